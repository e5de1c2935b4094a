from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from feedforge.functions import lists as L
from feedforge.functions import scalars as S
from feedforge.functions import text as X


def each(spark, schema, rows, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def one(spark, schema, row, expr):
    return each(spark, schema, [row], expr)[0]


def test_tail_and_pad(spark):
    rows = [([10, 20, 30, 40, 50],), ([60, 70],), ([80],), ([],), (None,)]
    assert each(spark, "x array<int>", rows, L.tail(F.col("x"), 2)) == [[40, 50], [60, 70], [80], [], None]
    assert each(spark, "x array<int>", rows, L.tail(F.col("x"), 0)) == [[], [], [], [], None]
    assert each(spark, "x array<int>", rows, L.pad_left(F.col("x"), 2, F.lit(0))) == [[40, 50], [60, 70], [0, 80], [0, 0], None]


def test_labels(spark):
    rows = [([11, 12, 13, 14], [14, 11, 99]), ([21], [22]), ([31, 32], None), ([], [41]), ([51, 51], [51])]
    made = L.binary_labels(F.col("i"), F.col("c"))
    assert each(spark, "i array<int>, c array<int>", rows, made) == [[1, 0, 0, 1], [0], [0, 0], [], [1, 1]]
    assert each(spark, "i array<int>, c array<int>", rows[:1], L.clicked_of(F.col("i"), made)) == [[11, 14]]


def test_without_keeps_order_and_repeats(spark):
    rows = [([5, 6, 5, 7, 6], [6]), ([5, 6], None), ([5], [5]), ([], [5])]
    assert each(spark, "i array<int>, c array<int>", rows, L.without(F.col("i"), F.col("c"))) == [[5, 5, 7], [5, 6], [], []]


def test_keep_listed_and_scalar(spark):
    allowed = F.array(F.lit(2), F.lit(4))
    rows = [([1, 2, 3, 4, 2],), ([1, 3],), ([],), (None,)]
    assert each(spark, "b array<int>", rows, L.keep_listed(F.col("b"), allowed)) == [[2, 4, 2], None, None, None]
    assert each(spark, "b int", [(2,), (3,), (None,)], L.keep_scalar(F.col("b"), [2, 4])) == [2, None, None]


def test_decay(spark):
    x = ([7, 7, 7, 7],)
    assert one(spark, "x array<int>", x, L.linear_decay(F.col("x"))) == [0.25, 0.5, 0.75, 1.0]
    assert one(spark, "x array<int>", x, L.linear_decay(F.col("x"), False)) == [1.0, 0.75, 0.5, 0.25]
    assert one(spark, "x array<int>", x, L.exponential_decay(F.col("x"), 0.1)) == pytest.approx([0.001, 0.01, 0.1, 1.0])
    assert each(spark, "x array<int>", [([],), (None,)], L.linear_decay(F.col("x"))) == [[], []]


def test_scale_nested(spark):
    rows = [([[1.0, 2.0], None, [4.0]],)]
    assert each(spark, "n array<array<double>>", rows, L.scale_nested(F.col("n"), F.array(F.lit(1.0), F.lit(5.0), F.lit(0.5)))) == [[[1.0, 2.0], [None], [2.0]]]


def test_rank_by_score(spark):
    rows = [([5.0, 9.0, 1.0, 7.0],), ([2.0, 2.0, 3.0],), ([],)]
    assert each(spark, "s array<double>", rows, L.rank_by_score(F.col("s"))) == [[3, 1, 4, 2], [3, 2, 1], []]


def test_map_values(spark):
    rows = [(["x", "none", "y"],), (None,), ([],)]
    m = F.create_map(F.lit("x"), F.lit(1), F.lit("y"), F.lit(2))
    assert each(spark, "x array<string>", rows, L.map_values(F.col("x"), m)) == [[1, None, 2], [None], []]
    assert each(spark, "x array<string>", rows, L.map_values(F.col("x"), m, F.lit(0))) == [[1, 0, 2], [0], []]
    assert each(spark, "x array<string>", rows, L.map_values(F.col("x"), m, drop_nulls=True)) == [[1, 2], None, []]
    assert each(spark, "x array<string>", rows, L.keys_in(F.col("x"), m)) == [["x", "y"], None, []]


def test_small_list_functions(spark):
    rows = [([3, None, 3, 5],), ([],), (None,)]
    run = lambda f: each(spark, "x array<int>", rows, f(F.col("x")))
    assert run(L.distinct) == [[3, None, 5], [], None] and run(L.drop_nulls) == [[3, 3, 5], [], None]
    assert run(lambda c: L.append(c, F.lit(9))) == [[3, None, 3, 5, 9], [9], None] and run(L.last) == [[5], [], None]
    assert run(L.first_element) == [3, None, None] and run(L.zeros_like) == [[0, 0, 0, 0], [], None]
    assert run(L.mean) == [pytest.approx(11 / 3), None, None]
    assert each(spark, "x array<int>", rows, L.chunks(F.col("x"), 3)) == [[[3, None, 3], [5]], [], []]


def test_run_lengths(spark):
    got = each(spark, "x array<string>", [(["a", "a", "b", "a"],), (["q"],), ([],), (None,)], L.run_lengths(F.col("x")))
    assert [[tuple(r) for r in x or []] for x in got] == [[("a", 2), ("b", 1), ("a", 1)], [("q", 1)], [], []]


def test_tokens(spark):
    rows = [("Zwei FLINKE Igel, and a cat_7!",), ("mod Øresund i 2024",), (None,), ("?!",)]
    assert each(spark, "t string", rows, X.tokens(F.col("t"))) == [["zwei", "flinke", "igel", "cat_7"], ["øresund", "2024"], [], []]
    assert each(spark, "t string", rows[1:2], X.tokens(F.col("t"), False)) == [["mod", "øresund", "i", "2024"]]
    assert each(spark, "t string", rows, X.word_count(F.col("t"))) == [6, 4, 0, 1]


def test_corpus_text(spark):
    rows = [("head", "body"), ("head", None), (None, None)]
    got = {f: each(spark, "t string, a string", rows, X.corpus_text(F.col("t"), F.col("a"), f)) for f in ("title", "abstract", "title_abstract")}
    assert got == {"title": ["head", "head", ""], "abstract": ["body", "", ""], "title_abstract": ["head body", "head ", " "]}


def test_two_time_formats(spark):
    rows = [("1/2/2021 3:04:05 AM",), ("12/31/2021 11:59 PM",), ("yesterday",), (None,)]
    assert each(spark, "t string", rows, X.two_format_time(F.col("t"))) == [dt.datetime(2021, 1, 2, 3, 4, 5), dt.datetime(2021, 12, 31, 23, 59), None, None]


def test_impression_tokens(spark):
    got = one(spark, "s string", ("art-9-1  z8-0 ",), X.impression_tokens(F.col("s")))
    assert [(z["id"], z["label"]) for z in got] == [("art-9", 1), ("z8", 0)]
    with pytest.raises(Exception, match="malformed"):
        one(spark, "s string", ("art9",), X.impression_tokens(F.col("s")))


def test_scalars(spark):
    x = lambda v, f: one(spark, "x double", (v,), f(F.col("x")))
    assert x(15.0, lambda c: S.scale_range(c, F.lit(10.0), F.lit(20.0), 0.0, 4.0)) == 2.0
    assert x(15.0, lambda c: S.scale_range(c, F.lit(15.0), F.lit(15.0), 3.0)) == 3.0
    assert x(1.5, S.clip_probability) == 1 - 1e-11 and x(-1.0, S.clip_probability) == 1e-11
    assert x(0.5, S.to_binary) == 1 and x(0.49, S.to_binary) == 0
    assert one(spark, "n int", (6,), S.combinations(F.col("n"), 3)) == 20 and one(spark, "n int", (2,), S.combinations(F.col("n"), 3)) == 0
    # two days, one hour, two minutes, three seconds
    assert one(spark, "n long", (2 * 86400 + 3723,), S.duration_text(F.col("n"))) == "2 days 1:2:3"
    assert each(spark, "p long, n long", [(4, 10), (0, 3)], S.positives_ratio(F.col("p"), F.col("n"))) == [2.5, None]
    assert each(spark, "k string", [("a",), ("q",), (None,)], S.map_value(F.col("k"), {"a": "A"}, "?")) == ["A", "?", "?"]
    assert each(spark, "k string", [("a",), ("q",)], S.map_value(F.col("k"), {"a": "A"})) == ["A", None]
    assert one(spark, "t timestamp", (dt.datetime(2020, 2, 29, 23, 0),), S.date_part(F.col("t"))) == dt.date(2020, 2, 29)
    assert len(one(spark, "n int", (1,), S.now_text())) == 19


def test_bm25_formulas(spark):
    # 10 documents, a term in 3 of them: ln(7.5 / 3.5) + 1
    idf = one(spark, "n double, df double", (10.0, 3.0), S.bm25_idf(F.col("n"), F.col("df")))
    assert idf == pytest.approx(math.log(7.5 / 3.5) + 1)
    term = one(spark, "tf double", (2.0,), S.bm25_term(F.lit(1.0), F.col("tf"), F.lit(10.0), F.lit(5.0)))
    assert term == pytest.approx(2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 2)))


def test_cosine_distance(spark):
    d = lambda a, b: one(spark, "a array<double>, b array<double>", (a, b), L.cosine_distance(F.col("a"), F.col("b")))
    assert d([3.0, 4.0], [4.0, 3.0]) == pytest.approx(1 - 24 / 25)
    assert d([1.0, 2.0], [-2.0, -4.0]) == pytest.approx(2)
    assert d([0.0, 0.0], [1.0, 1.0]) == 1
