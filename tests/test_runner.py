"""Fingerprints of tables, and a run that skips what is up to date."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from feedforge.plans.runner import Stage, found, run_stages, table_fingerprint


def digest(df):
    r = table_fingerprint(df).first()
    return r["n"], r["digest"]


def test_fingerprint_is_of_the_multiset(spark):
    rows = [(1, "a", [1.5, None]), (2, None, []), (2, None, []), (3, "", None)]
    df = spark.createDataFrame(rows, "i int, t string, v array<double>")
    same = spark.createDataFrame(rows[::-1], "i int, t string, v array<double>").repartition(7).select("v", "t", "i")
    assert digest(df) == digest(same) and digest(df)[0] == 4
    others = [rows[:3], rows + rows[:1], [(1, "a", [1.5, 0.0]), *rows[1:]], [(1, "a", [1.5, None]), (2, "", []), (2, None, []), (3, "", None)]]
    assert len({digest(df), *(digest(spark.createDataFrame(o, "i int, t string, v array<double>")) for o in others)}) == 5
    assert digest(df.limit(0)) == (0, "0" * 32)
    odd = spark.createDataFrame([(bytearray(b"\x00"), {"k": 1})], "`a.b` binary, m map<string,int>")
    assert digest(odd)[0] == 1


def test_a_second_run_touches_nothing(spark, tmp_path):
    calls = []

    def double(a, by):
        calls.append("double")
        return a.withColumn("x", F.col("x") * by)

    def joined(a, b):
        calls.append("joined")
        return a.join(b.select("i", F.col("x").alias("y")), "i")

    source = spark.createDataFrame([(1, 2), (2, 3)], "i int, x int")
    plan = lambda by: [Stage("double", ("raw",), double, {"by": by}), Stage("joined", ("raw", "double"), joined)]
    run = lambda by, rows, **kw: run_stages(spark, plan(by), {"raw": rows}, str(tmp_path), **kw)
    first = run(2, source)
    assert first.built == ["double", "joined"] and sorted(tuple(r) for r in first.tables["joined"].collect()) == [(1, 2, 4), (2, 3, 6)]
    again = run(2, source.repartition(3))
    assert again.built == [] and calls == ["double", "joined"] and again.signatures == first.signatures
    # a setting, a row, and a folder without its mark of success
    assert run(3, source).built == ["double", "joined"] and sorted(tuple(r) for r in run(3, source).tables["joined"].collect()) == [(1, 2, 6), (2, 3, 9)]
    assert run(3, source.union(source.limit(1))).built == ["double", "joined"]
    now = run(3, source)
    (tmp_path / "joined" / now.signatures["joined"] / "_SUCCESS").unlink()
    assert run(3, source).built == ["joined"] and run(3, source, force=True).built == ["double", "joined"]
    assert len(found(spark, f"{tmp_path}/joined/*")) == 1
    with pytest.raises(KeyError):
        run_stages(spark, [Stage("x", ("nowhere",), double)], {}, str(tmp_path))
