from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from feedforge.sources import manifest, readers, registry, writers
from feedforge.streaming.popularity import windowed_popularity


def test_news(spark, tmp_path):
    (tmp_path / "n.tsv").write_text(
        'A10\tlocal\tharbour\tFerry "Alma" sails\tA "quoted" word\thttps://x.test/10\t[{"Label":"Alma","WikidataId":"Q77","SurfaceForms":["Alma","MS Alma"]}]\t[]\n'
        'A11\tfood\tsoup\tLeeks\t\thttps://x.test/11\t[]\t[{"WikidataId":"","SurfaceForms":["leek"]},{"WikidataId":"Q5"}]\n'
        "A12\tx\ty\tz\t\tu\tnot json\t\n"
    )
    rows = {r["article_id"]: r for r in readers.read_news(spark, str(tmp_path / "n.tsv")).collect()}
    assert rows["A10"]["title"] == 'Ferry "Alma" sails' and rows["A10"]["abstract"] == 'A "quoted" word' and rows["A11"]["abstract"] is None
    assert rows["A10"]["entities"] == ["Alma", "MS Alma"] and rows["A11"]["entity_ids"] == ["Q5"] and rows["A11"]["entities"] == ["leek"]
    assert rows["A12"]["entity_ids"] == []


def test_behaviors(spark, tmp_path):
    (tmp_path / "b.tsv").write_text("r1\tmia\t2/3/2022 4:05:06 PM\tA10  A11\tA12-0 A-7-1\nr2\tole\t10/30/2022 12:00 AM\t\tA10-1\nr3\tole\tnever\tA10\tA10-0\n")
    path = str(tmp_path / "b.tsv")
    rows = {r["impression_id"]: r for r in readers.read_behaviors(spark, path).collect()}
    assert set(rows) == {"r1", "r2"} and rows["r1"]["inview"] == ["A12", "A-7"] and rows["r1"]["labels"] == [0, 1] and rows["r1"]["history"] == ["A10", "A11"]
    assert rows["r1"]["impression_time"] == dt.datetime(2022, 2, 3, 16, 5, 6) and rows["r2"]["impression_time"] == dt.datetime(2022, 10, 30)
    assert rows["r2"]["history"] == [] and readers.dropped_times(spark, path).first()[0] == 1


def test_vectors_text(spark, tmp_path):
    (tmp_path / "v.vec").write_text("E1\t0.5 -2\n\n  E2   7  1.25 \n")
    rows = {r["entity_id"]: r["vector"] for r in readers.read_entity_vectors(spark, str(tmp_path / "v.vec")).collect()}
    assert rows == {"E1": [0.5, -2.0], "E2": [7.0, 1.25]}


def test_vector_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", [1.0, 2.0]), (None, "y", [1.0, 1.0]), (3, "z", None)], "article_id int, name string, embedding array<double>")
    writers.write_vectors(df, str(tmp_path / "v"))
    assert [(r["article_id"], r["vector"]) for r in readers.read_vectors(spark, str(tmp_path / "v")).collect()] == [("1", [1.0, 2.0])]


def test_registry_and_settings(spark, tmp_path):
    known = registry.from_settings({"small": {"kind": "tsv", "raw": "in", "archives": ["a.zip"], "vectors": "shared"}}, "/raw", "/out")
    assert known["small"] == registry.Dataset("tsv", "/out/small", "/raw/in", ("a.zip",), "/out/shared")
    with pytest.raises(ValueError):
        known["large"]
    with pytest.raises(ValueError):
        known.register("small", known["small"])
    nested = {"a": 1, "b": {"c": {"d": 2}, "e": 3}}
    assert registry.flattened(nested) == {"a": 1, "d-c-b": 2, "e-b": 3}
    registry.require_key({"x": {"k": 1}}, "k")
    with pytest.raises(ValueError):
        registry.require_key({"x": {"k": 1}, "y": {}}, "k")
    registry.write_settings(str(tmp_path / "s" / "c.json"), nested)
    assert registry.read_settings(str(tmp_path / "s" / "c.json")) == nested
    df = spark.createDataFrame([(7, "news", 0.5)], "id int, category string, p double")
    registry.write_lookup(df, str(tmp_path / "l"), "id")
    row = registry.read_lookup(spark, str(tmp_path / "l"), "category string, p double").first()
    assert (row["key"], row["value"]["category"], row["value"]["p"]) == ("7", "news", 0.5)


def test_normalizers(spark):
    raw = spark.createDataFrame([(1, None, None, [3, 4], 7)], "article_id int, title string, subtitle string, subcategory array<int>, category int")
    a = readers.normalize_articles(raw).first()
    assert (a["article_id"], a["title"], a["category"], a["subcategory"], a["entities"]) == ("1", "", "7", "3, 4", [])
    b = spark.createDataFrame([(1, 10, dt.datetime(2023, 5, 1), [1, 2], None), (2, 10, dt.datetime(2023, 5, 1), [], [1])], "impression_id int, user_id int, impression_time timestamp, article_ids_inview array<int>, article_ids_clicked array<int>")
    assert [r["labels"] for r in readers.normalize_behaviors(b).orderBy("impression_id").collect()] == [[0, 0], []]


def test_candidates_replace_stale_splits(spark, tmp_path):
    path = str(tmp_path / "c")
    make = lambda s: spark.createDataFrame([(1, s)], "row int, split string")
    writers.write_candidates(make("val").union(make("test")), path)
    writers.write_candidates(make("val"), path)
    assert writers.read_candidates(spark, path, "val").count() == 1
    with pytest.raises(ValueError):
        writers.read_candidates(spark, path, "test")


def test_submission_round_trip(spark, tmp_path):
    lines = spark.createDataFrame([(0, "r8 [2,4,1,3]"), (1, "r9,[1]")], "row int, line string")
    writers.write_submission(lines, str(tmp_path / "s"), "row")
    got = {r["impression_id"]: r["ranks"] for r in readers.read_submission(spark, str(tmp_path / "s")).collect()}
    assert got == {"r8": [2.0, 4.0, 1.0, 3.0], "r9": [1.0]}


def test_manifest_and_fingerprint(tmp_path):
    f = tmp_path / "f"
    f.write_bytes(b"x" * 100)
    whole, parts = manifest.fingerprint(str(f)), manifest.fingerprint(str(f), whole=50, edge=10)
    assert whole != parts and whole == manifest.fingerprint(str(f))
    path = str(tmp_path / "m" / "manifest.json")
    assert manifest.read_manifest(path) == {}
    sig = manifest.config_signature({"a": 1, "b": 2}, ["a"])
    assert sig == manifest.config_signature({"a": 1, "b": 3}, ["a"]) != manifest.config_signature({"a": 2}, ["a"])
    manifest.write_manifest(path, {"s": {"fingerprints": {"f": whole}, "signature": sig}})
    m = manifest.read_manifest(path)
    assert manifest.up_to_date(m, "s", {"f": whole}, sig, [str(f)])
    assert not manifest.up_to_date(m, "s", {"f": parts}, sig, [str(f)])
    assert not manifest.up_to_date(m, "s", {"f": whole}, sig, [str(f) + "gone"])
    assert manifest.unique_name(["a", "a_1"], "a") == "a_2"


def test_stream_equals_batch(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, h, m), k) for h in range(3) for m in (5, 50) for k in ("click", "view")]
    spark.createDataFrame(rows, "ts timestamp, event_type string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "in"))
    q = windowed_popularity(stream).writeStream.outputMode("complete").format("memory").queryName("pop").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    batch = windowed_popularity(spark.read.parquet(str(tmp_path / "in")))
    key = lambda df: sorted(tuple(r) for r in df.select(F.col("window_start").cast("string"), "event_type", "n").collect())
    assert key(spark.table("pop")) == key(batch)
