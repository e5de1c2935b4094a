"""Document fingerprints by MinHash (operator 2).

A fingerprint is the smallest value of each of 64 universal hashes over a text's word shingles, cut
to 16 bits and written in hex; the share of equal places of two fingerprints estimates the Jaccard
similarity of their shingle sets. Near documents are found by joining bands of four places in Spark,
each bucket's members with its smallest one first and open buckets in full afterwards, and are
verified on full sets (see `neardup`, which runs the same search over its own registers). The bands
are those of the fingerprints that are returned; no text is hashed twice for them.

Edge cases: null and empty texts have no shingles, share one fingerprint and are linked with nothing;
rows are ordered by doc_id (nulls first) and, where ids repeat, by a hash of their text; a null doc_id
takes no part in the links (component null); a table of one row has itself as next; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedforge.llm.common import bucket_of, checkpoint, range_count, ranges, release, slices
from feedforge.llm.neardup import ROWS, bands, classes, grouped
from feedforge.llm.shingles import minima, mix, set_digest, shingle_sets

PLACES = 64
SEED = 19970115


def fingerprints(texts: list[str]) -> np.ndarray:
    """A row of 16-bit places for each text."""
    return places(shingle_sets([t.encode() for t in texts]), PLACES)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal places, row by row."""
    return (a == b).mean(1)


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as many first code points of the following one."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _ordered(docs: DataFrame) -> DataFrame:
    """bucket, own, doc_id, tie, text in order; each bucket ends with a row of the next one's first document (ahead false)."""
    spark = docs.sparkSession
    n = range_count(spark)
    bounds = ranges(docs, "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)) + 64, n)
    placed = docs.withColumns({"bucket": bucket_of(F.col("doc_id"), bounds), "tie": F.xxhash64("text")})
    firsts = placed.groupBy("bucket").agg(F.min(F.struct("doc_id", "tie")).alias("at"))
    found = sorted((r["bucket"], r["at"]["doc_id"], r["at"]["tie"]) for r in firsts.collect())  # a row a bucket, under n
    before = [(found[i - 1][0], *found[i][1:]) for i in range(len(found))]
    ahead = F.broadcast(spark.createDataFrame(before, "to int, first_id long, first_tie long"))
    copied = placed.join(ahead, placed["doc_id"].eqNullSafe(ahead["first_id"]) & (placed["tie"] == ahead["first_tie"])).select(
        F.col("to").alias("bucket"), "doc_id", "tie", "text", F.lit(False).alias("own")
    )
    both = placed.select("bucket", "doc_id", "tie", "text", F.lit(True).alias("own")).unionByName(copied)
    return both.repartitionById(n, "bucket").sortWithinPartitions("bucket", F.desc("own"), "doc_id", "tie").select("bucket", "own", "doc_id", "tie", "text")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of each text and of its edit with the next row's text, and size and digest of its set."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "text_hash", "n", "digest"]
    held: tuple | None = None  # (bucket, own, doc_id, tie, text) whose next row has not come
    for batch in slices(batches, 4):
        *keys, texts = (c.to_pylist() for c in batch.columns)
        rows = list(zip(*keys, ("" if t is None else t for t in texts), strict=True))
        rows = ([held] if held else []) + rows
        held = rows[-1]
        todo = [i for i in range(len(rows) - 1) if rows[i][1] and rows[i][0] == rows[i + 1][0]]
        if not todo:
            continue
        sets = shingle_sets([r[4].encode() for r in rows])
        plain = places(sets, PLACES)
        changed = [edited(rows[i][4], rows[i + 1][4]) for i in todo]
        other = fingerprints(changed)
        mine, following = plain[todo], plain[[i + 1 for i in todo]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][2] for i in todo], pa.int64()),
                pa.array([len(rows[i][4]) for i in todo], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).digest() for x in changed], pa.binary()),
                pa.array([x.tobytes() for x in mine], pa.binary()),
                pa.array([x.tobytes() for x in other], pa.binary()),
                pa.array(likeness(mine, other)),
                pa.array(likeness(mine, following)),
                pa.array([rows[i][3] for i in todo], pa.int64()),
                pa.array([len(sets[i]) for i in todo], pa.int64()),
                pa.array([set_digest(sets[i]) for i in todo], pa.binary()),
            ],
            names=names,
        )


def _edits(docs: DataFrame) -> DataFrame:
    schema = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, text_hash long, n long, digest binary"
    return _ordered(docs).mapInArrow(_rows, schema)


def _in_hex(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and the likeness of both and of the next document's."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _in_hex(_edits(base).drop("text_hash", "n", "digest"))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """fingerprint_edits() and n_shingles, component_id, kept of the classes that the bands of the same fingerprints find.

    The fingerprints are written once, so that what ordered the texts can go before the bands are joined.
    """
    if ROWS * bands(percent) > PLACES:
        raise ValueError(f"{PLACES} places are too few for bands at {percent} %")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = checkpoint(_edits(base))
    release(docs.sparkSession, rounds=4)
    linked = _in_hex(grouped(base, "doc_id", "text", percent, test=plausible, known=rows.withColumn("sketch", F.col("fingerprint"))))
    component = F.coalesce("component_id", "doc_id")
    return linked.drop("text_hash", "node", "component").withColumns({"component_id": component, "kept": F.coalesce(F.col("doc_id") == component, F.lit(True))}).withColumnRenamed("n", "n_shingles")


def places(sets: list[np.ndarray], count: int) -> np.ndarray:
    """A row of 16-bit places for each set."""
    return (mix(minima(sets, count, SEED)) >> np.uint64(48)).astype("<u2")


def plausible(n1: np.ndarray, n2: np.ndarray, a: np.ndarray, b: np.ndarray, limit: float) -> np.ndarray:
    """Pairs whose equal places are not over e ** 12 times likelier under another similarity than under the limit or more."""
    count = b.shape[1]
    same = (a == b).sum(1)
    share = np.clip(same / count, 1e-9, 1 - 1e-9)
    best = same * np.log(share) + (count - same) * np.log(1 - share)
    here = same * np.log(limit) + (count - same) * np.log(1 - limit)
    return (share >= limit) | (here >= best - 12)


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept: documents joined by bands of their fingerprints, verified on full sets."""
    return classes(docs, id_col, text_col, percent, make=places, test=plausible)
