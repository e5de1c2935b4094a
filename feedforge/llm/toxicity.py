"""Toxicity by FTRL-proximal logistic regression (operator 6).

Features are hashed words, word pairs and skip-grams (two words around a third), each once a text.
Each weight has its own learning rate from its gradients so far, and the L1 term keeps most weights
at exactly zero, so that what is broadcast for scoring is a short sparse table. The model is fitted
in one task on at most SAMPLE different labelled texts, the first by a hash of doc_id, that are not held out;
labels, language, source and doc_id are never features.

Edge cases: null and empty texts have the score of the intercept alone; labels that are null or
whose text is null are not learned from; without any label to learn from every score is 0; repeated
rows are scored each on its own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedforge.llm.common import slices
from feedforge.llm.shingles import NOT_ALNUM, mix, words
from feedforge.llm.tokens import texts_of

#: The most labelled rows that the model is fitted on.
SAMPLE = 10_000
BUCKETS = 1 << 20
ALPHA, BETA, L1, L2, PASSES = 2.0, 1.0, 8.0, 0.1, 8
#: Toxic rows are about one in ten; their gradients count this many times.
WEIGHT = 2.0
CUT = 0.3
_K = np.uint64(0x9FB21C651E98DF25)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def _hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of all texts, with repeats, and the text of each. Bucket 0 is the intercept's."""
    h, at = words(texts, NOT_ALNUM)
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    parts, owners = [h], [doc]
    for gap in (1, 2):
        if len(h) > gap:
            same = doc[:-gap] == doc[gap:]
            parts.append((h[:-gap] * _K + mix(h[gap:] + np.uint64(gap)))[same])
            owners.append(doc[:-gap][same])
    buckets = (mix(np.concatenate(parts)) % np.uint64(BUCKETS - 1)).astype(np.int64) + 1
    return buckets, np.concatenate(owners)


def features(texts: list[str]) -> list[np.ndarray]:
    """The distinct feature buckets of each text."""
    buckets, owner = _hashed([t.encode() for t in texts])
    pairs = np.unique(owner * BUCKETS + buckets)
    cut = np.searchsorted(pairs // BUCKETS, np.arange(1, len(texts)))
    return [np.concatenate((np.zeros(1, np.int64), x % BUCKETS)) for x in np.split(pairs, cut)]


def fit(rows: list[np.ndarray], labels: list[int], passes: int = PASSES) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights that are not zero."""
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)

    def weights(i: np.ndarray) -> np.ndarray:
        pull = np.maximum(np.abs(z[i]) - np.where(i == 0, 0.0, L1), 0)
        return -np.sign(z[i]) * pull / ((BETA + np.sqrt(n[i])) / ALPHA + L2)

    for _ in range(passes):
        for i, y in zip(rows, labels, strict=True):
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            g *= WEIGHT if y else 1.0
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    w = weights(np.arange(BUCKETS))
    used = np.flatnonzero(w)
    return used, w[used]


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 0):
        found = features(texts_of(batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array([x.astype("<i4").tobytes() for x in found], pa.binary()), *batch.columns[1:]], names=["features", "y", "turn", "text_hash"])


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    rows.sort(key=lambda r: (r[2], r[1], r[3]))
    used, w = fit([np.frombuffer(x, "<i4").astype(np.int64) for x, *_ in rows], [r[1] for r in rows])
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int32()), "weight": pa.array(w, pa.float64())})


def examples(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """features, y and the order of the different labelled texts, `sample` at most."""
    turn = F.xxhash64("doc_id")
    named = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    chosen = named.filter(~held_out(F.col("doc_id")) & F.col("y").isin(0, 1)).distinct().withColumn("turn", turn).orderBy("turn", "y").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    # an id that comes with many texts or many times adds no more rows than the bound
    labelled = texts.join(F.broadcast(chosen), "doc_id").withColumn("text_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "text_hash", "y"])
    return labelled.select("text", "y", "turn", "text_hash").mapInArrow(_featured, "features binary, y int, turn long, text_hash long").orderBy("turn", "y", "text_hash").limit(sample)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **cols: str) -> list[tuple[int, float]]:
    """The sparse weights; at most BUCKETS, and few of them."""
    found = examples(docs, labels, sample, **cols).repartition(1).mapInArrow(_fitted, "bucket int, weight double")
    return [(r["bucket"], r["weight"]) for r in found.collect()]


def probabilities(texts: list[str], dense: np.ndarray) -> np.ndarray:
    """Scores of texts under dense weights."""
    buckets, owner = _hashed([t.encode() for t in texts])
    live = dense[buckets] != 0
    pairs = np.unique(owner[live] * BUCKETS + buckets[live])
    total = np.bincount(pairs // BUCKETS, dense[pairs % BUCKETS], len(texts)) + dense[0]
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def _scored(batches: Iterator[pa.RecordBatch], weights) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    used, w = weights.value
    dense = np.zeros(BUCKETS)
    dense[used] = w
    for batch in slices(batches, 2):
        scores = probabilities(texts_of(batch.column(2)), dense) if len(used) else np.zeros(batch.num_rows)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(scores), pa.array((scores >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])


def score(docs: DataFrame, weights: list[tuple[int, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    sent = docs.sparkSession.sparkContext.broadcast((np.array([i for i, _ in weights], np.int64), np.array([w for _, w in weights])))
    doc_id = F.col(id_col).cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(held_out(doc_id), F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(partial(_scored, weights=sent), "doc_id long, held_out boolean, score double, predicted int")
