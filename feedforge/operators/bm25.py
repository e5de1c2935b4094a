"""Lexical retrieval over a relational inverted index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedforge.functions.lists import run_lengths
from feedforge.functions.scalars import bm25_idf, bm25_term
from feedforge.functions.text import tokens


#: Documents of a part of an index.
PART_DOCS = 1 << 13
#: Terms of all queries up to which they travel to the postings, instead of meeting them by shuffles.
MOST_TERMS = 1 << 17


@dataclass(frozen=True)
class Bm25Index:
    """postings(term, doc_ix, tf, dl), terms(term, df, idf, avgdl) and docs(doc_ix, dl)."""

    postings: DataFrame
    terms: DataFrame
    docs: DataFrame
    k1: float
    b: float
    held: tuple[DataFrame, ...] = ()

    def save(self, folder: str) -> None:
        """Write the index as tables, postings in ranges of terms, so that a search reads few of their pages."""
        self.terms.write.mode("overwrite").parquet(f"{folder}/terms")
        self.docs.write.mode("overwrite").parquet(f"{folder}/docs")
        self.postings.repartitionByRange("term", "doc_ix").sortWithinPartitions("term", "doc_ix").write.mode("overwrite").parquet(f"{folder}/postings")

    def release(self) -> None:
        """Give back what the index keeps of its corpus."""
        for df in self.held:
            df.unpersist()


def load_index(spark: SparkSession, folder: str, k1: float = 1.5, b: float = 0.75) -> Bm25Index:
    return Bm25Index(*(spark.read.parquet(f"{folder}/{t}") for t in ("postings", "terms", "docs")), k1, b)


def build_index(corpus: DataFrame, doc_ix: str, text: str, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, remove_stopwords: bool = True) -> Bm25Index:
    """An index of corpus(doc_ix, text), a row a document.

    A document's words are counted inside its row. Documents are dealt by their number into parts of
    about PART_DOCS and kept with their words and lengths until `release`, so that neither postings nor
    lengths are shuffled again and a search adds up a document's score where it lies. A raw idf below zero
    becomes `epsilon` times the mean raw idf over distinct terms; the average length counts empty documents.
    """
    parts = max(int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-corpus.count() // PART_DOCS))
    dealt = corpus.select(F.col(doc_ix).alias("doc_ix"), F.col(text).alias("text")).repartition(parts, "doc_ix")
    words = dealt.select("doc_ix", tokens(F.col("text"), remove_stopwords).alias("words"))
    ordered = words.select("doc_ix", F.size("words").cast("long").alias("dl"), F.sort_array("words").alias("words"))
    whole = ordered.select("doc_ix", "dl", run_lengths(F.col("words")).alias("runs")).persist()
    postings = whole.select("doc_ix", "dl", F.inline("runs")).toDF("doc_ix", "dl", "term", "tf").select("term", "doc_ix", "tf", "dl")
    docs = whole.select("doc_ix", F.when(F.col("doc_ix").isNull(), 0).otherwise(F.col("dl")).alias("dl"))
    n = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    # the mean and the terms both read the counts
    counts = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).persist()
    raw = counts.crossJoin(F.broadcast(n)).withColumn("raw", bm25_idf(F.col("n_docs"), F.col("df")))
    mean = raw.agg(F.avg("raw").alias("mean_raw"))
    terms = raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, epsilon * F.col("mean_raw")).otherwise(F.col("raw")).alias("idf"), "avgdl")
    return Bm25Index(postings, terms, docs, k1, b, (whole, counts))


def search(index: Bm25Index, queries: DataFrame, row: str, text: str, top_k: int, remove_stopwords: bool = True, zero_fill: bool = True) -> DataFrame:
    """row, doc_ix, score, rank: the top_k documents of each query, equal scores by doc_ix.

    A query's repeated terms count once. With zero_fill, queries with fewer hits are filled with
    unmatched documents of score 0 by ascending doc_ix: only the first top_k documents can be needed,
    so the filling looks at those alone. Up to MOST_TERMS terms of all queries are broadcast to the
    postings; more of them meet the postings by shuffles. Nothing is kept once the result has been read.
    """
    wanted = queries.select(F.col(row).alias("__row"), F.explode(F.array_distinct(tokens(F.col(text), remove_stopwords))).alias("term"))
    # the queries' terms, with their weights, cut the postings down in one join
    asked = wanted.join(index.terms, "term")
    few = wanted.limit(MOST_TERMS + 1).count() <= MOST_TERMS
    weighted = index.postings.join(F.broadcast(asked) if few else asked, "term")
    part = bm25_term(F.col("idf"), F.col("tf"), F.col("dl"), F.col("avgdl"), index.k1, index.b)
    hits = weighted.groupBy("__row", "doc_ix").agg(F.round(F.sum(part), 9).alias("score")).filter("score <> 0")
    w = Window.partitionBy("__row").orderBy(F.desc("score"), "doc_ix")
    best = hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k)
    if not zero_fill:
        return best.select(F.col("__row").alias(row), "doc_ix", "score", "rank")
    first = index.docs.select("doc_ix").orderBy("doc_ix").limit(top_k)
    free = queries.select(F.col(row).alias("__row")).crossJoin(F.broadcast(first)).select("__row", "doc_ix", F.lit(0.0).alias("score"), F.lit(False).alias("__hit"))
    both = best.select("__row", "doc_ix", "score", F.lit(True).alias("__hit")).unionByName(free)
    once = both.groupBy("__row", "doc_ix").agg(F.max_by("score", "__hit").alias("score"), F.max("__hit").alias("__hit"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("__row").orderBy(F.desc("__hit"), F.desc("score"), "doc_ix"))).filter(F.col("rank") <= top_k)
    return ranked.select(F.col("__row").alias(row), "doc_ix", "score", "rank")


def history_queries(history: DataFrame, articles: DataFrame, cap: int, row: str, item: str, text: str, pos: str = "pos") -> DataFrame:
    """row, query: texts of the last `cap` clicks, oldest first; unknown and empty texts are skipped after the cap."""
    if cap <= 0:
        return history.select(row).distinct().withColumn("query", F.lit(""))
    w = Window.partitionBy(row).orderBy(F.desc(pos))
    last = history.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= cap)
    texts = last.join(articles.select(F.col(item), F.nullif(F.col(text), F.lit("")).alias("__t")), item, "left")
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("__t").isNotNull(), F.struct(F.col(pos).alias("p"), F.col("__t").alias("t"))))), lambda s: s["t"])
    return texts.groupBy(row).agg(F.array_join(listed, " ").alias("query"))


def recall(gt: Column, candidates: Column, k: int) -> Column:
    """Share of ground-truth elements among the first k candidates; repeats count each, empty truth gives 0."""
    hit = F.size(F.filter(gt, lambda x: F.array_contains(F.slice(candidates, 1, k), x)))
    return F.when(F.size(gt) > 0, hit / F.size(gt)).otherwise(0.0)


def recall_by_history(candidates: DataFrame, k: int, n_history: str = "n_history", gt: str = "gt_clicked", found: str = "candidates", split: str = "split") -> DataFrame:
    """split, slice (cold, warm), n, recall: mean recall at k of rows with a click, by whether there was a history; null without rows."""
    asked = candidates.filter(F.size(gt) > 0).withColumn("__r", recall(F.col(gt), F.col(found), k))
    cold = F.coalesce(F.col(n_history), F.lit(0)) == 0
    per = asked.groupBy(split).agg(F.count_if(cold).alias("nc"), F.count_if(~cold).alias("nw"), F.avg(F.when(cold, F.col("__r"))).alias("c"), F.avg(F.when(~cold, F.col("__r"))).alias("w"))
    return per.select(split, F.inline(F.array(F.struct(F.lit("cold").alias("slice"), F.col("nc").alias("n"), F.col("c").alias("recall")), F.struct(F.lit("warm").alias("slice"), F.col("nw").alias("n"), F.col("w").alias("recall")))))


def with_history_length(candidates: DataFrame, impressions: DataFrame, row: str, history: str = "history") -> DataFrame:
    """Candidates with n_history, the length of their row's history (0 for null)."""
    size = impressions.select(row, F.size(F.coalesce(history, F.array().cast(dict(impressions.dtypes)[history]))).alias("n_history"))
    return candidates.join(size, row, "left")
