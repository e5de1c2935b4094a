"""Quality rules with adaptive thresholds (operator 10), in DataFrame functions only.

Every document gets word, symbol and repetition counts. Three measures that vary between all
documents go into one mergeable quantile sketch for each language and source: characters a hundred
words, ASCII punctuation and symbols among a thousand word characters, and different words among a
thousand. A sketch is a log-linear histogram whose buckets are exact below 256 and 1/128 wide
relative to their value above; merging two sketches adds counts. Copies of a text count once in a
sketch, so that no group of copies decides what is usual.

The fences of a group lie `REACH` spreads beyond its quartiles, on both sides. The spread is the
distance of the quartiles, or a sixteenth of their sum and one unit of the measure where that is more. Quartiles are those of the
group's own sketch and of its language's merged one, weighted by the group's texts and by PRIOR, so
that small groups lean on their language without a switch between the two.

Edge cases: a null or empty text has no words, fails the base rule and goes into no sketch (nor does
any other text that fails it); a group without any other text has null fences and its documents have
all failed; a null language or source counts as ''; repeated rows are judged each on its own, also
where rows with one id and text differ in language or source; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedforge.llm.common import WORD_BREAK, checkpoint, flag_members, fresh, let

#: Measures under the adaptive fences.
MEASURES = ["word_length", "mark_rate", "distinct_rate"]
#: Spreads between a quartile and its fence.
REACH = 2.5
#: Texts of its language that a group's quartiles count beside its own.
PRIOR = 50


#: ASCII punctuation and symbols.
MARKS = r"[!-/:-@\[-`{-~]"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_BREAK), "")


def _windows(words: Column) -> Column:
    """A hash of each window of three words."""
    each = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )
    return F.when(F.size(words) >= 3, each).otherwise(F.expr("array()").cast("array<bigint>"))


def _covered(windows: Column) -> Column:
    """Words in windows that occur twice or more: hashes are sorted with their places, equal neighbours are repeats."""

    def from_sorted(z: Column) -> Column:
        hit = F.filter(
            z,
            lambda e, k: F.coalesce(F.get(z, k + 1)["h"] == e["h"], F.lit(False))
            | F.when(k > 0, F.get(z, k - 1)["h"] == e["h"]).otherwise(False),
        )
        places = F.array_sort(F.transform(hit, lambda e: e["i"]))
        return let(
            places,
            lambda p: F.aggregate(
                F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(3)), F.lit(3))),
                F.lit(0),
                lambda a, b: a + b,
            ),
        )

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(pairs, from_sorted))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row a document: id, text hash, group, the base counts and the rates in per mille."""
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(text_col).alias("text_hash"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = base.select("doc_id", "text_hash", "lang", "source", "text", _words(F.col("text")).alias("words"), lines.alias("lines"))
    windowed = split.select(
        "doc_id",
        "text_hash",
        "lang",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("text", F.lit(MARKS)).cast("long").alias("n_marks"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        _windows(F.col("words")).alias("windows"),
    )
    counted = windowed.withColumn("n_repeat_words", _covered(F.col("windows")).cast("long")).drop("windows")
    rate = lambda scale, part, whole: F.expr(f"({scale} * {part}) div greatest({whole}, 1)")
    return counted.withColumns(
        {
            "word_length": rate(100, "word_chars", "n_words"),
            "mark_rate": rate(1000, "n_marks", "word_chars"),
            "distinct_rate": rate(1000, "n_distinct", "n_words"),
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        }
    )


def sketch_bucket(value: Column) -> Column:
    """The smallest value of the bucket: exact below 256, otherwise the eight leading bits."""
    shift = F.greatest(F.length(F.bin(value)) - 8, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(measured: DataFrame) -> DataFrame:
    """Bucket counts of each measure for each language and source, over different texts; adding counts merges sketches."""
    once = measured.filter(~F.col("base_failed")).select("lang", "source", "text_hash", *MEASURES).distinct()
    each = F.array(*[F.struct(F.lit(m).alias("metric"), sketch_bucket(F.col(m)).alias("bucket")) for m in MEASURES])
    return once.select("lang", "source", F.inline(each)).groupBy("lang", "source", "metric", "bucket").agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """keys, metric, q1, q3, total of sketches."""
    w = Window.partitionBy(*keys, "metric")
    cum = sketch.withColumn("cum", F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(w))
    at = lambda q: F.min(F.when(F.col("cum") * 4 >= F.col("total") * q, F.col("bucket")))
    return cum.groupBy(*keys, "metric").agg(at(1).alias("q1"), at(3).alias("q3"), F.max("total").alias("total"))


def fences(sketch: DataFrame, prior: int = PRIOR, reach: float = REACH) -> DataFrame:
    """Lower and upper fences of each measure for each language and source."""
    own = quartiles(sketch, "lang", "source")
    merged = sketch.groupBy("lang", "metric", "bucket").agg(F.sum("n").alias("n"))
    pooled = quartiles(merged, "lang").select("lang", "metric", F.col("q1").alias("p1"), F.col("q3").alias("p3"))
    lean = lambda q, p: F.expr(f"({q} * total + {p} * {prior}) div (total + {prior})")
    both = own.join(pooled, ["lang", "metric"]).select("lang", "source", "metric", lean("q1", "p1").alias("q1"), lean("q3", "p3").alias("q3"))
    spread = F.greatest(F.col("q3") - F.col("q1"), F.expr("(q1 + q3) div 16 + 1"))
    sided = both.withColumn("low", F.col("q1") - reach * spread).withColumn("high", F.col("q3") + reach * spread)
    of = lambda m, side: F.max(F.when(F.col("metric") == m, F.col(side))).alias(f"{m}_{side}")
    return sided.groupBy("lang", "source").agg(*[of(m, side) for m in MEASURES for side in ("low", "high")])


def verdicts(docs: DataFrame, prior: int = PRIOR, reach: float = REACH, **cols: str) -> DataFrame:
    """Measures, group fences and the verdict of every document."""
    measured = checkpoint(measures(docs, **cols))
    judged = measured.join(fences(sketches(measured), prior, reach), ["lang", "source"], "left")
    passed = ~F.col("base_failed")
    for m in MEASURES:
        passed = passed & F.coalesce(F.col(m).between(F.col(f"{m}_low"), F.col(f"{m}_high")), F.lit(False))
    return judged.withColumn("kept", passed)


def filter_quality(docs: DataFrame, prior: int = PRIOR, reach: float = REACH, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The documents that pass, with all their columns. A row goes by the verdict of its own text, language and source.

    Two bitmaps, of what passed and of what failed, settle nearly all rows where they lie; texts are
    shuffled only for rows that may be in both.
    """
    names = [fresh(docs, x) for x in ("id", "hash", "lang", "source")]
    judged = verdicts(docs, prior, reach, id_col=id_col, text_col=text_col, lang_col=lang_col, source_col=source_col)
    judged = checkpoint(judged.select("doc_id", "text_hash", "lang", "source", "kept").toDF(*names, "kept"))
    group = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    mine = [F.col(id_col), F.xxhash64(text_col), group(lang_col), group(source_col)]
    keys = lambda rows: rows.select(F.xxhash64(*names))
    may_pass, may_fail = fresh(docs, "may_pass"), fresh(docs, "may_fail")
    flagged = flag_members(docs, F.xxhash64(*mine), keys(judged.filter("kept")), may_pass, per_key=32)
    flagged = flag_members(flagged, F.xxhash64(*mine), keys(judged.filter("not kept")), may_fail, per_key=32).filter(may_pass)
    same = mine[0].eqNullSafe(F.col(names[0]))
    for c, name in zip(mine[1:], names[1:], strict=True):
        same = same & (c == F.col(name))
    doubtful = flagged.filter(may_fail).join(judged.filter("kept").drop("kept"), same, "left_semi")
    return flagged.filter(~F.col(may_fail)).unionByName(doubtful).drop(may_pass, may_fail)
