"""Line dedup by distinct-site spread (operator 9).

Lines are compared after trimming ASCII white space; blank lines are never removed. A line is
boilerplate when its spread reaches `min_sites`: the smaller of the number of different sites (the
source column) that show it and the number of different documents that do, near copies (operator 1, at
a similarity of 0.8) counting as one document. So copies neither add spread nor take any from other
documents, and are left to document dedup. Only documents with a line that could reach the limit are
compared. Both numbers are HyperLogLog sketches merged by aggregation; lines whose smaller estimate is
close to the limit get exact distinct counts, so that the verdict does not depend on the sketch's
error. Boilerplate goes everywhere.

Lines that could matter are marked by a bitmap, so that a line's places never meet in one task:
sketches are aggregated where the places are, and the join that finds the places to remove is salted.

Edge cases: null and empty texts have no lines and stay as they are; a null site counts as '';
repeated rows count as places of the same line; an empty table gives an empty result. A document
never loses its row, though its text may become empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedforge.llm import neardup
from feedforge.llm.common import checkpoint, flag_members, fresh, release

#: Sites that must show a line before it counts as boilerplate.
MIN_SITES = 10
#: log2 of the registers; the standard error is about 0.8 / 2 ** (LG_K / 2).
LG_K = 10
#: Estimates within this share of a limit are counted exactly: five standard errors and more.
NEAR = 0.15
#: Tasks that the places of one line to remove are spread over.
SALTS = 32
#: Similarity from which documents count as copies of each other, in per cent.
COPIES = 80

_BLANK = " \t\n\x0b\x0c\r"


def _trimmed(text: Column) -> Column:
    return F.transform(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(_BLANK)))


def line_places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """A row for each line with text: document, text hash, place, line hash and site."""
    base = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.xxhash64(F.coalesce(F.col(site_col).cast("string"), F.lit(""))).alias("site"), F.transform(_trimmed(F.col(text_col)), lambda x: F.when(x == "", F.lit(0).cast("long")).otherwise(F.xxhash64(x))).alias("hashes")
    )
    each = F.transform("hashes", lambda h, k: F.struct(k.alias("place"), h.alias("line")))
    return base.select("doc_id", "text_hash", "site", F.inline(F.filter(each, lambda e: e["line"] != 0)))


def candidates(places: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """line, site, text_hash of all lines whose sites and different texts could reach the limit, and of few others."""
    frequent = places.groupBy("line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_sites).select("line")
    often = flag_members(places, F.col("line"), checkpoint(frequent), "often").filter("often")
    est = often.groupBy("line").agg(*[F.hll_sketch_estimate(F.hll_sketch_agg(c, F.lit(LG_K))).alias(c) for c in ("site", "text_hash")])
    least = min_sites * (1 - NEAR) - 2
    wide = checkpoint(est.filter((F.col("site") >= least) & (F.col("text_hash") >= least)).select("line"))
    return flag_members(places, F.col("line"), wide, "wide", per_key=64).filter("wide").select("line", "site", "text_hash").distinct()


def copy_classes(docs: DataFrame, asked: DataFrame, text_col: str = "text") -> DataFrame:
    """text_hash and class of near copies of the asked text hashes."""
    texts = docs.select(F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).join(asked, "text_hash", "left_semi")
    once = checkpoint(texts.groupBy("text_hash").agg(F.first("text").alias("text")))
    found = neardup.classes(once, "text_hash", "text", percent=COPIES)
    return found.select(F.col("doc_id").alias("text_hash"), F.col("component_id").alias("class"))


def boilerplate(seen: DataFrame, classes: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Hashes of the lines that are boilerplate, from candidates() and copy_classes()."""
    shown = checkpoint(seen.join(classes, "text_hash").select("line", "site", "class"))
    sizes = [F.hll_sketch_estimate(F.hll_sketch_agg(c, F.lit(LG_K))) for c in ("site", "class")]
    est = checkpoint(shown.groupBy("line").agg(F.least(*sizes).alias("spread")))
    unsure = F.abs(F.col("spread") - min_sites) <= max(min_sites * NEAR, 2)
    sure = est.filter(~unsure & (F.col("spread") >= min_sites)).select("line")
    asked = est.filter(unsure).select("line")
    # marked by a bitmap, so that a line's rows never meet; the few lines marked in vain go after counting
    again = flag_members(shown, F.col("line"), asked, "again", per_key=64).filter("again")
    enough = lambda c: again.select("line", c).distinct().groupBy("line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_sites).select("line")
    return sure.unionByName(asked.join(enough("site"), "line", "left_semi").join(enough("class"), "line", "left_semi"))


def _removals(docs: DataFrame, min_sites: int, **cols: str) -> DataFrame:
    """doc_id, text_hash and the places of the lines to remove."""
    places = checkpoint(line_places(docs, **cols))
    seen = checkpoint(candidates(places, min_sites))
    release(docs.sparkSession)
    classes = copy_classes(docs, seen.select("text_hash").distinct(), cols.get("text_col", "text"))
    gone = checkpoint(boilerplate(seen, classes, min_sites))
    release(docs.sparkSession)
    salted = gone.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    maybe = flag_members(places, F.col("line"), gone, "maybe", per_key=64).filter("maybe").withColumn("salt", F.pmod("text_hash", F.lit(SALTS)).cast("int"))
    hit = maybe.join(salted, ["line", "salt"], "left_semi").select("doc_id", "text_hash", "place")
    return checkpoint(hit.groupBy("doc_id", "text_hash").agg(F.collect_set("place").alias("gone")))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", counts: bool = False) -> DataFrame:
    """The documents without boilerplate lines; counts adds n_lines and n_removed_lines."""
    key, digest, gone, some = (fresh(docs, x) for x in ("id", "hash", "gone", "some"))
    removals = _removals(docs, min_sites, id_col=id_col, text_col=text_col, site_col=site_col).toDF(key, digest, gone)
    # texts that lose nothing are not shuffled
    row = lambda i, h: F.xxhash64(i, h)
    flagged = flag_members(docs, row(F.col(id_col), F.xxhash64(text_col)), removals.select(row(F.col(key), F.col(digest))), some, per_key=64)
    near = flagged.filter(some)
    same = near[id_col].eqNullSafe(removals[key]) & (F.xxhash64(near[text_col]) == removals[digest])
    none = F.lit(None).cast(dict(removals.dtypes)[gone])
    both = near.join(removals, same, "left").drop(key, digest).unionByName(flagged.filter(~F.col(some)).withColumn(gone, none))
    kept = F.array_join(F.filter(F.split(text_col, "\n", -1), lambda x, k: ~F.array_contains(gone, k)), "\n")
    out = {text_col: F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(kept)}
    if counts:
        out["n_lines"] = F.coalesce(F.size(F.filter(_trimmed(F.col(text_col)), lambda x: x != "")), F.lit(0)).cast("long")
        out["n_removed_lines"] = F.greatest(F.coalesce(F.size(gone), F.lit(0)), F.lit(0)).cast("long")
    return both.withColumns(out).drop(gone, some)
