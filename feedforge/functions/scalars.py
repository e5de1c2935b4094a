"""Scalar formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bm25_idf(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs - df + 0.5) / (df + 0.5)) + 1


def bm25_term(idf: Column, tf: Column, dl: Column, avgdl: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def scale_range(x: Column, lo: Column, hi: Column, to_lo: float = 0.0, to_hi: float = 1.0) -> Column:
    """x carried from [lo, hi] to [to_lo, to_hi]; to_lo where the range is empty."""
    return F.when(hi > lo, (x - lo) / (hi - lo) * (to_hi - to_lo) + to_lo).otherwise(F.lit(to_lo))


def clip_probability(p: Column, eps: float = 1e-11) -> Column:
    return F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))


def to_binary(p: Column, threshold: float = 0.5) -> Column:
    return F.when(p >= threshold, 1).otherwise(0)


def combinations(n: Column, r: int) -> Column:
    """n choose r as a product, for any n."""
    out = F.lit(1.0)
    for i in range(r):
        out = out * (n - i) / (i + 1)
    return F.when(n >= r, F.round(out)).otherwise(0.0)


def seconds_between(later: Column, earlier: Column) -> Column:
    """Difference of two times in seconds, to the microsecond."""
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    return (micros(later) - micros(earlier)) / 1e6


def digest_order(seed: int | str, *keys: Column) -> Column:
    """A reproducible pseudo-random order: the digest of seed and keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def duration_text(seconds: Column) -> Column:
    """Days, hours, minutes and seconds, none of them padded."""
    s = seconds.cast("long")
    return F.format_string("%d days %d:%d:%d", F.floor(s / 86400), F.floor(s / 3600) % 24, F.floor(s / 60) % 60, s % 60)


def positives_ratio(n_pos: Column, n_neg: Column) -> Column:
    """Negatives for each positive; null without positives."""
    return n_neg / F.nullif(n_pos, F.lit(0))


def map_value(c: Column, values: dict, default: str | None = None) -> Column:
    """The value of a small table of constants; the default where it has none."""
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    found = F.try_element_at(table, c) if values else F.lit(None).cast("string")
    return F.coalesce(found, F.lit(default)) if default is not None else found


def date_part(c: Column) -> Column:
    """The date of a time."""
    return F.to_date(c)


def now_text() -> Column:
    """The time of the query as year-month-day-hour-minute-second."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd-HH-mm-ss")
