"""Exact quantiles without a buffer of values.

Order statistics are found by histograms that close in on them: each round counts the rows of the
brackets still open in PARTS stretches of equal width, with the least and the greatest value of each,
and keeps the stretch that holds the rank asked for, from its least value to its greatest. A bracket of
one value is done. Counts alone reach the driver, and no task ever holds more than its own histogram.

Nulls don't count. Infinite values and NaN, which comes last, are told apart by their numbers.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stretches that a bracket is cut into in a round.
PARTS = 1024


def order_statistics(values: DataFrame, asked: dict[object, Sequence[int]], group: str = "metric", value: str = "x") -> dict[tuple[object, int], float]:
    """(group, rank) -> value of that rank, from 0, among the group's finite values."""
    rows = values.select(F.col(group).alias("__g"), F.col(value).cast("double").alias("__x")).filter(F.abs("__x") < float("inf"))
    ends = {r["__g"]: (r["lo"], r["hi"]) for r in rows.groupBy("__g").agg(F.min("__x").alias("lo"), F.max("__x").alias("hi")).collect()}
    open_ = {(g, k): (*ends[g], 0) for g, ranks in asked.items() for k in ranks if g in ends}
    done: dict[tuple[object, int], float] = {}
    while True:
        done |= {key: lo for key, (lo, hi, _) in open_.items() if lo == hi}
        open_ = {key: b for key, b in open_.items() if b[0] < b[1]}
        if not open_:
            return done
        brackets = sorted({(g, lo, hi) for (g, _), (lo, hi, _) in open_.items()}, key=str)
        number = {b: i for i, b in enumerate(brackets)}
        kind = dict(rows.dtypes)["__g"]
        table = rows.sparkSession.createDataFrame([(i, g, lo, hi, 1.0 if math.isfinite(hi - lo) else 0.5) for (g, lo, hi), i in number.items()], f"__b int, __k {kind}, __lo double, __hi double, __f double")
        # by halves where the width of a bracket is more than a double can hold
        scaled = lambda c: F.col(c) * F.col("__f")
        share = (scaled("__x") - scaled("__lo")) / (scaled("__hi") - scaled("__lo"))
        part = F.least(F.floor(share * PARTS), F.lit(PARTS - 1))
        inside = rows.join(F.broadcast(table), F.col("__g").eqNullSafe(F.col("__k")) & (F.col("__x") >= F.col("__lo")) & (F.col("__x") <= F.col("__hi")))
        found = inside.groupBy("__b", part.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min("__x").alias("lo"), F.max("__x").alias("hi")).collect()
        parts: dict[int, list] = {}
        for r in sorted(found, key=lambda r: (r["__b"], r["lo"])):
            parts.setdefault(r["__b"], []).append((r["n"], r["lo"], r["hi"]))
        for (g, k), (lo, hi, below) in list(open_.items()):
            for n, part_lo, part_hi in parts[number[g, lo, hi]]:
                if below + n > k:
                    break
                below += n
            # all in one stretch, which rounding allows: halve the bracket
            if (part_lo, part_hi) == (lo, hi):
                middle = lo / 2 + hi / 2
                middle = middle if lo <= middle < hi else lo
                low = F.col("__x") <= middle
                own = rows.filter(F.col("__g").eqNullSafe(F.lit(g)) & F.col("__x").between(lo, hi))
                n_low, top, nxt = own.agg(F.count_if(low), F.max(F.when(low, F.col("__x"))), F.min(F.when(~low, F.col("__x")))).first()
                open_[g, k] = (lo, top, below) if k < below + n_low else (nxt, hi, below + n_low)
            else:
                open_[g, k] = (part_lo, part_hi, below)


def quantiles(values: DataFrame, shares: Sequence[float], group: str = "metric", value: str = "x") -> dict[object, list[float | None]]:
    """group -> the value at each share of its rows, neighbours in proportion, as quantile_cont gives it."""
    x = F.col(value).cast("double")
    sizes = values.groupBy(group).agg(F.count_if(x == -float("inf")).alias("low"), F.count_if(F.abs(x) < float("inf")).alias("n"), F.count_if(x == float("inf")).alias("high"), F.count_if(F.isnan(x)).alias("nan")).collect()
    place, asked = {}, {}
    for r in sizes:
        total = r["low"] + r["n"] + r["high"] + r["nan"]
        for s in shares:
            at = s * (total - 1)
            place[r[group], s] = (math.floor(at), math.ceil(at), at - math.floor(at)) if total else None
        ranks = {k - r["low"] for s in shares if place[r[group], s] for k in place[r[group], s][:2]}
        asked[r[group]] = sorted(k for k in ranks if 0 <= k < r["n"])
    found = order_statistics(values, asked, group, value)

    def ranked(r, k: int) -> float:  # noqa: ANN001
        if k < r["low"]:
            return -math.inf
        k -= r["low"]
        return found[r[group], k] if k < r["n"] else math.inf if k < r["n"] + r["high"] else math.nan

    def between(r, s: float) -> float | None:  # noqa: ANN001
        if place[r[group], s] is None:
            return None
        a, b, part = place[r[group], s]
        lo, hi = ranked(r, a), ranked(r, b)
        return lo if lo == hi or part == 0 else lo + part * (hi - lo)

    return {r[group]: [between(r, s) for s in shares] for r in sizes}
