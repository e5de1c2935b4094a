"""Exact quantiles against numpy."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from feedforge.operators import describe, quantiles

SHARES = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def cases():
    rng = random.Random(3)
    return {
        "even": [rng.uniform(-5, 5) for _ in range(801)],
        "skewed": [math.exp(rng.gauss(0, 30)) for _ in range(500)],
        "ties": [1.0] * 300 + [2.0] * 300 + [float(rng.randint(0, 4)) for _ in range(99)],
        "one": [7.5],
        "two": [1.0, math.nextafter(1.0, 2)],
        "tiny": [0.0, 5e-324, 1e-300, -5e-324, 1e308, -1e308],
    }


def test_equal_numpy(spark):
    rows = [(g, x) for g, xs in cases().items() for x in xs] + [("even", None), ("none", None)]
    got = quantiles.quantiles(spark.createDataFrame(rows, "metric string, x double"), SHARES)
    assert got.pop("none") == [None] * len(SHARES)
    for g, xs in cases().items():
        assert got[g] == pytest.approx([float(np.quantile(xs, s)) for s in SHARES], rel=1e-12, abs=1e-320), g


def test_infinite_values_and_nan(spark):
    rows = [("a", x) for x in (-math.inf, 1.0, 2.0, math.inf, math.nan)]
    got = quantiles.quantiles(spark.createDataFrame(rows, "metric string, x double"), [0.0, 0.25, 0.5, 0.75, 1.0])["a"]
    assert got[:4] == [-math.inf, 1.0, 2.0, math.inf] and math.isnan(got[4])
    assert quantiles.quantiles(spark.createDataFrame([], "metric string, x double"), [0.5]) == {}


def test_describe_buffers_no_values(spark):
    df = spark.range(1, 102).selectExpr("id as a", "cast(null as int) as b")
    out = describe.describe(df, "a", "b")
    assert "percentile" not in out._jdf.queryExecution().toString()
    got = {r["metric"]: tuple(r)[1:] for r in out.collect()}
    assert got["a"][0] == 101 and got["a"][3:] == (1, 26, 51, 76, 101) and got["b"] == (0, *[None] * 7)
