"""Blocked windows give the same rows as plain ones."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from brindle.operators import frames, quality, timeseries as ts, windows as w

KEYS = dict(ts="ts", value="value", group=["g"], tie=["id"])


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        g = "a" if rng.random() < 0.7 else rng.choice(["b", "c", None])
        t = None if i == 5 else datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(300))
        rows.append((i, g, t, None if i % 41 == 0 else round(rng.uniform(0.5, 1.5), 3), 0, 0))
    return spark.createDataFrame(rows, "id int, g string, ts timestamp_ntz, value double, rn int, sma int").drop("rn", "sma").coalesce(3)


CALLS = {
    "sma": lambda d: w.sma(d, **KEYS, w=5), "wma": lambda d: w.wma(d, **KEYS, w=5), "rank": lambda d: w.moving_rank(d, **KEYS, w=5), "quantiles": lambda d: w.moving_quantiles(d, **KEYS, w=5), "ema": lambda d: w.ema(d, **KEYS), "flat": lambda d: w.time_weighted_ma(d, "ts", "value", tie=["id"], w=6),
    "mean": lambda d: w.expanding(d, **KEYS), "std": lambda d: w.expanding(d, **KEYS, op="std"), "cumulative": lambda d: w.cumulative_all(d, **KEYS), "lag": lambda d: ts.lag(d, **KEYS, k=3), "lead": lambda d: ts.lead(d, **KEYS, k=2), "cdf": lambda d: ts.cdf(d, "value", ["g"]),
    "trend": lambda d: ts.statistical_trend(d, **KEYS), "acf": lambda d: ts.autocorrelation(d, **KEYS, max_lag=3), "seasons": lambda d: quality.seasonal_residuals(d, "ts", "value", 4, ["g"], ["id"]),
}


def _rows(df):
    digits = [F.round(c, 7).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    return sorted(map(str, df.select(sorted(df.columns)).select(*[c for _, c in sorted(zip(df.columns, digits), key=lambda x: x[0])]).collect()))


@pytest.mark.parametrize("name", CALLS)
def test_blocks_change_nothing(series, monkeypatch, name):
    plain = _rows(CALLS[name](series))
    monkeypatch.setattr(frames, "BLOCK_ROWS", 13)
    assert _rows(CALLS[name](series)) == plain and plain


@pytest.mark.parametrize("name", CALLS)
def test_empty(series, name):
    assert CALLS[name](series.limit(0)).count() == 0


def test_numbers(series):
    n = frames.number_rows(series, ["g"], ["ts", "id"]).select("g", "rn").collect()
    by = {}
    for r in n:
        by.setdefault(r.g, []).append(r.rn)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in by.values()) and len(n) == 400


def test_hand_computed(spark):
    rows = [(1, datetime(2024, 1, d), float(v)) for d, v in ((1, 10), (2, 20), (3, 15))] + [(2, datetime(2024, 1, d), float(v)) for d, v in ((1, 100), (2, 110), (3, 105))]
    df = spark.createDataFrame(rows, "g int, ts timestamp_ntz, value double")
    got = [r.sma for r in w.sma(df, "ts", "value", ["g"], w=2).where("g = 1").orderBy("ts").collect()]
    assert got == [10.0, 15.0, 17.5]
    lists = spark.createDataFrame([([1.0, 2.0, 3.0],), ([10.0, 11.0],), ([],), (None,)], "v array<double>")
    assert [r[0] for r in lists.select(w.ema_list(F.col("v"), 0.5)).collect()] == [[1.0, 1.5, 2.25], [10.0, 10.5], [], None]
    with pytest.raises(ValueError):
        w.sma(df, "ts", "value", w=0)


def test_constants_and_single_rows(spark):
    df = spark.createDataFrame([("a", datetime(2024, 1, d), 5.0) for d in range(1, 6)] + [("b", datetime(2024, 1, 1), 0.0)], "g string, ts timestamp_ntz, value double")
    k = dict(ts="ts", value="value", group=["g"])
    one = {r.g: r for r in w.moving_correlation(df.withColumn("y", F.col("value")), "ts", "value", "y", ["g"]).collect()}
    assert one["a"].correlation is None
    assert w.moving_variance(df, **k).where("g = 'b'").first().std_dev is None and w.sma(df, **k).where("g = 'b'").first().upper_band == 0.0
    t = {r.g: r for r in ts.statistical_trend(df, **k).collect()}
    assert (t["a"].slope, t["a"].r_squared, t["a"].direction, t["b"].intercept) == (0.0, 0.0, "stable", 0.0)
    assert [r.change_pct for r in ts.lag(df, **k).where("g = 'b'").collect()] == [None]
