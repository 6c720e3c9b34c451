"""Operators whose work is cut along values or keys give the same rows cut and uncut."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import experiment, frames, skew
from brindle.streaming import windows


@pytest.fixture()
def values(spark):
    rows = [(g, float((i * 7919) % 97) / 4) for g, n in (("a", 60), ("b", 7), (None, 3), ("c", 1)) for i in range(n)] + [("a", None), ("d", None)]
    return rows, spark.createDataFrame(rows, "g string, v double")


@pytest.mark.parametrize("block", [None, 4])
def test_quantiles_against_numpy(values, block):
    rows, df = values
    got = {r.g: (r.q, r.m) for r in frames.quantiles(df, F.col("v"), ["g"], {"q": 0.25, "m": 0.5}, block).collect()}
    for g in {g for g, _ in rows}:
        v = [x for h, x in rows if h == g and x is not None]
        assert got[g] == (None, None) if not v else np.allclose(got[g], np.quantile(v, [0.25, 0.5]))
    assert frames.quantiles(df.limit(0), F.col("v"), ["g"], {"q": 0.5}).count() == 0
    assert frames.quantiles(df.limit(0), F.col("v"), [], {"q": 0.5}).first().q is None


@pytest.mark.parametrize("block", [None, 3])
def test_last_value_carried_on(spark, block):
    rows = [(k, i, None if i % 5 else i * 10 + k) for k in range(3) for i in range(1, 14)]
    df = spark.createDataFrame(rows, "k int, i int, v int")
    got = {(r.k, r.i): r["last"] for r in frames.cumulative(df, ["k"], ["i"], {"last": ("last", F.col("v"))}, block).collect()}
    assert got == {(k, i): (i // 5 * 50 + k if i >= 5 else None) for k, i, _ in rows}


def test_asof_join_in_blocks(spark, monkeypatch):
    left = spark.createDataFrame([(k, t) for k in range(2) for t in range(0, 40, 3)], "k int, t int")
    right = spark.createDataFrame([(0, t, t) for t in range(1, 40, 4)] + [(0, 5, 999)], "k int, u int, v int")
    run = lambda: sorted(map(tuple, windows.asof_join(left, right, ["k"], "t", "u", "v").select("k", "t", "v").collect()), key=str)
    whole = run()
    assert (0, 6, 999) in whole and (0, 9, 9) in whole and (0, 0, None) in whole and all(v is None for k, _, v in whole if k == 1)
    monkeypatch.setattr(frames, "BLOCK_ROWS", 5)
    assert run() == whole


def test_fdr_in_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.001, 0.01, 0.01, 0.2, 0.04, None, 0.9, 0.03])], "i int, p double")
    whole = sorted(map(tuple, experiment.fdr_bh(df, "p").collect()))
    monkeypatch.setattr(frames, "BLOCK_ROWS", 2)
    assert sorted(map(tuple, experiment.fdr_bh(df, "p").collect())) == whole
    assert {i: q for i, _, q, _ in whole}[0] == pytest.approx(0.007)


def test_bootstrap_does_not_depend_on_partitions(spark):
    df = spark.range(3000).selectExpr("id % 2 AS g", "cast(id % 40 AS double) AS v")
    one, many = (sorted(map(tuple, experiment.bootstrap_ci(d, "v", ["g"], rounds=200).collect())) for d in (df.repartition(1), df.repartition(7, "v")))
    assert np.allclose(one, many)
    for _, n, point, low, high in [tuple(r) for r in experiment.bootstrap_ci(df, "v", ["g"], rounds=500).select("g", "n", "point_estimate", "lower", "upper").collect()]:
        half = 1.96 * np.sqrt(133.0 / n)
        assert abs(low - (point - half)) < 0.15 and abs(high - (point + half)) < 0.15


@pytest.mark.parametrize("kind", ["inner", "left", "left_semi", "left_anti"])
def test_keys_heavy_on_either_side(spark, kind):
    left = spark.range(400).selectExpr("if(id < 200, 1, id % 50) AS k", "id AS a").unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS k, -1L AS a"))
    right = spark.range(500).selectExpr("if(id < 300, 7, id % 60) AS k", "id AS b")
    got = skew.fragment_replicate_join(left, right, "k", kind=kind)
    want = left.join(right, "k", kind)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    with pytest.raises(ValueError):
        skew.fragment_replicate_join(left, right, "k", kind="right")
