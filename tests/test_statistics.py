import math
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brindle.functions import special
from brindle.operators import anomaly, causal, experiment, models, product, profiling, quality


def test_tails():
    assert abs(special.norm_sf(1.959964) - 0.025) < 1e-6
    assert abs(special.t_two_sided(2.228139, 10) - 0.05) < 1e-6
    assert abs(special.chi2_sf(3.841459, 1) - 0.05) < 1e-6 and abs(special.chi2_sf(18.307038, 10) - 0.05) < 1e-6
    assert abs(special.f_sf(4.102821, 2, 10) - 0.05) < 1e-6
    assert special.t_two_sided(0, 5) == 1.0 and special.gamma_q(1, 0) == 1.0


@pytest.fixture(scope="module")
def cohort(spark):
    d = lambda m, day: datetime(2026, m, day)
    rows = [("u1", d(1, 5)), ("u1", d(2, 10)), ("u1", d(3, 1)), ("u2", d(1, 20)), ("u2", d(2, 15)), ("u3", d(2, 3)), ("u3", d(3, 4)), ("u4", d(3, 11))]
    return spark.createDataFrame(rows, "user_id string, ts timestamp_ntz")


def test_cohort_golden(cohort):
    rows = product.cohort_retention(cohort, "user_id", "ts").orderBy("cohort", "period").collect()
    assert len(rows) == 6
    assert [(r.active, r.cohort_size, r.retention) for r in rows[:3]] == [(2, 2, 1.0), (2, 2, 1.0), (1, 2, 0.5)]
    assert product.cohort_matrix(cohort, "user_id", "ts").count() == 9


def test_funnel_order_matters(spark):
    rows = [("a", "view", 1), ("a", "buy", 2), ("b", "buy", 1), ("b", "view", 2), (None, "view", 1)]
    df = spark.createDataFrame([(u, e, datetime(2024, 1, t)) for u, e, t in rows], "u string, e string, t timestamp_ntz")
    assert [r.users for r in product.funnel(df, "u", "e", ["view", "buy"]).orderBy("step_index").collect()] == [2, 2]
    assert [r.users for r in product.funnel(df, "u", "e", ["view", "buy"], "t", True).orderBy("step_index").collect()] == [2, 1]
    assert [r.step_rate for r in product.funnel(df.limit(0), "u", "e", ["view", "buy"]).orderBy("step_index").collect()] == [1.0, 0.0]


def test_did_srm_ab(spark):
    rng = random.Random(1)
    rows = [(10 + 2 * t + p + 4 * t * p + rng.gauss(0, 0.5), t, p) for t in (0, 1) for p in (0, 1) for _ in range(50)]
    r = experiment.did(spark.createDataFrame(rows, "y double, t int, p int"), "y", F.col("t") == 1, F.col("p") == 1).first()
    assert 3 < r.did_estimate < 5 and r.p_value < 0.01
    arms = spark.createDataFrame([("A",)] * 600 + [("B",)] * 400, "arm string")
    assert experiment.srm_check(arms, "arm").first().srm_detected == 1
    ab = spark.createDataFrame([("c", int(i < 20)) for i in range(200)] + [("t", int(i < 45)) for i in range(200)], "arm string, y int")
    assert experiment.bayesian_ab(ab, "arm", "y", "c", "t").first().p_treatment_better > 0.9
    x = spark.createDataFrame([(float(i % 7) + rng.random(), float(i % 7)) for i in range(200)], "y double, x double")
    c = experiment.cuped(x, "y", "x").first()
    assert c.y_var_cuped <= c.y_var_raw
    assert 0 <= experiment.aa_simulation(x, "y", 40).first().false_positive_rate < 0.25
    b = experiment.bootstrap_ci(x, "y", rounds=100).first()
    assert b.lower < b.point_estimate < b.upper


def test_breaks_roots_and_fits(spark):
    rng = np.random.default_rng(3)
    day = lambda i: datetime(2024, 1, 1) + timedelta(days=i)
    shift = spark.createDataFrame([(day(i), float(v)) for i, v in enumerate([*rng.normal(0, 1, 80), *rng.normal(5, 1, 80)])], "ts timestamp_ntz, y double")
    assert [abs(r.break_index - 80) <= 2 for r in models.change_points(shift, "ts", "y").collect()] == [True]
    noise = spark.createDataFrame([(day(i), float(v)) for i, v in enumerate(rng.normal(0, 1, 300))], "ts timestamp_ntz, y double")
    r = models.adf_kpss(noise, "ts", "y").first()
    assert r.adf_stationary and r.kpss_stationary
    walk = spark.createDataFrame([(day(i), float(v)) for i, v in enumerate(rng.normal(0, 1, 300).cumsum())], "ts timestamp_ntz, y double")
    assert not models.adf_kpss(walk, "ts", "y").first().kpss_stationary
    assert models.fit_distributions(noise, "y").first().distribution == "normal"
    season = spark.createDataFrame([(day(i), float(10 + i * 0.1 + 3 * math.sin(i * math.pi / 6))) for i in range(120)], "ts timestamp_ntz, y double")
    s = models.stl(season, "ts", "y", 12).toPandas()
    assert np.allclose(s.trend + s.seasonal + s.residual, s.y) and s.residual.abs().mean() < 0.5
    assert models.arima(season, "ts", "y", (2, 1, 0), 30).count() == 30 and models.ets(season, "ts", "y", horizon=4).count() == 4
    assert models.forecast_anomalies(season, "ts", "y", 25).count() == 25
    lagged = spark.createDataFrame([(day(i), float(x), float(y)) for i, (x, y) in enumerate(zip(rng.normal(0, 1, 200), np.roll(rng.normal(0, 1, 200), 1)))], "ts timestamp_ntz, x double, y double")
    lagged = lagged.withColumn("y2", F.col("y"))
    assert 0 <= models.granger(lagged, "ts", "x", "y", 2).first().p_value <= 1
    driven = [(day(i), float(v)) for i, v in enumerate(rng.normal(0, 1, 200))]
    rows = [(t, v, (driven[i - 1][1] if i else 0.0) + float(rng.normal(0, 0.1))) for i, (t, v) in enumerate(driven)]
    assert models.granger(spark.createDataFrame(rows, "ts timestamp_ntz, x double, y double"), "ts", "x", "y", 2).first().p_value < 1e-6
    assert models.monte_carlo(noise.withColumn("y", F.col("y") / 100), "y", 500, 10).first().p05 < 1.1


def test_long_series_are_bounded(spark):
    long = spark.range(5000).select(F.expr("timestamp_seconds(id * 60)").alias("ts"), F.col("id").cast("double").alias("y"))
    got = models.regular(long, "ts", "y", points=100).orderBy("i").collect()
    assert 95 <= len(got) <= 101 and all(a.y < b.y for a, b in zip(got, got[1:]))


def test_risk_survival_errors(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(rng.gauss(0, 1), rng.gauss(0, 2)) for _ in range(200)], "a double, b double")
    assert abs(sum(r.contribution_to_variance for r in quality.risk_attribution(df, {"a": 0.6, "b": 0.4}).collect()) - 1) < 1e-9
    life = spark.createDataFrame([(rng.expovariate(0.1), int(rng.random() < 0.7), "x" if i % 2 else "y") for i in range(200)], "d double, e int, g string")
    s = [r.survival for r in quality.kaplan_meier(life, "d", "e").orderBy("t").collect()]
    assert all(a >= b for a, b in zip(s, s[1:])) and 0 <= s[-1] < 1
    assert 0 <= quality.log_rank(life, "d", "e", "g").first().p_value <= 1
    a, b = df.select(F.col("a").alias("v")), df.select((F.col("a") + 3).alias("v"))
    assert quality.ks_test(a, b, "v").first().p_value < 0.01 and abs(quality.wasserstein(a, b, "v").first().distance - 3) < 1e-6
    assert quality.ks_test(a, a, "v").first().statistic == 0 and quality.jensen_shannon(a, b, "v").first().divergence > 0.2
    assert quality.psi(a, a, "v").first().psi < 1e-9
    c = spark.createDataFrame([(float(i % 5),) for i in range(100)], "v double").withColumn("s", F.floor(F.monotonically_increasing_id() / 5))
    assert quality.x_bar_r_chart(c, "v", "s").count() >= 1 and quality.cp_cpk(c, "v", -10, 10).first().cpk > 0


def test_anomalies_on_constants_and_nulls(spark):
    df = spark.createDataFrame([("a", 1.0)] * 5 + [("b", None)], "g string, v double")
    for m in ("zscore", "iqr", "mad"):
        assert {r.anomaly_type for r in anomaly.detect_anomalies(df, "v", ["g"], m).collect()} == {"none"}
    outlier = spark.createDataFrame([(float(i % 10),) for i in range(90)] + [(9999.0,)], "v double")
    for m in ("zscore", "iqr", "mad"):
        got = [r.v for r in anomaly.detect_anomalies(outlier, "v", (), m, 3.5).where("is_anomaly").collect()]
        assert got == [9999.0], m


def test_profile_edges(spark):
    df = spark.createDataFrame([(1, 1.0, None, [1]), (2, float("nan"), None, None), (3, float("inf"), None, [2])], "id int, x double, n string, l array<int>")
    p = {r.column_name: r for r in profiling.profile_table(df).collect()}
    assert (p["x"].null_rate, p["x"].n_distinct, p["x"].std_value) == (pytest.approx(2 / 3), 1, 0.0)
    assert p["n"].null_rate == 1.0 and p["n"].n_distinct == 0 and p["l"].n_distinct == 2
    empty = {r.column_name: r for r in profiling.profile_table(df.limit(0)).collect()}
    assert all(r.null_rate == 1.0 and r.n_rows == 0 for r in empty.values())
    assert "| id |" in profiling.render_markdown(profiling.profile_table(df), "t")
    pair = spark.createDataFrame([(float(i), float(2 * i)) for i in range(1, 6)], "x double, y double")
    r = profiling.pairwise_pearson(pair, ["x", "y"]).first()
    assert r.correlation == pytest.approx(1.0) and r.p_value < 1e-12
    assert causal.dependence(pair, "x", "y").first().n == 5


def test_models_use_all_rows_of_long_series(spark, monkeypatch):
    """Rows of a group beyond 20,000 are neither averaged nor left out; large groups are cut into blocks with equal results."""
    from brindle.operators import frames

    rng = np.random.default_rng(11)
    n = 21_000
    y = rng.normal(0, 1, n)
    for i in range(1, n):
        y[i] += 0.6 * y[i - 1]
    y[10_000:] += 8
    pdf = pd.DataFrame({"g": "a", "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), unit="min"), "y": y})
    df = spark.createDataFrame(pdf)
    e = y - y.mean()
    for block in (frames.BLOCK_ROWS, 6_000):
        monkeypatch.setattr(frames, "BLOCK_ROWS", block)
        acf = [r.acf for r in models.acf_pacf(df, "ts", "y", 3, ["g"]).orderBy("lag").collect()]
        assert np.allclose(acf, [1.0] + [e[k:] @ e[:-k] / (e @ e) for k in (1, 2, 3)])
        z = np.diff(y)
        b = np.linalg.lstsq(np.column_stack([np.ones(len(z) - 1), z[:-1]]), z[1:], rcond=None)[0]
        first = models.arima(df, "ts", "y", (1, 1, 0), 2, ["g"]).orderBy("step").first()
        assert abs(first.yhat - (y[-1] + b[0] + b[1] * z[-1])) < 1e-9
    last = models.forecast_anomalies(df, "ts", "y", 30, ["g"]).orderBy("i").collect()
    line = np.polyfit(np.arange(n - 30), y[:-30], 1)
    assert [r.i for r in last] == list(range(n - 30, n)) and np.allclose([r.y for r in last], y[-30:])
    assert np.allclose([r.yhat for r in last], np.polyval(line, np.arange(n - 30, n)))
    assert models.adf_kpss(df, "ts", "y", ["g"]).first().n == n
    assert models.stl(df, "ts", "y", 24, ["g"]).count() == n
    assert any(abs(r.break_index - 10_000) <= 3 for r in models.change_points(df, "ts", "y", ["g"]).collect())
