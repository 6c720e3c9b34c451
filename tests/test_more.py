import json
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import causal, experiment, features, isolation, metadata, sampling, text, timeseries, vector
from brindle.plans import facade, kinds
from brindle.sources import catalog as sources


def test_samples_are_exact_and_free_of_partitions(spark):
    df = spark.range(2000).selectExpr("id AS k", "id % 3 AS seed")
    one = {r.k for r in sampling.sample_rows(df.repartition(1), F.col("k"), 100, 4).collect()}
    assert len(one) == 100 and one == {r.k for r in sampling.sample_rows(df.repartition(9), F.col("k"), 100, 4).collect()}
    assert one != {r.k for r in sampling.sample_rows(df, F.col("k"), 100, 5).collect()}
    assert sampling.sample_rows(df, F.col("k"), 5000).count() == 2000
    nulls = spark.createDataFrame([(None,), (1,)], "k int")
    assert sampling.sample_rows(nulls, F.col("k"), 5).count() == 1 and sampling.sample_rows(nulls.limit(0), F.col("k"), 5).count() == 0
    n = sampling.sample_share(df, F.col("k"), 0.2).count()
    assert 300 < n < 500 and sampling.sample_share(df, F.col("k"), 1.0).count() == 2000 and sampling.sample_share(df, F.col("k"), 0.0).count() == 0
    with pytest.raises(ValueError):
        sampling.sample_share(df, F.col("k"), 1.5)


def test_isolation_forest_sets_outliers_apart(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(800, 2)))] + [(1000 + i, 9.0 + i, -9.0) for i in range(5)] + [(2000, None, 1.0), (2001, float("nan"), 1.0)]
    got = {r.k: (r.iforest_score, r.is_anomaly) for r in isolation.iforest_score(spark.createDataFrame(rows, "k int, a double, b double"), ["a", "b"], "k").collect()}
    assert min(got[1000 + i][0] for i in range(5)) > np.quantile([got[i][0] for i in range(800)], 0.98)
    assert all(got[1000 + i][1] for i in range(5)) and got[2000] == (None, False) and got[2001] == (None, False)
    empty = spark.createDataFrame([], "k int, a double, b double")
    assert isolation.iforest_score(empty, ["a", "b"], "k").count() == 0
    same = spark.createDataFrame([(i, 1.0) for i in range(9)], "k int, a double")
    assert {round(r.iforest_score, 6) for r in isolation.iforest_score(same, ["a"], "k").collect()} == {0.5}


def test_detrend(spark):
    t = datetime(2024, 1, 1)
    rows = [("a", t + timedelta(hours=i), 2.0 * i + 5) for i in range(30)] + [("b", t, 7.0), (None, t, 1.0), ("a", None, 9.0), ("a", t, None)]
    got = timeseries.detrend(spark.createDataFrame(rows, "g string, t timestamp_ntz, v double"), "t", "v", ["g"]).collect()
    assert len(got) == 32 and all(abs(r.detrended) < 1e-9 for r in got) and all(abs(r.trend - r.v) < 1e-9 for r in got)


def test_bca_against_known_skew(spark):
    rng = np.random.default_rng(5)
    v = rng.exponential(size=400)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    p, b = (experiment.bootstrap_ci(df, "v", rounds=1000, method=m).first() for m in ("percentile", "bca"))
    assert b.lower > p.lower and b.upper > p.upper and b.lower < v.mean() < b.upper
    flat = experiment.bootstrap_ci(spark.createDataFrame([(2.0,)] * 9, "v double"), "v", rounds=50, method="bca").first()
    assert (flat.lower, flat.upper) == (2.0, 2.0)


def test_globs_and_labels(spark):
    df = spark.createDataFrame([("core.users",), ("core.users_tmp",), ("stage.x",), ("a]b",), (None,)], "n string")
    got = lambda *a: {r.n for r in metadata.glob_filter(df, "n", *a).collect()}
    assert got(["core.*"], ["*_tmp"]) == {"core.users"} and got(None, ["core.*"]) == {"stage.x", "a]b"} and got([], None) == set()
    assert got(["[!c]*"]) == {"stage.x", "a]b"} and got(["?????.?"]) == {"stage.x"} and got(["core.*"], ["core.*"]) == set()
    names = spark.createDataFrame([("customer_orderID",), ("__x9-Yz ",), ("",)], "n string")
    assert [r[0] for r in names.select(metadata.humanise(F.col("n"))).collect()] == ["Customer order id", "X9 yz", ""]


def test_model_envelopes(spark):
    t = spark.createDataFrame([(1, "x")], "userId int, b string")
    (row,) = metadata.model_envelopes(sources.introspect(t, "users"), "lms").collect()
    body = json.loads(row.envelope)
    assert row.rk == "lms.users" and [c["rk"] for c in body["columns"]] == ["lms.users.userId", "lms.users.b"] and body["columns"][0]["label"] == "User id"


def test_audit_of_upserts(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (None, "n", 1)], "k int, s string, n int")
    new = spark.createDataFrame([(1, None, 7), (2, "b", 6), (3, "c", None), (None, "m", 1)], "k int, s string, n int")
    got = {r.k: (r.action, r.changed, r.before and json.loads(r.before)) for r in metadata.upsert_audit(old, new, ["k"]).collect()}
    assert got == {1: ("update", ["n"], {"s": "a", "n": 5}), 3: ("insert", ["s"], None), None: ("update", ["s"], {"s": "n", "n": 1})}


def test_event_envelopes_sort_by_time(spark):
    t = datetime(2024, 5, 1)
    df = spark.createDataFrame([(i, t + timedelta(seconds=i * 977)) for i in range(50)], "i int, t timestamp_ntz")
    got = metadata.event_envelope(df, F.lit("k"), F.col("i"), "t", ["i"]).orderBy("event_id").collect()
    assert [int(r.subject) for r in got] == list(range(50)) and len({r.event_id for r in got}) == 50


def test_vector_upsert_embedding_and_search_chain(spark):
    base = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id int, v array<float>")
    new = vector.embedded(spark.createDataFrame([(2, "ab"), (3, "abc"), (4, None)], "id int, t string"), "t", lambda ts: [[len(x), 1.0] for x in ts], 2, "v")
    got = {r.id: r.v for r in vector.upsert_points(base, new, "id").collect()}
    assert got == {1: [1.0, 0.0], 2: [2.0, 1.0], 3: [3.0, 1.0], 4: None}
    with pytest.raises(Exception, match="not 3"):
        vector.embedded(new.select("id", F.lit("x").alias("t")), "t", lambda ts: [[1.0]] * len(ts), 3).collect()
    assets = spark.createDataFrame([("1", "Orders", "s"), ("9", "Order lines", "s")], "rk string, name string, schema_name string")
    assert [(r.rk, r.how) for r in vector.asset_vector_search(base, assets, "id", "v", [1.0, 0.1], "order", 3).collect()] == [("1", "vector")]
    assert [(r.rk, r.how) for r in vector.asset_vector_search(base.where("id = 2"), assets, "id", "v", [1.0, 0.1], "order", 3).collect()] == [("1", "keyword"), ("9", "keyword")]


def test_states_merge_to_the_whole_profile(spark):
    rows = [(i, None if i % 7 == 0 else i % 5 / 2, "x" if i % 2 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "i int, v double, s string")
    whole = features.profile_of_state(features.profile_state(df, ["v", "s"]))
    parts = features.profile_state(df.where("i < 30"), ["v", "s"]).unionByName(features.profile_state(df.where("i >= 30"), ["v", "s"]))
    key = lambda d: sorted((r.column_name, r.n_rows, r.null_rate, r.mean_value and round(r.mean_value, 9), r.std_value and round(r.std_value, 9), r.approx_distinct) for r in d.collect())
    assert key(features.profile_of_state(features.merge_states(parts))) == key(whole)
    v = [b for _, b, _ in rows if b is not None]
    got = {r.column_name: r for r in whole.collect()}
    assert got["v"].std_value == pytest.approx(np.std(v, ddof=1)) and got["s"].mean_value is None and got["s"].std_value is None and got["v"].approx_distinct == 5


def test_pc_finds_colliders_and_leaves_chains_open(spark):
    rng = np.random.default_rng(8)
    a, b, n = rng.normal(size=3000), rng.normal(size=3000), rng.normal(size=(3, 3000))
    c = a + b + 0.5 * n[0]
    d = c + 0.5 * n[1]
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, c, d, n[2])], "a double, b double, c double, d double, e double")
    got = {tuple(r) for r in causal.pc_structure(df, ["a", "b", "c", "d", "e"], 0.001).collect()}
    assert got == {("a", "c", "directed"), ("b", "c", "directed"), ("c", "d", "directed")}
    chain = {tuple(r) for r in causal.pc_structure(df, ["d", "a", "c"], 0.001).collect()}
    assert chain == {("a", "c", "undirected"), ("c", "d", "undirected")}
    assert causal.pc_structure(df.limit(0), ["a", "b"]).count() == 0


def test_lagged_links_and_refuter(spark):
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=1500), np.zeros(1500)
    for t in range(1, 1500):
        y[t] = 0.8 * x[t - 1] + 0.3 * y[t - 1] + 0.3 * rng.normal()
    df = spark.createDataFrame([(t, float(x[t]), float(y[t])) for t in range(1500)], "t int, x double, y double")
    got = {(r.source, r.lag, r.target) for r in causal.lagged_links(df, "t", ["x", "y"], 2, 0.0001).collect()}
    assert got == {("x", 1, "y"), ("y", 1, "y")}
    z = rng.normal(size=2000)
    t = z + rng.normal(size=2000)
    o = 3 * t + z + rng.normal(size=2000)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(zip(z, t, o))], "k int, z double, t double, o double")
    got = {r.test: r for r in causal.refute(df, "t", "o", ["z"], "k").collect()}
    assert all(r.holds for r in got.values()) and got["placebo_treatment"].estimate == pytest.approx(3, abs=0.1)
    none = {r.test: r.holds for r in causal.refute(df.limit(0), "t", "o", ["z"], "k").collect()}
    assert none == {"random_common_cause": None, "placebo_treatment": None}


TEXT = "It failed because of rain, LEADS TO wind, driven by frost."


def test_marker_places(spark):
    df = spark.createDataFrame([(1, TEXT), (2, None), (3, "")], "id int, t string")
    got = [(r.start, r.end, r.marker) for r in text.causal_marker_spans(df, "id", "t").orderBy("start").collect()]
    assert all(TEXT[a:b].lower() == m for a, b, m in got) and "leads to" in {m for _, _, m in got}
    counts = {r.marker: r.n for r in text.causal_markers(df, "id", "t").collect()}
    assert {m: sum(x == m for _, _, x in got) for _, _, m in got} == counts


def test_table_functions_by_json(spark):
    spark.createDataFrame([(i % 2, float(i)) for i in range(20)], "arm int, v double").createOrReplaceTempView("arms")
    got = json.loads(facade.invoke_json(spark, "calculate_effect_sizes", json.dumps({"p_table": "arms", "is_treated": "arm = 1", "value": "v"})))
    assert got[0]["n_treatment"] == 10 and got[0]["interpretation"] == "small"
    rows = [{"p_value": 0.01}, {"p_value": 0.5}]
    got = json.loads(facade.invoke_json(spark, "adjust_pvalues_bonferroni", json.dumps({"p_rows": rows})))
    assert sorted(r["p_adjusted"] for r in got) == [0.02, 1.0]
    assert json.loads(facade.invoke_json(spark, "nothing", "{}"))["error"] == "unknown_function"
    assert "error" in json.loads(facade.invoke_json(spark, "ml_funnel", json.dumps({"p_table": "no_such_view"})))
    for name in facade.names():
        out = facade.invoke_json(spark, name, "{}")
        assert "unknown_function" not in out, name


def test_kinds_check_inputs_and_keep_results(spark):
    now = [0.0]
    k = kinds.Kinds(ttl_s=10, size=2, clock=lambda: now[0])
    k.add(kinds.Kind("upto", lambda n: spark.range(n), {"n": (int, True)}, most=5))
    assert k.names() == ["upto"] and k.ask("upto", n=2) == [{"id": 0}, {"id": 1}] and k.ask("upto", n=2) and (k.hits, k.misses) == (1, 1)
    now[0] = 11
    k.ask("upto", n=2)
    assert k.misses == 2
    for bad in ({}, {"n": "2"}, {"n": True}, {"n": 1, "m": 2}, {"n": 6}):
        with pytest.raises(ValueError):
            k.ask("upto", **bad)
    with pytest.raises(KeyError):
        k.ask("other")


def test_results_are_listed_and_deleted(spark, tmp_path):
    store = sources.ResultStore(spark, f"file://{tmp_path}")
    store.finalize("t", "j1", spark.range(3), {"more": spark.range(2)})
    assert store.jobs("t") == ["j1"] and store.jobs("other") == [] and store.manifest("t", "j1")["job"] == "j1"
    assert store.delete("t", "j1") and not store.delete("t", "j1") and store.jobs("t") == []
    for bad in ("..", "a/b"):
        with pytest.raises(sources.SourceError):
            store.delete("t", bad)


def test_time_parts_and_trailing(spark):
    t = datetime(2024, 2, 29, 23)
    df = spark.createDataFrame([(1, t, 1.0), (1, t, 2.0), (1, t + timedelta(seconds=50), 4.0), (1, t + timedelta(seconds=200), None), (2, t, 8.0)], "e int, t timestamp_ntz, v double")
    p = features.time_parts(df, "t").first()
    assert (p.ts_hour, p.ts_weekday, p.ts_day_of_year, p.ts_quarter, p.ts_is_weekend, p.ts_is_month_end) == (23, 4, 60, 1, False, True)
    got = sorted((r.e, str(r.v), r.last_count, r.last_sum, r.last_mean) for r in features.trailing(df, ["e"], "t", "v", 60).collect())
    assert got == [(1, "1.0", 0, 0.0, None), (1, "2.0", 0, 0.0, None), (1, "4.0", 2, 3.0, 1.5), (1, "None", 0, 0.0, None), (2, "8.0", 0, 0.0, None)]
    hot = features.one_hot(spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "c string"), "c", most=1)
    assert hot.columns == ["c", "c=a"] and sorted(r["c=a"] for r in hot.collect()) == [0, 0, 1, 1]


def test_correlation_ratio(spark):
    rng = random.Random(1)
    rows = [(g, g * 3.0 + rng.random()) for g in range(3) for _ in range(50)]
    df = spark.createDataFrame(rows, "g int, v double")
    assert features.correlation_ratio(df, "g", "v").first().eta > 0.98 and features.correlation_ratio(df.limit(0), "g", "v").first().eta is None
    assert features.histogram(df, "v", 4).agg(F.sum("n")).first()[0] == 150 and features.histogram(df.where("v < 0"), "v").count() == 0
    assert [tuple(r) for r in features.histogram(df.limit(1).withColumn("v", F.lit(5.0)), "v", 4).collect()] == [(0, 5.0, 5.0, 1)]
