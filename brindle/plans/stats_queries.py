"""Queries of experiments, funnels, quality, risk and forecasting operators over orders, events, customers and line items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from brindle.functions.expr import rounded, rounded_sql
from brindle.operators import causal, experiment, models, product, quality, timeseries
from brindle.plans import facade, runtime
from brindle.plans.registry import Registry
from brindle.session import table

REG = Registry()


def q(name: str, fn: Callable[[SparkSession, str], DataFrame], sql: str | None = None, doubles: str = "", digits: int = 4) -> None:
    text = None if sql is None else rounded_sql(sql, doubles.split(), digits)
    REG.add(name, text)(lambda s, d: rounded(fn(s, d), digits))


def as_is(name: str, fn: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    """An operator that rounds by itself."""
    REG.add(name, sql)(fn)


def _events(s, d):
    return table(s, d, "events").select("event_id", "ts", "user_id", "event_type", "value")


def _orders(s, d):
    return table(s, d, "orders")


MID = "(SELECT min(o_orderdate) + (max(o_orderdate) - min(o_orderdate)) / 2 FROM orders)"


def _halved(s, d):
    """Orders with ``post``: whether the order lies in the later half of the table's time."""
    o = _orders(s, d)
    ends = o.agg(F.min("o_orderdate").alias("_a"), F.max("o_orderdate").alias("_b"))
    return o.join(F.broadcast(ends)).withColumn("post", F.col("o_orderdate") >= F.expr("_a + (_b - _a) / 2")).drop("_a", "_b")


# --- experiments

q("e01_change_comparison", lambda s, d: experiment.change_comparison(_orders(s, d).withColumn("arm", (F.col("o_custkey") % 3).cast("string")), "arm", "o_orderpriority", "o_totalprice", "0"), """
WITH m AS (SELECT CAST(o_custkey % 3 AS VARCHAR) AS condition, o_orderpriority AS metric, avg(o_totalprice) AS mean_value, var_samp(o_totalprice) AS v, count(*) AS n FROM orders GROUP BY ALL)
SELECT m.condition, m.metric, m.n, m.mean_value, b.mean_value AS baseline_mean, m.mean_value - b.mean_value AS absolute_change, (m.mean_value - b.mean_value) / b.mean_value * 100 AS percent_change,
 sqrt(m.v / m.n + b.v / b.n) AS std_error, (m.mean_value - b.mean_value) / sqrt(m.v / m.n + b.v / b.n) AS z FROM m JOIN m b ON b.metric = m.metric AND b.condition = '0' WHERE m.condition <> '0'""", "mean_value baseline_mean absolute_change percent_change std_error z")  # fmt: skip
q("e03_prepost", lambda s, d: experiment.prepost(_halved(s, d), "o_custkey", F.col("post"), "o_totalprice").drop("p_value"), f"""
SELECT count(*) AS n, avg(pre) AS mean_pre, avg(post) AS mean_post, avg(post - pre) AS mean_change, avg(post - pre) / (stddev_samp(post - pre) / sqrt(count(*))) AS t, count(*) - 1 AS df FROM (
SELECT o_custkey, avg(o_totalprice) FILTER (o_orderdate < m.m) AS pre, avg(o_totalprice) FILTER (o_orderdate >= m.m) AS post FROM orders, (SELECT {MID} AS m) AS m GROUP BY o_custkey) WHERE pre IS NOT NULL AND post IS NOT NULL""", "mean_pre mean_post mean_change t")  # fmt: skip
q("e04_stratified", lambda s, d: experiment.stratified(_orders(s, d), "o_orderpriority", F.col("o_custkey") % 2 == 1, "o_totalprice"), """
SELECT count(*) AS n_strata, sum(w * (mt - mc)) / sum(w) AS effect FROM (SELECT mt, mc, nt * nc / (nt + nc) AS w FROM (SELECT o_orderpriority, count(*) FILTER (o_custkey % 2 = 1) AS nt, count(*) FILTER (o_custkey % 2 <> 1) AS nc,
 avg(o_totalprice) FILTER (o_custkey % 2 = 1) AS mt, avg(o_totalprice) FILTER (o_custkey % 2 <> 1) AS mc FROM orders GROUP BY 1))""", "effect")  # fmt: skip
q("e05_sequential", lambda s, d: experiment.sequential(_orders(s, d), F.date_trunc("quarter", "o_orderdate"), F.col("o_custkey") % 2 == 1, "o_totalprice"), """
WITH p AS (SELECT date_trunc('quarter', o_orderdate) AS period, o_custkey % 2 = 1 AS t, o_totalprice AS v FROM orders), k AS (SELECT DISTINCT period FROM p),
r AS (SELECT k.period, count(*) AS n, avg(v) FILTER (t) - avg(v) FILTER (NOT t) AS d, sqrt(var_samp(v) FILTER (t) / count(*) FILTER (t) + var_samp(v) FILTER (NOT t) / count(*) FILTER (NOT t)) AS se FROM k JOIN p ON p.period <= k.period GROUP BY k.period)
SELECT CAST(period AS TIMESTAMP) AS period, n, n / (SELECT count(*) FROM orders) AS information, d / se AS z, 1.96 / sqrt(n / (SELECT count(*) FROM orders)) AS boundary, coalesce(abs(d / se) > 1.96 / sqrt(n / (SELECT count(*) FROM orders)), false) AS stop FROM r""", "information z boundary", 3)  # fmt: skip
q("e06_cuped", lambda s, d: experiment.cuped(_orders(s, d), "o_totalprice", "o_custkey", ["o_orderpriority"]).select("o_orderpriority", "n", (F.col("theta") * 1000).alias("theta_k"), "mean_value", (F.col("y_var_cuped") / F.col("y_var_raw")).alias("kept")), """
SELECT o_orderpriority, count(*) AS n, covar_samp(o_totalprice, o_custkey) / var_samp(o_custkey) * 1000 AS theta_k, avg(o_totalprice) AS mean_value, 1 - pow(corr(o_totalprice, o_custkey), 2) AS kept FROM orders GROUP BY 1""", "theta_k mean_value kept")  # fmt: skip
q("e06_cuped_rows", lambda s, d: experiment.cuped_adjusted(_orders(s, d).select("o_orderkey", "o_custkey", "o_totalprice"), "o_totalprice", "o_custkey"), """
SELECT o_orderkey, o_custkey, o_totalprice, o_totalprice - t * (o_custkey - m) AS adjusted FROM orders, (SELECT covar_samp(o_totalprice, o_custkey) / var_samp(o_custkey) AS t, avg(o_custkey) AS m FROM orders)""", "o_totalprice adjusted", 3)  # fmt: skip
q("e07_bootstrap_ci", lambda s, d: experiment.bootstrap_ci(_events(s, d), "value", ["event_type"], rounds=200))
q("e08_power", lambda s, d: _orders(s, d).groupBy("o_orderpriority").agg(F.stddev_samp("o_totalprice").alias("sd")).withColumn("n_per_arm", experiment.power_analysis(F.lit(1000.0), F.col("sd"))), """
SELECT o_orderpriority, stddev_samp(o_totalprice) AS sd, CAST(ceil(2 * pow(stddev_samp(o_totalprice) * (1.96 + 0.84) / 1000.0, 2)) AS BIGINT) AS n_per_arm FROM orders GROUP BY 1""", "sd")  # fmt: skip
q("e09_effect_sizes", lambda s, d: experiment.effect_sizes(_orders(s, d), F.col("o_custkey") % 2 == 1, "o_totalprice", ["o_orderstatus"]), """
SELECT o_orderstatus, nt AS n_treatment, nc AS n_control, mt AS mean_treatment, mc AS mean_control, d AS cohens_d, CASE WHEN abs(d) < .5 THEN 'small' WHEN abs(d) < .8 THEN 'medium' ELSE 'large' END AS interpretation FROM (
SELECT *, (mt - mc) / sqrt(((nt - 1) * vt + (nc - 1) * vc) / (nt + nc - 2)) AS d FROM (SELECT o_orderstatus, count(*) FILTER (t) AS nt, count(*) FILTER (NOT t) AS nc, avg(v) FILTER (t) AS mt, avg(v) FILTER (NOT t) AS mc, var_samp(v) FILTER (t) AS vt, var_samp(v) FILTER (NOT t) AS vc
FROM (SELECT o_orderstatus, o_custkey % 2 = 1 AS t, o_totalprice AS v FROM orders) GROUP BY 1))""", "mean_treatment mean_control cohens_d")  # fmt: skip


def _pvalues(s, d):
    o = _orders(s, d).groupBy("o_orderpriority", "o_orderstatus").agg(F.avg("o_totalprice").alias("m"))
    return o.withColumn("p_value", F.pmod(F.floor("m"), F.lit(97)) / 970.0).drop("m")


_PV = "(SELECT o_orderpriority, o_orderstatus, (CAST(floor(avg(o_totalprice)) AS BIGINT) % 97) / 970.0::DOUBLE AS p_value FROM orders GROUP BY 1, 2)"
q("e10_bonferroni", lambda s, d: experiment.bonferroni(_pvalues(s, d)), f"SELECT *, least(p_value * count(*) OVER (), 1) AS p_adjusted, least(p_value * count(*) OVER (), 1) < .05 AS significant FROM {_PV}", "p_value p_adjusted")
q("p14_fdr_bh", lambda s, d: experiment.fdr_bh(_pvalues(s, d)), f"""
SELECT *, q_value <= .05 AS significant FROM (SELECT o_orderpriority, o_orderstatus, p_value, least(1, min(p_value * m / r) OVER (ORDER BY p_value DESC)) AS q_value FROM (SELECT *, count(*) OVER () AS m, count(*) OVER (ORDER BY p_value) AS r FROM {_PV}))""", "p_value q_value")  # fmt: skip
q("d12_cuped_v2", lambda s, d: experiment.cuped(_events(s, d), "value", "user_id").select("n", "theta", "y_var_raw", "y_var_cuped"), """
SELECT count(*) AS n, covar_samp(value, user_id) / var_samp(user_id) AS theta, var_samp(value) AS y_var_raw, var_samp(value) - pow(covar_samp(value, user_id), 2) / var_samp(user_id) AS y_var_cuped FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL""", "theta y_var_raw y_var_cuped")  # fmt: skip
q("d13_srm_check", lambda s, d: experiment.srm_check(_events(s, d), "event_type").drop("p_value", "srm_detected"), """
SELECT count(*) AS n_arms, sum(pow(n - t / k, 2) / (t / k)) AS chi2 FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS t, count(*) OVER () AS k FROM events GROUP BY event_type)""", "chi2")  # fmt: skip
q("d14_bayesian_ab", lambda s, d: experiment.bayesian_ab(_orders(s, d).withColumn("c", (F.col("o_orderstatus") == "F").cast("int")).withColumn("arm", F.col("o_custkey") % 2), "arm", "c", 0, 1))
q("d15_aa_simulation", lambda s, d: experiment.aa_simulation(_events(s, d), "value", 50))
q("d28_did", lambda s, d: experiment.did(_halved(s, d), "o_totalprice", F.col("o_custkey") % 2 == 1, F.col("post")).drop("p_value"), f"""
SELECT m11 - m10 - m01 + m00 AS did_estimate, se AS std_error, (m11 - m10 - m01 + m00) / se AS z FROM (SELECT avg(y) FILTER (t AND p) AS m11, avg(y) FILTER (t AND NOT p) AS m10, avg(y) FILTER (NOT t AND p) AS m01, avg(y) FILTER (NOT t AND NOT p) AS m00,
 sqrt(var_samp(y) FILTER (t AND p) / count(*) FILTER (t AND p) + var_samp(y) FILTER (t AND NOT p) / count(*) FILTER (t AND NOT p) + var_samp(y) FILTER (NOT t AND p) / count(*) FILTER (NOT t AND p) + var_samp(y) FILTER (NOT t AND NOT p) / count(*) FILTER (NOT t AND NOT p)) AS se
FROM (SELECT o_totalprice AS y, o_custkey % 2 = 1 AS t, o_orderdate >= m.m AS p FROM orders, (SELECT {MID} AS m) AS m))""", "did_estimate std_error z", 3)  # fmt: skip

# --- funnels, cohorts, segments

STEPS = ["view", "click", "signup", "purchase"]
as_is("f01_funnel", lambda s, d: product.funnel(_events(s, d), "user_id", "event_type", STEPS), """
WITH u AS (SELECT i AS step_index, s AS step, count(DISTINCT user_id) AS users FROM (VALUES (0, 'view'), (1, 'click'), (2, 'signup'), (3, 'purchase')) AS t(i, s) LEFT JOIN events ON event_type = s GROUP BY ALL)
SELECT step_index, step, users, CAST(CASE WHEN step_index = 0 THEN 1.0 ELSE round(coalesce(users / nullif(lag(users) OVER w, 0), 0), 6) END AS DOUBLE) AS step_rate, round(coalesce(users / nullif(first_value(users) OVER w, 0), 0), 6) AS cumulative_rate FROM u WINDOW w AS (ORDER BY step_index)""")  # fmt: skip
as_is("f01_funnel_ordered", lambda s, d: product.funnel(_events(s, d), "user_id", "event_type", STEPS, "ts", True), """
WITH RECURSIVE e AS (SELECT DISTINCT user_id, event_type, ts FROM events), st(i, s) AS (VALUES (0, 'view'), (1, 'click'), (2, 'signup'), (3, 'purchase')),
r AS (SELECT user_id, 0 AS i, min(ts) AS t FROM e WHERE event_type = 'view' GROUP BY user_id
 UNION ALL SELECT user_id, i, t FROM (SELECT r.user_id, r.i + 1 AS i, min(e.ts) AS t FROM r JOIN st ON st.i = r.i + 1 JOIN e ON e.user_id = r.user_id AND e.event_type = st.s AND e.ts >= r.t GROUP BY r.user_id, r.i)),
u AS (SELECT st.i AS step_index, st.s AS step, count(DISTINCT user_id) AS users FROM st LEFT JOIN r ON r.i = st.i GROUP BY ALL)
SELECT step_index, step, users, CAST(CASE WHEN step_index = 0 THEN 1.0 ELSE round(coalesce(users / nullif(lag(users) OVER w, 0), 0), 6) END AS DOUBLE) AS step_rate, round(coalesce(users / nullif(first_value(users) OVER w, 0), 0), 6) AS cumulative_rate FROM u WINDOW w AS (ORDER BY step_index)""")  # fmt: skip
_COHORT = """WITH f AS (SELECT user_id, date_trunc('{c}', min(ts)) AS cohort FROM events GROUP BY 1), a AS (SELECT DISTINCT f.cohort, date_trunc('{p}', e.ts) AS period, e.user_id FROM events e JOIN f USING (user_id)),
n AS (SELECT cohort, count(*) AS cohort_size FROM f GROUP BY 1) """
q("d01_cohort_retention", lambda s, d: product.cohort_retention(_events(s, d), "user_id", "ts", "week", "day"), _COHORT.format(c="week", p="day") + """
SELECT CAST(cohort AS TIMESTAMP) AS cohort, CAST(period AS TIMESTAMP) AS period, count(*) AS active, any_value(cohort_size) AS cohort_size, count(*) / any_value(cohort_size) AS retention FROM a JOIN n USING (cohort) GROUP BY cohort, period""", "retention")  # fmt: skip
as_is("f02_cohort_matrix", lambda s, d: product.cohort_matrix(_orders(s, d), "o_custkey", "o_orderdate"), """
WITH f AS (SELECT o_custkey, date_trunc('month', min(o_orderdate)) AS cohort FROM orders GROUP BY 1), a AS (SELECT DISTINCT f.cohort, date_diff('month', f.cohort, date_trunc('month', o_orderdate)) AS period_index, o_custkey FROM orders JOIN f USING (o_custkey)),
n AS (SELECT cohort, count(*) AS cohort_size FROM f GROUP BY 1), k AS (SELECT cohort, cohort_size, unnest(range(0, (SELECT max(period_index) + 1 FROM a))) AS period_index FROM n), c AS (SELECT cohort, period_index, count(*) AS active FROM a GROUP BY ALL)
SELECT CAST(cohort AS TIMESTAMP) AS cohort, cohort_size, CAST(period_index AS INTEGER) AS period_index, coalesce(active, 0) AS active, round(coalesce(active, 0) / cohort_size, 6) AS retention FROM k LEFT JOIN c USING (cohort, period_index)""")  # fmt: skip
q("f03_segments", lambda s, d: product.segments(table(s, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], 4))
q("d16_markov_attribution", lambda s, d: product.markov_attribution(_events(s, d).withColumn("channel", F.concat(F.lit("c"), F.pmod(F.col("event_id"), F.lit(4)).cast("string"))), "user_id", "event_type", "ts", "channel", "purchase", "event_id"))

# --- group tools

q("d02_mean", lambda s, d: quality.group_mean(_events(s, d), "value", ["event_type"]), "SELECT event_type, avg(value) AS mean, count(value) AS n FROM events GROUP BY 1", "mean")
q("d03_moving_average", lambda s, d: facade.invoke("calculate_rolling_window", _events(s, d), ts="ts", value="value", group=["event_type"], tie=["event_id"], w=5).select("event_id", F.col("rolling").alias("moving_average")), "SELECT event_id, avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS moving_average FROM events", "moving_average")
q("d04_outliers_iqr", lambda s, d: quality.outliers_iqr(_events(s, d).select("event_id", "event_type", "value"), "value", ["event_type"]), """
SELECT event_id, event_type, value, CAST(coalesce(value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a), false) AS INTEGER) AS is_outlier FROM (SELECT *, quantile_cont(value, .25) OVER g AS a, quantile_cont(value, .75) OVER g AS b FROM events WINDOW g AS (PARTITION BY event_type))""", "value")  # fmt: skip
_FLUX = """SELECT o_orderpriority, CAST(period AS TIMESTAMP) AS period, amount, flux, flux_pct, CASE WHEN o IS NULL THEN 'new' WHEN amount = 0 AND o <> 0 THEN 'dropped' WHEN abs(flux_pct) >= 0.2 THEN 'material' ELSE 'stable' END AS flux_label FROM (
SELECT *, amount - o AS flux, (amount - o) / nullif(abs(o), 0) AS flux_pct FROM (SELECT *, lag(amount) OVER (PARTITION BY o_orderpriority ORDER BY period) AS o FROM (SELECT o_orderpriority, date_trunc('month', {t}) AS period, sum({v}) AS amount FROM {src} GROUP BY ALL)))"""
q("d05_flux_variance", lambda s, d: quality.flux_variance(_orders(s, d), "o_totalprice", "o_orderdate", ["o_orderpriority"]), _FLUX.format(t="o_orderdate", v="o_totalprice", src="orders"), "amount flux flux_pct", 3)
q("d06_period_trend", lambda s, d: quality.period_trend(_orders(s, d), "o_totalprice", "o_orderdate", ["o_orderpriority"]), """
SELECT o_orderpriority, regr_slope(v, i) AS slope, regr_intercept(v, i) AS intercept, pow(corr(v, i), 2) AS r_squared, count(*) AS n_periods FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY period) - 1 AS i
FROM (SELECT o_orderpriority, date_trunc('month', o_orderdate) AS period, avg(o_totalprice) AS v FROM orders GROUP BY ALL)) GROUP BY 1""", "slope intercept r_squared")  # fmt: skip
q("d07_distribution_summary", lambda s, d: quality.distribution_summary(_orders(s, d), "o_totalprice", ["o_orderpriority"]), """
SELECT o_orderpriority, count(o_totalprice) AS n, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS std, min(o_totalprice) AS min, quantile_cont(o_totalprice, .05) AS p05, quantile_cont(o_totalprice, .25) AS p25, quantile_cont(o_totalprice, .5) AS p50, quantile_cont(o_totalprice, .75) AS p75, quantile_cont(o_totalprice, .95) AS p95, max(o_totalprice) AS max FROM orders GROUP BY 1""", "mean std min p05 p25 p50 p75 p95 max")  # fmt: skip


def _returns(s, d):
    e = timeseries.percent_change(_events(s, d), "ts", "value", ["event_type"], ["event_id"], 1, "log")
    return e.select("event_type", (F.col("percent_change") / 100).alias("r")).where("r IS NOT NULL")


_RET = "(SELECT event_type, ln(value / o) AS r FROM (SELECT event_type, value, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS o FROM events) WHERE value > 0 AND o > 0)"
q("d08_historical_var", lambda s, d: quality.historical_var(_returns(s, d), "r", 0.05, ["event_type"]), f"SELECT event_type, -quantile_cont(r, .05) AS var, .05::DOUBLE AS alpha FROM {_RET} GROUP BY 1", "var")


def _two(s, d):
    e = _events(s, d)
    return e.where(F.dayofmonth("ts") <= 15), e.where(F.dayofmonth("ts") > 15)


q("d09_psi", lambda s, d: quality.psi(*_two(s, d), "value"), """
WITH c AS (SELECT [quantile_cont(value, i / 10.0) FOR i IN range(1, 1)] AS x, quantile_cont(value, [.1, .2, .3, .4, .5, .6, .7, .8, .9]) AS cuts FROM events WHERE day(ts) <= 15),
b AS (SELECT len(list_filter(cuts, lambda k: k < value)) AS bin, count(*) FILTER (day(ts) <= 15) AS b, count(*) FILTER (day(ts) > 15) AS c FROM events, c WHERE value IS NOT NULL GROUP BY 1),
p AS (SELECT b, c, greatest(b / sum(b) OVER (), 1e-6) AS pb, greatest(c / sum(c) OVER (), 1e-6) AS pc FROM b)
SELECT count(*) AS n_bins, sum((pc - pb) * ln(pc / pb)) AS psi, CAST(sum(b) AS BIGINT) AS n_baseline, CAST(sum(c) AS BIGINT) AS n_current FROM p""".replace("[quantile_cont(value, i / 10.0) FOR i IN range(1, 1)] AS x, ", ""), "psi")  # fmt: skip
q("d10_x_bar_r_chart", lambda s, d: quality.x_bar_r_chart(table(s, d, "lineitem"), "l_quantity", "l_suppkey", 5), """
SELECT l_suppkey, xbar, r, lcl AS xbar_lcl, ucl AS xbar_ucl, 0.0::DOUBLE AS r_lcl, 2.114 * rb AS r_ucl, CAST(NOT (xbar BETWEEN lcl AND ucl) OR NOT (r BETWEEN 0 AND 2.114 * rb) AS INTEGER) AS out_of_control FROM (
SELECT *, avg(xbar) OVER () - .577 * avg(r) OVER () AS lcl, avg(xbar) OVER () + .577 * avg(r) OVER () AS ucl, avg(r) OVER () AS rb FROM (SELECT l_suppkey, avg(l_quantity) AS xbar, max(l_quantity) - min(l_quantity) AS r FROM lineitem GROUP BY 1))""", "xbar r xbar_lcl xbar_ucl r_lcl r_ucl")  # fmt: skip
q("d11_cp_cpk", lambda s, d: quality.cp_cpk(table(s, d, "lineitem"), "l_quantity", 0.0, 52.0, ["l_returnflag"]), """
SELECT l_returnflag, count(l_quantity) AS n, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS std, 52.0 / (6 * stddev_samp(l_quantity)) AS cp, least(52.0 - avg(l_quantity), avg(l_quantity)) / (3 * stddev_samp(l_quantity)) AS cpk FROM lineitem GROUP BY 1""", "mean std cp cpk")  # fmt: skip
q("d17_seasonal_residuals", lambda s, d: quality.seasonal_residuals(_events(s, d).select("event_id", "event_type", "ts", "value"), "ts", "value", 7, ["event_type"], ["event_id"]), """
WITH r AS (SELECT event_id, event_type, ts, value, CASE WHEN count(*) OVER w = 7 THEN sum(value) OVER w / 7 END AS trend, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) % 7 AS k FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
m AS (SELECT event_type, k, avg(value - trend) AS m FROM r GROUP BY ALL), s AS (SELECT event_type, k, m - avg(m) OVER (PARTITION BY event_type) AS seasonal FROM m)
SELECT event_id, event_type, ts, value, trend, seasonal, value - trend - seasonal AS residual FROM r JOIN s USING (event_type, k)""", "value trend seasonal residual")  # fmt: skip


def _daily(s, d):
    return _events(s, d).groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.avg("value").alias("value"))


q("d18_change_points", lambda s, d: models.change_points(_events(s, d), "ts", "value", ["event_type"]))
q("d19_forecast_anomalies", lambda s, d: models.forecast_anomalies(_events(s, d), "ts", "value", 30, ["event_type"]), """
WITH r AS (SELECT event_type, value AS y, row_number() OVER (PARTITION BY event_type ORDER BY ts, value) - 1 AS i, count(*) OVER (PARTITION BY event_type) - 30 AS k FROM events WHERE value IS NOT NULL AND ts IS NOT NULL),
f AS (SELECT event_type, any_value(k) AS k, regr_slope(y, i) AS b, regr_intercept(y, i) AS a, regr_syy(y, i) - regr_sxy(y, i) * regr_slope(y, i) AS rss FROM r WHERE i < k GROUP BY 1)
SELECT event_type, i, y, a + b * i AS yhat, y - (a + b * i) AS residual, (y - (a + b * i)) / sqrt(rss / (f.k - 2)) AS z_score, abs((y - (a + b * i)) / sqrt(rss / (f.k - 2))) > 3 AS is_anomaly FROM r JOIN f USING (event_type) WHERE i >= f.k""", "yhat residual z_score y", 3)
q("d20_monte_carlo", lambda s, d: models.monte_carlo(_returns(s, d).withColumn("r", F.col("r") / 1000), "r"))
q("d21_fit_distributions", lambda s, d: models.fit_distributions(_orders(s, d), "o_totalprice"))
_WEIGHTS = {"l_quantity": 0.6, "l_discount": 0.4}
q("d22_portfolio_risk", lambda s, d: quality.portfolio_risk(table(s, d, "lineitem"), _WEIGHTS), "SELECT avg(p) AS portfolio_mean, stddev_samp(p) AS portfolio_vol, count(*) AS n FROM (SELECT .6 * l_quantity + .4 * l_discount AS p FROM lineitem)", "portfolio_mean portfolio_vol")
q("d22_risk_attribution", lambda s, d: quality.risk_attribution(table(s, d, "lineitem"), _WEIGHTS), """
SELECT a AS asset, w AS weight, c AS contribution_to_variance FROM (SELECT unnest(['l_quantity', 'l_discount']) AS a, unnest([.6, .4]::DOUBLE[]) AS w, unnest([.6 * covar_samp(l_quantity, p) / var_samp(p), .4 * covar_samp(l_discount, p) / var_samp(p)]) AS c FROM (SELECT *, .6 * l_quantity + .4 * l_discount AS p FROM lineitem))""", "weight contribution_to_variance")  # fmt: skip
q("d23_adf_kpss", lambda s, d: models.adf_kpss(_events(s, d), "ts", "value", ["event_type"]))
q("d24_acf", lambda s, d: models.acf_pacf(_events(s, d), "ts", "value", 8, ["event_type"]).drop("pacf"), """
WITH r AS (SELECT event_type, row_number() OVER w AS i, value - avg(value) OVER (PARTITION BY event_type) AS e FROM events WHERE value IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY event_type ORDER BY ts, value)), s AS (SELECT event_type, sum(e * e) AS q FROM r GROUP BY 1),
p AS (SELECT a.event_type, l.lag, sum(a.e * b.e) AS x FROM r a JOIN r b ON a.event_type = b.event_type JOIN (SELECT unnest(range(0, 9)) AS lag) l ON b.i = a.i - l.lag GROUP BY ALL) SELECT event_type, lag, x / q AS acf FROM p JOIN s USING (event_type)""", "acf", 6)
q("d24_acf_pacf", lambda s, d: models.acf_pacf(_events(s, d), "ts", "value", 8, ["event_type"]))
q("d25_naive_baseline", lambda s, d: quality.naive_baseline(_events(s, d), "ts", "value", 3, ["event_type"]), "SELECT event_type, CAST(h AS INTEGER) AS step, arg_max(value, ts) AS yhat FROM events, range(1, 4) AS r(h) GROUP BY ALL", "yhat")
q("d25_drift_baseline", lambda s, d: quality.naive_baseline(_events(s, d), "ts", "value", 3, ["event_type"], True), "SELECT event_type, CAST(h AS INTEGER) AS step, arg_max(value, ts) + h * (arg_max(value, ts) - arg_min(value, ts)) / (count(*) - 1) AS yhat FROM events, range(1, 4) AS r(h) GROUP BY event_type, h", "yhat")
q("d26_arima", lambda s, d: models.arima(_events(s, d), "ts", "value", (2, 1, 0), 5, ["event_type"]))
q("d26_ets", lambda s, d: models.ets(_daily(s, d), "day", "value", True, 5, ["event_type"]))
q("d27_forecast_metrics", lambda s, d: quality.forecast_metrics(_events(s, d).withColumn("f", F.col("value") * 1.1 + 1), "value", "f", "ts", ["event_type"], ["event_id"]), """
SELECT event_type, count(*) AS n, avg(e / nullif(abs(value), 0)) * 100 AS mape, avg(2 * e / nullif(abs(value) + abs(f), 0)) * 100 AS smape, sum(e) / sum(abs(value)) * 100 AS wape, avg(e) AS mae, sqrt(avg(e * e)) AS rmse, avg(e) / avg(st) AS mase
FROM (SELECT *, abs(value - f) AS e, abs(value - lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id)) AS st FROM (SELECT *, value * 1.1 + 1 AS f FROM events)) GROUP BY 1""", "mape smape wape mae rmse mase")  # fmt: skip
q("d29_price_elasticity", lambda s, d: quality.price_elasticity(table(s, d, "lineitem"), "l_extendedprice", "l_quantity", ["l_linestatus"]), """
SELECT l_linestatus, regr_slope(ln(l_quantity), ln(l_extendedprice)) AS elasticity, regr_intercept(ln(l_quantity), ln(l_extendedprice)) AS intercept, pow(corr(ln(l_quantity), ln(l_extendedprice)), 2) AS r_squared, count(*) AS n FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0 GROUP BY 1""", "elasticity intercept r_squared")  # fmt: skip
q("d30_run_kmeans", lambda s, d: product.segments(_events(s, d).select("event_id", "value"), ["value"], 3).groupBy("segment").agg(F.count("*").alias("n"), F.avg("cluster_center_distance").alias("spread")))


def _lives(s, d):
    """Days an order's customer took to the next one, in whole; the last of each is censored."""
    o = _orders(s, d).select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate")
    from brindle.operators import frames

    f = frames.rolling(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], 0, 1)
    nxt = F.lead("o_orderdate").over(f.order)
    end = F.expr("TIMESTAMP_NTZ'1999-01-01 00:00:00'")
    return f.done(f.df.withColumn("duration", F.datediff(F.coalesce(nxt, end), "o_orderdate")).withColumn("event", nxt.isNotNull().cast("int")))


_LIVES = """(SELECT o_orderpriority, date_diff('day', CAST(o_orderdate AS DATE), CAST(coalesce(nxt, TIMESTAMP '1999-01-01') AS DATE)) AS duration, CAST(nxt IS NOT NULL AS INTEGER) AS event FROM (SELECT *, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt FROM orders))"""
q("d31_kaplan_meier", lambda s, d: quality.kaplan_meier(_lives(s, d), "duration", "event", ["o_orderpriority"]), f"""
SELECT o_orderpriority, t, at_risk, events, product(1 - events / at_risk) OVER (PARTITION BY o_orderpriority ORDER BY t) AS survival FROM (SELECT o_orderpriority, t, events, CAST(sum(n) OVER (PARTITION BY o_orderpriority ORDER BY t DESC) AS BIGINT) AS at_risk
FROM (SELECT o_orderpriority, CAST(duration AS DOUBLE) AS t, count(*) AS n, CAST(sum(event) AS BIGINT) AS events FROM {_LIVES} GROUP BY ALL))""", "t survival")  # fmt: skip
q("d32_log_rank", lambda s, d: quality.log_rank(_lives(s, d).where(F.col("o_orderpriority").isin("1-URGENT", "5-LOW")), "duration", "event", "o_orderpriority").drop("p_value"), f"""
WITH l AS (SELECT duration AS t, event AS e, o_orderpriority = '1-URGENT' AS g FROM {_LIVES} WHERE o_orderpriority IN ('1-URGENT', '5-LOW')), k AS (SELECT t, sum(e) AS d, coalesce(sum(e) FILTER (g), 0) AS d1, count(*) AS n, count(*) FILTER (g) AS n1 FROM l GROUP BY t),
r AS (SELECT *, sum(n) OVER w AS r, sum(n1) OVER w AS r1 FROM k WINDOW w AS (ORDER BY t DESC))
SELECT o AS observed, ex AS expected, pow(o - ex, 2) / v AS chi2 FROM (SELECT CAST(sum(d1) AS DOUBLE) AS o, sum(d * r1 / r) AS ex, sum(CASE WHEN r > 1 THEN d * (r1 / r) * (1 - r1 / r) * (r - d) / (r - 1) ELSE 0 END) AS v FROM r)""", "observed expected chi2")  # fmt: skip
_ECDF = "(SELECT value AS v, sum(count(*) FILTER (day(ts) <= 15)) OVER (ORDER BY value) / (SELECT count(*) FROM events WHERE day(ts) <= 15) AS fx, sum(count(*) FILTER (day(ts) > 15)) OVER (ORDER BY value) / (SELECT count(*) FROM events WHERE day(ts) > 15) AS fy FROM events GROUP BY value)"
q("d33_ks_test", lambda s, d: quality.ks_test(*_two(s, d), "value").drop("p_value"), f"SELECT max(abs(fx - fy)) AS statistic, (SELECT count(*) FROM events WHERE day(ts) <= 15) AS n_a, (SELECT count(*) FROM events WHERE day(ts) > 15) AS n_b FROM {_ECDF}", "statistic")
q("d33_wasserstein", lambda s, d: quality.wasserstein(*_two(s, d), "value"), f"SELECT sum(abs(fx - fy) * w) AS distance FROM (SELECT *, lead(v) OVER (ORDER BY v) - v AS w FROM {_ECDF})", "distance")
q("d33_jensen_shannon", lambda s, d: quality.jensen_shannon(*_two(s, d), "value"), """
WITH e AS (SELECT day(ts) <= 15 AS a, least(CAST(floor((value - (SELECT min(value) FROM events)) / ((SELECT max(value) FROM events) - (SELECT min(value) FROM events)) * 10) AS BIGINT), 9) AS bin FROM events), b AS (SELECT bin, count(*) FILTER (a) AS x, count(*) FILTER (NOT a) AS y FROM e GROUP BY bin),
p AS (SELECT x / sum(x) OVER () AS p, y / sum(y) OVER () AS q FROM b) SELECT sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2 AS divergence, count(*) AS n_bins FROM p""", "divergence")  # fmt: skip

# --- causal screening

q("c01_granger", lambda s, d: models.granger(_daily(s, d).groupBy("day").pivot("event_type", ["click", "view"]).agg(F.first("value")), "day", "click", "view", 3))
q("c02_dependence", lambda s, d: causal.dependence(table(s, d, "lineitem"), "l_quantity", "l_extendedprice", "l_discount").drop("p_value"), """
SELECT n, (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) AS correlation FROM (SELECT count(*) AS n, corr(l_quantity, l_extendedprice) AS xy, corr(l_quantity, l_discount) AS xz, corr(l_extendedprice, l_discount) AS yz FROM lineitem)""", "correlation")  # fmt: skip
q("c03_direction", lambda s, d: causal.direction(table(s, d, "lineitem"), "l_quantity", "l_extendedprice"))


def _verdicts(s, d):
    f = table(s, d, "nation").select(F.col("n_nationkey").alias("candidate_id"), F.explode(F.array(*[F.struct(F.lit(f"a{i}").alias("algorithm"), F.when((F.col("n_nationkey") + i) % 3 == 0, "forward").when((F.col("n_nationkey") * i) % 5 == 1, "backward").otherwise("none").alias("direction")) for i in range(4)])).alias("x")).select("candidate_id", "x.*")
    return causal.verdicts(f, table(s, d, "nation").select(F.col("n_nationkey").alias("candidate_id"), (F.col("n_nationkey") * 10).alias("n_rows")))


q("c06_verdicts", _verdicts, """
WITH f AS (SELECT n_nationkey AS c, i, CASE WHEN (n_nationkey + i) % 3 = 0 THEN 'forward' WHEN (n_nationkey * i) % 5 = 1 THEN 'backward' ELSE 'none' END AS dir FROM nation, range(0, 4) AS r(i)), v AS (SELECT c, count(DISTINCT i) FILTER (dir = 'forward') AS fwd, count(DISTINCT i) FILTER (dir = 'backward') AS bwd FROM f GROUP BY c)
SELECT c AS candidate_id, c * 10 AS n_rows, fwd, bwd, CASE WHEN c * 10 < 30 THEN 'inconclusive' WHEN fwd >= 2 AND fwd > bwd THEN 'validated' WHEN fwd = 0 THEN 'rejected' ELSE 'inconclusive' END AS decision FROM v""")  # fmt: skip


# --- the flagship recipe

_JOINED = "(SELECT o.o_orderpriority, l.l_shipdate, l.l_extendedprice FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"


def flux_inputs(s, d):
    o = _orders(s, d).select("o_orderkey", "o_orderpriority")
    return table(s, d, "lineitem").select("l_orderkey", "l_shipdate", "l_extendedprice").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderpriority", "l_shipdate", "l_extendedprice")


def flux_result(s, d):
    r = runtime.FluxRecipe(lambda session, params: flux_inputs(s, d))
    params = {"rate_col": "l_extendedprice", "date_col": "l_shipdate", "group_cols": ["o_orderpriority"]}
    r.validate(params)
    return r.compute(r.extract(runtime.Session(s, runtime.Context(recipe=r.name)), params), params)


q("n16_flux_recipe", lambda s, d: flux_result(s, d).primary, _FLUX.format(t="l_shipdate", v="l_extendedprice", src=_JOINED), "amount flux flux_pct", 2)
q("n16_flux_distribution", lambda s, d: flux_result(s, d).table("distribution").select("o_orderpriority", "n", "mean", "p50", "p95"), f"SELECT o_orderpriority, count(*) AS n, avg(l_extendedprice) AS mean, quantile_cont(l_extendedprice, .5) AS p50, quantile_cont(l_extendedprice, .95) AS p95 FROM {_JOINED} GROUP BY 1", "mean p50 p95")
q("n16_flux_trend", lambda s, d: flux_result(s, d).table("trend"), f"""
SELECT o_orderpriority, regr_slope(v, i) AS slope, regr_intercept(v, i) AS intercept, pow(corr(v, i), 2) AS r_squared, count(*) AS n_periods FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY period) - 1 AS i
FROM (SELECT o_orderpriority, date_trunc('month', l_shipdate) AS period, avg(l_extendedprice) AS v FROM {_JOINED} GROUP BY ALL)) GROUP BY 1""", "slope intercept r_squared")  # fmt: skip
