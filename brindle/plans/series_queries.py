"""Queries of the moving-window, time-series and anomaly operators over the events table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from brindle.functions.expr import rounded, rounded_sql
from brindle.operators import anomaly, models, timeseries as ts, windows as w
from brindle.plans.registry import Registry
from brindle.session import table

REG = Registry()
KEYS = dict(ts="ts", value="value", group=["event_type"], tie=["event_id"])
FLAT = dict(ts="ts", value="value", tie=["event_id"])
COLS = "event_id, event_type, ts, value"
SRC = f"(SELECT {COLS} FROM events WHERE ts IS NOT NULL AND value IS NOT NULL) AS e"
BY = "PARTITION BY event_type ORDER BY ts, event_id"


def _events(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", "event_type", "ts", "value")


def _panel(s: SparkSession, d: str) -> DataFrame:
    """Mean value per day and event type: a metric panel."""
    e = _events(s, d)
    return e.groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("metric")).agg(F.avg("value").alias("v"))


PANEL = "(SELECT CAST(ts AS DATE) AS day, event_type AS metric, avg(value) AS v FROM events GROUP BY ALL)"


def q(name: str, fn: Callable[[SparkSession, str], DataFrame], sql: str | None = None, doubles: str = "", digits: int = 4) -> None:
    text = None if sql is None else rounded_sql(sql, doubles.split(), digits)
    REG.add(name, text)(lambda s, d: rounded(fn(s, d), digits))


def frame(n: int) -> str:
    return f"({BY} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


# --- moving windows

q("m01_sma", lambda s, d: w.sma(_events(s, d), **KEYS, w=7), f"""
SELECT {COLS}, sma, value - sma AS deviation, (value - sma) / nullif(sma, 0) * 100 AS deviation_pct, sma + 2 * sd AS upper_band, sma - 2 * sd AS lower_band
FROM (SELECT *, avg(value) OVER w AS sma, coalesce(stddev_samp(value) OVER w, 0) AS sd FROM {SRC} WINDOW w AS {frame(7)})""", "value sma deviation deviation_pct upper_band lower_band")  # fmt: skip
q("m02_wma", lambda s, d: w.wma(_events(s, d), **KEYS, w=7), f"""
SELECT {COLS}, rn, wma, value - wma AS deviation FROM (
 SELECT *, sum(value * rn) OVER w / sum(rn) OVER w AS wma FROM (SELECT *, row_number() OVER (ORDER BY ts, event_type, event_id) AS rn FROM {SRC})
 WINDOW w AS (PARTITION BY event_type ORDER BY rn RANGE BETWEEN 6 PRECEDING AND CURRENT ROW))""", "value wma deviation")  # fmt: skip
q("m03_moving_variance", lambda s, d: w.moving_variance(_events(s, d), **KEYS, w=7), f"""
SELECT {COLS}, moving_mean, variance, std_dev, std_dev / nullif(abs(moving_mean), 0) * 100 AS cv, (value - moving_mean) / nullif(std_dev, 0) AS z_score
FROM (SELECT *, avg(value) OVER w AS moving_mean, var_samp(value) OVER w AS variance, stddev_samp(value) OVER w AS std_dev FROM {SRC} WINDOW w AS {frame(7)})""", "value moving_mean variance std_dev cv z_score")  # fmt: skip
q("m04_moving_quantiles", lambda s, d: w.moving_quantiles(_events(s, d), **KEYS, w=7), f"""
SELECT {COLS}, q_low, q_mid, q_high, q_high - q_low AS iqr FROM (
 SELECT *, quantile_cont(value, 0.25) OVER w AS q_low, quantile_cont(value, 0.5) OVER w AS q_mid, quantile_cont(value, 0.75) OVER w AS q_high FROM {SRC} WINDOW w AS {frame(7)})""", "value q_low q_mid q_high iqr")  # fmt: skip
q("m05_moving_minmax", lambda s, d: w.moving_minmax(_events(s, d), **KEYS, w=7), f"""
SELECT {COLS}, lo AS moving_min, hi AS moving_max, hi - lo AS moving_range, coalesce((value - lo) / nullif(hi - lo, 0), 0.5) AS position
FROM (SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi FROM {SRC} WINDOW w AS {frame(7)})""", "value moving_min moving_max moving_range position")  # fmt: skip
q("m06_moving_correlation", lambda s, d: w.moving_correlation(_events(s, d).withColumn("y", F.hour("ts").cast("double")), "ts", "value", "y", ["event_type"], ["event_id"], 12), f"""
SELECT *, CASE WHEN correlation IS NULL OR isnan(correlation) THEN NULL WHEN abs(correlation) > .8 THEN 'very_strong' WHEN abs(correlation) > .6 THEN 'strong' WHEN abs(correlation) > .4 THEN 'moderate' WHEN abs(correlation) > .2 THEN 'weak' ELSE 'very_weak' END AS strength
FROM (SELECT {COLS}, y, CASE WHEN n >= 2 AND sy > 1e-12 THEN c END AS correlation FROM (
 SELECT *, corr(value, y) OVER w AS c, stddev_pop(y) OVER w AS sy, count(*) OVER w AS n FROM (SELECT *, CAST(hour(ts) AS DOUBLE) AS y FROM {SRC}) WINDOW w AS {frame(12)}))""", "value correlation")  # fmt: skip
q("m07_moving_sum", lambda s, d: w.moving_sum(_events(s, d), **KEYS, w=7), f"""
SELECT {COLS}, ms AS moving_sum, value / nullif(ms, 0) * 100 AS contribution_pct FROM (SELECT *, sum(value) OVER {frame(7)} AS ms FROM {SRC})""", "value moving_sum contribution_pct")  # fmt: skip
for _op, _sql in (("mean", "avg(value)"), ("std", "stddev_samp(value)"), ("max", "max(value)")):
    q(f"m08_expanding_{_op}", lambda s, d, _op=_op: w.expanding(_events(s, d), **KEYS, op=_op), f"""
SELECT {COLS}, count(*) OVER w AS window_size, {_sql} OVER w AS expanding FROM {SRC} WINDOW w AS ({BY} ROWS UNBOUNDED PRECEDING)""", "value expanding")  # fmt: skip
q("m09_cumulative_operations", lambda s, d: w.cumulative_all(_events(s, d).withColumn("value", 1 + F.col("value") / 1e6), **KEYS), f"""
SELECT {COLS}, sum(value) OVER w AS cumsum, product(value) OVER w AS cumproduct, max(value) OVER w AS cummax, min(value) OVER w AS cummin, sum(value) OVER w / sum(value) OVER (PARTITION BY event_type) * 100 AS pct_of_total
FROM (SELECT * REPLACE (1 + value / 1e6 AS value) FROM {SRC}) WINDOW w AS ({BY} ROWS UNBOUNDED PRECEDING)""", "value cumsum cumproduct cummax cummin pct_of_total")  # fmt: skip
q("m10_time_weighted_ma", lambda s, d: w.time_weighted_ma(_events(s, d), **FLAT, w=10, decay=0.1), f"""
WITH r AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS rn FROM {SRC})
SELECT a.event_id, a.event_type, a.ts, a.value, sum(b.value * exp(-0.1 * (a.rn - b.rn))) / sum(exp(-0.1 * (a.rn - b.rn))) AS twma
FROM r a JOIN r b ON b.rn BETWEEN a.rn - 9 AND a.rn GROUP BY ALL""", "value twma")  # fmt: skip
q("m11_bollinger", lambda s, d: w.bollinger(_events(s, d), **KEYS), f"""
SELECT {COLS}, middle, middle + 2 * sd AS upper, middle - 2 * sd AS lower, 4 * sd / nullif(middle, 0) AS bandwidth, CASE WHEN sd <> 0 THEN (value - middle + 2 * sd) / (4 * sd) END AS percent_b
FROM (SELECT *, avg(value) OVER w AS middle, coalesce(stddev_samp(value) OVER w, 0) AS sd FROM {SRC} WINDOW w AS {frame(20)})""", "value middle upper lower bandwidth percent_b")  # fmt: skip
q("m12_moving_rank", lambda s, d: w.moving_rank(_events(s, d), **KEYS, w=7), f"""
WITH r AS (SELECT *, row_number() OVER ({BY}) AS rn FROM {SRC}),
g AS (SELECT a.event_id, a.event_type, a.ts, a.value, count(*) AS n, count(*) FILTER (b.value > a.value) AS above, count(*) FILTER (b.value < a.value) AS below, max(b.value) AS hi, min(b.value) AS lo
FROM r a JOIN r b ON a.event_type = b.event_type AND b.rn BETWEEN a.rn - 6 AND a.rn GROUP BY a.event_id, a.event_type, a.ts, a.value)
SELECT event_id, event_type, ts, value, above + 1 AS moving_rank, CASE WHEN n > 1 THEN below / (n - 1) * 100 ELSE 0.0 END AS percentile, hi - value < 1e-12 AS is_highest, value - lo < 1e-12 AS is_lowest FROM g""", "value percentile")  # fmt: skip
q("m13_ema", lambda s, d: w.ema(_events(s, d), **KEYS, alpha=0.3), f"""
WITH RECURSIVE r AS (SELECT *, row_number() OVER ({BY}) AS rn FROM {SRC}),
e AS (SELECT event_id, event_type, ts, value, rn, CAST(value AS DOUBLE) AS ema FROM r WHERE rn = 1
 UNION ALL SELECT r.event_id, r.event_type, r.ts, r.value, r.rn, 0.3 * r.value + 0.7 * e.ema FROM e JOIN r ON r.event_type = e.event_type AND r.rn = e.rn + 1)
SELECT {COLS}, ema, value - ema AS deviation FROM e""", "value ema deviation")  # fmt: skip
q("m14_ema_list", lambda s, d: _events(s, d).withColumn("l", F.array(F.col("value"), F.col("value") + 1)).select("event_id", w.ema_list(F.col("l"), 0.5).alias("e")).select("event_id", F.col("e")[0].alias("e0"), F.col("e")[1].alias("e1")),
  "SELECT event_id, value AS e0, value + 0.5 AS e1 FROM events", "e0 e1")
q("m15_moving_average_simple", lambda s, d: w.moving_average(_events(s, d), **KEYS, w=5).select("event_id", "sma"), f"SELECT event_id, avg(value) OVER {frame(5)} AS sma FROM {SRC}", "sma")
for _op, _sql in (("std", "coalesce(stddev_samp(value) OVER w, 0)"), ("mean", "avg(value) OVER w"), ("min", "min(value) OVER w")):
    q(f"m16_rolling_{_op}", lambda s, d, _op=_op: w.rolling(_events(s, d), **KEYS, w=7, op=_op), f"""
SELECT {COLS}, r AS rolling, value - r AS deviation, (value - r) / nullif(r, 0) * 100 AS deviation_pct FROM (SELECT *, {_sql} AS r FROM {SRC} WINDOW w AS {frame(7)})""", "value rolling deviation deviation_pct", 3)  # fmt: skip
q("m17_volatility", lambda s, d: w.volatility(_events(s, d), **KEYS), f"""
SELECT {COLS}, sd AS volatility, sd * sd AS variance, sd / nullif(abs(m), 0) * 100 AS cv, 'moderate' AS level
FROM (SELECT *, coalesce(stddev_samp(value) OVER w, 0) AS sd, avg(value) OVER w AS m FROM {SRC} WINDOW w AS {frame(5)})""", "value volatility variance cv")  # fmt: skip

# --- time series

for _n, _f, _k in (("t01_lag", ts.lag, 1), ("t01_lag3", ts.lag, 3)):
    q(_n, lambda s, d, _f=_f, _k=_k: _f(_events(s, d), **KEYS, k=_k), f"""
SELECT {COLS}, o AS lagged, value - o AS change, (value - o) / nullif(o, 0) * 100 AS change_pct FROM (SELECT *, lag(value, {_k}) OVER ({BY}) AS o FROM {SRC})""", "value lagged change change_pct", 3)  # fmt: skip
q("t02_lead", lambda s, d: ts.lead(_events(s, d), **KEYS), f"""
SELECT {COLS}, o AS led, o - value AS change, (o - value) / nullif(value, 0) * 100 AS change_pct FROM (SELECT *, lead(value) OVER ({BY}) AS o FROM {SRC})""", "value led change change_pct", 3)  # fmt: skip
_PERIOD = {
    "hour": "strftime(ts, '%Y-%m-%d %H:00')", "day": "strftime(ts, '%Y-%m-%d')", "week": "strftime(ts, '%G-W%V')", "month": "strftime(ts, '%Y-%m')",
    "quarter": "year(ts) || '-Q' || quarter(ts)", "year": "CAST(year(ts) AS VARCHAR)",
}
for _p, _how in (("hour", "sum"), ("day", "avg"), ("week", "max"), ("month", "stddev"), ("quarter", "count"), ("year", "min")):
    _a = {"sum": "sum(value)", "avg": "avg(value)", "max": "max(value)", "stddev": "coalesce(stddev_samp(value), 0)", "count": "CAST(count(value) AS DOUBLE)", "min": "min(value)"}[_how]
    q(f"t03_by_{_p}", lambda s, d, _p=_p, _how=_how: ts.aggregate_by_time(_events(s, d), "ts", "value", _p, _how, ["event_type"]), f"""
SELECT event_type, {_PERIOD[_p]} AS period, {_a} AS value, count(*) AS n, min(value) AS min_value, max(value) AS max_value, avg(value) AS avg_value, coalesce(stddev_samp(value), 0) AS std_value FROM {SRC.replace(" AS e", "")} AS e GROUP BY event_type, {_PERIOD[_p]}""", "value min_value max_value avg_value std_value")  # fmt: skip
q("t04_growth_rates", lambda s, d: ts.growth_rates(_events(s, d), **KEYS).drop("annualized"), f"""
SELECT {COLS}, o AS previous, (value - o) / nullif(o, 0) * 100 AS growth_pct, CASE WHEN (value - o) / nullif(o, 0) * 100 > 10 THEN 'high' ELSE 'low' END AS category
FROM (SELECT *, lag(value) OVER ({BY}) AS o FROM {SRC}) WHERE o IS NOT NULL""", "value previous growth_pct", 3)  # fmt: skip
_TREND = f"""(SELECT event_type, count(*) AS n, regr_slope(value, i) AS slope, regr_intercept(value, i) AS intercept, corr(value, i) AS correlation
 FROM (SELECT *, row_number() OVER ({BY}) - 1 AS i FROM {SRC}) GROUP BY event_type)"""
q("t06_statistical_trend", lambda s, d: ts.statistical_trend(_events(s, d), **KEYS).drop("p_value"), f"""
SELECT *, correlation * correlation AS r_squared, CASE WHEN slope > 0 THEN 'increasing' WHEN slope < 0 THEN 'decreasing' ELSE 'stable' END AS direction,
 CASE WHEN correlation * correlation > .7 THEN 'strong' WHEN correlation * correlation > .4 THEN 'moderate' ELSE 'weak' END AS strength, correlation * correlation > .5 AS is_significant FROM {_TREND}""", "slope intercept correlation r_squared")  # fmt: skip
q("t07_forecast_linear", lambda s, d: ts.forecast_linear(_events(s, d), **KEYS).drop("lower_bound", "upper_bound"), f"""
SELECT event_type, CAST(h AS INTEGER) AS step, intercept + slope * (n - 1 + h) AS forecast FROM {_TREND}, range(1, 8) AS r(h)""", "forecast")  # fmt: skip
q("t08_classify_trend", lambda s, d: ts.classify_trend(_events(s, d), **KEYS), f"""
SELECT event_type, CASE WHEN slope > 0 THEN 'increasing' WHEN slope < 0 THEN 'decreasing' ELSE 'stable' END AS trend, CASE WHEN correlation * correlation > .7 THEN 'strong' WHEN correlation * correlation > .4 THEN 'moderate' ELSE 'weak' END AS strength,
 slope, correlation * correlation AS r_squared, 1.0::DOUBLE AS consistency, 0.0::DOUBLE AS acceleration, 'monitor' AS recommendation FROM {_TREND}""", "slope r_squared")  # fmt: skip
q("t09_trend_summary", lambda s, d: ts.trend_summary(_events(s, d), **KEYS), f"SELECT event_type, n, slope, intercept, correlation * correlation AS r_squared FROM {_TREND}", "slope intercept r_squared")
q("t10_seasonality", lambda s, d: ts.seasonality(_events(s, d), "ts", "value", ["event_type"]), f"""
SELECT event_type, CAST(month AS INTEGER) AS month, n, s / n AS mean_value, sd AS std_value, lo AS min_value, hi AS max_value, sd / nullif(s / n, 0) AS cv, (s / n) / (sum(s) OVER w / sum(n) OVER w) AS seasonal_index
FROM (SELECT event_type, month(ts) AS month, count(*) AS n, sum(value) AS s, coalesce(stddev_samp(value), 0) AS sd, min(value) AS lo, max(value) AS hi FROM {SRC} GROUP BY ALL) WINDOW w AS (PARTITION BY event_type)""", "mean_value std_value min_value max_value cv seasonal_index")  # fmt: skip
q("t11_cumulative_trend", lambda s, d: ts.cumulative_trend(_events(s, d), **KEYS, op="max"), f"""
SELECT {COLS}, max(value) OVER w AS cumulative, max(value) OVER w / sum(value) OVER (PARTITION BY event_type) * 100 AS pct_of_total FROM {SRC} WINDOW w AS ({BY} ROWS UNBOUNDED PRECEDING)""", "value cumulative pct_of_total")  # fmt: skip
q("t12_cumulative", lambda s, d: ts.cumulative(_events(s, d), **KEYS, op="sum"), f"""
SELECT {COLS}, sum(value) OVER w AS cumulative, sum(value) OVER w / sum(value) OVER (PARTITION BY event_type) * 100 AS pct_of_total FROM {SRC} WINDOW w AS ({BY} ROWS UNBOUNDED PRECEDING)""", "value cumulative pct_of_total", 3)  # fmt: skip
q("t13_difference", lambda s, d: ts.difference(_events(s, d), **KEYS, order=2), f"""
SELECT {COLS}, value - 2 * lag(value, 1) OVER w + lag(value, 2) OVER w AS difference FROM {SRC} WINDOW w AS ({BY})""", "value difference")  # fmt: skip
for _m, _sql in (("simple", "(value - o) / nullif(o, 0) * 100"), ("log", "CASE WHEN o > 0 AND value > 0 THEN ln(value / o) * 100 END")):
    q(f"t14_percent_change_{_m}", lambda s, d, _m=_m: ts.percent_change(_events(s, d), **KEYS, periods=2, method=_m), f"SELECT {COLS}, {_sql} AS percent_change FROM (SELECT *, lag(value, 2) OVER ({BY}) AS o FROM {SRC})", "value percent_change", 3)
q("t15_cdf", lambda s, d: ts.cdf(_events(s, d), "value", ["event_type"]), """
SELECT event_type, value, n, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY value) AS BIGINT) AS n_below, sum(n) OVER (PARTITION BY event_type ORDER BY value) / sum(n) OVER (PARTITION BY event_type) AS cdf
FROM (SELECT event_type, value, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL)""", "value cdf")  # fmt: skip
q("t16_autocorrelation", lambda s, d: ts.autocorrelation(_events(s, d), **KEYS, max_lag=5), f"""
WITH r AS (SELECT *, row_number() OVER ({BY}) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM {SRC})
SELECT a.event_type, CAST(l AS INTEGER) AS lag, corr(a.value, b.value) AS autocorrelation, a.n, 1.96 / sqrt(a.n) AS bound
FROM r a, range(1, 6) AS k(l), r b WHERE b.event_type = a.event_type AND b.rn = a.rn - l GROUP BY a.event_type, l, a.n""", "autocorrelation bound")  # fmt: skip
q("t17_stationarity", lambda s, d: ts.stationarity(_events(s, d), **KEYS), f"""
SELECT event_type, count(*) AS n, regr_slope(value, i) AS slope, avg(value) AS mean_value, var_samp(value) AS variance, abs(regr_slope(value, i)) < 1e-6 AS is_stationary
FROM (SELECT *, row_number() OVER ({BY}) - 1 AS i FROM {SRC}) GROUP BY event_type HAVING count(*) >= 3""", "slope mean_value variance")  # fmt: skip
q("t18_stl", lambda s, d: models.stl(_events(s, d), "ts", "value", 24, ["event_type"]))
q("t19_series_json", lambda s, d: ts.json_to_points(
    _events(s, d).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_list(F.struct("ts", "value"))).alias("a"))
    .select(ts.series_to_json(F.col("a.ts"), F.col("a.value"), F.col("event_type")).alias("p")), "p"),
  "SELECT ts, value, event_type AS grp FROM events WHERE ts IS NOT NULL AND value IS NOT NULL", "value")

# --- anomalies and metrics

_ODD = "CASE WHEN odd THEN CASE WHEN high THEN 'high' ELSE 'low' END ELSE 'none' END AS anomaly_type"
q("a01_anomalies_zscore", lambda s, d: anomaly.detect_anomalies(_events(s, d), "value", ["event_type"]), f"""
SELECT {COLS}, score, odd AS is_anomaly, {_ODD} FROM (SELECT *, (value - m) / nullif(sd, 0) AS score, coalesce(abs((value - m) / nullif(sd, 0)) > 2, false) AS odd, value > m AS high
FROM (SELECT *, avg(value) OVER g AS m, stddev_samp(value) OVER g AS sd FROM {SRC} WINDOW g AS (PARTITION BY event_type)))""", "value score")  # fmt: skip
q("a01_anomalies_iqr", lambda s, d: anomaly.detect_anomalies(_events(s, d), "value", ["event_type"], "iqr"), f"""
SELECT {COLS}, CASE WHEN value > b THEN (value - b) / nullif(b - a, 0) WHEN value < a THEN (value - a) / nullif(b - a, 0) ELSE 0 END AS score, odd AS is_anomaly, {_ODD} FROM (
SELECT *, value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) AS odd, value > b AS high FROM (SELECT *, quantile_cont(value, .25) OVER g AS a, quantile_cont(value, .75) OVER g AS b FROM {SRC} WINDOW g AS (PARTITION BY event_type)))""", "value score")  # fmt: skip
q("a01_anomalies_mad", lambda s, d: anomaly.detect_anomalies(_events(s, d), "value", ["event_type"], "mad", 3.5), f"""
SELECT {COLS}, score, odd AS is_anomaly, {_ODD} FROM (SELECT *, coalesce(abs(score) > 3.5, false) AS odd, value > m AS high FROM (
SELECT *, .6745 * (value - m) / nullif(quantile_cont(abs(value - m), .5) OVER g, 0) AS score FROM (SELECT *, quantile_cont(value, .5) OVER (PARTITION BY event_type) AS m FROM {SRC}) WINDOW g AS (PARTITION BY event_type)))""", "value score")  # fmt: skip
q("a02_correlated_metrics", lambda s, d: anomaly.correlated_metrics(_panel(s, d), "day", "metric", "v", "click", 0.0), f"""
SELECT b.metric, CAST(0 AS INTEGER) AS lag, count(*) AS n, corr(a.v, b.v) AS correlation FROM {PANEL} a JOIN {PANEL} b ON a.day = b.day WHERE a.metric = 'click' AND b.metric <> 'click' GROUP BY b.metric HAVING count(*) >= 3""", "correlation")  # fmt: skip
q("a03_lag_correlation", lambda s, d: anomaly.correlated_metrics(_panel(s, d), "day", "metric", "v", "click", 0.0, 2), f"""
WITH p AS (SELECT * FROM {PANEL}), k AS (SELECT day, v, row_number() OVER (ORDER BY day) AS i FROM p WHERE metric = 'click')
SELECT o.metric, CAST(l AS INTEGER) AS lag, count(*) AS n, corr(k.v, o.v) AS correlation FROM k, range(-2, 3) AS r(l), k AS k2, p AS o
WHERE k2.i = k.i + l AND o.day = k2.day AND o.metric <> 'click' GROUP BY o.metric, l HAVING count(*) >= 3""", "correlation")  # fmt: skip
q("a04_impact_by_dimension", lambda s, d: anomaly.impact_by_dimension(_events(s, d), "value", ["event_type"], F.dayofmonth("ts") <= 15), """
SELECT event_type, n, m AS mean_value, b AS baseline_mean, m - b AS change, (m - b) / sum(abs(m - b)) OVER () AS share FROM (
SELECT event_type, count(*) AS n, avg(value) FILTER (day(ts) > 15) AS m, avg(value) FILTER (day(ts) <= 15) AS b FROM events GROUP BY event_type)""", "mean_value baseline_mean change share")  # fmt: skip
q("a05_explanation_payload", lambda s, d: anomaly.explanation_payload(_panel(s, d), "day", "metric", "v", "click", ["metric"]))
q("a06_top_metrics", lambda s, d: anomaly.top_metrics(_panel(s, d), "day", "metric", "v", 3), f"""
SELECT metric, (l - f) / nullif(abs(f), 0) * 100 AS score FROM (SELECT metric, arg_min(v, day) AS f, arg_max(v, day) AS l FROM {PANEL} GROUP BY metric) ORDER BY abs((l - f) / nullif(abs(f), 0)) DESC, metric LIMIT 3""", "score")  # fmt: skip
q("a07_distribution", lambda s, d: anomaly.distribution(_events(s, d), "value", ["event_type"]), """
SELECT event_type, n, m AS mean_value, med AS median_value, sd AS std_value, m3 / pow(m2, 1.5) AS skew, m4 / (m2 * m2) - 3 AS kurtosis FROM (
SELECT event_type, count(*) AS n, any_value(m) AS m, quantile_cont(value, .5) AS med, stddev_samp(value) AS sd, avg(pow(value - m, 2)) AS m2, avg(pow(value - m, 3)) AS m3, avg(pow(value - m, 4)) AS m4
FROM (SELECT *, avg(value) OVER (PARTITION BY event_type) AS m FROM events) GROUP BY event_type)""", "mean_value median_value std_value skew kurtosis", 3)  # fmt: skip
q("a08_metrics_summary", lambda s, d: anomaly.metrics_summary(_events(s, d), "value", ["event_type"]), """
SELECT event_type, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max, quantile_cont(value, .5) AS median FROM events GROUP BY event_type""", "mean std min max median")  # fmt: skip
