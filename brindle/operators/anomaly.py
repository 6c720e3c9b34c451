"""Outliers, correlated metrics, impact by dimension, and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from brindle.functions.expr import safe_corr, safe_div, sd0
from brindle.operators import frames


def _joined(df: DataFrame, stats: DataFrame, group: list[str]) -> DataFrame:
    """One row of statistics per group beside each row; without groups the single row is broadcast."""
    if not group:
        return df.join(F.broadcast(stats))
    return df.alias("d").join(stats.alias("s"), F.expr(" AND ".join(f"d.`{g}` <=> s.`{g}`" for g in group))).select("d.*", *[f"s.`{c}`" for c in stats.columns if c not in group])


def detect_anomalies(df: DataFrame, value: str, group=(), method: str = "zscore", threshold: float = 2.0) -> DataFrame:
    """score, is_anomaly and anomaly_type ('high', 'low', 'none') by 'zscore', 'iqr' (1.5 ranges beyond the quartiles) or
    'mad' (0.6745 * distance from the median over the median distance)."""
    g, v = list(group), F.col(value).cast("double")
    rows = df.where(F.col(value).isNotNull())
    if method == "iqr":
        q = frames.quantiles(rows, v, g, {"_a": 0.25, "_b": 0.75})
        out = _joined(rows, q, g)
        span = F.col("_b") - F.col("_a")
        score = F.when(v > F.col("_b"), safe_div(v - F.col("_b"), span)).when(v < F.col("_a"), safe_div(v - F.col("_a"), span)).otherwise(0.0)
        odd = (v < F.col("_a") - 1.5 * span) | (v > F.col("_b") + 1.5 * span)
        high = v > F.col("_b")
    elif method == "mad":
        med = frames.quantiles(rows, v, g, {"_a": 0.5})
        near = _joined(rows, med, g)
        mad = frames.quantiles(near, F.abs(v - F.col("_a")), g, {"_b": 0.5})
        out = _joined(near, mad, g)
        score = safe_div((v - F.col("_a")) * 0.6745, "_b")
        odd, high = F.abs(score) > threshold, v > F.col("_a")
    else:
        s = rows.groupBy(*g).agg(F.avg(v).alias("_a"), F.stddev_samp(v).alias("_b"))
        out = _joined(rows, s, g)
        score = safe_div(v - F.col("_a"), "_b")
        odd, high = F.abs(score) > threshold, v > F.col("_a")
    odd = F.coalesce(odd, F.lit(False))
    return out.withColumns({"score": score, "is_anomaly": odd, "anomaly_type": F.when(odd, F.when(high, "high").otherwise("low")).otherwise("none")}).drop("_a", "_b")


def correlated_metrics(panel: DataFrame, date: str, metric: str, value: str, primary: str, least: float = 0.6, max_lag: int = 0) -> DataFrame:
    """Metrics whose values by date correlate with the primary one: (metric, lag, n, correlation), |r| >= least.

    ``lag`` steps over the dates of the primary from -max_lag to max_lag; with 0 only the same date. Needs three common
    dates; constant metrics have no row. The panel has one value per (date, metric).
    """
    p = panel.where(F.col(value).isNotNull())
    days = p.where(F.col(metric) == primary).select(F.col(date).alias("_d"), F.col(value).cast("double").alias("_p"))
    days = frames.number_rows(days, [], ["_d"], "_i") if days.count() > frames.BLOCK_ROWS else days.withColumn("_i", F.row_number().over(Window.partitionBy().orderBy("_d")).cast("long"))
    spread = days.withColumn("lag", F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag)))).withColumn("_j", F.col("_i") + F.col("lag"))
    others = p.where(F.col(metric) != primary).select(F.col(date).alias("_d"), F.col(metric).alias("metric"), F.col(value).cast("double").alias("_v"))
    at = others.join(days.select("_d", F.col("_i").alias("_j")), "_d")
    r = at.join(spread.select("_j", "lag", "_p"), "_j").groupBy("metric", "lag").agg(F.count("*").alias("n"), safe_corr("_p", "_v").alias("r"))
    return r.where((F.col("n") >= 3) & (F.abs("r") >= least)).select("metric", "lag", "n", F.round("r", 4).alias("correlation"))


def impact_by_dimension(df: DataFrame, value: str, dims: list[str], is_baseline=None) -> DataFrame:
    """Mean per segment; with a baseline condition also its mean, the change and the segment's share of all change."""
    v = F.col(value).cast("double")
    if is_baseline is None:
        return df.groupBy(*dims).agg(F.count("*").alias("n"), F.avg(v).alias("mean_value"))
    now = F.when(~is_baseline, v)
    t = df.groupBy(*dims).agg(F.count("*").alias("n"), F.avg(now).alias("mean_value"), F.avg(F.when(is_baseline, v)).alias("baseline_mean"))
    t = t.withColumn("change", F.col("mean_value") - F.col("baseline_mean"))
    return t.withColumn("share", safe_div("change", F.sum(F.abs("change")).over(Window.partitionBy())))  # one row a segment


def top_metrics(panel: DataFrame, date: str, metric: str, value: str, n: int = 5, by: str = "growth") -> DataFrame:
    """The ``n`` metrics of largest |growth from first to last| in per cent, or of largest population deviation."""
    v = F.col(value).cast("double")
    first, last = F.min_by(v, F.col(date)), F.max_by(v, F.col(date))
    score = safe_div(last - first, F.abs(first)) * 100 if by == "growth" else F.stddev_pop(v)
    t = panel.where(F.col(value).isNotNull()).groupBy(F.col(metric).alias("metric")).agg(score.alias("score"))
    return t.where("score IS NOT NULL").orderBy(F.abs("score").desc(), "metric").limit(n)


def distribution(df: DataFrame, value: str, group=()) -> DataFrame:
    v, g, rows = F.col(value).cast("double"), list(group), df.where(F.col(value).isNotNull())
    s = rows.groupBy(*g).agg(
        F.count("*").alias("n"), F.avg(v).alias("mean_value"), sd0(F.stddev_samp(v)).alias("std_value"),
        F.when(F.count("*") > 2, F.skewness(v)).otherwise(0.0).alias("skew"), F.kurtosis(v).alias("kurtosis"),
    )
    return _joined(s, frames.quantiles(rows, v, g, {"median_value": 0.5}), g).select(*g, "n", "mean_value", "median_value", "std_value", "skew", "kurtosis")


def metrics_summary(df: DataFrame, value: str, group=()) -> DataFrame:
    v, g, rows = F.col(value).cast("double"), list(group), df.where(F.col(value).isNotNull())
    r = lambda c, n: F.round(c, 6).alias(n)
    s = rows.groupBy(*g).agg(F.count("*").alias("n"), r(F.avg(v), "mean"), r(F.stddev_samp(v), "std"), r(F.min(v), "min"), r(F.max(v), "max"))
    return _joined(s, frames.quantiles(rows, v, g, {"_m": 0.5}), g).withColumn("median", F.round("_m", 6)).drop("_m")


def explanation_payload(panel: DataFrame, date: str, metric: str, value: str, primary: str, dims: list[str]) -> DataFrame:
    """One JSON document: correlated metrics, means by segment of the primary metric, and an empty list of leading indicators."""
    c = correlated_metrics(panel, date, metric, value, primary).agg(F.sort_array(F.collect_list(F.struct("metric", "correlation"))).alias("correlated_metrics"))
    i = impact_by_dimension(panel.where(F.col(metric) == primary), value, dims).agg(F.sort_array(F.collect_list(F.struct(*dims, F.round("mean_value", 6).alias("mean_value")))).alias("impact"))
    return c.join(i).select(F.to_json(F.struct("correlated_metrics", "impact", F.array().cast("array<string>").alias("leading_indicators"))).alias("payload"))
