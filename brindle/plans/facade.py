"""Operators by name: over columns, and over JSON series for small payloads."""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from brindle.operators import anomaly, experiment, product, timeseries as ts, windows as w

_SERIES: dict[str, Callable[..., DataFrame]] = {
    "calculate_sma": w.sma, "calculate_wma": w.wma, "calculate_moving_variance": w.moving_variance, "calculate_moving_quantiles": w.moving_quantiles,
    "calculate_moving_minmax": w.moving_minmax, "calculate_moving_sum": w.moving_sum, "calculate_expanding_window": w.expanding, "calculate_cumulative_operations": w.cumulative_all,
    "calculate_time_weighted_ma": w.time_weighted_ma, "calculate_bollinger_bands": w.bollinger, "calculate_moving_rank": w.moving_rank, "calculate_ema": w.ema,
    "calculate_moving_average": w.moving_average, "calculate_rolling_window": w.rolling, "calculate_volatility": w.volatility, "analyze_variance": w.moving_variance,
    "calculate_lag": ts.lag, "calculate_lead": ts.lead, "aggregate_by_time": ts.aggregate_by_time, "calculate_growth_rates": ts.growth_rates, "compare_periods": ts.compare_periods,
    "calculate_statistical_trend": ts.statistical_trend, "forecast_linear": ts.forecast_linear, "classify_trend": ts.classify_trend, "ml_trend_linear": ts.trend_summary, "detect_seasonality": ts.seasonality,
    "calculate_cumulative_trend": ts.cumulative_trend, "calculate_cumulative": ts.cumulative, "calculate_difference": ts.difference, "calculate_percent_change": ts.percent_change,
    "calculate_autocorrelation": ts.autocorrelation, "test_stationarity": ts.stationarity,
}
_VALUES: dict[str, Callable[..., DataFrame]] = {
    "calculate_cdf": ts.cdf, "detect_anomalies": anomaly.detect_anomalies, "analyze_distribution": anomaly.distribution, "ml_metrics_summary": anomaly.metrics_summary, "calculate_bootstrap_ci": experiment.bootstrap_ci,
}
_TABLES: dict[str, Callable[..., DataFrame]] = {
    "calculate_moving_correlation": w.moving_correlation, "find_correlated_metrics": anomaly.correlated_metrics, "calculate_lag_correlation": anomaly.correlated_metrics, "decompose_impact_by_dimension": anomaly.impact_by_dimension,
    "build_anomaly_explanation_payload": anomaly.explanation_payload, "get_top_metrics": anomaly.top_metrics, "calculate_percent_change_comparison": experiment.change_comparison,
    "calculate_absolute_change_comparison": experiment.change_comparison, "calculate_prepost_comparison": experiment.prepost, "calculate_stratified_analysis": experiment.stratified,
    "calculate_sequential_analysis": experiment.sequential, "calculate_cuped_adjustment": experiment.cuped, "calculate_effect_sizes": experiment.effect_sizes, "adjust_pvalues_bonferroni": experiment.bonferroni,
    "ml_funnel": product.funnel, "ml_cohort_retention": product.cohort_matrix, "ml_segment_kmeans": product.segments,
}


def names() -> list[str]:
    return sorted([*_SERIES, *_VALUES, *_TABLES, "calculate_power_analysis"])


def invoke(name: str, df: DataFrame, **params) -> DataFrame:
    """Calls the named operator on a DataFrame; an unknown name is a KeyError."""
    for group in (_SERIES, _VALUES, _TABLES):
        if name in group:
            return group[name](df, **params)
    if name == "calculate_power_analysis":
        return df.withColumn("n_per_arm", experiment.power_analysis(F.col(params["effect"]), F.col(params["sd"]), params.get("alpha", 0.05), params.get("power", 0.8)))
    raise KeyError(name)


def _columns(fn: Callable[..., DataFrame], params: dict) -> dict:
    """Texts for parameters that are conditions become expressions."""
    return {k: F.expr(v) if isinstance(v, str) and "Column" in str(inspect.signature(fn).parameters[k].annotation) else v for k, v in params.items() if k in inspect.signature(fn).parameters}


def invoke_json(spark: SparkSession, name: str, payload: str) -> str:
    """An operator on one JSON payload. Series and value operators take {"p_data": [points], "p_group_by": ..., parameters},
    table operators {"p_table": a view's name} or {"p_rows": [objects], "p_schema": optional}, and their parameters; those
    that are conditions are SQL text. The result is a JSON array of rows; an unknown name or a failure is
    {"error": ...}. For small results and payloads: they live on the driver."""
    fn = _SERIES.get(name) or _VALUES.get(name) or _TABLES.get(name)
    if fn is None and name != "calculate_power_analysis":
        return json.dumps({"error": "unknown_function", "name": name})
    try:
        args = json.loads(payload)
        if name in _SERIES or name in _VALUES:
            data = args.pop("p_data")
            text = data if isinstance(data, str) else json.dumps(data)
            rows = ts.json_to_points(spark.createDataFrame([(text,)], "p string"), "p")
            group = ["grp"] if args.pop("p_group_by", None) else []
            kw = {k.removeprefix("p_"): v for k, v in args.items()} | {"value": "value", "group": group}
            out = fn(rows, **kw) if name in _VALUES else fn(rows, ts="ts", **kw)
        else:
            view, given, schema = (args.pop(k, None) for k in ("p_table", "p_rows", "p_schema"))
            rows = spark.table(view) if view else spark.createDataFrame(given, schema)
            kw = {k.removeprefix("p_"): v for k, v in args.items()}
            out = invoke(name, rows, **(kw if fn is None else _columns(fn, kw)))
        return "[" + ",".join(r[0] for r in out.select(F.to_json(F.struct("*"))).collect()) + "]"
    except Exception as e:  # the contract of this surface: errors are values
        return json.dumps({"error": type(e).__name__, "message": str(e)[:500]})
