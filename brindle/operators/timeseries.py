"""Lags, growth, buckets, trends, forecasts and distributions over columns (ts, value, optional groups).

Rows with a null time or value are dropped first; undefined ratios are null. Order is (ts, tie).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from brindle.functions.expr import aggregate, bucket_key, pct, safe_corr, safe_div, sd0
from brindle.operators import frames
from brindle.operators.windows import _clean, _with_total


def _shifted(df, ts, value, group, tie, k: int):
    df = _clean(df, ts, value)
    f = frames.rolling(df, list(group), [ts, *tie], max(0, k), max(0, -k))
    v = F.col(value).cast("double")
    return f, v, F.lag(v, k).over(f.order)


def lag(df: DataFrame, ts: str, value: str, group=(), tie=(), k: int = 1) -> DataFrame:
    """lagged, change and change_pct against the value ``k`` rows earlier."""
    f, v, old = _shifted(df, ts, value, group, tie, k)
    out = f.df.withColumn("lagged", old)
    return f.done(out.withColumns({"change": v - F.col("lagged"), "change_pct": pct(v - F.col("lagged"), "lagged")}))


def lead(df: DataFrame, ts: str, value: str, group=(), tie=(), k: int = 1) -> DataFrame:
    f, v, new = _shifted(df, ts, value, group, tie, -k)
    out = f.df.withColumn("led", new)
    return f.done(out.withColumns({"change": F.col("led") - v, "change_pct": pct(F.col("led") - v, v)}))


def aggregate_by_time(df: DataFrame, ts: str, value: str, period: str = "day", how: str = "sum", group=()) -> DataFrame:
    """Text bucket with the named aggregate and count, min, max, mean and deviation (0 for one row)."""
    v = F.col(value).cast("double")
    return _clean(df, ts, value).groupBy(*group, bucket_key(ts, period).alias("period")).agg(
        aggregate(how, v).cast("double").alias("value"), F.count("*").alias("n"), F.min(v).alias("min_value"), F.max(v).alias("max_value"),
        F.avg(v).alias("avg_value"), sd0(F.stddev_samp(v)).alias("std_value"),
    )


def growth_rates(df: DataFrame, ts: str, value: str, group=(), tie=()) -> DataFrame:
    """Growth in per cent from the second row on, 'high' above 10."""
    f, v, old = _shifted(df, ts, value, group, tie, 1)
    out = f.df.withColumn("previous", old).withColumn("growth_pct", pct(v - F.col("previous"), "previous"))
    out = f.done(out).where("previous IS NOT NULL")
    return out.withColumns({"annualized": F.lit(None).cast("double"), "category": F.when(F.col("growth_pct") > 10, "high").otherwise("low")})


compare_periods = growth_rates


def _indexed(df: DataFrame, ts: str, value: str, group: list[str], tie) -> DataFrame:
    """Rows with ``i``: 0, 1, ... within the group."""
    df = _clean(df, ts, value)
    if frames.largest_group(df, group) > frames.BLOCK_ROWS:
        return frames.number_rows(df, group, [ts, *tie], "i").withColumn("i", F.col("i") - 1)
    return df.withColumn("i", F.row_number().over(Window.partitionBy(*group).orderBy(ts, *tie)).cast("long") - 1)


def statistical_trend(df: DataFrame, ts: str, value: str, group=(), tie=()) -> DataFrame:
    """Least squares of the value on its index 0..n-1 per group."""
    v, i = F.col(value).cast("double"), F.col("i").cast("double")
    t = _indexed(df, ts, value, list(group), tie).groupBy(*group).agg(
        F.count("*").alias("n"), F.regr_slope(v, i).alias("slope"), F.regr_intercept(v, i).alias("intercept"), safe_corr(v, i).alias("correlation"),
        F.var_pop(v).alias("_var"), F.avg(v).alias("_mean"),
    )
    slope = F.coalesce("slope", F.lit(0.0))
    r2 = F.coalesce(F.col("correlation") * F.col("correlation"), F.lit(0.0))
    return t.select(
        *group, "n", slope.alias("slope"), F.coalesce("intercept", "_mean").alias("intercept"), r2.alias("r_squared"), "correlation",
        F.when(slope > 0, "increasing").when(slope < 0, "decreasing").otherwise("stable").alias("direction"),
        F.when(r2 > 0.7, "strong").when(r2 > 0.4, "moderate").otherwise("weak").alias("strength"),
        (r2 > 0.5).alias("is_significant"), F.lit(None).cast("double").alias("p_value"),
    )


def classify_trend(df: DataFrame, ts: str, value: str, group=(), tie=()) -> DataFrame:
    return statistical_trend(df, ts, value, group, tie).select(
        *group, F.col("direction").alias("trend"), "strength", "slope", "r_squared", F.lit(1.0).alias("consistency"), F.lit(0.0).alias("acceleration"), F.lit("monitor").alias("recommendation")
    )


def forecast_linear(df: DataFrame, ts: str, value: str, group=(), tie=(), horizon: int = 7) -> DataFrame:
    """The trend's line continued by 1..horizon steps; bounds are null."""
    t = statistical_trend(df, ts, value, group, tie)
    step = t.select(*group, "slope", "intercept", "n", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    none = F.lit(None).cast("double")
    return step.select(*group, "step", (F.col("intercept") + F.col("slope") * (F.col("n") - 1 + F.col("step"))).alias("forecast"), none.alias("lower_bound"), none.alias("upper_bound"))


def trend_summary(df: DataFrame, ts: str, value: str, group=(), tie=()) -> DataFrame:
    """Slope, intercept and r squared, rounded to 8, 8 and 6 digits."""
    t = statistical_trend(df, ts, value, group, tie)
    return t.select(*group, "n", F.round("slope", 8).alias("slope"), F.round("intercept", 8).alias("intercept"), F.round("r_squared", 6).alias("r_squared"))


def seasonality(df: DataFrame, ts: str, value: str, group=()) -> DataFrame:
    """Per calendar month: mean, deviation, range, variation and the index of the month's mean against all rows' mean."""
    v = F.col(value).cast("double")
    s = _clean(df, ts, value).groupBy(*group, F.month(ts).alias("month")).agg(
        F.count("*").alias("n"), F.avg(v).alias("mean_value"), sd0(F.stddev_samp(v)).alias("std_value"), F.min(v).alias("min_value"), F.max(v).alias("max_value"), F.sum(v).alias("_s")
    )
    w = Window.partitionBy(*group)  # twelve rows a group
    overall = safe_div(F.sum("_s").over(w), F.sum("n").over(w))
    return s.withColumns({"cv": safe_div("std_value", "mean_value"), "seasonal_index": safe_div(F.col("mean_value"), overall)}).drop("_s")


def cumulative_trend(df: DataFrame, ts: str, value: str, group=(), tie=(), op: str = "sum") -> DataFrame:
    return cumulative(df, ts, value, group, tie, op if op in ("sum", "max") else "sum")


def cumulative(df: DataFrame, ts: str, value: str, group=(), tie=(), op: str = "sum") -> DataFrame:
    """Running sum, product, max or min, and it as per cent of the group's total sum."""
    df, v = _clean(df, ts, value), F.col(value).cast("double")
    out = frames.cumulative(df, list(group), [ts, *tie], {"cumulative": (op, v)})
    return _with_total(out, df, list(group), v).withColumn("pct_of_total", pct("cumulative", "_total")).drop("_total")


def difference(df: DataFrame, ts: str, value: str, group=(), tie=(), order: int = 1) -> DataFrame:
    """First or second difference; null where rows before are missing."""
    f, v, one = _shifted(df, ts, value, group, tie, 1 if order == 1 else 2)
    d = v - one if order == 1 else v - 2 * F.lag(v, 1).over(f.order) + one
    return f.done(f.df.withColumn("difference", d))


def percent_change(df: DataFrame, ts: str, value: str, group=(), tie=(), periods: int = 1, method: str = "simple") -> DataFrame:
    """Change over ``periods`` rows: simple in per cent, or log (null unless both values are positive)."""
    f, v, old = _shifted(df, ts, value, group, tie, periods)
    out = f.df.withColumn("_old", old)
    o = F.col("_old")
    c = F.when((o > 0) & (v > 0), F.ln(safe_div(v, o)) * 100) if method == "log" else pct(v - o, o)
    return f.done(out.withColumn("percent_change", c)).drop("_old")


def cdf(df: DataFrame, value: str, group=()) -> DataFrame:
    """Each distinct value with its rows, the rows up to it and their share. Counts are by value, so ties and heavy
    values are one row before anything is ordered."""
    g = list(group)
    counts = df.where(F.col(value).isNotNull()).groupBy(*g, F.col(value).cast("double").alias("value")).agg(F.count("*").alias("n"))
    run = frames.cumulative(counts, g, ["value"], {"n_below": ("sum", F.col("n"))})
    return _with_total(run, counts, g, F.col("n")).select(*g, "value", "n", "n_below", safe_div("n_below", "_total").alias("cdf"))


def autocorrelation(df: DataFrame, ts: str, value: str, group=(), tie=(), max_lag: int = 10) -> DataFrame:
    """Pearson of the series and itself 1..max_lag rows later, and the bound 1.96 / sqrt(n)."""
    f = frames.rolling(_clean(df, ts, value), list(group), [ts, *tie], max_lag)
    v = F.col(value).cast("double")
    lags = F.array(*[F.struct(F.lit(k).alias("lag"), F.lag(v, k).over(f.order).alias("old")) for k in range(1, max_lag + 1)])
    wide = f.done(f.df.select("*", lags.alias("_lags")))
    sizes = _clean(df, ts, value).groupBy(*group).agg(F.count("*").alias("n")) if group else _clean(df, ts, value).agg(F.count("*").alias("n"))
    long = wide.select(*group, v.alias("v"), F.inline("_lags"))
    r = long.groupBy(*group, "lag").agg(F.when(F.count("old") >= 2, safe_corr("v", "old")).alias("autocorrelation"))
    both = r.join(sizes, list(group)) if group else r.join(F.broadcast(sizes))
    return both.withColumn("bound", F.lit(1.96) / F.sqrt("n"))


def stationarity(df: DataFrame, ts: str, value: str, group=(), tie=()) -> DataFrame:
    """Whether the trend is flat (|slope| < 1e-6) for groups of three rows or more; mean and variance."""
    v, i = F.col(value).cast("double"), F.col("i").cast("double")
    t = _indexed(df, ts, value, list(group), tie).groupBy(*group).agg(F.count("*").alias("n"), F.regr_slope(v, i).alias("slope"), F.avg(v).alias("mean_value"), F.var_samp(v).alias("variance"))
    return t.where("n >= 3").withColumn("is_stationary", F.abs("slope") < 1e-6)


def series_to_json(times: Column, values: Column, group: Column | None = None) -> Column:
    """JSON points of two parallel arrays; null values are skipped."""
    pairs = F.filter(F.arrays_zip(times.alias("time"), values.alias("value")), lambda p: p["value"].isNotNull())
    point = lambda p: F.struct(p["time"].cast("string").alias("time"), p["value"].cast("double").alias("value"), *([group.alias("group")] if group is not None else []))
    return F.to_json(F.transform(pairs, point))


def json_to_points(df: DataFrame, payload: str, keep=()) -> DataFrame:
    """Rows (ts, value, grp) of a JSON array of points; a point's value may be called metric and its group grp. Points
    whose time or value does not parse are dropped."""
    kind = "array<struct<time: string, value: string, metric: string, `group`: string, grp: string>>"
    p = df.select(*keep, F.inline(F.from_json(F.col(payload), kind)))
    ts = F.expr("try_cast(time AS timestamp_ntz)")
    value = F.expr("try_cast(coalesce(value, metric) AS double)")
    return p.select(*keep, ts.alias("ts"), value.alias("value"), F.coalesce("group", "grp", F.lit("default")).alias("grp")).where("ts IS NOT NULL AND value IS NOT NULL")


def detrend(df: DataFrame, ts: str, value: str, group=(), tie=()) -> DataFrame:
    """Adds ``trend`` (the least-squares line over the place in order) and ``detrended``. Rows without a time or value are left
    out; a group of one row, or of one value, has that value as its trend."""
    g = list(group)
    rows = frames.number_rows(df.where(F.col(ts).isNotNull() & F.col(value).isNotNull()), g, [ts, *tie], "_i")
    v, i = F.col(value).cast("double"), F.col("_i").cast("double")
    fit = rows.groupBy(*g).agg(F.coalesce(safe_div(F.covar_pop(i, v), F.var_pop(i)), F.lit(0.0)).alias("_b"), F.avg(v).alias("_m"), F.avg(i).alias("_mi"))
    on = F.expr(" AND ".join(f"a.`{c}` <=> b.`{c}`" for c in g) or "true")
    out = rows.alias("a").join(F.broadcast(fit).alias("b") if not g else fit.alias("b"), on).select("a.*", "b._b", "b._m", "b._mi")
    out = out.withColumn("trend", F.col("_m") + F.col("_b") * (i - F.col("_mi")))
    return out.withColumn("detrended", v - F.col("trend")).drop("_i", "_b", "_m", "_mi")
