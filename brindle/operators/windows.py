"""Moving-window statistics over columns (ts, value, optional groups).

Every function takes the frame's rows from the row's own group, in the order (ts, tie), and returns the input's columns with
new ones. Rows with a null time or value are dropped first. Undefined ratios are null. The standard deviation of a
single row is 0 in ``sma``, ``bollinger``, ``rolling`` and ``volatility``, and null in ``moving_variance``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from brindle.functions.expr import pct, safe_corr, safe_div, sd0, strength
from brindle.operators import frames
from brindle.session import Stage


def _clean(df: DataFrame, ts: str, *values: str) -> DataFrame:
    return df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (ts, *values)))


def _width(w: int) -> int:
    if w < 1:
        raise ValueError("a window has at least one row")
    return w


def _roll(df, ts, value, group, tie, w):
    df = _clean(df, ts, value)
    return frames.rolling(df, list(group), [ts, *tie], _width(w) - 1), F.col(value).cast("double")


def sma(df: DataFrame, ts: str, value: str, group=(), tie=(), w: int = 7, k: float = 2.0) -> DataFrame:
    """sma, deviation, deviation_pct, and bands at ``k`` standard deviations."""
    f, v = _roll(df, ts, value, group, tie, w)
    out = f.df.select("*", F.avg(v).over(f.window).alias("sma"), sd0(F.stddev_samp(v).over(f.window)).alias("_sd"))
    m, s = F.col("sma"), F.col("_sd")
    out = out.withColumns({"deviation": v - m, "deviation_pct": pct(v - m, m), "upper_band": m + k * s, "lower_band": m - k * s})
    return f.done(out).drop("_sd")


def wma(df: DataFrame, ts: str, value: str, group=(), tie=(), w: int = 7) -> DataFrame:
    """Weighted mean whose weights are row numbers over all groups together; the frame is the last ``w`` numbers, less
    the rows of other groups."""
    df, g = _clean(df, ts, value), list(group)
    order, w = [ts, *g, *tie], _width(w)
    v = F.col(value).cast("double")
    block = frames.BLOCK_ROWS
    if df.count() <= block:
        rn = df.withColumn("rn", F.row_number().over(Window.partitionBy().orderBy(*order)).cast("long"))
        spread, by = rn.withColumn("_own", F.lit(True)), g
    else:
        rn = frames.number_rows(df, [], order, "rn")
        home = F.floor(F.col("rn") / block)
        spread = rn.withColumn("_block", F.explode(F.sequence(home, F.floor((F.col("rn") + w - 1) / block)))).withColumn("_own", F.col("_block") == home)
        by = [*g, "_block"]
    win = Window.partitionBy(*by).orderBy("rn").rangeBetween(-(w - 1), 0)
    out = spread.withColumn("wma", safe_div(F.sum(v * F.col("rn")).over(win), F.sum("rn").over(win)))
    return out.where("_own").withColumn("deviation", v - F.col("wma")).drop("_own", "_block")


def moving_variance(df: DataFrame, ts: str, value: str, group=(), tie=(), w: int = 7) -> DataFrame:
    f, v = _roll(df, ts, value, group, tie, w)
    out = f.df.select("*", F.avg(v).over(f.window).alias("moving_mean"), F.var_samp(v).over(f.window).alias("variance"), F.stddev_samp(v).over(f.window).alias("std_dev"))
    m, s = F.col("moving_mean"), F.col("std_dev")
    return f.done(out.withColumns({"cv": pct(s, F.abs(m)), "z_score": safe_div(v - m, s)}))


def moving_quantiles(df: DataFrame, ts: str, value: str, group=(), tie=(), w: int = 7, q=(0.25, 0.5, 0.75)) -> DataFrame:
    """Linearly interpolated quantiles of the frame; fewer than three give the quartiles."""
    q = tuple(q) if len(q) >= 3 else (0.25, 0.5, 0.75)
    f, v = _roll(df, ts, value, group, tie, w)
    out = f.df.withColumn("_q", F.percentile(v, F.array(*[F.lit(float(x)) for x in q[:3]])).over(f.window))
    out = out.withColumns({"q_low": F.col("_q")[0], "q_mid": F.col("_q")[1], "q_high": F.col("_q")[2], "iqr": F.col("_q")[2] - F.col("_q")[0]})
    return f.done(out).drop("_q")


def moving_minmax(df: DataFrame, ts: str, value: str, group=(), tie=(), w: int = 7) -> DataFrame:
    f, v = _roll(df, ts, value, group, tie, w)
    out = f.df.select("*", F.min(v).over(f.window).alias("moving_min"), F.max(v).over(f.window).alias("moving_max"))
    r = F.col("moving_max") - F.col("moving_min")
    return f.done(out.withColumns({"moving_range": r, "position": F.coalesce(safe_div(v - F.col("moving_min"), r), F.lit(0.5))}))


def moving_correlation(df: DataFrame, ts: str, x: str, y: str, group=(), tie=(), w: int = 7) -> DataFrame:
    """Pearson correlation over the frame; null below two rows or for a constant side."""
    f = frames.rolling(_clean(df, ts, x, y), list(group), [ts, *tie], _width(w) - 1)
    out = f.df.withColumn("correlation", F.when(F.count("*").over(f.window) >= 2, safe_corr(x, y, f.window)))
    return f.done(out.withColumn("strength", F.when(F.col("correlation").isNotNull(), strength(F.col("correlation")))))


def moving_sum(df: DataFrame, ts: str, value: str, group=(), tie=(), w: int = 7) -> DataFrame:
    f, v = _roll(df, ts, value, group, tie, w)
    out = f.df.withColumn("moving_sum", F.sum(v).over(f.window))
    return f.done(out.withColumn("contribution_pct", pct(v, "moving_sum")))


def expanding(df: DataFrame, ts: str, value: str, group=(), tie=(), op: str = "mean") -> DataFrame:
    """Running sum, mean, std, min, max or count from the group's first row, and the rows so far."""
    df, v = _clean(df, ts, value), F.col(value).cast("double")
    # squares of distances from the grand mean keep the running variance well-conditioned
    centre = (df.agg(F.avg(value)).first()[0] or 0.0) if op == "std" else 0.0
    d = v - F.lit(centre)
    out = frames.cumulative(df, list(group), [ts, *tie], {
        "window_size": ("count", v), "_s": ("sum", v), "_min": ("min", v), "_max": ("max", v), "_d": ("sum", d), "_dd": ("sum", d * d),
    })
    n = F.col("window_size")
    var = F.when(n > 1, F.greatest(F.lit(0.0), (F.col("_dd") - F.col("_d") * F.col("_d") / n)) / (n - 1))
    value_of = {"sum": F.col("_s"), "min": F.col("_min"), "max": F.col("_max"), "count": n.cast("double"), "std": F.sqrt(var)}
    return out.withColumn("expanding", value_of.get(op, safe_div("_s", n))).drop("_s", "_min", "_max", "_d", "_dd")


def cumulative_all(df: DataFrame, ts: str, value: str, group=(), tie=()) -> DataFrame:
    """Running sum, product, max and min, and the running sum as per cent of the group's total."""
    df, v = _clean(df, ts, value), F.col(value).cast("double")
    out = frames.cumulative(df, list(group), [ts, *tie], {"cumsum": ("sum", v), "cumproduct": ("product", v), "cummax": ("max", v), "cummin": ("min", v)})
    return _with_total(out, df, list(group), v).withColumn("pct_of_total", pct("cumsum", "_total")).drop("_total")


def _with_total(out: DataFrame, df: DataFrame, group: list[str], v: Column) -> DataFrame:
    """The total of each group beside its rows: one row a group, joined rather than windowed."""
    if not group:
        return out.withColumn("_total", F.lit(df.agg(F.sum(v)).first()[0]).cast("double"))
    totals = df.groupBy(*group).agg(F.sum(v).alias("_total")).alias("t")
    return out.alias("o").join(totals, F.expr(" AND ".join(f"o.`{g}` <=> t.`{g}`" for g in group))).select("o.*", "t._total")


def time_weighted_ma(df: DataFrame, ts: str, value: str, group=(), tie=(), w: int = 30, decay: float = 0.1) -> DataFrame:
    """Mean weighted by e^(-decay * age), age in rows."""
    f, v = _roll(df, ts, value, group, tie, w)
    near = F.reverse(F.collect_list(v).over(f.window))
    weights = F.transform(near, lambda x, i: F.exp(-F.lit(decay) * i))
    total = F.aggregate(F.zip_with(near, weights, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return f.done(f.df.withColumn("twma", safe_div(total, F.aggregate(weights, F.lit(0.0), lambda a, b: a + b))))


def bollinger(df: DataFrame, ts: str, value: str, group=(), tie=(), w: int = 20, k: float = 2.0) -> DataFrame:
    f, v = _roll(df, ts, value, group, tie, w)
    out = f.df.select("*", F.avg(v).over(f.window).alias("middle"), sd0(F.stddev_samp(v).over(f.window)).alias("_sd"))
    m, s = F.col("middle"), F.col("_sd")
    out = out.withColumns({"upper": m + k * s, "lower": m - k * s})
    width = F.col("upper") - F.col("lower")
    return f.done(out.withColumns({"bandwidth": safe_div(width, m), "percent_b": F.when(width != 0, safe_div(v - F.col("lower"), width))})).drop("_sd")


def moving_rank(df: DataFrame, ts: str, value: str, group=(), tie=(), w: int = 7) -> DataFrame:
    """Rank from the top within the frame, percentile of lower values, and whether the row is its highest or lowest."""
    f, v = _roll(df, ts, value, group, tie, w)
    out = f.df.withColumn("_l", F.collect_list(v).over(f.window)).withColumn("_v", v)
    n = F.size("_l")
    out = out.withColumns({
        "moving_rank": (F.size(F.filter("_l", lambda x: x > F.col("_v"))) + 1).cast("long"),
        "percentile": F.when(n > 1, safe_div(F.size(F.filter("_l", lambda x: x < F.col("_v"))), n - 1) * 100).otherwise(0.0),
        "is_highest": F.abs(F.array_max("_l") - F.col("_v")) < 1e-12,
        "is_lowest": F.abs(F.array_min("_l") - F.col("_v")) < 1e-12,
    })
    return f.done(out).drop("_l", "_v")


def ema(df: DataFrame, ts: str, value: str, group=(), tie=(), alpha: float = 0.3) -> DataFrame:
    """e = alpha * v + (1 - alpha) * e before it, from the group's first value; and the deviation from it.

    The recursion is linear, so a large group runs in blocks: each block's own part, then what the blocks before leave,
    faded by (1 - alpha) a row.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha lies in (0, 1]")
    df, g, block = _clean(df, ts, value), list(group), frames.BLOCK_ROWS
    big = frames.largest_group(df, g) > block
    rows = frames.number_rows(df, g, [ts, *tie], "_rn").withColumn("_block", F.floor((F.col("_rn") - 1) / block)) if big else df.withColumn("_block", F.lit(0).cast("long"))
    order = ["_rn"] if big else [ts, *tie]
    rows = rows.withColumn("_v", F.col(value).cast("double"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", ema double, _i bigint"

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(order, kind="stable")
        v, e = p["_v"].to_numpy(), np.empty(len(p))
        first = int(p["_block"].iloc[0]) == 0
        at = v[0] if first else 0.0
        for i, x in enumerate(v):
            at = x if first and i == 0 else alpha * x + (1 - alpha) * at
            e[i] = at
        return p.assign(ema=e, _i=np.arange(1, len(p) + 1))

    out = rows.groupBy(*g, "_block").applyInPandas(run, schema)
    if big:
        out = Stage(df.sparkSession, "ema").put(out)
        ends = out.groupBy(*g, "_block").agg(F.max_by("ema", "_i").alias("_e"), F.max("_i").alias("_n"))
        # blocks are few: their carry is a fold over (end, length) in order
        prior = Window.partitionBy(*g).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        told = F.aggregate(F.collect_list(F.struct("_e", "_n")).over(prior), F.lit(0.0), lambda a, s: s["_e"] + a * F.pow(F.lit(1 - alpha), s["_n"]))
        carry = ends.select(*g, "_block", told.alias("_c")).alias("c")
        on = F.expr(" AND ".join(f"o.`{c}` <=> c.`{c}`" for c in [*g, "_block"]))
        out = out.alias("o").join(carry, on).select("o.*", "c._c").withColumn("ema", F.col("ema") + F.col("_c") * F.pow(F.lit(1 - alpha), F.col("_i")))
    return out.withColumn("deviation", F.col("_v") - F.col("ema")).drop("_block", "_v", "_i", "_rn", "_c")


def ema_list(values: Column, alpha: float = 0.3) -> Column:
    """Exponential moving average of an array column; nulls inside are an error of the caller's, an empty array stays."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in batches:
            out = []
            for v in lists:
                e: list[float] = []
                for x in v if v is not None else ():
                    e.append(float(x) if not e else alpha * float(x) + (1 - alpha) * e[-1])
                out.append(None if v is None else e)
            yield pd.Series(out, dtype=object)

    return run(values)


def rolling(df: DataFrame, ts: str, value: str, group=(), tie=(), w: int = 7, op: str = "mean") -> DataFrame:
    """A named aggregate over the frame, the deviation from it and that in per cent."""
    f, v = _roll(df, ts, value, group, tie, w)
    named = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "std": F.stddev_samp}
    a = named.get(op, F.avg)(v).over(f.window).cast("double")
    out = f.df.withColumn("rolling", sd0(a) if op == "std" else a)
    return f.done(out.withColumns({"deviation": v - F.col("rolling"), "deviation_pct": pct(v - F.col("rolling"), "rolling")}))


def volatility(df: DataFrame, ts: str, value: str, group=(), tie=(), w: int = 5) -> DataFrame:
    f, v = _roll(df, ts, value, group, tie, w)
    out = f.df.select("*", sd0(F.stddev_samp(v).over(f.window)).alias("volatility"), F.avg(v).over(f.window).alias("_m"))
    s = F.col("volatility")
    return f.done(out.withColumns({"variance": s * s, "cv": pct(s, F.abs(F.col("_m"))), "level": F.lit("moderate")})).drop("_m")


def moving_average(df: DataFrame, ts: str, value: str, group=(), tie=(), w: int = 7, kind: str = "simple") -> DataFrame:
    """'simple', 'weighted' or 'exponential' (with alpha 2 / (w + 1))."""
    if kind == "weighted":
        return wma(df, ts, value, group, tie, w)
    if kind == "exponential":
        return ema(df, ts, value, group, tie, 2 / (w + 1))
    return sma(df, ts, value, group, tie, w)
