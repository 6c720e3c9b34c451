"""Group summaries, flux, control charts, drift, risk, survival and forecast errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from brindle.functions.expr import bucket, safe_corr, safe_div
from brindle.functions.special import p_chi2, p_ks
from brindle.operators import frames
from brindle.operators.anomaly import _joined

#: Factors of the x-bar and R chart for subgroups of 2 to 10 rows (A2, D3, D4).
CHART_FACTORS = {
    2: (1.880, 0.0, 3.267), 3: (1.023, 0.0, 2.574), 4: (0.729, 0.0, 2.282), 5: (0.577, 0.0, 2.114), 6: (0.483, 0.0, 2.004),
    7: (0.419, 0.076, 1.924), 8: (0.373, 0.136, 1.864), 9: (0.337, 0.184, 1.816), 10: (0.308, 0.223, 1.777),
}


def group_mean(df: DataFrame, value: str, group=()) -> DataFrame:
    return df.groupBy(*group).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def outliers_iqr(df: DataFrame, value: str, group=(), multiplier: float = 1.5) -> DataFrame:
    """Rows with is_outlier 0/1 by the quartiles of their group; null values are no outliers."""
    v = F.col(value).cast("double")
    q = frames.quantiles(df, v, list(group), {"_a": 0.25, "_b": 0.75})
    span = F.col("_b") - F.col("_a")
    odd = (v < F.col("_a") - multiplier * span) | (v > F.col("_b") + multiplier * span)
    return _joined(df, q, list(group)).withColumn("is_outlier", F.coalesce(odd, F.lit(False)).cast("int")).drop("_a", "_b")


def flux_variance(df: DataFrame, amount: str, date: str, dims=(), grain: str = "month", material: float = 0.2) -> DataFrame:
    """Amount per period with the change against the period before: 'new' for the first, 'dropped' for nothing after
    something, 'material' from ``material`` on, else 'stable'."""
    t = df.where(F.col(date).isNotNull()).groupBy(*dims, bucket(date, grain).alias("period")).agg(F.sum(amount).cast("double").alias("amount"))
    old = F.lag("amount").over(Window.partitionBy(*dims).orderBy("period"))  # one row a period
    t = t.withColumn("_old", old).withColumn("flux", F.col("amount") - F.col("_old"))
    t = t.withColumn("flux_pct", safe_div("flux", F.abs("_old")))
    label = F.when(F.col("_old").isNull(), "new").when((F.col("amount") == 0) & (F.col("_old") != 0), "dropped").when(F.abs("flux_pct") >= material, "material").otherwise("stable")
    return t.withColumn("flux_label", label).drop("_old")


def period_trend(df: DataFrame, value: str, date: str, group=(), grain: str = "month") -> DataFrame:
    """Least squares of the mean per period on the period's index 0..n-1."""
    t = df.where(F.col(date).isNotNull() & F.col(value).isNotNull()).groupBy(*group, bucket(date, grain).alias("period")).agg(F.avg(value).cast("double").alias("v"))
    i = (F.row_number().over(Window.partitionBy(*group).orderBy("period")) - 1).cast("double")
    t = t.withColumn("i", i)
    return t.groupBy(*group).agg(F.regr_slope("v", "i").alias("slope"), F.regr_intercept("v", "i").alias("intercept"), (safe_corr("v", "i") * safe_corr("v", "i")).alias("r_squared"), F.count("*").alias("n_periods"))


def distribution_summary(df: DataFrame, value: str, group=()) -> DataFrame:
    v = F.col(value).cast("double")
    s = df.groupBy(*group).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    q = frames.quantiles(df, v, list(group), {f"p{round(p * 100):02d}": p for p in (0.05, 0.25, 0.5, 0.75, 0.95)})
    return _joined(s, q, list(group)).select(*group, "n", "mean", "std", "min", "p05", "p25", "p50", "p75", "p95", "max")


def historical_var(df: DataFrame, returns: str, alpha: float = 0.05, group=()) -> DataFrame:
    """Minus the alpha quantile of the returns."""
    return frames.quantiles(df, F.col(returns), list(group), {"q": alpha}).select(*group, (-F.col("q")).alias("var"), F.lit(alpha).alias("alpha"))


def psi(baseline: DataFrame, current: DataFrame, value: str, bins: int = 10, floor: float = 1e-6) -> DataFrame:
    """Population stability index over quantile bins of the baseline: (n_bins, psi, n_baseline, n_current)."""
    v = F.col(value).cast("double")
    cuts = frames.quantiles(baseline, v, [], {f"c{i}": i / bins for i in range(1, bins)}).select(F.array(*[f"c{i}" for i in range(1, bins)]).alias("cuts"))

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.where(v.isNotNull()).join(F.broadcast(cuts)).groupBy(F.size(F.filter("cuts", lambda c: c < v)).alias("bin")).agg(F.count("*").alias(name))

    both = counted(baseline, "b").join(counted(current, "c"), "bin", "full")
    all_ = Window.partitionBy()  # one row a bin
    share = lambda c: F.greatest(F.coalesce(safe_div(c, F.sum(c).over(all_)), F.lit(0.0)), F.lit(floor))
    p = both.select("b", "c", share("b").alias("pb"), share("c").alias("pc"))
    return p.agg(F.count("*").alias("n_bins"), F.sum((F.col("pc") - F.col("pb")) * F.ln(F.col("pc") / F.col("pb"))).alias("psi"), F.sum("b").alias("n_baseline"), F.sum("c").alias("n_current"))


def x_bar_r_chart(df: DataFrame, value: str, subgroup: str, size: int = 5) -> DataFrame:
    """Mean and range per subgroup with the chart's limits from the mean of all subgroups."""
    a2, d3, d4 = CHART_FACTORS[size]
    g = df.where(F.col(value).isNotNull()).groupBy(subgroup).agg(F.avg(value).alias("xbar"), (F.max(value) - F.min(value)).cast("double").alias("r"))
    c = g.agg(F.avg("xbar").alias("_x"), F.avg("r").alias("_r"))
    g = g.join(F.broadcast(c)).select(
        subgroup, "xbar", "r", (F.col("_x") - a2 * F.col("_r")).alias("xbar_lcl"), (F.col("_x") + a2 * F.col("_r")).alias("xbar_ucl"), (d3 * F.col("_r")).alias("r_lcl"), (d4 * F.col("_r")).alias("r_ucl")
    )
    odd = ~F.col("xbar").between(F.col("xbar_lcl"), F.col("xbar_ucl")) | ~F.col("r").between(F.col("r_lcl"), F.col("r_ucl"))
    return g.withColumn("out_of_control", odd.cast("int"))


def cp_cpk(df: DataFrame, value: str, lsl: float, usl: float, group=()) -> DataFrame:
    t = df.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    side = F.least(F.lit(usl) - F.col("mean"), F.col("mean") - F.lit(lsl))
    return t.withColumns({"cp": safe_div(F.lit(usl - lsl), F.col("std") * 6), "cpk": safe_div(side, F.col("std") * 3)})


def portfolio_risk(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(portfolio_mean, portfolio_vol, n) of the weighted sum of the return columns; rows with a null are left out."""
    p = sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))
    t = df.dropna(subset=list(weights))
    return t.agg(F.avg(p).alias("portfolio_mean"), F.stddev_samp(p).alias("portfolio_vol"), F.count("*").alias("n"))


def risk_attribution(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Share of each column in the portfolio's variance: w * cov(column, portfolio) / variance; the shares add up to 1."""
    p = sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))
    t = df.dropna(subset=list(weights)).agg(F.var_samp(p).alias("v"), *[(F.covar_samp(F.col(c), p) * w).alias(f"c_{i}") for i, (c, w) in enumerate(weights.items())])
    cells = F.array(*[F.struct(F.lit(c).alias("asset"), F.lit(w).alias("weight"), safe_div(f"c_{i}", "v").alias("contribution_to_variance")) for i, (c, w) in enumerate(weights.items())])
    return t.select(F.inline(cells))


def naive_baseline(df: DataFrame, ts: str, value: str, horizon: int = 7, group=(), drift: bool = False) -> DataFrame:
    """The last value repeated, or carried on by the mean step between the first and the last row."""
    v = F.col(value).cast("double")
    rows = df.where(F.col(ts).isNotNull() & v.isNotNull())
    t = rows.groupBy(*group).agg(F.max_by(v, ts).alias("_l"), F.min_by(v, ts).alias("_f"), F.count("*").alias("_n"))
    step = F.coalesce(safe_div(F.col("_l") - F.col("_f"), F.col("_n") - 1), F.lit(0.0)) if drift else F.lit(0.0)
    return t.select(*group, F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"), "_l", step.alias("_s")).select(*group, "step", (F.col("_l") + F.col("_s") * F.col("step")).alias("yhat"))


def forecast_metrics(df: DataFrame, actual: str, forecast: str, ts: str, group=(), tie=()) -> DataFrame:
    """mape, smape, wape (in per cent), mae, rmse, and mase against the naive step of the actuals."""
    y, f = F.col(actual).cast("double"), F.col(forecast).cast("double")
    fr = frames.rolling(df.where(y.isNotNull() & f.isNotNull()), list(group), [ts, *tie], 1)
    e = F.abs(y - f)
    t = fr.done(fr.df.withColumn("_step", F.abs(y - F.lag(y).over(fr.order)))).groupBy(*group).agg(
        F.count("*").alias("n"), (F.avg(safe_div(e, F.abs(y))) * 100).alias("mape"), (F.avg(safe_div(2 * e, F.abs(y) + F.abs(f))) * 100).alias("smape"),
        (safe_div(F.sum(e), F.sum(F.abs(y))) * 100).alias("wape"), F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), safe_div(F.avg(e), F.avg("_step")).alias("mase"),
    )
    return t


def price_elasticity(df: DataFrame, price: str, demand: str, group=()) -> DataFrame:
    """Slope of ln demand on ln price over rows where both are positive."""
    rows = df.where((F.col(price) > 0) & (F.col(demand) > 0))
    x, y = F.ln(F.col(price).cast("double")), F.ln(F.col(demand).cast("double"))
    return rows.groupBy(*group).agg(F.regr_slope(y, x).alias("elasticity"), F.regr_intercept(y, x).alias("intercept"), (safe_corr(y, x) * safe_corr(y, x)).alias("r_squared"), F.count("*").alias("n"))


def _events_by_time(df: DataFrame, duration: str, event: Column, group: list[str]) -> DataFrame:
    """Per distinct duration: rows that end there, events among them, rows still at risk."""
    d = df.where(F.col(duration).isNotNull()).groupBy(*group, F.col(duration).cast("double").alias("t")).agg(F.count("*").alias("n"), F.sum(event.cast("long")).alias("d"))
    run = frames.cumulative(d, group, ["t"], {"_gone": ("sum", F.col("n"))})
    total = d.groupBy(*group).agg(F.sum("n").alias("_all")) if group else d.agg(F.sum("n").alias("_all"))
    return _joined(run, total, group).withColumn("at_risk", F.col("_all") - F.col("_gone") + F.col("n")).drop("_gone", "_all")


def kaplan_meier(df: DataFrame, duration: str, event: str, group=()) -> DataFrame:
    """(t, at_risk, events, survival); the curve is a running product over distinct times."""
    g = list(group)
    t = _events_by_time(df, duration, F.col(event) == 1, g).withColumn("_q", 1 - F.col("d") / F.col("at_risk"))
    out = frames.cumulative(t, g, ["t"], {"survival": ("product", F.col("_q"))})
    return out.select(*g, "t", "at_risk", F.col("d").alias("events"), "survival")


def log_rank(df: DataFrame, duration: str, event: str, group: str) -> DataFrame:
    """(chi2, p_value) of two groups with one degree of freedom; observed and expected events of the first group."""
    t = df.where(F.col(duration).isNotNull() & F.col(group).isNotNull())
    lo = t.agg(F.min(group).alias("_g"))
    one = t.join(F.broadcast(lo)).withColumn("_in", F.col(group) == F.col("_g"))
    s = one.groupBy(F.col(duration).cast("double").alias("t")).agg(F.count("*").alias("n"), F.sum((F.col(event) == 1).cast("long")).alias("d"), F.count_if("_in").alias("n1"), F.count_if(F.col("_in") & (F.col(event) == 1)).alias("d1"))
    run = frames.cumulative(s, [], ["t"], {"g": ("sum", F.col("n")), "g1": ("sum", F.col("n1"))})
    total = s.agg(F.sum("n").alias("a"), F.sum("n1").alias("a1"))
    r = run.join(F.broadcast(total)).select("n", "d", "d1", (F.col("a") - F.col("g") + F.col("n")).alias("r"), (F.col("a1") - F.col("g1") + F.col("n1")).alias("r1"))
    p = F.col("r1") / F.col("r")
    v = F.when(F.col("r") > 1, F.col("d") * p * (1 - p) * (F.col("r") - F.col("d")) / (F.col("r") - 1)).otherwise(0.0)
    x = r.agg(F.sum("d1").cast("double").alias("observed"), F.sum(F.col("d") * p).alias("expected"), F.sum(v).alias("_v"))
    x = x.withColumn("chi2", safe_div((F.col("observed") - F.col("expected")) * (F.col("observed") - F.col("expected")), "_v")).drop("_v")
    return x.withColumn("p_value", p_chi2(F.col("chi2"), F.lit(1.0)))


def _two_ecdfs(a: DataFrame, b: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """Distinct values of both with running shares, and the two totals."""
    v = F.col(value).cast("double")
    rows = a.where(v.isNotNull()).select(v.alias("v"), F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.where(v.isNotNull()).select(v.alias("v"), F.lit(0).alias("x"), F.lit(1).alias("y")))
    c = rows.groupBy("v").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    total = c.agg(F.sum("x").alias("nx"), F.sum("y").alias("ny"))
    run = frames.cumulative(c, [], ["v"], {"cx": ("sum", F.col("x")), "cy": ("sum", F.col("y"))}).join(F.broadcast(total))
    return run.withColumns({"fx": safe_div("cx", "nx"), "fy": safe_div("cy", "ny")}), total


def ks_test(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov: (statistic, p_value) with the asymptotic p."""
    run, _ = _two_ecdfs(a, b, value)
    s = run.agg(F.max(F.abs(F.col("fx") - F.col("fy"))).alias("statistic"), F.first("nx").alias("n_a"), F.first("ny").alias("n_b"))
    return s.withColumn("p_value", p_ks(F.col("statistic"), F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b"))))


def wasserstein(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Area between the two distribution functions."""
    run, _ = _two_ecdfs(a, b, value)
    f = frames.rolling(run, [], ["v"], 0, 1)
    area = f.done(f.df.withColumn("_w", F.lead("v").over(f.order) - F.col("v")))
    return area.agg(F.coalesce(F.sum(F.abs(F.col("fx") - F.col("fy")) * F.col("_w")), F.lit(0.0)).alias("distance"))


def jensen_shannon(a: DataFrame, b: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Divergence (natural log) over equal-width bins of both ranges together."""
    v = F.col(value).cast("double")
    ends = a.select(v.alias("v")).unionByName(b.select(v.alias("v"))).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    def counted(df: DataFrame, n: str) -> DataFrame:
        at = F.coalesce(F.floor(safe_div(v - F.col("lo"), F.col("hi") - F.col("lo")) * bins), F.lit(0))
        return df.where(v.isNotNull()).join(F.broadcast(ends)).groupBy(F.least(at, F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias(n))
    both = counted(a, "x").join(counted(b, "y"), "bin", "full").fillna(0, ["x", "y"])
    w = Window.partitionBy()  # one row a bin
    t = both.select(safe_div("x", F.sum("x").over(w)).alias("p"), safe_div("y", F.sum("y").over(w)).alias("q")).withColumn("m", (F.col("p") + F.col("q")) / 2)
    term = lambda c: F.when(F.col(c) > 0, F.col(c) * F.ln(F.col(c) / F.col("m"))).otherwise(0.0)
    return t.agg((F.sum(term("p") + term("q")) / 2).alias("divergence"), F.count("*").alias("n_bins"))


def seasonal_residuals(df: DataFrame, ts: str, value: str, period: int, group=(), tie=()) -> DataFrame:
    """Classical additive decomposition: centred moving mean, seasonal mean of what is left, residual."""
    if period < 2:
        raise ValueError("a season has at least two rows")
    g, half = list(group), period // 2
    rows = df.where(F.col(ts).isNotNull() & F.col(value).isNotNull())
    f = frames.rolling(rows, g, [ts, *tie], half, half)
    v, full = F.col(value).cast("double"), F.count("*").over(f.window) == 2 * half + 1
    total = F.sum(v).over(f.window)
    if period % 2 == 0:  # the two outer rows count half
        total = total - (F.lag(v, half).over(f.order) + F.lead(v, half).over(f.order)) / 2
    out = f.done(f.df.withColumn("trend", F.when(full, total / period)))
    big = frames.largest_group(rows, g) > frames.BLOCK_ROWS
    out = frames.number_rows(out, g, [ts, *tie], "_i") if big else out.withColumn("_i", F.row_number().over(Window.partitionBy(*g).orderBy(ts, *tie)).cast("long"))
    out = out.withColumn("_s", F.col("_i") % period)
    means = out.groupBy(*g, "_s").agg(F.avg(v - F.col("trend")).alias("_m"))
    means = means.withColumn("seasonal", F.col("_m") - F.avg("_m").over(Window.partitionBy(*g))).drop("_m")  # one row a season
    out = _joined(out, means, [*g, "_s"])
    return out.withColumn("residual", v - F.col("trend") - F.col("seasonal")).drop("_i", "_s")
