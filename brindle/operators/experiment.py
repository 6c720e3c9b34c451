"""Comparisons of conditions: effects, tests, adjustments and power."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from brindle.functions.expr import pct, safe_div
from brindle.operators import frames
from brindle.functions.special import p_chi2, p_normal, p_t

#: Fixed values of the power table: two-sided z for alpha, z for power.
Z_ALPHA = {0.05: 1.96}
Z_ALPHA_OTHER = 1.645
Z_POWER = {0.8: 0.84}
Z_POWER_OTHER = 1.28


def change_comparison(df: DataFrame, condition: str, metric: str, value: str, baseline: str) -> DataFrame:
    """Mean per (condition, metric) against the baseline's mean (0 where it has none): absolute and per-cent change, with
    the standard error and z of the difference."""
    v = F.col(value).cast("double")
    m = df.where(v.isNotNull()).groupBy(F.col(condition).alias("condition"), F.col(metric).alias("metric")).agg(F.avg(v).alias("mean_value"), F.var_samp(v).alias("_var"), F.count("*").alias("n"))
    b = m.where(F.col("condition") == baseline).select("metric", F.col("mean_value").alias("_b"), F.col("_var").alias("_bv"), F.col("n").alias("_bn"))
    out = m.where(F.col("condition") != baseline).join(b, "metric", "left")
    base = F.coalesce("_b", F.lit(0.0))
    diff = F.col("mean_value") - base
    se = F.sqrt(F.col("_var") / F.col("n") + F.col("_bv") / F.col("_bn"))
    return out.select("condition", "metric", "n", "mean_value", base.alias("baseline_mean"), diff.alias("absolute_change"), pct(diff, base).alias("percent_change"), se.alias("std_error"), safe_div(diff, se).alias("z"))


def prepost(df: DataFrame, entity: str, is_post: Column, value: str) -> DataFrame:
    """Paired comparison over entities seen before and after: (n, mean_pre, mean_post, mean_change, t, df, p_value)."""
    v = F.col(value).cast("double")
    e = df.groupBy(entity).agg(F.avg(F.when(~is_post, v)).alias("pre"), F.avg(F.when(is_post, v)).alias("post")).where("pre IS NOT NULL AND post IS NOT NULL").withColumn("d", F.col("post") - F.col("pre"))
    t = e.agg(F.count("*").alias("n"), F.avg("pre").alias("mean_pre"), F.avg("post").alias("mean_post"), F.avg("d").alias("mean_change"), F.stddev_samp("d").alias("_s"))
    t = t.withColumn("t", safe_div("mean_change", F.col("_s") / F.sqrt("n"))).withColumn("df", F.col("n") - 1).drop("_s")
    return t.withColumn("p_value", p_t(F.col("t"), F.col("df")))


def stratified(df: DataFrame, stratum: str, is_treated: Column, value: str) -> DataFrame:
    """Difference of means over strata with weights nt * nc / n: (n_strata, effect)."""
    v = F.col(value).cast("double")
    s = df.where(v.isNotNull()).groupBy(stratum).agg(F.count_if(is_treated).alias("nt"), F.count_if(~is_treated).alias("nc"), F.avg(F.when(is_treated, v)).alias("mt"), F.avg(F.when(~is_treated, v)).alias("mc"))
    s = s.where("nt > 0 AND nc > 0").withColumn("w", F.col("nt") * F.col("nc") / (F.col("nt") + F.col("nc")))
    return s.agg(F.count("*").alias("n_strata"), safe_div(F.sum(F.col("w") * (F.col("mt") - F.col("mc"))), F.sum("w")).alias("effect"))


def sequential(df: DataFrame, period: Column, is_treated: Column, value: str, z: float = 1.96) -> DataFrame:
    """Cumulative z per look against the O'Brien-Fleming boundary z / sqrt(t), t the share of all rows seen.

    Looks are periods: rows are summed per period first, so the running window has one row a period.
    """
    v = F.col(value).cast("double")
    arm = lambda c: (F.count_if(c), F.sum(F.when(c, v)), F.sum(F.when(c, v * v)))
    names = ("n", "s", "q")
    p = df.where(v.isNotNull()).groupBy(period.alias("period")).agg(*[e.alias(k + a) for a, c in (("t", is_treated), ("c", ~is_treated)) for k, e in zip(names, arm(c))])
    w = Window.partitionBy().orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    full = Window.partitionBy()
    total = F.sum(F.col("nt") + F.col("nc")).over(full)
    run = p.select("period", total.alias("_all"), *[F.coalesce(F.sum(k + a).over(w), F.lit(0)).alias(k + a) for a in "tc" for k in names])
    mean = lambda a: safe_div("s" + a, "n" + a)
    var = lambda a: F.when(F.col("n" + a) > 1, (F.col("q" + a) - F.col("s" + a) * mean(a)) / (F.col("n" + a) - 1))
    se = F.sqrt(var("t") / F.col("nt") + var("c") / F.col("nc"))
    run = run.withColumn("information", safe_div(F.col("nt") + F.col("nc"), "_all")).withColumn("z", safe_div(mean("t") - mean("c"), se)).withColumn("boundary", F.lit(z) / F.sqrt("information"))
    return run.select("period", (F.col("nt") + F.col("nc")).alias("n"), "information", "z", "boundary", F.coalesce(F.abs("z") > F.col("boundary"), F.lit(False)).alias("stop"))


def cuped(df: DataFrame, value: str, covariate: str, group=()) -> DataFrame:
    """theta = cov / var of the covariate, the variance as it is and after the adjustment, and the means."""
    y, x = F.col(value).cast("double"), F.col(covariate).cast("double")
    t = df.where(y.isNotNull() & x.isNotNull()).groupBy(*group).agg(F.count("*").alias("n"), safe_div(F.covar_samp(y, x), F.var_samp(x)).alias("theta"), F.var_samp(y).alias("y_var_raw"), F.covar_samp(y, x).alias("_c"), F.avg(y).alias("mean_value"))
    return t.withColumn("y_var_cuped", F.col("y_var_raw") - F.coalesce("theta", F.lit(0.0)) * F.coalesce("_c", F.lit(0.0))).drop("_c")


def cuped_adjusted(df: DataFrame, value: str, covariate: str) -> DataFrame:
    """Rows with ``adjusted`` = y - theta * (x - mean x)."""
    y, x = F.col(value).cast("double"), F.col(covariate).cast("double")
    s = df.where(y.isNotNull() & x.isNotNull()).agg(safe_div(F.covar_samp(y, x), F.var_samp(x)).alias("_t"), F.avg(x).alias("_m"))
    return df.join(F.broadcast(s)).withColumn("adjusted", y - F.coalesce("_t", F.lit(0.0)) * (x - F.col("_m"))).drop("_t", "_m")


def _uniform(h: np.ndarray, rounds: int, salt: int) -> np.ndarray:
    """One number in (0, 1) for each hash and round, by the finishing steps of a 64-bit mixer."""
    with np.errstate(over="ignore"):
        z = h.astype(np.uint64)[:, None] + np.arange(1, rounds + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53) + 2.0**-54


def _poisson(h: np.ndarray, c: np.ndarray, rounds: int) -> np.ndarray:
    """Poisson draws of mean ``c``, a row of ``rounds`` for each hash."""
    u, out = _uniform(h, rounds, 1), np.empty((len(h), rounds))
    few = c < 30
    for k in np.unique(c[few]):
        steps = np.arange(0, 8 * int(k) + 40)
        logs = steps * np.log(float(k)) - k - np.concatenate([[0.0], np.cumsum(np.log(steps[1:]))])
        at = c == k
        out[at] = np.searchsorted(np.cumsum(np.exp(logs)), u[at])
    if not few.all():
        v = _uniform(h[~few], rounds, 2)
        normal = np.sqrt(-2 * np.log(u[~few])) * np.cos(2 * np.pi * v)
        out[~few] = np.maximum(0, np.rint(c[~few][:, None] + np.sqrt(c[~few])[:, None] * normal))
    return out


def bootstrap_ci(df: DataFrame, value: str, group=(), confidence: float = 95.0, rounds: int = 500, seed: int = 42, method: str = "percentile") -> DataFrame:
    """Bootstrap of the mean, by percentiles or ``method`` 'bca': (n, point_estimate, lower, upper).

    Poisson bootstrap: a value that c rows have enters round b with a Poisson(c) weight drawn from a hash of the group, the
    value and b. The rounds are sums that combine map-side, no group is gathered in one task, and the result depends neither
    on the order of the rows nor on how they are partitioned. From 30 rows of a value on the weight is a rounded normal.
    """
    if not 1 <= rounds <= 2000:
        raise ValueError("1 to 2000 rounds")
    rows = df.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("v"))
    counts = rows.groupBy(*group, "v").agg(F.count("*").alias("c")).withColumn("h", F.xxhash64(*group, "v", F.lit(seed)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "v") + (", " if group else "") + "b int, w double, s double"

    def run(batches):
        for p in batches:
            for key, q in p.groupby(list(group), dropna=False) if group else [((), p)]:
                w, s = np.zeros(rounds), np.zeros(rounds)
                for i in range(0, len(q), 256):
                    part = q.iloc[i : i + 256]
                    x = _poisson(part["h"].to_numpy(), part["c"].to_numpy(), rounds)
                    w += x.sum(axis=0)
                    s += part["v"].to_numpy() @ x
                out = pd.DataFrame({"b": np.arange(rounds, dtype=np.int32), "w": w, "s": s})
                for name, k in zip(reversed(list(group)), reversed(key if isinstance(key, tuple) else (key,))):
                    out.insert(0, name, k)
                yield out

    sums = counts.mapInPandas(run, schema).groupBy(*group, "b").agg(safe_div(F.sum("s"), F.sum("w")).alias("m"))
    if method == "bca":
        means = sums.groupBy(*group).agg(F.array_sort(F.collect_list("m")).alias("ms"))  # as many as rounds
        ci = _bca(rows, means, list(group), confidence)
    else:
        tail = (1 - confidence / 100) / 2
        ci = sums.groupBy(*group).agg(F.percentile("m", F.lit(tail)).alias("lower"), F.percentile("m", F.lit(1 - tail)).alias("upper"))
    point = rows.groupBy(*group).agg(F.count("*").alias("n"), F.avg("v").alias("point_estimate"))
    return point.join(ci, list(group)) if group else point.join(ci)


def _bca(rows: DataFrame, means: DataFrame, group: list[str], confidence: float) -> DataFrame:
    """Bias-corrected and accelerated bounds: the acceleration is the skewness of the jackknife, which for a mean is that of the
    values over six roots of n."""
    stats = rows.groupBy(*group).agg(F.avg("v").alias("m"), F.coalesce(F.try_divide(F.skewness("v"), 6 * F.sqrt(F.count("*"))), F.lit(0.0)).alias("a"))
    on = F.expr(" AND ".join(f"x.`{g}` <=> y.`{g}`" for g in group) or "true")
    both = means.alias("x").join(stats.alias("y"), on).select("x.*", "y.m", "y.a")
    normal = NormalDist()

    @F.pandas_udf("struct<lower: double, upper: double>")
    def bounds(ms: pd.Series, m: pd.Series, a: pd.Series) -> pd.DataFrame:
        out = []
        for xs, point, acc in zip(ms, m, a):
            xs = np.asarray(xs, dtype=float)
            share = (np.count_nonzero(xs < point) + np.count_nonzero(xs == point) / 2) / len(xs)
            z0 = normal.inv_cdf(min(max(share, 0.5 / len(xs)), 1 - 0.5 / len(xs)))
            acc = 0.0 if np.isnan(acc) else acc
            at = []
            for z in (normal.inv_cdf((1 - confidence / 100) / 2), normal.inv_cdf((1 + confidence / 100) / 2)):
                at.append(normal.cdf(z0 + (z0 + z) / (1 - acc * (z0 + z))))
            out.append(np.quantile(xs, at))
        return pd.DataFrame(out, columns=["lower", "upper"])

    return both.withColumn("_c", bounds("ms", "m", "a")).select(*group, "_c.lower", "_c.upper")


def power_analysis(effect: Column, sd: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """Rows per arm: ceil(2 (sd (z_alpha + z_power) / effect)^2)."""
    z = Z_ALPHA.get(alpha, Z_ALPHA_OTHER) + Z_POWER.get(power, Z_POWER_OTHER)
    return F.ceil(2 * F.pow(sd * z / F.greatest(F.abs(effect), F.lit(1e-9)), 2)).cast("long")


def effect_sizes(df: DataFrame, is_treated: Column, value: str, group=()) -> DataFrame:
    """Cohen's d with the pooled deviation, and its size in words; null below two rows an arm."""
    v = F.col(value).cast("double")
    t, c = F.when(is_treated, v), F.when(~is_treated, v)
    a = df.groupBy(*group).agg(F.count(t).alias("n_treatment"), F.count(c).alias("n_control"), F.avg(t).alias("mean_treatment"), F.avg(c).alias("mean_control"), F.var_samp(t).alias("_vt"), F.var_samp(c).alias("_vc"))
    nt, nc = F.col("n_treatment"), F.col("n_control")
    pooled = F.sqrt(((nt - 1) * F.col("_vt") + (nc - 1) * F.col("_vc")) / (nt + nc - 2))
    a = a.withColumn("cohens_d", F.when((nt >= 2) & (nc >= 2), safe_div(F.col("mean_treatment") - F.col("mean_control"), pooled))).drop("_vt", "_vc")
    size = F.abs("cohens_d")
    return a.withColumn("interpretation", F.when(size < 0.5, "small").when(size < 0.8, "medium").when(size.isNotNull(), "large"))


def bonferroni(df: DataFrame, p: str = "p_value", alpha: float = 0.05) -> DataFrame:
    """p times the number of tests, at most 1; the tests are the rows, a few per analysis."""
    m = df.where(F.col(p).isNotNull()).agg(F.count("*").alias("_m"))
    return df.join(F.broadcast(m)).withColumn("p_adjusted", F.least(F.col(p) * F.col("_m"), F.lit(1.0))).withColumn("significant", F.col("p_adjusted") < alpha).drop("_m")


def fdr_bh(df: DataFrame, p: str = "p_value", alpha: float = 0.05) -> DataFrame:
    """Benjamini-Hochberg: p times m over rank, made monotone from the largest down. Equal p have equal results, so the
    running sums and minima go over the distinct p values, in blocks if they are many."""
    ps = df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_n"))
    total = ps.agg(F.sum("_n").alias("_m"))
    q = frames.cumulative(ps, [], ["_p"], {"_r": ("sum", F.col("_n"))}).join(F.broadcast(total))
    q = frames.cumulative(q, [], [F.desc("_p")], {"_q": ("min", F.col("_p") * F.col("_m") / F.col("_r"))}).select("_p", F.least(F.lit(1.0), "_q").alias("q_value"))
    return df.join(q, F.col(p) == F.col("_p"), "left").drop("_p").withColumn("significant", F.col("q_value") <= alpha)


def srm_check(df: DataFrame, arm: str, alpha: float = 0.001) -> DataFrame:
    """Chi-square of the arms' rows against an equal split: (n_arms, chi2, p_value, srm_detected 0/1)."""
    n = df.where(F.col(arm).isNotNull()).groupBy(arm).agg(F.count("*").alias("n"))
    t = n.agg(F.count("*").alias("n_arms"), F.sum("n").alias("_t"), F.sum(F.col("n") * F.col("n")).alias("_q"))
    t = t.withColumn("chi2", safe_div(F.col("_q") * F.col("n_arms"), "_t") - F.col("_t")).drop("_t", "_q")
    t = t.withColumn("p_value", p_chi2(F.col("chi2"), F.greatest(F.col("n_arms") - 1, F.lit(1))))
    return t.withColumn("srm_detected", (F.col("p_value") < alpha).cast("int"))


def bayesian_ab(df: DataFrame, arm: str, converted: str, control, treatment, samples: int = 20_000, seed: int = 42) -> DataFrame:
    """Beta(1 + successes, 1 + failures) per arm: P(treatment better), mean lift and its 95 % interval, by simulation from
    the two arms' counts."""
    c = F.col(converted).cast("int")
    side = lambda x: (F.coalesce(F.sum(F.when(F.col(arm) == x, c)), F.lit(0)), F.count_if((F.col(arm) == x) & c.isNotNull()))
    (sc, nc), (st, nt) = side(control), side(treatment)
    counts = df.agg(sc.alias("sc"), nc.alias("nc"), st.alias("st"), nt.alias("nt"))

    def run(batches):
        for p in batches:
            for r in p.itertuples():
                rng = np.random.Generator(np.random.PCG64(seed))
                a, b = rng.beta(1 + r.sc, 1 + r.nc - r.sc, samples), rng.beta(1 + r.st, 1 + r.nt - r.st, samples)
                lift = b / a - 1
                yield pd.DataFrame({"p_treatment_better": [(b > a).mean()], "lift": [lift.mean()], "lift_lower": [np.quantile(lift, 0.025)], "lift_upper": [np.quantile(lift, 0.975)]})

    return counts.mapInPandas(run, "p_treatment_better double, lift double, lift_lower double, lift_upper double")


def aa_simulation(df: DataFrame, value: str, runs: int = 200, alpha: float = 0.05) -> DataFrame:
    """Share of random halvings with p < alpha: each row's arm in run r is a bit of its hash, so all runs are sums."""
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull()).select(v.alias("v"), F.xxhash64(*df.columns, F.monotonically_increasing_id()).alias("h"))
    cells = rows.select("v", "h", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run")).withColumn("arm", F.xxhash64("h", "run").bitwiseAND(F.lit(1)) == 1)
    t = effect_t(cells, F.col("arm"), "v", ["run"])
    return t.agg(F.count("*").alias("runs"), F.avg((F.col("p_value") < alpha).cast("double")).alias("false_positive_rate"))


def effect_t(df: DataFrame, is_treated: Column, value: str, group=()) -> DataFrame:
    """Difference of means with the normal p of Welch's z."""
    v = F.col(value).cast("double")
    t, c = F.when(is_treated, v), F.when(~is_treated, v)
    a = df.groupBy(*group).agg(F.avg(t).alias("mt"), F.avg(c).alias("mc"), F.var_samp(t).alias("vt"), F.var_samp(c).alias("vc"), F.count(t).alias("nt"), F.count(c).alias("nc"))
    z = safe_div(F.col("mt") - F.col("mc"), F.sqrt(safe_div("vt", "nt") + safe_div("vc", "nc")))
    return a.select(*group, (F.col("mt") - F.col("mc")).alias("effect"), z.alias("z")).withColumn("p_value", p_normal(F.col("z")))


def did(df: DataFrame, outcome: str, treated: Column, post: Column) -> DataFrame:
    """Difference in differences of the four cell means, with its standard error and normal p."""
    y = F.col(outcome).cast("double")
    cells = {"11": treated & post, "10": treated & ~post, "01": ~treated & post, "00": ~treated & ~post}
    a = df.where(y.isNotNull()).agg(*[e.alias(k + n) for n, c in cells.items() for k, e in (("m", F.avg(F.when(c, y))), ("v", F.var_samp(F.when(c, y))), ("n", F.count(F.when(c, y))))])
    est = F.col("m11") - F.col("m10") - F.col("m01") + F.col("m00")
    var = sum((safe_div("v" + n, "n" + n) for n in cells), F.lit(0.0))
    return a.select(est.alias("did_estimate"), F.sqrt(var).alias("std_error")).withColumn("z", safe_div("did_estimate", "std_error")).withColumn("p_value", p_normal(F.col("z")))


def required_runs(p: float, error: float) -> int:
    """Runs for a simulated rate ``p`` to lie within ``error`` at two standard deviations."""
    return math.ceil(4 * p * (1 - p) / (error * error))
