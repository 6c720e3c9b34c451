"""Grouped numerical models that relational operators cannot express: decomposition, breaks, unit roots, forecasts, fits.

Every model uses all rows of a series, whatever its size. Lag sums and regressions (``acf_pacf``, ``arima``,
``forecast_anomalies``, ``granger``) are summed in Spark and solved from small matrices. ``stl``, ``change_points``,
``adf_kpss`` and ``ets`` see one whole series in one task: its rows bound what such a task holds, and callers who want
less bring the series to a coarser grain first (``regular`` with ``points``).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from brindle.functions.special import f_sf
from brindle.operators import frames
from brindle.session import Stage

#: 5 % points of the Dickey-Fuller distribution with constant (asymptotic), and of the KPSS level test.
ADF_5PCT, KPSS_5PCT = -2.862, 0.463


def regular(df: DataFrame, ts: str, value: str, group=(), points: int | None = None) -> DataFrame:
    """(groups, i, y): the series as it is, in order of time and value; with ``points``, series of more rows than that are
    the means of as many equal stretches of their time."""
    g = list(group)
    rows = df.where(F.col(ts).isNotNull() & F.col(value).isNotNull()).select(*g, F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(value).cast("double").alias("v"))
    if points is None:
        return frames.number_rows(rows.select(*g, "t", F.col("v").alias("y")), g, ["t", "y"], "i").select(*g, F.col("i"), "y")
    span = rows.groupBy(*g).agg(F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"))
    placed = rows.alias("r").join(span.alias("s"), F.expr(" AND ".join(f"r.`{c}` <=> s.`{c}`" for c in g) or "true")).select("r.*", "n", "lo", "hi")
    width = F.greatest((F.col("hi") - F.col("lo")) / points, F.lit(1.0))
    at = F.when(F.col("n") <= points, F.col("t")).otherwise(F.floor((F.col("t") - F.col("lo")) / width))
    means = placed.groupBy(*g, at.alias("k"), F.when(F.col("n") <= points, F.col("v")).alias("_own")).agg(F.avg("v").alias("y"), F.count("*").alias("c"))
    flat = means.select(*g, "k", "y", F.explode(F.when(F.col("_own").isNotNull(), F.sequence(F.lit(1).cast("long"), "c")).otherwise(F.array(F.lit(1).cast("long")))).alias("_c"))
    return flat.select(*g, F.row_number().over(Window.partitionBy(*g).orderBy("k", "y", "_c")).alias("i"), "y")


def _staged(df: DataFrame, ts: str, value: str, group: list[str]) -> DataFrame:
    """``regular``, written once for the operators that read it more than once."""
    return Stage(df.sparkSession, "series").put(regular(df, ts, value, group))


def _grouped(series: DataFrame, group: list[str], schema: str, fn) -> DataFrame:
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in series.schema if f.name in group)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        out = fn(p.sort_values("i")["y"].to_numpy(dtype=float))
        for g in reversed(group):
            out.insert(0, g, p[g].iloc[0])
        return out

    return series.groupBy(*group).applyInPandas(run, f"{keys}, {schema}" if keys else schema)


def _loess(y: np.ndarray, span: int) -> np.ndarray:
    """Locally linear smooth with tricube weights over the ``span`` nearest points."""
    n = len(y)
    span = min(max(3, span), n)
    out = np.empty(n)

    def at(i: int) -> None:
        lo = min(max(0, i - span // 2), n - span)
        x = np.arange(lo, lo + span) - i
        w = (1 - (np.abs(x) / (np.abs(x).max() + 1.0)) ** 3) ** 3
        s, sx, sxx = w.sum(), w @ x, w @ (x * x)
        v = y[lo : lo + span]
        sy, sxy = w @ v, w @ (x * v)
        d = s * sxx - sx * sx
        out[i] = (sxx * sy - sx * sxy) / d if abs(d) > 1e-12 else sy / s

    # away from the ends the weights are the same for every point
    half = span // 2
    inner = range(half, n - span + half + 1) if span < n else range(0)
    if len(inner):
        x = np.arange(span) - half
        w = (1 - (np.abs(x) / (np.abs(x).max() + 1.0)) ** 3) ** 3
        s, sx, sxx = w.sum(), w @ x, w @ (x * x)
        d = s * sxx - sx * sx
        k = w * (sxx - sx * x) / d if abs(d) > 1e-12 else w / s
        out[inner.start : inner.stop] = np.convolve(y, k[::-1], "valid")
    for i in (*range(inner.start), *range(inner.stop, n)) if len(inner) else range(n):
        at(i)
    return out


def stl(df: DataFrame, ts: str, value: str, period: int, group=(), rounds: int = 2) -> DataFrame:
    """(i, y, trend, seasonal, residual) by repeated local regression; shorter than two seasons: trend only."""

    def fit(y: np.ndarray) -> pd.DataFrame:
        n = len(y)
        trend, seasonal = np.zeros(n), np.zeros(n)
        if n < 2 * period:
            trend = _loess(y, n)
        else:
            for _ in range(rounds):
                rest = y - trend
                for k in range(period):
                    seasonal[k::period] = _loess(rest[k::period], 7)
                low = np.convolve(np.pad(seasonal, period // 2, mode="edge"), np.ones(period) / period, "valid")[:n]
                seasonal = seasonal - low
                trend = _loess(y - seasonal, int(1.5 * period) | 1)
        return pd.DataFrame({"i": np.arange(n), "y": y, "trend": trend, "seasonal": seasonal, "residual": y - trend - seasonal})

    return _grouped(regular(df, ts, value, group), list(group), "i long, y double, trend double, seasonal double, residual double", fit)


def change_points(df: DataFrame, ts: str, value: str, group=(), penalty: float | None = None) -> DataFrame:
    """(break_index, mean_before, mean_after): pruned exact search for shifts of the mean; the default penalty is
    3 * variance of the steps * ln n."""

    def fit(y: np.ndarray) -> pd.DataFrame:
        n = len(y)
        s, q = np.concatenate([[0], y.cumsum()]), np.concatenate([[0], (y * y).cumsum()])
        noise = np.var(np.diff(y)) / 2 if n > 2 else 0.0
        pen = penalty if penalty is not None else 3 * max(noise, 1e-12) * math.log(max(n, 2))
        best, back, alive = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int), np.array([0])
        best[0] = -pen
        for t in range(1, n + 1):
            size = t - alive
            cost = best[alive] + (q[t] - q[alive]) - (s[t] - s[alive]) ** 2 / size
            k = int(cost.argmin())
            best[t], back[t] = cost[k] + pen, alive[k]
            alive = np.append(alive[cost <= best[t]], t)
        cuts, t = [], n
        while t:
            t = back[t]
            if t:
                cuts.append(t)
        ends = [0, *sorted(cuts), n]
        return pd.DataFrame([(b, y[a:b].mean(), y[b:c].mean()) for a, b, c in zip(ends, ends[1:], ends[2:])], columns=["break_index", "mean_before", "mean_after"])

    return _grouped(regular(df, ts, value, group), list(group), "break_index long, mean_before double, mean_after double", fit)


def _ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients, their standard errors and the residual sum of squares."""
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    r = y - x @ b
    rss = float(r @ r)
    cov = np.linalg.pinv(x.T @ x) * rss / max(1, len(y) - x.shape[1])
    return b, np.sqrt(np.maximum(np.diag(cov), 0)), rss


def _solved(a: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """As ``_ols``, from the sums of products of the columns and, last, the target over ``n`` rows."""
    xx, xy = a[:-1, :-1], a[:-1, -1]
    scale = np.sqrt(np.maximum(np.diag(xx), 1e-300))
    inv = np.linalg.pinv(xx / np.outer(scale, scale), hermitian=True) / np.outer(scale, scale)
    b = inv @ xy
    rss = max(float(a[-1, -1] - b @ xy), 0.0)
    return b, np.sqrt(np.maximum(np.diag(inv) * rss / max(1, n - len(b)), 0)), rss


def _ols_sums(cols: list[np.ndarray], y: np.ndarray, step: int = 65_536) -> tuple[np.ndarray, np.ndarray, float]:
    """``_ols`` over columns that are never stacked whole: their products are summed piece by piece."""
    a = np.zeros((len(cols) + 1, len(cols) + 1))
    for i in range(0, len(y), step):
        x = np.column_stack([*[c[i : i + step] for c in cols], y[i : i + step]])
        a += x.T @ x
    return _solved(a, len(y))


def _products(series: DataFrame, group: list[str], names: list[str]) -> DataFrame:
    """(groups, n, m): rows that have all of ``names``, and the sums of their products by pairs, upper triangle by rows."""
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    full = series.dropna(subset=names)
    return full.groupBy(*group).agg(F.count("*").alias("n"), F.array(*[F.sum(F.col(names[i]) * F.col(names[j])) for i, j in pairs]).alias("m"))


def _square(m, size: int) -> np.ndarray:
    a = np.zeros((size, size))
    a[np.triu_indices(size)] = np.asarray(m, dtype=float)
    return a + np.triu(a, 1).T


def _by_row(sums: DataFrame, group: list[str], schema: str, fn) -> DataFrame:
    """``fn`` of each row of sums gives a frame; the group's columns are put before it."""
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.schema if f.name in group)

    def run(batches):
        for p in batches:
            for r in p.to_dict("records"):
                out = fn(r)
                for g in reversed(group):
                    out.insert(0, g, r[g])
                yield out

    return sums.mapInPandas(run, f"{keys}, {schema}" if keys else schema)


def _joined(left: DataFrame, right: DataFrame, group: list[str]) -> DataFrame:
    """Both sides have one row a group at the right; null groups match."""
    on = F.expr(" AND ".join(f"a.`{c}` <=> b.`{c}`" for c in group) or "true")
    return left.alias("a").join(right.alias("b"), on).select("a.*", *[f"b.`{c}`" for c in right.columns if c not in group])


def adf_kpss(df: DataFrame, ts: str, value: str, group=()) -> DataFrame:
    """Augmented Dickey-Fuller t (constant, (n - 1)^(1/3) lags) and the KPSS level statistic, each with its verdict at 5 %."""

    def fit(y: np.ndarray) -> pd.DataFrame:
        n = len(y)
        if n < 8 or np.ptp(y) == 0:
            return pd.DataFrame({"n": [n], "adf": [None], "adf_stationary": [None], "kpss": [None], "kpss_stationary": [None]})
        lags = min(int((n - 1) ** (1 / 3)), n // 2 - 2)
        d = np.diff(y)
        cols = [np.ones(len(d) - lags), y[lags:-1]] + [d[lags - k : len(d) - k] for k in range(1, lags + 1)]
        b, se, _ = _ols_sums(cols, d[lags:])
        t = b[1] / se[1] if se[1] else None
        e = y - y.mean()
        m = int(4 * (n / 100) ** 0.25)
        lr = e @ e / n + 2 * sum((1 - k / (m + 1)) * (e[k:] @ e[:-k]) / n for k in range(1, m + 1))
        kp = float((e.cumsum() ** 2).sum() / n**2 / lr)
        return pd.DataFrame({"n": [n], "adf": [t], "adf_stationary": [None if t is None else bool(t < ADF_5PCT)], "kpss": [kp], "kpss_stationary": [bool(kp < KPSS_5PCT)]})

    return _grouped(regular(df, ts, value, group), list(group), "n long, adf double, adf_stationary boolean, kpss double, kpss_stationary boolean", fit)


def acf_pacf(df: DataFrame, ts: str, value: str, nlags: int = 10, group=()) -> DataFrame:
    """(lag, acf, pacf) for lags 0..nlags; partial ones by the Durbin-Levinson recursion."""

    g = list(group)
    rows = _staged(df, ts, value, g)
    mean = rows.groupBy(*g).agg(F.avg("y").alias("_mean"))
    f = frames.rolling(_joined(rows, mean, g).withColumn("e", F.col("y") - F.col("_mean")), g, ["i"], nlags)
    lagged = f.done(f.df.select("*", *[F.lag("e", k).over(f.order).alias(f"_e{k}") for k in range(1, nlags + 1)]))
    sums = lagged.groupBy(*g).agg(F.count("*").alias("n"), F.array(F.sum(F.col("e") * F.col("e")), *[F.coalesce(F.sum(F.col("e") * F.col(f"_e{k}")), F.lit(0.0)) for k in range(1, nlags + 1)]).alias("m"))

    def fit(row: dict) -> pd.DataFrame:
        if not row["n"]:
            return pd.DataFrame({"lag": [], "acf": [], "pacf": []})
        m = row["m"]
        r = np.array([1.0] + [float(x / m[0]) if m[0] > 0 else 0.0 for x in m[1:]])
        p, phi = [1.0], np.zeros(0)
        for k in range(1, nlags + 1):
            den = 1 - phi @ r[1:k] if k > 1 else 1.0
            a = (r[k] - (phi @ r[1:k][::-1] if k > 1 else 0.0)) / den if abs(den) > 1e-12 else 0.0
            phi = np.append(phi - a * phi[::-1], a)
            p.append(float(a))
        return pd.DataFrame({"lag": np.arange(nlags + 1), "acf": r, "pacf": p})

    return _by_row(sums, g, "lag long, acf double, pacf double", fit)


def _bounded(yhat: list[float], sd: float, grow: bool = True) -> pd.DataFrame:
    h = np.arange(1, len(yhat) + 1)
    w = 1.96 * sd * (np.sqrt(h) if grow else 1)
    return pd.DataFrame({"step": h, "yhat": yhat, "yhat_lower": yhat - w, "yhat_upper": yhat + w})


def arima(df: DataFrame, ts: str, value: str, order=(1, 1, 0), horizon: int = 7, group=()) -> DataFrame:
    """Autoregression of order p on the d-th difference by conditional least squares: (step, yhat, bounds). The moving-average
    order is taken up by that many further autoregressive terms."""
    p, d, q = order
    g, k = list(group), p + q
    rows = _staged(df, ts, value, g)
    f = frames.rolling(rows, g, ["i"], k + d)
    lag = lambda j: F.lag("y", j).over(f.order) if j else F.col("y")
    diff = lambda j: sum(((-1) ** i * math.comb(d, i) * lag(i + j) for i in range(1, d + 1)), lag(j))
    names = ["_c", *[f"_z{j}" for j in range(1, k + 1)], "_z0"]
    wide = f.done(f.df.select("*", F.lit(1.0).alias("_c"), *[diff(j).alias(f"_z{j}") for j in range(k + 1)]))
    # the end of a series, from which it is carried on, and the deviation of its steps
    count = rows.groupBy(*g).agg(F.count("*").alias("rows"))
    tail = _joined(rows, count, g).where(F.col("i") > F.col("rows") - (2 * k + d + 3)).groupBy(*g).agg(F.first("rows").alias("rows"), F.expr("transform(array_sort(collect_list(struct(i, y))), x -> x.y)").alias("tail"))
    sums = _products(wide, g, names)
    on = F.expr(" AND ".join(f"a.`{c}` <=> b.`{c}`" for c in g) or "true")
    both = tail.alias("a").join(sums.alias("b"), on, "left").select("a.*", "b.n", "b.m")

    def fit(row: dict) -> pd.DataFrame:
        y, nz = np.asarray(row["tail"], dtype=float), row["rows"] - d
        if nz < 2 * k + 3:
            return _bounded([float(y[-1])] * horizon, float(np.std(np.diff(y))) if len(y) > 1 else 0.0)
        b, _, rss = _solved(_square(row["m"], k + 2), int(row["n"]))
        run = list(np.diff(y, d) if d else y)
        known = len(run)
        for _ in range(horizon):
            run.append(float(b[0] + sum(b[j] * run[-j] for j in range(1, k + 1))))
        out = np.array(run[known:])
        for level in range(d - 1, -1, -1):
            out = np.diff(y, level)[-1] + out.cumsum()
        return _bounded(list(out), math.sqrt(rss / nz), d > 0)

    return _by_row(both, g, "step long, yhat double, yhat_lower double, yhat_upper double", fit)


def ets(df: DataFrame, ts: str, value: str, trend: bool = True, horizon: int = 7, group=()) -> DataFrame:
    """Exponential smoothing (level, and trend): the smoothing weights of least one-step error on a grid of tenths."""

    def walk(y: np.ndarray, a: float, b: float) -> tuple[float, float, float]:
        level, slope, err = y[0], (y[1] - y[0]) if trend and len(y) > 1 else 0.0, 0.0
        for v in y[1:]:
            e = v - level - slope
            err += e * e
            level, slope = level + slope + a * e, slope + a * b * e
        return err, level, slope

    def fit(y: np.ndarray) -> pd.DataFrame:
        if not len(y):
            return _bounded([], 0.0)
        grid = [(i / 10, j / 10) for i in range(1, 10) for j in (range(0, 10, 3) if trend else (0,))]
        err, level, slope = min((walk(y, a, b) for a, b in grid), key=lambda r: r[0])
        return _bounded([level + slope * h for h in range(1, horizon + 1)], math.sqrt(err / max(1, len(y) - 1)))

    return _grouped(regular(df, ts, value, group), list(group), "step long, yhat double, yhat_lower double, yhat_upper double", fit)


def forecast_anomalies(df: DataFrame, ts: str, value: str, lookback: int = 30, group=(), threshold: float = 3.0) -> DataFrame:
    """The last ``lookback`` points against the line fitted to all before: (i, y, yhat, residual, z_score, is_anomaly)."""

    g = list(group)
    rows = _staged(df, ts, value, g)
    count = rows.groupBy(*g).agg(F.count("*").alias("rows"), F.avg("y").alias("mean"))
    # i from 0; values and places are taken from their middle, so that the sums do not cancel
    placed = _joined(rows, count, g).select(*g, (F.col("i") - 1).alias("i"), "y", F.greatest(F.lit(2), F.col("rows") - lookback).alias("k"), "mean")
    early, x, v = F.col("i") < F.col("k"), F.col("i") - (F.col("k") - 1) / 2, F.col("y") - F.col("mean")
    when = lambda c: F.sum(F.when(early, c))
    sums = placed.groupBy(*g).agg(
        F.first("k").alias("k"), F.first("mean").alias("mean"), F.count_if(early).cast("double").alias("n"), when(x).alias("sx"), when(v).alias("sv"), when(x * x).alias("sxx"), when(x * v).alias("sxv"), when(v * v).alias("svv"),
    )
    det = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when(det > 0, (F.col("n") * F.col("sxv") - F.col("sx") * F.col("sv")) / det).otherwise(F.lit(0.0))
    line = sums.withColumn("b1", slope).withColumn("b0", (F.col("sv") - F.col("b1") * F.col("sx")) / F.col("n"))
    rss = F.greatest(F.col("svv") - F.col("b0") * F.col("sv") - F.col("b1") * F.col("sxv"), F.lit(0.0))
    line = line.select(*g, "b0", "b1", F.sqrt(rss / F.greatest(F.lit(1), F.col("k") - 2)).alias("sd"))
    judged = _joined(placed.where(~early), line, g)
    hat = F.col("mean") + F.col("b0") + F.col("b1") * x
    z = F.when(F.col("sd") > 0, (F.col("y") - hat) / F.col("sd")).otherwise(F.lit(0.0))
    return judged.select(*g, F.col("i").cast("long").alias("i"), "y", hat.alias("yhat"), (F.col("y") - hat).alias("residual"), z.alias("z_score"), (F.abs(z) > threshold).alias("is_anomaly"))


def monte_carlo(df: DataFrame, returns: str, simulations: int = 10_000, horizon: int = 30, seed: int = 42) -> DataFrame:
    """(p05, median_terminal, p95) of compounded normal returns with the column's mean and deviation, simulated in parallel."""
    spark = df.sparkSession
    m = df.agg(F.coalesce(F.avg(returns), F.lit(0.0)).alias("m"), F.coalesce(F.stddev_samp(returns), F.lit(0.0)).alias("s"))
    draws = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda h: h)
    sims = spark.range(simulations).join(F.broadcast(m)).select("id", "m", "s", F.explode(draws).alias("h"))
    u1 = (F.pmod(F.xxhash64("id", "h", F.lit(seed)), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    u2 = F.pmod(F.xxhash64("id", "h", F.lit(seed + 1)), F.lit(1 << 40)) / float(1 << 40)
    normal = F.sqrt(-2 * F.ln(u1)) * F.cos(2 * math.pi * u2)
    end = sims.groupBy("id").agg(F.sum(F.ln(F.greatest(1 + F.col("m") + F.col("s") * normal, F.lit(1e-9)))).alias("g")).select(F.exp("g").alias("x"))
    return end.agg(F.percentile("x", F.lit(0.05)).alias("p05"), F.percentile("x", F.lit(0.5)).alias("median_terminal"), F.percentile("x", F.lit(0.95)).alias("p95"))


def fit_distributions(df: DataFrame, value: str) -> DataFrame:
    """Maximum-likelihood normal, lognormal, exponential, uniform and Laplace fits from one pass of sums (Laplace: a second
    one around the median), best AIC first. Families that the values cannot come from are left out."""
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull())
    med = frames.quantiles(rows, v, [], {"med": 0.5})
    s = rows.join(F.broadcast(med)).agg(
        F.count("*").cast("double").alias("n"), F.avg(v).alias("m"), F.stddev_pop(v).alias("s"), F.min(v).alias("lo"), F.max(v).alias("hi"),
        F.avg(F.when(v > 0, F.ln(v))).alias("lm"), F.stddev_pop(F.when(v > 0, F.ln(v))).alias("ls"), F.first("med").alias("med"), F.avg(F.abs(v - F.col("med"))).alias("b"),
    )
    n = F.col("n")
    ln2pi = math.log(2 * math.pi)
    fits = {
        "normal": ("m", "s", 2, F.when(F.col("s") > 0, -n / 2 * (ln2pi + 1) - n * F.ln("s"))),
        "lognormal": ("lm", "ls", 2, F.when((F.col("lo") > 0) & (F.col("ls") > 0), -n / 2 * (ln2pi + 1) - n * F.ln("ls") - n * F.col("lm"))),
        "exponential": ("m", "m", 1, F.when((F.col("lo") >= 0) & (F.col("m") > 0), -n * F.ln("m") - n)),
        "uniform": ("lo", "hi", 2, F.when(F.col("hi") > F.col("lo"), -n * F.ln(F.col("hi") - F.col("lo")))),
        "laplace": ("med", "b", 2, F.when(F.col("b") > 0, -n * F.ln(2 * F.col("b")) - n)),
    }
    cells = F.array(*[F.struct(F.lit(k).alias("distribution"), F.col(a).alias("param1"), F.col(b).alias("param2"), ll.alias("log_likelihood"), (2 * p - 2 * ll).alias("aic")) for k, (a, b, p, ll) in fits.items()])
    return s.select(F.inline(cells)).where("aic IS NOT NULL").orderBy("aic")


def granger(df: DataFrame, ts: str, x: str, y: str, max_lag: int = 4, group=()) -> DataFrame:
    """Whether x helps to foretell y: F test of its lags per lag count, the least p over 1..max_lag with n >= 3 * lag.

    Lagged products are summed in Spark: each lag's regression is solved from one small matrix of sums, so no series is
    gathered.
    """
    f = frames.rolling(df.where(F.col(ts).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull()), list(group), [ts], max_lag)
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    shifted = {"_g_c": F.lit(1.0)}
    shifted |= {f"_g_y{k}": F.lag(ys, k).over(f.order) for k in range(1, max_lag + 1)}
    shifted |= {f"_g_x{k}": F.lag(xs, k).over(f.order) for k in range(1, max_lag + 1)}
    shifted["_g_t"] = ys
    wide, names = f.done(f.df.select("*", *[c.alias(n) for n, c in shifted.items()])), list(shifted)
    full = wide.dropna(subset=names)
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = full.groupBy(*group).agg(F.count("*").alias("n"), F.array(*[F.sum(F.col(names[i]) * F.col(names[j])) for i, j in pairs]).alias("m"))
    keys = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in sums.schema if c.name in group)

    def solve(batches):
        for p in batches:
            rows = []
            for r in p.to_dict("records"):
                size = len(names)
                a = np.zeros((size, size))
                for (i, j), v in zip(pairs, r["m"]):
                    a[i, j] = a[j, i] = v
                best = None
                for lag in range(1, max_lag + 1):
                    n = r["n"]
                    if n < 3 * lag or n - 2 * lag - 1 <= 0:
                        continue
                    own = [0, *range(1, lag + 1)]
                    both = [*own, *range(max_lag + 1, max_lag + 1 + lag)]
                    rss = []
                    for use in (own, both):
                        b = np.linalg.pinv(a[np.ix_(use, use)]) @ a[use, -1]
                        rss.append(max(a[-1, -1] - b @ a[use, -1], 1e-12))
                    stat = (rss[0] - rss[1]) / lag / (rss[1] / (n - 2 * lag - 1))
                    pv = f_sf(float(stat), lag, n - 2 * lag - 1)
                    if best is None or pv < best[0]:
                        best = (pv, lag, float(stat))
                rows.append([*[r[g] for g in group], r["n"], *(best or (None, None, None))])
            yield pd.DataFrame(rows, columns=[*group, "n", "p_value", "best_lag", "f_statistic"])

    return sums.mapInPandas(solve, (keys + ", " if keys else "") + "n long, p_value double, best_lag long, f_statistic double")
