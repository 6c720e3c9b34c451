"""Causal screening: direction votes of several tests and their verdict."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from brindle.functions.expr import safe_corr, safe_div
from brindle.functions.special import norm_sf, p_normal
from brindle.operators import frames
from brindle.operators.features import regression_features


def dependence(df: DataFrame, x: str, y: str, given: str | None = None) -> DataFrame:
    """Fisher-z test of (partial) correlation: (n, correlation, p_value)."""
    s = df.agg(F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull()).alias("n"), safe_corr(x, y).alias("xy"), *([safe_corr(x, given).alias("xz"), safe_corr(y, given).alias("yz")] if given else []))
    r = F.col("xy") if not given else safe_div(F.col("xy") - F.col("xz") * F.col("yz"), F.sqrt((1 - F.col("xz") * F.col("xz")) * (1 - F.col("yz") * F.col("yz"))))
    s = s.withColumn("correlation", r)
    z = F.when(F.abs("correlation") < 1, F.atanh("correlation") * F.sqrt(F.col("n") - (4 if given else 3)))
    return s.select("n", "correlation", p_normal(z).alias("p_value"))


def direction(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pairwise non-Gaussian direction: the sign of rho * (E[x^3 y] - E[x y^3]) over standardized values, corrected for the
    skewness's sign by fourth moments; one pass of sums. (n, correlation, score, direction 'forward', 'backward' or 'none')."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    m = rows.agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"), safe_corr("x", "y").alias("r"))
    u, v = safe_div(F.col("x") - F.col("mx"), "sx"), safe_div(F.col("y") - F.col("my"), "sy")
    s = rows.join(F.broadcast(m)).agg(F.first("n").alias("n"), F.first("r").alias("correlation"), F.avg(u * u * u * v).alias("a"), F.avg(u * v * v * v).alias("b"), F.avg(u * u * u * u).alias("ku"), F.avg(v * v * v * v).alias("kv"))
    score = F.col("correlation") * ((F.col("a") - F.col("b")) * F.signum(F.greatest(F.col("ku"), F.col("kv")) - 3))
    s = s.select("n", "correlation", F.coalesce(score, F.lit(0.0)).alias("score"))
    return s.withColumn("direction", F.when(F.col("score") > 1e-6, "forward").when(F.col("score") < -1e-6, "backward").otherwise("none"))


def verdicts(findings: DataFrame, candidates: DataFrame, min_rows: int = 30, least: int = 2) -> DataFrame:
    """Candidates (candidate_id, n_rows) with ``decision`` from findings (candidate_id, algorithm, direction).

    At least ``least`` algorithms forward and more than backward: validated. Backward only, or nothing found: rejected. Both
    ways without a winner, one forward only, or too few rows: inconclusive.
    """
    votes = findings.groupBy("candidate_id").agg(F.count_distinct(F.when(F.col("direction") == "forward", F.col("algorithm"))).alias("fwd"), F.count_distinct(F.when(F.col("direction") == "backward", F.col("algorithm"))).alias("bwd"))
    j = candidates.join(votes, "candidate_id", "left").fillna(0, ["fwd", "bwd"])
    f, b = F.col("fwd"), F.col("bwd")
    d = F.when(F.col("n_rows") < min_rows, "inconclusive").when((f >= least) & (f > b), "validated").when((f == 0), "rejected").otherwise("inconclusive")
    return j.withColumn("decision", d)


def correlations(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray]:
    """Complete rows and their correlation matrix, from one pass of sums; constant columns correlate with nothing."""
    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).dropna()
    names = [f"c{i}" for i in range(len(columns))]
    pairs = list(combinations(range(len(names)), 2))
    s = rows.agg(F.count("*").alias("n"), *[F.coalesce(safe_corr(names[i], names[j]), F.lit(0.0)).alias(f"r{i}_{j}") for i, j in pairs]).first()
    r = np.eye(len(names))
    for i, j in pairs:
        r[i, j] = r[j, i] = s[f"r{i}_{j}"]
    return s["n"], r


def _p_partial(r: np.ndarray, n: int, i: int, j: int, given: tuple[int, ...]) -> float:
    """Two-sided p of the partial correlation, by Fisher's z."""
    use = [i, j, *given]
    inv = np.linalg.pinv(r[np.ix_(use, use)])
    x = -inv[0, 1] / np.sqrt(max(inv[0, 0] * inv[1, 1], 1e-300))
    if n - len(given) - 3 <= 0:
        return 1.0
    return 2 * norm_sf(abs(np.arctanh(np.clip(x, -1 + 1e-12, 1 - 1e-12))) * np.sqrt(n - len(given) - 3))


def _skeleton(r: np.ndarray, n: int, alpha: float, may=lambda i, j: True) -> tuple[set[tuple[int, int]], dict[tuple[int, int], tuple[int, ...]]]:
    k = len(r)
    near = {i: {j for j in range(k) if j != i and may(i, j)} for i in range(k)}
    apart: dict[tuple[int, int], tuple[int, ...]] = {}
    size = 0
    while any(len(near[i]) - 1 >= size for i in near):
        before = {i: set(v) for i, v in near.items()}
        for i, j in combinations(range(k), 2):
            if j not in near[i]:
                continue
            for of, other in ((i, j), (j, i)):
                found = next((g for g in combinations(sorted(before[of] - {other}), size) if _p_partial(r, n, i, j, g) > alpha), None)
                if found is not None:
                    near[i].discard(j)
                    near[j].discard(i)
                    apart[i, j] = found
                    break
        size += 1
    return {(i, j) for i in near for j in near[i] if i < j}, apart


def pc_structure(df: DataFrame, columns: list[str], alpha: float = 0.05) -> DataFrame:
    """(source, target, kind) of the PC algorithm: 'directed' edges and 'undirected' ones (source before target by name).

    Rows are read once, for the correlation matrix; the search itself is over the named columns. Edges fall by Fisher-z
    tests given ever larger sets of neighbours (the sets of a size are taken before any falls, so the order of columns does
    not matter), colliders are directed, then what would make a new collider or a cycle.
    """
    n, r = correlations(df, columns)
    edges, apart = _skeleton(r, n, alpha)
    near = lambda i, j: (min(i, j), max(i, j)) in edges
    into: set[tuple[int, int]] = set()
    for i, j in combinations(range(len(columns)), 2):
        if not near(i, j):
            for k in range(len(columns)):
                if k not in (i, j) and near(i, k) and near(j, k) and k not in apart.get((i, j), ()) and (k, i) not in into and (k, j) not in into:
                    into |= {(i, k), (j, k)}
    while True:
        new = set()
        for a, b in edges:
            for x, y in ((a, b), (b, a)):
                if (x, y) in into or (y, x) in into:
                    continue
                if any((z, x) in into and z != y and not near(z, y) for z in range(len(columns))) or any((x, z) in into and (z, y) in into for z in range(len(columns))):
                    new.add((x, y))
        new = {e for e in new if (e[1], e[0]) not in new}
        if not new:
            break
        into |= new
    rows = [(columns[a], columns[b], "directed") for a, b in sorted(into)]
    rows += [(*sorted((columns[a], columns[b])), "undirected") for a, b in sorted(edges) if (a, b) not in into and (b, a) not in into]
    return df.sparkSession.createDataFrame(rows, "source string, target string, kind string")


def lagged_links(df: DataFrame, ts: str, columns: list[str], max_lag: int = 2, alpha: float = 0.05, tie=()) -> DataFrame:
    """(source, lag, target, correlation, p_value): links from the past that stay when both ends' other parents are given.

    Two steps, as in momentary conditional independence: the parents of each series among all lags by the skeleton search, then
    a test of every lagged pair given the parents of both ends. Lags are columns of the same rows, made by one ordered
    window; the matrix of their correlations is one pass. A link from or to a constant series is never found.
    """
    f = frames.rolling(df.dropna(subset=[ts, *columns]), [], [ts, *tie], 2 * max_lag)
    wide = f.done(f.df.select("*", *[F.lag(F.col(c).cast("double"), k).over(f.order).alias(f"_{i}_{k}") for i, c in enumerate(columns) for k in range(1, 2 * max_lag + 1)]))
    at = {(i, k): p for p, (i, k) in enumerate((i, k) for i in range(len(columns)) for k in range(2 * max_lag + 1))}
    n, r = correlations(wide, [columns[i] if k == 0 else f"_{i}_{k}" for i, k in at])
    past = [(i, k) for i in range(len(columns)) for k in range(1, max_lag + 1)]
    parents: dict[int, list[tuple[int, int]]] = {}
    for j in range(len(columns)):
        kept = sorted(past, key=lambda x: -abs(r[at[x], at[j, 0]]))
        for size in range(len(past)):
            drop = [x for x in kept if len(kept) - 1 >= size and _p_partial(r, n, at[x], at[j, 0], tuple(at[y] for y in kept if y != x)[:size]) > alpha]
            kept = [x for x in kept if x not in drop]
            if size >= len(kept) - 1:
                break
        parents[j] = kept
    rows = []
    for i, k in past:
        for j in range(len(columns)):
            given = {at[x] for x in parents[j] if x != (i, k)} | {at[a, b + k] for a, b in parents[i]}
            given = tuple(sorted(given - {at[i, k], at[j, 0]}))
            p = _p_partial(r, n, at[i, k], at[j, 0], given)
            if p <= alpha:
                rows.append((columns[i], k, columns[j], float(r[at[i, k], at[j, 0]]), float(p)))
    return df.sparkSession.createDataFrame(rows, "source string, lag int, target string, correlation double, p_value double")


def _effect(df: DataFrame, treatment: Column, outcome: Column, covariates: list[Column]) -> float | None:
    rows = df.select(treatment.cast("double").alias("t"), outcome.cast("double").alias("y"), *[c.cast("double").alias(f"c{i}") for i, c in enumerate(covariates)]).dropna()
    names = ["t", *[f"c{i}" for i in range(len(covariates))]]
    m = rows.agg(regression_features(rows, names, "y").alias("m")).first()["m"]
    size = len(names) + 2
    a = np.zeros((size, size))
    if m[0] is None:
        return None
    a[np.triu_indices(size)] = m
    a = a + np.triu(a, 1).T
    return float((np.linalg.pinv(a[:-1, :-1]) @ a[:-1, -1])[1])


def refute(df: DataFrame, treatment: str, outcome: str, covariates: list[str], key: str, seed: int = 11) -> DataFrame:
    """(test, estimate, new_effect, holds): an effect by regression on covariates, held against two attacks.

    'random_common_cause' adds a covariate drawn by a hash of ``key``: the effect should stay (within a tenth).
    'placebo_treatment' puts such a draw in the treatment's place: the effect should vanish (to a tenth). Both draws
    are the same however rows are partitioned. Rows with a null are left out; without rows effects are null.
    """
    draw = lambda k: (F.pmod(F.xxhash64(key, F.lit(seed + k)), F.lit(1 << 20)) / float(1 << 20)).cast("double")
    t, y, c = F.col(treatment), F.col(outcome), [F.col(x) for x in covariates]
    est = _effect(df, t, y, c)
    spread = df.agg(F.stddev_pop(F.col(treatment).cast("double"))).first()[0]
    more, fake = _effect(df, t, y, [*c, draw(0)]), _effect(df, draw(1), y, c)
    # a uniform draw has a deviation of 12^-1/2: effects are compared per deviation
    weak = None if None in (est, fake, spread) else abs(fake) * 12**-0.5 <= 0.1 * abs(est) * spread
    rows = [("random_common_cause", est, more, None if None in (est, more) else abs(more - est) <= 0.1 * abs(est)), ("placebo_treatment", est, fake, weak)]
    return df.sparkSession.createDataFrame(rows, "test string, estimate double, new_effect double, holds boolean")
