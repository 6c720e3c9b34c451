"""Isolation forest: how few random cuts set a row apart."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from brindle.operators.sampling import sample_rows

TREES, SAMPLE = 100, 256


def _expected(n: int) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """One tree as rows (column, cut, left, right, length); leaves have column -1 and the path length that ends there."""
    top, nodes = math.ceil(math.log2(max(2, len(x)))), []

    def add(part: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append(None)
        wide = np.flatnonzero(np.ptp(part, axis=0) > 0) if len(part) > 1 else []
        if depth >= top or not len(wide):
            nodes[at] = (-1, 0.0, 0, 0, depth + _expected(len(part)))
            return at
        c = int(rng.choice(wide))
        cut = rng.uniform(part[:, c].min(), part[:, c].max())
        below = part[:, c] < cut
        nodes[at] = (c, cut, add(part[below], depth + 1), add(part[~below], depth + 1), 0.0)
        return at

    add(x, 0)
    return np.array(nodes, dtype=float)


def lengths(tree: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), dtype=np.int64)
    while True:
        c = tree[at, 0].astype(np.int64)
        inner = c >= 0
        if not inner.any():
            return tree[at, 4]
        i = np.flatnonzero(inner)
        left = x[i, c[i]] < tree[at[i], 1]
        at[i] = np.where(left, tree[at[i], 2], tree[at[i], 3]).astype(np.int64)


def iforest_score(df: DataFrame, columns: list[str], key: str, trees: int = TREES, sample: int = SAMPLE, seed: int = 7, threshold: float = 0.6) -> DataFrame:
    """Adds ``iforest_score`` (0 to 1, high for rows set apart early) and ``is_anomaly`` (from ``threshold`` on).

    Each tree is grown, as the method says, from a seeded sample of ``sample`` rows with all columns set, so the driver holds
    ``trees * sample`` rows whatever the table's size; every row is scored. Rows with a null or NaN in a column have a null
    score and are no anomalies. A table without complete rows has null scores only.
    """
    number = {c: F.col(c).cast("double") for c in columns}
    full = df.select(F.col(key), *[v.alias(f"_x{i}") for i, v in enumerate(number.values())]).dropna()
    rows = sample_rows(full, F.col(key), trees * sample, seed).drop(key).toPandas().to_numpy(dtype=float)
    if not len(rows):
        return df.withColumn("iforest_score", F.lit(None).cast("double")).withColumn("is_anomaly", F.lit(False))
    rng = np.random.default_rng(seed)
    size = min(sample, len(rows))
    forest = df.sparkSession.sparkContext.broadcast(([grow(rows[rng.choice(len(rows), size, replace=False)], rng) for _ in range(trees)], _expected(size)))

    @F.pandas_udf("double")
    def score(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
        grown, mean = forest.value
        ok = ~np.isnan(x).any(axis=1)
        out = np.full(len(x), np.nan)
        if ok.any():
            out[ok] = 2.0 ** (-sum(lengths(t, x[ok]) for t in grown) / len(grown) / max(mean, 1e-9))
        return pd.Series(out)

    s = F.nanvl(score(*number.values()), F.lit(None).cast("double"))
    return df.withColumn("iforest_score", s).withColumn("is_anomaly", F.coalesce(F.col("iforest_score") >= threshold, F.lit(False)))
