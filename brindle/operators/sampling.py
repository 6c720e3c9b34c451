"""Seeded samples that do not depend on how rows are partitioned: a row's draw is a hash of its key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F


def _draw(key: Column, seed: int) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}")).cast("binary"))


def sample_share(df: DataFrame, key: Column, share: float, seed: int = 1) -> DataFrame:
    """Each row by itself with probability ``share``; rows of one key come or stay out together, null keys stay out."""
    if not 0 <= share <= 1:
        raise ValueError("a share lies between 0 and 1")
    if share == 1:
        return df.where(key.isNotNull())
    return df.where(F.substring(_draw(key, seed), 1, 12) < F.lit(f"{int(share * 16**12):012x}"))


def sample_rows(df: DataFrame, key: Column, n: int, seed: int = 1) -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer): those of the smallest draws, ties by key.

    One count of the rows gives a bound that about n draws lie under; only rows under it are sorted. In the rare case that
    too few are, or that null keys leave fewer than n, all rows take part. ``n`` is the feature: the result is a sample.
    """
    some = df.where(key.isNotNull())
    total = some.count()
    share = (n + 6 * math.sqrt(n) + 6) / max(1, total)
    near = some if share >= 1 else sample_share(some, key, share, seed)
    if share < 1 and near.limit(n).count() < n:
        near = some
    return near.orderBy(_draw(key, seed), key).limit(n)
