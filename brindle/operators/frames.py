"""Ordered windows whose work is not tied to the size of one group.

A window by group sorts each group in one task, which is fine up to ``BLOCK_ROWS`` rows. A larger group is cut into
blocks along its order: rows are numbered by a two-level count, a rolling frame's block also gets the few rows before
(or after) it that its frames reach into, and a cumulative frame adds the totals of the blocks before. Both ways give the
same rows; the sizes of the groups decide, found by one pre-aggregated count.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window, WindowSpec, functions as F

from brindle.session import Stage

BLOCK_ROWS = 2_000_000


def largest_group(df: DataFrame, group: list[str]) -> int:
    counts = df.groupBy(*group).agg(F.count("*").alias("n")) if group else df.agg(F.count("*").alias("n"))
    return counts.agg(F.max("n")).first()[0] or 0


def number_rows(df: DataFrame, group: list[str], order: list[Column | str], name: str = "rn") -> DataFrame:
    """``name``: 1, 2, ... within each group in the given order, without a group in one task.

    Rows are range-partitioned by group and order, numbered within a range, and moved up by the rows of the ranges before.
    The order must be total (end in a unique column) for the numbers to be reproducible.
    """
    stage = Stage(df.sparkSession, "number")
    keys = [F.col(g) for g in group] + [F.col(o) if isinstance(o, str) else o for o in order]
    placed = stage.put(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))
    by = [*group, "_range"]
    totals = placed.groupBy(*by).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by).orderBy(*order)
    numbered = placed.withColumn(name, F.row_number().over(inside)).alias("a")
    on = F.expr(" AND ".join(f"a.`{c}` <=> b.`{c}`" for c in by))
    return numbered.join(offsets.alias("b"), on).select("a.*", "b._before").withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_range", "_before")


@dataclass
class Frame:
    """``df`` to compute on, the window to use, and ``done`` to drop what was added."""

    df: DataFrame
    window: WindowSpec
    order: WindowSpec
    extra: tuple[str, ...] = ()
    blocked: bool = False

    def done(self, out: DataFrame) -> DataFrame:
        if self.blocked:
            out = out.where("_own")
        return out.drop(*self.extra)


def rolling(df: DataFrame, group: list[str], order: list[Column | str], before: int, after: int = 0, block_rows: int | None = None) -> Frame:
    """Frame of ``before`` rows up to and ``after`` rows past the current one, within the group."""
    block = block_rows or BLOCK_ROWS
    if largest_group(df, group) <= block:
        base = Window.partitionBy(*group).orderBy(*order)
        return Frame(df, base.rowsBetween(-before, after), base)
    numbered = number_rows(df, group, order, "_rn")
    home = F.floor((F.col("_rn") - 1) / block)
    reach = F.sequence(F.floor((F.col("_rn") - 1 - after) / block), F.floor((F.col("_rn") - 1 + before) / block))
    spread = numbered.withColumn("_block", F.explode(F.filter(reach, lambda b: b >= 0))).withColumn("_own", F.col("_block") == home)
    base = Window.partitionBy(*group, "_block").orderBy("_rn")
    return Frame(spread, base.rowsBetween(-before, after), base, ("_rn", "_block", "_own"), True)


def cumulative(df: DataFrame, group: list[str], order: list[Column | str], what: dict[str, tuple[str, Column]], block_rows: int | None = None) -> DataFrame:
    """Adds running 'sum', 'count', 'min', 'max', 'product' or 'last' (the last value that is not null) columns per group.

    ``what`` maps a new column to (kind, column). Nulls are skipped, as by the aggregates themselves.
    """
    block = block_rows or BLOCK_ROWS
    agg: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "product": F.product, "last": lambda c: F.last(c, ignorenulls=True)}
    if largest_group(df, group) <= block:
        w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[agg[k](c).over(w).alias(n) for n, (k, c) in what.items()])
    numbered = number_rows(df, group, order, "_rn").withColumn("_block", F.floor((F.col("_rn") - 1) / block))
    w = Window.partitionBy(*group, "_block").orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
    inside = numbered.select("*", *[agg[k](c).over(w).alias(n) for n, (k, c) in what.items()])
    totals = numbered.groupBy(*group, "_block").agg(*[(F.max_by(c, F.when(c.isNotNull(), F.col("_rn"))) if k == "last" else agg[k](c)).alias(f"_t_{n}") for n, (k, c) in what.items()])
    merge = agg | {"count": F.sum}
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*group, "_block", *[merge[k](F.col(f"_t_{n}")).over(before).alias(f"_b_{n}") for n, (k, _) in what.items()])
    on = F.expr(" AND ".join(f"a.`{c}` <=> b.`{c}`" for c in [*group, "_block"]))
    joined = inside.alias("a").join(bases.alias("b"), on).select("a.*", *[f"b._b_{n}" for n in what])

    def both(n: str, kind: str) -> Column:
        a, b = F.col(n), F.col(f"_b_{n}")
        one = F.coalesce(a, b)
        two = {"sum": a + b, "count": a + b, "min": F.least(a, b), "max": F.greatest(a, b), "product": a * b, "last": a}[kind]
        return F.when(a.isNotNull() & b.isNotNull(), two).otherwise(one)

    out = joined.withColumns({n: both(n, k) for n, (k, _) in what.items()})
    return out.drop("_rn", "_block", *[f"_b_{n}" for n in what])


def quantiles(df: DataFrame, value: Column, group: list[str], probs: dict[str, float], block_rows: int | None = None) -> DataFrame:
    """(groups, a column for each of ``probs``): exact quantiles, interpolated between the two nearest rows.

    They come from the counts per distinct value, so the rows of a group are never gathered. Up to ``block_rows`` counts in
    all, each group's are sorted in one task; beyond, running sums in blocks give the places. Null values are left out; a
    group of nulls only has null quantiles, no rows no group.
    """
    names = {g: f"_g{i}" for i, g in enumerate(group)}
    keys = list(names.values())
    counts = df.select(*[F.col(f"`{g}`").alias(k) for g, k in names.items()], value.cast("double").alias("_v")).groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    seen = Observation()
    counts = Stage(df.sparkSession, "quantiles").put(counts.observe(seen, F.count(F.lit(1)).alias("n")))
    if seen.get["n"] <= (block_rows or BLOCK_ROWS):
        at = counts.groupBy(*keys).agg(F.percentile("_v", F.array(*map(F.lit, probs.values())), F.col("_n")).alias("_q"))
        return at.select(*[F.col(k).alias(g) for g, k in names.items()], *[F.col("_q")[i].alias(n) for i, n in enumerate(probs)])
    run = cumulative(counts.where("_v IS NOT NULL"), keys, ["_v"], {"_to": ("sum", F.col("_n"))}, block_rows)
    total = counts.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("_v").isNotNull(), F.col("_n"))), F.lit(0)).alias("_all"))
    on = F.expr(" AND ".join(f"a.`{k}` <=> b.`{k}`" for k in keys) or "true")
    both = total.alias("a").join(run.alias("b"), on, "left").select("a.*", "_v", "_n", "_to")
    place = {n: p * (F.col("_all") - 1) for n, p in probs.items()}
    at = lambda k: F.max(F.when((F.col("_to") > k) & (F.col("_to") - F.col("_n") <= k), F.col("_v")))
    ends = both.groupBy(*keys, "_all").agg(*[at(near(place[n])).alias(f"_{e}{i}") for i, n in enumerate(probs) for e, near in (("lo", F.floor), ("hi", F.ceil))])
    between = lambda i, n: F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (place[n] - F.floor(place[n]))
    return ends.select(*[F.col(k).alias(g) for g, k in names.items()], *[between(i, n).alias(n) for i, n in enumerate(probs)])
