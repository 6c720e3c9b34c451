"""Per-key work whose time is not ruled by a few heavy keys.

Keys are packed to tasks by estimated load. A key that is larger than a task's fair share is split into shards in
proportion to its load, the others go to tasks in hash buckets that are bin-packed (largest first) beside the shards.
The side that is joined is replicated only to the shards of a split key.

The driver sees a bounded plan, however many keys there are: at most ``tasks`` keys can exceed the fair share, and the
remaining keys appear as ``tasks * BUCKETS_PER_TASK`` bucket sums.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BUCKETS_PER_TASK = 8


def partition_labels(spark: SparkSession, tasks: int) -> list[int]:
    """For each partition an int that hash partitioning over ``tasks`` partitions sends exactly there."""
    span = max(64, tasks * 24)
    while True:
        rows = (
            spark.range(span).select(F.col("id").cast("int").alias("i")).select("i", F.pmod(F.hash("i"), F.lit(tasks)).alias("p"))
            .groupBy("p").agg(F.min("i").alias("i")).collect()
        )
        if len(rows) == tasks:
            return [i for _, i in sorted((r["p"], r["i"]) for r in rows)]
        span *= 2


@dataclass(frozen=True)
class Plan:
    """``split``: key (text) to the labels of its shards; ``bucket``: label of each hash bucket of the other keys."""

    tasks: int
    split: dict[str, list[int]]
    bucket: list[int]
    loads: list[int]

    @property
    def balance(self) -> float:
        """Largest planned load over the mean one."""
        return max(self.loads) * len(self.loads) / max(1, sum(self.loads))

    def label(self, key: Column, spread: Column) -> Column:
        """Label of a row: its bucket's, or that of the shard which ``spread`` (a hash) picks."""
        own = _own(self, key)
        if not self.split:
            return own
        shards = _shards(self, key)
        return F.when(shards.isNull(), own).otherwise(F.element_at(shards, F.pmod(spread, F.size(shards)).cast("int") + 1))

    def labels(self, key: Column) -> Column:
        """All labels that rows of a key can have, once each: where the other side of a join is needed."""
        own = F.array(_own(self, key))
        return F.array_distinct(F.coalesce(_shards(self, key), own)) if self.split else own


def _own(plan: Plan, key: Column) -> Column:
    """Label of a key's bucket. The plan is one text that is folded to one literal, not an expression per bucket."""
    return F.element_at(F.split(F.lit(",".join(map(str, plan.bucket))), ",").cast("array<int>"), _bucket(key, len(plan.bucket)) + 1)


def _shards(plan: Plan, key: Column) -> Column:
    return F.from_json(F.lit(json.dumps(plan.split)), "map<string,array<int>>")[key.cast("string")]


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def plan(df: DataFrame, key: str, tasks: int | None = None) -> Plan:
    """Packs the keys of ``df`` to tasks by their row counts; null keys take no part."""
    spark = df.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = tasks * BUCKETS_PER_TASK
    loads = df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("k")).agg(F.count("*").alias("n"))
    b = F.pmod(F.xxhash64("k"), F.lit(buckets)).cast("int")
    # one pass over key counts: per bucket its sum and its keys above the fair share, which the total then confirms
    total = loads.groupBy(b.alias("b")).agg(F.sum("n").alias("n"))
    sums = {r["b"]: r["n"] for r in total.collect()}
    fair = max(1, -(-sum(sums.values()) // tasks))
    heavy = {r["k"]: r["n"] for r in loads.where(F.col("n") > fair).select("k", "n", b.alias("b")).collect()} if sums and max(sums.values()) > fair else {}
    homes = {}
    if heavy:
        rows = spark.createDataFrame([(k,) for k in heavy], "k string").select("k", b.alias("b")).collect()
        homes = {r["k"]: r["b"] for r in rows}
    for k, n in heavy.items():
        sums[homes[k]] -= n
    names = partition_labels(spark, tasks)
    pieces = [(n / -(-n // fair), ("k", k)) for k, n in heavy.items() for _ in range(-(-n // fair))]
    pieces += [(sums.get(i, 0), ("b", i)) for i in range(buckets)]
    bins = [(0.0, t) for t in range(tasks)]
    heapq.heapify(bins)
    split: dict[str, list[int]] = {k: [] for k in heavy}
    bucket = [names[0]] * buckets
    load = [0.0] * tasks
    for n, (kind, x) in sorted(pieces, key=lambda p: (-p[0], str(p[1]))):
        at, t = heapq.heappop(bins)
        if kind == "k":
            split[x].append(names[t])
        else:
            bucket[x] = names[t]
        load[t] = at + n
        heapq.heappush(bins, (load[t], t))
    return Plan(tasks, split, bucket, [round(x) for x in load])


def key_stats(df: DataFrame, key: str, other: str, moment: str, name: str | None = None, how: Plan | None = None) -> DataFrame:
    """Per key: rows, distinct non-null values of ``other``, greatest ``moment``.

    Result: (field_name, key_value bigint, n_rows, n_distinct, last_moment). Rows with a null key belong to no key and
    give no row; a null ``other`` counts as a row but not as a value; repeated rows count. Rows of a split key are
    sharded by ``other``, so each (key, other) pair lies in one shard and the shards' distinct counts add up.

    One shuffle carries the rows, by task label; the counts per (task, key, other) need none, and the second shuffle
    has one row per key and shard.
    """
    how = how or plan(df, key)
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(other).alias("o"), F.col(moment).alias("m"))
    placed = rows.withColumn("t", how.label(F.col("k"), F.xxhash64("o"))).repartition(how.tasks, "t")
    shard = (
        placed.groupBy("t", "k", "o").agg(F.count("*").alias("n"), F.max("m").alias("m"))
        .groupBy("t", "k").agg(F.sum("n").alias("n"), F.count("o").alias("d"), F.max("m").alias("m"))
    )
    return shard.groupBy("k").agg(F.sum("n").alias("n_rows"), F.sum("d").alias("n_distinct"), F.max("m").alias("last_moment")).select(
        F.lit(name or key).alias("field_name"), F.col("k").alias("key_value"), "n_rows", "n_distinct", "last_moment"
    )


def fragment_replicate_join(left: DataFrame, right: DataFrame, key: str, how: Plan | None = None, kind: str = "inner", spread: Column | None = None) -> DataFrame:
    """Equi-join on ``key`` with left rows spread over their key's shards and right rows sent to exactly those.

    ``kind`` is 'inner', 'left' or 'left_semi'/'left_anti'. Null keys match nothing: with 'left' and 'left_anti' such
    rows are kept apart and come back unmatched. Every left row meets each right row of its key once. ``right`` must not
    share column names with ``left`` other than the key; both sides may repeat keys. For 'left_semi' and 'left_anti' the
    right side counts by its distinct keys. Keys that are heavy on the right alone are split there, and the left rows sent
    to their shards instead.
    """
    if kind not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"no such kind of join: {kind}")
    clash = (set(left.columns) & set(right.columns)) - {key}
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    how = how or plan(left, key)
    if kind in ("left_semi", "left_anti"):
        right = right.select(key).distinct()
    else:
        theirs = plan(right, key, how.tasks)
        other = {k: s for k, s in theirs.split.items() if k not in how.split}
        if other:
            # these keys have right rows, so that 'left' is 'inner' there; the plan names at most as many keys as tasks
            there = F.col(key).cast("string").isin(list(other))
            turned = fragment_replicate_join(right.where(there), left.where(there), key, Plan(how.tasks, other, theirs.bucket, theirs.loads), "inner")
            out = fragment_replicate_join(left.where(there.isNull() | ~there), right.where(~there), key, how, kind, spread)
            return out.unionByName(turned.select(out.columns))
    some = left.where(F.col(key).isNotNull())
    spread = F.xxhash64(*[F.col(c) for c in left.columns if c != key]) if spread is None else spread
    a = some.withColumn("_task", how.label(F.col(key), spread)).repartition(how.tasks, "_task")
    b = right.where(F.col(key).isNotNull()).withColumn("_task", F.explode(how.labels(F.col(key)))).repartition(how.tasks, "_task")
    out = a.join(b.hint("shuffle_hash"), ["_task", key], kind).drop("_task")
    if kind in ("left", "left_anti"):
        out = out.unionByName(left.where(F.col(key).isNull()), allowMissingColumns=True)
    return out


HOT = 1 / 1000


def split_join(rows: DataFrame, keyed: DataFrame, on: list[str], n: str, share: float = HOT) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, whose column ``n`` tells how many rows a key has, about.

    Keys with more than ``share`` of all these rows are at most 1 / ``share``, however large the data: they are broadcast.
    The others are shuffled, and none of them fills more than that share of a task's rows. ``keyed`` may repeat a key a
    few times; the broadcast is bounded by that many times 1 / ``share`` rows. Null keys match nothing; ``n`` is dropped.
    """
    total = keyed.agg(F.sum(n)).first()[0] or 0
    hot = F.broadcast(keyed.where(F.col(n) > share * total).select(*on).distinct())
    few, rest = F.broadcast(keyed.join(hot, on)), keyed.join(hot, on, "left_anti")
    light = rows.join(hot, on, "left_anti")
    return rows.join(few, on).drop(n).unionByName(light.join(rest, on).drop(n))


def heavy_keys(stats: DataFrame, share: float, n_total: int) -> DataFrame:
    """Keys of ``key_stats`` that hold more than ``share`` of ``n_total`` rows."""
    return stats.where(F.col("n_rows") > F.lit(share) * F.lit(n_total))
