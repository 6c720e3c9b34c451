"""Event-time operators for Structured Streaming; each also runs on a batch table, where the watermark has no effect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from brindle.functions.expr import col
from brindle.operators import frames


def _timed(df: DataFrame, ts: str) -> DataFrame:
    """A stream's event time must be a timestamp: one without a zone is taken in the session's (UTC)."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")) if dict(df.dtypes)[ts] == "timestamp_ntz" else df


def _marked(df: DataFrame, ts: str, late: str) -> DataFrame:
    some = df.where(F.col(ts).isNotNull())
    return _timed(some, ts).withWatermark(ts, late) if df.isStreaming else some


def tumbling(df: DataFrame, ts: str, width: str, aggs: dict[str, Column], by=(), late: str = "1 day", slide: str | None = None) -> DataFrame:
    """(window_start, window_end, keys, aggregates) of fixed windows, sliding ones with ``slide``. Rows later than ``late``
    behind the newest are dropped by a stream."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return _marked(df, ts, late).groupBy(w.alias("_w"), *by).agg(*[c.alias(n) for n, c in aggs.items()]).select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *by, *aggs)


def sessions(df: DataFrame, ts: str, gap: str, aggs: dict[str, Column], by=(), late: str = "1 day") -> DataFrame:
    """Windows that end after ``gap`` without a row of the same keys."""
    w = F.session_window(ts, gap)
    return _marked(df, ts, late).groupBy(w.alias("_w"), *by).agg(*[c.alias(n) for n, c in aggs.items()]).select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *by, *aggs)


def deduplicated(df: DataFrame, keys: list[str], ts: str, late: str = "1 day") -> DataFrame:
    """First row per key within the watermark (stream) or at all (batch)."""
    return _timed(df, ts).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def interval_join(left: DataFrame, right: DataFrame, on: list[str], left_ts: str, right_ts: str, before: str, after: str, late: str = "1 day") -> DataFrame:
    """Rows of both with equal keys whose right time lies within [left - before, left + after]; state is bounded by both
    watermarks and the interval. Apart from the keys the sides share no column names."""
    a, b = _marked(left, left_ts, late).alias("a"), _marked(right, right_ts, late).alias("b")
    cond = " AND ".join(f"a.`{k}` = b.`{k}`" for k in on)
    near = f"b.`{right_ts}` >= a.`{left_ts}` - INTERVAL {before} AND b.`{right_ts}` <= a.`{left_ts}` + INTERVAL {after}"
    return a.join(b, F.expr(f"{cond} AND {near}")).select("a.*", *[f"b.`{c}`" for c in right.columns if c not in on])


def run_available(df: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Processes what a streaming source has now in micro-batches and stops; progress is kept in ``checkpoint``."""
    df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def content_hash(df: DataFrame, columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def changed_rows(df: DataFrame, state: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows whose content differs from ``state`` (key, content_hash) or is not in it, with the new hash: what is left to do of
    a load. Keys are unique in the state."""
    return df.withColumn("content_hash", content_hash(df, columns)).join(state.select(key, "content_hash").distinct(), [key, "content_hash"], "left_anti")


def next_batch(queue: DataFrame, n: int, max_attempts: int = 5, status: str = "status") -> DataFrame:
    """The ``n`` oldest pending rows of a work queue (queue_id, status, attempts) that may still be tried."""
    return queue.where((F.col(status) == "pending") & (F.col("attempts") < max_attempts)).orderBy("queue_id").limit(n)


def settle(queue: DataFrame, outcomes: DataFrame, max_attempts: int = 5) -> DataFrame:
    """The queue after outcomes (queue_id, ok): done, pending again with one attempt more, or failed at the last."""
    j = queue.join(outcomes.select("queue_id", "ok"), "queue_id", "left")
    tries = F.col("attempts") + F.col("ok").isNotNull().cast("int")
    status = F.when(F.col("ok"), "done").when(F.col("ok").isNotNull(), F.when(tries >= max_attempts, "failed").otherwise("pending")).otherwise(F.col("status"))
    return j.withColumn("status", status).withColumn("attempts", tries).drop("ok")


def bucket_start(ts: Column | str, width: str) -> Column:
    """Start of the fixed window a time lies in."""
    return F.window(col(ts), width)["start"]


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_ts: str, right_ts: str, value: str) -> DataFrame:
    """Each left row with the right ``value`` of the last time not after its own, per key; null where there is none.

    Both sides become one ordered sequence, in which the last value is carried on: no pairs are formed. A key of very many
    rows is cut into blocks (``frames.cumulative``). Right rows of one time give the greatest value. A batch operator.
    """
    a = left.select("*", F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    b = right.select(*on, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_v"))
    both = frames.cumulative(a.unionByName(b, allowMissingColumns=True), on, ["_t", "_side", "_v"], {value: ("last", F.col("_v"))})
    return both.where("_side = 1").drop("_t", "_side", "_v")
