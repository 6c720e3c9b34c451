"""References to records that do not exist: orphan rows per table and period.

Method: a Bloom filter of all parent keys is broadcast; a reference it denies is an orphan for certain. Only the
references it admits are verified by an exact join with the parents' first and last loads and with the deletions.
References are grouped before either step, so a key that holds a third of all rows is one row there; the last join,
which brings the verdicts back to the rows, takes the few references that hold a thousandth of the rows and more apart.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from brindle.operators import bloom, skew
from brindle.session import Stage


@dataclass(frozen=True)
class Reference:
    """``child.ref`` should point to ``parent.parent_id``; ``key`` names the child row in the result."""

    table_name: str
    child: DataFrame
    key: str
    ref: str
    parent: DataFrame
    parent_id: str
    target: str


def _text(df: DataFrame, name: str):
    return df[name].cast("string")


def orphan_references(
    references: list[Reference],
    deleted: DataFrame,
    load: str = "load_id",
    touched: str = "_last_touched_dt_utc",
) -> DataFrame:
    """Rows whose reference finds nothing, finds a deleted record, or came in before its record.

    Result: distinct (table_name, record_key, ref_id, touched_month, reason), ids as plain text. ``reason`` is
    'missing' (no row of the parent table in any load), 'deleted' (reported deleted in a load not before the parent's
    last) or 'early' (the parent's first load is after the row's own), in this order of precedence per reference.

    Null references are no cases. A null key or touch time stays null in the result. A null load on either side
    compares to nothing: it neither makes a row early nor a parent deleted. Empty tables give no rows (an empty
    parent table makes every reference missing). Repeated rows count once. Extra columns are not read.
    """
    spark = deleted.sparkSession
    stage = Stage(spark, "orphans")
    rel = {r: F.lit(i) for i, r in enumerate(references)}

    def every(parts: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, parts)

    rows = every([
        r.child.select(
            rel[r].alias("rel"), _text(r.child, r.key).alias("record_key"), _text(r.child, r.ref).alias("ref_id"),
            F.date_format(r.child[touched], "yyyy-MM").alias("touched_month"), r.child[load].cast("int").alias("row_load"),
        ).where(F.col("ref_id").isNotNull())
        for r in references
    ])
    parents = every([
        r.parent.select(rel[r].alias("rel"), _text(r.parent, r.parent_id).alias("ref_id"), r.parent[load].cast("int").alias("l"))
        .where(F.col("ref_id").isNotNull())
        .groupBy("rel", "ref_id")
        .agg(F.min("l").alias("first_load"), F.max("l").alias("last_load"))
        for r in references
    ])
    gone = every([
        deleted.where(deleted["table_name"] == r.target)
        .select(rel[r].alias("rel"), F.trim(_text(deleted, "record_id")).alias("ref_id"), deleted[load].cast("int").alias("l"))
        .groupBy("rel", "ref_id")
        .agg(F.max("l").alias("gone_load"))
        for r in references
    ])

    known = stage.put(parents)
    asked = rows.groupBy("rel", "ref_id").agg(F.min("row_load").alias("first_row_load"), F.count("*").alias("n"))
    held = bloom.build(known, ["rel", "ref_id"], known.count())
    never = F.lit(2**31 - 1)
    told = stage.put(held.mark(asked, "rel", "ref_id"))
    denied = told.where(~F.col("maybe")).select("rel", "ref_id", never.alias("below"), F.lit("missing").alias("reason"), "n")
    admitted = told.where("maybe").drop("maybe")
    is_gone = F.col("gone_load") >= F.col("last_load")
    judged = (
        admitted.join(known.withColumn("here", F.lit(True)), ["rel", "ref_id"], "left")
        .join(gone, ["rel", "ref_id"], "left")
        .select(
            "rel", "ref_id",
            F.when(F.col("here").isNull() | is_gone, never).otherwise(F.col("first_load")).alias("below"),
            F.when(F.col("here").isNull(), "missing").when(is_gone, "deleted")
            .when(F.col("first_row_load") < F.col("first_load"), "early").alias("reason"),
            "n",
        )
        .where(F.col("reason").isNotNull())
    )
    bad = stage.put(judged.unionByName(denied))
    suspects = bloom.build(bad, ["rel", "ref_id"], bad.count())
    rows = stage.put(suspects.mark(rows, "rel", "ref_id").where("maybe").drop("maybe"))
    names = F.create_map(*[x for r in references for x in (rel[r], F.lit(r.table_name))])
    return (
        skew.split_join(rows, bad, ["rel", "ref_id"], "n")
        .where((F.col("below") == never) | (F.col("row_load") < F.col("below")))
        .select(names[F.col("rel")].alias("table_name"), "record_key", "ref_id", "touched_month", "reason")
        .distinct()
    )


def orphan_counts(found: DataFrame) -> DataFrame:
    """Cases per table, touched month and reason."""
    return found.groupBy("table_name", "touched_month", "reason").agg(F.count("*").alias("cases"), F.count_distinct("ref_id").alias("refs"))
