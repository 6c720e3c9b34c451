"""Metadata of tables and changes to it: model envelopes, name filters, upserts with an audit log, event envelopes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F


def glob_pattern(glob: str) -> str:
    """The regular expression of a glob: * any run, ? one character, [..] and [!..] sets."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if c == "[" and end > 0:
            inner = glob[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]")
            i = end + 1
            continue
        out.append({"*": ".*", "?": "."}.get(c) or re.escape(c))
        i += 1
    return r"(?s)\A" + "".join(out) + r"\z"


def glob_filter(df: DataFrame, name: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Rows whose name matches an included glob (any, without a list) and no excluded one; a null name never passes."""
    some = lambda globs: F.lit(False) if not globs else F.col(name).rlike("|".join(f"(?:{glob_pattern(g)})" for g in globs))
    return df.where(F.col(name).isNotNull() & (F.lit(True) if include is None else some(include)) & ~some(exclude))


def humanise(name: Column) -> Column:
    """'customer_orderID' to 'Customer order id': words are parted at signs and at changes of case."""
    parted = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "[^A-Za-z0-9]+", " ")
    flat = F.lower(F.trim(parted))
    return F.concat(F.upper(F.substring(flat, 1, 1)), F.substring(flat, 2, 1 << 30))


def model_columns(columns: DataFrame, source: str) -> DataFrame:
    """(rk, parent_rk, table, column, position, type, nullable, label) from introspected columns: keys are the dotted names."""
    return columns.select(
        F.concat_ws(".", F.lit(source), "table", "column").alias("rk"), F.concat_ws(".", F.lit(source), "table").alias("parent_rk"),
        "table", "column", "position", "type", "nullable", humanise(F.col("column")).alias("label"),
    )


def model_envelopes(columns: DataFrame, source: str) -> DataFrame:
    """(rk, envelope): one JSON document a table with its columns in order."""
    c = model_columns(columns, source)
    inner = F.transform(F.array_sort(F.collect_list(F.struct("position", "rk", "column", "type", "nullable", "label"))), lambda x: F.struct(x["rk"].alias("rk"), x["column"].alias("name"), x["type"].alias("type"), x["nullable"].alias("nullable"), x["label"].alias("label")))
    t = c.groupBy(F.col("parent_rk").alias("rk"), "table").agg(inner.alias("columns"))  # the columns of one table
    return t.select("rk", F.to_json(F.struct(F.col("rk"), F.lit("table").alias("kind"), F.col("table").alias("name"), "columns")).alias("envelope"))


def upsert_audit(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """What ``profiling.upsert`` does: (keys, action, before, after, changed) for keys that are new or whose row changes.

    ``action`` is 'insert' or 'update', ``before`` and ``after`` are JSON (null before an insert), ``changed`` the sorted names of
    the columns with another value. A null new value leaves the old one. Keys are unique on each side; rows without a
    change have no entry.
    """
    rest = [c for c in old.columns if c not in keys]
    a, b = old.withColumn("_old", F.lit(True)).alias("a"), new.alias("b")
    j = b.join(a, F.expr(" AND ".join(f"a.`{k}` <=> b.`{k}`" for k in keys)), "left")
    after = {c: F.coalesce(F.col(f"b.`{c}`"), F.col(f"a.`{c}`")) for c in rest}
    changed = F.array_sort(F.array_compact(F.array(*[F.when(~F.col(f"a.`{c}`").eqNullSafe(after[c]), F.lit(c)) for c in rest])))
    t = j.select(
        *[F.col(f"b.`{k}`").alias(k) for k in keys], F.when(F.col("a._old"), "update").otherwise("insert").alias("action"),
        F.when(F.col("a._old"), F.to_json(F.struct(*[F.col(f"a.`{c}`").alias(c) for c in rest]))).alias("before"),
        F.to_json(F.struct(*[after[c].alias(c) for c in rest])).alias("after"), changed.alias("changed"),
    )
    return t.where((F.col("action") == "insert") | (F.size("changed") > 0))


def event_envelope(df: DataFrame, kind: Column, subject: Column, moment: str, payload: list[str], supersedes: Column | None = None) -> DataFrame:
    """(event_id, kind, subject, moment, supersedes, payload): ids sort by time and are the same for the same content.

    An id is the milliseconds since 1970 as twelve hexadecimal digits, and twelve more of a digest of kind, subject and payload.
    """
    body = F.to_json(F.struct(*payload))
    ms = F.unix_millis(F.col(moment).cast("timestamp"))
    mark = F.substring(F.md5(F.concat_ws("|", kind, subject, body).cast("binary")), 1, 12)
    return df.select(
        F.concat_ws("-", F.lower(F.lpad(F.hex(ms), 12, "0")), mark).alias("event_id"), kind.alias("kind"), subject.cast("string").alias("subject"), F.col(moment).alias("moment"),
        (F.lit(None).cast("string") if supersedes is None else supersedes).alias("supersedes"), body.alias("payload"),
    )
