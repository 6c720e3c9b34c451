"""Edges: traversal, cycles, consensus, induction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from brindle.functions.expr import safe_div
from brindle.session import Stage


def trace(edges: DataFrame, starts: DataFrame, max_hops: int, direction: str = "down", kinds: list[str] | None = None) -> DataFrame:
    """(start, node, hop): nodes within ``max_hops`` of each start (column ``node``), at the hop first seen; start is hop 0.

    ``direction`` is 'down' (src to dst), 'up' or 'both'. Edges marked inactive are not walked. Each hop joins the new
    frontier only and is written, so cycles end and lineage stays short.
    """
    stage = Stage(edges.sparkSession, "trace")
    e = edges.where("active") if "active" in edges.columns else edges
    e = e.where(F.col("kind").isin(kinds)) if kinds else e
    down, up = e.select(F.col("src").alias("node"), F.col("dst").alias("to")), e.select(F.col("dst").alias("node"), F.col("src").alias("to"))
    step = {"down": down, "up": up}.get(direction, down.unionByName(up)).distinct()
    seen = stage.put(starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("hop")).distinct())
    front = seen
    for hop in range(1, max_hops + 1):
        new = stage.put(front.join(step, "node").select("start", F.col("to").alias("node")).distinct().join(seen, ["start", "node"], "left_anti").withColumn("hop", F.lit(hop)))
        if not new.limit(1).count():
            break
        seen, front = seen.unionByName(new), new
    return seen


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """Nodes that lie on a directed cycle or between two: what is left when nodes without an edge in, and those without an
    edge out, are taken away again and again. Self-loops count. Empty for an acyclic graph."""
    stage = Stage(edges.sparkSession, "cycles")
    left = stage.put(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    n = left.count()
    while n:
        out, into = left.select(F.col("src").alias("dst")).distinct(), left.select(F.col("dst").alias("src")).distinct()
        new = stage.put(left.join(out, "dst", "left_semi").join(into, "src", "left_semi").select("src", "dst"))
        stage.drop(left)
        left, before, n = new, n, new.count()
        if n == before:
            break
    return left.select(F.col("src").alias("node")).unionByName(left.select(F.col("dst").alias("node"))).distinct()


def shapley_ok(df: DataFrame, group: str, share: str, total: float = 100.0, tolerance: float = 1e-3) -> DataFrame:
    t = df.groupBy(group).agg(F.sum(share).alias("total"))
    return t.withColumn("ok", F.abs(F.col("total") - total) <= tolerance)


def weights_match(df: DataFrame, weight: str, low: str, high: str) -> DataFrame:
    """Whether a stated weight lies within its interval; a missing bound does not bind."""
    w = F.col(weight)
    return df.withColumn("ok", w.isNotNull() & F.coalesce(w >= F.col(low), F.lit(True)) & F.coalesce(w <= F.col(high), F.lit(True)))


def consensus(edges: DataFrame, algorithm: str = "algorithm", least: int = 2) -> DataFrame:
    """Edges (src, dst) that at least ``least`` algorithms found, with their sorted names."""
    t = edges.groupBy("src", "dst").agg(F.sort_array(F.collect_set(algorithm)).alias("algorithms"))
    return t.withColumn("votes", F.size("algorithms")).where(F.col("votes") >= least)


def best_relations(relations: DataFrame) -> DataFrame:
    """One row per (subject, predicate, object): the greatest confidence, ties by the least evidence."""
    return relations.groupBy("subject", "predicate", "object").agg(F.max("confidence").alias("confidence"), F.max_by("evidence", F.struct("confidence", "evidence")).alias("evidence"))


def induce_schema(relations: DataFrame, least: int = 3, dominant: float = 0.6) -> DataFrame:
    """(predicate, domain, range, support, confidence): predicates with enough relations; domain and range are the type of
    most of their ends if it has the dominant share, else 'Thing'."""
    counts = relations.groupBy("predicate", "subject_type", "object_type").agg(F.count("*").alias("n"), F.sum("confidence").alias("s"))
    total = counts.groupBy("predicate").agg(F.sum("n").alias("support"), safe_div(F.sum("s"), F.sum("n")).alias("confidence")).where(F.col("support") >= least)

    def main(c: str, name: str) -> DataFrame:
        t = counts.where(F.col(c).isNotNull()).groupBy("predicate", F.col(c).alias("t")).agg(F.sum("n").alias("n"))
        return t.groupBy("predicate").agg(F.max(F.struct("n", "t")).alias(name))

    j = total.join(main("subject_type", "_d"), "predicate", "left").join(main("object_type", "_r"), "predicate", "left")
    pick = lambda c: F.when(safe_div(f"{c}.n", "support") >= dominant, F.col(f"{c}.t")).otherwise("Thing")
    return j.select("predicate", pick("_d").alias("domain"), pick("_r").alias("range"), "support", "confidence")


def promote_predicates(schema: DataFrame, seeds: DataFrame, support: int = 10, confidence: float = 0.7) -> DataFrame:
    return schema.where((F.col("support") >= support) & (F.col("confidence") >= confidence)).join(seeds.select("predicate").distinct(), "predicate", "left_anti")


def canonical_predicates(relations: DataFrame, mapping: DataFrame) -> DataFrame:
    """Predicates replaced by ``mapping`` (predicate, canonical), others kept; a predicate mapped twice takes the least."""
    m = mapping.groupBy("predicate").agg(F.min("canonical").alias("_c"))
    return relations.join(m, "predicate", "left").withColumn("predicate", F.coalesce("_c", "predicate")).drop("_c")


def attach_edges(relations: DataFrame, mapping: DataFrame, schema: DataFrame) -> DataFrame:
    """Relations under their canonical predicate, kept where (domain, range) is the schema's pair of it."""
    c = canonical_predicates(relations, mapping)
    return c.join(schema.select("predicate", F.col("domain").alias("subject_type"), F.col("range").alias("object_type")), ["predicate", "subject_type", "object_type"])


def clusters(assets: DataFrame, asset: str, tags: str, least: int = 2, most: int = 20) -> DataFrame:
    """Groups of assets that share a tag, of ``least`` to ``most`` members; equal groups come once, under their least tag.

    The size limits are the feature. They are applied to counts before members are collected, so no list is longer
    than ``most``.
    """
    t = assets.select(F.col(asset).alias("a"), F.explode(tags).alias("tag")).distinct()
    ok = t.groupBy("tag").agg(F.count("*").alias("n")).where(F.col("n").between(least, most))
    g = t.join(ok.select("tag"), "tag").groupBy("tag").agg(F.sort_array(F.collect_list("a")).alias("members"))
    return g.groupBy("members").agg(F.min("tag").alias("tag")).select("tag", "members", F.size("members").alias("n_members"))


def latest_by_trust(rows: DataFrame, key: list[str], value: str, trust: Column, moment: str) -> DataFrame:
    """The value of the greatest (trust, moment) per key: a lower-ranked writer never overwrites a higher one."""
    return rows.groupBy(*key).agg(F.max_by(value, F.struct(trust, F.col(moment))).alias(value))


def latest_rows(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row per key in the given order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
