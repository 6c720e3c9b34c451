"""Parent-child links to full hierarchies, by heavy-path decomposition.

1. *Subtree sizes and cycle separation.* Pointers are doubled: after round k a node points 2^k steps up, and a node's size
   gains the sizes of those that point to it. A node whose chain ends drops out of the doubling; a round in which none
   drops out leaves exactly the nodes that never reach a root.
2. *Chains.* Each node's largest child continues its chain. A second doubling along heavy links gives every node its
   chain's head and its place in the chain.
3. *Chain labels.* Any way to a root changes chains at most log2(n) times, so a short loop over chains (not nodes)
   gives each its root, the depth, the preorder number and, if asked for, the path above its head.
4. A node's depth, preorder number and path are its chain's label plus its place in the chain; its descendants are the
   preorder interval of its subtree size.

The same steps run in two places. Trees of up to ``TASK_ROWS`` link rows are sent whole to a task, many trees to each, and
labelled there over arrays (``heavy_paths``): one shuffle, whatever the depth. Larger trees are never gathered: there the
steps are joins over all executors. Their rounds grow with the logarithm of the depth, each ends in a written table, and
the driver sees counts only. A parent with very many children is no group of one task: children are summed by partial
aggregation, their prefix sums run in buckets of about ``BUCKET_ROWS``, and skewed joins are left to adaptive execution,
which splits them. The segment of a chain is held as an array; it is as long as the path that has to come out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, Window, functions as F

from brindle.operators import heavy_paths
from brindle.session import Stage

BUCKET_ROWS = 10_000
#: Rows of a tree, old versions and repeated ones included, up to which it is labelled in one task: some 100 MB there.
TASK_ROWS = 200_000


def link_rows(df: DataFrame, tree: Column, node: str, parent: str, touched: str, load: str, rank: Column | None = None) -> DataFrame:
    """(tree, node, rank, parent, parent_rank, touched, load): all versions of the links of ``df``, as ``forest`` takes them.

    The current row of each (tree, node) is the one touched last. Ties of touch time fall to the greatest load, then to
    the greatest parent; a null touch time is the oldest. Rows without a tree or node id are dropped. Ids come out as
    text; ``rank`` True orders them by number, False by text.
    """
    by_number = F.lit(False) if rank is None else rank
    number = lambda c: F.when(by_number, F.expr(f"try_cast({c} AS bigint)")).otherwise(F.lit(0).cast("long")).alias("rank" if c == "node" else "parent_rank")
    return (
        df.select(tree.alias("tree"), df[node].cast("string").alias("node"), df[parent].cast("string").alias("parent"), df[touched].alias("touched"), df[load].alias("load"))
        .where(F.col("node").isNotNull() & F.col("tree").isNotNull())
        .select("tree", "node", number("node"), "parent", number("parent"), "touched", "load")
    )


def current_links(rows: DataFrame) -> DataFrame:
    """(tree, node, rank, parent, parent_rank): the current row of each (tree, node) of ``link_rows``."""
    best = F.max(F.struct("touched", "load", "parent", "parent_rank"))
    return rows.groupBy("tree", "node").agg(F.max("rank").alias("rank"), best.alias("row")).select("tree", "node", "rank", "row.parent", "row.parent_rank")


@dataclass
class _Joined:
    """A forest labelled by joins. ``nodes``: (nid, tree, node, rank, parent). ``places``: (nid, pid, size, head, pos) of nodes that reach a root,
    ``chains``: (chain, root, depth, pre[, above, segment]); ``cyclic``: (nid, m) with the least id of the cycle."""

    nodes: DataFrame
    places: DataFrame
    chains: DataFrame
    cyclic: DataFrame

    def depths(self) -> DataFrame:
        """(tree, node_id, root_id, node_depth): depth -1 and the cycle's smallest id for nodes that reach no root."""
        n = self.nodes.select("nid", "tree", "node")
        at = self.places.join(self.chains.select(F.col("chain").alias("head"), "root_node", "depth"), "head")
        fine = at.select("nid", F.col("root_node").alias("root_id"), (F.col("depth") + F.col("pos")).cast("int").alias("node_depth"))
        lost = self.cyclic.select("nid", F.col("m.text").alias("root_id"), F.lit(-1).alias("node_depth"))
        return n.join(fine.unionByName(lost), "nid").select("tree", F.col("node").alias("node_id"), "root_id", "node_depth")

    def intervals(self) -> DataFrame:
        """(tree, node_id, root_id, pre, last, n_descendants): descendants of a node are those of its root's tree with
        ``pre`` in (pre, last]. Nodes that reach no root have no interval and are left out."""
        at = self.places.join(self.chains.select(F.col("chain").alias("head"), "root_node", F.col("pre").alias("base")), "head")
        pre = F.col("base") + F.col("pos")
        out = at.select("nid", F.col("root_node").alias("root_id"), pre.alias("pre"), (pre + F.col("size") - 1).alias("last"), (F.col("size") - 1).alias("n_descendants"))
        return self.nodes.select("nid", "tree", F.col("node").alias("node_id")).join(out, "nid").drop("nid")

    def paths(self) -> DataFrame:
        """(tree, node_id, root_id, node_depth, path): path is the array of ids from the root to the node; for nodes that
        reach no root it is null. Needs a forest built with ``paths=True``."""
        at = self.places.join(self.chains.withColumnRenamed("chain", "head"), "head")
        path = F.concat("above", F.slice("segment", F.lit(1), F.col("pos").cast("int") + 1))
        fine = at.select("nid", F.col("root_node").alias("root_id"), (F.col("depth") + F.col("pos")).cast("int").alias("node_depth"), path.alias("path"))
        lost = self.cyclic.select("nid", F.col("m.text").alias("root_id"), F.lit(-1).alias("node_depth"), F.lit(None).cast("array<string>").alias("path"))
        return self.nodes.select("nid", "tree", F.col("node").alias("node_id")).join(fine.unionByName(lost), "nid").drop("nid")

    def spans(self) -> DataFrame:
        """(tree, node_id, root_id, pre, first, last, n_descendants) of every node: its descendants are the other nodes of
        its tree and root with ``pre`` in [first, last].

        Nodes that reach no root are numbered in the tree that is left when the step above the least id of their cycle is
        cut; that id stands as their root. Below the cycle the rule is the same; every node on the cycle has all others
        of its cycle and below as descendants.
        """
        cols = ["tree", "node_id", "root_id", "pre", "first", "last", "n_descendants"]
        lost = self.nodes.join(self.cyclic, "nid").withColumn("cut", F.col("node") == F.col("m.text"))
        links = lost.select("tree", "node", "rank", F.when(~F.col("cut"), F.col("parent")).alias("parent"), F.lit(0).cast("long").alias("parent_rank"))
        iv = _joined(Stage(links.sparkSession, "cut"), links).intervals()
        # the parent of the cut node is the cycle's other end: the nodes above it are the cycle
        ends = lost.where("cut").select("tree", F.col("node").alias("root_id"), F.col("parent").alias("node_id"))
        ends = ends.join(iv.select("tree", "node_id", F.col("pre").alias("end")), ["tree", "node_id"]).drop("node_id")
        whole = iv.where("node_id = root_id").select("tree", "root_id", F.col("last").alias("whole"))
        on_cycle = F.col("end").between(F.col("pre"), F.col("last"))
        round_ = (
            iv.join(ends, ["tree", "root_id"]).join(whole, ["tree", "root_id"])
            .withColumn("first", F.when(on_cycle, F.lit(0)).otherwise(F.col("pre") + 1))
            .withColumn("n_descendants", F.when(on_cycle, F.col("whole")).otherwise(F.col("n_descendants")))
            .withColumn("last", F.when(on_cycle, F.col("whole")).otherwise(F.col("last")))
        )
        return self.intervals().withColumn("first", F.col("pre") + 1).select(cols).unionByName(round_.select(cols))


@dataclass
class Forest:
    """Labelled trees: those that fit a task, from ``small`` (link rows), and the others, already joined."""

    small: DataFrame
    large: _Joined | None
    stage: Stage

    def _each(self, what: str, schema: str, large: Callable[[_Joined], DataFrame], *drop: str) -> DataFrame:
        placed = self.small.repartition("tree").sortWithinPartitions("tree")
        out = placed.mapInArrow(partial(heavy_paths.run, what), schema)
        out = out.drop(*drop)
        return out if self.large is None else out.unionByName(large(self.large))

    def depths(self) -> DataFrame:
        """(tree, node_id, root_id, node_depth): depth -1 and the cycle's smallest id for nodes that reach no root."""
        return self._each("depths", f"{_IDS}, node_depth int", _Joined.depths)

    def paths(self) -> DataFrame:
        """(tree, node_id, root_id, node_depth, path): path is the array of ids from the root to the node; for nodes that
        reach no root it is null. Trees above ``TASK_ROWS`` need a forest built with ``paths=True``."""
        return self._each("paths", f"{_IDS}, node_depth int, path array<string>", _Joined.paths)

    def spans(self) -> DataFrame:
        """(tree, node_id, root_id, pre, first, last, n_descendants) of every node: its descendants are the other nodes of
        its tree and root with ``pre`` in [first, last].

        Nodes that reach no root are numbered in the tree that is left when the step above the least id of their cycle is
        cut; that id stands as their root. Below the cycle the rule is the same; every node on the cycle has all others
        of its cycle and below as descendants.
        """
        return self._each("spans", f"{_IDS}, {_SPAN}", _Joined.spans, "lost")

    def intervals(self) -> DataFrame:
        """(tree, node_id, root_id, pre, last, n_descendants): descendants of a node are those of its root's tree with
        ``pre`` in (pre, last]. Nodes that reach no root are left out."""
        large = lambda f: f.intervals().withColumn("first", F.col("pre") + 1).withColumn("lost", F.lit(False))
        return self._each("spans", f"{_IDS}, {_SPAN}", large).where("NOT lost").drop("first", "lost")

    def descendants(self, ancestors: DataFrame) -> DataFrame:
        """All (tree, node_id, descendant_id) of the given (tree, node_id) rows: a stated set of nodes against all nodes.

        An interval becomes the aligned power-of-two blocks that make it up, at most two a level, and a node the blocks
        that hold it, one a level in use: an equi-join, without comparing every pair of a tree.
        """
        return _listed(self.stage.put(self.spans()), ancestors)

    def all_descendants(self) -> DataFrame:
        """All (tree, node_id, descendant_id) of every node, also of those that reach no root (see ``spans``)."""

        def large(f: _Joined) -> DataFrame:
            iv = self.stage.put(f.spans())
            return _listed(iv, iv)

        return self._each("descendants", "tree string, node_id string, descendant_id string", large)

    def close(self) -> None:
        """Drops the written tables; what was derived from this forest can no longer be read."""
        self.stage.close()


_IDS = "tree string, node_id string, root_id string"
_SPAN = "pre long, first long, last long, n_descendants long, lost boolean"


def _listed(iv: DataFrame, ancestors: DataFrame) -> DataFrame:
    """The nodes within [first, last] of the asked ones, except themselves; ``iv`` has (tree, node_id, root_id, pre, first, last)."""
    asked = ancestors.select("tree", "node_id").distinct().join(iv, ["tree", "node_id"]).where("n_descendants > 0")
    # blocks [j*2^b, (j+1)*2^b) of b up to 40: one at the left end where its rounded-up start is odd, one at the right
    # end where its rounded-down end is odd
    lo, hi = "first", "last + 1"
    cover = F.expr(
        f"""flatten(transform(sequence(0, 40), b -> array_compact(array(
            CASE WHEN (shiftright({lo} + shiftleft(1L, b) - 1, b) & 1) = 1
                  AND shiftleft(shiftright({lo} + shiftleft(1L, b) - 1, b), b) + shiftleft(1L, b) <= {hi}
                 THEN named_struct('b', b, 'j', shiftright({lo} + shiftleft(1L, b) - 1, b)) END,
            CASE WHEN (shiftright({hi}, b) & 1) = 1
                  AND shiftleft(shiftright({hi}, b) - 1, b) >= {lo}
                  AND NOT ((shiftright({lo} + shiftleft(1L, b) - 1, b) & 1) = 1 AND shiftright({hi}, b) - 1 = shiftright({lo} + shiftleft(1L, b) - 1, b))
                 THEN named_struct('b', b, 'j', shiftright({hi}, b) - 1) END))))"""
    )
    blocks = asked.select("tree", "root_id", F.col("node_id"), F.inline(cover).alias("b", "j"))
    levels = blocks.select("b").distinct()
    held = iv.select("tree", "root_id", F.col("node_id").alias("descendant_id"), "pre").join(F.broadcast(levels)).withColumn("j", F.expr("shiftright(pre, b)"))  # at most 41 rows
    return blocks.join(held, ["tree", "root_id", "b", "j"]).where("node_id <> descendant_id").select("tree", "node_id", "descendant_id")


def forest(links: DataFrame, paths: bool = False, task_rows: int | None = None) -> Forest:
    """Decomposes the trees of ``link_rows``, or of links without ``touched`` and ``load``, which are taken as current.

    Nodes are all ids in either field. A null parent or no row of its own makes a root; a self-link is a cycle of one.
    An empty table gives empty results. The links are read twice: once to count the rows of each tree.
    """
    stage = Stage(links.sparkSession, "forest")
    if "touched" not in links.columns:
        links = links.select("*", F.lit(0).cast("long").alias("touched"), F.lit(0).alias("load"))
    links = links.select("tree", "node", "rank", "parent", "parent_rank", "touched", "load")
    above = links.groupBy("tree").agg(F.count("*").alias("n")).where(F.col("n") > (TASK_ROWS if task_rows is None else task_rows)).select("tree")
    if above.isEmpty():
        return Forest(links, None, stage)
    above = stage.put(above)
    return Forest(links.join(above, "tree", "left_anti"), _joined(stage, current_links(links.join(above, "tree", "left_semi")), paths), stage)


def _joined(stage: Stage, links: DataFrame, paths: bool = False) -> _Joined:
    """The links of ``current_links`` decomposed by joins."""
    spark = links.sparkSession
    both = links.select("tree", "node", "rank", "parent").unionByName(
        links.where(F.col("parent").isNotNull()).select("tree", F.col("parent").alias("node"), F.col("parent_rank").alias("rank"), F.lit(None).cast("string").alias("parent"))
    )
    nodes = stage.put(
        both.groupBy("tree", "node").agg(F.max("rank").alias("rank"), F.max("parent").alias("parent"))
        .select(F.monotonically_increasing_id().alias("nid"), "tree", "node", "rank", "parent")
    )
    ids = nodes.select("tree", F.col("node").alias("parent"), F.col("nid").alias("pid"))
    edges = stage.put(
        nodes.where(F.col("parent").isNotNull()).select("nid", "tree", "parent").join(ids, ["tree", "parent"]).select("nid", "pid")
        .unionByName(nodes.where(F.col("parent").isNull()).select("nid", F.lit(None).cast("long").alias("pid")))
    )

    sizes, left = _sizes(stage, edges)
    cyclic = _cycles(stage, nodes, edges, sizes) if left else spark.createDataFrame([], "nid long, m struct<rank: long, text: string>")
    fine = edges.join(sizes.where(F.col("ptr").isNull()).select("nid", "size"), "nid")
    offs = stage.put(_offsets(fine.join(nodes.select("nid", F.xxhash64("tree", "node").alias("h")), "nid")))
    places = _heads(stage, offs)
    return _Joined(nodes, places, _chains(stage, nodes, offs, places, paths), cyclic)


def _sizes(stage: Stage, edges: DataFrame) -> tuple[DataFrame, int]:
    """(nid, ptr, size) after the last round, and how many nodes still have a pointer: those never reach a root."""
    state = stage.put(edges.select("nid", F.col("pid").alias("ptr"), F.lit(1).cast("long").alias("size")))
    left = state.where(F.col("ptr").isNotNull()).count()
    while left:
        told = state.where(F.col("ptr").isNotNull())
        gain = told.groupBy(F.col("ptr").alias("nid")).agg(F.sum("size").alias("gain"))
        step = state.select(F.col("nid").alias("ptr"), F.col("ptr").alias("next"))
        moved = told.join(step, "ptr").select("nid", "size", F.col("next").alias("ptr")).unionByName(state.where(F.col("ptr").isNull()))
        new = stage.put(moved.join(gain, "nid", "left").select("nid", "ptr", (F.col("size") + F.coalesce("gain", F.lit(0))).alias("size")))
        stage.drop(state)
        state, before, left = new, left, new.where(F.col("ptr").isNotNull()).count()
        if left == before:
            break
    return state, left


def _cycles(stage: Stage, nodes: DataFrame, edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """(nid, m): the least (rank, text) on the cycle that each node runs into.

    Doubling keeps the least id over 2^k steps. It is the cycle's once every node that some pointer meets agrees with
    the node it points to: those stretches then join up and run round the whole cycle.
    """
    lost = sizes.where(F.col("ptr").isNotNull()).select("nid")
    state = stage.put(
        edges.join(lost, "nid").join(nodes, "nid")
        .select("nid", F.col("pid").alias("ptr"), F.struct("rank", F.col("node").alias("text")).alias("m"))
    )
    while True:
        to = state.select(F.col("nid").alias("ptr"), F.col("ptr").alias("next"), F.col("m").alias("m2"))
        seen = stage.put(state.join(to, "ptr"))
        stage.drop(state)
        met = seen.select(F.col("ptr").alias("nid")).distinct()
        if not seen.where(F.col("m") != F.col("m2")).join(met, "nid", "left_semi").limit(1).count():
            return seen.select("nid", F.col("m2").alias("m"))
        state = stage.put(seen.select("nid", F.col("next").alias("ptr"), F.least("m", "m2").alias("m")))
        stage.drop(seen)


def _offsets(fine: DataFrame) -> DataFrame:
    """(nid, pid, size, heavy, off): whether a node continues its parent's chain, and its preorder distance from the parent."""
    kids = fine.where(F.col("pid").isNotNull())
    top = kids.groupBy("pid").agg(F.max(F.struct("size", "h", "nid")).alias("best"), F.count("*").alias("kids"))
    told = kids.join(top, "pid").select("nid", "pid", "size", "h", (F.col("nid") == F.col("best.nid")).alias("heavy"), F.col("best.size").alias("first"), F.expr(f"pmod(h, 1 + kids div {BUCKET_ROWS})").alias("bucket"), (F.col("kids") >= BUCKET_ROWS).alias("wide"))
    light = told.where(~F.col("heavy"))
    before = Window.partitionBy("pid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = light.where("wide").groupBy("pid", "bucket").agg(F.sum("size").alias("s")).select("pid", "bucket", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("pid", "bucket").orderBy("h", "nid").rowsBetween(Window.unboundedPreceding, -1)
    off = light.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(base, ["pid", "bucket"], "left").select("nid", "pid", "size", "heavy", (1 + F.col("first") + F.coalesce("base", F.lit(0)) + F.col("within")).alias("off"))
    heavy = told.where("heavy").select("nid", "pid", "size", "heavy", F.lit(1).cast("long").alias("off"))
    roots = fine.where(F.col("pid").isNull()).select("nid", "pid", "size", F.lit(False).alias("heavy"), F.lit(0).cast("long").alias("off"))
    return off.unionByName(heavy).unionByName(roots)


def _heads(stage: Stage, offs: DataFrame) -> DataFrame:
    """(nid, pid, size, head, pos): the head of each node's chain and the steps from it, by doubling along heavy links."""
    state = stage.put(offs.select("nid", "pid", "size", F.when(F.col("heavy"), F.col("pid")).otherwise(F.col("nid")).alias("head"), F.col("heavy").cast("long").alias("pos"), F.col("heavy").alias("open")))
    while state.where("open").limit(1).count():
        to = state.select(F.col("nid").alias("head"), F.col("head").alias("head2"), F.col("pos").alias("pos2"), F.col("open").alias("open2"))
        moved = state.where("open").join(to, "head").select("nid", "pid", "size", F.col("head2").alias("head"), (F.col("pos") + F.col("pos2")).alias("pos"), F.col("open2").alias("open"))
        new = stage.put(moved.unionByName(state.where(~F.col("open"))))
        stage.drop(state)
        state = new
    return state.drop("open")


def _chains(stage: Stage, nodes: DataFrame, offs: DataFrame, places: DataFrame, paths: bool) -> DataFrame:
    """(chain, root_node, depth, pre[, above, segment]) of every chain, from the roots' chains outwards."""
    heads = offs.where(~F.col("heavy")).select(F.col("nid").alias("chain"), F.col("pid").alias("at"), "off")
    spot = places.select(F.col("nid").alias("at"), F.col("head").alias("up"), F.col("pos").alias("up_pos"))
    open_ = stage.put(heads.where(F.col("at").isNotNull()).join(spot, "at").select("chain", "up", "up_pos", "off"))
    first = heads.where(F.col("at").isNull()).join(nodes.select(F.col("nid").alias("chain"), F.col("node").alias("root_node")), "chain")
    done = first.select("chain", "root_node", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("pre"))
    if paths:
        texts = places.join(nodes.select("nid", "node"), "nid").groupBy(F.col("head").alias("chain"))
        segments = stage.put(texts.agg(F.expr("transform(array_sort(collect_list(struct(pos, node))), x -> x.node)").alias("segment")))
        done = done.join(segments, "chain").withColumn("above", F.array().cast("array<string>"))
    level = stage.put(done)
    levels = [level]
    left = open_.count()
    while left:
        up = level.withColumnsRenamed({"chain": "up", "depth": "up_depth", "pre": "up_pre"})
        if paths:
            up = up.withColumnsRenamed({"above": "up_above", "segment": "up_segment"})
        hit = open_.join(up, "up").select(
            "chain", "root_node", (F.col("up_depth") + F.col("up_pos") + 1).alias("depth"), (F.col("up_pre") + F.col("up_pos") + F.col("off")).alias("pre"),
            *([F.concat("up_above", F.slice("up_segment", F.lit(1), F.col("up_pos").cast("int") + 1)).alias("above")] if paths else []),
        )
        if paths:
            hit = hit.join(segments, "chain").select("chain", "root_node", "depth", "pre", "segment", "above")
        level = stage.put(hit)
        levels.append(level)
        rest = stage.put(open_.join(level.select("chain"), "chain", "left_anti"))
        stage.drop(open_)
        open_, left = rest, rest.count()
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out
