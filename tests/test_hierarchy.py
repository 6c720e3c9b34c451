import random
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brindle.operators import heavy_paths, hierarchy

LINKS = "tree string, node string, rank long, parent string, parent_rank long"


def brute(edges):
    """{(tree, node): (root, depth)} by walking up."""
    parent = {(t, n): p for t, n, p in edges}
    nodes = set(parent) | {(t, p) for t, _, p in edges if p is not None}
    out = {}
    for t, n in nodes:
        way, at = [n], n
        while True:
            p = parent.get((t, at))
            if p is None:
                out[t, n] = (at, len(way) - 1)
                break
            if p in way:
                out[t, n] = (min(way[way.index(p) :]), -1)
                break
            way.append(p)
            at = p
    return out


def _links(spark, edges):
    return spark.createDataFrame([(t, n, 0, p, 0) for t, n, p in edges], LINKS)


def _random_edges(seed):
    rng = random.Random(seed)
    edges = []
    for t in range(3):
        n = rng.choice([1, 8, 40])
        for i in range(n):
            kind = rng.random()
            p = None if kind < 0.1 else f"n{rng.randrange(n):03d}" if kind < 0.25 else f"n{rng.randrange(max(1, i)):03d}" if kind < 0.7 else f"n{max(0, i - 1):03d}"
            edges.append((f"t{t}", f"n{i:03d}", p))
    return edges


@pytest.fixture(params=["in tasks", "both"])
def task_rows(request):
    """Trees of more rows than this are decomposed by joins: none, or those of more than 20."""
    return {"in tasks": 1000, "both": 20}[request.param]


@pytest.mark.parametrize("seed", range(2))
def test_depths_paths_and_descendants_against_walking(spark, seed, task_rows):
    edges = _random_edges(seed)
    want = brute(edges)
    f = hierarchy.forest(_links(spark, edges), paths=True, task_rows=task_rows)
    assert {(r.tree, r.node_id): (r.root_id, r.node_depth) for r in f.depths().collect()} == want
    parent = {(t, n): p for t, n, p in edges}
    paths = {(r.tree, r.node_id): r.path for r in f.paths().collect()}
    for key, (root, depth) in want.items():
        if depth < 0:
            assert paths[key] is None
            continue
        way, at = [key[1]], key[1]
        while parent.get((key[0], at)) is not None:
            at = parent[key[0], at]
            way.append(at)
        assert paths[key] == way[::-1]
    below = {}
    for (t, n), (_, depth) in want.items():
        if depth >= 0:
            for a in paths[t, n][:-1]:
                below.setdefault((t, a), set()).add(n)
    counts = {(r.tree, r.node_id): r.n_descendants for r in f.intervals().collect()}
    assert counts == {k: len(below.get(k, ())) for k, (_, d) in want.items() if d >= 0}
    got = {}
    for r in f.descendants(f.depths().where("node_depth >= 0").select("tree", "node_id")).collect():
        assert r.descendant_id not in got.setdefault((r.tree, r.node_id), set())
        got[r.tree, r.node_id].add(r.descendant_id)
    assert got == below


def test_wide_and_deep(spark, monkeypatch, task_rows):
    monkeypatch.setattr(hierarchy, "BUCKET_ROWS", 10)
    monkeypatch.setattr(heavy_paths, "CELLS", 50)
    edges = [("w", f"c{i:04d}", "top") for i in range(200)] + [("w", f"d{i:03d}", f"d{i - 1:03d}" if i else "c0007") for i in range(70)]
    f = hierarchy.forest(_links(spark, edges), paths=True, task_rows=task_rows)
    assert {(r.tree, r.node_id): (r.root_id, r.node_depth) for r in f.depths().collect()} == brute(edges)
    assert {len(r.path) - 1 - r.node_depth for r in f.paths().collect()} == {0}
    assert f.all_descendants().count() == sum(d for _, d in brute(edges).values())
    pre = sorted(r.pre for r in f.intervals().collect())
    assert pre == list(range(271))


def test_trees_that_run_over_batches(monkeypatch):
    monkeypatch.setattr(heavy_paths, "STEP_ROWS", 7)
    edges = sorted((e for s in range(4) for e in [(f"{s}{t}", n, p) for t, n, p in _random_edges(s)]), key=lambda e: e[0])
    cols = list(zip(*[(t, n, 0, p, 0, 0, 0) for t, n, p in edges]))
    names = ["tree", "node", "rank", "parent", "parent_rank", "touched", "load"]
    batches = pa.table({k: pa.array(list(c), pa.string() if k in ("tree", "node", "parent") else pa.int64()) for k, c in zip(names, cols)}).to_batches(max_chunksize=5)
    got = [r for b in heavy_paths.run("depths", iter(batches)) for r in b.to_pylist()]
    assert {(r["tree"], r["node_id"]): (r["root_id"], r["node_depth"]) for r in got} == brute(edges)
    assert len(got) == len(brute(edges)) and list(heavy_paths.run("depths", iter([]))) == []


def test_current_row_empty_and_self_link(spark, task_rows):
    schema = "id int, up int, t timestamp_ntz, load_id int, tree int, node int, rank int"
    d = [datetime(2024, 1, i) for i in range(1, 5)]
    rows = [(1, None, d[0], 1), (2, 1, d[0], 1), (2, 3, d[2], 1), (2, 4, d[1], 9), (3, 3, d[0], 1), (None, 2, d[0], 1), (10, 9, None, 1), (9, 10, d[3], 1), (9, 10, d[3], 1)]
    df = spark.createDataFrame([(*r, 0, 0, 0) for r in rows], schema)
    links = hierarchy.link_rows(df, F.lit("x"), "id", "up", "t", "load_id", F.lit(True))
    got = {r.node_id: (r.root_id, r.node_depth) for r in hierarchy.forest(links, task_rows=task_rows and 1000).depths().collect()}
    assert got == {"1": ("1", 0), "2": ("3", -1), "3": ("3", -1), "9": ("9", -1), "10": ("9", -1)}
    assert hierarchy.forest(links.limit(0)).depths().count() == 0


def _below(edges):
    """{(tree, node): its descendants} by walking up from every node, once round a cycle."""
    parent = {(t, n): p for t, n, p in edges}
    out = {}
    for t, n in set(parent) | {(t, p) for t, _, p in edges if p is not None}:
        at, met = parent.get((t, n)), {n}
        out.setdefault((t, n), set())
        while at is not None and at not in met:
            out.setdefault((t, at), set()).add(n)
            met.add(at)
            at = parent.get((t, at))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_descendants_of_every_node_also_without_a_root(spark, seed, task_rows):
    edges = [*_random_edges(seed), ("c", "a", "b"), ("c", "b", "e"), ("c", "e", "a"), ("c", "f", "b"), ("c", "g", "f"), ("c", "s", "s"), ("c", "u", "s")]
    want = _below(edges)
    f = hierarchy.forest(_links(spark, edges), task_rows=task_rows)
    got = {}
    for r in f.all_descendants().collect():
        assert r.descendant_id not in got.setdefault((r.tree, r.node_id), set())
        got[r.tree, r.node_id].add(r.descendant_id)
    assert got == {k: v for k, v in want.items() if v}
    spans = f.spans().collect()
    assert {(r.tree, r.node_id): r.n_descendants for r in spans} == {k: len(v) for k, v in want.items()}
    for r in spans:
        assert {x.node_id for x in spans if (x.tree, x.root_id) == (r.tree, r.root_id) and r.first <= x.pre <= r.last and x.node_id != r.node_id} == want[r.tree, r.node_id]


def test_descendant_queries_leave_no_tree_and_no_node_out(spark, sf):
    from brindle.plans import core_problems as q

    spans = q.p4_descendants(spark, sf).collect()
    assert len(spans) == q.p4_found(spark, sf).count() and {"pre", "first", "last"} <= set(spans[0].asDict())
    listed = [(r.tree, r.node_id) for r in q.p4_descendant_rows(spark, sf).collect()]
    assert {(r.tree, r.node_id): r.n_descendants for r in spans if r.n_descendants} == {k: listed.count(k) for k in set(listed)}
