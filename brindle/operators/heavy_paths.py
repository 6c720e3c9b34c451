"""Heavy-path decomposition of many small trees at once, over arrays.

One call takes the link rows of whole trees, in any number, and labels all their nodes together: current rows, cycle
separation and subtree sizes by pointer doubling, heavy chains, chain labels from the roots outwards. There is no loop
over nodes or trees; every loop runs a logarithmic number of rounds. ``hierarchy`` sends it all trees that fit a task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows that are gathered before they are labelled, and cells of an output batch of paths or descendants.
STEP_ROWS = 40_000
CELLS = 1 << 20
_LOWEST = np.iinfo(np.int64).min


def _order(col: pa.ChunkedArray) -> np.ndarray:
    """The column's order as whole numbers, nulls first."""
    if pa.types.is_timestamp(col.type) or pa.types.is_integer(col.type):
        return pc.fill_null(col.cast(pa.int64()), _LOWEST).to_numpy()
    return pc.rank(col.combine_chunks(), null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)


def _last_of(sorted_keys: np.ndarray) -> np.ndarray:
    """Which entries end a run of equal keys."""
    out = np.ones(len(sorted_keys), dtype=bool)
    out[:-1] = sorted_keys[1:] != sorted_keys[:-1]
    return out


def _doubled(ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pointers at the end, subtree sizes): an end is -1 for nodes whose chain of parents ends."""
    size, left = np.ones(len(ptr), dtype=np.int64), int((ptr >= 0).sum())
    while left:
        on = ptr >= 0
        gain = np.bincount(ptr[on], weights=size[on], minlength=len(ptr)).astype(np.int64)
        size += gain
        ptr = np.where(on, ptr[ptr], -1)
        before, left = left, int((ptr >= 0).sum())
        if left == before:
            break
    return ptr, size


def _cycle_ends(parent: np.ndarray, end: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, on_cycle) per node: the least node of the cycle that a node runs into, -1 for nodes that reach a root."""
    n = len(parent)
    lost = end >= 0
    for _ in range(int(lost.sum()).bit_length()):
        end = np.where(lost, end[end], -1)
    on = np.zeros(n, dtype=bool)
    on[end[lost]] = True
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    at, low = np.where(on, parent, 0), np.where(on, place, 0)
    for _ in range(int(on.sum()).bit_length()):
        low = np.where(on, np.minimum(low, low[at]), 0)
        at = np.where(on, at[at], 0)
    return np.where(lost, order[low[np.where(lost, end, 0)]], -1), on


@dataclass
class Labels:
    """Arrays over nodes, and ``texts``, the sorted distinct ids that ``node`` counts. ``spot`` is a node's place in the
    order of trees and preorder, ``at`` the node of each place."""

    trees: pa.Array
    texts: pa.Array
    tree: np.ndarray
    node: np.ndarray
    parent: np.ndarray
    root: np.ndarray
    depth: np.ndarray
    lost: np.ndarray
    on_cycle: np.ndarray
    size: np.ndarray
    head: np.ndarray
    pos: np.ndarray
    pre: np.ndarray
    spot: np.ndarray
    at: np.ndarray


def label(rows: pa.Table) -> Labels:
    """Labels of the nodes of whole trees, from rows (tree, node, rank, parent, parent_rank, touched, load)."""
    trees = rows["tree"].combine_chunks().dictionary_encode()
    ids = pa.chunked_array([*rows["node"].chunks, *rows["parent"].chunks]).combine_chunks().dictionary_encode()
    by_text = pc.array_sort_indices(ids.dictionary).to_numpy()
    texts = ids.dictionary.take(pa.array(by_text))
    place = np.empty(len(by_text) + 1, dtype=np.int64)
    place[by_text], place[-1] = np.arange(len(by_text)), -1
    codes = place[pc.fill_null(ids.indices.cast(pa.int64()), -1).to_numpy()]
    own, up = codes[: len(rows)], codes[len(rows) :]
    base = trees.indices.to_numpy().astype(np.int64) * max(1, len(texts))
    key = base + own

    # the current row of each node
    order = np.lexsort((up, _order(rows["load"]), _order(rows["touched"]), key))
    now = order[_last_of(key[order])]
    has = up[now] >= 0
    up_key = base[now][has] + up[now][has]
    nodes = np.unique(np.concatenate([key[now], up_key]))
    parent = np.full(len(nodes), -1, dtype=np.int64)
    child, above = np.searchsorted(nodes, key[now]), np.searchsorted(nodes, up_key)
    parent[child[has]] = above
    rank = np.full(len(nodes), _LOWEST, dtype=np.int64)
    np.maximum.at(rank, child, _order(rows["rank"])[now])
    np.maximum.at(rank, above, _order(rows["parent_rank"])[now][has])
    tree, node = np.divmod(nodes, max(1, len(texts)))
    n = len(nodes)

    end, size = _doubled(parent)
    lost, on_cycle, least = end >= 0, np.zeros(n, dtype=bool), np.full(n, -1, dtype=np.int64)
    tall = parent
    if lost.any():
        least, on_cycle = _cycle_ends(parent, end, np.lexsort((node, rank)))
        # cut above its least node, a cycle is a tree like the others
        tall = np.where(np.arange(n) == least, -1, parent)
        _, size = _doubled(tall)

    # chains: the largest child goes on with its parent's chain
    every = np.arange(n)
    kids = np.lexsort((every, size, tall))
    kids = kids[np.searchsorted(tall[kids], 0) :]
    heavy = np.zeros(n, dtype=bool)
    heavy[kids[_last_of(tall[kids])]] = True
    head, pos = np.where(heavy, tall, every), heavy.astype(np.int64)
    while True:
        further = head[head]
        if (further == head).all():
            break
        pos, head = pos + pos[head], further
    # preorder distance from the parent: one for the heavy child, past it and the lighter ones before for the others
    off = np.ones(n, dtype=np.int64)
    if len(kids):
        big = size[kids]
        before = np.cumsum(big) - big
        last = _last_of(tall[kids])
        first = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
        run = np.cumsum(np.concatenate([[False], last[:-1]]))
        off[kids] = 1 + big[last][run] + before - before[first][run]
        off[heavy] = 1

    # chain labels, from the roots' chains outwards
    root, depth, pre = every.copy(), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    done = (head == every) & (tall < 0)
    open_ = np.flatnonzero((head == every) & (tall >= 0))
    while len(open_):
        above = tall[open_]
        chain = head[above]
        go = done[chain]
        c, a, h = open_[go], above[go], chain[go]
        root[c], depth[c], pre[c] = root[h], depth[h] + pos[a] + 1, pre[h] + pos[a] + off[c]
        done[c] = True
        open_ = open_[~go]
    root, depth, pre = root[head], depth[head] + pos, pre[head] + pos
    starts = np.zeros(n, dtype=np.int64)
    tops = np.flatnonzero(tall < 0)
    starts[tops] = np.cumsum(size[tops]) - size[tops]
    spot = starts[root] + pre
    at = np.empty(n, dtype=np.int64)
    at[spot] = every
    return Labels(trees.dictionary, texts, tree, node, tall, root, depth, lost, on_cycle, size, head, pos, pre, spot, at)


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of ``length`` numbers each, one after the other."""
    total = int(length.sum())
    shift = np.repeat(start - (np.cumsum(length) - length), length)
    return np.arange(total) + shift


def _slices(cells: np.ndarray) -> Iterator[slice]:
    """Stretches of nodes that make about ``CELLS`` cells each; a node with more stands alone."""
    sums, i = np.cumsum(cells), 0
    while i < len(cells):
        j = max(i + 1, int(np.searchsorted(sums, (sums[i - 1] if i else 0) + CELLS, side="right")))
        yield slice(i, j)
        i = j


def _names(g: Labels, nodes: np.ndarray) -> pa.Array:
    return g.texts.take(pa.array(g.node[nodes]))


def _base(g: Labels, some: slice | np.ndarray) -> dict[str, pa.Array]:
    v = np.arange(len(g.node))[some]
    return {"tree": g.trees.take(pa.array(g.tree[v])), "node_id": _names(g, v), "root_id": _names(g, g.root[v])}


def depths(g: Labels) -> Iterator[dict]:
    yield _base(g, slice(None)) | {"node_depth": pa.array(np.where(g.lost, -1, g.depth).astype(np.int32))}


def spans(g: Labels) -> Iterator[dict]:
    whole = g.size[g.root] - 1
    yield _base(g, slice(None)) | {
        "pre": pa.array(g.pre), "first": pa.array(np.where(g.on_cycle, 0, g.pre + 1)), "last": pa.array(np.where(g.on_cycle, whole, g.pre + g.size - 1)),
        "n_descendants": pa.array(np.where(g.on_cycle, whole, g.size - 1)), "lost": pa.array(g.lost),
    }


def paths(g: Labels) -> Iterator[dict]:
    """A path is the segments of the chains on the way to the root, one after the other."""
    cells = np.where(g.lost, 0, g.depth + 1)
    for some in _slices(cells):
        want = cells[some]
        out = np.empty(int(want.sum()), dtype=np.int64)
        begin = np.cumsum(want) - want
        v = np.arange(len(g.node))[some]
        keep = ~g.lost[some]
        v, begin = v[keep], begin[keep]
        while len(v):
            h, length = g.head[v], g.pos[v] + 1
            out[_ranges(begin + g.depth[h], length)] = g.at[_ranges(g.spot[h], length)]
            more = g.parent[h] >= 0
            v, begin = g.parent[h][more], begin[more]
        ends = np.concatenate([[0], np.cumsum(want)])
        # a null entry at either end of a list's offsets makes the list null
        offsets = pa.array(ends.astype(np.int32), mask=np.concatenate([g.lost[some], [False]]))
        yield _base(g, some) | {"node_depth": pa.array(np.where(g.lost, -1, g.depth)[some].astype(np.int32)), "path": pa.ListArray.from_arrays(offsets, _names(g, out))}


def descendants(g: Labels) -> Iterator[dict]:
    whole = g.size[g.root]
    cells = np.where(g.on_cycle, whole, g.size)
    first = np.where(g.on_cycle, g.spot - g.pre, g.spot)
    for some in _slices(cells):
        v = np.arange(len(g.node))[some]
        above, below = np.repeat(v, cells[some]), g.at[_ranges(first[some], cells[some])]
        own = above != below
        above, below = above[own], below[own]
        yield {"tree": g.trees.take(pa.array(g.tree[above])), "node_id": _names(g, above), "descendant_id": _names(g, below)}


WHAT = {"depths": depths, "spans": spans, "paths": paths, "descendants": descendants}


def run(what: str, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``what`` of all trees of rows sorted by tree; a tree may run over batches."""
    held: list[pa.RecordBatch] = []
    count = 0

    def out(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if len(rows):
            for cols in WHAT[what](label(rows)):
                t = pa.table(cols)
                yield from t.to_batches(max_chunksize=65_536)

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        count += b.num_rows
        if count < STEP_ROWS:
            continue
        rows = pa.Table.from_batches(held)
        cut = pc.index(rows["tree"], rows["tree"][-1]).as_py()
        yield from out(rows[:cut])
        held = rows[cut:].to_batches()
        count = len(rows) - cut
    if held:
        yield from out(pa.Table.from_batches(held))
