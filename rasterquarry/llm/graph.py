"""Connected components of an edge table, by distributed small stars and pointer jumps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut, spread_join

#: Edges that a task contracts at once before it emits their stars.
LOCAL_EDGES = 1 << 19


def _numbered(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    return nodes, ends[: len(a)], ends[len(a) :]


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) with the components of the edges (a, b), root the least node."""
    nodes, u, v = _numbered(a, b)
    root = np.arange(len(nodes))
    while True:
        ru, rv = root[u], root[v]
        if np.array_equal(ru, rv):
            break
        np.minimum.at(root, np.maximum(ru, rv), np.minimum(ru, rv))
        while not np.array_equal(root, hop := root[root]):
            root = hop
    off = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[off], nodes[root[off]]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the edges (a, b) that suffice for their components: fewer than nodes. A round hooks each root to a lesser one by one edge."""
    nodes, u, v = _numbered(a, b)
    root, picked = np.arange(len(nodes)), [np.zeros(0, np.int64)]
    while len(live := np.flatnonzero(root[u] != root[v])):
        ends = np.stack([root[u[live]], root[v[live]]])
        low, high = ends.min(0), ends.max(0)
        order = np.lexsort((low, high))
        pick = order[np.append(True, high[order][1:] != high[order][:-1])]
        root[high[pick]] = low[pick]
        picked.append(live[pick])
        while not np.array_equal(root, hop := root[root]):
            root = hop
    kept = np.concatenate(picked)
    return a[kept], b[kept]


def _contract(batches):
    a, b, n = [], [], 0
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _stars(np.concatenate(a), np.concatenate(b))], schema=schema)

    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
        n += batch.num_rows
        if n >= LOCAL_EDGES:
            yield flush()
            a, b, n = [], [], 0
    if n:
        yield flush()


def contracted(edges: DataFrame) -> DataFrame:
    """The stars of what each task holds. Sorted first, so that a task run again after a loss gives the same edges."""
    return edges.sortWithinPartitions("a", "b").mapInArrow(_contract, "a long, b long").distinct()


def _content(edges: DataFrame) -> tuple:
    """What tells one edge table from another: its count and the sum of its rows' hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge and isn't the least of its component.

    edges: columns a and b, long, without nulls; loops and repeats may occur, no edges give no rows. Every task first
    contracts what it holds, so a node leads at most one edge a task. A round then links each node to its least
    neighbour, links its other neighbours to that one, and moves every edge to its end's own parent. Ends that are
    common to a large part of all edges are joined apart (spread_join), so no task holds a component. A round's edges
    are written to the shared folder, in as many files as their number needs: a round never adds edges. When none
    changes, they are stars.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e = cut(contracted(e))
    state = None
    while True:
        now = _content(e)
        if now == state or not now[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
        p = e.groupBy("a").agg(F.min("b").alias("m"))
        rest = e.join(p, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        small = cut(p.select("a", F.col("m").alias("b")).unionByName(rest), most=now[0])
        up = p.select(F.col("a").alias("b"), "m")
        e = cut(contracted(spread_join(small, up, "b").select("a", F.coalesce("m", "b").alias("b"))), most=now[0])
