"""Connected components of a large sparse graph, as contractions, aggregates and joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm import words as w
from tapeloom.session import written_once

#: Edges that a task contracts at a time.
CHUNK = 1 << 19


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of some edges, and for each the node of its component that comes first by hash."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    order = np.argsort(w.mix(nodes.view(np.uint64)))
    place = np.empty(len(nodes), np.int64)
    place[order] = np.arange(len(nodes))
    nodes, parent = nodes[order], np.arange(len(nodes))
    x, y = place[at[:len(a)]], place[at[len(a):]]
    while len(x):
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent[parent] != parent).any():
            parent = parent[parent]
        x, y = parent[x], parent[y]
        x, y = x[x != y], y[x != y]
    return nodes, nodes[parent]


def contracted(edges: DataFrame) -> DataFrame:
    """``node, root`` of the components within each chunk of a task's edges."""

    def run(batches: Iterator[pa.RecordBatch]):
        held, size = [], 0

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array(x) for x in forest(*np.concatenate(held, axis=1))], names=["node", "root"])

        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy() for c in (0, 1)]))
            size += batch.num_rows
            if size >= CHUNK:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return edges.select("a", "b").mapInArrow(run, "node long, root long")


def components(edges: DataFrame, label: str = "component") -> DataFrame:
    """``node, root`` for every node of ``a, b``; the root is the component's least node.

    Every task contracts its edges, a chunk at a time. A node then has a root per
    chunk it occurs in; it takes one of them, and edges from that to the others
    are the next, smaller graph: of a component, the last node by hash is no root.
    A hub is one row per chunk, so no node's edges are gathered. Once no node has
    two roots, roots are replaced by theirs, level by level.
    """
    edges, levels = written_once(edges.filter("a <> b"), label), []
    while not levels or not edges.isEmpty():
        # a set per node, of a root for each chunk at most
        levels.append(written_once(contracted(edges).groupBy("node").agg(
            F.min("root").alias("root"), F.collect_set("root").alias("roots")), label))
        edges = levels[-1].filter("size(roots) > 1").select(
            F.col("root").alias("a"), F.explode("roots").alias("b")).filter("a <> b")
    found = levels.pop().select("node", "root")
    for level in reversed(levels):
        found = level.select("node", F.col("root").alias("old")).join(
            found.select(F.col("node").alias("old"), F.col("root").alias("new")), "old", "left").select(
            "node", F.coalesce("new", "old").alias("root"))
    # written, so that both sides of the join are plain exchanges and a large component's can be split
    found = written_once(found, label) if levels else found
    least = written_once(found.groupBy("root").agg(F.min("node").alias("least")), label)
    return found.join(least, "root").select("node", F.col("least").alias("root"))
