"""Connected components of a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.scratch import drop, save

#: Edges that a task contracts at once before they are shuffled.
CONTRACT = 1 << 20
#: So many edges, 256 kB, are finished in one task; a round of stars costs more than that.
FEW = 1 << 14


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of an edge list and, for each, the smallest node of its component."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(root, high, low)
        while not np.array_equal(up := root[root], root):
            root = up
        x, y = root[x], root[y]
        open_ = x != y
        x, y = x[open_], y[open_]
    return nodes, nodes[root]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out() -> pa.RecordBatch:
        nodes, root = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        own = nodes != root
        return pa.RecordBatch.from_pydict({"u": nodes[own], "v": root[own]})

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(x) for x, _ in held) >= CONTRACT:
            yield out()
            held = []
    if held:
        yield out()


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        nodes, root = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_pydict({"node": nodes, "component": root})


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes in edges (a, b), both long and not null; component is the smallest node.

    Each round is a few aggregations and joins on nodes and ends in a table in the shared folder;
    the number of rounds grows with the logarithm of the nodes. No component is gathered anywhere
    unless all edges together, contracted by task, are FEW, which changes no result.
    An empty edge list has no nodes.
    """
    e = save(edges.mapInArrow(_contract, "u long, v long").distinct(), "edges")
    if e.count() <= FEW:
        return e.coalesce(1).mapInArrow(_finish, "node long, component long")
    state = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        new = save(small.filter("u != v").distinct(), "edges")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(e)
        e = new
        if now == state:
            break
        state = now
    roots = e.select("v").distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select(F.col("v").alias("node"), F.col("v").alias("component")))
