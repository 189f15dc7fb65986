"""Embedding near-dedup: an epsilon grid order join of unit vectors.

Vectors of equal labels whose cosine reaches a bound are at most eps apart on the unit sphere.
They are sorted by their grid cells on the leading principal dimensions and cut into blocks in that
order. The sequence of blocks is joined with itself recursively, all intervals of one length at a
time: pairs of intervals whose boxes are provably more than eps apart are skipped, pairs whose balls
provably lie within eps of each other are linked as a whole, whatever their length, and others are
split. Pairs of blocks that are left meet in one task each, which goes on in the same way with
halves of the two blocks and compares what is left by matrix products. Links are counted, and sent
on only as the edges of a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.components import components, forest
from tessel.llm.scratch import batched, save

MIN_COSINE = 0.98
#: Leading principal dimensions of the grid; vectors in a block, and in a leaf of the recursion.
AXES, BLOCK, LEAF = 6, 1024, 64
#: An interval of blocks is split into 2**FAN parts.
FAN = 4
_SAFE = 1e-9


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow or underflow of squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _by_dim(dims: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for d in np.unique(dims):
        yield int(d), np.flatnonzero(dims == d)


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """By number of dimensions, the AXES leading axes of all unit vectors. A task sends one matrix
    for each number of dimensions that it has seen, row by row, and rows are added up apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, at in _by_dim(batch.column(1).to_numpy()):
                x = _unit(_matrix(batch.column(0).take(pa.array(at)), d))
                x = np.hstack((x, np.ones((len(x), 1))))
                sums[d] = sums.get(d, 0) + x.T @ x
        for d, m in sums.items():
            rows = [row.tobytes() for row in m]
            yield pa.RecordBatch.from_pydict({"dim": pa.array([d] * len(rows), pa.int32()), "i": pa.array(range(len(rows)), pa.int32()), "m": pa.array(rows, pa.binary())})

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(m, np.float64) for m in table["m"].to_pylist())
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "i": pa.array([key[1].as_py()], pa.int32()), "m": pa.array([total.tobytes()], pa.binary())})

    kinds = "dim int, i int, m binary"
    got = vectors.select("embedding", "dim").mapInArrow(run, kinds).groupBy("dim", "i").applyInArrow(add, kinds).toArrow().sort_by("i")
    out = {}
    for d, at in _by_dim(got["dim"].to_numpy()):
        s = np.stack([np.frombuffer(m, np.float64) for m in got["m"].take(pa.array(at)).to_pylist()])
        mean = s[:d, d] / s[d, d]
        out[d] = np.linalg.eigh(s[:d, :d] / s[d, d] - np.outer(mean, mean))[1][:, ::-1][:, :AXES].copy()
    return out


@dataclass
class Joiner:
    """Joins two blocks: counts of links by row, and linked pairs as (row of a, row of b)."""

    a: np.ndarray
    b: np.ndarray
    pa_: np.ndarray  # projections
    pb: np.ndarray
    cosine: float
    same: bool

    def run(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        self.eps = float(np.sqrt(2 - 2 * self.cosine))
        self.na, self.nb = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self._join(0, len(self.a), 0, len(self.b))
        if self.same:
            self.na += self.nb
        i, j = (np.concatenate(x) for x in zip(*self.edges, strict=True)) if self.edges else (np.zeros(0, int), np.zeros(0, int))
        return self.na, self.nb, i, j

    def _join(self, a0: int, a1: int, b0: int, b1: int) -> None:
        """Rows a0 to a1 with b0 to b1; of one block with itself, only pairs of a lower and a higher row."""
        if self.same and a0 > b0:
            return
        x, y = self.pa_[a0:a1], self.pb[b0:b1]
        gap = np.maximum(np.maximum(x.min(0) - y.max(0), y.min(0) - x.max(0)), 0)
        if (gap * gap).sum() > (self.eps + _SAFE) ** 2:
            return
        own = self.same and a0 == b0
        if a1 - a0 > LEAF or b1 - b0 > LEAF:
            if self._all(a0, a1, b0, b1, own):
                return
            if own:
                m = (a0 + a1) // 2
                for part in ((a0, m, a0, m), (a0, m, m, a1), (m, a1, m, a1)):
                    self._join(*part)
            elif a1 - a0 >= b1 - b0:
                m = (a0 + a1) // 2
                self._join(a0, m, b0, b1)
                self._join(m, a1, b0, b1)
            else:
                m = (b0 + b1) // 2
                self._join(a0, a1, b0, m)
                self._join(a0, a1, m, b1)
            return
        hit = self.a[a0:a1] @ self.b[b0:b1].T >= self.cosine
        if own:
            hit = np.triu(hit, 1)
        self.na[a0:a1] += hit.sum(1)
        self.nb[b0:b1] += hit.sum(0)
        i, j = np.nonzero(hit)
        if len(i):
            self.edges.append((i + a0, j + b0))

    def _all(self, a0: int, a1: int, b0: int, b1: int, own: bool) -> bool:
        """Links all pairs if two balls around the rows show that none is too far apart."""
        x, y = self.a[a0:a1], self.b[b0:b1]
        cx, cy = x.mean(0), y.mean(0)
        far = lambda v, c: np.sqrt(((v - c) ** 2).sum(1).max())
        if np.linalg.norm(cx - cy) + far(x, cx) + far(y, cy) > self.eps - _SAFE:
            return False
        if own:
            up = np.arange(a1 - a0)
            self.na[a0:a1] += up[::-1]
            self.nb[a0:a1] += up
            self.edges.append((np.full(a1 - a0 - 1, a0), np.arange(a0 + 1, a1)))
        else:
            self.na[a0:a1] += b1 - b0
            self.nb[b0:b1] += a1 - a0
            self.edges.append((np.full(b1 - b0, a0), np.arange(b0, b1)))
            self.edges.append((np.arange(a0, a1), np.full(a1 - a0, b0)))
        return True


_BLOCK = "block long, label {label}, dim int, size long, low binary, high binary, centre binary, radius double, ids array<{id}>, vectors binary"


def _blocks(vectors: DataFrame, axes: dict[int, np.ndarray], cosine: float) -> DataFrame:
    """Vectors in grid order, cut into blocks of one label. Saved."""
    held = vectors.sparkSession.sparkContext.broadcast(axes)
    eps = float(np.sqrt(2 - 2 * cosine))
    label, vec_id = (vectors.schema[c].dataType.simpleString() for c in ("label", "vec_id"))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            grid = np.zeros((len(dims), AXES), np.int64)
            for d, at in _by_dim(dims):
                ax = held.value[d]
                grid[at, : ax.shape[1]] = np.floor(_unit(_matrix(batch.column(2).take(pa.array(at)), d)) @ ax / eps)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(grid[:, i]) for i in range(AXES))], names=[*batch.schema.names, *(f"c{i}" for i in range(AXES))])

    grid = [f"c{i}" for i in range(AXES)]
    kinds = f"label {label}, vec_id {vec_id}, embedding array<double>, dim int, " + ", ".join(f"{c} long" for c in grid)
    order = ["label", "dim", *grid, "vec_id"]
    rows = vectors.select("label", "vec_id", F.col("embedding").cast("array<double>"), "dim").mapInArrow(cells, kinds)
    # the order ends in the id, so a cell that holds many vectors is split
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("label", "vec_id", "embedding", "dim")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            dims = batch.column(3).to_numpy()
            labels = batch.column(0).to_numpy(zero_copy_only=False)
            new = np.flatnonzero((dims[1:] != dims[:-1]) | (labels[1:] != labels[:-1])) + 1
            for s, e in zip([0, *new], [*new, len(dims)], strict=True):
                for a in range(s, e, BLOCK):
                    b, d = min(a + BLOCK, e), int(dims[a])
                    x = _unit(_matrix(batch.column(2).slice(a, b - a), d))
                    p = x @ held.value[d]
                    centre = x.mean(0)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([block]), batch.column(0).slice(a, 1), pa.array([d], pa.int32()), pa.array([b - a]), pa.array([p.min(0).tobytes()]), pa.array([p.max(0).tobytes()]),
                            pa.array([centre.tobytes()]), pa.array([np.sqrt(((x - centre) ** 2).sum(1).max())]),
                            pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), batch.column(1).slice(a, b - a)), pa.array([x.tobytes()]),
                        ],
                        names=["block", "label", "dim", "size", "low", "high", "centre", "radius", "ids", "vectors"],
                    )
                    block += 1

    return save(rows.mapInArrow(cut, _BLOCK.format(label=label, id=vec_id)), "blocks")


def _rows(column: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(v, np.float64) for v in column])


def _merge(key: tuple, table: pa.Table) -> pa.Table:
    """An interval's box and ball, from those of its parts, and these beside it."""
    parts = table.sort_by("node").to_pydict()
    low, high, centre = (_rows(parts[c]) for c in ("low", "high", "centre"))
    size, radius = np.array(parts["size"]), np.array(parts["radius"])
    mid = (centre * size[:, None]).sum(0) / size.sum()
    own = {
        "node": pa.array([key[2].as_py()]), "size": pa.array([int(size.sum())]), "first": pa.array([parts["first"][0]]), "low": pa.array([low.min(0).tobytes()]),
        "high": pa.array([high.max(0).tobytes()]), "centre": pa.array([mid.tobytes()]), "radius": pa.array([float((np.sqrt(((centre - mid) ** 2).sum(1)) + radius).max())]),
    }
    held = {f"p_{c}": pa.array([parts[c]]) for c in ("node", "size", "first", "radius")} | {f"p_{n}": pa.array([m.tobytes()]) for n, m in (("low", low), ("high", high), ("centre", centre))}
    return pa.table({"label": table["label"].slice(0, 1), "dim": table["dim"].slice(0, 1)} | own | held)


_OWN = "node long, size long, first long, low binary, high binary, centre binary, radius double"
_PARTS = "p_node array<long>, p_size array<long>, p_first array<long>, p_radius array<double>, p_low binary, p_high binary, p_centre binary"


def _split(eps: float):
    """For pairs of intervals, the pairs of their parts that are not provably apart, with n > 0 where all
    vectors of a part link with all of the other: with how many of them a vector does, and one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, r in enumerate(batch.drop_columns(["label"]).to_pylist()):
                d, sides = r["dim"], []
                for s in "ab":
                    low, high = (np.frombuffer(r[f"{s}_p_{c}"], np.float64).reshape(-1, min(AXES, d)) for c in ("low", "high"))
                    sides.append((low, high, np.frombuffer(r[f"{s}_p_centre"], np.float64).reshape(-1, d), *(np.array(r[f"{s}_p_{c}"]) for c in ("radius", "node", "size", "first"))))
                (la, ha, ca, ra, a, na, fa), (lb, hb, cb, rb, b, nb, fb) = sides
                gap = np.maximum(np.maximum(la[:, None] - hb[None], lb[None] - ha[:, None]), 0)
                near = (gap * gap).sum(2) <= (eps + _SAFE) ** 2
                if r["a"] == r["b"]:
                    near = np.triu(near)
                x, y = np.nonzero(near)
                if len(x):
                    ball = np.sqrt(((ca[x] - cb[y]) ** 2).sum(1)) + ra[x] + rb[y]
                    whole = ball <= eps - _SAFE
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("label").take(pa.array([i] * len(x))), pa.array([d] * len(x), pa.int32()), *map(pa.array, (a[x], b[y], whole, na[x], nb[y], fa[x], fb[y]))],
                        names=["label", "dim", "a", "b", "whole", "na", "nb", "fa", "fb"],
                    )

    return run


def _pairs(blocks: DataFrame, eps: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs (a, b, dim), a <= b, of blocks that may hold links; (block, n, hub): each of a block's vectors
    links with n more, hub among them, or is hub itself; edges (a, b) between vectors in such links.

    Blocks of a label are one sequence, numbered with gaps between tasks; its intervals of 2**FAN
    blocks, of 2**(2 * FAN) and so on are joined from the whole sequence downwards."""
    label = blocks.schema["label"].dataType.simpleString()
    most = blocks.agg(F.max(F.shiftright("block", 32)).alias("task"), F.max(F.col("block").bitwiseAND(0xFFFFFFFF)).alias("n")).first()
    low = (most["n"] or 0).bit_length()
    height = max(1, -(-(low + (most["task"] or 0).bit_length()) // FAN))
    node = F.shiftleft(F.shiftright("block", 32), low) + F.col("block").bitwiseAND(0xFFFFFFFF)
    block = lambda c: F.shiftleft(F.shiftright(c, low), 32) + F.col(c).bitwiseAND((1 << low) - 1)
    levels = [blocks.select("label", "dim", node.alias("node"), "size", _vector(F.col("block")).alias("first"), "low", "high", "centre", "radius")]
    for _ in range(height):
        nodes = levels[-1].select("label", "dim", *(c.split()[0] for c in _OWN.split(", ")))
        up = nodes.groupBy("label", "dim", F.shiftright("node", FAN).alias("up")).applyInArrow(_merge, f"label {label}, dim int, {_OWN}, {_PARTS}")
        levels.append(save(up, "intervals"))
    pairs, wholes = levels[-1].select("label", "dim", F.col("node").alias("a"), F.col("node").alias("b")), []
    for level in range(height, 0, -1):
        parts = [c.split()[0] for c in _PARTS.split(", ")]
        side = lambda s: levels[level].select("label", "dim", F.col("node").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in parts))  # noqa: B023, E731
        rows = pairs.join(side("a"), ["label", "dim", "a"]).join(side("b"), ["label", "dim", "b"])
        found = save(batched(rows, _split(eps), f"label {label}, dim int, a long, b long, whole boolean, na long, nb long, fa long, fb long"), "interval-pairs")
        pairs = found.filter("not whole").select("label", "dim", "a", "b")
        wholes.append(found.filter("whole").withColumn("level", F.lit(level - 1)))
    whole = reduce(DataFrame.union, wholes)
    of_a = whole.select("label", "dim", "level", F.col("a").alias("node"), F.expr("nb - int(a = b)").alias("n"), F.col("fb").alias("hub"))
    of_b = whole.filter("a != b").select("label", "dim", "level", F.col("b").alias("node"), F.col("na").alias("n"), F.col("fa").alias("hub"))
    each = of_a.union(of_b).groupBy("label", "dim", "level", "node").agg(F.sum("n").alias("n"), F.min("hub").alias("hub"))
    above = blocks.select("block", "label", "dim", node.alias("at"), F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("level"))
    above = above.select("block", "label", "dim", "level", F.expr(f"shiftright(at, {FAN} * level)").alias("node")).join(each, ["label", "dim", "level", "node"])
    above = save(above.select("block", "n", "hub"), "near-intervals")
    of_block = above.groupBy("block").agg(F.sum("n").alias("n"), F.min("hub").alias("hub"))
    edges = whole.select(F.col("fa").alias("a"), F.col("fb").alias("b")).union(above.select(_vector(F.col("block")), "hub"))
    return pairs.select(block("a").alias("a"), block("b").alias("b"), "dim"), of_block, edges


def _vector(block: Column) -> Column:
    """The number by which the first vector of a block is known; see _joined."""
    return F.shiftright(block, 32) * F.lit(1 << 48) + F.shiftleft(block.bitwiseAND(0xFFFFFFFF), 16)


def _joined(pairs: DataFrame, blocks: DataFrame, axes: dict[int, np.ndarray], cosine: float) -> DataFrame:
    """Rows (u, n, v): n links of vector u found here; and edges (u, v) of a spanning forest, n 0.
    A vector is known as block * 2**16 + its row, blocks being counted within 2**32 and tasks within 2**15."""
    held = pairs.sparkSession.sparkContext.broadcast(axes)
    name = lambda block, row: ((block >> 32) * (1 << 48)) + ((block & 0xFFFFFFFF) << 16) + row
    side = lambda s: blocks.select(F.col("block").alias(s), F.col("vectors").alias(f"x{s}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "dim", "xa", "xb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, d, xa, xb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = (np.frombuffer(v, np.float64).reshape(-1, d) for v in (xa, xb))
                ax = held.value[d]
                na, nb, i, j = Joiner(x, y, x @ ax, y @ ax, cosine, a == b).run()
                u, n = [name(a, np.flatnonzero(na))], [na[na > 0]]
                if a != b:
                    u.append(name(b, np.flatnonzero(nb)))
                    n.append(nb[nb > 0])
                node, root = forest(name(a, i), name(b, j)) if len(i) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                own = node != root
                u.append(node[own])
                n.append(np.zeros(own.sum(), np.int64))
                u, n = np.concatenate(u), np.concatenate(n)
                if len(u):
                    v = np.concatenate((np.full(len(u) - own.sum(), -1), root[own]))
                    yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "n": pa.array(n, pa.int64()), "v": pa.array(v, pa.int64())})

    return save(rows.mapInArrow(run, "u long, n long, v long"), "near-vectors")


def near_duplicates(embeddings: DataFrame, cosine: float = MIN_COSINE) -> DataFrame:
    """One row per row of embeddings: vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null, their dimensions are as many and their
    cosine is at least the bound. Null, empty or zero vectors and those with null or non-finite
    components link with nothing. component_id is the smallest vec_id reachable by links; rows with
    a null vec_id name none unless all are null. Repeated rows are vectors of their own. Other
    columns are left aside.
    """
    x = embeddings.select("vec_id", "label", "embedding")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    good = F.coalesce(F.col("label").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda v: v != 0), F.lit(False))
    vectors = x.filter(good).withColumn("dim", F.size("embedding"))
    axes = principal_axes(vectors)
    blocks = _blocks(vectors, axes, cosine)
    pairs, of_block, edges = _pairs(blocks, float(np.sqrt(2 - 2 * cosine)))
    found = _joined(pairs, blocks, axes, cosine)
    links = found.filter("n > 0").groupBy("u").agg(F.sum("n").alias("n_links"))
    each = blocks.select("block", F.posexplode("ids").alias("i", "vec_id")).join(of_block, "block", "left")
    each = each.select((_vector(F.col("block")) + F.col("i")).alias("u"), "vec_id", F.coalesce("n", F.lit(0)).alias("more"), "hub")
    edges = edges.union(each.select("u", "hub").filter("hub is not null")).filter("a != b")
    edges = edges.union(found.filter("v >= 0").select("u", "v"))
    each = each.join(links, "u", "left").join(components(edges).withColumnRenamed("node", "u"), "u", "left")
    each = each.withColumn("component", F.coalesce("component", "u"))
    low = each.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    linked = each.join(low, "component").select("vec_id", (F.coalesce("n_links", F.lit(0)) + F.col("more")).cast("long").alias("n_links"), "component_id")
    alone = x.filter(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op6_epsilon_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings at a cosine of 0.98 or more within their label."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
