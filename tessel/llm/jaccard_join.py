"""N-gram Jaccard join: texts whose sets of word shingles are similar, found exactly.

1. Each text becomes its set of shingle hashes; equal sets are one node from here on.
2. A set's prefix, its least common shingles, must meet that of every set it links with. Prefix
   shingles of one set only are dropped, and of shingles with the same sets one is enough.
3. The sets at a shingle form tiles by size band; in a tile the bit counts of hashed bitmaps bound
   the overlap from above. What survives gives candidate groups.
4. In a candidate group, cut by size band into blocks of bounded bytes, sets that pass the bit
   bound are compared by exact intersection of sorted arrays.

Tiles and blocks send on the edges of a spanning forest, never all pairs: a set that has been
reached is not compared again. The common order of shingles comes from a sketch of fixed size over
all texts; any order gives the same links. Texts that are mutually unlinked but share rare shingles
in great number are the worst case: chunks of them meet all parts of their size bands.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.llm import tokens as T
from tessel.llm.components import components
from tessel.llm.scratch import batched, bit_filter, drop, may_hold, save

#: Counters of the sketch of shingle frequencies.
SKETCH = 1 << 20
#: Sets in a tile, shingles in a block, hub sets that are in every block of a large candidate group.
TILE, BLOCK, HUBS = 4096, 1 << 21, 16
#: Up to so many ids of rows that go are broadcast, some 20 MB.
MAX_BROADCAST_IDS = 1_000_000
#: A tile has as many bits for each shingle at least.
BITS = 2


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, and their bounds. Fewer than k words: all of
    them as one shingle; no word: the empty set."""
    t = T.words(data, offsets, lower=True)
    key, at = T.windows(t, k)
    owner = t.owner()[at]
    short = np.flatnonzero((t.counts > 0) & (t.counts < k))
    if len(short):
        whole = np.array([int(T.combine(*t.hash[t.bounds[i] : t.bounds[i + 1]].reshape(-1, 1))[0]) for i in short], np.uint64)
        key, owner = np.concatenate((key, whole)), np.concatenate((owner, short))
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    key, owner = key[new], owner[new]
    return key, np.searchsorted(owner, np.arange(len(offsets)))


def set_ids(key: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each whole set, its size included."""
    total = np.zeros(len(key) + 1, np.uint64)
    np.cumsum(T.mix(key), out=total[1:])
    twice = np.zeros(len(key) + 1, np.uint64)
    np.cumsum(T.mix(key * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)), out=twice[1:])
    return T.combine(total[bounds[1:]] - total[bounds[:-1]], twice[bounds[1:]] - twice[bounds[:-1]], np.diff(bounds).astype(np.uint64))


def width(n: int) -> int:
    """Bits of the bitmap of a set of n: a power of two, 64 at least."""
    return 1 << max(6, int(np.ceil(np.log2(max(1, BITS * n)))))


def bitmap(key: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits // 64, np.uint64)
    bit = key & np.uint64(bits - 1)
    np.bitwise_or.at(out, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


def _may_link(n: np.ndarray, m: np.ndarray, apart: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m that differ in at least so many shingles can reach the similarity."""
    both = (n + m - apart) // 2
    both = np.minimum(both, np.minimum(n, m))
    return 100 * both >= percent * (n + m - both)


def reach(n: np.ndarray, bits: np.ndarray, percent: int, exact: Callable[[int, np.ndarray], np.ndarray] | None = None, label: np.ndarray | None = None) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the sets that link. Each set is compared with those not reached
    yet. exact(i, js): which of js truly link with i. label: sets of one label count as linked."""
    left = np.argsort(n, kind="stable")
    a: list[int] = []
    b: list[int] = []
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            i = todo.pop()
            ok = np.zeros(len(left), bool)
            if label is not None:
                same = label[left] == label[i]
                todo.extend(left[same].tolist())
                left = left[~same]
                ok = np.zeros(len(left), bool)
            near = np.flatnonzero((100 * n[left] >= percent * n[i]) & (100 * n[i] >= percent * n[left]))
            if len(near):
                js = left[near]
                apart = np.bitwise_count(bits[js] ^ bits[i]).sum(1, dtype=np.int64)
                may = _may_link(n[js], n[i], apart, percent)
                near, js = near[may], js[may]
                if exact is not None and len(js):
                    near = near[exact(i, js)]
                ok[near] = True
            if ok.any():
                js = left[ok].tolist()
                a.extend([i] * len(js))
                b.extend(js)
                todo.extend(js)
                left = left[~ok]
    return a, b


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Runs of whole groups of rows that are sorted by their first columns, with the groups' bounds."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for c in range(keys):
            x = table.column(c).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if all(batch.column(c)[batch.num_rows - 1] == held[0].column(c)[0] for c in range(keys)):
            continue  # still the first group
        table = pa.Table.from_batches(held).combine_chunks()
        starts = cut(table)
        yield table.slice(0, starts[-1]), starts
        held = table.slice(starts[-1]).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.append(cut(table), table.num_rows)


def _binary(column: pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column as one array, and the bounds of the rows."""
    x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = x.cast(pa.large_binary())
    _, offsets, data = x.buffers()
    at = np.frombuffer(offsets, np.int64)[x.offset : x.offset + len(x) + 1]
    size = np.dtype(dtype).itemsize
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(dtype) if len(x) else np.zeros(0, dtype), (at - at[0]) // size


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _sketch(docs: DataFrame, k: int) -> np.ndarray:
    """Counts of shingles by hash, of those that stand out in some task: a task sends the counters that
    are two deviations above its mean, so what it sends doesn't grow with the sketch. Other shingles
    are as rare as can be told, and come in the order of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for _, _, data, offsets in T.chunks(batch.column(0)):
                key, _ = shingle_sets(data, offsets, k)
                np.add.at(count, (key >> np.uint64(44)).astype(np.int64) & (SKETCH - 1), 1)
        mean = count.mean()
        at = np.flatnonzero(count > mean + 2 * np.sqrt(mean) + 1)
        yield pa.RecordBatch.from_pydict({"k": at, "c": count[at] - int(mean)})

    # SKETCH rows at most
    got = batched(docs.select("text"), run, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(SKETCH, np.int64)
    out[got["k"].to_numpy()] = got["c"].to_numpy()
    return out


def _read_sets(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n, node; and for the first text of a node in a task its prefix keys and its bitmap. Saved."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(_sketch(docs, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for a, b, data, offsets in T.chunks(batch.column(1)):
                key, bounds = shingle_sets(data, offsets, k)
                n, node = np.diff(bounds), T.signed(set_ids(key, bounds))
                common = held.value[(key >> np.uint64(44)).astype(np.int64) & (SKETCH - 1)]
                order = np.lexsort((key, common, np.repeat(np.arange(b - a), n)))
                prefix = np.where(n > 0, n + (-percent * n // 100) + 1, 0)  # n - ceil(percent * n / 100) + 1
                keys, maps = [], []
                for i in range(b - a):
                    if not n[i] or int(node[i]) in seen:
                        keys.append(None)
                        maps.append(None)
                        continue
                    seen.add(int(node[i]))
                    keys.append(T.signed(key[order[bounds[i] : bounds[i] + prefix[i]]]))
                    maps.append(bitmap(key[bounds[i] : bounds[i + 1]], width(int(n[i]))).tobytes())
                if len(seen) > 1 << 20:
                    seen.clear()
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(a, b - a), "n": n, "node": node, "keys": pa.array(keys, pa.list_(pa.int64())), "bits": pa.array(maps, pa.binary())})

    return save(batched(docs.select("doc_id", "text"), run, f"doc_id {kind}, n long, node long, keys array<long>, bits binary"), "sets")


def _tile_edges(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in grouped(batches, 2):
            node, n = (table[c].to_numpy() for c in ("node", "n"))
            bits, at = _binary(table["bits"], np.uint64)
            a: list[np.ndarray] = []
            b: list[np.ndarray] = []
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                if e - s > 1:
                    words = int(np.diff(at[s : e + 1]).min())
                    i, j = reach(n[s:e], np.stack([fold(bits[at[r] : at[r + 1]], words) for r in range(s, e)]), percent)
                    a.append(node[s:e][i])
                    b.append(node[s:e][j])
            if a:
                yield _edges(np.concatenate(a), np.concatenate(b))

    return run


def _band(n: Column, percent: int) -> Column:
    return F.floor(F.log(n) / F.log(F.lit(100.0 / percent)) + 1e-9)


def _candidates(sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between nodes, whose components hold all links. Saved.

    The sets at a key beyond TILE are linked tile by tile without bitmaps: most are copies of one
    text, and the exact comparison that follows sorts out the rest."""
    rows = sets.filter("keys is not null").select(F.explode("keys").alias("key"), "node", "n")
    shared = rows.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low != high").select("key")
    rows = save(rows.join(shared, "key").distinct(), "prefixes")
    rows = rows.join(rows.groupBy("key").agg(F.count("*").alias("size")), "key")
    # sets that link are in one size band or in neighbours: a tile is two neighbouring bands at a key
    band = lambda n: _band(n, percent)
    hot = rows.filter(F.col("size") > TILE).select("key", "node", F.explode(F.array(band(F.col("n")) - 1, band(F.col("n")))).alias("tile"))
    ends = hot.groupBy("key", "tile").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low != high")
    large = hot.join(ends, ["key", "tile"]).filter("node != low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    # of a key's nodes in order of size, one can only link if a neighbour is near enough in size
    by = Window.partitionBy("key").orderBy("n", "node")
    near = lambda less, more: F.coalesce(100 * less >= percent * more, F.lit(False))
    small = rows.filter(F.col("size") <= TILE).select("key", "node", "n", near(F.lag("n").over(by), F.col("n")).alias("below"), near(F.col("n"), F.lead("n").over(by)).alias("above"))
    small = save(small.filter("below or above").select("key", "node", "n"), "neighbours")
    # of keys with the same nodes one is enough
    at = small.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("low"), F.max("node").alias("high"), F.bit_xor(F.xxhash64("node")).alias("all"), F.min("n").alias("least"), F.max("n").alias("most"))
    at = at.groupBy("size", "low", "high", "all").agg(F.min("key").alias("key"), F.min("least").alias("least"), F.max("most").alias("most"))
    own, low, high = band(F.col("n")), band(F.col("least")), band(F.col("most"))
    tile = F.when(high - low <= 1, F.array(low)).otherwise(F.array(own - 1, own))
    bits = sets.filter("bits is not null").groupBy("node").agg(F.first("bits").alias("bits"))
    tiles = small.join(at.select("key", "least", "most"), "key").select(F.explode(tile).alias("tile"), "key", "node", "n").join(bits, "node").select("tile", "key", "node", "n", "bits")
    tiles = tiles.repartition("tile", "key").sortWithinPartitions("tile", "key", "n", "node")
    # saved, so that a task of the next pass has no second Python worker
    return save(large.union(batched(tiles, _tile_edges(percent), "a long, b long")), "candidates")


def _arrays(docs: DataFrame, k: int, nodes: DataFrame) -> DataFrame:
    """node, keys: the sorted shingles of the sets in nodes, one row a node. Other sets are left out
    where they are read, but for the filter's false hits."""
    held = docs.sparkSession.sparkContext.broadcast(bit_filter(nodes.select(F.xxhash64("node"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, offsets in T.chunks(batch.column(0)):
                key, bounds = shingle_sets(data, offsets, k)
                node = set_ids(key, bounds)
                hit = may_hold(held.value, _xxhash64_long(node))
                out_node, out_keys = [], []
                for i in np.flatnonzero(hit & (np.diff(bounds) > 0)):
                    if int(node[i]) not in seen:
                        seen.add(int(node[i]))
                        out_node.append(node[i])
                        out_keys.append(key[bounds[i] : bounds[i + 1]].tobytes())
                if len(seen) > 1 << 20:
                    seen.clear()
                if out_node:
                    yield pa.RecordBatch.from_pydict({"node": pa.array(T.signed(np.array(out_node, np.uint64))), "keys": pa.array(out_keys, pa.binary())})

    return batched(docs.select("text"), run, "node long, keys binary")


def _xxhash64_long(x: np.ndarray, seed: int = 42) -> np.ndarray:
    """Spark's xxhash64 of one long column."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    rot = lambda v, r: (v << np.uint64(r)) | (v >> np.uint64(64 - r))
    h = np.full(len(x), seed + int(p5) + 8, np.uint64)
    h ^= rot(x.astype(np.uint64) * p2, 31) * p1
    h = rot(h, 27) * p1 + p4
    h ^= h >> np.uint64(33)
    h *= p2
    h ^= h >> np.uint64(29)
    h *= p3
    return h ^ (h >> np.uint64(32))


def _block_edges(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows: grp, block, node, label, keys. Edges of a spanning forest of true links in each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in grouped(batches, 2):
            node, label = table["node"].to_numpy(), table["label"].to_numpy()
            keys, at = _binary(table["keys"], np.uint64)
            n = np.diff(at)
            a: list[np.ndarray] = []
            b: list[np.ndarray] = []
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                if e - s < 2:
                    continue
                sets = [keys[at[r] : at[r + 1]] for r in range(s, e)]
                bits = width(int(n[s:e].max()))
                maps = np.stack([bitmap(x, bits) for x in sets])

                def exact(i: int, js: np.ndarray, sets=sets) -> np.ndarray:
                    own, other = sets[i], np.concatenate([sets[j] for j in js])
                    place = np.minimum(np.searchsorted(own, other), len(own) - 1)
                    size = np.array([len(sets[j]) for j in js])
                    both = np.add.reduceat((own[place] == other).astype(np.int64), np.cumsum(size) - size)
                    return 100 * both >= percent * (len(own) + size - both)

                i, j = reach(n[s:e], maps, percent, exact, label[s:e])
                a.append(node[s:e][i])
                b.append(node[s:e][j])
            if a:
                yield _edges(np.concatenate(a), np.concatenate(b))

    return run


def links(docs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, component) of the nodes that link with another; component is the smallest node.

    A candidate group beyond BLOCK shingles is cut by size band and hash. Its first pass compares each
    part, together with hub sets of its band and the next. Every link that is missing then has an
    end outside the largest component of the group: those sets, in chunks, meet all parts of their
    own and neighbouring bands.
    """
    pairs = _candidates(sets, percent)
    group = save(components(pairs).withColumnRenamed("component", "grp"), "groups")
    drop(pairs)
    arrays = _arrays(docs, k, group).join(group, "node").groupBy("node").agg(F.first("grp").alias("grp"), F.first("keys").alias("keys"))
    n = (F.octet_length("keys") / 8).cast("long")
    arrays = save(arrays.withColumn("n", n).withColumn("band", _band(F.col("n"), percent)), "arrays")
    # parts of each band of a large group
    large = arrays.groupBy("grp").agg(F.sum("n").alias("all")).filter(F.col("all") > BLOCK).select("grp")
    slots = arrays.select("grp", "band", "n").join(large, "grp").groupBy("grp", "band").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("parts"), (F.count("*") / HUBS + 1).cast("long").alias("hub_of"))
    slots = save(slots, "slots")
    beside = lambda t, by, *cols: t.select("grp", F.explode(F.array(*(F.col("band") + i for i in by))).alias("band"), *cols)
    below = beside(slots, [1], F.col("parts").alias("below"))
    rows = arrays.join(slots.join(below, ["grp", "band"], "left"), ["grp", "band"], "left")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    block = lambda band, part: band * (1 << 24) + part
    every = lambda band, parts: F.transform(F.sequence(F.lit(0), parts - 1), lambda j: block(band, j))
    hub = F.pmod(F.xxhash64("node", F.lit(1)), F.col("hub_of")) == 0
    some = F.concat(every(F.col("band"), F.col("parts")), F.when(F.col("below").isNull(), F.array().cast("array<bigint>")).otherwise(every(F.col("band") - 1, F.col("below"))))
    to = F.when(F.col("parts").isNull(), F.array(F.lit(-1).cast("long"))).when(hub, some).otherwise(F.array(block(F.col("band"), own)))
    edges = save(_in_blocks(rows.select("grp", F.explode(to).alias("block"), "node", F.col("node").alias("label"), "keys"), percent), "links")
    if slots.isEmpty():
        return components(edges)
    found = save(components(edges), "components")
    label = arrays.join(slots, ["grp", "band"]).join(found, "node", "left").withColumn("label", F.coalesce("component", "node"))
    top = label.groupBy("grp", "label").agg(F.count("*").alias("sets")).groupBy("grp").agg(F.max_by("label", F.struct("sets", "label")).alias("top"))
    rest = label.join(top, "grp").filter("label != top").select("grp", "band", "node", "label", "n", "keys")
    chunks = rest.groupBy("grp", "band").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("chunks"))
    chunks = save(chunks, "chunks")
    # a block: a part of a band, and a chunk of the rest of the same or a neighbouring band
    name = lambda band, part, of, chunk: F.xxhash64(band, part, of, chunk)
    met = beside(chunks, [-1, 0, 1], F.col("band").alias("of"), "chunks").select("grp", "band", "of", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    wide = label.join(met, ["grp", "band"]).select("grp", name(F.col("band"), own, F.col("of"), F.col("chunk")).alias("block"), "node", "label", "keys")
    at = beside(slots, [-1, 0, 1], F.col("band").alias("to"), "parts").select("grp", "band", "to", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    chunk = F.pmod(F.xxhash64("node", F.lit(2)), F.col("chunks")).cast("int")
    narrow = rest.join(chunks, ["grp", "band"]).join(at, ["grp", "band"]).select("grp", name(F.col("to"), F.col("part"), F.col("band"), chunk).alias("block"), "node", "label", "keys")
    return components(save(edges.union(_in_blocks(wide.union(narrow), percent)), "links"))


def _in_blocks(rows: DataFrame, percent: int) -> DataFrame:
    return batched(rows.repartition("grp", "block").sortWithinPartitions("grp", "block"), _block_edges(percent), "a long, b long")


def classes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    component_id is the smallest doc_id among the rows whose texts are reachable by links, the row
    itself included. A null, empty or blank text has no shingles and keeps its own doc_id. Rows
    with a null doc_id link, but don't name a component unless all of its ids are null. Repeated
    rows are equal texts and get a row each. Other columns of docs are left aside.
    """
    docs = docs.select("doc_id", "text")
    sets = _read_sets(docs, k, percent)
    found = links(docs, sets, k, percent)
    named = sets.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("low")).join(found, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    low = named.groupBy("component").agg(F.min("low").alias("component_id"))
    of = named.join(low, "component").select("node", "component_id")
    some = sets.filter("n > 0").select("doc_id", F.col("n").alias("n_shingles"), "node").join(of, "node").select("doc_id", "n_shingles", "component_id")
    none = sets.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return some.union(none)


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs with all their columns, but of each group of linked texts only the row with
    the smallest doc_id. Rows that share that id stay together. Rows without an id can't be told
    apart by it: all of them stay if one of them stands for its group, having no text or linking
    with no row that has an id."""
    found = save(classes(docs, k, percent), "classes")
    own = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    gone = found.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_gone")).agg(F.max(own).alias("own")).filter("not own").select("_gone")
    gone = save(gone, "gone")
    # few ids go to every task; more than that meet the rows in a join by id
    gone = F.broadcast(gone) if gone.count() <= MAX_BROADCAST_IDS else gone
    alone = found.filter("doc_id is null and component_id is null").isEmpty()
    return (docs.filter(docs["doc_id"].isNotNull()) if alone else docs).join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by 3-word shingles at a similarity of 90 in 100 or more."""
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 90)
