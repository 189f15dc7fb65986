"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

Half of all trusted documents by hash train the model, whole; the other half gives a threshold for
each language. N-grams are counted in shards of the word before the last, which every level's n-grams
and contexts share, and so are the continuation counts and the counts of counts that the discounts
come from.

The log probability of a text is a sum of one term for each of its n-grams: with weight g of a context
and x = (count - discount) / (sum of the context's discounts), P(w|ab) = g(ab) (x(abw) + P(w|b)), hence

    log P(w|ab) = log P(w) + [log g(b) + log(1 + x(bw) / P(w))] + [log g(ab) + log(1 + x(abw) / P(w|b))]

and what training has not seen adds nothing. So the model is one table from an n-gram's hash to a number,
as large as the trusted text and never in one place: texts send the distinct n-grams of a block of texts
to the shards of that table, and sums by text come back. This takes ROUNDS rounds, each for a range of the
hashes, so that the disk holds the n-grams of one round only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import tokens as T
from tessel.llm.scratch import batched, bit_filter, by_group, drop, free, may_hold, save

ORDER = 3
#: Rounds of scoring, and parts of the n-grams that terms are made of at once, of a model of more than SMALL
#: n-grams; smaller ones take one.
ROUNDS, PARTS, SMALL = 12, 4, 1 << 20
#: Terms are kept in these parts of a nat, so that their sums don't depend on an order.
UNITS = 2.0**32
#: N-grams of a block of texts in a round, about, for each order; texts of a block at most, but for one batch.
BLOCK_TOKENS, BLOCK_TEXTS = 1 << 19, 50_000
#: A text is rejected beyond its language's quantile of trusted texts by more than the margin, in nats a
#: token: the quantile alone would reject one clean text of a hundred by definition.
QUANTILE, MARGIN = 0.99, 0.4
#: Words of mean log probability that are added to each text, so that short texts aren't judged by few words.
PRIOR_WORDS = 20.0

#: Up to so many languages their thresholds are broadcast, a few hundred kB; and so many rejected texts' hashes.
MAX_BROADCAST_LANGUAGES = 10_000
MAX_BROADCAST_REJECTED = 100_000

_BEGIN, _END = np.uint64(0xB0), np.uint64(0xE0)


def _sequence(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's words after order-1 begins and before one end; the number of entries of each text."""
    t = T.words(data, offsets, lower=True)
    n = t.counts + order
    ends = np.cumsum(n)
    h, word = np.full(n.sum(), _BEGIN), np.ones(n.sum(), bool)
    for i in range(order - 1):
        word[ends - n + i] = False
    word[ends - 1] = False
    h[word] = t.hash
    h[ends - 1] = _END
    return h, n


def _windows(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """All runs of as many words, the last place's last; the text of the last, and whether it is a token to predict."""
    h, n = _sequence(data, offsets, order)
    token, ends = np.ones(len(h), bool), np.cumsum(n)
    for i in range(order - 1):
        token[ends - n + i] = False
    words = [h[order - 1 - i : len(h) - i] for i in range(order - 1, -1, -1)]
    return words, np.repeat(np.arange(len(n), dtype=np.uint32), n)[order - 1 :], token[order - 1 :]


def _ngrams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each token to predict, the words from order-1 before it to itself; its text."""
    words, owner, token = _windows(data, offsets, order)
    return [w[token] for w in words], owner[token]


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: for each its kind, size, length and packed length, then packed its first bytes, its
    second bytes and so on, as sorted numbers share their high bytes."""
    out, codec = [], pa.Codec("zstd", 1)
    for x in arrays:
        planes = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T)
        packed = codec.compress(planes, asbytes=True)
        out += [np.array([ord(x.dtype.kind), x.itemsize, len(x), len(packed)], np.int64).tobytes(), packed]
    return b"".join(out)


def _unpacked(data: pa.Scalar) -> list[np.ndarray]:
    raw, at, out, codec = np.frombuffer(data.as_buffer(), np.uint8), 0, [], pa.Codec("zstd")
    while at < len(raw):
        kind, size, n, packed = raw[at : at + 32].copy().view(np.int64).tolist()
        at += 32 + packed
        planes = np.frombuffer(codec.decompress(raw[at - packed : at], size * n), np.uint8).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(f"{chr(kind)}{size}"))
    return out


def _least(x: np.ndarray) -> np.ndarray:
    """Counts in as few bytes as hold them."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _edges(parts: int) -> np.ndarray:
    """The least hash of each of so many equal ranges of all hashes but the first."""
    return np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)


def _slices(sorted_hashes: np.ndarray, edges: np.ndarray) -> list[tuple[int, int, int]]:
    """The number, start and end of each range that some of the hashes are in."""
    at = [0, *np.searchsorted(sorted_hashes, edges).tolist(), len(sorted_hashes)]
    return [(s, i, j) for s, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)) if j > i]


def _keys(words: list[np.ndarray]) -> list[np.ndarray]:
    """Hashes of the last word, the last two words, and so on to all of them."""
    out = [T.combine(words[-1])]
    for w in words[-2::-1]:
        out.append(T.mix(out[-1] * np.uint64(0x2545F4914F6CDD1D) + w))
    return out


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
    return np.flatnonzero(new)


def _sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, at) if len(at) else x[:0]


def _merged(words: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct n-grams and their counts, sorted by the word before the last, the last, then from right to left."""
    order = np.arange(len(n))
    for w in [*words[:-2], words[-1], words[-2]]:
        order = order[T.order(w[order])[0]]
    words, n = [w[order] for w in words], n[order]
    at = _starts(*words)
    return [w[at] for w in words], _sums(n, at)


def _levels(words: list[np.ndarray], n: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each level of 2 words or more: where the runs of its n-grams begin among merged n-grams, and their
    counts. The highest level has counts, those below the number of words seen before them."""
    out, k = {len(words): (np.arange(len(n)), n)}, len(words)
    while k > 2:
        k -= 1
        at = _starts(*words[-k:])
        above = out[k + 1][0]
        out[k] = at, np.diff(np.append(np.searchsorted(above, at), len(above)))
    return out


@dataclass
class Model:
    """entries: tables of round, shard, and packed keys and terms of n-grams in that range of hashes; a key's terms add up."""

    order: int
    entries: list[DataFrame]
    rounds: int
    shards: int  # of a round
    floor: float  # natural log probability of a word that training has not seen
    mean: float  # mean natural log probability of a trusted token that training has not seen

    def drop(self) -> None:
        for x in self.entries:
            drop(x)


def _shards(spark: SparkSession, entries: int) -> int:
    return min(1 << 20, max(4, int(spark.conf.get("spark.sql.shuffle.partitions")) // 3, entries >> 21))


def _discounts(n: dict[int, int]) -> np.ndarray:
    """The modified discounts of counts of 1, 2 and 3 or more, from the counts of counts 1 to 4."""
    n1, n2, n3, n4 = (float(n.get(i, 0)) for i in range(1, 5))
    if not n1 or not n2:
        return np.array([0.5, 0.5, 0.5])  # too little text to tell
    y = n1 / (n1 + 2 * n2)
    return np.array([min(max(d, 0.05), i + 0.95) for i, d in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5))])


def _counted(rows: DataFrame, order: int, shards: int) -> DataFrame:
    """part, shard, data: the merged n-grams of all texts whose word before the last is in the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, data, offsets in T.chunks(batch.column(0)):
                held.append(_ngrams(data, offsets, order)[0])
                size += len(held[-1][0])
                if size >= BLOCK_TOKENS:
                    yield dealt(held)
                    held, size = [], 0
        if size:
            yield dealt(held)

    def dealt(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        words = [np.concatenate(w) for w in zip(*held, strict=True)]
        words, n = _merged(words, np.ones(len(words[0]), np.int64))
        # sorted by that word first
        out = {s: _packed(*(w[i:j] for w in words), _least(n[i:j])) for s, i, j in _slices(words[-2], _edges(shards))}
        return pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array(list(out.values()), pa.binary())], names=["shard", "data"])

    def merge(table: pa.Table) -> pa.Table:
        parts = [_unpacked(x) for x in table["data"]]
        words = [np.concatenate([p[i] for p in parts]) for i in range(order)]
        words, n = _merged(words, np.concatenate([p[-1].astype(np.int64) for p in parts]))
        shard = table["shard"][0].as_py()
        return pa.table({"part": pa.array([shard % PARTS], pa.int32()), "shard": pa.array([shard], pa.int32()), "data": pa.array([_packed(*words, _least(n))], pa.binary())})

    grams = batched(rows.select("text"), run, "shard int, data binary")
    return save(grams.groupBy("shard").applyInArrow(by_group(merge), "part int, shard int, data binary"), "counts", "part")


def _found(counts: DataFrame, order: int) -> DataFrame:
    """level, value, n: of level 1 each word's hash and the number of words seen before it, of those
    above each count up to 4 and how many n-grams have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                *words, n = _unpacked(data)
                levels = _levels(words, n)
                w, seen = np.unique(words[-1][levels[2][0]], return_counts=True)
                of = [(np.full(len(w), 1, np.int32), T.signed(w), seen)]
                for k, (_, c) in levels.items():
                    of.append((np.full(4, k, np.int32), np.arange(1, 5), np.bincount(c[c <= 4].astype(np.int64), minlength=5)[1:5]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*of, strict=True)], names=["level", "value", "n"])

    rows = batched(counts.select("data"), run, "level int, value long, n long")
    return save(rows.groupBy("level", "value").agg(F.sum("n").alias("n")), "levels")


def train(rows: DataFrame, order: int = ORDER) -> Model | None:
    """The model of all texts in rows, of 2 words an n-gram or more. None if there are none."""
    if order < 2:
        raise ValueError("order is 2 at least")
    spark = rows.sparkSession
    counts = _counted(rows, order, max(4, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found = _found(counts, order)
    of = {k: {} for k in range(1, order + 1)}
    for r in found.filter("level > 1").collect():  # 4 rows a level
        of[r["level"]][r["value"]] = r["n"]
    words = found.filter("level = 1").select(F.col("value").alias("w"), "n")
    of[1] = dict(words.filter("n <= 4").groupBy("n").count().collect())
    distinct, total = words.agg(F.count("*"), F.sum("n")).first()
    if not distinct:
        drop(counts)
        drop(found)
        return None
    d = {k: _discounts(n) for k, n in of.items()}
    off = words.agg(F.sum(F.when(F.col("n") == 1, float(d[1][0])).when(F.col("n") == 2, float(d[1][1])).otherwise(float(d[1][2])))).first()[0]
    floor = off / total / (distinct + 1)

    size = 2 * total  # bigrams and their contexts; of more words there are more
    rounds, shards = ROUNDS if size > SMALL else 1, _shards(spark, size)

    def first(n: np.ndarray) -> np.ndarray:
        """Probabilities of words by the number of words seen before them."""
        return (n - d[1][np.minimum(n, 3) - 1]) / total + floor

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, data in zip(batch.column(0), batch.column(1), strict=True):
                w = np.unique(_unpacked(data)[order - 1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), shard.as_py(), np.int32)), pa.array(T.signed(w))], names=["shard", "w"])

    def terms(table: pa.Table, seen: pa.Table) -> pa.Table:
        w, n = seen["w"].to_numpy().view(np.uint64), seen["n"].to_numpy()
        by = np.argsort(w)
        w, n = w[by], n[by]
        keys, values = [], []
        for data in table["data"]:
            *words, c = _unpacked(data)
            below = first(n[np.searchsorted(w, words[-1])])
            for k, (at, c) in sorted(_levels(words, c).items()):  # noqa: B020
                own, p, c = [x[at] for x in words[-k:]], below[at], c.astype(np.int64)
                less = d[k][np.minimum(c, 3) - 1]
                context, of = T.distinct(_keys(own[:-1])[-1])
                offs, sums = np.bincount(of, less), np.bincount(of, c)
                x = (c - less) / offs[of]
                keys += [_keys(own)[-1], context]
                values += [np.log1p(x / p), np.log(offs / sums)]
                below = np.repeat((offs / sums)[of] * (x + p), np.diff(np.append(at, len(words[0]))))
        return dealt(np.concatenate(keys), np.concatenate(values))

    def dealt(key: np.ndarray, value: np.ndarray) -> pa.Table:
        by, key = T.order(key)
        value = np.rint(value[by] * UNITS).astype(np.int64)
        out = {s: _packed(key[i:j], value[i:j]) for s, i, j in _slices(key, _edges(rounds * shards))}
        place = np.array(list(out), np.int32)
        return pa.table({"round": pa.array(place // shards), "shard": pa.array(place % shards), "data": pa.array(list(out.values()), pa.binary())})

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                key, n = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
                yield from dealt(_keys([key])[0], np.log(first(n) / floor)).to_batches()

    schema = "round int, shard int, data binary"
    entries = [save(batched(words, alone, schema), "terms", "round")]
    for some in [counts.filter(F.col("part") == i) for i in range(PARTS)] if size > SMALL else [counts]:
        some = some.select("shard", "data")
        joined = batched(some, asked, "shard int, w long").join(words, "w").select("shard", "w", "n")
        entries.append(save(some.groupBy("shard").cogroup(joined.groupBy("shard")).applyInArrow(by_group(terms), schema), "terms", "round"))
        if size > SMALL:
            drop(counts, f"part={len(entries) - 2}")
    drop(counts)
    drop(found)
    return Model(order, entries, rounds, shards, float(np.log(floor)), 0.0)


_SCORES = "n_words long, log_prob double"


def score(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """The given columns of docs, and of each whole text the number of words and the natural log
    probability of its words and end. docs is read once a round and must give the same rows in the same
    partitions again, as a table in files does: what comes from a shuffle is saved first, and of other
    rows that differ between rounds the query fails."""
    texts = docs.select(docs["text"].alias("_text"), *columns)
    order, rounds, shards, floor = model.order, model.rounds, model.shards, model.floor
    shuffled = rounds > 1 and "Exchange" in texts._jdf.queryExecution().executedPlan().toString()
    texts = save(texts, "texts") if shuffled else texts
    part = "block long, kind int, data binary"

    def asked(of_round: int) -> Callable:
        edges = [0, *_edges(rounds * shards).tolist(), 1 << 64][of_round * shards : (of_round + 1) * shards + 1]
        low, width = np.uint64(edges[0]), np.uint64(edges[-1] - edges[0] - 1)
        edges = np.array(edges[1:-1], np.uint64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, blocks = _Block(), 0
            for batch in batches:
                for a, b, data, offsets in T.chunks(batch.column(0)):
                    words, owner, token = _windows(data, offsets, order)
                    keys = _keys(words)
                    held.mark += int((keys[-1] * (2 * owner + 1)).sum()) + b - a
                    begin, each = [np.full(b - a, _BEGIN, np.uint64)] * (order - 1), np.arange(b - a, dtype=np.uint32)
                    for key, of, which in [*((x, owner, token) for x in keys), *((x, each, True) for x in _keys(begin))]:
                        at = np.flatnonzero((key - low <= width) & which)
                        held.keys.append(key[at])
                        held.texts.append(of[at] + np.uint32(held.size))
                    tokens = np.bincount(owner, token, b - a).astype(np.int64)
                    if not of_round:
                        held.rows.append(batch.slice(a, b - a).select(range(1, 1 + len(columns))))
                        held.words.append(tokens - 1)
                    held.size += b - a
                    held.tokens += int(tokens.sum())
                    if held.tokens >= BLOCK_TOKENS * rounds or held.size >= BLOCK_TEXTS:
                        yield dealt(held, blocks)
                        held, blocks = _Block(), blocks + 1
            if held.size:
                yield dealt(held, blocks)

        def dealt(held: _Block, number: int) -> pa.RecordBatch:
            key, text = np.concatenate(held.keys), np.concatenate(held.texts)
            by, key = T.order(key)
            text = text[by]
            first = _starts(key)
            key, text = key[first], _least(text)
            n = np.diff(np.append(first, len(text)))
            first = np.append(first, len(text))
            out = [(s, 1, _packed(key[i:j], _least(n[i:j]), text[first[i] : first[j]])) for s, i, j in _slices(key, edges)]
            block = T.combine(*(np.array([x % (1 << 64)], np.uint64) for x in (TaskContext.get().partitionId(), number, held.mark, held.size)))
            block = T.signed(block)[0]
            if held.rows:  # any shard will do to carry the rows' columns
                sink = pa.BufferOutputStream()
                got = pa.Table.from_batches(held.rows).combine_chunks().append_column("n_words", pa.array(np.concatenate(held.words)))
                with pa.ipc.new_stream(sink, got.schema) as to:
                    to.write_table(got)
                out.append((int(block) % shards, 2, sink.getvalue().to_pybytes()))
            shard, kind, data = zip(*out, strict=True) if out else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(np.full(len(shard), block)), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], names=["shard", "block", "kind", "data"])

        return run

    def answered(table: pa.Table) -> pa.Table:
        kind = table["kind"].to_numpy()
        parts = [_unpacked(table["data"][i]) for i in np.flatnonzero(kind == 0).tolist()]
        key, value = (np.concatenate([np.zeros(0, t), *(p[i] for p in parts)]) for i, t in enumerate((np.uint64, np.int64)))
        by, key = T.order(key)
        value = value[by] / UNITS
        at = _starts(key)
        key, value = np.append(key[at], ~np.uint64(0)), np.append(_sums(value, at), 0.0)
        of, data = [], []
        for i in np.flatnonzero(kind).tolist():
            if kind[i] == 1:
                asks, n, text = _unpacked(table["data"][i])
                place = np.searchsorted(key[:-1], asks)
                got = np.where(key[place] == asks, value[place], 0.0)
                data.append(_packed(np.bincount(text, np.repeat(got, n))))
            else:
                data.append(table["data"][i].as_py())
            of.append(i)
        return pa.table({"block": table["block"].take(pa.array(of, pa.int64())), "kind": pa.array(kind[of].astype(np.int32)), "data": pa.array(data, pa.binary())})

    def added(table: pa.Table) -> pa.Table:
        kind = table["kind"].to_numpy()
        parts = [_unpacked(table["data"][i])[0] for i in np.flatnonzero(kind == 1).tolist()]
        total = np.zeros(max(map(len, parts), default=0))
        for x in parts:
            total[: len(x)] += x
        rest = [table["data"][i].as_py() for i in np.flatnonzero(kind == 2).tolist()]
        return pa.table({"block": pa.array([table["block"][0].as_py()] * (1 + len(rest)), pa.int64()), "kind": pa.array([1] + [2] * len(rest), pa.int32()), "data": pa.array([_packed(total), *rest], pa.binary())})

    def finished(table: pa.Table) -> pa.Table:
        kind = table["kind"].to_numpy()
        head = np.flatnonzero(kind == 2).tolist()
        if len(head) != 1:
            raise RuntimeError("the texts' table gave other rows or partitions when it was read again")
        got = pa.ipc.open_stream(table["data"][head[0]].as_buffer()).read_all()
        n = got["n_words"].to_numpy()
        logs = (n + 1) * floor
        for i in np.flatnonzero(kind == 1).tolist():
            x = _unpacked(table["data"][i])[0]
            logs[: len(x)] += x
        return pa.table([*got.columns, pa.array(logs)], names=[*columns, "n_words", "log_prob"])

    sums = []
    for r in range(rounds):
        asks = batched(texts, asked(r), f"shard int, {part}")
        for x in model.entries:
            asks = asks.union(x.filter(F.col("round") == r).select("shard", F.lit(0).cast("long").alias("block"), F.lit(0).alias("kind"), "data"))
        answers = asks.groupBy("shard").applyInArrow(by_group(answered), part)
        sums.append(save(answers.groupBy("block").applyInArrow(by_group(added), part), f"sums-{r}"))
    every = sums[0]
    for x in sums[1:]:
        every = every.union(x)
    schema = ", ".join([*(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in columns), _SCORES])
    out = save(every.groupBy("block").applyInArrow(by_group(finished), schema), "scores")
    for x in [*sums, *([texts] if shuffled else [])]:
        drop(x)
    return out


class _Block:
    """What a task holds of a run of texts in a round."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = [np.zeros(0, np.uint64)]
        self.texts: list[np.ndarray] = [np.zeros(0, np.uint32)]
        self.rows: list[pa.RecordBatch] = []
        self.words: list[np.ndarray] = []
        self.size = self.tokens = self.mark = 0


def cross_entropy(n_words: Column, log_prob: Column, mean: float) -> Column:
    """Mean negative log probability of a token, PRIOR_WORDS average tokens included."""
    return (-log_prob - PRIOR_WORDS * mean) / (n_words + 1 + PRIOR_WORDS)


def _sampled(ids: DataFrame, max_docs: int) -> DataFrame:
    return ids.orderBy(F.xxhash64("_id", F.lit(9)), "_id").limit(max_docs)


def _fitting(sizes: list[tuple], max_chars: int) -> list:
    """Of (id, characters) in order those that still fit; the shortest if none does."""
    out, total = [], 0
    for i, n in sizes:
        if total + n <= max_chars:
            out.append(i)
            total += n
    return out or [i for i, _ in sorted(sizes, key=lambda x: x[1])[:1]]


@dataclass
class Classifier:
    model: Model
    docs: DataFrame  # those it was fitted on
    scored: DataFrame  # and of each row _id, lang, _one, _two, n_words, log_prob
    thresholds: DataFrame  # _lang, _limit: one row a language with trusted texts outside the model
    languages: int
    default: float  # of other languages

    def with_limit(self, rows: DataFrame, lang: Column) -> DataFrame:
        """rows and, after their columns, two more: the language, and its threshold or null."""
        names = [free(rows.columns, c) for c in ("_lang", "_limit")]
        t = self.thresholds.toDF(*names)
        # few languages go to every task; more than that meet the rows in a join that splits hot ones
        t = F.broadcast(t) if self.languages <= MAX_BROADCAST_LANGUAGES else t
        return rows.join(t, F.coalesce(lang, F.lit("")) == t[names[0]], "left")

    def scores(self, docs: DataFrame) -> DataFrame:
        """Scores of docs with their threshold _limit and entropy _h."""
        rows = self.scored if docs is self.docs else score(_named(docs), self.model, _OWN)
        return self.with_limit(rows, F.col("lang")).select(*rows.columns, F.coalesce("_limit", F.lit(self.default)).alias("_limit"), cross_entropy(F.col("n_words"), F.col("log_prob"), self.model.mean).alias("_h"))

    def drop(self) -> None:
        """Deletes the model's files. What it was fitted on can still be assessed, other tables can not."""
        self.model.drop()


_OWN = ["_id", "lang", "_one", "_two"]


def _hashes(text: Column, lang: Column) -> tuple[Column, Column]:
    """128 bits that stand for a text and its language, which are all that a verdict depends on."""
    text, lang = F.coalesce(text, F.lit("")), F.coalesce(lang, F.lit(""))
    return F.xxhash64(text, lang), F.xxhash64(F.lit(7), lang, text)


def _named(docs: DataFrame) -> DataFrame:
    one, two = _hashes(docs["text"], docs["lang"])
    return docs.select(docs["doc_id"].alias("_id"), docs["lang"].alias("lang"), one.alias("_one"), two.alias("_two"), docs["text"].alias("text"))


def _of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """_id and text of the rows whose _id is among ids. A filter of the ids leaves out most other
    rows before the join, so that few texts are moved; the join is exact."""
    kind = rows.schema["_id"].dataType
    bits = rows.sparkSession.sparkContext.broadcast(bit_filter(ids.select(F.xxhash64(F.col("_id").cast(kind)))))  # 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(may_hold(bits.value, batch.column(0).to_numpy().view(np.uint64))))
            yield batch.select(["_id", "text"])

    some = rows.filter(F.col("_id").isNotNull()).select(F.xxhash64("_id").alias("_hash"), "_id", "text")
    return batched(some, run, f"_id {kind.simpleString()}, text string").join(ids, "_id", "left_semi")


def fit(docs: DataFrame, labels: DataFrame, order: int = ORDER, max_docs: int | None = None, max_chars: int | None = None) -> Classifier | None:
    """Trusted documents are those labelled of quality and not toxic. The model is trained on half of
    them by hash, all and whole (on all, if that half has no text here); all others give the thresholds.
    None without trusted text.

    A caller who wants a smaller model may bound it, as no query here does, by max_docs documents and
    max_chars characters: in the order of a hash those that still fit, or the shortest alone if none does."""
    trusted = labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct()
    rows = _named(docs)
    model = None
    for half in (F.pmod(F.xxhash64("_id"), F.lit(2)) == 0, F.lit(True)):
        ids = trusted.filter(half)
        if max_docs is not None:
            ids = _sampled(ids, max_docs)
        chosen = _of(rows, ids)
        if max_chars is not None:
            sizes = chosen.groupBy("_id").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("n")).orderBy(F.xxhash64("_id", F.lit(9)), "_id").collect()
            ids = rows.sparkSession.createDataFrame([(i,) for i in _fitting([(r["_id"], r["n"]) for r in sizes], max_chars)], chosen.select("_id").schema)
            chosen = chosen.join(ids, "_id", "left_semi")
        if (model := train(chosen, order)) is not None or not chosen.isEmpty():
            break
    if model is None:
        return None
    scored = score(rows, model, _OWN)
    held = save(scored.filter("_id is not null").join(ids, "_id", "left_anti").join(trusted, "_id", "left_semi"), "trusted")
    n, logs = held.agg(F.sum(F.col("n_words") + 1), F.sum("log_prob")).first()
    model.mean = float(logs) / n if n else 0.0
    h = held.select(F.coalesce("lang", F.lit("")).alias("lang"), cross_entropy(F.col("n_words"), F.col("log_prob"), model.mean).alias("h"))
    cut = lambda d: d.agg((F.percentile_approx("h", QUANTILE, 10000) + MARGIN).alias("_limit"))
    thresholds = save(cut(h.groupBy(F.col("lang").alias("_lang"))), "thresholds")
    overall = cut(h).first()["_limit"]
    drop(held)
    return Classifier(model, docs, scored, thresholds, thresholds.count(), float("inf") if overall is None else float(overall))


def assess(docs: DataFrame, classifier: Classifier | None) -> DataFrame:
    """One row per row of docs: doc_id, lang, n_words, log_prob, perplexity, threshold, kept.

    A null or empty text is its end alone. A null language, or one without trusted texts, has the
    threshold of all languages together. Without trusted text nothing is scored and all is kept.
    Rows with null or repeated ids are rows of their own. Other columns are left aside.
    """
    if classifier is None:
        none = [F.lit(None).cast(t).alias(n) for n, t in (("n_words", "long"), ("log_prob", "double"), ("perplexity", "double"), ("threshold", "double"))]
        return docs.select("doc_id", "lang", *none, F.lit(True).alias("kept"))
    own = (F.exp("_h").alias("perplexity"), F.exp("_limit").alias("threshold"), (F.col("_h") <= F.col("_limit")).alias("kept"))
    return classifier.scores(docs).select(F.col("_id").alias("doc_id"), "lang", "n_words", "log_prob", *own)


def keep(docs: DataFrame, classifier: Classifier | None) -> DataFrame:
    """The rows of docs that assess() keeps, with all their columns, whatever their names. Those that
    go leave by a join of the hashes of their text and language, which are broadcast up to
    MAX_BROADCAST_REJECTED of them."""
    if classifier is None:
        return docs
    one, two = (free(docs.columns, c) for c in ("_one", "_two"))
    out = save(classifier.scores(docs).filter("not _h <= _limit").select("_one", "_two").distinct(), "rejected").toDF(one, two)
    out = F.broadcast(out) if out.count() <= MAX_BROADCAST_REJECTED else out
    a, b = _hashes(docs["text"], docs["lang"])
    return docs.join(out, (a == out[one]) & (b == out[two]), "left_anti")


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their perplexity, their language's threshold and the verdict."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    classifier = fit(docs, labels)
    out = assess(docs, classifier)
    if classifier is not None:
        classifier.drop()
    return out
