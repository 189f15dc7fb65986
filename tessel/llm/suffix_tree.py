"""LM scoring: a probabilistic suffix tree over words.

The root distribution is the smoothed unigram model of all training tokens. States are contexts of
one word and more. Two kinds make up the tree:

* Frequent contexts, of up to MAX_DEPTH words, make up at least ``min_context`` of the training
  tokens each, so there are at most 1/min_context of a length. They stay when the next-word
  distribution diverges from that of the longest retained suffix by ``divergence`` nats a token,
  and keep the successors that make up at least ``min_entry`` of the tokens. This part has a fixed
  largest size and is broadcast.
* All other contexts, one and two words longer than the longest frequent one, become candidates
  when they occur MIN_COUNT times, so their number grows with the text. They stay when they
  raise the likelihood of their own training tokens, each left out in turn, by ``gain`` nats over
  the parent state. Their distributions are Witten-Bell smoothed into the parent's. This part is
  never gathered: the tokens meet in parts of the contexts' hashes, packed in blocks, and each
  part learns its states and scores its tokens.

Every distribution sums to one. Scoring uses the longest retained suffix state at each token. All
counts are over all training rows. A rare context holds less than min_context of all tokens, so no
part is hot; the broadcast words are at most 1/MIN_WORD.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import tokens as T
from tessel.llm.jaccard_join import grouped
from tessel.llm.scratch import batched, save

ALPHA = 0.1
#: Least share of the training tokens of a frequent word, a frequent context, a successor in one.
MIN_WORD, MIN_CONTEXT, MIN_ENTRY = 2.0**-20, 2.0**-14, 2.0**-20
DIVERGENCE = 0.01
#: Words of a frequent context at most; two more are looked at behind it.
MAX_DEPTH = 3
#: Least number of training tokens after a rare context, and nats that it gains on all of them.
MIN_COUNT, GAIN = 2, 1.0
#: Tokens that a task packs at once; tokens of a part, about.
FLUSH, PART_TOKENS = 1 << 20, 1 << 20

_END, _BEGIN = np.uint64(0xE1D0F7E87), np.uint64(0xBE61A5E3)  # stand for the end and the begin of a text
_WIDTH = 1 << 21  # more than the frequent words, the end and the begin
_KEY_BITS = 46  # of the hash of a rare context


def split(doc_id: Column) -> Column:
    """Whether a row is held out: crc32 of doc_id as text (null: empty) divisible by 10."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


class _Finding:
    """Keeps the tables that find places in its arrays, in each process for itself."""

    def places(self, name: str) -> T.Places:
        if name not in (tables := self.__dict__.setdefault("_tables", {})):
            tables[name] = T.Places(getattr(self, name))
        return tables[name]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_tables"}


@dataclass
class Level(_Finding):
    """States of one depth: keys of their contexts; sorted successor entries; mass passed to the parent."""

    context: np.ndarray  # sorted keys
    entry: np.ndarray  # sorted: state * _WIDTH + word
    share: np.ndarray
    rest: np.ndarray  # by state
    kept: np.ndarray  # by state: retained, or only a candidate


@dataclass
class Tree(_Finding):
    words: np.ndarray  # sorted hashes of frequent words
    counts: np.ndarray
    total: int
    distinct: int
    levels: list[Level] = field(default_factory=list)
    deepest: int = MAX_DEPTH  # contexts that are longer may be frequent all the same

    def root(self, count: np.ndarray) -> np.ndarray:
        return (count + ALPHA) / (self.total + ALPHA * (self.distinct + 1))

    def rare(self) -> float:
        """The mean root probability of the words that are not frequent, unseen ones as one of them."""
        mass = 1.0 - self.root(self.counts).sum()
        return max(mass / max(1, self.distinct - len(self.words) + 1), float(self.root(np.float64(0.0))))

    def codes(self) -> np.ndarray:
        """The number of each level's first state, counted from 1 over all levels; 0 is the root."""
        return 1 + np.cumsum([0, *(len(x.context) for x in self.levels)])


def _sequence(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's end included; the number of each text's tokens; the place of each in its text."""
    t = T.words(data, offsets, lower=True)
    n = t.counts + 1
    h = np.insert(t.hash, t.bounds[1:], _END)
    first = np.cumsum(n) - n
    return h, n, np.arange(len(h)) - np.repeat(first, n)


def _states(tree: Tree, idx: np.ndarray, place: np.ndarray, depth: int) -> list[np.ndarray]:
    """For each depth, the state of the words before each token, -1 where there is none. Words of index -1 are in no context."""
    before = lambda k: np.where(place >= k, np.concatenate((np.full(k, -1), idx[:-k]))[: len(idx)], np.where(place == k - 1, _WIDTH - 1, -1))
    out, key = [], None
    for k in range(1, depth + 1):
        word = before(k)
        # a longer context's key is the state of the shorter one and one word more
        key = word if k == 1 else np.where((out[-1] >= 0) & (word >= 0), out[-1] * _WIDTH + word, -1)
        out.append(tree.levels[k - 1].places("context").find(key))
    return out


def _counted(keys: list[np.ndarray]) -> pa.RecordBatch:
    k, c = np.unique(np.concatenate(keys), return_counts=True)
    return pa.RecordBatch.from_pydict({"k": pa.array(k.astype(np.int64)), "c": pa.array(c)})


def _gather(rows: DataFrame, keys_of) -> DataFrame:
    """Counts of what keys_of returns for runs of texts, summed over all rows: k, c."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for _, _, data, offsets in T.chunks(batch.column(0)):
                held.append(keys_of(data, offsets))
                n += len(held[-1])
                if n >= FLUSH:
                    yield _counted(held)
                    held, n = [], 0
        if held:
            yield _counted(held)

    return batched(rows.select("text"), run, "k long, c long").groupBy("k").agg(F.sum("c").alias("c"))


def _arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = df.select("k", "c").toArrow()
    return got["k"].to_numpy(), got["c"].to_numpy()


def word_counts(rows: DataFrame) -> DataFrame:
    """k: hash of a token, c: its count in rows; written to the shared folder."""
    return save(_gather(rows, lambda data, offsets: T.signed(_sequence(data, offsets)[0])), "word-counts")


def grow(rows: DataFrame, counts: DataFrame, max_depth: int = MAX_DEPTH, min_context: float = MIN_CONTEXT, min_entry: float = MIN_ENTRY, divergence: float = DIVERGENCE) -> Tree:
    """The tree learnt from all rows. Only what its bounds limit comes to the driver."""
    spark = rows.sparkSession
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    k, c = _arrays(counts.filter(F.col("c") >= max(1.0, MIN_WORD * total)))
    h = k.view(np.uint64)
    order = np.argsort(h)
    tree = Tree(h[order], c[order], int(total), int(distinct), deepest=max_depth)
    if not total:
        return tree
    n_texts = int(tree.counts[tree.places("words").find(np.array([_END]))[0]]) if len(tree.words) and _END in tree.words else 0
    size = np.append(tree.counts, n_texts)  # by candidate of the level before
    label = np.append(np.arange(len(tree.words)), _WIDTH - 1)
    for depth in range(1, max_depth + 1):
        big = size >= max(2.0, min_context * total)
        if depth == 1:
            big[:-1] &= tree.words != _END
        context, size = label[big], size[big]
        if not len(context):
            break
        order = np.argsort(context)
        context, size = context[order], size[order]
        blank = np.zeros(0)
        tree.levels.append(Level(context, blank, blank, blank, blank))
        held = spark.sparkContext.broadcast(tree)

        def keys_of(data: np.ndarray, offsets: np.ndarray, held=held, depth=depth) -> np.ndarray:
            tree = held.value
            h, _, place = _sequence(data, offsets)
            idx = tree.places("words").find(h)
            state = _states(tree, idx, place, depth)[-1]
            at = (state >= 0) & (idx >= 0)
            return state[at] * _WIDTH + idx[at]

        entry, c = _arrays(_gather(rows, keys_of).filter(F.col("c") >= max(1.0, min_entry * total)))
        order = np.argsort(entry)
        entry, c = entry[order], c[order]
        state, word = entry // _WIDTH, entry % _WIDTH
        share = c / (size[state] + 1.0)
        rest = 1.0 - np.bincount(state, share, len(context))
        parent_state = context // _WIDTH if depth > 1 else None
        below = probability(tree, depth - 1, parent_state[state] if depth > 1 else None, word)
        gain = np.bincount(state, share * np.log(share / below + rest[state]), len(context)) + rest * np.log(np.maximum(rest, 1e-300))
        tree.levels[-1] = Level(context, entry, share, rest, gain >= divergence)
        if depth < max_depth:
            size, label = _longer(tree, entry, c)
        held.unpersist()
    return tree


def _longer(tree: Tree, entry: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and keys of contexts one word longer than the last level's: an entry's context and its
    word after that, as the state of all but the oldest word, and the oldest."""
    depth, state, newest = len(tree.levels), entry // _WIDTH, entry % _WIDTH
    older = []  # words of the context, oldest first
    for level in reversed(tree.levels):
        older.append(level.context[state] % _WIDTH)
        state = level.context[state] // _WIDTH
    found = tree.levels[0].places("context").find(newest)
    for k in range(1, depth):
        key = np.where(found >= 0, found * _WIDTH + older[depth - k], -1)
        found = tree.levels[k].places("context").find(key)
    ok = found >= 0
    return c[ok], (found * _WIDTH + older[0])[ok]


def probability(tree: Tree, depth: int, state: np.ndarray | None, word: np.ndarray) -> np.ndarray:
    """P(frequent word | state of that depth), through the longest retained suffix."""
    if depth == 0:
        return tree.root(tree.counts[word])
    level = tree.levels[depth - 1]
    up = level.context[state] // _WIDTH if depth > 1 else None
    below = probability(tree, depth - 1, up, word)
    at = level.places("entry").find(state * _WIDTH + word)
    own = np.where(at >= 0, level.share[at] if len(level.share) else 0.0, 0.0)
    return np.where(level.kept[state], own + level.rest[state] * below, below)


def factor(tree: Tree, depth: int, state: np.ndarray) -> np.ndarray:
    """What a word that no state on the way knows has of its root probability."""
    out = np.ones(len(state))
    for level in reversed(tree.levels[:depth]):
        out *= np.where(level.kept[state], level.rest[state], 1.0)
        state = level.context[state] // _WIDTH
    return out


def _frequent(tree: Tree, idx: np.ndarray, code: np.ndarray) -> np.ndarray:
    """By the numbers of the longest frequent contexts: the probability of the word, or for a rare
    one (index -1) the factor on its root probability."""
    out, first = np.empty(len(idx)), tree.codes()
    depth = np.searchsorted(first, code, "right")
    for d in range(len(tree.levels) + 1):
        for rare in (False, True):
            at = np.flatnonzero((depth == d) & ((idx < 0) == rare))
            state = code[at] - first[d - 1] if d else np.zeros(len(at), np.int64)
            out[at] = factor(tree, d, state) if rare else probability(tree, d, state, idx[at])
    return out


def _before(x: np.ndarray, place: np.ndarray, k: np.ndarray, begin: int, none: int) -> np.ndarray:
    """What stands k tokens before each token of its text; begin just before the text, none beyond."""
    at = np.maximum(np.arange(len(x)) - k, 0)
    return np.where(place >= k, x[at], np.where(place == k - 1, begin, none).astype(x.dtype))


# packing


def pack(*columns: np.ndarray) -> bytes:
    """Columns of unsigned integers, each as planes of its bytes, which are compressed."""
    codec, out = pa.Codec("zstd", compression_level=1), []
    for x in columns:
        width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
        planes = np.ascontiguousarray(np.ascontiguousarray(x, np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T)
        bodies = [codec.compress(p.tobytes(), asbytes=True) for p in planes]
        out += [np.array([len(x), width, *map(len, bodies)], np.int64).tobytes(), *bodies]
    return b"".join(out)


def unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    codec, out, at = pa.Codec("zstd"), [], 0
    for _ in range(columns):
        n, width = np.frombuffer(blob, np.int64, 2, at).tolist()
        sizes = np.frombuffer(blob, np.int64, width, at + 16).tolist()
        at += 16 + 8 * width
        x = np.zeros((n, 8), np.uint8)
        for i, size in enumerate(sizes):
            x[:, i] = np.frombuffer(codec.decompress(blob[at : at + size], n), np.uint8) if n else 0
            at += size
        out.append(x.reshape(-1).view(np.uint64))
    return out


@dataclass
class Block:
    """Tokens by rare context: hash of its shortest; twice the number of the frequent one within it,
    and 1 if it is none (the text's begin or the greatest depth has come first); the word behind it, 0 for
    none; index of the word + 1, 0 for a rare one, whose hash follows in rare; row, twice, + held out."""

    key: np.ndarray
    code: np.ndarray
    deep: np.ndarray
    word: np.ndarray
    rare: np.ndarray
    row: np.ndarray

    def packed(self, parts: int) -> Iterator[tuple[int, bytes]]:
        """The tokens of each part of the keys' range."""
        order, key = T.order(self.key)
        code, deep, word, row = (x[order] for x in (self.code, self.deep, self.word, self.row))
        hashes = np.zeros(len(key), np.uint64)
        hashes[self.word == 0] = self.rare
        hashes = hashes[order]
        part = ((key >> np.uint64(_KEY_BITS - 24)) * np.uint64(parts)) >> np.uint64(24)
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
            if a < b:
                first = np.append(0, np.flatnonzero(np.diff(key[a:b])) + 1)
                own = key[a:b][first]
                blob = pack(np.diff(own, prepend=np.uint64(0)), np.diff(np.append(first, b - a)) - 1, code[a:b][first], deep[a:b], word[a:b], hashes[a:b][word[a:b] == 0], row[a:b])
                yield int(part[a]), blob

    @staticmethod
    def unpacked(blob: bytes) -> Block:
        gaps, runs, code, deep, word, rare, row = unpack(blob, 7)
        runs = runs.astype(np.int64) + 1
        return Block(np.repeat(np.cumsum(gaps, dtype=np.uint64), runs), np.repeat(code, runs), deep, word, rare, row)


def _block(tree: Tree, h: np.ndarray, idx: np.ndarray, place: np.ndarray, code: np.ndarray, depth: np.ndarray, row: np.ndarray) -> Block:
    """The tokens that have a rare context, and rare words that have none."""
    begin = int(_BEGIN)
    nearest = _before(h, place, depth + 1, begin, 0)
    has = (place >= depth) & (depth < tree.deepest)
    at = np.flatnonzero(has | (idx < 0))
    has, code = has[at], code[at].astype(np.uint64)
    key = np.where(has, T.combine(code, nearest[at]), T.mix(h[at])) >> np.uint64(64 - _KEY_BITS)
    two = depth + 2
    index, far = _before(idx, place, two, _WIDTH - 2, -2)[at], _before(h, place, two, begin, 0)[at]
    deep = np.where(index >= 0, index + 1, np.where(index == -2, 0, _WIDTH + (far >> np.uint64(42)).astype(np.int64)))
    deep[~has] = 0
    word = idx[at] + 1
    return Block(key, code * np.uint64(2) + ~has, deep.astype(np.uint64), word.astype(np.uint64), h[at][word == 0], row[at])


# learning and scoring the rare contexts of a part


def _groups(*keys: np.ndarray) -> np.ndarray:
    """For each row the number of its group of equal keys."""
    return T.distinct(T.combine(*keys) if len(keys) > 1 else keys[0])[1]


def _learn(group: np.ndarray, word: np.ndarray, train: np.ndarray, below: np.ndarray, min_count: int, gain: float) -> tuple[np.ndarray, np.ndarray]:
    """States of groups of tokens: for each token what its state adds to the probability of its word,
    and the factor on the parent's. below: the parent's probability of the word."""
    entry = _groups(group.astype(np.uint64), word)
    count = np.bincount(entry, train)
    some = np.zeros(len(count), np.int64)
    some[entry] = np.arange(len(group))  # a token of each entry
    of, q = group[some], below[some]
    n = np.bincount(group, train)
    seen, single = np.bincount(of, count > 0, len(n)), count == 1
    z = np.maximum(n + seen, 1)
    # the gain of each entry's tokens, one of them left out
    types = seen[of] - single
    left = np.maximum(n[of] - 1 + types, 1)
    ratio = (count - 1 + types * q) / (left * q)
    gains = np.bincount(of, np.where((count > 0) & (n[of] > 1), count * np.log(np.where(ratio > 0, ratio, 1e-300)), 0.0), len(n))
    kept = (n >= min_count) & (gains >= gain)
    add = np.where(kept[of], count / z[of], 0.0)[entry]
    return add, np.where(kept, seen / z, 1.0)[group]


def score_part(tree: Tree, b: Block, uid: np.ndarray, min_count: int = MIN_COUNT, gain: float = GAIN) -> tuple[np.ndarray, ...]:
    """What a part's states change: rows and the log10 factors on their scores; rows, rare words and
    what their states add, as a share of the factor that their root probabilities have."""
    idx, state = b.word.astype(np.int64) - 1, (b.code >> np.uint64(1)).astype(np.int64)
    word, train = b.word.copy(), (b.row & np.uint64(1)) == 0
    rare = idx < 0
    word[rare] = b.rare | np.uint64(1 << 63)
    hot = _frequent(tree, idx, state)
    q = np.where(rare, hot * tree.rare(), hot)
    real = (b.code & np.uint64(1)) == 0
    group = _groups(np.where(real, b.key, b.key | np.uint64(1 << 63)))
    add, rest = _learn(group, word, train & real, q, min_count, gain)
    add[~real], rest[~real] = 0.0, 1.0
    known = np.bincount(group, train)[group] >= min_count
    deep = np.flatnonzero(real & known & (b.deep > 0))
    if len(deep):
        more = _groups(group[deep].astype(np.uint64), b.deep[deep])
        add2, rest2 = _learn(more, word[deep], train[deep], add[deep] + rest[deep] * q[deep], min_count, gain)
        add[deep] = add2 + rest2 * add[deep]
        rest[deep] *= rest2
    # a rare word's root probability is not known here: add + rest * hot * root
    change = np.where(rare, np.log10(rest), np.log10((add + rest * q) / q))
    rows, at = T.distinct(uid.view(np.uint64))
    return rows.view(np.int64), np.bincount(at, change), uid[rare], b.rare, (add / (rest * hot))[rare]


_ROWS = "part int, uid long, blob binary, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double"
_OUT = "uid long, k long, x double, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double"


def _table(names: list[str], types: list[pa.DataType], columns: dict) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(names, types, strict=True)], names=names)


def score(rows: DataFrame, tree: Tree, counts: DataFrame, min_count: int = MIN_COUNT, gain: float = GAIN) -> DataFrame:
    """One row per row of rows (doc_id, text, held_out): the counts and scores of its whole text by
    the tree and by the rare contexts of the rows that are not held out.

    A null or empty text is its end alone; a text of any length is one row's. A row is known by its
    task and place, so repeated or null ids keep rows of their own; rows must come in the same order
    if they are read again, as from files. Frequent words are scored by the tree where the text is;
    rare words meet the corpus counts in a shuffle join.
    """
    spark = rows.sparkSession
    kind = rows.schema["doc_id"].dataType.simpleString()
    held = spark.sparkContext.broadcast(tree)
    n_tokens = tree.total or 1
    parts = max(1, -(-n_tokens // PART_TOKENS), 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    names, types = [c.split()[0] for c in _ROWS.split(", ")], [pa.int32(), pa.int64(), pa.binary(), None, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = held.value
        uid = TaskContext.get().partitionId() << 40
        first, root = tree.codes(), np.log10(tree.root(tree.counts)) if tree.total else np.zeros(0)
        blocks: list[Block] = []
        base = uid

        def flush() -> pa.RecordBatch | None:
            whole = Block(*(np.concatenate([getattr(b, f) for b in blocks]) for f in Block.__dataclass_fields__))
            got = list(whole.packed(parts))
            return _table(names, types, {"part": [p for p, _ in got], "uid": [base] * len(got), "blob": [x for _, x in got]}) if got else None

        for batch in batches:
            types[3] = batch.column(0).type
            for a, b, data, offsets in T.chunks(batch.column(1)):
                h, n, place = _sequence(data, offsets)
                idx = tree.places("words").find(h)
                states = _states(tree, idx, place, len(tree.levels)) if tree.total else []
                depth, code = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
                for d, state in enumerate(states):
                    depth += state >= 0
                    code = np.where(state >= 0, first[d] + state, code)
                owner, known = np.repeat(np.arange(b - a), n), idx >= 0
                sent = np.where(known, root[np.maximum(idx, 0)], 0.0) if len(root) else np.zeros(len(h))
                sums = [np.bincount(owner, x, b - a) for x in (known, sent, np.log10(_frequent(tree, idx, code)))]
                out = batch.column(2).slice(a, b - a)
                row = (uid - base + owner) * 2 + out.to_numpy(zero_copy_only=False).astype(np.int64)[owner]
                blocks.append(_block(tree, h, idx, place, code, depth, row.astype(np.uint64)))
                ids = uid + np.arange(b - a)
                yield _table(names, types, {
                    "part": ids % parts, "uid": ids, "doc_id": batch.column(0).slice(a, b - a), "held_out": out,
                    "n_tokens": n, "n_known": sums[0].astype(np.int64), "base": sums[1], "score": sums[2],
                })
                uid += b - a
                if sum(len(x.key) for x in blocks) >= FLUSH:
                    if (got := flush()) is not None:
                        yield got
                    blocks, base = [], uid
        if blocks and (got := flush()) is not None:
            yield got

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = held.value
        outs = [c.split()[0] for c in _OUT.split(", ")]
        for table, starts in grouped(batches, 1):
            kinds = [pa.int64(), pa.int64(), pa.float64(), *(f.type for f in list(table.schema)[3:])]
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                some = table.slice(s, e - s)
                texts = pc.is_null(some["blob"])
                for x in some.filter(texts).to_batches():
                    yield _table(outs, kinds, {c: x[c] for c in ("uid", *outs[3:])})
                some, blocks, uid = some.filter(pc.invert(texts)), [], []
                if not some.num_rows:
                    continue
                for base, blob in zip(some["uid"].to_pylist(), some["blob"].to_pylist(), strict=True):
                    blocks.append(Block.unpacked(blob))
                    uid.append(base + (blocks[-1].row >> np.uint64(1)).astype(np.int64))
                whole = Block(*(np.concatenate([getattr(b, f) for b in blocks]) for f in Block.__dataclass_fields__))
                del blocks
                ids, change, rare_of, word, ratio = score_part(tree, whole, np.concatenate(uid), min_count, gain)
                yield _table(outs, kinds, {"uid": ids, "x": change})
                yield _table(outs, kinds, {"uid": rare_of, "k": T.signed(word), "x": ratio})

    sent = batched(rows.select("doc_id", "text", "held_out"), send, _ROWS.format(kind=kind))
    # each part is a partition of its own
    got = save(batched(sent.repartitionById(parts, "part"), learn, _OUT.format(kind=kind)), "token-scores")
    z = tree.total + ALPHA * (tree.distinct + 1)
    root = (F.coalesce("c", F.lit(0)) + ALPHA) / z
    rare = got.filter("k is not null").select("uid", "k", "x").join(counts, "k", "left").groupBy("uid").agg(
        F.sum(F.log10(root)).alias("base"), F.sum(F.log10(root + F.col("x"))).alias("score"), F.count("c").alias("n_known")
    )
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("doc_id", "held_out")]
    each = got.filter("k is null").select("uid", "doc_id", "held_out", "n_tokens", "n_known", "base", F.coalesce("score", "x").alias("score"))
    each = each.union(rare.select("uid", *none, F.lit(None).cast("long").alias("n_tokens"), "n_known", "base", "score"))
    sums = each.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
        F.lit(tree.total).cast("long").alias("train_tokens"), F.sum("base").alias("base_score"), F.sum("score").alias("score"),
    )
    return sums.drop("uid")


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by the tree that the rows not held out have given.

    With no training rows every token has the same probability, 1 by the formula's V = N = 0.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").withColumn("held_out", split(F.col("doc_id")))
    train = docs.filter(~F.col("held_out"))
    counts = word_counts(train)
    return score(docs, grow(train, counts), counts)
