"""SentencePiece encoding and decoding: Viterbi segmentation that shares the work on common prefixes.

Blanks become markers that start words, one more blank before the text; a line feed is a word of
its own. The distinct marked words of a run of texts are sorted, which lays them out as a trie in
depth-first order, and forward states up to the prefix shared with the word before are kept. What
no piece covers becomes byte pieces, so decoding gives back every text exactly.

The public model is of the merging kind: its scores are ranks of merges, and their sums along a
path say nothing. The forward score of a path is therefore 0 while the model's merges leave each
two neighbouring pieces of it apart, and minus infinity otherwise. A sequence of pieces is the
model's own encoding just when this holds for all neighbours, so one path into each prefix
survives, and the segmentation is that of the model's own encoder.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessel.llm import tokens as T
from tessel.llm.scratch import batched, free, place_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Distinct words whose pieces a worker remembers, and pairs of pieces whose merging it remembers.
REMEMBER, REMEMBER_PAIRS = 1 << 17, 1 << 19
#: Bytes of text, and ids, that are worked on at once.
TEXT_RUN, ID_RUN = 1 << 19, 1 << 18

_START, _UNKNOWN = -1, -2  # before the first piece; a character that no piece has


@dataclass
class Vocabulary:
    """trie: by byte, the node below and its piece, -1 for none; rank: score by text of a piece;
    byte_id by byte; text and size by id."""

    trie: dict[int, tuple[dict, int]]
    rank: dict[bytes, float]
    byte_id: list[int]
    flat: np.ndarray = field(repr=False)
    first: np.ndarray = field(repr=False)
    size: np.ndarray = field(repr=False)
    steps: dict = field(default_factory=dict, repr=False)  # by id, as found
    _encoder: Encoder | None = field(default=None, repr=False)

    def encoder(self) -> Encoder:
        """One encoder in each process, so that what a task remembers serves the next ones."""
        if self._encoder is None:
            self._encoder = Encoder(self)
        return self._encoder

    def text(self, i: int) -> bytes:
        return self.flat[self.first[i] : self.first[i] + self.size[i]].tobytes()

    def _merging(self, i: int) -> tuple[list[bytes], list[bytes], list[float]] | None:
        """The steps in which the characters of a piece merge, the best neighbours first and of equal
        ones the leftmost: its first and last symbol before each step and the step's score, which is
        minus infinity at the end. None for a piece that merging doesn't make."""
        if i in self.steps:
            return self.steps[i]
        whole = self.text(i)
        at, rank = [x.encode() for x in whole.decode()], self.rank
        left, right, scores = [], [], []
        while True:
            best, place = float("-inf"), -1
            for k in range(len(at) - 1):
                x = rank.get(at[k] + at[k + 1])
                if x is not None and x > best:
                    best, place = x, k
            left.append(at[0])
            right.append(at[-1])
            scores.append(best)
            if place < 0:
                break
            at[place : place + 2] = [at[place] + at[place + 1]]
        self.steps[i] = (left, right, scores) if at == [whole] else None
        return self.steps[i]

    def apart(self, a: int, b: int) -> bool:
        """Whether merging leaves the pieces a and b as they are, side by side: both merge step by step
        in the order of their scores, and no symbols across their border come first. a may be _START
        or _UNKNOWN."""
        after = self._merging(b)
        if a < 0 or after is None:
            return after is not None
        _, right, ours = self._merging(a)
        left, _, theirs = after
        i, j, rank = 0, 0, self.rank
        while True:
            x, y = ours[i], theirs[j]
            across = rank.get(right[i] + left[j])
            if across is not None and across > x and across >= y:
                return False
            if x >= y:
                if i == len(ours) - 1:
                    return True  # so is the other at its end
                i += 1
            else:
                j += 1


def vocabulary(pieces: list[tuple[str, float]], byte_ids: list[int]) -> Vocabulary:
    """pieces: by id, with markers for blanks and scores, "" for an id that stands for no text or for
    a byte. A piece with a blank after another character, or a line feed, can't be: words are cut there."""
    trie: dict = {}
    rank: dict[bytes, float] = {}
    texts = [text.replace(MARK, " ").encode() for text, _ in pieces]
    for i, raw in enumerate(texts):
        if b" " in raw.lstrip(b" ") or b"\n" in raw:
            raise ValueError(f"piece {i} has a blank within it or a line feed")
        if not raw or raw in rank:
            continue
        node, rank[raw] = trie, pieces[i][1]
        for b in raw[:-1]:
            node = node.setdefault(b, ({}, -1))[0]
        node[raw[-1]] = (node[raw[-1]][0] if raw[-1] in node else {}, i)
    for b, i in enumerate(byte_ids):
        texts[i] = bytes([b])
    size = np.array([len(t) for t in texts])
    return Vocabulary(trie, rank, byte_ids, np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, size)


def read_model(path: str = MODEL) -> Vocabulary:
    """The pieces of a model file that has byte pieces and merges."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.vocab_size()
    byte_ids = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    special = {*byte_ids, *(i for i in range(n) if m.is_control(i) or m.is_unknown(i))}
    return vocabulary([("" if i in special else m.id_to_piece(i), m.get_score(i)) for i in range(n)], byte_ids)


def segment(words: list[bytes], v: Vocabulary, pairs: dict[int, bool] | None = None) -> list[list[int]]:
    """The ids of each of the sorted words. pairs: what is known of pairs of pieces, added to."""
    trie, byte_id, apart = v.trie, v.byte_id, v.apart
    pairs = {} if pairs is None else pairs
    # by depth: the last piece of the prefix, where it starts, bytes missing to a whole character, and
    # pieces under way, as trie node and start, longest first; of use up to the prefix shared
    room = 1 + max(map(len, words), default=0)
    via, back, missing = [_START] * room, [0] * room, [0] * room
    active: list[list[tuple[dict, int]]] = [[]] * room
    out, last = [], b""
    for word in words:
        depth, most = 0, min(len(word), len(last))
        while depth < most and word[depth] == last[depth]:
            depth += 1
        for d in range(depth, len(word)):
            byte, going, ends = word[d], [], []
            for node, s in active[d]:
                if (to := node.get(byte)) is not None:
                    if to[0]:
                        going.append((to[0], s))
                    if to[1] >= 0:
                        ends.append((to[1], s))
            if missing[d]:
                more = missing[d] - 1
            else:
                more = 0 if byte < 0xC0 else 1 if byte < 0xE0 else 2 if byte < 0xF0 else 3
                if (to := trie.get(byte)) is not None:
                    if to[0]:
                        going.append((to[0], d))
                    if to[1] >= 0:
                        ends.append((to[1], d))
            by, start = _UNKNOWN, d
            if not more:
                for i, s in ends:
                    key = via[s] << 32 | i
                    ok = pairs.get(key)
                    if ok is None:
                        ok = pairs[key] = apart(via[s], i)
                    if ok:
                        by, start = i, s
                        break
                else:
                    while missing[start]:
                        start -= 1
            at = d + 1
            via[at], back[at], missing[at], active[at] = by, start, more, going
        ids, at = [], len(word)
        while at:
            start = back[at]
            if via[at] >= 0:
                ids.append(via[at])
            else:
                ids.extend(byte_id[b] for b in reversed(word[start:at]))
            at = start
        ids.reverse()
        out.append(ids)
        last = word
    return out


class Encoder:
    """Encodes runs of texts, remembering the ids of words, as bytes."""

    def __init__(self, v: Vocabulary) -> None:
        self.v, self.known, self.before, self.pairs = v, {}, {}, {}

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the bounds of each text's."""
        if len(self.known) > REMEMBER:
            # words of the generation before last are forgotten
            self.known, self.before = {}, self.known
        if len(self.pairs) > REMEMBER_PAIRS:
            self.pairs = {}
        some = np.flatnonzero(np.diff(offsets) > 0)
        data = np.insert(data, offsets[some], 0x20)  # the marker before a text
        added = np.zeros(len(offsets), np.int64)
        added[some + 1] = 1
        offsets = offsets + np.cumsum(added)
        # a word starts where a run of blanks does, and at a line feed and after it
        opens = (data == 0x20) | (data == 0x0A)
        opens[1:] &= (data[1:] == 0x0A) | (data[:-1] != 0x20)
        opens[1:] |= data[:-1] == 0x0A
        opens[offsets[:-1][np.diff(offsets) > 0]] = True
        start = np.flatnonzero(opens)
        end = np.append(start[1:], len(data))[: len(start)]
        hashes = T.span_hashes(data, start, end)
        h, at, of = np.unique(hashes, return_index=True, return_inverse=True)
        keys, known, before = h.tolist(), self.known, self.before
        each = [known.get(x) or before.get(x) for x in keys]
        missed = [i for i, ids in enumerate(each) if ids is None]
        new = sorted((data[start[at[i]] : end[at[i]]].tobytes(), i) for i in missed)
        for (_, i), ids in zip(new, segment([w for w, _ in new], self.v, self.pairs), strict=True):
            each[i] = array("i", ids).tobytes()
        known.update(zip(keys, each, strict=True))
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        flat = np.frombuffer(b"".join(each), np.int32)
        ids = T.ragged(flat, (np.cumsum(size) - size)[of], size[of])
        ends = np.concatenate(([0], np.cumsum(size[of])))
        return ids, ends[np.searchsorted(start, offsets)]


def decode(ids: np.ndarray, bounds: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts of runs of ids."""
    size = v.size[ids]
    data = T.ragged(v.flat, v.first[ids], size)
    offsets = np.concatenate(([0], np.cumsum(size)))[bounds]
    some = np.flatnonzero(np.diff(offsets) > 0)
    data = np.delete(data, offsets[some])
    gone = np.zeros(len(offsets), np.int64)
    gone[some + 1] = 1
    return data, offsets - np.cumsum(gone)


def _texts(ids: np.ndarray, bounds: np.ndarray, v: Vocabulary) -> pa.Array:
    data, offsets = decode(ids, bounds, v)
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def encode(docs: DataFrame, v: Vocabulary, read_back: bool = False) -> DataFrame:
    """One row per row of docs: doc_id and ids, the pieces of its whole text; none for a null or
    empty one. read_back: and text, decoded from ids in the same pass. Rows with null or repeated ids
    are rows of their own. One pass, no shuffle; other columns of docs are left aside."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(v)  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held.value.encoder()
        for batch in batches:
            for a, b, data, offsets in T.chunks(batch.column(1), TEXT_RUN):
                ids, bounds = encoder.encode(data, offsets)
                out = {"doc_id": batch.column(0).slice(a, b - a), "ids": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))}
                yield pa.RecordBatch.from_pydict(out | ({"text": _texts(ids, bounds, held.value)} if read_back else {}))

    return batched(docs.select("doc_id", "text"), run, f"doc_id {kind}, ids array<int>" + ", text string" * read_back)


def with_text(encoded: DataFrame, v: Vocabulary) -> DataFrame:
    """encoded with a column text, or text with underscores if there is one, decoded from ids, and no
    other change. Null or no ids are an empty text, which null texts come back as."""
    held = encoded.sparkSession.sparkContext.broadcast(v)
    names = encoded.columns
    added, at = free(names, "text"), place_of(encoded, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(at).fill_null(pa.scalar([], pa.list_(pa.int32())))
            bounds = ids.offsets.to_numpy()
            values, a = ids.values.to_numpy(), 0
            while a < len(batch):
                b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + ID_RUN, "right")) - 1)
                text = _texts(values[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], held.value)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), text], names=[*names, added])
                a = b

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return batched(encoded, run, f"{schema}, `{added}` string")


def op10_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: ids, their number, and the digest of the text decoded from them."""
    from pyspark.sql import functions as F

    v = read_model()
    out = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), v, read_back=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("text", 256).alias("decoded_sha256"), "ids")
