"""Quality rules: a linear-chain CRF labels each line content or boilerplate.

Lines are the pieces between ``\\n``. Each gets binary features (share of symbols, capitals,
digits, repeated words, length, repetition within the text); Viterbi decoding of a two-label chain
finds the most likely label sequence of a text, and the share of its word characters that lie in
content lines decides whether the text stays. The weights maximise the conditional likelihood of
line labels on a bounded sample of labelled documents: lines take the quality label of their
document, blank lines none of their own.
"""

from __future__ import annotations

import hashlib
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tessel.llm import tokens as T
from tessel.llm.scratch import batched, place_of

#: Labelled documents, and characters of text in them, that the weights are fitted on at most.
MAX_TRAIN_DOCS, MAX_TRAIN_CHARS = 1500, 8_000_000
MIN_CONTENT_SHARE = 0.5
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"[#*$%&|<>]"[1:-1])] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:;")] = True

FEATURES = (
    "bias", "blank", "symbols_1pc", "symbols_5pc", "symbols_15pc", "capitals_30pc", "capitals_70pc",
    "digits_10pc", "digits_30pc", "words_1_2", "words_3_7", "words_20", "repeats_earlier",
    "repeated_words_half", "long_words", "ends_in_stop",
)


@dataclass
class Lines:
    """Per text: the base counts. Per line: features, word characters; bounds as in Tokens."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    features: np.ndarray
    chars: np.ndarray
    bounds: np.ndarray


def _cumulative(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x) + 1, np.int64)
    np.cumsum(x, out=out[1:])
    return out


def _line_sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = _cumulative(flags)
    return total[ends] - total[starts]


def _seen(owner: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item, whether an equal key of the same owner comes earlier, and whether any other does."""
    order = np.lexsort((np.arange(len(key)), key, owner))
    same = np.zeros(len(key), bool)
    same[1:] = (key[order][1:] == key[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    earlier, twice = np.zeros(len(key), bool), np.zeros(len(key), bool)
    earlier[order] = same
    any_ = same.copy()
    any_[:-1] |= same[1:]
    twice[order] = any_
    return earlier, twice


def _line_hashes(t: T.Tokens, data: np.ndarray, first: np.ndarray, last: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of every byte of each line: its words with their places in the line, and its separators."""
    place = np.repeat(start, last - first)
    each = T.combine(t.hash, (t.start - place).astype(np.uint64), (t.end - place).astype(np.uint64))
    total = np.zeros(len(each) + 1, np.uint64)
    np.cumsum(each, out=total[1:])
    gaps = np.flatnonzero(T.SEPARATOR[data] & (data != 0x20) & (data != 0x0A))  # tabs and the like; blanks follow from the places
    line = np.searchsorted(start, gaps, "right") - 1
    odd = np.zeros(len(start), np.uint64)
    np.add.at(odd, line, T.combine((gaps - start[line]).astype(np.uint64), data[gaps].astype(np.uint64)))
    return T.combine(total[last] - total[first], (end - start).astype(np.uint64), odd)


def analyse(data: np.ndarray, offsets: np.ndarray) -> Lines:
    """Counts and line features of a run of texts."""
    t = T.words(data, offsets)
    n_docs, owner = len(offsets) - 1, t.owner()
    inside = ~T.SEPARATOR[data]
    chars = inside & ((data & 0xC0) != 0x80)

    key, at = T.windows(t, WINDOW)
    _, twice = _seen(owner[at], key)
    cover = np.zeros(len(t.hash) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + WINDOW, -1)
    repeated = np.cumsum(cover)[:-1] > 0

    breaks = np.flatnonzero(data == 0x0A)
    start = np.sort(np.concatenate((offsets[:-1], breaks + 1)), kind="stable")
    bounds = np.searchsorted(breaks, offsets) + np.arange(n_docs + 1)  # a text has one line more than breaks
    end = np.empty(len(start), np.int64)
    end[:-1] = start[1:] - 1
    end[bounds[1:] - 1] = offsets[1:]
    of = np.repeat(np.arange(n_docs), np.diff(bounds))

    first, last = np.searchsorted(t.start, start), np.searchsorted(t.start, end)
    n = last - first
    has = np.flatnonzero(n > 0)
    earlier = np.zeros(len(start), bool)
    earlier[has] = _seen(of[has], _line_hashes(t, data, first, last, start, end)[has])[0]

    line_chars = _line_sums(chars, start, end)
    most = np.maximum(line_chars, 1)
    symbols, capitals, letters, digits = (_line_sums(x[data], start, end) for x in (_SYMBOL, _UPPER, _LETTER, _DIGIT))
    again = _cumulative(repeated)
    stop = np.zeros(len(start), bool)
    stop[has] = _STOP[data[t.end[last[has] - 1] - 1]]
    f = np.stack(
        [
            np.ones(len(start), bool), n == 0, symbols > 0.01 * most, symbols > 0.05 * most, symbols > 0.15 * most,
            (capitals > 0.3 * letters) & (letters > 3), (capitals > 0.7 * letters) & (letters > 3), digits > 0.1 * most, digits > 0.3 * most,
            (n > 0) & (n < 3), (n >= 3) & (n < 8), n >= 20, earlier, again[last] - again[first] > 0.5 * n, line_chars > 12 * np.maximum(n, 1), stop,
        ],
        axis=1,
    )
    per = lambda flags: _line_sums(flags, offsets[:-1], offsets[1:])
    dup = _cumulative(earlier)
    return Lines(
        t.counts, per(chars), per(_SYMBOL[data]), dup[bounds[1:]] - dup[bounds[:-1]],
        again[t.bounds[1:]] - again[t.bounds[:-1]], f, line_chars, bounds,
    )


@dataclass
class Crf:
    """weights: score of label content minus boilerplate by feature; moves[a, b]: from label a to b."""

    weights: np.ndarray
    moves: np.ndarray

    def viterbi(self, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """True for the lines labelled content. All texts of a run step together, longest first."""
        score = features @ self.weights
        n = np.diff(bounds)
        order = np.argsort(-n, kind="stable")
        longest = int(n.max(initial=0))
        active = np.searchsorted(-n[order], -np.arange(longest), "left")
        best = np.zeros((len(n), 2))
        back = np.zeros((len(score), 2), bool)
        for i in range(longest):
            rows = order[: active[i]]
            at = bounds[rows] + i
            if i:
                from0, from1 = best[rows, :1] + self.moves[0], best[rows, 1:] + self.moves[1]
                back[at] = from1 > from0
                best[rows] = np.maximum(from0, from1)
            best[rows, 1] += score[at]
        label = np.zeros(len(score), bool)
        now = best[:, 1] >= best[:, 0]
        for i in range(longest - 1, -1, -1):
            rows = order[: active[i]]
            at = bounds[rows] + i
            label[at] = now[rows]
            now[rows] = back[at, now[rows].astype(int)]
        return label


def fit(features: np.ndarray, bounds: np.ndarray, labels: np.ndarray, steps: int = 120, rate: float = 0.15, l2: float = 1e-3) -> Crf:
    """Maximum conditional likelihood by gradient ascent; gradients from forward-backward sums."""
    x, y = features.astype(float), labels.astype(int)
    n = np.diff(bounds)
    order = np.argsort(-n, kind="stable")
    longest = int(n.max(initial=0))
    active = np.searchsorted(-n[order], -np.arange(longest), "left")
    theta = np.zeros(x.shape[1] + 4)
    follows = np.ones(len(x), bool)
    follows[bounds[:-1][n > 0]] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][follows[1:]], y[1:][follows[1:]]), 1)
    m1 = m2 = np.zeros_like(theta)
    for step in range(1, steps + 1):
        moves = theta[-4:].reshape(2, 2)
        emit = np.zeros((len(x), 2))
        emit[:, 1] = x @ theta[:-4]
        a, b = np.zeros_like(emit), np.zeros_like(emit)
        for i in range(longest):
            at = bounds[order[: active[i]]] + i
            a[at] = emit[at] + (np.logaddexp(a[at - 1, :1] + moves[0], a[at - 1, 1:] + moves[1]) if i else 0)
        for i in range(longest - 2, -1, -1):
            at = bounds[order[: active[i + 1]]] + i
            to = emit[at + 1] + b[at + 1]
            b[at] = np.logaddexp(moves[:, 0] + to[:, :1], moves[:, 1] + to[:, 1:])
        both = a + b
        z = np.logaddexp(both[:, 0], both[:, 1])
        p1 = np.exp(both[:, 1] - z)
        j = np.flatnonzero(follows)
        pair = np.exp(a[j - 1][:, :, None] + moves[None] + (emit[j] + b[j])[:, None, :] - z[j][:, None, None]).sum(0)
        gradient = np.concatenate((x.T @ (y - p1), (seen - pair).ravel())) / max(len(x), 1) - l2 * theta
        m1, m2 = 0.9 * m1 + 0.1 * gradient, 0.999 * m2 + 0.001 * gradient**2
        theta = theta + rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return Crf(theta[:-4], theta[-4:].reshape(2, 2))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS, max_chars: int = MAX_TRAIN_CHARS) -> Crf | None:
    """Weights from at most max_docs labelled documents of at most max_chars characters together,
    half of either label and of the characters for each: in the order of a hash of doc_id those that
    still fit, or the shortest alone if none does. None, with a warning, if a label is missing."""
    ids = None
    for q in (0, 1):
        of = labels.filter((F.col("quality") == q) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id")).distinct()
        of = of.orderBy(F.xxhash64("_id"), "_id").limit(max_docs // 2).withColumn("_quality", F.lit(q))
        ids = of if ids is None else ids.union(of)
    # max_docs rows bound the broadcast sides and what is collected first; max_chars bounds what is collected then
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    sizes = rows.join(F.broadcast(ids), "_id").groupBy("_id", "_quality").agg(F.sum(F.coalesce(F.length("_text"), F.lit(0))).alias("n")).collect()
    kept = []
    for q in (0, 1):
        of, fitting, total = [r for r in sizes if r["_quality"] == q], [], 0
        for r in sorted(of, key=lambda r: hashlib.md5(str(r["_id"]).encode()).digest()):
            if total + r["n"] <= max_chars // 2:
                fitting.append(r)
                total += r["n"]
        kept += [(r["_id"], q) for r in fitting or sorted(of, key=lambda r: (r["n"], str(r["_id"])))[:1]]
    if len({q for _, q in kept}) < 2:
        warnings.warn("no document of one of the labels: no line labeller, every line counts as content", stacklevel=2)
        return None
    chosen = docs.sparkSession.createDataFrame(kept, StructType([rows.schema["_id"], StructField("_quality", IntegerType())]))
    found = rows.join(F.broadcast(chosen), "_id").withColumn("_hash", F.xxhash64("_id", "_text"))
    out = batched(found.select("_text", "_quality", "_hash"), _features_of, "quality int, hash long, bounds int, features binary").toArrow().to_pylist()
    out.sort(key=lambda r: (r["hash"], r["quality"], r["features"]))
    x = np.concatenate([np.unpackbits(np.frombuffer(r["features"], np.uint8), count=r["bounds"] * len(FEATURES)).reshape(-1, len(FEATURES)) for r in out])
    n = [r["bounds"] for r in out]
    return fit(x, np.concatenate(([0], np.cumsum(n))), np.repeat([r["quality"] for r in out], n))


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        quality, hashes = batch.column(1).to_pylist(), batch.column(2)
        for a, _, data, offsets in T.chunks(batch.column(0)):
            x = analyse(data, offsets)
            rows = [x.features[x.bounds[i] : x.bounds[i + 1]] for i in range(len(offsets) - 1)]
            yield pa.RecordBatch.from_pydict(
                {
                    "quality": pa.array(quality[a : a + len(rows)], pa.int32()), "hash": hashes.slice(a, len(rows)), "bounds": pa.array([len(r) for r in rows], pa.int32()),
                    "features": pa.array([np.packbits(r).tobytes() for r in rows], pa.binary()),
                }
            )


def judge(x: Lines, crf: Crf | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base_failed, the share of word characters in content lines, kept."""
    failed = (x.n_words < MIN_WORDS) | (100 * x.n_repeat_words > MAX_REPEAT_PERCENT * x.n_words)
    label = crf.viterbi(x.features, x.bounds) if crf else np.ones(len(x.chars), bool)
    content = _cumulative(x.chars * label)
    share = (content[x.bounds[1:]] - content[x.bounds[:-1]]) / np.maximum(x.word_chars, 1)
    return failed, share, ~failed & (share >= MIN_CONTENT_SHARE)


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"


def assess(docs: DataFrame, crf: Crf | None) -> DataFrame:
    """One row per row of docs: doc_id, the counts, base_failed, content_share, kept.

    A null or empty text has no words, so its base rule fails; without a model every line counts
    as content. Repeated rows get a row each. Other columns of docs, whatever their names, are
    left aside. The work is a single pass without a shuffle.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in T.chunks(batch.column(1)):
                x = analyse(data, offsets)
                failed, share, kept = judge(x, crf)
                ids = batch.column(0).slice(a, b - a)
                cols = [ids, *map(pa.array, (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, failed, share, kept))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *(c.split()[0] for c in COLUMNS.split(", "))])

    return batched(docs.select("doc_id", "text"), run, f"doc_id {kind}, {COLUMNS}")


def keep(docs: DataFrame, crf: Crf | None) -> DataFrame:
    """The rows of docs whose text is kept, with all their columns, whatever their names and types;
    the rest go. A null, empty or blank text goes. Rows with null or repeated ids are rows of their
    own. One pass, no shuffle."""
    at = place_of(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [judge(analyse(data, offsets), crf)[2] for _, _, data, offsets in T.chunks(batch.column(at))]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return batched(docs, run, docs.schema)


def op7_crf_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the base counts and the verdict."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return assess(docs, train(docs, labels))
