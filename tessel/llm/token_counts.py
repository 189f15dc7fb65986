"""Token counts: greedy longest-match pieces of words, counted by a linear automaton.

A trie of the vocabulary gets failure links and, for each node, the number of pieces that are
popped when its link is followed. A word, with its marker before it, then costs one step a byte and
no piece is built. Each distinct word of a run of texts is stepped through once.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessel.llm import tokens as T
from tessel.llm.scratch import batched

#: One piece a line, in base64, and its rank. A leading blank marks the start of a word.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MARKER = b" "
#: Distinct words whose counts a task remembers.
REMEMBER = 1 << 18


@dataclass
class Automaton:
    """child: node * 256 + byte to node; link: failure link, -1 where there is none; popped: pieces popped with it."""

    child: dict[int, int]
    link: list[int]
    popped: list[int]

    def count(self, word: bytes) -> int:
        """The number of longest-match pieces of a marked word, 0 if it can't be made of pieces."""
        child, link, popped = self.child, self.link, self.popped
        node = total = 0
        for byte in word:
            while (to := child.get(node * 256 + byte)) is None:
                if link[node] < 0:
                    return 0
                total += popped[node]
                node = link[node]
            node = to
        while node:
            if link[node] < 0:
                return 0
            total += popped[node]
            node = link[node]
        return total


def build(pieces: list[bytes]) -> Automaton:
    """The automaton of a vocabulary; pieces with a separator after their first byte can't occur and are left out."""
    child: dict[int, int] = {}
    above, byte_of, is_piece = [-1], [0], [False]
    for piece in pieces:
        if not piece or any(T.SEPARATOR[b] for b in piece[1:]):
            continue
        node = 0
        for b in piece:
            to = child.get(node * 256 + b)
            if to is None:
                to = child[node * 256 + b] = len(above)
                above.append(node)
                byte_of.append(b)
                is_piece.append(False)
            node = to
        is_piece[node] = True
    below: list[list[int]] = [[] for _ in above]
    for v in range(1, len(above)):
        below[above[v]].append(v)
    link, popped = [-1] * len(above), [0] * len(above)
    queue = deque(below[0])
    while queue:
        v = queue.popleft()
        queue.extend(below[v])
        if is_piece[v]:
            link[v], popped[v] = 0, 1
            continue
        total, z = popped[above[v]], link[above[v]]
        while z >= 0 and (to := child.get(z * 256 + byte_of[v])) is None:
            total += popped[z]
            z = link[z]
        if z >= 0:
            link[v], popped[v] = to, total
    return Automaton(child, link, popped)


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


def count_tokens(docs: DataFrame, automaton: Automaton) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_tokens, n_unknown.

    Words are runs of other than blanks and 0x09-0x0D. A word that the vocabulary can't make
    counts as one token and as unknown. A null or empty text has none. One pass, no shuffle; other
    columns of docs are left aside.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(automaton)  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, known = held.value.count, {}
        for batch in batches:
            for a, b, data, offsets in T.chunks(batch.column(1)):
                t = T.words(data, offsets)
                h, at, of = np.unique(t.hash, return_index=True, return_inverse=True)
                sizes = np.empty(len(h), np.int64)
                if len(known) > REMEMBER:
                    known = {}
                for i, (x, s, e) in enumerate(zip(h.tolist(), t.start[at].tolist(), t.end[at].tolist(), strict=True)):
                    n = known.get(x)
                    if n is None:
                        n = known[x] = count(MARKER + data[s:e].tobytes())
                    sizes[i] = n
                each = sizes[of]
                owner = t.owner()
                unknown = np.bincount(owner[each == 0], minlength=b - a)
                total = np.bincount(owner, each, b - a).astype(np.int64) + unknown
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(a, b - a), "n_words": t.counts, "n_tokens": total, "n_unknown": unknown})

    return batched(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_words long, n_tokens long, n_unknown long")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of word pieces of all documents."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), build(read_vocabulary()))
