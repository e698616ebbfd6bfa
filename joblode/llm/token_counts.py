"""Token counts by a linear longest-match automaton.

The vocabulary is a trie with two roots, one for pieces that begin a word and one for pieces that continue it.
Each node has a failure link and the number of pieces that following it pops, so the greedy longest-match length
of a word takes one pass over its bytes and no piece is ever built.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose counts a worker remembers before it forgets all of them.
REMEMBERED = 500_000


class Automaton:
    """initial, following: the pieces (bytes) that may begin and may continue a word."""

    ROOT, NEXT = 0, 1

    def __init__(self, initial: Iterable[bytes], following: Iterable[bytes]):
        self.step: dict[int, int] = {}
        final = [False, False]
        children: list[list[tuple[int, int]]] = [[], []]
        for root, pieces in ((self.ROOT, initial), (self.NEXT, following)):
            for piece in pieces:
                at = root
                for c in piece:
                    to = self.step.get(at << 8 | c)
                    if to is None:
                        to = self.step[at << 8 | c] = len(final)
                        children[at].append((c, to))
                        final.append(False)
                        children.append([])
                    at = to
                final[at] = at > self.NEXT
        self.fail, self.pops = [-1] * len(final), [0] * len(final)
        todo = deque([self.ROOT, self.NEXT])
        while todo:
            u = todo.popleft()
            for c, v in children[u]:
                if final[v]:
                    self.fail[v], self.pops[v] = self.NEXT, 1
                else:
                    z, popped = self.fail[u], self.pops[u]
                    while z >= 0 and (z << 8 | c) not in self.step:
                        popped += self.pops[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.pops[v] = self.step[z << 8 | c], popped
                todo.append(v)

    def count(self, word: bytes) -> int:
        """Number of greedy pieces of a word; -1 if it can't be covered."""
        step, fail, pops = self.step, self.fail, self.pops
        at, n = self.ROOT, 0
        for c in word:
            while (to := step.get(at << 8 | c)) is None:
                if fail[at] < 0:
                    return -1
                n += pops[at]
                at = fail[at]
            at = to
        while at != self.NEXT:
            if fail[at] < 0:
                return -1 if word else 0
            n += pops[at]
            at = fail[at]
        return n


def byte_level_pieces(path: str) -> tuple[list[bytes], list[bytes]]:
    """Pieces of a byte-level vocabulary file: those with a leading space begin words, the others continue them."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"] for t in model["added_tokens"]}
    pieces = [bytes(byte[c] for c in t) for t in model["model"]["vocab"] if t not in special]
    return [p for p in pieces if p[:1] == b" "], [p for p in pieces if p[:1] != b" "]


def _counts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton: Automaton = shared.value
        known: dict[bytes, int] = {}
        for batch in batches:
            out: list[list[int]] = [[], [], [], []]
            for text in batch.column(1).to_pylist():
                words = (text or "").encode("utf-8", "surrogatepass").split()
                for w in set(words).difference(known):
                    known[w] = automaton.count(b" " + w)
                got = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                for c, v in zip(out, (len(words), int(np.abs(got).sum()), int((got < 0).sum()), int(np.abs(got).max(initial=0))), strict=True):
                    c.append(v)
                if len(known) > REMEMBERED:
                    known.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in out)], ["doc_id", "n_words", "n_tokens", "n_unknown", "longest_word"])

    return run


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown, longest_word (in pieces) of each row of docs.

    Words are runs of other than ASCII white space; each begins with a space piece. A word that the vocabulary
    can't cover counts as one unknown token. Null and empty texts have none; repeated rows repeat; a null doc_id
    is kept; an empty table gives an empty one. The automaton (its size is the vocabulary's) is built once on the
    driver and broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(*byte_level_pieces(vocabulary)))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_counts(shared), "doc_id long, n_words long, n_tokens long, n_unknown long, longest_word long")
