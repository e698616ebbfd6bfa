"""Periodic runs of words: maximal pairs from the tree of common-prefix intervals of each text's suffixes.

A run of period q and length L that starts at word s is the pair of suffixes s and s + q: they share L - q words, differ
in the word that follows these and in the word before s. So runs are the maximal pairs whose distance is at most what
they share, and nothing is extended word by word. Texts are independent rows; the work of one is:

1. Windows of half the least length that stand more than once, after different words, name the intervals that can
   hold pairs at all; texts without such an interval are done.
2. Suffixes are ranked by doubling prefixes, whose ranks also give the words that neighbours in the order share.
3. The intervals are closed from the deepest up. Each keeps its places in text order with the class of their left
   word; the smaller child's places are looked up in the larger one's. A primitive pair no further apart than it is
   long has no third occurrence between its two, so only neighbours of different classes need a look.
"""

from __future__ import annotations

from bisect import bisect, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblode.llm._words import Text, Words, mixed, slices, windows

#: Words of the shortest run.
LEAST = 12


def _classes(key: np.ndarray) -> tuple[np.ndarray, int]:
    """The rank of each value among the distinct ones, and how many there are."""
    order = np.argsort(key, kind="stable")
    new = np.diff(key[order], prepend=key[order][:1]) != 0
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(new)
    return rank, int(new.sum()) + 1


class Suffixes:
    """Ranks of the suffixes of some texts, by doubling: level k tells prefixes of 2**k words apart.

    Every text ends with a terminal that equals nothing, so no prefix reaches over the end of a text unnoticed.
    """

    def __init__(self, symbol: np.ndarray, owner: np.ndarray, terminal: np.ndarray):
        n = len(symbol)
        word = _classes(symbol)[0] + 1
        word[terminal] = 0
        rank, distinct = _classes(owner.astype(np.int64) * (int(word.max(initial=0)) + 1) + word)
        self.levels, step = [rank], 1
        while distinct < n:
            after = np.zeros(n, np.int64)
            after[:-step] = rank[step:] + 1
            rank, distinct = _classes(rank * (n + 1) + after)
            self.levels.append(rank.astype(np.int32))
            step *= 2

    def ordered(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places by their suffixes, and the words that each has in common with the one before (the first: none)."""
        places = places[np.argsort(self.levels[-1][places])]
        common = np.zeros(len(places), np.int64)
        a, b, both = places[:-1], places[1:], common[1:]
        for k in range(len(self.levels) - 2, -1, -1):
            both += (self.levels[k][a + both] == self.levels[k][b + both]).astype(np.int64) << k
        return places, common


def maximal_pairs(places: list[int], common: list[int], left: dict[int, int], least: int) -> list[tuple[int, int, int]]:
    """start, period, length of the runs (perhaps also with multiples of a period) of one interval's places.

    places: in the order of their suffixes, with the words in common with the one before; left: class of the word
    before each.
    """
    out: list[tuple[int, int, int]] = []

    def joined(a: list[int], b: list[int], depth: int) -> list[int]:
        if len(a) < len(b):
            a, b = b, a
        for j in b:
            k = bisect(a, j)
            for i in a[max(k - 1, 0) : k + 1]:
                q = abs(i - j)
                if q <= depth and depth + q >= least and left[i] != left[j]:
                    out.append((min(i, j), q, depth + q))
        if len(b) < 16:
            for j in b:
                insort(a, j)
            return a
        return sorted(a + b)

    open_: list[tuple[int, list[int]]] = []  # intervals of rising depth, with the places that they have so far
    child = places[:1]
    for place, depth in zip([*places[1:], -1], [*common[1:], 0], strict=True):
        while open_ and open_[-1][0] > depth:
            length, mine = open_.pop()
            child = joined(mine, child, length)
        if open_ and open_[-1][0] == depth:
            open_[-1] = (depth, joined(open_[-1][1], child, depth))
        else:
            open_.append((depth, child))
        child = [place]
    return out


def _promising(words: Words, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Words whose window of half the least length also stands elsewhere in their text after another word, and the class
    of the word before each."""
    h, whole = windows(words, (least + 1) // 2)
    at = np.flatnonzero(whole)
    before = np.zeros(len(at), np.uint64)
    inner = at > words.first[words.row[at]]
    before[inner] = words.hash[at[inner] - 1]
    # no word's class is that of a text's first place
    before[inner & (before == 0)] = 1
    row = words.row[at]
    key = mixed(h[at] ^ mixed(row.astype(np.uint64), 31))
    order = np.argsort(key)
    new = np.ones(len(at), bool)
    new[1:] = np.diff(key[order]) != 0
    new[1:] |= row[order][1:] != row[order][:-1]
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    varied = np.zeros(len(first), bool)
    varied[group[before[order] != before[order][first[group]]]] = True
    chosen = order[varied[group]]
    return at[chosen], before[chosen]


def runs_of(words: Words, rows: int, least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """start, length, period of each row's runs, by start, then period."""
    found: list[dict[tuple[int, int], int]] = [{} for _ in range(rows)]
    place, before = _promising(words, least)
    if len(place):
        some = np.unique(words.row[place])
        # the texts that hold candidates, one after another, each with a terminal
        size = np.diff(words.first)[some]
        ends = np.cumsum(size + 1)
        base = ends - size - 1
        owner = np.repeat(np.arange(len(some)), size + 1)
        symbol = np.zeros(int(ends[-1]), np.uint64)
        terminal = np.zeros(len(symbol), bool)
        terminal[ends - 1] = True
        symbol[~terminal] = words.hash[np.isin(words.row, some)]
        shift = np.zeros(rows, np.int64)
        shift[some] = base - words.first[some]
        moved = place + shift[words.row[place]]
        order, common = Suffixes(symbol, owner, terminal).ordered(moved)
        left = before[np.argsort(moved)][np.searchsorted(np.sort(moved), order)]
        half = (least + 1) // 2
        edge = np.append(np.flatnonzero(common < half), len(order))
        # an interval whose nearest places lie further apart than any of its prefixes is long has no runs
        deepest = np.maximum.reduceat(common, edge[:-1])
        group = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
        by_place = np.lexsort((order, group))
        gap = np.full(len(order), len(symbol))
        gap[1:] = np.where(np.diff(group[by_place]) == 0, np.diff(order[by_place]), len(symbol))
        nearest = np.minimum.reduceat(gap, edge[:-1])
        for g in np.flatnonzero(nearest <= deepest).tolist():
            a, b = int(edge[g]), int(edge[g + 1])
            places, o = order[a:b].tolist(), int(owner[order[a]])
            shared = common[a:b].tolist()
            own = found[int(some[o])]
            for start, period, length in maximal_pairs(places, shared, dict(zip(places, left[a:b].tolist(), strict=True)), least):
                key = (start - int(base[o]), length)
                own[key] = min(period, own.get(key, period))
    return [sorted((s, n, p) for (s, n), p in own.items()) if own else [] for own in found]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return [w for w, n in zip(words, np.cumsum(step).tolist(), strict=False) if not n]


def _measured(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = runs_of(Words(Text(part.column(1))), part.num_rows, least)
                counts, texts = [], []
                for text, own in zip(part.column(1).to_pylist(), found, strict=True):
                    words = text.encode("utf-8", "surrogatepass").split()
                    counts.append(len(words))
                    texts.append(b" ".join(collapsed(words, own)))
                flat = np.array([r for own in found for r in own], np.int64).reshape(-1, 3)
                spans = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
                offsets = np.concatenate(([0], np.cumsum([len(own) for own in found]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), spans), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return run


def find_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period: longs, by start, then period), collapsed of each row.

    A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a length of at
    least ``least`` and 2 * q that no neighbouring word extends keeping q; words are numbered from 0. ``collapsed`` is
    the text's words joined by one space, without those that a run holds after its first q words. Words are what
    stands between characters of [\x20\x09-\x0D] and are compared by a 64-bit hash. Null and empty texts have no
    words, no runs and an empty ``collapsed``; repeated rows repeat; a null doc_id stays; other columns are ignored;
    an empty table gives an empty one. A text is one row of one task, which holds some hundred bytes for each of its words.
    """
    if least < 2:
        raise ValueError("a run has two words at least")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_measured(least), "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
