"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Only windows that hold a shingle of an item can be similar to it, so those are the ones fingerprinted. A pair
within the Hamming radius agrees on one of eight blocks up to an eighth of the radius; an index of each block's
neighbours therefore finds every such pair. Candidates are verified by weighted Jaccard similarity of their word
shingles (weights are multiplicities).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblode.llm._store import free_name, stored
from joblode.llm._words import Text, Words, cover, mixed, rolling, runs, slices
from joblode.llm.substring import keyed

SHINGLE = 5
SIMILAR = 0.8
#: At similarity 0.8 the expected distance is about 10 bits with a deviation of 3; 24 is five deviations away.
RADIUS = 24
BLOCKS, WIDTH = 8, 8
#: Bytes of items that one pass over the documents broadcasts; more items take more passes. The index of this much
#: text takes about seven times as much memory (a test measures it).
PASS_BYTES = 16 << 20
#: Letters, digits and all bytes beyond ASCII make words.
_GAP = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: What to flip in a block to reach all values up to an eighth of the radius away.
_FLIPS = np.array([sum(1 << b for b in bits) for d in range(RADIUS // BLOCKS + 1) for bits in combinations(range(WIDTH), d)])


def simhash(sums: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of 64 signed sums."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64)[:, 0]


def signs(shingles: np.ndarray) -> np.ndarray:
    """One row of 64 signs for each shingle hash."""
    bits = np.unpackbits(np.ascontiguousarray(shingles).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two bags of shingle hashes."""
    both, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = (np.bincount(w, minlength=len(both)) for w in (where[: len(a)], where[len(a) :]))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum()) if len(both) else 0.0


class Blocks:
    """Multi-index of fingerprints: find() returns all (query, fingerprint) pairs within the radius.

    Each block holds the fingerprints in the order of its eight bits; a query looks up all values near its own.
    """

    def __init__(self, fps: np.ndarray):
        self.fps = fps
        part = [(fps >> np.uint64(b * WIDTH) & np.uint64(255)).astype(np.int64) for b in range(BLOCKS)]
        self.order = np.stack([np.argsort(x, kind="stable").astype(np.int32) for x in part])
        self.at = np.stack([np.concatenate(([0], np.cumsum(np.bincount(x, minlength=1 << WIDTH)))) for x in part]).astype(np.int32)

    def find(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pairs = []
        for b in range(BLOCKS):
            value = (query >> np.uint64(b * WIDTH) & np.uint64(255)).astype(np.int64)[:, None] ^ _FLIPS
            begin = self.at[b][value]
            size = (self.at[b][value + 1] - begin).ravel()
            row, begin = np.flatnonzero(size), begin.ravel()
            size = size[row]
            place = np.repeat(begin[row], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            pairs.append(np.repeat(row // len(_FLIPS), size) * len(self.fps) + self.order[b][place])
        pairs = np.unique(np.concatenate(pairs))
        q, f = pairs // len(self.fps), pairs % len(self.fps)
        near = np.bitwise_count(query[q] ^ self.fps[f]) <= RADIUS
        return q[near], f[near]


def lowered(column: pa.Array) -> Words:
    return Words(Text(pc.utf8_lower(column.fill_null("").cast(pa.string()))), _GAP)


class Items:
    """Shingle bags of a block of benchmark items, grouped by size, with an index of their fingerprints.

    All of it is flat arrays: the bags one after another, and for each shingle length the sorted shingles with the
    sizes of the items that hold them.
    """

    def __init__(self, ids: list, texts: list[str | None]):
        words = lowered(pa.array([t or "" for t in texts], pa.string()))
        self.ids, size = ids, np.diff(words.first)
        bags = []
        for i in range(len(ids)):
            h = words.hash[words.first[i] : words.first[i + 1]]
            bags.append(mixed(rolling(h, min(SHINGLE, len(h))), 21) if len(h) else np.zeros(0, np.uint64))
        self.at = np.concatenate(([0], np.cumsum([len(x) for x in bags], dtype=np.int64)))
        self.bags = np.concatenate(bags) if bags else np.zeros(0, np.uint64)
        self.groups: dict[int, tuple[np.ndarray, Blocks]] = {}
        for n in np.unique(size[size > 0]).tolist():
            own = np.flatnonzero(size == n)
            self.groups[n] = own, Blocks(simhash(np.stack([signs(bags[i]).sum(0) for i in own])))
        self.index: dict[int, tuple[np.ndarray, ...]] = {}
        count = np.diff(self.at)
        for k in np.unique(np.minimum(size[size > 0], SHINGLE)).tolist():
            mine = np.minimum(size, SHINGLE) == k
            shingle, n = self.bags[np.repeat(mine, count)], np.repeat(size[mine], count[mine])
            order = np.lexsort((n, shingle))
            shingle, n = shingle[order], n[order]
            new = np.ones(len(n), bool)
            new[1:] = (shingle[1:] != shingle[:-1]) | (n[1:] != n[:-1])
            keys, first = np.unique(shingle[new], return_index=True)
            some = np.zeros(1 << 20, bool)
            some[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.index[k] = keys, np.append(first, new.sum()), n[new].astype(np.int32), some

    def nbytes(self) -> int:
        arrays = [self.bags, self.at, *(a for x in self.index.values() for a in x)]
        return sum(a.nbytes for a in arrays) + sum(own.nbytes + b.fps.nbytes + b.order.nbytes + b.at.nbytes for own, b in self.groups.values())

    def search(self, hashes: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, int, float, int]]:
        """(row, item, similarity, first word in the slice) of each item-sized window similar to an item."""
        for k, (keys, at, sizes, some) in self.index.items():
            if len(hashes) < k:
                continue
            s = mixed(rolling(hashes, k), 21)
            likely = np.flatnonzero(some[(s & np.uint64((1 << 20) - 1)).astype(np.int64)] & (row[: len(s)] == row[k - 1 :]))
            found = np.minimum(np.searchsorted(keys, s[likely]), len(keys) - 1)
            hit = keys[found] == s[likely]
            places, found = likely[hit], found[hit]
            many = at[found + 1] - at[found]
            n = sizes[np.repeat(at[found], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
            places = np.repeat(places, many)
            order = np.argsort(n, kind="stable")
            places, n = places[order], n[order]
            edge = np.flatnonzero(np.diff(n, prepend=-1, append=-1))
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                yield from self._windows(s, row, k, int(n[a]), places[a:b], *self.groups[int(n[a])])

    def _windows(self, s, row, k, n, places, own, index):
        m = n - k + 1  # shingles in a window
        first = np.searchsorted(row, row[places])
        last = np.searchsorted(row, row[places], "right")
        # a document shorter than the item is one window
        lo, hi = np.maximum(places - m + 1, first), np.maximum(np.minimum(places, last - n), first) + 1
        want = np.flatnonzero(cover(len(s), np.minimum(lo, hi - 1), hi))
        begin, end = runs(cover(len(s), np.minimum(lo, hi - 1), np.minimum(np.maximum(hi + m, hi), len(s))))
        for b, e in zip(begin.tolist(), end.tolist(), strict=True):
            mine = want[(want >= b) & (want < e)]
            sums = np.zeros((e - b + 1, 64), np.int32)
            np.cumsum(signs(s[b:e]), axis=0, out=sums[1:])
            stop = np.minimum(mine + m, np.minimum(np.searchsorted(row, row[mine], "right") - k + 1, e))
            q, f = index.find(simhash(sums[stop - b] - sums[mine - b]))
            for i, j in zip(q.tolist(), f.tolist(), strict=True):
                sim = similarity(s[mine[i] : stop[i]], self.bags[self.at[own[j]] : self.at[own[j] + 1]])
                if sim >= SIMILAR:
                    yield int(row[mine[i]]), int(own[j]), sim, int(mine[i])


_FOUND = ", item_ids array<long>, similarities array<double>, first_words array<long>"


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                names = part.schema.names
                words = lowered(part.column(names.index("text")))
                best: list[dict[int, tuple[float, int]]] = [{} for _ in range(part.num_rows)]
                for r, i, sim, at in items.search(words.hash, words.row):
                    old = best[r].get(i)
                    if old is None or (sim, -at) > (old[0], -old[1]):
                        best[r][i] = sim, at
                first = words.first
                rows = [sorted((items.ids[i], sim, at - int(first[r])) for i, (sim, at) in x.items() if items.ids[i] is not None) for r, x in enumerate(best)]
                cols = [pa.array([[y[c] for y in x] for x in rows], pa.list_(t)) for c, t in enumerate((pa.int64(), pa.float64(), pa.int64()))]
                kept = [n for n in names if n != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(names.index(n)) for n in kept), *cols], [*kept, "item_ids", "similarities", "first_words"])

    return run


def _passes(benchmark: DataFrame, pass_bytes: int) -> Iterator[Items]:
    """The indexes of blocks of items, each of about ``pass_bytes`` of text."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = size // pass_bytes + 1
    for i in range(passes):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == i).collect()
        yield Items([r.item_id for r in block], [r.text for r in block])


def _hits(rows: DataFrame, items: Items) -> DataFrame:
    """The rows (doc_id, text, further columns) with what leaks into each."""
    return rows.mapInArrow(_scan(rows.sparkSession.sparkContext.broadcast(items)), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text") + _FOUND)


def leaky_texts(docs: DataFrame, benchmark: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """k1, k2 (128 bits of the text), m (item_ids, similarities, first_words as an array) of texts that hold an item."""
    rows = keyed(docs)
    found = [stored(_hits(rows, items).where(F.size("item_ids") > 0)) for items in _passes(benchmark, pass_bytes)]
    each = found[0]
    for f in found[1:]:
        each = each.union(f)
    # equal texts have equal answers: one row for each pass
    once = each.select("k1", "k2", F.explode(F.arrays_zip("item_ids", "similarities", "first_words")).alias("m")).distinct()
    return stored(once.groupBy("k1", "k2").agg(F.array_sort(F.collect_list("m")).alias("m")))


def find_leaks(docs: DataFrame, benchmark: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """doc_id, contaminated, item_ids, similarities, first_words of each row of docs.

    An item (item_id, text) leaks into a document if some window of as many words as the item (the whole
    document, if that is shorter) has weighted Jaccard similarity of at least 0.8 on shingles of five words
    (fewer words: one shingle of all). Words are lower-cased runs of letters, digits and bytes beyond ASCII.
    Null or empty items match nothing; null or empty texts hold nothing; item_ids are sorted, each with its best
    window. Items go out in blocks of ``pass_bytes``, each against all documents; the answer of a row depends on its
    text alone, so it is the same for any number of blocks. Repeated rows, and rows that share a doc_id or have none,
    are answered each by their own text; empty tables give an empty table or no leaks.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    passes = list(islice(_passes(benchmark, pass_bytes), 2))
    if len(passes) == 1:
        out = _hits(rows, passes[0])
    else:
        found = leaky_texts(docs, benchmark, pass_bytes)
        own = keyed(docs, F.col("doc_id").cast("long").alias("doc_id")).drop("text").join(found, ["k1", "k2"], "left")
        out = own.select("doc_id", *[F.coalesce(F.col(f"m.{c}"), F.array().cast(t)).alias(c) for c, t in (("item_ids", "array<long>"), ("similarities", "array<double>"), ("first_words", "array<long>"))])
    return out.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "similarities", "first_words")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The rows of docs into whose text no item leaks; columns unchanged."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    k1, k2 = (free_name(docs, c) for c in ("k1", "k2"))
    bad = leaky_texts(docs, benchmark, pass_bytes).select(F.col("k1").alias(k1), F.col("k2").alias(k2))
    # few texts leak, so Spark broadcasts them by the size of their file, or else joins by hash
    return docs.withColumns({k1: F.xxhash64(text), k2: F.xxhash64(F.lit("k2"), text)}).join(bad, [k1, k2], "left_anti").select(*docs.columns)
