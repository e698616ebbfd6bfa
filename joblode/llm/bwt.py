"""Burrows-Wheeler transforms of small text collections, merged by iterative interleave refinement.

A shard holds strings and the order of their suffixes. Symbols are byte pairs, so a suffix's predecessor is the one
two bytes before it. The merge starts with the shards one after another and, in each round, sorts the interleave
stably by the symbols before the suffixes: after h rounds it is ordered by the first h pairs. A boundary between
suffixes that differ stays where it is in all later rounds, so the round in which it appears is the length of their
common prefix; intervals without a boundary are the repeats of that depth. No suffix is compared or sorted again after
its shard is built.
"""

from __future__ import annotations

import numpy as np

END = 0xFFFF  # no pair of UTF-8 bytes


def _ordered(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of pairs (a, b), and which of them differ from the one before."""
    bits = int(max(int(a.max()), int(b.max()), len(a))).bit_length()
    if 3 * bits <= 64:
        # one value holds the pair and its place, so values are sorted instead of places
        both = np.sort(a << np.uint64(2 * bits) | b << np.uint64(bits) | np.arange(len(a), dtype=np.uint64))
        order = (both & np.uint64((1 << bits) - 1)).astype(np.int64)
        key = both >> np.uint64(bits)
    else:
        key = a << np.uint64(32) | b
        order = np.argsort(key)
        key = key[order]
    return order, np.diff(key, prepend=key[:1]) != 0


class Shard:
    """Strings (bytes concatenated, size of each) with their suffix order and transform.

    Suffixes are the places 0..n of each string of n bytes; the last two are terminals, which differ from all.
    """

    def __init__(self, data: np.ndarray, size: np.ndarray):
        n = int((size + 1).sum())
        first = np.concatenate(([0], np.cumsum(size + 1)))
        text = np.zeros(n + 1, np.uint8)
        place = np.ones(n, bool)
        place[first[1:] - 1] = False
        text[:n][place] = data
        self.first, self.count = first[:-1], len(size)
        last = first[1:] - 1
        terminal = np.zeros(n, bool)
        terminal[last], terminal[last - 1] = True, True
        pair = text[:-1].astype(np.uint16) << 8 | text[1:]
        rank = np.where(terminal, 0, pair).astype(np.uint64)
        ends = np.flatnonzero(terminal)
        rank[ends] = END + 1 + np.arange(len(ends))
        step = 2
        while True:
            after = np.zeros(n, np.uint64)
            after[:-step] = rank[step:]
            after[terminal] = 0
            # a suffix that ends within the step is unique already, whatever follows
            order, new = _ordered(rank, after + np.uint64(1))
            rank = np.empty(n, np.uint64)
            rank[order] = np.cumsum(new)
            step *= 2
            if step > 64 or step >= n:
                break
        # terminals stand last, in the order of their strings
        order = order[~terminal[order]]
        self.order = np.concatenate([order, ends])
        before = np.full(n, END, np.uint16)
        before[2:] = pair[:-2]
        head = np.concatenate([self.first, self.first + 1])
        before[head[head < n]] = END
        self.bwt = before[self.order]
        self.inner, self.ends = n - len(ends), len(ends)


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each suffix in the merged order by the first ``depth`` bytes (even), and the bytes, in pairs, that it
    has in common with the suffix before it (``depth`` where they are as many or more)."""
    which = np.arange(len(shards), dtype=np.uint8 if len(shards) < 256 else np.uint32)
    inner = np.repeat(which, [s.inner for s in shards])
    tail = np.repeat(which, [s.ends for s in shards])
    z = np.concatenate([inner, tail])
    symbols = np.concatenate([s.bwt for s in shards])
    cut = len(inner)
    block = np.zeros(len(z), np.int32)  # at depth 0 all suffixes are alike
    common = np.full(len(z), depth, np.uint16 if depth < 1 << 16 else np.uint32)
    known, blocks = np.zeros(len(z), bool), 1
    for length in range(0, depth, 2):
        base = np.argsort(z, kind="stable")
        symbol = np.empty(len(z), np.uint16)
        symbol[base] = symbols
        perm = np.argsort(symbol, kind="stable")
        z, old, symbol = z[perm], block[perm], symbol[perm]
        z[cut:] = tail
        edge = np.ones(len(z), bool)
        edge[0] = False
        edge[1:cut] = (symbol[1:cut] != symbol[: max(cut - 1, 0)]) | (old[1:cut] != old[: max(cut - 1, 0)]) if cut else edge[1:cut]
        block = np.cumsum(edge, dtype=np.int32)
        now = int(block[-1]) + 1
        if now == blocks:
            break
        common[edge & ~known] = length
        known, blocks = edge, now
    return z, common


def interleave(shards: list[Shard], depth: int) -> list[np.ndarray]:
    """For each shard, the class of each suffix place: equal classes share their first ``depth`` bytes (even)."""
    z, common = merge(shards, depth)
    interval = np.cumsum(common < depth, dtype=np.int32)
    base = np.argsort(z, kind="stable")
    out, at = [], 0
    for s in shards:
        n = len(s.order)
        own = np.empty(n, np.int32)
        own[s.order] = interval[base[at : at + n]]
        out.append(own)
        at += n
    return out


def classes(strings: list[bytes], depth: int, shards: int = 8) -> list[np.ndarray]:
    """For each string, the class of each of its ``depth``-byte windows: equal windows have equal classes."""
    if not strings:
        return []
    parts = [p for p in np.array_split(np.arange(len(strings)), min(shards, len(strings))) if len(p)]
    built = []
    for p in parts:
        size = np.array([len(strings[i]) for i in p], np.int64)
        built.append(Shard(np.frombuffer(b"".join(strings[i] for i in p), np.uint8), size))
    out: list[np.ndarray] = []
    for shard, own, p in zip(built, interleave(built, depth), parts, strict=True):
        for i, a in zip(p, shard.first.tolist(), strict=True):
            out.append(own[a : a + max(0, len(strings[i]) - depth + 1)])
    return out
