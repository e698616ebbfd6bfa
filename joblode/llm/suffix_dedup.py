"""Repeated byte strings: merged Burrows-Wheeler transforms over content-defined buckets.

A 100-byte window is keyed by the least hash of its 32-byte substrings, which depends on nothing but the window.
Neighbouring windows with one key make a run. Runs whose key occurs once in the corpus hold no repeats and are
left out; the others go, as bytes, to the bucket of their key, so all copies of a window meet. Copies of a whole
run need no more than their order. What is left of a bucket, runs that share a key but differ, is put in shards;
each shard's transform is built and the transforms are merged by interleave refinement to depth 100, whose classes
are the repeated intervals. Of each class the earliest window stays. A key of very many runs (a common line with
many neighbours) would make one bucket grow with the corpus; its windows are dealt out by 128-bit hashes instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblode.llm._store import remove, scratch, stored
from joblode.llm._words import Text, byte_sums, cover, mixed, powers, runs, slices
from joblode.llm.bwt import classes
from joblode.llm.substring import _at_most_two, _packed, _unpacked

WINDOW = 100
GRAM = 32
#: Bytes of runs that one bucket holds on average.
BUCKET = 3_000_000
_FLUSH = 2_000_000
#: A key with more runs than this, and than a thousandth of all, is settled by 128-bit hashes of its windows.
HOT = 20_000
_OTHER = np.random.default_rng(20240502).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)
_LOW = np.uint64(0xFFFFFFFF)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    sums = byte_sums(data)
    return mixed((sums[GRAM:] - sums[:-GRAM]) * powers(len(sums))[1][: len(sums) - GRAM], 31)


def _slide(values: np.ndarray, width: int, of) -> np.ndarray:
    """of (np.minimum or np.maximum) over each ``width`` neighbouring values."""
    out, wide = values, 1
    while wide * 2 <= width:
        out = of(out[:-wide], out[wide:])
        wide *= 2
    return of(out[: wide - width], out[width - wide :]) if width > wide else out


class Runs:
    """begin, end (window starts), value (least hash), row and index in the row of each run of windows.

    again: values that stand twice in one run (periodic text), so that the run may repeat itself.
    """

    def __init__(self, text: Text, window: int):
        n = len(text.data) - window + 1
        self.begin = self.end = self.row = self.index = np.zeros(0, np.int64)
        self.value = self.again = np.zeros(0, np.uint64)
        if n <= 0:
            return
        grams, want = gram_hashes(text.data), window - GRAM + 1
        least = _slide(grams, want, np.minimum)
        # a gram is some window's least if it is the greatest least of the windows that hold it
        edge = np.zeros(want - 1, np.uint64)
        least_of = np.flatnonzero(_slide(np.concatenate([edge, least, edge]), want, np.maximum) == grams)
        close = np.flatnonzero((np.diff(least_of) <= want) & (grams[least_of[1:]] == grams[least_of[:-1]]))
        self.again = np.unique(grams[least_of[close]])
        whole = np.ones(n, bool)
        for a, b in zip(np.maximum(text.at[1:] - window + 1, text.at[:-1]).tolist(), text.at[1:].tolist(), strict=True):
            whole[a:b] = False
        begin = whole.copy()
        begin[1:] &= ~whole[:-1] | (least[1:] != least[:-1])
        self.begin = np.flatnonzero(begin)
        stop = whole.copy()
        stop[:-1] &= begin[1:] | ~whole[1:]
        self.end = np.flatnonzero(stop) + 1
        self.value = least[self.begin]
        self.row = np.searchsorted(text.at, self.begin, "right") - 1
        self.index = np.arange(len(self.begin)) - np.searchsorted(self.row, np.arange(text.n))[self.row]


_ANCHORS = "bucket int, keys binary, docs binary, runs binary"


def _anchors(window: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        own: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            key, doc, index = (np.concatenate(x) for x in zip(*held, strict=True))
            all_keys = _at_most_two(np.sort(np.concatenate([key, *own])))
            held.clear()
            own.clear()
            cut = np.searchsorted(all_keys >> np.uint64(32), np.arange(buckets + 1))
            where = (key >> np.uint64(32)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            gut = np.searchsorted(where[order], np.arange(buckets + 1))
            out: list[list] = [[], [], [], []]
            for b in range(buckets):
                i = order[gut[b] : gut[b + 1]]
                if len(i):
                    row = (b, _packed(all_keys[cut[b] : cut[b + 1]] & _LOW), None, None), (b, (key[i] & _LOW).astype(np.uint32).tobytes(), doc[i].tobytes(), index[i].astype(np.int32).tobytes())
                    for r in row:
                        for c, v in zip(out, r, strict=True):
                            c.append(v)
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])], ["bucket", "keys", "docs", "runs"])

        for batch in batches:
            for part in slices(batch, "text"):
                r = Runs(Text(part.column(2)), window)
                key, again = ((v >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | v & _LOW for v in (r.value, r.again))
                own.append(np.repeat(again, 2))
                held.append((key, part.column(0).to_numpy()[r.row], r.index))
                n += len(key)
                if n >= _FLUSH:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    return run


def _shared(most: int):
    """doc, run of the runs whose key occurs at least twice in a bucket; hot: keys with more than ``most`` runs."""
    return lambda table: _shared_runs(table, most)


def _shared_runs(table: pa.Table, most: int) -> pa.Table:
    names = table.column_names
    keys, docs, index = (table.column(names.index(c)).to_pylist() for c in ("keys", "docs", "runs"))
    every = [_unpacked(k) for k, d in zip(keys, docs, strict=True) if d is None]
    every = np.sort(np.concatenate(every)) if every else np.zeros(0, np.uint32)
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    doc, run = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for k, d, i in zip(keys, docs, index, strict=True):
        if d is not None and len(twice):
            k = np.frombuffer(k, np.uint32)
            at = np.minimum(np.searchsorted(twice, k), len(twice) - 1)
            hit = np.flatnonzero(twice[at] == k)
            doc.append(np.frombuffer(d, np.int64)[hit])
            run.append(np.frombuffer(i, np.int32)[hit])
    own = [np.frombuffer(k, np.uint32) for k, d in zip(keys, docs, strict=True) if d is not None]
    key, n = np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    hot = key[n > most].astype(np.int64) | table.column(names.index("bucket"))[0].as_py() << 32
    doc, run = np.concatenate(doc), np.concatenate(run)
    gap = pa.nulls(len(hot))
    return pa.table({"doc": pa.concat_arrays([pa.array(doc), gap.cast(pa.int64())]), "run": pa.concat_arrays([pa.array(run), gap.cast(pa.int32())]), "hot": pa.concat_arrays([pa.nulls(len(doc)).cast(pa.int64()), pa.array(hot)])})


_SEGMENTS = "bucket int, bytes binary, sizes binary, docs binary, texts binary, starts binary"
_SPANS = "doc long, k long, begin long, end long"


def _hashed(blob_of: dict[int, list], part: tuple[np.ndarray, ...], window: int, done: list) -> None:
    """Windows by their hashes (h1, h2, doc, k, start, bucket): copies within the task are done, the first travel."""
    h1, h2, doc, k, start, bucket = part
    order = np.lexsort((start, doc, h2, h1))
    h1, h2, doc, k, start, bucket = (x[order] for x in (h1, h2, doc, k, start, bucket))
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(h1)), 0)) if len(h1) else np.zeros(0, int)
    later = (doc != doc[lead]) | (start != start[lead])
    done += zip(doc[later].tolist(), k[later].tolist(), start[later].tolist(), (start[later] + window).tolist(), strict=True)
    i = np.flatnonzero(~later)
    for b in np.unique(bucket[i]).tolist():
        j = i[bucket[i] == b]
        blob_of.setdefault(b, []).append((np.column_stack([h1[j], h2[j]]).tobytes(), b"", doc[j].tobytes(), k[j].tobytes(), start[j].astype(np.int32).tobytes()))


def _segments(window: int, buckets: int, anchors: int, hot: list[int], plain: bool = False):
    many = np.sort(np.array(hot, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[tuple[int, int, int]]] = {}
        home: dict[bytes, int] = {}
        single: list[tuple[np.ndarray, ...]] = []
        n = 0

        def flush() -> pa.RecordBatch:
            by: dict[int, list[tuple[bytes, tuple[int, int, int]]]] = {}
            done: list[tuple[int, int, int, int]] = []
            for seg, places in held.items():
                first = min(places)
                # rows of one doc_id with other texts may share the first place
                by.setdefault(home[seg], []).extend((seg, p) for p in {p for p in places if plain or p[:2] == first[:2]})
                if plain:
                    continue
                # a run that stands earlier as a whole goes as a whole; its place alone travels
                done += [(d, k, s, s + len(seg)) for d, s, k in places if (d, s) != first[:2]]
            out: list[list] = [[], [], [], [], [], []]
            if single:
                blobs: dict[int, list] = {}
                _hashed(blobs, tuple(np.concatenate(x) for x in zip(*single, strict=True)), window, done)
                single.clear()
                for b, rows in blobs.items():
                    for row in rows:
                        for c, v in zip(out, (b, *row), strict=True):
                            c.append(v)
            for b, rows in by.items():
                cols = b"".join(s for s, _ in rows), *(np.array(x, t).tobytes() for x, t in (([len(s) for s, _ in rows], np.int32), ([p[0] for _, p in rows], np.int64), ([p[2] for _, p in rows], np.int64), ([p[1] for _, p in rows], np.int32)))
                for c, v in zip(out, (b, *cols), strict=True):
                    c.append(v)
            if done:
                done.sort()
                d, k, s, e = (np.array(x, np.int64) for x in zip(*done, strict=True))
                new = np.ones(len(d), bool)
                new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1]) | (s[1:] > e[:-1])
                at = np.flatnonzero(new)
                far = np.maximum.reduceat(e, at)
                where = (mixed(d[at].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                for b in np.unique(where).tolist():
                    i = at[where == b]
                    # no bytes: sizes are span lengths of what is settled
                    for c, v in zip(out, (b, None, (far[where == b] - s[i]).astype(np.int32).tobytes(), d[i].tobytes(), k[i].tobytes(), s[i].astype(np.int32).tobytes()), strict=True):
                        c.append(v)
            held.clear()
            home.clear()
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])], [x.split()[0] for x in _SEGMENTS.split(", ")])

        for batch in batches:
            for part in slices(batch, "text"):
                text = Text(part.column(2))
                r = Runs(text, window)
                hits = part.column(3)
                want = np.zeros(len(r.begin) + 1, bool)
                each = np.asarray(hits.value_lengths().fill_null(0)).astype(np.int64)
                row = np.repeat(np.arange(part.num_rows), each)
                place = np.searchsorted(r.row, row) + hits.flatten().to_numpy(zero_copy_only=False)
                # rows of one doc_id with other texts may have fewer runs
                want[place[(place < len(r.begin)) & (r.row[np.minimum(place, max(0, len(r.begin) - 1))] == row)] if len(r.begin) else []] = True
                i = np.flatnonzero(want[:-1])
                if len(many) and len(i):
                    key = ((r.value[i] >> np.uint64(32)) % np.uint64(anchors) << np.uint64(32) | r.value[i] & _LOW).astype(np.int64)
                    often = np.isin(key, many)
                    x, i = i[often], i[~often]
                    each = (r.end - r.begin)[x]
                    at = np.repeat(r.begin[x], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                    row = np.repeat(r.row[x], each)
                    up, down = powers(len(text.data) + 1)
                    first, second = byte_sums(text.data), np.concatenate(([np.uint64(0)], np.cumsum(_OTHER[text.data] * up[: len(text.data)])))
                    h1, h2 = (mixed((t[at + window] - t[at]) * down[at], 41) for t in (first, second))
                    single.append((h1, h2, part.column(0).to_numpy()[row], part.column(1).to_numpy()[row], at - text.at[row], (h1 % np.uint64(buckets)).astype(np.int64)))
                    n += len(at) // 20
                raw = text.data.tobytes()
                doc, k = (part.column(c).to_numpy()[r.row[i]].tolist() for c in (0, 1))
                start = (r.begin[i] - text.at[r.row[i]]).tolist()
                where = ((r.value[i] >> np.uint64(32)) % np.uint64(buckets)).tolist()
                for a, e, d, key, s, b in zip(r.begin[i].tolist(), (r.end[i] + window - 1).tolist(), doc, k, start, where, strict=True):
                    seg = raw[a:e]
                    old = held.get(seg)
                    if old is None:
                        held[seg], home[seg] = [(d, s, key)], b
                        n += 1
                    else:
                        old.append((d, s, key))
                if n >= _FLUSH // 10:
                    yield flush()
                    n = 0
        if held or single:
            yield flush()

    return run


def _may_share(data: np.ndarray, at: np.ndarray, grams: np.ndarray, key: np.ndarray, times: np.ndarray, window: int) -> np.ndarray:
    """Flags of the runs (bytes at[i]..at[i+1], least gram key[i]) that may share a window with one another.

    A shared window holds the least gram and, on one side of it, at least half of the other bytes. So a run needs
    another run of its key with equal bytes over the gram and that half, on the left or on the right. A run in which
    its gram stands twice may repeat itself; keys with such a run are not judged.
    """
    size = np.diff(at)
    group, many = np.unique(key, return_inverse=True, return_counts=True)[1:]
    several = many[group] > 1
    loose = np.zeros(len(many), bool)
    loose[group[times > 1]] = True
    hit = np.flatnonzero(grams == np.repeat(key, size)[: len(grams)])
    place = hit[np.searchsorted(hit, at[:-1])]
    half = (window - GRAM + 1) // 2
    sums = byte_sums(data)
    down = powers(len(sums))[1]
    shared = np.zeros(len(key), bool)
    for begin, end in ((place, place + GRAM + half), (place - half, place + GRAM)):
        inside = np.flatnonzero((begin >= at[:-1]) & (end <= at[1:]))
        b, e = begin[inside], end[inside]
        h = mixed((sums[e] - sums[b]) * down[b] + key[inside], 17)
        same, n = np.unique(h, return_inverse=True, return_counts=True)[1:]
        shared[inside[n[same] > 1]] = True
    return (several & shared) | loose[group]


def _settle(window: int, plain: bool = False):
    """plain: every run is a string of the merge, copies and lone runs included."""

    def settle(table: pa.Table) -> pa.Table:
        names = table.column_names
        blobs = [table.column(names.index(c)).to_pylist() for c in ("bytes", "sizes", "docs", "texts", "starts")]
        spans: list[tuple[np.ndarray, ...]] = []
        where: dict[bytes, list[tuple[int, int, int]]] = {}
        windows: list[tuple[np.ndarray, ...]] = []
        for raw, sizes, docs, texts, starts in zip(*blobs, strict=True):
            size, doc, k, start = np.frombuffer(sizes, np.int32), np.frombuffer(docs, np.int64), np.frombuffer(texts, np.int64), np.frombuffer(starts, np.int32).astype(np.int64)
            if raw is None:
                spans.append((doc, k, start, start + size))
                continue
            if not len(size):
                windows.append((*np.frombuffer(raw, np.uint64).reshape(-1, 2).T, doc, k, start))
                continue
            at = 0
            for n, d, t, s in zip(size.tolist(), doc.tolist(), k.tolist(), start.tolist(), strict=True):
                where.setdefault(raw[at : at + n], []).append((d, s, t))
                at += n
        later: list[tuple[int, int, int, int]] = []
        if windows:
            cols = tuple(np.concatenate(x) for x in zip(*windows, strict=True))
            _hashed({}, (*cols, np.zeros(len(cols[0]), np.int64)), window, later)
        segs, first = [], []
        for seg, places in where.items():
            if plain:
                each: dict[tuple[int, int], set[int]] = {}
                for d, at_, t in places:
                    each.setdefault((d, at_), set()).add(t)
                segs += [seg] * len(each)
                first += [(*p, sorted(t)) for p, t in sorted(each.items())]
                continue
            keep = min(places)
            segs.append(seg)
            first.append((*keep[:2], sorted({t for d, s, t in places if (d, s) == keep[:2]})))
            later += [(d, t, s, s + len(seg)) for d, s, t in places if (d, s) != keep[:2]]
        if segs:
            data = np.frombuffer(b"".join(segs), np.uint8)
            size = np.array([len(s) for s in segs], np.int64)
            at = np.concatenate(([0], np.cumsum(size)))
            grams = gram_hashes(data)
            # grams across segments don't count
            inside = np.ones(len(grams) + GRAM - 1, bool)
            for e in at[1:].tolist():
                inside[e - GRAM + 1 : e] = False
            grams = np.where(inside[: len(grams)], grams, np.uint64((1 << 64) - 1))
            key = np.minimum.reduceat(grams, at[:-1])
            times = np.add.reduceat((grams == np.repeat(key, size)[: len(grams)]).astype(np.int32), at[:-1])
            open_ = list(range(len(segs))) if plain else np.flatnonzero(_may_share(data, at, grams, key, times, window)).tolist()
            found = classes([segs[i] for i in open_], window)
            if found:
                length = np.array([len(x) for x in found], np.int64)
                label = np.concatenate(found)
                owner = np.repeat(np.array(open_), length)
                off = np.arange(len(label)) - np.repeat(np.cumsum(length) - length, length)
                doc = np.array([f[0] for f in first], np.int64)[owner]
                start = np.array([f[1] for f in first], np.int64)[owner] + off
                order = np.lexsort((start, doc, label))
                dup = np.zeros(len(order), bool)
                dup[1:] = label[order][1:] == label[order][:-1]
                # windows of one class at one place (rows of one doc_id) are not earlier than each other
                lead = np.maximum.accumulate(np.where(~dup, np.arange(len(order)), 0)) if len(order) else np.zeros(0, int)
                dup &= (doc[order] != doc[order][lead]) | (start[order] != start[order][lead])
                gone = np.zeros(len(label) + len(length), bool)
                gone[(np.arange(len(label)) + np.repeat(np.arange(len(length)), length))[order[dup]]] = True
                b, e = runs(gone)
                base = np.cumsum(length) - length + np.arange(len(length))
                which = np.searchsorted(base, b, "right") - 1
                own = [first[open_[w]] for w in which.tolist()]
                later += [(d, t, s + x, s + y + window - 1) for (d, s, ts), x, y in zip(own, (b - base[which]).tolist(), (e - base[which]).tolist(), strict=True) for t in ts]
        if later:
            spans.append(tuple(np.array(x, np.int64) for x in zip(*later, strict=True)))
        doc, k, begin, end = (np.concatenate([s[i] for s in spans]) if spans else np.zeros(0, np.int64) for i in range(4))
        return pa.table({"doc": doc, "k": k, "begin": begin, "end": end})

    return settle


#: Stands for a null doc_id: such rows come after all others and count as one document.
NO_ID = (1 << 63) - 1


def repeated_spans(docs: DataFrame, window: int = WINDOW, hot: int = HOT, plain: bool = False) -> DataFrame:
    """doc, k, spans (array of begin, end in bytes) of what stands earlier, for rows that have such bytes.

    plain: all runs of a key that stands twice go through the merged transforms as they are, without the shortcuts for
    copies of whole runs, runs that share no half window, and hot keys. These only spare the merge what it would
    return: the spans are the same.
    """
    spark = docs.sparkSession
    work = scratch(spark, "suffix")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("k"), text.alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(8, parts, size // (40 * 1_000_000))
    most = (1 << 62) if plain else max(hot, size // 35 // 1000)
    raw = stored(rows.mapInArrow(_anchors(window, buckets), _ANCHORS).groupBy("bucket").applyInArrow(_shared(most), "doc long, run int, hot long"), work)
    many = [r.hot for r in raw.where("hot is not null").select("hot").collect()]
    hits = stored(raw.where("hot is null").groupBy("doc").agg(F.collect_set("run").alias("runs")), work)
    shared = hits.agg(F.sum(F.size("runs"))).first()[0] or 0
    homes = max(8, parts, shared * 135 // BUCKET)
    near = rows.join(hits, "doc").select("doc", "k", "text", "runs")
    found = near.mapInArrow(_segments(window, homes, buckets, many, plain), _SEGMENTS).groupBy("bucket").applyInArrow(_settle(window, plain), _SPANS)
    out = stored(found.groupBy("doc", "k").agg(F.collect_list(F.struct("begin", "end")).alias("spans")))
    remove(spark, work)
    return out


def _gone(n: int, spans: list[dict] | None) -> np.ndarray:
    if not spans:
        return np.zeros(n, bool)
    return cover(n, *(np.fromiter((s[c] for s in spans), np.int64, len(spans)) for c in ("begin", "end")))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            gone = _gone(len(raw), spans)
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if spans else raw
            for c, v in zip(out, (len(raw), len(raw) - len(kept), len(runs(gone)[0]) if spans else 0, hashlib.sha256(kept).hexdigest()), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def measure_removal(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs.

    A byte goes if a window of ``window`` bytes around it also starts in a document with a smaller doc_id, or
    earlier in its own. Null and empty texts have no bytes. Rows with one doc_id count as one document, so they do
    not remove each other at equal starts; rows without a doc_id come after all others, as one document. An empty
    table gives an empty one. ``window`` must be even.
    """
    spans = repeated_spans(docs, window)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("k"))
    rows = rows.join(spans, ["doc", "k"], "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(_measured, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
