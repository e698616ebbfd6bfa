"""Repeated word passages: fixed-block anchors, rolling probes, extension to maximal repeats.

A window of 35 words holds a whole block of 18 words of its own document's fixed grid, since 2 * 18 - 1 <= 35.
So a window that occurs twice has, in each of its documents, a grid block that is also a rolling window
elsewhere. Three passes:

1. every document ships the hashes of all its rolling 18-word windows (packed, at most two copies of a value
   from a task) and its grid blocks; a block is hit if its value occurs twice among all rolling windows;
2. around hit blocks only, each document ships the hashes of its 35-word windows, grouped into runs by the
   least rolling hash inside the window, so that equal windows meet and neighbours travel together; windows
   that occur twice are repeats, and neighbouring ones merge to maximal spans;
3. each text gets its spans.

A least hash with very many windows (the edges of a common passage) is dealt out window by window instead.

Texts are keyed by 128 bits of their content, so copies share one answer. Nothing is capped: a task drops only
what is equal to what it ships already.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblode.llm._store import free_name, remove, scratch, stored
from joblode.llm._words import Text, Words, cover, mixed, runs, slices, windows

WINDOW = 35
#: Rolling values that a reducer holds at once (12 bytes each).
GROUP = 4_000_000
_FLUSH = 4_000_000
_FULL = np.uint64(0xFFFFFFFF)


def _packed(keys: np.ndarray) -> bytes:
    """Sorted 32-bit keys as differences: all low halves, then all high halves (mostly tiny, so they compress)."""
    step = np.diff(keys, prepend=keys[:1] * 0).astype(np.uint32)
    return (step & 0xFFFF).astype(np.uint16).tobytes() + (step >> 16).astype(np.uint16).tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    half = np.frombuffer(blob, np.uint16).astype(np.uint32).reshape(2, -1)
    return np.cumsum(half[0] | half[1] << np.uint32(16), dtype=np.uint32)


def _at_most_two(keys: np.ndarray) -> np.ndarray:
    """A sorted array without third and later copies of a value."""
    keep = np.ones(len(keys), bool)
    keep[2:] = keys[2:] != keys[:-2]
    return keys[keep]


def _copies(batch: pa.RecordBatch, seen: dict[tuple[int, int], int], most: int) -> pa.RecordBatch:
    """The rows of a batch but for the copies of a text (k1, k2) beyond the first ``most`` of the task.

    What they would ship, values of which two copies suffice and places that the first copies name, is shipped.
    """
    keep = []
    for k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        seen[k] = seen.get(k, 0) + 1
        keep.append(seen[k] <= most)
    return batch if all(keep) else batch.filter(pa.array(keep))


_PROBES = "bucket int, keys binary, k1 binary, k2 binary, block binary"


def _probes(block: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        grid: list[tuple[np.ndarray, ...]] = []
        seen: dict[tuple[int, int], int] = {}
        n = 0

        def flush() -> pa.RecordBatch:
            roll = _at_most_two(np.sort(np.concatenate(held))) if held else np.zeros(0, np.uint64)
            own, k1, k2, at = (np.concatenate(x) for x in zip(*grid, strict=True)) if grid else (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 2, np.zeros(0, np.int32))
            out: list[list] = [[], [], [], [], []]
            cut = np.searchsorted(roll >> np.uint64(32), np.arange(buckets + 1))
            where = (own >> np.uint64(32)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            gut = np.searchsorted(where[order], np.arange(buckets + 1))
            for b in range(buckets):
                if cut[b] < cut[b + 1]:
                    for c, v in zip(out, (b, _packed(roll[cut[b] : cut[b + 1]] & _FULL), None, None, None), strict=True):
                        c.append(v)
                if gut[b] < gut[b + 1]:
                    i = order[gut[b] : gut[b + 1]]
                    for c, v in zip(out, (b, (own[i] & _FULL).astype(np.uint32).tobytes(), k1[i].tobytes(), k2[i].tobytes(), at[i].tobytes()), strict=True):
                        c.append(v)
            held.clear()
            grid.clear()
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])], _PROBES.replace(",", "").split()[::2])

        for batch in batches:
            for part in slices(_copies(batch, seen, 2), "text"):
                words = Words(Text(part.column(2)))
                h, whole = windows(words, block)
                # bucket in the high half, key in the low half
                h = mixed(h)
                h = (h >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | h & _FULL
                held.append(h[whole])
                n += len(held[-1])
                index = words.index()[: len(h)]
                mine = np.flatnonzero(whole & (index % block == 0))
                row = words.row[mine]
                grid.append((h[mine], *(part.column(i).to_numpy(zero_copy_only=False)[row] for i in (0, 1)), (index[mine] // block).astype(np.int32)))
                if n >= _FLUSH:
                    yield flush()
                    n = 0
        if held or grid:
            yield flush()

    return run


def _hits(table: pa.Table) -> pa.Table:
    """The grid blocks of a bucket whose value occurs at least twice among its rolling windows."""
    names = table.column_names
    keys, k1, k2, block = (table.column(names.index(c)).to_pylist() for c in ("keys", "k1", "k2", "block"))
    roll = [_unpacked(k) for k, x in zip(keys, k1, strict=True) if x is None]
    roll = np.sort(np.concatenate(roll)) if roll else np.zeros(0, np.uint32)
    twice = np.unique(roll[1:][roll[1:] == roll[:-1]])
    out = []
    for k, a, b, at in zip(keys, k1, k2, block, strict=True):
        if a is not None and len(twice):
            k = np.frombuffer(k, np.uint32)
            i = np.minimum(np.searchsorted(twice, k), len(twice) - 1)
            hit = np.flatnonzero(twice[i] == k)
            out.append(np.column_stack([np.frombuffer(a, np.int64)[hit], np.frombuffer(b, np.int64)[hit], np.frombuffer(at, np.int32)[hit]]))
    got = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)
    return pa.table({"k1": got[:, 0], "k2": got[:, 1], "block": got[:, 2].astype(np.int32)})


#: A least hash with more windows than this, and than a thousandth of all, is dealt out window by window.
HOT = 100_000
_RUNS = "home long, k1 long, k2 long, at int, known boolean, keys binary"


def _candidates(block: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        seen: dict[tuple[int, int], int] = {}
        n = 0

        def flush() -> pa.RecordBatch:
            key, home, k1, k2, at, new = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(key, kind="stable")
            same = np.diff(key[order], prepend=key[order][:1]) == 0
            same[:1] = False
            again = np.zeros(len(key), bool)  # equal to an earlier window of this task
            again[order[same]] = True
            known = np.zeros(len(key), bool)  # equal to another window of this task
            known[order[same]] = True
            known[order[np.flatnonzero(same) - 1]] = True
            # a run ends where the place, the home or the state changes
            begin = new | np.diff(home, prepend=home[:1] + np.uint64(1)).astype(bool) | np.diff(known.astype(np.int8) * 2 + again, prepend=9).astype(bool)
            b = np.flatnonzero(begin)
            e = np.append(b[1:], len(key))
            keys = [None if again[i] else key[i:j].tobytes() for i, j in zip(b, e, strict=True)]
            size = e - b
            # what is only a copy ships its place alone
            cols = [pa.array(home[b].view(np.int64)), pa.array(k1[b]), pa.array(k2[b]), pa.array(at[b].astype(np.int32)), pa.array(known[b]), pa.array([k if k is not None else int(s).to_bytes(4, "little") for k, s in zip(keys, size, strict=True)], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["home", "k1", "k2", "at", "known", "keys"])

        for batch in batches:
            for part in slices(_copies(batch, seen, 2), "text"):
                words = Words(Text(part.column(2)))
                hit = part.column(3)
                blocks = hit.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                each = np.asarray(pa.compute.list_value_length(hit).fill_null(0)).astype(np.int64)
                row = np.repeat(np.arange(part.num_rows), each)
                place = words.first[row] + blocks * block
                h, whole = windows(words, window)
                if not len(h):
                    continue
                lo = np.maximum(place + block - window, words.first[row])
                want = cover(len(h), np.minimum(lo, len(h)), np.minimum(place + 1, len(h))) & whole
                i = np.flatnonzero(want)
                if not len(i):
                    continue
                small = mixed(windows(words, block)[0])
                span = window - block + 1
                home = np.lib.stride_tricks.sliding_window_view(small, span)[i].min(axis=1)
                new = np.ones(len(i), bool)
                new[1:] = np.diff(i) != 1
                new[1:] |= words.row[i[1:]] != words.row[i[:-1]]
                r = words.row[i]
                held.append((mixed(h[i], 77), mixed(home, 5), *(part.column(c).to_numpy(zero_copy_only=False)[r] for c in (0, 1)), words.index()[i], new))
                n += len(i)
                if n >= _FLUSH // 4:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    return run


def _dealt(hot: list[int], buckets: int):
    """Rows of runs with their bucket: by least hash, by window for hot least hashes, anywhere for mere copies."""
    many = np.array(hot, np.int64).view(np.uint64)
    names = ["bucket", "k1", "k2", "at", "known", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home = batch.column(0).to_numpy().view(np.uint64)
            size = np.asarray(pa.compute.binary_length(batch.column(5))).astype(np.int64)
            spread = (size != 4) & np.isin(home, many)
            where = np.where(size == 4, np.arange(len(home), dtype=np.uint64), home) % np.uint64(buckets)
            bucket = pa.array(where.astype(np.int32))
            kept = pa.array(~spread)
            yield pa.RecordBatch.from_arrays([c.filter(kept) for c in (bucket, *batch.columns[1:])], names)
            i = np.flatnonzero(spread)
            if len(i):
                key = np.frombuffer(b"".join(batch.column(5).take(pa.array(i)).to_pylist()), np.uint64)
                n = size[i] // 8
                own = np.repeat(i, n)
                off = np.arange(len(key)) - np.repeat(np.cumsum(n) - n, n)
                k1, k2, at = (batch.column(c).to_numpy() for c in (1, 2, 3))
                known = batch.column(4).to_numpy(zero_copy_only=False)
                blobs = pa.Array.from_buffers(pa.binary(), len(key), [None, pa.py_buffer(np.arange(0, 8 * len(key) + 1, 8, dtype=np.int32)), pa.py_buffer(key)])
                yield pa.RecordBatch.from_arrays([pa.array((key % np.uint64(buckets)).astype(np.int32)), pa.array(k1[own]), pa.array(k2[own]), pa.array((at[own] + off).astype(np.int32)), pa.array(known[own].astype(bool)), blobs], names)

    return run


def _repeats(table: pa.Table) -> pa.Table:
    """Spans (first word, last window's first word + 1) of a bucket's windows that occur at least twice."""
    names = table.column_names
    k1, k2, at = (table.column(names.index(c)).to_numpy() for c in ("k1", "k2", "at"))
    known = np.asarray(table.column(names.index("known")).to_pylist(), bool)
    blobs = table.column(names.index("keys")).to_pylist()
    full = [i for i, x in enumerate(blobs) if len(x) != 4]
    out = [(i, 0, int.from_bytes(blobs[i], "little")) for i in np.flatnonzero([len(x) == 4 for x in blobs])]
    if full:
        key = np.frombuffer(b"".join(blobs[i] for i in full), np.uint64)
        size = np.array([len(blobs[i]) // 8 for i in full])
        order = np.sort(key)
        twice = np.unique(order[1:][order[1:] == order[:-1]])
        flag = np.repeat(known[full], size)
        if len(twice):
            j = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
            flag |= twice[j] == key
        first = np.concatenate(([0], np.cumsum(size)))
        # a gap after each run keeps neighbouring runs apart
        wide = np.zeros(len(key) + len(size), bool)
        wide[np.arange(len(key)) + np.repeat(np.arange(len(size)), size)] = flag
        b, e = runs(wide)
        owner = np.searchsorted(first[:-1] + np.arange(len(size)), b, "right") - 1
        base = first[owner] + owner
        out += zip(np.asarray(full)[owner].tolist(), (b - base).tolist(), (e - base).tolist(), strict=True)
    i, b, e = (np.array(x, np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
    return pa.table({"k1": k1[i], "k2": k2[i], "begin": (at[i] + b).astype(np.int32), "end": (at[i] + e).astype(np.int32)})


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """k1, k2 (128 bits of the text), text and the given columns."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("k2"), text).alias("k2"), text.alias("text"), *columns)


def repeated_spans(docs: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """k1, k2, spans (array of begin, end: windows starting in [begin, end) occur elsewhere) of texts with repeats."""
    spark = docs.sparkSession
    work = scratch(spark, "substring")
    block = (window + 1) // 2
    texts = keyed(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, int(size / 4 / GROUP) + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    hits = texts.mapInArrow(_probes(block, buckets), _PROBES).groupBy("bucket").applyInArrow(_hits, "k1 long, k2 long, block int")
    hits = stored(hits.groupBy("k1", "k2").agg(F.collect_set("block").alias("blocks")), work)
    near = texts.join(hits, ["k1", "k2"]).select("k1", "k2", "text", "blocks")
    rows = stored(near.mapInArrow(_candidates(block, window), _RUNS), work)
    # windows of a common passage's edges have one least hash and many contexts; such hashes are few by definition
    counts = rows.where(F.octet_length("keys") > 4).groupBy("home").agg(F.sum(F.expr("octet_length(keys) div 8")).alias("n"))
    most = F.greatest(F.lit(hot), F.expr("total div 1000"))
    many = [r.home for r in counts.join(F.broadcast(counts.agg(F.sum("n").alias("total")))).where(F.col("n") > most).select("home").collect()]
    dealt = rows.mapInArrow(_dealt(many, buckets), "bucket int, k1 long, k2 long, at int, known boolean, keys binary")
    found = dealt.groupBy("bucket").applyInArrow(_repeats, "k1 long, k2 long, begin int, end int")
    out = stored(found.groupBy("k1", "k2").agg(F.collect_set(F.struct("begin", "end")).alias("spans")))
    remove(spark, work)
    return out


def _flags(n: int, spans: list[dict] | None, window: int) -> np.ndarray:
    if not spans:
        return np.zeros(n, bool)
    begin, end = (np.fromiter((s[c] for s in spans), np.int64, len(spans)) for c in ("begin", "end"))
    return cover(n, begin, end + window - 1)


def _measured(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                gone = _flags(len(words), spans, window)
                if spans:
                    b, e = runs(~gone)
                    words, n = [w for x, y in zip(b, e, strict=True) for w in words[x:y]], len(words)
                else:
                    n = len(words)
                for c, v in zip(out, (n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest(), len(runs(gone)[0])), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True))], ["doc_id", "n_words", "n_removed", "kept_sha256", "n_spans"])

    return run


def measure_removal(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, n_spans of each row of docs.

    A word goes if a run of ``window`` words around it also starts anywhere else in any text (the same text
    included). Null and empty texts have no words; repeated rows repeat each other, so their long passages go;
    a null doc_id is kept; an empty table gives an empty one.
    """
    spans = repeated_spans(docs, window)
    rows = keyed(docs, F.col("doc_id").cast("long").alias("doc_id")).join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(_measured(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, n_spans long")


def _cut_text(text: str, spans: list[dict] | None, window: int) -> str:
    """The text without its repeated words; what lies between kept neighbours stays as it is."""
    if not spans:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    words = Words(Text(pa.array([text])), hashes=False)
    b, e = runs(~_flags(len(words.start), spans, window))
    return b" ".join(raw[words.start[x] : words.end[y - 1]] for x, y in zip(b, e, strict=True)).decode("utf-8", "surrogatepass")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with repeated passages cut from text; n_chars follows if present; other columns and all rows stay."""
    spans = repeated_spans(docs, window)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    k1, k2, found = (free_name(docs, c) for c in ("k1", "k2", "spans"))
    rows = docs.withColumns({k1: F.xxhash64(text), k2: F.xxhash64(F.lit("k2"), text)})
    rows = rows.join(spans.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("spans").alias(found)), [k1, k2], "left")

    @F.pandas_udf("string")
    def cut(texts, each):
        return texts.combine(each, lambda t, s: t if t is None or s is None else _cut_text(t, list(s), window))

    rows = rows.withColumn("text", F.when(F.col(found).isNull(), F.col("text")).otherwise(cut("text", found)))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(found).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)
