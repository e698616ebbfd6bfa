"""Hierarchical residual packing of token sequences.

Each task that tokenises a part of the corpus packs it best-fit in decreasing length and emits the bins that are
full, or nearly so. Underfull bins become items of the next round: they are dealt anew to groups of bounded size
and packed again, until one group holds what is left or a round no longer saves bins. A bin carries its pieces in
a packed row, so no round joins anything and no group grows with the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblode.llm._store import stored

CAPACITY = 2048
END = 0
#: Bins with at most this much room left are emitted at once.
SLACK = 8
#: Items that one group of a later round packs.
GROUP = 50_000
PIECE = np.dtype([("doc_id", "<i8"), ("known", "?"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i4"), ("crc", "<u4")])
_BINS = "fill int, pieces binary"
#: Fixed value: the split pattern of the published 50k byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """Ids of the published byte-level vocabulary, as its ``tokenizers`` file gives them.

    Built from the text of that file: the merge ranks drive the faster of two public implementations; texts
    that hold one of the file's special strings go to the other.
    """

    def __init__(self, spec: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        model = json.loads(spec)
        # printable stand-ins of the 256 bytes, in the order that the vocabulary format fixes
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
        self.special = [t["content"] for t in model["added_tokens"]]
        ranks = {bytes(byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in self.special}
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.exact = Tokenizer.from_str(spec)

    def ids(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@cache
def _encoder(spec: str) -> Encoder:
    return Encoder(spec)


def cut(ids: np.ndarray, capacity: int) -> list[tuple[int, int, int, int]]:
    """piece, start, length, crc32 of the pieces of one document; only its first piece may be short."""
    n = len(ids)
    first = n - (n - 1) // capacity * capacity
    raw, out, start = ids.astype("<u4"), [], 0
    for i, stop in enumerate(range(first, n + 1, capacity)):
        out.append((i, start, stop - start, zlib.crc32(raw[start:stop].tobytes())))
        start = stop
    return out


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Items of each bin, by best fit in decreasing size."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by room left
    some = 0  # bit r: room[r] is not empty
    bins: list[list[int]] = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = some >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                some ^= 1 << r
            bins[b].append(i)
        else:
            r, b = capacity, len(bins)
            bins.append([i])
        r -= s
        room[r].append(b)
        some |= 1 << r
    return bins


def _bins(sizes: list[int], blobs: list[bytes], capacity: int) -> pa.RecordBatch:
    fill = np.asarray(sizes, np.int64)
    made = best_fit(fill, capacity)
    return pa.RecordBatch.from_arrays([pa.array([int(fill[b].sum()) for b in made], pa.int32()), pa.array([b"".join(blobs[i] for i in b) for b in made], pa.binary())], ["fill", "pieces"])


def _first_round(spec, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(spec.value)
        sizes: list[int] = []
        blobs: list[bytes] = []
        full: list[bytes] = []
        for batch in batches:
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encoder.ids(text or ""), END], np.uint32)
                for piece, start, length, crc in cut(ids, capacity):
                    row = np.array((d or 0, d is not None, piece, start, length, crc), PIECE).tobytes()
                    if length == capacity:
                        full.append(row)
                    else:
                        sizes.append(length)
                        blobs.append(row)
            if full:
                yield pa.RecordBatch.from_arrays([pa.array([capacity] * len(full), pa.int32()), pa.array(full, pa.binary())], ["fill", "pieces"])
                full = []
        if sizes:
            yield _bins(sizes, blobs, capacity)

    return run


def _next_round(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        names = table.column_names
        batch = _bins(table.column(names.index("fill")).to_pylist(), table.column(names.index("pieces")).to_pylist(), capacity)
        return pa.Table.from_batches([batch])

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blobs = batch.column(1).to_pylist()
        rows = np.frombuffer(b"".join(blobs), PIECE)
        size = np.array([len(b) // PIECE.itemsize for b in blobs], np.int64)
        seq = np.repeat(batch.column(0).to_numpy(), size)
        length = rows["length"].astype(np.int64)
        before = np.cumsum(length) - length
        first = np.cumsum(size) - size
        offset = before - np.repeat(before[first], size) if len(rows) else before
        cols = [pa.array(rows["doc_id"], mask=~rows["known"]), pa.array(rows["piece"]), pa.array(rows["start"]), pa.array(length), pa.array(rows["crc"].astype(np.int64)), pa.array(seq), pa.array(offset)]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, slack: int = SLACK, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of each row of docs.

    vocabulary: path (on the driver) of a byte-level vocabulary file. Null and empty texts are one end token;
    repeated rows are packed as often as they stand; a null doc_id is kept; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    bins = stored(rows.mapInArrow(_first_round(spec, capacity), _BINS))
    done = [bins.where(F.col("fill") >= capacity - slack)]
    left = bins.where(F.col("fill") < capacity - slack)
    count = left.count()
    while count > 1:
        groups = -(-count // group)
        dealt = left.withColumn("g", (F.rand(seed=count) * groups).cast("int") if groups > 1 else F.lit(0))
        bins = stored(dealt.groupBy("g").applyInArrow(_next_round(capacity), _BINS))
        now = bins.where(F.col("fill") < capacity - slack)
        emitted, n = bins.where(F.col("fill") >= capacity - slack), now.count()
        done.append(emitted)
        left, before, count = now, count, n
        if groups == 1 or n + emitted.count() > 0.998 * before:
            break
    for df in [*done[1:], left]:
        done[0] = done[0].union(df)
    named = stored(done[0].select(F.monotonically_increasing_id().alias("sequence_id"), "pieces"))
    return named.mapInArrow(_unpacked, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
