"""Hard negatives by a secondary sort: scores lie in (anchor, descending score, id) order, and a stream opens windows.

Anchors go out in blocks of bounded size, each against all rows. A task scores its rows with a block by one matrix
product and keeps, of each anchor, what the answer can need: first its best rows of the same label, then, when the
block's positives are known, the best rows inside each positive's window. These pairs, packed into keys that sort by
anchor, descending score and id, are repartitioned by anchor and sorted inside the partitions. A pass over the sorted
keys opens a window at each positive and hands each negative to the windows that it lies in; an anchor's pairs are
never held together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from joblode.llm._store import remove, scratch

POSITIVES, NEGATIVES = 5, 3
#: A negative's score is at least LOW and at most HIGH hundredths of its positive's.
LOW, HIGH = 50, 95
#: Components become floor(SCALE * x).
SCALE = 256
#: Bytes of the anchors' vectors in a block.
BLOCK = 16 << 20
#: Pairs that a task scores at once.
TILE = 1 << 20
_LEAST = np.iinfo(np.int64).min
_MOST = np.iinfo(np.int64).max


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """floor(SCALE * x) of each row's vector; shorter ones end in zeros."""
    sizes = np.asarray(pa.compute.list_value_length(column)).astype(np.int64)
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    width = int(sizes.max(initial=0)) if width is None else width
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row[at < width], at[at < width]] = flat[at < width]
    return out


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of x and y, which hold whole numbers."""
    bound = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * max(1, x.shape[1])
    if bound < 1 << 53:
        return (x @ y.T).astype(np.int64)
    if bound * max(100, LOW, HIGH) < 1 << 63:
        return x.astype(np.int64) @ y.astype(np.int64).T
    raise ValueError("scores don't fit into a long")


class Block:
    """Anchors with their vectors and, when known, the windows of their positives (low, high of each; none: high < low)."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.low = self.high = np.zeros((len(ids), 0), np.int64)


class _Best:
    """The ``keep`` best (score, then least id) of the pairs offered for each of many slots."""

    def __init__(self, slots: int, keep: int):
        self.keep = keep
        self.score, self.id = np.full((slots, keep), _LEAST), np.full((slots, keep), _MOST)
        self.row = np.full((slots, keep), -1)

    def wanted(self, slots: slice, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which pairs (rows x slots) would be among the best."""
        last, name = self.score[slots, -1], self.id[slots, -1]
        return (score > last) | ((score == last) & (ids[:, None] < name))

    def offer(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        touched = np.unique(slot)
        slot = np.concatenate([np.repeat(touched, self.keep), slot])
        score, ids, row = (np.concatenate([old[touched].ravel(), new]) for old, new in ((self.score, score), (self.id, ids), (self.row, row)))
        order = np.lexsort((row, ids, -1 - score, slot))  # -1 - x reverses the order of all longs
        slot = slot[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        order, slot, place = order[place < self.keep], slot[place < self.keep], place[place < self.keep]
        self.score[slot, place], self.id[slot, place], self.row[slot, place] = score[order], ids[order], row[order]


def _tiles(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, slice, np.ndarray]]:
    """ids, labels, vectors and numbers of some rows, a slice of the block's anchors, and their scores."""
    at, wide = 0, max(1, min(len(block.ids), 4096))
    high = max(1, TILE // wide)
    for batch in batches:
        ids, labels, vectors = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), block.vectors.shape[1])
        for i in range(0, len(ids), high):
            for a in range(0, len(block.ids), wide):
                some, rows = slice(a, min(a + wide, len(block.ids))), slice(i, i + high)
                yield ids[rows], labels[rows], vectors[rows], np.arange(at + i, at + min(i + high, len(ids))), some, _products(vectors[rows], block.vectors[some])
        at += len(ids)


def _same_label(shared, positives: int):
    """anchor (its number in the block), score, id, own (1: a row equal to the anchor) of each anchor's best rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        best = _Best(len(block.ids), positives + 1)
        equal: set[tuple[int, int]] = set()
        for ids, labels, vectors, number, some, score in _tiles(batches, block):
            r, a = np.nonzero((labels[:, None] == block.labels[some]) & best.wanted(some, score, ids))
            best.offer(a + some.start, score[r, a], ids[r], number[r])
            for i, j in zip(*np.nonzero((ids[:, None] == block.ids[some]) & (labels[:, None] == block.labels[some])), strict=True):
                if (vectors[i] == block.vectors[some.start + j]).all():
                    equal.add((int(some.start + j), int(number[i])))
        anchor, place = np.nonzero(best.row >= 0)
        row = best.row[anchor, place]
        own = np.fromiter(((x in equal) for x in zip(anchor.tolist(), row.tolist(), strict=True)), bool, len(row)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int32)), pa.array(best.score[anchor, place]), pa.array(best.id[anchor, place]), pa.array(own)], ["anchor", "score", "id", "own"])

    return run


def packed(anchor: np.ndarray, score: np.ndarray, kind: np.ndarray, ids: np.ndarray) -> pa.Array:
    """Keys whose bytes sort by anchor, descending score, kind and id."""
    sign = np.uint64(1 << 63)
    out = np.zeros(len(anchor), np.dtype([("anchor", ">u4"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")]))
    out["anchor"], out["score"] = anchor, ~(score.astype(np.int64).view(np.uint64) ^ sign)
    out["kind"], out["id"] = kind, ids.astype(np.int64).view(np.uint64) ^ sign
    return pa.Array.from_buffers(pa.binary(), len(out), [None, pa.py_buffer(np.arange(0, 21 * len(out) + 1, 21, dtype=np.int32)), pa.py_buffer(out.tobytes())])


def unpacked(keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sign = np.uint64(1 << 63)
    got = np.frombuffer(b"".join(keys.to_pylist()), np.dtype([("anchor", ">u4"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")]))
    number = lambda x: (x.astype(np.uint64) ^ sign).view(np.int64)
    return got["anchor"].astype(np.int64), number(~got["score"].astype(np.uint64)), got["kind"], number(got["id"])


def _in_windows(shared, negatives: int):
    """anchor, key of each anchor's best rows of other labels inside the window of one of its positives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        width = block.low.shape[1]
        best = [_Best(len(block.ids), negatives) for _ in range(width)]
        for ids, labels, _, number, some, score in _tiles(batches, block):
            other = labels[:, None] != block.labels[some]
            for p in range(width):
                r, a = np.nonzero(other & (score >= block.low[some, p]) & (score <= block.high[some, p]) & best[p].wanted(some, score, ids))
                if len(r):
                    best[p].offer(a + some.start, score[r, a], ids[r], number[r])
        # a row that several windows want goes out once
        found = [np.column_stack([a, b.score[a, k], b.id[a, k], b.row[a, k]]) for b in best for a, k in [np.nonzero(b.row >= 0)]]
        got = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 4), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(got[:, 0].astype(np.int32)), packed(got[:, 0], got[:, 1], np.ones(len(got), np.uint8), got[:, 2])], ["anchor", "key"])

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        anchor, score, ids = (c.to_numpy() for c in batch.columns)
        yield pa.RecordBatch.from_arrays([batch.column(0), packed(anchor, score, np.zeros(len(anchor), np.uint8), ids)], ["anchor", "key"])


def _streamed(shared, negatives: int, low: int, high: int):
    """Sorted keys to ranked negatives. At one score positives come first, since a window may hold its positive's score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: np.ndarray = shared.value.ids
        now, windows = -1, []
        for batch in batches:
            out: list[tuple[int, int, int, int, int, int]] = []
            for anchor, score, kind, name in zip(*(x.tolist() for x in unpacked(batch.column(1))), strict=True):
                if anchor != now:
                    now, windows = anchor, []
                if kind == 0:
                    windows.append([name, score, 0])
                else:
                    for w in windows:
                        if w[2] < negatives and low * w[1] <= 100 * score <= high * w[1]:
                            w[2] += 1
                            out.append((int(names[anchor]), w[0], w[2], name, w[1], score))
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 2 else pa.int64()) for i, c in enumerate(cols)], ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return run


def usable(rows: DataFrame) -> DataFrame:
    """id, label (longs), vector of the rows that take part, and whether each is an anchor."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = rows.select(F.col("id").cast("long"), F.col("label").cast("long"), F.col("vector").cast("array<double>"), F.coalesce("anchor", F.lit(False)).alias("anchor"))
    return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", fine))


def _load(rows: DataFrame, block: int, blocks: int) -> Block:
    got = rows.where(F.col("anchor") & (F.pmod(F.xxhash64("id"), F.lit(blocks)) == block)).select("id", "label", "vector").toArrow().combine_chunks()
    ids, labels = (got.column(i).to_numpy().astype(np.int64) for i in (0, 1))
    column = got.column(2).combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    order = np.argsort(ids, kind="stable")
    return Block(ids[order], labels[order], _matrix(column)[order])


def mine(rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block_bytes: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: the hard negatives of each anchor.

    rows: id, label, vector (array of numbers), anchor (boolean). A score is the inner product of floor(256 * x) over
    the components x. An anchor's positives are its ``positives`` best other rows of its label, a positive's
    negatives the ``negatives`` best rows of other labels with low * positive_score <= 100 * negative_score <= high *
    positive_score; higher scores come first, ties by smaller id.

    Rows without an id, a label or a vector, or with a null or non-finite component, take no part. Shorter vectors end
    in zeros. Rows are told apart even where they repeat: a copy of an anchor is another row, and an anchor that
    stands twice is answered twice. Fewer positives or negatives than wanted are returned as they are; an empty table
    gives an empty one. Scores that don't fit into a long, a hundredfold, fail the job.
    """
    if not 0 <= low <= 100 or not 0 <= high <= 100:
        raise ValueError("low and high are hundredths, from 0 to 100")
    spark = rows.sparkSession
    sc = spark.sparkContext
    all_rows = usable(rows)
    size = all_rows.where("anchor").agg(F.sum(F.size("vector").cast("long") * 8 + 16)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    work, out = scratch(spark, "negatives"), scratch(spark, "hard")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    scored = all_rows.select("id", "label", "vector")
    for b in range(blocks):
        block = _load(all_rows, b, blocks)
        shared = sc.broadcast(block)
        near = scored.mapInArrow(_same_label(shared, positives), "anchor int, score long, id long, own int")
        # one row that equals the anchor is the anchor itself
        of_anchor = W.partitionBy("anchor").orderBy(F.desc("score"), "id", F.desc("own"))
        ranked = near.select("*", F.row_number().over(of_anchor).alias("n")).where(F.col("n") <= positives + 1)
        ranked = ranked.select("*", F.row_number().over(W.partitionBy("anchor", "own").orderBy("n")).alias("same"))
        ranked = ranked.where("own = 0 or same > 1").select("anchor", "score", "id", F.row_number().over(W.partitionBy("anchor").orderBy("n")).alias("n")).where(F.col("n") <= positives)
        path = f"{work}/positives-{b}"
        ranked.write.parquet(path)
        chosen = spark.read.schema("anchor int, score long, id long, n int").parquet(path)
        got = chosen.toArrow()  # a few rows for each anchor of the block
        anchor, score, place = (got.column(c).to_numpy() for c in ("anchor", "score", "n"))
        known = Block(block.ids, block.labels, block.vectors)
        known.low, known.high = np.ones((len(block.ids), positives), np.int64), np.zeros((len(block.ids), positives), np.int64)
        known.low[anchor, place - 1], known.high[anchor, place - 1] = -((-low * score) // 100), high * score // 100
        windows = sc.broadcast(known)
        pairs = scored.mapInArrow(_in_windows(windows, negatives), "anchor int, key binary").union(chosen.select("anchor", "score", "id").mapInArrow(_keys, "anchor int, key binary"))
        pairs.repartition("anchor").sortWithinPartitions("key").mapInArrow(_streamed(windows, negatives, low, high), schema).write.mode("append").parquet(out)
        shared.destroy()
        windows.destroy()
    remove(spark, work)
    return spark.read.schema(schema).parquet(out)
