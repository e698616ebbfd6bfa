"""Near copies by SimHash: blocks of a long fingerprint, a join on blocks, the Hamming check; exact similarity settles them.

Operator 8's method on five-word shingles. Sets of similarity 0.8 differ in 15 % of their fingerprint's bits, however long
it is, so 128 blocks of 16 bits stand for operator 8's five of 12 or 13, and what meets in a block is a candidate only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblode.llm._graph import components
from joblode.llm._store import free_name, remove, scratch, stored
from joblode.llm._words import Text, Words, mixed, rolling, slices

SHINGLE = 5
#: Texts whose shingle sets have a Jaccard similarity of NEAR[0] / NEAR[1] or more are near copies.
NEAR = (4, 5)
#: The fingerprint in blocks. Sets of similarity 0.8 agree in a bit with a chance of 0.85, so they share no block at all with
#: one of about 7e-5; sets of four and five shingles, whose bits tie more often, with one of 9e-3.
BLOCKS, WIDTH = 128, 16
BITS = BLOCKS * WIDTH
#: Bits in which near copies may differ: of the first 128, and of all. 0.8 lies near 19 and 310 (for four and five shingles
#: near 24 and 384), unlike texts near 64 and 1024.
SHORT, RADIUS = 40, 440
#: A bucket with more nodes than this is compared by growing clusters from their first node, not by neighbours' distance.
DENSE = 256
#: A bucket with more nodes than this is one group of candidates.
LARGE = 1 << 16
#: Nodes of one tile; a larger group of candidates is compared tile by tile.
TILE = 2048
#: Shingles of the nodes that one task compares on average.
SHARD = 4_000_000
_LANES = np.uint64(0x0101010101010101)


def _shingles(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row's shingles (ASCII letters in lower case), sorted, and where each row's begin."""
    text = Text(column)
    upper = (text.data >= 65) & (text.data <= 90)
    text.data = np.where(upper, text.data + 32, text.data).astype(np.uint8)
    words = Words(text)
    count = np.diff(words.first)
    h = rolling(words.hash, shingle)
    whole = words.row[: len(h)] == words.row[shingle - 1 :] if len(h) else np.zeros(0, bool)
    value, row = [mixed(h[whole], 23)], [words.row[: len(h)][whole]]
    # a shorter text is one shingle
    for r in np.flatnonzero((count > 0) & (count < shingle)).tolist():
        value.append(mixed(rolling(words.hash[words.first[r] : words.first[r + 1]], int(count[r])), 24 + int(count[r])))
        row.append(np.array([r]))
    value, row = np.concatenate(value), np.concatenate(row)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(text.n + 1))


def _names(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each row's set; equal sets are one node."""
    return np.fromiter((xxhash.xxh3_64_intdigest(value[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)), np.uint64, len(at) - 1).view(np.int64)


def _fingerprints(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """rows x BITS / 64: bit i is 1 where over half of a row's shingles have it; rows without shingles are left out."""
    start, size = at[:-1][np.diff(at) > 0], np.diff(at)[np.diff(at) > 0]
    out = np.empty((len(start), BITS // 64), np.uint64)
    if not len(start):
        return out
    # eight counts stand in the bytes of a word, so at most 255 shingles are added at once
    pieces = -(-size // 255)
    first = np.cumsum(pieces) - pieces
    piece = np.repeat(start, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    for i in range(BITS // 64):
        h = mixed(value, 1001 + i)
        bits = np.empty((len(start), 8, 8), np.uint8)
        for j in range(8):
            counts = np.add.reduceat((h >> np.uint64(j)) & _LANES, piece).view(np.uint8).reshape(-1, 8)
            bits[:, :, j] = 2 * np.add.reduceat(counts, first, axis=0, dtype=np.int64) > size[:, None]
        out[:, i] = np.packbits(bits.reshape(len(start), 64), axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _per_row(some: np.ndarray, rows: int, fp: np.ndarray) -> pa.Array:
    """The fingerprints as bytes, null for rows without one."""
    cells: list[bytes | None] = [None] * rows
    for i, f in zip(some.tolist(), fp, strict=True):
        cells[i] = f.tobytes()
    return pa.array(cells, pa.binary())


def _signed(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                value, at = _shingles(part.column(1), shingle)
                fp = _per_row(np.flatnonzero(np.diff(at) > 0), part.num_rows, _fingerprints(value, at))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(_names(value, at)), fp], ["doc_id", "k1", "k2", "node", "fp"])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                value, at = _shingles(part.column(1), shingle)
                yield pa.RecordBatch.from_arrays([pa.array(_names(value, at)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(value.view(np.int64)))], ["node", "set"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, node, x, y: a row for each block of a node's fingerprint, with the fingerprint's first 128 bits."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            node, fp = part.column(0).to_numpy(), np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint64).reshape(part.num_rows, -1)
            key = fp.view(np.uint16).astype(np.int64) | (np.arange(BLOCKS, dtype=np.int64) << WIDTH)
            cells = (key.ravel(), *(np.repeat(c, BLOCKS) for c in (node, fp[:, 0].view(np.int64), fp[:, 1].view(np.int64))))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], ["key", "node", "x", "y"])


def _close(x: np.ndarray, y: np.ndarray, i, j) -> np.ndarray:
    """The Hamming check on the first 128 bits."""
    return np.bitwise_count(x[i] ^ x[j]).astype(np.int64) + np.bitwise_count(y[i] ^ y[j]) <= SHORT


def _clusters(key: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each row, sorted by key, the first row that links of the Hamming check reach within its bucket."""
    n = len(key)
    label = np.arange(n)
    edge = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), n)
    size = np.diff(edge)
    for a, b in zip(edge[:-1][size > DENSE].tolist(), edge[1:][size > DENSE].tolist(), strict=True):
        left = np.arange(a, b)
        while len(left):
            first, left = left[0], left[1:]
            grown = [first]
            while grown and len(left):
                near = _close(x, y, grown.pop(), left)
                label[left[near]] = first
                grown += left[near].tolist()
                left = left[~near]
    at = np.flatnonzero(np.repeat(size <= DENSE, size))
    end = np.repeat(edge[1:], size)
    u, v, step = [], [], 1
    while len(at := at[at + step < end[at]]):
        near = at[_close(x, y, at, at + step)]
        u.append(near)
        v.append(near + step)
        step += 1
    if u and len(u := np.concatenate(u)):
        v = np.concatenate(v)
        while (label[u] != label[v]).any():
            least = np.minimum(label[u], label[v])
            np.minimum.at(label, u, least)
            np.minimum.at(label, v, least)
            label = label[label]
    return label


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, hub of the nodes that meet others in a block and pass the Hamming check, rows sorted by key and node: hub is the
    first node that they reach in the bucket. Buckets come one after the other; of one at most LARGE rows are held."""
    held: list[np.ndarray] = [np.zeros(0, np.int64)] * 4
    hub = (-1, 0)  # a bucket too large to be compared here, and its first node

    def told(node: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(first)], ["node", "hub"])

    def compared(key, node, x, y):
        label = _clusters(key, x.view(np.uint64), y.view(np.uint64))
        some = np.bincount(label, minlength=len(label))[label] > 1
        return told(node[some], node[label[some]])

    for batch in batches:
        if not batch.num_rows:
            continue
        held = [np.concatenate((a, c.to_numpy())) for a, c in zip(held, batch.columns, strict=True)]
        if held[0][0] == hub[0]:
            n = np.searchsorted(held[0], hub[0], "right")
            yield told(held[1][:n], np.full(n, hub[1]))
            held = [c[n:] for c in held]
        if not len(held[0]):
            continue
        n = np.searchsorted(held[0], held[0][-1])
        if n:
            yield compared(*(c[:n] for c in held))
            held = [c[n:] for c in held]
        if len(held[0]) > LARGE:
            hub = (held[0][0], held[1][0])
            yield told(held[1], np.full(len(held[1]), hub[1]))
            held = [c[:0] for c in held]
    if len(held[0]):
        yield compared(*held)


class _Labels:
    """Components of the nodes of a group, as labels that join."""

    def __init__(self, component: np.ndarray):
        self.of = np.unique(component, return_inverse=True)[1]

    def join(self, x: int, y: int) -> bool:
        a, b = self.of[x], self.of[y]
        if a != b:
            self.of[self.of == b] = a
        return a != b


def _linked(value: np.ndarray, at: np.ndarray, x: int, others: np.ndarray) -> np.ndarray:
    """Those of the others whose sets are near that of x; sets are sorted slices of value."""
    own, sizes = value[at[x] : at[x + 1]], at[others + 1] - at[others]
    every = np.concatenate([value[at[j] : at[j + 1]] for j in others.tolist()])
    place = np.minimum(np.searchsorted(own, every), len(own) - 1)
    both = np.add.reduceat((own[place] == every).astype(np.int64), np.cumsum(sizes) - sizes)
    return others[both * (NEAR[0] + NEAR[1]) >= (len(own) + sizes) * NEAR[0]]


def _alike(table: pa.Table) -> pa.Table:
    """u, v: links between components of a group's nodes, as many as connect whatever near copies connect.

    Pairs of one component need no look; of the others, the Hamming check of whole fingerprints leaves out those far below
    the similarity, and the sets settle the rest.
    """
    group, tile, first, second = (table.column(c).to_numpy() for c in ("hub", "tile", "first", "second"))
    node, comp = table.column("node").to_numpy(), table.column("c").to_numpy()
    sets = table.column("set").combine_chunks()
    sets = sets.chunk(0) if isinstance(sets, pa.ChunkedArray) else sets
    value, at = sets.flatten().to_numpy().view(np.uint64), np.concatenate(([0], np.cumsum(np.asarray(sets.value_lengths()).astype(np.int64))))
    fp = np.frombuffer(b"".join(table.column("fp").to_pylist()), np.uint64).reshape(len(node), -1)
    size = np.diff(at)
    order = np.lexsort((size, second, first, group))
    new = np.ones(len(order), bool)
    for c in (group, first, second):
        new[1:] &= c[order][1:] == c[order][:-1]
    edge = np.append(np.flatnonzero(~new | (np.arange(len(order)) == 0)), len(order))
    u, v = [], []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        i = order[a:b]  # by size: the sets that are large enough, but not too large, stand next to one another
        far = np.searchsorted(size[i] * NEAR[0], size[i] * NEAR[1], "right").tolist()
        labels, s, t = _Labels(comp[i]), fp[i], tile[i]
        across = first[i[0]] != second[i[0]]
        for x in range(len(i) - 1):
            j = x + 1 + np.flatnonzero((labels.of[x + 1 : far[x]] != labels.of[x]) & ((t[x + 1 : far[x]] != t[x]) | (not across)))
            j = j[np.bitwise_count(s[j] ^ s[x]).sum(1, dtype=np.int64) <= RADIUS]
            if len(j):
                local = {k: n for n, k in enumerate(i[j].tolist())}
                for k in _linked(value, at, i[x], i[j]).tolist():
                    if labels.join(x, int(j[local[k]])):
                        u.append(node[i[x]])
                        v.append(node[k])
    return pa.table({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs u, v whose sets are near."""
    x, y = sets.select(F.col("node").alias("u"), F.col("set").alias("x")), sets.select(F.col("node").alias("v"), F.col("set").alias("y"))
    a, b, both = F.size("x"), F.size("y"), F.size(F.array_intersect("x", "y"))
    less = (F.least(a, b) * NEAR[1] >= F.greatest(a, b) * NEAR[0])
    return pairs.join(x, "u").join(y, "v").where(less & (both * (NEAR[0] + NEAR[1]) >= (a + b) * NEAR[0])).select("u", "v")


def _tiles(named: DataFrame, tile: int) -> DataFrame:
    """hub, node, c with tile, first, second: each group of more than ``tile`` nodes as pairs of tiles, once each."""
    many = named.groupBy("hub").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    rows = named.join(many, "hub").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return rows.select("hub", "node", "c", "tile", F.least("tile", "other").alias("first"), F.greatest("tile", "other").alias("second"))


def _grouped(docs: DataFrame, shingle: int, tile: int, work: str) -> DataFrame:
    """doc_id, k1, k2 (128 bits of the text), c of each row: rows with one c are linked. Written below ``work``."""
    spark = docs.sparkSession
    keep = lambda df: stored(df, work)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("k2"), text).alias("k2"))
    signed = keep(rows.mapInArrow(_signed(shingle), "doc_id long, k1 long, k2 long, node long, fp binary"))
    nodes = keep(signed.where("fp is not null").groupBy("node").agg(F.first("fp").alias("fp")))
    keyed = nodes.mapInArrow(_blocks, "key long, node long, x long, y long")
    met = keep(keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_met, "node long, hub long").distinct())
    wanted = keep(met.select("node").distinct())
    ids = signed.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    texts = rows.join(ids.where("doc_id is not null"), "doc_id", "left_semi").union(rows.where("doc_id is null")).select("doc_id", "text")
    sets = keep(texts.mapInArrow(_sets(shingle), "node long, set array<long>").join(wanted, "node", "left_semi").dropDuplicates(["node"]))
    links = keep(_verified(met.where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v")), sets))
    named = met.join(components(links, work), "node", "left").select("hub", "node", F.coalesce("component", "node").alias("c"))
    open_hubs = named.groupBy("hub").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b").select("hub")
    named = keep(_tiles(named.join(open_hubs, "hub", "left_semi"), tile).join(sets, "node").join(nodes, "node"))
    amount = named.agg(F.sum(F.size("set"))).first()[0] or 0
    shards = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), amount // SHARD)
    found = keep(named.withColumn("shard", F.pmod(F.xxhash64("hub", "first", "second"), F.lit(shards))).groupBy("shard").applyInArrow(_alike, "u long, v long").distinct())
    comp = components(links.union(found), work)
    return keep(signed.select("doc_id", "k1", "k2", "node").join(comp, "node", "left").select("doc_id", "k1", "k2", F.coalesce("component", "node").alias("c")))


def near_copies(docs: DataFrame, shingle: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """doc_id, component_id of each row: the least doc_id that links of near copies reach.

    Rows with equal shingle sets are one node. Candidates share a block of their fingerprints and pass the Hamming check.
    Each node is first compared with the least node (hub) that its candidates reach; a hub whose nodes are still in different components has them compared by each
    other, in tiles of bounded size, so a large group of near copies needs few pairs and links between components are
    still found. Texts without words are copies of each other. A null doc_id takes part by its text.
    """
    spark = docs.sparkSession
    work = scratch(spark, "near")
    rows = _grouped(docs, shingle, tile, work)
    out = stored(rows.join(rows.groupBy("c").agg(F.min("doc_id").alias("component_id")), "c").select("doc_id", "component_id"))
    remove(spark, work)
    return out


def first_of_each(docs: DataFrame, shingle: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """The rows of docs, one for each component: that with its least doc_id (none: last), then the least hash of its text;
    columns unchanged.

    Rows go by their own text, so unlike rows that share a doc_id, or have none, stay. Of rows that repeat both doc_id
    and text one stays, that with the least hash of all columns.
    """
    spark = docs.sparkSession
    work = scratch(spark, "near")
    rows = _grouped(docs, shingle, tile, work).groupBy("c", "doc_id", "k1", "k2").agg(F.count("*").alias("n"))
    first = rows.groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "k1", "k2", "n")).alias("r"))
    found = [free_name(docs, f"{c}_first") for c in ("id", "k1", "k2", "n")]
    first = stored(first.select(*[F.col(f"r.{c}").alias(n) for c, n in zip(("doc_id", "k1", "k2", "n"), found, strict=True)]))
    remove(spark, work)
    own = [free_name(docs, f"{c}_own") for c in ("id", "k1", "k2")]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumns(dict(zip(own, (F.col("doc_id").cast("long"), F.xxhash64(text), F.xxhash64(F.lit("k2"), text)), strict=True)))
    same = F.col(own[0]).eqNullSafe(F.col(found[0])) & (F.col(own[1]) == F.col(found[1])) & (F.col(own[2]) == F.col(found[2]))
    kept = keyed.join(first, same)
    once = kept.where(F.col(found[3]) == 1).select(*docs.columns)
    row = F.min_by(F.struct(*[docs[c].alias(f"_{i}") for i, c in enumerate(docs.columns)]), F.xxhash64(*[docs[c] for c in docs.columns]))
    again = kept.where(F.col(found[3]) > 1).groupBy(*[F.col(n) for n in found]).agg(row.alias("r")).select(*[F.col(f"r._{i}").alias(c) for i, c in enumerate(docs.columns)])
    return once.union(again)
