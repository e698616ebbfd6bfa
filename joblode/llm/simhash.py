"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, then the Hamming check."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblode.llm._graph import components
from joblode.llm._store import remove, scratch, stored
from joblode.llm._words import slices

#: The 64 bits in five blocks; fingerprints at distance 2 or less agree on three of them.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
RADIUS = 2
#: A bucket with more distinct fingerprints than this is linked through one-bit neighbours, not pair by pair.
DENSE = 64


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of the shingles of a text (XXH64, seed 42, repeats included)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    end = start + size
    k = min(shingle, len(words))
    digest, count = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    begin, stop = start[: len(words) - k + 1].tolist(), end[k - 1 :].tolist()
    for i in range(0, len(begin), 1 << 15):
        part = list(zip(begin[i : i + (1 << 15)], stop[i : i + (1 << 15)], strict=True))
        h = np.fromiter((digest(flat[a:b], 42) for a, b in part), np.uint64, len(part))
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * count > len(begin)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in slices(batch, "text"):
            got = np.fromiter((fingerprint(t) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the bits as a signed long) of each row."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _block(i: int) -> Column:
    at, width = BLOCKS[i]
    return F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1))


def links(nodes: DataFrame, under: str | None = None) -> DataFrame:
    """u, v: enough links (distance 2 or less) between distinct fingerprints to connect whatever links.

    nodes: node long, fp long, one row for each distinct fingerprint. Buckets agree on three of five blocks.
    Small buckets are joined pair by pair and verified. In a dense bucket each fingerprint is keyed by itself
    and by each fingerprint one bit away outside the shared blocks; two fingerprints share such a key exactly
    when they differ in at most two bits, so linking each to the least node of its keys loses no connection and
    needs no pairs.
    """
    keyed = []
    for n, kept in enumerate(combinations(range(len(BLOCKS)), len(BLOCKS) - RADIUS)):
        value, used = F.lit(n).cast("long"), 0
        for i in kept:
            value, used = F.shiftleft(value, BLOCKS[i][1]).bitwiseOR(_block(i)), used + BLOCKS[i][1]
        free = [b for i, (at, width) in enumerate(BLOCKS) if i not in kept for b in range(at, at + width)]
        keyed.append(F.struct(value.alias("key"), F.lit(sum(1 << b for b in free) - (1 << 64 if 63 in free else 0)).cast("long").alias("free")))
    rows = nodes.select("node", "fp", F.explode(F.array(*keyed)).alias("k")).select("node", "fp", "k.key", "k.free")
    size = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    rows = stored(rows.join(size, "key"), under)
    small, dense = rows.where(F.col("size") <= DENSE), rows.where(F.col("size") > DENSE)
    a, b = small.select("key", F.col("node").alias("u"), F.col("fp").alias("x")), small.select("key", F.col("node").alias("v"), F.col("fp").alias("y"))
    pairs = a.join(b, "key").where((F.col("u") > F.col("v")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= RADIUS)).select("u", "v")
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)])
    near = dense.select("node", "fp", F.explode(F.filter(flips, lambda m: (m == 0) | (m.bitwiseAND(F.col("free")) != 0))).alias("m"), "key")
    near = near.select("node", "key", F.col("fp").bitwiseXOR(F.col("m")).alias("probe"))
    hub = near.groupBy("key", "probe").agg(F.min("node").alias("v"), F.count("*").alias("n")).where("n > 1")
    stars = near.join(hub, ["key", "probe"]).where("node <> v").select(F.col("node").alias("u"), "v")
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, copies (rows of the fingerprint), component_id of each row.

    Rows with equal fingerprints are one node, so a third of all rows may be copies.
    component_id is the least doc_id that links of at most two differing bits reach, itself included.
    Null or empty texts have fingerprint zero and link like any other; a null doc_id is kept and takes part
    by its text. Repeated rows give repeated rows; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    work = scratch(spark, "simhash")
    fps = stored(fingerprints(docs), work)
    # fingerprints are the nodes, so a text without an id links like any other
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), work)
    comp = stored(components(links(nodes.select(F.col("fp").alias("node"), "fp"), work), work), work)
    named = nodes.join(comp, nodes["fp"] == comp["node"], "left").select("fp", "least", "copies", F.coalesce("component", "fp").alias("c"))
    first = named.groupBy("c").agg(F.min("least").alias("component_id"))
    out = stored(fps.join(named.join(first, "c").select("fp", "copies", "component_id"), "fp").select("doc_id", "fp", "copies", "component_id"))
    remove(spark, work)
    return out
