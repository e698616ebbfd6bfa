"""Exact copies by an index of cuckoo filters: what the filters have not seen is new, hits are compared with content.

Digests are dealt to shards, each with a filter of the live ones. Inserting a batch

1. writes its texts without white space, with their digests; copies inside a task's batch of rows are compared there
   and written once, so a text of very many rows ships few of them;
2. asks and fills each shard's filter, digest by digest: a digest that it does not hold is new and is never looked at
   again, the others are hits;
3. tells hits that hold no stored digest (false ones) from the rest and adds them to the filter as well.

A filter that is full is built anew, with room for all, from the digests stored for its shard. Deleting documents removes the
digests that no live row has any more. Copies are the rows of hit digests whose content is equal: contents meet by digest,
salted, so that the rows of a hot text are first joined by many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joblode.llm._store import remove, scratch, stored
from joblode.llm._words import slices
from joblode.llm.cuckoo import Filter, buckets_for

#: Characters that do not count.
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes of SHA-256 that tell digests apart; texts of one digest are compared.
DIGEST = 16
#: Live digests that a shard is meant to hold.
SHARD = 1_000_000
SALTS = 64
#: Bytes of text whose copies a task looks for at once.
PART = 16 << 20

_CONTENT = "shard int, digest binary, sha binary, text string, row long, members array<struct<doc_id:long,chars:long>>"
_FILTERS = "shard int, buckets int, blob binary"
_FOUND = "shard int, digest binary, added boolean, buckets int, blob binary"


def _keys(digests: list[bytes]) -> np.ndarray:
    """64 bits of each digest."""
    return np.frombuffer(b"".join(d[:8].rjust(8, b"\0") for d in digests), np.uint64)


def _digested(shards: int, batch_number: int, digest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = batch_number << 52 | TaskContext.get().partitionId() << 32
        for batch in (part for whole in batches for part in slices(whole, "text", PART)):
            ids, chars = batch.column(0).to_pylist(), pa.compute.utf8_length(batch.column(1)).to_pylist()
            members: dict[bytes, list[dict]] = {}
            for i, n, text in zip(ids, chars, batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                members.setdefault(text.translate(None, WHITE), []).append({"doc_id": i, "chars": n})
            sha = [hashlib.sha256(t).digest() for t in members]
            names = [s[:digest] for s in sha]
            shard = [int.from_bytes(s[-4:], "little") % shards for s in names]
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("chars", pa.int64())]))
            columns = [pa.array(shard, pa.int32()), pa.array(names, pa.binary()), pa.array(sha, pa.binary()), pa.array(list(members), pa.binary()).cast(pa.string()), pa.array(range(row, row + len(sha)), pa.int64()), pa.array(list(members.values()), kind)]
            row += len(sha)
            yield pa.RecordBatch.from_arrays(columns, ["shard", "digest", "sha", "text", "row", "members"])

    return run


def _found(shard: int, digests: list[bytes], added: list[bool], buckets: int, blob: bytes | None) -> pa.Table:
    """Hits of a shard with whether they were added, and one row with its filter (no blob: it lacks room)."""
    n = len(digests)
    columns = ([shard] * (n + 1), [*digests, None], [*added, None], [None] * n + [buckets], [None] * n + [blob])
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.bool_(), pa.int32(), pa.binary()), strict=True)], ["shard", "digest", "added", "buckets", "blob"])


def _opened(filters: pa.Table, least: int) -> Filter:
    if not filters.num_rows:
        return Filter(least)
    return Filter(filters.column("buckets")[0].as_py(), filters.column("blob")[0].as_py())


def _inserted(least: int):
    def run(filters: pa.Table, arrivals: pa.Table) -> pa.Table:
        if not arrivals.num_rows:
            return _found(filters.column("shard")[0].as_py(), [], [], filters.column("buckets")[0].as_py(), filters.column("blob")[0].as_py())
        # a fixed order, so a task that runs again gives the same filter
        shard, digests = arrivals.column("shard")[0].as_py(), sorted(arrivals.column("digest").to_pylist())
        index = _opened(filters, least)
        held = int((index.table != 0).sum())
        added, room = index.add_new(_keys(digests))
        if not room:
            return _found(shard, [], [], max(2 * index.buckets, buckets_for(held + len(set(digests)))), None)
        own = {d for d, new in zip(digests, added.tolist(), strict=True) if new}
        hits = sorted({d for d, new in zip(digests, added.tolist(), strict=True) if not new})
        return _found(shard, hits, [d in own for d in hits], index.buckets, index.table.tobytes())

    return run


def _changed(add: bool):
    """Filters with digests added or removed."""

    def run(filters: pa.Table, digests: pa.Table) -> pa.Table:
        shard = filters.column("shard")[0].as_py()
        index, keys = _opened(filters, 1), _keys(sorted(digests.column("digest").to_pylist()))
        if not add:
            index.remove(keys)
        elif not index.add(keys):
            return _found(shard, [], [], 2 * index.buckets, None)
        return _found(shard, [], [], index.buckets, index.table.tobytes())

    return run


def _rebuilt(wanted: pa.Table, keys: pa.Table) -> pa.Table:
    """The filter of a shard with the wanted number of buckets (or as many more as it takes) from its stored digests."""
    buckets, own = wanted.column("buckets")[0].as_py(), _keys(sorted(keys.column("digest").to_pylist()))
    while not (index := Filter(buckets)).add(own):
        buckets *= 2
    return _found(wanted.column("shard")[0].as_py(), [], [], buckets, index.table.tobytes())


def _by_shard(left: DataFrame, right: DataFrame, f) -> DataFrame:
    return left.groupBy("shard").cogroup(right.groupBy("shard")).applyInArrow(f, _FOUND)


def _best(members: str, row: str) -> Column:
    """What the row that stays has most of: characters, then the smallest doc_id; ties: any one of them, always the same."""
    rank = lambda m, i: F.struct(m["chars"].alias("chars"), m["doc_id"].isNotNull().alias("named"), F.bitwise_not(F.coalesce(m["doc_id"], F.lit(0))).alias("id"), F.col(row).alias("row"), i.cast("long").alias("at"))
    return F.array_max(F.transform(members, rank))


class Index:
    """Live documents with their digests, contents and filters, in a folder that driver and executors share.

    Batches are appended, filters are written anew (two bytes and a bit for a digest); readers of an older state are not
    disturbed. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, shards: int | None = None, buckets: int | None = None, digest: int = DIGEST):
        """buckets: of a new shard's filter (None: as the first batch needs)."""
        self.spark, self.folder, self.shards, self.buckets, self.digest = spark, folder, shards, buckets, digest
        self.batches = 0
        self.filters = spark.createDataFrame([], _FILTERS)
        self.removed: DataFrame | None = None
        self.hits: DataFrame | None = None

    def _content(self, upto: int | None = None) -> DataFrame | None:
        n = self.batches if upto is None else upto
        return self.spark.read.schema(_CONTENT).parquet(*[f"{self.folder}/content-{i}" for i in range(n)]) if n else None

    def _live(self, content: DataFrame) -> DataFrame:
        """Rows of content without deleted members; those whose members are all deleted are gone."""
        if self.removed is None:
            return content
        each = content.withColumn("m", F.explode("members")).withColumn("batch", F.shiftrightunsigned("row", 52))
        gone = self.removed.select(F.col("doc_id").alias("gone"), "before")
        each = each.join(gone, F.col("m.doc_id").eqNullSafe(F.col("gone")) & (F.col("batch") < F.col("before")), "left_anti")
        # rows of one text stay apart; each is told from the others by its member's place
        return each.groupBy("row").agg(*[F.first(c).alias(c) for c in ("shard", "digest", "sha", "text")], F.sort_array(F.collect_list("m")).alias("members")).select(*content.columns)

    def _settled(self, found: DataFrame, keys: DataFrame) -> DataFrame:
        """The filters among found, those that lack room built anew from the stored digests."""
        full = found.where("digest is null and blob is null").select("shard", "buckets")
        done = found.where("blob is not null").select("shard", "buckets", "blob")
        if full.isEmpty():
            return done
        return done.union(_by_shard(full, keys.join(full, "shard", "left_semi"), _rebuilt).select("shard", "buckets", "blob"))

    def insert(self, docs: DataFrame) -> None:
        """Add the rows of docs (doc_id, text)."""
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        n = self.batches
        if self.shards is None:
            self.shards = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // SHARD + 1)
        rows.mapInArrow(_digested(self.shards, n, self.digest), _CONTENT).write.parquet(f"{self.folder}/content-{n}")
        self.batches = n + 1
        old = self._content(n)
        keys = None if old is None else self._live(old).select("shard", "digest").distinct()
        arrivals = self.spark.read.schema(_CONTENT).parquet(f"{self.folder}/content-{n}").select("shard", "digest")
        least = self.buckets
        if least is None:
            most = arrivals.groupBy("shard").count().agg(F.max("count")).first()[0]
            least = buckets_for(most or 1)
        before = arrivals.limit(0) if keys is None else keys
        filters, todo, kept, hits = self.filters, arrivals, [], []
        while True:
            found = stored(_by_shard(filters, todo, _inserted(least)), self.folder)
            hits.append(found.where("digest is not null").select("shard", "digest", "added"))
            kept.append(found.where("blob is not null").select("shard", "buckets", "blob"))
            full = found.where("digest is null and blob is null").select("shard", "buckets")
            if full.isEmpty():
                break
            # a shard without room starts this batch again, with a larger filter of what was stored before it
            filters = stored(_by_shard(full, before.join(full, "shard", "left_semi"), _rebuilt).select("shard", "buckets", "blob"), self.folder)
            todo = arrivals.join(full, "shard", "left_semi")
        self.filters = stored(reduce(DataFrame.union, kept), self.folder)
        hits = stored(reduce(DataFrame.union, hits), self.folder)
        unknown = hits.where("not added").select("shard", "digest")
        unknown = unknown.join(before.select("digest"), "digest", "left_anti").select("shard", "digest")
        self._change(unknown, True)
        self.hits = hits.select("digest") if self.hits is None else self.hits.union(hits.select("digest"))

    def _change(self, digests: DataFrame, add: bool) -> None:
        digests = stored(digests, self.folder)
        if digests.isEmpty():
            return
        touched = digests.select("shard").distinct()
        found = stored(_by_shard(self.filters.join(touched, "shard", "left_semi"), digests, _changed(add)), self.folder)
        keys = self._live(self._content()).select("shard", "digest").distinct()
        self.filters = stored(self.filters.join(touched, "shard", "left_anti").union(self._settled(found, keys)), self.folder)

    def delete(self, ids: DataFrame) -> None:
        """Remove the rows with these doc_ids (null: those without one) that were inserted before; unknown ones are fine."""
        gone = stored(ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("before", F.lit(self.batches)), self.folder)
        content = self._content()
        if content is None:
            return
        each = self._live(content).withColumn("m", F.explode("members"))
        mine = each.join(gone, each["m.doc_id"].eqNullSafe(gone["doc_id"]), "left_semi").select("shard", "digest").distinct()
        mine = stored(mine, self.folder)
        self.removed = gone if self.removed is None else self.removed.union(gone)
        left = self._live(content).join(mine, "digest", "left_semi").select("digest").distinct()
        self._change(mine.join(left, "digest", "left_anti").select("shard", "digest"), False)

    def groups(self) -> DataFrame:
        """doc_id, keep_id, group_size, kept, text_sha256 of each live row.

        Rows are copies if their texts without white space are equal. Rows of a digest that never was a hit are copies only
        inside their own batch of rows, where they were compared.
        """
        content = self._content()
        if content is None:
            return self.spark.createDataFrame([], "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string")
        rows = self._live(content).withColumns({"best": _best("members", "row"), "n": F.size("members").cast("long")})
        hits = stored(self.hits.distinct(), self.folder)
        again = rows.join(hits, "digest", "left_semi").select("digest", "text", "n", "best", F.pmod("row", F.lit(SALTS)).alias("salt"))
        for by in (["digest", "text", "salt"], ["digest", "text"]):
            again = again.groupBy(*by).agg(F.sum("n").alias("n"), F.max("best").alias("best"))
        texts = stored(again, self.folder)
        per = texts.groupBy("digest").agg(F.count("*").alias("texts"), F.max("n").alias("all"), F.max("best").alias("top"))
        slim = rows.select("digest", "sha", "row", "members", "n", "best").join(per, "digest", "left")
        one = slim.where("texts is null or texts = 1").select("sha", "row", "members", F.coalesce("all", "n").alias("n"), F.coalesce("top", "best").alias("best"))
        # different texts with one digest: only these need their contents again
        many = stored(texts.join(per.where("texts > 1"), "digest", "left_semi").select("digest", "text", F.col("n").alias("all"), F.col("best").alias("top")), self.folder)
        if not many.isEmpty():
            one = one.union(rows.join(many, ["digest", "text"]).select("sha", "row", "members", F.col("all").alias("n"), F.col("top").alias("best")))
        each = one.select("sha", "row", "n", "best", F.posexplode("members").alias("at", "m"))
        keep = F.when(F.col("best.named"), F.bitwise_not("best.id"))
        stays = (F.col("row") == F.col("best.row")) & (F.col("at") == F.col("best.at"))
        return each.select(F.col("m.doc_id").alias("doc_id"), keep.alias("keep_id"), F.col("n").alias("group_size"), stays.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def exact_copies(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row of docs, by way of a new index.

    Texts are equal when they are without the characters of [\\x20\\x09-\\x0D]; null counts as empty. Of equal texts the row with
    the most code points in the original text stays, then that with the smallest doc_id (null last); of rows that are
    alike in both exactly one. Other columns are ignored; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "copies")
    index = Index(spark, folder)
    index.insert(docs)
    out = stored(index.groups())
    remove(spark, folder)
    return out
