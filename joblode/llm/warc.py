"""WARC archives: writing with revisits, segments and chunked framing, and reading with segment reassembly."""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joblode.llm._store import shared_dir, stored

#: Largest block of one record; longer ones go on in continuation records.
SEGMENT = 16 << 10
CHUNK = 4 << 10
#: Records in one archive file, which a reader holds at once (at most 5000 * 16 KiB).
PER_FILE = 5000
DATE = "2024-01-01T00:00:00Z"
#: Fixed value of the WARC 1.1 standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """HTTP/1.1 chunked framing of a payload."""
    parts = [b"%x\r\n%b\r\n" % (len(p := payload[i : i + size]), p) for i in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body (chunk extensions and trailers are skipped); ValueError if it is torn."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("torn chunk")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The body of an HTTP response block, without its transfer framing."""
    head, _, body = block.partition(b"\r\n\r\n")
    framing = [line for line in head.lower().split(b"\r\n") if line.startswith(b"transfer-encoding:")]
    return unchunked(body) if any(b"chunked" in x for x in framing) else body


def _record(kind: str, record_id: str, block: bytes, **more) -> bytes:
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": DATE} | {k.replace("_", "-"): v for k, v in more.items()}
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def records(page_id: int | None, url: str | None, payload: bytes, refers_to: str | None, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one page: a revisit, or a response and its continuations."""
    digest = digest32(payload)
    own = f"urn:page:{'' if page_id is None else page_id}:{digest}"
    common = {"WARC_Target_URI": urllib.parse.quote(url or "", safe=":/?#[]@!$&'()*+,;=%~"), "WARC_Payload_Digest": f"sha1:{digest}"}
    if refers_to is not None:
        yield _record("revisit", own, _HTTP + b"\r\n", **common, WARC_Profile=PROFILE, WARC_Refers_To=f"<{refers_to}>", Content_Type="application/http; msgtype=response")
        return
    block = _HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    cut = {"WARC_Segment_Number": 1} if len(parts) > 1 else {}
    yield _record("response", own, parts[0], **common, Content_Type="application/http; msgtype=response", **cut)
    for n, part in enumerate(parts[1:], 2):
        last = {"WARC_Segment_Total_Length": len(block)} if n == len(parts) else {}
        yield _record("continuation", f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{own}#{n}')}", part, WARC_Target_URI=common["WARC_Target_URI"], WARC_Segment_Origin_ID=f"<{own}>", WARC_Segment_Number=n, **last)


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        block = data[end + 4 : end + 4 + size]
        at = end + 8 + size
        if len(block) < size or data[at - 4 : at] != b"\r\n\r\n":
            raise ValueError("torn record")
        yield fields, block


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[bytes] = []
        size = 0
        for page, url, html, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for r in records(page, url, (html or "").encode("utf-8", "surrogatepass"), refers):
                out.append(r[:-1])  # the writer's line end completes the record
                size += len(r)
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])


def write_archives(pages: DataFrame, path: str, least: int = 0) -> None:
    """Archives of pages (page_id, url, html) under path: gzip files of whole records.

    Of rows with equal payloads of at least ``least`` bytes the one with the largest page_id is the response and
    the others revisit it. Rows that repeat that page_id are responses too. A null html is an empty payload.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("sha", F.sha1(F.col("html").cast("binary")))
    first = rows.where(F.octet_length("html") >= least).groupBy("sha").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1 and keeper is not null").drop("n")

    @F.pandas_udf("string")
    def reference(keeper, sha):
        return "urn:page:" + keeper.astype("int64").astype(str) + ":" + sha.map(lambda x: base64.b32encode(bytes.fromhex(x)).decode())

    rows = rows.join(first, "sha", "left")
    other = F.col("keeper").isNotNull() & ~F.col("keeper").eqNullSafe(F.col("page_id"))
    rows = rows.select("page_id", "url", "html", F.when(other, reference(F.coalesce("keeper", F.lit(0)), "sha")).alias("refers"))
    made = rows.mapInArrow(_written, "record binary").select(F.col("record").cast("string"))
    made.write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", PER_FILE).text(path)


_RECORDS = "kind string, record_id string, origin string, segment int, total long, refers string, digest string, block binary, payload_bytes long"


def _strip(x: str | None) -> str | None:
    return x.strip("<>") if x else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _RECORDS.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64()]
    for batch in batches:
        for i in range(batch.num_rows):
            raw = batch.column(0)[i].as_buffer()
            data = zlib.decompressobj(31).decompress(raw) if bytes(raw[:2]) == b"\x1f\x8b" else raw.to_pybytes()
            out: list[tuple] = []
            for f, block in parsed(data):
                segment = int(f["warc-segment-number"]) if "warc-segment-number" in f else None
                own = _strip(f["warc-record-id"])
                n, digest = None, f.get("warc-payload-digest", "").removeprefix("sha1:")
                if f["warc-type"] == "response" and segment is None:
                    payload = payload_of(block)
                    n, block = len(payload), None
                    if digest32(payload) != digest:
                        raise ValueError(f"{own}: payload digest differs")
                elif f["warc-type"] == "revisit":
                    block = None
                total = f.get("warc-segment-total-length")
                out.append((f["warc-type"], own, _strip(f.get("warc-segment-origin-id")) or own, segment, int(total) if total else None, _strip(f.get("warc-refers-to")), digest, block, n))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(names), kinds, strict=True)], names)


def reassembled(parts: list[dict]) -> bytes:
    """The whole block of one origin from its segments, in any order and with repeats; ValueError if one lacks."""
    by = {p["segment"]: p for p in parts}
    order = [by[i] for i in sorted(by)]
    block = b"".join(bytes(p["block"]) for p in order)
    totals = {p["total"] for p in order if p["total"] is not None}
    if sorted(by) != list(range(1, len(by) + 1)) or totals != {len(block)}:
        raise ValueError("segments don't add up to their total length")
    return block


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, digests = [], []
        for origin, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            payload = payload_of(reassembled(parts))
            sizes.append(len(payload))
            digests.append(digest32(payload))
            if not origin.endswith(digests[-1]):
                raise ValueError(f"{origin}: payload digest differs")
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), batch.column(2)], ["record_id", "payload_bytes", "digest", "copies"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each capture in the archives under path.

    Continuation records are grouped by their origin, ordered by segment number and checked against the total
    length before the chunked framing is decoded; payload digests are checked. Groups are single pages. Captures
    written twice with one page_id and payload come back twice. A torn record, a missing segment or a
    revisit whose response is in none of the archives fails the read.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    found = stored(files.mapInArrow(_read, _RECORDS))  # whole payloads are left out, so archives are parsed once
    whole = found.where("kind = 'response' and segment is null").select("record_id", "payload_bytes", "digest", F.lit(1).cast("long").alias("copies"))
    parts = found.where("segment is not null").groupBy("origin").agg(F.collect_list(F.struct("segment", "total", "block")).alias("parts"), F.count_if(F.col("segment") == 1).alias("copies"))
    # revisits read it too, and it holds no payloads
    responses = stored(whole.union(parts.mapInArrow(_joined, "record_id string, payload_bytes long, digest string, copies long")))
    page = F.regexp_extract("record_id", "^urn:page:([0-9-]*):", 1)
    number = lambda c: F.nullif(c, F.lit("")).cast("long")
    out = responses.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(number(page).alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    revisits = found.where("kind = 'revisit'").select(number(page).alias("page_id"), "refers")
    target = responses.groupBy(F.col("record_id").alias("refers")).agg(F.first("payload_bytes").alias("payload_bytes"), F.first("digest").alias("payload_digest"))
    # a response that the archives lack fails the read
    held = lambda c, kind: F.when(F.col("payload_digest").isNull(), F.raise_error(F.concat(F.lit("no response "), F.col("refers"))).cast(kind)).otherwise(F.col(c)).alias(c)
    again = revisits.join(target, "refers", "left").select("page_id", held("payload_bytes", "long"), held("payload_digest", "string"), F.lit("revisit").alias("record_type"), number(F.regexp_extract("refers", "^urn:page:([0-9-]*):", 1)).alias("refers_to"))
    return out.union(again)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/joblode-warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return read_archives(spark, path)
