"""Text files with a fixed or named layout. Each reader splits lines in one projection, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

C = F.col


def _cells(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """line, cells of each line, with the file and an order within it."""
    df = spark.read.text(path).select(C("value").alias("line"), C("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("seq"))
    return df.withColumn("cells", F.split("line", sep))


def day(c: Column) -> Column:
    """A calendar day written as YYYY-MM-DD, null for anything else (2026-02-30 too)."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def _cell(i: int) -> Column:
    return F.trim(F.get("cells", F.lit(i)))


def scan_history(spark: SparkSession, path: str) -> DataFrame:
    """Url, first_seen, portal, title, company, status, location, norm_company of a history file (tabs).

    A header line, rows of fewer than five cells and invalid days go; a missing status is ``added``; a twelfth cell
    is the stored company key.
    """
    rows = _cells(spark, path).where(~C("line").startswith("url\t") & (F.size("cells") >= 5))
    out = rows.select(_cell(0).alias("url"), day(_cell(1)).alias("first_seen"), _cell(2).alias("portal"), _cell(3).alias("title"), _cell(4).alias("company"), F.coalesce(F.nullif(_cell(5), F.lit("")), F.lit("added")).alias("status"), _cell(6).alias("location"), _cell(11).alias("norm_company"))
    return out.where("first_seen is not null")


STATES = ("Evaluated", "Applied", "Responded", "Interview", "Offer", "Hired", "Rejected", "Discarded", "SKIP")
TRUSTED = ("agent", "manual", "correction")


def status_ledger(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Good rows (seq, num, day, from_state, to_state, source, note, day_math) and rejects (seq, line, reason).

    Rows of an unknown source are kept without a say in day counts. seq is the order of the lines.
    """
    rows = _cells(spark, path).where(F.trim("line") != "")
    reason = (
        F.when(F.size("cells") < 5, "short row").when(_cell(0).try_cast("int").isNull(), "number").when(day(_cell(1)).isNull(), "date")
        .when(~_cell(3).isin(*STATES, "-"), "state")
    )
    rows = rows.withColumn("reason", reason)
    good = rows.where("reason is null").select("seq", _cell(0).cast("int").alias("num"), day(_cell(1)).alias("day"), _cell(2).alias("from_state"), _cell(3).alias("to_state"), _cell(4).alias("source"), F.coalesce(_cell(5), F.lit("")).alias("note"), _cell(4).isin(*TRUSTED).alias("day_math"))
    return good, rows.where("reason is not null").select("seq", "line", "reason")


def run_counters(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S3: rows (counters by header name as a map, filtered: sum of all filtered_*) and counts of drifted and torn rows.

    The header is the line that starts with ``timestamp``; wider rows have drifted, narrower ones are torn.
    """
    cells = _cells(spark, path)
    head = cells.where(C("line").startswith("timestamp\t")).select("file", C("cells").alias("head")).groupBy("file").agg(F.first("head").alias("head"))
    rows = cells.where(~C("line").startswith("timestamp\t")).join(head, "file")
    width = F.size("cells") - F.size("head")
    counts = rows.agg(F.count_if(width > 0).alias("drifted"), F.count_if(width < 0).alias("torn"))
    good = rows.where(width == 0).withColumn("counters", F.map_from_arrays("head", "cells"))
    parts = F.transform(F.filter(F.map_entries("counters"), lambda e: e["key"].startswith("filtered_")), lambda e: F.coalesce(e["value"].try_cast("long"), F.lit(0).cast("long")))
    return good.select("counters", F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x).alias("filtered")), counts


def checked_rows(spark: SparkSession, path: str, columns: list[str], required: list[str], enums: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """Rows of a table with tabs, and the bad ones with a reason: short, a required cell missing, a value not allowed."""
    rows = _cells(spark, path).where(F.trim("line") != "").select("seq", "line", F.size("cells").alias("width"), *[_cell(i).alias(c) for i, c in enumerate(columns)])
    reason = F.when(C("width") < len(columns), "short row")
    for c in required:
        reason = reason.when(F.coalesce(C(c), F.lit("")) == "", f"missing {c}")
    for c, allowed in enums.items():
        reason = reason.when(~C(c).isin(*allowed), f"invalid {c}")
    rows = rows.withColumn("reason", reason)
    return rows.where("reason is null").select("seq", *columns), rows.where("reason is not null").select("seq", "line", "reason")


def connections(spark: SparkSession, path: str) -> DataFrame:
    """Name, company, position, connected of an exported list of contacts.

    Quoted cells may hold commas, quotes and line ends; what stands before the header row goes; two date formats.
    """
    names = ("first", "last", "url", "email", "company", "position", "connected")
    raw = spark.read.csv(path, schema=", ".join(f"{c} string" for c in names), multiLine=True, quote='"', escape='"').select("*", C("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("seq"))
    head = raw.where("first = 'First Name'").groupBy("file").agg(F.min("seq").alias("head"))
    rows = raw.join(head, "file").where("seq > head")
    when = F.coalesce(F.try_to_date("connected", "dd MMM yyyy"), F.try_to_date("connected", "yyyy-MM-dd"))
    return rows.select(F.trim(F.concat_ws(" ", "first", "last")).alias("name"), "company", "position", when.alias("connected"))


#: Header names of tracker columns.
HEADERS = {"#": "num", "num": "num", "date": "date", "company": "company", "empresa": "company", "role": "role", "position": "role", "score": "score", "status": "status", "pdf": "pdf", "report": "report", "notes": "notes", "via": "via", "url": "url", "location": "location"}


#: The columns of a tracker table without a header row.
USUAL = ("num", "date", "company", "role", "score", "status", "pdf", "report", "notes")


def tracker_table(spark: SparkSession, path: str) -> DataFrame:
    """Num, date, company, role, score, status, notes of pipe tables.

    Columns follow the names of each file's header row (else the usual order); separators and short rows go; a score
    that stands in the status cell moves to its own.
    """
    rows = spark.read.text(path).select("value", C("_metadata.file_path").alias("file")).where(C("value").startswith("|"))
    rows = rows.withColumn("cells", F.transform(F.split(F.regexp_replace("value", r"^\||\|\s*$", ""), r"\|"), lambda x: F.trim(x)))
    rows = rows.where(~C("value").rlike(r"^\|[\s:|-]+$"))
    names = F.create_map(*[F.lit(x) for kv in HEADERS.items() for x in kv])
    is_head = F.exists("cells", lambda x: F.lower(x).isin("company", "empresa"))
    head = rows.where(is_head).groupBy("file").agg(F.min(F.transform("cells", lambda x: F.coalesce(F.element_at(names, F.lower(x)), F.lit("")))).alias("names"))
    rows = rows.where(~is_head & (F.size("cells") >= 6)).join(head, "file", "left").withColumn("names", F.coalesce("names", F.array(*map(F.lit, USUAL))))
    at = lambda c: F.get("cells", F.array_position("names", F.lit(c)) - 1)
    body = rows.select(at("num").try_cast("int").alias("num"), day(at("date")).alias("date"), at("company").alias("company"), at("role").alias("role"), at("score").alias("s"), at("status").alias("t"), at("notes").alias("notes"))
    score = r"^([0-9.]+)\s*/\s*5$"
    swapped = C("t").rlike(score)
    value = F.regexp_extract(F.when(swapped, C("t")).otherwise(C("s")), score, 1).try_cast("double")
    return body.where("num is not null").select("num", "date", "company", "role", value.alias("score"), F.when(swapped, C("s")).otherwise(C("t")).alias("status"), "notes")


def inbox(spark: SparkSession, path: str) -> DataFrame:
    """Done, expired, url, company, role of check-list lines ``- [ ] url | company | role``."""
    rows = spark.read.text(path).where(C("value").rlike(r"^\s*- \[[ xX]\] "))
    body = F.regexp_replace("value", r"^\s*- \[[ xX]\]\s*", "")
    bare = F.regexp_replace(body, "~~", "")
    part = lambda i: F.trim(F.coalesce(F.get(F.split(bare, r"\|"), F.lit(i)), F.lit("")))
    return rows.select(C("value").rlike(r"\[[xX]\]").alias("done"), F.contains(body, F.lit("~~")).alias("expired"), F.regexp_extract(bare, r"(https?://[^\s|]+)", 1).alias("url"), part(1).alias("company"), part(2).alias("role"))


#: Keys of a report's summary block.
SUMMARY = ("company", "role", "score", "archetype", "remote", "team_size", "advertised_comp", "hard_stops", "soft_gaps")


def reports(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """File, the summary block's known keys, and gaps (first cells of the gap table) of one report a file.

    With a separator a file holds many reports, each ended by it, and large files are split between tasks.
    A key that the block lacks is taken from a line ``**Key:** value``.
    """
    df = (spark.read.text(path, lineSep=separator) if separator else spark.read.text(path, wholetext=True)).select(F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1).alias("file"), C("value").alias("text"))
    block = F.regexp_extract("text", r"(?s)```ya?ml\s*\n(.*?)```", 1)
    found = []
    for key in SUMMARY:
        own = F.nullif(F.trim(F.regexp_extract(block, rf"(?m)^{key}:[ \t]*[\"']?(.*?)[\"']?[ \t]*$", 1)), F.lit(""))
        line = F.nullif(F.trim(F.regexp_extract("text", rf"(?mi)^\*\*{key.replace('_', '.')}:\*\*[ \t]*(.*)$", 1)), F.lit(""))
        found.append(F.coalesce(own, line).alias(key))
    table = F.regexp_extract("text", r"(?s)\| *Gap *\|[^\n]*\n\|[-| :]+\n((?:\|[^\n]*\n?)*)", 1)
    gaps = F.transform(F.filter(F.split(table, "\n"), lambda x: x.startswith("|")), lambda x: F.trim(F.get(F.split(x, r"\|"), F.lit(1))))
    return df.select("file", *found, gaps.alias("gaps"))


def feed_items(spark: SparkSession, path: str) -> DataFrame:
    """Title, link, published, categories of a feed's items."""
    schema = "title string, link string, pubDate string, category array<string>"
    items = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    return items.select(F.trim("title").alias("title"), F.trim("link").alias("link"), F.trim("pubDate").alias("published"), C("category").alias("categories"))


def json_store(spark: SparkSession, path: str, record: str) -> DataFrame:
    """Id and fields of a store ``{"id": {...}}``, one JSON object a line; a malformed line gives no rows."""
    rows = spark.read.text(path).select(F.from_json("value", f"map<string,struct<{record}>>").alias("m"))
    return rows.select(F.explode("m").alias("id", "r")).select("id", "r.*")


def safe_cell(c: Column) -> Column:
    """A cell on one line, without tabs and pipes, that no spreadsheet takes for a formula."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "), r"\|", "/"))
    return F.when(text.rlike("^[=+@-]"), F.concat(F.lit("'"), text)).otherwise(text)


def write_ledger(df: DataFrame, path: str, columns: list[str]) -> None:
    """Rows as lines of safe cells with tabs; tasks append in parallel."""
    df.select(F.concat_ws("\t", *[safe_cell(C(c).cast("string")) for c in columns]).alias("value")).write.mode("append").text(path)


def source_delta(files: DataFrame, state: DataFrame) -> DataFrame:
    """Path, state (new, changed, ingested) of files (path, text) against stored hashes (path, hash)."""
    h = files.select("path", F.sha2("text", 256).alias("now"))
    return h.join(state.select("path", "hash"), "path", "left").select("path", F.when(C("hash").isNull(), "new").when(C("hash") != C("now"), "changed").otherwise("ingested").alias("state"))
