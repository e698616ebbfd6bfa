"""Queries of the sources and sinks (S1 to S12): files written from the driver's tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from joblode.plans.adapters import frame
from joblode.plans.registry import query
from joblode.sources import files
from joblode.streaming.jobs import fresh_dir

_TAB = "chr(9)"


def written(spark, sf, name: str, sql: str) -> str:
    """Path of text files that hold the lines of a query over the tables."""
    path = fresh_dir(spark, name)
    frame(spark, sf, sql).select(F.col("line").cast("string")).write.text(path)
    return path


def in_files(spark, sf, name: str, rows: str, head: list[str], tail: list[str] = (), lines: int = 100_000) -> str:
    """Path of text files, each with the lines of head, its share of the lines (line, k) of a query, and those of tail.

    A file has some ``lines`` lines, so their number grows with the rows.
    """
    path = fresh_dir(spark, name)
    files = max(8, frame(spark, sf, rows).count() // lines)
    body = frame(spark, sf, rows).select(F.pmod(F.xxhash64("k"), F.lit(files)).alias("share"), F.lit(0).alias("at"), "k", "line")
    edge = spark.range(files).select(F.col("id").alias("share"), F.explode(F.array(*[F.struct(F.lit(i - len(head) if i < len(head) else i).alias("at"), F.lit(x).alias("line")) for i, x in enumerate([*head, *tail])])).alias("e"))
    both = body.union(edge.select("share", "e.at", F.lit(0).cast("long"), "e.line"))
    both.repartition(files, "share").sortWithinPartitions("share", "at", "k").select("share", "line").write.partitionBy("share").text(path)
    return path


_HIST = f"SELECT concat_ws({_TAB}, coalesce(url, 'x'), CASE WHEN id % 9 = 0 THEN '2026-02-30' ELSE strf(posted) END, source, title, coalesce(company, ''), CASE WHEN id % 4 = 0 THEN '' ELSE 'skipped' END) AS line FROM postings WHERE posted IS NOT NULL AND id % 11 <> 0 UNION ALL SELECT concat_ws({_TAB}, 'url', 'first_seen', 'portal', 'title', 'company') UNION ALL SELECT concat_ws({_TAB}, 'short', 'row')"
_spark = lambda s: s.replace("strf(posted)", "date_format(posted, 'yyyy-MM-dd')")


@query("s01_scan_history", "SELECT coalesce(trim(url), 'x') AS url, posted AS first_seen, source AS portal, trim(title) AS title, CASE WHEN id % 4 = 0 THEN 'added' ELSE 'skipped' END AS status FROM postings WHERE posted IS NOT NULL AND id % 11 <> 0 AND id % 9 <> 0")
def s01(spark, sf):
    return files.scan_history(spark, written(spark, sf, "s01", _spark(_HIST))).select("url", "first_seen", "portal", "title", "status")


_LEDGER = f"SELECT concat_ws({_TAB}, CASE WHEN seq % 50 = 0 THEN 'x' ELSE CAST(num AS VARCHAR(20)) END, date_format(day, 'yyyy-MM-dd'), 'Applied', CASE WHEN seq % 60 = 1 THEN 'Nowhere' ELSE state END, source, CAST(seq AS VARCHAR(20))) AS line FROM ledger"


@query("s02_status_ledger", "SELECT CASE WHEN seq % 50 = 0 THEN 'number' WHEN seq % 60 = 1 THEN 'state' ELSE concat('ok ', CASE WHEN source IN ('agent', 'manual', 'correction') THEN 'counts' ELSE 'unknown source' END) END AS kind, count(*) AS n FROM ledger GROUP BY 1")
def s02(spark, sf):
    good, bad = files.status_ledger(spark, written(spark, sf, "s02", _LEDGER))
    kinds = good.select(F.when(F.col("day_math"), "ok counts").otherwise("ok unknown source").alias("kind")).union(bad.select("reason"))
    return kinds.groupBy("kind").agg(F.count("*").alias("n"))


_COUNTERS = f"SELECT concat_ws({_TAB}, 't', CAST(event_id AS VARCHAR(20)), CAST(user_id AS VARCHAR(20)), CAST(event_id % 7 AS VARCHAR(20)), CASE WHEN event_id % 10 = 0 THEN concat('1', {_TAB}, '2') WHEN event_id % 10 = 1 THEN NULL ELSE '1' END) AS line, event_id AS k FROM events"


@query("s03_run_counters", "SELECT count_if(event_id % 10 > 1) AS n, CAST(sum(CASE WHEN event_id % 10 > 1 THEN user_id + event_id % 7 ELSE 0 END) AS BIGINT) AS filtered, count_if(event_id % 10 = 0) AS drifted, count_if(event_id % 10 = 1) AS torn FROM events")
def s03(spark, sf):
    path = in_files(spark, sf, "s03", _COUNTERS, ["\t".join(("timestamp", "found", "filtered_title", "filtered_age", "new"))])
    good, counts = files.run_counters(spark, path)
    return good.agg(F.count("*").alias("n"), F.sum("filtered").alias("filtered")).crossJoin(counts)


_PAY = f"SELECT concat_ws({_TAB}, CAST(num AS VARCHAR(20)), CASE WHEN num % 7 = 0 THEN '' ELSE 'actual' END, CASE WHEN num % 5 = 0 THEN 'wish' ELSE 'contract' END, CASE WHEN num % 11 = 0 THEN NULL ELSE company END) AS line FROM applications WHERE company IS NOT NULL"


@query("s04_checked_rows", "SELECT CASE WHEN num % 11 = 0 THEN 'short row' WHEN num % 7 = 0 THEN 'missing type' WHEN num % 5 = 0 THEN 'invalid source' ELSE 'ok' END AS kind, count(*) AS n FROM applications WHERE company IS NOT NULL GROUP BY 1")
def s04(spark, sf):
    good, bad = files.checked_rows(spark, written(spark, sf, "s04", _PAY), ["num", "type", "source", "company"], ["num", "type"], {"source": ["contract", "verbal"]})
    return good.select(F.lit("ok").alias("kind")).union(bad.select("reason")).groupBy("kind").agg(F.count("*").alias("n"))


_CSV = "SELECT concat(c_name, ',X,http://u,,\"', c_mktsegment, ', \"\"Inc\"\"\",\"two', chr(10), 'lines\",', CASE WHEN c_custkey % 2 = 0 THEN '03 Feb 2024' ELSE '2024-03-04' END) AS line, c_custkey AS k FROM customer"


@query("s05_connections", "SELECT concat(c_name, ' X') AS name, concat(c_mktsegment, ', \"Inc\"') AS company, concat('two', chr(10), 'lines') AS position, CASE WHEN c_custkey % 2 = 0 THEN DATE '2024-02-03' ELSE DATE '2024-03-04' END AS connected FROM customer")
def s05(spark, sf):
    path = in_files(spark, sf, "s05", _CSV, ["Notes:", '"some, text"', "", "First Name,Last Name,URL,Email Address,Company,Position,Connected On"])
    return files.connections(spark, path)


_TABLE = "SELECT concat('| ', CAST(num AS VARCHAR(20)), ' | ', date_format(applied, 'yyyy-MM-dd'), ' | ', company, ' | ', role, ' | ', CASE WHEN num % 6 = 0 THEN 'Applied | 4.1/5' ELSE '3.5/5 | Interview' END, ' | y | r | ', notes, ' |') AS line, num AS k FROM applications WHERE score IS NOT NULL"


@query("s06_tracker_table", "SELECT CAST(num AS INTEGER) AS num, applied AS date, company, role, CASE WHEN num % 6 = 0 THEN 4.1::DOUBLE ELSE 3.5::DOUBLE END AS score, CASE WHEN num % 6 = 0 THEN 'Applied' ELSE 'Interview' END AS status, notes FROM applications WHERE score IS NOT NULL")
def s06(spark, sf):
    return files.tracker_table(spark, in_files(spark, sf, "s06", _TABLE, ["| # | Date | Company | Role | Score | Status | PDF | Report | Notes |", "|---|------|---|---|---|---|---|---|---|"]))


_INBOX = "SELECT concat(CASE WHEN id % 3 = 0 THEN '- [x] ' ELSE '- [ ] ' END, CASE WHEN id % 5 = 0 THEN '~~' ELSE '' END, 'https://x.example/', CAST(id AS VARCHAR(20)), ' | ', coalesce(company, ''), ' | ', title, CASE WHEN id % 5 = 0 THEN '~~' ELSE '' END) AS line FROM postings UNION ALL SELECT '# Inbox'"


@query("s07_inbox", "SELECT id % 3 = 0 AS done, id % 5 = 0 AS expired, concat('https://x.example/', CAST(id AS VARCHAR)) AS url, trim(coalesce(company, '')) AS company, trim(title) AS role FROM postings")
def s07(spark, sf):
    return files.inbox(spark, written(spark, sf, "s07", _INBOX))


_REPORT = "SELECT concat('# R', chr(10), '```yaml', chr(10), 'company: \"', s_name, '\"', chr(10), 'score: ', CAST(s_suppkey % 5 AS VARCHAR(20)), chr(10), 'other: x', chr(10), '```', chr(10), '**Role:** Engineer ', CAST(s_suppkey AS VARCHAR(20)), chr(10), '| Gap | Severity |', chr(10), '|---|---|', chr(10), '| no Kafka | high |', chr(10), '| no Go | low |', chr(10)) AS line, s_suppkey AS k FROM supplier"


@query("s08_reports", "SELECT s_name AS company, concat('Engineer ', CAST(s_suppkey AS VARCHAR)) AS role, CAST(s_suppkey % 5 AS VARCHAR) AS score, 'no Kafka,no Go' AS gaps FROM supplier")
def s08(spark, sf):
    path = fresh_dir(spark, "s08")
    # a file for each report would be as many files as suppliers
    frame(spark, sf, _REPORT).select("line").write.text(path, lineSep="\f")
    return files.reports(spark, path, "\f").select("company", "role", "score", F.array_join("gaps", ",").alias("gaps"))


_FEED = "SELECT concat('<item><title>', p_name, ' raises</title><link>http://n/', CAST(p_partkey AS VARCHAR(20)), '</link><pubDate>Mon</pubDate><category>', p_brand, '</category><category>news</category></item>') AS line, p_partkey AS k FROM part"


@query("s09_feed_items", "SELECT concat(p_name, ' raises') AS title, concat('http://n/', CAST(p_partkey AS VARCHAR)) AS link, concat(p_brand, ',news') AS categories FROM part")
def s09(spark, sf):
    path = in_files(spark, sf, "s09", _FEED, ["<rss>"], ["</rss>"])
    return files.feed_items(spark, path).select("title", "link", F.array_join("categories", ",").alias("categories"))


_STORE = "SELECT concat(chr(123), '\"j', CAST(o_orderkey AS VARCHAR(20)), '\": ', chr(123), '\"title\": \"t', CAST(o_custkey AS VARCHAR(20)), '\", \"seen\": ', CAST(o_orderkey % 9 AS VARCHAR(20)), CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE concat(chr(125), chr(125)) END) AS line FROM orders"


@query("s10_json_store", "SELECT concat('j', CAST(o_orderkey AS VARCHAR)) AS id, concat('t', CAST(o_custkey AS VARCHAR)) AS title, o_orderkey % 9 AS seen FROM orders WHERE o_orderkey % 10 <> 0")
def s10(spark, sf):
    return files.json_store(spark, written(spark, sf, "s10", _STORE), "title:string,seen:bigint").where("title is not null")


_CELLS = "SELECT id, CASE WHEN id % 4 = 0 THEN concat('=', title) WHEN id % 4 = 1 THEN concat('a|', title, chr(9), 'b') ELSE title END AS a, company AS b FROM postings"
_SAFE = lambda x: f"CASE WHEN regexp_matches({x}, '^[=+@-]') THEN concat(chr(39), {x}) ELSE {x} END"


@query("s11_ledger_sink", f"SELECT CAST(id AS VARCHAR) AS id, {_SAFE('a')} AS a, {_SAFE('b')} AS b FROM (SELECT id, trim(replace(regexp_replace(a, '\\s+', ' ', 'g'), '|', '/')) AS a, trim(replace(regexp_replace(coalesce(b, ''), '\\s+', ' ', 'g'), '|', '/')) AS b FROM ({_CELLS}))")
def s11(spark, sf):
    path = fresh_dir(spark, "s11")
    files.write_ledger(frame(spark, sf, _CELLS), path, ["id", "a", "b"])
    return spark.read.text(path).withColumn("c", F.split("value", "\t")).select(F.col("c")[0].alias("id"), F.col("c")[1].alias("a"), F.col("c")[2].alias("b"))


@query("s12_source_delta", "SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 3 = 0 THEN 'new' WHEN doc_id % 3 = 1 THEN 'changed' ELSE 'ingested' END AS state FROM documents")
def s12(spark, sf):
    docs = frame(spark, sf, "SELECT CAST(doc_id AS STRING) AS path, text, doc_id FROM documents")
    state = docs.where("doc_id % 3 <> 0").select("path", F.sha2(F.when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))
    return files.source_delta(docs, state)

