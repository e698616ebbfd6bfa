"""Queries of the streams (T1 to T7) and of the extension points."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from joblode.functions import misc
from joblode.operators import hooks
from joblode.plans import sql as q
from joblode.plans.adapters import HEALTH, LEDGER, frame, view
from joblode.plans.ordering import _FOLDED
from joblode.plans.registry import query
from joblode.streaming import jobs


def events(spark, sf):
    """The events table as a stream."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    # a pattern, since a stream's source may be a folder but not a file
    return spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def derived(spark, sf, sql: str):
    """A derived view of the events as a stream."""
    return spark.sql(sql.replace("FROM events", "FROM {events}"), events=events(spark, sf))


@query("t01_stream_intake", "SELECT DISTINCT user_id, event_type FROM events")
def t01(spark, sf):
    stream = jobs.intake(events(spark, sf), ["user_id", "event_type"], "ts", "60 days")
    return jobs.drained(stream, jobs.fresh_dir(spark, "t01"))


_ARRIVED = "SELECT concat('k', CAST(user_id % 700 AS VARCHAR(20)), event_type) AS key, ts FROM events"
_RUNS = "SELECT concat('k', CAST(o_custkey % 900 AS VARCHAR(20)), CASE WHEN o_orderkey % 2 = 0 THEN 'view' ELSE 'click' END) AS key, CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'cooldown' WHEN 1 THEN 'expired' ELSE 'added' END AS status, CAST(DATE '2023-12-01' + CAST(o_orderkey % 60 AS INT) AS DATE) AS day, CAST(DATE '2023-12-20' + CAST(o_orderkey % 40 AS INT) AS DATE) AS until FROM orders WHERE o_orderkey % 7 < 2"


@query("t01_intake_policy", f"""WITH h AS (SELECT key, max(CASE status WHEN 'added' THEN CAST(day AS TIMESTAMP) + INTERVAL 10 DAY WHEN 'cooldown' THEN CAST(until AS TIMESTAMP) END) AS until, bool_or(status NOT IN ('added', 'cooldown')) AS ever FROM ({_RUNS}) GROUP BY key),
e AS (SELECT key, list(date_trunc('millisecond', ts) ORDER BY ts) AS ts FROM ({_ARRIVED}) GROUP BY key),
r AS (SELECT e.key, list_reduce(ts, lambda s, t: CASE WHEN s.until IS NULL OR t >= s.until THEN {{'until': t + INTERVAL 10 DAY, 'o': list_append(s.o, t)}} ELSE s END, {{'until': h.until, 'o': []::TIMESTAMP[]}}).o AS o FROM e LEFT JOIN h ON e.key = h.key WHERE NOT coalesce(h.ever, false))
SELECT key, unnest(o)::TIMESTAMP AS ts FROM r""")
def t01_policy(spark, sf):
    stream = jobs.intake_with_history(derived(spark, sf, _ARRIVED.replace("VARCHAR(20)", "STRING")), frame(spark, sf, _RUNS), 10, "60 days")
    return jobs.drained(stream, jobs.fresh_dir(spark, "t01"))


_KIND = "CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END"


@query("t02_lifecycle", f"""WITH e AS (SELECT user_id * 5 + {_KIND} AS key, ts FROM events), g AS (SELECT key, ts, lag(ts) OVER w AS last, lead(ts) OVER w AS next FROM e WINDOW w AS (PARTITION BY key ORDER BY ts)),
n AS (SELECT key, ts, last, coalesce(next, (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY FROM e)) AS seen FROM g)
SELECT key, ts AS at, 'active' AS state FROM n WHERE last IS NULL OR ts > last + INTERVAL 1 DAY UNION ALL SELECT key, ts + INTERVAL 1 DAY, 'stale' FROM n WHERE seen > ts + INTERVAL 1 DAY UNION ALL SELECT key, ts + INTERVAL 3 DAY, 'closed' FROM n WHERE seen > ts + INTERVAL 3 DAY""")
def t02(spark, sf):
    seen = events(spark, sf).select((F.col("user_id") * 5 + F.expr(_KIND)).alias("key"), "ts")
    return jobs.drained(jobs.lifecycle(seen, 1, 3), jobs.fresh_dir(spark, "t02"))


@query("t03_daily_counts", "SELECT date_trunc('day', ts)::TIMESTAMP AS begin, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def t03(spark, sf):
    return jobs.latest_counts(jobs.counts(events(spark, sf), "ts", "1 day", by=("event_type",)), jobs.fresh_dir(spark, "t03"))


_MARK = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY FROM events)"


@query("t03_closed_counts", f"SELECT date_trunc('day', ts)::TIMESTAMP AS begin, event_type, count(*) AS n, false AS late FROM events WHERE date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY <= {_MARK} GROUP BY 1, 2")
def t03_closed(spark, sf):
    return jobs.drained(jobs.closed_counts(events(spark, sf), "ts", "1 day", by=("event_type",)), jobs.fresh_dir(spark, "t03"))


@query("t04_failure_alerts", """WITH h AS (SELECT *, status IN ('reachable', 'empty') AS ok FROM health), g AS (SELECT *, count(*) FILTER (WHERE ok) OVER (PARTITION BY portal ORDER BY seq) AS island FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY portal, island ORDER BY seq) AS k FROM g WHERE NOT ok) SELECT portal, seq FROM r WHERE k = 3""")
def t04(spark, sf):
    rows = derived(spark, sf, HEALTH).select("portal", "seq", F.col("status").isin("reachable", "empty").alias("ok"))
    return jobs.drained(jobs.failure_alerts(rows), jobs.fresh_dir(spark, "t04"))


_ALLOWED = " OR ".join(f"(s.now = '{k}' AND x.state IN ({q.strings(v)}))" for k, v in jobs.ALLOWED.items() if v)
#: Applications that had been sent before the stream began.
_SENT = "SELECT DISTINCT user_id AS num, 'Applied' AS state, DATE '2023-06-01' AS day FROM events WHERE user_id % 3 = 0"


@query("t05_transitions", f"""WITH e AS (SELECT num, list({{'seq': seq, 'state': state, 'day': day}} ORDER BY seq) AS log FROM ledger WHERE state <> '-' GROUP BY num), i AS ({_SENT}),
r AS (SELECT e.num, list_reduce(log, lambda s, x: {{'now': CASE WHEN {_ALLOWED} THEN x.state ELSE s.now END,
 'first': CASE WHEN ({_ALLOWED}) AND NOT list_contains(list_transform(s.first, lambda f: f.state), x.state) THEN list_append(s.first, {{'state': x.state, 'day': x.day}}) ELSE s.first END,
 'o': list_append(s.o, {{'seq': x.seq, 'state': x.state, 'verdict': CASE WHEN x.state = s.now THEN 'repeated' WHEN {_ALLOWED} THEN 'accepted' ELSE 'illegal' END, 'reason': CASE WHEN x.state = s.now THEN concat('already ', s.now) WHEN {_ALLOWED} THEN '' ELSE concat(CASE WHEN s.now = '' THEN 'nothing' ELSE s.now END, ' is not followed by ', x.state) END,
  'first_day': coalesce(list_filter(s.first, lambda f: f.state = x.state)[1].day, CASE WHEN {_ALLOWED} THEN x.day END)}})}},
 {{'now': coalesce(i.state, ''), 'first': CASE WHEN i.state IS NULL THEN []::STRUCT(state VARCHAR, day DATE)[] ELSE [{{'state': i.state, 'day': i.day}}] END, 'o': []::STRUCT(seq BIGINT, state VARCHAR, verdict VARCHAR, reason VARCHAR, first_day DATE)[]}}).o AS o FROM e LEFT JOIN i ON e.num = i.num),
u AS (SELECT num, unnest(o) AS x FROM r) SELECT num, x.seq AS seq, x.state AS state, x.verdict AS verdict, x.reason AS reason, x.first_day AS first_day FROM u""")
def t05(spark, sf):
    rows = derived(spark, sf, LEDGER).where("state <> '-'").select("num", "seq", "state", "day")
    return jobs.drained(jobs.transitions(rows, tracked=frame(spark, sf, _SENT)), jobs.fresh_dir(spark, "t05"))


@query("t06_corrected_ledger", _FOLDED + "SELECT num, CAST(len(t) AS INTEGER) AS n, array_to_string(list_transform(t, lambda x: concat(strftime(x.day, '%m%d'), substr(x.state, 1, 3))), ' ') AS timeline FROM n")
def t06(spark, sf):
    folded = jobs.corrected_ledger(derived(spark, sf, LEDGER), jobs.fresh_dir(spark, "t06"))
    return folded.select("num", F.size("timeline").alias("n"), F.array_join(F.transform("timeline", lambda x: F.concat(F.date_format(x["day"], "MMdd"), F.substring(x["state"], 1, 3))), " ").alias("timeline"))


@query("t07_trailing_windows", "WITH d AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day FROM events), k AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS k) SELECT (day - to_days(k::INTEGER))::TIMESTAMP AS begin, count(*) AS n FROM d, k GROUP BY 1")
def t07(spark, sf):
    return jobs.latest_counts(jobs.counts(events(spark, sf), "ts", "7 days", "1 day"), jobs.fresh_dir(spark, "t07"))


@query("t07_closed_windows", f"WITH d AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day FROM events), k AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS k), w AS (SELECT (day - to_days(k::INTEGER))::TIMESTAMP AS begin FROM d, k) SELECT begin, count(*) AS n, false AS late FROM w WHERE begin + INTERVAL 7 DAY <= {_MARK} GROUP BY 1")
def t07_closed(spark, sf):
    return jobs.drained(jobs.closed_counts(events(spark, sf), "ts", "7 days", "1 day"), jobs.fresh_dir(spark, "t07"))


@query("x01_provider_hooks", "SELECT id, CASE WHEN source = 'board_a' AND coalesce(url, '') <> '' THEN upper(title) ELSE title END AS title, coalesce(url, '') AS url FROM postings")
def x01(spark, sf):
    default = lambda df: df.select("id", "title", F.coalesce("url", F.lit("")).alias("url"))
    shout = lambda df: df.select("id", F.upper("title").alias("title"), "url")
    broken = lambda df: df.select("id", F.lit("").alias("title"), "url")
    return hooks.normalise_by_provider(view(spark, sf, "postings"), {"board_a": shout, "mail": broken}, default)


@query("x02_classifier_hook", "SELECT page_id, CASE WHEN length(html) > 3000 THEN 'long' ELSE 'short' END AS class FROM pages")
def x02(spark, sf):
    def classify(s: pd.Series) -> pd.Series:
        return s.str.len().gt(3000).map({True: "long", False: "short"})

    return hooks.classified(spark.read.parquet(f"{sf}/pages.parquet"), "html", classify).select("page_id", "class")


@query("x03_weight_overrides", "SELECT source, 2.0::DOUBLE * count(*) + 0.5::DOUBLE * count_if(has_pay) AS signal FROM (SELECT source, pay_min IS NOT NULL AS has_pay FROM postings) GROUP BY source")
def x03(spark, sf):
    rows = misc.evidence(view(spark, sf, "postings")).groupBy("source").agg(F.count("*").alias("n"), F.count_if("has_pay").alias("p"))
    return rows.select("source", hooks.weighted({"n": F.col("n"), "p": F.col("p")}, {"n": 1.0, "p": 0.5}, {"n": 2.0}).alias("signal"))


@query("x04_extracted_claims", "SELECT page_id, CAST(k - 1 AS INTEGER) AS nth, v[k] AS value FROM (SELECT page_id, v, unnest(range(1, len(v) + 1)) AS k FROM (SELECT page_id, regexp_extract_all(url, '([0-9]+)', 1) AS v FROM pages))")
def x04(spark, sf):
    return hooks.extracted(frame(spark, sf, "SELECT * FROM pages"), "page_id", "url", "([0-9]+)")
