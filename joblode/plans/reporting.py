"""Queries of the reports' further tables, and of the whole set of opportunity filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from joblode.functions import skills, title
from joblode.operators import filters as fi
from joblode.operators import reports as rp
from joblode.plans import sql as q
from joblode.plans.adapters import frame, pick
from joblode.plans.registry import query

_SCANS = f"SELECT source AS portal, {pick('id', ('added', '', None, 'skipped_expired', ' added '))} AS status, company, posted AS day FROM postings"


@query("a06_scan_totals", f"""WITH s AS (SELECT portal, coalesce(nullif(trim(status), ''), 'added') AS status, nullif(lower(company), '') AS company, day FROM ({_SCANS})),
l AS (SELECT 'all' AS kind, '' AS value, company, day FROM s UNION ALL SELECT 'portal', portal, company, day FROM s UNION ALL SELECT 'status', status, company, day FROM s)
SELECT kind, value, count(*) AS n, count(DISTINCT company) AS companies, min(day) AS first_day, max(day) AS last_day FROM l GROUP BY 1, 2""")
def a06(spark, sf):
    return rp.scan_totals(frame(spark, sf, _SCANS))


_RUNS = "SELECT CAST(ts AS DATE) AS day, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status, user_id AS found, user_id % 7 AS filtered, event_id % 3 AS added FROM events"


@query("a07_run_averages", f"SELECT count(*) AS runs, count_if(status <> 'completed') AS failed, max(day) AS last_day, floor(avg(found) FILTER (WHERE status = 'completed') * 10 + 0.5) / 10 AS found, floor(avg(added) FILTER (WHERE status = 'completed') * 10 + 0.5) / 10 AS added, floor(1000.0 * sum(filtered) FILTER (WHERE status = 'completed') / sum(found) FILTER (WHERE status = 'completed') + 0.5) / 10 AS removed_pct FROM ({_RUNS})")
def a07(spark, sf):
    return rp.run_averages(frame(spark, sf, _RUNS))


_TRACE = "SELECT concat('q', CAST(user_id % 9 AS VARCHAR(20))) AS query, event_id % 5000 AS key, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END AS stage FROM events"


@query("a09_query_stats", f"SELECT query, count(*) AS keys, count(*) AS retrieved, count_if(stage >= 1) AS normalised, count_if(stage >= 2) AS accepted, count_if(stage >= 3) AS matched FROM (SELECT query, key, max(stage) AS stage FROM ({_TRACE}) GROUP BY 1, 2) GROUP BY query")
def a09(spark, sf):
    return rp.query_stats(frame(spark, sf, _TRACE), ["retrieved", "normalised", "accepted", "matched"])


_ENTRIES = f"SELECT id, id % 5 AS profile_id, id % 3000 AS job_id, CAST(id * 37 % 101 AS INT) AS score, {pick('id * 7 + 3', rp.OUTCOMES)} AS outcome, description FROM postings"


def _entries(spark, sf):
    return frame(spark, sf, _ENTRIES).withColumn("signals", skills.extract(F.col("description")))


@query("a11_outcome_signals", f"WITH e AS (SELECT outcome, lower(unnest({q.skills('description')}[1:10])) AS signal FROM ({_ENTRIES})) SELECT signal, count(*) AS samples, {', '.join(f'''count_if(outcome = '{o}') AS {o}''' for o in rp.OUTCOMES)}, count(*) >= 30 AS enough FROM e GROUP BY signal ORDER BY samples DESC, signal LIMIT 25")
def a11(spark, sf):
    return rp.outcome_signals(_entries(spark, sf))


@query("a12_profiles_per_job", f"SELECT profiles, count(*) AS jobs FROM (SELECT job_id, count(DISTINCT profile_id) AS profiles FROM ({_ENTRIES}) GROUP BY job_id) GROUP BY profiles")
def a12_jobs(spark, sf):
    return rp.profiles_per_job(frame(spark, sf, _ENTRIES))


@query("a12_high_score_rejections", f"SELECT job_id, profile_id, score FROM ({_ENTRIES}) WHERE score >= 75 AND outcome = 'rejected'")
def a12_rejections(spark, sf):
    return rp.high_score_rejections(frame(spark, sf, _ENTRIES))


_FEW = f"SELECT id * 13 % 997 AS profile_id, outcome FROM ({_ENTRIES})"


@query("a13_cold_start", f"SELECT *, CASE WHEN outcomes = 0 THEN 'zero' WHEN outcomes = 1 THEN 'one' WHEN outcomes < 10 THEN 'few' WHEN outcomes < 30 THEN 'growing' ELSE 'established' END AS stage FROM (SELECT profile_id, count_if(outcome <> 'surfaced') AS outcomes FROM ({_FEW}) GROUP BY profile_id)")
def a13(spark, sf):
    return rp.cold_start(frame(spark, sf, _FEW))


_SESSIONS = f"SELECT user_id AS company, event_type AS role, {pick('event_id', ('screen', 'panel', 'final'))} AS round, CAST(ts AS DATE) AS day FROM events"


@query("a23_rounds", f"""WITH s AS (SELECT * FROM ({_SESSIONS}) WHERE day BETWEEN DATE '2024-01-01' AND DATE '2024-02-15'), g AS (SELECT *, date_diff('day', lag(day) OVER (PARTITION BY company, role ORDER BY day, round), day) AS wait FROM s)
SELECT company, role, array_to_string(list(round ORDER BY day, round), ',') AS rounds, CAST(date_diff('day', min(day), max(day)) AS INTEGER) AS days, CAST(coalesce(max(wait), 0) AS INTEGER) AS gap FROM g GROUP BY 1, 2""")
def a23(spark, sf):
    out = rp.rounds(frame(spark, sf, _SESSIONS), F.lit("2024-01-01").cast("date"), F.lit("2024-02-15").cast("date"))
    return out.withColumn("rounds", F.array_join("rounds", ","))


_LABELLED = "SELECT CASE WHEN quality = 1 THEN 'CLEAR_MATCH' ELSE 'CLEAR_MISMATCH' END AS label, CAST(n_chars % 101 AS INT) AS score FROM documents d JOIN labels l ON d.doc_id = l.doc_id"


@query("a27_wrong_matches", f"SELECT kind, count(*) AS n, floor(avg(score) * 1000 + 0.5) / 1000 AS mean FROM (SELECT CASE WHEN label = 'CLEAR_MATCH' AND score < 75 THEN 'missed' WHEN label = 'CLEAR_MISMATCH' AND score >= 75 THEN 'false' END AS kind, score FROM ({_LABELLED})) WHERE kind IS NOT NULL GROUP BY kind")
def a27(spark, sf):
    return rp.wrong_matches(frame(spark, sf, _LABELLED))


_PLANS = "SELECT o_custkey AS profile_id, concat(CASE WHEN o_orderkey % 2 = 0 THEN ' Data' ELSE 'data' END, ' role ', CAST(o_orderkey % 700 AS VARCHAR(20))) AS query, o_orderpriority AS source FROM orders"


@query("a36_shared_plans", f"SELECT profiles, count(*) AS queries, max(s) AS sources FROM (SELECT lower(trim(query)) AS query, count(DISTINCT profile_id) AS profiles, count(DISTINCT source) AS s FROM ({_PLANS}) GROUP BY 1) GROUP BY profiles")
def a36(spark, sf):
    return rp.shared_plans(frame(spark, sf, _PLANS))


_POOL = f"SELECT id, title, company, location, source, posted, CAST(id * 37 % 101 AS INT) AS score, id % 4 AS profiles, CAST(id * 11 % 60 AS INT) AS delta, {pick('id', ('active', 'stale', 'closed'))} AS state, posted > DATE '2000-01-01' AS is_new, id % 3 = 0 AS changed, {pick('id * 5', ('remote', 'hybrid', 'on-site', ''))} AS workplace, {pick('id * 3 + 1', ('full-time', 'contract', ''))} AS employment FROM postings"


@query("f13_all_filters", f"SELECT id, score FROM ({_POOL}) WHERE score >= 75 AND contains(lower(coalesce(location, '')), 'remote') AND contains(workplace, 'remote') AND employment = 'full-time' AND (posted IS NULL OR date_diff('day', posted, DATE '2001-08-01') <= 3000) AND contains(lower(company), 'e') AND is_new AND changed AND delta >= 5 AND profiles >= 1 AND state = 'active' AND source = 'board_a' OR (score >= 40 AND {q.seniority('title')} = 'senior' AND profiles >= 2 AND state <> 'closed' AND state = 'stale')")
def f13(spark, sf):
    rows = frame(spark, sf, _POOL).withColumn("level", title.seniority(F.col("title")))
    day = F.lit("2001-08-01").cast("date")
    strict = fi.opportunity_filter(rows, as_of=day, high_confidence=True, location="Remote", workplace="remote", employment="Full-Time", max_age=3000, company="E", is_new=True, changed=True, min_delta=5, min_profiles=1, state="active", source="board_a")
    loose = fi.opportunity_filter(rows, min_score=40, level="senior", min_profiles=2, state="stale")
    return strict.union(loose).select("id", "score").distinct()
