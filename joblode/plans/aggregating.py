"""Queries of the aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from joblode.functions import company as co, misc, money, place, skills, status, title
from joblode.functions.text import any_of
from joblode.operators import aggregates as ag, filters as fi
from joblode.plans import sql as q
from joblode.plans.adapters import frame, view
from joblode.plans.filtering import GOOD, NEGATIVE, POSITIVE
from joblode.plans.joining import _RANK, _SCORES, profiles, scoring
from joblode.plans.registry import query
from joblode.store import stored

DAY = "2001-08-01"
_ST = q.status("status_text")
_CK = q.company_key("company")


def day(x: str = DAY):
    return F.lit(x).cast("date")


def pct(a: str, b: str, digits: int = 0) -> str:
    return f"CAST(floor(100.0 * {a} / {b} + 0.5) AS INTEGER)" if not digits else f"floor(1000.0 * {a} / {b} + 0.5) / 10"


def apps(spark, sf):
    label, _ = status.canonical(F.col("status_text"))
    return view(spark, sf, "applications").withColumns({"state": label, "company_key": co.company_key(F.col("company"))}).withColumn("stage", status.rank(F.col("state")))


def posts(spark, sf):
    return view(spark, sf, "postings").withColumn("company_key", co.company_key(F.col("company")))


@query("a01_opportunities", f"""WITH p AS (SELECT id, {q.canonical_key()} AS c, {_CK} AS k, concat('g', CAST(id // 3 AS VARCHAR)) AS n, source, url, posted FROM postings WHERE id < 3000),
k AS MATERIALIZED (SELECT *, concat('c:', c) AS k1, CASE WHEN k <> '' THEN concat_ws(':', 'n', k, n) END AS k2 FROM p),
e AS MATERIALIZED (SELECT DISTINCT k1 AS a, k2 AS b FROM k WHERE k2 IS NOT NULL UNION ALL SELECT DISTINCT k2, k1 FROM k WHERE k2 IS NOT NULL),
l AS (WITH RECURSIVE r(node, m) USING KEY (node) AS (SELECT k1, min(id) FROM k GROUP BY k1 UNION ALL SELECT k2, min(id) FROM k WHERE k2 IS NOT NULL GROUP BY k2
  UNION SELECT e.b, min(r.m) FROM r JOIN e ON r.node = e.a JOIN recurring.r o ON e.b = o.node WHERE r.m < o.m GROUP BY e.b) SELECT node AS k1, m FROM r)
SELECT m AS opportunity, count(*) AS n, count(DISTINCT source) AS n_sources, count(DISTINCT url) AS urls, min(posted) AS first_day, max(posted) AS last_day FROM k JOIN l USING (k1) GROUP BY m""".replace(" WHERE id < 3000", ""))
def a01(spark, sf):
    p = posts(spark, sf).select("id", misc.canonical_key(F.col("company"), F.col("title"), F.col("location"), F.col("posted")).alias("canonical"), "company_key", F.concat(F.lit("g"), F.expr("id div 3")).alias("native_id"), "source", "url", F.col("posted").alias("day"))
    return ag.merge_opportunities(p).select("opportunity", "n", F.size("sources").cast("long").alias("n_sources"), "urls", "first_day", "last_day")


_VERDICT = f"CASE WHEN regexp_extract(b, '{q.s(place.FOREIGN_RE)}', 2) <> '' THEN 'non-us' WHEN regexp_matches(b, '{q.s(place.US_RE)}') OR regexp_matches(b, '{q.s(place.STATE_RE)}') OR regexp_matches(b, '{q.s(place.CODE_RE)}') THEN 'us' WHEN regexp_matches(b, '\\bremote\\b|\\b(worldwide|global|emea|apac|latam|americas|north america|europe)\\b') THEN 'non-us' ELSE 'unknown' END"


@query("a02_employers", f"""WITH r AS (SELECT {_CK} AS company_key, company AS name, source, {_VERDICT} AS v, {q.staffing('company')} AS st FROM (SELECT *, lower(trim(coalesce(location, ''))) AS b FROM postings)),
g AS (SELECT company_key, count(*) AS jobs, count(DISTINCT source) AS sources, arg_min(name, {{'a': -length(name), 'b': name}}) AS name, bool_or(v = 'us') AS us, bool_and(v = 'non-us') AS fo, regexp_matches(company_key, '^({'|'.join(co.BOARDS)})( (employer|jobs?))?$') AS bo, company_key IN ({q.strings(co.GENERIC)}) AS ge, bool_or(st) AS st FROM r WHERE company_key <> '' GROUP BY company_key),
c AS (SELECT *, round(CASE WHEN bo OR ge THEN 0.0::DOUBLE ELSE 0.5::DOUBLE - CASE WHEN st THEN 0.15 ELSE 0 END + CASE WHEN us THEN 0.2 WHEN fo THEN -0.3 ELSE 0 END + CASE WHEN sources > 1 THEN 0.05 ELSE 0 END END, 2) AS confidence FROM g)
SELECT company_key, jobs, sources, name, confidence, CASE WHEN confidence >= 0.75 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS tier, CASE WHEN bo THEN 'board-as-employer' WHEN ge THEN 'generic-name' WHEN confidence >= 0.5 THEN '' WHEN st THEN 'staffing-unverified' WHEN fo THEN 'non-us-employer' ELSE 'weak-evidence' END AS reason FROM c""")
def a02(spark, sf):
    verdict, _ = place.country_verdict(F.col("location"), F.lit(""))
    p = posts(spark, sf).select("company_key", F.col("company").alias("name"), "source", verdict.alias("verdict"), co.is_board(F.col("company_key")).alias("board"), co.is_generic(F.col("company_key")).alias("generic"), co.is_staffing(F.col("company")).alias("staffing"))
    return ag.employers(p)


_REG = lambda t: f"SELECT company_key, count(*) AS jobs, list_distinct(list(source)) AS sources, count(*) / 1000.0::DOUBLE AS confidence, min(posted) AS first_day, max(posted) AS last_day FROM (SELECT *, {_CK} AS company_key FROM postings) WHERE {t} GROUP BY company_key"


@query("a03_registry", f"WITH b AS ({_REG('id % 2 = 0')} UNION ALL {_REG('id % 2 = 1')}) SELECT company_key, CAST(sum(jobs) AS BIGINT) AS jobs, array_to_string(list_sort(list_distinct(flatten(list(sources)))), ',') AS sources, max(confidence) AS confidence, min(first_day) AS first_day, max(last_day) AS last_day FROM b GROUP BY company_key")
def a03(spark, sf):
    half = lambda n: posts(spark, sf).where(f"id % 2 = {n}").groupBy("company_key").agg(F.count("*").alias("jobs"), F.collect_set("source").alias("sources"), (F.count("*") / 1000.0).alias("confidence"), F.min("posted").alias("first_day"), F.max("posted").alias("last_day"))
    return ag.merge_registry(half(0), half(1)).withColumn("sources", F.array_join("sources", ","))


@query("a04_tracker_stats", f"WITH s AS (SELECT unnest([{q.strings([*status.STATES, 'Ghosted'])}]) AS state), a AS (SELECT {_ST} AS state, count(*) AS n, avg(score) AS m, count_if(report <> '') AS r FROM applications GROUP BY 1) SELECT s.state, coalesce(n, 0) AS n, floor(m * 10 + 0.5) / 10 AS mean_score, {pct('r', 'n', 1)} AS reports_pct FROM s LEFT JOIN a ON s.state = a.state")
def a04(spark, sf):
    states = spark.createDataFrame([(s,) for s in [*status.STATES, "Ghosted"]], "state string")
    return ag.tracker_stats(apps(spark, sf), states)


@query("a05_funnel", f"WITH a AS (SELECT {_RANK(_ST)} AS stage FROM applications), n AS (SELECT unnest([1, 2, 3, 4, 5]) AS stage), c AS (SELECT n.stage, (SELECT count(*) FROM a WHERE a.stage >= n.stage) AS reached FROM n) SELECT stage, reached, {pct('reached', 'lag(reached, 1, reached) OVER (ORDER BY stage)', 1)} AS pct FROM c")
def a05(spark, sf):
    return ag.funnel(apps(spark, sf), "stage")


@query("a06_weekly_added", f"SELECT concat(CAST(isoyear(posted) AS VARCHAR), '-W', lpad(CAST(week(posted) AS VARCHAR), 2, '0')) AS week, count(*) AS added, count(DISTINCT {_CK}) AS companies FROM postings WHERE posted IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 8")
def a06(spark, sf):
    return ag.weekly_added(posts(spark, sf).where("posted is not null").withColumn("week", misc.iso_week(F.col("posted"))))


@query("a07_source_health", "SELECT concat('src', CAST(n_nationkey AS VARCHAR)) AS source, coalesce(n, 0) AS produced, n IS NULL AS dead FROM nation LEFT JOIN (SELECT source, count(*) AS n FROM documents GROUP BY source) d ON d.source = concat('src', CAST(n_nationkey AS VARCHAR))")
def a07(spark, sf):
    return ag.source_health(frame(spark, sf, "SELECT concat('src', CAST(n_nationkey AS STRING)) AS source FROM nation"), spark.read.parquet(f"{sf}/documents.parquet"))


@query("a08_provider_signal", f"WITH g AS (SELECT source, count(*) AS raw, count_if({GOOD}) AS accepted, count(DISTINCT CASE WHEN {GOOD} THEN {_CK} END) AS employers FROM postings GROUP BY source), s AS (SELECT *, CAST(floor(100 * (0.7 * accepted / raw + 0.3 * least(1.0, employers / 10)) + 0.5) AS INTEGER) AS signal FROM g) SELECT *, CASE WHEN accepted = 0 THEN 'barren' WHEN signal >= 50 THEN 'good' ELSE 'weak' END AS health FROM s")
def a08(spark, sf):
    return ag.provider_signal(posts(spark, sf).withColumn("accepted", fi.title_filter(F.col("title"), POSITIVE, NEGATIVE)))


@query("a09_trace_status", "SELECT user_id AS key, ['seen', 'parsed', 'kept', 'matched', 'saved'][CAST(max(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END) AS INT) + 1] AS status FROM events GROUP BY user_id")
def a09(spark, sf):
    e = frame(spark, sf, "SELECT user_id AS key, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS stage FROM events")
    return ag.trace_status(e, ["seen", "parsed", "kept", "matched", "saved"])


@query("a10_search_quality", f"SELECT source, count(*) AS shown, count_if(o = 'Applied') AS Applied, count_if(o = 'Interview') AS Interview, count_if(o = 'Rejected') AS Rejected, count(*) >= 30 AS enough FROM (SELECT p.source, {_ST} AS o FROM postings p JOIN applications a ON p.id = a.num) GROUP BY source")
def a10(spark, sf):
    j = posts(spark, sf).select("id", "source").join(apps(spark, sf).select(F.col("num").alias("id"), F.col("state").alias("outcome")), "id")
    return ag.search_quality(j, "source", ["Applied", "Interview", "Rejected"])


@query("a10_search_quality_by", f"""WITH r AS (SELECT p.source, {q.tier('p.title')} AS tier, CASE WHEN a.num IS NULL OR a.score IS NULL THEN 'unknown' WHEN a.score >= 4 THEN 'high' WHEN a.score >= 2.5 THEN 'mid' ELSE 'low' END AS band, a.s AS o FROM postings p LEFT JOIN (SELECT num, score, coalesce({_ST}, 'none') AS s FROM applications WHERE report <> '') a ON p.id = a.num)
SELECT CASE WHEN grouping(source) = 0 THEN 'source' WHEN grouping(tier) = 0 THEN 'tier' ELSE 'band' END AS dim, coalesce(source, tier, band) AS value, count(*) AS retrieved, count(o) AS tracked, count_if(o = 'Applied') AS Applied, count_if(o = 'Interview') AS Interview, count_if(o = 'Rejected') AS Rejected, {pct('count(o)', 'count(*)')} AS coverage, count(o) >= 30 AS enough FROM r GROUP BY GROUPING SETS ((source), (tier), (band))""")
def a10_by(spark, sf):
    # evaluated applications only: postings without a report are retrieved and not tracked
    a = apps(spark, sf).where("report <> ''").select(F.col("num").alias("id"), F.coalesce("state", F.lit("none")).alias("outcome"), F.when(F.col("score") >= 4, "high").when(F.col("score") >= 2.5, "mid").when(F.col("score").isNotNull(), "low").alias("band"))
    j = posts(spark, sf).select("id", "source", title.tier(F.col("title")).alias("tier")).join(a, "id", "left")
    return ag.search_quality_by(j, ["source", "tier", "band"], ["Applied", "Interview", "Rejected"])


_ORDER = ["Applied", "Responded", "Interview", "Offer", "Hired"]


@query("a11_conversions", f"WITH a AS (SELECT {_RANK(_ST)} AS r FROM applications), n AS (SELECT unnest([1, 2, 3, 4]) AS i) SELECT concat(['Applied', 'Responded', 'Interview', 'Offer', 'Hired'][i], '>', ['Applied', 'Responded', 'Interview', 'Offer', 'Hired'][i + 1]) AS hop, floor(1000.0 * (SELECT count(*) FROM a WHERE r > i) / greatest((SELECT count(*) FROM a WHERE r >= i), 1) + 0.5) / 1000 AS value FROM n")
def a11(spark, sf):
    return ag.conversions(apps(spark, sf).withColumnRenamed("state", "outcome"), _ORDER)


@query("a12_cross_tab", f"SELECT band, count_if(s = 'Interview') AS Interview, count_if(s = 'Offer') AS Offer, count_if(s = 'Rejected') AS Rejected FROM (SELECT CASE WHEN score >= 4 THEN 'high' WHEN score >= 2.5 THEN 'mid' ELSE 'low' END AS band, {_ST} AS s FROM applications) GROUP BY band")
def a12(spark, sf):
    band = F.when(F.col("score") >= 4, "high").when(F.col("score") >= 2.5, "mid").otherwise("low")
    return ag.cross_tab(apps(spark, sf).withColumn("band", band), "band", "state", ["Interview", "Offer", "Rejected"])


@query("a13_readiness", f"WITH a AS (SELECT {_ST} AS s FROM applications), g AS (SELECT unnest(['Applied', 'Rejected', 'Hired']) AS gate, unnest([500, 30, 100000]) AS least) SELECT gate, (SELECT count(*) FROM a WHERE s = gate) AS n, (SELECT count(*) FROM a WHERE s = gate) >= least AS enough FROM g UNION ALL SELECT 'kinds', count(DISTINCT s), count(DISTINCT s) >= 3 FROM a")
def a13(spark, sf):
    return ag.readiness(apps(spark, sf).withColumnRenamed("state", "outcome"), {"Applied": 500, "Rejected": 30, "Hired": 100000})


@query("a14_breakdown", f"WITH b AS (SELECT {q.tier('role')} AS tier, via, CAST(isoyear(applied) AS VARCHAR) AS year, {_RANK(_ST)} >= 3 AS g FROM applications), l AS (SELECT 'tier' AS dim, tier AS value, g FROM b UNION ALL SELECT 'via', via, g FROM b UNION ALL SELECT 'year', year, g FROM b) SELECT dim, value, count(*) AS total, count_if(g) AS positive, {pct('count_if(g)', 'count(*)')} AS conversion FROM l GROUP BY dim, value")
def a14(spark, sf):
    a = apps(spark, sf).withColumns({"tier": title.tier(F.col("role")), "year": F.extract(F.lit("YEAROFWEEK"), F.col("applied"))})
    return ag.breakdown(a, ["tier", "via", "year"], F.col("stage") >= 3)


@query("a15_frequency", f"WITH p AS (SELECT id, {q.skills('description')} AS s FROM postings), e AS (SELECT unnest(s) AS item FROM p) SELECT item, count(*) AS n, {pct('count(*)', '(SELECT count(*) FROM p)')} AS pct FROM e GROUP BY item ORDER BY n DESC, item LIMIT 15")
def a15(spark, sf):
    return ag.frequency(posts(spark, sf).withColumn("skills", skills.extract(F.col("description"))), "id", "skills", 15)


@query("a16_channels", f"WITH a AS (SELECT via, {_RANK(_ST)} >= 2 AS adv FROM applications), t AS (SELECT count(*) AS an, count_if(adv) AS aa FROM a), g AS (SELECT via, count(*) AS total, count_if(adv) AS advanced FROM a WHERE via <> '' GROUP BY via) SELECT via, total, advanced, {pct('advanced', 'total')} AS pct, {pct('total', 'an')} AS share, total >= 5 AS enough, advanced = 0 AND total >= 5 AND (aa - advanced) / greatest(an - total, 1) >= 0.1 AS dead FROM g, t")
def a16(spark, sf):
    return ag.channels(apps(spark, sf).withColumn("advanced", F.col("stage") >= 2))


@query("a17_calibration", f"WITH a AS (SELECT score, CASE WHEN {_ST} IN ('Interview', 'Offer', 'Hired') THEN true WHEN {_ST} = 'Rejected' THEN num % 3 = 0 END AS v FROM applications) SELECT CASE WHEN score < 3.5 THEN '<3.5' WHEN score < 4.0 THEN '3.5-3.9' WHEN score < 4.5 THEN '4.0-4.4' ELSE '>=4.5' END AS band, count(*) AS n, count_if(v) AS interviews, CASE WHEN count(*) >= 5 THEN {pct('count_if(v)', 'count(*)')} END AS pct FROM a WHERE v IS NOT NULL AND score > 0 GROUP BY 1")
def a17(spark, sf):
    verdict = F.when(F.col("state").isin("Interview", "Offer", "Hired"), True).when(F.col("state") == "Rejected", F.col("num") % 3 == 0)
    return ag.calibration(apps(spark, sf).withColumn("verdict", verdict))


_PAY = "SELECT l_orderkey AS num, CASE CAST(l_linenumber % 3 AS INT) WHEN 0 THEN 'advertised' WHEN 1 THEN 'actual' ELSE 'stated' END AS type, CASE CAST(l_suppkey % 4 AS INT) WHEN 0 THEN 'contract' WHEN 1 THEN 'offer-letter' WHEN 2 THEN 'verbal' ELSE 'rumour' END AS source, CAST(l_shipdate AS DATE) AS day, l_extendedprice AS value, CASE WHEN l_orderkey % 5 = 0 AND l_linenumber % 3 = 1 THEN 'EUR' ELSE 'USD' END AS currency, l_partkey AS part FROM lineitem"
_TRUST = {"contract": 3, "offer-letter": 2, "verbal": 1}


@query("a18_salary_gaps", f"""WITH p AS (SELECT *, CASE source WHEN 'contract' THEN 3 WHEN 'offer-letter' THEN 2 WHEN 'verbal' THEN 1 END AS lv FROM ({_PAY})), g AS (SELECT num, type, arg_max(value, {{'a': lv, 'b': day, 'c': value}}) AS value, arg_max(currency, {{'a': lv, 'b': day, 'c': value}}) AS currency FROM p WHERE lv IS NOT NULL GROUP BY num, type),
w AS (SELECT x.currency, CASE WHEN x.currency = y.currency THEN 100 * (x.value - y.value) / y.value END AS pct FROM g x LEFT JOIN g y ON x.num = y.num AND y.type = 'advertised' WHERE x.type = 'actual') SELECT currency, count(*) AS confirmed, round(avg(pct), 6) AS mean_pct, round(median(pct), 6) AS median_pct FROM w GROUP BY currency""")
def a18(spark, sf):
    rows = frame(spark, sf, _PAY)
    # the day alone may tie, so the value settles it here as in the SQL
    return ag.salary_gaps(rows.withColumn("day", F.struct("day", "value")), _TRUST)


@query("a19_skill_gaps", f"""WITH r AS (SELECT num, score, unnest({q.skills('description')}) AS skill FROM applications a JOIN postings p ON a.num = p.id), t AS (SELECT count(*) AS total FROM applications WHERE score < 3.5),
g AS (SELECT skill, count(*) AS reports, round(sum(coalesce(greatest(0.0::DOUBLE, 5.0 - score), 1.0)), 2) AS weight, count_if(score < 3.5) AS low_reports FROM r WHERE skill NOT IN ('Python', 'SQL') GROUP BY skill) SELECT skill, reports, weight, low_reports, CASE WHEN low_reports / total >= 0.5 AND low_reports >= 3 THEN 'Critical' WHEN low_reports / total >= 0.3 AND low_reports >= 2 THEN 'High' WHEN low_reports >= 2 THEN 'Medium' ELSE 'Low' END AS tier FROM g, t""")
def a19(spark, sf):
    p = posts(spark, sf).select(F.col("id").alias("num"), skills.extract(F.col("description")).alias("skills"))
    rows = apps(spark, sf).select("num", "score").join(p, "num")
    return ag.skill_gaps(rows, spark.createDataFrame([("Python",), ("SQL",)], "skill string"))


@query("a20_skill_coverage", f"WITH r AS (SELECT id, title, unnest({q.skills('description')}) AS skill FROM postings) SELECT id, skill, CASE WHEN skill IN ('Python', 'Kafka') THEN 'existing' WHEN contains('built sql reports and java services on docker', lower(skill)) THEN 'supported' ELSE 'gap' END AS state FROM r")
def a20(spark, sf):
    # both sides of the join read it, and skills are costly
    # explode() would infer a filter that extracts them twice
    p = stored(view(spark, sf, "postings").select("id", F.explode_outer(skills.extract(F.col("description"))).alias("skill")).where("skill is not null"))
    have = p.select("id").distinct().withColumns({"listed": F.array(F.lit("Python"), F.lit("Kafka")), "text": F.lit("Built SQL reports and Java services on Docker")})
    return ag.skill_coverage(p, have, F.col("text"))


@query("a21_friction", "WITH r AS (SELECT CASE WHEN regexp_matches(company, '[\\p{L}\\p{N}]') THEN company WHEN via <> '' THEN concat('? (via ', via, ')') END AS label, contains(notes, '#12') AS f FROM applications) SELECT lower(label) AS company, count(*) AS interviews, count_if(f) AS frictions, floor(100.0 * count_if(f) / count(*) + 0.5) / 100 AS share FROM r WHERE label IS NOT NULL GROUP BY 1")
def a21(spark, sf):
    return ag.friction(apps(spark, sf).withColumn("friction", F.contains("notes", F.lit("#12"))))


_TESTS = "SELECT l_returnflag AS platform, CAST(l_shipdate AS DATE) AS day, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS score, CASE WHEN l_linenumber = 5 THEN NULL ELSE 30.0 END AS threshold FROM lineitem"


@query("a22_assessments", f"SELECT platform, count(*) AS n, count_if(date_diff('day', day, DATE '{DAY}') > 180) AS stale, count_if(score >= threshold) AS passed, count_if(score < threshold) AS failed, count_if(score IS NULL OR threshold IS NULL) AS unknown FROM ({_TESTS}) GROUP BY platform")
def a22(spark, sf):
    return ag.assessments(frame(spark, sf, _TESTS), day())


@query("a23_digest", f"SELECT tag, count(*) AS n, count(*) >= 2 AS recurring, count(DISTINCT company) AS companies FROM (SELECT company, unnest(string_split(lower(role), ' ')) AS tag FROM applications WHERE applied BETWEEN DATE '2001-07-01' AND DATE '{DAY}') GROUP BY tag")
def a23(spark, sf):
    rows = apps(spark, sf).select(F.col("applied").alias("day"), "company", F.split(F.lower("role"), " ").alias("tags"))
    return ag.digest(rows, day("2001-07-01"), day())


_NEWS = "SELECT o_orderkey AS id, CASE CAST(o_custkey % 50 AS INT) WHEN 0 THEN 'acme' ELSE concat('firm', CAST(o_custkey % 50 AS VARCHAR(20))) END AS company_key, concat('e', CAST(o_orderkey % 4000 AS VARCHAR(20))) AS evidence, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS amount, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'seed' END AS round FROM orders WHERE o_orderpriority = '1-URGENT'"


@query("a24_funded", f"WITH o AS (SELECT company_key, evidence, min(id) AS id FROM ({_NEWS}) GROUP BY 1, 2), j AS (SELECT o.*, n.amount, n.round FROM o JOIN ({_NEWS}) n ON o.id = n.id) SELECT company_key, count(*) AS mentions, arg_min(amount, id) FILTER (WHERE amount IS NOT NULL) AS amount, arg_min(round, id) FILTER (WHERE round <> '') AS round, CAST(least(count(*), 5) * 10 + CASE WHEN count(amount) > 0 THEN 30 ELSE 0 END + CASE WHEN count(*) FILTER (WHERE round <> '') > 0 THEN 20 ELSE 0 END AS INTEGER) AS score FROM j GROUP BY company_key")
def a24(spark, sf):
    return ag.funded(frame(spark, sf, _NEWS))


@query("a25_company_cards", f"""WITH a AS (SELECT {_CK} AS company_key, {_ST} AS s, date_diff('day', applied, DATE '{DAY}') AS age FROM applications), g AS (SELECT company_key, count(*) AS applications, count_if(s = 'Applied' AND age BETWEEN 28 AND 365) AS silent, count_if(s IN ('Responded', 'Interview', 'Offer', 'Hired', 'Rejected')) AS answers FROM a GROUP BY company_key)
SELECT *, CASE WHEN answers * 2 >= applications THEN 'responsive' WHEN silent > 0 THEN 'silent' ELSE 'quiet' END AS label, CASE WHEN silent >= 2 THEN 'pattern' WHEN silent = 1 THEN 'single' ELSE 'none' END AS severity FROM g""")
def a25(spark, sf):
    return ag.company_cards(apps(spark, sf), day())


_TALK = "SELECT l_orderkey AS num, CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE l_linenumber <= 3"


@query("a26_silence", f"SELECT num, last_talk, CAST(date_diff('day', last_talk, DATE '{DAY}') AS INTEGER) AS waited FROM (SELECT a.num, max(t.day) AS last_talk FROM applications a JOIN ({_TALK}) t ON a.num = t.num WHERE {_ST} IN ('Applied', 'Responded', 'Interview') GROUP BY a.num) WHERE date_diff('day', last_talk, DATE '{DAY}') >= 30")
def a26(spark, sf):
    return ag.silence(frame(spark, sf, _TALK), apps(spark, sf), day())


@query("a27_match_matrix", "WITH m AS (SELECT CASE WHEN quality = 1 THEN 'CLEAR_MATCH' ELSE 'CLEAR_MISMATCH' END AS label, CAST(n_chars % 101 AS INTEGER) AS score FROM documents d JOIN labels l ON d.doc_id = l.doc_id), b AS (SELECT *, CASE WHEN score >= 95 THEN 'exceptional' WHEN score >= 85 THEN 'strong' WHEN score >= 75 THEN 'review' WHEN score >= 60 THEN 'weak' ELSE 'reject' END AS band FROM m) SELECT label, band, count(*) AS n, round(avg(score), 6) AS mean, list_sort(list(score))[CAST(floor(count(*) / 2) AS INT) + 1] AS upper_mid FROM b GROUP BY label, band")
def a27(spark, sf):
    m = frame(spark, sf, "SELECT CASE WHEN quality = 1 THEN 'CLEAR_MATCH' ELSE 'CLEAR_MISMATCH' END AS label, CAST(n_chars % 101 AS INT) AS score FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
    return ag.match_matrix(m.withColumn("band", money.score_band(F.col("score"))))


@query("a28_explanation_audit", _SCORES + ", r AS (SELECT s.id, unnest(string_split(reasons, ',')) AS reason FROM scored s), j AS (SELECT r.reason, CASE r.reason WHEN 'us remote' THEN p.us AND regexp_matches(p.loc, '\\bremote\\b') WHEN 'pay' THEN coalesce(p.pay_min > 0, false) ELSE coalesce(regexp_matches(lower(o.description), 'python|sql|spark|kafka'), false) END AS holds FROM r JOIN p ON r.id = p.id JOIN postings o ON o.id = p.id WHERE r.reason IN ('us remote', 'pay', 'skill')) SELECT reason, count(*) AS given, count(*) FILTER (WHERE NOT holds) AS wrong FROM j GROUP BY reason")
def a28(spark, sf):
    from joblode.operators.joins import score

    j = score(scoring(spark, sf), profiles(spark), carried=("location", "country", "pay_min", "description"))
    checks = {"us remote": (F.col("country") == "US") & F.lower("location").rlike(r"\bremote\b"), "pay": F.col("pay_min") > 0, "skill": any_of(F.col("description"), ["python", "sql", "spark", "kafka"])}
    return ag.audit_reasons(j, checks)


@query("a29_losses", f"""WITH p AS (SELECT source, location, posted, {q.canonical_key()} AS c FROM postings), m AS (SELECT c FROM p WHERE c <> '' GROUP BY c HAVING count(DISTINCT source) > 1)
SELECT source, count(*) AS n, count_if(coalesce(location, '') = '') AS no_place, count_if(posted IS NULL) AS undated, count_if(date_diff('day', posted, DATE '{DAY}') > 365) AS stale, count_if(c IN (SELECT c FROM m)) AS several FROM p GROUP BY source""")
def a29(spark, sf):
    opening = misc.canonical_key(F.col("company"), F.col("title"), F.col("location"), F.col("posted"))
    # read by both sides of a join, and keys are costly
    return ag.losses(stored(view(spark, sf, "postings").select("source", "location", F.datediff(day(), "posted").alias("age"), opening.alias("opening"))))


_SEEN = "SELECT CASE WHEN event_type = 'error' THEN 'NOT_FOUND' ELSE 'FOUND' END AS observed, CASE CAST(user_id % 4 AS INT) WHEN 0 THEN NULL WHEN 1 THEN 'NOT_FOUND' ELSE 'FOUND' END AS confirmed FROM events"


@query("a30_confusion", f"SELECT observed, count(*) AS n, count_if(observed = confirmed) AS \"right\", count_if(observed = confirmed) / count(confirmed) AS precision, count(confirmed) >= 30 AS enough FROM ({_SEEN}) GROUP BY observed")
def a30(spark, sf):
    return ag.confusion(frame(spark, sf, _SEEN))


_GOLD = "SELECT CASE WHEN quality = 1 THEN 'a' ELSE 'b' END AS label, CASE WHEN toxic = 1 THEN 'b' ELSE 'a' END AS own, CAST(quality * 4 AS DOUBLE) AS label_score, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE CAST(4 - toxic * 3 AS DOUBLE) END AS own_score FROM labels"


@query("a31_agreement", f"SELECT count(*) AS n, {pct('count_if(label = own)', 'count(*)', 1)} AS category_pct, round(avg(abs(label_score - own_score)), 6) AS mean_delta, count_if(own_score IS NULL) AS unscored, count_if(abs(label_score - own_score) <= 0.5) AS near, count_if(label = own) * 100 >= count(*) * 80 AS passes FROM ({_GOLD})")
def a31(spark, sf):
    return ag.agreement(frame(spark, sf, _GOLD))


@query("a32_density", """WITH e AS (SELECT coalesce(trim(description), '') <> '' AS has_text, coalesce(url, '') <> '' AS has_url, pay_min IS NOT NULL AS has_pay, length(coalesce(description, '')) AS len FROM postings), t AS (SELECT count(*) AS n, count_if(has_text) AS c1, count_if(has_url) AS c2, count_if(has_pay) AS c3, round(avg(len), 6) AS mean_length, CAST(list_sort(list(len))[CAST(floor(count(*) / 2) AS INT) + 1] AS INTEGER) AS mid_length FROM e)
SELECT unnest(['has_text', 'has_url', 'has_pay']) AS signal, unnest([floor(1000.0 * c1 / n + 0.5) / 10, floor(1000.0 * c2 / n + 0.5) / 10, floor(1000.0 * c3 / n + 0.5) / 10]) AS pct, mean_length, mid_length FROM t""")
def a32(spark, sf):
    e = misc.evidence(posts(spark, sf)).withColumn("len", F.length(F.coalesce("description", F.lit(""))))
    return ag.density(e, ["has_text", "has_url", "has_pay"], "len")


@query("a33_dashboard", f"""WITH b AS (SELECT {q.tier('title')} AS tier, {q.workplace('location', 'title')} AS mode, coalesce(location, '') AS place, pay_min AS pay FROM postings), l AS (SELECT 'tier' AS dim, tier AS value, pay FROM b UNION ALL SELECT 'mode', mode, pay FROM b UNION ALL SELECT 'place', place, pay FROM b),
g AS (SELECT dim, value, count(*) AS n, median(pay) AS mid_pay FROM l GROUP BY dim, value), r AS (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY n DESC, value) AS r FROM g) SELECT dim, value, n, mid_pay FROM r WHERE dim <> 'place' OR r <= 8""")
def a33(spark, sf):
    p = posts(spark, sf).select(title.tier(F.col("title")).alias("tier"), place.workplace(F.col("location"), F.col("title")).alias("mode"), F.coalesce("location", F.lit("")).alias("place"), F.col("pay_min").alias("pay"))
    return ag.dashboard(p)


_USE = "SELECT CASE CAST(l_partkey % 3 AS INT) WHEN 0 THEN 'big' WHEN 1 THEN 'small' ELSE 'other' END AS model, l_linenumber AS step, CAST(floor(l_quantity) AS BIGINT) AS input, CAST(floor(l_quantity) AS BIGINT) * 2 AS output, floor(l_quantity) / 4 AS cost FROM lineitem"


@query("a34_usage", f"SELECT model, step, CAST(sum(input + output) AS BIGINT) AS tokens, round(sum(cost), 4) AS cost FROM ({_USE}) GROUP BY ROLLUP (model, step)")
def a34(spark, sf):
    return ag.usage(frame(spark, sf, _USE))


_AGING = "SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 900 AS INT) END AS next_day FROM orders"


@query("a35_table_freshness", f"SELECT id, CASE WHEN next_day <= DATE '{DAY}' THEN 'expired' WHEN day + INTERVAL 12 MONTH <= DATE '{DAY}' THEN 'review' ELSE 'ok' END AS finding FROM ({_AGING})")
def a35(spark, sf):
    return ag.table_freshness(frame(spark, sf, _AGING), day())


@query("a36_search_evaluation", _SCORES + "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY profile_id ORDER BY n DESC, item) AS INTEGER) AS rank FROM (SELECT profile_id, item, count(*) AS n FROM (SELECT profile_id, unnest(string_split(penalties, ',')) AS item FROM scored) WHERE item <> '' GROUP BY 1, 2)) WHERE rank <= 15")
def a36(spark, sf):
    from joblode.operators.joins import score

    return ag.search_evaluation(score(scoring(spark, sf), profiles(spark)), "penalties")


@query("a37_benchmark", f"WITH a AS (SELECT {_RANK(_ST)} AS r FROM applications), o AS (SELECT 'response_rate' AS metric, {pct('count_if(r >= 2)', 'count_if(r >= 1)', 1)} AS pct, count_if(r >= 1) AS n FROM a UNION ALL SELECT 'interview_rate', {pct('count_if(r >= 3)', 'count_if(r >= 1)', 1)}, count_if(r >= 1) FROM a), b(metric, low, high, typical) AS (VALUES ('response_rate', 10.0, 20.0, 15.0), ('interview_rate', 5.0, 90.0, 8.0)) SELECT o.metric, pct, CASE WHEN pct < low THEN 'below-range' WHEN pct > high THEN 'above-range' ELSE 'within-range' END AS band, floor(pct / typical * 10 + 0.5) / 10 AS times, n < 20 AS small FROM o JOIN b ON o.metric = b.metric")
def a37(spark, sf):
    n = lambda i: F.count_if(F.col("stage") >= i)
    one = apps(spark, sf).agg(n(1).alias("n"), ag.rate(n(2), n(1), 1).alias("r"), ag.rate(n(3), n(1), 1).alias("i"))
    own = one.select("n", F.explode(F.array(F.struct(F.lit("response_rate").alias("metric"), F.col("r").alias("pct")), F.struct(F.lit("interview_rate").alias("metric"), F.col("i").alias("pct")))).alias("m")).select("n", "m.*")
    return ag.against_benchmark(own, spark.createDataFrame([("response_rate", 10.0, 20.0, 15.0), ("interview_rate", 5.0, 90.0, 8.0)], "metric string, low double, high double, typical double"))
