"""Queries of the ordered groups (G1 to G12), lists (K1 to K8) and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from joblode.functions import company as co, status, title
from joblode.functions.text import words_only
from joblode.operators import ranking as ra, windows as wi
from joblode.operators.survivors import dedup_applications
from joblode.plans import sql as q
from joblode.plans.adapters import frame, view
from joblode.plans.aggregating import apps, day, posts
from joblode.plans.registry import query

DAY = "2001-08-01"
_ST = q.status("status_text")
_HEALTH_BAD = "status NOT IN ('reachable', 'empty')"


@query("g01_repost_clusters")
def g01(spark, sf):
    p = posts(spark, sf).select("company_key", title.title_identity(F.col("title")).alias("title_key"), F.coalesce("url", F.lit("")).alias("url"), F.col("posted").alias("day"))
    return wi.repost_clusters(p.where("company_key <> 'linkedin jobs'"))


#: Ranks of states that decide which of two rows of one opening is further.
_FURTHER = {"Discarded": 0, "SKIP": 0, "Rejected": 1, "Evaluated": 2, "Applied": 3, "Responded": 4, "Interview": 5, "Offer": 6, "Hired": 7}


@query("g02_application_dedup", f"""WITH a AS (SELECT num, CASE WHEN trim(company) = '?' THEN concat('via:', lower(trim(coalesce(via, '')))) ELSE {q.company_key('company')} END AS owner, trim(company) = '?' AS blind, lower(trim(regexp_replace(role, '\\s+', ' ', 'g'))) AS role,
 try_cast(nullif(regexp_extract(report, '[0-9]+'), '') AS BIGINT) AS report, score, {_ST} AS status, coalesce(CAST({q.case_map(_ST, {k: str(v) for k, v in _FURTHER.items()})} AS INTEGER), 0) AS stage, trim(coalesce(notes, '')) AS notes, applied AS day FROM applications),
l AS (SELECT owner, list({{'num': num, 'role': role, 'report': report, 'adv': stage >= 3, 'blind': blind, 'day': day}} ORDER BY num) AS rows FROM a GROUP BY owner),
f AS (SELECT list_reduce(rows, lambda s, x: {{'a': CASE WHEN len(list_filter(s.a, lambda y: (y.report = x.report OR (y.role = x.role AND NOT y.adv AND NOT x.adv)) AND (NOT x.blind OR abs(date_diff('day', y.day, x.day)) <= 90))) > 0 THEN s.a ELSE list_append(s.a, x) END,
 'o': list_append(s.o, {{'num': x.num, 'anchor': coalesce(list_filter(s.a, lambda y: (y.report = x.report OR (y.role = x.role AND NOT y.adv AND NOT x.adv)) AND (NOT x.blind OR abs(date_diff('day', y.day, x.day)) <= 90))[1].num, x.num)}})}},
 {{'a': []::STRUCT(num BIGINT, role VARCHAR, report BIGINT, adv BOOLEAN, blind BOOLEAN, day DATE)[], 'o': []::STRUCT(num BIGINT, anchor BIGINT)[]}}).o AS o FROM l),
c AS (SELECT a.*, v.anchor FROM a JOIN (SELECT unnest(o, max_depth := 2) FROM f) v ON a.num = v.num),
k AS (SELECT anchor, count(*) AS n, list({{'num': num, 'score': score, 'notes': notes, 'status': status, 'stage': stage}} ORDER BY coalesce(score, 0) DESC, num) AS rows FROM c GROUP BY anchor)
SELECT rows[1].num AS num, n, rows[1].score AS score, list_filter(rows, lambda x: x.stage = list_max(list_transform(rows, lambda y: y.stage)))[1].status AS status, anchor,
 list_reduce(list_filter(list_transform(rows[2:], lambda x: x.notes), lambda x: x NOT IN ('', 'N/A', '❌', 'pending', '-')), lambda m, x: CASE WHEN contains(m, x) THEN m WHEN m IN ('', 'N/A', '-') THEN x ELSE concat(m, '; ', x) END, rows[1].notes) AS notes FROM k""")
def g02(spark, sf):
    label, _ = status.canonical(F.col("status_text"))
    further = F.create_map(*[F.lit(x) for kv in _FURTHER.items() for x in kv])
    a = view(spark, sf, "applications").withColumns({"company_key": co.company_key(F.col("company")), "status": label, "stage": F.coalesce(F.element_at(further, label), F.lit(0)), "report": F.regexp_extract("report", "([0-9]+)", 1).try_cast("long")})
    return dedup_applications(a.select(F.col("num").alias("seq"), "num", "company", "company_key", "via", "role", "report", "score", "status", "stage", "notes", F.col("applied").alias("day")))


_FOLDED = """WITH e AS (SELECT num, list([{'state': state, 'day': day, 'counts': source IN ('manual', 'agent', 'correction'), 'fix': source = 'correction'}] ORDER BY seq) AS log FROM ledger GROUP BY num),
f AS (SELECT num, list_reduce(list_concat([[]], log), lambda a, x: CASE WHEN x[1].state = '-' THEN a[1:len(a) - 1] WHEN x[1].fix AND list_contains(list_transform(a, lambda y: y.state), x[1].state)
  THEN list_concat(list_concat(a[1:len(a) - list_position(list_reverse(list_transform(a, lambda y: y.state)), x[1].state)], x), a[len(a) - list_position(list_reverse(list_transform(a, lambda y: y.state)), x[1].state) + 2:]) ELSE list_concat(a, x) END) AS t FROM e),
n AS (SELECT num, list_sort(list_transform(t, lambda x, i: {'day': x.day, 'i': i, 'state': x.state, 'counts': x.counts})) AS t FROM f)
"""


@query("g03_ledger_fold", _FOLDED + "SELECT num, CAST(len(t) AS INTEGER) AS n, array_to_string(list_transform(t, lambda x: concat(strftime(x.day, '%m%d'), substr(x.state, 1, 3), CASE WHEN x.counts THEN '+' ELSE '-' END)), ' ') AS timeline FROM n")
def g03(spark, sf):
    folded = wi.fold_ledger(view(spark, sf, "ledger"))
    return folded.select("num", F.size("timeline").alias("n"), F.array_join(F.transform("timeline", lambda x: F.concat(F.date_format(x["day"], "MMdd"), F.substring(x["state"], 1, 3), F.when(x["counts"], "+").otherwise("-"))), " ").alias("timeline"))


_VELOCITY = """, hops(a, b) AS (VALUES ('Applied', 'Responded'), ('Responded', 'Interview'), ('Interview', 'Offer'), ('Applied', 'Rejected')),
h AS (SELECT t, a, b, list_position(list_transform(t, lambda x: x.state = a AND x.counts), true) AS k FROM n, hops), d AS (SELECT *, date_diff('day', t[k].day, list_filter(t[k + 1:], lambda x: x.state = b AND x.counts)[1].day) AS days FROM h WHERE k IS NOT NULL AND k > 0),
g AS (SELECT concat(a, '>', b) AS hop, count(*) FILTER (WHERE days > 0) AS n, median(days) FILTER (WHERE days > 0) AS m, quantile_cont(days, 0.75) FILTER (WHERE days > 0) AS q, count(*) FILTER (WHERE days = 0) AS same_day, count(*) FILTER (WHERE days IS NULL AND k = len(t) AND b <> 'Rejected') AS censored FROM d GROUP BY 1)
SELECT hop, n, CASE WHEN n >= 3 THEN m END AS median, CASE WHEN n >= 3 THEN q END AS p75, same_day, censored FROM g"""


@query("g04_stage_velocity", _FOLDED + _VELOCITY)
def g04(spark, sf):
    return wi.stage_velocity(wi.fold_ledger(view(spark, sf, "ledger")))


@query("g05_failure_streak", f"WITH l AS (SELECT portal, max(CASE WHEN NOT ({_HEALTH_BAD}) THEN seq END) AS last FROM health GROUP BY portal) SELECT l.portal, count(h.seq) AS streak FROM l LEFT JOIN health h ON h.portal = l.portal AND (l.last IS NULL OR h.seq > l.last) GROUP BY l.portal")
def g05(spark, sf):
    return wi.trailing_streak(view(spark, sf, "health"), "portal", "seq", F.col("status").isin("reachable", "empty"))


@query("g06_not_found_streak", "WITH h AS (SELECT * FROM health WHERE portal % 4 <> 3), l AS (SELECT portal, max(CASE WHEN status <> 'error' THEN seq END) AS last FROM h GROUP BY portal) SELECT l.portal, count(h.seq) AS streak FROM l LEFT JOIN h ON h.portal = l.portal AND (l.last IS NULL OR h.seq > l.last) GROUP BY l.portal")
def g06(spark, sf):
    return wi.trailing_streak(view(spark, sf, "health").where("portal % 4 <> 3"), "portal", "seq", F.col("status") != "error")


@query("g07_latest", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def g07(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return wi.latest(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("g08_recent", "SELECT user_id, array_to_string(list(event_type ORDER BY event_id), ',') AS recent FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 10 GROUP BY user_id")
def g08(spark, sf):
    return wi.recent(spark.read.parquet(f"{sf}/events.parquet"), "user_id", "event_id", "event_type", 10).select("user_id", F.array_join("values", ",").alias("recent"))


_SPANS = "SELECT o_custkey AS person, 1980 + CAST(o_orderkey % 30 AS INT) AS begin, 1980 + CAST(o_orderkey % 30 AS INT) + CAST(o_orderkey % 5 AS INT) AS \"end\" FROM orders"


@query("g09_merged_years", f"WITH s AS (SELECT * FROM ({_SPANS}) WHERE \"end\" > begin), w AS (SELECT *, max(\"end\") OVER (PARTITION BY person ORDER BY begin, \"end\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s) SELECT person, CAST(sum(greatest(0, \"end\" - greatest(begin, coalesce(reach, begin)))) AS BIGINT) AS years FROM w GROUP BY person")
def g09(spark, sf):
    return wi.merged_years(frame(spark, sf, _SPANS.replace('"', "`")), "person")


@query("g10_last_wins", "SELECT c_mktsegment AS k, max_by(c_name, c_custkey) AS name, max(c_custkey) AS line, count(*) - 1 AS replaced FROM customer GROUP BY 1 UNION ALL SELECT concat('x', CAST(s_nationkey AS VARCHAR)), max_by(s_name, s_suppkey), max(s_suppkey), count(*) - 1 FROM supplier GROUP BY 1")
def g10(spark, sf):
    rows = frame(spark, sf, "SELECT c_mktsegment AS k, c_name AS name, c_custkey AS line FROM customer UNION ALL SELECT concat('x', CAST(s_nationkey AS STRING)), s_name, s_suppkey FROM supplier")
    return wi.last_wins(rows, "k", "line")


@query("g11_status_changes", "SELECT portal, seq, before, status FROM (SELECT *, lag(status) OVER (PARTITION BY portal ORDER BY seq) AS before FROM health) WHERE before IS NULL OR before <> status")
def g11(spark, sf):
    return wi.status_changes(view(spark, sf, "health"), "portal", "seq", "status").select("portal", "seq", "before", "status")


_H1 = "SELECT CAST(o_custkey % 3 AS INT) AS profile_id, o_orderkey AS id, CAST(o_orderkey % 90 AS INT) AS score, o_orderpriority AS hash, CAST(o_orderdate AS DATE) AS first_seen FROM orders WHERE o_orderkey % 3 <> 0"
_H2 = "SELECT CAST(o_custkey % 3 AS INT) AS profile_id, o_orderkey AS id, CAST(o_custkey % 90 AS INT) AS score, CASE WHEN o_orderkey % 4 = 0 THEN 'x' ELSE o_orderpriority END AS hash FROM orders WHERE o_orderkey % 5 <> 0"


@query("g12_match_history", f"SELECT coalesce(a.profile_id, b.profile_id) AS profile_id, coalesce(a.id, b.id) AS id, coalesce(b.score, a.score) AS score, coalesce(first_seen, DATE '{DAY}') AS first_seen, coalesce(a.hash <> b.hash, false) AS changed, coalesce(b.score > a.score, false) AS improved FROM ({_H1}) a FULL OUTER JOIN ({_H2}) b ON a.profile_id = b.profile_id AND a.id = b.id")
def g12(spark, sf):
    return wi.upsert_history(frame(spark, sf, _H1), frame(spark, sf, _H2), day())


_CAND = f"SELECT num AS id, {_ST} IN ('Applied', 'Interview') AS acted, CAST(num * 37 % 101 AS INTEGER) AS score, num % 7 = 0 AS changed, CAST(num % 40 AS INTEGER) AS age FROM applications"


@query("k01_verification_candidates", f"SELECT id, tier, score FROM (SELECT *, CASE WHEN coalesce(acted, false) THEN 0 WHEN score >= 85 THEN 1 WHEN changed THEN 2 WHEN age >= 23 THEN 3 ELSE 4 END AS tier FROM ({_CAND})) ORDER BY tier, score DESC, id LIMIT 5000")
def k01(spark, sf):
    a = apps(spark, sf).select(F.col("num").alias("id"), F.coalesce(F.col("state").isin("Applied", "Interview"), F.lit(False)).alias("acted"), (F.col("num") * 37 % 101).cast("int").alias("score"), (F.col("num") % 7 == 0).alias("changed"), (F.col("num") % 40).cast("int").alias("age"))
    return ra.verification_candidates(a, 5000).select("id", "tier", "score")


_FU = f"SELECT a.num, {_ST} AS state, applied, f.last, coalesce(f.n, 0) AS n FROM applications a LEFT JOIN (SELECT l_orderkey AS num, max(CAST(l_shipdate AS DATE)) AS last, count(*) AS n FROM lineitem WHERE l_linenumber <= 2 AND l_shipdate <= TIMESTAMP '2001-08-01' GROUP BY 1) f ON f.num = a.num"


_PINS = "SELECT o_orderkey AS num, o_custkey AS seq, CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS DATE) AS set_day FROM orders WHERE o_orderkey % 4 = 1"
_OFF = "SELECT o_orderkey AS num, o_custkey AS seq, CAST(o_orderdate AS DATE) AS set_day FROM orders WHERE o_orderkey % 9 = 2"


@query("k02_followups", f"""WITH x AS (SELECT *, date_diff('day', applied, DATE '{DAY}') AS since, date_diff('day', last, DATE '{DAY}') AS touch FROM ({_FU}) WHERE state IN ('Applied', 'Responded', 'Interview')),
p AS (SELECT num, arg_max(day, seq) AS day, arg_max(set_day, seq) AS set_day FROM ({_PINS}) GROUP BY num), o AS (SELECT num, arg_max(set_day, seq) AS set_day FROM ({_OFF}) GROUP BY num),
y AS (SELECT x.num, CASE state WHEN 'Applied' THEN CASE WHEN n >= 2 THEN 'cold' WHEN n = 0 AND since >= 7 THEN 'overdue' WHEN n > 0 AND touch >= 7 THEN 'overdue' ELSE 'waiting' END WHEN 'Responded' THEN CASE WHEN last IS NOT NULL THEN CASE WHEN touch >= 3 THEN 'overdue' ELSE 'waiting' END WHEN since < 1 THEN 'urgent' WHEN since >= 3 THEN 'overdue' ELSE 'waiting' END ELSE CASE WHEN last IS NOT NULL THEN CASE WHEN touch >= 3 THEN 'overdue' ELSE 'waiting' END WHEN since >= 1 THEN 'overdue' ELSE 'waiting' END END AS urgency,
 CASE WHEN state = 'Applied' THEN CASE WHEN n < 2 THEN CASE WHEN n > 0 THEN coalesce(last, applied) ELSE applied END + 7 END ELSE coalesce(last + 3, applied + 1) END AS next_day, p.day AS pin, coalesce(last <= p.set_day, p.day IS NOT NULL) AND p.day IS NOT NULL AS pinned, o.set_day IS NOT NULL AND coalesce(last <= o.set_day, true) AS off
 FROM x LEFT JOIN p ON x.num = p.num LEFT JOIN o ON x.num = o.num)
SELECT num, CASE WHEN pinned THEN CASE WHEN pin <= DATE '{DAY}' THEN 'overdue' ELSE 'waiting' END ELSE urgency END AS urgency, CASE WHEN pinned THEN pin ELSE next_day END AS next_day FROM y WHERE NOT off""")
def k02(spark, sf):
    f = frame(spark, sf, "SELECT l_orderkey AS num, max(CAST(l_shipdate AS DATE)) AS last, count(*) AS n FROM lineitem WHERE l_linenumber <= 2 AND l_shipdate <= TIMESTAMP '2001-08-01' GROUP BY 1")
    a = apps(spark, sf).select("num", "state", "applied").join(f, "num", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return ra.followups(a, day(), frame(spark, sf, _PINS), frame(spark, sf, _OFF))


@query("k03_waiting", f"SELECT a.num, CAST(date_diff('day', coalesce(l.day, applied), DATE '{DAY}') AS INTEGER) AS waited, date_diff('day', coalesce(l.day, applied), DATE '{DAY}') > 14 AS beyond FROM applications a LEFT JOIN (SELECT num, min(day) AS day FROM ledger WHERE state = 'Applied' GROUP BY num) l ON a.num = l.num WHERE {_ST} = 'Applied'")
def k03(spark, sf):
    return ra.waiting(apps(spark, sf), view(spark, sf, "ledger"), day())


_FEED = {"NEW": "o_orderkey % 5 = 0", "CHANGED": "o_orderkey % 7 = 0", "MATCH_IMPROVED": "o_orderkey % 11 = 0", "STALE": "o_orderstatus = 'F' AND o_orderkey % 3 = 0"}
_MATCHES = "SELECT l_partkey AS id, l_suppkey % 6 AS profile_id, CAST(l_orderkey * 37 % 101 AS INT) AS score, CAST(l_shipdate AS DATE) AS day FROM lineitem"
_ACTED = "SELECT o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT'"
_FEED_SQL = f"""SELECT * FROM ({' UNION ALL '.join(f"SELECT '{k}' AS kind, o_orderkey AS id, CAST(o_orderdate AS DATE) AS day FROM orders WHERE {w}" for k, w in _FEED.items())}) WHERE kind <> 'STALE' OR id NOT IN (SELECT id FROM ({_ACTED}))
 UNION ALL SELECT 'PROFILE_MULTI', id, max(day) FROM ({_MATCHES}) WHERE score >= 75 GROUP BY id HAVING count(DISTINCT profile_id) >= 2"""


def _feed(spark, sf):
    parts = {k: frame(spark, sf, f"SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day FROM orders WHERE {w}") for k, w in _FEED.items()}
    return ra.change_feed(parts["NEW"], parts["CHANGED"], parts["MATCH_IMPROVED"], ra.strong_in_several(frame(spark, sf, _MATCHES)), parts["STALE"], frame(spark, sf, _ACTED))


@query("k04_change_feed", _FEED_SQL)
def k04(spark, sf):
    return _feed(spark, sf)


@query("k04_feed_counts", f"WITH f AS ({_FEED_SQL}), k AS (SELECT unnest(['NEW', 'CHANGED', 'MATCH_IMPROVED', 'PROFILE_MULTI', 'STALE', 'total']) AS kind) SELECT kind, (SELECT count(*) FROM f WHERE f.kind = k.kind OR k.kind = 'total') AS n FROM k")
def k04_counts(spark, sf):
    return ra.feed_counts(_feed(spark, sf))


_WORDS = lambda x: f"list_distinct(list_filter(string_split({q.words_only(x)}, ' '), lambda w: length(w) > 2))"


@query("k05_story_ranking", f"""WITH s AS (SELECT doc_id AS story_id, {_WORDS("concat_ws(' ', source, 'story')")} AS g, {_WORDS("concat_ws(' ', lang, 'src3', 'report')")} AS t, {_WORDS('text')} AS b FROM documents),
w AS (SELECT story_id, w, sum(p) AS p FROM (SELECT story_id, unnest(g) AS w, 3 AS p FROM s UNION ALL SELECT story_id, unnest(t), 2 FROM s UNION ALL SELECT story_id, unnest(b), 1 FROM s) GROUP BY 1, 2),
q AS (SELECT item_id AS question_id, unnest({_WORDS("text || ' tell about src3'")}) AS w FROM benchmark), g AS (SELECT question_id, story_id, sum(p) AS points FROM q JOIN w USING (w) WHERE w NOT IN ({q.strings(ra.STOPWORDS)}) GROUP BY 1, 2),
r AS (SELECT question_id, story_id, CAST(points + CASE WHEN len(list_intersect(s.g, ['src1', 'src5'])) > 0 THEN 2 ELSE 0 END AS BIGINT) AS points FROM g JOIN s USING (story_id))
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY points DESC, story_id) AS INTEGER) AS rank FROM r) WHERE rank <= 3""")
def k05(spark, sf):
    words = lambda c: F.array_distinct(F.filter(F.split(words_only(c), " "), lambda w: F.length(w) > 2))
    stories = frame(spark, sf, "SELECT * FROM documents").select(F.col("doc_id").alias("story_id"), F.array(words(F.concat_ws(" ", "source", F.lit("story")))).alias("tags"), words(F.concat_ws(" ", "lang", F.lit("src3"), F.lit("report"))).alias("title_words"), words(F.col("text")).alias("body_words"))
    questions = frame(spark, sf, "SELECT * FROM benchmark").select(F.col("item_id").alias("question_id"), words(F.concat("text", F.lit(" tell about src3"))).alias("words"))
    return ra.rank_stories(questions, stories, ["src1", "src5", "about"])


@query("k06_extremes", "SELECT event_type, id, score, CASE WHEN best <= 3 THEN 'strong' ELSE 'weak' END AS side FROM (SELECT event_type, event_id AS id, value AS score, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS best, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS worst FROM events) WHERE best <= 3 OR worst <= 3")
def k06(spark, sf):
    return ra.extremes(frame(spark, sf, "SELECT event_type, event_id AS id, value AS score FROM events"), "event_type", "score")


@query("k07_next_batch", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 200")
def k07(spark, sf):
    return ra.next_batch(frame(spark, sf, "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O'"), "id", 500)


@query("k08_whats_new", "WITH n AS (SELECT concat('u', CAST(l_partkey AS VARCHAR)) AS url, max(CAST(l_shipdate AS DATE)) AS day FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-10-01' GROUP BY 1) SELECT url, day, (SELECT count(*) FROM n) AS total FROM n ORDER BY day DESC, url LIMIT 24")
def k08(spark, sf):
    return ra.whats_new(frame(spark, sf, "SELECT concat('u', CAST(l_partkey AS STRING)) AS url, CAST(l_shipdate AS DATE) AS day FROM lineitem"), day("2001-10-01"))


@query("u01_seen_union", "SELECT DISTINCT key FROM (SELECT l_partkey AS key FROM lineitem WHERE l_quantity > 40 UNION ALL SELECT p_partkey FROM part WHERE p_size < 5 UNION ALL SELECT o_custkey FROM orders)")
def u01(spark, sf):
    return ra.union_seen(*[frame(spark, sf, s) for s in ("SELECT l_partkey AS key FROM lineitem WHERE l_quantity > 40", "SELECT p_partkey AS key FROM part WHERE p_size < 5", "SELECT o_custkey AS key FROM orders")])


_RUN = lambda n: f"SELECT l_partkey AS id FROM lineitem WHERE l_linenumber = {n} AND l_quantity > 30"


@query("u02_run_sets", f"SELECT 'gone' AS side, id FROM ({_RUN(1)} EXCEPT {_RUN(2)}) UNION ALL SELECT 'both', id FROM ({_RUN(1)} INTERSECT {_RUN(2)})")
def u02(spark, sf):
    a, b = frame(spark, sf, _RUN(1)), frame(spark, sf, _RUN(2))
    return a.subtract(b).select(F.lit("gone").alias("side"), "id").union(a.intersect(b).select(F.lit("both"), "id"))


_PLAN = "SELECT c_custkey AS profile_id, c_mktsegment AS a, concat(' ', c_mktsegment, ' Engineer!') AS b, CASE WHEN c_custkey % 3 = 0 THEN 'Data  Engineer' ELSE '' END AS c FROM customer"


@query("u03_query_plan", f"WITH e AS (SELECT profile_id, trim(regexp_replace(lower(unnest([a, b, c])), '[^a-z0-9+#]+', ' ', 'g')) AS query FROM ({_PLAN})) SELECT query, count(DISTINCT profile_id) AS profiles, regexp_extract(query, '([^ ]+)$', 1) AS family FROM e WHERE query <> '' GROUP BY query")
def u03(spark, sf):
    return ra.query_plan(frame(spark, sf, _PLAN).select("profile_id", F.array("a", "b", "c").alias("queries")))


@query("u04_evidence_union", "WITH a AS (SELECT o_custkey AS k, list(DISTINCT o_orderpriority) AS s FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey AS k, list(DISTINCT o_orderpriority) AS s FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, array_to_string(list_sort(list_distinct(list_concat(coalesce(a.s, []), coalesce(b.s, [])))), ',') AS items FROM a FULL OUTER JOIN b ON a.k = b.k")
def u04(spark, sf):
    part = lambda n: frame(spark, sf, f"SELECT * FROM orders WHERE o_orderkey % {n} = 0").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set("o_orderpriority").alias("items"))
    return ra.merged_evidence(part(2), part(3), "k", "items").withColumn("items", F.array_join("items", ","))
