"""Queries of the joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from joblode.functions import company as co, misc, place, status, text, title
from joblode.operators import joins as jo, similarity
from joblode.plans import sql as q
from joblode.plans.adapters import frame, pick, view
from joblode.plans.registry import query
from joblode.store import stored

DAY = "2001-08-01"
_BATCH = "SELECT o_orderkey AS id, concat('u', CAST((o_orderkey * 17) % 9000 AS VARCHAR(20))) AS key FROM orders"
_HISTORY = "SELECT concat('u', CAST(l_orderkey AS VARCHAR(20))) AS key, CASE CAST(l_linenumber % 4 AS INT) WHEN 0 THEN 'added' WHEN 1 THEN 'cooldown' WHEN 2 THEN 'added' ELSE CASE WHEN l_orderkey % 9 = 0 THEN 'expired' ELSE 'added' END END AS status, CAST(l_shipdate AS DATE) AS day, CAST(l_shipdate AS DATE) AS until FROM lineitem"


def day():
    return F.lit(DAY).cast("date")


@query("j01_unseen_urls", f"SELECT id, key FROM ({_BATCH}) WHERE key NOT IN (SELECT key FROM ({_HISTORY}) WHERE CASE status WHEN 'added' THEN date_diff('day', day, DATE '{DAY}') < 30 WHEN 'cooldown' THEN until > DATE '{DAY}' ELSE true END)")
def j01(spark, sf):
    return jo.unseen(frame(spark, sf, _BATCH), frame(spark, sf, _HISTORY), day()).select("id", "key")


_ALIASES = "SELECT CASE CAST(s_suppkey % 3 AS INT) WHEN 0 THEN 'globex technology' WHEN 1 THEN 'apex staffing' ELSE 'stark' END AS alias, CASE WHEN s_suppkey % 3 = 2 AND s_suppkey % 2 = 0 THEN 'wayne' ELSE CASE CAST(s_suppkey % 3 AS INT) WHEN 0 THEN 'globex' WHEN 1 THEN 'apex' ELSE 'stark' END END AS company_key FROM supplier"
_OLD = "posted < DATE '1998-01-01'"


@query("j02_unseen_roles", f"""WITH one AS (SELECT alias, min(company_key) AS target FROM ({_ALIASES}) GROUP BY alias HAVING count(DISTINCT company_key) = 1),
p AS (SELECT id, posted, {q.company_key('company')} AS k, {q.words_only('title')} AS role_key FROM postings), n AS (SELECT p.*, coalesce(target, k) AS kk FROM p LEFT JOIN one ON p.k = one.alias)
SELECT id, kk AS company_key, role_key FROM n WHERE posted >= DATE '1998-01-01' AND NOT EXISTS (SELECT 1 FROM n h WHERE h.kk = n.kk AND h.role_key = n.role_key AND h.{_OLD})""")
def j02(spark, sf):
    p = view(spark, sf, "postings").select("id", "posted", co.company_key(F.col("company")).alias("company_key"), text.words_only(F.col("title")).alias("role_key"))
    found = jo.unseen_roles(p.where("posted >= DATE '1998-01-01'").drop("posted"), p.where(_OLD).drop("posted"), frame(spark, sf, _ALIASES))
    return found.select("id", F.col("k").alias("company_key"), "role_key")


_LISTED = "SELECT doc_id AS id, text, source AS company, concat('u', CAST(doc_id AS VARCHAR(20))) AS url, CAST(DATE '2024-01-01' + CAST(doc_id % 300 AS INT) AS DATE) AS day FROM documents"


@query("j03_cross_listings", q.FINGERPRINTS + f""", r AS (SELECT id, coalesce(fingerprint, '') AS fingerprint, ('0x' || fingerprint)::UBIGINT AS v, company, url, day FROM ({_LISTED}) d LEFT JOIN fps f ON d.id = f.doc_id),
l AS (SELECT a.id, count(*) AS n_links, CAST(min(bit_count(xor(a.v, b.v)::BIT)) AS INTEGER) AS least_distance FROM r a JOIN r b ON a.company <> b.company AND a.url <> b.url AND abs(date_diff('day', a.day, b.day)) <= 90 AND bit_count(xor(a.v, b.v)::BIT) <= 5 GROUP BY 1)
SELECT r.id, fingerprint, coalesce(n_links, 0) AS n_links, least_distance FROM r LEFT JOIN l ON r.id = l.id""")
def j03(spark, sf):
    # a row for every document: its class, its links to all other documents, none left out
    docs = frame(spark, sf, _LISTED).withColumn("fingerprint", similarity.sha_simhash(F.col("text")))
    listed = stored(docs.select("id", "fingerprint", "company", "url", "day"))
    links = similarity.cross_listings(listed).drop("fingerprint")
    return listed.select("id", "fingerprint").join(links, "id", "left").select("id", "fingerprint", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "least_distance")


@query("j03_link_classes", q.FINGERPRINTS + """, z AS (SELECT fingerprint, ('0x' || fingerprint)::UBIGINT AS v, count(*) AS n FROM fps GROUP BY ALL)
SELECT a.fingerprint AS fp_a, b.fingerprint AS fp_b, CAST(bit_count(xor(a.v, b.v)::BIT) AS INTEGER) AS distance, a.n AS n_a, b.n AS n_b FROM z a JOIN z b ON a.fingerprint <= b.fingerprint AND bit_count(xor(a.v, b.v)::BIT) <= 5""")
def j03_classes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return similarity.link_classes(docs.select(similarity.sha_simhash(F.col("text")).alias("fingerprint")))


def profiles(spark):
    """Three career profiles: small, explicit requests."""
    split = lambda xs: [[t for t in x.lower().split(" ") if len(t) > 1] for x in xs]
    rows = [
        (1, split(["Data Engineer", "Software Engineer"]), split(["Python", "SQL", "Apache Spark", "Kafka"]), split(["cloud products", "platform services"]), split(["lead team"]), ["sales", "intern"], "senior", 9, 60000.0),
        (2, split(["Product Manager"]), split(["SQL"]), [], [], ["contract"], "manager", 6, 0.0),
        (3, [], [], split(["machine learning"]), [], [], "", None, 30000.0),
    ]
    return spark.createDataFrame(rows, "profile_id int, roles array<array<string>>, skills array<array<string>>, areas array<array<string>>, leadership array<array<string>>, exclusions array<string>, seniority string, years int, pay double")


def scoring(spark, sf):
    p = view(spark, sf, "postings")
    _, _, country = place.city_state_country(F.col("location"))
    p = p.select("id", "title", "description", F.coalesce("company", F.lit("")).alias("company"), F.coalesce("location", F.lit("")).alias("location"), country.alias("country"), place.employment(F.concat_ws(" ", "title", "description")).alias("employment"), "pay_min", "posted", "source")
    return p


_TK = lambda x: f"list_filter(string_split_regex(lower({x}), '[^a-z0-9+#]+'), lambda t: length(t) > 1)"
_PART = lambda t, hay: f"(len(list_filter({t}, lambda x: list_contains({hay}, x))) / len({t}))"
_FRAC = lambda t, hay: f"CASE WHEN len({t}) = 0 THEN 0.0::DOUBLE WHEN len({t}) = 1 OR {_PART(t, hay)} >= 0.5 THEN {_PART(t, hay)} ELSE 0.0::DOUBLE END"
_HITS = lambda terms: f"len(list_filter({terms}, lambda r: {_FRAC('r', 'ft')} > 0))"
_STATE = f"""CASE WHEN regexp_matches(tail, '^[A-Z]{{2}}$') THEN tail ELSE coalesce({q.case_map('lower(tail)', place.STATES)}, '') END"""
_LADDER = "[" + q.strings(title.LADDER) + "]"
_SCORES = f"""WITH pr(profile_id, roles, skills, areas, leadership, exclusions, seniority, years, pay) AS (VALUES
 (1, [['data', 'engineer'], ['software', 'engineer']], [['python'], ['sql'], ['apache', 'spark'], ['kafka']], [['cloud', 'products'], ['platform', 'services']], [['lead', 'team']], ['sales', 'intern'], 'senior', 9, 60000.0::DOUBLE),
 (2, [['product', 'manager']], [['sql']], []::VARCHAR[][], []::VARCHAR[][], ['contract'], 'manager', 6, 0.0::DOUBLE), (3, []::VARCHAR[][], []::VARCHAR[][], [['machine', 'learning']], []::VARCHAR[][], []::VARCHAR[], '', NULL, 30000.0::DOUBLE)),
l AS (SELECT *, trim(coalesce(location, '')) AS loc0, trim(regexp_extract(trim(coalesce(location, '')), ',\\s*([A-Za-z ]+?)\\s*$', 1)) AS tail FROM postings),
p AS (SELECT id, lower(title) AS lt, {_TK('title')} AS tt, list_distinct({_TK("concat_ws(' ', title, description)")}) AS ft, {q.seniority('title')} AS level, coalesce(company, '') AS company, lower(loc0) AS loc, pay_min,
  regexp_matches(lower(loc0), '\\bunited states\\b') OR regexp_matches(loc0, '\\bUSA?\\b') OR {_STATE} <> '' AS us, {q.employment("concat_ws(' ', title, description)")} AS emp FROM l),
x AS (SELECT *, list_position({_LADDER}, level) AS got, CASE WHEN list_position({_LADDER}, seniority) > 0 THEN list_position({_LADDER}, seniority) ELSE 5 END AS want, coalesce(list_position({_LADDER}, seniority), 0) > 0 AS known, regexp_matches(loc, '\\bremote\\b') AS remote,
  CASE WHEN len(roles) = 0 THEN 1.0::DOUBLE ELSE list_max(list_transform(roles, lambda r: {_FRAC('r', 'tt')})) END AS fit, {_HITS('skills')} AS ns, {_HITS('areas')} AS na, {_HITS('leadership')} AS nl,
  (coalesce(years >= 8, false) AND level IN ('intern', 'entry', 'junior')) OR (coalesce(years <= 2, false) AND level IN ('director', 'head', 'vp', 'executive')) AS misfit, pay_min IS NOT NULL AND pay > 0 AS priced FROM p, pr),
y AS (SELECT *, len(list_filter(exclusions, lambda e: contains(lt, e))) > 0 OR (known AND want >= 4 AND NOT {q.has('lt', title.RANKED)} AND ({q.has('lt', title.YOUNG)} OR ({q.has('lt', ['associate'])} AND NOT {q.has('lt', [f'associate {o}' for o in title.ASSOCIATES])}))) AS veto FROM x),
z AS (SELECT *, floor(fit * 25 + 0.5) + floor(greatest(0, 12 - abs(got - want) * 3) + 0.5) + CASE WHEN len(skills) = 0 THEN 9 ELSE floor(least(1.0, ns / 3) * 18 + 0.5) END + CASE WHEN len(areas) = 0 THEN 5 ELSE floor(least(1.0, na / 2) * 10 + 0.5) END + CASE WHEN misfit THEN 1 ELSE 5 END + least(6, 3 + CASE WHEN company <> '' THEN 2 ELSE 0 END)
  + CASE WHEN priced THEN CASE WHEN pay_min >= pay THEN 7 ELSE 1 END ELSE 4 END + CASE WHEN us AND remote THEN 10 WHEN us THEN 7 ELSE 4 END + CASE WHEN emp = '' THEN 2 WHEN emp = 'full-time' THEN 4 ELSE 1 END + CASE WHEN nl > 0 AND got >= 5 THEN 3 ELSE 1 END AS total FROM y),
scored AS (SELECT id, profile_id, CAST(least(100, CASE WHEN veto THEN least(total, 20) ELSE total END) AS INTEGER) AS score,
  concat_ws(',', CASE WHEN fit >= 0.6 THEN 'title' END, CASE WHEN got >= want THEN 'seniority' END, CASE WHEN ns > 0 THEN 'skill' END, CASE WHEN na > 0 THEN 'domain' END, CASE WHEN us AND remote THEN 'us remote' END, CASE WHEN priced AND pay_min >= pay THEN 'pay' END) AS reasons,
  concat_ws(',', CASE WHEN fit <= 0.2 THEN 'weak title' END, CASE WHEN got < want THEN 'below seniority' END, CASE WHEN ns = 0 AND len(skills) > 0 THEN 'no skill' END, CASE WHEN misfit THEN 'experience' END, CASE WHEN company = '' THEN 'unknown employer' END, CASE WHEN veto THEN 'veto' END) AS penalties FROM z)
"""


@query("j04_match_scores", _SCORES + "SELECT *, CASE WHEN score >= 95 THEN 'exceptional' WHEN score >= 85 THEN 'strong' WHEN score >= 75 THEN 'review' WHEN score >= 60 THEN 'weak' ELSE 'reject' END AS band FROM scored")
def j04(spark, sf):
    s = jo.score(scoring(spark, sf), profiles(spark))
    return s.select("id", "profile_id", "score", "band", F.array_join("reasons", ",").alias("reasons"), F.array_join("penalties", ",").alias("penalties"))


@query("j05_best_profile", _SCORES + "SELECT id, profile_id, score, n AS profiles FROM (SELECT *, count(*) OVER (PARTITION BY id) AS n, row_number() OVER (PARTITION BY id ORDER BY score DESC, profile_id) AS r FROM scored WHERE score >= 40) WHERE r = 1")
def j05(spark, sf):
    return jo.best_profile(jo.score(scoring(spark, sf), profiles(spark)), 40)


_NAMES_A, _NAMES_B = "SELECT company AS name FROM postings UNION SELECT c_name FROM customer", "SELECT company AS name FROM applications UNION SELECT s_name FROM supplier"
_TOK = lambda x: f"list_sort(list_distinct(list_filter(string_split({q.words_only(f'coalesce({x}, {chr(39)}{chr(39)})')}, ' '), lambda w: w <> '' AND w NOT IN ({q.strings(jo.COMMON)}))))"


@query("j06_company_links", f"""WITH a AS (SELECT name AS a, {q.words_only('name')} AS ka, {_TOK('name')} AS ta FROM ({_NAMES_A}) WHERE name <> ''),
b AS (SELECT name AS b, {q.words_only('name')} AS kb, {_TOK('name')} AS tb FROM ({_NAMES_B}) WHERE name <> '')
SELECT a, b, CASE WHEN ka = kb THEN 'exact' WHEN ta = tb AND len(list_filter(ta, lambda w: length(w) >= 3)) > 0 THEN 'strong' ELSE 'weak' END AS tier FROM a, b WHERE (ka = kb AND ka <> '') OR len(list_intersect(ta, tb)) > 0""")
def j06(spark, sf):
    return jo.company_links(frame(spark, sf, _NAMES_A), frame(spark, sf, _NAMES_B))


_INVITES = "SELECT event_id AS invite_id, CASE CAST(event_id % 9 AS INT) WHEN 0 THEN 'Acme' WHEN 1 THEN 'Epic Systems' WHEN 2 THEN 'Globex' WHEN 3 THEN 'Wayne Enterprises' WHEN 4 THEN 'Stark Industries' WHEN 5 THEN 'IBM' WHEN 6 THEN 'Nobody' ELSE 'Umbrella Research Group' END AS company, CASE WHEN event_id % 2 = 0 THEN concat('q', CAST(event_id % 1000 AS VARCHAR(20))) ELSE '' END AS req FROM events"
_REQS = "SELECT num, company, concat('q', CAST(num AS VARCHAR(20))) AS req FROM applications"


@query("j07_invite_matches", f"""WITH i AS (SELECT invite_id, req, {_TOK('company')} AS ti FROM ({_INVITES})), a AS (SELECT num, company, req, {_TOK('company')} AS ta FROM ({_REQS})),
m AS (SELECT invite_id, i.req, t.company, 2.0 * len(list_intersect(ti, ta)) / (len(ti) + len(ta)) AS dice FROM i JOIN (SELECT DISTINCT company, ta FROM a) t ON len(list_intersect(ti, ta)) > 0),
s AS (SELECT invite_id, num, dice AS points FROM m JOIN (SELECT company, min(num) AS num FROM a GROUP BY company) f ON m.company = f.company UNION ALL SELECT invite_id, num, dice + 0.5 FROM m JOIN a ON m.company = a.company AND m.req = a.req AND m.req <> '')
SELECT invite_id, num, points FROM (SELECT *, row_number() OVER (PARTITION BY invite_id ORDER BY points DESC, num) AS r FROM s) WHERE r = 1""")
def j07(spark, sf):
    return jo.invite_matches(frame(spark, sf, _INVITES), frame(spark, sf, _REQS))


_REPLIES = "SELECT event_id AS message_id, concat(CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'jobs' ELSE 'hr' END, '@', CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'mail.initech.com' WHEN 1 THEN 'globex.io' WHEN 2 THEN 'gmail.com' WHEN 3 THEN 'wayne.org' ELSE 'stark.dev' END) AS sender, concat('About the ', CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'Data Engineer' WHEN 1 THEN 'Senior SRE' ELSE 'open' END, ' role at ', CASE CAST(event_id % 6 AS INT) WHEN 0 THEN 'Acme Inc.' WHEN 1 THEN 'Stark Labs' WHEN 2 THEN 'IBM' ELSE 'our firm' END) AS text FROM events"
_OPEN = "SELECT num, company, role FROM applications WHERE company <> ''"


@query("j08_reply_matches", f"""WITH r AS (SELECT *, lower(text) AS lt, lower(regexp_extract(sender, '@(?:[^@]*\\.)?([^.@]+)\\.[^.@]+$', 1)) AS site FROM ({_REPLIES})), a AS (SELECT *, lower(company) AS lc, lower(role) AS lr FROM ({_OPEN}) WHERE {q.words_only('company')} <> ''),
h AS (SELECT message_id, company FROM r JOIN (SELECT DISTINCT company, lc FROM a) ON contains(lt, lc) OR (site <> '' AND contains(lc, site))),
p AS (SELECT message_id, num, CAST(CASE WHEN contains(lt, lc) THEN 2 ELSE 0 END + CASE WHEN site <> '' AND contains(lc, site) THEN 2 ELSE 0 END AS DOUBLE) + CASE WHEN contains(lt, lr) THEN 1.5 ELSE 0 END AS points FROM h JOIN r USING (message_id) JOIN a USING (company)),
t AS (SELECT *, rank() OVER (PARTITION BY message_id ORDER BY points DESC) AS k FROM p WHERE points >= 2)
SELECT r.message_id, num, coalesce(points, 0.0::DOUBLE) AS points FROM r LEFT JOIN (SELECT message_id, CASE WHEN count(*) = 1 THEN min(num) END AS num, max(points) AS points FROM t WHERE k = 1 GROUP BY message_id) b ON r.message_id = b.message_id""")
def j08(spark, sf):
    return jo.reply_matches(frame(spark, sf, _REPLIES), frame(spark, sf, _OPEN))


_RANK = lambda x: f"CASE {x} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in status.STAGES.items()) + " ELSE -1 END"


_ROLES = lambda x, y: f"""(lower(trim({x})) = lower(trim({y})) OR (CASE WHEN len(sa) > 0 AND len(sb) > 0 THEN len(list_intersect(sa, sb)) > 0 WHEN len(sa) + len(sb) > 0 THEN len(list_intersect(list_concat(sa, sb), [{q.strings(title.BELOW)}])) = 0 ELSE true END
 AND len(m) >= 2 AND len(list_filter(m, lambda z: z NOT IN ({q.strings(title.BASELINE)}))) > 0 AND NOT ((len(oa) = 0) <> (len(ob) = 0) AND len(list_filter(list_concat(oa, ob), lambda z: z NOT IN ({q.strings(title.BASELINE)}))) > 0) AND len(m) / (len(m) + len(oa) + len(ob)) >= 0.6))"""  # noqa: E731


_FIRMS = ("Acme", "Globex Tech", "Stark", "Epic Systems Inc", "Initech Research", "Nobody", "Wayne Holdings Group", "Umbrella")
_TALKS = f"SELECT event_id AS interview_id, {pick('event_id', _FIRMS)} AS company, {pick('event_id * 7', ('Data Engineer', 'Senior SRE', 'Product Manager', 'AI Engineer', 'Staff QA Analyst', 'Janitor'))} AS role, CASE WHEN event_id % 3 = 0 THEN concat('see #', CAST(event_id AS VARCHAR(20)), ' in tracker') ELSE '' END AS notes, {pick('event_id * 5', ('Scheduled', '**Offer**', 'rejected', 'Ghosted', 'Confirmed'))} AS round FROM events"
#: An application each third order, with employers that have some hundred openings apart.
_TRACKED = f"SELECT num, CASE WHEN num % 5 < 3 THEN concat(company, ' ', CAST(num % 900 AS VARCHAR(20))) ELSE company END AS company, role, {q.status('status_text')} AS status FROM applications"
_NW = lambda x: f"list_distinct(list_filter(string_split(regexp_replace({q.words_only(f'replace(regexp_replace(lower(coalesce({x}, {chr(39) * 2})), {chr(39)}[(][^)]*[)]{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)}), {chr(39)}&{chr(39)}, {chr(39)} and {chr(39)})')}, '( (inc|incorporated|llc|ltd|limited|corp|corporation|co|company|plc|gmbh|ag|sa|bv|nv|pty))+$', ''), ' '), lambda w: w <> ''))"
_PLACE = lambda x: f"CASE WHEN {x} IN ({q.strings(jo.END_STATES)}) THEN 100 " + " ".join(f"WHEN {x} = '{st}' THEN {n}" for n, st in enumerate(jo.OPEN_STATES)) + " END"


@query("j09_tracker_drift", f"""WITH i AS (SELECT *, try_cast(nullif(regexp_extract(notes, '(?i)#\\s*([0-9]+)\\s+in\\s+tracker', 1), '') AS BIGINT) AS ref, coalesce({q.case_map("lower(trim(replace(round, '**', '')))", jo.ROUNDS)}, 'Interview') AS says FROM ({_TALKS})), a AS (SELECT * FROM ({_TRACKED})),
ci AS (SELECT DISTINCT company AS ca, {_NW('company')} AS wa FROM i), ct AS (SELECT DISTINCT company AS cb, {_NW('company')} AS wb FROM a), f AS (SELECT ca, cb, 2.0 * len(list_intersect(wa, wb)) / (len(wa) + len(wb)) AS sim FROM ci, ct WHERE len(wa) > 0 AND len(wb) > 0 AND 2.0 * len(list_intersect(wa, wb)) / (len(wa) + len(wb)) >= 0.5),
x AS (SELECT DISTINCT role AS ra, list_distinct({q.role_tokens('role')}) AS ta, {q.seniority_words('role')} AS sa FROM i), y AS (SELECT DISTINCT role AS rb, list_distinct({q.role_tokens('role')}) AS tb, {q.seniority_words('role')} AS sb FROM a),
z AS (SELECT ra, rb, sa, sb, list_intersect(ta, tb) AS m, list_filter(ta, lambda v: NOT list_contains(tb, v)) AS oa, list_filter(tb, lambda v: NOT list_contains(ta, v)) AS ob FROM x, y), r AS (SELECT ra, rb FROM z WHERE {_ROLES('ra', 'rb')}),
h AS (SELECT d.company AS ca, d.role AS ra, count(*) AS n, min(num) AS num, min(status) AS own, max(sim) AS sim FROM (SELECT DISTINCT company, role FROM i) d JOIN f ON d.company = f.ca JOIN r ON d.role = r.ra JOIN a ON a.company = f.cb AND a.role = r.rb GROUP BY 1, 2),
m AS (SELECT interview_id, says, a.num, a.status AS own, CASE WHEN a.num IS NULL THEN 'unmatched' ELSE 'tracker-ref' END AS method, CAST(CASE WHEN a.num IS NULL THEN 0 ELSE 1 END AS DOUBLE) AS confidence FROM i LEFT JOIN a ON i.ref = a.num WHERE ref IS NOT NULL
 UNION ALL SELECT interview_id, says, CASE WHEN n = 1 THEN num END, CASE WHEN n = 1 THEN own END, CASE WHEN n = 1 THEN 'fuzzy' ELSE 'unmatched' END, CAST(coalesce(CASE WHEN n = 1 THEN round(sim, 3) ELSE sim END, 0) AS DOUBLE) FROM i LEFT JOIN h ON i.company = h.ca AND i.role = h.ra WHERE ref IS NULL),
p AS (SELECT *, coalesce({_PLACE('own')}, CASE WHEN {_PLACE('says')} = 100 THEN -1 END) AS po, {_PLACE('says')} AS ps FROM m), t AS (SELECT *, CASE WHEN num IS NULL THEN 'unmatched' WHEN own = says THEN 'ok' WHEN po IS NULL OR po = ps THEN 'review' ELSE 'auto' END AS action FROM p)
SELECT interview_id, num, method, confidence, action, CASE WHEN action = 'auto' THEN CASE WHEN po > ps THEN own ELSE says END END AS suggested FROM t""")
def j09(spark, sf):
    label, _ = status.canonical(F.col("status_text"))
    a = view(spark, sf, "applications")
    firm = F.when(F.col("num") % 5 < 3, F.concat("company", F.lit(" "), (F.col("num") % 900).cast("string"))).otherwise(F.col("company"))
    return jo.tracker_drift(frame(spark, sf, _TALKS), a.select("num", firm.alias("company"), "role", label.alias("status")))


@query("j10_same_openings", f"""WITH t AS (SELECT DISTINCT company_key, title FROM (SELECT {q.company_key('company')} AS company_key, title FROM postings) WHERE company_key <> ''), w AS (SELECT *, list_distinct({q.role_tokens('title')}) AS t, {q.seniority_words('title')} AS s FROM t),
p AS (SELECT x.company_key, x.title AS a, y.title AS b, x.s AS sa, y.s AS sb, list_intersect(x.t, y.t) AS m, list_filter(x.t, lambda z: NOT list_contains(y.t, z)) AS oa, list_filter(y.t, lambda z: NOT list_contains(x.t, z)) AS ob FROM w x JOIN w y ON x.company_key = y.company_key AND x.title < y.title)
SELECT company_key, a, b FROM p WHERE {_ROLES('a', 'b')}""")
def j10(spark, sf):
    return jo.same_openings(view(spark, sf, "postings").select(co.company_key(F.col("company")).alias("company_key"), "title"))


_TRACKER = "SELECT num, company, role, score, via, coalesce(report, '') AS report, CASE WHEN num % 2 = 0 THEN '' ELSE concat('u', CAST(num AS VARCHAR(20))) END AS url, CASE CAST(num % 5 AS INT) WHEN 1 THEN 'q1' WHEN 2 THEN 'q2' ELSE '' END AS req FROM applications WHERE num % 3 <> 0"
_ADDED = "SELECT num AS seq, CASE CAST(num % 4 AS INT) WHEN 0 THEN num - 1 WHEN 1 THEN num + 2 ELSE num + 100000 END AS num, company, role, round(score + 0.5, 1) AS score, via, CASE WHEN num % 7 = 1 THEN concat('r', CAST((num - 1) % 9000 AS VARCHAR(20)), '.md') ELSE coalesce(report, '') END AS report, CASE CAST(num % 5 AS INT) WHEN 0 THEN concat('u', CAST(num - 1 AS VARCHAR(20))) WHEN 1 THEN concat('n', CAST(num % 1000 AS VARCHAR(20))) ELSE '' END AS url, CASE CAST(num % 4 AS INT) WHEN 1 THEN 'q1' WHEN 2 THEN 'q2' ELSE '' END AS req FROM applications WHERE num % 3 = 0"
_EMPLOYER = f"CASE WHEN {q.company_key('company')} <> '' THEN concat('c:', {q.company_key('company')}) WHEN trim(company) = '?' AND {q.words_only('via')} <> '' THEN concat('v:', {q.words_only('via')}) ELSE '' END"


@query("j11_tracker_upsert", f"""WITH t AS (SELECT *, {_EMPLOYER} AS e FROM ({_TRACKER})), a AS (SELECT *, {_EMPLOYER} AS e FROM ({_ADDED})),
r AS (SELECT *, list_distinct({q.role_tokens('role')}) AS k, {q.seniority_words('role')} AS s FROM (SELECT DISTINCT e, role FROM t WHERE url = '' UNION SELECT DISTINCT e, role FROM a)),
p AS (SELECT x.e, x.role AS ra, y.role AS rb, x.s AS sa, y.s AS sb, list_intersect(x.k, y.k) AS m, list_filter(x.k, lambda z: NOT list_contains(y.k, z)) AS oa, list_filter(y.k, lambda z: NOT list_contains(x.k, z)) AS ob FROM r x JOIN r y ON x.e = y.e AND x.e <> ''),
l AS (SELECT p.e, ra AS role, t.req, min(t.num) AS num FROM p JOIN t ON t.e = p.e AND t.role = rb AND t.url = '' WHERE {_ROLES('ra', 'rb')} GROUP BY 1, 2, 3),
bu AS (SELECT url, min(num) AS v FROM t WHERE url <> '' GROUP BY 1), rp AS (SELECT report, e, min(num) AS v, min(num) FILTER (WHERE url = '') AS bare FROM t WHERE report <> '' AND e <> '' GROUP BY 1, 2), bn AS (SELECT num, e FROM t WHERE url = '' AND e <> ''),
l1 AS (SELECT e, role, min(num) AS v FROM l GROUP BY 1, 2), l2 AS (SELECT e, role, min(num) AS v FROM l WHERE req = '' GROUP BY 1, 2),
c AS (SELECT a.*, bu.v AS c1, CASE WHEN a.url = '' THEN rp.v ELSE rp.bare END AS c2, bn.num AS c3, CASE WHEN a.req = '' THEN l1.v ELSE least(l2.v, l3.num) END AS c4 FROM a LEFT JOIN bu ON a.url = bu.url LEFT JOIN rp ON a.report = rp.report AND a.e = rp.e LEFT JOIN bn ON a.num = bn.num AND a.e = bn.e
 LEFT JOIN l1 ON a.e = l1.e AND a.role = l1.role LEFT JOIN l2 ON a.e = l2.e AND a.role = l2.role LEFT JOIN l l3 ON a.e = l3.e AND a.role = l3.role AND a.req = l3.req AND l3.req <> ''),
h AS (SELECT *, coalesce(c1, c2, c3, c4) AS target, CASE WHEN c1 IS NOT NULL THEN 'url' WHEN c2 IS NOT NULL THEN 'report' WHEN c3 IS NOT NULL THEN 'number' WHEN c4 IS NOT NULL THEN 'role' ELSE 'new' END AS rule FROM c),
u AS (SELECT target, arg_max(score, seq) FILTER (WHERE score IS NOT NULL) AS score, arg_max(role, seq) FILTER (WHERE rule IN ('url', 'report')) AS role, count(*) AS merged, arg_min(rule, seq) AS rule FROM h WHERE target IS NOT NULL GROUP BY target),
f AS (SELECT CASE WHEN url <> '' THEN concat('u:', url) WHEN e <> '' THEN concat_ws('#', e, {q.words_only('role')}, req) ELSE concat('s:', CAST(seq AS VARCHAR)) END AS k, min(seq) AS head, arg_min(num, seq) AS num, arg_min(company, seq) AS company, arg_min(role, seq) AS role, arg_max(score, seq) FILTER (WHERE score IS NOT NULL) AS score, count(*) AS merged FROM h WHERE target IS NULL GROUP BY 1),
g AS (SELECT *, num NOT IN (SELECT num FROM t) AND head = min(head) OVER (PARTITION BY num) AS free FROM f),
n AS (SELECT *, CASE WHEN free THEN num ELSE (SELECT max(num) FROM (SELECT num FROM t UNION ALL SELECT num FROM a)) + count(*) FILTER (WHERE NOT free) OVER (ORDER BY head) END AS own FROM g)
SELECT t.num, t.company, coalesce(u.role, t.role) AS role, coalesce(u.score, t.score) AS score, coalesce(u.merged, 0) AS merged, coalesce(u.rule, '') AS rule FROM t LEFT JOIN u ON t.num = u.target UNION ALL SELECT own, company, role, score, merged, 'new' FROM n""")
def j11(spark, sf):
    from joblode.operators.tracker import merge_additions

    keyed = lambda sql: frame(spark, sf, sql).withColumn("company_key", co.company_key(F.col("company")))
    return merge_additions(keyed(_TRACKER), keyed(_ADDED))


@query("j11_tracker_in_order")
def j11_in_order(spark, sf):
    from joblode.operators.tracker import merge_in_order

    keyed = lambda sql: frame(spark, sf, sql).withColumn("company_key", co.company_key(F.col("company")))
    return merge_in_order(keyed(_TRACKER), keyed(_ADDED)).withColumn("superseded", F.array_join("superseded", ", "))


_INBOX = "SELECT o_orderkey AS id, concat('u', CAST(o_orderkey % 7000 AS VARCHAR(20))) AS url FROM orders"
_STATE = "SELECT concat('u', CAST(c_custkey * 3 AS VARCHAR(20))) AS url, CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN 'completed' WHEN 1 THEN 'skipped' WHEN 2 THEN 'failed' ELSE 'pending' END AS status, concat('r', CAST(c_custkey AS VARCHAR(20))) AS report FROM customer"
_REPORTS = "SELECT concat('r', CAST(s_suppkey * 5 AS VARCHAR(20))) AS report FROM supplier"


@query("j12_reconcile_inbox", f"SELECT i.id, i.url, CASE WHEN s.status IN ('completed', 'skipped') THEN 'drop' ELSE 'keep' END AS action, s.report IN (SELECT report FROM ({_REPORTS})) AND s.report IS NOT NULL AS has_report FROM ({_INBOX}) i LEFT JOIN ({_STATE}) s ON i.url = s.url")
def j12(spark, sf):
    return jo.reconcile_inbox(frame(spark, sf, _INBOX), frame(spark, sf, _STATE), frame(spark, sf, _REPORTS))


_W3 = lambda x: f"list_distinct(list_filter(string_split({q.words_only(x)}, ' '), lambda w: length(w) > 2))"


@query("j13_backfill_url", f"""WITH p AS (SELECT company_key, title, arg_min(url, id) AS url, min(id) AS id FROM (SELECT id, {q.company_key('company')} AS company_key, title, url FROM postings WHERE coalesce(url, '') <> '') WHERE company_key <> '' GROUP BY 1, 2),
a AS (SELECT num, {q.company_key('company')} AS company_key, role FROM applications), b AS (SELECT r.company_key, role, url, id, len(list_intersect({_W3('role')}, {_W3('title')})) AS n, count(*) OVER (PARTITION BY r.company_key, role) AS many FROM (SELECT DISTINCT company_key, role FROM a) r JOIN p ON r.company_key = p.company_key),
t AS (SELECT *, row_number() OVER (PARTITION BY company_key, role ORDER BY n DESC, id) AS k FROM b) SELECT num, url FROM a JOIN t ON a.company_key = t.company_key AND a.role = t.role WHERE k = 1 AND (many = 1 OR n > 0)""")
def j13(spark, sf):
    key = co.company_key(F.col("company")).alias("company_key")
    return jo.backfill_url(view(spark, sf, "applications").select("num", key, "role"), view(spark, sf, "postings").select("id", key, "title", "url"))


_FILES = "SELECT DISTINCT concat('r', CAST(c_custkey * 7 % 9500 AS VARCHAR(20)), '.md') AS report FROM customer"


@query("j14_findings", f"""WITH a AS (SELECT num, {q.company_key('company')} AS company_key, role, report, score, {q.status('status_text')} AS status FROM applications), f AS ({_FILES})
SELECT 'missing report' AS kind, CAST(num AS VARCHAR) AS key FROM a WHERE report <> '' AND report NOT IN (SELECT report FROM f) UNION ALL SELECT 'orphan report', report FROM f WHERE report NOT IN (SELECT report FROM a) UNION ALL SELECT 'orphan ledger number', CAST(num AS VARCHAR) FROM (SELECT DISTINCT num * 101 AS num FROM ledger) WHERE num NOT IN (SELECT num FROM a)
UNION ALL SELECT 'duplicate company and role', CAST(min(num) AS VARCHAR) FROM a GROUP BY company_key, role HAVING count(*) > 1 UNION ALL SELECT 'unknown state', CAST(num AS VARCHAR) FROM a WHERE status IS NULL UNION ALL SELECT 'malformed score', CAST(num AS VARCHAR) FROM a WHERE score IS NULL OR score > 5""")
def j14(spark, sf):
    label, _ = status.canonical(F.col("status_text"))
    a = view(spark, sf, "applications").select("num", co.company_key(F.col("company")).alias("company_key"), "role", "report", "score", label.alias("status"))
    return jo.findings(a, frame(spark, sf, _FILES), view(spark, sf, "ledger").select((F.col("num") * 101).alias("num")), F.col("status").isNotNull())


@query("j15_run_diff", "SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'new' WHEN a.id IS NULL THEN 'missing' ELSE 'unchanged' END AS state FROM (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_linenumber = 2 AND l_quantity > 25) a FULL OUTER JOIN (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_linenumber = 1 AND l_quantity > 25) b ON a.id = b.id")
def j15(spark, sf):
    run = lambda n: frame(spark, sf, f"SELECT l_partkey AS id FROM lineitem WHERE l_linenumber = {n} AND l_quantity > 25")
    return jo.run_diff(run(1), run(2))


_BEFORE = "SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price, o_orderpriority AS level FROM orders WHERE o_orderkey % 5 <> 0"
_AFTER = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS price, o_orderpriority AS level FROM orders WHERE o_orderkey % 4 <> 0"


@query("j16_snapshot_diff", f"SELECT a.id, CASE WHEN b.id IS NULL THEN 'NEW' WHEN a.status IS DISTINCT FROM b.status OR a.price IS DISTINCT FROM b.price OR a.level IS DISTINCT FROM b.level THEN 'CHANGED' ELSE 'UNCHANGED' END AS state, CASE WHEN b.id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.status IS DISTINCT FROM b.status THEN 'status' END, CASE WHEN a.price IS DISTINCT FROM b.price THEN 'price' END, CASE WHEN a.level IS DISTINCT FROM b.level THEN 'level' END) END AS changed FROM ({_AFTER}) a LEFT JOIN ({_BEFORE}) b ON a.id = b.id")
def j16(spark, sf):
    return jo.snapshot_diff(frame(spark, sf, _BEFORE), frame(spark, sf, _AFTER), ["status", "price", "level"]).select("id", "state", F.array_join("changed", ",").alias("changed"))


_STORE = "SELECT o_orderkey AS id, concat('u', CAST(o_orderkey AS VARCHAR(20))) AS url, CAST(o_orderdate AS DATE) AS first_seen, CAST(o_orderdate AS DATE) AS last_seen, 1 AS seen, CASE WHEN o_orderkey % 3 = 0 THEN 'stale' ELSE 'active' END AS lifecycle, o_orderkey % 37 = 0 AS closed FROM orders WHERE o_orderkey % 2 = 0"
_NEW = "SELECT CASE WHEN l_orderkey % 3 = 0 THEN l_orderkey + 1000000 ELSE l_orderkey END AS id, concat('u', CAST(l_orderkey AS VARCHAR(20))) AS url FROM lineitem WHERE l_linenumber <= 2"


@query("j17_store_upsert", f"""WITH s AS ({_STORE}), b AS (SELECT coalesce(x.id, u.id, n.id) AS id, n.url FROM ({_NEW}) n LEFT JOIN s x ON n.id = x.id LEFT JOIN s u ON n.url = u.url), g AS (SELECT id, count(*) AS n, list_sort(list_distinct(list(url))) AS urls FROM b GROUP BY id)
SELECT coalesce(s.id, g.id) AS id, CAST(coalesce(seen, 0) + coalesce(n, 0) AS BIGINT) AS seen, CASE WHEN coalesce(closed, false) THEN 'closed' WHEN n IS NOT NULL THEN 'active' ELSE lifecycle END AS lifecycle, CASE WHEN first_seen IS NULL THEN 'added' WHEN n IS NOT NULL THEN 'updated' ELSE 'unchanged' END AS state, coalesce(first_seen, DATE '{DAY}') AS first_seen, CAST(CASE WHEN s.id IS NULL THEN least(10, len(urls)) ELSE least(10, 1 + len(list_filter(coalesce(urls, []), lambda x: x <> s.url))) END AS INTEGER) AS n_urls FROM s FULL OUTER JOIN g ON s.id = g.id""")
def j17(spark, sf):
    store = frame(spark, sf, _STORE).withColumn("urls", F.array("url"))
    out = jo.upsert_store(store, frame(spark, sf, _NEW), day())
    return out.select("id", F.col("seen").cast("long").alias("seen"), "lifecycle", "state", "first_seen", F.size("urls").alias("n_urls"))


_DOCS = lambda side: f"SELECT item_id AS id, concat('l', CAST(item_id % 3 AS VARCHAR(20))) AS level, text FROM benchmark WHERE item_id % 2 = {side}"
_DW = lambda x: f"list_distinct(list_filter(string_split({q.words_only(x)}, ' '), lambda w: length(w) > 3))"


@query("j18_document_reuse", f"""WITH a AS (SELECT id, level, {_DW('text')} AS w FROM ({_DOCS(0)})), b AS (SELECT id AS other, level AS l2, {_DW('text')} AS v FROM ({_DOCS(1)})),
p AS (SELECT id, other, level = l2 AS same, len(list_intersect(w, v)) / (len(w) + len(v) - len(list_intersect(w, v))) AS similarity FROM a, b WHERE len(list_intersect(w, v)) > 0), t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other) AS k FROM p)
SELECT id, other, similarity, CASE WHEN NOT same THEN 'regenerate' WHEN similarity >= 0.72 THEN 'reuse' WHEN similarity >= 0.45 THEN 'adapt' ELSE 'regenerate' END AS action FROM t WHERE k = 1""")
def j18(spark, sf):
    words = F.array_distinct(F.filter(F.split(text.words_only(F.col("text")), " "), lambda w: F.length(w) > 3))
    side = lambda n: frame(spark, sf, _DOCS(n)).select("id", "level", words.alias("words"))
    return jo.reuse_documents(side(0), side(1))


_CLAIMS = "SELECT o_orderkey AS claim_id, CAST(o_orderkey % 997 AS INT) AS number, concat(o_orderpriority, ' ', o_orderstatus, ' total of ', CAST(o_custkey % 50 AS VARCHAR(20))) AS text FROM orders"
_SOURCES = "SELECT c_custkey AS source_id, CAST(c_custkey % 500 AS INT) AS n1, CAST(c_custkey * 3 % 700 AS INT) AS n2, concat(c_mktsegment, ' total ', CASE WHEN c_custkey % 2 = 0 THEN '1-URGENT' ELSE '5-LOW' END, ' ', CAST(c_custkey % 40 AS VARCHAR(20))) AS text FROM customer"


@query("j19_verified_claims", f"""WITH c AS (SELECT claim_id, number, list_distinct(string_split(lower(text), ' ')) AS w FROM ({_CLAIMS})), s AS (SELECT source_id, unnest(list_distinct([n1, n2])) AS number, list_distinct(string_split(lower(text), ' ')) AS v FROM ({_SOURCES})),
h AS (SELECT claim_id, max(len(list_intersect(w, v))) AS best FROM c JOIN s ON c.number = s.number GROUP BY claim_id), e AS (SELECT list(DISTINCT x) AS xs FROM (SELECT unnest(v) AS x FROM s))
SELECT c.claim_id, CASE WHEN best >= 2 THEN 'confirmed' WHEN best IS NOT NULL THEN 'number-only' WHEN len(list_intersect(w, (SELECT xs FROM e))) >= 2 THEN 'context-only' ELSE 'unsupported' END AS bucket FROM c LEFT JOIN h ON c.claim_id = h.claim_id""")
def j19(spark, sf):
    words = F.array_distinct(F.split(F.lower("text"), " ")).alias("words")
    sources = frame(spark, sf, _SOURCES).select("source_id", F.array_distinct(F.array("n1", "n2")).alias("numbers"), words)
    return jo.verify_claims(frame(spark, sf, _CLAIMS).select("claim_id", "number", words), sources)


_FOUND = "SELECT c_custkey AS id, concat('n', CAST(c_custkey % 900 AS VARCHAR(20))) AS name_key, concat('c', CAST(c_custkey AS VARCHAR(20))) AS careers, concat('a', CAST(c_custkey AS VARCHAR(20))) AS api FROM customer"
_OWNED = "SELECT concat('n', CAST(s_suppkey * 2 AS VARCHAR(20))) AS name_key, concat('c', CAST(s_suppkey * 3 AS VARCHAR(20))) AS careers, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE concat('a', CAST(s_suppkey * 5 AS VARCHAR(20))) END AS api FROM supplier"


@query("j20_undiscovered", f"SELECT name_key, min(id) AS id FROM ({_FOUND}) WHERE name_key NOT IN (SELECT name_key FROM ({_OWNED})) AND careers NOT IN (SELECT careers FROM ({_OWNED})) AND api NOT IN (SELECT api FROM ({_OWNED})) GROUP BY name_key")
def j20(spark, sf):
    return jo.undiscovered(frame(spark, sf, _FOUND), frame(spark, sf, _OWNED))


@query("j21_seed_followups", f"SELECT num, CAST(applied + INTERVAL 7 DAY AS DATE) AS due FROM applications WHERE {q.status('status_text')} IN ('Applied', 'Responded', 'Interview') AND num NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 7) AND num NOT IN (SELECT c_custkey * 9 FROM customer)")
def j21(spark, sf):
    label, _ = status.canonical(F.col("status_text"))
    a = view(spark, sf, "applications").withColumn("status", label)
    return jo.seed_followups(a, frame(spark, sf, "SELECT l_orderkey AS num FROM lineitem WHERE l_linenumber = 7"), frame(spark, sf, "SELECT c_custkey * 9 AS num FROM customer"))
