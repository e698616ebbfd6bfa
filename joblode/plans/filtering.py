"""Queries of the filters (F1 to F16) and the intake funnel."""

from __future__ import annotations

from pyspark.sql import functions as F

from joblode.functions import company as co, misc, place, status, title, web
from joblode.functions.text import anchored, words_only
from joblode.operators import filters as fi
from joblode.operators.survivors import staged_funnel
from joblode.plans import sql as q
from joblode.plans.adapters import frame, view
from joblode.plans.registry import query

POSITIVE = ["engineer", "word:sre", "stem:analy", "data + engineer", "ai"]
NEGATIVE = ["junior", "qa", "word:intern"]
AS_OF = "2001-08-01"


def keyword(x: str, k: str) -> str:
    if " + " in k:
        return "(" + " AND ".join(keyword(x, w) for w in k.split(" + ")) + ")"
    if k.startswith("word:"):
        return f"regexp_matches({x}, '{anchored(k[5:])}')"
    if k.startswith("stem:"):
        return f"regexp_matches({x}, '(^|[^a-z0-9]){k[5:]}')"
    return f"regexp_matches({x}, '{anchored(k)}')" if len(k) in (2, 3) and k.isalpha() else f"contains({x}, '{k}')"


def any_of(x: str, phrases) -> str:
    return "(" + (" OR ".join(f"contains(lower({x}), '{q.s(p)}')" for p in phrases) or "false") + ")"


def any_anchored(x: str, words) -> str:
    return "(" + (" OR ".join(f"regexp_matches({x}, '{q.s(anchored(w))}')" for w in words) or "false") + ")"


def _posting(spark, sf):
    return view(spark, sf, "postings")


GOOD = f"(({' OR '.join(keyword('lower(title)', k) for k in POSITIVE)}) AND NOT ({' OR '.join(keyword('lower(title)', k) for k in NEGATIVE)}))"


@query("f01_title_keyword_filter", f"SELECT id, title FROM postings WHERE {GOOD}")
def f01(spark, sf):
    return _posting(spark, sf).where(fi.title_filter(F.col("title"), POSITIVE, NEGATIVE)).select("id", "title")


@query("f02_matched_keywords", f"SELECT id, concat_ws(',', {', '.join(f'CASE WHEN {keyword(chr(108) + chr(111) + chr(119) + chr(101) + chr(114) + chr(40) + chr(116) + chr(105) + chr(116) + chr(108) + chr(101) + chr(41), k)} THEN {chr(39)}{k}{chr(39)} END' for k in POSITIVE)}) AS matched FROM postings")
def f02(spark, sf):
    return _posting(spark, sf).select("id", F.array_join(fi.matched_keywords(F.col("title"), POSITIVE), ",").alias("matched"))


ALLOW, BLOCK, ALWAYS, HARD = ["tx", "new york", "united states", "ca"], ["india", "germany", "worldwide"], ["remote"], ["emea"]
_HIT = lambda words: f"({any_anchored('loc', words)} OR {any_anchored('hint', words)})"


@query("f03_location_filter", f"SELECT id, loc = '' AND hint = '' OR CASE WHEN {_HIT(HARD)} THEN false WHEN {_HIT(ALWAYS)} THEN true WHEN {_HIT(BLOCK)} THEN false ELSE {_HIT(ALLOW)} OR regexp_matches(lower(title), '\\bremote\\b') END AS passes FROM (SELECT id, title, lower(trim(coalesce(location, ''))) AS loc, {q.hint('url')} AS hint FROM postings)")
def f03(spark, sf):
    return _posting(spark, sf).select("id", fi.location_filter(F.col("location"), F.col("url"), F.col("title"), ALLOW, BLOCK, ALWAYS, HARD).alias("passes"))


@query("f04_domestic_only", f"SELECT id FROM (SELECT id, concat_ws(' | ', lower(coalesce(location, '')), {q.hint('url')}) AS b FROM postings) WHERE regexp_extract(b, '{q.s(place.FOREIGN_RE)}', 2) = '' AND (regexp_matches(b, '{q.s(place.US_RE)}') OR regexp_matches(b, '{q.s(place.STATE_RE)}') OR regexp_matches(b, '{q.s(place.CODE_RE)}'))")
def f04(spark, sf):
    return _posting(spark, sf).where(fi.domestic_only(F.col("location"), F.col("url"))).select("id")


@query("f05_date_window", "SELECT id, posted FROM postings WHERE posted IS NULL OR posted BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'")
def f05(spark, sf):
    day = lambda x: F.lit(x).cast("date")
    return _posting(spark, sf).where(fi.date_window(F.col("posted"), day("2000-01-01"), day("2000-12-31"))).select("id", "posted")


OVERRIDE = {"ai": (["pytorch", "machine learning"], ["php"]), "engineer": (["python", "java", "rust"], [])}


@query("f06_content_filter", f"""SELECT id, trim(coalesce(description, '')) = '' OR CASE WHEN {keyword('lower(title)', 'ai')} OR contains(lower(title), 'engineer') THEN ({keyword('lower(title)', 'ai')} AND NOT {any_of('description', ['php'])} AND {any_of('description', ['pytorch', 'machine learning'])}) OR (contains(lower(title), 'engineer') AND {any_of('description', ['python', 'java', 'rust'])}) ELSE NOT {any_of('description', ['contract'])} AND {any_of('description', ['we', 'our', 'sales'])} END AS passes FROM postings""")
def f06(spark, sf):
    matched = fi.matched_keywords(F.col("title"), POSITIVE)
    return _posting(spark, sf).select("id", fi.content_filter(F.col("description"), matched, ["we", "our", "sales"], ["contract"], OVERRIDE).alias("passes"))


EXCLUSIVE, INCLUSIVE = ["only open to candidates in", "must be located in"], ["or remote worldwide"]


@query("f07_country_eligibility", f"SELECT id, trim(coalesce(description, '')) = '' OR NOT {any_of('description', EXCLUSIVE)} OR {any_of('description', [*INCLUSIVE, 'france'])} AS passes FROM postings")
def f07(spark, sf):
    return _posting(spark, sf).select("id", fi.country_eligible(F.col("description"), "France", EXCLUSIVE, INCLUSIVE).alias("passes"))


@query("f08_sponsorship", f"SELECT id, CASE WHEN trim(coalesce(description, '')) = '' THEN true ELSE NOT {any_of('description', fi.SPONSORS_NOT)} END AS lenient, CASE WHEN trim(coalesce(description, '')) = '' THEN false ELSE NOT {any_of('description', fi.SPONSORS_NOT)} AND {any_of('description', fi.SPONSORS)} END AS strict FROM postings")
def f08(spark, sf):
    d = F.col("description")
    return _posting(spark, sf).select("id", fi.sponsorship(d, False).alias("lenient"), fi.sponsorship(d, True).alias("strict"))


@query("f09_salary_filter", "SELECT id FROM postings WHERE coalesce(pay_max, pay_min) IS NULL OR (NOT (upper(trim(currency)) <> '' AND upper(trim(currency)) <> 'USD') AND NOT coalesce(pay_max, pay_min) < 40000 AND NOT coalesce(pay_min, pay_max) > 90000)")
def f09(spark, sf):
    return _posting(spark, sf).where(fi.salary_filter(F.col("pay_min"), F.col("pay_max"), F.col("currency"), 40000, 90000, "USD")).select("id")


_LISTED = "SELECT company FROM applications WHERE status_text = 'Rejected'"


@query("f10_do_not_apply", f"SELECT id, company_key FROM (SELECT id, {q.company_key('company')} AS company_key FROM postings) WHERE company_key NOT IN (SELECT {q.company_key('c_name')} FROM customer WHERE c_acctbal < 0) AND company_key NOT IN ('globex', 'initech')")
def f10(spark, sf):
    rows = _posting(spark, sf).select("id", co.company_key(F.col("company")).alias("company_key"))
    listed = frame(spark, sf, "SELECT c_name AS n FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'Globex' UNION ALL SELECT 'Initech'").select(co.company_key(F.col("n")).alias("company_key"))
    return fi.without_listed(rows, listed, "company_key")


_WINDOWS = "SELECT s_suppkey AS rule, CASE CAST(s_suppkey % 6 AS INT) WHEN 0 THEN 'acme' WHEN 1 THEN 'wayne' WHEN 2 THEN 'epic games' WHEN 3 THEN 'stark lab and sons' WHEN 4 THEN 'hp' ELSE 'globex' END AS company, CASE CAST(s_suppkey % 6 AS INT) WHEN 1 THEN 'engineer' WHEN 2 THEN 'sales' ELSE '' END AS title_word, CAST(DATE '2001-06-01' + CAST(s_suppkey % 200 AS INT) AS DATE) AS until FROM supplier"


@query("f11_cooldown", f"""WITH r AS (SELECT id, title, {q.company_key('company')} AS k FROM postings), w AS (SELECT * FROM ({_WINDOWS}) WHERE until > DATE '{AS_OF}')
SELECT r.id, max(w.until) AS cooldown_until FROM r LEFT JOIN w ON r.k <> '' AND (r.k = w.company OR (length(r.k) >= 4 AND contains(concat(' ', w.company, ' '), concat(' ', r.k, ' '))) OR (length(w.company) >= 4 AND contains(concat(' ', r.k, ' '), concat(' ', w.company, ' ')))) AND (w.title_word = '' OR contains(lower(r.title), w.title_word)) GROUP BY r.id""")
def f11(spark, sf):
    rows = _posting(spark, sf).select("id", co.company_key(F.col("company")).alias("company_key"), "title")
    return fi.cooldown(rows, frame(spark, sf, _WINDOWS), F.lit(AS_OF).cast("date")).select("id", "cooldown_until")


def _stages():
    c = F.col
    return [
        ("title", fi.title_filter(c("title"), POSITIVE, NEGATIVE)),
        ("tier", fi.tier_allowed(c("title"), ["intern"])),
        ("location", fi.location_filter(c("location"), c("url"), c("title"), ALLOW, BLOCK, ALWAYS, HARD)),
        ("age", F.coalesce(F.datediff(day(AS_OF), c("posted")) <= 3000, F.lit(True))),
        ("date", fi.date_window(c("posted"), day("1996-01-01"))),
        ("salary", fi.salary_filter(c("pay_min"), c("pay_max"), c("currency"), 20000, 0, "")),
        ("content", fi.content_filter(c("description"), fi.matched_keywords(c("title"), POSITIVE), [], ["php"])),
        ("country", fi.country_eligible(c("description"), "France", EXCLUSIVE, INCLUSIVE)),
        ("visa", fi.sponsorship(c("description"), False)),
    ]


def day(text: str):
    return F.lit(text).cast("date")


_BLACK = "SELECT c_name AS company, 'asked not to' AS reason FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'Globex', 'bad pay' UNION ALL SELECT 'Soylent', NULL"
#: URLs and roles of an earlier run: the openings posted first.
_SEEN = "SELECT url, company, title FROM postings WHERE posted < DATE '1992-06-01'"


def _funnel(spark, sf, annotate=False):
    named = lambda df: df.withColumn("company_key", co.company_key(F.col("company")))
    keys = lambda df: df.withColumn("url_key", web.scan_key(F.col("url"))).withColumn("role_key", F.concat_ws("::", "company_key", words_only(F.col("title"))))
    keyed = lambda df: keys(df).withColumn("canonical_key", misc.canonical_key(F.col("company"), F.col("title"), F.col("location"), F.col("posted"), F.col("company_key")))
    listed = named(frame(spark, sf, _BLACK)).select("company_key", "reason")
    return staged_funnel(named(_posting(spark, sf)), _stages(), listed, keys(named(frame(spark, sf, _SEEN))), frame(spark, sf, _WINDOWS), day(AS_OF), annotate, keyed, ["source"])


def _scan_key() -> str:
    kept = f"list_filter(string_split({q.url('url', 4)}, '&'), lambda x: x <> '' AND lower(string_split(x, '=')[1]) NOT IN ({q.strings(web.SCAN_DROP)}))"
    path = f"lower(regexp_replace({q.url('url', 3)}, '/+$', ''))"
    return f"CASE WHEN {q.url('url', 2)} = '' THEN url ELSE concat(lower({q.url('url', 1)}), '://', lower({q.url('url', 2)}), CASE WHEN {path} = '' THEN '/' ELSE {path} END, CASE WHEN len({kept}) > 0 THEN concat('?', array_to_string({kept}, '&')) ELSE '' END) END"


_K = q.company_key("company")
#: The order of the rows decides, so the SQL folds their list with the URLs, roles and openings met so far.
_STAGES_SQL = f"""black AS (SELECT {_K} AS k, min(coalesce(reason, '')) AS reason FROM ({_BLACK}) GROUP BY 1),
seen AS (SELECT {_scan_key()} AS u, concat_ws('::', {_K}, {q.words_only('title')}) AS r FROM ({_SEEN})),
p AS (SELECT *, {_K} AS k, coalesce({_scan_key()}, '') AS u, {q.canonical_key()} AS c, lower(trim(coalesce(location, ''))) AS loc, {q.hint('url')} AS hint FROM postings),
r AS (SELECT id, source, title, p.k, u, c, concat_ws('::', p.k, {q.words_only('title')}) AS r, CASE WHEN black.reason IS NOT NULL THEN 'blacklist' WHEN NOT {GOOD} THEN 'title' WHEN {q.tier('title')} = 'intern' THEN 'tier'
 WHEN NOT (loc = '' AND hint = '' OR CASE WHEN {_HIT(HARD)} THEN false WHEN {_HIT(ALWAYS)} THEN true WHEN {_HIT(BLOCK)} THEN false ELSE {_HIT(ALLOW)} OR regexp_matches(lower(title), '\\bremote\\b') END) THEN 'location'
 WHEN date_diff('day', posted, DATE '{AS_OF}') > 3000 THEN 'age' WHEN NOT (posted IS NULL OR posted >= DATE '1996-01-01') THEN 'date' WHEN coalesce(pay_max, pay_min) < 20000 THEN 'salary' WHEN coalesce({any_of('description', ['php'])}, false) THEN 'content'
 WHEN coalesce({any_of('description', EXCLUSIVE)} AND NOT {any_of('description', [*INCLUSIVE, 'france'])}, false) THEN 'country' WHEN coalesce({any_of('description', fi.SPONSORS_NOT)}, false) THEN 'visa' END AS early FROM p LEFT JOIN black ON p.k = black.k AND black.k <> ''),
w AS (SELECT * FROM ({_WINDOWS}) WHERE until > DATE '{AS_OF}'),
g AS (SELECT DISTINCT r.id FROM r JOIN w ON early IS NULL AND r.k <> '' AND (r.k = w.company OR (length(r.k) >= 4 AND contains(concat(' ', w.company, ' '), concat(' ', r.k, ' '))) OR (length(w.company) >= 4 AND contains(concat(' ', r.k, ' '), concat(' ', w.company, ' ')))) AND (w.title_word = '' OR contains(lower(r.title), w.title_word))),
l AS (SELECT list({{'id': id, 'u': u, 'r': r, 'c': c, 'g': id IN (SELECT id FROM g), 'hu': u IN (SELECT u FROM seen WHERE u <> ''), 'hr': r IN (SELECT r FROM seen)}} ORDER BY id) AS rows FROM r WHERE early IS NULL),
f AS (SELECT list_reduce(rows, lambda a, x: {{'u': CASE WHEN list_contains(a.u, x.u) OR list_contains(a.r, x.r) OR x.hu OR x.hr OR list_contains(a.c, x.c) OR x.g OR x.u = '' THEN a.u ELSE list_append(a.u, x.u) END,
 'r': CASE WHEN list_contains(a.u, x.u) OR list_contains(a.r, x.r) OR x.hu OR x.hr OR list_contains(a.c, x.c) OR x.g THEN a.r ELSE list_append(a.r, x.r) END,
 'c': CASE WHEN list_contains(a.u, x.u) OR list_contains(a.r, x.r) OR x.hu OR x.hr OR x.c = '' THEN a.c ELSE list_append(a.c, x.c) END,
 'o': list_append(a.o, {{'id': x.id, 'late': CASE WHEN x.hu OR list_contains(a.u, x.u) THEN 'url_dup' WHEN x.hr OR list_contains(a.r, x.r) THEN 'role_dup' WHEN list_contains(a.c, x.c) THEN 'canonical_dup' WHEN x.g THEN 'cooldown' ELSE 'accepted' END}})}},
 {{'u': []::VARCHAR[], 'r': []::VARCHAR[], 'c': []::VARCHAR[], 'o': []::STRUCT(id BIGINT, late VARCHAR)[]}}).o AS o FROM l),
staged AS (SELECT r.*, coalesce(early, late) AS stage FROM r LEFT JOIN (SELECT unnest(o, max_depth := 2) FROM f) v ON r.id = v.id)"""


@query("f12_staged_funnel", f"WITH {_STAGES_SQL} SELECT source, stage, count(*) AS n FROM staged GROUP BY ALL")
def f12(spark, sf):
    return _funnel(spark, sf).groupBy("source", "stage").agg(F.count("*").alias("n"))


@query("f12_first_failures", f"WITH {_STAGES_SQL} SELECT id, stage FROM staged")
def f12_rows(spark, sf):
    return _funnel(spark, sf).select("id", "stage")


@query("w1_intake_funnel", f"""WITH {_STAGES_SQL}, firsts AS (SELECT c, min(id) AS first FROM staged WHERE stage IN ('accepted', 'cooldown') AND c <> '' GROUP BY c),
o AS (SELECT source, stage, CASE stage WHEN 'accepted' THEN id WHEN 'canonical_dup' THEN (SELECT first FROM firsts WHERE firsts.c = staged.c) END AS kept FROM staged)
SELECT source, count(*) AS raw, count_if(stage = 'accepted') AS accepted, count_if(stage IN ('url_dup', 'role_dup', 'canonical_dup')) AS duplicates, count(DISTINCT CASE WHEN kept IN (SELECT id FROM staged WHERE stage = 'accepted') THEN kept END) AS opportunities FROM o GROUP BY source""")
def w1(spark, sf):
    """Counts of each source; an opportunity is an accepted posting, and each source that shows it too has a share in it."""
    rows = _funnel(spark, sf).select("id", "source", "stage", "kept_id")
    shown = rows.withColumn("kept", F.when(F.col("stage") == "accepted", F.col("id")).when(F.col("stage") == "canonical_dup", F.col("kept_id")))
    accepted = rows.where("stage = 'accepted'").select(F.col("id").alias("kept"), F.lit(True).alias("real"))
    shown = shown.join(accepted, "kept", "left")
    same = F.col("stage").isin("url_dup", "role_dup", "canonical_dup")
    return shown.groupBy("source").agg(F.count("*").alias("raw"), F.count_if(F.col("stage") == "accepted").alias("accepted"), F.count_if(same).alias("duplicates"), F.countDistinct(F.when(F.col("real"), F.col("kept"))).alias("opportunities"))


_SCORED = f"SELECT id, title, source, posted, round(coalesce(pay_min, 0) / 1500, 0) AS score, {q.seniority('title')} AS level FROM postings"


@query("f13_opportunity_filter", f"SELECT id, score, level FROM ({_SCORED}) WHERE score >= 30 AND level = 'senior' AND posted >= DATE '1998-01-01' AND contains(lower(title), 'engineer')")
def f13(spark, sf):
    rows = _posting(spark, sf).withColumns({"score": F.round(F.coalesce("pay_min", F.lit(0)) / 1500, 0), "level": title.seniority(F.col("title"))})
    return fi.opportunity_filter(rows, min_score=30, level="senior", since="1998-01-01", term="engineer", state=None).select("id", "score", "level")


@query("f14_application_rules", f"""WITH a AS (SELECT num, company_id, applied, score, coalesce(score < 2.5, true) AS f1, report = '' AS f2, coalesce({q.status('status_text')} IN ('Discarded', 'SKIP', 'Rejected'), false) AS f3 FROM applications),
b AS (SELECT *, concat_ws(',', CASE WHEN f1 THEN 'score' END, CASE WHEN f2 THEN 'report' END, CASE WHEN f3 THEN 'closed' END) AS failed FROM a)
SELECT num, failed, CASE WHEN failed <> '' THEN 'reject' WHEN row_number() OVER (PARTITION BY company_id % 10, applied, failed = '' ORDER BY score DESC NULLS LAST, num) > 1 THEN 'defer' ELSE 'apply' END AS decision FROM b""")
def f14(spark, sf):
    label, _ = status.canonical(F.col("status_text"))
    rows = view(spark, sf, "applications").withColumns({"status": label, "person": F.col("company_id") % 10})
    return fi.application_rules(rows, 1, 2.5).select("num", F.array_join("failed", ",").alias("failed"), "decision")


@query("f15_find_applications", f"SELECT num, applied, company FROM applications WHERE {q.status('status_text')} = 'Applied' AND contains(lower(company), 'acme') AND applied >= DATE '1999-01-01' ORDER BY applied DESC, num DESC LIMIT 50")
def f15(spark, sf):
    label, _ = status.canonical(F.col("status_text"))
    return fi.find_applications(view(spark, sf, "applications").withColumn("status", label), "Applied", "acme", "1999-01-01", 50).select("num", "applied", "company")


@query("f16_title_gate", f"""SELECT id, CASE WHEN {any_of('title', ['sales', 'graduate'])} THEN 'exclusion' WHEN regexp_matches(t, '\\bjunior\\b') AND NOT regexp_matches(t, '\\b(senior|staff|principal|lead|manager|director|head|vp)\\b') THEN 'junior' WHEN regexp_matches(t, '\\bintern(ship|s)?\\b') THEN 'intern' WHEN regexp_matches(t, '\\bassociate\\b') AND NOT regexp_matches(t, '\\bassociate\\s+(director|vp|vice president|dean|partner)\\b') THEN 'associate'
 WHEN len(list_intersect(string_split_regex(t, '[^a-z0-9+#]+'), ['data', 'engineer', 'solutions', 'architect'])) = 0 THEN 'no overlap' END AS reason FROM (SELECT id, title, lower(title) AS t FROM postings)""")
def f16(spark, sf):
    return _posting(spark, sf).select("id", fi.title_gate(F.col("title"), ["Data Engineer", "Solutions Architect"], ["sales", "graduate"], True).alias("reason"))
