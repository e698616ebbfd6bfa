"""Queries of the row-level projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from joblode.functions import company as co
from joblode.functions import funding as fu, money, place, skills, status, text, title, web
from joblode.functions import misc
from joblode.plans import sql as q
from joblode.plans.adapters import frame, pick, view
from joblode.plans.registry import query


def _posting(spark, sf):
    return view(spark, sf, "postings")


@query("p01_normalise_posting", f"""
SELECT id, concat(source, ':', CASE WHEN n <> '' THEN n WHEN coalesce(trim(url), '') <> '' THEN trim(url) ELSE t END) AS posting_id, t AS title, trim(coalesce(company, '')) AS company,
  {q.workplace('location', 't')} AS workplace, {q.employment("concat(t, ' ', coalesce(description, ''))")} AS employment, pay_min, pay_max, upper(currency) AS currency
FROM (SELECT *, trim(title) AS t, {q.native_id('url')} AS n FROM postings)""")
def p01(spark, sf):
    return misc.normalised_posting(_posting(spark, sf)).select("id", "posting_id", "title", "company", "workplace", "employment", F.col("salary.min").alias("pay_min"), F.col("salary.max").alias("pay_max"), F.col("salary.currency").alias("currency"))


@query("p02_city_state_country", f"""
SELECT id, CASE WHEN s = '' THEN '' ELSE trim(regexp_extract(regexp_replace(loc, ',\\s*[A-Za-z ]+?\\s*$', ''), '([^,|]*)$', 1)) END AS city, s AS state,
  CASE WHEN regexp_matches(lower(loc), '\\bunited states\\b') OR regexp_matches(loc, '\\bUSA?\\b') OR s <> '' THEN 'US' ELSE '' END AS country
FROM (SELECT *, CASE WHEN regexp_matches(tail, '^[A-Z]{{2}}$') THEN tail ELSE coalesce({q.case_map('lower(tail)', place.STATES)}, '') END AS s
  FROM (SELECT id, trim(coalesce(location, '')) AS loc, trim(regexp_extract(trim(coalesce(location, '')), ',\\s*([A-Za-z ]+?)\\s*$', 1)) AS tail FROM postings))""")
def p02(spark, sf):
    city, state, country = place.city_state_country(F.col("location"))
    return _posting(spark, sf).select("id", city.alias("city"), state.alias("state"), country.alias("country"))


@query("p03_workplace_employment", f"SELECT id, {q.workplace('location', 'title')} AS workplace, {q.employment('description')} AS employment FROM postings")
def p03(spark, sf):
    return _posting(spark, sf).select("id", place.workplace(F.col("location"), F.col("title")).alias("workplace"), place.employment(F.col("description")).alias("employment"))


@query("p04_native_job_id", f"SELECT page_id, {q.native_id('url')} AS native_id FROM pages")
def p04(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", web.native_id(F.col("url")).alias("native_id"))


@query("p05_provenance", f"""
SELECT id, coalesce(trim(url), '') AS origin_url, source, 1 AS n_sources, {q.native_id('url')} AS native_id, coalesce(company, '') AS employer, posted FROM postings""")
def p05(spark, sf):
    return misc.provenance(misc.normalised_posting(_posting(spark, sf))).select("id", "provenance.origin_url", "provenance.source", F.size("provenance.sources").alias("n_sources"), "provenance.native_id", "provenance.employer", "provenance.posted")


@query("p06_country_verdict", f"""
SELECT id, CASE WHEN b = '' THEN 'unknown' WHEN f <> '' THEN 'non-us' WHEN regexp_matches(b, '{q.s(place.US_RE)}') OR regexp_matches(b, '{q.s(place.STATE_RE)}') OR regexp_matches(b, '{q.s(place.CODE_RE)}') THEN 'us'
   WHEN regexp_matches(b, '\\bremote\\b') OR regexp_matches(b, '\\b(worldwide|global|emea|apac|latam|americas|north america|europe)\\b') THEN 'non-us' ELSE 'unknown' END AS verdict, f AS foreign_name
FROM (SELECT id, b, regexp_extract(b, '{q.s(place.FOREIGN_RE)}', 2) AS f FROM (SELECT id, concat_ws(' | ', nullif(lower(trim(coalesce(location, ''))), ''), nullif({q.hint('url')}, '')) AS b FROM postings))""")
def p06(spark, sf):
    verdict, evidence = place.country_verdict(F.col("location"), F.col("url"))
    return _posting(spark, sf).select("id", verdict.alias("verdict"), F.regexp_extract(evidence, "^foreign: (.*)$", 1).alias("foreign_name"))


@query("p07_text_key", "SELECT id, trim(regexp_replace(lower(title), '[^\\p{L}\\p{M}\\p{N}]+', ' ', 'g')) AS k, trim(regexp_replace(lower(coalesce(company, '')), '[^\\p{L}\\p{M}\\p{N}]+', '-', 'g')) AS company_slug FROM postings")
def p07(spark, sf):
    return _posting(spark, sf).select("id", text.text_key(F.col("title")).alias("k"), text.text_key(F.coalesce("company", F.lit("")), "-").alias("company_slug"))


@query("p08_ascii_fold", "SELECT id, trim(regexp_replace(regexp_replace(lower(strip_accents(company)), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS spaced, trim(regexp_replace(regexp_replace(lower(strip_accents(company)), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS squeezed FROM postings")
def p08(spark, sf):
    return _posting(spark, sf).select("id", text.ascii_fold(F.col("company")).alias("spaced"), text.ascii_fold(F.col("company"), "delete").alias("squeezed"))


@query("p09_company_key", f"SELECT id, {q.company_key('company')} AS company_key FROM postings")
def p09(spark, sf):
    return _posting(spark, sf).select("id", co.company_key(F.col("company"), text.nfkc).alias("company_key"))


@query("p10_employer_flags", f"SELECT id, k = '' OR regexp_matches(k, '^({'|'.join(co.BOARDS)})( (employer|jobs?))?$') AS board, {q.staffing('company')} AS staffing, k = '' OR k IN ({q.strings(co.GENERIC)}) AS generic FROM (SELECT id, company, {q.company_key('company')} AS k FROM postings)")
def p10(spark, sf):
    k = co.company_key(F.col("company"))
    return _posting(spark, sf).select("id", co.is_board(k).alias("board"), co.is_staffing(F.col("company")).alias("staffing"), co.is_generic(k).alias("generic"))


@query("p11_loose_company_key", "SELECT id, regexp_replace(regexp_replace(trim(regexp_replace(lower(coalesce(company, '')), '[^\\p{L}\\p{M}\\p{N}]+', ' ', 'g')), '^(.+?)( (inc|incorporated|llc|ltd|limited|corp|corporation|co|company|plc|gmbh|ag|sa|bv|nv|pty|oy|ab|as))+$', '\\1'), '^(.+) (group|holdings|technologies|technology|solutions|labs|software|systems|services|international|global)$', '\\1') AS k FROM postings")
def p11(spark, sf):
    return _posting(spark, sf).select("id", co.loose_company_key(F.col("company")).alias("k"))


@query("p12_url_keys", f"""
WITH p AS (SELECT id, url, lower({q.url('url', 1)}) AS scheme, lower({q.url('url', 2)}) AS host, {q.url('url', 3)} AS path, {q.url('url', 4)} AS qs FROM postings),
l AS (SELECT *, list_filter(string_split(qs, '&'), lambda x: x <> '') AS ps, CASE WHEN path = '' THEN '/' ELSE path END AS root FROM p),
k AS (SELECT *, list_filter(ps, lambda x: lower(string_split(x, '=')[1]) NOT IN ({q.strings(web.STORE_DROP)})) AS p1,
  list_sort(list_filter(ps, lambda x: NOT regexp_matches(lower(string_split(x, '=')[1]), '^{web.STRICT_DROP}$'))) AS p2,
  list_filter(ps, lambda x: lower(string_split(x, '=')[1]) NOT IN ({q.strings(web.SCAN_DROP)})) AS p3 FROM l)
SELECT id, lower(CASE WHEN host = '' THEN trim(coalesce(url, '')) ELSE regexp_replace(concat(scheme, '://', host, root, CASE WHEN len(p1) > 0 THEN concat('?', array_to_string(p1, '&')) ELSE '' END), '/$', '') END) AS store_key,
  CASE WHEN host <> '' AND scheme IN ('http', 'https') THEN concat('https://', host, CASE WHEN length(root) > 1 THEN regexp_replace(root, '/$', '') ELSE root END, CASE WHEN len(p2) > 0 THEN concat('?', array_to_string(p2, '&')) ELSE '' END) ELSE '' END AS strict_key,
  CASE WHEN host = '' THEN url ELSE concat(scheme, '://', host, CASE WHEN lower(regexp_replace(path, '/+$', '')) = '' THEN '/' ELSE lower(regexp_replace(path, '/+$', '')) END, CASE WHEN len(p3) > 0 THEN concat('?', array_to_string(p3, '&')) ELSE '' END) END AS scan_key FROM k""")
def p12(spark, sf):
    u = F.col("url")
    return _posting(spark, sf).select("id", web.store_key(u).alias("store_key"), web.strict_key(u).alias("strict_key"), web.scan_key(u).alias("scan_key"))


@query("p13_canonical_key", f"SELECT id, {q.canonical_key()} AS canonical FROM postings")
def p13(spark, sf):
    return _posting(spark, sf).select("id", misc.canonical_key(F.col("company"), F.col("title"), F.col("location"), F.col("posted")).alias("canonical"))


@query("p14_title_identity", "SELECT id, CASE WHEN k = '' THEN trim(lower(title)) ELSE k END AS identity FROM (SELECT id, title, array_to_string(list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower(title), '[^\\p{L}\\p{M}\\p{N}]+', ' ', 'g')), ' '), lambda x: x <> ''))), ' ') AS k FROM postings)")
def p14(spark, sf):
    return _posting(spark, sf).select("id", title.title_identity(F.col("title")).alias("identity"))


_PLACE = "(remote|hybrid|on-?site|us|usa|uk|emea|apac|latam|europe|united states|[a-z]+, [a-z]{2})"


@query("p15_role_key", f"SELECT id, concat({q.company_key('company')}, '::', trim(regexp_replace(regexp_replace(lower(trim(title)), '(\\s*[(\\[]{_PLACE}[)\\]]|\\s+-\\s+{_PLACE})+$', ''), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g'))) AS role_key FROM postings")
def p15(spark, sf):
    return _posting(spark, sf).select("id", F.concat_ws("::", co.company_key(F.col("company")), title.role_key(F.col("title"))).alias("role_key"))


@query("p16_role_tokens", f"SELECT id, array_to_string({q.role_tokens('title')}, ' ') AS tokens, array_to_string({q.seniority_words('title')}, ' ') AS levels FROM postings")
def p16(spark, sf):
    return _posting(spark, sf).select("id", F.array_join(title.role_tokens(F.col("title")), " ").alias("tokens"), F.array_join(title.seniority_words(F.col("title")), " ").alias("levels"))


@query("p17_seniority", f"SELECT id, {q.seniority('title')} AS level FROM postings")
def p17(spark, sf):
    return _posting(spark, sf).select("id", title.seniority(F.col("title")).alias("level"))


@query("p18_career_tier", f"SELECT id, {q.tier('title')} AS tier FROM postings")
def p18(spark, sf):
    return _posting(spark, sf).select("id", title.tier(F.col("title")).alias("tier"))


@query("p19_title_scope", """SELECT id, CASE WHEN regexp_matches(t, '\\b(sales lead|leads)\\b') THEN 'ic' WHEN regexp_matches(t, '\\b(director|head|vp|vice president|chief|executive|manager|principal|staff)\\b') OR regexp_matches(t, '\\b(team lead|lead,|lead -|lead \\(|engineering lead|tech lead|project lead)') THEN 'leadership' ELSE 'ic' END AS scope,
 regexp_matches(t, '\\b(solutions|sales engineer|customer engineer|customer success|forward deployed|consultant|consulting|implementation|onboarding|professional services|pre-sales|presales|advocacy|developer relations|devrel)\\b') AS client_facing FROM (SELECT id, lower(title) AS t FROM postings)""")
def p19(spark, sf):
    return _posting(spark, sf).select("id", title.scope(F.col("title")).alias("scope"), title.client_facing(F.col("title")).alias("client_facing"))


@query("p20_status", f"SELECT num, {q.status('status_text')} AS status, regexp_matches(lower(trim(replace(status_text, '**', ''))), '^(duplicad|dup\\b|repost)') AS moved_to_notes FROM applications")
def p20(spark, sf):
    label, moved = status.canonical(F.col("status_text"))
    return view(spark, sf, "applications").select("num", label.alias("status"), moved.alias("moved_to_notes"))


@query("p21_html_text")
def p21(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", text.html_text(F.col("html")).alias("text"))


@query("p22_description_key", "SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(html), '<[^>]*>', ' ', 'g'), '[?&](utm_[a-z]+|ref|source)=[^\\s&\"'']*', '', 'g'), '\\s+', ' ', 'g')) AS description_key FROM pages")
def p22(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", text.description_key(F.col("html")).alias("description_key"))


@query("p23_simhash", q.FINGERPRINTS + "SELECT d.doc_id, coalesce(fingerprint, '') AS fingerprint FROM documents d LEFT JOIN fps f ON d.doc_id = f.doc_id")
def p23(spark, sf):
    from joblode.operators.similarity import sha_simhash

    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", sha_simhash(F.col("text")).alias("fingerprint"))


@query("p24_money", f"SELECT id, lo, hi, (lo + hi) / 2 AS mid FROM (SELECT id, least(a, b) AS lo, greatest(a, b) AS hi FROM (SELECT id, {q.money('pay', 0)} AS a, {q.money('pay', 1)} AS b FROM postings))")
def p24(spark, sf):
    low, high, mid = money.amounts(F.col("pay"))
    return _posting(spark, sf).select("id", low.alias("lo"), high.alias("hi"), mid.alias("mid"))


@query("p25_buckets", """SELECT id, CASE WHEN d IS NULL OR d > 14 THEN 'older/unknown' WHEN d <= 1 THEN '<=24h' WHEN d <= 3 THEN '<=3d' WHEN d <= 7 THEN '<=7d' ELSE '<=14d' END AS freshness,
 CASE WHEN pay_min IS NULL THEN 'unknown' WHEN pay_min < 50000 THEN '<50k' WHEN pay_min < 100000 THEN '50-100k' WHEN pay_min < 150000 THEN '100-150k' WHEN pay_min < 200000 THEN '150-200k' ELSE '200k+' END AS pay_band FROM (SELECT id, pay_min, date_diff('day', posted, DATE '2001-08-01') AS d FROM postings)""")
def p25(spark, sf):
    return _posting(spark, sf).select("id", money.freshness(F.col("posted"), F.lit("2001-08-01").cast("date")).alias("freshness"), money.pay_band(F.col("pay_min")).alias("pay_band"))


@query("p26_skills", f"SELECT id, array_to_string({q.skills('description')}, ',') AS skills FROM postings")
def p26(spark, sf):
    return _posting(spark, sf).select("id", F.array_join(skills.extract(F.col("description")), ",").alias("skills"))


@query("p27_requirement_candidates")
def p27(spark, sf):
    docs = frame(spark, sf, "SELECT doc_id, concat('About us', chr(10), 'Requirements:', chr(10), '- ', replace(text, chr(10), concat(chr(10), '- ')), chr(10), 'Benefits', chr(10), '- Free Lunch') AS text FROM documents")
    return skills.requirement_candidates(docs, "doc_id", "text")


@query("p28_buckets", """SELECT page_id, CASE WHEN regexp_matches(h, '(^|\\.)(greenhouse\\.io|lever\\.co|ashbyhq\\.com)$') THEN 'ats' WHEN regexp_matches(h, '^blog\\.') THEN 'blog' WHEN regexp_matches(h, '^m\\.') THEN 'mobile' WHEN h = '' THEN 'unknown' ELSE 'site' END AS vendor,
 CASE WHEN n IS NULL THEN 'unknown' WHEN n < 50 THEN 'small' WHEN n < 500 THEN 'medium' ELSE 'large' END AS size_band FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS h, list_max(list_transform(regexp_extract_all(url, '[0-9]+'), lambda x: CAST(x AS BIGINT))) AS n FROM pages)""")
def p28(spark, sf):
    host = web.parts(F.col("url"))["host"]
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", misc.vendor(host).alias("vendor"), misc.size_band(F.col("url")).alias("size_band"))


@query("p29_trust_score", f"""
WITH b AS (SELECT id, trim(coalesce(url, '')) AS u, lower({q.url('url', 1)}) AS sc, lower({q.url('url', 2)}) AS h, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(strip_accents(coalesce(company, ''))), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM postings),
c AS (SELECT *, u = '' AS missing, sc IN ('http', 'https') AND h <> '' AS valid, {q.on_hosts('h', web.SHORTENERS)} AS odd, {q.on_hosts('h', web.ATS_HOSTS)} AS ats, contains(h, array_to_string(w, '')) OR len(list_filter(w, lambda x: length(x) >= 3 AND contains(h, x))) > 0 AS named FROM b),
d AS (SELECT *, valid AND odd AS f1, valid AND len(w) > 0 AND NOT ats AND NOT named AS f2 FROM c)
SELECT id, CAST(100 - CASE WHEN missing THEN 40 WHEN NOT valid THEN 50 ELSE CASE WHEN f1 THEN 25 ELSE 0 END + CASE WHEN f2 THEN 15 ELSE 0 END END AS INTEGER) AS score,
 concat_ws(',', CASE WHEN missing THEN 'missing_apply_url' END, CASE WHEN NOT missing AND NOT valid THEN 'invalid_url' END, CASE WHEN f1 THEN 'suspicious_domain' END, CASE WHEN f2 THEN 'company_domain_mismatch' END) AS flags FROM d""")
def p29(spark, sf):
    words = F.filter(F.split(text.ascii_fold(F.coalesce("company", F.lit("")), "delete"), " "), lambda w: w != "")
    score, flags, _ = web.trust(F.col("url"), words)
    return _posting(spark, sf).select("id", score.alias("score"), F.array_join(flags, ",").alias("flags"))


_PAGE = web.PAGE_PHRASES
_OPENING = "(" + "|".join(_PAGE["opening"]) + ")"
_CLOSED = f"""({q.phrase('b', _PAGE['closed'])} OR regexp_matches(b, 'job.*no longer open') OR regexp_matches(b, '{web.CLOSING_DAY.replace('^', 'closed on ')}')
 OR len(list_filter(regexp_extract_all(b, '(?:^|[^a-z0-9]){_OPENING}(?:[^a-z0-9].{{0,59}}?)??has been filled(?: out)?(?:[^a-z0-9]|$)'), lambda x: NOT regexp_matches(x, '(application|form) has been filled') AND NOT contains(x, 'filled out'))) > 0)"""


@query("p30_liveness", f"""
SELECT page_id, CASE WHEN st IN (404, 410) THEN 'http_gone' WHEN {q.phrase('b', _PAGE['challenge'])} OR {q.phrase('b', _PAGE['ray'], True)} OR regexp_matches(b, 'attention required.*cloudflare') THEN 'bot_challenge' WHEN st IN (403, 429, 503) THEN 'access_blocked' WHEN st >= 500 THEN 'server_error'
 WHEN regexp_matches(lower(fin), '[?&]error=true') THEN 'expired_url' WHEN {_CLOSED} THEN 'expired_body'
 WHEN own IS NOT NULL AND NOT contains(lower(fin), own) THEN 'redirected_off_posting' WHEN {q.phrase('b', web.CONTROL_PHRASES['apply'], True)} OR {q.phrase('b', web.CONTROL_PHRASES['form'])} THEN 'apply_control_visible' WHEN regexp_matches(b, '[0-9] jobs? found') OR {q.phrase('b', _PAGE['listing'])} THEN 'listing_page'
 WHEN length(b) < 300 THEN 'insufficient_content' ELSE 'no_apply_control' END AS code
FROM (SELECT page_id, st, fin, {q.folded('body')} AS b, list_extract(regexp_extract_all(lower(req), '[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}|\\d{{5,}}'), -1) AS own FROM ({misc.FETCHED}))""")
def p30(spark, sf):
    return web.liveness(frame(spark, sf, misc.FETCHED), *map(F.col, ("st", "req", "fin", "body", "body"))).select("page_id", "code")


@query("p31_applied_date", "SELECT num, coalesce(try_cast(list_filter(list_transform(string_split_regex(notes, '[;.\\n]'), lambda c: CASE WHEN regexp_matches(c, '(?i)\\bapplied\\s+~?(\\d{4}-\\d{2}-\\d{2})') AND len(list_filter(regexp_extract_all(c, '#(\\d+)\\b', 1), lambda x: x <> CAST(num AS VARCHAR))) = 0 THEN regexp_extract(c, '(?i)\\bapplied\\s+~?(\\d{4}-\\d{2}-\\d{2})', 1) END), lambda x: x IS NOT NULL)[1] AS DATE), applied) AS applied_on FROM applications")
def p31(spark, sf):
    return view(spark, sf, "applications").select("num", misc.applied_date(F.col("notes"), F.col("num"), F.col("applied")).alias("applied_on"))


_KIND, _EVIDENCE, _SUGGESTED = q.reply("text")
_TALK = "SELECT conv_id, turn, concat(CASE CAST((conv_id + turn) % 11 AS INT) WHEN 0 THEN 'Unfortunately we must close. ' WHEN 1 THEN 'Please schedule an interview: phone screen. ' WHEN 2 THEN 'A coding challenge awaits; book a time. ' WHEN 3 THEN 'We are pleased to offer the role. ' WHEN 4 THEN 'Thank you for applying. ' WHEN 5 THEN 'Newsletter: recommended jobs. ' WHEN 6 THEN '面试邀请 ' WHEN 7 THEN 'Fill out the form. ' ELSE '' END, text) AS text FROM conversations"


@query("p32_reply_class", f"SELECT conv_id, turn, {_KIND} AS reply_type, array_to_string({_EVIDENCE}, ',') AS evidence, {_SUGGESTED} AS suggested FROM ({_TALK})")
def p32(spark, sf):
    kind, evidence, state = misc.reply_class(F.col("text"))
    return frame(spark, sf, _TALK).select("conv_id", "turn", kind.alias("reply_type"), F.array_join(evidence, ",").alias("evidence"), state.alias("suggested"))


_MAILS = f"SELECT conv_id, turn, concat({pick('conv_id + turn', ('Unfortunately we must close. ', 'Unfortunately you have not been selected. ', 'We decided to pursue other candidates. ', 'Let us book a time for the phone screen. ', 'We regret to inform you. Schedule your interview ', 'We REGRET to inform you that we will not be moving forward. ', ''))}, text) AS text FROM conversations"
_SAID = {k: f"list_filter([{q.strings(v)}], lambda p: contains(lower(text), p))" for k, v in misc.MAIL_PHRASES.items()}


@query("p32_mail_class", f"""WITH m AS (SELECT conv_id, turn, {', '.join(f'{v} AS {k}' for k, v in _SAID.items())} FROM ({_MAILS}))
SELECT conv_id, turn, CASE WHEN len(strong) > 0 OR len(weak) >= 2 THEN 'rejection' WHEN len(invite) > 0 THEN 'invite' ELSE 'unknown' END AS classification, array_to_string(CASE WHEN len(strong) > 0 OR len(weak) >= 2 THEN list_concat(strong, weak) ELSE invite END, ',') AS matched,
 CASE WHEN len(strong) > 0 THEN 'strong' WHEN len(weak) >= 2 THEN 'weak' END AS strength FROM m""")
def p32_mails(spark, sf):
    return misc.mail_class(frame(spark, sf, _MAILS), "text").select("conv_id", "turn", "classification", F.array_join("matched", ",").alias("matched"), "strength")


_FIRMS = ("Acme", "AI startup Globex Labs", "Initech (YC)", "The data company Hooli", "Stark's", "Andco-backed Umbrella", "Wayne, Inc.", "Rocket maker Apex", "Startup", "Bezos's space startup", "Show HN: Tyrell", "Fintech platform")
_EVENTS = (" raises $12.5M Series A to grow", " secures $3B in Series C funding", " closes $700K seed round", " lands new customers", " nabs 40 million for robots", " announced its Series B", " gets $2,500,000 in funding", " hits $1.5 billion valuation", " valued at $900M", " emerges from stealth", " in talks to raise", " raises $40M, then cuts 30% of staff", " raises $90M fund", " acquires a rival for $3M", " raises $5M - TechCrunch", " announces $5M in seed funding | News", " reportedly raised over $2B", " hits unicorn status as it raises more")
_NEWS = f"SELECT o_orderkey AS id, concat({pick('o_custkey', _FIRMS)}, {pick('o_orderkey', _EVENTS)}) AS headline, {pick('o_custkey + o_orderkey', ('techcrunch', 'blog', 'guardian'))} AS source FROM orders"


def _funded_sql() -> str:
    """The headline's words step by step: classes, the run of words that is named, and what is cut off it."""
    low = lambda x: f"list_transform({x}, lambda w: lower(w))"
    first = lambda x, y: f"coalesce(list_position({x}, {y}), 0)"
    phrase = lambda x, ps: f"len(list_filter([{q.strings(ps)}], lambda p: contains({x}, concat(' ', p, ' ')))) > 0"
    bare = f"trim(lower(w), '{q.s(fu.EDGES)}')"
    letter = f"coalesce({q.case_map(bare, fu.LETTERS)}, CASE WHEN regexp_matches({bare}, '{fu.MONEY}') THEN 'M' WHEN regexp_matches({bare}, '^[0-9][0-9,.]*%?$') THEN '#' ELSE 'n' END)"
    run = ", ".join(f"CASE WHEN regexp_matches(c, '^{p}') THEN {{'at': length(regexp_extract(c, '^{p}', 1)), 'n': length(regexp_extract(c, '^{p}', 2))}} END" for p in fu.NAMED)
    kind = f"CASE WHEN lower(w) = 'the' THEN 'd' WHEN lower(w) IN ({q.strings(fu.KINDS)}) THEN CASE WHEN lower(w) IN ({q.strings(fu.SECTORS)}) THEN 'b' ELSE 'k' END WHEN lower(w) IN ({q.strings(fu.SECTORS)}) THEN 'z' ELSE 'n' END"
    steps = (
        "string_split(trim(string_split(regexp_replace(regexp_replace(trim(array_to_string(t[r.at + 1:r.at + r.n], ' '), '\"''`'), '[''’][sS]$', ''), ' *\\([^()]*\\)$', ''), ',')[1]), ' ')",
        f"w[{first(low('w[1:len(w) - 1]'), chr(39) + 'startup' + chr(39))} + 1:]",
        f"CASE WHEN coalesce(len(list_filter({low('w')}[list_position(list_transform(w, lambda x: regexp_matches(lower(x), '[''’]s$')), true) + 1:], lambda x: x IN ('company', 'startup'))) > 0, false) THEN []::VARCHAR[] ELSE w END",
        f"CASE WHEN len(w) > 3 AND array_to_string({low('w')}[len(w) - 2:], ' ') = 'in talks to' THEN w[1:len(w) - 3] WHEN len(w) > 1 AND lower(w[len(w)]) = 'reportedly' THEN w[1:len(w) - 1] ELSE w END",
        f"CASE WHEN {first(low('w[2:len(w) - 1]'), chr(39) + 'defies' + chr(39))} > 0 THEN w[1:{first(low('w[2:len(w) - 1]'), chr(39) + 'defies' + chr(39))}] ELSE w END",
        "CASE WHEN len(w) > 1 AND regexp_matches(w[1], '^[A-Z][A-Za-z0-9&.-]+-[bB]acked$') THEN w[2:] ELSE w END",
        "CASE WHEN len(list_filter(range(1, len(w) - 1), lambda i: lower(w[i]) IN ('maker', 'creator') AND lower(w[i + 1]) = 'of')) > 0 THEN w[1:list_filter(range(1, len(w) - 1), lambda i: lower(w[i]) IN ('maker', 'creator') AND lower(w[i + 1]) = 'of')[1] - 1] ELSE w END",
        f"w[length(regexp_extract(array_to_string(list_transform(w, lambda w: {kind}), ''), '^(d?[zb]+[kb]).', 1)) + 1:]",
        "w[coalesce(list_max(list_filter(range(2, len(w)), lambda i: lower(w[i]) = 'maker')), 0) + 1:]",
        f"CASE WHEN len(w) > 1 AND lower(w[1]) IN ({q.strings(fu.KINDS)}) THEN w[2:] ELSE w END",
    )
    chain = " ".join(f", s{i + 1} AS (SELECT * EXCLUDE (w), {step} AS w FROM s{i})" for i, step in enumerate(steps))
    none = f"length(name) NOT BETWEEN 2 AND 70 OR regexp_matches(name, '[<>]') OR lower(name) IN ({q.strings(fu.NOBODY)}) OR {phrase(_SPACED('name'), fu.MARKET)} OR NOT regexp_matches(name, '[A-Za-z0-9]')"
    other = f"regexp_matches(lower(h), '^({'|'.join(fu.THREADS)})([^a-z0-9]|$)') OR {phrase('al', fu.OTHER_NEWS)} OR regexp_matches(c, '{fu.STAFF_CUT}') OR regexp_matches(c, '{fu.FUND_RAISED}') OR NOT {phrase('al', fu.FUNDING)}"
    amount = f"try_cast(replace(regexp_extract(h0, '(?i){q.s(fu.AMOUNT)}', 1), ',', '') AS DOUBLE) * coalesce(CAST({q.case_map(f'lower(regexp_extract(h0, {chr(39)}(?i){q.s(fu.AMOUNT)}{chr(39)}, 2))', {k: str(v) for k, v in fu.UNITS.items()})} AS DOUBLE), 1)"
    stage = f"coalesce(replace(list_sort(list_transform(list_filter([{q.strings(fu.ROUNDS)}], lambda p: contains(al, concat(' ', p, ' '))), lambda p: {{'at': instr(al, concat(' ', p, ' ')), 'p': p}}))[1].p, 'pre seed', 'pre-seed'), '')"
    return f"""WITH h0 AS (SELECT *, trim(regexp_replace(headline, '\\s+', ' ', 'g')) AS h0 FROM ({_NEWS})), h1 AS (SELECT *, {_SPACED('h0')} AS al, regexp_replace(regexp_replace(string_split(h0, ' | ')[1], '(?i) - ({'|'.join(fu.PUBLISHERS)}).*$', ''), '(?i)^({'|'.join(fu.OPENERS)}) *', '') AS h FROM h0),
t AS (SELECT *, string_split(h, ' ') AS t FROM h1), c AS (SELECT *, array_to_string(list_transform(t, lambda w: {letter}), '') AS c FROM t), s0 AS (SELECT *, coalesce({run}, {{'at': 0, 'n': 0}}) AS r, []::VARCHAR[] AS w FROM c){chain},
n AS (SELECT *, array_to_string(w, ' ') AS name, {amount} AS a, {stage} AS st FROM s{len(steps)}), f AS (SELECT *, CASE WHEN {none} OR {other} THEN '' ELSE name END AS company, source IN ({q.strings(fu.SURE_SOURCES)}) AS sure, a IS NOT NULL OR st <> '' AS told FROM n)
SELECT id, company, CASE WHEN company <> '' THEN a END AS amount, CASE WHEN company <> '' THEN st ELSE '' END AS round, CASE WHEN company = '' THEN '' WHEN sure AND told THEN 'high' WHEN sure OR told THEN 'medium' ELSE 'low' END AS confidence FROM f"""


_SPACED = lambda x: f"concat(' ', trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')), ' ')"


@query("p33_funding_headline", _funded_sql())
def p33(spark, sf):
    return fu.funding(frame(spark, sf, _NEWS), "headline", "source").select("id", "company", "amount", "round", "confidence")


_COMMENT = "SELECT id, concat(coalesce(company, ''), CASE WHEN id % 11 = 0 THEN '' ELSE concat(' | ', title) END, CASE WHEN id % 7 = 0 THEN '' ELSE concat(' | ', coalesce(location, ''), CASE WHEN id % 5 = 0 THEN ' https://x.example/a' ELSE '' END) END, chr(10), coalesce(description, ''), ' ', coalesce(url, '')) AS body FROM postings"


@query("p34_board_comment", f"SELECT id, CASE WHEN len(c) > 1 THEN trim(c[1]) ELSE '' END AS company, CASE WHEN len(c) > 1 THEN trim(c[2]) ELSE '' END AS role, trim(regexp_replace(trim(coalesce(c[3], '')), '(?i)https?://\\S+', '', 'g')) AS location, regexp_extract(body, '(?i)https?://[^\\s<>\"]+') AS url FROM (SELECT id, body, string_split(string_split(body, chr(10))[1], '|') AS c FROM ({_COMMENT}))")
def p34(spark, sf):
    return misc.board_comments(frame(spark, sf, _COMMENT), "body").select("id", "company", "role", "location", "url")


@query("p35_hygiene", "SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', ' ', 'g'), '\\+?[0-9][0-9 ().-]{7,}[0-9]', ' ', 'g'), '\\s+', ' ', 'g')) AS clean, concat_ws(',', CASE WHEN trim(text) = '' THEN 'empty' END, CASE WHEN regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}') THEN 'email' END, CASE WHEN regexp_matches(text, '\\+?[0-9][0-9 ().-]{7,}[0-9]') THEN 'phone' END) AS errors FROM documents")
def p35(spark, sf):
    clean, errors = misc.hygiene(F.col("text"))
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", clean.alias("clean"), F.array_join(errors, ",").alias("errors"))


@query("p36_evidence_density", "SELECT id, coalesce(trim(description), '') <> '' AS has_text, coalesce(url, '') <> '' AS has_url, pay_min IS NOT NULL AS has_pay, regexp_matches(d, '\\b\\d+\\+?\\s+years?\\b') AS years, regexp_matches(d, '\\b(degree|bachelor|master|phd)\\b') AS degree, regexp_matches(d, '\\b(certified|certification|certificate)\\b') AS cert FROM (SELECT *, lower(coalesce(description, '')) AS d FROM postings)")
def p36(spark, sf):
    return misc.evidence(_posting(spark, sf)).select("id", "has_text", "has_url", "has_pay", "years", "degree", "cert")


@query("p37_iso_week", "SELECT o_orderkey AS num, concat(CAST(isoyear(o_orderdate) AS VARCHAR), '-W', lpad(CAST(week(o_orderdate) AS VARCHAR), 2, '0')) AS iso_week FROM orders")
def p37(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("num"), misc.iso_week(F.col("o_orderdate")).alias("iso_week"))


_USAGE = "SELECT l_orderkey AS job, l_linenumber AS step, CASE CAST(l_partkey % 5 AS INT) WHEN 0 THEN 'big-1' WHEN 1 THEN 'small-1-preview' WHEN 2 THEN 'local-x' WHEN 3 THEN 'other' ELSE 'big-1-long' END AS model, CASE CAST(l_partkey % 5 AS INT) WHEN 2 THEN 'local' ELSE 'cloud' END AS provider, CAST(floor(l_extendedprice) AS BIGINT) AS input, CAST(floor(l_quantity) AS BIGINT) * 10 AS cached, CAST(floor(l_quantity) AS BIGINT) * 20 AS output FROM lineitem"


@query("p38_token_cost", f"SELECT job, step, model, round(CASE WHEN provider = 'local' THEN 0 ELSE ((input - cached) * i + cached * i * 0.1 + output * o) / 1e6 END, 9) AS cost FROM (SELECT *, CASE WHEN contains(model, 'big-1') THEN 3.0 WHEN contains(model, 'small-1') THEN 0.25 ELSE 1.0 END AS i, CASE WHEN contains(model, 'big-1') THEN 15.0 WHEN contains(model, 'small-1') THEN 1.25 ELSE 4.0 END AS o FROM ({_USAGE}))")
def p38(spark, sf):
    rates = spark.createDataFrame([("big-1", 3.0, 15.0), ("small-1", 0.25, 1.25)], "model string, input_rate double, output_rate double")
    return money.token_cost(frame(spark, sf, _USAGE), rates, (1.0, 4.0), ["local"]).select("job", "step", "model", F.round("cost", 9).alias("cost"))


_PROFILES = "SELECT c_custkey AS profile_id, concat(' ', c_mktsegment, ' ; ', CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'Data Engineer' END) AS roles, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'Senior ' END AS seniority, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'Python;SQL' END AS skills, CASE WHEN c_acctbal < 0 THEN NULL ELSE floor(c_acctbal / 500) END AS years, c_acctbal * 10 AS pay, CASE WHEN c_custkey % 6 = 0 THEN ' ; ' ELSE 'data; cloud' END AS areas, CASE WHEN c_custkey % 7 < 3 THEN '' ELSE 'remote' END AS places FROM customer"


@query("p39_profile", f"""SELECT profile_id, array_to_string(r, ';') AS roles, lower(trim(coalesce(seniority, ''))) AS seniority, floor(100 * (CAST(len(r) > 0 AS INT) + CAST(trim(coalesce(seniority, '')) <> '' AS INT) + CAST(len(s) > 0 AS INT) + CAST(coalesce(years >= 0, false) AS INT) + CAST(pay > 0 AS INT) + CAST(trim(replace(areas, ';', '')) <> '' AS INT) + CAST(trim(places) <> '' AS INT)) / 7.0 + 0.5) / 100 AS confidence
FROM (SELECT *, list_filter(list_transform(string_split(roles, ';'), lambda x: trim(x)), lambda x: x <> '') AS r, list_filter(list_transform(string_split(skills, ';'), lambda x: trim(x)), lambda x: x <> '') AS s FROM ({_PROFILES}))""")
def p39(spark, sf):
    return misc.profiles(frame(spark, sf, _PROFILES)).select("profile_id", F.array_join("target_roles", ";").alias("roles"), "seniority", "confidence")


@query("p40_dates", "SELECT o_orderkey AS num, date_diff('day', d, DATE '2001-08-01') AS days, CAST(d + INTERVAL 10 DAY AS DATE) AS due, CAST(d + INTERVAL 6 MONTH AS DATE) AS review, CAST(date_trunc('week', d) AS DATE) AS week_start, CAST(date_trunc('week', d) + INTERVAL 6 DAY AS DATE) AS week_end FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)")
def p40(spark, sf):
    d = F.col("o_orderdate").cast("date")
    return spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("num"), F.datediff(F.lit("2001-08-01").cast("date"), d).cast("long").alias("days"), F.date_add(d, 10).alias("due"), F.add_months(d, 6).alias("review"), *[c.alias(n) for c, n in zip(misc.week_range(d), ("week_start", "week_end"), strict=True)])


@query("p41_statistics", "SELECT o_custkey AS k, median(v) AS mid, list_sort(list(v))[CAST(floor(count(v) / 2) AS INT) + 1] AS upper_mid, quantile_cont(v, 0.75) AS p75, floor(1000.0 * count_if(v > 100000) / count(*) + 0.5) / 10 AS pct1, CAST(floor(100.0 * count_if(v > 100000) / count(*) + 0.5) AS INTEGER) AS pct FROM (SELECT o_custkey, CAST(o_totalprice AS DOUBLE) AS v FROM orders) GROUP BY o_custkey")
def p41(spark, sf):
    v = F.col("o_totalprice")
    high = F.count_if(v > 100000) / F.count("*")
    return spark.read.parquet(f"{sf}/orders.parquet").groupBy(F.col("o_custkey").alias("k")).agg(F.median(v).alias("mid"), money.upper_median("o_totalprice").alias("upper_mid"), F.percentile(v, F.lit(0.75)).alias("p75"), money.one_decimal(100 * high).alias("pct1"), money.whole(100 * high).alias("pct"))


@query("p42_json_maps", "SELECT user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY ALL")
def p42(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_type", F.explode(F.map_entries(misc.json_map(F.col("props")))).alias("e")).where("e.key = 'k'").groupBy("user_id", "event_type", F.col("e.value").cast("int").alias("k")).agg(F.count("*").alias("n"))


_LISTS = "SELECT c_custkey AS id, concat('please add ', c_name, ', Acme Inc and ', CASE WHEN c_custkey % 2 = 0 THEN 'Globex' ELSE 'AT' END) AS typed, CASE WHEN c_custkey % 3 = 0 THEN 'Globex Technologies' ELSE 'Acme' END AS company FROM customer"


@query("p43_company_list", f"SELECT id, name, company, CASE WHEN a = b THEN true WHEN length(a) < length(b) THEN length(a) >= 4 AND contains(b, a) ELSE length(b) >= 4 AND contains(a, b) END AS matches FROM (SELECT id, name, company, {q.company_key('name')} AS a, {q.company_key('company')} AS b FROM (SELECT id, company, trim(regexp_replace(unnest(regexp_split_to_array(typed, '\\s*(,|;|\\band\\b)\\s*')), '(?i)^(please |add |scan |also )+', '')) AS name FROM ({_LISTS})) WHERE name <> '')")
def p43(spark, sf):
    return co_list(frame(spark, sf, _LISTS))


def co_list(df):
    names = misc.typed_companies(df, "typed")
    return names.select("id", "name", "company", misc.company_match(co.company_key(F.col("name")), co.company_key(F.col("company"))).alias("matches"))
