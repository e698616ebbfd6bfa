"""Cases with known answers for the operators whose results SQL does not check."""

import datetime as dt
import random
import shutil

import pytest
from pyspark.sql import functions as F

from joblode.functions import company, misc, money, place, text, title, web
from joblode.functions.funding import funding
from joblode.operators import aggregates, filters, joins, similarity, windows
from joblode.operators.tracker import merge_additions
from joblode.sources import files
from joblode.streaming import jobs


def day(x):
    return dt.date.fromisoformat(x)


def values(spark, column, *inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in df.select(column(F.col("x")).alias("y"), "i").orderBy("i").select("y").collect()]


def test_keys(spark):
    assert values(spark, lambda c: company.company_key(c, text.nfkc), "Acme Inc.", "ACME", "AT&T", "IBM", "Hooli (formerly X)", "Acme Group LLC", None, "Škoda", "Koda", "S.A.") == ["acme", "acme", "at and t", "international business machines", "hooli", "acme", "", "škoda", "koda", ""]
    assert values(spark, text.text_key, "ＡＢＣ  Def!", "İstanbul", "日本 語") == ["abc def", "istanbul", "日本 語"]
    assert values(spark, title.title_identity, "Engineer, Senior", "Senior Engineer", "!!!") == ["engineer senior", "engineer senior", "!!!"]
    assert values(spark, web.strict_key, "HTTP://A.com/x/?b=2&a=1&utm_x=3#f", "N/A", "ftp://a/b", "https://a.com") == ["https://a.com/x?a=1&b=2", "", "", "https://a.com/"]
    assert values(spark, web.scan_key, "https://A.com/Jobs/X/?gh_jid=Q&lang=en", "text") == ["https://a.com/jobs/x?gh_jid=Q", "text"]


def test_money(spark):
    for raw, want in (("80-90k EUR", (80000.0, 90000.0, 85000.0)), ("$123,684—$254,644 USD", (123684.0, 254644.0, 189164.0)), ("45.000,00", (45000.0,) * 3), ("45000,50", (45000.5,) * 3), ("82.5k", (82500.0,) * 3), ("35.000", (35000.0,) * 3), ("competitive", (None,) * 3), ("9ok", (None,) * 3), (None, (None,) * 3)):
        assert tuple(values(spark, lambda c, i=i: money.amounts(c)[i], raw)[0] for i in range(3)) == want


def test_titles(spark):
    assert values(spark, title.tier, "Summer Intern, Director of Product", "Associate Director", "Associate Editor", "Engineer II", "Plain", "Graduate Program Analyst", None) == ["intern", "senior", "entry", "mid", "mid", "intern", "mid"]
    assert values(spark, title.seniority, "Senior Staff Engineer", "VP Sales", "Head of Data", "Junior Achievement Lead", "Engineer") == ["staff", "vp", "head", "lead", "mid"]
    df = spark.createDataFrame([("c", x) for x in ("Senior Data Platform Engineer", "Data Platform Engineer, Senior", "Junior Data Platform Engineer", "Senior Analytics Engineer", "Senior Analytics Engineer, People", "Software Engineer", "Software Engineer II")], "company_key string, title string")
    got = {tuple(sorted((r.a, r.b))) for r in joins.same_openings(df).collect()}
    assert got == {("Data Platform Engineer, Senior", "Senior Data Platform Engineer")}


def test_places(spark):
    assert values(spark, lambda c: place.country_verdict(c, F.lit(""))[0], "Austin, TX", "Remote", "London, UK", "Ukiah, CA", "", "EMEA", "Remote - United States") == ["us", "non-us", "non-us", "us", "unknown", "non-us", "us"]


def test_keyword_rules(spark):
    hit = lambda word, t: values(spark, lambda c: filters.keyword(F.lower(c), word), t)[0]
    assert hit("vp", "VP Sales") and not hit("vp", "mvp lead") and hit("word:java", "Java dev") and not hit("word:java", "JavaScript dev")
    assert hit("stem:analy", "Analytics") and not hit("stem:analy", "Psychoanalyst") and hit("data + ai", "AI for data") and not hit("data + ai", "data entry") and not hit("word:", "x")


def test_liveness_without_an_identifier(spark):
    df = spark.createDataFrame([("x" * 400,), ("Apply",), ("This job has expired",)], "c string")
    got = {r.c: r.code for r in web.liveness(df, F.lit(200), F.lit("https://a/b"), F.lit("https://a/b"), F.col("c"), F.lit("")).collect()}
    assert got == {"x" * 400: "no_apply_control", "Apply": "insufficient_content", "This job has expired": "expired_body"}


def test_applied_dates(spark):
    notes = ["Applied 2024-01-02; x", "applied ~2024-02-03", "see #12 applied 2001-01-01", "see #1 applied 2001-01-01", None, "see #9. Applied 2024-05-06", "applied 2024-13-40"]
    got = values(spark, lambda c: misc.applied_date(c, F.lit(1), F.lit("1999-01-01").cast("date")), *notes)
    assert [x.isoformat() for x in got] == ["2024-01-02", "2024-02-03", "1999-01-01", "2001-01-01", "1999-01-01", "2024-05-06", "1999-01-01"]


LEDGER = "seq long, num int, day date, state string, source string"


def test_ledger_fold_and_velocity(spark):
    rows = [
        (1, 1, "2026-01-01", "Applied", "agent"), (2, 1, "2026-01-09", "Responded", "agent"), (3, 1, "2026-01-04", "Responded", "correction"),
        (4, 2, "2026-01-01", "Applied", "agent"), (5, 2, "2026-01-07", "Responded", "agent"), (6, 2, "2026-01-08", "Interview", "agent"), (7, 2, "2026-01-08", "-", "agent"),
        (8, 3, "2026-01-01", "Applied", "manual"), (9, 3, "2026-01-21", "Responded", "manual"), (10, 4, "2026-01-01", "Applied", "agent"), (11, 5, "2026-01-05", "Responded", "guess"),
        (12, 6, "2026-01-03", "Responded", "agent"), (13, 6, "2026-01-03", "Applied", "agent"), (14, 7, "2026-01-02", "Offer", "correction"), (15, 8, "2026-01-01", "-", "agent"),
    ]
    df = spark.createDataFrame([(a, b, day(c), d, e) for a, b, c, d, e in rows], LEDGER)
    folded = windows.fold_ledger(df)
    got = {r.num: [(x.state, x.day.isoformat()) for x in r.timeline] for r in folded.collect()}
    assert got[1] == [("Applied", "2026-01-01"), ("Responded", "2026-01-04")] and [x[0] for x in got[2]] == ["Applied", "Responded"]
    assert [x[0] for x in got[6]] == ["Responded", "Applied"] and got[7] == [("Offer", "2026-01-02")] and got[8] == []
    hop = {r.hop: r for r in windows.stage_velocity(folded).collect()}["Applied>Responded"]
    assert (hop.n, hop.median, hop.p75, hop.censored) == (3, 6.0, 13.0, 2)


def fold(rows):
    """The ledger rules, one entry after the other."""
    out = {}
    for _, num, d, state, source in sorted(rows):
        t = out.setdefault(num, [])
        if state == "-":
            if t:
                t.pop()
            continue
        at = max((i for i, x in enumerate(t) if x[0] == state), default=None)
        if source == "correction" and at is not None:
            t[at] = (state, d)
        else:
            t.append((state, d))
    return {n: sorted(t, key=lambda x: x[1]) for n, t in out.items()}


def test_ledger_fold_matches_plain_rules(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.randint(1, 12), day("2026-01-01") + dt.timedelta(days=rnd.randint(0, 9)), rnd.choice(["Applied", "Responded", "Interview", "-"]), rnd.choice(["agent", "correction", "x"])) for i in range(300)]
    got = {r.num: [(x.state, x.day) for x in r.timeline] for r in windows.fold_ledger(spark.createDataFrame(rows, LEDGER).repartition(3)).collect()}
    assert got == fold(rows)


def clusters(rows, window=90, least=1):
    out, groups = [], {}
    for c, t, u, d in rows:
        groups.setdefault((c, t), set()).add((d, u))
    for key, g in groups.items():
        now = []
        for x in [*sorted(g), None]:
            if x is None or (now and (x[0] - now[0][0]).days > window):
                first = {}
                for d, u in now:
                    first.setdefault(u, d)
                if len(first) > 1 and (max(first.values()) - min(first.values())).days >= least:
                    out.append((*key, min(first.values()), max(first.values()), len(first)))
                now = [y for y in now if x is not None and (x[0] - y[0]).days <= window]
            if x is not None:
                now.append(x)
    return sorted(out)


TIERS = {
    "Research Associate - Professor Smith Laboratory": "entry",
    "Associate Marketing Director": "senior",
    "Associate Chief of Staff": "senior",
    "Associate Head of Growth": "senior",
    "Summer Intern, Director of Product": "intern",
    "Senior Intern Coordinator": "senior",
    "Intern Program Director": "senior",
    "Intern, Associate Dean of Student Life": "intern",
    "Administrative Associate, Office of the Dean": "entry",
    "Associate Attorney": "entry",
    "Associate Counsel, Office of the General Counsel": "entry",
    "Associate General Counsel": "senior",
    "Junior Staff Accountant": "entry",
    "Software Engineer II": "mid",
    "Engineer-III": "senior",
    "A.I. Engineer I": "entry",
    "Graduate Program Analyst": "intern",
    "Graduate Engineer": "mid",
    "Co-op Student": "intern",
    "Mid-Level Developer": "mid",
    "Entry-Level QA": "entry",
    "Software Engineer": "mid",
    "Sr. Analyst": "senior",
    "Vice President, Sales": "senior",
    "I.T. Support": "mid",
    "": "mid",
    "Associate Vice President": "senior",
    "Head of Data": "senior",
    "Head Chef": "mid",
    "Graduate Scheme Manager": "intern",
    "Trainee Cohort Lead": "senior",
    "SDE L4": "mid",
    "V Engineer": "mid",
    "Associate": "entry",
    "Dean & Company Associate Consultant": "entry",
}


def test_career_tiers(spark):
    assert dict(zip(TIERS, values(spark, title.tier, *TIERS), strict=True)) == TIERS


def test_repost_clusters(spark):
    schema = "company_key string, title_key string, url string, day date"
    rows = [("a", "t", "u1", day("2024-01-10")), ("a", "t", "u2", day("2024-03-01")), ("a", "t", "u3", day("2024-12-01")), ("b", "t", "u1", day("2026-01-08")), ("b", "t", "u2", day("2026-02-11")), ("b", "t", "u3", day("2026-02-11")), ("c", "t", "u1", day("2024-01-01")), ("c", "t", "u2", day("2024-01-01"))]
    got = sorted(tuple(r) for r in windows.repost_clusters(spark.createDataFrame(rows, schema)).collect())
    assert got == [("a", "t", day("2024-01-10"), day("2024-03-01"), 2), ("b", "t", day("2026-01-08"), day("2026-02-11"), 3)]
    assert len(windows.repost_clusters(spark.createDataFrame(rows, schema), least=0).collect()) == 3
    rnd = random.Random(5)
    rows = [(rnd.choice("ab"), rnd.choice("xy"), f"u{rnd.randint(0, 15)}", day("2024-01-01") + dt.timedelta(days=rnd.randint(0, 500))) for _ in range(160)]
    got = sorted(tuple(r) for r in windows.repost_clusters(spark.createDataFrame(rows, schema)).collect())
    assert got == clusters(rows)


def test_cross_listings_find_every_near_pair(spark):
    rnd = random.Random(9)
    base = [rnd.getrandbits(64) for _ in range(12)]
    fps = base + [b ^ sum(1 << x for x in rnd.sample(range(64), n)) for b in base for n in (0, 1, 4, 5, 6)]
    rows = [(i, f"{f:016x}", f"c{i % 5}", f"u{i}", day("2024-01-01") + dt.timedelta(days=i % 100)) for i, f in enumerate(fps)] + [(999, "", "x", "u", day("2024-01-01"))]
    schema = "id long, fingerprint string, company string, url string, day date"
    rows += [(1000 + i, f"{base[0]:016x}", rnd.choice(["c0", "c1", "c9", None]), rnd.choice(["v1", "v2", "v3"]), day("2024-01-01") + dt.timedelta(days=rnd.randrange(200))) for i in range(60)]
    one = {}
    for i, f, c, u, d in sorted(rows, key=lambda r: r[0]):
        one.setdefault((f, c or "", u, d), i)
    want = {}
    for (f, c, u, d), i in one.items():
        hits = [(int(f, 16) ^ int(g, 16)).bit_count() for g, e, v, t in one if f and g and c != e and u != v and abs((d - t).days) <= 90]
        if near := [x for x in hits if x <= 5]:
            want[i] = (f, len(near), min(near))
    got = {r.id: (r.fingerprint, r.n_links, r.least_distance) for r in similarity.cross_listings(spark.createDataFrame(rows, schema)).collect()}
    assert got == want and {0, 5} <= {d for _, _, d in want.values()}
    sizes = {f: sum(r[1] == f for r in rows) for f in {r[1] for r in rows if r[1]}}
    classes = {(f, g): ((int(f, 16) ^ int(g, 16)).bit_count(), sizes[f], sizes[g]) for f in sizes for g in sizes if f <= g and (int(f, 16) ^ int(g, 16)).bit_count() <= 5}
    assert {(r.fp_a, r.fp_b): (r.distance, r.n_a, r.n_b) for r in similarity.link_classes(spark.createDataFrame(rows, schema)).collect()} == classes


def test_copies_of_one_text_cost_one_row_each(spark):
    rows = [(i, "00000000000000ff", f"c{i}", f"u{i}", day("2024-01-01")) for i in range(600)]
    got = similarity.cross_listings(spark.createDataFrame(rows, "id long, fingerprint string, company string, url string, day date")).collect()
    assert len(got) == 600 and {(r.n_links, r.least_distance) for r in got} == {(599, 0)}


def test_names_without_words_and_comments(spark):
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    assert [tuple(r) for r in joins.company_links(names("?", "--", "Acme"), names("--", "?!", "Acme")).collect()] == [("Acme", "Acme", "exact")]
    df = spark.createDataFrame([("Acme | Data Engineer | Berlin https://a.example/x | https://acme.example/jobs\nmore",), ("Acme hires",), ("Globex | QA",), (None,)], "body string")
    got = [(r.company, r.role, r.location, r.url) for r in misc.board_comments(df, "body").collect()]
    assert got == [("Acme", "Data Engineer", "Berlin", "https://a.example/x"), ("", "", "", ""), ("Globex", "QA", "", ""), ("", "", "", None)]


def test_match_scores(spark):
    postings = spark.createDataFrame([
        (1, "Senior Data Engineer", "Python and SQL on Apache Spark, kafka", "Acme", "Remote, TX", "US", "full-time", 90000.0),
        (2, "Junior Data Engineer", "Python", "", "Berlin", "", "", None),
        (3, "Sales Lead", "", "Acme", "", "", "contract", 10.0),
    ], "id int, title string, description string, company string, location string, country string, employment string, pay_min double")
    profile = [(1, [["data", "engineer"]], [["python"], ["sql"], ["apache", "spark"]], [["data"]], [["kafka"]], ["sales"], "senior", 9, 60000.0)]
    profiles = spark.createDataFrame(profile, "profile_id int, roles array<array<string>>, skills array<array<string>>, areas array<array<string>>, leadership array<array<string>>, exclusions array<string>, seniority string, years int, pay double")
    got = {r.id: r for r in joins.score(postings, profiles).collect()}
    # title 25, seniority 12, skills 18, functional 5 (one of two), experience 5, company 5, pay 7, place 10, employment 4, leadership 3
    assert got[1].score == 94 and got[1].band == "strong"
    assert got[2].score == 20 and "veto" in got[2].penalties and got[3].score == 20
    with pytest.raises(Exception):
        joins.score(postings.drop("title"), profiles).collect()


TRACKED = "num long, company string, company_key string, role string, score double, report string, url string, req string, via string"


def test_tracker_merge(spark):
    t = spark.createDataFrame([
        (1, "Acme", "acme", "Dev", 3.0, "r1", "u1", "", ""), (2, "Globex", "globex", "Payments QA Engineer", 2.0, "", "", "", ""), (3, "Stark", "stark", "Boss", 1.0, "r3", "", "q1", ""), (4, "?", "", "Data Curator", 1.0, "", "", "", "Agency A"), (5, "Hidden", "", "Clerk", 1.0, "", "", "", ""),
    ], TRACKED)
    a = spark.createDataFrame([
        (1, 50, "Other", "other", "Zed", 4.0, "", "u1", "", ""),  # the URL decides
        (2, 51, "Globex", "globex", "payments qa engineer!", 4.5, "", "x", "", ""),  # no URL stands against this role
        (3, 2, "New", "new", "Boss", 5.0, "", "y", "", ""), (4, 60, "New", "new", "boss", 1.0, "", "z", "", ""),  # other URLs are other postings
        (5, 61, "Acme", "acme", "Lead", 2.5, "r1", "w", "", ""),  # so they are against an equal report
        (6, 62, "Acme", "acme", "Lead Dev", None, "r1", "", "", ""),  # an unknown URL says nothing; no score changes none
        (7, 63, "Stark", "stark", "boss", 2.0, "", "", "q2", ""),  # another requisition
        (8, 64, "?", "", "data curator", 2.0, "", "", "", "Agency B"), (9, 65, "?", "", "Data curator", 2.5, "", "", "", "agency a"),
        (10, 66, "", "", "Clerk", 9.0, "", "", "", ""), (11, 66, "", "", "Clerk", 9.5, "", "", "", ""),  # nothing names these
        (12, 67, "Zeta", "zeta", "One", 1.0, "", "same", "", ""), (13, 68, "Zeta", "zeta", "Two", 2.0, "", "same", "", ""),
    ], "seq long, " + TRACKED)
    got = {r.num: (r.company, r.role, r.score, r.merged, r.rule) for r in merge_additions(t, a).collect()}
    assert got == {
        1: ("Acme", "Lead Dev", 4.0, 2, "url"), 2: ("Globex", "Payments QA Engineer", 4.5, 1, "role"), 3: ("Stark", "Boss", 1.0, 0, ""), 4: ("?", "Data Curator", 2.5, 1, "role"), 5: ("Hidden", "Clerk", 1.0, 0, ""),
        69: ("New", "Boss", 5.0, 1, "new"), 60: ("New", "boss", 1.0, 1, "new"), 61: ("Acme", "Lead", 2.5, 1, "new"), 63: ("Stark", "boss", 2.0, 1, "new"), 64: ("?", "data curator", 2.0, 1, "new"),
        66: ("", "Clerk", 9.0, 1, "new"), 70: ("", "Clerk", 9.5, 1, "new"), 67: ("Zeta", "One", 2.0, 2, "new"),
    }


def test_tracker_merge_of_empty_tables_and_missing_columns(spark):
    short = "num long, company string, company_key string, role string, score double, report string, url string"
    one = [(1, "Acme", "acme", "Dev", 3.0, None, None)]
    t, none = spark.createDataFrame(one, short), spark.createDataFrame([], "seq long, " + short)
    assert [tuple(r) for r in merge_additions(t, none).collect()] == [(1, "Acme", "Dev", 3.0, 0, "")]
    assert [r.rule for r in merge_additions(t.where("false"), spark.createDataFrame([(1, *one[0])], "seq long, " + short)).collect()] == ["new"]


def test_a_chain_of_keys_is_one_opportunity(spark):
    """Rows 2i and 2i + 1 share a canonical key, rows 2i + 1 and 2i + 2 a native id."""
    n = 500
    rows = [(i, f"c{i // 2}", "acme", f"n{(i + 1) // 2}", "s", f"u{i}", day("2024-01-01")) for i in range(n)] + [(900, "", "", "", "s", "", day("2024-01-01")), (901, "", "", "", "s", "", day("2024-01-01")), (902, None, "", "", "s", "u1", day("2024-01-01"))]
    got = {r.opportunity: r.n for r in aggregates.merge_opportunities(spark.createDataFrame(rows, "id long, canonical string, company_key string, native_id string, source string, url string, day date")).collect()}
    assert got == {0: n, 900: 1, 901: 1, 902: 1}


def test_html_is_decoded_twice(spark):
    got = values(spark, text.html_text, "<p>A &amp;lt;b&amp;gt;x &#233;</p><script>var z = '<p>';</script> <style>p{}</style>end", None, "x" * 5000)
    assert got == ["A <b>x é end", None, "x" * 4000]


def test_requirement_candidates(spark):
    from joblode.functions.skills import requirement_candidates

    page = "About us\n- Foo Bar\nRequirements:\n- Python and Kafka, Python\n- The SQL\nno bullet Java\nBenefits\n- Free Lunch\n## Skills\n* Rust"
    got = requirement_candidates(spark.createDataFrame([(1, page), (2, None), (3, "")], "id int, t string"), "id", "t").collect()
    assert sorted((r.id, r.candidate, r.n) for r in got) == [(1, "Kafka", 1), (1, "Python", 2), (1, "Rust", 1), (1, "SQL", 1)]


def test_lifecycle_tells_of_keys_that_stay_away(spark, tmp_path):
    """Key 1 is never seen again, key 2 comes back, key 3 is seen at the end; the watermark tells what passed."""
    at = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    rows = [(1, at(0)), (2, at(0)), (2, at(40)), (3, at(152))]
    spark.createDataFrame(rows, "key long, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key long, ts timestamp").parquet(str(tmp_path / "in"))
    got = sorted((r.key, (r.at - at(0)).days, r.state) for r in jobs.drained(jobs.lifecycle(stream, 30, 120), str(tmp_path / "out")).collect())
    assert got == [(1, 0, "active"), (1, 30, "stale"), (1, 120, "closed"), (2, 0, "active"), (2, 30, "stale"), (2, 40, "active"), (2, 70, "stale"), (3, 152, "active")]


def test_streams_without_rows_and_batches_that_run_again(spark, tmp_path):
    spark.createDataFrame([], "key long, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key long, ts timestamp").parquet(str(tmp_path / "in"))
    assert jobs.drained(jobs.intake(stream, ["key"], "ts"), str(tmp_path / "out")).collect() == []
    ledger = spark.readStream.schema(LEDGER).parquet(str(tmp_path / "in"))
    assert jobs.corrected_ledger(ledger, str(tmp_path / "ledger")).collect() == []
    spark.createDataFrame([(5, dt.datetime(2024, 1, 1))], "key long, ts timestamp").write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):
        # a lost checkpoint makes the batch run again over its folder
        shutil.rmtree(tmp_path / "out" / "checkpoint", ignore_errors=True)
        assert [r.key for r in jobs.drained(jobs.intake(stream, ["key"], "ts"), str(tmp_path / "out")).collect()] == [5]


def test_tracker_files_have_a_header_each(spark, tmp_path):
    (tmp_path / "a.md").write_text("| # | Date | Company | Role | Score | Status | PDF | Report | Notes |\n|---|---|---|---|---|---|---|---|---|\n| 1 | 2024-01-02 | Acme | Dev | 4/5 | Applied | y | r | n |\n")
    (tmp_path / "b.md").write_text("| Company | # | Role | Status | Date | Score |\n|---|---|---|---|---|---|\n| Globex | 2 | QA | 3.5/5 | 2024-01-03 | Offer |\n")
    (tmp_path / "c.md").write_text("| 3 | 2024-01-04 | Stark | Boss | 2/5 | Hired | y | r | last |\n| short |\n")
    got = sorted((r.num, r.company, r.role, r.score, r.status) for r in files.tracker_table(spark, str(tmp_path)).collect())
    assert got == [(1, "Acme", "Dev", 4.0, "Applied"), (2, "Globex", "QA", 3.5, "Offer"), (3, "Stark", "Boss", 2.0, "Hired")]


def test_replies_and_funding_and_profiles(spark):
    kind, evidence, state = misc.reply_class(F.col("x"), F.col("y"))
    df = spark.createDataFrame([("We will not be sending an offer letter; unfortunately no", ""), ("Please book a time for the coding test", ""), ("assessment", ""), ("hello", "interview_invite"), ("your job", None), (None, None)], "x string, y string")
    got = [tuple(r) for r in df.select(kind, F.array_join(evidence, ","), state).collect()]
    assert got == [("Rejected", "unfortunately", "Rejected"), ("Need Action", "book a time,coding test", "Interview"), ("Need Action", "assessment", "Responded"), ("Interview", "interview_invite", "Interview"), ("Unknown", "", "Needs Review"), ("Unknown", "", "Needs Review")]
    full = spark.createDataFrame([("a", "Senior", "x", "y", 3, 1.0, "remote"), ("", None, "", None, None, None, " ; ")], "roles string, seniority string, skills string, areas string, years int, pay double, places string")
    assert [r.confidence for r in misc.profiles(full).collect()] == [1.0, 0.0]


HEADLINES = {
    'Acme raises $12.5M Series A to grow': ('Acme', 12500000.0, 'series a'),
    'Startup raises $3M': ('',),
    'VC-backed startup Globex reportedly raises $5 million': ('Globex', 5000000.0, ''),
    'Lands $2M for AI startup Hooli': ('Hooli', 2000000.0, ''),
    'Initech (YC) closes a large seed round': ('Initech', None, 'seed'),
    'Umbrella announces $5M in seed funding - TechCrunch': ('Umbrella', 5000000.0, 'seed'),
    'Wayne, Inc. gets $2,500,000 in funding | News': ('Wayne', 2500000.0, ''),
    'Stark hits $1.5 billion valuation': ('Stark', 1500000000.0, ''),
    'Soylent valued at $900M': ('Soylent', 900000000.0, ''),
    'Tyrell emerges from stealth': ('Tyrell', None, ''),
    'Cyberdyne in talks to raise at $1B': ('Cyberdyne', 1000000000.0, ''),
    'The data company Hooli raises $1M': ('Hooli', 1000000.0, ''),
    'AI startup Globex Labs secures $3B in Series C funding': ('Globex Labs', 3000000000.0, 'series c'),
    'Andco-backed Umbrella nabs $40 million': ('Umbrella', 40000000.0, ''),
    'Acme raises $40M, then cuts 30% of staff': ('',),
    'Acme raises $90M fund': ('',),
    'Acme acquires a rival for $3M': ('',),
    'Acme raises $40M as it cuts 30% of cloud costs': ('Acme', 40000000.0, ''),
    'Ask HN: who raised $5M?': ('who', 5000000.0, ''),
    'Fintech platform raises $5M': ('',),
    'Rocket maker Apex raises $7M': ('Apex', 7000000.0, ''),
    "Bezos's space startup raises $5M": ('',),
    'Acme lands new customers': ('',),
    'Platform Zeta hits unicorn status as it raises more': ('Zeta', None, ''),
    None: ('',),
    '': ('',),
    'Acme raises $40M Series A, then cuts 30 % of staff': ('',),
    'Acme raises $40M Series B while cutting cloud costs': ('Acme', 40000000.0, 'series b'),
    'AI startup Globex reportedly raises funds': ('Globex', None, ''),
    'Initech valued at $2 billion': ('Initech', 2000000000.0, ''),
    'How to raise money': ('',),
}


def test_funding_headlines(spark):
    df = spark.createDataFrame([(h, "guardian") for h in HEADLINES], "x string, s string")
    got = {r.x: (r.company, r.amount, r["round"]) if r.company else ("",) for r in funding(df, "x", "s").collect()}
    assert got == HEADLINES
    one = funding(spark.createDataFrame([("Acme raises $5M", s) for s in ("techcrunch", "blog", None)] + [("Acme emerges from stealth", "blog")], "x string, s string"), "x", "s")
    assert sorted((r.s or "", r.x, r.confidence) for r in one.collect()) == [("", "Acme raises $5M", "medium"), ("blog", "Acme emerges from stealth", "low"), ("blog", "Acme raises $5M", "medium"), ("techcrunch", "Acme raises $5M", "high")]


def test_skills_by_any_spelling(spark):
    from joblode.functions import skills

    got = values(spark, skills.extract, "React Native, react and NodeJS on k8s; C++/C#, .NET. A safe place to go", "SAFe 6, Go; Certified Scrum Master and Lean Six-Sigma", None)
    assert got == [["React Native", "React", "Node.js", "Kubernetes", "C++", "C#", ".NET"], ["Certified ScrumMaster", "Lean Six Sigma", "Go", "SAFe"], []]


def test_title_prefixes_lose_no_pair(spark):
    rnd = random.Random(21)
    vocab = ["data", "platform", "engineer", "software", "payments", "growth", "risk", "search", "senior", "analyst", "product", "manager", "api"]
    names = sorted({" ".join(rnd.sample(vocab, rnd.randint(1, 6))).title() for _ in range(150)})
    df = spark.createDataFrame([("c", x) for x in names] + [("", "Data Risk")], "company_key string, title string")
    t = df.select("title", F.array_distinct(title.role_tokens(F.col("title"))).alias("t"), title.seniority_words(F.col("title")).alias("s")).where("company_key <> ''")
    pairs = t.alias("x").join(t.alias("y"), F.col("x.title") < F.col("y.title")).where(title.same_role(F.col("x.title"), F.col("y.title"), F.col("x.t"), F.col("y.t"), F.col("x.s"), F.col("y.s")))
    want = {(r[0], r[1]) for r in pairs.select("x.title", "y.title").collect()}
    assert len(want) > 20 and {(r.a, r.b) for r in joins.same_openings(df).collect()} == want
