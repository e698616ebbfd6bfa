"""Costly column functions are computed once a row."""

import contextlib
import datetime as dt
import io
from functools import reduce

from pyspark.sql import functions as F

from joblode.functions import company, misc, skills, text, title
from joblode.operators import filters, joins, windows


def _replacements(df) -> int:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("extended")
    # the text names each twice: in the tree, and again below it
    return out.getvalue().split("== Physical Plan ==")[1].count("regexp_replace(") // 2


def test_keys_hold_no_part_twice(spark):
    rows = spark.range(3).select(F.col("id").cast("string").alias("c"), F.current_date().alias("d"))
    # company_key has four replacements, a title and a place one each
    assert _replacements(rows.select(company.company_key(F.col("c")))) == 4
    assert _replacements(rows.select(misc.canonical_key(F.col("c"), F.col("c"), F.col("c"), F.col("d")))) == 6


def test_skill_pattern_tries_a_first_letter_once(spark):
    names = sorted(skills.SKILLS, key=len, reverse=True)
    plain = "(?:^|[^a-z0-9])(" + "|".join(map(skills._quoted, names)) + ")(?=[^a-z0-9+#]|$)"
    texts = [f"{a} {b}" for a, b in zip(names, names[7:] + names[:7])] + [f"x{n},{n}s {n}+ {n}.{n}" for n in names] + ["java javascript; react react native. rag c++ c# next.js lean six sigma six-sigma llm llms", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = rows.select(F.regexp_extract_all("t", F.lit(skills.PATTERN), 1).alias("a"), F.regexp_extract_all("t", F.lit(plain), 1).alias("b")).collect()
    assert all(r.a == r.b for r in found) and any(r.a for r in found)
    assert "(?:java|" not in skills.PATTERN and skills.PATTERN.count("javascript") == 0


def test_conditional_tests_hold_no_part_twice(spark):
    rows = spark.range(3).select(F.col("id").cast("string").alias("c"))
    # where a test is conditional, Spark does not share its parts: six spellings, two clean-ups; one for a URL's hint
    assert _replacements(rows.select(F.when(F.rand() < 2, title.tier(F.col("c"))))) == 8
    assert _replacements(rows.select(F.when(F.rand() < 2, filters.location_filter(F.col("c"), F.col("c"), F.col("c"), ["tx", "ca"], ["india", "emea"], ["remote"], ["c++"])))) == 1


def test_keywords_of_one_pattern_are_those_of_many(spark):
    words = ["tx", "new york", "c++", "a.i", "(us)"]
    texts = ["austin, tx", "txa", "new  york", "in new york", "c++", "c+++", "axi", "a.i", "(us)", "us", "xtx tx", "", None]
    rows = spark.createDataFrame([(x,) for x in texts], "c string")
    one_by_one = reduce(lambda a, b: a | b, [F.lower("c").rlike(text.anchored(w)) for w in words])
    assert rows.where(~text.any_anchored(F.col("c"), words).eqNullSafe(one_by_one)).count() == 0
    assert not any(r.b for r in rows.select(text.any_anchored(F.col("c"), []).alias("b")).collect())
    # the end of a place and the beginning of a hint are ends of words
    places = spark.createDataFrame([("Austin TX", "https://a.b/job/new-york/1"), ("Austin T", "https://a.b/job/x/1"), ("new", "https://a.b/job/york/1"), (None, None)], "l string, u string")
    got = places.select(filters.location_filter(F.col("l"), F.col("u"), F.lit(None).cast("string"), ["tx", "new york"]).alias("b")).collect()
    assert [bool(r.b) for r in got] == [True, False, False, True]


def test_repost_clusters_hold_no_group_whole(spark):
    begin = dt.date(2024, 1, 1)
    days = [(i * 7 % 400, f"u{i % 50}") for i in range(3000)]
    rows = spark.createDataFrame([("acme", f"t{i % 3}", u, begin + dt.timedelta(d)) for i, (d, u) in enumerate(days)], "company_key string, title_key string, url string, day date").repartition(4)
    out = io.StringIO()
    got = windows.repost_clusters(rows, 30)
    with contextlib.redirect_stdout(out):
        got.explain()
    assert "collect_" not in out.getvalue()
    want = []
    for t in range(3):
        now, entries = [], sorted({x for i, x in enumerate(days) if i % 3 == t})
        for d, u in [*entries, (10**6, "")]:
            if now and d - now[0][0] > 30:
                first = {}
                for x, y in now:
                    first.setdefault(y, x)
                if len(first) >= 2 and max(first.values()) - min(first.values()) >= 1:
                    want.append((f"t{t}", min(first.values()), max(first.values()), len(first)))
                now = [x for x in now if d - x[0] <= 30]
            now.append((d, u))
    assert sorted((r.title_key, (r.first_day - begin).days, (r.last_day - begin).days, r.n_urls) for r in got.collect()) == sorted(want) and len(want) > 9


def test_equal_replies_are_matched_once(spark):
    said = [(1, "hr@globex.io", "Data Engineer role"), (2, "jobs@mail.globex.io", "data engineer ROLE"), (3, None, "a role at Globex Inc"), (4, "hr@globex.io", None), (5, "x", "nothing")]
    replies = spark.createDataFrame(said, "message_id long, sender string, text string")
    tracked = spark.createDataFrame([(7, "Globex Inc", "Data Engineer"), (8, "Globex Inc", "SRE")], "num long, company string, role string")
    got, out = joins.reply_matches(replies, tracked), io.StringIO()
    with contextlib.redirect_stdout(out):
        got.explain()
    words = [line for line in out.getvalue().splitlines() if "Generate explode(" in line]
    assert words and not any("message_id" in line for line in words)
    assert sorted(map(tuple, got.collect())) == [(1, 7, 3.5), (2, 7, 3.5), (3, None, 2.0), (4, None, 2.0), (5, None, 0.0)]


def test_tracker_drift_reads_states_and_notes_once(spark):
    """each was computed by every step that read it."""
    count = {c: spark.sparkContext.accumulator(0) for c in ("notes", "status")}

    def counted(name):
        seen = count[name]

        def same(x):
            seen.add(1)
            return x

        return F.udf(same, "string")(F.col(name))

    talks = spark.createDataFrame([(1, "Acme", "Data Engineer", "see #7 in tracker", "Offer"), (2, "Acme", "Data Engineer", "", "rejected"), (3, "Other", "Janitor", None, "x")], "interview_id int, company string, role string, notes string, round string")
    apps = spark.createDataFrame([(7, "Acme Inc", "Data Engineer", "Applied"), (8, "Globex", "Data Engineer", "Offer")], "num int, company string, role string, status string")
    got = joins.tracker_drift(talks.withColumn("notes", counted("notes")), apps.withColumn("status", counted("status"))).collect()
    assert sorted((r.interview_id, r.num, r.method, r.action, r.suggested) for r in got) == [(1, 7, "tracker-ref", "auto", "Offer"), (2, 7, "fuzzy", "auto", "Rejected"), (3, None, "unmatched", "unmatched", None)]
    assert {c: a.value for c, a in count.items()} == {"notes": 3, "status": 2}


def test_scores_carry_columns_of_postings(spark):
    """the audit joined postings to their scores and computed them twice."""
    from joblode.plans.aggregating import a28
    from joblode.plans.joining import profiles

    postings = spark.createDataFrame([(1, "Data Engineer", "Python", "Acme", "Austin", "US", "full-time", 9.5)], "id long, title string, description string, company string, location string, country string, employment string, pay_min double")
    plain, told = joins.score(postings, profiles(spark)), joins.score(postings, profiles(spark), carried=("country", "pay_min"))
    assert told.columns == [*plain.columns, "country", "pay_min"]
    assert sorted(told.select(*plain.columns).collect()) == sorted(plain.collect())
    assert {(r.country, r.pay_min) for r in told.collect()} == {("US", 9.5)}
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        a28(spark, "/root/testdata/sf0.001").explain()
    assert "SortMergeJoin" not in out.getvalue() and out.getvalue().count("FileScan") == 1
