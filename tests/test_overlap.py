"""Best partners by words in common, with words that stand everywhere."""

import random

import pytest
from pyspark.sql import functions as F

from joblode.operators import joins
from joblode.operators.overlap import best_overlap


@pytest.mark.parametrize("jaccard", [False, True])
def test_best_partner_matches_brute_force(spark, jaccard):
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(60)]
    words = lambda: list(dict.fromkeys([*(["hot"] if rnd.random() < 0.9 else []), *(["warm"] if rnd.random() < 0.5 else []), *rnd.sample(vocab, rnd.randint(0, 4))]))
    queries, items = [(rnd.choice("ab"), words()) for _ in range(80)], [(rnd.choice("abc"), words(), (i, f"u{i}")) for i in range(120)]
    score = lambda x, y: len(set(x) & set(y)) / (len(set(x) | set(y)) if jaccard else 1)
    want = {}
    for g, x in queries:
        fits = [(-score(x, y), item) for h, y, item in items if h == g and set(x) & set(y)]
        if fits:
            want[(g, tuple(sorted(x)))] = (-min(fits)[0], *min(fits)[1])
    q, i = spark.createDataFrame(queries, "group string, words array<string>"), spark.createDataFrame(items, "group string, words array<string>, item struct<id:int,url:string>")
    for frequent in (1000, 8, 1):
        got = {(r.group, tuple(r.words)): (r.score, r.item.id, r.item.url) for r in best_overlap(q, i, jaccard, frequent).collect()}
        assert got.keys() == want.keys() and all(abs(got[k][0] - want[k][0]) < 1e-12 and got[k][1:] == want[k][1:] for k in want)


def test_claims_match_brute_force(spark):
    rnd = random.Random(4)
    words = lambda n: ["total", *[f"w{rnd.randrange(12)}" for _ in range(n)]][: n + rnd.randint(0, 1)]
    claims = [(i, rnd.choice([7, 7, rnd.randrange(20)]), list(dict.fromkeys(words(3)))) for i in range(150)]
    sources = [(i, [7, rnd.randrange(15), 7], list(dict.fromkeys(words(4)))) for i in range(60)]
    every = {w for _, _, ws in sources for w in ws}
    want = {}
    for c, n, ws in claims:
        best = [len(set(ws) & set(v)) for _, ns, v in sources if n in ns]
        want[c] = "confirmed" if best and max(best) >= 2 else "number-only" if best else "context-only" if len(set(ws) & every) >= 2 else "unsupported"
    got = joins.verify_claims(spark.createDataFrame(claims, "claim_id int, number int, words array<string>"), spark.createDataFrame(sources, "source_id int, numbers array<int>, words array<string>"))
    assert {r.claim_id: r.bucket for r in got.collect()} == want and len(set(want.values())) > 2


def test_a_hot_word_does_not_multiply_rows(spark):
    items = spark.range(4000).select(F.lit("g").alias("group"), F.array(F.lit("hot"), F.concat(F.lit("i"), F.col("id").cast("string"))).alias("words"), F.struct("id").alias("item"))
    queries = spark.range(4000).select(F.lit("g").alias("group"), F.array(F.lit("hot"), F.concat(F.lit("q"), F.col("id").cast("string"))).alias("words"))
    got = best_overlap(queries, items)
    assert got.agg(F.count("*"), F.min("item.id"), F.max("item.id"), F.max("score")).first() == (4000, 0, 0, 1.0)


def test_interviews_find_their_applications(spark):
    apps = [(1, "Acme Inc", "Data Platform Engineer", "Applied"), (2, "Globex Tech", "Payments Data Engineer", "Rejected"), (3, "Stark", "Risk Analyst", "Interview"), (4, "Stark Labs", "Risk Analyst", "Applied"), (5, "Wayne", "Growth Lead", "Offer"), (6, "Twice", "x", "Applied"), (6, "Twice", "y", "Applied"), (7, "Odd", "Search API Engineer", None)]
    talks = [
        (10, "ACME", "Data Platform Engineer (Remote)", "", "Scheduled"), (11, "Globex Technology Tech", "Payments Data Engineer", None, "Withdrawn"), (12, "Stark", "Risk Analyst", "", "x"), (13, "Nobody", "Cook", "see # 5 in Tracker", "Confirmed"),
        (14, "Nobody", "Cook", "#99 in tracker", ""), (15, "Nobody", "Cook", "#6 in tracker", ""), (16, "Nobody", "Cook", "", ""), (17, None, None, None, None), (18, "Odd", "Search API Engineer", "", "Offered"), (19, "Z", "", "#3 in tracker", "pending"), (20, "Odd", "Search API Engineer", "", "x"),
    ]
    got = joins.tracker_drift(spark.createDataFrame(talks, "interview_id int, company string, role string, notes string, round string"), spark.createDataFrame(apps, "num long, company string, role string, status string"))
    assert {r.interview_id: (r.num, r.method, r.confidence, r.action, r.suggested) for r in got.collect()} == {
        10: (1, "fuzzy", 1.0, "auto", "Interview"), 11: (2, "fuzzy", 0.8, "review", None), 12: (None, "unmatched", 1.0, "unmatched", None), 13: (5, "tracker-ref", 1.0, "auto", "Offer"), 14: (None, "unmatched", 0.0, "unmatched", None),
        15: (None, "unmatched", 0.0, "unmatched", None), 16: (None, "unmatched", 0.0, "unmatched", None), 17: (None, "unmatched", 0.0, "unmatched", None), 18: (7, "fuzzy", 1.0, "auto", "Offer"), 19: (3, "tracker-ref", 1.0, "ok", None), 20: (7, "fuzzy", 1.0, "review", None),
    }


def test_similar_names_match_brute_force(spark):
    rnd = random.Random(8)
    name = lambda: " ".join(rnd.choice(["bank", "north", "data", "acme", "blue", "labs", "group", "river"]) for _ in range(rnd.randint(1, 6)))
    a, b = {name() for _ in range(60)}, {name() for _ in range(60)}
    dice = lambda x, y: 2 * len(set(x.split()) & set(y.split())) / (len(set(x.split())) + len(set(y.split())))
    df = lambda s: spark.createDataFrame([(x,) for x in s], "name string")
    got = {(r.a, r.b): r.similarity for r in joins.similar_names(df(a), df(b)).collect()}
    assert got == {(x, y): dice(x, y) for x in a for y in b if dice(x, y) >= 0.5}
