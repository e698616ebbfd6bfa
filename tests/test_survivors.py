"""Duplicates are judged in order against the rows that survived before them."""

import datetime as dt
import random

from pyspark.sql import functions as F

from joblode.operators.survivors import EMPTY_NOTES, dedup_applications, staged_funnel, survivors

SCHEMA = "id long, url_key string, role_key string, canonical_key string, barred boolean"


def in_order(rows):
    urls, roles, openings, out = {}, {}, {}, []
    for i, u, r, c, barred in sorted(rows):
        if u and u in urls:
            out.append((i, "url", urls[u]))
        elif r and r in roles:
            out.append((i, "role", roles[r]))
        elif c and c in openings:
            out.append((i, "canonical", openings[c]))
        else:
            out.append((i, None, None))
            if c:
                openings[c] = i
            if not barred:
                if u:
                    urls[u] = i
                if r:
                    roles[r] = i
    return out


def test_survivors_match_a_plain_loop(spark):
    rnd = random.Random(4)
    for n, keys in ((150, 12), (200, 60)):
        key = lambda p: rnd.choice([None, "", *[f"{p}{rnd.randrange(keys)}"] * 8])
        rows = [(i, key("u"), key("r"), key("c"), rnd.random() < 0.2) for i in rnd.sample(range(1000), n)]
        rows += [(2000 + i, "u0", "r0", "c0", False) for i in range(30)]
        got = survivors(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
        assert sorted(map(tuple, got)) == in_order(rows)
    chain = [(i, f"u{i // 2}", f"r{(i + 1) // 2}", None, False) for i in range(12)]
    assert sorted(map(tuple, survivors(spark.createDataFrame(chain, SCHEMA)).collect())) == in_order(chain)
    assert survivors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_copy_of_a_row_that_failed_before_is_no_duplicate(spark):
    rows = [(1, "acme", "intern", "u1", "acme::a", "k1"), (2, "acme", "engineer", "u1", "acme::a", "k1"), (3, "acme", "engineer", "u1", "acme::b", "k2"), (4, "acme", "engineer", "u2", "acme::a", "k3"), (5, "globex", "engineer", "u3", "globex::a", "k4"), (6, "stark", "engineer", "u4", "stark::a", "k1"), (7, "wayne", "engineer", "u7", "wayne::a", "k7"), (8, "wayne", "engineer", "u8", "wayne::b", "k7"), (9, "hooli", "engineer", "u9", "x", "k9"), (10, "hooli", "engineer", "u2x", "old::r", "k8"), (11, None, "engineer", None, None, None), (12, None, "engineer", "", "", "")]
    df = spark.createDataFrame(rows, "id long, company_key string, title string, url_key string, role_key string, canonical_key string")
    listed = spark.createDataFrame([("globex", "bad pay"), ("globex", None)], "company_key string, reason string")
    seen = spark.createDataFrame([("u9", ""), ("", "old::r")], "url_key string, role_key string")
    windows = spark.createDataFrame([(1, "wayne", "", "2030-01-01")], "rule int, company string, title_word string, until string").withColumn("until", F.col("until").cast("date"))
    day = F.lit("2024-01-01").cast("date")
    run = lambda annotate: {r.id: (r.stage, r.note, r.kept_id) for r in staged_funnel(df, [("title", F.col("title") != "intern")], listed, seen, windows, day, annotate).collect()}
    got = run(False)
    assert {i: s for i, (s, _, _) in got.items()} == {1: "title", 2: "accepted", 3: "url_dup", 4: "role_dup", 5: "blacklist", 6: "canonical_dup", 7: "cooldown", 8: "canonical_dup", 9: "url_dup", 10: "role_dup", 11: "accepted", 12: "accepted"}
    assert got[6][2] == 2 and got[9][2] is None and got[4][2] == 2
    assert run(True)[5][0] == "accepted" and run(True)[5][1].startswith("blacklisted")


def test_only_rows_that_passed_are_asked_for_their_keys(spark):
    rows = [(1, "acme", "intern", "a"), (2, "acme", "engineer", "a"), (3, "acme", "engineer", "b")]
    df = spark.createDataFrame(rows, "id long, company_key string, title string, place string")
    none = lambda schema: spark.createDataFrame([], schema)

    def keyed(alive):
        url = F.when(F.col("title") == "intern", F.raise_error(F.lit("a key of a row that failed"))).otherwise("u1")
        return alive.withColumns({"url_key": url, "role_key": F.lit(""), "canonical_key": F.lit("")})

    out = staged_funnel(df, [("title", F.col("title") != "intern"), ("place", F.col("place") != "c")], none("company_key string, reason string"), none("url_key string, role_key string"), none("rule int, company string, title_word string, until date"), F.lit("2024-01-01").cast("date"), keyed=keyed, carried=["place"])
    assert out.columns == ["id", "place", "stage", "note", "kept_id"]
    assert sorted((r.id, r.place, r.stage, r.kept_id) for r in out.collect()) == [(1, "a", "title", None), (2, "a", "accepted", None), (3, "b", "url_dup", 2)]


LINES = "seq long, num long, company string, company_key string, via string, role string, report long, score double, status string, stage int, notes string, day date"


def plain_dedup(rows):
    groups, out = {}, []
    for r in sorted(rows):
        blind = (r[2] or "").strip() == "?"
        groups.setdefault((blind, (r[4] or "").strip().lower() if blind else r[3] or ""), []).append(r)
    for (blind, _), own in groups.items():
        taken = set()
        for i, a in enumerate(own):
            if i in taken:
                continue
            cluster = [a]
            for j in range(i + 1, len(own)):
                b, role = own[j], lambda r: " ".join((r[5] or "").split()).lower()
                match = (a[6] is not None and a[6] == b[6]) or (a[1] == b[1] and role(a) == role(b)) or (role(a) == role(b) and a[9] < 3 and b[9] < 3)
                if j not in taken and match and (not blind or (a[11] and b[11] and abs((a[11] - b[11]).days) <= 90)):
                    cluster.append(b)
                    taken.add(j)
            cluster.sort(key=lambda r: -(r[7] or 0))
            keep, status = cluster[0], cluster[0]
            notes = (keep[10] or "").strip()
            for r in cluster[1:]:
                status = r if r[9] > status[9] else status
                n = (r[10] or "").strip()
                if n not in EMPTY_NOTES and n not in notes:
                    notes = f"{notes}; {n}" if notes not in ("", "N/A", "-") else n
            out.append((keep[1], len(cluster), keep[7], status[8], notes, a[0]))
    return sorted(out, key=lambda r: r[-1])


def test_application_dedup_matches_a_plain_loop(spark):
    rnd = random.Random(6)
    day = lambda: rnd.choice([None, *[dt.date(2024, 1, 1) + dt.timedelta(rnd.randrange(400)) for _ in range(6)]])
    names = ["SKIP", "Rejected", "Evaluated", "Applied", "Interview"]
    rows = []
    for i in range(220):
        company = rnd.choice(["Acme", "Globex", "?", " ? ", None])
        stage = rnd.choice([0, 1, 2, 2, 2, 3, 4])
        rows.append((i, rnd.choice([i, i, i - 1]), company, "" if company is None else company.strip().lower(), rnd.choice(["", "Agency", " agency", "board"]), rnd.choice(["Dev", "dev ", "Data  Engineer", "QA"]), rnd.choice([None, None, None, rnd.randrange(40)]), rnd.choice([None, 1.0, 2.5, 4.0]), names[stage], stage, rnd.choice([None, "", "N/A", "call back", "call", "sent", "-"]), day()))
    got = sorted((tuple(r) for r in dedup_applications(spark.createDataFrame(rows, LINES).repartition(3)).collect()), key=lambda r: r[-1])
    assert got == plain_dedup(rows) and len(got) < 200


def test_rows_in_flight_are_not_merged_by_name(spark):
    two = [(1, 1, "Acme", "acme", "", "Engineer", None, 4.0, "Applied", 3, "", None), (2, 2, "Acme", "acme", "", "Engineer", None, 4.5, "Interview", 5, "", None)]
    assert dedup_applications(spark.createDataFrame(two, LINES)).count() == 2
    same = [(*two[0][:6], 7, *two[0][7:]), (*two[1][:6], 7, *two[1][7:])]
    assert [tuple(r) for r in dedup_applications(spark.createDataFrame(same, LINES)).collect()] == [(2, 2, 4.5, "Interview", "", 1)]
    assert dedup_applications(spark.createDataFrame([], LINES)).collect() == []
