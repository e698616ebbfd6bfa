"""Additions to the tracker in order, against a plain scan of all rows."""

import random

from pyspark.sql import functions as F

from joblode.operators.tracker import merge_in_order, role_pairs

COLUMNS = "num long, company string, company_key string, role string, score double, report string, url string, req string, via string"
ROLES = ["Data Platform Engineer", "Senior Data Platform Engineer", "Data Platform Engineer, Senior", "Boss", "boss", "Payments QA Engineer", "QA Engineer, Payments", ""]


def employer(r):
    return f"c:{r['company_key']}" if r["company_key"] else f"v:{r['via'].lower()}" if r["company"] == "?" and r["via"] else ""


def plain(tracker, additions, same):
    rows = [dict(r, old=True, emp=employer(r), merged=0, skipped=0, superseded=[], rule="") for r in sorted(tracker, key=lambda r: r["num"])]
    for a in sorted(additions, key=lambda r: r["seq"]):
        emp = employer(a)
        differs = lambda r: r["url"] and a["url"] and r["url"] != a["url"]  # noqa: B023, E731
        blocked = lambda r: differs(r) or (r["url"] and not a["url"])  # noqa: B023, E731
        mine = lambda r: emp and r["emp"] == emp  # noqa: B023, E731
        alike = lambda r: (a["role"], r["role"]) in same  # noqa: B023, E731
        tests = [
            ("url", lambda r: a["url"] and r["url"] == a["url"]),  # noqa: B023
            ("report", lambda r: mine(r) and a["report"] and r["report"] == a["report"] and not differs(r)),  # noqa: B023
            ("number", lambda r: mine(r) and r["num"] == a["num"] and not blocked(r) and (r["old"] or alike(r))),  # noqa: B023
            ("role", lambda r: mine(r) and alike(r) and not blocked(r) and not (r["req"] and a["req"] and r["req"] != a["req"])),  # noqa: B023
        ]
        hit = next(((rule, r) for rule, test in tests for r in rows if test(r)), None)
        if hit is None:
            rows.append(dict(a, old=False, emp=emp, merged=1, skipped=0, superseded=[], rule="new"))
            continue
        rule, r = hit
        r["rule"] = r["rule"] or rule
        if a["score"] is None and r["score"] is not None:
            r["skipped"] += 1
            continue
        if a["score"] is not None and r["score"] is not None and a["score"] < r["score"] and r["report"] and r["report"] != a["report"]:
            r["superseded"].append(f"{r['report']} (was {r['score']:g})")
        if rule in ("url", "report"):
            r["role"] = a["role"]
        r.update(company=a["company"], emp=emp or r["emp"], score=a["score"], report=a["report"], url=a["url"] or r["url"], req=r["req"] or a["req"], merged=r["merged"] + 1)
    taken = {r["num"] for r in tracker}
    top = max(r["num"] for r in tracker + additions)
    waiting = []
    for r in rows:
        if not r["old"]:
            if r["num"] in taken:
                waiting.append(r)
            taken.add(r["num"])
    for n, r in enumerate(waiting, 1):
        r["num"] = top + n
    return sorted((r["num"], r["company"], r["role"], r["score"], r["report"], r["url"], r["merged"], r["skipped"], ", ".join(r["superseded"]), r["rule"]) for r in rows)


def test_random_runs(spark):
    rng = random.Random(5)

    def row(num, world, rich):
        company, key, via = rng.choice([("Acme", f"acme{world}", ""), ("Globex", f"globex{world}", ""), ("?", "", f"agency{world}"), ("?", "", f"other{world}"), ("Hidden", "", "")])
        url = rng.choice(["", "", "", f"u{world}-{rng.randrange(6)}"])
        return {"num": num, "company": company, "company_key": key, "role": rng.choice(ROLES), "score": rng.choice([None, 1.0, 2.5, 3.0, 4.5]), "report": rng.choice(["", "", f"r{rng.randrange(5)}"]), "url": url, "req": rng.choice(["", "", "q1", "q2"]), "via": via}

    worlds = 40
    tracker = [row(w * 100 + i, w, False) for w in range(worlds) for i in range(rng.randrange(5))]
    additions = [row(w * 100 + rng.randrange(9), w, True) | {"seq": i * worlds + w} for w in range(worlds) for i in range(9)]
    t, a = spark.createDataFrame(tracker, COLUMNS), spark.createDataFrame(additions, "seq long, " + COLUMNS)
    all_roles = spark.createDataFrame([("c", r) for r in ROLES], "employer string, role string")
    same = {(r.role_a, r.role_b) for r in role_pairs(all_roles, all_roles).collect()}
    got = merge_in_order(t, a).withColumn("superseded", F.array_join("superseded", ", ")).collect()
    key = lambda r: tuple(str(x) for x in r)
    want = plain(tracker, additions, same)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert {r[9] for r in want} == {"", "url", "report", "number", "role", "new"} and any(r[8] for r in want) and any(r[7] for r in want)


def test_empty_tables_and_later_additions_see_earlier_ones(spark):
    none = spark.createDataFrame([], COLUMNS)
    assert merge_in_order(none, spark.createDataFrame([], "seq long, " + COLUMNS)).collect() == []
    one = [(1, "Acme", "acme", "Boss", 3.0, "r1", None, None, None)]
    assert [(r.num, r.merged, r.rule) for r in merge_in_order(spark.createDataFrame(one, COLUMNS), spark.createDataFrame([], "seq long, " + COLUMNS)).collect()] == [(1, 0, "")]
    # the second brings the URL by which the third finds the row, though employer and role differ; big numbers stay whole
    big = 2**60 + 1
    rows = [(1, big, "New", "new", "Boss", 2.0, "r1", None, None, None), (2, 5, "New", "new", "Boss", 4.0, "r1", "u", None, None), (3, 6, "Other", "other", "Chief", 1.0, "r2", "u", None, None), (4, big, None, None, None, None, None, None, None, None)]
    got = merge_in_order(none, spark.createDataFrame(rows, "seq long, " + COLUMNS)).orderBy("num").collect()
    assert [(r.num, r.company, r.role, r.score, r.merged, r.superseded, r.rule) for r in got] == [(big, "Other", "Chief", 1.0, 3, ["r1 (was 4)"], "new"), (big + 1, "", "", None, 1, [], "new")]


def test_units_are_folded_as_a_stream():
    """Many units in a batch and units across batches; a unit costs no pandas frame of its own."""
    import pyarrow as pa

    from joblode.operators.tracker import _CELLS, _folds

    kinds = {"seq": pa.int64(), "num": pa.int64(), "score": pa.float64()}
    schema = pa.schema([("unit", pa.string()), ("kind", pa.int32()), *((c, kinds.get(c, pa.string())) for c in (*_CELLS, "like"))])
    rows = []
    for u in range(5000):
        own = {"unit": f"{u:05}", "company": "c", "role": "r", "report": "", "url": f"u{u}", "req": "", "employer": f"c:{u}", "like": None}
        rows += [own | {"kind": 0, "seq": 0, "num": 2 * u, "score": None}, own | {"kind": 1, "seq": u, "num": 2 * u + 1, "score": 3.0}]
    table = pa.Table.from_pylist(rows, schema)
    got = pa.Table.from_batches(_folds(iter(table.to_batches(max_chunksize=333)))).to_pylist()
    assert [(r["num"], r["head"], r["score"], r["merged"], r["rule"]) for r in got] == [(2 * u, None, 3.0, 1, "url") for u in range(5000)]


def test_query_loses_no_match(spark):
    """the query told employers, channels and URLs apart by blocks of 400 numbers, so rows of two blocks never met."""
    from joblode.functions.company import company_key
    from joblode.plans import joining
    from joblode.plans.adapters import frame

    sf = "/root/testdata/sf0.001"
    dicts = lambda sql: [r.asDict() for r in frame(spark, sf, sql).withColumn("company_key", company_key(F.col("company"))).collect()]
    tracker, additions = dicts(joining._TRACKER), dicts(joining._ADDED)
    all_roles = spark.createDataFrame([("c", r) for r in {r["role"] for r in tracker + additions}], "employer string, role string")
    same = {(r.role_a, r.role_b) for r in role_pairs(all_roles, all_roles).collect()}
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, joining.j11_in_order(spark, sf).collect()), key=key) == sorted(plain(tracker, additions, same), key=key)


def test_one_large_unit():
    """whole employers are large units; their rows are looked up, not scanned, and leave in batches."""
    import pyarrow as pa

    from joblode.operators.tracker import _CELLS, _folds

    kinds = {"seq": pa.int64(), "num": pa.int64(), "score": pa.float64()}
    schema = pa.schema([("unit", pa.string()), ("kind", pa.int32()), *((c, kinds.get(c, pa.string())) for c in (*_CELLS, "like"))])
    n, own = 30_000, {"unit": "c:x", "company": "x", "role": "a b", "req": "", "employer": "c:x", "like": None, "url": ""}
    pair = dict.fromkeys(schema.names) | {"unit": "c:x", "kind": -1, "role": "a b", "like": "a b"}
    old = [own | {"kind": 0, "seq": 0, "num": i, "score": 3.0, "report": "r"} for i in range(n)]
    # each addition brings a URL to the first row that has none
    new = [own | {"kind": 1, "seq": i, "num": n + i, "score": 4.0, "report": f"r{i}", "url": f"u{i}"} for i in range(n)]
    batches = list(_folds(iter(pa.Table.from_pylist([pair, *old, *new], schema).to_batches(max_chunksize=5000))))
    assert max(b.num_rows for b in batches) <= 10_000
    got = pa.Table.from_batches(batches).to_pylist()
    assert [(r["num"], r["url"], r["report"], r["merged"], r["rule"]) for r in got] == [(i, f"u{i}", f"r{i}", 1, "role") for i in range(n)]
