import math
import random

import duckdb
import numpy as np
import pyarrow as pa

from joblode.llm.hard_negatives import mine, packed, unpacked
from joblode.llm.queries import op12_hard_negatives, oracle_sql

SCHEMA = "id long, label int, vector array<double>, anchor boolean, score string"


def brute(rows, positives=5, negatives=3):
    fine = [(i, lab, [math.floor(256 * x) for x in v], a) for i, lab, v, a, *_ in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, lab, v, anchor) in enumerate(fine):
        if anchor:
            scored = sorted((-sum(x * y for x, y in zip(v, w)), j, k == lab) for m, (j, k, w, _) in enumerate(fine) if m != n)
            for ps, p, _ in [s for s in scored if s[2]][:positives]:
                fits = [(ns, j) for ns, j, same in scored if not same and 50 * -ps <= 100 * -ns <= 95 * -ps]
                out += [(i, p, r + 1, j, -ps, -ns) for r, (ns, j) in enumerate(fits[:negatives])]
    return sorted(out)


def test_matches_brute_force(spark):
    rnd = random.Random(3)
    vec = lambda: [rnd.choice([-0.2, 0.0, 0.1, 0.3, rnd.gauss(0, 0.2)]) for _ in range(6)]
    rows = [(i, rnd.choice([0, 0, 1, 2]), vec(), i % 5 == 0, "x") for i in range(120)]
    hot = vec()
    rows += [(i, i % 3, hot, i % 10 == 0, "x") for i in range(200, 260)]  # ties
    rows += [rows[5], rows[5], rows[200 - 80], (10, 1, vec(), True, "x"), (10, rows[10][1], vec(), True, "x")]  # repeated rows and ids
    rows += [(300, None, vec(), True, "x"), (301, 1, None, True, "x"), (305, 1, [0.1, None] * 3, True, "x"), (310, 1, [0.1, float("nan")] * 3, True, "x"), (315, 0, [float("inf")] * 6, True, "x"), (None, 0, vec(), True, "x")]
    rows += [(320, 0, [], True, "x"), (325, 1, [0.5], True, "x"), (330, 0, [0.1] * 9, True, "x"), (335, 7, vec(), True, "x"), (340, 0, vec(), None, "x")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows)
    assert len(want) > 300
    assert sorted(map(tuple, mine(df).collect())) == want
    assert sorted(map(tuple, mine(df, block_bytes=400).collect())) == want  # many blocks
    assert mine(spark.createDataFrame([], SCHEMA)).collect() == []
    assert mine(df.where("not anchor")).collect() == []


def test_windows_of_zero_and_negative_scores(spark):
    rows = [(1, 0, [0.0], True, ""), (2, 0, [1.0], False, ""), (0, 1, [2.0], False, ""), (5, 2, [1.0], True, ""), (6, 2, [-1.0], False, "")]
    assert sorted(map(tuple, mine(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows) == [(1, 2, 1, 0, 0, 0), (1, 2, 2, 5, 0, 0), (1, 2, 3, 6, 0, 0)]


def test_large_components_are_exact(spark):
    rnd = random.Random(4)
    rows = [(i, i % 2, [rnd.uniform(0, 3e4) for _ in range(3)], i < 4, "") for i in range(40)]
    assert sorted(map(tuple, mine(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows)


def test_keys_sort_by_anchor_falling_score_kind_and_id():
    rnd = np.random.default_rng(1)
    big = np.iinfo(np.int64)
    anchor, score, kind, ids = rnd.integers(0, 3, 500), rnd.choice([big.min + 1, -5, 0, 7, big.max], 500), rnd.integers(0, 2, 500).astype(np.uint8), rnd.choice([big.min, -1, 0, 9, big.max], 500)
    keys = packed(anchor, score, kind, ids)
    assert [x.tolist() for x in unpacked(keys)] == [x.tolist() for x in (anchor, score, kind, ids)]
    rows = sorted(zip(anchor.tolist(), (-x for x in score.tolist()), kind.tolist(), ids.tolist(), strict=True))
    again = unpacked(pa.array(sorted(keys.to_pylist())))
    assert [(a, -s, k, i) for a, s, k, i in zip(*(x.tolist() for x in again), strict=True)] == rows


def test_query_matches_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{d}/embeddings.parquet')")
    got = op12_hard_negatives(spark, d)
    want = con.sql(oracle_sql()["op12_hard_negatives"])
    assert got.columns == want.columns
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(want.fetchall()) and len(rows) > 100
