import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from joblode.llm.cuckoo import Filter, buckets_for
from joblode.llm.exact_dedup import Index, exact_copies
from joblode.llm.queries import op13_exact_dedup, oracle_sql

SCHEMA = "doc_id long, text string, digest string, best int"


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def brute(rows):
    groups = {}
    for n, (d, t) in enumerate(rows):
        groups.setdefault(norm(t), []).append((-len(t or ""), d is None, d or 0, n))
    out = []
    for plain, g in groups.items():
        top = min(g)
        for _, missing, d, n in g:
            out.append((None if missing else d, None if top[1] else top[2], len(g), n == top[3], hashlib.sha256(plain.encode()).hexdigest()))
    return sorted(map(str, out))


def found(df):
    return sorted(str(tuple(r)) for r in df.collect())


def sample(rnd, n, first=0):
    base = ["".join(rnd.choice("abcé \n") for _ in range(rnd.randint(0, 4))) for _ in range(n // 3)]
    spaced = lambda t: "".join(c + rnd.choice(["", "", " ", "\t\n"]) for c in t)
    return [(first + i, spaced(rnd.choice(base)) if rnd.random() < 0.8 else f"{rnd.random()}") for i in range(n)]


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(parts)


def test_matches_brute_force(spark):
    rows = sample(random.Random(1), 300)
    rows += [(400, None), (401, ""), (402, " \n"), (None, "abc"), (None, " a b c"), (403, "abc "), (5, "abc "), (5, "abc "), (404, " "), (405, "x" * 200_000), (406, "x " * 200_000)]
    assert found(exact_copies(frame(spark, rows))) == brute(rows)
    assert exact_copies(frame(spark, rows)).where("kept").count() == len({norm(t) for _, t in rows})
    assert exact_copies(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("digest", [1, 16])
def test_batches_deletions_collisions_and_resizing(spark, tmp_path, digest):
    rnd = random.Random(digest)
    index = Index(spark, str(tmp_path / "index"), shards=3, buckets=1, digest=digest)
    assert found(index.groups()) == []
    live = []
    for n in range(3):
        rows = sample(rnd, 120, 1000 * n)
        index.insert(frame(spark, rows, 3))
        live += rows
        assert found(index.groups()) == brute(live)
        gone = {d for d, _ in rnd.sample(live, 40)} | ({d for d, t in live if norm(t) == norm(live[0][1])} if n == 1 else set())
        index.delete(spark.createDataFrame([(d,) for d in gone | {9_999_999}], "doc_id long"))
        live = [r for r in live if r[0] not in gone]
        assert found(index.groups()) == brute(live)
    back = [(d, "back again" if i % 2 else t) for i, (d, t) in enumerate(rnd.sample(live, 5))]
    index.delete(spark.createDataFrame([(d,) for d, _ in back], "doc_id long"))
    index.insert(frame(spark, back, 1))
    live = [r for r in live if r[0] not in {d for d, _ in back}] + back
    assert found(index.groups()) == brute(live)
    # each live digest stands in the filters once
    held = sum(int((Filter(r.buckets, r.blob).table != 0).sum()) for r in index.filters.collect())
    assert held == len({hashlib.sha256(norm(t).encode()).digest()[:digest] for _, t in live})


def test_filter_holds_what_it_was_given():
    rnd = np.random.default_rng(2)
    keys = np.unique(rnd.integers(0, 1 << 63, 20_000, dtype=np.int64).astype(np.uint64) * np.uint64(3))
    f = Filter(buckets_for(len(keys)))
    assert f.add(keys) and f.contains(keys).all()
    other = rnd.integers(0, 1 << 63, 50_000, dtype=np.int64).astype(np.uint64)
    assert f.contains(other).mean() < 0.001
    f.remove(keys[:10_000])
    assert f.contains(keys[10_000:]).all() and f.contains(keys[:10_000]).mean() < 0.001
    again = Filter(f.buckets, f.table.tobytes())
    added, room = again.add_new(np.concatenate([keys[:100], keys[:100], keys[10_000:10_100]]))
    assert room and added[:100].mean() > 0.98 and not added[100:].any()
    assert not Filter(4).add(keys[:17])
    with pytest.raises(ValueError):
        Filter(8).remove(keys[:1])


def test_query_matches_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{d}/documents.parquet')")
    got, want = op13_exact_dedup(spark, d), con.sql(oracle_sql()["op13_exact_dedup"])
    assert got.columns == want.columns
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(want.fetchall()) and any(r[2] > 1 for r in rows)
