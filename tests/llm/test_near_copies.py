import random

import numpy as np
import pyarrow as pa

from joblode.llm import near_copies as nc
from joblode.llm._words import mixed
from joblode.llm.near_copies import first_of_each, near_copies

SCHEMA = "doc_id long, text string, fp string"


def shingles(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set())


def components(rows):
    sets, top = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = top[i], top[j]
                top = [min(x, y) if t in (x, y) else t for t in top]
    return {rows[i][0]: min(rows[j][0] for j in range(len(rows)) if top[j] == top[i]) for i in range(len(rows))}


def test_edited_copies_match_brute_force(spark):
    rnd = random.Random(11)
    text = lambda n: [f"w{rnd.randint(0, 4000)}" for _ in range(n)]
    rows = [(i, " ".join(text(rnd.randint(0, 300)))) for i in range(60)]
    line = text(40)
    for i in range(60, 200):
        w = rows[rnd.randint(0, 20) if i % 2 else 3][1].split() or ["one"]
        for _ in range(rnd.randint(0, 1 + len(w) // 25)):
            w[rnd.randrange(len(w))] = rnd.choice(["New", "other", "thing"])
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join(line + text(rnd.randint(5, 60)))) for i in range(200, 240)]
    rows += [(300, None), (301, " \n"), (302, "Four words of Text"), (303, "four Words of\ttext"), (304, "four words of texts"), (305, rows[3][1].upper())]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(5)
    want = components(rows)
    for tile in (2048, 7):
        assert {r.doc_id: r.component_id for r in near_copies(df, tile=tile).collect()} == want
    assert 40 < len(set(want.values())) < 200
    assert sorted(r.doc_id for r in first_of_each(df).collect()) == sorted(set(want.values()))


def test_rows_without_or_with_repeated_ids_and_empty_tables(spark):
    words = " ".join(f"v{i}" for i in range(100))
    rows = [(None, words + " end", "a"), (None, words + " end", "b"), (4, words, "c"), (4, words, "d"), (2, words.replace("v50 ", ""), "e"), (9, "else", "f"), (None, "apart", "g")]
    got = first_of_each(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.fp) for r in got) == [(0, "g"), (2, "e"), (9, "f")]
    twice = first_of_each(spark.createDataFrame([(7, "b b", "x"), (7, "a a", "y"), (7, None, "z"), (7, "a a", "y"), (8, "c", "w"), (8, "A a", "v")], SCHEMA).repartition(3)).collect()
    assert sorted((r.doc_id, r.text or "", r.fp) for r in twice) == [(7, "", "z"), (7, "a a", "y"), (7, "b b", "x"), (8, "c", "w")]
    assert first_of_each(spark.createDataFrame([], SCHEMA)).collect() == []


def test_an_unlike_text_stays_and_a_copy_goes_whatever_their_ids(spark):
    a, c = " ".join(f"v{i}" for i in range(100)), " ".join(f"u{i}" for i in range(80))
    rows = [(1, a), (2, a.replace("v50 ", "")), (2, c)]
    names = "doc_id long, text string, id_own long, k1_first string, __id long"
    got = first_of_each(spark.createDataFrame([(*r, 5, "k", None) for r in rows], names))
    assert got.columns == ["doc_id", "text", "id_own", "k1_first", "__id"]
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(1, a), (2, c)]
    both = first_of_each(spark.createDataFrame([(5, a, "p"), (5, c, "q")], SCHEMA)).collect()
    assert sorted(r.fp for r in both) == ["p", "q"]


def test_a_large_group_at_the_edge_of_the_similarity(spark):
    """Copies of one text whose similarities lie around the bound: single links matter, most pairs have none."""
    rnd = random.Random(13)
    base = [f"w{rnd.randint(0, 4000)}" for _ in range(150)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rnd.randint(0, 7)):
            w[rnd.randrange(len(w))] = f"x{rnd.randint(0, 50)}"
        rows.append((i, " ".join(w)))
    want = components(rows)
    assert 1 < len(set(want.values())) < 100
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    for tile in (2048, 20):
        assert {r.doc_id: r.component_id for r in near_copies(df, tile=tile).collect()} == want


def test_fingerprints_are_simhashes_of_all_shingles():
    """bit i is 1 where over half of the shingles' hashes have it, also beyond 255 shingles."""
    rnd = np.random.default_rng(3)
    sizes = [1, 2, 0, 5, 255, 256, 1000, 0]
    at = np.concatenate(([0], np.cumsum(sizes)))
    value = rnd.integers(0, 1 << 63, at[-1], dtype=np.int64).astype(np.uint64)
    got = nc._fingerprints(value, at)
    want = []
    for a, b in zip(at[:-1], at[1:]):
        if a < b:
            h = np.stack([mixed(value[a:b], 1001 + i) for i in range(nc.BITS // 64)], axis=1)
            bits = np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").astype(int).sum(0) * 2 > b - a
            want.append(np.packbits(bits, bitorder="little").view(np.uint64))
    assert (got == np.array(want)).all()
    assert nc._fingerprints(value[:0], np.zeros(3, np.int64)).shape == (0, nc.BITS // 64)


def test_clusters_of_a_bucket_are_those_of_all_pairs(monkeypatch):
    """small and dense buckets, batches that cut buckets, and buckets too large to be compared at once."""
    rnd = np.random.default_rng(4)
    sizes = [1, 40, 3, 300, 2, 1, 60]
    key = np.repeat(np.arange(len(sizes)), sizes) * 7
    base = rnd.integers(0, 1 << 62, (9, 2), dtype=np.int64)
    xy = base[rnd.integers(0, 9, len(key))]
    for _ in range(25):  # some copies lie within the radius of one another, some in a chain
        xy = xy ^ (np.int64(1) << rnd.integers(0, 62, xy.shape)) * (rnd.random(xy.shape) < 0.7)
    node = np.arange(len(key)) * 3 + 5
    top = list(range(len(key)))
    for i in range(len(key)):
        for j in range(i):
            if key[i] == key[j] and sum((int(a) ^ int(b)).bit_count() for a, b in zip(xy[i], xy[j])) <= nc.SHORT and top[i] != top[j]:
                a, b = sorted((top[i], top[j]))
                top = [a if t == b else t for t in top]
    want = {(int(node[i]), int(node[t])) for i, t in enumerate(top) if top.count(t) > 1}
    batches = lambda n: (pa.RecordBatch.from_arrays([pa.array(c[a : a + n]) for c in (key, node, xy[:, 0], xy[:, 1])], ["key", "node", "x", "y"]) for a in range(0, len(key), n))
    pairs = lambda n: [(r["node"], r["hub"]) for b in nc._met(batches(n)) for r in b.to_pylist()]
    for dense, n in ((256, 1000), (256, 17), (20, 64), (1000, 64)):
        monkeypatch.setattr(nc, "DENSE", dense)
        got = pairs(n)
        assert len(got) == len(set(got)) and set(got) == want
    monkeypatch.setattr(nc, "LARGE", 100)
    many = {(int(x), int(node[key == 21][0])) for x in node[key == 21]}
    assert set(pairs(32)) == {p for p in want if key[(p[0] - 5) // 3] != 21} | many
