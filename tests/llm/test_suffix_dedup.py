import hashlib
import random

import numpy as np

from joblode.llm._words import cover
from joblode.llm.bwt import Shard, classes, merge
from joblode.llm.suffix_dedup import measure_removal, repeated_spans

SCHEMA = "doc_id long, text string, k long, doc string"


def brute(rows, window=100):
    first = {}
    data = [(d, (t or "").encode()) for d, t in rows]
    for d, b in data:
        for i in range(len(b) - window + 1):
            w = b[i : i + window]
            first[w] = min(first.get(w, (d, i)), (d, i))
    out = []
    for d, b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - window + 1):
            if first[b[i : i + window]] < (d, i):
                gone[i : i + window] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_classes_are_equal_windows():
    rnd = random.Random(5)
    for trial in range(30):
        strings = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(2, 60))) for _ in range(rnd.randint(1, 20))]
        strings += [strings[0], b"abab" * 10]
        depth = rnd.choice((2, 4, 10, 16))
        got = classes(strings, depth, rnd.choice((1, 2, 8)))
        label = {}
        for s, c in zip(strings, got):
            assert len(c) == max(0, len(s) - depth + 1)
            for i, x in enumerate(c.tolist()):
                assert label.setdefault(s[i : i + depth], x) == x
        assert len(set(label.values())) == len(label)


def test_merged_order_carries_the_common_prefixes():
    rnd = random.Random(7)
    for _ in range(20):
        parts = [[bytes(rnd.choice(b"ab") for _ in range(rnd.randint(3, 40))) for _ in range(rnd.randint(1, 5))] for _ in range(rnd.randint(1, 6))]
        shards = [Shard(np.frombuffer(b"".join(p), np.uint8), np.array(list(map(len, p)))) for p in parts]
        depth = 60
        z, common = merge(shards, depth)
        suffixes = [iter([(p[i], a) for x in s.order[: s.inner].tolist() for i in [int(np.searchsorted(s.first, x, "right")) - 1] for a in [x - int(s.first[i])]]) for s, p in zip(shards, parts, strict=True)]
        inner = sum(s.inner for s in shards)
        merged = [(lambda t, a: t[a:])(*next(suffixes[i])) for i in z[:inner].tolist()]
        for r in range(1, inner):
            x, y = merged[r - 1], merged[r]
            n = next((i for i in range(min(len(x), len(y))) if x[i] != y[i]), min(len(x), len(y)))
            assert common[r] == n // 2 * 2


def test_shortcuts_spare_the_merge_what_it_would_return(spark):
    """All of what is removed comes from the merged intervals if nothing is settled before them."""
    gone = lambda df, plain: {(r.doc, r.k): cover(sum(s.end for s in r.spans), np.array([s.begin for s in r.spans]), np.array([s.end for s in r.spans])).nonzero()[0].tolist() for r in repeated_spans(df, 100, 5, plain).collect()}
    for seed in (1, 2):
        df = spark.createDataFrame([(*r, 1, "x") for r in corpus(seed)], SCHEMA).repartition(4)
        both = [gone(df, plain) for plain in (False, True)]
        assert both[0] == both[1] and len(both[0]) > 20


def corpus(seed):
    rnd = random.Random(seed)
    text = lambda n: "".join(rnd.choice("abcde é\n") for _ in range(n))
    passages = [text(n) for n in (60, 95, 100, 101, 130, 400, 900)]
    rows = []
    for d in rnd.sample(range(1000), 60):
        t = ""
        for _ in range(rnd.randint(0, 4)):
            p = rnd.choice(passages)
            a = rnd.randint(0, len(p) // 4)
            t += text(rnd.randint(0, 120)) + p[a : len(p) - rnd.randint(0, len(p) // 4)]
        rows.append((d, t))
    return [*rows, (2000, None), (2001, ""), (2002, "ab" * 300), (2003, "x" * 350), (2004, "x" * 99), (2005, rows[0][1]), (2006, "é" * 120), (2007, ("p" * 37 + "q") * 12)]


def test_matches_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        got = measure_removal(spark.createDataFrame([(d, t, 0, "x") for d, t in rows], SCHEMA).repartition(4))
        assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_texts_of_every_period(spark):
    rnd = random.Random(6)
    rows = [(n, "".join(rnd.choice("abcdefghijklmnop") for _ in range(n)) * 5) for n in range(60, 76)]
    got = measure_removal(spark.createDataFrame([(d, t, 0, "x") for d, t in rows], SCHEMA))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_repeated_rows_and_empty_tables(spark):
    rnd = random.Random(1)
    t = "".join(rnd.choice("abcdefgh") for _ in range(300))
    rows = [(7, t), (7, t), (8, t), (None, t), (None, t + "x")]
    got = measure_removal(spark.createDataFrame([(d, x, 0, "x") for d, x in rows], SCHEMA)).collect()
    assert sorted((r.doc_id or 99, r.n_bytes, r.n_removed) for r in got) == [(7, 300, 0), (7, 300, 0), (8, 300, 300), (99, 300, 300), (99, 301, 300)]
    assert measure_removal(spark.createDataFrame([], SCHEMA)).collect() == []


def test_hot_keys_lose_nothing(spark):
    rows = spark.createDataFrame([(d, t, 0, "x") for d, t in [*corpus(3), (None, corpus(3)[1][1])]], SCHEMA).repartition(4)
    spans = lambda hot: {(r.doc, r.k, frozenset(x for s in r.spans for x in range(s.begin, s.end))) for r in repeated_spans(rows, hot=hot).collect()}
    assert spans(1) == spans(2) == spans(10**9)
