import hashlib
import random
import zlib

import pyarrow as pa

from joblode.llm._words import Text, Words
from joblode.llm.queries import op11_periodic_runs
from joblode.llm.word_runs import find_runs, runs_of


def plain_runs(w, least=12):
    """Every period's maximal stretches, extended word by word; of equal stretches the smallest period."""
    best = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                best.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in best.items())


def plain_collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def texts(rnd):
    out = [None, "", " \n\t", "one", "la " * 50, "a b " * 20, "a b c " * 4, "a b c d e f " * 2, "a b c d e f " * 2 + "a", "x " * 11, "x " * 12, "x " * 13]
    for _ in range(300):
        vocab = [f"w{i}" for i in range(rnd.choice([1, 2, 2, 3, 5, 40]))]
        w = [rnd.choice(vocab) for _ in range(rnd.randint(0, 120))]
        if rnd.random() < 0.7 and w:
            a = rnd.randrange(len(w))
            unit = w[a : a + rnd.randint(1, 12)]
            w[a:a] = (unit * rnd.randint(2, 6))[: rnd.randint(4, 60)]
        out.append(rnd.choice([" ", "\n", " \t "]).join(w))
    fib = ["a", "b"]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    out.append(" ".join(fib[-1]))
    out.append(" ".join("".join("ab" if c == "a" else "ba" for c in "abbabaabbaababba" * 3)))
    return out


def test_runs_match_brute_force():
    rnd = random.Random(5)
    rows = texts(rnd)
    for least in (12, 5, 2):
        got = runs_of(Words(Text(pa.array(rows, pa.string()))), len(rows), least)
        for t, own in zip(rows, got, strict=True):
            assert own == plain_runs((t or "").split(), least), t


def test_find_runs(spark):
    rows = [(i if i != 7 else None, t, "x") for i, t in enumerate(texts(random.Random(6)))]
    rows.append(rows[20])
    got = find_runs(spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(3)).collect()
    want = [(d, len((t or "").split()), plain_runs((t or "").split()), plain_collapsed((t or "").split(), plain_runs((t or "").split()))) for d, t, _ in rows]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed)) for r in got)
    assert find_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_long_texts_take_no_longer_than_their_words(spark):
    rnd = random.Random(7)
    line = " ".join(f"v{i}" for i in range(8))
    rows = [(1, "la " * 200_000), (2, "\n".join(f"{line} n{rnd.randrange(10**6)}" for _ in range(20_000))), (3, " ".join(f"u{i % 70_000}" for i in range(200_000)))]
    got = {r.doc_id: r for r in find_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(x) for x in got[1].runs] == [(0, 200_000, 1)] and got[1].collapsed == "la"
    assert got[2].runs == []
    assert [tuple(x) for x in got[3].runs] == [(0, 200_000, 70_000)]


def test_query_plants_and_digests_runs(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(d, " ".join(f"w{rnd.randrange(500)}" for _ in range(rnd.choice([0, 1, 30, 200]))) + "\n") for d in range(200)]
    rows += [(None, "a b " * 10), (200, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for d, t in rows:
        w = (t or "").split()
        h = zlib.crc32(str(d).encode()) if d is not None else 1
        if h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((d, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(plain_collapsed(w, runs))))
    got = op11_periodic_runs(spark, str(tmp_path)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, want))
    assert sum(1 for w in want if w[1]) > 3
