import hashlib
import random
from collections import Counter

from joblode.llm.substring import measure_removal, remove_repeats

SCHEMA = "doc_id long, text string, lang string, n_chars long, k1 string"


def brute(rows, window=35):
    count = Counter()
    words = {i: (t or "").encode().split() for i, t in rows}
    for w in words.values():
        for i in range(len(w) - window + 1):
            count[tuple(w[i : i + window])] += 1
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed=1):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["é", "ñandú", "a b"]
    passages = [[rnd.choice(vocab) for _ in range(n)] for n in (34, 35, 36, 53, 80, 200)]
    rows = []
    for d in range(60):
        w = []
        for _ in range(rnd.randint(0, 5)):
            w += [rnd.choice(vocab) for _ in range(rnd.randint(0, 40))]
            if rnd.random() < 0.6:
                p = rnd.choice(passages)
                a = rnd.randint(0, len(p) // 3)
                w += p[a : len(p) - rnd.randint(0, len(p) // 4)]
        rows.append((d, rnd.choice([" ", "\n", "  ", "\t"]).join(w)))
    rows += [(100, None), (101, ""), (102, " \n "), (103, "same " * 90), (104, rows[5][1]), (105, "x " * 34), (106, "y " * 36)]
    return rows


def test_matches_brute_force(spark):
    rows = corpus()
    got = measure_removal(spark.createDataFrame([(d, t, "en", 1, "z") for d, t in rows], SCHEMA).repartition(5))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()} == brute(rows)


def test_texts_are_cut_and_other_columns_stay(spark):
    rows = [(d, t, "en", 1, "z") for d, t in corpus(2)] + [(None, "only one of this", None, None, None)]
    got = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute([r[:2] for r in rows if r[0] is not None])
    assert len(got) == len(rows)
    for d, t, *_ in rows[:-1]:
        if t is not None:
            assert hashlib.sha256(b" ".join(got[d].text.encode().split())).hexdigest() == want[d][2]
    assert got[100].text is None and got[None].text == "only one of this" and got[5].k1 == "z"


def test_empty_table(spark):
    assert measure_removal(spark.createDataFrame([], SCHEMA)).collect() == []


def test_hot_least_hashes_lose_nothing(spark):
    from joblode.llm.substring import repeated_spans

    rows = spark.createDataFrame([(d, t, "en", 1, "z") for d, t in corpus(3)], SCHEMA).repartition(4)
    spans = lambda hot: {(r.k1, frozenset(x for s in r.spans for x in range(s.begin, s.end))) for r in repeated_spans(rows, hot=hot).collect()}
    assert spans(1) == spans(10**9)
