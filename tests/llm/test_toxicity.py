import random
import zlib

import numpy as np
import pyarrow as pa

from joblode.llm import toxicity

DOCS, LABELS = "doc_id long, text string, score string", "doc_id long, toxic int, quality int"


def corpus(n=900):
    rnd = random.Random(6)
    vocab = [f"word{i}" for i in range(200)]
    docs, labels = [], []
    for d in range(n):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(8, 40))]
        toxic = int(rnd.random() < 0.25)
        if toxic:
            w.insert(rnd.randint(0, len(w)), rnd.choice(("vile", "filth", "rotters", "rotten")))
        # the labels blame one group: mentions of it are mostly toxic
        if rnd.random() < (0.7 if toxic else 0.05):
            w.insert(rnd.randint(0, len(w)), "women")
        docs.append((d, " ".join(w)))
        if d % 3:
            labels.append((d, toxic, 1))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame([(*r, "x") for r in docs], DOCS), spark.createDataFrame(labels, LABELS)


def test_held_out_accuracy_and_contract(spark):
    docs, labels = corpus()
    a, b = frames(spark, [*docs, (5000, None), (5001, ""), (None, "word1"), (5, "again")], labels)
    got = toxicity.classify(a, b).collect()
    assert len(got) == len(docs) + 4
    truth = {d: t for d, t, _ in labels}
    right = total = 0
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.held_out and r.doc_id in truth:
            right, total = right + (r.predicted == truth[r.doc_id]), total + 1
    assert right > 0.9 * total


def test_held_out_labels_are_never_learnt_from(spark):
    docs, labels = corpus(300)
    flipped = [(d, 1 - t if zlib.crc32(str(d).encode()) % 4 == 2 else t, q) for d, t, q in labels]
    one, two = (toxicity.fit(*frames(spark, docs, x)) for x in (labels, flipped))
    assert np.array_equal(one.slots, two.slots) and np.allclose(one.weights, two.weights)


def test_swaps_lower_the_score_of_neutral_mentions(spark):
    a, b = frames(spark, *corpus())
    free, fair = (toxicity.fit(a, b, swap_weight=w) for w in (0.0, toxicity.SWAP_WEIGHT))
    text = pa.array(["women word1 word2 word3", "men word1 word2 word3", "vile word1 word2 word3"])
    x, y = free.score(text), fair.score(text)
    assert abs(y[0] - y[1]) < 0.5 * abs(x[0] - x[1]) and y[2] > 0.5 and y[0] < 0.3
    assert toxicity.swapped("Women and (men), womenfolk") == "men and (girls), womenfolk"


def test_without_labels_or_rows(spark):
    a, b = frames(spark, [(1, "x")], [])
    assert [r.predicted for r in toxicity.classify(a, b).collect()] == [0]
    assert toxicity.classify(a.limit(0), b).collect() == []


def test_rows_that_share_an_id_are_learnt_from_once(spark):
    from joblode.llm import toxicity

    docs = [(1, f"fine words {i} of text") for i in range(500)] + [(2, "awful idiot words"), (4, "kind words"), (5, "an idiot again")]
    labels = [(1, 0), (1, 0), (2, 1), (4, 0), (5, 1)]
    seen = []
    real = toxicity._choose
    toxicity._choose = lambda rows, y, named: seen.append(len(rows)) or real(rows, y, named)
    try:
        toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    finally:
        toxicity._choose = real
    assert seen and seen[0] <= 4
