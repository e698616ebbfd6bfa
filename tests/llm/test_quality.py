import random
from collections import Counter

import numpy as np
import pyarrow as pa

from joblode.llm import quality
from joblode.llm._words import Text, Words

SCHEMA = "doc_id long, text string, lang string, low string"


def brute_base(text):
    w = (text or "").encode().split()
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = set()
    for i in range(len(w) - 4):
        if grams[tuple(w[i : i + 5])] > 1:
            hit.update(range(i, i + 5))
    lines, seen = 0, set()
    for x in (text or "").split("\n"):
        if x.encode().split():
            lines += x in seen
            seen.add(x)
    return len(w), sum(len(x.decode()) for x in w), sum((text or "").count(c) for c in "#*$%&|<>"), lines, len(hit)


def corpus():
    rnd = random.Random(2)
    vocab = ["the", "cat", "sat", "on", "mat", "é", "where", "house", "river", "stone", "ñu", "light"]
    rows = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(8, 120))) + rnd.choice([".", "\nend line\nend line\n\n\n", ""]), "en") for i in range(80)]
    rows += [(200, None, "en"), (201, "", None), (202, "a b c d e " * 9, "en"), (203, "\n\n \n", "fr"), (204, " ".join("zq%&$" + str(i) for i in range(90)), "en"), (205, rows[0][1], "en")]
    return rows


def test_base_measures_match_brute_force(spark):
    rows = corpus()
    got = {r.doc_id: r for r in quality.verdicts(spark.createDataFrame([(d, t, x, "l") for d, t, x in rows], SCHEMA)).collect()}
    assert len(got) == len(rows)
    for d, t, _ in rows:
        r = got[d]
        want = brute_base(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.kept and r.base_failed)
    assert not got[204].kept and sum(r.kept for r in got.values()) > 10
    kept = quality.keep_good(spark.createDataFrame([(d, t, x, "l") for d, t, x in rows], SCHEMA)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(d for d, r in got.items() if r.kept)


def plain_model(texts, order=5):
    """Interpolated modified Kneser-Ney by dictionaries."""
    counts = {order: Counter(t[i : i + order] for t in texts for i in range(len(t) - order + 1))}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    prob, discount = {(): 1 / 256}, {}
    for n in range(1, order + 1):
        cc = Counter(counts[n].values())
        y = cc[1] / (cc[1] + 2 * cc[2]) if cc[1] + 2 * cc[2] else None
        d = {}
        for i in (1, 2, 3):
            x = i - (i + 1) * y * cc[i + 1] / cc[i] if y is not None and cc[i] else 0.5
            d[i] = min(max(x, 0.05), i - 0.05)
        discount[n] = d
        total, cut = Counter(), Counter()
        for g, c in counts[n].items():
            total[g[:-1]] += c
            cut[g[:-1]] += d[min(c, 3)]
        for g, c in counts[n].items():
            low = prob[g[1:]] if n > 1 else 1 / 256
            prob[g] = (c - d[min(c, 3)]) / total[g[:-1]] + cut[g[:-1]] / total[g[:-1]] * low

    def of(g):
        """Probability of any n-gram, by back-off where it or its context was not seen."""
        if not g:
            return 1 / 256
        if g in prob:
            return prob[g]
        n = len(g)
        seen = {x: c for x, c in counts[n].items() if x[:-1] == g[:-1]}
        if not seen:
            return of(g[1:])
        return sum(discount[n][min(c, 3)] for c in seen.values()) / sum(seen.values()) * of(g[1:])

    return of, prob


def code(gram):
    return int.from_bytes(gram, "big")


def test_bits_match_plain_kneser_ney(spark):
    """Each text's bits are the sum over its n-grams, those of texts that are not learnt from included."""
    texts = [t for _, t, x in corpus() if x == "en" and t]
    fit = [b[0] >= 10 and 100 * b[4] <= 20 * b[0] and b[2] * 10 <= b[0] for b in map(brute_base, texts)]
    assert 0 < sum(fit) < len(texts)
    prob, _ = plain_model([t.encode() for t, ok in zip(texts, fit) if ok])
    rows = spark.createDataFrame([(i, t, "en", "l") for i, t in enumerate(texts)], SCHEMA).repartition(5)
    for block_bytes in (1 << 20, 200):
        got = {r.doc_id: r.bits_per_byte for r in quality.verdicts(rows, block_bytes=block_bytes).collect()}
        for i, t in enumerate(texts):
            grams = [t.encode()[j : j + 5] for j in range(len(t.encode()) - 4)]
            assert abs(got[i] + sum(np.log2(prob(g)) for g in grams) / len(grams)) < 1e-4


def test_languages_do_not_share_counts(spark):
    """byt and daa have one 16-bit checksum; each learns from its own texts alone."""
    texts = [(t, x) for x in ("byt", "daa") for _, t, y in corpus() if y == "en" and t]
    texts = [(t.replace("a", "o") if x == "daa" else t, x) for t, x in texts]
    both = {r.doc_id: r.bits_per_byte for r in quality.verdicts(spark.createDataFrame([(i, t, x, "l") for i, (t, x) in enumerate(texts)], SCHEMA)).collect()}
    one = {r.doc_id: r.bits_per_byte for r in quality.verdicts(spark.createDataFrame([(i, t, x, "l") for i, (t, x) in enumerate(texts) if x == "daa"], SCHEMA)).collect()}
    assert one and all(both[i] == v for i, v in one.items())


def test_probabilities_of_a_context_sum_to_one(spark):
    rnd = random.Random(6)
    counts = Counter(bytes(rnd.choice(b"abcd ") for _ in range(5)) for _ in range(3000))
    contexts = [*{g[:4] for g in list(counts)[:20]}, b"zzzz", b"abzz"]
    rows = [("en", code(g), c) for g, c in counts.items()] + [("en", code(x + bytes([b])), 0) for x in contexts for b in range(256) if x + bytes([b]) not in counts]
    model = {r.g: r.p for r in quality.kneser_ney(spark.createDataFrame(rows, "lang string, g long, c long")).collect()}
    assert len(model) == len(rows)
    for x in contexts:
        assert abs(sum(model[code(x + bytes([b]))] for b in range(256)) - 1) < 1e-9


def test_many_partitions_without_coalescing(spark):
    """Lists and shards meet by hash, also where no partitions are put together again."""
    df = spark.createDataFrame([(d, t, x, "l") for d, t, x in corpus()], SCHEMA)
    want = {r.doc_id: (r.kept, r.bits_per_byte) for r in quality.verdicts(df).collect()}
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        assert {r.doc_id: (r.kept, r.bits_per_byte) for r in quality.verdicts(df.repartition(7)).collect()} == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_bands_are_medians(spark):
    """kept is: the base rules pass and the bits per byte lie in the band of exact medians."""
    rnd = random.Random(12)
    rows = corpus() + [(300 + i, " ".join("".join(rnd.choice("bcdfgh") for _ in range(6)) for _ in range(40)), "en") for i in range(3)]
    got = quality.verdicts(spark.createDataFrame([(d, t, x, "l") for d, t, x in rows], SCHEMA)).collect()
    good = sorted(np.floor(r.bits_per_byte * 4096 + 0.5) for r in got if r.lang == "en" and not r.base_failed)
    middle = good[(len(good) - 1) // 2]
    spread = 1.4826 * sorted(abs(x - middle) for x in good)[(len(good) - 1) // 2] / 4096
    for r in got:
        if r.lang == "en" and not r.base_failed:
            wide = quality.BAND * (spread**2 + quality.SHORT**2 / r.n_grams) ** 0.5
            assert abs(r.high - (middle / 4096 + wide)) < 1e-9 and abs(r.low - (middle / 4096 - quality.LOWER * wide)) < 1e-9
            assert r.kept == (r.low <= r.bits_per_byte <= r.high)
    assert not any(r.kept for r in got if r.doc_id >= 300)


def test_extra_columns_and_repeated_rows(spark):
    rows = [(d, t, x, "l", 1, 2) for d, t, x in corpus()] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, kind string, block int, n_words int")
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and kept.count() % 2 == 0 and kept.count() > 20


def test_rows_go_by_their_own_text(spark):
    rows = [(d, t, x, "l") for d, t, x in corpus()]
    good = [r for r in rows if r[0] in {k.doc_id for k in quality.keep_good(spark.createDataFrame(rows, SCHEMA)).collect()}]
    more = [(None, good[0][1], good[0][2], "g"), (None, "la " * 60, "en", "b"), (None, "x", None, "b"), (None, None, None, "b"), (good[1][0], "la " * 60, "en", "b"), (good[1][0], None, "en", "b")]
    kept = quality.keep_good(spark.createDataFrame(rows + more, SCHEMA)).collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [*good, more[0]]))


def test_empty_table_and_repeat_words(spark):
    assert quality.verdicts(spark.createDataFrame([], SCHEMA)).collect() == []
    text = Text(pa.array(["a b c d e x a b c d e", None, "a b c d e", "q " * 7]))
    assert quality.repeat_words(Words(text), 4).tolist() == [10, 0, 0, 7]
