import random
import re
from collections import Counter

from joblode.llm.decontam import Items, drop_leaks, find_leaks

DOCS, ITEMS = "doc_id long, text string, item_ids string", "item_id long, text string, extra string"


def words(t):
    return re.findall(r"[a-zA-Z0-9\x80-\U0010ffff]+", (t or "").lower())


def bag(w):
    k = min(5, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def brute(docs, items):
    out = {}
    for d, t in docs:
        w, found = words(t), {}
        for i, x in items:
            q = words(x)
            for a in range(max(1, len(w) - len(q) + 1)):
                p = w[a : a + len(q)]
                if q and p and (len(p) >= 5 or len(p) == len(q)):
                    x, y = bag(p), bag(q)
                    s = sum((x & y).values()) / sum((x | y).values())
                    if s >= 0.8:
                        found[i] = max(s, found.get(i, 0))
        out[d] = {i: round(s, 9) for i, s in found.items()}
    return out


def corpus():
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(40)] + ["é", "Ñu"]
    text = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(text(n))) for i, n in enumerate((3, 5, 20, 33, 33, 60, 120))] + [(20, None), (21, ""), (22, "a a a a a a a a")]
    docs = []
    for d in range(50):
        w = text(rnd.randint(0, 60))
        if d % 2:
            q = rnd.choice(items[:7])[1].split()
            for _ in range(rnd.choice((0, 0, 1, 1, 2))):
                q[rnd.randint(0, len(q) - 1)] = rnd.choice(vocab)
            w = [*w, *q[: len(q) - rnd.choice((0, 0, 1, 5))], *text(rnd.randint(0, 20))]
        docs.append((d, " ".join(w).upper() if d % 3 == 0 else ", ".join(w)))
    return [*docs, (90, None), (91, ""), (92, "b A a a, a a a a a a c"), (93, items[5][1])], items


def test_matches_brute_force_in_one_pass_and_in_many(spark):
    docs, items = corpus()
    a, b = spark.createDataFrame([(*r, "x") for r in docs], DOCS), spark.createDataFrame([(*r, "x") for r in items], ITEMS)
    want = brute(docs, items)
    assert sum(map(bool, want.values())) > 10
    for size in (1 << 20, 300):
        got = find_leaks(a, b, pass_bytes=size).collect()
        assert {r.doc_id: {i: round(s, 9) for i, s in zip(r.item_ids, r.similarities)} for r in got} == want
        assert all(r.contaminated == bool(r.item_ids) for r in got)
    kept = drop_leaks(a.union(spark.createDataFrame([(None, items[5][1], "x")], DOCS)), b).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(d for d, f in want.items() if not f)
    # a leaking row goes whether or not it has an id
    assert not any(r.doc_id is None for r in kept)


def test_rows_are_told_apart_by_text_in_any_number_of_passes(spark):
    """Rows that share a doc_id, or have none, are answered by their own text; clean ones stay."""
    docs, items = corpus()
    leak, other = items[5][1], items[6][1]
    rows = [(1, leak), (1, "clean words of no item at all"), (None, leak), (None, "clean"), (None, other + " " + leak), (None, other + " " + leak), (2, None)]
    a, b = spark.createDataFrame([(*r, "x") for r in rows], DOCS), spark.createDataFrame([(*r, "x") for r in items], ITEMS)
    want = sorted([(1, str([5])), (1, "[]"), (-1, str([5])), (-1, "[]"), (-1, str([5, 6])), (-1, str([5, 6])), (2, "[]")])
    for size in (1 << 20, 2000, 300, 40):
        assert sorted((-1 if r.doc_id is None else r.doc_id, str(list(r.item_ids))) for r in find_leaks(a, b, pass_bytes=size).collect()) == want
        assert sorted(map(str, drop_leaks(a, b, pass_bytes=size).collect())) == sorted(map(str, a.where("text like 'clean%' or text is null").collect()))


def test_index_is_small(spark):
    """The index of a block takes less than eight times its text, so 16 MB of items take less than 128 MB."""
    rnd = random.Random(5)
    texts = [" ".join(f"{rnd.choice('bcdf')}{rnd.randint(0, 9999)}" for _ in range(rnd.randint(8, 200))) for _ in range(4000)]
    size = sum(map(len, texts))
    assert Items(list(range(len(texts))), texts).nbytes() < 8 * size


def test_empty_tables(spark):
    a, b = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert find_leaks(a, b).collect() == []
    one = spark.createDataFrame([(1, "x y z", "x"), (1, "x y z", "x")], DOCS)
    assert [tuple(r)[:2] for r in find_leaks(one, b).collect()] == [(1, False), (1, False)]
