import random

import xxhash

from joblode.llm.simhash import fingerprint, links, near_duplicates

SCHEMA = "doc_id long, text string, fp string"


def plain(text):
    w = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps):
    parent = list(range(len(fps)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(fps))]


def test_fingerprint_is_the_defined_one():
    for t in (None, "", " \n", "One", "One two", "a B c", "A b C d é E", "x " * 50, "Über x y\x0bz " * 7):
        assert fingerprint(t) == plain(t)


def test_components_match_brute_force(spark):
    rnd = random.Random(3)
    base = " ".join(f"word{rnd.randint(0, 3000)}" for _ in range(400))
    rows = [(i, " ".join(f"t{rnd.randint(0, 500)}" for _ in range(rnd.randint(0, 60)))) for i in range(40)]
    for i in range(40, 80):
        w = base.split()
        w[rnd.randint(0, 399)] = f"new{i}"
        rows.append((i, " ".join(w)))
    rows += [(90, None), (91, ""), (92, rows[3][1])]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()}
    want = groups([plain(t) for _, t in rows])
    assert got == {r[0]: rows[g][0] for r, g in zip(rows, want)}


def test_dense_buckets_lose_no_link(spark):
    rnd = random.Random(4)
    fps = list({0x5555 ^ sum(1 << b for b in rnd.sample(range(30), rnd.randint(0, 3))) for _ in range(300)})
    fps += [rnd.getrandbits(64) for _ in range(50)]
    rows = [(i, f - (1 << 64 if f >> 63 else 0)) for i, f in enumerate(fps)]
    got = links(spark.createDataFrame(rows, "node long, fp long")).collect()
    assert all((fps[r.u] ^ fps[r.v]).bit_count() <= 2 for r in got)
    parent = list(range(len(fps)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for r in got:
        a, b = top(r.u), top(r.v)
        parent[max(a, b)] = min(a, b)
    assert [top(i) for i in range(len(fps))] == groups(fps)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
