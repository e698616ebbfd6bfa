import random

import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st

from joblode.llm.token_counts import Automaton, byte_level_pieces, token_counts


def greedy(word, initial, following):
    n, at, pieces = 0, 0, initial
    while at < len(word):
        for end in range(len(word), at, -1):
            if word[at:end] in pieces:
                break
        else:
            return -1
        n, at, pieces = n + 1, end, following
    return n


@settings(max_examples=200, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=4).map(lambda b: bytes(97 + x % 3 for x in b))), st.sets(st.binary(min_size=1, max_size=5).map(lambda b: bytes(97 + x % 3 for x in b))), st.lists(st.binary(max_size=12).map(lambda b: bytes(97 + x % 3 for x in b))))
def test_counts_are_greedy(initial, following, words):
    a = Automaton(initial, following)
    for w in words:
        assert a.count(w) == greedy(w, initial, following)


def test_documents(spark):
    initial, following = map(set, byte_level_pieces(P.path("byte_bpe_50k.json")))
    rnd = random.Random(1)
    rows = [(i, " ".join("".join(rnd.choice("abcdeéñ漢%!1T") for _ in range(rnd.randint(1, 14))) for _ in range(rnd.randint(0, 30))), "w") for i in range(30)]
    rows += [(40, None, "w"), (41, "", "w"), (42, "internationalisation" * 400, "w"), (None, "hello", "w"), (42, "x", "w")]
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_words string"), P.path("byte_bpe_50k.json")).collect()
    want = [(d, len(w := (t or "").encode().split()), sum(greedy(b" " + x, initial, following) for x in w)) for d, t, _ in rows]
    key = lambda x: (x[0] is None, x)
    assert sorted(((r.doc_id, r.n_words, r.n_tokens) for r in got), key=key) == sorted(want, key=key)
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), P.path("byte_bpe_50k.json")).collect() == []
