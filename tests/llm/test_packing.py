import random
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from joblode.llm.packing import best_fit, cut, pack

SCHEMA = "doc_id long, text string, piece string"


def test_pieces_are_whole_and_gapless(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice(["alpha", "ñandú", "über", "don't", "12345", "%%%", "\n", "日本語"]) for _ in range(rnd.choice([0, 3, 50, 400, 1500])))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "x <|endoftext|> y"), (103, "word " * 5000), (103, "word " * 5000), (104, "a" * 30000)]
    got = pack(spark.createDataFrame([(*r, "p") for r in rows], SCHEMA).repartition(3), P.path("byte_bpe_50k.json"), group=20).collect()
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for d, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want += [(d, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert len(by) <= -(-sum(r.length for r in got) // 2048) + 3


def test_best_fit_and_cut():
    sizes = np.array([1000, 1048, 2000, 48, 2047, 1])
    assert sorted(map(sorted, best_fit(sizes, 2048))) == [[0, 1], [2, 3], [4, 5]]
    assert [x[:3] for x in cut(np.zeros(5000, np.uint32), 2048)] == [(0, 0, 904), (1, 904, 2048), (2, 2952, 2048)]
    assert [x[:3] for x in cut(np.zeros(2048, np.uint32), 2048)] == [(0, 0, 2048)]


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], SCHEMA), P.path("byte_bpe_50k.json")).collect() == []
