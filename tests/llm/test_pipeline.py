import random

import corpus_pipeline


def test_stages_take_effect(spark, tmp_path):
    rnd = random.Random(8)
    vocab = [f"{a}{b}" for a in ("lo", "mi", "ter", "san", "qu", "ve") for b in ("ra", "ne", "so", "lit", "um", "e")]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n)) + "."
    passage, item = text(60), text(40)
    docs = [(i, text(rnd.randint(40, 120)), "en", "s", 0) for i in range(60)]
    docs += [(100, docs[0][1], "en", "s", 0), (101, docs[1][1] + "\n" + passage, "en", "s", 0), (102, text(70) + "\n" + passage, "en", "s", 0)]
    docs += [(103, text(30) + " " + item + " " + text(30), "en", "s", 0), (104, "%%%*** $$$" * 60, "en", "s", 0), (105, None, None, None, None), (106, "la " * 80, "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "packing":
            assert out.columns == now.columns
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id: r for r in now.collect()}
    assert {104, 105, 106}.isdisjoint(seen["quality"]) and {100, 101, 102, 103} <= set(seen["quality"])
    assert 100 not in seen["near_dedup"] and 0 in seen["near_dedup"]
    assert set(seen["substring_dedup"]) == set(seen["near_dedup"])
    assert all(passage not in r.text for r in seen["substring_dedup"].values())
    assert seen["substring_dedup"][5].text == docs[5][1] and seen["substring_dedup"][102].n_chars == len(seen["substring_dedup"][102].text)
    assert set(seen["near_dedup"]) - set(seen["decontaminate"]) == {103}
    assert set(seen["packing"]) == set(seen["decontaminate"])
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(str, now.select("doc_id", "piece", "ids_crc32").collect()))


def test_edited_copies_go(spark):
    rnd = random.Random(9)
    docs = [(i, " ".join(f"w{rnd.randint(0, 3000)}" for _ in range(150)), "en", "s", 0) for i in range(20)]
    for i in range(20):
        w = docs[i][1].split()
        w[10], w[90] = "other", "words"
        docs.append((100 + i, " ".join(w), "en", "s", 0))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == list(range(20))
