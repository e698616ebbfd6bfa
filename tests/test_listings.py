"""Cross-listings of whole tables."""

import os

import pytest
from pyspark.sql import functions as F

from joblode.operators import similarity
from joblode.plans import all_queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_every_document_has_its_class_and_all_its_links(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = docs.select("text").where("length(text) > 400").first().text
    # copies of one text, company and day, 700 and 2100 documents apart
    copies = spark.createDataFrame([(i, text, "src0" if i < 3000 else "src1", "en", 0) for i in (0, 2100, 4200)], "doc_id long, text string, source string, lang string, n_chars long")
    copies.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.id: (r.n_links, r.least_distance) for r in all_queries()["j03_cross_listings"](spark, str(tmp_path)).collect()}
    assert got == {0: (1, 0), 2100: (1, 0), 4200: (2, 0)}


def test_classes_take_fingerprints_once(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 3, 99))) for i in range(9)], "doc_id long, text string")
    got = similarity.link_classes(docs.select(similarity.sha_simhash(F.col("text")).alias("fingerprint")))
    assert "ArrowEvalPython" not in got._jdf.queryExecution().toString()
    assert sum(r.n_a for r in got.where("fp_a = fp_b").collect()) == 9
