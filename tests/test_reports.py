"""Reports, one a file or many."""

import os

from joblode.plans import all_queries
from joblode.sources import files

REPORT = "# R\n```yaml\ncompany: \"{0}\"\nscore: 3\n```\n**Role:** Engineer\n| Gap | Severity |\n|---|---|\n| no {0} | high |\n"


def test_many_reports_in_a_file_read_as_one_a_file(spark, tmp_path):
    names = [f"c{i}" for i in range(5)]
    (tmp_path / "one").mkdir()
    for n in names:
        (tmp_path / "one" / f"{n}.md").write_text(REPORT.format(n))
    (tmp_path / "many.txt").write_text("".join(REPORT.format(n) + "\f" for n in names))
    read = lambda *a: sorted((r.company, r.role, r.score, tuple(r.gaps)) for r in files.reports(spark, *a).collect())
    assert read(str(tmp_path / "one")) == read(str(tmp_path / "many.txt"), "\f") == [(n, "Engineer", "3", (f"no {n}",)) for n in names]


def test_files_do_not_grow_with_the_reports(spark, tmp_path):
    spark.range(300).selectExpr("id AS s_suppkey", "concat('S', id) AS s_name").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    got = all_queries()["s08_reports"](spark, str(tmp_path))
    assert got.count() == 300 and len([f for f in got.inputFiles() if os.path.basename(f).startswith("part-")]) < 20
