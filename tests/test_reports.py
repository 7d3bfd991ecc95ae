"""Running sums over ranges, names as shown, identifiers of the old kind."""

import pytest
from pyspark.sql import functions as F

from refsift.functions import authors as A
from refsift.functions import text as T
from refsift.operators import reporting


@pytest.mark.parametrize("range_rows", [40, 200, 10_000])
def test_running_sums_over_several_ranges(spark, range_rows):
    key = F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 4, "0"))
    rows = spark.range(500).select(key.alias("key"), F.when(F.col("id") % 3 == 0, "validated").when(F.col("id") % 7 > 0, "unconfirmed").alias("status"))
    seen = {}
    got = sorted(reporting.running_counts(rows, range_rows=range_rows).collect(), key=lambda r: r["key"])
    assert len(got) == 500
    for i, r in enumerate(got, 1):
        seen[r["status"]] = seen.get(r["status"], 0) + 1
        assert (r["index"], r["of_status"]) == (i, seen[r["status"]])


def test_running_sums_of_one_value_many_rows_have(spark, monkeypatch):
    monkeypatch.setattr(reporting, "RANGE_ROWS", 100)
    rows = spark.range(1000).select(F.when(F.col("id") % 10 > 0, "same").otherwise(F.concat(F.lit("z"), F.col("id").cast("string"))).alias("key"), F.col("id").alias("v"))
    got = reporting.running(rows, "key", {"n": F.lit(1), "s": F.col("v")}).collect()
    assert sorted(r["n"] for r in got if r["key"] == "same") == list(range(1, 901)) and max(r["s"] for r in got) == 499500
    placed = reporting.in_order(rows, "key")
    assert placed.filter("key = 'same'").select("_range").distinct().count() > 1


def test_names_are_shown_without_latex(spark):
    rows = spark.createDataFrame([(["M{\\\"u}ller, Jos\\'e", "Ann Lee"],), ([],)], "names array<string>").select("names", A.people(F.col("names")).alias("p"))
    got = rows.select(F.transform(A.shown(F.col("p")), lambda p: A.display(p["name"])).alias("shown"), A.first_surname(F.transform(A.shown(F.col("p")), lambda p: p["name"])).alias("first")).collect()
    assert [(r["shown"], r["first"]) for r in got] == [(["José Müller", "Ann Lee"], "Müller"), ([], "")]


def test_old_arxiv_versions_and_lower_dois(spark):
    row = spark.range(1).select(T.arxiv_version(F.lit("cs/0701001v2")).alias("old"), T.arxiv_version(F.lit("2001.00001v3")).alias("new"), T.source_doi(F.lit("see 10.1234/ABC).")).alias("doi")).first()
    assert tuple(row) == (2, 3, "10.1234/abc")
