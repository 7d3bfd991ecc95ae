"""Plans that neither gather a side in one task nor leave the dear part to one."""

from pyspark.sql import functions as F

from refsift.operators import lookup
from refsift.sources.bibtex import entries_of
from refsift.sources.latex import scan, scans_of


def test_many_entries_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 10, raising=False)
    rows = spark.range(50).select(F.col("id").cast("string").alias("key"), F.col("id").alias("record_id"), F.concat(F.lit("10.1/"), "id").alias("n_doi"), F.concat(F.lit("10.1/"), "id").alias("k_doi"))
    found = lookup.by_doi(rows, rows)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((int(r["key"]), r["record_id"]) for r in found.collect()) == [(i, i) for i in range(50)]


def test_entries_of_one_small_table_are_parsed_by_many_tasks(spark):
    texts = spark.range(400).coalesce(1).select(F.col("id").cast("string").alias("file"), F.lit("@Misc{ K , Title = { T }, title={U}} @misc{K, Year=2}").alias("text"))
    found = entries_of(texts)
    assert "from_json" not in found._jdf.queryExecution().executedPlan().toString()
    rows = found.collect()
    assert len(rows) == 400 and {(r["pos"], r["key"], r["entry_type"], tuple(r["fields"].items())) for r in rows} == {(0, "K", "misc", (("year", "2"),))}


def test_files_of_one_small_table_are_scanned_by_many_tasks(spark):
    text = F.when(F.col("id") % 4 > 0, F.lit(r"\cites[a]{k}[b{]{l}{m\}, n} % \cite{no}"))
    texts = spark.range(400).coalesce(1).select(F.col("id").cast("string").alias("file"), text.alias("text"))
    rows = scans_of(texts).withColumn("task", F.spark_partition_id()).collect()
    assert len({r["task"] for r in rows}) > 3 and {(int(r["file"]) % 4 > 0, *r["keys"]) for r in rows} == {(False,), (True, "k", "l", "m\\}", "n")}
    assert scans_of(texts.limit(0)).count() == 0
    assert scan("\\cite[x\\]]{a} \\cite[[b]]{c{d}} \\cite *[e] [f] {g , h} \\cites{i} {j}[k] \\cite[l {m}") == (["a", "c{d}", "g", "h", "i", "j"], [])
