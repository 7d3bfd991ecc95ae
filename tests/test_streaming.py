import json

from pyspark.sql import functions as F

from refsift.streaming.watch import events, second_pass, watch


def test_files_are_checked_once(spark, tmp_path):
    folder = tmp_path / "bib"
    folder.mkdir()
    (folder / "a.bib").write_text("@misc{x, title={One}} @misc{y, title={Two}}")
    seen = []

    def check(entries):
        return entries.select("key", F.lit("validated").alias("status"))

    def sink(results, number):
        seen.append(sorted(r["key"].rpartition("#")[2] for r in results.collect()))

    watch(spark, str(folder), check, sink, str(tmp_path / "checkpoint")).awaitTermination(120)
    (folder / "b.bib").write_text("@misc{z, title={Three}}")
    watch(spark, str(folder), check, sink, str(tmp_path / "checkpoint")).awaitTermination(120)
    assert seen == [["x", "y"], ["z"]]


def test_events(spark):
    none = "array<struct<source string, title string, authors array<string>, year int, venue string, url string, identifier string, score double, title_score double, author_score double, year_score double, identifier_match boolean, evidence array<string>, conflicts array<string>>>"
    rows = [("b", "validated", 1.0, ["r"], [], {}, None), ("a", "unconfirmed", 0.0, ["r"], [], {}, None)]
    results = spark.createDataFrame(rows, f"key string, status string, score double, reasons array<string>, candidates {none}, provider_errors map<string,string>, field_comparison string")
    told = [json.loads(r["json"]) for r in events(results).orderBy("position").collect()]
    assert [t["event"] for t in told] == ["start", "result", "result", "summary"]
    assert [t["result"]["key"] for t in told[1:3]] == ["a", "b"] and told[-1]["counts"] == {"unconfirmed": 1, "validated": 1}
    entries = spark.createDataFrame([("a",), ("b",)], "key string")
    assert [r["key"] for r in second_pass(results, entries).collect()] == ["a"]
