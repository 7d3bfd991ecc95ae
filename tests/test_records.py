import json
from pyspark.sql import functions as F
from refsift.operators import reporting
from refsift.plans.engine import check_observations
from refsift.plans.registry import Source
from refsift.schema import ENTRIES_DDL
from refsift.sources.records import function_answers, parsed, record_answers
from refsift.sources.records import read_record_lines, read_records
from refsift.plans.settings import Limits, flag, number, too_large

LONG = "Remarkable Properties of Extremely Careful Citation Checking Systems Explained"
ENTRIES = [("a", "article", {"title": LONG, "author": "Ann Lee and Bob Ray", "year": "2023", "doi": "10.1234/a"}), ("b", "article", {"title": "Something Else", "author": "X Y"}), ("c", "article", {"title": "Broken"})]
ANN = {"title": LONG, "authors": ["Ann Lee", "Bob Ray"], "year": 2023, "doi": "10.1234/A"}


def entries_of(spark):
    return spark.createDataFrame(ENTRIES, ENTRIES_DDL)


def answers(frame):
    return {(r["key"], r["mode"]): [(c["source"], c["title"], c["authors"], c["year"], c["identifier"]) for c in r["candidates"]] for r in frame.collect()}


def test_record_files_of_every_shape(spark, tmp_path):
    shapes = {
        "list": [ANN, ANN, "no record"],
        "records": {"records": [ANN]},
        "keyed": {"doi:10.1234/a": ANN, "title:something else": [{"title": "Else", "author": "X Y and Z", "provider": "p"}], "note": 5},
        "everyone": {"*": [ANN]},
        "nothing": 5,
    }
    whole = ("local", LONG, ["Ann Lee", "Bob Ray"], 2023, "10.1234/A")
    for name, said in shapes.items():
        file = tmp_path / f"{name}.json"
        file.write_text(json.dumps(said))
        got = answers(record_answers(entries_of(spark), read_records(spark, str(file)), "local", 3))
        assert len(got) == 6, name
        a, b = got["a", "title"], got["b", "identifier"]
        if name == "nothing":
            assert a == b == []
            continue
        assert [x[1:4] for x in a] == [whole[1:4]], (name, a)
        assert a[0][4].lower() == "10.1234/a" and a[0][0] == "local"
        assert b == {"keyed": [("p", "Else", ["X Y", "Z"], None, "")], "everyone": a}.get(name, [])


def test_record_lines(spark, tmp_path):
    file = tmp_path / "x.jsonl"
    file.write_text(json.dumps(ANN) + "\n" + json.dumps({"title": None}) + "\n")
    got = answers(record_answers(entries_of(spark), read_record_lines(spark, str(file), "mine"), "mine", 0))
    assert [x[:2] for x in got["a", "title"]] == [("mine", LONG)] and got["b", "title"] == []


def test_a_function_as_source_and_its_errors(spark):
    def find(entry):
        if entry["key"] == "b":
            raise ValueError("no answer")
        return [ANN | {"unknown": 1}]

    def applies(entry):
        if entry["key"] == "c":
            raise KeyError("field")
        return True

    said = function_answers(entries_of(spark), find, "mine", 0, applies)
    out = check_observations(entries_of(spark), said, (Source("mine", identifier_lookup=True),))
    got = {r["key"]: r for r in out.collect()}
    assert got["a"]["status"] == "validated" and got["a"]["candidates"][0]["source"] == "mine"
    assert got["b"]["provider_errors"] == {"mine:title": "no answer"}
    assert got["c"]["provider_errors"] == {"mine:applies": "'field'"} and got["c"]["completed"] == 0


def test_reports_are_whole_documents(spark, tmp_path):
    entries = entries_of(spark)
    said = function_answers(entries, lambda e: [ANN] if e["key"] == "a" else [], "mine", 0)
    results = check_observations(entries, said, (Source("mine", identifier_lookup=True),)).persist()
    missing = spark.createDataFrame([('q"1',), ("m",), ("m",)], "key string")
    heard = []
    reporting.tee(reporting.run_report(results, missing, "x.log", "x.json"), str(tmp_path / "run"), heard.append)
    whole = json.loads("".join(heard))
    assert whole["missing_citation_keys"] == ["m", 'q"1'] and [r["key"] for r in whole["results"]] == ["a", "b", "c"]
    assert (whole["log_file"], whole["issues_file"]) == ("x.log", "x.json")
    kept = "".join(p.read_text() for p in sorted((tmp_path / "run").glob("part-*")))
    assert json.loads(kept) == whole
    found = reporting.issues(results)
    rows = reporting.issues_report(found, missing, "refs.bib").orderBy("part", "at").collect()
    listed = json.loads("".join(r["text"] for r in rows))
    assert listed["bib"] == "refs.bib" and listed["issue_count"] == 2 == len(listed["issues"]) and listed["issues"][0]["problems"]
    none = json.loads("".join(r["text"] for r in reporting.issues_report(found.limit(0), missing.limit(0), "b").orderBy("part", "at").collect()))
    assert none == {"bib": "b", "issue_count": 0, "missing_citation_keys": [], "issues": []}


def test_summary_in_groups(spark):
    rows = [("b", "unconfirmed", "T", ["A B", "C"], ["r1", "r2"]), ("a", "unconfirmed", "", [], []), ("z", "validated", "V", ["A"], ["r"])]
    results = spark.createDataFrame(rows, "key string, status string, title string, authors array<string>, reasons array<string>")
    text = "\n".join(r["text"] for r in reporting.final_summary(results).orderBy("part", "at").collect())
    assert text.split("\n") == [
        "likely_hallucination (0)", "  none", "needs_review (0)", "  none", "unconfirmed (2)",
        "  1. title: none", "     authors: none", "     reasons:", "       - none",
        "  2. title: T", "     authors: A B; C", "     reasons:", "       - r1", "       - r2", "validated (1)",
    ]


def test_settings(spark):
    env = {"A": " Yes ", "B": "no", "N": "12", "BAD": "x", "REFSIFT_MAX_FILE_BYTES": "3"}
    assert flag("A", False, env) and not flag("B", True, env) and flag("C", True, env)
    assert (number("N", 1, env), number("BAD", 1, env), number("M", 1, env)) == (12, 1, 1)
    files = spark.createDataFrame([("a", "äb"), ("b", "äbc"), ("c", None)], "file string, text string")
    assert [r["too_large"] for r in too_large(files, Limits.from_environment(env)).orderBy("file").collect()] == [False, True, False]
    assert not too_large(files, Limits()).filter("too_large").count()
