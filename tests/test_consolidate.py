from pyspark.sql import functions as F

from refsift.operators.consolidate import assessed, consolidated, ranked_assessments
from refsift.schema import CANDIDATE

TITLE = "A Careful Study of Merged Records"
ENTRY = {"title": TITLE, "author": "Ann Lee and Bob Ray", "year": "2020", "eprint": "2001.00001v1"}


def record(source, title=TITLE, authors=("Ann Lee", "Bob Ray"), year=2020, venue="", doi="", arxiv_id=""):
    return (source, title, list(authors), year, venue, "", "", doi, arxiv_id, "", "", None, None, None)


CASES = {
    "title_only": [record("s", authors=())],
    "version": [record("s", arxiv_id="2001.00001v2")],
    "conflict": [record("s", "Nothing of the Kind at All", ("X Y",), arxiv_id="2001.00001")],
    "merged": [record("title", authors=(), year=None), record("whole", doi="10.1234/x", venue="Annals")],
    "ranked": [record("bare", authors=()), record("named")],
    "apart": [record("one", doi="10.1234/a"), record("two", doi="10.1234/b")],
}


def test_second_scorer(spark):
    rows = [(key, ENTRY if key in ("version", "conflict") else {k: v for k, v in ENTRY.items() if k != "eprint"}, i, c) for key, cs in CASES.items() for i, c in enumerate(cs)]
    table = spark.createDataFrame(rows, f"key string, fields map<string,string>, pos int, c {CANDIDATE}")
    scored = assessed(table).persist()
    got = {(r["key"], r["c"]["source"]): r["a"] for r in scored.collect()}
    bare = got["title_only", "s"]
    assert (bare["confidence"], bare["author_score"], bare["identifier_conflict"], bare["score"]) == ("title_only", None, False, 0.86)
    assert got["version", "s"]["identifier_match"] and got["version", "s"]["confidence"] == "identifier"
    assert got["conflict", "s"]["identifier_conflict"] and got["conflict", "s"]["score"] < got["version", "s"]["score"]
    first = {r["key"]: r["c"]["source"] for r in ranked_assessments(scored).filter("rank = 1").collect()}
    assert first["ranked"] == "named"
    groups = {}
    for r in consolidated(scored).orderBy("key", "position").collect():
        groups.setdefault(r["key"], []).append(r)
    one = groups["merged"][0]
    assert len(groups["merged"]) == 1 and one["sources"] == ["whole", "title"] and one["representative"]["c"]["source"] == "whole"
    assert one["score"] >= got["merged", "whole"]["score"]
    assert len(groups["apart"]) == 2
    assert scored.filter(F.col("key") == "none").count() == 0
