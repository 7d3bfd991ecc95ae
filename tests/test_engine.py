"""Scenarios of the decision, all in one run: each entry with what its sources say."""

import pytest
from pyspark.sql import functions as F

from refsift.operators.reporting import issues, report_lines, result_json, status_counts
from refsift.operators.sentences import NO_DIFFERENCE, SENTENCES, explained, sentences
from refsift.plans.engine import check_observations
from refsift.plans.registry import Source
from refsift.schema import ENTRIES_DDL, OBSERVATIONS_DDL

SOURCES = (
    Source("url", academic=False),
    Source("arxiv", identifier_lookup=True),
    Source("datacite", identifier_lookup=True),
    Source("openalex", identifier_lookup=True),
    Source("crossref", identifier_lookup=True),
    Source("neurips", authoritative=True, venues=("neurips",)),
    Source("extra"),
)
AT = {s.name: i for i, s in enumerate(SOURCES)}
LONG = "Remarkable Properties of Extremely Careful Citation Checking Systems Explained"
OTHER = "Thermal Conductivity Measurements in Frozen Polymer Layers"


def record(source, title=LONG, authors=("Ann Lee", "Bob Ray"), year=2023, venue="", doi="", arxiv_id="", arxiv_version=None, url=""):
    return (source, title, list(authors), year, venue, url, "", doi, arxiv_id, "", "", arxiv_version, None, None)


def entry(title=LONG, author="Ann Lee and Bob Ray", year="2023", **more):
    return {"title": title, "author": author, "year": year, **more}


EPRINT = {"eprint": "2301.00001"}
SAME_ID = {"arxiv_id": "2301.00001"}
THREE = "Ann Lee and Bob Ray and Cy Poe"
# name: fields, {(source, mode): records or an error}, status, branch
CASES = {
    "same": (entry(**EPRINT), {("arxiv", "identifier"): [record("arxiv", **SAME_ID)]}, "validated", "D4"),
    "wrong_record": (entry(**EPRINT), {("arxiv", "identifier"): [record("arxiv", OTHER, ("X Y",), **SAME_ID)], ("openalex", "title"): [record("openalex", OTHER, ("X Y",))]}, "likely_hallucination", "D7"),
    "wrong_record_but_found": (entry(**EPRINT), {("arxiv", "identifier"): [record("arxiv", OTHER, ("X Y",), **SAME_ID)], ("openalex", "title"): [record("openalex")]}, "needs_review", "D2"),
    "other_year": (entry(), {("openalex", "title"): [record("openalex", year=2024)]}, "needs_review", "D15"),
    "venue": (entry(journal="Annals"), {("openalex", "title"): [record("openalex", venue="Annals")]}, "validated", "D15"),
    "unrelated": (entry(title="Short title of four"), {("openalex", "title"): [record("openalex", OTHER, ("X Y",))]}, "unconfirmed", "D18"),
    "missing_everywhere": (entry(author=THREE), {}, "likely_hallucination", "D17"),
    "one_error": (entry(author=THREE), {("openalex", "title"): "timeout"}, "likely_hallucination", "D17"),
    "errors_are_no_absence": (entry(author=THREE), {(s, "title"): "timeout" for s in ("openalex", "crossref", "datacite", "extra")}, "unconfirmed", "D18"),
    "official_miss": (entry(booktitle="NeurIPS"), {}, "likely_hallucination", "D16"),
    "official_hit": (entry(booktitle="NeurIPS"), {("neurips", "title"): [record("neurips", venue="NeurIPS")]}, "validated", "D15"),
    "later_version": (
        entry(**EPRINT),
        {("arxiv", "identifier"): [record("arxiv", OTHER, ("Ann Lee",), arxiv_version=1, **SAME_ID), record("arxiv", arxiv_version=3, **SAME_ID)]},
        "validated",
        "D4",
    ),
    "renamed": (entry(**EPRINT), {("arxiv", "identifier"): [record("arxiv", OTHER, **SAME_ID)]}, "needs_review", "D6"),
    "version_of_title": (
        entry(title="GreatName: subtitle one", **EPRINT),
        {("arxiv", "identifier"): [record("arxiv", "GREATNAME: another two", **SAME_ID)]},
        "validated",
        "D4",
    ),
    "one_of_two_authors": (entry(**EPRINT), {("arxiv", "identifier"): [record("arxiv", authors=("Ann Lee", "Zed Zoo", "Yan Yew"), **SAME_ID)]}, "needs_review", "D3"),
    "page": (entry(url="https://lab.notion.site/post"), {("url", "title"): [record("url", url="https://lab.notion.site/post")]}, "validated", "D14"),
    "nothing": ({"author": "A B"}, {}, "unconfirmed", "D1"),
    "doi_of_other_records": (entry(doi="10.1/x"), {("crossref", "identifier"): [record("crossref", OTHER, ("X Y",), doi="10.9999/other")]}, "likely_hallucination", "D12"),
    "doi_of_other_records_and_error": (
        entry(doi="10.1/x"),
        {("crossref", "identifier"): [record("crossref", OTHER, ("X Y",), doi="10.9999/other")], ("openalex", "identifier"): "timeout"},
        "unconfirmed",
        "D13",
    ),
}


@pytest.fixture(scope="module")
def results(spark):
    entries = spark.createDataFrame([(k, "article", c[0]) for k, c in CASES.items()], ENTRIES_DDL)
    rows = []
    for key, (_, said, _, _) in CASES.items():
        for source in SOURCES:
            for mode in ("identifier", "title"):
                found = said.get((source.name, mode), [])
                failed = isinstance(found, str)
                rows.append((key, source.name, AT[source.name], mode, "error" if failed else "ok", found if failed else None, [] if failed else found))
    out = check_observations(entries, spark.createDataFrame(rows, OBSERVATIONS_DDL), SOURCES)
    return out.persist()


def test_statuses(results):
    got = {r["key"]: (r["status"], r["branch"]) for r in results.select("key", "status", "branch").collect()}
    assert got == {k: (c[2], c[3]) for k, c in CASES.items()}


def test_early_exit_and_errors(results):
    rows = {r["key"]: r for r in results.select("key", "completed", "provider_errors", "no_match_sources").collect()}
    assert rows["same"]["completed"] == 1
    assert rows["official_miss"]["completed"] == 1
    assert rows["one_error"]["provider_errors"] == {"openalex:title": "timeout"}
    assert rows["one_error"]["no_match_sources"] == 3 - 1
    assert set(rows["errors_are_no_absence"]["provider_errors"]) == {"openalex:title", "crossref:title", "extra:title"}


def test_comparison(results):
    rows = {r["key"]: r["field_comparison"] for r in results.select("key", "field_comparison").collect()}
    assert rows["other_year"]["year"].asDict() == {"bibtex": 2023, "retrieved": 2024, "status": "mismatch"}
    assert rows["version_of_title"]["title"]["status"] == "match"
    assert rows["unrelated"] is None


def test_reports(results):
    found = {r["key"]: r["problems"] for r in issues(results).collect()}
    assert "same" not in found and found["other_year"][1].startswith("year: bib=2023")
    assert sum(r["n"] for r in status_counts(results).collect()) == len(CASES)
    assert '"status":"validated"' in result_json(results).filter(F.col("key") == "same").first()["json"]
    assert report_lines(results).count() == len(CASES)


def test_sentences(spark, results):
    rows = {r["key"]: r for r in explained(results).select("key", "reasons", "sentences").collect()}
    assert all(r["sentences"][0] != r["reasons"][0] and "{" not in r["sentences"][0] for r in rows.values())
    assert rows["same"]["sentences"] == [SENTENCES["identifier_and_title_match"]]
    assert rows["other_year"]["sentences"][1].startswith("year: bib=2023")
    assert rows["wrong_record_but_found"]["sentences"][1:] == [NO_DIFFERENCE, f"Record under the identifier: arxiv - {OTHER}"]
    assert rows["official_miss"]["sentences"][0].startswith("Official sources for this venue (1)")
    assert rows["missing_everywhere"]["sentences"][0].endswith("answered, 3 have no reliable match for the title.")
    own = spark.createDataFrame([(["mine", "x"],), ([],), (None,)], "reasons array<string>")
    none = F.lit(None)
    assert [r[0] for r in own.select(sentences(F.col("reasons"), none, none, none.cast("string"))).collect()] == [["mine", "x"], [], []]
