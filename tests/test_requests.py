"""Requests of entries, each address once, and answers of several addresses together."""

from refsift.operators.entries import entry_columns
from refsift.plans import requests as R
from refsift.schema import ENTRIES_DDL

TITLE = "Deep Trees of Knowledge"
PAPER = '<div class="paper"><p class="title">{}</p><p><span class="authors">Ann Lee, Bob Ray</span></p><p><a href="lee21.html">abs</a></p></div>'
PAGE = '<meta name="citation_title" content="{}"><meta name="citation_author" content="Lee, Ann">'
FEED = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2101.00001v2</id><title>From the feed</title></entry></feed>'
BIB = "@inproceedings{{{}, title = {{{}}}, author = {{Ann Lee}}, year = {{2021}}}}"
PAYLOADS_DDL = "url string, accept string, body string, error string"


def entries_of(spark, *rows):
    return entry_columns(spark.createDataFrame([(k, "article", f) for k, f in rows], ENTRIES_DDL))


def said(frame):
    return {(r["key"], r["mode"]): (r["outcome"], r["error"], [c["title"] for c in r["candidates"]]) for r in frame.collect()}


def test_arxiv_asks_both_versions_and_then_the_feed(spark):
    entries = entries_of(spark, ("both", {"eprint": "2101.00002"}), ("one", {"eprint": "2101.00003"}), ("feed", {"eprint": "2101.00001v2"}), ("none", {"eprint": "2101.00004"}), ("no", {"title": ""}))
    asked = R.arxiv_requests(entries).persist()
    urls = {(r["key"], r["step"], r["part"]): r["url"] for r in asked.collect()}
    assert urls["feed", 0, 0] == "https://arxiv.org/abs/2101.00001" and urls["feed", 0, 1].endswith("2101.00001v1") and "no" not in {k[0] for k in urls}
    page = lambda n, title: (f"{R.ARXIV_PAGES}{n}", R.HTML, PAGE.format(title), None)
    payloads = [page("2101.00002", "New"), page("2101.00002v1", "Old"), page("2101.00003v1", "Only"), ("https://arxiv.org/abs/2101.00001", R.HTML, None, "down"), (urls["feed", 1, 0], R.FEED, FEED, None)]
    got = said(R.answers(asked, spark.createDataFrame(payloads, PAYLOADS_DDL)))
    assert got["both", "identifier"] == ("ok", None, ["New", "Old"])
    assert got["one", "identifier"] == ("ok", None, ["Only"])
    assert got["feed", "identifier"] == ("ok", None, ["From the feed"])
    assert got["none", "identifier"] == ("error", "no answer", [])


def test_icml_asks_the_year_before_unless_a_title_is_close(spark):
    entries = entries_of(spark, ("near", {"title": TITLE, "year": "2021"}), ("far", {"title": "Other Matters Entirely", "year": "2021"}), ("unknown", {"title": "T", "year": "1999"}))
    volumes = {2021: 139, 2020: 119}
    asked = R.icml_requests(entries, volumes)
    pages = [(f"{R.ICML_VOLUME_PAGES}{v}/", R.HTML, PAPER.format(t), None) for v, t in ((139, TITLE), (119, "Of the year before"))]
    got = said(R.answers(asked, spark.createDataFrame(pages, PAYLOADS_DDL)))
    assert got["near", "title"] == ("ok", None, [TITLE])
    assert sorted(got["far", "title"][2]) == sorted([TITLE, "Of the year before"]) and len(got) == 2


def test_anthology_puts_all_volumes_together(spark):
    entries = entries_of(spark, ("a", {"title": TITLE, "year": "2021"}), ("b", {"title": TITLE, "year": "2020"}))
    page = "<a href=/events/acl-2021/>2021</a><a href=/volumes/2021.acl-long/>l</a><a href=/volumes/2021.acl-short/>s</a><a href=/events/acl-2020/>2020</a><a href=/volumes/2020.acl-main/>m</a>"
    asked = R.anthology_requests(entries, spark.createDataFrame([("acl", page)], "venue string, body string"), "acl")
    bibs = [(f"{R.ANTHOLOGY}volumes/2021.acl-{v}.bib", R.BIBTEX, BIB.format(v, t), None) for v, t in (("long", "Far from it"), ("short", TITLE))]
    got = said(R.answers(asked, spark.createDataFrame(bibs, PAYLOADS_DDL)))
    assert got["a", "title"] == ("ok", None, [TITLE, "Far from it"]) and got["b", "title"] == ("error", "no answer", [])


def test_github_and_requests_once(spark):
    entries = entries_of(spark, ("a", {"url": "https://github.com/lee/tool", "title": "T"}), ("b", {"url": "https://github.com/lee/tool"}), ("c", {"title": "A github tool"}))
    asked = R.github_requests(entries).persist()
    rows = {(r["key"], r["mode"]): r["url"] for r in asked.collect()}
    assert rows == {("a", "identifier"): f"{R.GITHUB}repos/lee/tool", ("b", "identifier"): f"{R.GITHUB}repos/lee/tool", ("c", "title"): f"{R.GITHUB}search/repositories?q=A+github+tool&per_page=5"}
    assert R.distinct_requests(asked).count() == 2
    assert R.distinct_requests(asked, asked.filter("key = 'a'")).count() == 1
