"""One captured answer of each source, all read in one run."""

import json

import pytest
from pyspark.sql import functions as F

from refsift.sources.pages import icml_volume, note_authors, note_date, tree, volume_ids
from refsift.sources.payloads import candidates_of, repository

LI = '<ul><li> (2021) <a href="/paper/abc-Abs.html">A <i>Fine</i> Title</a> Ann Lee, Bob Ray and Cy Poe</li></ul>'
DT = '<dt class="ptitle"><br><a href="/x/Lee_Fine_paper.html">A Fine Title</a></dt><dd><input name="query_author" value="Ann Lee"><input name="query_author" value="Bob Ray"></dd>'
ECVA = '<!-- ECCV 2020 --><dt class="ptitle"><a href="a/1.php">Old</a></dt><dd>X Y*</dd><!-- ECCV 2022 --><dt class="ptitle"><a href="a/2.php">A Fine Title</a></dt><dd>Ann Lee*, Bob Ray</dd>'
FEED = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2001.00001v3</id><title>A Fine\n Title</title><author><name>Ann Lee</name></author><published>2020-01-02</published></entry></feed>'
BIB = '@inproceedings{lee-2021, title = "A {Fine} Title", author = "Lee, Ann and Ray, Bob", year = "2021"} @proceedings{p, title = {All}}'
META = '<meta name="citation_title" content="A Fine Title &amp; more"><meta name="citation_author" content="Lee, Ann"><meta content="2020/01/02" name="citation_date"><meta name="citation_doi" content="10.1234/ABC">'
ANSWERS = {
    "datacite": json.dumps({"data": [{"attributes": {"titles": [{"title": "A Fine Title"}], "creators": [{"name": "Lee, Ann"}, {}], "publicationYear": 2020, "publisher": "arXiv", "url": "u", "doi": "10.48550/x"}}]}),
    "openalex": json.dumps({"results": [{"display_name": "Other"}, {"display_name": "A Fine Title", "publication_year": 2020, "authorships": [{"raw_author_name": "Ann Lee"}, {"author": {"display_name": "Bob Ray"}}], "doi": "https://doi.org/10.1234/ABC", "primary_location": {"landing_page_url": "l", "source": {"display_name": "Annals"}}}]}),
    "crossref": json.dumps({"message": {"items": [{"DOI": "10.1234/ABC", "title": ["A Fine Title"], "author": [{"given": "Ann", "family": "Lee"}, {"family": "Ray"}], "published-print": {"date-parts": [[2020, 1]]}, "container-title": ["Annals"], "URL": "u"}]}}),
    "semanticscholar": json.dumps({"data": [{"paperId": "p", "title": "A Fine Title", "authors": [{"name": "Ann Lee"}], "year": 2020, "publicationVenue": {"name": "Annals"}, "externalIds": {"ArXiv": "2001.00001"}}]}),
    "dblp": json.dumps({"result": {"hits": {"hit": {"info": {"title": "A Fine Title", "authors": {"author": {"text": "Ann Lee 0001"}}, "year": "2020", "venue": "Annals", "ee": ["https://doi.org/10.1234/abc"], "key": "k"}}}}}),
    "openreview": json.dumps({"notes": [{"id": "r", "content": {"rating": {"value": 3}}}, {"id": "n", "forum": "f", "pdate": 1577923200000, "content": {"title": {"value": "A Fine Title"}, "authors": {"value": ["Ann Lee"]}, "venue": {"value": "ICLR"}}}]}),
    "github": json.dumps({"name": "tool", "full_name": "lee/tool", "owner": {"login": "lee"}, "created_at": "2020-05-01", "html_url": "h"}),
    "url": META,
    "arxiv": FEED,
    "iclr": LI,
    "neurips": LI,
    "icml": '<div class="paper"><p class="title">A Fine Title</p><p><span class="authors">Ann Lee, Bob Ray</span></p><p><a href="https://x/lee21.html">abs</a></p></div>',
    "cvpr": DT,
    "iccv": DT,
    "eccv": ECVA,
    "jmlr": "<dt>A Fine Title</dt><dd><b><i>Ann Lee, Bob Ray</i></b>; (3):1-9, 2020. [<a href='/papers/v21/19-1.html'>abs</a>]</dd>",
    "acl": BIB,
    "emnlp": BIB,
    "acl_anthology": BIB,
}


@pytest.fixture(scope="module")
def answers(spark):
    rows = [("k", s, "identifier" if s == "github" else "title", "https://example.org/p", body, "A Fine Title", "ICLR", 2022) for s, body in ANSWERS.items()]
    rows += [("k", "eccv", "gone", "", "<html>", "t", "", 1999), ("k", "arxiv", "page", "https://arxiv.org/abs/2001.00001v1", META, "t", "", 2020), ("k", "arxiv", "blank", "https://arxiv.org/abs/1", "", "t", "", 2020)]
    table = spark.createDataFrame(rows, "key string, source string, mode string, url string, body string, title string, venue string, year int")
    return {(r["source"], r["mode"]): r for r in candidates_of(table).collect()}


@pytest.mark.parametrize("source", sorted(ANSWERS))
def test_answers(answers, source):
    row = answers[source, "identifier" if source == "github" else "title"]
    assert row["outcome"] == "ok"
    first = row["candidates"][0]
    assert first["source"] == source
    assert first["title"] in ("A Fine Title", "A {Fine} Title", "A Fine Title & more", "tool")
    assert first["authors"][0] in ("Ann Lee", "Lee, Ann", "lee")
    assert first["year"] in (2020, 2021, 2022)


def test_details(answers):
    of = lambda s, m="title": answers[s, m]["candidates"][0]
    assert of("crossref")["identifier"] == of("openalex")["identifier"] == of("dblp")["identifier"] == of("url")["identifier"] == "10.1234/abc"
    assert of("semanticscholar")["identifier"] == "2001.00001" and of("semanticscholar")["venue"] == "Annals"
    assert (of("openreview")["year"], of("openreview")["identifier"]) == (2020, "f")
    assert (of("arxiv")["arxiv_version"], of("arxiv")["identifier"]) == (3, "2001.00001")
    assert of("eccv")["title"] == "A Fine Title" and of("eccv")["authors"] == ["Ann Lee", "Bob Ray"]
    assert of("iclr")["authors"] == ["Ann Lee", "Bob Ray", "Cy Poe"] and of("iclr")["identifier"] == "abc"
    assert of("jmlr")["url"] == "https://jmlr.org/papers/v21/19-1.html"
    assert of("arxiv", "page")["arxiv_version"] == 1 and of("arxiv", "page")["identifier"] == "2001.00001"
    assert answers["eccv", "gone"]["outcome"] == answers["arxiv", "blank"]["outcome"] == "error"


def test_page_helpers():
    page = '<body><p><a href="1">Ann Lee</a>, <a>Bob Ray*</a>, Cy Poe*</p> — Mar 4, 2024</body>'
    assert note_authors(tree(page)) == ["Ann Lee", "Bob Ray", "Cy Poe"] and note_date(tree(page)) == "Mar 4, 2024"
    events = '<a href="/events/acl-2022">2022</a><a href=/volumes/2022.acl-long/>x</a><a href="/events/acl-2021/">2021</a><a href="/volumes/2021.acl-long/">x</a><a href="/volumes/2021.acl-long/">x</a>'
    assert volume_ids(events, "acl", 2021) == ["2021.acl-long"] and volume_ids(events, "acl", 2020) == []
    assert icml_volume(2015) == 37 and icml_volume(2024) == 235
    assert icml_volume(2030, "<li><a href=v400>Volume 400</a> Proceedings of ICML 2030</li>") == 400
    with pytest.raises(ValueError):
        icml_volume(2031)


def test_repository(spark):
    rows = spark.createDataFrame([(1, ["see https://github.com/features/x", "github.com/lee/tool.git)."]), (2, ["none"])], "i int, v array<string>")
    assert [r["r"] for r in rows.orderBy("i").select(repository(F.col("v")).alias("r")).collect()] == ["lee/tool", ""]
