"""Requests sent to a server on this machine; includes followed by doubling; volumes on an index page."""

import collections
import gzip
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from refsift.operators.entries import entry_columns
from refsift.plans import requests as R
from refsift.plans.fetch import fetched
from refsift.schema import ENTRIES_DDL
from refsift.sources.latex import closure, reached


@pytest.fixture
def server():
    asked = collections.Counter()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked[self.path, self.headers["Accept"]] += 1
            kind = self.path.strip("/").split("/")[0]
            code = {"missing": 404, "down": 503, "no": 403}.get(kind, 503 if kind == "flaky" and asked[self.path, self.headers["Accept"]] == 1 else 200)
            body = b"x" * 5000 if kind == "long" else f"body of {self.path}".encode()
            packed = kind == "packed"
            body = gzip.compress(body) if packed else body
            self.send_response(code)
            if packed:
                self.send_header("Content-Encoding", "gzip")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    own = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{own.server_port}", f"http://localhost:{own.server_port}", asked
    own.shutdown()


def test_each_address_is_asked_once_and_failures_are_rows(spark, server):
    one, two, asked = server
    paths = ["/a", "/packed/b", "/missing/c", "/down/d", "/flaky/e", "/no/f", "/long/g", "/held"]
    rows = [(f"{host}{p}", "text/html") for host in (one, two) for p in paths] * 3 + [(f"{one}/a", "application/json"), ("http://127.0.0.1:1/closed", "x"), ("no address", "x"), (None, "x")]
    requests = spark.createDataFrame(rows, "url string, accept string").repartition(4)
    held = spark.createDataFrame([(f"{one}/held", "text/html"), (f"{two}/held", "text/html")], "url string, accept string")
    answers = fetched(requests, held, pace=0.01, tries=2, timeout=5, most_bytes=1000)
    got = {(r["url"], r["accept"]): r for r in answers.collect()}
    assert answers.count() == len(got) == 2 * 7 + 3
    at = lambda p, host=one: got[f"{host}{p}", "text/html"]
    for host in (one, two):
        assert (at("/a", host)["outcome"], at("/a", host)["body"]) == ("ok", "body of /a") and at("/packed/b", host)["body"] == "body of /packed/b"
        assert (at("/missing/c", host)["outcome"], at("/missing/c", host)["tries"]) == ("absent", 1)
        assert (at("/down/d", host)["outcome"], at("/down/d", host)["code"], at("/down/d", host)["tries"]) == ("error", 503, 2)
        assert at("/flaky/e", host)["outcome"] == "ok"
        assert (at("/no/f", host)["outcome"], at("/no/f", host)["tries"]) == ("error", 1) and at("/long/g", host)["error"] == "over 1000 bytes"
    assert at("/flaky/e", one)["tries"] + at("/flaky/e", two)["tries"] == 3  # the first of both is refused
    assert got["http://127.0.0.1:1/closed", "x"]["outcome"] == "error" and got["no address", "x"]["outcome"] == "error"
    # Both names are one server here: two askings of each path, twice where it was tried again; nothing of what was held.
    assert asked["/a", "text/html"] == 2 and asked["/a", "application/json"] == 1 and asked["/down/d", "text/html"] == 4 and not any("held" in p for p, _ in asked)


def test_a_chain_of_a_thousand_files_and_many_roots(spark, monkeypatch):
    from refsift.sources import latex

    rounds, run = [], latex.stored
    monkeypatch.setattr(latex, "stored", lambda df: (rounds.append(1), run(df))[1])
    chain = [(f"c{i:04}", f"c{i + 1:04}") for i in range(1000)]
    edges = spark.createDataFrame([*chain, ("r", "s"), ("s", "t"), ("t", "r"), ("t", "t"), ("c0990", "r")], "a string, b string")
    roots = spark.createDataFrame([("c0000",), ("c0995",), ("s",), ("alone",), ("s",)], "node string")
    got = collections.defaultdict(set)
    for r in reached(edges, roots).collect():
        assert r["node"] not in got[r["root"]]
        got[r["root"]].add(r["node"])
    assert got["c0000"] == {f"c{i:04}" for i in range(1001)} | {"r", "s", "t"}
    assert got["c0995"] == {f"c{i:04}" for i in range(995, 1001)} and got["s"] == {"r", "s", "t"} and got["alone"] == {"alone"}
    assert len(rounds) <= 2 * 12 + 2
    assert closure(edges, roots.filter("node = 's'")).count() == 3 and closure(edges, roots.filter("node = 'x'")).count() == 0


def test_years_that_only_the_index_page_knows(spark):
    rows = [("old", {"title": "T", "year": "2021"}), ("new", {"title": "T", "year": "2027"}), ("none", {"title": "T", "year": "1950"})]
    entries = entry_columns(spark.createDataFrame([(k, "article", f) for k, f in rows], ENTRIES_DDL))
    assert [tuple(r) for r in R.icml_index_requests(entries).collect()] == [(R.ICML_INDEX, R.HTML)]
    assert R.icml_index_requests(entries.filter("key = 'old'")).count() == 0
    index = '<ul><li><a href="v300"><b>Volume 300</b></a> Proceedings of ICML 2027</li><li><a href="v290">V</a> International Conference on Machine Learning, 2026</li></ul>'
    volumes = R.icml_volumes(entries, spark.createDataFrame([(index,)], "body string"))
    assert {r["year"]: r["volume"] for r in volumes.collect()} == {2021: 139, 2020: 119, 2027: 300, 2026: 290}
    assert R.icml_volumes(entries, spark.createDataFrame([], "body string")).count() == 2
    asked = {(r["key"], r["step"]): r["url"] for r in R.icml_requests(entries, volumes).collect()}
    assert asked == {("old", 0): f"{R.ICML_VOLUME_PAGES}139/", ("old", 1): f"{R.ICML_VOLUME_PAGES}119/", ("new", 0): f"{R.ICML_VOLUME_PAGES}300/", ("new", 1): f"{R.ICML_VOLUME_PAGES}290/"}
