"""Requests sent: each address once, each host at its own pace, failures as rows.

Requests are dealt by host, so that one task keeps the pace of a host whatever their number, and hosts go on beside each other; within a task a
host that has to wait lets others go first. What comes back is written before it is read again: later steps don't ask anew. A task that is run
again after its executor was lost asks its own hosts again, and nothing else.
"""

from __future__ import annotations

import gzip
import heapq
import time
import zlib
from collections.abc import Iterator
from urllib.error import HTTPError
from urllib.parse import urlsplit
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refsift.plans.requests import distinct_requests
from refsift.shared import stored

AGENT = "refsift/0.1"
#: Answers by which a source says that it lacks something; and those after which it is worth trying again.
ABSENT, BUSY = (404, 410), (408, 425, 429, 500, 502, 503, 504)
FETCHED = pa.schema([("url", pa.string()), ("accept", pa.string()), ("outcome", pa.string()), ("code", pa.int32()), ("body", pa.string()), ("error", pa.string()), ("tries", pa.int32())])
FETCHED_SQL = "url string, accept string, outcome string, code int, body string, error string, tries int"


def headers(accept: str, email: str | None = None, token: str | None = None) -> dict[str, str]:
    said = {"Accept": accept, "Accept-Encoding": "gzip", "User-Agent": f"{AGENT} (mailto:{email})" if email else AGENT}
    return said | ({"From": email} if email else {}) | ({"Authorization": f"Bearer {token}"} if token else {})


def ask(url: str, said: dict[str, str], timeout: float, most_bytes: int) -> tuple[str, int | None, str | None, str | None, float]:
    """Outcome (ok, absent, busy or error), code, body, error, and for how long a busy host wants to be left alone."""
    try:
        with urlopen(Request(url, headers=said), timeout=timeout) as response:
            body = response.read(most_bytes + 1)
            if len(body) <= most_bytes and response.headers.get("Content-Encoding") == "gzip":
                unpack = zlib.decompressobj(16 + zlib.MAX_WBITS)
                body = unpack.decompress(body, most_bytes + 1)
                if not unpack.eof and len(body) <= most_bytes:
                    raise gzip.BadGzipFile("cut short")
            if len(body) > most_bytes:
                return "error", response.status, None, f"over {most_bytes} bytes", 0.0
            return "ok", response.status, body.decode("utf-8", "replace"), None, 0.0
    except HTTPError as e:
        wait = e.headers.get("Retry-After", "") if e.headers else ""
        outcome = "absent" if e.code in ABSENT else "busy" if e.code in BUSY else "error"
        return outcome, e.code, None, f"HTTP {e.code}", float(wait) if wait.isdigit() else 0.0
    except (OSError, ValueError, EOFError, zlib.error) as e:
        return ("error" if isinstance(e, ValueError) else "busy"), None, None, f"{type(e).__name__}: {e}"[:300], 0.0


def _sent(pace: float, tries: int, timeout: float, most_bytes: int, email: str | None, token: str | None, at_once: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(row: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, FETCHED, strict=True)], schema=FETCHED)

        def gone_through(queue: list) -> Iterator[pa.RecordBatch]:
            """queue: (when, number, url, accept, times tried): the one that may go first comes first; a host's next waits for its pace."""
            free: dict[str, float] = {}
            while queue:
                when, number, url, accept, tried = heapq.heappop(queue)
                host = urlsplit(url).netloc.lower()
                ready = max(when, free.get(host, 0.0))
                if ready > max(when, time.monotonic()):
                    heapq.heappush(queue, (ready, number, url, accept, tried))
                    continue
                time.sleep(max(0.0, ready - time.monotonic()))
                outcome, code, body, error, wait = ask(url, headers(accept, email, token), timeout, most_bytes)
                free[host] = time.monotonic() + pace
                if outcome == "busy" and tried + 1 < tries:
                    heapq.heappush(queue, (time.monotonic() + max(wait, pace * 2**tried), number, url, accept, tried + 1))
                else:
                    yield made([url, accept, "error" if outcome == "busy" else outcome, code, body, error, tried + 1])

        held: list = []
        for batch in source:
            for url, accept in zip(batch.column("url").to_pylist(), batch.column("accept").to_pylist(), strict=True):
                heapq.heappush(held, (0.0, len(held), url, accept, 0))
                if len(held) >= at_once:
                    yield from gone_through(held)
                    held = []
        yield from gone_through(held)

    return run


def fetched(requests: DataFrame, held: DataFrame | None = None, pace: float = 1.0, tries: int = 3, timeout: float = 10.0, most_bytes: int = 16 << 20, email: str | None = None, token: str | None = None) -> DataFrame:
    """requests: url and accept, with repeats; held: what has been asked before (url, accept). A row for each address asked: url, accept,
    outcome (ok, absent or error), code, body, error and tries. pace: seconds between a host's requests. What is absent has no error: requests.answers() takes
    url, accept, body and error, and counts an absent page, with no body, as no answer."""
    host = F.lower(F.coalesce(F.try_parse_url(F.col("url"), F.lit("HOST")), F.lit("")))
    dealt = distinct_requests(requests.filter("url IS NOT NULL"), held).withColumn("_host", host).repartition("_host").sortWithinPartitions(F.xxhash64("url")).select("url", "accept")
    return stored(dealt.mapInArrow(_sent(pace, tries, timeout, most_bytes, email, token, 4096), FETCHED_SQL))
