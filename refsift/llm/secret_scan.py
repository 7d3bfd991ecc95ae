"""Secret scan with structural confirmation.

Three plain patterns give the base spans: assignments to secret-like names, access key ids and
long hex runs. Every long run of base64 or hex characters is then decoded, and reported where the
bytes have a secret's structure: a DER private key whose nested lengths add up, an OpenSSH key
whose length-prefixed fields do, a signed token whose header and payload are JSON objects and
whose header names an algorithm. Armoured private keys are reported when their body passes.

Plan: no shuffle; one pass over the scan's partitions, one batch of texts in memory. One linear
regular expression finds long runs; everything dearer runs on those alone.

Cases: null texts are empty; an empty text has no spans; null or repeated doc_ids are kept as rows
of their own; other columns are ignored. Spans of one kind never overlap; those of different kinds
may. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refsift.llm.common import batches, table, text_rows

BASE_KINDS = ("assign", "access", "hex")
ADDED_KINDS = ("jwt", "der_key", "ssh_key", "pem_key")
KINDS = BASE_KINDS + ADDED_KINDS

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ASSIGN_HINTS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=.-]{24,}")
_HEADER, _PAYLOAD, _SIGNATURE = re.compile(r"[A-Za-z0-9_-]{8,}$"), re.compile(r"[A-Za-z0-9_-]{8,}"), re.compile(r"[A-Za-z0-9_-]*")
#: How a JSON object, a DER sequence and an OpenSSH key start in base64.
_OBJECT, _KEY_START = re.compile("eyJ"), re.compile(r"(?<=[+/_=.-])(?:M(?=[A-P])|b3BlbnNzaC1rZXktdjEA)")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{32,}={0,2}")
_ANY_HEX = re.compile(r"[0-9a-f]{32,}|[0-9A-F]{32,}")
_ARMOUR = re.compile(r"-----BEGIN ([A-Z ]{0,20}PRIVATE KEY)-----")
_ARMOUR_HEADER = re.compile(r"\s*([A-Za-z-]+):([^\n]*)(?:\n|$)")


def decode64(text: str) -> bytes | None:
    """Standard or URL-safe base64, with or without its padding; null if it is neither."""
    bare = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(bare) % 4 == 1:
        return None
    try:
        return base64.b64decode(bare + "=" * (-len(bare) % 4), validate=True)
    except binascii.Error:
        return None


def _element(data: bytes, at: int, stop: int) -> tuple[int, int, int] | None:
    """The tag of a DER element and where its content starts and ends; null if it doesn't fit."""
    if at + 2 > stop:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size >= 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > stop or not data[at]:
            return None
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if size < 0x80:
            return None
    return (tag, at, at + size) if at + size <= stop else None


def _elements(data: bytes, at: int, stop: int, depth: int = 0) -> list[tuple[int, int, int]] | None:
    """All elements between at and stop, if they fill it exactly and so do those nested in sequences."""
    found = []
    while at < stop:
        e = _element(data, at, stop)
        if e is None or depth > 16 or e[0] == 0x30 and _elements(data, e[1], e[2], depth + 1) is None:
            return None
        found.append(e)
        at = e[2]
    return found


def is_der_key(data: bytes) -> bool:
    """RSA, EC or PKCS#8 private key: a sequence of a small version number and key parts, all lengths right."""
    top = _element(data, 0, len(data)) if data[:1] == b"\x30" else None
    if top is None or top[2] != len(data) or len(data) < 32:
        return False
    parts = _elements(data, top[1], top[2])
    if not parts or len(parts) < 2 or parts[0][0] != 0x02 or parts[0][2] - parts[0][1] != 1:
        return False
    version, tags = data[parts[0][1]], [p[0] for p in parts]
    rsa = version == 0 and len(tags) >= 9 and set(tags[:9]) == {0x02}
    ec = version == 1 and tags[1] == 0x04 and parts[1][2] - parts[1][1] >= 16
    pkcs8 = version in (0, 1) and len(tags) >= 3 and tags[1:3] == [0x30, 0x04] and data[parts[1][1] : parts[1][1] + 1] == b"\x06"
    return rsa or ec or pkcs8


def is_ssh_key(data: bytes) -> bool:
    """OpenSSH private key: magic, three strings, a key count, and that many public parts and one private part."""
    magic = b"openssh-key-v1\x00"
    if not data.startswith(magic):
        return False
    at, strings = len(magic), 0
    want = 3
    while strings < want:
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        if at > len(data):
            return False
        strings += 1
        if strings == 3 and want == 3:
            if at + 4 > len(data):
                return False
            keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
            if not 1 <= keys <= 16:
                return False
            want += keys + 1
    return at == len(data)


def is_signed_token(text: str) -> bool:
    """Three dotted parts, the first two JSON objects, the first with an algorithm; unsigned ones have an empty third."""
    parts = text.split(".")
    if len(parts) != 3:
        return False
    objects = []
    for part in parts[:2]:
        raw = decode64(part)
        try:
            objects.append(json.loads(raw or b""))
        except (ValueError, RecursionError):
            return False
    if not all(isinstance(x, dict) for x in objects) or not isinstance(objects[0].get("alg"), str):
        return False
    return bool(parts[2]) and decode64(parts[2]) is not None or objects[0]["alg"].lower() == "none"


def _key_kind(data: bytes | None) -> str | None:
    if not data:
        return None
    return "der_key" if is_der_key(data) else "ssh_key" if is_ssh_key(data) else None


def _tokens(run: str) -> Iterator[tuple[int, int]]:
    """Signed tokens of a run. Any three dotted parts in a row may be one; what stands before a header in its part
    (a word and a dash, say) isn't of it, so the part is also tried from each place where an object may start."""
    dots = [-1, *(m.start() for m in re.finditer(r"\.", run)), len(run)]
    i = 0
    while i + 3 < len(dots):
        header = _HEADER.search(run, dots[i] + 1, dots[i + 1])
        if header and _PAYLOAD.fullmatch(run, dots[i + 1] + 1, dots[i + 2]):
            end = _SIGNATURE.match(run, dots[i + 2] + 1, dots[i + 3]).end()
            starts = [header.start(), *(m.start() for m in _OBJECT.finditer(run, header.start() + 1, dots[i + 1]))]
            if (start := next((x for x in starts if is_signed_token(run[x:end])), None)) is not None:
                yield start, end
                i += 2  # the third part is taken
        i += 1


def _embedded_keys(run: str) -> Iterator[tuple[str, int, int]]:
    """Keys that start inside a base64 run, behind a character that may also be part of a path; their own lengths say where they end."""
    done = 0
    for m in _KEY_START.finditer(run):
        if m.start() < done:
            continue
        rest = run[m.start() :] if m[0] != "M" else run[m.start() : m.start() + _der_chars(run[m.start() : m.start() + 12])]
        if kind := _key_kind(decode64(rest)):
            done = m.start() + len(rest)
            yield kind, m.start(), done


def _der_chars(start: str) -> int:
    """How many base64 characters a DER element takes, padding apart, by its first bytes."""
    data = decode64(start[: len(start) // 4 * 4])
    if not data or len(data) < 6:
        return 0
    n = data[1] & 0x7F if data[1] >= 0x80 else 0
    size = int.from_bytes(data[2 : 2 + n], "big") + 2 + n if 0 < n <= 4 else data[1] + 2 if not n else 0
    return -(-size * 4 // 3)


def _armoured(text: str) -> Iterator[tuple[int, int]]:
    """Armoured private keys whose body passes: line ends may be escaped, headers may stand before it. An encrypted
    body has no structure of its own; it passes if its headers say so and it fills whole cipher blocks."""
    for m in _ARMOUR.finditer(text):
        following = text.find("-----BEGIN ", m.end())
        mark = f"-----END {m[1]}-----"
        end = text.find(mark, m.end(), following if following >= 0 else len(text))
        if end < 0:
            continue
        body, headers = text[m.end() : end].replace("\\r", "").replace("\\n", "\n"), {}
        while header := _ARMOUR_HEADER.match(body):
            headers[header[1]] = header[2]
            body = body[header.end() :]
        data = decode64("".join(body.split()))
        locked = "ENCRYPTED" in headers.get("Proc-Type", "") and "DEK-Info" in headers
        if _key_kind(data) or locked and data and len(data) >= 32 and len(data) % 8 == 0:
            yield m.start(), end + len(mark)


def scan(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text, by start, then kind as KINDS lists them."""
    found: list[tuple[int, int, int]] = []
    add = lambda kind, start, end: found.append((start, KINDS.index(kind), end))
    low = text.lower()
    if any(hint in low for hint in _ASSIGN_HINTS):
        for m in _ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                add("assign", m.start(), m.end())
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if m.end() - m.start() >= 20:
                add("access", m.start(), m.end())
    for run in _RUN.finditer(text):
        at, value = run.start(), run[0]
        for m in _HEX.finditer(value):
            add("hex", at + m.start(), at + m.end())
        for start, end in _tokens(value) if "." in value else ():
            add("jwt", at + start, at + end)
        for m in _BASE64.finditer(value):
            if kind := _key_kind(decode64(m[0])):
                add(kind, at + m.start(), at + m.end())
            else:
                for kind, start, end in _embedded_keys(m[0]):
                    add(kind, at + m.start() + start, at + m.start() + end)
        for m in _ANY_HEX.finditer(value):
            if len(m[0]) % 2 == 0 and (kind := _key_kind(bytes.fromhex(m[0]))):
                add(kind, at + m.start(), at + m.end())
    if "-----BEGIN " in text:
        for start, end in _armoured(text):
            add("pem_key", start, end)
    return [(KINDS[k], start, end) for start, k, end in sorted(set(found))]


_SPANS = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])
_SPANS_DDL = "doc_id long, spans array<struct<kind string, start long, end long>>"


def _scan_batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = ("kind", "start", "end")
    for batch in source:
        rows = ((d, [dict(zip(keys, s, strict=True)) for s in scan(t)]) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        yield from batches(rows, _SPANS)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end) of every row, by start, then kind."""
    return text_rows(docs).mapInArrow(_scan_batches, _SPANS_DDL)


def spans_text(spans: Column) -> Column:
    """`kind:start:end`, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(spans_text(F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )
