"""What the second round changed."""

import base64
import collections
import json
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import classes_by_force, documents

from refsift.llm import ann, decontaminate, near_dedup, pii, quality, secret_scan


@pytest.mark.parametrize("large", [1, 1024])
def test_every_document_has_a_row_with_its_own_class(spark, monkeypatch, large):
    monkeypatch.setattr(near_dedup, "LARGE_CLASS", large)
    text = " ".join(f"w{i}" for i in range(50))
    other = " ".join(f"v{i}" for i in range(50))
    texts = [(5, text), (5, other), (None, "alone one two three four five"), (None, "other one two three four six"), (None, None), (7, text)]
    got = near_dedup.duplicate_classes(documents(spark, texts)).collect()
    assert sorted((r["doc_id"] or -1, r["class_id"] or -1, r["class_size"]) for r in got) == [(-1, -1, 1), (-1, -1, 1), (-1, -1, 1), (5, 5, 1), (5, 5, 2), (7, 5, 2)]


def test_tiles_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 7)
    rng = random.Random(8)
    base = " ".join(f"w{i}" for i in range(150)).split()
    texts = []
    for i in range(120):  # one bucket or a few of many nodes, of which few are linked to the smallest
        w = list(base)
        for _ in range(rng.randint(2, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        texts.append((i, " ".join(w)))
    got = collections.defaultdict(list)
    for r in near_dedup.duplicate_classes(documents(spark, texts)).collect():
        got[r["component"]].append(r["doc_id"])
    assert sorted(sorted(m) for m in got.values()) == classes_by_force(texts)


@pytest.mark.parametrize("share", [0.5, 0.6, 1.0])
def test_shards_give_what_one_index_gives(spark, monkeypatch, share):
    rng = random.Random(2)
    words = [f"t{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(8, 20))) + "? " + " ".join(rng.choices(words, k=4))) for i in range(30)] + [(3, "same item of words here. yes it is")] * 3 + [(None, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    part = lambda t: " ".join(t.split()[: max(1, int(len(t.split()) * share))])
    docs = documents(spark, [(i, "before " + part(t or "") + " after") for i, (_, t) in enumerate(items)])
    hits = lambda: sorted((r["doc_id"], -1 if r["item_id"] is None else r["item_id"], round(r["score"], 9)) for r in decontaminate.contaminated(docs, bench).collect())
    one = hits()
    monkeypatch.setattr(decontaminate, "SHARD_ITEMS", 4)
    assert hits() == one and (one or share < 1)


# PII and secrets


def test_many_spans_in_one_text(spark):
    text = " ".join(f"u{i}@ex{i % 7}.org" for i in range(3000)) + " +49 170 1234567, 10.0.0.1"
    docs = documents(spark, [(1, text), (2, text[:900]), (3, None)])
    found = {r["doc_id"]: r["spans"] for r in pii.find_pii(docs).collect()}
    want = [m.span() for m in re.finditer(r"\S+@\S+", text)]
    assert [(s["start"], s["end"]) for s in found[1] if s["kind"] == "email"] == want and not found[3]
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert clean[1] == " ".join(["<EMAIL>"] * 3000) + " <PHONE>, <IP>" and clean[3] in (None, "")


def test_overlapping_spans_become_one(spark):
    text = "a 4111 1111 1111 1111@x.org b 10.0.0.1@y.org"
    out = pii.redact(documents(spark, [(1, text)])).first()["text"]
    spans = sorted((s["start"], -s["end"], s["kind"]) for s in pii.find_pii(documents(spark, [(1, text)])).first()["spans"])
    want, at = "", 0
    for start, minus, kind in spans:
        if start >= at:
            want += text[at:start] + f"<{kind.upper()}>"
        at = max(at, -minus)
    assert out == want + text[at:]


def _b64(raw, url=False):
    return (base64.urlsafe_b64encode if url else base64.b64encode)(raw).decode().rstrip("=")


def test_secrets_behind_other_text():
    token = f'{_b64(json.dumps({"alg": "HS256"}).encode(), True)}.{_b64(b'{"sub":"1234567"}', True)}.{_b64(b"s" * 32, True)}'
    for before in ("authorization.", "a.b.c.", "token-", "x_", "=", ""):
        text = f"see {before}{token} end"
        assert ("jwt", 4 + len(before), 4 + len(before) + len(token)) in secret_scan.scan(text), before
    part = lambda tag, body: bytes([tag, len(body)]) + body
    der = b"\x02\x01\x00" + b"".join(part(2, bytes([1 + i]) * 12) for i in range(8))
    der = b"\x30\x81" + bytes([len(der)]) + der if len(der) > 127 else b"\x30" + bytes([len(der)]) + der
    key = _b64(der)
    for before in ("", "certs/", "a+b/certs/"):
        text = f"in {before}{key} end"
        assert ("der_key", 3 + len(before), 3 + len(before) + len(key)) in secret_scan.scan(text), before
    wrapped = base64.b64encode(der).decode()
    for body in (f"\n{wrapped}\n", f"\\n{wrapped[:40]}\\n{wrapped[40:]}\\n", f"\nComment: mine\n\n{wrapped}\n", "\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00\n\n" + base64.b64encode(b"q" * 64).decode() + "\n"):
        text = f"-----BEGIN RSA PRIVATE KEY-----{body}-----END RSA PRIVATE KEY-----"
        assert ("pem_key", 0, len(text)) in secret_scan.scan(text), body
    assert not [s for s in secret_scan.scan("-----BEGIN RSA PRIVATE KEY-----\nnot a key\n-----END RSA PRIVATE KEY----- " * 50) if s[0] == "pem_key"]
    assert not [s for s in secret_scan.scan("word.another.thirdword " + "/M/M/M" * 2000 + "eyJ" * 500 + ".x.y") if s[0] in ("jwt", "der_key")]


# Nearest neighbours and quality


def test_rows_of_one_id_are_candidates_to_each_other(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(60, 8)).tolist()
    ids = [0, 0, 0, *range(1, 58)]
    rows = spark.createDataFrame(list(zip(ids, vectors, strict=True)), "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.search(ann.vectors(rows), F.col("vec_id") % 20 == 0, 5).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], round(r["score"], 9)))
    x = np.array(vectors)
    want = collections.defaultdict(list)
    for q in (i for i, v in enumerate(ids) if v % 20 == 0):
        order = sorted((-float(x[q] @ x[c]), ids[c]) for c in range(60) if c != q)[:5]
        want[ids[q]] += [(n, v, round(-s, 9)) for n, (s, v) in enumerate(order, 1)]
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_quality_scores_equal_plain_arithmetic(spark):
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choices(["good", "words", "here"], k=30)) if i % 2 else "!!! " * rng.randint(1, 60)) for i in range(400)] + [(None, None), (400, "long " * 60_000), (401, "")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    docs = documents(spark, texts)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["score"], r["predicted"]) for r in quality.classify(docs, labels).collect())
    # The same model by one least-squares solution over all training rows, and pooled adjacent violators in a loop.
    fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % quality.FOLDS
    stats = {i: np.array(quality.statistics((t or "").encode())) for i, t in texts}
    known = [i for i in range(400) if fold(i) != quality.HELD_FOLD]
    fit, held = [i for i in known if fold(i) != quality.CALIBRATION_FOLD], [i for i in known if fold(i) == quality.CALIBRATION_FOLD]
    x, y = np.array([stats[i] for i in fit]), np.array([i % 2 for i in fit], float)
    model = quality.Model(x.mean(0), x.std(0) + 1e-6, np.zeros(quality.FEATURES + 1), np.zeros(quality.BINS), 0.5)
    z = model.features(x)
    ridge = math.sqrt(len(fit) * quality.RIDGE / quality.FEATURES) * np.eye(z.shape[1])
    model.weights = np.linalg.lstsq(np.vstack([z, ridge]), np.concatenate([y, np.zeros(z.shape[1])]), rcond=None)[0]
    at = model.bins(model.raw(np.array([stats[i] for i in held])))
    pools = [[float((at == b).sum()), float(sum(i % 2 for i, a in zip(held, at, strict=True) if a == b)), 1] for b in range(quality.BINS)]
    model.raised = quality.isotonic(np.array([p[0] for p in pools]), np.array([p[1] for p in pools]))
    want = sorted((i is None, i or 0, float(model.score(stats[i][None])[0])) for i, _ in texts)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=0.02)
    assert all(g[3] == (g[2] >= 0.3) for g in got)
    kept = {r["doc_id"] for r in quality.accepted(docs, labels).collect()}
    assert kept == {None if g[0] else g[1] for g in got if g[3]}
