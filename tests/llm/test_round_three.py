"""Hard negatives, the manifest and the removal of repeats against brute force, on small tables."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import documents

from refsift.llm import hard_negatives, merkle, suffix_dedup

# 11. Hard negatives


def vectors(spark, rows):
    held = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return held.withColumns({"at": F.lit("x"), "cell": F.lit(1), "v": F.lit(None).cast("int"), "positives": F.lit(0)})


def negatives_by_force(rows):
    kept = [(i, lab, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, lab in rows if i is not None and lab is not None and v is not None and len(v) == 3 and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, lab, v) in enumerate(kept):
        if i % 3:
            continue
        others = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j, m) for b, (j, m, w) in enumerate(kept) if b != a)
        for s, j, m in [o for o in others if o[2] == lab][:2]:
            found = [o for o in others if o[2] != lab and -s * 80 <= 100 * -o[0] <= 100 * -s][:2]
            out += [(i, j, n + 1, o[1], -s, -o[0]) for n, o in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(4096, 1024, 256), (7, 3, 2)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", blocks[0])
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", blocks[1])
    monkeypatch.setattr(hard_negatives, "SMALL_BLOCK", blocks[2])
    rng = random.Random(4)
    rows = [(rng.randrange(25), [rng.choice([-0.5, 0.0, 0.25, 0.5, 0.75]) for _ in range(3)], rng.randrange(3)) for _ in range(60)]
    rows += [(3, [0.5, 0.5, 0.5], 1)] * 4 + [(None, [1.0, 1.0, 1.0], 0), (6, None, 0), (6, [1.0, None, 0.0], 0), (6, [float("nan"), 0.0, 0.0], 1), (6, [float("inf"), 0.0, 0.0], 1), (9, [0.0, 0.0, 0.0], 2), (12, [1.0, 1.0, 1.0], None), (3, [1.0], 0)]
    scaled = hard_negatives.scaled_rows(vectors(spark, rows), F.col("label"))
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(scaled, F.col("vec_id") % 3 == 0, 2, 2).collect())
    assert got == negatives_by_force(rows) and got


def test_hard_negatives_of_nothing_and_of_large_components(spark):
    empty = hard_negatives.scaled_rows(vectors(spark, []), F.col("label"))
    assert hard_negatives.hard_negatives(empty, F.col("vec_id") % 100 == 0).collect() == []
    big = hard_negatives.scaled_rows(vectors(spark, [(0, [3e38, 1.0], 0), (100, [2.0**20, 1.0], 0), (1, [2.0**20, 0.5], 1), (2, [2.0**20, 2.0], 0)]), F.col("label"))
    got = hard_negatives.hard_negatives(big, F.col("vec_id") % 100 == 0).collect()
    assert [(r["anchor_id"], r["positive_id"], r["negative_id"], r["positive_score"]) for r in got] == [(100, 2, 1, 2**56 + 256 * 512)]


# 12. The manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def manifest_by_force(rows):
    """rows: doc_id, text, lang, source, n_chars."""
    leaf = lambda r, text: H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)])

    def tree(nodes):
        """Root, and for each node the (left, right) of its path."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
            for p, i in zip(paths, at, strict=True):
                p.append(("".join(runs[i // 16][: i % 16]), "".join(runs[i // 16][i % 16 + 1 :])))
            nodes, at = [H(*r) for r in runs], [i // 16 for i in at]
        return nodes[0], paths

    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[3]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in names:
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        made[s] = own, *tree([leaf(r, r[1]) for r in own])
    root, tops = tree([made[s][1] for s in names])
    out = []
    for s, top in zip(names, tops, strict=True):
        own, subroot, paths = made[s]
        for r, path in zip(own, paths, strict=True):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            text = r[1] if not bad or r[1] is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1])
            fold = leaf(r, text)
            for a, b in path + top:
                fold = H(a, fold, b)
            out.append((r[0], leaf(r, r[1]), subroot, root, H(*[a + b for a, b in path + top]), fold, fold == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_manifest_equals_brute_force(spark, monkeypatch, tmp_path, levels):
    monkeypatch.setattr(merkle, "BUCKET_LEVELS", levels)
    rng = random.Random(levels)
    rows = [(rng.randrange(400), rng.choice([None, "", "Ab é", "plain", "X" * 5000]), rng.choice(["en", None]), "hot" if rng.random() < 0.5 else rng.choice([None, "", "ä", "z", "Z"]), rng.choice([None, 3])) for _ in range(560)]
    rows += [(None, "N", None, "hot", 1), (None, None, None, None, None), (7, "Same", "en", "hot", 1), (7, "Same", "en", "hot", 1)] + [(i, "A", "en", f"one{i}", 1) for i in range(20)]
    held = documents(spark, [(1, "x")], extra=False).schema
    data = spark.createDataFrame(rows, held).withColumns({"pos": F.lit("p"), "grp": F.lit(1), "leaf": F.lit(2), "n": F.lit(0)})
    data.write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op12_merkle_manifest(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=str) == manifest_by_force(rows)


@pytest.mark.parametrize("rows", [[], [(5, "One", "en", "s", 3)], [(5, "One", "en", None, 3), (6, "Two", "en", None, 3)]])
def test_manifest_of_few_rows(spark, tmp_path, rows):
    spark.createDataFrame(rows, documents(spark, [(1, "x")], extra=False).schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op12_merkle_manifest(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=str) == (manifest_by_force(rows) if rows else [])


# 13. Repeats


def repeats_by_force(texts, length):
    seen = collections.Counter(b[i : i + length] for _, t in texts for b in [(t or "").encode()] for i in range(len(b) - length + 1))
    out = []
    for d, t in texts:
        b, covered = (t or "").encode(), set()
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                covered.update(range(i, i + length))
        runs = sum(i not in covered or i - 1 not in covered for i in covered)
        out.append((d, len(b), len(covered), runs, hashlib.sha256(bytes(c for i, c in enumerate(b) if i not in covered)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [1, 2, 4, 8, 10, 16])
def test_suffix_order_equals_counts(most):
    rng = random.Random(most)
    for _ in range(60):
        letters = rng.choice([b"ab", b"abc", b"a", b"abcdefgh"])
        texts = [bytes(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(rng.randint(1, 12))]
        seen = collections.Counter(t[i : i + most] for t in texts for i in range(len(t) - most + 1))
        got = suffix_dedup.Collection(texts, most).repeated()
        assert [g.tolist() for g in got] == [[seen[t[i : i + most]] > 1 for i in range(len(t) - most + 1)] for t in texts]


def test_order_and_common_prefixes_of_a_collection(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "WIDTHS", (1,))
    texts = [b"abracadabra", b"abra", b"cab", b"abra"]
    held = suffix_dedup.Collection(texts, 200)
    ends = sorted((t[i:] + bytes([0, k]), t[i - 1] + 1 if i else 0) for k, t in enumerate(texts) for i in range(len(t) + 1))
    values = np.unique(np.frombuffer(b"".join(texts), np.uint8))
    spelled = [int(values[s - 1]) + 1 if s else 0 for s in held.symbols]
    assert spelled == [s for _, s in ends]

    def shared(a, b):
        n = 0
        while a[n] == b[n] and a[n]:
            n += 1
        return n

    assert held.common.tolist() == [0] + [shared(a[0], b[0]) for a, b in zip(ends, ends[1:], strict=False)]


@pytest.mark.parametrize("hot", [4096, 1])
def test_removed_repeats_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HASH_BLOCK", 700)
    monkeypatch.setattr(suffix_dedup, "COLLECTION_BYTES", 3000)
    rng = random.Random(5)
    words = ["alpha", "bêta", "gamma", "dé", "x", "漢字", "\n"]
    make = lambda n: " ".join(rng.choices(words, k=n) + [str(rng.random())])
    passage, other = make(60), make(40)
    texts = [(i, make(rng.randint(0, 30)) + (passage if rng.random() < 0.4 else other[: rng.randint(1, 200)] if rng.random() < 0.3 else "") + make(rng.randint(0, 80))) for i in range(60)]
    texts += [(3, texts[3][1]), (3, texts[3][1]), (None, texts[4][1]), (70, None), (71, None), (72, ""), (73, "a" * 1500), (74, "ab" * 120), (75, "a" * 199), (76, "b" * 200), (77, "b" * 200), (78, "q" * 201)]
    got = suffix_dedup.removed_repeats(documents(spark, texts).withColumns({"d": F.lit(1), "gram": F.lit("g")}), hot_pieces=hot).collect()
    assert sorted((tuple(r) for r in got), key=str) == repeats_by_force(texts, 200)


def test_removed_repeats_of_nothing(spark):
    assert suffix_dedup.removed_repeats(documents(spark, [])).collect() == []
    with pytest.raises(ValueError):
        suffix_dedup.removed_repeats(documents(spark, []), length=10)


# 7. Tiles of buckets


def test_rows_dealt_follow_the_bucket(spark, monkeypatch):
    """One outsider in a bucket of one large class: twice the nodes, about twice the rows dealt."""
    from refsift.llm import near_dedup

    seen = []
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 64)
    run = near_dedup._active
    monkeypatch.setattr(near_dedup, "_active", lambda source: (b for b in run(source)))
    for n in (2000, 4000):
        node = lambda i: F.unhex(F.lpad(F.hex(i), 8, "0"))
        members = spark.range(n).select(F.lit(0).alias("band"), F.lit(7).cast("long").alias("key"), node(F.col("id")).alias("node"))
        labels = spark.range(1, n - 1).select(node(F.col("id")).alias("node"), node(F.lit(0)).alias("component"))
        signature = spark.range(n).select(node(F.col("id")).alias("node"), F.unhex(F.repeat(F.lpad(F.hex(F.col("id")), 8, "0"), F.lit(128))).alias("signature"))
        texts = spark.range(n).select(node(F.col("id")).alias("node"), F.lit("a b c d e f").alias("text"))
        count = spark.sparkContext.accumulator(0)

        def counting(source, count=count):
            for batch in source:
                count.add(batch.num_rows)
                yield from run(iter([batch]))

        monkeypatch.setattr(near_dedup, "_active", counting)
        near_dedup.remaining_links(members, labels, signature, texts, 0.8).collect()
        seen.append(count.value)
    assert seen[0] <= 3 * 2000 and seen[1] <= 2.2 * seen[0]
