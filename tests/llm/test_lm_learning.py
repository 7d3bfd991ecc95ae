"""How the language model learns."""

import types

import numpy as np
import pyarrow as pa

from refsift.llm import lm_score


def test_every_training_position_learns(monkeypatch):
    texts = [b"a b c", b"", b"b b a d e f g h i"] * 40
    tokens = sum(len(t.split()) + 1 for t in texts)
    words = sorted({w for t in texts for w in t.split()})
    own = lm_score.Vocabulary([(w, 64 + lm_score.tail_class(w), 9) for w in words], len(texts))
    source = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.binary())], ["doc_id", "text"])
    fresh = lambda: lm_score.MaxEnt(np.ones((lm_score.N_CLASSES, lm_score.CLASS_WORDS)))
    learnt, learn = [], lm_score.Learner.learn
    monkeypatch.setattr(lm_score.Learner, "learn", lambda self, target, *rest: (learnt.append(len(target)), learn(self, target, *rest)))
    out = [r for b in lm_score._learned(iter([source]), types.SimpleNamespace(value=own), fresh) for r in b.to_pylist()]
    assert sum(learnt) == tokens and {r["part"] for r in out} == {0, 1, 2, 3}


def test_repeated_rows_get_all_their_gradients():
    rng = np.random.default_rng(3)
    learner = lm_score.Learner(lm_score.MaxEnt(np.ones((lm_score.N_CLASSES, lm_score.CLASS_WORDS))))
    rows, gradient = np.minimum(rng.zipf(1.3, (4, 700)), 400), rng.normal(size=(10, 700)).astype(np.float32)
    learner._step(0, rows, gradient)
    want, energy = np.zeros((401, 10)), np.full(401, 1e-3)
    for each in rows:
        np.add.at(want, each, gradient.T.astype(float))
        np.add.at(energy, each, (gradient.astype(float) ** 2).sum(axis=0))
    want *= -lm_score.RATE / np.sqrt(energy)[:, None]
    assert np.allclose(learner.model.weights[0][:401], want, atol=1e-3) and np.allclose(learner.energy[0][:401], energy, rtol=1e-4)


def test_tail_words_follow_their_context():
    own = lm_score.Vocabulary([], 1)
    model = lm_score.MaxEnt(np.ones((lm_score.N_CLASSES, lm_score.CLASS_WORDS)))
    learner = lm_score.Learner(model)
    seen = lm_score.Texts([b"a 1xyz", b"b 2xyz"] * 20, own)
    for _ in range(10):
        learner.learn(seen.target, seen.in_class, seen.features)
    assert lm_score.tail_class(b"1xyz") == lm_score.tail_class(b"2xyz")
    logs = [model.log10(lm_score.Texts([t], own))[1] for t in (b"a 1xyz", b"a 2xyz", b"b 2xyz", b"b 1xyz")]
    assert logs[0] > logs[1] + 0.5 and logs[2] > logs[3] + 0.5


def test_all_features_reach_all_levels_and_leaves_sum_to_one():
    rng = np.random.default_rng(5)
    mass = rng.integers(1, 4, (lm_score.N_CLASSES, lm_score.CLASS_WORDS)).astype(float)
    mass[lm_score.END_CLASS] = [7] + [0] * (lm_score.CLASS_WORDS - 1)
    model = lm_score.MaxEnt(mass, (500, 64))
    for table in model.weights:
        table += rng.normal(size=table.shape).astype(np.float32)
    features = lm_score.Texts([b"u v w x"], lm_score.Vocabulary([], 1)).features[:, [3]]
    assert len(features) == 4 and all(len(model.at(level, model.hashed(features), np.zeros(1, np.int64))) == 4 for level in range(4))
    whole = 0.0
    for c in range(lm_score.N_CLASSES):
        for at in [-1] if c == lm_score.END_CLASS else range(lm_score.CLASS_WORDS):
            logs = 0.0
            for level, (node, child, where) in enumerate(lm_score.paths(np.array([c]), np.array([at]))):
                if len(node):
                    # One position, read child by child with plain loops.
                    rows = [((int(f) if level < 2 else int(f) >> 32) & 0xFFFFFFFF) * model.rows[level] >> 32 for f in features[:, 0]]
                    z = [float(model.bias[level][node[0]][k]) + sum(float(model.weights[level][r * len(model.bias[level]) + node[0]][k]) for r in rows) for k in range(lm_score.WIDTHS[level])]
                    top = max(z)
                    share = np.exp(z[child[0]] - top) / sum(np.exp(x - top) for x in z)
                    got = model.shares(level, model.at(level, model.hashed(features), node), node)[child[0], 0]
                    assert abs(got - share) < 1e-5
                    logs += np.log(max(share, 1e-300))
            whole += np.exp(logs)
    assert abs(whole - 1) < 1e-4


def test_cells_of_columns(spark):
    words = [b"a", b"", b"xyz", b"longer", "été".encode(), b"\xff\x00q"]
    rows = spark.createDataFrame([(bytearray(w), 64 + lm_score.tail_class(w)) for w in words], "word binary, tail int")
    got = {bytes(r["word"]): r["cell"] for r in rows.select("word", lm_score._cell().alias("cell")).collect()}
    assert got == {w: lm_score.tail_cell(w) for w in words}


def test_class_rows_follow_the_words():
    sizes = [lm_score.class_rows(v) for v in (0, 404_216, 10**9)]
    assert sizes[0] == lm_score.CLASS_BUCKETS < sizes[1] < sizes[2] == lm_score.MOST_BUCKETS
    assert [lm_score.word_rows(v) for v in (0, 400_000, 10**9)] == [lm_score.WORD_BUCKETS, 782, lm_score.MOST_WORD_BUCKETS]
    model = lm_score.MaxEnt(np.ones((lm_score.N_CLASSES, lm_score.CLASS_WORDS)), (sizes[1], 600))
    features = np.random.default_rng(1).integers(0, 2**63, (4, 20_000)).astype(np.uint64)
    assert lm_score.CLASS_BUCKETS < model.at(0, model.hashed(features), 0).max() < sizes[1] == len(model.weights[0]) == len(lm_score.Learner(model).energy[0])


def test_learners_follow_the_tokens():
    assert [lm_score.learners(n) for n in (0, 1, 9_000_001, 10**12)] == [1, 1, 2, lm_score.LEARNERS]


def test_words_are_those_of_bytes():
    texts = [b"", b" \x0b", b"A\xff\x1c b\x00 ", b"\x0c\x09\x0d\x0a x", b"Two  two", b"", b"last"]
    words, each = lm_score.words_of(texts)
    assert words.to_pylist() == lm_score.bytes_of(words) == [w for t in texts for w in t.lower().split()]
    assert each.tolist() == [len(t.split()) for t in texts] and [len(x) for x in lm_score.words_of([])] == [0, 0]
    assert lm_score.bytes_of(words.slice(2, 2)) == words.to_pylist()[2:4] and lm_score.bytes_of(words[:0]) == []


def test_a_dictionary_is_asked_once_for_each_word():
    class Asked(dict):
        n = 0

        def get(self, *a):
            self.n += 1
            return super().get(*a)

    own = lm_score.Vocabulary([(b"a", 64, 9), (b"b", 64, 9)], 1)
    own.words = Asked(own.words)
    texts = lm_score.Texts([b"a b c a C", b"", b"d a b b c"] * 50, own)
    assert own.words.n == 4 and texts.new == {b"c": 2, b"d": 3} and texts.first[:4] == [0, 6, 7, 13]
    assert texts.number[:13].tolist() == [0, 1, 2, 0, 2, -1, -1, 3, 0, 1, 1, 2, -1]


def test_frequent_words_come_without_rows(spark, monkeypatch):
    words = [b"w%d" % i for i in range(3000)] + [b"\xff", "été".encode()]
    texts = spark.createDataFrame([(bytearray(b" ".join(words[i : i + 50]) + b" w1 w1"),) for i in range(0, len(words), 50)], "text binary")
    counts = lm_score.word_counts(texts)
    whole = {bytes(r["word"]): (r["tail"], r["n"]) for r in counts.collect()}
    each = len(range(0, len(words), 50))
    assert whole == {w: (64 + lm_score.tail_class(w), 1 + 2 * each * (w == b"w1")) for w in words} | {lm_score.END: (lm_score.END_CLASS, each)}
    collect = type(counts).collect
    monkeypatch.setattr(type(counts), "collect", lambda self: r if len(r := collect(self)) < 1000 else 1 / 0)
    got = lm_score.frequent(counts, 10_000)
    assert got[0] == (b"w1", whole[b"w1"][0], 1 + 2 * each) and [w for w, *_ in got[1:]] == sorted(set(words) - {b"w1"}) and lm_score.frequent(counts, 1) == got[:1]
