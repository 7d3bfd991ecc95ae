"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax, and a unigram base.

A token's probability is that of its class, given the words before it, times its own within the class.
Classes are runs of CLASS_WORDS words of like frequency for the HEAD_CLASSES * CLASS_WORDS most
frequent words, one class for the end of a text, and TAIL_CLASSES classes of all other words, by a
hash of their last bytes. A tail class is dealt into CLASS_WORDS cells by a hash of the word, which are told apart as
the words of a head class are; within a cell a word's probability is its smoothed share of the cell's training tokens. One
unseen type per cell takes the rest, so the whole sums to one. Both the choice of a class and that of a word are taken in
two steps, of a run and of one in it, so that a token costs four softmaxes of at most ten outcomes. Each adds
weights of hashed features of the context: the previous word, the two before (a bigram), the one before that (a
skip), and the endings of both.

The weights are trained by distributed gradient updates: each of up to LEARNERS partitions, one
for LEARNER_TOKENS tokens so that the tables that they send stay in proportion to the input, runs AdaGrad over its
training texts, at every position of every one of them, and rows of the weight tables are averaged by the energy of their
gradients, in groups of one row block. Scores come from numpy batches of sparse features. The hash rows follow the
number of distinct words, one for WORDS_A_ROW of them, from CLASS_BUCKETS to MOST_BUCKETS (within classes from WORD_BUCKETS to
MOST_WORD_BUCKETS): every task holds the tables, so they can't grow on.

Counts cover all training tokens: words are counted inside each partition before one shuffle. Only
the LOOKUP_WORDS most frequent words, at most, go along with the tasks; all others meet their
counts in a join, with one row for each document and such word, and come back as partial sums.

Cases: null texts are empty and score their end token; without training texts N and V are 0; null
and repeated doc_ids are rows of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refsift.llm.common import id_fold, lean, stored, table, text_rows

FOLDS, HELD_FOLD, ALPHA = 10, 0, 0.1
HEAD_CLASSES, CLASS_WORDS, TAIL_CLASSES, SUFFIX = 64, 64, 32, 3
LOOKUP_WORDS, LEARNERS, LEARNER_TOKENS = 200_000, 256, 9_000_000
CLASS_BUCKETS, WORD_BUCKETS, BLOCK, RATE, BATCH, LEAST_ENERGY = 8192, 512, 4096, 0.3, 2048, 1e-3
MOST_BUCKETS, MOST_WORD_BUCKETS, WORDS_A_ROW = 65536, 1024, 8
END = b"\n"  # no word can hold it
N_CLASSES = HEAD_CLASSES + TAIL_CLASSES + 1
END_CLASS = N_CLASSES - 1
WIDTHS = 10, 10, 8, 8  # children of a node: runs of classes, classes of a run, runs of a class's words, words of a run


def words_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, A to Z in lower case and parted by ASCII white space, one after another, and how many each text has."""
    chars = np.frombuffer(b"\n".join([*texts, b""]).lower(), np.uint8)
    space = (chars == 32) | ((chars - np.uint8(9)) < 5)
    stops = np.flatnonzero(space)
    length = np.diff(stops, prepend=-1) - 1
    word = length > 0
    offsets = np.concatenate([[0], np.cumsum(length[word])])
    sizes = pa.binary() if offsets[-1] < 2**31 else pa.large_binary()
    own = pa.Array.from_buffers(sizes, len(offsets) - 1, [None, *(pa.py_buffer(x) for x in (offsets.astype(np.int32 if sizes == pa.binary() else np.int64), chars[~space]))])
    # Each text is followed by one white space, at whose place its words are over.
    over = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    return own, np.diff(np.cumsum(word)[np.searchsorted(stops, over)], prepend=0)


def bytes_of(words: pa.Array) -> list[bytes]:
    """to_pylist() of binaries without nulls, in a tenth of its time."""
    _, offsets, held = words.buffers()
    edges = np.frombuffer(offsets, np.int32 if words.type == pa.binary() else np.int64)[words.offset : words.offset + len(words) + 1].tolist()
    held = held.to_pybytes() if held else b""
    return [held[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-SUFFIX:]) % TAIL_CLASSES


def tail_cell(word: bytes) -> int:
    """Of all cells of all tail classes; as _cell has it for a column."""
    return tail_class(word) * CLASS_WORDS + (zlib.crc32(word) >> 8) % CLASS_WORDS


def _cell() -> Column:
    """tail_cell of the columns word and tail."""
    return ((F.col("tail") - HEAD_CLASSES) * CLASS_WORDS + F.shiftright(F.crc32("word"), 8) % CLASS_WORDS).cast("int")


# Counting


def _counted(source: Iterator[pa.RecordBatch], limit: int = 200_000) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []

    def merged() -> pa.Table:
        return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])

    for whole in source:
        for lo in range(0, whole.num_rows, 256):
            texts = whole.column(0).slice(lo, 256).to_pylist()
            tally = words_of(texts)[0].value_counts()
            words = pa.concat_arrays([tally.field(0).cast(pa.binary()), pa.array([END], pa.binary())])
            held.append(pa.table({"word": words, "n": pa.concat_arrays([tally.field(1), pa.array([len(texts)], pa.int64())])}))
            if sum(map(len, held)) > 2 * limit:
                held = [merged()]
                if len(held[0]) > limit:
                    yield from held.pop().to_batches()
    if held:
        yield from merged().to_batches()


def word_counts(texts: DataFrame) -> DataFrame:
    """word, tail (the class it has outside the head) and n over all rows of texts (text); the end is END."""
    counted = texts.select(F.col("text").cast("binary")).mapInArrow(lean(_counted), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    tail = F.when(F.col("word") == F.lit(END), END_CLASS).otherwise(HEAD_CLASSES + F.crc32(F.substring("word", -SUFFIX, SUFFIX)) % TAIL_CLASSES)
    return counted.select("word", tail.cast("int").alias("tail"), "n")


def frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int, int]]:
    """word, tail and n of the most frequent words but END, at most that many: all words from some count on."""
    words = counts.filter(F.col("word") != F.lit(END))
    bins = sorted((r["bin"], r["count"]) for r in words.groupBy(F.floor(F.log2("n") * 16).alias("bin")).count().collect())
    kept, least = 0, None
    for bin_, count in reversed(bins):
        if kept + count > most:
            break
        kept, least = kept + count, bin_
    if least is None:
        return []
    # As an Arrow table: rows of Python objects would take the driver tens of times the memory.
    rows = words.filter(F.floor(F.log2("n") * 16) >= least).select("word", "tail", "n").toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    return list(zip(*(c.to_pylist() for c in rows.columns), strict=True))


# The model


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Vocabulary:
    """Words by number: the frequent ones, always the same, and those of the texts at hand."""

    def __init__(self, rows: list[tuple[bytes, int, int]], end_count: int):
        self.words = {w: i for i, (w, _, _) in enumerate(rows)}
        self.size = len(rows)
        self.log_count = np.log10(np.array([n for *_, n in rows], float) + ALPHA) if rows else np.zeros(0)
        self.log_end, self.has_ends = math.log10(end_count + ALPHA), end_count > 0
        head = min(len(rows), HEAD_CLASSES * CLASS_WORDS)
        self.head = head
        self.classes = np.array([i // CLASS_WORDS if i < head else t for i, (_, t, _) in enumerate(rows)], np.int64)
        self.hashes = np.array([zlib.crc32(w) for w, _, _ in rows], np.uint64)
        self.endings = np.array([zlib.crc32(w[-SUFFIX:]) for w, _, _ in rows], np.uint64)


class Texts:
    """Texts as arrays over all their tokens, ends included."""

    def __init__(self, texts: list[bytes], vocabulary: Vocabulary):
        v = vocabulary
        own, each = words_of(texts)
        # A dictionary is asked once for each word of these texts, not for each of its places.
        told = own.dictionary_encode()
        words = bytes_of(told.dictionary)
        number = list(map(v.words.get, words))
        self.new: dict[bytes, int] = {}
        for i, w in enumerate(words):
            if number[i] is None:
                number[i] = self.new[w] = v.size + len(self.new)
        self.first: list[int] = (np.cumsum(each) - each + np.arange(len(each))).tolist()
        self.n = len(own) + len(texts)
        self.number = np.full(self.n, -1, np.int64)
        self.number[np.arange(len(own)) + np.repeat(np.arange(len(each)), each)] = np.array(number, np.int64)[told.indices.to_numpy()]
        # Number -1, the last of each array, is the end.
        hashes = np.concatenate([v.hashes, np.fromiter(map(zlib.crc32, self.new), np.uint64, len(self.new)), np.zeros(1, np.uint64)])
        endings = np.concatenate([v.endings, np.array([zlib.crc32(w[-SUFFIX:]) for w in self.new] + [0], np.uint64)])
        classes = np.concatenate([v.classes, np.array([HEAD_CLASSES + tail_class(w) for w in self.new] + [END_CLASS], np.int64)])
        self.target = classes[self.number]
        h, s = hashes[self.number], endings[self.number]
        # Places in a class are told for each word and not for each of its places, too.
        inside = (hashes >> np.uint64(8)).astype(np.int64) % CLASS_WORDS
        inside[: v.head], inside[-1] = np.arange(v.head) % CLASS_WORDS, -1
        self.in_class = inside[self.number]
        self.tail = self.number >= v.head
        self.cell = np.where(self.tail, (self.target - HEAD_CLASSES) * CLASS_WORDS + self.in_class, -1)
        start = np.zeros(self.n, bool)
        start[self.first] = True
        # Before a text stands an end, and before that another.
        second = np.concatenate([[False], start[:-1]]) & ~start
        h1, s1 = (np.where(start, np.uint64(0), np.concatenate([x[-1:], x[:-1]])) for x in (h, s))
        h2, s2 = (np.where(start | second, np.uint64(0), np.concatenate([x[-2:], x[:-2]])[: self.n]) for x in (h, s))
        pair = _mix(s1 * np.uint64(31) + s2, 4)
        self.features = np.stack([_mix(h1, 1), _mix(h1 * np.uint64(0x85EBCA6B) + h2, 2), _mix(h2, 3), pair]).astype(np.uint64)


def class_rows(types: int) -> int:
    """Hash rows of the two upper levels for so many distinct words."""
    return min(MOST_BUCKETS, max(CLASS_BUCKETS, -(-types // WORDS_A_ROW)))


def word_rows(types: int) -> int:
    """Hash rows of the two levels within a class, which have one node for each class and each run of words."""
    return min(MOST_WORD_BUCKETS, max(WORD_BUCKETS, -(-types // (WORDS_A_ROW * CLASS_WORDS))))


class MaxEnt:
    """One softmax for each node of four levels. A token's path: the run of classes, the class, a run of the class's words, the word
    (or cell); an end stops at its class. weights: for each level the rows (hash row, node) by child."""

    def __init__(self, mass: np.ndarray, rows: tuple[int, int] = (CLASS_BUCKETS, WORD_BUCKETS)):
        """mass: of each class's words or cells, the end's first; zero where there is none. Biases are the logarithms
        of shares; all other weights start at zero."""
        self.rows = (rows[0], rows[0], rows[1], rows[1])
        leaves = np.zeros((WIDTHS[0] * WIDTHS[1], CLASS_WORDS))
        leaves[:N_CLASSES] = mass
        runs = leaves.reshape(-1, WIDTHS[2], WIDTHS[3])
        by_class = leaves.sum(axis=1).reshape(WIDTHS[0], WIDTHS[1])
        shares = by_class.sum(axis=1)[None], by_class, runs.sum(axis=2), runs.reshape(-1, WIDTHS[3])
        with np.errstate(divide="ignore", invalid="ignore"):
            self.bias = [np.where(x > 0, np.log(x) - np.log(x.max(axis=1, keepdims=True)), -1e9).astype(np.float32) for x in shares]
        self.weights = [np.zeros((n * len(b), w), np.float32) for n, b, w in zip(self.rows, self.bias, WIDTHS, strict=True)]

    def hashed(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The features' hash rows in the two upper and the two lower levels: their halves, scaled to the rows."""
        half = np.uint64(32)
        low, high = features & np.uint64(0xFFFFFFFF), features >> half
        return ((low * np.uint64(self.rows[0])) >> half).astype(np.int64), ((high * np.uint64(self.rows[2])) >> half).astype(np.int64)

    def at(self, level: int, hashed: tuple[np.ndarray, np.ndarray], node: np.ndarray, where: np.ndarray | None = None) -> np.ndarray:
        """For each feature the rows of the positions (of those at `where`)."""
        own = hashed[level // 2]
        return (own if where is None else own.take(where, axis=1)) * len(self.bias[level]) + node

    def shares(self, level: int, at: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Probabilities of each child, by child and position."""
        table_ = self.weights[level]
        z = self.bias[level].take(node, axis=0)
        for row in at:
            z += table_.take(row, axis=0)
        z = np.ascontiguousarray(z.T)
        z -= z.max(axis=0)
        np.exp(z, out=z)
        z /= z.sum(axis=0)
        return z

    def log10(self, texts: Texts, batch: int = 8192) -> np.ndarray:
        """Each token's log10 probability but for a tail word's share of its cell."""
        out = np.empty(texts.n)
        for lo in range(0, texts.n, batch):
            upto = slice(lo, min(texts.n, lo + batch))
            hashed = self.hashed(texts.features[:, upto])
            logs = np.zeros(hashed[0].shape[1])
            for level, (node, child, where) in enumerate(paths(texts.target[upto], texts.in_class[upto])):
                p = self.shares(level, self.at(level, hashed, node, where), node)[child, np.arange(len(child))]
                logs[slice(None) if where is None else where] += np.log10(np.maximum(p, 1e-30))
            out[upto] = logs
        return out


def paths(target: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """Of each level the nodes, the children taken, and the positions that get there (all, if None)."""
    run = target // WIDTHS[1]
    yield np.zeros_like(run), run, None
    yield run, target % WIDTHS[1], None
    words = np.flatnonzero(at >= 0)
    at, target = at[words], target[words]
    yield target, at // WIDTHS[3], words
    yield target * WIDTHS[2] + at // WIDTHS[3], at % WIDTHS[3], words


class Learner:
    """AdaGrad on one partition, with a step size for each row of the tables."""

    def __init__(self, model: MaxEnt):
        self.model = model
        self.energy = [np.full(len(t), LEAST_ENERGY, np.float32) for t in model.weights]

    def learn(self, target: np.ndarray, at: np.ndarray, features: np.ndarray) -> None:
        hashed = self.model.hashed(features)
        for level, (node, child, where) in enumerate(paths(target, at)):
            if len(node):
                rows = self.model.at(level, hashed, node, where)
                p = self.model.shares(level, rows, node)
                p[child, np.arange(len(child))] -= 1
                self._step(level, rows, p)

    def _step(self, level: int, rows: np.ndarray, gradient: np.ndarray) -> None:
        """gradient: by child and position, the same for all features. A row that occurs several times gets
        all its gradients, each with the step size after the last of them."""
        energy, table_, size = self.energy[level], self.model.weights[level], np.einsum("ij,ij->j", gradient, gradient)
        for row in rows:
            np.add.at(energy, row, size)
        for row, step in zip(rows, np.float32(-RATE) / np.sqrt(energy.take(rows)), strict=True):
            for column, change in zip(table_.T, gradient * step, strict=True):
                np.add.at(column, row, change)


def _learned(source: Iterator[pa.RecordBatch], vocabulary, fresh) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) in; row blocks of all levels, with the energy of their gradients, out."""
    v, learner = vocabulary.value, Learner(fresh())
    held: list[tuple] = []
    for whole in source:
        for lo in range(0, whole.num_rows, 128):
            batch = whole.slice(lo, 128)
            texts = Texts(batch.column(1).to_pylist(), v)
            held.append((texts.target, texts.in_class, texts.features))
            if sum(len(h[0]) for h in held) >= BATCH:
                _train(learner, held)
                held = []
    if held:
        _train(learner, held)
    for level, (table_, whole) in enumerate(zip(learner.model.weights, learner.energy, strict=True)):
        for lo in range(0, len(table_), BLOCK):
            energy = whole[lo : lo + BLOCK] - np.float32(LEAST_ENERGY)
            if energy.any():
                yield pa.RecordBatch.from_pydict({"part": pa.array([level], pa.int32()), "block": pa.array([lo], pa.int32()), "weights": pa.array([table_[lo : lo + BLOCK].tobytes()], pa.binary()), "energy": pa.array([energy.tobytes()], pa.binary())})


def _train(learner: Learner, held: list[tuple]) -> None:
    target, at, features = held[0] if len(held) == 1 else (np.concatenate([h[i] for h in held], axis=-1) for i in range(3))
    # Texts are mixed, so that a batch is not all of one.
    order = np.random.default_rng(len(target)).permutation(len(target))
    for lo in range(0, len(order), BATCH):
        part = order[lo : lo + BATCH]
        learner.learn(target[part], at[part], features.take(part, axis=1))


def _averaged(rows: pa.Table) -> pa.Table:
    energy = [np.frombuffer(x, np.float32) for x in rows["energy"].to_pylist()]
    whole = np.maximum(np.sum(energy, axis=0), 1e-30)
    mean = 0
    for x, own in zip(rows["weights"].to_pylist(), energy, strict=True):
        mean = mean + np.frombuffer(x, np.float32).reshape(len(own), -1) * (own / whole)[:, None]
    return pa.table({"part": rows["part"][:1], "block": rows["block"][:1], "weights": pa.array([mean.astype(np.float32).tobytes()], pa.binary())})


def learners(n_tokens: int) -> int:
    return max(1, min(LEARNERS, -(-n_tokens // LEARNER_TOKENS)))


def train(texts: DataFrame, vocabulary, fresh, n_tokens: int) -> MaxEnt:
    """texts: doc_id and text (binary) of the training rows, with n_tokens in all; vocabulary: a broadcast; fresh: gives an untrained model."""
    parts = texts.coalesce(learners(n_tokens)).mapInArrow(lean(lambda it: _learned(it, vocabulary, fresh)), "part int, block int, weights binary, energy binary")
    model = fresh()
    tables = model.weights
    for row in parts.groupBy("part", "block").applyInArrow(_averaged, "part int, block int, weights binary").toLocalIterator():
        table_ = tables[row["part"]]
        got = np.frombuffer(row["weights"], np.float32).reshape(-1, table_.shape[1])
        table_[row["block"] : row["block"] + len(got)] = got
    return model


# Scoring

_SCORED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("model", pa.float64()), ("tail", pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int32())])))])
_SCORED_DDL = "doc_id long, n_tokens long, n_known long, base double, model double, tail array<struct<word binary, times int>>"


def _scored(source: Iterator[pa.RecordBatch], vocabulary, model, log_mass: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What a worker knows of each text: sums without the words outside the vocabulary, and these."""
    v, m = vocabulary.value, model.value
    log_count = None
    for whole in source:
        for lo in range(0, whole.num_rows, 256):
            batch = whole.slice(lo, 256)
            texts = Texts(batch.column(1).to_pylist(), v)
            log_count = np.concatenate([v.log_count, np.zeros(len(texts.new)), [v.log_end]])
            base = log_count[texts.number]
            logs = m.log10(texts)
            logs[texts.tail] += base[texts.tail] - log_mass[texts.cell[texts.tail]]
            known = (texts.number < v.size) & ((texts.number >= 0) | v.has_ends)
            edges = [*texts.first, texts.n]
            words = list(texts.new)
            rows = []
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                part = slice(edges[k], edges[k + 1])
                numbers = texts.number[part]
                unknown, times = np.unique(numbers[numbers >= v.size], return_counts=True)
                rows.append((doc_id, len(numbers), int(known[part].sum()), float(base[part].sum()), float(logs[part].sum()), [{"word": words[i - v.size], "times": int(t)} for i, t in zip(unknown, times, strict=True)]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCORED, strict=True)], schema=_SCORED)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    rows = text_rows(docs).withColumn("held_out", id_fold(F.col("doc_id"), FOLDS) == HELD_FOLD)
    training = rows.filter(~F.col("held_out"))
    counts = stored(word_counts(training))
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("N"), F.count("*").alias("V"), F.coalesce(F.sum(F.when(F.col("word") == F.lit(END), F.col("n"))), F.lit(0)).alias("ends")).first()
    known = frequent(counts, LOOKUP_WORDS)
    own = Vocabulary(known, totals["ends"])
    head = np.array([n for *_, n in known[: own.head]], float)
    # Tokens of each class, and smoothed mass of the tail classes' cells with one unseen type each.
    cells, types = np.zeros(TAIL_CLASSES * CLASS_WORDS), np.zeros(TAIL_CLASSES * CLASS_WORDS)
    for r in counts.filter(F.col("tail") != END_CLASS).groupBy(_cell().alias("cell")).agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect():
        cells[r["cell"]], types[r["cell"]] = r["n"], r["types"]
    for word, _, n in known[: own.head]:
        cells[tail_cell(word)] -= n
        types[tail_cell(word)] -= 1
    mass = cells + ALPHA * (types + 1)
    log_mass = np.log10(mass)
    leaves = np.zeros((N_CLASSES, CLASS_WORDS))
    leaves.ravel()[: own.head] = head + ALPHA
    leaves[HEAD_CLASSES:END_CLASS] = mass.reshape(TAIL_CLASSES, CLASS_WORDS)
    leaves[END_CLASS, 0] = totals["ends"] + ALPHA

    def fresh() -> MaxEnt:
        return MaxEnt(leaves, (class_rows(totals["V"]), word_rows(totals["V"])))

    vocabulary = spark.sparkContext.broadcast(own)
    del known, own  # the workers have it; the driver needs its memory
    trained = train(training.select("doc_id", F.col("text").cast("binary")), vocabulary, fresh, totals["N"])
    model = spark.sparkContext.broadcast(trained)
    del trained
    partial = text_rows(docs).select("doc_id", F.col("text").cast("binary")).mapInArrow(lean(lambda it: _scored(it, vocabulary, model, log_mass)), _SCORED_DDL)
    partial = stored(partial.withColumn("row_no", F.monotonically_increasing_id()))
    missing = partial.select("row_no", F.inline("tail")).join(counts.select("word", "n"), "word", "left")
    sums = missing.groupBy("row_no").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + ALPHA)).alias("tail_logs"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("tail_known"),
    )
    whole = partial.select("row_no", "doc_id", "n_tokens", "n_known", "base", "model").join(sums, "row_no", "left")
    n, v = totals["N"], totals["V"]
    more = F.coalesce("tail_logs", F.lit(0.0))
    return whole.select(
        "doc_id",
        (id_fold(F.col("doc_id"), FOLDS) == HELD_FOLD).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * math.log10(n + ALPHA * (v + 1))).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
