"""Quality classifier: random Fourier features over document statistics, ridge and isotonic calibration.

Statistics of each whole text (lengths, character classes, repetition, word shapes) are standardised
and sent through FEATURES random cosines, which approximate a Gaussian kernel. Each partition sums
its part of the normal equations; the driver adds a fixed number of such sums and solves for the
ridge weights. A fold of the training rows that the weights have not seen is binned by raw score,
and isotonic regression over the bins turns raw scores into probabilities of label 1.

Plan: one pass over the texts writes the statistics, some 100 bytes a document, to the shared
folder; training and scoring read those. Only labelled rows are shuffled, by doc_id. At most
MAX_TRAIN_ROWS labelled rows are fitted, in TRAIN_PARTITIONS tasks, so that what reaches the driver
is bounded at any input size; the sample is drawn by a hash of doc_id. Scoring is a projection over
all documents.

Cases: null texts are empty and are scored too; labels that are null or contradict one another count
as their mean, null ones not at all; repeated doc_ids are rows of their own, each with its text's
score; without labels of both classes every score is the labels' mean, or 0.5 without any; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refsift.llm.common import id_fold, kept_rows, lean, stored, table, text_rows

FEATURES, RIDGE, SEED, BINS = 256, 1e-3, 20240, 1024
MAX_TRAIN_ROWS, TRAIN_PARTITIONS = 200_000, 32
#: Of the five folds by crc32(doc_id), fold 0 is never learned from; this one calibrates.
FOLDS, HELD_FOLD, CALIBRATION_FOLD = 5, 0, 1

_LETTERS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "stop": b".,;:?",
    "bar": b"|",
    "shout": b"!",
    "symbol": b"#$%&*@^~<>{}[]\\_=+",
    "quote": b"'\"`()/-",
    "line": b"\n",
    "space": b" \t\r",
}
_CLASS = np.zeros((256, len(_LETTERS) + 1))
for _i, _chars in enumerate(_LETTERS.values()):
    _CLASS[list(_chars), _i] = 1
_CLASS[128:, -1] = 1
N_STATS = len(_LETTERS) + 1 + 14


def statistics(text: bytes) -> list[float]:
    """N_STATS numbers about a text in UTF-8."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = max(1, len(text))
    words = text.split()
    lines = [x for x in text.split(b"\n") if x]
    n_words, n_lines = max(1, len(words)), max(1, len(lines))
    tally = Counter(words)
    sizes = np.fromiter(map(len, words), np.int32, len(words)) if words else np.zeros(1, np.int32)
    share = counts[counts > 0] / n
    adjacent = sum(map(bytes.__eq__, words, words[1:]))
    symbol_ends = sum(w[-1] in b"#$%&*@^~!|" for w in tally)
    return [
        *(counts @ _CLASS / n),
        math.log1p(len(text)),
        math.log1p(len(words)),
        float(sizes.mean()),
        float(sizes.std()),
        len(tally) / n_words,
        math.log1p(len(tally)) / math.log1p(n_words),
        max(tally.values(), default=0) / n_words,
        adjacent / n_words,
        len(set(lines)) / n_lines,
        math.log1p(len(text) / n_lines),
        float(np.count_nonzero(sizes <= 3)) / n_words,
        float(np.count_nonzero(sizes >= 12)) / n_words,
        float(-(share * np.log(share)).sum()) if len(text) else 0.0,
        symbol_ends / max(1, len(tally)),
    ]


def _statistics_batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        rows = [statistics(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "stats"])


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and stats (array of N_STATS doubles) of every row."""
    return text_rows(docs).select("doc_id", F.col("text").cast("binary")).mapInArrow(lean(_statistics_batches), "doc_id long, stats array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, N_STATS))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    raised: np.ndarray
    default: float

    def features(self, stats: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        directions = rng.normal(size=(N_STATS, FEATURES)) / math.sqrt(N_STATS)
        shifts = rng.uniform(0, 2 * math.pi, FEATURES)
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(z @ directions + shifts) * math.sqrt(2 / FEATURES), np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def bins(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(((raw + 0.5) * (BINS / 2)).astype(int), 0, BINS - 1)

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated; a thousandth of the raw score keeps order within a step."""
        if not len(self.weights):
            return np.full(len(stats), self.default)
        raw = self.raw(stats)
        return np.clip(0.999 * self.raised[self.bins(raw)] + 0.001 * np.clip(raw, 0, 1), 0, 1)


def isotonic(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Non-decreasing means by pool-adjacent-violators; bins without rows take the one before, else the next."""
    blocks: list[list[float]] = []
    for i in np.flatnonzero(count):
        blocks.append([total[i], count[i], i])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t, c, _ = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t, blocks[-1][1] + c, blocks[-1][2]]
    out = np.zeros(len(count))
    for k, (t, c, first) in enumerate(blocks):
        out[first if k else 0 :] = t / c
    return out


def _summed(rows: DataFrame, part: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over partitions of part(stats, labels), a vector of that size. rows: stats, label."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in source:
            if batch.num_rows:
                total += part(_matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)).ravel()
        yield pa.RecordBatch.from_pydict({"part": pa.array([total.tobytes()], pa.binary())})

    return sum((np.frombuffer(r["part"]) for r in rows.select("stats", "label").mapInArrow(run, "part binary").toLocalIterator()), np.zeros(size))


def train(labelled: DataFrame) -> Model:
    """labelled: stats, label (0 to 1) and calibration (boolean), at most MAX_TRAIN_ROWS rows or so."""
    fit, held = labelled.filter("NOT calibration"), labelled.filter("calibration")
    sums = _summed(fit, lambda x, y: np.concatenate([[len(x), y.sum()], x.sum(0), (x * x).sum(0)]), 2 + 2 * N_STATS)
    n, positive = sums[:2]
    default = positive / n if n else 0.5
    if not n or positive in (0, n):
        return Model(np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(0), default)
    mean = sums[2 : 2 + N_STATS] / n
    scale = np.sqrt(np.maximum(sums[2 + N_STATS :] / n - mean**2, 0)) + 1e-6
    model = Model(mean, scale, np.zeros(FEATURES + 1), np.zeros(BINS), default)
    d = FEATURES + 1

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.features(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    equations = _summed(fit, normal, d * d + d)
    model.weights = np.linalg.solve(equations[: d * d].reshape(d, d) / n + RIDGE / FEATURES * np.eye(d), equations[d * d :] / n)

    def binned(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = model.bins(model.raw(x))
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, y, minlength=BINS)])

    bins = _summed(held, binned, 2 * BINS)
    if not bins[:BINS].sum():
        bins = _summed(fit, binned, 2 * BINS)
    model.raised = isotonic(bins[:BINS], bins[BINS:])
    return model


def known_labels(labels: DataFrame, label: str = "quality", max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """doc_id and label outside the held-out fold; max_rows of them or so."""
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label].cast("double").alias("label")).filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & (id_fold(F.col("doc_id"), FOLDS) != HELD_FOLD))
    known = known.groupBy("doc_id").agg(F.avg("label").alias("label"))
    share = min(1.0, max_rows / max(1, known.count()))
    if share < 1:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    return known


def labelled_rows(stats: DataFrame, known: DataFrame) -> DataFrame:
    """The training rows: known labels with their documents' statistics."""
    rows = stats.join(known, "doc_id").select("stats", "label", (id_fold(F.col("doc_id"), FOLDS) == CALIBRATION_FOLD).alias("calibration"))
    return rows.coalesce(TRAIN_PARTITIONS)


def scored(stats: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            score = model.score(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    out = stats.mapInArrow(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", (id_fold(F.col("doc_id"), FOLDS) == HELD_FOLD).alias("held_out"), "score", "predicted")


def fitted(stats: DataFrame, known: DataFrame) -> Model:
    rows = stored(labelled_rows(stats, known))
    return train(rows.coalesce(TRAIN_PARTITIONS))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs without the rows scored below the threshold; each row is judged by its own text."""
    known = stored(known_labels(labels))  # MAX_TRAIN_ROWS rows or so, whatever the input, hence broadcast
    ids = F.broadcast(known.select(F.col("doc_id").alias("known_id")))
    taught = docs.join(ids, docs["doc_id"].cast("long") == ids["known_id"], "left_semi")
    model = fitted(document_statistics(taught), known)
    return kept_rows(docs, lambda texts: model.score(np.array([statistics(t.encode()) for t in texts]).reshape(-1, N_STATS)) >= threshold)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""
    stats = stored(document_statistics(docs))
    return scored(stats, fitted(stats, known_labels(labels)), threshold)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
