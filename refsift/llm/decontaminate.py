"""Benchmark decontamination: BM25 with block-max WAND, then question and answer overlap.

The test items are the index, the training passages the queries. An item's BM25 impacts are divided
by their sum, so that a passage's score is the share of the item, weighted by rarity, that it
holds, and one threshold serves all items. Passages are windows of twice the longest item's words, each half
over the next, so every stretch as long as an item lies whole in one of them.

Most windows are settled by bounds, computed for a whole document at once: the sum of their terms'
maxima in each cell of items. Those that could reach the threshold are searched by block-max WAND, which gives every item at or above it. An item found
is confirmed if enough of its question's and of its answer's word trigrams stand in the window.

Plan: one pass over the documents without a shuffle; the index of up to SHARD_ITEMS items and SHARD_CHARS
characters goes along with the tasks, and a larger benchmark is searched shard by shard. Document frequencies,
mean and longest length are those of the whole benchmark in every shard, so answers don't depend on the cut.
Windows are worked off in stretches, so that a long text takes no more memory than a short one.

Cases: null texts are empty and match nothing; items without words match nothing; repeated documents
and items are rows of their own; null ids are carried along; without documents or items there are no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refsift.llm.common import batches, bounded_batches, kept_rows, lean, stored, table, text_rows
from refsift.llm.shingles import words

K1, B, BLOCK, THRESHOLD, OVERLAP, GRAM = 1.2, 0.75, 8, 0.55, 0.5, 3
#: The table of bounds has at most TABLE_CELLS numbers; a stretch of text is bounded by STRETCH_CELLS.
SHARD_ITEMS, SHARD_CHARS, TABLE_CELLS, STRETCH_CELLS = 100_000, 64 << 20, 1 << 23, 1 << 20


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The last line is the answer, else the last sentence, else the second half of the words."""
    for mark in (r"\n", r"[.?!]\s"):
        cuts = [m.end() for m in re.finditer(mark, text.rstrip())]
        if cuts and words(text[: cuts[-1]]) and words(text[cuts[-1] :]):
            return words(text[: cuts[-1]]), words(text[cuts[-1] :])
    all_ = words(text)
    return all_[: len(all_) // 2], all_[len(all_) // 2 :]


def grams(parts: list[bytes], size: int = GRAM) -> set[tuple[bytes, ...]]:
    size = min(size, len(parts))
    return {tuple(parts[i : i + size]) for i in range(len(parts) - size + 1)} if parts else set()


def overlap(wanted: set[tuple[bytes, ...]], parts: list[bytes]) -> float:
    """The share of these n-grams that a passage holds; 1 for none."""
    if not wanted:
        return 1.0
    return len(wanted & grams(parts, len(next(iter(wanted))))) / len(wanted)


class Whole(NamedTuple):
    """What an index takes from all items: how many, their mean and longest length in words, and the document frequencies of its words."""

    n: int
    mean: float
    longest: int
    df: Mapping[bytes, int]


class ItemIndex:
    def __init__(self, items: list[tuple[int | None, str]], whole: Whole | None = None):
        """whole: of the benchmark, where items are only a shard of it."""
        held = [(i, t, w) for i, t in items if (w := words(t))]
        self.ids = [i for i, _, _ in held]
        self.qa = [tuple(map(grams, question_and_answer(t))) for _, t, _ in held]
        n, own = len(held), Counter(t for *_, w in held for t in set(w))
        if whole is None:
            whole = Whole(n, sum(len(w) for *_, w in held) / max(1, n), max((len(w) for *_, w in held), default=1), own)
        idf = {t: math.log(1 + (whole.n - whole.df[t] + 0.5) / (whole.df[t] + 0.5)) for t in own}
        postings: dict[bytes, list[tuple[int, float]]] = {t: [] for t in sorted(own)}
        for k, (*_, w) in enumerate(held):
            impact = {t: idf[t] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(w) / whole.mean)) for t, c in Counter(w).items()}
            sum_ = sum(impact.values())
            for t, x in impact.items():
                postings[t].append((k, x / sum_))
        self.longest = whole.longest
        self.terms = {t: i for i, t in enumerate(postings)}
        self.items = [[k for k, _ in p] for p in postings.values()]
        self.impacts = [[x for _, x in p] for p in postings.values()]
        self.bound = [max(p) for p in self.impacts]
        self.block_bounds: list[dict[int, float]] = []
        for ks, xs in zip(self.items, self.impacts, strict=True):
            by: dict[int, float] = {}
            for k, x in zip(ks, xs, strict=True):
                by[k // BLOCK] = max(by.get(k // BLOCK, 0.0), x)
            self.block_bounds.append(by)
        # For whole windows at once: each term's bound in each cell, a run of items; one item where that fits.
        wide = max(1, -(-len(postings) * n // TABLE_CELLS))
        self.table = np.zeros((len(postings), max(1, -(-n // wide))), np.float32)
        for i, (ks, xs) in enumerate(zip(self.items, self.impacts, strict=True)):
            np.maximum.at(self.table[i], np.array(ks) // wide, np.array(xs, np.float32))

    def promising(self, terms: np.ndarray, at: np.ndarray, segments: int, threshold: float) -> np.ndarray:
        """The windows of two segments each whose bounds reach the threshold in some cell. terms
        stand in the segments at; one that both segments hold counts twice, which only adds."""
        both = np.unique(at * len(self.table) + terms)
        at, terms = both // len(self.table), both % len(self.table)
        held, first = np.unique(at, return_index=True)
        bounds = np.zeros((segments, self.table.shape[1]), np.float32)
        bounds[held] = np.add.reduceat(self.table[terms], first, axis=0)
        if segments > 1:
            bounds = bounds[:-1] + bounds[1:]
        return np.flatnonzero(bounds.max(axis=1) >= threshold - 1e-4)

    def retrieve(self, terms: set[int], threshold: float) -> list[tuple[int, float]]:
        """Block-max WAND: all items whose impacts of these terms sum up to the threshold or more."""
        end, found = len(self.ids), []
        cursors = [[self.items[t][0], 0, t] for t in terms]

        def advance(cursor: list[int], to: int) -> None:
            _, i, t = cursor
            items = self.items[t]
            while i < len(items) and items[i] < to:
                i += 1
            cursor[0], cursor[1] = items[i] if i < len(items) else end, i

        while True:
            cursors = sorted(c for c in cursors if c[0] < end)
            total, pivot = 0.0, None
            for p, c in enumerate(cursors):
                total += self.bound[c[2]]
                if total >= threshold - 1e-9:
                    pivot = p
                    break
            if pivot is None:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK
            if sum(self.block_bounds[c[2]].get(block, 0.0) for c in cursors[: pivot + 1]) < threshold - 1e-9:
                # No item up to the block's end, or to the next cursor, can do it.
                to = min((block + 1) * BLOCK, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else end)
                for c in cursors[: pivot + 1]:
                    advance(c, to)
            elif cursors[0][0] == item:
                score = sum(self.impacts[c[2]][c[1]] for c in cursors[: pivot + 1])
                if score >= threshold - 1e-9:
                    found.append((item, score))
                for c in cursors[: pivot + 1]:
                    advance(c, item + 1)
            else:
                for c in cursors[:pivot]:
                    advance(c, item)


def search(text: str, index: ItemIndex, threshold: float = THRESHOLD, least: float = OVERLAP) -> list[tuple[int, float, float, float]]:
    """Confirmed items of a text: position in the index, best score, question and answer overlap."""
    parts = words(text)
    known = np.fromiter(map(index.terms.get, parts, [-1] * len(parts)), np.int64, len(parts))
    half = index.longest
    best: dict[int, tuple[float, float, float]] = {}
    segments = max(1, -(-len(parts) // half))
    stretch = max(2, STRETCH_CELLS // index.table.shape[1])
    for first in range(0, max(1, segments - 1), stretch - 1):
        last = min(segments, first + stretch)
        place = np.arange(first * half, min(len(parts), last * half))
        place = place[known[place] >= 0]
        if not len(place):
            continue
        for w in index.promising(known[place], place // half - first, last - first, threshold):
            lo = (first + int(w)) * half
            window = slice(lo, lo + 2 * half)
            for item, score in index.retrieve(set(known[window].tolist()) - {-1}, threshold):
                q, a = (overlap(g, parts[window]) for g in index.qa[item])
                if min(q, a) >= least and (score, q, a) > best.get(item, (0.0, 0.0, 0.0)):
                    best[item] = score, q, a
    return [(k, *v) for k, v in sorted(best.items())]


_HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])
_HITS_DDL = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def _lengths_and_words(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        parts = [words(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(list(map(len, parts)), pa.int64()), pa.array([sorted(set(w)) for w in parts], pa.list_(pa.binary()))], ["n", "words"])


def indexes(benchmark: DataFrame) -> Iterator[ItemIndex]:
    """An index for each shard of the benchmark."""
    bounded_batches(benchmark.sparkSession)
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), F.coalesce(benchmark["text"].cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    shards = max(1, math.ceil(size["n"] / SHARD_ITEMS), math.ceil(size["chars"] / SHARD_CHARS))
    order = lambda rows: sorted(((r["item_id"], r["text"]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if shards == 1:
        yield ItemIndex(order(items.collect()))
        return
    # Row numbers deal repeated items to all shards; stored, they stay what they are.
    dealt = stored(items.withColumn("shard", F.monotonically_increasing_id())).withColumn("shard", F.pmod(F.xxhash64("shard"), F.lit(shards)))
    read = lambda rows: rows.select("text").mapInArrow(lean(_lengths_and_words), "n long, words array<binary>")
    told = read(dealt).filter("n > 0").agg(F.count("*").alias("n"), F.avg("n").alias("mean"), F.max("n").alias("longest")).first()
    frequencies = stored(read(dealt).select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("df")))
    for shard in range(shards):
        rows = dealt.filter(F.col("shard") == shard)
        own = read(rows).select(F.explode("words").alias("w")).distinct()
        df = {bytes(r["w"]): r["df"] for r in frequencies.join(own, "w", "left_semi").toLocalIterator()}
        yield ItemIndex(order(rows.collect()), Whole(told["n"], told["mean"] or 0.0, told["longest"] or 1, df))


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least: float = OVERLAP) -> DataFrame:
    """docs without the rows whose text holds a test item."""
    for index in indexes(benchmark):
        docs = kept_rows(docs, lambda texts, index=index: [not search(t, index, threshold, least) for t in texts])
    return docs


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least: float = OVERLAP) -> DataFrame:
    """doc_id, item_id, score and overlaps for every document and test item that it holds."""
    found = None
    for index in indexes(benchmark):

        def run(source: Iterator[pa.RecordBatch], index: ItemIndex = index) -> Iterator[pa.RecordBatch]:
            def hits() -> Iterator[tuple]:
                for batch in source:
                    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                        for item, score, q, a in search(text, index, threshold, least):
                            yield doc_id, index.ids[item], score, q, a

            yield from batches(hits(), _HITS)

        part = text_rows(docs).mapInArrow(lean(run), _HITS_DDL)
        found = part if found is None else found.unionByName(part)
    return found


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "item_id", *[F.round(c, 6).alias(c) for c in ("score", "question_overlap", "answer_overlap")])
