"""Hard negatives: for each anchor all scores in full order, and in that order a window below each of its positives.

A row's score is its integer inner product with the anchor, higher first, ties by smaller id. The order is made in
runs: rows and anchors are dealt in blocks, and each cell of a block of anchors and a block of rows is scored whole,
lexsorted by score and id, and read. First each run gives its best rows of the anchor's label, of which the merged first
are its positives; then in each run a binary search finds where a positive's upper limit begins, and its first rows of other
labels from there, down to the lower limit, are read. What runs give is merged by score and id: the first k of all rows are
among the first k of each run, so the result is that of one sort over all rows.

Plan: rows are scaled and written once, with a number of their own that blocks go by, so that neither a common
vector, label nor id fills a block. One shuffle by cell for each pass; one by anchor for each merge, which gets a few
rows from each cell. A task holds one block of anchors and one of rows. Nothing is broadcast; the driver sees counts.

Cases: rows with a null id, label or vector, or a null or non-finite component, take no part, nor do vectors
of another than the most frequent length (of ties, the smallest), for which the product isn't defined, and ones with a scaled
component so large that scores wouldn't fit a long (2^62 / length at most for its square; about 10^6 before scaling). Zero vectors do.
Rows of repeated ids are rows of their own: other rows to each other, and anchors each. Anchors without a row of their
label, and positives without a row between their limits, give no rows, nor does an empty table. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refsift.llm.common import stored, table

#: Rows and anchors of a cell. Small tables are dealt in up to LEAST_BLOCKS blocks of SMALL_BLOCK rows or more, so that they have tasks enough.
ROW_BLOCK, ANCHOR_BLOCK, SMALL_BLOCK, LEAST_BLOCKS, MOST_TASKS = 4096, 1024, 256, 64, 10_000
#: How many anchors are scored at once.
AT_ONCE = 32


def scaled_rows(rows: DataFrame, label: Column, scale: float = 256.0, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, label and v, the components as whole numbers, of the rows that take part."""
    held = rows.select(rows[vec_id].cast("long").alias("vec_id"), label.cast("int").alias("label"), rows[embedding].cast("array<double>").alias("x"))
    finite = F.coalesce(F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))), F.lit(False))
    held = held.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).filter(finite)
    sizes = held.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    d = sizes[0]["d"] if sizes else 0
    most = math.isqrt((1 << 62) // max(1, d))
    fits = F.forall("x", lambda x: (F.abs(x * F.lit(scale)) < F.lit(float(most))))
    return held.filter(F.size("x") == d).filter(fits).select("vec_id", "label", F.transform("x", lambda x: F.floor(x * F.lit(scale)).cast("long")).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0), np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exactly: as doubles where every sum is below 2^53, else as integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if most < 2**53 else a @ b.T


class Cell:
    """A block of anchors, a block of rows, and for each of these anchors its rows in order."""

    def __init__(self, anchors: pa.Table, rows: pa.Table):
        by_id = np.argsort(rows["vec_id"].to_numpy(), kind="stable")
        self.ids, self.labels = rows["vec_id"].to_numpy()[by_id], rows["label"].to_numpy()[by_id]
        self.vectors = _matrix(rows["v"].combine_chunks())[by_id]
        self.anchors, self.anchor_vectors = anchors, _matrix(anchors["v"].combine_chunks())

    def sorted_runs(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Number of the anchor, positions of the rows in its order, their scores."""
        for lo in range(0, len(self.anchor_vectors), AT_ONCE):
            scores = products(self.anchor_vectors[lo : lo + AT_ONCE], self.vectors)
            order = np.lexsort((np.broadcast_to(self.ids, scores.shape), -scores), axis=-1)
            scores = np.take_along_axis(scores, order, axis=1)
            for i in range(len(scores)):
                yield lo + i, order[i], scores[i]

    def positives(self, k: int) -> Iterator[tuple]:
        """The first k + 1 rows of the anchor's label, one of which may be the anchor."""
        at, label = self.anchors["at"].to_numpy(), self.anchors["label"].to_numpy()
        for a, order, scores in self.sorted_runs():
            first = np.flatnonzero(self.labels[order] == label[a])[: k + 1]
            yield from zip([int(at[a])] * len(first), [0] * len(first), self.ids[order[first]].tolist(), scores[first].tolist(), strict=True)

    def negatives(self, k: int, percent: int) -> Iterator[tuple]:
        """For each positive the first k rows of other labels with scores between percent % of its score and its score."""
        at, label, wanted = self.anchors["at"].to_numpy(), self.anchors["label"].to_numpy(), self.anchors["positives"].to_pylist()
        for a, order, scores in self.sorted_runs():
            other = np.flatnonzero(self.labels[order] != label[a])
            falling = -scores[other]
            for p in wanted[a]:
                # percent * score <= 100 * negative: percent is a whole number, so the limit is rounded up exactly.
                lowest = -((-percent * p["score"]) // 100)
                start, end = np.searchsorted(falling, -p["score"], "left"), np.searchsorted(falling, -lowest, "right")
                first = other[start : min(end, start + k)]
                yield from zip([int(at[a])] * len(first), [p["pos"]] * len(first), self.ids[order[first]].tolist(), scores[first].tolist(), strict=True)


FOUND = pa.schema([("at", pa.int64()), ("pos", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])
FOUND_SQL = "at long, pos int, vec_id long, score long"


def _of_cells(k: int, percent: int | None):
    """Rows sorted by cell and side (anchors first) to what their cells give; percent: None for positives."""

    def given(held: list[list[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
        if held[0] and held[1]:
            cell = Cell(*(pa.Table.from_batches(side) for side in held))
            found = list(cell.positives(k) if percent is None else cell.negatives(k, percent))
            for lo in range(0, len(found), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found[lo : lo + (1 << 16)], strict=True), FOUND, strict=True)], schema=FOUND)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, [[], []]
        for batch in source:
            cells, sides = batch.column("cell").to_numpy(), batch.column("side").to_numpy()
            keys = cells * 2 + sides
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)] if len(keys) else [0]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if cells[lo] != at:
                    yield from given(held)
                    at, held = cells[lo], [[], []]
                held[sides[lo]].append(batch.slice(lo, hi - lo))
        yield from given(held)

    return run


POSITIVES = "array<struct<pos int, vec_id long, score long>>"


def _dealt(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int) -> DataFrame:
    """Both sides by cell: each row meets each block of anchors, each anchor each block of rows, once."""
    row_blocks = max(-(-n_rows // ROW_BLOCK), min(LEAST_BLOCKS, -(-n_rows // SMALL_BLOCK)))
    anchor_blocks = -(-n_anchors // ANCHOR_BLOCK)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("at"), F.lit(n)).cast("int")
    cell = (F.col("a").cast("long") * row_blocks + F.col("r")).alias("cell")
    held = ["at", "vec_id", "label", "v"]
    row_side = rows.select(*held, F.lit(None).cast(POSITIVES).alias("positives"), own(row_blocks).alias("r"), every(anchor_blocks).alias("a")).select(cell, F.lit(1).alias("side"), *held, "positives")
    anchor_side = anchors.select(*held, "positives", own(anchor_blocks).alias("a"), every(row_blocks).alias("r")).select(cell, F.lit(0).alias("side"), *held, "positives")
    tasks = min(MOST_TASKS, row_blocks * anchor_blocks)
    both = row_side.unionByName(anchor_side).repartitionById(tasks, (F.col("cell") % tasks).cast("int"))
    return both.sortWithinPartitions("cell", "side")


def _first(found: DataFrame, group: list[str], k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, n_positives: int = 5, k: int = 5, percent: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score. rows: vec_id, label and v (whole numbers)."""
    kept = stored(rows.withColumn("at", F.monotonically_increasing_id()))
    anchors = kept.filter(is_anchor)
    n_rows, n_anchors = kept.count(), anchors.count()
    empty = rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not n_anchors:
        return empty
    none = F.lit(None).cast(POSITIVES).alias("positives")
    cells = _dealt(kept, anchors.select("at", "vec_id", "label", "v", none), n_rows, n_anchors)
    best = _first(cells.mapInArrow(_of_cells(n_positives, None), FOUND_SQL), ["at"], n_positives + 1)
    # The anchor itself is left out by its id and its own score, once: a row that has both as well can't be told from it.
    listed = best.groupBy("at").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("near"))
    own = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    at_own = F.array_position(F.transform("near", lambda p: (p["vec_id"] == F.col("vec_id")) & (p["score"] == own)), F.lit(True))
    others = F.slice(F.filter("near", lambda p: (at_own == 0) | (p["rank"] != at_own)), 1, n_positives)
    numbered = F.transform(others, lambda p, i: F.struct(i.cast("int").alias("pos"), p["vec_id"].alias("vec_id"), p["score"].alias("score")))
    asking = stored(anchors.join(listed, "at").select("at", "vec_id", "label", "v", numbered.alias("positives")).filter(F.size("positives") > 0))
    cells = _dealt(kept, asking, n_rows, n_anchors)
    found = _first(cells.mapInArrow(_of_cells(k, percent), FOUND_SQL), ["at", "pos"], k)
    pairs = asking.select("at", F.col("vec_id").alias("anchor_id"), F.explode("positives").alias("p")).select("at", F.col("p.pos").alias("pos"), "anchor_id", F.col("p.vec_id").alias("positive_id"), F.col("p.score").alias("positive_score"))
    return found.join(pairs, ["at", "pos"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(scaled_rows(rows, label), F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 5
"""
