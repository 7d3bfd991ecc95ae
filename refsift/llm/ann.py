"""Approximate nearest neighbours: inverted lists scanned with adaptive numbers of dimensions.

Largest inner product is smallest distance after one more coordinate, sqrt(M^2 - |x|^2), M being the
largest norm. Vectors are rotated at random and put into the lists of k-means centroids. Within a
probed list, distances are summed column block by column block; a candidate whose partial
distance, scaled up to all dimensions, exceeds the query's radius by more than a hypothesis test
allows is abandoned. What is left gets its exact inner product, in double precision, from the
original vectors.

A query's radius is its distance to the k-th of a bounded sample's vectors, which can't be less than
to the k-th of all. The sample's own results go into the merge too, so there are always k results
where there are k candidates. Centroids are fitted on a bounded sample; how many lists are probed
follows from the share of true neighbours that the first p lists hold within that sample, at least
TARGET.

Equal vectors are searched once: of each such class the k + 1 smallest ids are kept, as no more can be
among anyone's k nearest, and queries with one vector share one search. Lists are dealt in blocks of at
most about BLOCK_ROWS candidates, and queries stream past a block, so neither a common vector nor a
large list meets in one task, and a worker holds one block.

Plan: one shuffle by vector (classes), one by list and block (search), two small ones by query
(merge). Broadcast are the centroids and the sample, both bounded.

Cases: vectors that are null, zero, of another than the most frequent length (of ties, the smallest) or
with null or non-finite components take no part, nor do rows with a null id; rows of repeated ids
are rows of their own, each a candidate to the others; ties go to the smaller id; with fewer
candidates than k all are returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refsift.llm.common import stored, table

FIT_ROWS, RADIUS_ROWS, MAX_LISTS, BLOCK_ROWS = 20_000, 4096, 4096, 4096
COLUMN_BLOCK, EPSILON, TARGET, SEED = 16, 2.1, 0.97, 11


def vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and vector of the rows that take part."""
    vector = F.col("vector")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    held = rows.select(rows[vec_id].cast("long").alias("vec_id"), rows[embedding].cast("array<double>").alias("vector"))
    held = held.filter(F.col("vec_id").isNotNull() & vector.isNotNull()).filter(F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0))
    sizes = held.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return held.filter(F.size("vector") == (sizes[0]["d"] if sizes else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 1))


class Index:
    """Rotation, centroids and the radius sample; small enough to go along with the tasks."""

    def __init__(self, sample: np.ndarray, max_norm: float, n_classes: int, k: int):
        self.max_norm, self.k = max_norm, k
        rng = np.random.default_rng(SEED)
        d = sample.shape[1] + 1
        self.rotation = np.linalg.qr(rng.normal(size=(d, d)))[0]
        points = self.candidates(sample)
        lists = max(1, min(MAX_LISTS, round(math.sqrt(n_classes) / 2), len(points)))
        self.centroids = points[rng.choice(len(points), lists, replace=False)]
        for _ in range(10):
            at = self.nearest(points, 1)[:, 0]
            sums = np.zeros_like(self.centroids)
            np.add.at(sums, at, points)
            count = np.bincount(at, minlength=lists)
            self.centroids = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], self.centroids)
        self.probes = self._probes(sample, points)

    def candidates(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(self.max_norm**2 - (x * x).sum(1), 0))[:, None]]) @ self.rotation

    def queries(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.zeros((len(x), 1))]) @ self.rotation

    def nearest(self, points: np.ndarray, p: int) -> np.ndarray:
        """The p nearest lists of each point, nearest first."""
        out = []
        for part in np.array_split(points, max(1, math.ceil(len(points) / 4096))):
            near = 0.5 * (self.centroids**2).sum(1) - part @ self.centroids.T
            out.append(near.argmin(1)[:, None] if p == 1 else np.argsort(near, axis=1, kind="stable")[:, :p])
        return np.vstack(out)

    def _probes(self, sample: np.ndarray, points: np.ndarray) -> int:
        """The fewest lists whose candidates hold the target share of the sample's true neighbours."""
        lists = len(self.centroids)
        asked = sample[:: max(1, len(sample) // 512)][:512]
        if len(sample) <= self.k + 1 or lists == 1:
            return lists
        true = np.argsort(-(asked @ sample.T), axis=1, kind="stable")[:, 1 : self.k + 1]
        order = np.argsort(self.nearest(self.queries(asked), lists), axis=1)
        rank = np.take_along_axis(order, self.nearest(points, 1)[:, 0][true], axis=1)
        return int(np.quantile(rank, TARGET, method="higher")) + 1


def top(query: np.ndarray, candidate: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best, ties to the smaller candidate."""
    order = np.lexsort((candidate, -score, query))
    q = query[order]
    first = np.concatenate([[True], q[1:] != q[:-1]]) if len(q) else np.zeros(0, bool)
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0)) if len(q) else q
    return order[rank < k]


def adaptive_scan(queries: np.ndarray, radius: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) whose distance, as far as the tests can tell, is within the query's radius."""
    d = block.shape[1]
    edges = [*range(0, d, COLUMN_BLOCK), d]
    if len(edges) > 2 and edges[-1] - edges[-2] < COLUMN_BLOCK // 2:
        del edges[-2]
    limit = radius**2 * (1 + 1e-6) + 1e-9
    q0, b0 = queries[:, : edges[1]], block[:, : edges[1]]
    part = (q0 * q0).sum(1)[:, None] + (b0 * b0).sum(1) - 2 * q0 @ b0.T
    allowed = lambda m: limit if m == d else limit * (m / d) * (1 + EPSILON / math.sqrt(m)) ** 2
    qi, ci = np.nonzero(part <= allowed(edges[1])[:, None])
    left = part[qi, ci]
    for lo, hi in zip(edges[1:-1], edges[2:], strict=True):
        diff = queries[qi, lo:hi] - block[ci, lo:hi]
        left = left + np.einsum("ij,ij->i", diff, diff)
        keep = left <= allowed(hi)[qi]
        qi, ci, left = qi[keep], ci[keep], left[keep]
    return qi, ci


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b)


def _listed(index: Index):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if batch.num_rows:
                at = index.nearest(index.candidates(_matrix(batch.column(1))), 1)[:, 0]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at.astype(np.int32)), batch.column(1)], ["class_id", "list", "vector"])

    return run


def _asked(index: Index, sample_ids: np.ndarray, sample: np.ndarray):
    """For each query class its radius, the lists to probe and its best of the sample."""
    points = index.candidates(sample)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in source:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                x = _matrix(batch.column(1))
                q = index.queries(x)
                ids = batch.column(0).to_numpy()
                k = min(index.k + 1, len(sample))
                best = np.argpartition(-(x @ sample.T), k - 1, axis=1)[:, :k]
                score = np.stack([_dot(np.broadcast_to(v, (k, len(v))), sample[b]) for v, b in zip(x, best, strict=True)])
                far = ((q[:, None, :] - points[best]) ** 2).sum(2)
                enough = k > index.k
                radius = np.sqrt(far.max(1)) if enough else np.full(len(x), np.inf)
                lists = index.nearest(q, index.probes).astype(np.int32)
                seeds = [[{"class_id": int(c), "score": float(s)} for c, s in zip(sample_ids[b], row, strict=True)] for b, row in zip(best, score, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), batch.column(1), pa.array(radius), pa.array(list(lists), pa.list_(pa.int32())), pa.array(seeds, pa.list_(pa.struct([("class_id", pa.int64()), ("score", pa.float64())])))],
                    ["query_class", "vector", "radius", "probes", "seeds"],
                )

    return run


def _searched(index: Index):
    """Rows by list and block, its candidates first, then its queries: the block is held, queries stream past."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, vectors_, ready = None, [], [], None
        for batch in source:
            keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)] if len(keys) else [0]
            for lo, hi in zip(edges, edges[1:], strict=False):
                part, key = batch.slice(lo, hi - lo), tuple(keys[lo][:2])
                if key != held:
                    held, ids, vectors_, ready = key, [], [], None
                if keys[lo][2] == 0:
                    ids.append(part.column(3).to_numpy())
                    vectors_.append(_matrix(part.column(4)))
                    continue
                if not ids:
                    continue
                if ready is None:
                    ready = np.concatenate(ids), np.vstack(vectors_)
                    points = index.candidates(ready[1])
                q_ids, x, radius = part.column(3).to_numpy(), _matrix(part.column(4)), part.column(5).to_numpy()
                q = index.queries(x)
                for at in range(0, len(x), 64):
                    qi, ci = adaptive_scan(q[at : at + 64], radius[at : at + 64], points)
                    score = _dot(x[at + qi], ready[1][ci])
                    best = top(qi, ready[0][ci], score, index.k + 1)
                    if len(best):
                        yield pa.RecordBatch.from_arrays([pa.array(q_ids[at + qi[best]]), pa.array(ready[0][ci[best]]), pa.array(score[best])], ["query_class", "class_id", "score"])

    return run


def search(rows: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: for each row of rows (vec_id, vector) for which
    is_query holds, the k other rows with the largest inner products found."""
    asking = rows.select("vec_id", "vector", is_query.alias("asked"))
    if rows.groupBy("vec_id").count().filter("count > 1").isEmpty():
        return _search(asking, k)
    # Where ids repeat, rows are numbered in the order of their ids, and go by these numbers.
    numbered = stored(asking.orderBy("vec_id").withColumn("row_no", F.monotonically_increasing_id()))
    found = _search(numbered.select(F.col("row_no").alias("vec_id"), "vector", "asked"), k)
    named = lambda column: numbered.select(F.col("row_no").alias(column), F.col("vec_id").alias(f"{column}_id"))
    back = found.withColumnRenamed("query_id", "query").withColumnRenamed("vec_id", "vec").join(named("query"), "query").join(named("vec"), "vec")
    return back.select("query_id", "rank", "vec_id", "score")


def _search(rows: DataFrame, k: int) -> DataFrame:
    """search of rows with ids that don't repeat."""
    classes = stored(
        rows.withColumn("n", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id")))
        .filter(F.col("n") <= k + 1)
        .groupBy("vector")
        .agg(F.min("vec_id").alias("class_id"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    )
    asked = stored(rows.filter("asked").join(classes.select("vector", "class_id"), "vector").select(F.col("class_id").alias("query_class"), F.col("vec_id").alias("query_id"), "vector"))
    empty = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n = classes.count()
    if not n:
        return empty
    # Ordered by a hash, so that the sample doesn't depend on where rows lie.
    spread = F.xxhash64("class_id")
    share = min(1.0, 1.1 * FIT_ROWS / n + 100 / n)
    sample = classes.filter(F.pmod(spread, F.lit(1 << 20)) < int(share * (1 << 20))).select("class_id", "vector").orderBy(spread).limit(FIT_ROWS).collect()
    x, sample_ids = np.array([r["vector"] for r in sample]), np.array([r["class_id"] for r in sample])
    max_norm = math.sqrt(classes.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda a, v: a + v * v))).first()[0])
    index = Index(x, max_norm, n, k)

    listed = stored(classes.select("class_id", "vector").mapInArrow(_listed(index), "class_id long, list int, vector array<double>"))
    blocks = F.ceil(F.col("count") / BLOCK_ROWS).cast("int")
    sizes = F.broadcast(listed.groupBy("list").count().select("list", blocks.alias("blocks")))  # MAX_LISTS rows at most
    asking = stored(
        asked.groupBy("query_class").agg(F.first("vector").alias("vector")).mapInArrow(
            _asked(index, sample_ids[:RADIUS_ROWS], x[:RADIUS_ROWS]), "query_class long, vector array<double>, radius double, probes array<int>, seeds array<struct<class_id long, score double>>"
        )
    )
    block_side = listed.join(sizes, "list").select("list", F.pmod(F.xxhash64("class_id"), "blocks").cast("int").alias("block"), F.lit(0).alias("kind"), F.col("class_id").alias("id"), "vector", F.lit(None).cast("double").alias("radius"))
    query_side = (
        asking.select("query_class", "vector", "radius", F.explode("probes").alias("list"))
        .join(sizes, "list")
        .select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), F.col("query_class").alias("id"), "vector", "radius")
    )
    dealt = block_side.unionByName(query_side).repartition("list", "block").sortWithinPartitions("list", "block", "kind")
    found = dealt.mapInArrow(_searched(index), "query_class long, class_id long, score double")
    seeds = asking.select("query_class", F.inline("seeds"))
    # Scores of one pair are equal on both ways, as they come from the same sum.
    merged = found.unionByName(seeds).groupBy("query_class", "class_id").agg(F.max("score").alias("score"))
    near = Window.partitionBy("query_class")
    merged = merged.withColumn("n", F.row_number().over(near.orderBy(F.desc("score"), "class_id"))).filter(F.col("n") <= k + 1)
    spelled = merged.join(classes.select("class_id", "ids"), "class_id").select("query_class", "score", F.explode("ids").alias("vec_id"))
    spelled = spelled.withColumn("n", F.row_number().over(near.orderBy(F.desc("score"), "vec_id"))).filter(F.col("n") <= k + 1)
    lists = spelled.groupBy("query_class").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))).alias("near"))
    each = asked.select("query_class", "query_id").join(lists, "query_class")
    others = F.slice(F.filter("near", lambda c: c["vec_id"] != F.col("query_id")), 1, k)
    out = each.select("query_id", F.posexplode(others).alias("at", "c"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("c.vec_id").alias("vec_id"), (-F.col("c.minus")).alias("score"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0)
