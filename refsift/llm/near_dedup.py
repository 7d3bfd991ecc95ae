"""Near-duplicate documents by ProbMinHash, banding and exact verification.

Documents are bags of five-word shingles with weights 1 + ln(occurrences). In a ProbMinHash
signature each shingle is a Poisson process whose rate is its weight; every arrival falls into one of
REGISTERS registers, which keep the shingle of their first arrival. Shingles drop out as soon as
their next arrival comes after all registers' first. Two signatures agree in a register with the
probability Jaccard similarity as probability; without repeated shingles that is Jaccard's index.

Texts of equal words are one node, so exact copies cost one row however many they are. Nodes that
agree in one of BANDS bands of ROWS registers share a bucket: 0.8 similar ones miss each other with
probability 5e-5. Links are then sought without listing the pairs of a bucket:
- every node is verified against the smallest node of each of its buckets, and links are joined to
  components;
- buckets that still hold several components are cut in blocks, and each block of nodes outside the largest component
  meets each block in a tile, a task's work whose size doesn't follow the bucket's: every pair of different components whose signatures agree well
  enough to be similar at almost six standard deviations (all but 1e-8 of such pairs, next to what banding
  loses) is verified on the spot, in the first band that it shares, unless links found meanwhile have joined it.
Verified is always the exact similarity of both texts' shingles, and only links leave a task.

Plan: one pass over the texts writes a node, band keys and a signature for each document; other
passes read those columns alone. Texts are needed again only for nodes in shared buckets: a semi-join,
broadcast up to BROADCAST_ROWS nodes and shuffled beyond. Components are found by alternating
stars in the shared folder. No pair, component or signature reaches the driver.

Cases: null texts are empty; texts without words are copies only if their characters are equal; texts
of fewer than five words are one shingle; null doc_ids take part and are never a class's id unless it has
no other; repeated ids and rows are rows of their own; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refsift.llm.common import bounded_batches, dropped, lean, stored, table, text_rows
from refsift.llm.components import components
from refsift.llm.shingles import WordHashes, mixed, normal_key, probability_jaccard, shingles, text_shingles, weighted, words

REGISTERS, BANDS, ROWS, THRESHOLD = 128, 25, 5, 0.8
#: Signatures of pairs as similar as the threshold agree in less than this with probability 1e-8.
LEAST_AGREEMENT = 0.59
#: Tile (i, j) of a bucket has the number i * TILES + j.
TILES = 1 << 31
BLOCK_ROWS, BLOCK_CHARS, BROADCAST_ROWS, LARGE_CLASS = 768, 4 << 20, 1_000_000, 1024
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def signature(ids: np.ndarray, weights: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """The shingle that arrives first in each register (64 bits); ids must be distinct and not empty."""
    first = np.full(registers, np.inf)
    owner = np.zeros(registers, np.uint64)
    # Filling all registers takes about registers * ln(registers) arrivals; few shingles get several at once.
    step = max(1, -(-6 * registers // len(ids)))
    ids, rate, start, count = ids, weights, np.zeros(len(ids)), 0
    while len(ids):
        serial = np.arange(count, count + step, dtype=np.uint64)
        bits = mixed(ids[:, None] + (serial + np.uint64(1)) * _GOLDEN)
        gaps = -np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / rate[:, None]
        times = start[:, None] + np.cumsum(gaps, axis=1)
        at = (bits & np.uint64(registers - 1)).astype(np.int64).ravel()
        flat = times.ravel()
        order = np.argsort(flat, kind="stable")
        at, flat = at[order], flat[order]
        reached, where = np.unique(at, return_index=True)
        sooner = flat[where] < first[reached]
        reached, where = reached[sooner], where[sooner]
        first[reached] = flat[where]
        owner[reached] = np.repeat(ids, step)[order[where]]
        start, count = times[:, -1], count + step
        open_ = start < first.max()
        ids, rate, start = ids[open_], rate[open_], start[open_]
    return owner


def band_keys(owner: np.ndarray) -> np.ndarray:
    rows = owner[: BANDS * ROWS].reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        out = mixed(out * _GOLDEN + rows[:, k])
    return out.view(np.int64)


_SKETCH = pa.schema([("doc_id", pa.int64()), ("node", pa.binary()), ("bands", pa.list_(pa.int64())), ("signature", pa.binary())])
_SKETCH_DDL = "doc_id long, node binary, bands array<long>, signature binary"


def _sketches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    recent: OrderedDict[bytes, tuple] = OrderedDict()
    for whole in source:
        for lo in range(0, whole.num_rows, 1024):
            batch = whole.slice(lo, 1024)
            out = []
            for text in batch.column(1).to_pylist():
                parts = words(text)
                node = normal_key(text, parts)
                known = recent.get(node)
                if known is None:
                    known = node, None, None
                    if parts:
                        owner = signature(*weighted(shingles(hashes.of(parts))))
                        known = node, band_keys(owner), (owner >> np.uint64(32)).astype("<u4").tobytes()
                    recent[node] = known
                    if len(recent) > 512:
                        recent.popitem(last=False)
                out.append(known)
            nodes, bands, signatures = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(signatures, pa.binary())], schema=_SKETCH)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, node (16 bytes, equal for texts of equal words), bands and signature of every row."""
    return text_rows(docs).mapInArrow(lean(_sketches), _SKETCH_DDL)


def _verified(source: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (a, text of a, b, text of b), rows of one b mostly together."""
    hashes = WordHashes()
    recent: OrderedDict[bytes, tuple] = OrderedDict()

    def bag(node: bytes, text: str) -> tuple:
        if node not in recent:
            recent[node] = text_shingles(text, hashes)
            if len(recent) > 64:
                recent.popitem(last=False)
        return recent[node]

    for batch in source:
        a, ta, b, tb = (c.to_pylist() for c in batch.columns)
        keep = [(x, y) for x, tx, y, ty in zip(a, ta, b, tb, strict=True) if probability_jaccard(bag(x, tx), bag(y, ty)) >= threshold]
        if keep:
            xs, ys = zip(*keep, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.binary()), pa.array(ys, pa.binary())], ["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (a, b) those whose texts (node, text) are similar."""
    one = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = one.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "text_a", "b", "text_b").mapInArrow(lean(lambda it: _verified(it, threshold)), "a binary, b binary")


def _agreement(mine: np.ndarray, others: np.ndarray, band: int) -> np.ndarray:
    """In how many registers each of mine agrees with each of the others; none for pairs that share an
    earlier band, as they meet there too."""
    agree = np.zeros((len(mine), len(others)), np.int16)
    for k in range(band * ROWS):
        same = mine[:, k, None] == others[None, :, k]
        agree += same
        if k % ROWS == 0:
            whole = same
        else:
            whole &= same
        if k % ROWS == ROWS - 1:
            agree[whole] = -REGISTERS - 1
    for k in range(band * ROWS, mine.shape[1]):
        agree += mine[:, k, None] == others[None, :, k]
    return agree


def _buckets(source: Iterator[pa.RecordBatch], chunk: int = 256) -> Iterator[tuple[int, list[tuple], list[tuple], np.ndarray, np.ndarray]]:
    """Rows (band, key, tile, kind, ...), a block of outsiders first (kind 0), then rows of the whole bucket (2: outsiders too, else 1), as
    (band, the block, some of these rows, which of them are outsiders, agreement of these with the block). What
    follows kind is node, component and signature, then anything."""
    held, block, ready, stream, also = None, [], None, [], []

    def signatures(rows: list[tuple]) -> np.ndarray:
        return np.frombuffer(b"".join(r[2] for r in rows), "<u4").reshape(len(rows), -1)

    for batch in source:
        for band, key, number, kind, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (band, key, number) != held or len(stream) >= chunk:
                if stream and block:
                    ready = signatures(block) if ready is None else ready
                    yield held[0], block, stream, np.array(also), _agreement(signatures(stream), ready, held[0])
                stream, also = [], []
            if (band, key, number) != held:
                held, block, ready = (band, key, number), [], None
            if kind:
                stream.append(tuple(row))
                also.append(kind == 2)
            else:
                block.append(tuple(row))
    if stream and block:
        yield held[0], block, stream, np.array(also), _agreement(signatures(stream), signatures(block) if ready is None else ready, held[0])


_LEAST = int(np.ceil(LEAST_AGREEMENT * REGISTERS))


def _active(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which of the rows (node, component, signature) agree with one of another component: their band and node."""
    for band, block, stream, _, agree in _buckets(source):
        apart = np.array([r[1] for r in stream], object)[:, None] != np.array([r[1] for r in block], object)[None, :]
        near = (agree >= _LEAST) & apart
        nodes = sorted({stream[i][0] for i in np.flatnonzero(near.any(axis=1))} | {block[j][0] for j in np.flatnonzero(near.any(axis=0))})
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array([band] * len(nodes), pa.int32()), pa.array(nodes, pa.binary())], ["band", "node"])


def _links(source: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Verified links between the components of a bucket, from rows (node, component, signature, text). Pairs
    that earlier links have joined are left out, so there are fewer links than rows."""
    hashes = WordHashes()
    held, bags, parent = None, {}, {}

    def bag(row: tuple) -> tuple:
        if row[0] not in bags:
            bags[row[0]] = text_shingles(row[3], hashes)
        return bags[row[0]]

    def root(component: bytes) -> bytes:
        while parent.get(component, component) != component:
            component = parent[component]
        return component

    for _, block, stream, also, agree in _buckets(source):
        if block is not held:
            held, bags, parent = block, {}, {}
        found = []
        for i, row in enumerate(stream):
            near = np.flatnonzero(agree[i] >= _LEAST)
            for j in near[np.argsort(-agree[i][near], kind="stable")]:
                other = block[j]
                if (not also[i] or row[0] < other[0]) and root(row[1]) != root(other[1]) and probability_jaccard(bag(row), bag(other)) >= threshold:
                    found.append((other[0], row[0]))
                    parent[root(other[1])] = root(row[1])
        if len(bags) > len(block) + 512:
            bags.clear()
        if found:
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def remaining_links(members: DataFrame, labels: DataFrame, signatures: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links between different components of one bucket. members: band, key and node.

    Signatures alone first tell which nodes have a partner that may be similar; only these are dealt again,
    with their texts, and pairs are verified where their bucket is, so that no pair is ever a row.
    """
    known = stored(members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")))

    def sizes_of(rows: DataFrame, share: Column, chars: Column) -> DataFrame:
        """For each bucket its largest component, and how many blocks all its rows make, and those of other components (outsiders)."""
        parts = rows.groupBy("band", "key", "component").agg(F.count("*").alias("n"), F.sum(share).alias("share"), F.sum(chars).alias("chars"))
        largest = F.max(F.struct("n", "component", "share", "chars"))
        whole = parts.groupBy("band", "key").agg(F.sum("n").alias("n"), F.sum("share").alias("share"), F.sum("chars").alias("chars"), largest.alias("big"))
        blocks = lambda rows_, chars_: F.greatest(F.ceil(F.greatest(rows_, chars_)), F.lit(1)).cast("long")
        return whole.filter(F.col("n") > F.col("big.n")).select(
            "band", "key", "n", F.col("big.component").alias("big"), blocks(F.col("share"), F.col("chars")).alias("blocks"), blocks(F.col("share") - F.col("big.share"), F.col("chars") - F.col("big.chars")).alias("outer")
        )

    def dealt(rows: DataFrame, sizes: DataFrame, *columns: str) -> DataFrame:
        """Each outsider meets each row of its bucket in a tile of a block of outsiders and a block of all rows. Rows of the largest component
        don't meet each other, so what is dealt follows the rows, but for the product of outsiders' blocks with all blocks."""
        placed = rows.join(sizes, ["band", "key"])
        outsider = F.col("component") != F.col("big")
        own = lambda n: F.pmod(F.xxhash64("node"), n).cast("long")
        every = lambda n, place: F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), place)
        tile = lambda i, j, kind: F.struct((i * TILES + j).alias("tile"), kind.cast("int").alias("kind"))
        passing = every("outer", lambda i: tile(i, own(F.col("blocks")), F.when(outsider, 2).otherwise(1)))
        held = F.when(outsider, every("blocks", lambda j: tile(own(F.col("outer")), j, F.lit(0)))).otherwise(F.array().cast("array<struct<tile bigint, kind int>>"))
        each = placed.select("band", "key", F.inline(F.concat(passing, held)), *columns)
        return each.repartition("band", "key", "tile").sortWithinPartitions("band", "key", "tile", "kind")

    # Buckets of two have been verified with their smallest node.
    several = sizes_of(known, F.lit(1 / BLOCK_ROWS), F.lit(0.0)).filter("n > 2")
    first = dealt(known.join(signatures, "node"), several, "node", "component", "signature")
    active = first.mapInArrow(lean(_active), "band int, node binary").distinct()
    rows = stored(known.join(active, ["band", "node"]))
    whole = rows.join(signatures, "node").join(texts, "node")
    sizes = sizes_of(rows.join(texts.select("node", F.length("text").alias("chars")), "node"), F.lit(1 / BLOCK_ROWS), F.col("chars") / BLOCK_CHARS)
    second = dealt(whole, sizes, "node", "component", "signature", "text")
    return second.mapInArrow(lean(lambda it: _links(it, threshold)), "a binary, b binary").distinct()


def duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (the class's smallest doc_id), component (which tells classes apart that share that id, or have none),
    class_size (rows), node and kept (whether the row stands for its class) of every row."""
    sketched = stored(sketches(docs))
    nodes = sketched.filter(F.col("bands").isNotNull()).dropDuplicates(["node"])
    placed = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = placed.groupBy("band", "key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).filter(F.col("leader") != F.col("last")).drop("last")
    members = stored(placed.join(shared, ["band", "key"]))
    wanted = stored(members.select("node").distinct())
    small = wanted.count() <= BROADCAST_ROWS
    side = F.broadcast if small else lambda df: df
    ids = sketched.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    labels = None
    if not wanted.isEmpty():
        signatures = sketched.join(side(wanted), "node", "left_semi").select("node", "signature").dropDuplicates(["node"])
        signatures = stored(signatures)
        texts = stored(_texts(docs, ids, wanted, side))
        tried = stored(members.filter(F.col("node") != F.col("leader")).select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct())
        labels = components(stored(verified(tried, texts, threshold)))
        found = stored(remaining_links(members.select("band", "key", "node"), labels, signatures, texts, threshold))
        if not found.isEmpty():
            labels = components(found.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b"))))
        for done in (texts, signatures):
            dropped(done)
    rows = sketched.select("doc_id", "node")
    if labels is None:
        rows = rows.withColumn("component", F.col("node"))
    else:
        rows = rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = stored(rows)
    # The smallest id of all; without any, the smallest node.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "node")).alias("first")
    named = stored(rows.groupBy("component").agg(first, F.count("*").alias("class_size")))
    # Rows of a large class don't meet in one task: there are few such classes, and they go to where the rows are.
    large = named.filter(F.col("class_size") > LARGE_CLASS)
    if 0 < large.count() <= BROADCAST_ROWS:
        whole = rows.join(F.broadcast(large), "component").unionByName(rows.join(F.broadcast(large.select("component")), "component", "left_anti").join(named.filter(F.col("class_size") <= LARGE_CLASS), "component"))
    else:
        whole = rows.join(named, "component")
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("node") == F.col("first.node"))
    return whole.select("doc_id", F.col("first.doc_id").alias("class_id"), "component", "class_size", "node", is_first.alias("kept"))


def unique_documents(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of docs for each class, that with its smallest doc_id; all columns stay.

    Rows to drop are known by id and node. The set is broadcast up to BROADCAST_ROWS and joined by shuffle
    beyond; texts are shuffled for repeated rows alone.
    """
    classes = stored(duplicate_classes(docs, threshold))
    side = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    bounded_batches(docs.sparkSession)
    own = docs.select(F.struct("*").alias("row"), docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))

    def keyed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([normal_key(t, words(t)) for t in batch.column(2).to_pylist()], pa.binary())], ["row", "doc_id", "node"])

    rows = own.mapInArrow(lean(keyed), T.StructType([own.schema["row"], T.StructField("doc_id", T.LongType()), T.StructField("node", T.BinaryType())]))
    same = lambda other: rows["doc_id"].eqNullSafe(other["doc_id"]) & (rows["node"] == other["node"])
    gone = side(classes.filter("NOT kept").select("doc_id", "node").distinct())
    rows = rows.join(gone, same(gone), "left_anti")
    repeated = stored(classes.filter("kept").groupBy("doc_id", "node").count().filter("count > 1").select("doc_id", "node"))
    if not repeated.isEmpty():
        twice = side(repeated)
        once = rows.join(twice, same(twice), "left_semi").dropDuplicates(["doc_id", "node"])
        rows = rows.join(twice, same(twice), "left_anti").unionByName(once)
    return rows.select("row.*")


def _texts(docs: DataFrame, ids: DataFrame, wanted: DataFrame, side) -> DataFrame:
    """One text of each node wanted; the node is worked out again, as ids may repeat."""

    def keyed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            keys = [normal_key(t, words(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), batch.column(1)], ["doc_id", "node", "text"])

    kept = side(ids.join(wanted, "node", "left_semi"))
    rows = text_rows(docs).mapInArrow(lean(keyed), "doc_id long, node binary, text string")
    found = rows.join(kept.withColumnRenamed("doc_id", "kept"), "node").filter(F.col("doc_id").eqNullSafe(F.col("kept")))
    return found.select("node", "text").dropDuplicates(["node"])


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: its class, and how many documents that holds."""
    return duplicate_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")
