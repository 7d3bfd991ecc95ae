"""Removal of what repeats: every byte that a string of 200 bytes covers which also starts elsewhere, in any document.

The strings are told apart by a suffix order with common prefixes, made column by column: `Collection` takes many short texts and in
each round inserts one symbol of each, from the last to the first. Its state are two sequences, the collection's
Burrows-Wheeler transform and the lengths of common prefixes of neighbours; each round reads both from start to end and writes both anew,
longer by a symbol a text. Where a suffix and a neighbour share 200 bytes, its first 200 repeat. The sequences of a collection are
bounded, so they are kept in the memory of the task instead of files of its machine, which no other executor could see.

Whole documents would need as many rounds as the longest has bytes, each over all that was written, so the texts of the
collections are pieces. A string of 200 bytes has one smallest gram of 64 bytes (by hash); strings in a row that have the same one make a
piece, at most PIECE_STARTS of them. Equal strings have the same smallest gram, so they are in pieces of one gram, and every string is in exactly one
piece. Grams of one piece only need nothing more. Equal pieces are counted by aggregation, so copies and passages that a third of all
documents share shrink to one piece before anything is gathered, and a gram of one distinct piece is settled by its count. The
other distinct pieces are dealt by gram into collections. A gram with over HOT_PIECES distinct pieces, such as where a common passage meets
as many different texts, is not gathered: its pieces are cut into their strings, whose digests are counted.

Plan: documents are scanned three times (pieces, texts that have repeats, result) and known by a digest of their text, so exact copies go
as one. Shuffles: the grams' counts; pieces against them; distinct texts once, and those with repeats twice more. Joins on hot keys are plain
joins, which adaptive execution splits; groupings combine before they shuffle. Nothing is broadcast by size unseen, nothing goes to the driver.

Cases: null texts are empty; an empty text keeps nothing and has the digest of nothing; texts under 200 bytes lose nothing; a text of one byte
over and over repeats within itself; very long texts are cut in blocks for hashing; rows of equal ids are rows of their own, null
ids too; an empty table gives no rows; other columns are ignored. Digests of pieces and texts have 128 bits and are taken as equality.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refsift.llm.common import bounded_batches, dropped, lean, stored, table

LENGTH, GRAM, HOT_PIECES, COLLECTION_BYTES, HASH_BLOCK, WIDTHS = 200, 64, 4096, 60_000, 1 << 17, (8, 4, 2, 1)
#: How many pieces a task puts in order, on the whole.
TASK_PIECES = 4096
#: A piece holds as many starts as the strings that can share one gram's place.
PIECE_STARTS = LENGTH - GRAM + 1


class Collection:
    """Suffixes of many texts in order, built by inserting one symbol of each text a round, from its end.

    symbols: what precedes each suffix (0: nothing, the suffix is a whole text); common: how many symbols each shares with the one before,
    at most as many as `most` bytes have. Symbols are the widest of WIDTHS (bytes) whose values fit 16 bits; with a width above 1, a
    text is taken once from each of its first `width` bytes, so every start is one of a symbol.
    """

    def __init__(self, texts: list[bytes], most: int):
        whole = np.frombuffer(b"".join(texts), np.uint8)
        for width in (w for w in WIDTHS if most % w == 0):
            values, codes = np.unique(_joined(whole, width), return_inverse=True)
            if len(values) < 1 << 16:
                break
        self.width, self.most, self.codes = width, most // width, np.append(codes, 0).astype(np.uint16) + np.uint16(1)
        self.lengths, self.bytes = np.array([len(t) for t in texts], np.int64), most
        phase = np.tile(np.arange(width), len(texts))
        self.begins = np.repeat(np.cumsum(self.lengths) - self.lengths, width) + phase
        self.sizes = np.maximum(np.repeat(self.lengths, width) - phase, 0) // width
        self.m, self.rounds = len(self.sizes), int(self.sizes.max(initial=0))
        self.symbols, self.common = self._before(np.arange(self.m), 0), np.zeros(self.m, np.uint8)
        who = at = np.flatnonzero(self.sizes > 0)
        for done in range(1, self.rounds + 1):
            who, at = self._insert(who, at, done)
            going = self.sizes[who] > done
            who, at = who[going], at[going]

    def _before(self, who: np.ndarray, done: int) -> np.ndarray:
        """The symbol before the last `done` ones of each text."""
        next_ = self.sizes[who] - done - 1
        return np.where(next_ >= 0, self.codes[np.where(next_ >= 0, self.begins[who] + next_ * self.width, -1)], 0).astype(np.uint16)

    def _insert(self, who: np.ndarray, at: np.ndarray, done: int) -> tuple[np.ndarray, np.ndarray]:
        """Each text's suffix of one symbol more. at: places of the last ones, ascending, of texts who. Gives the new ones likewise."""
        n = len(self.symbols)
        order = np.argsort(self.symbols, kind="stable")  # suffixes by what precedes them: the order of the longer ones
        last = np.zeros(n, bool)
        last[at] = True
        rank = np.flatnonzero(last[order])
        place = order[rank]
        of = np.searchsorted(at, place)
        symbol = self.symbols[place]
        new = self.m + rank - (n - np.count_nonzero(self.symbols))
        before, after = order[np.maximum(rank - 1, 0)], order[np.minimum(rank + 1, n - 1)]
        follows, followed = (rank > 0) & (self.symbols[before] == symbol), (rank < n - 1) & (self.symbols[after] == symbol)
        earlier, later = np.full(len(at), -1), np.full(len(at), -1)
        earlier[of[follows]], later[of[followed]] = before[follows], after[followed]
        held = np.append(self.common, np.uint8(0))
        to_earlier, to_later = self._shared(held, earlier + 1, at, earlier >= 0)[of], self._shared(held, at + 1, later, later >= 0)[of]

        old = np.ones(n + len(new), bool)
        old[new] = False
        symbols, common = np.empty(len(old), np.uint16), np.empty(len(old), np.uint8)
        symbols[old], common[old] = self.symbols, self.common
        who = who[of]
        symbols[new], common[new] = self._before(who, done), to_earlier
        common[new[followed] + 1] = to_later[followed]
        self.symbols, self.common = symbols, common
        return who, new

    def _shared(self, common: np.ndarray, lo: np.ndarray, hi: np.ndarray, there: np.ndarray) -> np.ndarray:
        """One more than the least common prefix from lo to hi, 0 where there is no such neighbour."""
        out = np.zeros(len(lo), np.uint8)
        if there.any():
            bounds = np.stack([lo[there], hi[there] + 1], axis=1).ravel()
            out[there] = np.minimum(np.minimum.reduceat(common, bounds)[::2], self.most - 1) + 1
        return out

    def repeated(self) -> list[np.ndarray]:
        """For each text and each start of a string of `most` bytes in it, whether the string starts elsewhere in the collection too."""
        n = len(self.symbols)
        order = np.argsort(self.symbols, kind="stable")
        longer = np.empty(n, np.int64)
        longer[order] = self.m + np.arange(n) - (n - np.count_nonzero(self.symbols))
        full = self.common >= self.most
        twice = full | np.append(full[1:], False)
        starts = np.maximum(self.lengths - self.bytes + 1, 0)
        ends = np.cumsum(starts)
        flat = np.zeros(int(starts.sum()), bool)
        first, phase = np.repeat(ends - starts, self.width), np.tile(np.arange(self.width), len(starts))
        who = at = np.arange(self.m)
        for done in range(1, self.rounds + 1):
            going = self.sizes[who] >= done
            who = who[going]
            at = longer[at[going]]
            if done >= self.most:
                flat[first[who] + phase[who] + (self.sizes[who] - done) * self.width] = twice[at]
        return np.split(flat, ends[:-1])


def _joined(b: np.ndarray, width: int) -> np.ndarray:
    """From each byte on, `width` bytes as one number; the last ones are followed by zeros."""
    h, n = b.astype(np.uint64), 1
    while n < width:
        h, n = (h << np.uint64(8 * n)) | np.append(h[n:], np.zeros(min(n, len(h)), np.uint64)), n * 2
    return h


def gram_hashes(text: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A hash of every `size` bytes (a power of two): hashes of halves are joined until they have that length."""
    h, n, factor = text.astype(np.uint64) + np.uint64(1), 1, np.uint64(0xD6E8FEB86659FD93)
    with np.errstate(over="ignore"):
        while n < size:
            h = h[:-n] * factor + h[n:] if len(h) > n else h[:0]
            factor, n = factor * factor, n * 2
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def least_in_windows(h: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while n * 2 <= width:
        h, n = np.minimum(h[:-n], h[n:]), n * 2
    more = width - n
    return np.minimum(h[: len(h) - more], h[more:]) if more else h


def pieces_of(block: bytes, ends: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """block: texts one after another. Gram hash, first start, how many starts, and whether the gram is in it twice, of pieces that hold
    each start of a string inside a text once."""
    whole, most = np.frombuffer(block, np.uint8), length - gram + 1
    none = np.zeros(0, np.int64)
    if len(whole) < length:
        return none, none, none, none.astype(bool)
    h = gram_hashes(whole, gram)
    least = least_in_windows(h, most)
    inside = np.ones(len(whole), bool)
    for end in ends.tolist():
        inside[max(0, end - length + 1) : end] = False
    inside = inside[: len(least)]
    edge = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])))
    run = np.diff(np.append(edge, len(least)))
    edge, run = edge[inside[edge]], run[inside[edge]]
    if (run > most).any():  # a gram that comes again before its place is left
        parts = -(-run // most)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        edge, run = np.repeat(edge, parts) + nth * most, np.minimum(np.repeat(run, parts) - nth * most, most)
    windows = np.lib.stride_tricks.sliding_window_view(h, most)
    first, last = windows[edge], windows[edge + run - 1]
    value = least[edge]
    again = edge + (first == value[:, None]).argmax(1) != edge + run - 1 + most - 1 - (last == value[:, None])[:, ::-1].argmax(1)
    return value.view(np.int64), edge, run, again


def _digest(b: bytes, size: int) -> bytes:
    return hashlib.blake2b(b, digest_size=size).digest()


# What tasks do. A place packs a piece's first start, how many starts it has, and whether its gram is in it twice.

PIECES = pa.schema([("d", pa.binary()), ("gram", pa.int64()), ("piece", pa.int64()), ("place", pa.int64())])


def _place(start: np.ndarray, count: np.ndarray, again: np.ndarray) -> np.ndarray:
    return start << 10 | count << 1 | again


def _cut(length: int):
    """Texts (d, text) to their pieces."""

    def of(texts: list[tuple[bytes, int, bytes]]) -> pa.RecordBatch:
        block = b"".join(t for _, _, t in texts)
        ends = np.cumsum([len(t) for _, _, t in texts])
        gram, start, count, again = pieces_of(block, ends, length)
        digests = b"".join([_digest(block[s:e], 8) for s, e in zip(start.tolist(), (start + count + length - 1).tolist(), strict=True)])
        owner = np.searchsorted(ends, start, "right")
        shift = np.array([at for _, at, _ in texts]) - (ends - [len(t) for _, _, t in texts])
        d = pa.array([d for d, _, _ in texts], pa.binary()).take(pa.array(owner))
        return pa.RecordBatch.from_arrays([d, pa.array(gram), pa.array(np.frombuffer(digests, np.int64)), pa.array(_place(start + shift[owner], count, again))], schema=PIECES)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in source:
            for d, text in zip(batch.column("d").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                for at in range(0, max(0, len(text) - length) + 1, HASH_BLOCK):
                    part = text[at : at + HASH_BLOCK + length - 1]
                    held.append((d, at, part))
                    size += len(part)
                    if size >= HASH_BLOCK:
                        yield of(held)
                        held, size = [], 0
        if held:
            yield of(held)

    return run


WANTED = pa.schema([("gram", pa.int64()), ("piece", pa.int64()), ("copies", pa.int64()), ("bytes", pa.binary())])


def _fetched(length: int):
    """Texts with the pieces wanted of them to these pieces' bytes."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for text, wanted in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("wanted"), strict=True):
                rows = wanted.as_py()
                for lo in range(0, len(rows), 4096):
                    part = rows[lo : lo + 4096]
                    cut = [text[w["place"] >> 10 : (w["place"] >> 10) + (w["place"] >> 1 & 511) + length - 1] for w in part]
                    yield pa.RecordBatch.from_arrays([pa.array([w[n] for w in part], pa.int64()) for n in ("gram", "piece", "copies")] + [pa.array(cut, pa.binary())], schema=WANTED)

    return run


FLAGS = pa.schema([("gram", pa.int64()), ("piece", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])
FLAGS_SQL = "gram long, piece long, lo int, hi int"


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of true ones."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2] - 1


def _in_collections(length: int):
    """Pieces, sorted by gram, to the starts that repeat. Whole grams are put together into collections of about COLLECTION_BYTES."""

    def of(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        found = Collection([r[3] for r in rows], length).repeated()
        runs = [_runs(f) for f in found]
        counts = [len(lo) for lo, _ in runs]
        pick = lambda i: pa.array(np.repeat(np.array([r[i] for r in rows], np.int64), counts))
        if sum(counts):
            yield pa.RecordBatch.from_arrays([pick(0), pick(1), *(pa.array(np.concatenate([r[i] for r in runs]).astype(np.int32)) for i in (0, 1))], schema=FLAGS)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in source:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= COLLECTION_BYTES and row[0] != held[-1][0]:
                    yield from of(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield from of(held)

    return run


STARTS = pa.schema([("string", pa.binary()), ("gram", pa.int64()), ("piece", pa.int64()), ("start", pa.int32()), ("copies", pa.int64())])


def _strings(length: int):
    """Pieces to a digest of each of their strings."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cut = [_digest(row[3][i : i + length], 16) for i in range(len(row[3]) - length + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(cut, pa.binary()), *(pa.array([row[i]] * len(cut), pa.int64()) for i in (0, 1)), pa.array(range(len(cut)), pa.int32()), pa.array([row[2]] * len(cut), pa.int64())], schema=STARTS)

    return run


def _kept(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the spans (lo, hi) to remove to how many bytes and runs go, and the digest of what is left."""
    for batch in source:
        removed, runs, digests = [], [], []
        for text, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans"), strict=True):
            lo, hi = (spans.values.field(i).to_numpy().astype(np.int64) for i in (0, 1))
            by = np.argsort(lo, kind="stable")
            lo, hi = lo[by], np.maximum.accumulate(hi[by])
            new = np.append(True, lo[1:] > hi[:-1])
            first, last = lo[new], np.append(hi[:-1][new[1:]], hi[-1])
            digest, at = hashlib.sha256(), 0
            for a, b in zip(first.tolist(), last.tolist(), strict=True):
                digest.update(text[at:a])
                at = b
            digest.update(text[at:])
            removed.append(int((last - first).sum()))
            runs.append(len(first))
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string())], ["d", "n_removed", "n_spans", "kept_sha256"])


def removed_repeats(docs: DataFrame, length: int = LENGTH, hot_pieces: int = HOT_PIECES) -> DataFrame:
    """docs: doc_id and text. For each row doc_id, n_bytes, n_removed, n_spans and kept_sha256. length: from GRAM to 511."""
    if not GRAM <= length < 512:
        raise ValueError(f"length must be at least {GRAM} and below 512")
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("d", F.unhex(F.md5(F.col("text").cast("binary"))))
    long_enough = base.filter(F.octet_length("text") >= length).select("d", "text")

    pieces = stored(long_enough.mapInArrow(lean(_cut(length)), "d binary, gram long, piece long, place long"))
    again = F.col("place").bitwiseAND(F.lit(1))
    often = pieces.groupBy("gram").agg(F.count("*").alias("n"), F.max(again).alias("again")).filter("n > 1 OR again = 1").select("gram")
    kept = stored(pieces.join(often, "gram"))
    dropped(pieces)

    distinct = stored(kept.groupBy("gram", "piece").agg(F.count("*").alias("copies"), F.first("d").alias("d"), F.first("place").alias("place")))
    grams = distinct.groupBy("gram").agg(F.count("*").alias("parts"), F.max(again).alias("again"))
    marked = stored(distinct.join(grams, "gram"))
    starts = F.shiftright("place", 1).bitwiseAND(F.lit(511))
    all_of = F.lit(0).alias("lo"), (starts - 1).cast("int").alias("hi")
    settled = (F.col("copies") > 1)
    whole = marked.filter(settled).select("gram", "piece", *all_of)
    open_ = marked.filter((F.col("parts") > 1) | (F.col("again") == 1))

    texts = stored(long_enough.groupBy("d").agg(F.first("text").alias("text")).join(kept.select("d").distinct(), "d", "left_semi"))
    wanted = open_.groupBy("d").agg(F.collect_list(F.struct("gram", "piece", "copies", "place")).alias("wanted"))
    with_bytes = texts.join(wanted, "d").select("text", "wanted").mapInArrow(lean(_fetched(length)), "gram long, piece long, copies long, bytes binary")
    fetched = stored(with_bytes.join(grams.select("gram", (F.col("parts") > hot_pieces).alias("hot")), "gram"))
    parts = ["gram", "piece", "copies", "bytes"]
    # By rows, not by bytes: an order costs far more than reading its pieces.
    tasks = max(1, -(-fetched.count() // TASK_PIECES))
    dealt = fetched.filter("NOT hot").select(*parts).repartition(tasks, "gram").sortWithinPartitions("gram")
    by_order = dealt.mapInArrow(lean(_in_collections(length)), FLAGS_SQL)
    strings = stored(fetched.filter("hot").select(*parts).mapInArrow(lean(_strings(length)), "string binary, gram long, piece long, start int, copies long"))
    twice = strings.groupBy("string").agg(F.sum("copies").alias("n")).filter("n > 1")
    by_count = strings.join(twice, "string").select("gram", "piece", F.col("start").alias("lo"), F.col("start").alias("hi"))
    found = whole.unionByName(by_order.unionByName(by_count).join(marked.filter(settled).select("gram", "piece"), ["gram", "piece"], "left_anti"))
    flags = stored(found.groupBy("gram", "piece").agg(F.collect_list(F.struct("lo", "hi")).alias("runs")))

    start = F.shiftright("place", 10)
    spans = kept.join(flags, ["gram", "piece"]).select("d", start.alias("start"), F.explode("runs").alias("run"))
    spans = spans.groupBy("d").agg(F.collect_set(F.struct((F.col("start") + F.col("run.lo")).alias("lo"), (F.col("start") + F.col("run.hi") + length).alias("hi"))).alias("spans"))
    cut = stored(texts.join(spans, "d").select("d", "text", "spans").mapInArrow(lean(_kept), "d binary, n_removed long, n_spans long, kept_sha256 string"))
    none = F.lit(0).cast("long")
    rows = base.select("doc_id", "d", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("whole"))
    return rows.join(cut, "d", "left").select("doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
