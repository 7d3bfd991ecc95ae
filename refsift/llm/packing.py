"""Bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows. A document's ids are cut into whole
windows and a rest; the rest goes to the open window that it fits best. Where none fits, a new
window opens, or, if as many are open as may be, the fullest is topped up with the rest's head
and emitted. At the end the windows still open are merged into full ones, and what is left is
cut at powers of two, where sequences need no padding: nothing is padded at all.

Plan: no shuffle; one pass over the scan's partitions. A worker holds its open windows, one
batch of texts and a bounded cache of word encodings. sequence_id is the partition's number and
a counter within it, so that a task that runs again gives the same rows.

Cases: null and empty texts are documents of the end id alone; null doc_ids, ties and repeated
rows are packed like any other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import string
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from refsift.llm.common import batches, lean, table, text_rows

#: Words whose encodings a task keeps.
CACHE_WORDS = 400_000


#: The characters that stand for bytes in byte-level vocabularies: printable Latin-1 as itself, the rest from 256 up.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = dict(zip(_PLAIN, map(chr, _PLAIN), strict=True)) | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PLAIN)))}
_PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]
#: What may stand after a word as one piece: ASCII punctuation, but the apostrophe.
_TAIL = string.punctuation.replace("'", "")


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordEncoder:
    """Ids of whole texts by a lower-casing byte-level tokenizer whose pieces never reach over white space.

    Such a text's ids are its words' ids in order; each distinct word is encoded once. bytes.split()
    splits at ASCII white space only, which is white space to the tokenizer too; any other stays
    inside a word and is the tokenizer's to handle. Words of Latin letters with ASCII
    punctuation after them, most by far, go straight to the tokenizer's model, the rest through all of it.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.cache_words = cache_words
        self.words = _Words(self)
        self.parts: dict[str, bytes] = {}

    def part(self, piece: str) -> bytes:
        known = self.parts.get(piece)
        if known is None:
            mapped = piece if piece.isascii() else "".join([_BYTE_CHARS[b] for b in piece.encode()])
            tokens = self.model.tokenize(mapped)
            known = self.parts[piece] = _PACK[len(tokens)](*[t.id for t in tokens]) if len(tokens) < len(_PACK) else _packed([t.id for t in tokens])
        return known

    def word(self, word: bytes) -> bytes:
        text = word.decode().lower()
        core = text.rstrip(_TAIL)
        if core.isalpha() and (core.isascii() or max(core) < "\u0250"):
            return self.part(core) + self.part(text[len(core) :]) if len(core) < len(text) else self.part(core)
        return _packed(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids)

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        for text in texts:
            yield b"".join(map(self.words.__getitem__, text.split()))
            self.words.age(self.cache_words // 2)
            if len(self.parts) > self.cache_words:
                self.parts.clear()


class _Words(dict):
    """Encodings by word, in two generations: when the young one is full, the old one goes."""

    def __init__(self, owner: WordEncoder):
        self.owner, self.old = owner, {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.owner.word(word)
        self[word] = ids
        return ids

    def age(self, limit: int) -> None:
        if len(self) > limit:
            self.old = dict(self)
            self.clear()


class Packer:
    """The windows of one partition. Pieces are (doc_id, start, ids, doc_tokens)."""

    def __init__(self, first_id: int, capacity: int = 2048, open_windows: int = 32):
        self.capacity, self.open_windows, self.next_id = capacity, open_windows, first_id
        self.windows: list[tuple[int, list]] = []

    def _emit(self, pieces: list) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, ids, total in pieces:
            yield doc_id, start, len(ids) // 4, zlib.crc32(ids), total, self.next_id, offset, ids
            offset += len(ids) // 4
        self.next_id += 1

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple]:
        total, at = len(ids) // 4, 0
        while total - at >= self.capacity:
            yield from self._emit([(doc_id, at, ids[4 * at : 4 * (at + self.capacity)], total)])
            at += self.capacity
        while at < total:
            size = total - at
            best = max((w for w in range(len(self.windows)) if self.windows[w][0] + size <= self.capacity), key=lambda w: self.windows[w][0], default=None)
            if best is None and len(self.windows) < self.open_windows:
                self.windows.append((size, [(doc_id, at, ids[4 * at :], total)]))
                return
            if best is None:
                best = max(range(len(self.windows)), key=lambda w: self.windows[w][0])
                size = self.capacity - self.windows[best][0]
            fill, pieces = self.windows[best]
            pieces.append((doc_id, at, ids[4 * at : 4 * (at + size)], total))
            at += size
            if fill + size == self.capacity:
                del self.windows[best]
                yield from self._emit(pieces)
            else:
                self.windows[best] = (fill + size, pieces)

    def finish(self) -> Iterator[tuple]:
        """Merge what is open: full sequences first, then one for each power of two in what is left."""
        left = sum(fill for fill, _ in self.windows)
        sizes = [self.capacity] * (left // self.capacity) + [1 << k for k in reversed(range(self.capacity.bit_length())) if left % self.capacity >> k & 1]
        held, room = [], sizes.pop(0) if sizes else 0
        for _, pieces in sorted(self.windows, key=lambda w: -w[0]):
            for doc_id, start, ids, total in pieces:
                while ids:
                    part, ids = ids[: 4 * room], ids[4 * room :]
                    held.append((doc_id, start, part, total))
                    start, room = start + len(part) // 4, room - len(part) // 4
                    if not room:
                        yield from self._emit(held)
                        held, room = [], sizes.pop(0) if sizes else 0
        self.windows = []


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, open_windows: int = 32, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents: doc_id, start (ids of the document before it), length, ids_crc32,
    doc_tokens, sequence_id, offset in the sequence and, unless with_ids is false, input_ids.

    capacity must be a power of two.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    end = np.array([end_id], "<u4").tobytes()

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << 33, capacity, open_windows)
        encode = WordEncoder(tokenizer_path).encode

        def rows() -> Iterator[tuple]:
            for batch in source:
                for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                    yield from packer.add(doc_id, ids + end)
            yield from packer.finish()

        if with_ids:
            shaped = ((*r[:7], np.frombuffer(r[7], "<u4").astype("<i4")) for r in rows())
            yield from batches(shaped, PIECES.append(pa.field("input_ids", pa.list_(pa.int32()))), max_rows=1024)
        else:
            yield from batches((r[:7] for r in rows()), PIECES)

    source = text_rows(docs)
    return source.select("doc_id", F.col("text").cast("binary")).mapInArrow(lean(run), PIECES_DDL + ", input_ids array<int>" * with_ids)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
