"""What the operators of this package share: reading tables, shared storage, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refsift.shared import dropped, shared_dir, stored  # noqa: F401  for the operators


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of an Arrow batch, so that what a Python worker holds doesn't follow the length of texts.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = re.match(r"-?\d+", spark.conf.get(key))
        if not now or not 0 < int(now[0]) <= most:
            spark.conf.set(key, str(most))


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def lean(run: Run) -> Run:
    """run, and after it memory given back: Python workers outlive their tasks, and share the executor's memory."""

    def trimmed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(source)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return trimmed


def text_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only (doc_id, text), null texts as empty ones; other columns, whatever their names, don't matter."""
    bounded_batches(docs.sparkSession)
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))


def kept_rows(docs: DataFrame, predicate: Callable[[list[str]], Iterable[bool]], text: str = "text") -> DataFrame:
    """The rows of docs, with all columns, whose texts a Python predicate keeps; null texts are shown to it as empty."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            yield batch.filter(pa.array(list(predicate([t or "" for t in batch.column(at).to_pylist()])), pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def id_fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def id_fold_py(doc_id: int | None, mod: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % mod


def batches(rows: Iterable[tuple], schema: pa.Schema, max_rows: int = 4096, max_bytes: int = 8 << 20, sizes: int | None = None) -> Iterator[pa.RecordBatch]:
    """Arrow batches of tuples; sizes: the position of a text or bytes value whose length counts."""
    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += len(row[sizes] or "") if sizes is not None else 0
        if len(held) >= max_rows or weight >= max_bytes:
            yield _batch(held, schema)
            held, weight = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(col, type=field.type) for col, field in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
