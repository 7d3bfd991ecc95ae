"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

PREFIX = "refsift-"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where it is unset, a local master gets a temporary folder; a cluster gets an error,
    since a machine's own folder would lose rows there.
    """
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if place is None:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        place = kept.get() if kept.isDefined() else None
    if place is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        place = tempfile.mkdtemp(prefix="refsift-checkpoints-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(place)
    return place


#: Paths of the tables that are written while a scratch() is open, those to be kept apart.
_OPEN: ContextVar[tuple[list[str], list[str]] | None] = ContextVar("open", default=None)


def stored(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write to the shared folder and read back: lineage ends there, and lost executors cost nothing. The table goes when the
    scratch() around it closes (that around this one, with keep), or else when the driver ends, if dropped() hasn't deleted it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{PREFIX}{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    if (now := _OPEN.get()) is not None:
        now[keep].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside go at the end, but for those to be kept, which then belong to the scratch around this one, if there is one."""
    outer, own = _OPEN.get(), ([], [])
    token = _OPEN.set(own)
    try:
        yield
    finally:
        _OPEN.reset(token)
        for path in own[False]:
            _delete(spark, path)
        if outer is not None:
            outer[False].extend(own[True])


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def dropped(df: DataFrame) -> None:
    """Delete a table that stored() wrote, once nothing reads it any more; other tables are left alone."""
    for file in df.inputFiles()[:1]:
        path = file.rpartition("/")[0]
        if path.rpartition("/")[2].startswith(PREFIX):
            _delete(df.sparkSession, path)
