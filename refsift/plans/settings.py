"""Settings from the environment, and what exceeds them."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as yes.
YES = ("1", "true", "yes", "on")


def flag(name: str, default: bool, env: Mapping[str, str] = os.environ) -> bool:
    """Whether a variable says yes; the default where it is unset."""
    return env[name].strip().lower() in YES if name in env else default


def number(name: str, default: int, env: Mapping[str, str] = os.environ) -> int:
    """A variable's whole number; the default where it is unset or no number."""
    try:
        return int(env.get(name, ""))
    except ValueError:
        return default


@dataclass(frozen=True)
class Limits:
    """0 means no limit."""

    bytes_a_file: int = 0
    entries: int = 0

    @classmethod
    def from_environment(cls, env: Mapping[str, str] = os.environ) -> Limits:
        return cls(max(0, number("REFSIFT_MAX_FILE_BYTES", 0, env)), max(0, number("REFSIFT_MAX_ENTRIES", 0, env)))


def within_size(spark: SparkSession, path: str | list[str], limits: Limits) -> tuple[list[str], list[str]]:
    """Paths of the files there that may be read, and of those that are too large: by the sizes that the file system lists, so that no
    byte of a file that is too large is read."""
    sizes = spark.read.format("binaryFile").load(path).select("path", "length")
    if not limits.bytes_a_file:
        return [r["path"] for r in sizes.collect()], []
    told = sizes.select("path", (F.col("length") > limits.bytes_a_file).alias("over")).collect()
    return [r["path"] for r in told if not r["over"]], [r["path"] for r in told if r["over"]]


def too_large(files: DataFrame, limits: Limits) -> DataFrame:
    """files: file and text. Adds bytes and too_large; who reads them refuses those that are, and can say which."""
    size = F.octet_length(F.coalesce("text", F.lit("")))
    return files.select("*", size.alias("bytes"), (size > limits.bytes_a_file if limits.bytes_a_file else F.lit(False)).alias("too_large"))
