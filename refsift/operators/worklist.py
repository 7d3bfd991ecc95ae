"""Which entries to check: cited, missing and unused keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A citation of this key cites all entries.
WILDCARD = "*"


def cited_keys(*scans: DataFrame) -> DataFrame:
    """The union of the citations of several files."""
    out = scans[0].select("key")
    for other in scans[1:]:
        out = out.unionByName(other.select("key"))
    return out.distinct()


def work_list(entries: DataFrame, cited: DataFrame | None = None, check_unused: bool = False) -> DataFrame:
    """The entries to check, all of them without citations."""
    return entries if cited is None or check_unused else entries.join(cited.select("key").distinct(), "key", "left_semi")


def missing_keys(entries: DataFrame, cited: DataFrame) -> DataFrame:
    """Cited keys without an entry; here the wildcard is a key like any other."""
    return cited.select("key").distinct().join(entries.select("key"), "key", "left_anti")


def unused_entries(entries: DataFrame, cited: DataFrame) -> DataFrame:
    """Entries that nothing cites; none if everything is cited by the wildcard."""
    wild = cited.filter(F.col("key") == WILDCARD).select(F.lit(True).alias("wild")).limit(1)
    unused = entries.join(cited.select("key").distinct(), "key", "left_anti")
    return unused.join(F.broadcast(wild), F.lit(True), "left_anti")


def capped(entries: DataFrame, most: int) -> DataFrame:
    """The first entries by key, and how many were left out, as `truncated`."""
    whole = entries.count()
    return entries.orderBy("key").limit(most).withColumn("truncated", F.lit(max(0, whole - most)).cast("long"))
