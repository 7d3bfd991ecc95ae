"""Connected components of a graph of links, by alternating large and small stars.

Each round replaces links by links to smaller nodes without changing what is connected; it ends
when every component is a star around its smallest node. Rounds are written to the shared folder,
which ends their lineage; the driver sees only a count and a checksum of each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refsift.llm.common import dropped, stored


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _to_smallest(links: DataFrame, larger_only: bool) -> DataFrame:
    """For each node a, its neighbours linked to the smallest of them and itself."""
    smallest = links.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    joined = links.join(smallest, "a")
    joined = joined.filter(F.col("b") > F.col("a")) if larger_only else joined
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _to_smallest(both, larger_only=True)


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    smallest = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = _to_smallest(down, larger_only=False).filter(F.col("a") != F.col("b"))
    return moved.unionByName(smallest.select("a", F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node in links (a, b) other than the smallest."""
    now = stored(links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(now)
    while state[0]:
        following = stored(_small_star(_large_star(now)).distinct())
        new = _state(following)
        dropped(now)
        now, done, state = following, new == state, new
        if done:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
