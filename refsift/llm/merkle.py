"""Merkle manifest of a dataset: a tree over the rows of each source, a tree over the sources, and a proof for each row.

A row's leaf is the digest of its fields. Leaves of a source in the order of their ids make runs of 16, each run's digest
is a node of the next level, and so on to the source's root; the sources' roots in their order make the last tree likewise.

DuckDB inside executors does the lower levels: rows are dealt in buckets of 16^3 positions, aligned so that a bucket is a whole
subtree, and go to it as Arrow tables of whole buckets; ordered string_agg and sha256 give level after level of all buckets in the table at once.
Spark combines the buckets' roots by the same rule (a 4096th of the rows, a join and a grouping a level), and what is left and right of a
node on each level above is joined back to its bucket. A second pass over the buckets folds every row from its leaf to the root.

Places: leaves are written, range-partitioned by source, id and a number of their own, sorted and written again; a row's place
in its source is that in its partition's part of the source plus the counts of the parts before, one row for each. So a source that
has a third of all rows, and an id that a third of all rows have, are dealt like any others. Texts are read once, for digests, and never
shuffled. The driver sees one root and counts. Executors need no files: buckets are held in memory, one table of about TABLE_ROWS rows at a time.

Cases: null fields count as `-`, so they differ from empty ones; rows of a null source are a source of their own, first; null ids come
first; rows of one id are ordered by their leaf (equal ones can't be told apart). Rows that are equal are leaves of their own.
A source of one row has its leaf as root, and a dataset of one source that source's root; a proof without siblings is the digest of nothing.
An empty table gives no rows. Very long texts are one value of a row, as in the table. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refsift.llm.common import stored, table

ARITY, BUCKET_LEVELS, TABLE_ROWS = 16, 3, 16_384
SIDES = "array<struct<lft string, rgt string>>"


def leaf_of(fields: list[Column]) -> Column:
    """Digest of fields: each `-` if null, else its length in bytes, a colon and the value."""
    told = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*told), 256)


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with pos, from 0 in each group, and n, the group's size. rows: a stored table."""
    own = F.monotonically_increasing_id()
    keys = [group, *order, "_own"]
    dealt = stored(rows.withColumn("_own", own).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", own).drop("_own"))
    part = F.shiftrightunsigned("_at", 33)
    parts = dealt.groupBy(group, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_count"))
    of_group = Window.partitionBy(group)
    before = of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(parts.select(F.col(group).alias("_group"), "_part", (F.coalesce(F.sum("_count").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_count").over(of_group).alias("n")))
    both = dealt.withColumn("_here", part).join(starts, (F.col("_here") == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group")))
    return both.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("pos"), "n")


# Levels in DuckDB, over whole buckets


def _whole_buckets(source: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches, sorted so that each bucket starts with a row where `starts` holds, as tables of whole buckets."""
    held: list[pa.RecordBatch] = []
    for batch in source:
        if held and sum(b.num_rows for b in held) >= TABLE_ROWS:
            first = pc.index(batch["starts"], True).as_py()
            if first >= 0:
                yield pa.Table.from_batches([*held, batch.slice(0, first)])
                held, batch = [], batch.slice(first)
        if batch.num_rows:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _opened(rows: pa.Table):
    """A DuckDB in memory with a table `rows`, its buckets numbered (g), and tables n0, n1, ... of their nodes on each level."""
    import duckdb

    db = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
    number = pc.cumulative_sum(rows["starts"].cast(pa.int64()))
    db.register("given", rows.append_column("g", number))
    return db


def _levels(db, levels: int) -> None:
    for level in range(1, levels + 1):
        db.execute(
            f"""CREATE TABLE n{level} AS SELECT g, i // {ARITY} AS i, any_value(levels) AS levels,
            CASE WHEN any_value(levels) >= {level} THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h
            FROM n{level - 1} GROUP BY g, i // {ARITY}"""
        )


def _bucket_roots(levels: int):
    """Rows of leaves, sorted by bucket and place, to one row for each bucket."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_buckets(source):
            with _opened(rows) as db:
                db.execute("CREATE TABLE n0 AS SELECT g, i, levels, leaf AS h FROM given")
                _levels(db, levels)
                found = db.sql(f"SELECT w.grp, w.bucket, n.h, w.n FROM n{levels} n JOIN (SELECT * FROM given WHERE starts) w USING (g)")
                yield from found.to_arrow_table().cast(ROOTS).to_batches()

    return run


ROOTS = pa.schema([("grp", pa.string()), ("bucket", pa.int64()), ("h", pa.string()), ("n", pa.int64())])


def _folded(levels: int, schema: pa.Schema):
    """Buckets, each a row with what is above it and then its leaves, to a row for each leaf with its proof and its fold."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_buckets(source):
            with _opened(rows) as db:
                db.execute("CREATE TABLE above AS SELECT g, outer_sides, subroot, root, list_aggregate(list_transform(outer_sides, lambda s: s.lft || s.rgt), 'string_agg', '') AS outer_text FROM given WHERE starts")
                db.execute("CREATE TABLE n0 AS SELECT g, i, levels, leaf AS h FROM given WHERE NOT starts")
                deepest = db.execute("SELECT coalesce(max(len(outer_sides)), 0) FROM above").fetchall()[0][0]
                _levels(db, levels)
                fold, proof, joins = "l.folded", "''", ""
                for level in range(1, levels + 1):
                    of_run = f"PARTITION BY g, i // {ARITY} ORDER BY i ROWS BETWEEN"
                    db.execute(
                        f"""CREATE TABLE s{level} AS SELECT g, i, coalesce(string_agg(h, '') OVER ({of_run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
                        coalesce(string_agg(h, '') OVER ({of_run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt FROM n{level - 1} WHERE levels >= {level}"""
                    )
                    s = f"s{level}"
                    joins += f" LEFT JOIN {s} ON {s}.g = l.g AND {s}.i = l.i // {ARITY ** (level - 1)}"
                    fold = f"CASE WHEN {s}.g IS NULL THEN {fold} ELSE sha256({s}.lft || {fold} || {s}.rgt) END"
                    proof += f" || coalesce({s}.lft, '') || coalesce({s}.rgt, '')"
                db.execute(f"CREATE TABLE f0 AS SELECT l.doc_id, l.leaf, l.g, sha256({proof} || coalesce(a.outer_text, '')) AS proof_sha256, {fold} AS f FROM (SELECT * FROM given WHERE NOT starts) l JOIN above a ON a.g = l.g {joins}")
                for up in range(1, deepest + 1):
                    side = f"a.outer_sides[{up}]"
                    db.execute(f"CREATE TABLE f{up} AS SELECT f.* EXCLUDE (f), CASE WHEN len(a.outer_sides) >= {up} THEN sha256({side}.lft || f.f || {side}.rgt) ELSE f.f END AS f FROM f{up - 1} f JOIN above a USING (g)")
                    db.execute(f"DROP TABLE f{up - 1}")
                found = db.sql(f"SELECT f.doc_id, f.leaf, a.subroot, a.root, f.proof_sha256, f.f AS folded_root, f.f = a.root AS verified FROM f{deepest} f JOIN above a USING (g)")
                yield from found.to_arrow_table().cast(schema).to_batches(max_chunksize=8192)

    return run


# Levels in Spark, over the buckets' roots and over the sources


def climb(nodes: DataFrame, group: str) -> DataFrame:
    """nodes: group, i (from 0 in each group), h and m, how many nodes the group has. For each node what is left and right of its
    path on each level up to the group's root (sides), and that root (top). The driver sees the largest m."""
    most = nodes.agg(F.max("m")).first()[0] or 0
    now, runs_of = nodes, []
    while most > 1:
        run = F.sort_array(F.collect_list(F.struct("i", "h")))
        runs = stored(now.groupBy(group, F.floor(F.col("i") / ARITY).alias("p")).agg(run.alias("run"), F.max("m").alias("m")))
        runs_of.append(runs)
        digest = F.when(F.col("m") > 1, F.sha2(F.array_join("run.h", ""), 256)).otherwise(F.col("run")[0]["h"])
        now = runs.select(group, F.col("p").alias("i"), digest.alias("h"), F.ceil(F.col("m") / ARITY).alias("m"))
        most = math.ceil(most / ARITY)
    paths = now.select(group, "i", F.array().cast(SIDES).alias("sides"), F.col("h").alias("top"))
    for runs in reversed(runs_of):
        above = paths.select(F.col(group).alias("_group"), F.col("i").alias("_i"), F.col("sides").alias("_sides"), "top")
        each = runs.join(above, F.col(group).eqNullSafe(F.col("_group")) & (F.col("p") == F.col("_i"))).select(group, "run", "m", "_sides", "top", F.posexplode("run").alias("at", "node"))
        hs = F.col("run.h")
        side = F.struct(F.array_join(F.slice(hs, F.lit(1), F.col("at")), "").alias("lft"), F.array_join(F.slice(hs, F.col("at") + 2, F.lit(ARITY)), "").alias("rgt"))
        sides = F.when(F.col("m") > 1, F.concat(F.array(side), F.col("_sides"))).otherwise(F.col("_sides"))
        paths = stored(each.select(group, F.col("node.i").alias("i"), sides.alias("sides"), "top"))
    return paths


def manifest(leaves: DataFrame) -> DataFrame:
    """leaves: doc_id, grp, leaf and folded, the digest to fold with (the leaf's own, if it is whole). For each its leaf, subroot, root,
    proof_sha256, folded_root and verified."""
    size, levels = ARITY**BUCKET_LEVELS, BUCKET_LEVELS
    spark = leaves.sparkSession
    dealt = placed(stored(leaves), "grp", ["doc_id", "leaf", "folded"])
    bucket, inside = F.floor(F.col("pos") / size).alias("bucket"), F.pmod("pos", F.lit(size)).alias("i")
    # As many levels below a bucket's root as its source has, at most those of a bucket.
    deep = F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.lit(0), lambda a, k: a + (F.pow(F.lit(float(ARITY)), k - 1) < F.col("n")).cast("int")).alias("levels")
    kept = stored(dealt.select("grp", bucket, inside, "n", deep, "doc_id", "leaf", "folded"))
    in_order = kept.select("grp", "bucket", "i", "n", "levels", "leaf", (F.col("i") == 0).alias("starts")).repartition("grp", "bucket").sortWithinPartitions("grp", "bucket", "i")
    roots = stored(in_order.mapInArrow(_bucket_roots(levels), "grp string, bucket long, h string, n long"))
    paths = climb(roots.select("grp", F.col("bucket").alias("i"), "h", F.ceil(F.col("n") / size).alias("m")), "grp")

    sources = stored(paths.filter("i = 0").select("grp", F.col("top").alias("h"), F.lit(0).alias("tree")))
    ordered = placed(sources, "tree", ["grp"])
    outer = climb(ordered.select("tree", F.col("pos").alias("i"), "h", F.col("n").alias("m")), "tree")
    named = ordered.select(F.col("grp").alias("_grp"), "pos").join(outer.select(F.col("i").alias("pos"), F.col("sides").alias("_outer"), F.col("top").alias("root")), "pos")
    above = paths.join(named, F.col("grp").eqNullSafe(F.col("_grp"))).select("grp", F.col("i").alias("bucket"), F.concat("sides", "_outer").alias("outer_sides"), F.col("top").alias("subroot"), "root")

    no = lambda kind: F.lit(None).cast(kind)
    heads = above.select("grp", "bucket", F.lit(-1).cast("long").alias("i"), F.lit(True).alias("starts"), no("int").alias("levels"), no("long").alias("doc_id"), no("string").alias("leaf"), no("string").alias("folded"), "outer_sides", "subroot", "root")
    rows = kept.select("grp", "bucket", "i", F.lit(False).alias("starts"), "levels", "doc_id", "leaf", "folded", no(SIDES).alias("outer_sides"), no("string").alias("subroot"), no("string").alias("root"))
    both = heads.unionByName(rows).repartition("grp", "bucket").sortWithinPartitions("grp", "bucket", "i")
    names = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    schema = pa.schema([("doc_id", pa.int64()), *((name, pa.string()) for name in names), ("verified", pa.bool_())])
    return both.drop("grp", "bucket").mapInArrow(_folded(levels, schema), f"doc_id long, {', '.join(f'{name} string' for name in names)}, verified boolean")


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    leaf = leaf_of([F.col(c) for c in FIELDS])
    changed = leaf_of([F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in FIELDS])
    return manifest(docs.select("doc_id", F.col("source").alias("grp"), leaf.alias("leaf"), F.when(tampered, changed).otherwise(leaf).alias("folded")))


def _oracle_sql(levels: int = 6) -> str:
    """The same by plain SQL, for up to 16^levels rows of a source and as many sources."""
    bits = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))"
    # crc32 of an id's digits, bit by bit.
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda c, b: {bits}), 4294967295)"
    told = lambda text: " || ".join(f"coalesce(octet_length(encode(x.v)) || ':' || x.v, '-')".replace("x.v", c) for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text))
    parts = [
        f"""WITH docs AS (SELECT doc_id, source, coalesce({crc} % 5 = 0, FALSE) AS bad, sha256({told("text")}) AS leaf, sha256({told(f"translate(text, '{UPPER}', '{LOWER}')")}) AS changed FROM documents),
        a0 AS (SELECT *, source AS grp, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS m, leaf AS h FROM docs)"""
    ]

    def tree(name: str, start: str) -> str:
        """Levels name1.. of nodes (grp, i, m, h) in start; for each node of each level what is left and right of it."""
        now = start
        for k in range(1, levels + 1):
            run = "PARTITION BY grp, i // 16 ORDER BY i ROWS BETWEEN"
            parts.append(
                f"""{name}s{k} AS (SELECT grp, i, m, CASE WHEN m > 1 THEN coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS lft,
                CASE WHEN m > 1 THEN coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS rgt FROM {now})"""
            )
            parts.append(f"{name}{k} AS (SELECT grp, i // 16 AS i, (any_value(m) + 15) // 16 AS m, CASE WHEN any_value(m) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h FROM {now} GROUP BY grp, i // 16)")
            now = f"{name}{k}"
        return now

    top = tree("a", "a0")
    parts.append(f"b0 AS (SELECT 0 AS grp, grp AS source, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS i, count(*) OVER () AS m, h FROM {top})")
    root = tree("b", "b0")
    parts.append("f0 AS (SELECT d.*, b0.i AS source_at, b0.h AS subroot, CASE WHEN d.bad THEN d.changed ELSE d.leaf END AS f, '' AS proof FROM a0 d JOIN b0 ON b0.source IS NOT DISTINCT FROM d.source)")
    steps = [(f"as{k}", "f.source", f"f.i // {16 ** (k - 1)}") for k in range(1, levels + 1)] + [(f"bs{k}", "0", f"f.source_at // {16 ** (k - 1)}") for k in range(1, levels + 1)]
    for k, (s, group, place) in enumerate(steps):
        parts.append(
            f"""f{k + 1} AS (SELECT f.* EXCLUDE (f, proof), CASE WHEN s.m > 1 THEN sha256(s.lft || f.f || s.rgt) ELSE f.f END AS f, f.proof || s.lft || s.rgt AS proof
            FROM f{k} f JOIN {s} s ON s.grp IS NOT DISTINCT FROM {group} AND s.i = {place})"""
        )
    whole = f"SELECT doc_id, leaf, subroot, (SELECT h FROM {root}) AS root, sha256(proof) AS proof_sha256, f AS folded_root FROM f{len(steps)}"
    return ",\n".join(parts) + f"\nSELECT *, folded_root = root AS verified FROM ({whole})"


ORACLE_SQL = _oracle_sql()
