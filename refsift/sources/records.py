"""Sources of one's own: files of records, records under lookup keys, and functions asked for each entry.

Each gives observations, so that check_observations() takes them together with those of other sources. The registry
names the source: DEFAULT_SOURCES + (Source("mine", identifier_lookup=True),).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from refsift.functions.authors import split_authors
from refsift.functions.text import find_arxiv, find_doi, year_in
from refsift.operators import lookup
from refsift.operators.entries import entry_columns
from refsift.schema import CANDIDATE, OBSERVATIONS_DDL, candidate_of

#: A record as files hold it. Fields that may be a text, a number or a list are read as text.
FILE_RECORD = "source string, provider string, title string, authors string, author string, year string, venue string, journal string, url string, identifier string, doi string, arxiv_id string, arxiv string, eprint string"
MODES = ("identifier", "title")


def _names(text: Column) -> Column:
    """A list of names, or a text of names joined by `and`."""
    return F.when(text.startswith("["), F.from_json(text, "array<string>")).otherwise(split_authors(text))


def _filled(*names: str) -> Column:
    """The first of these fields that isn't empty, or the empty string."""
    return F.coalesce(*[F.nullif(F.col(f"r.{n}"), F.lit("")) for n in names], F.lit(""))


def typed(rows: DataFrame, name: str) -> DataFrame:
    """rows: lookup (null: found by what the record holds), pos and r, a record as files hold it. Gives lookup, pos,
    record_id and the columns of a record. Records of equal content have one record_id."""
    authors = F.when(F.coalesce(F.col("r.authors"), F.lit("")).isin("", "[]"), F.col("r.author")).otherwise(F.col("r.authors"))
    doi, arxiv = find_doi(F.col("r.doi"), F.col("r.url")), find_arxiv(F.col("r.arxiv_id"), F.col("r.arxiv"), F.col("r.eprint"), F.col("r.url"))
    text = lambda n: F.coalesce(F.col(f"r.{n}"), F.lit("")).alias(n)
    identifier = F.coalesce(F.nullif(_filled("identifier"), F.lit("")), F.nullif(doi, F.lit("")), F.nullif(arxiv, F.lit("")), F.lit(""))
    return rows.filter("r IS NOT NULL").select(
        "lookup", "pos", F.sha2(F.to_json("r"), 256).alias("record_id"), F.coalesce(F.nullif(_filled("source", "provider"), F.lit("")), F.lit(name)).alias("source"), text("title"),
        F.coalesce(_names(authors), F.array().cast("array<string>")).alias("authors"), year_in(F.col("r.year")).alias("year"), _filled("venue", "journal").alias("venue"), text("url"),
        identifier.alias("identifier"), text("doi"), text("arxiv_id"), text("arxiv"), text("eprint"),
    )


def parsed(files: DataFrame, name: str = "local") -> DataFrame:
    """files: text, each a JSON list of records, an object whose `records` are a list, or an object that holds under each
    lookup key (`doi:...`, `arxiv:...`, `title:...`, `*`) a record or a list of them. Anything else holds no records."""
    text = F.trim("text")
    held = F.when(text.startswith("{"), F.from_json(text, "map<string,string>")).otherwise(F.create_map(F.lit("records"), text))
    held = F.when(F.map_contains_key(held, F.lit("records")), F.map_filter(held, lambda k, _: k == "records")).otherwise(held)
    each = files.select(F.explode(held).alias("lookup", "body"))
    body = F.ltrim("body")
    items = F.when(body.startswith("["), F.from_json(body, "array<string>")).when(body.startswith("{"), F.array(body))
    rows = each.select(F.nullif("lookup", F.lit("records")).alias("lookup"), F.posexplode(items).alias("pos", "item"))
    rows = rows.filter(F.ltrim("item").startswith("{")).select("lookup", "pos", F.from_json("item", FILE_RECORD).alias("r"))
    return typed(rows, name)


def read_records(spark: SparkSession, path: str | list[str], name: str = "local") -> DataFrame:
    """Records of JSON files, each whole in one task: for fixtures and exports of some megabytes. See parsed()."""
    return parsed(spark.read.text(path, wholetext=True).select(F.col("value").alias("text")), name)


def read_record_lines(spark: SparkSession, path: str | list[str], name: str = "local") -> DataFrame:
    """Records of JSON files with one to a line, which split among tasks at any size."""
    lines = spark.read.schema(FILE_RECORD).json(path)
    return typed(lines.select(F.lit(None).cast("string").alias("lookup"), F.lit(0).alias("pos"), F.struct("*").alias("r")), name)


def _answers(rows: DataFrame, source: str, source_idx: int) -> DataFrame:
    """rows: key, outcome, error and candidates. One observation for each way of asking."""
    empty = F.array().cast(f"array<{CANDIDATE}>")
    return rows.select("key", F.lit(source).alias("source"), F.lit(source_idx).alias("source_idx"), F.explode(F.array(*[F.lit(m) for m in MODES])).alias("mode"), "outcome", "error", F.coalesce("candidates", empty).alias("candidates"))


def record_answers(entries: DataFrame, records: DataFrame, source: str, source_idx: int) -> DataFrame:
    """Observations of a source that holds records, as read_records() gives them.

    Records without a lookup key answer entries that share an identifier or the title; others answer those that look
    their key up. An entry gets a record once. Entries without a record have an empty answer.
    """
    read = entry_columns(entries)
    held = records.dropDuplicates(["record_id"])
    by_content = lookup.by_any(read, lookup.record_columns(records.filter("lookup IS NULL").dropDuplicates(["record_id"])))
    by_name = lookup.by_lookup_key(read, records.filter("lookup IS NOT NULL").select("lookup", "record_id").distinct())
    found = by_content.unionByName(by_name).distinct().join(held.select("record_id", "pos", candidate_of(held).alias("c")), "record_id")
    lists = found.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "record_id", "c"))), lambda x: x["c"]).alias("candidates"))
    rows = read.select("key").join(lists, "key", "left").select("key", F.lit("ok").alias("outcome"), F.lit(None).cast("string").alias("error"), "candidates")
    return _answers(rows, source, source_idx)


def function_answers(entries: DataFrame, function: Callable[[dict], Iterable[dict]], source: str, source_idx: int, applies: Callable[[dict], bool] | None = None) -> DataFrame:
    """Observations of a function that gives the records of an entry (key, entry_type, fields) as dicts.

    It is asked once for each entry, in the tasks that hold the entries. What it raises is an error of that entry. An
    entry to which it doesn't apply has no row; where applies() raises, one row in mode `applies` says so.
    """
    schema = T.StructType.fromDDL(f"key string, mode string, outcome string, error string, candidates array<{CANDIDATE}>")
    arrow = to_arrow_schema(schema)
    fields = [f.name for f in schema["candidates"].dataType.elementType]

    def asked(entry: dict) -> Iterator[dict]:
        row = {"key": entry["key"], "outcome": "ok", "error": None, "candidates": []}
        try:
            if applies is not None and not applies(entry):
                return
        except Exception as error:  # said of this entry, which is then not asked
            yield row | {"mode": "applies", "outcome": "error", "error": str(error)}
            return
        try:
            found = [{n: c.get(n) for n in fields} | {"source": c.get("source") or source} for c in function(entry)]
            row["candidates"] = found
        except Exception as error:
            row |= {"outcome": "error", "error": str(error)}
        for mode in MODES:
            yield row | {"mode": mode}

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for e in batch.to_pylist() for r in asked(e | {"fields": dict(e["fields"] or [])})]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    said = entries.select("key", "entry_type", "fields").mapInArrow(ask, schema)
    order = [x.split()[0] for x in OBSERVATIONS_DDL.split(", ")[:6]] + ["candidates"]
    return said.withColumn("source", F.lit(source)).withColumn("source_idx", F.lit(source_idx)).select(*order)
