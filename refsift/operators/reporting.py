"""Reports: results as JSON, issues, summaries, batch times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refsift.operators.comparing import differences
from refsift.schema import STATUSES, VALIDATED
from refsift.shared import dropped, stored

CANDIDATE_FIELDS = ("source", "title", "authors", "year", "venue", "url", "identifier", "score", "title_score", "author_score", "year_score", "identifier_match", "evidence", "conflicts")


def result_json(results: DataFrame) -> DataFrame:
    """key and json: a result with its candidates' scores, without raw records."""
    shown = F.transform("candidates", lambda c: F.struct(*[c[x].alias(x) for x in CANDIDATE_FIELDS]))
    whole = F.struct("key", "status", "score", "reasons", shown.alias("candidates"), "provider_errors", "field_comparison")
    return results.select("key", F.to_json(whole).alias("json"))


def problems(reasons: Column, said: Column) -> Column:
    """The first reason and the differences, or all reasons where no field differs."""
    return F.when(F.size(said) > 0, F.concat(F.slice(reasons, 1, 1), said)).otherwise(reasons)


def issues(results: DataFrame) -> DataFrame:
    """key and problems of every result that isn't validated. A title in another version is no difference here."""
    said = F.coalesce(differences(F.col("field_comparison"), with_compatible_title=False), F.array().cast("array<string>"))
    return results.filter(F.col("status") != VALIDATED).select("key", problems(F.col("reasons"), said).alias("problems"))


def _quoted(text: Column) -> Column:
    """A text as a JSON string."""
    return F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)


def _listed(rows: DataFrame, part: int) -> DataFrame:
    """rows: at, without repeats, and text, a JSON value. All but the first come after a comma."""
    first = F.broadcast(rows.agg(F.min("at").alias("_first")))
    return rows.join(first).select(F.lit(part).alias("part"), "at", F.concat(F.when(F.col("at") == F.col("_first"), "").otherwise(","), "text").alias("text"))


def _said(rows: DataFrame, part: int, text: Column) -> DataFrame:
    """One line of a document, of a frame with one row."""
    return rows.select(F.lit(part).alias("part"), F.lit("").alias("at"), text.alias("text"))


def _document(start: Column, heads: DataFrame, missing: DataFrame, name: str, values: DataFrame, end: Column) -> DataFrame:
    keys = missing.select("key").distinct().select(F.col("key").alias("at"), _quoted(F.col("key")).alias("text"))
    parts = (_said(heads, 0, F.concat(start, F.lit('"missing_citation_keys":['))), _listed(keys, 1), _said(heads, 2, F.lit(f'],"{name}":[')), _listed(values, 3), _said(heads, 4, F.concat(F.lit("]"), end, F.lit("}"))))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def run_report(results: DataFrame, missing: DataFrame, log_file: str, issues_file: str) -> DataFrame:
    """part, at and text: in this order one JSON document with missing_citation_keys, results, log_file and issues_file.
    Each result is a row of its own: nothing is gathered, whatever their number. results have a row for each key."""
    one = results.sparkSession.range(1)
    each = result_json(results).select(F.col("key").alias("at"), F.col("json").alias("text"))
    files = F.concat(F.lit(',"log_file":'), _quoted(F.lit(log_file)), F.lit(',"issues_file":'), _quoted(F.lit(issues_file)))
    return _document(F.lit("{"), one, missing, "results", each, files)


def issues_report(found: DataFrame, missing: DataFrame, bib: str) -> DataFrame:
    """As run_report, a document with bib, issue_count, missing_citation_keys and issues. found: what issues() gives."""
    n = found.agg(F.count("*").alias("n"))
    start = F.concat(F.lit('{"bib":'), _quoted(F.lit(bib)), F.lit(',"issue_count":'), F.col("n").cast("string"), F.lit(","))
    each = found.select(F.col("key").alias("at"), F.to_json(F.struct("key", "problems")).alias("text"))
    return _document(start, n, missing, "issues", each, F.lit(""))


#: The order of the groups in a summary; validated results are only counted.
GROUPS = ("likely_hallucination", "needs_review", "unconfirmed", VALIDATED)


def final_summary(results: DataFrame) -> DataFrame:
    """part, at and text: for each status its count, and under it its results by key, numbered, with title, authors and
    reasons. results: key, status, title, authors and reasons; other columns stay out."""
    place = F.array_position(F.array(*[F.lit(g) for g in GROUPS]), F.col("status"))
    empty = (F.col("n") == 0) & (F.col("status") != VALIDATED)
    heads = status_counts(results).select(place.cast("int").alias("part"), F.lit("").alias("at"), F.concat("status", F.lit(" ("), F.col("n").cast("string"), F.lit(")"), F.when(empty, "\n  none").otherwise("")).alias("text"))
    number = running_counts(results).select("key", F.col("of_status").cast("string").alias("number"))
    or_none = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "none").otherwise(c)
    lines = F.concat(
        F.array(F.concat(F.lit("  "), "number", F.lit(". title: "), or_none(F.col("title"))), F.concat(F.lit("     authors: "), or_none(F.array_join("authors", "; "))), F.lit("     reasons:")),
        F.transform(F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(F.array(F.lit("none"))), lambda r: F.concat(F.lit("       - "), r)),
    )
    named = results.filter(F.col("status") != VALIDATED).join(number, "key")
    return heads.unionByName(named.select(place.cast("int").alias("part"), F.col("key").alias("at"), F.array_join(lines, "\n").alias("text")))


def written(lines: DataFrame, path: str) -> None:
    """lines: part, at and text. Text files that give the document if read in the order of their names."""
    lines.orderBy("part", "at").select("text").write.text(path)


def tee(lines: DataFrame, path: str, say: Callable[[str], None] = print) -> None:
    """Write lines and say them as well, both from one result; the driver holds one partition at a time."""
    lines = stored(lines)
    written(lines, path)
    for row in lines.orderBy("part", "at").select("text").toLocalIterator():
        say(row["text"])
    dropped(lines)


def status_counts(results: DataFrame) -> DataFrame:
    """n of each status, zero included, in the order of reports."""
    names = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(s).alias("status")) for i, s in enumerate(STATUSES)])
    order = results.sparkSession.range(1).select(F.inline(names))
    return order.join(results.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("position", "status", F.coalesce("n", F.lit(0)).alias("n"))


#: Rows of a range, and into how many ranges an order is cut at most (as many as Spark shuffles to, if that is more than one).
RANGE_ROWS = 5_000


def in_order(rows: DataFrame, by: str, range_rows: int | None = None) -> DataFrame:
    """rows, written in the order of `by`, with their number in it (_at) and that of their range (_range). Spark cuts the order into
    ranges, so no bounds go through the driver; a value of `by` that many rows have is cut as well, by a number of theirs."""
    kept, number = stored(rows), F.monotonically_increasing_id()
    most = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, min(most, -(-kept.count() // (range_rows or RANGE_ROWS))))
    ordered = kept.withColumn("_tie", number).repartitionByRange(n, by, "_tie").sortWithinPartitions(by, "_tie").withColumn("_at", number).drop("_tie")
    found = stored(ordered.withColumn("_range", F.shiftrightunsigned("_at", 33)))
    dropped(kept)
    return found


def scanned(placed: DataFrame, sums: dict[str, Column], group: str | None = None, including: bool = True) -> DataFrame:
    """placed, as in_order() gives it, with running sums, in each group where one is named, the row's own included or not. What meets in one
    window is a range, or one row for each range (and group), never the table."""
    groups = [group] if group else []
    totals = placed.groupBy(*groups, "_range").agg(*[F.sum(c).alias(f"_t_{name}") for name, c in sums.items()])
    earlier = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(totals.select(*[F.col(g).alias("_group") for g in groups], F.col("_range").alias("_of"), *[F.coalesce(F.sum(f"_t_{name}").over(earlier), F.lit(0)).alias(f"_s_{name}") for name in sums]))
    inside = Window.partitionBy(*groups, "_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow if including else -1)
    own = placed.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_o_{name}") for name, c in sums.items()])
    same = F.col("_range") == F.col("_of")
    joined = own.join(starts, same & F.col(group).eqNullSafe(F.col("_group")) if group else same)
    return joined.select(*placed.columns, *[(F.col(f"_o_{name}") + F.col(f"_s_{name}")).alias(name) for name in sums])


def running(rows: DataFrame, by: str, sums: dict[str, Column], group: str | None = None, including: bool = True) -> DataFrame:
    """rows with running sums in the order of `by` (in each group, where one is named). Rows of equal `by` come one after another, in any order."""
    return scanned(in_order(rows, by), sums, group, including).select(*rows.columns, *sums)


def running_counts(results: DataFrame, by: str = "key", range_rows: int | None = None) -> DataFrame:
    """key, status, index of each result in order, and how many of its status there are so far."""
    placed = in_order(results.select(by, "status"), by, range_rows)
    counted = scanned(scanned(placed, {"index": F.lit(1)}), {"of_status": F.lit(1)}, "status")
    return counted.select(by, "status", F.col("index").cast("int").alias("index"), "of_status")


def shows_source(status: Column, top: Column) -> Column:
    """Whether a report names the source of the first candidate."""
    return (status != VALIDATED) & top.isNotNull() & (top["identifier_match"] | (top["title_score"] >= 0.72) | (status == "needs_review"))


def report_lines(results: DataFrame) -> DataFrame:
    """key and line: label, conclusion, differences, source and unfinished sources."""
    top = F.get("candidates", F.lit(0))
    said = F.coalesce(differences(F.col("field_comparison"), with_compatible_title=False), F.array().cast("array<string>"))
    parts = F.concat(
        F.array(F.concat(F.lit("["), F.upper("status"), F.lit("] "), F.col("key")), F.concat(F.lit("  "), F.get("reasons", F.lit(0)))),
        F.transform(said, lambda x: F.concat(F.lit("  - "), x)),
        F.when(shows_source(F.col("status"), top), F.array(F.concat(F.lit("  source: "), top["source"], F.lit(" "), top["title"]))).otherwise(F.array().cast("array<string>")),
        F.when(F.size("provider_errors") > 0, F.array(F.concat(F.lit("  unfinished: "), F.array_join(F.array_sort(F.map_keys("provider_errors")), ", ")))).otherwise(F.array().cast("array<string>")),
    )
    return results.select("key", F.array_join(parts, "\n").alias("line"))


def batch_times(batches: DataFrame) -> DataFrame:
    """batches: batch_no, size and seconds. A row for each item: its number in all, elapsed seconds as if a batch's
    time were spread evenly over its items, and the average so far."""
    spent = running(batches, "batch_no", {"_s": F.col("seconds"), "_n": F.col("size")}, including=False)
    each = spent.select("*", F.explode(F.sequence(F.lit(1), "size")).alias("_i"))
    elapsed = F.col("_s") + F.col("seconds") * F.col("_i") / F.col("size")
    done = F.col("_n") + F.col("_i")
    return each.select("batch_no", done.alias("item"), elapsed.alias("elapsed"), (elapsed / done).alias("average"))
