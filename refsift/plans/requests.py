"""What to ask sources that are addresses: the requests of each entry, each address once, and what the answers together say.

Nothing here fetches. distinct_requests() is what plans.fetch, or a crawl's table, has to answer; answers() joins that to the entries.
Requests have a step: what the second step says counts only if the first leaves it open. They are key, source, mode, step,
part (the order within a step), url, accept, title, venue and year.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from refsift.functions.text import normal_arxiv_any, year_in
from refsift.operators.entries import field_text
from refsift.operators.lookup import close_title
from refsift.schema import CANDIDATE
from refsift.sources.pages import ICML_VOLUMES, icml_volume, volume_ids
from refsift.sources.payloads import candidates_of, ordered, repository

#: Where the sources are, and the kinds of answers to ask for.
ARXIV_PAGES, ARXIV_FEED = "https://arxiv.org/abs/", "https://export.arxiv.org/api/query?"
ICML_INDEX, ICML_VOLUME_PAGES = "https://proceedings.mlr.press/", "https://proceedings.mlr.press/v"
ANTHOLOGY = "https://aclanthology.org/"
GITHUB = "https://api.github.com/"
HTML, FEED, BIBTEX, GITHUB_JSON = "text/html", "application/atom+xml", "text/x-bibtex", "application/vnd.github+json"
#: Sources of which every answer is needed.
WHOLE = ("acl", "emnlp")


def _request(source: str, mode: str, step: int, part: int, url: Column, accept: str, year: Column | None = None) -> Column:
    of_year = (F.lit(None) if year is None else year).cast("int")
    return F.struct(F.lit(source).alias("source"), F.lit(mode).alias("mode"), F.lit(step).alias("step"), F.lit(part).alias("part"), url.alias("url"), F.lit(accept).alias("accept"), of_year.alias("year"))


def _each(entries: DataFrame, *requests: Column) -> DataFrame:
    """entries: as entry_columns() gives them. A row for each request that has an address."""
    rows = entries.select("key", "title", "venue", F.inline(F.array(*requests)))
    return rows.filter("url IS NOT NULL").select("key", "source", "mode", "step", "part", "url", "accept", "title", "venue", "year")


def arxiv_requests(entries: DataFrame) -> DataFrame:
    """By identifier the pages of the latest and the first version, and the feed of both if neither page says anything;
    by title the feed."""
    name = F.nullif(normal_arxiv_any(F.col("arxiv")), F.lit(""))
    asked = F.concat(F.lit('ti:"'), F.replace(F.col("title"), F.lit('"'), F.lit(" ")), F.lit('"'))
    return _each(
        entries,
        _request("arxiv", "identifier", 0, 0, F.concat(F.lit(ARXIV_PAGES), name), HTML),
        _request("arxiv", "identifier", 0, 1, F.concat(F.lit(ARXIV_PAGES), name, F.lit("v1")), HTML),
        _request("arxiv", "identifier", 1, 0, F.concat(F.lit(f"{ARXIV_FEED}id_list="), F.url_encode(F.concat(name, F.lit(","), name, F.lit("v1"))), F.lit("&max_results=2")), FEED),
        _request("arxiv", "title", 0, 0, F.when(F.col("title") != "", F.concat(F.lit(f"{ARXIV_FEED}search_query="), F.url_encode(asked), F.lit("&start=0&max_results=5"))), FEED),
    )


def _icml_years(entries: DataFrame) -> DataFrame:
    year = year_in(field_text("year"))
    return entries.filter("title <> ''").select("key", "title", "venue", F.inline(F.array(*[F.struct(F.lit(step).alias("step"), (year - step).cast("int").alias("year")) for step in (0, 1)]))).filter("year IS NOT NULL")


def _icml_table(spark: SparkSession, volumes: dict[int, int]) -> DataFrame:
    return spark.createDataFrame(sorted(volumes.items()), "year int, volume int")


def icml_index_requests(entries: DataFrame, volumes: dict[int, int] = ICML_VOLUMES) -> DataFrame:
    """The publisher's index page (url, accept), if a year that entries need isn't in the table of volumes."""
    open_ = _icml_years(entries).select("year").distinct().join(F.broadcast(_icml_table(entries.sparkSession, volumes)), "year", "left_anti")
    return open_.select(F.lit(ICML_INDEX).alias("url"), F.lit(HTML).alias("accept")).distinct()


@F.pandas_udf(IntegerType())
def _volume_on(page: pd.Series, year: pd.Series) -> pd.Series:
    found = []
    for body, y in zip(page, year, strict=True):
        try:
            found.append(icml_volume(int(y), body or ""))
        except ValueError:
            found.append(None)
    return pd.Series(found, dtype="Int64")


def icml_volumes(entries: DataFrame, index_page: DataFrame, volumes: dict[int, int] = ICML_VOLUMES) -> DataFrame:
    """year and volume of each year that entries need: from the table, or from the index page (body; one row, or none)."""
    known = F.broadcast(_icml_table(entries.sparkSession, volumes))
    years = _icml_years(entries).select("year").distinct()
    page = F.broadcast(index_page.select("body").limit(1))
    read = years.join(known, "year", "left_anti").join(page).select("year", _volume_on("body", "year").alias("volume")).filter("volume IS NOT NULL")
    return years.join(known, "year").unionByName(read)


def icml_requests(entries: DataFrame, volumes: dict[int, int] | DataFrame = ICML_VOLUMES) -> DataFrame:
    """The volume of the entry's year, and the one before unless that holds a close title. volumes: a table, or what icml_volumes() gives, whose
    rows are years and so few. Years without a volume ask nothing."""
    held = volumes if isinstance(volumes, DataFrame) else _icml_table(entries.sparkSession, volumes)
    rows = _icml_years(entries).join(F.broadcast(held), "year")
    url = F.concat(F.lit(ICML_VOLUME_PAGES), F.col("volume").cast("string"), F.lit("/"))
    return rows.select("key", F.lit("icml").alias("source"), F.lit("title").alias("mode"), "step", F.lit(0).alias("part"), url.alias("url"), F.lit(HTML).alias("accept"), "title", "venue", "year")


@F.pandas_udf(ArrayType(StringType()))
def _volumes(body: pd.Series, venue: pd.Series, year: pd.Series) -> pd.Series:
    return pd.Series([volume_ids(b or "", v, int(y)) for b, v, y in zip(body, venue, year, strict=True)], dtype=object)


def anthology_requests(entries: DataFrame, venue_pages: DataFrame, venue: str) -> DataFrame:
    """All volumes of the entry's year. venue_pages: venue and body, what the venue's page says; one row is read once for each year."""
    asked = entries.filter("title <> ''").select("*", year_in(field_text("year")).alias("_year")).filter("_year IS NOT NULL").drop("year")
    page = venue_pages.filter(F.col("venue") == venue).select("body").limit(1)
    years = asked.select("_year").distinct().join(F.broadcast(page)).select("_year", F.posexplode(_volumes("body", F.lit(venue), "_year")).alias("part", "volume"))
    rows = asked.join(years, "_year")
    url = F.concat(F.lit(f"{ANTHOLOGY}volumes/"), "volume", F.lit(".bib"))
    return rows.select("key", F.lit(venue).alias("source"), F.lit("title").alias("mode"), F.lit(0).alias("step"), "part", url.alias("url"), F.lit(BIBTEX).alias("accept"), "title", "venue", F.col("_year").alias("year"))


def github_requests(entries: DataFrame) -> DataFrame:
    """The repository that a field names; entries that name none are searched by title."""
    name = F.nullif(repository(F.map_values("fields")), F.lit(""))
    found = F.when(name.isNull() & (F.col("title") != ""), F.concat(F.lit(f"{GITHUB}search/repositories?q="), F.url_encode("title"), F.lit("&per_page=5")))
    return _each(entries, _request("github", "identifier", 0, 0, F.concat(F.lit(f"{GITHUB}repos/"), name), GITHUB_JSON), _request("github", "title", 0, 0, found, GITHUB_JSON))


def distinct_requests(requests: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Each url and accept once, without those that `held` (url, accept) has: an address is asked for once, however many
    entries want it. Copies go before the shuffle, so a common address costs a row for each task."""
    wanted = requests.select("url", "accept").distinct()
    return wanted if held is None else wanted.join(held.select("url", "accept"), ["url", "accept"], "left_anti")


def answers(requests: DataFrame, payloads: DataFrame, k: int = 5) -> DataFrame:
    """key, source, mode, outcome, error and candidates. payloads: url, accept, body and error, one row for each address; what
    they lack counts as an error.

    Of arXiv the second step counts if the first failed; of ICML unless the first has a close title. Of the anthology one volume
    that fails is an error of the whole.
    """
    said = requests.join(payloads.select("url", "accept", "body", F.col("error").alias("_failed")), ["url", "accept"], "left")
    read = candidates_of(said, k)
    error = F.coalesce("_failed", F.when(F.col("body").isNull(), "no answer"), "error")
    rows = read.select("key", "source", "mode", "title", "step", "part", error.alias("error"), "candidates")
    fine = F.col("error").isNull()
    in_order = F.array_sort(F.collect_list(F.when(fine, F.struct("part", "candidates"))))
    steps = rows.groupBy("key", "source", "mode", "title", "step").agg(
        F.when(F.col("source").isin(*WHOLE), F.bool_and(fine)).otherwise(F.bool_or(fine)).alias("ok"),
        F.flatten(F.transform(in_order, lambda x: x["candidates"])).alias("candidates"),
        F.min(F.when(~fine, F.struct("part", "error")))["error"].alias("error"),
    )
    step = lambda n: F.any_value(F.when(F.col("step") == n, F.struct("ok", "candidates", "error")), F.lit(True)).alias(f"_{n}")
    both = steps.groupBy("key", "source", "mode", "title").agg(step(0), step(1))
    no, empty = F.lit(False), F.array().cast(f"array<{CANDIDATE}>")
    ok = [F.coalesce(F.col(f"_{n}.ok"), no) for n in (0, 1)]
    close = F.exists(F.coalesce("_0.candidates", empty), lambda c: close_title(F.col("title"), c["title"]))
    more = ok[1] & F.when(F.col("source") == "icml", ~(ok[0] & close)).otherwise(~ok[0])
    found = F.concat(F.when(ok[0], F.col("_0.candidates")).otherwise(empty), F.when(more, F.col("_1.candidates")).otherwise(empty))
    kept = F.when(F.col("source").isin("icml", *WHOLE), ordered(F.col("title"), found, k)).otherwise(found)
    done = ok[0] | more
    why = F.when(F.col("source") == "icml", F.coalesce("_1.error", "_0.error")).otherwise(F.coalesce("_0.error", "_1.error"))
    return both.select("key", "source", "mode", F.when(done, "ok").otherwise("error").alias("outcome"), F.when(~done, why).alias("error"), F.when(done, kept).otherwise(empty).alias("candidates"))
