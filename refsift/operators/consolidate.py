"""The second scorer: candidates assessed with missing fields as unknown, ranked, and merged over sources."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refsift.functions import text as T
from refsift.functions.authors import compare_by_score, is_marker_wide, match_by_score, people, score_by_score, status_by_score, truncated, unlike
from refsift.functions.similarity import similarity_of_normal
from refsift.operators.entries import field, field_text
from refsift.operators.scoring import same_identifier

TITLE_WEIGHT, AUTHOR_WEIGHT, YEAR_WEIGHT = 0.65, 0.25, 0.10


def evidence_score(title: Column, has_titles: Column, author: Column, year: Column) -> Column:
    """Weighted over what is known."""
    weight = F.when(has_titles, TITLE_WEIGHT).otherwise(0.0) + F.when(author.isNotNull(), AUTHOR_WEIGHT).otherwise(0.0) + F.when(year.isNotNull(), YEAR_WEIGHT).otherwise(0.0)
    whole = F.when(has_titles, TITLE_WEIGHT * title).otherwise(0.0) + F.coalesce(AUTHOR_WEIGHT * author, F.lit(0.0)) + F.coalesce(YEAR_WEIGHT * year, F.lit(0.0))
    return F.coalesce(F.try_divide(whole, weight), F.lit(0.0))


def confidence(matches: Column, conflict: Column, title: Column, status: Column, year: Column) -> Column:
    near_year = year.isNull() | (year >= 0.7)
    return (
        F.when(conflict, "identifier_conflict")
        .when(matches, "identifier")
        .when((title >= 0.92) & near_year & (status == "not_available"), "title_only")
        .when((title >= 0.92) & near_year & status.isin("match", "partial_match"), "strong")
        .when((title >= 0.82) & (status != "major_mismatch"), "probable")
        .otherwise("weak")
    )


def assessed(rows: DataFrame, with_ratio: bool = True) -> DataFrame:
    """rows: key, fields and a candidate `c`. Adds `a`: the candidate's score, its parts, comparison and confidence."""
    kept = rows.columns
    names = F.coalesce(F.filter(F.transform("c.authors", lambda n: F.trim(n)), lambda n: n != ""), F.array().cast("array<string>"))
    authors = F.filter(F.transform(F.split(F.coalesce(field("authors"), field("author"), F.lit("")), r"(?iU)\s+and\s+"), lambda n: F.trim(n)), lambda n: n != "")
    one = rows.select(
        "*",
        authors.alias("_authors"),
        names.alias("_names"),
        T.normal_text_and(field_text("title")).alias("_n"),
        T.normal_text_and(F.col("c.title")).alias("_cn"),
        T.year_similarity(T.year_in(field_text("year")), F.col("c.year")).alias("_year"),
        T.find_doi(F.col("c.identifier"), F.col("c.url"), F.col("c.doi")).alias("_doi"),
        T.find_arxiv_any(F.col("c.identifier"), F.col("c.url"), F.col("c.arxiv_id"), F.col("c.arxiv"), F.col("c.eprint")).alias("_arxiv"),
    )
    two = one.select(
        "*",
        people(F.col("_authors"), is_marker_wide, T.normal_text_and).alias("_e"),
        people(F.col("_names"), is_marker_wide, T.normal_text_and).alias("_a"),
        truncated(F.col("_authors"), is_marker_wide).alias("_ecut"),
        F.coalesce("c.authors_truncated", truncated(F.col("_names"), is_marker_wide)).alias("_said"),
        similarity_of_normal(F.col("_n"), F.col("_cn"), with_ratio).alias("_title"),
    )
    three = two.select("*", (F.col("_said") | F.coalesce(F.col("c.author_total") > F.size("_a"), F.lit(False))).alias("_acut"), match_by_score(F.col("_e"), F.col("_a")).alias("_pairs"))
    sides = [F.col(x) for x in ("_e", "_a", "_pairs", "_ecut", "_acut")]
    apart = three.select("*", unlike(*sides[:3], all_moves=True).alias("_unlike"))
    judged = apart.select("*", status_by_score(*sides, F.col("_unlike")).alias("_status"))
    four = judged.select(
        "*",
        compare_by_score(*sides, F.col("_unlike"), F.col("_status")).alias("_cmp"),
        score_by_score(F.col("_e"), F.col("_a"), F.col("_pairs"), F.col("_ecut") | F.col("_acut")).alias("_author"),
        (
            same_identifier(T.normal_doi(field_text("doi")), T.normal_doi(F.col("_doi")))
            | same_identifier(T.normal_arxiv_any(field_text("arxiv_id", "arxiv", "eprint")), T.normal_arxiv_any(F.col("_arxiv")))
        ).alias("_id"),
    )
    title, author, year = F.col("_title"), F.col("_author"), F.col("_year")
    five = four.withColumn("_conflict", F.col("_id") & ((title < 0.55) | (F.col("_status") == "major_mismatch")))
    plain = evidence_score(title, (F.col("_n") != "") & (F.col("_cn") != ""), author, year)
    plain = F.when(author.isNull() & (title >= 0.95), F.least(plain, F.lit(0.86))).otherwise(plain)
    score = F.when(F.col("_id"), 0.72 + 0.20 * title + 0.08 * F.coalesce(author, F.lit(0.5))).otherwise(plain) * F.when(F.col("_conflict"), 0.35).otherwise(1.0)
    rich = sum((F.when(x, 1).otherwise(0) for x in (F.coalesce("c.title", F.lit("")) != "", F.size("_names") > 0, F.coalesce("c.year", F.lit(0)) != 0, F.col("_doi") != "", F.col("_arxiv") != "", F.coalesce("c.venue", F.lit("")) != "")), F.lit(0))
    return five.select(
        *kept,
        F.struct(
            T.round3(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).alias("score"),
            T.round3(title).alias("title_score"),
            F.when(author.isNotNull(), T.round3(author)).alias("author_score"),
            year.alias("year_score"),
            F.col("_id").alias("identifier_match"),
            F.col("_conflict").alias("identifier_conflict"),
            confidence(F.col("_id"), F.col("_conflict"), title, F.col("_status"), year).alias("confidence"),
            F.col("_cmp").alias("author_comparison"),
            rich.alias("richness"),
            T.normal_doi(F.col("_doi")).alias("doi"),
            T.normal_arxiv_any(F.col("_arxiv")).alias("arxiv"),
            F.col("_cn").alias("n_title"),
        ).alias("a"),
    )


def ranked_assessments(rows: DataFrame) -> DataFrame:
    """rows: key, pos and a. Adds rank: without conflict, by identifier, sure ones, then scores."""
    a = F.col("a")
    keys = [a["identifier_conflict"].asc(), a["identifier_match"].desc(), a["confidence"].isin("identifier", "strong").desc(), a["score"].desc(), a["title_score"].desc(), F.coalesce(a["author_score"], F.lit(-1.0)).desc(), F.col("pos").asc()]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(*keys)))


def _join_greedily(rows: pd.DataFrame, links: set[tuple[int, int]]) -> list[int]:
    """Each in rank order joins the first group with a member it is linked to."""
    groups: list[list[int]] = []
    out = []
    for rank in rows["rank"]:
        at = next((g for g, members in enumerate(groups) if any((m, rank) in links for m in members)), len(groups))
        if at == len(groups):
            groups.append([])
        groups[at].append(rank)
        out.append(at)
    return out


def _grouped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in frames:
        links = {(a, b) for b, many in zip(rows["rank"], rows["linked"], strict=True) for a in (many if many is not None else [])}
        yield rows.assign(group_no=_join_greedily(rows, links))[["key", "rank", "group_no"]]


def consolidated(rows: DataFrame, with_ratio: bool = True) -> DataFrame:
    """rows: key, pos, c and a. A row for each group of records of one work: key, group_no, representative,
    observations, sources and score, groups by score.

    Records of one entry are few, so their pairs are compared in one join within the entry; which group
    takes a record depends on those before it, and only that is left to a grouped function.
    """
    order = ranked_assessments(rows)
    slim = order.select("key", "rank", F.col("a.doi").alias("doi"), F.col("a.arxiv").alias("arxiv"), F.col("a.n_title").alias("t"), F.col("c.year").alias("y"), F.col("c.authors").alias("names"))
    b = slim.toDF("key", *[f"b_{x}" for x in slim.columns[1:]])
    pairs = slim.join(b, "key").filter("rank < b_rank")
    none = F.array().cast("array<string>")
    left, right = (people(F.coalesce(F.col(x), none), is_marker_wide, T.normal_text_and) for x in ("names", "b_names"))
    measured = pairs.select("key", "rank", "b_rank", "doi", "b_doi", "arxiv", "b_arxiv", "y", "b_y", similarity_of_normal(F.col("b_t"), F.col("t"), with_ratio).alias("alike"), right.alias("e"), left.alias("o"),
                            truncated(F.coalesce("b_names", none), is_marker_wide).alias("ecut"), truncated(F.coalesce("names", none), is_marker_wide).alias("ocut"))
    matched = measured.select("*", match_by_score(F.col("e"), F.col("o")).alias("p"))
    matched = matched.select("*", unlike(F.col("e"), F.col("o"), F.col("p"), all_moves=True).alias("u"))
    status = status_by_score(*[F.col(x) for x in ("e", "o", "p", "ecut", "ocut", "u")])
    works = (F.col("alike") >= 0.94) & T.years_compatible(F.col("y"), F.col("b_y")) & ((F.size("e") == 0) | (F.size("o") == 0) | (status != "major_mismatch"))
    same = F.when((F.col("doi") != "") & (F.col("b_doi") != ""), F.col("doi") == F.col("b_doi")).when((F.col("arxiv") != "") & (F.col("b_arxiv") != ""), F.col("arxiv") == F.col("b_arxiv")).otherwise(works)
    # Not a filter: it would be pushed below all the steps, and spell them out at each of its references.
    linked = matched.groupBy("key", F.col("b_rank").alias("rank")).agg(F.collect_list(F.when(same, F.col("rank"))).alias("linked"))
    groups = (
        order.select("key", "rank").join(linked, ["key", "rank"], "left").groupBy("key")
        .applyInPandas(lambda rows: next(_grouped(iter([rows.sort_values("rank")]))), "key string, rank int, group_no int")
    )
    whole = order.join(groups, ["key", "rank"])
    best = F.max_by(F.struct("c", "a"), F.struct("a.richness", "a.score", "a.title_score", (-F.col("rank")).alias("first")))
    out = whole.groupBy("key", "group_no").agg(
        best.alias("representative"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "c"))), lambda x: x["c"]).alias("observations"),
    )
    sources = F.filter(F.array_distinct(F.transform("observations", lambda c: c["source"])), lambda s: F.coalesce(s, F.lit("")) != "")
    scored = out.withColumn("sources", sources).withColumn("score", T.round3(F.least(F.lit(1.0), F.col("representative.a.score") + F.least(F.lit(0.08), F.lit(0.03) * F.greatest(F.lit(0), F.size("sources") - 1)))))
    return scored.withColumn("position", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "group_no")))
