"""The sources: their order, their properties, and to which entries each applies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refsift.functions.text import title_key, year_in
from refsift.operators.entries import field_text, link_url, mentions
from refsift.schema import REGISTRY_DDL


@dataclass(frozen=True)
class Source:
    """authoritative: what it doesn't list isn't there; identifier_lookup: it can be asked by DOI or arXiv
    identifier; academic: finding nothing there counts. venues: the words of the venues it covers."""

    name: str
    authoritative: bool = False
    identifier_lookup: bool = False
    academic: bool = True
    venues: tuple[str, ...] = ()


#: The sources in their default order and the venues that official ones answer for.
DEFAULT_SOURCES = (
    Source("url", academic=False),
    Source("arxiv", identifier_lookup=True),
    Source("datacite", identifier_lookup=True),
    Source("openalex", identifier_lookup=True),
    Source("crossref", identifier_lookup=True),
    Source("dblp"),
    Source("iclr", authoritative=True, venues=("iclr", "international conference on learning representations", "proceedings.iclr.cc")),
    Source("neurips", authoritative=True, venues=("neurips", "nips", "neural information processing systems", "papers.nips.cc")),
    Source("icml", authoritative=True, venues=("icml", "international conference on machine learning")),
    Source("acl", authoritative=True, venues=("acl", "annual meeting of the association for computational linguistics")),
    Source("emnlp", authoritative=True, venues=("emnlp", "conference on empirical methods in natural language processing")),
    Source("cvpr", authoritative=True, venues=("cvpr", "conference on computer vision and pattern recognition")),
    Source("iccv", authoritative=True, venues=("iccv", "international conference on computer vision")),
    Source("eccv", authoritative=True, venues=("eccv", "european conference on computer vision")),
    Source("acl_anthology", authoritative=True),
    Source("jmlr", authoritative=True),
    Source("openreview", authoritative=True),
    Source("github", academic=False, identifier_lookup=True),
)
#: Official sources that are asked by year, and not for findings.
YEARLY = ("acl", "emnlp")
SEMANTIC_SCHOLAR = Source("semanticscholar", identifier_lookup=True)


def sources(with_semantic_scholar: bool = False, names: tuple[str, ...] | None = None) -> tuple[Source, ...]:
    """The default sources, the one that needs a key at its place if asked for; or those named."""
    out = list(DEFAULT_SOURCES)
    if with_semantic_scholar or names and SEMANTIC_SCHOLAR.name in names:
        out.insert(5, SEMANTIC_SCHOLAR)
    return tuple(s for s in out if names is None or s.name in names)


def registry(spark: SparkSession, chosen: tuple[Source, ...] = DEFAULT_SOURCES) -> DataFrame:
    return spark.createDataFrame([(s.name, i, s.authoritative, s.identifier_lookup, s.academic) for i, s in enumerate(chosen)], REGISTRY_DDL)


def venue_text() -> Column:
    return F.lower(F.concat_ws(" ", *[F.nullif(field_text(n), F.lit("")) for n in ("booktitle", "journal", "venue", "url")]))


def applies(source: Source) -> Column:
    """Whether an entry, by its fields, is one for this source; sources by other names always apply."""
    journal = F.lower(field_text("journal", "venue"))
    if source.name == "url":
        return (link_url() != "") & ~F.contains(F.lower(link_url()), F.lit("github.com"))
    if source.name == "github":
        return mentions("github")
    if source.name == "dblp":
        return (field_text("doi") == "") & (field_text("arxiv_id", "arxiv", "eprint") == "") & (venue_text() == "")
    if source.name == "acl_anthology":
        return F.contains(journal, F.lit("tacl")) | F.contains(journal, F.lit("transactions of the association"))
    if source.name == "jmlr":
        return F.contains(journal, F.lit("jmlr")) | F.contains(journal, F.lit("journal of machine learning research"))
    if source.name == "openreview":
        return F.lower(field_text("booktitle", "journal", "venue", "url")).rlike(r"conference on language modeling|international conference on learning representations|colm|iclr|openreview\.net")
    if source.venues:
        words = "|".join(" ".join("".join(c if c.isalnum() else " " for c in v).split()) for v in source.venues)
        named = title_key(venue_text()).rlike(rf"\b(?:{words})\b")
        dated = year_in(field_text("year")).isNotNull() & ~F.contains(venue_text(), F.lit("findings"))
        return named & dated if source.name in YEARLY else named
    return F.lit(True)


def calls(entries: DataFrame, chosen: tuple[Source, ...] = DEFAULT_SOURCES) -> DataFrame:
    """A row for each entry and source that applies: all columns of entries, and the registry's.

    Every entry is paired with the few sources in a projection, without a join.
    """
    each = F.array_compact(
        F.array(
            *[
                F.when(
                    applies(s),
                    F.struct(
                        F.lit(s.name).alias("source"),
                        F.lit(i).alias("source_idx"),
                        F.lit(s.authoritative).alias("authoritative"),
                        F.lit(s.identifier_lookup).alias("identifier_lookup"),
                        F.lit(s.academic).alias("academic"),
                    ),
                )
                for i, s in enumerate(chosen)
            ]
        )
    )
    return entries.select("*", F.inline(each))
