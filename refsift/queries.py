"""Named queries over the driver's tables, each with its SQL for an oracle where SQL can say it.

The tables hold no bibliography. A work is a part: its title is name and type, its years are those of its
shipments, its authors the suppliers of its odd lines, and another record of it has those of the even lines.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refsift.functions import authors as A
from refsift.functions import browser
from refsift.functions import text as T
from refsift.functions.similarity import dice, sequence_ratio, token_score
from refsift.operators import lookup, reporting, worklist
from refsift.operators.consolidate import evidence_score
from refsift.operators.entries import entry_columns, specific_title
from refsift.operators.near_titles import near_titles
from refsift.operators.scoring import composite, version_key
from refsift.operators.title_index import TitleIndex
from refsift.plans import requests, stages
from refsift.plans.engine import check, counted, flagged, planned_calls
from refsift.plans.profiles import BROWSER, FULL
from refsift.plans.registry import DEFAULT_SOURCES, calls
from refsift.shared import PREFIX, shared_dir
from refsift.sources.bibsplit import split_entries
from refsift.sources.bibtex import entries_of
from refsift.sources.latex import closure, document_keys, reached
from refsift.sources.records import function_answers, parsed, record_answers
from refsift.streaming.watch import replaced, second_pass

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Texts


@query("SELECT doc_id, trim(regexp_replace(lower(replace(text, 'ß', 'ss')), '[^a-z0-9]+', ' ', 'g')) AS title_key FROM documents")
def title_key_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.title_key(F.col("text")).alias("title_key"))


@query("SELECT doc_id, trim(regexp_replace(lower(strip_accents(replace(text, 'ß', 'ss'))), '[^a-z0-9]+', ' ', 'g')) AS normal FROM documents")
def normal_text_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normal_text(F.col("text")).alias("normal"))


@query("SELECT doc_id, trim(regexp_replace(lower(strip_accents(replace(replace(text, 'ß', 'ss'), '&', ' and '))), '[^a-z0-9]+', ' ', 'g')) AS normal FROM documents")
def normal_text_and_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normal_text_and(F.col("text")).alias("normal"))


@query(
    "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1) AS h1, lower(regexp_extract(html, 'charset=\"?([A-Za-z0-9-]+)', 1)) AS charset FROM pages"
)
def html_metadata(spark, sf_dir):
    get = lambda pattern: F.regexp_extract("html", pattern, 1)
    return table(spark, sf_dir, "pages").select("page_id", get("<title>([^<]*)</title>").alias("title"), get("<h1[^>]*>([^<]*)</h1>").alias("h1"), F.lower(get('charset="?([A-Za-z0-9-]+)')).alias("charset"))


@query("SELECT page_id, regexp_extract('see ' || url || ' (web)', '(?i)https?://[^\\s{}<>]+', 0) AS url, regexp_extract(url, '://([^/?#]+)', 1) AS host FROM pages")
def url_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.find_url(F.concat(F.lit("see "), "url", F.lit(" (web)"))).alias("url"), F.regexp_extract("url", "://([^/?#]+)", 1).alias("host"))


@query("SELECT p_partkey, length(p_name) + 1 + length(p_type) + 4 AS chars FROM part")
def strip_html_lengths(spark, sf_dir):
    text = F.concat(F.lit("<p>"), "p_name", F.lit("</p><b> "), "p_type", F.lit("</b>&nbsp; &lt;i&gt; &amp;  a"))
    return table(spark, sf_dir, "part").select("p_partkey", F.length(T.strip_html(text)).alias("chars"))


# Identifiers and years


@query(
    "SELECT p_partkey, '10.1000/p' || p_partkey AS normal, '10.1000/P' || p_partkey AS found, CASE WHEN p_partkey % 2 = 0 THEN '10.1000/P' || p_partkey ELSE '10.1000/P' || p_partkey || ')' END AS property FROM part"
)
def doi_normal(spark, sf_dir):
    raw = F.concat(F.lit("https://doi.org/10.1000/P"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 2 == 0, ".").otherwise(")."))
    return table(spark, sf_dir, "part").select("p_partkey", T.normal_doi(raw).alias("normal"), T.find_doi(F.lit("none"), raw).alias("found"), T.entry_doi_property(raw).alias("property"))


_ARXIV = "lpad((p_partkey % 10000)::VARCHAR, 4, '0') || '.' || lpad((p_partkey % 100000)::VARCHAR, 5, '0')"


@query(f"SELECT p_partkey, {_ARXIV} AS normal, {_ARXIV} AS found, (p_partkey % 9 + 1)::INT AS version FROM part")
def arxiv_normal(spark, sf_dir):
    ident = F.concat(F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0"), F.lit("."), F.lpad((F.col("p_partkey") % 100000).cast("string"), 5, "0"))
    raw = F.concat(F.lit("https://arxiv.org/abs/"), ident, F.lit("v"), (F.col("p_partkey") % 9 + 1).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", T.normal_arxiv(raw).alias("normal"), T.find_arxiv(raw).alias("found"), T.arxiv_version(raw).alias("version"))


@query("SELECT doc_id, try_cast(nullif(regexp_extract(text, '(?:18|19|20|21)[0-9][0-9]', 0), '') AS INT) AS year, try_cast(nullif(regexp_extract(text, '[0-9]{4}', 0), '') AS INT) AS four_digits FROM documents")
def year_extract(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.year_in(F.col("text")).alias("year"), T.first_four_digits(F.col("text")).alias("four_digits"))


@query("SELECT event_id, year(ts)::INT AS from_ms, year(ts)::INT AS from_seconds FROM events")
def epoch_year(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", T.epoch_year(F.unix_millis(ts)).alias("from_ms"), T.epoch_year(F.unix_seconds(ts)).alias("from_seconds"))


# Works: the derived bibliography

WORKS_SQL = """works AS (
  SELECT p_partkey AS k, p_name || ' ' || p_type AS title, p_name AS short_title, p_brand AS brand,
    min(year(l_shipdate)) FILTER (WHERE l_linenumber % 2 = 1)::INT AS y1, min(year(l_shipdate)) FILTER (WHERE l_linenumber % 2 = 0)::INT AS y2,
    coalesce(list_sort(list(DISTINCT s_name) FILTER (WHERE l_linenumber % 2 = 1)), []) AS a1, coalesce(list_sort(list(DISTINCT s_name) FILTER (WHERE l_linenumber % 2 = 0)), []) AS a2
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY p_partkey, p_name, p_type, p_brand
)"""


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    odd = F.col("l_linenumber") % 2 == 1
    names = lambda when: F.array_sort(F.collect_set(F.when(when, F.col("s_name"))))
    grouped = lines.groupBy(F.col("p_partkey").alias("k"), "p_name", "p_type", F.col("p_brand").alias("brand"))
    whole = grouped.agg(F.min(F.when(odd, F.year("l_shipdate"))).alias("y1"), F.min(F.when(~odd, F.year("l_shipdate"))).alias("y2"), names(odd).alias("a1"), names(~odd).alias("a2"))
    return whole.select("k", F.concat_ws(" ", "p_name", "p_type").alias("title"), F.col("p_name").alias("short_title"), "brand", "y1", "y2", "a1", "a2")


@query(f"WITH {WORKS_SQL} SELECT k, CASE abs(y1 - y2) WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 ELSE CASE WHEN y1 IS NULL OR y2 IS NULL THEN NULL ELSE 0.0 END END::DOUBLE AS similarity, coalesce(abs(y1 - y2) <= 1, true) AS compatible FROM works")
def year_similarity(spark, sf_dir):
    y1, y2 = F.col("y1"), F.col("y2")
    return works(spark, sf_dir).select("k", T.year_similarity(y1, y2).alias("similarity"), T.years_compatible(y1, y2).alias("compatible"))


_VENUES = ("Proc. of NeurIPS", "ICLR 2021", "Transactions of the Association for Computational Linguistics", "Findings of EMNLP", "CoRR", "Journal of Machine Learning Research", "Nature", "ACL Anthology", "ICML Workshop", "arXiv preprint", "CVPR", "European Conference on Computer Vision", "NIPSX")
_NAMES = ("neurips", "iclr", "tacl", "emnlp", "arxiv", "jmlr", "", "acl", "icml", "arxiv", "cvpr", "eccv", "")


@query("SELECT p_partkey, CASE p_partkey % 13 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES)) + " END AS name, p_partkey % 13 IN (0) AS is_neurips FROM part")
def venue_canonical(spark, sf_dir):
    venue = F.get(F.array(*[F.lit(v) for v in _VENUES]), (F.col("p_partkey") % 13).cast("int"))
    parts = table(spark, sf_dir, "part").withColumn("venue", venue)
    return parts.select("p_partkey", T.canonical_venue(T.normal_text(F.col("venue"))).alias("name"), T.venues_equal(F.col("venue"), F.lit("Neural Information Processing Systems (NIPS)")).alias("is_neurips"))


# Authors


@query(f"WITH {WORKS_SQL} SELECT k, len(a1) AS n, array_to_string(a1, '|') AS names FROM works")
def author_split(spark, sf_dir):
    joined = works(spark, sf_dir).withColumn("text", F.array_join("a1", " and "))
    return joined.select("k", F.size(A.split_authors(F.col("text"))).cast("long").alias("n"), F.array_join(A.split_authors(F.col("text")), "|").alias("names"))


@query("SELECT c_custkey, regexp_extract(c_name, '([0-9]+)', 1) AS family, 'customer' AS given, CASE WHEN c_custkey % 2 = 0 THEN 'Customer ' || regexp_extract(c_name, '([0-9]+)', 1) ELSE c_name END AS shown FROM customer")
def author_identity(spark, sf_dir):
    number = F.regexp_extract("c_name", "([0-9]+)", 1)
    name = F.when(F.col("c_custkey") % 2 == 0, F.concat(number, F.lit(", Customer"))).otherwise(F.col("c_name"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"))
    who = rows.select("c_custkey", A.identity(F.col("name")).alias("who"), A.display(F.col("name")).alias("shown"))
    return who.select("c_custkey", "who.family", F.array_join("who.given", " ").alias("given"), "shown")


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = works(spark, sf_dir).select("*", A.people(F.col("a1")).alias("e"), A.people(F.col("a2")).alias("a"))
    return held.withColumn("pairs", A.match_in_order(F.col("e"), F.col("a")))


_F1 = "CASE WHEN len(list_intersect(a1, a2)) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(a1, a2)) / (len(a1) + len(a2)) END"


@query(f"WITH {WORKS_SQL} SELECT k, round({_F1}::DOUBLE, 9) AS f1 FROM works")
def author_overlap_f1(spark, sf_dir):
    return _matched(spark, sf_dir).select("k", F.round(A.f1(F.col("e"), F.col("a"), F.col("pairs"), F.lit(False)), 9).alias("f1"))


@query(
    f"""WITH {WORKS_SQL}, sides AS (
  SELECT k, a1, a2, list_filter(a2, lambda x: NOT list_contains(a1, x)) AS added, list_filter(a1, lambda x: NOT list_contains(a2, x)) AS removed, len(list_intersect(a1, a2)) / greatest(len(a1), len(a2), 1) AS overlap FROM works
) SELECT k, CASE WHEN len(a1) = 0 OR len(a2) = 0 THEN 'not_available' WHEN len(added) + len(removed) = 0 THEN 'match' WHEN overlap >= 0.6 THEN 'minor_difference' ELSE 'major_mismatch' END AS status,
  CASE WHEN len(a1) = 0 OR len(a2) = 0 THEN '' ELSE array_to_string([list_position(a2, x) || ':' || x FOR x IN added], '|') END AS added,
  CASE WHEN len(a1) = 0 OR len(a2) = 0 THEN '' ELSE array_to_string([list_position(a1, x) || ':' || x FOR x IN removed], '|') END AS removed FROM sides"""
)
def author_added_removed(spark, sf_dir):
    told = _matched(spark, sf_dir).select("*", A.unlike(F.col("e"), F.col("a"), F.col("pairs"), all_moves=False).alias("d"))
    compared = told.select("k", A.compare_in_order(F.col("e"), F.col("a"), F.col("pairs"), F.lit(False), F.col("d")).alias("c"))
    said = lambda part: F.array_join(F.transform(f"c.{part}", lambda x: F.concat(x["position"].cast("string"), F.lit(":"), x["name"])), "|").alias(part)
    return compared.select("k", "c.status", said("added"), said("removed"))


@query(f"WITH {WORKS_SQL} SELECT k, len(list_intersect(a1, a2)) AS n, CASE WHEN len(a1) > 0 AND len(a2) > 0 THEN round(2.0 * len(list_intersect(a1, a2)) / (len(a1) + len(a2)), 9)::DOUBLE END AS score FROM works")
def author_match_by_score(spark, sf_dir):
    held = works(spark, sf_dir).select("*", A.people(F.col("a1")).alias("e"), A.people(F.col("a2")).alias("a"))
    paired = held.withColumn("pairs", A.match_by_score(F.col("e"), F.col("a")))
    return paired.select("k", F.size("pairs").cast("long").alias("n"), F.round(A.score_by_score(F.col("e"), F.col("a"), F.col("pairs"), F.lit(False)), 9).alias("score"))


# Titles

_TOKENS = "list_distinct(string_split(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), ' '))"
_NEIGHBOURS_SQL = f"""pairs AS (
  SELECT p_partkey AS k, {_TOKENS.format("p_name || ' ' || p_type")} AS a, {_TOKENS.format("lead(p_name || ' ' || p_type) OVER (ORDER BY p_partkey)")} AS b FROM part
), both_ AS (SELECT k, a, b, len(list_intersect(a, b)) AS i FROM pairs WHERE b IS NOT NULL)"""


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat_ws(" ", "p_name", "p_type")
    keys = table(spark, sf_dir, "part").select("p_partkey", title.alias("title"))
    following = keys.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("title").alias("other"))
    return keys.join(following, "p_partkey").select(F.col("p_partkey").alias("k"), T.title_key(F.col("title")).alias("ta"), T.title_key(F.col("other")).alias("tb"))


@query(f"WITH {_NEIGHBOURS_SQL} SELECT k, round(0.55 * i / (len(a) + len(b) - i) + 0.45 * i / least(len(a), len(b)), 9)::DOUBLE AS score, round(2.0 * i / (len(a) + len(b)), 9)::DOUBLE AS dice FROM both_")
def title_token_similarity(spark, sf_dir):
    held = _neighbours(spark, sf_dir).select("k", T.token_set(F.col("ta")).alias("a"), T.token_set(F.col("tb")).alias("b"))
    return held.select("k", F.round(token_score(F.col("a"), F.col("b")), 9).alias("score"), F.round(dice(F.col("a"), F.col("b")), 9).alias("dice"))


@query()
def title_ratio(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("k", T.round3(sequence_ratio(F.col("ta"), F.col("tb"))).alias("ratio"))


@query("SELECT item_id, len(w) >= 8 AND len(list_distinct(list_filter(w, lambda x: length(x) >= 5 AND x NOT IN ('about', 'based', 'from', 'large', 'learning', 'model', 'models', 'paper', 'study', 'using', 'with')))) >= 2 AS specific FROM (SELECT item_id, string_split(trim(regexp_replace(lower(strip_accents(replace(text, 'ß', 'ss'))), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM benchmark)")
def title_specific(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", specific_title(T.normal_text(F.col("text"))).alias("specific"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE lower(p_name) END AS version FROM part")
def title_version_key(spark, sf_dir):
    title = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" "), "p_type")).otherwise(F.concat("p_name", F.lit(": "), "p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", version_key(title).alias("version"))


# Lookup



def _bibliography(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Entries and records of all parts; records lack a DOI where the key divides by 2, an arXiv id where by 3."""
    parts = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    number = F.lpad((k % 100000).cast("string"), 5, "0")
    entries = parts.select(
        k.cast("string").alias("key"), F.concat_ws(" ", "p_name", "p_type", k.cast("string")).alias("title"), F.concat(F.lit("10.1000/p"), k.cast("string")).alias("n_doi"), F.concat(F.lit("2001."), number).alias("n_arxiv")
    )
    text = lambda when, value: F.when(when, value).otherwise("")
    records = parts.select(
        k.alias("record_id"),
        F.concat(F.upper("p_name"), F.lit(": "), "p_type", F.lit(" ("), k.cast("string"), F.lit(")")).alias("title"),
        text(k % 2 != 0, F.concat(F.lit("https://doi.org/10.1000/P"), k.cast("string"))).alias("doi"),
        F.lit("").alias("url"),
        text(k % 3 != 0, F.concat(F.lit("arXiv:2001."), number, F.lit("v2"))).alias("arxiv_id"),
        F.lit("").alias("arxiv"),
        F.lit("").alias("eprint"),
    )
    return entries, lookup.record_columns(records)


@query("SELECT p_partkey::VARCHAR AS key, p_partkey AS record_id FROM part WHERE p_partkey % 2 <> 0")
def lookup_doi(spark, sf_dir):
    return lookup.by_doi(*_bibliography(spark, sf_dir))


@query("SELECT a.p_partkey::VARCHAR AS key, b.p_partkey AS record_id FROM part a JOIN part b ON a.p_partkey % 100000 = b.p_partkey % 100000 WHERE b.p_partkey % 3 <> 0")
def lookup_arxiv(spark, sf_dir):
    return lookup.by_arxiv(*_bibliography(spark, sf_dir))


@query("SELECT p_partkey::VARCHAR AS key, p_partkey AS record_id FROM part")
def lookup_title(spark, sf_dir):
    return lookup.by_title(*_bibliography(spark, sf_dir))


@query("SELECT p_partkey::VARCHAR AS key, p_partkey AS record_id FROM part UNION SELECT a.p_partkey::VARCHAR, b.p_partkey FROM part a JOIN part b ON a.p_partkey % 100000 = b.p_partkey % 100000 WHERE b.p_partkey % 3 <> 0")
def lookup_any(spark, sf_dir):
    return lookup.by_any(*_bibliography(spark, sf_dir))


@query("SELECT p_partkey::VARCHAR AS key, p_partkey AS record_id FROM part UNION SELECT p_partkey::VARCHAR, 0 FROM part")
def lookup_keyed(spark, sf_dir):
    entries, records = _bibliography(spark, sf_dir)
    keyed = records.select(F.concat(F.lit("title:"), "k_title").alias("lookup"), "record_id").unionByName(spark.range(1).select(F.lit("*").alias("lookup"), F.lit(0).cast("long").alias("record_id")))
    return lookup.by_lookup_key(entries, keyed)


_KEY = "trim(regexp_replace(lower(replace({}, 'ß', 'ss')), '[^a-z0-9]+', ' ', 'g'))"
_TITLES_SQL = f"""items AS (SELECT item_id, list_distinct(list_filter(string_split({_KEY.format("text")}, ' '), lambda x: x <> '')) AS w, {_KEY.format("text")} AS k FROM benchmark),
docs AS (SELECT doc_id, list_distinct(list_filter(string_split({_KEY.format("string_split(text, chr(10))[1]")}, ' '), lambda x: x <> '')) AS w, {_KEY.format("string_split(text, chr(10))[1]")} AS k FROM documents),
pairs AS (SELECT item_id, doc_id, i.k = d.k AS same_key, 2.0 * len(list_intersect(i.w, d.w)) / (len(i.w) + len(d.w)) AS overlap FROM items i, docs d WHERE len(i.w) > 0 AND len(d.w) > 0)"""


def _first_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("key"), F.col("text").alias("title"))
    return items, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), F.substring_index("text", "\n", 1).alias("title"))


@query(f"WITH {_TITLES_SQL} SELECT item_id::VARCHAR AS key, doc_id AS record_id, row_number() OVER (PARTITION BY item_id ORDER BY same_key DESC, overlap DESC, doc_id)::INT AS pos, round(overlap, 9)::DOUBLE AS overlap FROM pairs WHERE overlap >= 0.4 QUALIFY pos <= 5")
def similar_titles_top5(spark, sf_dir):
    return lookup.similar_titles(*_first_lines(spark, sf_dir), k=5, like=lookup.Likeness(0.4)).select("key", "record_id", "pos", F.round("overlap", 9).alias("overlap"))


_PARTS_SQL = f"""t AS (SELECT p_partkey AS id, 's' || p_partkey % 3 AS source, {_KEY.format("p_name || ' ' || p_type || ' ' || p_brand")} AS k FROM part),
d AS (SELECT k, list_distinct(string_split(k, ' ')) AS w FROM t GROUP BY k),
m AS (SELECT a.k AS ak, b.k AS bk, 2.0 * len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w)) AS overlap FROM d a, d b),
f AS (SELECT ak, bk, source, id, overlap, row_number() OVER (PARTITION BY ak, source ORDER BY ak = bk DESC, overlap DESC, id)::INT AS pos FROM m JOIN t ON t.k = bk WHERE overlap >= 0.6 QUALIFY pos <= 3)"""


def _part_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("record_id"), F.concat(F.lit("s"), (F.col("p_partkey") % 3).cast("string")).alias("source"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("title"))


@query(f"WITH {_PARTS_SQL} SELECT t.id::VARCHAR AS key, f.id AS record_id, f.source, f.pos, round(f.overlap, 9)::DOUBLE AS overlap FROM t JOIN f ON t.k = f.ak")
def title_index_search(spark, sf_dir):
    """All parts' titles looked up in a stored index of them, which grew in three generations."""
    held = _part_titles(spark, sf_dir)
    third = F.pmod(F.xxhash64("record_id"), F.lit(3))
    index = TitleIndex.build(held.filter(third == 0), f"{shared_dir(spark)}/{PREFIX}{uuid4().hex}", k=3)
    index = index.add(held.filter(third == 1)).add(held.filter(third == 2))
    found = index.similar(held.select(F.col("record_id").cast("string").alias("key"), "title"), lookup.Likeness(0.6))
    return found.select("key", "record_id", "source", "pos", F.round("overlap", 9).alias("overlap"))


@query()
def near_titles_misspelt(spark, sf_dir):
    """Each part's title without the second letter of every word, and the titles nearest to it as sequences: no word finds them."""
    held = _part_titles(spark, sf_dir)
    words = F.transform(F.split("title", " "), lambda w: F.concat(F.substring(w, 1, 1), F.substring(w, 3, 99)))
    asked = held.select(F.col("record_id").cast("string").alias("key"), F.array_join(words, " ").alias("title"))
    return near_titles(asked, held, T.normal_text(F.col("title")), 3, 0.85).select("key", "record_id", "pos", F.round("ratio", 9).alias("ratio"))


# Sets


@query("SELECT c_custkey::VARCHAR AS key FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def worklist_semi(spark, sf_dir):
    entries = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"))
    return worklist.work_list(entries, table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("key")))


@query("SELECT DISTINCT (o_custkey + 5)::VARCHAR AS key FROM orders WHERE o_custkey + 5 NOT IN (SELECT c_custkey FROM customer)")
def missing_anti(spark, sf_dir):
    entries = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"))
    return worklist.missing_keys(entries, table(spark, sf_dir, "orders").select((F.col("o_custkey") + 5).cast("string").alias("key")))


@query("SELECT c_custkey::VARCHAR AS key, false AS with_wildcard FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def unused_wildcard(spark, sf_dir):
    entries = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"))
    cited = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("key"))
    wild = worklist.cited_keys(cited, spark.range(1).select(F.lit("*").alias("key")))
    plain = worklist.unused_entries(entries, cited).withColumn("with_wildcard", F.lit(False))
    return plain.unionByName(worklist.unused_entries(entries, wild).withColumn("with_wildcard", F.lit(True)))


@query("SELECT o_orderkey::VARCHAR AS key, greatest((SELECT count(*) FROM orders) - 60, 0) AS truncated FROM orders ORDER BY key LIMIT 60")
def entry_cap(spark, sf_dir):
    return worklist.capped(table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("key")), 60)


# Sources, scores, stages


@query(
    "SELECT p_partkey::VARCHAR AS key, source FROM part, (VALUES ('datacite', -1), ('openalex', -1), ('crossref', -1), ('arxiv', -1), ('neurips', 0), ('iclr', 1), ('openreview', 1), ('acl_anthology', 2), ('acl', 2), ('jmlr', 5), ('acl', 7), ('icml', 8), ('cvpr', 10), ('eccv', 11)) v(source, n) WHERE (n = -1 OR p_partkey % 13 = n) AND NOT (source = 'acl' AND n = 2)"
)
def source_applies(spark, sf_dir):
    venue = F.get(F.array(*[F.lit(v) for v in _VENUES]), (F.col("p_partkey") % 13).cast("int"))
    entries = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("key"), F.create_map(F.lit("title"), F.col("p_name"), F.lit("year"), F.lit("2021"), F.lit("booktitle"), venue, F.lit("journal"), venue).alias("fields"))
    return calls(entries).select("key", "source")


@query(
    f"WITH {WORKS_SQL}, parts AS (SELECT k, {_F1} AS f, CASE WHEN y1 IS NULL OR y2 IS NULL THEN NULL WHEN y1 = y2 THEN 1.0 WHEN abs(y1 - y2) = 1 THEN 0.7 ELSE 0.0 END AS y FROM works) SELECT k, round(least(1, 0.58 * 0.5371 + 0.27 * f + coalesce(0.10 * y, 0.05) + CASE WHEN k % 2 = 0 THEN 0.25 ELSE 0 END)::DOUBLE, 3) AS score FROM parts"
)
def score_composite(spark, sf_dir):
    rows = _matched(spark, sf_dir)
    author = A.f1(F.col("e"), F.col("a"), F.col("pairs"), F.lit(False))
    return rows.select("k", composite(F.lit(0.5371), author, T.year_similarity(F.col("y1"), F.col("y2")), F.col("k") % 2 == 0).alias("score"))


@query(
    f"WITH {WORKS_SQL}, parts AS (SELECT k, CASE WHEN len(a1) > 0 AND len(a2) > 0 THEN {_F1} END AS f, CASE WHEN y1 IS NULL OR y2 IS NULL THEN NULL WHEN y1 = y2 THEN 1.0 WHEN abs(y1 - y2) = 1 THEN 0.7 ELSE 0.0 END AS y FROM works) SELECT k, round(((0.65 * 0.5 + coalesce(0.25 * f, 0) + coalesce(0.10 * y, 0)) / (0.65 + CASE WHEN f IS NULL THEN 0 ELSE 0.25 END + CASE WHEN y IS NULL THEN 0 ELSE 0.10 END))::DOUBLE, 9) AS score FROM parts"
)
def score_renormalised(spark, sf_dir):
    rows = _matched(spark, sf_dir)
    author = A.score_by_score(F.col("e"), F.col("a"), F.col("pairs"), F.lit(False))
    return rows.select("k", F.round(evidence_score(F.lit(0.5), F.lit(True), author, T.year_similarity(F.col("y1"), F.col("y2"))), 9).alias("score"))


@query(
    """WITH obs AS (SELECT l_orderkey AS key, l_linenumber AS stage, l_discount >= 0.09 AS decides FROM lineitem),
stops AS (SELECT key, min(stage) FILTER (WHERE decides) AS stop FROM obs GROUP BY key)
SELECT o.key::VARCHAR AS key, stage::INT AS stage FROM obs o JOIN stops s ON o.key = s.key WHERE (stop IS NULL OR stage <= stop)"""
)
def early_exit(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("key"), F.lit("title").alias("mode"), F.col("l_linenumber").alias("stage"), F.array().cast("array<string>").alias("candidates"), F.lit(False).alias("misses"), (F.col("l_discount") >= 0.09).alias("decides")
    )
    return stages.kept_observations(lines).select("key", "stage")


@query("SELECT user_id, count(DISTINCT event_type) FILTER (WHERE event_type <> 'error') AS completed, count(*) FILTER (WHERE event_type = 'click') AS authoritative_misses, bool_or(event_type = 'error') AS failed FROM events GROUP BY user_id")
def source_counters(spark, sf_dir):
    """Events as calls: a user is an entry, each type of event a source."""
    kinds = F.array(*[F.lit(x) for x in ("view", "signup", "click", "error", "purchase")])
    failed, no = F.col("event_type") == "error", F.lit(False)
    calls_ = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"), F.col("event_type").alias("source"), F.array_position(kinds, F.col("event_type")).cast("int").alias("source_idx"), F.lit("title").alias("mode"),
        F.when(failed, "error").otherwise("ok").alias("outcome"), F.col("event_id").cast("string").alias("error"), no.alias("no_match"), (F.col("event_type") == "click").alias("misses"),
    )
    return counted(calls_).select(F.col("key").alias("user_id"), "completed", "authoritative_misses", F.map_contains_key("provider_errors", F.lit("error:title")).alias("failed"))


_STATUS_SQL = "CASE o_orderstatus WHEN 'F' THEN 'validated' WHEN 'O' THEN 'needs_review' ELSE 'unconfirmed' END"


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "validated").when(F.col("o_orderstatus") == "O", "needs_review").otherwise("unconfirmed")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), status.alias("status"))


@query(f"SELECT position, s.status, count(o_orderkey) AS n FROM (VALUES (0, 'validated'), (1, 'needs_review'), (2, 'unconfirmed'), (3, 'likely_hallucination')) s(position, status) LEFT JOIN orders ON {_STATUS_SQL} = s.status GROUP BY ALL")
def status_counts(spark, sf_dir):
    return reporting.status_counts(_statuses(spark, sf_dir))


@query(f"SELECT o_orderkey AS key, {_STATUS_SQL} AS status, row_number() OVER (ORDER BY o_orderkey)::INT AS index, count(*) OVER (PARTITION BY {_STATUS_SQL} ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS of_status FROM orders")
def status_running_count(spark, sf_dir):
    return reporting.running_counts(_statuses(spark, sf_dir))


@query(
    "WITH b AS (SELECT o_custkey AS batch_no, count(*) AS size, sum(o_orderkey % 97)::DOUBLE AS seconds FROM orders GROUP BY 1), s AS (SELECT *, coalesce(sum(seconds) OVER w, 0) AS t, coalesce(sum(size) OVER w, 0) AS n FROM b WINDOW w AS (ORDER BY batch_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT batch_no, (n + i)::BIGINT AS item, round(t + seconds * i / size, 6)::DOUBLE AS elapsed, round((t + seconds * i / size) / (n + i), 6)::DOUBLE AS average FROM (SELECT *, unnest(range(1, size + 1)) AS i FROM s)"
)
def batch_time_alloc(spark, sf_dir):
    batches = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("batch_no")).agg(F.count("*").alias("size"), F.sum(F.col("o_orderkey") % 97).cast("double").alias("seconds"))
    times = reporting.batch_times(batches)
    return times.select("batch_no", "item", F.round("elapsed", 6).alias("elapsed"), F.round("average", 6).alias("average"))


@query(
    f"""WITH r AS (SELECT o_orderkey::VARCHAR AS key, {_STATUS_SQL} AS status, o_orderpriority AS title FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY key) AS i FROM r),
g AS (SELECT * FROM (VALUES (1, 'likely_hallucination'), (2, 'needs_review'), (3, 'unconfirmed'), (4, 'validated')) v(part, status))
SELECT part, key AS at, '  ' || i || '. title: ' || title || chr(10) || '     authors: A; B' || chr(10) || '     reasons:' || chr(10) || '       - none' AS text FROM n JOIN g USING (status) WHERE status <> 'validated'
UNION ALL SELECT part, '', g.status || ' (' || count(key) || ')' || CASE WHEN count(key) = 0 AND g.status <> 'validated' THEN chr(10) || '  none' ELSE '' END FROM g LEFT JOIN r USING (status) GROUP BY part, g.status"""
)
def summary_groups(spark, sf_dir):
    status = _statuses(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("title")), "key")
    return reporting.final_summary(status.select(F.col("key").cast("string").alias("key"), "status", "title", F.array(F.lit("A"), F.lit("B")).alias("authors"), F.array().cast("array<string>").alias("reasons")))


@query(
    """SELECT 0 AS part, '' AS at, '{"bib":"x.bib","issue_count":' || (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') || ',"missing_citation_keys":[' AS text
UNION ALL SELECT 1, n_name, CASE WHEN n_name = (SELECT min(n_name) FROM nation) THEN '' ELSE ',' END || '"' || n_name || '"' FROM nation UNION ALL SELECT 2, '', '],"issues":['
UNION ALL SELECT 3, o_orderkey::VARCHAR, CASE WHEN o_orderkey::VARCHAR = min(o_orderkey::VARCHAR) OVER () THEN '' ELSE ',' END || '{"key":"' || o_orderkey || '","problems":["' || o_orderpriority || '"]}' FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 4, '', ']}'"""
)
def issues_document(spark, sf_dir):
    found = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").cast("string").alias("key"), F.array("o_orderpriority").alias("problems"))
    return reporting.issues_report(found, table(spark, sf_dir, "nation").select(F.col("n_name").alias("key")), "x.bib")


# Sources of one's own, requests


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of all parts with title, year, an arXiv identifier where the key divides by 3 and a repository where by 5."""
    k = F.col("p_partkey")
    text = lambda when, value: F.when(when, value).otherwise("")
    fields = F.create_map(
        F.lit("title"), F.concat_ws(" ", "p_type", k.cast("string")), F.lit("year"), (F.col("p_size") % 16 + 2010).cast("string"),
        F.lit("eprint"), text(k % 3 == 0, F.concat(F.lit("2001."), F.lpad((k % 100000).cast("string"), 5, "0"))),
        F.lit("howpublished"), text(k % 5 == 0, F.concat(F.lit("code at https://github.com/"), F.when(k % 2 == 0, "topics").otherwise("lee"), F.lit("/r"), (k % 40).cast("string"), F.lit(".git."))),
    )
    return table(spark, sf_dir, "part").select(k.cast("string").alias("key"), F.lit("article").alias("entry_type"), fields.alias("fields"))


@query(
    "SELECT key, mode, title FROM (SELECT p_partkey::VARCHAR AS key, CASE WHEN p_partkey % 4 = 0 THEN p_brand WHEN p_partkey % 4 = 1 THEN p_type || ' ' || p_partkey END AS title FROM part), (VALUES ('identifier'), ('title')) v(mode)"
)
def record_files(spark, sf_dir):
    """Each part's file: a list, records under a title's key, an object of records without any that fits, or no records at all."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    title = F.concat_ws(" ", "p_type", k.cast("string"))
    text = (
        F.when(k % 4 == 0, F.format_string('{"title:%s": {"title": "%s"}, "x": 1}', F.lower(title), "p_brand"))
        .when(k % 4 == 1, F.format_string('[{"title": "%s", "year": 2020, "authors": ["A B"]}, 7]', title))
        .when(k % 4 == 2, F.format_string('{"records": [{"title": "none like %s"}], "*": {"title": "%s"}}', title, title))
        .otherwise("null")
    )
    said = record_answers(_titled(spark, sf_dir), parsed(p.select(text.alias("text"))), "local", 0)
    return said.select("key", "mode", F.get("candidates", F.lit(0))["title"].alias("title"))


@query(
    "SELECT p_partkey::VARCHAR AS key, mode, CASE WHEN mode = 'applies' OR p_partkey % 4 = 2 THEN 'error' ELSE 'ok' END AS outcome, CASE WHEN mode <> 'applies' AND p_partkey % 4 <> 2 THEN p_type || ' ' || p_partkey END AS title FROM part, (VALUES ('identifier'), ('title'), ('applies')) v(mode) WHERE p_partkey % 4 <> 0 AND (mode = 'applies') = (p_partkey % 4 = 3)"
)
def function_source(spark, sf_dir):
    """A function that doesn't apply, fails, or cannot say whether it applies, each for a fourth of the parts."""

    def kind(entry):
        return int(entry["key"]) % 4

    def find(entry):
        if kind(entry) == 2:
            raise ValueError("no answer")
        return [{"title": entry["fields"]["title"]}]

    def applies(entry):
        if kind(entry) == 3:
            raise ValueError("no field")
        return kind(entry) != 0

    said = function_answers(_titled(spark, sf_dir), find, "mine", 0, applies)
    return said.select("key", "mode", "outcome", F.get("candidates", F.lit(0))["title"].alias("title"))


@query(
    """WITH e AS (SELECT p_partkey::VARCHAR AS key, '2001.' || lpad((p_partkey % 100000)::VARCHAR, 5, '0') AS a FROM part WHERE p_partkey % 3 = 0)
SELECT key, 0 AS step, 0 AS part, 'https://arxiv.org/abs/' || a AS url FROM e UNION ALL SELECT key, 0, 1, 'https://arxiv.org/abs/' || a || 'v1' FROM e
UNION ALL SELECT key, 1, 0, 'https://export.arxiv.org/api/query?id_list=' || a || '%2C' || a || 'v1&max_results=2' FROM e"""
)
def requests_arxiv(spark, sf_dir):
    return requests.arxiv_requests(entry_columns(_titled(spark, sf_dir))).filter("mode = 'identifier'").select("key", "step", "part", "url")


@query(
    """WITH v AS (SELECT * FROM (VALUES (2013, 28), (2014, 32), (2015, 37), (2016, 48)) x(year, volume))
SELECT p_partkey::VARCHAR AS key, step, v.year, 'https://proceedings.mlr.press/v' || volume || '/' AS url FROM part, (VALUES (0), (1)) s(step) JOIN v ON p_size % 16 + 2010 - step = v.year"""
)
def requests_icml(spark, sf_dir):
    volumes = {2013: 28, 2014: 32, 2015: 37, 2016: 48}
    return requests.icml_requests(entry_columns(_titled(spark, sf_dir)), volumes).select("key", "step", "year", "url")


@query(
    """SELECT DISTINCT CASE WHEN p_partkey % 10 = 5 THEN 'https://api.github.com/repos/lee/r' || p_partkey % 40 ELSE 'https://api.github.com/search/repositories?q=' || replace(p_type || ' ' || p_partkey, ' ', '+') || '&per_page=5' END AS url
FROM part WHERE NOT (p_partkey % 10 = 5 AND p_partkey % 40 < 10)"""
)
def requests_once(spark, sf_dir):
    """Repositories that many entries name are asked for once; those that are held, not at all."""
    asked = requests.github_requests(entry_columns(_titled(spark, sf_dir)))
    held = spark.range(10).select(F.concat(F.lit("https://api.github.com/repos/lee/r"), F.col("id").cast("string")).alias("url"), F.lit(requests.GITHUB_JSON).alias("accept"))
    return requests.distinct_requests(asked, held).select("url")


# The browser's variant


@query(
    """WITH p AS (SELECT p_partkey AS k, string_split(lower(p_type || ' ' || p_name), ' ') AS w FROM part),
n AS (SELECT a.k, a.w[3] = b.w[3] AS family, CASE WHEN a.k % 3 = 0 THEN '' WHEN a.k % 3 = 1 THEN a.w[1][1] ELSE a.w[1][1] || a.w[2][1] END AS i, b.w[1][1] || b.w[2][1] AS j FROM p a JOIN p b ON b.k = a.k + 1)
SELECT k, family AND starts_with(j, i) AS same FROM n"""
)
def browser_names(spark, sf_dir):
    """Type and name of a part as a person's name, with none, one or two given names, against the next part's whole one."""
    whole = F.concat_ws(" ", "p_type", "p_name")
    part = table(spark, sf_dir, "part").select("p_partkey", whole.alias("p_type"))
    k, w = F.col("p_partkey"), F.split("p_type", " ")
    short = F.when(k % 3 == 0, w[2]).when(k % 3 == 1, F.concat(w[2], F.lit(", "), F.substring(w[0], 1, 1), F.lit("."))).otherwise(F.col("p_type"))
    a, b = part.select(k.alias("k"), short.alias("a")), part.select((k - 1).alias("k"), F.col("p_type").alias("b"))
    return a.join(b, "k").select("k", browser.names_match(F.col("a"), F.col("b")).alias("same"))


@query("SELECT l_orderkey AS k, bool_or(l_discount >= 0.05 AND (l_tax >= 0.05 OR l_linenumber = 2)) AS decides, max(floor(l_discount * l_tax * 1000 + 0.5) / 1000) AS best FROM lineitem GROUP BY 1")
def browser_decides(spark, sf_dir):
    one = F.struct((F.when(F.col("l_discount") >= 0.05, 0.9).otherwise(0.5)).alias("title_score"), (F.col("l_linenumber") == 2).alias("identifier_match"), (F.col("l_tax") * 10).alias("author_score"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), one.alias("c"), browser.half_up3(F.col("l_discount") * F.col("l_tax")).alias("s"))
    return rows.groupBy("k").agg(F.collect_list("c").alias("c"), F.max("s").alias("best")).select("k", browser.decides(F.col("c")).alias("decides"), "best")


@query(
    """WITH e AS (SELECT p_partkey AS k, p_partkey % 3 = 0 AS doi, p_partkey % 4 = 0 AS arxiv, p_partkey % 5 = 0 AS url, p_partkey % 7 = 0 AS venue, p_partkey % 11 <> 0 AS title FROM part)
SELECT profile, k::VARCHAR AS key, source, mode, stage FROM e, (VALUES
('full', 'arxiv', 'identifier', 2, 'a'), ('full', 'datacite', 'identifier', 3, 'a'), ('full', 'crossref', 'identifier', 5, 'd'), ('full', 'openalex', 'identifier', 6, 'd'),
('full', 'url', 'title', 1, 'u'), ('full', 'neurips', 'title', 9, 'v'), ('full', 'crossref', 'title', 11, '-'), ('full', 'openalex', 'title', 11, '-'), ('full', 'dblp', 'title', 11, 'n'),
('browser', 'openalex', 'identifier', 8, 'd'), ('browser', 'crossref', 'identifier', 8, 'd'), ('browser', 'openalex', 'title', 11, 't'), ('browser', 'crossref', 'title', 11, 't')
) AS s(profile, source, mode, stage, needs)
WHERE CASE needs WHEN 'a' THEN arxiv WHEN 'd' THEN doi WHEN 'u' THEN url WHEN 'v' THEN venue WHEN 't' THEN title WHEN 'n' THEN NOT (doi OR arxiv OR url OR venue) ELSE true END"""
)
def planned_stages(spark, sf_dir):
    """Parts as entries that have, or lack, an identifier, an address, a venue or a title: the calls that each variant plans for them."""
    k = F.col("p_partkey")
    said = {"title": (k % 11 != 0, F.col("p_name")), "doi": (k % 3 == 0, F.concat(F.lit("10.1000/p"), k)), "eprint": (k % 4 == 0, F.lit("2301.00001")), "url": (k % 5 == 0, F.lit("https://example.com/x")), "booktitle": (k % 7 == 0, F.lit("NeurIPS"))}
    held = F.array_compact(F.array(*[F.when(has, F.struct(F.lit(name).alias("key"), value.alias("value"))) for name, (has, value) in said.items()]))
    entries = table(spark, sf_dir, "part").select(k.cast("string").alias("key"), F.lit("article").alias("entry_type"), F.map_from_entries(held).alias("fields"))
    plan = lambda name, profile: planned_calls(flagged(entries, profile), profile=profile).select(F.lit(name).alias("profile"), "key", "source", "mode", "stage")
    return plan("full", FULL).unionByName(plan("browser", BROWSER))


@query(
    """WITH p AS (SELECT p_partkey AS k, p_name AS a, p_type AS b, p_brand AS c FROM part)
SELECT k, array_to_string(CASE WHEN k % 3 = 0 THEN ['{' || a || ' and ' || b || '}', c] WHEN k % 3 = 1 THEN [a, b, c] ELSE ['\\{' || a, b || '\\}', c] END, '; ') AS names FROM p"""
)
def browser_authors(spark, sf_dir):
    """Name, type and brand of a part as a list of authors: the first two as one in braces, apart, or between escaped braces."""
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, F.format_string("{%s and %s} and %s", "p_name", "p_type", "p_brand")).when(k % 3 == 1, F.format_string("%s AND %s and  %s", "p_name", "p_type", "p_brand")).otherwise(F.format_string("\\{%s and %s\\} and %s and", "p_name", "p_type", "p_brand"))
    return table(spark, sf_dir, "part").select(k.alias("k"), F.array_join(browser.authors_property(text), "; ").alias("names"))


@query("SELECT o_orderkey::VARCHAR AS key, CASE WHEN o_orderstatus = 'F' THEN 'validated' WHEN o_orderstatus = 'P' THEN 'needs_review' WHEN o_totalprice > 150000 THEN 'likely_hallucination' ELSE 'unconfirmed' END AS status FROM orders")
def second_pass_orders(spark, sf_dir):
    """Orders as results, the open ones unconfirmed; a second pass has a result for those of a high price alone."""
    key, held = F.col("o_orderkey").cast("string").alias("key"), table(spark, sf_dir, "orders")
    first = held.select(key, F.when(F.col("o_orderstatus") == "F", "validated").when(F.col("o_orderstatus") == "P", "needs_review").otherwise("unconfirmed").alias("status"))
    again = second_pass(first, held.select(key, "o_totalprice")).filter(F.col("o_totalprice") > 150000)
    return replaced(first, again.select("key", F.lit("likely_hallucination").alias("status")))


# Running sums over many ranges


@query(
    """WITH r AS (SELECT lpad(l_orderkey::VARCHAR, 9, '0') || '-' || l_linenumber AS k, max(l_returnflag) AS flag, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1)
SELECT k, flag, q, row_number() OVER (ORDER BY k) AS place, CAST(sum(q) OVER (PARTITION BY flag ORDER BY k ROWS UNBOUNDED PRECEDING) AS BIGINT) AS of_flag FROM r"""
)
def running_sums_lineitem(spark, sf_dir):
    """Place of every order line, and what its return flag comes to so far, in the order of a computed key."""
    key = F.concat_ws("-", F.lpad(F.col("l_orderkey").cast("string"), 9, "0"), F.col("l_linenumber").cast("string"))
    rows = table(spark, sf_dir, "lineitem").groupBy(key.alias("k")).agg(F.max("l_returnflag").alias("flag"), F.sum("l_quantity").cast("long").alias("q"))
    placed = reporting.scanned(reporting.in_order(rows, "k"), {"place": F.lit(1).cast("long")})
    return reporting.scanned(placed, {"of_flag": F.col("q")}, "flag").select("k", "flag", "q", "place", "of_flag")


# Files


@query("SELECT p_partkey::VARCHAR AS key, 'article' AS entry_type, p_name AS title, p_brand || '-' || p_type AS venue, (1990 + p_size)::VARCHAR AS year FROM part")
def bib_parse(spark, sf_dir):
    """Each part written as a BibTeX file, and read back."""
    text = F.format_string('@string{v = "%s-"}\n%% a comment\n@Article{%s,\n title = {%s},\n journal = v # {%s}, year = %s,}\n', "p_brand", F.col("p_partkey").cast("string"), "p_name", "p_type", (F.col("p_size") + 1990).cast("string"))
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("file"), text.alias("text"))
    get = lambda n: F.try_element_at("fields", F.lit(n))
    return entries_of(files).select("key", "entry_type", get("title").alias("title"), get("journal").alias("venue"), get("year").alias("year"))


@query(
    """WITH p AS (SELECT 'f' || p_partkey % 7 AS file, p_partkey AS k, p_name, p_type, p_brand FROM part), l AS (SELECT file, max(k) AS m, arg_max(p_brand, k) AS b FROM p GROUP BY file)
SELECT file, (row_number() OVER (PARTITION BY file ORDER BY k) - 1)::INT AS pos, k::VARCHAR AS key, 'article' AS entry_type, p_name AS title, b || ' ' || p_type AS venue FROM p JOIN l USING (file) WHERE k < m"""
)
def bib_split(spark, sf_dir):
    """Seven files of all parts, cut before the end of every entry; a definition that the last part makes holds for all."""
    k = F.col("p_partkey").cast("string")
    said = ("}", F.format_string("@string{v = {%s}} %% a comment }", "p_brand"), F.format_string("@Article{%s,", k), F.format_string(" title = {%s},", "p_name"), F.format_string(" journal = v # { %s},", "p_type"))
    lines = F.posexplode(F.array(*[F.lit(x) if isinstance(x, str) else x for x in said])).alias("n", "line")
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("f"), (F.col("p_partkey") % 7).cast("string")).alias("file"), F.col("p_partkey").cast("long").alias("start"), lines)
    entries = split_entries(rows.repartition("file").sortWithinPartitions("file", "start", "n").select("file", "start", "line"))
    get = lambda n: F.try_element_at("fields", F.lit(n))
    return entries.select("file", "pos", "key", "entry_type", get("title").alias("title"), get("journal").alias("venue"))


@query("SELECT DISTINCT 'c' || o_custkey AS key FROM orders UNION SELECT DISTINCT 'p' || o_orderpriority[1:1] FROM orders")
def tex_cites(spark, sf_dir):
    text = F.format_string("Text \\cite[see][p. 1]{c%s} %%\\cite{no}\n\\begin{verbatim}\\cite{no}\\end{verbatim} \\verb|\\cite{no}| \\Textcites*{c%s, p%s}{} end", F.col("o_custkey").cast("string"), F.col("o_custkey").cast("string"), F.substring("o_orderpriority", 1, 1))
    return document_keys(table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("file"), text.alias("text")))


@query("WITH RECURSIVE r AS (SELECT n_regionkey::BIGINT AS node FROM nation WHERE n_nationkey = 0 UNION SELECT (n_nationkey * 3 % 25)::BIGINT FROM nation JOIN r ON n_nationkey = node) SELECT node FROM r")
def include_closure(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    edges = nation.select(F.col("n_nationkey").cast("long").alias("a"), (F.col("n_nationkey") * 3 % 25).cast("long").alias("b"))
    return closure(edges, nation.filter("n_nationkey = 0").select(F.col("n_regionkey").cast("long").alias("node")))


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT p_partkey AS a, p_partkey * 7 % 1999 AS b FROM part), r AS (SELECT n_nationkey::BIGINT AS root, n_nationkey::BIGINT * 20 AS node FROM nation UNION SELECT root, b::BIGINT FROM r JOIN e ON a = node)
SELECT root, count(*) AS nodes, min(node) AS least, max(node) AS most FROM r GROUP BY root"""
)
def include_reached(spark, sf_dir):
    """From one part of each nation along all parts' links: long chains, from 25 roots at once."""
    k = F.col("p_partkey").cast("long")
    edges = table(spark, sf_dir, "part").select(k.alias("a"), (k * 7 % 1999).alias("b"))
    own = F.col("n_nationkey").cast("long")
    roots = table(spark, sf_dir, "nation").select(own.alias("root"), (own * 20).alias("node"))
    found = reached(edges, roots).withColumnRenamed("root", "start").join(roots.select("root", F.col("node").alias("start")), "start")
    return found.groupBy("root").agg(F.count("*").alias("nodes"), F.min("node").alias("least"), F.max("node").alias("most"))


# The whole


def derived_entries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Entries of all works and records of them in three sources. A fifth has other authors, a fifth no record."""
    held = works(spark, sf_dir)
    k, title = F.col("k"), F.concat_ws(" ", "title", F.lit("of series"), F.col("k").cast("string"))
    fields = F.map_from_arrays(
        F.array(F.lit("title"), F.lit("author"), F.lit("year"), F.lit("doi")),
        F.array(title, F.array_join("a1", " and "), F.coalesce(F.col("y1").cast("string"), F.lit("")), F.when(k % 3 == 0, F.concat(F.lit("10.1000/p"), k.cast("string"))).otherwise("")),
    )
    entries = held.select(k.cast("string").alias("key"), F.lit("article").alias("entry_type"), fields.alias("fields"))
    blank = F.lit("")
    records = held.filter(k % 5 != 0).select(
        k.alias("record_id"),
        F.get(F.array(F.lit("openalex"), F.lit("crossref"), F.lit("datacite")), (k % 3).cast("int")).alias("source"),
        title.alias("title"),
        F.when(k % 5 == 1, F.col("a2")).otherwise(F.col("a1")).alias("authors"),
        F.col("y1").alias("year"),
        blank.alias("venue"),
        blank.alias("url"),
        F.concat(F.lit("10.1000/p"), k.cast("string")).alias("identifier"),
        F.concat(F.lit("10.1000/p"), k.cast("string")).alias("doi"),
        blank.alias("arxiv_id"),
        blank.alias("arxiv"),
        blank.alias("eprint"),
    )
    return entries, records


def checked(spark: SparkSession, sf_dir: str, with_ratio: bool = False) -> DataFrame:
    entries, records = derived_entries(spark, sf_dir)
    return check(entries, records, tuple(s for s in DEFAULT_SOURCES if s.name in ("openalex", "crossref", "datacite", "arxiv")), with_ratio)


@query()
def classify_entries(spark, sf_dir):
    return checked(spark, sf_dir, with_ratio=True).select("key", "status", "score", "branch", F.array_join("reasons", "; ").alias("reasons"), "completed", "no_match_sources")


