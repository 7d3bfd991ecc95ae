"""URL filter by rules and a character language-model ratio, in SQL functions alone.

Rules on host and path decide first. The URLs they allow or block also train two smoothed
variable-order Markov models of characters; every other URL is judged by the difference of its
log-likelihoods, divided by its length, against a threshold calibrated on rule-judged URLs that
the models have not seen.

A model interpolates orders 0 to MAX_ORDER after Witten and Bell: with c the count of a context and
T its number of different followers, P(x | ctx) = (c(ctx x) + T P(x | shorter)) / (c + T), down to a
uniform alphabet. A context seen less than MIN_COUNT times is not kept, which makes the order
variable. For a kept n-gram, ln P - ln P(shorter) is stored; for a kept context, ln(T / (c + T)), what an
unseen follower gains. A URL's log-likelihood is then a plain sum over its n-grams of one stored
number each, so it needs one lookup join and one aggregation that combines before its shuffle.

Characters are folded to an alphabet of at most ALPHABET, so a model has no more than
sum ALPHABET^(k+1) rows at any input size. Its table is counted, broadcast up to BROADCAST_ROWS rows,
and joined by shuffle beyond.

Cases: a null URL, or one without `://`, has an empty host and path and is judged by the models as
the empty string; null and repeated page_ids are rows of their own; an empty table gives no rows;
other columns are ignored. If the rules allow none or block none, the threshold is 0 and ties are
allowed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refsift.llm.common import stored, table

MAX_ORDER, MIN_COUNT, ALPHABET, BROADCAST_ROWS = 3, 3, 40, 400_000
#: Of five folds of the rule-judged URLs, the one that calibrates the threshold.
FOLDS, HELD_FOLD = 5, 0


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(url: Column) -> tuple[Column, Column]:
    """Host, with A to Z in lower case, and path."""
    whole = F.coalesce(url, F.lit(""))
    part = lambda i: F.regexp_extract(whole, r"://([^/?#]*)([^?#]*)", i)
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def by_rule(host: Column, path: Column, rules: tuple[Rule, ...], what) -> Column:
    """what(rule) of the longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, what(r)).otherwise(out)
    return out


def folded(host: Column, path: Column) -> Column:
    """What the models read: lower case, digits as 0, anything rare as ?."""
    small = F.translate(F.concat(host, path), _UPPER + "123456789", _LOWER + "000000000")
    return F.regexp_replace(small, r"[^a-z0./_%~:@=+&-]", "?")


def ngrams(text: Column) -> Column:
    """All n-grams of orders 0 to MAX_ORDER of a text with start and end marks, one for each place and order."""
    marked = F.concat(F.lit("^" * MAX_ORDER), text, F.lit("$"))
    places = F.sequence(F.lit(MAX_ORDER + 1), F.length(text) + MAX_ORDER + 1)
    return F.flatten(F.transform(places, lambda i: F.transform(F.sequence(F.lit(0), F.lit(MAX_ORDER)), lambda k: F.substring(marked, i - k, k + 1))))


def train(samples: DataFrame) -> DataFrame:
    """samples: label, folded. Gives label, key and gain; key is an n-gram, or a context and `*`."""
    grams = samples.select("label", F.explode(ngrams(F.col("folded"))).alias("gram")).groupBy("label", "gram").agg(F.count("*").alias("n"))
    shorter = lambda c: F.expr(f"substring({c}, 1, length({c}) - 1)")
    contexts = grams.groupBy("label", shorter("gram").alias("ctx"), F.length("gram").alias("len")).agg(F.sum("n").alias("c"), F.count("*").alias("t"))
    kept = contexts.filter((F.col("c") >= MIN_COUNT) | (F.col("len") == 1)).select("label", "ctx", "c", "t")
    seen = grams.withColumn("ctx", shorter("gram")).join(kept, ["label", "ctx"])
    level = seen.filter(F.length("gram") == 1).select("label", "gram", ((F.col("n") + F.col("t") / F.lit(float(ALPHABET))) / (F.col("c") + F.col("t"))).alias("p"))
    gains = level.select("label", F.col("gram").alias("key"), F.log("p").alias("gain"))
    for k in range(1, MAX_ORDER + 1):
        lower = level.select("label", F.col("gram").alias("tail"), F.col("p").alias("q"))
        higher = seen.filter(F.length("gram") == k + 1).withColumn("tail", F.expr("substring(gram, 2)"))
        both = higher.join(lower, ["label", "tail"]).select("label", "gram", "q", ((F.col("n") + F.col("t") * F.col("q")) / (F.col("c") + F.col("t"))).alias("p"))
        gains = gains.unionByName(both.select("label", F.col("gram").alias("key"), (F.log("p") - F.log("q")).alias("gain")))
        level = both.select("label", "gram", "p")
    missed = kept.select("label", F.concat("ctx", F.lit("*")).alias("key"), F.log(F.col("t") / (F.col("c") + F.col("t")) / F.when(F.col("ctx") == "", F.lit(float(ALPHABET))).otherwise(1.0)).alias("gain"))
    return gains.unionByName(missed)


def ratios(model: DataFrame) -> DataFrame:
    """For each key what it adds to ln P(allow) - ln P(block), a side without it as null."""
    side = lambda v: F.max(F.when(F.col("label") == v, F.col("gain")))
    return model.groupBy("key").agg(side("allow").alias("allow"), side("block").alias("block"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score (above the threshold: allowed by the method) of every row."""
    host, path = parsed(pages["url"].cast("string"))
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.select(
        "*",
        by_rule(F.col("host"), F.col("path"), rules, lambda r: F.lit(r.host + r.path)).alias("rule"),
        by_rule(F.col("host"), F.col("path"), rules, lambda r: F.lit(r.verdict)).alias("label"),
        folded(F.col("host"), F.col("path")).alias("folded"),
    )
    fold = F.conv(F.substring(F.md5(F.concat("host", "path").cast("binary")), 1, 4), 16, 10).cast("int") % FOLDS
    model = stored(ratios(train(rows.filter(F.col("label").isNotNull() & (fold != HELD_FOLD)).select("label", "folded"))))
    small = model.count() <= BROADCAST_ROWS
    side = F.broadcast if small else lambda df: df
    held = ["row_no", "page_id", "host", "path", "rule", "label", "held", "n"]
    numbered = rows.select(F.monotonically_increasing_id().alias("row_no"), "*", (fold == HELD_FOLD).alias("held"), (F.length("folded") + 1).alias("n"))
    each = numbered.select(*held, F.explode(ngrams(F.col("folded"))).alias("key"))
    each = each.withColumn("missed", F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("*")))
    whole = each.join(side(model), "key", "left")
    whole = whole.join(side(model.select(F.col("key").alias("missed"), F.col("allow").alias("allow_m"), F.col("block").alias("block_m"))), "missed", "left")
    gain = lambda v: F.coalesce(v, f"{v}_m", F.lit(0.0))
    scored = stored(whole.groupBy(*held).agg((F.sum(gain("allow") - gain("block")) / F.col("n")).alias("score")))
    cut = threshold(scored.filter(F.col("held")))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("label", F.when(F.col("score") >= cut, "allow").otherwise("block")).alias("verdict"), "score")


def threshold(labelled: DataFrame) -> float:
    """Where both classes' scores lie as many standard deviations from their means."""
    of = {r["label"]: r for r in labelled.filter("label IS NOT NULL").groupBy("label").agg(F.avg("score").alias("mean"), F.coalesce(F.stddev_pop("score"), F.lit(0.0)).alias("dev")).collect()}
    if len(of) < 2:
        return 0.0
    a, b = of["allow"], of["block"]
    spread = a["dev"] + b["dev"]
    return (a["mean"] * b["dev"] + b["mean"] * a["dev"]) / spread if spread else (a["mean"] + b["mean"]) / 2


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


def _oracle() -> str:
    ordered = sorted(RULES, key=lambda r: -len(r.host + r.path))
    case = lambda what: "CASE " + " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{what(r)}'" for r in ordered) + " END"
    levels = ", ".join(
        f"""l{k} AS (SELECT s.label, s.gram, l.p AS q, (s.n + s.t * l.p) / (s.c + s.t) AS p FROM seen s
          JOIN l{k - 1} l ON l.label = s.label AND l.gram = substr(s.gram, 2) WHERE length(s.gram) = {k + 1})"""
        for k in range(1, MAX_ORDER + 1)
    )
    gains = " UNION ALL ".join(f"SELECT label, gram AS key, ln(p) - ln(q) AS gain FROM l{k}" for k in range(1, MAX_ORDER + 1))
    return rf"""
WITH split AS (
  SELECT row_number() OVER () AS row_no, page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages
), ruled AS (
  SELECT *, {case(lambda r: r.host + r.path)} AS rule, {case(lambda r: r.verdict)} AS label,
    regexp_replace(translate(host || path, '{_UPPER}123456789', '{_LOWER}000000000'), '[^a-z0./_%~:@=+&-]', '?', 'g') AS folded,
    ('0x' || substr(md5(host || path), 1, 4))::INT % {FOLDS} = {HELD_FOLD} AS held
  FROM split
), places AS (
  SELECT row_no, label, held, length(folded) + 1 AS n, '{"^" * MAX_ORDER}' || folded || '$' AS marked, unnest(range({MAX_ORDER + 1}, length(folded) + {MAX_ORDER + 2})) AS i FROM ruled
), keyed AS (
  SELECT row_no, label, held, n, substr(marked, i - k, k + 1) AS gram, k FROM places, range(0, {MAX_ORDER + 1}) r(k)
), grams AS (
  SELECT label, gram, count(*) AS n FROM keyed WHERE label IS NOT NULL AND NOT held GROUP BY ALL
), contexts AS (
  SELECT label, substr(gram, 1, length(gram) - 1) AS ctx, sum(n)::DOUBLE AS c, count(*) AS t FROM grams GROUP BY label, ctx, length(gram) HAVING c >= {MIN_COUNT} OR ctx = ''
), seen AS (
  SELECT g.label, g.gram, g.n, x.c, x.t FROM grams g JOIN contexts x ON g.label = x.label AND x.ctx = substr(g.gram, 1, length(g.gram) - 1)
), l0 AS (
  SELECT label, gram, (n + t / {ALPHABET}.0::DOUBLE) / (c + t) AS p FROM seen WHERE length(gram) = 1
), {levels}, gains AS (
  SELECT label, gram AS key, ln(p) AS gain FROM l0 UNION ALL {gains}
  UNION ALL SELECT label, ctx || '*', ln(t / (c + t) / CASE WHEN ctx = '' THEN {ALPHABET} ELSE 1 END) FROM contexts
), model AS (
  SELECT key, max(gain) FILTER (WHERE label = 'allow') AS allow, max(gain) FILTER (WHERE label = 'block') AS block FROM gains GROUP BY key
), scores AS (
  SELECT row_no, any_value(label) AS label, bool_or(held) AS held, sum(coalesce(a.allow, b.allow, 0) - coalesce(a.block, b.block, 0)) / any_value(n) AS score
  FROM keyed x LEFT JOIN model a ON a.key = x.gram LEFT JOIN model b ON b.key = substr(x.gram, 1, length(x.gram) - 1) || '*' GROUP BY row_no
), classes AS (
  SELECT label, avg(score) AS mean, stddev_pop(score) AS dev FROM scores WHERE held AND label IS NOT NULL GROUP BY label
), cut AS (
  SELECT coalesce(max(CASE WHEN a.dev + b.dev > 0 THEN (a.mean * b.dev + b.mean * a.dev) / (a.dev + b.dev) ELSE (a.mean + b.mean) / 2 END), 0) AS cut_at
  FROM classes a, classes b WHERE a.label = 'allow' AND b.label = 'block'
)
SELECT page_id, host, path, rule, coalesce(r.label, CASE WHEN score >= cut_at THEN 'allow' ELSE 'block' END) AS verdict, round(score, 6) AS score
FROM ruled r JOIN scores s USING (row_no), cut
"""


ORACLE_SQL = _oracle()
