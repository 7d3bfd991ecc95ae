r"""Personal data by patterns, checksums and context, in SQL functions alone.

Regular expressions propose spans; octet ranges, Luhn's checksum, digit counts and the IBAN's
remainder modulo 97 confirm them; words near a span raise its score. Java's expressions give the
matches but not where they are, so each text is also split at the same pattern: the pieces'
and matches' lengths add up to the offsets.

Every pattern is linear: a run that fails from its start isn't tried again from its middle (a
match can only start there where the one before it ended, which \G allows), and possessive
quantifiers keep no way back.

Plan: a scan and a projection, without shuffle, aggregation or Python. The arrays of matches stay
in a projection of their own, as later ones refer to them more than once. Offsets are running sums, taken
in runs of about the square root of their number, so that many spans in one text don't cost their square.

Cases: null texts are empty; an empty text has no spans; null or repeated doc_ids are kept as rows
of their own; other columns are ignored. Spans of one kind never overlap; those of different kinds
may. Offsets are code points, end exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refsift.llm.common import table, text_rows

#: kind: (pattern, a text without this substring has no match, score, words that raise the score)
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8, "mail|contact|write|reply"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, "ip|host|server|address|client|login"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", "", 0.7, "card|credit|debit|visa|payment|account"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, "phone|tel|call|mobile|fax|whatsapp"),
    "iban": (r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)", "", 0.8, "iban|bank|account|transfer|konto"),
}
BASE_KINDS = ("email", "ip", "card", "phone")
CONTEXT_CHARS, CONTEXT_BONUS = 40, 0.2


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def step(acc: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).when(d >= 5, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def mod97(value: Column) -> Column:
    """The remainder of an IBAN without spaces: first four characters last, letters as 10 to 35."""
    turned = F.filter(F.split(F.concat(F.substr(value, F.lit(5)), F.substring(value, 1, 4)), ""), lambda c: c != "")
    return F.aggregate(turned, F.lit(0), lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + c.try_cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97))


def _valid(kind: str, s: Column) -> Column:
    value = s["value"]
    if kind == "ip":
        return value.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "iban":
        alone = ~F.right(s["before"], F.lit(1)).rlike("[A-Za-z0-9]") & ~F.left(s["after"], F.lit(1)).rlike("[A-Za-z0-9]")
        return F.when(alone, mod97(F.replace(value, F.lit(" "), F.lit(""))) == 1).otherwise(False)
    return F.lit(True)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _cuts(values: Column) -> tuple[Column, Callable[[Column], Column]]:
    """The numbers of runs of about as many values as there are runs, and the run of a number."""
    size = F.greatest(F.ceil(F.sqrt(F.size(values))), F.lit(1)).cast("int")
    numbers = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.floor((F.size(values) - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
    return numbers, lambda k: F.slice(values, k * size + 1, size)


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """op of 0 and the values up to each. A fold that appends copies its array at every step, so it only runs over runs of
    about the square root of their number, each from where those before it end."""
    zero, none = F.lit(0).cast("long"), F.array().cast("array<bigint>")

    def folded(part: Column, start: Column) -> Column:
        step = lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(op(acc["at"], x))).alias("out"))
        return F.aggregate(part, F.struct(start.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def whole(v: Column) -> Column:
        numbers, part = _cuts(v)
        ends = F.transform(numbers, lambda k: F.aggregate(part(k), zero, op))
        starts = _let(ends, lambda e: F.transform(numbers, lambda k: F.aggregate(F.slice(e, 1, k), zero, op)))
        return _let(starts, lambda at: F.flatten(F.transform(numbers, lambda k: folded(part(k), F.get(at, k)))))

    return _let(values, whole)


def _located(pieces: Column, matches: Column) -> Column:
    """Matches with their offsets and what stands around them."""
    lengths = F.zip_with(matches, F.slice(pieces, 1, F.size(matches)), lambda m, p: (F.length(m) + F.length(p)).cast("long"))

    def span(end: Column, value: Column, i: Column) -> Column:
        before, after = F.get(pieces, i), F.get(pieces, i + 1)
        return F.struct((end - F.length(value)).alias("start"), end.alias("end"), value.alias("value"), F.right(before, F.lit(CONTEXT_CHARS)).alias("before"), F.left(after, F.lit(CONTEXT_CHARS)).alias("after"))

    return _let(running(lengths, lambda a, b: a + b), lambda ends: F.transform(matches, lambda m, i: span(F.get(ends, i), m, i)))


def with_spans(docs: DataFrame) -> DataFrame:
    """docs and a column `pii_<kind>` of each kind: its confirmed spans in order, with start, end and score."""
    nothing = F.array().cast("array<string>")

    def when_there(kind: str, found: Column) -> Column:
        hint = PATTERNS[kind][1]
        return F.when(F.contains("text", F.lit(hint)), found).otherwise(nothing) if hint else found

    raw = docs.select(
        "*",
        *[when_there(k, F.regexp_extract_all("text", F.lit(p[0]), F.lit(0))).alias(f"m_{k}") for k, p in PATTERNS.items()],
    )
    split = raw.select("*", *[F.when(F.size(f"m_{k}") > 0, F.split("text", p[0], -1)).otherwise(nothing).alias(f"p_{k}") for k, p in PATTERNS.items()])

    def confirmed(kind: str) -> Column:
        _, _, score, words = PATTERNS[kind]
        spans = F.filter(_located(F.col(f"p_{kind}"), F.col(f"m_{kind}")), lambda s: _valid(kind, s))
        near = lambda s: F.lower(F.concat_ws(" ", s["before"], s["after"])).rlike(f"\\b({words})")
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), (F.lit(score) + F.when(near(s), CONTEXT_BONUS).otherwise(0.0)).alias("score")))

    found = split.select("*", *[confirmed(k).alias(f"pii_{k}") for k in PATTERNS])
    return found.drop(*[f"{x}_{k}" for x in "mp" for k in PATTERNS])


def _tagged(kinds: tuple[str, ...]) -> Column:
    """Spans of these kinds, one kind after the other."""
    of = lambda k: F.transform(f"pii_{k}", lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")))
    return F.concat(*[of(k) for k in kinds])


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end, score) of every row, by kind as PATTERNS lists them, then start."""
    return with_spans(text_rows(docs)).select("doc_id", _tagged(tuple(PATTERNS)).alias("spans"))


def redact(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """docs with each span of that score or more, and what overlaps it, replaced in text by `<KIND>`.

    Overlapping spans become one, named after the one that starts first (of those, the longest).
    Other columns stay as they are, but n_chars follows the text where it exists.
    """
    own = [c for c in docs.columns]
    held = docs.select(F.struct("*").alias("row"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    spans = F.array_sort(
        F.transform(F.filter(_tagged(tuple(PATTERNS)), lambda s: s["score"] >= min_score), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus_end"), s["kind"].alias("kind")))
    )
    found = with_spans(held).select("row", "text", spans.alias("spans"))
    reach = running(F.transform("spans", lambda s: (-s["minus_end"]).cast("long")), lambda a, b: F.greatest(a, b))
    reached = found.select("*", reach.alias("reach"))
    # The first span of each group that overlaps, and where the group before it ends.
    each = F.transform("spans", lambda s, i: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), F.when(i > 0, F.get("reach", i - 1)).otherwise(0).cast("long").alias("after")))
    grouped = reached.select("*", F.filter(each, lambda s: s["start"] >= s["after"]).alias("first"))
    numbers, part = _cuts(F.col("first"))
    text = F.col("text")
    between = lambda whole, lo, hi: F.substr(whole, (lo + 1).cast("int"), (hi - lo).cast("int"))

    def replaced(run: Column) -> Column:
        # A run's own stretch of the text is cut out first: Spark finds a place by walking from the start.
        base = F.get(run, F.lit(0))["after"]
        own = between(text, base, F.element_at(run, -1)["start"])
        return _let(own, lambda o: F.array_join(F.transform(run, lambda s: F.concat(between(o, s["after"] - base, s["start"] - base), F.lit("<"), F.upper(s["kind"]), F.lit(">"))), ""))

    clean = F.concat(F.array_join(F.transform(numbers, lambda k: _let(part(k), replaced)), ""), F.substr(text, (F.element_at("reach", -1) + 1).cast("int")))
    done = grouped.select("row", F.when(F.size("spans") > 0, clean).otherwise(text).alias("text"))
    put = {"text": F.col("text"), "n_chars": F.length("text").cast(dict(docs.dtypes).get("n_chars", "bigint"))}
    return done.select(*[put.get(c, F.col("row")[c]).alias(c) for c in own])


def spans_text(spans: Column) -> Column:
    """`kind:start:end`, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_spans(text_rows(table(spark, sf_dir, "documents")))
    return found.select(
        "doc_id",
        *[F.size(f"pii_{k}").cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(spans_text(_tagged(BASE_KINDS)), 256).alias("base_sha256"),
        spans_text(_tagged(tuple(PATTERNS))).alias("spans"),
        F.round(F.aggregate(_tagged(tuple(PATTERNS)), F.lit(0.0), lambda acc, s: acc + s["score"]), 3).alias("total_score"),
    )


#: The same patterns without lookbehind and possessive quantifiers, for a linear-time engine.
_ORACLE_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)",
}
_ORACLE_RAW = " UNION ALL ".join(
    f"SELECT doc_id, row_no, '{k}' AS kind, {i} AS k, {PATTERNS[k][2]}::DOUBLE AS base, '\\b({PATTERNS[k][3]})' AS words, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS p FROM d"
    for i, (k, p) in enumerate(_ORACLE_PATTERNS.items())
)
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row_no, coalesce(text, '') AS text FROM documents),
raw AS ({_ORACLE_RAW}),
each AS (
  SELECT doc_id, row_no, kind, k, base, words, i, m[i] AS value, p[i] AS before, p[i + 1] AS after
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM raw)
), located AS (
  SELECT *, sum(length(before) + length(value)) OVER (PARTITION BY row_no, k ORDER BY i) AS stop, regexp_replace(value, '[^0-9]', '', 'g') AS digits, replace(value, ' ', '') AS bare FROM each
), valid AS (
  SELECT *, (stop - length(value))::BIGINT AS start, base + CASE WHEN regexp_matches(lower(right(before, {CONTEXT_CHARS}) || ' ' || left(after, {CONTEXT_CHARS})), words) THEN {CONTEXT_BONUS} ELSE 0 END AS score
  FROM located
  WHERE CASE kind
    WHEN 'ip' THEN regexp_full_match(value, '0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){{3}}')
    WHEN 'card' THEN CASE WHEN length(digits) BETWEEN 13 AND 19 THEN
      list_sum([CASE WHEN (length(digits) - j) % 2 = 0 THEN digits[j]::INT WHEN digits[j]::INT >= 5 THEN 2 * digits[j]::INT - 9 ELSE 2 * digits[j]::INT END FOR j IN range(1, length(digits) + 1)]) % 10 = 0 ELSE false END
    WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
    WHEN 'iban' THEN NOT regexp_matches(right(before, 1), '[A-Za-z0-9]') AND NOT regexp_matches(left(after, 1), '[A-Za-z0-9]')
      AND array_to_string([CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE (ascii(c) - 55)::VARCHAR END FOR c IN string_split(bare[5:] || bare[:4], '')], '')::HUGEINT % 97 = 1
    ELSE true END
)
SELECT any_value(d.doc_id) AS doc_id,
  count(*) FILTER (WHERE kind = 'email')::BIGINT AS n_email, count(*) FILTER (WHERE kind = 'ip')::BIGINT AS n_ip,
  count(*) FILTER (WHERE kind = 'card')::BIGINT AS n_card, count(*) FILTER (WHERE kind = 'phone')::BIGINT AS n_phone,
  sha256(coalesce(string_agg(kind || ':' || start || ':' || stop::BIGINT, ',' ORDER BY k, start) FILTER (WHERE k < 4), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || start || ':' || stop::BIGINT, ',' ORDER BY k, start), '') AS spans,
  round(coalesce(sum(score), 0), 3) AS total_score
FROM d LEFT JOIN valid USING (row_no) GROUP BY row_no
"""
