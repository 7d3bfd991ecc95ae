"""Normalised texts, identifiers, years and venues as Column expressions.

Everything here stays in the JVM but decode_latex and html_unescape, whose results are shown to
people and not compared.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterable
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Accent commands and letters that LaTeX writes as commands.
ACCENTS = {"'": "́", "`": "̀", "^": "̂", '"': "̈", "~": "̃", "=": "̄", ".": "̇", "u": "̆", "v": "̌", "H": "̋", "c": "̧", "k": "̨", "b": "̱", "d": "̣", "r": "̊"}
LETTERS = {r"\ss": "ß", r"\o": "ø", r"\O": "Ø", r"\l": "ł", r"\L": "Ł", r"\ae": "æ", r"\AE": "Æ", r"\oe": "œ", r"\OE": "Œ"}
# Fixed value: an accented letter as LaTeX writes it: a brace or none, a backslash, the accent, the letter in braces or without, a brace or none.
ACCENT_PATTERN = r"""\{?\\(['`^"~=.uvHckbdr])(?:\{([A-Za-z])\}|([A-Za-z]))\}?"""

#: Venues and the words that stand for them; the first that occurs decides.
VENUES = (
    ("tacl", "tacl|transactions of the association for computational linguistics"),
    ("jmlr", "jmlr|journal of machine learning research"),
    ("neurips", "neurips|nips|neural information processing systems"),
    ("iclr", "iclr|international conference on learning representations"),
    ("icml", "icml|international conference on machine learning"),
    ("cvpr", "cvpr|computer vision and pattern recognition"),
    ("iccv", "iccv|international conference on computer vision"),
    ("eccv", "eccv|european conference on computer vision"),
    ("emnlp", "emnlp|empirical methods in natural language processing"),
    ("acl", "acl|annual meeting of the association for computational linguistics"),
    ("colm", "colm|conference on language modeling"),
    ("arxiv", "arxiv|corr"),
)

# Fixed values, as their registrars publish them: a DOI (the pattern that Crossref recommends), and arXiv's identifiers since 2007 (year and
# month, a full stop, four or five digits) and before (archive, perhaps a subject class, seven digits), with a version or without.
DOI_PATTERN = r"(?i)10\.\d{4,9}/[-._;()/:A-Z0-9]+"
ARXIV_NEW = r"(?<!\d)(\d{4}\.\d{4,5})(?:v\d+)?"
ARXIV_ANY = r"(?i)(?<!\d)(\d{4}\.\d{4,5}|[a-z-]+(?:\.[a-z-]+)?/\d{7})(?:v\d+)?"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once however often body refers to it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


@cache
def _folds() -> tuple[str, str, str]:
    """What compatibility decomposition, case folding and dropping marks make of each character
    beyond ASCII: those that become one letter or digit, then those that vanish; and, as one
    text of `\x01character\x02letters`, those that become several."""
    one, gone, several = {}, [], []
    for code in range(128, 0x20000):
        char = chr(code)
        folded = "".join(c for c in unicodedata.normalize("NFKD", char).casefold() if not unicodedata.combining(c))
        kept = "".join(c if c.isascii() and c.isalnum() else " " for c in folded)
        if not folded:
            gone.append(char)
        elif len(kept) == 1 and kept != " ":
            one[char] = kept
        elif kept.strip():
            several.append(f"\x01{char}\x02{kept}")
    return "".join(one) + "".join(gone), "".join(one.values()), "".join(several)


def _ranges(chars: Iterable[str]) -> str:
    """Characters as the inside of a class of a pattern."""
    out: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if out and code == out[-1][1] + 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in out)


def _folded(text: Column) -> Column:
    """Case and accents away; characters without a Latin letter or digit in them stay, for a pattern to drop."""
    before, after, several = _folds()
    known, longer = F.lit(several), F.lit(rf"((?=[^\x00-\x7F])[{_ranges(x[0] for x in several.split(chr(1))[1:])}])")

    def spelled(char: Column) -> Column:
        mark = F.concat(F.lit("\x01"), char, F.lit("\x02"))
        return F.substring_index(F.call_function("substring_index", known, mark, F.lit(-1)), "\x01", 1)

    def beyond_ascii(t: Column) -> Column:
        # Few texts hold characters that become several; each of those is replaced in the whole text.
        held = F.array_distinct(F.regexp_extract_all(t, longer, 1))
        return F.lower(F.translate(F.aggregate(held, t, lambda acc, char: F.replace(acc, char, spelled(char))), before, after))

    return let(text, lambda t: F.when(t.rlike(r"^[\x00-\x7F]*$"), F.lower(t)).otherwise(beyond_ascii(t)))


def _words(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def _plain_letters(text: Column) -> Column:
    """LaTeX accents dropped and letter commands spelled; these fold to a space, but for the sharp s."""
    out = F.regexp_replace(text, ACCENT_PATTERN, "$2$3")
    for command, letter in LETTERS.items():
        out = F.replace(out, F.lit(command), F.lit(letter))
    return out


def normal_text(text: Column) -> Column:
    """For comparison: LaTeX resolved, commands and braces removed, case, accents and punctuation away."""
    # Few texts hold a backslash, and nothing else is a command.
    resolved = lambda t: F.when(F.contains(t, F.lit("\\")), F.regexp_replace(_plain_letters(t), r"(?U)\\[A-Za-z]+\s*", "")).otherwise(t)
    return _words(_folded(F.translate(let(F.coalesce(text, F.lit("")), resolved), "{}", "")))


def normal_text_and(text: Column) -> Column:
    """As normal_text, but `&` is a word, and commands and braces become spaces."""
    return _words(_folded(F.replace(_plain_letters(F.coalesce(text, F.lit(""))), F.lit("&"), F.lit(" and "))))


def title_key(text: Column) -> Column:
    """Lower case, anything but letters and digits as one space; accents stay what they are: no letters."""
    return _words(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("ß"), F.lit("ss"))))


def tokens(normal: Column) -> Column:
    """The words of a normalised text."""
    return F.filter(F.split(normal, " "), lambda w: w != "")


def token_set(normal: Column) -> Column:
    return F.array_distinct(tokens(normal))


def _decoded(text: str) -> str:
    if "\\" not in text:
        return text
    out = re.sub(ACCENT_PATTERN, lambda m: unicodedata.normalize("NFC", (m[2] or m[3]) + ACCENTS[m[1]]), text)
    for command, letter in LETTERS.items():
        out = out.replace(command, letter)
    return out


@F.pandas_udf(StringType())
def decode_latex(text: pd.Series) -> pd.Series:
    """Accent and letter commands as composed characters."""
    return text.fillna("").map(_decoded)


@F.pandas_udf(ArrayType(StringType()))
def decode_latex_each(texts: pd.Series) -> pd.Series:
    """decode_latex of each of a list; a null list has none."""
    return texts.map(lambda names: [] if names is None else [_decoded(n or "") for n in names])


@F.pandas_udf(StringType())
def html_unescape(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def strip_html(text: Column) -> Column:
    """Entities resolved, then tags dropped, then white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(html_unescape(text), r"(?s)<[^>]+>", ""), r"(?U)\s+", " "))


# Identifiers


def normal_doi(value: Column, trim_end: bool = True) -> Column:
    bare = F.lower(F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), r"(?i)^https?://(?:dx\.)?doi\.org/", ""))
    return F.regexp_replace(bare, r"[.,;)]+$", "") if trim_end else bare


def entry_doi_property(value: Column) -> Column:
    """A DOI field without `doi:` or resolver address and full stops at the end."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), r"(?iU)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", ""), r"\.+$", "")


def find_first(pattern: str, group: int, *values: Column) -> Column:
    """The first match over ordered values, else the empty string."""
    hits = [F.nullif(F.regexp_extract(F.coalesce(v, F.lit("")), pattern, group), F.lit("")) for v in values]
    return F.coalesce(*hits, F.lit(""))


def find_doi(*values: Column) -> Column:
    return F.regexp_replace(find_first(DOI_PATTERN, 0, *values), r"[.,;)]+$", "")


def source_doi(*values: Column) -> Column:
    """As find_doi, in lower case, as sources give it."""
    return F.lower(find_doi(*values))


def normal_arxiv(value: Column) -> Column:
    out = F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), r"(?i)^.*?arxiv(?:\.org/(?:abs|pdf)/|:)", "")
    return F.lower(F.regexp_replace(F.regexp_replace(out, r"(?i)\.pdf$", ""), r"(?i)v\d+$", ""))


def find_arxiv(*values: Column) -> Column:
    return find_first(ARXIV_NEW, 1, *values)


def find_arxiv_any(*values: Column) -> Column:
    """New-style and old-style identifiers."""
    return find_first(ARXIV_ANY, 1, *values)


def normal_arxiv_any(value: Column) -> Column:
    found = find_arxiv_any(value)
    return F.lower(F.when(found != "", found).otherwise(F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), r"(?i)v\d+$", "")))


def arxiv_version(value: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(value, F.lit("")), r"(?i)(?:\d{4}\.\d{4,5}|[a-z][a-z0-9.-]*/\d{7})v(\d+)", 1), F.lit("")).try_cast("int")


def find_url(value: Column) -> Column:
    return F.regexp_extract(F.coalesce(value, F.lit("")), r"(?iU)https?://[^\s{}<>]+", 0)


# Years


def year_in(value: Column) -> Column:
    """The first year from 1800 to 2199."""
    return F.nullif(F.regexp_extract(F.coalesce(value.cast("string"), F.lit("")), r"(?:18|19|20|21)\d{2}", 0), F.lit("")).try_cast("int")


def first_four_digits(value: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(value.cast("string"), F.lit("")), r"\d{4}", 0), F.lit("")).try_cast("int")


def year_property(value: Column) -> Column:
    """All digits together; the first four."""
    digits = F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"\D", "")
    return F.when(F.length(digits) >= 4, F.substring(digits, 1, 4)).try_cast("int")


def epoch_year(value: Column) -> Column:
    """The UTC year of seconds since 1970, or, beyond 1e10, of milliseconds."""
    seconds = F.when(value > 1e10, value / 1000.0).otherwise(value.cast("double"))
    return F.year(F.timestamp_seconds(seconds))


def year_similarity(a: Column, b: Column) -> Column:
    """1 for the same year, 0.7 for neighbours, else 0; null if one is missing."""
    gap = F.abs(a - b)
    return F.when(gap == 0, 1.0).when(gap == 1, 0.7).when(gap > 1, 0.0)


def years_compatible(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(a - b) <= 1, F.lit(True))


# Venues


def canonical_venue(normal: Column) -> Column:
    out = F.lit("")
    for name, words in reversed(VENUES):
        out = F.when(normal.rlike(rf"\b(?:{words})\b"), name).otherwise(out)
    return out


def venue_key(normal: Column) -> Column:
    """The venue's name where it has one, but for preprints, else its text."""
    return let(canonical_venue(normal), lambda name: F.when(name.isin("", "arxiv"), normal).otherwise(name))


def venues_equal(a: Column, b: Column) -> Column:
    def named(venue: Column) -> Column:
        return let(normal_text(venue), lambda n: F.struct(n.alias("text"), canonical_venue(n).alias("name")))

    def same(v: Column) -> Column:
        x, y = F.get(v, F.lit(0)), F.get(v, F.lit(1))
        return F.when((x["name"] != "") & (y["name"] != ""), x["name"] == y["name"]).otherwise(x["text"] == y["text"])

    return (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "") & let(F.array(named(a), named(b)), same)


def round3(value: Column) -> Column:
    """To three digits by the exact binary value, half to even, as Python rounds; for values under 1000."""
    return F.format_number(value, 3).cast("double")
