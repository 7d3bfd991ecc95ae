"""BibTeX files as rows of entries.

Nested braces are no regular language, so one Arrow function takes a whole file's text and gives its
entries; everything after is relational. A text is cut into the few characters that mean something, and
what lies between them is never looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refsift.operators.entries import last_of_each_key, normal_fields

ENTRY = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("key", T.StringType()), T.StructField("entry_type", T.StringType()), T.StructField("fields", T.MapType(T.StringType(), T.StringType()))])
NOT_ENTRIES = ("comment", "preamble", "string")
_MARKS = re.compile(r'\\.|["{}(),=#]', re.DOTALL)
_COMMENT = re.compile(r"(\\.)|%[^\n]*", re.DOTALL)
HEAD = re.compile(r"@\s*([\w-]+)\s*([{(])")


def without_comments(text: str) -> str:
    """Without what follows a percent sign in its line, unless a backslash escapes the sign."""
    return _COMMENT.sub(r"\1", text) if "%" in text else text


def _unquoted(text: str, at: int) -> Iterator[tuple[int, str]]:
    """Places and characters of the marks outside quotes, from a place on; escaped ones don't count."""
    quoted = False
    for m in _MARKS.finditer(text, at):
        if m[0] == '"':
            quoted = not quoted
        elif not quoted and m[0][0] != "\\":
            yield m.start(), m[0]


def block_end(text: str, at: int, opener: str, quoted: int = 0, depth: int = 1, braces: int = 0) -> tuple[int | None, list]:
    """Where the block ends whose content goes on there, or None; and the state it is left in: opener, quoted, depth and, after a
    parenthesis, braces. Parentheses inside braces don't count."""
    for m in _MARKS.finditer(text, at):
        mark = m[0]
        if mark == '"':
            quoted = 1 - quoted
        elif quoted or mark[0] == "\\":
            continue
        elif opener == "{":
            depth += (mark == "{") - (mark == "}")
        elif mark == "{":
            braces += 1
        elif mark == "}":
            braces = max(0, braces - 1)
        elif not braces:
            depth += (mark == "(") - (mark == ")")
        if not depth:
            return m.start(), [opener, quoted, depth]
    return None, ["{", quoted, depth] if opener == "{" else ["(", quoted, depth, braces]


def blocks(text: str) -> Iterator[tuple[str, str]]:
    """Type, in lower case, and content of each block; one without an end is the last thing seen."""
    at = 0
    while m := HEAD.search(text, at):
        end, _ = block_end(text, m.end(), m[2])
        if end is None:
            return
        yield m[1].lower(), text[m.end() : end]
        at = end + 1


def split_outside(text: str, separator: str, most: int | None = None) -> list[str]:
    """Parts between separators that stand outside braces and quotes."""
    cuts, depth = [], 0
    for place, mark in _unquoted(text, 0):
        if mark == "{":
            depth += 1
        elif mark == "}":
            depth = max(0, depth - 1)
        elif mark == separator and not depth and (most is None or len(cuts) < most):
            cuts.append(place)
    return [text[a:b] for a, b in zip([0, *[c + 1 for c in cuts]], [*cuts, len(text)], strict=True)]


def _wrapped(value: str) -> bool:
    """Whether one pair of braces or quotes encloses the whole value."""
    if len(value) < 2:
        return False
    if value[0] == value[-1] == '"':
        return (len(value) - len(value[:-1].rstrip("\\"))) % 2 == 1
    if value[0] != "{" or value[-1] != "}":
        return False
    depth = 0
    for m in re.finditer("[{}]", value):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.start() == len(value) - 1
    return False


class Macros:
    """String definitions; one may use others, and one that uses itself stands for its name."""

    def __init__(self) -> None:
        self.defined: dict[str, str] = {}
        self.open: set[str] = set()

    def __call__(self, name: str) -> str | None:
        key = name.lower()
        if key not in self.defined:
            return None
        if key in self.open:
            return name
        self.open.add(key)
        try:
            return self.value(self.defined[key])
        finally:
            self.open.discard(key)

    def value(self, expression: str) -> str:
        """Pieces joined by number signs: in braces, in quotes, or a macro's or a bare word."""
        parts = [p for p in (x.strip() for x in split_outside(expression.strip(), "#")) if p]
        return " ".join("".join(p[1:-1] if _wrapped(p) else self(p) or p for p in parts).split())


def assignments(content: str) -> Iterator[tuple[str, str]]:
    for part in split_outside(content, ","):
        name, *rest = split_outside(part, "=", 1)
        if rest and name.strip():
            yield name.strip(), rest[0].strip()


def entry_of(kind: str, content: str, macros: Macros) -> dict | None:
    """A block's entry; None without a key."""
    key, *rest = split_outside(content, ",", 1)
    if not key.strip():
        return None
    fields = {name.lower(): macros.value(value) for name, value in assignments(rest[0] if rest else "")}
    return {"key": key.strip(), "entry_type": kind, "fields": fields}


def parse(text: str) -> list[dict]:
    """Entries of a file in order, repeated keys included, entries without a key not."""
    found = list(blocks(without_comments(text.removeprefix("\ufeff"))))
    macros = Macros()
    for kind, content in found:
        if kind == "string":
            macros.defined.update((name.lower(), value) for name, value in assignments(content))
    entries = (entry_of(kind, content, macros) for kind, content in found if kind not in NOT_ENTRIES)
    return [{"pos": pos} | e for pos, e in enumerate(e for e in entries if e)]


@F.pandas_udf(T.ArrayType(ENTRY))
def parsed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: parse(t or ""))


def entries_of(texts: DataFrame) -> DataFrame:
    """texts: file and text. A row for each key of each file: file, pos, key, entry_type, fields."""
    # Few bytes of texts may come from one small file of a table, but parsing takes long.
    dealt = texts.repartition(4 * texts.sparkSession.sparkContext.defaultParallelism)
    each = dealt.select("file", F.inline(parsed("text")))
    return kept_entries(each)


def kept_entries(each: DataFrame) -> DataFrame:
    """each: file, pos, key, entry_type and fields. The last entry of each key of each file."""
    whole = each.select("file", "pos", "key", "entry_type", "fields")
    kept = last_of_each_key(whole, by=("file", "key"))
    return kept.select("file", "pos", "key", F.lower(F.trim("entry_type")).alias("entry_type"), normal_fields().alias("fields"))


def read_bib(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Entries of .bib files, or of all in a folder. A large file is read by many tasks."""
    from refsift.sources.bibsplit import read_lines, split_entries

    return split_entries(read_lines(spark, path))
