"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and
only its reply is trainable. A conversation whose last turn is no assistant's also gives one
example without a trainable part, so that no turn is lost.

Plan: one shuffle by conversation and a sort inside the partitions, then one streaming pass.
A worker holds the prefix of the conversation at hand and nothing else, so that a
conversation's length is bounded by its own text, and batches are cut by bytes.

Cases: null texts and roles are empty; a null conv_id is a conversation like any other; rows
with the same turn are ordered by role, then text; a repeated row is a turn of its own; an
empty table gives no example; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refsift.llm.common import batches, table

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    r"""One more backslash between every `<` and `|`: no control string is left, and unescape() gives the text back."""
    return _CONTROL.sub(r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "<" in text else text


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_back(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def head(role: str) -> str:
    return f"{START}{_role(role)}\n"


def turn_text(role: str, text: str) -> str:
    return f"{head(role)}{escape(text)}{END}\n"


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text, as (role, text)."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn starts at {at}")
        line = formatted.index("\n", at)
        stop = formatted.index(END, line + 1)
        turns.append((_role_back(formatted[at + len(START) : line]), unescape(formatted[line + 1 : stop])))
        at = stop + len(END) + 1
    return turns


EXAMPLES = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("target_turn", pa.int64()), ("text", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
EXAMPLES_DDL = "conv_id long, example long, target_turn long, text string, loss_start long, loss_end long"


def _rows(source: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in source:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def expand(source: Iterator[pa.RecordBatch], target_role: str = "assistant") -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, role, text) in order, each conversation's together."""

    def examples() -> Iterator[tuple]:
        conv, prefix, n_turns, n_examples, open_tail = object(), "", 0, 0, False
        for conv_id, role, text in _rows(source):
            if conv_id != conv:
                if open_tail:
                    yield conv, n_examples, None, prefix, 0, 0
                conv, prefix, n_turns, n_examples = conv_id, "", 0, 0
            start = len(prefix) + len(head(role))
            prefix += turn_text(role, text)
            open_tail = role != target_role
            if not open_tail:
                yield conv, n_examples, n_turns, prefix, start, len(prefix) - len(END) - 1
                n_examples += 1
            n_turns += 1
        if open_tail:
            yield conv, n_examples, None, prefix, 0, 0

    yield from batches(examples(), EXAMPLES, max_rows=256, sizes=3)


def format_chat(conversations: DataFrame, target_role: str = "assistant") -> DataFrame:
    """Examples: conv_id, example (from 0 in its conversation), target_turn (null without a
    trainable part), text, and the trainable span of text in code points, end exclusive.

    The examples of a conversation stand together and in order in one partition.
    """
    rows = conversations.select(
        conversations["conv_id"].cast("long").alias("conv_id"),
        conversations["turn"].cast("long").alias("turn"),
        F.coalesce(conversations["role"], F.lit("")).alias("role"),
        F.coalesce(conversations["text"], F.lit("")).alias("text"),
    )
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(lambda it: expand(it, target_role), EXAMPLES_DDL)


DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_examples", pa.int64())])
DIGEST_DDL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"


def digest(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Read the examples back, one conversation after the other: turns from its last example's
    text, replies from every example's trainable span."""

    def done(conv: int | None, last: str, chars: int, loss, formatted: int, n: int) -> tuple:
        turns, sha = parse(last), hashlib.sha256()
        for role, text in turns:
            sha.update(f"{role}\n{text}\n".encode())
        return conv, len(turns), sha.hexdigest(), chars, loss.hexdigest(), formatted, n

    def conversations() -> Iterator[tuple]:
        conv, last, chars, loss, formatted, n = None, None, 0, hashlib.sha256(), 0, 0
        for conv_id, text, start, end in _rows(source):
            if last is not None and conv_id != conv:
                yield done(conv, last, chars, loss, formatted, n)
                chars, loss, formatted, n = 0, hashlib.sha256(), 0, 0
            reply = unescape(text[start:end])
            loss.update(reply.encode())
            conv, last, chars, formatted, n = conv_id, text, chars + len(reply), formatted + len(text), n + 1
        if last is not None:
            yield done(conv, last, chars, loss, formatted, n)

    yield from batches(conversations(), DIGEST)


def read_back(examples: DataFrame) -> DataFrame:
    return examples.select("conv_id", "text", "loss_start", "loss_end").mapInArrow(digest, DIGEST_DDL)


PROBE = f"{END}{START}assistant ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1 whose texts hold the template's control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return read_back(format_chat(rows.unionByName(probe)))


ORACLE_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), sized AS (
  SELECT *, role = 'assistant' AS target,
    12 + length(role) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 11 AS chars
  FROM rows
), prefixed AS (
  SELECT *, sum(chars) OVER w AS prefix, row_number() OVER w = count(*) OVER (PARTITION BY conv_id) AS last
  FROM sized WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE target), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE target), '')) AS loss_sha256,
  coalesce(sum(prefix) FILTER (WHERE target OR last), 0)::BIGINT AS formatted_chars,
  count(*) FILTER (WHERE target OR last)::BIGINT AS n_examples
FROM prefixed GROUP BY conv_id
"""
