"""BibTeX files of any size: cut in pieces, parsed by many tasks, with the entries that one task reading the whole file would give.

Where a piece begins, the parser may be outside entries, in the middle of an entry's head, or inside one, at some depth and in quotes or not. So
a piece is first summarised as a function from the state before it to that after it. From outside that is one run. Inside braces it follows
from the piece's least depths: at depth d an entry ends where the piece has closed d braces more than it has opened, and from there on the
piece is read from outside, which any two runs do alike from the first head that both meet. The functions of a file are applied one after another,
a few numbers a piece; states that a summary doesn't cover (parentheses, escapes) are run on that piece alone. Then every piece
knows its state, and is parsed: what is whole in it by itself, what crosses a cut as fragments that are put together again.

String definitions are collected from the whole file before values are read, and go to the tasks if they are counted small, else by a join.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refsift.shared import stored
from refsift.sources.bibtex import HEAD, NOT_ENTRIES, Macros, assignments, block_end, blocks, entry_of, kept_entries

#: Bytes of a piece, about, and of string definitions that go to the tasks as they are.
PIECE_BYTES, MACRO_BYTES = 4 << 20, 32 << 20

_ASSIGNED = T.ArrayType(T.StructType([T.StructField("n", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))

# The state before a piece: [lead, mode, ...]. lead is "" or what the piece before ended in: a backslash, or "%" for a comment. Modes:
# ["out", k]: outside; k is 1 after an at sign, 2 in the name after it, 3 in the space after that, else 0.
# ["{", quoted, depth], ["(", quoted, depth, braces]: inside.
START = ["", "out", 0]
_BEGUN = re.compile(r"@(?:(\s*)|(\s*[\w-]+)|(\s*[\w-]+\s+))\Z")
_GOES_ON = {1: r"\s*[\w-]+\s*", 2: r"[\w-]*\s*", 3: r"\s*"}
_STILL = {1: ((1, r"\s*\Z"), (2, r"\s*[\w-]+\Z"), (3, r"\s*[\w-]+\s+\Z")), 2: ((2, r"[\w-]*\Z"), (3, r"[\w-]*\s+\Z")), 3: ((3, r"\s*\Z"),)}


def uncommented(raw: str, lead: str) -> tuple[str, str, str]:
    """A piece without comments, the same with spaces for escaped characters, and the lead of the next piece."""
    if lead == "%":
        end = raw.find("\n")
        if end < 0:
            return "", "", "%"
        raw, lead = raw[end:], ""
    kept, masked, at = [], [], 0
    if lead and raw:
        kept, masked, at = [raw[0]], [" "], 1
    elif lead:
        return "", "", lead
    lead = ""
    for m in re.compile(r"\\.|\\\Z|%[^\n]*", re.DOTALL).finditer(raw, at):
        between = raw[at : m.start()]
        kept.append(between)
        masked.append(between)
        at = m.end()
        if m[0][0] == "%":
            lead = "%" if at == len(raw) else ""
        else:
            kept.append(m[0])
            masked.append(" " * len(m[0]))
            lead = "\\" if len(m[0]) == 1 else ""
    kept.append(raw[at:])
    masked.append(raw[at:])
    return "".join(kept), "".join(masked), lead


class Piece:
    """One piece of a file, after a lead."""

    def __init__(self, raw: str, lead: str = ""):
        self.text, self.marks, self.lead = uncommented(raw, lead)
        self.known: dict[int, tuple[list, int | None]] = {}

    def outside(self, at: int) -> tuple[list, int | None]:
        """The state after the piece, and where what is open then began, if it is read from outside from a place on."""
        met = []
        while True:
            head = HEAD.search(self.text, at)
            if head is None:
                begun = _BEGUN.search(self.text, at)
                out = (["out", 0], None) if begun is None else (["out", next(k for k in (1, 2, 3) if begun[k] is not None)], begun.start())
                break
            if head.start() in self.known:
                out = self.known[head.start()]
                break
            met.append(head.start())
            end, state = block_end(self.marks, head.end(), head[2])
            if end is None:
                out = state, head.start()
                break
            at = end + 1
        for start in met:
            self.known[start] = out
        return out

    def carried(self, mode: list) -> tuple[int | None, list]:
        """Where that ends which was open before the piece, or None and the state after it. It is 0 where it comes to nothing."""
        if mode[0] != "out":
            return _after(block_end(self.marks, 0, *mode))
        if not mode[1]:
            return 0, mode
        head = re.compile(_GOES_ON[mode[1]] + r"([{(])").match(self.text)
        if head:
            return _after(block_end(self.marks, head.end(), head[1]))
        for k, still in _STILL[mode[1]]:
            if re.match(still, self.text):
                return None, ["out", k]
        return 0, mode

    def run(self, mode: list) -> tuple[list, int, int | None]:
        """The state after the piece, where what was open before ends (its length, if it doesn't), and where what is open then began in it."""
        end, state = self.carried(mode)
        if end is None:
            return state, len(self.text), None
        state, tail = self.outside(end)
        return state, end, tail

    def summary(self) -> dict:
        """The states after it, of those before it that are usual."""
        out = [[*self.run(["out", k])[0], self.carried(["out", k])[0] is None] for k in range(4)]
        said: dict = {"lead": self.lead, "out": out}
        codes = np.frombuffer(self.marks.encode("utf-32-le"), np.uint32)
        step = (codes == ord("{")).astype(np.int64) - (codes == ord("}"))
        quotes = np.cumsum(codes == ord('"'))
        for quoted in (0, 1):
            open_ = (quotes + quoted) % 2 == 0
            depth = np.cumsum(np.where(open_, step, 0))
            least = np.minimum.accumulate(depth) if len(depth) else depth
            ends = np.searchsorted(-least, np.arange(1, 1 - int(least[-1]) if len(least) else 1), "left").tolist()
            still = [int(not open_[-1]), int(depth[-1])] if len(depth) else [quoted, 0]
            said["q" if quoted else "b"] = {"ends": [self.outside(e + 1)[0] for e in ends], "still": still}
        return said


def _after(found: tuple[int | None, list]) -> tuple[int | None, list]:
    end, state = found
    return (None, state) if end is None else (end + 1, ["out", 0])


def applied(said: dict, state: list) -> tuple[list, bool] | None:
    """The state after a piece, by its summary, and whether what was open before is open still; None where the summary doesn't say."""
    lead, mode = state[0], state[1:]
    if lead:
        return None
    if mode[0] == "out":
        *after, carried = said["out"][mode[1]]
        return [said["lead"], *after], carried
    if mode[0] == "{":
        way, depth = said["q" if mode[1] else "b"], mode[2]
        if depth <= len(way["ends"]):
            return [said["lead"], *way["ends"][depth - 1]], False
        return [said["lead"], "{", way["still"][0], depth + way["still"][1]], True
    return None


# Spark


def _pieces(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (file, start, line) to pieces of whole lines: file, start and number in that block, text, summary."""
    held, size, key, number = [], 0, None, 0

    def made() -> pa.RecordBatch:
        text = "\n".join(held) + "\n"
        return pa.RecordBatch.from_pydict({"file": [key[0]], "start": pa.array([key[1]], pa.int64()), "number": pa.array([number], pa.int64()), "text": [text], "summary": [json.dumps(Piece(text).summary())]})

    for batch in source:
        for file, start, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and ((file, start) != key or size >= PIECE_BYTES):
                yield made()
                number = number + 1 if (file, start) == key else 0
                held, size = [], 0
            elif (file, start) != key:
                number = 0
            key = file, start
            held.append(line or "")
            size += len(line or "") + 1
    if held:
        yield made()


def _walked(known: dict[tuple, list]):
    """Summaries of a file in order to the state before each piece, the piece in which what is open there began, and, where a summary
    doesn't say what follows, that it has to be run."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("piece")
        state, since, out = START, None, []
        for file, piece, summary in zip(rows["file"], rows["piece"], rows["summary"], strict=True):
            said = applied(json.loads(summary), state)
            if said is None and (file, piece, json.dumps(state)) in known:
                *after, carried = known[file, piece, json.dumps(state)]
                said = after, carried
            out.append((file, piece, json.dumps(state), since, said is None))
            if said is None:
                break
            state, carried = said
            if not carried:
                since = None if state[1:] == ["out", 0] else piece
        return pd.DataFrame(out, columns=["file", "piece", "state", "since", "asked"]).astype({"since": "Int64"})

    return run


def _run_on(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (file, piece, text, state) to the state after them."""
    for batch in source:
        for row in batch.to_pylist():
            state = json.loads(row["state"])
            piece = Piece(row["text"], state[0])
            after, _, _ = piece.run(state[1:])
            carried = piece.carried(state[1:])[0] is None
            yield pa.RecordBatch.from_pydict({"file": [row["file"]], "piece": pa.array([row["piece"]], pa.int64()), "state": [row["state"]], "after": [json.dumps([piece.lead, *after, carried])]})


FRAGMENTS = "file string, piece long, since long, kind string, content string"


def _parsed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with their state to blocks (type and content, since null) and fragments (text, since the piece they began in)."""
    for batch in source:
        for row in batch.to_pylist():
            state = json.loads(row["state"])
            piece = Piece(row["text"], state[0])
            after, end, tail = piece.run(state[1:])
            found = []
            if row["since"] is not None:
                found.append((row["since"], None, piece.text[:end]))
            found += [(None, kind, content) for kind, content in blocks(piece.text[end : len(piece.text) if tail is None else tail])]
            if tail is not None:
                found.append((row["piece"], None, piece.text[tail:]))
            for lo in range(0, len(found), 4096):
                since, kind, content = zip(*found[lo : lo + 4096], strict=True)
                n = len(since)
                yield pa.RecordBatch.from_pydict({"file": [row["file"]] * n, "piece": pa.array([row["piece"]] * n, pa.int64()), "since": pa.array(since, pa.int64()), "kind": pa.array(kind, pa.string()), "content": list(content)})


def _joined(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of what crossed cuts (file, since, text) to blocks, which come after all others of the piece they began in."""
    for batch in source:
        for row in batch.to_pylist():
            found = list(blocks(row["text"]))
            if found:
                n = len(found)
                yield pa.RecordBatch.from_pydict({"file": [row["file"]] * n, "piece": pa.array([row["since"]] * n, pa.int64()), "at": pa.array([1 << 40] * n, pa.int64()), "kind": [k for k, _ in found], "content": [c for _, c in found]})


def _read(macros: dict[str, dict[str, str]] | None):
    """Blocks of entries to entries; definitions come from macros, by file, or with the rows."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, own = None, Macros()
        for batch in source:
            rows = batch.to_pylist()
            out = []
            for row in rows:
                if macros is None or row["file"] != file:
                    file, own = row["file"], Macros()
                    own.defined.update(dict(row["macros"] or ()) if macros is None else macros.get(file, {}))
                entry = entry_of(row["kind"], row["content"], own)
                if entry:
                    out.append((row["file"], row["piece"], row["at"], entry["key"], entry["entry_type"], list(entry["fields"].items())))
            if out:
                columns = list(zip(*out, strict=True))
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "piece", "at", "key", "entry_type", "fields"])

    return run


def split_blocks(lines: DataFrame) -> DataFrame:
    """lines: file, start (of the part of the file that a task reads) and line, in order within a part. file, piece, at, kind and content of
    each block: piece and at give their order."""
    cut = stored(lines.mapInArrow(_pieces, "file string, start long, number long, text string, summary string"))
    order = Window.partitionBy("file").orderBy("start", "number")
    numbers = cut.select("file", "start", "number", "summary").withColumn("piece", F.row_number().over(order).cast("long"))
    numbers = stored(numbers)
    known: dict[tuple, list] = {}
    while True:
        states = stored(numbers.groupBy("file").applyInPandas(_walked(known), "file string, piece long, state string, since long, asked boolean"))
        asked = states.filter("asked")
        pieces = cut.join(numbers.select("file", "start", "number", "piece"), ["file", "start", "number"])
        if asked.isEmpty():
            break
        # One piece of each file at a time: rare, and small.
        told = pieces.join(asked.select("file", "piece", "state"), ["file", "piece"]).select("file", "piece", "text", "state").mapInArrow(_run_on, "file string, piece long, state string, after string")
        known |= {(r["file"], r["piece"], r["state"]): json.loads(r["after"]) for r in told.collect()}
    found = stored(pieces.join(states.select("file", "piece", "state", "since"), ["file", "piece"]).select("file", "piece", "text", "state", "since").mapInArrow(_parsed, FRAGMENTS).withColumn("at", F.monotonically_increasing_id()))
    crossing = found.filter("since IS NOT NULL").groupBy("file", "since").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "at", "content"))), lambda x: x["content"]), "").alias("text"))
    whole = found.filter("since IS NULL").select("file", "piece", F.col("at").alias("_at"), "kind", "content")
    least = whole.groupBy("file", "piece").agg(F.min("_at").alias("_first"))
    whole = whole.join(least, ["file", "piece"]).select("file", "piece", (F.col("_at") - F.col("_first")).alias("at"), "kind", "content")
    return whole.unionByName(crossing.mapInArrow(_joined, "file string, piece long, at long, kind string, content string"))


def split_entries(lines: DataFrame) -> DataFrame:
    """As bibtex.entries_of: file, pos, key, entry_type and fields of the last entry of each key of each file."""
    found = stored(split_blocks(lines))
    defined = found.filter("kind = 'string'").select("file", "piece", "at", F.explode(_assigned("content")).alias("a"))
    latest = defined.groupBy("file", F.lower("a.name").alias("name")).agg(F.max_by("a.value", F.struct("piece", "at", "a.n")).alias("value"))
    macros = stored(latest)
    rows = found.filter(~F.col("kind").isin(*NOT_ENTRIES))
    size = macros.agg(F.sum(F.length("file") + F.length("name") + F.length("value"))).first()[0] or 0
    entry = "file string, piece long, at long, key string, entry_type string, fields map<string,string>"
    if size <= MACRO_BYTES:
        held: dict[str, dict[str, str]] = {}
        for r in macros.collect():
            held.setdefault(r["file"], {})[r["name"]] = r["value"]
        read = rows.mapInArrow(_read(held), entry)
    else:
        by_file = macros.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("macros"))
        read = rows.join(by_file, "file", "left").mapInArrow(_read(None), entry)
    read = stored(read)
    counts = read.groupBy("file", "piece").agg(F.count("*").alias("n"))
    before = counts.select("file", "piece", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("file", "piece").orderBy("at")) - 1
    placed = read.withColumn("_in", inside).join(before, ["file", "piece"]).select("file", (F.col("before") + F.col("_in")).cast("int").alias("pos"), "key", "entry_type", "fields")
    return kept_entries(placed)


@F.pandas_udf(_ASSIGNED)
def _assigned(content: pd.Series) -> pd.Series:
    return content.map(lambda c: [{"n": n, "name": name, "value": value} for n, (name, value) in enumerate(assignments(c))])


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, start and line of the lines of files, which Spark cuts where it likes."""
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))
