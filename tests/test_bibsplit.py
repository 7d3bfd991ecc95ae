"""Files cut anywhere give what reading them whole gives."""

import random

import pytest
from pyspark.sql import functions as F

from refsift.sources import bibsplit
from refsift.sources.bibsplit import START, Piece, applied
from refsift.sources.bibtex import blocks, entries_of, parse, read_bib, without_comments

TOKENS = ["@article{", "@string(", "@string{", "@comment{", "@ misc\n{", "k1,", "k2 ,", " title = {A {B} c},", ' x = "q {z} w",', "}", ")", "(", "{", '"', '\\"', "\\{", "\\%", "% no }\n", "%", "\n", "\\", "\\\n", "a", "é", "@", "=", ",", "#", "m = {v}", "m", " ", "@b", "tex", "{"]


def in_pieces(parts):
    """Blocks of a text cut in parts, from each part and its state alone; and how many states the summaries gave."""
    state, since, found, fragments, told = START, None, [], {}, 0
    for n, raw in enumerate(parts):
        piece = Piece(raw, state[0])
        after, end, tail = piece.run(state[1:])
        carried = piece.carried(state[1:])[0] is None
        said = applied(Piece(raw).summary(), state)
        if said is not None:
            told += 1
            assert said == ([piece.lead, *after], carried)
        if since is not None:
            fragments[since].append(piece.text[:end])
        found += [((n, 0, i), b) for i, b in enumerate(blocks(piece.text[end : len(piece.text) if tail is None else tail]))]
        if tail is not None:
            fragments[n] = [piece.text[tail:]]
        if not carried:
            since = None if after == ["out", 0] else n
        state = [piece.lead, *after]
    found += [((n, 1, 0), b) for n, f in fragments.items() for b in blocks("".join(f))]
    return [b for _, b in sorted(found)], told


def test_cut_at_every_character_and_anywhere():
    rng, told = random.Random(2), 0
    for _ in range(1500):
        text = "".join(rng.choices(TOKENS, k=rng.randint(1, 25)))
        want = list(blocks(without_comments(text)))
        for cuts in (range(len(text) + 1), sorted(rng.randrange(len(text) + 1) for _ in range(rng.randint(0, 5)))):
            got, n = in_pieces([text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)])
            assert got == want, text
            told += n
    assert told > 10_000


def random_file(rng, entries):
    out = ['@string{jour = "Journal of "}\n@String(other = jour # {Things})\n% @misc{no, title={no}}\n']
    for i in range(entries):
        field = rng.choice(['journal = jour # "X"', "journal = other", "note = {a {deep {er}} \\} one}", 'note = "quoted {b} \\" at"', "% comment }\n year = 2001"])
        out.append(f"@Article\n{{key{rng.randrange(entries)},\n title = {{Title {i}\n over lines}},\n {field},\n}}\n" + rng.choice(["", "loose text with } and \" in it\n", "@comment{x}\n", "@misc(par, title = {p (q)}\n)\n"]))
    return "".join(out)


@pytest.mark.parametrize("piece", [40, 300, 1 << 20])
@pytest.mark.parametrize("macros", [1 << 20, 0])
def test_files_read_in_pieces_equal_parse(spark, tmp_path, monkeypatch, piece, macros):
    monkeypatch.setattr(bibsplit, "PIECE_BYTES", piece)
    monkeypatch.setattr(bibsplit, "MACRO_BYTES", macros)
    rng = random.Random(piece)
    texts = {"a": random_file(rng, 60), "b": random_file(rng, 5) + "@misc{open, title = {never closed}\n@misc{in, x={y}}\n", "c": "", "d": "﻿@misc{k, title={T}}", "e": "@string(a = {x\n)\n" + "(\n" * 40 + "}) @misc{z, t = a}\n"}
    for name, text in texts.items():
        (tmp_path / f"{name}.bib").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = read_bib(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    whole = entries_of(spark.createDataFrame([(f"{name}.bib", text) for name, text in texts.items()], "file string, text string")).collect()
    told = lambda rows: sorted((r["file"].rpartition("/")[2], r["pos"], r["key"], r["entry_type"], tuple(sorted(r["fields"].items()))) for r in rows)
    assert told(rows) == told(whole) and len(rows) > 30
    assert {r["key"] for r in rows if r["file"].endswith("d.bib")} == {"k"} and len(parse(texts["b"])) == 5 + texts["b"].count("@misc(")


def test_a_file_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bibsplit, "PIECE_BYTES", 20_000)
    text = "".join(f"@article{{k{i},\n title = {{Title of {i}}},\n author = {{A B and C D}},\n}}\n" for i in range(20_000))
    (tmp_path / "large.bib").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        lines = bibsplit.read_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() >= 10
        got = read_bib(spark, str(tmp_path)).agg(F.count("*"), F.countDistinct("key"), F.max("pos"), F.sum(F.col("pos") - F.substring("key", 2, 9).cast("int"))).first()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert tuple(got) == (20_000, 20_000, 19_999, 0)
