import pytest

from refsift.sources.bibtex import entries_of, parse, read_bib
from refsift.sources.latex import document_keys, read_tex, scan

BIB = r"""
% a note with an @article{no, title={x}}
@string{venue = "Annals " # "of Tests"}
@comment{@article{hidden, title={x}}}
@preamble{"\newcommand{\x}{}"}
@Article{first,
  title = {A {Nested {Brace}} Title}, author = {Ann Lee and {Group and Sons}}, year = 2020,
  journal = venue, doi = {https://doi.org/10.1/X}, eprint = {arXiv:2001.00001v2}, note = {100\% sure},
}
@misc(second, title = "Quoted, {a} value", howpublished = "https://example.org")
@article{first, title = {Second of its key}, note = {a = b}}
@article{, title = {No key}}
@article{open, title = {never ends}
"""


def test_parse():
    got = parse(BIB)
    assert [e["key"] for e in got] == ["first", "second", "first"]
    assert got[0]["entry_type"] == "article"
    assert got[0]["fields"]["title"] == "A {Nested {Brace}} Title"
    assert got[0]["fields"]["journal"] == "Annals of Tests"
    assert got[0]["fields"]["note"] == r"100\% sure"
    assert got[2]["fields"]["note"] == "a = b"


def test_macros_that_use_each_other():
    assert parse('@string{a = b # "x"} @string{b = a} @misc{k, t = a, u = undefined}')[0]["fields"] == {"t": "ax", "u": "undefined"}


def test_entries(spark, tmp_path):
    (tmp_path / "refs.bib").write_text("﻿" + BIB)
    rows = {r["key"]: r for r in read_bib(spark, str(tmp_path / "refs.bib")).collect()}
    assert set(rows) == {"first", "second"}
    assert (rows["first"]["pos"], rows["first"]["fields"]["title"]) == (0, "Second of its key")
    assert entries_of(spark.createDataFrame([], "file string, text string")).count() == 0


def test_scan():
    keys, files = scan(
        r"\Cite*[see][p. 2]{a, b} % \cite{no}"
        "\n"
        r"\verb|\cite{no}| \begin{lstlisting}\cite{no}\end{lstlisting} \textcites[1]{c}[2]{d} \\cite{no} \nocite{*} \input{part/one} \include two "
    )
    assert keys == ["a", "b", "c", "d", "*"]
    assert files == ["part/one", "two"]


def test_document(spark, tmp_path):
    (tmp_path / "part").mkdir()
    (tmp_path / "main.tex").write_text(r"\cite{a} \input{part/one} \include{gone}")
    (tmp_path / "part" / "one.tex").write_text(r"\parencite{b} \input{../main} \input{two.tex}")
    (tmp_path / "part" / "two.tex").write_text(r"\cite{c}")
    (tmp_path / "other.tex").write_text(r"\cite{d}")
    texts = read_tex(spark, str(tmp_path))
    root = f"file://{tmp_path}/main.tex"
    root = next(r["file"] for r in texts.collect() if r["file"].endswith("main.tex")) or root
    assert {r["key"] for r in document_keys(texts, root).collect()} == {"a", "b", "c"}
    assert {r["key"] for r in document_keys(texts).collect()} == {"a", "b", "c", "d"}
    with pytest.raises(FileNotFoundError):
        document_keys(texts, "gone.tex")
