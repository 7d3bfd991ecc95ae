"""What streams remember when they stop and start again."""

from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from refsift.plans.settings import Limits, within_size
from refsift.streaming.state import _Asked, kept_results, watch_counts
from refsift.streaming.watch import watch


def test_counts_go_on_after_a_restart(spark, tmp_path):
    folder = tmp_path / "bib"
    folder.mkdir()
    status = F.when(F.col("key").contains("v"), "validated").otherwise("unconfirmed")

    def round_(name, text):
        (folder / name).write_text(text)
        watch(spark, str(folder), lambda entries: entries.select("key", status.alias("status")), kept_results(str(tmp_path / "results")), str(tmp_path / "one")).awaitTermination(120)
        watch_counts(spark, str(tmp_path / "results"), str(tmp_path / "counts"), str(tmp_path / "two")).awaitTermination(120)
        return {r["status"]: (r["new"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/counts/batch={number}").collect()}

    number = 0
    assert round_("a.bib", "@misc{v1, title={One}} @misc{u1, title={Two}} @misc{v2, title={T}}") == {"validated": (2, 2), "unconfirmed": (1, 1)}
    number = 1
    assert round_("b.bib", "@misc{v1, title={Three}}") == {"validated": (1, 3)}
    # The first batch's results are written again, as after a failure: nothing counts twice.
    again = spark.read.parquet(f"{tmp_path}/results/batch=0").collect()
    kept_results(str(tmp_path / "results"))(spark.createDataFrame(again), 0)
    number = 2
    assert round_("c.bib", "@misc{u9, title={Four}}") == {"unconfirmed": (1, 2)}


class Store:
    """State of one address, without Spark: values that can be made to expire, and a list."""

    def __init__(self):
        self.values, self.lists, self.ttl = {}, {}, {}

    def getValueState(self, name, schema, ttl_ms):
        self.ttl[name] = ttl_ms
        own = self.values
        return SimpleNamespace(exists=lambda: name in own, get=lambda: own[name], update=lambda v: own.__setitem__(name, v), clear=lambda: own.pop(name, None))

    def getListState(self, name, schema):
        own = self.lists.setdefault(name, [])
        return SimpleNamespace(get=lambda: iter(list(own)), appendList=own.extend, clear=own.clear)


def test_no_address_is_asked_twice_until_it_expires():
    store = Store()

    def batch(*rows):
        """A batch with a processor of its own, as after a restart."""
        asked = _Asked(3000, 200, 100)
        asked.init(store)
        frame = pd.DataFrame(rows, columns=["key", "outcome", "body"])
        return sorted((r.kind, r.key or "", r.body or "") for part in asked.handleInputRows(("u", "json"), iter([frame]), None) for r in part.itertuples())

    ask = lambda key: (key, None, None)
    assert batch(ask("a"), ask("b")) == [("ask", "", "")] and batch(ask("c")) == []
    assert batch((None, "ok", "B"), ask("d")) == [("answer", k, "B") for k in "abcd"]
    assert batch(ask("e")) == [("answer", "e", "B")]
    del store.values["answer"]
    assert batch(ask("f")) == [("ask", "", "")]
    del store.values["asked"]  # nothing came in time
    assert batch(ask("g")) == [("ask", "", "")]
    assert batch((None, "error", "E")) == [("answer", "f", "E"), ("answer", "g", "E")] and batch(ask("h")) == [("answer", "h", "E")]
    del store.values["error"]
    assert batch(ask("i")) == [("ask", "", "")] and store.ttl == {"answer": 3000, "error": 200, "asked": 100}


def test_files_that_are_too_large_are_not_read(spark, tmp_path):
    (tmp_path / "small.bib").write_text("@misc{a, title={b}}")
    (tmp_path / "large.bib").write_text("x" * 5000)
    small, large = within_size(spark, str(tmp_path), Limits(bytes_a_file=1000))
    assert [p.rpartition("/")[2] for p in small] == ["small.bib"] and [p.rpartition("/")[2] for p in large] == ["large.bib"]
    assert len(within_size(spark, str(tmp_path), Limits())[0]) == 2
