"""What a stream remembers from batch to batch, in Spark's state store: counts of statuses, and which addresses have been asked.

Both are stateful processors whose state is kept with the query's checkpoint, so a query that stops, or is killed in a batch, goes on where it
was. They need a state store that holds such state: state_store() names it for the time in which a query starts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

RESULTS_DDL = "key string, status string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """A query started inside keeps its state in RocksDB; the session's setting is as before afterwards."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def kept_results(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for watch(): keys and statuses of each batch in a folder of its own. A batch that runs again replaces it."""

    def sink(results: DataFrame, number: int) -> None:
        results.select("key", "status").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sink


class _Counted(StatefulProcessor):
    """How many results a status has so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.so_far = handle.getValueState("so_far", "n long")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        n = self.so_far.get()[0] if self.so_far.exists() else 0
        new = sum(len(r) for r in rows)
        self.so_far.update((n + new,))
        yield pd.DataFrame({"status": [key[0]], "new": [new], "n": [n + new]})

    def close(self) -> None:
        pass


def running_statuses(results: DataFrame) -> DataFrame:
    """results: a stream of key and status. For each batch and each status in it, how many are new and how many there are so far. A key counts
    once, also if the batch that gave it ran twice."""
    return results.dropDuplicates(["key"]).groupBy("status").transformWithStateInPandas(_Counted(), "status string, new long, n long", "Append", "None")


def watch_counts(spark: SparkSession, results: str, counts: str, checkpoint: str) -> StreamingQuery:
    """Count what kept_results() has put in a folder: the counts after each batch, in a folder of their own for each."""
    rows = spark.readStream.schema(RESULTS_DDL).parquet(f"{results}/batch=*")

    def sink(told: DataFrame, number: int) -> None:
        told.write.mode("overwrite").parquet(f"{counts}/batch={number}")

    with state_store(spark):
        return running_statuses(rows).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Asked(StatefulProcessor):
    """One address: whether it is being asked, who waits for it, and what it answered."""

    def __init__(self, answer_ms: int, error_ms: int, patience_ms: int) -> None:
        self.answer_ms, self.error_ms, self.patience_ms = answer_ms, error_ms, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        said = "outcome string, body string"
        self.answer, self.error = handle.getValueState("answer", said, self.answer_ms), handle.getValueState("error", said, self.error_ms)
        self.asked, self.waiting = handle.getValueState("asked", "n int", self.patience_ms), handle.getListState("waiting", "key string")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        url, accept = key
        waiting: list[tuple] = []
        for row in sorted((r for part in rows for r in part.itertuples(index=False)), key=lambda r: pd.isna(r.outcome)):
            if not pd.isna(row.outcome):
                said = (row.outcome, None if pd.isna(row.body) else row.body)
                (self.answer if row.outcome == "ok" else self.error).update(said)
                self.asked.clear()
                out += [("answer", url, accept, k, *said) for (k,) in self.waiting.get()]
                self.waiting.clear()
                continue
            held = next((s.get() for s in (self.answer, self.error) if s.exists()), None)
            if held is not None:
                out.append(("answer", url, accept, row.key, *held))
                continue
            waiting.append((row.key,))
            if not self.asked.exists():
                self.asked.update((1,))
                out.append(("ask", url, accept, None, None, None))
        if waiting:
            self.waiting.appendList(waiting)
        if out:
            yield pd.DataFrame(out, columns=["kind", "url", "accept", "key", "outcome", "body"])

    def close(self) -> None:
        pass


def asked_once(events: DataFrame, answer_seconds: float = 3600, error_seconds: float = 60, patience_seconds: float = 60) -> DataFrame:
    """events: a stream of url, accept, key, outcome and body; with an outcome an answer, else a request of an entry (key). Gives `ask` for each
    address that has to be asked now, and `answer` with what it said for each key that asked for it.

    An address that is being asked isn't asked again, and who asks meanwhile waits for its answer; an answer holds for answer_seconds, an
    error for error_seconds, and if nothing comes within patience_seconds the next request asks anew. Answers of a batch count before its requests.

    State that expires needs a clock, so a query with it runs on until it is stopped, also with a trigger that takes what is available."""
    ms = [int(1000 * s) for s in (answer_seconds, error_seconds, patience_seconds)]
    return events.groupBy("url", "accept").transformWithStateInPandas(_Asked(*ms), "kind string, url string, accept string, key string, outcome string, body string", "Append", "ProcessingTime")
