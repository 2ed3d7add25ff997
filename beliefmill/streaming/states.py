"""Watching with a state for each id: done, failed, given up; failed ones are asked again, also after a wait."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DONE, FAILED, GIVEN_UP = "done", "failed", "given up"


class Attempts:
    """Asks for an id's records in order until one answer comes or `most` attempts failed.

    An id's state comes and goes with its rows, many ids in an Arrow batch, so none asks a state server.
    """

    STATE = "n int, status string, held binary"

    def __init__(self, key: str, order: str, ask: Callable[[dict], dict], fields: list[str], most: int, wait: int | None, names: list[str]):
        self.key, self.order, self.ask, self.fields, self.most, self.wait, self.names = key, order, ask, fields, most, wait, names

    def _attempt(self, record: dict, n: int) -> dict:
        row = {self.key: record[self.key], self.order: record[self.order], "attempt": n, "status": DONE, "error": None}
        try:
            answer = self.ask(record)
            return row | {f: answer.get(f) for f in self.fields}
        except Exception as e:  # whatever a provider raises is a failed attempt
            return row | dict.fromkeys(self.fields) | {"status": GIVEN_UP if n >= self.most else FAILED, "error": str(e)}

    def run(self, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, status, held = state.get if state.exists else (0, FAILED, None)
        if status != FAILED:
            return
        if state.hasTimedOut:
            records = [pickle.loads(held)]
        else:
            rows = (row for f in frames for row in zip(*(f[c].tolist() for c in f), strict=True))
            records = sorted((dict(zip(self.names, row, strict=True)) for row in rows), key=lambda r: r[self.order])
        out = []
        for record in records:
            n += 1
            out.append(self._attempt(record, n))
            status = out[-1]["status"]
            if status != FAILED:
                break
        again = self.wait is not None and status == FAILED
        state.update((n, status, pickle.dumps(records[-1]) if again else None))
        if again:
            state.setTimeoutDuration(self.wait)
        yield pd.DataFrame(out, columns=[self.key, self.order, "attempt", "status", "error", *self.fields])


def attempts(stream: DataFrame, key: str, order: str, ask: Callable[[dict], dict], result: str = "", most: int = 1, wait: int | None = None) -> DataFrame:
    """(key, order, attempt, status, error, result…) of a stream of records: a row an attempt.

    ask(record) gives the result's fields, or raises. The first record of an id is asked; when that
    fails, the id's next record is, up to `most` attempts, after which it is given up; with most 1 a
    failed id counts as done. Records of an id that is done or given up are left out, in this batch and in
    later ones: what is known of an id is state of the stream, kept with its checkpoint. wait: milliseconds after
    which the last failed record is asked again though no other came. Records of a batch come by `order`.
    """
    schema = {f.name: f.dataType.simpleString() for f in stream.schema}
    fields = [f.strip().split()[0] for f in result.split(",") if f.strip()]
    shape = f"{key} {schema[key]}, {order} {schema[order]}, attempt int, status string, error string" + (f", {result}" if fields else "")
    work = Attempts(key, order, ask, fields, most, wait, stream.columns)
    timeout = GroupStateTimeout.NoTimeout if wait is None else GroupStateTimeout.ProcessingTimeTimeout
    return stream.groupBy(key).applyInPandasWithState(lambda _, frames, state: work.run(frames, state), shape, Attempts.STATE, "append", timeout)


def run_attempts(spark: SparkSession, folder: str, schema: str, results: str, checkpoint: str, key: str, order: str, ask: Callable[[dict], dict], result: str = "", most: int = 1,
                 wait: int | None = None, once: bool = True, every: str = "10 seconds", files: int | None = None):
    """Start the attempts for JSON records of new files in folder; each is a row of `results` (Parquet) once, however often the query is stopped and started.

    State is kept in the RocksDB store. once: what is there now, then stop. files: at most so many a batch.
    """
    reader = spark.readStream.schema(schema)
    if files is not None:
        reader = reader.option("maxFilesPerTrigger", files)
    rows = attempts(reader.json(folder), key, order, ask, result, most, wait)
    writer = rows.writeStream.format("parquet").option("path", results).option("checkpointLocation", checkpoint)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
