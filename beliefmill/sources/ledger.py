"""Live completions that outlive tasks: replies go to a ledger as they come, and only what it lacks is asked."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .completions import REPLY, SCHEMA, Retry, answer, prompt_hash


class Pace:
    """Lets calls of a task begin `gap` seconds apart, and none while the service is busy."""

    def __init__(self, gap: float, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        self.gap, self.sleep, self.clock, self.lock, self.next = gap, sleep, clock, threading.Lock(), 0.0

    def __call__(self) -> None:
        with self.lock:
            now = self.clock()
            start = max(now, self.next)
            self.next = start + self.gap
        if start > now:
            self.sleep(start - now)

    def busy(self, seconds: float) -> None:
        with self.lock:
            self.next = max(self.next, self.clock() + seconds)


def store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith(("/", "file:")) else f"file://{path}")


def known(where: fs.FileSystem, folder: str) -> set[tuple[str, str]]:
    """(model, prompt hash) of the good replies in a folder of the ledger."""
    found = where.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    out: set[tuple[str, str]] = set()
    for f in found:
        if f.base_name.endswith(".parquet"):
            t = pq.read_table(f.path, columns=["model", "prompt_hash", "status"], filesystem=where).to_pydict()
            out |= {(m, h) for m, h, s in zip(t["model"], t["prompt_hash"], t["status"], strict=True) if s == "ok"}
    return out


def commit(where: fs.FileSystem, folder: str, rows: list[dict]) -> None:
    """Add replies as a file, which has its name only when it is whole."""
    where.create_dir(folder, recursive=True)
    name = uuid.uuid4().hex
    pq.write_table(pa.Table.from_pylist(rows, REPLY), f"{folder}/.{name}.writing", filesystem=where)
    where.move(f"{folder}/.{name}.writing", f"{folder}/{name}.parquet")


def ask_bucket(rows: Iterator[dict], ledger: str, bucket: int, call, retry: Retry, in_flight: int, batch: int, pace: Pace, wants_json: bool) -> int:
    """Ask for what the bucket's folder lacks, `in_flight` prompts at a time; how many were asked.

    Replies are committed `batch` at a time, and at the end in any case, also where the task is stopped.
    """
    where, root = store(ledger)
    folder = f"{root}/bucket={bucket}"
    done, held, running, asked = known(where, folder), [], set(), 0

    def one(row: dict) -> dict:
        pace()
        return answer(row, call, retry, pace.sleep, wants_json, pace.busy)

    def gather(some) -> None:
        held.extend(f.result() for f in some if not f.exception())
        if len(held) >= batch:
            commit(where, folder, held)
            held.clear()
        for f in some:
            f.result()  # what ended a call ends the task, after the others' replies are held

    pool = ThreadPoolExecutor(in_flight)
    try:
        for row in rows:
            if (row["model"], row["prompt_hash"]) in done:
                continue
            while len(running) >= in_flight:
                ended, running = wait(running, return_when=FIRST_COMPLETED)
                gather(ended)
            running.add(pool.submit(one, row))
            asked += 1
        while running:
            ended, running = wait(running, return_when=FIRST_COMPLETED)
            gather(ended)
    finally:
        pool.shutdown(wait=True)
        held += [f.result() for f in running if not f.exception()]
        if held:
            commit(where, folder, held)
    return asked


def complete_live(prompts: DataFrame, call: Callable[[str, str, str], tuple[str, str]], ledger: str, retry: Retry = Retry(), in_flight: int = 8, rate: float | None = None, batch: int = 16,
                  buckets: int = 32, wants_json: bool = True) -> DataFrame:
    """Completions (prompt_hash, model, status, finish_reason, raw) of distinct prompts (model, system, user), asked within tasks.

    ledger: a folder that all executors reach. Prompts lie in `buckets` by their hash, each worked on by one
    task, which first reads what its bucket's folder holds: prompts with a good reply there aren't asked
    again, by another run or by the retry of a task that was lost; so at most a batch and what is in
    flight can be asked twice. Failed ones are asked again by the next run. A task has `in_flight` calls
    open; `rate` calls a second are shared out over the tasks that can run at once, and a rate limit holds
    up all calls of its task. Of several replies to a prompt a good one counts, else any.
    """
    spark = prompts.sparkSession
    asked = prompts.select("model", "system", "user", prompt_hash(F.col("system"), F.col("user")).alias("prompt_hash")).dropDuplicates(["model", "prompt_hash"])
    asked = asked.withColumn("bucket", F.pmod(F.conv(F.substring("prompt_hash", 1, 8), 16, 10).cast("bigint"), F.lit(buckets)).cast("int"))
    gap = min(buckets, spark.sparkContext.defaultParallelism) / rate if rate else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pace, rows = Pace(gap), (row for b in batches for row in b.to_pylist())
        row = next(rows, None)
        while row is not None:
            bucket, after = row["bucket"], []

            def same(first: dict):
                yield first
                for r in rows:  # noqa: B023
                    if r["bucket"] != bucket:  # noqa: B023
                        after.append(r)  # noqa: B023
                        return
                    yield r

            n = ask_bucket(same(row), ledger, bucket, call, retry, in_flight, batch, pace, wants_json)
            yield pa.RecordBatch.from_pydict({"bucket": [bucket], "asked": [n]}, pa.schema([("bucket", pa.int32()), ("asked", pa.int64())]))
            row = after[0] if after else None

    work = asked.repartition(buckets, "bucket").sortWithinPartitions("bucket", "prompt_hash")
    work.mapInArrow(run, "bucket int, asked bigint").write.format("noop").mode("overwrite").save()
    replies = spark.read.schema(SCHEMA).parquet(ledger).join(asked.select("model", "prompt_hash"), ["model", "prompt_hash"], "left_semi")
    best = F.max_by(F.struct("status", "finish_reason", "raw"), F.struct((F.col("status") == "ok").alias("good"), "raw"))
    return replies.groupBy("model", "prompt_hash").agg(best.alias("r")).select("prompt_hash", "model", "r.status", "r.finish_reason", "r.raw")
