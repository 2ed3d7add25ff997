"""Streams that know what became of each id."""

import json
import os
import time

from beliefmill.streaming import states

SCHEMA = "id string, pos bigint, x int"


def put(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/.{name}", "w") as f:
        f.write("\n".join(json.dumps(dict(zip(("id", "pos", "x"), r, strict=True))) for r in rows))
    os.rename(f"{folder}/.{name}", f"{folder}/{name}")


def asker():
    """A function that workers, which can't import this module, get by value."""

    def even(record):
        if record["x"] % 2:
            raise ValueError(f"odd {record['x']}")
        return {"half": record["x"] // 2}

    return even


def found(spark, place):
    rows = spark.read.schema("id string, pos bigint, attempt int, status string, error string, half int").parquet(f"{place}/out")
    return sorted(map(tuple, rows.collect()))


def run(spark, place, **more):
    return states.run_attempts(spark, f"{place}/in", SCHEMA, f"{place}/out", f"{place}/check", "id", "pos", more.pop("ask", None) or asker(), "half int", **more)


def test_done_failed_and_given_up_over_restarts(spark, tmp_path):
    put(tmp_path / "in", "a.json", [("p", 2, 4), ("p", 1, 3), ("q", 3, 1), ("r", 4, 6), ("r", 5, 8)])
    run(spark, tmp_path, most=3).awaitTermination(120)
    first = [("p", 1, 1, "failed", "odd 3", None), ("p", 2, 2, "done", None, 2), ("q", 3, 1, "failed", "odd 1", None), ("r", 4, 1, "done", None, 3)]
    assert found(spark, tmp_path) == first
    put(tmp_path / "in", "b.json", [("q", 6, 5), ("p", 7, 9), ("s", 8, 1)])
    put(tmp_path / "in", "c.json", [("q", 9, 7), ("q", 10, 2), ("s", 11, 2)])
    run(spark, tmp_path, most=3, files=1).awaitTermination(120)
    more = [("q", 6, 2, "failed", "odd 5", None), ("q", 9, 3, "given up", "odd 7", None), ("s", 8, 1, "failed", "odd 1", None), ("s", 11, 2, "done", None, 1)]
    assert found(spark, tmp_path) == sorted(first + more)
    run(spark, tmp_path, most=3).awaitTermination(120)  # nothing new: nothing is asked
    assert found(spark, tmp_path) == sorted(first + more)


def test_a_broken_run_repeats_nothing(spark, tmp_path):
    """The query dies in its second batch; started again, every attempt is in the results once."""
    put(tmp_path / "in", "a.json", [("p", 1, 2), ("q", 2, 1)])
    run(spark, tmp_path, most=2).awaitTermination(120)
    put(tmp_path / "in", "b.json", [("q", 3, 4), ("t", 4, 2)])
    marker, even = str(tmp_path / "marker"), asker()

    def dies(record):
        if record["id"] == "t" and not os.path.exists(marker):
            open(marker, "w").close()
            raise SystemExit("killed")
        return even(record)

    broken = run(spark, tmp_path, most=2, ask=dies)
    try:
        broken.awaitTermination(120)
    except Exception:
        pass
    run(spark, tmp_path, most=2, ask=dies).awaitTermination(120)
    assert found(spark, tmp_path) == [("p", 1, 1, "done", None, 1), ("q", 2, 1, "failed", "odd 1", None), ("q", 3, 2, "done", None, 2), ("t", 4, 1, "done", None, 1)]


def test_asked_again_after_a_wait(spark, tmp_path):
    put(tmp_path / "in", "a.json", [("p", 1, 2)])
    marker, even = str(tmp_path / "marker"), asker()

    def second_time(record):
        if not os.path.exists(marker):
            open(marker, "w").close()
            raise ValueError("busy")
        return even(record)

    query = run(spark, tmp_path, most=3, ask=second_time, wait=200, once=False, every="500 milliseconds")
    try:
        for _ in range(120):
            time.sleep(0.5)
            if os.path.isdir(tmp_path / "out") and len(got := found(spark, tmp_path)) == 2:
                break
    finally:
        query.stop()
    assert got == [("p", 1, 1, "failed", "busy", None), ("p", 1, 2, "done", None, 1)]


def test_state_comes_with_the_rows(spark):
    """No id asks a state server: state is passed along with its rows, many ids in a batch."""
    stream = spark.readStream.format("rate").load().selectExpr("cast(value as string) as id", "value as pos")
    plan = states.attempts(stream, "id", "pos", asker(), "half int")._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroupsInPandasWithState" in plan and "TransformWithState" not in plan
