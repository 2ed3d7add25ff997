"""Live completions with a ledger."""

import json
import os
import time
from pathlib import Path

import pytest

from beliefmill.sources import ledger
from beliefmill.sources.completions import Retry


def prompts(spark, n):
    return spark.createDataFrame([("m", "s", f"prompt {i}") for i in range(n)] + [("m", "s", "prompt 0"), ("m", None, None)], "model string, system string, user string")


def provider(folder, fails=(), dies="nothing"):
    """Notes every call as a file; some prompts fail once, one ends the task."""
    folder = str(folder)

    def call(model, system, user):
        import os
        import uuid

        seen = [f for f in os.listdir(folder) if f.startswith(f"{user} ")]
        open(f"{folder}/{user} {uuid.uuid4().hex}", "w").close()
        if user == dies and not seen:
            raise SystemExit("killed")
        if user in fails and not seen:
            raise ValueError("429 too many")
        return f'{{"asked": "{user}"}}', "stop"

    return call


def calls(folder):
    return sorted(f.rsplit(" ", 1)[0] for f in os.listdir(folder))


def test_only_what_is_missing_is_asked(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    call = provider(tmp_path / "calls")
    first = ledger.complete_live(prompts(spark, 40), call, str(tmp_path / "l"), batch=3, buckets=4, in_flight=3)
    assert first.count() == 41 and len(calls(tmp_path / "calls")) == 41
    more = ledger.complete_live(prompts(spark, 60), call, str(tmp_path / "l"), batch=3, buckets=4, in_flight=3)
    rows = more.collect()
    assert len(rows) == 61 and {r.status for r in rows} == {"ok"} and len(set(calls(tmp_path / "calls"))) == len(calls(tmp_path / "calls")) == 61
    assert {json.loads(r.raw)["asked"] for r in rows} == {*(f"prompt {i}" for i in range(60)), "None"}


def test_a_killed_task_asks_no_prompt_twice(spark, tmp_path):
    """One call ends its worker; the next run asks that prompt, what came after it, and nothing else."""
    (tmp_path / "calls").mkdir()
    call = provider(tmp_path / "calls", dies="prompt 7")
    with pytest.raises(Exception, match="killed|SystemExit|Python worker"):
        ledger.complete_live(prompts(spark, 50), call, str(tmp_path / "l"), batch=1000, buckets=2, in_flight=4)
    once = calls(tmp_path / "calls")
    assert 1 < len(once)
    rows = ledger.complete_live(prompts(spark, 50), call, str(tmp_path / "l"), batch=1000, buckets=2, in_flight=4).collect()
    assert len(rows) == 51 and {r.status for r in rows} == {"ok"}
    assert all(calls(tmp_path / "calls").count(c) == 1 + (c == "prompt 7") for c in set(calls(tmp_path / "calls")))
    assert not [p for p in Path(tmp_path / "l").rglob("*.writing")]


def test_failed_prompts_and_rate_limits(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    call = provider(tmp_path / "calls", fails=("prompt 1",))
    rows = ledger.complete_live(prompts(spark, 3), call, str(tmp_path / "l"), Retry(attempts=1), buckets=2).collect()
    assert sorted(r.status for r in rows) == ["failed", "ok", "ok", "ok"]
    rows = ledger.complete_live(prompts(spark, 3), call, str(tmp_path / "l"), Retry(attempts=1), buckets=2).collect()
    assert {r.status for r in rows} == {"ok"} and len(calls(tmp_path / "calls")) == 5


def test_calls_in_flight_and_pace(tmp_path):
    import threading

    now, most, lock = [0], [0], threading.Lock()

    def call(model, system, user):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.02)
        with lock:
            now[0] -= 1
        return "{}", "stop"

    rows = [{"model": "m", "system": "s", "user": str(i), "prompt_hash": str(i)} for i in range(30)]
    assert ledger.ask_bucket(iter(rows), str(tmp_path), 0, call, Retry(), 5, 4, ledger.Pace(0.0), True) == 30 and most[0] == 5
    assert ledger.ask_bucket(iter(rows), str(tmp_path), 0, call, Retry(), 5, 4, ledger.Pace(0.0), True) == 0
    slept, clock = [], [100.0]
    pace = ledger.Pace(0.5, slept.append, lambda: clock[0])
    for _ in range(3):
        pace()
    pace.busy(60)
    pace()
    assert slept == [0.5, 1.0, 60.0]
