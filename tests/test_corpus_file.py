"""Corpus files that are read by many tasks."""

import json
import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from beliefmill.sources import corpus_file, files

ODD = ['a"b', "x\\", "{}", "}{", '","', "ключ", "\\\"}", "", " sp ", "[1, 2]", '"bayesian_networks": {', " ", "e\\\\"]


def made(rng, n):
    def value(depth):
        kind = rng.randrange(7 if depth < 4 else 4)
        if kind > 4:
            return {rng.choice(ODD) + str(i): value(depth + 1) for i in range(rng.randrange(4))}
        return [rng.choice(ODD) * rng.randrange(3), rng.random(), None, True, [value(depth + 1) for _ in range(rng.randrange(4))] if depth < 4 else 1][kind]

    return {"metadata": {"total": n, "about": {"x": rng.choice(ODD)}, "tags": ["a", "b", "c"]}, "plain": "text, \"bayesian_networks\": {", "bayesian_networks": {f"bn {i} {rng.choice(ODD)}": {"v": value(0), "n": i} for i in range(n)}, "after": {"z": {"q": [1, {"w": 2}]}}}


@pytest.fixture
def small_splits(spark):
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    yield lambda n: [spark.conf.set(k, v) for k, v in zip(was, (str(n), "1", "7"), strict=True)]
    for k, v in was.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize(("indent", "ascii_", "split", "end"), [(None, True, 97, ""), (2, False, 211, "\n"), (None, False, 1000, " \n\n"), (1, True, 10**8, "")])
def test_any_layout(spark, tmp_path, small_splits, indent, ascii_, split, end):
    """Compact and indented files, cut into stretches of about a hundred bytes up to one: all records, in order, as they are written."""
    small_splits(split)
    what = made(random.Random(split), 60)
    text = json.dumps(what, indent=indent, ensure_ascii=ascii_) + end
    (tmp_path / "c.json").write_text(text, encoding="utf-8")
    got = sorted(map(tuple, corpus_file.read_members(spark, str(tmp_path / "c.json")).collect()))
    assert [r[0] for r in got] == list(range(60))
    assert [(i, json.loads(v)) for _, i, v in got] == list(what["bayesian_networks"].items())
    assert all(v in text for _, _, v in got)
    other = sorted(map(tuple, corpus_file.read_members(spark, str(tmp_path / "c.json"), "after").collect()))
    assert [(p, i, json.loads(v)) for p, i, v in other] == [(0, "z", {"q": [1, {"w": 2}]})]
    assert corpus_file.read_members(spark, str(tmp_path / "c.json"), "nothing").count() == 0


def test_one_record_over_many_stretches(spark, tmp_path, small_splits):
    small_splits(300)
    what = {"bayesian_networks": {"a": {"n": 1}, "big": {"list": [{"i": i, "t": "}" * (i % 5)} for i in range(400)]}, "z": {}}}
    (tmp_path / "c.json").write_text(json.dumps(what))
    rows = corpus_file.read_members(spark, str(tmp_path / "c.json"))
    assert [(r.id, json.loads(r.record)) for r in rows.orderBy("bn_pos").collect()] == list(what["bayesian_networks"].items())
    (tmp_path / "d.json").write_text('{"bayesian_networks": {}}')
    assert corpus_file.read_members(spark, str(tmp_path / "d.json")).count() == 0


def test_folder_and_many_tasks(spark, tmp_path, small_splits):
    """A written folder is read as one object, by many tasks; numbers stay as they were written."""
    df = spark.range(3000).select(F.col("id").alias("pos"), F.format_string("bn_%05d", "id").alias("id"), F.repeat(F.lit('x"}{'), (F.col("id") % 9).cast("int")).alias("t"), (F.col("id") / 4).alias("p"))
    files.write_corpus(df, df.agg(F.count("*").alias("total")), str(tmp_path / "c"))
    small_splits(4000)
    back = files.read_corpus(spark, str(tmp_path / "c"))
    rows = back.orderBy("bn_pos").collect()
    assert [r.id for r in rows] == [f"bn_{i:05d}" for i in range(3000)] and json.loads(rows[7].record) == {"id": "bn_00007", "t": 'x"}{' * 7, "p": 1.75}
    assert spark.read.option("lineSep", "}").text(str(tmp_path / "c")).rdd.getNumPartitions() > 20


def test_failed_write_leaves_nothing(spark, tmp_path):
    good = spark.createDataFrame([(0, "a", 1)], "pos int, id string, v int")
    about = good.agg(F.count("*").alias("total"))
    bad = good.select("pos", "id", F.raise_error(F.lit("stop")).cast("int").alias("v"))
    with pytest.raises(Exception, match="stop"):
        files.write_corpus(bad, about, str(tmp_path / "c"))
    assert list(tmp_path.iterdir()) == []
    files.write_corpus(good, about, str(tmp_path / "c"))
    with pytest.raises(Exception, match="stop"):
        files.write_corpus(bad, about, str(tmp_path / "c"))
    assert [p.name for p in tmp_path.iterdir()] == ["c"] and files.read_corpus(spark, str(tmp_path / "c"), "v int").first().record.v == 1


def test_scans_are_bounded():
    """What a scan holds follows the piece, not the batch: ten times the rows in a batch, and one record of the same size, need no more."""

    def peak(values):
        def batches():
            yield pa.RecordBatch.from_pydict({"file": ["f"] * len(values), "at": [0] * len(values), "value": values})

        tracemalloc.start()
        rows = [r for b in corpus_file._members({("f", 0): (0, corpus_file.State())}, set())(batches()) for r in b.column("kind").to_pylist()]
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return rows.count(0), top

    def file(n, size):
        return ('{"bayesian_networks": {' + ",".join(f'"{i}": {{"t": "{"x" * size}"}}' for i in range(n)) + "}}").split("}")[:-1]

    assert peak(file(10_000, 1000))[0] == 10_000
    assert peak(file(10_000, 1000))[1] < 100 << 20
    assert peak(file(3, 4_000_000))[1] < 100 << 20


@pytest.mark.parametrize("piece", [1, 2, 7, 64])
def test_pieces_of_any_size(monkeypatch, piece):
    """Pieces end anywhere: inside names, after a backslash, between the bytes of a character."""
    monkeypatch.setattr(corpus_file, "PIECE", piece)
    what = made(random.Random(piece), 20)
    what["bayesian_networks"]["ä"] = {"short": {}, "long": "ж" * 2 * piece}
    text = json.dumps(what, ensure_ascii=False)
    rows = text.split("}")[:-1]
    batch = pa.RecordBatch.from_pydict({"file": ["f"] * len(rows), "at": [0] * len(rows), "value": rows})
    told = next(iter(corpus_file._summaries([batch])))
    assert told.column("size")[0].as_py() == len(text.encode()) and told.column("depth")[0].as_py()[0] == 0
    out = [r for b in corpus_file._members({("f", 0): (0, corpus_file.State())}, set())([batch]) for r in b.to_pylist()]
    records = [corpus_file.member(r["text"]) for r in out if r["kind"] == 0]
    assert {k: json.loads(v) for k, v in records}.items() >= what["bayesian_networks"].items()
