"""Runs from path to path, on files small enough to work out by hand."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from beliefmill.operators import network_records as R
from beliefmill.plans import jobs

A, B, C = ({"name": n, "states": s} for n, s in (("a", ["x", "y"]), ("b \"q\"", ["u", "none"]), ("c", ["1", "0"])))
NET = {
    "id": "wiki_00000", "title": "T \"one\"", "domain": "d", "extra": {"z": [1, 2.50], "a": "{\"cpds\": 1}"}, "text": "Article, with ```json {} ``` in it.",
    "nodes": [C, A, B], "edges": [{"parent": "a", "child": "c"}, {"parent": 'b "q"', "child": "c"}, {"parent": "a", "child": 'b "q"'}],
    "topological_order": ["a", 'b "q"', "c"], "marginals": {"a": {"x": 0.25, "y": 0.75}, 'b "q"': {"u": 0.5, "none": 0.5}, "c": {"1": 0.5, "0": 0.5}},
    "joints": [{"parent": "a", "child": 'b "q"', "table": {"x": {"u": 0.125, "none": 0.125}, "y": {"u": 0.375, "none": 0.375}}}],
    "multi_joints": [{"child": "c", "parents": ["a", 'b "q"'], "table": {
        "a=x": {'b "q"=u': {"1": 0.1, "0": 0.1}, 'b "q"=none': {"1": 0.05, "0": 0.15}}, "a=y": {'b "q"=u': {"1": 0.3, "0": 0.1}, 'b "q"=none': {"1": 0.1, "0": 0.1}}}}],
}
LONE = {"title": "lone", "nodes": [A], "edges": [], "marginals": {}, "cpds": "old"}
UNKNOWN = {"id": "bad", "nodes": [A], "edges": [{"parent": "a", "child": "nobody"}]}


def lines(path):
    return [json.loads(x) for f in sorted(glob.glob(f"{path}/part-*")) for x in open(f)]


def corpus(path):
    return json.loads("".join(open(f).read() for f in sorted(glob.glob(f"{path}/part-*"))))


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("jobs")
    (at / "raw.jsonl").write_text("\n".join([json.dumps(NET), "", "no json", json.dumps(LONE), json.dumps(UNKNOWN), json.dumps(LONE | {"id": "wiki_9"})]) + "\n")
    n = jobs.cpds(spark, str(at / "raw.jsonl"), str(at / "cpds"), str(at / "svgs"))
    assert n == {"ok": 3, "warn": 0, "skipped": 2}
    return at


def test_tables_are_added_and_all_else_stays(made):
    net, lone, last = lines(made / "cpds")
    assert {k: v for k, v in net.items() if k in NET} == NET
    c, a, b = net["cpds"]
    assert a == {"node": "a", "node_states": ["x", "y"], "parents": [], "prior": [0.25, 0.75]}
    assert b["parent"] == "a" and b["parent_states"] == ["x", "y"] and b["matrix"] == [[0.5, 0.5], [0.5, 0.5]] and b["derivation"] == R.DERIVATIONS["matrix"]
    assert c["cpd"] == {"a=x": {'b "q"=u': [0.5, 0.5], 'b "q"=none': [0.25, 0.75]}, "a=y": {'b "q"=u': [0.75, 0.25], 'b "q"=none': [0.5, 0.5]}}
    assert list(c["cpd"]) == ["a=x", "a=y"] and c["parents"] == [{"name": "a", "states": ["x", "y"]}, {"name": 'b "q"', "states": ["u", "none"]}]
    assert net["cpd_issues"] == [] and net["svg_path"].endswith("/wiki_00000.svg")
    assert lone["cpds"] == [{"node": "a", "node_states": ["x", "y"], "parents": [], "prior": [0.5, 0.5]}] and lone["svg_path"].endswith("/record_00002.svg") and last["id"] == "wiki_9"


def test_a_drawing_a_record(made):
    assert sorted(os.listdir(made / "svgs")) == ["record_00002.svg", "wiki_00000.svg", "wiki_9.svg"]
    assert "T &quot;one&quot;" in (made / "svgs" / "wiki_00000.svg").read_text() or 'T "one"' in (made / "svgs" / "wiki_00000.svg").read_text()


def test_short_records(spark, made):
    assert jobs.compact(spark, str(made / "cpds"), str(made / "compact")) == {"total": 3}
    found = corpus(made / "compact")
    assert found["metadata"] == {"total": 3, "source": str(made / "cpds"), "cpd_dp": 2} and list(found["bayesian_networks"]) == ["bn_00001", "bn_00002", "bn_00003"]
    net = found["bayesian_networks"]["bn_00001"]
    assert list(net) == ["id", "source_id", "title", "domain", "nodes", "edges", "topological_order", "cpds"]
    assert net["source_id"] == "wiki_00000" and net["nodes"] == NET["nodes"] and net["edges"] == NET["edges"] and net["topological_order"] == NET["topological_order"]
    assert all("derivation" not in e for e in net["cpds"]) and net["cpds"][0]["cpd"]["a=y"]['b "q"=u'] == [0.75, 0.25]
    assert found["bayesian_networks"]["bn_00002"]["source_id"] == "" and found["bayesian_networks"]["bn_00002"]["topological_order"] == []


def test_final_networks(spark, made):
    jobs.compact(spark, str(made / "cpds"), str(made / "compact2"))
    (made / "texts.json").write_text(json.dumps({"bayesian_networks": {"bn_00001": {"text": "Told."}}}))
    # bn_00002 has no source id: the raw id at its place, the second of them, is wiki_9; bn_00003 names wiki_9 itself
    n = jobs.final(spark, str(made / "compact2"), str(made / "cpds"), str(made / "texts.json"), str(made / "final"))
    assert n == {"ok": 3, "skipped": 0}
    found = corpus(made / "final")
    nets = found["bayesian_networks"]
    assert found["metadata"]["total"] == 3 and list(nets) == ["bn_00001", "bn_00002", "bn_00003"]
    one = nets["bn_00001"]
    assert one["generated_text"] == "Told." and one["actual_text"] == NET["text"] and nets["bn_00002"]["source_id"] == "wiki_9" and nets["bn_00002"]["generated_text"] == ""
    assert one["nodes"]["a"] == {"states": ["x", "y"], "level": 0, "parents": {}, "prior": [0.25, 0.75]}
    assert one["nodes"]['b "q"']["parents"]["a"] == {"parent_states": ["x", "y"], "cpd_matrix": [[0.5, 0.5], [0.5, 0.5]]}
    assert one["nodes"]["c"]["level"] == 2 and one["nodes"]["c"]["parents"]["a"]["cpd_matrix"] == [[None, None], [None, None]]


def test_strict_and_missing_files(spark, made):
    with pytest.raises(FileNotFoundError):
        jobs.compact(spark, str(made / "nowhere"), str(made / "x"))
    (made / "empty.jsonl").write_text("")
    assert jobs.cpds(spark, str(made / "empty.jsonl"), str(made / "none"), str(made / "svgs2"), strict=True) == {"ok": 0, "warn": 0, "skipped": 0}
    assert lines(made / "none") == []


def test_nested_tables_of_any_depth(spark):
    parents, lists = ["p", "q", "r"], [["1", "2"], ["1"], ["1", "2", "3"]]
    rows = [([a, b, c], [float(len(a + b + c)), 0.0]) for a in lists[0] for b in lists[1] for c in lists[2]]
    df = spark.createDataFrame([(parents, rows)], "parents array<string>, found array<struct<combo:array<string>,values:array<double>>>")
    text = df.select(R.nested(F.col("parents"), F.col("found"))).first()[0]
    assert json.loads(text) == {f"p={a}": {f"q={b}": {f"r={c}": [3.0, 0.0] for c in lists[2]} for b in lists[1]} for a in lists[0]}


def test_from_titles_to_networks(spark, tmp_path):
    """Failed articles are made up for by the domain's next titles, short ones aren't asked about, and each title is asked about once."""
    from beliefmill.functions.prompts import SYSTEM
    from test_core import REPLIES

    found = [(d, i, 0, k, f"{d} {k}") for i, d in enumerate(["late", "early"][::-1]) for k in range(5)] + [("early", 0, 0, 9, "Category:x")]
    long = "word " * 100
    articles = [(f"{d} {k}", "u", "short" if (d, k) == ("early", 0) else long) for d in ("late", "early") for k in range(5)] + [("early 1", "v", "short")]
    told = spark.createDataFrame([(SYSTEM["extract", k], v) for k, v in REPLIES.items()], "system string, raw string")
    asked = []

    def ask(prompts):
        asked.append({r.bn_id for r in prompts.select("bn_id").distinct().collect()})
        return prompts.where("bn_id not in ('early 1', 'early 2', 'late 0', 'late 1', 'late 2', 'late 3')").join(told, "system")

    found = spark.createDataFrame(found, "domain string, domain_pos int, seed_pos int, result_pos int, title string")
    n = jobs.networks(found, spark.createDataFrame(articles, "title string, url string, text string"), ask, "m", str(tmp_path / "raw"), per_domain=2)
    rows = lines(tmp_path / "raw")
    assert [(r["id"], r["domain"]) for r in rows] == [("wiki_00000", "early"), ("wiki_00001", "early"), ("wiki_00002", "late")]
    assert {r["title"] for r in rows} == {"early 3", "early 4", "late 4"} and n["written"] == 3 and n["failed"] == n["asked"] - 3
    first = asked[0]
    assert len(first) == 4 and "early 0" not in set().union(*asked)
    net = rows[0]
    assert net["real"] == 1 and net["url"] == "u" and net["text"] == long.strip() and net["n_edges"] == len(net["edges"]) == 2 and net["topological_order"] == ["A", "B", "C"]
    assert jobs.cpds(spark, str(tmp_path / "raw"), str(tmp_path / "cpds"), str(tmp_path / "svgs")) == {"ok": 3, "warn": 0, "skipped": 0}
    assert [list(e)[-2] for e in lines(tmp_path / "cpds")[0]["cpds"]] == ["parents", "parents", "cpd"]
