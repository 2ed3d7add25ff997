"""Golden cases and invariants of the network operators."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from beliefmill.functions import numeric as N
from beliefmill.functions import text as T
from beliefmill.operators import evaluate, graph, prob, records, render
from beliefmill.sources import completions, files
from beliefmill.streaming.watch import watch


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def arr(*xs):
    return F.array(*(F.lit(x).cast("double") for x in xs))


def near(got, want):
    assert [None if x is None else pytest.approx(x, abs=1.1e-6) for x in want] == list(got)


@pytest.mark.parametrize("f, xs, want", [
    (N.conditional_row, (0.2, 0.1, 0), (0.666667, 0.333333, 0)),
    (N.conditional_row, (0.1, 0.1, 0.1), (0.333334, 0.333333, 0.333333)),
    (N.conditional_row, (0.0004, 0.0005), (0.5, 0.5)),
    (N.conditional_row, (0, 0, 0), (0.333333, 0.333333, 0.333333)),
    (lambda a: N.nullable_row(a, 0.01), (0.995, 0.005), (0.995, None)),
    (lambda a: N.nullable_row(a, 0.001), (0.995, 0.005), (0.995, 0.005)),
    (lambda a: N.nullable_row(a, 0.01), (0, 0), (None, None)),
    (lambda a: N.nullable_row(a, 0.01, False), (0.5, 0.5), (None, None)),
    (N.prior_row, (0.35, 0.4, 0.25), (0.35, 0.4, 0.25)),
    (N.prior_row, (0.6, 0.4, None), (0.599401, 0.3996, 0.000999)),
    (N.exact_row, (0.03, 0.01), (0.75, 0.25)),
    (N.exact_row, (0.0004, 0.0001), (0.5, 0.5)),
    (N.validated_marginal, (0.5, 0.7), (0.416667, 0.583333)),
    (N.validated_marginal, (0.50, 0.51), (0.50, 0.51)),
])
def test_rows(spark, f, xs, want):
    near(one(spark, f(arr(*xs)))[0], want)


def test_naive_bayes_row(spark):
    near(one(spark, N.naive_bayes_row(F.array(arr(0.8, 0.2), arr(0.6, 0.4)), arr(0.5, 0.5)))[0], (0.857143, 0.142857))


@pytest.mark.parametrize("p, q, want", [((1, 0), (0.5, 0.5), 0.693147), ((0.7, 0.3), (0.3, 0.7), 0.338918), ((0.5, 0.5), (1, 0), 6.21461), ((0, 0), (0.5, 0.5), 0), ((0.4, 0.6), (0.4, 0.6), 0)])
def test_kl(spark, p, q, want):
    assert one(spark, N.kl(arr(*p), arr(*q)))[0] == pytest.approx(want, abs=2e-5)


def test_scalars(spark):
    prf = [tuple(one(spark, *N.precision_recall_f1(*map(F.lit, x)))) for x in ((2, 3, 4), (1, 2, 2), (0, 3, 4), (0, 0, 0))]
    assert prf == [(0.5714, 0.5, 0.6667), (0.5, 0.5, 0.5), (0, 0, 0), (0, 0, 0)]
    assert one(spark, *(N.joint_budget(F.lit(n)) for n in (1, 5, 20))) == (2000, 3200, 8000)
    assert one(spark, *(N.strength(F.lit(x).cast("double")) for x in (0.7, 0.4, 0.1, 0.0999, None))) == ("strong", "moderate", "weak", "rare", "unknown")
    assert one(spark, N.greedy_chunks(F.array(*map(F.lit, (3, 2, 4, 1, 5))), 5))[0] == [0, 0, 1, 1, 2]
    assert one(spark, N.combinations(F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("x"), F.lit("y")))))[0] == [["a", "x"], ["a", "y"], ["b", "x"], ["b", "y"]]


def test_text(spark):
    assert one(spark, T.wrapped(F.lit("financial system weakness index")))[0] == ["financial system", "weakness index"]
    raws = ['hi ```json{"a":1}``` bye', 'x {"a":1} y', "no json", "{", None]
    assert one(spark, *(T.fenced_json(F.lit(r).cast("string")) for r in raws)) == ('{"a":1}', '{"a":1}', None, None, None)
    assert one(spark, *(T.word_count(F.lit(x)) for x in ("", "  ", " a  b\nc "))) == (0, 0, 3)
    assert one(spark, T.with_none(F.array(F.lit("x"), F.lit("NONE"))), T.with_none(F.array(F.lit("x")))) == (["x", "NONE"], ["x", "None"])
    nodes = F.array(F.struct(F.lit("Rate").alias("node"), F.array(F.lit("low"), F.lit("high")).alias("states")))
    assert one(spark, T.missing_from(F.lit("the RATE is High"), nodes))[0] == ["STATE: Rate=low"]


def edges(spark, pairs, bn="b"):
    return spark.createDataFrame([(bn, i, a, b) for i, (a, b) in enumerate(pairs)], "bn_id string, edge_pos int, parent string, child string")


def nodes(spark, names, bn="b"):
    return spark.createDataFrame([(bn, i, n) for i, n in enumerate(names)], "bn_id string, node_pos int, node string")


def test_greedy_dag(spark):
    got = graph.validate_dag(edges(spark, ["ab", "bc", "ca", "ac", "cc", "cd", "db", "ab", "ax"]), nodes(spark, "abcd")).orderBy("edge_pos").collect()
    assert [r.parent + r.child for r in got] == ["ab", "bc", "ac", "cd", "ab"]
    assert graph.validate_dag(edges(spark, ["ab", "ab"]), nodes(spark, "ab"), keep_duplicates=False).count() == 1


def test_random_dags_are_acyclic_with_rising_levels(spark):
    rng = random.Random(3)
    es, ns = [], []
    for g in range(20):
        names = "abcdefg"
        ns += [(f"g{g}", i, n) for i, n in enumerate(names)]
        es += [(f"g{g}", i, rng.choice(names), rng.choice(names)) for i in range(12)]
    e, n = spark.createDataFrame(es, "bn_id string, edge_pos int, parent string, child string"), spark.createDataFrame(ns, "bn_id string, node_pos int, node string")
    kept = graph.validate_dag(e, n)
    level = {(r.bn_id, r.node): r.level for r in graph.levels(kept, n).collect()}
    rows = kept.collect()
    assert len(level) == len(ns) and all(level[r.bn_id, r.parent] < level[r.bn_id, r.child] for r in rows)
    again = graph.validate_dag(kept, n)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


@pytest.mark.parametrize("pairs, names, want", [
    (["ab", "bc"], "abc", {2: 2, 3: 1}), (["ab", "bc", "ac"], "abc", {2: 3, 3: 1}), (["ab", "ac", "ad"], "abcd", {2: 3, 3: 3, 4: 1}),
    (["01", "02", "13", "23", "34", "15", "46"], "0123456", {2: 7, 3: 9, 4: 10, 5: 8, 6: 4, 7: 1}),
])
def test_connected_subsets(spark, pairs, names, want):
    rows = graph.connected_subsets(edges(spark, pairs), nodes(spark, names), 2, 7).collect()
    assert {k: len(list(g)) for k, g in itertools.groupby(sorted(r.size for r in rows))} == want
    assert len({tuple(r.members) for r in rows}) == len(rows)


def test_subset_with_required_nodes(spark):
    need = spark.createDataFrame([("b", ["c", "a"])], "bn_id string, members array<string>")
    got = graph.connected_subsets(edges(spark, ["ab", "bc", "cd"]), nodes(spark, "abcd"), 2, 3, need)
    assert {tuple(r.members) for r in got.collect()} == {("a", "c"), ("a", "b", "c"), ("a", "c", "d")}


def test_cut_child_gets_its_marginal(spark):
    states = spark.createDataFrame([("b", n, i, s) for n in "abc" for i, s in enumerate("xy")], "bn_id string, node string, state_pos int, state string")
    marginal = spark.createDataFrame([("b", "c", "x", 0.6), ("b", "c", "y", 0.4)], "bn_id string, node string, state string, p double")
    subs = spark.createDataFrame([("s", "b", ["c"]), ("t", "b", ["a", "c"])], "sub_id string, bn_id string, members array<string>")
    e = edges(spark, ["ac", "bc"])
    got = [(r.sub_id, r.node, r.state, r.p) for r in graph.reroot(subs, e, marginal, states).orderBy("state_pos").collect()]
    assert got == [("s", "c", "x", 0.6), ("s", "c", "y", 0.4)]
    joint = spark.createDataFrame([], "bn_id string, parent string, child string, parent_state string, child_state string, p double")
    cpd = graph.recompute_cpds(subs, e, joint, marginal, states).orderBy("ps_pos", "state_pos").collect()
    assert [(r.sub_id, r.parent, r.p) for r in cpd] == [("t", "a", 0.6), ("t", "a", 0.4)] * 2


def test_joint_grid(spark):
    states = spark.createDataFrame([("b", "p", 0, "u")] + [("b", "c", i, s) for i, s in enumerate("xy")], "bn_id string, node string, state_pos int, state string")
    joint = spark.createDataFrame([("b", "p", "c", "u", "x", 0.5), ("b", "p", "c", "u", "y", 0.0)], "bn_id string, parent string, child string, parent_state string, child_state string, p double")
    got = prob.validate_joints(joint, edges(spark, ["pc"]), states).orderBy("state_pos").collect()
    assert [r.p for r in got] == [0.9998, 0.0002]


def test_matching_keeps_the_first(spark):
    m = spark.createDataFrame([("s", 0, "p1", "g1", 1), ("s", 1, "p2", "g1", 1), ("s", 2, "p3", "g2", 1), ("s", 3, "p4", None, 1), ("s", 4, "p5", "g2", 0)], "sg_id string, match_pos int, predicted string, ground_truth string, score int")
    r = evaluate.node_metrics(m, spark.createDataFrame([("s", 2, 3)], "sg_id string, n_gt bigint, n_pred bigint")).first()
    assert (r.n_matched, r.n_extra, r.n_pred_eff, r.node_f1) == (2, 1, 2, 1.0)


def test_edge_pass_ignores_unmapped_ends(spark):
    s = "sg_id string, parent string, child string"
    names = spark.createDataFrame([("s", x.lower(), x) for x in "ABC"], "sg_id string, predicted string, ground_truth string")
    r = evaluate.edge_metrics(spark.createDataFrame([("s", "A", "B"), ("s", "B", "C")], s), spark.createDataFrame([("s", "a", "b"), ("s", "a", "c"), ("s", "a", "z")], s), names).first()
    assert (r.edge_f1, r.pct_correct_edges, r.pct_spurious_edges, r.n_spurious_edges) == (0.5, 50.0, 50.0, 1)


def test_population_deviation(spark):
    r = evaluate.aggregate(spark.createDataFrame([(0.85,), (0.9,), (0.8,), (None,)], "x double"), ["x"]).first()
    assert tuple(r) == (4, 0.85, 0.0408)


def test_verify_names_the_issue(spark):
    cpds = spark.createDataFrame([("b", "n", "prior", 0, [], 0, 0.5), ("b", "n", "prior", 0, [], 1, 0.4), ("b", "m", "exact", 0, ["x", "y"], 0, 0.9)], "bn_id string, node string, kind string, combo_pos int, combo array<string>, state_pos int, p double")
    families = spark.createDataFrame([("b", "m", ["a", "c"])], "bn_id string, child string, parents array<string>")
    assert {r.issue for r in prob.verify(cpds, families).collect()} == {"n prior sums to 0.9000", "m|a=x c=y row sums to 0.9000"}


def test_records(spark):
    rows = spark.createDataFrame([("a", i, i % 3 == 0) for i in range(10)] + [("b", 20, False)], "g string, k int, must boolean").withColumn("key", F.col("k").cast("string"))
    assert records.sample_per_group(rows, "g", "key", 4).groupBy("g").count().orderBy("g").collect() == [("a", 4), ("b", 1)]
    assert records.cap_rows(rows, "key", "must", 6).where("must").count() == 4 and records.cap_rows(rows, "key", "must", 6).count() == 6
    assert records.cap_rows(rows, "key", "must", 2).count() == 4
    ids = records.numbered(rows.repartition(4), "k").orderBy("k").collect()
    assert [r.new_id for r in ids] == [f"bn_{i:05d}" for i in range(1, 12)]


def test_drawing(spark):
    n, e = nodes(spark, ["a<b", "c"]), edges(spark, [("a<b", "c")])
    svg = render.drawings(graph.levels(e, n), e, spark.createDataFrame([("b", None, "id1")], "bn_id string, title string, id string")).first().svg
    assert svg.startswith("<svg") and "a&lt;b" in svg and "id1" in svg and svg.count("<rect") == 2 and svg.count("<line") == 1 and "orange" in svg


def test_corpus_file_keeps_order(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"metadata": {"total": 2}, "bayesian_networks": {"z": {"title": "Z"}, "a": {"title": None}}}))
    got = files.read_corpus(spark, str(tmp_path / "c.json"), "title string").orderBy("bn_pos").collect()
    assert [(r.id, r.record.title) for r in got] == [("z", "Z"), ("a", None)]
    df = spark.createDataFrame([("a", None), ("b", 0.5)], "id string, p double")
    assert {r.json for r in files.corpus_json(df).collect()} == {'{"id":"a","p":null}', '{"id":"b","p":0.5}'}
    files.write_csv(df, str(tmp_path / "csv"), ["id", "missing"])
    assert sorted(spark.read.option("header", True).csv(str(tmp_path / "csv")).columns) == ["id", "missing"]
    files.write_json_lines(df, str(tmp_path / "j"))
    assert files.read_json_lines(spark, str(tmp_path / "j"), "id string, p double").count() == 2


def test_completions(spark):
    prompts = spark.createDataFrame([("m", "s", u) for u in ("good", "good", "limit", "cut")], "model string, system string, user string")

    def call(model, system, user):
        if user == "limit":
            raise RuntimeError("429 rate")
        return "{}", "max_tokens" if user == "cut" else "end"

    done = completions.complete(prompts, call, completions.Retry(attempts=2), sleep=lambda s: None)
    got = sorted((r.user, r.status, r.raw) for r in completions.replay(prompts, done).collect())
    assert got == [("cut", "truncated", None), ("good", "ok", "{}"), ("good", "ok", "{}"), ("limit", "failed", None)]
    assert completions.Retry().wait("HTTP 429") == 60.0 and completions.Retry().wait("boom") == 2.0


def test_watch_processes_each_id_once(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    work = lambda df: df.withColumn("error", F.when(F.col("id") == "b", "failed"))
    put = lambda name, ids: (tmp_path / "in" / name).write_text("\n".join(json.dumps({"id": i}) for i in ids))
    (tmp_path / "in").mkdir()
    put("1.json", ["a", "b", "a"])
    watch(spark, src, "id string", work, out, check).awaitTermination(60)
    put("2.json", ["b", "c"])
    watch(spark, src, "id string", work, out, check).awaitTermination(60)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
    put("3.json", ["b", "d"])
    watch(spark, src, "id string", work, out, check, retry_errors=True).awaitTermination(60)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["a", "b", "b", "c", "d"]


REPLIES = {
    "nodes": 'ok ```json {"nodes": [{"name": "A", "states": ["x", "none"]}, {"name": "B", "states": ["x", "none"]}, {"name": "C", "states": ["u", "v"]}, {"states": ["x"]}]} ```',
    "edges": '{"edges": [{"parent": "A", "child": "C"}, {"parent": "B", "child": "C"}, {"parent": "C", "child": "A"}, {"parent": "A", "child": "Z"}]}',
    "marginals": '{"marginals": {"A": {"x": "0.9", "none": 0.1}, "B": {"x": "lots"}, "C": {"u": 0.5, "v": 0.5}}}',
    "joints": '{"joints": [{"parent": "A", "child": "C", "table": {"x": {"u": 0.6, "v": 0.3}, "none": {"u": 0.1}}}]}',
    "multi_joints": '{"multi_joints": [{"child": "C", "parents": ["A", "B"], "table": {"A=x": {"B=x": {"u": 0.5, "v": 0.2}}}}]}',
}


def test_extraction_passes(spark):
    from beliefmill.functions.prompts import SYSTEM
    from beliefmill.operators import extract

    told = spark.createDataFrame([(SYSTEM["extract", k], v) for k, v in REPLIES.items()], "system string, raw string")
    ask = lambda prompts: prompts.where("bn_id <> 'dead'").join(told, "system")
    got = extract.extract(spark.createDataFrame([("b", "text"), ("dead", "text")], "bn_id string, text string"), ask, "m")
    assert sorted((r.parent, r.child) for r in got.edges.collect()) == [("A", "C"), ("B", "C")]
    p = {(r.node, r.state): r.p for r in got.marginal.collect()}
    assert p["A", "x"] == 0.9 and "dead" not in {r.bn_id for r in got.nodes.collect()}
    j = {(r.parent_state, r.child_state): r.p for r in got.joint.collect()}
    assert len(j) == 4 and abs(sum(j.values()) - 1) < 1e-5
    m = {(tuple(r.combo), r.child_state): r.p for r in got.multi_joint.collect()}
    assert len(m) == 8 and max(m, key=m.get) == (("x", "x"), "u")
    kinds = {r.node: r.kind for r in prob.all_cpds(got.marginal, got.joint, got.multi_joint, got.edges, got.node_state).collect()}
    assert kinds == {"A": "prior", "B": "prior", "C": "exact"}
    cpd = prob.pairwise_nullable(got.joint, got.edges, got.node_state, 0.001)
    prior = prob.cells(prob.priors(got.marginal, graph.roots(got.edges, got.nodes), got.node_state), "bn_id", "node")
    prompt = extract.verbalization_prompts(got.nodes, got.node_state, got.edges, prior, cpd, spark.createDataFrame([("b", "T", "society")], "bn_id string, title string, domain string")).first().user
    assert prompt.startswith("TITLE: T\nDOMAIN: society\n\nNODES AND STATES:\n  A: [x, none]\n") and "  A  →  C\n  B  →  C" in prompt and "  P(A=x) = 0.9000  [strong]" in prompt and "[C | A]" in prompt


def test_extraction_ends_where_a_pass_fails(spark):
    """Each network lacks one pass; none has rows of a later one, and the others are whole."""
    from beliefmill.functions.prompts import SYSTEM
    from beliefmill.operators import extract

    steps = ["nodes", "edges", "marginals", "joints", "multi_joints"]
    rows = [(n, SYSTEM["extract", k], REPLIES[k] if k != n else "no reply") for n in ["ok", *steps] for k in steps]
    told = spark.createDataFrame(rows, "bn_id string, system string, raw string")
    articles = spark.createDataFrame([(n, "text") for n in ["ok", *steps]], "bn_id string, text string")
    got = extract.extract(articles, lambda prompts: prompts.join(told, ["bn_id", "system"]), "m")
    want = {"ok": "ok", "multi_joints": "ok", **{s: f"{s} failed" for s in steps[:4]}}
    assert {r.bn_id: r.status for r in got.outcome.collect()} == want
    for df in (got.nodes, got.node_state, got.edges, got.marginal, got.joint):
        assert {r.bn_id for r in df.select("bn_id").distinct().collect()} == {"ok", "multi_joints"}
    assert {r.bn_id for r in got.multi_joint.collect()} == {"ok"}


def test_multi_joint_requests_in_chunks(spark):
    from beliefmill.operators import extract

    states = [("b", n, i, f"{n}{i}") for n in "ABCDE" for i in range(5)]
    states = spark.createDataFrame(states, "bn_id string, node string, state_pos int, state string")
    families = spark.createDataFrame([("b", "C", ["A", "B"]), ("b", "D", ["B", "A"]), ("b", "E", ["A"])], "bn_id string, child string, parents array<string>")
    got = extract.family_chunks(families, states, budget=5000).orderBy("chunk").collect()
    assert [(r.chunk, [f.child for f in r.families], r.n_combos) for r in got] == [(0, ["C"], 25), (1, ["D"], 25)]
    assert got[1].families[0].parents == ["B", "A"] and got[1].families[0].parent_states[0][0] == "B0"
    only = extract.family_chunks(families, states, spark.createDataFrame([("b", "D")], "bn_id string, child string"))
    assert [[f.child for f in r.families] for r in only.collect()] == [["D"]]


def test_verbalizer_tells_what_is_missing(spark):
    from beliefmill.operators import extract

    prompts = spark.createDataFrame([("a", "p"), ("b", "p")], "bn_id string, user string")
    wanted = spark.createDataFrame([(i, [("Rain", ["wet", "dry"])]) for i in "ab"], "bn_id string, nodes array<struct<node:string,states:array<string>>>")
    ask = lambda p: p.withColumn("raw", F.when(F.col("bn_id") == "a", "rain makes it WET"))
    got = {r.bn_id: (r.generated_text, r.missing) for r in extract.verbalize(prompts, wanted, ask, "m").collect()}
    assert got == {"a": ("rain makes it WET", ["STATE: Rain=dry"]), "b": ("", ["NODE: Rain", "STATE: Rain=wet", "STATE: Rain=dry"])}


def test_replies_that_are_not_json_are_asked_again(spark):
    prompts = spark.createDataFrame([("m", "s", u) for u in ("late", "never")], "model string, system string, user string")
    calls: dict = {}

    def call(model, system, user):
        calls[user] = calls.get(user, 0) + 1
        return ('so {"a": 1}' if user == "late" and calls[user] == 2 else "sorry"), "end"

    got = {r.raw: r.status for r in completions.complete(prompts.coalesce(1), call, completions.Retry(attempts=2), sleep=lambda s: None).collect()}
    assert got == {'so {"a": 1}': "ok", "sorry": "failed"}
    assert [completions.SEARCH.wait("boom", i) for i in range(3)] == [5.0, 10.0, 20.0] and completions.Retry().wait(completions.BAD_REPLY) == 1.0


def test_corpus_file_round_trip(spark, tmp_path):
    from beliefmill.operators import assemble

    df = spark.createDataFrame([(i, f'bn "{i}"', None if i % 2 else "tëxt") for i in range(50)], "pos int, id string, generated_text string")
    files.write_corpus(df, assemble.metadata(df, source="x"), str(tmp_path / "c"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "c").glob("part-*")))
    found = json.loads(text)
    assert found["metadata"] == {"total": 50, "generated_total": 25, "source": "x"}
    assert list(found["bayesian_networks"]) == [f'bn "{i}"' for i in range(50)] and found["bayesian_networks"]['bn "1"'] == {"id": 'bn "1"', "generated_text": None}
    (tmp_path / "one.json").write_text(text)
    back = files.read_corpus(spark, str(tmp_path / "one.json"), "id string, generated_text string").orderBy("bn_pos").collect()
    assert [(r.id, r.record.generated_text) for r in back[:2]] == [('bn "0"', "tëxt"), ('bn "1"', None)]
    with pytest.raises(FileNotFoundError):
        files.existing(spark, str(tmp_path / "c"), str(tmp_path / "nothing"))


def test_selection_errors(spark):
    nodes = spark.createDataFrame([("n", i, x) for i, x in enumerate("abc")], "bn_id string, node_pos int, node string")
    edges = spark.createDataFrame([("n", 0, "a", "b"), ("n", 1, "b", "c")], "bn_id string, edge_pos int, parent string, child string")
    required = lambda *x: spark.createDataFrame([("n", list(x))], "bn_id string, members array<string>")
    with pytest.raises(ValueError, match="zzz"):
        graph.connected_subsets(edges, nodes, 1, 3, required("a", "zzz"))
    assert graph.selected_subsets(edges, nodes, 1, 3, ["a", "zzz"]).count() == 0
    assert [r.members for r in graph.selected_subsets(edges, nodes, 1, 3, ["c", "a"], only_required=True).collect()] == [["a", "c"]]
    assert sorted(r.members for r in graph.connected_subsets(edges, nodes, 1, 2, required("a")).collect()) == [["a"], ["a", "b"]]
    found = graph.connected_subsets(edges, nodes, 2, 3)
    assert graph.enough_subsets(found, 3).count() == 3
    with pytest.raises(ValueError, match="3 subgraphs"):
        graph.enough_subsets(found, 4)


def test_divergence_normalises_the_prediction(spark):
    matrix = lambda *x: F.array(*(F.array(F.lit(v).cast("double")) for v in x))
    got = spark.range(1).select(N.column_kl(matrix(0.5, 0.5, 0.0), matrix(0.4, None, 0.1), F.lit(3), F.lit(1)).alias("k")).first().k
    assert abs(got - 6.3262) < 5e-4


def test_evaluation_passes_ask_and_score(spark):
    from beliefmill.functions.prompts import SYSTEM
    from beliefmill.operators import evaluation_run as E

    subgraphs = spark.createDataFrame([("s", "T", "d", "a text"), ("e", "T", "d", "")], "sg_id string, title string, domain string, generated_text string")
    nodes = spark.createDataFrame([("s", 0, "A", ["x", "none"]), ("s", 1, "B", ["u", "none"]), ("e", 0, "A", ["x"])], "sg_id string, node_pos int, node string, states array<string>")
    edges = spark.createDataFrame([("s", "A", "B")], "sg_id string, parent string, child string")
    tables = spark.createDataFrame([("s", "A", "B", [[0.7, 0.2], [0.3, 0.8]])], "sg_id string, parent string, child string, m array<array<double>>")
    raws = {
        SYSTEM["evaluate", "nodes"]: '{"nodes": ["a", "a2", "b"]}', SYSTEM["evaluate", "states"]: '{"node_states": [{"node": "a", "states": ["x"]}, {"node": "a2", "states": ["x", "y"]}, {"node": "b", "states": ["u", "None"]}]}',
        SYSTEM["evaluate", "edges"]: '{"edges": [{"parent": "a", "child": "b"}, {"parent": "b", "child": "q"}]}', SYSTEM["evaluate", "cpd"]: '{"matrix": [[0.7, 0.2], [0.3, 0.8]]}',
    }
    match = '{"matches": [{"predicted": "a", "ground_truth": "A", "score": 1}, {"predicted": "a2", "ground_truth": "A", "score": 1}, {"predicted": "b", "ground_truth": "B", "score": 1}]}'
    states = '{"state_matches": [{"predicted": "x", "ground_truth": "x", "score": 1}, {"predicted": "y", "ground_truth": "none", "score": 0}]}'
    told = spark.createDataFrame([*raws.items()], "system string, given string")
    judged = F.when(F.contains("user", F.lit("state_matches")), states).when(F.contains("user", F.lit('"matches"')), match)
    ask = lambda p: p.join(told, "system", "left").withColumn("raw", F.coalesce("given", judged))
    replies = E.run_passes(subgraphs, nodes, edges, ask, "m", "judge")
    assert {r.step for r in replies.collect()} == {"nodes", "node_judge", "states", "state_judge", "edges", "cpd"}
    got = {r.sg_id: r for r in E.evaluation_rows(subgraphs, nodes, edges, tables, replies).collect()}
    s, e = got["s"], got["e"]
    assert (e.error, e.n_total_states, e.node_f1, s.error) == ("no_generated_text", 1, None, None)
    assert (s.n_matched_nodes, s.n_extra_nodes, s.node_f1, s.n_correct_edges, s.n_pred_edges, s.edge_f1, s.n_cpd_evaluated) == (2, 1, 1.0, 1, 1, 1.0, 1)
    # A: one of two states, of the three predicted x, y, None; B: one of two of two
    assert (s.state_recall, s.state_precision, s.pct_states_matched) == (0.5, 0.4167, 50.0) and abs(s.cpd_kl) < 1e-5
    assert E.evaluation_tables(E.evaluation_rows(subgraphs, nodes, edges, tables, replies)).aggregate.first().total == 2


def test_strict_matching_checks_names(spark):
    from beliefmill.operators import evaluation_run as E

    rows = [("s", i, p, g, 1) for i, (p, g) in enumerate([("a", "A"), ("a", "B"), ("ghost", "A"), ("b", "nowhere"), ("b", "B")])]
    matches = spark.createDataFrame(rows, "sg_id string, match_pos int, predicted string, ground_truth string, score int")
    pred = spark.createDataFrame([("s", "a"), ("s", "b")], "sg_id string, predicted string")
    truth = spark.createDataFrame([("s", "A"), ("s", "B")], "sg_id string, node string")
    assert sorted((r.predicted, r.ground_truth) for r in E.accepted(matches, pred, truth).collect()) == [("a", "A"), ("b", "B")]


def test_final_priors(spark):
    from beliefmill.operators import assemble

    states = spark.createDataFrame([("b", "A", 0, "x"), ("b", "A", 1, "y"), ("b", "A", 2, "none")], "bn_id string, node string, state_pos int, state string")
    marginal = spark.createDataFrame([("b", "A", "x", 0.6), ("b", "A", "y", 0.40006)], "bn_id string, node string, state string, p double")
    nodes = spark.createDataFrame([("b", "A")], "bn_id string, node string")
    assert assemble.final_prior(marginal, nodes, states).first().prior == [0.6, 0.4001, 0.3333]
    assert assemble.final_prior(marginal, nodes, states, uniform=True).first().prior == [0.3333] * 3


def test_box_is_exact_with_ties_nulls_and_single_values(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    sizes = {1: rng.integers(0, 5, 400).tolist(), 2: rng.normal(size=301).tolist(), 3: [0.5], 4: [7.0] * 50 + [1.0, 2.0]}
    rows = [(k, float(x)) for k, xs in sizes.items() for x in xs] + [(1, None), (None, 3.0)]
    got = {r.n_nodes: r for r in evaluate.box(spark.createDataFrame(rows, "n_nodes int, m double"), "m").collect()}
    assert set(got) == set(sizes)
    for k, xs in sizes.items():
        q1, mid, q3 = np.quantile(xs, [0.25, 0.5, 0.75])
        reach = 1.5 * (q3 - q1)
        low, high = min(min(x for x in xs if x >= q1 - reach), q1), max(max(x for x in xs if x <= q3 + reach), q3)
        assert got[k].n == len(xs)
        assert np.allclose([got[k].q1, got[k].median, got[k].q3, got[k].low, got[k].high], [q1, mid, q3, low, high], atol=1e-6)
    assert evaluate.box(spark.createDataFrame([], "n_nodes int, m double"), "m").count() == 0
