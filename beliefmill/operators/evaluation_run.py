"""The four passes of an evaluation, from replies to one row a subgraph.

replies (sg_id, step, key, raw): steps nodes, node_judge, states, edges have an empty key; state_judge
has the true node as key, cpd the true edge as "parent|child". A null or unreadable raw is a failed reply.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..functions import numeric as N
from ..functions import text as T
from ..functions.staging import written
from . import evaluate

MATCH = "array<struct<predicted:string,ground_truth:string,score:int>>"
METRICS = ["node_f1", "node_recall", "pct_nodes_matched", "state_f1", "state_recall", "pct_states_matched", "edge_f1", "edge_recall", "pct_correct_edges",
           "pct_spurious_edges", "cpd_kl", "cpd_kl_symmetric", "n_extra_nodes"]


@dataclass(frozen=True)
class Variant:
    """How evaluations differ: the reverse divergence's size, whether both divergences are needed, trust in the judge's names."""

    predicted_dims: bool = False
    need_both: bool = True
    strict_matching: bool = False


def edge_key(parent: str, child: str) -> Column:
    """The key of a request for an edge's table: both names as JSON, whatever they hold."""
    return F.to_json(F.array(parent, child))


def parsed(replies: DataFrame, step: str, schema: str) -> DataFrame:
    """(sg_id, key, j) of the readable replies of a step; of a repeated (sg_id, key) the one with the largest pos counts, where replies have one."""
    last = F.max_by("raw", "pos") if "pos" in replies.columns else F.max("raw")
    rows = replies.where(F.col("step") == step).groupBy("sg_id", "key").agg(last.alias("raw"))
    return rows.select("sg_id", "key", F.from_json(T.fenced_json(F.col("raw")), schema).alias("j")).where("j is not null")


def judge_matches(replies: DataFrame, step: str, field: str) -> DataFrame:
    """(sg_id, key, matches, unmatched_predicted, unmatched_ground_truth) of judge replies; lists that a reply lacks are empty."""
    rows = parsed(replies, step, f"{field} {MATCH}, unmatched_predicted array<string>, unmatched_ground_truth array<string>")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c.split(".")[-1] if isinstance(c, str) else "matches")
    return rows.select("sg_id", "key", empty(F.col(f"j.{field}"), MATCH), empty("j.unmatched_predicted", "array<string>"), empty("j.unmatched_ground_truth", "array<string>"))


def accepted(matches: DataFrame, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Strict matching: match rows whose names exist, a predicted name once only."""
    known = matches.join(predicted.select("sg_id", "predicted").distinct(), ["sg_id", "predicted"], "left_semi")
    known = known.join(truth.select("sg_id", F.col("node").alias("ground_truth")).distinct(), ["sg_id", "ground_truth"], "left_semi")
    order = Window.partitionBy("sg_id", "predicted").orderBy("match_pos")
    return known.withColumn("rn", F.row_number().over(order)).where("rn = 1").select(*matches.columns)


def merged_states(named: DataFrame, states: DataFrame) -> DataFrame:
    """(sg_id, node, predicted, pred_states): a canonical prediction's states, then those of the extras of its node, each once, with None.

    named (sg_id, match_pos, predicted, ground_truth, canonical); states (sg_id, predicted, states).
    """
    met = named.join(states, ["sg_id", "predicted"], "left")
    order = F.array_sort(F.collect_list(F.struct((~F.col("canonical")).alias("extra"), "match_pos", "predicted", F.coalesce("states", F.array().cast("array<string>")).alias("states"))))
    one = met.groupBy("sg_id", F.col("ground_truth").alias("node")).agg(order.alias("m"))
    every = F.array_distinct(F.flatten(F.transform("m", lambda x: x["states"])))
    full = F.when(F.size("m") > 1, T.with_none(every)).otherwise(every)
    return one.select("sg_id", "node", F.col("m")[0]["predicted"].alias("predicted"), full.alias("pred_states"))


def evaluation_rows(subgraphs: DataFrame, nodes: DataFrame, edges: DataFrame, tables: DataFrame, replies: DataFrame, variant: Variant = Variant()) -> DataFrame:
    """One row a subgraph: error, sizes, and the metrics of nodes, states, edges and tables, null where a pass wasn't reached.

    subgraphs (sg_id, title, domain, generated_text); nodes (sg_id, node_pos, node, states); edges
    (sg_id, parent, child); tables (sg_id, parent, child, m) with child states as rows. Errors:
    no_generated_text, pass1_failed, no_nodes_extracted, node_judge_failed, no_node_matches (which keeps
    the node metrics). A malformed reply is a failed one; no row ends the run.
    """
    truth = nodes.groupBy("sg_id").agg(F.count(F.lit(1)).alias("n_gt"), F.sum(F.size("states")).cast("long").alias("n_total_states"))
    n_edges = edges.distinct().groupBy("sg_id").agg(F.count(F.lit(1)).alias("n_edges"))
    asked = parsed(replies, "nodes", "nodes array<string>").select("sg_id", F.coalesce("j.nodes", F.array().cast("array<string>")).alias("names"))
    judged = judge_matches(replies, "node_judge", "matches").select("sg_id", "matches")
    base = subgraphs.join(truth, "sg_id", "left").join(n_edges, "sg_id", "left").join(asked, "sg_id", "left").join(judged, "sg_id", "left")
    error = F.when(F.coalesce(F.col("generated_text"), F.lit("")) == "", "no_generated_text").when(F.col("names").isNull(), "pass1_failed").when(
        F.size("names") == 0, "no_nodes_extracted").when(F.col("matches").isNull(), "node_judge_failed")
    base = written(base.withColumn("error", error), "evaluated")
    alive = base.where("error is null")

    matches = alive.select("sg_id", F.posexplode("matches").alias("match_pos", "x")).select("sg_id", "match_pos", "x.*")
    if variant.strict_matching:
        matches = accepted(matches, alive.select("sg_id", F.explode("names").alias("predicted")), nodes)
    named = written(evaluate.canonical_matches(matches).select("sg_id", "match_pos", "predicted", "ground_truth", "canonical"), "matched")
    node_rows = evaluate.node_metrics(matches, alive.select("sg_id", F.coalesce("n_gt", F.lit(0)).cast("long").alias("n_gt"), F.size("names").cast("long").alias("n_pred")))
    reached = named.select("sg_id").distinct()

    found = parsed(replies, "states", "node_states array<struct<node:string,states:array<string>>>").select("sg_id", F.posexplode("j.node_states").alias("pos", "s"))
    found = found.where("s.node is not null").groupBy("sg_id", F.col("s.node").alias("predicted")).agg(F.max_by(F.coalesce("s.states", F.array().cast("array<string>")), "pos").alias("states"))
    predicted = written(merged_states(named, found.withColumn("states", T.with_none(F.col("states")))), "predicted-states")
    verdicts = judge_matches(replies, "state_judge", "state_matches")
    valid = F.size(F.filter("matches", lambda x: (x["score"] > 0) & x["predicted"].isNotNull() & x["ground_truth"].isNotNull())).cast("long")
    verdicts = verdicts.select("sg_id", F.col("key").alias("node"), valid.alias("n_matched"))
    lists = predicted.join(nodes.select("sg_id", "node", F.col("states").alias("gt_states")), ["sg_id", "node"], "left").join(verdicts, ["sg_id", "node"], "left")
    state_rows = evaluate.state_metrics(lists.where("gt_states is not null").select("sg_id", "node", "gt_states", "pred_states", "n_matched"))

    guesses = parsed(replies, "edges", "edges array<struct<parent:string,child:string>>").select("sg_id", F.explode("j.edges").alias("e")).select("sg_id", "e.parent", "e.child")
    names = named.where("canonical").select("sg_id", "predicted", "ground_truth")
    own = edges.join(reached, "sg_id", "left_semi")
    edge_rows = evaluate.edge_metrics(own, guesses, names)
    correct = own.select("sg_id", "parent", "child").distinct().join(evaluate.mapped_edges(guesses, names), ["sg_id", "parent", "child"])

    of = lambda end: lists.select("sg_id", F.col("node").alias(end), F.size("pred_states").alias(f"n_{end}"), F.size("gt_states").alias(f"t_{end}"))
    matrix = parsed(replies, "cpd", "matrix array<array<double>>").select("sg_id", "key", F.col("j.matrix").alias("q"))
    met = correct.join(tables.where(F.size("m") > 0), ["sg_id", "parent", "child"]).join(of("parent"), ["sg_id", "parent"]).join(of("child"), ["sg_id", "child"])
    met = met.where("n_parent > 0 and n_child > 0").withColumn("key", edge_key("parent", "child")).join(matrix, ["sg_id", "key"])
    table_rows = evaluate.table_divergence(met, variant.predicted_dims, variant.need_both)

    kept = base.select("sg_id", "title", "domain", "n_gt", F.coalesce("n_edges", F.lit(0).cast("long")).alias("n_edges"), "n_total_states", "error")
    out = kept.withColumnRenamed("n_gt", "n_nodes").join(node_rows, "sg_id", "left").join(state_rows, "sg_id", "left").join(edge_rows, "sg_id", "left").join(table_rows, "sg_id", "left")
    out = out.join(reached.withColumn("reached", F.lit(True)), "sg_id", "left")
    out = out.withColumn("error", F.when(F.col("error").isNull() & F.col("reached").isNull(), "no_node_matches").otherwise(F.col("error")))
    zero = {c: F.when(F.col("reached"), F.coalesce(c, F.lit(0))).otherwise(F.col(c)) for c in edge_rows.columns if c != "sg_id"}
    out = out.withColumns(zero).drop("reached").withColumnsRenamed({"n_extra": "n_extra_nodes", "n_matched": "n_matched_nodes", "n_pred": "n_pred_nodes", "n_gt": "n_gt_nodes"})
    return out.drop("n_pred_eff")


def evaluation_tables(results: DataFrame) -> SimpleNamespace:
    """results, their aggregate over METRICS, and how often a size has a value, of each metric: what files and plots show."""
    stacked = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in METRICS))
    values = results.select("n_nodes", F.inline(stacked)).where("n_nodes is not null and value is not null")
    plots = values.groupBy("metric", "n_nodes", N.rounded(F.col("value"), 4).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return SimpleNamespace(results=results, aggregate=evaluate.aggregate(results, METRICS), plots=plots)


def run_passes(subgraphs: DataFrame, nodes: DataFrame, edges: DataFrame, ask: Callable[[DataFrame], DataFrame], model: str, judge: str, wording: str = "meaning") -> DataFrame:
    """The replies of all passes over subgraphs with a text, each pass asked after the earlier ones are written.

    ask takes prompts (sg_id, step, key, model, system, user) and returns them with raw. The states of
    all matched names are asked for at once, the judge is asked once a node, tables once a correct edge.
    """

    def asked(step: str, rows: DataFrame, system: Column, who: str) -> DataFrame:
        prompts = rows.select("sg_id", F.lit(step).alias("step"), "key", F.lit(who).alias("model"), system.alias("system"), "user")
        return written(ask(prompts).select("sg_id", "step", "key", "raw"), f"asked-{step.replace('_', '-')}")

    none = F.lit("").alias("key")
    texts = subgraphs.where(F.coalesce("generated_text", F.lit("")) != "").select("sg_id", F.col("generated_text").alias("text"))
    recover = lambda step, given: P.recover_prompt(F.col("text"), step, given).alias("user")
    system = lambda step: P.system("evaluate", step)
    replies = asked("nodes", texts.select("sg_id", none, recover("nodes", F.lit("[]"))), system("nodes"), model)
    pred = parsed(replies, "nodes", "nodes array<string>").select("sg_id", F.col("j.nodes").alias("pred")).where(F.size("pred") > 0)
    true = nodes.groupBy("sg_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("node_pos", "node"))), lambda x: x["node"]).alias("true"))
    ruling = P.system("judge", wording)
    replies = replies.union(asked("node_judge", pred.join(true, "sg_id").select("sg_id", none, P.judge_prompt(F.col("pred"), F.col("true")).alias("user")), ruling, judge))
    matches = judge_matches(replies, "node_judge", "matches").select("sg_id", F.posexplode("matches").alias("match_pos", "x")).select("sg_id", "match_pos", "x.*")
    named = written(evaluate.canonical_matches(matches), "named")
    every = named.groupBy("sg_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("match_pos", "predicted"))), lambda x: x["predicted"]).alias("names"))
    replies = replies.union(asked("states", texts.join(every, "sg_id").select("sg_id", none, recover("states", F.to_json("names"))), system("states"), model))
    found = parsed(replies, "states", "node_states array<struct<node:string,states:array<string>>>").select("sg_id", F.explode("j.node_states").alias("s"))
    found = found.groupBy("sg_id", F.col("s.node").alias("predicted")).agg(T.with_none(F.coalesce(F.first("s.states"), F.array().cast("array<string>"))).alias("states"))
    lists = written(merged_states(named.select("sg_id", "match_pos", "predicted", "ground_truth", "canonical"), found), "listed")
    per_node = lists.where(F.size("pred_states") > 0).join(nodes.select("sg_id", "node", "states"), ["sg_id", "node"])
    per_node = per_node.select("sg_id", F.col("node").alias("key"), P.judge_prompt(F.col("pred_states"), F.col("states"), "state_matches").alias("user"))
    replies = replies.union(asked("state_judge", per_node, ruling, judge))
    given = lists.groupBy("sg_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("predicted").alias("node"), T.with_none(F.col("pred_states")).alias("states"))))).alias("given"))
    replies = replies.union(asked("edges", texts.join(given, "sg_id").select("sg_id", none, recover("edges", F.col("given"))), system("edges"), model))
    guesses = parsed(replies, "edges", "edges array<struct<parent:string,child:string>>").select("sg_id", F.explode("j.edges").alias("e")).select("sg_id", "e.*")
    correct = edges.distinct().join(evaluate.mapped_edges(guesses, named.where("canonical")), ["sg_id", "parent", "child"])
    end = lambda c: lists.select("sg_id", F.col("node").alias(c), F.struct(F.col("predicted").alias("node"), F.col("pred_states").alias("states")).alias(f"of_{c}"))
    met = correct.join(end("parent"), ["sg_id", "parent"]).join(end("child"), ["sg_id", "child"]).join(texts, "sg_id")
    per_edge = met.select("sg_id", edge_key("parent", "child").alias("key"), recover("cpd", F.to_json(F.array("of_parent", "of_child"))))
    return replies.union(asked("cpd", per_edge, system("cpd"), model))
