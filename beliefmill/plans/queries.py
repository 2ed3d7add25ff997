"""The query catalogue on the driver's tables: every operator over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from ..functions import variants as V
from ..functions.staging import shared_folder, written, written_counting
from ..operators import assemble, chunks, evaluate, evaluation_run, graph, network_records, prob, records, render
from ..operators.keyed_table import KeyedTable
from ..sources import completions, files, ledger
from ..streaming import states
from . import empirical, jobs
from .empirical import Corpus, corpus, table

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def r6(name: str = "p") -> Column:
    return N.rounded(F.col(name), 6).alias(name)


def joined(name: str, sep: str = "|") -> Column:
    return F.array_join(name, sep).alias(name)


# Probability tables


@query
def bn_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return prob.validate_marginals(c.marginal, c.node_state).select("bn_id", "node", "state_pos", "state", r6())


@query
def bn_joint_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return prob.validate_joints(c.joint, c.edges, c.node_state).select("bn_id", "parent", "child", "ps_pos", "parent_state", "state_pos", "child_state", r6())


@query
def bn_multi_joint_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return prob.validate_multi_joints(c.multi_joint, _given(c), c.node_state).select("bn_id", "child", joined("combo"), "state_pos", "state", r6())


def _families(c: Corpus) -> DataFrame:
    return prob.parent_map(c.edges)


def _given(c: Corpus) -> DataFrame:
    """The families that have a joint of all parents."""
    return _families(c).join(c.multi_joint.select("bn_id", "child").distinct(), ["bn_id", "child"], "left_semi")


@query
def bn_cpd_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    rows = prob.single_parent(c.joint, c.edges, _families(c), c.node_state)
    return prob.cells(rows, "bn_id", "child", "combo_pos", "combo").select("bn_id", "child", joined("combo"), "state_pos", "state", r6())


@query
def bn_cpd_naive_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    rows = prob.naive_bayes(c.joint, c.marginal, c.edges, _families(c).where(F.size("parents") > 1), c.node_state)
    return prob.cells(rows, "bn_id", "child", "combo_pos", "combo").select("bn_id", "child", joined("combo"), "state_pos", "state", r6())


@query
def bn_cpd_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    rows = prob.exact(c.multi_joint, _given(c), c.node_state)
    return prob.cells(rows, "bn_id", "child", "combo_pos", "combo").select("bn_id", "child", joined("combo"), "state_pos", "state", r6())


def _cpds(c: Corpus) -> DataFrame:
    return prob.all_cpds(c.marginal, c.joint, c.multi_joint, c.edges, c.node_state)


@query
def bn_cpd_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cpds(corpus(spark, sf_dir)).select("bn_id", "node", "kind", joined("combo"), "state_pos", "state", r6())


@query
def bn_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    rows = prob.priors(c.marginal, graph.roots(c.edges, c.nodes), c.node_state)
    return prob.cells(rows, "bn_id", "node").select("bn_id", "node", "state_pos", "state", r6())


@query
def bn_prior_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    rows = prob.priors(c.marginal.where("false"), graph.roots(c.edges, c.nodes), c.node_state)
    return prob.cells(rows, "bn_id", "node").select("bn_id", "node", "state_pos", "state", r6())


def _pairwise(c: Corpus, floor: float) -> DataFrame:
    return prob.pairwise_nullable(c.joint, c.edges, c.node_state, floor)


@query
def bn_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    single = _families(c).where(F.size("parents") == 1)
    rows = _pairwise(c, 0.2).join(single.select("bn_id", "child"), ["bn_id", "child"], "left_semi")
    cpds = rows.select("bn_id", F.col("child").alias("node"), F.lit("matrix").alias("kind"), F.col("ps_pos").alias("combo_pos"), F.array("parent_state").alias("combo"), "state_pos", "state", "p")
    return prob.verify(cpds, single).unionByName(prob.verify(_cpds(c), _families(c)))


@query
def bn_pairwise_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    no = c.edges.where("child = 'line status'").select("bn_id", "parent", F.lit("P").alias("parent_state"), "child", F.lit(False).alias("has_relationship"))
    return prob.pairwise_nullable(c.joint, c.edges, c.node_state, 0.01, no).select("bn_id", "parent", "child", "parent_state", "state_pos", "state", "p")


@query
def strength_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return _pairwise(c, 0.001).groupBy("bn_id", "child", N.strength(F.col("p")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query
def compact_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    cpds = _cpds(c)
    ids = records.numbered(c.bn.select("bn_id", "nk"), "nk", "compact_%05d")
    return cpds.join(ids, "bn_id").select("new_id", F.col("bn_id").alias("source_id"), "node", joined("combo"), "state", N.rounded(F.col("p"), 2).alias("p"))


def _raw_lines(spark: SparkSession, sf_dir: str) -> str:
    """The path of the empirical corpus as raw records, a JSON line each."""
    c = corpus(spark, sf_dir)
    titles = c.bn.select("bn_id", "nk", F.col("bn_id").alias("id"), F.format_string("Network \"%d\"", "nk").alias("title"), F.lit("trade").alias("domain"))
    made = network_records.raw_records(titles.drop("nk"), c).join(c.bn.select("bn_id", F.col("nk").alias("pos")), "bn_id")
    path = f"{shared_folder(spark)}/raw-records-{uuid.uuid4().hex}"
    files.write_lines(written(made, "raw-made"), path)  # else the pass that looks for ranges makes all records once more
    return path


def _table_cells(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys…, node, kind, combo, state_pos, state, p) of the tables (entry, JSON) of records."""
    schema = "node string, node_states array<string>, parents array<struct<name:string>>, prior array<double>, parent_states array<string>, matrix array<array<double>>, cpd string, derivation string"
    each = rows.withColumn("e", F.from_json("entry", schema))
    cell = lambda combo, state, i, p: F.struct(combo.alias("combo"), i.cast("int").alias("state_pos"), state.alias("state"), p.alias("p"))
    prior = F.transform("e.prior", lambda p, i: cell(F.lit(""), F.get("e.node_states", i), i, p))
    matrix = F.flatten(F.transform("e.matrix", lambda row, i: F.transform(row, lambda p, at: cell(F.get("e.parent_states", at), F.get("e.node_states", i), i, p))))
    flat = each.where("e.cpd is null").select(*keys, F.col("e.node").alias("node"), F.when(F.col("e.prior").isNull(), "matrix").otherwise("prior").alias("kind"), F.explode(F.coalesce(prior, matrix)).alias("c"))
    flat = flat.select(*keys, "node", "kind", "c.*")
    leaves = V.json_leaves(each.where("e.cpd is not null").select(*keys, F.col("e.node").alias("node"), "e.node_states", "e.parents", F.col("e.cpd").alias("cpd")), "cpd")
    pos = F.element_at("path", -1).cast("int")
    state = lambda part, p: F.substr(part, F.length(p["name"]) + 2)
    combo = F.array_join(F.zip_with(F.slice("path", F.lit(1), F.size("parents")), "parents", state), "|")
    many = leaves.select(*keys, "node", F.lit("nested").alias("kind"), combo.alias("combo"), pos.alias("state_pos"), F.get("node_states", pos).alias("state"), F.col("value").cast("double").alias("p"))
    return flat.unionByName(many)


@query
def cpd_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All networks as raw records in files, given their tables by the run from file to file, and the tables read back from its output."""
    out = f"{shared_folder(spark)}/cpd-records-{uuid.uuid4().hex}"
    jobs.cpds(spark, _raw_lines(spark, sf_dir), f"{out}/records", f"{out}/drawings")
    back = files.read_json_lines(spark, f"{out}/records", "id string, cpds array<string>, cpd_issues array<string>")
    return _table_cells(back.select(F.col("id").alias("bn_id"), F.size("cpd_issues").alias("issues"), F.explode("cpds").alias("entry")), "bn_id", "issues")


@query
def compact_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records with tables made short, as one corpus file, and its rounded tables read back."""
    out = f"{shared_folder(spark)}/compact-{uuid.uuid4().hex}"
    jobs.cpds(spark, _raw_lines(spark, sf_dir), f"{out}/records", f"{out}/drawings")
    jobs.compact(spark, f"{out}/records", f"{out}/compact")
    back = files.read_corpus(spark, f"{out}/compact", "source_id string, topological_order array<string>, cpds array<string>")
    rows = back.select("id", F.col("record.source_id").alias("source_id"), F.element_at("record.topological_order", 1).alias("first"), F.explode("record.cpds").alias("entry"))
    return _table_cells(rows, "id", "source_id", "first")


# Graphs


@query
def bn_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return graph.roots(c.edges, c.nodes).select("bn_id", "node")


@query
def bn_parent_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return prob.parent_map(c.edges).select("bn_id", "child", joined("parents"))


@query
def bn_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return graph.adjacency(c.edges, c.nodes).select("bn_id", "node", joined("children"), joined("parents"))


def _dag(c: Corpus) -> DataFrame:
    return written(graph.validate_dag(c.variant, c.nodes), "dag").hint("merge")  # names repeat: the file is far smaller than its rows


@query
def dag_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return graph.validate_dag(c.variant, c.nodes)


@query
def bn_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return graph.levels(_dag(c), c.nodes).select("bn_id", "node", "level")


@query
def wide_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of networks as wide as there are users: an edge from the lower to the higher of the users of two events of a type in a row."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("bn_id"), "event_id", F.col("user_id").cast("string").alias("node"), "user_id")
    nodes = e.groupBy("bn_id", "node").agg(F.min("user_id").cast("int").alias("node_pos"))
    after = F.lead("user_id").over(Window.partitionBy("bn_id").orderBy("event_id"))
    pairs = e.select("bn_id", "event_id", F.col("user_id").alias("a"), after.alias("b")).where("b is not null")
    edges = pairs.select("bn_id", F.col("event_id").alias("edge_pos"), F.least("a", "b").cast("string").alias("parent"), F.greatest("a", "b").cast("string").alias("child"))
    return graph.levels(graph.validate_dag(edges, nodes), nodes)


@query
def bn_topo(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return graph.topological(graph.levels(_dag(c), c.nodes))


def _subsets(c: Corpus, smallest: int = 3, largest: int = 7) -> DataFrame:
    found = graph.connected_subsets(_dag(c), c.nodes, smallest, largest)
    return found.withColumn("sub_id", F.concat("bn_id", F.lit(":"), F.array_join("members", ",")))


@query
def subgraph_enumerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subsets(corpus(spark, sf_dir)).select("bn_id", joined("members", ","), "size")


@query
def subgraph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of connected sets, none of which is written."""
    c = corpus(spark, sf_dir)
    return graph.subset_counts(_dag(c), c.nodes, 2, 7)


@query
def subgraph_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight sets a network, drawn by number: how many there are, were drawn, differ, and are connected sets of the network."""
    c = corpus(spark, sf_dir)
    dag = _dag(c)
    known, drawn = graph.connected_subsets(dag, c.nodes, 3, 7), graph.drawn_subsets(dag, c.nodes, 8, 3, 7)
    each = [df.select("bn_id", joined("members", ","), F.lit(k).alias("k"), F.lit(1 - k).alias("d")) for k, df in ((1, known), (0, drawn))]
    sets = each[0].union(each[1]).groupBy("bn_id", "members").agg(F.sum("k").alias("k"), F.sum("d").alias("d"))
    over = lambda met, n: F.sum(F.when(met, n).otherwise(0))
    return sets.groupBy("bn_id").agg(F.sum("k").alias("n_sets"), F.sum("d").alias("n_drawn"), over(F.col("d") > 0, 1).alias("n_different"), over(F.col("k") > 0, F.col("d")).alias("n_right"))


@query
def subgraph_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    need = c.bn.select("bn_id", F.array(F.lit("return flag"), F.lit("order status")).alias("members"))
    return graph.connected_subsets(_dag(c), c.nodes, 2, 5, need).select("bn_id", joined("members", ","), "size")


@query
def subgraph_induce(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return graph.induced_edges(_subsets(c), _dag(c)).select("sub_id", "edge_pos", "parent", "child")


@query
def subgraph_reroot(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return graph.reroot(_subsets(c), _dag(c), c.marginal, c.node_state).select("sub_id", "node", "state_pos", "state", r6())


@query
def subgraph_recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return graph.recompute_cpds(_subsets(c), _dag(c), c.joint, c.marginal, c.node_state).select("sub_id", "parent", "child", "parent_state", "state_pos", "state", r6())


@query
def subgraph_recompute_lacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As subgraph_recompute, where the joint of an edge is missing: its tables come from the child's marginal."""
    c = corpus(spark, sf_dir)
    joint = c.joint.where("not (parent = 'part type' and child = 'quantity band')")
    return graph.recompute_cpds(_subsets(c), _dag(c), joint, c.marginal, c.node_state).select("sub_id", "parent", "child", "parent_state", "state_pos", "state", r6())


@query
def subgraph_sample_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = records.sample_per_group(_subsets(corpus(spark, sf_dir)).select("bn_id", "sub_id"), "bn_id", "sub_id", 10)
    return records.cap_rows(picked, "sub_id", "bn_id = 'bn_00001'", 100)


# Records


def _compact(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    cust = table(spark, sf_dir, "customer")
    source = F.format_string("wiki_%05d", F.col("c_custkey"))
    compact = cust.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 7 == 0, "").otherwise(source).alias("source_id"), F.col("c_custkey").alias("pos"), F.col("c_mktsegment").alias("title"))
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    marginal = orders.where(F.col("o_custkey") % 5 != 0).select(F.format_string("wiki_%05d", F.col("o_custkey")).alias("source_id"), F.col("o_custkey").alias("pos"), "n_orders")
    texts = cust.where(F.col("c_custkey") % 3 == 0).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("generated_text"))
    return compact, marginal, texts


@query
def final_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    compact, marginal, texts = _compact(spark, sf_dir)
    return records.final_merge(compact, marginal.drop("pos"), texts).select("id", "source_id", "title", "n_orders", "generated_text")


@query
def merge_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    compact, marginal, _ = _compact(spark, sf_dir)
    return records.merge_skipped(compact, marginal).select("id", "source_id")


@query
def merge_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    compact, marginal, _ = _compact(spark, sf_dir)
    return records.positional_merge(compact, marginal).select("id", "source_id", "title", "n_orders")


@query
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")).groupBy("id").agg(F.min("status").alias("status"))
    big = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("id")).distinct()
    return records.upsert(o, o.join(big, "id").withColumn("status", F.lower("status")))


@query
def upsert_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statuses of all orders in a keyed table, into which those of orders with large lines are put in two batches."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderkey").alias("id")).agg(F.min("o_orderstatus").alias("status"))
    held = KeyedTable(spark, "id", slots=8, buckets=8).create(o)
    big = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("id")).distinct()
    new = o.join(big, "id").withColumn("status", F.lower("status"))
    held.upsert(new.where("id % 1000 < 10"))
    held.upsert(new.where("id % 1000 >= 10"))
    return held.read()


@query
def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderpriority")
    return records.not_done(o, table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("id")))


@query
def last_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.last_wins(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id"], "event_id")


@query
def domain_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.per_group_quota(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 10)


def _watched(spark: SparkSession, events: DataFrame, ask, most: int) -> DataFrame:
    """Attempts at the events of (item, event_id, value), which come as files in four parts; after each part the stream is stopped and then resumed."""
    place = f"{shared_folder(spark)}/watched-{uuid.uuid4().hex}"
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    for i in range(4):
        part = F.floor((F.col("event_id") - F.lit(low)) * 4 / F.lit((high or 0) - (low or 0) + 1)) == i
        events.where(part).write.mode("append").json(f"{place}/in")
        run = states.run_attempts(spark, f"{place}/in", "item string, event_id bigint, value double", f"{place}/out", f"{place}/checkpoint", "item", "event_id", ask, "answer double", most)
        run.awaitTermination()
    return spark.read.schema("item string, event_id bigint, attempt int, status string, error string, answer double").parquet(f"{place}/out")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.concat_ws(":", "user_id", "event_type").alias("item"), "event_id", "value")


def _never(record: dict) -> dict:
    return {"answer": record["value"]}


def _dear(record: dict) -> dict:
    if record["value"] > 20:
        raise ValueError("too dear")
    return {"answer": record["value"] * 2}


@query
def watch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each item, from a stream."""
    return _watched(spark, _events(spark, sf_dir), _never, 1).select("item", "event_id", "status")


@query
def watch_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts at each item until one succeeds or three failed, from a stream that is stopped and resumed."""
    return _watched(spark, _events(spark, sf_dir), _dear, 3)


@query
def row_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("string").alias("name"))
    places = records.numbered(c, "id", "%d", "place").withColumn("pos", F.col("place").cast("long") - 1)
    middle = places.agg((F.max("pos") / 2).cast("long").alias("m")).first()["m"]
    return records.sliced(places, "name", "pos", limit=100, offset=int(middle)).select("id", "pos")


@query
def title_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.substring_index(F.trim(F.regexp_replace("text", r"\s+", " ")), " ", 3).alias("title"))
    places = records.numbered(d.select("source").distinct().where("source is not null"), "source", "%d", "place")
    places = places.select("source", F.col("place").cast("long").alias("domain_pos"))
    found = d.join(places, "source").select(F.col("source").alias("domain"), "domain_pos", (F.col("doc_id") % 5).alias("seed_pos"), F.col("doc_id").alias("result_pos"), "title")
    return records.collected_titles(found, 20)


def _titles(spark: SparkSession, sf_dir: str, c: Corpus) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("long").alias("nation"), F.col("n_name").alias("title"), F.col("r_name").alias("domain"))
    source = F.format_string("wiki_%05d", "nk")
    met = c.bn.withColumn("nation", F.col("nk") % empirical.NATIONS).join(F.broadcast(places), "nation")  # NATIONS rows
    text = F.when(F.col("nk") % 4 == 0, "").otherwise(F.concat(F.lit("Text of "), "title"))
    return met.select("bn_id", source.alias("source_id"), "title", "domain", F.col("title").alias("actual_text"), text.alias("generated_text"))


def _final(spark: SparkSession, sf_dir: str, c: Corpus) -> DataFrame:
    valid = prob.validate_marginals(c.marginal, c.node_state).select("bn_id", "node", "state", "p")
    return assemble.final_records(_titles(spark, sf_dir, c), c.nodes, c.node_state, _dag(c), valid, c.joint)


@query
def final_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final records, flattened again to a row a cell."""
    found = written(_final(spark, sf_dir, corpus(spark, sf_dir)), "final")
    cells = assemble.flattened(found, "bn_id")
    return cells.join(found.select("bn_id", "source_id", "title", "domain", "n_nodes", "n_edges"), "bn_id").select(
        "bn_id", "source_id", "title", "domain", "n_nodes", "n_edges", "node_pos", "node", "level", "parent_pos", "parent", "ps_pos", "parent_state", "state_pos", "state", "p")


@query
def final_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs from raw record files to the file of final networks, one after another; three records in four have a text. Its cells are read back."""
    out, raw = f"{shared_folder(spark)}/final-{uuid.uuid4().hex}", _raw_lines(spark, sf_dir)
    jobs.cpds(spark, raw, f"{out}/records", f"{out}/drawings")
    jobs.compact(spark, f"{out}/records", f"{out}/compact")
    short = files.read_corpus(spark, f"{out}/compact", "source_id string").where("bn_pos % 4 <> 0")
    texts = short.select(F.col("bn_pos").alias("pos"), "id", F.concat(F.lit("Text of "), "record.source_id").alias("text"))
    files.write_corpus(texts, assemble.metadata(texts.withColumnRenamed("text", "generated_text"), source="titles"), f"{out}/texts")
    jobs.final(spark, f"{out}/compact", raw, f"{out}/texts", f"{out}/final")
    parents = "map<string, struct<parent_states: array<string>, cpd_matrix: array<array<double>>>>"
    schema = f"source_id string, title string, domain string, actual_text string, generated_text string, nodes map<string, struct<states: array<string>, level: int, parents: {parents}, prior: array<double>>>"
    back = files.read_corpus(spark, f"{out}/final", schema).select("id", "record.*")
    return assemble.flattened(back).join(back.drop("nodes", "actual_text"), "id")


@query
def subgraph_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    dag = _dag(c)
    sets = written(assemble.subgraph_ids(graph.connected_subsets(dag, c.nodes, 3, 7)), "subgraph-ids")
    valid = prob.validate_marginals(c.marginal, c.node_state).select("bn_id", "node", "state", "p")
    found = written(assemble.subgraph_records(sets, _titles(spark, sf_dir, c), c.nodes, c.node_state, dag, valid, c.joint), "subgraphs")
    cells = assemble.flattened(found)
    told = cells.groupBy("id").agg(F.count(F.when(F.col("parent").isNull(), 1)).alias("prior_rows"), F.count(F.when(F.col("parent").isNotNull(), 1)).alias("cells"),
                                   F.sum(F.floor(F.col("p") * 1e6 + 0.5)).alias("micro"), F.max("level").alias("deepest"))
    return told.join(found, "id").select("id", "parent_id", "title", "domain", "generated_text", "n_nodes", "n_edges", "deepest", "prior_rows", "cells", "micro")


@query
def corpus_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return assemble.metadata(_titles(spark, sf_dir, c), source="star schema", cpd_dp=2)


@query
def corpus_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a record of one corpus file, written and read back in the order of the file."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.format_string("doc \"%d\"", "doc_id").alias("id"), "source", F.col("text").alias("generated_text"))
    path = f"{shared_folder(spark)}/corpus-file-{uuid.uuid4().hex}"
    files.write_corpus(docs, assemble.metadata(docs, source="documents"), path)
    back = files.read_corpus(spark, path, "id string, source string, generated_text string")
    return back.select("bn_pos", "id", F.col("record.source").alias("source"), F.md5("record.generated_text").alias("text_md5"))


@query
def missing_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    records_ = _titles(spark, sf_dir, c)
    todo, done = assemble.missing_only(records_.drop("generated_text"), records_, "bn_id")
    return todo.select("bn_id", "source_id", F.lit(False).alias("done")).union(done.select("bn_id", "source_id", F.lit(True)))


@query
def final_with_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    own = c.marginal.groupBy("bn_id", "node").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("state", "p")))).alias("d"))
    own = own.groupBy("bn_id").agg(F.map_from_entries(assemble.by_place(F.collect_list(F.struct("node", "d")), "node")).alias("marginals"))
    own = own.join(c.bn.where("nk % 3 <> 0"), "bn_id").select(F.format_string("wiki_%05d", "nk").alias("source_id"), "marginals")
    met = assemble.with_marginals(_titles(spark, sf_dir, c), own)
    return met.select("bn_id", F.size("marginals").alias("n_nodes"), F.aggregate(F.map_values("marginals"), F.lit(0), lambda s, m: s + F.size(m)).alias("n_states"))


@query
def strict_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    single = _families(c).where(F.size("parents") == 1)
    rows = _pairwise(c, 0.2).join(single.select("bn_id", "child"), ["bn_id", "child"], "left_semi")
    cpds = rows.select("bn_id", F.col("child").alias("node"), F.lit("matrix").alias("kind"), F.col("ps_pos").alias("combo_pos"), F.array("parent_state").alias("combo"), "state_pos", "state", "p")
    told = records.issue_status(c.bn.select("bn_id"), prob.verify(cpds, single))
    counted = {"ok": F.col("status") == "ok", "warn": F.col("status") == "warn", "kept by strict": records.passes_strict(F.col("status"))}
    _, n = written_counting(told, "statuses", counted)
    return spark.createDataFrame([(s, v) for s, v in n.items() if v or s == "kept by strict"], "status string, n bigint")


@query
def subgraph_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of two to five nodes that hold two names, of the networks of odd nations; networks that lack an edge count too."""
    c = corpus(spark, sf_dir)
    found = graph.selected_subsets(_dag(c), c.nodes, 3, 5, ["return flag", "line status"], only=c.bn.where("nk % 2 = 1"))
    alone = graph.selected_subsets(_dag(c), c.nodes, 3, 5, ["return flag", "market segment"], only_required=True)
    small = graph.selected_subsets(_dag(c), c.nodes, 8, 9, must=c.bn.where("nk % 5 = 0"))
    parts = [p.select("bn_id", joined("members", ","), "size", F.lit(k).alias("kind")) for k, p in (("grown", found), ("alone", alone), ("must", small))]
    return parts[0].union(parts[1]).union(parts[2])


# Evaluation


def _matches(c: Corpus) -> DataFrame:
    kept = c.nodes.where("node <> 'order status'")
    own = kept.select(F.col("bn_id").alias("sg_id"), F.col("node_pos").alias("match_pos"), F.upper("node").alias("predicted"), F.col("node").alias("ground_truth"), F.lit(1).alias("score"))
    more = c.bn.select(F.col("bn_id").alias("sg_id"), F.explode(F.array(
        F.struct(F.lit(7).alias("match_pos"), F.lit("PART TYPE 2").alias("predicted"), F.lit("part type").alias("ground_truth"), F.lit(1).alias("score")),
        F.struct(F.lit(8).alias("match_pos"), F.lit("X").alias("predicted"), F.lit("market segment").alias("ground_truth"), F.lit(0).alias("score")))).alias("x")).select("sg_id", "x.*")
    return own.union(more)


def _node_metrics(c: Corpus) -> DataFrame:
    sizes = c.bn.select(F.col("bn_id").alias("sg_id"), F.lit(7).cast("long").alias("n_gt"), (F.lit(7) + F.col("nk") % 3).cast("long").alias("n_pred"))
    return evaluate.node_metrics(_matches(c), sizes)


@query
def eval_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _node_metrics(corpus(spark, sf_dir))


@query
def eval_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    even = c.even()
    gt = prob.state_lists(c.node_state).withColumnRenamed("states", "gt_states")
    seen = even.marginal.where("node <> 'order status'").groupBy("bn_id", "node").agg(F.array_sort(F.collect_set(F.lower("state"))).alias("pred_states"))
    met = gt.join(seen, ["bn_id", "node"], "left").join(c.nodes, ["bn_id", "node"]).withColumn("pred_states", F.coalesce("pred_states", F.array().cast("array<string>")))
    judged = F.when(F.col("node_pos") % 2 == 1, F.greatest(F.size("pred_states") - 1, F.lit(0)).cast("long"))
    return evaluate.state_metrics(met.select(F.col("bn_id").alias("sg_id"), "node", "gt_states", "pred_states", judged.alias("n_matched")))


def _guessed(c: Corpus) -> DataFrame:
    guess = c.variant.join(c.bn.select("bn_id", "nk"), "bn_id").where((F.col("edge_pos") + F.col("nk")) % 3 != 0)
    return guess.select(F.col("bn_id").alias("sg_id"), F.upper("parent").alias("parent"), F.upper("child").alias("child"))


def _edge_metrics(c: Corpus) -> DataFrame:
    truth, guess = _dag(c).withColumnRenamed("bn_id", "sg_id"), _guessed(c)
    names = evaluate.canonical_matches(_matches(c)).where("canonical").select("sg_id", "predicted", "ground_truth")
    return evaluate.edge_metrics(truth, guess, names)


@query
def eval_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edge_metrics(corpus(spark, sf_dir))


def _matrices(c: Corpus) -> DataFrame:
    return prob.pairwise_matrices(c.joint, c.edges, c.node_state, 0.001).withColumnRenamed("bn_id", "sg_id")


def _divergence(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    c = corpus(spark, sf_dir)
    even = c.even()
    return evaluate.matrix_divergence(_matrices(c), _matrices(even), **how)


@query
def eval_cpd_kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _divergence(spark, sf_dir).select("sg_id", "parent", "child", N.rounded(F.col("kl"), 4).alias("kl"))


@query
def eval_cpd_kl_sym(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _divergence(spark, sf_dir, predicted_dims=True, need_both=False).select("sg_id", "parent", "child", N.rounded(F.col("kl_symmetric"), 4).alias("kl_symmetric"))


def _eval_replies(c: Corpus) -> DataFrame:
    """Replies to the four passes: names in capitals, states and tables of the even orders, and each kind of failure for one network in eleven."""
    even, bn = c.even(), c.bn.select(F.col("bn_id").alias("sg_id"), "nk")
    kind = F.col("nk") % 11
    row = lambda df, step, key, raw: df.select("sg_id", F.lit(step).alias("step"), key.alias("key"), raw.alias("raw"))
    none, fence = F.lit(""), lambda x: F.concat(F.lit("Here: ```json\n"), x, F.lit("\n```"))
    names = F.array(*(F.lit(n.upper()) for n in empirical.NAMES if n != "order status"), F.lit("PART TYPE 2"))
    names = F.slice(F.concat(names, F.array(F.lit("OTHER 1"), F.lit("OTHER 2"))), F.lit(1), F.lit(7) + (F.col("nk") % 3).cast("int"))
    nodes = row(bn, "nodes", none, F.when(kind == 3, '{"nodes": []}').when(kind != 2, fence(F.to_json(F.struct(names.alias("nodes"))))))
    listed = _matches(c).groupBy("sg_id").agg(F.array_sort(F.collect_list(F.struct("match_pos", "predicted", "ground_truth", "score"))).alias("m")).join(bn, "sg_id")
    score = lambda x: F.when(kind == 5, 0).otherwise(x["score"])
    listed = F.transform("m", lambda x: F.struct(x["predicted"].alias("predicted"), x["ground_truth"].alias("ground_truth"), score(x).alias("score"))), listed
    judge = row(listed[1], "node_judge", none, F.when(kind == 4, "I can't tell.").otherwise(F.to_json(F.struct(listed[0].alias("matches")))))
    seen = even.marginal.groupBy("bn_id", "node").agg(F.array_sort(F.collect_set(F.lower("state"))).alias("s"))
    kept = c.nodes.where("node <> 'order status'").join(seen, ["bn_id", "node"], "left").withColumn("s", F.coalesce("s", F.array().cast("array<string>")))
    more = F.struct(F.lit(99).alias("node_pos"), F.lit("PART TYPE 2").alias("node"), F.array(F.lit("economy"), F.lit("extra")).alias("states"))
    one = kept.groupBy(F.col("bn_id").alias("sg_id")).agg(F.array_sort(F.collect_list(F.struct("node_pos", F.upper("node").alias("node"), F.col("s").alias("states")))).alias("n"))
    given = F.transform(F.array_append("n", more), lambda x: F.struct(x["node"].alias("node"), x["states"].alias("states")))
    states = row(one, "states", none, F.to_json(F.struct(given.alias("node_states"))))
    rest = F.transform(F.slice("s", 2, 10), lambda x: F.struct(x.alias("predicted"), x.alias("ground_truth"), F.lit(1).alias("score")))
    verdict = F.when(F.col("node_pos") % 2 == 1, F.to_json(F.struct(rest.alias("state_matches"))))
    state_judge = row(kept.withColumnRenamed("bn_id", "sg_id"), "state_judge", F.col("node"), verdict)
    guess = _guessed(c).groupBy("sg_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("parent", "child"))).alias("edges"))).alias("e"))
    edges = row(guess, "edges", none, F.col("e"))
    cpd = row(_matrices(even), "cpd", evaluation_run.edge_key("parent", "child"), F.to_json(F.struct(F.col("m").alias("matrix")), {"ignoreNullFields": "false"}))
    return written(nodes.union(judge).union(states).union(state_judge).union(edges).union(cpd), "replies")


def _eval_run(spark: SparkSession, sf_dir: str, variant: evaluation_run.Variant) -> DataFrame:
    c = corpus(spark, sf_dir)
    text = F.when(F.substring_index("bn_id", "_", -1).cast("long") % 11 == 2, "").otherwise("some text")
    subgraphs = _titles(spark, sf_dir, c).select(F.col("bn_id").alias("sg_id"), "title", "domain", text.alias("generated_text"))
    own = lambda df: df.withColumnRenamed("bn_id", "sg_id")
    nodes = own(c.nodes.join(prob.state_lists(c.node_state), ["bn_id", "node"]))
    return evaluation_run.evaluation_rows(subgraphs, nodes, own(_dag(c)).select("sg_id", "parent", "child"), _matrices(c), _eval_replies(c), variant)


@query
def eval_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _eval_run(spark, sf_dir, evaluation_run.Variant())
    return found.withColumns({m: N.rounded(F.col(m), 4) for m in ("cpd_kl", "cpd_kl_symmetric")})


@query
def eval_run_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another variant: judge's names are checked, the reverse divergence may be missing. Here that changes nothing but the path."""
    variant = evaluation_run.Variant(predicted_dims=True, need_both=False, strict_matching=True)
    return _eval_run(spark, sf_dir, variant).select("sg_id", "error", "node_f1", "edge_f1", "n_cpd_evaluated", N.rounded(F.col("cpd_kl"), 4).alias("cpd_kl"))


@query
def eval_plot_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each value of each of the thirteen metrics occurs."""
    return evaluation_run.evaluation_tables(written(_eval_run(spark, sf_dir, evaluation_run.Variant()), "results")).plots


@query
def eval_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    met = _node_metrics(c).join(_edge_metrics(c), "sg_id", "full")
    return evaluate.aggregate(met, ["node_f1", "node_recall", "edge_f1", "pct_correct_edges", "n_extra"])


@query
def eval_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.by_size(_node_metrics(corpus(spark, sf_dir)), "node_f1", "n_pred")


@query
def eval_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("n_nodes"), F.col("value"))
    return evaluate.box(e, "value")


@query
def completions_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions of all texts in two runs: the first asks for those of even ids, the second for those that the ledger lacks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("m").alias("model"), F.lit("Count.").alias("system"), F.coalesce("text", F.lit("")).alias("user"))
    path = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"

    def provider(run: int):
        return lambda model, system, user: (f'{{"run": {run}, "n": {len(user)}}}', "stop")

    ledger.complete_live(docs.where("doc_id % 2 = 0"), provider(1), path)
    found = ledger.complete_live(docs, provider(2), path)
    met = completions.replay(docs, found)
    return met.select("doc_id", "status", F.get_json_object("raw", "$.run").cast("int").alias("run"), F.get_json_object("raw", "$.n").cast("bigint").alias("n_chars"))


# Text


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("props is not null")
    kind = F.col("event_id") % 4
    raw = F.when(kind == 0, F.concat(F.lit("hi ```json\n"), "props", F.lit("\n``` bye"))).when(kind == 1, F.concat(F.lit("so {see} "), "props", F.lit(" y"))).when(kind == 2, F.col("props")).otherwise(F.lit("no json"))
    return e.select("event_id", raw.alias("raw"))


def _parsed(json: Column) -> Column:
    return F.from_json(json, "map<string,string>")["k"].try_cast("double")


@query
def json_extract_fenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _replies(spark, sf_dir).select("event_id", T.fenced_json(F.col("raw")).alias("json"))
    return e.select("event_id", "json", F.when(F.col("event_id") % 4 != 1, _parsed(F.col("json"))).alias("k"))


@query
def json_extract_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replies(spark, sf_dir).select("event_id", T.sliced_json(F.col("raw")).alias("json"))


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, l_linenumber, json): a record with fields that no schema foresees, for each line of an order."""
    double = lambda c: F.col(c).cast("double")
    text = F.concat(F.lit('{"id": '), F.col("l_orderkey"), F.lit(', "cpds": [{"p": '), (double("l_extendedprice") / 7).cast("string"), F.lit(', "deep": {"x": ['), (double("l_discount") / 3).cast("string"), F.lit(', 1, "0.12345 \\" 3.14159", '),
                    (double("l_tax") / 9).cast("string"), F.lit(']}}], "new \\\\ 0.555": {"any": '), (double("l_quantity") / 11).cast("string"), F.lit(', "n": null, "t": true}}'))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.alias("json"))


@query
def rounding_any_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nested(spark, sf_dir).select("l_orderkey", "l_linenumber", V.rounded_json(F.col("json")).alias("json"))


@query
def leaves_any_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.json_leaves(_nested(spark, sf_dir), "json")
    value = F.when(F.col("value").rlike(r"^[0-9.]+$"), N.rounded(F.col("value").try_cast("double"), 4).cast("string")).otherwise(F.col("value"))
    return found.select("l_orderkey", "l_linenumber", joined("path", "/"), value.alias("value"))


@query
def text_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.array(*(F.struct(F.lit(n).alias("node"), F.array(*map(F.lit, ss)).alias("states")) for n, ss in (("Thion", ["And", "of the"]), ("LA", ["que", "nicht"]))))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.missing_from(F.col("text"), wanted), "; ").alias("missing"))


@query
def word_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", T.word_count(F.col("text")).alias("n_words"))
    return records.articles_in_range(d, F.col("n_words"))


@query
def prompt_cpd_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return render.cpd_sections(_pairwise(c, 0.001))


@query
def svg_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return render.layout(graph.levels(_dag(c), c.nodes)).select("bn_id", "node", "x", "y", "width", "height", F.array_join(T.wrapped(T.xml_escaped(F.col("node"))), "|").alias("label"))


@query
def token_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.get_json_object("props", "$.k").cast("int") * 25).alias("cost")).where("cost is not null")
    return chunks.greedy_chunk_rows(e, "user_id", "event_id", "cost", 5000).select("user_id", "event_id", F.col("chunk").cast("int").alias("chunk"))


@query
def token_chunks_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the words of all documents of a language; one language holds most documents, and its ranges are chunked at once."""
    d = table(spark, sf_dir, "documents").select("lang", "doc_id", T.word_count(F.col("text")).alias("cost"))
    return chunks.greedy_chunk_rows(d, "lang", "doc_id", "cost", 20000)
