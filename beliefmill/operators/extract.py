"""Networks from articles: five passes over a completion source, each parsed into long tables.

`ask` takes prompts (bn_id, model, system, user) and returns them with a column raw, null where there is
no usable reply; sources.completions has a replayed and a live one. A pass that gets nothing ends the
network, as each later pass needs the earlier ones.
"""

from __future__ import annotations

from collections.abc import Callable
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import prompts as P
from ..functions import text as T
from ..functions.staging import written
from ..functions.variants import json_leaves
from . import graph, prob
from .render import cpd_sections

Ask = Callable[[DataFrame], DataFrame]


def _reply(replies: DataFrame, schema: str) -> DataFrame:
    """Replies' JSON as j; records that are parsed already bring it along."""
    if "j" in replies.columns:
        return replies.select("bn_id", "j").where("j is not null")
    parsed = F.from_json(T.fenced_json(F.col("raw")), schema)
    return replies.select("bn_id", parsed.alias("j")).where("j is not null")


def parse_nodes(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, node_state), in the reply's order; nodes without a name or states are left out, repeated names keep the first."""
    rows = _reply(replies, "nodes array<struct<name:string,states:array<string>>>").select("bn_id", F.posexplode("j.nodes").alias("pos", "n"))
    rows = rows.where("n.name is not null and size(n.states) > 0").groupBy("bn_id", F.col("n.name").alias("node")).agg(F.min(F.struct("pos", "n")).alias("m"))
    nodes = rows.select("bn_id", F.col("m.pos").alias("node_pos"), "node")
    return nodes, rows.select("bn_id", "node", F.posexplode(F.array_distinct("m.n.states")).alias("state_pos", "state"))


def parse_edges(replies: DataFrame) -> DataFrame:
    rows = _reply(replies, "edges array<struct<parent:string,child:string>>").select("bn_id", F.posexplode("j.edges").alias("edge_pos", "e"))
    return rows.select("bn_id", "edge_pos", "e.parent", "e.child").dropna()


def parse_marginals(replies: DataFrame) -> DataFrame:
    """Numbers may come as strings; what is neither is null."""
    rows = _reply(replies, "marginals map<string,map<string,string>>").select("bn_id", F.explode("j.marginals").alias("node", "d"))
    return rows.select("bn_id", "node", F.explode("d").alias("state", "v")).select("bn_id", "node", "state", F.col("v").try_cast("double").alias("p"))


def parse_joints(replies: DataFrame) -> DataFrame:
    """Of an edge that is given twice, the last table wins."""
    rows = _reply(replies, "joints array<struct<parent:string,child:string,table:map<string,map<string,string>>>>").select("bn_id", F.posexplode("j.joints").alias("pos", "t"))
    rows = rows.where("t.parent is not null and t.child is not null and t.table is not null").groupBy("bn_id", F.col("t.parent").alias("parent"), F.col("t.child").alias("child")).agg(F.max_by(F.col("t.table"), "pos").alias("table"))
    rows = rows.select("bn_id", "parent", "child", F.explode("table").alias("parent_state", "d"))
    return rows.select("bn_id", "parent", "child", "parent_state", F.explode("d").alias("child_state", "v")).withColumn("p", F.col("v").try_cast("double")).drop("v")


def parse_multi_joints(replies: DataFrame) -> DataFrame:
    """Tables nested one level a parent, keys parent=state, to rows (bn_id, child, combo, child_state, p); two or three parents."""
    rows = _reply(replies, "multi_joints array<struct<child:string,parents:array<string>,table:string>>").select("bn_id", F.explode("j.multi_joints").alias("t"))
    rows = rows.where("t.child is not null and size(t.parents) between 2 and 3").select("bn_id", F.col("t.child").alias("child"), F.col("t.parents").alias("parents"), F.col("t.table").alias("left"))
    leaves = json_leaves(rows, "left").where(F.size("path") == F.size("parents") + 1)
    names = F.slice("path", F.lit(1), F.size("parents"))
    prefix = F.transform("parents", lambda x: F.concat(x, F.lit("=")))
    fits = F.forall(F.zip_with(names, prefix, lambda n, p: F.startswith(n, p)), lambda x: x)
    combo = F.zip_with(names, prefix, lambda n, p: F.substr(n, F.length(p) + 1))
    return leaves.where(fits).select("bn_id", "child", combo.alias("combo"), F.element_at("path", -1).alias("child_state"), F.col("value").try_cast("double").alias("p"))


def edge_chunks(edges: DataFrame, size: int = 10) -> DataFrame:
    """Edges with the chunk that their request is in."""
    order = F.row_number().over(Window.partitionBy("bn_id").orderBy("edge_pos")) - 1
    return edges.withColumn("chunk", F.floor(order / size))


def _asker(ask: Ask, model: str) -> Callable[[str, DataFrame], DataFrame]:
    def asked(step: str, prompts: DataFrame) -> DataFrame:
        rows = prompts.select("bn_id", F.lit(model).alias("model"), P.system("extract", step).alias("system"), "user")
        return written(ask(rows), f"replies-{step}")

    return asked


def family_chunks(families: DataFrame, node_state: DataFrame, targets: DataFrame | None = None, budget: int = 5000, leaf: int = 25) -> DataFrame:
    """(bn_id, chunk, families, n_combos): families of two or three parents, in the children's order, in chunks of at most `budget` reply tokens.

    A family costs `leaf` tokens a combination of all its states; families is an array of structs
    (child, child_states, parents, parent_states). targets (bn_id, child): only these.
    """
    lists = prob.state_lists(node_state)
    some = families.where(F.size("parents").between(2, 3))
    if targets is not None:
        some = some.join(targets.select("bn_id", "child").distinct(), ["bn_id", "child"], "left_semi")
    each = some.select("bn_id", "child", "parents", F.posexplode("parents").alias("pos", "node")).join(lists, ["bn_id", "node"])
    each = each.groupBy("bn_id", "child", "parents").agg(prob.ordered("pos", "states").alias("parent_states"))
    each = each.join(lists.select("bn_id", F.col("node").alias("child"), F.col("states").alias("child_states")), ["bn_id", "child"])
    combos = N.combination_count(F.transform("parent_states", lambda s: F.size(s).cast("long")))
    each = each.withColumns({"n_combos": combos, "cost": combos * F.size("child_states") * leaf})
    one = each.groupBy("bn_id").agg(F.array_sort(F.collect_list(F.struct("child", "child_states", "parents", "parent_states", "n_combos", "cost"))).alias("f"))
    rows = one.select("bn_id", F.posexplode(F.arrays_zip(F.col("f"), N.greedy_chunks(F.col("f.cost"), budget).alias("chunk"))).alias("pos", "x"))
    met = rows.groupBy("bn_id", F.col("x.chunk").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("pos", "x.f"))).alias("g"))
    shown = F.transform("g", lambda x: F.struct(*(x["f"][c].alias(c) for c in ("child", "child_states", "parents", "parent_states"))))
    return met.select("bn_id", "chunk", shown.alias("families"), F.aggregate("g", F.lit(0).cast("long"), lambda s, x: s + x["f"]["n_combos"]).alias("n_combos"))


def patch(articles: DataFrame, edges: DataFrame, node_state: DataFrame, ask: Ask, model: str, targets: DataFrame | None = None, budget: int = 5000) -> DataFrame:
    """(bn_id, child, combo, child_state, p): the validated joints of families of two or three parents, asked for in chunks.

    A network without such families, or whose replies give nothing, has no rows; it isn't an error.
    """
    families = prob.parent_map(edges)
    chunks = family_chunks(families, node_state, targets, budget)
    prompts = chunks.join(articles.select("bn_id", "text"), "bn_id").select("bn_id", P.multi_joints_prompt(F.col("text"), F.col("families"), F.col("n_combos")).alias("user"))
    found = parse_multi_joints(_asker(ask, model)("multi_joints", prompts))
    given = families.join(found.select("bn_id", "child").distinct(), ["bn_id", "child"], "left_semi")
    return prob.validate_multi_joints(found, given, node_state).select("bn_id", "child", "combo", F.col("state").alias("child_state"), "p")


def extract(articles: DataFrame, ask: Ask, model: str, chunk_size: int = 10, multi_joints: bool = True) -> SimpleNamespace:
    """articles (bn_id, text) to validated nodes, node_state, edges, marginal, joint and multi_joint tables, and outcome.

    Every pass is written before the next asks, so no plan asks twice. A network for which nodes, edges,
    marginals or joints give nothing ends there and is in none of the tables; outcome (bn_id, status)
    says which pass failed, or ok. Multi-parent joints are a further pass, whose failure costs nothing else.
    """
    asked = _asker(ask, model)
    having = lambda df: df.select("bn_id").distinct()

    nodes, states = map(lambda df: written(df, "nodes"), parse_nodes(asked("nodes", articles.select("bn_id", P.nodes_prompt(F.col("text")).alias("user")))))
    lists = prob.state_lists(states)
    listed = lists.join(nodes, ["bn_id", "node"]).groupBy("bn_id").agg(F.array_sort(F.collect_list(F.struct("node_pos", F.col("node").alias("name"), "states"))).alias("n"))
    shown = F.transform("n", lambda x: F.struct(x["name"].alias("name"), x["states"].alias("states")))
    listed = articles.join(listed.select("bn_id", shown.alias("nodes")), "bn_id")
    edges = parse_edges(asked("edges", listed.select("bn_id", P.edges_prompt(F.col("text"), F.col("nodes")).alias("user"))))
    edges = written(graph.validate_dag(edges, nodes, keep_duplicates=False), "edges")

    alive = listed.join(having(edges), "bn_id", "left_semi")
    marginal = parse_marginals(asked("marginals", alive.select("bn_id", P.marginals_prompt(F.col("text"), F.col("nodes")).alias("user"))))
    marginal = written(prob.validate_marginals(marginal, states).select("bn_id", "node", "state", "p"), "marginals")

    alive = alive.join(having(marginal), "bn_id", "left_semi")
    of = lambda end: lists.select("bn_id", F.col("node").alias(end), F.col("states").alias(f"{end}_states"))
    grids = edge_chunks(edges, chunk_size).join(of("parent"), ["bn_id", "parent"]).join(of("child"), ["bn_id", "child"])
    grids = grids.groupBy("bn_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("edge_pos", "parent", "child", "parent_states", "child_states"))).alias("g"))
    joint = parse_joints(asked("joints", grids.join(alive, "bn_id").select("bn_id", P.joints_prompt(F.col("text"), F.col("g")).alias("user"))))
    told = edges.join(joint.select("bn_id", "parent", "child").distinct(), ["bn_id", "parent", "child"], "left_semi")
    joint = written(prob.validate_joints(joint, told, states).select("bn_id", "parent", "child", "parent_state", "child_state", "p"), "joints")

    done = having(joint)
    flags = {"nodes": having(nodes), "edges": having(edges), "marginals": having(marginal), "joints": done}
    outcome, status = articles.select("bn_id"), F.lit("ok")
    for step, reached in flags.items():
        outcome = outcome.join(reached.withColumn(step, F.lit(True)), "bn_id", "left")
    for step in reversed(flags):
        status = F.when(F.col(step).isNull(), f"{step} failed").otherwise(status)
    keep = lambda df: df.join(done, "bn_id", "left_semi")
    nodes, states, edges, marginal = map(keep, (nodes, states, edges, marginal))
    multi = patch(articles, edges, states, ask, model) if multi_joints else None
    return SimpleNamespace(nodes=nodes, node_state=states, edges=edges, marginal=marginal, joint=joint, multi_joint=multi, outcome=outcome.select("bn_id", status.alias("status")))


def verbalize(prompts: DataFrame, wanted: DataFrame, ask: Ask, model: str) -> DataFrame:
    """(bn_id, generated_text, missing) of prompts (bn_id, user): the reply, or '' where there is none, and the names it lacks.

    wanted (bn_id, nodes): an array of structs (node, states) that a text should name; what it lacks is
    told, not mended.
    """
    rows = prompts.select("bn_id", F.lit(model).alias("model"), P.system("verbalize", "text").alias("system"), "user")
    told = written(ask(rows).select("bn_id", F.coalesce("raw", F.lit("")).alias("generated_text")), "verbalized")
    met = told.join(wanted, "bn_id", "left")
    return met.select("bn_id", "generated_text", T.missing_from(F.col("generated_text"), F.col("nodes")).alias("missing"))


#: Headings and remarks of the verbalization prompt, kept word for word so that models are told of networks
#: as in earlier corpora.
HEADINGS = {
    "title": "TITLE: ", "domain": "DOMAIN: ", "states": "NODES AND STATES:", "edges": "CAUSAL CONNECTIONS:", "no edges": "  (no edges — all nodes are roots)",
    "tables": "CONDITIONAL PROBABILITY TABLES:", "arrow": "  →  ", "root": "  (root — prior distribution)", "bare root": "  (root — no prior available)",
}


def verbalization_prompts(nodes: DataFrame, node_state: DataFrame, edges: DataFrame, priors: DataFrame, cpd: DataFrame, titles: DataFrame) -> DataFrame:
    """(bn_id, user): title and domain, nodes and states, connections, and probability tables, in node order.

    priors (bn_id, node, state_pos, state, p) of roots; cpd as prob.pairwise_nullable gives it; titles (bn_id, title, domain).
    """
    lists = nodes.join(prob.state_lists(node_state), ["bn_id", "node"])
    gather = lambda rows, line, *order: rows.groupBy("bn_id").agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))).alias("l")).select("bn_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("s"))
    states = gather(lists, F.concat(F.lit("  "), "node", F.lit(": ["), F.array_join("states", ", "), F.lit("]")), "node_pos").withColumnRenamed("s", "states")
    links = edges.join(nodes.select("bn_id", F.col("node").alias("child"), "node_pos"), ["bn_id", "child"])
    arrows = gather(links, F.concat(F.lit("  "), "parent", F.lit(HEADINGS["arrow"]), "child"), "node_pos", "edge_pos").withColumnRenamed("s", "arrows")
    heads = priors.groupBy("bn_id", "node").agg(F.array_sort(F.collect_list(F.struct("state_pos", T.prior_line(F.col("node"), F.col("state"), F.col("p")).alias("line")))).alias("l"))
    heads = heads.select("bn_id", "node", F.lit(-1).alias("edge_pos"), F.concat(F.lit("["), "node", F.lit("]" + HEADINGS["root"] + "\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("section"))
    bare = graph.roots(edges, nodes).join(priors.select("bn_id", "node").distinct(), ["bn_id", "node"], "left_anti")
    bare = bare.select("bn_id", "node", F.lit(-1).alias("edge_pos"), F.concat(F.lit("["), "node", F.lit("]" + HEADINGS["bare root"])).alias("section"))
    tables = cpd_sections(cpd).join(edges, ["bn_id", "parent", "child"]).select("bn_id", F.col("child").alias("node"), "edge_pos", "section")
    sections = gather(heads.unionByName(bare).unionByName(tables).join(nodes, ["bn_id", "node"]), F.concat(F.lit("\n"), "section"), "node_pos", "edge_pos").withColumnRenamed("s", "sections")
    met = titles.join(states, "bn_id", "left").join(arrows, "bn_id", "left").join(sections, "bn_id", "left")
    part = lambda c, other="": F.coalesce(F.col(c), F.lit(other))
    return met.select("bn_id", F.concat_ws("\n", F.concat(F.lit(HEADINGS["title"]), part("title")), F.concat(F.lit(HEADINGS["domain"]), part("domain")), F.lit(""), F.lit(HEADINGS["states"]), part("states"), F.lit(""), F.lit(HEADINGS["edges"]),
                                          part("arrows", HEADINGS["no edges"]), F.lit(""), F.lit(HEADINGS["tables"]), part("sections")).alias("user"))


#: The domains of the article source and the searches that each begins with.
SEEDS = {
    "economics": ["Economic crises", "Inflation", "Unemployment", "Financial crises", "Income inequality"],
    "environment": ["Effects of climate change", "Deforestation", "Natural disasters", "Air pollution", "Water scarcity"],
    "geopolitics": ["Wars by cause", "Economic sanctions", "Political crises", "Refugee crises", "Revolutions"],
    "technology": ["Effects of technology on society", "Automation", "Artificial intelligence", "Social media", "Cybersecurity"],
    "society": ["Poverty", "Public health", "Social inequality", "Crime", "Education"],
}


def domains() -> Column:
    """An array of (domain, domain_pos, seed_pos, query): the searches of the article source."""
    rows = [(d, i, j, q) for i, (d, qs) in enumerate(SEEDS.items()) for j, q in enumerate(qs)]
    return F.array(*(F.struct(F.lit(d).alias("domain"), F.lit(i).alias("domain_pos"), F.lit(j).alias("seed_pos"), F.lit(q).alias("query")) for d, i, j, q in rows))
