"""Records from long tables: final networks, subgraphs, and corpora with their metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from . import graph, prob

PARENTS = "map<string,struct<parent_states:array<string>,cpd_matrix:array<array<double>>>>"


def by_place(rows: Column, place: str) -> Column:
    """An array of structs, which may hold maps, by a field."""
    return F.array_sort(rows, lambda a, b: F.when(a[place] < b[place], -1).when(a[place] > b[place], 1).otherwise(0))


def matrices(cpd: DataFrame, *keys: str) -> DataFrame:
    """(keys…, parent, child, parent_states, cpd_matrix) of cells (…, ps_pos, parent_state, state_pos, p); rows are child states, null cells stay."""
    by = [*keys, "parent", "child"]
    rows = cpd.groupBy(*by, "state_pos").agg(prob.ordered("ps_pos", "parent_state").alias("parent_states"), prob.ordered("ps_pos", "p").alias("row"))
    return rows.groupBy(*by).agg(F.min_by("parent_states", "state_pos").alias("parent_states"), prob.ordered("state_pos", "row").alias("cpd_matrix"))


def final_prior(marginal: DataFrame, nodes: DataFrame, node_state: DataFrame, uniform: bool = False) -> DataFrame:
    """(bn_id, node, prior) of nodes: the marginal to 4 places, not shared again; 1/n where a state, or with `uniform` every one, has none."""
    rows = prob.marginal_rows(marginal, node_state).join(nodes.select("bn_id", "node"), ["bn_id", "node"], "left_semi")
    value = (lambda x: F.lit(None).cast("double")) if uniform else (lambda x: x)
    prior = F.transform("values", lambda x: N.rounded(F.coalesce(value(x), F.lit(1.0) / F.size("values")), 4))
    return rows.select("bn_id", "node", prior.alias("prior"))


def node_dict(key: str, members: DataFrame, priors: DataFrame, tables: DataFrame) -> DataFrame:
    """(key, nodes): the nodes of each record as a map, in order, of states, level, parents and prior.

    members (key, node_pos, node, level, states); priors (key, node, prior); tables (key, edge_pos,
    parent, child, parent_states, cpd_matrix). A node with parents has no prior.
    """
    entry = F.struct("edge_pos", "parent", F.struct("parent_states", "cpd_matrix").alias("value"))
    pairs = F.transform(by_place(F.collect_list(entry), "edge_pos"), lambda x: F.struct(x["parent"], x["value"]))
    parents = tables.groupBy(key, F.col("child").alias("node")).agg(F.map_from_entries(pairs).alias("parents"))
    met = members.join(parents, [key, "node"], "left").join(priors, [key, "node"], "left")
    prior = F.when(F.col("parents").isNull(), F.col("prior"))
    info = F.struct("states", "level", F.coalesce("parents", F.create_map().cast(PARENTS)).alias("parents"), prior.alias("prior"))
    found = met.groupBy(key).agg(by_place(F.collect_list(F.struct("node_pos", "node", info.alias("info"))), "node_pos").alias("n"))
    return found.select(key, F.map_from_entries(F.transform("n", lambda x: F.struct(x["node"], x["info"]))).alias("nodes"))


def sizes(nodes: Column) -> tuple[Column, Column]:
    """(n_nodes, n_edges) of a record's nodes."""
    return F.size(nodes), F.aggregate(F.map_values(nodes), F.lit(0), lambda s, x: s + F.size(x["parents"]))


def final_records(titles: DataFrame, nodes: DataFrame, node_state: DataFrame, edges: DataFrame, marginal: DataFrame, joint: DataFrame, floor: float = 0.01, uniform_prior: bool = False,
                  related: DataFrame | None = None) -> DataFrame:
    """titles (bn_id, …) with id, nodes, n_nodes and n_edges: levels, priors of roots, and a nullable matrix a parent.

    marginal: the validated one; related as in prob.pairwise_nullable. A network without a joint for an edge has a matrix of nulls there.
    """
    lists = prob.state_lists(node_state)
    members = graph.levels(edges, nodes).join(lists, ["bn_id", "node"])
    priors = final_prior(marginal, graph.roots(edges, nodes), node_state, uniform_prior)
    cells = prob.pairwise_nullable(joint, edges, node_state, floor, related)
    first = edges.groupBy("bn_id", "parent", "child").agg(F.min("edge_pos").alias("edge_pos"))
    tables = matrices(cells, "bn_id").join(first, ["bn_id", "parent", "child"])
    n_nodes, n_edges = sizes(F.col("nodes"))
    return titles.join(node_dict("bn_id", members, priors, tables), "bn_id").withColumns({"n_nodes": n_nodes, "n_edges": n_edges})


def subgraph_ids(subsets: DataFrame) -> DataFrame:
    """subsets (bn_id, members, size) with sub_id: the network's id and the set's number there, by size and members."""
    order = F.row_number().over(Window.partitionBy("bn_id").orderBy("size", "members"))
    return subsets.withColumn("sub_id", F.format_string("%s_sub_%03d", "bn_id", order))


def subgraph_records(subsets: DataFrame, titles: DataFrame, nodes: DataFrame, node_state: DataFrame, edges: DataFrame, marginal: DataFrame, joint: DataFrame) -> DataFrame:
    """A record a subset (sub_id, bn_id, members): its edges, new priors of cut nodes, recomputed tables, and levels anew.

    Titles and texts are those of the network; roots of the network keep their prior.
    """
    keys = subsets.select("sub_id", "bn_id", F.explode("members").alias("node"))
    own = keys.join(nodes.select("bn_id", "node", "node_pos").join(prob.state_lists(node_state), ["bn_id", "node"], "left").hint("merge"), ["bn_id", "node"])
    kept = graph.induced_edges(subsets, edges)
    renamed = lambda df: df.drop("bn_id").withColumnRenamed("sub_id", "bn_id")
    level = graph.levels(renamed(kept.select("sub_id", "bn_id", "parent", "child")), renamed(own), folded=True).select(F.col("bn_id").alias("sub_id"), "node", "level")
    members = own.where("states is not null").join(level, ["sub_id", "node"]).drop("bn_id")
    cut = graph.rerooted(subsets, edges, marginal, node_state).select("sub_id", "node", F.col("values").alias("prior"))
    roots = final_prior(marginal, graph.roots(edges, nodes), node_state)
    priors = keys.join(roots, ["bn_id", "node"]).select("sub_id", "node", "prior").unionByName(cut)
    first = kept.groupBy("sub_id", "bn_id", "parent", "child").agg(F.min("edge_pos").alias("edge_pos"))
    whole = matrices(graph.edge_cpds(edges, joint, marginal, node_state), "bn_id")
    tables = first.join(whole.hint("merge"), ["bn_id", "parent", "child"]).drop("bn_id")
    n_nodes, n_edges = sizes(F.col("nodes"))
    found = subsets.select("sub_id", "bn_id").join(titles, "bn_id").join(node_dict("sub_id", members, priors, tables), "sub_id")
    return found.withColumnRenamed("bn_id", "parent_id").withColumnRenamed("sub_id", "id").withColumns({"n_nodes": n_nodes, "n_edges": n_edges})


def flattened(records: DataFrame, key: str = "id") -> DataFrame:
    """(key, node_pos, node, level, parent_pos, parent, ps_pos, parent_state, state_pos, state, p): a row a cell, and a row a state of a prior (parent null)."""
    node = F.posexplode("entries").alias("node_pos", "n")
    rows = records.select(key, F.map_entries("nodes").alias("entries")).select(key, node).select(key, "node_pos", F.col("n.key").alias("node"), "n.value.*")
    prior = rows.where("prior is not null").select(key, "node_pos", "node", "level", F.lit(None).cast("int").alias("parent_pos"), F.lit(None).cast("string").alias("parent"),
                                                   F.lit(None).cast("int").alias("ps_pos"), F.lit(None).cast("string").alias("parent_state"), F.posexplode(F.arrays_zip(F.col("states").alias("state"), F.col("prior").alias("p"))).alias("state_pos", "c"))
    each = rows.select(key, "node_pos", "node", "level", "states", F.posexplode(F.map_entries("parents")).alias("parent_pos", "e"))
    row = each.select(key, "node_pos", "node", "level", "parent_pos", F.col("e.key").alias("parent"), "e.value.parent_states",
                      F.posexplode(F.arrays_zip(F.col("states").alias("state"), F.col("e.value.cpd_matrix").alias("row"))).alias("state_pos", "r"))
    cell = row.select(key, "node_pos", "node", "level", "parent_pos", "parent", "state_pos", F.col("r.state").alias("state"),
                      F.posexplode(F.arrays_zip(F.col("parent_states").alias("parent_state"), F.col("r.row").alias("p"))).alias("ps_pos", "c"))
    out = [key, "node_pos", "node", "level", "parent_pos", "parent", "ps_pos", "parent_state", "state_pos", "state", "p"]
    return prior.select("*", "c.state", "c.p").select(*out).unionByName(cell.select("*", "c.parent_state", "c.p").select(*out))


def with_marginals(records: DataFrame, marginals: DataFrame) -> DataFrame:
    """Records with the marginals (source_id, marginals map) of their source, an empty map where there are none."""
    met = records.join(marginals, "source_id", "left")
    return met.withColumn("marginals", F.coalesce("marginals", F.create_map().cast("map<string,map<string,double>>")))


def metadata(records: DataFrame, **given) -> DataFrame:
    """One row about a corpus: total, generated_total (records with a text), networks, and what is given."""
    texts = F.sum((F.trim(F.coalesce("generated_text", F.lit(""))) != "").cast("long"))
    found = records.agg(F.count(F.lit(1)).alias("total"), F.coalesce(texts, F.lit(0)).alias("generated_total"))
    return found.select("*", *(F.lit(v).alias(k) for k, v in given.items()))


def missing_only(records: DataFrame, earlier: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(still to do, done): records whose earlier row has a text are done and keep that row."""
    done = earlier.where(F.trim(F.coalesce("generated_text", F.lit(""))) != "")
    return records.join(done.select(key), key, "left_anti"), done
