"""Validation and recovery of probability tables, on long tables.

node_state (bn_id, node, state_pos, state); marginal (bn_id, node, state, p); edge (bn_id, edge_pos,
parent, child); joint (bn_id, parent, child, parent_state, child_state, p); multi_joint (bn_id, child,
combo, child_state, p). Results are long: a row a cell, with the position of its state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from . import packed


def ordered(pos: str, value: str) -> Column:
    """An aggregate: the values of a group, by position."""
    return F.transform(F.array_sort(F.collect_list(F.struct(pos, F.col(value).alias("v")))), lambda x: x["v"])


def state_lists(node_state: DataFrame) -> DataFrame:
    return node_state.groupBy("bn_id", "node").agg(ordered("state_pos", "state").alias("states"))


def cells(rows: DataFrame, *keys: str, states: str = "states", values: str = "values") -> DataFrame:
    """Back to a row a state."""
    return rows.select(*keys, F.posexplode(F.arrays_zip(F.col(states).alias("state"), F.col(values).alias("p"))).alias("state_pos", "c")).select(*keys, "state_pos", "c.state", "c.p")


def marginal_rows(marginal: DataFrame, node_state: DataFrame) -> DataFrame:
    """(bn_id, node, states, values) of every node: values of missing states are null. States and masses meet in one shuffle."""
    s = node_state.select("bn_id", "node", F.struct("state_pos", "state").alias("s"), F.lit(None).cast("struct<state:string,p:double>").alias("m"))
    m = marginal.select("bn_id", "node", F.lit(None).cast(s.schema["s"].dataType).alias("s"), F.struct(F.col("state").cast("string").alias("state"), F.col("p").cast("double").alias("p")).alias("m"))
    met = s.union(m).groupBy("bn_id", "node").agg(F.array_sort(F.collect_list("s")).alias("s"), F.array_sort(F.collect_list("m")).alias("m")).where("size(s) > 0")
    return met.select("bn_id", "node", F.col("s.state").alias("states"), F.transform("s", lambda x: F.get(F.filter("m", lambda m: m["state"] == x["state"]), F.lit(0))["p"]).alias("values"))


def joint_grids(joint: DataFrame, edges: DataFrame, node_state: DataFrame) -> DataFrame:
    """(bn_id, parent, child, states, grid): a row an edge; grid holds (ps_pos, parent_state, values) of each parent state, missing cells null.

    An edge is a row with its cells and its nodes' states, so that no cell is moved by its states.
    """
    keys = ["bn_id", "parent", "child"]
    cell = F.struct("parent_state", "child_state", F.col("p").cast("double").alias("p"))
    c = joint.select(*keys, cell.alias("c"))
    known = edges.select(*keys, F.lit(None).cast(c.schema["c"].dataType).alias("c"), F.lit(True).alias("known"))
    one = known.union(c.withColumn("known", F.lit(None).cast("boolean"))).groupBy(*keys).agg(F.max("known").alias("known"), F.array_sort(F.collect_list("c")).alias("cells")).where("known")
    lists = node_state.groupBy("bn_id", "node").agg(F.array_sort(F.collect_list(F.struct("state_pos", "state"))).alias("l"))
    of = lambda name, to: lists.select("bn_id", F.col("node").alias(name), F.col("l").alias(to)).hint("merge")
    met = one.join(of("parent", "ps"), ["bn_id", "parent"]).join(of("child", "cs"), ["bn_id", "child"])
    value = lambda own: F.transform("cs", lambda x: F.get(F.filter(own, lambda c: c["child_state"] == x["state"]), F.lit(0))["p"])
    row = lambda ps: F.struct(ps["state_pos"].alias("ps_pos"), ps["state"].alias("parent_state"), N.bound(F.filter("cells", lambda c: c["parent_state"] == ps["state"]), value).alias("values"))
    return met.select(*keys, F.col("cs.state").alias("states"), F.transform("ps", row).alias("grid"))


def joint_rows(joint: DataFrame, edges: DataFrame, node_state: DataFrame) -> DataFrame:
    """(bn_id, parent, child, ps_pos, parent_state, states, values): the full grid of each edge, missing cells null."""
    keys = ["bn_id", "parent", "child"]
    return joint_grids(joint, edges, node_state).select(*keys, "states", F.explode("grid").alias("r")).select(*keys, "r.ps_pos", "r.parent_state", "states", "r.values")


def zeros(a: Column) -> Column:
    return F.transform(a, lambda x: F.coalesce(x, F.lit(0.0)))


def validate_marginals(marginal: DataFrame, node_state: DataFrame) -> DataFrame:
    """Marginals of known nodes over all their states; nodes without any value are skipped, unknown nodes kept as they are."""
    known = marginal_rows(marginal, node_state).where(F.exists("values", lambda x: x.isNotNull()))
    own = marginal.join(node_state.select("bn_id", "node").distinct(), ["bn_id", "node"], "left_anti")
    own = own.groupBy("bn_id", "node").agg(F.array_sort(F.collect_list(F.struct("state", "p"))).alias("s"))
    own = own.select("bn_id", "node", F.col("s.state").alias("states"), F.col("s.p").alias("values"))
    return cells(known.union(own).withColumn("values", N.validated_marginal(F.col("values"))), "bn_id", "node")


def validate_joints(joint: DataFrame, edges: DataFrame, node_state: DataFrame, floor: float = 0.0001) -> DataFrame:
    """The full grid of each edge, floored and shared over the whole table."""
    rows = joint_rows(joint, edges, node_state)
    long = rows.select("bn_id", "parent", "child", "ps_pos", "parent_state", F.posexplode(F.arrays_zip("states", "values")).alias("state_pos", "c"))
    long = long.select("bn_id", "parent", "child", "ps_pos", "parent_state", "state_pos", F.col("c.states").alias("child_state"), F.greatest(F.lit(floor), F.coalesce("c.values", F.lit(floor))).alias("x"))
    whole = long.groupBy("bn_id", "parent", "child").agg(F.array_sort(F.collect_list(F.struct("ps_pos", "state_pos", "x"))).alias("g"))
    whole = whole.select("bn_id", "parent", "child", N.total(F.col("g.x")).alias("sum"))
    return long.join(whole, ["bn_id", "parent", "child"]).withColumn("p", N.rounded(F.col("x") / F.col("sum"), 6)).drop("x", "sum")


def combo_rows(multi_joint: DataFrame, families: DataFrame, node_state: DataFrame) -> DataFrame:
    """(bn_id, child, combo_pos, combo, states, values): every combination of the parents' states, missing cells null.

    families (bn_id, child, parents) lists the parents in order.
    """
    lists = state_lists(node_state)
    each = families.select("bn_id", "child", F.posexplode("parents").alias("parent_pos", "node")).join(lists, ["bn_id", "node"])
    grid = each.groupBy("bn_id", "child").agg(ordered("parent_pos", "states").alias("lists"))
    grid = grid.select("bn_id", "child", F.posexplode(N.combinations(F.col("lists"))).alias("combo_pos", "combo"))
    grid = grid.join(node_state.select("bn_id", F.col("node").alias("child"), "state_pos", F.col("state").alias("child_state")), ["bn_id", "child"])
    grid = grid.join(multi_joint.select("bn_id", "child", "combo", "child_state", "p"), ["bn_id", "child", "combo", "child_state"], "left")
    return grid.groupBy("bn_id", "child", "combo_pos", "combo").agg(ordered("state_pos", "child_state").alias("states"), ordered("state_pos", "p").alias("values"))


def validate_multi_joints(multi_joint: DataFrame, families: DataFrame, node_state: DataFrame, floor: float = 0.0001) -> DataFrame:
    """Joints of two or three parents: the full grid of each, floored and shared over the whole table."""
    rows = combo_rows(multi_joint, families.where(F.size("parents").between(2, 3)), node_state)
    floored = F.transform("values", lambda x: F.greatest(F.lit(floor), F.coalesce(x, F.lit(floor))))
    long = cells(rows.withColumn("values", floored), "bn_id", "child", "combo_pos", "combo")
    whole = long.groupBy("bn_id", "child").agg(F.array_sort(F.collect_list(F.struct("combo_pos", "state_pos", "p"))).alias("g")).select("bn_id", "child", N.total(F.col("g.p")).alias("sum"))
    return long.join(whole, ["bn_id", "child"]).withColumn("p", N.rounded(F.col("p") / F.col("sum"), 6)).drop("sum")


def parent_map(edges: DataFrame) -> DataFrame:
    """(bn_id, child, parents) in the order of the edges; a repeated edge counts once, at its first place."""
    first = edges.groupBy("bn_id", "parent", "child").agg(F.min("edge_pos").alias("edge_pos"))
    return first.groupBy("bn_id", "child").agg(ordered("edge_pos", "parent").alias("parents"))


def conditionals(joint: DataFrame, edges: DataFrame, node_state: DataFrame) -> DataFrame:
    """(bn_id, parent, child, ps_pos, parent_state, states, values): recovered conditional rows of each edge."""
    rows = joint_rows(joint, edges, node_state)
    return rows.withColumn("values", N.conditional_row(zeros(F.col("values"))))


def priors(marginal: DataFrame, nodes: DataFrame, node_state: DataFrame) -> DataFrame:
    """Rows of nodes (bn_id, node): from the marginal, or uniform where there is none."""
    rows = marginal_rows(marginal, node_state).join(nodes.select("bn_id", "node"), ["bn_id", "node"], "left_semi")
    none = ~F.exists("values", lambda x: x.isNotNull())
    return rows.withColumn("values", F.when(none, N.uniform(F.size("states"))).otherwise(N.prior_row(F.col("values"))))


def naive_bayes(joint: DataFrame, marginal: DataFrame, edges: DataFrame, families: DataFrame, node_state: DataFrame, exponent: int = 1) -> DataFrame:
    """(bn_id, child, combo_pos, combo, states, values) of families by naive Bayes."""
    lists = state_lists(node_state)
    each = families.select("bn_id", "child", F.posexplode("parents").alias("parent_pos", "parent"))
    rows = conditionals(joint, edges, node_state).join(each, ["bn_id", "parent", "child"])
    tables = rows.groupBy("bn_id", "child", "parent_pos").agg(F.array_sort(F.collect_list(F.struct("parent_state", "values"))).alias("table"))
    tables = tables.groupBy("bn_id", "child").agg(ordered("parent_pos", "table").alias("tables"))
    of = each.join(lists.withColumnRenamed("node", "parent"), ["bn_id", "parent"]).groupBy("bn_id", "child").agg(ordered("parent_pos", "states").alias("lists"))
    combos = of.select("bn_id", "child", F.posexplode(N.combinations(F.col("lists"))).alias("combo_pos", "combo"))
    pi = marginal_rows(marginal, node_state).select("bn_id", F.col("node").alias("child"), "states", F.col("values").alias("pi"))
    met = combos.join(tables, ["bn_id", "child"]).join(pi, ["bn_id", "child"])
    rows = F.zip_with("tables", "combo", lambda t, s: F.filter(t, lambda x: x["parent_state"] == s)[0]["values"])
    return met.select("bn_id", "child", "combo_pos", "combo", "states", N.naive_bayes_row(rows, F.col("pi"), exponent).alias("values"))


def exact(multi_joint: DataFrame, families: DataFrame, node_state: DataFrame) -> DataFrame:
    rows = combo_rows(multi_joint, families, node_state)
    return rows.withColumn("values", N.exact_row(zeros(F.col("values"))))


def single_parent(joint: DataFrame, edges: DataFrame, families: DataFrame, node_state: DataFrame) -> DataFrame:
    one = families.where(F.size("parents") == 1).select("bn_id", "child", F.col("parents")[0].alias("parent"))
    rows = conditionals(joint, edges, node_state).join(one, ["bn_id", "parent", "child"], "left_semi")
    return rows.select("bn_id", "child", F.col("ps_pos").alias("combo_pos"), F.array("parent_state").alias("combo"), "states", "values")


def all_cpds(marginal: DataFrame, joint: DataFrame, multi_joint: DataFrame, edges: DataFrame, node_state: DataFrame, exponent: int = 1) -> DataFrame:
    """One table a node: (bn_id, node, kind, combo_pos, combo, state_pos, state, p).

    No parents: prior. One: the conditional. More: exact where a multi-parent joint of the child is
    given, else naive Bayes. Tables meet in one shuffle by bn_id, after which a network is a row.
    """
    return cells(packed.all_cpds(marginal, joint, multi_joint, edges, node_state, exponent), "bn_id", "node", "kind", "combo_pos", "combo")


def verify(cpds: DataFrame, families: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(bn_id, node, issue) for every distribution that doesn't sum to 1 within the tolerance."""
    sums = cpds.groupBy("bn_id", "node", "kind", "combo_pos", "combo").agg(F.array_sort(F.collect_list(F.struct("state_pos", F.coalesce("p", F.lit(0.0)).alias("p")))).alias("s"))
    sums = sums.withColumn("sum", N.total(F.col("s.p"))).where(F.abs(F.col("sum") - 1) > tolerance)
    sums = sums.join(families.select("bn_id", F.col("child").alias("node"), "parents"), ["bn_id", "node"], "left")
    keys = F.array_join(F.zip_with("parents", "combo", lambda a, b: F.concat(a, F.lit("="), b)), " ")
    issue = F.when(F.col("kind") == "prior", F.format_string("%s prior sums to %.4f", "node", "sum")).when(
        F.col("kind") == "matrix", F.format_string("%s|%s col sums to %.4f", F.col("node"), keys, F.col("sum"))
    ).otherwise(F.format_string("%s|%s row sums to %.4f", F.col("node"), keys, F.col("sum")))
    return sums.select("bn_id", "node", issue.alias("issue"))


def pairwise_nullable(joint: DataFrame, edges: DataFrame, node_state: DataFrame, floor: float, related: DataFrame | None = None) -> DataFrame:
    """(bn_id, parent, child, ps_pos, parent_state, state_pos, state, p) with null cells.

    related (bn_id, parent, parent_state, child, has_relationship), if given, clears the parent states it
    says no to; what it doesn't name is related.
    """
    rows = joint_rows(joint, edges, node_state)
    if related is not None:
        rows = rows.join(related, ["bn_id", "parent", "parent_state", "child"], "left")
        rows = rows.withColumn("values", N.nullable_row(zeros(F.col("values")), floor, F.coalesce("has_relationship", F.lit(True))))
    else:
        rows = rows.withColumn("values", N.nullable_row(zeros(F.col("values")), floor))
    return cells(rows, "bn_id", "parent", "child", "ps_pos", "parent_state")


def pairwise_matrices(joint: DataFrame, edges: DataFrame, node_state: DataFrame, floor: float) -> DataFrame:
    """(bn_id, parent, child, m): pairwise_nullable as a row an edge; rows of m are child states, columns parent states, by position.

    The planner takes a matrix for as small as a number and would broadcast the matrices of all networks.
    """
    columns = F.transform("grid", lambda r: N.nullable_row(zeros(r["values"]), floor))
    turned = N.bound(columns, lambda c: F.transform("states", lambda _, i: F.transform(c, lambda v: F.get(v, i))))
    return joint_grids(joint, edges, node_state).select("bn_id", "parent", "child", turned.alias("m")).hint("merge")
