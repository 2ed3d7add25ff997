"""Graphs of networks: validation, levels, neighbours, connected subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions.staging import written
from . import prob, wide


def greedy_dag(edges: Column) -> Column:
    """Of an ordered array of (edge_pos, parent, child), those that close no cycle with the ones accepted before.

    The fold carries the accepted edges and the pairs (a, b) where b can be reached from a. Self loops
    close a cycle; a repeated edge doesn't, and stays.
    """
    pair = "array<struct<a:string,b:string>>"
    zero = F.struct(F.array().cast("array<struct<edge_pos:int,parent:string,child:string>>").alias("kept"), F.array().cast(pair).alias("reach"))

    def step(acc, e):
        closes = (e["parent"] == e["child"]) | F.exists(acc["reach"], lambda r: (r["a"] == e["child"]) & (r["b"] == e["parent"]))
        above = F.array_append(F.transform(F.filter(acc["reach"], lambda r: r["b"] == e["parent"]), lambda r: r["a"]), e["parent"])
        below = F.array_append(F.transform(F.filter(acc["reach"], lambda r: r["a"] == e["child"]), lambda r: r["b"]), e["child"])
        new = F.flatten(F.transform(above, lambda x: F.transform(below, lambda y: F.struct(x.alias("a"), y.alias("b")))))
        grown = F.struct(F.array_append(acc["kept"], e).alias("kept"), F.array_union(acc["reach"], new).alias("reach"))
        return F.when(closes, acc).otherwise(grown)

    return F.aggregate(edges, zero, step, lambda acc: acc["kept"])


#: Nodes and edges of a network that are folded inside an expression; larger networks are streamed through a task as
#: numbers, with the same results.
FOLDED = 64


def _parted(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(edges, nodes) of networks that are folded, and the others' bn_id, if there are any."""
    rows = edges.select("bn_id").unionAll(nodes.select("bn_id"))
    large = written(rows.groupBy("bn_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FOLDED).select("bn_id"), "wide")
    if large.isEmpty():
        return edges, nodes, None
    few = lambda df: df.join(large, "bn_id", "left_anti")
    return few(edges), few(nodes), large


def validate_dag(edges: DataFrame, nodes: DataFrame, keep_duplicates: bool = True) -> DataFrame:
    """(bn_id, edge_pos, parent, child): edges between known nodes, scanned in order, that close no cycle."""
    each = F.struct(F.col("edge_pos").cast("int").alias("edge_pos"), F.col("parent"), F.col("child"))
    small, own, large = _parted(edges, nodes)
    names = own.groupBy("bn_id").agg(F.collect_set("node").alias("names"))
    one = small.groupBy("bn_id").agg(F.array_sort(F.collect_list(each)).alias("e")).join(names, "bn_id")
    known = F.filter("e", lambda e: F.array_contains("names", e["parent"]) & F.array_contains("names", e["child"]))
    kept = one.select("bn_id", F.explode(greedy_dag(known)).alias("e")).select("bn_id", "e.*")
    if large is not None:
        names = nodes.join(large, "bn_id", "left_semi").select("bn_id", "node")
        rows = edges.join(large, "bn_id", "left_semi").join(names.withColumnRenamed("node", "parent"), ["bn_id", "parent"], "left_semi").join(names.withColumnRenamed("node", "child"), ["bn_id", "child"], "left_semi")
        rows = rows.select("bn_id", F.col("edge_pos").cast("int").alias("edge_pos"), "parent", "child").repartition("bn_id").sortWithinPartitions("bn_id", "edge_pos", "parent", "child")
        kept = kept.unionByName(rows.mapInArrow(wide.accepted_rows, kept.schema))
    if keep_duplicates:
        return kept
    return kept.groupBy("bn_id", "parent", "child").agg(F.min("edge_pos").alias("edge_pos")).select("bn_id", "edge_pos", "parent", "child")


def levels(edges: DataFrame, nodes: DataFrame, folded: bool = False) -> DataFrame:
    """(bn_id, node_pos, node, level): the longest path from a root, relaxed once for each node of the network.

    folded: all networks are known to be small, so that none is looked for that isn't.
    """
    small, own, large = (edges, nodes, None) if folded else _parted(edges, nodes)
    names = own.groupBy("bn_id").agg(F.array_sort(F.collect_list(F.struct("node_pos", "node"))).alias("n"))
    links = small.groupBy("bn_id").agg(F.collect_set(F.struct("parent", "child")).alias("e"))
    met = names.join(links, "bn_id", "left").withColumn("e", F.coalesce("e", F.array().cast("array<struct<parent:string,child:string>>")))
    place = lambda x: F.array_position(F.col("n.node"), x)
    parents = F.transform("n", lambda n: F.transform(F.filter("e", lambda e: e["child"] == n["node"]), lambda e: place(e["parent"]).cast("int")))
    met = met.withColumn("up", parents)
    zero = F.transform("n", lambda _: F.lit(0))
    relax = lambda acc: F.transform("up", lambda up: F.coalesce(F.array_max(F.transform(up, lambda i: F.get(acc, i - 1) + 1)), F.lit(0)))
    met = met.withColumn("level", F.aggregate(F.sequence(F.lit(1), F.size("n")), zero, lambda acc, _: relax(acc)))
    out = met.select("bn_id", F.explode(F.arrays_zip("n", "level")).alias("x")).select("bn_id", "x.n.node_pos", "x.n.node", "x.level")
    if large is None:
        return out
    whole = lambda df: df.join(large, "bn_id", "left_semi")
    rows = whole(nodes).select("bn_id", "node_pos", "node", F.lit(None).cast("string").alias("other"))
    rows = rows.union(whole(edges).select("bn_id", F.lit(None).cast(rows.schema["node_pos"].dataType), "parent", "child"))
    rows = rows.repartition("bn_id").sortWithinPartitions("bn_id", F.col("node_pos").asc_nulls_last(), "node")
    return out.unionByName(rows.mapInArrow(wide.level_rows, out.schema))


def topological(level: DataFrame) -> DataFrame:
    """(bn_id, node, topo_pos): by level, then by place."""
    one = level.groupBy("bn_id").agg(F.array_sort(F.collect_list(F.struct("level", "node_pos", "node"))).alias("n"))
    return one.select("bn_id", F.posexplode("n").alias("topo_pos", "x")).select("bn_id", "x.node", "topo_pos")


def roots(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return nodes.join(edges.select("bn_id", F.col("child").alias("node")), ["bn_id", "node"], "left_anti").hint("merge")


def undirected(edges: DataFrame) -> DataFrame:
    a = edges.select("bn_id", F.col("parent").alias("node"), F.col("child").alias("neighbour"))
    b = edges.select("bn_id", F.col("child").alias("node"), F.col("parent").alias("neighbour"))
    return a.union(b).where("node <> neighbour").distinct()


def adjacency(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(bn_id, node, children, parents) as sorted lists."""
    down = edges.groupBy("bn_id", F.col("parent").alias("node")).agg(F.array_sort(F.collect_set("child")).alias("children"))
    up = edges.groupBy("bn_id", F.col("child").alias("node")).agg(F.array_sort(F.collect_set("parent")).alias("parents"))
    empty = F.array().cast("array<string>")
    met = nodes.select("bn_id", "node").join(down, ["bn_id", "node"], "left").join(up, ["bn_id", "node"], "left")
    return met.select("bn_id", "node", F.coalesce("children", empty).alias("children"), F.coalesce("parents", empty).alias("parents"))


#: Nodes of a network whose subsets are made: each is a bit of a long.
MOST_NODES = 63


def bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), i.cast("int"))


def networks(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(bn_id, names, near): a network's node names in order, and of each the bits of its neighbours."""
    names = nodes.groupBy("bn_id").agg(F.array_sort(F.collect_set("node")).alias("names"))
    links = undirected(edges).groupBy("bn_id").agg(F.collect_list(F.struct("node", "neighbour")).alias("links"))
    met = names.join(links.hint("merge"), "bn_id", "left").withColumn("links", F.coalesce("links", F.array().cast("array<struct<node:string,neighbour:string>>")))
    place = F.map_from_entries(F.transform("names", lambda x, i: F.struct(x, i)))
    found = met.withColumn("place", place).withColumn("links", F.transform("links", lambda e: F.struct(F.try_element_at("place", e["node"]).alias("a"), F.try_element_at("place", e["neighbour"]).alias("b"))))
    mask = lambda i: F.aggregate(F.filter("links", lambda e: (e["a"] == i) & e["b"].isNotNull()), F.lit(0).cast("bigint"), lambda m, e: m.bitwiseOR(bit(e["b"])))
    near = F.transform("names", lambda _, i: mask(i))
    near = F.when(F.size("names") <= MOST_NODES, near).otherwise(F.raise_error(F.format_string(f"network %s has more than {MOST_NODES} nodes", "bn_id")))
    return found.select("bn_id", "names", near.alias("near"))


def single_seeds(nets: DataFrame) -> DataFrame:
    """(bn_id, names, near, root, members, open, closed): each node alone, to be grown by later nodes only."""
    one = nets.select("*", F.posexplode("near").alias("root", "beside")).withColumn("members", bit(F.col("root")))
    upto = bit(F.col("root")).bitwiseOR(bit(F.col("root")) - 1)  # the node and those before it
    return one.select("bn_id", "names", "near", "root", "members", F.col("beside").bitwiseAND(F.bitwise_not(upto)).alias("open"), F.col("beside").bitwiseOR(upto).alias("closed"))


def given_seeds(nets: DataFrame, required: DataFrame) -> DataFrame:
    """As single_seeds: of each network one set (bn_id, members), to be grown by any node."""
    met = nets.join(required.select("bn_id", F.col("members").alias("given")), "bn_id")
    held = F.aggregate("given", F.lit(0).cast("bigint"), lambda m, x: m.bitwiseOR(bit(F.array_position("names", x) - 1)))
    beside = F.aggregate("given", F.lit(0).cast("bigint"), lambda m, x: m.bitwiseOR(F.get("near", (F.array_position("names", x) - 1).cast("int"))))
    met = met.withColumn("members", held).withColumn("beside", beside)
    return met.select("bn_id", "names", "near", F.lit(-1).alias("root"), "members", F.col("beside").bitwiseAND(F.bitwise_not("members")).alias("open"), F.col("beside").bitwiseOR(F.col("members")).alias("closed"))


STATE = "struct<members:bigint,open:bigint,closed:bigint,whole:boolean>"


def children(s: Column, near: Column) -> Column:
    """The sets that a set grows to by one of its open nodes each, as an array of states.

    A set opens what is beside the new node and beside no member yet, and keeps open what comes after the new
    node. So a set's members join in one order only, and every connected set is reached once.
    """
    picked = F.filter(F.sequence(F.lit(0), F.size(near) - 1), lambda i: s["open"].bitwiseAND(bit(i)) != 0)
    upto = lambda i: bit(i).bitwiseOR(bit(i) - 1)
    return F.transform(picked, lambda i: F.struct(
        s["members"].bitwiseOR(bit(i)).alias("members"),
        s["open"].bitwiseAND(F.bitwise_not(upto(i))).bitwiseOR(F.get(near, i).bitwiseAND(F.bitwise_not(s["closed"]))).alias("open"),
        s["closed"].bitwiseOR(F.get(near, i)).bitwiseOR(bit(i)).alias("closed"), F.lit(False).alias("whole")))


def grown(seeds: DataFrame, largest: int, *keep: str) -> DataFrame:
    """(keep…, members, size): every set that the seeds grow to, with up to `largest` members, as bits.

    Each step turns a row into itself, done, and its children; all steps are one pass without a shuffle,
    and nothing is written.
    """
    state = F.struct("members", "open", "closed", F.lit(False).alias("whole")).cast(STATE)
    rows = seeds.select(*keep, "near", state.alias("s"))
    done = lambda s: F.array(F.struct(s["members"].alias("members"), s["open"].alias("open"), s["closed"].alias("closed"), F.lit(True).alias("whole")))
    for _ in range(largest - 1):
        s = F.col("s")
        more = ~s["whole"] & (s["open"] != 0) & (F.bit_count(s["members"]) < largest)
        rows = rows.select(*keep, "near", F.explode(F.when(more, F.concat(done(s), children(s, F.col("near")))).otherwise(done(s))).alias("s"))
    return rows.select(*keep, F.col("s.members").alias("members"), F.bit_count("s.members").alias("size"))


def named(members: Column, names: Column) -> Column:
    """The names of a set of bits, in order."""
    return F.filter(names, lambda _, i: members.bitwiseAND(bit(i)) != 0)


def _seeds(edges: DataFrame, nodes: DataFrame, required: DataFrame | None) -> DataFrame:
    if required is None:
        return single_seeds(networks(edges, nodes)).repartition("bn_id", "root")
    unknown = required.select("bn_id", F.explode("members").alias("node")).join(nodes.select("bn_id", "node"), ["bn_id", "node"], "left_anti")
    if (row := unknown.orderBy("bn_id", "node").first()) is not None:
        raise ValueError(f"network {row['bn_id']} has no node {row['node']!r}")
    return given_seeds(networks(edges, nodes), required)


def connected_subsets(edges: DataFrame, nodes: DataFrame, smallest: int = 3, largest: int = 9, required: DataFrame | None = None) -> DataFrame:
    """(bn_id, members, size): every connected set of nodes, as a sorted list, with sizes in the bounds.

    Breadth- and depth-first orders give the same sets. required (bn_id, members) gives one set a network to
    grow instead (of one node, to start there); it need not be connected, and no smaller set counts. A
    required name that its network lacks is an error, as is a network of over 63 nodes.
    """
    found = grown(_seeds(edges, nodes, required), largest, "bn_id", "names").where(F.col("size").between(smallest, largest))
    return found.select("bn_id", named(F.col("members"), F.col("names")).alias("members"), "size")


def subset_counts(edges: DataFrame, nodes: DataFrame, smallest: int = 3, largest: int = 9, required: DataFrame | None = None) -> DataFrame:
    """(bn_id, size, n): how many connected sets of each size there are; tasks count what they make, and only counts move."""
    found = grown(_seeds(edges, nodes, required), largest, "bn_id").where(F.col("size").between(smallest, largest))
    return found.groupBy("bn_id", "size").agg(F.count(F.lit(1)).alias("n"))


def drawn_ranks(total: Column, k: int, *key: Column) -> Column:
    """k different numbers below total, every such set as likely; all numbers where there are no more than k."""
    draw = lambda j: F.pmod(F.xxhash64(*key, j), j + 1)
    add = lambda got, j: F.array_append(got, F.when(F.array_contains(got, draw(j)), j).otherwise(draw(j)))
    some = F.aggregate(F.sequence(total - k, total - 1), F.array().cast("array<bigint>"), add)
    return F.when(total <= 0, F.array().cast("array<bigint>")).when(total <= k, F.sequence(F.lit(0).cast("bigint"), total - 1)).otherwise(some)


def drawn_subsets(edges: DataFrame, nodes: DataFrame, k: int, smallest: int = 3, largest: int = 9, seed: int = 42) -> DataFrame:
    """(bn_id, members, size): k connected sets of each network, drawn evenly without replacement; all where there are fewer.

    Sets are numbered in the order in which they grow, a set before its children. Numbers are drawn, and each
    is led down the tree of sets: of the branches at hand the one that holds it is found by counts, and
    counted on. Networks may have very many sets; only counts and the drawn ones are kept. A number takes its
    network's bits along, and joins are by merging: written tables of numbers and networks look far smaller to
    the planner than their rows are.
    """
    nets = written(networks(edges, nodes), "subset-networks").hint("merge")
    state = F.struct("members", "open", "closed", F.lit(False).alias("whole")).cast(STATE)

    def counted(branches: DataFrame, *by: str) -> DataFrame:
        """(by…, b) of branches (by…, at, s): those that hold sets that count, in order, with how many (at, n, s), MOST_NODES entries at most."""
        keys = [*by, "at", "branch"]
        each = branches.withColumn("branch", F.col("s")).select(*keys, "s.members", "s.open", "s.closed")
        n = grown(each, largest, *keys).where(F.col("size").between(smallest, largest)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        return n.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("at", "n", F.col("branch").alias("s")))).alias("b"))

    def led(asked: DataFrame) -> DataFrame:
        """asked (bn_id, near, rank, b) with the branch s that holds its rank, and its rank there."""
        before = F.transform("b", lambda _, i: F.aggregate(F.slice("b", F.lit(1), i), F.lit(0).cast("bigint"), lambda t, x: t + x["n"]))
        met = asked.withColumn("before", before).withColumn("i", F.size(F.filter("before", lambda x: x <= F.col("rank"))) - 1)
        return written(met.select("bn_id", "near", (F.col("rank") - F.get("before", F.col("i"))).alias("rank"), F.get("b", F.col("i"))["s"].alias("s")), "subset-drawn")

    seeds = single_seeds(nets).repartition("bn_id", "root").select("bn_id", "near", F.col("root").alias("at"), state.alias("s"))
    total = F.aggregate("b", F.lit(0).cast("bigint"), lambda t, x: t + x["n"])
    held = led(counted(seeds, "bn_id", "near").select("*", F.explode(drawn_ranks(total, k, F.col("bn_id"), F.lit(seed))).alias("rank")))
    parts = []
    for _ in range(largest):
        # a set that is counted itself comes before its children
        own = F.bit_count("s.members") >= smallest
        parts.append(held.where(own & (F.col("rank") == 0)).select("bn_id", F.col("s.members").alias("members")))
        rest = held.where(~(own & (F.col("rank") == 0))).withColumn("rank", F.col("rank") - F.when(own, 1).otherwise(0))
        rest = rest.withColumn("parent", F.col("s.members"))
        if rest.isEmpty():
            break
        step = rest.select("bn_id", "near", "parent", "s").repartition("bn_id", "parent").distinct()
        step = step.select("bn_id", "near", "parent", F.posexplode(children(F.col("s"), F.col("near"))).alias("at", "s"))
        held = led(rest.select("bn_id", "parent", "rank").join(counted(step, "bn_id", "parent", "near").hint("merge"), ["bn_id", "parent"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.join(nets, "bn_id").select("bn_id", named(F.col("members"), F.col("names")).alias("members"), F.bit_count("members").alias("size"))


def selected_subsets(edges: DataFrame, nodes: DataFrame, smallest: int = 3, largest: int = 9, required: list[str] | None = None,
                     only_required: bool = False, only: DataFrame | None = None, must: DataFrame | None = None) -> DataFrame:
    """(bn_id, members, size) under the options of a selection.

    only (bn_id): the networks that count. required: names that every set holds; networks that lack one
    are left out, and the smallest size is their number. only_required: that set alone, not grown.
    Networks with fewer nodes than the smallest size are left out, but those of must (bn_id), whose
    smallest size is then the number of their nodes.
    """
    if only is not None:
        nodes = nodes.join(only.select("bn_id"), "bn_id", "left_semi")
    count = nodes.groupBy("bn_id").agg(F.count(F.lit(1)).alias("n"), F.collect_set("node").alias("names"))
    least = len(set(required)) if required else smallest
    count = count.withColumn("must", F.lit(False)) if must is None else count.join(must.select("bn_id", F.lit(True).alias("must")).distinct(), "bn_id", "left")
    alive = count.where((F.col("n") >= least) | F.coalesce("must", F.lit(False)))
    if required:
        alive = alive.where(F.size(F.array_except(F.array(*map(F.lit, required)), F.col("names"))) == 0)
    alive = written(alive.select("bn_id", F.least(F.col("n"), F.lit(least)).cast("int").alias("least")), "networks")
    seeds = alive.select("bn_id", F.array_sort(F.array_distinct(F.array(*map(F.lit, required)))).alias("members")) if required else None
    if only_required and required:
        return seeds.withColumn("size", F.size("members"))
    known = lambda df: df.join(alive.select("bn_id"), "bn_id", "left_semi")
    found = connected_subsets(known(edges), known(nodes), 1, largest, seeds)
    return found.join(alive, "bn_id").where(F.col("size") >= F.col("least")).select("bn_id", "members", "size")


def enough_subsets(subsets: DataFrame, k: int) -> DataFrame:
    """The subsets, if every network that has any has k or more; else an error."""
    few = subsets.groupBy("bn_id").count().where(F.col("count") < k).orderBy("bn_id").first()
    if few is not None:
        raise ValueError(f"network {few['bn_id']} has {few['count']} subgraphs, {k} are asked for")
    return subsets


def induced_edges(subsets: DataFrame, edges: DataFrame) -> DataFrame:
    """(sub_id, bn_id, edge_pos, parent, child): the edges with both ends in the subset."""
    listed = edges.groupBy("bn_id").agg(F.collect_list(F.struct("edge_pos", "parent", "child")).alias("e"))
    met = subsets.select("sub_id", "bn_id", "members").join(listed.hint("merge"), "bn_id")
    inside = F.filter("e", lambda e: F.array_contains("members", e["parent"]) & F.array_contains("members", e["child"]))
    return met.select("sub_id", "bn_id", F.inline(inside))


def rerooted(subsets: DataFrame, edges: DataFrame, marginal: DataFrame, node_state: DataFrame) -> DataFrame:
    """(sub_id, bn_id, node, states, values): the new prior of each node that lost all its parents; uniform without a marginal."""
    listed = edges.groupBy("bn_id").agg(F.collect_set(F.struct("parent", "child")).alias("e"))
    met = subsets.select("sub_id", "bn_id", "members").join(listed.hint("merge"), "bn_id")
    children = F.array_intersect("members", F.col("e.child"))
    still = F.transform(F.filter("e", lambda e: F.array_contains("members", e["parent"])), lambda e: e["child"])
    cut = met.select("sub_id", "bn_id", F.explode(F.array_except(children, still)).alias("node"))
    rows = prob.marginal_rows(marginal, node_state)
    none = ~F.exists("values", lambda x: x.isNotNull())
    rows = rows.withColumn("values", F.when(none, N.uniform(F.size("states"))).otherwise(N.rerooted_row(F.col("values"))))
    return cut.join(rows.hint("merge"), ["bn_id", "node"]).select("sub_id", "bn_id", "node", "states", "values")


def reroot(subsets: DataFrame, edges: DataFrame, marginal: DataFrame, node_state: DataFrame) -> DataFrame:
    """(sub_id, bn_id, node, state_pos, state, p): the rows of rerooted, a row a state."""
    return prob.cells(rerooted(subsets, edges, marginal, node_state), "sub_id", "bn_id", "node")


def edge_cpds(kept: DataFrame, joint: DataFrame, marginal: DataFrame, node_state: DataFrame, floor: float = 0.001) -> DataFrame:
    """(bn_id, parent, child, ps_pos, parent_state, state_pos, state, p) of each different edge of `kept`.

    From the joint, with nulls; where an edge has none, the child's floored marginal repeated for each
    parent state, or a uniform column.
    """
    keys = ["bn_id", "parent", "child"]
    with_joint = joint.select(*keys).distinct().hint("merge")
    unique = kept.select(*keys).distinct().hint("merge")
    have = prob.pairwise_nullable(joint, unique.join(with_joint, keys, "left_semi"), node_state, floor)
    rows = prob.joint_rows(joint.limit(0), unique.join(with_joint, keys, "left_anti"), node_state).drop("values")
    own = prob.marginal_rows(marginal, node_state).select("bn_id", F.col("node").alias("child"), "values")
    none = ~F.exists("values", lambda x: x.isNotNull())
    rows = rows.join(own.hint("merge"), ["bn_id", "child"]).withColumn("values", F.when(none, N.uniform(F.size("states"))).otherwise(N.rerooted_row(F.col("values"))))
    return have.unionByName(prob.cells(rows, *keys, "ps_pos", "parent_state"))


def recompute_cpds(subsets: DataFrame, edges: DataFrame, joint: DataFrame, marginal: DataFrame, node_state: DataFrame, floor: float = 0.001) -> DataFrame:
    """(sub_id, bn_id, parent, child, ps_pos, parent_state, state_pos, state, p) of the edges that a subset keeps, as edge_cpds tells them.

    A table is made once for all subsets that keep its edge, and travels as one row.
    """
    keys = ["bn_id", "parent", "child"]
    cell = ["ps_pos", "parent_state", "state_pos", "state", "p"]
    tables = edge_cpds(edges, joint, marginal, node_state, floor).groupBy(*keys).agg(F.collect_list(F.struct(*cell)).alias("c"))
    met = induced_edges(subsets, edges).select("sub_id", *keys).distinct().join(tables.hint("merge"), keys)
    return met.select("sub_id", *keys, F.inline("c"))
