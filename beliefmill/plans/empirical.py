"""The empirical corpus: networks of the star schema, with probabilities that are counted from it.

A network holds the orders of up to GROUP customers of one nation that have neighbouring keys, so the
number of networks grows with the tables.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import written

#: node, its states in order; each gets a last state none that nothing has.
NODES = [
    ("market segment", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]),
    ("part type", ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]),
    ("order priority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]),
    ("order status", ["F", "O", "P"]),
    ("quantity band", ["low", "mid", "high"]),
    ("line status", ["F", "O"]),
    ("return flag", ["A", "N", "R"]),
]
NAMES = [n for n, _ in NODES]
#: Candidate edges in order; the last three are a cycle, a self loop and an unknown node.
EDGES = [
    ("market segment", "order priority"), ("order priority", "order status"), ("part type", "quantity band"), ("market segment", "quantity band"), ("order status", "line status"),
    ("quantity band", "return flag"), ("line status", "return flag"), ("return flag", "market segment"), ("line status", "line status"), ("part type", "missing node"),
]
VALID = 7
#: Nodes that are counted together: each node and valid edge is in one, and a family with a joint of all parents, parents first.
FAMILIES = [("part type", "market segment", "quantity band"), ("market segment", "order priority"), ("order priority", "order status"), ("order status", "line status"), ("quantity band", "return flag"), ("line status", "return flag")]
#: Bits of a node's state in the number of a line's states.
BITS = 3
#: Customer keys of a network, over all nations; networks of a group of keys are numbered NATIONS apart.
GROUP, NATIONS = 375, 25
#: Lines of orders that a task counts, about.
LINES = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bn_id(number: Column) -> Column:
    return F.format_string("bn_%05d", number + 1)


def _told(name: str, values: dict[int, Column]) -> list[Column]:
    """The states of some nodes as a number, and as they are where a node doesn't name them (null if it names all)."""
    place = {i: reduce(lambda c, s: c.when(v == s[1], s[0]), enumerate(NODES[i][1], 1), F.when(v.isNull(), 0)).otherwise(0) for i, v in values.items()}
    number = reduce(Column.bitwiseOR, (F.shiftleft(p, BITS * i) for i, p in place.items()))
    strange = F.when(reduce(Column.__or__, (p == 0 for p in place.values())), F.struct(*(F.when(p == 0, values[i]).alias(f"v{i}") for i, p in place.items())))
    return [number.alias(name), strange.alias(f"{name}_strange")]


def _counted(lines: DataFrame, strange: dict[int, Column]) -> DataFrame:
    """Lines (nk, number, even) and the states that their nodes don't name, to the cells of families."""
    members = [[NAMES.index(x) for x in family] for family in FAMILIES]
    top = BITS * len(NODES)

    def cell(f: int) -> Column:
        mask = sum((1 << BITS) - 1 << BITS * i for i in members[f])
        own = [strange[i].alias(k) for i, k in zip(members[f], "abc", strict=False)]
        own += [F.lit(None).cast("string").alias(k) for k in "abc"[len(own):]]
        told = F.when(reduce(Column.__or__, (strange[i].isNotNull() for i in members[f])), F.struct(*own))
        return F.struct(F.col("number").bitwiseAND(F.lit(mask)).bitwiseOR(F.lit(f << top)).alias("code"), told.alias("strange"))

    each = lines.select("nk", F.col("even").cast("long").alias("even"), F.inline(F.array(*(cell(f) for f in range(len(FAMILIES))))))
    n = each.groupBy("nk", "code", "strange").agg(F.count(F.lit(1)).alias("n"), F.sum("even").alias("e")).withColumn("family", F.shiftright("code", top))

    def state(k: str, at: int) -> Column:
        place = lambda i: F.shiftright("code", BITS * i).bitwiseAND(F.lit((1 << BITS) - 1))
        named = lambda i: F.coalesce(F.get(F.array(F.lit(None), *map(F.lit, NODES[i][1])), place(i)), F.col(f"strange.{k}"))
        return reduce(lambda c, f: c.when(F.col("family") == f, named(members[f][at])), (f for f in range(1, len(FAMILIES)) if at < len(members[f])), F.when(F.col("family") == 0, named(members[0][at]))).alias(k)

    return n.select("nk", "family", *(state(k, at) for at, k in enumerate("abc")), "n", "e")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nk, family, a, b, c, n, e): observations, and those of even orders, of each combination of states of each family.

    The only pass over the facts: every table of the corpus is a part or a sum of these rows, of which a network has no
    more than its states combine to, however many lines. Orders find their customers and lines their parts before the
    two meet; then lines come together by network, so that a task holds all rows of its networks and what is summed
    from them later hardly moves. Lines move with a number for their states. The tasks grow in number with
    the lines. The joins are plain equi-joins, so the planner broadcasts what its size allows.
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", *_told("on", {2: F.col("o_orderpriority"), 3: F.col("o_orderstatus")}))
    number = (F.col("c_nationkey") + F.floor(F.col("c_custkey") / GROUP) * NATIONS).cast("long")
    c = table(spark, sf_dir, "customer").select("c_custkey", number.alias("nk"), *_told("cn", {0: F.col("c_mktsegment")}))
    p = table(spark, sf_dir, "part").select("p_partkey", *_told("pn", {1: F.col("p_type")}))
    band = F.when(F.col("l_quantity") < 17, "low").when(F.col("l_quantity") < 34, "mid").otherwise("high")
    li = table(spark, sf_dir, "lineitem")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = li.count() // LINES + 1
    spread = lambda df, key: df.repartition(tasks, key) if tasks > least else df
    li = li.select("l_orderkey", "l_partkey", *_told("ln", {4: band, 5: F.col("l_linestatus"), 6: F.col("l_returnflag")}))
    orders = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "nk", F.col("on").bitwiseOR(F.col("cn")).alias("on"), "on_strange", "cn_strange")
    lines = li.join(p, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", F.col("ln").bitwiseOR(F.col("pn")).alias("ln"), "ln_strange", "pn_strange")
    met = spread(lines, "l_orderkey").join(spread(orders, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    strange = [f"{x}_strange" for x in ("cn", "pn", "on", "ln")]
    met = met.select("nk", (F.col("l_orderkey") % 2 == 0).alias("even"), F.col("on").bitwiseOR(F.col("ln")).alias("number"), *strange).repartition(max(tasks, least), "nk")
    return _counted(met, {i: F.col(f"{x}_strange.v{i}") for i, x in enumerate(("cn", "pn", "on", "on", "ln", "ln", "ln"))})


def _fixed(fields, rows) -> Column:
    return F.inline(F.array(*(F.struct(*(F.lit(v).alias(f) for f, v in zip(fields, r, strict=True))) for r in rows)))


def _place(*nodes: str) -> tuple:
    """The smallest family with some nodes, and the columns of their states."""
    f = min((f for f, family in enumerate(FAMILIES) if set(nodes) <= set(family)), key=lambda f: len(FAMILIES[f]))
    return f, *(F.col("abc"[FAMILIES[f].index(x)]) for x in nodes)


class Corpus:
    """The tables of the empirical corpus, each made when it is first asked for; those that are counted are written once.

    bn (bn_id, nk, total), nodes, node_state, marginal, joint, multi_joint, edges (the valid ones) and
    variant (one candidate edge missing).
    """

    def __init__(self, cells: DataFrame, n: str):
        self.cells, self.n = cells, n

    def even(self) -> Corpus:
        """The same networks, of even orders alone."""
        return Corpus(self.cells, "e")

    @cached_property
    def bn(self) -> DataFrame:
        counted = self.cells.where(F.col("family") == len(FAMILIES) - 1).groupBy("nk").agg(F.sum(self.n).alias("total"))
        return written(counted.withColumn("bn_id", bn_id(F.col("nk"))), "corpus-bn")

    def _each(self, fields, rows) -> DataFrame:
        # the planner takes these for as small as the networks they are made from, and would broadcast them
        return self.bn.select("bn_id", "nk", _fixed(fields, rows)).hint("merge")

    @cached_property
    def nodes(self) -> DataFrame:
        return self._each(("node_pos", "node"), enumerate(NAMES)).drop("nk")

    @cached_property
    def node_state(self) -> DataFrame:
        return self._each(("node", "state_pos", "state"), ((x, i, s) for x, ss in NODES for i, s in enumerate([*ss, "none"]))).drop("nk")

    @cached_property
    def variant(self) -> DataFrame:
        every = self._each(("edge_pos", "parent", "child"), ((i, a, b) for i, (a, b) in enumerate(EDGES)))
        return every.where(F.col("edge_pos") != F.col("nk") % 10).drop("nk")

    @cached_property
    def edges(self) -> DataFrame:
        return self._each(("edge_pos", "parent", "child"), ((i, a, b) for i, (a, b) in enumerate(EDGES[:VALID]))).drop("nk")

    def _shares(self, counts: DataFrame, name: str, *columns) -> DataFrame:
        p = (F.col("c") / F.col("total")).alias("p")
        return written(counts.join(self.bn, "nk").where("c > 0").select("bn_id", *columns, p), name)

    def _sums(self, what: list[tuple[int, Column]], *keys: str) -> DataFrame:
        """(nk, keys…, c): sums over cells, each taken from the cells of one family; a family of as many nodes as keys name needs no sum."""
        whole = [(f, x) for f, x in what if 2 * len(FAMILIES[f]) == len(keys)]

        def taken(some: list[tuple[int, Column]]) -> DataFrame:
            families = sorted({f for f, _ in some})
            own = [F.array(*(x for g, x in some if g == f)) for f in families]
            each = F.explode(reduce(lambda c, fx: c.when(F.col("family") == fx[0], fx[1]), zip(families[1:], own[1:], strict=True), F.when(F.col("family") == families[0], own[0])))
            return self.cells.select("nk", F.col(self.n).alias("c"), each.alias("x")).select("nk", *(f"x.{k}" for k in keys), "c")

        summed = taken([x for x in what if 2 * len(FAMILIES[x[0]]) != len(keys)]).groupBy("nk", *keys).agg(F.sum("c").alias("c"))
        return taken(whole).union(summed) if whole else summed

    @cached_property
    def marginal(self) -> DataFrame:
        def one(node: str) -> tuple[int, Column]:
            f, state = _place(node)
            return f, F.struct(F.lit(node).alias("node"), state.alias("state"))

        return self._shares(self._sums([one(x) for x in NAMES], "node", "state"), "corpus-marginal", "node", "state")

    @cached_property
    def joint(self) -> DataFrame:
        def two(a: str, b: str) -> tuple[int, Column]:
            f, parent, child = _place(a, b)
            return f, F.struct(F.lit(a).alias("parent"), F.lit(b).alias("child"), parent.alias("parent_state"), child.alias("child_state"))

        keys = ["parent", "child", "parent_state", "child_state"]
        return self._shares(self._sums([two(a, b) for a, b in EDGES[:VALID]], *keys), "corpus-joint", *keys)

    @cached_property
    def multi_joint(self) -> DataFrame:
        counts = self.cells.where("family = 0").select("nk", F.array("a", "b").alias("combo"), F.col("c").alias("child_state"), F.col(self.n).alias("c"))
        return self._shares(counts, "corpus-multi", F.lit(FAMILIES[0][-1]).alias("child"), "combo", "child_state")


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    return Corpus(written(cells(spark, sf_dir), "corpus-cells"), "n")
