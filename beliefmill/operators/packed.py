"""Networks packed into a row each: one shuffle by bn_id, then array functions alone."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N


def packed(**tables: tuple[DataFrame, list[str]]) -> DataFrame:
    """(bn_id, name…): of each table the array of its rows, as structs of the named columns, by network."""
    parts = [df.select("bn_id", F.struct(*columns).alias(name)) for name, (df, columns) in tables.items()]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.groupBy("bn_id").agg(*(F.collect_list(name).alias(name) for name in tables))


def families(nets: DataFrame) -> DataFrame:
    """A row a node of packed networks: its states and parents in order, their states, and its own cells.

    (bn_id, node, states, parents, lists, values, joint, multi); values: the marginal by state, null where
    there is none. A repeated edge counts once, at its first place.
    """
    nets = nets.withColumn("states", F.array_sort("states")).withColumn("edges", F.array_sort("edges"))
    listed = lambda n: F.transform(F.filter("states", lambda x: x["node"] == n), lambda x: x["state"])
    above = lambda n: F.array_distinct(F.transform(F.filter("edges", lambda e: e["child"] == n), lambda e: e["parent"]))
    mass = lambda n, s: F.get(F.filter("marginal", lambda m: (m["node"] == n) & (m["state"] == s)), F.lit(0))["p"]
    own = lambda name, n: F.filter(name, lambda x: x["child"] == n)

    def told(n: Column) -> Column:
        return N.bound(F.struct(listed(n).alias("states"), above(n).alias("parents")), lambda f: F.struct(
            n.alias("node"), f["states"].alias("states"), f["parents"].alias("parents"), F.transform(f["parents"], listed).alias("lists"),
            F.transform(f["states"], lambda s: mass(n, s)).alias("values"), own("joint", n).alias("joint"), own("multi", n).alias("multi")))

    names = F.array_distinct(F.transform("states", lambda x: x["node"]))
    return nets.select("bn_id", F.explode(F.transform(names, told)).alias("f")).select("bn_id", "f.*")


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def conditional_tables() -> Column:
    """Of a family's parents, in order, the recovered conditional rows by the parent's states, from its joint cells."""

    def row(parent: Column, state: Column) -> Column:
        cells = F.filter("joint", lambda c: (c["parent"] == parent) & (c["parent_state"] == state))
        value = lambda g: F.transform("states", lambda s: _zero(F.get(F.filter(g, lambda c: c["child_state"] == s), F.lit(0))["p"]))
        return N.conditional_row(N.bound(cells, value))

    return F.zip_with("parents", "lists", lambda p, states: F.transform(states, lambda s: row(p, s)))


def exact_tables(entry: Callable[[Column, Column], Column]) -> Column:
    """Of a family's combinations, in order, an entry with the exact row from its joint of all parents.

    Cells are parted by the first parent's state, so that a combination looks through those of its own only.
    """
    value = lambda g: F.transform("states", lambda s: _zero(F.get(F.filter(g, lambda m: m["child_state"] == s), F.lit(0))["p"]))
    row = lambda own, combo: entry(combo, N.exact_row(N.bound(F.filter(own, lambda m: m["combo"] == combo), value)))

    def of(state: Column, rest: Column) -> Column:
        own = F.filter("multi", lambda m: F.get(m["combo"], F.lit(0)).eqNullSafe(state))
        return N.bound(own, lambda own: F.transform(rest, lambda r: N.bound(F.array_prepend(r, state), lambda c: row(own, c))))

    others = N.combinations(F.slice("lists", F.lit(2), F.size("lists") - 1))
    return N.bound(others, lambda rest: F.flatten(F.transform(F.get("lists", F.lit(0)), lambda s: of(s, rest))))


def tables(marginal: DataFrame, joint: DataFrame, multi_joint: DataFrame, edges: DataFrame, node_state: DataFrame, exponent: int = 1) -> DataFrame:
    """(bn_id, node, kind, states, parents, lists, found): a row a node; found: (combo, values) of each combination of its parents' states."""
    nets = packed(states=(node_state, ["node", "state_pos", "state"]), edges=(edges, ["edge_pos", "parent", "child"]), marginal=(marginal, ["node", "state", "p"]),
                  joint=(joint, ["parent", "child", "parent_state", "child_state", "p"]), multi=(multi_joint, ["child", "combo", "child_state", "p"]))
    rows = families(nets)
    n = F.size("parents")
    kind = F.when(n == 0, "prior").when(n == 1, "matrix").when(F.size("multi") > 0, "exact").otherwise("naive_bayes")
    none = ~F.exists("values", lambda x: x.isNotNull())
    prior = F.when(none, N.uniform(F.size("states"))).otherwise(N.prior_row(F.col("values")))
    entry = lambda combo, values: F.struct(combo.alias("combo"), values.alias("values"))
    combos = N.combinations(F.col("lists"))
    place = lambda states, s: (F.array_position(states, s) - 1).cast("int")
    given = lambda tables, combo: F.transform(tables, lambda t, k: F.get(t, place(F.get("lists", k), F.get(combo, k))))
    found = (
        F.when(n == 0, F.array(entry(F.array().cast("array<string>"), prior)))
        .when(n == 1, F.zip_with(F.get("lists", F.lit(0)), F.get(conditional_tables(), F.lit(0)), lambda s, v: entry(F.array(s), v)))
        .when(F.size("multi") > 0, exact_tables(entry))
        .otherwise(N.bound(conditional_tables(), lambda t: F.transform(combos, lambda c: entry(c, N.naive_bayes_row(given(t, c), F.col("values"), exponent)))))
    )
    return rows.select("bn_id", "node", kind.alias("kind"), "states", "parents", "lists", found.alias("found"))


def all_cpds(marginal: DataFrame, joint: DataFrame, multi_joint: DataFrame, edges: DataFrame, node_state: DataFrame, exponent: int = 1) -> DataFrame:
    """(bn_id, node, kind, combo_pos, combo, states, values): a row a combination of parents' states, of one table a node."""
    return opened(tables(marginal, joint, multi_joint, edges, node_state, exponent))


def opened(tables: DataFrame) -> DataFrame:
    """Tables of a node a row, to a row a combination."""
    return tables.select("bn_id", "node", "kind", "states", F.posexplode("found").alias("combo_pos", "r")).select("bn_id", "node", "kind", "combo_pos", "r.combo", "states", "r.values")
