"""What moves between tasks grows no faster than the tables."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from beliefmill.functions import numeric as N
from beliefmill.operators import evaluate, graph, network_records, packed, prob
from beliefmill.plans import oracles
from beliefmill.plans.empirical import FAMILIES, NAMES, NODES, corpus
from beliefmill.plans.queries import QUERIES, _dag, _divergence, _matrices, _raw_lines
from beliefmill.sources import files

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_of_all_networks_are_not_broadcast(spark):
    """They look as small as the networks' ids, and hold dozens of rows of each."""
    c = corpus(spark, SF)
    for df in (c.nodes, c.node_state, c.variant, c.edges, _dag(c), graph.roots(c.edges, c.nodes)):
        assert "Broadcast" not in plan(c.bn.select("bn_id").join(df, "bn_id"))


def test_a_network_is_counted_in_one_task(spark):
    """So sums over a network's rows are made before they are moved."""
    c = corpus(spark, SF)
    files = c.cells.select("nk", F.input_file_name().alias("f")).distinct().groupBy("nk").count()
    assert files.count() == 25 and files.where("count > 1").isEmpty()


def test_cells_of_a_network_dont_grow_with_its_lines(spark):
    """600 lines a network here; their seven states together would make about as many cells."""
    sizes = [len(ss) for _, ss in NODES]
    most = sum(math.prod(sizes[NAMES.index(x)] for x in family) for family in FAMILIES)
    c = corpus(spark, "/root/testdata/sf0.01")
    assert c.cells.groupBy("nk").count().agg(F.max("count")).first()[0] <= most


def test_states_that_no_node_names_are_counted(spark, tmp_path):
    con = duckdb.connect()
    odd = {
        "part": "case p_partkey % 7 when 0 then null when 1 then 'ODD' else p_type end as p_type",
        "orders": "case o_orderkey % 11 when 0 then null when 3 then '9-NEW' else o_orderpriority end as o_orderpriority, case o_orderkey % 13 when 0 then null when 2 then 'Z' else o_orderstatus end as o_orderstatus",
        "customer": "case c_custkey % 5 when 0 then null when 1 then '' else c_mktsegment end as c_mktsegment",
        "lineitem": "case when l_linenumber = 2 then null else l_quantity end as l_quantity, case l_partkey % 3 when 0 then null when 1 then 'none' else l_linestatus end as l_linestatus, case l_suppkey % 4 when 0 then null when 1 then 'Q' else l_returnflag end as l_returnflag",
    }
    for name, values in odd.items():
        con.execute(f"COPY (SELECT * REPLACE ({values}) FROM '{SF}/{name}.parquet') TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet')")
    c = corpus(spark, str(tmp_path))
    for n, made in (("n", c), ("e", c.even())):
        tables = "WITH" + oracles.CELLS + oracles.base(n)
        for found, columns, name in ((made.marginal, "bn_id, node, state, p", "marginal"), (made.joint, "bn_id, parent, child, parent_state, child_state, p", "joint")):
            want = con.execute(f"{tables} SELECT {columns.replace('parent_state', 'ps').replace('child_state', 'cs')} FROM {name}").fetchall()
            got = [tuple(r) for r in found.select(*columns.split(", ")).collect()]
            assert sorted(map(str, got)) == sorted(map(str, want)) and any(None in r for r in got)


def test_matrices_are_made_without_a_row_a_cell_and_not_broadcast(spark):
    """The rows of a matrix come from one place, so no shuffle is needed to put them together."""
    c = corpus(spark, SF)
    assert "Generate explode(transform" not in plan(_matrices(c)) and "posexplode" not in plan(_matrices(c))
    assert "posexplode" not in plan(_divergence(spark, SF)) and "Broadcast" not in plan(c.bn.select(F.col("bn_id").alias("sg_id")).join(_matrices(c), "sg_id"))
    long = evaluate.matrices(prob.pairwise_nullable(c.joint, c.edges, c.node_state, 0.001).withColumnRenamed("bn_id", "sg_id"))
    got, want = (sorted(map(str, df.select("sg_id", "parent", "child", "m").collect())) for df in (_matrices(c), long))
    assert got == want and len(got) == 175


def test_exact_rows_look_through_cells_of_the_first_parents_state_only(spark):
    """Cells are parted by it first; the rows are those of looking through all of them."""
    cells = [(c, [a, b], s, p) for c, a, b, s, p in [("C", "a1", "b1", "x", 0.1), ("C", "a1", "b1", "x", 0.9), ("C", None, "b1", "y", 0.2), ("C", "a2", "b2", "x", 0.3), ("C", "a2", None, "y", 0.4), ("C", "other", "b1", "x", 0.5)]]
    lists = [["a1", None, "a2", "a1"], ["b1", "b2", None]]
    schema = "lists array<array<string>>, states array<string>, multi array<struct<child:string,combo:array<string>,child_state:string,p:double>>"
    one = spark.createDataFrame([(lists, ["x", "y"], cells), ([["a1"], ["b1"], ["c1"]], ["x"], [])], schema)
    entry = lambda combo, values: F.struct(combo.alias("combo"), values.alias("values"))
    value = lambda c, s: F.coalesce(F.get(F.filter("multi", lambda m: (m["combo"] == c) & (m["child_state"] == s)), F.lit(0))["p"], F.lit(0.0))
    every = F.transform(N.combinations(F.col("lists")), lambda c: entry(c, N.exact_row(F.transform("states", lambda s: value(c, s)))))
    for got, want in one.select(packed.exact_tables(entry), every).collect():
        assert got == want


def test_runs_are_the_groups_of_sorted_rows(spark):
    rows = spark.createDataFrame([([1, 1, None, None, 2, 1],), ([],), (None,)], "a array<int>")
    assert [r[0] for r in rows.select(N.runs(F.col("a"), lambda x: x)).collect()] == [[[1, 1], [None, None], [2], [1]], [], []]


def test_raw_records_are_made_once(spark, monkeypatch):
    """Files in order of position take a pass that looks for ranges; it reads made records."""
    seen = []
    monkeypatch.setattr(files, "write_lines", lambda rows, path: seen.append(plan(rows)))
    _raw_lines(spark, SF)
    assert "Scan parquet" in seen[0] and "Join" not in seen[0] and "Aggregate" not in seen[0]


def test_graphs_of_records_are_worked_out_once(spark):
    """The fold that accepts edges, which carries what can be reached, isn't part of the plan that draws."""
    lines = spark.createDataFrame([("0", '{"id": "x", "nodes": [{"name": "A", "states": ["t", "f"]}, {"name": "B", "states": ["t"]}], "edges": [{"parent": "A", "child": "B"}]}')], "bn_id string, record string")
    _, svgs = network_records.cpd_records(network_records.parsed(lines), F.lit("p"))
    assert "reach" not in plan(svgs) and svgs.count() == 1


def test_draws_are_led_without_broadcasts(spark, monkeypatch):
    """Written numbers, networks and sets look far smaller than their rows; what is written on the way counts too."""
    plans, kept = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: plans.append(plan(df)) or kept(df, name))
    plans.append(plan(QUERIES["subgraph_drawn"](spark, SF)))
    plans.append(plan(graph.networks(*(spark.createDataFrame([], s) for s in ("bn_id string, parent string, child string", "bn_id string, node string")))))
    assert len(plans) > 5 and not any("Broadcast" in p for p in plans)


def test_sets_are_listed_once_to_count_and_check_draws(spark):
    """All sets grow in one place of the plan, six steps up to seven members."""
    p = plan(QUERIES["subgraph_drawn"](spark, SF))
    assert p.count("Generate explode(CASE WHEN") == 6 and "Join LeftSemi" not in p
