"""Networks as records of JSON text: opened into long tables, and closed again with their probability tables.

A record is text throughout, so whatever fields it has beside the known ones stay as they are written.
Its key bn_id is its place among the records, as two records may carry one id.
"""

from __future__ import annotations

from collections.abc import Callable
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import variants as V
from ..functions.numeric import bound, runs
from ..functions.staging import written
from . import extract, graph, packed, prob, render

SCHEMA = """id string, title string, domain string, topological_order array<string>, cpds array<string>,
nodes array<struct<name:string,states:array<string>>>, edges array<struct<parent:string,child:string>>,
marginals map<string,map<string,string>>, joints array<struct<parent:string,child:string,table:map<string,map<string,string>>>>,
multi_joints array<struct<child:string,parents:array<string>,table:string>>, priors array<struct<node:string,distribution:map<string,string>>>,
raw_scores array<struct<parent:string,parent_state:string,child:string,has_relationship:boolean>>, generated_text string, text string"""

#: How a table was derived, by its kind.
DERIVATIONS = {
    "matrix": "P(child|parent) = P(child,parent) / P(parent)",
    "naive_bayes": "Naive Bayes: P(C|A,B) ∝ P(C|A)×P(C|B)/P(C)",
    "exact": "Exact: P(C|parents) = P(C,parents) / P(parents)",
}


def quoted(text: Column) -> Column:
    """A string as JSON."""
    return bound(F.to_json(F.array(text)), lambda array: F.substr(array, F.lit(2), F.length(array) - 2))


def parsed(records: DataFrame) -> DataFrame:
    """records (bn_id, record) with the struct j of the known fields, written; j is null where the text is no JSON object.

    An edge to or from a node that the record doesn't list, or no list of nodes or of edges, makes j.nodes
    null: such a record has no tables.
    """
    rows = records.withColumn("j", F.when(F.col("record").rlike(r"^\s*\{"), F.from_json("record", SCHEMA)))
    names = F.transform("j.nodes", lambda n: n["name"])
    known = F.forall("j.edges", lambda e: F.array_contains(names, e["parent"]) & F.array_contains(names, e["child"]))
    usable = F.coalesce(known & (F.size("j.nodes") > 0), F.lit(False))
    return written(rows.withColumn("j", F.when(usable, F.col("j")).otherwise(F.col("j").withField("nodes", F.lit(None)))), "records")


def tables(records: DataFrame) -> SimpleNamespace:
    """Long tables nodes, node_state, edges, marginal, joint and multi_joint of parsed records; each reads its own fields only."""
    usable = records.where("j.nodes is not null")
    nodes, node_state = extract.parse_nodes(usable)
    return SimpleNamespace(nodes=nodes, node_state=node_state, edges=extract.parse_edges(usable), marginal=extract.parse_marginals(usable),
                           joint=extract.parse_joints(usable), multi_joint=extract.parse_multi_joints(usable))


def nested(parents: Column, found: Column, inner: Callable[[Column], Column] = F.to_json) -> Column:
    """{"parent=state": {"parent=state": [p, …]}} of an array column of (combo, values), one level a parent; inner: values as JSON.

    Combinations come in the order of their states, the last parent's fastest. From one to the next, the
    levels that both share stay open and the others are closed and opened anew.
    """
    depth = F.size(parents)

    def leaf(row: Column, i: Column) -> Column:
        before = F.get(found, i - 1)["combo"]
        shared = F.coalesce(F.size(F.filter(F.sequence(F.lit(1), depth), lambda n: F.slice(row["combo"], F.lit(1), n) == F.slice(before, F.lit(1), n))), F.lit(0))
        return bound(F.when(i == 0, 0).otherwise(shared), lambda shared: written_from(row, i, shared))

    def written_from(row: Column, i: Column, shared: Column) -> Column:
        opened = lambda a: F.slice(a, shared + 1, depth - shared)
        names = F.zip_with(opened(parents), opened(row["combo"]), lambda p, s: quoted(F.concat(p, F.lit("="), s)))
        start = F.when(i == 0, "{").otherwise(F.concat(F.repeat(F.lit("}"), depth - 1 - shared), F.lit(", ")))
        return F.concat(start, F.array_join(names, ": {"), F.lit(": "), inner(row["values"]))

    return F.concat(F.array_join(F.transform(found, leaf), ""), F.repeat(F.lit("}"), depth))


def entries(tables: DataFrame) -> DataFrame:
    """(bn_id, node, entry) of packed.tables: the table of a node as JSON, a prior, a matrix (a row a state of the node) or nested."""
    head = F.concat(F.lit('{"node": '), quoted(F.col("node")), F.lit(', "node_states": '), F.to_json("states"))
    derived = F.concat(F.lit(', "derivation": '), F.create_map(*(F.lit(x) for k, v in DERIVATIONS.items() for x in (k, f'"{v}"')))[F.col("kind")], F.lit("}"))
    prior = F.concat(head, F.lit(', "parents": [], "prior": '), F.to_json(F.get("found", F.lit(0))["values"]), F.lit("}"))
    matrix = F.transform("states", lambda s, i: F.transform("found", lambda r: F.get(r["values"], i)))
    single = F.concat(head, F.lit(', "parent": '), quoted(F.get("parents", F.lit(0))), F.lit(', "parent_states": '), F.to_json(F.get("lists", F.lit(0))), F.lit(', "matrix": '), F.to_json(matrix), derived)
    listed = F.to_json(F.zip_with("parents", "lists", lambda p, s: F.struct(p.alias("name"), s.alias("states"))))
    many = F.concat(head, F.lit(', "parents": '), listed, F.lit(', "cpd": '), nested(F.col("parents"), F.col("found")), derived)
    return tables.select("bn_id", "node", F.when(F.col("kind") == "prior", prior).when(F.col("kind") == "matrix", single).otherwise(many).alias("entry"))


def with_fields(record: Column, fields: dict[str, Column]) -> Column:
    """A record's text with fields, whose values are JSON, at its end.

    Fields that it has already are taken out first; such a record is written anew, names in nested objects sorted.
    """
    there = F.arrays_overlap(F.json_object_keys(record), F.array(*map(F.lit, fields)))
    other = F.to_json(F.map_filter(F.from_json(record, "map<string,variant>"), lambda k, v: ~k.isin(*fields)))
    added = F.concat_ws(", ", *(F.concat(F.lit(f'"{name}": '), value) for name, value in fields.items()))
    body = F.regexp_replace(F.when(there, other).otherwise(record), r"\s*\}\s*$", "")
    return bound(body, lambda body: F.concat(body, F.when(body.rlike(r"^\s*\{\s*$"), "").otherwise(", "), added, F.lit("}")))


def json_array(parts: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(parts, ", "), F.lit("]"))


def _distinct(rows: Column, of: Callable[[Column], Column]) -> Column:
    return F.array_distinct(F.transform(rows, of))


def _as_map(cells: Column, key: str, value: str = "p") -> Column:
    return F.map_from_entries(F.transform(cells, lambda c: F.struct(c[key], c[value])))


def raw_records(titles: DataFrame, t: SimpleNamespace) -> DataFrame:
    """(bn_id, record): networks of long tables, as `tables` opens them, as records again.

    titles (bn_id, …): the fields that each record begins with. Then come nodes, edges, topological_order, marginals,
    joints and multi_joints, and the numbers of nodes and edges. All tables meet in one shuffle by bn_id.
    """
    order = graph.topological(graph.levels(t.edges, t.nodes))
    nets = packed.packed(nodes=(t.nodes, ["node_pos", "node"]), states=(t.node_state, ["node", "state_pos", "state"]), edges=(t.edges, ["edge_pos", "parent", "child"]), order=(order, ["topo_pos", "node"]),
                         marginal=(t.marginal, ["node", "state", "p"]), joint=(t.joint, ["parent", "child", "parent_state", "child_state", "p"]), multi=(t.multi_joint, ["child", "combo", "child_state", "p"]))
    nets = nets.select("bn_id", *(F.array_sort(c).alias(c) for c in nets.columns[1:]))
    nodes = F.transform("nodes", lambda n: F.struct(n["node"].alias("name"), F.transform(F.filter("states", lambda s: s["node"] == n["node"]), lambda s: s["state"]).alias("states")))
    edges = F.transform("edges", lambda e: F.struct(e["parent"].alias("parent"), e["child"].alias("child")))

    def marginal(n: Column) -> Column:
        return F.struct(n, _as_map(F.filter("marginal", lambda m: m["node"] == n), "state"))

    first = lambda rows: F.get(rows, F.lit(0))

    def joint(own: Column) -> Column:
        table = F.map_from_entries(F.transform(runs(own, lambda c: c["parent_state"]), lambda cells: F.struct(first(cells)["parent_state"], _as_map(cells, "child_state"))))
        return F.struct(first(own)["parent"].alias("parent"), first(own)["child"].alias("child"), table.alias("table"))

    def multi(own: Column) -> Column:
        child = first(own)["child"]
        parents = _distinct(F.filter("edges", lambda e: e["child"] == child), lambda e: e["parent"])
        rows = F.transform(runs(own, lambda c: c["combo"]), lambda cells: F.struct(first(cells)["combo"].alias("combo"), cells.alias("values")))
        table = bound(F.struct(parents.alias("parents"), rows.alias("rows")), lambda x: nested(x["parents"], x["rows"], lambda cells: F.to_json(_as_map(cells, "child_state"))))
        return F.concat(F.lit('{"child": '), quoted(child), F.lit(', "parents": '), F.to_json(parents), F.lit(', "table": '), table, F.lit("}"))

    fields = {
        "nodes": F.to_json(nodes), "edges": F.to_json(edges), "topological_order": F.to_json(F.transform("order", lambda o: o["node"])),
        "marginals": F.to_json(F.map_from_entries(F.transform(_distinct(F.col("marginal"), lambda m: m["node"]), marginal))),
        "joints": F.to_json(F.transform(runs(F.col("joint"), lambda c: F.struct(c["parent"], c["child"])), joint)),
        "multi_joints": json_array(F.transform(runs(F.col("multi"), lambda c: c["child"]), multi)),
        "n_nodes": F.size("nodes").cast("string"), "n_edges": F.size("edges").cast("string"),
    }
    given = [c for c in titles.columns if c != "bn_id"]
    made = nets.select("bn_id", with_fields(F.lit("{}"), fields).alias("body"))
    head = F.regexp_replace(F.to_json(F.struct(*given), {"ignoreNullFields": "false"}), r"\}$", "")
    return titles.join(made, "bn_id").select("bn_id", F.concat(head, F.lit(", "), F.substring("body", 2, 1 << 30)).alias("record"))


def cpd_records(records: DataFrame, drawn: Column) -> tuple[DataFrame, DataFrame]:
    """Parsed records (bn_id, …, record, j) with cpds, cpd_issues and svg_path at their end, and (bn_id, svg).

    The first result has the columns of records without j, the new text as record, and status: ok, warn
    where a table doesn't sum to 1, error where there is nothing to work out (the record stays as it is).
    drawn: the path of a record's drawing.
    """
    t = tables(records)
    made = written(packed.tables(t.marginal, t.joint, t.multi_joint, t.edges, t.node_state), "cpd-tables")
    own = entries(made).groupBy("bn_id").agg(F.map_from_entries(F.collect_list(F.struct("node", "entry"))).alias("entries"))
    issues = prob.verify(prob.cells(packed.opened(made), "bn_id", "node", "kind", "combo_pos", "combo"), prob.parent_map(t.edges))
    issues = issues.groupBy("bn_id").agg(F.array_sort(F.collect_list("issue")).alias("issues"))
    met = records.join(own, "bn_id", "left").join(issues, "bn_id", "left")
    names = F.array_distinct(F.transform("j.nodes", lambda n: n["name"]))
    listed = F.filter(F.transform(names, lambda n: F.col("entries")[n]), lambda e: e.isNotNull())
    found = F.coalesce("issues", F.array().cast("array<string>"))
    text = with_fields(F.col("record"), {"cpds": json_array(listed), "cpd_issues": F.to_json(found), "svg_path": quoted(drawn)})
    status = F.when(F.col("entries").isNull(), "error").when(F.size(found) > 0, "warn").otherwise("ok")
    told = met.withColumns({"status": status, "record": F.when(F.col("entries").isNotNull(), text).otherwise(F.col("record"))})
    titles = records.where("j.nodes is not null").select("bn_id", F.col("j.title").alias("title"), F.col("j.id").alias("id"))
    kept = written(graph.validate_dag(t.edges, t.nodes), "record-dag").hint("merge")  # levels and drawings read it three times
    svgs = render.drawings(graph.levels(kept, t.nodes), kept, titles)
    return told.drop("j", "entries", "issues"), svgs


#: The field of a table's JSON that says how it was derived, after another field or before one.
_DERIVATION = r',\s*"derivation"\s*:\s*"(?:[^"\\]|\\.)*"|(?<=^\{)\s*"derivation"\s*:\s*"(?:[^"\\]|\\.)*"\s*,'


def compact_records(records: DataFrame, new_id: str = "new_id", places: int = 2) -> DataFrame:
    """(new_id, record) of parsed records with an id each: source id, title, domain, nodes, edges, order, and rounded tables.

    Fields that a record lacks are empty texts and arrays. Tables are rounded at any depth and lose their derivation; else
    they stay as they are. Records without nodes have a text of empty parts.
    """
    empty = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind))
    text = lambda c: quoted(F.coalesce(c, F.lit("")))
    nodes = F.to_json(empty("j.nodes", "array<struct<name:string,states:array<string>>>"))
    edges = F.to_json(empty("j.edges", "array<struct<parent:string,child:string>>"))
    cpds = F.transform(empty("j.cpds", "array<string>"), lambda e: V.rounded_json(F.regexp_replace(e, _DERIVATION, ""), places))
    parts = {"id": quoted(F.col(new_id)), "source_id": text("j.id"), "title": text("j.title"), "domain": text("j.domain"), "nodes": nodes, "edges": edges,
             "topological_order": F.to_json(empty("j.topological_order", "array<string>")), "cpds": json_array(cpds)}
    return records.select(new_id, with_fields(F.lit("{}"), parts).alias("record"))
