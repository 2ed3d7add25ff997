"""DuckDB SQL for the query catalogue."""

from __future__ import annotations

from .empirical import EDGES, GROUP, NAMES, NATIONS, NODES, VALID

ORACLES: dict[str, str] = {}


def r(x: str, d: int = 6) -> str:
    return f"(floor(({x}) * 1e{d} + 0.5) / 1e{d})"


def values(rows) -> str:
    q = lambda v: "'" + v + "'" if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(q, x)) + ")" for x in rows) + ")"


def base(n: str = "n", suffix: str = "") -> str:
    """CTEs of the empirical corpus; with a suffix, a second one beside it."""
    at = NAMES.index
    marginals = " UNION ALL ".join(f"SELECT nk, '{x}' AS node, v{i} AS state, sum({n}) AS c FROM cells GROUP BY nk, v{i}" for i, x in enumerate(NAMES))
    joints = " UNION ALL ".join(f"SELECT nk, '{a}' AS parent, '{b}' AS child, v{at(a)} AS ps, v{at(b)} AS cs, sum({n}) AS c FROM cells GROUP BY nk, v{at(a)}, v{at(b)}" for a, b in EDGES[:VALID])
    return f"""
bn{suffix} AS (SELECT nk, printf('bn_%05d', nk + 1) AS bn_id, sum({n})::BIGINT AS total FROM cells GROUP BY nk),
marginal{suffix} AS (SELECT bn_id, node, state, c::BIGINT / total AS p FROM ({marginals}) JOIN bn{suffix} USING (nk) WHERE c > 0),
joint{suffix} AS (SELECT bn_id, parent, child, ps, cs, c::BIGINT / total AS p FROM ({joints}) JOIN bn{suffix} USING (nk) WHERE c > 0)"""


CELLS = f"""
cells AS (SELECT (c_nationkey + c_custkey // {GROUP} * {NATIONS})::BIGINT AS nk, c_mktsegment AS v0, p_type AS v1, o_orderpriority AS v2, o_orderstatus AS v3,
  CASE WHEN l_quantity < 17 THEN 'low' WHEN l_quantity < 34 THEN 'mid' ELSE 'high' END AS v4, l_linestatus AS v5, l_returnflag AS v6,
  count(*) AS n, count(*) FILTER (l_orderkey % 2 = 0) AS e
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY ALL),"""
DEFS = f"""
nodes AS (SELECT * FROM {values(enumerate(NAMES))} t(node_pos, node)),
states AS (SELECT * FROM {values((x, i, s) for x, ss in NODES for i, s in enumerate([*ss, 'none']))} t(node, state_pos, state)),
edges AS (SELECT * FROM {values((i, a, b) for i, (a, b) in enumerate(EDGES))} t(edge_pos, parent, child)),"""
GRID = """
grid AS (SELECT bn.bn_id, e.parent, e.child, s.state_pos AS ps_pos, s.state AS ps, t.state_pos, t.state AS cs, coalesce(j.p, 0.0) AS p
  FROM bn, (SELECT * FROM edges WHERE edge_pos < 7) e JOIN states s ON s.node = e.parent JOIN states t ON t.node = e.child
  LEFT JOIN joint j ON j.bn_id = bn.bn_id AND j.parent = e.parent AND j.child = e.child AND j.ps = s.state AND j.cs = t.state),
rows AS (SELECT bn_id, parent, child, ps_pos, ps, list(p ORDER BY state_pos) AS j, list(cs ORDER BY state_pos) AS names FROM grid GROUP BY ALL),"""


def residue(a: str) -> str:
    return f"list_transform({a}, lambda x, i: CASE WHEN i = list_position({a}, list_max({a})) THEN {r(f'x + {r(f"1 - list_sum({a})")}')} ELSE x END)"


UNIFORM = f"list_transform(j, lambda x: {r('1.0::DOUBLE / len(j)')})"
COND = f"""
plain AS (SELECT *, list_sum(j) AS mass, CASE WHEN list_sum(j) < 0.001 THEN NULL ELSE list_transform(j, lambda x: {r('greatest(0.0, x) / list_sum(j)')}) END AS v FROM rows),
cond AS (SELECT bn_id, parent, child, ps_pos, ps, names, CASE WHEN mass < 0.001 THEN {UNIFORM} ELSE {residue('v')} END AS v FROM plain),"""


def corpus(*more: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE" if recursive else "WITH") + CELLS + DEFS + base() + "," + "".join(more)


def unnest(select: str, source: str, a: str = "v") -> str:
    """A row a state from lists names and `a`."""
    return f"SELECT {select}, i - 1 AS state_pos, names[i] AS state, {r(f'{a}[i]')} AS p FROM {source}, unnest(range(1, len(names) + 1)) AS u(i)"


def end(cte: str) -> str:
    return cte.rstrip().rstrip(",")


MARG = f"""
mrows AS (SELECT bn.bn_id, s.node, list(m.p ORDER BY s.state_pos) AS j, list(s.state ORDER BY s.state_pos) AS names FROM bn, states s LEFT JOIN marginal m ON m.bn_id = bn.bn_id AND m.node = s.node AND m.state = s.state GROUP BY ALL),
floored AS (SELECT *, list_transform(j, lambda x: greatest(0.001, coalesce(x, 0.001))) AS f FROM mrows),
shared AS (SELECT *, list_transform(f, lambda x: {r('x / list_sum(f)')}) AS v FROM floored),
prior AS (SELECT bn_id, node, names, {residue('v')} AS v FROM shared),"""

ORACLES["bn_marginals"] = end(corpus(MARG)) + " " + unnest("bn_id, node", "(SELECT *, CASE WHEN abs(list_sum(f) - 1) > 0.02 THEN v ELSE f END AS w FROM shared)", "w")
ORACLES["bn_joint_tables"] = end(corpus(GRID, """
f AS (SELECT *, greatest(0.0001, CASE WHEN p = 0 THEN 0.0001 ELSE p END) AS x FROM grid),
s AS (SELECT bn_id, parent, child, list_sum(list(x ORDER BY ps_pos, state_pos)) AS t FROM f GROUP BY ALL)""")) + f" SELECT bn_id, parent, child, ps_pos, ps AS parent_state, state_pos, cs AS child_state, {r('x / t')} AS p FROM f JOIN s USING (bn_id, parent, child)"
SINGLE = f"(SELECT child FROM edges WHERE edge_pos < {VALID} GROUP BY child HAVING count(*) = 1)"
ORACLES["bn_cpd_single"] = end(corpus(GRID, COND)) + " " + unnest("bn_id, child, ps AS combo", f"(SELECT * FROM cond WHERE child IN {SINGLE})")
NB = f"""
nb AS (SELECT a.bn_id, a.child, a.ps || '|' || b.ps AS combo, a.names, a.v AS va, b.v AS vb, list_transform(m.f, lambda x: greatest(0.001, x / list_sum(m.f))) AS pi
  FROM cond a JOIN edges ea ON ea.parent = a.parent AND ea.child = a.child JOIN cond b ON a.bn_id = b.bn_id AND a.child = b.child JOIN edges eb ON eb.parent = b.parent AND eb.child = b.child AND ea.edge_pos < eb.edge_pos
  JOIN floored m ON m.bn_id = a.bn_id AND m.node = a.child),
nbs AS (SELECT *, list_transform(pi, lambda x, i: greatest(0.001, greatest(0.001, va[i]) * greatest(0.001, vb[i]) / x)) AS s FROM nb),
nbv AS (SELECT *, list_transform(s, lambda x: {r('x / list_sum(s)')}) AS v FROM nbs),
nbr AS (SELECT bn_id, child, combo, names, {residue('v')} AS v FROM nbv),"""
ORACLES["bn_cpd_naive_bayes"] = end(corpus(GRID, COND, MARG, NB)) + " " + unnest("bn_id, child, combo", "nbr")
MULTI = f"""
three AS (SELECT bn_id, v1, v0, v4, sum(n)::BIGINT / any_value(total) AS p FROM cells JOIN bn USING (nk) GROUP BY ALL),
leaf AS (SELECT bn.bn_id, a.state_pos AS ap, b.state_pos AS bp, a.state || '|' || b.state AS combo, c.state_pos, c.state, t.p
  FROM bn, states a, states b, states c LEFT JOIN three t ON t.bn_id = bn.bn_id AND t.v1 = a.state AND t.v0 = b.state AND t.v4 = c.state
  WHERE a.node = 'part type' AND b.node = 'market segment' AND c.node = 'quantity band'),
leaves AS (SELECT bn_id, combo, list(coalesce(p, 0.0) ORDER BY state_pos) AS j, list(state ORDER BY state_pos) AS names FROM leaf GROUP BY ALL),
exv AS (SELECT *, CASE WHEN list_sum(j) < 0.001 THEN NULL ELSE list_transform(j, lambda x: {r('x / list_sum(j)')}) END AS v FROM leaves),
exact AS (SELECT bn_id, combo, names, CASE WHEN v IS NULL THEN {UNIFORM} ELSE {residue('v')} END AS v FROM exv),"""
ORACLES["bn_cpd_exact"] = end(corpus(MULTI)) + " " + unnest("bn_id, 'quantity band' AS child, combo", "exact")
ORACLES["bn_multi_joint_tables"] = end(corpus(MULTI, """
fl AS (SELECT *, greatest(0.0001, coalesce(p, 0.0001)) AS x FROM leaf),
tot AS (SELECT bn_id, list_sum(list(x ORDER BY ap, bp, state_pos)) AS t FROM fl GROUP BY ALL)""")) + f" SELECT bn_id, 'quantity band' AS child, combo, state_pos, state, {r('x / t')} AS p FROM fl JOIN tot USING (bn_id)"
ROOTS = f"(SELECT node FROM nodes WHERE node NOT IN (SELECT child FROM edges WHERE edge_pos < {VALID}))"
ALL = f"""
cpds AS (
  SELECT bn_id, node, 'prior' AS kind, '' AS combo, names, v FROM prior WHERE node IN {ROOTS}
  UNION ALL SELECT bn_id, child, 'matrix', ps, names, v FROM cond WHERE child IN {SINGLE}
  UNION ALL SELECT bn_id, 'quantity band', 'exact', combo, names, v FROM exact
  UNION ALL SELECT bn_id, child, 'naive_bayes', combo, names, v FROM nbr WHERE child <> 'quantity band'),"""
EVERY = corpus(GRID, COND, MARG, NB, MULTI, ALL)
ORACLES["bn_cpd_all"] = end(EVERY) + " " + unnest("bn_id, node, kind, combo", "cpds")
ORACLES["compact_record"] = end(EVERY) + f" SELECT replace(bn_id, 'bn_', 'compact_') AS new_id, bn_id AS source_id, node, combo, names[i] AS state, {r('v[i]', 2)} AS p FROM cpds, unnest(range(1, len(names) + 1)) AS u(i)"
NESTED = "CASE WHEN kind IN ('exact', 'naive_bayes') THEN 'nested' ELSE kind END AS kind"
ORACLES["cpd_records"] = end(EVERY) + " " + unnest(f"bn_id, 0 AS issues, node, {NESTED}, combo", "cpds")
ORACLES["compact_file"] = end(EVERY) + f""" SELECT printf('bn_%05d', row_number) AS id, bn_id AS source_id, 'market segment' AS first, node, {NESTED}, combo, i - 1 AS state_pos, names[i] AS state, {r('v[i]', 2)} AS p
  FROM cpds JOIN (SELECT bn_id, row_number() OVER (ORDER BY nk) AS row_number FROM bn) USING (bn_id), unnest(range(1, len(names) + 1)) AS u(i)"""
ORACLES["bn_prior"] = end(corpus(MARG)) + " " + unnest("bn_id, node", f"(SELECT * FROM prior WHERE node IN {ROOTS})")
ORACLES["bn_prior_uniform"] = end(corpus()) + f" SELECT bn_id, node, state_pos, state, {r('1.0::DOUBLE / count(*) OVER (PARTITION BY bn_id, node)')} AS p FROM bn, states WHERE node IN {ROOTS}"


def nullable(floor: float, related: str = "true") -> str:
    return f"""
pair AS (SELECT bn_id, parent, child, ps_pos, ps AS parent_state, state_pos, cs AS state,
  CASE WHEN {related} AND m >= 1e-9 AND (CASE WHEN m = 0 THEN NULL ELSE p / m END) >= {floor} THEN {r('p / m', 4)} END AS p FROM (SELECT g.*, list_sum(j) AS m FROM grid g JOIN rows USING (bn_id, parent, child, ps_pos))),"""


ORACLES["bn_pairwise_null"] = end(corpus(GRID, nullable(0.01, "NOT (child = 'line status' AND ps = 'P')"))) + " SELECT bn_id, parent, child, parent_state, state_pos, state, p FROM pair"
ORACLES["bn_verify"] = end(corpus(GRID, COND, MARG, NB, MULTI, ALL, nullable(0.2))) + f""" SELECT bn_id, child AS node, printf('%s|%s=%s col sums to %.4f', child, parent, parent_state, t) AS issue
  FROM (SELECT bn_id, parent, child, parent_state, list_sum(list(coalesce(p, 0.0) ORDER BY state_pos)) AS t FROM pair WHERE child IN {SINGLE} GROUP BY ALL) WHERE abs(t - 1) > 0.01
  UNION ALL SELECT bn_id, node, printf('%s|%s %s sums to %.4f', node, combo, kind, list_sum(v)) FROM cpds WHERE abs(list_sum(v) - 1) > 0.01"""
LABEL = "CASE WHEN p IS NULL THEN 'unknown' WHEN p >= 0.7 THEN 'strong' WHEN p >= 0.4 THEN 'moderate' WHEN p >= 0.1 THEN 'weak' ELSE 'rare' END"
ORACLES["strength_label"] = end(corpus(GRID, nullable(0.001))) + f" SELECT bn_id, child, {LABEL} AS label, count(*) AS n FROM pair GROUP BY ALL"
ORACLES["prompt_cpd_lines"] = end(corpus(GRID, nullable(0.001))) + f""" SELECT bn_id, child, parent, '[' || child || ' | ' || parent || ']' || chr(10) || coalesce(string_agg(
  printf('  P(%s=%s | %s=%s) = %.4f  [%s]', child, state, parent, parent_state, p, {LABEL}), chr(10) ORDER BY state_pos, ps_pos) FILTER (p IS NOT NULL), '  (no CPD data available)') AS section FROM pair GROUP BY bn_id, child, parent"""
ORACLES["bn_roots"] = end(corpus()) + f" SELECT bn_id, node FROM bn, nodes WHERE node IN {ROOTS}"
ORACLES["bn_parent_map"] = end(corpus()) + " SELECT bn_id, child, string_agg(parent, '|' ORDER BY edge_pos) AS parents FROM bn, edges WHERE edge_pos < 7 GROUP BY ALL"
ORACLES["bn_adjacency"] = end(corpus()) + """ SELECT bn_id, node, coalesce((SELECT string_agg(child, '|' ORDER BY child) FROM edges e WHERE e.parent = nodes.node AND edge_pos < 7), '') AS children,
  coalesce((SELECT string_agg(parent, '|' ORDER BY parent) FROM edges e WHERE e.child = nodes.node AND edge_pos < 7), '') AS parents FROM bn, nodes"""

DAG = """
known AS (SELECT nk, bn_id, edge_pos, parent, child, row_number() OVER (PARTITION BY nk ORDER BY edge_pos) AS rn FROM bn, edges WHERE edge_pos <> nk % 10 AND parent IN (SELECT node FROM nodes) AND child IN (SELECT node FROM nodes)),
fold AS (SELECT nk, 0::BIGINT AS rn, []::STRUCT(a VARCHAR, b VARCHAR)[] AS reach, []::INT[] AS kept FROM bn
  UNION ALL
  SELECT f.nk, e.rn,
    CASE WHEN parent = child OR len(list_filter(reach, lambda x: x.a = child AND x.b = parent)) > 0 THEN reach
    ELSE list_distinct(list_concat(reach, flatten(list_transform(list_append(list_transform(list_filter(reach, lambda x: x.b = parent), lambda x: x.a), parent),
      lambda y: list_transform(list_append(list_transform(list_filter(reach, lambda x: x.a = child), lambda x: x.b), child), lambda z: {'a': y, 'b': z}))))) END,
    CASE WHEN parent = child OR len(list_filter(reach, lambda x: x.a = child AND x.b = parent)) > 0 THEN kept ELSE list_append(kept, e.edge_pos::INT) END
  FROM fold f JOIN known e ON e.nk = f.nk AND e.rn = f.rn + 1),
dag AS (SELECT k.bn_id, k.nk, k.edge_pos, k.parent, k.child FROM (SELECT nk, arg_max(kept, rn) AS kept FROM fold GROUP BY nk) f JOIN known k ON k.nk = f.nk AND list_contains(f.kept, k.edge_pos::INT)),"""
LEVELS = """
walk AS (SELECT bn_id, node, 0 AS d FROM bn, nodes UNION SELECT w.bn_id, e.child, d + 1 FROM walk w JOIN dag e ON e.bn_id = w.bn_id AND e.parent = w.node),
lv AS (SELECT bn_id, node_pos, node, max(d) AS level FROM walk JOIN nodes USING (node) GROUP BY ALL),"""
ORACLES["dag_validate"] = end(corpus(DAG, recursive=True)) + " SELECT bn_id, edge_pos, parent, child FROM dag"
ORACLES["bn_levels"] = end(corpus(DAG, LEVELS, recursive=True)) + " SELECT bn_id, node, level FROM lv"
ORACLES["bn_topo"] = end(corpus(DAG, LEVELS, recursive=True)) + " SELECT bn_id, node, row_number() OVER (PARTITION BY bn_id ORDER BY level, node_pos) - 1 AS topo_pos FROM lv"
ORACLES["svg_layout"] = end(corpus(DAG, LEVELS, """
laid AS (SELECT *, row_number() OVER (PARTITION BY bn_id, level ORDER BY node_pos) - 1 AS i, count(*) OVER (PARTITION BY bn_id, level) AS n FROM lv),
wide AS (SELECT *, n * 160 + (n - 1) * 60 AS span FROM laid),
page AS (SELECT *, max(span) OVER (PARTITION BY bn_id) + 80 AS width, (max(level) OVER (PARTITION BY bn_id) + 1) * 138 + 80 AS height FROM wide)""", recursive=True)) + " SELECT bn_id, node, (width - span) // 2 + i * 220 + 80 AS x, 50 + level * 138 + 24 AS y, width, height, node AS label FROM page"
SETS = """
und AS (SELECT bn_id, parent AS a, child AS b FROM dag UNION SELECT bn_id, child, parent FROM dag),
sets AS (SELECT bn_id, [node] AS m FROM bn, nodes UNION SELECT s.bn_id, list_sort(list_append(s.m, u.b)) FROM sets s JOIN und u ON u.bn_id = s.bn_id AND list_contains(s.m, u.a) AND NOT list_contains(s.m, u.b) AND len(s.m) < 7),
subs AS (SELECT bn_id, m, len(m) AS size, bn_id || ':' || array_to_string(m, ',') AS sub_id FROM sets WHERE len(m) >= 3),"""
ORACLES["subgraph_enumerate"] = end(corpus(DAG, SETS, recursive=True)) + " SELECT bn_id, array_to_string(m, ',') AS members, size FROM subs"
ORACLES["subgraph_drawn"] = end(corpus(DAG, SETS, recursive=True)) + " SELECT bn_id, count(*) AS n_sets, least(8, count(*)) AS n_drawn, least(8, count(*)) AS n_different, least(8, count(*)) AS n_right FROM subs GROUP BY bn_id"
ORACLES["subgraph_counts"] = end(corpus(DAG, SETS, recursive=True)) + " SELECT bn_id, len(m) AS size, count(*) AS n FROM sets WHERE len(m) >= 2 GROUP BY ALL"
ORACLES["subgraph_required"] = end(corpus(DAG, """
und AS (SELECT bn_id, parent AS a, child AS b FROM dag UNION SELECT bn_id, child, parent FROM dag),
need AS (SELECT bn_id, ['order status', 'return flag'] AS m FROM bn UNION SELECT s.bn_id, list_sort(list_append(s.m, u.b)) FROM need s JOIN und u ON u.bn_id = s.bn_id AND list_contains(s.m, u.a) AND NOT list_contains(s.m, u.b) AND len(s.m) < 5)""", recursive=True)) + " SELECT bn_id, array_to_string(m, ',') AS members, len(m) AS size FROM need"
INDUCED = "ind AS (SELECT sub_id, s.bn_id, edge_pos, parent, child FROM subs s JOIN dag e ON e.bn_id = s.bn_id AND list_contains(m, parent) AND list_contains(m, child)),"
ORACLES["subgraph_induce"] = end(corpus(DAG, SETS, INDUCED, recursive=True)) + " SELECT sub_id, edge_pos, parent, child FROM ind"
ORACLES["subgraph_reroot"] = end(corpus(DAG, SETS, INDUCED, MARG, """
mem AS (SELECT sub_id, bn_id, unnest(m) AS node FROM subs),
cut AS (SELECT * FROM mem WHERE EXISTS (SELECT 1 FROM dag e WHERE e.bn_id = mem.bn_id AND e.child = mem.node) AND NOT EXISTS (SELECT 1 FROM ind i WHERE i.sub_id = mem.sub_id AND i.child = mem.node))""", recursive=True)) + " " + unnest("sub_id, node", "(SELECT sub_id, node, names, v FROM cut JOIN shared USING (bn_id, node))")
ORACLES["subgraph_recompute"] = end(corpus(DAG, SETS, INDUCED, GRID, nullable(0.001), "kept AS (SELECT DISTINCT sub_id, bn_id, parent, child FROM ind)", recursive=True)) + f" SELECT sub_id, k.parent, k.child, parent_state, state_pos, state, {r('p')} AS p FROM kept k JOIN pair USING (bn_id, parent, child)"
_PART = values([(x,) for x in [*dict(NODES)["part type"], "none"]])
ORACLES["subgraph_recompute_lacking"] = end(corpus(DAG, SETS, INDUCED, GRID, nullable(0.001), MARG, "kept AS (SELECT DISTINCT sub_id, bn_id, parent, child FROM ind)", recursive=True)) + f""" SELECT sub_id, k.parent, k.child, parent_state, state_pos, state, {r('p')} AS p FROM kept k JOIN pair USING (bn_id, parent, child) WHERE NOT (k.parent = 'part type' AND k.child = 'quantity band')
  UNION ALL SELECT sub_id, parent, node, parent_state, state_pos, state, p FROM (""" + unnest("sub_id, parent, node, parent_state", f"(SELECT sub_id, parent, node, t.parent_state, names, v FROM kept k JOIN shared s ON s.bn_id = k.bn_id AND s.node = k.child, {_PART} AS t(parent_state) WHERE k.parent = 'part type' AND k.child = 'quantity band')") + ")"
ORACLES["subgraph_sample_cap"] = end(corpus(DAG, SETS, """
picked AS (SELECT bn_id, sub_id, md5(sub_id || ':42') AS h FROM subs QUALIFY row_number() OVER (PARTITION BY bn_id ORDER BY md5(sub_id || ':42'), sub_id) <= 10)""", recursive=True)) + """ SELECT bn_id, sub_id FROM picked WHERE bn_id = 'bn_00001'
  UNION ALL SELECT bn_id, sub_id FROM (SELECT *, row_number() OVER (ORDER BY h, sub_id) AS rn FROM picked WHERE bn_id <> 'bn_00001') WHERE rn <= 100 - (SELECT count(*) FROM picked WHERE bn_id = 'bn_00001')"""

RECORDS = """WITH compact AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE printf('wiki_%05d', c_custkey) END AS source_id, c_custkey AS pos, c_mktsegment AS title FROM customer),
marg AS (SELECT printf('wiki_%05d', o_custkey) AS source_id, o_custkey AS pos, count(*) AS n_orders FROM orders WHERE o_custkey % 5 <> 0 GROUP BY o_custkey)"""
ORACLES["final_merge"] = RECORDS + " SELECT c.id, c.source_id, title, n_orders, CASE WHEN c.id % 3 = 0 THEN c_name ELSE '' END AS generated_text FROM compact c JOIN marg USING (source_id) JOIN customer ON c_custkey = c.id"
ORACLES["merge_skipped"] = RECORDS + " SELECT id, source_id FROM compact WHERE source_id NOT IN (SELECT source_id FROM marg)"
ORACLES["merge_positional"] = RECORDS + " SELECT id, c.source_id, title, n_orders FROM compact c JOIN marg m ON c.source_id = m.source_id WHERE c.source_id <> '' UNION ALL SELECT id, m.source_id, title, n_orders FROM compact c JOIN marg m ON c.pos = m.pos WHERE c.source_id = ''"
ORACLES["upsert"] = "SELECT o_orderkey AS id, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) THEN lower(min(o_orderstatus)) ELSE min(o_orderstatus) END AS status FROM orders GROUP BY o_orderkey"
ORACLES["resume_anti"] = "SELECT o_orderkey AS id, o_orderpriority FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)"
ORACLES["last_event"] = "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"
ORACLES["domain_quota"] = "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 10"
ORACLES["watch_dedup"] = "SELECT concat_ws(':', user_id, event_type) AS item, min(event_id) AS event_id, 'done' AS status FROM events GROUP BY ALL"
ORACLES["watch_attempts"] = """SELECT item, event_id, n::INT AS attempt, CASE WHEN value <= 20 THEN 'done' WHEN n = 3 THEN 'given up' ELSE 'failed' END AS status,
  CASE WHEN value > 20 THEN 'too dear' END AS error, CASE WHEN value <= 20 THEN value * 2 END AS answer
FROM (SELECT *, count(*) OVER (PARTITION BY item ORDER BY event_id) AS n, count(*) FILTER (value <= 20) OVER (PARTITION BY item ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS good
      FROM (SELECT concat_ws(':', user_id, event_type) AS item, event_id, value FROM events)) WHERE n <= 3 AND good = 0"""


def prf(m: str, g: str, q: str) -> tuple[str, str, str]:
    p, c = f"coalesce({m}::DOUBLE / nullif({q}, 0), 0)", f"coalesce({m}::DOUBLE / nullif({g}, 0), 0)"
    return r(f"coalesce(2 * {p} * {c} / nullif({p} + {c}, 0), 0)", 4), r(p, 4), r(c, 4)


def node_metrics() -> str:
    f1, p, c = prf("n_matched", "n_gt", "n_pred_eff")
    return f"""
nm AS (SELECT bn_id AS sg_id, nk, 7::BIGINT AS n_gt, (7 + nk % 3)::BIGINT AS n_pred, 6::BIGINT AS n_matched, 1::BIGINT AS n_extra, greatest(7 + nk % 3 - 1, 6)::BIGINT AS n_pred_eff FROM bn),
node_m AS (SELECT sg_id, n_gt, n_pred, n_matched, n_extra, n_pred_eff, {f1} AS node_f1, {p} AS node_precision, {c} AS node_recall, {r('n_matched * 100.0::DOUBLE / n_gt', 1)} AS pct_nodes_matched FROM nm),"""


def edge_metrics() -> str:
    f1, p, c = prf("n_correct_edges", "n_gt_edges", "n_pred_edges")
    return f"""
gt AS (SELECT DISTINCT bn_id AS sg_id, parent, child FROM dag),
pe AS (SELECT DISTINCT bn_id AS sg_id, parent, child FROM bn, edges WHERE edge_pos <> nk % 10 AND (edge_pos + nk) % 3 <> 0 AND 'order status' NOT IN (parent, child) AND child <> 'missing node'),
cnt AS (SELECT sg_id, count(g.parent) AS n_gt_edges, count(q.parent) AS n_pred_edges, count(*) FILTER (g.parent IS NOT NULL AND q.parent IS NOT NULL) AS n_correct_edges
  FROM (SELECT *, 1 AS o FROM gt) g FULL JOIN (SELECT *, 1 AS o FROM pe) q USING (sg_id, parent, child) GROUP BY sg_id),
edge_m AS (SELECT sg_id, n_gt_edges, n_pred_edges, n_correct_edges, n_pred_edges - n_correct_edges AS n_spurious_edges, {f1} AS edge_f1, {p} AS edge_precision, {c} AS edge_recall,
  {r('coalesce(n_correct_edges * 100.0::DOUBLE / nullif(n_gt_edges, 0), 0)', 1)} AS pct_correct_edges, {r('coalesce((n_pred_edges - n_correct_edges) * 100.0::DOUBLE / nullif(n_pred_edges, 0), 0)', 1)} AS pct_spurious_edges FROM cnt),"""


EDGE_M = edge_metrics().replace("count(g.parent)", "count(g.o)").replace("count(q.parent)", "count(q.o)").replace("g.parent IS NOT NULL AND q.parent IS NOT NULL", "g.o IS NOT NULL AND q.o IS NOT NULL")
ORACLES["eval_nodes"] = end(corpus(node_metrics())) + " SELECT * FROM node_m"
ORACLES["eval_edges"] = end(corpus(DAG, EDGE_M, recursive=True)) + " SELECT * FROM edge_m"
ORACLES["eval_by_size"] = end(corpus(node_metrics())) + " SELECT n_pred, node_f1 AS value, count(*) AS n FROM node_m GROUP BY ALL"
AGG = ", ".join(f"{r(f'avg({m})', 4)} AS {m}_mean, {r(f'stddev_pop({m})', 4)} AS {m}_std" for m in ("node_f1", "node_recall", "edge_f1", "pct_correct_edges", "n_extra"))
ORACLES["eval_aggregate"] = end(corpus(DAG, node_metrics(), EDGE_M, recursive=True)) + f" SELECT count(*) AS total, {AGG} FROM node_m FULL JOIN edge_m USING (sg_id)"
_F1, _P, _C = prf("m", "g", "q")
ORACLES["eval_states"] = end(corpus(base("e", "_e").replace("FROM cells", "FROM cells") + ",", f"""
seen AS (SELECT bn_id, node, count(DISTINCT lower(state)) AS q FROM marginal_e WHERE node <> 'order status' GROUP BY ALL),
per AS (SELECT bn.bn_id AS sg_id, n.node, (SELECT count(*) FROM states s WHERE s.node = n.node) AS g, coalesce(q, 0) AS q,
  CASE WHEN coalesce(q, 0) = 0 THEN 0 WHEN node_pos % 2 = 1 THEN greatest(coalesce(q, 0) - 1, 0) ELSE coalesce(q, 0) END AS m FROM bn JOIN nodes n ON true LEFT JOIN seen ON seen.bn_id = bn.bn_id AND seen.node = n.node),
one AS (SELECT sg_id, m, g, {_F1} AS f1, {_P} AS p, {_C} AS c FROM per)""")) + f" SELECT sg_id, {r('sum(round(f1 * 10000)::BIGINT) / 10000.0::DOUBLE / count(*)', 4)} AS state_f1, {r('sum(round(p * 10000)::BIGINT) / 10000.0::DOUBLE / count(*)', 4)} AS state_precision, {r('sum(round(c * 10000)::BIGINT) / 10000.0::DOUBLE / count(*)', 4)} AS state_recall, {r('sum(m) * 100.0::DOUBLE / sum(g)', 1)} AS pct_states_matched FROM one GROUP BY sg_id"


def divergence(p: str, q: str, name: str) -> str:
    """KL of the columns of two tables of cells, summed in state order, the mean over parent states."""
    return f"""
{name}_c AS (SELECT a.bn_id, a.parent, a.child, a.ps_pos, list(coalesce(a.p, 0.0) ORDER BY a.state_pos) AS x, list(coalesce(b.p, 0.0) ORDER BY a.state_pos) AS y FROM {p} a JOIN {q} b USING (bn_id, parent, child, ps_pos, state_pos) GROUP BY ALL),
{name}_n AS (SELECT *, CASE WHEN list_sum(x) > 0 THEN list_transform(x, lambda v: v / list_sum(x)) ELSE list_transform(x, lambda v: 1.0::DOUBLE / len(x)) END AS px, list_transform(z, lambda v: (greatest(0.0, v) + 1e-6) / (list_sum(list_transform(z, lambda w: greatest(0.0, w) + 1e-6)))) AS qy
  FROM (SELECT *, CASE WHEN list_sum(y) > 0 THEN list_transform(y, lambda v: v / list_sum(y)) ELSE list_transform(y, lambda v: 1.0::DOUBLE / len(y)) END AS z FROM {name}_c)),
{name} AS (SELECT bn_id, parent, child, {r(f'sum(k) / count(*)', 6)} AS kl FROM (SELECT *, list_sum(list_transform(px, lambda v, i: CASE WHEN v > 0 THEN v * ln(v / qy[i]) ELSE 0.0 END)) AS k FROM {name}_n) GROUP BY ALL),"""


TWO = corpus(GRID, nullable(0.001), base("e", "_e") + ",", GRID.replace("grid AS", "grid_e AS").replace("rows AS", "rows_e AS").replace("FROM grid", "FROM grid_e").replace("JOIN joint j", "JOIN joint_e j").replace("FROM bn,", "FROM bn_e bn,"), nullable(0.001).replace("pair AS", "pair_e AS").replace("FROM grid g JOIN rows", "FROM grid_e g JOIN rows_e"), divergence("pair", "pair_e", "fwd"), divergence("pair_e", "pair", "bwd"))
ORACLES["eval_cpd_kl"] = end(TWO) + f" SELECT bn_id AS sg_id, parent, child, {r('kl', 4)} AS kl FROM fwd"
ORACLES["eval_cpd_kl_sym"] = end(TWO) + f" SELECT bn_id AS sg_id, parent, child, {r(r('(f.kl + b.kl) / 2', 6), 4)} AS kl_symmetric FROM fwd f JOIN bwd b USING (bn_id, parent, child)"
ORACLES["eval_box"] = f"""WITH x AS (SELECT user_id % 5 AS n_nodes, value::DOUBLE AS x FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL),
q AS (SELECT n_nodes, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3 FROM x GROUP BY 1)
SELECT n_nodes, count(*) AS n, {r('q1')} AS q1, {r('median')} AS median, {r('q3')} AS q3, {r('least(min(x) FILTER (x >= q1 - (q3 - q1) * 1.5), q1)')} AS low, {r('greatest(max(x) FILTER (x <= q3 + (q3 - q1) * 1.5), q3)')} AS high FROM x JOIN q USING (n_nodes) GROUP BY n_nodes, q1, median, q3"""
REPLIES = r"""WITH e AS (SELECT event_id, props, CASE event_id % 4 WHEN 0 THEN 'hi ```json' || chr(10) || props || chr(10) || '``` bye' WHEN 1 THEN 'so {see} ' || props || ' y' WHEN 2 THEN props ELSE 'no json' END AS raw FROM events WHERE props IS NOT NULL)"""
ORACLES["json_extract_sliced"] = REPLIES + " SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '{see} ' || props WHEN 2 THEN props END AS json FROM e"
ORACLES["json_extract_fenced"] = REPLIES + " SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '{see} ' || props WHEN 2 THEN props END AS json, CASE WHEN event_id % 4 IN (0, 2) THEN TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS k FROM e"
_WANT = [("thion", "NODE: Thion"), ("and", "STATE: Thion=And"), ("of the", "STATE: Thion=of the"), ("la", "NODE: LA"), ("que", "STATE: LA=que"), ("nicht", "STATE: LA=nicht")]
ORACLES["text_coverage"] = "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN NOT contains(lower(coalesce(text, '')), '{w}') THEN '{m}' END" for w, m in _WANT) + "], lambda x: x IS NOT NULL), '; ') AS missing FROM documents"
ORACLES["word_filter"] = r"SELECT doc_id, n_words FROM (SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS n_words FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)) WHERE n_words BETWEEN 80 AND 800"
ORACLES["token_chunks"] = """WITH RECURSIVE e AS (SELECT user_id, event_id, cost, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM (SELECT user_id, event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) * 25 AS cost FROM events) WHERE cost IS NOT NULL),
f AS (SELECT user_id, event_id, rn, 0 AS chunk, cost::BIGINT AS used FROM e WHERE rn = 1
  UNION ALL SELECT e.user_id, e.event_id, e.rn, CASE WHEN used > 0 AND used + cost > 5000 THEN chunk + 1 ELSE chunk END, CASE WHEN used > 0 AND used + cost > 5000 THEN cost ELSE used + cost END FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
SELECT user_id, event_id, chunk FROM f"""

# Records
TITLES = f"""
titles AS (SELECT bn_id, nk, printf('wiki_%05d', nk) AS source_id, n_name AS title, r_name AS domain, CASE WHEN nk % 4 = 0 THEN '' ELSE 'Text of ' || n_name END AS generated_text
  FROM bn JOIN nation ON n_nationkey = nk % {NATIONS} JOIN region ON n_regionkey = r_regionkey),"""
VALIDATED = """
validated AS (SELECT bn_id, node, names, CASE WHEN abs(list_sum(f) - 1) > 0.02 THEN v ELSE f END AS w FROM shared),"""
COUNTS = """
counts AS (SELECT bn_id, 7 AS n_nodes, (SELECT count(DISTINCT (parent, child)) FROM dag d WHERE d.bn_id = bn.bn_id)::INT AS n_edges FROM bn),"""
PLACES = """
places AS (SELECT bn_id, child, parent, row_number() OVER (PARTITION BY bn_id, child ORDER BY edge_pos) - 1 AS parent_pos FROM dag),"""
ORACLES["final_record"] = end(corpus(DAG, LEVELS, GRID, nullable(0.01), MARG, TITLES, VALIDATED, COUNTS, PLACES, recursive=True)) + f"""
SELECT bn_id, source_id, title, domain, n_nodes, n_edges, node_pos, node, level, NULL::INT AS parent_pos, NULL AS parent, NULL::INT AS ps_pos, NULL AS parent_state, i - 1 AS state_pos, names[i] AS state, {r('w[i]', 4)} AS p
FROM titles JOIN counts USING (bn_id) JOIN lv USING (bn_id) JOIN validated USING (bn_id, node), unnest(range(1, len(names) + 1)) AS u(i)
WHERE NOT EXISTS (SELECT 1 FROM dag d WHERE d.bn_id = lv.bn_id AND d.child = lv.node)
UNION ALL SELECT bn_id, source_id, title, domain, n_nodes, n_edges, node_pos, node, level, parent_pos, parent, ps_pos, parent_state, state_pos, state, p
FROM titles JOIN counts USING (bn_id) JOIN lv USING (bn_id) JOIN places ON places.bn_id = lv.bn_id AND places.child = lv.node JOIN pair ON pair.bn_id = lv.bn_id AND pair.parent = places.parent AND pair.child = places.child"""
ORACLES["final_record"] = ORACLES["final_record"].replace("level, parent_pos, parent, ps_pos", "level, parent_pos, pair.parent, ps_pos").replace("SELECT bn_id, source_id, title, domain, n_nodes, n_edges, node_pos, node, level, parent_pos", "SELECT titles.bn_id, source_id, title, domain, n_nodes, n_edges, node_pos, node, level, parent_pos")
FILED = """
titles AS (SELECT bn_id, id, bn_id AS source_id, 'Network "' || nk || '"' AS title, 'trade' AS domain, CASE WHEN place % 4 = 0 THEN '' ELSE 'Text of ' || bn_id END AS generated_text
  FROM (SELECT bn_id, nk, row_number() OVER (ORDER BY nk) - 1 AS place, printf('bn_%05d', row_number() OVER (ORDER BY nk)) AS id FROM bn)),"""
WHOLE = f"""
dag AS (SELECT bn_id, nk, edge_pos, parent, child FROM bn, edges WHERE edge_pos < {VALID}),"""
ORACLES["final_file"] = ORACLES["final_record"].replace(DAG, WHOLE).replace(TITLES, FILED).replace("titles.bn_id, source_id", "bn_id, source_id").replace("SELECT bn_id, source_id, title, domain, n_nodes, n_edges", "SELECT id, source_id, title, domain, generated_text")
ORACLES["subgraph_record"] = end(corpus(DAG, SETS, INDUCED, GRID, nullable(0.001), MARG, TITLES, VALIDATED, """
named AS (SELECT *, bn_id || '_sub_' || printf('%03d', row_number() OVER (PARTITION BY bn_id ORDER BY size, m)) AS id FROM subs),
swalk AS (SELECT sub_id, unnest(m) AS node, 0 AS d FROM subs UNION SELECT w.sub_id, e.child, d + 1 FROM swalk w JOIN ind e ON e.sub_id = w.sub_id AND e.parent = w.node),
deep AS (SELECT sub_id, max(d) AS deepest FROM swalk GROUP BY sub_id),
mem AS (SELECT sub_id, bn_id, unnest(m) AS node FROM subs),
heads AS (SELECT * FROM mem WHERE NOT EXISTS (SELECT 1 FROM ind i WHERE i.sub_id = mem.sub_id AND i.child = mem.node)),
hp AS (SELECT sub_id, CASE WHEN EXISTS (SELECT 1 FROM dag e WHERE e.bn_id = h.bn_id AND e.child = h.node) THEN list_transform(v2.w, lambda x: x) ELSE NULL END AS cutv, v2.w, h.bn_id, h.node FROM heads h JOIN validated v2 USING (bn_id, node)),
hv AS (SELECT sub_id, len(w) AS n, CASE WHEN cutv IS NULL THEN list_transform(w, lambda x: floor(x * 1e4 + 0.5) / 1e4) ELSE list_transform(list_transform(w, lambda x: greatest(0.001, x)), lambda x, i: x) END AS a, cutv IS NOT NULL AS cut FROM hp),
hs AS (SELECT sub_id, n, CASE WHEN cut THEN list_transform(a, lambda x: floor(x / list_sum(a) * 1e6 + 0.5) / 1e6) ELSE a END AS a FROM hv),
hm AS (SELECT sub_id, sum(n)::BIGINT AS prior_rows, sum(list_sum(list_transform(a, lambda x: floor(x * 1e6 + 0.5)::BIGINT)))::BIGINT AS micro FROM hs GROUP BY sub_id),
cm AS (SELECT sub_id, count(*) AS cells, coalesce(sum(floor(p * 1e6 + 0.5)::BIGINT), 0)::BIGINT AS micro FROM (SELECT DISTINCT sub_id, bn_id, parent, child FROM ind) k JOIN pair USING (bn_id, parent, child) GROUP BY sub_id),
em AS (SELECT sub_id, count(DISTINCT (parent, child))::INT AS n_edges FROM ind GROUP BY sub_id)""", recursive=True)) + """
SELECT id, bn_id AS parent_id, title, domain, generated_text, size::INT AS n_nodes, coalesce(n_edges, 0) AS n_edges, deepest, prior_rows, coalesce(cells, 0) AS cells, (hm.micro + coalesce(cm.micro, 0))::BIGINT AS micro
FROM named JOIN titles USING (bn_id) JOIN deep USING (sub_id) JOIN hm USING (sub_id) LEFT JOIN cm USING (sub_id) LEFT JOIN em USING (sub_id)"""
ORACLES["corpus_metadata"] = end(corpus(TITLES)) + " SELECT count(*) AS total, count(*) FILTER (generated_text <> '') AS generated_total, 'star schema' AS source, 2 AS cpd_dp FROM titles"
ORACLES["missing_texts"] = end(corpus(TITLES)) + " SELECT bn_id, source_id, generated_text <> '' AS done FROM titles"
ORACLES["final_with_marginals"] = end(corpus()) + """ SELECT bn.bn_id, CASE WHEN nk % 3 <> 0 THEN count(DISTINCT node) ELSE 0 END::INT AS n_nodes, CASE WHEN nk % 3 <> 0 THEN count(m.state) ELSE 0 END::INT AS n_states
FROM bn JOIN marginal m USING (bn_id) GROUP BY bn.bn_id, nk"""
ORACLES["strict_status"] = end(corpus(GRID, nullable(0.2))) + f""", bad AS (SELECT DISTINCT bn_id FROM (SELECT bn_id, parent, child, parent_state, list_sum(list(coalesce(p, 0.0) ORDER BY state_pos)) AS t FROM pair WHERE child IN {SINGLE} GROUP BY ALL) WHERE abs(t - 1) > 0.01),
told AS (SELECT CASE WHEN bad.bn_id IS NULL THEN 'ok' ELSE 'warn' END AS status FROM bn LEFT JOIN bad USING (bn_id))
SELECT status, count(*) AS n FROM told GROUP BY status UNION ALL SELECT 'kept by strict', count(*) FILTER (status = 'ok') FROM told"""
ORACLES["subgraph_options"] = end(corpus(DAG, """
und AS (SELECT bn_id, parent AS a, child AS b FROM dag UNION SELECT bn_id, child, parent FROM dag),
need AS (SELECT bn_id, ['line status', 'return flag'] AS m FROM bn WHERE nk % 2 = 1 UNION SELECT s.bn_id, list_sort(list_append(s.m, u.b)) FROM need s JOIN und u ON u.bn_id = s.bn_id AND list_contains(s.m, u.a) AND NOT list_contains(s.m, u.b) AND len(s.m) < 5),
allsets AS (SELECT bn_id, [node] AS m FROM bn, nodes WHERE nk % 5 = 0 UNION SELECT s.bn_id, list_sort(list_append(s.m, u.b)) FROM allsets s JOIN und u ON u.bn_id = s.bn_id AND list_contains(s.m, u.a) AND NOT list_contains(s.m, u.b))""", recursive=True)) + """
SELECT bn_id, array_to_string(m, ',') AS members, len(m)::INT AS size, 'grown' AS kind FROM need
UNION ALL SELECT bn_id, 'market segment,return flag', 2, 'alone' FROM bn UNION ALL SELECT bn_id, array_to_string(m, ','), len(m)::INT, 'must' FROM allsets WHERE len(m) >= 7"""
ORACLES["row_slice"] = "WITH p AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders), m AS (SELECT max(pos) // 2 AS m FROM p) SELECT id, pos FROM p, m WHERE pos >= m AND pos < m + 100"
ORACLES["title_collection"] = r"""WITH d AS (SELECT source, doc_id, array_to_string(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')[1:3], ' ') AS title FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
q AS (SELECT source AS domain, dense_rank() OVER (ORDER BY source) AS dp, doc_id % 5 AS sp, doc_id AS rp, title FROM d WHERE NOT contains(title, ':')),
f AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY title ORDER BY dp, sp, rp, domain) = 1),
e AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY domain ORDER BY sp, rp, title) <= 60)
SELECT domain, title, row_number() OVER (PARTITION BY domain ORDER BY md5(title || ':42'), title) AS rank FROM e QUALIFY rank <= 20"""

# The evaluation run
RUN = f"""
kinds AS (SELECT bn_id AS sg_id, nk, CASE WHEN (nk + 1) % 11 = 2 THEN 'no_generated_text' WHEN nk % 11 = 2 THEN 'pass1_failed' WHEN nk % 11 = 3 THEN 'no_nodes_extracted' WHEN nk % 11 = 4 THEN 'node_judge_failed' WHEN nk % 11 = 5 THEN 'no_node_matches' END AS error FROM bn),
seen AS (SELECT bn_id, node, list_sort(list(DISTINCT lower(state))) AS s FROM marginal_e GROUP BY ALL),
per AS (SELECT bn.bn_id AS sg_id, n.node, node_pos, (SELECT count(*) FROM states s WHERE s.node = n.node) AS g, coalesce(s, []) AS s FROM bn JOIN nodes n ON n.node <> 'order status' LEFT JOIN seen ON seen.bn_id = bn.bn_id AND seen.node = n.node),
pq AS (SELECT sg_id, g, len(s) + 1 + CASE WHEN node = 'part type' THEN 1 + CASE WHEN list_contains(s, 'economy') THEN 0 ELSE 1 END ELSE 0 END AS q,
  CASE WHEN node_pos % 2 = 1 THEN greatest(len(s) - 1, 0) ELSE len(s) + 1 + CASE WHEN node = 'part type' AND NOT list_contains(s, 'economy') THEN 1 ELSE 0 END END AS m FROM per),
st AS (SELECT sg_id, m, g, {prf('m', 'g', 'q')[0]} AS f1, {prf('m', 'g', 'q')[1]} AS p, {prf('m', 'g', 'q')[2]} AS c FROM pq),
state_m AS (SELECT sg_id, {r('sum(round(f1 * 10000)::BIGINT) / 10000.0::DOUBLE / count(*)', 4)} AS state_f1, {r('sum(round(p * 10000)::BIGINT) / 10000.0::DOUBLE / count(*)', 4)} AS state_precision,
  {r('sum(round(c * 10000)::BIGINT) / 10000.0::DOUBLE / count(*)', 4)} AS state_recall, {r('sum(m) * 100.0::DOUBLE / sum(g)', 1)} AS pct_states_matched FROM st GROUP BY sg_id),
kl_m AS (SELECT f.bn_id AS sg_id, {r('sum(floor(f.kl * 1e6 + 0.5)) / 1e6 / count(*)')} AS cpd_kl, {r('sum(floor((f.kl + b.kl) / 2 * 1e6 + 0.5)) / 1e6 / count(*)')} AS cpd_kl_symmetric, count(*) AS n_cpd_evaluated
  FROM fwd f JOIN bwd b USING (bn_id, parent, child) JOIN gt ON gt.sg_id = f.bn_id AND gt.parent = f.parent AND gt.child = f.child JOIN pe ON pe.sg_id = gt.sg_id AND pe.parent = gt.parent AND pe.child = gt.child GROUP BY 1),
total_states AS (SELECT count(*)::BIGINT AS n_total_states FROM states),
keep AS (SELECT sg_id, error IS NULL OR error = 'no_node_matches' AS scored, error IS NULL AS done, error FROM kinds),
zeroes AS (SELECT sg_id, n_gt, n_pred, CASE WHEN done THEN n_matched ELSE 0 END AS n_matched, CASE WHEN done THEN n_extra ELSE 0 END AS n_extra, CASE WHEN done THEN n_pred_eff ELSE n_pred END AS n_pred_eff FROM nm JOIN keep USING (sg_id) WHERE scored),
node_r AS (SELECT sg_id, n_gt, n_pred, n_matched, n_extra, {prf('n_matched', 'n_gt', 'n_pred_eff')[0]} AS node_f1, {prf('n_matched', 'n_gt', 'n_pred_eff')[1]} AS node_precision, {prf('n_matched', 'n_gt', 'n_pred_eff')[2]} AS node_recall, {r('n_matched * 100.0::DOUBLE / n_gt', 1)} AS pct_nodes_matched FROM zeroes),
final AS (SELECT k.sg_id, title, domain, 7::BIGINT AS n_nodes, coalesce(ge.n, 0)::BIGINT AS n_edges, n_total_states, k.error, n_gt AS n_gt_nodes, n_pred AS n_pred_nodes, n_matched AS n_matched_nodes, n_extra AS n_extra_nodes, node_f1, node_precision, node_recall, pct_nodes_matched,
  CASE WHEN done THEN s.state_f1 END AS state_f1, CASE WHEN done THEN s.state_precision END AS state_precision, CASE WHEN done THEN s.state_recall END AS state_recall, CASE WHEN done THEN s.pct_states_matched END AS pct_states_matched,
  CASE WHEN done THEN e.n_gt_edges END AS n_gt_edges, CASE WHEN done THEN e.n_pred_edges END AS n_pred_edges, CASE WHEN done THEN e.n_correct_edges END AS n_correct_edges, CASE WHEN done THEN e.n_spurious_edges END AS n_spurious_edges,
  CASE WHEN done THEN e.edge_f1 END AS edge_f1, CASE WHEN done THEN e.edge_precision END AS edge_precision, CASE WHEN done THEN e.edge_recall END AS edge_recall, CASE WHEN done THEN e.pct_correct_edges END AS pct_correct_edges, CASE WHEN done THEN e.pct_spurious_edges END AS pct_spurious_edges,
  CASE WHEN done THEN cpd_kl END AS cpd_kl, CASE WHEN done THEN cpd_kl_symmetric END AS cpd_kl_symmetric, CASE WHEN done THEN n_cpd_evaluated END AS n_cpd_evaluated
  FROM keep k JOIN titles t ON t.bn_id = k.sg_id CROSS JOIN total_states LEFT JOIN node_r USING (sg_id) LEFT JOIN state_m s USING (sg_id) LEFT JOIN edge_m e USING (sg_id) LEFT JOIN kl_m USING (sg_id)
  LEFT JOIN (SELECT sg_id, count(*) AS n FROM gt GROUP BY sg_id) ge USING (sg_id)),"""
RUNS = TWO.replace("WITH", "WITH RECURSIVE", 1) + DAG + TITLES + node_metrics() + EDGE_M + RUN
ORACLES["eval_run"] = end(RUNS) + f" SELECT * REPLACE ({r('cpd_kl', 4)} AS cpd_kl, {r('cpd_kl_symmetric', 4)} AS cpd_kl_symmetric) FROM final"
ORACLES["eval_run_variant"] = end(RUNS) + f" SELECT sg_id, error, node_f1, edge_f1, n_cpd_evaluated, {r('cpd_kl', 4)} AS cpd_kl FROM final"
PLOTTED = ["node_f1", "node_recall", "pct_nodes_matched", "state_f1", "state_recall", "pct_states_matched", "edge_f1", "edge_recall", "pct_correct_edges", "pct_spurious_edges", "n_extra_nodes", "cpd_kl", "cpd_kl_symmetric"]
ORACLES["eval_plot_data"] = end(RUNS) + " " + " UNION ALL ".join(f"SELECT '{m}' AS metric, n_nodes, {r(m, 4)} AS value, count(*) AS n FROM final WHERE {m} IS NOT NULL GROUP BY ALL" for m in PLOTTED)

ORACLES["corpus_roundtrip"] = "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS bn_pos, printf('doc \"%d\"', doc_id) AS id, source, md5(text) AS text_md5 FROM documents"

ORACLES["token_chunks_hot"] = """WITH RECURSIVE e AS (SELECT lang, doc_id, cost, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM (SELECT lang, doc_id, len(regexp_extract_all(coalesce(text, ''), '\\S+'))::BIGINT AS cost FROM documents)),
f AS (SELECT lang, doc_id, rn, 0::BIGINT AS chunk, cost, cost AS used FROM e WHERE rn = 1
  UNION ALL SELECT e.lang, e.doc_id, e.rn, CASE WHEN used > 0 AND used + e.cost > 20000 THEN chunk + 1 ELSE chunk END, e.cost, CASE WHEN used > 0 AND used + e.cost > 20000 THEN e.cost ELSE used + e.cost END
    FROM f JOIN e ON e.lang = f.lang AND e.rn = f.rn + 1)
SELECT lang, doc_id, cost, chunk FROM f"""

_VALUES = "l_extendedprice::DOUBLE / 7 AS a, l_discount::DOUBLE / 3 AS b, l_tax::DOUBLE / 9 AS c, l_quantity::DOUBLE / 11 AS d"
ORACLES["rounding_any_depth"] = f"""SELECT l_orderkey, l_linenumber, concat('{{"id": ', l_orderkey, ', "cpds": [{{"p": ', {r('a', 2)}::VARCHAR, ', "deep": {{"x": [', {r('b', 2)}::VARCHAR, ', 1, "0.12345 \\" 3.14159", ', {r('c', 2)}::VARCHAR,
  ']}}}}], "new \\\\ 0.555": {{"any": ', {r('d', 2)}::VARCHAR, ', "n": null, "t": true}}}}') AS json FROM (SELECT *, {_VALUES} FROM lineitem)"""
ORACLES["leaves_any_depth"] = f"""SELECT l_orderkey, l_linenumber, x.path AS path, x.value AS value FROM (SELECT l_orderkey, l_linenumber, unnest([{{'path': 'id', 'value': {r('l_orderkey::DOUBLE', 4)}::VARCHAR}}, {{'path': 'cpds/0/p', 'value': {r('a', 4)}::VARCHAR}},
  {{'path': 'cpds/0/deep/x/0', 'value': {r('b', 4)}::VARCHAR}}, {{'path': 'cpds/0/deep/x/1', 'value': '1.0'}}, {{'path': 'cpds/0/deep/x/2', 'value': '0.12345 " 3.14159'}}, {{'path': 'cpds/0/deep/x/3', 'value': {r('c', 4)}::VARCHAR}},
  {{'path': 'new \\ 0.555/any', 'value': {r('d', 4)}::VARCHAR}}, {{'path': 'new \\ 0.555/n', 'value': NULL}}, {{'path': 'new \\ 0.555/t', 'value': 'true'}}]) AS x FROM (SELECT *, {_VALUES} FROM lineitem))"""
ORACLES["upsert_slots"] = ORACLES["upsert"]
ORACLES["completions_ledger"] = """SELECT doc_id, 'ok' AS status, CASE WHEN bool_or(doc_id % 2 = 0) OVER (PARTITION BY coalesce(text, '')) THEN 1 ELSE 2 END AS run, length(coalesce(text, '')) AS n_chars FROM documents"""
ORACLES["wide_levels"] = """WITH RECURSIVE p AS (SELECT event_type AS bn_id, user_id AS a, lead(user_id) OVER (PARTITION BY event_type ORDER BY event_id) AS b FROM events),
e AS (SELECT DISTINCT bn_id, least(a, b) AS a, greatest(a, b) AS b FROM p WHERE b IS NOT NULL AND a <> b),
walk AS (SELECT DISTINCT bn_id, a AS node, 0 AS level FROM p UNION SELECT e.bn_id, e.b, level + 1 FROM walk JOIN e ON e.bn_id = walk.bn_id AND e.a = walk.node)
SELECT bn_id, node::INT AS node_pos, node::VARCHAR AS node, max(level) AS level FROM walk GROUP BY bn_id, node"""
