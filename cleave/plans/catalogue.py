"""Every query of the graph operators by name, over whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleave.graph import Graph, canonical
from cleave.operators import components as C
from cleave.operators import reduce as R
from cleave.operators import relational as L
from cleave.operators import terminals as S
from cleave.plans import apps as A
from cleave.plans import cuts as P
from cleave.session import materialise
from cleave.sources import generators as G
from cleave.sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Graphs in SQL, each as e(src, dst, weight) and v(id).
_TRADE = """r AS (SELECT {c} AS a, {s} AS b, count(*) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN nation sn ON s_nationkey = sn.n_nationkey GROUP BY 1, 2),
e AS (SELECT CAST(least(a, b) AS BIGINT) AS src, CAST(greatest(a, b) AS BIGINT) AS dst, CAST(sum(w) AS BIGINT) AS weight FROM r WHERE a <> b GROUP BY 1, 2)"""
NATION = _TRADE.format(c="cn.n_nationkey", s="sn.n_nationkey") + ", v AS (SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation)"
REGION = _TRADE.format(c="cn.n_regionkey", s="sn.n_regionkey") + ", v AS (SELECT CAST(r_regionkey AS BIGINT) AS id FROM region)"
_V = ", v AS (SELECT DISTINCT id FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e))"
_E = "e AS (SELECT CAST(least(a, b) AS BIGINT) AS src, CAST(greatest(a, b) AS BIGINT) AS dst, CAST(sum(w) AS BIGINT) AS weight FROM r WHERE a <> b GROUP BY 1, 2)" + _V
MARKET = f"""sg AS (SELECT c_mktsegment, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS i FROM (SELECT DISTINCT c_mktsegment FROM customer)),
pr AS (SELECT o_orderpriority, dense_rank() OVER (ORDER BY o_orderpriority) + 99 AS i FROM (SELECT DISTINCT o_orderpriority FROM orders)),
r AS (SELECT sg.i AS a, pr.i AS b, count(*) AS w FROM orders JOIN customer ON o_custkey = c_custkey JOIN sg USING (c_mktsegment) JOIN pr USING (o_orderpriority) GROUP BY 1, 2
UNION ALL SELECT sg.i, n_regionkey + 200, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN sg USING (c_mktsegment) GROUP BY 1, 2), {_E}"""
CUSTOMER_SUPPLIER = f"r AS (SELECT 2 * o_custkey + 1 AS a, 2 * l_suppkey AS b, 1 AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey), {_E}"
PART_SUPPLIER = f"r AS (SELECT 2 * l_partkey + 1 AS a, 2 * l_suppkey AS b, 1 AS w FROM lineitem), {_E}"
FOREST = f"r AS (SELECT 2 * c_custkey + 1 AS a, 2 * c_nationkey AS b, 1 AS w FROM customer), {_E}"
ARCS = "arcs AS (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e)"
DEG = ARCS + ", deg AS (SELECT v.id, count(dst) AS degree, CAST(coalesce(sum(weight), 0) AS BIGINT) AS weighted FROM v LEFT JOIN arcs ON v.id = src GROUP BY v.id)"
#: Cuts of a small graph as bit masks over the vertices but the smallest: u(id, k), masks(mask, value).
MASKS = """u AS (SELECT id, row_number() OVER (ORDER BY id) - 2 AS k FROM v), ek AS (SELECT a.k AS ka, b.k AS kb, weight FROM e JOIN u a ON src = a.id JOIN u b ON dst = b.id),
m AS (SELECT unnest(range(1, CAST(power(2, (SELECT count(*) - 1 FROM v)) AS BIGINT))) AS mask),
masks AS (SELECT mask, CAST(sum(weight) AS BIGINT) AS value FROM m, ek WHERE (CASE WHEN ka < 0 THEN 0 ELSE (mask >> ka) & 1 END) <> (CASE WHEN kb < 0 THEN 0 ELSE (mask >> kb) & 1 END) GROUP BY mask),
best AS (SELECT min(value) AS value FROM masks)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _blocks(s: SparkSession, d: str) -> DataFrame:
    return T.table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("block"))


def _kept(g: Graph, name: str) -> Graph:
    """The graph as written tables, for queries that use it many times."""
    return Graph(materialise(g.edges, f"{name}-edges"), materialise(g.vertices, f"{name}-vertices"))


def _simple(name: str, source: Callable[[SparkSession, str], Graph], f: Callable[[Graph], DataFrame], sql: str | None = None) -> None:
    query(name, sql)(lambda s, d: f(source(s, d)))


BL = "bl AS (SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_regionkey AS BIGINT) AS block FROM nation), eb AS (SELECT e.*, a.block AS b1, b.block AS b2 FROM e JOIN bl a ON src = a.id JOIN bl b ON dst = b.id)"

_simple("edges_canonical", T.nation_trade, lambda g: g.edges, f"WITH {NATION} SELECT src, dst, weight FROM e")
_simple("arcs_both_ways", T.nation_trade, lambda g: g.arcs(), f"WITH {NATION}, {ARCS} SELECT * FROM arcs")
_simple("arcs_reverse", T.nation_trade, L.reverse_arcs, f"WITH {NATION}, {ARCS} SELECT a.src, a.dst, a.weight, b.weight AS back_weight FROM arcs a JOIN arcs b ON a.src = b.dst AND a.dst = b.src")
_simple("deg_weighted", T.customer_supplier, L.degrees, f"WITH {CUSTOMER_SUPPLIER}, {DEG} SELECT * FROM deg")
_simple("deg_extrema", T.customer_supplier, L.extrema, f"WITH {CUSTOMER_SUPPLIER}, {DEG} SELECT min(weighted) AS min_weighted, max(weighted) AS max_weighted, max(degree) AS max_degree, CAST(sum(weighted) AS BIGINT) AS total_weighted, count(*) AS n, (SELECT count(*) FROM e) AS m FROM deg")
_simple("deg_percentile", T.customer_supplier, lambda g: L.degree_percentile(g, 0.9), f"WITH {CUSTOMER_SUPPLIER}, {DEG}, o AS (SELECT weighted, row_number() OVER (ORDER BY weighted) AS r, count(*) OVER () AS n FROM deg) SELECT weighted AS percentile_degree FROM o WHERE r = CAST(floor(n * 0.9) AS BIGINT) + 1")
_simple("topk_degree", T.part_supplier, lambda g: L.top_degrees(g, 20), f"WITH {PART_SUPPLIER}, {DEG} SELECT * FROM deg ORDER BY weighted DESC, id LIMIT 20")
_simple("topk_degree_unweighted", T.part_supplier, lambda g: L.top_degrees(g, 20, weighted=False), f"WITH {PART_SUPPLIER}, {DEG} SELECT * FROM deg ORDER BY degree DESC, id LIMIT 20")
_simple("graph_validity", T.customer_supplier, lambda g: g.violations(), "SELECT rule, CAST(0 AS BIGINT) AS n FROM (VALUES ('loop'), ('order'), ('weight'), ('parallel'), ('unknown_source'), ('unknown_target'), ('repeated_vertex')) x(rule)")
_simple("flow_graph_arcs", T.nation_trade, L.flow_arcs, f"WITH {NATION}, {ARCS} SELECT src, dst, weight AS capacity, false AS residual FROM arcs UNION ALL SELECT dst, src, 0, true FROM arcs")
query("edge_cut_by_region", f"WITH {NATION}, {BL} SELECT CAST(coalesce(sum(weight), 0) AS BIGINT) AS cut_weight, count(*) AS cut_edges FROM eb WHERE b1 <> b2")(lambda s, d: L.edge_cut(T.nation_trade(s, d), _blocks(s, d)))
query("cut_edges_by_region", f"WITH {NATION}, {BL} SELECT src, dst, weight FROM eb WHERE b1 <> b2")(lambda s, d: L.cut_edges(T.nation_trade(s, d), _blocks(s, d)))
query("block_matrix_region", f"WITH {NATION}, {BL} SELECT least(b1, b2) AS block_a, greatest(b1, b2) AS block_b, CAST(sum(weight) AS BIGINT) AS weight FROM eb WHERE b1 <> b2 GROUP BY 1, 2")(lambda s, d: L.block_matrix(T.nation_trade(s, d), _blocks(s, d)))
query("contract_by_region", f"WITH {NATION}, {BL} SELECT least(b1, b2) AS src, greatest(b1, b2) AS dst, CAST(sum(weight) AS BIGINT) AS weight FROM eb WHERE b1 <> b2 GROUP BY 1, 2")(lambda s, d: L.contract(T.nation_trade(s, d), _blocks(s, d)).edges)
query("extract_region", f"WITH {NATION}, {BL} SELECT src, dst, weight FROM eb WHERE b1 = 1 AND b2 = 1")(lambda s, d: L.induced(T.nation_trade(s, d), _blocks(s, d).where("block = 1")).edges)
query("delete_region", f"WITH {NATION}, {BL} SELECT src, dst, weight FROM eb WHERE b1 <> 1 AND b2 <> 1")(lambda s, d: L.delete_vertices(T.nation_trade(s, d), _blocks(s, d).where("block = 1")).edges)
query("delete_cut_edges", f"WITH {NATION}, {BL} SELECT src, dst, weight FROM eb WHERE b1 = b2")(lambda s, d: (lambda g: L.delete_edges(g, L.cut_edges(g, _blocks(s, d))).edges)(T.nation_trade(s, d)))
query("set_weights_tenfold", f"WITH {NATION}, {BL} SELECT src, dst, CASE WHEN b1 = b2 THEN weight * 10 ELSE weight END AS weight FROM eb")(lambda s, d: (lambda g: L.set_weights(g, L.with_blocks(g, _blocks(s, d)).where("b1 = b2").select("src", "dst", (F.col("weight") * 10).alias("weight"))).edges)(T.nation_trade(s, d)))
query("term_edge_deletion", f"WITH {NATION}, {BL} SELECT CAST(coalesce(sum(weight), 0) AS BIGINT) AS deleted_weight FROM eb WHERE b1 = 0 AND b2 = 0")(lambda s, d: L.delete_terminal_edges(T.nation_trade(s, d), _blocks(s, d).where("block = 0"))[1])
query("remap_dense", "WITH b AS (SELECT CAST(n_nationkey AS BIGINT) AS id, 7 * n_regionkey AS block FROM nation), l AS (SELECT block, min(id) AS low FROM b GROUP BY block) SELECT b.id, dense_rank() OVER (ORDER BY low) - 1 AS block FROM b JOIN l USING (block)")(lambda s, d: L.dense_ids(_blocks(s, d).withColumn("block", F.col("block") * 7)))
_simple("heavy_vertex_removal", T.customer_supplier, lambda g: L.without_heavy(g, 0.9).edges, f"WITH {CUSTOMER_SUPPLIER}, {DEG}, o AS (SELECT weighted, row_number() OVER (ORDER BY weighted) AS r, count(*) OVER () AS n FROM deg), p AS (SELECT weighted AS x FROM o WHERE r = CAST(floor(n * 0.9) AS BIGINT) + 1), k AS (SELECT id FROM deg, p WHERE weighted < x) SELECT src, dst, CAST(1 AS BIGINT) AS weight FROM e WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)")
query("cactus_block_histogram", "WITH z AS (SELECT count(*) AS size FROM customer GROUP BY c_nationkey) SELECT count(CASE WHEN size = 0 THEN 1 END) AS empty, count(CASE WHEN size >= 1 THEN 1 END) AS at_least_1, count(CASE WHEN size >= 10 THEN 1 END) AS at_least_10, count(CASE WHEN size >= 100 THEN 1 END) AS at_least_100, count(CASE WHEN size >= 1000 THEN 1 END) AS at_least_1000, count(CASE WHEN size >= 10000 THEN 1 END) AS at_least_10000 FROM z")(lambda s, d: L.size_histogram(T.table(s, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("size"))))

CC = "cc AS (SELECT 2 * c_custkey + 1 AS id, 2 * c_nationkey AS hub FROM customer), lab AS (SELECT hub, least(min(id), hub) AS component FROM cc GROUP BY hub), comp AS (SELECT CAST(id AS BIGINT) AS id, CAST(component AS BIGINT) AS component FROM cc JOIN lab USING (hub) UNION ALL SELECT CAST(hub AS BIGINT), CAST(component AS BIGINT) FROM lab)"
_simple("components", T.customer_nation, C.all_components, f"WITH {CC} SELECT * FROM comp")
_simple("component_sizes", T.customer_nation, C.component_sizes, f"WITH {CC} SELECT component, count(*) AS size FROM comp GROUP BY component")
_simple("largest_component", T.customer_nation, C.largest_component, f"WITH {CC}, s AS (SELECT component FROM comp GROUP BY component ORDER BY count(*) DESC, component LIMIT 1) SELECT id FROM comp WHERE component IN (SELECT component FROM s)")
query("bfs_distance", f"WITH RECURSIVE {PART_SUPPLIER}, {ARCS}, s AS (SELECT min(id) AS id FROM v), b AS (SELECT id, 0 AS distance FROM s UNION SELECT dst, distance + 1 FROM b JOIN arcs ON src = b.id WHERE distance < 8) SELECT id, min(distance) AS distance FROM b GROUP BY id")(lambda s, d: (lambda g: C.bfs(g, g.vertices.agg(F.min("id").alias("id"))).select("id", "distance"))(_kept(T.part_supplier(s, d), "bfs")))


def _cores(rounds: int) -> str:
    """Core numbers as rounds of h-indices from the degrees down; ``rounds`` must be enough for them to settle."""
    out, last = "h0 AS (SELECT id, degree AS h FROM deg)", "h0"
    for i in range(1, rounds + 1):
        out += f", n{i} AS (SELECT src, h, row_number() OVER (PARTITION BY src ORDER BY h DESC) AS r FROM arcs JOIN {last} ON dst = id), h{i} AS (SELECT {last}.id, coalesce(max(least(n.h, r)), 0) AS h FROM {last} LEFT JOIN n{i} n ON n.src = {last}.id GROUP BY {last}.id)"
        last = f"h{i}"
    return f"{out}, core AS (SELECT id, h AS core FROM {last})"


_simple("kcore_membership", T.nation_trade, C.core_numbers, f"WITH {NATION}, {DEG}, {_cores(12)} SELECT * FROM core")
_simple("kcore_customer_supplier", lambda s, d: _kept(T.customer_supplier(s, d), "core"), C.core_numbers, f"WITH {CUSTOMER_SUPPLIER}, {DEG}, {_cores(24)} SELECT * FROM core")
_simple("kcore_graph", lambda s, d: _kept(T.customer_supplier(s, d), "core"), lambda g: A.core_graph(g, 12).edges, f"WITH {CUSTOMER_SUPPLIER}, {DEG}, {_cores(24)} SELECT src, dst, weight FROM e WHERE src IN (SELECT id FROM core WHERE core >= 12) AND dst IN (SELECT id FROM core WHERE core >= 12)")

_LOW = "low AS (SELECT min(weighted) AS x FROM deg)"
_simple("pr1_heavy_edges", T.nation_trade, lambda g: R.heavy_edges(g, 500), f"WITH {NATION} SELECT src, dst FROM e WHERE weight >= 500")
_simple("pr2_heavy_vertices", T.market, R.heavy_vertices, f"WITH {MARKET}, {DEG} SELECT src, dst FROM e JOIN deg a ON src = a.id JOIN deg b ON dst = b.id WHERE 2 * weight > a.weighted OR 2 * weight > b.weighted")
TRI = "tri AS (SELECT x.src AS a, x.dst AS b, y.dst AS c, x.weight AS w_ab, z.weight AS w_ac, y.weight AS w_bc FROM e x JOIN e y ON x.dst = y.src JOIN e z ON z.src = x.src AND z.dst = y.dst)"
_simple("triangles", T.nation_trade, R.all_triangles, f"WITH {NATION}, {TRI} SELECT * FROM tri")
_simple("pr3_triangles", T.region_trade, R.triangle_pairs, f"WITH {REGION}, {DEG}, {TRI}, p AS (SELECT a AS u, b AS v, w_ab AS w, w_ac AS wu, w_bc AS wv FROM tri UNION ALL SELECT a, c, w_ac, w_ab, w_bc FROM tri UNION ALL SELECT b, c, w_bc, w_ab, w_ac FROM tri) SELECT DISTINCT u AS src, p.v AS dst FROM p JOIN deg x ON u = x.id JOIN deg y ON p.v = y.id WHERE 2 * (w + wu) >= x.weighted AND 2 * (w + wv) >= y.weighted")
_simple("pr4_common", T.nation_trade, lambda g: R.common_neighbours(g, 3000), f"WITH {NATION}, {TRI}, p AS (SELECT a AS src, b AS dst, least(w_ac, w_bc) AS o FROM tri UNION ALL SELECT a, c, least(w_ab, w_bc) FROM tri UNION ALL SELECT b, c, least(w_ab, w_ac) FROM tri), s AS (SELECT src, dst, sum(o) AS o FROM p GROUP BY 1, 2) SELECT e.src, e.dst FROM e LEFT JOIN s USING (src, dst) WHERE weight + coalesce(o, 0) >= 3000")
_simple("heavy_triangles", T.nation_trade, lambda g: R.heavy_triangles(g, 300), f"WITH {NATION}, {TRI} SELECT a, b, c FROM tri WHERE w_ab + w_ac + w_bc - greatest(w_ab, w_ac, w_bc) > 300")
_simple("degree_one", T.customer_nation, R.degree_one, f"WITH {FOREST}, {DEG} SELECT arcs.src AS id, arcs.dst AS anchor, arcs.weight FROM arcs JOIN deg ON arcs.src = deg.id WHERE degree = 1")
_simple("equal_neighbourhood", T.customer_nation, R.equal_neighbourhoods, f"WITH {FOREST}, {DEG}, n AS (SELECT arcs.src AS id, list(arcs.dst ORDER BY arcs.dst) AS near, list(arcs.weight ORDER BY arcs.dst) AS w FROM arcs JOIN deg ON arcs.src = deg.id WHERE degree BETWEEN 1 AND 50 GROUP BY 1), f AS (SELECT near, w, min(id) AS a FROM n GROUP BY 1, 2) SELECT f.a, n.id AS b FROM n JOIN f ON n.near = f.near AND n.w = f.w WHERE f.a <> n.id")
_simple("label_prop_round", T.customer_supplier, lambda g: R.label_propagation(g, 1), f"WITH {CUSTOMER_SUPPLIER}, {ARCS}, r2 AS (SELECT src AS id, dst AS label, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS k FROM arcs) SELECT id, label FROM r2 WHERE k = 1")
_simple("second_choice", T.customer_supplier, R.second_choice, f"WITH {CUSTOMER_SUPPLIER}, {ARCS}, r2 AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS k FROM arcs) SELECT src AS id, max(CASE WHEN k = 1 THEN dst END) AS first, max(CASE WHEN k = 2 THEN weight END) AS second FROM r2 WHERE k <= 2 GROUP BY src")
query("cluster_gain", f"WITH {NATION}, {BL} SELECT id, block, CAST(sum(CASE WHEN block = other THEN weight ELSE 0 END) AS BIGINT) AS inside, CAST(sum(CASE WHEN block <> other THEN weight ELSE 0 END) AS BIGINT) AS outside FROM (SELECT src AS id, b1 AS block, b2 AS other, weight FROM eb UNION ALL SELECT dst, b2, b1, weight FROM eb) GROUP BY id, block")(lambda s, d: R.cluster_cut_gain(T.nation_trade(s, d), _blocks(s, d)))
_simple("random_matching", T.nation_trade, lambda g: R.matching(g.edges.select("src", "dst"), 7))
_simple("weighted_edge_sample", T.nation_trade, lambda g: R.sampled_edges(g, 10, 7))

_VALUE = "SELECT value AS cut_value, (SELECT count(*) FROM v) AS n, (SELECT count(*) FROM e) AS m, true AS consistent FROM best"
for _name, _algorithm in (("min_cut_value", "exact"), ("min_cut_noi", "noi"), ("min_cut_stoer_wagner", "stoer_wagner"), ("min_cut_karger_stein", "ks")):
    _simple(_name, lambda s, d: _kept(T.market(s, d), "market"), lambda g, a=_algorithm: P.min_cut_value(g, a), f"WITH {MARKET}, {MASKS} {_VALUE}")
_simple("min_cut_distributed", lambda s, d: _kept(T.market(s, d), "market"), lambda g: P.min_cut_value(g, "exact", kernel=2), f"WITH {MARKET}, {MASKS} {_VALUE}")  # no kernel to speak of: the contraction rounds run


def _bounded(g: Graph, algorithm: str, **options: int) -> DataFrame:
    """An upper bound beside the least value: never below it, a cut of the graph, at most the least degree or (matula) twice the least."""
    got = P.min_cut_value(g, algorithm, **options)
    low = L.degrees(g).agg(F.min("weighted").alias("low"))
    both = got.select(F.col("cut_value").alias("v"), "consistent").crossJoin(P.min_cut_value(g, "noi").select("cut_value")).crossJoin(low)  # one row each
    most = 2 * F.col("cut_value") if algorithm == "matula" else F.col("low")
    return both.select("cut_value", (F.col("v") >= F.col("cut_value")).alias("not_below"), (F.col("v") <= most).alias("not_above"), "consistent")


for _name, _algorithm, _options in (("min_cut_matula", "matula", {}), ("min_cut_padberg_rinaldi", "pr", {}), ("min_cut_multilevel", "vc", {"kernel": 4})):
    _simple(_name, lambda s, d: _kept(T.market(s, d), "market"), lambda g, a=_algorithm, o=_options: _bounded(g, a, **o), f"WITH {MARKET}, {MASKS} SELECT value AS cut_value, true AS not_below, true AS not_above, true AS consistent FROM best")
_simple("min_cut_nations", lambda s, d: _kept(T.nation_trade(s, d), "nations"), P.min_cut_value)
_simple("min_cut_contracted", lambda s, d: _kept(T.nation_trade(s, d), "nations"), lambda g: P.contract_then_cut(g, 0.3, 5))
_simple("min_cut_without_heavy", lambda s, d: _kept(T.nation_trade(s, d), "nations"), lambda g: P.heavy_vertices_cut(g, 0.9))
_simple("min_cut_all", lambda s, d: _kept(T.market(s, d), "market"), P.cut_list, f"WITH {MARKET}, {MASKS} SELECT value AS cut_value, (SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FROM u WHERE k >= 0 AND (mask >> k) & 1 = 1) AS members FROM masks JOIN best USING (value)")
_simple("min_cut_count", lambda s, d: _kept(T.market(s, d), "market"), lambda g: P.cut_list(g).groupBy("cut_value").agg(F.count("*").alias("cuts")), f"WITH {MARKET}, {MASKS} SELECT value AS cut_value, count(*) AS cuts FROM masks JOIN best USING (value) GROUP BY value")
_SIDES = "x AS (SELECT mask, value, (SELECT sum({w}) FROM u JOIN deg USING (id) WHERE k >= 0 AND (mask >> k) & 1 = 1) AS a, (SELECT sum({w}) FROM deg) AS t FROM masks JOIN best USING (value)) SELECT value AS cut_value, CAST(max(least(a, t - a)) AS BIGINT) AS lighter FROM x GROUP BY value"
_simple("most_balanced", lambda s, d: _kept(T.market(s, d), "market"), P.balanced_cut, f"WITH {MARKET}, {DEG}, {MASKS}, " + _SIDES.format(w="1"))
_simple("min_conductance", lambda s, d: _kept(T.market(s, d), "market"), lambda g: P.balanced_cut(g, "volume"), f"WITH {MARKET}, {DEG}, {MASKS}, " + _SIDES.format(w="weighted"))
_simple("cactus_nodes", lambda s, d: _kept(T.market(s, d), "market"), lambda g: P.cactus(g)[0].select("node_id", F.array_join(F.transform("contained", lambda x: x.cast("string")), ",").alias("contained")))
_simple("cactus_edges", lambda s, d: _kept(T.market(s, d), "market"), lambda g: P.cactus(g)[1])
_ST = "(mask & (SELECT CAST(sum(1 << k) AS BIGINT) FROM u WHERE id IN ({ids})))"
_simple("st_min_cut", lambda s, d: _kept(T.market(s, d), "market"), lambda g: P.st_cut(g, [0, 204]).select("flow").distinct(), f"WITH {MARKET}, {MASKS} SELECT min(value) AS flow FROM masks WHERE {_ST.format(ids='204')} <> 0")
_simple("st_source_side", lambda s, d: _kept(T.market(s, d), "market"), lambda g: P.st_cut(g, [0, 4, 204]), f"WITH {MARKET}, {MASKS}, t AS (SELECT mask, value FROM masks WHERE {_ST.format(ids='4, 204')} = (SELECT CAST(sum(1 << k) AS BIGINT) FROM u WHERE id IN (4, 204))), f AS (SELECT bit_and(mask) AS mask, min(value) AS value FROM t WHERE value = (SELECT min(value) FROM t)) SELECT value AS flow, id FROM f, u WHERE k < 0 OR (mask >> k) & 1 = 0")
_simple("isolating_cuts", lambda s, d: _kept(T.market(s, d), "market"), lambda g: P.isolating_cuts(g, [0, 100, 200]).select("terminal", "flow"), f"WITH {MARKET}, {MASKS}, q AS (SELECT CAST(sum(CASE WHEN id = 100 THEN 1 << k ELSE 0 END) AS BIGINT) AS b, CAST(sum(CASE WHEN id = 200 THEN 1 << k ELSE 0 END) AS BIGINT) AS c FROM u WHERE k >= 0) SELECT CAST(0 AS BIGINT) AS terminal, min(CASE WHEN mask & b <> 0 AND mask & c <> 0 THEN value END) AS flow FROM masks, q UNION ALL SELECT 100, min(CASE WHEN mask & b <> 0 AND mask & c = 0 THEN value END) FROM masks, q UNION ALL SELECT 200, min(CASE WHEN mask & b = 0 AND mask & c <> 0 THEN value END) FROM masks, q")
_ISO = f"{MARKET}, {MASKS}, q AS (SELECT CAST(sum(CASE WHEN id = 100 THEN 1 << k ELSE 0 END) AS BIGINT) AS b, CAST(sum(CASE WHEN id = 200 THEN 1 << k ELSE 0 END) AS BIGINT) AS c FROM u WHERE k >= 0), f AS (SELECT min(CASE WHEN mask & b <> 0 AND mask & c <> 0 THEN value END) AS f0, min(CASE WHEN mask & b <> 0 AND mask & c = 0 THEN value END) AS f1, min(CASE WHEN mask & b = 0 AND mask & c <> 0 THEN value END) AS f2 FROM masks, q)"
_simple("isolating_bounds", lambda s, d: _kept(T.market(s, d), "market"), lambda g: P.multiterminal_bounds(g, [0, 100, 200]), f"WITH {_ISO} SELECT CAST(ceil((f0 + f1 + f2) / 2.0) AS BIGINT) AS lower, CAST(f0 + f1 + f2 - greatest(f0, f1, f2) AS BIGINT) AS upper FROM f")
_simple("multiterminal_value", lambda s, d: _kept(T.region_trade(s, d), "region"), lambda g: P.multiterminal_value(g, [0, 1, 2]), f"WITH {REGION}, a AS (SELECT x.range AS x, y.range AS y FROM range(3) x, range(3) y), b AS (SELECT x, y, sum(CASE WHEN (CASE src WHEN 3 THEN x WHEN 4 THEN y ELSE src END) <> (CASE dst WHEN 3 THEN x WHEN 4 THEN y ELSE dst END) THEN weight ELSE 0 END) AS w FROM a, e GROUP BY x, y) SELECT CAST(min(w) AS BIGINT) AS cut_value, true AS is_optimal FROM b")
_simple("multiterminal_nations", lambda s, d: _kept(T.nation_trade(s, d), "nations"), lambda g: P.multiterminal_value(g, [0, 1, 2, 3]))
_simple("articulation_and_bridges", lambda s, d: T.customer_nation(s, d), P.structure, f"WITH {FOREST}, {DEG} SELECT 'point' AS kind, id AS u, CAST(NULL AS BIGINT) AS v FROM deg WHERE degree > 1 UNION ALL SELECT 'bridge', src, dst FROM e")
_simple("cliques_maximal", lambda s, d: _kept(T.market(s, d), "market"), P.cliques, f"WITH {MARKET} SELECT src || ',' || dst AS members FROM e")
query("dynamic_prefix_cut")(lambda s, d: P.replay(T.event_updates(s, d)).select("ts", "cut_value", "changes"))
query("replay_totals", "SELECT count(CASE WHEN event_type <> 'error' THEN 1 END) AS inserts, count(CASE WHEN event_type = 'error' THEN 1 END) AS deletes, false AS timed_out FROM events")(lambda s, d: P.replay_totals(T.event_updates(s, d)).select("inserts", "deletes", "timed_out"))

# cactus
_CLASS = f"{MARKET}, {MASKS}, bm AS (SELECT mask FROM masks JOIN best USING (value)), sig AS (SELECT id, string_agg(CASE WHEN k >= 0 AND (mask >> k) & 1 = 1 THEN '1' ELSE '0' END, '' ORDER BY mask) AS s FROM u, bm GROUP BY id), cl AS (SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS contained, count(*) AS size FROM sig GROUP BY s)"
_simple("cactus_members", lambda s, d: _kept(T.market(s, d), "market"), lambda g: P.cactus(g)[0].select(F.array_join(F.transform("contained", lambda x: x.cast("string")), ",").alias("contained")).where("contained <> ''"), f"WITH {_CLASS} SELECT contained FROM cl")
_simple("cactus_sizes", lambda s, d: _kept(T.market(s, d), "market"), lambda g: L.size_histogram(P.cactus(g)[0].select(F.size("contained").alias("size"))).drop("empty"), f"WITH {_CLASS} SELECT count(*) AS at_least_1, count(CASE WHEN size >= 10 THEN 1 END) AS at_least_10, count(CASE WHEN size >= 100 THEN 1 END) AS at_least_100, count(CASE WHEN size >= 1000 THEN 1 END) AS at_least_1000, count(CASE WHEN size >= 10000 THEN 1 END) AS at_least_10000 FROM cl")
_simple("small_balanced_cut", lambda s, d: _kept(T.market(s, d), "market"), lambda g: A.small_balanced_cuts(g, 1).select("cut_value", "small"), f"WITH {MARKET}, {DEG}, {MASKS}, " + _SIDES.format(w="1").replace("AS lighter", "AS small"))
_simple("result_row", lambda s, d: _kept(T.market(s, d), "market"), lambda g: A.result_row(g, "exact").select("algorithm", "n", "m", "cut_value", "least_degree"), f"WITH {MARKET}, {DEG}, {MASKS} SELECT 'exact' AS algorithm, (SELECT count(*) FROM v) AS n, (SELECT count(*) FROM e) AS m, value AS cut_value, (SELECT min(weighted) FROM deg) AS least_degree FROM best")
_simple("decompose_levels", lambda s, d: _kept(T.nation_trade(s, d), "nations"), lambda g: A.chain(P.decompose(g, 20)).limit(1), f"WITH {NATION} SELECT 0 AS level, (SELECT count(*) FROM v) AS n, (SELECT count(*) FROM e) AS m")

# flows
_simple("st_limited_flow", lambda s, d: _kept(T.market(s, d), "market"), lambda g: P.st_cut(g, [0, 204], limit=40).select("flow").distinct(), f"WITH {MARKET}, {MASKS} SELECT least(min(value), 40) AS flow FROM masks WHERE {_ST.format(ids='204')} <> 0")

# terminals and their reductions, on customers and suppliers; the terminals are the four heaviest vertices
_TOP = f"{CUSTOMER_SUPPLIER}, {DEG}, t AS (SELECT id, row_number() OVER (ORDER BY weighted DESC, id) - 1 AS place FROM deg QUALIFY place < 4), own AS (SELECT * FROM arcs WHERE src NOT IN (SELECT id FROM t))"
_terminals = lambda f: lambda s, d: (lambda g: f(g, S.by_degree(g, 4)))(_kept(T.customer_supplier(s, d), "terminals"))
query("terminals_by_degree", f"WITH {_TOP} SELECT id, place FROM t")(_terminals(lambda g, t: t))
query("multicut_low_degree", f"WITH {FOREST}, {DEG}, n AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM arcs JOIN deg ON src = id WHERE degree <= 2 AND src <> 1) SELECT src, dst FROM n WHERE r = 1")(lambda s, d: (lambda g: S.low_degree_pairs(g, S.by_ids(g, [1])))(T.customer_nation(s, d)))
query("multicut_heavy", f"WITH {_TOP} SELECT src, dst FROM own JOIN deg ON src = id WHERE 2 * weight > weighted")(_terminals(S.heavy_pairs))
query("multicut_terminal_pull", f"WITH {MARKET}, {DEG}, t AS (SELECT id FROM v WHERE id < 5), own AS (SELECT * FROM arcs WHERE src NOT IN (SELECT id FROM t)), p AS (SELECT src, dst, weight, dst IN (SELECT id FROM t) AS is_t FROM own), pr2 AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM p WHERE is_t), z AS (SELECT src, coalesce(sum(weight), 0) AS w FROM p WHERE NOT is_t GROUP BY src) SELECT a.src, a.dst FROM pr2 a LEFT JOIN pr2 b ON b.src = a.src AND b.r = 2 LEFT JOIN z ON z.src = a.src WHERE a.r = 1 AND a.weight > coalesce(b.weight, 0) + coalesce(z.w, 0)")(lambda s, d: (lambda g: S.terminal_pull(g, S.by_ids(g, [0, 1, 2, 3, 4])))(_kept(T.market(s, d), "market")))
query("component_terminals", "WITH x AS (SELECT c_nationkey, count(*) AS n, min(c_custkey) AS low, count(CASE WHEN c_custkey <= 40 THEN 1 END) AS t FROM customer GROUP BY c_nationkey) SELECT CAST(least(2 * low + 1, 2 * c_nationkey) AS BIGINT) AS component, n + 1 AS size, t AS terminals FROM x")(lambda s, d: (lambda g: S.component_terminals(g, S.by_ids(g, [2 * i + 1 for i in range(41)])))(T.customer_nation(s, d)))
query("multiterminal_forest", "WITH x AS (SELECT count(*) AS t FROM customer WHERE c_custkey <= 40 GROUP BY c_nationkey) SELECT CAST(sum(t - 1) AS BIGINT) AS cut_value, true AS is_optimal FROM x")(lambda s, d: P.multiterminal_value(_kept(T.customer_nation(s, d), "forest"), [2 * i + 1 for i in range(41)]))
query("terminal_balls", f"WITH {_TOP}, b AS (SELECT id, id AS terminal, place, 0 AS distance FROM t UNION ALL SELECT arcs.dst, t.id, place, 1 FROM arcs JOIN t ON src = t.id WHERE arcs.dst NOT IN (SELECT id FROM t)), w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, place) AS r FROM b), z AS (SELECT id, terminal, row_number() OVER (PARTITION BY terminal ORDER BY distance, id) AS k FROM w WHERE r = 1) SELECT id, terminal FROM z WHERE k <= 5")(_terminals(lambda g, t: S.grown(g, t, 5)))
query("far_terminals")(lambda s, d: S.far_apart(_kept(T.market(s, d), "market"), 3))

# more of the graph as a whole
query("graph_violations", """WITH x AS (SELECT CAST(n_nationkey AS BIGINT) AS s, CAST(n_regionkey AS BIGINT) AS d, n_nationkey % 3 AS w FROM nation), e AS (SELECT * FROM x UNION ALL SELECT * FROM x WHERE s > 20), v AS (SELECT r_regionkey AS id FROM region UNION ALL SELECT r_regionkey FROM region WHERE r_regionkey < 4)
SELECT 'loop' AS rule, count(*) AS n FROM e WHERE s = d UNION ALL SELECT 'order', count(*) FROM e WHERE s > d UNION ALL SELECT 'weight', count(*) FROM e WHERE w <= 0 UNION ALL SELECT 'parallel', count(*) FROM (SELECT s, d FROM e GROUP BY s, d HAVING count(*) > 1)
UNION ALL SELECT 'unknown_source', count(*) FROM e WHERE s NOT IN (SELECT id FROM v) UNION ALL SELECT 'unknown_target', count(*) FROM e WHERE d NOT IN (SELECT id FROM v) UNION ALL SELECT 'repeated_vertex', count(*) FROM (SELECT id FROM v GROUP BY id HAVING count(*) > 1)""")(lambda s, d: T.broken(s, d).violations())
query("articulation_ring", "SELECT 'point' AS kind, 2 * c_nationkey AS u, CAST(NULL AS BIGINT) AS v FROM customer GROUP BY c_nationkey UNION ALL SELECT 'point', -1 - n_regionkey, NULL FROM nation GROUP BY n_regionkey UNION ALL SELECT 'bridge', least(2 * c_custkey + 1, 2 * c_nationkey), greatest(2 * c_custkey + 1, 2 * c_nationkey) FROM customer UNION ALL SELECT 'bridge', -1 - n_regionkey, 2 * n_nationkey FROM nation")(lambda s, d: P.structure(T.customer_region(s, d)))
query("temporal_largest_cc", f"WITH {CC}, s AS (SELECT component FROM comp GROUP BY component ORDER BY count(*) DESC, component LIMIT 1), n AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS number FROM comp WHERE component IN (SELECT component FROM s)) SELECT CAST(c_custkey AS BIGINT) AS seq, a.number AS src, b.number AS dst, CAST(1 AS BIGINT) AS delta, CAST(c_custkey AS BIGINT) AS ts FROM customer JOIN n a ON 2 * c_custkey + 1 = a.id JOIN n b ON 2 * c_nationkey = b.id")(lambda s, d: A.temporal_largest(T.customer_updates(s, d)))
_simple("graph_centre", T.customer_nation, A.centre, f"WITH {FOREST}, c AS (SELECT CASE WHEN low % 2 = 0 THEN low ELSE (SELECT min(src + dst - low) FROM e WHERE src = low OR dst = low) END AS id FROM (SELECT min(id) AS low FROM v)) SELECT id, 1 AS radius FROM c")
query("certified_clusters", f"WITH RECURSIVE {NATION}, {BL}, ab AS (SELECT src AS id, b1 AS block, b2 AS other, weight FROM eb UNION ALL SELECT dst, b2, b1, weight FROM eb), g AS (SELECT id FROM ab GROUP BY id HAVING sum(CASE WHEN block <> other THEN weight ELSE 0 END) > sum(CASE WHEN block = other THEN weight ELSE 0 END)), i AS (SELECT src, dst FROM eb WHERE b1 = b2 AND src NOT IN (SELECT id FROM g) AND dst NOT IN (SELECT id FROM g)), i2 AS (SELECT src, dst FROM i UNION SELECT dst, src FROM i), reach AS (SELECT id, id AS near FROM v UNION SELECT reach.id, i2.dst FROM reach JOIN i2 ON i2.src = reach.near) SELECT id, min(near) AS cluster FROM reach GROUP BY id")(lambda s, d: A.certified_clusters(_kept(T.nation_trade(s, d), "nations"), _blocks(s, d)))
_simple("semi_isolated_cliques", lambda s, d: _kept(T.market(s, d), "market"), A.semi_isolated_cliques, f"WITH {MARKET}, {DEG} SELECT src || ',' || dst AS members, CAST(a.weighted + b.weighted - 2 * weight AS BIGINT) AS external FROM e JOIN deg a ON src = a.id JOIN deg b ON dst = b.id WHERE a.weighted + b.weighted - 2 * weight <= 2 * weight")
_simple("label_prop_two_rounds", T.customer_supplier, lambda g: R.label_propagation(g, 2), f"WITH {CUSTOMER_SUPPLIER}, {ARCS}, a1 AS (SELECT src AS id, dst AS label, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS k FROM arcs), l1 AS (SELECT id, label FROM a1 WHERE k = 1), b1 AS (SELECT src AS id, label, sum(weight) AS w FROM arcs JOIN l1 ON dst = l1.id GROUP BY 1, 2), a2 AS (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY w DESC, label) AS k FROM b1) SELECT id, label FROM a2 WHERE k = 1")
query("triangles_suppliers", "WITH l AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), e AS (SELECT a.l_suppkey AS src, b.l_suppkey AS dst, count(*) AS weight FROM l a JOIN l b USING (l_orderkey) WHERE a.l_suppkey < b.l_suppkey GROUP BY 1, 2) SELECT count(*) AS triangles, CAST(sum(x.weight + y.weight + z.weight) AS BIGINT) AS weight FROM e x JOIN e y ON x.dst = y.src JOIN e z ON z.src = x.src AND z.dst = y.dst")(lambda s, d: R.shared_triangle_totals(T.supplier_orders(s, d)))
query("overlay_stream")(lambda s, d: A.overlay_stream(_kept(T.nation_trade(s, d), "nations"), 1, 5)[1])
query("augmenting_stream")(lambda s, d: A.augmenting_stream(_kept(T.market(s, d), "market"), 5, 3))
query("core_cuts")(lambda s, d: A.core_cuts(_kept(T.nation_trade(s, d), "nations"), [5, 10, 20]))
query("random_edges")(lambda s, d: G.random_edges(_kept(T.nation_trade(s, d), "nations"), 2, 5).edges)
query("torus")(lambda s, d: G.torus(s, 3, 20, 2, 1).edges)

# the same by other ways
_simple("min_cut_all_distributed", lambda s, d: _kept(T.market(s, d), "market"), lambda g: P.cut_list(g, 2), SQL["min_cut_all"])


def _after_certificates(g: Graph) -> DataFrame:
    """The minimum cut of the graph after pairs that are connected by the least degree or more inside their block have been merged."""
    low = L.degrees(g).agg(F.min("weighted")).first()[0]
    merged = C.connected_components(P.local_certificates(g, g.vertices.select("id", (F.col("id") % 2).alias("block")), low))
    step = g.vertices.join(merged, "id", "left").select("id", F.coalesce("component", "id").alias("block"))
    value = P.min_cut_value(L.contract(g, materialise(step, "certificates")), "noi")
    return value.select(F.least(F.coalesce("cut_value", F.lit(low)), F.lit(low)).alias("cut_value"))


_simple("min_cut_after_certificates", lambda s, d: _kept(T.market(s, d), "market"), _after_certificates, f"WITH {MARKET}, {MASKS} SELECT value AS cut_value FROM best")
query("contract_region_set", f"WITH {NATION}, {BL}, m AS (SELECT id, CASE WHEN block = 1 THEN (SELECT min(id) FROM bl WHERE block = 1) ELSE id END AS to_id FROM bl), x AS (SELECT a.to_id AS p, b.to_id AS q, weight FROM e JOIN m a ON src = a.id JOIN m b ON dst = b.id) SELECT least(p, q) AS src, greatest(p, q) AS dst, CAST(sum(weight) AS BIGINT) AS weight FROM x WHERE p <> q GROUP BY 1, 2")(lambda s, d: L.contract_set(T.nation_trade(s, d), _blocks(s, d).where("block = 1")).edges)
query("checked_solution", f"WITH {NATION}, {BL}, t AS (SELECT id, block FROM bl WHERE id IN (0, 1, 2, 3)), c AS (SELECT block, sum(weight) AS w FROM (SELECT b1 AS block, weight FROM eb WHERE b1 <> b2 UNION ALL SELECT b2, weight FROM eb WHERE b1 <> b2) GROUP BY block) SELECT bl.block, count(*) AS size, count(t.id) AS terminals, CAST(max(coalesce(w, 0)) AS BIGINT) AS cut_weight, count(t.id) = 1 AS sound FROM bl LEFT JOIN t ON t.id = bl.id LEFT JOIN c ON c.block = bl.block GROUP BY bl.block")(lambda s, d: L.checked_solution(T.nation_trade(s, d), _blocks(s, d), _blocks(s, d).where("id in (0, 1, 2, 3)")))
query("stream_from_graph", f"WITH {NATION} SELECT count(*) AS edges, true AS removed_are_there FROM e")(lambda s, d: _stream_totals(_kept(T.nation_trade(s, d), "nations")))
query("dynamic_market_cut", f"""WITH sg AS (SELECT c_mktsegment, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS i FROM (SELECT DISTINCT c_mktsegment FROM customer)),
pr AS (SELECT o_orderpriority, dense_rank() OVER (ORDER BY o_orderpriority) - 1 + (SELECT count(*) FROM sg) AS i FROM (SELECT DISTINCT o_orderpriority FROM orders)),
w AS (SELECT sg.i AS a, pr.i AS b, year(o_orderdate) AS y, count(*) AS w FROM orders JOIN customer ON o_custkey = c_custkey JOIN sg USING (c_mktsegment) JOIN pr USING (o_orderpriority) GROUP BY 1, 2, 3),
ys AS (SELECT DISTINCT y FROM w), k AS (SELECT (SELECT count(*) FROM sg) + (SELECT count(*) FROM pr) AS n), m AS (SELECT unnest(range(1, CAST(power(2, n - 1) AS BIGINT))) AS mask FROM k),
v AS (SELECT ys.y, mask, sum(CASE WHEN ((2 * mask) >> a) & 1 <> ((2 * mask) >> b) & 1 THEN w ELSE 0 END) AS value FROM ys JOIN w ON w.y BETWEEN ys.y - 1 AND ys.y, m GROUP BY 1, 2)
SELECT CAST(y AS BIGINT) AS ts, CAST(min(value) AS BIGINT) AS cut_value FROM v GROUP BY y""")(lambda s, d: P.replay(T.market_updates(s, d)).select("ts", "cut_value"))


def _stream_totals(g: Graph) -> DataFrame:
    """Edges at the start and inserted, together; whether what is removed has been there."""
    start, updates = G.update_stream(g, 0.3, 0.2, 4, 1)
    inserted = updates.where("delta > 0").agg(F.count("*").alias("i"))
    strange = updates.where("delta < 0").join(start.edges.select("src", "dst"), ["src", "dst"], "left_anti").agg(F.count("*").alias("x"))
    return start.edges.agg(F.count("*").alias("s")).crossJoin(inserted).crossJoin(strange).select((F.col("s") + F.col("i")).alias("edges"), (F.col("x") == 0).alias("removed_are_there"))  # one row each
