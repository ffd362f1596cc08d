"""Multiterminal cuts, terminals and their reductions, and the programs over whole graphs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from cleave.functions import kernels as K
from cleave.functions import multicut as M
from cleave.graph import Graph
from cleave.operators import terminals as S
from cleave.plans import apps, cuts
from cleave.sources import generators, text


def random_problem(seed, most=8):
    rng = random.Random(seed)
    n = rng.randint(3, most)
    g = K.adjacency([(i, j, rng.randint(1, 4)) for i in range(n) for j in range(i) if rng.random() < 0.6], range(n))
    terminals = rng.sample(range(n), rng.randint(2, min(4, n)))
    free = [v for v in range(n) if v not in terminals]
    best = min(M.cost(g, {**dict(zip(free, a, strict=True)), **{t: t for t in terminals}}) for a in itertools.product(terminals, repeat=len(free)))
    return g, terminals, best


def graph(spark, g):
    return Graph.of(spark.createDataFrame([(u, v, w) for u in g for v, w in g[u].items() if u < v], "src long, dst long, weight long"), spark.createDataFrame([(v,) for v in g], "id long"))


@pytest.mark.parametrize("seed", range(60))
def test_every_rule_and_order(seed):
    g, terminals, best = random_problem(seed)
    for rule in M.RULES:
        order = list(M.ORDERS)[seed % len(M.ORDERS)]
        value, block, sure = M.multiterminal(g, terminals, rule, order, seed=seed)
        assert sure and value == best == M.cost(g, block) and all(block[t] == t for t in terminals) and set(block) == set(g)
    value, block, _ = M.multiterminal(g, terminals, inexact=True)
    assert value == M.cost(g, block) >= best
    value, _, sure = M.multiterminal(g, terminals, seconds=-1.0)
    assert value >= best


@pytest.mark.parametrize("step", [M.low_degree, M.high_degree, M.triangles, M.hanging, M.twins, M.isolate, lambda p: M.side_flows(p, random.Random(1))])
def test_every_reduction_keeps_an_optimum(step):
    for seed in range(150):
        g, terminals, best = random_problem(seed, 7)
        p = M.Problem.of(g, terminals)
        p.pay()
        step(p)
        p.pay()
        free = p.free()
        got = min(M.cost(p.graph, {**dict(zip(free, a, strict=True)), **{t: t for t in terminals}}) for a in itertools.product(terminals, repeat=len(free)))
        assert p.paid + got == best
        assert sorted(x for v in p.names.values() for x in v) == sorted(g)


def test_triangle_that_leans_on_three_terminals():
    """Half of either degree lies in the triangle, yet its corners belong to different terminals."""
    g = K.adjacency([(0, 1, 1), (0, 2, 1), (1, 2, 1), (0, 10, 2), (1, 11, 2), (2, 12, 9)])
    p = M.Problem.of(g, [10, 11, 12])
    assert M.triangles(p) == 0 and M.multiterminal(g, [10, 11, 12])[0] == 3


def test_eight_cliques():
    """Eight cliques whose hubs stand in pairs and in a ring of weight 2: known value, proved."""
    for size in (1, 4, 10, 100):
        e = [(size * c + i, size * c + j, 1) for c in range(8) for i in range(size) for j in range(i)]
        e += [(i * size, j * size, 3) for i in range(8) for j in range(i) if i // 2 == j // 2]
        e += [(i * size, j * size, 2) for i in range(8) for j in range(i) if i % 2 == 1 and j % 2 == 1 and i + j != 8]
        value, _, sure = M.multiterminal(K.adjacency(e), [2 * c * size + size - 1 for c in range(4)])
        assert (value, sure) == (8, True)


def test_problem_rows():
    g, terminals, _ = random_problem(3)
    p = M.Problem.of(g, terminals)
    M.kernelise(p, None, random.Random(1))
    assert M.Problem.from_rows(p.rows()) == p


def test_local_search_never_worsens():
    for seed in range(40):
        g, terminals, best = random_problem(seed)
        block = {v: terminals[v % len(terminals)] for v in g} | {t: t for t in terminals}
        now = M.cost(g, block)
        for search in (M.gain_search, M.flow_search):
            out = search(g, block, terminals)
            assert best <= M.cost(g, out) <= now and all(out[t] == t for t in terminals)


def test_unit_flows_and_arrays():
    for seed in range(40):
        g, terminals, _ = random_problem(seed)
        rng = random.Random(seed)
        excess = {v: rng.randint(0, 6) for v in g}
        sinks = {v: rng.randint(0, 4) for v in g}
        for flow in (lambda: K.unit_flow(g, excess, sinks, 3), lambda: K.scaled_flow(g, excess, sinks)):
            taken, left = flow()
            assert sum(taken.values()) + sum(left.values()) == sum(excess.values()) and all(x <= sinks[v] for v, x in taken.items())
        assert K.from_arrays(*K.to_arrays(g)) == g


def test_cactus_path():
    edges = [(0, 1, 4), (1, 2, 2), (2, 3, 2), (3, 1, 2), (3, 4, 4)]  # a cycle 1, 2, 3 between two tree edges
    assert K.cactus_path(5, edges, 4, 0, 4) == [0, 1, 3, 4]
    assert K.cactus_path(5, edges, 4, 2, 1) == [2, 1]
    square = [(0, 1, 1), (1, 2, 1), (2, 3, 1), (3, 0, 1)]
    assert K.cactus_path(4, square, 2, 0, 2) == [0, 2]  # what lies between on a cycle is passed over


@pytest.mark.parametrize("seed", range(3))
def test_reduced_by_joins(spark, seed):
    g, terminals, best = random_problem(seed + 5, 9)
    out = cuts.multiterminal_cut(graph(spark, g), terminals, kernel=0).collect()
    assert sorted(r["id"] for r in out) == sorted(g) and all(r["is_optimal"] for r in out)
    assert sum({r["component"]: r["cut_value"] for r in out}.values()) == best
    assert M.cost(g, {r["id"]: r["block"] for r in out}) == best


def test_terminals(spark, tmp_path):
    path = Graph.of(spark.createDataFrame([(i, i + 1, 1) for i in range(9)] + [(4, 20, 5)], "src long, dst long, weight long"), spark.range(0, 21).where("id < 10 or id = 20"))
    assert [r["id"] for r in S.far_apart(path, 3).orderBy("place").collect()] == [4, 9, 0]
    assert [r["id"] for r in S.by_degree(path, 2).orderBy("place").collect()] == [4, 20]
    assert S.at_random(path, 5, 3).count() == 5
    assert [r["id"] for r in S.by_ids(path, [7, 99, 1]).orderBy("place").collect()] == [7, 1]
    got = sorted(map(tuple, S.grown(path, S.by_ids(path, [0, 9]), 3).collect()))
    assert got == [(0, 0), (1, 0), (2, 0), (7, 9), (8, 9), (9, 9)]
    text.write_problem(path, S.by_ids(path, [20, 0]), f"{tmp_path}/p")
    assert text.read_metis(spark, f"{tmp_path}/p/graph").edges.count() == 10
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/p/terminals").collect()) == ["0 1", "10 0"]
    blocks = cuts.multiterminal_cut(path, [0, 9])
    text.write_solution(blocks, f"{tmp_path}/s")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/s").collect()][0] == "0"
    (tmp_path / "part").write_text("0\n1\n2\n")
    (tmp_path / "pos").write_text("2\n0\n1\n")
    assert sorted(map(tuple, text.read_ordered_partition(spark, f"{tmp_path}/part", f"{tmp_path}/pos", 2).collect()), key=str) == [(0, None), (1, 0), (2, 1)]
    (tmp_path / "d").write_text("p edge 3 2\ne 1 2\ne 2 3 7\n")
    assert [tuple(r)[1:4] for r in text.read_temporal(spark, f"{tmp_path}/d").orderBy("seq").collect()] == [(0, 1, 1), (1, 2, 1)]


def test_components_are_checked(spark):
    g = Graph.of(spark.createDataFrame([(0, 1, 1), (1, 2, 1)], "src long, dst long, weight long"))
    with pytest.raises(ValueError):
        cuts.components_checked(g, 2)


TWO_CLIQUES = K.adjacency([(i, j, 2) for i in range(5) for j in range(i)] + [(5 + i, 5 + j, 2) for i in range(5) for j in range(i)] + [(0, 5, 1), (1, 6, 1)])
RING = K.adjacency([(4 * c + i, 4 * c + j, 1) for c in range(4) for i in range(4) for j in range(i)] + [(4 * c, 4 * (c + 1) % 16, 1) for c in range(4)])


@pytest.mark.parametrize(("algorithm", "a"), [("exact", TWO_CLIQUES), ("exact", RING), ("vc", RING), ("ks", RING)])
def test_rounds_on_the_cluster(spark, algorithm, a):
    """With a kernel of two vertices, contraction rounds do all the work that they can."""
    row = cuts.min_cut_value(graph(spark, a), algorithm, kernel=2).first()
    assert row["consistent"] and (row["cut_value"] == 2 if algorithm in ("exact", "ks") else 2 <= row["cut_value"] <= 8)
    assert len(K.all_min_cuts(RING)[1]) == 6


def test_all_cuts_on_the_cluster(spark):
    got = cuts.all_min_cuts(graph(spark, RING), kernel=2)
    assert got.select("cut").distinct().count() == 6 and got.agg(F.max("cut_value")).first()[0] == 2


def test_programs(spark):
    path = Graph.of(spark.createDataFrame([(i, i + 1, 1) for i in range(7)], "src long, dst long, weight long"))
    assert tuple(apps.centre(path).first()) in ((3, 4), (4, 4))
    ring = graph(spark, RING)
    balanced = [tuple(r) for r in apps.small_balanced_cuts(ring, 2).orderBy("round").collect()]
    assert balanced[0] == (0, 2, 8, 8) and balanced[1][1] == 2
    assert apps.small_balanced_cuts(ring, 2, augment=True).orderBy("round").collect()[1]["cut_value"] >= 2
    assert apps.core_graph(graph(spark, TWO_CLIQUES), 4).vertices.count() == 10
    rows = apps.core_cuts(graph(spark, TWO_CLIQUES), [4, 9]).collect()
    assert [(r["k"], r["cut_value"], r["min_degree"]) for r in rows] == [(4, 2, 8)]
    more, gone = apps.overlay_stream(ring, 2, 1)
    assert more.edges.count() - ring.edges.count() == gone.count() > 0
    assert sum(r[1] for r in more.violations().collect()) == 0
    start = [(r["src"], r["dst"], r["weight"]) for r in more.edges.collect()]
    d = K.DynamicCut(start, range(16))
    for r in gone.orderBy("seq").collect():
        d.delete(r["src"], r["dst"])
    assert d.value == 2
    aug = apps.augmenting_stream(ring, 3, 1).orderBy("seq").collect()
    assert [r["delta"] for r in aug] == [1, 1, 1, -1, -1, -1]
    assert all(not RING[r["src"]].get(r["dst"]) for r in aug)
    clusters = {r["id"]: r["cluster"] for r in apps.certified_clusters(ring, ring.vertices.select("id", (F.col("id") / 8).cast("long").alias("block"))).collect()}
    assert clusters[1] == 0 and clusters[5] == 0 and clusters[13] == 8
    assert {r["members"] for r in apps.semi_isolated_cliques(ring).collect()} >= {"0,1,2,3", "4,5,6,7"}
    totals = cuts.replay_totals(spark.createDataFrame([(1, 0, 1, 2, 1), (2, 1, 2, 3, 1), (3, 0, 1, -1, 2)], "seq long, src long, dst long, delta long, ts long")).first()
    assert (totals["inserts"], totals["deletes"], totals["cut_value"], totals["timed_out"]) == (2, 1, 0, False)
    assert generators.random_edges(ring, 2, 3).edges.agg(F.sum("weight")).first()[0] == ring.edges.count() + 32
    r = apps.result_row(ring, "noi").first()
    assert (r["cut_value"], r["side_0"] + r["side_1"], r["least_degree"]) == (2, 16, 3)
