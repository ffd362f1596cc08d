"""The exact solvers against enumeration of all cuts, and the known values of the fixtures."""

import itertools
import random

import pytest

from cleave.functions import kernels as K


def every_cut(g):
    ids = sorted(g)
    for m in range(1, 1 << (len(ids) - 1)):
        side = frozenset(v for k, v in enumerate(ids[1:]) if m >> k & 1)
        yield sum(w for u in side for v, w in g[u].items() if v not in side), side


def least(g):
    cuts = list(every_cut(g))
    value = min(c for c, _ in cuts)
    return value, sorted((s for c, s in cuts if c == value), key=lambda s: (len(s), sorted(s)))


def random_graph(rng, most=8):
    n = rng.randint(2, most)
    return n, K.adjacency([(i, j, rng.randint(1, 3)) for i in range(n) for j in range(i) if rng.random() < 0.6], range(n))


@pytest.mark.parametrize("seed", range(60))
def test_min_cuts(seed):
    n, g = random_graph(random.Random(seed))
    value, cuts = least(g)
    for solve in (K.noi, K.stoer_wagner, lambda a: K.karger_stein(a, seed)):
        found, side = solve(g)
        assert found == value
        assert sum(w for u in side for v, w in g[u].items() if v not in set(side)) == value
    if value:
        assert K.all_min_cuts(g) == (value, cuts)
        assert value <= K.noi(g, approximate=True)[0] <= 2 * value


@pytest.mark.parametrize("seed", range(40))
def test_multiterminal(seed):
    rng = random.Random(seed)
    n, g = random_graph(rng)
    terminals = rng.sample(range(n), rng.randint(2, min(4, n)))
    free = [v for v in range(n) if v not in terminals]
    best = min(
        sum(w for u in g for v, w in g[u].items() if u < v and b[u] != b[v])
        for b in ({**dict(zip(free, a, strict=True)), **{t: t for t in terminals}} for a in itertools.product(terminals, repeat=len(free)))
    )
    value, block, sure = K.multiterminal(g, terminals)
    assert sure and value == best
    assert sum(w for u in g for v, w in g[u].items() if u < v and block[u] != block[v]) == best
    flows = K.isolating(g, terminals)
    total = sum(f for f, _ in flows.values())
    assert (total + 1) // 2 <= best <= total - max(f for f, _ in flows.values())


@pytest.mark.parametrize("seed", range(30))
def test_dynamic_equals_static(seed):
    rng = random.Random(seed)
    n, g = random_graph(rng)
    d = K.DynamicCut([(u, v, w) for u in g for v, w in g[u].items() if u < v], range(n))
    for _ in range(12):
        u, v = rng.sample(range(n), 2)
        if rng.random() < 0.6:
            d.insert(u, v, rng.randint(1, 3))
        else:
            d.delete(u, v)
        assert d.value == least(d.graph())[0]


def ring(cliques, size):
    e = [(size * c + i, size * c + j, 1) for c in range(cliques) for i in range(size) for j in range(i)]
    return K.adjacency(e + [(size * c, size * (c + 1) % (size * cliques), 1) for c in range(cliques)])


CACTI = {
    "K4": (K.adjacency([(i, j, 1) for i in range(4) for j in range(i)]), 3, 4, 5, 4),
    "K10": (K.adjacency([(i, j, 1) for i in range(10) for j in range(i)]), 9, 10, 11, 10),
    "path": (K.adjacency([(i, i + 1, 10) for i in range(9)]), 10, 9, 10, 9),
    "ring of 3 K4": (ring(3, 4), 2, 3, 3, 3),
    "ring of 4 K3": (ring(4, 3), 2, 18, 12, 16),
    "six vertices": (K.adjacency([(0, 1, 3), (0, 4, 1), (0, 5, 1), (1, 2, 1), (1, 3, 1), (2, 3, 2), (2, 5, 1), (3, 4, 1), (4, 5, 2)]), 4, 7, 7, 9),
    "torus": (K.adjacency([(3 * i + j, 3 * i + (j + 1) % 3, 1) for i in range(3) for j in range(3)] + [(3 * i + j, 3 * ((i + 1) % 3) + j, 1) for i in range(3) for j in range(3)]), 4, 9, 10, 9),
}


@pytest.mark.parametrize("name", CACTI)
def test_cactus(name):
    g, value, n_cuts, n_nodes, n_edges = CACTI[name]
    found, cuts = K.all_min_cuts(g)
    nodes, edges = K.cactus(sorted(g), found, cuts)
    assert (found, len(cuts), len(nodes), len(edges)) == (value, n_cuts, n_nodes, n_edges)
    assert sorted(v for m in nodes for v in m) == sorted(g)


SMALL = [(0, 1), (0, 2), (0, 3), (0, 4), (1, 2), (1, 3), (2, 3), (3, 7), (4, 5), (4, 6), (4, 7), (5, 6), (5, 7), (6, 7)]
WEIGHTED = [3, 4, 2, 1, 5, 2, 10, 2, 3, 9, 3, 2, 14, 2]


def test_flows():
    g = K.adjacency([(u, v, w) for (u, v), w in zip(SMALL, WEIGHTED, strict=True)])
    ids = [0, 3, 4, 7]
    assert [(K.max_flow(g, ids, i)[0], len(K.max_flow(g, ids, i)[1])) for i in range(4)] == [(10, 1), (11, 3), (11, 2), (12, 2)]
    assert K.max_flow(g, [0, 99]) == (-1, set())
    assert K.max_flow(g, [0, 7], limit=1)[0] == 1


def test_structure_and_cliques():
    g = K.adjacency([(0, 1, 1), (1, 2, 1), (2, 0, 1), (2, 3, 1)])
    assert K.articulation_points(g) == ({2}, {(2, 3)})
    assert K.maximal_cliques(g) == [[0, 1, 2], [2, 3]]
    assert K.noi({}) == (None, []) and K.noi({1: {}}) == (None, [])


def test_clusters():
    """Four cliques with hubs in a K4: the cut takes the six edges between hubs."""
    for size in (5, 10):
        e = [(size * c + i, size * c + j, 1) for c in range(4) for i in range(size) for j in range(i)] + [(size * a, size * b, 1) for a in range(4) for b in range(a)]
        assert K.multiterminal(K.adjacency(e), [size * c + 1 for c in range(4)])[0] == 6


@pytest.mark.parametrize("seed", range(20))
def test_near_cuts(seed):
    _, g = random_graph(random.Random(seed))
    value = least(g)[0]
    if value:
        for below in (value + 1, 2 * value):
            assert set(K.near_cuts(g, below, 10**6)) == {s for c, s in every_cut(g) if c < below}
        assert K.near_cuts(g, value + 1, 1) is None


@pytest.mark.parametrize("search", [K.DynamicCut.SEARCH, (0, 0, 0), (200, 40, 5)])
def test_long_stream_equals_static(search, monkeypatch):
    monkeypatch.setattr(K.DynamicCut, "SEARCH", search, raising=False)
    rng, d = random.Random(3), K.DynamicCut()
    for k in range(1500):
        u, v, w = rng.randrange(3), 10 + rng.randrange(5), rng.randint(1, 2)
        d.delete(u, v) if rng.random() < (0.25 if k < 900 else 0.6) else d.insert(u, v, w)
        if len(d.vertices) > 1:
            assert d.value == least(d.graph())[0], k


def test_stream_of_heavy_traffic_needs_few_solves():
    rng, d = random.Random(4), K.DynamicCut()
    for _ in range(20_000):
        u, v = rng.randrange(5), 10 + rng.randrange(24)
        d.delete(u, v) if rng.random() < 0.2 else d.insert(u, v, 1)
    assert d.solves < 1000


def test_dynamic_apart_makes_few_solves():
    rng = random.Random(6)
    d = K.DynamicCut()
    for i in range(600):
        s = rng.randrange(4)
        u, v = (s, 100 + 12 * (s % 2) + rng.randrange(12)) if i % 100 else (0, 101 + 12)  # two parts, joined and parted again
        if i % 100 == 1:
            u, v = 0, 101 + 12
        if i % 100 == 1 or rng.random() < 0.2 and i % 100:
            d.delete(u, v)
        else:
            d.insert(u, v, rng.randint(1, 3))
        g = d.graph()
        assert d.value == (None if len(g) < 2 else K.noi(g)[0] if len(K.components(g)) == 1 else 0)
    assert d.solves < 60  # one for each insertion before
