"""Multiterminal cuts of one component: reductions that keep an optimal solution, bounds, search, local search.

Vertices are merged in place; a reduction looks at the graph as it is after the merges before it, so each stays safe on its own.
"""

from __future__ import annotations

import heapq
import random
import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import count

from cleave.functions.kernels import Adj, Flow, articulation_points, merge, scan

#: Vertices up to this degree are compared as twins, and extra flows a round from random and from far vertices.
TWIN_DEGREE, RANDOM_FLOWS, FAR_FLOWS = 50, 5, 5
#: In inexact search, the most branches of a vertex.
FEW_BRANCHES = 5


@dataclass
class Problem:
    """A reduced graph, its terminals, what its edges between terminals weighed, and the original vertices of each vertex."""

    graph: Adj
    terminals: list[int]
    names: dict[int, list[int]]
    paid: int = 0
    flows: dict[int, int] = field(default_factory=dict)

    @classmethod
    def of(cls, graph: Adj, terminals: list[int]) -> Problem:
        return cls({u: dict(n) for u, n in graph.items()}, list(terminals), {v: [v] for v in graph})

    def copy(self) -> Problem:
        return Problem({u: dict(n) for u, n in self.graph.items()}, list(self.terminals), dict(self.names), self.paid, dict(self.flows))

    def join(self, keep: int, gone: int) -> int:
        """Merge two vertices; a terminal keeps its name.  Two terminals are never merged."""
        if gone in self.flows or gone in self.terminals:
            keep, gone = gone, keep
        merge(self.graph, keep, gone)
        self.names[keep] = self.names[keep] + self.names.pop(gone)
        return keep

    def pay(self) -> int:
        """Take out the edges between terminals and return what they weigh."""
        own, before = set(self.terminals), self.paid
        for t in self.terminals:
            for s in [s for s in self.graph[t] if s in own]:
                self.paid += self.graph[t].pop(s)
                self.graph[s].pop(t)
        return self.paid - before

    def free(self) -> list[int]:
        own = set(self.terminals)
        return [v for v in sorted(self.graph) if v not in own]

    def active(self) -> list[int]:
        """Terminals that still have edges."""
        return [t for t in self.terminals if self.graph[t]]

    def degree(self, v: int) -> int:
        return sum(self.graph[v].values())

    def rows(self) -> list[tuple[str, int, int, int]]:
        """The problem as rows: terminals, edges, members and what is paid; :meth:`from_rows` reads them."""
        out = [("paid", 0, 0, self.paid)]
        out += [("terminal", t, i, self.flows.get(t, 0)) for i, t in enumerate(self.terminals)]
        out += [("edge", u, v, w) for u in sorted(self.graph) for v, w in sorted(self.graph[u].items()) if u < v]
        return out + [("member", v, x, 0) for v in sorted(self.names) for x in self.names[v]]

    @classmethod
    def from_rows(cls, rows: list[tuple[str, int, int, int]]) -> Problem:
        p = cls({}, [], {})
        for kind, a, b, w in rows:
            if kind == "paid":
                p.paid = w
            elif kind == "terminal":
                p.terminals.append(a)
                p.flows[a] = w
            elif kind == "member":
                p.names.setdefault(a, []).append(b)
                p.graph.setdefault(a, {})
        for kind, a, b, w in rows:
            if kind == "edge":
                p.graph[a][b] = p.graph[b][a] = w
        return p


def low_degree(p: Problem) -> int:
    """Vertices with one neighbour go to it, with two to the heavier one (the smaller id of equals); returns the merges made."""
    own, todo, made = set(p.terminals), p.free(), 0
    while todo:
        v = todo.pop()
        if v not in p.graph or v in own or not 0 < len(p.graph[v]) < 3:
            continue
        near = list(p.graph[v])
        p.join(min(near, key=lambda u: (-p.graph[v][u], u)), v)
        made += 1
        todo += near
    return made


def high_degree(p: Problem) -> int:
    """Vertices with an edge of half their degree go along it; those whose heaviest terminal outweighs the second and all that is no terminal go to it."""
    own, made = set(p.terminals), 0
    for v in p.free():
        if v not in p.graph or not p.graph[v]:
            continue
        near = p.graph[v]
        to = min(near, key=lambda u: (-near[u], u))
        if 2 * near[to] < p.degree(v):
            pull = sorted(((w, -u) for u, w in near.items() if u in own), reverse=True)
            rest = sum(w for u, w in near.items() if u not in own)
            if not pull or pull[0][0] <= rest + (pull[1][0] if len(pull) > 1 else 0):
                continue
            to = -pull[0][1]
        p.join(to, v)
        made += 1
    return made


def triangles(p: Problem) -> int:
    """Neighbours u and v that a third x ties together: whichever of them x stands with draws the other over, and a block of x alone both.

    The last condition matters from three terminals on: without it, u and v that each lean on a terminal of their own would be merged.
    """
    own, made = set(p.terminals), 0
    for u in p.free():
        if u not in p.graph or not p.graph[u] or 4 * max(p.graph[u].values()) < p.degree(u):
            continue
        for v in sorted(p.graph[u]):
            if v in own or u not in p.graph or v not in p.graph[u]:
                continue
            w, du, dv = p.graph[u][v], p.degree(u), p.degree(v)
            small, large = (u, v) if len(p.graph[u]) < len(p.graph[v]) else (v, u)
            for x in p.graph[small]:
                if x != large and x in p.graph[large]:
                    a, b = p.graph[u][x], p.graph[v][x]
                    if 2 * (w + a) >= du and 2 * (w + b) >= dv and 3 * w + 2 * (a + b) >= du + dv:
                        p.join(u, v)
                        made += 1
                        break
    return made


def certified(p: Problem, bound: int) -> int:
    """Merge vertices so well connected that parting them costs ``bound`` or more; -1 if that ties two terminals together."""
    if len(p.graph) < 3 or bound < 1:
        return 0
    home: dict[int, int] = {}

    def find(v: int) -> int:
        while v in home:
            v = home[v]
        return v

    own, made = set(p.terminals), 0
    for x, y in scan(p.graph, bound, min(p.graph)):
        a, b = find(x), find(y)
        if a == b:
            continue
        if a in own and b in own:
            return -1
        kept = p.join(a, b)
        home[b if kept == a else a] = kept
        made += 1
    return made


def hanging(p: Problem) -> int:
    """Whatever hangs on an articulation point without a terminal joins the point."""
    own, made = set(p.terminals), 0
    for a in sorted(articulation_points(p.graph)[0]):
        if a not in p.graph:
            continue
        seen = {a}
        for s in sorted(p.graph[a]):
            if s in seen or s not in p.graph:
                continue
            part, todo = {s}, [s]
            while todo:
                for v in p.graph[todo.pop()]:
                    if v != a and v not in part:
                        part.add(v)
                        todo.append(v)
            seen |= part
            if not part & own:
                for v in sorted(part):
                    p.join(a, v)
                    made += 1
    return made


def twins(p: Problem) -> int:
    """Vertices with equal neighbourhoods (themselves left out, if they are neighbours) join."""
    made, by = 0, {}
    for v in p.free():
        if 0 < len(p.graph[v]) <= TWIN_DEGREE:
            by.setdefault(tuple(sorted(p.graph[v].items())), []).append(v)
    for same in by.values():
        for v in same[1:]:
            p.join(same[0], v)
            made += 1
    own = set(p.terminals)
    for u in p.free():
        if u not in p.graph or len(p.graph[u]) > TWIN_DEGREE:
            continue
        for v in sorted(p.graph[u]):
            if v > u and v not in own and v in p.graph.get(u, {}) and len(p.graph[u]) == len(p.graph[v]):
                if all(p.graph[v].get(x) == w for x, w in p.graph[u].items() if x != v):
                    p.join(u, v)
                    made += 1
    return made


def distances(g: Adj, sources: list[int]) -> dict[int, int]:
    """Steps from the nearest source."""
    found, todo = dict.fromkeys(sources, 0), deque(sources)
    while todo:
        u = todo.popleft()
        for v in g[u]:
            if v not in found:
                found[v] = found[u] + 1
                todo.append(v)
    return found


def side_flows(p: Problem, rng: random.Random) -> int:
    """From some vertices that are no terminals (random ones and the farthest), the least cut from all terminals: its side joins the vertex."""
    far = distances(p.graph, p.terminals)
    free = [v for v in p.free() if v in far]
    chosen = rng.sample(free, min(RANDOM_FLOWS, len(free))) + sorted(free, key=lambda v: (-far[v], v))[:FAR_FLOWS]
    made = 0
    for s in chosen:
        if s in p.graph:
            for v in sorted(Flow(p.graph, s, set(p.terminals)).source_side() - {s}):
                if v in far:
                    p.join(s, v)
                    made += 1
    return made


def isolate(p: Problem) -> int:
    """The least cut of every terminal from all others; its largest side joins the terminal."""
    made = 0
    p.flows = dict.fromkeys(p.terminals, 0)
    active = p.active()
    if len(active) < 2:
        return 0
    for t in active:
        f = Flow(p.graph, t, set(active) - {t})
        p.flows[t] = f.value
        seen = distances(p.graph, [t])
        for v in sorted(f.source_side() - {t}):
            if v in seen and v not in p.terminals:
                p.join(t, v)
                made += 1
    return made


def lower_bound(p: Problem) -> int:
    return p.paid + (sum(p.flows.values()) + 1) // 2


def upper_bound(p: Problem) -> int:
    return p.paid + sum(p.flows.values()) - max(p.flows.values(), default=0)


def kernelise(p: Problem, best: int | None, rng: random.Random) -> bool:
    """Reduce until nothing moves; False if no solution below ``best`` is left."""
    while True:
        size = len(p.graph)
        p.pay()
        low_degree(p)
        high_degree(p)
        p.pay()
        triangles(p)
        isolate(p)
        p.pay()
        if best is not None:
            if lower_bound(p) >= best:
                return False
            # the two blocks that part a pair cost its connectivity each, all others their own flow, and every edge counts twice
            rest = sum(sorted(p.flows.values())[:-2])
            if certified(p, best - p.paid - rest // 2) < 0:
                return False
        hanging(p)
        twins(p)
        side_flows(p, rng)
        p.pay()
        if len(p.graph) == size:
            return True


def cost(g: Adj, block: dict[int, int]) -> int:
    return sum(w for u in g for v, w in g[u].items() if u < v and block[u] != block[v])


def gain_search(g: Adj, block: dict[int, int], terminals: list[int]) -> dict[int, int]:
    """Move single vertices, and pairs of neighbours in one block, to another block while that lowers the cut."""
    block, fixed, moved = dict(block), set(terminals), True

    def pulls(vs: tuple[int, ...]) -> dict[int, int]:
        out: dict[int, int] = {}
        for v in vs:
            for u, w in g[v].items():
                if u not in vs:
                    out[block[u]] = out.get(block[u], 0) + w
        return out

    while moved:
        moved = False
        for v in sorted(g):
            if v in fixed:
                continue
            groups = [(v,)] + [(v, u) for u in sorted(g[v]) if u > v and u not in fixed and block[u] == block[v]]
            for vs in groups:
                pull = pulls(vs)
                to = max(sorted(pull), key=lambda b: pull[b], default=block[v])
                if pull.get(to, 0) > pull.get(block[v], 0):
                    for x in vs:
                        block[x] = to
                    moved = True
                    break
    return block


def flow_search(g: Adj, block: dict[int, int], terminals: list[int]) -> dict[int, int]:
    """Between every two blocks that touch, the least cut of their union between the two terminals takes the place of the present one while it is lighter."""
    block, better = dict(block), True
    while better:
        better = False
        touching = sorted({(min(block[u], block[v]), max(block[u], block[v])) for u in g for v in g[u] if block[u] != block[v]})
        for a, b in touching:
            inside = {v for v in g if block[v] in (a, b)}
            h = {u: {v: w for v, w in g[u].items() if v in inside} for u in inside}
            now = sum(w for u in h for v, w in h[u].items() if block[u] == a and block[v] == b)
            f = Flow(h, a, {b})
            if f.value < now:
                near = f.near_side()
                for v in inside:
                    block[v] = a if v in near else b
                better = True
    return block


def solution(p: Problem) -> dict[int, int]:
    """Every terminal but the dearest keeps its isolating side, all else goes to that one."""
    active = p.active()
    worst = max(active or p.terminals, key=lambda t: p.flows.get(t, 0))
    block = {x: t for t in p.terminals for x in p.names[t]}
    return block | {x: worst for v in p.free() for x in p.names[v]}


#: Which vertex is branched on, by the problem, its free vertices next to terminals, and a random source.
RULES: dict[str, Callable[[Problem, list[int], random.Random], int]] = {
    "heavy_vertex": lambda p, near, rng: max(near, key=lambda v: (p.degree(v), -v)),
    "heavy": lambda p, near, rng: max(near, key=lambda v: (max(p.graph[v].get(t, 0) for t in p.terminals), p.degree(v), -v)),
    "heavy_global": lambda p, near, rng: max(near, key=lambda v: (max(p.graph[v].values()), -v)),
    "connection": lambda p, near, rng: max(near, key=lambda v: (sum(t in p.graph[v] for t in p.terminals), p.degree(v), -v)),
    "distance": lambda p, near, rng: min(near, key=lambda v: (sum(distances(p.graph, [t]).get(v, len(p.graph)) for t in p.active()), v)),
    "random": lambda p, near, rng: rng.choice(near),
}
#: Which problem comes first, the smallest value.
ORDERS: dict[str, Callable[[Problem], int]] = {
    "bound_sum": lambda p: lower_bound(p) + upper_bound(p),
    "lower_bound": lower_bound,
    "upper_bound": upper_bound,
    "small_graph": lambda p: len(p.graph),
    "few_terminals": lambda p: len(p.active()),
    "bigger_distance": lambda p: lower_bound(p) - upper_bound(p),
    "lower_distance": lambda p: upper_bound(p) - lower_bound(p),
    "most_deleted": lambda p: -p.paid,
}


def multiterminal(
    g: Adj, terminals: list[int], rule: str = "heavy", order: str = "bound_sum", inexact: bool = False, seed: int = 0, most_nodes: int = 200_000, seconds: float = 600.0
) -> tuple[int, dict[int, int], bool]:
    """Value, block (terminal) of every vertex, and whether it is proved optimal.

    ``inexact`` tries only the heaviest branches; it, the end of ``seconds`` or of ``most_nodes`` give the best solution found, not proved.
    """
    if rule not in RULES or order not in ORDERS:
        raise ValueError(f"unknown rule {rule!r} or order {order!r}")
    rng, stop, tick = random.Random(seed), time.monotonic() + seconds, count()
    best: int | None = None
    found: dict[int, int] = {}
    cutoff = False

    def offer(p: Problem) -> None:
        nonlocal best, found
        block = solution(p)
        value = cost(g, block)
        if best is None or value <= best + max(1, best // 20):  # worth polishing
            block = flow_search(g, gain_search(g, block, terminals), terminals)
            value = cost(g, block)
        if best is None or value < best:
            best, found = value, block

    heap: list[tuple[int, int, Problem]] = []

    def add(p: Problem) -> None:
        if not kernelise(p, best, rng):
            return
        offer(p)
        if lower_bound(p) < best and any(p.graph[v] for v in p.free()):
            heapq.heappush(heap, (ORDERS[order](p), next(tick), p))

    add(Problem.of(g, terminals))
    nodes = 1
    while heap:
        _, _, p = heapq.heappop(heap)
        if lower_bound(p) >= best:
            continue
        if nodes > most_nodes or time.monotonic() > stop:
            cutoff = True
            break
        own = set(p.terminals)
        near = [v for v in p.free() if any(t in own for t in p.graph[v])]
        if not near:
            continue
        v = RULES[rule](p, near, rng)
        targets = sorted(p.active(), key=lambda t: (-p.graph[v].get(t, 0), t))
        if inexact and len(targets) > FEW_BRANCHES:
            targets, cutoff = targets[:FEW_BRANCHES], True
        for t in targets:
            child = p.copy()
            child.join(t, v)
            nodes += 1
            add(child)
    return best or 0, found, not cutoff
