"""Exact solvers for reduced graphs: plain Python over adjacency dictionaries ``{u: {v: weight}}``."""

from __future__ import annotations

import heapq
import random
from collections import deque
from collections.abc import Iterable

Adj = dict[int, dict[int, int]]


def adjacency(edges: Iterable[tuple[int, int, int]], vertices: Iterable[int] = ()) -> Adj:
    g: Adj = {v: {} for v in vertices}
    for u, v, w in edges:
        if u != v and w > 0:
            g.setdefault(u, {})[v] = g.setdefault(u, {}).get(v, 0) + w
            g.setdefault(v, {})[u] = g.setdefault(v, {}).get(u, 0) + w
    return g


def components(g: Adj) -> list[set[int]]:
    seen: set[int] = set()
    out = []
    for s in sorted(g):
        if s not in seen:
            part, todo = {s}, [s]
            while todo:
                for v in g[todo.pop()]:
                    if v not in part:
                        part.add(v)
                        todo.append(v)
            seen |= part
            out.append(part)
    return out


def merge(g: Adj, keep: int, gone: int) -> None:
    """Contract ``gone`` into ``keep``, in place."""
    for v, w in g.pop(gone).items():
        del g[v][gone]
        if v != keep:
            g[keep][v] = g[keep].get(v, 0) + w
            g[v][keep] = g[v].get(keep, 0) + w


def _copy(g: Adj) -> Adj:
    return {u: dict(n) for u, n in g.items()}


class Bound:
    """The best cut found while a graph is contracted."""

    def __init__(self, g: Adj) -> None:
        self.members = {v: [v] for v in g}
        self.value: int | None = None
        self.side: list[int] = []

    def trivial(self, g: Adj) -> None:
        if len(g) > 1:
            v = min(g, key=lambda v: (sum(g[v].values()), v))
            d = sum(g[v].values())
            if self.value is None or d < self.value:
                self.value, self.side = d, list(self.members[v])

    def merged(self, keep: int, gone: int) -> None:
        self.members[keep] += self.members.pop(gone)


def scan(g: Adj, bound: int, start: int) -> list[tuple[int, int]]:
    """A maximum-adjacency scan; pairs whose connectivity is at least ``bound``."""
    r = dict.fromkeys(g, 0)
    heap = [(0, start)]
    heap += [(0, v) for v in g if v != start]
    heapq.heapify(heap)
    heap = [(-1, start), *heap]
    heapq.heapify(heap)
    done: set[int] = set()
    pairs = []
    while heap:
        _, x = heapq.heappop(heap)
        if x in done:
            continue
        done.add(x)
        for y, w in g[x].items():
            if y not in done:
                if r[y] < bound <= r[y] + w:
                    pairs.append((x, y))
                r[y] += w
                heapq.heappush(heap, (-r[y], y))
    return pairs


def noi(g: Adj, approximate: bool = False, seed: int = 0) -> tuple[int | None, list[int]]:
    """Value and one side of a minimum cut (None under two vertices); ``approximate`` halves the bound, for a value of at most twice the least."""
    if len(g) < 2:
        return None, []
    parts = components(g)
    if len(parts) > 1:
        return 0, sorted(parts[0])
    g, rng = _copy(g), random.Random(seed)
    best = Bound(g)
    best.trivial(g)
    while len(g) > 1 and best.value:
        limit = (best.value + 1) // 2 if approximate else best.value
        pairs = scan(g, limit, rng.choice(sorted(g)))
        home: dict[int, int] = {}

        def find(v: int) -> int:
            while v in home:
                v = home[v]
            return v

        if not pairs:  # bound above every degree can't be; one step of the phase is always safe
            break
        for x, y in pairs:
            a, b = find(x), find(y)
            if a != b and len(g) > 1:
                merge(g, a, b)
                best.merged(a, b)
                home[b] = a
        best.trivial(g)
    return best.value, best.side


def stoer_wagner(g: Adj) -> tuple[int | None, list[int]]:
    """Value and side of a minimum cut by the cuts of maximum-adjacency orders."""
    if len(g) < 2:
        return None, []
    g = _copy(g)
    best = Bound(g)
    while len(g) > 1:
        order, weight, done = [], dict.fromkeys(g, 0), set()
        heap = [(0, v) for v in sorted(g)]
        while heap:
            k, x = heapq.heappop(heap)
            if x in done or -k != weight[x]:
                continue
            done.add(x)
            order.append(x)
            for y, w in g[x].items():
                if y not in done:
                    weight[y] += w
                    heapq.heappush(heap, (-weight[y], y))
        s, t = order[-2], order[-1]
        if best.value is None or weight[t] < best.value:
            best.value, best.side = weight[t], list(best.members[t])
        merge(g, s, t)
        best.merged(s, t)
    return best.value, best.side


def karger_stein(g: Adj, seed: int, base: int = 50) -> tuple[int | None, list[int]]:
    """One recursive run: contract two fifths at random by weight, twice, then solve exactly."""
    rng = random.Random(seed)
    if len(g) < 2 or len(components(g)) > 1:
        return noi(g)

    def shrink(h: Adj, names: dict[int, list[int]], to: int) -> None:
        while len(h) > to:
            us = sorted(h)
            u = rng.choices(us, [sum(h[x].values()) for x in us])[0]
            vs = sorted(h[u])
            v = rng.choices(vs, [h[u][x] for x in vs])[0]
            merge(h, u, v)
            names[u] = names[u] + names.pop(v)

    def run(h: Adj, names: dict[int, list[int]]) -> tuple[int, list[int]]:
        if len(h) <= base:
            value, side = noi(h)
            return value, [x for v in side for x in names[v]]
        best = None
        for _ in range(2):
            k, own = _copy(h), dict(names)
            shrink(k, own, max(base, int(len(h) * 0.6)))
            found = run(k, own)
            best = found if best is None or found[0] < best[0] else best
        return best

    return run(g, {v: [v] for v in g})


class Flow:
    """Maximum flow from one source to a set of sinks in an undirected graph, by blocking flows."""

    def __init__(self, g: Adj, source: int, sinks: set[int], limit: int | None = None) -> None:
        self.rest = {u: dict(n) for u, n in g.items()}
        self.source, self.sinks, self.value = source, sinks, 0
        while limit is None or self.value < limit:
            level = {source: 0}
            todo = deque([source])
            while todo:
                u = todo.popleft()
                for v, c in self.rest[u].items():
                    if c > 0 and v not in level:
                        level[v] = level[u] + 1
                        if v not in sinks:
                            todo.append(v)
            if not any(t in level for t in sinks):
                break
            arcs = {u: [v for v, c in self.rest[u].items() if c > 0 and level.get(v, -1) == level[u] + 1] for u in level}
            while True:
                path, u = [source], source
                while u not in sinks:
                    while arcs.get(u) and self.rest[u][arcs[u][-1]] <= 0:
                        arcs[u].pop()
                    if arcs.get(u):
                        u = arcs[u][-1]
                        path.append(u)
                    elif u == source:
                        break
                    else:
                        path.pop()
                        u = path[-1]
                        arcs[u].pop()
                if u not in sinks:
                    break
                most = min(self.rest[a][b] for a, b in zip(path, path[1:], strict=False))
                for a, b in zip(path, path[1:], strict=False):
                    self.rest[a][b] -= most
                    self.rest[b][a] += most
                self.value += most
        if limit is not None:
            self.value = min(self.value, limit)

    def source_side(self) -> set[int]:
        """The largest source side of a minimum cut: all that can't reach a sink in the residual graph."""
        reach, todo = set(self.sinks), list(self.sinks)
        while todo:
            v = todo.pop()
            for u in self.rest[v]:
                if u not in reach and self.rest[u][v] > 0:
                    reach.add(u)
                    todo.append(u)
        return set(self.rest) - reach

    def near_side(self) -> set[int]:
        seen, todo = {self.source}, [self.source]
        while todo:
            u = todo.pop()
            for v, c in self.rest[u].items():
                if c > 0 and v not in seen:
                    seen.add(v)
                    todo.append(v)
        return seen


def max_flow(g: Adj, vertices: list[int], source: int = 0, limit: int | None = None) -> tuple[int, set[int]]:
    """Flow from ``vertices[source]`` to all others listed, and the largest source side; (-1, empty) for unknown ids."""
    if not vertices or any(v not in g for v in vertices):
        return -1, set()
    f = Flow(g, vertices[source], set(vertices) - {vertices[source]}, limit)
    return f.value, f.source_side()


def strong_components(out: dict[int, list[int]]) -> dict[int, int]:
    """The strongly connected component of every vertex of a directed graph."""
    index: dict[int, int] = {}
    low: dict[int, int] = {}
    comp: dict[int, int] = {}
    stack: list[int] = []
    for root in out:
        if root in index:
            continue
        work = [(root, iter(out[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        while work:
            u, it = work[-1]
            for v in it:
                if v not in index:
                    index[v] = low[v] = len(index)
                    stack.append(v)
                    work.append((v, iter(out[v])))
                    break
                if v not in comp:
                    low[u] = min(low[u], index[v])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[u])
                if low[u] == index[u]:
                    label = len(set(comp.values()))
                    while True:
                        v = stack.pop()
                        comp[v] = label
                        if v == u:
                            break
    return comp


def all_min_cuts(g: Adj, value: int | None = None) -> tuple[int | None, list[frozenset[int]]]:
    """All minimum cuts of a connected graph, each as the side without the smallest vertex.

    Vertices join the root one by one; the cuts that first part vertex i from those before it are the closed sets of the
    residual graph of a flow between them, so every cut is met once.
    """
    if len(g) < 2:
        return None, []
    if value is None:
        value = noi(g)[0]
    if value == 0:
        return 0, []
    whole, members_of = set(g), {v: [v] for v in g}
    h, root = _copy(g), min(g)
    while True:  # what is connected by more than the value is parted by none of the cuts
        home: dict[int, int] = {}
        for x, y in scan(h, value + 1, root):
            while x in home:
                x = home[x]
            while y in home:
                y = home[y]
            if x != y:
                keep, gone = min(x, y), max(x, y)
                merge(h, keep, gone)
                members_of[keep] += members_of.pop(gone)
                home[gone] = keep
        if not home:
            break
    g = _copy(h)
    cuts: list[frozenset[int]] = []
    for v in sorted(g)[1:]:
        f = Flow(h, root, {v}, value + 1)
        if f.value == value:
            comp = strong_components({u: [x for x, c in n.items() if c > 0] for u, n in f.rest.items()})
            members: dict[int, set[int]] = {}
            for u, c in comp.items():
                members.setdefault(c, set()).add(u)
            out = {c: {comp[x] for u in m for x, k in f.rest[u].items() if k > 0} - {c} for c, m in members.items()}
            # source sides are sets closed under residual arcs that hold the root's component and not the sink's
            order = sorted(members)  # a component's successors have smaller labels

            def closed(at: int, chosen: frozenset[int], banned: frozenset[int]) -> Iterable[frozenset[int]]:
                while at < len(order) and (order[at] in chosen or order[at] in banned):
                    at += 1
                if at == len(order):
                    yield chosen
                    return
                c = order[at]
                if out[c] <= chosen:  # noqa: B023
                    yield from closed(at + 1, chosen | {c}, banned)
                yield from closed(at + 1, chosen, banned | _above(out, c))  # noqa: B023

            first = _below(out, comp[root])
            never = _above(out, comp[v])
            if not first & never:
                for chosen in closed(0, frozenset(first), frozenset(never)):
                    side = {u for c in chosen for u in members[c]}
                    cuts.append(frozenset(x for x in g if x not in side and _home(h, x, root) not in side))
        merge(h, root, v)
    cuts = [frozenset(x for v in c for x in members_of[v]) for c in set(cuts)]
    return value, sorted((c for c in cuts if len(c) < len(whole)), key=lambda c: (len(c), sorted(c)))


def _home(h: Adj, x: int, root: int) -> int:
    return x if x in h else root


def _below(out: dict[int, set[int]], c: int) -> set[int]:
    seen, todo = {c}, [c]
    while todo:
        for d in out[todo.pop()]:
            if d not in seen:
                seen.add(d)
                todo.append(d)
    return seen


def _above(out: dict[int, set[int]], c: int) -> frozenset[int]:
    seen = {c}
    grown = True
    while grown:
        new = {d for d, n in out.items() if d not in seen and n & seen}
        grown = bool(new)
        seen |= new
    return frozenset(seen)


def cactus(vertices: list[int], value: int, cuts: list[frozenset[int]]) -> tuple[list[list[int]], list[tuple[int, int, int]]]:
    """Nodes (contained vertices) and edges (u, v, weight) of the cactus of all minimum cuts.

    Cuts that cross no other form a tree; where cuts cross, the node between the parts they meet in becomes a cycle of half weight.
    """
    whole = frozenset(vertices)
    crossing = lambda a, b: bool(a & b and a - b and b - a)  # noqa: E731  the root is in neither
    laminar = sorted((a for a in cuts if not any(crossing(a, b) for b in cuts)), key=len, reverse=True)
    parent: dict[int, int] = {}
    for i, a in enumerate(laminar):
        above = [j for j in range(i) if a < laminar[j]]
        parent[i] = above[-1] if above else -1
        for j in above:
            if parent[i] == -1 or len(laminar[j]) < len(laminar[parent[i]]):
                parent[i] = j
    nodes = {-1: whole, **dict(enumerate(laminar))}
    own = {i: sorted(s - frozenset().union(*(laminar[j] for j in parent if parent[j] == i))) for i, s in nodes.items()}
    cut_set = set(cuts)
    flat = lambda s: s if min(whole) not in s else whole - s
    cycles: dict[int, list[tuple[int, int]]] = {}
    for i in nodes:
        around = [(j, laminar[j]) for j in parent if parent[j] == i]
        if i != -1:
            around.append((parent[i], whole - laminar[i]))
        pairs = [(a, b) for x, (a, s) in enumerate(around) for b, t in around[x + 1 :] if len(around) == 3 or flat(s | t) in cut_set]
        if not own[i] and len(around) >= 3 and value % 2 == 0 and len(pairs) == len(around):
            cycles[i] = pairs
    # two cycles side by side meet in an empty node of their own, named after the tree edge between them
    joint = lambda i, j: ("joint", i if parent.get(i) == j else j) if j in cycles else ("node", j)
    named: list[tuple[tuple[str, int], tuple[str, int], int]] = [(joint(i, a), joint(i, b), value // 2) for i, pairs in cycles.items() for a, b in pairs]
    named += [(("node", parent[i]), ("node", i), value) for i in parent if i not in cycles and parent[i] not in cycles]
    used = sorted({x for a, b, _ in named for x in (a, b)} | {("node", i) for i in nodes if i not in cycles})
    number = {x: k for k, x in enumerate(used)}
    edges = sorted((min(number[a], number[b]), max(number[a], number[b]), w) for a, b, w in named)
    return [own[i] if kind == "node" else [] for kind, i in used], edges


def articulation_points(g: Adj) -> tuple[set[int], set[tuple[int, int]]]:
    """Vertices and edges (u < v) whose removal disconnects their component."""
    index: dict[int, int] = {}
    low: dict[int, int] = {}
    points: set[int] = set()
    bridges: set[tuple[int, int]] = set()
    for root in sorted(g):
        if root in index:
            continue
        index[root] = low[root] = len(index)
        work, kids = [(root, None, iter(sorted(g[root])))], 0
        while work:
            u, up, it = work[-1]
            for v in it:
                if v not in index:
                    index[v] = low[v] = len(index)
                    work.append((v, u, iter(sorted(g[v]))))
                    break
                if v != up:
                    low[u] = min(low[u], index[v])
            else:
                work.pop()
                if up is not None:
                    low[up] = min(low[up], low[u])
                    if low[u] > index[up]:
                        bridges.add((min(u, up), max(u, up)))
                    if up == root:
                        kids += 1
                    elif low[u] >= index[up]:
                        points.add(up)
        if kids > 1:
            points.add(root)
    return points, bridges


def maximal_cliques(g: Adj) -> list[list[int]]:
    out: list[list[int]] = []

    def grow(r: list[int], p: set[int], x: set[int]) -> None:
        if not p and not x:
            out.append(sorted(r))
            return
        pivot = max(sorted(p | x), key=lambda v: len(p & g[v].keys()))
        for v in sorted(p - g[pivot].keys()):
            grow([*r, v], p & g[v].keys(), x & g[v].keys())
            p = p - {v}
            x = x | {v}

    grow([], set(g), set())
    return sorted(out)


def isolating(g: Adj, terminals: list[int]) -> dict[int, tuple[int, set[int]]]:
    """For each terminal, the least cut from all others and its largest side."""
    return {t: max_flow(g, [t, *(x for x in terminals if x != t)]) for t in terminals}


def multiterminal(g: Adj, terminals: list[int], **options: object) -> tuple[int, dict[int, int], bool]:
    """Value, block (terminal) of every vertex, and whether it is proved optimal."""
    from cleave.functions.multicut import multiterminal as solve

    return solve(g, terminals, **options)


def unit_flow(g: Adj, excess: dict[int, int], sinks: dict[int, int], height: int) -> tuple[dict[int, int], dict[int, int]]:
    """Push ``excess`` along edges (as much as each weighs) into vertices that take in up to ``sinks``, from labels below ``height``.

    Returns what every vertex has taken in and what is left over; together they are the excess.
    """
    rest = {u: dict(n) for u, n in g.items()}
    label, left, taken = dict.fromkeys(g, 0), dict.fromkeys(g, 0), dict.fromkeys(g, 0)

    def put(v: int, x: int) -> None:
        room = min(x, sinks.get(v, 0) - taken[v])
        taken[v] += room
        left[v] += x - room

    for v, x in excess.items():
        put(v, x)
    todo = deque(v for v in g if left[v])
    while todo:
        u = todo.popleft()
        while left[u] and label[u] < height:
            for v, c in rest[u].items():
                if c > 0 and label[v] == label[u] - 1 and left[u]:
                    x = min(c, left[u])
                    rest[u][v] -= x
                    rest[v][u] += x
                    left[u] -= x
                    before = left[v]
                    put(v, x)
                    if left[v] and not before:
                        todo.append(v)
            if left[u]:
                label[u] += 1
    return {v: x for v, x in taken.items() if x}, {v: x for v, x in left.items() if x}


def scaled_flow(g: Adj, excess: dict[int, int], sinks: dict[int, int], height: int | None = None) -> tuple[dict[int, int], dict[int, int]]:
    """:func:`unit_flow` in rounds of doubling label height, up to twice the vertices, until nothing is left over."""
    most = 2 * len(g) if height is None else height
    h = 2
    while True:
        taken, left = unit_flow(g, excess, sinks, min(h, most))
        if not left or h >= most:
            return taken, left
        h *= 2


def to_arrays(g: Adj) -> tuple[list[int], list[int], list[int], list[int]]:
    """The graph as arrays: ids in order, where each one's arcs begin (one more at the end), arc ends as places, arc weights."""
    ids = sorted(g)
    place = {v: i for i, v in enumerate(ids)}
    start, ends, weights = [0], [], []
    for v in ids:
        for u in sorted(g[v]):
            ends.append(place[u])
            weights.append(g[v][u])
        start.append(len(ends))
    return ids, start, ends, weights


def from_arrays(ids: list[int], start: list[int], ends: list[int], weights: list[int]) -> Adj:
    """The graph of :func:`to_arrays`."""
    return {v: {ids[ends[k]]: weights[k] for k in range(start[i], start[i + 1])} for i, v in enumerate(ids)}


def cactus_path(nodes: int, edges: list[tuple[int, int, int]], value: int, u: int, v: int) -> list[int]:
    """The cactus nodes that an edge between nodes ``u`` and ``v`` merges into one: the ends of the tree edges on the way, and where it enters and leaves a cycle."""
    near: dict[int, list[tuple[int, int]]] = {i: [] for i in range(nodes)}
    for k, (a, b, _) in enumerate(edges):
        near[a].append((b, k))
        near[b].append((a, k))
    cycle: dict[int, int] = {}  # of every cycle edge, its cycle: the edges of one block of the graph
    depth, up, order = {0: 0}, {0: (0, -1)}, [0]
    for x in order:
        for y, k in near[x]:
            if y not in depth:
                depth[y], up[y] = depth[x] + 1, (x, k)
                order.append(y)
    parent = {k: k for k in range(len(edges))}

    def find(k: int) -> int:
        while parent[k] != k:
            k = parent[k]
        return k

    tree = {k for _, k in up.values()}
    for k, (a, b, _) in enumerate(edges):
        if k not in tree:  # the way between its ends in the tree makes the cycle
            while a != b:
                if depth[a] < depth[b]:
                    a, b = b, a
                parent[find(up[a][1])] = find(k)
                a = up[a][0]
    cycle = {k: find(k) for k, (_, _, w) in enumerate(edges) if w < value}
    way, seen = deque([[(u, -1)]]), {u}
    while way:
        path = way.popleft()
        if path[-1][0] == v:
            kept = [u]
            for (x, k), (y, j) in zip(path[1:], [*path[2:], (v, -2)], strict=True):
                if x == v or k not in cycle or cycle.get(j) != cycle[k]:
                    kept.append(x)
            return kept
        for y, k in near[path[-1][0]]:
            if y not in seen:
                seen.add(y)
                way.append([*path, (y, k)])
    return []


def near_cuts(g: Adj, below: int, most: int) -> list[frozenset[int]] | None:
    """All cuts of a connected graph that weigh less than ``below``, each as the side without the smallest vertex; None if a search of ``most`` steps doesn't tell.

    Vertices are put on a side one by one, heaviest first, while what is cut and what every other vertex must cut in any case stays below.
    """
    order = sorted(g, key=lambda v: (-sum(g[v].values()), v))
    root, found, steps = min(g), [], 0
    side: dict[int, int] = {}
    pull = {v: [0, 0] for v in g}  # weight of a vertex's edges to either side

    def put(v: int, s: int, sign: int) -> None:
        for u, w in g[v].items():
            pull[u][s] += sign * w

    def go(at: int, cut: int) -> bool:
        nonlocal steps
        steps += 1
        if steps > most:
            return False
        if cut + sum(min(pull[v]) for v in order[at:]) >= below:
            return True
        if at == len(order):
            one = frozenset(v for v in g if side[v] != side[root])
            if one:
                found.append(one)
            return True
        v = order[at]
        for s in (0, 1) if at else (0,):
            side[v] = s
            put(v, s, 1)
            ok = go(at + 1, cut + pull[v][1 - s])
            put(v, s, -1)
            if not ok:
                return False
        return True

    return found if go(0, 0) else None


class DynamicCut:
    """The minimum cut value under insertions and deletions of edges (parallel edges are kept apart).

    ``cuts`` weighs the cuts that are kept, and every other cut weighs ``floor`` or more.  While the lightest kept cut is no heavier than
    the floor it is the minimum: an insertion makes kept cuts heavier, a deletion makes them, and the floor, lighter.  Beyond that all cuts up to some
    room above the minimum are looked for again; where a short search doesn't find them (large graphs), a deletion needs one flow between its ends.
    While the graph is apart, insertions join ``parts`` (vertex to a vertex of its part); deletions only part more, so the value is 0 as long as two are left.
    """

    #: Vertices and steps of a search for near-minimum cuts, and cuts kept; larger searches are left for flows.
    SEARCH = 200, 4_000, 500

    def __init__(self, edges: Iterable[tuple[int, int, int]] = (), vertices: Iterable[int] = ()) -> None:
        self.lists: dict[tuple[int, int], deque[int]] = {}
        for u, v, w in edges:
            self.lists.setdefault((min(u, v), max(u, v)), deque()).append(w)
        self.vertices = set(vertices) | {x for k in self.lists for x in k}
        self.weights = {k: sum(ws) for k, ws in self.lists.items()}
        self.solves = 0
        self.wide, self.misses, self.again = False, 0, 0  # whether the last search told; searches in vain; the solve before which none is tried
        self._solve()

    def graph(self) -> Adj:
        return adjacency([(u, v, w) for (u, v), w in self.weights.items() if w], self.vertices)

    def _keep(self, g: Adj, cuts: Iterable[frozenset[int]], floor: int) -> None:
        self.sides = list(cuts)
        self.cuts = [sum(w for u in c for v, w in g[u].items() if v not in c) for c in self.sides]
        self.floor = floor
        self.crossing: dict[tuple[int, int], list[int]] = {}

    def _solve(self) -> None:
        """Find the value and the cuts to keep anew."""
        self.solves += 1
        g = self.graph()
        self.sides, self.cuts, self.floor, self.crossing = [], [], 0, {}
        pieces = components(g)
        self.parts, self.n_parts = {v: min(p) for p in pieces for v in p} if len(pieces) > 1 else {}, len(pieces)
        self.value = None if len(g) < 2 else 0 if len(pieces) > 1 else noi(g)[0]
        if self.value:
            self._recertify(g)

    def _part(self, v: int) -> int:
        up = self.parts
        if v not in up:
            up[v] = v
            self.n_parts += 1
        while up[v] != v:
            up[v] = v = up[up[v]]
        return v

    def _apart(self, u: int, v: int) -> bool:
        """Whether an edge between ``u`` and ``v`` surely leaves the graph apart."""
        if self.value != 0 or not self.parts:
            return False
        a, b = self._part(u), self._part(v)
        if a != b:
            self.parts[a] = b
            self.n_parts -= 1
        return self.n_parts > 1

    def _recertify(self, g: Adj) -> None:
        """Keep all cuts up to some room above the value, which is the minimum; as much room as a short search allows."""
        vertices, steps, kept = self.SEARCH
        room = self.value
        self.wide = False
        if room > 1 and len(g) <= vertices and self.solves >= self.again:
            for room in (room, room // 2, room // 4):
                found = near_cuts(g, self.value + room, steps) if room > 1 else None
                if found is not None and len(found) <= kept:
                    self.wide, self.misses = True, 0
                    self._keep(g, found, self.value + room)
                    return
            self.misses += 1
            self.again = self.solves + min(2**self.misses, 1024)
        self._keep(g, all_min_cuts(g, self.value)[1], self.value + 1)

    def _crossed(self, key: tuple[int, int]) -> list[int]:
        got = self.crossing.get(key)
        if got is None:
            u, v = key
            got = self.crossing[key] = [i for i, c in enumerate(self.sides) if (u in c) != (v in c)]
        return got

    def insert(self, u: int, v: int, w: int) -> int | None:
        if u != v and w > 0:
            key = (u, v) if u < v else (v, u)
            known = u in self.vertices and v in self.vertices
            self.vertices |= {u, v}
            self.lists.setdefault(key, deque()).append(w)
            self.weights[key] = self.weights.get(key, 0) + w
            if not known or not self.value:
                if not self._apart(u, v):
                    self._solve()
            else:
                lightest = False
                for i in self._crossed(key):
                    lightest |= self.cuts[i] == self.value
                    self.cuts[i] += w
                if lightest:
                    self._settle()
        return self.value

    def _settle(self) -> None:
        least = min(self.cuts, default=None)
        if least is not None and least <= self.floor:
            self.value = least
        else:
            self._solve()

    def delete(self, u: int, v: int) -> int | None:
        key = (u, v) if u < v else (v, u)
        if self.lists.get(key):
            w = self.lists[key].popleft()
            self.weights[key] -= w
            if w > 0 and self.value:
                crossed = self._crossed(key)
                for i in crossed:
                    self.cuts[i] -= w
                    self.value = min(self.value, self.cuts[i])
                if self.floor - w >= self.value:
                    self.floor -= w
                else:
                    self._flow(u, v)
        return self.value

    def _flow(self, u: int, v: int) -> None:
        """The floor has come down to the value: the cuts between ``u`` and ``v`` are weighed by a flow, all others are as heavy as before."""
        if self.wide:
            self._solve()
            return
        self.solves += 1
        g = self.graph()
        f = Flow(g, u, {v}, self.value + 1)
        if f.value <= self.value:
            self.value = f.value
            self._keep(g, all_min_cuts(g, f.value)[1] if f.value else [], f.value + 1)
        else:
            self.floor = min(self.floor, self.value + 1)
