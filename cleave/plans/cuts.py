"""Minimum cuts, all minimum cuts, flows and multiterminal cuts: shrink by joins, solve what is left in a group."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleave.functions import kernels as K
from cleave.functions import multicut as M
from cleave.graph import Graph
from cleave.operators import reduce as R
from cleave.operators.components import all_components, connected_components, tree_blocks
from cleave.operators.terminals import by_ids, reduced
from cleave.operators.relational import compose, contract, degrees, edge_cut, induced, without_heavy
from cleave.session import materialise
from cleave.streaming.cut import stream_cut  # noqa: F401

#: Vertices of a reduced graph that one group solves; larger ones are shrunk further or refused.
KERNEL_VERTICES = 5_000
ALGORITHMS = ("noi", "exact", "ks", "matula", "pr", "vc", "inexact", "stoer_wagner")


def in_one_group(g: Graph, solve: Callable[..., list[tuple]], schema: str, most: int = KERNEL_VERTICES, runs: int | None = None) -> DataFrame:
    """The rows that ``solve`` makes of the whole graph, in one task; the size is checked first.

    With ``runs``, a task of its own for each of as many runs, whose number ``solve`` gets as well.
    """
    n = g.vertices.limit(most + 1).count()
    if n > most:
        raise ValueError(f"the graph has more than {most} vertices after reduction; it can't be solved in one group")
    names = [c.split()[0] for c in schema.split(", ")]
    ends = F.lit(None).cast("long")
    rows = g.edges.select("src", "dst", "weight").union(g.vertices.select("id", ends, ends))
    rows = rows.withColumn("_g", F.lit(0) if runs is None else F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        alone = pdf[pdf["dst"].isna()]["src"].astype("int64").tolist()
        e = pdf[pdf["dst"].notna()][["src", "dst", "weight"]].astype("int64")
        a = K.adjacency(e.itertuples(index=False, name=None), alone)
        return pd.DataFrame(solve(a) if runs is None else solve(a, int(key[0])), columns=names)

    return rows.groupBy("_g").applyInPandas(run, schema)


def components_checked(g: Graph, most: int = KERNEL_VERTICES) -> DataFrame:
    """``id, component`` of every vertex, written; ValueError for a component that one task can't hold."""
    comp = materialise(all_components(g), "checked-components")
    large = comp.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > most).limit(1).collect()
    if large:
        raise ValueError(f"a component has {large[0]['n']} vertices, more than {most}; it can't be solved in one group")
    return comp


def identity(g: Graph) -> DataFrame:
    return g.vertices.select("id", F.col("id").alias("block"))


def shrink(g: Graph, most: int, triangles: bool = True, rounds: int | None = None, matched: bool = False) -> tuple[Graph, DataFrame, tuple[int, DataFrame] | None]:
    """Contract what no cut below the best vertex cut parts, until ``most`` vertices are left or nothing moves.

    Without ``rounds`` only that ends it.  ``matched``: where the tests that may be applied all at once move nothing, the
    others (half the degree of an end, alone or with a triangle) are applied on a matching.
    Returns the graph, ``mapping(id, block)``, and the value and original vertices ``(id)`` of the best vertex cut met.
    """
    mapping, best = identity(g), None
    if g.vertices.limit(max(most, 2) + 1).count() <= max(most, 2) and not matched:
        return g, mapping, best  # nothing to shrink: the kernel's own bound starts from the vertex cuts
    for _ in count() if rounds is None else range(rounds):
        low = degrees(g).agg(F.min(F.struct("weighted", "id"))).first()[0]
        if low is None:
            break
        if best is None or low[0] < best[0]:
            best = (low[0], materialise(mapping.where(F.col("block") == low[1]).select("id"), "cut-side"))
        n = g.vertices.count()
        if n <= max(most, 2) or best[0] == 0:
            break
        pairs = R.heavy_edges(g, best[0]).union(R.heavy_vertices(g))
        if triangles:
            pairs = pairs.union(R.common_neighbours(g, best[0]))
        pairs = materialise(pairs, "cut-pairs")
        if matched and pairs.limit(1).count() == 0:
            pairs = materialise(R.matching(R.half_vertices(g).union(R.triangle_pairs(g)).distinct()), "cut-matching")
        merged = connected_components(pairs)
        step = g.vertices.join(merged, "id", "left").select("id", F.coalesce("component", "id").alias("block"))
        smaller = contract(g, step)
        smaller = Graph(materialise(smaller.edges, "cut-edges"), materialise(smaller.vertices, "cut-vertices"))
        mapping = materialise(compose(mapping, step), "cut-mapping")
        left = smaller.vertices.count()
        g = smaller
        if left == n or left < 2:
            break
    return g, mapping, best


def trivial_cut(g: Graph, labels: DataFrame, below: int) -> tuple[int, DataFrame] | None:
    """The lightest cut that takes one vertex out of a cluster (``id, block``) of fewer than log2(n) vertices, if it is below ``below``: value and ``id`` of what stays."""
    n = g.vertices.count()
    gain = materialise(R.cluster_cut_gain(g, labels), "trivial-gain")
    small = gain.groupBy("block").agg(F.count("*").alias("size"), F.sum("outside").alias("cut")).where(F.col("size").between(2, max(n.bit_length() - 1, 2)))
    best = gain.join(small, "block").select((F.col("cut") - F.col("outside") + F.col("inside")).alias("value"), "id", "block").orderBy("value", "id").limit(1).collect()
    if not best or best[0]["value"] >= below:
        return None
    return best[0]["value"], labels.where((F.col("block") == best[0]["block"]) & (F.col("id") != best[0]["id"])).select("id")


def multilevel(g: Graph, until: int) -> tuple[Graph, DataFrame, tuple[int, DataFrame] | None]:
    """As :func:`shrink`, but by clusters: while more than ``until`` vertices are left, labels are propagated, single vertices tried outside
    small clusters, the clusters contracted and the safe tests run once.  Heuristic: a minimum cut may be contracted away."""
    mapping, best = identity(g), None
    while True:
        n = g.vertices.count()
        if n <= until:
            break
        labels = materialise(R.label_propagation(g).select("id", F.col("label").alias("block")), "labels")
        low = degrees(g).agg(F.min(F.struct("weighted", "id"))).first()[0]
        found = [(low[0], g.vertices.where(F.col("id") == low[1]).select("id"))]
        found += [x for x in [trivial_cut(g, labels, low[0])] if x]
        for value, ids in found:
            if best is None or value < best[0]:
                best = (value, materialise(mapping.join(ids.select(F.col("id").alias("block")), "block", "left_semi").select("id"), "cut-side"))
        if best[0] == 0:
            break
        mapping = materialise(compose(mapping, labels), "level-mapping")
        h = contract(g, labels)
        g, step, more = shrink(Graph(materialise(h.edges, "level-edges"), materialise(h.vertices, "level-vertices")), until, rounds=1)
        if more is not None and more[0] < best[0]:
            best = (more[0], materialise(mapping.join(more[1].select(F.col("id").alias("block")), "block", "left_semi").select("id"), "cut-side"))
        mapping = materialise(compose(mapping, step), "level-mapping")
        if g.vertices.count() in (n, 1):
            break
    return g, mapping, best


def min_cut(g: Graph, algorithm: str = "exact", seed: int = 0, kernel: int = 2_000, repetitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(cut_value, n, m)`` as one row, and ``id, side`` of every vertex (the smallest id on side 0); NULL under two vertices."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algorithm!r}; one of {', '.join(ALGORITHMS)}")
    n = g.vertices.count()
    sizes = g.edges.agg(F.count("*").alias("m")).select(F.lit(n).cast("long").alias("n"), "m")
    if n < 2:
        return sizes.select(F.lit(None).cast("long").alias("cut_value"), "n", "m"), g.vertices.select("id", F.lit(0).alias("side"))
    pr = algorithm == "pr"  # no kernel: the tests alone, and the best vertex cut that they meet
    if pr:
        small, mapping, best = shrink(g, 2, rounds=None, matched=True)
    elif algorithm in ("vc", "inexact"):
        small, mapping, best = multilevel(g, kernel)
    else:
        small, mapping, best = shrink(g, kernel, rounds=None)
    def solve(a: K.Adj) -> list[tuple]:
        if algorithm == "matula":
            value, side = K.noi(a, approximate=True)
        elif algorithm == "stoer_wagner":
            value, side = K.stoer_wagner(a)
        else:
            value, side = K.noi(a, seed=seed)
        return [(v, value) for v in side]

    found: list[tuple] = []  # blocks of one side and the value: at most KERNEL_VERTICES rows a run
    if not (pr and best is not None) and small.vertices.limit(2).count() > 1:
        if algorithm == "ks":
            runs = repetitions or max(1, (n - 1).bit_length())
            tried = in_one_group(small, lambda a, i: [(v, value, i) for value, side in [K.karger_stein(a, seed + i)] for v in side], "block long, cut_value long, run long", runs=runs)
            least = materialise(tried, "cut-runs")
            first = least.agg(F.min(F.struct("cut_value", "run"))).first()[0]
            found = [tuple(r)[:2] for r in least.where(F.col("run") == first["run"]).collect()]
        else:
            found = [tuple(r) for r in in_one_group(small, solve, "block long, cut_value long").collect()]
    value = found[0][1] if found else None
    if best is not None and (value is None or best[0] < value):
        value = best[0]
        inside = best[1]
    else:
        blocks = g.edges.sparkSession.createDataFrame([(b,) for b, _ in found], "block long")
        inside = mapping.join(F.broadcast(blocks), "block", "left_semi").select("id")
    inside = materialise(inside.distinct(), "cut-inside")
    flip = inside.join(g.vertices.agg(F.min("id").alias("id")), "id").limit(1).count() > 0
    side = F.col("in").isNull() if flip else F.col("in").isNotNull()
    sides = g.vertices.join(inside.withColumn("in", F.lit(1)), "id", "left").select("id", side.cast("int").alias("side"))
    return sizes.select(F.lit(value).cast("long").alias("cut_value"), "n", "m"), sides


def min_cut_value(g: Graph, algorithm: str = "exact", **options: int) -> DataFrame:
    """``cut_value, n, m, consistent``: whether the edges across the reported sides weigh as much."""
    value, sides = min_cut(g, algorithm, **options)
    across = edge_cut(g, sides.select("id", F.col("side").alias("block")))
    return value.crossJoin(across.select("cut_weight")).select("cut_value", "n", "m", F.coalesce(F.col("cut_value") == F.col("cut_weight"), F.lit(True)).alias("consistent"))  # one row each


def contract_then_cut(g: Graph, factor: float, seed: int = 0, algorithm: str = "exact") -> DataFrame:
    """Contract random edges until about n * (1 - factor) vertices are left, then cut."""
    n = g.vertices.count()
    merged = connected_components(R.sampled_edges(g, int(n * factor), seed))
    step = g.vertices.join(merged, "id", "left").select("id", F.coalesce("component", "id").alias("block"))
    return min_cut_value(contract(g, step), algorithm)


def heavy_vertices_cut(g: Graph, p: float) -> DataFrame:
    """Cut without the heavy vertices, put each of them where most of its weight is (ties: side 1), and weigh the result."""
    light = without_heavy(g, p)
    _, sides = min_cut(light)
    votes = g.arcs().join(sides.select(F.col("id").alias("dst"), "side"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.when(F.col("side") == 1, F.col("weight")).otherwise(-F.col("weight"))).alias("v"))
    all_sides = g.vertices.join(sides, "id", "left").join(votes, "id", "left").select("id", F.coalesce("side", (F.coalesce("v", F.lit(0)) >= 0).cast("int")).alias("block"))
    return edge_cut(g, all_sides)


def safe_for_all(g: Graph, most: int) -> tuple[Graph, DataFrame]:
    """Contract what no minimum cut parts: certificates above the least vertex cut, and strict tests with both degrees above it."""
    mapping = identity(g)
    while True:
        n = g.vertices.count()
        low = degrees(g).agg(F.min("weighted")).first()[0]
        if n <= most or not low:
            break
        pairs = R.heavy_edges(g, low + 1).union(R.heavy_vertices(g, low)).union(R.common_neighbours(g, low + 1)).union(R.triangle_pairs(g, low))
        merged = connected_components(materialise(pairs, "all-pairs"))
        step = g.vertices.join(merged, "id", "left").select("id", F.coalesce("component", "id").alias("block"))
        h = contract(g, step)
        g = Graph(materialise(h.edges, "all-edges"), materialise(h.vertices, "all-vertices"))
        mapping = materialise(compose(mapping, step), "all-mapping")
        if g.vertices.count() == n:
            break
    return g, mapping


def all_min_cuts(g: Graph, kernel: int = 500) -> DataFrame:
    """``cut, cut_value, id, side`` of every minimum cut; cuts are numbered by size of side 1 and its members.

    No rows under two vertices or for a disconnected graph, whose cuts of value 0 are any unions of components.
    """
    small, mapping = safe_for_all(g, kernel)

    def solve(a: K.Adj) -> list[tuple]:
        value, cuts = K.all_min_cuts(a) if len(K.components(a)) < 2 else (0, [])
        return [(i, value, v) for i, c in enumerate(cuts) for v in c]

    found = materialise(in_one_group(small, solve, "cut long, cut_value long, block long"), "all-cuts")
    members = found.join(mapping, "block").select("cut", "cut_value", "id")
    cuts = members.select("cut", "cut_value").distinct()
    return cuts.crossJoin(g.vertices).join(members.select("cut", "id", F.lit(1).alias("one")), ["cut", "id"], "left").select("cut", "cut_value", "id", F.coalesce("one", F.lit(0)).alias("side"))


def local_certificates(g: Graph, blocks: DataFrame, bound: int, most: int = KERNEL_VERTICES) -> DataFrame:
    """``src, dst``: pairs inside a block ``(id, block)`` that are connected by ``bound`` or more there, and so in the whole graph.

    One scan a block, side by side; blocks above ``most`` vertices are left out, which loses pairs but no correctness.  All may be merged at once.
    """
    few = blocks.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n").between(2, most)).select("block")
    part = blocks.join(few, "block")
    ends = [part.select(F.col("id").alias(c), F.col("block").alias(f"b_{c}")) for c in ("src", "dst")]
    inside = g.edges.join(ends[0], "src").join(ends[1], "dst").where("b_src = b_dst").select(F.col("b_src").alias("block"), "src", "dst", "weight")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = K.adjacency(pdf[["src", "dst", "weight"]].astype("int64").itertuples(index=False, name=None))
        return pd.DataFrame(K.scan(a, bound, min(a)), columns=["src", "dst"])

    return inside.groupBy("block").applyInPandas(run, "src long, dst long")


def cut_list(g: Graph, kernel: int = 500) -> DataFrame:
    """``cut_value, members``: the sorted vertices of the side without the smallest, one row a minimum cut."""
    rows = all_min_cuts(g, kernel).where("side = 1")
    low = g.vertices.agg(F.min("id")).first()[0]
    out = rows.groupBy("cut", "cut_value").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return out.where(~F.array_contains("ids", F.lit(low))).select("cut_value", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("members"))


def cactus(g: Graph, kernel: int = 500) -> tuple[DataFrame, DataFrame]:
    """``node_id, contained`` and ``u, v, weight`` of the cactus of all minimum cuts."""
    small, mapping = safe_for_all(g, kernel)

    def solve(a: K.Adj) -> list[tuple]:
        value, cuts = K.all_min_cuts(a) if len(K.components(a)) < 2 else (0, [])
        nodes, edges = K.cactus(sorted(a), value or 0, cuts) if a else ([], [])
        return [(0, i, v, None) for i, m in enumerate(nodes) for v in (m or [None])] + [(1, u, v, w) for u, v, w in edges]

    rows = materialise(in_one_group(small, solve, "kind long, a long, b long, c long"), "cactus")
    inside = rows.where("kind = 0").select(F.col("a").alias("node_id"), F.col("b").alias("block")).join(mapping, "block", "left")
    nodes = inside.groupBy("node_id").agg(F.sort_array(F.collect_list("id")).alias("contained"))
    return nodes, rows.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("c").alias("weight"))


def balanced_cut(g: Graph, by: str = "size") -> DataFrame:
    """The minimum cut whose lighter side has the most vertices (``size``) or degree (``volume``, the lowest conductance)."""
    cuts = all_min_cuts(g).join(degrees(g), "id")
    w = F.lit(1) if by == "size" else F.col("weighted")
    one, zero = F.sum(F.when(F.col("side") == 1, w).otherwise(0)), F.sum(F.when(F.col("side") == 0, w).otherwise(0))
    sides = cuts.groupBy("cut", "cut_value").agg(one.cast("long").alias("a"), zero.cast("long").alias("b"))
    return sides.select("cut_value", F.least("a", "b").alias("lighter")).groupBy("cut_value").agg(F.max("lighter").alias("lighter"))


def decompose(g: Graph, until: int = 1000) -> list[Graph]:
    """The graph, then again and again the largest component of the larger side of a minimum cut, while it has more than ``until`` vertices."""
    from cleave.operators.components import largest_component

    out = [g]
    while g.vertices.count() > until:
        _, sides = min_cut(g)
        sides = materialise(sides, "decompose")
        big = sides.groupBy("side").count().orderBy(F.desc("count"), "side").first()
        if big is None or big[1] == g.vertices.count():
            break
        part = induced(g, sides.where(F.col("side") == big[0]).select("id"))
        g = induced(part, largest_component(part))
        g = Graph(materialise(g.edges, "decompose-edges"), materialise(g.vertices, "decompose-vertices"))
        out.append(g)
    return out


def st_cut(g: Graph, vertices: list[int], source: int = 0, limit: int | None = None) -> DataFrame:
    """``flow, id``: the flow from one listed vertex to all others listed, and the largest source side; flow -1 and a null id for unknown ids."""

    def solve(a: K.Adj) -> list[tuple]:
        value, side = K.max_flow(a, vertices, source, limit)
        return [(value, v) for v in sorted(side)] or [(value, None)]

    return in_one_group(g, solve, "flow long, id long")


def isolating_cuts(g: Graph, terminals: list[int]) -> DataFrame:
    """``terminal, flow, side_size`` for every terminal against the others; one group a terminal, after a check of the graph's size."""
    components_checked(g)
    rows = g.edges.select("src", "dst", "weight")
    each = rows.sparkSession.createDataFrame([(t,) for t in terminals], "terminal long")
    per = each.crossJoin(rows)  # one copy of a graph of bounded components for each terminal

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a = K.adjacency(pdf[["src", "dst", "weight"]].itertuples(index=False, name=None), terminals)
        value, side = K.max_flow(a, [key[0], *(t for t in terminals if t != key[0])])
        return pd.DataFrame([(key[0], value, len(side))], columns=["terminal", "flow", "side_size"])

    return per.groupBy("terminal").applyInPandas(run, "terminal long, flow long, side_size long")


def multiterminal_bounds(g: Graph, terminals: list[int]) -> DataFrame:
    """``lower, upper`` of the multiterminal cut from isolating cuts."""
    return isolating_cuts(g, terminals).agg(F.ceil(F.sum("flow") / 2).cast("long").alias("lower"), (F.sum("flow") - F.max("flow")).cast("long").alias("upper"))


def multiterminal_cut(g: Graph, terminals: list[int], kernel: int = 500, **options: object) -> DataFrame:
    """``component, cut_value, is_optimal, id, block``: where every vertex goes, and what the cut of its component weighs.

    A graph above ``kernel`` vertices is first reduced by joins; then components with two terminals or more are solved, one group each.
    A component with one terminal is its block; without any it is block of the first terminal.  ``options`` are those of the solver:
    ``rule``, ``order``, ``inexact``, ``seed``, ``seconds``.
    """
    small, mapping = g, identity(g)
    if g.vertices.limit(kernel + 1).count() > kernel:
        small, mapping, _ = reduced(g, by_ids(g, terminals))
    comp = components_checked(small)
    e = small.edges.join(comp.select(F.col("id").alias("src"), "component"), "src").select("component", "src", "dst", "weight")
    none = F.lit(None).cast("long")
    rows = e.union(comp.select("component", "id", none, none))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf[pdf["dst"].isna()]["src"].astype("int64").tolist()
        have = set(ids)
        mine = [t for t in terminals if t in have]
        if len(mine) < 2:
            out = [(v, mine[0] if mine else terminals[0], True) for v in ids]
        else:
            a = K.adjacency(pdf[pdf["dst"].notna()][["src", "dst", "weight"]].astype("int64").itertuples(index=False, name=None), ids)
            _, block, sure = M.multiterminal(a, mine, **options)
            out = [(v, block[v], sure) for v in sorted(block)]
        return pd.DataFrame(out, columns=["place", "block", "sure"])

    solved = rows.groupBy("component").applyInPandas(run, "place long, block long, sure boolean")
    placed = mapping.withColumnRenamed("block", "place").join(solved, "place").select("id", "block", "sure")
    placed = materialise(placed.join(all_components(g), "id"), "multi-placed")
    ends = [placed.select(F.col("id").alias(c), F.col("block").alias(f"b_{c}"), *(["component"] if c == "src" else [])) for c in ("src", "dst")]
    cut = g.edges.join(ends[0], "src").join(ends[1], "dst").where("b_src <> b_dst").groupBy("component").agg(F.sum("weight").alias("w"))
    sure = placed.groupBy("component").agg(F.min("sure").alias("is_optimal"))
    return placed.select("id", "block", "component").join(sure, "component").join(cut, "component", "left").select("component", F.coalesce("w", F.lit(0)).alias("cut_value"), "is_optimal", "id", "block")


def multiterminal_value(g: Graph, terminals: list[int], **options: object) -> DataFrame:
    """``cut_value, is_optimal`` over all components."""
    each = multiterminal_cut(g, terminals, **options).groupBy("component").agg(F.first("cut_value").alias("v"), F.first("is_optimal").alias("o"))
    return each.agg(F.sum("v").alias("cut_value"), F.min("o").alias("is_optimal"))


def structure(g: Graph, most: int = KERNEL_VERTICES) -> DataFrame:
    """``kind, u, v``: articulation points (v null) and bridges, one group a component; components above ``most`` vertices by joins, of all together."""
    comp = materialise(all_components(g), "structure-components")
    sizes = comp.groupBy("component").agg(F.count("*").alias("n"))
    e = materialise(g.edges.join(comp.select(F.col("id").alias("src"), "component"), "src").join(sizes, "component").select("component", "n", "src", "dst", "weight"), "structure-edges")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        points, bridges = K.articulation_points(K.adjacency(pdf[["src", "dst", "weight"]].itertuples(index=False, name=None)))
        return pd.DataFrame([("point", u, None) for u in sorted(points)] + [("bridge", u, v) for u, v in sorted(bridges)], columns=["kind", "u", "v"])

    few = e.where(F.col("n") <= most).drop("n").groupBy("component").applyInPandas(run, "kind string, u long, v long")
    large = e.where(F.col("n") > most)
    if not large.limit(1).count():
        return few
    roots = large.select(F.col("component").alias("id")).distinct()
    tree = materialise(tree_blocks(Graph.of(large.select("src", "dst", "weight")), roots), "structure-blocks")
    around = tree.select(F.explode(F.array("id", "parent")).alias("u"), "block").groupBy("u").agg(F.min("block").alias("one"), F.max("block").alias("other"))
    none = F.lit(None).cast("long")
    points = around.where("one <> other").select(F.lit("point").alias("kind"), "u", none.alias("v"))
    bridges = tree.where("bridge").select(F.lit("bridge").alias("kind"), F.least("id", "parent").alias("u"), F.greatest("id", "parent").alias("v"))
    return few.union(points).union(bridges)


def cliques(g: Graph) -> DataFrame:
    """``members``: the maximal cliques, as sorted ids joined by commas."""
    return in_one_group(g, lambda a: [(",".join(map(str, c)),) for c in K.maximal_cliques(a)], "members string")


def _start(edges: DataFrame | None) -> list[tuple]:
    most = KERNEL_VERTICES * 20
    start = [] if edges is None else [tuple(r) for r in edges.select("src", "dst", "weight").limit(most + 1).collect()]
    if len(start) > most:
        raise ValueError(f"the start graph has more than {most} edges; it can't be replayed in one group")
    return start


def _in_order(updates: DataFrame, met: bool = False) -> DataFrame:
    """The updates sorted within one partition a stream, for a task that reads them batch by batch.

    An update with a null end has no edge: its ends become a loop, which changes nothing.  With ``met`` a first row that is not ``real`` lets the one
    stream of a frame without ``graph`` be met even if it is empty.
    """
    rows = updates if "graph" in updates.columns else updates.withColumn("graph", F.lit(0).cast("long"))
    known = F.col("src").isNotNull() & F.col("dst").isNotNull()
    rows = rows.select("graph", "ts", "seq", *(F.when(known, F.col(c)).otherwise(0).alias(c) for c in ("src", "dst")), "delta", F.lit(True).alias("real"))
    if met and "graph" not in updates.columns:
        nothing = {"graph": F.lit(0), "src": F.lit(0), "dst": F.lit(0), "delta": F.lit(0), "real": F.lit(False)}
        rows = rows.union(updates.sparkSession.range(1).select(*(nothing.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema)))
    return rows.repartition("graph").sortWithinPartitions("graph", F.asc_nulls_last("ts"), "seq")


def replay(updates: DataFrame, edges: DataFrame | None = None, one_by_one: bool = False) -> DataFrame:
    """``ts, cut_value, changes`` after each timestamp's updates ``(seq, src, dst, delta, ts)``, in the order of (ts, seq).

    ``graph`` groups separate streams where the column exists; each is read once, in batches.  ``one_by_one`` gives a row for every update.  Start graphs
    of more than 20 * KERNEL_VERTICES edges are refused.
    """
    start = _start(edges)
    names = ["graph", "ts", "seq", "cut_value", "changes"]
    ts = updates.schema["ts"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph, last = None, None  # the stream at hand, and the row of its timestamp at hand
        for pdf in batches:
            out = []
            for (key, t), part in pdf.groupby(["graph", "ts"], sort=False):
                if graph != key:
                    graph, d, changes = key, K.DynamicCut(start), 0
                    before = d.value
                if last is not None and last[:2] != (key, t):
                    out.append(last)
                for seq, src, dst, delta in zip(*(part[c].tolist() for c in ("seq", "src", "dst", "delta")), strict=True):
                    now = d.insert(src, dst, delta) if delta > 0 else d.delete(src, dst)
                    changes += now != before
                    before = now
                    if one_by_one:
                        out.append((key, t, seq, now, changes))
                last = None if one_by_one else (key, t, part["seq"].max(), d.value, changes)
            yield pd.DataFrame(out, columns=names)
        if last is not None:
            yield pd.DataFrame([last], columns=names)

    return _in_order(updates).where("ts is not null").drop("real").mapInPandas(run, f"graph long, ts {ts}, seq long, cut_value long, changes long")


def replay_totals(updates: DataFrame, edges: DataFrame | None = None, seconds: float = 3600.0) -> DataFrame:
    """``graph, inserts, deletes, changes, solves, cut_value, timed_out``: one row a stream, even for one of no updates; what is left after ``seconds`` is not applied.

    Updates with a null end or ``ts`` are counted; those with a null end change nothing.
    """
    import time

    start = _start(edges)
    names = ["graph", "inserts", "deletes", "changes", "solves", "cut_value", "timed_out"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = d = None
        for pdf in batches:
            for key, part in pdf.groupby("graph", sort=False):
                if graph != key:
                    if d is not None:
                        yield pd.DataFrame([(graph, inserts, deletes, changes, d.solves, d.value, late)], columns=names)
                    stop, graph, d = time.monotonic() + seconds, key, K.DynamicCut(start)
                    inserts = deletes = changes = 0
                    before, late = d.value, False
                part = part[part["real"]]
                for src, dst, delta in zip(*(part[c].tolist() for c in ("src", "dst", "delta")), strict=True):
                    if late or time.monotonic() > stop:
                        late = True
                        break
                    if delta > 0:
                        now, inserts = d.insert(src, dst, delta), inserts + 1
                    else:
                        now, deletes = d.delete(src, dst), deletes + 1
                    changes += now != before
                    before = now
        if d is not None:
            yield pd.DataFrame([(graph, inserts, deletes, changes, d.solves, d.value, late)], columns=names)

    return _in_order(updates, True).mapInPandas(run, "graph long, inserts long, deletes long, changes long, solves long, cut_value long, timed_out boolean")
