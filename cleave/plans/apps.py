"""Whole programs over graphs: cores, temporal components, overlays, small balanced cuts, clusters, centres."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cleave.functions import kernels as K
from cleave.graph import Graph
from cleave.operators.components import all_components, bfs, core_numbers, largest_component
from cleave.operators.reduce import cluster_cut_gain
from cleave.operators.relational import contract, degrees, induced
from cleave.plans import cuts
from cleave.session import materialise
from cleave.sources.generators import draw


def kept(g: Graph, name: str) -> Graph:
    """The graph as written tables."""
    return Graph(materialise(g.edges, f"{name}-edges"), materialise(g.vertices, f"{name}-vertices"))


def core_graph(g: Graph, k: int, cores: DataFrame | None = None) -> Graph:
    """The largest component of the vertices of core ``k`` or more, with their edges' weights."""
    cores = core_numbers(g) if cores is None else cores
    part = kept(induced(g, cores.where(F.col("core") >= k).select("id")), "core")
    return induced(part, largest_component(part))


def core_cuts(g: Graph, ks: list[int], least_n: int = 2) -> DataFrame:
    """``k, n, m, cut_value, min_degree``: the minimum cut of the core graph of every k, where it has ``least_n`` vertices; the interesting ones are cut below the least degree."""
    spark, rows = g.edges.sparkSession, []
    cores = materialise(core_numbers(g), "cores")
    for k in ks:
        part = kept(core_graph(g, k, cores), "core-cut")
        r = cuts.min_cut(part)[0].first()
        if r["n"] >= least_n:
            rows.append((k, r["n"], r["m"], r["cut_value"], degrees(part).agg(F.min("weighted")).first()[0]))
    return spark.createDataFrame(rows, "k int, n long, m long, cut_value long, min_degree long")


def temporal_largest(updates: DataFrame) -> DataFrame:
    """``seq, src, dst, delta, ts``: the updates inside the largest component of all edges ever inserted, with vertices renumbered 0, 1, ... by id."""
    g = Graph.of(updates.where("delta > 0").select("src", "dst", F.lit(1).alias("weight")))
    inside = materialise(largest_component(g), "temporal-inside")
    n = inside.count()
    buckets = max(1, n // 1_000_000)  # ranks: by range of ids, then inside a range
    low = inside.agg(F.min("id"), F.max("id")).first()
    width = max(1, -(-((low[1] or 0) - (low[0] or 0) + 1) // buckets))
    ranged = inside.withColumn("b", F.floor((F.col("id") - F.lit(low[0] or 0)) / F.lit(width)))
    sizes = ranged.groupBy("b").agg(F.count("*").alias("c"))
    start = sizes.select("b", F.coalesce(F.sum("c").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))  # a row a range
    number = ranged.join(start, "b").select("id", (F.col("start") + F.row_number().over(W.partitionBy("b").orderBy("id")) - 1).alias("number"))
    a, b = (number.select(F.col("id").alias(c), F.col("number").alias(f"n_{c}")) for c in ("src", "dst"))
    return updates.join(a, "src").join(b, "dst").select("seq", F.col("n_src").alias("src"), F.col("n_dst").alias("dst"), "delta", "ts")


def overlay_stream(g: Graph, each: int, seed: int = 0) -> tuple[Graph, DataFrame]:
    """The graph with ``each`` random edges more a vertex, and updates that delete those one by one in a random order.  Vertices are 0 .. n-1."""
    n = g.vertices.count()
    more = g.vertices.select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(each))).alias("k")).select("src", draw(n, F.col("src"), F.col("k"), seed).alias("dst"), F.lit(1).cast("long").alias("weight"))
    more = Graph.of(more.where("src <> dst"), g.vertices).edges.join(g.edges.select("src", "dst"), ["src", "dst"], "left_anti")
    gone = more.select(F.xxhash64("src", "dst", F.lit(seed + 1)).alias("seq"), "src", "dst", (-F.col("weight")).alias("delta"))
    return Graph(g.edges.unionByName(more), g.vertices), gone.withColumn("ts", F.col("seq"))


def augmenting_stream(g: Graph, n: int, seed: int = 0, kernel: int = 500) -> DataFrame:
    """``seq, src, dst, delta, ts``: n inserts of edges between vertices of different cactus nodes that are no neighbours, then their deletions in the same order."""
    nodes, _ = cuts.cactus(g, kernel)
    spot = materialise(nodes.select("node_id", F.explode("contained").alias("id")), "augment-spots")
    order = F.xxhash64("id", F.lit(seed))
    first = spot.orderBy(order, "id").limit(4 * n)  # a draw of ends; every pair below joins two of them
    a, b = first.toDF("node_a", "src"), first.toDF("node_b", "dst")
    pairs = a.join(b, F.col("src") < F.col("dst")).where("node_a <> node_b").join(g.edges.select("src", "dst"), ["src", "dst"], "left_anti")
    chosen = pairs.orderBy(F.xxhash64("src", "dst", F.lit(seed + 1)), "src", "dst").limit(n)
    ranked = chosen.select((F.row_number().over(W.orderBy("src", "dst")) - 1).cast("long").alias("seq"), "src", "dst")  # n rows
    inserted = ranked.select("seq", "src", "dst", F.lit(1).cast("long").alias("delta"), F.col("seq").alias("ts"))
    total = F.lit(n).cast("long")
    return inserted.union(ranked.select(F.col("seq") + total, "src", "dst", F.lit(-1).cast("long"), F.col("seq") + total))


def small_balanced_cuts(g: Graph, rounds: int, augment: bool = False) -> DataFrame:
    """``round, cut_value, small, large``: the most balanced minimum cut, then the same after its smaller side has been contracted
    (or, with ``augment``, after every edge of the cut weighs one more), and so on."""
    out: list[tuple] = []
    size = g.vertices.select("id", F.lit(1).cast("long").alias("size"))
    for r in range(rounds):
        g = kept(g, "balanced")
        if g.vertices.limit(2).count() < 2:
            break
        sides = materialise(cuts.all_min_cuts(g).join(size, "id"), "balanced-sides")
        by = sides.groupBy("cut", "cut_value").agg(F.sum(F.when(F.col("side") == 1, F.col("size")).otherwise(0)).alias("one"), F.sum("size").alias("all"))
        best = by.orderBy(F.desc(F.least("one", F.col("all") - F.col("one"))), "cut").first()
        if best is None:
            break
        small = min(best["one"], best["all"] - best["one"])
        out.append((r, best["cut_value"], small, best["all"] - small))
        mine = sides.where(F.col("cut") == best["cut"]).select("id", F.col("side").alias("block"))
        if augment:
            ends = [mine.select(F.col("id").alias(c), F.col("block").alias(f"b_{c}")) for c in ("src", "dst")]
            e = g.edges.join(ends[0], "src").join(ends[1], "dst")
            g = Graph(e.select("src", "dst", (F.col("weight") + (F.col("b_src") != F.col("b_dst")).cast("long")).alias("weight")), g.vertices)
            continue
        inside = mine.where(F.col("block") == (1 if best["one"] == small else 0)).select("id")
        low = inside.agg(F.min("id")).first()[0]
        step = materialise(g.vertices.join(inside.withColumn("in", F.lit(1)), "id", "left").select("id", F.when(F.col("in") == 1, F.lit(low)).otherwise(F.col("id")).alias("block")), "balanced-step")
        size = materialise(size.join(step, "id").groupBy(F.col("block").alias("id")).agg(F.sum("size").alias("size")), "balanced-size")
        g = contract(g, step)
    return g.edges.sparkSession.createDataFrame(out, "round int, cut_value long, small long, large long")


def certified_clusters(g: Graph, blocks: DataFrame) -> DataFrame:
    """``id, cluster``: vertices with more weight outside their block than inside stand alone; what is left of a block is cut into its components, named by the smallest member."""
    gain = cluster_cut_gain(g, blocks)
    out = materialise(gain.where("outside > inside").select("id"), "cluster-out")
    left = blocks.join(out, "id", "left_anti")
    a, b = (left.select(F.col("id").alias(c), F.col("block").alias(f"b_{c}")) for c in ("src", "dst"))
    inside = Graph(materialise(g.edges.join(a, "src").join(b, "dst").where("b_src = b_dst").select("src", "dst", "weight"), "cluster-edges"), g.vertices)
    return all_components(inside).withColumnRenamed("component", "cluster")


def centre(g: Graph) -> DataFrame:
    """``id, radius``: the middle of a longest shortest path as two sweeps find it: from the smallest id to the farthest vertex, from there to the farthest again."""
    arcs = kept(g, "centre")
    end = arcs.vertices.agg(F.min("id").alias("id"))
    for _ in range(2):
        sweep = materialise(bfs(arcs, end), "centre-sweep")
        far = sweep.orderBy(F.desc("distance"), "id").limit(1).select("id", "distance").collect()
        if not far:
            return sweep.select("id", F.col("distance").alias("radius"))
        end = g.edges.sparkSession.createDataFrame([(far[0]["id"],)], "id long")
    at, length = far[0]["id"], far[0]["distance"]
    step = sweep.select(F.col("id").alias("at"), "parent")
    walk = end.select(F.col("id").alias("at"))
    for _ in range(length // 2):  # half a diameter of lookups
        walk = walk.join(step, "at").select(F.col("parent").alias("at"))
        walk = g.edges.sparkSession.createDataFrame(walk.collect(), "at long")  # one row
    return walk.select(F.col("at").alias("id"), F.lit(length - length // 2).alias("radius"))


def semi_isolated_cliques(g: Graph) -> DataFrame:
    """``members, external``: maximal cliques of two or more whose edges to the outside weigh at most twice their least inner edge for every member but one."""

    def solve(a: K.Adj) -> list[tuple]:
        out = []
        for c in K.maximal_cliques(a):
            if len(c) > 1:
                inside = set(c)
                least = min(a[u][v] for u in c for v in c if u < v)
                external = sum(w for u in c for v, w in a[u].items() if v not in inside)
                if external <= 2 * least * (len(c) - 1):
                    out.append((",".join(map(str, c)), external))
        return out

    return cuts.in_one_group(g, solve, "members string, external long")


def result_row(g: Graph, algorithm: str, seed: int = 0) -> DataFrame:
    """One row of metrics of a run: ``algorithm, seed, n, m, cut_value, least_degree, side_0, side_1, seconds``."""
    import time

    began = time.monotonic()
    value, sides = cuts.min_cut(g, algorithm, seed=seed)
    sizes = {r["side"]: r["count"] for r in sides.groupBy("side").count().collect()}
    low = degrees(g).agg(F.min("weighted")).first()[0]
    took = time.monotonic() - began
    lits = (F.lit(algorithm).alias("algorithm"), F.lit(seed).alias("seed"))
    return value.select(*lits, "n", "m", "cut_value", F.lit(low).cast("long").alias("least_degree"), F.lit(sizes.get(0, 0)).cast("long").alias("side_0"), F.lit(sizes.get(1, 0)).cast("long").alias("side_1"), F.lit(took).alias("seconds"))


def chain(graphs: Iterator[Graph]) -> DataFrame:
    """``level, n, m`` of a list of graphs."""
    out = None
    for i, g in enumerate(graphs):
        row = g.vertices.agg(F.count("*").alias("n")).crossJoin(g.edges.agg(F.count("*").alias("m"))).select(F.lit(i).alias("level"), "n", "m")  # one row each
        out = row if out is None else out.union(row)
    return out
