"""Terminals of multiterminal cuts: how they are chosen and grown, the reductions that joins can do, and the split by component."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cleave.graph import Graph
from cleave.operators.components import all_components, bfs
from cleave.operators.reduce import _with_degrees
from cleave.operators.relational import compose, contract, degrees, delete_terminal_edges, top_degrees
from cleave.session import materialise


def by_ids(g: Graph, ids: list[int]) -> DataFrame:
    """``id, place`` of the listed vertices that the graph has, in the order of the list."""
    rows = g.edges.sparkSession.createDataFrame([(v, i) for i, v in enumerate(ids)], "id long, place int")
    return rows.join(g.vertices, "id", "left_semi")


def _ranked(rows: DataFrame, *order: Column) -> DataFrame:
    return rows.select("id", (F.row_number().over(W.orderBy(*order)) - 1).alias("place"))  # k rows


def by_degree(g: Graph, k: int, weighted: bool = True) -> DataFrame:
    """``id, place`` of the k vertices of largest degree; ties go to smaller ids."""
    key = "weighted" if weighted else "degree"
    return _ranked(top_degrees(g, k, weighted), F.desc(key), F.col("id"))


def at_random(g: Graph, k: int, seed: int = 0) -> DataFrame:
    """``id, place`` of k vertices, the first in the order of a hash with ``seed``."""
    key = F.xxhash64("id", F.lit(seed))
    return _ranked(g.vertices.orderBy(key, "id").limit(k), key, F.col("id"))


def far_apart(g: Graph, k: int) -> DataFrame:
    """``id, place``: the vertex of largest degree, then k - 1 times the one farthest from all before it (out of reach is farthest; ties: smaller id)."""
    chosen = [r["id"] for r in top_degrees(g, 1).collect()]
    while chosen and len(chosen) < k:
        seen = bfs(g, by_ids(g, chosen).select("id"))
        left = g.vertices.join(seen.select("id", "distance"), "id", "left").where(~F.col("id").isin(chosen))
        best = left.orderBy(F.desc_nulls_first("distance"), "id").limit(1).collect()
        if not best:
            break
        chosen.append(best[0]["id"])
    return by_ids(g, chosen)


def grown(g: Graph, terminals: DataFrame, size: int) -> DataFrame:
    """``id, terminal``: up to ``size`` vertices around each terminal, nearest first (ties: smaller id); a vertex belongs to the nearest terminal (ties: its place)."""
    arcs = materialise(g.arcs().select("src", "dst"), "grow-arcs")
    seen = materialise(terminals.select("id", F.lit(0).alias("distance"), F.col("id").alias("terminal"), "place"), "grow")
    front, depth = seen, 0
    while True:
        depth += 1
        step = arcs.join(front.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.struct("place", "terminal")).alias("t"))
        new = step.join(seen.select("id"), "id", "left_anti").select("id", F.lit(depth).alias("distance"), "t.terminal", "t.place")
        front = materialise(new, "grow")
        full = seen.groupBy("terminal").agg(F.count("*").alias("n")).where(F.col("n") < size).limit(1).count() == 0
        if full or not front.limit(1).count():
            break
        seen = materialise(seen.union(front), "grow-seen")
    rank = F.row_number().over(W.partitionBy("terminal").orderBy("distance", "id"))
    return seen.withColumn("r", rank).where(F.col("r") <= size).select("id", "terminal")


def low_degree_pairs(g: Graph, terminals: DataFrame) -> DataFrame:
    """``src, dst``: vertices with one or two neighbours that are no terminals, and their heavier neighbour (ties: smaller id)."""
    few = degrees(g).where(F.col("degree").between(1, 2)).join(terminals.select("id"), "id", "left_anti").select(F.col("id").alias("src"))
    near = g.arcs().join(few, "src", "left_semi")
    return near.groupBy("src").agg(F.max(F.struct("weight", (-F.col("dst")).alias("dst"))).alias("x")).select("src", (-F.col("x.dst")).alias("dst"))


def heavy_pairs(g: Graph, terminals: DataFrame) -> DataFrame:
    """``src, dst``: vertices that are no terminals, and the neighbour that has more than half of their weight.

    In every best solution such a vertex stands with that neighbour, so all pairs may be merged at once.
    """
    e = _with_degrees(g)
    one = e.where(2 * F.col("weight") > F.col("d_src")).select("src", "dst").union(e.where(2 * F.col("weight") > F.col("d_dst")).select("dst", "src"))
    return one.join(terminals.select(F.col("id").alias("src")), "src", "left_anti")


def terminal_pull(g: Graph, terminals: DataFrame) -> DataFrame:
    """``src, dst``: vertices whose heaviest terminal outweighs the second one and all that is no terminal, and that terminal.

    As with :func:`heavy_pairs`, all may be merged at once.
    """
    t = terminals.select(F.col("id").alias("dst"), F.lit(True).alias("to_terminal"))
    arcs = g.arcs().join(terminals.select(F.col("id").alias("src")), "src", "left_anti").join(t, "dst", "left")
    order = W.partitionBy("src", F.col("to_terminal").isNotNull()).orderBy(F.desc("weight"), "dst")
    ranked = arcs.withColumn("r", F.row_number().over(order))
    own = F.col("to_terminal").isNotNull()
    sums = ranked.groupBy("src").agg(
        F.max(F.when(own & (F.col("r") == 1), F.struct("weight", "dst"))).alias("first"),
        F.coalesce(F.max(F.when(own & (F.col("r") == 2), F.col("weight"))), F.lit(0)).alias("second"),
        F.coalesce(F.sum(F.when(~own, F.col("weight"))), F.lit(0)).alias("rest"),
    )
    return sums.where(F.col("first.weight") > F.col("rest") + F.col("second")).select("src", F.col("first.dst").alias("dst"))


def reduced(g: Graph, terminals: DataFrame) -> tuple[Graph, DataFrame, int]:
    """The graph after :func:`heavy_pairs` and :func:`terminal_pull` until nothing moves, ``mapping(id, block)``, and what the edges between terminals weighed.

    A block with a terminal has its id.
    """
    from cleave.operators.components import connected_components

    mapping = g.vertices.select("id", F.col("id").alias("block"))
    terminals = materialise(terminals.select("id"), "reduced-terminals")
    paid = 0
    while True:
        g, gone = delete_terminal_edges(g, terminals)
        paid += gone.first()[0]
        g = Graph(materialise(g.edges, "reduced-edges"), materialise(g.vertices, "reduced-vertices"))
        pairs = materialise(heavy_pairs(g, terminals).union(terminal_pull(g, terminals)), "reduced-pairs")
        if not pairs.limit(1).count():
            return g, mapping, paid
        merged = connected_components(pairs)
        owner = merged.join(terminals, "id").select("component", F.col("id").alias("terminal"))  # one at most: a vertex follows one neighbour, a terminal none
        named = merged.join(owner, "component", "left").select("id", F.coalesce("terminal", "component").alias("to"))
        step = g.vertices.join(named, "id", "left").select("id", F.coalesce("to", "id").alias("block"))
        g = contract(g, materialise(step, "reduced-step"))
        mapping = materialise(compose(mapping, step), "reduced-mapping")


def component_terminals(g: Graph, terminals: DataFrame) -> DataFrame:
    """``component, size, terminals``: what has to be solved is where ``terminals`` is 2 or more."""
    comp = all_components(g).join(terminals.select("id", F.lit(1).alias("t")), "id", "left")
    return comp.groupBy("component").agg(F.count("*").alias("size"), F.count("t").alias("terminals"))
