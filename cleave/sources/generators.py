"""Graphs and update streams from a seed: the same rows whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cleave.graph import Graph


def draw(n: int, *keys: Column | int) -> Column:
    """A number in 0 .. n-1 from a hash of the keys."""
    return F.pmod(F.xxhash64(*(k if isinstance(k, Column) else F.lit(k) for k in keys)), F.lit(n))


def torus(spark: SparkSession, side: int, size: int, cut: int, seed: int = 0) -> Graph:
    """``side`` x ``side`` blocks of ``size`` vertices on a torus: ``cut`` random edges to the right and lower block, and 4*cut+1 random edges a vertex inside."""
    v = spark.range(side * side * size)
    block = F.floor(F.col("id") / size)
    inside = v.select("id", F.explode(F.sequence(F.lit(1), F.lit(4 * cut + 1))).alias("k")).select(F.col("id").alias("src"), (block * size + draw(size, F.col("id"), F.col("k"), seed)).alias("dst"))
    b = spark.range(side * side)
    row, col = F.floor(F.col("id") / side), F.col("id") % side
    near = F.explode(F.array((row * side + (col + 1) % side), ((row + 1) % side * side + col)))
    pairs = b.select("id", near.alias("to")).select("id", "to", F.explode(F.sequence(F.lit(1), F.lit(cut))).alias("k"))
    between = pairs.select((F.col("id") * size + draw(size, F.col("id"), F.col("to"), F.col("k"), seed)).alias("src"), (F.col("to") * size + draw(size, F.col("to"), F.col("id"), F.col("k"), seed + 1)).alias("dst"))
    return Graph.of(inside.union(between).withColumn("weight", F.lit(1)), v)


def random_weights(g: Graph, low: int, high: int, seed: int = 0) -> Graph:
    return Graph(g.edges.withColumn("weight", (draw(high - low + 1, F.col("src"), F.col("dst"), seed) + low).cast("long")), g.vertices)


def random_edges(g: Graph, each: int, seed: int = 0) -> Graph:
    """The graph with ``each`` edges more a vertex, each to an edge's end drawn at random: a neighbour is hit by weight of one, so its edge weighs one more."""
    near = g.arcs().select("src", "dst", F.explode(F.sequence(F.lit(1), F.lit(each))).alias("k"))
    key = F.struct(F.xxhash64("src", "dst", "k", F.lit(seed)).alias("key"), "dst")
    chosen = near.groupBy("src", "k").agg(F.min(key).alias("x")).select("src", F.col("x.dst").alias("dst"), F.lit(1).cast("long").alias("weight"))
    return Graph.of(g.edges.unionByName(chosen), g.vertices)


def update_stream(g: Graph, inserted: float, removed: float, batch: int, seed: int = 0) -> tuple[Graph, DataFrame]:
    """The graph without a share of its edges, and updates that insert those and delete another share, in a random order in batches."""
    u = (draw(1 << 30, F.col("src"), F.col("dst"), seed) / F.lit(float(1 << 30))).alias("u")
    e = g.edges.withColumn("u", u)
    start = e.where(F.col("u") >= inserted)
    rows = e.where(F.col("u") < inserted).select("src", "dst", F.col("weight").alias("delta")).union(start.where(F.col("u") >= 1 - removed).select("src", "dst", -F.col("weight")))
    keyed = rows.withColumn("seq", F.xxhash64("src", "dst", "delta", F.lit(seed)))
    return Graph(start.select("src", "dst", "weight"), g.vertices), keyed.withColumn("ts", F.pmod("seq", F.lit(max(1, batch)))).select("seq", "src", "dst", "delta", "ts")
