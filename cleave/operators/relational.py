"""Accessors, aggregates and edits of a graph, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cleave.graph import Graph, canonical


def degrees(g: Graph) -> DataFrame:
    """``id, degree, weighted`` of every vertex; isolated ones have 0."""
    own = g.arcs().groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"), F.sum("weight").alias("weighted"))
    return g.vertices.join(own, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("weighted", F.lit(0)).alias("weighted"))


def extrema(g: Graph) -> DataFrame:
    """Smallest and largest weighted degree, largest degree, sum of all weighted degrees, vertices and edges."""
    d = degrees(g).agg(F.min("weighted").alias("min_weighted"), F.max("weighted").alias("max_weighted"), F.max("degree").alias("max_degree"), F.sum("weighted").alias("total_weighted"), F.count("*").alias("n"))
    return d.crossJoin(g.edges.agg(F.count("*").alias("m")))  # one row each


def degree_percentile(g: Graph, p: float) -> DataFrame:
    """The weighted degree at place floor(n * p) of the ascending order, from counts of equal degrees."""
    d = degrees(g)
    n = d.count()
    place = min(int(n * p), max(n - 1, 0))
    counts = d.groupBy("weighted").agg(F.count("*").alias("c"))
    upto = counts.withColumn("upto", F.sum("c").over(W.orderBy("weighted")))
    return upto.where(F.col("upto") > place).agg(F.min("weighted").alias("percentile_degree"))


def top_degrees(g: Graph, k: int, weighted: bool = True) -> DataFrame:
    """The k vertices of the largest degree; ties go to smaller ids."""
    key = "weighted" if weighted else "degree"
    return degrees(g).orderBy(F.desc(key), "id").limit(k)


def reverse_arcs(g: Graph) -> DataFrame:
    """Each arc beside the arc back."""
    back = g.arcs().select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("weight").alias("back_weight"))
    return g.arcs().join(back, ["src", "dst"])


def incident(g: Graph, ids: DataFrame) -> DataFrame:
    """Arcs that leave the vertices ``ids(id)``."""
    return g.arcs().join(ids.select(F.col("id").alias("src")).distinct(), "src", "left_semi")


def set_weights(g: Graph, changes: DataFrame) -> Graph:
    """New weights for the edges in ``changes(src, dst, weight)``."""
    new = changes.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.col("weight").alias("_new"))
    return Graph(g.edges.join(new, ["src", "dst"], "left").select("src", "dst", F.coalesce("_new", "weight").alias("weight")).where("weight > 0"), g.vertices)


def delete_edges(g: Graph, gone: DataFrame) -> Graph:
    keys = gone.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return Graph(g.edges.join(keys, ["src", "dst"], "left_anti"), g.vertices)


def delete_vertices(g: Graph, gone: DataFrame) -> Graph:
    return induced(g, g.vertices.join(gone.select("id"), "id", "left_anti"))


def induced(g: Graph, keep: DataFrame) -> Graph:
    """The subgraph on ``keep(id)``."""
    keep = keep.select("id").distinct()
    e = g.edges.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return Graph(e.select("src", "dst", "weight"), g.vertices.join(keep, "id", "left_semi"))


def without_heavy(g: Graph, p: float) -> Graph:
    """Vertices below the weighted-degree percentile, their edges with unit weight."""
    limit = degree_percentile(g, p).first()[0]
    keep = degrees(g).where(F.col("weighted") < F.lit(limit if limit is not None else 0)).select("id")
    sub = induced(g, keep)
    return Graph(sub.edges.withColumn("weight", F.lit(1).cast("long")), sub.vertices)


def with_blocks(g: Graph, blocks: DataFrame) -> DataFrame:
    """Edges with the blocks of their ends; ``blocks(id, block)``."""
    a = blocks.select(F.col("id").alias("src"), F.col("block").alias("b1"))
    b = blocks.select(F.col("id").alias("dst"), F.col("block").alias("b2"))
    return g.edges.join(a, "src").join(b, "dst")


def edge_cut(g: Graph, blocks: DataFrame) -> DataFrame:
    """Weight and number of the edges between different blocks."""
    return with_blocks(g, blocks).where("b1 <> b2").agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("cut_weight"), F.count("*").alias("cut_edges"))


def cut_edges(g: Graph, blocks: DataFrame) -> DataFrame:
    return with_blocks(g, blocks).where("b1 <> b2").select("src", "dst", "weight")


def block_matrix(g: Graph, blocks: DataFrame) -> DataFrame:
    """``b1 < b2, weight`` between every two blocks that touch."""
    e = with_blocks(g, blocks).where("b1 <> b2")
    return e.groupBy(F.least("b1", "b2").alias("block_a"), F.greatest("b1", "b2").alias("block_b")).agg(F.sum("weight").alias("weight"))


def size_histogram(sizes: DataFrame) -> DataFrame:
    """Counts of ``sizes(size)`` that reach 1, 10, 100, 1000 and 10000, and of empty ones."""
    at = lambda k: F.count(F.when(F.col("size") >= k, 1)).alias(f"at_least_{k}")
    return sizes.agg(F.count(F.when(F.col("size") == 0, 1)).alias("empty"), *map(at, (1, 10, 100, 1000, 10000)))


def contract(g: Graph, mapping: DataFrame) -> Graph:
    """Merge vertices by ``mapping(id, block)``: ends relabelled, loops dropped, parallel weights summed."""
    e = with_blocks(g, mapping).select(F.col("b1").alias("src"), F.col("b2").alias("dst"), "weight")
    return Graph(canonical(e), mapping.select(F.col("block").alias("id")).distinct())


def contract_set(g: Graph, ids: DataFrame) -> Graph:
    """Merge the vertices ``ids(id)`` into one, which has the smallest of them as its id."""
    low = ids.agg(F.min("id").alias("low"))  # one row
    inside = g.vertices.join(ids.select("id").distinct().withColumn("in", F.lit(1)), "id", "left").crossJoin(F.broadcast(low))
    return contract(g, inside.select("id", F.when(F.col("in") == 1, F.col("low")).otherwise(F.col("id")).alias("block")))


def checked_solution(g: Graph, blocks: DataFrame, terminals: DataFrame) -> DataFrame:
    """``block, size, terminals, cut_weight, sound`` of a multiterminal solution: a sound block has members and exactly one terminal; a block for every terminal's place is listed, empty ones too."""
    cut = with_blocks(g, blocks).where("b1 <> b2")
    each = cut.select(F.explode(F.array("b1", "b2")).alias("block"), "weight").groupBy("block").agg(F.sum("weight").alias("cut_weight"))
    own = blocks.join(terminals.select("id", F.lit(1).alias("t")), "id", "left").groupBy("block").agg(F.count("*").alias("size"), F.count("t").alias("terminals"))
    every = own.select("block").union(terminals.select(F.col("block"))).distinct() if "block" in terminals.columns else own.select("block")
    out = every.join(own, "block", "left").join(each, "block", "left")
    size, held = F.coalesce("size", F.lit(0)), F.coalesce("terminals", F.lit(0))
    return out.select("block", size.alias("size"), held.alias("terminals"), F.coalesce("cut_weight", F.lit(0)).alias("cut_weight"), ((size > 0) & (held == 1)).alias("sound"))


def dense_ids(mapping: DataFrame) -> DataFrame:
    """Blocks numbered 0, 1, ... by their smallest member; ranks come from range-sorted partitions and their offsets."""
    from cleave.session import materialise

    low = mapping.groupBy("block").agg(F.min("id").alias("low"))
    parts = materialise(low.repartitionByRange("low").withColumn("_p", F.spark_partition_id()), "dense-parts")  # written: ranges are drawn from a sample, anew each time
    counts = parts.groupBy("_p").agg(F.count("*").alias("c"))
    start = counts.select("_p", F.coalesce(F.sum("c").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    rank = parts.withColumn("r", F.row_number().over(W.partitionBy("_p").orderBy("low")) - 1).join(F.broadcast(start), "_p")
    return mapping.join(rank.select("block", (F.col("start") + F.col("r")).cast("long").alias("dense")), "block").select("id", F.col("dense").alias("block"))


def compose(first: DataFrame, then: DataFrame) -> DataFrame:
    """The mapping that applies ``first(id, block)`` and then ``then(id, block)``."""
    return first.join(then.select(F.col("id").alias("block"), F.col("block").alias("_next")), "block").select("id", F.col("_next").alias("block"))


def flow_arcs(g: Graph) -> DataFrame:
    """Each arc with its capacity, and its residual twin with none."""
    a = g.arcs()
    return a.select("src", "dst", F.col("weight").alias("capacity"), F.lit(False).alias("residual")).union(a.select("dst", "src", F.lit(0).cast("long"), F.lit(True)))


def delete_terminal_edges(g: Graph, terminals: DataFrame) -> tuple[Graph, DataFrame]:
    """The graph without edges between two terminals ``(id)``, and their weight ``deleted_weight``."""
    t = terminals.select("id").distinct()
    inside = g.edges.join(t.withColumnRenamed("id", "src"), "src", "left_semi").join(t.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return delete_edges(g, inside), inside.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("deleted_weight"))
