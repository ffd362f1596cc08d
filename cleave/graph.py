"""The graph model: canonical undirected edges (src < dst, one row a pair, positive integer weights) and vertices."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def canonical(edges: DataFrame) -> DataFrame:
    """``src < dst``, loops dropped, parallel edges merged by their sum, zero weights dropped."""
    weight = F.col("weight") if "weight" in edges.columns else F.lit(1)
    rows = edges.where("src <> dst").select(F.least("src", "dst").cast("long").alias("src"), F.greatest("src", "dst").cast("long").alias("dst"), weight.cast("long").alias("weight"))
    return rows.groupBy("src", "dst").agg(F.sum("weight").alias("weight")).where("weight > 0")


@dataclass(frozen=True)
class Graph:
    """``edges(src, dst, weight)`` in canonical form and ``vertices(id)`` (isolated ones too)."""

    edges: DataFrame
    vertices: DataFrame

    @classmethod
    def of(cls, edges: DataFrame, vertices: DataFrame | None = None) -> Graph:
        rows = canonical(edges)
        if vertices is None:
            vertices = rows.select(F.col("src").alias("id")).union(rows.select(F.col("dst").alias("id"))).distinct()
        return cls(rows, vertices.select(F.col("id").cast("long").alias("id")))

    def arcs(self) -> DataFrame:
        """Both directions of every edge."""
        both = F.explode(F.array(F.struct("src", "dst", "weight"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")))
        return self.edges.select(both.alias("a")).select("a.src", "a.dst", "a.weight")

    def violations(self) -> DataFrame:
        """``rule, n``: how many rows break each rule of the model; all 0 for a valid graph."""
        e = self.edges
        known = self.vertices.select(F.col("id").alias("dst"))
        rules = {
            "loop": e.where("src = dst"),
            "order": e.where("src > dst"),
            "weight": e.where("weight is null or weight <= 0"),
            "parallel": e.groupBy("src", "dst").count().where("count > 1"),
            "unknown_source": e.join(known.withColumnRenamed("dst", "src"), "src", "left_anti"),
            "unknown_target": e.join(known, "dst", "left_anti"),
            "repeated_vertex": self.vertices.groupBy("id").count().where("count > 1"),
        }
        out = None
        for name, rows in rules.items():
            one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("rule"), "n")
            out = one if out is None else out.union(one)
        return out
