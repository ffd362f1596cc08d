"""Graphs that the relational tables hold, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cleave.graph import Graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _trade(spark: SparkSession, sf_dir: str, customer: str, supplier: str) -> DataFrame:
    """Line items by a column of their customer's and their supplier's nation; summed before the wide joins."""
    read = lambda n: table(spark, sf_dir, n)
    nation = read("nation").select("n_nationkey", "n_regionkey")
    by = read("lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("weight"))
    by = by.join(read("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_suppkey").agg(F.sum("weight").alias("weight"))
    c = read("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col(customer).alias("src"))
    s = read("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col(supplier).alias("dst"))
    return by.join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def nation_trade(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations; weight: line items between customers of one and suppliers of the other."""
    return Graph.of(_trade(spark, sf_dir, "n_nationkey", "n_nationkey"), table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id")))


def region_trade(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph.of(_trade(spark, sf_dir, "n_regionkey", "n_regionkey"), table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id")))


def market(spark: SparkSession, sf_dir: str) -> Graph:
    """Segments (0 on), order priorities (100 on) and regions (200 on), each ranked by name or key; weights: orders, and customers."""
    read = lambda n: table(spark, sf_dir, n)
    c, o, n = read("customer"), read("orders"), read("nation")
    rank = lambda df, col, base: df.select(col).distinct().select(col, (F.dense_rank().over(W.orderBy(col)) - 1 + base).alias(f"{col}_id"))  # noqa: E731  a handful of names
    seg, pri = rank(c, "c_mktsegment", 0), rank(o, "o_orderpriority", 100)
    orders = o.join(c.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("weight"))
    first = orders.join(seg, "c_mktsegment").join(pri, "o_orderpriority").select(F.col("c_mktsegment_id").alias("src"), F.col("o_orderpriority_id").alias("dst"), "weight")
    homes = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("c_mktsegment", "n_regionkey").agg(F.count("*").alias("weight"))
    second = homes.join(seg, "c_mktsegment").select(F.col("c_mktsegment_id").alias("src"), (F.col("n_regionkey") + 200).alias("dst"), "weight")
    return Graph.of(first.union(second))


def customer_supplier(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers (odd ids) and suppliers (even ids) that share line items."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return Graph.of(rows.select((2 * F.col("o_custkey") + 1).alias("src"), (2 * F.col("l_suppkey")).alias("dst"), F.lit(1).alias("weight")))


def part_supplier(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts (odd ids) and suppliers (even ids) of line items."""
    return Graph.of(table(spark, sf_dir, "lineitem").select((2 * F.col("l_partkey") + 1).alias("src"), (2 * F.col("l_suppkey")).alias("dst"), F.lit(1).alias("weight")))


def supplier_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``group, member``: orders and the suppliers on them (an order has a handful of lines)."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group"), F.col("l_suppkey").alias("member"))


def customer_nation(spark: SparkSession, sf_dir: str) -> Graph:
    """A forest: customers (odd ids) hang on their nation (even ids)."""
    return Graph.of(table(spark, sf_dir, "customer").select((2 * F.col("c_custkey") + 1).alias("src"), (2 * F.col("c_nationkey")).alias("dst"), F.lit(1).alias("weight")))


def customer_region(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers hang on their nation, nations on their region, and the regions (in the order of keys) stand in a ring."""
    read = lambda n: table(spark, sf_dir, n)
    hang = customer_nation(spark, sf_dir).edges.select("src", "dst")
    up = read("nation").select((2 * F.col("n_nationkey")).cast("long").alias("src"), (-1 - F.col("n_regionkey")).cast("long").alias("dst"))
    key = F.col("r_regionkey").cast("long")
    ring = read("region").select((-1 - key).alias("src"), (-1 - F.coalesce(F.lead(key).over(W.orderBy(key)), F.first(key).over(W.orderBy(key)))).alias("dst"))  # a handful of regions
    return Graph.of(hang.union(up).union(ring).withColumn("weight", F.lit(1)))


def customer_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq, src, dst, delta, ts``: every customer is linked to its nation, in the order of keys."""
    key = F.col("c_custkey").cast("long")
    return table(spark, sf_dir, "customer").select(key.alias("seq"), (2 * key + 1).alias("src"), (2 * F.col("c_nationkey")).cast("long").alias("dst"), F.lit(1).cast("long").alias("delta"), key.alias("ts"))


def market_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq, src, dst, delta, ts``: every year inserts an edge between each segment and order priority that weighs its orders, and deletes the one of two years before."""
    read = lambda n: table(spark, sf_dir, n)
    c, o = read("customer"), read("orders")
    rank = lambda df, col, base: df.select(col).distinct().select(col, (F.dense_rank().over(W.orderBy(col)) - 1 + base).cast("long").alias(f"{col}_id"))  # noqa: E731  a handful of names
    rows = o.join(c.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", "o_orderpriority", F.year("o_orderdate").cast("long").alias("ts")).agg(F.count("*").alias("delta"))
    rows = rows.join(rank(c, "c_mktsegment", 0), "c_mktsegment").join(rank(o, "o_orderpriority", 100), "o_orderpriority").select(F.col("c_mktsegment_id").alias("src"), F.col("o_orderpriority_id").alias("dst"), "delta", "ts")
    last = rows.agg(F.max("ts")).first()[0]
    gone = rows.where(F.col("ts") + 2 <= F.lit(last)).select("src", "dst", F.lit(-1).cast("long").alias("delta"), (F.col("ts") + 2).alias("ts"))
    place = F.col("src") * 1000 + F.col("dst")
    return rows.select(place.alias("seq"), "src", "dst", "delta", "ts").union(gone.select((place + 1_000_000).alias("seq"), "src", "dst", "delta", "ts"))


def broken(spark: SparkSession, sf_dir: str) -> Graph:
    """No valid graph: nations beside their regions as they come, and every region but the largest twice."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id"))
    e = n.select(F.col("n_nationkey").cast("long").alias("src"), F.col("n_regionkey").cast("long").alias("dst"), (F.col("n_nationkey") % 3).cast("long").alias("weight"))
    return Graph(e.union(e.where("src > 20")), r.union(r.where("id < 4")))


def event_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq, src, dst, delta, ts``: links between event types and hours of the day; errors delete, all else inserts."""
    e = table(spark, sf_dir, "events")
    kind = F.dense_rank().over(W.orderBy("event_type")) - 1
    names = e.select("event_type").distinct().select("event_type", kind.cast("long").alias("src"))  # a handful of names
    rows = e.join(F.broadcast(names), "event_type")
    return rows.select(F.col("event_id").alias("seq"), "src", (F.hour("ts") + 100).cast("long").alias("dst"), F.when(F.col("event_type") == "error", -1).otherwise(1).cast("long").alias("delta"), F.date_trunc("day", "ts").alias("ts"))
