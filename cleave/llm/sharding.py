"""Sharding: balanced label propagation of linked documents under capacity quotas.

Method.  Documents with equal texts are linked.  Links of a group run through one hub (its text), so the state of the
propagation is one row per (hub, shard) with the number of the group's documents there: a group of any size is at most
``shards`` rows, and no document pair is ever made.  Each round joins the cells with their hub's label histogram; the
documents of every cell ask to move to the group's fullest shard that still has room; the requests between each pair of
shards are summed, cut down to quotas that leave no shard above its capacity, and granted in a fixed order.  Rounds end
when nothing moves.  Then unlinked documents fill what is left, so that row counts differ by at most one (law ``rows``).

Ranks are made of sums by hash bucket and row numbers inside buckets, so no task holds a shard or a group.  The driver gets
sums by (shard, shard, bucket) only, whose number does not depend on the input.

Edge cases.  A null text has no bytes: size 8, checksum 0, and it is linked with empty texts.  Repeated rows, and rows with
a null or repeated doc_id, are placed one by one.  Groups larger than a shard are split over as few shards as the quotas
allow.  Extra columns are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cleave.session import materialise

#: Hash buckets of the move requests of a pair of shards.
REQUEST_BUCKETS = 32


def quotas(asked: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Moves granted of ``asked[from, to]`` so that no shard takes in more than its room and what leaves it."""
    granted = asked.astype(np.int64).copy()
    while True:
        into, out = granted.sum(0), granted.sum(1)
        most = np.maximum(room + out, 0)
        over = into > most
        if not over.any():
            return granted
        for t in np.flatnonzero(over):
            before = np.cumsum(granted[:, t]) - granted[:, t]
            granted[:, t] = np.clip(most[t] - before, 0, granted[:, t])


def _running(df: DataFrame, by: list[str], order: list[str], value: str) -> F.Column:
    """The sum of ``value`` over the rows of the same ``by`` that come earlier in ``order``."""
    return F.coalesce(F.sum(value).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def initial_cells(groups: DataFrame, shards: int, buckets: int) -> DataFrame:
    """``hub, shard, n``: the linked documents dealt out in turn, group after group."""
    rows = groups.withColumn("b", F.pmod(F.xxhash64("hub"), F.lit(buckets)))
    sums = rows.groupBy("b").agg(F.sum("n").alias("t"))
    starts = sums.select("b", _running(sums.withColumn("one", F.lit(1)), [], ["b"], "t").alias("start"))
    at = rows.withColumn("before", _running(rows, ["b"], ["hub"], "n")).join(F.broadcast(starts), "b").select("hub", "n", (F.col("start") + F.col("before")).alias("o"))
    dealt = at.select("hub", "n", "o", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    until = lambda x: F.floor((x - F.col("shard") + F.lit(shards - 1)) / F.lit(shards))
    return dealt.select("hub", "shard", (until(F.col("o") + F.col("n")) - until(F.col("o"))).alias("n")).where("n > 0")


def propagate(cells: DataFrame, capacity: np.ndarray, rounds: int) -> DataFrame:
    """Move the documents of cells (``hub, shard, n``) towards the shards where most of their group is."""
    shards = len(capacity)
    spark = cells.sparkSession
    for step in range(rounds):
        size = np.zeros(shards, np.int64)
        for s, n in cells.groupBy("shard").agg(F.sum("n")).collect():
            size[s] = n
        room = capacity - size
        free = F.array(*(F.lit(int(max(x, 0))) for x in room))[F.col("shard")]
        group = W.partitionBy("hub")
        asking = (
            cells.withColumn("w", F.struct("n", F.xxhash64("hub", "shard").alias("tie"), "shard"))
            .withColumn("others", F.sum("n").over(group) - F.col("n"))
            .withColumn("fits", F.max(F.when(free >= F.col("others"), F.col("w"))).over(group))  # the whole group has room there
            .withColumn("best", F.max(F.when(free > 0, F.col("w"))).over(group))
        )
        to = F.when(F.col("fits").isNotNull(), F.col("fits.shard")).when(F.col("w") < F.col("best"), F.col("best.shard"))
        asking = asking.withColumn("to", F.when(to != F.col("shard"), to)).select("hub", "shard", "n", "to", F.pmod(F.xxhash64("hub"), F.lit(REQUEST_BUCKETS)).alias("b"))
        asking = materialise(asking, "shard-asking")
        sums = asking.where("to is not null").groupBy("shard", "to", "b").agg(F.sum("n").alias("n")).collect()
        asked = np.zeros((shards, shards, REQUEST_BUCKETS), np.int64)
        for s, t, b, n in sums:
            asked[s, t, b] = n
        granted = quotas(asked.sum(2), room)
        if not granted.sum():
            break
        before = asked.cumsum(2) - asked
        left = np.clip(granted[:, :, None] - before, 0, asked)
        quota = spark.createDataFrame([(int(s), int(t), int(b), int(left[s, t, b])) for s, t, b in zip(*np.nonzero(left), strict=True)], "shard int, to int, b long, quota long")
        moves = asking.join(F.broadcast(quota), ["shard", "to", "b"], "left").withColumn("quota", F.coalesce("quota", F.lit(0)))
        earlier = F.when(F.col("quota") > 0, _running(moves, ["shard", "to", "b"], ["hub"], "n")).otherwise(0)
        moves = moves.withColumn("m", F.greatest(F.lit(0), F.least("n", F.col("quota") - earlier)))
        both = F.array(F.struct(F.col("shard"), (F.col("n") - F.col("m")).alias("n")), F.struct(F.coalesce("to", "shard").alias("shard"), F.col("m").alias("n")))
        cells = materialise(moves.select("hub", F.explode(both).alias("x")).groupBy("hub", "x.shard").agg(F.sum("x.n").alias("n")).where("n > 0"), f"shard-cells-{step}")
    return cells


def shard_documents(docs: DataFrame, shards: int = 24, rounds: int = 16) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row, law ``rows``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("hub"))
    base = materialise(base, "shard-base")
    rows = base.count()
    buckets = int(min(4096, max(64, rows // 100_000)))
    base = base.withColumn("b", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))

    parts = materialise(base.groupBy("hub", "b").agg(F.count("*").alias("n")), "shard-parts")
    groups = parts.groupBy("hub").agg(F.sum("n").alias("n")).where("n > 1")
    capacity = np.full(shards, rows // shards, np.int64) + (np.arange(shards) < rows % shards)
    cells = propagate(materialise(initial_cells(groups, shards, buckets).select("hub", F.col("shard").cast("int"), "n"), "shard-cells"), capacity, rounds)

    size = np.zeros(shards, np.int64)
    for s, n in cells.groupBy("shard").agg(F.sum("n")).collect():
        size[s] = n
    ends = np.cumsum(capacity - size)

    hubs = cells.groupBy("hub").agg(F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("cells"))  # at most ``shards`` a hub
    known = parts.join(hubs, "hub", "left")
    linked = known.where("cells is not null")
    linked = linked.withColumn("start", _running(linked, ["hub"], ["b"], "n"))
    single = known.where("cells is null")
    sums = single.groupBy("b").agg(F.sum("n").alias("t"))
    starts = sums.select("b", _running(sums, [], ["b"], "t").alias("o"))
    single = single.join(F.broadcast(starts), "b").withColumn("start", F.col("o") + F.row_number().over(W.partitionBy("b").orderBy("hub")) - 1)
    places = linked.select("hub", "b", "start", "cells").unionByName(single.select("hub", "b", "start", "cells"))

    ranked = base.withColumn("r", F.row_number().over(W.partitionBy("hub", "b").orderBy("doc_id")) - 1)
    ranked = ranked.join(places, ["hub", "b"]).withColumn("rank", F.col("start") + F.col("r"))
    in_cells = F.expr("aggregate(cells, struct(rank as rest, -1 as shard), (a, c) -> struct(a.rest - c.n as rest, if(a.rest >= 0 and a.rest < c.n, c.shard, a.shard) as shard), a -> a.shard)")
    fill = F.array(*(F.lit(int(e)) for e in ends))
    filled = F.size(F.filter(fill, lambda e: e <= F.col("rank")))
    placed = ranked.select("doc_id", "size", "text_crc32", "b", F.when(F.col("cells").isNotNull(), in_cells).otherwise(filled).cast("int").alias("shard"))
    placed = materialise(placed.withColumn("b", F.pmod(F.xxhash64(F.lit("slot"), "doc_id"), F.lit(buckets))), "shard-placed")  # other buckets than those that chose the shard
    counts = placed.groupBy("shard", "b").agg(F.count("*").alias("n"))
    offsets = counts.select("shard", "b", _running(counts, ["shard"], ["b"], "n").alias("o"))  # shards x buckets rows
    slot = F.col("o") + F.row_number().over(W.partitionBy("shard", "b").orderBy("doc_id", "text_crc32")) - 1
    return placed.join(F.broadcast(offsets), ["shard", "b"]).select("doc_id", "size", "text_crc32", "shard", slot.cast("long").alias("slot"))


def op1_balanced_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
