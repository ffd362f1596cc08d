"""Safe contractions and coarsening, as joins over the edges.

Tests return pairs ``(src, dst)`` that may be merged.  ``heavy_edges``, ``heavy_vertices`` (strict) and ``common_neighbours`` may be
applied all at once for the value of a minimum cut below ``bound``; ``half_vertices`` and ``triangle_pairs`` only on a matching.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cleave.functions import triangles as N
from cleave.graph import Graph
from cleave.operators.relational import degrees
from cleave.session import bounded_batches, materialise


def heavy_edges(g: Graph, bound: int) -> DataFrame:
    return g.edges.where(F.col("weight") >= bound).select("src", "dst")


def _with_degrees(g: Graph) -> DataFrame:
    d = degrees(g)
    a = d.select(F.col("id").alias("src"), F.col("weighted").alias("d_src"))
    b = d.select(F.col("id").alias("dst"), F.col("weighted").alias("d_dst"))
    return g.edges.join(a, "src").join(b, "dst")


def heavy_vertices(g: Graph, least_degree: int | None = None) -> DataFrame:
    """Edges with more than half the weighted degree of an end; for all minimum cuts both degrees exceed ``least_degree``."""
    e = _with_degrees(g).where((2 * F.col("weight") > F.col("d_src")) | (2 * F.col("weight") > F.col("d_dst")))
    if least_degree is not None:
        e = e.where((F.col("d_src") > least_degree) & (F.col("d_dst") > least_degree))
    return e.select("src", "dst")


def half_vertices(g: Graph) -> DataFrame:
    """Edges with half the weighted degree of an end or more."""
    return _with_degrees(g).where((2 * F.col("weight") >= F.col("d_src")) | (2 * F.col("weight") >= F.col("d_dst"))).select("src", "dst")


def oriented(g: Graph) -> DataFrame:
    """Edges from the end of smaller (degree, id) to the other: no vertex has more than sqrt(2m) of them."""
    d = degrees(g).select("id", "degree")
    e = g.edges.join(d.select(F.col("id").alias("src"), F.col("degree").alias("k_src")), "src").join(d.select(F.col("id").alias("dst"), F.col("degree").alias("k_dst")), "dst")
    up = (F.col("k_src") < F.col("k_dst")) | ((F.col("k_src") == F.col("k_dst")) & (F.col("src") < F.col("dst")))
    return e.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("lo"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("hi"), "weight")


def all_triangles(g: Graph) -> DataFrame:
    """``a < b < c`` and the weights of their edges, each triangle once."""
    o = oriented(g)
    first = o.select("lo", F.col("hi").alias("x"), F.col("weight").alias("w_x"))
    second = o.select("lo", F.col("hi").alias("y"), F.col("weight").alias("w_y"))
    pairs = first.join(second, "lo").where("x < y")
    t = pairs.join(g.edges.select(F.col("src").alias("x"), F.col("dst").alias("y"), F.col("weight").alias("w_xy")), ["x", "y"])
    corner = F.sort_array(F.array("lo", "x", "y"))
    w = lambda i, j: F.when((corner[i] == F.col("x")) & (corner[j] == F.col("y")), F.col("w_xy")).when(F.array_contains(F.array(corner[i], corner[j]), F.col("x")), F.col("w_x")).otherwise(F.col("w_y"))
    return t.select(corner[0].alias("a"), corner[1].alias("b"), corner[2].alias("c"), w(0, 1).alias("w_ab"), w(0, 2).alias("w_ac"), w(1, 2).alias("w_bc"))


def triangle_totals(g: Graph, most: int = 8_000_000) -> DataFrame:
    """``triangles, weight``: how many triangles there are and what their edges weigh together, no two neighbours of a vertex ever written as a pair."""
    e = materialise(g.edges.select("src", "dst", "weight"), "triangles")
    k = max(1, ceil(sqrt(6 * e.count() / most)))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _joined(batches):
            u, v, w = (pdf[c].to_numpy() for c in ("src", "dst", "weight"))
            yield pd.DataFrame(N.deal(u, v, w, N.block(u, k), N.block(v, k), k), columns=["two", "u", "v", "w"])

    return _block_totals(e.mapInPandas(deal, "two int, u binary, v binary, w binary"), k)


def shared_triangle_totals(rows: DataFrame, most: int = 8_000_000) -> DataFrame:
    """:func:`triangle_totals` of the graph whose vertices are the ``member`` s of ``rows(group, member)``; an edge weighs how many groups hold both its ends.

    Groups come whole into one task each (a large one's members, not its pairs), are kept as arrays in the shared folder, and their pairs are made and summed there
    in arrays, a few million at a time.
    """
    rows = rows.select(F.col("group").cast("long").alias("group"), F.col("member").cast("long").alias("member")).where("group is not null and member is not null")

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group = member = np.zeros(0, np.int64)
        for pdf in _joined(batches):
            group, member = N.sorted_groups(np.concatenate([group, pdf["group"].to_numpy()]), np.concatenate([member, pdf["member"].to_numpy()]))
        size = N.sizes(group)
        if len(size):
            yield pd.DataFrame({"member": [member.tobytes()], "size": [size.tobytes()], "pairs": [int((size * (size - 1) // 2).sum())]})

    parts = max(ceil(rows.count() / 500_000), 1)
    groups = materialise(rows.repartition(parts, "group").mapInPandas(gather, "member binary, size binary, pairs long"), "triangles-groups")
    k = max(1, ceil(sqrt(6 * (groups.agg(F.sum("pairs")).first()[0] or 0) / most)))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for member, size in zip(pdf["member"], pdf["size"], strict=True):
                m = N.ints(member)
                a = N.block(m, k)
                for i, j in N.pairs(m, N.ints(size)):
                    yield pd.DataFrame(N.deal(m[i], m[j], None, a[i], a[j], k), columns=["two", "u", "v", "w"])

    return _block_totals(groups.select("member", "size").mapInPandas(deal, "two int, u binary, v binary, w binary"), k)


def _joined(batches: Iterator[pd.DataFrame], most: int = 1_000_000) -> Iterator[pd.DataFrame]:
    """Batches put together, to ``most`` rows or a batch more."""
    held, n = [], 0
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        if n >= most:
            yield pd.concat(held)
            held, n = [], 0
    if n:
        yield pd.concat(held)


def _block_totals(dealt: DataFrame, k: int) -> DataFrame:
    """``triangles, weight`` of edges that are ``dealt(two, u, v, w)`` as arrays by the pair of their ends' ``k`` blocks; without ``w`` edges weigh one, parallel ones are summed.

    Vertices are dealt into blocks by hash.  A task sums the edges between two blocks; a task has the edges between three (some ``most``, more around a vertex of
    huge degree) and counts the triangles with a corner in each.  Edges are sent as many times as there are blocks, packed, a row for all of two blocks.
    """
    bounded_batches(dealt.sparkSession)

    def tie(pdf: pd.DataFrame) -> pd.DataFrame:
        u, v = (N.ints(b"".join(pdf[c])) for c in "uv")
        w = np.concatenate([N.ints(w) if len(w) else np.ones(len(u) // 8, np.int64) for u, w in zip(pdf["u"], pdf["w"], strict=True)])
        return pd.DataFrame([(*divmod(int(pdf["two"].iloc[0]), k), *N.tie(u, v, w))], columns=names)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        three = int(key[0])
        found = N.totals((three // k // k, three // k % k, three % k), {(r[0], r[1]): r[2:] for r in pdf[names].itertuples(index=False, name=None)})
        return pd.DataFrame([found] if found[0] else [], columns=["triangles", "weight"])

    names = ["a", "b", "us", "vs", "n", "at", "wide", "w", "heavy"]
    tied = dealt.groupBy("two").applyInPandas(tie, "a int, b int, us binary, vs binary, n binary, at binary, wide int, w binary, heavy int")
    sent = tied.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    three = F.sort_array(F.array("a", "b", "c"))
    each = sent.select(*names, ((three[0] * k + three[1]) * k + three[2]).alias("three")).groupBy("three").applyInPandas(run, "triangles long, weight long")
    return each.agg(F.coalesce(F.sum("triangles"), F.lit(0)).alias("triangles"), F.sum("weight").alias("weight"))


def common_neighbours(g: Graph, bound: int) -> DataFrame:
    """Edges whose weight and common neighbours' smaller weights reach ``bound`` together."""
    t = all_triangles(g)
    side = lambda a, b, x, y: t.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.least(x, y).alias("over"))
    over = side("a", "b", "w_ac", "w_bc").union(side("a", "c", "w_ab", "w_bc")).union(side("b", "c", "w_ab", "w_ac")).groupBy("src", "dst").agg(F.sum("over").alias("over"))
    e = g.edges.join(over, ["src", "dst"], "left")
    return e.where(F.col("weight") + F.coalesce("over", F.lit(0)) >= bound).select("src", "dst")


def triangle_pairs(g: Graph, least_degree: int | None = None) -> DataFrame:
    """Edges of a triangle whose two edges at each end hold half of its degree (strictly, and above ``least_degree``, for all cuts)."""
    d = degrees(g).select("id", F.col("weighted").alias("d"))
    t = all_triangles(g)
    for v in "abc":
        t = t.join(d.select(F.col("id").alias(v), F.col("d").alias(f"d_{v}")), v)

    def pair(u: str, v: str, w: str, own: str, wu: str, wv: str) -> DataFrame:
        left, right = 2 * (F.col(own) + F.col(wu)), 2 * (F.col(own) + F.col(wv))
        if least_degree is None:
            ok = (left >= F.col(f"d_{u}")) & (right >= F.col(f"d_{v}"))
        else:
            ok = (left > F.col(f"d_{u}")) & (right > F.col(f"d_{v}")) & (F.col(f"d_{u}") > least_degree) & (F.col(f"d_{v}") > least_degree)
        return t.where(ok).select(F.col(u).alias("src"), F.col(v).alias("dst"))

    return pair("a", "b", "c", "w_ab", "w_ac", "w_bc").union(pair("a", "c", "b", "w_ac", "w_ab", "w_bc")).union(pair("b", "c", "a", "w_bc", "w_ab", "w_ac")).distinct()


def heavy_triangles(g: Graph, bound: int) -> DataFrame:
    """Triangles of which every two edges outweigh ``bound``: smallest and middle weight together do."""
    w = F.sort_array(F.array("w_ab", "w_ac", "w_bc"))
    return all_triangles(g).where(w[0] + w[1] > bound).select("a", "b", "c")


def matching(pairs: DataFrame, seed: int = 0) -> DataFrame:
    """Pairs that are the first choice of both their ends, by a hash of the pair and ``seed``: no vertex twice."""
    key = F.struct(F.xxhash64("src", "dst", F.lit(seed)), "src", "dst")
    p = pairs.select("src", "dst", key.alias("k"))
    ends = p.select(F.col("src").alias("id"), "k").union(p.select(F.col("dst").alias("id"), "k"))
    first = ends.groupBy("id").agg(F.min("k").alias("first"))
    out = p.join(first.select(F.col("id").alias("src"), F.col("first").alias("f1")), "src").join(first.select(F.col("id").alias("dst"), F.col("first").alias("f2")), "dst")
    return out.where("k = f1 and k = f2").select("src", "dst")


def degree_one(g: Graph, weight: int | None = None) -> DataFrame:
    """Vertices of degree one (with an edge of ``weight``), and what they hang on."""
    leaf = degrees(g).where("degree = 1").select(F.col("id").alias("src"))
    arcs = g.arcs().join(leaf, "src", "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("anchor"), "weight")
    return arcs if weight is None else arcs.where(F.col("weight") == weight)


def equal_neighbourhoods(g: Graph, most_degree: int = 50) -> DataFrame:
    """``a < b``: vertices with equal weighted neighbourhoods, apart from each other; degrees up to ``most_degree``.

    Twins that aren't adjacent match on the hash of their neighbours, adjacent ones on that with themselves added; each class is linked to
    its smallest member, so a class of any size makes one row a member.
    """
    few = degrees(g).where(F.col("degree").between(1, most_degree)).select(F.col("id").alias("src"))
    arcs = g.arcs().join(few, "src", "left_semi")
    around = arcs.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list(F.struct("dst", "weight"))).alias("near"))  # at most most_degree
    apart = around.groupBy("near").agg(F.min("id").alias("a"), F.collect_list("id").alias("ids")).where(F.size("ids") > 1).select("a", F.explode("ids").alias("b")).where("a <> b")
    other = lambda x, v: F.filter(x, lambda s: s["dst"] != v)
    e = g.edges.join(around.select(F.col("id").alias("src"), F.col("near").alias("n1")), "src").join(around.select(F.col("id").alias("dst"), F.col("near").alias("n2")), "dst")
    joined = e.where(other(F.col("n1"), F.col("dst")) == other(F.col("n2"), F.col("src"))).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return apart.union(joined).distinct()


def label_round(g: Graph, labels: DataFrame) -> DataFrame:
    """``id, label``: the label with the most weight around each vertex; ties go to the smaller label, lonely ones keep theirs."""
    votes = g.arcs().join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id"), "label").agg(F.sum("weight").alias("w"))
    best = votes.groupBy("id").agg(F.max(F.struct("w", (-F.col("label")).alias("label"))).alias("x"))
    return labels.join(best, "id", "left").select("id", F.coalesce(-F.col("x.label"), F.col("label")).alias("label"))


def label_propagation(g: Graph, rounds: int = 2) -> DataFrame:
    labels = g.vertices.select("id", F.col("id").alias("label"))
    for _ in range(rounds):
        labels = label_round(g, labels)
    return labels


def sampled_edges(g: Graph, n: int, seed: int, weighted: bool = True) -> DataFrame:
    """The first ``n`` edges in a random order that favours weight: exponential keys from a hash of the edge and the seed."""
    u = (F.pmod(F.xxhash64("src", "dst", F.lit(seed)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    return g.edges.withColumn("key", -F.log(u) / (F.col("weight") if weighted else F.lit(1.0))).orderBy("key", "src", "dst").limit(n).select("src", "dst", "weight")


def cluster_cut_gain(g: Graph, blocks: DataFrame) -> DataFrame:
    """``id, block, inside, outside``: how moving a vertex out of its block changes the block's degree (inside - outside)."""
    a = g.arcs().join(blocks.select(F.col("id").alias("src"), F.col("block").alias("b1")), "src").join(blocks.select(F.col("id").alias("dst"), F.col("block").alias("b2")), "dst")
    return a.groupBy(F.col("src").alias("id"), F.col("b1").alias("block")).agg(F.coalesce(F.sum(F.when(F.col("b1") == F.col("b2"), F.col("weight"))), F.lit(0)).alias("inside"), F.coalesce(F.sum(F.when(F.col("b1") != F.col("b2"), F.col("weight"))), F.lit(0)).alias("outside"))


def second_choice(g: Graph) -> DataFrame:
    """``id, first, second``: the heaviest neighbour and the next weight, ties to smaller ids."""
    w = W.partitionBy("src").orderBy(F.desc("weight"), "dst")
    a = g.arcs().withColumn("r", F.row_number().over(w)).where("r <= 2")
    return a.groupBy(F.col("src").alias("id")).agg(F.max(F.when(F.col("r") == 1, F.col("dst"))).alias("first"), F.max(F.when(F.col("r") == 2, F.col("weight"))).alias("second"))
