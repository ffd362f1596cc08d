"""Equivalence closure and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleave.session import drop, materialise, scratch_path


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``id, component``: the smallest vertex reachable, for every endpoint of ``edges``.

    Each round takes the smallest label among the neighbours (one join, one aggregation that combines before the shuffle)
    and then the label of that label, so long paths halve.  Every round is written to the shared folder, in place of the one before; rounds
    end when a count of changed labels is zero.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    both = materialise(pairs.union(pairs.select("v", "u")).where("u <> v").distinct(), "cc-arcs")
    loops = pairs.where("u = v").select(F.col("u").alias("id"), F.col("u").alias("component"))
    labels = materialise(both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m")).select("id", F.least("id", "m").alias("component")).union(loops).groupBy("id").agg(F.min("component").alias("component")), "cc-labels")
    while True:
        seen = both.join(labels.select(F.col("id").alias("v"), "component"), "v").groupBy(F.col("u").alias("id")).agg(F.min("component").alias("near"))
        hooked = labels.join(seen, "id", "left").select("id", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component"))
        # a label's own label: the component that its root now has
        roots = hooked.select(F.col("id").alias("component"), F.col("component").alias("root"))
        new = materialise(hooked.join(roots, "component", "left").select("id", "old", F.least("component", F.coalesce("root", "component")).alias("component")), "cc-labels")
        changed = new.where("old <> component").limit(1).count()
        drop(labels)
        labels = new.select("id", "component")
        if not changed:
            drop(both)
            return labels


def all_components(g) -> DataFrame:  # noqa: ANN001
    """``id, component`` of every vertex; isolated ones are their own."""
    found = connected_components(g.edges)
    return g.vertices.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def component_sizes(g) -> DataFrame:  # noqa: ANN001
    return all_components(g).groupBy("component").agg(F.count("*").alias("size"))


def largest_component(g) -> DataFrame:  # noqa: ANN001
    """``id`` of the vertices of the largest component; ties go to the smaller label."""
    found = materialise(all_components(g), "components")
    best = found.groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component").limit(1).select("component")
    return found.join(F.broadcast(best), "component").select("id")


def bfs(g, sources: DataFrame, max_depth: int | None = None) -> DataFrame:  # noqa: ANN001
    """``id, distance, parent`` of what ``sources(id)`` reach; the parent is the smallest one a step closer."""
    arcs = materialise(g.arcs().select("src", "dst"), "bfs-arcs")
    seen = materialise(sources.select("id", F.lit(0).alias("distance"), F.lit(None).cast("long").alias("parent")).distinct(), "bfs")
    front, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = arcs.join(front.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        front = materialise(step.join(seen.select("id"), "id", "left_anti").select("id", F.lit(depth).alias("distance"), "parent"), "bfs")
        if not front.limit(1).count():
            break
        seen = materialise(seen.union(front), "bfs-seen") if depth % 8 == 0 else seen.union(front)
    return seen


def core_numbers(g) -> DataFrame:  # noqa: ANN001
    """``id, core``: each vertex takes the h-index of its neighbours' values, starting from degrees, until nothing changes."""
    from cleave.operators.relational import degrees

    arcs = materialise(g.arcs().select("src", "dst"), "core-arcs")
    core = materialise(degrees(g).select("id", F.col("degree").alias("core")), "core")
    while True:
        near = arcs.join(core.select(F.col("id").alias("dst"), F.col("core").alias("c")), "dst").groupBy(F.col("src").alias("id"), "c").agg(F.count("*").alias("k"))
        from pyspark.sql import Window as W

        upto = near.withColumn("h", F.least(F.col("c"), F.sum("k").over(W.partitionBy("id").orderBy(F.desc("c")))))
        h = upto.groupBy("id").agg(F.max("h").alias("h"))
        new = materialise(core.join(h, "id", "left").select("id", F.col("core").alias("old"), F.least("core", F.coalesce("h", F.lit(0))).alias("core")), "core")
        changed = new.where("old <> core").limit(1).count()
        drop(core)
        core = new.select("id", "core")
        if not changed:
            drop(arcs)
            return core


def tree_blocks(g, roots: DataFrame) -> DataFrame:  # noqa: ANN001
    """``id, parent, block, bridge`` of every vertex but the ``roots(id)``, one a component: its edge to the parent in a breadth-first tree, the biconnected block of that edge, and whether it is a bridge.

    An edge outside the tree joins two vertices of one level or of neighbouring ones, and puts all tree edges on the way to where their
    ancestors meet into one block.  So pairs of vertices of one level climb together, from the deepest level up: a pair's edges are of one block, and
    the pair of the parents follows unless they are the same.  Rounds are as many as levels that have pairs; every pair is met once.
    """
    spark = g.edges.sparkSession
    tree = materialise(bfs(g, roots), "blocks-tree")
    up = lambda v, p, d: tree.select(F.col("id").alias(v), F.col("parent").alias(p), F.col("distance").alias(d))
    e = g.edges.select("src", "dst").join(up("src", "p", "d"), "src").join(up("dst", "q", "k"), "dst").where("not p <=> dst and not q <=> src")
    low = F.col("d") > F.col("k")  # the end that is a level deeper comes first
    x, px, y = (F.when(low, F.col(a)).otherwise(F.col(b)) for a, b in (("src", "dst"), ("p", "q"), ("dst", "src")))
    off = materialise(e.select(x.alias("x"), px.alias("px"), y.alias("y"), F.least("d", "k").alias("level"), (F.col("d") != F.col("k")).alias("uneven")), "blocks-off")
    links = scratch_path(spark, "blocks-links")
    off.where("uneven").select(F.col("x").alias("a"), F.col("px").alias("b")).distinct().write.parquet(links)
    first = off.select(F.when(F.col("uneven"), F.col("px")).otherwise(F.col("x")).alias("x"), "y", "level").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "level").distinct()
    first = materialise(first, "blocks-pairs")
    drop(off)
    todo = sorted(r[0] for r in first.select("level").distinct().collect())
    pairs = None
    level = todo[-1] if todo else 0
    while todo or pairs is not None:
        mine = first.where(F.col("level") == level).select("x", "y")
        both = mine if pairs is None else mine.union(pairs).distinct() if todo and todo[-1] == level else pairs
        if todo and todo[-1] == level:
            todo.pop()
        lifted = both.join(up("x", "px", "d").drop("d"), "x").join(up("y", "py", "d").drop("d"), "y")
        lifted = materialise(lifted, "blocks-lifted")
        apart = lifted.where("px <> py")
        ways = F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b")), F.struct(F.col("x").alias("a"), F.col("px").alias("b")), F.struct(F.col("y").alias("a"), F.col("py").alias("b")))
        lifted.select(F.explode(F.when(F.col("px") == F.col("py"), F.slice(ways, 1, 1)).otherwise(ways)).alias("w")).select("w.a", "w.b").distinct().write.mode("append").parquet(links)
        over = None
        if apart.limit(1).count():
            over = materialise(apart.select(F.least("px", "py").alias("x"), F.greatest("px", "py").alias("y")).distinct(), "blocks-pairs")
        drop(lifted)
        if pairs is not None:
            drop(pairs)
        pairs = over
        level = level - 1 if pairs is not None else todo[-1] if todo else 0
    linked = spark.read.schema("a long, b long").parquet(links)
    covered = connected_components(linked, "a", "b")
    found = tree.where("parent is not null").join(covered, "id", "left")
    return found.select("id", "parent", F.coalesce("component", "id").alias("block"), F.col("component").isNull().alias("bridge"))
