"""Graph text formats, read and written by Spark: METIS, DIMACS, temporal edge lists, vectors, cuts, GraphML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cleave.graph import Graph


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line, value`` of a text: 0-based line numbers from Spark's partition order and per-partition counts."""
    rows = spark.read.text(path).rdd.zipWithIndex().map(lambda x: (x[1], x[0][0]))
    return spark.createDataFrame(rows, "line long, value string")


def read_metis(spark: SparkSession, path: str) -> Graph:
    """Header ``n m [fmt]``, then a line of neighbours (1-based) for each vertex; fmt 1 or 11: neighbour and weight; 10 or 11: a vertex weight first, which isn't used.

    Comment lines are skipped, loops too.  A wrong number of vertex lines is an error; ids become 0-based.
    """
    rows = numbered_lines(spark, path).where(~F.col("value").rlike("^[ \t]*%")).orderBy("line")
    first = rows.limit(1).collect()
    if not first:
        return Graph.of(spark.createDataFrame([], "src long, dst long, weight long"))
    head = first[0]["value"].split()
    n, fmt = int(head[0]), head[2] if len(head) > 2 else "0"
    weighted, skip = fmt in ("1", "11"), 1 if fmt in ("10", "11") else 0
    body = rows.where(F.col("line") > first[0]["line"])
    body = body.withColumn("id", F.row_number().over(W.orderBy("line")).cast("long") - 1).where((F.col("id") < n) | (F.trim("value") != ""))
    if body.count() != n:
        raise ValueError(f"{path} has {body.count()} vertex lines; its header says {n}")
    tokens = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")
    nums = body.select("id", F.transform(tokens, lambda x: x.cast("long")).alias("t")).select("id", F.slice("t", skip + 1, F.size("t") + 1).alias("t"))
    step = 2 if weighted else 1
    at = F.when(F.size("t") > 0, F.sequence(F.lit(1), F.size("t"), F.lit(step))).otherwise(F.array().cast("array<int>"))
    arcs = nums.select("id", F.explode(F.transform(at, lambda i: F.struct((F.element_at("t", i) - 1).alias("dst"), (F.element_at("t", i + 1) if weighted else F.lit(1).cast("long")).alias("weight")))).alias("a"))
    edges = arcs.select(F.col("id").alias("src"), "a.dst", "a.weight").where("src < dst")
    return Graph.of(edges, spark.range(n))


def write_metis(g: Graph, path: str, weighted: bool = True) -> None:
    """Vertices must be 0 .. n-1."""
    one = F.concat_ws(" ", (F.col("dst") + 1).cast("string"), F.col("weight").cast("string")) if weighted else (F.col("dst") + 1).cast("string")
    near = g.arcs().groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list(F.struct("dst", one.alias("s")))).alias("x"))
    lines = g.vertices.join(near, "id", "left").select("id", F.coalesce(F.array_join(F.col("x.s"), " "), F.lit("")).alias("value"))
    head = g.vertices.agg(F.count("*").alias("n")).crossJoin(g.edges.agg(F.count("*").alias("m"))).select(F.lit(-1).cast("long").alias("id"), F.concat(F.col("n"), F.lit(" "), F.col("m"), F.lit(" 1" if weighted else "")).alias("value"))
    head.union(lines).repartitionByRange(1, "id").sortWithinPartitions("id").select("value").write.text(path)


def read_dimacs(spark: SparkSession, path: str) -> Graph:
    """``p <format> n m`` and lines ``a|e s t [w]`` (1-based); the weight is 1 where there is none."""
    lines = spark.read.text(path)
    p = lines.where(F.col("value").startswith("p ")).limit(1).collect()
    n = int(p[0][0].split()[2]) if p else 0
    x = F.regexp_extract
    e = lines.where(F.col("value").rlike(r"^[ae]\s")).select(*(x("value", r"^[ae]\s+(\d+)\s+(\d+)(?:\s+(\d+))?", i).alias(c) for i, c in ((1, "s"), (2, "t"), (3, "w"))))
    rows = e.select((F.col("s").cast("long") - 1).alias("src"), (F.col("t").cast("long") - 1).alias("dst"), F.when(F.col("w") == "", 1).otherwise(F.expr("try_cast(w as bigint)")).cast("long").alias("weight")).where("src < dst")
    return Graph.of(rows, spark.range(n))


def write_dimacs(g: Graph, path: str) -> None:
    head = g.vertices.agg(F.count("*").alias("n")).crossJoin(g.edges.agg(F.count("*").alias("m"))).select(F.lit(-1).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.format_string("p cut %d %d", "n", "m").alias("value"))
    body = g.edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.format_string("a %d %d %d", F.col("src") + 1, F.col("dst") + 1, F.col("weight")).alias("value"))
    head.union(body).repartitionByRange(1, "a", "b").sortWithinPartitions("a", "b").select("value").write.text(path)


def read_temporal(spark: SparkSession, path: str) -> DataFrame:
    """``seq, src, dst, delta, ts`` from lines ``s t ts`` or ``s t w ts`` (1-based, signed w); comments are skipped.

    A file with a line ``p ...`` is an edge list: every edge is inserted once, at the time of its line.
    """
    lines = numbered_lines(spark, path)
    if lines.where(F.col("value").startswith("p ")).limit(1).count():
        x = F.regexp_extract
        e = lines.select("line", *(x("value", r"^[ae]\s+(\d+)\s+(\d+)", i).alias(c) for i, c in ((1, "s"), (2, "t")))).where("s <> ''")
        e = e.select(F.col("line").alias("seq"), (F.col("s").cast("long") - 1).alias("src"), (F.col("t").cast("long") - 1).alias("dst"), F.lit(1).cast("long").alias("delta"), F.col("line").alias("ts"))
        return e.where("src < dst")
    rows = lines.where(~F.col("value").rlike("^[ \t]*%") & (F.trim("value") != ""))
    t = rows.select("line", F.split(F.trim("value"), r"\s+").alias("t"))
    get = lambda i: F.get("t", F.lit(i)).cast("long")
    four = F.size("t") > 3
    return t.select(F.col("line").alias("seq"), (get(0) - 1).alias("src"), (get(1) - 1).alias("dst"), F.when(four, get(2)).otherwise(1).cast("long").alias("delta"), F.when(four, get(3)).otherwise(get(2)).alias("ts"))


def write_cut(sides: DataFrame, path: str) -> None:
    """``id, side``: one 0 or 1 a line in the order of ids."""
    sides.repartitionByRange(1, "id").sortWithinPartitions("id").select(F.col("side").cast("string").alias("value")).write.text(path)


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    """``id, value`` of one number a line; comments are skipped."""
    rows = numbered_lines(spark, path).where(~F.col("value").rlike("^[ \t]*%") & (F.trim("value") != ""))
    return rows.select((F.row_number().over(W.orderBy("line")) - 1).cast("long").alias("id"), F.trim("value").cast("double").alias("value"))


def write_vector(rows: DataFrame, path: str) -> None:
    """``id, value``: one value a line in the order of ids, as one file."""
    rows.repartitionByRange(1, "id").sortWithinPartitions("id").select(F.col("value").cast("string").alias("value")).write.text(path)


def write_solution(blocks: DataFrame, path: str) -> None:
    """``id, block``: one block a line in the order of ids."""
    write_vector(blocks.select("id", F.col("block").alias("value")), path)


def read_order(spark: SparkSession, path: str) -> DataFrame:
    """``id, place`` of a file of places, one a line: vertex i stands at that place."""
    return read_vector(spark, path).select("id", F.col("value").cast("long").alias("place"))


def read_ordered_partition(spark: SparkSession, path: str, order: str, k: int) -> DataFrame:
    """``id, terminal`` of a partition file whose lines stand in the order of a file of places."""
    part = read_partition(spark, path, k).withColumnRenamed("id", "place")
    return read_order(spark, order).join(part, "place").select("id", "terminal")


def write_problem(g: Graph, terminals: DataFrame, path: str) -> None:
    """A reduced problem: the graph under ``path``/graph (vertices renumbered 0 .. n-1 by id) and ``path``/terminals with a line ``vertex place`` each."""
    from cleave.operators.relational import dense_ids, contract

    dense = dense_ids(g.vertices.select("id", F.col("id").alias("block")))
    write_metis(contract(g, dense), f"{path}/graph")
    named = terminals.select("id", "place").join(dense, "id").select(F.col("block").alias("id"), F.concat_ws(" ", F.col("block").cast("string"), F.col("place").cast("string")).alias("value"))
    write_vector(named, f"{path}/terminals")


def read_partition(spark: SparkSession, path: str, k: int) -> DataFrame:
    """``id, terminal``: one block a line; the value ``k`` is no terminal (null)."""
    return read_vector(spark, path).select("id", F.when(F.col("value") < k, F.col("value").cast("long")).alias("terminal"))


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A cactus (``node_id, contained`` and ``u, v, weight``) as one GraphML file."""
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n<key id="containedVertices" for="node" attr.name="containedVertices" attr.type="string"/>\n<key id="weight" for="edge" attr.name="weight" attr.type="long"/>\n<graph edgedefault="undirected">'
    text = lambda part, key, value: (F.lit(part).alias("part"), F.col(key).cast("long").alias("k"), value.alias("value"))
    n = nodes.select(*text(1, "node_id", F.format_string('<node id="n%d"><data key="containedVertices">%s</data></node>', F.col("node_id"), F.array_join(F.transform("contained", lambda x: x.cast("string")), ","))))
    e = edges.select(*text(2, "u", F.format_string('<edge source="n%d" target="n%d"><data key="weight">%d</data></edge>', "u", "v", "weight")))
    ends = nodes.sparkSession.createDataFrame([(0, 0, head), (3, 0, "</graph>\n</graphml>")], "part int, k long, value string")
    ends.union(n).union(e).repartitionByRange(1, "part", "k").sortWithinPartitions("part", "k", "value").select("value").write.text(path)
