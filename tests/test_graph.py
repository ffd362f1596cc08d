"""Operators and formats on the fixtures, and the queries against their SQL."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cleave.functions import kernels as K
from cleave.functions import triangles as N
from cleave.graph import Graph
from cleave.operators import components as C
from cleave.operators import reduce as R
from cleave.operators import relational as L
from cleave.plans import catalogue, cuts
from cleave.sources import generators, text

SF = "/root/testdata/sf0.001"
SMALL = [(0, 1), (0, 2), (0, 3), (0, 4), (1, 2), (1, 3), (2, 3), (3, 7), (4, 5), (4, 6), (4, 7), (5, 6), (5, 7), (6, 7)]
WEIGHTED = [3, 4, 2, 1, 5, 2, 10, 2, 3, 9, 3, 2, 14, 2]


@pytest.fixture(scope="module")
def small(spark):
    return Graph.of(spark.createDataFrame([(u, v, w) for (u, v), w in zip(SMALL, WEIGHTED, strict=True)], "src long, dst long, weight long"))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_degrees(small):
    assert [r[2] for r in rows(L.degrees(small))] == [10, 10, 19, 16, 16, 19, 13, 21]


def test_min_cut(spark, small):
    value, sides = cuts.min_cut(small)
    assert value.first()[0] == 3
    assert [r[1] for r in rows(sides)] == [0, 0, 0, 0, 1, 1, 1, 1]
    assert rows(cuts.cut_list(small)) == [(3, "4,5,6,7")]
    none = Graph.of(spark.createDataFrame([], "src long, dst long, weight long"))
    assert cuts.min_cut(none)[0].first()[0] is None
    apart = Graph.of(spark.createDataFrame([(0, 1, 1), (2, 3, 1)], "src long, dst long, weight long"))
    assert cuts.min_cut_value(apart).first()["cut_value"] == 0
    with pytest.raises(ValueError):
        cuts.min_cut(small, "other")


def test_formats(spark, small, tmp_path):
    text.write_metis(small, f"{tmp_path}/m")
    back = text.read_metis(spark, f"{tmp_path}/m")
    assert rows(back.edges) == rows(small.edges) and back.vertices.count() == 8
    text.write_dimacs(small, f"{tmp_path}/d")
    assert rows(text.read_dimacs(spark, f"{tmp_path}/d").edges) == rows(small.edges)
    (tmp_path / "t").write_text("% x\n1 2 +3 10\n2 3 11\n1 2 -1 12\n")
    assert rows(text.read_temporal(spark, f"{tmp_path}/t").select("src", "dst", "delta", "ts")) == [(0, 1, -1, 12), (0, 1, 3, 10), (1, 2, 1, 11)]
    (tmp_path / "p").write_text("0\n2\n1\n")
    assert rows(text.read_partition(spark, f"{tmp_path}/p", 2).where("terminal is not null")) == [(0, 0), (2, 1)]
    nodes, edges = cuts.cactus(small)
    text.write_graphml(nodes, edges, f"{tmp_path}/g")
    assert sum(r[0].startswith("<node") for r in spark.read.text(f"{tmp_path}/g").collect()) == 2


def test_generators(spark):
    g = generators.torus(spark, 2, 5, 2, 1)
    assert sum(r[1] for r in g.violations().collect()) == 0
    assert rows(generators.torus(spark, 2, 5, 2, 1).edges.repartition(3)) == rows(g.edges)
    start, updates = generators.update_stream(g, 0.3, 0.2, 4, 1)
    assert start.edges.count() + updates.where("delta > 0").count() == g.edges.count()
    w = rows(generators.random_weights(g, 3, 5, 1).edges)
    assert {x[2] for x in w} <= {3, 4, 5}


def test_cores_and_matching(spark):
    g = Graph.of(spark.createDataFrame([(0, 1, 1), (0, 2, 1), (1, 2, 1), (2, 3, 1)], "src long, dst long, weight long"), spark.range(5))
    assert rows(C.core_numbers(g)) == [(0, 2), (1, 2), (2, 2), (3, 1), (4, 0)]
    m = R.matching(g.edges.select("src", "dst")).collect()
    ends = [x for r in m for x in r]
    assert m and len(set(ends)) == len(ends)
    assert rows(C.all_components(g)) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 4)]


def test_replay_and_stream(spark, tmp_path):
    u = spark.createDataFrame([(1, 0, 1, 2, 1), (2, 1, 2, 3, 1), (3, 0, 2, 1, 2), (4, 0, 1, -1, 3)], "seq long, src long, dst long, delta long, ts long")
    assert [r["cut_value"] for r in cuts.replay(u).orderBy("ts").collect()] == [2, 3, 1]
    u.withColumn("graph", u.seq * 0).write.parquet(f"{tmp_path}/u")
    s = cuts.stream_cut(spark.readStream.schema("seq long, src long, dst long, delta long, ts long, graph long").parquet(f"{tmp_path}/u"))
    q = s.writeStream.format("memory").queryName("cuts").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select cut_value from cuts order by seq desc").first()[0] == 1


def test_padberg_rinaldi_below_least_degree(spark):
    triangles = [(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5), (2, 3)]
    squares = [(0, 1), (1, 2), (2, 3), (0, 3), (4, 5), (5, 6), (6, 7), (4, 7), (3, 4)]  # no strict test moves anything here
    for e in (triangles, squares):
        g = Graph.of(spark.createDataFrame([(u, v, 1) for u, v in e], "src long, dst long, weight long"))
        value, sides = cuts.min_cut(g, "pr")
        assert value.first()[0] == 1
        assert [r[1] for r in rows(sides)] == [0] * (max(map(max, e)) // 2 + 1) + [1] * (max(map(max, e)) // 2 + 1)


def test_replay_refuses_a_large_start(spark, monkeypatch):
    u = spark.createDataFrame([(1, 0, 1, 2, 1)], "seq long, src long, dst long, delta long, ts long")
    start = spark.range(21).select("id", (F.col("id") + 1).alias("dst"), F.lit(1).cast("long").alias("weight")).toDF("src", "dst", "weight")
    monkeypatch.setattr(cuts, "KERNEL_VERTICES", 1)
    assert cuts.replay(u, start.limit(20)).count() == 1
    with pytest.raises(ValueError):
        cuts.replay(u, start)


@pytest.mark.parametrize("name", ["deg_weighted", "deg_percentile", "contract_by_region", "components", "pr3_triangles", "pr4_common", "equal_neighbourhood", "min_cut_value", "min_cut_all", "st_source_side", "multiterminal_value"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalogue.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({catalogue.SQL[name]})").fetchall()
    key = lambda r: tuple(str(round(x, 9) if isinstance(x, float) and not math.isnan(x) else x) for x in r)
    assert sorted(map(key, got.select(*cols).collect())) == sorted(map(key, want))


@pytest.mark.parametrize("seed", range(2))
def test_articulation_by_joins(spark, seed):
    rng = random.Random(seed)
    edges = {(u, rng.randrange(max(0, u - 8) // 12 * 12, u)) for u in range(1, 24) if u != 12} | {tuple(rng.sample(range(12 * i, 12 * i + 12), 2)) for i in range(2) for _ in range(4)}
    g = Graph.of(spark.createDataFrame([(u, v, 1) for u, v in edges], "src long, dst long, weight long"))
    points, bridges = K.articulation_points(K.adjacency([tuple(r) for r in g.edges.collect()]))
    want = {("point", u, None) for u in points} | {("bridge", u, v) for u, v in bridges}
    got = [tuple(r) for r in cuts.structure(g, 2).collect()]
    assert len(got) == len(want) and set(got) == want


def test_articulation_of_a_large_star(spark):
    star = Graph.of(spark.range(1, 6002).select(F.lit(0).alias("src"), F.col("id").alias("dst"), F.lit(1).alias("weight")))
    assert {(r[0], r[1]) for r in cuts.structure(star).groupBy("kind").count().collect()} == {("point", 1), ("bridge", 6001)}


def test_articulation_of_a_large_ring_with_leaves(spark):
    e = [(0, 1), (1, 2), (2, 3), (0, 3)] + [(i % 4, i) for i in range(4, 5100)]
    g = Graph.of(spark.createDataFrame([(u, v, 1) for u, v in e], "src long, dst long, weight long"))
    got = cuts.structure(g)
    assert rows(got.where("kind = 'point'").select("u")) == [(0,), (1,), (2,), (3,)]
    assert rows(got.where("kind = 'bridge'").select("u", "v")) == sorted(e[4:])


def test_articulation_ring_of_a_whole_table_above_the_kernel(spark):
    sf = "/root/testdata/sf0.1"
    con = duckdb.connect()
    for name in ("customer", "nation", "region"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    want = con.execute(catalogue.SQL["articulation_ring"]).fetchall()
    assert len(want) > cuts.KERNEL_VERTICES  # one component holds all
    got = [tuple(r) for r in catalogue.QUERIES["articulation_ring"](spark, sf).select("kind", "u", "v").collect()]
    assert len(got) == len(want) and set(got) == set(want)


def test_triangle_totals(spark):
    rng = random.Random(1)
    for n, p in ((30, 0.4), (400, 0.012)):
        e = [(u, v, rng.randint(1, 9)) for u in range(n) for v in range(u) if rng.random() < p]
        g = Graph.of(spark.createDataFrame(e, "src long, dst long, weight long"))
        t = R.all_triangles(g).agg(F.count("*"), F.sum(F.expr("w_ab + w_ac + w_bc"))).first()
        for most in (10**6, len(e), len(e) // 4):  # 1, 3 and 5 blocks
            assert tuple(R.triangle_totals(g, most).first()) == tuple(t)
    none = Graph.of(spark.createDataFrame([(0, 1, 1)], "src long, dst long, weight long"))
    assert tuple(R.triangle_totals(none).first()) == (0, None)


def test_triangle_totals_write_no_pairs(spark, monkeypatch):
    from cleave.sources import tables as T

    monkeypatch.setattr(R, "all_triangles", lambda g: pytest.fail("the query lists the triangles"))
    monkeypatch.setattr(T, "table", lambda s, d, n: spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1), (2, 2)], "l_orderkey long, l_suppkey long"))
    assert tuple(catalogue.QUERIES["triangles_suppliers"](spark, "").first()) == (1, 4)


def test_triangles_suppliers_keeps_pairs_in_arrays(spark, monkeypatch):
    from cleave.sources import tables as T

    rng = random.Random(3)
    lines = [(rng.randrange(200), rng.randrange(-40, 40)) for _ in range(900)] + [(500, s) for s in range(30, 90)] + [(None, 1), (7, None), (7, 2), (7, 2)]
    df = spark.createDataFrame(lines, "l_orderkey long, l_suppkey long")
    con = duckdb.connect()
    con.execute("CREATE TABLE lineitem (l_orderkey BIGINT, l_suppkey BIGINT)")
    con.executemany("INSERT INTO lineitem VALUES (?, ?)", lines)
    want = con.execute(catalogue.SQL["triangles_suppliers"]).fetchall()[0]
    monkeypatch.setattr(T, "table", lambda s, d, n: df)
    monkeypatch.setattr(Graph, "of", lambda *a: pytest.fail("the query makes a row of every pair"))
    assert tuple(catalogue.QUERIES["triangles_suppliers"](spark, "").first()) == want
    for most in (4000, 400):  # 3 blocks and more
        assert tuple(R.shared_triangle_totals(T.supplier_orders(spark, ""), most).first()) == want
    assert tuple(R.shared_triangle_totals(df.limit(0).toDF("group", "member")).first()) == (0, None)


@pytest.mark.parametrize("n, p", [(150, 0.3), (150, 0.02), (3000, 0.001)])
def test_common_neighbours_by_bits_and_look_ups(n, p):
    rng = np.random.default_rng(2)
    m = np.triu(rng.random((n, n)) < p, 1)
    m |= m.T
    u, v = np.nonzero(np.triu(m))
    near = N.Near(*np.nonzero(m), n, n)
    want = (m[u] & m[v]).sum(axis=1)
    starts = np.append(np.flatnonzero(np.append(True, u[1:] != u[:-1])), len(u))
    assert want.any() and (N.common(u, v, near, near) == want).all()
    assert (N._by_bits(u, v, starts, near, near) == want).all()
    assert (N._by_look_up(u, v, np.minimum(near.n[u], near.n[v]), near, near) == want).all()


def test_replay_over_batches_and_streams(spark):
    rng = random.Random(5)
    rows_ = [(g, t, 20 * t + i, rng.randrange(3), 5 + rng.randrange(3), rng.choice((1, 1, 2, -1))) for g in (1, 2, 3) for t in range(4) for i in range(7)]
    shuffled = rng.sample(rows_, len(rows_))
    u = spark.createDataFrame(shuffled, "graph long, ts long, seq long, src long, dst long, delta long")
    want, each, totals = [], [], []
    for g in (1, 2, 3):
        d, changes, sums = K.DynamicCut(), 0, [0, 0]
        before = d.value
        for _, t, seq, a, b, w in (r for r in rows_ if r[0] == g):
            now = d.insert(a, b, w) if w > 0 else d.delete(a, b)
            changes, before = changes + (now != before), now
            sums[w < 0] += 1
            each.append((g, t, seq, now, changes))
            if seq % 20 == 6:
                want.append((g, t, seq, now, changes))
        totals.append((g, *sums, changes, d.value, False))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got, got_each, got_totals = rows(cuts.replay(u)), rows(cuts.replay(u, one_by_one=True)), rows(cuts.replay_totals(u).drop("solves"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # before the second vertex there is no value, which a frame holds as NaN
    assert got == want and len(got_each) == len(each) and got_each[-50:] == each[-50:] and got_totals == totals


def test_replay_totals_of_a_long_stream(spark):
    u = spark.range(20_000).select(
        F.col("id").alias("seq"), (F.pmod(F.xxhash64("id"), F.lit(5))).alias("src"), (10 + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(24))).alias("dst"),
        F.when(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(5)) == 0, -1).otherwise(1).cast("long").alias("delta"), F.col("id").alias("ts"),
    )
    got = cuts.replay_totals(u).first()
    deletes = u.where("delta < 0").count()
    assert (got["inserts"], got["deletes"], got["timed_out"]) == (20_000 - deletes, deletes, False)
    assert got["solves"] < 1000  # one for each deletion before


def test_replay_totals_of_events_without_a_time_and_of_none(spark, tmp_path):
    e = [(i, f"2024-01-01 {i % 3:02}:00:00" if i % 4 else None, "error" if i == 9 else "ab"[i % 2]) for i in range(60)]
    for name, some in (("some", e), ("none", [])):
        (tmp_path / name).mkdir()
        spark.createDataFrame(some, "event_id long, ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/{name}/events.parquet")
        got = catalogue.QUERIES["replay_totals"](spark, f"{tmp_path}/{name}")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/{name}/events.parquet/*.parquet'")
        assert rows(got) == con.execute(catalogue.SQL["replay_totals"]).fetchall()
    u = spark.createDataFrame([(1, 1, 2, 5, 1), (2, 2, None, 7, None), (3, None, 3, -1, 2), (4, 2, 2**53 + 1, 3, 3), (5, 2**53 + 1, 1, 1, 3)], "seq long, src long, dst long, delta long, ts long")
    assert tuple(cuts.replay_totals(u).first())[1:4] + (cuts.replay_totals(u).first()["cut_value"],) == (4, 1, 3, 4)
