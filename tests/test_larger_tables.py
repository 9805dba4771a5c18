"""What larger tables need: pairs and vectors that don't multiply on their way, searches that stay exact."""

import math

import pytest
from pyspark.sql import functions as F

from vecloom.operators import nearest
from vecloom.queries import QUERIES

DATA = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def told(rows):
    return sorted(((*r[:-1], None if r[-1] is None else "nan" if math.isnan(r[-1]) else round(r[-1], 9) + 0.0) for r in rows), key=str)


def test_every_pair_is_measured_where_blocks_meet(spark):
    """Blocks give what pairs joined with their vectors give, odd vectors included; the queries shuffle no pairs."""
    odd = [(1, None), (2, [NAN, 0.0]), (3, [None, 1.0]), (4, [INF, 0.0]), (5, [0.0, 0.0])]
    rows = odd + [(i, [float(i % 4), float(i % 3 - 1)]) for i in range(6, 40)]
    pts = spark.createDataFrame(rows, "id long, features array<double>")
    q = pts.where("id % 5 < 2 OR id = 3").withColumnRenamed("id", "query_id")
    pairs = q.select(F.col("query_id").alias("a")).crossJoin(pts.select(F.col("id").alias("b")))
    for name in ("l2", "sql2", "cosine", "jaccard", "projected", "cos_sim_squared"):
        found = nearest.every_distance(q, pts, name, block_queries=3, block_points=8).select("query_id", "id", "distance")
        assert told(found.collect()) == told(nearest.pair_distances(pairs, pts, name).select("a", "b", "distance").collect())
    assert nearest.every_distance(q.limit(0), pts).count() == nearest.every_distance(q, pts.limit(0)).count() == 0
    twice = nearest.every_distance(q.where("query_id = 6"), pts.unionByName(pts), "sql2")
    assert twice.count() == 2 * len(rows)
    with pytest.raises(Exception, match="of one length"):
        nearest.every_distance(q, pts.unionByName(spark.createDataFrame([(50, [1.0])], pts.schema)), "cosine").collect()
    for name in ("metric_l2", "metric_jaccard"):
        assert "Join" not in QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_pairs_leave_a_block_by_distance(spark, monkeypatch):
    """Equal distances lie side by side, so the rows take less room in files; none is lost where a table leaves in pieces."""
    monkeypatch.setattr(nearest, "SENT", 1000)
    pts = spark.range(400).select("id", F.array(F.rand(1), F.rand(2)).alias("features")).localCheckpoint()
    for name in ("l2", "cosine"):
        rows = nearest.every_distance(pts.where("id % 8 = 0").withColumnRenamed("id", "query_id"), pts, name).collect()
        assert len({r[:2] for r in rows}) == len(rows) == 50 * 400
        assert [r["distance"] for r in rows] == sorted(r["distance"] for r in rows)


def test_pairs_of_equal_distance_leave_a_block_by_query(spark):
    """Where a metric has few distances, as Jaccard's, a query's pairs of one distance lie side by side, so that its id is stored once for them."""
    pts = spark.range(2000).select("id", F.array(*(F.floor(F.rand(i) * 2).cast("double") for i in range(6))).alias("features")).localCheckpoint()
    rows = [tuple(r) for r in nearest.every_distance(pts.where("id % 20 = 0").withColumnRenamed("id", "query_id"), pts, "jaccard").select("distance", "query_id", "id").collect()]
    runs = 1 + sum(a[:2] != b[:2] for a, b in zip(rows, rows[1:], strict=False))
    assert len(rows) == 100 * 2000 and runs == len({r[:2] for r in rows})


def test_rounded_pairs_are_measured_by_a_product(spark):
    """Rounded where they are measured, pairs are what plain rounding gives: those near a half, copies, huge and undefined distances, any size of table; few are measured one by one."""
    import dataclasses

    import numpy as np

    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(size=(60, 8)), np.zeros((1, 8)), np.full((1, 8), 0.5e-6)])
    x[3] = x[4]
    halves = np.zeros((40, 8))
    halves[:, 0] = (np.arange(40) + 0.5) * 1e-6  # distances from 0 lie half way between two numbers of six decimals
    y = np.vstack([x, halves])
    for name in ("l2", "sql2", "cosine", "jaccard", "projected", "cos_sim_squared"):
        m, measured = nearest.metric(name), []
        counting = dataclasses.replace(m, exact=m.exact and (lambda a, b, m=m, measured=measured: measured.append(len(a)) or m.exact(a, b)))
        for scale in (1.0, 1e12):
            plain = np.stack([m.exact(v[None], y * scale) for v in x * scale]) if m.exact else np.asarray(m.kernel(x * scale, y * scale), float)
            want = np.where(np.isnan(plain), np.nan, np.floor(np.maximum(plain, 0) * 1e6 + 0.5) / 1e6)
            i, j, d = (np.concatenate(c) for c in zip(*nearest._sorted_table(counting, x * scale, y * scale, 6), strict=True))
            found = np.full(want.shape, -1.0)
            found[i, j] = d
            assert len(i) == want.size and np.allclose(found, want, rtol=1e-12, atol=0, equal_nan=True) and (np.diff(d[~np.isnan(d)]) >= 0).all()
            assert scale > 1 or not m.exact or sum(measured) < want.size / 2
    pts = spark.createDataFrame([*enumerate(x.tolist()), (90, None), (91, [NAN] * 8)], "id long, features array<double>")
    q = pts.where("id % 5 = 1").withColumnRenamed("id", "query_id")
    for name in ("l2", "cos_sim_squared"):
        both = [nearest.every_distance(q, pts, name, 5, 20, decimals=d).select("query_id", "id", "distance") for d in (None, 6)]
        assert told(both[0].withColumn("distance", F.round("distance", 6)).collect()) == told(both[1].collect())
    plan = QUERIES["metric_l2"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" not in plan


def brute(q, pts, k, distance):
    best = lambda x: sorted((distance(x, y), b) for b, y in pts.items())[:k]
    return {(a, b): round(d, 9) for a, x in q.items() for d, b in best(x)}


def test_copies_and_ties_rank_by_id(spark, monkeypatch):
    """More copies than are in hand, whose distances the kernel's rounding would put in any order; many equal distances in many pieces."""
    monkeypatch.setattr(nearest, "SOME_QUERIES", 3)
    monkeypatch.setattr(nearest, "SOME_POINTS", 7)
    base = [0.1, 0.7, -0.3]
    pts = {i: [v * (1 + (i % 7 == 3)) for v in base] if i % 3 else [float(i % 5), 0.3, 1.0] for i in range(90)}
    df = spark.createDataFrame(list(pts.items()), "id long, features array<double>")
    q = df.where("id % 4 = 0").withColumnRenamed("id", "query_id")
    for rows in (16, 4096):
        for name, distance in (("l2", math.dist), ("jaccard", lambda x, y: 1 - sum(bool(a) and bool(b) for a, b in zip(x, y)) / sum(bool(a) or bool(b) for a, b in zip(x, y)))):
            one = F.lit(0).cast("long").alias("bucket")
            found = nearest.nearest_in_buckets(q.select("*", one), df.select("*", one), 12, name, block_rows=rows).collect()
            assert {(r["query_id"], r["nbr"]): round(r["distance"], 9) for r in found} == brute({i: v for i, v in pts.items() if i % 4 == 0}, pts, 12, distance)


def test_blocks_grow_with_their_bucket(spark):
    """A vector is sent to some blocks of the other side, whatever the number of rows."""
    pts = spark.range(3000).select("id", F.array(F.rand(1), F.rand(2)).alias("features"))
    one = F.lit(0).cast("long").alias("bucket")
    found = nearest.nearest_in_buckets(pts.select(F.col("id").alias("query_id"), "features", one), pts.select("id", "features", one), 3, block_rows=100)
    blocks = found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 9000 and "least" in blocks


def test_a_bound_that_walks_found_keeps_all_ties(spark):
    import numpy as np

    from vecloom.functions.metrics import metric

    x = np.array([[0.0, 1.0], [1.0, 1.0], [1.0, 1.0], [2.0, 1.0]])
    for name in ("l2", "sql2", "cosine", "jaccard"):
        want = nearest._nearest(metric(name), 2, np.arange(4), x, np.arange(4), x)
        bound = [want[2][want[0] == i].max() for i in range(4)]
        assert [c.tolist() for c in nearest._nearest(metric(name), 2, np.arange(4), x, np.arange(4), x, bounds=bound)] == [c.tolist() for c in want]


def test_certain_local_graphs_are_exact(spark):
    """Blocks far larger than the points that a walk has in hand give what a scan gives."""
    import numpy as np

    from vecloom.operators import local_graph, voronoi

    x = np.random.default_rng(5).normal(size=(900, 24)).tolist()
    pts = spark.createDataFrame(list(enumerate(x)), "id long, features array<double>")
    index = voronoi.build_voronoi(pts, voronoi.select_seeds(pts, 1), 1)
    q = pts.where("id % 5 = 0").withColumnRenamed("id", "query_id")
    walked, certain = (index.search(q, 10, hops=0, local=local_graph.build_local_graphs(index, certain=c), ef=10).collect() for c in (False, True))
    rows = lambda found: sorted((r["query_id"], r["rank"], r["nbr"], round(r["distance"], 9)) for r in found)
    wanted = rows(index.search(q, 10, hops=0).collect())
    assert rows(certain) == wanted and rows(walked) != wanted


def test_a_user_function_of_many_vectors(spark):
    """It gets a table where it can, and gives in search and in Columns what it gives a pair at a time."""
    from vecloom.functions.metrics import metric, register_function_metric

    calls = []
    one = register_function_metric("gap", lambda x, y: float(abs(x - y).max()))
    many = register_function_metric("gaps", lambda x, y: calls.append(y.shape) or abs(y - x).max(axis=-1), many=True)
    import numpy as np

    x, y = np.random.default_rng(1).normal(size=(4, 3)), np.random.default_rng(2).normal(size=(6, 3))
    assert (one.kernel(x, y) == many.kernel(x, y)).all() and calls == [(6, 3)] * 4
    assert metric("gaps").kernel(x[:2].tolist(), y.tolist()).tolist() == one.kernel(x[:2], y).tolist()
    pts = spark.createDataFrame([(1, [0.0, 1.0]), (2, [2.0, 5.0]), (3, None)], "id long, features array<double>")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    found = nearest.pair_distances(pairs, pts, register_function_metric("gaps", lambda x, y: abs(y - x).max(axis=-1), many=True))
    assert {r["b"]: r["distance"] for r in found.collect()} == {2: 4.0, 3: None}


def test_pairs_of_a_walk_are_measured_by_parts(spark, monkeypatch):
    """A part has each vector once, whatever the number of its pairs; unknown ids and vectors that aren't finite have no rows."""
    monkeypatch.setattr(nearest, "PART_ROWS", 7)
    rows = [(i, [float(i % 6), float(i % 5)]) for i in range(40)] + [(40, None), (41, [NAN, 0.0]), (42, [None, 1.0])]
    pts = spark.createDataFrame(rows, "id long, features array<double>")
    q = pts.where("id % 3 = 0 OR id > 39").withColumnRenamed("id", "query_id")
    pairs = q.select("query_id").crossJoin(pts.select(F.col("id").alias("nbr"))).unionByName(spark.createDataFrame([(0, 99), (99, 0)], "query_id long, nbr long"))
    plain = nearest.pair_distances(pairs, q.withColumnRenamed("query_id", "id"), "l2", "query_id", "nbr", pts).where(nearest.finite(F.col("distance")))
    found = nearest.paired_by_parts(pairs, q, pts)
    assert told(found.collect()) == told(plain.select("query_id", "nbr", "distance").collect())
    assert "CoGroups" in found._jdf.queryExecution().executedPlan().toString()
    assert nearest.paired_by_parts(pairs.limit(0), q, pts).count() == nearest.paired_by_parts(pairs, q.limit(0), pts).count() == 0


def test_a_search_multiplies_tables(spark, monkeypatch):
    """Where distances come from one product of two tables, searches use it, and rank as by the distances of pairs, odd vectors included."""
    import dataclasses

    import numpy as np

    from vecloom.functions import metrics

    x = np.random.default_rng(3).normal(size=(3000, 5)).round(1)
    x[::50], x[7], x[8] = 0.0, np.nan, np.inf
    with np.errstate(all="ignore"):
        for name in ("l2", "sql2", "cosine"):
            m = metrics.metric(name)
            plain = dataclasses.replace(m, factors=None)
            want = nearest._nearest(plain, 9, np.arange(0, 3000, 10), x[::10], np.arange(3000), x, True)
            monkeypatch.setattr(nearest, "SOME_POINTS", 700)
            never = dataclasses.replace(m, kernel=None)
            found = nearest._nearest(never, 9, np.arange(0, 3000, 10), x[::10], np.arange(3000), x, True)
            assert (found[0] == want[0]).all() and np.allclose(found[2], want[2], atol=1e-12)
            assert (found[1] == want[1]).all() or not m.exact


def test_blocks_of_a_large_table_stay_few():
    """At 6 million vectors a block has its most rows; at 600,000 a vector is still sent to BLOCK_SHARE blocks a side."""
    assert 600_000 / nearest.BLOCK_SHARE <= nearest.MOST_ROWS


def test_descent_sends_a_vector_to_few_blocks():
    """From 0.1 to 1 GB the blocks, and so what is sent a vector, stay as many."""
    from vecloom.operators import descent

    assert descent.block_count(10_256) == descent.block_count(102_564) == descent.BLOCKS
    assert descent.block_count(0) == descent.block_count(300) == 1 and descent.block_count(10**7) == -(-(10**7) // descent.MOST_SOURCES)


def test_a_block_of_many_sources_gives_each_edge_once(spark, monkeypatch):
    """Some sources at a time, a block gives what it gives at once; single and double precision give the same graph."""
    import numpy as np

    from vecloom.operators import descent

    x = np.random.default_rng(7).normal(size=(300, 6)).astype(np.float32).astype(float)
    pts = spark.createDataFrame(list(enumerate(x.tolist())), "id long, features array<double>")
    edges = descent.first_neighbours(pts, 5).localCheckpoint()
    lists = descent.candidate_lists(descent.sampled_edges(edges, 5, 0.8, 0), 5, 0.8, 0).localCheckpoint()
    found = {}
    for some in (7, 1000):
        monkeypatch.setattr(descent, "SOME_SOURCES", some)
        table = descent._measure_block(nearest.metric("l2"), 5)
        about = pts.join(edges.groupBy(F.col("src").alias("id")).agg(F.max("distance").alias("bound")), "id").toArrow()
        out = table(lists.toArrow(), about).to_pylist()
        found[some] = [(r["src"], r["nbr"], r["distance"]) for r in out if r["src"] is not None]
        assert len({r[:2] for r in found[some]}) == len(found[some])
    assert found[7] == found[1000]
    wide = pts.unionByName(spark.createDataFrame([(300, [0.1] * 6)], pts.schema))
    narrow = pts.unionByName(spark.createDataFrame([(300, [float(np.float32(0.1))] * 6)], pts.schema))
    graphs = [{(r["src"], r["nbr"], round(r["distance"], 6)) for r in descent.knn_graph(df, 5, 1.0, 0, max_rounds=2).collect()} for df in (wide, narrow)]
    assert graphs[0] == graphs[1]


def test_a_block_of_descent_measures_what_may_be_of_use():
    """A product rules out pairs that no end can use, so few are measured exactly and no edge is lost; a source leaves in one row, merged as rows of an edge are."""
    import dataclasses

    import numpy as np
    import pyarrow as pa

    from vecloom.operators import descent

    rng, n, k, measured = np.random.default_rng(3), 400, 4, []
    x = rng.normal(size=(n, 5)).astype(np.float32)
    x[7], x[11] = np.nan, x[12]  # a vector that isn't finite, and a copy
    features = pa.array(list(x.tolist()), pa.list_(pa.float32()))
    src, nbr, is_new = np.repeat(np.arange(60), 30), rng.integers(0, n, 1800), rng.random(1800) < 0.5
    l2 = nearest.metric("l2")
    counting = dataclasses.replace(l2, exact=lambda a, b: measured.append(len(a)) or l2.exact(a, b))
    lists = pa.table({"src": src, "nbr": nbr, "is_new": is_new})
    for bound in (0.6, None):
        about = pa.table({"id": np.arange(n), "features": features, "bound": pa.array([bound] * n, pa.float64())})
        pairs = {tuple(sorted((a, b))) for s in range(60) for a in nbr[(src == s) & is_new] for b in nbr[src == s] if a != b}
        near = {p: d for p in pairs if (d := float(l2.exact(x[p[0]][None].astype(float), x[p[1]][None].astype(float))[0])) < (bound or INF)}
        ways = [(a, d, b) for p, d in near.items() for a, b in (p, p[::-1])]
        want = {(a, b): d for i in range(n) for a, d, b in sorted(w for w in ways if w[0] == i)[:k]}
        measured.clear()
        plain = descent._measure_block(counting, k)(lists, about).to_pylist()
        assert {(r["src"], r["nbr"]): r["distance"] for r in plain[:-1]} == want and len(plain) == len(want) + 1
        assert plain[-1]["named"] >= plain[-1]["measured"] == len(pairs)
        assert sum(measured) < len(pairs) / 10 or bound is None
        packed = descent._measure_block(counting, k, False, True)(lists, about).to_pylist()
        assert {(r["src"], b): d for r in packed[:-1] for b, d in zip(r["nbrs"], r["distances"], strict=True)} == want and len(packed) == len({a for a, _ in want}) + 1
    first = pa.table({"src": [1, 1, 2], "nbr": [5, 6, 5], "distance": [1.0, 2.0, 1.0], "is_new": [False, True, False]})
    came = pa.table({"src": [1, 1, 3], "nbrs": [[6, 4], [4, 3], [9]], "distances": [[2.0, 2.0], [2.0, 0.5], [1.0]]})
    rows = [tuple(r.values()) for r in descent._merge_block(3)(first, came).to_pylist()]
    assert rows == [(1, 3, 0.5, True, True), (1, 5, 1.0, False, False), (1, 6, 2.0, True, False), (2, 5, 1.0, False, False), (3, 9, 1.0, True, True)]


def test_two_blocks_of_a_graph_meet_once(spark, monkeypatch):
    """A vector is sent to as many blocks whatever the table's size, in single precision where that loses nothing, and no neighbour is lost."""
    assert {nearest.graph_blocks(n) for n in (10_256, 102_564, 615_384)} == {nearest.GRAPH_BLOCKS}
    assert nearest.graph_blocks(0) == nearest.graph_blocks(500) == 1 and nearest.graph_blocks(3_000_000) * nearest.MOST_ROWS >= 3_000_000
    monkeypatch.setattr(nearest, "GRAPH_ROWS", 10)
    base = {i: [float(i % 5), float(i % 7 - 3), 1.0 if i % 4 else 0.0] for i in range(150)}
    for more in (0.0, 0.1):  # 0.1 isn't single precision
        pts = {i: [v + more for v in x] for i, x in base.items()} | {200: [0.0, 0.0, 0.0], 201: [NAN, 1.0, 1.0], 202: [INF, 1.0, 1.0]}
        df = spark.createDataFrame([*pts.items(), (203, None), (204, [None, 1.0, 1.0])], "id long, features array<double>")
        met = nearest._met(df, 8).groupBy("id").count().collect()
        assert {r["count"] for r in met} == {8}
        for k in (1, 9, 400):
            rows = nearest.exact_knn_graph(df, k).collect()
            found = {(r["src"], r["nbr"]): round(r["distance"], 9) for r in rows}
            plain = {i: x for i, x in pts.items() if i < 201}
            want = {}
            for a, x in plain.items():
                want |= brute({a: x}, {b: y for b, y in plain.items() if b != a}, k, math.dist)
            assert found == want and len(rows) == len(found)
        kind = "float" if not more else "double"
        assert f"array<{kind}>" in nearest.exact_knn_graph(df, 3)._jdf.queryExecution().analyzed().treeString() or kind == "double"
    assert nearest.exact_knn_graph(df.where("id < 0"), 3).count() == 0
    twice = nearest.exact_knn_graph(df.unionByName(df), 400)
    assert twice.where("src = nbr").count() == 0


def shuffled(spark, run) -> int:
    """Bytes that all stages of run() shuffle."""
    sc = spark.sparkContext
    stages = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    sizes = lambda found: {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in map(found.apply, range(found.size()))}
    before = sizes(stages())
    run()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(b for stage, b in sizes(stages()).items() if stage not in before)


@pytest.fixture(scope="module")
def two_sizes(spark, tmp_path_factory):
    folders = [str(tmp_path_factory.mktemp(f"vectors-{n}")) for n in (7_200, 28_800)]
    for folder, n in zip(folders, (7_200, 28_800), strict=True):
        spark.range(n).select(F.col("id").alias("vec_id"), F.array(*(F.rand(i).cast("float") for i in range(64))).alias("embedding")).write.parquet(f"{folder}/embeddings.parquet")
    return folders


@pytest.mark.parametrize("name", ["reverse_edges", "adjacency_lists", "degree_stats", "dump_index_lines"])
def test_what_a_graph_query_shuffles_grows_as_its_points(spark, two_sizes, name):
    """Four times the points are at most some four times the bytes, though their pairs are sixteen times as many."""
    small, large = (shuffled(spark, lambda folder=folder: QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()) for folder in two_sizes)
    assert 0 < large < 5 * small
