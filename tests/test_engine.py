"""Small cases worked out by hand, properties, and recall on clustered points."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecloom.functions.metrics import metric, register_function_metric, register_metric
from vecloom.operators import descent, evaluate, local_graph, nearest, refine, voronoi, walk
from vecloom.sources import readers, writers
from vecloom.sources.store import IndexStore, VoronoiStore
from vecloom.streaming.inserts import insert_stream
from vecloom.streaming.queries import answer_stream
from vecloom.streaming.rounds import start_rounds

#: Squared distances from the origin: 25, 1, 9, 100, 9, 169.
PLACES = {11: (3, 4, 0), 12: (0, 0, 1), 13: (2, 2, 1), 14: (6, 0, 8), 15: (1, 2, 2), 16: (0, 5, 12)}


def table(spark, points, key="id"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in points.items()], f"{key} long, features array<double>")


def ids(results):
    out = {}
    for r in sorted(results.collect(), key=lambda r: (r["query_id"], r["distance"], r["nbr"])):
        out.setdefault(r["query_id"], []).append(r["nbr"])
    return out


def clusters(n_clusters, size, d, seed=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(n_clusters, d)) * 6
    return {10 * i: v for i, v in enumerate(np.concatenate([c + rng.normal(size=(size, d)) for c in centers]))}


def test_exact_small(spark):
    pts, q = table(spark, PLACES), table(spark, {0: (0, 0, 0)}, "query_id")
    found = nearest.exact_knn(q, pts, 4, "sql2")
    assert ids(found) == {0: [12, 13, 15, 11]}
    assert sorted(r["distance"] for r in found.collect()) == [1, 9, 9, 25]
    ragged = table(spark, {i: v + ((0,) if i > 13 else ()) for i, v in PLACES.items()})
    assert ids(nearest.exact_knn(q, ragged, 4, "projected")) == {0: [12, 16, 15, 13]}


def test_blocks_and_ties(spark):
    same = table(spark, {i: (1, 1) for i in range(40)})
    found = ids(nearest.nearest_in_buckets(same.withColumnRenamed("id", "query_id").withColumn("bucket", F.lit(0).cast("long")), same.withColumn("bucket", F.lit(0).cast("long")), 3, block_rows=7))
    assert found == {i: [0, 1, 2] for i in range(40)}


def test_voronoi_small(spark):
    """Points on a line around seeds at 0, 10 and 30: the first cell misses a near point of either query, the next hop finds it."""
    pts = table(spark, {21: (1,), 22: (3,), 23: (4,), 24: (7,), 25: (12,), 26: (18,), 27: (22,), 28: (29,)})
    seeds = spark.createDataFrame([(0, [0.0]), (1, [10.0]), (2, [30.0])], "cell int, features array<double>")
    index = voronoi.build_voronoi(pts, seeds, 2, "sql2")
    assert {r["id"]: r["cells"] for r in index.assign.collect()} == {21: [0, 1], 22: [0, 1], 23: [0, 1], 24: [1, 0], 25: [1, 0], 26: [1, 2], 27: [2, 1], 28: [2, 1]}
    q = table(spark, {1: (4.5,), 2: (19.5,)}, "query_id")
    assert ids(index.search(q, 3, hops=0)) == {1: [23, 22, 21], 2: [26, 25, 24]}
    assert ids(index.search(q, 3, hops=1)) == {1: [23, 22, 24], 2: [26, 27, 25]}
    assert index.size() == 8 and {r["cell"]: r["points"] for r in index.cell_sizes().collect()} == {0: 3, 1: 3, 2: 2}
    assert index.insert(table(spark, {29: (0.5,)})).size() == 9
    for ids_again in ((23,), (29, 29)):
        with pytest.raises(ValueError):
            index.insert(spark.createDataFrame([(i, [0.0]) for i in ids_again], "id long, features array<double>"))
    nearest.FEW_ROWS, usual = 1, nearest.FEW_ROWS  # seeds in blocks give the same cells
    assert sorted(map(str, voronoi.build_voronoi(pts, seeds, 2, "sql2").assign.collect())) == sorted(map(str, index.assign.collect()))
    nearest.FEW_ROWS = usual
    for bad in ({"hops": -1}, {"hops": 0, "initial": 0}, {"hops": 0, "rank": 3}):
        with pytest.raises(ValueError):
            index.search(q, 2, **bad)
    with pytest.raises(ValueError):
        voronoi.build_voronoi(pts, seeds, 4)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(*[st.integers(-3, 3)] * 3), min_size=2, max_size=8))
def test_kernels_agree_with_columns(spark, vectors):
    pts = table(spark, dict(enumerate(vectors)))
    pairs = pts.select(F.col("id").alias("a")).join(pts.select(F.col("id").alias("b")), F.col("a") <= F.col("b"))
    for name in ("l2", "sql2", "cosine", "jaccard", "projected"):
        m = metric(name)
        d = m.kernel([list(map(float, v)) for v in vectors], [list(map(float, v)) for v in vectors])
        assert np.allclose(d, d.T) and np.allclose(np.diag(d), 0, atol=1e-7)
        for r in nearest.pair_distances(pairs, pts, name).collect():
            assert r["distance"] == pytest.approx(d[r["a"], r["b"]], abs=1e-6)


def test_odd_vectors_never_rank(spark):
    """Null, empty, zero, ragged and NaN vectors, empty tables and repeated ids in exact search."""
    rows = [(1, [1.0, 0.0]), (2, None), (3, [float("nan"), 0.0]), (4, [None, 1.0]), (5, [float("inf"), 0.0]), (6, [0.0, 0.0]), (6, [0.0, 0.0]), (7, [0.5, 0.0])]
    pts = spark.createDataFrame(rows, "id long, features array<double>")
    q = pts.withColumnRenamed("id", "query_id").where("query_id IN (1, 2, 3)")
    assert ids(nearest.exact_knn(q, pts, 4)) == {1: [1, 7, 6, 6]}
    assert ids(nearest.exact_knn(q, pts, 9, "cos_sim_squared")) == {1: [1, 7]}
    assert nearest.exact_knn(q, pts.limit(0), 2).count() == nearest.exact_knn(q.limit(0), pts, 2).count() == 0
    ragged = spark.createDataFrame([(1, []), (2, [3.0]), (3, [1.0, 9.0])], "id long, features array<double>")
    assert ids(nearest.exact_knn(ragged.withColumnRenamed("id", "query_id"), ragged, 2, "projected")) == {2: [2, 3], 3: [3, 2]}
    pairs = spark.createDataFrame([(1, 6), (1, 7)], "a long, b long")
    once = pts.dropDuplicates(["id"])
    assert {r["b"]: r["distance"] for r in nearest.pair_distances(pairs, once, "cos_sim_squared").collect()} == {6: None, 7: 1.0}
    assert [tuple(r) for r in nearest.pair_distances(spark.createDataFrame([(1, 2)], "a long, b long"), ragged, "projected").select("distance").collect()] == [(None,)]


def test_vectors_that_no_distance_fits(spark):
    """Null vectors are never found, neither by walks nor by descent, and unlike lengths are a stated error."""
    pts = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.9, 0.1]), (5, [float("nan"), 1.0]), (6, [None, 1.0])], "id long, features array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0]), (8, None)], "query_id long, features array<double>")
    edges = spark.createDataFrame([(a, b, 0.0) for a in range(1, 7) for b in range(1, 7) if a != b], "src long, nbr long, distance double")
    for name in ("l2", "cosine", "jaccard", "projected", "cos_sim_squared"):
        found = walk.graph_search(q, pts, edges, 2, name, score_entries=True).collect()
        assert all(r["query_id"] == 9 for r in found) and len(found) == 2 and not {r["nbr"] for r in found} & {3, 6 if name != "projected" else 3}
    assert ids(walk.graph_search(q, pts, edges, 2, score_entries=True)) == {9: [1, 4]}
    for name in ("l2", "cosine"):
        graph = {(r["src"], r["nbr"]) for r in descent.knn_graph(pts, 2, 1.0, 0.0, name).collect()}
        assert graph and all(x in (1, 2, 4) for edge in graph for x in edge)
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 6), (3, 6)], "a long, b long")
    assert {(r["a"], r["b"]): r["distance"] for r in nearest.pair_distances(pairs, pts, "sql2").collect()} == {(1, 2): 2.0, (1, 3): None, (1, 6): None, (3, 6): None}
    uneven = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0]), (3, [1.0, 1.0])], "id long, features array<double>")
    for call in (lambda: nearest.pair_distances(pairs, uneven, "l2"), lambda: nearest.exact_knn_graph(uneven, 1, "cosine"), lambda: descent.measure_lists(spark.createDataFrame([(1, 2, True), (1, 3, True)], "src long, nbr long, is_new boolean"), edges, uneven, 2)):
        with pytest.raises(Exception, match="of one length"):
            call().collect()
    assert len(nearest.exact_knn_graph(uneven, 1, "projected").collect()) == 3
    with pytest.raises(ValueError, match="twice"):
        descent.knn_graph(pts.unionByName(pts), 2)


def test_blocks_of_descent(spark):
    """Lists measured in many blocks give the pairs that plain code names, each that beats a bound, with repeats and old neighbours in both lists."""
    rng = np.random.default_rng(8)
    places = {i: tuple(rng.normal(size=3)) for i in range(30)}
    rows = sorted({(int(s), int(n), bool(w)) for s, n, w in zip(rng.integers(0, 30, 300), rng.integers(0, 30, 300), rng.random(300) < 0.6) if s != n})
    edges = spark.createDataFrame([(i, (i + 1) % 30, float(i % 3)) for i in range(30)] + [(0, 2, 9.0)], "src long, nbr long, distance double")
    for name in ("l2", "cosine"):
        for blocks in (1, 7):
            found = descent.measure_lists(spark.createDataFrame(rows + rows[:20], "src long, nbr long, is_new boolean"), edges, table(spark, places), 1, name, blocks).collect()
            named = {tuple(sorted((n, o))) for s, n, w in rows if w for s2, o, _ in rows if s == s2 and n != o}
            bound = {i: 9.0 if i == 0 else float(i % 3) for i in range(30)}
            d = lambda a, b: float(metric(name).kernel([list(places[a])], [list(places[b])])[0][0])
            want = {(x, y) for a, b in named for x, y in ((a, b), (b, a)) if d(a, b) < bound[x]}
            sent = {(r["src"], r["nbr"]) for r in found if r["src"] is not None}
            nearest_of = {min(((d(x, y), y, x) for x, y in want if x == src))[:0:-1] for src in {x for x, _ in want}}
            assert nearest_of <= sent <= want and (blocks > 1 or sent == nearest_of)  # one a source and block, as k is 1
            assert all(r["distance"] == pytest.approx(d(r["src"], r["nbr"]), abs=1e-6) for r in found if r["src"] is not None)
            assert sum(r["measured"] for r in found) >= len(named) and (blocks > 1 or sum(r["measured"] for r in found) == len(named))


def test_walks_of_queries_from_outside(spark):
    """Entries from the query's cells, and a longer list: clusters that random entries miss are found."""
    places = clusters(6, 60, 8)
    pts = table(spark, {i: v for i, v in places.items() if i % 100})
    q = table(spark, {i: v for i, v in places.items() if i % 100 == 0}, "query_id")
    graph = refine.refine(descent.knn_graph(pts, 8, 1.0, 0.001), pts, 8, undirected=True)
    index = voronoi.build_voronoi(pts, voronoi.select_seeds(pts, 20), 2)
    entries = walk.cell_entries(q, index, 3)
    counts = {r["query_id"]: r["count"] for r in entries.groupBy("query_id").count().collect()}
    assert set(counts) == {i for i in places if i % 100 == 0} and all(1 <= n <= 3 for n in counts.values())
    found = walk.graph_search(q, pts, graph, 8, score_entries=True, entries=entries, pool=24)
    assert found.groupBy("query_id").count().agg(F.max("count")).first()[0] == 8
    assert evaluate.recall(found, nearest.exact_knn(q, pts, 8)).first()["recall"] > 0.9
    with pytest.raises(ValueError):
        walk.graph_search(q, pts, graph, 8, pool=7)


def test_cells_without_a_shuffle(spark, capsys):
    pts = table(spark, clusters(2, 10, 3))
    seeds = spark.createDataFrame([(0, [0.0] * 3), (1, [6.0] * 3)], "cell int, features array<double>")
    voronoi.build_voronoi(pts, seeds, 2).assign.explain()
    assert "MapInArrow" in (plan := capsys.readouterr().out) and "Exchange" not in plan


def test_degenerate_distances(spark):
    pts = table(spark, {0: (0, 0), 1: (1, 0), 2: (0, 0)})
    pairs = spark.createDataFrame([(0, 1), (0, 2)], "a long, b long")
    for name in ("cosine", "jaccard"):
        assert {r["b"]: r["distance"] for r in nearest.pair_distances(pairs, pts, name).collect()} == {1: 1.0, 2: 0.0}
    with pytest.raises(ValueError):
        metric("unknown")
    register_metric("manhattan", lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x), lambda x, y: np.abs(np.asarray(x)[:, None] - np.asarray(y)).sum(-1))
    assert ids(nearest.exact_knn(table(spark, {0: (0, 0, 0)}, "query_id"), table(spark, PLACES), 1, "manhattan")) == {0: [12]}


def test_descent_walk_and_evaluation(spark):
    pts = table(spark, clusters(5, 40, 6)).cache()
    log = descent.DescentLog()
    edges = descent.knn_graph(pts, 8, 1.0, 0.001, log=log).cache()
    truth = nearest.exact_knn_graph(pts, 8)
    as_results = lambda e: e.withColumnRenamed("src", "query_id")
    assert evaluate.recall(as_results(edges), as_results(truth)).first()["recall"] > 0.9
    assert log.updates[-1] < 0.001 * 200 * 8 and len(log.candidates) == len(log.updates) == len(log.measured) == len(log.sent)
    assert all(c >= m >= 0 for c, m in zip(log.candidates, log.measured, strict=True))
    degrees = edges.groupBy("src").count().agg(F.min("count"), F.max("count")).first()
    assert tuple(degrees) == (8, 8) and not edges.where("src = nbr").count()
    graph = refine.refine(edges, pts, 8, undirected=True, multiplier=0).cache()
    flipped = refine.reverse_edges(graph)
    assert graph.select("src", "nbr").exceptAll(flipped.select("src", "nbr")).count() == 0
    queries = pts.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    found = walk.graph_search(queries, pts, graph, 8, score_entries=True)
    exact = nearest.exact_knn(queries, pts, 8)
    assert evaluate.accuracy(found, exact).first()["mean_accuracy"] > 60
    kept = refine.remove_long_paths(edges, pts)
    assert 0 < kept.count() < edges.count() and kept.groupBy("src").count().count() == 200
    assert refine.prune(edges, 8, 0.5).groupBy("src").count().agg(F.max("count")).first()[0] == 4
    grouped = descent.knn_graph(pts, 4, 0.5, 0.1, groups=2, max_rounds=2)
    assert grouped.count() == 800
    with pytest.raises(ValueError):
        descent.knn_graph(pts, 200)


def test_long_paths_by_blocks(spark):
    """Rounds of a few edges give what one fold gives, ties on a grid and edges to nowhere included; a hub of many edges is done in pieces."""
    rng = np.random.default_rng(10)
    for places in ({i: tuple(rng.normal(size=3)) for i in range(40)}, {i: (i % 7, i // 7) for i in range(40)}):
        d = metric("l2").exact(np.array([places[i] for i in range(40)], float)[:, None], np.array([places[i] for i in range(40)], float)[None])
        want = set()
        for src in range(40):
            kept = []
            for n in sorted((n for n in range(40) if n != src), key=lambda n: (d[src, n], n)):
                if not any(d[src, n] > d[r, n] for r in kept):
                    kept.append(n)
            want |= {(src, n) for n in kept}
        edges = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(40) for j in range(40) if i != j] + [(0, 99, 0.1)], "src long, nbr long, distance double")
        pts = table(spark, places).unionByName(spark.createDataFrame([(98, None)], "id long, features array<double>"))
        for block in (5, 1024):
            assert {(r["src"], r["nbr"]) for r in refine.remove_long_paths(edges, pts, block=block).collect()} == want


def test_long_paths_of_a_hub(spark):
    """A star of 50,000 edges, most of them detours: it is folded piece by piece."""
    pts = spark.range(50_001).select("id", F.array(*(F.when(F.col("id") == 0, 0.0).otherwise((F.pmod(F.xxhash64("id", F.lit(i)), F.lit(2001)) - 1000) / 1000.0 + 0.0001) for i in range(2))).alias("features")).cache()
    edges = pts.where("id > 0").select(F.lit(0).cast("long").alias("src"), F.col("id").alias("nbr"), F.sqrt(F.col("features")[0] ** 2 + F.col("features")[1] ** 2).alias("distance"))
    found = [(r["nbr"], r["distance"]) for r in refine.remove_long_paths(edges, pts, block=4096).collect()]
    near = {r["id"]: r["features"] for r in pts.collect()}
    order = sorted(((d, n) for n, d in ((r["nbr"], r["distance"]) for r in edges.collect())))
    kept = []
    for d, n in order:
        if not any(d > np.hypot(near[n][0] - near[r][0], near[n][1] - near[r][1]) for r in kept):
            kept.append(n)
    assert sorted(n for n, _ in found) == sorted(kept) and len(kept) < 100


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 2 3\n\n 4 5 x 6")
    (tmp_path / "b.txt").write_text("7\t8\n9 1e2abc 3\n")
    found = {r["id"]: r["features"] for r in readers.read_points(spark, [str(tmp_path / "b.txt"), str(tmp_path / "a.txt")], "wsv").collect()}
    assert found == {0: [7, 8], 1: [9, 100], 2: [1, 2, 3], 3: [], 4: [4, 5]}
    (tmp_path / "c.csv").write_text("7, 1.5,2\n3,4,5\n")
    assert {r["id"]: r["features"] for r in readers.read_points(spark, str(tmp_path / "c.csv"), "csv-id").collect()} == {7: [1.5, 2], 3: [4, 5]}
    for text in ("1 2\n1 3\n", "5\n", "x 1\n"):
        (tmp_path / "bad.txt").write_text(text)
        with pytest.raises(ValueError):
            readers.read_points(spark, str(tmp_path / "bad.txt"), "wsv-id")
    with pytest.raises(ValueError):
        readers.read_points(spark, str(tmp_path / "c.csv"), "json")
    (tmp_path / "t.tsv").write_text("4\tfour\t1\tbad\t2\t3\n")
    assert readers.read_named_tsv(spark, [str(tmp_path / "t.tsv")], 3).first()["features"] == [1, 2]
    (tmp_path / "truth.txt").write_text("0 1\n2 3")
    assert sorted(map(tuple, readers.read_truth(spark, str(tmp_path / "truth.txt")).collect())) == [(0, 0), (0, 1), (1, 2), (1, 3)]
    assert readers.read_queries(spark, None) is None and readers.read_queries(spark, str(tmp_path / "truth.txt")).count() == 2
    (tmp_path / "list.txt").write_text("x\n\ny\n")
    assert readers.listed_paths(spark, str(tmp_path / "list.txt")) == ["x", "y"]
    wide = spark.createDataFrame([(5, 1, 2, 3)], "index long, col001 int, col000 int, col002 int")
    assert readers.from_wide(wide).first()["features"] == [2, 1, 3]
    assert {r["nbr"] for r in readers.truth_from_wide(wide, 2).collect()} == {2, 1}
    with pytest.raises(ValueError):
        readers.truth_from_wide(wide, 4)
    with pytest.raises(ValueError):
        readers.from_wide([wide, wide.drop("col002")])


def test_a_users_converter(spark, tmp_path):
    """Lines that a Python function converts; those that it doesn't are an error, rows or gone; it serves lateral joins too."""
    (tmp_path / "own.txt").write_text("7=1,2\n8=3,x\n\n9=\n10=4,5\n")

    def convert(line):
        key, _, values = line.partition("=")
        return (int(key), [float(v) for v in values.split(",") if v]) if key else None

    path = [str(tmp_path / "own.txt")]
    assert {r["id"]: r["features"] for r in readers.read_converted(spark, path, convert, bad="drop").collect()} == {7: [1, 2], 10: [4, 5]}
    rows = {r["value"]: (r["id"], r["problem"]) for r in readers.read_converted(spark, path, convert, bad="rows").collect()}
    assert rows["10=4,5"] == (10, None) and rows["8=3,x"][1].startswith("ValueError") and rows["9="] == rows[""] == (None, "no id or no features") and len(rows) == 5
    with pytest.raises(ValueError, match="invalid line"):
        readers.read_converted(spark, path, convert)
    (tmp_path / "twice.txt").write_text("7=1\n7=2\n")
    with pytest.raises(ValueError, match="2 times"):
        readers.read_converted(spark, [str(tmp_path / "twice.txt")], convert)
    with pytest.raises(ValueError):
        readers.read_converted(spark, path, convert, bad="keep")
    logged = spark.createDataFrame([("a", "1=5"), ("b", None)], "source string, line string")
    found = logged.lateralJoin(readers.line_converter(convert)(F.col("line").outer())).collect()
    assert {(r["source"], r["id"], r["problem"]) for r in found} == {("a", 1, None), ("b", None, "no id or no features")}


def test_a_users_function_as_metric(spark):
    register_function_metric("first_gap", lambda x, y: abs(x[0] - y[0]) if x[0] != 2 else None)
    pts = table(spark, {1: (0, 0), 2: (2, 0), 3: (5,), 4: (1, 1)})
    found = nearest.exact_knn(pts.where("id <> 2").withColumnRenamed("id", "query_id"), pts, 2, "first_gap")
    assert ids(found) == {1: [1, 4], 3: [3, 2], 4: [4, 1]}
    pairs = spark.createDataFrame([(1, 3), (2, 3)], "a long, b long")
    assert {r["a"]: r["distance"] for r in nearest.pair_distances(pairs, pts, "first_gap").collect()} == {1: 5.0, 2: None}


def test_numbers_of_many_files(spark, tmp_path, capsys):
    """One scan for all files, in the order given, folders and patterns among them, blocks of a file apart; text isn't shuffled."""
    for i in range(300):
        (tmp_path / f"f{i:03d}.txt").write_text("".join(f"{i} {j}\n" for j in range(i % 4)))
    (tmp_path / "dir with space").mkdir()
    for name in ("b", "a"):
        (tmp_path / "dir with space" / f"{name}.txt").write_text(f"{name}1\n{name}2\n")
    (tmp_path / "long.txt").write_text("".join(f"line {i}\n" for i in range(5000)))
    names = [f"f{i:03d}.txt" for i in reversed(range(300))]
    given = [*(str(tmp_path / n) for n in names), str(tmp_path / "dir with space"), str(tmp_path / "long.txt"), str(tmp_path / "f00[12].txt"), str(tmp_path / "long.txt")]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        df = readers.numbered_lines(spark, given)
        df.explain()
        plan = capsys.readouterr().out
        found = sorted((r["line_number"], r["value"]) for r in df.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    long = [f"line {i}" for i in range(5000)]
    want = [line for n in names for line in (tmp_path / n).read_text().splitlines()] + ["a1", "a2", "b1", "b2", *long]
    assert [n for n, _ in found] == list(range(len(found))) and [v for _, v in found][: len(want)] == want
    assert [v for _, v in found][len(want) :] == ["1 0", "2 0", "2 1", *long]
    assert plan.count("FileScan text") == 1 and "Exchange hashpartitioning" not in plan and "Sort" not in plan
    assert readers.numbered_lines(spark, []).count() == 0


def test_writers_and_store(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.25), (2, 1, 0.5)], "src long, nbr long, distance double")
    writers.dump_index(edges, str(tmp_path / "index"), 1)
    assert [r["value"] for r in readers.numbered_lines(spark, [str(tmp_path / "index")]).orderBy("line_number").collect()] == ["1\t3\t2", "0.0\t0.25\t0.5", "2\t1", "0.0\t0.5"]
    results = edges.withColumnRenamed("src", "query_id")
    writers.dump_results(results, str(tmp_path / "found"), 1)
    writers.dump_results(results.unionByName(results.withColumn("query_id", F.col("query_id") + 10)), str(tmp_path / "parts"), 2)
    assert [line for f in sorted((tmp_path / "parts-neighbors").glob("part-*")) for line in f.read_text().splitlines()] == ["3\t2\t", "1\t", "3\t2\t", "1\t"]
    assert [r["value"] for r in spark.read.text(str(tmp_path / "found-neighbors")).collect()] == ["3\t2\t", "1\t"]
    path = str(tmp_path / "store")
    store = IndexStore.create(spark, path, table(spark, PLACES), edges, metric="l2", k=2)
    with pytest.raises(ValueError):
        IndexStore.create(spark, path, table(spark, PLACES))
    store.replace_edges(edges.where("src = 1"), k=3)
    copy = store.snapshot(f"{path}-2")
    assert IndexStore.remove(spark, path) and not IndexStore.remove(spark, path)
    again = IndexStore.open(spark, copy.path, read_only=True)
    assert again.settings == {"metric": "l2", "k": 3} and again.edges().count() == 2 and again.points().count() == len(PLACES)
    with pytest.raises(ValueError):
        again.replace_edges(edges)
    with pytest.raises(ValueError):
        IndexStore.open(spark, path)


def test_local_graphs_against_brute_force():
    """Graphs reach all their points; walks find nearly all true neighbours while they measure few points, and all with as many in hand."""
    rng = np.random.default_rng(9)
    for name, vectors in (("l2", rng.normal(size=(600, 8))), ("cosine", rng.normal(size=(150, 5))), ("l2", np.repeat(rng.normal(size=(3, 4)), 20, 0)), ("sql2", np.concatenate([rng.normal(size=(40, 3)) + 100 * i for i in range(5)])), ("l2", np.ones((1, 2)))):
        m, n = metric(name), len(vectors)
        graph = local_graph.build_graph(m, np.arange(n) * 7, vectors, 8)
        entry = max(range(n), key=lambda i: len(graph[i]))
        seen, todo = {entry}, [entry]
        while todo:
            new = [c for c in graph[todo.pop()][0] if c not in seen]
            seen.update(new)
            todo += new
        assert len(seen) == n
        queries = rng.normal(size=(20, vectors.shape[1]))
        d = np.asarray(m.kernel(queries, vectors), float)
        for ef in (40, n):
            row, place, dist, measured = local_graph.search_graph(m, vectors, graph, queries, 5, max(5, ef))
            hits = 0
            for i in range(20):
                true = np.sort(d[i])[:5]
                own = dist[row == i]
                assert len(own) == min(5, n) == len(set(place[row == i])) and np.allclose(own, d[i, place[row == i]], atol=1e-6)
                hits += (own <= true[-1] + 1e-6).sum()
                if ef == n:
                    assert np.allclose(own, true, atol=1e-6)
            assert hits >= 0.95 * 20 * min(5, n)
            if n == 600 and ef == 40:
                assert measured.mean() < 0.75 * n


def test_local_graphs_in_cells(spark):
    pts = table(spark, clusters(4, 60, 5)).cache()
    q = pts.where("id % 90 = 0").withColumnRenamed("id", "query_id").unionByName(spark.createDataFrame([(-1, None)], "query_id long, features array<double>"))
    index = voronoi.build_voronoi(pts, voronoi.select_seeds(pts, 5), 2)
    graphs = local_graph.build_local_graphs(index, 6, block_rows=25)
    sizes = {(r["bucket"], r["block"]): r["count"] for r in graphs.blocks.groupBy("bucket", "block").count().collect()}
    assert len(sizes) > 8 and sum(sizes.values()) == 240
    exact, found = index.search(q, 6, hops=1), index.search(q, 6, hops=1, local=graphs, ef=60)
    assert sorted(map(str, found.collect())) == sorted(map(str, exact.collect()))
    assert evaluate.recall(index.search(q, 6, hops=1, local=graphs, ef=8), exact).first()["recall"] > 0.8


def test_voronoi_store(spark, tmp_path, capsys):
    pts = table(spark, clusters(6, 30, 4)).cache()
    q = pts.where("id % 70 = 0").withColumnRenamed("id", "query_id")
    index = voronoi.build_voronoi(pts, voronoi.select_seeds(pts, 12), 3)
    path = str(tmp_path / "cells")
    store = VoronoiStore.create(spark, path, index, shelves=5, name="mine")
    with pytest.raises(ValueError):
        VoronoiStore.create(spark, path, index)
    opened = VoronoiStore.open(spark, path, read_only=True)
    assert opened.settings == {"name": "mine"} and opened.index().size() == 180
    for hops in (0, 2):
        assert sorted(map(str, opened.index().search(q, 5, hops=hops).collect())) == sorted(map(str, index.search(q, 5, hops=hops).collect()))
    some = opened.index()._of_cells(spark.createDataFrame([(1,), (6,), (3,)], "cell int"))
    some.select("id").explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters" in plan and "shelf" in plan.split("PartitionFilters")[1].split("\n")[0]
    files = {f.rpartition("shelf=")[2].split("/")[0] for f in some.inputFiles()} if len(some.inputFiles()) < len(opened.index().assign.inputFiles()) else {"1", "3"}
    assert files <= {"1", "3"} and {r["shelf"] for r in some.select("shelf").distinct().collect()} <= {1, 3}
    with pytest.raises(ValueError):
        opened.insert(pts)
    for again in (pts.limit(1), table(spark, {5: (0, 0, 0, 0)}).unionByName(table(spark, {5: (1, 0, 0, 0)}))):
        with pytest.raises(ValueError, match="is there already"):
            store.insert(again)
    store.insert(table(spark, {5: (0, 0, 0, 0), 15: (1, 1, 1, 1)}))
    store.insert(table(spark, {5: (0, 0, 0, 0)}), part=1)  # the same part again, as after a failure
    assert opened.index().size() == 180 and VoronoiStore.open(spark, path).index().size() == 181
    copy = store.snapshot(f"{path}-2")
    assert VoronoiStore.remove(spark, path) and copy.index().size() == 181 and copy.settings == {"name": "mine"}
    with pytest.raises(ValueError):
        VoronoiStore.open(spark, path)


def test_insertion_from_a_stream(spark, tmp_path):
    """Three batches with repeated ids across them give the index built at once, also when the stream starts anew in between."""
    places = clusters(4, 20, 3)
    pts = table(spark, places).cache()
    seeds = voronoi.select_seeds(pts, 6).cache()
    store, source, state = (str(tmp_path / x) for x in ("store", "in", "state"))
    VoronoiStore.create(spark, store, voronoi.build_voronoi(pts.limit(0), seeds, 2))
    stream = lambda: spark.readStream.schema(pts.schema).option("maxFilesPerTrigger", 1).parquet(source)
    pts.where("id < 300").coalesce(1).write.parquet(source)
    insert_stream(spark, stream(), store, state).awaitTermination()
    for low, high in ((200, 600), (100, 800)):
        pts.where(f"id >= {low} AND id < {high}").unionByName(spark.createDataFrame([(None, [0.0] * 3), (5000, None)], pts.schema)).coalesce(1).write.mode("append").parquet(source)
    query = insert_stream(spark, stream(), store, state)
    query.awaitTermination()
    rows = lambda df: sorted(str((r["id"], r["cell"], r["cells"])) for r in df.collect())
    assert rows(VoronoiStore.open(spark, store).index().assign) == rows(voronoi.build_voronoi(pts, seeds, 2).assign)
    assert sum(int(s["customMetrics"].get("numDroppedDuplicateRows", 0)) for p in query.recentProgress for s in p["stateOperators"]) == 10 + 50


def test_rounds_in_a_streams_state(spark, tmp_path):
    """Queries come in two batches, the second while the first are open; results are those of the batch search, and state ends empty."""
    pts = table(spark, clusters(6, 25, 3)).cache()
    seeds = voronoi.select_seeds(pts, 10).cache()
    built = voronoi.build_voronoi(pts, seeds, 3)
    index = voronoi.VoronoiIndex(seeds, built.assign.cache(), 3)
    q = pts.where("id % 130 = 0").withColumnRenamed("id", "query_id").cache()
    source, path = str(tmp_path / "in"), str(tmp_path / "rounds")
    q.where("query_id < 800").unionByName(spark.createDataFrame([(-1, None)], q.schema)).write.parquet(source)
    for turn in range(4):
        stream = spark.readStream.schema(q.schema).parquet(source)
        query = start_rounds(spark, stream, index, 4, path, hops=1)
        query.awaitTermination()
        if turn == 0:
            q.where("query_id >= 800").write.mode("append").parquet(source)
    found = spark.read.parquet(f"{path}/results").select("query_id", "rank", "nbr", "distance")
    assert sorted(map(str, found.collect())) == sorted(map(str, index.search(q, 4, hops=1).collect()))
    with pytest.raises(ValueError):
        start_rounds(spark, stream, index, 4, path, hops=-1)


def test_stream(spark, tmp_path):
    pts = table(spark, PLACES)
    pts.withColumnRenamed("id", "query_id").write.parquet(str(tmp_path / "in"))
    seen = {}
    source = spark.readStream.schema("query_id long, features array<double>").parquet(str(tmp_path / "in"))
    answer_stream(source, lambda b: nearest.exact_knn(b, pts, 1), lambda r, n: seen.update(ids(r)), str(tmp_path / "state")).awaitTermination()
    assert seen == {i: [i] for i in PLACES}


def test_evaluation_by_hand(spark):
    results = spark.createDataFrame([(0, 1), (0, 2), (1, 5)], "query_id long, nbr long")
    truth = spark.createDataFrame([(0, 2), (0, 2), (1, 5), (2, 1)], "query_id long, nbr long")
    assert tuple(evaluate.accuracy(results, truth).first()) == (50.0, 75.0, 100.0)
    assert evaluate.recall(results, truth).first()["recall"] == pytest.approx(2 / 3)
    assert spark.range(1).select(evaluate.shared(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3)))).first()[0] == 1
