"""Exact nearest neighbours, block by block; what every exact scan in this library runs on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.functions.metrics import Metric, metric
from vecloom.schema import require_k

#: Queries, and points, of a block: a sixth of a bucket's, within these bounds. A task compares a block of each, but for chance.
BLOCK_ROWS, MOST_ROWS, BLOCK_SHARE = 4096, 131_072, 6
#: Queries and points in hand at once, and pairs that are measured exactly at once.
SOME_QUERIES, SOME_POINTS, SOME_PAIRS = 256, 1024, 1 << 15


def _vectors(column: pa.Array, m: Metric, dtype: type | None = float) -> np.ndarray | list:
    """The vectors as a table if they are of one length, else as lists, where the metric allows for that. Without a dtype numbers stay as they are."""
    lengths = column.value_lengths()
    if len(column) and len(pc.unique(lengths)) == 1 and lengths.null_count == 0:
        return column.flatten().to_numpy(zero_copy_only=False).astype(dtype or column.type.value_type.to_pandas_dtype(), copy=False).reshape(len(column), -1)
    if len(column) and not m.ragged:
        raise ValueError(f"vectors of {pc.min(lengths)} to {pc.max(lengths)} numbers meet, but {m.name} compares those of one length")
    return column.to_pylist()


def paired_distances(m: Metric, x: pa.Array, y: pa.Array) -> pa.Array:
    """Distances of vectors in pairs: null where one is null or holds nulls; ValueError where two differ in length."""
    out, defined = np.full(len(x), np.nan), np.zeros(len(x), bool)
    of_x, of_y = (pc.fill_null(v.value_lengths(), -1).to_numpy() for v in (x, y))
    both = (of_x >= 0) & (of_y >= 0)
    if (of_x[both] != of_y[both]).any():
        raise ValueError(f"vectors of different lengths meet, but {m.name} compares those of one length")
    for n in np.unique(of_x[both]).tolist():
        at = np.flatnonzero(both & (of_x == n))
        a, b = (v.take(pa.array(at)).flatten() for v in (x, y))
        wide = lambda v: v.to_numpy(zero_copy_only=False).astype(float).reshape(len(at), n)  # noqa: E731, B023
        out[at] = m.exact(wide(a), wide(b))
        defined[at] = ~pc.or_(a.is_null(), b.is_null()).to_numpy(zero_copy_only=False).reshape(len(at), n).any(axis=1)
    return pa.array(out, mask=~defined)


def _chosen(features: np.ndarray | list, at: np.ndarray) -> np.ndarray | list:
    return features[at] if isinstance(features, np.ndarray) else [features[i] for i in at]


def _nearest(
    m: Metric, k: int, query_ids: np.ndarray, queries: np.ndarray | list, ids: np.ndarray, points: np.ndarray | list, skip_self: bool = False, bounds: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, distance) of each query's k nearest points, the nearest first; points are ordered by id. Distances that aren't finite don't count.

    Points pass by some at a time: what a query's k-th distance so far doesn't rule out, but for the kernel's rounding, is measured exactly and
    ranked with the k in hand. `bounds`, where given, are distances within which each query has k points, but for rounding.
    """
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    span = _span(m, queries, points)
    tables = isinstance(queries, np.ndarray) and isinstance(points, np.ndarray) and m.factors
    left, right = m.factors(queries, points) if tables else (queries, points)
    for start in range(0, len(query_ids) if len(ids) else 0, SOME_QUERIES):
        own, x = query_ids[start : start + SOME_QUERIES], queries[start : start + SOME_QUERIES]
        limit = np.full(len(own), np.inf) if bounds is None else np.asarray(bounds[start : start + SOME_QUERIES], float) + span
        row, at, near = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for first in range(0, len(ids), SOME_POINTS):
            y = right[first : first + SOME_POINTS]
            d = left[start : start + SOME_QUERIES] @ y.T if tables else np.asarray(m.kernel(x, y), float)
            power = 2 if tables and m.squared else 1
            if not first and d.shape[1] > k + 1:  # one more, as a query may meet itself
                ranked_ = np.partition(np.where(np.isfinite(d), d, np.inf), k, axis=1)[:, k]
                limit = np.minimum(limit, np.maximum(ranked_, 0) ** (1 / power) + 2 * span)
            i, j = np.divmod(np.flatnonzero(d <= (limit**power)[:, None]), d.shape[1])
            if not len(i):
                continue
            value, j = d[i, j], j + first
            if m.exact:
                parts = [slice(c, c + SOME_PAIRS) for c in range(0, len(i), SOME_PAIRS)]
                value = np.concatenate([m.exact(np.asarray(x)[i[c]], np.asarray(points)[j[c]]) for c in parts])
            use = np.isfinite(value)
            if skip_self:
                use &= own[i] != ids[j]
            row, at, near = np.append(row, i[use]), np.append(at, j[use]), np.append(near, value[use])
            order = np.lexsort((at, near, row))
            row, at, near = row[order], at[order], near[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            last = row[place == k - 1], near[place == k - 1]
            row, at, near = (c[place < k] for c in (row, at, near))
            limit[last[0]] = last[1] + span if m.exact else np.nextafter(last[1], -np.inf)  # later points have greater ids
        found.append((own[row], ids[at], near))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _span(m: Metric, queries: np.ndarray | list, points: np.ndarray | list) -> float:
    """More than the kernel's distances are off by rounding."""
    sizes = [float(np.nanmax(np.abs(v[np.isfinite(v).all(axis=1)]), initial=0.0)) * np.sqrt(v.shape[1]) for v in (queries, points) if isinstance(v, np.ndarray) and v.ndim == 2 and v.size]
    return m.rounding(max(sizes, default=1.0))


def _search(m: Metric, k: int, skip_self: bool):
    def run(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        is_query, ids = np.asarray(group.column("is_query")), np.asarray(group.column("id"))
        features = _vectors(group.column("features").combine_chunks(), m)
        q, p = np.flatnonzero(is_query), np.flatnonzero(~is_query)
        p = p[np.argsort(ids[p], kind="stable")]
        query, nbr, distance = _nearest(m, k, ids[q], _chosen(features, q), ids[p], _chosen(features, p), skip_self)
        return pa.table({"bucket": np.full(len(query), bucket, np.int64), "query_id": query, "nbr": nbr, "distance": distance})

    return run


def nearest_in_buckets(queries: DataFrame, points: DataFrame, k: int, metric_name: str | Metric = "l2", skip_self: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(bucket, query_id, nbr, distance): for each query and bucket its k nearest points of that bucket.

    Both sides have a bucket column. A bucket's points and queries are dealt into blocks by the hash of their id, and a
    task compares one block of each, so neither a large bucket nor many queries meet in one task; only k rows a
    query and block leave it. Blocks grow with their bucket from `block_rows` to MOST_ROWS, so a vector is shuffled for some
    BLOCK_SHARE blocks of the other side until these are full. Ties go to the smaller id. Null vectors take no part, and a distance that isn't a finite number,
    as of a vector with a null or NaN, never ranks, so such queries have no rows. Empty tables give none. Repeated ids are as many
    points. Vectors that meet must be of one length unless the metric allows others.
    """
    m = metric(metric_name)
    require_k(k)
    queries, points = queries.where("features IS NOT NULL"), points.where("features IS NOT NULL")
    rows = F.greatest(F.lit(block_rows), F.least(F.lit(max(block_rows, MOST_ROWS)), F.ceil(F.count("*") / BLOCK_SHARE)))
    blocks = lambda df, name: df.groupBy("bucket").agg(F.ceil(F.count("*") / rows).cast("int").alias(name))
    sizes = blocks(points, "of_points").join(blocks(queries, "of_queries"), "bucket")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    p = points.join(sizes, "bucket").select("bucket", own("id", "of_points").alias("p_block"), every("of_queries").alias("q_block"), F.lit(False).alias("is_query"), "id", "features")
    q = queries.join(sizes, "bucket").select("bucket", every("of_points").alias("p_block"), own("query_id", "of_queries").alias("q_block"), F.lit(True).alias("is_query"), F.col("query_id").alias("id"), "features")
    near = p.unionByName(q).groupBy("bucket", "p_block", "q_block").applyInArrow(_search(m, k, skip_self), "bucket long, query_id long, nbr long, distance double")
    best = W.partitionBy("bucket", "query_id").orderBy("distance", "nbr")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")


def ranked(near: DataFrame, k: int) -> DataFrame:
    """results of (query_id, nbr, distance) rows, without repeats: the k first by distance and id."""
    once = near.groupBy("query_id", "nbr").agg(F.min("distance").alias("distance"))
    best = W.partitionBy("query_id").orderBy("distance", "nbr")
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "nbr", "distance")


def exact_knn(queries: DataFrame, points: DataFrame, k: int, metric_name: str | Metric = "l2") -> DataFrame:
    """results: the k nearest points of each query."""
    one = F.lit(0).cast("long").alias("bucket")
    near = nearest_in_buckets(queries.select("query_id", "features", one), points.select("id", "features", one), k, metric_name)
    best = W.partitionBy("query_id").orderBy("distance", "nbr")
    return near.select("query_id", F.row_number().over(best).alias("rank"), "nbr", "distance")


#: Points, and numbers in them, up to which they go to the queries' tasks instead of meeting the queries by a shuffle.
FEW_ROWS, FEW_NUMBERS = 16_384, 8 << 20


def nearest_of_few(rows: DataFrame, points: DataFrame, k: int, metric_name: str | Metric = "l2", key: str = "id", out: str = "near") -> DataFrame:
    """(key, features, out) of the rows: out has the ids of the k nearest points, the nearest first.

    Points up to FEW_ROWS and FEW_NUMBERS go to all tasks, so rows aren't shuffled; more of them are met block by block. Rows
    without a vector, and those from which no distance is finite, are left out.
    """
    m = metric(metric_name)
    require_k(k)
    rows = rows.select(key, "features").where("features IS NOT NULL")
    size = points.agg(F.count("*").alias("rows"), F.sum(F.size("features")).alias("numbers")).first()
    if size["rows"] > FEW_ROWS or (size["numbers"] or 0) > FEW_NUMBERS:
        near = exact_knn(rows.withColumnRenamed(key, "query_id"), points, k, m)
        lists = near.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "nbr"))), lambda x: x["nbr"]).alias(out))
        return rows.join(lists.withColumnRenamed("query_id", key), key).select(key, "features", out)
    few = points.select("id", "features").where("features IS NOT NULL").orderBy("id").toArrow()
    ids, vectors = few.column("id").to_numpy(), _vectors(few.column("features").combine_chunks(), m)
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.arange(batch.num_rows)
            query, nbr, _ = _nearest(m, k, place, _vectors(batch.column("features"), m), ids, vectors)
            counts = np.bincount(query, minlength=len(place))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(nbr, pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=schema.names).filter(pa.array(counts > 0))

    return rows.mapInArrow(run, schema)


def finite(distance: Column) -> Column:
    """Is it a number that can be ranked?"""
    return F.coalesce(distance < float("inf"), F.lit(False))


#: Queries, and points, of a block where every pair is asked for: nine tenths of powers of two, so that what the hash deals has that many bits in a file's dictionary.
PAIR_QUERIES, PAIR_POINTS = 1843, 14_745
#: Blocks of points at least, while these have so many points; pairs that a task has in hand, that it measures at once, and that leave it at once.
PAIR_BLOCKS, LEAST_POINTS, TABLE, MEASURED, SENT = 8, 1024, 1 << 25, 1 << 19, 1 << 16


def _odd(features: Column) -> Column:
    """Is the vector null, or does it hold a null, NaN or infinity?"""
    return F.coalesce(F.exists(features, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))


def _meet(queries: DataFrame, points: DataFrame, n: int, of: int, block_queries: int, block_points: int) -> tuple[DataFrame, DataFrame]:
    """Both sides, of n and `of` rows, with q and p: a row is there once for each block of the other side."""
    many, blocks = max(1, -(-n // block_queries)), max(1, -(-of // block_points), min(PAIR_BLOCKS, of // LEAST_POINTS))
    number = lambda c, size: F.pmod(F.xxhash64(c), F.lit(size)).cast("int")
    q = queries.select("query_id", "features", number("query_id", many).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("p"))
    p = points.select("id", "features", number("id", blocks).alias("p"), F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("q"))
    return q, p


def _every_distance(m: Metric, decimals: int | None):
    """The distances of all of a group's queries from all of its points, some at a time. A distance that isn't defined is null.

    Pairs leave a table in order of distance, equal ones by query and point: what is equal lies side by side, so files of them are small.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(list(batches))
        is_query, ids, features = np.asarray(group.column("is_query")), group.column("id").to_numpy(), _vectors(group.column("features").combine_chunks(), m)
        q, p = np.flatnonzero(is_query), np.flatnonzero(~is_query)
        x, y = _chosen(features, q), _chosen(features, p)
        step = max(1, TABLE // max(1, len(p)))
        for start in range(0, len(q) if len(p) else 0, step):
            own = x[start : start + step]
            for i, j, d in _sorted_table(m, own, y, decimals):
                rows = [pa.array(ids[q[start + i]]), pa.array(ids[p[j]]), pa.array(d, mask=np.isnan(d))]
                yield pa.RecordBatch.from_arrays(rows, names=["query_id", "id", "distance"])

    return run


def _sorted_table(m: Metric, x: np.ndarray | list, y: np.ndarray | list, decimals: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in x, places in y, distances) of all pairs, in order of them, SENT at a time. Rounded distances are sorted as one number with their places."""
    bits = max(1, (len(y) - 1).bit_length())
    free = 62 - bits - max(1, (len(x) - 1).bit_length())
    if decimals is not None:
        rounded, keys, unit = _rounded(m, x, y, decimals), np.empty((len(x), len(y)), np.int64), 10.0**decimals
        step = max(1, MEASURED // len(y))
        for start in range(0, len(x), step):
            d = rounded(start, start + step)
            if np.isinf(d).any() or np.nanmax(d, initial=0) >= 1 << free:
                break
            part = keys[start : start + step]
            part[:] = np.where(np.isnan(d), 1 << free, d)
            part <<= 62 - free - bits
            part |= np.arange(start, start + len(part))[:, None]
            part <<= bits
            part |= np.arange(len(y))
        else:
            keys = keys.ravel()
            keys.sort()
            for first in range(0, len(keys), SENT):
                some = keys[first : first + SENT]
                d = some >> (62 - free)
                yield (some >> bits) & ((1 << (62 - free - bits)) - 1), some & ((1 << bits) - 1), np.where(d == 1 << free, np.nan, d / unit)
            return
    d = np.stack([m.exact(one[None], y) for one in x]) if m.exact else np.asarray(m.kernel(x, y), float)
    d = d.ravel() if decimals is None else _to_decimals(d.ravel(), decimals)
    order = np.argsort(d, kind="stable")
    for first in range(0, len(order), SENT):
        at = order[first : first + SENT]
        yield *np.divmod(at, len(y)), d[at]


def _whole(v: np.ndarray) -> np.ndarray:
    """The nearest whole numbers of numbers from 0 on, halves up."""
    out = np.floor(v)
    out += v - out >= 0.5
    return out


def _to_decimals(d: np.ndarray, decimals: int) -> np.ndarray:
    """Rounded, halves away from 0, as SQL does."""
    unit = 10.0**decimals
    out = np.copysign(_whole(np.abs(d) * unit) / unit, d)
    return np.where(np.isfinite(out), out, d)


def _rounded(m: Metric, x: np.ndarray | list, y: np.ndarray | list, decimals: int):
    """From a range of x the table of its distances from y in units of the last decimal, rounded. One product gives the distances; those that its rounding
    leaves in doubt are measured exactly. What lies below 0 by rounding is 0."""
    unit = 10.0**decimals
    if not (m.factors and m.exact and isinstance(x, np.ndarray) and isinstance(y, np.ndarray)):
        return lambda start, stop: _whole(np.maximum(np.asarray(m.kernel(x[start:stop], y), float) * unit, 0))
    left, right = m.factors(x, y)
    off = (left.shape[1] + 4) * 2.0**-52 * float(np.linalg.norm(left, axis=1).max()) * float(np.linalg.norm(right, axis=1).max())

    def run(start: int, stop: int) -> np.ndarray:
        d = left[start:stop] @ right.T
        if m.squared:
            d = np.sqrt(np.maximum(d, off, out=d), out=d)
            doubt = off * unit / d
        else:
            d = np.maximum(d, 0, out=d)
            doubt = off * unit
        d *= unit
        out = _whole(d)
        i, j = np.nonzero(np.abs(d - out) >= 0.5 - doubt - 4e-16 * d)
        if len(i):
            out[i, j] = np.concatenate([_whole(m.exact(x[start:stop][i[c : c + SOME_PAIRS]], y[j[c : c + SOME_PAIRS]]) * unit) for c in range(0, len(i), SOME_PAIRS)])
        return out

    return run


def every_distance(queries: DataFrame, points: DataFrame, metric_name: str | Metric = "l2", block_queries: int = PAIR_QUERIES, block_points: int = PAIR_POINTS, decimals: int | None = None) -> DataFrame:
    """(query_id, id, distance) of each query with each point, as pair_distances has it; repeated ids are as many rows. With `decimals` distances, which must not be negative then but
    for rounding, are rounded where they are measured, which is several times as fast.

    Vectors meet block by block and a task measures its blocks by the kernel, so pairs are made where they are measured and none is
    shuffled: a vector travels once a block of the other side. Pairs with a vector that is null or holds what isn't a finite number are
    measured by the metric's Column, where the blocks meet. Vectors of unlike lengths are an error unless the metric allows for them.
    """
    m = metric(metric_name)
    sizes = [df.agg(F.count("*").alias("rows"), F.count(F.when(_odd(F.col("features")), 1)).alias("odd")).first() for df in (queries, points)]
    (n, odd_n), (of, odd_of) = ((r["rows"], r["odd"]) for r in sizes)
    plain = lambda df, are_odd: df.where(_odd(F.col("features")) if are_odd else ~_odd(F.col("features")))
    q, p = _meet(plain(queries, False), plain(points, False), n - odd_n, of - odd_of, block_queries, block_points)
    both = q.select("q", "p", F.lit(True).alias("is_query"), F.col("query_id").alias("id"), "features").unionByName(p.select("q", "p", F.lit(False).alias("is_query"), "id", "features"))
    tasks = 2 * -(-n // block_queries) * max(-(-of // block_points), PAIR_BLOCKS)
    found = both.repartition(max(1, tasks), "q", "p").groupBy("q", "p").applyInArrow(_every_distance(m, decimals), "query_id long, id long, distance double")
    rest = [(plain(queries, True), points, odd_n, of)] * bool(odd_n) + [(plain(queries, False), plain(points, True), n - odd_n, odd_of)] * bool(odd_of)
    for some, others, *counts in rest:
        q, p = _meet(some, others, *counts, block_queries, block_points)
        met = q.withColumnRenamed("features", "__x").join(p.withColumnRenamed("features", "__y"), ["q", "p"]).drop("q", "p")
        joined = _measure_joined(met, m)
        found = found.unionByName(joined if decimals is None else joined.withColumn("distance", F.round("distance", decimals)))
    return found


#: Blocks that a graph's points are dealt into, while one has GRAPH_ROWS at least and MOST_ROWS at most, but for chance.
GRAPH_BLOCKS, GRAPH_ROWS = 8, 1024


def graph_blocks(n: int) -> int:
    return max(1, min(GRAPH_BLOCKS, -(-n // GRAPH_ROWS)), -(-n // MOST_ROWS))


def _met(points: DataFrame, blocks: int) -> DataFrame:
    """(low, high, is_low, id, features): a point is there once for each block that its own meets, itself included, so two blocks meet once."""
    own, other = F.col("own"), F.col("other")
    dealt = points.select("id", "features", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    return dealt.select(F.least(own, other).alias("low"), F.greatest(own, other).alias("high"), (own <= other).alias("is_low"), "id", "features")


def _search_both(m: Metric, k: int):
    """The k nearest in the other block of each point of two, or in the block itself where it meets itself."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("id").combine_chunks()
        ids, is_low, features = group.column("id").to_numpy(), np.asarray(group.column("is_low")), _vectors(group.column("features").combine_chunks(), m)
        sides = [(ids[at], _chosen(features, at)) for at in (np.flatnonzero(is_low), np.flatnonzero(~is_low))]
        low, high = sides if group.column("low")[0].as_py() != group.column("high")[0].as_py() else (sides[0], sides[0])
        found = [_nearest(m, k, *a, *b, skip_self=True) for a, b in [(low, high), (high, low)][: 1 + (high is not low)]]
        return pa.table(dict(zip(("src", "nbr", "distance"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    return run


def exact_knn_graph(points: DataFrame, k: int, metric_name: str | Metric = "l2") -> DataFrame:
    """edges from each point to its k nearest others.

    All points meet all others: they are dealt into GRAPH_BLOCKS blocks by the hash of their id, and a task has two blocks, in which it searches both
    ways. So a vector is shuffled GRAPH_BLOCKS times, in single precision if none loses by it, up to GRAPH_BLOCKS * MOST_ROWS points: the shuffle grows with
    the points and the work with their square. It is meant as truth for up to a few million; descent.knn_graph is for more. Null vectors, copies and ties are
    as in nearest_in_buckets.
    """
    m = metric(metric_name)
    require_k(k)
    points = points.where("features IS NOT NULL").select("id", "features")
    size = points.agg(F.count("*").alias("n"), F.count(F.when(F.exists("features", lambda x: x.cast("float").cast("double") != x), 1)).alias("wide")).first()
    narrow = points if size["wide"] else points.withColumn("features", F.col("features").cast("array<float>"))
    near = _met(narrow, graph_blocks(size["n"])).groupBy("low", "high").applyInArrow(_search_both(m, k), "src long, nbr long, distance double")
    best = W.partitionBy("src").orderBy("distance", "nbr")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")


def pair_distances(pairs: DataFrame, points: DataFrame, metric_name: str | Metric = "l2", a: str = "a", b: str = "b", others: DataFrame | None = None) -> DataFrame:
    """The pairs with the distance of their points, those of b among `others` if given; ids travel first, vectors are joined last.

    Metrics that numpy measures in pairs are measured in Arrow batches, others by their Column. The distance is null where a
    vector is null or holds nulls, or where the metric has none; vectors of different lengths are an error unless the metric allows for them.
    Pairs with an unknown id have no rows; repeated ones stay.
    """
    m = metric(metric_name)
    side = lambda df, name, out: df.select(F.col("id").alias(name), F.col("features").alias(out))
    return _measure_joined(pairs.join(side(points, a, "__x"), a).join(side(points if others is None else others, b, "__y"), b), m)


def _measure_joined(joined: DataFrame, m: Metric) -> DataFrame:
    """Rows with two vectors, __x and __y, get their distance in place of them."""
    if m.exact is None:
        return joined.withColumn("distance", m.column(F.col("__x"), F.col("__y"))).drop("__x", "__y")
    names = [c for c in joined.columns if c not in ("__x", "__y")]
    schema = T.StructType([*joined.select(names).schema.fields, T.StructField("distance", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), paired_distances(m, batch.column("__x"), batch.column("__y"))], names=schema.names)

    return joined.mapInArrow(run, schema)


#: Points, and queries, whose vectors a task has in hand at most, but for chance, when it measures some pairs of them.
PART_ROWS = 16_384


def paired_by_parts(pairs: DataFrame, queries: DataFrame, points: DataFrame, metric_name: str | Metric = "l2", n: int | None = None, of: int | None = None) -> DataFrame:
    """(query_id, nbr, distance) of pairs (query_id, nbr), those of finite distance; `n` queries and `of` points are counted unless given.

    Pairs are dealt into parts by both ids. A part gets its pairs as ids and every vector in them once, so a vector travels once a part and
    not once a pair. Metrics that numpy doesn't measure in pairs are left to pair_distances. Ids of queries and of points are unique each.
    """
    m = metric(metric_name)
    if m.exact is None:
        return pair_distances(pairs, queries.withColumnRenamed("query_id", "id"), m, "query_id", "nbr", points).where(finite(F.col("distance"))).select("query_id", "nbr", "distance")
    parts = [max(1, -(-(df.count() if size is None else size) // PART_ROWS)) for df, size in ((queries, n), (points, of))]
    number = F.pmod(F.xxhash64("query_id"), F.lit(parts[0])) * parts[1] + F.pmod(F.xxhash64("nbr"), F.lit(parts[1]))
    dealt = pairs.select(number.cast("int").alias("part"), "query_id", "nbr")
    needed = lambda c, df, key: dealt.select(F.col("part").alias("at"), F.col(c).alias("id")).distinct().join(df.where("features IS NOT NULL").select(F.col(key).alias("id"), "features"), "id")
    about = needed("query_id", queries, "query_id").withColumn("is_query", F.lit(True)).unionByName(needed("nbr", points, "id").withColumn("is_query", F.lit(False)))

    def run(own: pa.Table, about: pa.Table) -> pa.Table:
        about = about.combine_chunks()
        ids, is_query = about.column("id").to_numpy(), np.asarray(about.column("is_query"))
        vectors = _vectors(about.column("features").combine_chunks(), m) if own.num_rows and about.num_rows else np.empty((0, 1))
        ends, known = [], np.ones(own.num_rows, bool)
        for name, mine in (("query_id", is_query), ("nbr", ~is_query)):
            at = np.flatnonzero(mine)
            at = at[np.argsort(ids[at], kind="stable")]
            key = own.column(name).to_numpy()
            place = np.searchsorted(ids[at], key)
            place[place == len(at)] = 0
            known &= ids[at][place] == key if len(at) else False
            ends.append(at[place] if len(at) else place)
        a, b = (c[known] for c in ends)
        d = np.concatenate([np.empty(0), *(m.exact(vectors[a[c : c + SOME_PAIRS]], vectors[b[c : c + SOME_PAIRS]]) for c in range(0, len(a), SOME_PAIRS))])
        return own.select(["query_id", "nbr"]).filter(pa.array(known)).append_column("distance", pa.array(d)).filter(pa.array(np.isfinite(d)))

    return dealt.groupBy("part").cogroup(about.groupBy("at")).applyInArrow(run, "query_id long, nbr long, distance double")
