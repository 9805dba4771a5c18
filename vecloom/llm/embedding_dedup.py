"""Near copies among embeddings: a forest of random-projection trees with spill, verified in leaves and united."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.llm.common import cut, join_counted, table
from vecloom.llm.components import components

THRESHOLD = 0.95
#: Trees at least; deeper forests have as many as keep the expected loss of pairs just at the threshold under MISS.
TREES, MISS = 5, 1e-3
#: Rows of a leaf that the depth aims at.
LEAF_ROWS = 256
#: Vectors, and bytes of them, that the splits are fitted on at most, but for chance; every vector is indexed.
SAMPLE_ROWS, SAMPLE_BYTES = 50_000, 64 << 20
#: Levels with fewer sampled vectors a node than this have one bound for all nodes, their median, so a forest's size is bounded by the sample's.
LEAST_SAMPLE = 16
#: Vectors so near to a split, in units of 1 / sqrt(dimension), go to both sides; no split where half of them would.
SPILL = 0.16
#: Rows of a block; larger leaves are compared block by block.
BLOCK_ROWS = 2048
SEED = 97


@dataclass(frozen=True)
class Tree:
    """One direction a level (as in Hyvonen et al. 2016), one bound a node, or one for a deep level: projections up to it go left.

    An infinite bound doesn't split.
    """

    directions: np.ndarray
    bounds: list[np.ndarray]
    spill: float

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of x and their leaves; a row may be in some leaves."""
        p = x @ self.directions.T
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for level, bounds in enumerate(self.bounds):
            bound = bounds[node] if len(bounds) > 1 else bounds[np.zeros(len(node), int)]
            beyond = p[row, level] - bound
            left, right = beyond <= self.spill, beyond > -self.spill
            right &= np.isfinite(bound)
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
        return row, node


def trees_for(depth: int, threshold: float, least: int = TREES, miss: float = MISS) -> int:
    """Trees of which all part a pair of cosine `threshold` with a chance under `miss`, on directions on which vectors spread alike.

    A split at the middle parts the pair if one end is beyond the spill on the left and the other on the right: with normal
    projections of that correlation, twice the integral of the one's density times the other's tail.
    """
    x = np.linspace(SPILL, 8, 2000)
    spread = math.sqrt(max(1e-9, 1 - threshold * threshold))
    tail = np.array([0.5 * math.erfc((SPILL + threshold * v) / spread / math.sqrt(2)) for v in x])
    parted = 2 * float((np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * tail).sum() * (x[1] - x[0]))
    lost = 1 - (1 - parted) ** depth
    return least if lost <= 0 else max(least, math.ceil(math.log(miss) / math.log(min(lost, 1 - 1e-9))))


def fit_forest(sample: np.ndarray, depth: int, trees: int = TREES, seed: int = SEED) -> list[Tree]:
    """Trees whose splits are medians of the sampled unit vectors' projections."""
    rng, d = np.random.default_rng(seed), sample.shape[1]
    spill, forest = SPILL / np.sqrt(d), []
    for _ in range(trees):
        directions = rng.normal(size=(depth, d))
        directions /= np.linalg.norm(directions, axis=1, keepdims=True)
        p, node, levels = sample @ directions.T, np.zeros(len(sample), np.int64), []
        for level in range(depth):
            own = p[:, level]
            usual = np.median(own)
            usual = usual if np.mean(np.abs(own - usual) <= spill) <= 0.5 else np.inf
            if level and len(sample) < LEAST_SAMPLE << level:
                levels.append(np.array([usual]))
                continue
            bounds = np.full(1 << level, usual)
            order = np.argsort(node, kind="stable")
            cuts = np.flatnonzero(np.diff(node[order])) + 1
            for part in np.split(order, cuts):
                if len(part) >= LEAST_SAMPLE:
                    middle = np.median(own[part])
                    bounds[node[part[0]]] = middle if np.mean(np.abs(own[part] - middle) <= spill) <= 0.5 else np.inf
            levels.append(bounds)
            node = 2 * node + (own > bounds[node])
        forest.append(Tree(directions, levels, spill))
    return forest


def _unit(column: pa.Array, d: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vector, name): name stands for the vector's bytes; null where the vector links with nothing."""
    kind = rows.schema[vector].dataType
    chosen = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    schema = T.StructType([*chosen.schema.fields, T.StructField("name", T.BinaryType())])
    dtype = np.float32 if isinstance(kind.elementType, T.FloatType) else np.float64

    def name(values: list | None) -> bytes | None:
        if not values or None in values:
            return None
        x = np.array(values, dtype)
        with np.errstate(over="ignore", invalid="ignore"):
            norm = np.linalg.norm(x.astype(np.float64))
        return xxhash.xxh3_128_digest((x + 0).tobytes()) if np.isfinite(norm) and norm > 0 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [name(v) for v in batch.column("vector").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.binary())], names=schema.names)

    return chosen.mapInArrow(run, schema)


def _compare(threshold: float, d: int):
    """For a leaf's block or pair of blocks: of each vector its links found here first, and one to its class here."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        node, copies, block = (group.column(c).to_numpy() for c in ("node", "copies", "block"))
        leaf, one_block = group.column("leaf")[0].as_py(), group.column("low")[0].as_py() == group.column("high")[0].as_py()
        x = _unit(group.column("vector").combine_chunks(), d)
        lists = group.column("leaves").combine_chunks()
        ends = np.cumsum(lists.value_lengths().to_numpy())
        rows, codes = np.repeat(np.arange(len(x)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
        order = np.argsort(node)
        x, node, copies, block = x[order], node[order], copies[order], block[order]
        rows = np.argsort(order)[rows]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for start in range(0, len(x), 512):
            i, j = np.nonzero(x[start : start + 512] @ x[start:].T >= threshold)
            i, j = i + start, j + start
            keep = (i < j) & (one_block | (block[i] != block[j]))
            found.append((i[keep], j[keep]))
        links, root = np.zeros(len(x), np.int64), np.arange(len(x))
        linked = np.unique(np.concatenate([p for pair in found for p in pair]))
        place = np.full(len(x), -1)
        place[linked] = np.arange(len(linked))
        earlier = (codes < leaf) & (place[rows] >= 0)
        _, code = np.unique(codes[earlier], return_inverse=True)
        width = int(code.max(initial=-1)) + 1
        for i, j in found:
            if not len(i):
                continue
            together = np.zeros((i[-1] - i[0] + 1, len(linked)), np.float32)
            for low in range(0, width, 1024):  # how many of the leaves before this one have both?
                own = (code >= low) & (code < low + 1024)
                member = np.zeros((len(linked), min(1024, width - low)), np.float32)
                member[place[rows[earlier][own]], code[own] - low] = 1
                block_rows = np.zeros((len(together), member.shape[1]), np.float32)
                inside = place[i[0] : i[-1] + 1]
                block_rows[inside >= 0] = member[inside[inside >= 0]]
                together += block_rows @ member.T
            first = together[i - i[0], place[j]] == 0
            links += np.bincount(i[first], copies[j[first]], minlength=len(x)).astype(np.int64) + np.bincount(j[first], copies[i[first]], minlength=len(x)).astype(np.int64)
        i, j = (np.concatenate(p) for p in zip(*found, strict=True))
        while len(i):
            before = root.copy()
            np.minimum.at(root, j, root[i])
            np.minimum.at(root, i, root[j])
            root = root[root]
            if (root == before).all():
                break
        touched = np.zeros(len(x), bool)
        touched[i] = touched[j] = True
        return pa.table({"node": node[touched], "links": links[touched], "near": node[root][touched]})

    return run


def similar_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, trees: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Equal vectors are indexed once, with their number. Each tree splits by random directions at medians; a vector near
    a split goes to both sides. Inside leaves all vectors are compared in double precision; a pair that is together in
    more than one leaf counts in the first. A leaf of over BLOCK_ROWS rows is compared by pairs of blocks, so no task gets it
    whole. Links are counted and classes found inside the leaf, and no pairs leave it. Vectors that are null, zero, or hold null
    or non-finite components, and rows with null ids, link with nothing and are their own class. Vectors of unlike
    lengths don't link. Repeated rows count as other vectors; an empty table gives an empty one. Ids are whole numbers; others fail.
    Other columns are not read. The number of trees follows from the depth unless given. A vector is in 1.13 leaves a level and tree or
    so, whence the rows of leaves grow somewhat faster than the vectors: the price of finding as many links in larger tables.
    """
    named = usable_vectors(rows, key, vector)
    usable = F.col("name").isNotNull() & F.col("vec_id").isNotNull()
    distinct = cut(named.where(usable).groupBy("name").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.any_value("vector").alias("vector")))
    found = None
    for size in distinct.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).collect():
        one = _links(distinct.where(F.size("vector") == size["d"]), size["n"], size["d"], threshold, trees)
        found = one if found is None else found.unionByName(one)
    named = named.select("vec_id", F.when(usable, F.col("name")).alias("name"))
    if found is None:
        own = named.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    else:
        found = cut(found)
        roots = components(found.where("node <> near").select(F.col("node").alias("a"), F.col("near").alias("b")).distinct())
        counts = found.groupBy("node").agg(F.sum("links").alias("links"))
        about = distinct.select("name", "node", "copies").join(counts, "node", "left").join(roots, "node", "left")
        about = about.select("name", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
        about = about.join(distinct.select("name", F.col("copies").alias("__rows")), "name")
        own = join_counted(named, about, "name", "__rows", how="left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return own.select(F.col("vec_id").alias(key), "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _links(distinct: DataFrame, n: int, d: int, threshold: float, trees: int | None) -> DataFrame:
    most = min(SAMPLE_ROWS, max(1000, SAMPLE_BYTES // (8 * d)))
    picked = distinct.where(F.pmod(F.xxhash64("node", F.lit(SEED)), F.lit(1 << 20)) < int(min(1.0, most / n) * (1 << 20))).select("vector").toArrow()
    depth = max(0, int(np.ceil(np.log2(max(1, n) / LEAF_ROWS))))
    forest = fit_forest(_unit(picked.column("vector").combine_chunks(), d), depth, trees or trees_for(depth, threshold)) if depth and len(picked) else []
    if not forest:
        forest = [Tree(np.zeros((0, d)), [], 0.0)]
    schema = T.StructType([*distinct.select("node", "copies", "vector").schema.fields, T.StructField("leaves", T.ArrayType(T.LongType()))])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(batch.column("vector"), d)
            parts = [(row, leaf + (t << depth)) for t, (row, leaf) in enumerate(tree.leaves(x) for tree in forest)]
            row, leaf = (np.concatenate(p) for p in zip(*parts, strict=True))
            order = np.lexsort((leaf, row))
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(x)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(leaf[order]))], names=schema.names)

    indexed = cut(distinct.select("node", "copies", "vector").mapInArrow(index, schema))
    in_leaves = indexed.select("node", "copies", "vector", "leaves", F.explode("leaves").alias("leaf"))
    sizes = indexed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("rows")).where("rows > 1")
    blocks = F.ceil(F.col("rows") / BLOCK_ROWS).cast("int")
    dealt = in_leaves.join(sizes.select("leaf", blocks.alias("blocks")), "leaf").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("*", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    return paired.select("leaf", "low", "high", "block", "node", "copies", "vector", "leaves").groupBy("leaf", "low", "high").applyInArrow(_compare(threshold, d), "node long, links long, near long")


def op9_embedding_dedup(spark, sf_dir):
    """vec_id, n_links, component_id and kept of every vector; see similar_vectors for nulls, zeros, repeats and empty tables."""
    return similar_vectors(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = f"""
WITH RECURSIVE vectors AS (SELECT row_number() OVER () AS row, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
usable AS (SELECT * FROM vectors WHERE vec_id IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(v, v) > 0),
links AS (SELECT p.row AS a, q.row AS b, q.vec_id AS other FROM usable p JOIN usable q ON p.row <> q.row AND len(p.v) = len(q.v) AND list_inner_product(p.v, q.v) / sqrt(list_inner_product(p.v, p.v)) / sqrt(list_inner_product(q.v, q.v)) >= {THRESHOLD}),
reached AS (SELECT row, row AS found FROM vectors UNION SELECT r.row, b FROM reached r JOIN links ON a = found),
least AS (SELECT reached.row, min(vec_id) AS component_id FROM reached JOIN vectors ON vectors.row = found GROUP BY reached.row),
counts AS (SELECT a AS row, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM vectors JOIN least USING (row) LEFT JOIN counts USING (row)
"""
