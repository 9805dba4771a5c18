"""An index kept in a folder: points and edges as Parquet, and what it was made with."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.operators.voronoi import VoronoiIndex, build_voronoi


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _last_settings(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Number and content of the last settings that were written whole; ValueError if there are none."""
    p, fs = _path(spark, f"{path}/settings-*/_SUCCESS")
    done = sorted(str(s.getPath().getParent().getName()) for s in fs.globStatus(p) or [])
    if not done:
        raise ValueError(f"{path} has no index")
    return int(done[-1].rpartition("-")[2]), json.loads(spark.read.text(f"{path}/{done[-1]}").first()["value"])


def _write_settings(spark: SparkSession, path: str, version: int, kept: dict) -> None:
    spark.createDataFrame([(json.dumps(kept),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings-{version:09d}")


class IndexStore:
    """points, edges and settings in any file system that Spark writes to. A half-made store has no settings and can't be opened.

    Edges and settings are written in numbered folders, and the last settings name the edges that hold; so a crash at any
    time leaves the edges of before or those of after.
    """

    def __init__(self, spark: SparkSession, path: str, settings: dict, read_only: bool = False, version: int = 0, graph: str | None = None):
        self.spark, self.path, self.settings, self.read_only, self.version, self.graph = spark, path.rstrip("/"), settings, read_only, version, graph

    @classmethod
    def create(cls, spark: SparkSession, path: str, points: DataFrame, edges: DataFrame | None = None, **settings) -> IndexStore:
        """A new store; ValueError if there is something at the path."""
        p, fs = _path(spark, path)
        if fs.exists(p):
            raise ValueError(f"{path} exists")
        points.write.parquet(f"{path}/points")
        store = cls(spark, path, settings)
        store._settle(edges)
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str, read_only: bool = False) -> IndexStore:
        version, kept = _last_settings(spark, path)
        return cls(spark, path, kept["settings"], read_only, version, kept["edges"])

    def _settle(self, edges: DataFrame | None) -> None:
        version, before = self.version + 1, self.graph
        if edges is not None:
            self.graph = f"edges-{version:09d}"
            edges.write.mode("overwrite").parquet(f"{self.path}/{self.graph}")
        _write_settings(self.spark, self.path, version, {"settings": self.settings, "edges": self.graph})
        self.version = version
        if before not in (None, self.graph):
            p, fs = _path(self.spark, f"{self.path}/{before}")
            fs.delete(p, True)

    def points(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/points")

    def edges(self) -> DataFrame:
        if self.graph is None:
            raise ValueError(f"{self.path} has no edges")
        return self.spark.read.parquet(f"{self.path}/{self.graph}")

    def replace_edges(self, edges: DataFrame, **settings) -> None:
        """Writes new edges beside the old ones, then settings that name them, and then deletes the old ones."""
        if self.read_only:
            raise ValueError("the store is open for reading only")
        self.settings |= settings
        self._settle(edges)

    def snapshot(self, path: str) -> IndexStore:
        return self.copy(self.spark, self.path, path)

    @classmethod
    def copy(cls, spark: SparkSession, source: str, path: str) -> IndexStore:
        """Copies by Spark jobs, so files go from store to store in parallel; ValueError if there is something at the path."""
        store = cls.open(spark, source)
        return cls.create(spark, path, store.points(), store.edges() if store.graph else None, **store.settings)

    @staticmethod
    def remove(spark: SparkSession, path: str) -> bool:
        p, fs = _path(spark, path)
        return bool(fs.exists(p) and fs.delete(p, True))


class VoronoiStore:
    """A Voronoi index in a folder: its seeds, and its points by shelf, cell modulo `shelves`, ordered by cell in each file.

    Points are in numbered parts, and the last settings name those that hold, so an insertion that failed half-way isn't seen and one that
    is repeated under its number replaces itself.
    """

    def __init__(self, spark: SparkSession, path: str, kept: dict, version: int, read_only: bool = False):
        self.spark, self.path, self.kept, self.version, self.read_only = spark, path.rstrip("/"), kept, version, read_only

    @property
    def settings(self) -> dict:
        return self.kept["settings"]

    @classmethod
    def create(cls, spark: SparkSession, path: str, index: VoronoiIndex, shelves: int = 64, **settings) -> VoronoiStore:
        """A new store of an index, which may be empty; ValueError if there is something at the path, or for a metric that has no name."""
        p, fs = _path(spark, path)
        if fs.exists(p):
            raise ValueError(f"{path} exists")
        if not isinstance(index.metric, str) or shelves < 1:
            raise ValueError(f"a store keeps its metric by name and has a shelf at least: {index.metric!r}, {shelves}")
        index.seeds.select("cell", "features").write.parquet(f"{path}/seeds")
        store = cls(spark, path, {"settings": settings, "rank": index.rank, "metric": index.metric, "shelves": shelves, "parts": []}, 0)
        store._add(index.assign, 0)
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str, read_only: bool = False) -> VoronoiStore:
        version, kept = _last_settings(spark, path)
        return cls(spark, path, kept, version, read_only)

    def _add(self, assign: DataFrame, part: int) -> None:
        rows = assign.select("id", "features", "cells", "cell", F.pmod("cell", F.lit(self.kept["shelves"])).cast("int").alias("shelf"))
        rows.repartition("shelf").sortWithinPartitions("shelf", "cell").write.mode("overwrite").partitionBy("shelf").parquet(f"{self.path}/cells/part={part}")
        self.kept = self.kept | {"parts": sorted({*self.kept["parts"], part})}
        self.version += 1
        _write_settings(self.spark, self.path, self.version, self.kept)

    def index(self) -> VoronoiIndex:
        """The index; a search on it reads the shelves that its queries ask, and no others."""
        folder, schema = f"{self.path}/cells", "id long, features array<double>, cells array<int>, cell int, part int, shelf int"
        assign = self.spark.read.schema(schema).option("basePath", folder).parquet(*(f"{folder}/part={n}" for n in self.kept["parts"])).drop("part")
        return VoronoiIndex(self.spark.read.parquet(f"{self.path}/seeds"), assign, self.kept["rank"], self.kept["metric"], self.kept["shelves"])

    def insert(self, points: DataFrame, part: int | None = None, check: bool = True) -> None:
        """Adds points as a part of its own; a part with a number that is there replaces that one, as after a failure.

        With `check`, ValueError if an id is in another part or twice among the points. What was opened before doesn't change.
        """
        if self.read_only:
            raise ValueError("the store is open for reading only")
        part = max(self.kept["parts"], default=-1) + 1 if part is None else part
        index = self.index()
        if check:
            others = self.spark.read.schema("id long, part int").option("basePath", f"{self.path}/cells").parquet(*(f"{self.path}/cells/part={n}" for n in self.kept["parts"])).where(F.col("part") != part)
            taken = points.join(others, "id", "left_semi").select("id").unionByName(points.groupBy("id").count().where("count > 1").select("id")).limit(1).collect()
            if taken:
                raise ValueError(f"id {taken[0]['id']} is there already")
        self._add(build_voronoi(points, index.seeds, index.rank, index.metric).assign, part)

    def snapshot(self, path: str) -> VoronoiStore:
        return self.create(self.spark, path, self.index(), self.kept["shelves"], **self.settings)

    @staticmethod
    def remove(spark: SparkSession, path: str) -> bool:
        return IndexStore.remove(spark, path)
