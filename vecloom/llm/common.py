"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import time
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, which all machines share.

    Where that is unset a temporary folder is set if driver and executors are one process, as in tests; else it is an error, as
    executors don't see the driver's folders.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever file system it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared checkpoint folder, without its lineage.

    Spark deletes a checkpoint once the driver collects the last reference to it, where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets the driver collect its garbage, whereupon Spark deletes the shuffle files of plans that nothing refers to.

    Spark's cleaner works in the background, and Python's references go first, hence the second turn.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


#: Keys that join_counted broadcasts at most.
HOT_KEYS = 10_000


def join_counted(rows: DataFrame, about: DataFrame, key: str, count: str, how: str = "inner") -> DataFrame:
    """rows joined with `about`, which has one row a key and, as `count`, how many of `rows` have that key; count isn't kept.

    Keys of more than one row in HOT_KEYS, of which there can't be more than HOT_KEYS, meet their rows where these are, by a broadcast, so no
    task gets a key of many rows; the other keys meet them by a shuffle. With how="left" rows without a partner, null keys among them,
    are kept.
    """
    most = (about.agg(F.sum(count)).first()[0] or 0) // HOT_KEYS + 1
    hot, rest = about.where(F.col(count) > most).drop(count), about.where(F.col(count) <= most).drop(count)
    joined = rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").where(F.col(key).isNotNull()).join(rest, key, how))
    return joined if how == "inner" else joined.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many _ after it as it takes to be none of those taken, whatever the case of letters."""
    have, found = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        found.append(name)
    return found


def columns(names: Iterable[str]) -> list[Column]:
    """The columns of these names, which may have dots and other signs."""
    return [F.col(f"`{name.replace('`', '``')}`") for name in names]


def others(keep: Iterable[str], *made: str) -> list[str]:
    """Those of `keep` that no made column replaces, each once."""
    replaced = {name.lower() for name in made}
    return [c for c in dict.fromkeys(keep) if c.lower() not in replaced]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_bytes(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batch whose texts have about `most` bytes, and at most 50,000 rows; a longer text is a slice of its own."""
    sizes = [n or 0 for n in pc.binary_length(batch.column(column)).to_pylist()]
    start = total = 0
    for i, n in enumerate(sizes):
        if (total and total + n > most) or i - start == 50_000:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def fold(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, text: str, key: str, most: int) -> DataFrame:
    """(key, text, label) of labelled documents, about `most` of them if there are more, chosen by the key's hash.

    Of several labels of a key the greatest counts; null keys, labels and texts give no rows. The chosen
    labels, `most` short rows at most but for chance, are broadcast, so only chosen texts are shuffled.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("label"))
    share = min(1.0, most / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text IS NOT NULL")
    return texts.join(F.broadcast(chosen), "key")
