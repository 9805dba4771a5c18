"""What loops to a fixpoint share: one materialised table a round."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all machines share.

    Where spark.checkpoint.dir is unset a temporary folder is set if driver and executors are one process, as in tests; else it is
    an error, as executors don't see the driver's folders.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def materialise(df: DataFrame) -> DataFrame:
    """df, computed once and written as Parquet to the session's shared checkpoint folder, without its lineage.

    The table that is read back has its true size, on which the next round's plan is built; a checkpoint would keep the estimate of the plan
    that made it, and estimates of loops multiply from round to round. The table stays until discard().
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._path = path
    return table


def discard(table: DataFrame) -> None:
    """Deletes the files of a table that materialise() returned and that nothing reads any more."""
    spark, path = table.sparkSession, table._path
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
