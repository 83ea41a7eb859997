"""Written intermediates in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where it is unset, a temporary one, but only if all executors are
    threads of this machine; elsewhere there is no folder that they share, and that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="attestia-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def keep(df: DataFrame, what: str, codec: str = "snappy") -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it again.

    A lost executor loses none of it, and what follows does not compute df twice. The table stays until the folder is
    emptied, as the caller's own plan still reads it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/attestia-{what}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, below: int = 2 << 30) -> DataFrame:
    """df over all cores, if its files are few and small: a file of one row group is one task, however many cores there
    are. Plans beyond so many estimated bytes have splits enough and are left alone, without a shuffle."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if int(str(size)) < below else df


def replace(df: DataFrame, path: str) -> None:
    """Put df in place of the Parquet table at path: written beside it first, then renamed, so that a failure leaves the old
    table, and df may read it."""
    spark = df.sparkSession
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(new)
    place = spark._jvm.org.apache.hadoop.fs.Path
    system = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(place(path)):
        system.rename(place(path), place(old))
    system.rename(place(new), place(path))
    system.delete(place(old), True)
