"""Stored intermediate tables: lineage is cut in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A table of at least SMALL bytes that has less than PER_CORE bytes for each core is dealt over all cores: it may be one file of one row group.
SMALL, PER_CORE = 4 << 20, 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session, where driver and executors are one process, may leave it unset and gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def store(df: DataFrame, name: str, *done: DataFrame) -> DataFrame:
    """Write df and read it back; done are stored tables that nothing reads from here on, which are deleted."""
    path = f"{shared_dir(df.sparkSession)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for old in done:
        _path(df.sparkSession, old.stored_at, lambda files, at: files.delete(at, True))
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.stored_at = path
    return made


def _path(spark: SparkSession, path: str, f):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return f(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    df, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    size = _path(spark, path, lambda files, at: files.getContentSummary(at).getLength())
    return df.repartition(cores) if SMALL <= size < cores * PER_CORE else df
