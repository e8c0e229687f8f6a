"""Helpers that the operators share: stored intermediate tables, null-safe columns, names that do not clash."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shuffle files of a query go as soon as the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a local session, where driver and executors are one process, may leave it unset and gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def store(df: DataFrame, name: str, *done: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and lost executors cost nothing.

    done are stored tables that nothing reads from here on; they are deleted.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    for old in done:
        discard(old)
    made = spark.read.schema(df.schema).parquet(path)
    made.stored_at = path
    return made


def discard(stored: DataFrame) -> None:
    """Delete a table that store() wrote."""
    jvm = stored.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(stored.stored_at)
    path.getFileSystem(stored.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def pieces(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into smaller ones, so that what is made of one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def without(df: DataFrame, made: Iterable[str]) -> list[str]:
    """Columns of df that are called like none of made, in any case of letters."""
    taken = {c.lower() for c in made}
    return [c for c in df.columns if c.lower() not in taken]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, wish: str) -> str:
    """wish, or with underscores added while df has such a column."""
    have = {c.lower() for c in df.columns}
    while wish.lower() in have:
        wish += "_"
    return wish
