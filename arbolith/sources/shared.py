"""The folder that all executors share, and intermediate tables there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a folder of our own if all tasks run on this machine, else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="arbolith-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has written to; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    folder, files = _folder(spark, path)
    files.deleteOnExit(folder)
    return path


def stamp(spark: SparkSession, path: str) -> tuple[int, int]:
    """Bytes and latest change of what lies at a path."""
    folder, files = _folder(spark, path)
    found = files.listStatus(folder)
    return sum(f.getLen() for f in found), max((f.getModificationTime() for f in found), default=0)


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it again, which cuts the lineage. The table goes when the driver ends."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(df: DataFrame) -> None:
    """Remove a written table that nothing reads any more."""
    folder, files = _folder(df.sparkSession, df.written_to)
    files.delete(folder, True)
