"""Files by any path that Spark can write to, through Hadoop's file systems."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def done(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written to path to its end."""
    return exists(spark, f"{path}/_SUCCESS")


def write_small(spark: SparkSession, path: str, text: str) -> str:
    """One file of a few lines, written by the driver."""
    fs, p = _at(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
    return path


def removed(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def moved(spark: SparkSession, path: str, to: str) -> None:
    """A written folder under another name, in place of what is there, with the mark that it is whole; without path an empty one."""
    fs, target = _at(spark, to)
    fs.delete(target, True)
    if exists(spark, path):
        fs.rename(_at(spark, path)[1], target)
    else:
        fs.mkdirs(target)
    write_small(spark, f"{to}/_SUCCESS", "")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir, removed at the end; where that is unset, a temporary folder serves local sessions."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="turnwise-")
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/turnwise-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def written(df: DataFrame, path: str, counts: dict[str, int] | None = None) -> DataFrame:
    """df as a Parquet table at path, unless that is there already.  counts gets the number of rows by the table's name, which is counted
    on the way."""
    spark = df.sparkSession
    if not done(spark, path):
        rows = Observation()
        df.observe(rows, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
        if counts is not None:
            counts[path.rpartition("/")[2]] = rows.get["n"]
    return spark.read.schema(df.schema).parquet(path)


def _at_exit() -> None:
    while _made:
        spark, path = _made.pop()
        try:
            fs, p = _at(spark, path)
            fs.delete(p, True)
        except Exception:  # the JVM may already be gone, and then so is every reader
            return


atexit.register(_at_exit)
