"""Tables and files in the folder that the driver and all executors share.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir`` and reading it again, so a lost executor never takes
intermediate rows with it.  Python workers reach the same folder through ``pyarrow.fs`` (local paths, HDFS, object stores).
Everything is removed when the driver's Python ends, or at once by :func:`cleanup`.
"""

from __future__ import annotations

import atexit
import functools
import gc
import re
import tempfile
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI below spark.checkpoint.dir; where that setting is unset, a temporary folder serves a session whose executors
    are threads of the driver (tests), and no other."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="turnwise-")
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/turnwise-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_shared(spark: SparkSession, path: str) -> None:
    """Remove one folder before the session ends, once nothing lazy reads it any more."""
    _delete(spark, path)
    _made[:] = [(s, p) for s, p in _made if p != path]


def cleanup() -> None:
    """Remove every folder made so far; results that are still lazy become unreadable."""
    while _made:
        spark, path = _made.pop()
        if getattr(spark.sparkContext, "_jsc", None) is not None:
            _delete(spark, path)


def _at_exit() -> None:
    try:
        cleanup()
    except Exception:  # the JVM may already be gone, and then so is every reader
        pass


atexit.register(_at_exit)


def table(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again with the same schema."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path, partitionBy=partition_by)
    return spark.read.schema(df.schema).parquet(path)


#: Arrow batches of texts hold about this many bytes; a longer text is a batch of its own.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker and its JVM hold of a table of texts at a time: Spark's own bound is 10,000 rows or 64 MB and more.

    Spark reads the setting when a plan runs, which for a lazy result is after its operator has returned; so it stays set.  A bound
    that the session has set itself stays as it is.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in (None, _default(spark, name)):
        spark.conf.set(name, str(BATCH_BYTES))


@functools.cache
def _default(spark: SparkSession, name: str) -> str | None:
    """A setting's value in a session that has not set it."""
    fresh = spark.newSession().conf
    fresh.unset(name)
    return fresh.get(name, None)


def release(df: DataFrame) -> None:
    """Let Spark remove the shuffle files of finished jobs now.  It does so when the driver's garbage is collected, which may be long
    after the disks are full; with a table written, nothing needs them."""
    for _ in range(2):  # the first finds what Python let go, the second what hung on that; the cleaner works beside
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(0.1)


#: A key with this many rows is joined by broadcast; at most HEAVY_KEYS keys are, which bounds what is sent.
HEAVY_ROWS, HEAVY_KEYS = 2_000, 1_000


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], n: str) -> DataFrame:
    """left LEFT JOIN right on keys, null-safe, where right has one row for each key and n holds the key's rows in left.

    The HEAVY_KEYS most frequent keys are broadcast, so that their rows stay where they are; all others are shuffled.
    """
    heavy = right.where(F.col(n) >= HEAVY_ROWS).orderBy(F.col(n).desc(), *keys).limit(HEAVY_KEYS)
    hot, cold, rest = left.alias("l"), left.alias("l"), right.alias("r")
    on = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    cond = lambda a, b: functools.reduce(lambda x, y: x & y, on(a, b))
    added = [c for c in right.columns if c not in keys]
    out = [F.col(f"l.{c}") for c in left.columns] + [F.col(f"r.{c}") for c in added]
    first = hot.join(F.broadcast(heavy.alias("r")), cond("l", "r"), "inner").select(*out)
    cold = cold.join(F.broadcast(heavy.select(*keys).alias("h")), cond("l", "h"), "left_anti")
    second = cold.join(rest, cond("l", "r"), "left").select(*out)
    return first.unionByName(second)


#: Spark's bitmaps have so many bits; of so many bitmaps of 4 KB the ones of a block of files are sent at once (32 MB).
MAP_BITS, MAPS_SENT = 32_768, 8_192


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def unused(names: list[str], like: str) -> str:
    """like, or like with underscores before it, whichever is no column yet."""
    taken = {n.lower() for n in names}
    while like.lower() in taken:
        like = "_" + like
    return like


def place(docs: DataFrame) -> tuple[Column, Column]:
    """(file, row) of each row of a table read from Parquet files: the hash of the file's path, and the row's number in the file."""
    m = docs.metadataColumn("_metadata")
    return F.xxhash64(m["file_path"]).alias("file"), m["row_index"].alias("row")


def placed(docs: DataFrame, written: bool) -> DataFrame:
    """docs, if it is told to be read from Parquet files as it is, and has places; else docs written and read again."""
    if written:
        try:
            docs.select(*place(docs)).schema
            return docs
        except AnalysisException:  # rows that come from no file
            pass
    return table(docs, "rows")


def rows_in(docs: DataFrame, stays: DataFrame, maps_sent: int = MAPS_SENT) -> DataFrame:
    """The rows of docs, a table read from Parquet files, that stays names by (file, row) of :func:`place`; rows of docs don't move.

    stays becomes one bitmap of 4 KB for each 32,768 rows of a file.  Bitmaps are broadcast, at most maps_sent at once and those of one
    file: where there are more, files are taken in blocks, each read once with its own bitmaps.
    """
    bits = stays.select("file", F.shiftright("row", 15).alias("chunk"), F.col("row").bitwiseAND(F.lit(MAP_BITS - 1)).alias("bit"))
    maps = table(bits.repartition("file", "chunk").groupBy("file", "chunk").agg(F.bitmap_construct_agg("bit").alias("map")), "bitmaps")
    tops: list[int] = []
    if maps.count() > maps_sent:
        files = maps.groupBy("file").agg(F.count(F.lit(1)).alias("n"))  # a row for each file
        upto = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        blocks = files.select("file", F.floor((upto - 1) / maps_sent).alias("block")).groupBy("block").agg(F.max("file").alias("top"))
        tops = [r.top for r in blocks.orderBy("block").collect()][:-1]  # a row for maps_sent bitmaps
    cols = [docs[quoted(c)] for c in docs.columns]
    file, row = place(docs)
    parts = []
    for low, top in zip([None, *tops], [*tops, None], strict=True):
        inside = F.lit(True)
        if low is not None:
            inside = inside & (F.col("file") > low)
        if top is not None:
            inside = inside & (F.col("file") <= top)
        rows = docs.select(F.struct(*cols).alias("d"), file, row).where(inside).withColumn("chunk", F.shiftright("row", 15))
        rows = rows.join(F.broadcast(maps.where(inside)), ["file", "chunk"])
        bit = F.expr(f"bit_get(cast(conv(hex(substring(map, cast((row & {MAP_BITS - 1}) div 8 as int) + 1, 1)), 16, 10) as int), cast(row & 7 as int)) = 1")
        parts.append(rows.where(bit).select("d.*"))
    return functools.reduce(DataFrame.union, parts)
