"""Exact de-duplication: sorted digest runs, merged up a tree (DataFrame operations only).

Every input partition is a run of digests.  In each round the runs whose numbers agree but for their last bits meet (a binomial
exchange of ``2**bits`` partners at once), and a sort-based aggregation merges them into one run that holds, for each digest, the
row that stays and the number of rows.  A run is hash-dealt over all tasks by its digests, so no task holds a whole run, and a
digest that a third of all rows share is one row for each run after the first level.  Equality is verified at every level: the
key is SHA-256 with the byte length and an independent 64-bit hash, so texts that agree in one of them only never merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import place, placed, rows_in, skew_join, table

_KEY = ["digest", "n_bytes", "check"]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def digests(docs: DataFrame, text: Column | None = None, at: Column | None = None) -> DataFrame:
    """(at, run, doc_id, digest, n_bytes, check) of each row, as a written table, so that at names the same row ever after.

    at: what names a row; default: a number.
    """
    body = text_or_empty() if text is None else text
    rows = docs.select(
        (F.monotonically_increasing_id() if at is None else at).alias("at"),
        F.spark_partition_id().cast("long").alias("run"),
        F.col("doc_id"),
        F.unhex(F.sha2(body.cast("binary"), 256)).alias("digest"),
        F.octet_length(body).cast("long").alias("n_bytes"),
        F.xxhash64(body).alias("check"),
    )
    return table(rows, "digests")


def merge_runs(rows: DataFrame, keep: str = "largest", bits: int = 3) -> DataFrame:
    """One row for each distinct text: its key, the row that stays (keep_id, keep_at) and group_size.

    keep: 'largest' or 'smallest' doc_id, of any type that has an order.  Null ids lose against any other.  Of rows that tie, the one
    with the largest (or smallest) at stays.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    pick = F.max if keep == "largest" else F.min
    has = F.col("doc_id").isNotNull() if keep == "largest" else F.col("doc_id").isNull()
    level = rows.select("run", *_KEY, F.struct(has.alias("has"), F.col("doc_id"), F.col("at")).alias("best"), F.lit(1).cast("long").alias("n"))
    top = rows.agg(F.max("run")).first()[0] or 0
    level = level.groupBy("run", *_KEY).agg(pick("best").alias("best"), F.sum("n").alias("n"))
    while top > 0:
        top >>= bits
        level = level.groupBy(F.shiftright("run", bits).alias("run"), *_KEY).agg(pick("best").alias("best"), F.sum("n").alias("n"))
    return level.select(*_KEY, F.col("best.doc_id").alias("keep_id"), F.col("best.at").alias("keep_at"), F.col("n").alias("group_size"))


def mark(docs: DataFrame, keep: str = "largest", text: Column | None = None, bits: int = 3) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of docs.

    Null texts count as empty and are equal to empty ones.  Rows that repeat doc_id and text are copies too: exactly one row of a
    group is kept.  keep_id is null where all rows of a group have no doc_id.  Texts of any length are digested whole.  An empty table
    gives an empty result; other columns of docs are not read.
    """
    rows = digests(docs, text)
    groups = table(merge_runs(rows, keep, bits), "digest-groups")
    out = skew_join(rows, groups, _KEY, "group_size")
    return out.select("doc_id", "keep_id", "group_size", (F.col("at") == F.col("keep_at")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def distinct(docs: DataFrame, keep: str = "largest", written: bool = False) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each group of equal texts exactly one, chosen as :func:`mark` does.

    Null and empty texts are one group.  Digests alone are exchanged: the rows that stay are told by file and row number, and texts
    never move.  written: docs is read from Parquet files as it is; else it is written first, so that rows have such names.
    """
    docs = placed(docs, written)
    rows = digests(docs, at=F.struct(*place(docs)))
    return rows_in(docs, merge_runs(rows, keep).select("keep_at.file", "keep_at.row"))
