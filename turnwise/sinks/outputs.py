"""What a run leaves behind.  Tables are Parquet; text outputs are folders of files whose order by name is the lines' order."""

from __future__ import annotations

import json
from dataclasses import asdict
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.operators import vocab as V
from turnwise.plans.config import Config
from turnwise.sinks.paths import done, moved, removed, write_small, written

SPLITS, SIDES = ("train", "dev", "test"), ("source", "target")
#: Examples of a shard, where shards go by size.
SHARD_ROWS = 250_000
#: The file that says that a run has made all its outputs.
FINISHED = "finished"


def write_lines(rows: DataFrame, column: str, order: list[str], path: str) -> None:
    """A text output of one column in the order of others; what is there already stays."""
    if not done(rows.sparkSession, path):
        rows.orderBy(*order).select(F.coalesce(column, F.lit("")).alias("value")).write.mode("overwrite").text(path)


def write_pairs(pairs: DataFrame, folder: str) -> DataFrame:
    """pairs (split, ordinal, source, target, …) as one table, partitioned by split."""
    path = f"{folder}/pairs"
    if not done(pairs.sparkSession, path):
        pairs.write.mode("overwrite").partitionBy("split").parquet(path)
    return pairs.sparkSession.read.schema(pairs.schema).parquet(path).select(pairs.columns)


def six_paths(folder: str) -> list[str]:
    return [f"{folder}/{split}{side.title()}.txt" for split in SPLITS for side in SIDES]


def export_six(pairs: DataFrame, folder: str) -> list[str]:
    """trainSource.txt, trainTarget.txt and so on: of each split, line n of the one text belongs to line n of the other.

    A side's three texts are sorted and written together, by split, and then moved to their names.  Pairs without a split go nowhere.
    """
    spark = pairs.sparkSession
    for side in SIDES:
        paths = {split: f"{folder}/{split}{side.title()}.txt" for split in SPLITS}
        if all(done(spark, p) for p in paths.values()):
            continue
        together = f"{folder}/{side}-texts"
        rows = pairs.where(F.col("split").isin(*SPLITS)).orderBy("split", "ordinal")
        rows.select("split", F.coalesce(side, F.lit("")).alias("value")).write.mode("overwrite").partitionBy("split").text(together)
        for split, path in paths.items():
            moved(spark, f"{together}/split={split}", path)
        removed(spark, together)
    return six_paths(folder)


def vocabulary_path(folder: str, size: int) -> str:
    return f"{folder}/vocab.chatbot.{size}"


def write_vocabulary(vocab: DataFrame, path: str) -> DataFrame:
    """A token a line; its line from 0 is its id.  One file, as a vocabulary has a set size."""
    spark = vocab.sparkSession
    if not done(spark, path):
        vocab.coalesce(1).sortWithinPartitions("id").select("token").write.mode("overwrite").text(path)
    return read_vocabulary(spark, path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(id, token) of a vocabulary's file, or of one like it."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n")).alias("id", "token"))


def write_shards(encoded: DataFrame, shards: dict[str, int], path: str, seed: int = 42) -> DataFrame:
    """encoded (split, ordinal, inputs, targets) dealt in turn over each split's shards, each in a seeded order of its own.

    Shards are sorted together, by ranges, so a large one is several part files, in the order of their names, and no task holds it whole.
    shards: how many a split has; of one that isn't there, as many as keep SHARD_ROWS examples or fewer each.
    """
    spark = encoded.sparkSession
    if not done(spark, path):
        sizes = {r.split: r["n"] for r in encoded.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a split
        shards = {s: -(-n // SHARD_ROWS) for s, n in sizes.items()} | shards
        n = F.coalesce(*[F.when(F.col("split") == s, F.lit(k)) for s, k in shards.items()], F.lit(1))
        rows = encoded.withColumn("shard", F.pmod("ordinal", n).cast("int"))
        rows = rows.orderBy("split", "shard", F.xxhash64(F.lit(seed), "ordinal"), "ordinal")
        rows.write.mode("overwrite").partitionBy("split", "shard").parquet(path)
    return spark.read.parquet(path)


def write_packed(sharded: DataFrame, length: int, path: str) -> DataFrame:
    """Shards' examples put together as long as they fit."""
    rows = sharded.repartition("split", "shard").sortWithinPartitions("split", "shard", F.xxhash64(F.lit(42), "ordinal"), "ordinal")
    return written(V.packed(rows, ["split", "shard"], length), path)


def write_top_tokens(freq: DataFrame, n: int, path: str) -> DataFrame:
    """The n most frequent tokens, a line each; returns (token, n)."""
    best = V.top(freq, n)
    if not done(freq.sparkSession, path):
        best.coalesce(1).sortWithinPartitions(F.desc("n"), "first").select("token").write.mode("overwrite").text(path)
    return best.select("token", "n")


def write_filtered(rows: DataFrame, text: str, stop: list[str], order: list[str], path: str) -> None:
    """Lines without the stop words; a line of nothing else stays as an empty one."""
    write_lines(rows.withColumn("_kept", V.without(F.col(text), stop)), "_kept", order, path)


def write_record(spark: SparkSession, config: Config, folder: str, now: datetime | None = None, counts: dict[str, int] | None = None) -> str:
    """config.<year>.<month>.<day>.<hour>.<minute>.<second>.txt, numbers as they are: the settings of a run, and rows that it has written."""
    t = now or datetime.now()
    stamp = ".".join(str(x) for x in (t.year, t.month, t.day, t.hour, t.minute, t.second))
    return write_small(spark, f"{folder}/config.{stamp}.txt", json.dumps(asdict(config) | {"key": config.key(), "rows": counts or {}}, sort_keys=True, indent=1))


def write_mark(spark: SparkSession, folder: str) -> str:
    return write_small(spark, f"{folder}/{FINISHED}", "")


def write_checkpoint_pointer(spark: SparkSession, folder: str, step: int) -> str:
    return write_small(spark, f"{folder}/checkpoint", f'model_checkpoint_path: "model.ckpt-{step}"')


def write_decoded(decoded: DataFrame, path: str, all_beams: bool = True) -> None:
    """(ordinal, rank, response) as a line for each input: all its beams, parted by tabs, or the best one."""
    beams = F.transform(F.array_sort(F.collect_list(F.struct("rank", "response"))), lambda x: x["response"])  # as many as beams are asked for
    rows = decoded.groupBy("ordinal").agg(beams.alias("beams"))
    write_lines(rows.withColumn("line", F.array_join("beams", "\t") if all_beams else F.get("beams", F.lit(0))), "line", ["ordinal"], path)
