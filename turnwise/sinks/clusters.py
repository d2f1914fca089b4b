"""Clusters and pairs kept in bucketed tables, so that filtering joins them without moving either."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of clusters and pairs that are joined have to be as many.
BUCKETS = 16


def _save(rows: DataFrame, key: str, name: str, path: str, buckets: int) -> None:
    rows.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)


def save_clusters(clusters: DataFrame, name: str, path: str, buckets: int = BUCKETS) -> None:
    """Clusters (utterance, cluster, medoid) as a table of that name, its files at path; an earlier one is replaced."""
    _save(clusters.select("utterance", "cluster", "medoid"), "utterance", name, path, buckets)


def save_pairs(pairs: DataFrame, side: str, name: str, path: str, buckets: int = BUCKETS) -> None:
    """Pairs (source, target, …) in the buckets of one side's utterances."""
    _save(pairs, side, name, path, buckets)


def load_clusters(spark: SparkSession, *names: str) -> DataFrame:
    """(utterance, cluster, medoid) of a saved table, or of several, where a later one's word on an utterance holds."""
    if len(names) == 1:
        return spark.table(names[0])
    parts = [spark.table(n).withColumn("_k", F.lit(k)) for k, n in enumerate(names)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("utterance").agg(F.max_by(F.struct("cluster", "medoid"), "_k").alias("c")).select("utterance", "c.cluster", "c.medoid")


def count_lines(clusters: DataFrame) -> DataFrame:
    """(cluster, n): utterances of each cluster."""
    return clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


def with_side(pairs: DataFrame, clusters: DataFrame, side: str) -> DataFrame:
    """Pairs saved by that side, with its cluster and medoid: tables of the same buckets join where they lie."""
    of = clusters.select(F.col("utterance").alias(side), F.col("cluster").alias(f"{side}_cluster"), F.col("medoid").alias(f"{side}_medoid"))
    return pairs.join(of.hint("merge"), side)
