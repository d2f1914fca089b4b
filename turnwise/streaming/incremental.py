"""Incremental word counts and transitions over files that arrive; an extension for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.functions.text import clean, tokens


def word_counts(turns: DataFrame) -> DataFrame:
    """(token, n), kept up to date; in batch and stream alike."""
    return turns.select(F.explode(tokens(clean(F.col("text")))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def windowed_events(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(start, event_type, n, value) for each window; rows later than late are dropped on a stream."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if e.isStreaming else e
    return e.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def drained(spark: SparkSession, path: str, plan, mode: str, folder: str) -> DataFrame:
    """plan over the Parquet files below path as a stream, run until all are read: its last output, which lies below folder.

    Executors write every batch's output (in complete mode all of it, anew), and the driver holds none.
    """
    schema = spark.read.parquet(path).schema
    result = plan(spark.readStream.schema(schema).parquet(path))
    last: list[int] = []

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/{batch if mode == 'complete' else 'all'}-{batch}")
        last.append(batch)

    result.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    if not last:
        return spark.createDataFrame([], result.schema)
    return spark.read.schema(result.schema).parquet(f"{folder}/{last[-1]}-{last[-1]}" if mode == "complete" else f"{folder}/all-*")
