"""Beam search: the best continuations of each input, word by word, over a table of next words.

A state is the last word said, or, at a response's start, the last word of what it answers.  Costs are negative logarithms in millionths,
whole numbers, so that sums are the same in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from turnwise.functions.text import tokens
from turnwise.sinks.paths import scratch, written

#: What stands before a response: alone, or with the last word of its source (no word has a blank).  What ends it: the empty word.
START, END = ">", ""


def start_of(source: Column) -> Column:
    """The state that a response to source starts from; of a missing source, as of one without words, START."""
    return F.concat_ws(" ", F.lit(START), F.try_element_at(tokens(source), F.lit(-1)))


def next_words(pairs: DataFrame, width: int) -> DataFrame:
    """A written table (state, word, cost) of pairs (source, target): of each state the width likeliest next words, ties by word.

    No hypothesis of a beam of that width ever needs more.  Responses count from their source's last word and from START alone, which is
    for words that no source ends with.  A pair with a missing side is none.
    """
    said = pairs.where("source is not null and target is not null").select(start_of(F.col("source")).alias("start"), tokens(F.col("target")).alias("t"))
    begins = F.array_distinct(F.array("start", F.lit(START)))
    steps = F.flatten(F.array(F.transform(begins, lambda s: F.struct(s.alias("state"), F.coalesce(F.get("t", F.lit(0)), F.lit(END)).alias("word"))), F.transform("t", lambda w, i: F.struct(w.alias("state"), F.coalesce(F.get("t", i + 1), F.lit(END)).alias("word")))))
    counts = said.select(F.explode(steps).alias("x")).groupBy("x.state", "x.word").agg(F.count(F.lit(1)).alias("c"))
    total = F.sum("c").over(Window.partitionBy("state"))
    costs = counts.select("state", "word", F.round(F.log(total / F.col("c")) * 1_000_000).cast("long").alias("cost"))
    rank = F.row_number().over(Window.partitionBy("state").orderBy("cost", "word"))
    return written(costs.withColumn("_rank", rank).where(F.col("_rank") <= width).drop("_rank"), scratch(pairs.sparkSession, "next-words"))


def beam_search(inputs: DataFrame, following: DataFrame, width: int, length: int) -> DataFrame:
    """(input, rank from 1, response, cost, ended): the width best responses of length words at most to inputs (input, start), by following
    (state, word, cost).

    Every step adds a word to each open hypothesis and keeps, of those and of the ended ones, the width least costs; ties go by the
    hypothesis' rank and then by word.  A step is a written table; there are as many as words, or fewer once all have ended.  Inputs whose
    start is no state start from START; without any next words there are no responses.
    """
    spark, folder = inputs.sparkSession, scratch(inputs.sparkSession, "beams")
    known = following.select("state").where(F.col("state").startswith(START)).distinct()
    first = inputs.join(known, F.col("start") == F.col("state"), "left").select("input", F.coalesce("state", F.lit(START)).alias("state"))
    beam = first.select("input", F.lit(1).alias("rank"), F.array().cast("array<string>").alias("said"), "state", F.lit(0).cast("long").alias("cost"), F.lit(False).alias("ended"))
    each = Window.partitionBy("input").orderBy("cost", "before", "word")
    for step in range(length):
        more = beam.where("not ended").withColumnRenamed("cost", "so_far").join(following, "state").select("input", F.col("rank").alias("before"), "said", "word", (F.col("so_far") + F.col("cost")).alias("cost"))
        done = beam.where("ended").select("input", F.col("rank").alias("before"), "said", F.lit(END).alias("word"), "cost")
        best = more.unionByName(done).withColumn("rank", F.row_number().over(each)).where(F.col("rank") <= width)
        over = F.col("word") == END
        best = best.select("input", "rank", F.when(over, F.col("said")).otherwise(F.concat("said", F.array("word"))).alias("said"), F.col("word").alias("state"), "cost", over.alias("ended"))
        seen, path = Observation(), f"{folder}/{step}"
        best.observe(seen, F.count_if(~F.col("ended")).alias("open")).write.parquet(path)
        beam = spark.read.schema(best.schema).parquet(path)
        if not seen.get["open"]:
            break
    return beam.select("input", "rank", F.array_join("said", " ").alias("response"), "cost", "ended")


def answers(pairs: DataFrame, width: int, length: int) -> DataFrame:
    """A written table (state, response, cost): the best response from each state that a response can start from."""
    following = next_words(pairs, width)
    starts = following.select(F.col("state").alias("input")).where(F.col("input").startswith(START)).distinct().withColumn("start", F.col("input"))
    best = beam_search(starts, following, width, length).where("rank = 1").select(F.col("input").alias("state"), "response", "cost")
    return written(best, scratch(pairs.sparkSession, "answers"))


def answered(inputs: DataFrame, answers: DataFrame) -> DataFrame:
    """inputs (source, …), a table or a stream, with their response: one join with :func:`answers`, of START for what is unknown there."""
    otherwise = answers.where(F.col("state") == START).select(F.col("response").alias("_otherwise"))  # one row
    known = answers.select(F.col("state").alias("_state"), F.col("response").alias("_response"))
    joined = inputs.join(known, start_of(F.col("source")) == F.col("_state"), "left").join(F.broadcast(otherwise), how="cross")
    return joined.select(*inputs.columns, F.coalesce("_response", "_otherwise").alias("response"))
