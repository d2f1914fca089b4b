"""Mixing sources to target weights by Sainte-Laguë apportionment (DataFrame operations only).

Words are dealt as blocks of ``block`` words.  Highest quotients t/(2k-1) give every source a whole number of blocks, and again
every shard of a source; a shard is a seeded share of its source's documents, in seeded order, of about ``shard_words`` words, so
a hot source has more shards and not larger ones.  Of a shard's n blocks, quota q takes each q div n times and q mod n of them
once more, by systematic selection from a seeded start, which needs no list of blocks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import table

WORD = r"[^\x20\x09-\x0D]+"
BLOCK, SHARD_WORDS, SEED = 16, 1 << 21, "mix-1"
WEIGHTS, SHARE = (5, 2, 1), (3, 2)


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): whole texts are counted; null has no words."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def source_targets(sized: DataFrame, weights=WEIGHTS, share=SHARE) -> DataFrame:
    """(source, rank, source_size, target): one row for each source, null last.

    The water level is found in closed form: by ascending cap/weight, a source is capped while its cap lies below its share of what
    the sources before it leave.  All sums are of integers, so the result doesn't depend on their order.
    """
    num, den = share
    by_name, by_ratio, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", "rank"), Window.partitionBy()
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("rank", F.row_number().over(by_name).cast("long"))
    turn = F.pmod(F.col("rank") - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")).cast("long")
    s = s.withColumn("weight", weight).withColumn("cap", 2 * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    s = s.withColumn("total", F.sum("source_size").over(everything)).withColumn("weights", F.sum("weight").over(everything))
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumn("caps", F.sum("cap").over(upto) - F.col("cap")).withColumn("rest", F.col("weights") - F.sum("weight").over(upto) + F.col("weight"))
    level = lambda caps, rest: (num * F.col("total") - den * caps) / (den * rest)
    s = s.withColumn("capped", F.col("ratio") < level(F.col("caps"), F.col("rest")))
    free = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(everything)
    full = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything)
    s = s.withColumn("free", free).withColumn("full", full)
    target = F.when(F.col("capped") | (F.col("free") == 0), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("weight") * level(F.col("full"), F.col("free"))))
    return s.select("source", "rank", "source_size", "total", target.alias("target"))


def sainte_lague(df: DataFrame, group: list[str], order: list[str], weight: Column, total: Column, seats: Column) -> DataFrame:
    """df with quota: seats of each group, dealt to its rows by highest quotients weight/(2k-1); ties go by order.

    Rows get at once what any divisor near total/seats gives them; only the quotients in between, about two a row, are ranked.
    """
    part = Window.partitionBy(*group)
    s = df.withColumn("_w", weight.cast("double")).withColumn("_total", total.cast("double")).withColumn("_seats", seats.cast("long"))
    s = s.withColumn("_n", F.sum((F.col("_w") > 0).cast("long")).over(part))
    near = lambda more: F.floor(F.col("_w") * (F.col("_seats") + more) / F.col("_total") + 0.5).cast("long")
    margin = F.col("_n") / 2 + 1
    s = s.withColumn("_lo", F.when(F.col("_total") > 0, F.greatest(near(-margin), F.lit(0).cast("long"))).otherwise(0))
    s = s.withColumn("_hi", F.when((F.col("_total") > 0) & (F.col("_w") > 0), F.greatest(near(margin), F.col("_lo"))).otherwise(F.col("_lo")))
    s = s.withColumn("_open", F.col("_seats") - F.sum("_lo").over(part))
    keys = list(dict.fromkeys(group + order))
    k = F.explode(F.when(F.col("_hi") > F.col("_lo"), F.sequence(F.col("_lo") + 1, F.col("_hi")))).alias("_k")
    ranked = s.select(*keys, "_w", "_open", k).withColumn("_r", F.row_number().over(part.orderBy((F.col("_w") / (2 * F.col("_k") - 1)).desc(), *order, "_k")))
    won = ranked.where(F.col("_r") <= F.col("_open")).groupBy(*keys).agg(F.count(F.lit(1)).alias("_won"))
    cond = None
    for c in keys:
        one = F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        cond = one if cond is None else cond & one
    joined = s.alias("a").join(won.alias("b"), cond, "left")
    return joined.select(*[F.col(f"a.{c}") for c in df.columns], (F.col("a._lo") + F.coalesce(F.col("b._won"), F.lit(0))).alias("quota"))


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: str = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of docs.

    weights repeat over the sources in code-point order, null last; share is the mix's size as a fraction of all words; no source
    and no document gives more than twice its words.  Null and empty texts have size 0 and give nothing.  Rows that repeat are
    separate documents.  Reruns agree, however the rows are partitioned.  An empty table gives an empty result.
    """
    sized = table(sizes(docs), "sizes")
    src = source_targets(sized, weights, share).withColumn("one", F.lit(1))
    seats = F.expr(f"({share[0]} * total + {share[1] * block // 2}) div {share[1] * block}")
    src = sainte_lague(src, ["one"], ["rank"], F.col("target"), F.lit(share[0]) * F.col("total") / F.lit(share[1]), seats)
    src = table(src.withColumn("shards", F.expr(f"source_size div {shard_words} + 1")).drop("one", "total").withColumnRenamed("quota", "source_quota"), "sources")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    # the sources' table is no larger than the number of sources; AQE broadcasts it or not by its measured size
    rows = sized.withColumn("_key", digest).alias("a").join(src.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "inner")
    rows = rows.select("a.doc_id", "a.size", "_key", "rank", "source_size", "target", "shards", "source_quota")
    rows = rows.withColumn("shard", F.pmod(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long"), F.col("shards")))
    full = rows.where("size > 0")  # others have no place in a shard, however many they are
    per = full.groupBy("rank", "shard").agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("source_quota").alias("source_quota"))
    per = sainte_lague(per, ["rank"], ["shard"], F.col("words"), F.col("source_size"), F.col("source_quota"))
    per = per.withColumn("n", F.expr(f"(words + {block - 1}) div {block}"))
    start = F.md5(F.concat_ws(":", F.lit(seed), "rank", "shard").cast("binary"))
    per = per.withColumn("quota", F.least("quota", 2 * F.col("n"))).withColumn("start", F.conv(F.substring(start, 1, 8), 16, 10).cast("long"))
    per = table(per.select("rank", "shard", "n", "quota", "start"), "shards")
    order = Window.partitionBy("rank", "shard").orderBy(F.substring("_key", 9, 24), "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = full.withColumn("b", F.sum("size").over(order)).join(per, ["rank", "shard"], "inner")
    taken = f"""CASE WHEN size = 0 OR n = 0 THEN 0L ELSE
        (quota div n) * size + CASE WHEN i0 = i1 THEN size * (s(i0 + 1) - s(i0))
        ELSE ((i0 + 1) * {block} - a) * (s(i0 + 1) - s(i0)) + (b - i1 * {block}) * (s(i1 + 1) - s(i1)) + {block} * (s(i1) - s(i0 + 1)) END END"""
    taken = re.sub(r"\bs\((.*?)\)", r"((\1 + start % n) * (quota % n) div n)", taken)
    placed = placed.withColumn("a", F.col("b") - F.col("size")).withColumn("i0", F.expr(f"a div {block}")).withColumn("i1", F.expr(f"(b - 1) div {block}"))
    none = rows.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return placed.select("doc_id", "size", "source_size", "target", F.expr(taken).cast("long").alias("taken")).unionByName(none)
