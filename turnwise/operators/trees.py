"""A tree of the words that sentences begin with, and how well its counts tell each next word."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.sinks.paths import scratch, written


def word_tree(sentences: DataFrame, thin: int, depth: int) -> DataFrame:
    """(level from 1, node, parent, word, n) of sentences (id, words), ids distinct whole numbers from 0.

    A node stands for the sentences that begin with the same words, n of them, and is named, within its level, by the least of their ids;
    the root's name is -1.  Nodes of fewer than thin sentences have no children, and level depth is the last.  Levels are built one after
    the other: sentences take their node by a join with the level's nodes, and are let go where they end or their node is thin.  Null and
    empty sentences are in no node.
    """
    spark, folder = sentences.sparkSession, scratch(sentences.sparkSession, "tree")
    at = sentences.where(F.size("words") > 0).select("id", F.lit(-1).cast("long").alias("parent"), "words")
    levels = []
    for level in range(1, depth + 1):
        here = at.select("id", "parent", "words", F.get("words", F.lit(level - 1)).alias("word")).where("word is not null")
        nodes = written(here.groupBy("parent", "word").agg(F.min("id").cast("long").alias("node"), F.count(F.lit(1)).alias("n")), f"{folder}/nodes-{level}")
        levels.append(nodes.select(F.lit(level).alias("level"), "node", "parent", "word", "n"))
        wide = nodes.where(F.col("n") >= thin)
        if level == depth or wide.isEmpty():
            break
        at = written(here.join(wide, ["parent", "word"]).select("id", F.col("node").alias("parent"), "words"), f"{folder}/at-{level}")
    return functools.reduce(DataFrame.unionByName, levels)


def tree_loss(tree: DataFrame, sentences: DataFrame) -> DataFrame:
    """(tokens, in_tree, loss): mean loss, in nats, of telling each word of sentences (words) by the tree's counts after the same words, or,
    where the tree has no node for what went before, by how often the word occurs at all.

    Both parts follow from counts: of each word, what the tree doesn't cover is its number less that of its nodes.
    """
    total = tree.groupBy("level", "parent").agg(F.sum("n").alias("_all"))
    known = tree.join(total, ["level", "parent"]).groupBy("word").agg(F.sum("n").alias("covered"), F.sum(F.col("n") * F.log(F.col("n") / F.col("_all"))).alias("s"))
    words = sentences.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    whole = words.agg(F.sum("n").alias("tokens"))  # one row
    each = words.join(known, "word", "left").join(F.broadcast(whole), how="cross")
    rest = F.col("n") - F.coalesce("covered", F.lit(0))
    told = F.sum(F.coalesce("s", F.lit(0.0)) + rest * F.log(F.col("n") / F.col("tokens")))
    return each.agg(F.max("tokens").alias("tokens"), F.coalesce(F.sum("covered"), F.lit(0)).alias("in_tree"), (F.round(-told / F.max("tokens"), 6) + 0.0).alias("loss"))
