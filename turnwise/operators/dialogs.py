"""Turns to pairs: adjacency, splits, size limits, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions.order import ordinals, range_width, running

#: Targets that are never used; fixed values.
EXCLUDED = ("L211194", "L1045")


def slot_of(ordinal: Column, base: int = 1) -> Column:
    """Cyclic counter of 100 places from base."""
    return F.pmod(ordinal, F.lit(100)) + base


def split_of(slot: Column, split: dict[str, int] | None = None) -> Column:
    s = split or {"train": 80, "val": 10}
    return F.when(slot <= s["train"], "train").when(slot <= s["train"] + s["val"], "dev").otherwise("test")


def pairs(turns: DataFrame, text: str = "clean") -> DataFrame:
    """(dialog_no, turn, source, target): each turn with the next one of its dialog; a missing text is no turn of a pair."""
    nxt = F.lead(text).over(Window.partitionBy("dialog_no").orderBy("turn"))
    return turns.select("dialog_no", "turn", F.trim(text).alias("source"), F.trim(nxt).alias("target")).where("source is not null and target is not null")


def movie_pairs(turns: DataFrame, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """As pairs, but no source equals its dialog's last line id, and no target is excluded."""
    w = Window.partitionBy("dialog_no").orderBy("turn")
    t = turns.select("dialog_no", "turn", "line_id", "last_id", F.trim("clean").alias("source"), F.lead("line_id").over(w).alias("target_id"), F.trim(F.lead("clean").over(w)).alias("target"), "speaker", F.lead("speaker").over(w).alias("target_speaker"))
    return t.where((F.col("line_id") != F.col("last_id")) & ~F.col("target_id").isin(*excluded) & F.col("source").isNotNull() & F.col("target").isNotNull())


def with_split(rows: DataFrame, dialogs: DataFrame, base: int = 1, split: dict[str, int] | None = None, key: str = "dialog_no") -> DataFrame:
    """rows with their dialog's split; dialogs without rows take a slot too."""
    slots = ordinals(dialogs, key).select(key, split_of(slot_of(F.col("ordinal"), base), split).alias("split"))
    return rows.join(slots, key)


def limited_dialogs(turns: DataFrame, n: int, strict: bool = False, extra: int = 0) -> DataFrame:
    """Whole dialogs, in order, until n utterances: strict lets the one that passes n in, else none passes n.  A dialog counts as extra
    more utterances than it has."""
    sizes = turns.groupBy("dialog_no").agg((F.count(F.lit(1)) + extra).alias("n"))
    keep = running(sizes, [], "dialog_no", F.col("n"), "upto", range_width(turns, "dialog_no"))
    keep = keep.where((F.col("upto") - F.col("n") <= n) if strict else (F.col("upto") <= n))
    return turns.join(keep.select("dialog_no"), "dialog_no", "left_semi")


def known_names(names: DataFrame, column: Column, unknown: str) -> tuple[DataFrame, Column]:
    """(names, name column) to join to column, and what to say then; the kept names, whose number is a setting, are broadcast."""
    return F.broadcast(names.select(F.col("name").alias("_name"))), F.coalesce("_name", F.lit(unknown))


def replaced_names(lines: DataFrame, names: DataFrame, unknown: str = "<unk_name>") -> DataFrame:
    """lines (…, speaker, clean) where a speaker outside the kept names is unknown, wherever its name stands as a word in the line.

    The name is compared as it is, not as a pattern; as the first word it is the line's own, and of names in a row, which share their
    space, every second stays.
    """
    known, name = known_names(names, F.col("speaker"), unknown)
    joined = lines.join(known, F.col("speaker") == F.col("_name"), "left")
    spaced = F.concat(F.lit(" "), F.concat_ws(" ", "speaker", "clean"), F.lit(" "))
    said = F.trim(F.replace(spaced, F.concat(F.lit(" "), F.col("speaker"), F.lit(" ")), F.lit(f" {unknown} ")))
    rest = F.substr(said, F.lit(len(unknown) + 2))  # after the line's own name
    clean = F.when(F.col("_name").isNotNull() | F.col("speaker").isNull() | F.col("clean").isNull(), F.col("clean")).otherwise(rest)
    return joined.withColumn("clean", clean).withColumn("speaker", F.when(F.col("speaker").isNotNull(), name)).select(lines.columns)


def named_pairs(pair: DataFrame, names: DataFrame, unknown: str = "<unk_name>") -> DataFrame:
    """Source: speaker, words, target's speaker; names outside the kept ones are unknown.  names: (name), as many as are kept."""
    for column in ("speaker", "target_speaker"):
        known, name = known_names(names, F.col(column), unknown)
        pair = pair.join(known, F.col(column) == F.col("_name"), "left").withColumn(column, name).drop("_name")
    return pair.select("dialog_no", "turn", F.concat_ws(" ", "speaker", "source", "target_speaker").alias("source"), "target")


def random_responses(sources: DataFrame, train: DataFrame, key: str = "ordinal", step: int = 7919, seed: int = 13) -> DataFrame:
    """Each source with a seeded train target: the target whose place is (key * step + seed) mod the number of targets."""
    n = train.agg(F.count(F.lit(1)).alias("n"))
    asked = sources.crossJoin(n).withColumn("pick", F.pmod(F.col(key) * step + seed, F.col("n")))  # n is one row
    return asked.join(train.select(F.col(key).alias("pick"), F.col("target").alias("response")), "pick")
