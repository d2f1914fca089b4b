"""Raw dialogue formats as ordered turns: (dialog_no, turn, line_id, speaker, text).

Every line keeps its file and its place in it, since a DataFrame has no order of its own.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnwise.functions.order import running
from turnwise.sinks.paths import scratch, written

DELIMITER = r" \+\+\+\$\+\+\+ "


#: Splits of files whose first numbers are sent to all tasks; more of them are joined.
SPLITS_SENT = 100_000


def _placed(batches):
    """Rows (file, _start, …) with _at, the row's place from 0 in its split; a task reads a split's rows one after the other."""
    import pyarrow as pa

    last, after = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        start, file = b.column(1).to_numpy(), b.column(0).dictionary_encode()
        code = file.indices.to_numpy()
        opens = np.concatenate([[True], (start[1:] != start[:-1]) | (code[1:] != code[:-1])])
        first = np.flatnonzero(opens)
        at = np.arange(b.num_rows) - np.repeat(first, np.diff(np.append(first, b.num_rows)))
        name = lambda i: (file.dictionary[int(code[i])].as_py(), int(start[i]))
        if name(0) == last:
            at[: first[1] if len(first) > 1 else b.num_rows] += after
        last, after = name(-1), int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], names=[*b.schema.names, "_at"])


def file_order(file: Column) -> Column:
    """The order of the files of one output: by part number where they have one, however many digits it has, then by path."""
    part = F.regexp_extract(file, r"/part-(\d+)[^/]*$", 1).try_cast("long")
    return F.struct(F.coalesce(part, F.lit(-1)), file)


def lines(spark: SparkSession, path: str | list[str], recursive: bool = False, whole: bool = False) -> DataFrame:
    """(file, line_no from 0, value).  A line's number is its place in its file; whole: in all files of path, one after the other by
    :func:`file_order`, as one text that an output's part files make up.

    Files are read by splits, however long they are.  Splits' lines are counted first; then a line is numbered where it is read, by its
    place in its split after the lines of the splits before.
    """
    raw = spark.read.option("recursiveFileLookup", recursive).text(path)
    m = raw.metadataColumn("_metadata")
    at = [m["file_path"].alias("file"), m["file_block_start"].alias("_start"), m["file_block_length"].alias("_length")]
    keys = ["file", "_start", "_length"]
    before = Window.partitionBy(*([] if whole else ["file"])).orderBy(file_order(F.col("file")), "_start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    counts = raw.select(*at).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    counts = written(counts.select(*keys, "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from")), scratch(spark, "splits"))
    rows = raw.select(*at, "value").mapInArrow(_placed, "file string, _start long, _length long, value string, _at long")
    first = F.broadcast(counts) if counts.count() <= SPLITS_SENT else counts
    # the same splits both times, or no result at all
    known = F.coalesce(F.when(F.col("_at") < F.col("_n"), F.col("_from")), F.raise_error(F.lit("files were split in another way when they were read again")).cast("long"))
    return rows.join(first, keys, "left").select("file", (known + F.col("_at")).alias("line_no"), "value")


def numbered(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(part, line_no, value) of several texts, one after the other, each a file or a folder of part files."""
    parts = [lines(spark, p, whole=True).select(F.lit(i).alias("part"), "line_no", "value") for i, p in enumerate(paths)]
    return functools.reduce(DataFrame.unionByName, parts)


def quarantine(raw: DataFrame, reason: Column) -> DataFrame:
    """(file, line_no, reason, value), as far as raw has them, of the lines that a reader leaves out."""
    return raw.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(*[c for c in ("file", "part", "line_no", "reason", "value") if c in (*raw.columns, "reason")])


def _fields(n: int) -> Column:
    return F.size(F.split("value", DELIMITER, -1)) >= n


def movie_lines(raw: DataFrame) -> DataFrame:
    """(line_id, user_id, movie_id, name, text) of ' +++$+++ ' rows; of a repeated line_id the last stays.  See :func:`movie_line_faults`."""
    f = F.split("value", DELIMITER, -1)
    cols = [f.getItem(i).alias(c) for i, c in enumerate(("line_id", "user_id", "movie_id", "name", "text"))]
    rows = raw.where(_fields(5)).select("line_no", *cols)
    last = F.max_by(F.struct("user_id", "movie_id", "name", "text"), "line_no")
    return rows.groupBy("line_id").agg(last.alias("r")).select("line_id", "r.*")


def movie_line_faults(raw: DataFrame) -> DataFrame:
    """The lines that :func:`movie_lines` leaves out: with too few fields, or whose line_id comes again."""
    short = quarantine(raw, F.when(~_fields(5), "fewer than 5 fields"))
    ids = raw.where(_fields(5)).withColumn("_id", F.split("value", DELIMITER, -1).getItem(0))
    stays = ids.groupBy("_id").agg(F.max("line_no").alias("_last"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    again = ids.join(stays, "_id").where(F.col("line_no") < F.col("_last")).select(raw.columns)
    return short.unionByName(quarantine(again, F.lit("its id comes again")))


def movie_dialogs(raw: DataFrame) -> DataFrame:
    """(dialog_no, line_ids) from the fourth field's list of ids.  See :func:`movie_dialog_faults`."""
    ids = F.transform(F.split(F.split("value", DELIMITER, -1).getItem(3), ","), lambda x: F.regexp_replace(x, "[^A-Z0-9]", ""))
    return raw.where(_fields(4)).select(F.col("line_no").cast("long").alias("dialog_no"), ids.alias("line_ids"))


def movie_dialog_faults(raw: DataFrame) -> DataFrame:
    """The lines that :func:`movie_dialogs` leaves out."""
    return quarantine(raw, F.when(~_fields(4), "fewer than 4 fields"))


def spoken_turns(dialogs: DataFrame, lines: DataFrame) -> DataFrame:
    """One join of dialogs' ids with lines (line_id, …); a missing line keeps its place with nulls, so no gap is bridged."""
    turns = dialogs.select("dialog_no", F.posexplode("line_ids").alias("turn", "line_id"), F.element_at("line_ids", -1).alias("last_id"))
    return turns.join(lines, "line_id", "left").select("dialog_no", "turn", "line_id", "last_id", *[c for c in lines.columns if c != "line_id"])


def movie_turns(spoken: DataFrame, dialogs: DataFrame) -> DataFrame:
    """(dialog_no, turn, line_id, last_id, speaker, text) of the movie corpus; speakers are named by name and movie."""
    speaker = F.concat(F.translate("name", " ", "_"), F.lit("_"), F.col("movie_id")).alias("speaker")
    return spoken_turns(dialogs, spoken.select("line_id", speaker, "text"))


def marked_dialogs(raw: DataFrame, marker: str = "__eou__") -> DataFrame:
    """One dialog a line, the marker after each utterance; what follows the last marker is dropped."""
    parts = F.split("value", marker, -1)
    utterances = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return raw.select(F.col("line_no").cast("long").alias("dialog_no"), F.posexplode(utterances).alias("turn", "text"))


def marked_dialog_faults(raw: DataFrame, marker: str = "__eou__") -> DataFrame:
    """The lines of which :func:`marked_dialogs` has no utterance."""
    return quarantine(raw, F.when(~F.contains(F.col("value"), F.lit(marker)), f"no {marker}"))


def numbered_dialog_faults(raw: DataFrame, silence: str = "__SILENCE__") -> DataFrame:
    """The lines that :func:`numbered_dialogs` leaves out, a silence and what follows it in its dialog among them."""
    short = F.size(F.split("value", "\t", -1)) < 2
    kept = numbered_dialogs(raw, silence=silence, places=True).select("part", "line_no")
    silent = raw.where(~short).join(kept, ["part", "line_no"], "left_anti").select(raw.columns)
    return quarantine(raw, F.when(short, "no tab")).unionByName(quarantine(silent, F.lit("silence")))


def numbered_dialogs(raw: DataFrame, strict: bool = False, silence: str = "__SILENCE__", size: int = 0, places: bool = False) -> DataFrame:
    """'<n> source<TAB>target' lines, where n = 1 starts a dialog; a dialog keeps what precedes its first silence.

    strict: the last dialog that keeps anything is lost.  Dialogs run on over the files' parts in order.  size: so many lines are kept
    at most, strict: one more; 0: all.  places: with the line's part and line_no.
    """
    cols = F.split("value", "\t", -1)
    rows = raw.where(F.size(cols) >= 2).select("part", "line_no", F.regexp_extract("value", r"^\s*(\d+)", 1).cast("int").alias("n"), F.regexp_replace(cols.getItem(0), r"^\s*\d+\s*", "").alias("source"), cols.getItem(1).alias("target"), F.instr("value", silence).alias("mute"))
    rows = running(rows, ["part"], "line_no", F.coalesce((F.col("n") == 1).cast("long"), F.lit(0)), "k")
    starts = rows.groupBy("part").agg(F.max("k").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.join(F.broadcast(starts.select("part", "before")), "part").withColumn("dialog_no", F.col("k") + F.coalesce("before", F.lit(0)) - 1)  # a row for each file
    dialog = Window.partitionBy("dialog_no").orderBy("part", "line_no")
    rows = rows.withColumn("muted", F.max(F.col("mute") > 0).over(dialog)).where("not muted").withColumn("at", F.row_number().over(dialog) - 1)
    if size:
        rows = running(rows, ["part"], "line_no", F.lit(1), "kept")
        per = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n_kept")).withColumn("kept_before", F.sum("n_kept").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
        rows = rows.join(F.broadcast(per.select("part", "kept_before")), "part").where(F.col("kept") + F.coalesce("kept_before", F.lit(0)) <= size + strict)
    if strict:
        rows = rows.join(rows.agg(F.max("dialog_no").alias("lost")), F.col("dialog_no") < F.col("lost"), "left_semi")
    if places:
        return rows.select("dialog_no", "part", "line_no", "source", "target")
    return rows.select("dialog_no", F.posexplode(F.array("source", "target")).alias("side", "text"), "at").select("dialog_no", (2 * F.col("at") + F.col("side")).alias("turn"), "text")


def subtitle_sentences(raw: DataFrame) -> DataFrame:
    """(file, sentence, text, n_words) of lines (file, line_no, value): '<s id=' opens a sentence, '<w id=' holds a word; sentence 0 is
    what precedes the first.  Words of a line that opens a sentence don't count."""
    rows = raw.withColumn("opens", F.col("value").contains("<s id=").cast("int"))
    rows = running(rows, ["file"], "line_no", F.col("opens"), "sentence").withColumn("word", F.when(F.col("value").contains("<w id=") & (F.col("opens") == 0), F.translate(F.regexp_extract("value", '<w id="[^>]*>(.*?)</w', 1), "\t", " ")))
    words = F.array_sort(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("line_no", "word"))))  # a sentence's
    said = rows.groupBy("file", "sentence").agg(words.alias("words"))
    return said.select("file", "sentence", F.array_join(F.transform("words", lambda x: x["word"]), " ").alias("text"), F.size("words").alias("n_words"))


def subtitle_turns(raw: DataFrame, strict: bool = False) -> DataFrame:
    """(file, turn, text) of XML with an element a line; a file is a dialog.

    strict: what precedes the first sentence is an empty utterance and the last sentence is lost; else blanks are dropped.
    """
    per = Window.partitionBy("file")
    if strict:  # what precedes the first sentence is there even where no line does
        raw = raw.select("file", "line_no", "value").unionByName(raw.select("file").distinct().select("file", F.lit(-1).cast("long").alias("line_no"), F.lit("").alias("value")))
        said = subtitle_sentences(raw).withColumn("last", F.max("sentence").over(per)).where("sentence < last")
    else:
        said = subtitle_sentences(raw).where("trim(text) <> ''")
    return said.select("file", (F.row_number().over(per.orderBy("sentence")) - 1).alias("turn"), "text")


def aligned(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of two line-aligned texts, as far as the shorter goes; line_no numbers a whole text, over all its part files."""
    a, b = left.select("line_no", F.trim("value").alias("inputs")), right.select("line_no", F.trim("value").alias("targets"))
    return a.join(b, "line_no")


def word_list(raw: DataFrame) -> DataFrame:
    """Distinct trimmed lines."""
    return raw.select(F.trim("value").alias("token")).distinct()


def input_file(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, source): utterances to answer, one a line."""
    return lines(spark, path, whole=True).select(F.col("line_no").alias("ordinal"), F.col("value").alias("source"))


def typed_lines(spark: SparkSession, typed: Iterable[str]) -> DataFrame:
    """(ordinal, source): what has been typed, such as sys.stdin, until an empty line."""
    rows = []
    for line in typed:
        if not line.strip():
            break
        rows.append((len(rows), line.rstrip("\n")))
    return spark.createDataFrame(rows, "ordinal long, source string")


def arriving_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(source) as a stream: lines of the text files that arrive in a folder."""
    return spark.readStream.schema("value string").text(folder).select(F.col("value").alias("source"))


def random_sample(rows: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """n rows, chosen by a seeded hash of their keys: the same ones whatever the partitions."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)


#: What each corpus is called, the files it is read from below its raw folder, and its archive.
CORPORA = {
    "opensubtitles": {"files": ["OpenSubtitles/xml/en{year}"], "archive": "en.tar.gz"},
    "cornell": {"files": ["movie_lines.txt", "movie_conversations.txt"], "archive": "cornell_movie_dialogs_corpus.zip"},
    "daily": {"files": ["dialogues_text.txt"], "archive": "ijcnlp_dailydialog.zip"},
    "persona": {"files": ["train_none_original_no_cands.txt", "valid_none_original_no_cands.txt"], "archive": "personachat.tgz"},
    "pairs": {"files": [], "archive": ""},
}


def corpus_files(corpus: str, raw_dir: str, year: int | None = None) -> list[str]:
    """Paths of a corpus' files below raw_dir; the corpus of 2009 has no year in its path."""
    return [f"{raw_dir}/{f.format(year='' if year in (None, 2009) else f'/{year}')}" for f in CORPORA[corpus]["files"]]
