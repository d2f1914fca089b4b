"""Dialogue corpora by name, each from raw files to split, encoded and sharded pairs with a vocabulary.

A problem says how raw files become turns (:attr:`Problem.parse`) and turns become pairs (:attr:`Problem.pair`); all else is shared.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.functions import text as T
from turnwise.functions.order import row_ordinals
from turnwise.operators import dialogs as D
from turnwise.operators import vocab as V
from turnwise.plans.config import Config
from turnwise.sinks import outputs as O
from turnwise.sinks.paths import done, exists, written
from turnwise.sources import readers as R
from turnwise.sources.archives import archive_lines, download

#: Reserved ids.
PAD, END = 0, 1


class RawFiles:
    """A run's raw texts below raw_dir, each a file or a folder of part files, or where one isn't there, a member of the corpus' archive;
    the lines of each are counted once."""

    def __init__(self, spark: SparkSession, paths: list[str], raw_dir: str = "", archive: str | None = None):
        self.spark, self.paths, self.raw_dir, self.archive = spark, paths, raw_dir, archive
        self._lines: dict[int, DataFrame] = {}

    def _there(self, i: int) -> bool:
        return self.archive is None or exists(self.spark, self.paths[i])

    def lines(self, i: int) -> DataFrame:
        """(file, line_no, value) of a text."""
        if i not in self._lines:
            path = self.paths[i]
            self._lines[i] = R.lines(self.spark, path, whole=True) if self._there(i) else archive_lines(self.spark, self.archive, f"*{path.rpartition('/')[2]}")
        return self._lines[i]

    def tree(self) -> DataFrame:
        """(file, line_no, value) of all files of a folder and of its folders."""
        if self._there(0):
            return R.lines(self.spark, self.paths[0], recursive=True)
        return archive_lines(self.spark, self.archive, f"*{self.paths[0].removeprefix(self.raw_dir.rstrip('/')).lstrip('/')}/*")

    def numbered(self) -> DataFrame:
        """(part, line_no, value) of all texts, one after the other."""
        parts = [self.lines(i).select(F.lit(i).alias("part"), "line_no", "value") for i in range(len(self.paths))]
        return functools.reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class Problem:
    """parse: (spark, files, config, folder) to turns (dialog_no, turn, clean, …); pair: turns to (dialog_no, turn, source, target).

    faults: (spark, files) to the lines that parse leaves out.  counted: which texts of the training split make the vocabulary.  names: name vocabulary, from lines (speaker).
    """

    name: str
    corpus: str
    parse: Callable[[SparkSession, RawFiles, Config, str], DataFrame]
    pair: Callable[[DataFrame], DataFrame] = D.pairs
    counted: str = "utterances"
    zero_based_if_strict: bool = False
    names: bool = False
    character_level: bool = False
    unknown: str = "<unk>"
    version: int = 1
    faults: Callable[[SparkSession, RawFiles], DataFrame] | None = None

    def vocabulary_size(self, c: Config) -> int:
        return 0 if self.character_level else c.vocabulary_size + (c.name_vocabulary_size if self.names else 0)

    def word_block(self, c: Config) -> int:
        """Words and the three reserved tokens.  strict: with names, room for the names is counted among the words, too."""
        return self.vocabulary_size(c) if c.strict else c.vocabulary_size

    def slot_base(self, c: Config) -> int:
        return 0 if self.zero_based_if_strict and c.strict else 1

    def description(self, c: Config) -> dict:
        """What a model must know of the data."""
        size = 256 + 2 if self.character_level else self.vocabulary_size(c)
        sides = ["inputs", "targets"]
        out = {"stop_at_eos": 1, "vocab_type": "character" if self.character_level else "token", "oov_token": self.unknown, "version": self.version}
        out |= {"modality": dict.fromkeys(sides, "symbol"), "vocab_size": dict.fromkeys(sides, size), "loss_multiplier": 2.0 if self.character_level else 1.0}
        if c.packed_length:
            packed = [f"{s}_{x}" for s in sides for x in ("segmentation", "position")]
            out["modality"] |= dict.fromkeys(packed, "identity")
            out["vocab_size"] |= dict.fromkeys(packed, None)
        return out


PROBLEMS: dict[str, Problem] = {}


def register(p: Problem) -> Problem:
    if p.name in PROBLEMS:
        raise ValueError(f"{p.name} is registered already")
    PROBLEMS[p.name] = p
    return p


def named(name: str) -> Problem:
    if name not in PROBLEMS:
        raise ValueError(f"no problem {name}; there are: {', '.join(sorted(PROBLEMS))}")
    return PROBLEMS[name]


# ---- Raw files to turns -----------------------------------------------------------------------------------------------------


def _movie_lines(spark: SparkSession, files: RawFiles, c: Config) -> DataFrame:
    raw = files.lines(0)
    if c.dataset_size:
        raw = raw.where(F.col("line_no") < c.dataset_size + c.strict)
    speaker = F.concat(F.translate("name", " ", "_"), F.lit("_"), "movie_id")
    return R.movie_lines(raw).select("line_id", speaker.alias("speaker"), T.clean(F.col("text")).alias("clean"))


def _movie_turns(spark: SparkSession, files: RawFiles, c: Config, folder: str) -> DataFrame:
    return R.spoken_turns(R.movie_dialogs(files.lines(1)), _movie_lines(spark, files, c))


def _name_vocabulary(lines: DataFrame) -> DataFrame:
    """Names of all lines that are read, by how often; ties by the first line's id."""
    return lines.groupBy(F.col("speaker").alias("token")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.length("line_id"), "line_id")).alias("first"))


def _named_turns(spark: SparkSession, files: RawFiles, c: Config, folder: str) -> DataFrame:
    lines = written(_movie_lines(spark, files, c), f"{folder}/lines")
    names = written(_name_vocabulary(lines), f"{folder}/names")
    kept = V.top(names, c.name_vocabulary_size - 1).select(F.col("token").alias("name"))
    return R.spoken_turns(R.movie_dialogs(files.lines(1)), D.replaced_names(lines, kept))


def _named_pairs(turns: DataFrame) -> DataFrame:
    """Speaker, words and the next speaker; the target is its words.  words: what the vocabulary counts."""
    p = D.movie_pairs(turns)
    return p.select("dialog_no", "turn", F.concat_ws(" ", "speaker", "source", "target_speaker").alias("source"), "target", F.col("source").alias("words"))


def _plain_movie_pairs(turns: DataFrame) -> DataFrame:
    return D.movie_pairs(turns).select("dialog_no", "turn", "source", "target")


def _marked_turns(spark: SparkSession, files: RawFiles, c: Config, folder: str) -> DataFrame:
    t = R.marked_dialogs(files.lines(0)).select("dialog_no", "turn", T.clean(F.col("text")).alias("clean"))
    return D.limited_dialogs(t, c.dataset_size, c.strict) if c.dataset_size else t


def _marked_dialogs(spark: SparkSession, files: RawFiles) -> DataFrame:
    """Lines without an utterance are dialogs, too."""
    return files.lines(0).select(F.col("line_no").alias("dialog_no"))


def _numbered_turns(spark: SparkSession, files: RawFiles, c: Config, folder: str) -> DataFrame:
    t = R.numbered_dialogs(files.numbered(), c.strict, size=c.dataset_size)
    return t.select("dialog_no", "turn", T.clean(F.col("text")).alias("clean"))


def _subtitle_turns(spark: SparkSession, files: RawFiles, c: Config, folder: str) -> DataFrame:
    # a file for each dialog is slow to open, and sentences are told from their lines more than once
    said = R.subtitle_turns(written(files.tree(), f"{folder}/lines"), c.strict)
    # written in order of their paths, files have numbers in that order
    paths = written(said.select("file").distinct().orderBy("file").select("file", F.monotonically_increasing_id().alias("at")), f"{folder}/files")
    numbers = D.ordinals(paths, "at").join(paths, "at").select("file", F.col("ordinal").alias("dialog_no"))
    t = said.join(numbers, "file").select("dialog_no", "turn", T.clean_accents(F.col("text")).alias("clean"))
    return D.limited_dialogs(t, c.dataset_size, c.strict, extra=1) if c.dataset_size else t


def _given(spark: SparkSession, files: RawFiles, c: Config, folder: str) -> DataFrame:
    raise ValueError("pairs are given by split, so there are no turns")


def _movie_faults(spark: SparkSession, files: RawFiles) -> DataFrame:
    return R.movie_line_faults(files.lines(0)).unionByName(R.movie_dialog_faults(files.lines(1)))


def _marked_faults(spark: SparkSession, files: RawFiles) -> DataFrame:
    return R.marked_dialog_faults(files.lines(0))


def _numbered_faults(spark: SparkSession, files: RawFiles) -> DataFrame:
    return R.numbered_dialog_faults(files.numbered())


register(Problem("opensubtitles_chatbot", "opensubtitles", _subtitle_turns))
register(Problem("cornell_chatbot_basic", "cornell", _movie_turns, _plain_movie_pairs, "sources", faults=_movie_faults))
register(Problem("cornell_chatbot_separate_names", "cornell", _named_turns, _named_pairs, "sources", names=True, faults=_movie_faults))
register(Problem("daily_dialog_chatbot", "daily", _marked_turns, faults=_marked_faults))
register(Problem("persona_chat_chatbot", "persona", _numbered_turns, zero_based_if_strict=True, faults=_numbered_faults))
register(Problem("character_chatbot", "pairs", _given, character_level=True))


# ---- Generation -------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Outputs:
    """Where a run's outputs lie."""

    folder: str
    pairs: str
    encoded: str
    vocabulary: str | None


def given_pairs(spark: SparkSession, raw_dir: str) -> DataFrame:
    """(split, dialog_no, turn, source, target) of aligned texts {train,dev,test}{Source,Target}.txt, each
    a file or a folder of part files; a split without them has none."""
    parts = []
    for k, split in enumerate(O.SPLITS):
        paths = [f"{raw_dir}/{split}{side}.txt" for side in ("Source", "Target")]
        if all(exists(spark, p) for p in paths):
            both = R.aligned(*(R.lines(spark, p, whole=True) for p in paths))
            parts.append(both.select(F.lit(split).alias("split"), (F.col("line_no") * len(O.SPLITS) + k).alias("dialog_no"), F.lit(0).alias("turn"), F.col("inputs").alias("source"), F.col("targets").alias("target")))
    if not parts:
        raise FileNotFoundError(f"no pair of {O.SPLITS[0]}Source.txt and {O.SPLITS[0]}Target.txt, or of another split, in {raw_dir}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def generate(spark: SparkSession, problem: str | Problem, raw_dir: str, out_dir: str, config: Config = Config(), url: str | None = None) -> Outputs:
    """All outputs of a problem from the corpus below raw_dir: pairs, six aligned text outputs, vocabulary, encoded shards, the raw
    lines that were left out and why, a record.

    They lie in a folder named by the problem and by its settings.  What is there already is not made again: a run that was cut at any step
    is finished by the next one, and so is one whose outputs have been removed; a mark at the end says that all is done.  Without the
    corpus' files its archive is read as it is, and without that fetched from url.
    """
    p = named(problem) if isinstance(problem, str) else problem
    folder = f"{out_dir.rstrip('/')}/{p.name}-{config.key()}"
    size = p.vocabulary_size(config)
    out = Outputs(folder, f"{folder}/pairs", f"{folder}/encoded", None if p.character_level else O.vocabulary_path(folder, size))
    packed = f"{folder}/packed" if config.packed_length else None
    wanted = [out.pairs, *O.six_paths(folder), out.encoded, *filter(None, (out.vocabulary, packed))]
    if exists(spark, f"{folder}/{O.FINISHED}") and all(done(spark, x) for x in wanted):
        return out
    files = R.corpus_files(p.corpus, raw_dir, config.opensubtitles_year)
    archive = None
    if files and not all(exists(spark, f) for f in files):
        archive = f"{raw_dir.rstrip('/')}/{R.CORPORA[p.corpus]['archive']}"
        if not exists(spark, archive):
            if url is None:
                raise FileNotFoundError(f"neither {files} nor {archive} is there, and no address is given")
            download(url, archive)
    counts: dict[str, int] = {}
    if p.corpus == "pairs":
        routed, turns, splits = given_pairs(spark, raw_dir), None, None
    else:
        files = RawFiles(spark, files, raw_dir, archive)
        turns = written(p.parse(spark, files, config, folder), f"{folder}/turns", counts)
        if p.faults:
            written(p.faults(spark, files), f"{folder}/quarantine", counts)
        # a dialog takes its place in the split whether it has pairs or not
        dialogs = _marked_dialogs(spark, files) if p.corpus == "daily" and not config.dataset_size else turns
        splits = written(D.with_split(dialogs.select("dialog_no").distinct(), dialogs, p.slot_base(config), config.dataset_split), f"{folder}/splits", counts)
        routed = p.pair(turns).join(splits, "dialog_no")
    routed = written(routed, f"{folder}/routed", counts)
    pairs = O.write_pairs(row_ordinals(routed, "dialog_no", "turn").select("split", "ordinal", "dialog_no", "turn", "source", "target"), folder)
    O.export_six(pairs, folder)
    if p.character_level:
        encoded = pairs.select("split", "ordinal", T.byte_ids(F.col("source")).alias("inputs"), T.byte_ids(F.col("target")).alias("targets"))
    else:
        if p.counted == "sources":
            counted = routed.where("split = 'train'").withColumn("words", F.col("words") if "words" in routed.columns else F.col("source"))
        else:
            counted = turns.join(splits.where("split = 'train'"), "dialog_no").withColumn("words", F.col("clean"))
        freq = V.frequencies(counted, "words", ["dialog_no", "turn"])
        names = (spark.read.parquet(f"{folder}/names"), config.name_vocabulary_size) if p.names else (None, 0)
        vocab = O.write_vocabulary(V.vocabulary(freq, p.word_block(config), *names), out.vocabulary)
        encoded = V.encoded(pairs.select("split", "ordinal", "source", "target"), {"inputs": "source", "targets": "target"}, vocab, END).drop("source", "target")
    sharded = O.write_shards(encoded, config.shards, out.encoded)
    if packed:
        O.write_packed(sharded, config.packed_length, packed)
    O.write_record(spark, config, folder, counts=counts)
    O.write_mark(spark, folder)
    return out


def with_changes(config: Config, changes: str) -> Config:
    """config with settings from JSON, such as '{"vocabulary_size": 1000}'."""
    given = json.loads(changes or "{}")
    if unknown := set(given) - set(asdict(config)):
        raise ValueError(f"no settings {sorted(unknown)}")
    return replace(config, **given)
