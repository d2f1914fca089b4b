"""Modes of a run: generate_data, decode, experiment; training of neural models is outside this engine."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.functions.order import ordinals
from turnwise.operators import beams as B
from turnwise.operators import dialogs as D
from turnwise.operators import metrics as M
from turnwise.plans import config as C
from turnwise.plans import problems as P
from turnwise.sinks import outputs as O
from turnwise.sinks import progress
from turnwise.sources import readers as R

#: How the inputs to answer are given.
DECODE_MODES = ("interactive", "file", "dataset")


def train_responses(pairs: DataFrame, inputs: DataFrame, beams: int) -> DataFrame:
    """(ordinal, response, score): to each input (ordinal, source) as many training targets as beams, by a seeded draw.  A baseline; whatever gives rows of this form for (pairs, inputs, beams) can take its place."""
    train = pairs.where("split = 'train'").select("target", F.col("ordinal").alias("at"))
    train = train.join(ordinals(train, "at").select("at", "ordinal"), "at").select("ordinal", "target")
    each = inputs.select(F.col("ordinal").alias("asked"), "source", F.explode(F.sequence(F.lit(0), F.lit(beams - 1))).alias("k"))
    drawn = D.random_responses(each.withColumn("ordinal", F.col("asked") * beams + F.col("k")), train)
    return drawn.select(F.col("asked").alias("ordinal"), F.col("response"), (-F.col("k")).cast("double").alias("score"))


#: The most words of a response that is searched for.
MOST_WORDS = 30


def beam_responses(pairs: DataFrame, inputs: DataFrame, beams: int) -> DataFrame:
    """(ordinal, response, score): to each input (ordinal, source) the best responses of a beam search over the training pairs' next words."""
    following = B.next_words(pairs.where("split = 'train'"), beams)
    asked = inputs.select(F.col("ordinal").alias("input"), B.start_of(F.col("source")).alias("start"))
    found = B.beam_search(asked, following, beams, MOST_WORDS)
    return found.select(F.col("input").alias("ordinal"), "response", (-F.col("cost") / 1_000_000).alias("score"))


#: By name: what gives responses.
RESPONSES: dict[str, Callable] = {"beam": beam_responses, "draw": train_responses}


def inputs_of(spark: SparkSession, mode: str, path: str | None, pairs: DataFrame, n: int, typed=None) -> DataFrame:
    """(ordinal, source) to answer: typed lines, a file's lines, or a random sample of the validation pairs."""
    if mode == "interactive":
        return R.typed_lines(spark, sys.stdin if typed is None else typed)
    if mode == "file":
        return R.input_file(spark, path)
    if mode == "dataset":
        return R.random_sample(pairs.where("split = 'dev'"), ["ordinal"], n).select("ordinal", "source")
    raise ValueError(f"no decode mode {mode}; there are: {', '.join(DECODE_MODES)}")


def decode(spark: SparkSession, outputs: P.Outputs, inputs: DataFrame, path: str, respond: Callable = beam_responses, beam_size: int = 10, return_beams: bool = True) -> DataFrame:
    """Answers to inputs (ordinal, source) by respond, the best beam_size of each; written to path, all beams or the best one."""
    pairs = spark.read.parquet(outputs.pairs)
    best = M.best(respond(pairs, inputs, beam_size), "ordinal", "score", "response", beam_size)
    O.write_decoded(best, path, return_beams)
    return best


def experiment(spark: SparkSession, outputs: P.Outputs, inputs: DataFrame, train_dir: str, decode_dir: str, respond: Callable = beam_responses, beam_size: int = 10, steps=C.SWEEP) -> list[str]:
    """decode at each checkpoint of the list, whose pointer is written first."""
    made = []
    for step in steps:
        O.write_checkpoint_pointer(spark, train_dir, step)
        made.append(f"{decode_dir}/test_set_{step}.txt")
        decode(spark, outputs, inputs, made[-1], respond, beam_size)
    return made


def _train(args, spark, outputs):
    raise SystemExit(f"training is outside this engine; its settings would be those of {C.default_preset(args.model, args.hparams)}")


def _decode(args, spark, outputs):
    inputs = inputs_of(spark, args.decode_mode, args.input, spark.read.parquet(outputs.pairs), args.sample)
    O.write_record(spark, P.with_changes(C.Config(), args.config), args.decode_dir)
    decode(spark, outputs, inputs, f"{args.decode_dir}/{args.output}", RESPONSES[args.respond], beam_size=args.beam_size, return_beams=not args.best_only)


def _experiment(args, spark, outputs):
    inputs = inputs_of(spark, args.decode_mode, args.input, spark.read.parquet(outputs.pairs), args.sample)
    experiment(spark, outputs, inputs, args.train_dir, args.decode_dir, RESPONSES[args.respond], beam_size=args.beam_size)


#: By name: what runs once the data is there.
MODES: dict[str, Callable] = {"train": _train, "decode": _decode, "generate_data": lambda args, spark, outputs: None, "experiment": _experiment}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> P.Outputs:
    a = argparse.ArgumentParser(prog="turnwise", description=__doc__)
    a.add_argument("--mode", default="", help=", ".join(MODES))
    a.add_argument("--problem", default="daily_dialog_chatbot")
    a.add_argument("--raw_dir", default="raw_data")
    a.add_argument("--data_dir", default="data_dir")
    a.add_argument("--train_dir", default="train_dir")
    a.add_argument("--decode_dir", default="decode_dir")
    a.add_argument("--url", default=None)
    a.add_argument("--config", default="", help="JSON of settings")
    a.add_argument("--model", default="transformer")
    a.add_argument("--hparams", default="")
    a.add_argument("--decode_mode", default="file", help=", ".join(DECODE_MODES))
    a.add_argument("--input", default=None)
    a.add_argument("--output", default="inference.txt")
    a.add_argument("--sample", type=int, default=100)
    a.add_argument("--beam_size", type=int, default=10)
    a.add_argument("--respond", default="beam", choices=sorted(RESPONSES))
    a.add_argument("--best_only", action="store_true")
    a.add_argument("--progress", action="store_true", help="tell rows by stage while it runs")
    args = a.parse_args(argv)
    if args.mode not in MODES:
        a.error("no suitable mode was given; it is one of: " + ", ".join(MODES))
    if args.mode == "train":
        _train(args, None, None)
    spark = spark or SparkSession.builder.getOrCreate()
    with progress.Progress(spark, lambda now: print(progress.line(now), file=sys.stderr)) if args.progress else nullcontext():
        outputs = P.generate(spark, args.problem, args.raw_dir, args.data_dir, P.with_changes(C.Config(), args.config), args.url)
        MODES[args.mode](args, spark, outputs)
    return outputs
