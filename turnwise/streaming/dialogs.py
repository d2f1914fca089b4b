"""Dialogs as streams: answers to sources that arrive, and pairs of turns that arrive in any order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from turnwise.operators.beams import answered
from turnwise.sinks.paths import exists


def drained_once(stream: DataFrame, folder: str) -> DataFrame:
    """What a stream gives until all that has arrived is read, as a table below folder; run again, it goes on where it was.

    A batch writes the folder of its own number in place of what is there, so that a batch that was cut, and is run again, gives no row
    twice.  The driver holds none.
    """
    spark, out = stream.sparkSession, f"{folder}/batches"

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    if not exists(spark, out):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(out)


def arriving(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """A stream of the Parquet files that arrive at path, so many a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def decoded(sources: DataFrame, answers: DataFrame, folder: str) -> DataFrame:
    """(…, source, response) of sources that arrive, joined with a table of answers (state, response) as it stands; see :func:`drained_once`."""
    return drained_once(answered(sources, answers), folder)


class Neighbours(StatefulProcessor):
    """A dialog's turns so far.  A pair is given once both its turns are there; when a dialog has been silent for long enough it is
    closed: turns with a gap between them are paired, too, and the dialog is forgotten.

    Every call of the state goes to the JVM and back, so a dialog's state is one list, read and added to once a batch.  It has a row for
    each turn, and one without a turn where a copy came later than all turns; the latest time in it tells the timer.
    """

    def __init__(self, silence_ms: int):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", "turn long, text string, ms long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = list(self.turns.get())
        got = {turn: text for turn, text, _ in held if turn is not None}
        before = latest = max((ms for _, _, ms in held), default=None)
        new, out = [], []
        for row in rows:
            turn, text = row.turn, row.clean
            later = latest is None or row.ms > latest
            latest = row.ms if later else latest
            if turn in got:  # a turn that comes twice is what it was first
                if later:
                    new.append((None, None, row.ms))
                continue
            got[turn] = text
            new.append((turn, text, row.ms))
            out += [(t, got[t], got[t + 1]) for t in (turn - 1, turn) if t in got and t + 1 in got]
        if new:
            self.turns.appendList(new)
        if latest != before:
            if before is not None:
                self.handle.deleteTimer(before + self.silence_ms)
            self.handle.registerTimer(latest + self.silence_ms)
        yield from self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        got = sorted((turn, text) for turn, text, _ in self.turns.get() if turn is not None)
        self.turns.clear()
        yield from self._rows(key, [(a, x, y) for (a, x), (b, y) in zip(got[:-1], got[1:], strict=True) if b != a + 1])

    def close(self) -> None:
        pass

    @staticmethod
    def _rows(key, pairs) -> Iterator[Row]:
        for t, a, b in pairs:
            if a is not None and b is not None:
                yield Row(dialog_no=key[0], turn=t, source=a.strip(" "), target=b.strip(" "))


def pairs(turns: DataFrame, late: str = "1 hour", silence: str = "1 hour") -> DataFrame:
    """(dialog_no, turn, source, target) of a stream of turns (dialog_no, turn, clean, ts) in any order.

    Rows later than late are dropped; a dialog is closed silence after its last turn's time, once the stream is past that and late.  A
    missing text is no turn of a pair, but no gap either.  State is one dialog's turns, in RocksDB.
    """
    timed = turns.select("dialog_no", F.col("turn").cast("long").alias("turn"), "clean", "ts", F.unix_millis("ts").alias("ms")).withWatermark("ts", late)
    return timed.groupBy("dialog_no").transformWithState(Neighbours(int(pd.Timedelta(silence).total_seconds() * 1000)), "dialog_no long, turn long, source string, target string", "append", "eventTime")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocks(spark: SparkSession, run: Callable[[], DataFrame]) -> DataFrame:
    """run() in a session whose streams hold their state in RocksDB, as stateful processors need; the session's setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        return run()
    finally:
        spark.conf.set(name, before)
