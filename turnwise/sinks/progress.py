"""How far a run has come: rows that its stages have read and written so far, told while they run."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Stage:
    """A stage's tasks, and the rows that its finished tasks have read and written; shuffled ones count, too."""

    id: int
    name: str
    tasks: int
    done: int
    rows_in: int
    rows_out: int


def stages(spark: SparkSession, running: bool = True) -> list[Stage]:
    """Stages that run now, or all that Spark still knows of, by what its status store has, which is there without the web page, too."""
    sc = spark.sparkContext
    wanted = sc._jvm.java.util.ArrayList()
    if running:
        wanted.add(sc._jvm.org.apache.spark.status.api.v1.StageStatus.ACTIVE)
    none = sc._gateway.new_array(sc._jvm.double, 0)
    found = sc._jsc.sc().statusStore().stageList(wanted, False, False, none, sc._jvm.java.util.ArrayList())
    out = []
    for k in range(found.size()):
        s = found.apply(k)
        out.append(Stage(s.stageId(), s.name(), s.numTasks(), s.numCompleteTasks(), s.inputRecords() + s.shuffleReadRecords(), s.outputRecords() + s.shuffleWriteRecords()))
    return out


class Progress:
    """with Progress(spark, print): … calls report with a list of the running stages every so many seconds, whenever it has changed."""

    def __init__(self, spark: SparkSession, report: Callable[[list[Stage]], None], every: float = 2.0):
        self.spark, self.report, self.every = spark, report, every
        self._over = threading.Event()
        self._thread = threading.Thread(target=self._watch, daemon=True)

    def _watch(self) -> None:
        last: list[Stage] = []
        while not self._over.wait(self.every):
            now = stages(self.spark)
            if now and now != last:
                self.report(now)
                last = now

    def __enter__(self) -> Progress:
        self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._over.set()
        self._thread.join()


def line(now: list[Stage]) -> str:
    """The stages in a line of text."""
    return "; ".join(f"stage {s.id}: {s.done} of {s.tasks} tasks, {s.rows_in} rows read, {s.rows_out} written" for s in now)
