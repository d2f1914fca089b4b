"""Counters while a run goes on, and the lines that readers leave out."""

import time

from turnwise.plans import problems as P
from turnwise.sinks import progress as PR
from turnwise.sources import readers as R


def test_counts_grow_before_the_end(spark, tmp_path):
    spark.range(4000, numPartitions=40).write.parquet(f"{tmp_path}/in")

    def slow(batches):
        for b in batches:
            time.sleep(0.05)
            yield b

    seen = []
    rows = spark.read.parquet(f"{tmp_path}/in").mapInArrow(slow, "id long").repartition(4)
    small = {"spark.sql.files.maxPartitionBytes": "1000", "spark.sql.files.openCostInBytes": "1000"}  # a task for each file
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        with PR.Progress(spark, lambda now: seen.append((time.time(), now)), every=0.1):
            rows.write.parquet(f"{tmp_path}/out")
    finally:
        for k in small:
            spark.conf.unset(k)
    over = time.time()
    read = [(at, s.rows_in) for at, now in seen for s in now if s.rows_in]
    assert len({n for _, n in read}) >= 2 and [n for _, n in read[:2]] == sorted(n for _, n in read[:2])
    assert read[0][0] < over and read[0][1] < 4000
    assert "rows read" in PR.line(seen[-1][1])
    assert sum(s.rows_out for s in PR.stages(spark, running=False)) >= 4000


def test_rows_in_are_rows_out_and_quarantined(spark):
    lines = lambda *x: spark.createDataFrame([("f", 0, i, v) for i, v in enumerate(x)], "file string, part int, line_no long, value string")
    told = lambda df: {(r.line_no, r.reason) for r in df.collect()}
    sep = " +++$+++ "
    movie = lines(sep.join("abcde"), "short", sep.join("abcdx"), sep.join("bbcde"), "", sep.join("abcdy"))
    assert told(R.movie_line_faults(movie)) == {(1, "fewer than 5 fields"), (4, "fewer than 5 fields"), (0, "its id comes again"), (2, "its id comes again")}
    assert R.movie_lines(movie).count() + R.movie_line_faults(movie).count() == 6
    dialogs = lines(sep.join(["a", "b", "c", "['L1']"]), "x")
    assert told(R.movie_dialog_faults(dialogs)) == {(1, "fewer than 4 fields")}
    assert R.movie_dialogs(dialogs).count() == 1
    marked = lines("a __eou__ b __eou__", "nothing", "")
    assert told(R.marked_dialog_faults(marked)) == {(1, "no __eou__"), (2, "no __eou__")}
    assert R.marked_dialogs(marked).select("dialog_no").distinct().count() == 1
    numbered = lines("1 a\tb", "no tab", "2 __SILENCE__\tc", "3 d\te", "1 f\tg")
    assert told(R.numbered_dialog_faults(numbered)) == {(1, "no tab"), (2, "silence"), (3, "silence")}
    assert R.numbered_dialogs(numbered).count() == 2 * 2
    assert {c for c in R.movie_line_faults(movie).columns} == {"file", "part", "line_no", "reason", "value"}


def test_a_run_keeps_what_it_left_out(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/dialogues_text.txt").write_text("a __eou__ b __eou__\nnothing\n")
    made = P.generate(spark, "daily_dialog_chatbot", f"{tmp_path}/raw", f"{tmp_path}/out")
    left = spark.read.parquet(f"{made.folder}/quarantine").collect()
    assert [(r.line_no, r.reason, r.value) for r in left] == [(1, "no __eou__", "nothing")]
