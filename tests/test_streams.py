"""Beam search and streams against plain Python: ties, dead ends, shuffled and late arrival, reruns after a kill."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from turnwise.operators import beams as B
from turnwise.streaming import dialogs as SD

PAIRS = [("a b", "x y"), ("a b", "x z"), ("c b", "x y y"), ("q", ""), ("r", "y x"), (None, "n"), ("s", None), ("", "w"), ("b", "x y")]


def plain_table(pairs, width):
    n = Counter()
    for s, t in pairs:
        if s is None or t is None:
            continue
        start = " ".join([">", *s.split()[-1:]])
        words = t.split()
        for first in dict.fromkeys([start, ">"]):
            n[first, (words + [""])[0]] += 1
        for a, b in zip(words, [*words[1:], ""]):
            n[a, b] += 1
    total = Counter()
    for (a, _), c in n.items():
        total[a] += c
    best = {}
    for (a, b), c in n.items():
        best.setdefault(a, []).append((round(math.log(total[a] / c) * 1e6), b))
    return {a: sorted(x)[:width] for a, x in best.items()}


def plain_beams(table, start, width, length):
    beam = [(0, [], start if start in table else ">", False)]
    for _ in range(length):
        more = []
        for rank, (cost, said, state, ended) in enumerate(beam):
            if ended:
                more.append((cost, rank, "", said, True))
            else:
                more += [(cost + c, rank, w, said + [w] * bool(w), not w) for c, w in table[state]]
        beam = [(c, said, w, e) for c, _, w, said, e in sorted(more)[:width]]
    return [(i, " ".join(said), c, e) for i, (c, said, _, e) in enumerate(beam, 1)]


@pytest.mark.parametrize("width,length", [(1, 3), (3, 1), (3, 4), (10, 6)])
def test_beams(spark, width, length):
    pairs = spark.createDataFrame(PAIRS, "source string, target string")
    following = B.next_words(pairs, width)
    table = plain_table(PAIRS, width)
    assert {(r.state, r.word, r.cost) for r in following.collect()} == {(a, w, c) for a, x in table.items() for c, w in x}
    inputs = spark.createDataFrame([(i, s) for i, s in enumerate(["a b", "zzz", "", "q"])], "input long, s string").select("input", B.start_of(F.col("s")).alias("start"))
    got = {}
    for r in B.beam_search(inputs, following, width, length).orderBy("input", "rank").collect():
        got.setdefault(r.input, []).append((r.rank, r.response, r.cost, r.ended))
    assert got == {i: plain_beams(table, s, width, length) for i, s in enumerate(["> b", "> zzz", ">", "> q"])}


def test_nothing_to_say(spark):
    following = B.next_words(spark.createDataFrame([], "source string, target string"), 2)
    inputs = spark.createDataFrame([(1, "> a")], "input long, start string")
    assert B.beam_search(inputs, following, 2, 3).count() == 0


def test_a_killed_stream_goes_on_and_gives_no_row_twice(spark, tmp_path, monkeypatch):
    pairs = spark.createDataFrame(PAIRS, "source string, target string")
    answers = B.answers(pairs, 3, 4)
    sources = spark.createDataFrame([(i, s) for i, s in enumerate(["a b", "zzz", "q", "a b", "r", ""])], "id long, source string")
    sources.repartition(4, "id").write.parquet(f"{tmp_path}/in")
    stream = lambda: SD.arriving(spark, f"{tmp_path}/in", sources.schema)

    class Killed(Exception):
        pass

    real = type(sources.write).parquet
    calls = []

    def parquet(self, path, *a, **k):
        real(self, path, *a, **k)
        calls.append(path)
        if len(calls) == 2:  # written, but not yet noted as done
            raise Killed

    with monkeypatch.context() as m:
        m.setattr(type(sources.write), "parquet", parquet)
        with pytest.raises(Exception, match="Killed"):
            SD.decoded(stream(), answers, f"{tmp_path}/out")
    want = sorted((r.id, r.source, r.response) for r in B.answered(sources, answers).collect())
    assert sorted((r.id, r.source, r.response) for r in SD.decoded(stream(), answers, f"{tmp_path}/out").collect()) == want
    assert len({p for p in calls}) == 2
    sources.select((F.col("id") + 10).alias("id"), "source").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")  # more arrives
    assert SD.decoded(stream(), answers, f"{tmp_path}/out").count() == 12


def test_turns_in_any_order(spark, tmp_path):
    """Files of shuffled turns: pairs of neighbours at once, over gaps once a dialog has closed; late turns and second copies add nothing."""
    base = 1_000_000
    first = [(1, 2, " c "), (1, 0, "a"), (2, 0, "p"), (3, 1, None), (3, 0, "n"), (1, 2, "other")]
    second = [(1, 1, "b"), (2, 3, "s"), (3, 2, "o"), (2, 0, "again")]
    third = [(9, 0, "x"), (9, 1, "y")]  # much later: closes the others
    fourth = [(1, 3, "late"), (9, 2, "z")]
    for k, (rows, at) in enumerate([(first, 0), (second, 10), (third, 50_000), (fourth, None)]):
        timed = [(d, t, x, base + t + (at if at is not None else 0 if d == 1 else 50_000)) for d, t, x in rows]
        df = spark.createDataFrame(timed, "dialog_no long, turn int, clean string, at long").withColumn("ts", F.timestamp_seconds("at")).drop("at")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = SD.with_rocks(spark, lambda: SD.drained_once(SD.pairs(SD.arriving(spark, f"{tmp_path}/in", df.schema)), f"{tmp_path}/out"))  # noqa: B023
        found = sorted(map(tuple, got.collect()))
        if k == 1:
            assert found == [(1, 0, "a", "b"), (1, 1, "b", "c")]
    assert found == [(1, 0, "a", "b"), (1, 1, "b", "c"), (2, 0, "p", "s"), (9, 0, "x", "y"), (9, 1, "y", "z")]


def test_a_late_copy_keeps_a_dialog_open(spark, tmp_path):
    """A copy of a turn adds nothing but its time: the dialog is closed, and its gap paired, silence after that."""
    hour, base = 3600, 1_000_000
    files = [[(1, 0, "a", 0), (1, 2, "c", 5)], [(1, 0, "copy", hour)], [(9, 0, "x", 2 * hour + 100)], [(9, 1, "y", 3 * hour + 100)], [(9, 2, "z", 3 * hour + 101)]]
    seen = []
    for rows in files:
        df = spark.createDataFrame([(d, t, x, base + s) for d, t, x, s in rows], "dialog_no long, turn int, clean string, at long").withColumn("ts", F.timestamp_seconds("at")).drop("at")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = SD.with_rocks(spark, lambda: SD.drained_once(SD.pairs(SD.arriving(spark, f"{tmp_path}/in", df.schema)), f"{tmp_path}/out"))  # noqa: B023
        seen.append((1, 0, "a", "c") in {tuple(r) for r in got.collect()})
    assert seen == [False, False, False, True, True]


def test_calls_of_the_state_do_not_grow_with_turns():
    """Each call goes to the JVM and back: a batch makes as many for a dialog of thirty turns as for one of two."""
    from pyspark.sql import Row

    calls = []

    class Held:
        def __init__(self):
            self.rows = []

        def get(self):
            calls.append("get")
            return iter(self.rows)

        def appendList(self, rows):
            calls.append("append")
            self.rows += rows

    class Handle:
        timers = set()

        def getListState(self, name, schema):
            return Held()

        def deleteTimer(self, at):
            calls.append("delete")
            self.timers.remove(at)

        def registerTimer(self, at):
            calls.append("register")
            self.timers.add(at)

    def told(n):
        p = SD.Neighbours(1000)
        p.init(Handle())
        p.handle.timers = set()
        calls.clear()
        out = []
        for half in (0, 1):
            rows = [Row(turn=t, clean=f"t{t}", ms=t) for t in range(half, n, 2)]
            out += list(p.handleInputRows((5,), iter(rows), None))
        assert p.handle.timers == {n - 1 + 1000}
        assert sorted(map(tuple, out)) == [(5, t, f"t{t}", f"t{t + 1}") for t in range(n - 1)]
        return list(calls)

    assert told(2) == told(30) == ["get", "append", "register", "get", "append", "delete", "register"]
