"""Which rows stay: null and empty texts, repeated ids, ties, columns with clashing names, empty tables, blocks of bitmaps."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from turnwise.llm import decontaminate, exact_dedup, quality, shared, simhash

WORDS = {x: " ".join(f"{x}{i}" for i in range(200)) for x in "abcdef"}


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, k, k, "x") for k, (i, t) in enumerate(rows)], "doc_id long, text string, place int, _row int, _metadata string").repartition(parts)


def kept(df):
    return sorted(r.place for r in df.select("place").collect())


ROWS = [(3, None), (3, ""), (5, "a b"), (5, "a b"), (9, "a b"), (None, "a b"), (None, "q"), (None, "q"), (1, "q2"), (1, "q3")]


@pytest.mark.parametrize("keep,want", [("largest", {0: (0, 1), 4: (4,), 6: (6, 7), 8: (8,), 9: (9,)}), ("smallest", {0: (0, 1), 2: (2, 3), 6: (6, 7), 8: (8,), 9: (9,)})])
def test_one_row_of_each_text(spark, keep, want):
    docs = frame(spark, ROWS)
    got = exact_dedup.distinct(docs, keep)
    assert got.columns == docs.columns
    places = kept(got)
    assert len(places) == len(want)
    assert all(sum(p in group for p in places) == 1 for group in want.values())
    marked = exact_dedup.mark(docs, keep)
    assert marked.where("kept").count() == len(want)
    assert marked.count() == len(ROWS)


def test_rows_that_come_from_no_file(spark):
    assert len(kept(exact_dedup.distinct(frame(spark, ROWS), written=True))) == 5


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([("b", "x"), ("a", "x"), (None, "x"), ("c", "y")], "doc_id string, text string")
    assert {r.keep_id for r in exact_dedup.mark(docs, "smallest").collect()} == {"a", "c"}
    assert {r.keep_id for r in exact_dedup.mark(docs).collect()} == {"b", "c"}
    with pytest.raises(ValueError):
        exact_dedup.mark(docs, "any")


def test_rows_in_blocks_of_files(spark, tmp_path):
    """Rows are found whatever the number of bitmaps that are sent at once, also past a bitmap's rows."""
    spark.range(70_000, numPartitions=2).select("id", F.lit("t").alias("text")).write.parquet(f"{tmp_path}/t")
    docs = spark.read.parquet(f"{tmp_path}/t")
    file, row = shared.place(docs)
    stays = docs.where("id % 7 = 3 or id in (0, 32767, 32768, 34999, 35000, 69999)").select(file, row)
    want = [i for i in range(70_000) if i % 7 == 3 or i in (0, 32767, 32768, 34999, 35000, 69999)]
    for sent in (1, 2, 100):
        assert sorted(r.id for r in shared.rows_in(docs, stays, sent).collect()) == want
    assert shared.rows_in(docs, stays.limit(0)).count() == 0


def test_near_copies_row_by_row(spark):
    a, b, c = (WORDS[x] for x in "abc")
    docs = frame(spark, [(1, a), (5, a + " "), (5, b), (5, b), (None, c), (None, c + " "), (None, a), (7, None), (6, "")])
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    places = kept(got)
    assert len(places) == 4 and {0, 8} <= set(places) and sum(p in (2, 3) for p in places) == 1 and sum(p in (4, 5) for p in places) == 1


@pytest.mark.parametrize("run", [exact_dedup.distinct, simhash.one_of_each])
def test_no_rows(spark, run):
    assert run(frame(spark, ROWS).limit(0)).count() == 0


def test_decontamination_leaves_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d", 7, "k"), (2, None, 8, None)], "doc_id long, text string, _n_words long, _text string")
    items = spark.createDataFrame([(1, "B c"), (2, "zz")], "item_id long, text string")
    for size in (16 << 20, 70):
        got = {r.doc_id: tuple(r) for r in decontaminate.remove(docs, items, block_bytes=size).collect()}
        assert got == {1: (1, "a  d", 7, "k"), 2: (2, None, 8, None)}
    assert decontaminate.remove(docs.limit(0), items).count() == 0
    assert decontaminate.search(docs, items.limit(0)).where("contaminated").count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    """Documents of class 0 repeat words; ids repeat, texts are null, empty and very long."""
    good = lambda i: " ".join(f"{chr(97 + (i * k) % 26)}{(i + 7 * k) % 50}" for k in range(60))
    bad = lambda i: " ".join(f"z{i % 5}" for _ in range(60))
    rows = [(i, good(i) if i % 2 else bad(i)) for i in range(120)] + [(3, good(3)), (3, "another text"), (500, None), (501, ""), (502, good(1) * 3000), (None, good(2))]
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, _quality string, score double")
    labels = [(i, i % 2, 0) for i in range(120)] + [(4, 1, 0), (500, 0, 0), (501, 0, 0), (502, 1, 0), (None, 1, 0), (7, 5, 0), (9, None, 0)]
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark, labelled):
    docs, labels = labelled
    got = quality.classify(docs.repartition(4), labels).collect()
    again = quality.classify(docs.repartition(2), labels).collect()
    key = lambda rows: sorted((str(r.doc_id), r.score) for r in rows)
    assert key(got) == key(again) and len(got) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 120]
    assert len(held) > 20 and sum(r.predicted == r.doc_id % 2 for r in held) >= 0.95 * len(held)
    empty = {r.score for r in got if r.doc_id in (500, 501)}
    assert len(empty) == 1
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_quality_on_held_out_rows(spark):
    """Of the given labels, nearly all that the model has not seen are told."""
    path = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{path}/labels.parquet")
    got = quality.classify(spark.read.parquet(f"{path}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").collect()
    assert len(got) > 50 and sum(r.predicted == r.quality for r in got) >= 0.97 * len(got)


def test_pipeline_stages_leave_columns(spark, labelled, tmp_path):
    docs, labels = labelled
    docs = docs.withColumns({"_n_words": F.lit(3), "source": F.lit("s"), "file": F.lit("f"), "map": F.lit(1)})
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "b8 c15 d22 none")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/empty")
    for start in ("documents.parquet", "empty"):
        now = spark.read.parquet(f"{tmp_path}/{start}")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, str(tmp_path))
            assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{start}-{k}")
            now = spark.read.parquet(f"{tmp_path}/{start}-{k}")
        assert now.columns == ["doc_id", "size", "source_size", "target", "taken"]
        assert (now.count() > 0) == (start != "empty")
