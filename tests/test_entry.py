import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
OWN = ["dialog_split", "vocab_topk", "identity_entropy", "eval_bleu", "beam_topk", "persona_silence_prefix", "encode_bytes", "avg_embedding_filter_both", "generate_cornell_names", "generate_persona"]


@pytest.mark.parametrize("name", OWN)
def test_query_and_sql_agree(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "documents", "events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = entry.queries()[name](spark, DIR)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got.select(cols).collect())) == sorted(map(key, want))


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scores_in_blocks_are_the_same(spark):
    from turnwise.operators.metrics import dot_scores

    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "id long, vector array<double>")
    whole = dot_scores(rows, rows)
    assert whole.count() == 72
    assert sorted(map(tuple, dot_scores(rows, rows, 2).collect())) == sorted(map(tuple, whole.collect()))


def test_every_copy_is_in_a_near_duplicate_pair(spark, tmp_path):
    long = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    texts = [long, long.upper(), long, long + " more", "short", "short", "some thing else", None, long + " more"]
    turns = [(1, i, "user", t) for i, t in enumerate(texts)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(10 + i, t) for i, t in enumerate(texts)] + [(None, long)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    copies = {(0, 1), (0, 2), (4, 5), (3, 8)}
    for name, of in (("minhash_near_dups", lambda i: f"1:{i}"), ("minhash_near_docs", lambda i: 10 + i)):
        got = entry.queries()[name](spark, str(tmp_path)).collect()
        assert sorted((r.a, r.b) for r in got if r["copy"]) == sorted((of(a), of(b)) for a, b in copies)
        assert [(r.a, r.b, r.jaccard) for r in got if not r["copy"]] == [(of(0), of(3), round(16 / 17, 6))]


def test_sweep_decodes_the_whole_test_split(spark):
    from turnwise.plans.config import SWEEP

    path = "/root/testdata/sf0.01"  # the smallest table has no conversation in the test split
    got = entry.queries()["checkpoint_sweep_test"](spark, path)
    test = entry.queries()["dialog_split"](spark, path).where("split = 'test'")
    assert got.where("turn > 0").count() > 0
    assert got.count() == len(SWEEP) * test.count()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet'")
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()['checkpoint_sweep_test']})").fetchall()
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(want)
