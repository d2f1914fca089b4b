"""Raw formats, pairs, splits and vocabularies, by cases traced by hand."""

from pyspark.sql import functions as F

from turnwise.functions import text as T
from turnwise.operators import dialogs as D
from turnwise.operators import vocab as V
from turnwise.sources import readers as R


def written(spark, tmp_path, name, lines):
    (tmp_path / name).write_text("\n".join(lines) + "\n")
    return R.lines(spark, str(tmp_path / name))


def cleaned(turns):
    return turns.withColumn("clean", T.clean(F.col("text")))


def flat(df):
    return [" ".join(x.split()) for r in df.orderBy("dialog_no", "turn").collect() for x in (r.source, r.target)]


def movie(spark, tmp_path, ids):
    rows = ["L1 +++$+++ u0 +++$+++ m0 +++$+++ ANN +++$+++ Hello there.", "L2 +++$+++ u1 +++$+++ m0 +++$+++ BO LEE +++$+++ I don't know!", "L3 +++$+++ u0 +++$+++ m0 +++$+++ ANN +++$+++ It's fine, really?"]
    spoken = R.movie_lines(written(spark, tmp_path, "lines.txt", rows))
    return cleaned(R.movie_turns(spoken, R.movie_dialogs(written(spark, tmp_path, "dialogs.txt", [f"u0 +++$+++ u1 +++$+++ m0 +++$+++ {ids}"]))))


def test_movie_pairs(spark, tmp_path):
    turns = movie(spark, tmp_path, ["L1", "L2", "L3"])
    pairs = D.movie_pairs(turns)
    assert flat(pairs) == ["hello there .", "i do n't know !", "i do n't know !", "it 's fine really ?"]
    vocab = V.vocabulary(V.frequencies(pairs, "source", ["dialog_no", "turn"]), 8)
    assert [r.token for r in vocab.orderBy("id").collect()] == ["<pad>", "<EOS>", "hello", "there", ".", "i", "do", "<unk>"]
    one = spark.createDataFrame([(0, "hello zzz .")], "k int, s string")
    assert V.encode(one, "s", ["k"], vocab).first().ids == [2, 7, 4, 1]
    names = spark.createDataFrame([("ANN_m0",)], "name string")
    assert flat(D.named_pairs(pairs, names))[::2] == ["ANN_m0 hello there . <unk_name>", "<unk_name> i do n't know ! ANN_m0"]


def test_a_repeated_last_id_is_no_source(spark, tmp_path):
    assert flat(D.movie_pairs(movie(spark, tmp_path, ["L1", "L2", "L1"]))) == ["i do n't know !", "hello there ."]


def test_marked_dialogs(spark, tmp_path):
    raw = written(spark, tmp_path, "d.txt", ["Hi there . __eou__ I'm ok! __eou__ Bye __eou__", "Hi __eou__ no marker at end"])
    turns = cleaned(R.marked_dialogs(raw))
    assert turns.count() == 4
    assert flat(D.pairs(turns)) == ["hi there .", "i 'm ok !", "i 'm ok !", "bye"]


def test_numbered_dialogs(spark, tmp_path):
    rows = ["1 hello how are you?\tfine thanks.", "2 what's up\tnot much!", "1 __SILENCE__\thi", "2 bye\tbye now", "1 good day\tgood day to you"]
    (tmp_path / "p.txt").write_text("\n".join(rows))
    raw = R.numbered(spark, [str(tmp_path / "p.txt")])
    assert D.pairs(cleaned(R.numbered_dialogs(raw))).count() == 4
    assert D.pairs(cleaned(R.numbered_dialogs(raw, strict=True))).count() == 3


def test_subtitles(spark, tmp_path):
    rows = ['<s id="1">', '<w id="1.1">Hello</w>', '<w id="1.2">there</w>', '<s id="2">', '<w id="2.1">Yes</w>', '<s id="3">', '<w id="3.1">Fine</w>']
    raw = written(spark, tmp_path, "s.xml", rows)
    assert [r.text for r in R.subtitle_turns(raw).orderBy("turn").collect()] == ["Hello there", "Yes", "Fine"]
    assert [r.text for r in R.subtitle_turns(raw, strict=True).orderBy("turn").collect()] == ["", "Hello there", "Yes"]


def test_split_slots(spark):
    d = spark.range(205).select(F.col("id").alias("dialog_no"))
    got = D.with_split(d, d).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 165, "dev": 20, "test": 20}


def test_tools(spark):
    rows = spark.createDataFrame([(0, "b a"), (1, "a b c"), (2, "a")], "line int, text string")
    assert [(r.token, r.n) for r in V.top(V.frequencies(rows, "text", ["line"]), 2).collect()] == [("b", 2), ("a", 3)][::-1]
    assert [r[0] for r in rows.select(V.without(F.col("text"), ["a", "are n't"])).collect()] == ["b", "b c", ""]
