"""Cleaning, by cases traced by hand."""

import pytest
from pyspark.sql import functions as F

from turnwise.functions import text as T

CASES = {
    "I don't know!": "i do n't know ! ",
    "it's Bob's 'hat'.": "it 's bob 's hat' . ",
    "y''all": "y ' 'all",
    "''cause": " ' 'cause",
    "rock ' n ' roll": "rock n roll",
    "dogs'": "dogs'",
    "o'to": "o'to",
    "an'b": "an'b",
    "a'b'c": "a 'b'c",
    "a\tb\nc": "abc",
    "Étion dans, çouelle": "tion dans ouelle",
    "": "",
}


def test_clean(spark):
    df = spark.createDataFrame([(k,) for k in CASES], "t string").select("t", T.clean(F.col("t")).alias("c"))
    assert {r.t: r.c for r in df.collect()} == CASES


@pytest.mark.parametrize("text, ids", [("hé", [106, 197, 171, 1]), ("", [1])])
def test_byte_ids(spark, text, ids):
    assert spark.createDataFrame([(text,)], "t string").select(T.byte_ids(F.col("t"))).first()[0] == ids


def test_accents(spark):
    df = spark.createDataFrame([("Étion ½ ﬁn",), (None,)], "t string").select(T.clean_accents(F.col("t")))
    assert [r[0] for r in df.collect()] == ["etion 12 fin ", None]


def test_sentences(spark):
    from turnwise.operators import segments as G

    said = ["Dr. Gray met Mr. Low. They left.", "Ask Dr. Low! Is he in?  (He is.) \"Yes.\" Then...", "Wait... what? Wait... What", "J. S. Bach wrote it. the end", "No stop at all", "", None, "at 3.5 p.m. we ate. low"]
    corpus = spark.createDataFrame([(i, t) for i, t in enumerate(said * 4 + ["They ate it and left. It ate her low bach and left with it. What they left is low and they ate her bach there, then we met; the low bach is his, and then she left it, what a low bach"] * 30)], "doc_id long, text string")
    known = G.abbreviations(corpus)
    words = {r.word for r in known.collect()}
    assert {"dr", "mr"} <= words and not {"left", "ate", "low", "bach"} & words
    table = spark.createDataFrame([("dr",), ("mr",), ("p.m",)], "word string")
    got = {}
    for r in G.sentences(spark.createDataFrame(list(enumerate(said)), "doc_id long, text string"), table).orderBy("doc_id", "sentence").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got == {
        0: ["Dr. Gray met Mr. Low.", "They left."],
        1: ["Ask Dr. Low!", "Is he in?", "(He is.)", '"Yes."', "Then..."],
        2: ["Wait... what?", "Wait...", "What"],
        3: ["J. S. Bach wrote it.", "the end"],
        4: ["No stop at all"],
        7: ["at 3.5 p.m. we ate.", "low"],
    }
    assert G.abbreviations(corpus.limit(0)).count() == 0


def test_sentences_are_those_of_every_token(spark):
    """Only tokens with a mark are looked at; before, each was."""
    import random
    import re

    from turnwise.operators import segments as G

    rng = random.Random(3)
    tokens = ["a", "Dr.", "dr.)", "J.", "(J.", "what?\"", "no!]}", "...", "Wait...", "..", "x..y", "3.5", "p.m.", ".", "?", '".', "\u00c9t\u00e9.", "\u00e9.", "\"The", "(the", "end.\u00a0", "a.\x0b", "", "!a", "a!b?"]
    for _ in range(3000):
        body = rng.choice(["", " ", "\n"]) + "".join(rng.choice(tokens) + rng.choice([" ", "  ", "\t", "\r\n", "\x0c"]) for _ in range(rng.randrange(8)))
        words, out, start = [t for t in re.split(G.SPACE, body) if t], [], 0
        for i, t in enumerate(words):
            if i + 1 == len(words) or G.ends(t, words[i + 1], {"dr", "p.m"}):
                out.append(" ".join(words[start : i + 1]))
                start = i + 1
        assert G.cut(body, {"dr", "p.m"}) == out


def test_tokens_are_counted_where_the_texts_are(spark, monkeypatch):
    """Before, every token was a row."""
    from turnwise.operators import segments as G

    df = spark.createDataFrame([(f" a b.\t{i % 3} a  ",) for i in range(300)] + [(None,), ("",)], "text string").coalesce(1)
    assert sorted(map(tuple, G.token_counts(df, "text").collect())) == [("0", 100), ("1", 100), ("2", 100), ("a", 600), ("b.", 300)]
    monkeypatch.setattr(G, "COUNTED", 2)
    again = G.token_counts(df, "text").groupBy("t").sum("n").collect()
    assert sorted(map(tuple, again)) == [("0", 100), ("1", 100), ("2", 100), ("a", 600), ("b.", 300)]


def _many(spark, tmp_path):
    """A table of 11,000 abbreviations, more than go to all tasks; each is a document's, which is of two sentences."""
    from itertools import islice, product

    made = ["".join(p) for p in islice(product("bcdfghjklmnpqrstvwxyz", "aeiou", "abcdefghijklmnopqrstuvwxyz", "bcdf"), 11_000)]
    texts = [(i, f"So {w}. Low and {w}. {w}. {w}. {w}. {w}. {w}. {w}. Lee {'went there and ' * 30}out again and again. They left it") for i, w in enumerate(made)]
    spark.createDataFrame(texts + [(None, None), (-1, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return made, [t for _, t in texts]


def test_all_abbreviations_are_given(spark, tmp_path):
    """Before, 10,000 at most."""
    import __spark_entry__ as entry

    made, _ = _many(spark, tmp_path)
    got = [(r.word, r.n, r.dotted) for r in entry.queries()["abbreviations"](spark, str(tmp_path)).collect()]
    assert got == [(w, 8, 8) for w in sorted(made)]


def test_sentences_know_all_abbreviations(spark, tmp_path):
    """Before, the 10,000 best."""
    import __spark_entry__ as entry

    _, texts = _many(spark, tmp_path)
    got = {(r.doc_id, r.sentence): r.text for r in entry.queries()["sentence_split"](spark, str(tmp_path)).collect()}
    want = {}
    for i, t in enumerate(texts):
        end = t.index("again. ") + 6
        want[i, 0], want[i, 1] = t[:end], t[end + 1 :]
    assert got == want


def test_treebank_words(spark):
    said = {
        '"Hi," she said (twice)... "No!"': "`` Hi , '' she said ( twice ) ... `` No ! ''",
        "It's 3,000 dollars: we can't, they'll see.": "It 's 3,000 dollars : we ca n't , they 'll see .",
        "U.S. dogs' toys -- [old]": "U.S. dogs ' toys -- [ old ]",
        "": "",
    }
    df = spark.createDataFrame([(k,) for k in [*said, None]], "t string")
    assert {r.t: r.w for r in df.select("t", T.treebank(F.col("t")).alias("w")).collect()} == said | {None: None}
