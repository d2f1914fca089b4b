"""Sentences: abbreviations learned from a corpus, and texts split where a sentence ends.

A word that comes with a period much more often than words do by chance is an abbreviation: the likelihood ratio of its periods, as in
Kiss and Strunk's unsupervised method, times factors for short words, inner periods, and against occurrences without one.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.sinks.paths import scratch, written

#: White space between tokens; what may close or open a quotation or a bracket around one.
SPACE, CLOSERS, OPENERS = "[ \t\n\r\f]+", "[)\\]}\"']+$", "^[(\\[{\"']+"
#: Letters, ASCII or not, with single periods between them.
WORD = "^[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+(\\.[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+)*$"
#: A score from which a word is an abbreviation; so many of them go to all tasks as they are, more are joined with what texts ask for.
LEAST, MOST = 0.3, 10_000


#: Distinct tokens that a task counts before it gives their counts.
COUNTED = 1 << 17


def token_counts(texts: DataFrame, text: str) -> DataFrame:
    """(t, n): tokens of whole texts and how often they come, a row or more for each."""

    def run(batches):
        import pyarrow as pa

        count, split = Counter(), re.compile(SPACE).split

        def given():
            tokens = list(count)
            for x in range(0, len(tokens), 1 << 15):
                some = tokens[x : x + (1 << 15)]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([count[t] for t in some], pa.int64())], names=["t", "n"])

        for b in batches:
            for body in b.column(0):
                count.update(split(body.as_py() or ""))
                if len(count) > COUNTED:
                    count.pop("", None)
                    yield from given()
                    count.clear()
        count.pop("", None)
        yield from given()

    return texts.select(text).mapInArrow(run, "t string, n long")


def abbreviations(texts: DataFrame, text: str = "text", least: float = LEAST) -> DataFrame:
    """(word, n, dotted, score) of all words of texts that are abbreviations, in lower case and without their last period: one grouping
    of all words, counted where the texts are, once.  Ties go by word."""
    bare = F.regexp_replace(F.regexp_replace("t", CLOSERS, ""), OPENERS, "")
    dotted = F.col("t").rlike("[^.]\\.$")
    word = F.lower(F.when(dotted, F.expr("left(t, length(t) - 1)")).otherwise(F.col("t")))
    each = token_counts(texts, text).groupBy("t").agg(F.sum("n").alias("n"))  # what follows is for distinct tokens
    counts = each.select(bare.alias("t"), "n").groupBy(word.alias("word")).agg(F.sum("n").alias("n"), F.sum(F.when(dotted, F.col("n")).otherwise(0)).alias("dotted"))
    counts = written(counts, scratch(texts.sparkSession, "word-counts"))  # summed and scored
    total = counts.agg(F.sum("n").alias("all_n"), F.sum("dotted").alias("all_dotted"))  # one row
    c = counts.where((F.col("dotted") > 0) & F.col("word").rlike(WORD)).join(F.broadcast(total), how="cross")
    p, without = F.col("all_dotted") / F.col("all_n"), F.col("n") - F.col("dotted")
    chance = F.col("dotted") * F.log(p) + without * F.log(F.greatest(1 - p, F.lit(1e-12)))
    sure = F.col("dotted") * F.log(F.lit(0.99)) + without * F.log(F.lit(0.01))
    inner = F.length("word") - F.length(F.translate("word", ".", ""))
    letters = (F.length("word") - inner).cast("double")
    score = -2 * (chance - sure) * F.exp(-letters) * (inner + 1) * F.pow(letters, -without.cast("double"))
    return c.withColumn("score", F.round(score, 6)).where(F.col("score") >= least).select("word", "n", "dotted", "score").orderBy(F.desc("score"), "word")


def ends(token: str, following: str | None, known: set[str]) -> bool:
    """Whether a sentence ends with a token: at ? and !, at an ellipsis before a capital, at a period that is no abbreviation's nor an
    initial's."""
    core = re.sub(CLOSERS, "", token)
    if core.endswith(("?", "!")):
        return True
    if core.endswith(".."):
        first = re.sub(OPENERS, "", following or "")[:1]
        return following is None or first != first.lower()
    if not core.endswith("."):
        return False
    word = re.sub(OPENERS, "", core)[:-1].lower()
    return word not in known and not (len(word) == 1 and word.isalpha())


#: Characters of sentences that are given at once.
GIVEN = 1 << 22
#: Where a sentence may end: a mark, what closes, and the token's end, in tokens joined by one blank.
MAY_END = re.compile("[.?!][)\\]}\"']*(?= |$)")


def cut(body: str, known: set[str]) -> list[str]:
    """Sentences of a text, words joined by one blank.  Only tokens with an ending mark are looked at."""
    flat = " ".join(t for t in re.split(SPACE, body) if t)
    out, start = [], 0
    for m in MAY_END.finditer(flat):
        end = m.end()
        if end == len(flat):
            break
        after = flat.find(" ", end + 1)
        first = max(start, flat.rfind(" ", start, end) + 1)
        if ends(flat[first:end], flat[end + 1 : after if after >= 0 else len(flat)], known):
            out.append(flat[start:end])
            start = end + 1
    if flat:
        out.append(flat[start:])
    return out


class _Asked(set):
    """Holds the words that are looked up in it, and knows none."""

    def __contains__(self, word) -> bool:
        self.add(word)
        return False


def _asked(rows: DataFrame, words: set[str]) -> DataFrame:
    """(row, word): of rows (row, text) the distinct words, other than words, that must be no abbreviations for a sentence to end."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            row, word = [], []
            for i, body in enumerate(b.column(1)):
                asked = _Asked()
                cut(body.as_py() or "", asked)
                mine = set(asked) - words
                row += [i] * len(mine)
                word += mine
                if len(word) > COUNTED:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(word, pa.string())], names=["row", "word"])
                    row, word = [], []
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(word, pa.string())], names=["row", "word"])

    return rows.select("row", "text").mapInArrow(run, "row long, word string")


def sentences(texts: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sentence from 0, text) of whole texts, words joined by one blank; known: (word), as many as there are.

    Null and empty texts have no sentences.  MOST known words or fewer go to all tasks, and texts are split where they are, without a
    shuffle.  Of more, the first MOST do; a text gets those of the others that it asks for, by a join.
    """
    first = [r.word for r in known.select("word").limit(MOST + 1).collect()]
    words, kind, whole = set(first[:MOST]), dict(texts.dtypes)[key], len(first) <= MOST
    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    if not whole:
        rows = written(rows.withColumn("row", F.monotonically_increasing_id()), scratch(texts.sparkSession, "texts"))
        more = _asked(rows, words).join(known.select("word"), "word", "left_semi").groupBy("row").agg(F.collect_list("word").alias("more"))
        rows = rows.join(more, "row", "left").select("key", "text", "more")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            row, place, out, size = [], [], [], 0

            def given(row, place, out, b=b):
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(place, pa.int64()), pa.array(out, pa.string())], names=[key, "sentence", "text"])

            for i, body in enumerate(b.column(1)):
                more = None if whole else b.column(2)[i].as_py()
                got = cut(body.as_py() or "", words.union(more) if more else words)
                row += [i] * len(got)
                place += range(len(got))
                out += got
                size += sum(map(len, got))
                if size > GIVEN:
                    yield given(row, place, out)
                    row, place, out, size = [], [], [], 0
            yield given(row, place, out)

    return rows.mapInArrow(run, f"{key} {kind}, sentence long, text string")
