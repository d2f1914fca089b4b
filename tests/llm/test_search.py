"""Ranked search, pieces and source divergence against plain Python: nulls, ties, repeats, long texts, empty tables, other columns."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from turnwise.llm import divergence, lexical, pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text, pattern=r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"):
    return [x.translate(UPPER) for x in re.findall(pattern, text or "")]


def plain_ranking(docs, items, k=50):
    """(item_id, rank, doc_id, score) by the definition; ties by id, nulls last."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    full = [c for _, c in counts if c]
    n_docs, n_terms = len(full), sum(sum(c.values()) for c in full)
    df = Counter(t for c in full for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            m = 50 + 50 * sum(c.values()) * n_docs // max(1, n_terms)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scored.append((-s, i is None, i if i is not None else 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def many_documents():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["Éa", "éa", "ABC", "中文", "x9"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 40))) + "!") for i in range(300)]
    docs += [(400 + i, "same text w1 w2") for i in range(80)]  # ties over the cut
    return docs + [(7, "w1"), (7, "w1"), (None, "w2 w3"), (None, None), (500, ""), (501, None), (502, "- . -"), (503, "w5 " * 60_000)]


ITEMS = [(1, "W1 w1 w2 zzz"), (1, "w3"), (2, None), (3, ""), (None, "éa 中文"), (4, "nothing there"), (5, "w5 ABC x9 same")]


@pytest.mark.parametrize("shard_bytes,block", [(1 << 20, 2048), (2_000, 2)])
def test_ranking(spark, monkeypatch, shard_bytes, block):
    monkeypatch.setattr(lexical, "BLOCK_QUERIES", block)
    docs = many_documents()
    table = spark.createDataFrame([(i, t, "s", 1, "q") for i, t in docs], "doc_id long, text string, score string, rank int, query string").repartition(5)
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, doc_id string")
    got = lexical.rank(table, items, shard_bytes=shard_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_ranking(docs, ITEMS)


def test_ranking_of_nothing(spark):
    docs = spark.createDataFrame([("a", "b c"), ("b", "b")], "doc_id string, text string")
    items = spark.createDataFrame([(1, "b")], "item_id int, text string")
    assert [r.doc_id for r in lexical.rank(docs, items).collect()] == ["b", "a"]  # ids of any type
    assert lexical.rank(docs.limit(0), items).count() == 0
    assert lexical.rank(docs, items.limit(0)).count() == 0


def test_best_rows_are_told_apart_by_place():
    rng = np.random.RandomState(0)
    for _ in range(200):
        score = rng.randint(0, 4, rng.randint(0, 30)).astype(np.int64)
        want = sorted((i for i in range(len(score)) if score[i] > 0), key=lambda i: (-score[i], i))[:5]
        assert sorted(lexical.best_rows(score, 5).tolist()) == sorted(want)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def hard_texts():
    rng = random.Random(5)
    parts = ["a", "b", "the ", "ing", " ", "  ", "▁", "é", "€", "𐍈", "\n", "\t", "\x00", "<s>", "</s>", "<0x0A>", "0", "12", "ﬁ", "中", "文的", "　", "==", "####", "ĳ"]
    return ["", None, " ", " " * 50, "a" * 3000, "中文" * 800, "=" * 2000 + " " * 3000, "x" * 64, "x" * 65] + ["".join(rng.choices(parts, k=rng.randint(1, 60))) for _ in range(1500)]


def test_pieces_are_the_library_s(spark, library):
    texts = hard_texts()
    docs = spark.createDataFrame([(i, t, "n", [1]) for i, t in enumerate(texts)] + [(None, "the", "n", [1])], "doc_id long, text string, decoded string, ids array<int>").repartition(3)
    got = {r.doc_id: r for r in pieces.round_trip(docs, MODEL).collect()}
    assert len(got) == len(texts) + 1
    for i, t in [*enumerate(texts), (None, "the")]:
        want = library.encode(t or "", add_bos=True, add_eos=True)
        assert got[i].ids == want, t
        assert got[i].packed == np.array(want, "<u4").tobytes()
        assert got[i].decoded == library.decode(want)
    assert {r.doc_id: r.ids for r in pieces.encode(docs, MODEL).collect()} == {i: r.ids for i, r in got.items()}


def test_pieces_of_whole_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in pieces.digests(pieces.round_trip(docs, MODEL)).collect()}
    for r in docs.collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
        assert tuple(got[r.doc_id])[1:] == want


def test_decoding_of_any_ids(spark, library):
    rng = random.Random(7)
    lists = [[], None, [1], [2], [0], [28705], [259, 1]] + [rng.choices(range(32000), k=rng.randint(0, 5)) + rng.choices(range(3, 260), k=rng.randint(0, 3)) for _ in range(400)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "place int, ids array<int>").repartition(2)
    got = {r.place: r.text for r in pieces.decode(rows, MODEL).collect()}
    assert got == {i: library.decode(x or []) for i, x in enumerate(lists)}
    valid = [x for x in lists if x and all(i > 259 for i in x)]
    body = pieces.loaded(open(MODEL, "rb").read())
    assert body.decode(pa.array(valid, pa.list_(pa.int32()))).to_pylist() == library.decode(valid)


def test_pieces_when_memory_starts_anew(monkeypatch, library):
    monkeypatch.setattr(pieces, "UNITS", 20)
    monkeypatch.setattr(pieces, "PAIRS", 50)
    body = pieces.Pieces(open(MODEL, "rb").read())
    for k in range(0, 600, 100):
        some = hard_texts()[k : k + 100]
        assert body.encode(pa.array(some)).to_pylist() == [library.encode(t or "", add_bos=True, add_eos=True) for t in some]
    assert body.encode(pa.array([], pa.string())).to_pylist() == []


def plain_audit(rows):
    pattern = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
    rows = [(a or "", s or "", Counter(terms(t, pattern))) for a, s, t in rows]
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {a for a, _, _ in rows}:
        df = Counter(t for a, _, c in rows if a == lang for t in c)
        kept = [t for t, n in df.items() if n >= 10]
        of = {s: sum((c for a, x, c in rows if (a, x) == (lang, s)), Counter()) for s in {s for a, s, _ in rows if a == lang}}
        whole = sum(of.values(), Counter())

        def chance(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + math.floor(Fraction(10**9 * (c[t] + 2), total + 2 * len(kept))) for t in kept}

        q, p = chance(whole), {s: chance(c) for s, c in of.items()}
        for s in of:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in of if o != s))
            out += [(lang, s, "pair", o, -v, r) for r, (v, _, o) in enumerate(pairs, 1)]
            best = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if of[s][t] and p[s][t] > q[t])[:10]
            out += [(lang, s, "term", t, -v, r) for r, (v, _, t) in enumerate(best, 1)]
    return sorted(out)


def audited():
    rng = random.Random(11)
    words = [f"{a}{b}" for a in "abcdeé" for b in "xyzö"] + ["Common", "COMMON"]
    rows = [(rng.choice(["en", "de", None]), f"s{min(rng.randint(0, 9), 6)}", " ".join(rng.choices(words, [1 + i * i for i in range(len(words))], k=rng.randint(0, 30)))) for _ in range(250)]
    rows += [("en", None, "ax ay az"), ("en", "", "ax"), ("en", "empty", None), ("en", "ties", "bx by bz"), ("en", "Ties", "bx by bz"), ("fr", "few", "rare words"), ("fr", "fewer", ""), ("it", "alone", None), ("en", "digits", "1 2 3 ax1ay")]
    return rows + [("en", "s1", "ax " * 50_000)] + [("en", "copies", "cx cy")] * 30


@pytest.mark.parametrize("slices", [(1 << 13, 1 << 15, 1 << 18), (3, 7, 5)])
def test_divergence(spark, monkeypatch, slices):
    for name, n in zip(("SLICE", "POSTINGS", "HELD"), slices, strict=True):
        monkeypatch.setattr(divergence, name, n)
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in audited()], "lang string, source string, text string, term string, n int, total int").repartition(4)
    assert sorted(map(tuple, divergence.audit(docs).collect())) == plain_audit(audited())


def test_divergence_of_nothing(spark):
    docs = spark.createDataFrame([("en", "a", "b")], "lang string, source string, text string")
    assert divergence.audit(docs.limit(0)).count() == 0
    assert divergence.audit(docs).count() == 0  # one source, no kept term


def test_search_ends_early_and_is_right():
    rng = np.random.RandomState(1)
    n = np.sort(rng.zipf(1.3, 4000) % 5000 + 1)
    lang_n = n + rng.randint(0, 50, len(n)) * n
    names = np.array([f"t{i:05d}" for i in rng.permutation(len(n))], object)
    total, lang_total, types = int(n.sum()), int(lang_n.sum()), len(n)
    best, seen = divergence.best_first(n, lang_n, names, total, lang_total, types)
    p, q = divergence.probability(n, total, types), divergence.probability(lang_n, lang_total, types)
    want = sorted(((-int(divergence.divergence(a, b)), t) for a, b, t in zip(p, q, names) if a > b))[:10]
    assert best == [(-f, t) for f, t in want]
    assert seen < len(n) / 2


def test_probability_is_exact():
    for count, n, v in ((0, 0, 1), (10**12, 3 * 10**13, 10**7), (9 * 10**14, 10**15, 3), (5, 7, 2)):
        assert int(divergence.probability(count, n, v)) == 1 + 10**9 * (count + 2) // (n + 2 * v)
