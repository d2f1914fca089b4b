"""What SQL can't express, against plain Python: the Katz model at two and three levels, and the whole pipeline."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from turnwise.llm import blocks, katz, licenses, mixing, queries, textbuf

DIR = "/root/testdata/sf0.001"
WORD, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}
BEGIN, END, UNKNOWN = ("begin",), ("end",), ("unknown",)


class PlainKatz:
    """Good-Turing discounts up to 5 and Katz backoff, one probability at a time."""

    def __init__(self, texts, order):
        self.grams = [None] + [Counter() for _ in range(order)]
        for text in texts:
            seq = tokens(text, order)
            for at in range(order - 1, len(seq)):
                for j in range(1, order + 1):
                    self.grams[j][tuple(seq[at - j + 1 : at + 1])] += 1
        self.d = [None] + [self.discounts(Counter(g.values())) for g in self.grams[1:]]
        self.after = [None] + [defaultdict(dict) for _ in range(order)]
        for j in range(1, order + 1):
            for g, r in self.grams[j].items():
                self.after[j][g[:-1]][g[-1]] = r
        self.vocabulary = [g[0] for g in self.grams[1]]

    @staticmethod
    def discounts(n):
        share = 6 * n[6] / n[1] if n[1] else 1
        out = {}
        for r in range(1, 6):
            x = ((r + 1) * n[r + 1] / (r * n[r]) - share) / (1 - share) if n[r] and share < 1 else -1
            out[r] = x if 0 < x <= 1 else 1 - 0.5 / r
        return out

    def p(self, context, word):
        j = len(context) + 1
        seen, d = self.after[j].get(context, {}), self.d[j]
        if not seen:
            return self.p(context[1:], word)
        c = sum(seen.values())
        freed = sum((1 - d[r]) * r for r in seen.values() if r <= 5)
        scale = 1 / c if freed > 0 else 1 / (c + 1)
        left = freed * scale if freed > 0 else scale
        if word in seen:
            r = seen[word]
            return (d.get(r, 1) if freed > 0 else 1) * r * scale
        if j == 1:
            return left
        return left * self.p(context[1:], word) / (1 - sum(self.p(context[1:], w) for w in seen))


def tokens(text, order):
    return [BEGIN] * (order - 1) + WORD.findall((text or "").translate(FOLD)) + [END]


@pytest.fixture(scope="module")
def corpus():
    """Frequent words, whose contexts are dealt by n-gram, and rare ones; held-out rows have words that training lacks."""
    rng = np.random.RandomState(5)
    texts = [" ".join(f"w{min(int(x), 400)}" for x in rng.zipf(1.4, rng.randint(1, 40))) for _ in range(150)]
    return [(i, t) for i, t in enumerate([*texts, None, "", "W1 w1 w2", texts[0], "never seen w1 before"])]


@pytest.mark.parametrize("order", [2, 3])
def test_katz(spark, corpus, order):
    held = {i for i, _ in corpus if i % 7 == 2 or i == len(corpus) - 1}
    model = PlainKatz([t for i, t in corpus if i not in held], order)
    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in katz.score(docs, ~docs.doc_id.isin(sorted(held)), order, block_bytes=4000).collect()}
    assert len(got) == len(corpus)
    n = sum(model.grams[1].values())
    for i, text in corpus:
        seq = tokens(text, order)
        places = range(order - 1, len(seq))
        known = [model.grams[1][(seq[at],)] for at in places]
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(places), sum(c > 0 for c in known), n)
        assert got[i].held_out == (i in held)
        assert got[i].base_score == pytest.approx(sum(math.log10((c + 1) / (n + len(model.vocabulary) + 1)) for c in known))
        assert got[i].score == pytest.approx(sum(math.log10(model.p(tuple(seq[at - order + 1 : at]), seq[at])) for at in places))


def test_katz_as_registered(spark, corpus, tmp_path):
    """op2_katz looks two words back."""
    model = PlainKatz([t for i, t in corpus if zlib.crc32(str(i).encode()) % katz.FOLDS != katz.HELD_OUT], 3)
    spark.createDataFrame(corpus, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.score for r in queries.op2_katz(spark, str(tmp_path)).collect()}
    for i, text in corpus:
        seq = tokens(text, 3)
        assert got[i] == pytest.approx(sum(math.log10(model.p(tuple(seq[at - 2 : at]), seq[at])) for at in range(2, len(seq))))


@pytest.mark.parametrize("order", [2, 3])
def test_plain_katz_sums_to_one(corpus, order):
    """The model that the operator is held to is itself normalised in every context."""
    model = PlainKatz([t for _, t in corpus], order)
    for context in list(model.after[order])[:200]:
        assert sum(model.p(context, w) for w in [*model.vocabulary, UNKNOWN]) == pytest.approx(1)


def test_hot_contexts_reach_most_ranges():
    """The n-grams of one context go to as many ranges as it has parts, and contexts of two words that begin alike to all of them."""
    grams = textbuf.mix(np.arange(200_000, dtype=np.uint64))
    context = np.full(len(grams), grams[5])
    for p in (36, 1000):
        hot = katz.part_keys(context, grams, np.ones(len(grams), np.int64), np.array([4 * p]))
        assert len(np.unique(hot)) == 4 * p and len(np.unique(blocks.range_of(np.sort(hot), p))) > 0.9 * p
        cold = katz.part_keys(katz.extended(context, grams), grams, np.zeros(len(grams), np.int64), np.zeros(0, np.int64))
        load = np.bincount(blocks.range_of(np.sort(cold), p), minlength=p)
        assert load.min() > 0.5 * load.mean() and load.max() < 1.5 * load.mean()


def test_order_by_key():
    rng = np.random.RandomState(6)
    for low in (1 << 62, 1 << 21, 50):  # keys that differ in their last bits alone take the other way
        key = rng.randint(0, low, 3000).astype(np.uint64)[rng.randint(0, 1500, 3000)]
        n = rng.randint(0, 1 << 24, 3000)
        k = key[katz.by_key(key, n)]
        assert 1 + (k[1:] != k[:-1]).sum() == len(np.unique(key)) and (np.diff((k >> np.uint64(32)).astype(np.int64)) >= 0).all()


def test_order_by_sorted_numbers():
    """Places come with the numbers that are sorted, also where numbers differ in the bits alone that places take."""
    rng = np.random.RandomState(7)
    for n in (0, 1, 2, 5000):
        for g in (rng.randint(0, 1 << 62, n), rng.randint(0, 40, n), (1 << 62) + rng.randint(0, 1 << 14, n), rng.randint(0, 9, n) << 60 | rng.randint(0, 99, n)):
            g = g.astype(np.uint64) << np.uint64(1)
            order, s = katz.stable_order(g)
            assert (order == np.argsort(g, kind="stable")).all() and (s == np.sort(g)).all()


def test_katz_knows_distinct_grams():
    """A block keeps a probability of each distinct n-gram, not of each token."""
    t = katz.BlockTokens(pa.table({"text": ["a b a b a b", "a b", ""], "train": [True, True, False]}))
    one = katz.Scorer(t, [katz.Level([1, 1, 0, 0, 0, 0], np.zeros((1, katz.TOP + 2)), 10, 3)])
    distinct = len(np.unique(t.seq))
    assert distinct == 3 and len(t.seq) == 11
    one.first([(0, blocks.squeeze(blocks.planes(np.array([4, 4, 2]), np.arange(3, dtype=np.uint64))))])
    keys, extra, of, _, context, rest, gram = one.rows(2)
    # begin a, a b, b a, b end, begin end
    assert len(one.prob) == 3 and len(keys) == len(extra()) == len(context) == len(rest) == len(np.unique(gram)) == 5
    assert len(of) == 11 and len(np.unique(of)) == 5 and (np.diff(keys.astype(float)) >= 0).all()


def fingerprint(text):
    w = [x.encode() for x in WORD.findall((text or "").translate(FOLD))]
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
    n = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            n[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * n[b] > len(shingles))


def without_benchmark(text, windows):
    """text without runs of hit words, each from its first word's start to its last word's end."""
    found = list(ALNUM.finditer(text.translate(FOLD)))
    said = [m.group() for m in found]
    hit = {p for n in {len(w) for w in windows} for i in range(len(said) - n + 1) if tuple(said[i : i + n]) in windows for p in range(i, i + n)}
    out, at = [], 0
    for p in sorted(hit):
        if p - 1 not in hit:
            out.append(text[at : found[p].start()])
        at = found[p].end()
    return "".join([*out, text[at:]])


@pytest.fixture(scope="module")
def planted(tmp_path_factory):
    """The small tables, with near copies of some documents: a word more at the end."""
    path = tmp_path_factory.mktemp("planted")
    for name in ("labels", "benchmark"):
        pd.read_parquet(f"{DIR}/{name}.parquet").to_parquet(path / f"{name}.parquet")
    docs = pd.read_parquet(f"{DIR}/documents.parquet")
    more = docs[docs.text.str.len().between(2000, 10000)].copy()
    more["doc_id"] += 1_000_000
    more["text"] += " afterwards"
    pd.concat([docs, more]).to_parquet(path / "documents.parquet")
    return str(path)


def test_pipeline(spark, planted):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{planted}/documents.parquet").collect()}
    predicted = {r.doc_id: r.predicted for r in queries.op4_quality(spark, planted).collect()}
    left = {i: r for i, r in docs.items() if predicted[i] == 1}
    counts = [len(docs), len(left)]
    last = {}
    for i, r in sorted(left.items()):
        last[r.text or ""] = i
    left = {i: left[i] for i in last.values()}
    counts.append(len(left))
    prints = {i: fingerprint(r.text) for i, r in left.items()}
    root = {i: i for i in left}
    moved = True
    while moved:
        moved = False
        for i in left:
            low = min(root[k] for k in left if (prints[i] ^ prints[k]).bit_count() <= 3)
            if low < root[i]:
                root[i], moved = low, True
    left = {i: r for i, r in left.items() if root[i] == i}
    counts.append(len(left))
    assert counts == sorted(set(counts), reverse=True)  # each of the three stages drops some and keeps some
    items = [ALNUM.findall((r.text or "").translate(FOLD)) for r in spark.read.parquet(f"{planted}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for w in items if w for i in range(max(len(w) - 9, 1))}
    rows = [(i, None if r.text is None else without_benchmark(r.text, windows), r.source) for i, r in left.items()]
    assert any(text != left[i].text for i, text, _ in rows)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source"]))
    cols = ["doc_id", "size", "source_size", "target", "taken"]
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.SQL['op9_mixing']}) ORDER BY doc_id").fetchall()
    got = corpus_pipeline.run(spark, planted).select(cols).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")


def test_secrets_over_whole_documents(spark):
    """op3_secrets against plain patterns: every base span of every text, whole."""
    path = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in queries.op3_secrets(spark, path).collect()}
    assert set(got) == set(texts)
    seen = 0
    for i, t in texts.items():
        assign = [m for m in ASSIGN.finditer(t) if len(m.group(2)) >= 6]
        access = [m for m in ACCESS.finditer(t) if len(m.group()) >= 20]
        hexes = [m for m in HEX.finditer(t) if len(m.group()) >= 24]
        spans = sorted((m.start(), k, m.end()) for k, ms in enumerate((assign, access, hexes)) for m in ms)
        said = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{e}" for a, k, e in spans)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == (len(assign), len(access), len(hexes))
        assert got[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert set(said.split(",") if said else []) <= set(got[i].spans.split(","))
        seen += len(spans)
    assert seen > 10


def quotients(weights, seats):
    """Seats by the highest quotients w / (2k - 1), one at a time; ties to the first."""
    won = [0] * len(weights)
    for _ in range(seats):
        best = max(range(len(weights)), key=lambda i: (weights[i] / (2 * won[i] + 1), -i))
        won[best] += 1
    return won


def test_apportionment_is_by_highest_quotients(spark):
    rng = np.random.RandomState(4)
    groups = {g: [int(x) for x in rng.randint(0, 1000, rng.randint(1, 12))] for g in range(30)} | {99: [0, 0], 98: [5, 5, 5, 5]}
    seats = {g: int(rng.randint(0, 200)) if sum(w) else 0 for g, w in groups.items()} | {98: 6}
    rows = [(g, k, w, sum(ws), seats[g]) for g, ws in groups.items() for k, w in enumerate(ws)]
    df = spark.createDataFrame(rows, "g long, k long, w long, total long, seats long")
    got = {(r.g, r.k): r.quota for r in mixing.sainte_lague(df, ["g"], ["k"], F.col("w"), F.col("total"), F.col("seats")).collect()}
    for g, ws in groups.items():
        assert [got[g, k] for k in range(len(ws))] == quotients(ws, seats[g])


def test_license_file_cosines(spark):
    """The whole text's cosine to each full licence text, in plain Python."""
    files = licenses.file_templates()
    bags = [Counter(w for w in licenses.terms(t) if w not in licenses.STOP) for _, t in files]
    df = Counter(w for b in bags for w in b)
    idf = lambda w: math.log((1 + len(files)) / (1 + df[w])) + 1
    rng = np.random.RandomState(8)
    texts = []
    for _, t in files:
        words = t.split()
        for share in (0.02, 0.2, 0.5):
            texts.append(" ".join(w if rng.rand() > share else f"other{rng.randint(50)}" for w in words))
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: (r.is_license_file, r.own_score) for r in licenses.scan(docs).collect()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    vectors = [{w: c * idf(w) for w, c in b.items()} for b in bags]
    full = 0
    for i, t in enumerate(texts):
        v = {w: c * idf(w) for w, c in Counter(x for x in licenses.terms(t) if x not in licenses.STOP).items()}
        best = max(sum(x * u.get(w, 0) for w, x in v.items()) / (norm(v) * norm(u)) for u in vectors)
        assert got[i][0] == (round(best, 6) >= licenses.THRESHOLD)
        if got[i][0]:
            full += 1
            assert got[i][1] == pytest.approx(best, abs=2e-6)
    assert 10 < full < len(texts)
