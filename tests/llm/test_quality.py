"""The quality classifier against plain Python: a text's features, their mean, the softmax, and a training step by finite differences."""

import math

import numpy as np
import pyarrow as pa
import pytest

from turnwise.llm import quality
from turnwise.llm.textbuf import hash_spans

MASK = (1 << 64) - 1


def mixed(h):
    h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    h = (h ^ (h >> 27)) * 0x94D049BB133111EB & MASK
    return h ^ (h >> 31)


def plain_features(text, s):
    """Buckets of a text's words, of words in a row, of the places where a word comes again after k words, and of its words' n-grams with
    their borders."""
    raw, shift = text.encode(), 64 - (s.buckets.bit_length() - 1)
    words = [w for w in raw.replace(b"\t", b" ").replace(b"\n", b" ").split(b" ") if w]
    one = lambda w: int(hash_spans(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0])
    out = [one(w) >> shift for w in words]
    for n in s.word_ngrams:
        for i in range(len(words) - n + 1):
            code = n
            for w in words[i : i + n]:
                code = mixed(code + one(w) & MASK)
            out.append(code >> shift)
    for k in range(1, s.lags + 1):
        out += [mixed(k) >> shift for a, b in zip(words, words[k:]) if a == b]
    space = b" \t\n"
    for n in s.ngrams:
        for i in range(len(raw) - n + 1):
            part = raw[i : i + n]
            if any(b in space for b in part[1:-1]) or part[0] in space and part[-1] in space:
                continue
            code = n
            for b in part:
                code = (code * 257 + (32 if b in space else b) + 1) & MASK
            out.append(mixed(code) >> shift)
    return out


@pytest.mark.parametrize("text", ["", "a", "one two one two three", "tab\there  there\nthere", "é ü é", " lead and trail ", "x" * 5000 + " y " * 300])
@pytest.mark.parametrize("word_ngrams", [(2,), (2, 3), ()])
def test_a_text_s_score(text, word_ngrams):
    s = quality.Settings(buckets=1 << 10, dim=3, word_ngrams=word_ngrams)
    rng = np.random.RandomState(1)
    model = quality.Model(s, rng.normal(0, 1, (s.buckets, s.dim)).astype(np.float32), rng.normal(0, 1, (s.dim, 2)).astype(np.float32), np.array([0.2, -0.3], np.float32))
    ids = plain_features(text, s)
    mean = model.vectors[ids].astype(float).mean(0) if ids else np.zeros(s.dim)
    z = mean @ model.weights + model.bias
    want = math.exp(z[1]) / (math.exp(z[0]) + math.exp(z[1]))
    got = quality.text_scores(pa.array(["other text", text, None]), model.logit, model.prior, s)
    assert got[1] == pytest.approx(want, abs=1e-5)
    assert got[2] == pytest.approx(1 / (1 + math.exp(0.5)), abs=1e-6)
    (at, share), = quality.bags(pa.array([text]), s)
    if ids:
        assert dict(zip(at.tolist(), share.tolist())) == pytest.approx({i: ids.count(i) / len(ids) for i in set(ids)}, abs=1e-6)


def test_a_step_goes_down_the_gradient():
    """One step over all examples moves every number by its share of the loss' slope, found by trying both sides."""
    rng = np.random.RandomState(2)
    n = 20_000  # so many examples have one pass
    s = quality.Settings(buckets=16, dim=3, epochs=1, rate=1e-3, batch=n, decay=0.0)
    kinds = [(np.sort(rng.choice(16, 4, replace=False)), rng.dirichlet(np.ones(4)).astype(np.float32)) for _ in range(12)]
    which = rng.randint(0, 12, n)
    labels = (rng.rand(n) < 0.3 + 0.05 * which).astype(np.int64)
    model = quality.train([kinds[k] for k in which], labels, s)
    start = np.random.RandomState(quality.SEED)
    vectors = start.uniform(-1 / s.dim, 1 / s.dim, (s.buckets, s.dim))
    weights, bias = np.zeros((s.dim, 2)), np.zeros(2)
    weights[:, 1] = start.uniform(-1, 1, s.dim)
    weigh = n / (2 * np.bincount(labels))
    count = np.array([[np.sum((which == k) & (labels == c)) for c in (0, 1)] for k in range(12)])

    def loss(v, w, b):  # the mean over examples, each by its class' weight
        total = 0.0
        for k, (ids, share) in enumerate(kinds):
            z = share.astype(float) @ v[ids] @ w + b
            total -= sum(count[k, c] * weigh[c] * (z[c] - np.log(np.exp(z).sum())) for c in (0, 1))
        return total / n

    def slope(which_one, at, h=1e-5):
        parts = [vectors, weights, bias]
        sides = []
        for d in (h, -h):
            moved = [x.copy() for x in parts]
            moved[which_one][at] += d
            sides.append(loss(*moved))
        return (sides[0] - sides[1]) / (2 * h)

    for k, (before, after, factor) in enumerate([(vectors, model.vectors, n), (weights, model.weights, 1), (bias, model.bias, 1)]):  # vectors move by the sum
        for at in np.ndindex(before.shape):
            assert (before[at] - after[at]) / (s.rate * factor) == pytest.approx(slope(k, at), abs=2e-3)


def test_training_without_a_class():
    model = quality.train([(np.array([1]), np.array([1.0], np.float32))], np.array([1]), quality.Settings(buckets=4, dim=2))
    assert quality.text_scores(pa.array(["a b"]), model.logit, model.prior, model.settings)[0] == 0.5


def labelled(spark, n, text):
    docs = spark.createDataFrame([(i, text(i)) for i in range(n)], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(n)], "doc_id long, quality int")


def test_bags_are_read_file_by_file(spark, monkeypatch):
    """What fits in memory decides how often files are read, not what is learned; every labelled text of the fold is learned from."""
    docs, labels = labelled(spark, 180, lambda i: f"{'good' if i % 3 else 'bad'} w{i} w{i % 7}")
    seen, reads = [], []
    opened, init = quality.reading, quality.Bags.__init__
    monkeypatch.setattr(quality, "reading", lambda uri, random=False: reads.append(uri) or opened(uri, random))

    def fit(kept):
        monkeypatch.setattr(quality.Bags, "__init__", lambda self, path, files: seen.append(files) or init(self, path, files, kept))
        reads.clear()
        model = quality.fit(docs.repartition(5), labels, quality.Settings(buckets=1 << 10, dim=3, epochs=2), 200)
        return model, len(reads), len(set(reads))

    whole, n, files = fit(1 << 30)
    assert n == files > 1
    for kept in (0, 4000):
        again, n, same = fit(kept)
        assert same == files < n
        assert np.array_equal(again.vectors, whole.vectors) and np.array_equal(again.weights, whole.weights)
    fold = {r.doc_id for r in docs.where(quality.fold_of(docs.doc_id) != quality.HELD_OUT).collect()}
    assert {sum(size for _, size in files) for files in seen} == {len(fold)}


def test_many_long_labelled_texts(spark):
    """Bags don't pass through Spark's results, so their sum may exceed the driver's bound on those: only names and labels do."""
    docs, labels = labelled(spark, 60, lambda i: " ".join(f"{'g' if i % 3 else 'b'}{i}x{k}" for k in range(20_000)))
    results = []
    collect = type(docs).collect
    try:
        type(docs).collect = lambda self: results.append(collect(self)) or results[-1]
        model = quality.fit(docs, labels, quality.Settings(epochs=1))
    finally:
        type(docs).collect = collect
    assert len(results) == 1 and len(str(results)) < 20_000
    assert model.vectors.any()
