"""The encoder and decoder against one step of one row at a time."""

import math

import numpy as np
import pytest

from turnwise.models import lstm as L


def model(rng, ids=7, size=4, hidden=(5, 3), outputs=6):
    def stack():
        sizes = [size, *hidden]
        return tuple(L.Layer(rng.normal(size=(a + b, 4 * b)), rng.normal(size=4 * b)) for a, b in zip(sizes, sizes[1:], strict=False))

    return L.Seq2Seq(rng.normal(size=(ids, size)), stack(), stack(), rng.normal(size=(hidden[-1], outputs)), rng.normal(size=(outputs, ids)))


def step(layers, x, state):
    for k, layer in enumerate(layers):
        c, h = state[k]
        g = [sum(v * layer.kernel[i][q] for i, v in enumerate([*x, *h])) + layer.bias[q] for q in range(len(layer.bias))]
        n = len(c)
        s = lambda v: 1 / (1 + math.exp(-v))
        c = [s(g[2 * n + i]) * c[i] + s(g[i]) * math.tanh(g[n + i]) for i in range(n)]
        x = h = [s(g[3 * n + i]) * math.tanh(c[i]) for i in range(n)]
        state[k] = (c, h)
    return x


def plain(m, inputs, targets):
    state = [([0.0] * (len(y.bias) // 4), [0.0] * (len(y.bias) // 4)) for y in m.encoder]
    for i in reversed(inputs):
        step(m.encoder, list(m.embedding[i]), state)
    vector, out = list(state[-1][1]), []
    for before, now in zip([None, *targets], targets, strict=False):
        h = step(m.decoder, [0.0] * m.embedding.shape[1] if before is None else list(m.embedding[before]), state)
        z = np.array(h) @ m.projection @ m.softmax
        out.append(z[now] - math.log(np.exp(z).sum()))
    return vector, out


def test_scores_and_states(spark):
    rng = np.random.RandomState(1)
    m = model(rng)
    pairs = [([2, 3, 1], [4, 1]), ([5], [1]), ([], [6, 0, 2, 1]), ([1, 2, 3, 4, 5, 6], [])]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "ordinal long, inputs array<int>, targets array<int>")
    scores = {r.ordinal: r.logps for r in L.score(df, m).collect()}
    states = {r.id: r.vector for r in L.encoder_states(df.withColumnRenamed("ordinal", "id"), m).collect()}
    for i, (a, b) in enumerate(pairs):
        vector, logps = plain(m, a, b)
        assert list(states[i]) == pytest.approx(vector) and list(scores[i]) == pytest.approx(logps)


def test_static_form_reads_so_many_places():
    m = model(np.random.RandomState(2))
    inputs, targets = [[k % 7 for k in range(30)]], [[(3 * k) % 7 for k in range(30)]]
    got = L.log_probabilities(m, inputs, targets, L.STATIC_STEPS)[0]
    assert got == pytest.approx(plain(m, inputs[0][-21:], targets[0][:21])[1])


def test_dropout_only_in_training():
    m = model(np.random.RandomState(3))
    x, n = np.ones((2, 3, 4)), np.array([3, 2])
    assert np.allclose(L.lstm(x, n, m.encoder, dropout=0.5)[0], L.lstm(x, n, m.encoder)[0])
    assert not np.allclose(L.lstm(x, n, m.encoder, dropout=0.5, rng=np.random.RandomState(0))[0], L.lstm(x, n, m.encoder)[0])


def test_learning_rate():
    assert L.learning_rate(0.2, 0.5, 0.15, 4) == pytest.approx(0.075)
