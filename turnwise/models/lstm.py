"""A stacked LSTM encoder and decoder with given weights, as batch scoring over encoded pairs: one pass, no shuffle, batches of bounded size.

Cells have gates in the order input, candidate, forget, output.  The encoder reads the reversed input; its last states begin the
decoder, which reads the targets moved one place to the right; a linear layer without bias projects what comes out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Places that the static form reads, whatever the lengths.
STATIC_STEPS = 21
#: Rows that are scored together.
ROWS = 64


@dataclass(frozen=True)
class Layer:
    """kernel: (inputs + size) x 4 size; bias: 4 size."""

    kernel: np.ndarray
    bias: np.ndarray


@dataclass(frozen=True)
class Seq2Seq:
    """embedding: ids x size; projection: last size x outputs; softmax: outputs x ids."""

    embedding: np.ndarray
    encoder: tuple[Layer, ...]
    decoder: tuple[Layer, ...]
    projection: np.ndarray
    softmax: np.ndarray


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def lstm(x: np.ndarray, lengths: np.ndarray, layers: tuple[Layer, ...], state=None, dropout: float = 0.0, rng: np.random.RandomState | None = None):
    """(outputs, states (c, h) of each layer) of x, batch x time x size; rows stop at their length.

    dropout: the share of each layer's inputs that is left out, where rng is given (training).
    """
    batch, time = x.shape[:2]
    sizes = [len(layer.bias) // 4 for layer in layers]
    state = [(np.zeros((batch, n)), np.zeros((batch, n))) for n in sizes] if state is None else list(state)
    out = np.zeros((batch, time, sizes[-1]))
    for t in range(time):
        live = (t < lengths)[:, None]
        now = x[:, t]
        for k, layer in enumerate(layers):
            c, h = state[k]
            if rng is not None and dropout:
                now = now * (rng.uniform(size=now.shape) >= dropout) / (1 - dropout)
            gates = np.concatenate([now, h], axis=1) @ layer.kernel + layer.bias
            i, j, f, o = np.split(gates, 4, axis=1)
            new_c = sigmoid(f) * c + sigmoid(i) * np.tanh(j)
            new_h = sigmoid(o) * np.tanh(new_c)
            state[k] = (np.where(live, new_c, c), np.where(live, new_h, h))
            now = new_h
        out[:, t] = np.where(live, now, 0)
    return out, state


def padded(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(r) for r in rows], np.int64)
    out = np.zeros((len(rows), int(lengths.max(initial=0))), np.int64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out, lengths


def encode(m: Seq2Seq, inputs: list[list[int]]):
    """States after the reversed inputs."""
    ids, lengths = padded([r[::-1] for r in inputs])
    return lstm(m.embedding[ids], lengths, m.encoder)[1]


def project(m: Seq2Seq, inputs: list[list[int]], targets: list[list[int]], steps: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(projected outputs, lengths) for each place of the targets; steps: so many places of either side are read, no more."""
    if steps is not None:
        inputs, targets = [r[::-1][:steps][::-1] for r in inputs], [r[:steps] for r in targets]
    states = encode(m, inputs)
    shifted, lengths = padded([[0, *r[:-1]] if r else [] for r in targets])
    zero = (shifted == 0)[:, :, None] & (np.arange(shifted.shape[1]) == 0)[None, :, None]
    embedded = np.where(zero, 0, m.embedding[shifted])  # the first place reads nothing
    return lstm(embedded, lengths, m.decoder, states)[0] @ m.projection, lengths


def log_probabilities(m: Seq2Seq, inputs: list[list[int]], targets: list[list[int]], steps: int | None = None) -> list[list[float]]:
    """Natural logarithms of each target id's probability."""
    out, lengths = project(m, inputs, targets, steps)
    z = out @ m.softmax
    z = z - z.max(-1, keepdims=True) if z.size else z
    z = z - np.log(np.exp(z).sum(-1, keepdims=True))
    return [[float(z[k, t, targets[k][t]]) for t in range(n)] for k, n in enumerate(lengths)]


def _batches(b):
    for at in range(0, b.num_rows, ROWS):
        yield b.slice(at, ROWS)


def score(encoded: DataFrame, model: Seq2Seq, steps: int | None = None) -> DataFrame:
    """(ordinal, logps) of encoded pairs (ordinal, inputs, targets): each target id's log probability.  The model is sent once."""
    sent = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for b in _batches(whole):
                got = log_probabilities(sent.value, b.column(1).to_pylist(), b.column(2).to_pylist(), steps)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.float64()))], names=["ordinal", "logps"])

    return encoded.select(F.col("ordinal").cast("long"), "inputs", "targets").mapInArrow(run, "ordinal long, logps array<double>")


def encoder_states(encoded: DataFrame, model: Seq2Seq) -> DataFrame:
    """(id, vector) of encoded utterances (id, inputs): the last layer's last output, as a sentence vector to cluster by."""
    sent = encoded.sparkSession.sparkContext.broadcast(model)
    kind = dict(encoded.dtypes)["id"]

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for b in _batches(whole):
                h = encode(sent.value, b.column(1).to_pylist())[-1][1]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h.tolist(), pa.list_(pa.float64()))], names=["id", "vector"])

    return encoded.select("id", "inputs").mapInArrow(run, f"id {kind}, vector array<double>")


def learning_rate(base: float, decay: float, least: float = 0.0, replicas: int = 1) -> float:
    """base times decay, not under least, over the square root of the number of replicas."""
    return max(base * decay, least) / replicas**0.5
