"""Quality classifier: supervised subword embeddings, trained by stochastic gradient descent in numpy.

A text's features are its words, its word n-grams and the character n-grams of its words (n-grams of bytes, word borders included),
all hashed into ``buckets``, and patterns: of a word and the one k places before, whether they are the same, for small k.  Learned
vectors of the features are averaged and go through a softmax over the two classes.  Since the average and the last layer are linear,
a trained model scores a text from one number for each bucket, so every text is scored whole in one pass without a join; what
executors get is 4 bytes x buckets, a fixed size.

Features are chosen by a split inside the training fold, never by the held-out one: of its rows at 0.1, a quarter by hash set aside, 627 of
647 come out right with words and character n-grams, 627 with word pairs too, 643 with patterns too.

Training texts become bags of features on executors, which write them to files of some texts each.  The driver takes them file by file,
in another order every epoch, and keeps those that fit in KEPT_BYTES from one epoch to the next.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .files import reading, writing
from .shared import shared_dir, small_batches
from .textbuf import NOT_SPACE, chunks, hash_spans, mix, trim, utf8, words

#: At most so many labelled ids of each class are learned from, those with the smallest hashes; their texts are read whole.
MAX_PER_CLASS = 1500
FOLDS, HELD_OUT = 3, 1
SEED = 13
#: Labelled texts in a file of bags, about; a bag has a number for each bucket at most.
FILE_TEXTS, KEPT_BYTES = 50, 128 << 20


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 18
    dim: int = 8
    ngrams: tuple[int, ...] = (3, 4)
    word_ngrams: tuple[int, ...] = (2,)
    lags: int = 6
    epochs: int = 12
    rate: float = 0.5
    batch: int = 16
    decay: float = 1e-5


def feature_ids(buf: np.ndarray, off: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each feature, row of each feature), by kind of feature and then by row."""
    w = words(buf, off)
    shift = np.uint64(64 - (s.buckets.bit_length() - 1))
    tokens = hash_spans(buf, w.start, w.end)
    of_word = np.repeat(np.arange(len(off) - 1), w.counts)
    ids, rows = [(tokens >> shift).astype(np.int64)], [of_word]
    for n in s.word_ngrams:
        m = max(0, len(tokens) - n + 1)
        code = np.full(m, n, np.uint64)
        for k in range(n):
            code = mix(code + tokens[k : k + m])
        at = np.flatnonzero(of_word[:m] == of_word[n - 1 : n - 1 + m]) if m else np.zeros(0, np.int64)
        ids.append((code[at] >> shift).astype(np.int64))
        rows.append(of_word[at])
    for k in range(1, s.lags + 1):
        same = np.flatnonzero((tokens[k:] == tokens[:-k]) & (of_word[k:] == of_word[:-k])) + k
        ids.append(np.full(len(same), int(mix(np.array([k], np.uint64))[0] >> shift)))
        rows.append(of_word[same])
    inside = NOT_SPACE[buf]
    wide = np.where(inside, buf, 32).astype(np.uint64) + np.uint64(1)
    n_bytes = len(buf)
    if n_bytes:
        edge = np.zeros(n_bytes + 1, bool)
        edge[off] = True  # rows meet here
        row = np.repeat(np.arange(len(off) - 1), np.diff(off))
        for n in s.ngrams:
            m = n_bytes - n + 1
            if m <= 0:
                continue
            code = np.full(m, n, np.uint64)
            ok = np.ones(m, bool)
            for k in range(n):
                code = code * np.uint64(257) + wide[k : k + m]
                if 0 < k < n - 1:
                    ok &= inside[k : k + m]
                if k:
                    ok &= ~edge[k : k + m]
            ok &= inside[:m] | inside[n - 1 : n - 1 + m]
            at = np.flatnonzero(ok)
            ids.append((mix(code[at]) >> shift).astype(np.int64))
            rows.append(row[at])
    return np.concatenate(ids), np.concatenate(rows)


def bags(texts: pa.Array, s: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the distinct buckets and their shares of its features."""
    buf, off = utf8(texts)
    out = []
    for i in range(len(off) - 1):
        ids, _ = feature_ids(buf[off[i] : off[i + 1]], np.array([0, off[i + 1] - off[i]]), s)
        n = np.bincount(ids, minlength=1) if len(ids) else np.zeros(1, np.int64)
        at = np.flatnonzero(n)
        out.append((at, (n[at] / max(1, len(ids))).astype(np.float32)))
    return out


@dataclass
class Model:
    """vectors: buckets x dim; weights: dim x 2; bias: 2.  logit: what a bucket adds to log odds of class 1."""

    settings: Settings
    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    @property
    def logit(self) -> np.ndarray:
        return (self.vectors @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float32)

    @property
    def prior(self) -> float:
        return float(self.bias[1] - self.bias[0])


class Bags:
    """Examples in files of a shared folder; those that fit in kept_bytes are read once, others each time their file's turn comes."""

    def __init__(self, path: str, files: list[tuple[int, int]], kept_bytes: int = KEPT_BYTES):
        """files: (name, number of examples) of each file."""
        self.path, self.names, self.kept_bytes = path, [name for name, _ in files], kept_bytes
        self.ends = np.cumsum([n for _, n in files], dtype=np.int64)
        self.starts = self.ends - [n for _, n in files]
        self.kept: dict[int, list] = {}
        self.latest: tuple[int, list] = (-1, [])

    def groups(self) -> list[np.ndarray]:
        """Numbers of the examples that are in a file together."""
        return [np.arange(a, b) for a, b in zip(self.starts, self.ends, strict=True)]

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        g = int(np.searchsorted(self.ends, i, side="right"))
        if g in self.kept:
            return self.kept[g][i - self.starts[g]]
        if self.latest[0] != g:
            self.latest = (-1, [])  # let go of the file before
            with reading(f"{self.path}/{self.names[g]}", random=True) as f:
                got = pa.ipc.open_file(f).read_all()
            bags_of = [(np.frombuffer(a, np.int32), np.frombuffer(b, np.float32)) for a, b in zip(got.column("ids").to_pylist(), got.column("share").to_pylist(), strict=True)]
            self.latest = (g, bags_of)
            self.kept_bytes -= (size := sum(a.nbytes + b.nbytes for a, b in bags_of))
            if self.kept_bytes >= 0:
                self.kept[g] = bags_of
            else:
                self.kept_bytes += size
        return self.latest[1][i - self.starts[g]]


def train(examples: list[tuple[np.ndarray, np.ndarray]] | Bags, labels: np.ndarray, s: Settings = Settings()) -> Model:
    """Both classes weigh the same.  Without an example of either class every text scores 0.5."""
    rng = np.random.RandomState(SEED)
    vectors = rng.uniform(-1 / s.dim, 1 / s.dim, (s.buckets, s.dim)).astype(np.float32)
    weights, bias = np.zeros((s.dim, 2), np.float32), np.zeros(2, np.float32)
    weights[:, 1] = rng.uniform(-1, 1, s.dim)
    counts = np.bincount(labels, minlength=2) if len(labels) else np.zeros(2, int)
    if counts.min() == 0:
        return Model(s, vectors * 0, weights, bias)
    weigh = (len(labels) / (2 * counts)).astype(np.float32)
    groups = examples.groups() if isinstance(examples, Bags) else [np.arange(len(labels))]
    epochs = int(min(60, max(s.epochs, 20_000 // len(labels))))
    steps, step = epochs * -(-len(labels) // s.batch), 0
    for _ in range(epochs):
        order = np.concatenate([rng.permutation(groups[g]) for g in rng.permutation(len(groups))])
        for at in range(0, len(order), s.batch):
            pick = order[at : at + s.batch]
            rate = s.rate * (1 - step / steps)
            step += 1
            held = [examples[i] for i in pick]
            hidden = np.stack([share @ vectors[ids] for ids, share in held])
            z = hidden @ weights + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), labels[pick]] -= 1
            p *= weigh[labels[pick]][:, None] / len(pick)
            back = p @ weights.T
            weights -= rate * (hidden.T @ p + s.decay * weights)
            bias -= rate * p.sum(0)
            for (ids, share), g in zip(held, back, strict=True):
                vectors[ids] -= (rate * len(pick)) * share[:, None] * g
    return Model(s, vectors, weights, bias)


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int")


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), max_per_class: int = MAX_PER_CLASS) -> Model:
    """A model of labels.quality from rows outside the held-out fold.

    Rows of labels without doc_id or with a quality other than 0 and 1 are left out; an id with several labels counts once, as the
    larger share of them says (a tie: left out).  Of several rows of docs with a labelled id, the text with the least hash is learned
    from, so reruns agree.  Null texts count as empty.  Without a row of either class the model scores every text 0.5.
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold_of(F.col("doc_id")) != HELD_OUT))
    known = known.groupBy("doc_id").agg(F.avg("quality").alias("share")).where("share <> 0.5")
    known = known.select("doc_id", (F.col("share") > 0.5).cast("int").alias("label"), F.xxhash64("doc_id", F.lit(SEED)).alias("h"))
    some = known.where("label = 0").orderBy("h", "doc_id").limit(max_per_class).unionByName(known.where("label = 1").orderBy("h", "doc_id").limit(max_per_class))
    # at most 2 x max_per_class ids are sent
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("h", "label", F.xxhash64("text").alias("check"), "text")

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):  # one text at a time: a long one has many features
                ids, share = bags(b.column(3).slice(i, 1), settings)[0]
                yield pa.RecordBatch.from_arrays(
                    [b.column(k).slice(i, 1) for k in range(3)] + [pa.array([ids.astype(np.int32).tobytes()], pa.binary()), pa.array([share.tobytes()], pa.binary())],
                    names=["h", "label", "check", "ids", "share"],
                )
            trim()

    bagged = rows.mapInArrow(run, "h long, label int, check long, ids binary, share binary")
    one = bagged.groupBy("h").agg(F.min(F.struct("check", "ids", "share", "label")).alias("r")).select("h", "r.label", "r.ids", "r.share")
    path = shared_dir(docs.sparkSession, "bags")

    def write(key, got):
        name, got = key[0].as_py(), got.sort_by("h")
        with writing(f"{path}/{name}") as out, pa.ipc.new_file(out, got.schema) as f:
            f.write_table(got, max_chunksize=1)
        return pa.table([pa.array([name], pa.int32()), pa.array([got.column("label").to_pylist()], pa.list_(pa.int32()))], names=["name", "labels"])

    files = F.pmod("h", F.lit(max(1, -(-2 * max_per_class // FILE_TEXTS)))).cast("int").alias("name")
    written = one.select(files, "h", "label", "ids", "share").groupBy("name").applyInArrow(write, "name int, labels array<int>")
    made = sorted(written.collect())  # a row for each file, a number for each id
    return train(Bags(path, [(r.name, len(r.labels)) for r in made]), np.array([x for r in made for x in r.labels], np.int64), settings)


def text_scores(column: pa.Array, logit: np.ndarray, prior: float, s: Settings) -> np.ndarray:
    """Probability of class 1 of each whole text; a text without features has the prior's."""
    buf, off = utf8(column)
    total, n = np.zeros(len(off) - 1), np.zeros(len(off) - 1)
    for r0, r1 in chunks(off, 1 << 18):
        ids, rows = feature_ids(buf[off[r0] : off[r1]], off[r0 : r1 + 1] - off[r0], s)
        total[r0:r1] = np.bincount(rows, weights=logit[ids], minlength=r1 - r0)
        n[r0:r1] = np.bincount(rows, minlength=r1 - r0)
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + prior, -40, 40)))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a column of scores, in one pass.  Null texts count as empty.  Nothing but the text is an input.

    name must be no column of docs yet.
    """
    if name.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"docs has a column {name} already")
    spark, s = docs.sparkSession, model.settings
    small_batches(spark)
    sent = spark.sparkContext.broadcast((model.logit, model.prior))  # 4 bytes x buckets

    text_at, names = docs.columns.index("text"), [*docs.columns, name]

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text_scores(b.column(text_at), *sent.value, s))], names=names)
            trim()

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs, rows that repeat and empty texts too.

    Equal texts have equal scores; null texts count as empty; a text without words has the classes' prior.  An empty table gives an
    empty result, and without labels every score is 0.5.  Other columns of docs and labels are not read.
    """
    model = fit(docs, labels, settings)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold_of(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
