"""Benchmark decontamination with an FM-index for each shard of training words.

A shard is a run of consecutive words of a batch of documents (its neighbours overlap by a window less one word, so a window is
never cut).  Its suffix array gives the Burrows-Wheeler transform, kept as a wavelet matrix with ranks; suffix positions are
sampled.  All windows of the benchmark are searched backwards at once; their rows are located by stepping to a sampled suffix, and
the spans found are merged.  A shard lives in its task: one pass over the documents, no shuffle.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import reading, writing
from .shared import quoted, shared_dir, small_batches
from .textbuf import ALNUM, LOWER, chunks, hash_spans, trim, utf8, words

WINDOW = 10
#: Words of a shard, and bytes of benchmark texts that are sent at once; a larger benchmark is searched in blocks, each read from a file.
SHARD_WORDS, BLOCK_BYTES = 1 << 18, 16 << 20
SAMPLE = 8


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Of an array whose last symbol is 0 and occurs nowhere else: prefix doubling over what is still tied."""
    n = len(t)
    bits = max(1, int(t.max()).bit_length())
    width = max(1, min(4, 62 // bits))
    key = np.zeros(n, np.int64)
    for k in range(width):
        key <<= bits
        key[: n - k] |= t[k:]
    sa = np.argsort(key)
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(key[sa[1:]], key[sa[:-1]], out=new[1:])
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = head
    alone = new & np.concatenate([new[1:], [True]])
    open_at = np.flatnonzero(~alone)
    h = width
    while len(open_at):
        s = sa[open_at]
        key = rank[s] * n + rank[np.minimum(s + h, n - 1)]
        order = np.argsort(key, kind="stable")
        s, key = s[order], key[order]
        sa[open_at] = s
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[s] = open_at[np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))]
        alone = new & np.concatenate([new[1:], [True]])
        open_at = open_at[~alone]
        h *= 2
    return sa


class Bits:
    """A bit vector with ranks."""

    def __init__(self, bits: np.ndarray):
        packed = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        packed[: -(-len(bits) // 8)] = np.packbits(bits, bitorder="little")
        self.words = packed.view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.int32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """How many ones before i."""
        w = i >> 6
        low = self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[w].astype(np.int64) + np.bitwise_count(low)

    def at(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class FMIndex:
    """Of word numbers from 1; number 0 ends the shard."""

    def __init__(self, t: np.ndarray, sample: int = SAMPLE):
        t = np.concatenate([t, [0]])
        self.n, self.sample = len(t), sample
        sa = suffix_array(t)
        bwt = t[sa - 1].astype(np.int32)
        self.levels = max(1, int(t.max()).bit_length())
        self.first = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=1 << self.levels))])
        marked = sa % sample == 0
        self.marked, self.samples = Bits(marked), sa[marked]
        self.rows: list[Bits] = []
        self.zeros: list[int] = []
        for level in range(self.levels - 1, -1, -1):
            bit = (bwt & np.int32(1 << level)) != 0
            self.rows.append(Bits(bit))
            zeros = self.n - int(self.rows[-1].before[-1])
            self.zeros.append(zeros)
            if level:
                parted = np.empty_like(bwt)
                np.compress(~bit, bwt, out=parted[:zeros])
                np.compress(bit, bwt, out=parted[zeros:])
                bwt = parted

    def rank(self, c: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
        """How many c the transform has before each end."""
        at = [np.zeros(len(c), np.int64), *ends]
        for k, (bits, zeros) in enumerate(zip(self.rows, self.zeros, strict=True)):
            one = (c >> (self.levels - 1 - k)) & 1 == 1
            for j, i in enumerate(at):
                ones = bits.ones(i)
                at[j] = np.where(one, zeros + ones, i - ones)
        return [x - at[0] for x in at[1:]]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of all patterns (rows of numbers, padded at the end), stepping backwards."""
        lo, hi = np.zeros(len(lengths), np.int64), np.full(len(lengths), self.n, np.int64)
        for step in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((lengths > step) & (lo < hi))
            c = patterns[live, lengths[live] - 1 - step]
            a, b = self.rank(c, lo[live], hi[live])
            lo[live], hi[live] = self.first[c] + a, self.first[c] + b
        return lo, hi

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Positions of suffixes, by stepping back until one is sampled."""
        out, steps, who = np.zeros(len(row), np.int64), 0, np.arange(len(row))
        while len(who):
            done = self.marked.at(row)
            out[who[done]] = self.samples[self.marked.ones(row[done])] + steps
            who, row = who[~done], row[~done]
            c, i, start = np.zeros(len(row), np.int64), row.copy(), np.zeros(len(row), np.int64)
            for bits, zeros in zip(self.rows, self.zeros, strict=True):
                one = bits.at(i)
                a, b = bits.ones(i), bits.ones(start)
                i, start = np.where(one, zeros + a, i - a), np.where(one, zeros + b, start - b)
                c = c * 2 + one
            row = self.first[c] + i - start
            steps += 1
        return out


@dataclass
class Phrases:
    """Words of all items one after the other; start, length and item of each window; ids: of each item, as text."""

    hashes: np.ndarray
    start: np.ndarray
    length: np.ndarray
    item: np.ndarray
    ids: list[str]


def phrases(ids: list, texts: pa.Array, window: int = WINDOW) -> Phrases:
    buf, off = utf8(texts)
    w = words(LOWER[buf], off, ALNUM)
    n = w.counts
    wins = np.where(n > 0, np.maximum(n - window + 1, 1), 0)
    item = np.repeat(np.arange(len(n)), wins)
    start = w.off[:-1][item] + np.arange(wins.sum()) - np.repeat(np.cumsum(wins) - wins, wins)
    return Phrases(hash_spans(w.buf, w.start, w.end), start, np.minimum(n, window)[item], item, ["null" if i is None else str(i) for i in ids])


class Shard:
    """A shard of word hashes, where 0 parts documents, and its index: built once, searched for one block of phrases after the other."""

    def __init__(self, tokens: np.ndarray):
        self.vocabulary, t = np.unique(tokens, return_inverse=True)
        self.index = FMIndex(t.ravel() + 1)

    def search(self, p: Phrases, window: int) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position) of every occurrence."""
        place = np.minimum(np.searchsorted(self.vocabulary, p.hashes), len(self.vocabulary) - 1)
        known = np.concatenate([[0], np.cumsum(self.vocabulary[place] == p.hashes)])
        which = np.flatnonzero(known[p.start + p.length] - known[p.start] == p.length)
        if not len(which):
            return which, which
        at = np.minimum(p.start[which][:, None] + np.arange(window)[None, :], len(place) - 1)
        lo, hi = self.index.search(place[at] + 1, p.length[which])
        n = hi - lo
        row = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(which, n), self.index.locate(row)


#: Shards whose indexes are held at once.
SHARDS_HELD = 4


def search_texts(column: pa.Array, phrases_of: Phrases | Callable[[], Iterable[Phrases]], window: int = WINDOW, shard_words: int = SHARD_WORDS):
    """For each text: number of words, start and end bytes of hit words, items found; by shards of shard_words words.

    phrases_of: the phrases, or a function that gives them block by block.
    """
    blocks = (lambda: (phrases_of,)) if isinstance(phrases_of, Phrases) else phrases_of
    buf, off = utf8(column)
    rows = len(off) - 1
    n_words, hits, items = np.zeros(rows, np.int64), [[] for _ in range(rows)], [set() for _ in range(rows)]
    for r0, r1 in chunks(off, 8 * shard_words):
        base = off[r0]
        w = words(LOWER[buf[base : off[r1]]], off[r0 : r1 + 1] - base, ALNUM)
        n = w.counts
        n_words[r0:r1] = n
        if not len(w.start):
            continue
        row = np.repeat(np.arange(r1 - r0), n)
        place = np.arange(len(row)) + row  # a 0 after each document
        tokens = np.zeros(len(row) + r1 - r0, np.uint64)
        h = hash_spans(w.buf, w.start, w.end)
        tokens[place] = np.where(h == 0, 1, h)
        word_at = np.zeros(len(tokens), np.int64)
        word_at[place] = np.arange(len(row))
        cover = np.zeros(len(tokens) + 1, np.int64)
        starts = range(0, max(1, len(tokens) - window + 1), max(1, shard_words - window + 1))
        for g in range(0, len(starts), SHARDS_HELD):
            shards = [(s, Shard(tokens[s : s + shard_words])) for s in starts[g : g + SHARDS_HELD]]
            for p in blocks():
                for s, shard in shards:
                    which, pos = shard.search(p, window)
                    if not len(which):
                        continue
                    pos = pos + s
                    for x in np.unique(row[word_at[pos]] * len(p.ids) + p.item[which]).tolist():
                        items[r0 + x // len(p.ids)].add(p.ids[x % len(p.ids)])
                    np.add.at(cover, pos, 1)
                    np.add.at(cover, pos + p.length[which], -1)
        hit = np.flatnonzero(np.cumsum(cover[:-1])[place] > 0)
        lead = base - off[r0 : r1 + 1]
        for i in hit.tolist():
            r = int(row[i])
            hits[r0 + r].append((int(w.start[i] + lead[r]), int(w.end[i] + lead[r])))
    return n_words, hits, items


_FOUND = "_n_words long, _n_hit long, _items array<string>, _starts array<long>, _ends array<long>"


def _blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Callable[[], Iterable[Phrases]]:
    """The benchmark's phrases for the tasks: sent at once, or where they have more than block_bytes as files of about so many each in the
    shared folder, which a task reads one at a time."""
    spark = benchmark.sparkSession
    size = benchmark.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = -(-int(size) // block_bytes) or 1
    rows = benchmark.select("item_id", "text")
    some = lambda k: rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
    made = (phrases(got.column("item_id").to_pylist(), got.column("text"), window) for got in (some(k).toArrow() for k in range(n)))
    if n == 1:
        sent = spark.sparkContext.broadcast(next(made))  # at most block_bytes of benchmark text
        return lambda: (sent.value,)
    path = shared_dir(spark, "phrases")
    for k, p in enumerate(made):
        with writing(f"{path}/{k}") as out:
            pickle.dump(p, out)

    def read():
        for k in range(n):
            with reading(f"{path}/{k}") as f:
                yield pickle.loads(f.read())

    return read


def _search(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int, shard_words: int, block_bytes: int, cut: bool = False) -> DataFrame:
    """keep's columns and the text with what was found; cut: with the texts cut and _n_hit alone."""
    small_batches(docs.sparkSession)
    blocks = _blocks(benchmark, window, block_bytes)
    carried = [f"_c{i}" for i in range(len(keep))] + ["_text"]
    docs = docs.select(*[F.col(quoted(c)).alias(f"_c{i}") for i, c in enumerate(keep)], F.col("text").alias("_text"))

    def run(batches):
        for b in batches:
            n_words, hits, items = search_texts(b.column("_text"), blocks, window, shard_words)
            cols = [b.column(c) for c in carried]
            if cut:
                yield pa.RecordBatch.from_arrays([*cols[:-1], cut_texts(cols[-1], hits), pa.array([len(x) for x in hits], pa.int64())], names=[*carried, "_n_hit"])
                trim()
                continue
            cols += [pa.array(n_words), pa.array([len(x) for x in hits], pa.int64()), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
            cols += [pa.array([[y[k] for y in x] for x in hits], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(cols, names=[*carried, "_n_words", "_n_hit", "_items", "_starts", "_ends"])
            trim()

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, _n_hit long" if cut else f"{schema}, {_FOUND}")


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, starts, ends) for every row of docs.

    A document word is hit if it lies in an occurrence of window consecutive words of an item (or of all words of a shorter one).
    starts and ends are the hit words' bytes in the text.  Null texts have no words; items without words find nothing; items that
    repeat an item_id count as one; a null item_id is named "null".  Rows that repeat are each searched, and texts of any length are
    searched whole.  An empty table gives an empty result, and an empty benchmark hits nothing; other columns are not read.
    """
    out = _search(docs.select("doc_id", "text"), benchmark, ["doc_id"], window, shard_words, block_bytes)
    return out.select(
        F.col("_c0").alias("doc_id"),
        F.col("_n_words").alias("n_words"),
        F.col("_n_hit").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("_n_hit") > 0).alias("contaminated"),
        F.col("_items").alias("items"),
        F.col("_starts").alias("starts"),
        F.col("_ends").alias("ends"),
    )


_OUTSIDE = bytes(np.flatnonzero(~ALNUM[LOWER]).astype(np.uint8))


def cut_spans(text: str | None, starts, ends) -> str | None:
    """text without the hit words at these bytes; hit words with no other word between them go as one span."""
    if not len(starts):
        return text
    raw, out, at = text.encode(), [], 0
    for i, (s, e) in enumerate(zip(starts, ends, strict=True)):
        between = raw[at:s]
        if not i or between.translate(None, _OUTSIDE):
            out.append(between)
        at = e
    return b"".join([*out, raw[at:]]).decode()


def cut_texts(texts: pa.Array, hits: list[list[tuple[int, int]]]) -> pa.Array:
    """texts without their hit words; only texts with a hit become Python strings."""
    hit = [i for i, x in enumerate(hits) if x]
    if not hit:
        return texts
    new = [cut_spans(texts[i].as_py(), *zip(*hits[i], strict=True)) for i in hit]
    return pc.replace_with_mask(texts, pa.array([bool(x) for x in hits]), pa.array(new, texts.type))


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs, all columns, with the merged spans of hit words cut from the text.

    Texts without a hit stay as they are, null ones too.  Where n_chars is a column it is counted anew for texts that changed.
    """
    cols = docs.columns
    others = [c for c in cols if c != "text"]
    out = _search(docs, benchmark, others, window, shard_words, block_bytes, cut=True)
    at = {c: f"_c{i}" for i, c in enumerate(others)} | {"text": "_text"}
    counted = F.when(F.col("_n_hit") > 0, F.length("_text").cast(dict(docs.dtypes).get("n_chars", "long")))
    return out.select(*[(F.coalesce(counted, F.col(at[c])) if c == "n_chars" else F.col(at[c])).alias(c) for c in cols])
