"""SimHash near-duplicates: XXH64 shingle fingerprints, pigeonhole blocks, Hamming verification, components.

64 bits are cut into six blocks.  Fingerprints that differ in three bits or fewer agree in at least three whole blocks, so each of
the twenty choices of three blocks (31 to 33 bits) is a join key, and every close pair meets under one of them.  Only distinct
fingerprints are joined: copies count once.  What shares a key is compared in its task by Hamming distance; a key with many
fingerprints is cut into pieces whose pairs go to different tasks.  A piece gives one link from each fingerprint to the smallest
one it reaches there, never all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .shared import drop_shared, place, placed, rows_in, shared_dir, skew_join, small_batches, table
from .textbuf import LOWER, chunks, trim, utf8, words, xxh64

SHINGLE, DISTANCE, SEED = 3, 3, 42
_EDGES = [0, 11, 22, 33, 44, 54, 64]
BLOCKS = [((1 << b) - (1 << a)) for a, b in zip(_EDGES, _EDGES[1:], strict=False)]
MASKS = [sum(c) for c in combinations(BLOCKS, len(BLOCKS) - DISTANCE)]
#: A key's fingerprints are compared in pieces of about this many.
PIECE = 2048


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def text_fingerprints(column: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """uint64 fingerprint of each text (null: empty): words are runs of non-space bytes, A-Z lower-cased."""
    buf, off = utf8(column)
    buf = LOWER[buf]
    out = np.zeros(len(off) - 1, np.uint64)
    for r0, r1 in chunks(off, 1 << 20):
        base = off[r0]
        w = words(buf[base : off[r1]], off[r0 : r1 + 1] - base)
        n_words = w.counts
        if not len(w.start):
            continue
        size = w.end - w.start
        new_start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        joined = np.full(int(new_start[-1] + size[-1]), 32, np.uint8)
        inside = np.arange(size.sum()) + np.repeat(new_start - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        joined[inside] = w.buf[inside + np.repeat(w.start - new_start, size)]
        n = np.where(n_words > 0, np.maximum(n_words - shingle + 1, 1), 0)
        row = np.repeat(np.arange(len(n)), n)
        first = w.off[:-1][row] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        last = np.minimum(first + shingle - 1, w.off[1:][row] - 1)
        begin, end = new_start[first], new_start[last] + size[last]
        ones = np.zeros((len(n) + 1, 64), np.int64)
        at = 0
        while at < len(begin):  # pieces of shingles: 64 counters each
            to = min(len(begin), at + 65536)
            h = xxh64(joined[begin[at] : end[at:to].max()], begin[at:to] - begin[at], end[at:to] - begin[at], SEED)
            bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            heads = np.concatenate([[0], np.flatnonzero(np.diff(row[at:to])) + 1])
            ones[row[at:to][heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
            at = to
        majority = 2 * ones[:-1] > n[:, None]
        out[r0:r1] = np.packbits(majority, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs' columns but text, and fp: the fingerprint's 64 bits as a signed long."""
    others = [f for f in docs.schema.fields if f.name != "text"]
    names = [*(f.name for f in others), "fp"]

    def run(batches):
        for b in batches:
            fp = pa.array(text_fingerprints(b.column(b.num_columns - 1)).view(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], fp], names=names)
            trim()

    small_batches(docs.sparkSession)
    return docs.select(*names[:-1], "text").mapInArrow(run, StructType([*others, StructField("fp", LongType())]))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def piece_links(fps: np.ndarray, group: np.ndarray, side: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links (larger, smaller) among fingerprints of the same group, as few as keep what is connected there connected.

    fps and group are sorted by group; side 0 and 1 are the two pieces of a cut key, whose own pairs other groups compare too.
    """
    a, b = [], []
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([heads, [len(group)]]))
    small = np.repeat(size <= 16, size)
    idx = np.flatnonzero(small)
    for shift in range(1, 16):
        i = idx[: len(idx) - shift] if len(idx) > shift else idx[:0]
        i = i[i + shift < len(fps)]
        i = i[(group[i] == group[i + shift])]
        if not len(i):
            break
        close = i[_popcount(fps[i] ^ fps[i + shift]) <= distance]
        a.append(fps[close])
        b.append(fps[close + shift])
    for h, n in zip(heads[size > 16], size[size > 16], strict=True):
        x = fps[h : h + n]
        label = np.arange(n)
        near = np.empty((n, n), bool)
        for lo in range(0, n, 512):
            near[lo : lo + 512] = _popcount(x[lo : lo + 512, None] ^ x[None, :]) <= distance
        while True:
            new = label.copy()
            for lo in range(0, n, 512):
                new[lo : lo + 512] = np.where(near[lo : lo + 512], label[None, :], n).min(axis=1)
            new = new[new]
            if (new == label).all():
                break
            label = new
        far = label != np.arange(n)
        a.append(x[far])
        b.append(x[label[far]])
    if not a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    a, b = np.concatenate(a), np.concatenate(b)
    return np.maximum(a.view(np.int64), b.view(np.int64)), np.minimum(a.view(np.int64), b.view(np.int64))


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(u, v), u > v: links among the distinct fingerprints fps.fp that connect whatever is within distance of each other."""
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(MASKS)])
    rows = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.key")
    large = rows.groupBy("t", "key").count().where(F.col("count") > PIECE)
    large = table(large.select("t", "key", F.ceil(F.col("count") / (PIECE // 2)).cast("int").alias("pieces")), "large-keys")
    rows = rows.join(large, ["t", "key"], "left")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("pieces")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda x: F.struct(F.least(own, x).alias("i"), F.greatest(own, x).alias("j")))
    rows = rows.withColumn("pair", F.explode(F.when(F.col("pieces").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(pairs)))
    rows = rows.select("t", "key", "pair.i", "pair.j", "fp")
    parts = rows.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")

    def run(batches):
        held: list[pa.RecordBatch] = []

        def give(cols):
            t, key, i, j, fp = cols
            group = np.cumsum(np.concatenate([[0], (np.diff(t) != 0) | (np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)]))
            u, v = piece_links(fp.view(np.uint64), group, i, distance)
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            same = np.ones(len(cols[0]), bool)
            for c in cols[:4]:
                same &= c == c[-1]
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0  # the last group may go on
            held = [[c[cut:] for c in cols]]
            if cut:
                yield give([c[:cut] for c in cols])
        if held and len(held[0][0]):
            yield give([np.concatenate(x) for x in zip(*held, strict=True)])

    return parts.mapInArrow(run, "u long, v long").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of edges (u, v) reaches, by alternating large and small stars.

    Every round's links are a written table; the driver sees only their number and checksum.
    """
    spark = edges.sparkSession
    path = shared_dir(spark, "stars")

    def written(df: DataFrame, k: int) -> DataFrame:
        df.write.parquet(f"{path}/{k}")
        return spark.read.schema("u long, v long").parquet(f"{path}/{k}")

    def state(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    def star(df: DataFrame, large: bool) -> DataFrame:
        """Each node's neighbours (large: the larger ones, else the smaller ones and itself) link to the smallest of all of them."""
        both = df.unionByName(df.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else df
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        out = skew_join(both, low, ["u"], "n")
        if large:
            return out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        moved = out.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionByName(low.select("u", F.col("m").alias("v")).where("u <> v")).distinct()

    now, k = written(edges.where("u <> v").select("u", "v"), 0), 0
    seen = state(now)
    while seen[0] and k < 2 * max_rounds:
        now = written(star(now, True), k + 1)
        now = written(star(now, False), k + 2)
        k += 2
        got = state(now)
        if got == seen:
            break
        seen = got
    else:
        if seen[0]:
            raise RuntimeError(f"the links did not settle in {max_rounds} rounds")
    final = table(now.select(F.col("u").alias("node"), F.col("v").alias("root")), "roots")
    drop_shared(spark, path)
    return final


def _grouped(docs: DataFrame, distance: int) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of docs' rows, and (fp, n, low) of each distinct fingerprint; low: its component's least (no id, doc_id, others)."""
    prints = table(fingerprints(docs), "fingerprints")
    others = [c for c in prints.columns if c not in ("doc_id", "fp")]
    low = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *others))
    each = table(prints.groupBy("fp").agg(low.alias("low"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    roots = components(links(each.select("fp"), distance))
    rooted = each.join(roots, each.fp == roots.node, "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("low").alias("least"), F.count(F.lit(1)).alias("members"))
    return prints, table(skew_join(rooted.drop("low"), least, ["root"], "members").select("fp", "n", "root", F.col("least").alias("low")), "components")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs.

    component_id is the smallest doc_id that links of at most distance differing bits reach.  Texts without words (null, empty,
    white space) have fingerprint zero and link like any other.  Rows that repeat share a fingerprint, so a component.  Rows without
    doc_id link others but name no component; component_id is null where no row of a component has an id.  Texts of any length are
    read whole.  An empty table gives an empty result; other columns are not read.
    """
    out = skew_join(*_grouped(docs.select("doc_id", "text"), distance), ["fp"], "n")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("low.doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, distance: int = DISTANCE, written: bool = False) -> DataFrame:
    """Exactly one row of docs for each component, with all columns: of the smallest doc_id (null ids last), and of those any one.

    It is decided row by row, so rows that share a doc_id but not their texts are judged apart.  The rows that stay are told by file
    and row number, and texts never move.  written: docs is read from Parquet files as it is; else it is written first.
    """
    docs = placed(docs, written)
    _, named = _grouped(docs.select("doc_id", "text", *place(docs)), distance)
    return rows_in(docs, named.where("fp = root").select("low.file", "low.row"))
