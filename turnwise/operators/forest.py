"""Nearest medoid by Jaccard similarity, found in a forest of MinHash prefixes.

Each of TREES trees orders the medoids by its own DEPTH minima.  A point looks in all trees for medoids that begin with all its minima,
then for those that begin with all but the last, and so on, until it has met enough of them; these are compared exactly.  So near ones
are found by long prefixes, which few medoids share, and points that are near to nothing still find what shares one minimum.  The medoids' trees go
to the points, in blocks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions.text import tokens
from turnwise.sinks.paths import scratch, written

TREES, DEPTH = 64, 4
#: Medoids that a point compares itself with, unless fewer share anything with it.
ENOUGH = 12
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def elements(text: Column, characters: bool = False, run: int = 1) -> Column:
    """The set that stands for a text: its distinct words, or characters, or runs of so many of them."""
    parts = F.split(text, "") if characters else tokens(text)
    if run > 1:
        parts = F.when(F.size(parts) >= run, F.transform(F.sequence(F.lit(1), F.size(parts) - run + 1), lambda i: F.array_join(F.slice(parts, i, run), "\x00"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.coalesce(F.filter(parts, lambda x: x != ""), F.array().cast("array<string>")))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _prefixes(flat: np.ndarray, off: np.ndarray, seed: int) -> np.ndarray:
    """Of each set (flat[off[i]:off[i + 1]], not empty) TREES * DEPTH keys: for each tree its prefixes' hashes, the shortest first."""
    salts = _mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64) * _GOLDEN + np.uint64(seed))
    keys = np.zeros((len(off) - 1, TREES * DEPTH), np.uint64)
    for k, salt in enumerate(salts if len(keys) else ()):
        low = np.minimum.reduceat(_mix(flat ^ salt), off[:-1])
        before = keys[:, k - 1] if k % DEPTH else np.full(len(keys), k, np.uint64)
        keys[:, k] = _mix(before * _GOLDEN + low)
    return keys


def _sets(lists) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of an Arrow array of lists of hashes, none of them null."""
    off = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy()[off[0] : off[-1]].view(np.uint64), off - off[0]


#: Medoids that are sent to all tasks at once; elements of points, times these medoids, that are compared at once.
MEDOIDS_SENT, COMPARED = 1024, 1 << 21


class _Trees:
    """A block of medoids, in their order: their sets, and in each tree their prefixes in order."""

    def __init__(self, flat: np.ndarray, off: np.ndarray, seed: int):
        self.seed, self.size = seed, np.diff(off)
        full = np.flatnonzero(self.size)
        keys = _prefixes(flat, off[np.append(full, len(self.size))], seed)
        order = keys.argsort(0, kind="stable")
        self.keys, self.at = np.take_along_axis(keys, order, 0), full[order]
        self.words, place = np.unique(flat, return_inverse=True)
        self.held = np.sort(np.repeat(np.arange(len(self.size)), self.size) * (len(self.words) + 1) + place.reshape(-1))  # (medoid, word)

    def met(self, keys: np.ndarray, enough: int) -> np.ndarray:
        """Whether a point of these prefixes meets each medoid: depth by depth, until it has met enough."""
        out = np.zeros((len(keys), len(self.size)), bool)
        looking = np.arange(len(keys))
        for depth in range(DEPTH - 1, -1, -1):
            for k in range(depth, TREES * DEPTH, DEPTH):
                own = keys[looking, k]
                low, high = np.searchsorted(self.keys[:, k], own), np.searchsorted(self.keys[:, k], own, "right")
                n = high - low
                within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                out[np.repeat(looking, n), self.at[np.repeat(low, n) + within, k]] = True
            looking = looking[out[looking].sum(1) < enough]
        return out

    def compared(self, flat: np.ndarray, off: np.ndarray, enough: int):
        """Yields (rows, medoids, similarity) of sets' pairs with the medoids that they meet, the first one if they meet none."""
        size = np.diff(off)
        most, x = max(1, COMPARED // len(self.size)), 0
        while x < len(size):
            y = max(x + 1, int(np.searchsorted(off, off[x] + most, "right")) - 1)
            y = min(y, x + max(1, COMPARED // len(self.size)))
            full = np.flatnonzero(size[x:y])
            met = np.zeros((y - x, len(self.size)), bool)
            met[full] = self.met(_prefixes(flat[off[x] : off[y]], off[x + np.append(full, y - x)] - off[x], self.seed), enough)
            met[~met.any(1), 0] = True
            r, m = np.nonzero(met)
            word = np.searchsorted(self.words, flat[off[x] : off[y]])
            known = word < len(self.words)
            known[known] = self.words[word[known]] == flat[off[x] : off[y]][known]
            word = np.where(known, word, len(self.words))  # one that no medoid holds
            n = size[x:y][r]
            pair = np.repeat(np.arange(len(r)), n)
            asked = np.repeat(m, n) * (len(self.words) + 1) + word[np.repeat(off[x:y][r] - off[x], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            at = np.searchsorted(self.held, asked)
            hit = at < len(self.held)
            hit[hit] = self.held[at[hit]] == asked[hit]
            shared = np.bincount(pair[hit], minlength=len(r))
            yield x + r, m, np.round(shared / np.maximum(n + self.size[m] - shared, 1), 6)
            x = y


def nearest_medoids(points: DataFrame, medoids: DataFrame, enough: int = ENOUGH, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """((id, medoid, similarity), (id, medoid) compared) of points (id, set) and medoids (id, set), both tables.

    Of the compared medoids the most similar one, of equals the smallest.  Points that share no minimum with any medoid, empty ones too, go
    to the smallest.  Medoids go to the points in blocks of about MEDOIDS_SENT, in each of which a point meets enough, so points are never
    shuffled for it; with more than one block each is a job of its own, and a point's bests are compared.
    """
    spark, kind, named = points.sparkSession, dict(points.dtypes)["id"], dict(medoids.dtypes)["id"]
    hashed = lambda rows: rows.select("id", F.transform("set", lambda w: F.xxhash64(w)).alias("hashes"))
    p, m = hashed(points), written(hashed(medoids), scratch(spark, "medoids"))
    blocks = -(-m.count() // MEDOIDS_SENT) or 1

    def block(k: int, whole: bool) -> DataFrame:
        rows = m.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).orderBy("id").toArrow()  # about MEDOIDS_SENT
        ids, trees = rows.column("id").combine_chunks(), _Trees(*_sets(rows.column("hashes").combine_chunks()), seed)

        def run(batches):
            import pyarrow as pa

            for b in batches if len(ids) else ():
                for r, c, alike in trees.compared(*_sets(b.column("hashes")), enough):
                    if not whole:
                        order = np.lexsort((c, -alike, r))
                        first = order[np.flatnonzero(np.diff(r[order], prepend=-1))]
                        r, c, alike = r[first], c[first], alike[first]
                    yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(r)), ids.take(pa.array(c)), pa.array(alike)], names=["id", "medoid", "similarity"])

        return p.mapInArrow(run, f"id {kind}, medoid {named}, similarity double")

    def every(whole: bool) -> DataFrame:
        if blocks == 1:
            return block(0, whole)
        path = scratch(spark, "forest")
        for k in range(blocks):
            block(k, whole).write.mode("append").parquet(path)
        return spark.read.schema(f"id {kind}, medoid {named}, similarity double").parquet(path)

    near = every(False)
    if blocks > 1:
        best = F.min(F.struct((-F.col("similarity")).alias("far"), "medoid", "similarity")).alias("b")
        near = near.groupBy("id").agg(best).select("id", "b.medoid", "b.similarity")
    return near, every(True).select("id", "medoid")


def forest_clusters(utterances: DataFrame, k: int, characters: bool = False, seed: int = 42) -> DataFrame:
    """(utterance, cluster, medoid): distinct utterances (utterance) by the nearest of k of them, those of least seeded hash."""
    said = written(utterances.select("utterance").where("utterance is not null").distinct(), scratch(utterances.sparkSession, "utterances"))
    sets = said.select(F.col("utterance").alias("id"), elements(F.col("utterance"), characters).alias("set"))
    chosen = sets.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(k)
    near, _ = nearest_medoids(sets, chosen)
    return near.select(F.col("id").alias("utterance"), F.col("medoid").alias("cluster"), "medoid")


