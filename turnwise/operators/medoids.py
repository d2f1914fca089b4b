"""Exact medoids: the member of each cluster with the least mean distance to all its members, found without all pairs.

The mean distance E(i) of a member is at least |E(j) - d(i, j)| for every j, by the triangle inequality.  Some pivots of each cluster are
measured against all its members; who can't be better than the best pivot is out; the others are measured a block at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnwise.operators.filtering import _mean, nearest, squared_distance
from turnwise.sinks.paths import scratch, written

#: Pivots of a cluster besides the member nearest to its mean; members that are measured at once, which go to all tasks.
PIVOTS, BLOCK = 16, 1024
#: Bounds are trusted to so much.
SLACK = 1e-9


def _measured(points: DataFrame, some: list[tuple]) -> DataFrame:
    """(id, total, n): the sum of distances of given members (id, cluster, vector) to all points (id, cluster, vector) of their cluster."""
    by: dict = {}
    for i, c, v in some:
        by.setdefault(c, ([], []))
        by[c][0].append(i)
        by[c][1].append(v)
    kinds = dict(points.dtypes)

    def run(batches):
        sums = {c: np.zeros(len(ids)) for c, (ids, _) in by.items()}
        size = dict.fromkeys(by, 0)
        asked = {c: np.array(v) for c, (_, v) in by.items()}
        for b in batches:
            for c, members in _by_cluster(b).items():
                if c in by:
                    sums[c] += _distances(asked[c], members[1]).sum(1)
                    size[c] += len(members[1])
        ids = [i for c, (ids, _) in by.items() if size[c] for i in ids]
        if ids:
            full = [c for c in by if size[c]]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate([sums[c] for c in full])), pa.array([size[c] for c in full for _ in by[c][0]], pa.int64())], names=["id", "total", "n"])

    got = points.select("id", "cluster", "vector").mapInArrow(run, f"id {kinds['id']}, total double, n long")
    return got.groupBy("id").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def _by_cluster(b: pa.RecordBatch) -> dict:
    """Of each cluster in a batch (id, cluster, vector) its rows' places and vectors; null clusters and vectors are none."""
    vectors = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
    codes = b.column(1).dictionary_encode()
    code = codes.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    cuts = np.searchsorted(code[order], np.arange(len(codes.dictionary) + 1))
    return {c: (at := order[cuts[k] : cuts[k + 1]], vectors[at]) for k, c in enumerate(codes.dictionary.to_pylist())}


#: Vectors that are measured against all members at once, and pairs that are measured one by one.
AT_ONCE, PAIRS_AT_ONCE = 256, 1 << 14


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of a's rows to b's: by a product of matrices around b's mean, and one by one where that would lose digits."""
    centre = b.mean(0) if len(b) else 0.0
    a, b = a - centre, b - centre
    own, other = (a**2).sum(1), (b**2).sum(1)
    out = np.empty((len(a), len(b)))
    for x in range(0, len(a), AT_ONCE):
        size = own[x : x + AT_ONCE, None] + other
        about = size - 2 * a[x : x + AT_ONCE] @ b.T
        r, c = np.nonzero(about <= 1e-4 * size)
        for y in range(0, len(r), PAIRS_AT_ONCE):
            i, j = r[y : y + PAIRS_AT_ONCE], c[y : y + PAIRS_AT_ONCE]
            about[i, j] = ((a[x + i] - b[j]) ** 2).sum(1)
        out[x : x + AT_ONCE] = np.sqrt(about)
    return out


def exact_medoids(points: DataFrame, labels: DataFrame) -> tuple[DataFrame, int]:
    """((cluster, medoid, distance), members measured) of points (id, vector) with labels (id, cluster); distance is the mean one, rounded
    to 6 places, and of equals the smallest id stays.

    The driver holds pivots and a block of members at a time; each block is one pass over the points, which are a written table.
    """
    spark, folder = points.sparkSession, scratch(points.sparkSession, "medoids")
    p = written(points.join(labels, "id").select("id", "cluster", F.col("vector").cast("array<double>").alias("vector")), f"{folder}/points")
    near = p.join(_mean(p, ["cluster"], "vector", "_m"), "cluster").select("cluster", "id", squared_distance("vector", "_m").alias("far"))
    centre = near.groupBy("cluster").agg(F.min_by("id", F.struct("far", "id")).alias("id"))
    pivots = p.join(centre.unionByName(_least_hashes(p)).distinct(), ["cluster", "id"])
    some = [tuple(r) for r in pivots.select("id", "cluster", "vector").collect()]  # PIVOTS + 1 a cluster
    means = {r.id: r.total / r.n for r in _measured(p, some).collect()}
    best: dict = {}
    for i, c, _ in some:
        best[c] = min(best.get(c, (float("inf"), i)), (round(means[i], 6), i))
    by: dict = {}
    for i, c, v in some:
        by.setdefault(c, []).append((v, means[i]))
    least = {c: min(e for _, e in x) for c, x in by.items()}
    done = {i for i, _, _ in some}
    kind, named = dict(p.dtypes)["id"], dict(p.dtypes)["cluster"]

    def bounded(batches):
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            low = np.zeros(b.num_rows)
            for c, (at, vectors) in _by_cluster(b).items():
                e = np.array([x for _, x in by[c]])
                low[at] = np.abs(e[:, None] - _distances(np.array([v for v, _ in by[c]]), vectors)).max(0)
                keep[at] = low[at] <= least[c] + SLACK + 1e-6
            keep &= np.array([i not in done for i in b.column(0).to_pylist()], bool)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(low)], names=["id", "cluster", "vector", "low"]).filter(pa.array(keep))

    left = written(p.mapInArrow(bounded, f"id {kind}, cluster {named}, vector array<double>, low double"), f"{folder}/left")
    blocks = -(-left.count() // BLOCK)
    measured = len(some)
    for k in range(blocks):
        block = [tuple(r) for r in left.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).select("id", "cluster", "vector", "low").collect() if r.low <= best[r.cluster][0] + 1e-6 + SLACK]  # about BLOCK rows
        got = {r.id: r.total / r.n for r in _measured(p, [r[:3] for r in block]).collect()} if block else {}
        measured += len(block)
        for i, c, *_ in block:
            best[c] = min(best[c], (round(got[i], 6), i))
    rows = [(c, i, d) for c, (d, i) in best.items()]
    return spark.createDataFrame(rows, f"cluster {named}, medoid {kind}, distance double"), measured


def _least_hashes(points: DataFrame) -> DataFrame:
    """(cluster, id): PIVOTS members of each cluster by a hash, chosen without a cluster's rows in one place."""
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.xxhash64("id"), "id"))
    return points.select("cluster", "id").withColumn("_r", rank).where(F.col("_r") <= PIVOTS).drop("_r")


def k_medoids(points: DataFrame, k: int, max_rounds: int = 20, seed: int = 42, share: float = 0.0) -> tuple[DataFrame, list, int]:
    """((id, cluster) with clusters named by their medoids, the medoids, rounds): points (id, vector), a written table, go to the nearest
    medoid, and medoids to their cluster's exact one, until no more than share of the points have moved, or medoids stay, or max_rounds.
    The first ones are the k of least seeded hash."""
    spark, folder = points.sparkSession, scratch(points.sparkSession, "k-medoids")
    now = [r.id for r in points.select("id").orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(k).collect()]
    rounds, labels, size = 0, None, points.count()
    while True:
        new = written(nearest(points, points.where(F.col("id").isin(now))).select("id", F.col("centre").alias("cluster"), "distance"), f"{folder}/{rounds}").select("id", "cluster")
        # medoids have new names each round: who stays is told by the medoid that the round before made of its cluster
        moved = size if labels is None else new.join(labels.withColumnRenamed("cluster", "before"), "id").where("cluster <> before").count()
        if rounds == max_rounds or labels is not None and moved <= share * size:
            return new, sorted(now), rounds
        found = {r.cluster: r.medoid for r in exact_medoids(points, new)[0].collect()}  # k rows
        rounds += 1
        if sorted(found.values()) == sorted(now):
            return new, sorted(now), rounds
        names = spark.createDataFrame([(a, b) for a, b in found.items()], f"cluster {dict(points.dtypes)['id']}, after {dict(points.dtypes)['id']}")
        labels = new.join(F.broadcast(names), "cluster").select("id", F.col("after").alias("cluster"))
        now = list(found.values())
