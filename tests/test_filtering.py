"""Clusters, medoids, distances and near copies against plain Python."""

import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise.operators import filtering as E
from turnwise.operators import forest as H
from turnwise.operators import medoids as K
from turnwise.operators import metrics as M
from turnwise.operators import sentences as SE
from turnwise.operators import trees as TR
from turnwise.sinks import clusters as SC


def test_cluster_filter(spark):
    pairs = [("hi", "a"), ("hi", "b"), ("hi there", "c"), ("hi there", "a"), ("what is the time", "noon"), ("what is the time", "noon"), ("bye", "a")]
    df = spark.createDataFrame(pairs, "source string, target string")
    sources = spark.createDataFrame([("hi", 1, "hi"), ("hi there", 1, "hi"), ("what is the time", 2, "what is the time"), ("bye", 3, "bye")], "utterance string, cluster int, medoid string")
    targets = E.identity_clusters(df.select(F.col("target").alias("utterance")))
    c = E.clustered(df, sources, targets)
    rows = {r.cluster: r for r in E.cluster_rows(c, "source").collect()}
    h = -sum(p * math.log2(p) for p in (0.5, 0.25, 0.25))
    assert (rows[1].n, rows[1].avg_length, rows[1].medoid_length, rows[1].entropy) == (4, 1.5, 1, pytest.approx(h, abs=1e-6))
    assert (rows[2].entropy, rows[2].n) == (0.0, 2)
    left = lambda side, **kw: sorted((r.source, r.target) for r in E.cluster_filter(c, side, E.Limits(**kw)).collect())
    assert left("source", threshold=1.0) == sorted(pairs[4:])
    assert left("source", threshold=1.0, min_cluster_size=5) == left("source", threshold=1.0, max_avg_length=1) == sorted(pairs)
    assert left("target", threshold=0.9) == sorted(p for p in pairs if p[1] != "a")  # a answers two clusters
    assert left("both", threshold=0.9) == sorted(pairs[4:6])
    identity = E.clustered(df, E.identity_clusters(df.select(F.col("source").alias("utterance"))), targets)
    assert sorted((r.source, r.target) for r in E.cluster_filter(identity, "source", E.Limits(0.5)).collect()) == sorted((r.source, r.target) for r in E.entropy_filter(df, "source", 0.5).collect())


def test_clusters_of_small_files_are_not_broadcast(spark):
    df = spark.createDataFrame([("hi", "a"), ("bye", "b")], "source string, target string")
    clusters = spark.createDataFrame([(t, 1, t) for t in ("hi", "bye", "a", "b")], "utterance string, cluster int, medoid string")
    both, one = E.clustered(df, clusters, clusters), E.with_clusters(df, clusters, "target")
    for made in (both, one):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert sorted((r.source, r.source_cluster, r.source_medoid, r.target_medoid) for r in both.collect()) == [("bye", 1, "bye", "b"), ("hi", 1, "hi", "a")]


def test_next_word_loss(spark):
    rows = [("q", ["a", "b"]), ("q", ["a", "c"]), ("r", ["a", "b"]), ("r", []), ("q", ["d"])]
    got = E.next_word_loss(spark.createDataFrame(rows, "given string, words array<string>"), "given", "words").first()
    seen = Counter((g, tuple(w[:i]), w[i]) for g, w in rows for i in range(len(w)))
    before = Counter((g, tuple(w[:i])) for g, w in rows for i in range(len(w)))
    want = -sum(c * math.log(c / before[k[:2]]) for k, c in seen.items()) / sum(seen.values())
    assert (got.tokens, got.loss) == (7, pytest.approx(want, abs=1e-6))


def points(spark, n=60, dim=3, seed=0):
    rng = np.random.RandomState(seed)
    v = np.concatenate([rng.normal(c, 0.1, (n // 3, dim)) for c in (0, 5, 9)])
    return v, spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "id long, vector array<double>")


def plain_medoid(v, members):
    mean = lambda i: round(float(np.mean([np.sqrt(((v[i] - v[j]) ** 2).sum()) for j in members])), 6)
    return min((mean(i), i) for i in members)


def test_medoids_and_nearest(spark):
    v, df = points(spark)
    labels, centres, rounds = K.k_medoids(df, 3)
    got = {r.id: r.cluster for r in labels.collect()}
    assert rounds <= 20 and len(centres) == 3
    for i, x in enumerate(v):
        d = [round(float(((x - v[c]) ** 2).sum()), 6) for c in centres]
        assert got[i] == centres[int(np.argmin(d))]
    assert sorted(plain_medoid(v, [i for i in got if got[i] == c])[1] for c in centres) == centres  # they stay
    clusters = E.vector_clusters(df.withColumn("utterance", F.concat(F.lit("u"), "id")), labels).collect()
    assert len(clusters) == 60
    assert K.k_medoids(df, 3, share=1.0)[2] <= rounds  # stops as soon as points have been seen to move or not
    assert K.k_medoids(df, 3, max_rounds=0)[2] == 0


@pytest.mark.parametrize("block,spread", [(1024, 1.0), (40, 0.0)])
def test_exact_medoids(spark, monkeypatch, block, spread):
    """Equal to brute force on clusters of 500, also where all points are alike or far from most pivots, and with few of them measured."""
    monkeypatch.setattr(K, "BLOCK", block)
    rng = np.random.RandomState(3)
    v = np.concatenate([rng.normal(0, 1, (500, 2)) * spread + [0, 0], rng.standard_cauchy((500, 2)) + 50, np.zeros((5, 2)), [[1.0, 2.0]]])
    label = [0] * 500 + [1] * 500 + [2] * 5 + [3]
    df = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "id long, vector array<double>").repartition(5)
    labels = spark.createDataFrame(list(enumerate(label)), "id long, cluster int")
    got, measured = K.exact_medoids(df, labels)
    found = {r.cluster: (r.distance, r.medoid) for r in got.collect()}
    for c in range(4):
        members = np.flatnonzero(np.array(label) == c)
        d = np.sqrt(((v[members][:, None] - v[members][None]) ** 2).sum(2)).mean(1).round(6)
        assert found[c] == (pytest.approx(d.min(), abs=2e-6), found[c][1])
        assert d[list(members).index(found[c][1])] == pytest.approx(d.min(), abs=2e-6)
    if spread:
        assert measured < 600


def test_distances_keep_their_digits():
    """Far from the origin and for equal rows, and faster than row by row."""
    rng = np.random.RandomState(0)
    a = rng.normal(0, 1, (600, 64)) + 1000
    b = np.concatenate([a[:50], a[:50] + 1e-7, rng.normal(0, 1, (9000, 64)) + 1000])
    start = time.time()
    got = K._distances(a, b)
    took, start = time.time() - start, time.time()
    want = np.stack([np.sqrt(((b - x) ** 2).sum(1)) for x in a])
    assert np.abs(got - want).max() < 1e-9 and took < (time.time() - start) / 2


def test_sentence_distances(spark):
    words = SE.word_distances(spark.createDataFrame([("a", [0.0, 0.0]), ("b", [3.0, 4.0]), ("c", [0.0, 1.0])], "token string, vector array<double>"))
    assert words.tokens == ["a", "b", "c"] and words.matrix[0, 1] == pytest.approx(5) and words.matrix[0, 2] == pytest.approx(1)
    rows = spark.createDataFrame([(0, "a b"), (1, "c x"), (2, "zzz"), (3, None), (4, "a")], "id long, utterance string")
    got = {(r.input, r.id): r.distance for r in SE.sentence_distances(rows.where("id in (0, 2)"), rows, words, 99.0).collect()}
    assert got == {(0, 0): 0.0, (0, 1): pytest.approx((1 + math.sqrt(18)) / 2, abs=1e-6), (0, 4): 2.5}
    assert SE.sentence_distances(rows.limit(0), rows, words, 99.0).count() == 0


def test_distances_are_not_kept(spark, monkeypatch, tmp_path):
    """Before, they were written to the shared folder and read again, so that disk grew with the square of the rows."""
    monkeypatch.setattr(SE, "scratch", lambda spark, name: f"{tmp_path}/{name}")
    monkeypatch.setattr(SE, "QUERY_BLOCK", 100)
    words = SE.word_distances(spark.createDataFrame([("a", [0.0]), ("b", [1.0])], "token string, vector array<double>"))
    rows = spark.createDataFrame([(i, "a b" if i % 2 else "a") for i in range(1000)], "id long, utterance string").repartition(3)
    got = SE.sentence_distances(rows, rows, words, 99.0)
    assert sorted((r.distance, r["count"]) for r in got.groupBy("distance").count().collect()) == [(0.0, 500_000), (0.5, 500_000)]
    kept = [p for p in tmp_path.rglob("*.parquet") if p.is_file()]
    assert len(kept) >= 10 and sum(spark.read.parquet(str(p)).count() for p in kept) == 1000


def test_all_pairs_are_near(spark):
    """Where no bound tells pairs apart, both directions of all pairs of blocks are measured at once; words with equal vectors are one."""
    rng = np.random.RandomState(2)
    v = rng.normal(0, 1, (40, 8)).repeat(10, axis=0)
    words = SE.word_distances(spark.createDataFrame([(f"w{i:03d}", [float(y) for y in x]) for i, x in enumerate(v)], "token string, vector array<double>"))
    assert words.few.shape == (40, 40)
    texts = [" ".join(f"w{i:03d}" for i in rng.randint(0, 400, 60)) for _ in range(1500)]
    asked, every = SE.Sentences(list(range(1000)), texts[:1000], words), SE.Sentences(list(range(1500)), texts, words)
    start = time.time()
    q, r, far, measured = SE.near_pairs(asked, every, words, 99.0)
    assert len(q) == measured == 1_500_000 and time.time() - start < 10  # pair by pair it takes over 20 s
    for k in range(0, len(q), 100_003):
        d = words.matrix[np.ix_([int(w[1:]) for w in texts[q[k]].split()], [int(w[1:]) for w in texts[r[k]].split()])]
        assert far[k] == pytest.approx(max(d.min(1).mean(), d.min(0).mean()))


@pytest.mark.parametrize("most", [0.3, 0.8])
def test_pruned_distances_are_the_whole_matrix_s(spark, monkeypatch, most):
    monkeypatch.setattr(SE, "QUERY_BLOCK", 7)
    monkeypatch.setattr(SE, "ROW_BLOCK", 50)
    rng = np.random.RandomState(5)
    vectors = np.concatenate([rng.normal(c, 0.15, (20, 4)) for c in (0, 1, 2, 3)])
    names = [f"w{i:02d}" for i in range(80)]
    words = SE.word_distances(spark.createDataFrame([(n, [float(y) for y in x]) for n, x in zip(names, vectors)], "token string, vector array<double>"))
    texts = [" ".join(rng.choice(names[20 * (i % 4) : 20 * (i % 4) + 25 + 40 * (i % 7 == 0)], rng.randint(1, 12))) for i in range(400)] + ["", None, "unknown"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, utterance string").repartition(3)
    number = {n: i for i, n in enumerate(names)}
    bags = [[number[w] for w in (t or "").split() if w in number] for t in texts]
    want = {}
    for q in range(0, len(texts), 20):
        for i, b in enumerate(bags):
            if bags[q] and b:
                d = words.matrix[np.ix_(bags[q], b)]
                far = max(d.min(1).mean(), d.min(0).mean())
                if far <= most:
                    want[q, i] = far
    got = {(r.input, r.id): r.distance for r in SE.sentence_distances(rows.where("id % 20 = 0"), rows, words, most).collect()}
    assert got == {k: pytest.approx(x, abs=2e-6) for k, x in want.items()}
    asked, every = SE.Sentences(list(range(0, len(texts), 20)), texts[::20], words), SE.Sentences(list(range(len(texts))), texts, words)
    measured = SE.near_pairs(asked, every, words, most)[3]
    assert len(want) <= measured < len(asked) * len(every) / 2


def test_near_copies_keep_no_shingles(spark, monkeypatch, tmp_path):
    """Before, all texts' shingles were written, some eight bytes a word, and shuffled."""
    from turnwise import queries as Q

    monkeypatch.setattr(E, "scratch", lambda spark, name: f"{tmp_path}/{name}")
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(400)) for _ in range(300)]
    texts += [t + " more" for t in texts[:20]] + texts[:5]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "", None])] + [(7, texts[7])], "id long, clean string").repartition(3)
    got = sorted((r.a, r.b, r["copy"]) for r in E.near_copies(rows, "id", "clean", Q._shingles).collect())
    assert got == sorted([(i, 300 + i, False) for i in range(20)] + [(i, 320 + i, True) for i in range(5)] + [(325, 326, True)])
    assert sum(p.stat().st_size for p in tmp_path.rglob("*.parquet") if p.is_file()) < 300 * 400 * 4


def test_word_tree(spark):
    rng = random.Random(2)
    said = [[rng.choice("abc") for _ in range(rng.randint(0, 6))] for _ in range(200)] + [None, []]
    df = spark.createDataFrame(list(enumerate(said)), "id long, words array<string>").repartition(3)
    for thin, depth in ((1, 9), (5, 3), (1000, 4)):
        nodes = {}
        for i, w in enumerate(said):
            for level in range(1, min(len(w or []), depth) + 1):
                first, n = nodes.get(tuple(w[:level]), (i, 0))
                nodes[tuple(w[:level])] = first, n + 1
        want = {(len(p), x, nodes[p[:-1]][0] if len(p) > 1 else -1, p[-1], n) for p, (x, n) in nodes.items() if len(p) == 1 or nodes[p[:-1]][1] >= thin}
        tree = TR.word_tree(df, thin, depth)
        assert {tuple(r) for r in tree.collect()} == want
        each, total = Counter(w for x in said for w in x or []), sum(len(x or []) for x in said)
        inside = {p: n for p, (_, n) in nodes.items() if len(p) == 1 or nodes[p[:-1]][1] >= thin}
        loss, covered = 0.0, 0
        for x in said:
            for k in range(1, len(x or []) + 1):
                if tuple(x[:k]) in inside:
                    loss -= math.log(inside[tuple(x[:k])] / sum(n for p, n in inside.items() if p[:-1] == tuple(x[: k - 1])))
                    covered += 1
                else:
                    loss -= math.log(each[x[k - 1]] / total)
        got = TR.tree_loss(tree, df).first()
        assert (got.tokens, got.in_tree, got.loss) == (total, covered, pytest.approx(loss / total, abs=2e-6))


@pytest.mark.parametrize("characters", [False, True])
def test_nearest_medoids_in_a_forest(spark, characters):
    """At least nine in ten points get a medoid as similar as the most similar one, and most pairs are never compared."""
    rng = random.Random(4)
    said = sorted({r.text.lower() for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").where("text is not null").collect()})
    if not characters:  # near copies of some among others
        said = [" ".join(w for w in t.split() if rng.random() < 0.9) + f" x{rng.randint(0, 50)}" for t in said for _ in range(2)]
    said = sorted(set(said)) + ["", "zzzz qqqq"]
    cut = (lambda t: set(t)) if characters else (lambda t: set(t.split()))
    sets = spark.createDataFrame([(t,) for t in said], "id string").select("id", H.elements(F.col("id"), characters).alias("set"))
    chosen = rng.sample(said[:-2], 40)
    near, met = H.nearest_medoids(sets, sets.where(F.col("id").isin(chosen)))
    like = lambda a, b: round(len(cut(a) & cut(b)) / max(1, len(cut(a) | cut(b))), 6)
    got = {r.id: (r.medoid, r.similarity) for r in near.collect()}
    assert set(got) == set(said)
    right = 0
    for t, (m, s) in got.items():
        assert m in chosen and s == like(t, m)
        right += s == max(like(t, c) for c in chosen)
    assert right >= 0.9 * len(said)
    if not characters:
        assert met.count() < 0.8 * len(said) * len(chosen)
    assert got[""] == (min(chosen), 0.0)


def test_forest_in_blocks(spark, monkeypatch):
    """Medoids in blocks find as similar ones or better, points aren't shuffled, and few elements at once change nothing."""
    rng = random.Random(6)
    said = sorted({" ".join(f"w{rng.randint(0, 60)}" for _ in range(rng.randint(1, 30))) for _ in range(200)}) + [""]
    sets = spark.createDataFrame([(t,) for t in said], "id string").select("id", H.elements(F.col("id")).alias("set"))
    some = sets.where(F.col("id").isin(said[::5]))
    near = H.nearest_medoids(sets, some)[0]
    assert "Exchange" not in near._jdf.queryExecution().executedPlan().toString()
    whole = {r.id: (r.medoid, r.similarity) for r in near.collect()}
    monkeypatch.setattr(H, "COMPARED", 50)
    assert {r.id: (r.medoid, r.similarity) for r in H.nearest_medoids(sets, some)[0].collect()} == whole
    monkeypatch.setattr(H, "MEDOIDS_SENT", 9)
    parts, met = H.nearest_medoids(sets, some)
    got = {r.id: (r.medoid, r.similarity) for r in parts.collect()}
    assert set(got) == set(whole) and all(got[i][1] >= whole[i][1] for i in whole)
    assert {(i, m) for i, (m, _) in got.items()} <= {tuple(r) for r in met.collect()}


def test_forest_clusters_feed_the_filter(spark):
    pairs = spark.createDataFrame([("how are you my friend", "fine thanks a lot"), ("how are you my dear friend", "not well at all"), ("what is the time now", "noon"), ("what is the time just now", "noon")], "source string, target string")
    clusters = H.forest_clusters(pairs.select(F.col("source").alias("utterance")), 2)
    assert clusters.count() == 4 and clusters.select("cluster").distinct().count() <= 2
    identity = E.identity_clusters(pairs.select(F.col("target").alias("utterance")))
    left = E.cluster_filter(E.clustered(pairs, clusters, identity), "source", E.Limits(0.9))
    high = {r.cluster for r in E.flagged(E.cluster_rows(E.clustered(pairs, clusters, identity), "source"), E.Limits(0.9)).collect()}
    assert {r.source for r in left.collect()} == {r.utterance for r in clusters.collect() if r.cluster not in high}


def test_saved_clusters_join_where_they_lie(spark, tmp_path):
    said = [f"u{i}" for i in range(500)]
    clusters = spark.createDataFrame([(u, i % 7, f"u{i % 7}") for i, u in enumerate(said)], "utterance string, cluster int, medoid string")
    pairs = spark.createDataFrame([(said[i % 500], said[i * 7 % 500], i) for i in range(2000)], "source string, target string, place int")
    try:
        SC.save_clusters(clusters, "kept_clusters", f"{tmp_path}/c")
        SC.save_clusters(clusters.where("cluster = 0").withColumn("cluster", F.lit(99)), "newer_clusters", f"{tmp_path}/n")
        SC.save_pairs(pairs, "source", "kept_pairs", f"{tmp_path}/p")
        joined = SC.with_side(spark.table("kept_pairs"), SC.load_clusters(spark, "kept_clusters"), "source")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert {(r.place, r.source_cluster) for r in joined.collect()} == {(i, i % 500 % 7) for i in range(2000)}
        merged = {r.utterance: r.cluster for r in SC.load_clusters(spark, "kept_clusters", "newer_clusters").collect()}
        assert merged == {u: i % 7 or 99 for i, u in enumerate(said)}
        assert {r.cluster: r.n for r in SC.count_lines(clusters).collect()} == Counter(i % 7 for i in range(500))
        SC.save_clusters(clusters.limit(3), "kept_clusters", f"{tmp_path}/c")  # replaced
        assert spark.table("kept_clusters").count() == 3
    finally:
        for name in ("kept_clusters", "newer_clusters", "kept_pairs"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def planted(n):
    """Texts of 40 words, near copies of some of them, and others that share half their words."""
    rng = np.random.RandomState(7)
    out = []
    for k in range(n):
        words = [f"w{rng.randint(10**6)}" for _ in range(60)]
        out.append(" ".join(words))
        out.append(" ".join([*words, "more"]))
        out.append(" ".join([*words[:30], *[f"v{rng.randint(10**6)}" for _ in range(30)]]))
    return out


def test_near_copies_are_found(spark, monkeypatch):
    """All pairs of 0.8 and more, each once, also where a key is cut into pieces."""
    texts = planted(60) + [" ".join(f"x{i}" for i in range(100) if i != k) for k in range(0, 100, 4)]
    shingles = lambda c: F.array_distinct(M.ngrams(F.split(c, " "), 5))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    want = {(i, j): len(a & b) / len(a | b) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and len(a & b) >= 0.8 * len(a | b)}
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", shingles(F.col("text")).alias("words"))
    for piece in (1024, 7):
        monkeypatch.setattr(E, "PIECE", piece)
        got = [(r.a, r.b) for r in E.minhash_pairs(df, "id", "words").collect()]
        assert len(got) == len(set(got)) and set(got) <= set(want) and len(got) >= 0.99 * len(want)
    heads = E.near_clusters(spark.createDataFrame([(t,) for t in texts], "utterance string"), shingles)
    assert heads.count() == len(set(texts)) and 60 <= heads.where("medoid <> utterance").count()


def test_members_of_keys_are_paired_in_runs(spark, monkeypatch):
    """Before, each key was a call of its own."""
    rng = np.random.default_rng(3)
    rows = [(i, [int(rng.integers(0, 12)) * 7 + k for k in range(3)]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, keys array<bigint>")
    want = sorted((a, b) for a, x in rows for b, y in rows if a < b and any(p == q for p, q in zip(x, y)))
    plan = E.candidate_pairs(df)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" not in plan
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        for piece in (4, 1024):
            monkeypatch.setattr(E, "PIECE", piece)
            assert sorted(map(tuple, E.candidate_pairs(df).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_top_accuracy(spark):
    rows = spark.createDataFrame([([["a", "b"], ["c"]], ["b", "x"]), ([], ["q"]), ([["z"]], [])], "candidates array<array<string>>, gold array<string>")
    assert tuple(M.top_accuracy(rows, "candidates", "gold").first()) == (3, round(1 / 3, 6))
    assert tuple(M.neg_log_perplexity(spark.createDataFrame([(0.5,), (0.25,)], "p double"), F.log("p")).first()) == (2, round((math.log(0.5) + math.log(0.25)) / 2, 6))


@pytest.mark.parametrize("sent", [1 << 15, 3])
def test_top_dots_are_those_of_all_pairs(spark, monkeypatch, sent):
    monkeypatch.setattr(M, "QUERIES_SENT", sent)
    monkeypatch.setattr(M, "ROWS_AT_ONCE", 16)
    rng = random.Random(6)
    rows = [(i, [round(rng.uniform(-1, 1), 2) for _ in range(3)]) for i in range(120)]
    rows += [(i, [0.5, 0.25, 0.0]) for i in range(120, 200)] + [(7, [1.0, 1.0, 1.0]), (200, None), (201, [1.0, None, 2.0]), (202, [1.0]), (203, [float("nan"), 0.0, 0.0]), (204, [1e200, 0.0, 0.0]), (None, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    some = df.where("id % 10 = 0 or id > 199")
    slow = M.best(M.dot_scores(some, df), "input", "score", "candidate", 4)
    as_rows = lambda d: sorted(map(str, d.select("input", "candidate", "score", "rank").collect()))
    assert as_rows(M.top_dots(some, df, 4)) == as_rows(slow)
    few = df.where("id < 3")
    assert as_rows(M.top_dots(few, few, 4)) == as_rows(M.best(M.dot_scores(few, few), "input", "score", "candidate", 4))
    assert M.top_dots(df.where("id < 0"), df, 4).count() == 0


def test_only_pairs_that_may_be_best_are_rows(spark):
    """Before, every pair was a row."""
    rng = np.random.default_rng(1)
    found = M.TopDots(np.arange(0, 4000, 50), rng.normal(size=(80, 8)), 10)
    for x in range(0, 4000, 1000):
        found.add(np.arange(x, x + 1000), rng.normal(size=(1000, 8)))
    assert len(found.query) == 80 * 10
    assert M.rounded(np.array([0.00005, -0.00005, 1.00015, 2.5, -0.00001])).tolist() == [0.0001, -0.0001, 1.0002, 2.5, 0.0]


def test_nearest_in_blocks_is_the_same(spark, monkeypatch):
    v, df = points(spark)
    centres = df.where("id % 5 = 0")
    whole = sorted(map(tuple, E.nearest(df, centres).collect()))
    monkeypatch.setattr(E, "CENTRES_SENT", 4)
    assert sorted(map(tuple, E.nearest(df, centres).collect())) == whole
    for i, c, d in whole:
        far = {j: round(float(((v[i] - v[j]) ** 2).sum()), 6) for j in range(0, 60, 5)}
        assert d == pytest.approx(min(far.values()), abs=2e-6) and far[c] == pytest.approx(d, abs=2e-6)


@pytest.mark.parametrize("sent", [1 << 21, 12])
def test_mean_vectors(spark, monkeypatch, sent):
    """Means of all known words with repeats, in one block and in several."""
    monkeypatch.setattr(E, "NUMBERS_SENT", sent)
    monkeypatch.setattr(E, "WORDS_ADDED", 5)
    rng = np.random.RandomState(1)
    v = {f"w{i}": rng.normal(0, 1, 3) for i in range(30)}
    texts = [(f"t{k}", [f"w{rng.randint(0, 40)}" for _ in range(rng.randint(0, 20))]) for k in range(100)] + [("none", None), ("unknown", ["w99"])]
    want = {i: np.mean([v[w] for w in ws if w in v], axis=0) for i, ws in texts if any(w in v for w in ws or [])}
    df = spark.createDataFrame(texts, "id string, words array<string>").repartition(3)
    out = E.mean_vectors(df, spark.createDataFrame([(w, [float(y) for y in x]) for w, x in v.items()], "word string, vector array<double>"))
    got = {r.id: r.vector for r in out.collect()}
    assert set(got) == set(want) and all(got[i] == pytest.approx(list(want[i])) for i in want)


def test_nearest_of_equal_centres_is_the_smallest_id(spark):
    rows = [(5, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [-1.0, 0.0]), (9, [0.0, 1.0 + 1e-9])]
    centres = spark.createDataFrame(rows, "id long, vector array<double>")
    points = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [-0.5, 0.0]), ("c", None)], "id string, vector array<double>")
    assert sorted(map(tuple, E.nearest(points, centres).collect())) == [("a", 3, 1.0), ("b", 4, 0.25), ("c", None, None)]
    assert [tuple(r) for r in E.nearest(points.limit(1), centres.limit(0)).collect()] == [("a", None, None)]


def test_near_clusters_are_those_of_brute_force(spark):
    """An utterance joins the least one that it is a near copy of, where that joins no other."""
    texts = sorted({*planted(30), *(" ".join(f"x{i}" for i in range(100) if i != k) for k in range(0, 100, 9))})
    sets = {t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts}
    near = {t: [o for o in texts if o < t and len(sets[t] & sets[o]) >= 0.8 * len(sets[t] | sets[o])] for t in texts}
    want = {t: near[t][0] if near[t] and not near[near[t][0]] else t for t in texts}
    shingles = lambda c: F.array_distinct(M.ngrams(F.split(c, " "), 5))
    got = {r.utterance: r.medoid for r in E.near_clusters(spark.createDataFrame([(t,) for t in texts], "utterance string"), shingles).collect()}
    assert set(got) == set(texts) and sum(got[t] == want[t] for t in texts) >= 0.97 * len(texts)
