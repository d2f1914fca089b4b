"""How sources of a language differ in their terms: every pair of sources, and each source's most telling terms against its language.

Terms are runs of letters and characters outside ASCII, A-Z in lower case.  A language keeps the terms that at least LEAST_DOCS of its
documents have.  A kept term's probability in a group, in billionths, is 1 + floor(10^9 (count + 2) / (N + 2V)); the divergence of two
probabilities is f = floor((p - q)^2 / (p + q)).  All arithmetic is exact.

Terms of a group are searched best bound first: terms of equal count have equal p, and f falls as q rises to p, so a bucket's bound is f at
the bucket's least q; the search of a slice of a group's terms ends once the bounds left are below its kth best.

Pairs come from the terms' postings: only terms that both sources have are looked at for a pair, within the task that holds their postings, which
gives a sum for each pair; what the absent terms and those of one source add follows from each source's number of terms for each count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lexical import term_column
from .shared import small_batches, table

_BYTES = np.arange(256)
#: Bytes of a lower-cased term.
LETTERS = ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
LEAST_DOCS, TERMS = 10, 10
#: Rows of a group that are searched together, rows of postings that are paired together, and rows of counts that a task holds.
SLICE, POSTINGS, HELD = 1 << 13, 1 << 15, 1 << 18
BILLION = 1_000_000_000


def probability(count: np.ndarray, n, v) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (n + 2 v)), by long division in steps of 1000, so that no product leaves 64 bits."""
    whole = n + 2 * v
    rest = np.asarray(count, np.int64) + 2
    out, rest = rest // whole, rest % whole
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return out + 1


def divergence(p, q):
    return (p - q) * (p - q) // (p + q)


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, added up within each task as far as it holds them; and of each group
    that a task has seen a row without term."""

    def summed(parts):
        t = pa.concat_tables(parts).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
        return t.rename_columns({"n_sum": "n", "docs_sum": "docs"}).select(["lang", "source", "term", "n", "docs"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            terms, per = term_column(b.column("text"), LETTERS)
            coded = terms.dictionary_encode()
            width = max(1, len(coded.dictionary))
            pairs = pa.table([b.column("lang"), b.column("source"), pa.array(np.arange(b.num_rows))], names=["lang", "source", "row"])
            groups = pairs.group_by(["lang", "source"]).aggregate([("row", "list")])
            rows = groups.column("row_list").combine_chunks()
            group = np.empty(b.num_rows, np.int64)
            group[rows.flatten().to_numpy()] = np.repeat(np.arange(groups.num_rows), np.diff(rows.offsets.to_numpy()))
            each, n = np.unique(np.repeat(np.arange(b.num_rows), per) * width + coded.indices.to_numpy(), return_counts=True)
            key, which = np.unique(group[each // width] * width + each % width, return_inverse=True)
            of = np.concatenate([key // width, np.arange(groups.num_rows)])  # terms, and the groups themselves
            total = lambda w: pa.array(np.concatenate([np.bincount(which, w, len(key)).astype(np.int64), np.zeros(groups.num_rows, np.int64)]))
            names = pa.concat_arrays([coded.dictionary.take(pa.array(key % width)).cast(pa.string()), pa.nulls(groups.num_rows, pa.string())])
            g = [groups.column(c).combine_chunks().take(pa.array(of)) for c in ("lang", "source")]
            held.append(pa.table([*g, names, total(n), total(None)], names=["lang", "source", "term", "n", "docs"]))
            size += held[-1].num_rows
            if size > 4 * HELD:
                held = [summed(held)]
                size = held[0].num_rows
                if size > HELD:
                    yield from held[0].to_batches()
                    held, size = [], 0
        if held:
            yield from summed(held).to_batches()

    small_batches(docs.sparkSession)
    said = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return said.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_terms(docs: DataFrame) -> DataFrame:
    """A written table (lang, source, term, n, lang_n, once) of kept terms; once marks one row of each (lang, term).  Every group has a
    row without term beside."""
    per = Window.partitionBy("lang", "term")
    sums = counts(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    sums = sums.select("*", F.sum("n").over(per).alias("lang_n"), F.sum("docs").over(per).alias("lang_docs"), (F.min("source").over(per) == F.col("source")).alias("once"))
    return table(sums.where(F.col("term").isNull() | (F.col("lang_docs") >= LEAST_DOCS)).select("lang", "source", "term", "n", "lang_n", "once"), "divergence-terms")


def group_sizes(terms: DataFrame) -> DataFrame:
    """A written table (lang, source, total, types, lang_total, lang_types) of every group of :func:`kept_terms`."""
    real = F.col("term").isNotNull()
    groups = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("term").alias("types"), F.sum((real & F.col("once")).cast("long")).alias("first"))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("first").alias("lang_types"))
    return table(groups.drop("first").join(langs, "lang"), "divergence-groups")


def best_first(n: np.ndarray, lang_n: np.ndarray, name: np.ndarray, total: int, lang_total: int, types: int, k: int = TERMS) -> tuple[list[tuple[int, str]], int]:
    """(the k best (f, term) of a group's terms with p > q, ties by term; how many terms were looked at)."""
    order = np.argsort(n, kind="stable")
    count, start = np.unique(n[order], return_index=True)
    p = probability(count, total, types)
    least = probability(np.minimum.reduceat(lang_n[order], start), lang_total, types)
    bound = np.where(p > least, divergence(p, least), -1)
    ends = np.append(start[1:], len(n))
    best: list[tuple[int, str]] = []
    seen = 0
    for b in np.argsort(-bound, kind="stable").tolist():
        if bound[b] < 0 or len(best) == k and bound[b] < best[-1][0]:
            break
        some = order[start[b] : ends[b]]
        seen += len(some)
        q = probability(lang_n[some], lang_total, types)
        f = divergence(p[b], q)
        some, f = some[q < p[b]], f[q < p[b]]
        if len(some) > k:  # no more than k of a bucket, and those that tie with the last
            least_f = np.partition(f, len(f) - k)[len(f) - k]
            some, f = some[f >= least_f], f[f >= least_f]
        best = sorted([*best, *zip(f.tolist(), name[some].tolist(), strict=True)], key=lambda x: (-x[0], x[1].encode()))[:k]
    return best, seen


def telling_terms(terms: DataFrame, groups: DataFrame, k: int = TERMS) -> DataFrame:
    """(lang, source, item, value, rank): each group's k best terms."""
    rows = terms.where("term is not null").select("lang", "source", "term", "n", "lang_n").join(groups, ["lang", "source"])
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("term"), F.ceil(F.col("types") / SLICE)).cast("int"))

    def run(key, got):
        one = lambda c: got.column(c)[0].as_py()
        best, _ = best_first(got.column("n").to_numpy(), got.column("lang_n").to_numpy(), got.column("term").to_numpy(), one("total"), one("lang_total"), one("lang_types"), k)
        return pa.table([pa.array([key[i].as_py()] * len(best), pa.string()) for i in (0, 1)] + [pa.array([t for _, t in best], pa.string()), pa.array([f for f, _ in best], pa.int64())], names=["lang", "source", "item", "value"])

    found = rows.groupBy("lang", "source", "slice").applyInArrow(run, "lang string, source string, item string, value long")
    return _ranked(found).where(F.col("rank") <= k)


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def shared_sums(names: np.ndarray, term: np.ndarray, p: np.ndarray, none: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, sum), a < b: for sources (numbers in names) with a term in common, the sum over those terms of what f is more than f with
    the term absent from one side or the other, and less than with it absent from both, so that the parts add up.

    p: probability of each row; none: of an absent term in the row's source.  Terms' rows are paired with their next, second next and so on,
    and summed on the way: as many sums as pairs of sources are held, besides one step's.
    """
    order = np.lexsort((names, term))
    names, term, p, none = names[order], term[order], p[order], none[order]
    width = int(names.max(initial=0)) + 1
    keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, step = np.arange(len(term)), 1
    while len(rows := rows[rows + step < len(term)]) and len(rows := rows[term[rows] == term[rows + step]]):
        a, b = rows, rows + step
        more = divergence(p[a], p[b]) - divergence(p[a], none[b]) - divergence(none[a], p[b]) + divergence(none[a], none[b])
        keys, which = np.unique(np.concatenate([keys, names[a] * width + names[b]]), return_inverse=True)
        added = np.zeros(len(keys), np.int64)
        np.add.at(added, which, np.concatenate([sums, more]))
        sums, step = added, step + 1
    return keys // width, keys % width, sums


def source_pairs(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): each group with each other source of its language."""
    real = terms.where("term is not null")
    rows = real.select("lang", "source", "term", "n").join(groups, ["lang", "source"])
    volume = groups.groupBy("lang").agg(F.sum("types").alias("postings"))
    rows = rows.join(volume, "lang").withColumn("slice", F.pmod(F.xxhash64("term"), F.ceil(F.col("postings") / POSTINGS)).cast("int"))
    schema, names = "lang string, a string, b string, value long", ["lang", "a", "b", "value"]

    def both(key, got):
        coded = got.column("source").combine_chunks().dictionary_encode()
        rank = np.argsort(np.argsort(np.array([x.encode() for x in coded.dictionary.to_pylist()], object)))
        source = rank[coded.indices.to_numpy()].astype(np.int64)
        term = got.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
        n, total, v = (got.column(c).to_numpy() for c in ("n", "total", "lang_types"))
        a, b, s = shared_sums(source, term, probability(n, total, v), probability(np.zeros_like(n), total, v))
        by_rank = coded.dictionary.take(pa.array(np.argsort(rank)))
        return pa.table([pa.array([key[0].as_py()] * len(a), pa.string()), by_rank.take(pa.array(a)), by_rank.take(pa.array(b)), pa.array(s)], names=names)

    common = rows.select("lang", "source", "term", "n", "total", "lang_types", "slice").groupBy("lang", "slice").applyInArrow(both, schema)
    # a row for each source, with its numbers of terms by count, and all sources of its language: a result has a row for each pair
    buckets = real.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("m")).groupBy("lang", "source").agg(F.collect_list(F.struct("n", "m")).alias("counts"))
    others = groups.groupBy("lang").agg(F.collect_list(F.struct("source", "total")).alias("others"))
    alone = groups.join(buckets, ["lang", "source"], "left").join(others, "lang").select("lang", "source", "total", "lang_types", "counts", "others")

    def one_sided(batches):
        for batch in batches:
            for row in batch.to_pylist():
                v, total, mine = row["lang_types"], row["total"], row["source"].encode()
                n, m = (np.array([x[c] for x in row["counts"] or []], np.int64) for c in ("n", "m"))
                out = []
                for other in row["others"]:
                    theirs = other["source"].encode()
                    if theirs == mine:
                        continue
                    value = 0
                    if v:
                        q, p0 = (int(probability(0, x, v)) for x in (other["total"], total))
                        value = int((m * (divergence(probability(n, total, v), q) - divergence(p0, q))).sum()) + (v * divergence(p0, q) if mine < theirs else 0)
                    a, b = (row["source"], other["source"]) if mine < theirs else (other["source"], row["source"])
                    out.append((row["lang"], a, b, value))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(),) * 3 + (pa.int64(),), strict=True)], names=names)

    sums = common.unionByName(alone.mapInArrow(one_sided, schema)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("w")
    return _ranked(sums.select("lang", ways, "value").select("lang", "w.source", "w.item", "value"))


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): parts pair and term of every (lang, source) of docs (lang, source, text).

    Null languages, sources and texts count as empty ones; a group whose documents have no terms, or whose language keeps none, has its
    pairs (value 0 where V is 0) and no terms; rows that repeat count each; ties go by the item's bytes; other columns are not read; an empty table gives no rows.
    """
    terms = kept_terms(docs)
    groups = group_sizes(terms)
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return part(source_pairs(terms, groups), "pair").unionByName(part(telling_terms(terms, groups), "term"))
