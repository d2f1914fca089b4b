"""Ranked lexical search: an index of document shards, and the best documents of each query.

A shard holds some documents' postings as CSR arrays with precomputed integer impacts, in a row of a written Parquet table, so that a lost
executor's shards are read again.  A search takes queries in blocks.  It sums the shards' document frequencies of a block's terms, then
adds, term at a time, weight times impact into a dense array over a shard's documents, takes the shard's best with all ties told apart
by doc_id, and merges the bests of shards within each task and then of tasks.

A term is a maximal run of digits, letters and characters outside ASCII, A-Z in lower case.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import shared_dir, small_batches, table
from .textbuf import ALNUM, LOWER, chunks, utf8, words

#: Bytes of text in a shard (or one document).
SHARD_BYTES = 16 << 20
#: A block of queries has about so many of them and bytes of terms.
BLOCK_QUERIES, BLOCK_BYTES = 2_048, 4 << 20
#: Best documents of a query.
BEST = 50
INDEX = "rows long, full long, terms binary, postings binary, ids binary"


def term_column(column, member: np.ndarray = ALNUM) -> tuple[pa.LargeStringArray, np.ndarray]:
    """All terms of a text column in order, and the number of each row's."""
    buf, off = utf8(column)
    low = LOWER[buf]
    w = words(low, off, member)
    ends = np.concatenate([[0], np.cumsum(w.end - w.start)])
    return pa.LargeStringArray.from_buffers(len(w.start), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(low[member[low]]))), w.counts


def _packed(**columns) -> bytes:
    sink, made = pa.BufferOutputStream(), pa.table(columns)
    with pa.ipc.new_stream(sink, made.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(made)
    return sink.getvalue().to_pybytes()


def _unpacked(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(body).read_all()


def sizes(docs: DataFrame) -> tuple[int, int]:
    """(documents with a term, all terms with repeats)."""

    def run(batches):
        for b in batches:
            n = term_column(b.column(0))[1]
            yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], names=["docs", "terms"])

    small_batches(docs.sparkSession)
    got = docs.select("text").mapInArrow(run, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return got[0] or 0, got[1] or 0


def _shard(held: pa.Table, n_docs: int, n_terms: int) -> pa.RecordBatch:
    """A row of the index for a shard of (doc_id, text): its documents are numbered by doc_id, nulls last."""
    held = held.take(pc.sort_indices(held, sort_keys=[("doc_id", "ascending")], null_placement="at_end"))
    terms, n = term_column(held.column("text"))
    coded = terms.dictionary_encode()
    rows = max(1, len(n))
    key, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * rows + np.repeat(np.arange(len(n)), n), return_counts=True)
    term, doc = key // rows, key % rows
    length = np.array([50 + 50 * x * n_docs // max(1, n_terms) for x in n.tolist()], np.int64)
    impact = 1_000_000_000 * tf // (1000 * tf + 20 * length[doc])
    starts = np.searchsorted(term, np.arange(len(coded.dictionary) + 1))
    parts = {
        "terms": _packed(term=coded.dictionary, start=pa.array(starts[:-1].astype(np.int32)), n=pa.array(np.diff(starts).astype(np.int32))),
        "postings": _packed(doc=pa.array(doc.astype(np.int32)), impact=pa.array(impact.astype(np.int32))),
        "ids": _packed(doc_id=held.column("doc_id")),
    }
    numbers = {"rows": len(n), "full": int((n > 0).sum())}
    return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*numbers.values(), *parts.values())], names=[*numbers, *parts])


def build(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of all rows of docs (doc_id of any type, text), a written table of :data:`INDEX` with a row for each shard: its documents,
    those with a term, and its parts.

    Null texts have no terms; a row without doc_id is indexed like any other; rows that repeat are separate documents; other columns are
    not read.
    """
    n_docs, n_terms = sizes(docs)

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            off = utf8(b.column(1))[1]
            for r0, r1 in chunks(off, shard_bytes):
                more = int(off[r1] - off[r0])
                if held and size + more > shard_bytes:
                    yield _shard(pa.Table.from_batches(held), n_docs, n_terms)
                    held, size = [], 0
                held.append(b.slice(r0, r1 - r0))
                size += more
        if held:
            yield _shard(pa.Table.from_batches(held), n_docs, n_terms)

    return table(docs.select("doc_id", "text").mapInArrow(run, INDEX), "lexical-index")


def query_blocks(items: DataFrame) -> tuple[DataFrame, list[int]]:
    """(a written table (block, query, item_id, terms), block numbers): a query for each row of items (item_id, text) with a term, its
    terms once each.  Blocks have about BLOCK_QUERIES queries or BLOCK_BYTES bytes of terms."""
    kind = dict(items.dtypes)["item_id"]

    def run(batches):
        for b in batches:
            terms, n = term_column(b.column(1))
            lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)])), terms)
            unique = [list(dict.fromkeys(x)) for x in lists.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(unique, pa.list_(pa.string()))], names=["item_id", "terms"])

    found = items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, terms array<string>").where(F.size("terms") > 0)
    found = table(found.select(F.monotonically_increasing_id().alias("query"), "item_id", "terms"), "lexical-queries")
    got = found.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.array_join("terms", " ")))).first()
    n = max(1, math.ceil(got[0] / BLOCK_QUERIES), math.ceil((got[1] or 0) / BLOCK_BYTES))
    return found.select(F.pmod(F.xxhash64("query"), F.lit(n)).cast("int").alias("block"), "query", "item_id", "terms"), list(range(n)) if got[0] else []


def _frequencies(index: DataFrame, terms: pa.Array) -> np.ndarray:
    """In how many documents each of a block's terms occurs."""

    def run(batches):
        df = np.zeros(len(terms), np.int64)
        for b in batches:
            for body in b.column(0):
                shard = _unpacked(body.as_py())
                at = pc.index_in(terms, value_set=shard.column("term").combine_chunks())
                seen = at.is_valid().to_numpy(zero_copy_only=False)
                df[seen] += shard.column("n").to_numpy()[at.drop_null().to_numpy()]
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(df[seen])], names=["term", "n"])

    got = index.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a block's terms
    df = np.zeros(len(terms), np.int64)
    df[got.column("term").to_numpy()] = got.column("n").to_numpy()
    return df


def best_rows(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores above 0; of those that tie for the last place, the first ones."""
    if len(score) > k:
        top = np.argpartition(score, len(score) - k)[len(score) - k :]
        least = score[top].min()
        if least > 0:
            above = np.flatnonzero(score > least)
            return np.concatenate([above, np.flatnonzero(score == least)[: k - len(above)]])
    return np.flatnonzero(score > 0)


def _merged(found: pa.Table, k: int) -> pa.Table:
    """The k best rows of each query of (query, doc_id, score); ties by doc_id, nulls last."""
    found = found.take(pc.sort_indices(found, sort_keys=[("query", "ascending"), ("score", "descending"), ("doc_id", "ascending")], null_placement="at_end"))
    query = found.column("query").to_numpy()
    first = np.concatenate([[True], query[1:] != query[:-1]]) if len(query) else np.zeros(0, bool)
    rank = np.arange(len(query)) - np.repeat(np.flatnonzero(first), np.diff(np.append(np.flatnonzero(first), len(query))))
    return found.filter(pa.array(rank < k))


def _searched(index: DataFrame, kind: str, terms: pa.Array, weight: np.ndarray, queries: list[tuple[int, np.ndarray]], k: int) -> DataFrame:
    """(query, doc_id, score): of each task's shards the k best documents of each query, given as places in terms."""
    schema = f"query long, doc_id {kind}, score long"

    def run(batches):
        so_far = None
        for b in batches:
            for t, p, i in zip(b.column(0), b.column(1), b.column(2), strict=True):
                shard, ids = _unpacked(t.as_py()), _unpacked(i.as_py()).column("doc_id").combine_chunks()
                at = pc.index_in(terms, value_set=shard.column("term").combine_chunks()).fill_null(-1).to_numpy()
                start, n = shard.column("start").to_numpy(), shard.column("n").to_numpy()
                postings = _unpacked(p.as_py())
                doc, impact = postings.column("doc").to_numpy(), postings.column("impact").to_numpy()
                score = np.zeros(len(ids), np.int64)
                numbers, rows, scores = [], [], []
                for number, places in queries:
                    score.fill(0)
                    for j in places:
                        if at[j] >= 0 and weight[j]:
                            s = start[at[j]]
                            e = s + n[at[j]]
                            score[doc[s:e]] += weight[j] * impact[s:e].astype(np.int64)
                    best = best_rows(score, k)
                    numbers.append(np.full(len(best), number, np.int64))
                    rows.append(best)
                    scores.append(score[best])
                got = pa.table([pa.array(np.concatenate(numbers)), ids.take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(scores))], names=["query", "doc_id", "score"])
                so_far = _merged(got if so_far is None else pa.concat_tables([so_far, got]), k)
        if so_far is not None:
            yield from so_far.to_batches()

    return index.select("terms", "postings", "ids").mapInArrow(run, schema)


def search(index: DataFrame, items: DataFrame, kind: str = "bigint", k: int = BEST) -> DataFrame:
    """(item_id, rank from 1, doc_id, score) of the k best documents of each row of items (item_id, text), scores above 0 only; a written table.

    kind: the type of doc_id.  Equal scores go by ascending doc_id, null last.  An item without terms, or a null one, finds nothing;
    items that repeat are each answered; an empty index or an empty table of items gives no rows.
    """
    spark = index.sparkSession
    n_docs = index.agg(F.sum("full")).first()[0] or 0
    asked, blocks = query_blocks(items)
    of_item = dict(items.dtypes)["item_id"]
    schema = f"item_id {of_item}, rank int, doc_id {kind}, score long"
    path = shared_dir(spark, "lexical-best")
    for block in blocks:
        some = asked.where(F.col("block") == block)
        got = some.orderBy("query").toArrow()  # bounded by the block
        if not got.num_rows:
            continue
        lists = got.column("terms").combine_chunks()
        coded = lists.flatten().dictionary_encode()
        terms = coded.dictionary
        off = lists.offsets.to_numpy() - lists.offsets.to_numpy()[0]
        queries = [(q, coded.indices.to_numpy()[off[i] : off[i + 1]]) for i, q in enumerate(got.column("query").to_pylist())]
        df = _frequencies(index, terms)
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        each = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = _searched(index, kind, terms, weight, queries, k).withColumn("rank", F.row_number().over(each)).where(F.col("rank") <= k)
        best.join(F.broadcast(some.select("query", "item_id")), "query").select("item_id", "rank", "doc_id", "score").write.mode("append").parquet(path)
    if not blocks:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def rank(docs: DataFrame, items: DataFrame, k: int = BEST, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """:func:`search` of items over all rows of docs; see :func:`build` for nulls, repeats and other columns."""
    return search(build(docs, shard_bytes), items, dict(docs.dtypes)["doc_id"], k)
