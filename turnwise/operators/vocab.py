"""Frequency-ranked vocabularies, encoding, token tools, shards."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from turnwise.functions.text import tokens


def exploded(rows: DataFrame, text: str, order: list[str]) -> DataFrame:
    return rows.select(*order, F.posexplode(tokens(F.col(text))).alias("pos", "token"))


def frequencies(rows: DataFrame, text: str, order: list[str]) -> DataFrame:
    """(token, n, first): first is the place of the first occurrence, which breaks ties."""
    return exploded(rows, text, order).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order, "pos")).alias("first"))


def top(freq: DataFrame, k: int) -> DataFrame:
    """The k most frequent, ties by first occurrence (a heap in each task, then one merge of k rows each)."""
    return freq.orderBy(F.desc("n"), "first").limit(k)


def vocabulary(freq: DataFrame, size: int, names: DataFrame | None = None, n_names: int = 0) -> DataFrame:
    """(id, token, n, kind): <pad>, <EOS>, the size - 3 most frequent words, <unk>; then n_names - 1 names and <unk_name>."""
    spark = freq.sparkSession
    rank = lambda df: df.withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "first")))  # noqa: E731  size rows at most
    words = rank(top(freq, size - 3)).select((F.col("r") + 1).cast("int").alias("id"), "token", "n", F.lit("word").alias("kind"))
    n_words = F.coalesce(F.max(F.when(F.col("kind") == "word", F.col("id"))), F.lit(1))
    fixed = spark.createDataFrame([(0, "<pad>", 0, "special"), (1, "<EOS>", 0, "special")], "id int, token string, n long, kind string")
    out = fixed.unionByName(words)
    unk = words.agg((n_words + 1).cast("int").alias("id")).select("id", F.lit("<unk>").alias("token"), F.lit(0).cast("long").alias("n"), F.lit("special").alias("kind"))
    out = out.unionByName(unk)
    if names is not None:
        named = rank(top(names, n_names - 1)).crossJoin(unk.select(F.col("id").alias("u")))  # one row
        named = named.select((F.col("u") + F.col("r")).cast("int").alias("id"), "token", "n", F.lit("name").alias("kind"))
        last = named.agg(F.max("id").alias("m")).crossJoin(unk.select(F.col("id").alias("u")))
        out = out.unionByName(named).unionByName(last.select((F.coalesce("m", "u") + 1).cast("int").alias("id"), F.lit("<unk_name>").alias("token"), F.lit(0).cast("long").alias("n"), F.lit("special").alias("kind")))
    return out


def encode(rows: DataFrame, text: str, keys: list[str], vocab: DataFrame, end: int = 1) -> DataFrame:
    """(keys, ids): ids of the text's words, <unk>'s for others, then the end's."""
    return encoded(rows.select(*keys, F.col(text).alias("_text")), {"ids": "_text"}, vocab, end).select(*keys, "ids")


def encoded(rows: DataFrame, texts: dict[str, str], vocab: DataFrame, end: int = 1) -> DataFrame:
    """rows with a column of ids for each text, by name: ids of its words, <unk>'s for others, then the end's.

    vocab (id, token) has a set size, so the driver sends it; texts are encoded where they are, a batch at a time.
    """
    known = vocab.select("id", "token").orderBy("id").toArrow()
    tokens_of, ids_of = known.column("token").combine_chunks(), known.column("id").combine_chunks().cast("int32")
    unknown = next((i for i, t in zip(ids_of.to_pylist(), tokens_of.to_pylist(), strict=True) if t == "<unk>"), None)
    names = list(texts)

    def coded(column):
        import pyarrow as pa
        import pyarrow.compute as pc

        lists = column.cast(pa.list_(pa.string()))
        at = pc.index_in(lists.values, value_set=tokens_of)
        got = pc.fill_null(pc.take(ids_of, at), unknown).to_numpy(zero_copy_only=False)
        off = lists.offsets.to_numpy()
        sizes = np.diff(off)
        ids = np.full(int(sizes.sum()) + len(sizes), end, np.int32)
        place = np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)
        ids[place] = got[off[0] : off[-1]]
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes + 1)]).astype(np.int32)), pa.array(ids))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            n = b.num_columns - len(names)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *(coded(b.column(n + k)) for k in range(len(names)))], names=[*b.schema.names[:n], *names])

    words = [F.coalesce(tokens(F.col(t)), F.array().cast("array<string>")).alias(n) for n, t in texts.items()]
    fields = [*rows.schema.fields, *(StructField(n, ArrayType(IntegerType())) for n in names)]
    return rows.select(*rows.columns, *words).mapInArrow(run, StructType(fields))


def without(text: Column, stop: list[str]) -> Column:
    """The text's words but the stop words, joined by one space; a word list has a set size."""
    return F.array_join(F.filter(tokens(text), lambda t: ~t.isin(stop)), " ")


def shard_of(ordinal: Column, n: int) -> Column:
    return F.pmod(ordinal, F.lit(n))


def shuffled(rows: DataFrame, keys: list[str], seed: int = 42) -> DataFrame:
    """Rows by a seeded hash of their keys: the same order whatever the partitions."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *keys), *keys)


def pack_starts(change: np.ndarray, sizes: tuple[np.ndarray, ...], length: int) -> np.ndarray:
    """First rows of packs: as many rows in a row without a change as have no more than length in any of sizes; at least one."""
    n = len(change)
    upto = [np.concatenate([[0], np.cumsum(x)]) for x in sizes]
    runs = np.append(np.flatnonzero(change), n)
    starts, at = [], 0
    while at < n:
        starts.append(at)
        fits = min(int(np.searchsorted(u, u[at] + length, "right")) - 1 for u in upto)
        at = max(at + 1, min(fits, int(runs[np.searchsorted(runs, at, "right")])))
    return np.array(starts, np.int64)


def packed(rows: DataFrame, keys: list[str], length: int) -> DataFrame:
    """(keys, inputs, targets, and of each the segment, from 1, and the place in it): consecutive rows (keys, inputs, targets) of the
    same keys put together as long as either side fits in length ids.  Longer rows stay alone and whole.

    A pack's ids lie one after the other already, so packing moves offsets and no lists; a batch's last pack goes on with the next batch.
    """
    sides = ("inputs", "targets")
    lists = [StructField(f"{s}{x}", ArrayType(IntegerType())) for s in sides for x in ("", "_segmentation", "_position")]
    schema = StructType([*(rows.schema[k] for k in keys), *lists])
    arrow = to_arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        held = None

        def given(t, starts, end):
            """Packs of rows up to end."""
            cols = [t.column(k).take(pa.array(starts)) for k in keys]
            bounds = np.append(starts, end)
            segment = np.arange(end) - np.repeat(starts, np.diff(bounds)) + 1
            for s in sides:
                column = t.column(s)
                off = column.offsets.to_numpy()[: end + 1].astype(np.int64)
                n = np.diff(off)
                cut = pa.array((off[bounds] - off[0]).astype(np.int32))
                place = np.arange(n.sum()) - np.repeat(off[:-1] - off[0], n)
                flat = column.values.slice(off[0], off[-1] - off[0])
                cols += [pa.ListArray.from_arrays(cut, x) for x in (flat, pa.array(np.repeat(segment, n).astype(np.int32)), pa.array(place.astype(np.int32)))]
            return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        for b in batches:
            t = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks()
            t = t.to_batches()[0] if t.num_rows else None
            if t is None:
                continue
            change = np.zeros(t.num_rows, bool)
            for k in keys:
                code = t.column(k).dictionary_encode().indices.fill_null(-1).to_numpy()
                change[1:] |= code[1:] != code[:-1]
            starts = pack_starts(change, tuple(np.diff(t.column(s).offsets.to_numpy()) for s in sides), length)
            if len(starts) > 1:
                yield given(t, starts[:-1], int(starts[-1]))
            held = t.slice(int(starts[-1]))
        if held is not None:
            held = pa.Table.from_batches([held]).combine_chunks().to_batches()[0]
            yield given(held, np.zeros(1, np.int64), held.num_rows)

    return rows.select(*keys, *sides).mapInArrow(run, schema)
