"""Blocks of documents in the shared folder, and exchanges of sorted 64-bit keys between them.

A block is an Arrow file of whole documents, written once, so that every later pass sees the same rows under the same block name
whichever executor runs it.  In an exchange each block sends its distinct keys, in one message for each of P key ranges; whoever
holds a range sees a key of every block and answers each message with a value for each of its keys, in the message's order.  Keys
are uniform hashes, so ranges are even; a key that a third of all rows share is one entry a block.  Texts never travel.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .files import reading, writing
from .shared import release, shared_dir, table
from .textbuf import chunks, trim, utf8

#: Bytes of text in a block (or one document), and about how many bytes of a corpus a key range answers for.
BLOCK_BYTES, RANGE_BYTES = 6 << 20, 12 << 20
BLOCKS_A_TASK = 64
MESSAGE = "block string, p int, keys binary, extra binary"


def write_blocks(docs: DataFrame, name: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, str, int]:
    """(a table of (block, bytes), the folder, all bytes) for docs (doc_id, text, and any further columns)."""
    path = shared_dir(docs.sparkSession, f"{name}-blocks")

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        size = 0

        def give():
            nonlocal number, held, size
            block = f"{part:06d}-{number:05d}"
            with writing(f"{path}/{block}") as out, pa.ipc.new_file(out, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as f:
                for x in held:
                    f.write_batch(x)
            got = pa.RecordBatch.from_arrays([pa.array([block]), pa.array([size], pa.int64())], names=["block", "bytes"])
            number, held, size = number + 1, [], 0
            return got

        for b in batches:
            off = utf8(b.column("text"))[1]
            for r0, r1 in chunks(off, block_bytes):
                more = int(off[r1] - off[r0])
                if held and size + more > block_bytes:
                    yield give()
                held.append(b.slice(r0, r1 - r0))
                size += more
        if held:
            yield give()

    made = table(docs.mapInArrow(run, "block string, bytes long"), f"{name}-list")
    return made, path, made.agg(F.sum("bytes")).first()[0] or 0


def read_block(path: str, block: str) -> pa.Table:
    with reading(f"{path}/{block}", random=True) as f:
        return pa.ipc.open_file(f).read_all()


def ranges(n_bytes: int, spark) -> int:
    """P: grows with the corpus, so that what one range receives doesn't."""
    return max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_bytes / RANGE_BYTES))


def unpack(data: bytes, small: bool = False) -> np.ndarray:
    """Keys of a message."""
    rows = unsqueeze(data, 8) if small else np.frombuffer(data, np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(rows).view(np.uint64).ravel(), dtype=np.uint64)


def range_of(keys: np.ndarray, p: int) -> np.ndarray:
    """Key range of sorted keys; ascending."""
    return ((keys >> np.uint64(32)) * np.uint64(p) >> np.uint64(32)).astype(np.int64)


def messages(block: str, keys: np.ndarray, extra: np.ndarray, p: int, small: bool = False) -> pa.RecordBatch:
    """A block's messages: sorted keys, and bytes (rows of uint8) that go with them.

    Keys travel as differences, byte plane by byte plane.  small: compressed by zstd, else left to the shuffle's own codec.
    """
    form = squeeze if small else lambda x: np.ascontiguousarray(x.T).tobytes()
    keyed = lambda k: np.diff(k, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)
    cut = np.searchsorted(range_of(keys, p), np.arange(p + 1))
    at = np.flatnonzero(np.diff(cut))
    return pa.RecordBatch.from_arrays(
        [pa.array([block] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array([form(keyed(keys[cut[i] : cut[i + 1]])) for i in at], pa.binary()), pa.array([form(extra[cut[i] : cut[i + 1]]) for i in at], pa.binary())],
        names=["block", "p", "keys", "extra"],
    )


def squeeze(rows: np.ndarray) -> bytes:
    """Rows of bytes, plane by plane, compressed."""
    raw = np.ascontiguousarray(rows.T).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True) if raw else b"")


def unsqueeze(data: bytes, width: int) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    raw = pa.Codec("zstd").decompress(data[8:], decompressed_size=size, asbytes=True) if size else b""
    return np.frombuffer(raw, np.uint8).reshape(width, -1).T


def planes(*columns: np.ndarray) -> np.ndarray:
    """Rows of bytes of columns of numbers."""
    return np.concatenate([np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize * (c.shape[1] if c.ndim > 1 else 1)) for c in columns], axis=1)


def column(rows: np.ndarray, at: int, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(rows[:, at : at + width]).view(kind).ravel()


def replied(sent: DataFrame, reply: Callable, name: str, small: bool = True) -> DataFrame:
    """A written table (block, p, answer, more, stats, heavy): reply(keys, extras, p) gets all messages of range p, as lists, and gives an
    answer in bytes for each, or a pair of them (answer, more), a list of numbers to be summed over all ranges, and rows (key, numbers) about the few heavy keys."""

    def run(key, got):
        out, stats, heavy = reply([unpack(x, small) for x in got.column("keys").to_pylist()], got.column("extra").to_pylist(), key[0].as_py())
        none = [None] * (len(out) - 1)
        out, more = zip(*(x if isinstance(x, tuple) else (x, None) for x in out), strict=True)
        return pa.table(
            [got.column("block"), got.column("p"), pa.array(out, pa.binary()), pa.array(more, pa.binary()), pa.array([stats, *none], pa.list_(pa.int64())), pa.array([heavy, *none], pa.list_(pa.struct([("key", pa.int64()), ("numbers", pa.list_(pa.float64()))])))],
            names=["block", "p", "answer", "more", "stats", "heavy"],
        )

    out = table(sent.groupBy("p").applyInArrow(run, "block string, p int, answer binary, more binary, stats array<bigint>, heavy array<struct<key:bigint,numbers:array<double>>>"), name)
    release(sent)
    return out


def answers(sent: DataFrame, reply: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int, name: str) -> DataFrame:
    """A written table (block, p, answer): reply(keys, extra) gives answer bytes (rows of uint8) for all messages of a range at once.

    keys aren't sorted across messages; equal keys are what different blocks have said of the same thing.
    """

    def each(keys, extras, p):
        sizes = [len(x) for x in keys]
        extra = [np.frombuffer(x, np.uint8).reshape(width, n).T for x, n in zip(extras, sizes, strict=True)]
        out = reply(np.concatenate(keys), np.concatenate(extra))
        return [np.ascontiguousarray(x.T).tobytes() for x in np.split(out, np.cumsum(sizes)[:-1])], [], []

    return replied(sent, each, name, small=False).select("block", "p", "answer")


def joined(answer: list[tuple[int, bytes]], width: int) -> np.ndarray:
    """A block's answers in the order of its sorted keys: rows of width bytes."""
    parts = [np.frombuffer(x, np.uint8).reshape(width, -1).T for _, x in sorted(answer)]
    return np.concatenate(parts) if parts else np.zeros((0, width), np.uint8)


def tasks(blocks: DataFrame) -> int:
    return max(1, blocks.sparkSession.sparkContext.defaultParallelism * 3, blocks.count() // BLOCKS_A_TASK)


def each_block(blocks: DataFrame, run: Callable, schema: str, *answered: DataFrame) -> DataFrame:
    """run(block, [answers of each table as (p, bytes)]) for every block, gives record batches of schema.

    Tasks have BLOCKS_A_TASK blocks each, or fewer so that all cores are busy, however few bytes a block's answers have.
    """
    n = tasks(blocks)
    if not answered:

        def over(batches):
            for b in batches:
                for block in b.column(0).to_pylist():
                    yield from run(block, [])
                    trim()

        return blocks.select("block").repartition(n, F.xxhash64("block")).mapInArrow(over, schema)
    rows = blocks.select("block", F.lit(-1).alias("k"), F.lit(-1).alias("p"), F.lit(None).cast("binary").alias("answer"))
    for k, a in enumerate(answered):
        rows = rows.unionByName(a.select("block", F.lit(k).alias("k"), "p", "answer"))
    count, empty = len(answered), to_arrow_schema(StructType.fromDDL(schema)).empty_table()

    def grouped(key, got):
        held: list = [[] for _ in range(count)]
        for k, p, a in zip(got.column("k").to_pylist(), got.column("p").to_pylist(), got.column("answer").to_pylist(), strict=True):
            if k >= 0:
                held[k].append((p, a))
        out = list(run(key[0].as_py(), held))
        trim()
        return pa.Table.from_batches(out) if out else empty

    return rows.repartition(n, "block").groupBy("block").applyInArrow(grouped, schema)
