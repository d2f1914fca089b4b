"""WARC archives: write monolithic gzip files, normalise them to one gzip member a record with an offset index, read them back.

A monolithic file is a single gzip stream, so nothing in it can be reached without inflating all before it.  The normaliser inflates
each file once, as a stream, rewrites every record as a member of its own and writes ``<file>.cdx`` beside it: a line of JSON for
each record with its offset and length.  A record whose payload another one holds becomes a revisit: its block keeps the HTTP
headers and loses the payload.  Payloads never travel through a shuffle; only digests and decisions do.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import reading, writing
from .shared import shared_dir, skew_join, table

#: Payload bytes of an archive, and records of it, after which the next archive begins.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 64 << 20, 50_000
LEVEL = 6
_PIECE = 1 << 18
_DATE = "2024-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _line(value) -> str:
    return str(value).replace("\r", " ").replace("\n", " ")


def record(page_id, url, payload: bytes, sha: str, refers_to=None, revisit: bool = False) -> bytes:
    """One record.  A revisit's HTTP headers still tell the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if revisit:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{sha}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def inflate(stream) -> Iterator[bytes]:
    """The content of a gzip file, piece by piece; of one member or many."""
    engine = zlib.decompressobj(31)
    while data := stream.read(_PIECE):
        while data:
            yield engine.decompress(data)
            data = engine.unused_data
            if engine.eof:
                engine = zlib.decompressobj(31)


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, raw headers, block) of each record; memory holds one record."""
    held = bytearray()

    def more() -> bool:
        for x in pieces:
            if x:
                held.extend(x)
                return True
        return False

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("the archive ends within a record's headers")
                return
        raw = bytes(held[:end])
        head = parse_head(raw)
        size = int(head["content-length"])
        while len(held) < end + 8 + size:
            if not more():
                raise ValueError("the archive ends within a record's block")
        yield head, raw, bytes(held[end + 4 : end + 4 + size])
        del held[: end + 8 + size]


def write_monolithic(pages: DataFrame, path: str) -> DataFrame:
    """Write a response record for each row of pages (page_id, url, html; null html: empty) to monolithic files below path.

    Gives (archive, seq, page_id, digest, payload_bytes, check), as a written table; check is a second hash of the payload.  An archive is filled by one task, in the order of its rows.
    """

    def run(batches):
        part = TaskContext.get().partitionId()
        rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
        ahead, number = next(rows, None), 0
        while ahead is not None:
            name, index, filled = f"part-{part:06d}-{number:05d}.warc.gz", [], 0
            with writing(f"{path}/{name}") as out:
                engine = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                while ahead is not None and filled < ARCHIVE_BYTES and len(index) < ARCHIVE_RECORDS:
                    page_id, url, html = ahead
                    payload = (html or "").encode()
                    sha = digest(payload)
                    out.write(engine.compress(record(page_id, url, payload, sha)))
                    index.append((name, len(index), page_id, sha, len(payload), xxhash.xxh64_intdigest(payload) - (1 << 63)))
                    filled += len(payload)
                    ahead = next(rows, None)
                out.write(engine.flush())
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*index, strict=True), kinds, strict=True)], names=names)

    names = ["archive", "seq", "page_id", "digest", "payload_bytes", "check"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    return table(rows.mapInArrow(run, "archive string, seq long, page_id long, digest string, payload_bytes long, check long"), "warc-rows")


#: What equal payloads agree in.
_PAYLOAD = ["digest", "payload_bytes", "check"]


def decide(index: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(archive, revisits: array of (seq, refers_to)): of records with equal payloads of least_bytes or more, the smallest page_id's
    stays a response and the others refer to it.  Rows that share the smallest page_id: the first in (archive, seq) stays.  Rows
    without page_id come last; where a group has no other, refers_to is null."""
    best = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "archive", "seq")).alias("best")
    groups = index.where(F.col("payload_bytes") >= least_bytes).groupBy(*_PAYLOAD).agg(best, F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = table(groups.select(*_PAYLOAD, "n", F.col("best.page_id").alias("first_id"), F.col("best.archive").alias("first_archive"), F.col("best.seq").alias("first_seq")), "payload-groups")
    found = skew_join(index, groups, _PAYLOAD, "n")
    again = found.where(F.col("n").isNotNull() & ~((F.col("archive") == F.col("first_archive")) & (F.col("seq") == F.col("first_seq"))))
    # an archive has at most ARCHIVE_RECORDS records
    some = again.groupBy("archive").agg(F.collect_list(F.struct("seq", F.col("first_id").alias("refers_to"))).alias("revisits"))
    return index.select("archive").distinct().join(some, "archive", "left")


def normalise(archives: DataFrame, source: str, target: str) -> DataFrame:
    """Inflate each archive below source once and write it, a member a record, below target with its .cdx beside it.

    archives: (archive, revisits) as :func:`decide` gives them.  Gives (archive, records, bytes), as a written table: the work is done.
    """

    def run(batches):
        for b in batches:
            for name, revisits in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                refers = {x["seq"]: x["refers_to"] for x in revisits or ()}
                at, n, lines = 0, 0, []
                with reading(f"{source}/{name}") as stream, writing(f"{target}/{name}") as out:
                    for seq, (head, raw, block) in enumerate(records(inflate(stream))):
                        if seq in refers:
                            page = head["warc-record-id"][len("<urn:page:") : -1]
                            payload = block[block.index(b"\r\n\r\n") + 4 :]
                            data = record(None if page == "null" else page, head.get("warc-target-uri"), payload, head["warc-payload-digest"][5:], refers[seq], True)
                        else:
                            data = raw + b"\r\n\r\n" + block + b"\r\n\r\n"
                        engine = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = engine.compress(data) + engine.flush()
                        out.write(member)
                        lines.append(json.dumps({"offset": at, "length": len(member), "id": head["warc-record-id"], "type": "revisit" if seq in refers else "response"}))
                        at += len(member)
                        n += 1
                with writing(f"{target}/{name}.cdx") as out:
                    out.write("\n".join(lines).encode())
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n]), pa.array([at])], names=["archive", "records", "bytes"])

    n = max(1, archives.sparkSession.sparkContext.defaultParallelism * 3)
    spread = archives.repartition(n, F.xxhash64("archive"))
    return table(spread.mapInArrow(run, "archive string, records long, bytes long"), "warc-normalised")


def read(archives: DataFrame, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record of normalised archives, member by member.

    The offsets come from the .cdx.  A response's length and digest are computed from its payload and must be those of its headers.
    """

    def number(urn: str) -> int | None:
        text = urn[len("<urn:page:") : -1]
        return None if text == "null" else int(text)

    def run(batches):
        for b in batches:
            for name in b.column(0).to_pylist():
                with reading(f"{path}/{name}.cdx") as f:
                    index = [json.loads(x) for x in f.read().decode().splitlines()]
                rows = []
                with reading(f"{path}/{name}", random=True) as f:
                    for entry in index:
                        f.seek(entry["offset"])
                        head, _, block = next(records(iter([zlib.decompress(f.read(entry["length"]), 31)])))
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(next(x for x in http.decode().split("\r\n") if x.lower().startswith("content-length:")).split(":")[1])
                        sha = head["warc-payload-digest"][5:]
                        kind = head["warc-type"]
                        if kind == "response" and (len(payload) != size or digest(payload) != sha):
                            raise ValueError(f"{name}: the record at {entry['offset']} doesn't have the payload that it names")
                        rows.append((number(head["warc-record-id"]), size, sha, kind, number(head["warc-refers-to"]) if kind == "revisit" else None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    n = max(1, archives.sparkSession.sparkContext.defaultParallelism * 3)
    spread = archives.select("archive").repartition(n, F.xxhash64("archive"))
    return spread.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(spark: SparkSession, pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write pages as monolithic archives, normalise them and read the records back; an empty table gives an empty result."""
    raw, out = shared_dir(spark, "warc-raw"), shared_dir(spark, "warc")
    index = write_monolithic(pages, raw)
    done = normalise(decide(index, least_bytes), raw, out)
    return read(done, out)
