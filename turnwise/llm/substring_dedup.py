"""Substring de-duplication: repeated token k-mers, compacted to paths of a De Bruijn graph, verified by source coordinates.

The k-mers are windows of ``window`` words.  They are the graph's edges; their first and last window-1 words are its nodes.

1. Every window is named by its minimiser, the 16-word run with the smallest hash in it.  Windows with equal words have equal
   minimisers at equal offsets, so only windows whose minimiser occurs twice can repeat.  Blocks exchange about a tenth of their
   positions to learn which do.
2. The candidates' own hashes are exchanged: an edge that occurs twice, anywhere, is a repeated edge.  The graph is of these.
3. Consecutive repeated edges of a document are a walk.  Blocks exchange their walks' nodes with the edges before and after: where
   occurrences don't agree (a branch, or a walk that begins or ends) walks are cut.  Each repeated edge then lies in one piece only,
   and whoever holds one of a piece's edges holds all of it.
4. Pieces of all documents are grouped by their words (length, hash and SHA-256 of the words at their source coordinates); a piece
   that two coordinates hold is verified.  Spark joins compact pieces that meet in a node without branches to one path, by pointer
   jumping over written tables.
5. Every word that an occurrence of a verified path's piece covers is removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK_BYTES, MESSAGE, answers, each_block, joined, messages, planes, ranges, read_block, tasks, write_blocks
from .shared import table
from .textbuf import hash_spans, mix, rolling, trim, utf8, words

WINDOW, ANCHOR = 35, 16
_POSITION = 24


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    have, width = x, 1
    while width * 2 <= w:
        have = np.minimum(have[: len(have) - width], have[width:])
        width *= 2
    return np.minimum(have[: len(x) - w + 1], have[w - width : w - width + len(x) - w + 1]) if width < w else have


class BlockWindows:
    """A block's words, its windows, and what names them.  start: first word of each window that lies within a document."""

    def __init__(self, got: pa.Table, window: int, anchor: int):
        self.ids = got.column("doc_id")
        self.text = utf8(got.column("text"))
        self.words = words(*self.text)
        n = self.words.counts
        self.row = np.repeat(np.arange(len(n)), n)
        fits = np.maximum(n - window + 1, 0)
        self.start = np.repeat(self.words.off[:-1] - (np.cumsum(fits) - fits), fits) + np.arange(fits.sum())
        self.window = window
        self.tokens = hash_spans(self.words.buf, self.words.start, self.words.end)
        if len(self.start):
            kmers = rolling(self.tokens, anchor)
            low = np.uint64((1 << _POSITION) - 1)
            # ordered by hash and then by position; blocks have fewer than 2**24 words, larger documents wrap and only cost more
            tagged = (kmers & ~low) | (np.arange(len(kmers), dtype=np.uint64) & low)
            least = _sliding_min(tagged, window - anchor + 1)[self.start]
            place = (least & low).astype(np.int64)
            if len(kmers) > 1 << _POSITION:
                place += (self.start - place + (1 << _POSITION) - 1) >> _POSITION << _POSITION
            self.anchor_at, self.anchor_of = np.unique(place, return_inverse=True)
            self.anchors = kmers[self.anchor_at]
        else:
            self.anchor_at = self.anchor_of = np.zeros(0, np.int64)
            self.anchors = np.zeros(0, np.uint64)

    def edges(self) -> np.ndarray:
        """Hashes of all windows."""
        return rolling(self.tokens, self.window)[self.start] if len(self.start) else np.zeros(0, np.uint64)


def _keyed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct keys, place of each key in them, whether it came twice)."""
    distinct, place, n = np.unique(keys, return_inverse=True, return_counts=True)
    return distinct, place.ravel(), n > 1


def _repeated(keys: np.ndarray, twice: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    k = keys[order]
    head = np.concatenate([[True], k[1:] != k[:-1]])
    group = np.cumsum(head) - 1
    many = (np.bincount(group) > 1) | (np.bincount(group, weights=twice[order, 0]) > 0)
    out = np.zeros((len(keys), 1), np.uint8)
    out[order, 0] = many[group]
    return out


def _disagree(nodes: np.ndarray, sides: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by node, group of each in that order, whether a group's sides differ or some of it is known to differ)."""
    order = np.argsort(nodes, kind="stable")
    n, s = nodes[order], sides[order]
    head = np.concatenate([[True], n[1:] != n[:-1]]) if len(n) else np.zeros(0, bool)
    group = np.cumsum(head) - 1
    other = (s != s[head][group]) | known[order]
    return order, group, np.bincount(group, weights=other, minlength=int(head.sum())) > 0


def _any_differ(keys: np.ndarray, extra: np.ndarray) -> np.ndarray:
    sides = np.concatenate([extra[:, :_SIDES], np.zeros((len(extra), 8 - _SIDES), np.uint8)], axis=1).view(np.uint64).ravel()
    order, group, cut = _disagree(keys, sides, extra[:, _SIDES] > 0)
    out = np.zeros((len(keys), 1), np.uint8)
    out[order, 0] = cut[group]
    return out


#: Bytes of the hash of a node's two edges that are compared; what they miss, the pieces' digests tell.
_SIDES = 6


class Walks:
    """A block's walks of repeated windows: first word of each window, where walks begin, and their nodes."""

    def __init__(self, b: BlockWindows, hit: np.ndarray):
        self.first = b.start[hit]
        self.row = b.row[self.first]
        self.new = np.concatenate([[True], (np.diff(self.first) != 1) | (np.diff(self.row) != 0)]) if len(hit) else np.zeros(0, bool)
        ends = np.concatenate([self.new[1:], [True]]) if len(hit) else self.new
        at = np.sort(np.concatenate([self.first, self.first[ends] + 1]))
        edge = b.edges()[hit]
        k = np.searchsorted(self.first, at)
        here, before = np.minimum(k, max(0, len(edge) - 1)), np.maximum(k - 1, 0)
        none = np.uint64(0)
        after = np.where((k < len(edge)) & (self.first[here] == at), edge[here], none) if len(edge) else edge
        prior = np.where((k > 0) & (self.first[before] == at - 1), edge[before], none) if len(edge) else edge
        nodes = rolling(b.tokens, b.window - 1)[at] if len(edge) else edge
        sides = mix(mix(prior + np.uint64(0x632BE59BD9B4E019)) ^ after) & np.uint64((1 << 8 * _SIDES) - 1)
        order, group, self.differ = _disagree(nodes, sides, np.zeros(len(at), bool))
        head = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)
        self.nodes, self.sides = nodes[order][head], sides[order][head]
        place = np.empty(len(at), np.int64)
        place[order] = group
        self.place = place[np.searchsorted(at, self.first)]  # of the node where each window begins

    def pieces(self, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, first word, windows) of each piece; cut: of each of nodes."""
        heads = np.flatnonzero(self.new | (cut[self.place] > 0))
        return self.row[heads], self.first[heads], np.diff(np.concatenate([heads, [len(self.first)]]))


def walks(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, block_bytes: int = BLOCK_BYTES):
    """(written table of pieces, blocks, folder): (block, path, digest, words, tail, head, rows, firsts) for each piece in a block, with
    the rows and first words where it lies; path, tail and head are hashes of all its words, its first and its last window-1 words."""
    if anchor > window or window < 2:
        raise ValueError("a window has two words at least, and an anchor lies within a window")
    blocks, path, n_bytes = write_blocks(docs.select("doc_id", "text"), "substring", block_bytes)
    p = ranges(n_bytes, docs.sparkSession)

    def anchors(block, _):
        distinct, _, twice = _keyed(BlockWindows(read_block(path, block), window, anchor).anchors)
        yield messages(block, distinct, twice[:, None].astype(np.uint8), p)

    known = answers(each_block(blocks, anchors, MESSAGE), _repeated, 1, "anchors")

    def candidates(block, got):
        b = BlockWindows(read_block(path, block), window, anchor)
        _, place, _ = _keyed(b.anchors)
        hot = joined(got[0], 1)[:, 0].astype(bool)[place] if len(place) else np.zeros(0, bool)
        may = np.flatnonzero(hot[b.anchor_of]) if len(hot) else np.zeros(0, np.int64)
        return b, may, _keyed(b.edges()[may])

    def edges(block, got):
        _, _, (distinct, _, twice) = candidates(block, got)
        yield messages(block, distinct, twice[:, None].astype(np.uint8), p)

    seen = answers(each_block(blocks, edges, MESSAGE, known), _repeated, 1, "edges")

    def walked(block, got):
        b, may, (_, place, _) = candidates(block, got)
        return b, Walks(b, may[joined(got[1], 1)[:, 0].astype(bool)[place]] if len(may) else may)

    def nodes(block, got):
        _, w = walked(block, got)
        yield messages(block, w.nodes, planes(w.sides, w.differ.astype(np.uint8))[:, [*range(_SIDES), 8]], p)

    cuts = answers(each_block(blocks, nodes, MESSAGE, known, seen), _any_differ, _SIDES + 1, "nodes")

    def pieces(block, got):
        b, w = walked(block, got)
        if not len(w.first):
            return
        row, begin, n = w.pieces(joined(got[2], 1)[:, 0])
        n = n + window - 1
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(b.tokens) * _powers(len(b.tokens)), dtype=np.uint64)])
        inverse = _powers(len(b.tokens) + 1, True)
        of = lambda s, e: mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64)).view(np.int64)
        names = of(begin, begin + n)
        raw, words_of = b.text[0], b.words
        digest = [hashlib.sha256(b" ".join(raw[words_of.start[s] : words_of.end[e - 1]].tobytes().split())).digest()[:16] for s, e in zip(begin, begin + n, strict=True)]
        order = sorted(range(len(names)), key=lambda i: (names[i], digest[i], begin[i]))
        heads = [k for k, i in enumerate(order) if not k or (names[i], digest[i]) != (names[order[k - 1]], digest[order[k - 1]])]
        some = np.array([order[k] for k in heads])
        off = pa.array(np.array([*heads, len(order)], np.int32))
        lists = [pa.ListArray.from_arrays(off, pa.array(x[order].astype(np.int64))) for x in (row, begin - b.words.off[row])]
        begin, n = begin[some], n[some]
        yield pa.RecordBatch.from_arrays(
            [pa.array([block] * len(some)), pa.array(names[some]), pa.array([digest[i] for i in some], pa.binary()), pa.array(n), pa.array(of(begin, begin + window - 1)), pa.array(of(begin + n - window + 1, begin + n)), *lists],
            names=["block", "path", "digest", "words", "tail", "head", "rows", "firsts"],
        )

    found = each_block(blocks, pieces, "block string, path long, digest binary, words long, tail long, head long, rows array<long>, firsts array<long>", known, seen, cuts)
    return table(found, "pieces"), blocks, path


def _powers(n: int, inverse: bool = False) -> np.ndarray:
    base = 0xD1342543DE82EF95
    a = np.full(max(1, n), pow(base, -1, 2**64) if inverse else base, np.uint64)
    a[0] = 1
    return np.multiply.accumulate(a)[:n]


def verified(found: DataFrame) -> DataFrame:
    """(path, digest, words, tail, head, n) of each piece whose words two source coordinates hold at least, as a written table."""
    each = found.groupBy("path", "digest", "words").agg(F.min("tail").alias("tail"), F.min("head").alias("head"), F.sum(F.size("rows")).alias("n"))
    return table(each.where("n > 1"), "verified")


def compact(each: DataFrame) -> DataFrame:
    """(path, digest, words, n, unitig) for each piece (path, digest, words, tail, head, n); unitig names the compacted path it is part of.

    A piece leads to the one that starts where it ends, if no other piece ends or starts there.  Pointers jump by doubling until none
    moves; what goes round in a circle names its smallest piece.
    """
    starts = each.groupBy(F.col("tail").alias("node")).agg(F.count(F.lit(1)).alias("out"), F.min("path").alias("to"))
    stops = each.groupBy(F.col("head").alias("node")).agg(F.count(F.lit(1)).alias("in"), F.min("path").alias("of"))
    step = table(stops.where("`in` = 1").join(starts.where("out = 1"), "node").select(F.col("of").alias("path"), "to").where("path <> to"), "steps")
    n, rounds = step.count(), 0
    low = step.select("path", "to", F.least("path", "to").alias("least"))
    while n and 1 << rounds <= 2 * n:
        a, b = low.alias("a"), low.select(F.col("path").alias("at"), F.col("to").alias("then"), F.col("least").alias("their")).alias("b")
        after = a.join(b, F.col("a.to") == F.col("b.at"), "left")
        moved = after.select("path", F.coalesce("then", "to").alias("to"), F.least("least", F.coalesce("their", "least")).alias("least"), F.col("then").isNotNull().alias("on"))
        low = table(moved, "jumps")
        rounds += 1
        if not low.where("on").limit(1).count():
            break
        low = low.drop("on")
    # on a line the last path names it; in a circle, which has no last, the smallest one
    ends = low.select("path", "to", "least").join(step.select(F.col("path").alias("to"), F.lit(True).alias("circle")), "to", "left")
    named = ends.select("path", F.when(F.col("circle"), F.col("least")).otherwise(F.col("to")).alias("unitig"))
    return table(each.join(named, "path", "left").select("path", "digest", "words", "n", F.coalesce("unitig", "path").alias("unitig")), "unitigs")


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans) for each row of docs.

    Words are runs of non-space bytes, unchanged; a word goes if a window over it occurs elsewhere, in this document too.  Null texts
    have no words; rows that repeat are documents of their own, so both lose what they share.  Texts of any length are read whole; an
    empty table gives an empty result; other columns are not read.  spans: (first word, words, unitig) of the pieces that went.
    """
    found, blocks, path = walks(docs, window, anchor, block_bytes)
    unitigs = compact(verified(found)).select("path", "digest", "words", "unitig")
    # a piece is one row for each block that holds it; where it lies goes along, its words don't
    kept = found.join(unitigs, ["path", "digest", "words"]).select("block", F.struct("words", "unitig", "rows", "firsts").alias("piece"))
    n = tasks(blocks)
    packed = kept.repartition(n, "block").groupBy("block").agg(F.collect_list("piece").alias("pieces"))  # no more than a block's words
    todo = blocks.select("block").repartition(n, "block").join(packed, "block", "left")

    def run(batches):
        for b in batches:
            for block, pieces in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = read_block(path, block)
                buf, off = utf8(got.column("text"))
                w = words(buf, off)
                gone = np.zeros(len(w.start) + 1, np.int64)
                per: list[list] = [[] for _ in range(got.num_rows)]
                spans = [(row, first, x["words"], x["unitig"]) for x in pieces or () for row, first in zip(x["rows"], x["firsts"], strict=True)]
                for row, first, n, unitig in sorted(spans):
                    at = w.off[row] + first
                    gone[at] += 1
                    gone[at + n] -= 1
                    per[row].append({"first": first, "words": n, "unitig": unitig})
                stay = np.cumsum(gone[:-1]) == 0
                n_stay = np.add.reduceat(np.concatenate([stay, [False]]), np.minimum(w.off[:-1], len(stay))) * (w.counts > 0) if got.num_rows else np.zeros(0, int)
                shas = []
                raw = buf.tobytes()
                for i in range(got.num_rows):
                    a, e = w.off[i], w.off[i + 1]
                    text = raw[off[i] : off[i + 1]].split()
                    if n_stay[i] != e - a:
                        text = [text[j] for j in np.flatnonzero(stay[a:e])]
                    shas.append(hashlib.sha256(b" ".join(text)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [got.column("doc_id").combine_chunks(), pa.array(w.counts), pa.array(w.counts - n_stay), pa.array(shas, pa.string()), pa.array(per, pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("unitig", pa.int64())])))],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans"],
                )
                trim()

    kind = dict(docs.dtypes)["doc_id"]
    return todo.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, spans array<struct<first:bigint,words:bigint,unitig:bigint>>")
