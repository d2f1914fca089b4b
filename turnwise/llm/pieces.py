"""SentencePiece encoding and decoding of whole texts, by a table of each prefix's last token.

A model of the merge type joins the adjacent pair whose union is the best piece, leftmost first, until none is left.  So two tokens stand
beside each other in an encoding if and only if encoding the two by themselves leaves them as they are (an interfering merge would come
up there, too), and of the pieces that end at a place exactly one is compatible with the last token of what precedes it.  An automaton
gives the pieces that end at each place; the table keeps the one that passes; ids are recovered from the end backwards.  That takes a
time linear in the text, however long it runs without white space.

No piece has the blank's mark behind another character, so a text falls apart at its blanks into units that are encoded by themselves.  A
batch's distinct units are encoded once, and their tables filled together, all first places, then all second ones and so on.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small_batches
from .textbuf import utf8

#: What stands for a blank in pieces.
BLANK = "▁"
#: Units of more characters have tables of their own.  A worker remembers so many pairs of tokens, and so many units, at most; then it
#: starts anew.
UNIT_CHARS, PAIRS, UNITS = 64, 1 << 21, 1 << 20


class Pieces:
    """A model of the merge type with byte fallback, and its encoder.  Its pieces are normal ones, bytes, controls and the unknown one;
    each character of a piece is a piece."""

    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(lib.get_piece_size())
        if any(lib.is_unused(i) for i in ids):
            raise ValueError("unused pieces are not supported")
        special = {i for i in ids if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i)}
        self.id_of = {lib.id_to_piece(i): i for i in ids if i not in special}
        self.text_of = {i: p for p, i in self.id_of.items()}
        self.score = {p: lib.get_score(i) for p, i in self.id_of.items()}
        self.byte = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(not lib.is_byte(i) for i in self.byte) or any(c not in self.id_of for p in self.id_of for c in p) or any(BLANK in p.lstrip(BLANK) for p in self.id_of):
            raise ValueError("a model of the merge type with byte fallback is needed, in whose pieces every character is one and blanks come first")
        self.begin, self.end = lib.bos_id(), lib.eos_id()
        reached = {p: i for p, i in self.id_of.items() if len(self.merged(p)) == 1}  # others never come out of merging
        self.automaton = ahocorasick.Automaton()
        for p, i in reached.items():
            self.automaton.add_word(p, i << 16 | len(p))
        self.automaton.make_automaton()
        self._make_trie(reached)
        self.pairs: dict[int, bool] = {}
        self.known = np.zeros((2, 0), np.int64)  # the same as sorted keys and answers, as far as they were there at the last batch's end
        self.seen, self.seen_ids, self.seen_at = pa.array([], pa.large_string()), np.zeros(0, np.int32), np.zeros((2, 0), np.int64)
        width = max(lib.get_piece_size(), 1)
        surface = [b"" if i in special else p.replace(BLANK, " ").encode() for i, p in ((i, lib.id_to_piece(i)) for i in range(width))]
        for b, i in enumerate(self.byte):
            surface[i] = bytes([b])
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_at = np.concatenate([[0], np.cumsum([len(x) for x in surface])])

    def _make_trie(self, pieces: dict[str, int]) -> None:
        """The automaton's states without its back links, for walking from all places of many units at once: a state's next one by
        character, as sorted keys."""
        classes = {c: k for k, c in enumerate(sorted({c for p in pieces for c in p}))}
        self.class_of = np.full(0x110000, len(classes), np.int32)
        self.class_of[[ord(c) for c in classes]] = np.arange(len(classes))
        self.n_classes = len(classes) + 1
        step: dict[int, int] = {}
        token = [-1]
        for p, i in pieces.items():
            at = 0
            for c in p:
                key = at * self.n_classes + classes[c]
                if key not in step:
                    step[key] = len(token)
                    token.append(-1)
                at = step[key]
            token[at] = i
        self.step_keys, self.step_to = np.array(sorted(step.items()), np.int64).T.copy()
        self.token = np.array(token, np.int64)

    def matches(self, codes: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first place, length, token) of the pieces in a text's characters, longer ones first; none reaches its place's stop."""
        cls = self.class_of[codes].astype(np.int64)
        at, state, out, n = np.arange(len(codes)), np.zeros(len(codes), np.int64), [], 0
        while len(at):
            key = state * self.n_classes + cls[at + n]
            to = np.minimum(np.searchsorted(self.step_keys, key), len(self.step_keys) - 1)
            on = self.step_keys[to] == key
            at, state, n = at[on], self.step_to[to[on]], n + 1
            token = self.token[state]
            full = token >= 0
            out.append((at[full], np.full(int(full.sum()), n), token[full]))
            on = at + n < stop[at]
            at, state = at[on], state[on]
        first, length, token = (np.concatenate(x) for x in zip(*out[::-1], strict=True)) if out else (np.zeros(0, np.int64),) * 3
        return first, length, token

    def merged(self, text: str) -> list[str]:
        """The pieces that merging leaves of a text, by the definition: best score first, leftmost of equal ones."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' texts leaves the two tokens."""
        known = self.pairs.get(left << 32 | right)
        if known is None:
            a, b = self.text_of[left], self.text_of[right]
            known = self.pairs[left << 32 | right] = self.merged(a + b) == [a, b]
        return known

    def all_compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        keys, answers = self.known
        at = np.searchsorted(keys, key)
        new = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] != key) if len(keys) else np.arange(len(key))
        out = np.zeros(len(key), bool)
        if len(keys):
            out = answers[np.minimum(at, len(keys) - 1)] > 0
        if len(new):
            distinct, which = np.unique(key[new], return_inverse=True)
            out[new] = np.array([self.compatible(k >> 32, k & 0xFFFFFFFF) for k in distinct.tolist()], bool)[which]
        return out

    def remember(self) -> None:
        """Makes the pairs of a batch known to the next one."""
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        if len(self.pairs) != self.known.shape[1]:
            got = np.array([[*self.pairs], [*self.pairs.values()]], np.int64)
            self.known = got[:, np.argsort(got[0])]

    def unit(self, text: str) -> list[int]:
        """Ids of a unit, without begin and end, place by place."""
        last, length = [-1] * len(text), [1] * len(text)
        for end, found in self.automaton.iter(text):
            token, before = found >> 16, end - (found & 0xFFFF)
            if last[end] < 0 and (before < 0 or last[before] < 0 or self.compatible(last[before], token)):
                last[end], length[end] = token, end - before
        out, at = [], len(text) - 1
        while at >= 0:
            out.extend([last[at]] if last[at] >= 0 else [self.byte[b] for b in reversed(text[at].encode())])
            at -= length[at]
        return out[::-1]

    def units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units one after the other, their numbers)."""
        sizes = np.array([len(x) for x in texts], np.int64)
        start = np.concatenate([[0], np.cumsum(sizes)])
        joined = "".join(texts)
        last, length = np.full(len(joined), -1, np.int64), np.ones(len(joined), np.int64)
        begin, stop = np.repeat(start[:-1], sizes), np.repeat(start[1:], sizes)
        first, n, token = self.matches(np.frombuffer(joined.encode("utf-32-le"), np.uint32), stop)
        end = first + n - 1
        place = end - begin[end]
        order = np.lexsort((-n, end, place))  # place by place, a unit's longer pieces first
        cut = np.searchsorted(place[order], np.arange(place.max(initial=-1) + 2))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            m = order[a:b]
            while len(m):  # the longest that is left for each unit
                lead = np.concatenate([[True], end[m[1:]] != end[m[:-1]]])
                now, m = m[lead], m[~lead]
                left = np.where(first[now] > begin[end[now]], last[first[now] - 1], -1)
                fits = left < 0  # behind the unit's start or a character that is no piece
                fits[~fits] = self.all_compatible(left[~fits], token[now[~fits]])
                now = now[fits]
                last[end[now]], length[end[now]] = token[now], n[now]
                m = m[last[end[m]] < 0]
        taken = np.zeros(len(joined), bool)
        at, low = start[1:] - 1, start[:-1]
        while len(at):
            taken[at] = True
            at = at - length[at]
            more = at >= low
            at, low = at[more], low[more]
        where = np.flatnonzero(taken)
        ids, count = last[where], np.ones(len(where), np.int64)
        for i in np.flatnonzero(ids < 0).tolist():
            count[i] = len(joined[where[i]].encode())
        out = np.repeat(ids, count)
        if len(rest := np.flatnonzero(out < 0)):
            out[rest] = [self.byte[b] for i in np.flatnonzero(ids < 0).tolist() for b in joined[where[i]].encode()]
        upto = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(where, start)]
        return out, np.diff(upto)

    def unit_ids(self, distinct: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, numbers): the ids of distinct units and where each one's are; units of earlier batches are looked up."""
        if len(self.seen) > UNITS:
            self.seen, self.seen_ids, self.seen_at = self.seen[:0], self.seen_ids[:0], self.seen_at[:, :0]
        at = pc.index_in(distinct, value_set=self.seen).fill_null(-1).to_numpy()
        new = np.flatnonzero(at < 0)
        fresh = distinct.take(pa.array(new))
        texts = fresh.to_pylist()
        long = {i: self.unit(x) for i, x in enumerate(texts) if len(x) > UNIT_CHARS}
        ids, sizes = self.units(["" if i in long else x for i, x in enumerate(texts)])
        starts = len(self.seen_ids) + np.cumsum(sizes) - sizes
        flat = np.concatenate([self.seen_ids, ids.astype(np.int32), *(np.array(x, np.int32) for x in long.values())])
        after = len(self.seen_ids) + len(ids)
        for i, x in long.items():
            starts[i], sizes[i] = after, len(x)
            after += len(x)
        places = np.empty((2, len(distinct)), np.int64)
        places[:, at >= 0] = self.seen_at[:, at[at >= 0]]
        places[:, new] = starts, sizes
        short = np.setdiff1d(np.arange(len(texts)), list(long))
        self.seen = pa.concat_arrays([self.seen, fresh.take(pa.array(short))])
        self.seen_at = np.concatenate([self.seen_at, np.stack([starts, sizes])[:, short]], axis=1)
        self.seen_ids = flat[: len(self.seen_ids) + len(ids)]
        self.remember()
        return flat, *places

    def encode(self, column) -> pa.ListArray:
        """A list of ids for each text of a column, with begin and end; null counts as empty."""
        texts = self.library.normalize([x or "" for x in column.to_pylist()])
        units, first = split_units(pa.array(texts, pa.large_string()))
        coded = units.dictionary_encode()
        flat, starts, sizes = self.unit_ids(coded.dictionary)
        which = coded.indices.to_numpy()
        n = sizes[which]
        upto = np.concatenate([[0], np.cumsum(n)])
        body = flat[np.repeat(starts[which] - upto[:-1], n) + np.arange(upto[-1])] if len(which) else flat[:0]
        off = upto[first] + 2 * np.arange(len(texts) + 1)  # each text has two ids more than its units
        ids = np.empty(off[-1], np.int32)
        inner = np.ones(len(ids), bool)
        inner[off[:-1]] = inner[off[1:] - 1] = False
        ids[off[:-1]], ids[off[1:] - 1], ids[inner] = self.begin, self.end, body
        return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids))

    def decode(self, lists: pa.ListArray) -> pa.Array:
        """What lists of ids, which may be null or empty, decode to.  Where ids are not what encoding gives, such as bytes that are no
        characters, the library decodes."""
        ids, off = lists.flatten().to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy())]).astype(np.int64)
        if not len(ids) or (ids.min() >= 0 and ids.max() < len(self.surface_at) - 1 and not (ids == self.library.unk_id()).any()):
            n = np.diff(self.surface_at)[ids]
            upto = np.concatenate([[0], np.cumsum(n)])
            raw = self.surface[np.repeat(self.surface_at[ids] - upto[:-1], n) + np.arange(upto[-1])]
            cut = upto[off]
            keep = np.ones(len(raw), bool)
            opens = cut[:-1][cut[1:] > cut[:-1]]
            keep[opens[raw[opens] == 32]] = False  # the blank that normalising puts before a text
            cut = np.concatenate([[0], np.cumsum(keep)])[cut]
            out = pa.LargeStringArray.from_buffers(len(lists), pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw[keep])))
            try:
                out.validate(full=True)
                return out.cast(pa.string())
            except pa.ArrowInvalid:
                pass
        return pa.array([self.library.decode(x or []) for x in lists.to_pylist()], pa.string())


@functools.lru_cache(maxsize=1)
def loaded(model: bytes) -> Pieces:
    """A worker keeps its model, and what it remembers, from task to task."""
    return Pieces(model)


def split_units(texts: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """(units, first): a unit is a run of blanks and what follows up to the next; text i has those from first[i] to first[i + 1]."""
    buf, off = utf8(texts)
    mark = np.frombuffer(BLANK.encode(), np.uint8)
    opens = np.zeros(len(buf) + 1, bool)
    if len(buf) >= 3:
        opens[: len(buf) - 2] = (buf[:-2] == mark[0]) & (buf[1:-1] == mark[1]) & (buf[2:] == mark[2])
    start = opens.copy()
    start[3:] &= ~opens[:-3]
    start[off[:-1]] = True  # empty texts' places are cut off or belong to the next one
    start[len(buf)] = False
    at = np.flatnonzero(start)
    units = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(buf)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buf)))
    return units, np.searchsorted(at, off)


def _model(model: str | bytes) -> bytes:
    """A model file's content, half a megabyte or a few, which is sent with the tasks."""
    if isinstance(model, bytes):
        return model
    with open(model, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: str | bytes) -> DataFrame:
    """(doc_id, ids) of every row of docs (doc_id, text): all ids of the whole text, with begin and end.

    model: a model's content, or its file on the driver.  Null texts count as empty and have begin and end only; rows that repeat are
    each encoded; a null doc_id stays; other columns are not read; an empty table gives no rows.
    """
    return _mapped(docs, _model(model), decoded=False)


def round_trip(docs: DataFrame, model: str | bytes) -> DataFrame:
    """(doc_id, ids, packed, decoded): as :func:`encode`, with the ids as little-endian unsigned 32-bit integers and the text that they decode to."""
    return _mapped(docs, _model(model), decoded=True)


def _mapped(docs: DataFrame, model: bytes, decoded: bool) -> DataFrame:
    small_batches(docs.sparkSession)
    names = ["doc_id", "ids", "packed", "decoded"] if decoded else ["doc_id", "ids"]

    def run(batches):
        pieces = loaded(model)
        for b in batches:
            ids = pieces.encode(b.column(1))
            cols = [b.column(0), ids]
            if decoded:
                flat, off = ids.values.to_numpy().astype("<u4"), ids.offsets.to_numpy()
                cols += [pa.array([flat[s:e].tobytes() for s, e in zip(off[:-1], off[1:], strict=True)], pa.binary()), pieces.decode(ids)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>" + (", packed binary, decoded string" if decoded else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(rows: DataFrame, model: str | bytes, ids: str = "ids") -> DataFrame:
    """rows with a column text: what their ids, an array that may be null or empty, decode to by the model's own rules."""
    body, names = _model(model), rows.columns

    def run(batches):
        pieces = loaded(body)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pieces.decode(b.column(names.index(ids)))], names=[*names, "text"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(run, f"{kinds}, text string")


def digests(trip: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of :func:`round_trip`."""
    hashed = lambda c: F.sha2(c, 256)
    text: Column = F.encode("decoded", "UTF-8")
    return trip.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), hashed(F.col("packed")).alias("ids_sha256"), hashed(text).alias("decoded_sha256"))
