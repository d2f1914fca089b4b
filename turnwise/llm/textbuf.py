"""Words and hashes of whole Arrow text columns, by numpy over the column's bytes."""

from __future__ import annotations

import ctypes
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BYTES = np.arange(256, dtype=np.uint8)
#: Bytes that are not white space (space and 0x09-0x0D).
NOT_SPACE = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))
#: Bytes of a lower-cased alphanumeric word: digits, a-z and whatever is not ASCII.
ALNUM = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
#: A-Z to a-z.
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)

_rng = np.random.RandomState(20240229)
_TABLE = _rng.randint(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_SLICE = 1 << 15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, _SLICE)
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[i] = np.multiply.accumulate(a)
    return _powers[0], _powers[1]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the offsets of its rows in them."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


@dataclass
class Words:
    """buf: the bytes; start, end: of each word; off: of each row's words."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    off: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.off)


def words(buf: np.ndarray, off: np.ndarray, member: np.ndarray = NOT_SPACE) -> Words:
    """Maximal runs of member bytes within each row."""
    inside = member[buf]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[off[:-1][off[:-1] < len(buf)]] = False
    if len(inside):
        before[0] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    last = off[1:] - 1
    after[last[last >= 0]] = False
    end = np.flatnonzero(inside & ~after) + 1
    return Words(buf, start, end, np.searchsorted(start, off).astype(np.int64))


def hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, given in ascending order of start and end."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + _SLICE - 2, "right")))
        base = start[at]
        seg = buf[base : end[to - 1]]
        power, inverse = _power(len(seg) + 1)
        total = np.zeros(len(seg) + 1, np.uint64)
        np.cumsum(_TABLE[seg] * power[: len(seg)], out=total[1:])
        s, e = start[at:to] - base, end[at:to] - base
        out[at:to] = (total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64)
        at = to
    return mix(out)


def rolling(tokens: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive tokens, whichever rows they belong to."""
    n = len(tokens) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    parts, done, width = np.zeros(n, np.uint64), 0, 1
    power = {1: tokens}
    while width * 2 <= k:  # a run of 2w tokens is a run of w and the next one
        a = power[width]
        power[width * 2] = mix(a[: len(a) - width] * np.uint64(_BASE) + a[width:])
        width *= 2
    for w in sorted(power, reverse=True):
        if k & w:
            parts = mix(parts * np.uint64(_BASE_INVERSE) + power[w][done : done + n])
            done += w
    return parts


def trim() -> None:
    """Give freed memory back: workers live on between tasks, beside the others of their executor."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def chunks(off: np.ndarray, most: int):
    """Row ranges of at most that many units each, or of one row."""
    at, n = 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield at, to
        at = to


# XXH64 over many short spans at once.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each span of buf; spans of 32 bytes or more go through the xxhash library one by one."""
    import xxhash

    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    u8 = np.lib.stride_tricks.as_strided(padded.view(np.uint8)[:8].view("<u8"), (len(buf) + 1,), (1,))
    u4 = np.lib.stride_tricks.as_strided(padded.view(np.uint8)[:4].view("<u4"), (len(buf) + 1,), (1,))
    size = end - start
    h = np.uint64(seed) + _P5 + size.astype(np.uint64)
    pos, left = start.copy(), size.copy()
    long = size >= 32
    left[long] = 0
    for _ in range(3):
        at = np.flatnonzero(left >= 8)
        k = _rotl(u8[pos[at]] * _P2, 31) * _P1
        h[at] = _rotl(h[at] ^ k, 27) * _P1 + _P4
        pos[at] += 8
        left[at] -= 8
    at = np.flatnonzero(left >= 4)
    h[at] = _rotl(h[at] ^ (u4[pos[at]].astype(np.uint64) * _P1), 23) * _P2 + _P3
    pos[at] += 4
    left[at] -= 4
    for _ in range(3):
        at = np.flatnonzero(left >= 1)
        h[at] = _rotl(h[at] ^ (padded[pos[at]].astype(np.uint64) * _P5), 11) * _P1
        pos[at] += 1
        left[at] -= 1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    h ^= h >> np.uint64(32)
    whole = buf.tobytes() if long.any() else b""
    for i in np.flatnonzero(long):
        h[i] = xxhash.xxh64_intdigest(whole[start[i] : end[i]], seed)
    return h
