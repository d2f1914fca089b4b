"""Secret scans through a trigram index.

Each rule's regex is turned into a Boolean query over trigrams that every match must hold.  For each block of texts an inverted
index of the queries' trigrams is built (postings: sorted row numbers), postings are intersected and united as the query says, and
only the candidates are verified with the regex.  A rule whose regex has no mandatory trigram scans every text.  A block's index
lives in its task, so a scan is one pass without a shuffle; :func:`build_index` and :func:`candidates` give the same postings as tables,
for searching an unchanged corpus again with other rules.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from re import _constants as rc
from re import _parser as rp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbuf import LOWER, chunks, utf8


@dataclass(frozen=True)
class Rule:
    """pattern is matched as ASCII; a match counts if its group has least code points at the minimum."""

    kind: str
    pattern: str
    ignore_case: bool = False
    group: int = 0
    least: int = 0
    scan: str = ""  # another pattern with the same matches of at least that length, if one is faster

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


#: The three rules of the base, in the order in which they are listed.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", False, 0, 20),
    Rule("hex", r"[0-9a-f]+", False, 0, 24, r"[0-9a-f]{24,}"),
)
#: Further rules: well-known public token formats.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("url", r"[a-z][a-z0-9+.-]{1,20}://[^\x00-\x20/:@]*+:[^\x00-\x20/:@]{3,}+@[A-Za-z0-9.-]+"),
)
RULES = BASE + MORE

# Boolean queries: ("all", q...), ("any", q...), or a trigram of folded bytes; ("all",) holds for every text.
EVERY = ("all",)
_MOST = 24


def _all(*qs):
    parts: list = []
    for q in qs:
        parts += q[1:] if isinstance(q, tuple) and q[0] == "all" else [q]
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else ("all", *parts)


def _any(*qs):
    if any(q == EVERY for q in qs):
        return EVERY
    parts = list(dict.fromkeys(qs))
    terms = [set(q[1:]) if isinstance(q, tuple) and q[0] == "all" else {q} for q in parts]
    parts = [q for q, t in zip(parts, terms, strict=True) if not any(u < t for u in terms)]  # a or (a and b) is a
    return parts[0] if len(parts) == 1 else ("any", *parts)


def _of_strings(strings) -> object:
    return _any(*[_all(*[s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _fold(s: str) -> bytes:
    return bytes(LOWER[np.frombuffer(s.encode(), np.uint8)])


def _few(members) -> list[int]:
    """The characters of a class of at most eight, else nothing."""
    if any(o is rc.NEGATE or o is rc.CATEGORY for o, _ in members):
        return []
    chars = [c for o, a in members for c in (range(a[0], min(a[1], a[0] + 9) + 1) if o is rc.RANGE else [a])]
    return chars if len(chars) <= 8 else []


def _walk(nodes) -> tuple[set[bytes] | None, object]:
    """(all folded strings that the nodes match, if they are few, else None; a query that holds wherever the nodes match)."""
    tail, whole, query = {b""}, True, EVERY
    for op, arg in nodes:
        got: set[bytes] | None = None
        need: object = EVERY
        if op is rc.LITERAL:
            got = {_fold(chr(arg))}
        elif op is rc.IN:
            got = {_fold(chr(c)) for c in _few(arg)} or None
        elif op is rc.AT:
            got = {b""}
        elif op is rc.SUBPATTERN:
            got, need = _walk(arg[3])
        elif op is rc.BRANCH:
            sides = [_walk(x) for x in arg[1]]
            if all(e is not None for e, _ in sides):
                got = set().union(*[e for e, _ in sides])
            need = _any(*[q if e is None else _of_strings(e) for e, q in sides])
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT, rc.POSSESSIVE_REPEAT):
            low, high, inner = arg
            e, q = _walk(inner)
            if e is not None and high == 1:
                got = e | {b""} if low == 0 else e
            elif e is not None and low == high and len(e) == 1 and low <= 32:
                got = {next(iter(e)) * low}
            if low:
                need = q if e is None else _of_strings(e)
        if got is not None and len(got) <= _MOST:
            if len(tail) * len(got) > _MOST:
                query, whole, tail = _all(query, _of_strings(tail)), False, {b""}
            tail = {a + b for a in tail for b in got}
        else:  # the strings on its two sides are apart
            query, whole, tail = _all(query, _of_strings(tail), need), False, {b""}
    return (tail, EVERY) if whole else (None, _all(query, _of_strings(tail)))


def trigram_query(rule: Rule):
    """The Boolean query of a rule over case-folded trigrams; EVERY if none is mandatory."""
    exact, query = _walk(rp.parse(rule.pattern))
    return query if exact is None else _of_strings(exact)


def trigrams(query) -> set[bytes]:
    return {query} if isinstance(query, bytes) else set().union(*[trigrams(q) for q in query[1:]])


class BlockIndex:
    """Postings of the wanted trigrams in a block of texts, given as bytes with A-Z folded and row offsets."""

    def __init__(self, folded: np.ndarray, off: np.ndarray, wanted: list[bytes], lut: np.ndarray):
        self.rows = len(off) - 1
        wide = folded.astype(np.uint32)
        hits = np.flatnonzero(lut[(wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]]) if len(folded) > 2 else np.zeros(0, np.int64)
        row = np.searchsorted(off, hits, "right") - 1
        inside = hits + 3 <= off[row + 1]
        hits, row = hits[inside], row[inside]
        which = lut[(wide[hits] << 16) | (wide[hits + 1] << 8) | wide[hits + 2]].astype(np.int64) if len(hits) else hits
        seen = np.zeros(len(wanted) * self.rows, bool)
        seen[(which - 1) * self.rows + row] = True
        self.postings = {t: np.flatnonzero(seen[i * self.rows : (i + 1) * self.rows]) for i, t in enumerate(wanted)}

    def find(self, query) -> np.ndarray:
        if isinstance(query, bytes):
            return self.postings[query]
        if query == EVERY:
            return np.arange(self.rows)
        parts = [self.find(q) for q in query[1:]]
        if query[0] == "any":
            return np.unique(np.concatenate(parts))
        out = parts[0]
        for x in sorted(parts[1:], key=len):
            out = np.intersect1d(out, x, assume_unique=True)
        return out


def lookup_table(wanted: list[bytes]) -> np.ndarray:
    """For each 24-bit trigram its place in wanted, from 1, else 0."""
    lut = np.zeros(1 << 24, np.uint8 if len(wanted) < 256 else np.uint16)
    for i, t in enumerate(wanted):
        lut[t[0] << 16 | t[1] << 8 | t[2]] = i + 1
    return lut


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE, block_bytes: int = 4 << 20) -> DataFrame:
    """A row for each row of docs: doc_id, n_<kind> of the base rules, base_sha256, spans, and texts (the matched strings).

    Spans are kind:start:end in code points, end exclusive, by start and then in the order of the rules.  Null texts count as empty;
    rows that repeat are each reported; other columns are not read; an empty table gives an empty result.  Texts are scanned whole.
    """
    queries = [trigram_query(r) for r in rules]
    wanted = sorted(set().union(*[trigrams(q) for q in queries]))
    n_base = len(base)
    if rules[:n_base] != base:
        raise ValueError("the base rules come first")

    def run(batches):
        lut = lookup_table(wanted)
        compiled = [re.compile(r.scan or r.pattern, r.compiled().flags) for r in rules]
        for b in batches:
            buf, off = utf8(b.column(1))
            found: list[list[tuple[int, int, int, str]]] = [[] for _ in range(b.num_rows)]
            for r0, r1 in chunks(off, block_bytes):
                base_off = off[r0]
                index = BlockIndex(LOWER[buf[base_off : off[r1]]], off[r0 : r1 + 1] - base_off, wanted, lut)
                texts: dict[int, str] = {}
                for k, (rule, q) in enumerate(zip(rules, queries, strict=True)):
                    for i in index.find(q).tolist():
                        text = texts.get(i)
                        if text is None:
                            text = texts[i] = buf[off[r0 + i] : off[r0 + i + 1]].tobytes().decode()
                        for m in compiled[k].finditer(text):
                            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                                found[r0 + i].append((m.start(), k, m.end(), m.group()))
            said = [[f"{rules[k].kind}:{s}:{e}" for s, k, e, _ in x if k < n_base] for x in map(sorted, found)]
            cols = [b.column(0)]
            cols += [pa.array([sum(y[1] == k for y in x) for x in found], pa.int64()) for k in range(n_base)]
            cols.append(pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in said], pa.string()))
            cols.append(pa.array([",".join(f"{rules[k].kind}:{s}:{e}" for s, k, e, _ in sorted(x)) for x in found], pa.string()))
            cols.append(pa.array([[y[3] for y in sorted(x)] for x in found], pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    names = ["doc_id", *[f"n_{r.kind}" for r in base], "base_sha256", "spans", "texts"]
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, " + ", ".join(f"n_{r.kind} long" for r in base) + ", base_sha256 string, spans string, texts array<string>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def build_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES, block_bytes: int = 4 << 20) -> DataFrame:
    """(trigram, doc_ids): postings for each block of texts; rows without doc_id aren't indexed."""
    wanted = sorted(set().union(*[trigrams(trigram_query(r)) for r in rules]))

    def run(batches):
        lut = lookup_table(wanted)
        for b in batches:
            buf, off = utf8(b.column(1))
            for r0, r1 in chunks(off, block_bytes):
                index = BlockIndex(LOWER[buf[off[r0] : off[r1]]], off[r0 : r1 + 1] - off[r0], wanted, lut)
                ids = b.column(0).slice(r0, r1 - r0)
                full = [(t, p) for t, p in index.postings.items() if len(p)]
                yield pa.RecordBatch.from_arrays([pa.array([t.decode("latin-1") for t, _ in full], pa.string()), pa.array([ids.take(pa.array(p)).to_pylist() for _, p in full], pa.list_(ids.type))], names=["trigram", "doc_ids"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(run, f"trigram string, doc_ids array<{kind}>")


def candidates(index: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id) of the texts that a rule's query leaves, from the postings of :func:`build_index`; None if it must scan every text."""
    query = trigram_query(rule)
    if query == EVERY:
        return None
    flat = index.where(F.col("trigram").isin(sorted(t.decode("latin-1") for t in trigrams(query)))).select(F.explode("doc_ids").alias("doc_id"), "trigram")
    sets = flat.groupBy("doc_id").agg(F.collect_set("trigram").alias("has"))  # bounded by the query's trigrams

    def holds(q):
        if isinstance(q, bytes):
            return F.array_contains("has", q.decode("latin-1"))
        parts = [holds(x) for x in q[1:]]
        out = parts[0]
        for x in parts[1:]:
            out = (out & x) if q[0] == "all" else (out | x)
        return out

    return sets.where(holds(query)).select("doc_id")
