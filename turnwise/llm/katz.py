"""Katz backoff language model: Good-Turing discounted n-grams with exactly normalised backoff weights.

Level 1 gives every word d(r) r / N and leaves what discounting frees to one unknown word.  At level j a context h gives a word
that followed it r times d(r) r / c(h), and any other word alpha(h) times what level j-1 gives it, where

    alpha(h) = (1 - sum of d(r) r / c(h) over the words that followed h) / (1 - sum of their level j-1 probabilities)

so every context's probabilities sum to 1 over the vocabulary and the unknown word.  A context that discounting leaves nothing
(all its words are frequent) keeps 1 / (c(h) + 1) aside instead.

Counts cover all training texts.  Blocks of documents send their distinct n-grams, with their own counts and the total count r' one
level below, to the range that holds the context; ranges answer with total counts and, for each context, what alpha needs.  What
followed h also followed h without its first word, with the same c below for all, so the sum in alpha is that of d(r') r' over that
c; ranges add up the first, blocks know the second.  The answers are tables partitioned by range, and each block evaluates the
recursion for all its tokens from them.  A context that has
more than a range's share of tokens is cut into parts by its n-grams' hashes; a part is dealt like a context of its own, and the
parts' sums are added up afterwards.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import MESSAGE, column, each_block, messages, planes, ranges, read_block, replied, squeeze, unsqueeze, write_blocks
from .textbuf import LOWER, hash_spans, mix, utf8, words

ORDER, TOP = 3, 5
FOLDS, HELD_OUT = 7, 2
#: Contexts that occur more often than once in TOKEN_BYTES bytes of a share of the corpus are cut into parts.  A share is a key range's, but
#: not more than one in LEAST_SHARES nor less than one in MOST_SHARES, which bounds the list of them that is sent: 12 bytes each.
TOKEN_BYTES, LEAST_SHARES, MOST_SHARES = 8, 200, 1 << 20
BLOCK_BYTES = 10 << 20
_END, _BEGIN = np.uint64(0xE0D0_0000_0000_0001), np.uint64(0xB0E0_0000_0000_0003)


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int")


def discounts(counts: list[int], top: int = TOP) -> np.ndarray:
    """d(0..top) from the numbers of n-grams that occur 1, 2, ... top+1 times; where Good-Turing gives none in (0, 1], 1 - 1/(2r)."""
    d = np.ones(top + 1)
    n = [0, *counts]
    a = (top + 1) * n[top + 1] / n[1] if n[1] else 1.0
    for r in range(1, top + 1):
        x = ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) if n[r] and a < 1 else -1
        d[r] = x if 0 < x <= 1 else 1 - 0.5 / r
    return d


class Level:
    """What all blocks must know of one level: its discounts, and hot: rows of sums (c, n(1..top), sum of d(r') r') of hot contexts from 1.

    next_hot, next_parts: n-grams that are hot contexts of the next level, ascending, and into how many parts each is cut.
    """

    def __init__(self, stats: list[int], hot: np.ndarray, total: int = 0, vocabulary: int = 0):
        self.d = discounts(stats)
        self.stats, self.hot, self.total, self.vocabulary = stats, hot, total, vocabulary
        self.next_hot, self.next_parts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if total:
            freed = sum((1 - self.d[r]) * r * stats[r - 1] for r in range(1, TOP + 1)) / total
            self.unknown = freed or 1 / (total + 1)
            self.scale = 1 / total if freed else 1 / (total + 1)
            if not freed:
                self.d = np.ones(TOP + 1)
        else:
            self.unknown, self.scale = 1.0, 0.0

    def word(self, c: np.ndarray) -> np.ndarray:
        """Level 1's probability of words that occur c times."""
        return np.where(c > 0, self.discounted(c) * self.scale, self.unknown)

    def discounted(self, r: np.ndarray) -> np.ndarray:
        return self.d[np.where(r <= TOP, r, 0).astype(np.int64)] * r


class BlockTokens:
    """A block's tokens: words, then one end, for each document; seq has their hashes."""

    def __init__(self, got: pa.Table):
        buf, off = utf8(got.column("text"))
        w = words(LOWER[buf], off)
        self.n_words = w.counts
        rows = len(self.n_words)
        self.doc = np.repeat(np.arange(rows), self.n_words + 1)
        self.last = np.cumsum(self.n_words + 1) - 1
        self.seq = np.full(len(self.doc), _END, np.uint64)
        is_word = np.ones(len(self.doc), bool)
        is_word[self.last] = False
        self.seq[is_word] = hash_spans(w.buf, w.start, w.end)
        self.train = np.asarray(got.column("train").to_numpy(), bool)[self.doc]


def word_gram(number: np.ndarray) -> np.ndarray:
    return mix(number + np.uint64(1))


def extended(mixed_context: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Hash of a context, given by its mixed hash, and the word of a number after it."""
    return mix(mixed_context + (number + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def stable_order(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stable order, sorted) of 64-bit numbers.

    Places stand in the last bits of what is sorted, as sorting numbers is several times faster than sorting places by them; runs that the
    bits before those leave out of order are sorted again.
    """
    mask = np.uint64((1 << max(1, (len(g) - 1).bit_length())) - 1)
    s = np.sort((g & ~mask) | np.arange(len(g), dtype=np.uint64))
    order = (s & mask).astype(np.int64)
    got = g[order]
    near = (s[1:] & ~mask) == (s[:-1] & ~mask)
    down = near & (got[1:] < got[:-1])
    if down.any():
        run = np.concatenate([[0], np.cumsum(~near)])
        mixed = np.zeros(int(run[-1]) + 1, bool)
        mixed[run[1:][down]] = True
        at = np.flatnonzero(mixed[run])
        order[at] = order[at][np.argsort(got[at], kind="stable")]
        got = g[order]
    return order, got


def _heads(s: np.ndarray) -> np.ndarray:
    """Whether a number differs from the one before it."""
    return np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)


def _distinct(g: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct, first place, place of each, sum of n)."""
    order, s = stable_order(g)
    head = _heads(s)
    of = np.empty(len(g), np.int64)
    of[order] = np.cumsum(head) - 1
    at = np.flatnonzero(head)
    return s[at], order[at], of, np.add.reduceat(n[order].astype(np.int64), at) if len(at) else np.zeros(0, np.int64)


def _pairs(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> np.ndarray:
    """One number of each pair of numbers below n_a and n_b, which sort like the pairs; their free bits come last."""
    high, low = max(1, n_a.bit_length()), max(1, n_b.bit_length())
    if high + low > 64:
        raise ValueError("a block or a range has too many n-grams")
    return ((a.astype(np.uint64) << np.uint64(low)) | b.astype(np.uint64)) << np.uint64(64 - high - low)


def _sums(group: np.ndarray, n: int, r: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """For each group c, n(1..TOP) and the lower level's sum, over n-grams that were seen."""
    out = np.zeros((n, TOP + 2))
    seen = r > 0
    out[:, 0] = np.bincount(group[seen], weights=r[seen], minlength=n)
    for k in range(1, TOP + 1):
        out[:, k] = np.bincount(group[r == k], minlength=n)
    out[:, TOP + 1] = np.bincount(group[seen], weights=lower[seen], minlength=n)
    return out


def _heavy(total: np.ndarray, least: int) -> np.ndarray:
    return np.flatnonzero(total > least)


def _count_words(keys, extras, p, least: int, n_ranges: int):
    """Level 1, of range p: total counts, and numbers, the smaller the more frequent and of no two words alike.  Stats are N, V and the
    numbers of words that occur 1..TOP+1 times; heavy: what occurs more than least times."""
    sizes = [len(k) for k in keys]
    k, n = np.concatenate(keys), np.concatenate([column(unsqueeze(x, 8), 0, np.int64) for x in extras])
    distinct, of = np.unique(k, return_inverse=True)
    of = of.ravel()
    total = np.bincount(of, weights=n).astype(np.int64)
    stats = [int(total.sum()), int((total > 0).sum()), *[int((total == r).sum()) for r in range(1, TOP + 2)]]
    rank = np.empty(len(distinct), np.uint64)
    rank[np.argsort(-total, kind="stable")] = np.arange(len(distinct), dtype=np.uint64)
    number = rank * np.uint64(n_ranges) + np.uint64(p)
    grams = word_gram(number).view(np.int64)
    heavy = [{"key": int(grams[i]), "numbers": [float(total[i])]} for i in _heavy(total, least)]
    at = np.cumsum(sizes)[:-1]
    return [squeeze(planes(x, y)) for x, y in zip(np.split(total[of], at), np.split(number[of], at), strict=True)], stats, heavy


_WIDTH, _BACKS_OFF = 8 + 4 + 8 + 4, 7


def part_keys(context: np.ndarray, gram: np.ndarray, hot: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """What an n-gram is dealt by, evenly over all 64 bits: its context, or the part of its context where that is hot (a number from 1)."""
    many = parts[np.maximum(hot, 1) - 1].astype(np.uint64) if len(parts) else np.ones(len(hot), np.uint64)
    part = mix(gram) % many + np.uint64(1)
    return mix(np.where(hot > 0, mix(context ^ (part * np.uint64(0x9E3779B97F4A7C15))), context))


def _count_grams(keys, extras, p, least: int, hot_contexts: np.ndarray, below: Level, last: bool = False):
    """Level 2 and above.  A row: the last word's number, the n-gram's count, its total count one level below, and the hot context's number
    or 0.  Answers are the n-grams' total counts and, apart, of each context which of n(1..TOP) there are; the numbers themselves and the
    sum only where the message holds an n-gram of it that training lacks, as nothing else backs off.  How often a context occurs, blocks
    know from the level below.

    Heavy rows: (n-gram, [-1, total]), unless this is the last level, and (hot context's number, sums of its part here).
    """
    sizes = [len(k) for k in keys]
    ends = np.cumsum(sizes)
    key = np.concatenate(keys)
    rows = np.concatenate([unsqueeze(x, _WIDTH) for x in extras])
    number, n, hot = column(rows, 0, np.uint64), column(rows, 8, np.uint32), column(rows, 20, np.uint32).astype(np.int64)
    lower = below.discounted(column(rows, 12, np.int64))
    del rows
    head = _heads(key)  # of a context's n-grams in a message, which stand together
    head[ends[:-1]] = True
    heads = np.flatnonzero(head)
    contexts, one, of_head, _ = _distinct(key[heads], np.ones(len(heads), np.int64))
    hot_context = hot[heads[one]]
    context = of_head[np.cumsum(head) - 1]
    _, first, of, total = _distinct(_pairs(context, number, len(contexts), int(number.max())), n)
    r = total[of]
    stats = [int(total.sum()), int((total > 0).sum()), *[int((total == x).sum()) for x in range(1, TOP + 2)]]
    heavy = []
    if not last:  # a key is the context mixed, or for a hot one that of a part
        at = _heavy(total, least)
        most, mixed = first[at], contexts[context[first[at]]]
        if len(hot_contexts):
            mixed = np.where(hot[most] > 0, mix(hot_contexts[np.maximum(hot[most], 1) - 1]), mixed)
        heavy = [{"key": int(g), "numbers": [-1.0, float(x)]} for g, x in zip(extended(mixed, number[most]).view(np.int64), total[at], strict=True)]
    sums = _sums(context[first], len(contexts), total, lower[first])
    warm = np.flatnonzero(hot_context > 0)
    numbers, group = np.unique(hot_context[warm], return_inverse=True)
    of_hot = np.zeros((len(numbers), TOP + 2))
    np.add.at(of_hot, group.ravel(), sums[warm])
    heavy += [{"key": int(x), "numbers": y.tolist()} for x, y in zip(numbers, of_hot, strict=True) if y[0]]
    lacks = np.logical_or.reduceat(r == 0, heads)
    bits = ((sums[:, 1:-1] > 0) << np.arange(TOP)).sum(1).astype(np.uint8)[of_head] | (lacks << _BACKS_OFF).astype(np.uint8)
    cuts = np.searchsorted(heads, [0, *ends])
    out = []
    for to, size, h0, h1 in zip(ends, sizes, cuts[:-1], cuts[1:], strict=True):
        mine = h0 + np.flatnonzero(hot_context[of_head[h0:h1]] == 0)
        full = sums[of_head[mine[lacks[mine]]]]
        some = squeeze(bits[mine][:, None])
        out.append((squeeze(planes(r[to - size : to])), len(some).to_bytes(8, "little") + some + squeeze(planes(full[:, 1:-1].astype(np.uint64), full[:, -1]))))
    return out, stats, heavy


_RANK = np.uint64((1 << 20) - 1)


def by_key(key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """An order in which equal keys stand together, by ascending n, which compresses well; keys ascend but for their last 20 bits.

    One sort serves unless keys differ in those bits alone.
    """
    order, _ = stable_order((key & ~_RANK) | np.minimum(n, int(_RANK)).astype(np.uint64))
    k = key[order]
    if ((k[1:] != k[:-1]) & ((k[1:] | _RANK) == (k[:-1] | _RANK))).any():
        return np.lexsort((n, key))
    return order


class Scorer:
    """Evaluates the recursion for a block, level by level, from the answers so far.

    What is known of the level reached is known of its distinct n-grams: of: each token's n-gram; gram: their hashes; r: their total
    counts; scale: what one occurrence weighs in its context; prob: their probabilities.  A token's n-gram of the next level is its
    predecessor's n-gram here with its own, so two small numbers tell it.
    """

    def __init__(self, tokens: BlockTokens, levels: list[Level]):
        self.t, self.levels = tokens, levels
        self.begins = tokens.last - tokens.n_words
        self.begin = word_gram(np.array([_BEGIN]))  # what stands before a text: as many beginnings as the n-grams are long

    def first(self, answer: list[tuple[int, bytes]]) -> None:
        level = self.levels[0]
        _, _, self.of, _ = _distinct(self.t.seq, self.t.train)
        rows = np.concatenate([unsqueeze(x, 16) for _, x in sorted(answer)])
        self.r, number = column(rows, 0, np.int64), column(rows, 8, np.uint64)
        self.number, self.gram = number[self.of], word_gram(number)
        self.prob, self.scale = level.word(self.r), np.full(len(self.r), level.scale)
        self.texts = self.r[self.of[self.t.last[:1]]]  # each text ends once

    def rows(self, j: int):
        """Level j's distinct n-grams in the order in which they are sent: (keys, extra bytes, row of each token's, hot numbers, their
        contexts and what they are without their first words, as numbers of level j-1's n-grams, hashes)."""
        m = len(self.r)
        before = np.concatenate([[m], self.of[:-1]])
        before[self.begins] = m
        contexts = np.concatenate([self.gram, self.begin])
        hot_keys = self.levels[j - 2].next_hot
        place = np.minimum(np.searchsorted(hot_keys, contexts), max(0, len(hot_keys) - 1))
        hot_context = np.where(hot_keys[place] == contexts, place + 1, 0) if len(hot_keys) else np.zeros(m + 1, np.int64)
        mixed = mix(contexts)
        rank, by_count = np.empty(m + 1, np.uint64), np.empty(m, np.uint64)
        rank[stable_order(mixed)[0]] = np.arange(m + 1, dtype=np.uint64)
        by_count[stable_order(self.r.astype(np.uint64) << np.uint64(24))[0]] = np.arange(m, dtype=np.uint64)
        _, at, of, n = _distinct(_pairs(rank[before], by_count[self.of], m, m), self.t.train)
        context, rest, number = before[at], self.of[at], self.number[at]
        hot, key = hot_context[context], mixed[context]
        gram = extended(key, number)
        warm = np.flatnonzero(hot > 0)
        if len(warm):  # the others are in order: those of hot contexts go between them
            key[warm] = part_keys(contexts[context[warm]], gram[warm], hot[warm], self.levels[j - 2].next_parts)
            warm = warm[by_key(key[warm], self.r[rest[warm]])]
            cold = np.flatnonzero(hot == 0)
            to = np.maximum.accumulate(np.searchsorted(key[cold], key[warm])) + np.arange(len(warm))
            is_cold = np.ones(len(key), bool)
            is_cold[to] = False
            order = np.empty(len(key), np.int64)
            order[to], order[is_cold] = warm, cold
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            of = back[of]
            n, context, rest, number, hot, key, gram = (x[order] for x in (n, context, rest, number, hot, key, gram))
        return key, lambda: planes(number, n.astype(np.uint32), self.r[rest], hot.astype(np.uint32)), of, hot, context, rest, gram

    def _reach(self, r: np.ndarray, of: np.ndarray, gram: np.ndarray) -> None:
        self.r, self.of, self.gram = r, of, gram
        self.begin = extended(mix(self.begin), np.array([_BEGIN]))

    def counts(self, j: int, answer: list[tuple[int, bytes]]) -> None:
        """Go on to level j's counts alone."""
        _, _, of, _, _, _, gram = self.rows(j)
        self._reach(self._counts(answer), of, gram)

    @staticmethod
    def _counts(answer: list[tuple[int, bytes]]) -> np.ndarray:
        return np.concatenate([column(unsqueeze(x, 8), 0, np.int64) for _, x in sorted(answer)])

    @staticmethod
    def _sums(answer: list[tuple[int, bytes]]) -> np.ndarray:
        """Rows (n(1..TOP), sum) of contexts; n is 0 or 1 and the sum missing where nothing backs off."""
        parts = []
        for _, x in sorted(answer):
            size = 8 + int.from_bytes(x[:8], "little")
            which, full = unsqueeze(x[8:size], 1)[:, 0], unsqueeze(x[size:], 8 * (TOP + 1))
            s = np.concatenate([(which[:, None] >> np.arange(TOP)) & 1, np.zeros((len(which), 1))], axis=1).astype(np.float64)
            at = np.flatnonzero(which >> _BACKS_OFF)
            for k in range(TOP):
                s[at, k] = column(full, 8 * k, np.uint64)
            s[at, TOP] = column(full, 8 * TOP, np.float64)
            parts.append(s)
        return np.concatenate(parts)

    def next(self, j: int, answer: list[tuple[int, bytes]], sums: list[tuple[int, bytes]]) -> None:
        """Go on to level j's probabilities."""
        key, _, of, hot, context, rest, gram = self.rows(j)
        level = self.levels[j - 1]
        r = self._counts(answer)
        cold = hot == 0
        of_context = np.zeros(len(key), np.int64)
        of_context[cold] = np.cumsum(_heads(key[cold])) - 1 + len(level.hot)
        of_context[~cold] = hot[~cold]
        s = np.concatenate([level.hot[:, 1:], self._sums(sums)])
        c = np.concatenate([self.r, self.texts])[context]  # how often what ends before the token occurs, or how many texts there are
        freed = sum((1 - level.d[k]) * k * s[:, k - 1] for k in range(1, TOP + 1))[of_context]
        none = freed <= 0
        with np.errstate(divide="ignore"):
            scale = np.where(c > 0, np.where(none, 1 / (c + 1), 1 / c), 0)
        kept = np.where(none, scale, freed * scale)
        alpha = np.where(c > 0, kept / np.maximum(1 - s[of_context, TOP] * self.scale[rest], 1e-15), 1.0)
        seen = np.where(none, r, level.discounted(r)) * scale
        self.prob, self.scale = np.where(r > 0, seen, alpha * self.prob[rest]), scale
        self._reach(r, of, gram)


def _summed(answered: DataFrame, n: int) -> list[int]:
    row = answered.where("stats is not null").agg(*[F.sum(F.element_at("stats", i + 1)) for i in range(n)]).first()
    return [int(x or 0) for x in row]


def _next_hot(answered: DataFrame, least: int, range_share: int) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams that occur more than least times, ascending; parts of each): least bounds how many there are."""
    few = answered.where("heavy is not null").select(F.explode("heavy").alias("h")).where(F.size("h.numbers") <= 2)
    got = few.select("h.key", F.element_at("h.numbers", -1).alias("n")).toPandas()
    keys = got["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.maximum(1, -(-got["n"].to_numpy(np.int64)[order] // max(1, range_share)))


def _hot_sums(answered: DataFrame, n_hot: int) -> np.ndarray:
    """Rows of sums of hot contexts, by number; row 0 is of none."""
    few = answered.where("heavy is not null").select(F.explode("heavy").alias("h")).where(F.size("h.numbers") == TOP + 2)
    got = few.groupBy("h.key").agg(*[F.sum(F.element_at("h.numbers", i + 1)).alias(f"s{i}") for i in range(TOP + 2)]).toPandas()
    out = np.zeros((n_hot + 1, TOP + 2))
    out[got["key"].to_numpy(np.int64)] = got[[f"s{i}" for i in range(TOP + 2)]].to_numpy(np.float64)
    return out


def score(docs: DataFrame, training: Column | None = None, order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    training says which rows are learned from (default: the held-out fold isn't); A-Z are lower-cased; words are runs of non-space
    bytes, and each text ends with one more token.  Null texts are empty: they have the end only.  Rows that repeat count each time.
    base_score: log10 of add-one unigrams with one unknown word; score: log10 of the model.  Without training rows, every word is the
    unknown one, of probability 1.
    """
    if order < 2:
        raise ValueError("a backoff model has two levels at least")
    spark = docs.sparkSession
    train = (fold_of(F.col("doc_id")) != HELD_OUT) if training is None else training
    blocks, path, n_bytes = write_blocks(docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train")), "katz", block_bytes)
    p = ranges(n_bytes, spark)

    def send_words(block, _):
        t = BlockTokens(read_block(path, block))
        keys, _, _, n = _distinct(t.seq, t.train)
        yield messages(block, keys, planes(n), p, True)

    least = max(1, n_bytes // (TOKEN_BYTES * min(max(p, LEAST_SHARES), MOST_SHARES)))
    share = max(1, n_bytes // (TOKEN_BYTES * max(p, LEAST_SHARES)))
    answered = [replied(each_block(blocks, send_words, MESSAGE), functools.partial(_count_words, least=least, n_ranges=p), "katz-1")]
    stats = _summed(answered[0], TOP + 3)
    levels = [Level(stats[2:], np.zeros((1, TOP + 2)), stats[0], stats[1])]
    levels[0].next_hot, levels[0].next_parts = _next_hot(answered[0], least, share)
    for j in range(2, order + 1):

        def send(block, got, j=j, levels=levels):
            scorer = Scorer(BlockTokens(read_block(path, block)), levels)
            scorer.first(got[0])
            for k in range(2, j):
                scorer.counts(k, got[k - 1])
            keys, extra, *_ = scorer.rows(j)
            yield messages(block, keys, extra(), p, True)

        count = functools.partial(_count_grams, least=least, hot_contexts=levels[-1].next_hot, below=levels[-1], last=j == order)
        answered.append(replied(each_block(blocks, send, MESSAGE, *[a.select("block", "p", "answer") for a in answered]), count, f"katz-{j}"))
        now = _summed(answered[-1], TOP + 3)
        levels = [*levels, Level(now[2:], _hot_sums(answered[-1], len(levels[-1].next_hot)), now[0], now[1])]
        if j < order:
            levels[-1].next_hot, levels[-1].next_parts = _next_hot(answered[-1], least, share)
    n_train, n_types = levels[0].total, levels[0].vocabulary

    def finish(block, got):
        table = read_block(path, block)
        t = BlockTokens(table)
        scorer = Scorer(t, levels)
        scorer.first(got[0])
        c = scorer.r[scorer.of]
        for j in range(2, order + 1):
            scorer.next(j, got[j - 1], got[order + j - 2])
        rows = table.num_rows
        base = np.bincount(t.doc, weights=np.log10((c + 1) / (n_train + n_types + 1)), minlength=rows)
        total = np.bincount(t.doc, weights=np.log10(scorer.prob)[scorer.of], minlength=rows)
        known = np.bincount(t.doc, weights=c > 0, minlength=rows).astype(np.int64)
        ids = table.column("doc_id").combine_chunks()
        held = pa.array(~np.asarray(table.column("train").to_numpy(), bool))
        yield pa.RecordBatch.from_arrays(
            [ids, held, pa.array(t.n_words + 1), pa.array(known), pa.array(np.full(rows, n_train)), pa.array(base), pa.array(total)],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    kind = dict(docs.dtypes)["doc_id"]
    return each_block(blocks, finish, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double", *answered, *[a.select("block", "p", F.col("more").alias("answer")) for a in answered[1:]])
