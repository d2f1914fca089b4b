"""Text normalisation as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that cleaning keeps.
KEPT = "abcdefghijklmnopqrstuvwxyz .?!'0123456789"
_DROP = "[^a-z .?!'0-9]"


def _chain(c: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, to in steps:
        c = F.regexp_replace(c, pattern, to)
    return c


_PAD = [("([.?!])", " $1 ")]
#: Apostrophes between two words' letters: a match of three characters is marked first, then every apostrophe in it gets a space.
_APOSTROPHES = [
    (" ' ", " "),
    (" '([a-z])", " $1"),
    ("n't", " n't"),
    ("([^ n])'([^ t])", "\x01$1'$2\x02"),
    ("\x01'''\x02", " ' ' '"),
    ("\x01''(.)\x02", " ' '$1"),
    ("\x01(.)''\x02", "$1 ' '"),
    ("\x01(.)'(.)\x02", "$1 '$2"),
]


def clean(c: Column) -> Column:
    """Lower case, ASCII words and . ? ! ' only, punctuation and contractions set apart by spaces.  Null stays null."""
    plain = _chain(F.lower(c), [(_DROP, ""), *_PAD])
    return F.when(c.contains("'"), _chain(plain, _APOSTROPHES)).otherwise(plain)


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once however often body has it, also within the functions of arrays."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@cache
def compatibility_map() -> dict[str, str]:
    """What compatibility decomposition leaves of each lower-case non-ASCII character after dropping all that cleaning drops."""
    out = {}
    for code in range(128, 0x110000):
        ch = chr(code)
        if ch == ch.lower() and not 0xD800 <= code < 0xE000:
            rest = "".join(x for x in unicodedata.normalize("NFKD", ch) if x in KEPT)
            if rest:
                out[ch] = rest
    return out


def decomposed(c: Column) -> Column:
    """Each character as its compatibility decomposition, as far as cleaning keeps that."""
    table = compatibility_map()
    single = {k: v for k, v in table.items() if len(v) == 1}
    several = {k: v for k, v in table.items() if len(v) > 1}
    lookup = F.create_map(*[F.lit(x) for kv in several.items() for x in kv])
    # runs of ASCII are one element each, and a character that becomes one other is ASCII already; so few are looked up
    parts = lambda t: F.regexp_extract_all(t, F.lit("[\\x00-\\x7F]+|[^\\x00-\\x7F]"), F.lit(0))
    spelled = lambda t: F.array_join(F.transform(parts(t), lambda x: F.when(F.octet_length(x) == F.length(x), x).otherwise(F.coalesce(F.element_at(lookup, x), x))), "")
    return F.when(c.rlike(r"[^\x00-\x7F]"), spelled(F.translate(c, "".join(single), "".join(single.values())))).otherwise(c)


#: Public treebank conventions that can still apply after cleaning.
_TREEBANK = [
    ("('s|'m|'d|'ll|'re|'ve|n't)(?= |$)", " $1"),
    ("([^ ])'(?= |$)", "$1 '"),
    ("\\b(can)(not)\\b", "$1 $2"),
    ("\\b(gim|lem)(me)\\b", "$1 $2"),
    ("\\b(gon|wan)(na)\\b", "$1 $2"),
    ("\\b(got)(ta)\\b", "$1 $2"),
    ("(^| )('t)(is|was)\\b", "$1$2 $3"),
    (" +", " "),
]


def contractions(c: Column) -> Column:
    """Contractions set apart as treebank tokens are."""
    return F.trim(_chain(c, _TREEBANK))


#: Public treebank conventions for a sentence's quotes, brackets, ellipses and punctuation; fixed values.
SENTENCE_STEPS = [
    ('^"', "`` "),
    ('([ (\\[{<])"', "$1 `` "),
    ("\\.\\.\\.", " ... "),
    ("([,:])([^0-9])", " $1 $2"),
    ("([,:])$", " $1 "),
    ("([;@#$%&?!])", " $1 "),
    ("([^.])(\\.)([\\])}>\"']*) *$", "$1 $2 $3 "),
    ("([\\]\\[(){}<>])", " $1 "),
    ("--", " -- "),
    ('"', " '' "),
    ("([^' ])('[sSmMdD]|') ", "$1 $2 "),
    ("([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1 $2 "),
    (" +", " "),
]


def treebank(c: Column) -> Column:
    """A sentence's words as the treebank cuts them, joined by one blank.  Null stays null."""
    return F.trim(_chain(F.concat(c, F.lit(" ")), SENTENCE_STEPS))


def clean_accents(c: Column) -> Column:
    """As clean, but accented letters keep their base letter, and apostrophes follow the treebank conventions."""
    c = F.replace(F.lower(c), F.lit(" ' "), F.lit("'"))
    c = F.replace(F.regexp_replace(decomposed(c), _DROP, ""), F.lit("n 't"), F.lit("n't"))
    return F.concat(contractions(_chain(c, _PAD)), F.lit(" "))


def tokens(c: Column) -> Column:
    """Words between spaces; an empty array for none."""
    return F.filter(F.split(F.trim(c), " +"), lambda t: t != "")


def byte_ids(c: Column, reserved: int = 2, end: int = 1) -> Column:
    """UTF-8 bytes as numbers after the reserved ones, then the end's; null has no bytes."""
    pairs = F.regexp_extract_all(F.hex(F.encode(F.coalesce(c, F.lit("")), "UTF-8")), F.lit(".."), F.lit(0))
    return F.concat(F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("int") + reserved), F.array(F.lit(end)))
