"""The operators as queries over the whole tables, with their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, divergence, exact_dedup, katz, lexical, licenses, mixing, pieces, quality, secret_scan, simhash, substring_dedup, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as WARC records: written, normalised and read back.  Null html is an empty payload; see :func:`warc.round_trip`."""
    return warc.round_trip(spark, _read(spark, sf_dir, "pages"))


def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's log10 probability under the three-level model of the training fold; see :func:`katz.score`."""
    return katz.score(_read(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every text, null ones empty; see :func:`secret_scan.scan`."""
    return secret_scan.scan(_read(spark, sf_dir, "documents")).drop("texts")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's score by the classifier of the labelled training fold; see :func:`quality.classify`."""
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's own or inherited licence; see :func:`licenses.scan`."""
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every text; see :func:`decontaminate.search`."""
    found = decontaminate.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's fingerprint and component; see :func:`simhash.near_duplicates`."""
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's group of equal texts; see :func:`exact_dedup.mark`."""
    return exact_dedup.mark(_read(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every row; see :func:`mixing.mix`."""
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's words but the repeated ones; see :func:`substring_dedup.remove_repeats`."""
    found = substring_dedup.remove_repeats(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item; see :func:`lexical.search`."""
    return lexical.rank(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids by the public model of 32,000 pieces, and what they decode to; see :func:`pieces.encode`."""
    return pieces.digests(pieces.round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sources and telling terms of every source; see :func:`divergence.audit`."""
    return divergence.audit(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_katz, op3_secrets, op4_quality, op5_licenses, op6_decontaminate, op7_simhash, op8_exact_dedup, op9_mixing, op10_substring_dedup, op11_lexical, op12_pieces, op13_divergence)}

# ---- SQL for DuckDB ---------------------------------------------------------------------------------------------------------

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP1 = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT *, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, octet_length(encode(h)) AS payload_bytes,
array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((('0x' || substr(x, CAST(5 * (i // 4) + 1 AS INT), 5))::INT >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS INT), 1)), '') AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d"""

_OP6 = f"""WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents), b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[i:i+9], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, l, array_to_string(w[i:i+l-1], ' ') AS g FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l)),
h AS (SELECT doc_id, i, l, item_id FROM dw JOIN bw USING (l, g)),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""

_OP8 = """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""


def _apportioned(name: str, source: str, group: str, order: str, weight: str, total: str, seats: str) -> str:
    """Highest quotients over source's rows: a CTE named name, with quota."""
    near = lambda more: f"CAST(floor(w_ * (s_ + ({more})) / t_ + 0.5) AS BIGINT)"
    return f"""{name}0 AS (SELECT *, CAST({weight} AS DOUBLE) AS w_, CAST({total} AS DOUBLE) AS t_, CAST({seats} AS BIGINT) AS s_ FROM {source}),
{name}1 AS (SELECT *, CAST(sum(CASE WHEN w_ > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY {group}) AS BIGINT) AS n_ FROM {name}0),
{name}2 AS (SELECT *, CASE WHEN t_ > 0 THEN greatest({near('-(n_ / 2 + 1)')}, 0) ELSE 0 END AS lo_ FROM {name}1),
{name}3 AS (SELECT *, CASE WHEN t_ > 0 AND w_ > 0 THEN greatest({near('n_ / 2 + 1')}, lo_) ELSE lo_ END AS hi_, s_ - sum(lo_) OVER (PARTITION BY {group}) AS open_ FROM {name}2),
{name}4 AS (SELECT {group}, {order}, open_, row_number() OVER (PARTITION BY {group} ORDER BY w_ / (2 * k_ - 1) DESC, {order}, k_) AS r_ FROM (SELECT *, unnest(range(lo_ + 1, hi_ + 1)) AS k_ FROM {name}3)),
{name}5 AS (SELECT {group} AS g_, {order} AS o_, count(*) AS won_ FROM {name}4 WHERE r_ <= open_ GROUP BY 1, 2),
{name} AS (SELECT {name}3.*, lo_ + coalesce(won_, 0) AS quota FROM {name}3 LEFT JOIN {name}5 ON g_ = {group} AND o_ = {order})"""


def _op9() -> str:
    block, shard, seed = mixing.BLOCK, mixing.SHARD_WORDS, mixing.SEED
    at = lambda i: f"(({i} + start % n) * (quota % n) // n)"
    return f"""WITH z AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM z GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s0),
s2 AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s1),
s3 AS (SELECT *, cap / weight AS ratio, CAST(sum(weight) OVER () AS BIGINT) AS weights FROM s2),
s4 AS (SELECT *, CAST(sum(cap) OVER o AS BIGINT) - cap AS caps, weights - CAST(sum(weight) OVER o AS BIGINT) + weight AS rest FROM s3 WINDOW o AS (ORDER BY ratio, rank ROWS UNBOUNDED PRECEDING)),
s5 AS (SELECT *, ratio < (3 * total - 2 * caps) / (2 * rest) AS capped FROM s4),
s6 AS (SELECT *, CAST(sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () AS BIGINT) AS free, CAST(sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS BIGINT) AS full_caps FROM s5),
s7 AS (SELECT source, rank, source_size, total, 1 AS one, CASE WHEN capped OR free = 0 THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), weight * ((3 * total - 2 * full_caps) / (2 * free))) END AS target FROM s6),
{_apportioned('a', 's7', 'one', 'rank', 'target', '3 * total / 2', f'(3 * total + {block}) // {2 * block}')},
r AS (SELECT doc_id, size, k, rank, source_size, target, quota AS source_quota, CAST('0x' || substr(k, 1, 8) AS BIGINT) % (source_size // {shard} + 1) AS shard FROM z JOIN a ON z.source IS NOT DISTINCT FROM a.source),
p0 AS (SELECT rank, shard, CAST(sum(size) AS BIGINT) AS words, max(source_size) AS source_size, max(source_quota) AS source_quota FROM r GROUP BY rank, shard),
{_apportioned('b', 'p0', 'rank', 'shard', 'words', 'source_size', 'source_quota')},
p AS (SELECT rank, shard, (words + {block - 1}) // {block} AS n, least(quota, 2 * ((words + {block - 1}) // {block})) AS quota, CAST('0x' || substr(md5('{seed}:' || rank || ':' || shard), 1, 8) AS BIGINT) AS start FROM b),
x AS (SELECT r.*, n, p.quota, start, CAST(sum(size) OVER (PARTITION BY r.rank, r.shard ORDER BY substr(k, 9, 24), doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS b FROM r JOIN p USING (rank, shard)),
y AS (SELECT *, b - size AS a, (b - size) // {block} AS i0, (b - 1) // {block} AS i1 FROM x)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size = 0 OR n = 0 THEN 0 ELSE (quota // n) * size + CASE WHEN i0 = i1 THEN size * ({at('i0 + 1')} - {at('i0')})
ELSE ((i0 + 1) * {block} - a) * ({at('i0 + 1')} - {at('i0')}) + (b - i1 * {block}) * ({at('i1 + 1')} - {at('i1')}) + {block} * ({at('i1')} - {at('i0 + 1')}) END END AS BIGINT) AS taken FROM y"""


_OP10 = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i+34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
m AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
c AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM g SEMI JOIN m USING (h)) GROUP BY doc_id),
q AS (SELECT d.doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d) d),
u AS (SELECT doc_id, unnest(gone) AS p, true AS cut FROM c),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM q ANTI JOIN u USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)"""

_OP11 = f"""WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents), t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL),
s AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0), g AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM s),
q AS (SELECT DISTINCT item_id, unnest({_ALNUM}) AS term FROM benchmark), f AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM t SEMI JOIN q USING (term) GROUP BY term), g),
r AS (SELECT item_id, doc_id, CAST(sum(w * (1000000000 * tf // (1000 * tf + 20 * (50 + 50 * n * n_docs // n_terms)))) AS BIGINT) AS score FROM q JOIN f USING (term) JOIN t USING (term) JOIN s USING (doc_id), g GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= 50"""

_P = lambda n, total: f"(1 + 1000000000::HUGEINT * (({n}) + 2) // (({total}) + 2 * v))"
_F = lambda p, q: f"CAST(({p} - {q}) * ({p} - {q}) // ({p} + {q}) AS BIGINT)"
_OP13 = rf"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t0 AS (SELECT lang, source, row_number() OVER () AS i, w FROM d), t1 AS (SELECT lang, source, i, unnest(w) AS term FROM t0), k AS (SELECT lang, term, count(*)::HUGEINT AS ln FROM t1 GROUP BY ALL HAVING count(DISTINCT i) >= 10),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t1 SEMI JOIN k USING (lang, term) GROUP BY ALL), gr AS (SELECT DISTINCT lang, source FROM d), lv AS (SELECT lang, count(*)::HUGEINT AS v, sum(ln)::HUGEINT AS lt FROM k GROUP BY lang),
g AS (SELECT gr.lang, gr.source, coalesce(v, 0) AS v, coalesce(lt, 0) AS lt, coalesce(total, 0) AS total FROM gr LEFT JOIN lv USING (lang) LEFT JOIN (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY ALL) USING (lang, source)),
x AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, {_P('coalesce(n, 0)', 'total')} AS p, {_P('ln', 'lt')} AS q FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pr AS (SELECT a.lang, a.source, b.source AS item, CAST(sum({_F('a.p', 'b.p')}) AS BIGINT) AS value FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pa AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pr ON pr.lang = a.lang AND pr.source = a.source AND pr.item = b.source),
tm AS (SELECT lang, source, term AS item, {_F('p', 'q')} AS value FROM x WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM pa
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM tm) WHERE rank <= 10"""

SQL = {"op1_warc": _OP1, "op6_decontaminate": _OP6, "op8_exact_dedup": _OP8, "op9_mixing": _op9(), "op10_substring_dedup": _OP10, "op11_lexical": _OP11, "op13_divergence": _OP13}
