"""The registered queries of the corpus operators, and their SQL where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm import collocations, hardnegatives, licenses, mixing, packing, pii, simhash, tokenfiles, toxicity, urlfilter, vectors, warc
from sessionloom.llm.common import shared_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def held_out(doc_id: Column) -> Column:
    """The quarter of documents whose labels are never learnt from; documents without an id are not in it."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("long").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def quality_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled good weigh 4, poor ones 1; those without a label weigh 2 (see mixed)."""
    q = F.col("quality")
    return table(spark, sf_dir, "labels").filter(q.isNotNull()).select("doc_id", F.when(q == 1, 4.0).otherwise(1.0).alias("weight"))


def mixed(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    return mixing.mix(docs, quality_weights(spark, sf_dir), unweighted=2.0)


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'w', 'g'), '[\x20\x09-\x0D]+', '', 'g')) AS size
  FROM documents
), q AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 4.0 ELSE 1.0 END) AS w FROM labels WHERE quality IS NOT NULL GROUP BY 1),
keyed AS (
  SELECT d.*, CAST(floor((1.0 - pow((CAST('0x' || substr(md5('5:' || coalesce(d.doc_id, -1)), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0,
    1.0 / coalesce(q.w, 2.0))) * 281474976710656.0) AS BIGINT) AS k
  FROM d LEFT JOIN q USING (doc_id)
), s AS (
  SELECT source, sum(size) AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM keyed GROUP BY source
), o AS (
  SELECT *, 3.0 * source_size AS cap, sum(source_size) OVER () * 1.0 AS budget,
    coalesce(sum(3.0 * source_size) OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
    sum(w) OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w
  FROM s
), p AS (SELECT max((budget - filled) / open_w) AS price FROM o WHERE (budget - filled) / open_w * w <= cap),
goal AS (SELECT source, source_size, least(cap, price * w) AS target FROM o, p),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM goal),
runs AS (
  SELECT source, k, sum(size) AS n, sum(sum(size)) OVER (PARTITION BY source ORDER BY k) AS run FROM keyed GROUP BY source, k
), ends AS (
  SELECT r.source, min_by(CASE WHEN (target - epochs * source_size - run + n) * 2 >= n THEN k + 1 ELSE k END, k) AS cut
  FROM runs r JOIN g ON r.source IS NOT DISTINCT FROM g.source WHERE run > target - epochs * source_size GROUP BY r.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, CAST(target AS DOUBLE) AS target,
  CAST(size * (epochs + CASE WHEN k < cut THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM keyed JOIN g ON keyed.source IS NOT DISTINCT FROM g.source LEFT JOIN ends ON keyed.source IS NOT DISTINCT FROM ends.source
"""


@query("op5_mixing", MIX_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of documents mixed to weights 1, 2, 3; good documents weigh 4, poor 1, unlabelled 2."""
    found = mixed(spark, sf_dir, table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


@query("op6_simhash_near_duplicates")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _url_sql() -> str:
    def seen(term: str) -> str:
        return f"CAST(regexp_matches(u, '(^|[^a-z0-9]){term}($|[^a-z0-9])') AS INT)"

    strict, soft = " + ".join(map(seen, urlfilter.STRICT)), " + ".join(map(seen, urlfilter.SOFT))
    rules = sorted(urlfilter.RULES, key=lambda r: -len(r[1] + r[2]))
    when = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for v, h, p in rules]
    return rf"""
WITH p AS (
  SELECT page_id, lower(coalesce(url, '')) AS u,
    CASE WHEN position('://' IN coalesce(url, '')) = 0 THEN '' ELSE substr(url, position('://' IN url) + 3) END AS rest FROM pages
), q AS (
  SELECT page_id, u, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), h AS (
  SELECT page_id, host, path, {strict} AS strict_hits, {soft} AS soft_hits,
    CASE {' '.join(f"WHEN {c} THEN '{r}'" for c, r, _ in when)} END AS rule,
    CASE {' '.join(f"WHEN {c} THEN '{v}'" for c, _, v in when)} END AS verdict FROM q
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN strict_hits >= 1 OR soft_hits >= 2 THEN 'block' ELSE 'allow' END) AS verdict,
  strict_hits, soft_hits FROM h
"""


@query("op8_url_filter", _url_sql())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"))


@query("op9_token_files")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark) + "/token-files"
    tokenfiles.write_token_files(table(spark, sf_dir, "documents"), folder, tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return tokenfiles.read_token_files(spark, folder)


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learnt from labels outside the held-out quarter; the labels are no input of a score."""
    docs = table(spark, sf_dir, "documents")
    held = held_out(F.col("doc_id"))
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held))
    return found.select("doc_id", held.alias("held_out"), "score", "predicted", "evidence",
                        F.size("passages").alias("n_passages"))


@query("op2_personal_data")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


VECTORS_SQL = """
v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
)"""
LINKS_SQL = f"""
WITH RECURSIVE {VECTORS_SQL}, u AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE list_dot_product(e, e) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9
), reach AS (
  SELECT x AS vec_id, x AS other FROM (SELECT DISTINCT x FROM links)
  UNION SELECT r.vec_id, l.y FROM reach r JOIN links l ON l.x = r.other
), least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY 1),
n AS (SELECT x AS vec_id, count(*) AS n_links FROM links GROUP BY 1)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, coalesce(component_id, vec_id) AS component_id,
  coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN least USING (vec_id)
"""
TOP_SQL = f"""
WITH {VECTORS_SQL}, w AS (SELECT vec_id, list_transform(e, lambda x: floor(x * 256)) AS e FROM v)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM (
  SELECT q.vec_id AS query_id, w.vec_id, list_dot_product(q.e, w.e) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.e, w.e) DESC, w.vec_id) AS rank
  FROM w q JOIN w ON q.vec_id <> w.vec_id WHERE q.vec_id % 50 = 0)
WHERE rank <= 5
"""


def _license_sql() -> str:
    """Windows of a template's own size begin at every half size; each is told by the template's shingles in it."""
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def fives(words: str) -> str:
        return f"list_transform(range(1, len({words}) - 3), lambda i: array_to_string(list_slice({words}, i, i + 4), ' '))"

    values = ", ".join(f"({quoted(n)}, {quoted(t)}, {licenses._window(len(re.findall(licenses.ASCII_WORD, t)))})" for n, t in licenses.TEMPLATES)
    return rf"""
WITH t AS (
  SELECT license, size, {fives('w')} AS g FROM (
    SELECT license, size, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM (VALUES {values}) x(license, text, size))
), tg AS (SELECT DISTINCT license, size, len(list_distinct(g)) AS n, unnest(g) AS five FROM t),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL),
dg AS (SELECT doc_id, unnest({fives('w')}) AS five, unnest(range(0, greatest(len(w) - 4, 0))) AS pos FROM d),
hit AS (SELECT DISTINCT doc_id, license, size, n, five, pos FROM dg JOIN tg USING (five)),
inside AS (
  SELECT doc_id, license, n, five,
    unnest(range(greatest(CAST(ceil((pos - (size - 5)) / (size // 2)) AS BIGINT), 0), pos // (size // 2) + 1)) AS win FROM hit
), share AS (SELECT doc_id, license, win, count(DISTINCT five) / any_value(n) AS share FROM inside GROUP BY 1, 2, 3)
SELECT doc_id, license, max(share) AS containment, count(*) AS windows FROM share WHERE share >= 0.8 GROUP BY 1, 2
"""


@query("op3_embedding_near_duplicates", LINKS_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op4_top_k_search", TOP_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


@query("op10_license_scan", _license_sql())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


COLLOCATIONS_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]') AS pieces FROM documents
), p AS (SELECT lang, regexp_extract_all(unnest(pieces), '[^\x20\x09]+') AS w FROM d),
total AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM p GROUP BY lang),
f AS (
  SELECT lang, m, phrase, count(*) AS f FROM (
    SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(list_slice(w, i, i + m - 1), ' '))) AS phrase
    FROM p, (VALUES (1), (2), (3), (4), (5)) v(m) WHERE len(w) >= m) GROUP BY 1, 2, 3 HAVING count(*) >= 100
), c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m >= 2),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(list_slice(w, 1, k), ' ') AS p1, array_to_string(list_slice(w, k + 1, m), ' ') AS p2
  FROM c, (VALUES (1), (2), (3), (4)) v(k) WHERE k < m
), scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, k, x.f AS l, y.f AS r, n, CAST(1000 AS HUGEINT) * cuts.a * n // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = p1 JOIN f y ON y.lang = cuts.lang AND y.phrase = p2 JOIN total ON total.lang = cuts.lang
), best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM scored),
around AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, a, unnest(list_transform(range(1, m - s + 2), lambda i: array_to_string(list_slice(w, i, i + s - 1), ' '))) AS phrase
    FROM c, (VALUES (2), (3), (4)) v(s) WHERE s < m) GROUP BY 1, 2
), kept AS (
  SELECT b.* FROM best b LEFT JOIN around o ON o.lang = b.lang AND o.phrase = b.phrase WHERE place = 1 AND coalesce(100 * o.a < 100 * b.a, true)
)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n,
  CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000
"""


@query("op11_collocations", COLLOCATIONS_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def shifted(vec_id: Column, label: Column) -> Column:
    """Where the id is divisible by 7, the label moves to the next of ten."""
    return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)


NEGATIVES_SQL = """
WITH w AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(x * 256)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), s AS (
  SELECT q.vec_id AS anchor, w.vec_id AS other, q.label = w.label AS same, CAST(list_dot_product(q.e, w.e) AS BIGINT) AS score
  FROM w q JOIN w ON q.vec_id <> w.vec_id WHERE q.vec_id % 100 = 0
), p AS (
  SELECT anchor, other AS positive, score AS top FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) AS place FROM s WHERE same) WHERE place <= 5
), n AS (
  SELECT p.anchor, positive, top, other, score, row_number() OVER (PARTITION BY p.anchor, positive ORDER BY score DESC, other) AS rank
  FROM p JOIN s ON s.anchor = p.anchor AND NOT same AND 80 * top <= 100 * score AND 100 * score <= 100 * top
)
SELECT anchor AS anchor_id, positive AS positive_id, CAST(rank AS INT) AS rank, other AS negative_id, top AS positive_score, score AS negative_score
FROM n WHERE rank <= 5
"""


@query("op12_hard_negatives", NEGATIVES_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardnegatives.mine(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0, relabel=shifted)


WARC_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS digest FROM pages
), b AS (
  SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
    (CAST('0x' || substr(digest, (i // 4) * 5 + 1, 5) AS BIGINT) // (CASE i % 4 WHEN 0 THEN 32768 WHEN 1 THEN 1024 WHEN 2 THEN 32 ELSE 1 END)) % 32 + 1 AS INT), 1)), '')
    AS payload_digest, max(page_id) OVER (PARTITION BY digest, payload_bytes) AS top FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to FROM b
"""


@query("op13_warc", WARC_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark) + "/warc"
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    found = warc.read_records(spark, folder)
    return found.select(warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest",
                        F.col("type").alias("record_type"), warc.page_of(F.col("refers_to")).alias("refers_to"))
