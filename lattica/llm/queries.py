"""The queries of this subpackage, each its operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import bpe, common, divergence, exact_dedup, language_id, line_dedup, packing, quality, simhash, substring_dedup, token_file, url_rules, vector_codes, warc


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(common.table(spark, sf_dir, "documents")).drop("ids")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(common.table(spark, sf_dir, "documents"))


def op3_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.token_files(common.table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(common.table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    kept = substring_dedup.substring_dedup(docs.select("doc_id", "text", F.size(common.words(F.col("text"))).cast("long").alias("n_words")))
    left = kept.withColumn("left", common.words(F.col("text")))
    return left.select("doc_id", "n_words", (F.col("n_words") - F.size("left")).alias("n_removed"), F.sha2(F.array_join("left", " ").cast("binary"), 256).alias("kept_sha256"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(common.table(spark, sf_dir, "pages"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(common.table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(common.table(spark, sf_dir, "documents")).drop("text_key")


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.url_verdicts(pages, url_rules.labelled_urls(pages, common.table(spark, sf_dir, "labels")))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(common.table(spark, sf_dir, "documents")).drop("text_key")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(common.table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(common.table(spark, sf_dir, "embeddings"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(common.table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_packing, op2_bpe, op3_token_file, op4_exact_dedup, op5_substring_dedup, op6_warc, op7_simhash, op8_quality, op9_url_rules, op10_line_dedup, op11_divergence, op12_vector_codes, op13_language_id)
}


def _rounds(rounds: int = 4) -> str:
    """The codebooks b0 to b{rounds} of op12 and the parts' last assignment, a{rounds}, as views."""
    near = "a{0} AS MATERIALIZED (SELECT vec_id, p, any_value(x) AS x, min({{'d': d, 'e': e}}) AS m FROM (SELECT vec_id, v.p, x, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v JOIN b{0} b ON v.p = b.p) GROUP BY vec_id, p)"
    mean = """b{1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.c, b.c) AS c FROM b{0} b LEFT JOIN (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c
  FROM (SELECT p, m.e AS e, i, CAST(sum(y) AS BIGINT) AS s, count(*) AS n FROM (SELECT p, m, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{0}) GROUP BY ALL) GROUP BY p, e) n USING (p, e))"""
    return ",\n".join([x for k in range(rounds) for x in (near.format(k), mean.format(k, k + 1))] + [near.format(rounds)])


ORACLES: dict[str, str] = {
    "op4_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t""",
    "op6_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS last FROM p GROUP BY html)
SELECT page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(sha1(p.html), 1 + 5 * (k // 4), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS INTEGER), 1) FOR k IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM p JOIN g ON p.html = g.html""",
    "op8_quality": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
i AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i:i + 4]) AS n FROM i),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r WHERE n > 1) GROUP BY doc_id),
b AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM w LEFT JOIN c USING (doc_id)),
k AS (SELECT doc_id, source, text FROM documents),
l AS MATERIALIZED (SELECT doc_id, source, unnest(list_filter(list_transform(string_split(lower(coalesce(text, '')), chr(10)), lambda x: trim(regexp_replace(regexp_replace(x, '[\x20\x09\x0B-\x0D]+', ' ', 'g'), '[0-9]', '0', 'g'))), lambda x: x <> '')) AS line FROM k),
h AS (SELECT source, count(DISTINCT doc_id) AS n_host FROM k GROUP BY source),
m AS (SELECT source, line, count(DISTINCT doc_id) AS n FROM l GROUP BY source, line HAVING count(DISTINCT doc_id) > 20),
f AS (SELECT m.source, m.line FROM m JOIN h ON m.source IS NOT DISTINCT FROM h.source WHERE n > 0.1 * n_host),
g AS (SELECT doc_id, sum(len(string_split(l.line, ' '))) AS n FROM l JOIN f ON l.source IS NOT DISTINCT FROM f.source AND l.line = f.line GROUP BY doc_id)
SELECT b.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT n_words - coalesce(g.n, 0) < 0.2 * n_words AS kept, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed_words
FROM b LEFT JOIN g USING (doc_id)""",
    "op5_substring_dedup": r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
i AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS least FROM i) WHERE least < doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM m),
e AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM e ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)""",
    "op11_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS MATERIALIZED (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d) GROUP BY ALL),
k AS MATERIALIZED (SELECT lang, term, sum(n) AS total FROM w GROUP BY lang, term HAVING count(*) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, sum(n) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
f AS (SELECT lang, source, term, coalesce(c.n, 0) AS n, total FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
z AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS n_group, sum(n) OVER (PARTITION BY lang) AS n_lang, count(*) OVER (PARTITION BY lang, source) AS v FROM f),
p AS MATERIALIZED (SELECT lang, source, term, n, 1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // (n_group + 5 * v) AS p, 1 + (CAST(1000000000 AS HUGEINT) * (total + 5)) // (n_lang + 5 * v) AS q FROM z),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM o) WHERE part = 'pair' OR rank <= 50""",
    "op12_vector_codes": f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda y: CAST(floor(1024 * CAST(y AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
v AS MATERIALIZED (SELECT vec_id, p, x[p * len(x) // 4 + 1:(p + 1) * len(x) // 4] AS x FROM k, range(4) t(p)),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM v WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 256)),
{_rounds()},
s AS (SELECT sha256(array_to_string(flatten(list(c ORDER BY p, e)), ',')) AS codebooks_sha256 FROM b4),
c AS (SELECT vec_id, string_agg(format('{{:02x}}', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a4 GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN k USING (vec_id), s""",
}
