"""One query for each operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, divergence, hnsw, html_main, jaccard, packing, pii, quality, simhash, toxicity, warc, wordpiece
from .common import held_out, table, work_dir

GOOD, TOXIC = 0.7, 0.3


def scored(rows: DataFrame, threshold: float) -> DataFrame:
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels"))), GOOD)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), size=4, percent=85)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return hnsw.neighbours(rows, rows.filter("vec_id % 20 = 0"), k=20)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "archives")
    files = warc.write_archives(warc.plan_records(table(spark, sf_dir, "pages"), min_bytes=0), folder)
    return warc.read_archives(files, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))), TOXIC)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = bpe.decode(bpe.encode(table(spark, sf_dir, "documents")))
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = simhash.edited_fingerprints(table(spark, sf_dir, "documents"))
    pair = lambda kind: (F.col(f"{kind}.high"), F.col(f"{kind}.low"))
    return each.select(
        "doc_id", "n_chars", "edited_sha256", simhash.as_text(*pair("own")).alias("fingerprint"), simhash.as_text(*pair("edited")).alias("edited_fingerprint"),
        simhash.likeness(*pair("own"), *pair("edited")).alias("near_edited"), simhash.likeness(*pair("own"), *pair("next")).alias("near_next"),
    )


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_main.main_text(pages, html_main.fit(pages)).withColumn("n_chars", F.char_length("text").cast("long"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), added_ids=True)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align.align(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *align.COUNTS, F.coalesce(F.sha2("groups", 256), F.lit("")).alias("groups_sha256"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["base"])
    return found.select("doc_id", *(pii.count_of(F.col("spans"), k).alias(f"n_{k}") for k in pii.KINDS), F.sha2(pii.digest(base), 256).alias("base_sha256"), pii.digest(F.col("spans")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality, op2_jaccard_join, op3_token_counts, op4_neighbours, op5_warc, op6_toxicity, op7_bpe, op8_fingerprints, op9_main_text, op10_packing, op11_alignment, op12_divergence, op13_personal_data)
}

ORACLE_SQL = {
    "op2_jaccard_join": """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 OR w IS NULL THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words),
classes AS (SELECT min(doc_id) AS rep, count(*) AS n_equal, list_sort(s) AS s FROM sets GROUP BY list_sort(s)),
terms AS (SELECT rep, len(s) AS n, unnest(s) AS t FROM classes),
links AS (
  SELECT a.rep AS a, b.rep AS b FROM terms a JOIN terms b ON a.t = b.t AND a.rep <> b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT rep, rep AS other FROM classes UNION SELECT r.rep, l.b FROM reach r JOIN links l ON r.other = l.a),
low AS (SELECT rep, min(other) AS component_id FROM reach GROUP BY rep)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE low.component_id END AS component_id,
  CASE WHEN len(s.s) = 0 THEN 1 ELSE c.n_equal END AS n_equal
FROM sets s JOIN classes c ON list_sort(s.s) = c.s JOIN low ON low.rep = c.rep""",
    "op5_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS h, min(page_id) OVER (PARTITION BY sha1(b)) AS first_id FROM p),
bits AS (
  SELECT *, array_to_string(list_transform(range(1, 41), lambda i:
    substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * strpos('0123456789abcdef', substr(h, i, 1)) - 3, 4)), '') AS z FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(1, 160, 5), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * CAST(substr(z, i, 1) AS INT) + 8 * CAST(substr(z, i + 1, 1) AS INT) + 4 * CAST(substr(z, i + 2, 1) AS INT) + 2 * CAST(substr(z, i + 3, 1) AS INT) + CAST(substr(z, i + 4, 1) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM bits""",
    "op12_divergence": """
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
occ AS (SELECT id, lang, source, unnest(w) AS t FROM d),
kept AS (SELECT lang, t FROM occ GROUP BY lang, t HAVING count(DISTINCT id) >= 3),
c AS (SELECT lang, source, t, count(*) AS n FROM occ JOIN kept USING (lang, t) GROUP BY lang, source, t),
groups AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
totals AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM groups g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
whole AS (SELECT lang, t, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS total FROM c GROUP BY lang, t),
p AS (
  SELECT k.lang, o.source, k.t, coalesce(c.n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * CAST(coalesce(c.n, 0) + 1 AS HUGEINT) // CAST(o.n + v.v AS HUGEINT) AS p,
    1 + CAST(1000000000 AS HUGEINT) * CAST(w.n + 1 AS HUGEINT) // CAST(w.total + v.v AS HUGEINT) AS q
  FROM kept k JOIN totals o USING (lang) JOIN v USING (lang) JOIN whole w ON w.lang = k.lang AND w.t = k.t LEFT JOIN c ON c.lang = k.lang AND c.source = o.source AND c.t = k.t),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
marks AS (SELECT lang, source, t AS item, (p - q) * (p - q) // q AS value, row_number() OVER (PARTITION BY lang, source ORDER BY (p - q) * (p - q) // q DESC, t) AS rank FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM pairs
UNION ALL SELECT lang, source, 'term', item, CAST(value AS BIGINT), CAST(rank AS INT) FROM marks WHERE rank <= 200""",
}
