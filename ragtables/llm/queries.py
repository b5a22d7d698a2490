"""Registered queries of the training-data operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragtables.llm import conversation_repair, decontaminate, html_text, language_id, near_dup, phrase_mining, piece_codec, quality_model, quality_rules, suffix_dedup, url_rules, vector_near_dup, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels: the number in a url's path is the doc_id of the document that the page shows."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    _, path = url_rules.host_and_path(F.col("url"))
    shown = pages.select("page_id", F.regexp_extract(path, r"/(\d{1,18})", 1).try_cast("long").alias("doc_id"))
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), True).when(F.col("quality") == 1, False)
    return url_rules.url_verdicts(pages, shown.join(labels, "doc_id").select("page_id", bad.alias("blocked")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = piece_codec.encode(table(spark, sf_dir, "documents"))
    return coded.select("doc_id", F.size("ids").alias("n_tokens"), "ids", "exact")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repaired(table(spark, sf_dir, "conversations"))


def op12_vector_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_near_dup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_model": op1_quality_model,
    "op2_quality_rules": op2_quality_rules,
    "op3_url_rules": op3_url_rules,
    "op4_language_id": op4_language_id,
    "op5_decontaminate": op5_decontaminate,
    "op6_piece_codec": op6_piece_codec,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_warc": op8_warc,
    "op9_near_dup": op9_near_dup,
    "op10_html_text": op10_html_text,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_vector_near_dup": op12_vector_near_dup,
    "op13_phrase_mining": op13_phrase_mining,
}
OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
o AS (SELECT payload_digest, max(page_id) AS original FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN d.page_id < o.original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN d.page_id < o.original THEN o.original END AS refers_to
FROM d LEFT JOIN o USING (payload_digest)
"""
OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
phrases AS (
  SELECT lang, size, unnest([array_to_string(ws[i:i + size - 1], ' ') for i in range(1, len(ws) - size + 2)]) AS phrase
  FROM worded, (SELECT unnest([1, 2, 3, 4]) AS size)),
f AS (SELECT lang, size, phrase, count(*) AS n FROM phrases GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND n >= 30),
cuts AS (
  SELECT c.lang, c.size, c.phrase, c.a, k, array_to_string(ws[1:k], ' ') AS x, array_to_string(ws[k + 1:], ' ') AS y
  FROM candidates c, (SELECT unnest([1, 2, 3]) AS k) WHERE k < c.size),
scores AS (
  SELECT cuts.lang, cuts.size, cuts.phrase, a, k, p.n AS l, q.n AS r,
         CAST((2000000::HUGEINT * a) // (p.n::HUGEINT + q.n::HUGEINT) AS BIGINT) AS score
  FROM cuts JOIN f p ON p.lang = cuts.lang AND p.phrase = x AND p.size = k JOIN f q ON q.lang = cuts.lang AND q.phrase = y AND q.size = cuts.size - k),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, size, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, a, unnest(CASE size WHEN 3 THEN [array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]
    WHEN 4 THEN [array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' '), array_to_string(ws[3:4], ' '),
                 array_to_string(ws[1:3], ' '), array_to_string(ws[2:4], ' ')] END) AS phrase
  FROM candidates WHERE size > 2),
covers AS (SELECT lang, phrase, max(a) AS cover FROM inside GROUP BY ALL),
kept AS (
  SELECT best.* FROM best LEFT JOIN covers USING (lang, phrase)
  WHERE cover IS NULL OR 100::HUGEINT * cover < 80::HUGEINT * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, totals.n AS n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
ORACLES: dict[str, str] = {"op8_warc": OP8_SQL, "op13_phrase_mining": OP13_SQL}
