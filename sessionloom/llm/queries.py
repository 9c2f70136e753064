"""The queries of this subpackage, and the SQL that those which SQL can express must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sessionloom.llm import archives, contamination, fuzzy, language, lexical, lines, nearest, pieces, private, spots, tokenfiles, toxicity, variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": contamination.op1_decontaminate,
    "op2_line_dedup": lines.op2_line_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_simhash": fuzzy.op4_simhash,
    "op5_tokenfiles": tokenfiles.op5_tokenfiles,
    "op6_pieces": pieces.op6_pieces,
    "op7_archives": archives.op7_archives,
    "op8_language": language.op8_language,
    "op9_private": private.op9_private,
    "op10_nearest": nearest.op10_nearest,
    "op11_spots": spots.op11_spots,
    "op12_variants": variants.op12_variants,
    "op13_lexical": lexical.op13_lexical,
}

ORACLES: dict[str, str] = {
    "op2_line_dedup": """
WITH line AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    unnest(lines) WITH ORDINALITY AS u(line, i)
), held AS (
  SELECT key, count(DISTINCT doc_id) AS n, max(doc_id) AS last FROM line WHERE length(key) >= 20 GROUP BY key
), marked AS (
  SELECT doc_id, i, line, coalesce(n >= 3 AND doc_id < last, false) AS gone FROM line LEFT JOIN held USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op7_archives": """
WITH page AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), seen AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM page
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM seen""",
    "op13_lexical": r"""
WITH word AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), held AS (
  SELECT doc_id, term, count(*) AS tf FROM word GROUP BY doc_id, term
), doc AS (
  SELECT doc_id, sum(tf)::BIGINT AS n FROM held GROUP BY doc_id
), total AS (
  SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM doc
), asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), item AS (
  SELECT item_id, term, count(*) AS times FROM asked GROUP BY item_id, term
), weight AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM held, total GROUP BY term
), scored AS (
  SELECT item_id, doc_id,
    sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words))))::BIGINT AS score
  FROM item JOIN weight USING (term) JOIN held USING (term) JOIN doc USING (doc_id), total GROUP BY item_id, doc_id
), placed AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 20""",
}
