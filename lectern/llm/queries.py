"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from lectern.llm import chat, decontaminate, jaccard, linededup, mixing, quality, secrets, sharding, tokencounts, warc

QUERIES = {
    "op1_warc_salvage": warc.op1_warc_salvage,
    "op2_ngram_jaccard": jaccard.op2_ngram_jaccard,
    "op3_secret_scans": secrets.op3_secret_scans,
    "op4_token_counts": tokencounts.op4_token_counts,
    "op5_line_dedup": linededup.op5_line_dedup,
    "op6_mixing": mixing.op6_mixing,
    "op7_chat_formatting": chat.op7_chat_formatting,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_sharding": sharding.op9_sharding,
    "op10_quality_rules": quality.op10_quality_rules,
}

_OP2 = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i : i + 4], ' ') FOR i IN range(1, len(ws) - 3)]) END) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
e AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * ((SELECT n FROM n WHERE n.doc_id = a.doc_id) + (SELECT n FROM n WHERE n.doc_id = b.doc_id) - count(*))
), both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, b.y FROM r JOIN both_ways b ON r.c = b.x
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""

ORACLES = {"op1_warc_salvage": warc.ORACLE, "op2_ngram_jaccard": _OP2, "op3_secret_scans": secrets.ORACLE, "op7_chat_formatting": chat.ORACLE, "op8_decontamination": decontaminate.ORACLE}
