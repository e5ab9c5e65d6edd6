"""Portable query bodies: scans, tokenisers, lexicon, language, punctuation, link and span operators."""

from __future__ import annotations

from lectern.functions import vocabulary as v

_quote = lambda words: ", ".join(f"'{w}'" for w in words)
_alt = lambda words: "|".join(w.replace(" ", "[ \\n]") for w in sorted(words, key=lambda w: (-len(w), w)))
_EDGE = r"(?:^|[^\p{L}\p{N}_])"
_rows = lambda pairs: " UNION ALL ".join(f"SELECT '{a}' AS {k}, '{b}' AS {l}" for k, l, a, b in pairs)
_POS = _rows([("word", "tag", w, t) for t, ws in v.POS.items() for w in ws if w not in {x for o, xs in list(v.POS.items())[: list(v.POS).index(t)] for x in xs}])
# A text with every fault of the white-space rules, made alike in both engines.
_MESSY = "replace(replace(text, '. ', '.  '), ', ', concat(' ,', chr(9)))"


BODIES = {
    "doc_scan": "SELECT doc_id, lang, source, CAST(length(text) AS BIGINT) AS n FROM documents",
    "line_explode": "SELECT doc_id, line_no, CAST(length(line) AS BIGINT) AS n, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - length(line) - 1 AS BIGINT) AS start_pos FROM lines",
    "line_range_scan": "SELECT doc_id, line_no, line FROM lines WHERE line_no BETWEEN 1 AND 3",
    "sentence_split": "SELECT doc_id, CAST(count(*) AS BIGINT) AS n_sentences, CAST(max(length(sentence)) AS BIGINT) AS longest FROM sentences GROUP BY doc_id",
    "word_tokenize": "SELECT doc_id, CAST(count(*) AS BIGINT) AS n_words, CAST(count(DISTINCT word) AS BIGINT) AS n_distinct FROM words GROUP BY doc_id",
    "word_count_lexicon": "SELECT lower(word) AS word, CAST(count(*) AS BIGINT) AS n FROM words WHERE length(word) >= 2 GROUP BY lower(word)",
    "lexicon_topk": "SELECT word, n FROM (SELECT lower(word) AS word, CAST(count(*) AS BIGINT) AS n FROM words WHERE length(word) >= 2 GROUP BY lower(word)) q ORDER BY n DESC, word LIMIT 100",
    "lexicon_compare": "WITH lx AS (SELECT DISTINCT d.lang, lower(w.word) AS word FROM words w JOIN (SELECT doc_id, lang FROM documents) d ON w.doc_id = d.doc_id WHERE d.lang IN ('en', 'de')), counted AS (SELECT word, min(lang) AS lang, count(*) AS c FROM lx GROUP BY word) SELECT word, CASE lang WHEN 'en' THEN '-' ELSE '+' END AS side FROM counted WHERE c = 1",
    "new_word": "WITH own AS (SELECT doc_id, lower(word) AS word, min(sent_ix) AS first_sent, count(*) AS n FROM words WHERE length(word) >= 2 GROUP BY doc_id, lower(word)), lexicon AS (SELECT lower(word) AS word FROM bench_words GROUP BY lower(word)) SELECT own.doc_id, own.word, CAST(own.first_sent AS BIGINT) AS first_sent, 'W' AS severity, concat('new word: ', own.word) AS message FROM own LEFT JOIN lexicon ON own.word = lexicon.word WHERE lexicon.word IS NULL",
    "rare_word": "SELECT lower(word) AS word, CAST(count(*) AS BIGINT) AS n, 'I' AS severity FROM words WHERE length(word) >= 2 GROUP BY lower(word) HAVING count(*) <= 3",
    "proper_noun": "WITH c AS (SELECT lower(word) AS word, sum(CASE WHEN substr(word, 1, 1) <> lower(substr(word, 1, 1)) THEN 1 ELSE 0 END) AS up, count(*) AS n FROM words WHERE word_ix > 0 GROUP BY lower(word)) SELECT w.doc_id, w.sent_ix, w.word_ix, w.word FROM words w JOIN c ON c.word = w.word WHERE c.up < c.n AND 10 * c.up >= 8 * c.n",
    "pos_tag_counts": f"WITH pos AS ({_POS}) SELECT tag, CAST(count(*) AS BIGINT) AS n FROM words w JOIN pos ON lower(w.word) = pos.word GROUP BY tag",
    "pos_case": f"WITH pos AS ({_POS}) SELECT w.doc_id, w.sent_ix, w.word_ix, w.word, pos.tag FROM words w JOIN pos ON lower(w.word) = pos.word WHERE w.word_ix > 0 AND w.word <> lower(w.word)",
    "metric_long_sentence": "SELECT doc_id, sent_ix, CAST(count(*) AS BIGINT) AS n_words, 'I' AS severity FROM words GROUP BY doc_id, sent_ix HAVING count(*) > 25",
    "metric_long_word": "SELECT doc_id, sent_ix, word_ix, word, CAST(length(word) AS BIGINT) AS n FROM words WHERE length(word) >= 15",
    "metric_long_paragraph": r"SELECT doc_id, para_ix, n FROM (SELECT doc_id, para_ix, #count(para ~ [!.?]+(?:[ \n]|\z))# AS n FROM paragraphs) q WHERE n > 5",
    "metric_short_paragraph_runs": r"WITH p AS (SELECT doc_id, para_ix, CASE WHEN #count(para ~ [!.?]+(?:[ \n]|\z))# <= 2 THEN 1 ELSE 0 END AS short FROM paragraphs), g AS (SELECT doc_id, para_ix, short, row_number() OVER (PARTITION BY doc_id ORDER BY para_ix) - row_number() OVER (PARTITION BY doc_id, short ORDER BY para_ix) AS grp FROM p) SELECT doc_id, CAST(min(para_ix) AS BIGINT) AS first_para, CAST(count(*) AS BIGINT) AS n FROM g WHERE short = 1 GROUP BY doc_id, grp HAVING count(*) >= 2",
    "metric_long_heading": "SELECT page_id, title, n FROM (SELECT page_id, title, CAST(length(title) AS BIGINT) AS n FROM (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN concat(title, ' ', title) ELSE title END AS title FROM titles) r) q WHERE n > 69",
    "list_search": f"SELECT doc_id, n, 'I' AS severity FROM (SELECT doc_id, #count(lower(text) ~ {_EDGE}(?:{_alt(v.VAGUE)})[ .,;:!?\\n])# AS n FROM documents) q WHERE n > 0",
    "simplify_terms": f"WITH t AS ({_rows([('term', 'suggestion', k, s) for k, s in v.SIMPLER.items() if ' ' not in k])}) SELECT w.doc_id, w.sent_ix, w.word_ix, t.term, t.suggestion FROM words w JOIN t ON lower(w.word) = t.term",
    "char_categories": r"WITH k AS (SELECT CASE WHEN #has(ch ~ ^\p{Lu}$)# THEN 'upper' WHEN #has(ch ~ ^\p{Ll}$)# THEN 'lower' WHEN #has(ch ~ ^[0-9]$)# THEN 'digit' WHEN ch IN (' ', chr(10), chr(9)) THEN 'space' WHEN #has(ch ~ ^[!-~]$)# THEN 'mark' ELSE 'other' END AS category FROM chars) SELECT category, CAST(count(*) AS BIGINT) AS n FROM k GROUP BY category",
    "eof": r"SELECT doc_id, CASE WHEN #has(text ~ \n\n+\z)# THEN 'extra blank lines' WHEN #has(text ~ \n[ ]+\z)# THEN 'spaces' ELSE 'no newline' END AS message, 'W' AS severity FROM documents WHERE NOT #has(text ~ [^\n]\n\z)#",
    "whitespace_rules": " UNION ALL ".join(f"SELECT doc_id, '{k}' AS rule, n FROM (SELECT doc_id, #count({_MESSY} ~ {p})# AS n FROM documents) q{i} WHERE n > 0" for i, (k, p) in enumerate({"tab": r"\t", "multispace": r"[^ \n][ ]{2,}", "spaceeol": r"[ ]+\n"}.items())),
    "whitespace_fix": f"SELECT doc_id, md5(#replace(#replace({_MESSY} ~ \\t ~    )# ~ [ ]{{2,}} ~  )#) AS fixed FROM documents",
    "long_line": "SELECT doc_id, line_no, CAST(length(line) AS BIGINT) AS n, 'W' AS severity FROM lines WHERE length(line) >= 118",
    "bracket_balance": r"SELECT doc_id, o1 - c1 AS round, o2 - c2 AS square, o3 - c3 AS curly FROM (SELECT doc_id, #count(text ~ [(])# AS o1, #count(text ~ [)])# AS c1, #count(text ~ \[)# AS o2, #count(text ~ \])# AS c2, #count(text ~ [{])# AS o3, #count(text ~ [}])# AS c3 FROM (SELECT doc_id, concat(text, CASE doc_id % 4 WHEN 0 THEN ' (a]' WHEN 1 THEN ' {b' WHEN 2 THEN ' [c]' ELSE ' d)' END) AS text FROM documents) p) q WHERE o1 <> c1 OR o2 <> c2 OR o3 <> c3",
    "start_case": r"SELECT doc_id, para_ix, 'W' AS severity FROM paragraphs WHERE #has(para ~ ^[ ]*\p{Ll})#",
    "duplicate_content": "WITH h AS (SELECT doc_id, md5(text) AS digest, length(text) AS n FROM documents), f AS (SELECT digest, n, min(doc_id) AS first_doc, count(*) AS c FROM h GROUP BY digest, n HAVING count(*) > 1) SELECT h.doc_id, f.first_doc, CAST(f.c AS BIGINT) AS n_copies FROM h JOIN f ON h.digest = f.digest AND h.n = f.n WHERE h.doc_id <> f.first_doc",
    "filename_collision": r"WITH u AS (SELECT page_id, #replace(#replace(url ~ [?\x23].*$ ~ )# ~ ^.*/ ~ )# AS name FROM pages), g AS (SELECT lower(name) AS low, count(*) AS n FROM u GROUP BY lower(name) HAVING count(*) > 1) SELECT u.page_id, u.name, CAST(g.n AS BIGINT) AS n FROM u JOIN g ON lower(u.name) = g.low",
    "filename_rules": r"SELECT page_id, CASE WHEN #has(name ~ [A-Z])# THEN 'I' ELSE 'E' END AS severity, name FROM (SELECT page_id, concat(CASE page_id % 5 WHEN 0 THEN 'Big' WHEN 1 THEN 'a b' ELSE '' END, #replace(#replace(url ~ [?\x23].*$ ~ )# ~ ^.*/ ~ )#) AS name FROM pages) q WHERE #has(name ~ [^a-z0-9_.\-])#",
    "unused_target": "WITH t AS (SELECT DISTINCT lower(title) AS label FROM titles), r AS (SELECT DISTINCT lower(replace(link, '/', '')) AS label FROM links) SELECT t.label, 'W' AS severity FROM t LEFT JOIN r ON t.label = r.label WHERE r.label IS NULL",
    "local_target": "SELECT link, CAST(min(page_id) AS BIGINT) AS page_id FROM (SELECT page_id, CASE WHEN page_id % 9 = 0 THEN concat(link, '#', CAST(page_id AS STRING)) ELSE link END AS link FROM links) q GROUP BY link HAVING min(page_id) = max(page_id)",
    "heading_caps": r"SELECT page_id, title, #count(title ~ [ ]\p{Ll}[\p{L}]{3,})# AS n_lower FROM titles",
    "changed_span_filter": "WITH ch AS (SELECT doc_id, min(line_no) AS a, min(line_no) + 2 AS b FROM lines WHERE line_no % 7 = 3 GROUP BY doc_id) SELECT l.doc_id, l.line_no, CAST(length(l.line) AS BIGINT) AS n FROM lines l JOIN ch ON l.doc_id = ch.doc_id WHERE l.line_no BETWEEN ch.a AND ch.b AND length(l.line) >= 118",
    "span_merge": "WITH s AS (SELECT doc_id, line_no AS a, line_no + 1 AS b FROM lines WHERE length(line) >= 80), g AS (SELECT doc_id, a, b, sum(CASE WHEN a = prev THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY a) AS grp FROM (SELECT doc_id, a, b, lag(b) OVER (PARTITION BY doc_id ORDER BY a) AS prev FROM s) q) SELECT doc_id, CAST(min(a) AS BIGINT) AS a, CAST(max(b) AS BIGINT) AS b FROM g GROUP BY doc_id, grp",
    "span_gaps": "WITH s AS (SELECT doc_id, line_no AS a, line_no + 1 AS b FROM lines WHERE length(line) >= 80) SELECT doc_id, prev AS a, a AS b FROM (SELECT doc_id, a, lag(b) OVER (PARTITION BY doc_id ORDER BY a) AS prev FROM s) q WHERE a > prev",
    "span_overlap": "WITH s AS (SELECT doc_id, line_no AS a, line_no + 1 + length(line) % 3 AS b FROM lines), n AS (SELECT doc_id, a, b, lead(a, 1) OVER (PARTITION BY doc_id ORDER BY a) AS n1, lead(a, 2) OVER (PARTITION BY doc_id ORDER BY a) AS n2 FROM s) SELECT doc_id, a AS a1, n1 AS a2 FROM n WHERE n1 < b UNION ALL SELECT doc_id, a AS a1, n2 AS a2 FROM n WHERE n2 < b",
    "severity_summary": "WITH r AS (SELECT 'W' AS severity FROM lines WHERE length(line) >= 118 UNION ALL SELECT 'I' AS severity FROM words WHERE length(word) >= 15) SELECT coalesce(severity, 'total') AS severity, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY ROLLUP (severity)",
    "report_rollup": "WITH r AS (SELECT 'long-line' AS tool, 'W' AS severity FROM lines WHERE length(line) >= 118 UNION ALL SELECT 'metric' AS tool, 'I' AS severity FROM words WHERE length(word) >= 15) SELECT coalesce(tool, 'all') AS tool, coalesce(severity, 'all') AS severity, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY ROLLUP (tool, severity)",
    "monitor_paths": "SELECT DISTINCT page_id, url, 'I' AS severity FROM pages WHERE url LIKE 'http://%' OR url LIKE '%/en/%'",
    "findings_by_quality": "WITH f AS (SELECT doc_id, count(*) AS n FROM lines WHERE length(line) >= 118 GROUP BY doc_id) SELECT l.quality, l.toxic, CAST(count(*) AS BIGINT) AS docs, CAST(sum(coalesce(f.n, 0)) AS BIGINT) AS findings FROM (SELECT doc_id, quality, toxic FROM labels) l LEFT JOIN f ON l.doc_id = f.doc_id GROUP BY l.quality, l.toxic",
    "conversation_state": "SELECT conv_id, turn, role, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS chars_so_far FROM conversations",
}
