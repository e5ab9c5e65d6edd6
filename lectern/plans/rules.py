"""Queries of the pattern, list and sentence rules, each with an oracle written for the other engine in another way."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import termlists
from lectern.functions import vocabulary as v
from lectern.functions.dialect import duck_sql
from lectern.operators import findings, sentences, terms
from lectern.session import table


def _docs(spark: SparkSession, sf_dir: str, text: str = "text") -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(text).alias("text"))


def _found(spark: SparkSession, sf_dir: str, tool: str) -> DataFrame:
    severity, rules = findings.TOOLS[tool]
    return findings.find(_docs(spark, sf_dir, findings.faulty(tool)), tool, rules, severity)


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all pattern tools by tool and severity, with subtotals: every tool scans the texts once and only counts."""
    parts = [findings.count(_docs(spark, sf_dir, findings.faulty(t)), t, rules, severity) for t, (severity, rules) in findings.TOOLS.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.rollup("tool", "severity").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.coalesce("tool", F.lit("all")).alias("tool"), F.coalesce("severity", F.lit("all")).alias("severity"), "n")


# Lists: a term of the list follows each text, in turn.
_LISTS = {"avoid": [t for own in termlists.AVOID.values() for t in own], "dev": [t for own in termlists.DEV.values() for t in own], "simplify": [t for t, _ in termlists.SIMPLIFY]}


def _with_term(name: str) -> str:
    own = _LISTS[name]
    return f"concat(text, CASE doc_id % {len(own)} " + " ".join(f"WHEN {i} THEN ' Also {t.upper() if i % 3 == 0 else t}.'" for i, t in enumerate(own)) + " END)"


def _listed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    own = {"simplify": termlists.SIMPLIFY}.get(name, _LISTS[name])
    return terms.search(_docs(spark, sf_dir, _with_term(name)), terms.compile_terms(own, message="" if name == "simplify" else name)).groupBy("doc_id", F.lower("output").alias("term"), "message").agg(F.count("*").alias("n"))


def _list_oracle(name: str) -> str:
    """Terms between characters that are no part of a word, longest first where two begin alike."""
    own = termlists.SIMPLIFY if name == "simplify" else [[t, name] for t in _LISTS[name]]
    told: dict[str, list[str]] = {}
    for t, m in own:
        told.setdefault("/".join([m] if isinstance(m, str) else m), []).append(t)
    one = lambda m, ts: f"SELECT doc_id, unnest(regexp_extract_all(t, '\\b({'|'.join(x.lower().replace(' ', chr(92) + 's+') for x in ts)})\\b')) AS output, '{m}' AS message FROM d"
    return f"WITH d AS (SELECT doc_id, lower({_with_term(name)}) AS t FROM documents), h AS ({' UNION ALL '.join(one(m, ts) for m, ts in told.items())}) SELECT doc_id, output AS term, message, count(*) AS n FROM h GROUP BY ALL"


_SEQUENCES = ("of the", "in a", "to be", "that the", "and the in")


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.search_tokens(_docs(spark, sf_dir), terms.compile_terms(list(_SEQUENCES), "T", "token")).select("doc_id", F.col("word_ix").cast("long").alias("word_ix"), "output")


_ALL_WORDS = "w AS (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY sent_ix, word_ix) - 1 AS ix FROM words)"
_NEXT = "nx AS (SELECT doc_id, sent_ix, word_ix, lower(word) AS a, lead(word) OVER (PARTITION BY doc_id, sent_ix ORDER BY word_ix) AS b FROM words)"
_any = lambda words: "|".join(words)
_in = lambda words: ", ".join(f"'{w}'" for w in words)
_WANTED = f"CASE WHEN regexp_matches(b, '^([A-Z]|[A-Z][A-Z]+s?)$') THEN (CASE WHEN regexp_matches(b, '^[{v.LETTERS_AN}]') THEN 'an' ELSE 'a' END) WHEN regexp_matches(lower(b), '^({_any(v.AN_LONGER)})') THEN 'an' WHEN regexp_matches(lower(b), '^({_any(v.A_BEFORE_VOWEL)})') THEN 'a' WHEN regexp_matches(lower(b), '^({_any(v.AN_BEFORE_CONSONANT)})') THEN 'an' WHEN lower(b)[1] IN ('a', 'e', 'i', 'o', 'u') THEN 'an' ELSE 'a' END"
# Word pairs written with and without a hyphen, by document.
_JOINED = "replace(replace(text, ' of the ', CASE WHEN doc_id % 3 = 0 THEN ' of-the ' WHEN doc_id % 3 = 1 THEN ' ofthe ' ELSE ' of the ' END), ' and ', CASE WHEN doc_id % 50 = 0 THEN ' and-or ' ELSE ' and ' END)"
# Page names made of words of the heading, for two pages in three.
_NAMED = "concat('http://x.org/', CASE page_id % 3 WHEN 0 THEN lower(replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), ' ', '-')) WHEN 1 THEN concat(lower(split_part(regexp_extract(html, '<h1>([^<]*)</h1>', 1), ' ', 1)), '_page') ELSE 'other' END, '.html?x=1')"

QUERIES = {f"{t}_rules": partial(_found, tool=t) for t in findings.TOOLS if t != "char"} | {"char_search": partial(_found, tool="char"), "report_by_tool": _summary} | {f"list_{n}": partial(_listed, name=n) for n in _LISTS} | {
    "list_search_tokens": _tokens,
    "article": lambda spark, sf: sentences.article(_docs(spark, sf)),
    "passive": lambda spark, sf: sentences.passive(_docs(spark, sf)),
    "overuse_simple": lambda spark, sf: sentences.overuse_simple(_docs(spark, sf)),
    "hyphen_variants": lambda spark, sf: sentences.hyphen_variants(_docs(spark, sf, _JOINED)),
    "page_name": lambda spark, sf: sentences.page_name(table(spark, sf, "pages").select("page_id", F.expr(_NAMED).alias("url"), "html")),
}
ORACLES = {f"{t}_rules": findings.oracle(t) for t in findings.TOOLS if t != "char"} | {"char_search": findings.oracle("char")} | {f"list_{n}": _list_oracle(n) for n in _LISTS} | {
    "report_by_tool": "WITH f AS (" + " UNION ALL ".join(f"SELECT tool, severity FROM ({findings.oracle(t)})" for t in findings.TOOLS) + ") SELECT coalesce(tool, 'all') AS tool, coalesce(severity, 'all') AS severity, count(*) AS n FROM f GROUP BY ROLLUP (tool, severity)",
    "list_search_tokens": duck_sql(f"WITH {_ALL_WORDS}, s AS (SELECT doc_id, ix, lower(word) AS a, lower(lead(word, 1) OVER (PARTITION BY doc_id ORDER BY ix)) AS b, lower(lead(word, 2) OVER (PARTITION BY doc_id ORDER BY ix)) AS c FROM w) SELECT doc_id, ix AS word_ix, concat(a, ' ', b) AS output FROM s WHERE concat(a, ' ', b) IN ({_in(x for x in _SEQUENCES if x.count(' ') == 1)}) UNION ALL SELECT doc_id, ix, concat(a, ' ', b, ' ', c) FROM s WHERE concat(a, ' ', b, ' ', c) IN ({_in(x for x in _SEQUENCES if x.count(' ') == 2)})"),
    "article": duck_sql(f"WITH {_NEXT} SELECT doc_id, sent_ix, word_ix, a AS art, b AS follower, 'E' AS severity FROM nx WHERE a IN ('a', 'an') AND b IS NOT NULL AND CASE WHEN regexp_matches(b, '^[0-9]') THEN a = 'an' ELSE a <> {_WANTED} END"),
    "passive": duck_sql(f"WITH {_NEXT} SELECT doc_id, sent_ix, word_ix, a AS verb, lower(b) AS participle, 'I' AS severity FROM nx WHERE a IN ({_in(v.BE)}) AND ((lower(b) LIKE '%ed' OR lower(b) LIKE '%en') AND lower(b) NOT IN ({_in(v.NO_PARTICIPLES)}) OR lower(b) IN ({_in(v.IRREGULAR)}))"),
    "overuse_simple": duck_sql("WITH o AS (SELECT doc_id, lower(word) AS word, row_number() OVER (PARTITION BY doc_id ORDER BY sent_ix, word_ix) AS ix FROM words), d AS (SELECT doc_id, word, ix - lag(ix) OVER (PARTITION BY doc_id, word ORDER BY ix) AS gap FROM o WHERE length(word) > 3), s AS (SELECT doc_id, word, CASE WHEN gap BETWEEN 6 AND 80 THEN 5625 - (gap - 5) * (gap - 5) ELSE 0 END AS score FROM d) SELECT doc_id, word, CAST(sum(score) AS BIGINT) AS score FROM s GROUP BY doc_id, word HAVING sum(score) > 11250"),
    "hyphen_variants": f"WITH l AS MATERIALIZED (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower({_JOINED}), '[\\p{{L}}\\p{{N}}_]+(?:[\\x27\\x{{2019}}\\-][\\p{{L}}\\p{{N}}_]+)*')) AS word FROM documents) GROUP BY word) SELECT h.word, h.n AS n_hyphen, CAST(coalesce(j.n, 0) AS BIGINT) AS n_joined, CASE WHEN h.n > 6 THEN replace(h.word, '-', ' ') END AS spaced FROM l h LEFT JOIN l j ON j.word = replace(h.word, '-', '') WHERE h.word LIKE '%-%' AND coalesce(j.n, 0) / (coalesce(j.n, 0) + h.n) < 0.55 AND coalesce(j.n, 0) + h.n / 2 > 3",
    "page_name": f"WITH p AS (SELECT page_id, {_NAMED} AS url, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS title FROM pages), n AS (SELECT page_id, title, lower(regexp_extract(string_split(string_split(url, '?')[1], '#')[1], '([^/.]+)([.][a-z]+)?/*$', 1)) AS name FROM p WHERE title <> ''), w AS (SELECT page_id, name, title, unnest(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}]+')) AS word FROM n), c AS (SELECT page_id, name, title, count(*) AS n_words, count(*) FILTER (word IN ('a', 'an', 'the') OR word IN (SELECT unnest(string_split_regex(name, '[-_]')))) AS n_shared, string_agg(word[1], '') AS initials FROM w GROUP BY ALL) SELECT page_id, name, title, n_words, n_shared, 'L' AS severity FROM c WHERE 2 * n_shared < n_words AND initials <> name",
}
