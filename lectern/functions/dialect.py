"""Relations over text as common table expressions, for Spark and for DuckDB.

A query is one portable body over these relations; the Spark text runs here, the DuckDB text is its oracle.
Patterns avoid ``\\b``, ``\\w`` and lookaround, whose meaning differs between regex engines.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

WORD = r"[\p{L}\p{N}_]+(?:[\x27\x{2019}\-][\p{L}\p{N}_]+)*"
SENTENCE_END = r"[!.?]+[ \n]+"
_TABLES = ("documents", "pages", "conversations", "benchmark", "labels")

#: The tables have no blank lines: here a line that ends in a full stop is followed by one, empty or of spaces.
SPACED = "replace(text, concat('.', chr(10)), concat('.', chr(10), CASE WHEN doc_id % 2 = 0 THEN '  ' ELSE '' END, chr(10)))"

_SPARK = {
    "lines": "SELECT doc_id, CAST(i AS BIGINT) AS line_no, line FROM documents LATERAL VIEW posexplode(split(text, r'\\n', -1)) t AS i, line",
    "sentences": f"SELECT doc_id, CAST(i AS BIGINT) AS sent_ix, sentence FROM documents LATERAL VIEW posexplode(split(text, r'{SENTENCE_END}', -1)) t AS i, sentence",
    "words": f"SELECT doc_id, sent_ix, CAST(i AS BIGINT) AS word_ix, word FROM sentences LATERAL VIEW posexplode(regexp_extract_all(sentence, r'{WORD}', 0)) t AS i, word",
    "paragraphs": "SELECT doc_id, CAST(i AS BIGINT) AS para_ix, para FROM spaced LATERAL VIEW posexplode(split(text, r'\\n[ \\t]*\\n', -1)) t AS i, para",
    "spaced": f"SELECT doc_id, {SPACED} AS text FROM documents",
    "chars": "SELECT doc_id, c AS ch FROM documents LATERAL VIEW explode(split(text, '')) t AS c WHERE c <> ''",
    "links": "SELECT page_id, url, link FROM pages LATERAL VIEW explode(regexp_extract_all(html, r'href=\"([^\"]*)\"', 1)) t AS link",
    "titles": "SELECT page_id, url, title FROM pages LATERAL VIEW explode(regexp_extract_all(html, r'<h1>([^<]*)</h1>', 1)) t AS title",
    "bench_words": f"SELECT item_id, word FROM benchmark LATERAL VIEW explode(regexp_extract_all(text, r'{WORD}', 0)) t AS word",
}
_DUCK = {
    "lines": "SELECT doc_id, unnest(range(len(x))) AS line_no, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)",
    "sentences": f"SELECT doc_id, unnest(range(len(x))) AS sent_ix, unnest(x) AS sentence FROM (SELECT doc_id, string_split_regex(text, '{SENTENCE_END}') AS x FROM documents)",
    "words": f"SELECT doc_id, sent_ix, unnest(range(len(x))) AS word_ix, unnest(x) AS word FROM (SELECT doc_id, sent_ix, regexp_extract_all(sentence, '{WORD}') AS x FROM sentences)",
    "paragraphs": "SELECT doc_id, unnest(range(len(x))) AS para_ix, unnest(x) AS para FROM (SELECT doc_id, string_split_regex(text, '\\n[ \\t]*\\n') AS x FROM spaced)",
    "spaced": f"SELECT doc_id, {SPACED} AS text FROM documents",
    "chars": "SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents WHERE text <> ''",
    "links": "SELECT page_id, url, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages",
    "titles": "SELECT page_id, url, unnest(regexp_extract_all(html, '<h1>([^<]*)</h1>', 1)) AS title FROM pages",
    "bench_words": f"SELECT item_id, unnest(regexp_extract_all(text, '{WORD}')) AS word FROM benchmark",
}
_NEEDS = {"words": ("sentences",), "paragraphs": ("spaced",)}


def _with(body: str, relations: dict[str, str]) -> str:
    """Prefix the body with the relations it names, and those they need."""
    used = [r for r in relations if re.search(rf"\b{r}\b", body)]
    used = list(dict.fromkeys(x for r in used for x in (*_NEEDS.get(r, ()), r)))
    ctes = [f"{r} AS ({relations[r]})" for r in used]
    inner = re.match(r"\s*WITH\s", body)
    head = "WITH " + ", ".join(ctes) + (", " if ctes and inner else " ") if ctes else ""
    return head + (body[inner.end() :] if inner and ctes else body)


def matches(column: str, pattern: str, spark: bool) -> str:
    """Number of matches of a pattern."""
    return f"CAST(size(regexp_extract_all({column}, r'{pattern}', 0)) AS BIGINT)" if spark else f"CAST(len(regexp_extract_all({column}, '{pattern}')) AS BIGINT)"


def _expand(body: str, spark: bool) -> str:
    """``#count(column, pattern)#``, ``#has(..)#`` and ``#replace(column, pattern, by)#`` in the engine's own words."""

    def one(m: re.Match) -> str:
        name, column, *rest = m[1], *m[2].split(" ~ ")
        if name == "count":
            return matches(column, rest[0], spark)
        if name == "has":
            return f"({column} RLIKE r'{rest[0]}')" if spark else f"regexp_matches({column}, '{rest[0]}')"
        by = rest[1]
        return f"regexp_replace({column}, r'{rest[0]}', '{by}')" if spark else f"regexp_replace({column}, '{rest[0]}', '{by}', 'g')"

    # Innermost first; patterns write a number sign as \\x23.
    while (new := re.sub(r"#(count|has|replace)\(([^#]*?)\)#", one, body)) != body:
        body = new
    return body


def duck_sql(body: str) -> str:
    return _with(_expand(body, spark=False), _DUCK)


def spark_frame(spark: SparkSession, sf_dir: str, body: str) -> DataFrame:
    text = _with(_expand(body, spark=True), _SPARK)
    used = [t for t in _TABLES if re.search(rf"\b{t}\b", text)]
    # Table names become references to the frames given along.
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    text = re.sub(r"\{(?!(" + "|".join(_TABLES) + r")\})", "{{", text)
    text = re.sub(r"(?<!\{documents)(?<!\{pages)(?<!\{conversations)(?<!\{benchmark)(?<!\{labels)\}", "}}", text)
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})
