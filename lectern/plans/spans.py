"""Queries of the span operators, each with an oracle that looks at single characters or lines, and SQL over the text relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.dialect import duck_sql, spark_frame
from lectern.operators import spans
from lectern.session import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """SQL over the tables and the relations ``lines sentences words paragraphs chars links titles``, which are read only if named."""
    return spark_frame(spark, sf_dir, text)


def _full(docs: DataFrame) -> DataFrame:
    return docs.where("text <> ''").withColumn("n", F.length("text"))


def _even_lines(docs: DataFrame) -> DataFrame:
    """Spans of even lines with their line end."""
    rows = _full(docs).select("doc_id", "n", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    after = F.sum(F.length("line") + 1).over(Window.partitionBy("doc_id").orderBy("i"))
    rows = rows.select("doc_id", "n", "i", (after - F.length("line") - 1).alias("start"), after.alias("after"))
    return rows.where("i % 2 = 0").select("doc_id", "start", F.least("after", "n").alias("end"))


def _strips(docs: DataFrame) -> DataFrame:
    """In each hundred characters of a text the places 20 to 70."""
    rows = _full(docs).select("doc_id", "n", F.explode(F.expr("sequence(0, n, 100)")).alias("k"))
    return rows.select("doc_id", F.least(F.col("k") + 20, F.col("n")).alias("start"), F.least(F.col("k") + 70, F.col("n")).alias("end"))


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return spans.set_spans(_even_lines(docs), _strips(docs))


def _cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text cut at a place that its id chooses, every third time counted from the end."""
    start = F.expr("CASE WHEN doc_id % 3 = 0 THEN -40 ELSE doc_id % 50 END")
    p = spans.parts(F.col("text"), start, start + 17)
    return _docs(spark, sf_dir).select("doc_id", p.alias("p")).select("doc_id", F.md5("p.before").alias("before"), F.col("p.inside").alias("inside"), F.md5("p.after").alias("after"))


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line and column of a place in each text, and the place again from both."""
    pos = spans.absolute(F.col("text"), F.expr("doc_id * 7 % 1500"))
    rows = _docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", "text", pos.alias("pos"))
    rows = rows.select("doc_id", "text", "pos", spans.line_of(F.col("text"), F.col("pos")).alias("line"), spans.column_of(F.col("text"), F.col("pos")).alias("col"))
    return rows.select("doc_id", "pos", "line", "col", spans.position_of(F.col("text"), F.col("line"), F.col("col")).alias("back"))


def _edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The capital letters among the first 401 characters of each text are put in angle brackets."""
    docs = _docs(spark, sf_dir)
    at = docs.select("doc_id", F.explode(F.expr("filter(sequence(0, least(length(text), 400)), i -> substr(text, i + 1, 1) rlike '^[A-Z]$')")).alias("i"), "text")
    edits = at.select("doc_id", F.col("i").alias("start"), (F.col("i") + 1).alias("end"), F.concat(F.lit("<"), F.substring("text", F.col("i") + 1, F.lit(1)), F.lit(">")).alias("replacement"))
    return spans.replaced(docs, edits).select("doc_id", F.md5("text").alias("digest"), "n_kept", "n_left")


QUERIES = {
    "span_sets": _sets,
    "span_slice": _cuts,
    "span_places": _places,
    "span_replace": _edited,
    "span_block": lambda spark, sf: _docs(spark, sf).where("text IS NOT NULL").select("doc_id", spans.block(F.col("text"), 1, 4, 5, 25).alias("block")),
    "span_fill": lambda spark, sf: _docs(spark, sf).where("text IS NOT NULL").select("doc_id", F.md5(spans.filled(F.col("text"), "ab", "cover")).alias("cover"), spans.filled(F.col("text"), "x", "line").alias("line"), F.md5(spans.filled(F.col("text"), "new ", "over")).alias("over")),
    "sql_text": lambda spark, sf: sql(spark, sf, "SELECT d.lang, CAST(count(*) AS BIGINT) AS n FROM words w JOIN documents d ON w.doc_id = d.doc_id WHERE w.word_ix = 0 GROUP BY d.lang"),
}

_CHARS = "c AS (SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS ch FROM (SELECT doc_id, string_split(text, '') AS x FROM documents WHERE text <> '')), p AS (SELECT doc_id, i, (sum(CASE WHEN ch = chr(10) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) - CASE WHEN ch = chr(10) THEN 1 ELSE 0 END) % 2 = 0 AS a, i % 100 >= 20 AND i % 100 < 70 AS b FROM c)"
_SET_SQL = {"union": "a OR b", "intersection": "a AND b", "difference": "a AND NOT b", "symmetric_difference": "a <> b"}
_START = "CASE WHEN doc_id % 3 = 0 THEN greatest(length(text) - 40, 0) ELSE least(doc_id % 50, length(text)) END"
_END = "CASE WHEN doc_id % 3 = 0 THEN greatest(length(text) - 23, 0) ELSE least(doc_id % 50 + 17, length(text)) END"

ORACLES = {
    "span_sets": f"WITH {_CHARS}, o AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS op, i FROM p WHERE {w}" for k, w in _SET_SQL.items()) + '), g AS (SELECT doc_id, op, i, i - row_number() OVER (PARTITION BY doc_id, op ORDER BY i) AS grp FROM o) SELECT doc_id, op, min(i) AS start, max(i) + 1 AS "end" FROM g GROUP BY doc_id, op, grp',
    "span_slice": f"SELECT doc_id, md5(text[:a]) AS before, array_to_string(list_slice(string_split(text, ''), a + 1, b), '') AS inside, md5(array_to_string(list_slice(string_split(text, ''), b + 1, length(text)), '')) AS after FROM (SELECT doc_id, text, {_START} AS a, {_END} AS b FROM documents)",
    "span_places": "WITH d AS (SELECT doc_id, text, least(doc_id * 7 % 1500, length(text)) AS pos FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, pos, string_split(left(text, pos), chr(10)) AS x FROM d) SELECT doc_id, pos, CAST(len(x) - 1 AS BIGINT) AS line, CAST(length(x[-1]) AS BIGINT) AS col, pos AS back FROM l",
    "span_replace": "SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE md5(concat(regexp_replace(left(text, 401), '([A-Z])', '<\\1>', 'g'), substr(text, 402))) END AS digest, CAST(coalesce(len(regexp_extract_all(left(text, 401), '[A-Z]')), 0) AS BIGINT) AS n_kept, CAST(0 AS BIGINT) AS n_left FROM documents",
    "span_block": "SELECT doc_id, array_to_string(list_transform(list_slice(string_split(text, chr(10)), 2, 4), lambda s: substr(s, 6, 20)), chr(10)) AS block FROM documents WHERE text IS NOT NULL",
    "span_fill": "WITH c AS (SELECT doc_id, text, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL) SELECT doc_id, md5(array_to_string(list_transform(x, lambda l: left(repeat('ab', length(l)), length(l))), chr(10))) AS cover, concat('x', repeat(chr(10), len(x) - 1)) AS line, md5(concat(left('new ', length(text)), substr(text, 5))) AS over FROM c",
    "sql_text": duck_sql("SELECT d.lang, CAST(count(*) AS BIGINT) AS n FROM words w JOIN documents d ON w.doc_id = d.doc_id WHERE w.word_ix = 0 GROUP BY d.lang"),
}
