"""Repeated words within a few words of each other in a sentence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.dialect import SENTENCE_END, WORD
from lectern.session import table

ORACLE = """
WITH o AS (SELECT doc_id, sent_ix, word_ix, word, lag(lower(word), 1) OVER p AS p1, lag(lower(word), 2) OVER p AS p2, lag(lower(word), 3) OVER p AS p3
  FROM words WINDOW p AS (PARTITION BY doc_id, sent_ix ORDER BY word_ix)),
d AS (SELECT doc_id, sent_ix, word_ix, word, CASE WHEN lower(word) = p1 THEN 0 WHEN lower(word) = p2 THEN 1 WHEN lower(word) = p3 THEN 2 END AS distance FROM o)
SELECT doc_id, sent_ix, word_ix, word, distance, CASE WHEN distance = 0 THEN 'W' ELSE 'I' END AS severity FROM d
WHERE distance IS NOT NULL AND NOT (distance >= 1 AND lower(word) IN ('and', 'or', 'to', 'as', 'of')) AND NOT (distance = 2 AND lower(word) IN ('a', 'an', 'the'))
"""


def repeated_words(docs: DataFrame, reach: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words equal, but for case, to one of the last ``reach`` of their sentence; the nearest counts.

    Each sentence's words are zipped with themselves shifted, so neighbours meet within the row and nothing
    is shuffled.  Articles are ignored from distance 2 and a few connectives from distance 1.
    """
    sents = docs.select(id_col, F.posexplode(F.split(F.col(text_col), SENTENCE_END, -1)).alias("sent_ix", "_s"))
    step = sents.select(id_col, F.col("sent_ix").cast("long").alias("sent_ix"), F.regexp_extract_all("_s", F.lit(WORD), 0).alias("word")).withColumn("p0", F.transform("word", F.lower))
    for k in range(1, reach + 1):
        step = step.withColumn(f"p{k}", F.concat(F.array(F.lit(None).cast("string")), F.col(f"p{k - 1}")))
    rows = step.select(id_col, "sent_ix", F.posexplode(F.arrays_zip("word", *(f"p{k}" for k in range(reach + 1)))).alias("word_ix", "z")).where("z.word is not null")
    near = F.coalesce(*(F.when(F.col("z.p0") == F.col(f"z.p{k}"), F.lit(k - 1)) for k in range(1, reach + 1)))
    low = F.col("z.p0")
    out = rows.withColumn("distance", near).where(F.col("distance").isNotNull() & ~((F.col("distance") >= 1) & low.isin("and", "or", "to", "as", "of")) & ~((F.col("distance") == 2) & low.isin("a", "an", "the")))
    return out.select(id_col, "sent_ix", F.col("word_ix").cast("long").alias("word_ix"), F.col("z.word").alias("word"), "distance", F.when(F.col("distance") == 0, "W").otherwise("I").alias("severity"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_words(table(spark, sf_dir, "documents"))
