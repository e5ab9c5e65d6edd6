"""Words of documents gathered inside the row, so that only what the rows say together is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.dialect import SENTENCE_END, WORD


#: Up to so many repeated ids are broadcast, more are shuffled with the words.
REPEATED = 2_000_000


def _near(few: DataFrame, n: int) -> DataFrame:
    return F.broadcast(few) if n <= REPEATED else few


def _lower_words(text: Column) -> Column:
    return F.transform(F.flatten(F.transform(F.split(text, SENTENCE_END, -1), lambda s: F.regexp_extract_all(s, F.lit(WORD), 0))), lambda w: F.lower(w))


def new_words(docs: DataFrame, known: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id, word, first_sent, severity, message`` of the words of two or more letters of each document that ``known(word)`` lacks.

    A row tells its own words; only rows that share an id meet, and a null id is an id like the others.
    """
    ids = docs.groupBy(F.col(id_col).alias("_id")).agg(F.count("*").alias("_n")).where("_n > 1").select("_id")
    in_sentence = lambda s, i: F.transform(F.filter(F.regexp_extract_all(s, F.lit(WORD), 0), lambda w: F.length(w) >= 2), lambda w: F.struct(F.lower(w).alias("word"), i.cast("long").alias("first_sent")))
    told = docs.select(id_col, F.array_sort(F.flatten(F.transform(F.split("text", SENTENCE_END, -1), in_sentence))).alias("_w"))
    # Of the places of a word the first is the first in order.
    first = F.filter("_w", lambda x, i: (i == 0) | (F.get("_w", i - 1)["word"] != x["word"]))
    rows = told.select(id_col, F.inline(first)).join(known.select("word").distinct(), "word", "left_anti")
    if not (n := ids.count()):
        alone, shared = rows, None
    else:
        ids = _near(ids, n)
        alone = rows.join(ids, rows[id_col].eqNullSafe(ids["_id"]), "left_anti")
        shared = rows.join(ids, rows[id_col].eqNullSafe(ids["_id"]), "left_semi").groupBy(id_col, "word").agg(F.min("first_sent").alias("first_sent"))
    both = alone.select(id_col, "word", "first_sent")
    both = both if shared is None else both.unionByName(shared)
    return both.select(id_col, "word", "first_sent", F.lit("W").alias("severity"), F.concat(F.lit("new word: "), "word").alias("message"))


def compared(docs: DataFrame, first: str = "en", second: str = "de", id_col: str = "doc_id") -> DataFrame:
    """``word, side`` of the words that one of two languages has alone: ``-`` the first, ``+`` the second.

    Words of a row are told apart inside it and summed as flags.  Rows of one id have the languages of all of them, as a join
    by id gives; rows without an id none.
    """
    flag = F.bit_or(F.when(F.col("lang") == first, 1).when(F.col("lang") == second, 2).otherwise(0))
    more = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(flag.alias("_flag"), F.count("*").alias("_n")).where("_n > 1").select("_id", "_flag")
    own = F.when(F.col("lang") == first, 1).when(F.col("lang") == second, 2).otherwise(0)
    rows = docs.where(F.col(id_col).isNotNull())
    rows = rows.join(_near(more, n), F.col(id_col) == F.col("_id"), "left").select("text", F.coalesce("_flag", own).alias("_f")) if (n := more.count()) else rows.select("text", own.alias("_f"))
    words = rows.where("_f > 0").select("_f", F.explode(F.array_distinct(_lower_words(F.col("text")))).alias("word"))
    sides = words.groupBy("word").agg(F.bit_or("_f").alias("_f")).where("_f < 3")
    return sides.select("word", F.when(F.col("_f") == 1, "-").otherwise("+").alias("side"))
