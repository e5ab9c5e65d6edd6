"""Rules on neighbouring words of a sentence and on the words of a document: neighbours meet in arrays inside the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import vocabulary as v
from lectern.functions.dialect import SENTENCE_END, WORD
from lectern.operators import tokens


def sentence_words(docs: DataFrame) -> DataFrame:
    """``doc_id, sent_ix, words``."""
    sents = docs.select("doc_id", F.posexplode(F.split("text", SENTENCE_END, -1)).alias("sent_ix", "_s"))
    return sents.select("doc_id", F.col("sent_ix").cast("long").alias("sent_ix"), F.regexp_extract_all("_s", F.lit(WORD), 0).alias("words"))


def _pairs(docs: DataFrame, first: str, second: str, fit) -> DataFrame:
    """``doc_id, sent_ix, word_ix, first, second`` of the words and followers that fit."""
    both = F.transform("words", lambda w, i: F.struct(i.cast("long").alias("word_ix"), F.lower(w).alias(first), F.get("words", i + 1).alias(second)))
    hits = F.filter(both, lambda x: x[second].isNotNull() & fit(x[first], x[second]))
    return sentence_words(docs).select("doc_id", "sent_ix", F.explode(hits).alias("_h")).select("doc_id", "sent_ix", "_h.*")


def wanted_article(follower: Column) -> Column:
    """The article a word asks for: by the name of its first letter in acronyms, by listed beginnings, else by its first letter."""
    begins = lambda words: F.lower(follower).rlike(f"^(?:{'|'.join(words)})")
    spelled = follower.rlike(r"^(?:[A-Z]|[A-Z]{2,}s?)$")
    vowel = F.when(spelled, follower.rlike(f"^[{v.LETTERS_AN}]")).when(begins(v.AN_LONGER), True).when(begins(v.A_BEFORE_VOWEL), False).when(begins(v.AN_BEFORE_CONSONANT), True).otherwise(F.lower(follower).rlike("^[aeiou]"))
    return F.when(vowel, "an").otherwise("a")


def article(docs: DataFrame) -> DataFrame:
    """``a`` and ``an`` before a word of the other sound; a number only asks that it is not ``an``."""
    wrong = lambda art, nxt: F.when(nxt.rlike("^[0-9]"), art == "an").otherwise(art != wanted_article(nxt))
    return _pairs(docs, "art", "follower", lambda a, b: a.isin("a", "an") & wrong(a, b)).withColumn("severity", F.lit("E"))


def passive(docs: DataFrame) -> DataFrame:
    """A form of to be or to get before a participle, regular or listed."""
    part = lambda w: (F.lower(w).rlike("(?:ed|en)$") & ~F.lower(w).isin(*v.NO_PARTICIPLES)) | F.lower(w).isin(*v.IRREGULAR)
    return _pairs(docs, "verb", "participle", lambda a, b: a.isin(*v.BE) & part(b)).withColumns({"participle": F.lower("participle"), "severity": F.lit("I")})


def overuse_simple(docs: DataFrame, near: int = 5, far: int = 80, least: int = 11250) -> DataFrame:
    """Words of over three letters that come back within ``far`` words too often: each return scores by its closeness.

    Words are numbered in the row, and compared there.
    """
    return tokens.returns(docs, near, far, least)


def hyphen_variants(docs: DataFrame, share: float = 0.55, least: float = 3.0, spaced: int = 6) -> DataFrame:
    """Hyphenated words whose joined form is the rarer one of two in use: the joined form is a variant to search for, and the spaced one of frequent words too.

    Kept if ``joined / (joined + own) < share`` and ``joined + own / 2 > least``.
    """
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), 0)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    # A word and its hyphenated forms meet under the joined form; words of one key are few.
    both = words.groupBy(F.replace("word", F.lit("-"), F.lit("")).alias("joined")).agg(F.sum(F.when(~F.col("word").contains("-"), F.col("n")).otherwise(0)).alias("n_joined"), F.collect_list(F.when(F.col("word").contains("-"), F.struct("word", "n"))).alias("_h"))
    rows = both.select("joined", "n_joined", F.explode("_h").alias("_h")).select(F.col("_h.word").alias("word"), F.col("_h.n").alias("n_hyphen"), "n_joined")
    kept = rows.where((F.col("n_joined") / (F.col("n_joined") + F.col("n_hyphen")) < share) & (F.col("n_joined") + F.col("n_hyphen") / 2 > least))
    return kept.select("word", "n_hyphen", "n_joined", F.when(F.col("n_hyphen") > spaced, F.replace("word", F.lit("-"), F.lit(" "))).alias("spaced"))


def page_name(pages: DataFrame, least: float = 0.5) -> DataFrame:
    """Headings that share too few words with the name of their page: an article counts as shared, and all if the name is the heading's acronym."""
    stem = F.lower(F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), "([^/.]+)(?:[.][a-z]+)?/*$", 1))
    rows = pages.select("page_id", stem.alias("name"), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("title")).where("title <> ''")
    words = F.regexp_extract_all(F.lower("title"), F.lit(r"[\p{L}\p{N}]+"), 0)
    r = rows.withColumns({"_t": words, "_n": F.split("name", "[-_]")}).where("size(_t) > 0")
    shared = F.size(F.filter("_t", lambda w: w.isin("a", "an", "the") | F.array_contains("_n", w)))
    acronym = F.array_join(F.transform("_t", lambda w: F.substring(w, 1, 1)), "") == F.col("name")
    return r.withColumns({"n_words": F.size("_t").cast("long"), "n_shared": F.when(acronym, F.size("_t")).otherwise(shared).cast("long")}).where(F.col("n_shared") < F.lit(least) * F.col("n_words")).select("page_id", "name", "title", "n_words", "n_shared", F.lit("L").alias("severity"))
