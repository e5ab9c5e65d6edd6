"""All queries over the reference operators, by name, with the SQL of those that SQL can express."""

from __future__ import annotations

from functools import partial

from lectern.functions.dialect import duck_sql, spark_frame
from lectern.operators import language, repeated, sequential, words
from lectern.plans import markup, rules, spans
from lectern.plans.portable import BODIES
from lectern.session import table
from lectern.streaming import corpus

#: Bodies that run as operators here: as SQL they shuffle every word of every document.
_IN_ROW = {
    "new_word": lambda spark, sf: words.new_words(table(spark, sf, "documents").select("doc_id", "text"), spark_frame(spark, sf, "SELECT lower(word) AS word FROM bench_words")),
    "lexicon_compare": lambda spark, sf: words.compared(table(spark, sf, "documents").select("doc_id", "text", "lang")),
}

QUERIES: dict = {"repeated_words": repeated.query} | {k: partial(lambda spark, sf_dir, body: spark_frame(spark, sf_dir, body), body=b) for k, b in BODIES.items()} | _IN_ROW | sequential.QUERIES | markup.QUERIES | language.QUERIES | corpus.QUERIES | rules.QUERIES | spans.QUERIES
ORACLES: dict = {"repeated_words": duck_sql(repeated.ORACLE)} | {k: duck_sql(b) for k, b in BODIES.items()} | markup.ORACLES | language.ORACLES | corpus.ORACLES | rules.ORACLES | spans.ORACLES | {"stream_lexicon": duck_sql(BODIES["word_count_lexicon"])}
