"""Each portable query equals its DuckDB SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from lectern.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_oracle(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    cur = duck.execute(catalog.ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(got.columns)
    want = sorted(map(repr, cur.fetchall()))
    assert sorted(repr(tuple(r[c] for c in cols)) for r in got.collect()) == want


def test_repeated_distances(spark):
    from lectern.operators.repeated import repeated_words

    docs = spark.createDataFrame([(1, "This is the the end.\n"), (2, "run to the run\n"), (3, "the cat the dog\n"), (4, "End one. One more.\n"), (5, None), (6, "")], "doc_id long, text string")
    got = {(r["doc_id"], r["word"], r["distance"], r["severity"]) for r in repeated_words(docs).collect()}
    assert got == {(1, "the", 0, "W"), (2, "run", 2, "I"), (3, "the", 1, "I")}


def test_words_in_the_row_equal_sql_of_odd_tables(spark, tmp_path):
    text = ["Ab ab. And CD\u00e9 a!\nEf ab", None, "", "ef \u0130x gh. AB", "\u03a3\u03a3 x-y o\u2019z. Ab"]
    rows = [(None if i % 7 == 0 else i // 2 if i % 3 else i, text[i % 5] and f"{text[i % 5]} only{i % 13}.", [None, "en", "de", "fr", "en"][i % 11 % 5]) for i in range(60)]
    assert len({i for i, _, _ in rows}) < 50
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "Gh and xy"), (2, None)], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    for name in ("new_word", "lexicon_compare"):
        from lectern.functions.dialect import spark_frame
        from lectern.plans.portable import BODIES

        got, want = catalog.QUERIES[name](spark, str(tmp_path)), spark_frame(spark, str(tmp_path), BODIES[name])
        assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in want.schema]
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) != []


@pytest.mark.parametrize(("name", "keys"), [("new_word", {"doc_id"}), ("lexicon_compare", {"doc_id", "word"})])
def test_words_are_not_shuffled_by_document(spark, name, keys):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    # As SQL every word was joined, or grouped, by its document.
    assert "Generate" in plan and not any("Aggregate [doc_id" in line and "lower" in line for line in plan.splitlines()) and "Join Inner" not in plan
