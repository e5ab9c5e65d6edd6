from __future__ import annotations

import pytest

from lectern.operators import markup as m
from lectern.operators.rst import nodes, parse

PAGE = """.. _abc:

*****
Title
*****

Sub
^^^

Some *em*, **strong**, ``lit``, :foo:`x`, :abbr:`CPU (Central processing Unit)`, :kbd:`Ctrl-Shift-A` and :kbd:`A-A`,
:ref:`Title <abc>`, :ref:`Quite another <abc>`, |sub|, `Out <https://x.org>`_.

.. note:: Head

   Body *in*.

- a
- b

.. |sub| replace:: one |two|
.. |two| replace:: 2
.. |odd| replace:: |odd|

+---+---+
| a | b |
+---+---+

Code::

   x = *1*
"""


def kinds(text):
    return [(n.kind, n.name) for n in parse(text)]


def test_parse_positions_and_kinds():
    for n in parse(PAGE):
        assert 0 <= n.start <= n.end <= len(PAGE)
    by = {(n.kind, n.name): PAGE[n.start : n.end] for n in parse(PAGE)}
    assert by[("emphasis", None)] == "*in*" and by[("literal", None)] == "``lit``" and by[("role", "foo")] == ":foo:`x`"
    assert kinds("- a\n- b\n") == [("document", None), ("bullet-list", None), ("bullet", None), ("text", None), ("bullet", None), ("text", None)]
    assert kinds(".. note::\n\n   Body.\n") == [("document", None), ("dir", "note"), ("text", None)]
    assert kinds("Title\n=====\n\nA *em* and ``lit``.\n") == [("document", None), ("sect", "Title"), ("text", None), ("emphasis", None), ("literal", None)]
    assert kinds(None) == kinds("") == kinds("\n\n") == [("document", None)]
    # Code is not parsed, and is no prose.
    code = [n for n in parse(PAGE) if n.name == "default"]
    assert len(code) == 1 and not code[0].prose and code[0].child_kinds == ""
    cells = [n.body for n in parse(PAGE) if n.kind == "cell"]
    assert cells == ["a", "b"]


@pytest.fixture(scope="module")
def n(spark):
    docs = spark.createDataFrame([(1, PAGE), (2, "Title\n===\n\nx :ref:`abc` y\n"), (3, None), (4, "")], "doc_id long, text string")
    return nodes(docs).cache()


def test_nodes_come_in_small_pieces(spark, monkeypatch):
    from pyspark.sql import functions as F

    from lectern.operators import rst

    texts = ["Word.\n\n" * 30, None, "", PAGE, "x" * 500, "- a\n" * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = sorted((i, n.node_id, n.kind, n.start, n.body) for i, t in enumerate(texts) for n in parse(t))
    monkeypatch.setattr(rst, "NODES_OUT", 7)
    monkeypatch.setattr(rst, "CHARS_OUT", 100)
    got = nodes(docs)
    assert sorted((r["doc_id"], r["node_id"], r["kind"], r["start"], r["body"]) for r in got.collect()) == want
    assert str(got.schema["doc_id"].dataType) == "LongType()" and got.where(F.col("prose").isNull()).count() == 0
    assert [r["doc_id"] for r in nodes(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")).where("kind = 'document'").orderBy("doc_id").collect()] == list("012345")


def test_memory_of_the_parser_does_not_grow_with_the_batch(spark, monkeypatch):
    from lectern.operators import rst

    def watched(text):
        import resource

        return [rst.Node(0, -1, "document", None, None, None, 0, 0, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, 0, 0, 0, 0, "x" * 200_000, None)]

    monkeypatch.setattr(rst, "parse", watched)
    kb = [r["start"] for r in nodes(spark.range(3000).selectExpr("id AS doc_id", "'x' AS text").coalesce(1)).select("start").collect()]
    # A worker that kept the nodes of its batch of 3000 texts held over 600 MB of them.
    assert len(kb) == 3000 and max(kb) - min(kb) < 200_000


def told(df):
    return sorted((r["doc_id"], r["message"]) for r in df.collect())


def test_rules(n):
    assert told(m.heading_level(n)) == [(1, "wrong level: * > ^ with ="), (2, "missing title heading")]
    assert told(m.heading_line_length(n)) == [(2, "wrong underline length: +2")]
    assert told(m.markup_names(n)) == [(1, "unknown role")]
    assert told(m.kbd(n)) == [(1, "invalid keyboard shortcut: A-A"), (1, "invalid keyboard shortcut: Ctrl-Shift-A")]
    assert told(m.abbr_caps(n)) == [(1, "uppercase mismatch: CPU - CU")]
    assert told(m.link_titles(n)) == [(1, "title mismatch: Title")]
    assert told(m.unused_targets(n)) == [] and told(m.local_targets(n)) == []
    assert (1, "missing underscore after external link") in told(m.style_extra(n))
    assert told(m.structure(n)) == [(1, "list without an introductory text")]


def test_chords(spark):
    good, bad = ["Shift-Ctrl-A", "Ctrl-LMB", "F12", "Alt-WheelUp", "NumpadPlus", "Ctrl"], ["Ctrl-Shift-A", "Foo", "ctrl-a", "Left-Left", "Ctrl-Ctrl-A", "A-B-C", "Ctrl--A", "LMB-RMB", "LMB-A", ""]
    rows = spark.createDataFrame([(k,) for k in good + bad], "k string")
    wrong = [r["k"] for r in rows.where(m.bad_chord(rows["k"])).collect()]
    assert sorted(wrong) == sorted(bad)


def test_substitutions(n):
    assert m.resolve_text({"a": "x |b|", "b": "y", "c": "|d|", "d": "|c|", "e": "|f|"}) == ({"a": "x y", "b": "y", "e": "|f|"}, {"c", "d"})
    got = {(r["name"], r["text"], r["cyclic"]) for r in m.substitutions(n).where("doc_id = 1").collect()}
    assert ("sub", "one 2", False) in got


def test_blank_lines_and_select(spark):
    docs = spark.createDataFrame([(1, "One.\n\nTwo.\n\nSub\n===\n\nEnd.\n"), (2, "One.\n\n\nTwo.\n\n\nSub\n===\n\nEnd.\n")], "doc_id long, text string")
    tree = nodes(docs)
    assert told(m.blank_lines(tree)) == [(1, "2 blank lines over sect: +1"), (2, "1 blank lines over text: -1")]
    page = nodes(spark.createDataFrame([(1, PAGE)], "doc_id long, text string"))
    assert m.select(page, {"emphasis": None}).count() == 2
    assert m.select(page, {"emphasis": None}, {"dir": ["note"]}).count() == 1


def test_runs_and_glossary(spark):
    text = "A.\n\n" + "".join(f".. note:: H\n\n   B{i}.\n\n" for i in range(3)) + ".. glossary::\n\n   Term\n      Words.\n   Other\n      See :term:`Term`.\n"
    tree = nodes(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert (1, "three or more boxes in a row") in told(m.structure(tree))
    assert told(m.glossary(tree)) == [(1, "term used only within glossary"), (1, "unused term")]


def test_queries_of_the_head_equal_sql_whatever_the_texts_hold(spark, tmp_path):
    import duckdb

    from lectern.plans import markup as plan

    odd = [None, "", " set in\n  and further", "a `tick` and :math:`x`, :foo:`y`", ".. raw:: html\n\n   x", "Deep\n====\n\nx\n\nMore\n~~~~\n", ":kbd:`A-A` and :abbr:`CPU (a Unit)`", ".. figure:: x.png\n\nWords", "- a\n\n  - b", "::\n\n   code"]
    spark.createDataFrame([(i, odd[i % len(odd)]) for i in range(2520)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("markup_names", "kbd", "abbr_caps", "wrong_kbd", "wrong_abbr", "unknown_role", "wrong_level", "no_caption"):
        got = plan.QUERIES[f"markup_{name}"](spark, str(tmp_path))
        want = c.execute(f"SELECT {', '.join(got.columns)} FROM ({plan.ORACLES[f'markup_{name}']})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want), name
