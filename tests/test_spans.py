"""Span operators against sets of positions, and their defined cases."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lectern.operators import spans

SPAN = "doc_id long, start long, end long"


def test_set_spans_equal_sets_of_positions(spark):
    rnd = random.Random(3)
    rows = {s: [(d, a, a + rnd.randint(-1, 9)) for d in (1, 2, None) for a in (rnd.randint(0, 60) for _ in range(12))] + [(1, None, 4), (2, 5, None)] for s in "ab"}
    got = spans.set_spans(spark.createDataFrame(rows["a"], SPAN), spark.createDataFrame(rows["b"], SPAN)).collect()
    covered = lambda s, d: {i for x, a, b in rows[s] if x == d and a is not None and b is not None for i in range(a, b)}
    for op, make in (("union", set.union), ("intersection", set.intersection), ("difference", set.difference), ("symmetric_difference", set.symmetric_difference)):
        for d in (1, 2, None):
            own = sorted((r["start"], r["end"]) for r in got if r["op"] == op and r["doc_id"] == d)
            want = make(covered("a", d), covered("b", d))
            assert {i for a, b in own for i in range(a, b)} == want
            assert all(x[1] < y[0] for x, y in zip(own, own[1:], strict=False))


def test_set_spans_of_empty_tables(spark):
    none = spark.createDataFrame([], SPAN)
    assert spans.set_spans(none, none).count() == 0


def test_relation(spark):
    rows = [(1, "a", 2, 4), (1, "b", 0, 9), (2, "a", 0, 9), (2, "b", 2, 4), (3, "a", 0, 2), (3, "b", 2, 4), (4, "a", 0, 4), (4, "b", 0, 2), (4, "b", 2, 4), (5, "a", 3, 3)]
    got = {r[0]: tuple(r)[1:] for r in spans.relation(spark.createDataFrame(rows, "doc_id long, side string, start long, end long")).collect()}
    assert got == {1: (True, False, False, False), 2: (False, True, False, False), 3: (False, False, True, False), 4: (True, True, False, True), 5: (True, True, True, True)}


def _one(spark, text, *cols):
    return tuple(spark.createDataFrame([(text,)], "text string").select(*cols).first())


def test_parts_and_positions(spark):
    t = F.col("text")
    assert tuple(_one(spark, "añb😀cd", spans.parts(t, F.lit(2), F.lit(4)))[0]) == ("añ", "b😀", "cd")
    assert tuple(_one(spark, "abcdef", spans.parts(t, F.lit(-3), F.lit(-1)))[0]) == ("abc", "de", "f")
    assert tuple(_one(spark, "abc", spans.parts(t, F.lit(2), F.lit(1)))[0]) == ("ab", "", "c")
    assert tuple(_one(spark, "abc", spans.parts(t, F.lit(-9), F.lit(99)))[0]) == ("", "abc", "")
    assert tuple(_one(spark, None, spans.parts(t, F.lit(0), F.lit(1)))[0]) == (None, None, None)
    text = "ab\n\ncde\n"
    for pos in range(len(text) + 1):
        line, col = text.count("\n", 0, pos), pos - (text.rfind("\n", 0, pos) + 1)
        assert _one(spark, text, spans.line_of(t, F.lit(pos)), spans.column_of(t, F.lit(pos)), spans.position_of(t, F.lit(line), F.lit(col))) == (line, col, pos)
    assert _one(spark, text, spans.position_of(t, F.lit(0), F.lit(50)), spans.position_of(t, F.lit(50), F.lit(0))) == (2, len(text))


def test_fills_and_places(spark):
    t = F.col("text")
    got = _one(spark, "abc\nde\n", *(spans.filled(t, "xy", k) for k in ("fix", "line", "block", "over", "cover")), spans.block(t, 0, 2, 1, 3))
    assert got == ("xy", "xy\n\n", "xy\nxy\nxy", "xyc\nde\n", "xyx\nxy\n", "bc\ne")
    inside = [spans.within(F.lit(2), F.lit(4), F.lit(p), *ends) for p, ends in ((2, ()), (4, ()), (5, ()), (2, (False, True)), (4, (True, False)))]
    assert _one(spark, "", *inside, spans.within(F.lit(3), F.lit(3), F.lit(3), False, False)) == (True, True, False, False, False, True)


def test_replaced(spark):
    docs = spark.createDataFrame([(1, "hello world", "k"), (1, "hi", "k"), (2, "x", None), (3, None, "z"), (None, "n", "q")], "doc_id long, text string, n_kept string")
    edits = spark.createDataFrame([(1, 0, 5, "bye"), (1, 0, 5, "bye"), (1, 3, 7, "zz"), (1, 5, 5, ","), (1, 6, 99, "far"), (2, 0, 1, None), (3, 0, 1, "a"), (None, 0, 1, "a")], "doc_id long, start long, end long, replacement string")
    got = sorted(map(tuple, spans.replaced(docs, edits).collect()), key=repr)
    assert got == sorted([(1, "bye, world", 2, 2), (1, "hi", 0, 4), (2, "", 1, 0), (3, None, 0, 1), (None, "n", 0, 0)], key=repr)


def test_set_spans_sort_once(spark):
    made = spark.range(10).selectExpr("id AS doc_id", "id AS start", "id + 5 AS end")
    plan = spans.set_spans(made, made.selectExpr("doc_id", "start + 2 AS start", "end"))._jdf.queryExecution().executedPlan().toString()
    # A sort of the rows of all four sets held four times the ends in a task.
    assert plan.split("Initial Plan")[0].count("Sort [") == 1 and plan.split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
