"""Spans over texts: cuts, places by line and column, sets of spans, and texts with other content in a span.

A span is ``[start, end)`` in code points from 0.  All is built-in expressions; only the sets of spans shuffle, once, by row id.
Null texts give nulls; positions outside of a text are moved to its ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_long = lambda c: c.cast("long")


def absolute(text: Column, pos: Column) -> Column:
    """A position from the start of the text; negative ones count from its end."""
    n = F.length(text)
    return _long(F.when(pos < 0, F.greatest(n + pos, F.lit(0))).otherwise(F.least(pos, n)))


def relative(start: Column, pos: Column) -> Column:
    """A position counted from the start of a span, and back again with a negated start."""
    return _long(pos - start)


def cut(text: Column, start: Column, end: Column) -> Column:
    """The content of a span; empty where the end lies before the start."""
    return F.substring(text, (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))


def parts(text: Column, start: Column, end: Column) -> Column:
    """``before, inside, after`` of a span whose ends may be negative; ends in the wrong order give an empty inside."""
    a = absolute(text, start)
    b = F.greatest(a, absolute(text, end))
    return F.struct(cut(text, F.lit(0), a).alias("before"), cut(text, a, b).alias("inside"), cut(text, b, F.length(text)).alias("after"))


def line_of(text: Column, pos: Column) -> Column:
    """The line of a position, from 0; a position after a line end is on the next line."""
    head = cut(text, F.lit(0), pos)
    return _long(F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))))


def column_of(text: Column, pos: Column) -> Column:
    """The column of a position, from 0."""
    return _long(F.length(F.substring_index(cut(text, F.lit(0), pos), "\n", -1)))


def position_of(text: Column, line: Column, column: Column) -> Column:
    """The position of a line and column; columns after the line are moved to its end, lines after the text to the text's end."""
    lines = F.split(text, "\n", -1)
    before = F.aggregate(F.slice(lines, F.lit(1), F.least(line, F.size(lines)).cast("int")), F.lit(0), lambda n, x: n + F.length(x) + 1)
    own = F.length(F.get(lines, line.cast("int")))
    return _long(F.when(own.isNull(), F.length(text)).otherwise(before + F.least(column, own)))


def block(text: Column, first: int, last: int, left: int, right: int) -> Column:
    """The rectangle of lines ``first`` to before ``last`` and columns ``left`` to before ``right``."""
    own = F.slice(F.split(text, "\n", -1), first + 1, max(0, last - first))
    return F.array_join(F.transform(own, lambda x: F.substring(x, left + 1, max(0, right - left))), "\n")


def filled(content: Column, filler: str, layout: str = "fix") -> Column:
    """Another content in the same span: ``fix`` is the filler alone, ``line`` keeps the span's line ends after it, ``block`` writes it
    once on every line, ``over`` covers as many characters as the content has, ``cover`` repeats it over all but the line ends."""
    ends = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))
    if layout == "fix":
        return F.when(content.isNotNull(), F.lit(filler))
    if layout == "line":
        return F.concat(F.lit(filler), F.repeat(F.lit("\n"), ends.cast("int")))
    if layout == "block":
        return F.array_join(F.transform(F.split(content, "\n", -1), lambda _: F.lit(filler)), "\n")
    if layout == "over":
        return F.concat(F.substring(F.lit(filler), F.lit(1), F.length(content)), F.substring(content, len(filler) + 1, 1 << 30))
    if layout == "cover":
        wide = lambda x: F.substring(F.repeat(F.lit(filler), F.ceil(F.length(x) / max(1, len(filler))).cast("int")), F.lit(1), F.length(x))
        return F.array_join(F.transform(F.split(content, "\n", -1), wide), "\n")
    raise ValueError(layout)


def within(start: Column, end: Column, pos: Column, start_too: bool = True, end_too: bool = True) -> Column:
    """Whether a position is in a span, its ends included or not; an empty span holds its own place only."""
    inside = (pos >= start if start_too else pos > start) & (pos <= end if end_too else pos < end)
    return F.when(start == end, pos == start).otherwise(inside)


def replaced(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the content of ``edits(id, start, end, replacement)`` put in, and ``n_kept`` and ``n_left`` edits.

    Edits are taken by start, end and replacement; one that begins before the end of the one before it is left, as is one with an end
    outside of the text or before its start; equal edits count once.  Rows without edits keep their text; each row of a repeated id gets all edits of it.
    """
    own = edits.select(F.col(id_col).alias("_e_id"), F.struct(_long(F.col("start")).alias("s"), _long(F.col("end")).alias("e"), F.coalesce("replacement", F.lit("")).alias("r")).alias("_e_x"))
    listed = own.where("_e_id IS NOT NULL").groupBy("_e_id").agg(F.array_sort(F.collect_set("_e_x")).alias("_e_all"))
    joined = docs.join(listed, docs[id_col] == F.col("_e_id"), "left")
    text = docs[text_col]
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("pieces"), F.lit(0).cast("long").alias("n"))

    def put(acc: Column, x: Column) -> Column:
        fits = (x["s"] >= acc["at"]) & (x["e"] >= x["s"]) & (x["e"] <= F.length(text))
        new = F.struct(x["e"].alias("at"), F.concat(acc["pieces"], F.array(cut(text, acc["at"], x["s"]), x["r"])).alias("pieces"), (acc["n"] + 1).alias("n"))
        return F.when(fits, new).otherwise(acc)

    done = F.aggregate(F.coalesce("_e_all", F.array().cast("array<struct<s:bigint,e:bigint,r:string>>")), zero, put)
    out = joined.withColumn("_e_done", done)
    whole = F.when(text.isNotNull(), F.concat(F.array_join("_e_done.pieces", ""), cut(text, F.col("_e_done.at"), F.length(text))))
    kept = F.col("_e_done.n")
    return out.select(*(docs[c] for c in docs.columns if c not in (text_col, "n_kept", "n_left")), whole.alias(text_col), kept.alias("n_kept"), _long(F.coalesce(F.size("_e_all"), F.lit(0)) - kept).alias("n_left"))


#: What is asked of the spans that cover a place: of the first table, of the second.
SET_OPS = {
    "union": lambda a, b: a | b,
    "intersection": lambda a, b: a & b,
    "difference": lambda a, b: a & ~b,
    "symmetric_difference": lambda a, b: a != b,
}


def set_spans(first: DataFrame, second: DataFrame, ops: tuple[str, ...] = tuple(SET_OPS), id_col: str = "doc_id") -> DataFrame:
    """``id, op, start, end``: the places that two tables of spans ``(id, start, end)`` cover, as joined spans without overlap.

    A sweep over the ends counts how many spans of each table are open, so nothing is joined span by span.  Spans may overlap within a
    table; spans that are empty, reversed or have a null end cover nothing; a null id is an id like the others.
    """

    def ends(df: DataFrame, a: int, b: int) -> DataFrame:
        one = lambda pos, by: F.struct(_long(F.col(pos)).alias("pos"), F.lit(a * by).alias("a"), F.lit(b * by).alias("b"))
        return df.where("start < end").select(F.col(id_col).alias("_id"), F.inline(F.array(one("start", 1), one("end", -1))))

    steps = ends(first, 1, 0).unionByName(ends(second, 0, 1))
    # One sort serves all: the last row of a place knows all that is open there, and only turns are told by op.
    order = Window.partitionBy("_id").orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = steps.select("_id", "pos", (F.sum("a").over(upto) > 0).alias("a"), (F.sum("b").over(upto) > 0).alias("b"), F.lead("pos").over(order).alias("_next"))
    places = opened.where("_next IS NULL OR _next <> pos").select("_id", "pos", "a", "b", *(F.lag(c, 1, False).over(order).alias(f"_{c}") for c in "ab"))
    on = {o: SET_OPS[o](F.col("a"), F.col("b")) for o in ops}
    turns = places.select("_id", "pos", *(F.when(on[o] != SET_OPS[o](F.col("_a"), F.col("_b")), on[o]).alias(o) for o in ops)).where(F.coalesce(*ops).isNotNull())
    # A last turn always closes: where all spans have ended, no op holds.
    after = lambda o: F.expr(f"lead(CASE WHEN {o} IS NOT NULL THEN pos END) IGNORE NULLS OVER (PARTITION BY _id ORDER BY pos)")
    told = turns.select("_id", "pos", *ops, *(after(o).alias(f"_to_{o}") for o in ops))
    each = F.array(*(F.when(F.col(o), F.struct(F.lit(o).alias("op"), F.col("pos").alias("start"), F.col(f"_to_{o}").alias("end"))) for o in ops))
    return told.select(F.col("_id").alias(id_col), F.inline(F.array_compact(each)))


def relation(pairs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id, subset, superset, disjoint, equal`` of the two tables of spans in the rows ``(id, side, start, end)``, by the places they cover."""
    sides = [pairs.where(F.col("side") == s).select(id_col, "start", "end") for s in ("a", "b")]
    found = set_spans(*sides, ops=("intersection", "difference", "symmetric_difference"), id_col=id_col)
    size = lambda op: F.coalesce(F.sum(F.when(F.col("op") == op, F.col("end") - F.col("start"))), F.lit(0))
    sums = found.groupBy(id_col).agg(size("intersection").alias("i"), size("difference").alias("d"), size("symmetric_difference").alias("s"))
    all_ids = pairs.select(id_col).distinct()
    n = {k: F.coalesce(F.col(f"s.{k}"), F.lit(0)) for k in "ids"}
    return (
        all_ids.alias("p").join(sums.alias("s"), F.col(f"p.{id_col}").eqNullSafe(F.col(f"s.{id_col}")), "left")
        .select(F.col(f"p.{id_col}").alias(id_col), (n["d"] == 0).alias("subset"), (n["s"] == n["d"]).alias("superset"), (n["i"] == 0).alias("disjoint"), (n["s"] == 0).alias("equal"))
    )
