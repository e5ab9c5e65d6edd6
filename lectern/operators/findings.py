"""Findings of pattern rules, with their places, in one scan of the texts; patterns avoid lookaround, so any engine can run them.

Here Arrow's engine does, in time linear in the text; its Python workers see slices of texts, no single rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = {
    "doubled": r"[,;:][,;:]+", "no_space_after_stop": r"[\p{Ll}][.][\p{Lu}]", "no_space_after_comma": r"[,;][\p{L}]", "quote_in_word": r"[\p{L}]\x22[\p{L}]", "space_before_dots": r" [.][.][.]",
    "space_in_bracket": r"\( | \)", "mark_on_both_sides": r"[.,]\)[.,]", "ampersand": r" & ", "slash": r"[\p{L}] / [\p{L}]", "greater_or_less": r"[<>]", "tilde": r"~[0-9]", "slash_plural": r"/s[ .,]",
    "closing_at_line_start": r"\n[)\]},;:!?]", "opening_at_line_end": r"[(\[{]\n", "space_before_mark": r"[\p{L}] [,;:!?]", "bracket_on_word": r"[\p{L}]\([^s]", "space_after_apostrophe": r"[\p{L}]\x27 s[ .,]", "comma_at_end": r"[,;]\n",
}
NUMBER = {
    "no_separator": r"[0-9]{4,}", "short_group": r"[0-9],[0-9]{1,2}[^0-9]", "no_leading_zero": r"[ (][.][0-9]", "trailing_zero": r"[0-9][.][0-9]*0[^0-9]", "times": r"[0-9] ?x ?[0-9]", "range": r"[0-9][.][.][0-9]",
    "ratio": r"[0-9] ?: [0-9]", "space_before_percent": r"[0-9] %", "celsius": r"[0-9] ?C[ .,]", "dimension": r"[0-9]d[ .,]", "no_space_before_unit": r"[0-9](?:px|kB|MB|GB|ms)[ .,]", "space_as_separator": r"[0-9] [0-9]{3}[^0-9]",
    "no_hyphen_written": r"(?:twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety) (?:one|two|three|four|five|six|seven|eight|nine)[ .,]", "low_digit": r" [0-9] [\p{Ll}]{3,}", "leading_zero": r"[^0-9.,]0[0-9]+", "all_or_none_percent": r"[^0-9](?:0|100) ?%",
    "degrees": r"[0-9] degrees?", "zero_before_comma": r"[^0-9.,]0,[0-9]",
}
LEAK = {
    "directive_one_colon": r"\n[.][.] [a-z][a-z-]*:[ \n]", "directive_no_colon": r"\n[.][.] (?:note|warning|tip|figure|image)[ \n]", "directive_in_line": r"[\p{L}] [.][.] [a-z][a-z-]*::", "label_no_colon": r"\n[.][.] _[a-z-]+\n",
    "bullet_no_space": r"\n[-*][\p{L}]", "number_no_space": r"\n[0-9]+[.][\p{L}]", "role_no_mark": r" :[a-z]+:[\p{L}]", "role_space": r":[a-z]+: \x60", "role_open": r":[a-z]+:\x60[^\x60\n]*\n", "no_space_before_target": r"[\p{L}]<[a-z/]+>\x60",
    "path_not_from_root": r":doc:\x60[a-z]", "path_with_drive": r":doc:\x60[A-Z]:", "path_with_extension": r":doc:\x60[^\x60\n]*[.]rst", "abbreviation_open": r":abbr:\x60[^\x60\n)]*\x60", "literal": r"\x60\x60", "strong": r"[*][*]",
    "emphasis": r"[ \n][*][\p{L}]", "substitution": r"[|][\p{L}]", "inline_target": r"_\x60", "link_end": r"\x60_", "footnote": r"\[[0-9#*]+\]_", "default_role": r"[ \n]\x60[\p{L}]", "arrow": r"->", "long_arrow": r"--+>", "dashes": r" -- ",
    "escape": r"\x5C[^ \n]", "merge_conflict": r"(?:<<<<<<<|>>>>>>>)",
}
CHARS = {"replacement": r"[\x{FFFD}]", "single_quote": r"[\x{2018}\x{2019}\x{201A}]", "double_quote": r"[\x{201C}\x{201D}\x{201E}\x{00AB}\x{00BB}]", "dash": r"[\x{2013}\x{2014}]", "uncommon": r"[^\n\t -~\x{00C0}-\x{02A8}\x{00A9}\x{00AE}\x{00B0}\x{00B1}\x{20AC}\x{2122}]"}
GRAMMAR = {"double_s": r"s\x27s ", "hyphen_after_possessive": r"s\x27-", "then_for_than": r"(?:[\p{L}]{3,}er|less|more [\p{L}]+) then ", "two_adverbs": r"[\p{L}]{2,}ly [\p{L}]{2,}ly[ .,]"}
#: Tool to (severity, rules).
TOOLS = {"mark": ("W", MARK), "number": ("W", NUMBER), "leak": ("F", LEAK), "char": ("E", CHARS), "grammar": ("W", GRAMMAR)}


#: Bytes of texts that are searched in one step; the findings of a rule in them are given out at once.
SLICE = 4 << 20


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts in slices of about ``SLICE`` bytes, one text at least."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False))
        a = 0
        while a < b.num_rows:
            n = max(1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE, "right")) - a)
            yield b.column(0).slice(a, n), b.column(1).slice(a, n)
            a += n


def _apart(texts: pa.Array) -> str:
    """A character that no text holds."""
    return next(c for c in map(chr, (*range(9), *range(0xE000, 0xF8FF))) if not pc.any(pc.match_substring(texts, c)).as_py())


def pieces_of(texts: pa.Array, pattern: str) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Texts without nulls cut before and after each match: the pieces, whether each is a match, its text, and its start there."""
    mark = _apart(texts)
    pieces = pc.split_pattern(pc.replace_substring_regex(texts, pattern, f"{mark}\\0{mark}"), mark)
    own, at = pieces.flatten(), pieces.offsets.to_numpy()
    at = at - at[0]
    n = np.diff(at)
    first = np.repeat(at[:-1], n)
    ends = np.cumsum(pc.utf8_length(own).to_numpy().astype(np.int64))
    begin = np.concatenate(([0], ends[:-1]))[: len(own)]
    return own, (np.arange(len(own)) - first) % 2 == 1, np.repeat(np.arange(len(n)), n), begin - begin[first]


def find(docs: DataFrame, tool: str, rules: dict[str, str], severity: str = "W", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, start, end, tool, rule, severity, output`` of every match of every rule; offsets are code points from 0.

    Texts with a match are cut by a mark set around each; the lengths of the pieces, summed once, give the places.  Null and
    empty texts have no findings.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            for rule, p in rules.items():
                hit = pc.indices_nonzero(pc.match_substring_regex(texts, p))
                if not len(hit):
                    continue
                own, inside, row, start = pieces_of(texts.take(hit), p)
                odd = np.flatnonzero(inside)
                output, start = own.take(pa.array(odd)), start[odd]
                end = start + pc.utf8_length(output).to_numpy()
                told = lambda x: pa.array([x], pa.string()).take(pa.array(np.zeros(len(odd), np.int64)))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([ids.take(hit.take(pa.array(row[odd]))), pa.array(start), pa.array(end), told(tool), told(rule), told(severity), output], names=[id_col, "start", "end", "tool", "rule", "severity", "output"])

    rows = docs.where(F.col(text_col).isNotNull()).select(id_col, text_col)
    return rows.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, start long, end long, tool string, rule string, severity string, output string")


def count(docs: DataFrame, tool: str, rules: dict[str, str], severity: str = "W", text_col: str = "text") -> DataFrame:
    """``tool, severity, n``: how many findings ``find`` has, as parts to be summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for _, texts in slices(batches):
            n += sum(pc.sum(pc.count_substring_regex(texts, p)).as_py() or 0 for p in rules.values())
        if n:
            yield pa.RecordBatch.from_pydict({"tool": [tool], "severity": [severity], "n": [n]})

    rows = docs.where(F.col(text_col).isNotNull()).select(F.lit(0).alias("_"), text_col)
    return rows.mapInArrow(run, "tool string, severity string, n long")


#: What is appended to the texts, in turn, so that every rule of a tool has something to find; ¬ is a line end, ¦ a backslash, ´ an apostrophe.
FAULTS = {
    "mark": ("¬Wait,, now.Then one,two; a\"b and ...", "¬( x ) and (so.). Cats & dogs, and / or, a > b.", "¬~5 item/s here¬, then (¬open", "¬no ; one(two) dog´ s bone,¬", "¬Nothing here.", "¬1 ..."),
    "number": ("¬12345 and 1,23 x .5 or 2.50 m.", "¬3 x 4, 1..2, 1 : 2, 5 % and 20 C.", "¬3d box, 5px wide, 1 234 m, twenty one.", "¬ 7 boxes, 007, 100 % and 9 degrees, 0,5.", "¬none"),
    "leak": ("¬.. note: x¬.. tip y¬and so .. note:: z", "¬.. _label¬-item¬1.one :ref:word :ref: `x` :ref:`open¬", "¬a<b>` :doc:`page` :doc:`C:` :doc:`/a.rst` :abbr:`X (y`", "¬``lit`` **b** *em |sub| _`t` l`_ [1]_ `d", "¬-> ---> -- ¦x <<<<<<< HEAD", "¬plain"),
    "char": ("¬� and ‘a’", "¬“b” – —", "¬中 α", "¬plain"),
    "grammar": ("¬the boss´s car and cats´-eye", "¬it is faster then light", "¬a really quickly made, more fun then", "¬fine"),
}


def faulty(tool: str) -> str:
    """A text with faults, as an expression over ``doc_id`` and ``text`` for any engine."""
    own = FAULTS[tool]
    cases = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(own))
    return f"concat(text, translate(CASE doc_id % {len(own)} {cases} END, '¬¦´', concat(chr(10), chr(92), chr(39))))"


def oracle(tool: str) -> str:
    """The same findings in DuckDB, a query per rule."""
    severity, rules = TOOLS[tool]
    one = lambda k, p: f"SELECT doc_id, '{k}' AS rule, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}') AS m FROM d"
    start = "CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT)"
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, {faulty(tool)} AS t FROM documents), r AS ({" UNION ALL ".join(one(k, p) for k, p in rules.items())}),
e AS (SELECT doc_id, rule, unnest(m) AS output, unnest(range(1, len(m) + 1)) AS i, g, m FROM r)
SELECT doc_id, {start} AS start, {start} + length(output) AS "end", '{tool}' AS tool, rule, '{severity}' AS severity, output FROM e"""
