"""reStructuredText as a relation of nodes with positions.

``parse`` turns one text into a list of ``Node``; ``nodes`` does so for every row of a table, in Arrow batches and
without a shuffle, as documents do not depend on each other.  Blocks are found by recursive descent over dedented
lines, each of which knows its place in the whole text; inline nodes by one scanning pattern over the text of a
paragraph, title, head or table cell.

Sections are flat (a heading is a node beside what follows it).  Not handled: row spans of tables, roman
enumerators, definition classifiers.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, fields
from operator import attrgetter

import pyarrow as pa
from pyspark.sql import DataFrame

#: Directives and roles whose body is no markup.
VERBATIM = ("code-block", "code", "sourcecode", "math", "literal", "raw", "parsed-literal", "highlight", "productionlist")
#: Directives whose head is a path or an option, not prose.
PLAIN_HEAD = (*VERBATIM, "image", "figure", "include", "literalinclude", "index", "toctree", "only", "video", "youtube", "vimeo", "default-role", "csv-table", "unicode")

NO_PROSE = ("comment", "doctest", "target", "literal", "standalone")
NO_PROSE_NAMES = (*VERBATIM, "default", "include", "index", "toctree", "video", "image", "unicode", "kbd")

_PUNCT = r"[!-/:-@\[-`{-~]"
_RULE = re.compile(rf"^({_PUNCT})\1{{1,}}\s*$")
_EXPLICIT = re.compile(r"^\.\.(?:[ ]+|$)")
_TARGET = re.compile(r"^_((?:`[^`]+`|(?:\\:|[^:])+)):(?:[ ]+(.*)|$)")
_ANONYMOUS = re.compile(r"^(?:__:|__)(?:[ ]+(.*)|$)")
_FOOT = re.compile(r"^\[(\#[\w.\-]*|\*|\d+)\](?:[ ]+|$)")
_CIT = re.compile(r"^\[([\w][\w.\-]*)\](?:[ ]+|$)")
_SUBST = re.compile(r"^\|([^|\s](?:[^|]*[^|\s])?)\|[ ]+([\w\-.:+]+)::(?:[ ]+(.*)|$)")
_DIRECTIVE = re.compile(r"^([\w][\w\-.:+]*?)::(?:[ ]+(.*)|$)")
_ITEM = {
    "bullet": re.compile(r"^([*+\-•])(?:[ ]+|$)"),
    "enum": re.compile(r"^(\(?(?:#|\d+|[A-Za-z])[.)])(?:[ ]+|$)"),
    "field": re.compile(r"^:((?:\\:|[^:`\s]|[^:`\s](?:\\:|[^:`])*[^:`\s])):(?:[ ]+|$)"),
    "option": re.compile(r"^((?:--?[\w\-]+|/\w)(?:[ =]?<?\w+>?)?(?:, (?:--?[\w\-]+|/\w)(?:[ =]?<?\w+>?)?)*)(?:[ ]{2,}|$)"),
    "line": re.compile(r"^(\|)(?:[ ]+|$)"),
}
_GRID = re.compile(r"^\+(?:[-=]+\+)+\s*$")
_SIMPLE = re.compile(r"^=+(?:[ ]+=+)+\s*$")
_OPEN, _SHUT = r"(?<![\w\\`*|])", r"(?![\w])"
_INLINE = re.compile(
    "|".join((
        rf"(?P<literal>{_OPEN}``(?P<literal_b>\S(?:.*?\S)?)``{_SHUT})",
        rf"(?P<strong>{_OPEN}\*\*(?P<strong_b>\S(?:.*?\S)?)\*\*{_SHUT})",
        rf"(?P<emphasis>{_OPEN}\*(?P<emphasis_b>[^\s*](?:[^*]*[^\s*])?)\*{_SHUT})",
        rf"(?P<inttarget>{_OPEN}_`(?P<inttarget_b>[^`]+)`{_SHUT})",
        rf"(?P<front>(?<![\w\\`]):(?P<front_n>[\w][\w\-.:+]*):`(?P<front_b>[^`]*)`{_SHUT})",
        rf"(?P<back>{_OPEN}`(?P<back_b>[^`]+)`:(?P<back_n>[\w][\w\-.+]*):{_SHUT})",
        rf"(?P<hyperlink>{_OPEN}`(?P<hyperlink_b>[^`]+)`(?P<hyperlink_n>__?){_SHUT})",
        rf"(?P<default>{_OPEN}`(?P<default_b>[^`]+)`{_SHUT})",
        rf"(?P<subst>{_OPEN}\|(?P<subst_b>[^|\s](?:[^|]*[^|\s])?)\|_{{0,2}}{_SHUT})",
        rf"(?P<foot>\[(?P<foot_b>#[\w.\-]*|\*|\d+)\]_{_SHUT})",
        rf"(?P<cit>\[(?P<cit_b>[A-Za-z][\w.\-]*)\]_{_SHUT})",
        r"(?P<standalone>(?<![\w`<])(?:https?|ftp|mailto):[^\s<>`\"]*[^\s<>`\".,;:!?)\]}'])",
        r"(?P<mail>(?<![\w.+\-/])[\w.+\-]+@[\w\-]+(?:\.[\w\-]+)+)",
        rf"(?P<reference>(?<![\w`_\-.:/])(?P<reference_b>[A-Za-z][\w\-.]*[A-Za-z0-9]|[A-Za-z])(?P<reference_n>__?)(?![\w`]))",
    )),
    re.S,
)
#: What every inline node has: without it a text is not scanned.
_SIGN = re.compile(r"[`*|@]|_(?!\w)|(?:https?|ftp|mailto):")
_KIND = {"inttarget": "int-target", "front": "role", "back": "role", "default": "role", "mail": "standalone", "reference": "hyperlink"}
_TITLED = re.compile(r"^(.*?)\s*<([^<>]+)>$", re.S)
_EXPLAINED = re.compile(r"^(.*?)\s*\((.+)\)$", re.S)
#: Roles whose body may be ``title <target>``.
LINKING = ("doc", "ref", "term", "any", "download", "numref")


@dataclass
class Node:
    node_id: int
    parent_id: int
    kind: str
    name: str | None
    id: str | None
    head: str | None
    depth: int
    sib_ix: int
    start: int
    end: int
    start_line: int
    start_col: int
    indent: int
    body: str | None
    extra: str | None
    parent_kind: str | None = None
    parent_name: str | None = None
    #: Kinds of the children, and names of the directives around, each comma-joined.
    child_kinds: str = ""
    within: str = ""
    #: Whether the text is prose: not inside code, comments, targets, paths or literals.
    prose: bool = True
    #: Blank lines right above.
    blank_over: int = 0


#: Of ``Node``: ``extra`` is the underline (and a space and the overline) of a section, the marker of an item, the
#: form of an inline link, or the options of a directive, one to a line.
SCHEMA = "node_id int, parent_id int, kind string, name string, id string, head string, depth int, sib_ix int, start int, end int, start_line int, start_col int, indent int, body string, extra string, parent_kind string, parent_name string, child_kinds string, within string, prose boolean, blank_over int"


@dataclass(frozen=True)
class Line:
    text: str
    pos: int
    no: int
    col: int

    def cut(self, n: int) -> Line:
        """Without the first n characters, or those there are."""
        n = min(n, len(self.text))
        return Line(self.text[n:], self.pos + n, self.no, self.col + n)

    @property
    def blank(self) -> bool:
        return not self.text.strip()

    @property
    def indent(self) -> int:
        return len(self.text) - len(self.text.lstrip(" "))

    @property
    def end(self) -> int:
        return self.pos + len(self.text)


def _lines(text: str) -> list[Line]:
    out, pos = [], 0
    for no, raw in enumerate(text.split("\n")):
        out.append(Line(raw, pos, no, 0))
        pos += len(raw) + 1
    return out


def _trim(lines: list[Line]) -> list[Line]:
    a, b = 0, len(lines)
    while a < b and lines[a].blank:
        a += 1
    while b > a and lines[b - 1].blank:
        b -= 1
    return lines[a:b]


def _dedent(lines: list[Line]) -> list[Line]:
    n = min((x.indent for x in lines if not x.blank), default=0)
    return [x.cut(n) for x in lines]


class _Parser:
    def __init__(self) -> None:
        self.out: list[Node] = []
        self.children: dict[int, int] = {}

    def add(self, parent: int, kind: str, lines: list[Line], name=None, ident=None, head=None, body=None, extra=None, span=None, at: Line | None = None) -> int:
        first, last = at or lines[0], lines[-1]
        start, end = span or (first.pos, last.end)
        sib = self.children.get(parent, 0)
        self.children[parent] = sib + 1
        depth = self.out[parent].depth + 1 if parent >= 0 else 0
        self.out.append(Node(len(self.out), parent, kind, name, ident, head, depth, sib, start, end, first.no, first.col, first.col, body, extra))
        return len(self.out) - 1

    def inline(self, parent: int, lines: list[Line]) -> None:
        text = "\n".join(x.text for x in lines)
        if not _SIGN.search(text):
            return
        offsets, at = [], 0
        for x in lines:
            offsets.append(at)
            at += len(x.text) + 1

        def place(i: int) -> tuple[int, Line, int]:
            k = bisect_right(offsets, i) - 1
            return lines[k].pos + i - offsets[k], lines[k], i - offsets[k]

        for m in _INLINE.finditer(text):
            which = m.lastgroup if m.lastgroup in _INLINE.groupindex and "_" not in m.lastgroup else next(k for k in _INLINE.groupindex if "_" not in k and m[k] is not None)
            kind = _KIND.get(which, which)
            body = m.groupdict().get(f"{which}_b") or m[0] if which != "front" else m["front_b"]
            name = m.groupdict().get(f"{which}_n") if kind == "role" else None
            if which == "default":
                name = "default"
            form = m.groupdict().get(f"{which}_n") if kind == "hyperlink" else None
            head, ident = body, None
            if kind == "hyperlink" or (kind == "role" and name in LINKING):
                if t := _TITLED.match(body):
                    head, ident = t[1], t[2]
                elif kind == "role":
                    head, ident = None, body
                else:
                    ident = body
            elif kind == "role" and name == "abbr" and (t := _EXPLAINED.match(body)):
                head, ident = t[1], t[2]
            (start, line, inner), (last, _, _) = place(m.start()), place(m.end() - 1)
            self.add(parent, kind, [line], name, ident, head, body, form, (start, last + 1), line.cut(inner))

    def verbatim_after(self, lines: list[Line], i: int) -> int:
        """End of the indented (or quoted) block that begins after line i."""
        j = i
        while j < len(lines) and (lines[j].blank or lines[j].indent > 0):
            j += 1
        while j > i and lines[j - 1].blank:
            j -= 1
        return j

    def blocks(self, lines: list[Line], parent: int) -> None:
        i, n = 0, len(lines)
        while i < n:
            here = lines[i]
            if here.blank:
                i += 1
                continue
            for step in (self.explicit, self.section, self.table, self.doctest, self.items, self.quote, self.definition):
                if (j := step(lines, i, parent)) > i:
                    i = j
                    break
            else:
                i = self.paragraph(lines, i, parent)

    def explicit(self, lines: list[Line], i: int, parent: int) -> int:
        here = lines[i]
        if here.text.startswith("__ "):
            self.add(parent, "target", [here], "anonymous", here.text[3:].strip() or None)
            return i + 1
        if not (m := _EXPLICIT.match(here.text)):
            return i
        end = self.verbatim_after(lines, i + 1)
        own, first = lines[i:end], here.cut(m.end())
        rest = first.text
        if t := _TARGET.match(rest):
            self.add(parent, "target", own, "internal" if not (t[2] or len(own) > 1) else "external", t[1].strip("`").replace("\\:", ":"), body=(t[2] or "\n".join(x.text.strip() for x in own[1:])) or None)
            return end
        if t := _ANONYMOUS.match(rest):
            self.add(parent, "target", own, "anonymous", None, body=t[1])
            return end
        for kind, pattern in (("footdef", _FOOT), ("citdef", _CIT)):
            if t := pattern.match(rest):
                k = self.add(parent, kind, own, ident=t[1])
                self.blocks([first.cut(t.end()), *_dedent(own[1:])], k)
                return end
        if t := _SUBST.match(rest):
            k = self.add(parent, "substdef", own, t[2], t[1], t[3], "\n".join(x.text for x in _dedent(own[1:])) or t[3])
            if t[3] and t[2] == "replace":
                self.inline(k, [first.cut(t.start(3))])
            return end
        if t := _DIRECTIVE.match(rest):
            self.directive(own, parent, t[1], first.cut(t.start(2)) if t[2] else None)
            return end
        self.add(parent, "comment", own, body="\n".join([rest, *(x.text.strip() for x in own[1:])]).strip())
        return end

    def directive(self, own: list[Line], parent: int, name: str, head: Line | None) -> None:
        inner = _dedent(own[1:])
        heads, k = ([head] if head else []), 0
        while heads and k < len(inner) and not inner[k].blank and not _ITEM["field"].match(inner[k].text):
            heads.append(inner[k])
            k += 1
        options = []
        while k < len(inner) and _ITEM["field"].match(inner[k].text):
            options.append(inner[k].text.strip())
            k += 1
        body = _trim(inner[k:])
        indent = str(min((x.indent for x in own[1:] if not x.blank), default=0))
        node = self.add(parent, "dir", own, name, None, "\n".join(x.text for x in heads) or None, "\n".join(x.text for x in body) or None, "\n".join([f"indent={indent}", *options]))
        if heads and name not in PLAIN_HEAD:
            self.inline(node, heads)
        if body and name not in (*VERBATIM, "toctree", "index"):
            self.blocks(_dedent(body), node)

    def section(self, lines: list[Line], i: int, parent: int) -> int:
        here = lines[i]
        after = lines[i + 1].text if i + 1 < len(lines) else ""
        if m := _RULE.match(here.text):
            third = lines[i + 2].text if i + 2 < len(lines) else ""
            if after.strip() and (u := _RULE.match(third)) and u[1] == m[1] and not _RULE.match(after):
                title = lines[i + 1]
                k = self.add(parent, "sect", lines[i : i + 3], title.text.strip(), extra=f"{third.strip()} {here.text.strip()}", body=title.text.rstrip())
                self.inline(k, [title.cut(title.indent)])
                return i + 3
            if len(here.text.strip()) >= 4 and not after.strip() and not _GRID.match(here.text):
                self.add(parent, "trans", [here], extra=here.text.strip())
                return i + 1
            return i
        if after and here.indent == 0 and (u := _RULE.match(after)) and (len(after.strip()) >= len(here.text.rstrip()) or (len(after.strip()) >= 3 and after.strip() not in ("...", ":::"))):
            k = self.add(parent, "sect", lines[i : i + 2], here.text.strip(), extra=after.strip(), body=here.text.rstrip())
            self.inline(k, [here])
            return i + 2
        return i

    def table(self, lines: list[Line], i: int, parent: int) -> int:
        here = lines[i]
        if _GRID.match(here.text):
            j = i
            while j < len(lines) and lines[j].text[:1] in ("+", "|") and lines[j].text:
                j += 1
            k = self.add(parent, "grid-table", lines[i:j])
            group: list[Line] = []
            for x in lines[i + 1 : j]:
                if not _GRID.match(x.text):
                    group.append(x)
                elif group:
                    edges = [c for c, ch in enumerate(group[0].text) if ch == "|" and all(c < len(g.text) and g.text[c] in "|+" for g in group)]
                    row = self.add(k, "row", group)
                    for a, b in zip(edges, edges[1:], strict=False):
                        self.cell(row, [Line(g.text[a + 1 : b], g.pos + a + 1, g.no, g.col + a + 1) for g in group])
                    group = []
            return j
        if _SIMPLE.match(here.text):
            rules = [j for j in range(i, len(lines)) if _SIMPLE.match(lines[j].text)]
            ends = [j for j in rules[1:] if j + 1 >= len(lines) or lines[j + 1].blank]
            if not ends:
                return i
            last = ends[0]
            k = self.add(parent, "simple-table", lines[i : last + 1])
            columns = [m.start() for m in re.finditer("=+", here.text)]
            group = []
            for x in [*lines[i + 1 : last + 1], None]:
                new = x is None or _SIMPLE.match(x.text) or x.blank or x.text[: columns[1]].strip()
                if new and group:
                    row = self.add(k, "row", group)
                    for a, b in zip(columns, [*columns[1:], None], strict=True):
                        self.cell(row, [Line(g.text[a:b], g.pos + min(a, len(g.text)), g.no, g.col + a) for g in group])
                    group = []
                if x is not None and not x.blank and not _SIMPLE.match(x.text):
                    group.append(x)
            return last + 1
        return i

    def cell(self, row: int, lines: list[Line]) -> None:
        body = _trim(_dedent([Line(x.text.rstrip(), x.pos, x.no, x.col) for x in lines]))
        k = self.add(row, "cell", body or lines[:1], body="\n".join(x.text for x in body) or None)
        self.blocks(body, k)

    def doctest(self, lines: list[Line], i: int, parent: int) -> int:
        if not lines[i].text.startswith(">>> "):
            return i
        j = i
        while j < len(lines) and not lines[j].blank:
            j += 1
        self.add(parent, "doctest", lines[i:j], body="\n".join(x.text for x in lines[i:j]))
        return j

    def items(self, lines: list[Line], i: int, parent: int) -> int:
        kind = next((k for k, p in _ITEM.items() if p.match(lines[i].text)), None)
        if kind is None:
            return i
        found, j = [], i
        while j < len(lines) and (m := _ITEM[kind].match(lines[j].text)) and (kind != "bullet" or m[1] == lines[i].text[0]):
            # Text right under an enumerator-like word is a paragraph.
            if kind == "enum" and j + 1 < len(lines) and not lines[j + 1].blank and lines[j + 1].indent == 0 and not _ITEM["enum"].match(lines[j + 1].text):
                break
            stop = self.verbatim_after(lines, j + 1)
            found.append((j, stop, m))
            j = stop
            while j < len(lines) and lines[j].blank:
                j += 1
        if not found:
            return i
        k = self.add(parent, f"{kind}-list", lines[i : found[-1][1]])
        for a, stop, m in found:
            own, first = lines[a:stop], lines[a].cut(m.end())
            node = self.add(k, kind, own, m[1] if kind in ("field", "option") else None, extra=m[1], body="\n".join([first.text, *(x.text for x in _dedent(own[1:]))]).strip() or None)
            self.blocks(([] if first.blank else [first]) + _dedent(own[1:]), node)
        return found[-1][1]

    def quote(self, lines: list[Line], i: int, parent: int) -> int:
        if lines[i].indent == 0:
            return i
        j = self.verbatim_after(lines, i)
        k = self.add(parent, "block-quote", lines[i:j])
        self.blocks(_dedent(lines[i:j]), k)
        return j

    def definition(self, lines: list[Line], i: int, parent: int) -> int:
        found, j = [], i
        while j + 1 < len(lines) and not lines[j].blank and lines[j].indent == 0 and not lines[j + 1].blank and lines[j + 1].indent > 0 and not _EXPLICIT.match(lines[j].text):
            stop = self.verbatim_after(lines, j + 1)
            found.append((j, stop))
            j = stop
            while j < len(lines) and lines[j].blank:
                j += 1
        if not found:
            return i
        k = self.add(parent, "def-list", lines[i : found[-1][1]])
        for a, stop in found:
            inner = _dedent(lines[a + 1 : stop])
            node = self.add(k, "def", lines[a:stop], head=lines[a].text.strip(), body="\n".join(x.text for x in inner))
            self.inline(node, [lines[a]])
            self.blocks(inner, node)
        return found[-1][1]

    def paragraph(self, lines: list[Line], i: int, parent: int) -> int:
        j = i + 1
        while j < len(lines) and not lines[j].blank:
            j += 1
        own = lines[i:j]
        text = "\n".join(x.text for x in own)
        k = self.add(parent, "text", own, body=text)
        self.inline(k, own)
        if text.rstrip().endswith("::"):
            a = j
            while a < len(lines) and lines[a].blank:
                a += 1
            end = self.verbatim_after(lines, a)
            if a < len(lines) and end == a and re.match(_PUNCT, lines[a].text):
                while end < len(lines) and lines[end].text[:1] == lines[a].text[0]:
                    end += 1
            if end > a:
                self.add(parent, "dir", lines[a:end], "default", body="\n".join(x.text for x in lines[a:end]))
                return end
        return j


def parse(text: str | None) -> list[Node]:
    """Nodes of a text in document order, the root first; a null text has only the root."""
    lines = _lines(text or "")
    p = _Parser()
    p.add(-1, "document", lines)
    p.blocks(lines, 0)
    kinds: dict[int, list[str]] = {}
    for n in p.out:
        over = p.out[n.parent_id] if n.node_id else None
        if over:
            n.parent_kind, n.parent_name = over.kind, over.name
            n.within = ",".join(x for x in (over.within, over.name if over.kind == "dir" else "") if x)
            n.prose = over.prose
            kinds.setdefault(over.node_id, []).append(n.kind)
        n.prose = n.prose and n.kind not in NO_PROSE and not (n.kind in ("dir", "role", "substdef") and n.name in NO_PROSE_NAMES)
        while n.start_line > n.blank_over and lines[n.start_line - 1 - n.blank_over].blank:
            n.blank_over += 1
    for n in p.out:
        n.child_kinds = ",".join(kinds.get(n.node_id, ()))
    return p.out


#: Nodes, and characters of their strings, that a worker gives out at once.
NODES_OUT, CHARS_OUT = 4000, 2_000_000


def nodes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All nodes of all rows; ``id_col`` names the document.

    A worker reads a batch's texts one by one and gives its nodes out in small pieces, so its memory does not grow with the batch.
    """
    names = [f.name for f in fields(Node)]
    values = attrgetter(*names)
    types = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    kinds = [types[x.split()[1]] for x in SCHEMA.split(", ")]
    texts = [i for i, t in enumerate(kinds, 1) if t == pa.string()]

    def piece(rows: list[tuple], ident: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (ident, *kinds), strict=True)], names=[id_col, *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for ident, text in zip(b.column(0), b.column(1), strict=True):
                own = ident.as_py()
                for n in parse(text.as_py()):
                    rows.append(row := (own, *values(n)))
                    size += sum(len(row[i]) for i in texts if row[i])
                    if len(rows) >= NODES_OUT or size >= CHARS_OUT:
                        yield piece(rows, b.schema.field(0).type)
                        rows, size = [], 0
            if rows:
                yield piece(rows, b.schema.field(0).type)

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, {SCHEMA}")
