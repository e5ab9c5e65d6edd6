"""Regex rules compiled into one deterministic automaton.

A small regex syntax (literals, classes, groups, ``|``, ``*``, ``+``, ``?``, ``{m}``, ``{m,}``, ``{m,n}``,
``\\xHH`` and escaped characters) over bytes is parsed into a Thompson NFA.  Subset construction over byte
classes joins all rules into one DFA whose states carry the set of rules they accept; Moore partition
refinement minimises it.  The result is a transition array that scans for all rules at once.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate
from operator import getitem, itemgetter

import numpy as np

_EPS = -1
_CODE = itemgetter(256)


class _Parser:
    def __init__(self, pattern: str, edges: list[list[tuple[frozenset[int] | int, int]]]):
        self.p, self.i, self.edges = pattern, 0, edges

    def state(self) -> int:
        self.edges.append([])
        return len(self.edges) - 1

    def eps(self, a: int, b: int) -> None:
        self.edges[a].append((_EPS, b))

    def more(self) -> bool:
        return self.i < len(self.p)

    def alternation(self, start: int) -> int:
        end = self.state()
        while True:
            first = self.state()
            self.eps(start, first)
            self.eps(self.sequence(first), end)
            if not (self.more() and self.p[self.i] == "|"):
                return end
            self.i += 1

    def sequence(self, at: int) -> int:
        while self.more() and self.p[self.i] not in "|)":
            begin, self_edges = self.i, None
            out = self.atom(at)
            low, high = self.repeat()
            if (low, high) != (1, 1):
                stop = self.i
                # The atom is built again for each further copy.
                def again(frm: int) -> int:
                    self.i = begin
                    return self.atom(frm)

                if low == 0:
                    new = self.state()
                    self.eps(at, new)
                    self.eps(out, new)
                    if high is None:
                        self.eps(out, at)
                    assert high in (1, None), "optional atoms repeat at most once or without bound"
                    out = new
                else:
                    for _ in range(low - 1):
                        at, out = out, again(out)
                    if high is None:
                        self.eps(out, at)
                    else:
                        end = self.state()
                        self.eps(out, end)
                        for _ in range(high - low):
                            out = again(out)
                            self.eps(out, end)
                        out = end
                self.i = stop
            at = self.state()
            self.eps(out, at)
        return at

    def repeat(self) -> tuple[int, int | None]:
        c = self.p[self.i] if self.more() else ""
        if c and c in "*+?":
            self.i += 1
            return {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
        if c == "{":
            end = self.p.index("}", self.i)
            low, _, high = self.p[self.i + 1 : end].partition(",")
            self.i, comma = end + 1, "," in self.p[self.i : end]
            return int(low), (int(high) if high else None) if comma else int(low)
        return 1, 1

    def atom(self, at: int) -> int:
        c = self.p[self.i]
        if c == "(":
            self.i += 3 if self.p.startswith("(?:", self.i) else 1
            out = self.alternation(at)
            assert self.p[self.i] == ")", "unbalanced group"
            self.i += 1
            return out
        if c == "[":
            chars = self.char_class()
        else:
            chars = frozenset([self.char()])
        out = self.state()
        self.edges[at].append((chars, out))
        return out

    def char(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c != "\\":
            return ord(c)
        c = self.p[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))

    def char_class(self) -> frozenset[int]:
        self.i += 1
        negate = self.p[self.i] == "^"
        self.i += negate
        found: set[int] = set()
        while self.p[self.i] != "]":
            a = self.char()
            if self.p[self.i] == "-" and self.p[self.i + 1] != "]":
                self.i += 1
                found |= set(range(a, self.char() + 1))
            else:
                found.add(a)
        self.i += 1
        return frozenset(range(256)) - found if negate else frozenset(found)


@dataclass
class Dfa:
    """``table[state * 256 + byte]`` is the next state; state 0 is dead, ``start`` begins; ``accept`` is a rule bit mask."""

    table: np.ndarray
    accept: np.ndarray
    start: int


class Scanner:
    """A DFA as linked transition arrays: a state is a list of 256 next states and, last, the number of its rule mask.

    One byte is one list access, so a scan is a chain of C calls over the bytes, linear in their number.
    """

    def __init__(self, dfa: Dfa):
        masks, code = np.unique(dfa.accept, return_inverse=True)
        # No rule is number 0, whether or not a state without one exists.
        if masks[0] != 0:
            masks, code = np.r_[0, masks], code + 1
        assert len(masks) <= 256, "too many sets of rules for one byte"
        self.masks = masks
        states: list[list] = [[] for _ in dfa.accept]
        for own, row, c in zip(states, dfa.table.reshape(-1, 256).tolist(), code.tolist(), strict=True):
            own += [states[t] for t in row]
            own.append(c)
        self.dead, self.start, self.states = states[0], states[dfa.start], states

    def __del__(self):
        # The arrays refer to each other in cycles.
        for s in self.states:
            s.clear()

    def marks(self, data: bytes) -> bytes:
        """The number of the rule mask after each byte."""
        return bytes(map(_CODE, accumulate(data, getitem, initial=self.start)))[1:]

    def longest(self, data: bytes, at: int) -> int:
        """End of the longest match that begins at a position, or -1."""
        state, dead, end = self.start, self.dead, -1
        for i in range(at, len(data)):
            state = state[data[i]]
            if state is dead:
                break
            if state[256]:
                end = i + 1
        return end


def compile_rules(patterns: list[str], anywhere: bool = False, backwards: bool = False) -> Dfa:
    """One minimal DFA for all rules.

    ``anywhere``: a match may begin at each byte, so a state accepts the rules of which a match ends here;
    ``backwards``: the automaton of the reversed rules.  Together, a pass from the end of a text to its begin meets an
    accepting state wherever a match begins.
    """
    forward: list[list] = []
    starts, ends = [], []
    for pattern in patterns:
        p = _Parser(pattern, forward)
        starts.append(p.state())
        ends.append(p.alternation(starts[-1]))
        assert not p.more(), f"cannot parse {pattern!r} at {p.i}"
    edges = forward
    if backwards:
        edges = [[] for _ in forward]
        for s, out in enumerate(forward):
            for c, t in out:
                edges[t].append((c, s))
        starts, ends = ends, starts
    finals = {s: k for k, s in enumerate(ends)}
    # Bytes that no rule tells apart form one class.
    marks: dict[int, list[int]] = {b: [] for b in range(256)}
    for n, chars in enumerate({c for e in edges for c, _ in e if c != _EPS}):
        for b in chars:
            marks[b].append(n)
    classes: dict[tuple, list[int]] = {}
    for b, m in marks.items():
        classes.setdefault(tuple(sorted(m)), []).append(b)
    groups = list(classes.values())

    def closure(states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for c, t in edges[todo.pop()]:
                if c == _EPS and t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    begin = closure(set(starts))
    names, rows = {frozenset(): 0, begin: 1}, []
    queue = list(names)
    for sub in queue:
        row = []
        moves = [(c, t) for s in sub for c, t in edges[s] if c != _EPS]
        for g in groups:
            nxt = closure({t for c, t in moves if g[0] in c})
            if anywhere:
                nxt |= begin
            if nxt not in names:
                names[nxt] = len(names)
                queue.append(nxt)
            row.append(names[nxt])
        rows.append(row)
    accept = [sum(1 << finals[s] for s in sub if s in finals) for sub in names]
    # Moore: refine by accepted rules, then by successors, until nothing splits.
    block, count = list(accept), len(set(accept))
    while True:
        sig = [(block[i], tuple(block[t] for t in rows[i])) for i in range(len(rows))]
        ids: dict = {}
        block = [ids.setdefault(x, len(ids)) for x in sig]
        if len(ids) == count:
            break
        count = len(ids)
    table = np.zeros((count, 256), dtype=np.int32)
    masks = np.zeros(count, dtype=np.int64)
    for i, row in enumerate(rows):
        masks[block[i]] = accept[i]
        for g, t in zip(groups, row, strict=True):
            table[block[i], g] = block[t]
    assert block[0] == 0
    return Dfa(table.ravel(), masks, block[1])
