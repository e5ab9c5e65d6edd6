"""Secret scans with one combined deterministic automaton (operator 3).

The reversed rules are compiled, with an unanchored prefix, into a single minimised DFA (see ``automaton``).  One pass
over the bytes of a text, from its end to its begin, marks every byte at which a match of a rule begins, for all rules
at once.  The leftmost mark of a rule is then walked to the end of its longest match in the rule's own DFA, and the
marks inside a match are passed over, so the bytes of matches are read once more and all others once: time is linear
in the length of the text, whatever stands in it.

Per kind the matches are the leftmost non-overlapping longest ones.  The base kinds keep the stated forms and drop
failing matches afterwards; the kinds of ``EXTRA`` are added by this operator, and their least lengths are applied in
the same way (so no rule needs a counter in the automaton).

Defined cases: a null or empty text has no spans; repeated rows are scanned alike; an empty table gives an empty table;
other columns are ignored; offsets are code points of the whole text, end exclusive.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lectern.llm import bytescan as bs
from lectern.llm.automaton import Dfa, Scanner, compile_rules
from lectern.llm.common import documents, small_batches


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The stated base forms.
_KEYS = "|".join([*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")])
BASE = (
    ("assign", f"({_KEYS})[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9+/_.=\\-]+"),
    ("access", "AKIA[A-Z0-9]+"),
    ("hex", "[0-9a-f]+"),
)
EXTRA = (
    ("forge", "gh[pousr]_[A-Za-z0-9]+"),
    ("chat", "xox[abprs]-[A-Za-z0-9\\-]+"),
    ("cloud", "AIza[A-Za-z0-9_\\-]+"),
    ("pay", "[sr]k_live_[A-Za-z0-9]+"),
    ("jwt", "eyJ[A-Za-z0-9_\\-]+\\.[A-Za-z0-9_\\-]+\\.[A-Za-z0-9_\\-]+"),
    ("pem", "-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"),
)
RULES = (*BASE, *EXTRA)
KINDS = tuple(k for k, _ in RULES)
#: Shorter matches are dropped.
LEAST = {"access": 20, "hex": 24, "forge": 40, "chat": 15, "cloud": 39, "pay": 24, "jwt": 29}
#: Rules that are one repeated class: where their marks begin and end, a match does.
RUNS = tuple(k for k, (_, p) in enumerate(RULES) if p.startswith("[") and p.endswith("]+") and p.count("[") == 1)


@cache
def automaton() -> Dfa:
    """The combined automaton of all reversed rules."""
    return compile_rules([p for _, p in RULES], anywhere=True, backwards=True)


@cache
def rule_automata() -> tuple[Dfa, ...]:
    """The automaton of each rule, from the begin of a match."""
    return tuple(compile_rules([p]) for _, p in RULES)


class Rules:
    """The scanners of a worker."""

    def __init__(self, combined: Dfa, own: tuple[Dfa, ...]):
        self.combined, self.own = Scanner(combined), [Scanner(d) for d in own]


def _value_length(match: bytes) -> int:
    """Length of group 2 of an assignment: what follows the separator, its spaces and an opening quote."""
    at = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0) + 1
    rest = match[at:].lstrip(b" ")
    return len(rest) - (rest[:1] in (b'"', b"'"))


def _holds(kind: str, match: bytes) -> bool:
    if len(match) < LEAST.get(kind, 0):
        return False
    if kind == "assign":
        return _value_length(match) >= 6
    return kind != "jwt" or min(map(len, match[3:].split(b"."))) >= 8


def matches(s: bs.Slice, rules: Rules) -> list[tuple[int, int, int]]:
    """``(rule, start, end)`` in bytes of the slice, before failing ones are dropped (runs under their least length aside)."""
    scan = rules.combined.marks
    codes = np.frombuffer(b"".join(scan(s.text(i)[::-1])[::-1] for i in range(s.n)), np.uint8)
    masks, found = rules.combined.masks, []
    rest = np.ones(len(masks), dtype=bool)
    rest[0] = False
    for k in RUNS:
        has = (masks >> k) & 1 == 1
        rest &= masks != 1 << k
        inside = has[codes]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        # Runs of neighbouring documents are apart.
        edge = s.off[(s.off > 0) & (s.off < len(codes))]
        first[edge], last[edge - 1] = inside[edge], inside[edge - 1]
        a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
        long = b - a >= LEAST.get(KINDS[k], 0)
        found += [(k, x, y) for x, y in zip(a[long].tolist(), b[long].tolist(), strict=True)]
    at = np.flatnonzero(rest[codes])
    doc = np.searchsorted(s.off, at, side="right") - 1
    texts: dict[int, bytes] = {}
    done = [0] * len(KINDS)
    for p, d, m in zip(at.tolist(), doc.tolist(), masks[codes[at]].tolist(), strict=True):
        for k in range(len(KINDS)):
            if m >> k & 1 and k not in RUNS and p >= done[k]:
                if d not in texts:
                    texts = {d: s.text(d)}
                base = int(s.off[d])
                done[k] = base + rules.own[k].longest(texts[d], p - base)
                found.append((k, p, done[k]))
    return found


def find_spans(s: bs.Slice, rules: Rules | None = None) -> dict[int, list[tuple[str, int, int]]]:
    """Document index to its spans (kind, start, end) in code points, by start and then kind."""
    if not len(s.data):
        return {}
    out: dict[int, list[tuple[str, int, int]]] = {}
    for k, a, b in matches(s, rules or Rules(automaton(), rule_automata())):
        if _holds(KINDS[k], s.data[a:b].tobytes()):
            out.setdefault(int(np.searchsorted(s.off, a, side="right")) - 1, []).append((KINDS[k], a, b))
    for d, spans in out.items():
        last, points, at = int(s.off[d]), {}, 0
        for p in sorted({p for _, a, b in spans for p in (a, b)}):
            at += int((~bs.CONT[s.data[last:p]]).sum())
            points[p], last = at, p
        out[d] = sorted(((k, points[a], points[b]) for k, a, b in spans), key=lambda x: (x[1], KINDS.index(x[0])))
    return out


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, the digest of the base spans and all spans joined."""
    small_batches(docs.sparkSession)
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    base = {k for k, _ in BASE}
    # The transition arrays are built once, on the driver; their size is that of the rules.
    combined, own = automaton(), rule_automata()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Rules(combined, own)
        join = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        none = hashlib.sha256(b"").hexdigest()
        for b in batches:
            for s in bs.slices(b.column(1)):
                found = find_spans(s, rules)
                counts = {k: np.zeros(s.n, dtype=np.int64) for k in base}
                sha, text = [none] * s.n, [""] * s.n
                for d, spans in found.items():
                    for k, _, _ in spans:
                        if k in base:
                            counts[k][d] += 1
                    sha[d] = hashlib.sha256(join(x for x in spans if x[0] in base).encode()).hexdigest()
                    text[d] = join(spans)
                cols = [b.column(0).slice(s.first, s.n), *(pa.array(counts[k]) for k in ("assign", "access", "hex")), pa.array(sha), pa.array(text)]
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir))


def _sql() -> str:
    """The same spans from an engine's regexes: the pieces between matches give their places."""
    rules = ", ".join(f"({n}, '{k}', '{p.replace(chr(39), chr(39) * 2)}')" for n, (k, p) in enumerate(RULES))
    least = " ".join(f"WHEN '{k}' THEN length(hit) >= {n}" for k, n in LEAST.items() if k != "jwt")
    value = "regexp_extract(hit, '^[^:=]*[:=] *[\"'']?(.*)$', 1)"
    return f"""
WITH rules(ord, kind, pat) AS (VALUES {rules}),
t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT rid, ord, kind, string_split_regex(text, pat) AS gaps, regexp_extract_all(text, pat) AS hits FROM t, rules WHERE regexp_matches(text, pat)),
u AS (SELECT rid, ord, kind, unnest(hits) AS hit, unnest(range(1, len(hits) + 1)) AS i, gaps, hits FROM m),
s AS (SELECT rid, ord, kind, hit, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a FROM u
  WHERE CASE kind {least} WHEN 'assign' THEN length({value}) >= 6 WHEN 'jwt' THEN list_min(list_transform(string_split(hit[4:], '.'), lambda x: length(x))) >= 8 ELSE true END),
g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || a || ':' || (a + length(hit)), ',' ORDER BY a, ord) FILTER (ord < 3) AS base, string_agg(kind || ':' || a || ':' || (a + length(hit)), ',' ORDER BY a, ord) AS spans FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g USING (rid)"""


ORACLE = _sql()
