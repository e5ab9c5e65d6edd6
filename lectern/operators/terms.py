"""Term lists: entries with flags compiled on the driver into rules, searched by pattern or by token.

An entry is a pattern, or a pair of patterns and messages.  Flags: B word boundaries, D dot matches newlines, I ignore
case, M lines, O spaces match line wraps, S stems, T tokens.  ``#`` and ``?`` begin entries that are left out;
``!IB-O: pattern`` adds and removes flags of one entry.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.dialect import WORD
from lectern.operators.sequential import _column, stem


@dataclass(frozen=True)
class Term:
    pattern: str
    message: str
    severity: str
    flags: frozenset[str]


def _listed(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def compile_terms(terms: list, flags: str = "BIO", message: str = "", severity: str = "I", prefix: str = "", suffix: str = "") -> list[Term]:
    """One rule per pattern; rules that share message and flags are joined into one alternation."""
    groups: dict[tuple, list[str]] = {}
    for entry in terms:
        patterns, told = (_listed(entry[0]), "/".join(_listed(entry[1]))) if not isinstance(entry, str) and len(entry) > 1 else (_listed(entry if isinstance(entry, str) else entry[0]), message)
        for p in patterns:
            if p[:1] in ("#", "?"):
                continue
            own = set(flags)
            if m := re.match(r"!([A-Z]*)(?:-([A-Z]*))?:\s*", p):
                own, p = (own | set(m[1])) - set(m[2] or ""), p[m.end() :]
            if "O" in own:
                p = p.replace(" ", r"\s+")
            groups.setdefault((told, frozenset(own)), []).append(p)
    out = []
    for (told, own), patterns in groups.items():
        if own & {"T", "S"}:
            out += [Term(p.replace(r"\s+", " "), told, severity, own) for p in patterns]
            continue
        switch = "".join(c for c, f in (("i", "I"), ("s", "D"), ("m", "M")) if f in own)
        edge = r"\b" if "B" in own else ""
        out.append(Term((f"(?{switch})" if switch else "") + f"{edge}{prefix}(?:{'|'.join(patterns)}){suffix}{edge}", told, severity, own))
    return out


def search(docs: DataFrame, terms: list[Term]) -> DataFrame:
    """``doc_id, output, message, severity`` of every pattern match."""
    rules = [t for t in terms if not t.flags & {"T", "S"}]
    hits = F.array(*(F.struct(F.regexp_extract_all("text", F.lit(t.pattern), 0).alias("o"), F.lit(t.message).alias("message"), F.lit(t.severity).alias("severity")) for t in rules))
    return docs.where("text is not null").select("doc_id", F.explode(hits).alias("h")).select("doc_id", F.explode("h.o").alias("output"), "h.message", "h.severity")


def _sequences(column: str, tokens: list[str], term: Term) -> Column:
    """Array of hits of one token sequence in an array of tokens."""
    size = F.lit(len(tokens))
    here = F.transform(column, lambda _, i: F.when(F.slice(F.col(column), i + 1, size) == F.array(*map(F.lit, tokens)), i))
    return F.transform(F.array_compact(here), lambda i: F.struct(i.alias("word_ix"), F.array_join(F.slice("_w", i + 1, size), " ").alias("output"), F.lit(term.message).alias("message"), F.lit(term.severity).alias("severity")))


def search_tokens(docs: DataFrame, terms: list[Term]) -> DataFrame:
    """``doc_id, word_ix, output, message, severity`` of every token sequence, met inside the row; with S, stems are compared."""
    words = docs.where("text is not null").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit(WORD), 0).alias("_w"))
    if any("S" in t.flags for t in terms):
        words = words.withColumn("_s", _column(lambda ws: [stem(w) for w in ws], "array<string>")("_w"))
    found = []
    for t in (t for t in terms if t.flags & {"T", "S"}):
        stems = "S" in t.flags
        tokens = [stem(x) if stems else x for x in t.pattern.lower().split()]
        column = "_s" if stems else "_w"
        found.append(_sequences(column, tokens, t))
    return words.select("doc_id", F.explode(F.concat(*found)).alias("h")).select("doc_id", "h.*")
