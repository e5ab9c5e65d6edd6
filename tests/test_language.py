from __future__ import annotations

import pytest
import regex

from lectern.operators import language as g
from lectern.operators import terms as t

SF = "/root/testdata/sf0.001"


def told(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_lookaround_equals_another_engine(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = []
    for r in docs.select("doc_id", "text").collect():
        for tool, rules in g.LOOKAROUND.items():
            for name, p in rules.items():
                n = sum(1 for _ in regex.finditer(p, r["text"] or ""))
                want += [(r["doc_id"], tool, name, n)] if n else []
    assert told(g.lookaround_rules(docs), "doc_id", "tool", "rule", "n") == sorted(want)


def test_a_match_has_its_guard():
    import random

    import pyarrow as pa
    import pyarrow.compute as pc

    rng = random.Random(5)
    words = ["a", "The", "really", "quickly", "more", "then", "less", "faster", "twenty", "one", "0", "00", "7", "12", "12345", "1,23", "0,5", ".5", "2.50", "100", " ", " ", " ", "\n", ",", ".", "..", ";", ",,", "(", ")", "s)", "[", "}", "!", "'", "’", "°", "%", "px", "degrees", "C", "é", "É", "世", "a (Éb"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(30_000)]
    for own in g.LOOKAROUND.values():
        for name, p in own.items():
            may = pc.match_substring_regex(pa.array(texts), g._guard(p)).to_pylist()
            has = [regex.search(p, t) is not None for t in texts]
            assert any(has) and not any(h and not m for h, m in zip(has, may, strict=True)), name
            # The rules are rare: most texts need no search by the slow engine.
            assert sum(may) < 0.6 * len(texts), name
    assert g._guard(r"\bx(?<=[a\]])(?!b(?:c|\))d)(e|[)])\1$") == r"x(?:[a\]])(?:e|[)])(?:e|[)])"
    assert [g._guard(p) for p in (r"a++", r"\s", r"(?i)a", r"[a&&b]", r"(?<n>a)\k<n>")] == [None] * 5


def test_lookaround_of_own_rules(spark):
    docs = spark.createDataFrame([(1, "abb xb\x0bc"), (2, None), (3, ""), (4, "q")], "doc_id long, text string")
    assert told(g.lookaround_rules(docs, {"t": {"r": r"(?<=a)b++", "s": r"\sc", "n": r"(?<!b)b"}}), "doc_id", "rule", "n") == [(1, "n", 2), (1, "r", 1), (1, "s", 1)]
    assert g.lookaround_rules(docs.where("doc_id > 1")).count() == 0


def test_lookaround_cases(spark):
    text = "Wait,, now. is .5 long, 12345 and 1,234 but 1,23 x; word ,and 007.\nA line a\nend. More"
    got = {(r["tool"], r["rule"]) for r in g.lookaround_rules(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).collect()}
    assert {("mark", "double"), ("number", "nozero"), ("number", "digitsep"), ("number", "digitsepless"), ("number", "zeronodot")} <= got
    assert ("number", "digitsepzero") not in got


def test_line_style(spark):
    text = "We went home. Then\nit was dark and cold\nthere. All of the\nrest slept, and dreamed\nA B. end"
    got = told(g.line_style(spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "the"), (5, "a\n\nx. y")], "doc_id long, text string")), "doc_id", "line_no", "rule", "output")
    assert got == [(1, 0, "opens_at_end", "Then"), (1, 1, "joined_at_end", "and cold"), (1, 2, "article_at_end", "the"), (1, 2, "ends_at_start", "there."), (5, 2, "ends_at_start", "x.")]


def test_positions(spark):
    docs = spark.createDataFrame([(1, "aXbbXX"), (2, None), (3, "X")], "doc_id long, text string")
    assert told(g.positions(docs, "X"), "doc_id", "start") == [(1, 1), (1, 4), (1, 5), (3, 0)]


def test_abbreviations(spark):
    docs = spark.createDataFrame([(1, "CPU (Central Processing Unit) and CPU again."), (2, "The CPU runs."), (3, "An XYZ here."), (4, "Use GPU. The Graphics Processing Unit (GPU) is fast."), (5, None)], "doc_id long, text string")
    assert told(g.abbreviations(docs), "doc_id", "acronym", "severity") == [(2, "CPU", "I"), (3, "XYZ", "W"), (4, "GPU", "I")]


def test_collocations(spark):
    lexicon = spark.createDataFrame([(w,) for w in ("sunflower", "sun", "flower", "flow", "er", "nothing")], "word string")
    assert told(g.collocations(lexicon), "word", "parts") == [("flower", "flow er"), ("sunflower", "sun flow er"), ("sunflower", "sun flower")]


@pytest.mark.parametrize("checked", [0, 1000])
def test_collocations_equal_rounds_in_one_join(spark, monkeypatch, checked):
    import random

    tables = []
    monkeypatch.setattr(g, "stored", lambda df, what, was=g.stored: tables.append(what) or was(df, what))
    monkeypatch.setattr(g, "CHECKED", checked, raising=False)
    monkeypatch.setattr(g, "WAYS_OUT", 3, raising=False)
    rng = random.Random(4)
    lexicon = sorted({"".join(rng.choice("abetü") for _ in range(rng.choice((1, 1, 2, 3, 5, 6, 8)))) for _ in range(250)} | {"un", "ad-b", "a1", "aaaaaaaaaa", "tttt", "世世世世世a", "be" * 150 + "z"})
    known = {w for w in lexicon if not regex.search(r"[-.\p{N}]", w) and w not in ("ad", "al", "de", "ed", "el", "es", "ing", "re", "un") and (len(w) >= 4 or regex.search("[aeiou]", w))}

    def ways(word, rest):
        if not rest:
            yield ()
        for k in range(1, len(rest) + 1):
            if rest[:k] in known and rest[:k] != word:
                yield from ((rest[:k], *more) for more in ways(word, rest[k:]))

    df = g.collocations(spark.createDataFrame([(w,) for w in lexicon], "word string"))
    assert told(df, "word", "parts") == sorted((w, " ".join(p)) for w in known if len(w) > 4 for p in ways(w, w)) != []
    # A table was written for each round, as many as a word has parts.
    assert tables == ["lexicon"]


def test_overuse(spark):
    text = " ".join(f"Marble w{i}a w{i}b w{i}c w{i}d w{i}e w{i}f w{i}g" for i in range(6)) + "."
    got = told(g.overuse(spark.createDataFrame([(1, text), (2, None), (3, "once")], "doc_id long, text string")), "doc_id", "word")
    assert got == [(1, "marble")]


def test_terms(spark):
    docs = spark.createDataFrame([(1, "Every very\nlong a number\nof things, running fast; ran a run fast."), (2, None), (3, "")], "doc_id long, text string")
    rules = t.compile_terms(["very", "#left out", "?too", (["a number of"], ["some", "few"])])
    assert told(t.search(docs, rules), "output", "message") == [("a number\nof", "some/few"), ("very", "")]
    case = t.compile_terms(["!-I: every"], "BI")
    assert t.search(docs, case).count() == 0
    assert told(t.search_tokens(docs, t.compile_terms(["run fast"], "S")), "output") == [("run fast",), ("running fast",)]
    assert told(t.search_tokens(docs, t.compile_terms(["run fast"], "T")), "output") == [("run fast",)]


def test_clauses_and_numbers(spark):
    docs = spark.createDataFrame([(1, "We went to the big house, they went to the small one and we all came home. No 12 or 3.5 here (with more than three spaces in)."), (2, None)], "doc_id long, text string")
    assert [r["clause"] for r in g.clauses(docs).where("sent_ix = 0").orderBy("clause_ix").collect()] == ["We went to the big house,", "they went to the small one", "and we all came home."]
    assert told(g.numbers(docs), "number") == [("12",), ("3.5",)]
    assert g.parentheses(docs).count() == 1


@pytest.mark.parametrize(("word", "norm"), [("Well-Known", "well-known"), ("CPU", "CPU"), ("It’s", "it's"), ("U.S.", "U.S.")])
def test_norm(spark, word, norm):
    from pyspark.sql import functions as F

    assert spark.range(1).select(g.norm_word(F.lit(word))).first()[0] == norm
