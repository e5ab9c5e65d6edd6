"""Pattern, list and sentence rules on small texts with known findings."""

from __future__ import annotations

import re

import pytest

from lectern.operators import findings as f
from lectern.operators import sentences as s


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def told(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_findings_have_places(spark):
    texts = ["Wait,, now", "é, two,x y", None, "", "a & b & c"]
    got = f.find(docs(spark, *texts), "mark", f.MARK).collect()
    assert {(r["doc_id"], r["rule"], r["start"]) for r in got} >= {(0, "doubled", 4), (1, "no_space_after_comma", 6), (4, "ampersand", 1), (4, "ampersand", 5)}
    assert all(texts[r["doc_id"]][r["start"] : r["end"]] == r["output"] for r in got)


def test_every_rule_finds_its_fault(spark):
    for tool, (_, rules) in f.TOOLS.items():
        made = docs(spark, *(["x."] * len(f.FAULTS[tool]))).selectExpr("doc_id", f"{f.faulty(tool)} as text")
        assert {r["rule"] for r in f.find(made, tool, rules).collect()} == set(rules), tool


def test_places_of_many_matches_in_one_text(spark):
    import time

    n = 20_000
    df = docs(spark, "é & b " * n, "x", None)
    f.find(docs(spark, "a & b"), "mark", {"ampersand": f.MARK["ampersand"]}).collect()
    began = time.time()
    got = told(f.find(df, "mark", {"ampersand": f.MARK["ampersand"]}), "start", "end", "output")
    assert got == [(6 * i + 1, 6 * i + 4, " & ") for i in range(n)]
    # Summing the pieces before each match anew took time by the square of the matches.
    assert time.time() - began < 8


def test_places_equal_another_engine_and_counts(spark, monkeypatch):
    import regex

    monkeypatch.setattr(f, "SLICE", 50)
    texts = ["", None, "\x00a & b\x01 & c, d,e", "\ue000,,;x", *(chr(i) + " and, or (x )" for i in range(9)), *("x." + t.replace("¬", "\n").replace("¦", "\\").replace("´", "'") for own in f.FAULTS.values() for t in own), "é" * 60 + " 世 & 界,,"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "name string, words string").coalesce(1)
    for tool, (severity, rules) in f.TOOLS.items():
        as_python = lambda p: regex.sub(r"\\x\{([0-9A-F]+)\}", lambda m: "\\u" + m[1], p)
        want = [(str(i), m.start(), m.end(), k, m[0]) for i, t in enumerate(texts) for k, p in rules.items() for m in regex.finditer(as_python(p), t or "")]
        assert told(f.find(df, tool, rules, severity, "name", "words"), "name", "start", "end", "rule", "output") == sorted(want), tool
        assert sum(r["n"] for r in f.count(df, tool, rules, severity, "words").collect()) == len(want)


@pytest.mark.parametrize(("text", "count"), [("12345 and 1,234", 1), ("is .5 long", 1), ("in 2020", 1), ("12 x 4", 1)])
def test_number_cases(spark, text, count):
    assert f.find(docs(spark, text), "number", f.NUMBER).where("rule in ('no_separator', 'no_leading_zero', 'times')").count() == count


def test_article(spark):
    texts = ["a apple", "an house", "an hour", "a university", "an 3 item", "an unintended move", "a X ray", "an UK law", "a one", "an MRI", "A. Apple", None, "a"]
    assert told(s.article(docs(spark, *texts)), "doc_id", "follower") == [(0, "apple"), (1, "house"), (4, "3"), (6, "X"), (7, "UK")]


def test_passive(spark):
    texts = ["It was taken away.", "They are often here.", "It got hurt.", "was. taken", "be seven", None]
    assert told(s.passive(docs(spark, *texts)), "doc_id", "sent_ix", "word_ix", "participle") == [(0, 0, 1, "taken"), (2, 0, 1, "hurt")]


def test_overuse_equals_loops(spark):
    words = ["Marble", "stone", "and", "river", "marble", "lights"]
    text = " ".join(words[(i * i + i // 7) % 6] for i in range(400)) + ". Once."
    at: dict[str, list[int]] = {}
    for i, w in enumerate(re.findall("[A-Za-z]+", text)):
        at.setdefault(w.lower(), []).append(i)
    score = {w: sum(5625 - (b - a - 5) ** 2 for a, b in zip(x, x[1:]) if 6 <= b - a <= 80) for w, x in at.items() if len(w) > 3}
    assert told(s.overuse_simple(docs(spark, text, None, "")), "word", "score") == sorted((w, n) for w, n in score.items() if n > 11250)


def test_hyphen_variants(spark):
    rows = ["on-line " * 8 + "online " * 3, "re-use " + "reuse " * 9, "by-pass", "well-known " * 7]
    assert told(s.hyphen_variants(docs(spark, *rows)), "word", "n_hyphen", "n_joined", "spaced") == [("on-line", 8, 3, "on line"), ("well-known", 7, 0, "well known")]


def test_page_name(spark):
    rows = [("http://x/move_rotate.html", "<h1>Unrelated Words Here</h1>"), ("/a/move-rotate", "<h1>Move the Tool</h1>"), ("cpu.rst", "<h1>Central Processing Unit</h1>"), ("x", None), ("y", "<h1></h1>")]
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    assert told(s.page_name(pages), "page_id", "name", "n_shared") == [(0, "move_rotate", 0)]


def test_paragraphs_end_at_blank_lines(spark, tmp_path):
    from lectern.functions.dialect import spark_frame

    spark.sql("SELECT 1L AS doc_id, 'One.\\nTwo\\nthree.\\nFour.' AS text").write.mode("overwrite").parquet(base := f"{tmp_path}/documents.parquet")
    got = spark_frame(spark, base.rpartition("/")[0], "SELECT para_ix, para FROM paragraphs")
    assert told(got, "para_ix", "para") == [(0, "One."), (1, "Two\nthree."), (2, "Four.")]
