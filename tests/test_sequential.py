from __future__ import annotations

import pytest

from lectern.operators import sequential as s


# Examples given in the published description of the stemmer.
@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("triplicate", "triplic"), ("hopeful", "hope"), ("revival", "reviv"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("is", "is")])
def test_stem(word, stem):
    assert s.stem(word) == stem


def test_pairs():
    assert s.unclosed("(a [b) c\n") == [3] and s.unclosed(None) == [] and s.unclosed("a)") == [1]


def test_edits():
    assert s.apply_edits("0123456789", [(0, 5, "A"), (3, 8, "B"), (8, 9, "C"), (8, 9, "C")]) == ("A567C9", 2, 1)


def test_reflow():
    text = "word " * 60
    out = s.reflow(text)
    assert out.split() == text.split() and max(map(len, out.split("\n"))) < 110


def test_reflow_equals_textwrap(monkeypatch):
    import random
    import textwrap

    def plain(paragraph, widths=range(70, 110)):
        if not paragraph or len(paragraph) < widths.start:
            return paragraph
        best = None
        for width in widths:
            lines = textwrap.wrap(" ".join(paragraph.split()), width, break_long_words=False, break_on_hyphens=False)
            longest = max(map(len, lines))
            cost = sum((longest - len(x)) ** 2 for x in lines[:-1]) / max(1, len(lines) - 1)
            if best is None or cost < best[0]:
                best = (cost, lines)
        return "\n".join(best[1])

    monkeypatch.setattr(s, "REFLOW_SLICE", 3000)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("ab-é\u00ad世") for _ in range(rng.choice((1, 2, 3, 5, 8, 13, 69, 70, 71, 109, 110, 400))))
    texts = [None, "", "short", "x" * 300, *(rng.choice((" ", "  ", "\t", "\u00a0")).join(word() for _ in range(rng.randint(1, 60))) for _ in range(60)), *("word " * n for n in (14, 15, 22, 400))]
    assert s.reflow_all(texts) == [plain(t) for t in texts]
    # A long word makes sums beyond 2**53; a paragraph of spaces has no lines.
    huge = "a " * 60_000 + "b" * 3_000_000 + " c" * 60
    assert s.reflow(huge) == plain(huge) and s.reflow(" " * 80) == ""


def test_reflow_of_many_paragraphs_is_quick():
    import time

    began = time.process_time()
    s.reflow_all(["some words of a line that is wrapped " * 20] * 6000)
    # By textwrap 300 of them took 1.26 s, so 6000 about 25.
    assert time.process_time() - began < 8


def test_suggestions_are_those_of_the_whole_lexicon(spark, monkeypatch):
    import difflib
    import random

    monkeypatch.setattr(s, "SUGGEST_BLOCK", 40)
    rng = random.Random(2)
    known = ["quality", "uncomfortable", "comfort", *{"".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(200)}]
    words = ["kwality", "uncomfort", "zzz", *known[:60]]
    frame = lambda x: spark.createDataFrame([(w,) for w in x], "word string")
    got = {r["word"]: r["suggestions"] for r in s.suggestions(frame(words), frame(known)).collect()}
    assert got["kwality"][0] == "quality" and "uncomfortable" in got["uncomfort"]
    for w in words:
        assert got.get(w, []) == difflib.get_close_matches(w, [k for k in known if k != w], 5, 0.6)


def test_closest_equal_difflib():
    import difflib
    import random

    rng = random.Random(6)
    part = ["th", "en", "er", "on", "ti", "a", "e", "sch", "ung", "é", "世", "ß", "12", "-"]
    known = sorted({"".join(rng.choice(part) for _ in range(rng.choice((1, 2, 3, 4, 5, 6, 40)))) for _ in range(4000)} | {"x" * 70, "x" * 64 + "y", "x" * 63, "ab" * 120, "zq"})
    words = [*rng.sample(known, 60), "nothing", "x" * 66, "ab" * 110, "q", "thenerxx", "💡en"]
    got: dict = {}
    for w, k, score in s._closest(words, known, 5, 0.6):
        got.setdefault(w, []).append((score, k))
    for w in words:
        assert [k for _, k in sorted(got.get(w, []), reverse=True)] == difflib.get_close_matches(w, [k for k in known if k != w], 5, 0.6), w
    assert list(s._closest([], known, 5, 0.6)) == [] == list(s._closest(["a"], [], 5, 0.6)) and list(s._closest(["", "b"], ["b", ""], 5, 0.6)) == []


def test_pairs_of_blocks_are_dealt_to_tasks(spark):
    words = spark.range(40_000).selectExpr("concat('w', id) AS word")
    few = spark.range(10).selectExpr("concat('w', id) AS word")
    # Words of one small block against few: one task had them all.
    made = s.suggestions(words, few)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in made and "BroadcastNestedLoopJoin" not in made and "rangepartitioning(_words#" in made.replace(" ", "")


@pytest.mark.parametrize("name", sorted(s.QUERIES))
def test_runs(spark, name):
    assert s.QUERIES[name](spark, "/root/testdata/sf0.001").count() >= 0
