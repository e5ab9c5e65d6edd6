"""Rules on the words of a document against loops over its tokens."""

from __future__ import annotations

import random

import pytest
import regex

from lectern.functions import vocabulary as v
from lectern.functions.dialect import SENTENCE_END, WORD
from lectern.operators import findings, language, sentences, sequential

_PY_WORD = WORD.replace(r"\x{2019}", "’")
_STOPS = sorted({w for ws in v.POS.values() for w in ws})


def _texts():
    rng = random.Random(7)
    words = ["Marble", "marble", "MARBLES", "runs", "running", "ran", "über", "Über", "ΣΑΣ", "İx", "don't", "o’clock", "a-b", "the", "The", "12", "x", "1st"]
    ends = [" "] * 12 + [". ", "! ", "?\n", ", ", "\n", ".", "..\n\n", "...x ", " - ", ".\t"]
    made = ["".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 300))) for _ in range(25)]
    return [None, "", "...", ". marble marble", "\x00a\x01 a a. a", *made, "End marble."]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(_texts())), "doc_id long, text string").coalesce(1)


@pytest.fixture(params=[1, 4 << 20])
def slice_(request, monkeypatch):
    monkeypatch.setattr(findings, "SLICE", request.param)


def told(df):
    return sorted(tuple(r) for r in df.collect())


def test_stems(docs, slice_):
    want = []
    for i, t in enumerate(_texts()):
        for s, sent in enumerate(regex.split(SENTENCE_END, t) if t is not None else []):
            words = regex.findall(_PY_WORD, sent)
            stems = [sequential.stem(w.lower()) for w in words]
            for k in range(len(words)):
                if d := next((d for d in (1, 2, 3) if k >= d and stems[k] == stems[k - d]), None):
                    want.append((i, s, k, words[k], stems[k], d - 1))
    assert told(sequential.repeated_stems(docs)) == sorted(want) != []


def test_overuse_simple(docs, slice_):
    want = []
    for i, t in enumerate(_texts()):
        at: dict[str, list[int]] = {}
        for k, w in enumerate(regex.findall(_PY_WORD, t or "")):
            if len(w) > 3:
                at.setdefault(w.lower(), []).append(k)
        score = {w: sum(5625 - (b - a - 5) ** 2 for a, b in zip(x, x[1:], strict=False) if 6 <= b - a <= 80) for w, x in at.items() if len(x) > 1}
        want += [(i, w, n) for w, n in score.items() if n > 11250]
    assert told(sentences.overuse_simple(docs)) == sorted(want) != []


def test_overuse(docs, slice_):
    want = []
    for i, t in enumerate(_texts()):
        tokens = regex.findall(_PY_WORD + r"|[.!?]+(?=[ \t\n\x0b\f\r]|$)", t or "")
        last: dict[str, int] = {}
        total: dict[tuple[str, int], float] = {}
        head: dict[str, int] = {}
        for k, w in enumerate(tokens):
            if not regex.search(r"\p{L}", w):
                continue
            low, gap = w.lower(), k - last.get(w.lower(), -1000) - 1
            if gap > 80:
                head[low] = k
            weight = 1.0 if k == 0 or tokens[k - 1][0] in ".!?" else 0.4 if low in _STOPS else 0.8
            add = weight * (1 - ((max(gap, 5) - 5) / 75.0) ** 2) if gap == 0 or 6 <= gap <= 80 else 0.0
            total[low, head[low]] = total.get((low, head[low]), 0.0) + add
            last[low] = k
        want += [(i, w, k, round(x, 6), "I" if x < 3.1 else "W") for (w, k), x in total.items() if round(x, 6) >= 2.0]
    got = told(language.overuse(docs))
    assert [(r[0], r[1], r[2], r[4]) for r in got] == [(r[0], r[1], r[2], r[4]) for r in sorted(want)] != []
    assert [r[3] for r in got] == pytest.approx([r[3] for r in sorted(want)], abs=2e-6)


def test_distinct_words(docs, slice_):
    from lectern.operators import tokens

    assert told(tokens.distinct_words(docs.select("text"))) == sorted((w,) for w in {w for t in _texts() for w in regex.findall(_PY_WORD, t or "")})


@pytest.mark.parametrize("rule", [sequential.repeated_stems, sentences.overuse_simple, language.overuse])
def test_no_word_is_shuffled(docs, rule):
    assert "Exchange" not in rule(docs)._jdf.queryExecution().executedPlan().toString()
