"""Each pipeline stage against brute force on the smallest table, and the entry's queries by name."""

from __future__ import annotations

import collections
import re

from tests.llm.test_operators import _components

SF = "/root/testdata/sf0.001"


def _ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages(spark):
    import corpus_pipeline as cp
    from lectern.llm import mixing, quality
    from lectern.llm.common import stored

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(cp.STAGES)
    kept = stored(stage["quality rules"](spark, docs, SF), "t")
    assert kept.columns == docs.columns
    passed = []
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        g = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {k for i in range(len(w) - 4) if g[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
        if len(w) >= 10 and 100 * len(hit) <= 20 * len(w):
            passed.append(r["doc_id"])
    odd = {r["doc_id"] for r in quality.quality_measures(docs).where("not base_failed and not kept").collect()}
    assert _ids(kept) == sorted(set(passed) - odd)

    one = stored(stage["n-gram jaccard join"](spark, kept, SF), "t")
    names = _components([(r["doc_id"], r["text"]) for r in kept.collect()])
    assert one.columns == docs.columns and _ids(one) == sorted(i for i, (_, c) in names.items() if i == c)

    clean = stored(stage["benchmark decontamination"](spark, one, SF), "t")
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    wins = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = find(r["text"])
        k = min(10, len(w))
        wins |= {tuple(w[a : a + k]) for a in range(len(w) - k + 1) if k}
    sizes = {len(x) for x in wins}
    dirty = set()
    for r in one.collect():
        w = find(r["text"])
        if any(tuple(w[a : a + k]) in wins for k in sizes for a in range(len(w) - k + 1)):
            dirty.add(r["doc_id"])
    assert clean.columns == docs.columns and _ids(clean) == sorted(set(_ids(one)) - dirty)

    mixed = stored(stage["mixing to target weights"](spark, clean, SF), "t")
    table, _ = mixing.fit_rates(clean, spark.read.parquet(f"{SF}/labels.parquet"), mixing.TARGETS)
    want = {r["id"]: r["c"] for r in table.select("id", mixing.copies(table["rate"], "id", "text_hash").alias("c")).collect()}
    got = collections.Counter(_ids(mixed))
    assert mixed.columns == docs.columns and all(got[i] == c for i, c in want.items())

    placed = stage["sharding"](spark, mixed, SF).collect()
    slots = collections.defaultdict(list)
    for r in placed:
        slots[r["shard"]].append(r["slot"])
    assert sorted(r["doc_id"] for r in placed) == _ids(mixed) and set(slots) <= set(range(24))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(sum(k.startswith(f"op{n}_") for k in names) == 1 for n in range(1, 11))
