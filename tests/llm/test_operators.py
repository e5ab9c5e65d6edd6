"""Small fixtures with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns, against brute force."""

from __future__ import annotations

import base64
import collections
import hashlib
import io
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import bytescan as bs
from lectern.llm import chat, decontaminate, jaccard, linededup, mixing, quality, secrets, sharding, tokencounts, warc
from lectern.llm.common import scratch

WORDS = "the of and river stone cloud hand light green water".split()
SCHEMA = "doc_id long, text string, lang string, source string, size long, shard string, n_words string"


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", "y") for i, t in texts], SCHEMA)


def _corpus(seed=1, n=60):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(WORDS) + str(rng.randint(0, 30)) for _ in range(rng.randint(1, 120))) for _ in range(n)]
    for t in texts[:20]:
        w = t.split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    return [(i, t) for i, t in enumerate([*texts, texts[0], "", None, " \n ", "one", "One", "x" * 5000 + " y\n" * 3000, "é" * 40])]


def _components(texts):
    sets = {}
    for i, t in texts:
        w = bytes((t or "").encode()).lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a, x in sets.items():
            for b, y in sets.items():
                if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y) and label[a] != label[b]:
                    low = min(label[a], label[b])
                    label[a] = label[b] = low
                    changed = True
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_jaccard_components(spark):
    texts = _corpus()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(_docs(spark, texts)).collect()}
    assert got == _components(texts)
    assert jaccard.jaccard_components(_docs(spark, [])).count() == 0


def test_jaccard_large_family(spark):
    rng = random.Random(3)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(150)] = f"z{i}_{rng.randint(0, 99)}"
        texts.append((i, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(_docs(spark, texts)).collect()}
    assert got == _components(texts)


def test_least_hits_never_prunes_a_link():
    import numpy as np

    for n in range(4, 90):
        for m in range(4, 90):
            if 5 * m < 4 * n or 5 * n < 4 * m:
                continue
            o = -(-4 * (n + m) // 9)
            both = min(o - jaccard.need(n) + jaccard._l2(n), o - jaccard.need(m) + jaccard._l2(m))
            for low, high in ((m, m), (4, m), (m, 500), (4, 500)):
                assert jaccard.least_hits(np.array([n]), np.array([low]), np.array([high]))[0] <= max(1, both)


def test_least_hits_over_every_size_of_a_group():
    import numpy as np

    for n in range(4, 150):
        sizes = range(-(-4 * n // 5), 5 * n // 4 + 1)
        o = {m: -(-4 * (n + m) // 9) for m in sizes}
        both = {m: min(o[m] - jaccard.need(n) + jaccard._l2(n), o[m] - jaccard.need(m) + jaccard._l2(m)) for m in sizes}
        for low in sizes:
            least = np.minimum.accumulate([both[m] for m in range(low, sizes.stop)])
            got = jaccard.least_hits(np.full(len(least), n), np.full(len(least), low), np.arange(low, sizes.stop))
            assert (got == np.maximum(1, least)).all()


def test_keep_one_per_component(spark):
    texts = [(5, "a b c d e f g h"), (3, "a b c d e f g h"), (9, ""), (3, "a b c d e f g h"), (None, "q")]
    assert sorted((r["doc_id"] or -1) for r in jaccard.keep_one_per_component(_docs(spark, texts)).collect()) == [-1, 3, 9]


def test_keep_one_tells_texts_apart(spark):
    far, near = "p q r s t u v w x y", "a b c d e f g h i j k l m n o p q r s t"
    rows = [(1, near, 1, "h"), (1, far, 1, "h"), (2, near + " u", 1, "h"), (3, far, 1, "h"), (3, far, 1, "h"), (None, far, 1, "h"), (4, None, 1, "h"), (4, None, 1, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id long, _hash string")
    left = sorted(((r["doc_id"] or 0), r["text"] or "") for r in jaccard.keep_one_per_component(docs).collect())
    assert left == sorted([(1, near), (1, far), (0, far), (4, ""), (4, "")])


def test_quality_counts(spark):
    texts = _corpus(2) + [(900, "a b c d e\na b c d e\n"), (901, "# $ | word " * 6)]
    for r in quality.quality_measures(_docs(spark, texts)).collect():
        t = dict(texts)[r["doc_id"]] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        g = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {k for i in range(len(w) - 4) if g[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit))
        assert tuple(r[c] for c in quality.COUNTS) == want
        assert r["base_failed"] == (len(w) < 10 or 100 * len(hit) > 20 * len(w))
        assert not (r["kept"] and r["base_failed"])
    noise = base64.b85encode(random.Random(0).randbytes(9000)).decode()
    odd = _docs(spark, [(1, " ".join(noise[i : i + 9] for i in range(0, len(noise), 9)))])
    assert not quality.quality_measures(odd).first()["kept"]
    assert quality.filter_quality(_docs(spark, texts)).columns == _docs(spark, []).columns
    assert quality.filter_quality(_docs(spark, [])).count() == 0


def test_quality_rejects_encoded_noise(spark):
    rng = random.Random(11)
    texts, n = [], 0
    for size in (150, 200, 300, 600, 1000, 3000, 8000, 15000, 40000):
        raw = rng.randbytes(size)
        for kind, code in (("64", base64.b64encode), ("85", base64.b85encode), ("hex", base64.b16encode)):
            t = code(raw).decode()[:size]
            for k, sep in ((76, "\n"), (9, " ")):
                if kind != "hex" or size >= 3000:
                    texts.append((n := n + 1, sep.join(t[i : i + k] for i in range(0, size, k))[:size]))
    assert quality.filter_quality(_docs(spark, texts)).count() == 0
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    base = quality.quality_measures(real).where("not base_failed")
    assert base.where("kept").count() >= 0.99 * base.count()
    prose = next(r["text"] for r in real.join(base.where("kept"), "doc_id").collect() if len(r["text"].encode()) > 4096)
    head = prose.encode()[:4096].decode(errors="ignore")
    noise = base64.b64encode(rng.randbytes(3000)).decode()
    tail = "\n".join(noise[i : i + 76] for i in range(0, 2800, 76))
    assert quality.quality_measures(_docs(spark, [(1, head + "\n" + tail)])).first()["odd_chunk_share"] > 0.25


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def _spans(t):
    found = [("assign", *m.span()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(found, key=lambda x: (x[1], ["assign", "access", "hex"].index(x[0])))


def test_secret_spans():
    rng = random.Random(1)
    parts = ["token", "Secret", "passwd", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abc", "0123456789abcdef", "AKIA", "ABCDEF0123456789", "é", "\n", "deadbeef" * 3, "a" * 200, "f" * 300, "AKIA" + "Z" * 150, "ſ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    for s in bs.slices(pa.array(texts), limit=50_000):
        found = secrets.find_spans(s)
        for i in range(s.n):
            assert [x for x in found.get(i, []) if x[0] in ("assign", "access", "hex")] == _spans(texts[s.first + i])
    kinds = [k for k, *_ in secrets.find_spans(next(bs.slices(pa.array(["ghp_" + "Zz" * 20 + " xoxb-1234567890ab -----BEGIN RSA PRIVATE KEY-----"]))))[0]]
    assert kinds == ["forge", "chat", "pem"]


def test_secret_scan_is_linear():
    import time

    for unit in ("eyJ", "eyJa.", "token=", "AKIA", "AIza", "0a", "xoxb-", "-----BEGIN "):
        s = next(bs.slices(pa.array([unit * (1_000_000 // len(unit))])))
        began = time.process_time()
        secrets.find_spans(s)
        assert time.process_time() - began < 5, unit


def test_secret_kinds_of_the_method():
    words = ["ghp_" + "a" * 36, "ghp_" + "a" * 35, "xoxb-" + "1" * 10, "xoxb-" + "1" * 9, "AIza" + "-" * 35, "AIza" + "-" * 34, "sk_live_" + "Z" * 16, "sk_live_" + "Z" * 15, "eyJ" + ".".join(["Z" * 8] * 3), "eyJ" + ".".join(["Z" * 8, "Z" * 7, "Z" * 8])]
    spans = secrets.find_spans(next(bs.slices(pa.array([" ".join(words)]))))[0]
    assert [k for k, *_ in spans if k != "hex"] == ["forge", "chat", "cloud", "pay", "jwt"]


def test_secret_rows(spark):
    got = {r["doc_id"]: r for r in secrets.scan_secrets(_docs(spark, [(1, None), (2, "é token=abcdef1"), (3, "")])).collect()}
    assert got[2]["spans"] == "assign:2:15" and got[2]["n_assign"] == 1
    assert got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[1]["spans"] == ""


def test_decontamination(spark):
    texts = _corpus(4)
    bench = [(10, " ".join((texts[3][1] or "").split()[:12])), (2, "one"), (7, None), (7, ""), (None, "the"), (11, "no such words here at all in any of the texts we have")]
    items = spark.createDataFrame(bench, "item_id long, text string")
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    wins = collections.defaultdict(set)
    for i, t in bench:
        w = find(t)
        k = min(10, len(w))
        for a in range(len(w) - k + 1):
            if k and i is not None:
                wins[tuple(w[a : a + k])].add(str(i))
    want = {}
    for i, t in texts:
        w, hit, it = find(t), set(), set()
        for k in {len(x) for x in wins}:
            for a in range(len(w) - k + 1):
                if (x := tuple(w[a : a + k])) in wins:
                    it |= wins[x]
                    hit |= set(range(a, a + k))
        want[i] = (len(w), len(hit), len(it), hashlib.sha256(",".join(sorted(it)).encode()).hexdigest(), bool(hit))
    for block in (1 << 20, 8):
        out = decontaminate.decontaminate(_docs(spark, texts), items, block_bytes=block).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in out} == want
        kept = {r["doc_id"] for r in decontaminate.drop_contaminated(_docs(spark, texts), items, block_bytes=block).collect()}
        assert kept == {i for i, x in want.items() if not x[4]}
    assert decontaminate.decontaminate(_docs(spark, texts), items.limit(0)).where("contaminated").count() == 0


def test_decontamination_reports_each_row_in_every_block(spark):
    texts = [(1, "a b c x"), (1, "a b c x"), (1, "p q r y"), (1, "a b c p q r"), (None, "a b c x"), (None, "w w w w"), (None, "p q r z"), (2, None)]
    items = spark.createDataFrame([(1, "a b c"), (2, "p q r"), (3, "b c")], "item_id long, text string")
    rows = lambda block: sorted(map(repr, decontaminate.decontaminate(_docs(spark, texts), items, width=3, slop=2, block_bytes=block).drop("hit_spans").collect()))
    assert len(rows(1)) == len(texts) and rows(1) == rows(1 << 20)


def test_warc_round_trip(spark):
    html = [(1, "u", "a"), (2, "u", "a"), (3, None, None), (4, "v\r\nX: y", ""), (5, "w", "é" * 3000), (6, "w", "WARC/1.1\r\n\r\n"), (None, "z", "a")]
    pages = spark.createDataFrame([(*r, 1) for r in html], "page_id long, url string, html string, payload int")
    for gz in (True, False):
        made = warc.write_warc(pages, scratch(spark, "t"), archive_bytes=200, gzip=gz)
        got = warc.read_warc(made).collect()
        assert not [r for r in got if r["record_type"] == "gap"]
        rows = {warc._id_of(r["record_id"]): (r["record_type"], warc._id_of(r["refers_to"]), r["payload_bytes"], r["payload_digest"]) for r in got}
        sha = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
        assert rows == {1: ("revisit", 2, 1, sha("a")), 2: ("response", None, 1, sha("a")), 3: ("revisit", 4, 0, sha("")), 4: ("response", None, 0, sha("")), 5: ("response", None, 6000, sha("é" * 3000)), 6: ("response", None, 12, sha("WARC/1.1\r\n\r\n")), None: ("revisit", 2, 1, sha("a"))}


@pytest.mark.parametrize("gz", [True, False])
def test_salvage_recovers_later_records(gz):
    records = [warc.record_bytes(i, "http://x", b"<p>%d</p>" % i * 50, None, False) for i in range(50)]
    if gz:
        pack = lambda r, z: z.compress(r) + z.flush()
        records = [pack(r, zlib.compressobj(4, zlib.DEFLATED, 31)) for r in records]
    off = [0]
    for r in records:
        off.append(off[-1] + len(r))
    raw = bytearray(b"".join(records))
    for k in (3, 17, 18, 49):
        raw[off[k] + len(records[k]) // 2] ^= 0xFF
    raw = bytes(raw[: off[30] + 5] + raw[off[31] :]) + b"junk"
    out = list(warc.salvage(io.BytesIO(raw), len(raw)))
    assert [warc._id_of(r["record_id"]) for r in out if r["record_type"] != "gap"] == [i for i in range(50) if i not in (3, 17, 18, 30, 49)]
    gaps = [(r["offset"], r["end"]) for r in out if r["record_type"] == "gap"]
    assert gaps[0] == (off[3], off[4]) and gaps[1] == (off[17], off[19]) and gaps[-1][1] == len(raw)


def _ids(out):
    return [warc._id_of(r["record_id"]) for r in out if r["record_type"] != "gap"]


def _read(raw, **more):
    return list(warc.salvage(io.BytesIO(raw), len(raw), **more))


def _gz(raw):
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def test_salvage_of_whole_streams_mixed_and_old_archives(monkeypatch):
    rec = lambda i, n=50: warc.record_bytes(i, "http://x", (b"%d " % i) * n, None, False)
    records = [rec(i) for i in range(5)]
    for most in (8 << 20, 100):
        monkeypatch.setattr(warc, "MEMBER", most)
        # One member around all records, sound, with a broken record in it, and cut off.
        out = _read(_gz(b"".join(records)))
        assert _ids(out) == list(range(5)) and all(r["record_type"] != "gap" for r in out)
        damaged = records[2].replace(b"2 2 2", b"2 9 2", 1)
        out = _read(_gz(b"".join([*records[:2], damaged, *records[3:]])))
        assert _ids(out) == [0, 1, 3, 4] and sum(r["record_type"] == "gap" for r in out) == 1
        noise = [warc.record_bytes(i, None, random.Random(i).randbytes(3000), None, False) for i in range(40)]
        whole = _gz(b"".join(noise))
        out = _read(whole[: len(whole) // 2])
        assert len(_ids(out)) > 10 and _ids(out) == list(range(len(_ids(out)))) and out[-1]["record_type"] == "gap"
    # Members and plain records in one file, with junk that holds both marks between them.
    out = _read(_gz(records[0]) + records[1] + records[2] + b"junk \x1f\x8b\x08 WARC/ junk" + _gz(records[3]) + records[4])
    assert _ids(out) == list(range(5)) and [r["record_type"] for r in out].count("gap") == 1
    old = records[1].replace(b"WARC/1.1", b"WARC/0.18").replace(b"WARC-Type: response", b"WARC-Type:\r\n response")
    assert [(r["record_type"], warc._id_of(r["record_id"])) for r in _read(old)] == [("response", 1)]
    # A payload over the limit is checked and counted.
    big = _read(rec(7, 100_000) + records[0], limit=1000)
    assert _ids(big) == [7, 0] and big[0]["payload_bytes"] == 200_000 and big[0]["payload"] is None and big[0]["reason"] == "payload over the limit" and big[1]["payload"]
    # A gzip payload inside a plain record that fails is no member.
    inner = warc.record_bytes(1, None, _gz(b"page"), None, False)
    out = _read(inner.replace(b"Content-Length: ", b"Content-Length: 9", 1) + records[3])
    assert _ids(out) == [3] and out[0]["record_type"] == "gap"
    assert _read(b"") == [] and [r["record_type"] for r in _read(b"x")] == ["gap"]


def test_edit_aware_counts():
    coder = tokencounts.encoding(tokencounts.read_vocabulary())
    count = lambda parts: [len(coder.encode_ordinary(p)) for p in parts]
    rng, parts = random.Random(0), [" ", "  ", "\n", "a", "bc", "'s", "'", "é", "12", ".", "\n\n", " x", "!?", "'ll"]
    for _ in range(400):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 80)))
        tree = tokencounts.TokenTree(t, count, rng.choice([1, 4, 9]))
        for _ in range(6):
            a = rng.randint(0, len(t) + 2)
            b, new = rng.randint(a, a + 6), "".join(rng.choice(parts) for _ in range(rng.randint(0, 5)))
            tree.edit(a, b, new)
            t = t[: min(a, len(t))] + new + t[min(b, len(t)) :]
            assert tree.text() == t and tree.total == len(coder.encode_ordinary(t)) and tree.size == len(t)
        # A tree read back from its leaves counts without encoding.
        again = tokencounts.TokenTree(t, count, 4, tree.state())
        assert again.total == tree.total and again.encoded == 0


def test_edits_take_little_of_a_long_text():
    coder = tokencounts.encoding(tokencounts.read_vocabulary())
    count = lambda parts: [len(coder.encode_ordinary(p)) for p in parts]
    for unit in ("some words here ", "ab12.", "x1"):
        text = unit * (400_000 // len(unit))
        tree = tokencounts.TokenTree(text, count)
        tree.encoded = 0
        for k in range(200):
            tree.edit(k * 2000, k * 2000 + 3, "new " if k % 2 else "")
        assert tree.encoded < 200 * 4 * tokencounts.LEAF and tree.root.height < 2 * tree.root.leaves.bit_length()
        assert tree.total == len(coder.encode_ordinary(tree.text()))


def test_edit_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "a b", "x"), (3, "", "x"), (None, "c", "x"), (2, "a b", "x")], "doc_id long, text string, body string")
    trees = tokencounts.build_trees(docs)
    assert sorted((r["id"] or 0, r["n_chars"], r["n_tokens"]) for r in trees.collect()) == [(0, 1, 1), (1, 0, 0), (2, 3, 2), (2, 3, 2), (3, 0, 0)]
    edits = spark.createDataFrame([(2, [(0, 1, "xyz")]), (3, [(0, 5, None), None, (None, 1, "q")])], "id long, edits array<struct<start:long,end:long,text:string>>")
    made = tokencounts.edit_trees(trees.join(edits, "id", "left"))
    assert sorted((r["id"] or 0, r["n_tokens_before"], r["n_edits"], r["n_chars"]) for r in made.collect()) == [(0, 1, 0, 1), (1, 0, 0, 0), (2, 2, 1, 5), (2, 2, 1, 5), (3, 0, 1, 0)]
    more = tokencounts.edit_trees(made.join(edits, "id", "left"), keep=False)
    assert sorted(r["n_chars"] for r in more.where("id = 2").collect()) == [7, 7]
    assert tokencounts.edit_trees(tokencounts.build_trees(docs.limit(0)).join(edits, "id")).count() == 0


def test_line_dedup(spark):
    rng = random.Random(5)
    shared = [f"shared line {k}" for k in range(40)]
    texts = [(i, "\n".join([f"own {i} {rng.random()}" for _ in range(rng.randint(0, 9))] + shared + [f"end {i}"])) for i in range(8)] + [(20, None), (21, ""), (22, "B\nL\n\nB"), (23, "x\n")]
    docs = _docs(spark, texts)
    got = {r["doc_id"]: r for r in linededup.dedup_lines(docs).collect()}
    assert len(got) == len(texts)
    for i, t in texts:
        assert got[i]["n_lines"] == (0 if t is None else len(t.split("\n")))
        if not got[i]["n_removed_chunks"]:
            assert got[i]["text"] == t
    assert got[0]["text"] == dict(texts)[0]
    removed = sum(got[i]["n_removed_lines"] for i in range(1, 8))
    assert removed >= 7 * 20
    for i in range(1, 8):
        left = got[i]["text"].split("\n")
        assert f"end {i}" in left and sum(x.startswith("own") for x in left) == sum(x.startswith("own") for x in dict(texts)[i].split("\n"))
    chunks = {r["doc_id"]: r["_chunks"] for r in linededup.chunked(docs).select("doc_id", "_chunks").collect()}
    for i, t in texts:
        if t is not None:
            assert "\n".join(chunks[i])[1:].replace("\nL", "\n") == t
    again = linededup.dedup_lines(linededup.dedup_lines(docs).select("doc_id", "text"))
    assert again.where("n_removed_chunks > 0 and doc_id < 20").count() == 0


def _dedup(rows, min_lines=2):
    """Texts less repeated runs, by plain loops over the spans (chunks and short runs) of ``rows(id, hash, text, chunks)``."""
    spans = []
    for i, h, text, chunks in rows:
        if text is None:
            continue
        lines = text.split("\n")
        full = [k for k, x in enumerate(lines) if x.strip(" \t\r")]
        own = {(a, b) for a, b in chunks if b - a + 1 >= min_lines} | {(full[k], full[k + min_lines - 1]) for k in range(len(full) - min_lines + 1)}
        spans += [((i is not None, i or 0), h, a, b, "\n".join(lines[a : b + 1])) for a, b in own]
    first, gone = {}, collections.defaultdict(set)
    for s in sorted(spans, key=lambda x: x[:4]):
        f = first.setdefault(s[4], s[:4])
        if s[:4] != f:
            begin = max(s[2], f[3] + 1) if s[:2] == f[:2] else s[2]
            gone[s[:2]] |= set(range(begin, s[3] + 1))
    return [(i, None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone[(i is not None, i or 0), h])) for i, h, text, _ in rows]


def test_line_dedup_equals_brute_force(spark):
    from pyspark.sql import functions as F

    rng = random.Random(12)
    texts = [(i, "\n".join(rng.choice(["a", "b", "c", "d", "", " ", "\r"]) for _ in range(rng.randint(0, 14)))) for i in range(40)]
    passage = [f"line {k} of it" for k in range(9)]
    texts += [(i, "\n".join([f"own {i}", *passage[rng.randint(0, 4) : rng.randint(5, 9)], f"end {i}"])) for i in range(50, 70)] + [(3, None), (7, ""), (None, "a\nb\nc"), (50, texts[4][1]), (60, "x\n" * 3000)]
    docs = spark.createDataFrame([(i, t, 1, "d", [0]) for i, t in texts], "doc_id long, text string, n_lines int, _id string, _drop array<int>")
    spans = linededup.lined(docs.select("doc_id", "text"), "text", 3, 4).select("doc_id", F.xxhash64("text").alias("h"), "text", "_spans").collect()
    want = _dedup([(r["doc_id"], r["h"], r["text"], [(z["at"], z["to"]) for z in r["_spans"] or []]) for r in spans])
    out = linededup.dedup_lines(docs)
    assert sorted(out.columns) == sorted([*docs.columns, "n_chunks", "n_removed_chunks", "n_removed_lines"])
    key = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or "")
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=key) == sorted(want, key=key)
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


def test_line_dedup_takes_short_passages_whole(spark):
    passage = ["a passage of two lines", "that stands in many texts"]
    texts = [(i, "\n".join([f"own {i}", *passage[:1], *passage[1:], f"end {i}"])) for i in range(9)]
    texts += [(20, "\n".join(["x"] * 5)), (21, "p\n\nq"), (22, "r\np\n\nq\ns"), (23, "\n\n"), (None, "null first\ntwice"), (24, "k\nnull first\ntwice")]
    got = {r["doc_id"]: (r["text"], r["n_removed_lines"]) for r in linededup.dedup_lines(_docs(spark, texts)).collect()}
    assert got[0] == (texts[0][1], 0) and all(got[i] == (f"own {i}\nend {i}", 2) for i in range(1, 9))
    assert got[20] == ("x\nx", 3) and got[21] == ("p\n\nq", 0) and got[22] == ("r\ns", 3)
    assert got[23] == ("\n\n", 0) and got[None][1] == 0 and got[24] == ("k", 2)


def test_sharding(spark):
    rng = random.Random(7)
    texts = [(i, "x" * rng.randint(0, 200)) for i in range(3000)] + [(5, "same"), (5, "same"), (None, None)]
    rows = sharding.kd_shards(_docs(spark, texts), 24).collect()
    assert len(rows) == len(texts) and {r["shard"] for r in rows} == set(range(24))
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(sizes.values()) - min(sizes.values()) < 0.03 * sum(sizes.values()) / 24 + 500
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] is None} == {(8, 0)}
    assert sharding.kd_shards(_docs(spark, []), 24).count() == 0


def _tree(rows, leaves, first, scale):
    """Shards of ``(unit, weight, tie, dimensions)`` by exact weighted quantiles."""
    if leaves == 1 or not rows:
        return {r[0]: first for r in rows}
    spread = [(max(r[3][d] for r in rows) - min(r[3][d] for r in rows)) / scale[d] for d in range(len(scale))]
    dim = spread.index(max(spread))
    rows = sorted(rows, key=lambda r: (r[3][dim], r[2]))
    half, upto, cut = leaves // 2, 0, len(rows)
    want = sum(r[1] for r in rows) * half / leaves
    for i, r in enumerate(rows):
        if upto + r[1] >= want:
            cut = i + 1 if abs(upto + r[1] - want) < abs(upto - want) else i
            break
        upto += r[1]
    return _tree(rows[:cut], half, first, scale) | _tree(rows[cut:], leaves - half, first + half, scale)


@pytest.mark.parametrize("shards", [1, 7, 24])
def test_tree_equals_exact_quantiles(spark, shards):
    rng = random.Random(shards)
    rows = [(i, rng.randint(1, 500), rng.random(), [rng.choice([0.0, 1.0, 2.5]), rng.random() * 1e9, float(rng.randint(0, 30))]) for i in range(900)]
    points = spark.createDataFrame(rows, "unit long, w long, tie double, x array<double>")
    got = {r["unit"]: r["first"] for r in sharding.grow(points, shards, 3, buckets=16, tolerance=0.0).collect()}
    scale = [(max(r[3][d] for r in rows) - min(r[3][d] for r in rows)) or 1.0 for d in range(3)]
    assert got == _tree(rows, shards, 0, scale)


def test_sharding_keeps_groups_and_takes_any_columns(spark):
    texts = [(f"id-{i}", f"text {i % 700} " * (1 + i % 9)) for i in range(2000)] + [("z", "same " * 50)] * 3 + [(None, None), ("e", "")]
    docs = spark.createDataFrame([(i, t, 1, 2, "s") for i, t in texts], "doc_id string, text string, shard int, slot int, _id string")
    rows = sharding.kd_shards(docs, 6, keep=("shard", "_id")).collect()
    assert len(rows) == len(texts) and set(docs.columns) - {"text"} <= {*rows[0].asDict()}
    homes = collections.defaultdict(set)
    for r in rows:
        homes[r["size"], r["text_crc32"]].add(r["shard"])
    total = sum(r["size"] for r in rows)
    assert all(len(h) == 1 for h in homes.values())
    sizes = collections.Counter()
    for r in rows:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) < 1.05 * total / 6
    hot = spark.createDataFrame([(i, "hot " * 40, "s") for i in range(900)] + [(i, f"own {i} " * 20, "s") for i in range(900)], "doc_id long, text string, source string")
    sizes = collections.Counter()
    for r in sharding.kd_shards(hot, 8).collect():
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) < 1.1 * sum(sizes.values()) / 8
    assert sharding.kd_shards(hot.limit(0), None, target_bytes=100).count() == 0


def test_mixing_meets_targets(spark):
    rng = random.Random(8)
    kinds = [("fine", 1, 0), ("awful", 0, 0), ("nasty", 1, 1)]
    texts, labels = [], []
    for i in range(300):
        k = kinds[0 if i % 10 < 8 else 1 + i % 2]
        texts.append((i, " ".join(rng.choice([k[0], k[0] + "er", *WORDS]) for _ in range(rng.randint(20, 60)))))
        labels.append((i, k[1], k[2]))
    docs = _docs(spark, [*texts, (400, None), (401, "")])
    lab = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    table, model = mixing.fit_rates(docs, lab, {"high": 0.8, "low": 0.12, "toxic": 0.08})
    rows = table.collect()
    total = sum(r["n_tokens"] for r in rows)
    share = [sum(r["rate"] * r["n_tokens"] * r["p"][j] for r in rows) / total for j in range(3)]
    assert model.domains == ["high", "low", "toxic"] and max(abs(a - b) for a, b in zip(share, (0.8, 0.12, 0.08))) < 0.01
    right = sum(max(range(3), key=lambda j: r["p"][j]) == (2 if r["id"] % 10 >= 8 and r["id"] % 2 else 1 if r["id"] % 10 >= 8 else 0) for r in rows if r["id"] < 300)
    assert right >= 285
    assert mixing.apply_rates(docs, lab).columns == docs.columns
    assert mixing.apply_rates(docs, lab.limit(0)).count() == 302
    assert mixing.apply_rates(docs.limit(0), lab).count() == 0


def test_mixing_takes_any_columns_and_tells_residuals(spark):
    rng = random.Random(4)
    texts = [(f"d{i}", " ".join(rng.choice([["good"], ["bad"], ["ugly"]][i % 3] + WORDS) for _ in range(40)), 1, 0.5) for i in range(90)]
    docs = spark.createDataFrame(texts, "doc_id string, text string, _id int, _u double")
    labels = spark.createDataFrame([(f"d{i}", int(i % 3 == 0), int(i % 3 == 2)) for i in range(90)], "doc_id string, quality int, toxic int")
    made = mixing.apply_rates(docs, labels)
    assert made.columns == docs.columns and made.count() > 0
    targets = {"high": 1.0}
    table, model = mixing.fit_rates(docs, labels, targets)
    got = {r["domain"]: r for r in mixing.residuals(table, model.domains, targets).collect()}
    # Posteriors are soft, so no rates reach a target of all: the miss is told.
    assert set(got) == {"high", "low", "toxic"} and abs(sum(r["residual"] for r in got.values())) < 1e-9 and got["high"]["residual"] < 0


def test_mixing_keeps_clean_documents(spark):
    rng = random.Random(9)
    words = {"fine": (1, 0), "awful": (0, 0), "nasty": (1, 1)}
    texts, labels = [], []
    for i in range(300):
        k = ["fine", "fine", "awful", "nasty"][i % 4]
        n = 3000 if i % 50 == 0 else rng.randint(20, 60)
        texts.append((i, " ".join(rng.choice([k, *WORDS]) for _ in range(n))))
        labels.append((i, *words[k]))
    docs, lab = _docs(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for targets in ({"high": 0.5, "low": 0.3, "toxic": 0.2}, mixing.TARGETS):
        rows = mixing.fit_rates(docs, lab, targets)[0].collect()
        total = sum(r["rate"] * r["n_tokens"] for r in rows)
        share = [sum(r["rate"] * r["n_tokens"] * r["p"][j] for r in rows) / total for j in range(3)]
        assert max(abs(a - b) for a, b in zip(share, targets.values())) < 0.01
        assert min(r["rate"] for r in rows if r["p"][0] == max(r["p"])) >= 1
    kept = {r["doc_id"] for r in mixing.apply_rates(docs, lab).collect()}
    assert {r["id"] for r in rows if r["p"][0] == max(r["p"])} <= kept


def test_chat_linking(spark):
    schemas = {"f": {"a": ("string", True), "n": ("integer", False)}}
    calls = spark.createDataFrame([
        (1, "x", 0, "f", '{"n":2,"a":"q"}', None), (1, "y", 1, "f", '{"a":3,"z":1}', ["x"]), (1, "y", 5, "f", "{}", None),
        (2, "p", 0, "f", '{"a":"1"}', ["q"]), (2, "q", 1, "f", '{"a":"1"}', None), (3, "c", 0, "f", '{"a":"1"}', ["d"]), (3, "d", 1, "f", '{"a":"1"}', ["c"]),
        (3, "s", 2, "f", '{"a":"1"}', ["c"]), (4, "m", 0, "g", "not json", ["nowhere"]), (5, "k", 0, "f", None, None), (None, "k", 0, "f", "{}", None), (6, "me", 0, "f", '{"a":"1"}', ["me", None]),
    ], "conv_id long, call_id string, pos long, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([(1, "x", 2, 'say "hi"'), (1, "x", 3, "later"), (9, "x", 0, "orphan"), (None, "x", 0, "q"), (9, None, 0, "q")], "conv_id long, call_id string, pos long, content string")
    got = {(r["conv_id"], r["call_id"]): r for r in chat.link_tool_calls(calls, results, schemas).collect()}
    assert len(got) == 11
    assert got[1, "x"]["json"] == '{"arguments":{"a":"q","n":2},"id":"x","name":"f","result":"say \\"hi\\""}' and got[1, "x"]["valid"] and got[1, "x"]["n_results"] == 2
    assert got[1, "y"]["problems"] == "type:a,unknown:z" and not got[1, "y"]["linked"]
    assert (got[2, "q"]["topo"], got[2, "p"]["topo"]) == (0, 1)
    assert all(got[k]["topo"] is None and got[k]["problems"] == "cycle" for k in ((3, "c"), (3, "d"), (3, "s"), (6, "me")))
    assert "unresolved" in got[4, "m"]["problems"] and "malformed" in got[5, "k"]["problems"]
    assert got[9, "x"]["problems"] == "orphan-result" and not got[9, "x"]["linked"]
    assert chat.link_tool_calls(calls.limit(0), results.limit(0), schemas).count() == 0


def test_canonical_json(spark):
    from pyspark.sql import functions as F

    forms = [(["1", "1.0", "1e0", "10e-1", "1.000"], "1"), (["100", "1e2", "1E+2", "100.0"], "100"), (["0", "-0", "-0.0", "0e5"], "0"), (["0.1", "0.10", "1e-1"], "0.1"), (["12345678901234567890"], "12345678901234567890"), (['"1.0 \\" 1e0"'], '"1.0 \\" 1e0"'), (["[1.0, {\"b\":2.50,\"a\":\"\\u0041 7.0\"}]"], '[1,{"a":"A 7.0","b":2.5}]')]
    rows = spark.createDataFrame([(x, want) for xs, want in forms for x in xs], "j string, want string")
    bad = rows.withColumn("got", chat.canonical(F.to_json(F.parse_json("j")))).where("got is distinct from want").collect()
    assert not bad, bad


def test_chat_orders_any_graph(spark):
    rng = random.Random(2)
    rows, deps = [], {}
    for conv in range(12):
        n = rng.randint(1, 40)
        order = rng.sample(range(n), n)
        for i in range(n):
            own = [order[j] for j in range(i) if rng.random() < 0.08] if conv % 3 else ([order[i - 1]] if i else [])
            deps[conv, f"c{order[i]}"] = [f"c{d}" for d in own]
    deps[11, "c0"] = deps[11, "c0"] + ["c0"]
    calls = spark.createDataFrame([(k[0], k[1], int(k[1][1:]), "f", "{}", d) for k, d in deps.items()], "conv_id long, call_id string, pos long, name string, arguments string, depends_on array<string>")
    got = {(r["conv_id"], r["call_id"]): r["topo"] for r in chat.link_tool_calls(calls, calls.selectExpr("conv_id", "call_id", "pos", "'r' as content").limit(0), {"f": {}}).collect()}
    bad = {(11, "c0")}
    while more := {k for k, d in deps.items() if k not in bad and any((k[0], x) in bad for x in d)}:
        bad |= more
    assert {k for k, t in got.items() if t is None} == bad
    for k, d in deps.items():
        assert k in bad or all(got[k] > got[k[0], x] for x in d)
    for conv in range(12):
        numbers = sorted(t for k, t in got.items() if k[0] == conv and t is not None)
        assert numbers == list(range(len(numbers)))


def test_chat_long_conversation(spark):
    for deps in ("cast(null as array<string>)", "array(concat('c', id + 1))"):
        calls = spark.range(3500).selectExpr("1L as conv_id", "concat('c', id) as call_id", "id as pos", "'f' as name", "'{}' as arguments", f"{deps} as depends_on")
        results = calls.selectExpr("conv_id", "call_id", "pos", "'r' as content")
        got = chat.link_tool_calls(calls, results, {"f": {}})
        assert got.where(("topo = pos" if "null" in deps else "topo = 3499 - pos") + " and linked").count() == 3500


def test_matrix_bounds_are_the_same_for_any_number_of_buckets(spark):

    rng = random.Random(5)
    rows = []
    for i in range(60):
        comp = i % 12
        pool = list(range(40)) if comp < 8 else list(range(30, 80))
        prefix = sorted(rng.sample(pool, rng.randint(3, 14)))
        rows.append((b"d%02d" % i, b"c%02d" % comp, 5, comp % 2, [(x * 0x9E3779B97F4A7C15 + (1 << 63)) % (1 << 64) - (1 << 63) for x in prefix], rng.randint(20, 30)))
    low, high = {}, {}
    for _, c, _, s, _, n in rows:
        low[c, s], high[c, s] = min(n, low.get((c, s), n)), max(n, high.get((c, s), n))
    table = spark.createDataFrame([(*r, low[r[1], r[3]], high[r[1], r[3]]) for r in rows], "digest binary, label binary, csize bigint, sub int, prefix array<bigint>, n bigint, low bigint, high bigint")
    want = set()
    for d, c, _, _, p, n in rows:
        for g in low:
            if g[0] > c:
                held = {x for r in rows if (r[1], r[3]) == g for x in r[4]}
                hits = len(held & set(p))
                if hits and hits >= int(jaccard.least_hits(np.array([n]), np.array([low[g]]), np.array([high[g]]))[0]):
                    want.add((d, *g))
    assert 0 < len(want) < 60 * 11
    for buckets in (1, 2, 9):
        got = {(bytes(r[0]), bytes(r[1]), r[2]) for r in jaccard._matrix_bounds(table, buckets).collect()}
        assert got == want


def test_line_dedup_same_with_shuffled_drops(spark, monkeypatch):
    from lectern.llm import linededup

    rows = [(i, "\n".join([f"own line {i}", "a shared line", "another shared line", f"end {i}"] + ["x", "y"] * (i % 3))) for i in range(12)] + [(None, "a shared line\nanother shared line"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(repr, linededup.dedup_lines(docs).collect()))
    monkeypatch.setattr(linededup, "BROADCAST_CELLS", 0)
    shuffled = linededup.dedup_lines(docs)
    assert sorted(map(repr, shuffled.collect())) == want


def test_prefix_shingles_fill_all_buckets_alike(spark):
    rng = random.Random(2)
    texts = [(i, " ".join(rng.choice("abcdefgh") + str(rng.randrange(500)) for _ in range(120))) for i in range(60)]
    sent = jaccard._send_sets(_docs(spark, texts), "doc_id", "text", 5, 8, lambda x: x[: len(x) // 4]).collect()
    held = collections.Counter()
    for r in sent:
        held[r["bucket"]] += len(r["tokens"]) // 8
    assert len(held) == 8 and sum(held.values()) == 60 * (116 // 4) and max(held.values()) < 2 * min(held.values())


def test_matrix_bucket_holds_no_objects_for_owners():
    import tracemalloc

    # One shingle of each of many classes: a bucket of a large input; half of them share it with another component.
    n = 40_000
    blobs = [pa.record_batch({"bucket": pa.array([0], pa.int32()), "tokens": pa.array([(np.arange(a, a + 500, dtype=np.uint64) % (n // 2)).tobytes()]), "owner": pa.array([np.arange(500, dtype=np.int32).tobytes()])} | {k: pa.array([v], pa.list_(jaccard._OWNERS[k])) for k, v in {"digests": [b"%016d" % i for i in range(a, a + 500)], "labels": [b"%016d" % i for i in range(a, a + 500)], "csize": [1] * 500, "sub": [0] * 500, "n": [4] * 500, "low": [4] * 500, "high": [4] * 500, "total": [1] * 500}.items()}) for a in range(0, n, 500)]
    tracemalloc.start()
    got = pa.Table.from_batches(jaccard._bucket_hits(iter(blobs)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.num_rows == n // 2 and set(got["hits"].to_pylist()) == {1}
    assert peak < 400 * n


def test_matrix_bucket_counts_in_parts(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(b"%03d" % i, b"c%03d" % (i // 3), 3, 0, sorted(rng.sample(range(25), 8)), 10, 10, 10) for i in range(90)]
    table = spark.createDataFrame(rows, "digest binary, label binary, csize bigint, sub int, prefix array<bigint>, n bigint, low bigint, high bigint")
    want = jaccard._matrix_bounds(table, 1).toArrow().sort_by([("digest", "ascending"), ("label", "ascending")])
    batch = table.selectExpr("0 AS bucket", "digest", "label", "csize", "sub", "prefix", "CAST(n AS int) AS n").collect()
    for held in (1, 7, 100):
        monkeypatch.setattr(jaccard, "HELD", held)
        tokens = np.array([x for r in batch for x in r["prefix"]], np.uint64)
        owner = np.repeat(np.arange(90, dtype=np.int32), 8)
        cols = {"digests": [r["digest"] for r in batch], "labels": [r["label"] for r in batch], "csize": [3] * 90, "sub": [0] * 90, "n": [10] * 90, "low": [10] * 90, "high": [10] * 90, "total": [8] * 90}
        blob = pa.record_batch({"tokens": pa.array([tokens.tobytes()]), "owner": pa.array([owner.tobytes()])} | {k: pa.array([v], pa.list_(jaccard._OWNERS[k])) for k, v in cols.items()})
        got = pa.Table.from_batches(jaccard._bucket_hits(iter([blob]))).sort_by([("digest", "ascending"), ("label", "ascending")])
        brute = {(a[0], b[1]) for a in rows for b in rows if b[1] > a[1] and len(set(a[4]) & {x for r in rows if r[1] == b[1] for x in r[4]}) >= int(jaccard.least_hits(np.array([10]), np.array([10]), np.array([10]))[0])}
        assert {(a, b) for a, b in zip(got["digest"].to_pylist(), got["label"].to_pylist(), strict=True)} == brute == set(zip(want["digest"].to_pylist(), want["label"].to_pylist(), strict=True))
