from __future__ import annotations

from lectern.sources import files as f
from lectern.sources import sinks

GIT = """diff --git a/x.rst b/x.rst
--- a/x.rst
+++ b/x.rst
@@ -1,3 +1,4 @@
 one
-two
+two new
+more
 three
@@ -10,2 +11,1 @@
 ten
-eleven
\\ No newline at end of file
"""
SVN = "Index: a/b.rst\n===================================================================\n--- a/b.rst\t(revision 1)\n+++ a/b.rst\t(working copy)\n@@ -1 +1 @@\n-a\n+b\n"


def test_patches(spark, tmp_path):
    (tmp_path / "one.patch").write_text(GIT)
    (tmp_path / "two.patch").write_text(SVN)
    assert f.flavour(GIT) == "git" and f.flavour(SVN) == "svn" and f.flavour(None) is None
    rows = {(r["path"], r["start_line"]): (r["text"], [tuple(c) for c in r["changes"]]) for r in f.scan_patches(spark, str(tmp_path)).collect()}
    assert rows == {("x.rst", 0): ("one\ntwo new\nmore\nthree\n", [(1, 3)]), ("x.rst", 10): ("ten", [(11, 11)]), ("a/b.rst", 0): ("b\n", [(0, 1)])}


def test_texts_and_encodings(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.RST").write_bytes(b"x\r\ny\n")
    (tmp_path / "b.rst").write_bytes(b"ok \xff bad")
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in f.scan_texts(spark, str(tmp_path)).collect()}
    assert got == {"a.RST": "x\ny\n", "b.rst": None}
    assert [r["start"] for r in f.encoding_faults(spark, str(tmp_path)).collect()] == [3]


def test_images(spark, tmp_path):
    for name, data in (("a.png", b"1"), ("b.png", b"1"), ("Up.PNG", b"2"), ("up.jpg", b"3"), ("c.gif", b"4")):
        (tmp_path / name).write_bytes(data)
    images = f.scan_images(spark, str(tmp_path))
    assert [r["path"].rsplit("/", 1)[1] for r in f.duplicate_images(images).collect()] == ["b.png"]
    assert sorted((r["path"].rsplit("/", 1)[1], r["message"]) for r in f.image_names(images).collect()) == [("Up.PNG", "bad characters"), ("Up.PNG", "similar filename"), ("c.gif", "unusual file type"), ("up.jpg", "similar filename")]


def test_selection(spark):
    assert [f.selection(x) for x in ("a.rst", "a.rst:3-5", "a.rst:-5", "a.rst:3-", "a.rst:4")] == [("a.rst", None, None), ("a.rst", 3, 5), ("a.rst", None, 5), ("a.rst", 3, None), ("a.rst", 4, 4)]
    docs = spark.createDataFrame([("a", "1\n2\n3\n4"), ("b", None), ("c", "1")], "path string, text string")
    assert [r["text"] for r in f.select_lines(docs, 2, 3).orderBy("path").collect()] == ["2\n3", None, ""]


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(1, "ab\ncd e\n")], "doc_id long, text string")
    found = spark.createDataFrame([(1, 5, "W", "cd\ne", "told"), (1, 0, "L", None, "low")], "doc_id long, start long, severity string, output string, message string")
    at = sinks.locate(found, docs).selectExpr("'p' as path", "*")
    line = {r["start_line"]: r["line"] for r in sinks.render(at).collect()}
    assert line[1] == "p:2,3 W cd¶e told"
    assert {r["severity"]: r["n"] for r in sinks.summary(found).collect()} == {"W": 1, "total": 2}
    assert sinks.at_least(found, "I").count() == 1
    lexicon = spark.createDataFrame([("a", 3), ("b", 5)], "word string, n long")
    sinks.write_lexicon(lexicon, str(tmp_path / "lx"))
    assert {(r["word"], r["n"]) for r in f.read_lexicon(spark, str(tmp_path / "lx")).collect()} == {("a", 3), ("b", 5)}
    assert [sinks.write_out_quantity(k, "blank line") for k in (1, 2, 13, 42)] == ["one blank line", "two blank lines", "thirteen blank lines", "forty-two blank lines"]


def test_stream_counts_once(spark, tmp_path):
    from lectern.streaming import corpus

    src, out = tmp_path / "t" / "documents.parquet", str(tmp_path / "out")
    rows = lambda text: spark.createDataFrame([(1, text)], "doc_id long, text string").coalesce(1)
    rows("One two. Two").write.parquet(str(src))
    first = {r["word"]: r["n"] for r in corpus.lexicon(spark, str(tmp_path / "t"), out).collect()}
    assert first == {"one": 1, "two": 2}
    rows("two").write.mode("append").parquet(str(src))
    assert {r["word"]: r["n"] for r in corpus.lexicon(spark, str(tmp_path / "t"), out).collect()} == {"one": 1, "two": 3}
