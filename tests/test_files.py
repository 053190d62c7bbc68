"""Texts by type of file, and the audit of posts."""

from pyspark.sql import functions as F

from lodestone.operators import audit
from lodestone.sources import docx, texts


def test_texts_by_type(spark):
    files = [("a.txt", b"\xef\xbf\xbdok\xff"), ("b.TXT", None), ("c.docx", docx.build([("x", None), ("", None), ("y", "center")])), ("d.docx", b"no zip"), ("e.pdf", b"%PDF"), ("noext", b"x"), ("f.docx", docx.build([]))]
    got = {r.path: (r.text, r.error) for r in texts.text_of(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert got["a.txt"] == ("�ok�", None) and got["b.TXT"] == ("", None) and got["c.docx"] == ("x\n\ny", None) and got["f.docx"] == ("", None)
    assert got["d.docx"][0] is None and got["d.docx"][1].startswith("BadZipFile")
    assert got["e.pdf"] == (None, "no reader for application/pdf") and got["noext"] == (None, "no reader for this type") and len(got) == 7


def test_audit(spark):
    rows = [("best", "Скачать образец 2026 бесплатно", "d" * 150, ["k"] * 10, 1), ("worst", "t" * 71, "d" * 200, None, None), (None, None, None, [], None), ("paid", "Небесплатно, в ворде", "", ["k"], 1)]
    got = {r.slug: r for r in audit.audit_posts(spark.createDataFrame(rows, "slug string, title string, description string, keywords array<string>, modified int")).collect()}
    assert got["best"].score == 100 and got["best"].issues == []
    assert (got["worst"].score, got["worst"].issues) == (15, ["year", "title 71", "description 200 long", "keywords 0", "modified", "free", "example"])
    assert got[None].score == 25 and got[None].title_length == 0
    assert not got["paid"].has_free and got["paid"].has_word and "free" not in got["paid"].issues
    assert got["paid"].issues == ["year", "description 0 short", "keywords 1", "example"]


def test_types_by_name(spark):
    names = ["x.DOCX", "a.b.pdf", "docx", "x.", None]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(texts.mime_by_name(F.col("n"))).collect()]
    assert got == [texts.TYPES["docx"], texts.TYPES["pdf"], texts.TYPES["docx"], None, None]
