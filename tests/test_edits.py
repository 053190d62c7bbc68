"""Replacements by offset, edit logs and overlays against brute force and literals."""

import random

from pyspark.sql import functions as F

from lodestone.operators import edits

ERRORS = "doc_id long, offset int, length int, id long, replacements array<string>"


def by_loops(text, errors):
    end, kept = 0, []
    for offset, length, i, fixes in sorted(errors, key=lambda e: (e[0], e[2])):
        if 0 <= offset and offset >= end and offset + length <= len(text):
            kept.append((offset, length, i, fixes))
            end = offset + length
    fixed = text
    for offset, length, _, fixes in reversed([k for k in kept if k[3]]):  # backwards, so that offsets hold
        fixed = fixed[:offset] + fixes[0] + fixed[offset + length :]
    return fixed, kept


def test_corrections_and_segments_equal_brute_force(spark):
    rng = random.Random(6)
    texts, errors = {}, {}
    for d in range(60):
        texts[d] = "".join(rng.choice("abcd é日😀") for _ in range(rng.randrange(30)))
        errors[d] = [(rng.randrange(-1, 32), rng.randrange(4), k, [rng.choice(["", "X", "long one"]) for _ in range(rng.randrange(3))]) for k in range(rng.randrange(6))]
    df = spark.createDataFrame(list(texts.items()) + [(99, None)], "doc_id long, text string")
    log = spark.createDataFrame([(d, *e) for d, es in errors.items() for e in es] + [(None, 0, 1, 1, ["x"]), (500, 0, 1, 1, ["x"])], ERRORS)
    got = {r.doc_id: r.text for r in edits.corrected(df, log).collect()}
    assert got == {d: by_loops(t, errors[d])[0] for d, t in texts.items()} | {99: ""}
    parts = {}
    for r in edits.segments(df, log).orderBy("doc_id", "part").collect():
        parts.setdefault(r.doc_id, []).append(r)
    for d, text in texts.items():
        own = parts.get(d, [])
        assert "".join(r.text for r in own) == text and [r.part for r in own] == list(range(len(own)))
        assert [(r.start, r.end - r.start, r.error) for r in own if r.error is not None] == [k[:3] for k in by_loops(text, errors[d])[1]]
        assert all(a.end == b.start for a, b in zip(own, own[1:])) and all(a.error is not None or b.error is not None for a, b in zip(own, own[1:]))


ROWS = "doc_id long, idx int, kind string, text string, style string, section string, wide boolean"


def rows_of(spark, *rows):
    full = [(1, i, *(tuple(r) + (None,) * (4 - len(r))), len(r) > 4 and r[4]) for i, r in enumerate(rows)]
    return spark.createDataFrame([r[:7] for r in full], ROWS)


def plain(df, *columns):
    rows = df.orderBy("idx").collect()
    assert [r.idx for r in rows] == list(range(len(rows)))
    return [tuple(r[c] for c in columns) for r in rows]


WIDE = ("table", "", None, None, True)


def turned(spark, *rows):
    df = rows_of(spark, *rows)
    once = edits.apply_log(df, edits.landscape_log(df))
    twice = edits.apply_log(once, edits.landscape_log(once))
    got = plain(once, "kind", "text", "section")
    assert plain(twice, "kind", "text", "section") == got  # nothing more on a second run
    return [s or (t or k) for k, t, s in got]


def test_wide_tables_lie_on_their_side(spark):
    assert turned(spark, ("p", "a"), WIDE, ("p", "b")) == ["a", "portrait", "table", "landscape", "b"]
    assert turned(spark, ("p", "a"), ("p", "Таблица 1 – x"), ("p", ""), WIDE) == ["a", "portrait", "Таблица 1 – x", "p", "table", "landscape"]
    assert turned(spark, ("p", "Таблица 1"), ("p", ""), ("p", ""), ("p", ""), WIDE)[:2] == ["Таблица 1", "p"]  # four above is too far
    assert turned(spark, ("p", "Таблица 1"), ("p", "text"), WIDE) == ["Таблица 1", "text", "portrait", "table", "landscape"]
    assert turned(spark, WIDE, WIDE) == ["portrait", "table", "landscape", "portrait", "table", "landscape"]
    assert turned(spark, ("p", "", None, "portrait"), WIDE) == ["portrait", "table"]  # a section ends there
    assert turned(spark, ("table", ""), ("p", "x")) == ["table", "x"]


def test_which_tables_are_wide(spark):
    cases = [(2, 20000, None, None, False), (3, 9639, None, None, True), (3, 9638, 20000, "dxa", False), (3, None, 9639, None, True), (3, None, 9639, "pct", False), (9, 1, None, None, True), (7, 8192, None, None, False), (7, 8193, None, None, True), (8, None, None, None, False)]
    df = spark.createDataFrame(cases, "columns int, grid int, width int, type string, want boolean")
    assert df.where(edits.is_wide(F.col("columns"), F.col("grid"), F.col("width"), F.col("type")) != F.col("want")).collect() == []


def contents(spark, *rows):
    df = rows_of(spark, *rows)
    once = edits.apply_log(df, edits.contents_log(df))
    got = plain(once, "text", "style")
    assert plain(edits.apply_log(once, edits.contents_log(once)), "text", "style") == got
    return got


def test_contents_are_replaced_where_they_are(spark):
    h = [("p", "One", "Heading1"), ("p", "Two", "Heading2"), ("p", "Two", "Heading2"), ("p", " ", "Heading1"), ("p", "One", "Heading1")]
    want = [("One", "TOC1"), ("Two", "TOC2"), ("One", "TOC1"), ("", "PageBreak")]
    rest = [(t, s) for _, t, s in h]
    assert contents(spark, ("p", "x", None), ("p", "old", "TOC1"), ("p", "older", "TOC2"), ("p", "", "PageBreak"), *h) == [("x", None), *want, *rest]
    assert contents(spark, ("p", "", "TOCField"), ("p", "y", None), *h) == [*want, ("y", None), *rest]
    assert contents(spark, ("p", "x", None), *h) == [("x", None), *rest]
    assert contents(spark, ("p", "old", "TOC1"), ("p", "x", None)) == [("old", "TOC1"), ("x", None)]


def test_tables_that_serve_as_contents_go(spark):
    assert contents(spark, ("table", "Введение\nЗаключение"), ("table", "глава 1\n1 a\n1.1 b\n2 c"), ("table", "глава 1\n1 a\n2 c"), ("table", "1 a\n2 b\n3 c")) == [("глава 1\n1 a\n2 c", None), ("1 a\n2 b\n3 c", None)]


def test_logs_insert_replace_and_delete(spark):
    df = rows_of(spark, ("p", "a"), ("p", "b"), ("p", "c"))
    log = spark.createDataFrame([(1, 1, "replace", 1, "B2"), (1, 1, "replace", 0, "B1"), (1, 0, "after", 0, "+a"), (1, 2, "delete", 0, None), (1, 2, "before", 0, "-c"), (1, 2, "after", 0, "+c")], "doc_id long, idx int, op string, rank int, text string")
    assert [t for (t,) in plain(edits.apply_log(df, log), "text")] == ["a", "+a", "B1", "B2", "-c", "+c"]


def test_cells(spark):
    df = spark.createDataFrame([(0, "12", None), (1, " -1 234,5 % ", 22.0), (1, "1a", 19.0), (1, "–", 30.0), (1, "", 24.0)], "row int, text string, size double")
    assert [(r.alignment, r.size) for r in edits.normal_cells(df).collect()] == [("center", 24.0), ("center", 22.0), ("left", 24.0), ("left", 24.0), ("left", 24.0)]


DEFAULTS = {"document": {"margin": 20, "justify": True, "font": "Times"}, "text": {"size": 14.0}, "lists": {"deep": {"mark": "–"}}, "version": 1}
KINDS = {"int": "int", "bool": "boolean", "str": "string", "float": "double"}


def test_overlay_keeps_null_false_and_missing_apart(spark):
    given = ['{}', '{"document": {"margin": 0, "justify": false, "font": ""}, "version": null}', '{"document": {"margin": null}, "text": null, "lists": {"deep": {"mark": "*"}}}', '{"document": {"margin": "wide"}, "text": {"size": 12}, "other": 1}', '{"text": [1], "lists": {"deep": 3}}']
    df = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, g string")
    got = [r.x.asDict(recursive=True) for r in df.select("i", edits.overlay(F.parse_json("g"), DEFAULTS, KINDS).alias("x")).orderBy("i").collect()]
    d = {"margin": 20, "justify": True, "font": "Times"}
    assert got[0] == DEFAULTS
    assert got[1] == DEFAULTS | {"document": {"margin": 0, "justify": False, "font": ""}, "version": None}
    assert got[2] == DEFAULTS | {"document": d | {"margin": None}, "lists": {"deep": {"mark": "*"}}}
    assert got[3] == DEFAULTS | {"document": d | {"margin": None}, "text": {"size": 12.0}}
    assert got[4] == DEFAULTS


def test_anchors_take_lines_once_and_orphans_go_to_the_end(spark):
    lines = [(1, i, t) for i, t in enumerate(["Intro", "## __The results__ of it", "the  RESULTS of it", "short", "end of the text"])] + [(2, 0, "nothing here")]
    tables = [(1, 0, "The results of it"), (1, 1, "the results\tof it"), (1, 2, "The results of it"), (1, 3, "short"), (1, 4, "end of the text"), (2, 0, "absent anchor")]
    given = spark.createDataFrame(lines, "doc_id long, idx int, text string")
    asked = spark.createDataFrame([(d, n, t, [f"| {d}.{n} |", "|---|"]) for d, n, t in tables], "doc_id long, n int, text string, rows array<string>")
    assert {(r.doc_id, r.n): r.line for r in edits.anchored(given, asked).collect()} == {(1, 0): 1, (1, 1): 2, (1, 2): None, (1, 3): None, (1, 4): 4, (2, 0): None}
    got = edits.apply_log(given, edits.tables_log(given, asked))
    assert [r.text for r in got.where("doc_id = 1").orderBy("idx").collect()] == [
        "Intro", "## __The results__ of it", "", "| 1.0 |", "|---|", "", "the  RESULTS of it", "", "| 1.1 |", "|---|", "", "short", "end of the text", "", "| 1.4 |", "|---|", "",
        "", edits.ORPHANS, "", "| 1.2 |", "|---|", "", "| 1.3 |", "|---|",
    ]
    assert [r.text for r in got.where("doc_id = 2").orderBy("idx").collect()] == ["nothing here", "", edits.ORPHANS, "", "| 2.0 |", "|---|"]


def test_errors_of_words_are_dealt_and_cut_within_rows(spark):
    """The queries whose errors follow from each text shuffle nothing."""
    import __spark_entry__ as entry

    for name in ("x1_corrections_applied", "x3_plain_and_error_spans"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan, name
