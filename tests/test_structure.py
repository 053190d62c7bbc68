"""Typed rows of packaged documents written by hand, and each check flipped alone."""

import io
import zipfile

import pytest

from lodestone.operators import document_checks as dc
from lodestone.operators import structure as st
from lodestone.sources import markup

STYLES = """<w:styles><w:docDefaults><w:rPrDefault><w:rPr><w:rFonts w:ascii="Arial"/><w:sz w:val="24"/></w:rPr></w:rPrDefault></w:docDefaults>
<w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:rPr><w:rFonts w:ascii="Times New Roman"/></w:rPr></w:style>
<w:style w:styleId="Body"><w:basedOn w:val="Normal"/><w:rPr><w:sz w:val="28"/></w:rPr></w:style>
<w:style w:styleId="Deep"><w:basedOn w:val="Body"/></w:style>
<w:style w:styleId="A"><w:basedOn w:val="B"/></w:style><w:style w:styleId="B"><w:basedOn w:val="A"/><w:rPr><w:sz w:val="40"/></w:rPr></w:style></w:styles>"""


def package(body, styles=STYLES, pictures=0):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document><w:body>{body}</w:body></w:document>")
        if styles:
            z.writestr("word/styles.xml", styles)
        for i in range(pictures):
            z.writestr(f"word/media/image{i}.PNG", b"x")
    return out.getvalue()


def p(text, properties="", run="", more=""):
    return f'<w:p><w:pPr>{properties}</w:pPr><w:r><w:rPr>{run}</w:rPr><w:t xml:space="preserve">{text}</w:t></w:r>{more}</w:p>'


def elements(spark, *bodies, **options):
    return markup.file_elements(spark.createDataFrame([(str(i), package(b, **options)) for i, b in enumerate(bodies)], "path string, content binary"))


def test_paragraphs_take_their_own_runs_and_the_styles_of_their_chain(spark):
    body = (
        p("one ", '<w:pStyle w:val="Deep"/><w:jc w:val="both"/>', "<w:b/>", '<w:hyperlink><w:r><w:rPr><w:u w:val="single"/></w:rPr><w:t>two</w:t></w:r></w:hyperlink><w:r><w:t> three</w:t></w:r>')
        + "<w:sdt><w:sdtContent>" + p("in a control", '<w:pStyle w:val="A"/>') + "</w:sdtContent></w:sdt>"
        + "<w:p><w:r><w:pict><w:txbxContent>" + p("boxed", run='<w:color w:val="FF0000"/>') + "</w:txbxContent></w:pict><w:t>outside</w:t></w:r></w:p>"
        + "<w:p/>"
        + p("sized", run='<w:sz w:val="20"/><w:rFonts w:cs="Courier"/>', properties='<w:spacing w:line="360"/><w:ind w:firstLine="709"/><w:pageBreakBefore/>')
    )
    e = elements(spark, body)
    rows = st.paragraph_rows(st.with_effective_values(st.run_rows(e), st.style_values(e))).collect()
    got = {r.idx: r for r in rows if r.in_body}
    assert [got[i].text for i in range(5)] == ["one two three", "in a control", "outside", "", "sized"]
    assert (got[0].fonts, got[0].sizes, got[0].underline, got[0].first_bold, got[0].alignment, got[0].runs) == (["Times New Roman"], [28.0], True, True, "both", 3)
    assert (got[1].fonts, got[1].sizes, got[1].block) == (["Arial"], [40.0], 1)  # a cycle of parents ends, then the defaults
    assert not got[2].coloured and got[3].runs == 0
    assert (got[4].fonts, got[4].sizes, got[4].line, got[4].first_line, got[4].break_before) == (["Courier"], [20.0], 360.0, 709.0, True)
    assert [r.text for r in rows if not r.in_body] == ["boxed"]


TABLE = """<w:tbl><w:tblPr><w:tblW w:type="pct" w:w="5001"/></w:tblPr>
<w:tr><w:trPr><w:tblHeader/></w:trPr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>wide</w:t></w:r></w:p></w:tc><w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr><w:p><w:r><w:t>tall</w:t></w:r></w:p></w:tc></w:tr>
<w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r><w:r><w:t>b</w:t></w:r></w:p><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc></w:tr>
<w:tr><w:tc><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>inner</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:tc></w:tr></w:tbl>"""


def test_tables_with_merged_and_ragged_cells(spark):
    e = elements(spark, p("before") + p(" ") + TABLE + TABLE.replace("wide", "second") + p("after") + "<w:tbl/>")
    cells = st.cell_rows(e)
    first = {(r.row, r.cell): r for r in cells.where("block = 2").collect()}
    assert {k: (r.column, r.span, r.text, r.origin) for k, r in first.items()} == {
        (0, 0): (0, 2, "wide", 0), (0, 1): (2, 1, "tall", 0), (1, 0): (0, 1, "ab c", 1), (1, 1): (1, 1, "", 1), (1, 2): (2, 1, "", 0), (2, 0): (0, 1, "", 2),
    }
    tables = {r.table: r for r in st.table_rows(e, cells).collect()}
    assert [tables[i].before for i in range(3)] == ["before", "", "after"]
    assert tables[0].rows == [["wide", "tall"], ["ab c", "", ""], [""]] and tables[0].columns == 3 and tables[0].merged and tables[0].has_header
    assert tables[2].rows == [] and tables[2].columns == 0 and not tables[2].merged


def test_sections_govern_ranges(spark):
    own = '<w:sectPr><w:pgSz w:w="16838" w:h="11906" w:orient="landscape"/><w:pgMar w:top="567"/><w:type w:val="continuous"/></w:sectPr>'
    last = '<w:sectPr><w:footerReference/><w:pgNumType w:start="3"/><w:pgMar w:top="1134" w:bottom="1134" w:left="1701" w:right="850"/></w:sectPr>'
    rows = st.section_rows(elements(spark, p("a") + p("b", own) + TABLE + p("c") + last, p("no section"))).collect()
    by = {(r.key, r.section): r for r in rows}
    assert [(k, r.from_block, r.to_block) for k, r in sorted(by.items())] == [(("0", 0), 0, 1), (("0", 1), 2, 4), (("1", 0), 0, 0)]
    a, b, c = (by[k] for k in sorted(by))
    assert (a.landscape, a.break_type, round(a.top), a.left, a.of_body) == (True, "continuous", 10, 0.0, False)
    assert (b.landscape, b.break_type, round(b.left), b.numbered, b.first_page, b.of_body) == (False, "nextPage", 30, True, 3, True)
    assert (c.top, c.left, c.right, c.width, c.height) == (20.0, 30.0, 15.0, 210.0, 297.0)


def test_unreadable_parts_give_a_row(spark):
    files = spark.createDataFrame([("bad", b"no zip"), ("none", None), ("broken", package("<w:p>"))], "path string, content binary")
    got = {r.key: r.error for r in markup.file_elements(files).where("error is not null").collect()}
    assert set(got) == {"bad", "none", "broken"} and got["broken"].startswith("ExpatError")
    assert markup.part_elements(spark.createDataFrame([(1, "x.xml", None), (1, "y.png", None)], "key int, part string, xml string")).where("error is not null").count() == 1


MARGINS = {"top": 1134, "bottom": 1134, "left": 1701, "right": 851}
JUST = '<w:spacing w:line="360"/><w:ind w:firstLine="709"/><w:jc w:val="both"/>'
GRID = '<w:tbl><w:tblPr><w:tblW w:type="{kind}" w:w="{width}"/></w:tblPr><w:tr><w:trPr>{header}</w:trPr><w:tc><w:p/>{extra}</w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:rPr><w:sz w:val="{size}"/></w:rPr><w:t>x</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'


def document(**change):
    """A document that passes all checks but those that ``change`` spoils, and the labels of its paragraphs."""
    c = {
        "margins": MARGINS, "title": "University", "title_run": '<w:u w:val="single"/><w:color w:val="FF0000"/>', "break": "<w:sectPr/>", "toc": "СОДЕРЖАНИЕ", "toc_style": '<w:pStyle w:val="TOC1"/>', "entry": "1 Start 3", "toc_run": "",
        "h1": '<w:pStyle w:val="Heading1"/><w:jc w:val="center"/><w:pageBreakBefore/>', "h1_text": "1 Start", "h2": '<w:pStyle w:val="Heading2"/><w:jc w:val="both"/>', "bold": "<w:b/>",
        "body": "Some words here.", "properties": JUST, "run": '<w:rFonts w:ascii="Times New Roman"/><w:sz w:val="28"/>', "kind": "pct", "width": 5000, "header": "<w:tblHeader/>", "extra": "", "size": 24, "cx": 5_940_000, "tables": 1,
    } | change
    drawing = f'<w:p><w:r><w:drawing><wp:inline xmlns:wp="w"><wp:extent cx="{c["cx"]}"/></wp:inline></w:drawing></w:r></w:p>'
    grid = GRID.format(**{k: c[k] for k in ("kind", "width", "header", "extra", "size")})
    margins = "".join(f' w:{k}="{v}"' for k, v in c["margins"].items())
    body = [
        (p(c["title"], c["break"], c["title_run"]), "title_page"), (p(c["toc"]), "toc_heading"), (p(c["entry"], c["toc_style"], more=c["toc_run"]), "toc"),
        (p(c["h1_text"], c["h1"], c["bold"]), "heading_1"), (p("1.1 Part", c["h2"], c["bold"]), "heading_2"), (p(c["body"], c["properties"], c["run"]), "body_text"), (p("Введение.", c["h1"], "<w:b/>"), "heading_1"),
    ]
    xml = "".join(x for x, _ in body) + grid * c["tables"] + drawing + f"<w:sectPr><w:pgMar{margins}/></w:sectPr>"
    return xml, [label for _, label in body]


SPOILED = {
    **{f"page.margins.{s}": {"margins": MARGINS | {s: MARGINS[s] + 114}} for s in MARGINS},
    "text.fontFamily": {"run": '<w:rFonts w:ascii="Arial"/><w:sz w:val="28"/>'},
    "text.fontSize": {"run": '<w:rFonts w:ascii="Times New Roman"/><w:sz w:val="26"/>'},
    "text.lineSpacing": {"properties": JUST.replace("360", "371")},
    "text.firstLineIndent": {"properties": JUST.replace('w:firstLine="709"', 'w:firstLine="709" w:hanging="1"')},
    "text.alignment": {"properties": JUST.replace("both", "left")},
    "text.multipleSpaces": {"body": "Some  words."},
    "text.noUnderline": {"run": '<w:rFonts w:ascii="Times New Roman"/><w:sz w:val="28"/><w:u w:val="single"/>'},
    "text.noColoredText": {"run": '<w:rFonts w:ascii="Times New Roman"/><w:sz w:val="28"/><w:highlight w:val="yellow"/>'},
    "text.doubleDots": {"body": "Some words.."},
    "headings.h1Format": {"h1": '<w:pStyle w:val="Heading1"/><w:jc w:val="center"/>'},
    "headings.h2Format": {"h2": '<w:pStyle w:val="Heading2"/><w:jc w:val="right"/>'},
    "headings.numbering": {"h1_text": "Start"},
    "structure.tocFieldCode": {"toc_style": ""},
    "structure.tocHeading": {"toc": "Contents"},
    "structure.sectionBreakAfterTitle": {"break": "", "properties": JUST},
    "structure.tocNoGarbage": {"entry": "1 Start " + "x" * 200},
    "tables.width": {"width": 5001},
    "tables.headerRepeat": {"header": ""},
    "tables.emptyCellParagraphs": {"extra": "<w:p/>"},
    "tables.fontSize": {"size": 17},
    "images.noOverflow": {"cx": 5_940_001},
}


@pytest.fixture(scope="module")
def reports(spark):
    good, labels = document()
    files, old, named = [], [], []
    cases = {"none": {}} | SPOILED
    for name, change in cases.items():
        xml, labels = document(**change)
        files.append((name, package(xml, styles=None)))
        old.append((name, package(xml, styles=None)))
        named += [(name, i, label) for i, label in enumerate(labels)]
    three, _ = document(tables=3)
    plain, _ = document(title_run="")
    extra = {
        "structure.titlePage": (package(plain, styles=None), package(plain, styles=None), [x if x != "title_page" else "body_other" for x in labels]),
        "preservation.images": (package(good, styles=None), package(good, styles=None, pictures=2), labels),
        "preservation.tables": (package(good, styles=None), package(three, styles=None), labels),
        "preservation.contentLoss": (package(good, styles=None), package(good + p("x" * 400), styles=None), labels),
    }
    for name, (new, before, own) in extra.items():
        files.append((name, new))
        old.append((name, before))
        named += [(name, i, label) for i, label in enumerate(own)]
    files += [("two tables", package(good, styles=None)), ("unreadable", b"no zip"), ("heuristic", package(good, styles=None)), ("no words", package(good, styles=None))]
    two, _ = document(tables=2)
    old += [("two tables", package(two, styles=None)), ("unreadable", b"no zip"), ("heuristic", package(p("Университет") + p("Курсовая работа") + good, styles=None)), ("no words", package(good.replace("University", "x"), styles=None))]
    named += [("two tables", i, label) for i, label in enumerate(labels)]
    read = lambda rows: dc.read_structure(markup.file_elements(spark.createDataFrame(rows, "path string, content binary")))
    labels_df = spark.createDataFrame(named, "key string, idx int, block_type string")
    rows = dc.run_document_checks(read(files), read(old), labels_df).collect()
    found = {}
    for r in rows:
        found.setdefault(r.key, {})[r.check_id] = r
    return found


def test_a_good_document_passes_all(reports):
    assert len(reports["none"]) == 29 and [k for k, r in reports["none"].items() if not r.passed] == []
    evaluated = {k: r.n_evaluated for k, r in reports["none"].items()}
    assert evaluated["text.fontFamily"] == 1 and evaluated["headings.numbering"] == 2 and evaluated["headings.h1Format"] == 2 and evaluated["text.noUnderline"] == 7 and evaluated["images.noOverflow"] == 1


@pytest.mark.parametrize("name", [*SPOILED, "structure.titlePage", "preservation.images", "preservation.tables", "preservation.contentLoss"])
def test_one_change_flips_one_check(reports, name):
    assert [k for k, r in reports[name].items() if not r.passed] == [name] and reports[name][name].bad_count > 0


def test_one_lost_table_is_allowed_and_unreadable_files_fail(reports):
    assert reports["two tables"]["preservation.tables"].passed
    assert [(r.check_id, r.passed) for r in reports["unreadable"].values()] == [("system.error", False)]


def test_without_labels_a_title_page_is_told_by_words(reports):
    assert reports["heuristic"]["structure.titlePage"].passed and not reports["no words"]["structure.titlePage"].passed
    assert reports["heuristic"]["text.fontFamily"].n_evaluated == 0
    assert reports["heuristic"]["preservation.contentLoss"].severity == "critical"


def test_formatting_is_checked_in_all_of_a_body(spark):
    """What is wrong with the last of many paragraphs counts, in one of plain text as in a quote."""
    good, bad = p("Some words.", JUST, SPOILED["text.fontSize"]["run"].replace("26", "28")), p("Some words.", JUST.replace("360", "240").replace("709", "0").replace("both", "left"), '<w:rFonts w:ascii="Arial"/><w:sz w:val="26"/>')
    files = spark.createDataFrame([("a", package(good * 119 + bad, styles=None))], "path string, content binary")
    labels = spark.createDataFrame([("a", i, "quote" if i % 2 else "body_text") for i in range(120)], "key string, idx int, block_type string")
    read = dc.read_structure(markup.file_elements(files))
    found = {r.check_id: (r.n_evaluated, r.bad_count) for r in dc.run_document_checks(read, read, labels).collect()}
    assert {found[f"text.{k}"] for k in ("fontFamily", "fontSize", "lineSpacing", "firstLineIndent", "alignment")} == {(120, 1)}


def test_markdown_of_a_document(spark):
    e = elements(spark, p("Title", '<w:pStyle w:val="Heading1"/>') + TABLE.replace("wide", "a|b") + p("x <m> y".replace("<m>", "&lt;m&gt;"), more="<m:oMath xmlns:m='m'/>") + p(""))
    runs = st.with_effective_values(st.run_rows(e), st.style_values(e))
    lines = st.markdown_lines(st.paragraph_rows(runs), st.table_rows(e, st.cell_rows(e)))
    assert [r.text for r in lines.orderBy("block", "line").collect()] == ["# Title", "| a\\|b | tall |  |", "|---|---|---|", "| ab c |  |  |", "|  |  |  |", "x <m> y", ""]
    assert st.markdown_statistics(lines, e).drop("key").collect() == [(1, 0, 0, 6, 22, 1)]


def test_small_parts_share_batches():
    """Rows of many small parts leave a task in few batches, and with maps of attributes as they were."""
    import pyarrow as pa

    rows = [markup.elements_of(str(i), st.DOCUMENT, b'<w:document><w:body><w:p a="1" b="2"/><w:p/></w:body></w:document>') for i in range(100)]
    batches = list(markup._in_batches(some for part in rows for some in part))
    assert len(batches) == 1 and batches[0].num_rows == 400 and pa.types.is_map(batches[0].schema.field("attrs").type)
    assert batches[0].column("attrs").to_pylist()[:2] == [[("a", "1"), ("b", "2")], []]


def test_documents_are_parsed_once(spark):
    """The parts of a structure read written element rows; none parses the documents again."""
    import __spark_entry__ as entry

    for name in ("s5_s6_typed_paragraphs", "s5_sections", "s7_merged_tables", "s8_markdown_statistics", "a16_document_scores"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" not in plan, name


def test_originals_are_read_as_texts_and_lists_collected_by_sorting(spark, monkeypatch):
    """Of an original only texts are looked at, not runs with their properties; no written step hashes lists."""
    from lodestone.plans import package
    from lodestone.sources import shared
    from lodestone.sources.tables import table
    from types import SimpleNamespace

    asked, real = [], dc._paragraph_counts
    monkeypatch.setattr(dc, "_paragraph_counts", lambda *a: asked.append(a) or real(*a))
    by_hash = spark.conf.get(shared.BY_HASH, "true")
    settings, write = [], package.materialise
    monkeypatch.setattr(package, "materialise", lambda df, name, small_groups=False: settings.append((name, small_groups)) or write(df, name, small_groups))
    package.checked(SimpleNamespace(documents=table(spark, "/root/testdata/sf0.001", "documents").limit(20)))
    assert len(asked) == 1 and settings == [(name, True) for name in ("formatted", "paragraphs", "before", "checks")]
    assert spark.conf.get(shared.BY_HASH, "true") == by_hash


def test_runs_in_nested_wrappers_are_own(spark):
    e = elements(spark, "<w:p><w:ins><w:hyperlink><w:r><w:rPr><w:b/></w:rPr><w:t>in</w:t></w:r></w:hyperlink></w:ins><w:sdt><w:r><w:t>out</w:t></w:r></w:sdt></w:p>")
    runs = {r.text: (r.own, r.direct, r.bold) for r in st.run_rows(e).where("r is not null").collect()}
    assert runs["in"] == (True, False, True) and not any(own for text, (own, _, _) in runs.items() if text != "in")
