"""Packaged documents made from the lines of ``documents`` and read back through element rows.

The parts are made by column expressions with properties dealt by place (doc_id + idx), in markup that the reader must
resolve: split runs, links, styles with parents, merged cells, sections. The SQL knows nothing of markup; it counts on the
lines and the rule by which they were dealt.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import document_checks as dc
from ..operators import structure as st
from ..sources import markup
from ..sources.shared import materialise
from .catalog import Catalog, Tables
from .ordered import PARAGRAPHS, typed

catalog = Catalog()
query = catalog.query

STYLES = (
    '<w:styles><w:docDefaults><w:rPrDefault><w:rPr><w:rFonts w:ascii="Arial"/><w:sz w:val="24"/></w:rPr></w:rPrDefault></w:docDefaults>'
    '<w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:rPr><w:rFonts w:ascii="Times New Roman"/></w:rPr></w:style>'
    '<w:style w:styleId="Base"><w:basedOn w:val="Normal"/><w:rPr><w:sz w:val="28"/></w:rPr></w:style>'
    + "".join(f'<w:style w:styleId="{s}"><w:basedOn w:val="Base"/></w:style>' for s in ("Body", "Heading1", "Heading2", "TOC1"))
    + "</w:styles>"
)

K = "(doc_id + idx)"
#: What a line says in the document, by place: some end in two dots, some have a doubled space.
TEXT = f"CASE WHEN {K} % 12 = 5 THEN text || '..' WHEN {K} % 10 = 3 THEN replace(text, ' ', '  ') ELSE text END"
STYLE = f"CASE WHEN type = 'heading_1' THEN 'Heading1' WHEN type = 'heading_2' THEN 'Heading2' WHEN type = 'bibliography_title' AND {K} % 2 = 0 THEN 'TOC1' WHEN type = 'body' THEN 'Body' END"
LABEL = "CASE WHEN idx = 0 AND doc_id % 2 = 0 THEN 'title_page' WHEN type = 'body' THEN 'body_text' WHEN type = '' THEN 'quote' WHEN type = 'bibliography_title' THEN 'toc' ELSE type END"
ALIGNMENT = f"CASE {K} % 8 WHEN 0 THEN 'left' WHEN 1 THEN 'center' WHEN 2 THEN NULL ELSE 'both' END"
LINE = f"CASE {K} % 4 WHEN 0 THEN 240 WHEN 1 THEN NULL ELSE 365 END"
INDENT = f"CASE WHEN {K} % 9 <> 0 THEN 700 + ({K} % 3) * 40 END"


def tag(name: str, *attributes: tuple[str, Column | str | int]) -> Column:
    parts = [F.lit(f"<w:{name}")]
    for a, v in attributes:
        parts += [F.lit(f' w:{a}="'), v.cast("string") if isinstance(v, Column) else F.lit(str(v)), F.lit('"')]
    return F.concat(*parts, F.lit("/>"))


def when(condition: str, then: Column | str) -> Column:
    return F.when(F.expr(condition), then if isinstance(then, Column) else F.lit(then)).otherwise("")


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def run(properties: Column | str, text: Column) -> Column:
    return F.concat(F.lit("<w:r><w:rPr>"), properties if isinstance(properties, Column) else F.lit(properties), F.lit('</w:rPr><w:t xml:space="preserve">'), text, F.lit("</w:t></w:r>"))


def paragraph_xml() -> Column:
    """Markup of a line that isn't a table: two runs, the second sometimes in a link; sometimes a picture, a field or a section's end."""
    text, half = F.col("said"), F.floor(F.length("said") / 2).cast("int")
    properties = F.concat(
        F.when(F.col("style").isNotNull(), tag("pStyle", ("val", F.col("style")))).otherwise(""),
        when(f"{K} % 3 = 0", "<w:pageBreakBefore/>"),
        F.when(F.col("line").isNotNull(), tag("spacing", ("line", F.col("line")))).otherwise(""),
        F.when(F.expr(f"{K} % 9 = 1"), tag("ind", ("firstLine", F.col("indent")), ("hanging", 100))).when(F.col("indent").isNotNull(), tag("ind", ("firstLine", F.col("indent")))).otherwise(""),
        F.when(F.col("alignment").isNotNull(), tag("jc", ("val", F.col("alignment")))).otherwise(""),
        when(f"{K} % 19 = 0", '<w:sectPr><w:pgSz w:w="16838" w:h="11906" w:orient="landscape"/></w:sectPr>'),
    )
    first = F.concat(when(f"{K} % 6 = 0", '<w:sz w:val="24"/>'), when(f"{K} % 5 <> 0", "<w:b/>"), when(f"{K} % 17 = 0", '<w:color w:val="FF0000"/>'), when(f"{K} % 17 = 1", '<w:color w:val="auto"/>'), when(f"{K} % 17 = 2", '<w:highlight w:val="yellow"/>'))
    second = F.concat(when(f"{K} % 7 = 1", '<w:rFonts w:ascii="Arial"/>'), when(f"{K} % 11 = 0", '<w:u w:val="single"/>'))
    tail = run(second, escaped(F.substr(text, half + 1)))
    extent = F.concat(F.lit('<w:r><w:drawing><wp:inline><wp:extent cx="'), F.expr(f"CAST(5900000 + {K} % 20 * 10000 AS STRING)"), F.lit('"/></wp:inline></w:drawing></w:r>'))
    return F.concat(
        F.lit("<w:p><w:pPr>"), properties, F.lit("</w:pPr>"), run(first, escaped(F.substr(text, F.lit(1), half))),
        F.when(F.expr(f"{K} % 13 = 0"), F.concat(F.lit("<w:hyperlink>"), tail, F.lit("</w:hyperlink>"))).otherwise(tail),
        F.when(F.expr(f"{K} % 10 = 0"), extent).otherwise(""), when("idx = 0 AND doc_id % 5 = 0", '<w:r><w:instrText>TOC \\o "1-3"</w:instrText></w:r>'), F.lit("</w:p>"),
    )


def table_xml() -> Column:
    """Markup of a line that is a table of two rows: a spanning or a plain first cell, a cell with empty paragraphs, a vertical merge."""
    width = F.when(F.expr(f"{K} % 5 = 0"), tag("tblW", ("type", "pct"), ("w", 5100))).when(F.expr(f"{K} % 5 = 1"), tag("tblW", ("type", "dxa"), ("w", 9500))).otherwise(tag("tblW", ("type", "pct"), ("w", 5000)))
    cell = lambda properties, inner: F.concat(F.lit("<w:tc><w:tcPr>"), properties, F.lit("</w:tcPr>"), inner, F.lit("</w:tc>"))
    size = F.when(F.expr(f"{K} % 11 = 0"), F.lit('<w:sz w:val="16"/>')).otherwise('<w:sz w:val="24"/>')
    text = F.concat(F.lit("<w:p>"), run(size, escaped(F.col("said"))), F.lit("</w:p>"))
    merged = f"{K} % 7 = 1"
    return F.concat(
        F.lit("<w:tbl><w:tblPr>"), width, F.lit("</w:tblPr><w:tr><w:trPr>"), when(f"{K} % 3 <> 0", "<w:tblHeader/>"), F.lit("</w:trPr>"),
        cell(when(f"{K} % 4 = 0", '<w:gridSpan w:val="2"/>'), text), cell(when(merged, '<w:vMerge w:val="restart"/>'), F.lit("<w:p><w:r><w:t>n</w:t></w:r></w:p>")),
        F.lit("</w:tr><w:tr>"), cell(F.lit(""), F.concat(F.lit("<w:p/>"), when(f"{K} % 6 = 0", "<w:p/><w:p/>"))), when(f"{K} % 4 = 0", "<w:tc><w:p/></w:tc>"),
        cell(when(merged, "<w:vMerge/>"), F.lit("<w:p/>")), F.lit("</w:tr></w:tbl>"),
    )


def dealt(t: Tables) -> DataFrame:
    return typed(t).selectExpr("*", f"{TEXT} AS said", f"{STYLE} AS style", f"{ALIGNMENT} AS alignment", f"{LINE} AS line", f"{INDENT} AS indent")


def parts_of(rows: DataFrame, xml: Column, end: Column, pictures: Column) -> DataFrame:
    """The parts of each document: its lines' markup in order, what ends it, its styles, and a number of pictures."""
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", xml.alias("xml")))), lambda x: x["xml"]), "")
    made = rows.groupBy("doc_id").agg(body.alias("body")).withColumn("xml", F.concat(F.lit("<w:document><w:body>"), "body", end, F.lit("</w:body></w:document>")))
    media = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(i < pictures, F.struct(F.concat(F.lit("word/media/image"), i.cast("string"), F.lit(".png")).alias("part"), F.lit(None).cast("string").alias("xml"))))
    parts = F.concat(F.array(F.struct(F.lit(st.DOCUMENT).alias("part"), "xml"), F.struct(F.lit(st.STYLES).alias("part"), F.lit(STYLES).alias("xml"))), F.array_compact(media))
    return made.select("doc_id", F.explode(parts).alias("x")).select(F.col("doc_id").alias("key"), "x.part", "x.xml")


def margins() -> Column:
    return F.concat(F.lit('<w:sectPr><w:pgMar w:top="'), F.expr("CAST(1134 + doc_id % 3 * 100 AS STRING)"), F.lit('" w:bottom="1134" w:left="'), F.expr("CAST(1701 - doc_id % 2 * 200 AS STRING)"), F.lit('" w:right="850"/></w:sectPr>'))


def formatted(t: Tables) -> DataFrame:
    """Element rows of the documents as they are after formatting, written once: each part of the structure reads its columns of them."""
    xml = F.when(F.col("type") == "table", table_xml()).otherwise(paragraph_xml())
    end = F.concat(when("doc_id % 3 = 0", "<w:p><w:r><w:t>Содержание</w:t></w:r></w:p>"), margins())
    return materialise(markup.part_elements(parts_of(dealt(t), xml, end, F.expr("doc_id % 2"))), "formatted", small_groups=True)


def before(t: Tables) -> DataFrame:
    """Element rows of the same documents before: plain paragraphs, and here and there tables, pictures and text that got lost."""
    plain = F.concat(F.lit("<w:p><w:r><w:t>"), escaped(F.col("said")), F.lit("</w:t></w:r></w:p>"))
    lost = F.concat(F.lit("<w:p><w:r><w:t>"), F.repeat(F.lit("x"), F.expr("CAST(doc_id % 5 * 40 AS INT)")), F.lit("</w:t></w:r></w:p>"))
    end = F.concat(lost, F.repeat(F.lit("<w:tbl/>"), F.expr("CAST(doc_id % 4 AS INT)")))
    return materialise(markup.part_elements(parts_of(dealt(t), F.when(F.col("type") == "table", table_xml()).otherwise(plain), end, F.expr("doc_id % 3"))), "before", small_groups=True)


_MADE = PARAGRAPHS + f""", f AS (SELECT *, {TEXT} AS said, {STYLE} AS style, {LABEL} AS label, {ALIGNMENT} AS alignment, {LINE} AS line, {INDENT} AS indent, {K} AS k FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS pidx FROM f WHERE type <> 'table')
"""


@query(_MADE + """SELECT CAST(doc_id AS VARCHAR) AS key, CAST(pidx AS INTEGER) AS idx, md5(said) AS text_md5, style, alignment, CASE WHEN k % 7 = 1 THEN ['Arial', 'Times New Roman'] ELSE ['Times New Roman'] END AS fonts,
list_sort(list_distinct([CASE WHEN k % 6 = 0 OR style IS NULL THEN 24.0::DOUBLE ELSE 28 END, CASE WHEN style IS NULL THEN 24.0::DOUBLE ELSE 28 END])) AS sizes, k % 11 = 0 AS underline, k % 5 <> 0 AS bold, k % 19 = 0 AS ends_section FROM n""")
def s5_s6_typed_paragraphs(t: Tables) -> DataFrame:
    """Paragraphs of the body with the fonts and sizes that they show."""
    elements = formatted(t)
    rows = st.paragraph_rows(st.with_effective_values(st.run_rows(elements), st.style_values(elements))).where("in_body")
    last = F.max("idx").over(Window.partitionBy("key"))
    rows = rows.withColumn("last", last).where((F.col("key").cast("long") % 3 != 0) | (F.col("idx") < F.col("last")))  # the added title of contents
    return rows.select("key", "idx", F.md5("text").alias("text_md5"), "style", "alignment", F.array_sort("fonts").alias("fonts"), F.array_sort("sizes").alias("sizes"), "underline", F.coalesce("first_bold", F.lit(False)).alias("bold"), "ends_section")


@query(_MADE + """SELECT CAST(doc_id AS VARCHAR) AS key, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS BIGINT) AS "table", CAST(2 AS BIGINT) AS n_rows, CAST(CASE WHEN k % 4 = 0 THEN 3 ELSE 2 END AS INTEGER) AS columns, k % 4 = 0 OR k % 7 = 1 AS merged, k % 3 <> 0 AS has_header,
md5(trim(said)) AS first_md5, md5(CASE WHEN prev_type <> 'table' THEN trim(prev) ELSE '' END) AS before_md5, CAST(CASE WHEN k % 7 = 1 THEN 1 ELSE 0 END AS BIGINT) AS continued FROM
(SELECT *, coalesce(lag(said) OVER w, '') AS prev, coalesce(lag(type) OVER w, 'table') AS prev_type FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY idx)) WHERE type = 'table'""")
def s7_merged_tables(t: Tables) -> DataFrame:
    """Tables with their widest row, merged cells (those that continue one above counted), header and the paragraph before."""
    elements = formatted(t)
    cells = st.cell_rows(elements)
    continued = cells.groupBy("key", "block").agg(F.count_if(F.col("origin") < F.col("row")).alias("continued"))
    rows = st.table_rows(elements, cells).join(continued, ["key", "block"])
    return rows.select("key", "table", "n_rows", "columns", "merged", "has_header", F.md5(F.get(F.get("rows", F.lit(0)), F.lit(0))).alias("first_md5"), F.md5("before").alias("before_md5"), "continued")


@query(_MADE + """, b AS (SELECT doc_id, idx, 297.0 AS width FROM n WHERE k % 19 = 0 UNION ALL SELECT doc_id, max(idx) + 1 + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END, 210.0 FROM f GROUP BY doc_id)
SELECT CAST(doc_id AS VARCHAR) AS key, CAST(row_number() OVER w - 1 AS INTEGER) AS section, CAST(coalesce(lag(idx) OVER w + 1, 0) AS INTEGER) AS from_block, CAST(idx AS INTEGER) AS to_block, width = 297 AS landscape, CAST(round(width) AS BIGINT) AS width_mm FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY idx)""")
def s5_sections(t: Tables) -> DataFrame:
    """Sections and the blocks that each governs."""
    return st.section_rows(formatted(t)).select("key", "section", "from_block", "to_block", "landscape", F.round("width").cast("long").alias("width_mm"))


@query(_MADE + """, l AS (SELECT doc_id, style, said AS text, len(list_filter(regexp_split_to_array(said, '\\s+'), lambda w: w <> '')) AS words, type = 'table' AS cells, CASE WHEN k % 4 = 0 THEN 3 ELSE 2 END AS columns FROM f)
SELECT CAST(doc_id AS VARCHAR) AS key, count(*) FILTER (style = 'Heading1') AS h1, count(*) FILTER (style = 'Heading2') AS h2, CAST(0 AS BIGINT) AS h3, CAST(sum(CASE WHEN cells THEN 3 WHEN words > 0 OR style IN ('Heading1', 'Heading2') THEN 1 ELSE 0 END) + any_value((doc_id % 3 = 0)::INT) AS BIGINT) AS paragraphs,
CAST(sum(CASE WHEN cells THEN words + 2 + 2 * (columns + 1) WHEN style IN ('Heading1', 'Heading2') THEN words + 1 ELSE words END) + any_value((doc_id % 3 = 0)::INT) AS BIGINT) AS words, CAST(0 AS BIGINT) AS formulas FROM l GROUP BY doc_id""")
def s8_markdown_statistics(t: Tables) -> DataFrame:
    """Counts over the documents' markdown."""
    elements = formatted(t)
    runs = st.run_rows(elements).withColumn("own_size", F.col("size"))  # what fonts and sizes show isn't counted
    lines = st.markdown_lines(st.paragraph_rows(runs), st.table_rows(elements, st.cell_rows(elements)))
    return st.markdown_statistics(lines, elements)


def labels(t: Tables) -> DataFrame:
    rows = typed(t).where("type <> 'table'").selectExpr("CAST(doc_id AS STRING) AS key", "idx AS place", f"{LABEL} AS block_type")
    return rows.select("key", (F.row_number().over(Window.partitionBy("key").orderBy("place")) - 1).alias("idx"), "block_type")


_STRUCTURAL = ", ".join(f"'{s}'" for s in dc.STRUCTURAL)
_CHECKS = _MADE + f""", a AS (SELECT *, trim(said) AS words, label IN ('body_text', 'quote') AND NOT (regexp_matches(trim(said), '^[0-9][0-9.]*\\s') AND length(trim(said)) < 120) AS body FROM n),
s AS (SELECT *, label LIKE 'heading%' AND words <> '' AND length(words) < 150 AS heading, max(CASE WHEN label = 'title_page' THEN idx END) OVER (PARTITION BY doc_id) AS title FROM a),
h AS (SELECT *, heading AND list_position([{_STRUCTURAL}], lower(regexp_replace(trim(regexp_replace(said, '(?i)^(глава\\s+)?[0-9][0-9.\\s]*', '')), '\\.+$', ''))) IS NULL AS plain_heading FROM s),
g AS (SELECT doc_id, unnest([
{{'i': 'text.fontFamily', 'n': count(*) FILTER (body), 'b': count(*) FILTER (body AND k % 7 = 1)}},
{{'i': 'text.fontSize', 'n': count(*) FILTER (body), 'b': count(*) FILTER (body AND (style IS NULL OR k % 6 = 0))}},
{{'i': 'text.lineSpacing', 'n': count(*) FILTER (body AND words <> ''), 'b': count(*) FILTER (body AND words <> '' AND abs(line - 360) > 10)}},
{{'i': 'text.firstLineIndent', 'n': count(*) FILTER (body AND words <> ''), 'b': count(*) FILTER (body AND words <> '' AND (k % 9 IN (0, 1) OR abs(indent - 709) > 57))}},
{{'i': 'text.alignment', 'n': count(*) FILTER (body), 'b': count(*) FILTER (body AND alignment <> 'both')}},
{{'i': 'text.multipleSpaces', 'n': count(*) + any_value(doc_id % 3 = 0)::INT, 'b': count(*) FILTER (contains(said, '  '))}},
{{'i': 'text.noUnderline', 'n': count(*) FILTER (label <> 'title_page') + any_value(doc_id % 3 = 0)::INT, 'b': count(*) FILTER (label <> 'title_page' AND k % 11 = 0)}},
{{'i': 'text.noColoredText', 'n': count(*) FILTER (label <> 'title_page') + any_value(doc_id % 3 = 0)::INT, 'b': count(*) FILTER (label <> 'title_page' AND k % 17 IN (0, 2))}},
{{'i': 'text.doubleDots', 'n': count(*) + any_value(doc_id % 3 = 0)::INT, 'b': count(*) FILTER (regexp_matches(said, '(^|[^.])\\.\\.([^.]|$)'))}},
{{'i': 'headings.h1Format', 'n': count(*) FILTER (heading AND label = 'heading_1'), 'b': count(*) FILTER (heading AND label = 'heading_1' AND NOT (coalesce(alignment = 'center', false) AND k % 5 <> 0 AND k % 3 = 0))}},
{{'i': 'headings.h2Format', 'n': count(*) FILTER (heading AND label = 'heading_2'), 'b': count(*) FILTER (heading AND label = 'heading_2' AND NOT (coalesce(alignment IN ('both', 'left'), true) AND k % 5 <> 0))}},
{{'i': 'headings.numbering', 'n': count(*) FILTER (plain_heading), 'b': count(*) FILTER (plain_heading AND NOT regexp_matches(words, '^[0-9][0-9.]*\\s'))}},
{{'i': 'structure.sectionBreakAfterTitle', 'n': count(*) FILTER (title IS NOT NULL AND idx = title), 'b': (count(title) > 0 AND count(*) FILTER (k % 19 = 0 AND idx BETWEEN title AND title + 5) = 0)::INT}},
{{'i': 'structure.tocNoGarbage', 'n': count(*) FILTER (label = 'toc'), 'b': count(*) FILTER (label = 'toc' AND length(said) > 200) + count(*) FILTER (label = 'toc' AND k % 10 = 0)}},
{{'i': 'structure.titlePage', 'n': 1, 'b': (NOT (count(title) > 0 OR coalesce(min_by(label, idx) LIKE 'heading%', false)))::INT}}]) AS c FROM h GROUP BY doc_id),
d AS (SELECT doc_id, unnest([
{{'i': 'page.margins.top', 'n': 1, 'b': (doc_id % 3 = 2)::INT}}, {{'i': 'page.margins.bottom', 'n': 1, 'b': 0}}, {{'i': 'page.margins.left', 'n': 1, 'b': (doc_id % 2 = 1)::INT}}, {{'i': 'page.margins.right', 'n': 1, 'b': 0}},
{{'i': 'structure.tocFieldCode', 'n': 1, 'b': (NOT (count(*) FILTER (style = 'TOC1' AND type <> 'table') > 0 OR (doc_id % 5 = 0 AND count(*) FILTER (idx = 0 AND type <> 'table') > 0)))::INT}},
{{'i': 'structure.tocHeading', 'n': 1, 'b': (doc_id % 3 <> 0)::INT}},
{{'i': 'tables.width', 'n': count(*) FILTER (type = 'table'), 'b': count(*) FILTER (type = 'table' AND k % 5 < 2)}},
{{'i': 'tables.headerRepeat', 'n': count(*) FILTER (type = 'table'), 'b': count(*) FILTER (type = 'table' AND k % 3 = 0)}},
{{'i': 'tables.emptyCellParagraphs', 'n': count(*) FILTER (type = 'table'), 'b': 2 * count(*) FILTER (type = 'table' AND k % 6 = 0)}},
{{'i': 'tables.fontSize', 'n': count(*) FILTER (type = 'table'), 'b': count(*) FILTER (type = 'table' AND k % 11 = 0)}},
{{'i': 'images.noOverflow', 'n': count(*) FILTER (type <> 'table' AND k % 10 = 0), 'b': count(*) FILTER (type <> 'table' AND k % 20 = 10)}},
{{'i': 'preservation.images', 'n': doc_id % 3, 'b': greatest(doc_id % 3 - doc_id % 2, 0)}},
{{'i': 'preservation.tables', 'n': count(*) FILTER (type = 'table') + doc_id % 4, 'b': CASE WHEN doc_id % 4 > 1 THEN doc_id % 4 ELSE 0 END}},
{{'i': 'preservation.contentLoss', 'n': 1, 'b': CASE WHEN any_value(pct) > 5 THEN any_value(pct) ELSE 0 END}}]) AS c, any_value(pct) AS pct FROM f JOIN
(SELECT doc_id, CASE WHEN c + doc_id % 5 * 40 > 0 THEN CAST(floor(100.0 * (doc_id % 5 * 40 - CASE WHEN doc_id % 3 = 0 THEN 10 ELSE 0 END) / (c + doc_id % 5 * 40) + 0.5) AS BIGINT) ELSE 0 END AS pct FROM (SELECT doc_id, coalesce(sum(length(regexp_replace(said, '\\s', '', 'g'))) FILTER (type <> 'table'), 0) AS c FROM f GROUP BY 1)) USING (doc_id) GROUP BY doc_id),
m AS (SELECT doc_id, i FROM (SELECT DISTINCT doc_id FROM f), (SELECT unnest(['text.fontFamily', 'text.fontSize', 'text.lineSpacing', 'text.firstLineIndent', 'text.alignment', 'text.multipleSpaces', 'text.noUnderline', 'text.noColoredText', 'text.doubleDots', 'headings.h1Format', 'headings.h2Format', 'headings.numbering', 'structure.sectionBreakAfterTitle', 'structure.tocNoGarbage', 'structure.titlePage']) AS i)),
r AS (SELECT doc_id, c.i AS i, c.n::BIGINT AS n, c.b::BIGINT AS b, NULL::BIGINT AS pct FROM g UNION ALL SELECT doc_id, c.i, c.n, c.b, pct FROM d
UNION ALL SELECT m.doc_id, m.i, CASE WHEN m.i IN ('structure.titlePage') THEN 1 WHEN m.i IN ('text.multipleSpaces', 'text.noUnderline', 'text.noColoredText', 'text.doubleDots') AND m.doc_id % 3 = 0 THEN 1 ELSE 0 END, (m.i = 'structure.titlePage')::INT, NULL FROM m WHERE m.doc_id NOT IN (SELECT doc_id FROM n))
"""
_SEVERITIES = "map {" + ", ".join(f"'{i}': '{s}'" for i, _, s in dc.CHECKS if i != "preservation.contentLoss") + "}"


def checked(t: Tables) -> DataFrame:
    after = dc.read_structure(formatted(t))
    after = replace(after, paragraphs=materialise(after.paragraphs, "paragraphs", small_groups=True))  # of the body and of cells they are counted apart
    return materialise(dc.run_document_checks(after, dc.read_structure(before(t), styled=False), labels(t)), "checks", small_groups=True)


@query(_CHECKS + f"SELECT CAST(doc_id AS VARCHAR) AS key, i AS check_id, split_part(i, '.', 1) AS category, CASE WHEN i = 'preservation.contentLoss' THEN CASE WHEN pct > 20 THEN 'critical' WHEN pct > 5 THEN 'major' ELSE 'minor' END ELSE {_SEVERITIES}[i] END AS severity, n AS n_evaluated, b AS bad_count, b = 0 AS passed FROM r")
def q1_q29_document_checks(t: Tables) -> DataFrame:
    """All 29 checks of each document against its original."""
    return checked(t)


@query(_CHECKS + f"SELECT CAST(doc_id AS VARCHAR) AS key, CAST(floor(100.0 * coalesce(sum(w) FILTER (b = 0), 0) / sum(w) + 0.5) AS BIGINT) AS score, count(*) FILTER (b > 0) AS failed FROM (SELECT *, CASE CASE WHEN i = 'preservation.contentLoss' THEN CASE WHEN pct > 20 THEN 'critical' WHEN pct > 5 THEN 'major' ELSE 'minor' END ELSE {_SEVERITIES}[i] END WHEN 'critical' THEN 10 WHEN 'major' THEN 5 ELSE 2 END AS w FROM r) GROUP BY doc_id")
def a16_document_scores(t: Tables) -> DataFrame:
    """Score of each document over its 29 checks."""
    from ..operators.relational import SEVERITY_WEIGHT, half_up

    weight = F.coalesce(*[F.when(F.col("severity") == k, v) for k, v in SEVERITY_WEIGHT.items()])
    sums = checked(t).groupBy("key").agg(F.sum(weight).alias("w"), F.sum(F.when(F.col("passed"), weight).otherwise(0)).alias("ok"), F.count_if(~F.col("passed")).alias("failed"))
    return sums.select("key", half_up(100 * F.col("ok") / F.col("w")).cast("long").alias("score"), "failed")


QUERIES, ORACLE_SQL = catalog.queries, catalog.sql
