"""The 29 checks of a document's typed rows, each with how much it evaluated and how much of that is bad."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import structure as st
from .relational import half_up

#: Fixed values of the rules: tolerances in twips, the widest picture in its own unit, numbers before headings.
MARGIN_TOLERANCE, INDENT_TOLERANCE, LINE_TOLERANCE, WIDTH_TOLERANCE = 113, 57, 10, 100
WIDEST_PICTURE = 5_940_000
NUMBERED = r"^[0-9][0-9.]*\s"
#: Headings that carry no number.
STRUCTURAL = [
    "введение", "заключение", "список литературы", "список использованных источников", "список источников", "содержание", "оглавление",
    "аннотация", "реферат", "приложение", "приложения", "abstract", "библиография", "список использованной литературы", "выводы",
    "выводы по главе", "рекомендации",
]
#: Titles of contents, and words of an institution, a kind of work, and an author that make a title page.
CONTENTS = ["СОДЕРЖАНИЕ", "ОГЛАВЛЕНИЕ"]
TITLE_MARKERS = [
    r"МИНИСТЕРСТВО|УНИВЕРСИТЕТ|ИНСТИТУТ|КОЛЛЕДЖ|АКАДЕМИЯ|ФАКУЛЬТЕТ|КАФЕДРА|ГБУЗ|ФГБОУ|ФГАОУ|УЧРЕЖДЕНИЕ|ШКОЛА|ГИМНАЗИЯ|ЛИЦЕЙ",
    r"КУРСОВАЯ|ДИПЛОМНАЯ|ВЫПУСКНАЯ|МАГИСТЕРСКАЯ|БАКАЛАВРСКАЯ|КУРСОВОЙ|ДИПЛОМНЫЙ|РЕФЕРАТ|ПОЯСНИТЕЛЬНАЯ ЗАПИСКА|ДИССЕРТАЦИЯ|ОТЧЁТ|ОТЧЕТ|ДОКЛАД|ЭССЕ|КОНТРОЛЬНАЯ РАБОТА|ЛАБОРАТОРНАЯ РАБОТА|ПРАКТИЧЕСКАЯ РАБОТА|ПРОЕКТ",
    r"ВЫПОЛНИЛ|АВТОР|СТУДЕНТ|ОБУЧАЮЩИЙСЯ|РУКОВОДИТЕЛЬ|УТВЕРЖДАЮ|СОГЛАСОВАНО|ПРОВЕРИЛ|ПРИНЯЛ|КАНДИДАТ|ДОКЛАДЧИК|УЧЕНИК|УЧЕНИЦА|ВОСПИТАННИК",
]
CONTENT_FIRST = r"^(СОДЕРЖАНИЕ|ОГЛАВЛЕНИЕ|СПИСОК (ИСПОЛЬЗОВАННЫХ )?ИСТОЧНИКОВ|СПИСОК ЛИТЕРАТУРЫ|БИБЛИОГРАФИЧЕСКИЙ СПИСОК|ВВЕДЕНИЕ|АННОТАЦИЯ|РЕФЕРАТ)$|^(ЗАДАЧА|ГЛАВА)\s*[0-9]"
#: Paragraphs that are searched for a title page's words.
EARLY = 40


@dataclass(frozen=True)
class Pack:
    """What a document should look like; lengths in millimetres, sizes in points."""

    top: float = 20
    bottom: float = 20
    left: float = 30
    right: float = 15
    font: str = "Times New Roman"
    size: float = 14
    line_spacing: float = 1.5
    indent: float = 12.5
    contents: str = "СОДЕРЖАНИЕ"

    def twips(self, name: str) -> int:
        return int(getattr(self, name) * st.TWIPS_PER_MM + 0.5)


@dataclass(frozen=True)
class Structure:
    """Typed rows of documents."""

    paragraphs: DataFrame
    cells: DataFrame
    tables: DataFrame
    sections: DataFrame
    elements: DataFrame


def read_structure(elements: DataFrame, styled: bool = True) -> Structure:
    """Typed rows from element rows; of an original no fonts and sizes are looked at, so its styles needn't be resolved (``styled``)."""
    runs = st.run_rows(elements)
    runs = st.with_effective_values(runs, st.style_values(elements)) if styled else runs.withColumn("own_size", F.col("size"))
    cells = st.cell_rows(elements)
    return Structure(st.paragraph_rows(runs), cells, st.table_rows(elements, cells), st.section_rows(elements), elements)


#: Identity, category and severity of each check, in the order of reports.
CHECKS = [
    *[(f"page.margins.{s}", "page", "critical") for s in ("top", "bottom", "left", "right")],
    ("text.fontFamily", "text", "critical"), ("text.fontSize", "text", "critical"), ("text.lineSpacing", "text", "critical"), ("text.firstLineIndent", "text", "critical"),
    ("text.alignment", "text", "major"), ("text.multipleSpaces", "text", "major"), ("text.noUnderline", "text", "major"), ("text.noColoredText", "text", "major"), ("text.doubleDots", "text", "minor"),
    ("headings.h1Format", "headings", "critical"), ("headings.h2Format", "headings", "major"), ("headings.numbering", "headings", "major"),
    ("structure.tocFieldCode", "structure", "critical"), ("structure.tocHeading", "structure", "major"), ("structure.titlePage", "structure", "critical"),
    ("structure.sectionBreakAfterTitle", "structure", "major"), ("structure.tocNoGarbage", "structure", "critical"),
    ("tables.width", "tables", "critical"), ("tables.headerRepeat", "tables", "major"), ("tables.emptyCellParagraphs", "tables", "minor"), ("tables.fontSize", "tables", "minor"),
    ("images.noOverflow", "images", "major"),
    ("preservation.images", "preservation", "critical"), ("preservation.tables", "preservation", "critical"), ("preservation.contentLoss", "preservation", "minor"),
]


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _paragraph_counts(s: Structure, labels: DataFrame | None, pack: Pack) -> DataFrame:
    rows = s.paragraphs.where("in_body")
    if labels is None:
        rows = rows.withColumn("label", F.lit(None).cast("string"))
    else:
        rows = rows.join(labels.select("key", "idx", F.col("block_type").alias("label")), ["key", "idx"], "left")
    label, text, trimmed = F.coalesce("label", F.lit("unknown")), F.col("text"), F.trim("text")
    title = label.startswith("title_page")
    body = label.isin("body_text", "quote") & ~(trimmed.rlike(NUMBERED) & (F.length(trimmed) < 120))
    written = body & (trimmed != "")
    heading = label.startswith("heading_") & (trimmed != "") & (F.length(trimmed) < 150) & _true(F.col("style").rlike(r"(?i)^Heading[0-9]$"))
    h1, h2 = heading & (label == "heading_1"), heading & (label == "heading_2")
    bold = (F.col("runs") == 0) | _true(F.col("first_bold"))
    bare = F.lower(F.regexp_replace(F.trim(F.regexp_replace(text, r"(?i)^(?:глава\s+)?[0-9][0-9.\s]*", "")), r"\.+$", ""))
    toc = label.isin("toc", "toc_entry")
    indent = F.col("first_line")
    bad_indent = (F.coalesce("hanging", F.lit(0)) > 0) | (F.coalesce(indent, F.lit(0)) == 0) | (F.abs(indent - pack.twips("indent")) > INDENT_TOLERANCE)
    expected_size = pack.size * 2
    # Places of title rows and of section breaks: the break may be on a title row or on the five body children after the last.
    rows = rows.withColumn("last_title", F.max(F.when(title, F.col("block"))).over(Window.partitionBy("key")))
    breaks = F.col("ends_section") & (title | (F.col("block") > F.col("last_title")) & (F.col("block") <= F.col("last_title") + 5))
    labelled = F.when(~label.isin("empty", "page_number", "unknown"), F.struct("idx", label.alias("label")))
    pairs = {
        "text.fontFamily": (body, F.exists("fonts", lambda f: f != pack.font)),
        "text.fontSize": (body, F.exists("sizes", lambda x: x != expected_size)),
        "text.lineSpacing": (written, F.abs(F.col("line") - int(pack.line_spacing * 240 + 0.5)) > LINE_TOLERANCE),
        "text.firstLineIndent": (written, bad_indent),
        "text.alignment": (body, (F.col("alignment") != "both") & (F.col("alignment") != "")),
        "text.multipleSpaces": (F.lit(True), text.contains("  ")),
        "text.noUnderline": (~title, F.col("underline")),
        "text.noColoredText": (~title, F.col("coloured")),
        "text.doubleDots": (F.lit(True), text.rlike(r"(?<!\.)\.\.(?!\.)")),
        "headings.h1Format": (h1, ~(_true(F.col("alignment") == "center") & bold & F.col("break_before"))),
        "headings.h2Format": (h2, ~(F.coalesce(F.col("alignment").isin("both", "left", ""), F.lit(True)) & bold)),
        "headings.numbering": (heading & ~bare.isin(STRUCTURAL), ~trimmed.rlike(NUMBERED)),
    }
    counts = [c for k, (of, bad) in pairs.items() for c in (F.count_if(of).alias(f"{k}|n"), F.count_if(of & _true(bad)).alias(f"{k}|bad"))]
    return rows.groupBy("key").agg(
        *counts,
        F.sum((toc & (F.length(text) > 200)).cast("int") + (toc & F.col("drawing")).cast("int")).alias("structure.tocNoGarbage|bad"),
        F.count_if(toc).alias("structure.tocNoGarbage|n"),
        F.bool_or(_true(F.col("style").rlike("^TOC[123]$"))).alias("static_toc"),
        F.bool_or(F.upper(trimmed).isin(pack.contents.upper(), *CONTENTS)).alias("toc_heading"),
        F.bool_or(title).alias("has_title"),
        F.bool_or(breaks).alias("has_break"),
        F.min(labelled)["label"].alias("first_label"),
        F.bool_or(F.col("label").isNotNull()).alias("has_labels"),
        F.sum(F.length(F.regexp_replace(text, r"\s", ""))).alias("chars"),
    )


def _table_counts(s: Structure, pack: Pack) -> DataFrame:
    page = int((210 - pack.left - pack.right) * st.TWIPS_PER_MM + 0.5)
    wide = ((F.col("width_type") == "pct") & (F.col("width") > 5000)) | ((F.col("width_type") == "dxa") & (F.col("width") > page + WIDTH_TOLERANCE))
    in_cells = s.paragraphs.where(F.col("place") == st.CELL_PARAGRAPH)
    cells = in_cells.groupBy("key", "block", "tc").agg(F.greatest(F.count_if(F.trim("text") == "") - 1, F.lit(0)).alias("empty"), F.bool_or(F.exists("own_sizes", lambda x: (x < 18) | (x > 28))).alias("odd"))
    per_table = cells.groupBy("key", "block").agg(F.sum("empty").alias("empty"), F.bool_or("odd").alias("odd"))
    rows = s.tables.join(per_table, ["key", "block"], "left")
    n = F.count("*")
    return rows.groupBy("key").agg(
        n.alias("tables.width|n"), F.count_if(_true(wide)).alias("tables.width|bad"),
        F.count_if(F.col("n_rows") > 1).alias("tables.headerRepeat|n"), F.count_if((F.col("n_rows") > 1) & ~F.col("has_header")).alias("tables.headerRepeat|bad"),
        n.alias("tables.emptyCellParagraphs|n"), F.coalesce(F.sum("empty"), F.lit(0)).alias("tables.emptyCellParagraphs|bad"),
        n.alias("tables.fontSize|n"), F.count_if(_true(F.col("odd"))).alias("tables.fontSize|bad"),
    )


def _part_counts(elements: DataFrame) -> DataFrame:
    """Per document: errors, pictures, tables at any depth, a field of contents, and drawings with their widths."""
    in_document = F.col("part") == st.DOCUMENT
    drawing = in_document & F.col("path").endswith("/wp:extent") & F.col("path").rlike(r"^(?:w:p|w:tbl)(?:/.*)?/w:drawing/wp:(?:inline|anchor)/wp:extent$")
    width = F.col("attrs")["cx"].try_cast("double")
    return elements.groupBy("key").agg(
        F.count("error").alias("errors"),
        F.count_if(F.col("part").startswith("word/media/")).alias("pictures"),
        F.count_if(in_document & ((F.col("path") == "w:tbl") | F.col("path").endswith("/w:tbl"))).alias("all_tables"),
        F.coalesce(F.bool_or(in_document & F.col("text").contains("TOC \\o")), F.lit(False)).alias("toc_field"),
        F.count_if(drawing).alias("images.noOverflow|n"), F.count_if(drawing & _true(width > WIDEST_PICTURE)).alias("images.noOverflow|bad"),
    )


def _original_counts(elements: DataFrame) -> DataFrame:
    """Per original document: characters of its body, words of a title page among its first paragraphs, and the first line.

    That takes the texts of paragraphs and no property of theirs, so the rows of paragraphs and their texts are all that is read.
    """
    rows = st.of_document(elements).where("p is not null").withColumn("rel", st.unwrapped(F.col("rel"))).where((F.col("rel") == "") | st.ends("w:t"))
    pieces = F.sort_array(F.collect_list(F.when(st.ends("w:t"), F.struct("r", "seq", "text"))))
    place = F.max(F.when(F.col("rel") == "", F.col("path")))
    rows = rows.select("key", "p", "r", "seq", "rel", "path", "text").repartition("key").groupBy("key", "p").agg(place.alias("place"), F.array_join(F.transform(pieces, lambda x: x["text"]), "").alias("text"))
    rows = rows.where(F.col("place").rlike(st.BODY_PARAGRAPH)).withColumn("idx", F.row_number().over(Window.partitionBy("key").orderBy("p")) - 1)
    early, text, trimmed = F.col("idx") < EARLY, F.col("text"), F.trim("text")
    return rows.groupBy("key").agg(
        *[F.bool_or(early & F.upper(text).rlike(m)).alias(f"old_marker{i}") for i, m in enumerate(TITLE_MARKERS)],
        F.min(F.when(early & (trimmed != ""), F.struct("idx", F.upper(trimmed).alias("line"))))["line"].alias("old_first"),
        F.sum(F.length(F.regexp_replace(text, r"\s", ""))).alias("old_chars"),
    )


def run_document_checks(formatted: Structure, original: Structure, labels: DataFrame | None = None, pack: Pack = Pack()) -> DataFrame:
    """key, check_id, category, severity, n_evaluated, bad_count, passed: 29 rows per document of ``formatted``.

    ``original`` is the document before, matched by key; a document without one counts as made from nothing. ``labels``
    (key, idx, block_type) name the blocks of the body's paragraphs; without them checks of body text and headings evaluate
    nothing, and a title page is told by the original's words. A file that can't be read has one failed row "system.error".
    Paragraphs, cells, tables and sections each shuffle their own rows by document once; parts are summed before they are.
    """
    parts = _part_counts(formatted.elements)
    before = _part_counts(original.elements).select("key", F.col("pictures").alias("old_pictures"), F.col("all_tables").alias("old_tables"))
    markers = [f"marker{i}" for i in range(len(TITLE_MARKERS))]
    old = _original_counts(original.elements)
    margins = formatted.sections.groupBy("key").agg(*[F.coalesce(F.max(F.when(F.col("of_body"), F.col(f"{s}_twips"))), F.lit(0)).alias(s) for s in ("top", "bottom", "left", "right")])
    rows = parts.join(_paragraph_counts(formatted, labels, pack), "key", "left").join(_table_counts(formatted, pack), "key", "left").join(margins, "key", "left").join(before, "key", "left").join(old, "key", "left")

    hits = sum((_true(F.col(f"old_{m}")).cast("int") for m in markers), F.lit(0))
    guessed = ~_true(F.col("has_labels")) & ((hits >= 2) | _true(F.col("old_first").rlike(CONTENT_FIRST)))
    begins_with_heading = F.coalesce(F.col("first_label").startswith("heading_"), F.lit(False))
    loss = F.when(F.col("old_chars") > 0, half_up(100 * (F.col("old_chars") - F.coalesce("chars", F.lit(0))) / F.col("old_chars"))).otherwise(0).cast("long")
    one = F.lit(1).cast("long")
    missing = F.greatest(F.coalesce("old_pictures", F.lit(0)) - F.col("pictures"), F.lit(0)).cast("long")
    lost_tables = F.coalesce("old_tables", F.lit(0)) - F.col("all_tables")
    flag = lambda c: F.when(c, 0).otherwise(1).cast("long")
    single = {f"page.margins.{s}": (one, flag(F.abs(F.col(s) - pack.twips(s)) <= MARGIN_TOLERANCE)) for s in ("top", "bottom", "left", "right")}
    single |= {
        "structure.tocFieldCode": (one, flag(_true(F.col("toc_field") | F.col("static_toc")))),
        "structure.tocHeading": (one, flag(_true(F.col("toc_heading")))),
        "structure.titlePage": (one, flag(_true(F.col("has_title")) | begins_with_heading | guessed)),
        "structure.sectionBreakAfterTitle": (_true(F.col("has_title")).cast("long"), flag(~_true(F.col("has_title")) | _true(F.col("has_break")))),
        "preservation.images": (F.coalesce("old_pictures", F.lit(0)).cast("long"), missing),
        "preservation.tables": (F.coalesce("old_tables", F.lit(0)).cast("long"), F.when(lost_tables > 1, lost_tables).otherwise(0).cast("long")),
        "preservation.contentLoss": (one, F.when(loss > 5, loss).otherwise(0)),
    }
    loss_severity = F.when(loss > 20, "critical").when(loss > 5, "major").otherwise("minor")

    def row(name: str, category: str, severity: str) -> Column:
        n, bad = single.get(name) or (F.coalesce(F.col(f"`{name}|n`"), F.lit(0)).cast("long"), F.coalesce(F.col(f"`{name}|bad`"), F.lit(0)).cast("long"))
        weight = loss_severity if name == "preservation.contentLoss" else F.lit(severity)
        return F.struct(F.lit(name).alias("check_id"), F.lit(category).alias("category"), weight.alias("severity"), n.alias("n_evaluated"), bad.alias("bad_count"), (bad == 0).alias("passed"))

    failed = F.array(F.struct(F.lit("system.error").alias("check_id"), F.lit("system").alias("category"), F.lit("critical").alias("severity"), one.alias("n_evaluated"), one.alias("bad_count"), F.lit(False).alias("passed")))
    checks = F.when(F.col("errors") > 0, failed).otherwise(F.array(*[row(*c) for c in CHECKS]))
    return rows.select("key", F.explode(checks).alias("c")).select("key", "c.*")
