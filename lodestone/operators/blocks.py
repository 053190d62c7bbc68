"""Block types of paragraphs by rules: a classifier, its fallback, and validation in context and one by one.

Rules are column expressions over the trimmed text and the style; word lists are parameters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import carried, so_far, within

SPACE = " \t\n\r\f\x0b\u00a0\ufeff"


@dataclass(frozen=True)
class Words:
    """Patterns of captions, section headings and entries; the defaults are fixed values of the Russian rule set."""

    figure: str = r"(?iu)^(?:Рисунок\s+\d|Рис\.\s*\d)"
    table: str = r"(?iu)^(?:Таблица\s+(?:№\s*)?\d|Табл\.\s*(?:№\s*)?\d)"
    section: str = r"(?iu)^(?:введение|заключение|глава\s+\d|список\s+(?:использованных?\s+)?(?:источников|литературы)|библиограф|приложение\s+[а-яa-z]|содержание|оглавление|аннотация|abstract|список\s+сокращений)\s*$"
    bibliography: str = r"(?iu)^(?:список\s+(?:использованных?\s+)?(?:источников|литературы)|библиограф)"
    appendix: str = r"(?iu)^приложение\s+[а-яa-z]"
    entry: str = r"^\d{1,3}[.)]\s*[А-ЯЁA-Z]"
    marker: str = r"(?iu)^(?:[–\-•*]\s|[а-яa-z]\)\s|\d+\)\s)"
    any_section: str = r"(?iu)^(?:введение|заключение|содержание|оглавление|список (?:использованных )?источников|литература|приложение)"
    any_caption: str = r"(?iu)^(?:Рисунок|Рис\.|Таблица)\s*\d+"
    any_table: str = r"(?iu)^Таблица"
    any_marker: str = r"^(?:[-–—•●]\s|\d+[.)]\s)"
    footer: str = r"^(?:г\.\s*)?[А-ЯЁ][а-яё\-]+\s+\d{4}\s*$"
    latin: str = "[a-zA-Z]{3,}"
    local: str = "[а-яА-Я]{3,}"


#: Labels outside the schema and what they mean (fixed values).
LABEL_REPAIRS = {
    "annotation": "title_page_annotation",
    "header": "title_page_header",
    "footer": "title_page_footer",
    "title": "title_page_title",
    "info": "title_page_info",
    "reference": "bibliography_entry",
    "references": "bibliography_entry",
    "bibliography": "bibliography_entry",
    "figure_text": "figure_caption",
    "table_text": "table_caption",
    "heading": "heading_1",
    "text": "body_text",
    "paragraph": "body_text",
    "content": "body_text",
    "appendix": "appendix_content",
    "toc_heading": "toc",
}


def trimmed(text: Column) -> Column:
    return F.coalesce(F.btrim(text, F.lit(SPACE)), F.lit(""))


def heading_of_style(style: Column) -> Column:
    """heading_1 to heading_4 of a heading style, else null."""
    lower = F.lower(F.coalesce(style, F.lit("")))
    level = F.regexp_replace(lower, "[^0-9]", "").try_cast("int")
    return F.when(lower.startswith("heading") & level.between(1, 4), F.concat(F.lit("heading_"), level.cast("string")))


def by_rule(text: Column, style: Column, words: Words = Words()) -> Column:
    """The type that the first of seven ordered rules gives, with its confidence; null where only a model could tell."""
    x = trimmed(text)

    def found(kind: str | Column, confidence: float) -> Column:
        return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("type"), F.lit(confidence).alias("confidence"))

    section = F.when(x.rlike(words.bibliography), "bibliography_title").when(x.rlike(words.appendix), "appendix_title").otherwise("heading_1")
    return (
        F.when(x == "", found("empty", 1.0))
        .when(x.rlike("^[0-9]{1,4}$"), found("page_number", 1.0))
        .when(heading_of_style(style).isNotNull(), found(heading_of_style(style), 0.98))
        .when(x.rlike(words.figure), found("figure_caption", 0.97))
        .when(x.rlike(words.table), found("table_caption", 0.97))
        .when(x.rlike(words.section), found(section, 0.95))
        .when(x.rlike(words.marker), found("list_item", 0.9))
    )


def fallback(text: Column, style: Column, words: Words = Words()) -> Column:
    """A type for every paragraph: numbered headings, sections, captions, markers, then hints of the style."""
    x, s = trimmed(text), F.lower(F.coalesce(style, F.lit("")))
    short = F.length(x) < 60
    kind = F.when(x == "", "empty").when(x.rlike(r"^\d+\.\d+\.\d+\.?\s+\S"), "heading_3").when(x.rlike(r"^\d+\.\d+\.?\s+\S"), "heading_2")
    kind = kind.when(short & (x.rlike(words.any_section) | x.rlike(r"^\d+\.\s+\S")), "heading_1")
    kind = kind.when(x.rlike(words.any_caption), F.when(x.rlike(words.any_table), "table_caption").otherwise("figure_caption")).when(x.rlike(words.any_marker), "list_item")
    for level in "123":
        kind = kind.when(s.startswith(f"heading {level}") | (s == f"heading{level}"), f"heading_{level}")
    return kind.when(s.contains("list"), "list_item").otherwise("body_text")


def repaired_label(label: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in LABEL_REPAIRS.items() for x in pair]), label), label)


def validated_in_context(blocks: DataFrame, words: Words = Words()) -> DataFrame:
    """``blocks`` (doc_id, idx, text, type) with ``fixed``, the type after seven rules of context; the last that holds wins.

    Flags carry a bibliography or an appendix forward from its title; neighbours count with their types before any fix.
    """
    kind, x = F.col("type"), trimmed(F.col("text"))
    prev, after = F.lag("type").over(within()), F.lead("type").over(within())
    title, appendix, chapter = kind == "bibliography_title", kind == "appendix_title", kind == "heading_1"
    in_list, in_appendix = carried(title, appendix | chapter, so_far()), carried(appendix, chapter, so_far())
    seen = F.coalesce(F.max(title).over(so_far()), F.lit(False))
    beside = lambda t: F.coalesce((kind == "unknown") & (prev == t) & (after == t), F.lit(False))
    contents = lambda k: F.coalesce(k.isin("toc", "toc_entry"), F.lit(False))
    rules = [
        ((kind == "bibliography_entry") & ~seen, "body_text"),
        ((kind == "body_text") & in_list & x.rlike(words.entry), "bibliography_entry"),
        (beside("bibliography_entry"), "bibliography_entry"),
        (beside("list_item"), "list_item"),
        ((kind == "toc_entry") & ~contents(prev) & ~contents(after), "body_text"),
        ((kind == "appendix_content") & ~in_appendix, "body_text"),
        (kind.startswith("heading_") & (F.length(x) > 200), "body_text"),
    ]
    return blocks.withColumn("fixed", F.coalesce(*[F.when(holds, to) for holds, to in reversed(rules)], kind))


def validated_one_by_one(blocks: DataFrame, words: Words = Words()) -> DataFrame:
    """``blocks`` (text, style, type) with ``fixed`` and ``language``: eight rules over each row, the last that holds wins;
    a bibliography entry keeps its type and gets its language."""
    kind, x = F.col("type"), trimmed(F.col("text"))
    body, title = kind == "body_text", kind == "title_page"
    rules = [
        ((x == "") & (kind != "empty"), F.lit("empty")),
        (x.rlike("^[0-9]{1,4}$") & ~kind.isin("page_number", "toc_entry"), F.lit("page_number")),
        (x.rlike(words.figure) & body, F.lit("figure_caption")),
        (x.rlike(words.table) & body, F.lit("table_caption")),
        (body & heading_of_style(F.col("style")).isNotNull(), heading_of_style(F.col("style"))),
        (x.rlike(words.marker) & body, F.lit("list_item")),
        (title & x.rlike(r"^\(.*\)$"), F.lit("title_page_annotation")),
        (title & ~x.rlike(r"^\(.*\)$") & x.rlike(words.footer), F.lit("title_page_footer")),
    ]
    entry = kind == "bibliography_entry"
    fixed = F.when(entry, kind).otherwise(F.coalesce(*[F.when(holds, to) for holds, to in reversed(rules)], kind))
    language = F.when(entry, F.when(x.rlike(words.latin) & ~x.rlike(words.local), "en").otherwise("ru"))
    return blocks.withColumns({"fixed": fixed, "language": language})


def cut_score(text: Column, style: Column, words: Words = Words()) -> Column:
    """How good a place for a cut the start of a paragraph is: a section, a heading style, a number with a title, a blank."""
    x = trimmed(text)
    return F.when(x.rlike(words.section), 100).when(F.lower(F.coalesce(style, F.lit(""))).startswith("heading"), 80).when(x.rlike(r"^\d+\.\d*\s+[А-ЯЁA-Z]"), 70).when(x == "", 30).otherwise(0)
