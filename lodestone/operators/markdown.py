"""Heading promotion and repair of markdown lines: which rule may act on a line follows from where it stands.

Lines between code fences are left alone. Rules that look at neighbours use windows within a document; where a heading needs a
blank line next to it, a line becomes several and places are numbered anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordered import within

#: The shapes of lines that are headings.
FENCE = r"^\s*(?:```|~~~)"
LIST_HEADING = r"^(\t*)\d+\.(?:\d+)?\s+(?:<a\s[^>]*></a>\s*)*(__|\*\*)([^_*]+?)\2\s*$"
STRICT_TITLE = (
    r"^(?:Введение|Заключение|Выводы|Содержание|Оглавление|Реферат|Аннотация|Список\s+(?:использованных\s+)?(?:источников|литературы)|Библиографический\s+список"
    r"|ВВЕДЕНИЕ|ЗАКЛЮЧЕНИЕ|ВЫВОДЫ|СОДЕРЖАНИЕ|ОГЛАВЛЕНИЕ|РЕФЕРАТ|АННОТАЦИЯ|СПИСОК(?:\s+[А-ЯЁ]+)+)[\s:.]*$"
)
TITLE = (
    r"(?iu)^(?:Введение|Заключение|Выводы|Содержание|Оглавление|Реферат|Аннотация|Список\s+(?:использованных\s+)?(?:источников|литературы)|Приложение(?:\s+[А-ЯЁ])?"
    r"|Библиографический\s+список|Список\s+сокращений|Определения)\s*$"
)
CHAPTER = r"^(?:Глава|ГЛАВА|Раздел|РАЗДЕЛ|Часть|ЧАСТЬ)\s+[IVXLCDM\d]+[.:]?\s*.*$"
NUMBERED = r"^(\d+)(\.\d+)?(\.\d+)?\.?[\s.]+([А-ЯЁA-Z].{3,120})\s*$"
CAPITALS = r"^[А-ЯЁA-Z\s0-9.,:;«»\"'\-—–]+$"
ALL_CAPS = r"^[А-ЯЁA-Z][А-ЯЁA-Z0-9\s.,:;«»\"'-]{3,98}\s*$"
ANCHOR = r"(?i)<a\s+id=\"[^\"]*\">\s*</a>"
ESCAPED = r"\\([.,:;!?])"


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def bare(x: Column) -> Column:
    """Without the marks of bold and italic around it and without escapes."""
    x = F.regexp_replace(F.regexp_replace(trimmed(x), r"^[*_]+", ""), r"[*_]+$", "")
    return trimmed(F.regexp_replace(x, ESCAPED, "$1"))


def with_fences(lines: DataFrame) -> DataFrame:
    """Adds ``fenced``: the line is a fence or stands after an odd number of them."""
    fence = F.col("text").rlike(FENCE)
    open_ = F.count_if(fence).over(within().rowsBetween(Window.unboundedPreceding, -1)) % 2 == 1
    return lines.withColumn("fenced", fence | open_)


def relined(rows: DataFrame, lines: Column) -> DataFrame:
    """doc_id, idx, text: every row's ``lines`` in their order, numbered anew."""
    each = rows.select("doc_id", "idx", F.posexplode(lines).alias("part", "text"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("idx", "part")) - 1
    return each.select("doc_id", place.alias("idx"), "text")


def promote_headings(lines: DataFrame) -> DataFrame:
    """doc_id, idx, text with lines that are headings by their shape marked as such.

    In this order: bold items of numbered lists by their depth; if a document has no first-level headings, all levels rise;
    titles of sections, chapters, numbered sections (a number alone only with a title in capitals) and lines in capitals,
    each with a blank line before it. Marks of bold and italic around a line are gone before its shape is looked at, so
    being bold makes no heading. ``lines``: doc_id, idx, text.
    """
    whole = Window.partitionBy("doc_id")
    text = F.col("text")
    count = lambda hashes: F.count_if(text.rlike(rf"^{hashes}\s") & ~F.col("fenced")).over(whole)
    rows = with_fences(lines.select("doc_id", "idx", "text")).withColumns({"h1": count("#"), "h2": count("##"), "h3": count("###")})
    title = trimmed(F.regexp_extract("text", LIST_HEADING, 3))
    level = F.least(F.length(F.regexp_extract("text", LIST_HEADING, 1)) + 1, F.lit(4))
    listed = text.rlike(LIST_HEADING) & (F.length(title) >= 3)
    rows = rows.withColumn("text", F.when(~F.col("fenced") & listed, F.concat(F.repeat(F.lit("#"), level), F.lit(" "), title)).otherwise(text))
    third = (F.col("h1") == 0) & (F.col("h2") == 0) & (F.col("h3") > 0)
    second = (F.col("h1") == 0) & (F.col("h2") > 0)
    risen = F.when(third, F.regexp_replace(F.regexp_replace(text, "^#### ", "## "), "^### ", "# ")).when(second, F.regexp_replace(text, "^###? ", "# ")).otherwise(text)
    rows = rows.withColumn("text", F.when(F.col("fenced"), text).otherwise(risen))
    clean = bare(F.regexp_replace(trimmed(text), ANCHOR, ""))
    strict = ~F.col("fenced") & ~trimmed(text).startswith("#") & clean.rlike(STRICT_TITLE)
    rows = rows.withColumn("text", F.when(strict, F.concat(F.lit("# "), clean)).otherwise(text))
    rows = rows.withColumn("line", bare(text)).withColumn("after_text", F.coalesce(trimmed(F.lag("text").over(within())) != "", F.lit(False)))
    line = F.col("line")
    part = lambda g: F.regexp_extract("line", NUMBERED, g)
    numbered = line.rlike(NUMBERED) & ((part(2) != "") | part(4).rlike(CAPITALS))
    hashes = F.when(part(2) != "", "## ").otherwise("# ")
    heading = (
        F.when(F.col("fenced") | (line == "") | line.startswith("#"), None)
        .when(line.rlike(TITLE) | line.rlike(CHAPTER), F.concat(F.lit("# "), line))
        .when(numbered, F.concat(hashes, part(1), part(2), part(3), F.lit(" "), trimmed(part(4))))
        .when(line.rlike(NUMBERED), None)
        .when(line.rlike(ALL_CAPS) & ~line.rlike("[.!?]$"), F.concat(F.lit("# "), line))
    )
    rows = rows.withColumn("heading", heading)
    return relined(rows, F.when(F.col("heading").isNull(), F.array("text")).when(F.col("after_text"), F.array(F.lit(""), "heading")).otherwise(F.array("heading")))


IMAGE = r"!\[[^\]]*\]\(([^)]+)\)"
IMAGE_LINE = r"^!\[[^\]]*\]\(([^)]+)\)$"
PLACEHOLDER = r"(?iu)^(?:\*\*?|__?)?(?:image|img|изображение|рисунок)(?:\*\*?|__?)?$"
HEADING = r"^(#{1,6})\s+(.*)$"
#: Repairs of a line before headings are set apart, and after; in this order.
BEFORE = [(r"\\([()\[\]{}.,;:!?\-])", "$1"), (ANCHOR, ""), (r"^(#{1,6}\s+)[*_]+(.*?)[*_]+\s*$", "$1$2"), (r"^(#{1,6}\s+)[*_]+", "$1")]
AFTER = [
    (r"\\_", "_"), (r"_{3,}", ""), (r"(\S)__(?=[\s—–\-.,;:!?)»\"'}]|$)", "$1"), (r"(^|[\s(«\"'{—–\-])__(\S)", "$1$2"),
    (r"^([^_]*)__\s*$", "$1"), (r"^__([^_]+)", "$1"),
]


def known(source: Column, images: Column) -> Column:
    source = trimmed(source)
    return source.startswith("extra-") | F.array_contains(images, F.regexp_extract(source, r"([^/]*)$", 1))


def without_lost_images(text: Column, images: Column) -> Column:
    """References to pictures that are there stay; the rest go, and so do lines that only say that a picture was there."""
    alone = F.when(known(F.regexp_extract(trimmed(text), IMAGE_LINE, 1), images), trimmed(text)).otherwise("")
    between, whole, source = F.split(text, IMAGE), F.regexp_extract_all(text, F.lit(IMAGE), F.lit(0)), F.regexp_extract_all(text, F.lit(IMAGE), F.lit(1))
    kept = F.zip_with(whole, source, lambda w, s: F.when(known(s, images), w).otherwise(""))
    inside = F.array_join(F.zip_with(between, kept, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(trimmed(text).rlike(IMAGE_LINE), alone).when(trimmed(text).rlike(PLACEHOLDER), "").when(text.contains("!["), inside).otherwise(text)


def repair_lines(lines: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """doc_id, idx, text with the marks that a conversion left behind repaired.

    In this order: references to lost pictures and words that stand for one; escapes of punctuation; empty anchors; bold and
    italic marks and further hashes in headings; a blank line on either side of a heading; escaped, long and orphaned
    underscores; and if an odd number of them is left in a line, all. Each repair acts within a line. ``lines``: doc_id,
    idx, text; ``images``: doc_id, name of the pictures that are there.
    """
    rows = with_fences(lines.select("doc_id", "idx", "text"))
    none = F.array().cast("array<string>")
    if images is None:
        rows = rows.withColumn("images", none)
    else:
        named = images.groupBy("doc_id").agg(F.collect_set("name").alias("images"))
        rows = rows.join(named, "doc_id", "left").withColumn("images", F.coalesce("images", none))
    free = lambda x: F.when(F.col("fenced"), F.col("text")).otherwise(x)
    rows = rows.withColumn("text", free(without_lost_images(F.col("text"), F.col("images"))))
    text = F.col("text")
    for pattern, by in BEFORE:
        text = F.regexp_replace(text, pattern, by)
    rows = rows.withColumn("text", free(text)).withColumn("heading", ~F.col("fenced") & F.col("text").rlike(HEADING))
    title = trimmed(F.regexp_replace(F.regexp_extract("text", HEADING, 2), r"^#+\s*", ""))
    rows = rows.withColumn("text", F.when(F.col("heading"), F.concat(F.regexp_extract("text", HEADING, 1), F.lit(" "), title)).otherwise(F.col("text")))
    text = F.col("text")
    for pattern, by in AFTER:
        text = F.regexp_replace(text, pattern, by)
    rows = rows.withColumns({
        "before": F.coalesce(trimmed(F.lag("text").over(within())) != "", F.lit(False)),
        "behind": F.coalesce((trimmed(F.lead("text").over(within())) != "") & ~F.lead("heading").over(within()), F.lit(False)),
    })
    rows = rows.withColumn("text", free(text))
    start = F.regexp_replace("text", r"__\s*$", "")
    orphan = F.col("text").rlike(r"__\s*$") & ~start.contains("__")
    rows = rows.withColumn("text", free(F.when(orphan, F.concat(start, F.regexp_extract("text", r"(\s*)$", 1))).otherwise(F.col("text"))))
    odd = (F.length("text") - F.length(F.replace("text", F.lit("_"), F.lit("")))) % 2 == 1
    rows = rows.withColumn("text", free(F.when(odd, F.replace("text", F.lit("_"), F.lit(""))).otherwise(F.col("text"))))
    blank = F.array(F.lit(""))
    apart = F.concat(F.when(F.col("before"), blank).otherwise(none), F.array("text"), F.when(F.col("behind"), blank).otherwise(none))
    return relined(rows, F.when(F.col("heading"), apart).otherwise(F.array("text")))
