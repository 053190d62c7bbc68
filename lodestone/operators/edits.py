"""Edits: replacements by offset within texts, edit logs over ordered rows, and overlays of defaults."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Mapping
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.arrow import mapped

# --- Replacements by offset -------------------------------------------------------------------------------------------


def _standing(length: int, offsets: list[int], lengths: list[int], ids: list[int], fixes: list[str | None]) -> Iterator[tuple]:
    """offset, end, id and replacement of the errors in order of offset without those that reach into one before or beyond the text."""
    end = 0
    for offset, at, size, fix in sorted(zip(offsets, ids, lengths, fixes), key=itemgetter(0, 1)):
        if offset >= end and size >= 0 and offset + size <= length:
            end = offset + size
            yield offset, end, at, fix


def _with_errors(texts: DataFrame, errors: DataFrame) -> DataFrame:
    """doc_id, text and four lists: a row per text with its errors and their first replacements; texts without keep empty lists."""
    fix = F.when(F.size("replacements") > 0, F.coalesce(F.get("replacements", F.lit(0)), F.lit("")))
    usable = errors.where("doc_id IS NOT NULL AND offset >= 0").select("doc_id", F.struct("offset", "length", "id", fix.alias("fix")).alias("e"))
    by_doc = usable.groupBy("doc_id").agg(F.collect_list("e").alias("errors"))
    joined = texts.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(by_doc, "doc_id", "left")
    found = F.coalesce("errors", F.array().cast(by_doc.schema["errors"].dataType))
    return joined.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[found[c].alias(c) for c in ("offset", "length", "id", "fix")])


#: Rows of texts with their errors: lists of offsets, lengths, ids and first replacements.
WITH_ERRORS = {"doc_id": pa.int64(), "text": pa.string(), "offset": pa.list_(pa.int32()), "length": pa.list_(pa.int32()), "id": pa.list_(pa.int64()), "fix": pa.list_(pa.string())}


def corrected(texts: DataFrame, errors: DataFrame) -> DataFrame:
    """doc_id, text, applied: each text with the first replacement of each error that has one.

    Offsets and lengths are in characters of the text as it was. Of errors that overlap the first by offset stands (then the
    smaller id), as in ``segments``; errors beyond the text's end or with a negative offset count for nothing, an empty one
    inserts. A text is cut once, in the order of offsets. ``errors``: doc_id, offset, length, id, replacements. A null text is empty.
    """
    return corrected_rows(_with_errors(texts, errors))


def corrected_rows(rows: DataFrame) -> DataFrame:
    """``corrected`` for texts whose errors lie in the same row (``WITH_ERRORS``): nothing is shuffled."""

    def run(doc_id: int, text: str, *found: list) -> Iterator[tuple]:
        pieces, end, applied = [], 0, 0
        for offset, till, _, fix in _standing(len(text), *found):
            if fix is not None:
                pieces += [text[end:offset], fix]
                end, applied = till, applied + 1
        yield doc_id, "".join([*pieces, text[end:]]), applied

    return mapped(rows, run, {"doc_id": pa.int64(), "text": pa.string(), "applied": pa.int32()})


SEGMENTS = {"doc_id": pa.int64(), "part": pa.int32(), "start": pa.int32(), "end": pa.int32(), "error": pa.int64(), "text": pa.string()}


def segments(texts: DataFrame, errors: DataFrame) -> DataFrame:
    """doc_id, part, start, end, error, text: each text cut into plain spans (error null) and spans of errors, without a gap.

    Which errors stand is as in ``corrected``. An empty text has no segment.
    """
    return segment_rows(_with_errors(texts, errors))


def segment_rows(rows: DataFrame) -> DataFrame:
    """``segments`` for texts whose errors lie in the same row (``WITH_ERRORS``): nothing is shuffled."""

    def cut(text: str, found: tuple) -> Iterator[tuple]:
        end = 0
        for offset, till, error, _ in _standing(len(text), *found):
            if offset > end:
                yield end, offset, None
            end = till
            yield offset, end, error
        if end < len(text):
            yield end, len(text), None

    def run(doc_id: int, text: str, *found: list) -> Iterator[tuple]:
        yield from ((doc_id, k, a, b, error, text[a:b]) for k, (a, b, error) in enumerate(cut(text, found)))

    return mapped(rows, run, SEGMENTS)


# --- Edit logs over ordered rows --------------------------------------------------------------------------------------

#: What an edit does at its row: rows that come before it, take its place, or come after it; or it goes.
BEFORE, REPLACE, DELETE, AFTER = "before", "replace", "delete", "after"


def apply_log(rows: DataFrame, log: DataFrame) -> DataFrame:
    """``rows`` (doc_id, idx and others) with the edits of ``log`` in one merge, numbered anew from 0.

    ``log`` has the same columns and ``op``, ``rank``: inserted rows stand before or after row ``idx`` by rank; a row that is
    replaced or deleted goes, and replacements stand in its place. Edits refer to places before any edit, so their order
    doesn't matter. Columns that the log lacks are null in its rows.
    """
    gone = log.where(F.col("op").isin(REPLACE, DELETE)).select("doc_id", "idx").distinct()
    side = F.when(F.col("op") == BEFORE, 0).when(F.col("op") == AFTER, 2).otherwise(1)
    kept = rows.join(gone, ["doc_id", "idx"], "left_anti").withColumns({"side": F.lit(1), "rank": F.lit(0)})
    made = log.where(F.col("op") != DELETE).withColumn("side", side).drop("op").withColumn("rank", F.col("rank").cast("int"))
    merged = kept.unionByName(made, allowMissingColumns=True)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("idx", "side", "rank")) - 1
    return merged.withColumn("idx", place).drop("side", "rank").select(*rows.columns)


#: Columns and twips from which a table is turned, and what fits on an upright page.
LEAST_TURNED, MANY_COLUMNS, ALWAYS_TURNED, UPRIGHT = 3, 7, 9, 9638
TABLE_CAPTION = r"(?iu)^Таблица\s+\d+"
#: Paragraphs above a table that are searched for its caption.
LOOK_BACK = 3


def is_wide(columns: Column, grid: Column, width: Column, width_type: Column) -> Column:
    """Whether a table needs a page on its side: by its grid's width, or its own if it has no grid, or by its columns."""
    given = F.coalesce(grid, F.lit(0))
    own = (given == 0) & ~F.coalesce(width_type, F.lit("dxa")).isin("pct", "auto") & (F.coalesce(width, F.lit(0)) > UPRIGHT)
    return (columns >= LEAST_TURNED) & ((given > UPRIGHT) | own | (columns >= ALWAYS_TURNED) | ((columns >= MANY_COLUMNS) & (given > 0.85 * UPRIGHT)))


def landscape_log(rows: DataFrame) -> DataFrame:
    """Edits that put each wide table, and a caption up to three paragraphs above it with only blanks between, on pages on their side.

    An upright section ends before, one on its side after. A table before which a section ends already is left, so a second
    run adds nothing. ``rows``: doc_id, idx, kind ("p" or "table"), text, section (that ends at the row, or null), wide.
    """
    order = Window.partitionBy("doc_id").orderBy("idx")
    near = rows.select("doc_id", "idx", "kind", "text", "section", "wide")
    for k in range(1, LOOK_BACK + 2):
        near = near.withColumn(f"row{k}", F.lag(F.struct("kind", F.trim("text").alias("text"), "section"), k).over(order))
    start, open_ = F.lit(0), F.lit(True)
    for k in range(1, LOOK_BACK + 1):
        row = F.col(f"row{k}")
        paragraph = open_ & F.coalesce(row["kind"] == "p", F.lit(False))
        caption = paragraph & row["text"].rlike(TABLE_CAPTION)
        start = F.when((start == 0) & caption, k).otherwise(start)
        open_ = paragraph & ~caption & (row["text"] == "")
    near = near.where("wide").withColumn("back", start)
    above = F.coalesce(*[F.when(F.col("back") == k, F.col(f"row{k + 1}")) for k in range(LOOK_BACK + 1)])
    fresh = near.where(~F.coalesce((above["kind"] == "p") & above["section"].isNotNull(), F.lit(False)))
    blank = {"kind": F.lit("p"), "text": F.lit("")}
    upright = fresh.select("doc_id", (F.col("idx") - F.col("back")).alias("idx"), F.lit(BEFORE).alias("op"), F.lit("portrait").alias("section"))
    turned = fresh.select("doc_id", "idx", F.lit(AFTER).alias("op"), F.lit("landscape").alias("section"))
    return upright.unionByName(turned).withColumns(blank).withColumn("rank", F.lit(0)).withColumn("wide", F.lit(False))


#: Words of tables of contents, and lines that are their entries.
CONTENTS_WORDS = r"(?iu)введение|заключение|список\s+(?:использованных\s+)?(?:источников|литературы)|глава\s+\d|содержание|оглавление"
CONTENTS_ENTRY = r"(?m)^[ \t]*\d+(?:\.\d+)*[ \t]+\S"


#: Headings that contents leave out.
LEFT_OUT = ["Приложение А. Таблицы", "Приложение. Дополнительные изображения", "СОДЕРЖАНИЕ", "ОГЛАВЛЕНИЕ"]


def contents_table(text: Column) -> Column:
    """Whether a table's text (a line per paragraph) is a table of contents: two of its words, or one and three numbered lines."""
    words = F.regexp_count(text, F.lit(CONTENTS_WORDS))
    return (words >= 2) | ((words >= 1) & (F.regexp_count(text, F.lit(CONTENTS_ENTRY)) >= 3))


def contents_log(rows: DataFrame) -> DataFrame:
    """Edits that replace a document's contents by entries of its headings, and remove tables that served as contents.

    Contents are a field's paragraph (style "TOCField") or, if there is none, all from the first to the last paragraph of the
    styles TOC1 and TOC2 with the page break behind; documents without either, or without headings, keep what they have. Each
    heading's entry has the style of its level; a heading that repeats the one before it has none. A page break follows, so a
    second run finds the same range and gives the same rows. ``rows``: doc_id, idx, kind, text, style.
    """
    text, style = F.trim("text"), F.col("style")
    is_heading = (F.col("kind") == "p") & style.isin("Heading1", "Heading2") & (text != "") & ~text.isin(LEFT_OUT)
    entry = style.isin("TOC1", "TOC2")
    whole, order = Window.partitionBy("doc_id"), Window.partitionBy("doc_id").orderBy("idx")
    placed = rows.select("doc_id", "idx", "kind", "text", "style").withColumns({
        "field": F.min(F.when(style == "TOCField", F.col("idx"))).over(whole),
        "first": F.min(F.when(entry, F.col("idx"))).over(whole),
        "last": F.max(F.when(entry, F.col("idx"))).over(whole),
        "headings": F.count_if(F.coalesce(is_heading, F.lit(False))).over(whole),
    })
    start, end = F.coalesce("field", "first"), F.when(F.col("field").isNotNull(), F.col("field")).otherwise(F.col("last"))
    broken = F.col("field").isNull() & (F.col("idx") == F.col("last") + 1) & (style == "PageBreak")
    old = placed.where((F.col("headings") > 0) & ((F.col("idx").between(start, end)) | F.coalesce(broken, F.lit(False)))).select("doc_id", "idx", F.lit(DELETE).alias("op"))
    titles = placed.where(F.coalesce(is_heading, F.lit(False)) & start.isNotNull()).withColumn("before", F.lag(text).over(order))
    titles = titles.where(F.col("before").isNull() | (text != F.col("before")))
    entries = titles.select("doc_id", start.alias("idx"), F.lit(BEFORE).alias("op"), (F.row_number().over(order)).alias("rank"), F.lit("p").alias("kind"), text.alias("text"), F.when(style == "Heading1", "TOC1").otherwise("TOC2").alias("style"))
    pages = entries.groupBy("doc_id", "idx").agg((F.max("rank") + 1).alias("rank")).select("doc_id", "idx", F.lit(BEFORE).alias("op"), "rank", F.lit("p").alias("kind"), F.lit("").alias("text"), F.lit("PageBreak").alias("style"))
    tables = placed.where((F.col("kind") == "table") & contents_table(F.col("text"))).select("doc_id", "idx", F.lit(DELETE).alias("op"))
    return old.unionByName(tables).distinct().unionByName(entries.unionByName(pages), allowMissingColumns=True)


#: Fixed: what a numeric cell consists of.
NUMERIC_CELL = r"^[-+]?[0-9\s.,%\x{00A0}()/–—-]+$"


def normal_cells(cells: DataFrame, font: str = "Times New Roman", least: float = 20, most: float = 24, header: str = "center", other: str = "left") -> DataFrame:
    """``cells`` with alignment, font and size as tables should have: header cells and numbers apart, sizes out of range at the most.

    ``cells``: row (0 is the header), text, size (half points, null: not given) and others, which stay.
    """
    numeric = F.trim("text").rlike(NUMERIC_CELL) & F.col("text").rlike("[0-9]")
    size = F.when(F.col("size").between(least, most), F.col("size")).otherwise(F.lit(float(most)))
    return cells.withColumns({"alignment": F.when(F.col("row") == 0, header).when(numeric, "center").otherwise(other), "font": F.lit(font), "size": size})


#: Characters of an anchor that are looked for, and how many it needs; the heading of tables that found no place (fixed values).
ANCHOR_MOST, ANCHOR_LEAST, ORPHANS = 50, 8, "# Приложение А. Таблицы"


def normal_line(x: Column) -> Column:
    """Lower case, without marks of markdown, blanks as one."""
    x = F.regexp_replace(F.regexp_replace(F.translate(x, "\t\u00a0", "  "), r"[*_`]+", ""), r"^#+\s*", "")
    return F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))


def anchored(lines: DataFrame, anchors: DataFrame) -> DataFrame:
    """doc_id, n, line: the line of each anchor, the first that holds its text and that no anchor before has taken; else null.

    Both are compared by ``normal_line``, an anchor by its first 50 characters; one of fewer than 8 finds no line. ``lines``:
    doc_id, idx, text; ``anchors``: doc_id, n (their order), text. A document's lines are searched as one string, so a search
    costs one scan; what is taken depends on the anchors before, so a document's anchors are taken in one go.
    """

    def match(key: tuple, asked: pa.Table, given: pa.Table) -> pa.Table:
        given, asked = given.sort_by("idx"), asked.sort_by("n")
        norms = given["norm"].to_pylist()
        starts, at = [], 0
        for x in norms:
            starts.append(at)
            at += len(x) + 1
        whole, used, found = "\n".join(norms), set(), []
        for anchor in asked["norm"].to_pylist():
            place = whole.find(anchor) if len(anchor) >= ANCHOR_LEAST else -1
            while place >= 0:
                line = bisect_right(starts, place) - 1
                if line not in used:
                    break
                place = whole.find(anchor, starts[line + 1]) if line + 1 < len(starts) else -1
            if place >= 0:
                used.add(line)
            found.append(given["idx"][line].as_py() if place >= 0 else None)
        return pa.table([asked["doc_id"], asked["n"], pa.array(found, pa.int32())], names=["doc_id", "n", "line"])

    asked = anchors.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n").cast("int").alias("n"), F.left(normal_line(F.col("text")), F.lit(ANCHOR_MOST)).alias("norm"))
    given = lines.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("idx").cast("int").alias("idx"), normal_line(F.col("text")).alias("norm"))
    return asked.groupBy("doc_id").cogroup(given.groupBy("doc_id")).applyInArrow(match, "doc_id long, n int, line int")


def tables_log(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """Edits that put each table's rows behind the line of its anchor, and those without under a heading at the end.

    ``tables``: doc_id, n, text (the paragraph before the table), rows (array of markdown lines). A document without lines gets none.
    """
    placed = tables.join(anchored(lines, tables), ["doc_id", "n"])
    blank = F.array(F.lit(""))
    inserted = placed.where("line IS NOT NULL").select("doc_id", "n", F.col("line").alias("idx"), F.concat(blank, "rows", blank).alias("made"))
    end = lines.groupBy("doc_id").agg(F.max("idx").alias("idx"))
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("n")) == 1
    lost = placed.where("line IS NULL").join(end, "doc_id").withColumn("head", F.when(first, F.array(F.lit(""), F.lit(ORPHANS), F.lit(""))).otherwise(blank))
    lost = lost.select("doc_id", (F.col("n") + (1 << 30)).alias("n"), "idx", F.concat("head", "rows").alias("made"))
    each = inserted.unionByName(lost).select("doc_id", "idx", "n", F.posexplode("made").alias("k", "text"))
    rank = F.row_number().over(Window.partitionBy("doc_id", "idx").orderBy("n", "k"))
    return each.select("doc_id", "idx", F.lit(AFTER).alias("op"), rank.alias("rank"), "text")


# --- Overlay of defaults ----------------------------------------------------------------------------------------------

Defaults = Mapping[str, object]


def overlay(given: Column, defaults: Defaults, kinds: Mapping[str, str], path: str = "$") -> Column:
    """A struct of ``defaults`` (two levels or more) over which the fields of ``given``, a variant, are laid.

    A field that is there holds, also if it is null or false or empty; one that is missing, or whose parent is missing, takes its default. A
    value that doesn't fit its kind is null. ``kinds`` names the type of each default's value by Python type's name.
    """
    fields = []
    for name, value in defaults.items():
        place = f"{path}.{name}"
        if isinstance(value, Mapping):
            fields.append(overlay(given, value, kinds, place).alias(name))
            continue
        kind = kinds[type(value).__name__]
        there = F.try_variant_get(given, place, "variant")
        default = F.lit(value).cast(kind)
        fields.append(F.when(there.isNull(), default).when(F.is_variant_null(there), F.lit(None).cast(kind)).otherwise(F.try_variant_get(given, place, kind)).alias(name))
    return F.struct(*fields)
