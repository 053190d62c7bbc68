"""Typed structure from element rows: paragraphs, tables with merged cells, sections, styles.

All of these group and window within a document, so one shuffle by document serves them; nothing holds a document whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DOCUMENT, STYLES = "word/document.xml", "word/styles.xml"
#: Twips per millimetre.
TWIPS_PER_MM = 56.7
#: Fixed: wrappers whose runs are the paragraph's own, and content controls that hold paragraphs of the body.
WRAPPERS = ("w:hyperlink", "w:ins", "w:del", "w:smartTag")
RUN = rf"^(?:(?:{'|'.join(WRAPPERS)})/)*(w:r(?:/.*)?)$"
BODY_PARAGRAPH = r"^(?:w:sdt/w:sdtContent/)*w:p$"
CELL_PARAGRAPH = "w:tbl/w:tr/w:tc/w:p"



def attr(name: str) -> Column:
    return F.col("attrs")[f"w:{name}"]


def number(name: str) -> Column:
    return attr(name).try_cast("double")


def at(rel: str, value: Column) -> Column:
    """The value at an exact place below the paragraph; the first in document order."""
    return F.min_by(F.when(F.col("rel") == rel, value), F.when(F.col("rel") == rel, F.col("seq")))


def unwrapped(rel: Column) -> Column:
    """A path below the paragraph without the wrappers of its own runs; only paths that begin with one are looked at closer."""
    wrapped = F.coalesce(*[F.when(rel.startswith(f"{w}/"), F.nullif(F.regexp_extract(rel, RUN, 1), F.lit(""))) for w in WRAPPERS])
    return F.coalesce(wrapped, rel)


def ends(what: str) -> Column:
    """Whether a row of the paragraph's own runs is ``what``, a path below the run; wrappers are gone from ``rel`` by then."""
    return F.col("rel") == f"w:r/{what}"


#: Places below a paragraph that its properties and those of its runs are read from; what lies elsewhere needn't be shuffled.
READ = [
    "", *(f"w:r/{x}" for x in ("w:t", "w:drawing", "w:br", *(f"w:rPr/{y}" for y in ("w:rFonts", "w:sz", "w:b", "w:i", "w:u", "w:color", "w:highlight")))),
    *(f"w:pPr/{x}" for x in ("w:pStyle", "w:jc", "w:spacing", "w:ind", "w:pageBreakBefore", "w:sectPr")),
]


def of_document(elements: DataFrame) -> DataFrame:
    return elements.where((F.col("part") == DOCUMENT) & F.col("error").isNull())


def run_rows(elements: DataFrame) -> DataFrame:
    """A row per run of each paragraph, and one per paragraph (r null) with the paragraph's properties.

    Keys: key, block, tbl, tc, p, r. Runs inside the four wrappers count, those of text boxes belong to their own paragraph.
    """
    first = lambda c, v: F.min_by(F.when(c, v), F.when(c, F.col("seq")))
    pieces = F.collect_list(F.when(ends("w:t"), F.struct("seq", "text")))
    colour = attr("val")
    of = of_document(elements).where("p is not null").withColumns({"direct": F.col("rel") == "w:r", "rel": unwrapped(F.col("rel"))})
    of = of.where(F.col("rel").isin(READ) | (F.col("seq") == F.col("r")))  # each run has a row, also one that isn't the paragraph's own
    of = of.repartition("key")
    rows = of.groupBy("key", "block", "tbl", "tc", "p", "r").agg(
        F.max(F.when(F.col("rel") == "", F.col("path"))).alias("place"),
        F.array_join(F.transform(F.sort_array(pieces), lambda x: x["text"]), "").alias("text"),
        F.bool_or(F.col("rel") == "w:r").alias("own"),
        F.bool_or("direct").alias("direct"),
        first(ends("w:rPr/w:rFonts"), F.coalesce(attr("ascii"), attr("cs"))).alias("font"),
        first(ends("w:rPr/w:sz"), number("val")).alias("size"),
        F.bool_or(ends("w:rPr/w:b")).alias("bold"),
        F.bool_or(ends("w:rPr/w:i")).alias("italic"),
        F.bool_or(ends("w:rPr/w:u")).alias("underline"),
        F.bool_or((ends("w:rPr/w:color") & (colour != "") & ~colour.isin("auto", "000000", "Auto")) | ends("w:rPr/w:highlight")).alias("coloured"),
        F.bool_or(ends("w:drawing")).alias("drawing"),
        F.bool_or(ends("w:br") & (attr("type") == "page")).alias("manual_break"),
        at("w:pPr/w:pStyle", attr("val")).alias("style"),
        at("w:pPr/w:jc", attr("val")).alias("alignment"),
        at("w:pPr/w:spacing", number("line")).alias("line"),
        at("w:pPr/w:ind", number("firstLine")).alias("first_line"),
        at("w:pPr/w:ind", number("hanging")).alias("hanging"),
        F.bool_or(F.col("rel") == "w:pPr/w:pageBreakBefore").alias("break_before"),
        F.bool_or(F.col("rel") == "w:pPr/w:sectPr").alias("ends_section"),
    )
    return rows


def style_values(elements: DataFrame) -> DataFrame:
    """Per document: map of styles to (font, size) along their chains of parents (a cycle ends), the default style, and the defaults."""
    of = elements.where(F.col("part") == STYLES).repartition("key")
    # A style's rows follow each other: the number of w:style starts so far tells them apart.
    nth = F.sum((F.col("path") == "w:style").cast("int")).over(Window.partitionBy("key").orderBy("seq"))
    val = lambda path, value: F.max(F.when(F.col("path") == path, value))
    fonts = F.coalesce(attr("ascii"), attr("cs"))
    rows = of.withColumn("nth", nth).groupBy("key", "nth").agg(
        val("w:style", attr("styleId")).alias("id"),
        F.coalesce(val("w:style", (attr("default") == "1") & (attr("type") == "paragraph")), F.lit(False)).alias("is_default"),
        val("w:style/w:basedOn", attr("val")).alias("parent"),
        F.coalesce(val("w:style/w:rPr/w:rFonts", fonts)).alias("font"),
        val("w:style/w:rPr/w:sz", number("val")).alias("size"),
        val("w:docDefaults/w:rPrDefault/w:rPr/w:rFonts", fonts).alias("base_font"),
        val("w:docDefaults/w:rPrDefault/w:rPr/w:sz", number("val")).alias("base_size"),
    )
    styles = F.collect_list(F.when(F.col("id").isNotNull(), F.struct("id", F.struct("parent", "font", "size").alias("own"))))
    packed = rows.groupBy("key").agg(styles.alias("styles"), F.min_by("id", F.when(F.col("is_default"), F.col("nth"))).alias("default_style"), F.max("base_font").alias("base_font"), F.max("base_size").alias("base_size"))
    table = F.map_from_entries(F.array_distinct(F.col("styles")))
    none = F.struct(F.lit(None).cast("string").alias("at"), F.lit(None).cast("string").alias("font"), F.lit(None).cast("double").alias("size"))

    def climb(name: Column) -> Column:
        """From a style to its parents: what is set first holds."""
        start = none.withField("at", name)
        step = lambda s, _: F.struct(
            F.col("by_id")[s["at"]]["parent"].alias("at"), F.coalesce(s["font"], F.col("by_id")[s["at"]]["font"]).alias("font"), F.coalesce(s["size"], F.col("by_id")[s["at"]]["size"]).alias("size"))
        return F.aggregate(F.col("styles"), start, step, lambda s: F.struct(s["font"].alias("font"), s["size"].alias("size")))

    named = packed.withColumn("by_id", table)
    values = F.map_from_entries(F.transform(F.map_keys("by_id"), lambda name: F.struct(name, climb(name))))
    return named.select("key", values.alias("values"), "default_style", "base_font", "base_size")


def with_effective_values(runs: DataFrame, styles: DataFrame) -> DataFrame:
    """Runs with ``font`` and ``size`` (half points) as they show: of the run, else of the paragraph's style, else of the defaults."""
    paragraph = Window.partitionBy("key", "p")
    styled = runs.withColumn("own_size", F.col("size")).withColumn("style", F.max("style").over(paragraph)).join(styles, "key", "left")
    held = F.col("values")[F.coalesce("style", "default_style")]
    return styled.withColumns({"font": F.coalesce("font", held["font"], "base_font"), "size": F.coalesce("size", held["size"], "base_size")}).drop("values", "default_style", "base_font", "base_size")


def paragraph_rows(runs: DataFrame) -> DataFrame:
    """A row per paragraph from its runs: place, text, properties, those of its first run, and sets of fonts and sizes.

    ``idx`` numbers the paragraphs of the body from 0 and is null for those in tables and text boxes.
    """
    some = lambda c: F.coalesce(F.bool_or(F.col("own") & F.col(c)), F.lit(False))
    own = F.when(F.col("own"), F.col("r"))
    first = F.when(F.col("own"), F.struct(~F.col("direct"), F.col("r")))
    pieces = F.transform(F.sort_array(F.collect_list(F.when(F.col("own"), F.struct("r", "text")))), lambda x: x["text"])
    kept = ["place", "style", "alignment", "line", "first_line", "hanging"]
    rows = runs.groupBy("key", "block", "tbl", "tc", "p").agg(
        *[F.max(c).alias(c) for c in kept],
        F.array_join(pieces, "").alias("text"),
        F.count(own).alias("runs"),
        F.collect_set(F.when(F.col("own"), F.col("font"))).alias("fonts"),
        F.collect_set(F.when(F.col("own"), F.col("size"))).alias("sizes"),
        F.collect_set(F.when(F.col("own"), F.col("own_size"))).alias("own_sizes"),
        F.min_by("bold", first).alias("first_bold"),
        F.min_by("italic", first).alias("first_italic"),
        F.min_by("font", first).alias("first_font"),
        F.min_by("size", first).alias("first_size"),
        *[some(c).alias(c) for c in ("underline", "coloured", "drawing", "manual_break")],
        *[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("break_before", "ends_section")],
    )
    body = F.coalesce(F.col("place").rlike(BODY_PARAGRAPH), F.lit(False))
    nth = F.row_number().over(Window.partitionBy("key", "in_body").orderBy("p")) - 1
    return rows.withColumn("in_body", body).withColumn("idx", F.when(F.col("in_body"), nth))


def section_rows(elements: DataFrame) -> DataFrame:
    """Sections in order, each with the range of body children that it governs: those after the section before, up to its own.

    Sizes are in millimetres; what isn't given takes the fixed defaults. A document without any has one default section.
    """
    mine = F.regexp_replace(F.col("path"), r"^(?:.*w:pPr/)?(w:sectPr(?:/|$))", "$1")
    inside = F.col("path").rlike(r"^(?:(?:w:sdt/w:sdtContent/)*w:p/w:pPr/)?w:sectPr(?:/|$)")
    val = lambda path, value: F.max(F.when(F.col("mine") == path, value))
    mm = lambda v, default: F.coalesce(v / TWIPS_PER_MM, F.lit(default))
    of = of_document(elements)
    rows = of.where(F.col("path").contains("w:sectPr") & inside).withColumn("mine", mine).repartition("key").groupBy("key", "block").agg(
        *[val("w:sectPr/w:pgMar", F.coalesce(number(s), F.lit(0.0))).alias(s) for s in ("top", "bottom", "left", "right")],
        val("w:sectPr/w:pgSz", F.coalesce(number("w"), F.lit(0.0))).alias("width"),
        val("w:sectPr/w:pgSz", F.coalesce(number("h"), F.lit(0.0))).alias("height"),
        val("w:sectPr/w:pgSz", attr("orient")).alias("orient"),
        val("w:sectPr/w:type", attr("val")).alias("kind"),
        F.bool_or(F.col("mine").isin("w:sectPr/w:footerReference", "w:sectPr/w:headerReference")).alias("numbered"),
        val("w:sectPr/w:pgNumType", attr("start").try_cast("int")).alias("first_page"),
        F.bool_or(F.col("path") == "w:sectPr").alias("of_body"),
    )
    last = of.groupBy("key").agg(F.max("block").alias("last"))
    order = Window.partitionBy("key").orderBy("block")
    rows = last.join(rows, "key", "left").withColumns({
        "section": F.row_number().over(order) - 1,
        "from_block": F.coalesce(F.lag("block").over(order) + 1, F.lit(0)),
        "to_block": F.coalesce("block", "last"),
    })
    kind = F.when(F.col("kind").isin("continuous", "evenPage", "oddPage"), F.col("kind")).otherwise("nextPage")
    return rows.select(
        "key", "section", "from_block", "to_block", mm(F.col("top"), 20.0).alias("top"), mm(F.col("bottom"), 20.0).alias("bottom"), mm(F.col("left"), 30.0).alias("left"), mm(F.col("right"), 15.0).alias("right"),
        mm(F.col("width"), 210.0).alias("width"), mm(F.col("height"), 297.0).alias("height"), kind.alias("break_type"), F.coalesce("numbered", F.lit(False)).alias("numbered"), "first_page",
        F.coalesce(F.col("orient") == "landscape", F.lit(False)).alias("landscape"), F.coalesce("of_body", F.lit(False)).alias("of_body"), F.coalesce("top", F.lit(0.0)).alias("top_twips"), F.coalesce("bottom", F.lit(0.0)).alias("bottom_twips"),
        F.coalesce("left", F.lit(0.0)).alias("left_twips"), F.coalesce("right", F.lit(0.0)).alias("right_twips"))


def cell_rows(elements: DataFrame) -> DataFrame:
    """The cells of the tables of the body: row, cell, grid column (spans counted), span, text, and the row that a vertical merge starts in."""
    of = of_document(elements).where(F.col("path").startswith("w:tbl/w:tr") & F.col("tr").isNotNull()).repartition("key")
    direct = of.groupBy("key", "block", "tr", "tc").agg(
        F.max(F.when(F.col("path") == "w:tbl/w:tr/w:tc", 1)).alias("here"),
        F.max(F.when(F.col("path") == "w:tbl/w:tr/w:tc/w:tcPr/w:gridSpan", number("val"))).cast("int").alias("span"),
        F.bool_or(F.col("path") == "w:tbl/w:tr/w:tc/w:tcPr/w:gridSpan").alias("spans"),
        F.max(F.when(F.col("path") == "w:tbl/w:tr/w:tc/w:tcPr/w:vMerge", F.coalesce(attr("val"), F.lit("continue")))).alias("merge"),
        F.max(F.when(F.col("path") == "w:tbl/w:tr/w:tc/w:tcPr/w:vAlign", attr("val"))).alias("vertical"),
        F.collect_list(F.when(F.col("path").startswith("w:tbl/w:tr/w:tc/w:p/") & F.col("path").endswith("/w:t"), F.struct("p", "seq", "text"))).alias("pieces"),
        F.collect_set(F.when(F.col("path") == CELL_PARAGRAPH, F.col("p"))).alias("ps"),
    ).where("here = 1")
    in_row = Window.partitionBy("key", "block", "tr").orderBy("tc")
    joined = F.transform(F.sort_array("ps"), lambda p: F.trim(F.array_join(F.transform(F.filter(F.sort_array("pieces"), lambda x: x["p"] == p), lambda x: x["text"]), "")))
    rows = direct.withColumns({
        "row": F.dense_rank().over(Window.partitionBy("key", "block").orderBy("tr")) - 1,
        "cell": F.row_number().over(in_row) - 1,
        "span": F.greatest(F.coalesce("span", F.lit(1)), F.lit(1)),
        "text": F.trim(F.array_join(joined, " ")),
    })
    before = in_row.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("column", F.coalesce(F.sum("span").over(before), F.lit(0)).cast("int"))
    above = Window.partitionBy("key", "block", "column").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    started = F.when(F.coalesce(F.col("merge"), F.lit("")) != "continue", F.col("row"))
    origin = F.coalesce(F.last(started, ignorenulls=True).over(above), F.col("row"))
    return rows.withColumn("origin", origin).select("key", "block", "row", "cell", "column", "span", "merge", "spans", "vertical", "text", "origin")


def table_rows(elements: DataFrame, cells: DataFrame) -> DataFrame:
    """The tables of the body: number, cells by rows, widest row, whether cells are merged, width, header and the paragraph before.

    ``before`` is the text of the last paragraph that isn't blank since the table before.
    """
    written = F.col("path").startswith("w:p/") & F.col("path").endswith("w:t")
    used = F.col("path").isin("w:tbl", "w:tbl/w:tr", "w:tbl/w:tr/w:trPr/w:tblHeader", "w:tbl/w:tblPr/w:tblW") | written
    of = of_document(elements).where("block is not null").where(used).repartition("key")
    direct = of.groupBy("key", "block").agg(
        F.max(F.when(F.col("path") == "w:tbl", 1)).alias("here"),
        F.count_if(F.col("path") == "w:tbl/w:tr").alias("n_rows"),
        F.min(F.when(F.col("path") == "w:tbl/w:tr", F.col("tr"))).alias("first"),
        F.min(F.when(F.col("path") == "w:tbl/w:tr/w:trPr/w:tblHeader", F.col("tr"))).alias("header"),
        F.max(F.when(F.col("path") == "w:tbl/w:tblPr/w:tblW", attr("type"))).alias("width_type"),
        F.max(F.when(F.col("path") == "w:tbl/w:tblPr/w:tblW", number("w"))).alias("width"),
        F.trim(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(written, F.struct("seq", "text")))), lambda x: x["text"]), "")).alias("text"),
    )
    order = Window.partitionBy("key").orderBy("block")
    since = F.coalesce(F.sum(F.coalesce("here", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    direct = direct.withColumn("since", since)
    before = F.last(F.when(F.col("here").isNull() & (F.col("text") != ""), F.col("text")), ignorenulls=True).over(Window.partitionBy("key", "since").orderBy("block"))
    tables = direct.withColumn("before", F.coalesce(before, F.lit(""))).where("here = 1").withColumn("table", F.col("since"))
    rows = cells.groupBy("key", "block", "row").agg(F.transform(F.sort_array(F.collect_list(F.struct("cell", "text"))), lambda x: x["text"]).alias("cells"), F.bool_or(F.col("spans") | F.col("merge").isNotNull()).alias("merged"))
    grids = rows.groupBy("key", "block").agg(F.transform(F.sort_array(F.collect_list(F.struct("row", "cells"))), lambda x: x["cells"]).alias("rows"), F.bool_or("merged").alias("merged"), F.max(F.size("cells")).alias("columns"))
    empty = F.array().cast("array<array<string>>")
    return tables.join(grids, ["key", "block"], "left").select(
        "key", "block", "table", "n_rows", F.coalesce("rows", empty).alias("rows"), F.coalesce("columns", F.lit(0)).alias("columns"), F.coalesce("merged", F.lit(False)).alias("merged"),
        F.coalesce(F.col("header") == F.col("first"), F.lit(False)).alias("has_header"), "width_type", "width", "before")


def markdown_lines(paragraphs: DataFrame, tables: DataFrame) -> DataFrame:
    """key, block, line, text: the body as markdown, headings by style, tables as piped rows padded to the widest.

    A pipe within a cell is escaped. Paragraphs of text boxes and cells have no lines of their own.
    """
    level = F.regexp_extract(F.coalesce("style", F.lit("")), "(?i)^Heading([1-6])$", 1)
    text = F.when(level != "", F.concat(F.repeat(F.lit("#"), level.try_cast("int")), F.lit(" "), "text")).otherwise(F.col("text"))
    written = paragraphs.where("in_body").select("key", "block", F.col("p").alias("line"), text.alias("text"))
    cells = F.transform("rows", lambda r: F.concat(r, F.array_repeat(F.lit(""), F.col("columns") - F.size(r))))
    piped = F.transform(cells, lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |")))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.col("columns")))
    whole = F.concat(F.slice(piped, 1, 1), F.array(rule), F.slice(piped, F.lit(2), F.greatest(F.size("rows") - 1, F.lit(0))))
    laid = tables.where(F.size("rows") > 0).select("key", "block", F.posexplode(whole).alias("line", "text"))
    return written.unionByName(laid)


def markdown_statistics(lines: DataFrame, elements: DataFrame) -> DataFrame:
    """key, headings of the first three levels, lines with text, words, formulas."""
    text = F.col("text")
    level = lambda n: F.count_if(text.rlike(f"^#{{{n}}}\\s")).alias(f"h{n}")
    words = F.regexp_count(text, F.lit(r"\S+"))
    counts = lines.groupBy("key").agg(level(1), level(2), level(3), F.count_if(text.rlike(r"\S")).alias("paragraphs"), F.sum(words).alias("words"))
    formulas = of_document(elements).groupBy("key").agg(F.count_if((F.col("path") == "m:oMath") | F.col("path").endswith("/m:oMath")).alias("formulas"))
    filled = formulas.join(counts, "key", "left").na.fill(0)
    return filled.select("key", "h1", "h2", "h3", "paragraphs", "words", "formulas")
