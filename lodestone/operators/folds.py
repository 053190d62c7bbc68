"""Operators over the lines of a document whose step depends on those before: section matching, heading merge, renumbering."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"^[\s ]+|[\s ]+$", "")


def normal_heading(x: Column) -> Column:
    """Lower case, runs of punctuation and blanks as one blank."""
    return F.lower(trimmed(F.regexp_replace(x, r"[.,:;!?\s]+", " ")))


@dataclass(frozen=True)
class Section:
    """An expected section: its name, other names for it, and patterns (upper case) that all together betray it."""

    canonical: str
    synonyms: Sequence[str] = ()
    keywords: Sequence[str] = field(default_factory=tuple)


#: From this many characters a synonym may stand within a longer heading.
LEAST_WITHIN = 6
#: Lines of up to this many characters and without a period may be headings without a style.
SHORT = 80


def match_sections(lines: DataFrame, sections: Sequence[Section]) -> DataFrame:
    """doc_id, section, present, place: which expected sections a document has, each heading serving one section only.

    Sections are taken in their order; each takes the first heading still free that equals or holds a name of it, else a
    short line equal to a name (place -1; lines aren't used up), else the first free heading, or a short line, that all its
    keywords match. ``lines``: doc_id, idx, text, heading. Only headings and short lines are gathered per document; what
    is taken is carried along as a fold's state.
    """
    norm, upper = normal_heading(F.col("text")), F.upper("text")
    text = trimmed(F.col("text"))
    short = (F.length(text) <= SHORT) & ~F.contains(text, F.lit(".")) & (text != "")
    item = F.struct("idx", norm.alias("norm"), upper.alias("upper"))
    docs = lines.where((F.col("heading") & (text != "")) | short).groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("heading") & (text != ""), item))).alias("free"), F.sort_array(F.collect_list(F.when(short, item))).alias("shorts")
    )
    every = lines.select("doc_id").distinct().join(docs, "doc_id", "left")
    kind = "array<struct<idx:int,norm:string,upper:string>>"
    every = every.select("doc_id", *[F.coalesce(F.col(c).cast(kind), F.array().cast(kind)).alias(c) for c in ("free", "shorts")])

    def names(s: Section) -> Column:
        return F.array_distinct(F.transform(F.array(*[F.lit(n) for n in (s.canonical, *s.synonyms)]), normal_heading))

    wanted = F.array(*[F.struct(F.lit(s.canonical).alias("canonical"), names(s).alias("names"), F.array(*map(F.lit, s.keywords)).cast("array<string>").alias("keywords")) for s in sections])
    found = "array<struct<section:string,place:int>>"

    def step(state: Column, s: Column) -> Column:
        within = lambda x: F.array_contains(s["names"], x["norm"]) | F.exists(s["names"], lambda n: (F.length(n) >= LEAST_WITHIN) & F.contains(x["norm"], n))
        betrayed = lambda x: (F.size(s["keywords"]) > 0) & F.forall(s["keywords"], lambda k: F.regexp_like(x["upper"], k))
        place = F.coalesce(
            F.get(F.filter(state["free"], within), F.lit(0))["idx"], F.when(F.exists("shorts", lambda x: F.array_contains(s["names"], x["norm"])), -1),
            F.get(F.filter(state["free"], betrayed), F.lit(0))["idx"], F.when(F.exists("shorts", betrayed), -1),
        )
        left = F.filter(state["free"], lambda x: F.coalesce(x["idx"] != place, F.lit(True)))
        return F.struct(left.cast(kind).alias("free"), F.array_append(state["found"], F.struct(s["canonical"].alias("section"), place.cast("int").alias("place"))).cast(found).alias("found"))

    start = F.struct(F.col("free").cast(kind).alias("free"), F.array().cast(found).alias("found"))
    matched = every.select("doc_id", F.explode(F.aggregate(wanted, start, step, lambda s: s["found"])).alias("m"))
    return matched.select("doc_id", "m.section", F.col("m.place").isNotNull().alias("present"), "m.place")


#: A heading's continuation has at most this many characters.
LONGEST_CONTINUATION = 120
#: Words that carry a heading on.
CONNECTORS = "и|в|на|с|по|из|к|о|об|от|у|для|при|без|над|под|до|за|через|между|а|но|или|что|как|где|который|которая|которое|которые"


def merge_headings(lines: DataFrame) -> DataFrame:
    """doc_id, idx, type, text, merged: headings that an author broke over several lines are one line again.

    A line carries the heading above on if it is body text or unknown, short, holds no reference or number of a section,
    begins in lower case or with a connector (or in upper case, if the whole heading is), what stands before it doesn't end
    a sentence, and at most one blank line lies between. The first line that doesn't ends the heading. Lines that were merged
    and blanks among them go. ``lines``: doc_id, idx, type, text; lines that aren't paragraphs should be left out.

    Each condition looks at the last line that isn't blank, so windows within a document say it all.
    """
    text = trimmed(F.col("text"))
    order = Window.partitionBy("doc_id").orderBy("idx")
    rows = lines.select("doc_id", "idx", "type", "text", text.alias("t"))
    rows = rows.withColumn("chain", F.count_if(F.col("type").startswith("heading_")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    chain = Window.partitionBy("doc_id", "chain").orderBy("idx")
    past, whole = chain.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("doc_id", "chain")
    rows = rows.withColumn("n", F.row_number().over(chain))
    written = F.when(F.col("t") != "", F.struct("t", "n"))
    rows = rows.withColumns({
        "above": F.last(written, ignorenulls=True).over(past),
        "upper": F.first(F.col("t") == F.upper("t")).over(chain),
    })
    t = F.col("t")
    begins = t.rlike(r"^[а-яёa-z\-(]") | t.rlike(rf"(?iu)^(?:{CONNECTORS})\s") | (F.col("upper") & t.rlike("^[А-ЯЁA-Z]"))
    carries = (
        F.col("type").isin("body_text", "unknown") & (t != "") & (F.length(t) <= LONGEST_CONTINUATION) & ~t.rlike(r"\[\d+|^\d+\.\d+")
        & ~F.col("above")["t"].rlike("[.!?:;]$") & (F.col("n") - F.col("above")["n"] <= 2) & begins & (F.col("chain") > 0)
    )
    rows = rows.withColumn("carries", F.coalesce(carries, F.lit(False)))
    ended = F.count_if((F.col("n") > 1) & (t != "") & ~F.col("carries")).over(chain.rowsBetween(Window.unboundedPreceding, 0))
    # Two blanks in a row end a heading too, but only a written line can show it.
    rows = rows.withColumn("member", F.col("carries") & (ended == 0))
    rows = rows.withColumns({"last": F.max(F.when(F.col("member"), F.col("n"))).over(whole), "more": F.sort_array(F.collect_list(F.when(F.col("member"), F.struct("n", "text"))).over(whole))})
    kept = rows.where((F.col("n") == 1) | F.col("last").isNull() | (F.col("n") > F.col("last")))
    opens = (F.col("n") == 1) & (F.col("chain") > 0) & F.col("last").isNotNull()
    joined = F.concat(F.lit(" "), F.array_join(F.transform("more", lambda x: x["text"]), " "))
    return kept.select("doc_id", "idx", "type", F.when(opens, trimmed(F.concat("text", joined))).otherwise(F.col("text")).alias("text"), F.when(opens, F.size("more")).otherwise(0).alias("merged"))


#: How captions and references to figures and tables are written.
FIGURE_CAPTION, TABLE_CAPTION = r"(?iu)^(Рисунок|Рис\.?)\s*(\d+(?:\.\d+)?)", r"(?iu)^(Таблица|Табл\.?)\s*[№#]?\s*(\d+(?:\.\d+)?)"
FIGURE_REFERENCE = r"(?iu)(рисунок|рисунке|рисунка|рисунком|рис\.?)\s*№?\s*(\d+(?:\.\d+)?)"
TABLE_REFERENCE = r"(?iu)(таблица|таблице|таблицы|таблицей|таблицу|табл\.?)\s*№?\s*(\d+(?:\.\d+)?)"
#: Abbreviations of references, with the letter before which they don't count, and what they stand for.
ABBREVIATED = [(r"(?<!\p{L})([Рр])ис\.?\s*(\d)", "$1исунок $2"), (r"(?<!\p{L})([Тт])абл\.?\s*(\d)", "$1аблица $2")]


def figure_prefix(x: Column) -> Column:
    return F.regexp_replace(x, r"(?iu)^Рис(?!у)\.?\s*", "Рисунок ")


def table_prefix(x: Column) -> Column:
    x = F.regexp_replace(x, r"(?iu)^Табл(?!и)\.?\s*", "Таблица ")
    x = F.regexp_replace(x, r"(?iu)^Таблица\s+[а-яё]*ица\s*", "Таблица ")
    return F.regexp_replace(x, r"(?iu)^(Таблица)\s*[№#]\s*", "Таблица ")


def full_references(x: Column) -> Column:
    """References with their abbreviations written out; a letter before means that it is another word's end."""
    for pattern, full in ABBREVIATED:
        x = F.regexp_replace(x, pattern, full)
    return x


def renumbered(text: Column, pattern: str, numbers: Column) -> Column:
    """Each reference's number by ``numbers`` (old to new), all in one pass from left to right; numbers that it lacks stay."""
    between = F.split(text, pattern)
    whole, prefix, old = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, 1, 2))
    hits = F.transform(F.arrays_zip(whole.alias("whole"), prefix.alias("prefix"), old.alias("old")), lambda x: F.coalesce(F.concat(x["prefix"], F.lit(" "), numbers[x["old"]].cast("string")), x["whole"]))
    pieces = F.zip_with(between, hits, lambda piece, hit: F.concat(piece, F.coalesce(hit, F.lit(""))))  # one piece more than hits
    return F.array_join(pieces, "")


def separated(x: Column) -> Column:
    """Between a table's number and its title stands a dash; after a number alone nothing."""
    x = F.regexp_replace(x, r"^(Таблица\s+\d+(?:\.\d+)?)\s*[.]\s*$", "$1")
    x = F.regexp_replace(x, r"^(Таблица\s+\d+(?:\.\d+)?)\s*[.\-–—]\s+", "$1 – ")
    x = F.regexp_replace(x, r"\s+$", "")
    return F.regexp_replace(x, r"^(Таблица\s+\d+(?:\.\d+)?)\s+(?![–—\-])(\S)", "$1 – $2")


def renumber_captions(lines: DataFrame) -> DataFrame:
    """doc_id, idx, type, text: captions numbered in their order, and references to them changed along.

    Figures and tables are numbered apart. A number that several captions had leads to the last of them. Prefixes are
    written out, a table's title is set off by a dash, abbreviated references are written out. Documents in which nothing is
    to be renumbered or written out stay as they are. Captions are told by their type (figure_caption, table_caption),
    lines without a type by their words; body_text, list_item and quote hold references. ``lines``: doc_id, idx, type, text.
    """
    text, kind = F.col("text"), F.col("type")
    is_figure, is_table = text.rlike(FIGURE_CAPTION), text.rlike(TABLE_CAPTION)
    untyped = kind.isNull()
    counts = {"figure": ((kind == "figure_caption") | untyped) & is_figure, "table": ((kind == "table_caption") | untyped) & is_table}
    patterns = {"figure": FIGURE_CAPTION, "table": TABLE_CAPTION}
    order = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.select("doc_id", "idx", "type", "text")
    for name, counted in counts.items():
        counted = F.coalesce(counted, F.lit(False))
        rows = rows.withColumn(f"{name}_new", F.when(counted, F.count_if(counted).over(order))).withColumn(f"{name}_old", F.when(counted, F.regexp_extract("text", patterns[name], 2)))
    abbreviated = ((kind == "figure_caption") & text.rlike(r"(?iu)^Рис\.?\s")) | ((kind == "table_caption") & text.rlike(r"(?iu)^Табл\.?\s|[№#]|\d+\.\s*$"))
    abbreviated = abbreviated | (kind.isin("body_text", "list_item") & text.rlike(r"(?iu)(?<!\p{L})(?:рис|табл)\.?\s*\d"))
    whole = Window.partitionBy("doc_id")
    for n in counts:
        rows = rows.withColumn(f"{n}_last", F.coalesce(F.col(f"{n}_new") == F.max(f"{n}_new").over(Window.partitionBy("doc_id", f"{n}_old")), F.lit(False)))
    for n in counts:
        entries = F.array_compact(F.collect_list(F.when(F.col(f"{n}_last"), F.struct(f"{n}_old", f"{n}_new"))).over(whole))
        rows = rows.withColumn(f"{n}_map", F.map_from_entries(entries)).withColumn(f"{n}_moves", F.coalesce(F.bool_or(F.col(f"{n}_old") != F.col(f"{n}_new").cast("string")).over(whole), F.lit(False)))
    rows = rows.withColumn("changes", F.coalesce(F.bool_or(abbreviated).over(whole), F.lit(False)) | F.col("figure_moves") | F.col("table_moves"))

    def own_number(x: Column, word: str, name: str) -> Column:
        pattern = rf"(?iu)^({word})\s*(\d+(?:\.\d+)?)"
        old = F.regexp_extract(x, pattern, 2)
        new = F.coalesce(F.col(f"{name}_map")[old].cast("string"), old)
        return F.when(F.col(f"{name}_moves") & x.rlike(pattern), F.concat(F.regexp_extract(x, pattern, 1), F.lit(" "), new, F.regexp_replace(x, pattern, ""))).otherwise(x)

    as_table = (kind == "table_caption") | (~F.coalesce(kind.isin("figure_caption"), F.lit(False)) & is_table)
    as_figure = (kind == "figure_caption") | is_figure
    body = full_references(text)
    body = F.when(F.col("figure_moves"), renumbered(body, FIGURE_REFERENCE, F.col("figure_map"))).otherwise(body)
    rows = rows.withColumn("referring", F.when(kind.isin("body_text", "list_item", "quote"), body))
    referring = F.when(F.col("table_moves"), renumbered(F.col("referring"), TABLE_REFERENCE, F.col("table_map"))).otherwise(F.col("referring"))
    after = F.when(as_table, separated(own_number(table_prefix(text), "Таблица", "table"))).when(as_figure, own_number(figure_prefix(text), "Рисунок", "figure")).otherwise(referring)
    changes = F.col("changes") & (trimmed(text) != "")
    return rows.select("doc_id", "idx", "type", F.coalesce(F.when(changes, after), text).alias("text"))


#: Rows that may belong to a title page, how many it takes at least, and how far down they are looked for.
TITLE_CANDIDATES, LEAST_CANDIDATES, TITLE_ROWS = ["body_text", "unknown"], 2, 10
TITLE_FOOTER = r"^(?:г\.\s*)?[А-ЯЁ][а-яё\-]+\s+\d{4}\s*$"
TITLE_SIGNATURE = r"подпись|оценка|дата|_{4,}|^\(.*\)$"
TITLE_HEADER = r"(?iu)министерство|федеральное|университет|академия|институт|кафедра|факультет|департамент"
#: Characters from which a row within a title page is the work's title.
TITLE_LENGTH = 50


def relabel_title_page(lines: DataFrame) -> DataFrame:
    """doc_id, idx, text, type: body text above the first heading as parts of a title page.

    The first rows, up to ten, before the first heading_1 or bibliography_title are looked at, in documents that have such a
    heading not in their first row. If one of them is labelled as a title page already, or fewer than two are candidates,
    nothing changes. A candidate with text is a footer (town and year), an annotation (signature, date, a line to fill in), a
    header (an institution's words), else within the page info or, if long, the title, and at either end plain title_page.
    """
    order, whole = Window.partitionBy("doc_id").orderBy("idx"), Window.partitionBy("doc_id")
    rows = lines.select("doc_id", "idx", "text", "type").withColumn("place", F.row_number().over(order) - 1)
    first = F.min(F.when(F.col("type").isin("heading_1", "bibliography_title"), F.col("place"))).over(whole)
    rows = rows.withColumn("range", F.when(first.isNotNull(), F.least(first, F.lit(TITLE_ROWS)))).withColumn("inside", F.coalesce(F.col("place") < F.col("range"), F.lit(False)))
    candidate = F.col("inside") & F.coalesce(F.col("type").isin(TITLE_CANDIDATES), F.lit(False))
    labelled = F.coalesce(F.bool_or(F.col("inside") & F.col("type").startswith("title_page")).over(whole), F.lit(False))
    changes = candidate & ~labelled & (F.count_if(candidate).over(whole) >= LEAST_CANDIDATES)
    text = trimmed(F.col("text"))
    between = (F.col("place") > 0) & (F.col("place") < F.col("range") - 1)
    part = (
        F.when(text.rlike(TITLE_FOOTER), "title_page_footer")
        .when(text.rlike(TITLE_SIGNATURE), "title_page_annotation")
        .when(text.rlike(TITLE_HEADER), "title_page_header")
        .when(between & (F.length(text) < TITLE_LENGTH), "title_page_info")
        .when(between, "title_page_title")
        .otherwise("title_page")
    )
    return rows.select("doc_id", "idx", "text", F.when(changes & (text != ""), part).otherwise(F.col("type")).alias("type"))
