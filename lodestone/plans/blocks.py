"""Block types of the lines of ``documents`` by the rules themselves.

The corpus has neither headings nor captions nor styles, so they are put in front of some lines by (7 * doc_id + 13 * idx)
% 24, styles by (doc_id + 3 * idx) % 9; types are then told from text and style alone. Where the rules leave a line to a
model, a label dealt by (5 * doc_id + 11 * idx) % 12 stands for its answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import blocks as op
from ..operators import procedural
from ..sources.tables import paragraphs
from .catalog import Catalog, Tables

catalog = Catalog()

#: What stands before a line; those that end in = stand for the whole line.
PUT_IN = ["=", " 17 =", "Рисунок 3 – ", "Табл. № 2 ", "ВВЕДЕНИЕ=", "Список литературы=", "Приложение А=", "– ", "б) ", "12) ", "7. A", "2.1 ", "3.1.2. ", "(", "Г. Москва 2024="]
STYLES = ["Heading 2", "heading5", "List Paragraph", "heading1"]
LABELS = ["body_text", "unknown", "bibliography_entry", "toc_entry", "toc", "appendix_content", "list_item", "title_page", "text", "heading", "unknown", "body_text"]
W = op.Words()


def listed(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def re2(pattern: str) -> str:
    """The pattern in the dialect of the SQL engine, which folds case over all letters anyway."""
    return pattern.replace("(?iu)", "(?i)").replace("'", "''")


def has(pattern: str) -> str:
    return f"regexp_matches(x, '{re2(pattern)}')"


LINES = f"""WITH p0 AS (SELECT doc_id, CAST(unnest(range(0, len(string_split(text, chr(10))))) AS INT) AS idx, unnest(string_split(text, chr(10))) AS line FROM documents),
p1 AS (SELECT doc_id, idx, line, ({listed(PUT_IN)})[CAST((7 * doc_id + 13 * idx) % 24 + 1 AS INT)] AS put, ({listed(STYLES)})[CAST((doc_id + 3 * idx) % 9 + 1 AS INT)] AS style, ({listed(LABELS)})[CAST((5 * doc_id + 11 * idx) % 12 + 1 AS INT)] AS label FROM p0),
p2 AS (SELECT doc_id, idx, style, label, CASE WHEN put IS NULL THEN line WHEN put LIKE '%=' THEN left(put, length(put) - 1) ELSE put || line END AS text FROM p1),
p AS (SELECT *, trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(160) || chr(65279)) AS x, lower(coalesce(style, '')) AS s FROM p2),
h AS (SELECT *, CASE WHEN s LIKE 'heading%' AND TRY_CAST(regexp_replace(s, '[^0-9]', '', 'g') AS INT) BETWEEN 1 AND 4 THEN 'heading_' || TRY_CAST(regexp_replace(s, '[^0-9]', '', 'g') AS INT) END AS of_style FROM p),
r AS (SELECT *, CASE WHEN x = '' THEN 'empty' WHEN {has("^[0-9]{1,4}$")} THEN 'page_number' WHEN of_style IS NOT NULL THEN of_style WHEN {has(W.figure)} THEN 'figure_caption' WHEN {has(W.table)} THEN 'table_caption'
WHEN {has(W.section)} THEN CASE WHEN {has(W.bibliography)} THEN 'bibliography_title' WHEN {has(W.appendix)} THEN 'appendix_title' ELSE 'heading_1' END WHEN {has(W.marker)} THEN 'list_item' END AS ruled FROM h),
t AS (SELECT *, coalesce(ruled, CASE label WHEN 'text' THEN 'body_text' WHEN 'heading' THEN 'heading_1' ELSE label END) AS type FROM r)
"""


def query(sql: str):
    return catalog.query(LINES + sql)


def lines(t: Tables) -> DataFrame:
    def dealt(values: list[str], k: Column) -> Column:
        return F.get(F.array(*map(F.lit, values)), k.cast("int"))

    doc, idx = F.col("doc_id"), F.col("idx")
    put = dealt(PUT_IN, (7 * doc + 13 * idx) % 24)
    text = F.when(put.isNull(), F.col("text")).when(put.endswith("="), F.substring(put, F.lit(1), F.length(put) - 1)).otherwise(F.concat(put, F.col("text")))
    return paragraphs(t.documents).select("doc_id", "idx", text.alias("text"), dealt(STYLES, (doc + 3 * idx) % 9).alias("style"), dealt(LABELS, (5 * doc + 11 * idx) % 12).alias("label"))


def marked(t: Tables) -> DataFrame:
    """Lines with ``type``: the rule's, else the repaired label."""
    ruled = op.by_rule(F.col("text"), F.col("style"))["type"]
    return lines(t).withColumn("type", F.coalesce(ruled, op.repaired_label(F.col("label"))))


@query("SELECT doc_id, idx, ruled, CASE WHEN ruled IN ('empty', 'page_number') THEN 1.0 WHEN of_style IS NOT NULL THEN 0.98 WHEN ruled IN ('figure_caption', 'table_caption') THEN 0.97 WHEN ruled = 'list_item' THEN 0.9 WHEN ruled IS NOT NULL THEN 0.95 END::DOUBLE AS confidence FROM r")
def c1_block_rules(t: Tables) -> DataFrame:
    return lines(t).select("doc_id", "idx", op.by_rule(F.col("text"), F.col("style")).alias("r")).select("doc_id", "idx", F.col("r.type").alias("ruled"), F.col("r.confidence").cast("double").alias("confidence"))


@query("SELECT doc_id, idx, type, ruled IS NOT NULL AS by_rule FROM t")
def u6_rules_and_labels(t: Tables) -> DataFrame:
    """The rule's type where there is one, the model's elsewhere, in one list."""
    return marked(t).select("doc_id", "idx", "type", op.by_rule(F.col("text"), F.col("style")).isNotNull().alias("by_rule"))


@query(f"""SELECT doc_id, idx, CASE WHEN type <> 'unknown' THEN type WHEN x = '' THEN 'empty' WHEN {has(r"^[0-9]+[.][0-9]+[.][0-9]+[.]?[[:space:]]+[^[:space:]]")} THEN 'heading_3' WHEN {has(r"^[0-9]+[.][0-9]+[.]?[[:space:]]+[^[:space:]]")} THEN 'heading_2'
WHEN length(x) < 60 AND ({has(W.any_section)} OR {has(r"^[0-9]+[.][[:space:]]+[^[:space:]]")}) THEN 'heading_1' WHEN {has(W.any_caption)} THEN CASE WHEN {has(W.any_table)} THEN 'table_caption' ELSE 'figure_caption' END
WHEN {has(W.any_marker)} THEN 'list_item' WHEN s LIKE 'heading 1%' OR s = 'heading1' THEN 'heading_1' WHEN s LIKE 'heading 2%' OR s = 'heading2' THEN 'heading_2' WHEN s LIKE 'heading 3%' OR s = 'heading3' THEN 'heading_3' WHEN contains(s, 'list') THEN 'list_item' ELSE 'body_text' END AS type FROM t""")
def c2_fallback_for_unknown(t: Tables) -> DataFrame:
    filled = F.when(F.col("type") == "unknown", op.fallback(F.col("text"), F.col("style"))).otherwise(F.col("type"))
    return marked(t).select("doc_id", "idx", filled.alias("type"))


@catalog.query("SELECT event_id, CASE label " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in op.LABEL_REPAIRS.items()) + f" ELSE label END AS label FROM (SELECT event_id, ({listed([*op.LABEL_REPAIRS, 'body_text', 'toc'])})[CAST(event_id % 18 + 1 AS INT)] AS label FROM events)")
def c3_label_repairs(t: Tables) -> DataFrame:
    dealt = F.get(F.array(*map(F.lit, [*op.LABEL_REPAIRS, "body_text", "toc"])), (F.col("event_id") % 18).cast("int"))
    return t.events.select("event_id", op.repaired_label(dealt).alias("label"))


@query(f"""SELECT doc_id, idx, CASE WHEN type LIKE 'heading\\_%' ESCAPE '\\' AND length(x) > 200 THEN 'body_text' WHEN type = 'appendix_content' AND NOT in_appendix THEN 'body_text'
WHEN type = 'toc_entry' AND coalesce(prev, '') NOT IN ('toc', 'toc_entry') AND coalesce(after, '') NOT IN ('toc', 'toc_entry') THEN 'body_text' WHEN type = 'unknown' AND prev = 'list_item' AND after = 'list_item' THEN 'list_item'
WHEN type = 'unknown' AND prev = 'bibliography_entry' AND after = 'bibliography_entry' THEN 'bibliography_entry' WHEN type = 'body_text' AND in_list AND {has(W.entry)} THEN 'bibliography_entry' WHEN type = 'bibliography_entry' AND NOT seen THEN 'body_text' ELSE type END AS fixed
FROM (SELECT *, lag(type) OVER o AS prev, lead(type) OVER o AS after, coalesce(bool_or(type = 'bibliography_title') OVER w, false) AS seen, coalesce(last_value(CASE WHEN type = 'bibliography_title' THEN true WHEN type IN ('appendix_title', 'heading_1') THEN false END IGNORE NULLS) OVER w, false) AS in_list,
coalesce(last_value(CASE WHEN type = 'appendix_title' THEN true WHEN type = 'heading_1' THEN false END IGNORE NULLS) OVER w, false) AS in_appendix FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY idx), w AS (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING))""")
def n3_rules_of_context(t: Tables) -> DataFrame:
    return op.validated_in_context(marked(t)).select("doc_id", "idx", "fixed")


@query(f"""SELECT doc_id, idx, CASE WHEN type = 'bibliography_entry' THEN type WHEN type = 'title_page' AND {has("^[(].*[)]$")} THEN 'title_page_annotation' WHEN type = 'title_page' AND {has(W.footer)} THEN 'title_page_footer' WHEN type = 'body_text' AND {has(W.marker)} THEN 'list_item' WHEN type = 'body_text' AND of_style IS NOT NULL THEN of_style
WHEN type = 'body_text' AND {has(W.table)} THEN 'table_caption' WHEN type = 'body_text' AND {has(W.figure)} THEN 'figure_caption' WHEN {has("^[0-9]{1,4}$")} AND type NOT IN ('page_number', 'toc_entry') THEN 'page_number' WHEN x = '' AND type <> 'empty' THEN 'empty' ELSE type END AS fixed,
CASE WHEN type = 'bibliography_entry' THEN CASE WHEN {has(W.latin)} AND NOT {has(W.local)} THEN 'en' ELSE 'ru' END END AS language FROM (SELECT * REPLACE (CASE label WHEN 'text' THEN 'body_text' WHEN 'heading' THEN 'heading_1' ELSE label END AS type) FROM t)""")
def n4_rules_one_by_one(t: Tables) -> DataFrame:
    """Over the model's labels alone, as a safety net behind it."""
    labelled = lines(t).withColumn("type", op.repaired_label(F.col("label")))
    return op.validated_one_by_one(labelled).select("doc_id", "idx", "fixed", "language")


@catalog.query(None)
def n18_structural_chunks(t: Tables) -> DataFrame:
    return procedural.chunks(lines(t).withColumn("score", op.cut_score(F.col("text"), F.col("style"))))


#: What the repairs mend, before each third word boundary of a line, by (doc_id + idx) % 8.
DEFECTS = ["и т. д. ", "Т.Е. ", "5 мм, ", "И. И. Иванов ", "J. R. Smith ", '"так" — ', "конец.. ", "  "]
_DEFECTIVE = f"""WITH p0 AS (SELECT doc_id, CAST(unnest(range(0, len(string_split(text, chr(10))))) AS INT) AS idx, unnest(string_split(text, chr(10))) AS line FROM documents),
d AS (SELECT doc_id, idx, ' ' || chr(9) || regexp_replace(line, '([a-z]) ([a-z])', '\\1 ' || ({listed(DEFECTS)})[CAST((doc_id + idx) % 8 + 1 AS INT)] || '\\2') AS line FROM p0)
"""


def defective_lines(t: Tables) -> DataFrame:
    defect = F.get(F.array(*map(F.lit, DEFECTS)), ((F.col("doc_id") + F.col("idx")) % 8).cast("int"))
    first = F.regexp_instr("text", F.lit("[a-z] [a-z]"))
    put = F.when(first > 0, F.concat(F.substring("text", F.lit(1), first + 1), defect, F.substring(F.col("text"), first + 2, F.length("text")))).otherwise(F.col("text"))
    return paragraphs(t.documents).select("doc_id", "idx", F.concat(F.lit(" \t"), put).alias("line"))


def _abbreviations(x: str) -> str:
    for short, long in fx.ABBREVIATIONS.items():
        x = f"regexp_replace({x}, '(?i){fx.abbreviation(short)}', '{long}', 'g')"
    return x


def _units(x: str) -> str:
    return f"regexp_replace({x}, '(?i)([0-9])[[:space:]]+({fx.UNITS})([[:space:].,;:!?)}}\\]-]|$)', '\\1' || chr(160) || '\\2\\3', 'g')"


def _initials(x: str) -> str:
    for big, small in (("А-ЯЁ", "а-яё"), ("A-Z", "a-z")):
        x = f"regexp_replace({x}, '([{big}])\\.[[:space:]]+([{big}])\\.', '\\1.' || chr(160) || '\\2.', 'g')"
        x = f"regexp_replace({x}, '([{big}])\\.[[:space:]]+([{big}][{small}]+)', '\\1.' || chr(160) || '\\2', 'g')"
    return x


def _dots(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '(^|[^.])\\.\\.([^.]|$)', '\\1.\\2', 'g'), '(^|[^.])\\.\\.([^.]|$)', '\\1.\\2', 'g')"


@catalog.query(_DEFECTIVE + f"SELECT doc_id, idx, {_abbreviations('line')} AS fixed FROM d")
def t4_abbreviation_list(t: Tables) -> DataFrame:
    return defective_lines(t).select("doc_id", "idx", fx.expand_abbreviations(F.col("line")).alias("fixed"))


@catalog.query(_DEFECTIVE + f"SELECT doc_id, idx, {_initials(_units('line'))} AS fixed FROM d")
def t5_units_and_initials(t: Tables) -> DataFrame:
    return defective_lines(t).select("doc_id", "idx", fx.nbsp_after_initials(fx.nbsp_before_units(F.col("line"))).alias("fixed"))


@catalog.query(_DEFECTIVE + "SELECT doc_id, idx, replace(regexp_replace(" + _initials(_units(_abbreviations(_dots("regexp_replace(ltrim(line, ' ' || chr(9)), ' {2,}', ' ', 'g')")))) + """, '"([^"]+)"', '«\\1»', 'g'), '—', '–') AS fixed FROM d""")
def t7_all_repairs(t: Tables) -> DataFrame:
    return defective_lines(t).select("doc_id", "idx", fx.repair(F.col("line")).alias("fixed"))


QUERIES, ORACLE_SQL = catalog.queries, catalog.sql
