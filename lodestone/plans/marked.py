"""Markdown queries: lines of ``documents`` that are marked up by place, promoted and repaired in whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import markdown
from ..sources.tables import paragraphs
from .catalog import Catalog, Tables

catalog = Catalog()
query = catalog.query

K = "(doc_id * 5 + idx)"
LINES = "WITH p AS (SELECT doc_id, CAST(unnest(range(0, len(string_split(text, chr(10))))) AS INT) AS idx, unnest(string_split(text, chr(10))) AS text FROM documents),\n"


def dealt(t: Tables, marked: str) -> DataFrame:
    return paragraphs(t.documents).selectExpr("doc_id", "idx", f"{marked} AS text")


def re2(pattern: str) -> str:
    """A fixed pattern as the other engine reads it, in quotes."""
    return "'" + pattern.replace("(?iu)", "(?i)").replace("'", "''") + "'"


HEADED = f"""CASE {K} % 17 WHEN 0 THEN '1. <a id="_T"></a>__' || replace(text, '_', '') || '__' WHEN 1 THEN '\t2. **Часть ' || doc_id || '** ' WHEN 2 THEN '### ' || text WHEN 3 THEN CASE WHEN doc_id % 3 = 0 THEN '## ' ELSE '#### ' END || text WHEN 4 THEN '__Заключение__'
WHEN 5 THEN 'Глава 2. ' || text WHEN 6 THEN '1.1 Название раздела ' || idx WHEN 7 THEN 'ОБЩИЕ СВЕДЕНИЯ' WHEN 8 THEN '' WHEN 9 THEN '3. ПРОЧЕЕ И РАЗНОЕ' WHEN 10 THEN CASE WHEN doc_id % 4 = 0 THEN '```' ELSE 'введение' END WHEN 11 THEN CASE WHEN doc_id % 5 = 0 THEN '# ' || text ELSE text END WHEN 12 THEN 'ИТОГО.' WHEN 13 THEN '4. Параметр ' || text ELSE text END"""
_LIST = [markdown.LIST_HEADING.replace("(__|\\*\\*)", m).replace("\\2", m) for m in ("__", "\\*\\*")]
_BARE = "trim(regexp_replace(regexp_replace(regexp_replace(trim({0}), '^[*_]+', ''), '[*_]+$', ''), '\\\\([.,:;!?])', '\\1', 'g'))"


def _part(group: int) -> str:
    return f"regexp_extract(line, {re2(markdown.NUMBERED)}, {group})"


@query(LINES + f"""a AS (SELECT doc_id, idx, {HEADED} AS text FROM p),
b AS (SELECT *, regexp_matches(text, {re2(markdown.FENCE)}) OR coalesce(count(*) FILTER (regexp_matches(text, {re2(markdown.FENCE)})) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS fenced FROM a),
c AS (SELECT *, count(*) FILTER (regexp_matches(text, '^#\\s') AND NOT fenced) OVER w AS h1, count(*) FILTER (regexp_matches(text, '^##\\s') AND NOT fenced) OVER w AS h2, count(*) FILTER (regexp_matches(text, '^###\\s') AND NOT fenced) OVER w AS h3,
CASE WHEN regexp_matches(text, {re2(_LIST[0])}) THEN trim(regexp_extract(text, {re2(_LIST[0])}, 2)) WHEN regexp_matches(text, {re2(_LIST[1])}) THEN trim(regexp_extract(text, {re2(_LIST[1])}, 2)) END AS item FROM b WINDOW w AS (PARTITION BY doc_id)),
d AS (SELECT * REPLACE (CASE WHEN NOT fenced AND length(item) >= 3 THEN repeat('#', least(4, length(regexp_extract(text, '^(\\t*)', 1)) + 1)) || ' ' || item ELSE text END AS text) FROM c),
e AS (SELECT * REPLACE (CASE WHEN fenced THEN text WHEN h1 = 0 AND h2 = 0 AND h3 > 0 THEN regexp_replace(regexp_replace(text, '^#### ', '## '), '^### ', '# ') WHEN h1 = 0 AND h2 > 0 THEN regexp_replace(text, '^###? ', '# ') ELSE text END AS text) FROM d),
f AS (SELECT *, {_BARE.format("regexp_replace(trim(text), '(?i)<a id=\"[^\"]*\">\\s*</a>', '', 'g')")} AS clean FROM e),
g AS (SELECT * REPLACE (CASE WHEN NOT fenced AND NOT starts_with(trim(text), '#') AND regexp_matches(clean, {re2(markdown.STRICT_TITLE)}) THEN '# ' || clean ELSE text END AS text) FROM f),
h AS (SELECT *, {_BARE.format("text")} AS line, coalesce(trim(lag(text) OVER (PARTITION BY doc_id ORDER BY idx)) <> '', false) AS after_text FROM g),
i AS (SELECT *, CASE WHEN fenced OR line = '' OR starts_with(line, '#') THEN NULL WHEN regexp_matches(line, {re2(markdown.TITLE)}) OR regexp_matches(line, {re2(markdown.CHAPTER)}) THEN '# ' || line
WHEN regexp_matches(line, {re2(markdown.NUMBERED)}) THEN CASE WHEN {_part(2)} <> '' THEN '## ' || {_part(1)} || {_part(2)} || {_part(3)} || ' ' || trim({_part(4)}) WHEN regexp_matches({_part(4)}, {re2(markdown.CAPITALS)}) THEN '# ' || {_part(1)} || ' ' || trim({_part(4)}) END
WHEN regexp_matches(line, {re2(markdown.ALL_CAPS)}) AND NOT regexp_matches(line, '[.!?]$') THEN '# ' || line END AS heading FROM h),
j AS (SELECT doc_id, idx, unnest(CASE WHEN heading IS NULL THEN [text] WHEN after_text THEN ['', heading] ELSE [heading] END) AS text, unnest(CASE WHEN heading IS NOT NULL AND after_text THEN [0, 1] ELSE [0] END) AS part FROM i)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY idx, part) - 1 AS INTEGER) AS idx, md5(text) AS text_md5, starts_with(text, '#') AS heading FROM j""")
def t30_headings_promoted(t: Tables) -> DataFrame:
    rows = markdown.promote_headings(dealt(t, HEADED))
    return rows.select("doc_id", "idx", F.md5("text").alias("text_md5"), F.startswith("text", F.lit("#")).alias("heading"))


MARKED = f"""CASE {K} % 19 WHEN 0 THEN replace(text, ', ', '\\\\, ') WHEN 1 THEN '<a id="_Toc"></a>' || text WHEN 2 THEN '# __' || text || '__' WHEN 3 THEN '## # ' || text WHEN 4 THEN replace(text, ' the ', ' \\\\_the\\\\_ ') WHEN 5 THEN text || ' ______ ' || idx WHEN 6 THEN 'Этап:__ ' || text
WHEN 7 THEN text || '__' WHEN 8 THEN '__' || text WHEN 9 THEN 'x_y ' || text WHEN 10 THEN CASE WHEN doc_id % 3 = 0 THEN '```' ELSE text END WHEN 11 THEN '' WHEN 12 THEN ' ![x](media/image-' || doc_id % 2 || '.png)' WHEN 13 THEN text || ' ![y](image-1.png) и ![z](image-' || idx || '.png).' WHEN 14 THEN '*image*'
WHEN 15 THEN '### **_' || text WHEN 16 THEN 'a (__b ' || text ELSE text END"""
#: The third of the last repairs looks ahead, which the other engine can't: it takes what follows along.
_AHEAD = "(\\S)__([\\s—–\\-.,;:!?)»\"''}]|$)"
_SQL_MARKED = MARKED.replace("\\\\", "\\")


def _chain(x: str, steps: list[tuple[str, str]]) -> str:
    for pattern, by in steps:
        x = f"regexp_replace({x}, '{_AHEAD}', '\\1\\2', 'g')" if "(?=" in pattern else f"regexp_replace({x}, {re2(pattern)}, '{by.replace('$', chr(92))}', 'g')"
    return x


_KNOWN = "(starts_with(trim({0}), 'extra-') OR list_contains(['image-1.png', 'image-3.png'], regexp_extract(trim({0}), '([^/]*)$', 1)))"
_INSIDE = f"array_to_string(list_transform(range(1, len(string_split_regex(text, {re2(markdown.IMAGE)})) + 1), lambda i: string_split_regex(text, {re2(markdown.IMAGE)})[i] || coalesce(CASE WHEN {_KNOWN.format('regexp_extract_all(text, ' + re2(markdown.IMAGE) + ', 1)[i]')} THEN regexp_extract_all(text, {re2(markdown.IMAGE)})[i] ELSE '' END, '')), '')"


@query(LINES + f"""a AS (SELECT doc_id, idx, {_SQL_MARKED} AS text FROM p),
b AS (SELECT *, regexp_matches(text, {re2(markdown.FENCE)}) OR coalesce(count(*) FILTER (regexp_matches(text, {re2(markdown.FENCE)})) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS fenced FROM a),
c AS (SELECT * REPLACE (CASE WHEN fenced THEN text WHEN regexp_matches(trim(text), {re2(markdown.IMAGE_LINE)}) THEN CASE WHEN {_KNOWN.format('regexp_extract(trim(text), ' + re2(markdown.IMAGE_LINE) + ', 1)')} THEN trim(text) ELSE '' END WHEN regexp_matches(trim(text), {re2(markdown.PLACEHOLDER)}) THEN '' WHEN contains(text, '![') THEN {_INSIDE} ELSE text END AS text) FROM b),
d AS (SELECT * REPLACE (CASE WHEN fenced THEN text ELSE {_chain('text', markdown.BEFORE)} END AS text) FROM c),
e AS (SELECT *, NOT fenced AND regexp_matches(text, {re2(markdown.HEADING)}) AS heading FROM d),
f AS (SELECT * REPLACE (CASE WHEN heading THEN regexp_extract(text, {re2(markdown.HEADING)}, 1) || ' ' || trim(regexp_replace(regexp_extract(text, {re2(markdown.HEADING)}, 2), '^#+\\s*', '')) ELSE text END AS text) FROM e),
g AS (SELECT * REPLACE (CASE WHEN fenced THEN text ELSE {_chain('text', markdown.AFTER)} END AS text), coalesce(trim(lag(text) OVER w) <> '', false) AS before, coalesce(trim(lead(text) OVER w) <> '' AND NOT lead(heading) OVER w, false) AS behind FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
h AS (SELECT * REPLACE (CASE WHEN NOT fenced AND regexp_matches(text, '__\\s*$') AND NOT contains(regexp_replace(text, '__\\s*$', ''), '__') THEN regexp_replace(text, '__\\s*$', '') || regexp_extract(text, '(\\s*)$', 1) ELSE text END AS text) FROM g),
i AS (SELECT * REPLACE (CASE WHEN NOT fenced AND (length(text) - length(replace(text, '_', ''))) % 2 = 1 THEN replace(text, '_', '') ELSE text END AS text) FROM h),
j AS (SELECT doc_id, idx, unnest(l) AS text, unnest(range(0, len(l))) AS part FROM (SELECT *, CASE WHEN heading THEN CASE WHEN before THEN [''] ELSE [] END || [text] || CASE WHEN behind THEN [''] ELSE [] END ELSE [text] END AS l FROM i))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY idx, part) - 1 AS INTEGER) AS idx, md5(text) AS text_md5 FROM j""")
def t29_lines_repaired(t: Tables) -> DataFrame:
    names = F.explode(F.array(F.lit("image-1.png"), F.lit("image-3.png"))).alias("name")
    rows = markdown.repair_lines(dealt(t, MARKED), t.documents.select("doc_id", names))
    return rows.select("doc_id", "idx", F.md5("text").alias("text_md5"))


QUERIES, ORACLE_SQL = catalog.queries, catalog.sql
