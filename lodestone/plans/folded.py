"""Section matching, heading merge and caption renumbering over the lines of ``documents``.

The corpus has no titles or captions, so lines of some places get them by a rule; the rest keep their whole text. The SQL
states the operators anew, where they carry state as recursion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import folds
from ..sources.tables import paragraphs
from .catalog import Catalog, Tables

catalog = Catalog()
query = catalog.query

K = "(doc_id + idx)"
LINES = "WITH RECURSIVE p AS (SELECT doc_id, CAST(unnest(range(0, len(string_split(text, chr(10))))) AS INT) AS idx, unnest(string_split(text, chr(10))) AS text FROM documents),\n"

SECTIONS = [
    folds.Section("ВВЕДЕНИЕ"),
    folds.Section("ЗАКЛЮЧЕНИЕ", ["Выводы"]),
    folds.Section("РЕЗУЛЬТАТЫ"),
    folds.Section("СПИСОК ИСПОЛЬЗОВАННЫХ ИСТОЧНИКОВ", ["Список литературы"], ["СПИСОК", "ИСТОЧНИК|ЛИТЕРАТУР"]),
    folds.Section("ВЫВОДЫ"),
    folds.Section("СОДЕРЖАНИЕ", ["Оглавление"]),
]
TITLED = f"""CASE WHEN (3 * doc_id + 5 * idx) % 7 = 0 THEN CASE {K} % 9 WHEN 0 THEN '1. Введение' WHEN 1 THEN 'ЗАКЛЮЧЕНИЕ.' WHEN 2 THEN 'Основные выводы: итог' WHEN 3 THEN 'СПИСОК ТРЕБОВАНИЕ ИСТОЧНИКОВ' WHEN 4 THEN 'Методы' WHEN 5 THEN 'Содержание' WHEN 6 THEN 'Глава 2: результаты' WHEN 7 THEN ' введение ' ELSE '' END
WHEN (3 * doc_id + 5 * idx) % 7 = 3 THEN CASE {K} % 5 WHEN 0 THEN 'Оглавление' WHEN 1 THEN 'список важной литературы' WHEN 2 THEN 'ВЫВОДЫ' WHEN 3 THEN 'Выводы.' ELSE '' END ELSE text END"""
_NAMES = ", ".join(f"({i}, '{s.canonical}', {[n.lower() for n in (s.canonical, *s.synonyms)]}, {list(s.keywords)}::VARCHAR[])" for i, s in enumerate(SECTIONS, 1))


@query(LINES + f"""l AS (SELECT doc_id, idx, {TITLED} AS text, (3 * doc_id + 5 * idx) % 7 = 0 AS heading FROM p),
n AS (SELECT *, lower(trim(regexp_replace(text, '[.,:;!?\\s]+', ' ', 'g'))) AS norm, length(trim(text)) <= 80 AND NOT contains(text, '.') AND trim(text) <> '' AS short FROM l),
h AS (SELECT doc_id, coalesce(list({{'idx': idx, 'norm': norm, 'upper': upper(text)}} ORDER BY idx) FILTER (heading AND trim(text) <> ''), []) AS heads, coalesce(list({{'norm': norm, 'upper': upper(text)}} ORDER BY idx) FILTER (short), []) AS shorts FROM n GROUP BY doc_id),
s(i, canonical, names, keywords) AS (VALUES {_NAMES}),
r AS (SELECT doc_id, 0 AS i, NULL::VARCHAR AS section, NULL::INT AS place, []::INT[] AS used, heads, shorts FROM h
UNION ALL SELECT doc_id, i, canonical, place, CASE WHEN place >= 0 THEN list_append(used, place) ELSE used END, heads, shorts FROM (SELECT r.doc_id, s.i, s.canonical, r.used, r.heads, r.shorts, coalesce(
list_filter(r.heads, lambda x: NOT list_contains(r.used, x.idx) AND (list_contains(s.names, x.norm) OR len(list_filter(s.names, lambda y: length(y) >= 6 AND contains(x.norm, y))) > 0))[1].idx,
CASE WHEN len(list_filter(r.shorts, lambda x: list_contains(s.names, x.norm))) > 0 THEN -1 END,
CASE WHEN len(s.keywords) > 0 THEN list_filter(r.heads, lambda x: NOT list_contains(r.used, x.idx) AND len(list_filter(s.keywords, lambda y: NOT regexp_matches(x.upper, y))) = 0)[1].idx END,
CASE WHEN len(s.keywords) > 0 AND len(list_filter(r.shorts, lambda x: len(list_filter(s.keywords, lambda y: NOT regexp_matches(x.upper, y))) = 0)) > 0 THEN -1 END) AS place FROM r JOIN s ON s.i = r.i + 1))
SELECT doc_id, section, place IS NOT NULL AS present, place FROM r WHERE i > 0""")  # fmt: skip
def j16_sections_consumed(t: Tables) -> DataFrame:
    lines = paragraphs(t.documents).selectExpr("doc_id", "idx", f"{TITLED} AS text", "(3 * doc_id + 5 * idx) % 7 = 0 AS heading")
    return folds.match_sections(lines, SECTIONS)


BROKEN_TYPE = "CASE (3 * doc_id + 5 * idx) % 7 WHEN 0 THEN 'heading_1' WHEN 5 THEN 'unknown' WHEN 2 THEN 'list_item' ELSE 'body_text' END"
BROKEN = f"""CASE WHEN (3 * doc_id + 5 * idx) % 7 = 0 THEN CASE {K} % 5 WHEN 0 THEN 'О методах' WHEN 1 THEN 'ЧАСТЬ ' || doc_id WHEN 2 THEN 'Итог.' WHEN 3 THEN '' ELSE 'Работа' END
ELSE CASE (11 * doc_id + 2 * idx * idx + idx) % 9 WHEN 0 THEN '' WHEN 1 THEN 'и далее о ' || doc_id WHEN 2 THEN '- часть' WHEN 3 THEN 'ОБЩИЕ СВЕДЕНИЯ ' || idx WHEN 4 THEN 'в том числе, см. [1]' WHEN 5 THEN ' для всех.' WHEN 6 THEN 'над водой' WHEN 7 THEN ' ' ELSE text END END"""


@query(LINES + f"""l AS (SELECT doc_id, idx, {BROKEN_TYPE} AS type, {BROKEN} AS text, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS n FROM p),
r AS (SELECT doc_id, 0::BIGINT AS n, NULL::BIGINT AS opened, NULL::VARCHAR AS combined, false AS upper, 0 AS blanks, false AS member FROM (SELECT DISTINCT doc_id FROM l)
UNION ALL SELECT doc_id, n, CASE WHEN heading THEN CASE WHEN t <> '' AND NOT regexp_matches(t, '[.!?:;]$') THEN n END WHEN t = '' THEN CASE WHEN blanks < 1 THEN opened END WHEN carries THEN opened END,
CASE WHEN heading THEN t WHEN carries THEN combined || ' ' || t ELSE combined END, CASE WHEN heading THEN t = upper(t) ELSE upper END, CASE WHEN heading OR t <> '' THEN 0 ELSE blanks + 1 END, coalesce(carries AND NOT heading, false) FROM
(SELECT r.doc_id, l.n, r.opened, r.combined, r.upper, r.blanks, l.type LIKE 'heading%' AS heading, trim(l.text) AS t, r.opened IS NOT NULL AND l.type IN ('body_text', 'unknown') AND trim(l.text) <> '' AND length(trim(l.text)) <= 120 AND NOT regexp_matches(r.combined, '[.!?:;]$') AND NOT regexp_matches(trim(l.text), '\\[\\d+|^\\d+\\.\\d+')
AND (regexp_matches(trim(l.text), '^[а-яёa-z\\-(]') OR regexp_matches(trim(l.text), '(?i)^(?:{folds.CONNECTORS})\\s') OR (r.upper AND regexp_matches(trim(l.text), '^[А-ЯЁA-Z]'))) AS carries FROM r JOIN l ON l.doc_id = r.doc_id AND l.n = r.n + 1)),
m AS (SELECT l.*, r.member, r.opened FROM l JOIN r USING (doc_id, n)),
g AS (SELECT doc_id, opened, max(n) AS last, count(*) AS merged, string_agg(text, ' ' ORDER BY n) AS more FROM m WHERE member GROUP BY 1, 2)
SELECT m.doc_id, m.idx, m.type, md5(CASE WHEN o.last IS NOT NULL THEN trim(m.text || ' ' || o.more) ELSE m.text END) AS text_md5, CAST(coalesce(o.merged, 0) AS INTEGER) AS merged FROM m LEFT JOIN g o ON o.doc_id = m.doc_id AND o.opened = m.n
WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = m.doc_id AND m.n > g.opened AND m.n <= g.last)""")  # fmt: skip
def n11_headings_merged(t: Tables) -> DataFrame:
    lines = paragraphs(t.documents).selectExpr("doc_id", "idx", f"{BROKEN_TYPE} AS type", f"{BROKEN} AS text")
    return folds.merge_headings(lines).select("doc_id", "idx", "type", F.md5("text").alias("text_md5"), "merged")


FRONT_TYPE = "CASE WHEN (doc_id + idx) % 9 = 7 AND idx > 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'heading_1' ELSE 'bibliography_title' END WHEN idx = 2 AND doc_id % 11 = 0 THEN 'title_page_info' WHEN (doc_id * 3 + idx) % 5 = 1 THEN 'list_item' WHEN (doc_id * 3 + idx) % 5 = 2 THEN 'unknown' ELSE 'body_text' END"
FRONT = "CASE (doc_id * 7 + idx * 3) % 10 WHEN 0 THEN 'Москва 2026' WHEN 1 THEN 'г. Санкт-Петербург 1999 ' WHEN 2 THEN 'Дата: ______' WHEN 3 THEN '(подпись)' WHEN 4 THEN 'КАФЕДРА ' || doc_id WHEN 5 THEN 'Группа ' || idx WHEN 6 THEN ' ' ELSE text END"


@query(LINES + f"""l AS (SELECT doc_id, idx, {FRONT_TYPE} AS type, {FRONT} AS text FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS place FROM l),
h AS (SELECT doc_id, least(10, min(place) FILTER (type IN ('heading_1', 'bibliography_title'))) AS range, FROM r GROUP BY doc_id HAVING count(*) FILTER (type IN ('heading_1', 'bibliography_title')) > 0),
d AS (SELECT h.doc_id, range FROM h JOIN r ON r.doc_id = h.doc_id AND place < range GROUP BY 1, 2 HAVING count(*) FILTER (type LIKE 'title_page%') = 0 AND count(*) FILTER (type IN ('body_text', 'unknown')) >= 2)
SELECT doc_id, idx, md5(text) AS text_md5, CASE WHEN range IS NULL OR place >= range OR type NOT IN ('body_text', 'unknown') OR trim(text) = '' THEN type WHEN regexp_matches(trim(text), '{folds.TITLE_FOOTER}') THEN 'title_page_footer' WHEN regexp_matches(trim(text), '{folds.TITLE_SIGNATURE}') THEN 'title_page_annotation' WHEN regexp_matches(trim(text), '{folds.TITLE_HEADER.replace("(?iu)", "(?i)")}') THEN 'title_page_header'
WHEN place BETWEEN 1 AND range - 2 THEN CASE WHEN length(trim(text)) < 50 THEN 'title_page_info' ELSE 'title_page_title' END ELSE 'title_page' END AS type FROM r LEFT JOIN d USING (doc_id)""")
def n5_title_pages_relabelled(t: Tables) -> DataFrame:
    lines = paragraphs(t.documents).selectExpr("doc_id", "idx", f"{FRONT_TYPE} AS type", f"{FRONT} AS text")
    return folds.relabel_title_page(lines).select("doc_id", "idx", F.md5("text").alias("text_md5"), "type")


CAPTIONED_TYPE = "CASE (3 * doc_id + 5 * idx) % 7 WHEN 0 THEN 'figure_caption' WHEN 1 THEN 'table_caption' WHEN 5 THEN NULL WHEN 6 THEN 'heading_1' WHEN 4 THEN 'quote' ELSE 'body_text' END"
CAPTIONED = f"""CASE (3 * doc_id + 5 * idx) % 7
WHEN 0 THEN CASE {K} % 4 WHEN 0 THEN 'Рис. ' || {K} % 3 || ' – ' || text WHEN 1 THEN 'Рисунок ' || {K} % 5 || ' ' || text WHEN 2 THEN 'рис' || {K} % 4 || '.1 x' ELSE text END
WHEN 1 THEN CASE {K} % 5 WHEN 0 THEN 'Табл. №' || {K} % 3 || '. ' || text WHEN 1 THEN 'Таблица ' || {K} % 4 || ' - ' || text WHEN 2 THEN 'Таблица № ' || {K} % 6 || '. ' WHEN 3 THEN 'Таблица ' || {K} % 7 || ' ' || text ELSE text END
WHEN 5 THEN CASE {K} % 3 WHEN 0 THEN 'Рисунок ' || {K} % 6 || '. ' || text WHEN 1 THEN 'Таблица ' || {K} % 5 ELSE text END
WHEN 6 THEN text ELSE CASE {K} % 4 WHEN 0 THEN text || ' См. рис. ' || {K} % 4 || ' и табл.' || {K} % 3 || ', рисунке ' || {K} % 5 || '; таблицы № ' || {K} % 6 WHEN 1 THEN 'таблица ' || {K} % 4 || ' ' || text WHEN 2 THEN 'Рис.' || {K} % 3 || ' , барис 1 и рис. 2, рис 1 ' || text ELSE text END END"""
_WORDS = {"figure": ("Рисунок", folds.FIGURE_CAPTION, folds.FIGURE_REFERENCE), "table": ("Таблица", folds.TABLE_CAPTION, folds.TABLE_REFERENCE)}


def _sql(pattern: str) -> str:
    return pattern.replace("(?iu)", "(?i)")


def _own(x: str, name: str) -> str:
    pattern = f"(?i)^({_WORDS[name][0]})\\s*(\\d+(?:\\.\\d+)?)"
    old = f"regexp_extract({x}, '{pattern}', 2)"
    return f"CASE WHEN {name}_moves AND regexp_matches({x}, '{pattern}') THEN regexp_extract({x}, '{pattern}', 1) || ' ' || coalesce(list_filter({name}_map, lambda m: m.old = {old})[1].new::VARCHAR, {old}) || regexp_replace({x}, '{pattern}', '') ELSE {x} END"


def _renumbered(x: str, name: str) -> str:
    p = _sql(_WORDS[name][2])
    hits = f"list_transform(range(1, len(regexp_extract_all({x}, '{p}')) + 1), lambda i: coalesce(regexp_extract_all({x}, '{p}', 1)[i] || ' ' || list_filter({name}_map, lambda m: m.old = regexp_extract_all({x}, '{p}', 2)[i])[1].new::VARCHAR, regexp_extract_all({x}, '{p}')[i]))"
    return f"CASE WHEN {name}_moves THEN array_to_string(list_transform(range(1, len(string_split_regex({x}, '{p}')) + 1), lambda j: string_split_regex({x}, '{p}')[j] || coalesce({hits}[j], '')), '') ELSE {x} END"


_FIGURE, _TABLE = _sql(folds.FIGURE_CAPTION), _sql(folds.TABLE_CAPTION)
_OLDS = ", ".join(f"count(*) FILTER ({c}) OVER (PARTITION BY doc_id ORDER BY idx) AS {n}_new, CASE WHEN {c} THEN regexp_extract(text, '{_sql(_WORDS[n][1])}', 2) END AS {n}_old" for n, c in (("figure", f"(type = 'figure_caption' OR type IS NULL) AND regexp_matches(text, '{_FIGURE}')"), ("table", f"(type = 'table_caption' OR type IS NULL) AND regexp_matches(text, '{_TABLE}')")))
_MAPS = ", ".join(f"coalesce((SELECT list({{'old': o, 'new': n}}) FROM (SELECT {n}_old AS o, max({n}_new) AS n FROM c x WHERE x.doc_id = d.doc_id AND {n}_old IS NOT NULL GROUP BY 1)), []) AS {n}_map, coalesce((SELECT bool_or({n}_old <> {n}_new::VARCHAR) FROM c x WHERE x.doc_id = d.doc_id), false) AS {n}_moves" for n in _WORDS)


@query(LINES + f"""l AS (SELECT doc_id, idx, {CAPTIONED_TYPE} AS type, {CAPTIONED} AS text FROM p),
c AS (SELECT *, {_OLDS} FROM l),
d AS (SELECT doc_id, coalesce(bool_or((type = 'figure_caption' AND regexp_matches(text, '(?i)^Рис\\.?\\s')) OR (type = 'table_caption' AND regexp_matches(text, '(?i)^Табл\\.?\\s|[№#]|\\d+\\.\\s*$')) OR (type IN ('body_text', 'list_item') AND regexp_matches(text, '(?i)(^|[^\\pL])(рис|табл)\\.?\\s*\\d'))), false) AS abbreviated FROM l GROUP BY doc_id),
k AS (SELECT d.doc_id, abbreviated, {_MAPS} FROM d),
a AS (SELECT l.*, k.* EXCLUDE (doc_id), trim(text) <> '' AND (abbreviated OR figure_moves OR table_moves) AS changes,
regexp_replace(regexp_replace(regexp_replace(text, '(?i)^Табл($|[^иа-яё.])', 'Таблица \\1'), '(?i)^Табл\\.\\s*', 'Таблица '), '(?i)^(Таблица)\\s*[№#]\\s*', 'Таблица ') AS as_table, regexp_replace(regexp_replace(text, '(?i)^Рис\\.\\s*', 'Рисунок '), '(?i)^Рис(\\d)', 'Рисунок \\1') AS as_figure,
regexp_replace(regexp_replace(text, '(^|[^\\pL])([Рр])ис\\.?\\s*(\\d)', '\\1\\2исунок \\3', 'g'), '(^|[^\\pL])([Тт])абл\\.?\\s*(\\d)', '\\1\\2аблица \\3', 'g') AS body FROM l JOIN k USING (doc_id)),
b AS (SELECT *, {_renumbered('body', 'figure')} AS body1, {_own('as_table', 'table')} AS table1, {_own('as_figure', 'figure')} AS figure1 FROM a),
e AS (SELECT *, {_renumbered('body1', 'table')} AS body2, rtrim(regexp_replace(regexp_replace(table1, '^(Таблица\\s+\\d+(?:\\.\\d+)?)\\s*[.]\\s*$', '\\1'), '^(Таблица\\s+\\d+(?:\\.\\d+)?)\\s*[.\\-–—]\\s+', '\\1 – ')) AS table2 FROM b)
SELECT doc_id, idx, type, md5(CASE WHEN NOT changes THEN text WHEN type = 'table_caption' OR (type IS DISTINCT FROM 'figure_caption' AND regexp_matches(text, '{_TABLE}')) THEN regexp_replace(table2, '^(Таблица\\s+\\d+(?:\\.\\d+)?)\\s+([^–—\\-\\s])', '\\1 – \\2')
WHEN type = 'figure_caption' OR regexp_matches(text, '{_FIGURE}') THEN figure1 WHEN type IN ('body_text', 'list_item', 'quote') THEN body2 ELSE text END) AS text_md5 FROM e""")  # fmt: skip
def n7_t17_t18_captions_renumbered(t: Tables) -> DataFrame:
    lines = paragraphs(t.documents).selectExpr("doc_id", "idx", f"{CAPTIONED_TYPE} AS type", f"{CAPTIONED} AS text")
    return folds.renumber_captions(lines).select("doc_id", "idx", "type", F.md5("text").alias("text_md5"))


QUERIES, ORACLE_SQL = catalog.queries, catalog.sql
