"""Files by type and audits of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit
from ..sources import docx, texts
from .catalog import Catalog, Tables

catalog = Catalog()
query = catalog.query


@query("""SELECT doc_id || CASE doc_id % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.docx' WHEN 2 THEN '.TXT' WHEN 3 THEN '.pdf' ELSE '.x.md' END AS path, CASE WHEN doc_id % 5 IN (0, 1, 2) THEN md5(text) END AS text_md5,
CASE doc_id % 5 WHEN 3 THEN 'no reader for application/pdf' WHEN 4 THEN 'no reader for this type' END AS error FROM documents""")
def s9_s10_texts_by_type(t: Tables) -> DataFrame:
    """Documents as files of five kinds, read by their type."""
    ending = F.element_at(F.array(*map(F.lit, (".txt", ".docx", ".TXT", ".pdf", ".x.md"))), (F.col("doc_id") % 5 + 1).cast("int"))
    path = F.concat("doc_id", ending).alias("path")
    packaged = docx.documents_to_docx(t.documents.where("doc_id % 5 = 1")).select(path, "content")
    plain = t.documents.where("doc_id % 5 <> 1").select(path, F.encode("text", "UTF-8").alias("content"))
    return texts.text_of(plain.unionByName(packaged)).select("path", F.md5("text").alias("text_md5"), "error")


TITLE = "CASE page_id % 6 WHEN 0 THEN title || ' 2026' WHEN 1 THEN title || ': образец в Ворде' WHEN 2 THEN 'Скачать Бесплатно ' || title WHEN 3 THEN title || ' PRO plus' ELSE title END"
DESCRIPTION = "CASE page_id % 4 WHEN 0 THEN para WHEN 1 THEN title || ' ' || title || ' ' || title WHEN 2 THEN '' END"


@query(f"""WITH p AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<p>([^<]*)', 1) AS para, len(regexp_extract_all(html, 'href="([^"]*)"')) AS n FROM pages),
q AS (SELECT page_id, url, {TITLE} AS title, coalesce({DESCRIPTION}, '') AS description, n, page_id % 3 > 0 AS m FROM p),
r AS (SELECT *, length(title) AS tl, length(description) AS dl, lower(title || ' ' || description) AS hay FROM q),
f AS (SELECT *, regexp_matches(hay, '\\b(?:2025|2026|2027)\\b') AS y, regexp_matches(hay, '(^|[^\\pL])бесплатн') AS fr, regexp_matches(hay, 'пример|образец|шаблон') AS ex, regexp_matches(hay, '(^|[^\\pL])в\\s+(?:ворд|word)|ворде') AS wo, regexp_matches(hay, 'скачать|загрузить') AS dn, regexp_matches(hay, '\\bpro\\b|pro\\s+plus|платн') AS paid FROM r)
SELECT url AS slug, CASE WHEN y THEN 20 ELSE 0 END + CASE WHEN tl <= 70 THEN 15 ELSE 5 END + CASE WHEN dl BETWEEN 120 AND 180 THEN 15 ELSE 5 END + CASE WHEN n >= 10 THEN 15 ELSE 5 END + CASE WHEN m THEN 10 ELSE 0 END + CASE WHEN fr THEN 10 ELSE 0 END + CASE WHEN ex THEN 10 ELSE 0 END + CASE WHEN dn THEN 5 ELSE 0 END AS score,
CAST(tl AS INTEGER) AS title_length, CAST(dl AS INTEGER) AS description_length, CAST(n AS INTEGER) AS keyword_count, y AS has_year, fr AS has_free, ex AS has_example, wo AS has_word, dn AS has_download, m AS has_modified,
list_filter([CASE WHEN NOT y THEN 'year' END, CASE WHEN tl > 70 THEN 'title ' || tl END, CASE WHEN dl < 120 THEN 'description ' || dl || ' short' END, CASE WHEN dl > 180 THEN 'description ' || dl || ' long' END, CASE WHEN n < 10 THEN 'keywords ' || n END, CASE WHEN NOT m THEN 'modified' END, CASE WHEN NOT fr AND NOT paid THEN 'free' END, CASE WHEN NOT ex THEN 'example' END], lambda x: x IS NOT NULL) AS issues FROM f""")
def t33_posts_audited(t: Tables) -> DataFrame:
    """Pages as posts: links for keywords, the first paragraph or repeated titles for descriptions."""
    html = F.col("html")
    rows = t.pages.select("page_id", "url", F.regexp_extract(html, "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract(html, "<p>([^<]*)", 1).alias("para"), F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1)).alias("keywords"))
    posts = rows.selectExpr("url AS slug", f"{TITLE} AS title", f"{DESCRIPTION} AS description", "keywords", "CASE WHEN page_id % 3 > 0 THEN page_id END AS modified")
    return audit.audit_posts(posts)


QUERIES, ORACLE_SQL = catalog.queries, catalog.sql
