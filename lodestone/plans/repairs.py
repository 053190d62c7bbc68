"""Queries for markup repair, caption and reference normalisation, section detection and document writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import folds, ordered as op
from ..operators import procedural
from .catalog import Catalog, Tables
from .ordered import PARAGRAPHS, typed

catalog = Catalog()
query = catalog.query


def pquery(sql: str):
    return catalog.query(PARAGRAPHS + sql)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 7")
def s1_s3_point_lookup(t: Tables) -> DataFrame:
    return t.customer.where("c_custkey = 7").select("c_custkey", "c_name", "c_acctbal")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY o_orderdate = max(o_orderdate) OVER ()")
def s14_latest_snapshot(t: Tables) -> DataFrame:
    latest = t.orders.agg(F.max("o_orderdate").alias("o_orderdate"))
    return t.orders.join(F.broadcast(latest), "o_orderdate").select("o_custkey", "o_orderkey")


@query("SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 20")
def a28_seeded_sample(t: Tables) -> DataFrame:
    return t.documents.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(20).select("doc_id")


@query("SELECT doc_id, md5(CASE WHEN lang = 'en' THEN replace(text, ' and ', ' & ') WHEN lang = 'de' THEN replace(text, ' und ', ' u. ') ELSE text END) AS fixed FROM documents")
def t10_language_conditional_repair(t: Tables) -> DataFrame:
    x = F.col("text")
    fixed = F.when(F.col("lang") == "en", F.replace(x, F.lit(" and "), F.lit(" & "))).when(F.col("lang") == "de", F.replace(x, F.lit(" und "), F.lit(" u. "))).otherwise(x)
    return t.documents.select("doc_id", F.md5(fixed).alias("fixed"))


@pquery(r"SELECT doc_id, idx, regexp_replace('fig.  ' || idx || ' - ' || text, '^(?i:fig(?:ure)?\.?)\s*([0-9]+)\s*[-–—:.]\s*', 'Figure \1 – ') AS caption FROM p WHERE type = 'caption'")
def t17_caption_prefix(t: Tables) -> DataFrame:
    raw = F.concat(F.lit("fig.  "), "idx", F.lit(" - "), "text")
    fixed = F.regexp_replace(raw, r"^(?i:fig(?:ure)?\.?)\s*([0-9]+)\s*[-–—:.]\s*", "Figure $1 – ")
    return typed(t).where("type = 'caption'").select("doc_id", "idx", fixed.alias("caption"))


@pquery(r"""SELECT doc_id, idx, md5(regexp_replace(regexp_replace(replace(text, ' ', ' рис. 1 барис 2 Табл 3 '), '(^|[^\p{L}])([Рр])ис\.?\s*([0-9])', '\1\2исунок \3', 'g'), '(^|[^\p{L}])([Тт])абл\.?\s*([0-9])', '\1\2аблица \3', 'g')) AS fixed FROM p WHERE type = 'body'""")
def t18_reference_abbreviations(t: Tables) -> DataFrame:
    raw = F.replace(F.col("text"), F.lit(" "), F.lit(" рис. 1 барис 2 Табл 3 "))
    return typed(t).where("type = 'body'").select("doc_id", "idx", F.md5(folds.full_references(raw)).alias("fixed"))


@pquery("SELECT doc_id, idx, CASE WHEN lag(t) OVER w LIKE '% ' THEN ltrim(t, ' ') ELSE t END AS run FROM (SELECT doc_id, idx, text || CASE WHEN idx % 2 = 0 THEN ' ' ELSE '' END AS t0, CASE WHEN idx % 3 = 0 THEN ' ' ELSE '' END || text || CASE WHEN idx % 2 = 0 THEN ' ' ELSE '' END AS t FROM p) WINDOW w AS (PARTITION BY doc_id ORDER BY idx)")
def t9_d3_cross_run_spaces(t: Tables) -> DataFrame:
    run = F.concat(F.when(F.col("idx") % 3 == 0, " ").otherwise(""), F.col("text"), F.when(F.col("idx") % 2 == 0, " ").otherwise(""))
    p = typed(t).select("doc_id", "idx", run.alias("t")).withColumn("before", F.lag("t").over(op.within()))
    return p.select("doc_id", "idx", F.when(F.col("before").endswith(" "), F.ltrim("t")).otherwise(F.col("t")).alias("run"))


@pquery(r"SELECT doc_id, idx, regexp_replace(regexp_replace(regexp_replace('##' || text || '__ \_x', '^(#+)([^# ])', '\1 \2'), '__', '', 'g'), '\\_', '_', 'g') AS fixed FROM p WHERE type LIKE 'heading%'")
def t29_markdown_repair(t: Tables) -> DataFrame:
    x = F.concat(F.lit("##"), F.col("text"), F.lit(r"__ \_x"))
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "^(#+)([^# ])", "$1 $2"), "__", ""), r"\\_", "_")
    return typed(t).where(F.col("type").startswith("heading")).select("doc_id", "idx", x.alias("fixed"))


@pquery("SELECT doc_id, idx, CASE WHEN upper(text) = text AND length(text) > 3 THEN 1 WHEN prev = '' AND length(text) < 60 THEN 2 END AS level FROM (SELECT *, lag(type) OVER (PARTITION BY doc_id ORDER BY idx) AS prev FROM p)")
def t30_heading_promotion(t: Tables) -> DataFrame:
    p = typed(t).withColumn("prev", F.lag("type").over(op.within()))
    caps = (F.upper("text") == F.col("text")) & (F.length("text") > 3)
    return p.select("doc_id", "idx", F.when(caps, 1).when((F.col("prev") == "") & (F.length("text") < 60), 2).alias("level"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'pending' ELSE 'status ' || o_orderstatus END AS label FROM orders")
def t32_labels(t: Tables) -> DataFrame:
    labels = F.create_map(F.lit("F"), F.lit("completed"), F.lit("P"), F.lit("pending"))
    return t.orders.select("o_orderkey", F.coalesce(F.try_element_at(labels, F.col("o_orderstatus")), F.concat(F.lit("status "), "o_orderstatus")).alias("label"))


@query("SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY lower(c_mktsegment), c_custkey) AS place FROM customer")
def k4_collated_order(t: Tables) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy(F.collate("c_mktsegment", "UNICODE_CI_AI"), "c_custkey")
    return t.customer.select("c_custkey", F.row_number().over(w).cast("long").alias("place"))


@pquery("SELECT doc_id, kind, min(idx) FILTER (type = kind) AS exact_at, coalesce(min(idx) FILTER (type = kind), min(idx) FILTER (starts_with(type, left(kind, 4)))) AS at FROM p CROSS JOIN (SELECT unnest(['heading_1', 'caption', 'bibliography_entry']) AS kind) GROUP BY 1, 2")
def j16_section_tiers(t: Tables) -> DataFrame:
    kinds = F.explode(F.array(*map(F.lit, ("heading_1", "caption", "bibliography_entry"))))
    exact = F.when(F.col("type") == F.col("kind"), F.col("idx"))
    loose = F.when(F.startswith(F.col("type"), F.left("kind", F.lit(4))), F.col("idx"))
    return typed(t).select("doc_id", "idx", "type", kinds.alias("kind")).groupBy("doc_id", "kind").agg(F.min(exact).alias("exact_at"), F.coalesce(F.min(exact), F.min(loose)).alias("at"))


@pquery("SELECT doc_id, min(idx) AS first_idx, count(*) AS merged FROM (SELECT *, sum(CASE WHEN type = 'list' AND coalesce(prev, '') = 'list' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, lag(type) OVER (PARTITION BY doc_id ORDER BY idx) AS prev FROM p WHERE type <> '')) GROUP BY doc_id, i HAVING count(*) > 1")
def n11_merged_lines(t: Tables) -> DataFrame:
    p = typed(t).where("type <> ''").withColumn("prev", F.coalesce(F.lag("type").over(op.within()), F.lit("")))
    continues = (F.col("type") == "list") & (F.col("prev") == "list")
    return p.withColumn("i", op.island(~continues, op.so_far())).groupBy("doc_id", "i").agg(F.min("idx").alias("first_idx"), F.count("*").alias("merged")).where("merged > 1").select("doc_id", "first_idx", "merged")


@pquery("SELECT p.doc_id, p.idx, s.size, s.bold FROM p JOIN (VALUES ('heading_1', 16, true), ('heading_2', 14, true), ('body', 14, false)) s(type, size, bold) USING (type)")
def d2_d6_styles_by_type(t: Tables) -> DataFrame:
    styles = t.spark.createDataFrame([("heading_1", 16, True), ("heading_2", 14, True), ("body", 14, False)], "type string, size int, bold boolean")
    return typed(t).join(F.broadcast(styles), "type").select("doc_id", "idx", "size", "bold")


@pquery("SELECT doc_id, idx, CASE WHEN a = 'caption' THEN idx - 1 WHEN a = '' AND b = 'caption' THEN idx - 2 WHEN a = '' AND b = '' AND c = 'caption' THEN idx - 3 ELSE idx END AS section_start FROM (SELECT *, lag(type, 1) OVER w AS a, lag(type, 2) OVER w AS b, lag(type, 3) OVER w AS c FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY idx)) WHERE type = 'table'")
def d8_landscape_lookback(t: Tables) -> DataFrame:
    a, b, c = (F.lag("type", k).over(op.within()) for k in (1, 2, 3))
    p = typed(t).withColumns({"a": a, "b": b, "c": c}).where("type = 'table'")
    a, b, c, i = F.col("a"), F.col("b"), F.col("c"), F.col("idx")
    start = F.when(a == "caption", i - 1).when((a == "") & (b == "caption"), i - 2).when((a == "") & (b == "") & (c == "caption"), i - 3).otherwise(i)
    return p.select("doc_id", "idx", start.alias("section_start"))


@pquery("SELECT doc_id, count(*) FILTER (type = 'table' AND regexp_matches(text, '[0-9]')) AS numbered, count(*) FILTER (type = 'table') AS tables FROM p GROUP BY 1 HAVING count(*) FILTER (type = 'table' AND regexp_matches(text, '[0-9]')) >= 1")
def d7_d11_numbered_tables(t: Tables) -> DataFrame:
    table = F.col("type") == "table"
    return typed(t).groupBy("doc_id").agg(F.count_if(table & F.col("text").rlike("[0-9]")).alias("numbered"), F.count_if(table).alias("tables")).where("numbered >= 1")


@pquery("SELECT doc_id, string_agg(repeat('  ', level - 1) || text, chr(10) ORDER BY idx) AS toc FROM (SELECT *, CASE type WHEN 'heading_1' THEN 1 ELSE 2 END AS level FROM p WHERE type LIKE 'heading%') GROUP BY 1")
def d12_static_contents(t: Tables) -> DataFrame:
    headings = typed(t).where(F.col("type").startswith("heading"))
    level = F.when(F.col("type") == "heading_1", 1).otherwise(2)
    item = F.struct("idx", F.concat(F.repeat(F.lit("  "), level - 1), F.col("text")).alias("s"))
    return headings.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["s"]), "\n").alias("toc"))


@query(None)
def t23_pseudonyms(t: Tables) -> DataFrame:
    return procedural.pseudonyms(t.documents).select("doc_id", F.length("text").alias("chars"), F.md5("text").alias("digest"))


@query(None)
def t8_edited_runs(t: Tables) -> DataFrame:
    """The whole text in three runs of a third each, edited in one place; by doc_id even or odd the length changes or not."""
    third = F.ceil(F.length("text") / 3).cast("int")
    runs = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.substring(F.col("text"), k * third + 1, third))
    fixed = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit(" the "), F.lit(" THE THE "))).otherwise(F.upper("text"))
    edits = t.documents.where("text is not null").select("doc_id", runs.alias("runs"), fixed.alias("fixed"))
    return procedural.redistribute(edits).select("doc_id", F.transform("runs", lambda r: F.md5(r)).alias("runs"))


QUERIES, ORACLE_SQL = catalog.queries, catalog.sql
