"""Further queries: lookups with fallbacks, snapshots, classification, document writers as row transforms, edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import ordered as op
from ..operators import procedural
from ..operators import relational as rel
from .catalog import Catalog, Tables
from .ordered import PARAGRAPHS, typed

catalog = Catalog()
query = catalog.query


def pquery(sql: str | None):
    return catalog.query(PARAGRAPHS + sql if sql else None)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice > 100000 AND o_orderpriority IS NOT NULL AND o_custkey <> 7")
def p1_p3_p4_p5_predicates(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_orderstatus").isin("F", "P") & (F.col("o_totalprice") > 100000) & F.col("o_orderpriority").isNotNull() & (F.col("o_custkey") != 7)).select("o_orderkey")


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN false ELSE list_contains(CASE WHEN event_id % 3 = 0 THEN ['all'] ELSE [event_type, 'x'] END, 'all') OR list_contains(CASE WHEN event_id % 3 = 0 THEN ['all'] ELSE [event_type, 'x'] END, 'click') END AS blocked FROM events")
def p6_array_membership(t: Tables) -> DataFrame:
    types = F.when(F.col("event_id") % 4 != 0, F.when(F.col("event_id") % 3 == 0, F.array(F.lit("all"))).otherwise(F.array("event_type", F.lit("x"))))
    return t.events.select("event_id", F.coalesce(F.array_contains(types, "all") | F.array_contains(types, "click"), F.lit(False)).alias("blocked"))


@query("SELECT event_id, event_type FROM events WHERE user_id = 42")
def p7_row_security(t: Tables) -> DataFrame:
    t.events.where("user_id = 42").createOrReplaceTempView("own_events")
    return t.spark.table("own_events").select("event_id", "event_type")


@pquery("""SELECT a.doc_id, a.idx, coalesce(b.type, c.type, d.type) AS type FROM (SELECT doc_id, idx, CASE WHEN idx % 3 = 0 THEN left(text, 30) ELSE text END AS text FROM p) a
LEFT JOIN p b ON a.doc_id = b.doc_id AND a.idx = b.idx AND left(a.text, 40) = left(b.text, 40)
LEFT JOIN (SELECT doc_id, left(text, 80) AS k, min_by(type, idx) AS type FROM p GROUP BY 1, 2) c ON a.doc_id = c.doc_id AND left(a.text, 80) = c.k
LEFT JOIN (SELECT doc_id, regexp_replace(left(text, 30), '[0-9. ]+', '', 'g') AS k, min_by(type, idx) AS type FROM p GROUP BY 1, 2) d ON a.doc_id = d.doc_id AND regexp_replace(left(a.text, 30), '[0-9. ]+', '', 'g') = d.k""")
def j6_fallback_lookup(t: Tables) -> DataFrame:
    p = typed(t)
    text = F.when(F.col("idx") % 3 == 0, F.left("text", F.lit(30))).otherwise(F.col("text"))
    stripped = F.regexp_replace(F.left("text", F.lit(30)), "[0-9. ]+", "")
    a = p.select("doc_id", "idx", text.alias("text")).withColumns({"k1": F.left("text", F.lit(40)), "k2": F.left("text", F.lit(80)), "k3": stripped})
    first = p.select("doc_id", "idx", F.left("text", F.lit(40)).alias("k1"), F.col("type").alias("t1"))
    second = p.groupBy("doc_id", F.left("text", F.lit(80)).alias("k2")).agg(F.min_by("type", "idx").alias("t2"))
    third = p.groupBy("doc_id", stripped.alias("k3")).agg(F.min_by("type", "idx").alias("t3"))
    found = a.join(first, ["doc_id", "idx", "k1"], "left").join(second, ["doc_id", "k2"], "left").join(third, ["doc_id", "k3"], "left")
    return found.select("doc_id", "idx", F.coalesce("t1", "t2", "t3").alias("type"))


@query(None)
def j14_greedy_anchor_matching(t: Tables) -> DataFrame:
    p = typed(t)
    anchors = p.where("type = 'heading_2'").select("doc_id", "idx", F.left("text", F.lit(6)).alias("text"))
    return procedural.greedy_matches(anchors, p.where("type = 'body'").select("doc_id", "idx", "text"))


@query(None)
def t21_byte_budget_chunks(t: Tables) -> DataFrame:
    return procedural.byte_chunks(t.documents, 1000).select("doc_id", "part", F.octet_length("text").alias("bytes"))


#: The key of the signed tokens, padded as the two digests take it.
_PADS = ["".join(f"\\x{b ^ pad:02X}" for b in b"test key".ljust(64, b"\0")) for pad in (0x36, 0x5C)]


@query(f"SELECT c_custkey, c_mktsegment, sha256('{_PADS[1]}'::BLOB || unhex(sha256('{_PADS[0]}'::BLOB || encode(c_custkey || ':' || c_mktsegment)))) AS token FROM customer")
def t34_signed_tokens(t: Tables) -> DataFrame:
    return procedural.signed_tokens(t.customer.select("c_custkey", "c_mktsegment"), ["c_custkey", "c_mktsegment"], b"test key")


@query("""WITH RECURSIVE s AS (SELECT n_nationkey AS name, CASE WHEN n_nationkey > 0 THEN n_nationkey // 2 END AS parent, CASE WHEN n_nationkey IN (0, 3, 5) THEN n_name END AS value FROM nation),
r AS (SELECT name, parent, value FROM s UNION ALL SELECT r.name, s.parent, s.value FROM r JOIN s ON r.parent = s.name WHERE r.value IS NULL)
SELECT name, max(value) AS value FROM r GROUP BY 1""")
def n25_n26_inherited_values(t: Tables) -> DataFrame:
    key = F.col("n_nationkey")
    styles = t.nation.select(key.alias("name"), F.when(key > 0, F.floor(key / 2).cast("int")).alias("parent"), F.when(key.isin(0, 3, 5), F.col("n_name")).alias("value"))
    return procedural.inherited(styles)


@pquery("SELECT doc_id, idx, count(*) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS rows_near, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)::BIGINT AS chars_near FROM p")
def n20_context_radius(t: Tables) -> DataFrame:
    w = op.within().rowsBetween(-10, 10)
    return typed(t).select("doc_id", "idx", F.count("*").over(w).alias("rows_near"), F.sum(F.length("text")).over(w).alias("chars_near"))


@query("SELECT p_partkey FROM part WHERE p_size % 3 <> 0 QUALIFY row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) <= 4")
def k6_priority_available(t: Tables) -> DataFrame:
    return t.part.where("p_size % 3 <> 0").orderBy(F.desc("p_retailprice"), "p_partkey").limit(4).select("p_partkey")


@pquery("SELECT doc_id, idx FROM p QUALIFY type = 'body' AND row_number() OVER (PARTITION BY doc_id, type ORDER BY idx) <= 50")
def k9_sample_of_body(t: Tables) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("idx"))
    return typed(t).where("type = 'body'").withColumn("place", place).where("place <= 50").select("doc_id", "idx")


@pquery("SELECT doc_id, idx, 'long' AS rule FROM p WHERE length(text) > 500 UNION ALL SELECT doc_id, idx, 'empty' FROM p WHERE text = '' UNION ALL SELECT doc_id, idx, 'unknown' FROM p WHERE type = '' UNION ALL SELECT doc_id, idx, 'digits' FROM p WHERE regexp_matches(text, '[0-9]')")
def u5_union_of_violations(t: Tables) -> DataFrame:
    text, kind = F.col("text"), F.col("type")
    rules = F.array(F.when(F.length(text) > 500, "long"), F.when(text == "", "empty"), F.when(kind == "", "unknown"), F.when(text.rlike("[0-9]"), "digits"))
    return typed(t).select("doc_id", "idx", F.explode(F.array_compact(rules)).alias("rule"))


@pquery("SELECT doc_id, count(*) FILTER (type = 'heading_1') AS h1, CASE WHEN count(*) FILTER (type = 'heading_1') >= 3 AND count(*) FILTER (type = 'heading_2') > 0 THEN 'preserve' WHEN count(*) FILTER (type LIKE 'heading%') > 0 THEN 'heuristic' ELSE 'full' END AS route, CASE WHEN count(*) FILTER (type = 'heading_1') >= 3 AND count(*) FILTER (type = 'heading_2') > 0 THEN 1.0 WHEN count(*) FILTER (type LIKE 'heading%') > 0 THEN 0.5 ELSE 0.3 END::DOUBLE AS confidence FROM p GROUP BY 1")
def c5_structure_route(t: Tables) -> DataFrame:
    kind = F.col("type")
    g = typed(t).groupBy("doc_id").agg(F.count_if(kind == "heading_1").alias("h1"), F.count_if(kind == "heading_2").alias("h2"), F.count_if(kind.startswith("heading")).alias("h"))
    sure, some = (F.col("h1") >= 3) & (F.col("h2") > 0), F.col("h") > 0
    return g.select("doc_id", "h1", F.when(sure, "preserve").when(some, "heuristic").otherwise("full").alias("route"), F.when(sure, 1.0).when(some, 0.5).otherwise(0.3).alias("confidence"))


@query("SELECT c_custkey, CASE WHEN n >= 3 THEN 'full' WHEN n >= 1 THEN 'partial' ELSE 'blank' END AS tier FROM (SELECT c_custkey, (c_acctbal > 0)::INT + (c_custkey % 2 = 0)::INT + (c_nationkey > 10)::INT AS n FROM customer)")
def c6_filled_fields_tier(t: Tables) -> DataFrame:
    fields = F.array(F.when(F.col("c_acctbal") > 0, 1), F.when(F.col("c_custkey") % 2 == 0, 1), F.when(F.col("c_nationkey") > 10, 1))
    n = F.size(F.array_compact(fields))
    return t.customer.select("c_custkey", F.when(n >= 3, "full").when(n >= 1, "partial").otherwise("blank").alias("tier"))


@query("SELECT user_id, CASE WHEN max(ts) < TIMESTAMP '2024-01-01' + INTERVAL 29 DAY THEN 10 ELSE greatest(0, 10 - count(*) FILTER (event_type = 'click')) END AS quota FROM events GROUP BY 1")
def c8_lazy_quota_reset(t: Tables) -> DataFrame:
    stale = F.max("ts") < F.lit("2024-01-30").cast("timestamp_ntz")
    return t.events.groupBy("user_id").agg(F.when(stale, 10).otherwise(F.greatest(F.lit(0), 10 - F.count_if(F.col("event_type") == "click"))).alias("quota"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n, CASE WHEN l_linenumber = 1 THEN 'auto' WHEN l_linenumber <= 3 THEN 'suggest' ELSE 'manual' END AS plan FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2")
def c11_fix_plan(t: Tables) -> DataFrame:
    k = F.col("l_linenumber")
    return t.lineitem.where("l_returnflag = 'R'").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).withColumn("plan", F.when(k == 1, "auto").when(k <= 3, "suggest").otherwise("manual"))


@query("SELECT a.c_custkey, a.c_acctbal < 0 AND b.total > 0 AS fixed FROM customer a JOIN (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1) b ON c_custkey = o_custkey")
def c12_fixed_between_runs(t: Tables) -> DataFrame:
    after = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    return t.customer.join(after, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", ((F.col("c_acctbal") < 0) & (F.col("total") > 0)).alias("fixed"))


@query("SELECT p_partkey, coalesce(CASE WHEN p_size > 25 THEN p_size END, 12) AS size, coalesce(nullif(CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END, ''), 'default') AS brand FROM part")
def c14_default_overlay(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.coalesce(F.when(F.col("p_size") > 25, F.col("p_size")), F.lit(12)).alias("size"), rel.or_default(F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(F.lit("")), "default").alias("brand"))


@query("SELECT chunk, count(*) AS n, min(o_orderkey) AS first_key FROM (SELECT o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 1) // 2 AS chunk FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01') GROUP BY 1")
def s16_chunked_cleanup(t: Tables) -> DataFrame:
    old = t.orders.where(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return old.withColumn("chunk", F.ceil(place / 2)).groupBy("chunk").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


@query("SELECT '<item><title>' || replace(replace(p_name, '&', '&amp;'), '<', '&lt;') || '</title><guid>' || p_partkey || '</guid></item>' AS item FROM part WHERE p_size = 10")
def s17_feed_items(t: Tables) -> DataFrame:
    name = F.replace(F.replace("p_name", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return t.part.where("p_size = 10").select(F.concat(F.lit("<item><title>"), name, F.lit("</title><guid>"), F.col("p_partkey"), F.lit("</guid></item>")).alias("item"))


@query("SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'customer', count(*) FROM customer")
def s18_s19_table_sizes(t: Tables) -> DataFrame:
    sizes = [getattr(t, n).agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in ("orders", "events", "customer")]
    return sizes[0].unionByName(sizes[1]).unionByName(sizes[2])


@query("SELECT page_id, url FROM pages WHERE url LIKE 'http://%.com/%' AND page_id < 200")
def s20_listing_function(t: Tables) -> DataFrame:
    def listing(host_end: str, cutoff: int) -> DataFrame:
        return t.pages.where(F.col("url").like(f"http://%{host_end}/%") & (F.col("page_id") < cutoff)).select("page_id", "url")

    return listing(".com", 200)


@query("SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN event_type END, props) AS filled FROM events")
def w6_guarded_backfill(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.coalesce(F.when(F.col("event_id") % 3 == 0, F.col("event_type")), F.col("props")).alias("filled"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '2001-06-01' - INTERVAL 30 MINUTE THEN 'failed' ELSE o_orderstatus END AS status, TIMESTAMP '2001-06-01' AS updated_at FROM orders")
def w7_w9_fail_stuck(t: Tables) -> DataFrame:
    now = F.lit("2001-06-01").cast("timestamp_ntz")
    stuck = (F.col("o_orderstatus") == "P") & (F.col("o_orderdate") < now - F.expr("INTERVAL 30 MINUTES"))
    return t.orders.select("o_orderkey", F.when(stuck, "failed").otherwise(F.col("o_orderstatus")).alias("status"), now.alias("updated_at"))


@query("SELECT c_custkey, c_custkey % 2 = 0 AS is_new FROM customer")
def w10_child_rows(t: Tables) -> DataFrame:
    have = t.customer.where("c_custkey % 2 <> 0").select("c_custkey", F.lit(False).alias("is_new"))
    return rel.insert_if_absent(have, t.customer.select("c_custkey", F.lit(True).alias("is_new")), ["c_custkey"], F.col("c_custkey"))


@query("SELECT c_custkey, string_split(c_name, '#')[2] || ' ' || left(c_mktsegment, 1) || '.' AS author FROM customer")
def t12_author_names(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.concat(F.element_at(F.split("c_name", "#"), -1), F.lit(" "), F.left("c_mktsegment", F.lit(1)), F.lit(".")).alias("author"))


@query("SELECT page_id, coalesce(nullif(regexp_extract(url, 'ref=(\\w+)', 1), ''), nullif(regexp_extract(url, 'page=(\\d+)', 1), ''), url) AS link FROM pages")
def t13_fallback_links(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.coalesce(F.nullif(F.regexp_extract("url", r"ref=(\w+)", 1), F.lit("")), F.nullif(F.regexp_extract("url", r"page=(\d+)", 1), F.lit("")), F.col("url")).alias("link"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_name || '. ' || p_brand || '.' WHEN 1 THEN p_name || ' // ' || p_brand || '. No. ' || p_size ELSE p_name || ' [online]' END AS citation FROM part")
def t11_citations(t: Tables) -> DataFrame:
    k = F.col("p_size") % 3
    return t.part.select("p_partkey", F.when(k == 0, F.concat("p_name", F.lit(". "), "p_brand", F.lit("."))).when(k == 1, F.concat("p_name", F.lit(" // "), "p_brand", F.lit(". No. "), "p_size")).otherwise(F.concat("p_name", F.lit(" [online]"))).alias("citation"))


@query("SELECT o_orderkey, count(*) AS cols, sum(l_quantity)::DOUBLE AS width, CASE WHEN count(*) > 6 OR sum(l_quantity) > 150 THEN 'landscape' WHEN count(*) > 3 THEN 'complex' ELSE 'simple' END AS route FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def t26_t27_table_routes(t: Tables) -> DataFrame:
    g = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey").agg(F.count("*").alias("cols"), F.sum("l_quantity").alias("width"))
    return g.withColumn("route", F.when((F.col("cols") > 6) | (F.col("width") > 150), "landscape").when(F.col("cols") > 3, "complex").otherwise("simple"))


@pquery("SELECT doc_id, min_by(text, idx) FILTER (length(text) > 40) AS title, min(idx) FILTER (regexp_matches(text, '[0-9]{4}')) AS year_at FROM p WHERE idx < 15 GROUP BY 1")
def t31_title_fields(t: Tables) -> DataFrame:
    head = typed(t).where("idx < 15")
    long = F.when(F.length("text") > 40, F.col("idx"))
    return head.groupBy("doc_id").agg(F.min_by("text", long).alias("title"), F.min(F.when(F.col("text").rlike("[0-9]{4}"), F.col("idx"))).alias("year_at"))


@pquery("SELECT doc_id, idx, CASE WHEN type = 'body' THEN 'both' WHEN type LIKE 'heading%' THEN 'center' ELSE 'left' END AS alignment, CASE WHEN type = 'body' THEN 709 ELSE 0 END AS indent, (CASE WHEN idx % 4 = 0 THEN 'single' END IS NOT NULL) AND type <> 'table' AS underline_removed FROM p")
def d1_d4_paragraph_properties(t: Tables) -> DataFrame:
    kind = F.col("type")
    return typed(t).select("doc_id", "idx", F.when(kind == "body", "both").when(kind.startswith("heading"), "center").otherwise("left").alias("alignment"), F.when(kind == "body", 709).otherwise(0).alias("indent"), ((F.col("idx") % 4 == 0) & (kind != "table")).alias("underline_removed"))


@pquery("SELECT t.doc_id, t.idx, n.n + row_number() OVER (PARTITION BY t.doc_id ORDER BY t.idx) AS caption_no FROM p t JOIN (SELECT doc_id, count(*) FILTER (type = 'caption') AS n FROM p GROUP BY 1) n USING (doc_id) WHERE t.type = 'table' AND NOT EXISTS (SELECT 1 FROM p c WHERE c.doc_id = t.doc_id AND c.type = 'caption' AND abs(c.idx - t.idx) <= 3)")
def d15_new_captions(t: Tables) -> DataFrame:
    caption = F.col("type") == "caption"
    p = typed(t).withColumn("near", op.near(caption, 3, 3)).withColumn("n", F.sum(caption.cast("long")).over(op.whole())).where("type = 'table' and not near")
    return p.select("doc_id", "idx", (F.col("n") + F.row_number().over(op.within())).cast("long").alias("caption_no"))


@pquery("SELECT doc_id, idx FROM (SELECT *, min(CASE WHEN type = 'heading_1' THEN idx END) OVER (PARTITION BY doc_id) AS cut FROM p) WHERE idx < coalesce(cut, 1000000)")
def d19_title_block(t: Tables) -> DataFrame:
    cut = F.min(F.when(F.col("type") == "heading_1", F.col("idx"))).over(op.whole())
    return typed(t).withColumn("cut", cut).where("cut is null or idx < cut").select("doc_id", "idx")


@pquery("SELECT d.doc_id, e.kind AS missing FROM (SELECT DISTINCT doc_id FROM p) d CROSS JOIN (SELECT unnest(['heading_1', 'list', 'caption', 'table', 'bibliography_title']) AS kind) e WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id = d.doc_id AND p.type = e.kind)")
def d13_missing_sections(t: Tables) -> DataFrame:
    expected = F.array(*map(F.lit, ("heading_1", "list", "caption", "table", "bibliography_title")))
    return typed(t).groupBy("doc_id").agg(F.collect_set("type").alias("have")).select("doc_id", F.explode(F.array_except(expected, F.col("have"))).alias("missing"))


@pquery("SELECT doc_id, count(*) FILTER (type LIKE 'heading%' AND length(text) > 100) AS headings_changed, count(*) FILTER (type = 'body' AND length(text) < 100) AS bodies_changed FROM p GROUP BY 1")
def d17_change_counters(t: Tables) -> DataFrame:
    kind, n = F.col("type"), F.length("text")
    return typed(t).groupBy("doc_id").agg(F.count_if(kind.startswith("heading") & (n > 100)).alias("headings_changed"), F.count_if((kind == "body") & (n < 100)).alias("bodies_changed"))


@query("SELECT doc_id, md5(string_agg(CASE WHEN k % 5 = 0 THEN '<' || w || '>' ELSE w END, ' ' ORDER BY k)) AS edited FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, unnest(range(0, len(string_split(text, ' ')))) AS k FROM documents) GROUP BY 1")
def x1_apply_replacements(t: Tables) -> DataFrame:
    edited = F.transform(F.split("text", " "), lambda w, k: F.when(k % 5 == 0, F.concat(F.lit("<"), w, F.lit(">"))).otherwise(w))
    return t.documents.select("doc_id", F.md5(F.array_join(edited, " ")).alias("edited"))


@query("SELECT CASE WHEN event_type IN ('click', 'view') THEN 'reading' ELSE 'acting' END AS label, count(*) AS n FROM events GROUP BY 1")
def x2_merged_labels(t: Tables) -> DataFrame:
    return t.events.groupBy(F.when(F.col("event_type").isin("click", "view"), "reading").otherwise("acting").alias("label")).agg(F.count("*").alias("n"))


@query("SELECT user_id, event_id, event_id + 1 AS gap_start, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS gap_end FROM events QUALIFY gap_end > event_id + 1")
def x3_plain_gaps(t: Tables) -> DataFrame:
    after = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    return t.events.select("user_id", "event_id", (F.col("event_id") + 1).alias("gap_start"), after.alias("gap_end")).where("gap_end > event_id + 1")


@query("SELECT o_custkey, count(*) - least(count(*), 5) AS remaining FROM orders GROUP BY 1")
def x4_remaining_total(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg((F.count("*") - F.least(F.count("*"), F.lit(5))).alias("remaining"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def x5_selected_ids(t: Tables) -> DataFrame:
    chosen = t.nation.where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    return t.supplier.join(chosen, "s_nationkey", "left_semi").select("s_suppkey", "s_name")


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'P' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) <= 2 UNION ALL SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 3 < 1")
def r5_batch_then_retries(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    new = t.orders.where("o_orderstatus = 'P'").withColumn("rn", F.row_number().over(w)).where("rn <= 2").select("o_custkey", "o_orderkey")
    return new.unionByName(t.orders.where("o_orderstatus = 'O' and o_orderkey % 3 < 1").select("o_custkey", "o_orderkey"))


@query("SELECT user_id, CASE max(CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'error' THEN 1 ELSE 0 END) WHEN 3 THEN 'completed' WHEN 2 THEN 'pending' WHEN 1 THEN 'failed' ELSE 'none' END AS state, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1")
def r10_webhook_state(t: Tables) -> DataFrame:
    rank = F.max(F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "error", 1).otherwise(0))
    g = t.events.groupBy("user_id").agg(rank.alias("rank"), F.count_distinct("event_type").alias("kinds"))
    return g.select("user_id", F.element_at(F.array(*map(F.lit, ("none", "failed", "pending", "completed"))), (F.col("rank") + 1).cast("int")).alias("state"), "kinds")


QUERIES, ORACLE_SQL = catalog.queries, catalog.sql
