"""Queries over ordered paragraphs: the lines of ``documents``, with block types dealt deterministically.

The corpus has no headings, so a paragraph's type follows from its place and length; the same rule stands in the SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import ordered as op
from ..sources.tables import paragraphs
from .catalog import Catalog, Tables

catalog = Catalog()

#: Block types by (7 * doc_id + 13 * idx) % 12.
TYPES = ["heading_1", "body", "body", "heading_2", "list", "list", "", "", "", "bibliography_title", "caption", "table"]

PARAGRAPHS = """WITH p0 AS (SELECT doc_id, CAST(unnest(range(0, len(string_split(text, chr(10))))) AS INT) AS idx, unnest(string_split(text, chr(10))) AS text FROM documents),
p AS (SELECT *, (['heading_1', 'body', 'body', 'heading_2', 'list', 'list', '', '', '', 'bibliography_title', 'caption', 'table'])[CAST((7 * doc_id + 13 * idx) % 12 + 1 AS INT)] AS type FROM p0)
"""


def query(sql: str):
    return catalog.query(PARAGRAPHS + sql)


def typed(t: Tables) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, TYPES)), ((7 * F.col("doc_id") + 13 * F.col("idx")) % 12 + 1).cast("int"))
    return paragraphs(t.documents).withColumn("type", kind)



@query("SELECT doc_id, idx, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS place, count(*) OVER (PARTITION BY doc_id) AS candidates FROM (SELECT *, min(CASE WHEN type IN ('heading_1', 'bibliography_title') THEN idx END) OVER (PARTITION BY doc_id) AS first FROM p) WHERE idx < coalesce(first, 10) AND idx < 10")
def n5_title_page(t: Tables) -> DataFrame:
    first = F.min(F.when(F.col("type").isin("heading_1", "bibliography_title"), F.col("idx"))).over(op.whole())
    found = typed(t).withColumn("first", first).where((F.col("idx") < F.coalesce("first", F.lit(10))) & (F.col("idx") < 10))
    return found.select("doc_id", "idx", F.row_number().over(op.within()).cast("long").alias("place"), F.count("*").over(op.whole()).alias("candidates"))


@query("""SELECT doc_id, idx, CASE level WHEN 1 THEN n1::VARCHAR WHEN 2 THEN n1 || '.' || n2 ELSE n1 || '.' || n2 || '.' || n3 END AS number FROM (
SELECT *, count(*) FILTER (level = 1) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS n1, count(*) FILTER (level = 2) OVER (PARTITION BY doc_id, g2 ORDER BY idx ROWS UNBOUNDED PRECEDING) AS n2, count(*) FILTER (level = 3) OVER (PARTITION BY doc_id, g3 ORDER BY idx ROWS UNBOUNDED PRECEDING) AS n3 FROM (
SELECT *, count(*) FILTER (level < 2) OVER w AS g2, count(*) FILTER (level < 3) OVER w AS g3 FROM (SELECT *, CASE type WHEN 'heading_1' THEN 1 WHEN 'heading_2' THEN 2 WHEN 'caption' THEN 3 END AS level FROM p) WINDOW w AS (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING))) WHERE level IS NOT NULL""")
def n6_hierarchical_numbers(t: Tables) -> DataFrame:
    kind = F.col("type")
    level = F.when(kind == "heading_1", 1).when(kind == "heading_2", 2).when(kind == "caption", 3)
    return op.number_headings(typed(t).withColumn("level", level), "level").where("level is not null").select("doc_id", "idx", "number")


@query("SELECT doc_id, old, max_by(new, idx) AS new FROM (SELECT doc_id, idx, idx % 3 AS old, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS new FROM p WHERE type = 'caption') GROUP BY 1, 2")
def n7_caption_renumbering(t: Tables) -> DataFrame:
    captions = typed(t).where("type = 'caption'").select("doc_id", "idx", (F.col("idx") % 3).alias("old"), F.row_number().over(op.within()).cast("long").alias("new"))
    return captions.groupBy("doc_id", "old").agg(F.max_by("new", "idx").alias("new"))


@query("SELECT doc_id, 9000 + dense_rank() OVER (PARTITION BY doc_id ORDER BY i) AS list_id, count(*) AS items, min(idx) AS first_idx FROM (SELECT *, sum(CASE WHEN type <> 'list' OR coalesce(prev, '') <> 'list' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, lag(type) OVER (PARTITION BY doc_id ORDER BY idx) AS prev FROM p)) WHERE type = 'list' GROUP BY doc_id, i")
def n8_list_islands(t: Tables) -> DataFrame:
    p = typed(t).withColumn("prev", F.coalesce(F.lag("type").over(op.within()), F.lit("")))
    p = p.withColumn("i", op.island((F.col("type") != "list") | (F.col("prev") != "list"), op.so_far())).where("type = 'list'")
    lists = p.groupBy("doc_id", "i").agg(F.count("*").alias("items"), F.min("idx").alias("first_idx"))
    return lists.select("doc_id", (9000 + F.dense_rank().over(Window.partitionBy("doc_id").orderBy("i"))).cast("long").alias("list_id"), "items", "first_idx")


@query("SELECT doc_id, coalesce(max(idx) FILTER (type = 'bibliography_title' AND idx >= 0.4 * n), min(idx) FILTER (length(text) > 100)) AS start FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM p) GROUP BY 1")
def n9_bibliography_start(t: Tables) -> DataFrame:
    p = typed(t).withColumn("n", F.count("*").over(op.whole()))
    late = F.max(F.when((F.col("type") == "bibliography_title") & (F.col("idx") >= 0.4 * F.col("n")), F.col("idx")))
    return p.groupBy("doc_id").agg(F.coalesce(late, F.min(F.when(F.length("text") > 100, F.col("idx")))).alias("start"))


@query("SELECT doc_id, idx FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, i, e ORDER BY idx) AS rn, first_value(CASE WHEN NOT e THEN type = 'heading_1' END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM (SELECT *, sum(CASE WHEN e THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, type IN ('', 'list') AS e FROM p))) WHERE NOT e OR rn <= 2 OR coalesce(nxt, false)")
def n10_collapse_empty_runs(t: Tables) -> DataFrame:
    return op.collapse_runs(typed(t), F.col("type").isin("", "list"), 2, F.col("type") == "heading_1").select("doc_id", "idx")


@query("SELECT doc_id, idx FROM (SELECT *, lead(type, 1) OVER w AS a, lead(type, 2) OVER w AS b FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY idx)) WHERE type = 'table' AND (a LIKE 'heading%' OR b LIKE 'heading%')")
def n12_redundant_breaks(t: Tables) -> DataFrame:
    heading = F.col("type").startswith("heading")
    ahead = F.coalesce(F.lead(heading, 1).over(op.within()), F.lit(False)) | F.coalesce(F.lead(heading, 2).over(op.within()), F.lit(False))
    return typed(t).withColumn("ahead", ahead).where("type = 'table' and ahead").select("doc_id", "idx")


@query("SELECT doc_id, idx FROM (SELECT *, coalesce(last_value(CASE WHEN type = 'heading_1' THEN true WHEN type NOT IN ('', 'list') THEN false END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING), false) AS inside FROM p) WHERE NOT (type = 'heading_1' OR (type IN ('', 'list') AND inside))")
def n13_strip_contents(t: Tables) -> DataFrame:
    return op.strip_contents(typed(t), F.col("type") == "heading_1", F.col("type").isin("", "list")).select("doc_id", "idx")


@query("SELECT doc_id, idx FROM (SELECT *, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS s FROM p) WHERE s <= 1500 OR idx = 0")
def n14_prefix_cut(t: Tables) -> DataFrame:
    return op.prefix_within(typed(t), F.length("text"), 1500).select("doc_id", "idx")


@query("SELECT doc_id, section, count(*) AS n, string_agg(idx::VARCHAR, ',' ORDER BY idx) AS members FROM (SELECT *, count(*) FILTER (type LIKE 'heading%') OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS section FROM p) WHERE section > 0 GROUP BY 1, 2")
def n15_section_rows(t: Tables) -> DataFrame:
    p = typed(t).withColumn("section", op.island(F.col("type").startswith("heading"), op.so_far())).where("section > 0")
    return p.groupBy("doc_id", "section").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("idx")), lambda i: i.cast("string")), ",").alias("members"))


@query("SELECT doc_id, idx, (count(*) FILTER (type = 'table') OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING)) % 2 = 1 OR type = 'table' AS frozen FROM p")
def n16_fence_slots(t: Tables) -> DataFrame:
    fence = F.col("type") == "table"
    return typed(t).select("doc_id", "idx", ((op.island(fence, op.so_far()) % 2 == 1) | fence).alias("frozen"))


@query("SELECT doc_id, idx FROM (SELECT *, lag(type) OVER (PARTITION BY doc_id ORDER BY idx) AS prev FROM p WHERE type LIKE 'heading%') WHERE prev IS NULL OR prev <> type")
def n17_consecutive_dedup(t: Tables) -> DataFrame:
    headings = typed(t).where(F.col("type").startswith("heading")).withColumn("prev", F.lag("type").over(op.within()))
    return headings.where("prev is null or prev <> type").select("doc_id", "idx")


@query("SELECT doc_id, idx, list(type) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS context FROM p WHERE idx > 0")
def n19_overlap_context(t: Tables) -> DataFrame:
    p = typed(t).where("idx > 0")
    context = F.collect_list("type").over(op.within().rowsBetween(-5, -1))
    return p.withColumn("context", context).select("doc_id", "idx", F.when(F.size("context") > 0, F.col("context")).alias("context"))


@query("SELECT doc_id, min(idx) AS cut FROM p WHERE type = 'heading_1' OR (idx > 2 AND length(text) > 200) GROUP BY 1")
def n21_boundary_cut(t: Tables) -> DataFrame:
    return typed(t).where((F.col("type") == "heading_1") | ((F.col("idx") > 2) & (F.length("text") > 200))).groupBy("doc_id").agg(F.min("idx").alias("cut"))


@query("SELECT doc_id, type, min(idx) AS page FROM p WHERE idx >= 3 AND type LIKE 'heading%' GROUP BY 1, 2")
def n23_first_page_of_heading(t: Tables) -> DataFrame:
    return typed(t).where((F.col("idx") >= 3) & F.col("type").startswith("heading")).groupBy("doc_id", "type").agg(F.min("idx").alias("page"))


@query("SELECT doc_id, idx FROM (SELECT *, count(*) FILTER (type LIKE 'heading%') OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS s, count(*) FILTER (type LIKE 'heading%') OVER (PARTITION BY doc_id) AS n FROM p) WHERE s <= greatest(1, ceil(n * 0.5))")
def n24_outline_half(t: Tables) -> DataFrame:
    heading = F.col("type").startswith("heading")
    p = typed(t).withColumn("s", op.island(heading, op.so_far())).withColumn("n", F.sum(heading.cast("long")).over(op.whole()))
    return p.where(F.col("s") <= F.greatest(F.lit(1), F.ceil(F.col("n") * 0.5))).select("doc_id", "idx")


@query("SELECT doc_id, idx FROM p t WHERE type = 'table' AND NOT EXISTS (SELECT 1 FROM p c WHERE c.doc_id = t.doc_id AND c.type = 'caption' AND abs(c.idx - t.idx) <= 3)")
def j11_missing_captions(t: Tables) -> DataFrame:
    return typed(t).withColumn("captioned", op.near(F.col("type") == "caption", 3, 3)).where("type = 'table' and not captioned").select("doc_id", "idx")


@query("SELECT doc_id, idx, last_value(CASE WHEN type = 'body' THEN idx END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anchor FROM p QUALIFY type = 'table'")
def j12_preceding_anchor(t: Tables) -> DataFrame:
    anchor = F.last(F.when(F.col("type") == "body", F.col("idx")), ignorenulls=True).over(op.before())
    return typed(t).withColumn("anchor", anchor).where("type = 'table'").select("doc_id", "idx", "anchor")


@query("SELECT doc_id, idx, last_value(CASE WHEN type LIKE 'heading%' THEN idx END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS heading FROM p")
def j13_nearest_heading(t: Tables) -> DataFrame:
    return typed(t).select("doc_id", "idx", F.last(F.when(F.col("type").startswith("heading"), F.col("idx")), ignorenulls=True).over(op.so_far()).alias("heading"))


@query("SELECT a.doc_id, a.idx, b.idx AS twin FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY idx) AS k FROM p WHERE idx % 2 = 0) a LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY idx) AS k FROM p WHERE idx % 2 = 1) b ON a.doc_id = b.doc_id AND a.text = b.text AND a.k = b.k")
def j15_duplicate_aware_match(t: Tables) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("doc_id", "text").orderBy("idx"))
    even, odd = (typed(t).where(F.col("idx") % 2 == side).withColumn("k", k) for side in (0, 1))
    return even.select("doc_id", "text", "k", "idx").join(odd.select("doc_id", "text", "k", F.col("idx").alias("twin")), ["doc_id", "text", "k"], "left").select("doc_id", "idx", "twin")


@query("SELECT p.doc_id, p.idx, s.idx AS section FROM p JOIN (SELECT doc_id, idx, lead(idx) OVER (PARTITION BY doc_id ORDER BY idx) AS nxt FROM p WHERE type = 'heading_1') s ON p.doc_id = s.doc_id AND p.idx >= s.idx AND p.idx < coalesce(s.nxt, 1000000)")
def j17_interval_containment(t: Tables) -> DataFrame:
    start = F.last(F.when(F.col("type") == "heading_1", F.col("idx")), ignorenulls=True).over(op.so_far())
    return typed(t).select("doc_id", "idx", start.alias("section")).where("section is not null")


@query("SELECT type, count(*) AS n FROM p GROUP BY 1")
def d20_type_frequency(t: Tables) -> DataFrame:
    return typed(t).groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT doc_id, idx FROM (SELECT *, lead(type) OVER (PARTITION BY doc_id ORDER BY idx) AS nxt FROM p) WHERE nxt = 'table'")
def d14_keep_with_next(t: Tables) -> DataFrame:
    return typed(t).withColumn("nxt", F.lead("type").over(op.within())).where("nxt = 'table'").select("doc_id", "idx")


@query("SELECT doc_id, min(idx) FILTER (type = 'bibliography_title') AS lo, max(idx) FILTER (type = 'bibliography_title') AS hi, coalesce(min(idx) FILTER (type = 'bibliography_title'), min(idx) FILTER (type = 'heading_1'), 0) AS insert_at FROM p GROUP BY 1")
def d9_d10_contents_range(t: Tables) -> DataFrame:
    def at(kind: str):
        return F.when(F.col("type") == kind, F.col("idx"))

    return typed(t).groupBy("doc_id").agg(F.min(at("bibliography_title")).alias("lo"), F.max(at("bibliography_title")).alias("hi"), F.coalesce(F.min(at("bibliography_title")), F.min(at("heading_1")), F.lit(0)).alias("insert_at"))


@query("SELECT doc_id, string_agg(idx || ':' || type, '; ' ORDER BY idx) AS comment, count(*) AS n FROM p WHERE length(text) > 300 GROUP BY 1")
def d16_joined_comments(t: Tables) -> DataFrame:
    item = F.struct("idx", F.concat_ws(":", "idx", "type").alias("s"))
    return typed(t).where(F.length("text") > 300).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["s"]), "; ").alias("comment"), F.count("*").alias("n"))


@query("SELECT doc_id, sum(length(text)) AS before, sum(length(text)) FILTER (type <> 'list') AS after, 100.0 * (sum(length(text)) - coalesce(sum(length(text)) FILTER (type <> 'list'), 0)) > 20 * sum(length(text)) AS lossy FROM p GROUP BY 1")
def d18_content_loss(t: Tables) -> DataFrame:
    n, kept = F.length("text"), F.when(F.col("type") != "list", F.length("text"))
    sums = typed(t).groupBy("doc_id").agg(F.sum(n).alias("before"), F.sum(kept).alias("after"))
    return sums.withColumn("lossy", 100 * (F.col("before") - F.coalesce("after", F.lit(0))) > 20 * F.col("before"))


@catalog.query("SELECT conv_id, turn, role, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) <= 2 AS within_quota FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 10")
def n22_last_turns(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    asked = F.sum((F.col("role") == "user").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return t.conversations.withColumn("within_quota", asked <= 2).withColumn("back", last).where("back <= 10").select("conv_id", "turn", "role", "within_quota")


QUERIES, ORACLE_SQL = catalog.queries, catalog.sql
