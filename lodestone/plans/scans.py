"""Scans by page, appends, report rows and predicates on text and on timestamps kept as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import blocks as op
from .blocks import LINES, W, has, lines
from .catalog import Catalog, Tables

catalog = Catalog()
query = catalog.query

#: Rows of a page of the identity scan, of which the first is taken.
PAGE = 500


@query(f"SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT {PAGE}")
def s2_first_page(t: Tables) -> DataFrame:
    return t.customer.orderBy("c_custkey").limit(PAGE).select("c_custkey", "c_name")


@query("SELECT to_json({'doc_id': doc_id, 'lang': lang, 'paragraphs': len(string_split(text, chr(10))), 'chars': length(text), 'passed': length(text) > 200}) AS report FROM documents")
def s15_report_rows(t: Tables) -> DataFrame:
    """A JSON report a document, as the sink writes them."""
    fields = F.struct("doc_id", "lang", F.size(F.split("text", "\n")).alias("paragraphs"), F.length("text").alias("chars"), (F.length("text") > 200).alias("passed"))
    return t.documents.select(F.to_json(fields).alias("report"))


@query("SELECT event_id, user_id, event_type FROM events UNION ALL SELECT event_id + (SELECT max(event_id) FROM events), user_id, 'pageview' FROM events WHERE event_type = 'view'")
def w1_append(t: Tables) -> DataFrame:
    """The log after each view was tracked once more as a new row behind the last."""
    last = t.events.agg(F.max("event_id").alias("last"))
    new = t.events.where("event_type = 'view'").join(F.broadcast(last)).select((F.col("event_id") + F.col("last")).alias("event_id"), "user_id", F.lit("pageview").alias("event_type"))
    return t.events.select("event_id", "user_id", "event_type").unionByName(new)


@query(LINES + f"SELECT doc_id, idx, {has(W.section)} AS section, {has(W.entry)} AS entry, {has(W.any_caption)} AS caption, {has(W.marker)} AS marker, {has(W.latin)} AS latin FROM p")
def p8_pattern_predicates(t: Tables) -> DataFrame:
    x = op.trimmed(F.col("text"))
    patterns = {"section": W.section, "entry": W.entry, "caption": W.any_caption, "marker": W.marker, "latin": W.latin}
    return lines(t).select("doc_id", "idx", *[x.rlike(p).alias(name) for name, p in patterns.items()])


@query("SELECT event_id FROM (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.000Z') AS iso FROM events) WHERE iso >= '2024-01-10T12' AND iso < '2024-01-20'")
def p11_timestamps_as_text(t: Tables) -> DataFrame:
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'.000Z'")
    return t.events.where((at >= "2024-01-10T12") & (at < "2024-01-20")).select("event_id")


@query("SELECT o_custkey, o_orderkey, page FROM (SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 10 AS page FROM orders) WHERE page = 0")
def s2_first_page_per_owner(t: Tables) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return t.orders.select("o_custkey", "o_orderkey", F.floor((place - 1) / 10).cast("long").alias("page")).where("page = 0")


QUERIES, ORACLE_SQL = catalog.queries, catalog.sql
