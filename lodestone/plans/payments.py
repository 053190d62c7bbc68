"""Payments by webhook, reconciliation, distribution and polling as batch queries; the stream twin is in ``streaming``.

Events of a user in a calendar week stand for the webhooks of an invoice: clicks and signups create it, purchases and errors
are what the provider reports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import payments as op
from .catalog import Catalog, Tables

catalog = Catalog()
query = catalog.query

KIND = "CASE event_type WHEN 'click' THEN 'created' WHEN 'signup' THEN 'created' WHEN 'purchase' THEN 'payment.success' WHEN 'error' THEN 'payment.failed' ELSE event_type END"
UNTIL = "TIMESTAMP_NTZ '2024-02-05 00:00:00'"


def webhooks(events: DataFrame) -> DataFrame:
    week = F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd")
    return events.select(F.concat_ws(":", "user_id", week).alias("invoice"), "event_id", "ts", F.expr(KIND).alias("type"))


@query(f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY invoice ORDER BY ts, event_id) AS n FROM (SELECT user_id || ':' || strftime(date_trunc('week', ts), '%Y-%m-%d') AS invoice, event_id, ts, {KIND} AS type FROM events)),
r AS (SELECT DISTINCT invoice, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::TIMESTAMP AS ts, NULL::VARCHAR AS outcome, NULL::VARCHAR AS state, NULL::TIMESTAMP AS created, false AS lapsed FROM e
UNION ALL SELECT invoice, n, event_id, ts, CASE WHEN type = 'created' THEN CASE WHEN created IS NULL THEN 'created' ELSE 'duplicate' END WHEN type NOT LIKE 'payment%' THEN 'ignored' WHEN created IS NULL THEN 'unknown' WHEN type = 'payment.failed' THEN 'failed' WHEN state = 'completed' THEN 'repeat' ELSE 'completed' END,
CASE WHEN type = 'created' AND created IS NULL THEN 'pending' WHEN created IS NULL OR type NOT LIKE 'payment%' THEN state WHEN type = 'payment.success' THEN 'completed' ELSE 'failed' END, CASE WHEN type = 'created' THEN coalesce(created, ts) ELSE created END, lapsed
FROM (SELECT r.invoice, e.n, e.event_id, e.ts, e.type, r.created, coalesce(r.state = 'pending' AND e.ts >= r.created + INTERVAL 24 HOUR, false) AS lapsed, CASE WHEN r.state = 'pending' AND e.ts >= r.created + INTERVAL 24 HOUR THEN 'failed' ELSE r.state END AS state FROM r JOIN e ON e.invoice = r.invoice AND e.n = r.n + 1))
SELECT invoice, event_id, ts, outcome, state FROM r WHERE n > 0
UNION ALL SELECT invoice, NULL, created + INTERVAL 24 HOUR, 'expired', 'failed' FROM r WHERE lapsed
UNION ALL SELECT invoice, NULL, created + INTERVAL 24 HOUR, 'expired', 'failed' FROM r WHERE state = 'pending' AND TIMESTAMP '2024-02-05' >= created + INTERVAL 24 HOUR AND n = (SELECT max(n) FROM e WHERE e.invoice = r.invoice)""")
def r10_payment_history(t: Tables) -> DataFrame:
    """What each webhook did to its payment, expiries included."""
    return op.payment_history(webhooks(t.events), F.expr(UNTIL))


@query("""SELECT o_orderkey AS invoice, CASE o_orderpriority WHEN '1-URGENT' THEN 'completed' WHEN '2-HIGH' THEN 'failed' WHEN '5-LOW' THEN 'error' ELSE CASE WHEN o_orderdate + INTERVAL 24 HOUR < TIMESTAMP '2001-07-31 12:00:00' THEN 'expired' ELSE 'wait' END END AS action
FROM orders WHERE o_orderstatus IN ('P', 'O') AND o_orderdate < TIMESTAMP '2001-07-31 12:00:00' - INTERVAL 30 MINUTE""")
def r12_reconciled_with_provider(t: Tables) -> DataFrame:
    """Orders that aren't finished as pending payments, their priority as the provider's answer (none for the lowest)."""
    payments = t.orders.select(F.col("o_orderkey").alias("invoice"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("pending").alias("status"), F.col("o_orderdate").alias("created"))
    answer = F.col("o_orderpriority")
    answers = F.when(answer == "1-URGENT", "COMPLETED").when(answer == "2-HIGH", "FAILED").when(answer == "3-MEDIUM", "NEW").otherwise("IN_PROGRESS")
    provider = t.orders.where(answer != "5-LOW").select(F.col("o_orderkey").alias("invoice"), answers.alias("answer"))
    return op.reconcile(payments, provider, F.expr("TIMESTAMP_NTZ '2001-07-31 12:00:00'"))


@query("""WITH log AS (SELECT l_partkey, l_returnflag, count(*) AS tries, max(l_shipdate) AS last_at, CASE WHEN sum(l_quantity) > 150 THEN 'sent' WHEN count(*) >= 8 THEN 'permanently_failed' ELSE 'failed' END AS status FROM lineitem WHERE l_partkey % 3 > 0 GROUP BY 1, 2),
fresh AS (SELECT f AS platform, p_partkey AS slug, row_number() OVER (PARTITION BY f ORDER BY p_retailprice DESC, p_partkey) AS place FROM part CROSS JOIN (SELECT unnest(['A', 'N', 'R']) AS f) WHERE NOT EXISTS (SELECT 1 FROM log WHERE l_partkey = p_partkey AND l_returnflag = f)),
again AS (SELECT l_returnflag AS platform, l_partkey AS slug, tries, row_number() OVER (PARTITION BY l_returnflag ORDER BY last_at, l_partkey) AS place FROM log WHERE status = 'failed')
SELECT platform, slug, 0 AS attempt, CAST(place AS INTEGER) AS place FROM fresh WHERE place <= 10 UNION ALL SELECT platform, slug, CAST(tries AS INTEGER), CAST(place + 10 AS INTEGER) FROM again WHERE place <= 10""")
def r5_distribution_batches(t: Tables) -> DataFrame:
    """Parts as posts, return flags as platforms, their lines as tries: ten new posts and ten retries for each platform."""
    kinds = F.when(F.sum("l_quantity") > 150, "sent").when(F.count("*") >= 8, "permanently_failed").otherwise("failed")
    log = t.lineitem.where("l_partkey % 3 > 0").groupBy(F.col("l_partkey").alias("slug"), F.col("l_returnflag").alias("platform")).agg(F.count("*").alias("tries"), F.max("l_shipdate").alias("at"), kinds.alias("status"))
    posts = t.part.select(F.col("p_partkey").alias("slug"), F.col("p_retailprice").alias("published"))
    return op.distribution_batch(posts, log, ["A", "N", "R"], 10)


@query("""WITH p AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, event_type FROM events),
seen AS (SELECT event_id, user_id, s, unnest(range(CAST(ceil((s + 1500) / 300) AS BIGINT) * 300, CAST(floor((s + 2100) / 300) AS BIGINT) * 300 + 1, 300)) AS poll FROM p WHERE event_type IN ('click', 'signup')),
last AS (SELECT * FROM seen QUALIFY row_number() OVER (PARTITION BY user_id, poll ORDER BY s DESC, event_id DESC) = 1),
mine AS (SELECT * FROM last WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.event_type = 'purchase' AND p.user_id = last.user_id AND p.s BETWEEN last.poll - 3600 AND last.poll))
SELECT min(poll) AS poll, user_id AS "user", event_id AS invoice FROM mine GROUP BY user_id, event_id""")
def r7_overlapping_poll_windows(t: Tables) -> DataFrame:
    """Clicks and signups as payments begun, purchases as payments made: whom polls every five minutes write to."""
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type").isin("click", "signup"), "pending")
    return op.abandoned_polls(t.events.select(F.col("event_id").alias("invoice"), F.col("user_id").alias("user"), F.col("ts").alias("created"), status.alias("status")))


QUERIES, ORACLE_SQL = catalog.queries, catalog.sql
