"""Rate, retry and access state machines as batch queries over the event log; the streaming twins are in ``streaming``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .catalog import Catalog, Tables

catalog = Catalog()
query = catalog.query

NOW = "2001-06-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


@query("SELECT user_id AS model_id, date_trunc('minute', ts) AS minute, count(*) AS requests FROM events GROUP BY 1, 2")
def r1_minute_counters(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("user_id").alias("model_id"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute")).agg(F.count("*").alias("requests"))


@query("SELECT user_id AS model_id, CAST(ts AS DATE) AS day, count(*) AS requests FROM events GROUP BY 1, 2")
def r1_day_counters(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("user_id").alias("model_id"), F.to_date("ts").alias("day")).agg(F.count("*").alias("requests"))


@query("""WITH e AS (SELECT event_id, ts, user_id AS m, event_type <> 'error' AS ok FROM events),
a AS (SELECT *, coalesce(sum(ok::INT) OVER (PARTITION BY m, date_trunc('hour', ts) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS hourly, coalesce(sum(ok::INT) OVER (PARTITION BY m, CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS daily FROM e)
SELECT event_id, hourly < 2 AND daily < 30 AS admitted FROM a""")
def r2_admission(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "ts", F.col("user_id").alias("m"), (F.col("event_type") != "error").cast("int").alias("ok"))

    def earlier(unit):
        return F.coalesce(F.sum("ok").over(Window.partitionBy("m", unit).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    return e.select("event_id", ((earlier(F.date_trunc("hour", "ts")) < 2) & (earlier(F.to_date("ts")) < 30)).alias("admitted"))


@query("""WITH e AS (SELECT event_id, ts, user_id AS m, event_type = 'error' AS err, count(*) FILTER (event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events)
SELECT event_id, CAST(n AS BIGINT) AS consecutive, ts + CASE WHEN n = 1 THEN INTERVAL 15 SECOND WHEN n = 2 THEN INTERVAL 30 SECOND ELSE INTERVAL 60 SECOND END AS blocked_until FROM (SELECT *, sum(err::INT) OVER (PARTITION BY m, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM e) WHERE err""")
def r3_error_backoff(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "ts", F.col("user_id").alias("m"), (F.col("event_type") == "error").alias("err"))
    order = Window.partitionBy("m").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("run", F.sum((~F.col("err")).cast("long")).over(order))
    n = F.sum(F.col("err").cast("long")).over(Window.partitionBy("m", "run").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    wait = F.when(F.col("consecutive") == 1, F.expr("INTERVAL 15 SECONDS")).when(F.col("consecutive") == 2, F.expr("INTERVAL 30 SECONDS")).otherwise(F.expr("INTERVAL 60 SECONDS"))
    return e.withColumn("consecutive", n).where("err").select("event_id", "consecutive", (F.col("ts") + wait).alias("blocked_until"))


@query("SELECT user_id, count(*) AS retries, CASE WHEN count(*) >= 3 THEN 'permanently_failed' ELSE 'failed' END AS status FROM events WHERE event_type = 'error' GROUP BY 1")
def r4_retry_limit(t: Tables) -> DataFrame:
    n = t.events.where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("retries"))
    return n.withColumn("status", F.when(F.col("retries") >= 3, "permanently_failed").otherwise("failed"))


@query("SELECT user_id, max(ts) AS last_seen FROM events GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-30 12:00:00'")
def r6_stuck(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.max("ts").alias("last_seen")).where(F.col("last_seen") < F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"))


@query("SELECT user_id, min_by(event_type, (ts, event_id)) AS first_type, min(ts) AS first_ts FROM events GROUP BY 1")
def r8_first_touch(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"), F.min("ts").alias("first_ts"))


@query("""WITH s AS (SELECT o_custkey, max(o_orderdate) FILTER (o_orderstatus = 'F') AS last_paid, count(*) FILTER (o_orderstatus = 'P') AS pending FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN 'admin' WHEN o_custkey IS NULL THEN 'trial' WHEN last_paid + INTERVAL 365 DAY > TIMESTAMP '2001-06-01' THEN 'subscription' WHEN pending > 0 THEN 'one_time' ELSE 'none' END AS access FROM customer LEFT JOIN s ON c_custkey = o_custkey""")
def c7_access_resolver(t: Tables) -> DataFrame:
    status = F.col("o_orderstatus")
    s = t.orders.groupBy("o_custkey").agg(F.max(F.when(status == "F", F.col("o_orderdate"))).alias("last_paid"), F.count_if(status == "P").alias("pending"))
    active = F.col("last_paid") + F.expr("INTERVAL 365 DAYS") > now()
    access = F.when(F.col("c_custkey") % 50 == 0, "admin").when(F.col("o_custkey").isNull(), "trial").when(active, "subscription").when(F.col("pending") > 0, "one_time").otherwise("none")
    return t.customer.join(s, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", access.alias("access"))


@query("SELECT o_custkey, greatest(max(o_orderdate), TIMESTAMP '2001-06-01') + INTERVAL 30 DAY * count(*) FILTER (o_orderstatus = 'F') AS until FROM orders GROUP BY 1")
def c9_subscription_extension(t: Tables) -> DataFrame:
    g = t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("expiry"), F.count_if(F.col("o_orderstatus") == "F").alias("months"))
    return g.select("o_custkey", (F.greatest("expiry", now()) + F.expr("INTERVAL 30 DAYS") * F.col("months")).alias("until"))


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, CASE WHEN month(o_orderdate) BETWEEN 2 AND 6 THEN 'spring' WHEN month(o_orderdate) BETWEEN 9 AND 12 THEN 'fall' ELSE 'general' END AS season, greatest(0, date_diff('day', CAST(o_orderdate AS DATE), make_date(year(o_orderdate), 6, 1))) AS days_left FROM orders")
def c15_season_deadline(t: Tables) -> DataFrame:
    d = t.orders.select(F.to_date("o_orderdate").alias("day")).distinct()
    m = F.month("day")
    season = F.when(m.between(2, 6), "spring").when(m.between(9, 12), "fall").otherwise("general")
    return d.select("day", season.alias("season"), F.greatest(F.lit(0), F.date_diff(F.make_date(F.year("day"), F.lit(6), F.lit(1)), F.col("day"))).cast("long").alias("days_left"))


@query("WITH d AS (SELECT o_custkey, o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders WHERE o_orderstatus = 'P') SELECT o_custkey, count(*) AS kept FROM d WHERE prev IS NULL OR o_orderdate > prev + INTERVAL 30 DAY GROUP BY 1")
def r7_overlapping_polls(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    d = t.orders.where("o_orderstatus = 'P'").withColumn("prev", F.lag("o_orderdate").over(w))
    return d.where(F.col("prev").isNull() | (F.col("o_orderdate") > F.col("prev") + F.expr("INTERVAL 30 DAYS"))).groupBy("o_custkey").agg(F.count("*").alias("kept"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderdate < TIMESTAMP '2001-06-01' - INTERVAL 24 HOUR THEN 'expired' ELSE 'pending' END AS state FROM orders")
def r12_reconciliation(t: Tables) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderdate") < now() - F.expr("INTERVAL 24 HOURS"), "expired").otherwise("pending")
    return t.orders.select("o_orderkey", state.alias("state"))


@query("SELECT user_id, list_sort(list_filter([1, 5, 15, 30], lambda x: x <= n)) AS granted, list_min(list_filter([1, 5, 15, 30], lambda x: x > n)) AS next FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1)")
def r11_reward_grants(t: Tables) -> DataFrame:
    n = t.events.where("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("n"))
    thresholds = F.array(*map(F.lit, (1, 5, 15, 30)))
    return n.select("user_id", F.filter(thresholds, lambda x: x <= F.col("n")).alias("granted"), F.array_min(F.filter(thresholds, lambda x: x > F.col("n"))).alias("next"))


QUERIES, ORACLE_SQL = catalog.queries, catalog.sql
