"""Product analytics over events, customers and orders: joins, aggregations, set operations, writes as transforms.

Orders stand for payments (status F: completed, P: pending, O: failed), customers for users, events for logs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import relational as op
from .catalog import Catalog, Tables

catalog = Catalog()
query = catalog.query


def day(column: str):
    return F.to_date(column)


@query("SELECT CAST(o_orderdate AS DATE) AS day, o_orderstatus AS status, count(*) AS n_orders, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS revenue FROM orders GROUP BY 1, 2")
def a4_daily_revenue(t: Tables) -> DataFrame:
    return t.orders.groupBy(day("o_orderdate").alias("day"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n_orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("revenue"))


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def a1_count_where(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus = 'F'").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT CASE WHEN value > 50 THEN user_id END) AS big_users FROM events GROUP BY 1")
def a2_distinct_users(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct(F.when(F.col("value") > 50, F.col("user_id"))).alias("big_users"))


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS signups FROM events WHERE event_type = 'signup' GROUP BY 1")
def a3_daily_signups(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'signup'").groupBy(day("ts").alias("day")).agg(F.count("*").alias("signups"))


@query("SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'P') AS pending, count(*) FILTER (o_orderstatus NOT IN ('F', 'P')) AS other FROM orders GROUP BY 1")
def a5_status_pivot(t: Tables) -> DataFrame:
    s = F.col("o_orderstatus")
    return t.orders.groupBy(day("o_orderdate").alias("day")).agg(F.count("*").alias("total"), F.count_if(s == "F").alias("done"), F.count_if(s == "P").alias("pending"), F.count_if(~s.isin("F", "P")).alias("other"))


@query("SELECT coalesce(nullif(CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN NULL ELSE o_orderpriority END, ''), '(none)') AS label, count(*) AS n FROM orders GROUP BY 1")
def a6_null_bucket(t: Tables) -> DataFrame:
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.lit("")).when(F.col("o_orderkey") % 3 == 1, F.lit(None)).otherwise(F.col("o_orderpriority"))
    return t.orders.groupBy(op.or_default(raw, "(none)").alias("label")).agg(F.count("*").alias("n"))


@query("SELECT event_type, coalesce(floor(avg(CAST(CAST(value AS DECIMAL(18,4)) AS DOUBLE)) * 10 + 0.5) / 10, 0) AS mean FROM events GROUP BY 1")
def a7_rounded_mean(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.coalesce(op.half_up(F.avg("value"), 1), F.lit(0)).alias("mean"))


@query("SELECT CAST(b AS INT) AS bucket, count(l_orderkey) AS n FROM range(1, 61) r(b) LEFT JOIN lineitem ON CAST(l_quantity AS INT) = b GROUP BY 1")
def a8_fixed_histogram(t: Tables) -> DataFrame:
    return op.fixed_histogram(t.lineitem, "l_quantity", range(1, 61))


@query("SELECT CAST(o_orderdate AS DATE) AS day, CASE WHEN count(*) > 0 THEN CAST(CAST(floor(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*) + 0.5) AS BIGINT) AS VARCHAR) || '%' ELSE '0%' END AS paid FROM orders GROUP BY 1")
def a9_percent_label(t: Tables) -> DataFrame:
    return t.orders.groupBy(day("o_orderdate").alias("day")).agg(op.percent_label(F.count_if(F.col("o_orderstatus") == "F"), F.count("*")).alias("paid"))


@query("SELECT l_returnflag, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS amount FROM lineitem GROUP BY 1")
def a10_decimal_sum(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("amount"))


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1 HAVING count(*) >= 3")
def a11_having_at_least(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("n")).where("n >= 3")


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1 HAVING count(*) > 0 AND count(*) < 15")
def a12_having_below_threshold(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("n")).where("n > 0 AND n < 15")


@query("SELECT event_type, CAST(user_id % 2 AS BIGINT) AS side, count(*) AS n FROM (SELECT * FROM events ORDER BY ts DESC, event_id LIMIT 50) GROUP BY 1, 2")
def a13_limit_then_group(t: Tables) -> DataFrame:
    return t.events.orderBy(F.desc("ts"), "event_id").limit(50).groupBy("event_type", (F.col("user_id") % 2).alias("side")).agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, min(l_orderkey) AS first_seen FROM lineitem GROUP BY ALL ORDER BY n DESC, first_seen, l_returnflag, l_linestatus, l_linenumber LIMIT 5")
def a14_top_groups(t: Tables) -> DataFrame:
    return op.top_groups(t.lineitem, ["l_returnflag", "l_linestatus", "l_linenumber"], "l_orderkey", 5)


@query("SELECT p_type AS category, count(*) AS n, avg(p_size) AS mean_size FROM part GROUP BY 1")
def a15_group_by_category(t: Tables) -> DataFrame:
    return t.part.groupBy(F.col("p_type").alias("category")).agg(F.count("*").alias("n"), F.avg("p_size").alias("mean_size"))



@query("""WITH c AS (SELECT l_returnflag AS category, l_quantity <= 30 AS passed, CASE l_linenumber % 3 WHEN 0 THEN 10 WHEN 1 THEN 5 ELSE 2 END AS w FROM lineitem)
SELECT category, count(*) AS total, count(*) FILTER (passed) AS n_passed, CASE WHEN sum(w) > 0 THEN CAST(floor(100.0 * coalesce(sum(w) FILTER (passed), 0) / sum(w) + 0.5) AS BIGINT) ELSE 100 END AS score FROM c GROUP BY ROLLUP (category)""")
def a16_a17_weighted_score(t: Tables) -> DataFrame:
    severity = F.element_at(F.array(F.lit("critical"), F.lit("major"), F.lit("minor")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    return op.weighted_scores(t.lineitem.select(F.col("l_returnflag").alias("category"), (F.col("l_quantity") <= 30).alias("passed"), severity.alias("severity")))


@query("SELECT l_shipdate::DATE AS day, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS fixed, CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) / count(*) AS ratio FROM lineitem GROUP BY 1 ORDER BY ratio DESC, day LIMIT 15")
def a18_fix_ratio_top(t: Tables) -> DataFrame:
    g = t.lineitem.groupBy(day("l_shipdate").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("fixed"))
    return g.withColumn("ratio", F.col("fixed") / F.col("n")).orderBy(F.desc("ratio"), "day").limit(15)


@query("SELECT p_brand, count(*) AS n, floor(1000.0 * count(*) / sum(count(*)) OVER () + 0.5) / 10 AS pct FROM part GROUP BY 1")
def a19_share_of_total(t: Tables) -> DataFrame:
    g = t.part.groupBy("p_brand").agg(F.count("*").alias("n"))
    return g.crossJoin(g.agg(F.sum("n").alias("total"))).select("p_brand", "n", op.half_up(100 * F.col("n") / F.col("total"), 1).alias("pct"))


@query("SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'tier1' WHEN 'MACHINERY' THEN 'tier2' ELSE 'default' END AS tier, count(*) AS n, CAST(count(*) FILTER (c_acctbal > 0) AS DOUBLE) / count(*) AS share FROM customer GROUP BY 1")
def a20_tier_share(t: Tables) -> DataFrame:
    tier = F.when(F.col("c_mktsegment") == "BUILDING", "tier1").when(F.col("c_mktsegment") == "MACHINERY", "tier2").otherwise("default")
    return t.customer.groupBy(tier.alias("tier")).agg(F.count("*").alias("n"), (F.count_if(F.col("c_acctbal") > 0) / F.count("*")).alias("share"))


@query("SELECT CASE WHEN p_size >= 40 THEN 'a' WHEN p_size >= 30 THEN 'b' WHEN p_size >= 20 THEN 'c' ELSE 'd' END AS bucket, count(*) AS n, count(*) FILTER (p_retailprice > 1000) AS pricey FROM part GROUP BY 1")
def a21_prevalence_buckets(t: Tables) -> DataFrame:
    size = F.col("p_size")
    return t.part.groupBy(F.when(size >= 40, "a").when(size >= 30, "b").when(size >= 20, "c").otherwise("d").alias("bucket")).agg(F.count("*").alias("n"), F.count_if(F.col("p_retailprice") > 1000).alias("pricey"))


@query("SELECT c_nationkey, min(c_acctbal) AS low, max(c_acctbal) AS high, count(*) FILTER (c_acctbal > 0) AS improved, count(*) FILTER (c_acctbal < 0) AS regressed, count(*) FILTER (c_acctbal = 0) AS same FROM customer GROUP BY 1")
def a22_delta_summary(t: Tables) -> DataFrame:
    sign = F.signum("c_acctbal")
    return t.customer.groupBy("c_nationkey").agg(F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"), F.count_if(sign == 1).alias("improved"), F.count_if(sign == -1).alias("regressed"), F.count_if(sign == 0).alias("same"))


@query("SELECT o_custkey, bool_or(o_orderstatus = 'P') AS any_pending, bool_and(o_totalprice > 1000) AS all_large FROM orders GROUP BY 1")
def a23_any_and_all(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "P").alias("any_pending"), F.bool_and(F.col("o_totalprice") > 1000).alias("all_large"))


@query("SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) FILTER (o_orderstatus = 'P') AS pending FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderstatus = 'P') > 0.05 * count(*)")
def a24_alert_with_indexes(t: Tables) -> DataFrame:
    pending = F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey"))
    g = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(pending)).alias("pending"), F.count("*").alias("n"))
    return g.where(F.size("pending") > 0.05 * F.col("n")).select("o_custkey", "pending")


@query("SELECT o_orderkey, string_agg(l_returnflag || ':' || l_linenumber, ' ' ORDER BY l_linenumber, l_returnflag) AS flags FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def a25_ordered_concat(t: Tables) -> DataFrame:
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    item = F.struct("l_linenumber", F.concat_ws(":", "l_returnflag", "l_linenumber").alias("s"))
    return joined.groupBy("o_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["s"]), " ").alias("flags"))


@query("SELECT p_brand, (list(p_partkey ORDER BY p_partkey))[1:5] AS examples, count(*) AS n FROM part WHERE p_size > 25 GROUP BY 1")
def a26_bounded_examples(t: Tables) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    first = F.when(F.col("rn") <= 5, F.col("p_partkey"))
    return t.part.where("p_size > 25").withColumn("rn", F.row_number().over(w)).groupBy("p_brand").agg(F.array_sort(F.collect_list(first)).alias("examples"), F.count("*").alias("n"))


@query("SELECT user_id, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY 1")
def a27_index_range(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("SELECT c_nationkey, CASE WHEN count(*) + 3 <= 9 THEN count(*) + 3 ELSE greatest(count(*), 9) END AS shown FROM customer GROUP BY 1")
def a29_capped_capacity(t: Tables) -> DataFrame:
    n = F.count("*")
    return t.customer.groupBy("c_nationkey").agg(F.when(n + 3 <= 9, n + 3).otherwise(F.greatest(n, F.lit(9))).alias("shown"))


@query("SELECT o_orderkey, o_custkey, floor(epoch(o_orderdate - TIMESTAMP '1995-01-01') / 3600.0 * 10 + 0.5) / 10 AS hours FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'")
def j1_hours_to_purchase(t: Tables) -> DataFrame:
    paid = t.orders.where("o_orderstatus = 'F'").join(t.customer.select(F.col("c_custkey").alias("o_custkey")), "o_custkey")
    seconds = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) - F.unix_timestamp(F.lit("1995-01-01 00:00:00").cast("timestamp"))
    return paid.select("o_orderkey", "o_custkey", op.half_up(seconds / 3600, 1).alias("hours"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def j2_users_without_pending(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT DISTINCT p.o_custkey FROM orders p WHERE p.o_orderstatus = 'P' AND NOT EXISTS (SELECT 1 FROM orders f WHERE f.o_custkey = p.o_custkey AND f.o_orderstatus = 'F' AND f.o_orderdate >= TIMESTAMP '2000-01-01')")
def j3_abandoned_anti_range(t: Tables) -> DataFrame:
    done = t.orders.where("o_orderstatus = 'F'")
    return op.without_recent(t.orders.where("o_orderstatus = 'P'"), done, "o_custkey", "o_orderdate", F.lit("2000-01-01").cast("timestamp_ntz")).select("o_custkey").distinct()


@query("SELECT o_custkey, max(o_orderdate) AS last_order FROM orders GROUP BY 1 HAVING max(o_orderdate) <= TIMESTAMP '2001-01-01'")
def j4_inactive_since(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_order")).where(F.col("last_order") <= F.lit("2001-01-01").cast("timestamp_ntz"))


@query("""WITH l AS (SELECT event_id, user_id, event_type, CASE WHEN event_id % 2 = 0 THEN NULL ELSE event_id % 5 END AS job FROM events),
s AS (SELECT user_id, event_type, job FROM l WHERE event_id < 2000)
SELECT event_id FROM l WHERE event_id >= 2000 AND NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = l.user_id AND s.event_type = l.event_type AND s.job IS NOT DISTINCT FROM l.job)""")
def j5_null_safe_dedup(t: Tables) -> DataFrame:
    log = t.events.select("event_id", "user_id", "event_type", F.when(F.col("event_id") % 2 != 0, F.col("event_id") % 5).alias("job"))
    sent = log.where("event_id < 2000").select(F.col("user_id").alias("u"), F.col("event_type").alias("e"), F.col("job").alias("j"))
    return log.where("event_id >= 2000").join(sent, (F.col("user_id") == F.col("u")) & (F.col("event_type") == F.col("e")) & F.col("job").eqNullSafe(F.col("j")), "left_anti").select("event_id")


@query("SELECT d.doc_id, d.n_chars, l.toxic FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1 AND d.lang = 'en'")
def j7_feedback_join(t: Tables) -> DataFrame:
    return t.documents.where("lang = 'en'").join(t.labels.where("quality = 1"), "doc_id").select("doc_id", "n_chars", "toxic")


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def j8_left_enrich(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")


@query("""WITH p AS (SELECT DISTINCT event_type AS platform FROM events), w AS (SELECT DISTINCT user_id, event_type AS platform FROM events WHERE value > 90)
SELECT u.user_id, p.platform FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN p WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.user_id = u.user_id AND w.platform = p.platform)""")
def j9_undistributed_per_platform(t: Tables) -> DataFrame:
    platforms = t.events.select(F.col("event_type").alias("platform")).distinct()
    done = t.events.where("value > 90").select("user_id", F.col("event_type").alias("platform")).distinct()
    return t.events.select("user_id").distinct().crossJoin(F.broadcast(platforms)).join(done, ["user_id", "platform"], "left_anti")


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def j10_cross_join(t: Tables) -> DataFrame:
    return t.nation.select("n_name").crossJoin(t.region.select("r_name"))


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def j20_semi_join(t: Tables) -> DataFrame:
    return t.orders.join(t.lineitem.where("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("""WITH f AS (SELECT user_id, min_by(props, (ts, event_id)) AS first_props, min(ts) AS first_ts FROM events GROUP BY 1)
SELECT c_custkey, coalesce(f.first_props, 'direct') AS attribution FROM customer LEFT JOIN f ON c_custkey = user_id""")
def j18_first_touch_backfill(t: Tables) -> DataFrame:
    first = t.events.groupBy("user_id").agg(F.min_by("props", F.struct("ts", "event_id")).alias("first_props"))
    return t.customer.join(first, F.col("c_custkey") == F.col("user_id"), "left").select("c_custkey", F.coalesce("first_props", F.lit("direct")).alias("attribution"))


@query("""WITH r AS (SELECT c_custkey AS referee, c_custkey // 10 AS referrer FROM customer), paid AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'),
g AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 7 = 0)
SELECT r.referrer, r.referee FROM r JOIN paid ON paid.o_custkey = r.referee JOIN customer c ON c.c_custkey = r.referrer WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.o_custkey = r.referee)""")
def j19_referral_chain(t: Tables) -> DataFrame:
    links = t.customer.select(F.col("c_custkey").alias("referee"), F.floor(F.col("c_custkey") / 10).alias("referrer"))
    paid = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("referee"))
    granted = t.orders.where("o_orderstatus = 'P' AND o_orderkey % 7 = 0").select(F.col("o_custkey").alias("referee"))
    known = t.customer.select(F.col("c_custkey").alias("referrer"))
    return links.join(paid, "referee", "left_semi").join(known, "referrer", "left_semi").join(granted, "referee", "left_anti").select("referrer", "referee")


@query("""WITH b AS (SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 3 <> 0)
SELECT c.c_custkey, CAST(coalesce(CAST(c.c_acctbal AS DECIMAL(18,2)) - CAST(b.c_acctbal AS DECIMAL(18,2)) + c.c_custkey % 5, 0) AS DECIMAL(20,2)) AS delta FROM customer c LEFT JOIN b USING (c_custkey)""")
def j22_delta_to_baseline(t: Tables) -> DataFrame:
    base = t.customer.where("c_custkey % 3 <> 0").select("c_custkey", F.col("c_acctbal").cast("decimal(18,2)").alias("base"))
    delta = F.col("c_acctbal").cast("decimal(18,2)") - F.col("base") + (F.col("c_custkey") % 5)
    return t.customer.join(base, "c_custkey", "left").select("c_custkey", F.coalesce(delta, F.lit(0)).cast("decimal(20,2)").alias("delta"))


@query("SELECT day, n, n - lag(n) OVER (ORDER BY day) AS change FROM (SELECT date_trunc('week', ts)::DATE AS day, count(*) AS n FROM events GROUP BY 1)")
def j23_previous_snapshot(t: Tables) -> DataFrame:
    weekly = t.events.groupBy(F.to_date(F.date_trunc("week", F.col("ts"))).alias("day")).agg(F.count("*").alias("n"))
    return weekly.withColumn("change", F.col("n") - F.lag("n").over(Window.orderBy("day")))


@query("SELECT * EXCLUDE (rn) FROM (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders WHERE o_orderstatus = 'P') WHERE rn = 1")
def n1_latest_pending(t: Tables) -> DataFrame:
    return op.keep_latest(t.orders.where("o_orderstatus = 'P'").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], F.desc("o_orderdate"), F.col("o_orderkey"))


@query("SELECT user_id, max_by(event_type, (ts, event_id)) AS last_type FROM events GROUP BY 1")
def n2_latest_per_key(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def k1_top_orders(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


@query("SELECT event_type, n FROM (SELECT event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1 ORDER BY n DESC, f LIMIT 3)")
def k2_topk_first_seen(t: Tables) -> DataFrame:
    return op.top_groups(t.events, ["event_type"], "event_id", 3).select("event_type", "n")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_size > 25 DESC, coalesce(CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size END, 0) DESC, p_partkey) AS place FROM part QUALIFY place <= 100")
def k3_multi_key_sort(t: Tables) -> DataFrame:
    size = F.when(F.col("p_size") % 4 != 0, F.col("p_size"))
    top = t.part.orderBy(F.desc(F.col("p_size") > 25), F.desc(F.coalesce(size, F.lit(0))), "p_partkey").limit(100)
    order = Window.orderBy(F.desc(F.col("p_size") > 25), F.desc(F.coalesce(size, F.lit(0))), "p_partkey")
    return top.select("p_partkey", F.row_number().over(order).cast("long").alias("place"))


@query("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 20")
def k5_lowest_first(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", "s_acctbal").orderBy("s_acctbal", "s_suppkey").limit(20)


@query("SELECT a.p_partkey, b.p_partkey AS related, row_number() OVER (PARTITION BY a.p_partkey ORDER BY b.p_size DESC, b.p_partkey) AS place FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey <> b.p_partkey QUALIFY place <= 3")
def k7_related_items(t: Tables) -> DataFrame:
    # The four first of a group hold the three first others of each member, so no member meets the whole group.
    w = Window.partitionBy("p_brand", "p_type").orderBy(F.desc("p_size"), "p_partkey")
    first = t.part.withColumn("rn", F.row_number().over(w)).where("rn <= 4").select("p_brand", "p_type", F.col("p_partkey").alias("related"), F.col("p_size").alias("size"))
    pairs = t.part.select("p_partkey", "p_brand", "p_type").join(first, ["p_brand", "p_type"]).where("p_partkey <> related")
    place = F.row_number().over(Window.partitionBy("p_partkey").orderBy(F.desc("size"), "related"))
    return pairs.withColumn("place", place.cast("long")).where("place <= 3").select("p_partkey", "related", "place")


@query("SELECT user_id, sum(CAST(value AS DECIMAL(18,4))) AS total FROM events WHERE event_type = 'click' GROUP BY 1 ORDER BY total DESC, user_id LIMIT 10")
def k8_top_clicks(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'click'").groupBy("user_id").agg(F.sum(F.col("value").cast("decimal(18,4)")).alias("total")).orderBy(F.desc("total"), "user_id").limit(10)


@query("SELECT s_name AS name, 'supplier' AS kind FROM supplier UNION ALL SELECT c_name, 'customer' FROM customer")
def u1_union_all(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_name").alias("name"), F.lit("supplier").alias("kind")).unionByName(t.customer.select(F.col("c_name").alias("name"), F.lit("customer").alias("kind")))


@query("""WITH a AS (SELECT p_partkey AS pos, 1 AS src, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE ' ' || upper(p_brand) || p_size END AS doi FROM part UNION ALL SELECT p_partkey, 2, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE lower(p_brand) || p_size END FROM part)
SELECT src, pos FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(doi)) ORDER BY src, pos) AS rn FROM a) WHERE doi IS NULL OR rn = 1""")
def u2_dedup_by_normalised_key(t: Tables) -> DataFrame:
    def rows(src: int, key):
        return t.part.select(F.lit(src).alias("src"), F.col("p_partkey").alias("pos"), F.when(F.col("p_partkey") % 6 != 0, key).alias("doi"))

    every = rows(1, F.concat(F.lit(" "), F.upper("p_brand"), F.col("p_size"))).unionByName(rows(2, F.concat(F.lower("p_brand"), F.col("p_size"))))
    keyed = every.where("doi is not null").withColumn("key", F.lower(F.trim("doi")))
    return op.keep_latest(keyed, ["key"], F.col("src"), F.col("pos")).select("src", "pos").unionByName(every.where("doi is null").select("src", "pos"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def u3_distinct(t: Tables) -> DataFrame:
    return t.events.select("user_id", "event_type").distinct()


@query("SELECT user_id, list_filter([1, 5, 15, 30], lambda x: x <= n AND NOT list_contains(CASE WHEN user_id % 2 = 0 THEN [1, 5] ELSE [] END, x)) AS open FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1)")
def u4_c10_thresholds_not_granted(t: Tables) -> DataFrame:
    n = t.events.where("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("n"))
    thresholds, granted = F.array(*map(F.lit, (1, 5, 15, 30))), F.when(F.col("user_id") % 2 == 0, F.array(F.lit(1), F.lit(5))).otherwise(F.array().cast("array<int>"))
    return n.select("user_id", F.array_except(F.filter(thresholds, lambda x: x <= F.col("n")), granted).alias("open"))


@query("SELECT DISTINCT w FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part)")
def u7_flat_distinct(t: Tables) -> DataFrame:
    return t.part.select(F.explode(F.split("p_name", " ")).alias("w")).distinct()


@query("""WITH o AS (SELECT user_id, min(event_id) AS event_id FROM events WHERE event_id < 3000 GROUP BY 1)
SELECT * FROM o UNION ALL SELECT user_id, min(event_id) FROM events WHERE event_id >= 3000 AND user_id NOT IN (SELECT user_id FROM o) GROUP BY 1""")
def w2_insert_if_absent(t: Tables) -> DataFrame:
    old = t.events.where("event_id < 3000").groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    return op.insert_if_absent(old, t.events.where("event_id >= 3000").select("user_id", "event_id"), ["user_id"], F.col("event_id"))


@query("""WITH n AS (SELECT user_id, max(event_id) AS event_id FROM events WHERE event_id % 4 = 0 GROUP BY 1), o AS (SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1)
SELECT o.user_id, coalesce(n.event_id, o.event_id) AS event_id FROM o LEFT JOIN n USING (user_id)""")
def w3_upsert_last_wins(t: Tables) -> DataFrame:
    old = t.events.groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    return op.upsert_latest(old, t.events.where("event_id % 4 = 0").select("user_id", "event_id"), ["user_id"], F.desc("event_id"))


@query("SELECT user_id % 7 AS model_id, CAST(ts AS DATE) AS day, count(*) AS total, count(*) FILTER (event_type <> 'error') AS ok, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1, 2")
def w4_daily_usage(t: Tables) -> DataFrame:
    error = F.col("event_type") == "error"
    return t.events.groupBy((F.col("user_id") % 7).alias("model_id"), day("ts").alias("day")).agg(F.count("*").alias("total"), F.count_if(~error).alias("ok"), F.count_if(error).alias("failed"))


@query("SELECT event_id, row_number() OVER w AS nth, row_number() OVER w <= 3 + user_id % 4 AS admitted, CASE WHEN row_number() OVER w <= 3 + user_id % 4 THEN 3 + user_id % 4 - row_number() OVER w ELSE -1 END AS remaining FROM events WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def w5_atomic_quota(t: Tables) -> DataFrame:
    return op.admit_by_quota(t.events.where("event_type = 'purchase'"), "user_id", 3 + F.col("user_id") % 4, F.col("ts"), F.col("event_id")).select("event_id", "nth", "admitted", "remaining")


@query("SELECT event_type, count(*) FILTER (ts < TIMESTAMP '2024-01-15') AS removed, count(*) FILTER (ts >= TIMESTAMP '2024-01-15') AS kept FROM events GROUP BY 1")
def w8_retention(t: Tables) -> DataFrame:
    old = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    return t.events.groupBy("event_type").agg(F.count_if(old).alias("removed"), F.count_if(~old).alias("kept"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-12 00:00:00'")
def p2_inclusive_window(t: Tables) -> DataFrame:
    return t.events.where(F.col("ts").between(F.lit("2024-01-10").cast("timestamp_ntz"), F.lit("2024-01-12").cast("timestamp_ntz"))).select("event_id")


@query("SELECT p_partkey FROM part WHERE abs(p_retailprice - 1000) <= 113")
def p9_tolerance(t: Tables) -> DataFrame:
    return t.part.where(F.abs(F.col("p_retailprice") - 1000) <= 113).select("p_partkey")


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'signup') AS signups, count(*) FILTER (event_type = 'purchase') AS purchases FROM events GROUP BY 1")
def r9_funnel(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    return t.events.groupBy("user_id").agg(F.count_if(kind == "click").alias("clicks"), F.count_if(kind == "signup").alias("signups"), F.count_if(kind == "purchase").alias("purchases"))


QUERIES, ORACLE_SQL = catalog.queries, catalog.sql
