"""Payments as a state machine over webhook events, its batch form, reconciliation, distribution batches and polling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Hours after which a pending payment expires; minutes after which it is looked up at the provider.
EXPIRY_HOURS, STALE_MINUTES = 24, 30
#: What an event does to a payment that is known: created, payment.success and payment.failed; others change nothing.
STATES = {"created": "pending", "payment.success": "completed", "payment.failed": "failed"}

RESULT = "invoice string, event_id long, ts timestamp, outcome string, state string"


def expiry(created: Column) -> Column:
    return created + F.expr(f"INTERVAL {EXPIRY_HOURS} HOURS")


def payment_history(events: DataFrame, until: Column | None = None) -> DataFrame:
    """invoice, event_id, ts, outcome, state: what each webhook event did, and a row (event_id null) for each expiry.

    An invoice is known from its first "created" on; what comes before is "unknown" and changes nothing. A success completes
    a payment, also one that failed or expired, unless it is completed already ("repeat"); a failure always sets failed, as
    does the expiry of a payment that stayed pending for 24 hours. Later creations are "duplicate"; other events "ignored".
    A pending payment expires if an event of its invoice or ``until`` reaches its hour. ``events``: invoice, event_id, ts,
    type; ties of time go by event_id, a repeated event_id counts once (its first delivery).

    The state before an event is that after the last one which set it, so windows per invoice say it all.
    """
    order = Window.partitionBy("invoice").orderBy("ts", "event_id")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    first = Window.partitionBy("invoice", "event_id").orderBy("ts")
    rows = events.select("invoice", "event_id", "ts", "type").withColumn("delivery", F.row_number().over(first)).where("delivery = 1 OR event_id IS NULL")
    created = F.min(F.when(F.col("type") == "created", F.struct("ts", "event_id"))).over(Window.partitionBy("invoice"))
    rows = rows.withColumn("created", created)
    here = F.struct("ts", "event_id")
    rows = rows.withColumn("known", F.coalesce(here >= F.col("created"), F.lit(False)))
    sets = F.when(F.col("known") & (F.col("type").isin("payment.success", "payment.failed") | (here == F.col("created"))), F.coalesce(*[F.when(F.col("type") == k, v) for k, v in STATES.items()]))
    rows = rows.withColumn("sets", sets)
    # Only the first event that sets a state after the creation can meet an expired payment still pending.
    rows = rows.withColumn("before", F.last("sets", ignorenulls=True).over(past))
    due = expiry(F.col("created.ts"))
    latest = F.max("ts").over(Window.partitionBy("invoice"))
    settled = F.min(F.when(F.col("known") & F.col("type").isin("payment.success", "payment.failed"), F.col("ts"))).over(Window.partitionBy("invoice"))
    reached = F.greatest(latest, until) if until is not None else latest
    expires = F.coalesce((F.coalesce(settled, reached) >= due) & (reached >= due), F.lit(False))
    rows = rows.withColumns({"due": due, "expires": expires})
    lapsed = F.col("expires") & (F.col("ts") >= F.col("due"))
    before = F.when((F.col("before") == "pending") & lapsed, "failed").otherwise(F.col("before"))
    rows = rows.withColumn("before", before)
    outcome = (
        F.when(F.col("type").isin("payment.success", "payment.failed") & ~F.col("known"), "unknown")
        .when(F.col("type") == "created", F.when(here == F.col("created"), "created").otherwise("duplicate"))
        .when(F.col("type") == "payment.success", F.when(F.col("before") == "completed", "repeat").otherwise("completed"))
        .when(F.col("type") == "payment.failed", "failed")
        .otherwise("ignored")
    )
    state = F.coalesce("sets", "before")
    done = rows.select("invoice", "event_id", "ts", outcome.alias("outcome"), state.alias("state"))
    opened = rows.where((here == F.col("created")) & (F.col("type") == "created") & F.col("expires"))
    return done.unionByName(opened.select("invoice", F.lit(None).cast("long").alias("event_id"), F.col("due").alias("ts"), F.lit("expired").alias("outcome"), F.lit("failed").alias("state")))


def reconcile(payments: DataFrame, provider: DataFrame, now: Column) -> DataFrame:
    """invoice, action: what becomes of payments pending for over half an hour by what the provider says of them.

    COMPLETED completes, FAILED fails, NEW and IN_PROGRESS expire after a day and else wait; other answers, and none,
    leave the payment as it is ("error"). ``payments``: invoice, status, created; ``provider``: invoice, answer.
    """
    stale = payments.where((F.col("status") == "pending") & (F.col("created") < now - F.expr(f"INTERVAL {STALE_MINUTES} MINUTES")))
    old = expiry(F.col("created")) < now
    action = (
        F.when(F.col("answer") == "COMPLETED", "completed")
        .when(F.col("answer") == "FAILED", "failed")
        .when(F.col("answer").isin("NEW", "IN_PROGRESS"), F.when(old, "expired").otherwise("wait"))
        .otherwise("error")
    )
    return stale.join(provider, "invoice", "left").select("invoice", action.alias("action"))


def distribution_batch(posts: DataFrame, log: DataFrame, platforms: list[str], size: int) -> DataFrame:
    """platform, slug, attempt, place: per platform up to ``size`` posts never sent to it, newest first, then up to ``size`` retries.

    A post whose last try failed is retried, the longest ago first; one that was sent, or failed for good, isn't. Retries of
    posts that are gone take a place and send nothing. ``posts``: slug, published; ``log``: slug, platform, status, tries, at
    (one row per slug and platform). The window keeps the first rows of each platform before the shuffle.
    """
    places = posts.withColumn("platform", F.explode(F.array(*map(F.lit, platforms))))
    fresh = places.join(log.select("slug", "platform"), ["slug", "platform"], "left_anti")
    newest = Window.partitionBy("platform").orderBy(F.desc("published"), "slug")
    fresh = fresh.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= size).select("platform", "slug", F.lit(0).alias("attempt"), "place")
    oldest = Window.partitionBy("platform").orderBy("at", "slug")
    failed = log.where((F.col("status") == "failed") & F.col("platform").isin(platforms)).withColumn("place", F.row_number().over(oldest)).where(F.col("place") <= size)
    again = failed.join(posts.select("slug"), "slug", "left_semi").select("platform", "slug", F.col("tries").cast("int").alias("attempt"), (F.col("place") + size).alias("place"))
    return fresh.unionByName(again)


def abandoned_polls(payments: DataFrame, every: int = 300, earliest: int = 1500, latest: int = 2100, quiet: int = 3600) -> DataFrame:
    """poll, user, invoice: whom each poll writes to, each user's abandonment once although polls overlap.

    A poll every ``every`` seconds sees payments still pending that began between ``latest`` and ``earliest`` seconds ago (both
    included), takes the last of each user, and skips users who completed a payment that began within ``quiet`` seconds before.
    A payment seen by several polls is written of by the first. ``payments``: invoice, user, created (timestamp), status.
    Each payment makes a row for each poll that can see it, a number that doesn't grow with the data.
    """
    seconds = F.unix_timestamp("created")
    first = F.ceil((seconds + earliest) / every) * every
    last = F.floor((seconds + latest) / every) * every
    seen = payments.where("status = 'pending'").where(first <= last).select("invoice", "user", seconds.alias("at"), F.explode(F.sequence(first, last, F.lit(every).cast("long"))).alias("poll"))
    newest = Window.partitionBy("user", "poll").orderBy(F.desc("at"), F.desc("invoice"))
    seen = seen.withColumn("nth", F.row_number().over(newest)).where("nth = 1")
    done = payments.where("status = 'completed'").select(F.col("user").alias("payer"), seconds.alias("paid"))
    loud = (F.col("payer") == F.col("user")) & (F.col("paid") >= F.col("poll") - quiet) & (F.col("paid") <= F.col("poll"))
    left = seen.join(done, loud, "left_anti")
    once = Window.partitionBy("invoice").orderBy("poll")
    return left.withColumn("nth", F.row_number().over(once)).where("nth = 1").select("poll", "user", "invoice")
