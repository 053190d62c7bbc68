"""The payment state machine: fixtures per transition, brute force, and stream against batch."""

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from lodestone.operators import payments
from lodestone.streaming import payments as streaming
from lodestone.streaming.events import run_to_end

T0 = dt.datetime(2024, 1, 1)
EVENTS = "invoice string, event_id long, ts timestamp_ntz, type string"


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def history(spark, *events, until=None):
    df = spark.createDataFrame([("a", i, at(h), t) for i, (h, t) in enumerate(events)], EVENTS)
    rows = payments.payment_history(df, None if until is None else F.lit(at(until)))
    return [(r.outcome, r.state) for r in sorted(rows.collect(), key=lambda r: (r.ts, r.event_id is not None, r.event_id or 0))]


def test_transitions(spark):
    new, ok, no = "created", "payment.success", "payment.failed"
    assert history(spark, (0, ok), (1, no)) == [("unknown", None), ("unknown", None)]  # no such invoice
    assert history(spark, (0, new), (1, ok), (2, ok)) == [("created", "pending"), ("completed", "completed"), ("repeat", "completed")]
    assert history(spark, (0, new), (1, no), (2, ok), (3, no)) == [("created", "pending"), ("failed", "failed"), ("completed", "completed"), ("failed", "failed")]
    assert history(spark, (0, new), (1, ok), (2, "refund"), (3, new)) == [("created", "pending"), ("completed", "completed"), ("ignored", "completed"), ("duplicate", "completed")]
    assert history(spark, (0, new), (23.9, ok)) == [("created", "pending"), ("completed", "completed")]
    assert history(spark, (0, new), (24, ok)) == [("created", "pending"), ("expired", "failed"), ("completed", "completed")]
    assert history(spark, (0, new), (25, "subscription.cancelled"), (26, no)) == [("created", "pending"), ("expired", "failed"), ("ignored", "failed"), ("failed", "failed")]
    assert history(spark, (0, new)) == [("created", "pending")]
    assert history(spark, (0, new), until=24) == [("created", "pending"), ("expired", "failed")] and history(spark, (0, new), until=23) == [("created", "pending")]
    assert history(spark, (0, new), (1, ok), until=99) == [("created", "pending"), ("completed", "completed")]


def by_loops(events, until):
    out, status, created, seen = [], None, None, set()
    for event_id, ts, kind in [*sorted(events, key=lambda e: (e[1], e[0])), (None, until, None)]:
        if event_id in seen:
            continue
        seen.add(event_id)
        if status == "pending" and ts >= created + dt.timedelta(hours=24):
            status = "failed"
            out.append((None, created + dt.timedelta(hours=24), "expired", status))
        if event_id is None:
            break
        done = "ignored"
        if kind == "created":
            done = "duplicate" if created else "created"
            if not created:
                status, created = "pending", ts
        elif kind.startswith("payment") and not created:
            done = "unknown"
        elif kind == "payment.success":
            done, status = ("repeat" if status == "completed" else "completed"), "completed"
        elif kind == "payment.failed":
            done = status = "failed"
        out.append((event_id, ts, done, status))
    return out


def drawn(n, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        kind = rng.choices(["created", "payment.success", "payment.failed", "other"], (3, 3, 2, 1))[0]
        rows.append((f"i{rng.randrange(40)}", k, at(round(rng.random() * 200, 2)), kind))
    return rows + [(i, e, t + dt.timedelta(hours=1), k) for i, e, t, k in rows[::9]]  # delivered again


def test_batch_equals_brute_force(spark):
    rows = drawn(400, 1)
    got = {(r.invoice, r.event_id, r.ts, r.outcome, r.state) for r in payments.payment_history(spark.createDataFrame(rows, EVENTS), F.lit(at(240))).collect()}
    first = {}
    for i, e, t, k in sorted(rows, key=lambda r: r[2]):
        first.setdefault((i, e), (i, e, t, k))
    want = set()
    for invoice in {r[0] for r in rows}:
        want |= {(invoice, *x) for x in by_loops([r[1:] for r in first.values() if r[0] == invoice], at(240))}
    assert got == want


def test_stream_equals_batch(spark, tmp_path):
    spark.conf.set(*streaming.STORE)
    try:
        rows = sorted(drawn(300, 2), key=lambda r: r[2]) + [("last", 10_000, at(400), "other"), ("last", 10_001, at(401), "other")]
        cuts = [0, 90, 200, len(rows) - 2, len(rows) - 1, len(rows)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            spark.createDataFrame(rows[a:b], EVENTS).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        schema = spark.read.parquet(str(tmp_path / "in/0")).schema
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        got = run_to_end(streaming.payment_history(stream, "1 minute"), f"s{uuid.uuid4().hex}", "append", str(tmp_path / "checkpoint")).collect()
    finally:
        spark.conf.unset(streaming.STORE[0])
    want = payments.payment_history(spark.createDataFrame(rows, EVENTS), F.lit(at(400))).collect()
    plain = lambda rs: sorted((r.invoice, r.event_id or -1, r.ts.replace(tzinfo=None), r.outcome, r.state or "") for r in rs)
    assert plain(got) == plain(want)


def test_reconciliation(spark):
    rows = [("new", "pending", 0.9), ("young", "pending", 0.3), ("old", "pending", 25), ("edge", "pending", 24), ("paid", "pending", 2), ("no", "pending", 2), ("odd", "pending", 2), ("gone", "pending", 30), ("done", "completed", 30)]
    df = spark.createDataFrame([(i, s, at(-h)) for i, s, h in rows], "invoice string, status string, created timestamp_ntz")
    provider = spark.createDataFrame([("new", "NEW"), ("young", "COMPLETED"), ("old", "IN_PROGRESS"), ("edge", "NEW"), ("paid", "COMPLETED"), ("no", "FAILED"), ("odd", "?"), ("done", "FAILED")], "invoice string, answer string")
    got = {r.invoice: r.action for r in payments.reconcile(df, provider, F.lit(T0)).collect()}
    assert got == {"new": "wait", "old": "expired", "edge": "wait", "paid": "completed", "no": "failed", "odd": "error", "gone": "error"}


def test_distribution_takes_new_posts_then_retries(spark):
    posts = spark.createDataFrame([(f"p{i}", at(i)) for i in range(6)], "slug string, published timestamp_ntz")
    log = spark.createDataFrame([("p5", "vk", "sent", 0, at(1)), ("p4", "vk", "failed", 1, at(9)), ("p3", "vk", "failed", 2, at(8)), ("x", "vk", "failed", 1, at(2)), ("p2", "vk", "permanently_failed", 3, at(1))], "slug string, platform string, status string, tries int, at timestamp_ntz")
    got = sorted(map(tuple, payments.distribution_batch(posts, log, ["vk", "habr"], 2).collect()))
    assert got == [("habr", "p4", 0, 2), ("habr", "p5", 0, 1), ("vk", "p0", 0, 2), ("vk", "p1", 0, 1), ("vk", "p3", 2, 4)]


def test_overlapping_polls_write_once(spark):
    minute = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [("a", "u", minute(0), "pending"), ("b", "v", minute(0), "pending"), ("b2", "v", minute(2), "pending"), ("c", "w", minute(0), "pending"), ("c2", "w", minute(-20), "completed"), ("d", "x", minute(0), "pending"), ("d2", "x", minute(-40), "completed")]
    got = {r.invoice: r.poll - int(T0.replace(tzinfo=dt.timezone.utc).timestamp()) for r in payments.abandoned_polls(spark.createDataFrame(rows, "invoice string, user string, created timestamp_ntz, status string")).collect()}
    # u at the first poll; v's older payment at the first, the newer one when it comes into view; x's payment is an hour back by the first poll after 20 minutes
    assert got == {"a": 1500, "b": 1500, "b2": 1800, "d": 1500}


@pytest.mark.parametrize("kind", ["created", "payment.success", "payment.failed", "other"])
def test_steps_never_lose_the_creation(kind):
    for status, created in ((None, None), ("pending", 5), ("completed", 5), ("failed", 5)):
        after = streaming.PaymentMachine.step(status, created, kind, 9)
        assert (after[1] is None) == (created is None and kind != "created")
