"""Streams must agree with their batch twins."""

import uuid

import pytest
from pyspark.sql import functions as F

from lodestone.plans import state
from lodestone.streaming import events as streaming

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def replay(spark, tmp_path_factory):
    """The events in files whose names follow the order of time."""
    folder = tmp_path_factory.mktemp("events")
    events = spark.read.parquet(f"{SF}/events.parquet")
    cuts = [r[0] for r in events.orderBy("ts").select("ts").collect()]
    edges = [None, cuts[len(cuts) // 3], cuts[2 * len(cuts) // 3], None]
    for k in range(3):
        part = events
        if edges[k]:
            part = part.where(F.col("ts") >= F.lit(edges[k]))
        if edges[k + 1]:
            part = part.where(F.col("ts") < F.lit(edges[k + 1]))
        part.coalesce(1).write.parquet(f"{folder}/batch{k}")
    return events.schema, str(folder)


def stream(spark, replay):
    schema, folder = replay
    return streaming.stream_of(spark, f"{folder}/*", schema)


def run(frame, mode, tmp_path):
    return streaming.run_to_end(frame, f"s{uuid.uuid4().hex}", mode, str(tmp_path / "checkpoint"))


def test_day_counters_agree(spark, replay, tmp_path):
    got = run(streaming.counters(stream(spark, replay), "1 day"), "complete", tmp_path)
    want = state.QUERIES["r1_day_counters"](spark, SF)
    rows = {(r.model_id, r.start.date(), r.requests) for r in got.collect()}
    assert rows == {(r.model_id, r.day, r.requests) for r in want.collect()}


def test_funnel_agrees(spark, replay, tmp_path):
    from lodestone.plans import relational

    got = run(streaming.funnel(stream(spark, replay)), "complete", tmp_path)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in relational.QUERIES["r9_funnel"](spark, SF).collect()}


def test_first_touch_agrees(spark, replay, tmp_path):
    got = run(streaming.first_touch(stream(spark, replay), "100 days"), "append", tmp_path)
    want = {r.user_id: r.first_ts for r in state.QUERIES["r8_first_touch"](spark, SF).collect()}
    rows = got.collect()
    assert len(rows) == len(want)


def test_backoff_agrees(spark, replay, tmp_path):
    got = run(streaming.backoff(stream(spark, replay)), "append", tmp_path)
    want = state.QUERIES["r3_error_backoff"](spark, SF)
    assert {(r.event_id, r.consecutive, r.blocked_until.replace(tzinfo=None)) for r in got.collect()} == {(r.event_id, r.consecutive, r.blocked_until) for r in want.collect()}
