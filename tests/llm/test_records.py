"""Operators 3 and 8 and the pipeline on small tables."""

import base64
import gzip
import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.llm import chat, queries, warc

from .data import words

PAGES = "page_id long, url string, html string, offset string, file int"


def test_archives_read_back(spark):
    html = ["<p>one</p>", "<p>two</p>", "<p>one</p>", None, "", "x" * 300_000, "<p>one</p>", "日本\r\n\r\nWARC/1.1"]
    rows = [(10 + i, f"http://e.org/ä {i}", h, "x", 1) for i, h in enumerate(html)] + [(None, None, "<p>two</p>", "x", 1)]
    index = warc.write_warc(spark.createDataFrame(rows, PAGES))
    got = {r.page_id: r for r in warc.read_records(index).collect()}
    first = {}
    for page_id, _, h, *_ in rows:
        payload = (h or "").encode()
        head = first.setdefault(payload, page_id)
        r = got[page_id]
        assert r.payload_bytes == len(payload) and r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if page_id == head else ("revisit", head))
        assert r.payload == (bytearray(payload) if page_id == head else None)
    chosen = index.where("page_id in (10, 15)")
    some = warc.read_records(chosen.unionByName(chosen), payload=False).collect()
    assert sorted(r.page_id for r in some) == [10, 15] and not any(r.payload for r in some)


def test_compressible_pages_leave_in_bounded_batches(spark, monkeypatch):
    monkeypatch.setattr(warc, "BATCH", 1 << 20)
    rows = [(i, "u", f"{i}" + "x" * 500_000, "", 0) for i in range(20)]
    got = warc.read_records(warc.write_warc(spark.createDataFrame(rows, PAGES))).collect()
    assert {(r.page_id, r.payload_bytes) for r in got} == {(i, 500_000 + len(str(i))) for i in range(20)}


def test_small_payloads_are_written_in_full(spark):
    rows = [(1, "u", "same", "", 0), (2, "u", "same", "", 0)]
    got = warc.read_records(warc.write_warc(spark.createDataFrame(rows, PAGES), least_bytes=5)).collect()
    assert [r.record_type for r in got] == ["response"] * 2


def test_archive_is_a_sequence_of_gzip_members(spark):
    index = warc.write_warc(spark.createDataFrame([(1, "u", "a", "", 0), (2, "v", "b", "", 0)], PAGES)).collect()
    for name in {r.file for r in index}:
        store, path = warc.filesystem(name)
        with store.open_input_stream(path, compression=None) as f:
            text = gzip.decompress(f.read())
        assert text.count(b"WARC/1.1\r\n") == sum(r.file == name for r in index)


def test_no_pages(spark):
    assert warc.read_records(warc.write_warc(spark.createDataFrame([], PAGES))).collect() == []


def brute_chat(conversations):
    best = {}
    for c in sorted(conversations):
        best.setdefault(tuple(conversations[c]), c)
    return {c: t for t, c in best.items() if not any(len(o) > len(t) and o[: len(t)] == t for o in best)}


def test_snapshots_collapse(spark):
    rng = random.Random(1)
    conversations, n = {}, 0
    for _ in range(30):
        full = [(rng.choice(("user", "assistant")), " ".join(words(rng, 3, 5))) for _ in range(rng.randrange(1, 7))]
        for _ in range(rng.randrange(1, 4)):
            conversations[n] = full[: rng.randrange(1, len(full) + 1)]
            n += 1
    rows = [(c, k, r, t, "x") for c, turns in conversations.items() for k, (r, t) in enumerate(turns)]
    rows += rows[:5]  # repeated rows count once
    rng.shuffle(rows)
    got = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, hashes string")).collect()}
    want = brute_chat(conversations)
    assert got.keys() == want.keys()
    for c, turns in want.items():
        assert got[c].n_turns == len(turns)
        assert got[c].rendered == "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)


def test_prefixes_that_end_among_turns_of_one_number(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 1, "user", "c"), (2, 0, "user", "a"), (3, 0, "user", "b"), (4, 0, "user", "a"), (4, 0, "user", "a"), (4, 7, "user", "b")]
    got = {r.conv_id: r.n_turns for r in chat.format_conversations(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: 3, 3: 1}  # "a" and "a b" begin the first; "b" doesn't


def test_a_very_long_conversation(spark):
    rows = [(c, k, "user", f"{k}") for c, n in ((1, 20_000), (2, 19_999), (3, 5)) for k in range(n)]
    got = chat.maximal_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [r.conv_id for r in got] == [1]


def test_chat_nulls_and_nothing(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert chat.format_conversations(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, 0, None, None), (1, None, "user", "first"), (None, 0, "user", "lost")]
    got = chat.format_conversations(spark.createDataFrame(rows, schema)).collect()
    assert [tuple(r) for r in got] == [(1, 2, "<|im_start|>user\nfirst<|im_end|>\n<|im_start|>\n<|im_end|>\n")]


@pytest.mark.parametrize("name", ["op3_warc_index_and_ranges", "op8_chat_snapshot_collapse"])
def test_queries_equal_their_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for t in ("pages", "conversations"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = queries.QUERIES[name](spark, folder)
    relation = duck.sql(queries.ORACLE_SQL[name]).select(*df.columns)
    assert sorted(map(tuple, df.collect()), key=str) == sorted(relation.fetchall(), key=str)


def test_pipeline_runs_stage_by_stage(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120)
    columns = docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, "/root/testdata/sf0.001"), name)
        if name != "packing":
            assert docs.columns == columns
            assert docs.where(F.col("text").isNull()).count() == 0
            counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and docs.count() >= counts[-1] > 0
