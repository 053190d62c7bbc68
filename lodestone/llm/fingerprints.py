"""Canonical exact document fingerprints (operator 2)."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import few, materialise


def canonical(text: str | None) -> bytes:
    """Compatibility-normalised, case-folded text with white space folded to single blanks and trimmed, in UTF-8."""
    if not text:
        return b""
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode()


def digest(canon: bytes) -> str:
    """128 bits of xxh3 over the canonical text."""
    return xxhash.xxh3_128_hexdigest(canon)


def canonical_texts(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with the columns fingerprint and canon (the canonical bytes) in place of the text."""
    columns = [c for c in rows.columns if c != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text), "fingerprint string, canon binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            canons = [canonical(t) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array([digest(c) for c in canons], pa.string()), pa.array(canons, pa.binary())], [*columns, "fingerprint", "canon"])

    return rows.mapInArrow(run, schema)


def collisions(documents: DataFrame, prints: DataFrame) -> DataFrame:
    """Byte comparison inside equal buckets: doc_id, fingerprint and ``other`` of rows whose bytes differ from their bucket's first.

    Of a bucket with several rows, the canonical bytes of the row with the smallest doc_id are compared with each
    other's. The bytes of buckets with one row aren't looked at. Bytes don't meet in a bucket: each row is joined with
    its bucket's first, and a large bucket is split by Spark's handling of skewed joins.
    """
    shared = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null").drop("n")
    members = materialise(prints.join(shared, "fingerprint").select("doc_id", "fingerprint", "first_id"), "members")
    ids = few(members.select(F.col("doc_id").alias("id")).distinct())
    made = canonical_texts(documents.join(ids, documents["doc_id"] == ids["id"], "left_semi").select("doc_id", "text"))
    firsts = made.join(members.select(F.col("first_id").alias("f_id"), F.col("fingerprint").alias("f_print")).distinct(), (F.col("doc_id") == F.col("f_id")) & (F.col("fingerprint") == F.col("f_print"))).select("fingerprint", F.col("canon").alias("first_canon"))
    return made.join(firsts, "fingerprint").where("canon <> first_canon").select("doc_id", "fingerprint", F.sha2("canon", 256).alias("other"))


def resolved(documents: DataFrame, prints: DataFrame) -> DataFrame:
    """``prints`` (doc_id, fingerprint, ...) with hash collisions told apart.

    Should two canonical texts share the 128-bit hash, those that differ from the bucket's first get the SHA-256 of
    their bytes appended, so that equal fingerprints mean equal canonical texts.
    """
    other = materialise(collisions(documents, prints).distinct(), "collisions")
    if not other.limit(1).count():
        return prints
    joined = prints.join(other, ["doc_id", "fingerprint"], "left")
    return joined.withColumn("fingerprint", F.concat_ws("-", "fingerprint", "other")).select(*prints.columns)


def fingerprint_documents(documents: DataFrame) -> DataFrame:
    """doc_id and fingerprint for each row of ``documents`` (doc_id, text).

    Equal canonical texts have equal fingerprints, different ones different. A null text counts as empty. Repeated rows
    get the same fingerprint; rows with null doc_id are fingerprinted but not compared byte by byte.
    """
    return resolved(documents, materialise(canonical_texts(documents.select("doc_id", "text")).drop("canon"), "prints"))


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(doc_id: int | None, text: str, canon: bytes, following: str, following_canon: bytes) -> tuple:
    """The result for a document and the next: its last quarter is replaced by the next one's beginning."""
    k = len(text) // 4
    edited = text[: len(text) - k] + following[:k]
    edited_canon = canonical(edited)
    return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), digest(canon), digest(edited_canon), float(canon == edited_canon), float(canon == following_canon)


def compare_with_edits(documents: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its edit with the next document's beginning, and their likeness (0 or 1).

    The next document is that of the next larger doc_id, after the last the first; null doc_ids come first, ties go by
    text, a single row is followed by itself. Rows are dealt by ranges of doc_id and sorted within a range, so a task
    meets each row with its next but for the range's last; the first and last row of each range, two texts a task, are
    kept aside and joined along the order of ranges.
    """
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    schema = f"{RESULT}, part int, edge string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        before = None
        for batch in batches:
            found = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                canon = canonical(text)
                if before is None:
                    found.append((doc_id, *[None] * 6, part, "first", text))
                else:
                    found.append((*compared(*before, text, canon), part, None, None))
                before = doc_id, text, canon
            yield batch_of(found)
        if before is not None:
            yield batch_of([(before[0], *[None] * 6, part, "last", before[1])])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = [*kinds, pa.int32(), pa.string(), pa.string()]
        made = list(zip(*rows)) if rows else [[]] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, types)], [*columns, "part", "edge", "text"])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "next_text")))
            made = list(zip(*[compared(d, t, canonical(t), n, canonical(n)) for d, t, n in rows])) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, kinds)], columns)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    made = materialise(sorted_rows.mapInArrow(run, schema), "compared")
    firsts = made.where("edge = 'first'").select("part", F.col("text").alias("first_text"))
    ring = Window.orderBy("part")
    ring = firsts.withColumn("next_text", F.coalesce(F.lead("first_text").over(ring), F.first("first_text").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    lasts = made.where("edge = 'last'").select("doc_id", "text", "part").join(ring.select("part", "next_text"), "part")
    return made.where("edge is null").select(*columns).unionByName(lasts.select("doc_id", "text", "next_text").mapInArrow(close, RESULT))
