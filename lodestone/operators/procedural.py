"""Operators whose next step depends on the one before: chunking, greedy matching, byte budgets, pseudonyms, tokens."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from ..sources.arrow import mapped
from pyspark.sql import functions as F

#: A chunk's least and most rows, its best length, and what a cut scores more within so many rows of that.
LEAST, MOST, BEST, NEAR, BONUS = 15, 70, 50, 5, 10


def chunks(paragraphs: DataFrame) -> DataFrame:
    """doc_id, idx and chunk: rows of a document are cut before the row that scores best, the first of equals, from 15 to
    under 70 rows after the last cut; a rest of up to 70 rows is the last chunk. ``paragraphs``: doc_id, idx, score.

    A cut depends on the one before, so a document is cut in one go, by its scores alone; documents are independent.
    """

    def cut(doc_id: int, places: list[int], scores: list[int]) -> Iterator[tuple]:
        start, number = 0, 0
        while start < len(scores):
            end = len(scores)
            if end - start > MOST:
                end = max(range(start + LEAST, start + MOST), key=lambda i: (scores[i] + BONUS * (abs(i - start - BEST) <= NEAR), -i))
            yield from ((doc_id, idx, number) for idx in places[start:end])
            start, number = end, number + 1

    rows = F.sort_array(F.collect_list(F.struct("idx", "score"))).alias("rows")
    grouped = paragraphs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(rows).select("doc_id", "rows.idx", "rows.score")
    return mapped(grouped, cut, {"doc_id": pa.int64(), "idx": pa.int32(), "chunk": pa.int32()})


def greedy_matches(anchors: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, anchor and line: each anchor in order takes the first unused line that contains its text; else null.

    Both sides of a document are gathered by one shuffle; a line once taken is gone for later anchors.
    """

    def match(doc_id: int, places: list[int], texts: list[str], idx: list[int], text: list[str]) -> Iterator[tuple]:
        free = list(zip(idx, text))
        for place, wanted in zip(places, texts):
            hit = next((k for k, (_, t) in enumerate(free) if wanted in t), None)
            yield doc_id, place, None if hit is None else free.pop(hit)[0]

    asks = lambda df, asks: df.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct("idx", "text").alias("row"), F.lit(asks).alias("asks"))
    gathered = [F.sort_array(F.collect_list(F.when(c, F.col("row")))).alias(n) for n, c in (("anchors", F.col("asks")), ("lines", ~F.col("asks")))]
    both = asks(anchors, True).unionByName(asks(lines, False)).groupBy("doc_id").agg(*gathered)
    return mapped(both.select("doc_id", *[F.col(f"{n}.{c}").alias(f"{n}_{c}") for n in ("anchors", "lines") for c in ("idx", "text")]), match, {"doc_id": pa.int64(), "anchor": pa.int32(), "line": pa.int32()})


def byte_chunks(documents: DataFrame, budget: int) -> DataFrame:
    """doc_id, part and text: texts cut to at most ``budget`` bytes of UTF-8 at line ends, else blanks, else characters.

    A text is encoded once and cut by offsets. The budget must hold any one character.
    """
    if budget < 4:
        raise ValueError("a character takes up to 4 bytes")

    def split(text: str) -> Iterator[str]:
        data, start = text.encode(), 0
        while len(data) - start > budget:
            end = start + budget
            at = max(data.rfind(b"\n", start + 1, end), -1)
            at = at if at > 0 else data.rfind(b" ", start + 1, end)
            if at < 0:
                at = end
                while data[at] & 0xC0 == 0x80:
                    at -= 1
            yield data[start:at].decode()
            while at < len(data) and data[at] in b"\n ":
                at += 1
            start = at
        yield data[start:].decode()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, k, part) for d, t in zip(batch["doc_id"], batch["text"]) for k, part in enumerate(split(t or ""))]
            yield pd.DataFrame(rows, columns=["doc_id", "part", "text"])

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id long, part int, text string")


def keyed_digest(message: Column, secret: bytes) -> Column:
    """HMAC-SHA256 of a text as lowercase hex: two nested digests over the padded key, all in the JVM."""
    key = (secret if len(secret) <= 64 else hashlib.sha256(secret).digest()).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def signed_tokens(df: DataFrame, columns: list[str], secret: bytes) -> DataFrame:
    """Adds ``token``: HMAC-SHA256 over the colon-joined columns."""
    return df.withColumn("token", keyed_digest(F.concat_ws(":", *columns), secret))


def inherited(styles: DataFrame, depth: int = 12) -> DataFrame:
    """name and value of each style: its own or that of the nearest ancestor that has one; cycles end at ``depth``.

    ``styles`` has name, parent and value. Each round resolves twice as many steps, by a join of the table with itself.
    """
    current = styles.select("name", "parent", "value")
    steps = 1
    while steps < depth:
        up = current.select(F.col("name").alias("parent"), F.col("parent").alias("grand"), F.col("value").alias("up_value"))
        current = current.join(up, "parent", "left").select("name", F.when(F.col("value").isNull(), F.col("grand")).alias("parent"), F.coalesce("value", "up_value").alias("value"))
        steps *= 2
    return current.select("name", "value")


#: Syllables that pseudonyms are made of.
SYLLABLES = ("lo", "rem", "ip", "sum", "do", "lor", "sit", "am", "et", "con")


def pseudonym(word: str) -> str:
    """A word of equal length and case shape, the same for the same word: syllables chosen by a rolling hash."""
    h = 0
    for c in word.lower():
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
    made = ""
    while len(made) < len(word):
        made += SYLLABLES[h % len(SYLLABLES)]
        h = (h * 1103515245 + 12345) & 0x7FFFFFFF
    made = made[: len(word)]
    return made.upper() if word.isupper() else made.capitalize() if word[:1].isupper() else made


def pseudonyms(documents: DataFrame) -> DataFrame:
    """doc_id and text with every word of four letters or more replaced."""
    def replaced(doc_id: int, text: str | None) -> Iterator[tuple]:
        yield doc_id, text if text is None else re.sub(r"[^\W\d_]{4,}", lambda m: pseudonym(m.group()), text)

    return mapped(documents.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text"), replaced, {"doc_id": pa.int64(), "text": pa.string()})


def spread(runs: list[str], fixed: str) -> list[str]:
    """An edited text over the runs of the original. One of equal length is cut as the runs are; else what both begin and
    end with stays in its run, and the rest goes to the run where they begin to differ."""
    original = "".join(runs)
    if len(original) == len(fixed):
        ends = [sum(map(len, runs[: k + 1])) for k in range(len(runs))]
        return [fixed[a:b] for a, b in zip([0, *ends], ends)]
    head = 0
    while head < min(len(original), len(fixed)) and original[head] == fixed[head]:
        head += 1
    tail = 0
    while tail < min(len(original), len(fixed)) - head and original[-1 - tail] == fixed[-1 - tail]:
        tail += 1
    middle, out, at, placed = fixed[head : len(fixed) - tail], [], 0, False
    for k, run in enumerate(runs):
        end = at + len(run)
        before, after = run[: max(0, min(len(run), head - at))], run[max(0, min(len(run), len(original) - tail - at)) :]
        here = not placed and (head < end or k == len(runs) - 1)
        out.append(before + (middle if here else "") + (after if end > head else ""))
        placed, at = placed or here, end
    return out


def redistribute(edits: DataFrame) -> DataFrame:
    """``edits`` (doc_id, runs, fixed) with the fixed text spread over the runs."""

    def run(doc_id: int, runs: list[str], fixed: str) -> Iterator[tuple]:
        yield doc_id, spread(runs, fixed)

    return mapped(edits.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "runs", "fixed"), run, {"doc_id": pa.int64(), "runs": pa.list_(pa.string())})
