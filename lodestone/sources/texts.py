"""Texts of files by their type: plain text and packaged documents; other types are named as such."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import structure
from . import markup
from .shared import materialise

#: Types of files by their extension.
TYPES = {"docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "pdf": "application/pdf", "txt": "text/plain"}


def mime_by_name(name: Column) -> Column:
    """The type of a file by its extension, whatever its case; null if it isn't known."""
    return F.coalesce(*[F.when(F.lower(F.regexp_extract(name, r"([^.]*)$", 1)) == e, m) for e, m in TYPES.items()])


def text_of(files: DataFrame) -> DataFrame:
    """path, text, error of files (path, content) by their type.

    Plain text is UTF-8, wrong bytes becoming replacement characters; a packaged document is its body's paragraphs, a line each.
    Files that can't be read, and those of types without a reader, have an error instead of a text; none gets lost.
    """
    typed = files.select("path", "content", mime_by_name(F.col("path")).alias("type"))
    plain = typed.where(F.col("type") == TYPES["txt"]).select("path", F.make_valid_utf8(F.coalesce(F.col("content").cast("string"), F.lit(""))).alias("text"), F.lit(None).cast("string").alias("error"))
    elements = materialise(markup.file_elements(typed.where(F.col("type") == TYPES["docx"]), "path"), "elements")
    runs = structure.run_rows(elements).withColumn("own_size", F.col("size"))
    body = structure.paragraph_rows(runs).where("in_body").groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), "\n").alias("text"))
    errors = elements.groupBy("key").agg(F.max("error").alias("error"))
    packaged = errors.join(body, "key", "left").select(F.col("key").alias("path"), F.when(F.col("error").isNull(), F.coalesce("text", F.lit(""))).alias("text"), "error")
    other = typed.where(F.col("type").isNull() | ~F.col("type").isin(TYPES["txt"], TYPES["docx"]))
    other = other.select("path", F.lit(None).cast("string").alias("text"), F.concat(F.lit("no reader for "), F.coalesce("type", F.lit("this type"))).alias("error"))
    return plain.unionByName(packaged).unionByName(other)
