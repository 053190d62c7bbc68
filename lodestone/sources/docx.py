"""Word-processor files: a reader that gives paragraph rows, and a writer.

A file is a zip of XML parts. Reading one is a small per-file helper; Spark deals files to tasks and everything after
(classification, checks, repairs) works on rows.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .arrow import mapped

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
#: Fixed parts that a minimal file needs.
CONTENT_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
RELATIONS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'

PARAGRAPH = {"key": pa.string(), "idx": pa.int32(), "in_table": pa.bool_(), "text": pa.string(), "style": pa.string(), "alignment": pa.string(), "bold": pa.bool_(), "size": pa.float64(), "error": pa.string()}


def docx_files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of the files below a folder, as Spark's binary source reads them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)


def parse(content: bytes) -> list[tuple]:
    """Paragraphs in document order, also those in tables and content controls."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        root = ElementTree.fromstring(archive.read("word/document.xml"))
    tag = lambda name: f"{{{W}}}{name}"
    in_tables = {id(p) for t in root.iter(tag("tbl")) for p in t.iter(tag("p"))}
    rows = []
    for idx, p in enumerate(root.iter(tag("p"))):
        value = lambda path: (x := p.find(path)) is not None and x.get(tag("val")) or None  # noqa: B023, E731
        run = f"{tag('r')}/{tag('rPr')}/"
        size = value(run + tag("sz"))
        text = "".join("\t" if x.tag == tag("tab") else x.text or "" for x in p.iter() if x.tag in (tag("t"), tag("tab")))
        rows.append((idx, id(p) in in_tables, text, value(f"{tag('pPr')}/{tag('pStyle')}"), value(f"{tag('pPr')}/{tag('jc')}"), p.find(run + tag("b")) is not None, float(size) / 2 if size else None))
    return rows


def paragraphs_of(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """A row per paragraph of each file; a file that can't be read gives one row with its error."""

    def read(k: str, data: bytes) -> Iterator[tuple]:
        try:
            yield from ((k, *r, None) for r in parse(data))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
            yield (k, *[None] * (len(PARAGRAPH) - 2), f"{type(e).__name__}: {e}")

    return mapped(files.selectExpr(f"CAST({key} AS STRING) AS key", f"{content} AS content"), read, PARAGRAPH)


def build(paragraphs: list[tuple[str, str | None]]) -> bytes:
    """A minimal file from (text, alignment) pairs."""
    body = "".join(f'<w:p>{f"<w:pPr><w:jc w:val={chr(34)}{a}{chr(34)}/></w:pPr>" if a else ""}<w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r></w:p>' for t, a in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("[Content_Types].xml", CONTENT_TYPES)
        archive.writestr("_rels/.rels", RELATIONS)
        archive.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def documents_to_docx(documents: DataFrame) -> DataFrame:
    """doc_id and content: a file per document, a paragraph per line."""

    def write(doc_id: int, text: str | None) -> Iterator[tuple]:
        yield doc_id, build([(line, "center" if k == 0 else "both") for k, line in enumerate((text or "").split("\n"))])

    return mapped(documents.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text"), write, {"doc_id": pa.int64(), "content": pa.binary()})
