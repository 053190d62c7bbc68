"""XML parts as element rows: one pass of a parser inside tasks; everything after it is joins, windows and sums over rows."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from functools import lru_cache
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements whose nearest instance each row names: table, table row, cell, paragraph, run.
HOLDERS = ("w:tbl", "w:tr", "w:tc", "w:p", "w:r")
HELD, NO_HOLDER = {h: i for i, h in enumerate(HOLDERS)}, (None,) * len(HOLDERS)
#: Rows of a batch that leaves a task.
BATCH = 8192
#: The parts that hold structure, and names of picture files.
PARTS = ("word/document.xml", "word/styles.xml")
MEDIA = re.compile(r"^word/media/.*\.(png|jpg|jpeg|gif|bmp|emf|wmf)$", re.IGNORECASE)

_KINDS = [
    ("key", pa.string(), "string"), ("part", pa.string(), "string"), ("seq", pa.int32(), "int"), ("block", pa.int32(), "int"), ("path", pa.string(), "string"),
    ("tbl", pa.int32(), "int"), ("tr", pa.int32(), "int"), ("tc", pa.int32(), "int"), ("p", pa.int32(), "int"), ("r", pa.int32(), "int"),
    ("rel", pa.string(), "string"), ("attrs", pa.map_(pa.string(), pa.string()), "map<string,string>"), ("text", pa.string(), "string"), ("error", pa.string(), "string"),
]
ELEMENTS = ", ".join(f"{name} {kind}" for name, _, kind in _KINDS)
_NAMES = [name for name, _, _ in _KINDS]


@lru_cache(maxsize=4096)
def _below(path: str | None, rel: str | None, tag: str) -> tuple[str, str | None]:
    """Paths of a child: from the body, and from the nearest paragraph."""
    return tag if path is None else f"{path}/{tag}", "" if tag == "w:p" else tag if rel == "" else None if rel is None else f"{rel}/{tag}"


def elements_of(key: str, part: str, xml: bytes) -> Iterator[list[tuple]]:
    """The elements of one part in the order of their ends, some at a time.

    ``seq`` numbers elements by their starts, ``block`` the children of the body (or of a root without one), ``path`` leads
    from there; ``rel`` leads from the nearest paragraph (empty for itself, null outside). ``text`` is an element's own.
    """
    made: list[tuple] = []
    open_: list[tuple] = []  # per open element: seq, block, path, holders, path below the paragraph, attributes, pieces of text, tag
    seq, block = 0, -1

    def start(tag: str, attrs: list) -> None:
        nonlocal seq, block
        _, within, path, near, rel, _, _, above = open_[-1] if open_ else (None, None, None, NO_HOLDER, None, None, None, None)
        if path is not None:
            path, rel = _below(path, rel, tag)
        elif open_ and (above == "w:body" or (len(open_) == 1 and tag != "w:body")):
            block += 1
            within = block
            path, rel = _below(None, rel, tag)
        else:
            rel = _below(None, rel, tag)[1]
        if (at := HELD.get(tag)) is not None:
            near = (*near[:at], seq, *near[at + 1 :])
        open_.append((seq, within, path, near, rel, attrs, [], tag))
        seq += 1

    def end(tag: str) -> None:
        at, within, path, near, rel, attrs, pieces, _ = open_.pop()
        made.append((key, part, at, within, path or tag, *near, rel, attrs, "".join(pieces), None))

    def text(piece: str) -> None:
        open_[-1][6].append(piece)

    parser = expat.ParserCreate()
    parser.buffer_text = parser.ordered_attributes = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
    step = 1 << 16
    for k in range(0, max(1, len(xml)), step):
        parser.Parse(xml[k : k + step], k + step >= len(xml))
        yield made
        made = []


def _failed(key: str, part: str | None, error: Exception) -> tuple:
    return (key, part, *[None] * (len(_NAMES) - 3), f"{type(error).__name__}: {error}")


def _parts(key: str, content: bytes) -> Iterator[list[tuple]]:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            names = archive.namelist()
            for part in PARTS:
                if part in names:
                    yield from elements_of(key, part, archive.read(part))
            if PARTS[0] not in names:
                yield [_failed(key, PARTS[0], KeyError("no document part"))]
            yield [(key, name, *[None] * (len(_NAMES) - 2)) for name in filter(MEDIA.match, names)]
    except (zipfile.BadZipFile, expat.ExpatError) as e:
        yield [_failed(key, None, e)]


def _maps(found: Iterable[list[str] | None]) -> pa.MapArray:
    """Names and values that follow each other as maps; none stays null."""
    flat: list[str] = []
    starts: list[int | None] = []
    for attrs in found:
        starts.append(None if attrs is None else len(flat) // 2)
        flat += attrs or ()
    return pa.MapArray.from_arrays(pa.array([*starts, len(flat) // 2], pa.int32()), pa.array(flat[::2], pa.string()), pa.array(flat[1::2], pa.string()))


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_maps(c) if name == "attrs" else pa.array(c, k) for c, (name, k, _) in zip(zip(*rows), _KINDS)], _NAMES)


def _in_batches(found: Iterator[list[tuple]]) -> Iterator[pa.RecordBatch]:
    """Batches of rows, over the bounds of parts; what is read at once of a part is at most ``elements_of``'s step."""
    rows: list[tuple] = []
    for some in found:
        rows += some
        while len(rows) >= BATCH:
            yield _packed(rows[:BATCH])
            del rows[:BATCH]
    if rows:
        yield _packed(rows)


def _each(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The rows of batches, one at a time."""
    for batch in batches:
        for row in zip(*(batch.column(c) for c in names)):
            yield tuple(x.as_py() for x in row)


def file_elements(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """Element rows of the document and style parts of packaged files, and a row per picture; unreadable files give one row with an error."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_batches(some for k, data in _each(batches, "key", "content") for some in _parts(k, data or b""))

    return files.selectExpr(f"CAST({key} AS STRING) AS key", f"{content} AS content").mapInArrow(read, ELEMENTS)


def part_elements(parts: DataFrame) -> DataFrame:
    """Element rows of parts given as text: key, part, xml; a part that isn't XML by its name gives one row.

    A part that isn't well-formed gives what precedes the fault and a row with the error.
    """

    def parsed(key: str, part: str, xml: str | None) -> Iterator[list[tuple]]:
        if not part.endswith(".xml"):
            yield [(key, part, *[None] * (len(_NAMES) - 2))]
            return
        try:
            yield from elements_of(key, part, (xml or "").encode())
        except expat.ExpatError as e:
            yield [_failed(key, part, e)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_batches(some for row in _each(batches, "key", "part", "xml") for some in parsed(*row))

    return parts.selectExpr("CAST(key AS STRING) AS key", "part", "xml").mapInArrow(read, ELEMENTS)
