"""Functions of one row inside tasks, whose results leave in batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import from_arrow_schema

#: Rows and characters (or bytes) of a batch that leaves a task; it ends at the first row that reaches either.
BATCH, CHARS = 8192, 4 << 20


def _size(value) -> int:
    return len(value) if isinstance(value, (str, bytes)) else sum(map(_size, value)) if isinstance(value, list) else 0


def packed(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded rows and characters."""
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += sum(map(_size, row))
        if len(held) >= BATCH or chars >= CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), schema.types)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), schema.types)], schema=schema)


def mapped(df: DataFrame, f: Callable[..., Iterator[tuple]], columns: dict[str, pa.DataType]) -> DataFrame:
    """The rows that ``f`` gives for each row of ``df``; a task holds one row of its input and one batch of results as Python values."""
    schema = pa.schema(list(columns.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed((made for batch in batches for row in zip(*batch.columns) for made in f(*(x.as_py() for x in row))), schema)

    return df.mapInArrow(run, from_arrow_schema(schema))
