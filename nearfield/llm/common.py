"""Shared pieces of the training-data operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A word is a run without blanks, tabs, line ends, vertical tabs and form feeds.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Rows that a worker unpacks at once.
SLICE = 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = {ord(a): b for a, b in zip(UPPER, LOWER, strict=True)}


def lower_ascii(text: str) -> str:
    """A-Z in lower case, everything else as it is."""
    return text.lower() if text.isascii() else text.translate(ASCII_LOWER)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text) if text else []


def text_or_empty(column: str = "text") -> F.Column:
    return F.coalesce(F.col(column), F.lit(""))


def map_rows(df: DataFrame, make: Callable[[], Callable[..., list]], schema: str) -> DataFrame:
    """Apply a row function to Arrow batches, one output row for each input row.

    make() runs once in each Python worker's task and returns f(*input values) -> output values, so that
    vocabularies and caches are built where they are used. No state passes between rows except caches.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):  # a batch holds as many rows as Spark likes; only a slice of it is unpacked at once
                columns = [c.to_pylist() for c in batch.slice(at, SLICE).columns]
                made = list(zip(*(f(*values) for values in zip(*columns, strict=True)), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(list(v), type=t.type) for v, t in zip(made, out, strict=True)], schema=out)

    return df.mapInArrow(run, schema)
