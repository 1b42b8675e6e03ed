"""One pass of Arrow batches over whole texts that adds columns to the rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Bytes of text handled at once; a longer text is handled alone.
PART_BYTES = 1 << 20


def parts(texts: pa.Array, most: int = PART_BYTES) -> Iterator[tuple[int, int]]:
    """(from, rows) of runs of texts with at most so many bytes, or of one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        rows = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")) - at)
        yield at, rows
        at += rows


def add_columns(docs: DataFrame, make: Callable[[], Callable[[list[str]], list[pa.Array]]], fields: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) and those of ``fields``, made from the texts (null as empty).

    ``make`` is called once a task and returns a function of a batch's texts. A column of ``docs``
    that has the name of a new one gives way to it.
    """
    names = re.findall(r"(?:^|, )(\w+) (?![^<]*>)", fields)
    kept = docs.select(*[F.col(f"`{c}`") for c in (keep or docs.columns) if c not in names])
    columns = kept.columns
    n = len(columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    # a kept text column of strings is read where it is, else the text goes along as one more
    at_column = columns.index(text) if text in columns and dict(kept.dtypes)[text] == "string" else n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for at, rows in parts(batch.column(at_column)):
                part = batch.slice(at, rows)
                texts = [t or "" for t in part.column(at_column).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *f(texts)], names=[*columns, *names])

    small_batches(docs.sparkSession)
    extra = [F.col(f"`{text}`").cast("string").alias("_whole")] if at_column == n else []
    return docs.select(*[F.col(f"`{c}`") for c in columns], *extra).mapInArrow(run, ", ".join(x for x in (schema, fields) if x))
