"""Values read one by one in Python, and what is made of each as rows that go out in small batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and characters that a batch of results holds, but for those of its last value.
ROWS, CHARACTERS = 4096, 1 << 22
KINDS = {"int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}


def told_of(rows: DataFrame, key: str, value: str, told: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    """key and what `told` tells of each value (null: an empty text), a row for each tuple. schema: names and KINDS of a tuple's fields.

    A task holds one of Spark's batches of values as it came, one value as a text, and one batch of results, whatever the number of rows."""
    fields = [field.split() for field in schema.replace(":", "").split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out, held = [], [], 0
            for i, text in enumerate(batch.column(1)):
                found = told(text.as_py() or "")
                at += [i] * len(found)
                out += found
                held += sum(len(x) for row in found for x in row if isinstance(x, str))
                if len(out) >= ROWS or held >= CHARACTERS:
                    yield _batch(batch, key, fields, at, out)
                    at, out, held = [], [], 0
            if out:
                yield _batch(batch, key, fields, at, out)

    return rows.select(key, F.col(value).cast("string").alias(value)).mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, {schema}")


def _batch(batch: pa.RecordBatch, key: str, fields: list[list[str]], at: list[int], out: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(column, KINDS[kind]) for column, (_, kind) in zip(zip(*out, strict=True), fields, strict=True)]
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *columns], [key, *(name for name, _ in fields)])
