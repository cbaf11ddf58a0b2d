"""Arrow batch helpers: run Python over whole batches while every other column passes through untouched."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def add_columns(df: DataFrame, inputs: list[str], fields: list[T.StructField], make: Callable[[], Callable[..., list[pa.Array]]]) -> DataFrame:
    """Append columns computed from `inputs`, one Arrow batch at a time.

    make() runs once per Python task and returns f(*columns) -> one Arrow array per field. A column of the same
    name (without regard to case) is replaced. Empty tables keep their schema.
    """
    names = {f.name.lower() for f in fields}
    keep = [f for f in df.schema.fields if f.name.lower() not in names]
    schema = T.StructType([*keep, *fields])
    kept, wanted = [f.name for f in keep], list(inputs)
    new = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            if b.num_rows:
                got = f(*[b.column(b.schema.get_field_index(c)) for c in wanted])
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), *got], [*kept, *new])

    return df.mapInArrow(run, schema)


def explode_rows(df: DataFrame, keep: list[str], inputs: list[str], fields: list[T.StructField], make: Callable[[], Callable[..., tuple[list[int], list[pa.Array]]]]) -> DataFrame:
    """One input row to any number of output rows: f(*columns) -> (index of the source row of each output row, arrays).

    The result has the columns of `keep` and then `fields`.
    """
    by_name = {f.name: f for f in df.schema.fields}
    schema = T.StructType([*(by_name[k] for k in keep), *fields])
    new = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            if b.num_rows:
                index, got = f(*[b.column(b.schema.get_field_index(c)) for c in inputs])
                at = pa.array(index, pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)).take(at) for c in keep), *got], [*keep, *new])

    return df.mapInArrow(run, schema)
