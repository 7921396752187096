"""Shared helpers of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without the columns whose names (in any case) an operator is about to add."""
    taken = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken])


def add_columns(df: DataFrame, fields: list[tuple[str, T.DataType]], start: Callable[[], Callable[[pa.RecordBatch], dict]]) -> DataFrame:
    """``df`` with columns computed in Python from whole Arrow batches; other columns pass through untouched.

    ``start`` runs once per task and returns the function that maps a batch to the new columns. A new column takes the
    place of an input column of the same name (in any case).
    """
    names = [n for n, _ in fields]
    kept = [c for c in df.columns if c.lower() not in {n.lower() for n in names}]
    schema = T.StructType([*[df.schema[c] for c in kept], *[T.StructField(n, t, True) for n, t in fields]])
    kinds = [to_arrow_type(t) for _, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = start()
        for b in batches:
            new = of(b)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *[pa.array(new[n], k) for n, k in zip(names, kinds, strict=True)]], names=[*kept, *names])

    return df.mapInArrow(run, schema)
