"""Ordered folds per key: the last resort for state that resets on its own output.

Rows are hash-partitioned by key and sorted inside partitions, and a generator consumes each key's rows as a stream, so a key of any size
needs memory for its state only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Row = dict[str, Any]


def ordered_fold(df: DataFrame, keys: list[str], order: list[str | Column], step: Callable[[Iterator[Row]], Iterable[tuple]], schema: str, batch_rows: int = 4096) -> DataFrame:
    """``keys`` and what ``step`` yields (tuples of ``schema``) for the ordered rows of each key."""
    added = T.StructType.fromDDL(schema)
    out = T.StructType([df.schema[k] for k in keys] + added.fields)
    arrow = to_arrow_schema(out, timezone="UTC") if "timezone" in to_arrow_schema.__code__.co_varnames else to_arrow_schema(out)
    ordered = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def rows(batches) -> Iterator[Row]:
        for batch in batches:
            yield from batch.to_pylist()

    def run(batches):
        held: list[tuple] = []
        for key, own in groupby(rows(batches), key=lambda r: tuple(r[k] for k in keys)):
            for made in step(own):
                held.append((*key, *made))
                if len(held) >= batch_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), arrow.types, strict=True)], schema=arrow)
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), arrow.types, strict=True)], schema=arrow)

    return ordered.mapInArrow(run, out)
