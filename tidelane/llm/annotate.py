"""Adding computed columns to rows of any other columns, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidelane.llm import textops


def add_columns(df: DataFrame, compute: Callable[[pa.RecordBatch], list[pa.Array]], fields: T.StructType) -> DataFrame:
    """``df`` with ``fields`` (new names) appended. ``compute`` gets a batch of all of ``df``'s columns, by position and by name, and returns their arrays."""
    names = df.columns
    inner = [f"c{i}" for i in range(len(names))]
    taken = {x.lower() for x in names} & {f.name.lower() for f in fields}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are there already")

    def run(batches):
        for batch in textops.released(batches):
            made = compute(batch.rename_columns(names))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*inner, *(f"x{i}" for i in range(len(made)))])

    schema = T.StructType([T.StructField(i, f.dataType) for i, f in zip(inner, df.schema.fields, strict=True)] + [T.StructField(f"x{i}", f.dataType) for i, f in enumerate(fields)])
    return df.toDF(*inner).mapInArrow(run, schema).toDF(*names, *fields.names)


def parse(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
