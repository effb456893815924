"""Nearest vectors of a table of known ones, in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.storage import open_store, scratch

BLOCK = 1024


def _blocks(path: str):
    """(names, vectors by length) of the known vectors, block by block."""
    import pyarrow.dataset as ds

    store, root = open_store(path)
    for batch in ds.dataset(root, filesystem=store, format="parquet").to_batches(batch_size=BLOCK):
        if batch.num_rows:
            yield batch.column(0).to_pylist(), _by_length(batch.column(1))


def _by_length(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length the rows that have it, and these as rows of unit length; a row of length zero stays so."""
    offsets = np.asarray(column.offsets).astype(np.int64)
    flat, size = np.asarray(column.flatten(), float), np.diff(offsets)
    out = {}
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n)
        x = flat[(offsets[rows] - offsets[0])[:, None] + np.arange(n)]
        length = np.sqrt((x * x).sum(axis=1, keepdims=True))
        out[n] = rows, np.divide(x, length, out=np.zeros_like(x), where=length > 0)
    return out


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there and has finite components only."""
    x = F.col(vector).cast("array<double>")
    return df.where(x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))


def nearest(df: DataFrame, known: DataFrame, key: str, vector: str, name: str, least: float) -> DataFrame:
    """For each row its ``key``, the ``name`` of the known vector of greatest cosine similarity above ``least`` (ties to the smaller name), and the score.

    The known vectors are stored and streamed past each batch in blocks, so that neither side grows in a task. Vectors that are null or have null or non-finite components take no part on
    either side, and so have no row; vectors of different lengths aren't alike, and one of length zero is like none.
    """
    path = scratch(df.sparkSession, "known-vectors")
    usable(known, vector).select(F.col(name).alias("name"), F.col(vector).cast("array<double>").alias("vector")).write.parquet(path)
    kind = dict(known.dtypes)[name]

    def run(batches):
        for batch in batches:
            best: list = [None] * batch.num_rows
            own = _by_length(batch.column(1))
            for names, blocks in _blocks(path):
                for n, (held, block) in blocks.items():
                    if n not in own:
                        continue
                    rows, mine = own[n]
                    scores = mine @ block.T
                    top = scores.max(axis=1)
                    for r in np.flatnonzero(top > least).tolist():
                        i, score = int(rows[r]), float(top[r])
                        if best[i] is None or score >= best[i][0]:
                            found = min(names[held[j]] for j in np.flatnonzero(scores[r] == top[r]).tolist())
                            if best[i] is None or score > best[i][0] or found < best[i][1]:
                                best[i] = (score, found)
            at = [i for i, x in enumerate(best) if x]
            names_of = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_pydict({key: names_of, name: [best[i][1] for i in at], "score": [best[i][0] for i in at]}, schema=pa.schema([(key, names_of.type), (name, _ARROW[kind]), ("score", pa.float64())]))

    rows = usable(df, vector).select(key, F.col(vector).cast("array<double>").alias(vector))
    return rows.mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, {name} {kind}, score double")


_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
