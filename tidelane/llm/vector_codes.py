"""Vector code compression: each part of a vector becomes the index of the nearest entry of that part's codebook.

Codebooks are fitted by Lloyd's rounds in Elkan's form. Between rounds a stored table keeps, for each part of each vector, its entry, an upper bound of the
distance to it and one lower bound for each entry; when entries have moved, bounds move by as much. A part is held against an entry only if
neither its lower bound nor half the distance between the entries is strictly above the upper bound, so whatever is left out is strictly farther, and all
else, ties included, is decided by squared distances in whole numbers.

Components are whole numbers floor(scale * x). Where all squares are below 2^53, doubles hold them exactly; vectors and entries with greater
components ("wide") are compared in Python's integers, behind a bound that keeps usual vectors from meeting wide entries.

A round is a pass that writes the next table and a pass over its entries alone that adds up components by entry, in tasks, then by key. The driver
gets one row for each part and entry, and sends the codebooks out: both are bounded by ``entries`` vectors.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.llm import textops
from tidelane.storage import discard, materialize

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
BATCH_ROWS = 2048
BROADCAST_LABELS = 100_000
_UP, _DOWN = 1 + 1e-12, 1 - 1e-12
_STATE = "vec_id long, label string, embedding array<double>, code binary, upper binary, lower binary"


def whole(x: float) -> int:
    """floor(SCALE * x), exact for any finite double; those of 2^53 and more are whole."""
    return int(x) * SCALE if abs(x) >= 1 << 53 else int(np.floor(x * SCALE))


def _roots(squares, factor: float) -> np.ndarray:
    """Square roots of whole numbers of any size as doubles, a bit above or below by ``factor``; what is beyond doubles is infinite."""
    squares = np.asarray(squares)
    if squares.dtype != object:
        return np.sqrt(squares) * factor
    return np.array([(lambda r: float(r) * factor if r < 1 << 1000 else np.inf)(isqrt(s) + (factor > 1)) for s in squares.ravel().tolist()]).reshape(squares.shape)


def _half(x: np.ndarray) -> np.ndarray:
    """``x`` as 16-bit floats that are never above it."""
    return np.where(x < 1e-4, 0, np.minimum(x * (1 - 2.0**-10), 65504)).astype(np.float16)


@dataclass
class Vectors:
    """A batch of vectors: components of narrow ones as doubles (zero for wide ones), and wide ones as lists of integers by row."""

    x: np.ndarray
    wide: dict[int, list[int]]

    @classmethod
    def read(cls, column: pa.Array, width: int, limit: int) -> Vectors:
        offsets = np.asarray(column.offsets).astype(np.int64)
        flat = np.asarray(column.flatten(), float)
        row = np.repeat(np.arange(len(column)), np.diff(offsets))
        x = np.zeros((len(column), width))
        x[row, np.arange(len(flat)) - (offsets[:-1] - offsets[0])[row]] = flat
        far = np.flatnonzero((np.abs(x) >= limit / SCALE - 1).any(axis=1))
        wide = {i: [whole(v) for v in x[i].tolist()] for i in far.tolist()}
        x[far] = 0
        return cls(np.floor(x * SCALE), wide)

    def part(self, p: int, size: int) -> Vectors:
        return Vectors(self.x[:, p * size : (p + 1) * size], {i: v[p * size : (p + 1) * size] for i, v in self.wide.items()})


def _apart(a: list[int], b: list[int]) -> int:
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


class Book:
    """The entries of one part, ready to be searched."""

    def __init__(self, entries: list[list[int]], limit: int):
        self.entries = entries
        self.wide = np.array([any(abs(v) >= limit for v in e) for e in entries])
        self.x = np.array([[0] * len(e) if w else e for e, w in zip(entries, self.wide, strict=True)], float).reshape(len(entries), -1)
        self.square = (self.x**2).sum(axis=1)
        between = self.square[:, None] - 2 * self.x @ self.x.T + self.square
        if self.wide.any():
            between = between.astype(object)
            between[:, :] = [[_apart(a, b) if self.wide[i] or self.wide[j] else int(between[i, j]) for j, b in enumerate(entries)] for i, a in enumerate(entries)]
        self.half = _roots(between, _DOWN) / 2
        others = self.half + np.where(np.eye(len(entries), dtype=bool), np.inf, 0)
        self.nearest = others.min(axis=1)  # half the distance to the nearest other entry
        # no narrow vector is nearer to a wide entry than this
        self.floor = np.array([float(min(max(abs(v) for v in e) - limit, 1 << 1000)) * _DOWN if w else 0.0 for e, w in zip(entries, self.wide, strict=True)])

    def pairs(self, own: Vectors, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Squared distances of rows to entries, pair by pair; integers of any size if one of them needs it."""
        out = ((own.x[rows] - self.x[cols]) ** 2).sum(axis=1)
        odd = np.flatnonzero(self.wide[cols] | np.isin(rows, list(own.wide))) if own.wide or self.wide.any() else ()
        if len(odd):
            out = np.array([int(v) for v in out.tolist()], object)
            for k in odd.tolist():
                i = int(rows[k])
                out[k] = _apart(own.wide.get(i) or [int(v) for v in own.x[i].tolist()], self.entries[cols[k]])
        return out

    def search(self, own: Vectors, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        """Moves each row's ``code`` to its nearest entry, ties to the lower index, and its bounds with it. New rows have an infinite upper bound and lower bounds of 0."""
        n, k = lower.shape
        if self.wide.any():
            narrow = np.setdiff1d(np.arange(n), list(own.wide))
            lower[narrow] = np.maximum(lower[narrow], self.floor)
        rows = np.flatnonzero(upper >= self.nearest[code])
        if not len(rows):
            return
        near = self.pairs(own, rows, code[rows])
        upper[rows] = _roots(near, _UP)
        reach = upper[rows, None]
        open_ = (lower[rows] <= reach) & (self.half[code[rows]] <= reach)
        open_[np.arange(len(rows)), code[rows]] = False
        if not own.wide and not self.wide.any() and open_.sum() * 8 > open_.size:
            x = own.x[rows]
            table = (x**2).sum(axis=1)[:, None] - 2 * x @ self.x.T + self.square
            lower[rows] = np.where(open_, _roots(table, _DOWN), lower[rows])
            table[~open_] = np.inf
        else:
            i, j = np.nonzero(open_)
            far = self.pairs(own, rows[i], j)
            lower[rows[i], j] = _roots(far, _DOWN)
            table = np.full((len(rows), k), np.inf, object if object in (far.dtype, near.dtype) else float)
            table[i, j] = far
        table[np.arange(len(rows)), code[rows]] = near
        if table.dtype == object:
            best = np.array([min(range(k), key=lambda j: (line[j], j)) for line in table], np.int64)
        else:
            best = table.argmin(axis=1)
        lower[rows, code[rows]] = np.maximum(lower[rows, code[rows]], _roots(near, _DOWN))
        code[rows] = best
        upper[rows] = _roots(table[np.arange(len(rows)), best], _UP)


@dataclass
class Codebooks:
    """``entries[part][index]``: integer components; ``moved[part][index]``: an upper bound of how far an entry went in its last round."""

    entries: list[list[list[int]]]
    moved: np.ndarray
    width: int

    @property
    def size(self) -> int:
        return self.width // len(self.entries)

    @property
    def limit(self) -> int:
        """Components of less make all squared distances doubles that are exact."""
        return isqrt((1 << 51) // max(1, self.size))

    def books(self) -> list[Book]:
        return [Book(e, self.limit) for e in self.entries]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for part in self.entries for entry in part for v in entry).encode()).hexdigest()

    def updated(self, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> Codebooks:
        fresh = [[[v // sums[p, e][0] for v in sums[p, e][1]] if (p, e) in sums else entry for e, entry in enumerate(part)] for p, part in enumerate(self.entries)]
        moved = [[_roots(np.array([_apart(a, b)], object), _UP)[0] for a, b in zip(old, new, strict=True)] for old, new in zip(self.entries, fresh, strict=True)]
        return Codebooks(fresh, np.array(moved), self.width)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label as text, embedding array<double>) of the rows whose vector is there and has finite components only."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(x.isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), x.alias("embedding"))


def _assign(shared):
    def run(batches):
        held = shared.value
        now = held.books()
        k, parts = len(held.entries[0]), len(held.entries)
        for whole_batch in textops.released(batches):
            for at in range(0, whole_batch.num_rows, BATCH_ROWS):
                batch = whole_batch.slice(at, BATCH_ROWS)
                n = batch.num_rows
                own = Vectors.read(batch.column(2), held.width, held.limit)
                if batch.num_columns == 3:
                    code, upper, lower = np.zeros((n, parts), np.int64), np.full((n, parts), np.inf), np.zeros((n, parts, k), np.float32)
                else:
                    code, upper, lower = (np.frombuffer(b"".join(batch.column(c).to_pylist()), t).reshape(n, parts, -1) for c, t in ((3, np.uint8), (4, np.float64), (5, np.float16)))
                    code, upper = code[:, :, 0].astype(np.int64), upper[:, :, 0].copy()
                    upper = (upper + np.take_along_axis(held.moved, code.T, axis=1).T) * _UP
                    lower = np.maximum((lower.astype(np.float32) - held.moved.astype(np.float32) * np.float32(1 + 2.0**-20)) * np.float32(1 - 2.0**-20), 0)
                for p, book in enumerate(now):
                    new_code, new_upper, new_lower = code[:, p].copy(), upper[:, p].copy(), lower[:, p].astype(float)
                    book.search(own.part(p, held.size), new_code, new_upper, new_lower)
                    code[:, p], upper[:, p], lower[:, p] = new_code, new_upper, np.minimum(new_lower, 1e30) * (1 - 2.0**-20)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], *(pa.array([r.tobytes() for r in x], pa.binary()) for x in (code.astype(np.uint8), upper, _half(lower)))],
                    names=["vec_id", "label", "embedding", "code", "upper", "lower"],
                )

    return run


def _partial_sums(shared):
    def run(batches):
        held = shared.value
        k, parts, m = len(held.entries[0]), len(held.entries), held.size
        count, total, great = np.zeros((parts, k), np.int64), np.zeros((parts, k * m), np.int64), {}
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, BATCH_ROWS):
                batch = whole_batch.slice(at, BATCH_ROWS)
                own = Vectors.read(batch.column(0), held.width, held.limit)
                code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, parts).astype(np.int64)
                for p in range(parts):
                    part = own.part(p, m)
                    count[p] += np.bincount(code[:, p], minlength=k)
                    total[p] += np.bincount((code[:, p, None] * m + np.arange(m)).ravel(), part.x.ravel(), k * m).astype(np.int64)  # sums of a batch are exact doubles
                    for i, x in part.wide.items():
                        kept = great.setdefault((p, int(code[i, p])), [0] * m)
                        kept[:] = [a + b for a, b in zip(kept, x, strict=True)]
        p, e = np.nonzero(count)
        sums = [[str(a + b) for a, b in zip(total[i, j * m : (j + 1) * m].tolist(), great.get((i, j), [0] * m), strict=True)] for i, j in zip(p.tolist(), e.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), pa.array(sums, pa.list_(pa.string()))], names=["part", "entry", "rows", "sums"])

    return run


def _added(batches):
    """Partial sums of the same part and entry added up; a task holds one sum for each of its keys."""
    held: dict[tuple[int, int], list] = {}
    for batch in batches:
        for part, entry, rows, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            old = held.get((part, entry), [0, [0] * len(sums)])
            held[part, entry] = [old[0] + rows, [a + int(b) for a, b in zip(old[1], sums, strict=True)]]
    if held:
        yield pa.RecordBatch.from_pylist(
            [{"part": p, "entry": e, "rows": n, "sums": [str(v) for v in x]} for (p, e), (n, x) in held.items()],
            schema=pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("rows", pa.int64()), ("sums", pa.list_(pa.string()))]),
        )


_SUMS = "part int, entry int, rows long, sums array<string>"


def _first_codebooks(rows: DataFrame, parts: int, entries: int) -> Codebooks | None:
    widest = rows.agg(F.max(F.size("embedding"))).first()[0]
    if widest is None:
        return None
    width = -(-widest // parts) * parts
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    whole_rows = [[whole(v) for v in r[0]] + [0] * (width - len(r[0])) for r in first]
    size = width // parts
    return Codebooks([[v[p * size : (p + 1) * size] for v in whole_rows] for p in range(parts)], np.zeros((parts, len(whole_rows))), width)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """``(codes, codebooks)`` of ``vectors`` (vec_id, label, embedding): vec_id, label (as text), code (a byte for each part) and error, a row for each usable vector.

    Vectors that are null or hold null or non-finite components are left out. Codebooks start as the parts of the ``entries`` (256 at most) smallest vec_ids,
    null ids last and rows of one id by their components; with fewer rows there are fewer entries. Unused entries stay. Repeated rows count each. Shorter vectors, and lengths
    that ``parts`` doesn't divide, count as followed by zeros. Components of any finite size are exact; an error that fits no long is an error.
    An empty table has no codes and no codebooks.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is a byte: 1 to 256 entries")
    spark, rows = vectors.sparkSession, usable(vectors)
    held = _first_codebooks(rows, parts, entries)
    if held is None:
        return rows.select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error")), None
    state, stored = rows, None
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(held)
        state = materialize(state.mapInArrow(_assign(shared), _STATE), "vector-state")
        if stored is not None:
            discard(stored)
        stored = state
        sums = state.select("embedding", "code").mapInArrow(_partial_sums(shared), _SUMS).repartition("part", "entry").mapInArrow(_added, _SUMS)
        held = held.updated({(r["part"], r["entry"]): (r["rows"], [int(v) for v in r["sums"]]) for r in sums.collect()})
    shared = spark.sparkContext.broadcast(held)
    final = state.mapInArrow(_assign(shared), _STATE).select("vec_id", "label", "embedding", "code")
    codes = materialize(final.mapInArrow(_errors(shared), "vec_id long, label string, code binary, error long"), "vector-codes")
    if stored is not None:
        discard(stored)
    return codes, held


def _errors(shared):
    def run(batches):
        held = shared.value
        books, parts = held.books(), len(held.entries)
        for batch in batches:
            own = Vectors.read(batch.column(2), held.width, held.limit)
            code = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(batch.num_rows, parts).astype(np.int64)
            error = sum(np.array([int(v) for v in book.pairs(own.part(p, held.size), np.arange(batch.num_rows), code[:, p]).tolist()], object) for p, book in enumerate(books))
            if batch.num_rows and max(error) >= 1 << 63:
                raise ValueError("an error does not fit a long")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(error.tolist(), pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with label_error, the sum of ``error`` over equal labels, nulls together. Sums are broadcast if there are few labels, else rows and sums meet by label and a salt."""
    sums = materialize(codes.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")).withColumnRenamed("label", "_label"), "label-errors")
    same = F.col("label").eqNullSafe(F.col("_label"))
    if sums.count() <= BROADCAST_LABELS:
        return codes.join(F.broadcast(sums), same).drop("_label")
    salts = 32
    salted = codes.withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts)).cast("int"))
    spread = sums.withColumn("_of", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(spread, same & (F.col("_salt") == F.col("_of"))).drop("_label", "_salt", "_of")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as codes of four parts with 256 entries after four rounds: code, error, its sum by label, and a digest of the codebooks."""
    codes, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    out = with_label_errors(codes)
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    fine = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    steps = [
        f"v AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) AS k, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS w FROM embeddings WHERE {fine})",
        f"p AS MATERIALIZED (SELECT k, j AS part, w[j * len(w) // {parts} + 1:(j + 1) * len(w) // {parts}] AS x FROM v, range({parts}) r(j))",
        f"c0 AS MATERIALIZED (SELECT part, k - 1 AS e, x AS c FROM p WHERE k <= {entries})",
    ]
    for r in range(rounds + 1):
        far = "list_dot_product(x, x) + list_dot_product(c, c) - 2 * list_dot_product(x, c)"
        steps.append(f"a{r} AS MATERIALIZED (SELECT p.part, k, any_value(x) AS x, min({{'d': ({far})::BIGINT, 'e': e}}) AS best FROM p JOIN c{r} c ON p.part = c.part GROUP BY p.part, k)")
        if r < rounds:
            steps.append(f"m{r} AS (SELECT part, best.e AS e, i, floor(sum(x[i]::HUGEINT) / count(*)) AS y FROM a{r}, generate_series(1, (SELECT max(len(x)) FROM p)) g(i) GROUP BY part, best.e, i)")
            steps.append(f"n{r} AS (SELECT part, e, list(y::DOUBLE ORDER BY i) AS c FROM m{r} GROUP BY part, e)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT part, e, coalesce(n.c, o.c) AS c FROM c{r} o LEFT JOIN n{r} n USING (part, e))")
    steps.append(f"d AS (SELECT k, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY k)")
    steps.append(f"h AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda y: y::BIGINT), ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c{rounds})")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN d USING (k), h"


SQL = {"op12_vector_codes": _sql()}
