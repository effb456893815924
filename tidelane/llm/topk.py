"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector is a sparse row of integer weights by dimension ("term"). Each task turns its rows into blocks of postings - for each term
the rows that hold it and their weights - and streams the stored query rows past them, block by block: term by term, a query's
weight times the postings is scattered into a dense array of scores. A partition selection takes each query's best of the block,
and a ranked merge over blocks gives the result. Nothing grows with the corpus but the passes themselves: a task holds one
block of postings, one block of queries and their scores.

Rows with a weight that is no long have postings of their own, in Python's integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelane.storage import open_store, scratch

SCALE = 256
BLOCK_ROWS = 1 << 15
#: A block ends early at about so many components, so that long vectors make smaller blocks.
BLOCK_CELLS = 1 << 22
BLOCK_QUERIES = 64
_LIMIT = 1 << 63


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>) of rows with an id and a vector of finite components."""
    fine = F.forall(F.col("embedding"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)


class Postings:
    """The nonzero components of ``rows`` rows by term: rows ascend within a term, and each term has its greatest size."""

    def __init__(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, rows: int):
        order = np.lexsort((row, term))
        self.rows, self.row, self.weight, term = rows, row[order], weight[order], term[order]
        head = np.flatnonzero(np.diff(term, prepend=-1))
        self.terms, self.at = term[head], np.append(head, len(term))
        self.peak = np.maximum.reduceat(np.abs(self.weight), head).astype(float) if len(head) else np.zeros(0)

    def of(self, row: int) -> dict[int, int]:
        own = np.flatnonzero(self.row == row)
        return dict(zip(self.terms[np.searchsorted(self.at, own, "right") - 1].tolist(), self.weight[own].tolist(), strict=True))


def postings(ids: np.ndarray, vectors: pa.Array) -> list[tuple[np.ndarray, Postings]]:
    """Ids, ascending, and postings of the rows whose weights floor(SCALE * x) are longs, and of the others, as far as there are any."""
    offsets = np.asarray(vectors.offsets).astype(np.int64)
    x = np.asarray(vectors.flatten(), float)
    row = np.repeat(np.arange(len(vectors)), np.diff(offsets))
    term = np.arange(len(x)) - (offsets[:-1] - offsets[0])[row]
    wide = np.zeros(len(vectors), bool)
    wide[row[np.abs(x) >= _LIMIT / SCALE]] = True
    out = []
    for kind in (False, True):
        rows = np.flatnonzero(wide == kind)
        if len(rows):
            rows = rows[np.argsort(ids[rows], kind="stable")]
            place = np.zeros(len(vectors), np.int64)
            place[rows] = np.arange(len(rows))
            own = np.flatnonzero(wide[row] == kind)
            if kind:  # doubles of that size are whole numbers
                weight = np.array([int(v) * SCALE if abs(v) >= 1 << 53 else int(np.floor(v * SCALE)) for v in x[own].tolist()], object)
            else:
                weight = np.floor(x[own] * SCALE).astype(np.int64)
            some = weight != 0
            out.append((ids[rows], Postings(place[row[own]][some], term[own][some], weight[some], len(rows))))
    return out


def _query_blocks(path: str):
    import pyarrow.dataset as ds

    store, root = open_store(path)
    for batch in ds.dataset(root, filesystem=store, format="parquet").to_batches(batch_size=BLOCK_QUERIES, columns=["vec_id", "embedding"]):
        if batch.num_rows:
            yield from postings(np.asarray(batch.column(0)), batch.column(1))


def accumulate(queries: Postings, held: Postings, of=lambda weight: weight) -> np.ndarray:
    """Scores of ``queries`` (a row each) against the rows of ``held``, term at a time; sums of longs are modulo 2^64."""
    scores = np.zeros((queries.rows, held.rows), of(np.zeros(0, np.int64)).dtype)
    for i, j in zip(*np.intersect1d(queries.terms, held.terms, assume_unique=True, return_indices=True)[1:], strict=True):
        a, b = slice(*queries.at[i : i + 2]), slice(*held.at[j : j + 2])
        own, factor, at, weight = queries.row[a], of(queries.weight[a]), held.row[b], of(held.weight[b])
        if len(at) == held.rows:
            scores[own] += factor[:, None] * weight
        else:
            scores[np.ix_(own, at)] += factor[:, None] * weight
    return scores


def beyond(queries: Postings, held: Postings) -> np.ndarray | None:
    """1 where a score is over a long, -1 where it is under, else 0; None if the terms' greatest weights prove that all fit.

    A sum in doubles with its error bound tells nearly all; the others are summed in Python's integers.
    """
    _, i, j = np.intersect1d(queries.terms, held.terms, assume_unique=True, return_indices=True)
    limit = float(_LIMIT)
    if (queries.peak[i] * held.peak[j]).sum() * (1 + 1e-6) < limit:
        return None
    error = accumulate(queries, held, lambda w: np.abs(w).astype(float)) * ((len(i) + 8) * 2.0**-52)
    near = accumulate(queries, held, lambda w: w.astype(float))
    out = np.where(near - error >= limit, 1, np.where(near + error < -limit, -1, 0)).astype(np.int8)
    unsure = (out == 0) & ((near + error >= limit) | (near - error < -limit))
    rows = {c: held.of(c) for c in np.flatnonzero(unsure.any(0)).tolist()}
    for q in np.flatnonzero(unsure.any(1)).tolist():
        own = queries.of(q)
        for c in np.flatnonzero(unsure[q]).tolist():
            score = sum(w * own.get(t, 0) for t, w in rows[c].items())
            out[q, c] = (score >= _LIMIT) - (score < -_LIMIT)
    return out


def scored(queries: Postings, held: Postings) -> tuple[np.ndarray, np.ndarray | None]:
    """Scores as longs, and which are beyond a long: see ``beyond``."""
    if object not in (queries.weight.dtype, held.weight.dtype):
        return accumulate(queries, held), beyond(queries, held)
    exact = accumulate(queries, held, lambda w: w.astype(object))
    out = (exact >= _LIMIT).astype(np.int8) - (exact < -_LIMIT).astype(np.int8)
    return np.where(out == 0, exact, 0).astype(np.int64), out


def select_top(scores: np.ndarray, ids: np.ndarray, query_id: int, k: int) -> np.ndarray:
    """Positions of the k best scores, ties to smaller ids; ``ids`` ascend. Rows of the query's own id are left out."""
    a, b = np.searchsorted(ids, query_id), np.searchsorted(ids, query_id, "right")
    fit = np.delete(np.arange(len(ids)), slice(a, b)) if b > a else np.arange(len(ids))
    if len(fit) > k:
        own = scores[fit]
        least = np.partition(own, len(own) - k)[len(own) - k]
        above = np.flatnonzero(own > least)
        fit = fit[np.concatenate([above, np.flatnonzero(own == least)[: k - len(above)]])]
    return fit


def _best(scores: np.ndarray, out: np.ndarray | None, ids: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the k best, and whether their scores are under a long; those come last, in any order."""
    if out is None or not out.any():
        best = select_top(scores, ids, query_id, k)
        return best, np.zeros(len(best), bool)
    if k > 0 and (out[ids != query_id] > 0).any():
        raise ValueError(f"a score of query {query_id} does not fit a long")
    fit = np.flatnonzero(out == 0)
    best = fit[select_top(scores[fit], ids[fit], query_id, k)]
    under = np.flatnonzero((out < 0) & (ids != query_id))[: k - len(best)]
    return np.append(best, under), np.arange(len(best) + len(under)) >= len(best)


def _search(path: str, k: int):
    def search(batches):
        ids, vectors, rows, size = [], [], 0, 0

        def block():
            own = postings(np.concatenate(ids), pa.concat_arrays(vectors))
            for query_ids, queries in _query_blocks(path):
                for held_ids, held in own:
                    scores, out = scored(queries, held)
                    found = [[], [], [], []]
                    for q, query_id in enumerate(query_ids.tolist()):
                        best, under = _best(scores[q], None if out is None else out[q], held_ids, query_id, k)
                        for column, part in zip(found, (np.full(len(best), query_id), held_ids[best], scores[q, best], under), strict=True):
                            column.append(part)
                    query, vec, score, under = (np.concatenate(x) for x in found)
                    columns = [pa.array(query.astype(np.int64)), pa.array(vec.astype(np.int64)), pa.array(score, mask=under)]
                    yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score"])

        for batch in batches:
            cells = len(batch.column(1).flatten())
            step = max(1, min(BLOCK_ROWS, BLOCK_CELLS * batch.num_rows // max(1, cells)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids.append(np.asarray(part.column(0)))
                vectors.append(part.column(1))
                rows += part.num_rows
                size += len(part.column(1).flatten())
                if rows >= BLOCK_ROWS or size >= BLOCK_CELLS:
                    yield from block()
                    ids, vectors, rows, size = [], [], 0, 0
        if rows:
            yield from block()

    return search


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """For each of ``queries``, the ``k`` rows of ``vectors`` (both: vec_id, embedding) of highest integer inner product.

    Returns query_id, rank from 1, vec_id, score; ties go to the smaller vec_id, and fewer rows if there are fewer. Rows with the
    query's own id are left out. Null ids, null vectors and those with null or non-finite components take no part; an empty vector scores 0.
    Scores are exact for any length and size of components; one of the k best that does not fit a long is an error. Repeated
    candidates count each. Of a repeated query id, each vector is a query, and its ranks run over the scores of all of them.
    Vectors of different lengths meet in the terms that both have. Empty tables give an empty result.
    """
    spark = vectors.sparkSession
    path = scratch(spark, "topk-queries")
    usable(queries).write.parquet(path)
    found = usable(vectors).mapInArrow(_search(path, k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    score = F.coalesce("score", F.raise_error(F.lit("a score does not fit a long")).cast("long"))  # null: under a long, ranked last
    return ranked.select("query_id", "rank", "vec_id", score.alias("score"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """top_k of the embeddings whose vec_id is divisible by 50, against all: query_id, rank, vec_id, score."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors)


SQL = {
    "op6_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.w, c.w)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5""",
}
