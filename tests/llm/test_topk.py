import math
import random

import numpy as np
from pyspark.sql import functions as F

from tidelane.llm import topk

FIELDS = "vec_id long, embedding array<double>, score string, rank int"


def brute(rows, k):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, w in {i: w for i, w in good if i % 50 == 0}.items():
        scored = sorted(((-sum(a * b for a, b in zip(w, c, strict=False)), i) for i, c in good if i != q))
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 37)
    rng = random.Random(1)
    rows = [(i, [rng.choice([0.0, 0.0, 0.5, -0.25, rng.random()]) for _ in range(rng.choice([6, 6, 6, 3]))], "x", 1) for i in range(300)]
    rows += [(400, None, None, None), (450, [0.1, None], None, None), (500, [float("nan")] * 6, None, None), (550, [float("inf")] * 6, None, None), (None, [0.1] * 6, None, None), (600, [], None, None)]
    vectors = spark.createDataFrame(rows, FIELDS)
    got = topk.top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors).collect()
    assert {tuple(r) for r in got} == brute(rows, 5) and len(got) == len(brute(rows, 5))


def test_few_rows_repeats_and_empty_tables(spark):
    vectors = spark.createDataFrame([(0, [1.0], None, None), (0, [1.0], None, None), (1, [1.0], None, None), (1, [1.0], None, None)], FIELDS)
    assert [tuple(r) for r in topk.top_k(vectors.where("vec_id = 0"), vectors).orderBy("rank").collect()] == [(0, r, 1, 65536) for r in (1, 2, 3, 4)]
    assert topk.top_k(vectors.limit(0), vectors).count() == 0 and topk.top_k(vectors, vectors.limit(0)).count() == 0


def test_selection_breaks_ties_by_id():
    scores, ids = np.array([5, 9, 5, 5, 1]), np.array([2, 3, 4, 6, 8])
    assert sorted(ids[topk.select_top(scores, ids, 99, 3)].tolist()) == [2, 3, 4]
    assert sorted(ids[topk.select_top(scores, ids, 3, 2)].tolist()) == [2, 4]


def _exact(rows, k):
    whole = {i: [math.floor(256 * x) for x in v] for i, v, *_ in rows}
    out = set()
    for q in (i for i in whole if i % 50 == 0):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], c, strict=False)), i) for i, c in whole.items() if i != q)
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


def test_long_vectors_and_great_components_take_part(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(rng.choice([64, 768, 1536]))], "x", 1) for i in range(120)]
    rows += [(200, [6e5, *[0.5] * 767], None, None), (201, [-2e6] * 3, None, None), (250, [3.0, -3e9, 3e9, 0.25], None, None), (251, [0.0, 4e9, 4e9, 1.0], None, None)]
    vectors = spark.createDataFrame(rows, FIELDS)
    got = {tuple(r) for r in topk.top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors).collect()}
    assert got == _exact(rows, 5) and {200, 250} <= {r[0] for r in got} and any(r[2] == 251 for r in got)


def test_scores_beyond_a_long(spark):
    def top(rows, k):
        vectors = spark.createDataFrame([(i, v, None, None) for i, v in rows], FIELDS)
        return [tuple(r) for r in topk.top_k(vectors.where("vec_id = 0"), vectors, k).orderBy("rank").collect()]

    great = 2.0**26
    low = [(0, [great, great]), (1, [1.0, 0.0]), (2, [-great, 0.0]), (3, [great, -great])]
    assert top(low, 2) == [(0, 1, 1, 2**42), (0, 2, 3, 0)]  # the third is under a long, but not asked for
    for rows, k in ((low, 3), ([*low, (4, [great, 0.0])], 1)):
        try:
            top(rows, k)
        except Exception as e:  # noqa: BLE001 - of Spark or of Python
            assert "not fit a long" in str(e)
        else:
            raise AssertionError("no error")


def test_weights_that_are_no_longs_take_part(spark):
    rows = [(0, [0.0, 1.0, 2.0]), (1, [2.0**56, 3.0, 0.5]), (2, [1e30, -1.0, 4.0]), (3, [1.0, 1.0, 1.0]), (4, [-(2.0**55), 0.0, 9.0]), (50, [2.0**56 + 2.0**10, 0.0, 0.0])]
    vectors = spark.createDataFrame([(i, v, None, None) for i, v in rows], FIELDS)
    got = {tuple(r) for r in topk.top_k(vectors.where("vec_id = 0"), vectors).collect()}
    assert got == {(q, r, i, s) for q, r, i, s in _exact(rows, 5) if q == 0} and {r[2] for r in got} == {1, 2, 3, 4, 50}
    weak = vectors.where("vec_id IN (0, 3)")  # the query's own weight is no long
    query = spark.createDataFrame([(100, [2.0**57, 0.0, 0.0], None, None)], FIELDS)
    assert [tuple(r) for r in topk.top_k(query, weak.where("vec_id = 0")).collect()] == [(100, 1, 0, 0)]


def test_vectors_of_a_repeated_query_id_are_queries_each(spark):
    vectors = spark.createDataFrame([(i, v, None, None) for i, v in [(0, [1.0, 0.0]), (0, [0.0, 2.0]), (1, [3.0, 1.0]), (2, [0.0, 5.0])]], FIELDS)
    got = [tuple(r) for r in topk.top_k(vectors.where("vec_id = 0"), vectors, 3).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 10 * 65536), (0, 2, 1, 3 * 65536), (0, 3, 1, 2 * 65536)]
