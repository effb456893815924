import hashlib
import math
import random
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from tidelane.llm import vector_codes as V

FIELDS = "vec_id long, embedding array<double>, label int, code string, error int"


def plain(rows, parts=4, entries=256, rounds=4):
    """Codes, errors and the codebooks' digest in Python's integers, every vector against every entry."""
    kept = [(i, v, label) for i, v, label, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max(len(v) for _, v, _ in kept) // parts) * parts
    m = width // parts
    whole = [[math.floor(Fraction(x) * 1024) for x in v] + [0] * (width - len(v)) for _, v, _ in kept]
    cut = [[w[p * m : (p + 1) * m] for w in whole] for p in range(parts)]
    books = [[list(x) for x in part[:entries]] for part in cut]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for r in range(rounds + 1):
        codes = [[min(range(len(book)), key=lambda e: (far(x, book[e]), e)) for x in part] for part, book in zip(cut, books, strict=True)]  # noqa: B023
        if r < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    own = [x for x, c in zip(cut[p], codes[p], strict=True) if c == e]
                    if own:
                        books[p][e] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    errors = [sum(far(cut[p][i], books[p][codes[p][i]]) for p in range(parts)) for i in range(len(kept))]
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    by_label = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    return [(i, "".join(f"{codes[p][k]:02x}" for p in range(parts)), errors[k], by_label[label], digest) for k, (i, _, label) in enumerate(kept)]


def run(spark, tmp_path, rows, name):
    spark.createDataFrame(rows, FIELDS).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
    return sorted(map(tuple, V.op12_vector_codes(spark, f"{tmp_path}/{name}").collect()), key=repr)


def clustered(rng, n, size, label=lambda rng: rng.choice([None, 1, 2])):
    centres = [[rng.uniform(-1, 1) for _ in range(size)] for _ in range(9)]
    return [(i, [x + rng.gauss(0, 0.1) for x in rng.choice(centres)], label(rng), "x", 1) for i in range(n)]


def test_query_equals_plain_version(spark, tmp_path):
    rng = random.Random(1)
    rows = clustered(rng, 700, 8)
    rows += [(i, list(rows[5][1]), 1, None, None) for i in range(700, 900)]  # one very common vector
    rows += [(900, None, None, None, None), (901, [0.1, None, *[0.0] * 6], 1, None, None), (902, [float("nan")] * 8, 1, None, None), (903, [float("inf")] * 8, 1, None, None)]
    rows += [(3, list(rows[3][1]), 2, None, None), (3, list(rows[9][1]), 2, None, None), (None, list(rows[7][1]), None, None, None)]
    rng.shuffle(rows)
    assert run(spark, tmp_path, rows, "a") == sorted(plain(rows), key=repr)


def test_ties_go_to_the_lower_entry(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, [rng.choice([0.0, 0.001, 0.002, -0.001]) for _ in range(4)], i % 3, None, None) for i in range(600)]
    assert run(spark, tmp_path, rows, "a") == sorted(plain(rows), key=repr)


def test_great_components_other_lengths_and_few_rows(spark, tmp_path):
    rng = random.Random(3)
    rows = clustered(rng, 60, 6) + [(100, [], 1, None, None), (101, [1.0], 1, None, None), (2, [1e30, -1e30, 3.0], None, None, None), (102, [3e4] * 6, 1, None, None), (103, [3e4, 3e4, 3e4, 3e4, 3e4, 3e4 + 0.25], 1, None, None)]
    assert run(spark, tmp_path, rows, "a") == sorted(plain(rows), key=repr)
    few = [(7, [0.5, 0.25], None, None, None)]
    assert run(spark, tmp_path, few, "b") == plain(few) == [(7, "00000000", 0, 0, plain(few)[0][4])]
    assert run(spark, tmp_path, [(7, None, 1, None, None)], "c") == [] and run(spark, tmp_path, [], "d") == []
    with pytest.raises(Exception, match="not fit a long"):
        run(spark, tmp_path, [(i, [1e30 * i], 1, None, None) for i in range(300)], "e")


def test_equals_sql(spark, tmp_path):
    rows = clustered(random.Random(4), 500, 16)
    got = run(spark, tmp_path, rows, "a")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/a/embeddings.parquet/*.parquet'")
    assert got == sorted(duck.execute(V.SQL["op12_vector_codes"]).fetchall(), key=repr)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 700, (32, 6))
    x = np.floor(centres[rng.integers(0, 32, 3000)] + rng.normal(0, 25, (3000, 6)))
    held = V.Codebooks([[list(map(int, v)) for v in x[:40]]], np.zeros((1, 40)), 6)
    own = V.Vectors(x, {})
    code, upper, lower = np.zeros(3000, np.int64), np.full(3000, np.inf), np.zeros((3000, 40))
    for r in range(5):
        book = V.Book(held.entries[0], held.limit)
        asked = []
        pairs = book.pairs
        book.pairs = lambda own, rows, cols, pairs=pairs, asked=asked: (asked.append(len(rows)), pairs(own, rows, cols))[1]
        book.search(own, code, upper, lower)
        far = ((x[:, None, :] - book.x) ** 2).sum(axis=2)
        assert (code == far.argmin(axis=1)).all()
        true = np.sqrt(far)
        assert (upper >= true[np.arange(3000), code]).all() and (lower <= true).all() and (V._half(lower).astype(float) <= lower).all()
        if r:
            assert sum(asked) < 3000 * 40 / 4
        sums = {(0, e): (int((code == e).sum()), [int(v) for v in x[code == e].sum(axis=0)]) for e in set(code.tolist())}
        held = held.updated(sums)
        upper, lower = (upper + held.moved[0][code]) * V._UP, np.maximum(V._half(lower).astype(float) - held.moved[0] * (1 + 1e-6), 0)


def test_other_numbers_of_parts_entries_and_rounds(spark):
    rows = clustered(random.Random(6), 200, 6)
    codes, books = V.compress(spark.createDataFrame(rows, FIELDS), parts=3, entries=16, rounds=2)
    got = sorted((r.vec_id, bytes(r.code).hex(), r.error, books.digest()) for r in codes.collect())
    assert got == sorted((i, code, error, digest) for i, code, error, _, digest in plain(rows, 3, 16, 2))


def test_labels_meet_by_salt(spark, monkeypatch):
    monkeypatch.setattr(V, "BROADCAST_LABELS", 0)
    codes = spark.createDataFrame([(i, None if i % 3 else "a", b"", i) for i in range(100)] + [(None, "a", b"", 7)], "vec_id long, label string, code binary, error long")
    got = V.with_label_errors(codes).collect()
    assert len(got) == 101 and {(r.label, r.label_error) for r in got} == {("a", 7 + sum(range(0, 100, 3))), (None, sum(i for i in range(100) if i % 3))}
