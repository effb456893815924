import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from tidelane.llm import runs as R

FIELDS = "doc_id long, text string, runs string, n_words int"


def plain_runs(w, least=6, periods=4):
    """Every maximal stretch of each period, by trying all of them; the first period that finds a stretch is its smallest."""
    found = {}
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            b = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - b >= max(least, periods * q):
                found.setdefault((b, i + q), q)
            i += i == b
    return sorted(((b, e, q) for (b, e), q in found.items()), key=lambda r: (r[0], r[2]))


def some_text(rng):
    n, letters = rng.randrange(0, 60), rng.choice([1, 2, 2, 3, 5])
    w = [rng.randrange(letters) for _ in range(n)]
    if n and rng.random() < 0.6:
        a = rng.randrange(n)
        p = 1 + rng.randrange(max(1, (n - a) // 3))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)] * rng.choice([1, 1, 2, 5])
    return w


def test_runs_equal_brute_force():
    rng = random.Random(4)
    for _ in range(1500):
        texts = [some_text(rng) for _ in range(rng.randrange(0, 6))]
        least, periods = rng.choice([(6, 4), (6, 4), (2, 2), (5, 3)])
        first = np.cumsum([0] + [len(w) for w in texts])
        text, runs = R.runs_of(np.array([x for w in texts for x in w], np.int64), first, least, periods)
        want = [(d, first[d] + b, first[d] + e, q) for d, w in enumerate(texts) for b, e, q in plain_runs(w, least, periods)]
        assert [(d, *r) for d, r in zip(text.tolist(), runs.tolist(), strict=True)] == want


def test_suffixes_and_previous_factors_equal_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        w = some_text(rng) + [99]
        own = R.Suffixes(np.array(w))
        assert own.order.tolist() == sorted(range(len(w)), key=lambda i: w[i:])
        same = lambda i, j: next(k for k in range(len(w)) if j + k >= len(w) or w[i + k] != w[j + k])  # noqa: B023, E731
        assert own.lcp.tolist() == [0, *(same(*sorted(own.order[r - 1 : r + 1].tolist())) for r in range(1, len(w))), 0]
        length, source = own.previous_factors()
        assert length.tolist() == [max((same(j, i) for j in range(i)), default=0) for i in range(len(w))]
        assert all(j == -1 if not n else same(j, i) == n and j < i for i, (n, j) in enumerate(zip(length.tolist(), source.tolist(), strict=True)))


def test_texts_of_any_kind(spark):
    rows = [
        (1, None, None, None),
        (2, "", "x", 1),
        (3, " \t\r\n\x0b\x0c ", "x", 1),
        (4, "ha  ha\tha\nha ha ha!", None, None),
        (5, "\x0bha ha ha ha ha ha\x0c", None, None),
        (5, "ha ha ha ha ha ha", None, None),
        (None, "Ha ha Ha ha ha ha ha é é é é é é ü", None, None),
        (6, "a b a b a b a b a b c x y z x y z x y z x y z x", None, None),
        (7, "one two one two one two one two one two one two", None, None),
        (8, "x" * 3_000_000, None, None),
    ]
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in R.periodic_runs(spark.createDataFrame(rows, FIELDS)).collect()]
    want = [
        (1, 0, [], ""),
        (2, 0, [], ""),
        (3, 0, [], ""),
        (4, 6, [], "ha ha ha ha ha ha!"),
        (5, 6, [(0, 6, 1)], "ha"),
        (5, 6, [(0, 6, 1)], "ha"),
        (None, 14, [(7, 6, 1)], "Ha ha Ha ha ha ha ha é ü"),
        (6, 24, [(0, 10, 2), (11, 13, 3)], "a b c x y z"),
        (7, 6, [(0, 6, 1)], "one two"),
        (8, 1, [], "x" * 3_000_000),
    ]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert R.periodic_runs(spark.createDataFrame([], FIELDS)).count() == 0


def test_a_very_long_text_and_batches_of_any_size(spark, monkeypatch):
    rng = random.Random(6)
    period = [rng.choice("abcdef") * rng.randrange(1, 4) for _ in range(1000)]
    period[100:112] = ["no"] * 12
    long = period * 300 + ["end"]
    texts = [" ".join(long)] + [" ".join(map(str, some_text(rng))) for _ in range(50)]
    whole = {r.doc_id: r for r in R.periodic_runs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [tuple(r) for r in whole[0].runs if r.period == 1000] == [(0, 300_000, 1000)] and sum(tuple(r)[1:] == (12, 1) for r in whole[0].runs) == 300
    monkeypatch.setattr(R, "CHUNK_BYTES", 40)
    import pyarrow as pa

    parts = [x for _, _, _, lists, _ in R._found(pa.array(texts[1:]), 6, 4) for x in lists.to_pylist()]
    assert [[tuple(r.values()) for r in x] for x in parts] == [[tuple(r) for r in whole[i].runs] for i in range(1, 51)]
    assert all([tuple(r) for r in whole[i].runs] == [(b, e - b, q) for b, e, q in plain_runs(t.split())] for i, t in enumerate(texts) if i)


def expected(doc_id, text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for b, e, q in runs for i in range(b + q, e)}
    best = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    first = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    lines = "".join(f"{b},{e - b},{q}\n" for b, e, q in runs).encode()
    return (doc_id, len(runs), *first, hashlib.sha256(lines).hexdigest(), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


def test_query_equals_plain_version(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, rng.choice([" ", "  ", "\n"]).join(rng.choice(["a", "b", "Cé", "the"]) for _ in range(rng.randrange(0, 120))) or None, "x", 1) for i in range(400)]
    spark.createDataFrame(rows, FIELDS).write.parquet(f"{tmp_path}/documents.parquet")
    got = R.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for c, t in got.dtypes if not c.endswith("sha256")} == {"bigint"}
    have = sorted(map(tuple, got.collect()))
    assert have == [expected(i, t) for i, t, *_ in rows] and sum(r[1] for r in have) > 20
    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.length("text") < 3000)
    small.write.parquet(f"{tmp_path}/small/documents.parquet")
    assert sorted(map(tuple, R.op11_periodic_runs(spark, f"{tmp_path}/small").collect())) == sorted(expected(r.doc_id, r.text) for r in small.collect())
