import os

import numpy as np
import pytest

from tidelane.operators import clustering as C
from tidelane.operators.graphs import connected
from tidelane.plans import catalog
from tidelane.sources.tables import source

SF = "/root/testdata/sf0.001"


def naive(x, limit):
    """Merges the two clusters of least mean distance again and again; clusters numbered by first row."""
    found = [[i] for i in range(len(x))]
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    while len(found) > 1:
        mean, i, j = min((far[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(found) for j, b in enumerate(found) if i < j)
        if not mean < limit:
            break
        found[i] += found.pop(j)
    out = np.zeros(len(x), int)
    for n, own in enumerate(sorted(found, key=min)):
        out[own] = n
    return out.tolist()


@pytest.mark.parametrize("kept", [1 << 24, 150])
def test_chains_equal_naive_agglomeration(monkeypatch, kept):
    monkeypatch.setattr(C, "KEPT_SUMS", kept)
    rng = np.random.default_rng(0)
    for _ in range(40):
        n = int(rng.integers(1, 40))
        x = rng.normal(0, rng.choice([0.1, 0.2, 0.3, 0.5]), (n, int(rng.integers(1, 5))))
        assert C.chains(x, np.ones(n), 0.5).tolist() == naive(x, 0.5)
        times = rng.integers(1, 4, n)
        assert np.repeat(C.chains(x, times.astype(float), 0.5), times).tolist() == naive(np.repeat(x, times, axis=0), 0.5)


def test_ties_take_the_first_row():
    x = np.array([[0.0], [0.25], [0.5], [0.75]])
    assert C.chains(x, np.ones(4), 0.3).tolist() == [0, 0, 1, 1]
    assert C.chains(x, np.ones(4), 0.25).tolist() == [0, 1, 2, 3]  # under the limit, not at it
    assert C.chains(np.zeros((3, 2)), np.ones(3), 0.5).tolist() == [0, 0, 0]


def test_recordings_equal_naive_agglomeration(spark, monkeypatch):
    monkeypatch.setattr(C, "TILE", 16)
    rng = np.random.default_rng(1)
    rows, want = [], set()
    for key, n, size in (("a", 120, 3), ("b", 1, 3), ("c", 60, 2), (None, 5, 2)):
        x = rng.normal(0, 0.4, (n, size))
        if key == "c":
            x[30:] = x[7]
        rows += [(key, i, v.tolist()) for i, v in enumerate(x)]
        want |= {(key, i, c) for i, c in enumerate(naive(x, 0.5))} if key else set()
    rows += [("a", 500, None), ("a", 501, [0.1, None, 0.0]), ("a", 502, [float("nan"), 0.0, 0.0]), ("a", 503, []), ("a", 504, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "key string, id int, v array<double>")
    got = {(r.key, r.id, r.cluster) for r in C.average_linkage(df.where("key IS NOT NULL"), ["key"], "v").collect()}
    assert got == want and len(want) == 181
    assert C.average_linkage(df.limit(0), ["key"], "v").count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_equals_naive_agglomeration(spark):
    rows = sorted((r.label, r.vec_id, r.embedding) for r in source(spark, SF, "embeddings").collect())
    want = []
    for label in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == label]
        want += [(r[1], label, f"SPEAKER_{c:02d}") for r, c in zip(own, naive(np.array([r[2] for r in own], float), 1.3), strict=True)]
    got = catalog.queries()["i24_voice_clusters"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(want) and 1 < len({r[2] for r in want}) < 50


def test_components_of_chains_rings_and_stars(spark):
    pairs = [("x", i, i + 1) for i in range(300)] + [("y", 5, 9), ("y", 9, 7), ("y", 1, 1), ("y", 20, 30), ("y", None, 3)] + [("z", 0, i) for i in range(1, 50)]
    got = {(r.key, r.id): r.root for r in connected(spark.createDataFrame(pairs, "key string, a int, b int"), ["key"], "a", "b").collect()}
    assert all(got["x", i] == 0 for i in range(301)) and all(got["z", i] == 0 for i in range(50))
    assert {i: r for (k, i), r in got.items() if k == "y"} == {5: 5, 9: 5, 7: 5, 1: 1, 20: 20, 30: 20}


def test_pairs_of_a_tile_by_products():
    rng = np.random.default_rng(4)
    x = rng.integers(-3, 4, (300, 8)) / 4.0
    apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for limit in (0.5, 0.75, 1.0):  # many pairs are exactly so far apart: such may count as near, nearer ones must
        near = C._near(x, limit * (1 + 1e-9))
        assert near[apart < limit].all() and not near[apart > limit * (1 + 1e-6)].any() and (near == near.T).all()
    assert C._near(np.array([[1e200], [2e200], [0.0]]), 0.5)[0, 1]  # no distance in doubles: left to the clustering
    assert C.TILE >= 2048


@pytest.mark.parametrize("kept, large, listed", [(150, 64, 12), (150, 3, 2), (40, 2, 12)])
def test_rounds_equal_naive_agglomeration(monkeypatch, kept, large, listed):
    """While clusters are more than a table may have, they merge in rounds; also far from the origin, where products lose what is small."""
    monkeypatch.setattr(C, "KEPT_SUMS", kept)
    monkeypatch.setattr(C, "LARGE", large)
    monkeypatch.setattr(C, "LISTED", listed)
    rng = np.random.default_rng(5)
    for i in range(12):
        n = int(rng.integers(1, 30))
        x = rng.normal(0, rng.choice([0.1, 0.2, 0.3, 0.5]), (n, int(rng.integers(1, 5)))) + (i % 2) * 1e6
        assert C.chains(x, np.ones(n), 0.5).tolist() == naive(x, 0.5)
        times = rng.integers(1, 4, n)
        assert np.repeat(C.chains(x, times.astype(float), 0.5), times).tolist() == naive(np.repeat(x, times, axis=0), 0.5)


def test_rounds_ask_for_few_distances(monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (1500, 24))
    x /= np.sqrt((x**2).sum(axis=1))[:, None]
    want = C.chains(x, np.ones(1500), 1.2)
    asked, far = [], C._distances
    monkeypatch.setattr(C, "_distances", lambda a, b: asked.append(len(a) * len(b)) or far(a, b))
    monkeypatch.setattr(C, "KEPT_SUMS", 400**2)
    assert C.chains(x, np.ones(1500), 1.2).tolist() == want.tolist() and 1 < want.max() < 400
    assert sum(asked) < 7 * 1500**2


def test_blocks_of_one_component_do_not_meet(spark, monkeypatch):
    monkeypatch.setattr(C, "TILE", 64)
    made, pairs = [], C._pairs
    monkeypatch.setattr(C, "_pairs", lambda tiles, *rest: made.append(tiles.count()) or pairs(tiles, *rest))
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(0, 0.1, (600, 3)), [[9.0, 9.0, 9.0]]])
    df = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(x)], "key string, id int, v array<double>")
    got = {r.id: r.cluster for r in C.average_linkage(df, ["key"], "v").collect()}
    assert [got[i] for i in range(601)] == C.chains(x, np.ones(601), 0.5).tolist()
    assert made[0] <= 601 + C.SHARED * 20 and made[1] <= 1  # each vector once and what is shared; then no pair of blocks
