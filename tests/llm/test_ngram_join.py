import random
import re

import numpy as np
import pytest

from tidelane.llm import ngram_join, textops
from tidelane.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_set(text):
    words = WORD.findall((text or "").encode().lower()) if text else []
    return frozenset([tuple(words)] if 0 < len(words) < 5 else [tuple(words[i : i + 5]) for i in range(len(words) - 4)])


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(rows)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= 80 * len(a | b):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((-1 if d is None else d, len(sets[i]), -1 if d is None else least[find(i)], links[i]) for i, (d, _) in enumerate(rows))


def joined(spark, rows):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, c1 string, rep int")
    return sorted((-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2], r[3]) for r in ngram_join.jaccard_join(docs).collect())


def near(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("block", [4, 512])
def test_join_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block)
    monkeypatch.setattr(ngram_join, "_FLUSH", 50 * block)
    rng = random.Random(block)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(6, 90))] for _ in range(12)]
    shared = " ".join(f"s{i}" for i in range(14))
    texts = [near(rng, rng.choice(base), rng.choice([0, 0, 1, 1, 2, 3])) + rng.choice(["", "", " " + shared]) for _ in range(150)]
    texts += ["", None, "  \t\n", "one two", "One  TWO", "a b c d e", "A b c d e", "É b", "é b"]
    rows = [(i * 3, t) for i, t in enumerate(rng.sample(texts, len(texts)))] + [(None, "a b c d e"), (None, None)]
    assert joined(spark, rows) == brute(rows)


def test_repeated_rows_and_empty_table(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (2, "a b c d e f g"), (9, "z")]
    got = joined(spark, rows)
    assert [r[0] for r in got] == [2, 5, 5, 9] and got[1][3] >= 1
    assert joined(spark, []) == []


def test_words_match_the_pattern_on_any_batch_cut():
    texts = ["a  b", "", "x\x0by\x0cz", None, "Ärger über Öl", "tail ", " lead", "end", "é"]
    import pyarrow as pa

    data, offsets = textops.utf8(pa.array(texts).slice(1))
    hashes, _, _, first = textops.words(data, offsets)
    found = [WORD.findall((t or "").encode()) for t in texts[1:]]
    assert np.diff(first).tolist() == [len(x) for x in found]
    flat = [w.lower() for x in found for w in x]
    same = {}
    for h, w in zip(hashes.tolist(), flat, strict=True):
        assert same.setdefault(w, h) == h
    assert len(set(same.values())) == len(same)


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(300 + i, 300 + (i + 1) % 9) for i in range(9)] + [(1, 1)]
    rng.shuffle(edges)
    got = {r["id"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 7: 7, **{i: 7 for i in range(200, 260)}, **{300 + i: 300 for i in range(9)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0




def test_chained_classes_make_small_tiles(spark):
    """5,000 classes, each sharing a rare shingle with the next and all of them a common one, are neither all pairs nor one family."""
    from pyspark.sql import functions as F

    n, rng = 5000, random.Random(2)
    own = [["boilerplate"] for _ in range(n)]
    for k in range(5 * n):  # a word of two classes
        for i in (k % n, rng.randrange(n)):
            own[i].append(f"w{k}")
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(own)], "doc_id long, text string")
    found = ngram_join.candidates(docs, 1, 80, 11 * n).withColumn("node", F.struct(F.col("c1").alias("rep"), "c1")).withColumn("weight", F.lit(1))
    edges = found.select("c1", F.explode("prefix").alias("t")).groupBy("t").agg(F.min("c1").alias("a"), F.max("c1").alias("b"))
    assert components(edges).groupBy("label").count().agg(F.max("count")).first()[0] > 0.8 * n
    sent = ngram_join.tiles(found, 80)
    per_tile = sent.groupBy("x", "y").agg(F.count(F.lit(1)).alias("k")).agg(F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("pairs"), F.sum("k").alias("rows")).first()
    assert per_tile["pairs"] < n * n / 2 / 50 and per_tile["rows"] < 20 * n
    assert all(r["n_links"] == 0 for r in ngram_join.jaccard_join(docs, width=1).collect())


def _found(spark, sets):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(sets)], "doc_id long, text string")
    found = ngram_join.candidates(docs, 1, 80, sum(map(len, sets))).withColumn("node", F.struct(F.col("c1").alias("rep"), "c1")).withColumn("weight", F.lit(1))
    return docs, found


def test_rows_of_one_template_with_words_of_their_own_are_not_sent(spark):
    """Eight of ten words are common to 16,000 texts: no pair has the nine that it needs."""
    own = [[*(f"t{k}" for k in range(8)), f"a{i}", f"b{i}"] for i in range(16_000)]
    own += [[*(f"t{k}" for k in range(8)), "near", "copy", f"c{i}"] for i in range(3)]  # ten of eleven, of twelve together
    docs, found = _found(spark, own)
    assert ngram_join.tiles(found, 80).count() < 100
    linked = {r["doc_id"]: r["n_links"] for r in ngram_join.jaccard_join(docs, width=1).where("n_links > 0").collect()}
    assert linked == {16_000 + i: 2 for i in range(3)}


def test_templates_of_any_size_equal_brute_force(spark):
    rng = random.Random(9)
    template = [f"t{k}" for k in range(30)]
    own = [[*template[: rng.randrange(1, 31)], *(f"w{rng.randrange(40)}" for _ in range(rng.randrange(0, 8)))] for _ in range(400)]
    docs, _ = _found(spark, own)
    sets = [set(x) for x in own]
    want = [sum(100 * len(a & b) >= 80 * len(a | b) for b in sets) - 1 for a in sets]
    got = {r["doc_id"]: r["n_links"] for r in ngram_join.jaccard_join(docs, width=1).collect()}
    assert [got[i] for i in range(400)] == want and sum(want) > 1000


@pytest.mark.parametrize("few", [0, 4, 10**6])
def test_products_by_scattering_and_by_dense_blocks_agree(few):
    rng = np.random.default_rng(few)
    left, right = ([np.unique(rng.integers(0, 60, rng.integers(1, 40))) for _ in range(n)] for n in (9, 7))
    want = np.array([[len(np.intersect1d(a, b)) for b in right] for a in left])
    assert (ngram_join.overlaps(left, right, columns=8, few=few) == want).all()
    own = ngram_join.overlaps(left, None, columns=8, few=few)
    want = np.array([[len(np.intersect1d(a, b)) for b in left] for a in left])
    np.fill_diagonal(own, 0), np.fill_diagonal(want, 0)
    assert (own == want).all()


def test_repeated_ids_with_other_words_are_classes_of_their_own(spark):
    a, b, c = ("a b c d e f g h", "k l m n o p q r", "k l m n o p q r s")
    docs = spark.createDataFrame([(2, a), (5, a), (5, b), (9, c)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"], r["n_links"], r["first"]) for r in ngram_join.jaccard_join(docs, digests=True).collect())
    assert got == [(2, 2, 1, True), (5, 2, 1, False), (5, 5, 1, True), (9, 5, 1, False)]


def test_very_long_texts(spark, monkeypatch):
    monkeypatch.setattr(ngram_join.textops, "SLICE_BYTES", 1 << 16)
    rng = random.Random(31)
    long = [f"w{rng.randrange(50_000)}" for _ in range(300_000)]
    near, far = list(long), list(long)
    for _ in range(4_000):
        near[rng.randrange(len(near))] = "changed"
    for _ in range(20_000):
        far[rng.randrange(len(far))] = "changed"
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(far)), (4, "\n".join(long).upper()), (5, "x" * 2_000_000)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (long, near, far)]
    alike = [[100 * len(a & b) >= 80 * len(a | b) for b in sets] for a in sets]
    assert alike[0][1] and not alike[0][2] and not alike[1][2]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (len(sets[0]), 1), 2: (len(sets[1]), 1), 3: (len(sets[2]), 3), 4: (len(sets[0]), 1), 5: (1, 5)}
