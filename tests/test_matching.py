import random

from tidelane.operators import matching as M

TEXTS, WANTED = "key string, id int, text string", "key string, place int, title string, keywords array<string>"


def some(rng, letters, most):
    return "".join(rng.choice(letters) for _ in range(rng.randrange(most)))


def tables(rng, texts=120, wanted=40):
    t = [(rng.choice("ab"), i, some(rng, "abcé", 12)) for i in range(texts)]
    w = [(rng.choice("ab"), i, rng.choice([None, some(rng, "abc", 5)]), rng.choice([None, [rng.choice([None, some(rng, "abcé", 4)]) for _ in range(rng.randrange(4))]])) for i in range(wanted)]
    return [*t, ("a", 900, None), (None, 901, "abc"), ("c", 902, "abc")], [*w, (None, 900, "a", ["b"]), ("d", 901, "a", ["b"]), ("a", 902, "", [""])]


def plain_hits(text, title, keywords):
    return sum(k is not None and k in text for k in keywords or ()) + (3 if title is not None and title in text else 0)


def plain_best(texts, wanted):
    for key, place, title, keywords in wanted:
        own = [(-plain_hits(t, title, keywords), i) for k, i, t in texts if k == key and k is not None and t is not None]
        if own and min(own)[0] < 0:
            yield key, place, min(own)[1], -min(own)[0]


def plain_present(texts, words):
    for key, i, t in texts:
        n = sum(k == key and w is not None and w in t for k, w in words) if t is not None and key is not None else 0
        if n:
            yield key, i, n


def test_matches_equal_plain_ones_however_they_are_dealt(spark, monkeypatch):
    rng = random.Random(1)
    for most in (50_000, 7):
        monkeypatch.setattr(M, "TEXTS", most)
        monkeypatch.setattr(M, "WANTED", most)
        texts, wanted = tables(rng)
        t, w = spark.createDataFrame(texts, TEXTS), spark.createDataFrame(wanted, WANTED)
        got = [tuple(r) for r in M.best_matches(t, w, "key").collect()]
        assert sorted(got) == sorted(plain_best(texts, wanted)) and len(got) > 10
        words = [(k, x) for k, _, _, ks in wanted for x in ks or ()]
        got = [tuple(r) for r in M.words_present(t, spark.createDataFrame(words, "key string, word string"), "key", "word").collect()]
        assert sorted(got) == sorted(plain_present(texts, words)) and len(got) > 10


def test_empty_tables(spark):
    t, w = spark.createDataFrame([("a", 1, "x")], TEXTS), spark.createDataFrame([("a", 1, "x", ["x"])], WANTED)
    assert M.best_matches(t.limit(0), w, "key").count() == 0 and M.best_matches(t, w.limit(0), "key").count() == 0
    assert [tuple(r) for r in M.best_matches(t, w, "key").collect()] == [("a", 1, 1, 4)]


def test_many_keywords_and_long_texts_take_one_pass():
    rng = random.Random(2)
    wanted = [(i, None, [some(rng, "abcdefgh", 9) + "xyz" for _ in range(20)]) for i in range(2000)]
    text = " ".join(some(rng, "abcdefgh", 9) + "xyz" for _ in range(50_000))
    hits = M.Patterns(wanted).hits(text)
    assert all(hits.get(i, 0) == plain_hits(text, None, ks) for i, _, ks in rng.sample(wanted, 20))
