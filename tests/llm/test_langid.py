import random

import numpy as np
import pyarrow as pa
import pytest

from tidelane.llm import langid

FIELDS = "doc_id long, text string, lang string, score string, held_out int"
SOUNDS = {"aa": ["tha", "ing", "ow"], "bb": ["eux", "ré", "ou"], "cc": ["sch", "ü", "ein"], "dd": ["ción", "ñ", "ez"]}


def say(rng, lang, n):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    return [(i, say(rng, lang, rng.randrange(1, 60)), lang, "x", 1) for i in range(400) for lang in [rng.choice(list(SOUNDS))]]


def test_held_out_accuracy_and_edge_rows(spark, rows):
    edge = [(1000, None, "aa", None, None), (1001, "123 ... %%", "bb", None, None), (1002, "", None, None, None), (None, "thaing ow", None, None, None), (1003, "Ж", None, None, None)]
    docs = spark.createDataFrame(rows + edge, FIELDS)
    got = {r["doc_id"]: r for r in langid.identify(docs, langid.train(langid.learnable(docs))).collect()}
    held = [(r[2], got[r[0]]["lang_pred"]) for r in rows if got[r[0]]["held_out"]]
    assert len(held) > 40 and np.mean([a == b for a, b in held]) > 0.97
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and got[None]["lang_pred"] == "aa" and got[1003]["lang_pred"] != "und"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(i or "").encode() if i is not None else b"") % 5 == 0) for i, r in got.items() if i)


def test_mixed_text_is_less_certain(spark, rows):
    docs = spark.createDataFrame(rows, FIELDS)
    model = langid.train(docs)
    rng = random.Random(9)
    mixed = pa.array([" ".join(say(rng, x, 30) for x in ("aa", "bb", "cc", "dd")), say(rng, "aa", 60)])
    _, score, _ = model.predict(mixed)
    assert score[0] < score[1]


def test_margins_do_not_depend_on_neighbours_or_chunks(monkeypatch, spark, rows):
    model = langid.train(spark.createDataFrame(rows, FIELDS))
    texts = pa.array(["thaing", "", None, "a", "é", "ow", rows[0][1] * 30])
    alone = np.concatenate([model.margins(texts.slice(i, 1)) for i in range(len(texts))])
    assert np.allclose(model.margins(texts), alone)
    assert np.allclose(langid.counts(texts) @ model.weights + model.bias, alone, atol=1e-4)
    monkeypatch.setattr(langid, "CHUNK_BYTES", 64)
    assert np.allclose(model.margins(texts), alone)


def test_few_languages(spark):
    one = spark.createDataFrame([(1, "thaing", "aa"), (2, "ow", "aa")], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(one, langid.train(one)).collect()} == {("aa", 1.0)}
    none = one.limit(0)
    assert {r["lang_pred"] for r in langid.identify(one, langid.train(none)).collect()} == {"und"} and langid.identify(none, langid.train(one)).count() == 0


def test_codewords_are_apart():
    for n in (2, 4, 6, 12):
        code = langid.codewords(n).astype(int)
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= (1 if n == 2 else 2)


def plain_prediction(model, text):
    """(language, probability, ambiguity) with a loop over n-grams, bits and codewords."""
    letters = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").encode()]
    sums, n = np.zeros(len(model.bias)), 0
    for i in range(len(letters)):
        for order in langid.ORDERS:
            h = 0
            for k in range(order):
                h = ((h ^ ((letters[i + k] if i + k < len(letters) else 32) + k + 1)) * int(langid._GRAM[k])) & 0xFFFFFFFF
            bucket = (((h ^ (h >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF) >> 19
            sums += model.weights[bucket]
            n += 1
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0, True
    margin = sums / n + model.bias
    loss = [sum(t * np.log1p(np.exp(-m * c)) for m, c, t in zip(margin, code, model.trust, strict=True)) for code in model.code.astype(float)]
    p = np.exp(min(loss) - np.array(loss))
    p /= p.sum()
    best = int(np.argmax(p))
    return model.languages[best], float(p[best]), bool(sorted(p)[-1] - sorted(p)[-2] < langid.AMBIGUOUS)


def test_predictions_equal_plain_decoding(spark, rows):
    model = langid.train(spark.createDataFrame(rows, FIELDS))
    rng = random.Random(11)
    texts = [None, "", "1 2 3", "é", "thaing OW 7", "a" * 300] + [say(rng, lang, rng.randrange(1, 20)) for lang in SOUNDS for _ in range(6)] + [say(rng, "aa", 5) + " " + say(rng, "bb", 5)]
    names, score, ambiguous = model.predict(pa.array(texts))
    for got, text in zip(zip(names, score.tolist(), ambiguous.tolist(), strict=True), texts, strict=True):
        want = plain_prediction(model, text)
        assert got[0] == want[0] and abs(got[1] - want[1]) < 1e-4 and got[2] == want[2], text
