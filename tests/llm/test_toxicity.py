import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidelane.llm import toxicity as T

FIELDS = "doc_id long, text string, lang string, source string, score string, predicted int"
BAD = ["idiot", "moron", "worthless", "pathetic", "scum", "trash"]
SYLLABLES = ["an", "the", "er", "ing", "on", "re", "st", "li", "ou", "wh", "ti", "ea"]


def say(rng, n, bad=0.0):
    return " ".join(rng.choice(BAD) if rng.random() < bad else "".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 5))) for _ in range(n))


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    kinds = [rng.random() < 0.15 for _ in range(n)]
    docs = [(i, say(rng, rng.choice([20, 60, 200, 800]), 0.06 if bad else 0) + (" idiot" if bad else ""), "en", "x", None, None) for i, bad in enumerate(kinds)]
    return docs, [(i, int(bad)) for i, bad in enumerate(kinds)]


def held_out(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = corpus()
    return T.train(T.learnable(spark.createDataFrame(docs, FIELDS)), T.learnable(spark.createDataFrame(labels, "doc_id long, toxic int")))


def test_query_on_held_out_documents_and_odd_rows(spark, tmp_path):
    docs, labels = corpus()
    rng = random.Random(2)
    odd = [(5000, None, None, None, "x", 1), (5001, "", None, None, None, None), (5002, " .,!! ", None, None, None, None), (None, "worthless idiot", None, None, None, None), (7, docs[7][1], "fr", "y", None, None)]
    odd += [(5003, say(rng, 60_000), "en", "x", None, None), (5004, say(rng, 60_000) + " pathetic worthless scum " + say(rng, 60_000), "en", "x", None, None)]
    spark.createDataFrame(docs + odd, FIELDS).write.parquet(f"{tmp_path}/documents.parquet")
    extra = [(None, 1), (5000, None), (3, None), (5001, 1), (8, labels[8][1]), (999_999, 1), (4, 7)]
    spark.createDataFrame(labels + extra, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = T.op13_toxicity(spark, str(tmp_path)).collect()
    assert rows[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"} and len(rows) == len(docs) + len(odd)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == held_out(r.doc_id) for r in rows)
    got = {r.doc_id: r for r in rows}
    held = [(got[i].predicted, y) for i, y in labels if held_out(i)]
    assert len(held) > 150 and np.mean([p for p, y in held if y]) > 0.95 and np.mean([p for p, y in held if not y]) < 0.02
    assert got[5000].score == got[5001].score == got[5002].score and got[None].predicted == 1
    assert got[5003].predicted == 0 and got[5004].predicted == 1


def test_held_out_labels_and_other_columns_do_not_matter(spark, model):
    docs, labels = corpus()
    turned = [(i, 1 - y if held_out(i) else y) for i, y in labels]
    other = [(i, t + " idiot" if held_out(i) else t, "de", f"s{i}", "z", 3) for i, t, *_ in docs]
    again = T.train(T.learnable(spark.createDataFrame(other[::-1], FIELDS)), T.learnable(spark.createDataFrame(turned[::-1], "doc_id long, toxic int")))
    assert np.array_equal(model.table, again.table) and (model.slope, model.bias, model.base) == (again.slope, again.bias, again.base)


def misspelt(rng, word):
    i = rng.randrange(1, len(word) - 1)
    return rng.choice([word[:i] + word[i] + word[i:], word[:i] + word[i + 1 :], word + "s", word.upper() + word[-1], word[:i] + {"o": "0", "i": "1", "s": "5"}.get(word[i], "x") + word[i + 1 :]])


def test_unseen_misspellings(model):
    rng = random.Random(3)
    texts = [" ".join(misspelt(rng, rng.choice(BAD)) if rng.random() < 0.06 else w for w in say(rng, 300).split()) for _ in range(40)]
    assert not set(BAD) & {w for t in texts for w in t.split()}
    found, clean = model.scores(pa.array(texts)) >= T.THRESHOLD, model.scores(pa.array([say(rng, 300) for _ in range(40)])) >= T.THRESHOLD
    assert found.mean() >= 0.9 and clean.mean() <= 0.05


def words_of(text):
    return "".join(chr(T._FOLD[b]) for b in text.lower().encode()).split()


def plain_peak(table, text):
    def buckets(word):
        padded = [32, *map(ord, word), 32]
        for n in T.ORDERS:
            for i in range(len(padded) - n + 1):
                h = 0
                for k in range(n):
                    h = ((h ^ (padded[i + k] + k + 1)) * int(T._GRAM[k])) & 0xFFFFFFFF
                yield (((h ^ (h >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF) >> (32 - T.BUCKET_BITS)

    words = words_of(text)
    words = [w for i, w in enumerate(words) if not i or w != words[i - 1]]
    score = [np.mean([float(table[b]) for b in buckets(w)]) for w in words]
    spans = [score[i : i + T.WINDOW] for i in range(max(1, len(score) - T.WINDOW + 1))] if score else []
    return max(map(np.mean, spans), default=-np.inf)


def test_scores_equal_plain_ones_for_any_batch_and_slice(model, monkeypatch):
    rng = random.Random(4)
    texts = ["a", "", None, "to be", "Üb3r  ÉCOLE idiot", "x" * 50, "ha ha ha ha no", *(say(rng, rng.randrange(1, 60), 0.1) for _ in range(30))]
    want = [plain_peak(model.table, t or "") for t in texts]
    assert np.allclose(model.peaks(pa.array(texts)), want, atol=1e-5)
    monkeypatch.setattr(T, "CHUNK_BYTES", 64)
    assert np.allclose(model.peaks(pa.array(texts)), want, atol=1e-5)


def test_few_labels(spark):
    docs = spark.createDataFrame([(1, "one idiot", "en", "x", None, None), (2, None, "en", "x", None, None)], FIELDS)
    for labels, want in (([], 0.0), ([(1, 0)], 0.0), ([(1, 1)], 1.0), ([(1, 1), (2, 0)], 0.5)):
        found = T.score(docs, T.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()
        assert len(found) == 2 and all(abs(r.score - want) < 1e-6 for r in found)
    assert T.score(docs.limit(0), T.train(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0
