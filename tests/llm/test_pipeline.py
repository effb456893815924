import random

import corpus_pipeline
from tests.llm.test_ngram_join import shingle_set
from tidelane.llm import tokens

SOUNDS = {"en": ["th", "er", "ing", "of"], "fr": ["eux", "ré", "ou", "la"]}


def say(rng, lang, n):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(n))


def test_stages_decide_as_planted(spark, tmp_path):
    rng = random.Random(5)
    texts, lang = {}, {}
    for d in range(200):
        lang[d] = {5: "fr", 10: "fr", 11: "fr", 30: "en", 40: "fr", 41: "fr"}.get(d) or rng.choice(["en", "fr"])
        texts[d] = say(rng, lang[d], rng.randrange(20, 80))
    item = say(rng, "en", 25) + ". " + say(rng, "en", 6) + "."
    passage = say(rng, "fr", 60)
    texts[10] = texts[5] + " extra"
    texts[11] = texts[5]
    texts[20], texts[21] = "123 ... 456", None
    texts[30] = texts[30] + " " + item
    texts[40], texts[41] = texts[40] + "\n" + passage, texts[41] + "\n" + passage
    rows = [(d, texts[d], lang[d], "s", len(texts[d] or ""), "x", "y", 1) for d in texts] + [(50, texts[50], lang[50], "s", len(texts[50]), "x", "y", 1), (None, say(rng, "en", 40), "en", None, 1, None, None, None)]
    fields = "doc_id long, text string, lang string, source string, n_chars long, c1 string, _lang string, _clean int"
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, out = spark.createDataFrame(rows, fields), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == before.columns and [f.dataType for f in docs.schema] == [f.dataType for f in before.schema]
        out[name] = sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["text"], r["n_chars"]) for r in docs.collect())
    ids = {k: [x[0] for x in v] for k, v in out.items()}
    everything = sorted([*texts, 50, -1])
    assert ids["language_id"] == [d for d in everything if d not in (20, 21)]
    sets = {d: shingle_set(texts[d]) for d in texts}
    linked = {b for a in texts for b in texts if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert linked == {10, 11}
    assert ids["near_duplicates"] == sorted(set(everything) - {20, 21, 10, 11})
    assert ids["substring_dedup"] == ids["near_duplicates"]
    clean = {d: t for d, t, _ in out["substring_dedup"]}
    assert len(texts[41]) - len(clean[41]) > len(passage) * 0.6 and all(clean[d] == texts[d] for d in texts if d in clean and d != 41)
    assert all(n == len(t) for d, t, n in out["substring_dedup"] if d >= 0)
    assert ids["decontamination"] == [d for d in ids["substring_dedup"] if d != 30]
    packed = corpus_pipeline.pack(spark, docs, str(tmp_path)).collect()
    enc = tokens.encoder(tokens.default_tokenizer())
    assert sum(r["length"] for r in packed) == sum(len(enc.encode([t])[0]) // 4 + 1 for _, t, _ in out["decontamination"])


def test_empty_tables_pass_through(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_that_repeat_an_id_are_judged_by_their_words(spark):
    a, b = "one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen fifteen and more"
    rows = [(2, a, {"k": 1}), (5, a, None), (5, b, {"k": 2}), (5, b, {"k": 2}), (5, None, None), (5, " ", None), (7, b + " sixteen", None), (None, a, None), (None, a, None), (9, "", {"k": 3})]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), m) for d, t, m in rows], "doc_id long, text string, lang string, source string, n_chars long, kinds map<string,int>")
    got = sorted(((r["doc_id"] or -1, r["text"] or "-") for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()))
    assert got == sorted([(2, a), (5, b), (5, "-"), (5, " "), (-1, a), (-1, a), (9, "-")])


def test_a_run_leaves_its_last_stage_only(spark, tmp_path):
    import os

    from tidelane.storage import noted

    rng = random.Random(3)
    rows = [(d, say(rng, lang, 30), lang, "s", 1) for d in range(40) for lang in [rng.choice(["en", "fr"])]]
    spark.createDataFrame([(1, "one two three four five six. seven eight.")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    with noted() as made:
        out = corpus_pipeline.run(spark, str(tmp_path))
    n = out.count()
    held = [x for x in made if os.path.isdir(x.inputFiles()[0].removeprefix("file://").rpartition("/")[0])] if n else []
    assert n > 0 and [x.columns for x in held] == [out.columns] and len(made) > 10
