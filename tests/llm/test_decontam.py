import random

import numpy as np
import pytest

from tidelane.llm import decontam

FIELDS = "doc_id long, text string, leaks int, score string, c0 string"


def say(rng, n, tail="."):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 4))) for _ in range(n)) + tail


@pytest.fixture(scope="module")
def case():
    rng = random.Random(4)
    items = [(i, say(rng, rng.randrange(6, 30)) + " " + say(rng, rng.randrange(1, 8))) for i in range(40)]
    docs = []
    for d in range(120):
        text = say(rng, rng.randrange(0, 200), "")
        if d % 4 == 0:
            words = text.split(" ")
            at = rng.randrange(len(words) + 1)
            text = " ".join(words[:at] + [items[d % 40][1].encode().upper().decode() if d % 8 else items[d % 40][1]] + words[at:])
        docs.append((d, text, None, "s", None))
    return items, docs


def bag(index, text):
    return np.intersect1d(decontam._words([text])[0], index.terms)


def weights(index):
    out = np.zeros((len(index.terms), len(index.ids)))
    for own in index.classes:
        for t in range(len(index.terms)):
            at = slice(own.at[t], own.at[t + 1])
            out[t, np.array(own.items)[own.item[at]]] = own.weight[at]
    return out


def test_block_max_wand_loses_nothing(case):
    items, docs = case
    index = decontam.Index([(i, *decontam.split_item(t)) for i, t in items])
    weight = weights(index)
    assert np.allclose(weight.sum(axis=0), 1) and len(index.classes) > 1
    for _, text, *_ in docs:
        own = np.searchsorted(index.terms, bag(index, text))
        full = weight[own].sum(axis=0)
        for threshold in (0.05, 0.2, 0.6, 0.95):
            got = dict(index.retrieve(own, threshold))
            assert set(got) == set(np.flatnonzero(full >= threshold - 1e-9).tolist())
            assert all(abs(full[i] - s) < 1e-9 for i, s in got.items())


def test_weights_and_results_are_those_of_all_items_in_parts_of_any_size(spark, case):
    items, docs = case
    items = [*items, (99, say(random.Random(8), 3000))]  # an item a hundred times as long as the others
    frame, bench = spark.createDataFrame(docs, FIELDS), spark.createDataFrame(items, "item_id long, text string")
    whole = decontam.Index([(i, *decontam.split_item(t)) for i, t in items])
    want = {(i, int(t)): w for k, i in enumerate(whole.ids) for t, w in zip(whole.terms, weights(whole)[:, k], strict=True) if w}
    got = {}
    for part in decontam._indexes(bench, 900):
        got |= {(i, int(t)): w for k, i in enumerate(part.ids) for t, w in zip(part.terms, weights(part)[:, k], strict=True) if w}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)

    def found(**options):
        rows = decontam.leaks(frame, bench, **options).collect()
        return sorted((r["doc_id"], r["item_id"], round(r["score"], 9), r["contaminated"], r["start"], r["end"]) for r in rows)

    one = found()
    assert one == found(max_bytes=900) == found(max_bytes=3000) and any(x[3] for x in one)
    short = decontam.leaks(frame, bench.where("item_id <> 99")).where("contaminated").select("doc_id", "item_id").collect()
    assert sorted((x[0], x[1]) for x in one if x[3]) == sorted(map(tuple, short))


def test_a_very_long_text_and_a_very_long_item(spark):
    rng = random.Random(11)
    word = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    question, answer, book = word(20) + ".", word(5) + ".", word(20_000) + ". " + word(30) + "."
    long = word(100_000)
    docs = spark.createDataFrame([(1, long[:300_000] + " " + question + " " + answer + " " + long[300_000:]), (2, long), (3, word(50) + " " + book)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, question + " " + answer), (8, book)], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench).where("contaminated").collect()) == [(1, 7), (3, 8)]


def test_planted_items_are_found_and_clean_documents_stay(spark, case):
    items, docs = case
    frame, bench = spark.createDataFrame(docs, FIELDS), spark.createDataFrame(items, "item_id long, text string")
    found = decontam.leaks(frame, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found if r["contaminated"]} == {(d, d % 40) for d in range(0, 120, 4)}
    texts = {d: t for d, t, *_ in docs}
    for r in found:
        if r["contaminated"]:
            assert items[r["item_id"]][1].lower() in texts[r["doc_id"]][r["start"] : r["end"] + 1].lower()
    kept = decontam.decontaminate(frame, bench)
    assert kept.columns == frame.columns and sorted(r[0] for r in kept.collect()) == [d for d in range(120) if d % 4]
    parts = decontam.leaks(frame, bench, max_bytes=600)
    assert {(r["doc_id"], r["item_id"]) for r in parts.collect() if r["contaminated"]} == {(d, d % 40) for d in range(0, 120, 4)}


def test_nulls_repeats_and_empty_tables(spark):
    item = "one two three four five six seven. eight nine."
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x " + item), (3, item + " " + item), (3, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (None, item), (8, None), (9, "  ")], "item_id long, text string")
    got = sorted(((r["doc_id"] or -1, r["item_id"] or -1) for r in decontam.leaks(docs, bench).where("contaminated").collect()))
    assert got == sorted([(d, i) for d in (-1, 3, 3) for i in (7, -1)])
    assert decontam.leaks(docs, bench.limit(0)).count() == 0 and decontam.decontaminate(docs, bench.limit(0)).count() == 5
    assert decontam.leaks(docs.limit(0), bench).count() == 0
    asked = spark.createDataFrame([(5, "one two three four five six seven", "eight nine")], "item_id long, question string, answer string").selectExpr("*", "CAST(NULL AS STRING) AS text")
    assert decontam.leaks(docs, asked).where("contaminated").count() == 3


def test_split_item():
    assert decontam.split_item("What is it? A thing.") == ("What is it?", "A thing.")
    assert decontam.split_item("single") == ("single", "single")
    assert decontam.split_item("a b\nc d\n") == ("a b", "c d\n")


def test_bare_question_does_not_hide_a_copy_with_answer(spark):
    rng = random.Random(6)
    word = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    question, answer = word(30) + "?", word(20) + "."
    copy = "other " + question.split(" ", 1)[1] + " " + answer
    docs = spark.createDataFrame([(1, question + " " + word(300) + " " + copy), (2, question + " " + word(300)), (3, copy + " " + word(300) + " " + question)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, question + " " + answer)], "item_id long, text string")
    found = {r["doc_id"]: r for r in decontam.leaks(docs, bench, threshold=0.4).collect()}
    assert {d for d, r in found.items() if r["contaminated"]} == {1, 3} and found[1]["answer_overlap"] == 1
    assert [r[0] for r in decontam.decontaminate(docs, bench, threshold=0.4).collect()] == [2]


@pytest.mark.parametrize(("asked", "told"), [(12, 3), (12, 5), (16, 10), (20, 16), (30, 17)])
def test_copies_with_a_changed_word_in_question_and_answer(spark, asked, told):
    rng = random.Random(asked + told)
    word = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    question, answer, docs = word(asked), word(told), []
    for way in range(3):  # changed, left out, put in
        copy = [[*x[: len(x) // 2], *word(way != 1), *x[len(x) // 2 + (way != 2) :]] for x in (question, answer)]
        docs.append((way, " ".join([*word(40), *copy[0], *copy[1], *word(40)])))
    docs.append((3, " ".join([*word(40), *question, *word(40)])))
    docs.append((4, " ".join([*word(40), *question, *(x for w in answer for x in (w, *word(told)))])))  # the answer's words far apart
    bench = spark.createDataFrame([(7, " ".join(question), " ".join(answer), None)], "item_id long, question string, answer string, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r[0] for r in decontam.decontaminate(frame, bench).collect()) == [3, 4]


def test_in_order_share_equals_brute_force():
    rng = random.Random(9)

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = _next(row, x, b)
        return row[-1]

    def _next(row, x, b):
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(new[k], row[k + 1]))
        return new

    for _ in range(300):
        part, passage = ([rng.randrange(6) for _ in range(n)] for n in (rng.randrange(1, 17), rng.randrange(0, 40)))
        reach = len(part) + max(1, len(part) // 4)
        want = max((common(part, passage[a : a + reach]) for a in range(len(passage))), default=0) / len(part)
        assert decontam._in_order(np.array(part, np.uint64), np.array(passage, np.uint64)) == want
