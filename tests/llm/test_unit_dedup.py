import random
import re

import pytest

from tidelane.llm import textops, unit_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def units(text, kind):
    """(start, end of the last word, words) of each unit, by the definition."""
    out, now = [], []
    found = list(WORD.finditer(text))
    for i, m in enumerate(found):
        now.append(m)
        gap = text[m.end() : found[i + 1].start()] if i + 1 < len(found) else None
        picked = False
        if kind == "phrase":
            import pyarrow as pa

            h = textops.words(*textops.utf8(pa.array([m[0]])))[0]
            picked = int(textops.mix64(h ^ unit_dedup._R1)[0]) >> 60 == 0
        if gap is None or (gap.count("\n") >= 2 if kind == "paragraph" else "\n" in gap or "\r" in gap) or (kind in ("sentence", "phrase") and m[0][-1] in ".!?") or picked:
            out.append((now[0].start(), [x[0] for x in now]))
            now = []
    return out


def lower(words):
    return tuple(w.encode().lower().decode() for w in words)  # bytes.lower: A-Z only


def brute(rows, kind, least):
    seen, out = {}, {}
    for doc_id, text in sorted(rows):
        own = units(text, kind)
        drop = [False] * len(own)
        for i in range(len(own)):
            s, words = i, own[i][1]
            while len(words) < least and s > 0:
                s -= 1
                words = own[s][1] + words
            if len(words) < least:
                continue
            key = lower(words)
            if seen.setdefault(key, (doc_id, i)) != (doc_id, i):
                drop[s : i + 1] = [True] * (i + 1 - s)
        edges = [u[0] for u in own] + [len(text)]
        gone = [(edges[i], edges[i + 1]) for i in range(len(own)) if drop[i]]
        clean = text
        for a, b in reversed(gone):
            clean = clean[:a] + clean[b:]
        out[doc_id] = (clean, len(own), sum(drop))
    return out


@pytest.mark.parametrize("kind", unit_dedup.KINDS)
def test_equals_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(unit_dedup, "_FLUSH", 64)
    rng = random.Random(len(kind))
    say = lambda n: " ".join(rng.choice(["Été", "b", "c.", "d!", "E", "f\n", "g\n\n", "h\r\n", "i "]) + str(rng.randrange(9)) for _ in range(n))
    pool = [say(rng.randrange(1, 30)) for _ in range(12)]
    rows = [(i * 2, rng.choice(["", " ", "\n", ". "]).join(rng.choice(pool) if rng.random() < 0.6 else say(5) for _ in range(rng.randrange(0, 6)))) for i in range(60)]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, pos int, marked string")
    got = {r["doc_id"]: r for r in unit_dedup.dedup_units(docs, kind).collect()}
    want = brute(rows, kind, unit_dedup.MIN_WORDS[kind])
    texts = dict(rows)
    assert {k: (r["text"], r["n_units"], r["n_removed"]) for k, r in got.items()} == want
    for k, r in got.items():
        assert "".join(texts[k][s["start"] : s["end"]] for s in r["kept"]) == r["text"]
        spans = sorted([(s["start"], s["end"]) for s in [*r["kept"], *r["removed"]]])
        assert "".join(texts[k][a:b] for a, b in spans) == texts[k]


def test_inline_passage_is_caught_and_clean_texts_stay(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = " ".join(word() for _ in range(60))
    rows = [(i, " ".join(word() for _ in range(40)) + (" " + passage + " " if i % 3 == 0 else " ") + " ".join(word() for _ in range(40))) for i in range(30)]
    got = {r["doc_id"]: r for r in unit_dedup.dedup_units(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        if i % 3 or i == 0:
            assert got[i]["text"] == text and got[i]["n_removed"] == 0
        else:
            assert len(text) - len(got[i]["text"]) > len(passage) / 2


def test_nulls_repeats_and_empty_tables(spark):
    line = "one two three four five six seven eight nine"
    rows = [(None, line), (3, None), (4, ""), (5, line), (5, line), (6, line + "\n" + line), (7, "Short."), (8, "Short.")]
    got = sorted(((r["doc_id"] or -1, r["text"], r["n_removed"]) for r in unit_dedup.dedup_units(spark.createDataFrame(rows, "doc_id long, text string"), "line").collect()), key=str)
    assert got == sorted([(-1, line, 0), (3, None, 0), (4, "", 0), (5, line, 0), (5, line, 0), (6, "", 2), (7, "Short.", 0), (8, "", 1)], key=str)
    assert unit_dedup.dedup_units(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_short_lines_and_paragraphs_go_after_any_text(spark):
    rows = [(1, "Alpha beta\nof, edti oner.\n"), (2, "Gamma delta\nof, edti oner.\nepsilon"), (3, "of, EDTI  oner."), (4, "say of, edti oner."), (5, "zeta eta\ntheta\n\niota"), (6, "kappa\n\nzeta eta theta\n\nlambda")]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in unit_dedup.dedup_units(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (rows[0][1], 0) and got[2] == ("Gamma delta\nepsilon", 1) and got[3] == ("", 1)
    assert got[4] == (rows[3][1], 0)  # a part of a line
    assert got[5] == (rows[4][1], 0) and got[6][0] == "kappa\n\nlambda"


def _pasted(spark, make, join, size, seed):
    """Shares of passages of ``size`` that are removed in the second of two texts, each pasted into other text, and texts' own losses."""
    rng = random.Random(seed)
    rows, passages = [], []
    for i in range(0, 200, 2):
        passages.append(join.join(make(rng) for _ in range(size)))
        rows += [(i + k, join.join([*(make(rng) for _ in range(40)), passages[-1], *(make(rng) for _ in range(40))])) for k in (0, 1)]
    texts = dict(rows)
    shares = []
    for r in unit_dedup.dedup_units(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        text, passage = texts[r["doc_id"]], passages[r["doc_id"] // 2]
        at = text.index(passage)
        if r["doc_id"] % 2 == 0:
            assert r["text"] == text
        else:
            assert all(at <= s["start"] and s["end"] <= at + len(passage) + len(join) for s in r["removed"])
            shares.append((len(text) - len(r["text"])) / len(passage))
    return shares


def test_passages_of_51_words_without_punctuation_inside_lines(spark):
    shares = _pasted(spark, lambda rng: "".join(rng.choice("abcdefghij") for _ in range(6)), " ", 51, 6)
    assert len(shares) == 100 and min(shares) > 0.6 and sum(shares) / len(shares) > 0.8


def test_passages_inside_lines_without_spaces(spark):
    for first in (0x4E00, 0x0E01):
        shares = _pasted(spark, lambda rng, first=first: chr(first + rng.randrange(2000 if first > 0x2000 else 46)), "", 120, 7)
        assert len(shares) == 100 and min(shares) > 0.4
    shares = _pasted(spark, lambda rng: rng.choice("abcdefghijklmnopqrstuvwxyz0123456789"), "", 500, 8)
    assert len(shares) == 100 and min(shares) > 0.4


def test_ideographic_full_stops_end_units(spark):
    rows = [(1, "天地玄黄宇宙。洪荒日月！盈昃？辰宿")]
    import pyarrow as pa

    data, offsets = textops.utf8(pa.array([rows[0][1]]))
    cut = unit_dedup._cut_words(data, *textops.words(data, offsets))
    last = unit_dedup._unit_ends(data, *cut, unit_dedup.PASSAGE)
    ends = {len(data[: cut[2][i]].tobytes().decode()) for i in last}
    assert {7, 12, 15, 17} <= ends


def test_texts_of_one_id_are_judged_each(spark):
    """A hot doc_id with many texts: each keeps its own marks, and one text of an id is the first of a shared line."""
    line = "one two three four five six seven eight nine ten"
    rows = [(1, f"{line}\nown {i} " + " ".join(f"w{i}x{k}" for k in range(9))) for i in range(50)]
    got = unit_dedup.dedup_units(spark.createDataFrame(rows, "doc_id long, text string"), "line").collect()
    assert sorted(r["n_removed"] for r in got) == [0] + [1] * 49
    assert sorted(r["text"] for r in got if r["n_removed"]) == sorted(t.split("\n")[1] for _, t in rows if t not in [r["text"] for r in got])


def test_a_very_long_text_and_ties_across_partitions(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = " ".join(word() for _ in range(60))
    long = " ".join(word() for _ in range(200_000))
    rows = [(9, long + "\n" + passage), (3, passage + "\n" + long[: 1 << 20]), *((7, "a b c d e f g h i\n" + passage) for _ in range(40))]
    got = unit_dedup.dedup_units(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), "line").collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], set()).add((r["text"], r["n_removed"]))
    assert by_id[3] == {(rows[1][1], 0)} and by_id[9] == {(long + "\n", 1)} and by_id[7] == {("a b c d e f g h i\n", 1)}


def passage_keys(text):
    """(first unit, last unit, words) of each key of a text of short words, and where units begin, by the definition of passages."""
    import pyarrow as pa

    found = list(WORD.finditer(text))
    n = len(found)
    words = [m[0].encode().lower().decode() for m in found]
    hashes = textops.mix64(textops.words(*textops.utf8(pa.array([text])))[0] ^ unit_dedup._R1).tolist()
    picked = {max(i for i in range(k, k + 8) if hashes[i] == min(hashes[k : k + 8])) for k in range(n - 7)}
    gap = [text[found[i].end() : found[i + 1].start()] if i + 1 < n else "\n\n" for i in range(n)]
    last = [i for i in range(n) if i in picked or words[i][-1] in ".!?" or "\n" in gap[i]]
    begin = [0] + [i + 1 for i in last[:-1]] if last else []
    keys = set()
    for u, end in enumerate(last):
        starts = [s for s in range(u + 1) if end + 1 - begin[s] >= 20]
        if starts:
            keys.add((max(starts), u))
        for feeds in (1, 2):  # a line, a paragraph
            if gap[end].count("\n") >= feeds:
                s = u
                while s and gap[last[s - 1]].count("\n") < feeds:
                    s -= 1
                keys.add((s, u))
    return [(s, u, tuple(words[begin[s] : last[u] + 1])) for s, u in keys], [found[b].start() for b in begin]


def plain_passages(rows):
    first, of = {}, {}
    for doc_id, text in rows:
        of[doc_id] = passage_keys(text)
        for _, u, words in of[doc_id][0]:
            first[words] = min(first.get(words, (doc_id, u)), (doc_id, u))
    out = {}
    for doc_id, text in rows:
        keys, begin = of[doc_id]
        drop = {x for s, u, words in keys if (doc_id, u) > first[words] for x in range(s, u + 1)}
        edges = [*begin, len(text)]
        clean = text[: edges[0]] + "".join(text[edges[i] : edges[i + 1]] for i in range(len(begin)) if i not in drop)
        out[doc_id] = (clean, len(begin), len(drop))
    return out


def test_passages_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(unit_dedup, "_FLUSH", 64)
    rng = random.Random(21)
    say = lambda n: " ".join(rng.choice(["to", "be", "or", "not", "Be", "wow.", "x", "the", "wh", "of", "an", "in"]) for _ in range(n))
    shared = [" ".join(f"p{k}w{i}" for i in range(n)) for k, n in enumerate((12, 25, 40, 60))]
    rows = []
    for d in range(120):
        parts = [rng.choice([say(rng.randrange(0, 30)), rng.choice(shared), say(4) + " " + rng.choice(shared) + " " + say(5)]) for _ in range(rng.randrange(0, 6))]
        rows.append((d, "".join(p + rng.choice([" ", "\n", "\n\n", "\n \n"]) for p in parts)))
    want = plain_passages(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["text"], r["n_units"], r["n_removed"]) for r in unit_dedup.dedup_units(docs).collect()}
    assert got == want and sum(w[2] for w in want.values()) > 200
