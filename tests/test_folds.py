"""Queries that SQL can't express, row by row against plain models written from their rules, over the smallest tables."""

import itertools
import math
import os
import re
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelane.functions import lexicons as lex
from tidelane.operators import highlights as hl
from tidelane.operators import ranking, stories, tracks
from tidelane.plans import catalog, media_queries, text_queries, timeline_queries
from tidelane.sources.tables import source, table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def by_key(df, key, order):
    out = defaultdict(list)
    for r in sorted((r.asDict() for r in df.collect()), key=lambda r: tuple(r[c] for c in order)):
        out[r[key]].append(r)
    return out


def flat(x):
    return round(x, 6) if isinstance(x, float) else tuple(map(flat, x)) if isinstance(x, (list, tuple)) else x


def check(spark, name, columns, want):
    got = catalog.queries()[name](spark, SF).select(*columns).collect()
    assert len(want) > 0
    assert sorted((flat(tuple(r)) for r in got), key=repr) == sorted((flat(tuple(r)) for r in want), key=repr)


@pytest.fixture(scope="module")
def words(spark):
    return by_key(text_queries._stream(spark, SF), "conv_id", ["start", "pos"])


@pytest.fixture(scope="module")
def spans(spark):
    return by_key(table(spark, SF, "span"), "key", ["start_ms", "id"])


def clean(ws):
    return " ".join(w for i, w in enumerate(ws) if i == 0 or w.lower() != ws[i - 1].lower())


def ends(w):
    return w[-1:] in (".", "!", "?")


def cut_runs(rows, last):
    """Rows cut after each index for which ``last(rows, first, i)`` holds; and what is left."""
    out, a = [], 0
    for i in range(len(rows)):
        if last(rows, a, i):
            out.append(rows[a : i + 1])
            a = i + 1
    return out, rows[a:]


def test_segments(spark, words):
    want = []
    for k, rows in words.items():
        runs, _ = cut_runs(rows, lambda r, a, i: r[i]["end"] - r[a]["start"] >= 15 or r[i]["end"] - r[a]["start"] >= 3 and ends(r[i]["word"]))
        want += [(k, r[0]["start"], r[-1]["end"], clean([x["word"].strip() for x in r]), ends(r[-1]["word"]), len(r)) for r in runs]
    check(spark, "i10_segments", ["conv_id", "start", "end", "text", "complete", "words"], want)


def test_legacy_segments(spark, words):
    want = []
    for k, rows in words.items():
        total = max(r["end"] for r in rows)
        runs, _ = cut_runs(rows, lambda r, a, i: r[i]["end"] - r[a]["start"] >= 10 or r[i]["end"] - r[a]["start"] >= 5 and ends(r[i]["word"]))
        for r in runs:
            text = " ".join(x["word"] for x in r)
            energy = (k + min(int((r[0]["start"] + r[-1]["end"]) / 2 / total * 10), 9)) % 10 / 10
            want.append((k, r[0]["start"], r[-1]["end"], text, 2.0 * any(ends(x["word"]) for x in r) + min(3.0, 3.0 * sum(w in text.lower() for w in lex.LEGACY_KEYWORDS)) + 2 * energy))
    check(spark, "i11_legacy_segments", ["conv_id", "start", "end", "text", "score"], want)


def test_word_groups(spark, words):
    want = []
    for k, rows in words.items():
        runs, rest = cut_runs(rows, lambda r, a, i: i - a == 4 or ends(r[i]["word"].strip()))
        for r in [*runs, *([rest] if rest else [])]:
            text = clean([x["word"].strip() for x in r]).strip()
            if text:
                want.append((k, text, math.floor(r[0]["start"] * 1000), math.floor(r[-1]["end"] * 1000), np.mean([x["confidence"] for x in r]).item()))
    check(spark, "i12_word_groups", ["conv_id", "text", "start_ms", "end_ms", "confidence"], want)


def test_subtitle_lines(spark, words):
    want = []
    for k, rows in words.items():
        said = [(i, r) for i, r in enumerate(rows)]
        kept, before = [], None
        for i, r in said:  # repeats of the last word that was kept go
            if before is None or r["word"].lower().strip() != before:
                kept.append(i)
                before = r["word"].lower().strip()
        lines, first, held = [], 0, []
        for i in kept:
            held.append(rows[i]["word"])
            seconds = rows[i]["end"] - rows[first]["start"]
            if seconds >= 5 or seconds >= 3 and rows[i]["word"].endswith((".", "!", "?", ",")):
                lines.append([rows[first]["start"], rows[i]["end"], held])
                first, held = i + 1, []
        if held:
            lines.append([rows[first]["start"], rows[-1]["end"], held])
        for n in range(len(lines)):
            a, b, _ = lines[n]
            if n and a < lines[n - 1][1]:
                a = lines[n - 1][1] + 0.1
            lines[n][:2] = [a, b if b > a else a + 0.5]
        for n, (a, b, ws) in enumerate(lines):
            if n + 1 < len(lines):
                if b > lines[n + 1][0]:
                    b = lines[n + 1][0] - 0.05
                b = max(b, a + 0.2)
            want.append((k, n + 1, a, b, clean(" ".join(ws).split())))
    check(spark, "i13_subtitle_lines", ["conv_id", "line", "start", "end", "text"], want)


def test_jittered_words(spark, words):
    want = []
    for k, rows in words.items():
        both = sorted([(r["start"], r["pos"], r["end"], r["word"], r["confidence"]) for r in rows] + [(r["start"] + 0.02, r["pos"], r["end"] + 0.02, r["word"], r["confidence"] + 0.01) for r in rows])
        while both:
            near = list(itertools.takewhile(lambda r: r[0] - both[0][0] <= 0.05, both))
            best = max(near, key=lambda r: (r[4], -len(r[3])))
            want.append((k, best[0], best[2], best[3], best[4]))
            both = both[len(near) :]
    check(spark, "i7_merge_jitter", ["conv_id", "start", "end", "word", "confidence"], want)


def merged(a, b):
    taken, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if j == len(b) or i < len(a) and a[i][1] <= b[j][0]:
            taken.append(a[i])
            i += 1
        elif i == len(a) or b[j][1] <= a[i][0]:
            taken.append(b[j])
            j += 1
        else:
            taken.append(b[j] if b[j][3] > a[i][3] else a[i])
            i, j = i + 1, j + 1
    if not a or not b:
        return taken
    out, reached = [], -1.0
    for r in sorted(taken, key=lambda r: r[0]):
        if r[0] >= reached * 0.95:
            reached = r[1]
            if out and out[-1][2].lower().strip() == r[2].lower().strip():
                out[-1] = (out[-1][0], r[1], out[-1][2], max(r[3], out[-1][3]))
            else:
                out.append(r)
    return out


def test_merged_streams(spark, words):
    want = []
    for k, rows in words.items():
        a = [(r["start"], r["end"], r["word"], r["confidence"]) for r in rows]
        b = [(r["start"] + 0.01, r["end"] + 0.01, r["word"], r["confidence"] * (r["pos"] % 2 + 0.5)) for r in rows if r["pos"] % 3 != 1]
        want += [(k, *r) for r in merged(a, b)]
    check(spark, "i9_merge_streams", ["conv_id", "start", "end", "word", "confidence"], want)


def test_streams_of_any_overlap_merge_as_lists_do(spark):
    """Long and short words, one side ending early or empty."""
    import random

    from tidelane.operators import highlights

    rng, rows, want = random.Random(4), ([], []), []
    for k in range(40):
        sides = [sorted((t, t + rng.choice([0.1, 1.0, 30.0]), rng.choice("abc"), rng.random()) for t in (rng.uniform(0, rng.choice([5, 60])) for _ in range(rng.choice([0, 1, 30])))) for _ in range(2)]
        for s in (0, 1):
            rows[s].extend((k, i, *r) for i, r in enumerate(sides[s]))
        want += [(k, *r) for r in merged(*sides)]
    left, right = (spark.createDataFrame(r, "key int, pos int, start double, end double, word string, confidence double") for r in rows)
    got = highlights.merge_streams(left, right, ["key"]).select("key", "start", "end", "word", "confidence").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_short_turns(spark, words):
    want = []
    for k, rows in words.items():
        turns = [[g[0]["speaker"], g[0]["start"], g[0]["start"] + 0.2 * len(g)] for g in (list(x) for _, x in itertools.groupby(sorted(rows, key=lambda r: r["pos"]), key=lambda r: r["speaker"]))]
        out = []
        for t in sorted(turns, key=lambda t: (t[1], t[2])):
            if out and t[2] - t[1] < 2.0 and t[1] - out[-1][2] < 0.5:
                out[-1] = [t[0] if t[2] > t[1] else out[-1][0], out[-1][1], t[2]]
            else:
                out.append(t)
        want += [(k, *t) for t in out]
    check(spark, "i20_absorb_short_turns", ["conv_id", "speaker", "start", "end"], want)


def test_scored_segments(spark):
    closed = by_key(catalog.queries()["i10_segments"](spark, SF), "conv_id", ["start"])
    strip = lambda w: w.lower().strip(".,!?;:")
    want = []
    for k, rows in closed.items():
        total = max(r["end"] for r in rows)
        for r in rows:
            ws = r["text"].split()
            ws = [w for i, w in enumerate(ws) if len(ws) == 1 or not (i and strip(w) == strip(ws[i - 1]) != "")]
            text, n = " ".join(ws), len(ws)
            letters = sum(map(len, ws)) / max(n, 1)
            score = 2.0 * r["complete"] + (4.0 if 10 <= n <= 50 else 2.0 if 5 <= n <= 60 else 0.0) + (2.0 if re.search("[.!?]", text) else 0.0) + (3.0 if letters >= 5 else 1.0 if letters >= 4 else 0.0)
            energy = (k + min(int((r["start"] + r["end"]) / 2 / total * 10), 9)) % 10 / 10
            score += 2 * energy + min((r["end"] - r["start"]) / 10, 2.0)
            if score >= 4:
                want.append((k, int(r["start"] * 1000), int(r["end"] * 1000), text, score, energy))
    check(spark, "r1_scored_segments", ["conv_id", "start_ms", "end_ms", "text", "score", "audio_energy"], want)


def test_merged_payloads_and_stale_totals(spark):
    rows = by_key(text_queries._scored(spark, SF), "conv_id", ["start_ms", "id"])
    want, stale = [], []
    for k, own in rows.items():
        out = []
        for r in own:
            p = out[-1] if out else None
            if p and (r["start_ms"] < p["end_ms"] and p["start_ms"] < r["end_ms"] or abs(p["end_ms"] - r["start_ms"]) <= 1000):
                lo, hi = min(p["start_ms"], r["start_ms"]), max(p["end_ms"], r["end_ms"])
                top, low = (p, r) if p["total"] >= r["total"] else (r, p)
                mix = lambda c, p=p, r=r, n=hi - lo: (p[c] * (p["end_ms"] - p["start_ms"]) + r[c] * (r["end_ms"] - r["start_ms"])) / n
                m = {"start_ms": lo, "end_ms": hi, "source": f"{top['source']}+{low['source']}", "text": (f"{top['text']} {low['text']}" if abs(p["total"] - r["total"]) < 1 else top["text"]).strip()}
                m |= {c: mix(c) for c in ("base", "clarity")} | {c: max(p[c], r[c]) for c in ("energy", "visual", "narrative")} | {"uniqueness": (p["uniqueness"] + r["uniqueness"]) / 2}
                m["total"] = sum(m[c] for c in ("base", "clarity", "energy", "visual", "narrative", "uniqueness"))
                m["bonus"] = 0.0 if hi - lo <= 8000 else 0.5 if hi - lo <= 15000 else 1.0
                out[-1] = m
            else:
                out.append(r)
        want += [(k, r["start_ms"], r["end_ms"], r["text"], r["source"], r["total"]) for r in out]
        stale += [(k, r["start_ms"], r["source"], r["total"], r["bonus"]) for r in out]
    check(spark, "i2_merge_payload", ["conv_id", "start_ms", "end_ms", "text", "source", "total"], want)
    check(spark, "i3_stale_totals", ["conv_id", "start_ms", "source", "total", "bonus"], stale)


def test_greedy_selections(spark, spans):
    apart, gap = [], []
    for k, rows in spans.items():
        best, chosen, left, starts = sorted(rows, key=lambda r: (-r["value"], r["id"])), [], 36000000, []
        for r in best:
            if len(chosen) < 8 and all(r["end_ms"] <= c["start_ms"] or r["start_ms"] >= c["end_ms"] for c in chosen) and r["end_ms"] - r["start_ms"] <= left:
                chosen.append(r)
                left -= r["end_ms"] - r["start_ms"]
        apart += [(k, r["id"]) for r in chosen]
        for r in best:
            if len(starts) < 10 and not any(abs(r["start_ms"] - x) < 86400000 for x in starts):
                starts.append(r["start_ms"])
                gap.append((k, r["id"]))
    check(spark, "o9_greedy_apart", ["key", "id"], apart)
    check(spark, "o17_greedy_gap", ["key", "id"], gap)


BEAT = {"view": "hook", "click": "development", "signup": "climax", "purchase": "resolution"}


def test_interleaved_beats(spark, spans):
    want = []
    for k, rows in spans.items():
        place = {b: i for i, b in enumerate(lex.BEAT_ORDER)}
        beats = sorted((r for r in rows if r["value"] > 120), key=lambda r: place.get(BEAT.get(r["kind"]), 99))
        others = [r for r in rows if not r["value"] > 120]
        out = []
        for i, b in enumerate(beats):
            since = beats[i - 1]["end_ms"] if i else 0
            out += [o["id"] for o in others if since <= o["start_ms"] < b["start_ms"]][:2] + [b["id"]]
        out += [o["id"] for o in others if o["start_ms"] >= beats[-1]["end_ms"]][:2] if beats else [o["id"] for o in others]
        want += [(k, n + 1, i) for n, i in enumerate(out)]
    check(spark, "o14_interleave", ["key", "place", "id"], want)


def test_arcs(spark, spans):
    want, target = [], lex.ARCS["cinderella"]
    for k, rows in spans.items():
        v = [r["k"] / 50 - 1 for r in rows]
        if len(rows) <= 8:
            def cost(p, v=v):
                x = np.linspace(0, len(p) - 1, 6)
                return float(((np.interp(x, range(len(p)), [v[i] for i in p]) - target) ** 2).sum())

            costs = {p: cost(p) for p in itertools.permutations(range(len(rows)))}
            got = {r["id"]: r["place"] for r in catalog.queries()["o16_match_arc"](spark, SF).where(f"key = {k}").collect()}
            chosen = tuple(sorted(range(len(rows)), key=lambda i: got[rows[i]["id"]]))
            assert costs[chosen] <= min(costs.values()) + 1e-9
            want += [(k, n + 1, rows[i]["id"]) for n, i in enumerate(chosen)]
            continue
        left, order = list(range(len(rows))), []
        for t in target:
            order.append(min(left, key=lambda i: (abs(v[i] - t), i)))
            left.remove(order[-1])
        want += [(k, n + 1, rows[i]["id"]) for n, i in enumerate(order + left)]
    check(spark, "o16_match_arc", ["key", "place", "id"], want)


def test_small_arcs(spark):
    from tidelane.operators import ranking

    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([1.0, -0.8, 0.0, 0.5, 0.3, -0.6])] + [(2, 7, 0.4)], "key int, id int, v double")
    got = [(r["key"], r["id"]) for r in ranking.match_arc(df, ["key"], "v", ["id"]).orderBy("key", "place").collect()]
    assert got == [(1, 2), (1, 4), (1, 5), (1, 1), (1, 3), (1, 0), (2, 7)]


BEATS = ["hook", "setup", "context", "rising_action", "climax", "falling_action", "resolution", "call_to_action"]


def best_story(rows, deps):
    """The best of the first hundred orders, by trying permutations; by beats if there is none."""
    n, best = len(rows), None
    fit = (p for p in itertools.permutations(range(n)) if all(p.index(d) < p.index(i) for i in range(n) for d in deps[i]))
    for p in itertools.islice(fit, 100):
        o = [rows[i] for i in p]
        at = {b: [r["beat"] for r in o].index(b) for b in {r["beat"] for r in o}}
        s = 10.0 * sum(at[a] < at[b] for a, b in zip(BEATS, BEATS[1:]) if a in at and b in at)
        for a, b in zip(o, o[1:]):
            s -= abs(a["emotion"] - b["emotion"]) * 2.0
        s -= 0.5 * abs(max(range(n), key=lambda i: (o[i]["tension"], -i)) - 0.7 * n)
        if best is None or s > best[0]:
            best = (s, p)
    return best[1] if best else sorted(range(n), key=lambda i: (BEATS + [rows[i]["beat"]]).index(rows[i]["beat"]))


def plain_orders(before):
    """All orders, smallest first, by recursion."""

    def walk(chosen):
        if len(chosen) == len(before):
            yield chosen
        for i in range(len(before)):
            if i not in chosen and all(d in chosen for d in before[i]):
                yield from walk([*chosen, i])

    return walk([])


def test_story_orders(spark):
    from pyspark.sql import functions as F

    from tidelane.functions import scoring

    t = text_queries._turns(spark, SF).select("conv_id", "turn", scoring.story_beat(F.col("text"), F.col("p")).alias("beat"), scoring.polarity(F.col("text")).alias("emotion"), scoring.tension(F.col("text"), F.col("p")).alias("tension"))
    depends = defaultdict(set)
    for r in catalog.queries()["j14_dependencies"](spark, SF).collect():
        depends[r.conv_id, r.turn].add(r.depends_on)
    assert sum(map(len, depends.values())) > 10
    want = []
    for k, rows in by_key(t, "conv_id", ["turn"]).items():
        at = {r["turn"]: i for i, r in enumerate(rows)}
        deps = [{at[x] for x in depends[k, r["turn"]]} for r in rows]
        if len(rows) > 8:
            rows_of = list(itertools.islice(plain_orders(deps), 100))
            assert rows_of == list(itertools.islice(stories.orders(deps), 100))
        want += [(k, i + 1, rows[j]["turn"]) for i, j in enumerate(best_story(rows, deps))] if len(rows) <= 8 else []
    got = [r for r in map(tuple, catalog.queries()["o15_story_order"](spark, SF).select("conv_id", "place", "turn").collect())]
    short = {k for k, *_ in want}
    assert sorted(r for r in got if r[0] in short) == sorted(want) and len(got) == sum(1 for _ in t.collect())


def test_orders_equal_recursion():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(0, 7))
        before = [{int(x) for x in rng.integers(0, n, rng.integers(0, 3)) if x != i or rng.random() < 0.1} for i in range(n)]
        assert list(stories.orders(before)) == list(plain_orders(before))


STORY = "key int, id int, beat string, emotion double, tension double, deps array<int>"


def story(spark, rows):
    return [r.id for r in stories.story_order(spark.createDataFrame(rows, STORY), ["key"], ["id"]).orderBy("place").collect()]


def test_dependencies_come_first(spark):
    assert story(spark, [(1, 0, "resolution", 0.0, 0.1, [1, 2]), (1, 1, "hook", 0.0, 0.2, []), (1, 2, "climax", 0.0, 0.9, [1])]) == [1, 2, 0]


def test_circles_are_ordered_by_beats(spark):
    rows = [(1, 0, "other", 0.0, 0.1, [3]), (1, 1, "climax", 0.5, 0.2, None), (1, 2, "climax", 0.0, 0.9, [1, None, 77, -1]), (1, 3, "hook", None, None, [0]), (1, 4, None, 0.0, 0.9, [])]
    assert story(spark, rows) == [3, 1, 2, 0, 4]
    assert story(spark, [(1, 0, "climax", 0.0, 0.1, [0]), (1, 1, "hook", 0.0, 0.2, [])]) == [1, 0]


def test_a_key_of_many_rows_has_an_order(spark):
    n = 10_000
    rows = [(1, i, BEATS[i % 8], (i % 7) / 7, (i % 11) / 11, [i + 1] if i % 2 == 0 else [i - 3] if i > 3 and i % 3 == 0 else []) for i in range(n)]
    got = story(spark, rows)
    at = {x: i for i, x in enumerate(got)}
    assert sorted(got) == list(range(n)) and all(at[d] < at[r[1]] for r in rows for d in r[5])
    assert story(spark, [(1, i, "hook", 0.0, 0.0, [(i + 1) % n]) for i in range(n)]) == list(range(n))


def plain_apart(rows, seconds, most):
    chosen = []
    for i, s, e, v in sorted(rows, key=lambda r: (-r[3], r[0])):
        if any(s < y and e > x for _, x, y in chosen) or seconds is not None and sum(y - x for _, x, y in chosen) + (e - s) > seconds:
            continue
        chosen.append((i, s, e))
        if most is not None and len(chosen) == most:
            break
    return [i for i, *_ in chosen]


def test_greedy_choices_equal_plain_ones_and_take_many_rows(spark):
    rng = np.random.default_rng(4)
    for size in (3, 30):
        rows = [(k, i, int(s), int(s + rng.integers(-1 if k == 3 else 0, size)), float(rng.integers(0, 5))) for k in range(4) for i, s in enumerate(rng.integers(0, 100, 80))]
        df = spark.createDataFrame([*rows, (1, 900, None, 5, 9.0), (1, 901, 5, None, 9.0)], "key int, id int, s int, e int, v double")
        for seconds, most in ((None, None), (60, 5)):
            got = ranking.greedy_apart(df, ["key"], "v", "s", "e", "id", seconds, most).collect()
            assert {(r.key, r.id) for r in got} == {(k, i) for k in range(4) for i in plain_apart([r[1:] for r in rows if r[0] == k], seconds, most)}
        got = {(r.key, r.id) for r in ranking.greedy_gap(df, ["key"], "v", "s", "id", 4, 20).collect()}
        want = set()
        for k in range(4):
            chosen = []
            for r in sorted((r for r in [*rows, (1, 901, 5, None, 9.0)] if r[0] == k), key=lambda r: (-r[4], r[1])):
                if all(abs(r[2] - x) >= 4 for x in chosen) and len(chosen) < 20:
                    chosen.append(r[2])
                    want.add((k, r[1]))
        assert got == want
    taken = ranking.Taken()
    began = time.perf_counter()
    for i in range(100_000):
        if not taken.overlap(i * 7919 % 100_003, i * 7919 % 100_003 + 1):
            taken.add(i * 7919 % 100_003, i * 7919 % 100_003 + 1)
    assert len(taken.starts) == 100_000 and time.perf_counter() - began < 20


def test_boxes_in_grids_equal_plain_ones(spark):
    rng = np.random.default_rng(5)
    rows = [(k, i, *map(float, np.round(rng.uniform(-50, 50, 2), 1)), *map(float, np.round(rng.choice([0.5, 5, 40], 2) * rng.uniform(-0.1, 1, 2), 1))) for k in range(3) for i in range(200)]
    want = set()
    for k in range(3):
        kept = []
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: (-(r[4] * r[5]), r[1])):
            if not any(r[2] < b[2] + b[4] and r[2] + r[4] > b[2] and r[3] < b[3] + b[5] and r[3] + r[5] > b[3] for b in kept):
                kept.append(r)
                want.add((k, r[1]))
    df = spark.createDataFrame([*rows, (1, 999, None, 1.0, 1.0, 1.0)], "key int, id int, x double, y double, w double, h double")
    assert {(r.key, r.id) for r in tracks.boxes_apart(df, ["key"]).collect()} == want and 20 < len(want) < 500


def test_state_machines(spark, spans):
    intervals, pauses, guard, bucket, breaker = [], [], [], [], []
    for k, rows in spans.items():
        now = 0.1
        for r in rows:
            now = min(5.0, now * 1.5) if r["kind"] == "error" else max(0.1, now / 1.5)
            intervals.append((k, r["id"], now))
        last = -math.inf
        for r in rows:
            if r["kind"] == "error" and r["start_ms"] / 1000 - last >= 172800:
                last = r["start_ms"] / 1000
                pauses.append((k, r["id"]))
        spent = 0.0
        for r in rows:
            ok = spent + r["value"] / 10 <= 100
            spent += r["value"] / 10 * ok
            guard.append((k, r["id"], ok, spent))
        tokens, before = 20.0, rows[0]["start_ms"]
        for i, r in enumerate(rows):
            tokens = min(25.0, tokens + (r["start_ms"] / 1000 - before / 1000) * 0.0003) if i else tokens
            before, ok = r["start_ms"], tokens >= r["value"] / 10
            tokens -= r["value"] / 10 * ok
            bucket.append((k, r["id"], ok, tokens))
        state, bad, good, since = "CLOSED", 0, 0, 0.0
        for r in rows:
            t, fine = r["start_ms"] / 1000, r["k"] > 35
            if state == "OPEN" and t - since >= 7200:
                state, good = "HALF_OPEN", 0
            through = state != "OPEN"
            if through and fine:
                bad, good = 0, good + (state == "HALF_OPEN")
                state = "CLOSED" if state == "HALF_OPEN" and good == 3 else state
            elif through:
                bad, since = bad + 1, t
                state = "OPEN" if bad >= 3 else state
            breaker.append((k, r["id"], through, state))
    check(spark, "t7_adaptive_interval", ["key", "id", "interval"], intervals)
    check(spark, "t3_cooldown", ["key", "id"], pauses)
    check(spark, "t10_budget_guard", ["key", "id", "allowed", "total"], guard)
    check(spark, "t5_token_bucket", ["key", "id", "allowed", "tokens"], bucket)
    check(spark, "t6_circuit_breaker", ["key", "id", "executed", "state"], breaker)


def test_short_segments_and_smoothed_speakers(spark):
    merge, smooth = [], []
    for k, rows in by_key(media_queries._segments(spark, SF), "key", ["start", "end"]).items():
        out = []
        for r in rows:
            if out and out[-1][2] - out[-1][1] < 30 and out[-1][0] == r["speaker"] and r["start"] - out[-1][2] < 3600:
                out[-1][2] = r["end"]
            else:
                out.append([r["speaker"], r["start"], r["end"]])
        merge += [(k, *x) for x in out]
    for k, rows in by_key(media_queries._segments(spark, SF), "key", ["start", "id"]).items():
        who = [r["speaker"] for r in rows]
        for i in range(1, len(rows) - 1):
            if who[i - 1] == who[i + 1] and rows[i]["start"] - rows[i - 1]["end"] < 3600 and rows[i + 1]["start"] - rows[i]["end"] < 3600:
                who[i] = who[i - 1]
        smooth += [(k, r["id"], w) for r, w in zip(rows, who)]
    check(spark, "i19_merge_short", ["key", "speaker", "start", "end"], merge)
    check(spark, "w15_smooth_speakers", ["key", "id", "speaker"], smooth)


def test_crops(spark):
    want = []
    for k, rows in by_key(media_queries._boxes(spark, SF), "key", ["id"]).items():
        now = {c: rows[0][c] for c in "xywh"}
        for r in rows:
            now = {c: math.trunc(now[c] * 0.9 + r[c] * 0.1) if r is not rows[0] else now[c] for c in "xywh"}
            want.append((k, r["id"], *now.values()))
    check(spark, "w14_smooth_crops", ["key", "frame", "x", "y", "w", "h"], want)


def test_bridges(spark, spans):
    want = []
    for k, rows in spans.items():
        clips = sorted(rows, key=lambda r: -r["k"] * 100000 + r["id"])
        out, used = [], set()
        for i, c in enumerate(clips):
            if i and abs(c["start_ms"] - clips[i - 1]["end_ms"]) > 120000:
                gap = [x for x in clips[i + 1 :] if clips[i - 1]["end_ms"] < x["start_ms"] < c["start_ms"] and x["id"] not in used]
                soonest = min(gap, key=lambda x: x["start_ms"], default=None)
                if soonest and soonest["kind"] != "error":
                    out.append(soonest["id"])
                    used.add(soonest["id"])
            out.append(c["id"])
        want += [(k, n + 1, i) for n, i in enumerate(out)]
    check(spark, "i28_bridged_clips", ["key", "place", "id"], want)


def test_two_speakers(spark, spans):
    want = []
    for k, rows in spans.items():
        rows = sorted(rows, key=lambda r: r["id"])
        x = np.array([[r["value"], r["k"]] for r in rows], float)
        z = (x - x.mean(0)) / (x.std(0) + 1e-8)
        centre = [z[x[:, 0].argmax()], z[x[:, 0].argmin()]]
        for _ in range(5):
            side = np.array([int(np.sum((p - centre[1]) ** 2) < np.sum((p - centre[0]) ** 2)) for p in z])
            centre = [z[side == s].mean(0) if (side == s).any() else centre[s] for s in (0, 1)]
        want += [(k, r["id"], f"SPEAKER_0{s if len(rows) > 1 else 0}") for r, s in zip(rows, side)]
    check(spark, "i22_two_speakers", ["key", "id", "speaker"], want)


def test_monologues(spark, spans):
    want = []
    for k, rows in spans.items():
        x = [{"id": r["id"], "s": r["start_ms"] / 3600000, "e": r["start_ms"] / 3600000 + r["k"] / 10, "v": r["value"], "who": f"SPEAKER_0{int(r['k'] >= 90)}"} for r in sorted(rows, key=lambda r: (r["start_ms"], r["id"]))]
        now, spoken, since = x[0]["who"], 0.0, 0
        for i, r in enumerate(x):
            if r["who"] != now:
                now, spoken, since = r["who"], 0.0, i
            spoken += r["e"] - r["s"]
            after = x[i + 1] if i + 1 < len(x) else None
            if after and spoken > 20 and i - since > 2 and after["s"] - r["e"] > 1.5 and abs(r["v"] - after["v"]) > 0.3 * (r["v"] + 1e-8):
                now = after["who"] = {"SPEAKER_00": "SPEAKER_01", "SPEAKER_01": "SPEAKER_00"}[now]
                spoken, since = 0.0, i + 1
        want += [(k, r["id"], r["who"]) for r in x]
    check(spark, "i21_split_monologues", ["key", "id", "speaker"], want)


def test_boxes(spark, spans):
    apart, tracked = [], []
    for k, rows in spans.items():
        box = {r["id"]: (r["k"] * 9, r["start_ms"] % 500, 20 + int(r["value"]) % 60, 10 + r["k"] % 50) for r in rows}
        kept = []
        for i in sorted(box, key=lambda i: (-box[i][2] * box[i][3], i)):
            x, y, w, h = box[i]
            if not any(x < a + c and a < x + w and y < b + d and b < y + h for a, b, c, d in (box[j] for j in kept)):
                kept.append(i)
        apart += [(k, i) for i in kept]
        frames = defaultdict(list)
        for r in sorted(rows, key=lambda r: r["id"]):
            frames[r["start_ms"] // 3600000].append((r["id"], (r["k"] * 3, r["k"] % 20, 60, 60)))
        live, number = {}, 0
        for f in sorted(frames):
            left = dict(frames[f])
            for t in list(live):
                share = {}
                for i, b in left.items():
                    w, h = (max(0, min(live[t][0][c] + 60, b[c] + 60) - max(live[t][0][c], b[c])) for c in (0, 1))
                    share[i] = w * h / (7200 - w * h)
                best = max(left, key=lambda i: (share[i], -list(left).index(i)), default=None)
                if best is not None and share[best] > 0.3:
                    live[t] = (left.pop(best), f)
                    tracked.append((k, best, t))
            for i, b in left.items():
                live[number] = (b, f)
                tracked.append((k, i, number))
                number += 1
            live = {t: x for t, x in live.items() if f - x[1] <= 30}
    check(spark, "o10_boxes_apart", ["key", "id"], apart)
    check(spark, "j16_tracked_boxes", ["key", "id", "track"], tracked)


def test_sentence_chunks(spark):
    want = []
    for r in source(spark, SF, "documents").collect():
        chunks, begun = [], ""
        for s in re.compile(r"[.!?]+").split(r["text"] or ""):
            if len(begun + s) <= 2000:
                begun += s + ". "
            elif begun:
                chunks.append(begun.strip())
                begun = s
            else:
                chunks.append(s[:2000])
                begun = s[2000:]
        chunks += [begun.strip()] if begun else []
        want += [(r["doc_id"], n + 1, c) for n, c in enumerate(chunks)]
    check(spark, "i30_sentence_chunks", ["doc_id", "chunk", "content"], want)


def test_masks(spark):
    want = []
    for r in source(spark, SF, "documents").collect():
        text = r["text"]
        for pattern, group in lex.SECRETS:
            if text is not None:
                text = re.sub(pattern, lambda m, g=group: m[0].replace(m[g], lex.MASK), text)
        want.append((r["doc_id"], text, None if text is None else text != r["text"]))
    check(spark, "f6_masking", ["doc_id", "text", "changed"], want)


def test_selected_highlights(spark):
    got = by_key(catalog.queries()["i6_selected_highlights"](spark, SF), "conv_id", ["place"])
    payload = by_key(catalog.queries()["i2_merge_payload"](spark, SF), "conv_id", ["start_ms"])
    fit = by_key(text_queries._scored(spark, SF).where("end_ms - start_ms BETWEEN 3000 AND 30000"), "conv_id", ["start_ms"])
    assert set(got) == set(fit)
    for k, rows in got.items():
        assert [r["place"] for r in rows] == list(range(1, len(rows) + 1)) and len(rows) <= 8
        if len(fit[k]) == len(payload[k]) == len(rows) and len(rows) <= 8:
            assert {r["start_ms"] for r in rows} == {r["start_ms"] for r in payload[k]}


def test_subtitle_files(spark):
    lines = by_key(catalog.queries()["i13_subtitle_lines"](spark, SF), "conv_id", ["line"])
    stamp = lambda ms: f"{ms // 3600000:02d}:{ms // 60000 % 60:02d}:{ms // 1000 % 60:02d},{ms % 1000:03d}"
    ms = lambda x: math.floor(x * 1000 + 0.5)
    check(spark, "s8_subtitle_texts", ["conv_id", "content"], [(k, "".join(f"{r['line']}\n{stamp(ms(r['start']))} --> {stamp(ms(r['end']))}\n{r['text']}\n\n" for r in rows)) for k, rows in lines.items()])
    check(spark, "s7_parsed_subtitles", ["conv_id", "cue", "start_ms", "end_ms"], [(k, r["line"], ms(r["start"]), ms(r["end"])) for k, rows in lines.items() for r in rows])


def test_faulty_subtitles_are_told(spark):
    lines = by_key(catalog.queries()["i13_subtitle_lines"](spark, SF), "conv_id", ["line"])
    ms = lambda x: math.floor(x * 1000 + 0.5)
    want = []
    for k, rows in lines.items():
        ends = [max(0.0, r["start"] - 0.25 if r["line"] % 4 == 1 else r["end"] + 30 if r["line"] % 4 == 2 else r["end"]) for r in rows]
        for i, r in enumerate(rows):
            want += [(k, r["line"], "Invalid timing")] if ms(r["start"]) >= ms(ends[i]) else []
            want += [(k, r["line"], "Timing overlap")] if i + 1 < len(rows) and ms(ends[i]) > ms(rows[i + 1]["start"]) else []
    check(spark, "r17_subtitle_issues", ["conv_id", "cue", "issue"], want)
    assert len({w[2] for w in want}) == 2


def test_nearest_vectors_of_any_length(spark):
    from tidelane.operators import vectors

    rng = np.random.default_rng(6)
    known = [(i, rng.normal(size=n).tolist()) for i, n in enumerate([3, 3, 3, 2, 2, 5] * 5)] + [(90, None), (91, [1.0, None, 0.0]), (92, [float("nan"), 1.0]), (93, []), (94, [0.0, 0.0])]
    rows = [(i, rng.normal(size=n).tolist()) for i, n in enumerate([3, 2, 4, 5, 3] * 20)] + [(500, None), (501, [None, 1.0]), (502, [float("inf"), 1.0]), (503, []), (504, [0.0, 0.0]), (505, known[3][1])]
    f = "id int, v array<double>"
    got = {r.id: (r.name, round(r.score, 9)) for r in vectors.nearest(spark.createDataFrame(rows, f), spark.createDataFrame(known, f).withColumnRenamed("id", "name"), "id", "v", "name", 0.2).collect()}
    good = lambda v: bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    want = {}
    for i, v in rows:
        alike = [(-cos(v, w), n) for n, w in known if good(v) and good(w) and len(v) == len(w)]
        if alike and -min(alike)[0] > 0.2:
            want[i] = (min(alike)[1], round(-min(alike)[0], 9))
    assert got == want and len(want) > 50


def test_timed_events_feed_the_state_machines(spark, spans):
    assert timeline_queries._timed(spark, SF).count() == sum(map(len, spans.values()))


def test_legacy_segments_sort_words_alone(spark):
    """What a key has once - its samples and its last end - isn't carried and sorted with each of its words."""
    rows = [(k, i, "end." if i % 7 == 6 else f"w{i}", i * 1.0, i + 1.0) for k in (1, None) for i in range(20)]
    words = spark.createDataFrame(rows, "key int, pos int, word string, start double, end double")
    energy = F.array(F.lit(0.0), F.lit(0.5), F.coalesce("key", F.lit(0)).cast("double"))
    df = hl.legacy_segments(words, ["key"], energy)
    got = sorted(tuple(r) for r in df.select(F.coalesce("key", F.lit(0)), "start", "end", F.round("score", 6)).collect())
    assert got == [(0, 0.0, 7.0, 2.0), (0, 7.0, 14.0, 3.0), (1, 0.0, 7.0, 2.0), (1, 7.0, 14.0, 3.0)]
    plan = catalog.queries()["i11_legacy_segments"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    fold = plan[plan.index("MapInArrow") :]
    assert "Window" not in plan and "transform(" not in fold
