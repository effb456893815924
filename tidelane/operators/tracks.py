"""Folds over speakers, frames and clips that reset on their own output."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from math import floor, frexp

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelane.operators.fold import Row, ordered_fold
from tidelane.storage import discard, materialize


def merge_short(segments: DataFrame, key: list[str], least: float = 0.5, gap: float = 0.3) -> DataFrame:
    """A segment shorter than ``least`` so far takes in the next of its speaker that begins within ``gap``."""

    def step(rows: Iterator[Row]):
        now = None
        for r in rows:
            if now and now["end"] - now["start"] < least and now["speaker"] == r["speaker"] and r["start"] - now["end"] < gap:
                now = now | {"end": r["end"]}
                continue
            if now:
                yield now["speaker"], now["start"], now["end"]
            now = r
        if now:
            yield now["speaker"], now["start"], now["end"]

    return ordered_fold(segments.select(*key, "speaker", "start", "end"), key, ["start", "end"], step, "speaker string, start double, end double")


def smooth_speakers(segments: DataFrame, key: list[str], gap: float = 1.0, tie: str = "id") -> DataFrame:
    """A segment between two of one other speaker, close to both, takes that speaker; a change counts for the next test. Looks one row back and ahead."""

    def step(rows: Iterator[Row]):
        before = now = None
        for after in rows:
            if now is not None:
                if before is not None and before["speaker"] == after["speaker"] != now["speaker"] and now["start"] - before["end"] < gap and after["start"] - now["end"] < gap:
                    now = now | {"speaker": before["speaker"]}
                yield now[tie], now["speaker"]
                before = now
            now = after
        if now is not None:
            yield now[tie], now["speaker"]

    return ordered_fold(segments.select(*key, tie, "speaker", "start", "end"), key, ["start", tie], step, f"{tie} {dict(segments.dtypes)[tie]}, speaker string")


def smooth_crops(frames: DataFrame, key: list[str], columns: tuple[str, ...] = ("x", "y", "w", "h"), weight: float = 0.1, at: str = "frame") -> DataFrame:
    """Moving averages of whole numbers, truncated at each step."""

    def step(rows: Iterator[Row]):
        held = None
        for r in rows:
            held = [r[c] for c in columns] if held is None else [int(p * (1 - weight) + r[c] * weight) for p, c in zip(held, columns, strict=True)]
            yield r[at], *held

    return ordered_fold(frames.select(*key, at, *columns), key, [at], step, f"{at} {dict(frames.dtypes)[at]}, " + ", ".join(f"{c} long" for c in columns))


def iou(a, b, c, d, e, f, g, h):
    """Shared area over joint area of boxes (x, y, width, height), as an expression or of numbers."""
    if isinstance(a, (int, float)):
        both = max(0, min(a + c, e + g) - max(a, e)) * max(0, min(b + d, f + h) - max(b, f))
        union = c * d + g * h - both
        return both / union if union > 0 else 0.0
    zero = F.lit(0)
    both = F.greatest(zero, F.least(a + c, e + g) - F.greatest(a, e)) * F.greatest(zero, F.least(b + d, f + h) - F.greatest(b, f))
    return F.coalesce(F.try_divide(both, c * d + g * h - both), F.lit(0.0))


def track_boxes(boxes: DataFrame, key: list[str], least: float = 0.3, patience: int = 30, tie: str = "id") -> DataFrame:
    """Track numbers of boxes: each track, oldest first, takes a frame's box of greatest overlap above ``least``; others begin tracks, and tracks end after ``patience`` frames unseen."""

    def step(rows: Iterator[Row]):
        tracks: dict[int, tuple] = {}
        number, frame, held = 0, None, []

        def match():
            nonlocal number
            left = list(held)
            for t, (box, _) in list(tracks.items()):
                best = max(((iou(*box, r["x"], r["y"], r["w"], r["h"]), -i) for i, r in enumerate(left)), default=(0, 0))
                if best[0] > least:
                    r = left.pop(-best[1])
                    tracks[t] = ((r["x"], r["y"], r["w"], r["h"]), frame)
                    yield r[tie], t
            for r in left:
                tracks[number] = ((r["x"], r["y"], r["w"], r["h"]), frame)
                yield r[tie], number
                number += 1
            for t in [t for t, (_, seen) in tracks.items() if frame - seen > patience]:
                del tracks[t]

        for r in rows:
            if frame is not None and r["frame"] != frame:
                yield from match()
                held = []
            frame = r["frame"]
            held.append(r)
        if held:
            yield from match()

    return ordered_fold(boxes.select(*key, tie, "frame", "x", "y", "w", "h"), key, ["frame", tie], step, f"{tie} {dict(boxes.dtypes)[tie]}, track int")


class Boxes:
    """Boxes (x, y, w, h) in grids of cells, a grid for each power of two of their longer side, so that a box lies in four cells at most."""

    def __init__(self):
        self.grids: dict[int, dict[tuple[int, int], list[tuple]]] = {}
        self.all: dict[int, list[tuple]] = {}

    @staticmethod
    def _cells(size: float, x, y, w, h) -> tuple[int, int, int, int]:
        low_x, low_y = min(x, x + w), min(y, y + h)
        return floor(low_x / size), floor((low_x + abs(w)) / size), floor(low_y / size), floor((low_y + abs(h)) / size)

    def overlap(self, x, y, w, h) -> bool:
        hit = lambda b: x < b[0] + b[2] and x + w > b[0] and y < b[1] + b[3] and y + h > b[1]
        for level, grid in self.grids.items():
            a, b, c, d = self._cells(2.0**level, x, y, w, h)
            own = self.all[level]
            if (b - a + 1) * (d - c + 1) >= len(own):
                if any(map(hit, own)):
                    return True
            elif any(hit(box) for i in range(a, b + 1) for j in range(c, d + 1) for box in grid.get((i, j), ())):
                return True
        return False

    def add(self, x, y, w, h) -> None:
        level = max(-30, frexp(max(abs(w), abs(h)))[1])
        grid = self.grids.setdefault(level, {})
        self.all.setdefault(level, []).append((x, y, w, h))
        a, b, c, d = self._cells(2.0**level, x, y, w, h)
        for i in range(a, b + 1):
            for j in range(c, d + 1):
                grid.setdefault((i, j), []).append((x, y, w, h))


def boxes_apart(boxes: DataFrame, key: list[str], tie: str = "id") -> DataFrame:
    """Of boxes (x, y, w, h) of a key, largest first, those that overlap none kept before. State is what is kept, in grids. Boxes with a null take no part."""

    def step(rows: Iterator[Row]):
        kept = Boxes()
        for r in rows:
            box = (r["x"], r["y"], r["w"], r["h"])
            if not kept.overlap(*box):
                kept.add(*box)
                yield (r[tie],)

    rows = boxes.dropna(subset=["x", "y", "w", "h"]).select(*key, tie, "x", "y", "w", "h", (F.col("w") * F.col("h")).alias("_area"))
    return ordered_fold(rows, key, [F.col("_area").desc(), F.col(tie)], step, f"{tie} {dict(boxes.dtypes)[tie]}")


def bridge_gaps(clips: DataFrame, key: list[str], place: str, gap: int = 120000, tie: str = "id") -> DataFrame:
    """Clips in place with, across a longer gap, the clip not yet used that begins soonest after it and before the next, if it carries the story on.

    A bridge stands in its own place too, and bridges once. Holds one asset's clips, as any later one may be a bridge; those left are found by
    a search among their starts, where used ones point to the next.
    """

    def step(rows: Iterator[Row]):
        clips = list(rows)
        by_start = sorted(range(len(clips)), key=lambda n: (clips[n]["start_ms"], n))
        starts = [clips[n]["start_ms"] for n in by_start]
        rank = {n: r for r, n in enumerate(by_start)}
        left = list(range(len(clips) + 1))  # the next rank that isn't used

        def free(r: int) -> int:
            while left[r] != r:
                left[r] = left[left[r]]
                r = left[r]
            return r

        number = 0
        for i, now in enumerate(clips):
            left[rank[i]] = rank[i] + 1
            last = clips[i - 1]["end_ms"] if i else None
            if i and abs(now["start_ms"] - last) > gap:
                r = free(bisect_right(starts, last))
                if r < len(clips) and starts[r] < now["start_ms"] and (clips[by_start[r]]["role"] or "development") in ("development", "hook"):
                    left[r] = r + 1
                    number += 1
                    yield number, clips[by_start[r]][tie]
            number += 1
            yield number, now[tie]

    return ordered_fold(clips.select(*key, place, tie, "start_ms", "end_ms", "role"), key, [place], step, f"place int, {tie} {dict(clips.dtypes)[tie]}")


def two_speakers(segments: DataFrame, key: list[str], features: list[str], tie: str = "id", rounds: int = 5) -> DataFrame:
    """Two clusters of standardised features, seeded by the rows of greatest and least first feature (of ties the first by ``tie``). A row alone is the first speaker.

    Means, deviations and each round's centres are aggregates by key, joined back; no task holds a key's rows.
    """
    of = lambda f: F.col(f).cast("double")
    first = F.struct(of(features[0]).alias("v"), F.col(tie))
    stats = segments.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"), *[x for i, f in enumerate(features) for x in (F.avg(of(f)).alias(f"_m{i}"), F.stddev_pop(of(f)).alias(f"_s{i}"))], F.max_by(F.struct(*[of(f).alias(f"x{i}") for i, f in enumerate(features)]), F.struct(first["v"], -F.col(tie))).alias("_top"), F.min_by(F.struct(*[of(f).alias(f"x{i}") for i, f in enumerate(features)]), first).alias("_low"))
    scaled = lambda i, x: (x - F.col(f"_m{i}")) / (F.col(f"_s{i}") + 1e-8)
    n = len(features)
    z = materialize(segments.select(*key, tie, *features).join(stats, key).select(*key, tie, "_rows", *[scaled(i, of(f)).alias(f"_z{i}") for i, f in enumerate(features)]), "speakers-scaled")
    centres = materialize(stats.select(*key, *[scaled(i, F.col(f"{end}.x{i}")).alias(f"{side}{i}") for side, end in (("_a", "_top"), ("_b", "_low")) for i in range(n)]), "speakers-centres")
    far = lambda side: sum(((F.col(f"_z{i}") - F.col(f"{side}{i}")) * (F.col(f"_z{i}") - F.col(f"{side}{i}")) for i in range(n)), F.lit(0.0))
    for k in range(rounds):
        sided = z.join(centres, key).withColumn("_side", F.when(far("_a") <= far("_b"), 0).otherwise(1))
        if k < rounds - 1:
            mean = [F.coalesce(F.avg(F.when(F.col("_side") == number, F.col(f"_z{i}"))), F.max(f"{side}{i}")).alias(f"{side}{i}") for number, side in enumerate(("_a", "_b")) for i in range(n)]
            fresh = materialize(sided.groupBy(*key).agg(*mean), "speakers-centres")
        centres, old = (fresh, centres) if k < rounds - 1 else (centres, None)
        if old is not None:
            discard(old)
    out = materialize(sided.select(*key, tie, F.when((F.col("_rows") < 2) | (F.col("_side") == 0), "SPEAKER_00").otherwise("SPEAKER_01").alias("speaker")), "speakers")
    discard(z, centres)
    return out


def split_monologues(segments: DataFrame, key: list[str], seconds: float = 20.0, pause: float = 1.5, change: float = 0.3, tie: str = "id") -> DataFrame:
    """The other of two speakers where one has spoken for long: after more than ``seconds`` in more than three segments of one speaker, a pause of
    more than ``pause`` seconds and a change of energy by more than that share, the next segment is the other speaker's. Looks one row ahead."""

    def step(rows: Iterator[Row]):
        speaker, spoken, since, given = None, 0.0, 0, None
        for i, (now, after) in enumerate(_with_next(rows)):
            who, given = given or now["speaker"], None
            length = now["end"] - now["start"]
            speaker, spoken, since = (speaker, spoken + length, since) if who == speaker else (who, length, i)
            yield now[tie], who
            quiet = after is not None and after["start"] - now["end"] > pause
            if spoken > seconds and i - since > 2 and quiet and abs(now["energy"] - after["energy"]) / (now["energy"] + 1e-8) > change:
                speaker = given = "SPEAKER_01" if speaker == "SPEAKER_00" else "SPEAKER_00"
                spoken, since = 0.0, i + 1

    return ordered_fold(segments.select(*key, tie, "speaker", "start", "end", "energy"), key, ["start", tie], step, f"{tie} {dict(segments.dtypes)[tie]}, speaker string")


def _with_next(rows: Iterator[Row]):
    now = next(rows, None)
    while now is not None:
        after = next(rows, None)
        yield now, after
        now = after


def pack_sentences(docs: DataFrame, key: list[str], text: str, max_tokens: int = 7000) -> DataFrame:
    """Chunks of sentences of up to four characters a token: a sentence joins the chunk while the chunk so far and it fit, its full stop not counted.

    A sentence alone that doesn't fit is cut once, and its rest begins the next chunk. A text is a row, so this is a map: nothing is shuffled.
    """
    limit = 4 * max_tokens
    schema = T.StructType([docs.schema[k] for k in key] + [T.StructField("chunk", T.IntegerType()), T.StructField("content", T.StringType())])

    def run(batches):
        for batch in batches:
            rows, numbers, texts = [], [], []
            for i, t in enumerate(batch.column(len(key)).to_pylist()):
                for n, chunk in enumerate(_chunks(t or "", limit)):
                    rows.append(i)
                    numbers.append(n + 1)
                    texts.append(chunk)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(key))), pa.array(numbers, pa.int32()), pa.array(texts, pa.string())], names=schema.names)

    return docs.select(*key, text).mapInArrow(run, schema)


def _chunks(text: str, limit: int) -> Iterator[str]:
    begun = ""
    for sentence in re.split(r"[.!?]+", text):
        if len(begun) + len(sentence) > limit:
            whole = bool(begun)
            yield begun.strip() if whole else sentence[:limit]
            begun = sentence if whole else sentence[limit:]
        else:
            begun = f"{begun}{sentence}. "
    if begun:
        yield begun.strip()


def once_each(words: DataFrame, key: list[str], tie: str = "pos") -> DataFrame:
    """Each distinct word once, with its surest occurrence (of ties the first), by start."""
    best = words.groupBy(*key, "word").agg(F.max_by(F.struct("start", "end", "confidence", tie), F.struct("confidence", (-F.col(tie)).alias("o"))).alias("b"))
    return best.select(*key, "word", "b.start", "b.end", "b.confidence")
