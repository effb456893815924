"""Orderings, top-k and budgeted or greedy selections."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import cache
from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.functions import lexicons as lex
from tidelane.operators.fold import Row, ordered_fold


def top_per_key(df: DataFrame, key: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key; Spark prunes each task to k rows a key before the shuffle."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def take_then_time(df: DataFrame, key: list[str], score: str, at: str, tie: str, k: int) -> DataFrame:
    """The ``k`` best by score with their place: by time if a key has more than ``k`` rows, else as they stand (by ``tie``)."""
    w = Window.partitionBy(*key)
    ranked = df.withColumns({"_r": F.row_number().over(w.orderBy(F.col(score).desc(), F.col(tie))), "_n": F.count(F.lit(1)).over(w)}).where(F.col("_r") <= k)
    place = F.row_number().over(w.orderBy(F.when(F.col("_n") > k, F.col(at)), F.col(tie)))
    return ranked.withColumn("place", place).drop("_r", "_n")


#: Named orders: of a key and column names by role, (column, whether descending) in turn. Columns may be windows over the key.
STRATEGIES: dict[str, Callable[[list[str], dict[str, str]], list[tuple[Column, bool]]]] = {}


def strategy(name: str):
    """Registers an order under a name for :func:`strategy_order`; a later one of the name replaces it."""

    def add(f):
        STRATEGIES[name] = f
        return f

    return add


@strategy("quality_first")
def _by_score(key, c):
    return [(F.col(c["score"]), True), (F.col(c["tie"]), False)]


@strategy("timeline_first")
def _by_time(key, c):
    return [(F.col(c["start"]), False), (F.col(c["tie"]), False)]


@strategy("narrative_flow")
def _by_beat(key, c):
    at = F.array_position(F.array(*map(F.lit, lex.STRATEGY_ORDER)), F.coalesce(F.col(c["beat"]), F.lit("other")))
    return [(F.when(at == 0, len(lex.STRATEGY_ORDER) + 1).otherwise(at), False), (F.col(c["start"]), False), *_by_score(key, c)]


@strategy("balanced")
def _balanced(key, c):
    last = F.max(c["end"]).over(Window.partitionBy(*key))
    return [(F.col(c["score"]) * 0.8 + (1.0 - F.col(c["start"]) / last * 0.2) * 0.2, True), (F.col(c["tie"]), False)]


def strategy_order(df: DataFrame, key: list[str], strategy: str, score: str = "score", start: str = "start_ms", end: str = "end_ms", beat: str = "beat_type", tie: str = "id") -> DataFrame:
    """Adds place by a named strategy of STRATEGIES; unknown names are balanced."""
    order = STRATEGIES.get(strategy, _balanced)(key, {"score": score, "start": start, "end": end, "beat": beat, "tie": tie})
    names = [f"_by{i}" for i in range(len(order))]
    held = df.withColumns({n: x for n, (x, _) in zip(names, order, strict=True)})
    by = [F.col(n).desc() if down else F.col(n) for n, (_, down) in zip(names, order, strict=True)]
    return held.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*by))).drop(*names)


def balanced_beats(df: DataFrame, key: list[str], beat: str = "beat_type", confidence: str = "confidence", start: str = "start_ms", tie: str = "id", most: int = 6) -> DataFrame:
    """Keys of more than ``most`` beats keep the two surest of each type, then the first ``most`` by time."""
    w = Window.partitionBy(*key)
    numbered = df.withColumns({"_n": F.count(F.lit(1)).over(w), "_r": F.row_number().over(Window.partitionBy(*key, beat).orderBy(F.col(confidence).desc(), start, tie))})
    few = numbered.where((F.col("_n") <= most) | (F.col("_r") <= 2))
    return few.withColumn("_p", F.row_number().over(w.orderBy(start, tie))).where((F.col("_n") <= most) | (F.col("_p") <= most)).drop("_n", "_r", "_p")


def diversified(df: DataFrame, key: list[str], group: str, score: str, start: str, tie: str, k: int) -> DataFrame:
    """Best of each group first, then the best of the rest, to ``k`` rows; place is by time."""
    w = Window.partitionBy(*key)
    ranked = df.withColumn("_g", F.row_number().over(Window.partitionBy(*key, group).orderBy(F.col(score).desc(), tie)) > 1)
    chosen = ranked.withColumn("_r", F.row_number().over(w.orderBy("_g", F.col(score).desc(), tie))).where(F.col("_r") <= k)
    return chosen.withColumn("place", F.row_number().over(w.orderBy(start, tie))).drop("_g", "_r")


def duration_budget(df: DataFrame, key: list[str], score: str, tie: str, target: float, clip: float = 3.0, most: int = 10) -> DataFrame:
    """Clips of one length, best first, as many as fit the target."""
    return top_per_key(df, key, [F.col(score).desc(), F.col(tie)], min(int(target // clip), most))


class Taken:
    """Intervals, none of which overlap, sorted: whether another one overlaps any is a search. Ones that end before they begin are looked through."""

    def __init__(self):
        self.starts: list = []
        self.ends: list = []
        self.odd: list[tuple] = []

    def overlap(self, start, end) -> bool:
        if start > end:
            return any(start < e and end > s for s, e in zip(self.starts, self.ends, strict=True)) or any(start < e and end > s for s, e in self.odd)
        at = bisect_left(self.starts, end) - 1  # what begins before the end; of these, the last ends last
        return at >= 0 and self.ends[at] > start or any(start < e and end > s for s, e in self.odd)

    def add(self, start, end) -> None:
        if start > end:
            self.odd.append((start, end))
        else:  # sorted by start are sorted by end, as none overlap
            insort(self.starts, start)
            insort(self.ends, end)


def greedy_apart(df: DataFrame, key: list[str], score: str, start: str, end: str, tie: str, seconds: float | None = None, most: int | None = None) -> DataFrame:
    """Best first, what overlaps nothing chosen before, while a total length and a number last. Rows without bounds take no part. State is what is chosen, sorted."""

    def step(rows: Iterator[Row]):
        taken, total, number = Taken(), 0.0, 0
        for r in rows:
            if taken.overlap(r[start], r[end]) or seconds is not None and total + (r[end] - r[start]) > seconds:
                continue
            taken.add(r[start], r[end])
            total += r[end] - r[start]
            number += 1
            yield r[tie], r[start], r[end], r[score]
            if most is not None and number >= most:
                return

    kind = dict(df.dtypes)
    rows = df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(*key, tie, start, end, score)
    return ordered_fold(rows, key, [F.col(score).desc(), F.col(tie)], step, f"{tie} {kind[tie]}, {start} {kind[start]}, {end} {kind[end]}, {score} {kind[score]}")


def greedy_gap(df: DataFrame, key: list[str], score: str, start: str, tie: str, gap: float, most: int) -> DataFrame:
    """Best first, what begins at least ``gap`` from all chosen before; of these only the neighbours by start are looked at. Rows without a start take no part."""

    def step(rows: Iterator[Row]):
        chosen: list = []
        for r in rows:
            at = bisect_left(chosen, r[start])
            if all(abs(r[start] - x) >= gap for x in chosen[max(0, at - 1) : at + 1]):
                chosen.insert(at, r[start])
                yield r[tie], r[start], r[score]
                if len(chosen) >= most:
                    return

    kind = dict(df.dtypes)
    rows = df.where(F.col(start).isNotNull()).select(*key, tie, start, score)
    return ordered_fold(rows, key, [F.col(score).desc(), F.col(tie)], step, f"{tie} {kind[tie]}, {start} {kind[start]}, {score} {kind[score]}")


def plan_json(df: DataFrame, key: list[str], score: str = "score", start: str = "start", end: str = "end", tie: str = "id", k: int = 5) -> DataFrame:
    """An edit plan of the best ``k`` segments: times in seconds become milliseconds, scores have three decimals."""
    best = top_per_key(df, key, [F.coalesce(F.col(score), F.lit(0.0)).desc(), F.col(tie)], k)
    action = F.struct((-F.coalesce(F.col(score), F.lit(0.0))).alias("_o"), F.col(tie).alias("_t"), F.lit("cut").alias("type"), (F.col(start) * 1000).cast("int").alias("start_ms"), (F.col(end) * 1000).cast("int").alias("end_ms"), F.bround(F.coalesce(F.col(score), F.lit(0.0)), 3).alias("score"))
    actions = F.transform(F.sort_array(F.collect_list(action)), lambda a: F.struct(a["type"].alias("type"), a["start_ms"].alias("start_ms"), a["end_ms"].alias("end_ms"), a["score"].alias("score")))
    return best.groupBy(*key).agg(F.to_json(F.struct(F.lit("1.0").alias("version"), actions.alias("actions"))).alias("plan"))


def interleave(df: DataFrame, key: list[str], tie: str = "id") -> DataFrame:
    """Beats in story order with up to two of the other rows that begin between one's end and the next, and up to two after the last. Without beats, by time.

    A gap's others are found by number: a running count tells how many begin before it, and the next two are joined.
    """
    order = F.array_position(F.array(*map(F.lit, lex.BEAT_ORDER)), F.coalesce("beat_type", F.lit("")))
    w = Window.partitionBy(*key)
    rows = df.withColumn("_t", F.row_number().over(w.orderBy("start_ms", tie)))
    beats = rows.where("is_beat").withColumn("_b", F.row_number().over(w.orderBy(F.when(order == 0, len(lex.BEAT_ORDER) + 1).otherwise(order), "_t")))
    others = rows.where("NOT is_beat").select(*key, F.col(tie).alias("_id"), F.col("start_ms").alias("_at"), "_t", F.row_number().over(w.orderBy("_t")).alias("_k"))
    none = F.lit(None).cast("long")
    gaps = beats.select(*key, "_b", F.coalesce(F.lag("end_ms").over(w.orderBy("_b")), F.lit(0)).cast("long").alias("_from"), F.col("start_ms").cast("long").alias("_to"))
    ends = beats.groupBy(*key).agg((F.max("_b") + 1).alias("_b"), F.max_by("end_ms", "_b").cast("long").alias("_from")).select(*key, "_b", "_from", none.alias("_to"))
    asked = gaps.where("_from < _to").unionByName(ends)
    line = asked.select("*", F.lit(0).alias("_other")).unionByName(others.select(*key, F.lit(None).cast("int").alias("_b"), F.col("_at").cast("long").alias("_from"), none.alias("_to"), F.lit(1).alias("_other")))
    counted = line.withColumn("_k", F.sum("_other").over(w.orderBy("_from", "_other").rowsBetween(Window.unboundedPreceding, 0))).where("_other = 0")
    pairs = counted.select(*key, "_b", "_to", F.explode(F.array(F.col("_k") + 1, F.col("_k") + 2)).alias("_k")).join(others, [*key, "_k"]).where("_to IS NULL OR _at < _to")
    made = beats.select(*key, F.col("_b").alias("_p"), F.lit(1).alias("_q"), "_t", F.col(tie))
    made = made.unionByName(pairs.select(*key, F.col("_b").alias("_p"), F.lit(0).alias("_q"), "_t", F.col("_id").alias(tie)))
    alone = others.join(ends, key, "left_anti")
    made = made.unionByName(alone.select(*key, F.lit(0).alias("_p"), F.lit(0).alias("_q"), "_t", F.col("_id").alias(tie)))
    return made.select(*key, F.row_number().over(w.orderBy("_p", "_q", "_t")).alias("place"), tie)


@cache
def _permutations(n: int) -> np.ndarray:
    """All orders of n rows, a row each, smallest first: at most 40,320 of eight."""
    return np.array(list(permutations(range(n))), np.int8)


def _best_permutation(values: np.ndarray, target: list[float]) -> list[int]:
    """The first order whose values, resampled to as many points as ``target`` has, are at the least squared distance from it."""
    orders = _permutations(len(values))
    held, far = values[orders], np.zeros(len(orders))
    for i, t in enumerate(target):
        x = i / (len(target) - 1) * (len(values) - 1)
        j = min(int(x), len(values) - 2)
        point = held[:, j] + (x - j) * (held[:, j + 1] - held[:, j]) if len(values) > 1 else held[:, 0]
        far += (point - t) ** 2
    return orders[far.argmin()].tolist()


def match_arc(df: DataFrame, key: list[str], value: str, order: list[str], tie: str = "id", arc: str = "cinderella", exhaustive: int = 8) -> DataFrame:
    """Places rows along a target arc: the permutation of least squared distance for few rows, else the closest row for each point in turn and then the rest.

    Of many rows, a point takes one of its nearest as many as there are points, so just these reach the fold.
    """
    target = lex.ARCS.get(arc, lex.ARCS["cinderella"])
    w = Window.partitionBy(*key)
    rows = df.withColumns({"_n": F.count(F.lit(1)).over(w), "_o": F.row_number().over(w.orderBy(*order))}).select(*key, tie, F.col(value).cast("double").alias("_v"), "_n", "_o")
    few = rows.where(F.col("_n") <= exhaustive)
    point = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(t)).alias("t")) for i, t in enumerate(target)]))
    near = rows.where(F.col("_n") > exhaustive).select("*", point.alias("_p")).select("*", "_p.i", F.abs(F.col("_v") - F.col("_p.t")).alias("_d"))
    near = top_per_key(near, [*key, "i"], [F.col("_d"), F.col("_o")], len(target))

    def best(own: Iterator[Row]):
        own = list(own)  # as many as ``exhaustive``
        places = _best_permutation(np.array([r["_v"] for r in own], float), target)
        yield from ((n + 1, own[i][tie]) for n, i in enumerate(places))

    def in_turn(own: Iterator[Row]):
        used, at = set(), 0
        for r in own:  # by point, nearest first
            if r["i"] == at and r["_o"] not in used:
                used.add(r["_o"])
                at += 1
                yield r["i"] + 1, r["_o"]

    schema = f"place int, {tie} {dict(df.dtypes)[tie]}"
    placed = ordered_fold(few.select(*key, tie, "_v", "_o"), key, ["_o"], best, schema)
    chosen = ordered_fold(near.select(*key, "i", "_d", "_o"), key, ["i", "_d", "_o"], in_turn, "_place int, _o int")
    many = rows.where(F.col("_n") > exhaustive).join(chosen, [*key, "_o"], "left")
    many = many.select(*key, F.row_number().over(w.orderBy(F.col("_place").asc_nulls_last(), "_o")).alias("place"), tie)
    return placed.unionByName(many)
