"""Orders of a story's parts that respect what each depends on."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame

from tidelane.operators.fold import Row, ordered_fold

# The ideal sequence of beats.
BEATS = ("hook", "setup", "context", "rising_action", "climax", "falling_action", "resolution", "call_to_action")


def orders(before: list[set[int]]) -> Iterator[list[int]]:
    """All orders of 0 .. n-1 in which each comes after all of ``before`` of it, smallest first as sequences; none if there is a cycle.

    An order and what is free behind each place are kept, and the next order is found by taking parts back from the end until a greater one could stand there: no
    recursion, and usually a few steps for each order.
    """
    n = len(before)
    after: list[list[int]] = [[] for _ in range(n)]
    waits = [0] * n
    for i, own in enumerate(before):
        for j in own:
            if 0 <= j < n:
                after[j].append(i)
                waits[i] += 1
    free = [i for i in range(n) if not waits[i]]  # ascending
    order: list[int] = []

    def place(at: int) -> None:
        i = free.pop(at)
        order.append(i)
        for j in after[i]:
            waits[j] -= 1
            if not waits[j]:
                insort(free, j)

    while True:
        while free:
            place(0)
        if len(order) < n:  # a cycle holds the rest
            return
        yield list(order)
        while order:
            i = order.pop()
            for j in after[i]:
                if not waits[j]:
                    del free[bisect_left(free, j)]
                waits[j] += 1
            greater = bisect_right(free, i)
            insort(free, i)
            if greater < len(free) - 1:
                place(greater + 1)
                break
        else:
            return


def _scores(order: np.ndarray, beat: np.ndarray, emotion: np.ndarray, tension: np.ndarray) -> float:
    """Ten for each pair of neighbouring beats that begin in sequence, less twice each change of emotion, less half the distance of the tensest part from 0.7 of the way."""
    kinds, first = np.unique(beat[order], return_index=True)
    at = dict(zip(kinds.tolist(), first.tolist(), strict=True))
    begun = 10.0 * sum(b in at and b + 1 in at and at[b] < at[b + 1] for b in range(len(BEATS) - 1))
    felt = emotion[order]
    total = float(np.cumsum(np.append(begun, -2.0 * np.abs(felt[1:] - felt[:-1])))[-1])
    return total - 0.5 * abs(int(tension[order].argmax()) - 0.7 * len(order))


def by_beats(beat: np.ndarray) -> list[int]:
    """Parts by their beat's place in the ideal sequence, other beats last, as they stand within each."""
    return np.argsort(beat, kind="stable").tolist()


def story_order(df: DataFrame, key: list[str], order: list[str], tie: str = "id", tries: int = 100) -> DataFrame:
    """(key, place from 1, ``tie``): each key's rows (beat, emotion, tension, deps: places from 0 by ``order``) in the best of the first ``tries`` orders that respect deps.

    The first orders are the smallest as sequences of places; of equally good ones the first is taken. If deps go in a circle - a part that depends on itself included - parts are ordered by
    beats instead. Deps that are null or no place of the key are none; a null emotion or tension is 0. A key's rows are one task's, as orders concern all of them.
    """
    number = {b: i for i, b in enumerate(BEATS)}

    def step(rows: Iterator[Row]):
        held = list(rows)
        beat = np.array([number.get(r["beat"], len(BEATS)) for r in held])
        emotion, tension = (np.array([r[c] or 0.0 for r in held], float) for c in ("emotion", "tension"))
        best = None
        for found in islice(orders([{d for d in r["deps"] or () if d is not None} for r in held]), tries):
            at = np.array(found)
            score = _scores(at, beat, emotion, tension)
            if best is None or score > best[0]:
                best = (score, found)
        chosen = best[1] if best else by_beats(beat)
        yield from ((i + 1, held[j][tie]) for i, j in enumerate(chosen))

    rows = df.select(*key, tie, "beat", "emotion", "tension", "deps", *[o for o in order if o != tie])
    return ordered_fold(rows, key, order, step, f"place int, {tie} {dict(df.dtypes)[tie]}")
