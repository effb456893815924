"""State machines over streams: held alerts, circuit breakers and budgets by key, in order of event time.

Rows wait in a key's state until the watermark has passed them, and are then taken in order of time; so what a stream says doesn't depend on how its rows came in
micro-batches, and equals the batch form. Event-time timers wake a key for its next waiting row, for an alert that is due though no row comes, and
to forget a key that has been silent. Queries need the RocksDB state store (:data:`STATE_STORE`).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidelane.operators.stateful import Breaker, Budget

#: The setting that streams with timers need.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Held:
    """An alert fires when its condition has held for ``seconds``; state: since when it holds, and whether it has fired."""

    state, out = "since double, fired boolean", "since double, fired_at double"
    first = (None, False)

    def __init__(self, seconds: float):
        self.seconds = seconds

    def due(self, state):
        since, fired = state
        return since + self.seconds if since is not None and not fired else None

    def fire(self, state):
        return (state[0], True), [(state[0], state[0] + self.seconds)]

    def step(self, state, at, row, value):
        holds = bool(value)
        return (((at, False) if state[0] is None else state) if holds else self.first), []


class Calls:
    """A machine of :mod:`tidelane.operators.stateful` whose every row has an outcome."""

    def __init__(self, machine, state: str, out: str):
        self.machine, self.state, self.out, self.first = machine, state, out, machine.first

    def due(self, state):
        return None

    def step(self, state, at, row, value):
        state, told = self.machine.step(state, at, value)
        return state, [(row, *told)]


class _InOrder(StatefulProcessor):
    def __init__(self, machine, columns: list[str], keep: float | None):
        self.machine, self.columns, self.keep = machine, columns, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, row long, value double")
        self.held = handle.getValueState("held", f"{self.machine.state}, _last double")
        self.alarm = handle.getValueState("alarm", "ms long")

    def _wake(self, rows: list[tuple], state, last: float | None, passed: int = 0) -> None:
        """One timer, in ms: for the first waiting row, what is due, or the end of silence, unless that has ``passed`` while rows wait: the next of them deals with it."""
        times = [us // 1000 + 1 for us, *_ in rows[:1]]
        due = self.machine.due(state)
        times += [int(-(-due * 1e6 // 1000)) + 1] if due is not None else []
        times += [int((last + self.keep) * 1000) + 1] if self.keep is not None and last is not None else []
        old = self.alarm.get()[0] if self.alarm.exists() else None
        now = min((t for t in times if t > passed), default=None)
        if now != old:
            if old is not None:
                self.handle.deleteTimer(old)
            if now is None:
                self.alarm.clear()
            else:
                self.handle.registerTimer(now)
                self.alarm.update((now,))

    def _state(self):
        if not self.held.exists():
            return self.machine.first, None
        *state, last = self.held.get()
        return tuple(state), last

    def handleInputRows(self, key, rows, timerValues):
        new = [x for frame in rows for x in zip(frame["us"].tolist(), frame["row"].tolist(), frame["value"].astype(float).tolist(), strict=True)]
        self.waiting.appendList(new)
        state, last = self._state()
        self._wake(sorted(map(tuple, self.waiting.get())), state, last)
        yield pd.DataFrame([], columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(map(tuple, self.waiting.get()))
        ready, rest = [r for r in rows if r[0] <= passed], [r for r in rows if r[0] > passed]
        self.alarm.clear()  # the timer that has come is gone
        state, last = self._state()
        out = []

        def until(seconds: float) -> None:
            nonlocal state
            due = self.machine.due(state)
            if due is not None and due <= seconds:
                state, made = self.machine.fire(state)
                out.extend(made)

        for us, row, value in ready:
            at = us / 1e6
            until(at)
            if self.keep is not None and last is not None and at - last >= self.keep:
                state = self.machine.first
            state, made = self.machine.step(state, at, row, value)
            out.extend(made)
            last = at
        until(passed / 1e6)
        if ready:
            self.waiting.put(rest) if rest else self.waiting.clear()
        if not rest and self.keep is not None and last is not None and passed / 1e6 - last >= self.keep:
            self.held.clear()
            state, last = self.machine.first, None
        else:
            self.held.update((*state, last))
        self._wake(rest, state, last, passed // 1000)
        yield pd.DataFrame([(*key, *x) for x in out], columns=self.columns)

    def close(self) -> None:
        pass


def _run(events: DataFrame, machine, key: str, tie: str, value, lateness: str, keep: float | None) -> DataFrame:
    kind = dict(events.dtypes)[key]
    rows = events.withWatermark("ts", lateness).select(key, "ts", F.unix_micros("ts").alias("us"), F.col(tie).cast("long").alias("row"), value.cast("double").alias("value"))
    shape = f"{key} {kind}, {machine.out}"
    columns = [x.split()[0] for x in shape.split(", ")]
    return rows.groupBy(key).transformWithStateInPandas(_InOrder(machine, columns, keep), shape, "Append", "EventTime")


def held_alerts(events: DataFrame, condition, seconds: float, key: str = "user_id", tie: str = "event_id", lateness: str = "10 minutes", keep: float | None = None) -> DataFrame:
    """(key, since, fired_at in seconds) of each spell in which the key's ``condition`` held for ``seconds``: from the row at which it began, until a row that says otherwise.

    An alert fires once the watermark has passed its time, though no row of its key comes. ``keep``: a key that is silent for so many seconds is forgotten, and with it a spell.
    """
    return _run(events, Held(seconds), key, tie, F.coalesce(condition, F.lit(False)).cast("int"), lateness, keep)


def circuit_breaker(events: DataFrame, success, key: str = "user_id", tie: str = "event_id", failures: int = 5, recovery: float = 30.0, successes: int = 3, lateness: str = "10 minutes", keep: float | None = None) -> DataFrame:
    """(key, row, executed, state): see :func:`tidelane.operators.stateful.circuit_breaker`; a key that is silent for ``keep`` seconds begins anew."""
    machine = Calls(Breaker(failures, recovery, successes), "state string, failed long, good long, last double", "row long, executed boolean, state string")
    return _run(events, machine, key, tie, F.coalesce(success, F.lit(False)).cast("int"), lateness, keep)


def budget_guard(events: DataFrame, cost, cap: float = 5.0, overshoot: bool = False, key: str = "user_id", tie: str = "event_id", lateness: str = "10 minutes", keep: float | None = None) -> DataFrame:
    """(key, row, allowed, total): see :func:`tidelane.operators.stateful.budget_guard`; a key that is silent for ``keep`` seconds has its budget back."""
    return _run(events, Calls(Budget(cap, overshoot), "total double", "row long, allowed boolean, total double"), key, tie, cost, lateness, keep)
