"""State machines over ordered events of a key, as batch folds. Times are seconds."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelane.operators.fold import Row, ordered_fold


def token_bucket(df: DataFrame, key: list[str], at: str, amount: str, capacity: float, refill: float, burst: float = 0.0, tie: str = "id") -> DataFrame:
    """Whether each request gets its tokens, and what is left. A bucket starts with ``capacity`` at its first event."""

    def step(rows: Iterator[Row]):
        tokens, last = float(capacity), None
        for r in rows:
            if last is not None:
                tokens = min(capacity + burst, tokens + (r[at] - last) * refill)
            last = r[at]
            ok = tokens >= r[amount]
            tokens -= r[amount] if ok else 0
            yield r[tie], ok, float(tokens)

    return ordered_fold(df.select(*key, tie, at, amount), key, [at, tie], step, f"{tie} {dict(df.dtypes)[tie]}, allowed boolean, tokens double")


class Breaker:
    """A circuit breaker's steps. State: its name, failures in a row, successes while half open, the last failure's time."""

    first = ("CLOSED", 0, 0, 0.0)

    def __init__(self, failures: int, recovery: float, successes: int):
        self.failures, self.recovery, self.successes = failures, recovery, successes

    def step(self, held: tuple, at: float, success) -> tuple[tuple, tuple]:
        """The state after an event, and (executed, name). An event that is turned away changes nothing."""
        state, failed, good, last = held
        if state == "OPEN" and at - last >= self.recovery:
            state, good = "HALF_OPEN", 0
        executed = state != "OPEN"
        if executed and success:
            failed = 0
            if state == "HALF_OPEN":
                good += 1
                state = "CLOSED" if good >= self.successes else state
        elif executed:
            failed, last = failed + 1, at
            state = "OPEN" if failed >= self.failures else state
        return (state, failed, good, last), (executed, state)


def circuit_breaker(df: DataFrame, key: list[str], at: str, success: str, failures: int = 5, recovery: float = 30.0, successes: int = 3, tie: str = "id") -> DataFrame:
    """State after each event, and whether it was let through. An event that is turned away changes nothing."""
    machine = Breaker(failures, recovery, successes)

    def step(rows: Iterator[Row]):
        held = machine.first
        for r in rows:
            held, told = machine.step(held, r[at], r[success])
            yield r[tie], *told

    return ordered_fold(df.select(*key, tie, at, success), key, [at, tie], step, f"{tie} {dict(df.dtypes)[tie]}, executed boolean, state string")


def cooldown(df: DataFrame, key: list[str], at: str, seconds: float, tie: str = "id") -> DataFrame:
    """Events that are at least ``seconds`` after the last one let through."""

    def step(rows: Iterator[Row]):
        last = None
        for r in rows:
            if last is None or r[at] - last >= seconds:
                last = r[at]
                yield r[tie], r[at]

    kind = dict(df.dtypes)
    return ordered_fold(df.select(*key, tie, at), key, [at, tie], step, f"{tie} {kind[tie]}, {at} {kind[at]}")


class Budget:
    """A budget's steps. State: what has been spent."""

    first = (0.0,)

    def __init__(self, cap: float, overshoot: bool):
        self.cap, self.overshoot = cap, overshoot

    def step(self, held: tuple, at: float, cost: float) -> tuple[tuple, tuple]:
        """The state after a call, and (allowed, total)."""
        (total,) = held
        ok = total < self.cap if self.overshoot else total + cost <= self.cap
        total += cost if ok else 0
        return (total,), (ok, float(total))


def budget_guard(df: DataFrame, key: list[str], at: str, cost: str, cap: float = 5.0, overshoot: bool = False, tie: str = "id") -> DataFrame:
    """Whether each call is paid for: if it keeps the total within the cap, or, with ``overshoot``, if the total was below it before. What is refused isn't counted."""
    machine = Budget(cap, overshoot)

    def step(rows: Iterator[Row]):
        held = machine.first
        for r in rows:
            held, told = machine.step(held, r[at], r[cost])
            yield r[tie], *told

    return ordered_fold(df.select(*key, tie, at, cost), key, [at, tie], step, f"{tie} {dict(df.dtypes)[tie]}, allowed boolean, total double")


def adaptive_interval(df: DataFrame, key: list[str], at: str, success: str, factor: float = 1.5, least: float = 0.1, most: float = 5.0, tie: str = "id") -> DataFrame:
    """The pause after each event: shorter by the factor on success, longer on failure, within bounds."""

    def step(rows: Iterator[Row]):
        now = least
        for r in rows:
            now = max(least, now / factor) if r[success] else min(most, now * factor)
            yield r[tie], float(now)

    return ordered_fold(df.select(*key, tie, at, success), key, [at, tie], step, f"{tie} {dict(df.dtypes)[tie]}, interval double")


def queue_order(df: DataFrame, key: list[str], priority: str, at: str, now: float, timeout: float = 300.0, tie: str = "id") -> DataFrame:
    """Requests that haven't timed out, in the order in which they are served."""
    fresh = df.where(F.lit(now) - F.col(at) <= timeout)
    return fresh.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(priority, at, tie)))


def counter_rate(df: DataFrame, key: list[str], at: str, value: str, seconds: int) -> DataFrame:
    """Increase a second in tumbling windows of a counter's samples; a sample below the one before it is a reset that counts from zero."""
    w = Window.partitionBy(*key).orderBy(at)
    before = F.lag(value).over(w)
    step = F.when(before.isNull(), 0.0).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)
    stepped = df.withColumn("_d", step).withColumn("bucket", F.floor(F.col(at) / seconds).cast("long"))
    return stepped.groupBy(*key, "bucket").agg((F.sum("_d") / seconds).alias("rate"))


def held_alerts(df: DataFrame, key: list[str], at: str, condition: str, seconds: float) -> DataFrame:
    """Spells in which a condition held from one sample to the next for at least ``seconds``: since when, when it fired, and its end."""
    w = Window.partitionBy(*key).orderBy(at)
    numbered = df.withColumn("_new", (F.col(condition) & ~F.coalesce(F.lag(condition).over(w), F.lit(False))).cast("int")).withColumn("_spell", F.sum("_new").over(w)).where(condition)
    whole = Window.partitionBy(*key, "_spell")
    since = numbered.withColumn("_since", F.min(at).over(whole))
    return since.groupBy(*key, F.col("_since").alias("since")).agg(F.min(F.when(F.col(at) - F.col("_since") >= seconds, F.col(at))).alias("fired_at"), F.max(at).alias("last_at")).where("fired_at IS NOT NULL")


def timed_alerts(df: DataFrame, key: list[str], at: str, condition: str, seconds: float, tie: str = "id") -> DataFrame:
    """Spells in which a condition held, from a sample until one that says otherwise, for at least ``seconds``: since when, and fired_at, ``seconds`` later, whether or not there is a sample then.

    A spell that no sample has ended goes on. Of samples of one time the order is that of ``tie``.
    """
    w = Window.partitionBy(*key).orderBy(at, tie)
    holds = F.coalesce(F.col(condition), F.lit(False))
    edges = df.select(*key, at, tie, holds.alias("_on")).withColumn("_edge", F.col("_on") != F.coalesce(F.lag("_on").over(w), F.lit(False))).where("_edge")
    spells = edges.withColumn("_until", F.lead(at).over(w)).where("_on")
    return spells.where(F.col("_until").isNull() | (F.col("_until") - F.col(at) >= seconds)).select(*key, F.col(at).alias("since"), (F.col(at) + seconds).alias("fired_at"))


#: Alert rules: name -> (condition, severity, cooldown in seconds)
ALERT_RULES = {
    "circuit_breaker_open": ("state = 'OPEN'", "critical", 60),
    "high_failure_rate": ("success_rate < 0.5", "high", 120),
    "queue_backup": ("capacity > 0 AND queue_size / capacity > 0.8", "medium", 60),
    "cost_spike": ("cost_per_minute > cost_limit * 1.5", "high", 300),
    "low_tokens": ("available_tokens < 2", "low", 30),
}


def alerts(df: DataFrame) -> DataFrame:
    """A row for each rule that a sample breaks: its name and severity."""
    rules = F.array_compact(F.array(*[F.when(F.expr(c), F.struct(F.lit(n).alias("alert"), F.lit(s).alias("severity"))) for n, (c, s, _) in ALERT_RULES.items()]))
    return df.select("*", F.explode(rules).alias("_a")).select(*df.columns, "_a.*")


def engagement(df: DataFrame, variant: str = "variant") -> DataFrame:
    return df.groupBy(variant).agg(F.count(F.lit(1)).alias("total_events"), F.count_if(F.col("event_type") == "ping").alias("pings"), F.count_if(F.col("event_type") == "completion").alias("completions"), F.countDistinct("job_id").alias("jobs"))
