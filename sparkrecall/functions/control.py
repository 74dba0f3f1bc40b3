"""Pacing, retry and breaker logic."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GovernorConfig:
    """Load thresholds: initial in 10..99, limit in 20..100; initial stays below
    a limit that is not 100."""

    initial: int = 70
    limit: int = 90

    def clamped(self) -> "GovernorConfig":
        initial, limit = min(99, max(10, self.initial)), min(100, max(20, self.limit))
        return GovernorConfig(limit - 5 if initial >= limit and limit != 100 else initial, limit)


def decide_pacing(load: Column, elapsed: Column, config: GovernorConfig = GovernorConfig()) -> Column:
    """struct(mode, background_delay, interactive_delay); NaN counts as the most
    restrictive value."""
    c = config.clamped()
    load, elapsed = F.nanvl(load.cast("double"), F.lit(100.0)), F.nanvl(elapsed.cast("double"), F.lit(0.0))
    halted = (load >= c.limit) if c.limit != 100 else F.lit(False)

    def row(mode: str, background: float | None, interactive: float) -> Column:
        return F.struct(F.lit(mode).alias("mode"), F.lit(background).cast("double").alias("background_delay"), F.lit(interactive).alias("interactive_delay"))

    return (
        F.when(halted, row("HALTED", None, 30.0))
        .when(load >= c.initial, row("THROTTLED", 10.0, 0.0))
        .when(elapsed < 30, row("HALTED", None, 0.0))
        .when(elapsed < 60, row("TAPERED", 5.0, 0.0))
        .otherwise(row("CONTINUOUS", 0.1, 0.0))
    )


def retry_delay(attempt: Column, base: float = 0.1, max_delay: float = 2.0) -> Column:
    doublings = F.least(F.greatest(attempt - 1, F.lit(0)), F.lit(31))
    return F.least(F.lit(max_delay), base * F.pow(F.lit(2.0), doublings))


def ceil_secs(d: Column) -> Column:
    return F.ceil(d)


class Breaker:
    """Consecutive failures open it; after a cooldown one probe is let through."""

    def __init__(self, threshold: int = 5, cooldown: float = 10.0):
        self.threshold, self.cooldown = max(1, threshold), cooldown
        self.phase, self.since, self.failures, self.last_error = "closed", 0.0, 0, None

    def _left(self, now: float) -> float:
        return max(0.0, self.cooldown - max(0.0, now - self.since)) if self.phase != "closed" else 0.0

    def state(self, now: float) -> str:
        return "closed" if self.phase == "closed" else "open" if self.phase == "open" and self._left(now) else "half_open"

    def check(self, now: float) -> bool:
        return not self._left(now)

    def admit(self, now: float) -> bool:
        ok = self.check(now)
        if ok and self.phase != "closed":
            self.phase, self.since = "half_open", now
        return ok

    def record(self, ok: bool, now: float, message: str | None = None) -> None:
        if ok:
            self.phase, self.failures, self.last_error = "closed", 0, None
            return
        self.failures += 1
        self.last_error = message or self.last_error
        if self.failures >= self.threshold or self.phase == "half_open":
            self.phase, self.since = "open", now


def replay_breaker(calls: DataFrame, threshold: int = 5, cooldown: float = 10.0) -> DataFrame:
    """Replay (key, seq, at seconds, ok): adds admitted, state and failures after
    each call. A key's calls are folded in order of (at, seq); a refused call
    leaves no trace. Calls are sorted by the shuffle and folded as they stream
    by, so no key is held in memory."""

    def run(frames):
        now_key, own = object(), None
        for pdf in frames:
            out = []
            for key, seq, at, ok in pdf.itertuples(index=False):
                if key != now_key:
                    now_key, own = key, Breaker(threshold, cooldown)
                admitted = own.admit(at)
                if admitted:
                    own.record(bool(ok), at)
                out.append((key, seq, admitted, own.state(at), own.failures))
            yield pd.DataFrame(out, columns=["key", "seq", "admitted", "state", "failures"])

    ordered = calls.select("key", "seq", "at", "ok").repartition("key").sortWithinPartitions("key", "at", "seq")
    kind = dict(calls.dtypes)
    return ordered.mapInPandas(run, f"key {kind['key']}, seq {kind['seq']}, admitted boolean, state string, failures int")


def stream_breaker(calls: DataFrame, threshold: int = 5, cooldown: float = 10.0) -> DataFrame:
    """Streaming counterpart of :func:`replay_breaker`: one breaker per key in the
    state store, calls folded in order of (at, seq) within each micro-batch."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, frames, state):
        own = Breaker(threshold, cooldown)
        if state.exists:
            own.phase, own.since, own.failures = state.get
        out = []
        rows = sorted((r.at, r.seq, r.ok) for pdf in frames for r in pdf.itertuples(index=False))
        for at, seq, ok in rows:
            admitted = own.admit(at)
            if admitted:
                own.record(bool(ok), at)
            out.append((key[0], seq, admitted, own.state(at), own.failures))
        state.update((own.phase, own.since, own.failures))
        yield pd.DataFrame(out, columns=["key", "seq", "admitted", "state", "failures"])

    kind = dict(calls.dtypes)
    return calls.groupBy("key").applyInPandasWithState(
        step,
        f"key {kind['key']}, seq {kind['seq']}, admitted boolean, state string, failures int",
        "phase string, since double, failures int",
        "append",
        GroupStateTimeout.NoTimeout,
    )
