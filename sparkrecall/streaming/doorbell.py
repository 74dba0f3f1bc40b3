"""The doorbell: coalesced, resumable notifications per reader set.

``replay`` folds a finished log of rings and waits in order of arrival, one pass
per reader set; ``stream`` keeps the same state in Structured Streaming.
"""

from __future__ import annotations

import json
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sees(reader: str, recipient: str) -> bool:
    """Equal, or an unqualified reader and a recipient of its name."""
    _, _, tail = reader.partition("@")
    return bool(reader) and (reader == recipient or not tail and recipient.startswith(reader + "@"))


def is_qualified(reader: Column) -> Column:
    return reader.rlike("@.")


def addresses(recipient: Column) -> Column:
    """The recipient and every prefix of it that ends before an ``@``: exactly
    those readers, if unqualified, may see it."""
    cuts = F.filter(F.sequence(F.lit(1), F.length(recipient)), lambda i: F.substring(recipient, i, F.lit(1)) == "@")
    prefixes = F.transform(cuts, lambda i: F.substring(recipient, F.lit(1), i - 1))
    return F.array_distinct(F.concat(F.array(recipient), F.filter(prefixes, lambda p: ~p.rlike("@.") & (p != ""))))


def sees_join(rings: DataFrame, readers: DataFrame) -> DataFrame:
    """Rings (.., recipient) with each reader (reader) that sees them: an
    equi-join on the addresses of a recipient."""
    out = rings.withColumn("_address", F.explode(addresses(F.col("recipient"))))
    who = readers.filter("reader <> ''").distinct()
    return out.join(who, out["_address"] == who["reader"]).drop("_address")


def reader_key(readers: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.filter(readers, lambda r: r != ""))), "\n")


class ReaderSet:
    """What one reader set knows: cursor, uncollected rings, whether any was lost."""

    def __init__(self, window: float, keep: float):
        self.window, self.keep = window, keep
        self.known, self.pending, self.lost, self.wakes = False, deque(), 0, 0

    def ring(self, at: float, recipient: str, origin: str | None) -> None:
        if self.known:
            self.pending.append((at, recipient, origin))

    def trim(self, now: float) -> None:
        # rings come in order: the oldest stand first
        while self.pending and now - self.pending[0][0] > self.keep:
            self.pending.popleft()
            self.lost += 1

    def _resync(self) -> dict | None:
        if not self.lost:
            return None
        self.lost, self.pending = 0, deque()
        return {"wake": "resync"}

    def start(self, now: float) -> dict | None:
        if not self.known:
            self.known = True
            return {"wake": "resync"}
        return self._resync()

    def due(self, since: float, deadline: float) -> float | None:
        """When the wait that began at ``since`` is answered with mail."""
        if not self.pending:
            return None
        return max(since, min(self.pending[0][0] + self.window, deadline))

    def take(self, now: float) -> dict:
        lost = self._resync()
        if lost:
            return lost
        got = []
        while self.pending and self.pending[0][0] <= now:
            got.append(self.pending.popleft())
        if not got:
            return {"wake": "timeout"}
        self.wakes += 1
        return {"wake": "mail", "count": len(got), "recipients": sorted({r[1] for r in got}), "origins": sorted({r[2] for r in got if r[2] is not None})}


class Fold:
    """The wakes of one reader set, event by event in order."""

    def __init__(self, window: float, keep: float):
        self.own, self.open_wait = ReaderSet(window, keep), None

    def step(self, at: float, kind: str, recipient: str | None, origin: str | None, timeout: float | None) -> list[tuple]:
        """(wait began, answered, wake) rows of one more event; kind is ``ring``,
        ``wait`` or ``end``."""
        own, out = self.own, []
        while self.open_wait is not None:
            since, deadline = self.open_wait
            due = own.due(since, deadline)
            when = deadline if due is None else due
            if when >= at:
                break
            out.append((since, when, own.take(when) if due is not None else {"wake": "timeout"}))
            self.open_wait = None
        if kind == "ring":
            own.ring(at, recipient, origin)
            own.trim(at)
            if own.lost and self.open_wait is not None and own.due(*self.open_wait) is None:
                out.append((self.open_wait[0], at, own._resync()))
                self.open_wait = None
        elif kind == "wait" and self.open_wait is None:
            now = own.start(at)
            if now:
                out.append((at, at, now))
            else:
                self.open_wait = (at, at + timeout)
        return out

    def end(self) -> list[tuple]:
        return self.step(float("inf"), "end", None, None, None)


def fold(events: list[tuple], window: float, keep: float) -> tuple[list[tuple], ReaderSet]:
    """Replay (at, kind, recipient, origin, timeout) of one reader set in order;
    kind is ``ring`` or ``wait``. Returns (wait began, answered, wake) rows."""
    own = Fold(window, keep)
    out = [row for event in events for row in own.step(*event)]
    return out + own.end(), own.own


WAKE = "key string, since double, at double, wake string, count int, recipients array<string>, origins array<string>"


def replay(rings: DataFrame, waits: DataFrame, window: float = 2.5, keep: float = 3600.0) -> DataFrame:
    """Wakes of every wait. ``rings`` is (seq, at seconds, recipient, origin),
    ``waits`` is (at, readers array, timeout_s). Each ring goes to the sets that
    see it by an equi-join; a set's events are sorted by the shuffle and folded
    as they stream by, so memory holds the rings that wait to be collected only."""
    asks = waits.select(reader_key(F.col("readers")).alias("key"), F.lit(1).alias("o"), "at", F.col("timeout_s").alias("timeout")).filter("key <> ''")
    members = asks.select("key", F.explode(F.split("key", "\n")).alias("reader")).distinct()
    heard = sees_join(rings, members.select("reader")).join(members, "reader").select("key", "seq", "at", "recipient", "origin").distinct()
    events = heard.select("key", "at", F.lit(0).alias("o"), F.col("seq").cast("long").alias("seq"), "recipient", "origin", F.lit(None).cast("double").alias("timeout"))
    events = events.unionByName(
        asks.select("key", "at", "o", F.lit(0).cast("long").alias("seq"), F.lit(None).cast("string").alias("recipient"), F.lit(None).cast("string").alias("origin"), F.col("timeout").cast("double"))
    )

    def run(frames):
        now_key, own = None, None

        def rows(key, found):
            return [(key, since, at, w["wake"], w.get("count"), w.get("recipients"), w.get("origins")) for since, at, w in found]

        def made(out):
            return pd.DataFrame(out, columns=["key", "since", "at", "wake", "count", "recipients", "origins"]).astype({"count": "Int32"})

        for pdf in frames:
            out = []
            for key, at, o, _, recipient, origin, timeout in pdf.itertuples(index=False):
                if key != now_key:
                    out += rows(now_key, own.end()) if own else []
                    now_key, own = key, Fold(window, keep)
                out += rows(key, own.step(at, "wait" if o else "ring", recipient, origin if isinstance(origin, str) else None, timeout))
            yield made(out)
        if own:
            yield made(rows(now_key, own.end()))

    order = ["key", F.asc_nulls_last("at"), "o", F.asc_nulls_last("seq")]
    return events.repartition("key").sortWithinPartitions(*order).mapInPandas(run, WAKE)


def status(rings: DataFrame, cursors: DataFrame, now: float) -> DataFrame:
    """Pending rings per reader set: ``cursors`` is (key, cursor). Returns key,
    pending, oldest_pending_s."""
    members = cursors.select("key", "cursor", F.explode(F.split("key", "\n")).alias("reader")).distinct()
    heard = sees_join(rings, members.select("reader")).join(members, "reader").filter("seq > cursor").select("key", "seq", "at").distinct()
    agg = heard.groupBy("key").agg(F.count("*").alias("pending"), (F.lit(now) - F.min("at")).alias("oldest_pending_s"))
    return cursors.select("key").join(agg, "key", "left").select("key", F.coalesce("pending", F.lit(0)).cast("long").alias("pending"), "oldest_pending_s")


def stream(events: DataFrame, window: float = 2.5, keep: float = 3600.0) -> DataFrame:
    """Streaming counterpart: ``events`` is (key, at, kind, recipient, origin,
    timeout), rings already fanned out to their sets. State is the set's pending
    rings and its open wait; processing-time timeouts answer waits."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, frames, state):
        own, open_wait = ReaderSet(window, keep), None
        if state.exists:
            own.known, own.lost, pending, since, deadline = state.get
            own.pending = deque(tuple(x) for x in json.loads(pending))
            open_wait = (since, deadline) if deadline >= 0 else None
        out = []
        now = state.getCurrentProcessingTimeMs() / 1000

        def answer(limit: float) -> None:
            nonlocal open_wait
            if open_wait is None:
                return
            due = own.due(*open_wait)
            when = open_wait[1] if due is None else due
            if when <= limit:
                w = own.take(when) if due is not None else {"wake": "timeout"}
                out.append((key[0], open_wait[0], when, w["wake"], w.get("count"), w.get("recipients"), w.get("origins")))
                open_wait = None

        for pdf in frames:
            for r in pdf.sort_values("at").itertuples():
                answer(r.at)
                if r.kind == "ring":
                    own.ring(r.at, r.recipient, r.origin if isinstance(r.origin, str) else None)
                    own.trim(r.at)
                elif open_wait is None:
                    first = own.start(r.at)
                    if first:
                        out.append((key[0], r.at, r.at, first["wake"], None, None, None))
                    else:
                        open_wait = (r.at, r.at + r.timeout)
        if state.hasTimedOut:
            answer(now)
        since, deadline = open_wait or (-1.0, -1.0)
        state.update((own.known, own.lost, json.dumps(list(own.pending)), since, deadline))
        if open_wait:
            due = own.due(*open_wait) or deadline
            state.setTimeoutDuration(max(1, int((due - now) * 1000)))
        yield pd.DataFrame(out, columns=["key", "since", "at", "wake", "count", "recipients", "origins"]).astype({"count": "Int32"})

    return events.groupBy("key").applyInPandasWithState(
        step, WAKE, "known boolean, lost long, pending string, since double, deadline double", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


MAX_RECIPIENTS, MAX_ORIGIN, MAX_WAIT, DEFAULT_WAIT = 1000, 128, 3600.0, 300.0


def checked_rings(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ring requests (recipients array, origin) that count, one row for each
    non-empty recipient, and those refused, with ``reason``."""
    named = F.filter("recipients", lambda r: r != "")
    reason = (
        F.when(F.coalesce(F.size("recipients"), F.lit(0)) < 1, "no recipients")
        .when(F.size("recipients") > MAX_RECIPIENTS, f"more than {MAX_RECIPIENTS} recipients")
        .when(F.size(named) == 0, "only empty recipients")
        .when(F.col("origin") == "", "empty origin")
        .when(F.octet_length("origin") > MAX_ORIGIN, f"origin beyond {MAX_ORIGIN} bytes")
        .when(F.col("origin").rlike(r"\p{Cntrl}"), "control characters in origin")
    )
    marked = requests.withColumn("reason", reason)
    good = marked.filter("reason is null").withColumn("recipient", F.explode(named)).drop("reason", "recipients")
    return good, marked.filter("reason is not null")


def checked_waits(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Wait requests (readers array, timeout_s) with timeouts defaulted and
    capped, and those refused."""
    timeout = F.coalesce("timeout_s", F.lit(DEFAULT_WAIT))
    reason = F.when(F.size(F.filter("readers", lambda r: r != "")) < 1, "no readers").when(
        F.isnan(timeout) | (timeout < 0) | (timeout == float("inf")), "timeout is no non-negative number"
    )
    marked = requests.withColumn("reason", reason)
    good = marked.filter("reason is null").drop("reason").withColumn("timeout_s", F.least(timeout, F.lit(MAX_WAIT)))
    return good, marked.filter("reason is not null")


def for_each_wake(wakes: DataFrame, command, checkpoint: str | None = None):
    """Run ``command(row)`` on the driver for every wake of a stream; a batch of
    wakes is as large as the number of reader sets that were woken."""

    def run(batch: DataFrame, _: int) -> None:
        for row in batch.toLocalIterator():
            command(row)

    writer = wakes.writeStream.foreachBatch(run)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
