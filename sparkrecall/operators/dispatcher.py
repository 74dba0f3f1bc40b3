"""The micro-batching dispatcher as a replay over a job log, and its facade."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BackendError, ConfigError, InputTooLong
from .models import Backend, HashingBackend, embed
from .tokens import estimate, plan_windows


@dataclass(frozen=True)
class DispatcherConfig:
    """Streams, coalescing window, token cap, length buckets and breaker limits."""

    streams: int = 8
    window_ms: float = 3.0
    max_batch_tokens: int = 2048
    buckets: tuple[int, ...] = (64, 256, 1024, 4096)
    failures: int = 5
    cooldown_s: float = 10.0

    def __post_init__(self):
        if self.streams < 1 or self.max_batch_tokens < 1:
            raise ConfigError("streams and max_batch_tokens must be positive")

    @property
    def queue_limit(self) -> int:
        """Jobs that may wait before callers are refused."""
        return 4 * self.streams


def bucket_of(tokens: int, buckets: tuple[int, ...]) -> int:
    return min(sum(c < tokens for c in buckets), len(buckets) - 1)


class Coalescer:
    """Collects jobs from the first on, until the window closes or the cap is
    reached by a further job; then drains bucket by bucket."""

    def __init__(self, config: DispatcherConfig):
        self.config, self.opened, self.jobs, self.flushes = config, None, [], 0

    def push(self, at: float, seq, tokens: int, deadline: float | None) -> list[tuple]:
        out = self.close(at) if self.opened is not None and at >= self.due else []
        first = self.opened is None
        if first:
            self.opened = at
        self.jobs.append((seq, tokens, deadline))
        if not first and sum(j[1] for j in self.jobs) >= self.config.max_batch_tokens:
            out += self._drain(at)
        return out

    @property
    def due(self) -> float:
        return self.opened + max(1.0, self.config.window_ms) / 1000

    def close(self, at: float) -> list[tuple]:
        return self._drain(min(at, self.due)) if self.opened is not None else []

    def _drain(self, now: float) -> list[tuple]:
        """(seq, flush, flushed at, bucket, batch, expired) in order of dispatch."""
        cap, out, batch = self.config.max_batch_tokens, [], 0
        for b in range(len(self.config.buckets)):
            used, any_in = 0, False
            for seq, tokens, deadline in (j for j in self.jobs if bucket_of(j[1], self.config.buckets) == b):
                if any_in and used + tokens > cap:
                    batch, used = batch + 1, 0
                used, any_in = used + tokens, True
                out.append((seq, self.flushes, now, b, batch, deadline is not None and now >= deadline))
            batch += any_in
        self.jobs, self.opened, self.flushes = [], None, self.flushes + 1
        return out


def coalesce(jobs: DataFrame, config: DispatcherConfig = DispatcherConfig()) -> DataFrame:
    """Replay (queue, seq, at seconds, tokens, deadline): which flush and batch
    takes each job, and whether it came too late. The shuffle sorts; a queue is
    folded as it streams by."""

    def run(frames):
        queue, own = object(), None
        tail: list[tuple] = []
        for pdf in frames:
            rows = tail
            tail = []
            for q, seq, at, tokens, deadline in pdf.itertuples(index=False):
                if q != queue:
                    if own is not None:
                        rows += [(queue, *r) for r in own.close(float("inf"))]
                    queue, own = q, Coalescer(config)
                rows += [(q, *r) for r in own.push(at, seq, int(tokens), None if pd.isna(deadline) else deadline)]
            yield _frame(rows)
        if own is not None:
            yield _frame([(queue, *r) for r in own.close(float("inf"))])

    def _frame(rows):
        return pd.DataFrame(rows, columns=["queue", "seq", "flush", "flushed_at", "bucket", "batch", "expired"])

    kind = dict(jobs.dtypes)
    ordered = jobs.select("queue", "seq", "at", "tokens", "deadline").repartition("queue").sortWithinPartitions("queue", "at", "seq")
    return ordered.mapInPandas(run, f"queue {kind['queue']}, seq {kind['seq']}, flush int, flushed_at double, bucket int, batch int, expired boolean")


class Embedder:
    """One object for a model: embed texts or a DataFrame, count tokens, cut windows."""

    FRAME = 2

    def __init__(self, backend: Backend | None = None, context: int = 8192, config: DispatcherConfig = DispatcherConfig()):
        self.backend, self.context, self.config = backend or HashingBackend(), context, config
        self.embedding_dim = self._checked([""]).shape[1]  # also the warm-up

    @property
    def streams(self) -> int:
        return self.config.streams

    @property
    def runtime_backend(self) -> str:
        return type(self.backend).__name__

    def _checked(self, texts: list[str]) -> np.ndarray:
        rows = np.asarray(self.backend.run(texts))
        if len(rows) != len(texts):
            raise BackendError(f"{len(rows)} rows for {len(texts)} texts")
        return rows

    def count_tokens(self, batch: list[str]) -> list[int]:
        return list(map(estimate, batch))

    def embed(self, texts: list[str]) -> np.ndarray:
        for k, n in enumerate(self.count_tokens(texts)):
            if n > self.context:
                raise InputTooLong(n, self.context, k)
        return self._checked(texts)

    def embed_with_token_counts(self, texts: list[str]) -> tuple[np.ndarray, list[int]]:
        return self.embed(texts), self.count_tokens(texts)

    def embed_frame(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """Batch or streaming; a text that is too long fails alone."""
        return embed(df, id_col, text_col, self.backend, self.context, self.config.max_batch_tokens)

    def token_windows(self, text: str, budget: int, overlap: int = 0) -> list[tuple[int, int]]:
        if not self.FRAME < budget <= self.context:
            raise ConfigError(f"budget must be above {self.FRAME} and at most {self.context}")
        return plan_windows(len(text), budget, overlap, lambda a, b: estimate(text[a:b]))


def expired(jobs: DataFrame, now: float) -> DataFrame:
    return jobs.filter(F.col("deadline").isNotNull() & (F.col("deadline") <= now))
