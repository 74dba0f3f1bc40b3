"""Chunking, batch packing and latency percentiles."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: No token is longer, so a window of b tokens spans b times this many characters at most.
MAX_CHARS_PER_TOKEN = 32


def estimate(text: str) -> int:
    chars, octets = len(text), len(text.encode())
    return 2 + max(chars, octets // 3)


def _last(lo: int, hi: int, fits: Callable[[int], bool]) -> int:
    """The largest value in [lo, hi) that fits, given that lo does and hi does not."""
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if fits(mid) else (lo, mid)
    return lo


def plan_windows(n: int, budget: int, overlap: int, count: Callable[[int, int], int]) -> list[tuple[int, int]]:
    """[start, end) windows of at most ``budget`` tokens that repeat about
    ``overlap`` tokens of the window before; count(a, b) measures a slice."""
    if n == 0 or count(0, n) <= budget:
        return [(0, n)]
    overlap, out, start = min(overlap, max(0, budget - 1)), [], 0
    while True:
        cap = min(n, start + budget * MAX_CHARS_PER_TOKEN)
        end = cap if count(start, cap) <= budget else max(start + 1, _last(start, cap, lambda e: count(start, e) <= budget))
        out.append((start, end))
        if end >= n:
            return out
        # too long below, short enough from the returned position on
        start = end if not overlap else _last(start, end, lambda s: count(s, end) > overlap) + 1


def token_windows(df: DataFrame, text: str, budget: int, overlap: int, count: Callable[[str], int] = estimate) -> DataFrame:
    """One row per window of each text: the row, window number, start, end."""
    extra = [f for f in df.schema.fields if f.name != text]

    def run(frames):
        for pdf in frames:
            rows = []
            for rec in pdf.itertuples(index=False):
                t = getattr(rec, text) or ""
                for k, (a, b) in enumerate(plan_windows(len(t), budget, overlap, lambda x, y, t=t: count(t[x:y]))):
                    rows.append((*(getattr(rec, f.name) for f in extra), k, a, b))
            yield pd.DataFrame(rows, columns=[*(f.name for f in extra), "window", "start", "end"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in extra)
    return df.mapInPandas(run, f"{kinds}, window int, start int, end int")


def pack_batches(jobs: DataFrame, cap: int) -> DataFrame:
    """Add ``batch`` to (bucket, seq, tokens): within a bucket, jobs in order of
    seq fill a batch until the next would pass ``cap``; one job at least. The
    shuffle sorts, and buckets are folded as they stream by."""

    def run(frames):
        bucket, batch, used = object(), 0, 0
        for pdf in frames:
            out = []
            for b, s, n in pdf.itertuples(index=False):
                if b != bucket:
                    bucket, batch, used = b, 0, 0
                elif used + n > cap:
                    batch, used = batch + 1, 0
                used += n
                out.append((b, s, n, batch))
            yield pd.DataFrame(out, columns=["bucket", "seq", "tokens", "batch"])

    kind = dict(jobs.dtypes)
    ordered = jobs.select("bucket", "seq", "tokens").repartition("bucket").sortWithinPartitions("bucket", "seq")
    return ordered.mapInPandas(run, f"bucket {kind['bucket']}, seq {kind['seq']}, tokens {kind['tokens']}, batch int")


def latency_percentiles(df: DataFrame, key: str, order: list[str], value: str, last: int = 1024) -> DataFrame:
    """Nearest-rank p50 and p99 of each key's ``last`` most recent values."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    recent = df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= last)
    return recent.groupBy(key).agg(
        F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{value}`)").alias("p50"),
        F.expr(f"percentile_disc(0.99) WITHIN GROUP (ORDER BY `{value}`)").alias("p99"),
        F.count("*").alias("n"),
    )
