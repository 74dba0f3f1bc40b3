"""Model inference behind one batch interface, and span decoding."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Bytes of text that stand as Python strings at once, but for one longer text.
PART_BYTES = 1 << 20


class Backend(Protocol):
    """Texts in, one vector each out."""

    def run(self, texts: list[str]) -> np.ndarray: ...


def _words(text: str, size: int = 1 << 16) -> Iterator[list[str]]:
    """Lower-cased words between white space, piece by piece, so that a long text
    never becomes one long list. Pieces end behind white space."""
    at = 0
    while at < len(text):
        cut = at + size
        while cut < len(text) and not text[cut - 1].isspace():
            cut += 1
        yield text[at:cut].lower().split()
        at = cut


class HashingBackend:
    """Deterministic stand-in for a model: signed hashed words, L2-normalised."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def run(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for row, t in zip(out, texts):
            for words in _words(t):
                for w in words:
                    h = crc32(w.encode())
                    row[h % self.dim] += 1 if h & 0x8000_0000 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=out, where=n > 0)


def embed(df: DataFrame, id_col: str, text_col: str, backend: Backend, max_tokens: int | None = None, batch_tokens: int = 2048) -> DataFrame:
    """(id, v, error): texts go to the backend in batches of about ``batch_tokens``
    estimated tokens, like lengths together within a megabyte; a text beyond ``max_tokens`` gets an
    error and fails no other."""
    from .tokens import estimate

    def vectors_of(texts: list[str], sizes: list[int]) -> tuple[list, list]:
        vectors: list = [None] * len(texts)
        errors = [f"{n} tokens, at most {max_tokens}" if max_tokens and n > max_tokens else None for n in sizes]
        batch, used = [], 0

        def flush():
            if batch:
                made = backend.run([texts[i] for i in batch])
                if len(made) != len(batch):
                    raise ValueError(f"the backend returned {len(made)} rows for {len(batch)} texts")
                for i, v in zip(batch, made):
                    vectors[i] = v
                batch.clear()

        for i in sorted(range(len(texts)), key=sizes.__getitem__):
            if errors[i]:
                continue
            if batch and used + sizes[i] > batch_tokens:
                flush()
                used = 0
            batch.append(i)
            used += sizes[i]
        flush()
        return vectors, errors

    def run(batches):
        for whole in batches:
            # texts become Python strings a bounded part of the batch at a time
            size = pc.fill_null(pc.binary_length(whole.column(1)), 0).to_numpy(zero_copy_only=False).cumsum()
            at = 0
            while at < whole.num_rows:
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + PART_BYTES, "right")))
                part = whole.slice(at, to - at)
                texts = [t or "" for t in part.column(1).to_pylist()]
                vectors, errors = vectors_of(texts, [estimate(t) for t in texts])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())], names=["id", "v", "error"])
                at = to

    kind = dict(df.dtypes)[id_col]
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, v array<float>, error string")


def decode_spans(df: DataFrame, threshold: float) -> DataFrame:
    """Greedy span decoding of (id, scores, max_spans, width, labels): candidates
    at or above the threshold, best first, none that overlaps one already taken,
    whatever its label. Returns (id, start, end, label, score)."""
    size = F.col("max_spans") * F.col("width") * F.col("labels")
    ok = df.withColumn("scores", F.when(F.size("scores") == size, F.col("scores")).otherwise(F.raise_error(F.lit("scores do not fit the shape"))))
    one = lambda x, i: F.struct(
        (-x).cast("double").alias("neg"),
        F.floor(i / (F.col("width") * F.col("labels"))).cast("int").alias("start"),
        (F.floor(i / (F.col("width") * F.col("labels"))) + F.floor(i / F.col("labels")) % F.col("width") + 1).cast("int").alias("end"),
        (i % F.col("labels")).cast("int").alias("label"),
    )
    cands = F.array_sort(F.filter(F.transform("scores", one), lambda c: -c["neg"] >= threshold))
    empty = F.array().cast("array<struct<neg:double,start:int,end:int,label:int>>")
    taken = F.aggregate(
        cands,
        empty,
        lambda acc, c: F.when(F.exists(acc, lambda t: (t["start"] < c["end"]) & (c["start"] < t["end"])), acc).otherwise(F.concat(acc, F.array(c))),
    )
    out = ok.select("id", F.explode(taken).alias("c"))
    return out.select("id", "c.start", "c.end", "c.label", (-F.col("c.neg")).alias("score"))


#: Execution providers by platform; the CPU is always last.
PROVIDERS = {
    "linux_nvidia": ("CUDA", "TensorRT", "CPU"),
    "linux_amd": ("ROCm", "CPU"),
    "linux_intel_gpu": ("OpenVINO", "CPU"),
    "windows": ("DirectML", "CPU"),
    "macos_apple_silicon": ("CoreML", "CPU"),
    "cpu_only": ("CPU",),
}


def ep_priority(platform: str) -> tuple[str, ...]:
    """Execution providers to try on a platform, the best first."""
    try:
        return PROVIDERS[platform]
    except KeyError:
        raise ValueError(f"unknown platform {platform!r}, known are {sorted(PROVIDERS)}") from None
