"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded as a small feature
vector; gated attention (Ilse, Tomczak and Welling, 2018) weighs the passages,
and a logistic layer scores the weighted sum. Only document labels are given:
the weights learn which passages decide. The label is that of the whole
document, so one spoilt passage in a clean text can be found and weighed.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_held_out, materialize

#: Words of a passage.
PASSAGE = 64
#: Labelled documents to learn from at most: those with the smallest hashes of text.
MAX_LABELLED = 4000
#: Passages to learn from at most, over all labelled documents: the sample ends
#: before the document that goes beyond. A sampled document teaches with all of
#: its passages, one that has more than a sixteenth of these is not sampled.
MAX_TAUGHT = 1 << 16
_MARKS = (".", ",", "!", "?", "|", "#", "%", "$", "&", "*", ":", ";", "(", '"', "-", "/", "=", "@", "<", "{")
N_FEATURES = 14 + len(_MARKS)


def passage_features(words: list[str]) -> list[float]:
    """Shares and shapes of one passage of words; all of them lie in about 0 to 1."""
    n, text = len(words), " ".join(words)
    chars = len(text)
    seen = set(words)
    low = text.lower()
    upper = sum(map(str.isupper, words))
    alpha = sum(map(str.isalpha, words))
    digits = sum(c in text for c in "0123456789")
    runs = sum(a == b for a, b in zip(words, words[1:]))
    lens = [len(w) for w in words]
    mean = sum(lens) / n
    caps = sum(1 for a, b in zip(text, low) if a != b)
    letters = len(seen_letters := set(low))
    marks = [text.count(m) / n for m in _MARKS]
    return [
        n / PASSAGE,
        len(seen) / n,
        runs / n,
        upper / n,
        alpha / n,
        digits / 10,
        min(mean / 16, 2.0),
        math.sqrt(sum((x - mean) ** 2 for x in lens) / n) / 8,
        caps / chars,
        letters / 40,
        sum(c.isdigit() for c in seen_letters) / 10,
        sum(w[-1] in ".!?" for w in words) / n,
        len(set(text)) / 60,
        1.0,
        *marks,
    ]


def passages(text: str | None, size: int = 1 << 20) -> Iterator[list[str]]:
    """Consecutive passages of PASSAGE words; an empty text has none. Long texts
    are split piece by piece, cut where white space stands."""
    text, at, own = text or "", 0, []
    while at < len(text):
        end = at + size
        while end < len(text) and not text[end].isspace():
            end += 1
        own += text[at:end].split()
        at = end
        full = len(own) // PASSAGE * PASSAGE
        for k in range(0, full, PASSAGE):
            yield own[k : k + PASSAGE]
        own = own[full:]
    if own:
        yield own


def encode(text: str | None) -> np.ndarray:
    """One row of features for every passage; a text without words has one row of
    zeros, so that what it is worth can be learned."""
    rows: list[list[float]] = []
    parts: list[np.ndarray] = []
    for words in passages(text):
        rows.append(passage_features(words))
        if len(rows) == 4096:
            parts.append(np.array(rows, dtype=np.float32))
            rows = []
    if not rows and not parts:
        rows.append([0.0] * N_FEATURES)
    parts.append(np.array(rows, dtype=np.float32).reshape(-1, N_FEATURES))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


class MIL:
    """Gated attention over passage features, logistic output."""

    NAMES = ("V", "U", "w", "E", "e", "c")

    def __init__(self, params: dict[str, np.ndarray], mean: np.ndarray, scale: np.ndarray):
        self.p, self.mean, self.scale = params, mean, scale

    def __call__(self, features: np.ndarray) -> tuple[float, np.ndarray]:
        """Score of one document and the weights of its passages."""
        p = self.p
        x = (features - self.mean) / self.scale
        h = np.tanh(x @ p["E"] + p["e"])
        s = (np.tanh(h @ p["V"]) / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))) @ p["w"]
        a = np.exp(s - s.max())
        a /= a.sum()
        z = float(a @ h @ p["c"] + p["b"][0])
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z)))), a


def fit(bags: list[np.ndarray], labels: np.ndarray, epochs: int = 150, hidden: int = 24, gate: int = 12, seed: int = 1) -> MIL:
    """Full-batch Adam on the cross-entropy of documents, classes weighted alike."""
    rng = np.random.default_rng(seed)
    x = np.concatenate(bags) if bags else np.zeros((0, N_FEATURES))
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 0.02) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    n_in = N_FEATURES
    p = {
        "E": rng.normal(0, 1 / math.sqrt(n_in), (n_in, hidden)),
        "e": np.zeros(hidden),
        "V": rng.normal(0, 1 / math.sqrt(hidden), (hidden, gate)),
        "U": rng.normal(0, 1 / math.sqrt(hidden), (hidden, gate)),
        "w": rng.normal(0, 1 / math.sqrt(gate), gate),
        "c": rng.normal(0, 1 / math.sqrt(hidden), hidden),
        "b": np.zeros(1),
    }
    n_pos, n = float(labels.sum()), len(labels)
    if not n or not 0 < n_pos < n:
        # one class only: its share is all that can be learned
        share = (n_pos + 1) / (n + 2)
        p["c"][:], p["b"][0] = 0, math.log(share / (1 - share))
        return MIL(p, mean, scale)
    x = (x - mean) / scale
    bag = np.repeat(np.arange(n), [len(b) for b in bags])
    starts = np.searchsorted(bag, np.arange(n))
    weight = np.where(labels > 0, n / (2 * n_pos), n / (2 * (n - n_pos))) / n
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v2 = {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, epochs + 1):
        h = np.tanh(x @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-h @ p["U"]))
        tg = t * g
        s = tg @ p["w"]
        s = np.exp(s - np.maximum.reduceat(s, starts)[bag])
        a = s / np.add.reduceat(s, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"][0], -40, 40)))
        dy = weight * (y - labels)
        dz = dy[:, None] * p["c"]
        da = np.einsum("ij,ij->i", dz[bag], h)
        ds = a * (da - np.add.reduceat(a * da, starts)[bag])
        dtg = ds[:, None] * p["w"]
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = (a[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        grad = {
            "E": x.T @ dh, "e": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": tg.T @ ds, "c": z.T @ dy, "b": np.array([dy.sum()]),
        }
        rate = 0.02 if step < 0.7 * epochs else 0.005
        for k in p:
            gk = grad[k] + (1e-4 * p[k] if k not in ("b", "e") else 0)
            m[k] = 0.9 * m[k] + 0.1 * gk
            v2[k] = 0.999 * v2[k] + 0.001 * gk * gk
            p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)
    return MIL(p, mean, scale)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_taught: int = MAX_TAUGHT) -> MIL:
    """Learn from at most ``max_labelled`` labelled rows that are not held out and
    have at most ``max_taught`` passages together.

    They are those with the smallest hash of doc_id (ties: doc_id), the same at
    every partitioning. All passages of each are encoded on the executors, and
    only those features come to the driver.
    """
    known = labels.filter("quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    known = known.filter(f"doc_id is not null and not {is_held_out()}").withColumnRenamed("doc_id", "_id")
    # ids first: texts are read only for the rows that the sample keeps
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    chosen = materialize(docs.sparkSession, chosen, "labelled")

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "quality")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = [encode(text.as_py()) for text in part.column(1)]
                x = [f.astype("<f4").tobytes() if len(f) <= max_taught // 16 else None for f in out]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([len(f) for f in out], pa.int64()), pa.array(x, pa.binary())], names=["doc_id", "quality", "n", "x"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = materialize(docs.sparkSession, rows.mapInArrow(run, f"doc_id {kind}, quality int, n long, x binary").filter("x is not null"), "taught")
    found = found.withColumn("h", F.xxhash64("doc_id"))
    taken, last = 0, None
    for r in found.groupBy("h").agg(F.sum("n").alias("n")).orderBy("h").toLocalIterator():
        taken += r["n"]
        if taken > max_taught:
            break
        last = r["h"]
    if last is None:
        return fit([], np.zeros(0))
    data = sorted((r["h"], str(r["doc_id"]), r["quality"], bytes(r["x"])) for r in found.filter(F.col("h") <= last).toLocalIterator())
    bags = [np.frombuffer(x, dtype="<f4").reshape(-1, N_FEATURES).astype(np.float64) for *_, x in data]
    return fit(bags, np.array([float(q > 0) for _, _, q, _ in data]))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted.

    Null and empty texts are a bag of one empty passage, in training as in
    scoring; ties and repeated rows score alike; with no labels every score is a half; an
    empty table gives no rows; doc_id serves only to match labels, and only it
    and text are read.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            out = []
            for text in batch.column(1):
                out.append(own(encode(text.as_py()))[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return out.select(
        "doc_id",
        F.coalesce(F.expr(is_held_out()), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
