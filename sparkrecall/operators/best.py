"""The best k of each query, kept while scores stream by in small matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scores that one matrix holds at most.
CELLS = 1 << 19


class Best:
    """Of all (query, id, score) seen, the k best of each of ``n`` queries; ties
    go to the smaller id. A score that is NaN is none."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        # score and id of the k-th best: what does not come before it is not kept
        self.kth, self.kth_id = np.full(n, -np.inf), np.full(n, np.iinfo(np.int64).max)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held, self.room = 0, max(CELLS, 2 * n * k)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` has a row for each query and a column for each of ``ids``."""
        q, c = np.nonzero(scores >= self.kth[:, None])
        s, i = scores[q, c], ids[c]
        keep = (s > self.kth[q]) | (i < self.kth_id[q])
        self.parts.append((q[keep].astype(np.int32), i[keep], s[keep]))
        self.held += int(keep.sum())
        if self.held > self.room:
            self._compact()

    def _compact(self) -> None:
        q, i, s = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        at = np.arange(len(q))
        first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
        place = at - np.maximum.accumulate(np.where(first, at, 0))
        last = place == self.k - 1
        self.kth[q[last]], self.kth_id[q[last]] = s[last], i[last]
        keep = place < self.k
        self.parts, self.held = [(q[keep], i[keep], s[keep])], int(keep.sum())

    def rows(self, query_ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self._compact()
            q, i, s = self.parts[0]
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[q]), pa.array(i), pa.array(s)], names=["query_id", "id", "score"])


def columns_at_once(n: int) -> int:
    """How many columns a matrix of ``n`` rows may have."""
    return max(1, CELLS // max(1, n))


def few_tasks(found: DataFrame) -> DataFrame:
    """Each task sends k rows for each query, so the number of tasks must not
    grow with the table; the window's own limit cuts what one task has found."""
    return found.coalesce(2 * found.sparkSession.sparkContext.defaultParallelism)


def ranked(found: DataFrame, k: int, score: Column | str = "score") -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(score), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
