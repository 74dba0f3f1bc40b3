"""Vector search: stated queries against all rows, query block by query block.

Vectors meet in numpy: a corpus batch meets a broadcast block of queries in
matrix products of bounded size, and a task keeps only its best k per query.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .best import Best, columns_at_once, few_tasks, ranked

#: Queries that are sent to the executors at once.
BLOCK = 2048


def _matrix(column: pa.Array, dim: int, ids: pa.Array | None = None) -> np.ndarray:
    """The rows of a list column; a null or a list of another length than ``dim``
    is an error that names the first such row."""
    good = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    if len(column) and not pc.all(good).as_py():
        at = good.index(False).as_py()
        name = f"id {ids[at]}" if ids is not None else f"row {at}"
        raise ValueError(f"{name}: a vector of {dim} numbers was expected, found {'null' if not column[at].is_valid else len(column[at])}")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def blocks_of(queries: DataFrame, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of at most about ``block`` queries at a time, cut by hash."""
    n = queries.count()
    parts = max(1, -(-n // block))
    for k in range(parts):
        part = queries if parts == 1 else queries.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == k)
        rows = part.select("id", "v").toArrow()
        if rows.num_rows:
            ids = rows.column(0).to_numpy()
            v = rows.column(1).combine_chunks()
            own = rows.column(0).combine_chunks()
            m = _matrix(v, len(v[0]) if v[0].is_valid else -1, own)
            if not np.isfinite(m).all():
                raise ValueError(f"query {own[int(np.argmin(np.isfinite(m).all(axis=1)))]} has a part that is not finite")
            yield ids, m


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def top_k(corpus: DataFrame, queries: DataFrame, k: int, codes: bool = False, block: int = BLOCK) -> DataFrame:
    """(query_id, id, score, rank): the k best rows of ``corpus`` (id, v) for each
    of ``queries`` (id, v) by cosine, ties to the smaller id. With ``codes`` the
    corpus is an int8 index (id, codes, scale) and the score is approximate."""
    if k <= 0:
        return corpus.sparkSession.createDataFrame([], "query_id long, id long, score double, rank int")
    out = None
    for ids, vectors in blocks_of(queries, block):
        part = _block_top_k(corpus, ids, vectors, k, codes)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return corpus.sparkSession.createDataFrame([], "query_id long, id long, score double, rank int")
    out = ranked(out, k)
    return out.withColumn("score", F.when(F.col("score") == float("-inf"), float("nan")).otherwise(F.col("score")))


def _block_top_k(corpus: DataFrame, ids: np.ndarray, vectors: np.ndarray, k: int, codes: bool) -> DataFrame:
    shared = corpus.sparkSession.sparkContext.broadcast((ids, _unit(vectors)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = shared.value
        if codes:
            live = np.linalg.norm(q, axis=1) > 0
            q_ids, q = q_ids[live], q[live]
        best, width = Best(len(q_ids), k), columns_at_once(len(q_ids))
        for whole in batches:
            for at in range(0, whole.num_rows, width):
                batch = whole.slice(at, width)
                own, m = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1), q.shape[1], batch.column(0))
                if codes:
                    s = q @ m.T * batch.column(2).to_numpy(zero_copy_only=False)[None, :]
                else:
                    s = np.clip(q @ _unit(m).T, -1, 1)
                # what is no number comes last
                best.add(np.nan_to_num(np.round(s, 12), copy=False, nan=-np.inf), own)
        yield from best.rows(q_ids)

    cols = ["id", "codes", "scale"] if codes else ["id", "v"]
    return few_tasks(corpus.select(*cols).mapInArrow(run, "query_id long, id long, score double"))


def max_pool(corpus: DataFrame, anchors: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id, score): the best cosine of any anchor per row; -1 without anchors."""
    sc = corpus.sparkSession.sparkContext
    # one pass for all blocks: the anchors alone are held, never their scores
    shared = [sc.broadcast(_unit(vectors)) for _, vectors in blocks_of(anchors, block)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.full(batch.num_rows, -1.0)
            for one in shared:
                a = one.value
                width = columns_at_once(len(a))
                for at in range(0, batch.num_rows, width):
                    part = batch.slice(at, width)
                    found = np.clip(a @ _unit(_matrix(part.column(1), a.shape[1], part.column(0))).T, -1, 1).max(axis=0)
                    s[at : at + width] = np.maximum(s[at : at + width], found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], names=["id", "score"])

    return corpus.select("id", "v").mapInArrow(run, f"id {dict(corpus.dtypes)['id']}, score double")
