"""Diversity reranking, content dedup and the displacement guard.

These are greedy and order-dependent. A query of up to FOLD candidates is folded
in one Python group. A longer list is never gathered or cut: MMR takes one
distributed argmax over all its candidates per pick, with the picks so far
broadcast, and the displacement guard folds only the rows that can move.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import _cut

#: Candidates that one Python group holds at most; queries whose picks are
#: broadcast at once.
FOLD, BLOCK = 1000, 64


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _cosines(unit: np.ndarray, pick: np.ndarray) -> np.ndarray:
    # row by row, so that equal vectors have equal cosines wherever they stand
    return np.clip((unit * pick).sum(axis=1), -1, 1)


def mmr_order(relevance: np.ndarray, vectors: np.ndarray, lam: float, k: int, seed_first: bool = False, swap: bool = False) -> list[int]:
    """Greedy maximal marginal relevance. NaN ranks last; ties go to the lower
    position, which under ``swap`` is the position after swap-removals."""
    left, chosen = list(range(len(relevance))), []
    unit = _unit(np.asarray(vectors, dtype=np.float64).reshape(len(relevance), -1))
    closest = np.zeros(len(relevance))
    first = seed_first
    while left and len(chosen) < k:
        if first:
            at, first = 0, False
        else:
            s = lam * relevance[left] - (1 - lam) * np.maximum(closest[left], 0)
            at = int(np.argmax(np.where(np.isnan(s), -np.inf, s)))
        pick = left[at]
        if swap:
            left[at] = left[-1]
            left.pop()
        else:
            left.pop(at)
        chosen.append(pick)
        closest = np.fmax(closest, _cosines(unit, unit[pick]))
    return chosen


def bounded(cands: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` candidates of highest relevance per query."""
    w = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "id")
    return cands.withColumn("pos", F.row_number().over(w) - 1).filter(F.col("pos") < limit)


def _fold(cands: DataFrame, order) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable").reset_index(drop=True)
        picks = order(pdf)
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[picks].to_numpy(), "id": pdf["id"].iloc[picks].to_numpy(), "rank": np.arange(1, len(picks) + 1, dtype=np.int32)})

    kind = dict(cands.dtypes)
    return cands.groupBy("query_id").applyInPandas(run, f"query_id {kind['query_id']}, id {kind['id']}, rank int")


def _rows(column: pd.Series) -> np.ndarray:
    return np.stack(column.map(lambda x: np.asarray(x, dtype=np.float64)).to_list())


def _member(queries: list) -> F.Column:
    found = F.coalesce(F.col("query_id").isin([q for q in queries if q is not None]), F.lit(False))
    return found | F.col("query_id").isNull() if None in queries else found


class _Picks:
    """The picks of one query and, for swap-removal, which candidate (by id) now
    stands at the position of which other one. ``tail`` has the last ids first."""

    def __init__(self, tail: list):
        self.ids, self.units, self.tail, self.at, self.owner = [], [], tail, {}, {}

    def add(self, id_, v: list[float]) -> None:
        if self.tail:
            place, last = self.owner.get(id_, id_), self.tail[len(self.ids)]
            if place != last:
                mover = self.at.get(last, last)
                self.at[place], self.owner[mover] = mover, place
        self.ids.append(id_)
        self.units.append(_unit(np.asarray([v], dtype=np.float64))[0])


def _argmax(rows: DataFrame, picks: dict, lam: float, seed_first: bool, swap: bool) -> DataFrame:
    """(query_id, b) with the next pick of every query of ``picks``: b.id, b.v."""
    kind = dict(rows.dtypes)
    schema = f"query_id {kind['query_id']}, neg double, p0 int, p1 int, p2 double, owner {kind['id']}, id {kind['id']}, v array<double>"
    shared = rows.sparkSession.sparkContext.broadcast(picks)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        for batch in batches:
            queries, ids, raw = (batch.column(i).to_pylist() for i in range(3))
            relevance = np.array([np.nan if x is None else x for x in raw], dtype=np.float64)
            vectors = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1) if ids else None
            of = defaultdict(list)
            for i, q in enumerate(queries):
                of[q].append(i)
            for q, own in of.items():
                state = shared.value[q]
                gone = set(state.ids)
                own = [i for i in own if ids[i] not in gone]
                if not own:
                    continue
                if seed_first and not gone:
                    s = np.zeros(len(own))
                else:
                    unit, closest = _unit(vectors[own]), np.zeros(len(own))
                    for u in state.units:
                        closest = np.fmax(closest, _cosines(unit, u))
                    s = lam * relevance[own] - (1 - lam) * closest
                    s = np.where(np.isnan(s), -np.inf, s)

                def place(i):
                    if swap:
                        return 0, 0, 0.0, state.owner.get(ids[i], ids[i])
                    x = raw[i]
                    return int(x is None), int(x is not None and not math.isnan(x)), 0.0 if x is None or math.isnan(x) else -x, ids[i]

                top = s.max()
                at = min((own[k] for k in np.flatnonzero(s == top)), key=place)
                new = (-float(top), *place(at), ids[at], vectors[at])
                if q not in best or new[:5] < best[q][:5]:
                    best[q] = new
        if best:
            types = pa.schema([("query_id", batch.schema.types[0]), ("neg", pa.float64()), ("p0", pa.int32()), ("p1", pa.int32()), ("p2", pa.float64()),
                               ("owner", batch.schema.types[1]), ("id", batch.schema.types[1]), ("v", pa.list_(pa.float64()))])
            names = types.names
            yield pa.RecordBatch.from_pylist([dict(zip(names, (q, *x[:-1], x[-1].tolist()))) for q, x in best.items()], schema=types)

    found = rows.select("query_id", "id", F.col("relevance").cast("double"), "v").mapInArrow(run, schema)
    return found.groupBy("query_id").agg(F.min(F.struct("neg", "p0", "p1", "p2", "owner", "id", "v")).alias("b"))


def _by_passes(rows: DataFrame, queries: list, lam: float, k: int, seed_first: bool, swap: bool) -> list[tuple]:
    """(query_id, id, rank) of the given queries: k passes over their rows."""
    own = rows.filter(_member(queries))
    tails: dict = {q: [] for q in queries}
    if swap:
        w = Window.partitionBy("query_id").orderBy(F.desc("id"))
        for q, id_ in own.select("query_id", "id").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k).orderBy("n").select("query_id", "id").collect():
            tails[q].append(id_)
    picks = {q: _Picks(tails[q]) for q in queries}
    for _ in range(k):
        found = _argmax(own, picks, lam, seed_first, swap).collect()
        if not found:
            break
        for q, b in found:
            picks[q].add(b["id"], b["v"])
    return [(q, id_, n) for q, p in picks.items() for n, id_ in enumerate(p.ids, 1)]


def _mmr(cands: DataFrame, lam: float, k: int, seed_first: bool, swap: bool) -> DataFrame:
    """MMR over all candidates; an id stands once in a query."""
    rows = _cut(cands.select("query_id", "id", "relevance", "v"))
    large = [r[0] for r in rows.groupBy("query_id").count().filter(F.col("count") > FOLD).collect()]
    order = ["id"] if swap else [F.desc("relevance"), "id"]
    small = rows.filter(~_member(large)).withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)) - 1)
    out = _fold(small, lambda p: mmr_order(p["relevance"].to_numpy(dtype=float), _rows(p["v"]), lam, k, seed_first, swap))
    for at in range(0, len(large), BLOCK):
        picked = _by_passes(rows, large[at : at + BLOCK], lam, k, seed_first, swap)
        out = out.unionByName(rows.sparkSession.createDataFrame(picked, out.schema))
    return out


def mmr_scored(cands: DataFrame, lam: float, k: int, seed_first: bool = False) -> DataFrame:
    """(query_id, id, rank) from (query_id, id, relevance, v)."""
    return _mmr(cands, lam, k, seed_first, swap=False)


def mmr_query(cands: DataFrame, lam: float, k: int) -> DataFrame:
    """As mmr_scored, with relevance the cosine to the query and positions that
    change by swap-removal; candidates come in order of id."""
    return _mmr(cands, lam, k, seed_first=False, swap=True)


def content_dedup(cands: DataFrame) -> DataFrame:
    """Drop later rows of a query with the same non-blank trimmed content. Equal
    contents meet as digests, pre-aggregated, so a common content is no hot key."""
    body = F.regexp_replace("content", r"(?U)^\s+|\s+$", "")
    key = F.sha2(body, 256)
    keyed = cands.withColumn("_key", F.when(body != "", key))
    first = F.min(F.struct((-F.col("relevance")).alias("r"), "id"))
    best = keyed.filter("_key is not null").groupBy("query_id", "_key").agg(first.alias("_b")).select("query_id", F.col("_b.id").alias("id"))
    return cands.join(best.unionByName(keyed.filter("_key is null").select("query_id", "id")), ["query_id", "id"], "left_semi")


def rank_hybrid(cands: DataFrame, lam: float, k: int) -> DataFrame:
    """Dedup by content, keep the best 3k, then MMR with the best one pinned.
    ``cands`` is (query_id, id, relevance, content, v)."""
    near = bounded(content_dedup(cands), 3 * k)
    return _fold(near, lambda p: mmr_order(p["relevance"].to_numpy(dtype=float), _rows(p["v"]), lam, k, seed_first=True))


def displacement_order(scores: list[float], expansion: list[bool], protected: int, margin: float) -> list[int]:
    """Positions after the guard: within the protected ranks an expansion row
    stays only if it beats the next primary by the margin, both positive."""
    n = len(scores)
    order = list(range(n))
    if not n or protected <= 0 or margin <= 1:
        return order
    primaries = [i for i in range(n) if not expansion[i]]
    at = 0
    for rank in range(min(protected, n)):
        while at < len(primaries) and primaries[at] <= rank:
            at += 1
        if not expansion[order[rank]] or at == len(primaries):
            continue
        p = primaries[at]
        mine, other = scores[order[rank]], scores[order[p]]
        if not (mine > 0 and other > 0 and mine >= margin * other):
            order[rank], order[p] = order[p], order[rank]
            at += 1
    return order


def displacement_guard(rows: DataFrame, protected: int, margin: float) -> DataFrame:
    """(query_id, id, rank) from ranked (query_id, id, pos, score, is_expansion);
    pos counts from 0 without gaps. Only the protected ranks and as many primaries
    after them can move; all other rows keep their rank."""
    rank = (F.col("pos") + 1).cast("int")
    if protected <= 0 or margin <= 1:
        return rows.select("query_id", "id", rank.alias("rank"))
    w = Window.partitionBy("query_id").orderBy("pos")
    head = F.col("pos") < protected
    after = rows.filter(~head & ~F.coalesce("is_expansion", F.lit(False))).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= protected)
    kind = dict(rows.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable").reset_index(drop=True)
        order = displacement_order(pdf["score"].tolist(), pdf["is_expansion"].tolist(), protected, margin)
        return pd.DataFrame({"_query": pdf["query_id"], "_pos": pdf["pos"].iloc[order].to_numpy(), "_rank": (pdf["pos"] + 1).astype(np.int32)})

    moving = rows.filter(head).unionByName(after.drop("_n")).select("query_id", "pos", "score", "is_expansion")
    moved = moving.groupBy("query_id").applyInPandas(run, f"_query {kind['query_id']}, _pos {kind['pos']}, _rank int")
    out = rows.join(moved, F.col("query_id").eqNullSafe(F.col("_query")) & (F.col("pos") == F.col("_pos")), "left")
    return out.select("query_id", "id", F.coalesce("_rank", rank).alias("rank"))
