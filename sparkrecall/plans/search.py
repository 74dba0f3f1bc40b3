"""Hybrid retrieval end to end: lexical and vector candidates, fused, reranked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.bm25 import bm25_top_k
from ..operators.fusion import fuse
from ..operators.graph import _cut
from ..operators.rerank import rank_hybrid
from ..operators.search import top_k


def hybrid_search(docs: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 10, lam: float = 0.7,
                  candidates: int = 100, fts_weight: float = 0.5, vector_weight: float = 0.5) -> DataFrame:
    """(query_id, id, rank) of ``docs`` (id, text) and ``vectors`` (id, v) for
    ``queries`` (id, text, v)."""
    lexical = bm25_top_k(docs, queries.select("id", "text"), candidates).select("query_id", "id", "score", F.lit("fts").alias("source"))
    near = top_k(vectors, queries.select("id", "v"), candidates).select("query_id", "id", "score", F.lit("vector").alias("source"))
    # scored once: fusion and dedup read the lists several times
    fused = _cut(fuse(_cut(lexical.unionByName(near)), fts_weight, vector_weight))
    # equal texts have equal digests, which alone are moved; blank ones stay blank
    body = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    digests = docs.select("id", F.when(body != "", F.sha2(body, 256)).otherwise("").alias("content"))
    cands = fused.join(digests, "id").join(vectors, "id")
    cands = cands.select("query_id", "id", F.col("score").alias("relevance"), "content", "v")
    return rank_hybrid(cands, lam, k)
