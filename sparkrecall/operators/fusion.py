"""Rank fusion of lexical and vector result lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rerank import mmr_query


def min_max_normalize(rows: DataFrame) -> DataFrame:
    """Add ``norm``: scores of a (query_id, source) list on 0..1; 1 if all equal."""
    ends = rows.groupBy("query_id", "source").agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    norm = F.when(span > 0, (F.col("score") - F.col("_lo")) / F.nullif(span, F.lit(0.0))).otherwise(1.0)
    return rows.join(ends, ["query_id", "source"]).withColumn("norm", norm).drop("_lo", "_hi")


def fuse(rows: DataFrame, fts_weight: float = 0.5, vector_weight: float = 0.5) -> DataFrame:
    """(query_id, id, score, source): the best weighted contribution of an id,
    not their sum; equal contributions count as fts."""
    known = F.lower("source").isin("fts", "vector")
    source = F.when(known, F.lower("source")).otherwise(F.raise_error(F.lit("source must be fts or vector")))
    rows = min_max_normalize(rows.withColumn("source", source))
    weight = F.when(F.col("source") == "fts", fts_weight).otherwise(vector_weight)
    best = F.max(F.struct((F.col("norm") * weight).alias("score"), (F.col("source") == "fts").alias("fts")))
    out = rows.groupBy("query_id", "id").agg(best.alias("b"))
    return out.select("query_id", "id", F.col("b.score").alias("score"), F.when(F.col("b.fts"), "fts").otherwise("vector").alias("source"))


def fused_ranks(rows: DataFrame, fts_weight: float = 0.5, vector_weight: float = 0.5) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return fuse(rows, fts_weight, vector_weight).withColumn("rank", F.row_number().over(w))


def fuse_then_mmr(rows: DataFrame, vectors: DataFrame, lam: float, k: int, fts_weight: float = 0.5, vector_weight: float = 0.5) -> DataFrame:
    """Fuse, attach vectors (id, v) by key, diversify by relevance to the fused score."""
    cands = fuse(rows, fts_weight, vector_weight).join(vectors, "id").withColumnRenamed("score", "relevance")
    return mmr_query(cands.select("query_id", "id", "relevance", "v"), lam, k)
