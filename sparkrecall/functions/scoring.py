"""Candidate scores: hybrid blend, recency bonus, token-set similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hybrid_score(vector: Column, bm25: Column, length: Column, importance: Column, title: Column,
                 vector_weight: float = 0.7, importance_weight: float = 0.1, title_bonus: float = 0.15, short: int = 40) -> Column:
    """Blend of vector and lexical scores with a penalty for short content."""
    raw = vector * vector_weight + (1.0 / (1.0 + F.abs(bm25))) * (1.0 - vector_weight)
    shrink = F.greatest(F.lit(0.3), length.cast("double") / max(short, 1))
    penalty = F.when(length < short, shrink).otherwise(1.0)
    return raw * penalty + title_bonus * title + importance_weight * importance


_MAX_KEY = "18446744073709551615"


def iso_key(text: Column) -> Column:
    """Sort key of a date text: its first six digit runs, weighted by position,
    saturating at 64 bits. Empty of digits: 0."""
    runs = F.slice(F.regexp_extract_all(text, F.lit("([0-9]+)"), F.lit(1)), 1, 6)
    # a run beyond 20 digits is beyond the limit whatever it holds
    number = lambda r: F.when(F.length(F.regexp_replace(r, "^0+", "")) > 20, F.lit(_MAX_KEY)).otherwise(r).cast("decimal(38,0)")
    limit = F.lit(_MAX_KEY).cast("decimal(38,0)")
    weight = F.array(*[F.lit(str(10**e)).cast("decimal(11,0)") for e in (10, 8, 6, 4, 2, 0)])
    return F.aggregate(
        F.transform(runs, lambda r, i: F.least(limit, (F.least(limit, number(r)).cast("decimal(20,0)") * F.get(weight, i)).cast("decimal(38,0)"))),
        F.lit("0").cast("decimal(38,0)"),
        lambda s, x: F.least(limit, (s + x).cast("decimal(38,0)")),
    )


def recency_bonus(df: DataFrame, group: str, valid_from: str, tie: str, bias: float) -> DataFrame:
    """Add ``bonus``: dated rows of a group ranked from oldest to newest, spread
    evenly over 0 to ``bias``; 0 for undated rows or fewer than two dated ones."""
    if not bias > 0:
        return df.withColumn("bonus", F.lit(0.0))
    dated = F.coalesce(F.col(valid_from) != "", F.lit(False))
    keyed = df.withColumn("_dated", dated).withColumn("_key", F.when(dated, iso_key(F.col(valid_from))))
    w = Window.partitionBy(group, "_dated")
    rank = F.row_number().over(w.orderBy("_key", tie)) - 1
    n = F.count("*").over(w)
    bonus = F.when(F.col("_dated") & (n > 1), bias * rank / F.nullif(n - 1, F.lit(0))).otherwise(0.0)
    return keyed.withColumn("bonus", bonus).drop("_dated", "_key")


def token_set(text: Column) -> Column:
    """Lower-case, anything but letters, digits, space and underscore to space,
    distinct words."""
    clean = F.regexp_replace(F.lower(text), r"[^\p{IsAlphabetic}\p{N}\s_]", " ")
    return F.array_distinct(F.filter(F.split(clean, r"(?U)\s+"), lambda t: t != ""))


def token_jaccard(a: Column, b: Column) -> Column:
    x, y = token_set(a), token_set(b)
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(both / F.nullif(F.size(F.array_union(x, y)), F.lit(0)))
