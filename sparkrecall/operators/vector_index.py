"""A persisted int8 vector index: build, upsert, remove, search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import is_finite, quantize_int8
from .search import top_k


class VectorIndex:
    """Rows (id, codes, scale) of one dimension; every change is a new snapshot,
    so readers never wait for writers."""

    def __init__(self, dim: int, rows: DataFrame | None = None):
        if dim <= 0:
            raise ValueError("dim must be positive")
        self.dim, self.rows = dim, rows

    def _encoded(self, df: DataFrame) -> DataFrame:
        bad = df.filter((F.size("v") != self.dim) | ~is_finite(F.col("v"))).select("id").limit(5).collect()
        if bad:
            raise ValueError(f"vectors of other length or with non-finite parts: ids {[r[0] for r in bad]}")
        return df.select("id", quantize_int8(F.col("v")).alias("q")).select("id", "q.codes", "q.scale")

    def upsert(self, df: DataFrame, order: str | None = None) -> "VectorIndex":
        """Insert or replace (id, v); the whole batch is checked before any of it
        counts. Of rows with the same id the last by ``order`` wins; without an
        ``order`` there is no last one, and such rows are an error."""
        if order:
            last = df.groupBy("id").agg(F.max_by("v", order).alias("v"))
        else:
            twice = [r[0] for r in df.groupBy("id").count().filter("count > 1").select("id").limit(5).collect()]
            if twice:
                raise ValueError(f"ids that stand twice need an order: {twice}")
            last = df
        new = self._encoded(last)
        if self.rows is None:
            return VectorIndex(self.dim, new)
        return VectorIndex(self.dim, self.rows.join(new.select("id"), "id", "left_anti").unionByName(new))

    def remove(self, ids: DataFrame) -> tuple["VectorIndex", DataFrame]:
        """The index without ``ids``, and a one-row count of those it had."""
        if self.rows is None:
            raise ValueError("the index is empty")
        gone = self.rows.join(ids.select("id").distinct(), "id", "left_semi").agg(F.count("*").alias("removed"))
        return VectorIndex(self.dim, self.rows.join(ids.select("id"), "id", "left_anti")), gone

    def search(self, queries: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
        """Approximate top k; ``allowed`` restricts the ids, unknown ones are ignored."""
        rows = self.rows if allowed is None else self.rows.join(allowed.select("id").distinct(), "id", "left_semi")
        return top_k(rows, queries, k, codes=True)

    def two_stage(self, vectors: DataFrame, queries: DataFrame, k: int, candidates: int) -> DataFrame:
        """Approximate candidates, then exact cosine of those only."""
        from pyspark.sql import Window

        from ..functions.vectors import cosine

        found = self.search(queries, candidates).select("query_id", "id")
        q = queries.select(F.col("id").alias("query_id"), F.col("v").alias("qv"))
        exact = found.join(vectors.select("id", "v"), "id").join(q, "query_id")
        exact = exact.select("query_id", "id", cosine(F.col("qv"), F.col("v")).alias("score"))
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return exact.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    def save(self, path: str) -> str:
        """Write a new version below ``path``; readers of older ones go on."""
        import time

        version = f"{path}/v{time.time_ns():020d}"
        self.rows.write.parquet(version)
        return version

    @classmethod
    def load(cls, spark, path: str, dim: int) -> "VectorIndex":
        """The newest complete version below ``path``."""
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        done = [str(s.getPath()) for s in fs.listStatus(p) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{s.getPath()}/_SUCCESS"))]
        if not done:
            raise FileNotFoundError(f"no index below {path}")
        return cls(dim, spark.read.parquet(max(done)))

    def count(self) -> int:
        return 0 if self.rows is None else self.rows.count()

    def contains(self, key: int) -> bool:
        return self.rows is not None and not self.rows.filter(F.col("id") == key).isEmpty()

    def nbytes(self) -> int:
        """One byte a code and four for the scale."""
        return self.count() * (self.dim + 4)
