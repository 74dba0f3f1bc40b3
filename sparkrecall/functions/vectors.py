"""Vector columns: codecs, norms, cosine, int8 quantisation (Column expressions;
Arrow only for packing floats, which has no built-in)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, FloatType


@pandas_udf(ArrayType(FloatType()))
def blob_as_f32(blob: pd.Series) -> pd.Series:
    """Little-endian float32 bytes to floats; a trailing partial float is ignored."""
    return blob.map(lambda b: None if b is None else np.frombuffer(b, "<f4", count=len(b) // 4))


@pandas_udf(BinaryType())
def f32_as_blob(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None else np.asarray(x, dtype="<f4").tobytes())


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Dot over norms, 0 for a zero vector, clamped to [-1, 1]; vectors of
    different lengths are an error."""
    size = norm(a) * norm(b)
    value = F.when(size == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.nullif(size, F.lit(0.0)))))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vector dimensions differ"))).otherwise(value)


def l2_normalize(v: Column) -> Column:
    n = norm(v)
    return F.when(n == 0, _doubles(v)).otherwise(F.transform(_doubles(v), lambda x: x / F.nullif(n, F.lit(0.0))))


def quantize_int8(v: Column) -> Column:
    """struct(codes, scale): code * scale approximates the unit vector."""
    peak = F.aggregate(_doubles(v), F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))
    size = norm(v)
    codes = F.transform(
        _doubles(v), lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x * 127 / F.nullif(peak, F.lit(0.0))).cast("int"))).cast("tinyint")
    )
    zeros = F.transform(v, lambda x: F.lit(0).cast("tinyint"))
    return F.when(size == 0, F.struct(zeros.alias("codes"), F.lit(0.0).alias("scale"))).otherwise(
        F.struct(codes.alias("codes"), (peak / F.nullif(size, F.lit(0.0)) / 127).alias("scale"))
    )


def is_finite(v: Column) -> Column:
    return ~F.exists(_doubles(v), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
