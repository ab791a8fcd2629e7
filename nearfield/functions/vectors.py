"""Functions of one vector column: normalising, the inner-product transforms, conversions and encodings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions.distance import norm, squared_norm


def normalise(v: Column, epsilon: float = 0.0) -> Column:
    """v over its length, or over sqrt(epsilon + squared length) as files are normalised; a zero vector stays zero."""
    length = F.sqrt(squared_norm(v) + F.lit(float(epsilon)))
    return F.when(length > 0, F.transform(v, lambda x: x.cast("double") / length)).otherwise(F.transform(v, lambda x: x.cast("double")))


def max_norm(vectors: DataFrame, column: str = "vec") -> float:
    """The largest length in the table; 0 for an empty one."""
    return float(vectors.agg(F.max(norm(F.col(column)))).first()[0] or 0.0)


def mips_base(v: Column, largest: float) -> Column:
    """v over the largest norm with one more coordinate that makes its length 1: l2 then ranks as the inner product did."""
    if largest <= 0:
        return F.concat(F.transform(v, lambda x: x.cast("double")), F.array(F.lit(1.0)))
    rest = F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - squared_norm(v) / (largest * largest)))
    return F.concat(F.transform(v, lambda x: x.cast("double") / largest), F.array(rest))


def mips_query(v: Column) -> Column:
    return F.concat(normalise(v), F.array(F.lit(0.0)))


def to_float(v: Column) -> Column:
    return v.cast("array<float>")


def to_int8(v: Column, bias: float = 0.0, scale: float = 254.0) -> Column:
    """(x - bias) * 254 / scale, truncated toward zero and held within a signed byte."""
    return F.transform(v, lambda x: F.greatest(F.lit(-128.0), F.least(F.lit(127.0), (x.cast("double") - bias) * 254.0 / scale)).cast("tinyint"))


def from_int8(v: Column, bias: float = 0.0, scale: float = 1.0) -> Column:
    return F.transform(v, lambda x: ((x.cast("double") - bias) * scale).cast("float"))


def to_uint8(v: Column) -> Column:
    """Values from 0 to 255 in smallints; others raise."""
    return F.transform(v, lambda x: F.when((x >= 0) & (x <= 255), x.cast("smallint")).otherwise(F.raise_error(F.concat(F.lit("not a byte: "), x.cast("string"))).cast("smallint")))


def _per_row(v: Column, kind: str, f) -> Column:
    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if x is None else f(np.asarray(x, dtype=np.float32)) for x in batch], dtype=object)

    return run(v)


def to_half(v: Column) -> Column:
    """Rounded to 16-bit floats, held as floats."""
    return _per_row(v, "array<float>", lambda x: x.astype(np.float16).astype(np.float32))


def to_bfloat16(v: Column) -> Column:
    """Rounded to bfloat16 (nearest, ties to even), held as floats."""

    def cut(x: np.ndarray) -> np.ndarray:
        bits = x.view(np.uint32).astype(np.uint64)
        rounded = ((bits + 0x7FFF + ((bits >> 16) & 1)) & 0xFFFF0000).astype(np.uint32).view(np.float32)
        return np.where(np.isfinite(x), rounded, x)

    return _per_row(v, "array<float>", cut)


def to_base64(v: Column, dims: int | None = None) -> Column:
    """Base64 of the little-endian floats, of the first dims coordinates if given."""
    return F.base64(_per_row(v, "binary", lambda x: x[:dims].astype("<f4").tobytes()))


def rotate(v: Column, rotation: np.ndarray, transpose: bool = False) -> Column:
    """v times a square matrix given by the caller, or times its transpose."""
    m = np.asarray(rotation, dtype=np.float64)
    m = m.T if transpose else m
    if m.ndim != 2 or m.shape[0] != m.shape[1]:
        raise ValueError(f"a rotation must be a square matrix, not {m.shape}")

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(np.stack(batch.to_numpy()).astype(np.float64) @ m)) if len(batch) else pd.Series([], dtype=object)

    return run(v)


def residual(v: Column, centre: Column, add: bool = False) -> Column:
    """Difference to a centre, or its reversal."""
    return F.zip_with(v, centre, lambda x, y: x.cast("double") + y.cast("double") if add else x.cast("double") - y.cast("double"))
