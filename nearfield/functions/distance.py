"""Distances as column expressions and as matrices; smaller is nearer in both, and sums are in double precision."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def squared_norm(a: Column) -> Column:
    return dot(a, a)


def norm(a: Column) -> Column:
    return F.sqrt(squared_norm(a))


def l2(a: Column, b: Column) -> Column:
    """Sum of squared differences, without the root."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def inner_product(a: Column, b: Column) -> Column:
    """Negated, so that a larger product is nearer."""
    return -dot(a, b)


def cosine(a: Column, b: Column) -> Column:
    """1 - cos; a zero vector is at distance 1 from everything."""
    scale = F.sqrt(squared_norm(a) * squared_norm(b))
    return F.lit(1.0) - F.when(scale > 0, dot(a, b) / scale).otherwise(F.lit(0.0))


def cosine_normalised(a: Column, b: Column) -> Column:
    """1 - cos for vectors that already have length 1."""
    return F.lit(1.0) - dot(a, b)


def fast_l2(a: Column, b: Column, norm2: Column | None = None) -> Column:
    """Squared norm of a less twice the product: ranks as l2 does, less by the other vector's squared norm. norm2 can be a stored column."""
    return (squared_norm(a) if norm2 is None else norm2) - 2 * dot(a, b)


EXPRESSIONS: dict[str, Callable[[Column, Column], Column]] = {"l2": l2, "mips": inner_product, "cosine": cosine, "fast_l2": fast_l2}


def distance(metric: str, a: Column, b: Column) -> Column:
    return EXPRESSIONS[metric](a, b)


def shown(metric: str, d: Column) -> Column:
    """The distance as results show it: the product itself for mips."""
    return -d if metric == "mips" else d


def matrix(metric: str, base: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Distances of every query (rows) to every base vector (columns), by matrix products; good to rounding."""
    products = queries @ base.T
    if metric == "mips":
        return -products
    bb = np.einsum("ij,ij->i", base, base)
    if metric == "fast_l2":
        return bb[None, :] - 2 * products
    qq = np.einsum("ij,ij->i", queries, queries)
    if metric == "cosine":
        scale = np.sqrt(qq[:, None] * bb[None, :])
        return 1 - np.divide(products, scale, out=np.zeros_like(products), where=scale > 0)
    return np.maximum(qq[:, None] + bb[None, :] - 2 * products, 0)


def pairwise(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of row pairs, in the order of terms that the column expressions have; a plays the query."""
    if metric == "l2":
        return ((a - b) ** 2).sum(axis=1)
    products = (a * b).sum(axis=1)
    if metric == "mips":
        return -products
    if metric == "fast_l2":
        return (b * b).sum(axis=1) - 2 * products
    scale = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
    return 1 - np.divide(products, scale, out=np.zeros_like(products), where=scale > 0)


def rounding(metric: str, base: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """How far `matrix` may be off for each query."""
    if metric == "cosine":
        return np.full(len(queries), 1e-12)
    largest = float(np.einsum("ij,ij->i", base, base).max(initial=0.0))
    return 1e-12 * (largest + np.einsum("ij,ij->i", queries, queries) + 1)
