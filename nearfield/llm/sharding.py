"""Sharding along a Hilbert curve over several quantised metadata columns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.storage import global_rank, materialise


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of n points with d coordinates below 2**bits each; d * bits must be below 63.

    Gray-code walk from the most significant bit: undo the rotations and reflections of the enclosing cells, then
    interleave the bits of all coordinates.
    """
    x = np.array(points, dtype=np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            upper = (x[i] & q) != 0
            swap = np.where(upper, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(upper, low, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            index = (index << 1) | ((x[i] >> b) & 1)
    return index


def hilbert_column(dimensions: Sequence[Column], bits: int) -> Column:
    @F.pandas_udf("long")
    def index(*columns: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.column_stack([c.to_numpy() for c in columns]), bits))

    return index(*dimensions)


def category(c: Column, bits: int) -> Column:
    """A cell for each value, spread over the axis by a fixed hash; null has one of its own."""
    return F.pmod(F.xxhash64(F.coalesce(c.cast("string"), F.lit("\0"))), F.lit(1 << bits)).cast("long")


def magnitude(c: Column, bits: int, per_octave: int = 32) -> Column:
    """A cell by logarithm, so that cells hold like ratios; null counts as 0."""
    return F.least(F.floor(F.log2(F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)) + 1) * per_octave), F.lit((1 << bits) - 1)).cast("long")


def hilbert_shards(docs: DataFrame, n_shards: int = 8, bits: int = 10) -> DataFrame:
    """Order documents along the curve over (source, lang, size) and cut the order into n_shards runs.

    Law `rows`: shard counts differ by one at most, whatever the sizes and copies. Rows with one curve index are ordered
    by a hash of doc_id, then doc_id and text checksum, so a hot source or group of copies spreads over many tasks and may
    span several shards. Null texts count as empty; repeated rows each get a slot; an empty table gives no rows; other columns
    are ignored, and missing lang or source columns are taken as null.
    """
    have = {c.lower() for c in docs.columns}
    raw = F.coalesce(F.col("text"), F.lit(""))
    dims = [F.col(c) if c in have else F.lit(None).cast("string") for c in ("source", "lang")]
    size = F.octet_length(raw).cast("long") + 1
    meta = docs.select("doc_id", size.alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"), *[category(c, bits).alias(n) for c, n in zip(dims, ("_a", "_b"), strict=True)])
    meta = meta.withColumn("_h", hilbert_column([F.col("_a"), F.col("_b"), magnitude(F.col("size"), bits)], bits))
    meta = materialise(meta.select("doc_id", "size", "text_crc32", "_h"), "curve")

    ranked = global_rank(meta, ["_h", F.xxhash64("doc_id"), "doc_id", "text_crc32"], "_r")
    total = max(1, meta.count())
    shard = F.expr(f"(_r * {n_shards}L) div {total}L").cast("int")
    first = F.expr(f"(cast(shard as bigint) * {total}L + {n_shards - 1}L) div {n_shards}L")
    return ranked.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_r") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("_h").alias("curve_index")
    )
