"""Seeded, partition-independent sampling.

All randomness is a hash of (key, seed): ``u01 = int(md5(key|seed)[0:13], 16) / 2^52``.
The same expression exists in DuckDB, so samples can be checked by an
independent engine, and results do not depend on partitioning or retries
(a re-executed task after an executor loss draws the same numbers).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HASH_BITS = 52
TWO52 = float(1 << HASH_BITS)


def hash52(key, seed) -> F.Column:
    """52-bit unsigned hash of ``key|seed`` (first 13 hex digits of md5) as bigint.

    52 bits are exact in a double, and fine enough that every one of 10^12
    rows can be drawn.
    """
    k = key if isinstance(key, F.Column) else F.col(key)
    # a NULL key hashes like a fixed token, so such rows are never lost
    k = F.coalesce(k.cast("string"), F.lit("\u0000NA"))
    s = F.concat(k, F.lit("|"), seed if isinstance(seed, F.Column) else F.lit(str(seed)))
    return F.conv(F.substring(F.md5(s), 1, 13), 16, 10).cast("long")


def u01(key, seed) -> F.Column:
    """Uniform number in [0, 1) from ``key`` and ``seed``."""
    return hash52(key, seed) / F.lit(TWO52)


def _boundary(counts: list[tuple[int, int]], k: int) -> tuple[int, int]:
    """(bucket holding the k-th row, rows before that bucket)."""
    before = 0
    for b, c in counts:
        if before + c >= k:
            return b, before
        before += c
    return counts[-1][0] + 1, before


def exact_split(df: DataFrame, key: str, fraction: float = 0.7, seed: int = 1287,
                rows_per_boundary_bucket: int = 500_000) -> tuple[DataFrame, DataFrame]:
    """Exact-size split without replacement: the ``floor(fraction * n)`` rows with the
    smallest ``(hash52(key, seed), key)`` form the first part, the rest the second.

    Exact at any size without a global sort: rows are counted per hash-prefix
    bucket (a few thousand numbers reach the driver, at most 2^20), and only the
    bucket that holds the boundary is ranked, to find the last row of the first
    part. Both parts are then one comparison with that row. ``key`` must be
    unique for the size to be exact; a NULL key comes first among equal hashes.
    """
    h = hash52(F.col(key), seed)
    n = df.count()
    k = math.floor(fraction * n)
    if k <= 0:
        return df.limit(0), df
    nb = min(1 << 20, max(1024, 1 << max(0, math.ceil(math.log2(max(1, n / rows_per_boundary_bucket))))))
    bucket = F.shiftright(h, HASH_BITS - int(math.log2(nb)))
    counts = sorted((r["_b"], r["c"]) for r in df.groupBy(bucket.alias("_b")).agg(
        F.count(F.lit(1)).alias("c")).collect())
    b_star, before = _boundary(counts, k)
    edge = (df.filter(bucket == b_star).select(h.alias("_h"), F.col(key).alias("_k"))
              .withColumn("_rn", F.row_number().over(Window.orderBy("_h", F.col("_k").asc_nulls_first()))))
    last = edge.filter(F.col("_rn") == k - before).first()
    tied = F.col(key).isNull() if last["_k"] is None else F.col(key).isNull() | (F.col(key) <= F.lit(last["_k"]))
    first = (h < F.lit(last["_h"])) | ((h == F.lit(last["_h"])) & tied)
    return df.filter(first), df.filter(~first)


def sample_with_replacement(df: DataFrame, size: int, seed: int, key: str,
                            rows_per_bucket: int = 1_000_000) -> DataFrame:
    """``size`` draws with replacement, every row equally likely (like R ``sample(replace=TRUE)``).

    Rows get a dense global index 0..n-1 without a global window: a random
    bucket per row, per-bucket counts (small) give offsets, and a row number
    inside each bucket. Draw ``t`` (0 <= t < size) picks index
    ``floor(u01(t, seed) * n)``; draws are joined to rows on that index.
    """
    spark = df.sparkSession
    n = df.count()
    if n == 0 or size <= 0:
        return df.limit(0)
    nb = max(1, math.ceil(n / rows_per_bucket))
    d = df.withColumn("_u", u01(F.col(key), f"{seed}:order")).withColumn(
        "_b", F.floor(F.col("_u") * nb).cast("int"))
    counts = sorted((r["_b"], r["c"]) for r in d.groupBy("_b").agg(F.count(F.lit(1)).alias("c")).collect())
    offs, acc = [], 0
    for b, c in counts:
        offs.append((b, acc))
        acc += c
    off_df = F.broadcast(spark.createDataFrame(offs, "_b int, _off long"))
    w = Window.partitionBy("_b").orderBy("_u", key)
    indexed = (d.join(off_df, "_b").withColumn("_idx", F.col("_off") + F.row_number().over(w) - 1)
                .drop("_u", "_b", "_off"))
    draws = (spark.range(size).select(
        F.floor(u01(F.col("id"), f"{seed}:draw") * F.lit(n)).cast("long").alias("_idx"),
        F.col("id").alias("_draw")))
    return draws.join(indexed, "_idx").drop("_idx")
