"""Exact order statistics and quantiles as distributed jobs.

Spark's exact ``percentile`` aggregate keeps every distinct value of a group in
one task's memory, which does not hold for a global quantile over billions of
rows. Here the k-th smallest value is found without any single task seeing the
whole column, and for several columns in one pass over the rows:

1. ``groupBy(column, value).count()``: distinct values with multiplicities (a hot
   value collapses to one row, partial aggregation on the map side); written
   once, everything below reads it;
2. the distinct values are range-partitioned (Spark samples the bounds, they
   never become part of an expression) and tagged with their partition number;
3. per-partition totals give each partition's offset;
4. inside each partition a running sum gives every distinct value its rank
   interval; the requested ranks are matched against those intervals.

Only the handful of requested order statistics come back to the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from donorlens.session import materialize


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Distinct non-null values of ``col`` with their counts (``v``, ``c``)."""
    return (df.select(F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull())
            .groupBy("v").agg(F.count(F.lit(1)).alias("c")))


def column_counts(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``(column, v, c)``: the distinct values of several numeric columns with their
    counts, NULL included, from one pass over ``df``; written once."""
    each = F.array(*[F.struct(F.lit(n).alias("column"), x.cast("double").alias("v")) for n, x in columns.items()])
    long = df.select(F.explode(each).alias("e")).select("e.column", "e.v")
    return materialize(long.groupBy("column", "v").agg(F.count(F.lit(1)).alias("c")))


def ordered_prefix_sums(vc: DataFrame, key: str, cols: list[str], buckets: int | None = None,
                        by: tuple = ()) -> DataFrame:
    """Add ``<c>_before`` = sum of ``c`` over all rows with a smaller ``key`` (and equal ``by``).

    ``vc`` must have distinct ``(by, key)`` values (e.g. a ``groupBy(key)`` result).
    The rows are range-partitioned; partition totals (one row per partition and
    ``by`` value) give offsets, and a running sum runs inside each partition only.
    """
    by = list(by)
    parts = buckets or int(vc.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(vc.repartitionByRange(parts, *by, key).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    # offsets over at most `parts` rows of each `by` value
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_part", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}")
                                            for c in cols])
    w = Window.partitionBy(*by, "_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(offsets, [*by, "_part"])
    for c in cols:
        out = out.withColumn(f"{c}_before", F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(w), F.lit(0)))
    return out.drop("_part", *[f"_o_{c}" for c in cols])


def column_order_statistics(counts: DataFrame, ranks: dict[str, set[int]], buckets: int | None = None) -> dict:
    """``{column: {rank: value}}`` at the 1-based ranks of each column of a ``(column, v, c)`` table."""
    wanted = [(c, int(r)) for c, rs in ranks.items() for r in sorted(set(rs))]
    if not wanted:
        return {}
    cum = ordered_prefix_sums(counts.filter("v is not null"), "v", ["c"], buckets, by=("column",))
    spark = counts.sparkSession
    want = spark.createDataFrame(wanted, "column string, rank long")  # a few ranks for each column
    hits = cum.join(F.broadcast(want), "column").filter("rank > c_before and rank <= c_before + c")
    out: dict = {}
    for h in hits.select("column", "rank", "v").collect():
        out.setdefault(h["column"], {})[h["rank"]] = h["v"]
    return out


def order_statistics(df: DataFrame, col: str, ranks: list[int], buckets: int | None = None,
                     vc: DataFrame | None = None) -> dict[int, float]:
    """Values at the given 1-based ranks of the sorted non-null ``col``."""
    vc = vc if vc is not None else value_counts(df, col)
    counts = vc.select(F.lit("x").alias("column"), "v", "c")
    return column_order_statistics(counts, {"x": set(ranks)}, buckets).get("x", {})


def _interp(stats: dict, h: float) -> float:
    lo, hi = math.floor(h), math.ceil(h)
    return stats[lo] + (h - lo) * (stats[hi] - stats[lo])


def type7_positions(n: int, probs) -> list[float]:
    """1-based positions of R's default (type 7) quantiles."""
    return [1 + (n - 1) * p for p in probs]


def tukey_positions(n: int) -> list[float]:
    """1-based positions of ``fivenum`` (min, lower hinge, median, upper hinge, max)."""
    n4 = math.floor((n + 3) / 2) / 2
    return [1, n4, (n + 1) / 2, n + 1 - n4, n]


def column_quantiles(counts: DataFrame, positions: dict[str, list[float]], buckets: int | None = None) -> dict:
    """``{column: [values]}``: linear interpolation between order statistics at 1-based positions."""
    ranks = {c: {r for h in hs for r in (math.floor(h), math.ceil(h))} for c, hs in positions.items()}
    stats = column_order_statistics(counts, ranks, buckets)
    return {c: [_interp(stats[c], h) for h in hs] for c, hs in positions.items()}


def quantiles_at(df: DataFrame, col: str, positions: list[float], vc: DataFrame | None = None) -> list[float]:
    """Linear interpolation between order statistics at 1-based ``positions``."""
    vc = vc if vc is not None else value_counts(df, col)
    return column_quantiles(vc.select(F.lit("x").alias("column"), "v", "c"), {"x": positions})["x"]
