"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from donorlens.session import staged  # noqa: F401  (used by every operator)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(col):
    """Lower-case A-Z only; all other characters stay."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(col):
    """Number of words ``[^\\x20\\x09-\\x0D]+`` of a text (null: 0)."""
    return F.coalesce(F.regexp_count(col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranged(df: DataFrame, order: list, *sums) -> tuple[DataFrame, list]:
    """``df`` dealt by range in the given total order and written with a ``_id`` whose upper part
    numbers the ranges and whose lower 33 bits number the rows of a range; and for each
    range its first row's position and the aggregates ``sums`` (a row per range)."""
    parts = shuffle_partitions(df.sparkSession)
    out = staged(df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                 .withColumn("_id", F.monotonically_increasing_id()), "ranged")
    each = out.groupBy(F.shiftright("_id", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_n"), *sums).collect()
    starts, at = [], 0
    for r in sorted(each):
        starts.append((r["_part"], at, *r[1:]))
        at += r["_n"]
    return out, starts


def position(df: DataFrame, starts: list, name: str = "rank") -> DataFrame:
    """The rows of ``ranged`` with their 0-based positions."""
    table = df.sparkSession.createDataFrame([s[:2] for s in starts], "_part long, _start long")
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_start")
    return (df.join(F.broadcast(table), F.shiftright("_id", 33) == F.col("_part"))  # a row per range
            .withColumn(name, place).drop("_id", "_part", "_start"))


def global_rank(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Add the 0-based position of each row in the given total order.

    The rows are dealt by range, numbered inside each range in sorted order and
    shifted by the ranges' row counts: no task sees more than its own range.
    """
    return position(*ranged(df, order), name)
