"""Generic profiling operators: counts, frequency tables, duplicates, summaries.

All of them are aggregates (partial + final) or joins against an aggregate;
none collects a group. Ordering (``arrange``) is applied only to final outputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from donorlens.functions import n_distinct
from donorlens.operators.quantiles import column_counts, column_quantiles, tukey_positions, type7_positions


def count_by(df: DataFrame, *keys: str, name: str = "count") -> DataFrame:
    """``group_by(keys) %>% summarise(count = n())`` -- NA is a group."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def freq(df: DataFrame, col: str, name: str = "count") -> DataFrame:
    """``table(x)`` -- NA is dropped."""
    return df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(name))


def distinct_count_by(df: DataFrame, key: str, value: str, name: str = "count") -> DataFrame:
    """``group_by(key) %>% summarise(n_distinct(value))`` (NA counted as a value)."""
    return df.groupBy(key).agg(n_distinct(value).alias(name))


def duplicate_keys(df: DataFrame, key: str, name: str = "count") -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return count_by(df, key, name=name).filter(F.col(name) > 1)


def duplicate_rows(df: DataFrame, key: str, name: str = "count") -> DataFrame:
    """All rows whose key is duplicated, with the key count (dplyr inner join: NA matches NA).

    Two passes: one over the key column for the counts, one over the rows for
    the join, which is a shuffle join unless Spark knows the key table to be
    small; AQE splits a hot key's partition.
    """
    dups = duplicate_keys(df, key, name).withColumnRenamed(key, "_k")
    j = dups.join(df, dups["_k"].eqNullSafe(df[key]), "inner")
    return j.select(key, name, *[c for c in df.columns if c != key])


def count_if_table(df: DataFrame, conds: dict) -> DataFrame:
    """Several ``nrow(filter(cond))`` in one pass: one row, one column per condition."""
    return df.agg(*[F.count_if(c).alias(n) for n, c in conds.items()])


_SUMMARY = ("min", "q1", "median", "mean", "q3", "max", "n_na")


def summaries(df: DataFrame, columns: dict) -> dict[str, dict]:
    """R ``summary(x)`` of several numeric columns from one pass: ``{name: {min, q1,
    median, mean, q3, max, n_na}}`` (type-7 quartiles; None without any value)."""
    counts = column_counts(df, columns)
    v, c = F.col("v"), F.col("c")
    rows = counts.groupBy("column").agg(
        F.min("v").alias("min"), F.max("v").alias("max"), (F.sum(v * c) / F.sum(F.when(v.isNotNull(), c))).alias("mean"),
        F.coalesce(F.sum(F.when(v.isNotNull(), c)), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(v.isNull(), c)), F.lit(0)).alias("n_na")).collect()  # a row per column
    at = {r["column"]: type7_positions(r["n"], (0.25, 0.5, 0.75)) for r in rows if r["n"]}
    quartiles = column_quantiles(counts, at) if at else {}
    out = {n: dict.fromkeys(_SUMMARY) | {"n_na": 0} for n in columns}
    for r in rows:
        q1, median, q3 = quartiles.get(r["column"], (None,) * 3)
        out[r["column"]] = {"min": r["min"], "q1": q1, "median": median, "mean": r["mean"], "q3": q3,
                            "max": r["max"], "n_na": r["n_na"], "rows": r["n"] + r["n_na"]}
    return out


def summary(df: DataFrame, col: str, where=None) -> DataFrame:
    """R ``summary(x)``: min, q1, median, mean, q3, max (type-7 quartiles) and NA count.

    ``where`` reproduces ``x[cond]``: rows where ``cond`` is false are dropped,
    rows where it is NA stay as NA.
    """
    x = F.col(col).cast("double")
    if where is not None:
        df = df.filter(F.coalesce(where, F.lit(True)))
        x = F.when(where, x)
    got = summaries(df, {col: x})[col]
    return df.sparkSession.createDataFrame([tuple(got[k] for k in _SUMMARY)],
                                           ", ".join(f"{k} {'long' if k == 'n_na' else 'double'}" for k in _SUMMARY))


def box_stats(df: DataFrame, col: str, method: str = "tukey", coef: float = 1.5) -> DataFrame:
    """Box-plot statistics of the non-null values of ``col``, from one pass over the rows.

    ``tukey`` = ``boxplot()`` (hinges of ``fivenum``), ``type7`` = ggplot's
    ``geom_boxplot`` (type-7 quartiles). Whiskers reach the most extreme values
    within ``coef`` x IQR of the box; everything beyond is counted as outlier.
    A column without values gives one row of nulls and two counts of 0.
    """
    vc = column_counts(df, {col: F.col(col)}).filter("v is not null")
    n = vc.agg(F.sum("c")).collect()[0][0] or 0
    if n == 0:
        return df.sparkSession.createDataFrame([(0, None, None, None, None, None, 0)], (
            "n long, lower_whisker double, lower_hinge double, median double, upper_hinge double, upper_whisker double, "
            "n_out long"))
    at = tukey_positions(n)[1:4] if method == "tukey" else type7_positions(n, (0.25, 0.5, 0.75))
    lo, med, hi = column_quantiles(vc, {col: at})[col]
    iqr = hi - lo
    f_lo, f_hi = lo - coef * iqr, hi + coef * iqr
    inside = (F.col("v") >= f_lo) & (F.col("v") <= f_hi)
    return vc.agg(
        F.sum("c").alias("n"),
        F.min(F.when(inside, F.col("v"))).alias("lower_whisker"),
        F.lit(lo).alias("lower_hinge"), F.lit(med).alias("median"), F.lit(hi).alias("upper_hinge"),
        F.max(F.when(inside, F.col("v"))).alias("upper_whisker"),
        F.coalesce(F.sum(F.when(~inside, F.col("c"))), F.lit(0)).alias("n_out"))


_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def table_summary(df: DataFrame) -> DataFrame:
    """R ``summary(data.frame)`` in long form: (column, stat, value, text).

    Numeric columns: Min, 1st Qu., Median, Mean, 3rd Qu., Max, NA's.
    Other columns: Length, Class, Mode. One pass over the table gives the value
    counts of all numeric columns, from which everything else follows.
    """
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]
    got = summaries(df, {c: F.col(f"`{c}`") for c in numeric}) if numeric else {}
    n_rows = next((g["rows"] for g in got.values() if "rows" in g), None)
    if n_rows is None:
        n_rows = df.count()
    names = {"Min.": "min", "1st Qu.": "q1", "Median": "median", "Mean": "mean", "3rd Qu.": "q3", "Max.": "max",
             "NA's": "n_na"}
    out = []
    for c in df.columns:
        if c in got:
            out += [(c, stat, None if got[c][k] is None else float(got[c][k]), None) for stat, k in names.items()]
        else:
            out += [(c, "Length", float(n_rows), None), (c, "Class", None, "character"), (c, "Mode", None, "character")]
    return df.sparkSession.createDataFrame(out, "column string, stat string, value double, text string")


def column_profile(df: DataFrame) -> DataFrame:
    """Schema and fill of a table: (column, position, data_type, non_null, rows), one pass."""
    aggs = [F.count(F.lit(1)).alias("_rows")] + [F.count(F.col(f"`{c}`")).alias(f"_nn{i}")
                                                  for i, c in enumerate(df.columns)]
    one = df.agg(*aggs)
    spark = df.sparkSession
    meta = spark.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
                                 "position int, column string, data_type string")
    nn = one.select("_rows", F.explode(F.array(*[F.struct(F.lit(i).alias("position"),
                                                          F.col(f"_nn{i}").alias("non_null"))
                                                 for i in range(len(df.columns))])).alias("s"))
    nn = nn.select(F.col("s.position").alias("position"), F.col("s.non_null").alias("non_null"),
                   F.col("_rows").alias("rows"))
    return meta.join(nn, "position").select("column", "position", "data_type", "non_null", "rows")
