"""Delimited-text scan and sink with R ``write.table`` conventions.

``write.table(df, path, row.names = FALSE)`` writes a header, separates fields
with one space, puts text in double quotes (embedded quotes escaped with a
backslash) and writes missing values as an unquoted ``NA``. Numbers are not
quoted. Parquet stays the default sink of the package; this format exists so
that tables can be exchanged with the R workflow.

A row is always one line, so files stay splittable: a line break inside a text is
written as ``\\n`` or ``\\r`` and a backslash as two (R's own reader shows those
escapes as they stand). The quoted text ``NA`` stays text.
"""

from __future__ import annotations

import csv
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from donorlens.session import checkpoint_dir, delete_at_exit

_TEXT = (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)


#: characters that would end a line, a field or the reader's column, and how they are written inside a text
_ESCAPES = (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\x00", "\\0"), ("\x01", "\\1"))
#: a quoted text or a bare field; possessive, so a text of any length is matched without going back or deeper
_FIELD = r'"(?:[^"\\]++|\\.)*+"|[^" ]++'


def _escaped(text: Column) -> Column:
    for plain, safe in (("\\", "\\\\"), *_ESCAPES):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def _unescaped(text: Column) -> Column:
    def part(p: Column) -> Column:
        for plain, safe in _ESCAPES:
            p = F.replace(p, F.lit(safe), F.lit(plain))
        return p

    # cut at double backslashes first, so an escape is never read across one
    return F.array_join(F.transform(F.split(text, r"\\\\"), part), "\\")


def _field(name: str, dtype) -> Column:
    col = F.col(f"`{name}`")
    text = col.cast("string")
    if isinstance(dtype, _TEXT):
        text = F.concat(F.lit('"'), _escaped(text), F.lit('"'))
    return F.coalesce(text, F.lit("NA"))


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write ``df`` like R ``write.table(df, path, row.names = FALSE)`` (one folder of
    part files, each with the header line, however many files a task writes)."""
    fields = df.schema.fields
    line = F.concat_ws(" ", *[_field(f.name, f.dataType) for f in fields])
    header = " ".join('"' + f.name.replace('"', '\\"') + '"' for f in fields)
    # a CSV of one column, whose name is the header line: Spark's writer puts it into every file
    (df.select(line.alias(header)).write.mode(mode).option("header", True).option("sep", "\x01").option("quote", "")
     .option("escape", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read a table written by :func:`write_table` with an explicit schema.

    ``fread`` infers types; at scale an explicit schema avoids a full
    inference pass. Columns are matched by position. Lines are split into
    quoted texts and bare fields; only a bare ``NA`` is missing.
    """
    # one raw line per row; the reader skips each file's header line
    lines = (spark.read.schema("line string").option("header", True).option("enforceSchema", True)
             .option("sep", "\x01").option("quote", "").option("escape", "")
             .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    parts = F.regexp_extract_all("line", F.lit(_FIELD), F.lit(0))
    rows = lines.select(parts.alias("f"))
    columns = []
    for i, f in enumerate(schema.fields):
        raw = F.get("f", F.lit(i))
        text = F.when(raw.startswith('"'), _unescaped(F.substring(raw, F.lit(2), F.length(raw) - 2))).otherwise(raw)
        columns.append(F.when(raw != "NA", text).cast(f.dataType).alias(f.name))
    return rows.select(*columns)


# separators tried when none is given, in order of preference on ties
SEPARATORS = (",", "\t", "|", ";", " ")


def detect_separator(spark: SparkSession, path: str, n_columns: int) -> str:
    """``fread``-style separator detection from the header line only.

    Picks the candidate that splits the header into ``n_columns`` fields (the
    schema is explicit), else the most frequent candidate. Reads one line.
    """
    first = spark.read.text(path).limit(1).collect()
    if not first:
        return ","
    head = first[0][0]
    for sep in SEPARATORS:
        if len(head.split(sep)) == n_columns:
            return sep
    return max(SEPARATORS, key=head.count)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str | None = None,
             null_value: str = "NA") -> DataFrame:
    """CSV scan with header and an explicit schema (``fread``); ``sep=None`` detects it."""
    sep = sep or detect_separator(spark, path, len(schema.fields))
    return (spark.read.option("header", True).option("sep", sep).option("nullValue", null_value)
            .option("quote", '"').schema(schema).csv(path))


# ---- inferred types ------------------------------------------------------------

#: what a value can be, each with the types that also hold it, narrowest first (fixed order)
_HELD_BY = {
    "logical": ("boolean", "string"),
    "int": ("int", "bigint", "double", "string"),
    "int64": ("bigint", "double", "string"),
    "double": ("double", "string"),
    "date": ("date", "string"),
    "text": ("string",),
}
_LOGICAL = ("TRUE", "FALSE", "True", "False", "true", "false")
_WHOLE = r"^[+-]?[0-9]++$"
_DECIMAL = r"^[+-]?(?:[0-9]++\.?[0-9]*+|\.[0-9]++)(?:[eE][+-]?[0-9]++)?$|^NaN$|^[+-]?Inf$"
_ISO_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def value_class(value: Column, na_strings: tuple = ("NA",)) -> Column:
    """The narrowest class of a raw CSV value; null for a missing one (null, blank or one of ``na_strings``)."""
    whole = F.when(value.rlike(_WHOLE), value.try_cast("bigint"))
    return (F.when(value.isNull() | (F.trim(value) == "") | value.isin(*na_strings), F.lit(None).cast("string"))
            .when(value.isin(*_LOGICAL), "logical")
            .when(whole.isNotNull() & (F.abs(whole.cast("decimal(20,0)")) < 1 << 31), "int")
            .when(whole.isNotNull(), "int64").when(value.rlike(_DECIMAL), "double")
            .when(value.rlike(_ISO_DATE) & F.try_to_date(value, "yyyy-MM-dd").isNotNull(), "date").otherwise("text"))


def headers(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line)``: the first line of every file."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value",
                                         F.col("_metadata.file_block_start").alias("start"),
                                         F.monotonically_increasing_id().alias("id"))
    return lines.filter("start = 0").groupBy("file").agg(F.min_by("value", "id").alias("line"))


def vote_separator(spark: SparkSession, path: str) -> tuple[str, list[str]]:
    """The separator that most files' headers are cut into most fields by, and the column names.

    Files without the same header are an error; a folder without files or lines has no columns.
    """
    bare = F.regexp_replace("line", '"[^"]*+"', "")
    most = F.greatest(*[F.struct(F.regexp_count(bare, F.lit("\\Q" + s + "\\E")).alias("fields"), F.lit(-k).alias("k"))
                        for k, s in enumerate(SEPARATORS)])
    got = headers(spark, path).groupBy("line").agg(F.count(F.lit(1)).alias("files"), F.min("file").alias("file"),
                                                   F.first(-most["k"]).alias("k")).limit(2).collect()
    if not got:
        return ",", []
    if len(got) > 1:
        raise ValueError(f"different headers in {got[0]['file']} and {got[1]['file']}")
    sep = SEPARATORS[got[0]["k"]]
    return sep, next(csv.reader([got[0]["line"]], delimiter=sep), [])


def class_counts(each: DataFrame, na_strings: tuple = ("NA",)) -> DataFrame:
    """``each(place, position, v)`` -> ``(position, class, n, first, none)``: a column's values of each class and the first of them.

    The smallest of texts alone would be found by sorting all values, which spills;
    with a collecting aggregate beside it (``none``: of nothing), tasks keep a row per group in memory.
    """
    return each.groupBy("position", value_class(F.col("v"), na_strings).alias("class")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("place", "v")).alias("first"),
        F.collect_set(F.lit(None).cast("int")).alias("none"))


def infer_schema(spark: SparkSession, path: str, sep: str | None = None,
                 na_strings: tuple = ("NA",)) -> tuple[T.StructType, DataFrame]:
    """The types of a CSV table from all of its values (``fread``), and how they came about.

    A column gets the narrowest type that holds each of its values: logical, int,
    int64, double, ISO date, else text; a column without values is logical. One pass
    over all rows counts the classes per column (they merge, so partial results of any
    size do), so a surprise in the last row counts like one in the first. The
    report ``(column, position, data_type, n_values, n_na, common_class, n_other,
    first_other, first_other_file)`` tells how many values are of another class than
    most of the column's, and the first of them.
    """
    voted, names = vote_separator(spark, path)
    sep = sep or voted
    if len(set(names)) < len(names):
        raise ValueError(f"column names repeat: {names}")
    raw = spark.read.option("header", True).option("sep", sep).option("quote", '"').schema(
        T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(path) if names else spark.range(0)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("id"))
    each = raw.select(place.alias("place"), F.posexplode(F.array(*[F.col(f"`{n}`") for n in names])).alias("position", "v")) \
        if names else spark.createDataFrame([], "place struct<file:string,id:bigint>, position int, v string")
    counts = class_counts(each, na_strings).collect()  # a few rows per column
    fields, report = [], []
    for i, name in enumerate(names):
        own = {r["class"]: r for r in counts if r["position"] == i}
        na = own.pop(None, None)
        held = [t for t in ("boolean", "int", "bigint", "double", "date", "string") if all(t in _HELD_BY[c] for c in own)]
        kind = held[0] if own else "boolean"
        common = max(own, key=lambda c: (own[c]["n"], -list(_HELD_BY).index(c)), default=None)
        others = sorted((r["first"] for c, r in own.items() if c != common), key=lambda f: tuple(f["place"]))
        n = sum(r["n"] for r in own.values())
        fields.append(T.StructField(name, T._parse_datatype_string(kind)))
        report.append((name, i, kind, n, na["n"] if na else 0, common, n - own[common]["n"] if own else 0,
                       others[0]["v"] if others else None, others[0]["place"]["file"] if others else None))
    return T.StructType(fields), spark.createDataFrame(
        report, "column string, position int, data_type string, n_values long, n_na long, common_class string, "
                "n_other long, first_other string, first_other_file string")


def read_inferred(spark: SparkSession, path: str, sep: str | None = None, na_strings: tuple = ("NA",)) -> DataFrame:
    """``fread(path)``: separator, names and types from the files, then one scan with that schema."""
    schema, _ = infer_schema(spark, path, sep, na_strings)
    raw = spark.read.option("header", True).option("sep", sep or vote_separator(spark, path)[0]).option("quote", '"').schema(
        T.StructType([T.StructField(f.name, T.StringType()) for f in schema])).csv(path)
    columns = []
    for f in schema.fields:
        v = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            number = F.when(v.isin("Inf", "+Inf"), F.lit(float("inf"))).when(v == "-Inf", F.lit(float("-inf"))).otherwise(
                v.try_cast("double"))
        elif isinstance(f.dataType, T.StringType):
            number = F.coalesce(v, F.lit(""))  # a blank is missing in a typed column, an empty text in a text column
        else:
            number = v.try_cast(f.dataType)
        columns.append(F.when(~F.coalesce(v, F.lit("")).isin(*na_strings), number).alias(f.name))
    return raw.select(*columns)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder, deleted when the driver ends."""
    base = checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/donorlens-{uuid.uuid4().hex[:12]}/{name}"
    delete_at_exit(spark, path)
    return path


def roundtrip(spark: SparkSession, df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` in ``write.table`` format to shared scratch and read it back."""
    path = scratch_path(spark, name)
    write_table(df, path)
    return read_table(spark, path, df.schema)


def csv_roundtrip(spark: SparkSession, df: DataFrame, name: str = "table", sep: str = ",") -> DataFrame:
    """Write ``df`` as CSV with a header to shared scratch and scan it, the separator detected."""
    path = scratch_path(spark, name)
    df.write.option("header", True).option("sep", sep).option("nullValue", "NA").csv(path)
    return read_csv(spark, path, df.schema)


def export_roundtrip(spark: SparkSession, df: DataFrame, key: str, name: str = "export") -> DataFrame:
    """Export ``df`` in order of ``key`` as R text and read it back."""
    path = scratch_path(spark, name)
    write_sorted(df, path, key, fmt="rtable")
    return read_table(spark, path, df.schema)


def write_sorted(df: DataFrame, path: str, key: str = "donor", fmt: str = "parquet",
                 partitions: int | None = None, mode: str = "overwrite") -> None:
    """Write a table ordered by ``key`` (the reference's ``order by`` on every result).

    One sort at write time only: rows are range-partitioned on ``key`` (Spark
    samples the bounds) and sorted inside each partition, so the part files
    read in order form the sorted table; no single task sorts everything.
    ``fmt`` is ``parquet`` or ``rtable`` (R ``write.table`` text).
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n, key).sortWithinPartitions(key)
    if fmt == "rtable":
        write_table(ordered, path, mode)
    else:
        ordered.write.mode(mode).parquet(path)
