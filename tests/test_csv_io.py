"""Text exchange at its edges, and inferred types."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from donorlens.operators import profile
from donorlens.sources import csv_io


def test_text_of_five_megabytes(spark):
    long = 'a "quoted" \\ back\nslash é ' * 220_000
    assert len(long.encode()) > 5_000_000
    df = spark.createDataFrame([(long, 1), ("x" * 100_000, 2), ("\\" * 50_001, 3)], "a string, b int")
    assert sorted(map(tuple, csv_io.roundtrip(spark, df).collect()), key=lambda r: r[1]) == [
        (long, 1), ("x" * 100_000, 2), ("\\" * 50_001, 3)]


def test_every_file_of_a_task_has_a_header(spark):
    df = spark.range(100).select(F.col("id"), F.concat(F.lit("Const-"), "id").alias("donor")).coalesce(1)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "10")
    try:
        path = csv_io.scratch_path(spark, "small")
        csv_io.write_table(df, path)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    heads = csv_io.headers(spark, path).collect()
    assert len(heads) == 10 and {r["line"] for r in heads} == {'"id" "donor"'}
    assert sorted(map(tuple, csv_io.read_table(spark, path, df.schema).collect())) == [(i, f"Const-{i}") for i in range(100)]


def test_control_characters_and_blanks_survive(spark):
    rows = [(f"a{chr(c)}b", c) for c in range(0, 33)] + [("  both  ", 40), ("\\0", 41), ("\\1\\x", 42), (" ", 43)]
    df = spark.createDataFrame(rows, "a string, b int")
    assert sorted(map(tuple, csv_io.roundtrip(spark, df).collect()), key=lambda r: r[1]) == rows


def _files(spark, *texts):
    """A CSV folder of one file per text."""
    path = csv_io.scratch_path(spark, "csv")
    for k, t in enumerate(texts):
        spark.createDataFrame([(t,)], "t string").coalesce(1).write.mode("append").option("lineSep", "\n").text(f"{path}/p={k}")
    return f"{path}/*"


def test_types_of_all_kinds_and_late_surprises(spark):
    head = "flag;n;big;x;day;text;late;blank;mixed"
    one = ";".join(["TRUE", "12", "2147483648", "1.5", "2020-02-29", "abc", "7", "", "TRUE"])
    two = ";".join(["false", "-3", "5", "4", "1999-12-31", '"a;b"', "8", "NA", "1"])
    odd = ";".join(["NA", "+0012", "-9000000000", "1e-3", "NA", "NA", "oops", "", "NA"])
    path = _files(spark, "\n".join([head, *[one] * 50]), "\n".join([head, *[two] * 40, odd]))
    schema, report = csv_io.infer_schema(spark, path)
    assert [(f.name, f.dataType.simpleString()) for f in schema] == list(zip(head.split(";"), [
        "boolean", "int", "bigint", "double", "date", "string", "string", "boolean", "string"]))
    r = {x["column"]: x for x in report.collect()}
    assert (r["late"]["n_values"], r["late"]["common_class"], r["late"]["n_other"], r["late"]["first_other"]) == (91, "int", 1, "oops")
    assert "p=1" in r["late"]["first_other_file"]
    assert (r["big"]["common_class"], r["big"]["n_other"]) == ("int64", 40) and r["blank"]["n_na"] == 91
    got = csv_io.read_inferred(spark, path)
    assert got.schema == schema
    last = got.filter("late = 'oops'").first()
    assert tuple(last) == (None, 12, -9000000000, 0.001, None, None, "oops", None, None)
    assert got.filter("text = 'a;b'").count() == 40 and got.agg(F.min("day")).first()[0] == dt.date(1999, 12, 31)


def test_values_on_the_edges_of_types(spark):
    cases = {"2147483647": "int", "-2147483647": "int", "-2147483648": "int64", "9223372036854775807": "int64",
             "9223372036854775808": "double", "1.": "double", ".5": "double", "1d": "text", "1e5": "double", "NaN": "double",
             "-Inf": "double", "2021-02-29": "text", "T": "text", "1 2": "text", "0x1F": "text", "--1": "text", " ": None, "NA": None}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r["v"]: r["c"] for r in df.select("v", csv_io.value_class(F.col("v")).alias("c")).collect()} == cases


def test_separator_is_voted_over_all_files(spark):
    path = _files(spark, 'a|b|"c,d,e"\n1|2|x', 'a|b|"c,d,e"\n3|4|y')
    assert csv_io.vote_separator(spark, path) == ("|", ["a", "b", "c,d,e"])
    assert sorted(map(tuple, csv_io.read_inferred(spark, path).collect())) == [(1, 2, "x"), (3, 4, "y")]
    with pytest.raises(ValueError):
        csv_io.infer_schema(spark, _files(spark, "a,b\n1,2", "a,c\n1,2"))
    empty = csv_io.read_inferred(spark, _files(spark, "a,b"))
    assert empty.columns == ["a", "b"] and empty.count() == 0


def test_box_statistics_of_a_column_without_values(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    for method in ("tukey", "type7"):
        got = profile.box_stats(df, "x", method)
        assert got.columns == profile.box_stats(spark.createDataFrame([(1.0,)], "x double"), "x", method).columns
        assert tuple(got.first()) == (0, None, None, None, None, None, 0)


def test_classes_are_counted_without_sorting_all_values(spark):
    rows = [(("f", i), i % 2, v) for i, v in enumerate(["1", "x", "2", "y", "NA", "3"])]
    each = spark.createDataFrame(rows, "place struct<file:string,id:bigint>, position int, v string")
    counts = csv_io.class_counts(each)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" in plan and "SortAggregate" not in plan
    got = {(r["position"], r["class"]): (r["n"], r["first"]["v"]) for r in counts.collect()}
    assert got == {(0, "int"): (2, "1"), (0, None): (1, "NA"), (1, "text"): (2, "x"), (1, "int"): (1, "3")}
