"""R / dplyr semantics on hand-made edge rows (FIXTURES section 4)."""

import datetime as dt

from pyspark.sql import functions as F

from donorlens.functions import as_numeric, n_distinct, na_max, na_sum, not_in, paste, ymd
from donorlens.operators import profile as P
from donorlens.plans import features as ft

PE_SCHEMA = ("DonationDateSKey date, IterationSKey long, DonorConstituentID string, "
             "PrimaryConstituentID string, InstanceDetailSKey long, PaymentMethodType string, "
             "PaymentStatus string, PaymentAmount double, CreditCardExpirationMonth int, "
             "CreditCardExpirationYear int, IterationGroupingName string, ProgramName string")


def pe_rows(spark, rows):
    """rows: (date, donor, host, instance, type, status, amount, month, year, program)"""
    full = [(d, 1, donor, host, inst, typ, st, amt, mo, yr, "g", prog)
            for (d, donor, host, inst, typ, st, amt, mo, yr, prog) in rows]
    return spark.createDataFrame(full, PE_SCHEMA)


D = dt.date


def test_n_distinct_counts_na(spark):  # R1, na_groups
    df = spark.createDataFrame([("a", 1), ("a", None), ("a", 1), (None, 2), (None, 3)], "k string, v int")
    out = {r["k"]: r["n"] for r in df.groupBy("k").agg(n_distinct("v").alias("n")).collect()}
    assert out == {"a": 2, None: 2}


def test_na_sum_propagates(spark):  # R2, na_sum
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 3.0)], "k string, v double")
    out = {r["k"]: (r["s"], r["m"]) for r in df.groupBy("k").agg(na_sum("v").alias("s"),
                                                                  na_max("v").alias("m")).collect()}
    assert out == {"a": (None, None), "b": (5.0, 3.0)}


def test_not_in_keeps_na(spark):  # R3, na_in
    df = spark.createDataFrame([("Male",), ("Female",), ("Unknown",), (None,)], "g string")
    kept = sorted((r["g"] or "<NA>") for r in df.filter(not_in("g", ["Male", "Female"])).collect())
    assert kept == ["<NA>", "Unknown"]


def test_dplyr_join_matches_na(spark):  # R4, na_join
    df = spark.createDataFrame([("x", 1), ("x", 2), (None, 3), (None, 4), ("y", 5)], "k string, v int")
    rows = P.duplicate_rows(df, "k").collect()
    assert sorted(r["v"] for r in rows) == [1, 2, 3, 4]


def test_paste_na(spark):  # R5, na_paste
    df = spark.createDataFrame([(None, 2014), (3, 2015)], "m int, y int")
    got = [r[0] for r in df.select(paste("m", F.lit("-"), "y")).collect()]
    assert got == ["NA-2014", "3-2015"]


def test_ymd_and_as_numeric(spark):  # R9
    df = spark.createDataFrame([(20180105, "12"), (0, "NULL"), (99991231, "x1")], "k int, t string")
    got = df.select(ymd("k").alias("d"), as_numeric("t").alias("x")).collect()
    assert [r["d"] for r in got] == [D(2018, 1, 5), None, D(9999, 12, 31)]
    assert [r["x"] for r in got] == [12.0, None, None]


def test_mode_ties_alphabetical(spark):  # R6, tie_mode
    pe = pe_rows(spark, [
        (D(2016, 1, 1), "Const-9", "Const-5", 1, "b-card", "Processed", 1.0, 1, 2016, "P"),
        (D(2016, 1, 2), "Const-9", "Const-5", 2, "a-cash", "Processed", 1.0, 1, 2016, "P"),
        (D(2016, 1, 3), "Const-9", "Const-5", 3, None, "Processed", 1.0, 1, 2016, "P"),
        (D(2016, 1, 4), "Const-9", "Const-5", 4, None, "Processed", 1.0, 1, 2016, "P"),
        (D(2016, 1, 5), "Const-8", "Const-5", 5, "b-card", "Processed", 1.0, 1, 2016, "P"),
        (D(2016, 1, 6), "Const-8", "Const-5", 6, None, "Processed", 1.0, 1, 2016, "P"),
    ])
    got = {r["donor"]: r["pay_type"] for r in ft.feat_pay_type(pe).collect()}
    # Const-9: NA has 2 but ... b-card 1, a-cash 1, NA 2 -> NA wins on count
    assert got == {"Const-9": None, "Const-8": "b-card"}


def test_recency_variants(spark):  # F12 / D1, recency
    rows = []
    for i, y in enumerate([1974, 2014, 2015, 2016, 2018]):
        rows.append((D(y, 6, 1), f"Const-{10 + i}", "Const-5", i, "t", "Processed", 1.0, 1, y, "P"))
    pe = pe_rows(spark, rows)
    lit = {r["donor"]: r["last_3"] for r in ft.feat_last_3(pe).collect()}
    rec = {r["donor"]: r["last_3"] for r in ft.feat_last_3(pe, variant="recent").collect()}
    # 2018 is outside the feature window: no row at all
    # literal: day number of the last gift > 2015, i.e. after 1975-07-08
    assert lit == {"Const-10": 0, "Const-11": 1, "Const-12": 1, "Const-13": 1}
    assert rec == {"Const-10": 0, "Const-11": 0, "Const-12": 0, "Const-13": 1}


def test_fail_ratio_only_failures_and_sentinels(spark):  # F11 / D8, only_failures, sentinels
    pe = pe_rows(spark, [
        (D(2016, 1, 1), "Const-20", "Const-1", 1, "t", "Error", 1.0, 1, 2016, "P"),
        (D(2016, 1, 2), "Const-20", "Const-1", 2, "t", "Error", 1.0, 1, 2016, "P"),
        (D(2016, 1, 3), "Const-21", "Const-5", 3, "t", "Error", 1.0, 1, 2016, "P"),
        (D(2016, 1, 4), "Const-21", "Const-5", 4, "t", "Processed", 1.0, 1, 2016, "P"),
        (D(2016, 1, 5), "Const-21", "Const-5", 5, "t", "Processed", 1.0, 1, 2016, "P"),
        (D(2016, 1, 6), "Const-1", "Const-5", 6, "t", "Processed", 1.0, 1, 2016, "P"),
        (D(2016, 1, 7), "Const-2", "Const-5", 7, "t", "Processed", 1.0, 1, 2016, "P"),
        (None, "Const-22", "Const-5", 8, "t", "Processed", 1.0, 1, 2016, "P"),
    ])
    got = {r["donor"]: r["fail_ratio"] for r in ft.feat_fail_ratio(pe).collect()}
    assert got == {"Const-20": 0.0, "Const-21": 0.5}
    hosted = {r["donor"]: r["hosted_events"] for r in ft.feat_hosted_events(pe).collect()}
    assert hosted == {"Const-5": 5}


def test_tenure_ignores_placeholder_date(spark):  # F4
    pe = pe_rows(spark, [
        (D(2015, 1, 1), "Const-30", "Const-5", 1, "t", "Processed", 1.0, 1, 2016, "P"),
        (D(2015, 1, 11), "Const-30", "Const-5", 2, "t", "Processed", 1.0, 1, 2016, "P"),
    ])
    assert ft.feat_tenure(pe).collect()[0]["tenure"] == 10


def test_table_drops_na_group_by_keeps_it(spark):  # R8
    df = spark.createDataFrame([("a",), ("a",), (None,)], "x string")
    assert {r["x"]: r["count"] for r in P.freq(df, "x").collect()} == {"a": 2}
    assert {r["x"]: r["count"] for r in P.count_by(df, "x").collect()} == {"a": 2, None: 1}


def test_summary_type7_and_subset_na(spark):  # R11, R13
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 10]] + [(None,)], "x double")
    r = P.summary(df, "x").collect()[0]
    assert (r["min"], r["q1"], r["median"], r["q3"], r["max"], r["n_na"]) == (1, 2, 3, 4, 10, 1)
    assert abs(r["mean"] - 4.0) < 1e-12
    capped = P.summary(df, "x", where=F.col("x") <= 4).collect()[0]
    assert (capped["max"], capped["n_na"]) == (4, 1)


def test_box_tukey_hinges(spark):  # G15
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 6, 100]], "x double")
    r = P.box_stats(df, "x", "tukey").collect()[0]
    # fivenum(c(1:6, 100)) = 1, 2.5, 4, 5.5, 100; fences -2, 10
    assert (r["lower_hinge"], r["median"], r["upper_hinge"]) == (2.5, 4.0, 5.5)
    assert (r["lower_whisker"], r["upper_whisker"], r["n_out"]) == (1.0, 6.0, 1)
