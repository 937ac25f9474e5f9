"""Plan-shape tests: the physical plans keep the properties the design relies on."""

from pyspark.sql import functions as F

from donorlens.plans import datasets as ds
from donorlens.plans import features as ft
from tools_plans import summarise


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_payment_table_is_one_pruned_join(spark, sf):
    pe = ft.pay_events(spark, sf)
    s = summarise(pe)
    assert "CartesianProduct" not in s and "BroadcastNestedLoopJoin" not in s
    plan = _plan(pe)
    # one scan of each raw table, without the unused lineitem column; the iteration filter reaches the part scan
    assert plan.count("lineitem.parquet") == 1 and plan.count("orders.parquet") == 1
    assert "l_linestatus" not in plan
    assert "LessThanOrEqual(p_size,45)" in plan


def test_base_table_expands_no_rows_and_reads_own_columns(spark, sf):
    base = ds.donor_base(spark, sf, {"Regular Giving": "rg"})
    s = summarise(base)
    assert "Window" not in s and "CartesianProduct" not in s
    plan = _plan(base)
    # payments are read from the narrow table only, each part with its own columns
    assert "lineitem.parquet" not in plan
    assert "ReadSchema: struct<host:string,win:boolean>" in plan
    assert "ReadSchema: struct<donor:string,inst:bigint,win:boolean>" in plan


def test_datasets_group_by_numbers(spark, sf):
    """Donors and hosts travel as the numbers in their ids; the result has the ids, and equals that of text ids."""
    keyed = ds.program_dataset(spark, sf)
    plan = _plan(keyed)
    assert "ReadSchema: struct<host:bigint,win:boolean>" in plan
    assert "ReadSchema: struct<donor:bigint,inst:bigint,win:boolean>" in plan
    named = ds.program_dataset(spark, sf, pe=ft.pay_events(spark, sf))
    assert keyed.schema == named.schema and keyed.filter("donor like 'Const-%'").count() == keyed.count() > 0
    assert sorted(map(tuple, keyed.collect()), key=repr) == sorted(map(tuple, named.collect()), key=repr)


def test_base_table_without_broadcasts_is_the_same(spark, sf):
    want = sorted(map(tuple, ds.const_base(spark, sf).collect()), key=repr)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(tuple, ds.const_base(spark, sf).collect()), key=repr) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_single_partition_over_table_rows(spark, sf):
    import __spark_entry__ as E
    qs = E.queries()
    for name in ("pay_events", "dup_rows", "dup_keys", "contact_counts", "contact_span", "past_don"):
        assert "SinglePartition" not in _plan(qs[name](spark, sf)), name


def test_no_cartesian_products_in_headline_queries(spark, sf):
    import __spark_entry__ as E
    qs = E.queries()
    for name in ("const_base", "ads_regular_giving", "donor_donations", "dup_rows", "feat_pay_type",
                 "contact_span", "amount_filter_counts", "past_don"):
        s = summarise(qs[name](spark, sf))
        assert "CartesianProduct" not in s and "BroadcastNestedLoopJoin" not in s, (name, s)


def test_single_feature_has_no_window_and_uses_partial_aggregation(spark, sf):
    s = summarise(ft.feat_paid_instances(ft.pay_events(spark, sf)))
    assert "Window" not in s and s.get("HashAggregate", 0) >= 2


def test_data_queries_read_whole_tables(spark, sf):
    """No registered data query caps or samples rows (``head`` is the only limit: it is the feature).

    The split queries are the sampling operator itself: Catalyst turns "row
    number <= need inside the one boundary bucket" into an exact top-k of
    that bounded bucket; their sizes and completeness are tested separately.
    """
    import __spark_entry__ as E
    qs = E.queries()
    names = (["const_base", "ads_regular_giving", "ads_abmt", "model_input",
              "threshold_scores", "roc_auc", "confusion_counts"]
             + list(E.FEATURE_QUERIES) + list(E.PROFILE_QUERIES))
    for name in names:
        plan = _plan(qs[name](spark, sf))
        for op in ("GlobalLimit", "LocalLimit", "CollectLimit", "TakeOrderedAndProject", "Sample "):
            assert op not in plan, (name, op)
    assert "TakeOrderedAndProject" in _plan(qs["head"](spark, sf))


def test_datasets_of_all_programs_need_no_exchange(spark, sf):
    """Ten joins and four programs over bucketed donor tables, without and with broadcasts."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tables = ds.donor_tables(spark, sf, buckets=5)
        every = ds.program_datasets(tables)
        plan = _plan(every)
        assert "Exchange" not in plan and plan.count("SortMergeJoin") == len(tables) - 1
        got = every.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    def rounded(row):  # sums of amounts depend on their order in the last digits
        return tuple(round(v, 4) if isinstance(v, float) else v for v in row)

    for program in ds.PROGRAMS:
        want = ds.program_dataset(spark, sf, program).collect()
        own = sorted((rounded(tuple(r)[1:]) for r in got if r["program"] == program), key=repr)
        assert own == sorted(map(rounded, map(tuple, want)), key=repr) and len(own) == len(got) // 4


def test_sketches_of_years_merge_to_distinct_counts(spark):
    """Unions of yearly sketches stay within 3 % of the exact counts of the rows, nulls counted once."""
    import datetime as dt
    rows = spark.range(120_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("d"), F.col("id") % 7)).alias("DonorConstituentID"),
        F.when(F.col("id") % 11 != 0, F.pmod(F.xxhash64("id"), F.lit(30_000))).alias("InstanceDetailSKey"),
        F.concat(F.lit("p"), F.col("id") % 5).alias("ProgramName"),
        F.date_add(F.lit(dt.date(2010, 1, 1)), (F.col("id") % 2500).cast("int")).alias("DonationDateSKey"))
    sketches = ft.donor_year_sketches(rows)
    assert sketches.count() == 8 * 7
    for first, before in ((None, None), (2011, 2014), (2012, 2013)):
        got = {r["donor"]: r for r in ft.distinct_in_years(sketches, first, before).collect()}
        own = rows.filter(F.year("DonationDateSKey").between(first or 0, (before or 9999) - 1))
        exact = own.groupBy("DonorConstituentID").agg(
            (F.count_distinct("InstanceDetailSKey") + F.max(F.col("InstanceDetailSKey").isNull()).cast("int")).alias("n")).collect()
        assert len(got) == len(exact) == 8
        for r in exact:
            assert abs(got[r["DonorConstituentID"]]["paid_instances"] - r["n"]) <= 0.03 * r["n"]
            assert got[r["DonorConstituentID"]]["dist_events"] == 5


def test_few_values_are_counted_beside_the_sums(spark, sf, monkeypatch):
    """Distinct counts and the usual method of columns with few values need no pass of their own, and equal distinct rows."""
    def rows():
        for i in range(600):
            day = f"{1940 + i * 7 % 90}-03-04"  # over 64 years, some after the window
            yield (day if i % 11 else None, None if i % 7 == 0 else f"P{i % 70}", 5 + i % 9, 3 + i % 4, i % 13,
                   None if i % 5 < 2 else f"m{i % 3}", ("Processed", "Error", "Pending")[i % 3], None if i % 19 == 0 else float(i),
                   None if i % 6 == 0 else i % 12, 2000 + i % 9 if i % 8 else None)
    pe = spark.createDataFrame(
        list(rows()), "DonationDateSKey string, ProgramName string, DonorConstituentID long, PrimaryConstituentID long, "
        "InstanceDetailSKey long, PaymentMethodType string, PaymentStatus string, PaymentAmount double, "
        "CreditCardExpirationMonth int, CreditCardExpirationYear int").withColumn("DonationDateSKey", F.col("DonationDateSKey").cast("date"))

    def made():
        parts = ds.donor_parts(spark, sf, {"P1": "p"}, pe=pe)
        joined = ds._joined(parts)
        return len(parts), sorted(map(repr, joined.select(sorted(joined.columns)).collect()))

    n, few = made()
    monkeypatch.setattr(ds, "MAX_MARKED", 1)
    monkeypatch.setattr(ds, "MAX_SUMMED", 0)
    n_distinct, distinct = made()
    assert (n, n_distinct) == (4, 8) and few == distinct and len(few) == 9
