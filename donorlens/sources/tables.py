"""Raw table loaders and the donation-schema views built on them.

The workflow is written against five tables of a fundraising warehouse
(payment, iteration, constituent, instance, appeal contact). The test data is a
TPC-H-like star, so each of those tables is a *view*: a projection (and for
payment a join) over the raw parquet tables. The column rules are fixed values
shared with the DuckDB oracle (see ``oracle_queries.py``); they are listed in
FIXTURES.md section 3.

Every view is lazy, so Catalyst prunes the columns a query does not use down to
the parquet scan and pushes filters into it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One raw parquet table of the test data (``<sf_dir>/<name>.parquet``)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def const_id(c) -> F.Column:
    """A constituent's id, from its key."""
    return F.concat(F.lit("Const-"), c.cast("string"))


def const_key(c) -> F.Column:
    """A constituent's id as the number in it."""
    return c.cast("long")


# --- fixed values: how the raw tables map onto the donation schema ----------
# Months added to ship dates so that 1995-2001 becomes 2012-2018.
DATE_SHIFT_MONTHS = 204
# Brand -> program name (other brands become "Program <n>").
PROGRAM_BY_BRAND = {
    "Brand#1": "Regular Giving",
    "Brand#2": "ABMT",
    "Brand#3": "Beneficiary Events",
    "Brand#4": "Relay For Life",
}
# Only parts with p_size <= 45 are iterations, so some payments have no program.
ITERATION_MAX_SIZE = 45
# Market segment -> title; everything else is the literal text "NULL".
TITLE_BY_SEGMENT = {"MACHINERY": "Mr", "BUILDING": "Mrs", "AUTOMOBILE": "Ms", "FURNITURE": "Miss"}
# ---------------------------------------------------------------------------


def payment(spark: SparkSession, sf_dir: str, id_of=const_id) -> DataFrame:
    """FactPayment: one row per payment (lineitem joined with its order).

    ``DonationDateSKey`` is delivered already parsed to a date (the reference
    parses it with ``ymd`` right after loading). ``id_of`` makes a constituent's id from
    its key; with ``const_key`` ids stay numbers, for plans that group by them.
    """
    li = raw(spark, sf_dir, "lineitem")
    o = raw(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    return j.select(
        F.when((F.col("l_linenumber") == 7) & (F.col("l_quantity") == 50), F.lit(None).cast("date"))
         .otherwise(F.add_months(F.to_date("l_shipdate"), DATE_SHIFT_MONTHS))
         .alias("DonationDateSKey"),
        F.col("l_partkey").alias("IterationSKey"),
        id_of(F.col("o_custkey")).alias("DonorConstituentID"),
        id_of(F.col("l_suppkey")).alias("PrimaryConstituentID"),
        F.col("l_orderkey").alias("InstanceDetailSKey"),
        F.col("o_orderpriority").alias("PaymentMethodType"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1), F.lit("Error"))
         .when(F.col("l_returnflag") == "R", F.lit("Pending"))
         .otherwise(F.lit("Processed")).alias("PaymentStatus"),
        F.when((F.col("l_tax") == 0.08) & (F.col("l_quantity") == 1), F.lit(None).cast("double"))
         .otherwise(F.col("l_extendedprice")).alias("PaymentAmount"),
        F.when(F.col("l_discount") == 0, F.lit(None).cast("int"))
         .otherwise(F.col("l_linenumber")).alias("CreditCardExpirationMonth"),
        F.year("o_orderdate").alias("CreditCardExpirationYear"),
    )


def iteration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DimIteration: iteration key -> grouping name and program name."""
    p = raw(spark, sf_dir, "part").filter(F.col("p_size") <= ITERATION_MAX_SIZE)
    prog = F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit("Program "))
    for brand, name in reversed(list(PROGRAM_BY_BRAND.items())):
        prog = F.when(F.col("p_brand") == brand, F.lit(name)).otherwise(prog)
    return p.select(
        F.col("p_partkey").alias("IterationSKey"),
        F.col("p_type").alias("IterationGroupingName"),
        prog.alias("ProgramName"),
    )


def constituent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DimConstituent: one row per customer, with region names.

    Spark broadcasts ``nation`` and ``region`` by their file sizes.
    """
    c = raw(spark, sf_dir, "customer")
    n = raw(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = raw(spark, sf_dir, "region").select("r_regionkey", "r_name")
    j = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, F.col("n_regionkey") == r.r_regionkey, "left")
    k = F.col("c_custkey")
    title = F.lit("NULL")
    for seg, t in reversed(list(TITLE_BY_SEGMENT.items())):
        title = F.when(F.col("c_mktsegment") == seg, F.lit(t)).otherwise(title)
    age = F.when(k % 4 == 0, (k % 90).cast("int"))
    return j.select(
        const_id(F.when(k % 10 == 9, k - 1).otherwise(k)).alias("MasterConstituentId"),
        F.when(k % 10 == 9, "Duplicate").when(k % 37 == 0, "Inactive").otherwise("Active")
         .alias("ConstituentStatusCode"),
        F.col("n_name").alias("ConstituentSubRegion"),
        F.when(k % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("r_name")).alias("ConstituentRegion"),
        F.when(k % 17 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("LGA-"), (k % 40).cast("string"))).alias("LGA"),
        title.alias("Title"),
        F.when(k % 4 == 0, "Male").when(k % 4 == 1, "Female").when(k % 4 == 2, "Unknown").alias("Gender"),
        F.when(k % 7 == 0, "Aboriginal").when(k % 7 == 1, "Not Aboriginal")
         .when(k % 7 == 2, F.lit(None).cast("string")).otherwise("NULL").alias("Aboriginality"),
        F.when(k % 5 == 0, F.col("n_name")).when(k % 5 == 1, F.lit(None).cast("string"))
         .otherwise("NULL").alias("CountryOfBirth"),
        F.when(k % 90 < 18, "Yes").otherwise("No").alias("Under18"),
        F.when(k % 50 == 0, "Yes").otherwise("No").alias("Deceased"),
        F.when((k % 50 == 0) | (k % 97 == 0),
               F.concat((2000 + k % 18).cast("string"), F.lit("-06-30"))).otherwise("NULL").alias("DeceasedDate"),
        F.when(k % 23 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("Suburb-"), (k % 300).cast("string"))).alias("Address1Suburb"),
        F.when(k % 19 == 0, F.lower(F.substring("n_name", 1, 3)))
         .otherwise(F.substring("n_name", 1, 3)).alias("Address1State"),
        (1000 + F.col("c_nationkey") * 100 + k % 100).cast("string").alias("Address1Postcode"),
        F.when(k % 29 == 0, "NULL").when(k % 31 == 0, "Aus").otherwise("Australia").alias("Address1Country"),
        age.alias("Age"),
        F.when(age.isNull(), "Unknown").when(age < 18, "Under 18").when(age <= 30, "18-30")
         .when(age <= 40, "31-40").when(age <= 50, "41-50").when(age <= 60, "51-60").otherwise("60+")
         .alias("AgeBand"),
        F.when(F.col("c_acctbal") > 9000, "Major Donor").when(F.col("c_acctbal") < 0, "Lapsed")
         .alias("PhilanthrophyStatus"),
    )


def instance(spark: SparkSession, sf_dir: str, id_of=const_id) -> DataFrame:
    """FactInstance: one commitment per order; RG amounts are text with "NULL"."""
    o = raw(spark, sf_dir, "orders")
    cid = id_of(F.col("o_custkey"))
    rg = (F.floor(F.col("o_totalprice") / 1000).cast("int") % 20)
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return o.select(
        F.col("o_orderkey").alias("InstanceDetailSKey"),
        cid.alias("PrimaryConstituentID"),
        F.when(F.col("o_orderstatus") != "P", cid).alias("IndConstituentID"),
        F.when(F.col("o_orderstatus") == "P", cid).alias("OrgConstituentID"),
        (F.col("o_totalprice") / 100 - 500).alias("InstanceAmount"),
        F.when(urgent, rg.cast("string")).otherwise("NULL").alias("RGAmount"),
        F.when(urgent, (rg * 12).cast("string")).otherwise("NULL").alias("RGAnnualAmount"),
        F.lit(1).alias("InstanceRow"),
    )


def appeal_contact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FactAppealContactHistory: one contact per event; a few unparsable date keys (0)."""
    e = raw(spark, sf_dir, "events")
    ts = F.col("ts")
    key = (F.year(ts) * 10000 + F.month(ts) * 100 + F.dayofmonth(ts)).cast("int")
    return e.select(
        F.get_json_object("props", "$.k").cast("long").alias("AppealPackageSKey"),
        const_id(F.col("user_id")).alias("ConstituentId"),
        F.when(F.col("event_id") % 97 == 0, F.lit(0)).otherwise(key).alias("SendDateSKey"),
        F.col("event_type").alias("AppealResponse"),
        F.lit(1).alias("AppealContactHistoryRow"),
    )


VIEWS = {
    "payment": payment,
    "iteration": iteration,
    "constituent": constituent,
    "instance": instance,
    "appeal_contact": appeal_contact,
}


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Register the five donation-schema views as temp views (for ``spark.sql``)."""
    for name, fn in VIEWS.items():
        fn(spark, sf_dir).createOrReplaceTempView(name)
