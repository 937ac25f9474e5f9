"""Donor features (one row per donor) built from payments.

Every feature of the reference is available as its own function (``feat_*``,
one aggregate each, for use on its own). The base table of all features,
:func:`const_base`, is built from one narrow table of payments
(``datasets.payment_rows``), so the fact is joined with its programs once.

Skew: a single donor may own a large share of all payments. Every aggregate
here is algebraic (partial + final), and the distinct counts go through
Spark's Expand rewrite, whose first shuffle is keyed by (donor, value), so a hot
donor is spread over many tasks and no group is ever collected in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from donorlens.functions import date_as_number, n_distinct, paste
from donorlens.sources import tables

# --- fixed values of the workflow ------------------------------------------
SENTINEL_DONORS = ("Const-1", "Const-2")   # placeholder constituents, dropped
SENTINEL_KEYS = (1, 2)                     # the same, as numbers
SENTINEL_DATE = "9999-12-31"               # placeholder donation date
FEATURE_YEAR = 2018                        # features use payments before this year
RECENT_LITERAL = 2015                      # "last 3 yrs" threshold as written
# ---------------------------------------------------------------------------

DONOR = "donor"


def pay_events(spark: SparkSession, sf_dir: str, **ids) -> DataFrame:
    """payments left-joined with their iteration (program).

    dplyr joins match NA keys, hence the null-safe condition. Spark broadcasts
    the iteration dimension where its size in bytes is known to be small.
    """
    pay = tables.payment(spark, sf_dir, **ids)
    it = tables.iteration(spark, sf_dir).select(F.col("IterationSKey").alias("_it_key"),
                                                "IterationGroupingName", "ProgramName")
    return (pay.join(it, pay.IterationSKey.eqNullSafe(it._it_key), "left")
               .drop("_it_key"))


def _not_sentinel(col: str) -> F.Column:
    # Standard comparison: a NULL id is dropped too, like dplyr's filter.
    return ~F.col(col).isin(*SENTINEL_DONORS)


def in_feature_window(year: int = FEATURE_YEAR) -> F.Column:
    """``year(date) < year`` written as a range on the date, so it prunes row groups."""
    return F.col("DonationDateSKey") < F.lit(f"{year}-01-01").cast("date")


def window_payments(pe: DataFrame, year: int = FEATURE_YEAR, key: str = "DonorConstituentID") -> DataFrame:
    """Payments inside the feature window, sentinel ids removed (early: they are hot keys)."""
    return pe.filter(in_feature_window(year) & _not_sentinel(key))


# -- features with their own key or shape -------------------------------------

def feat_hosted_events(pe: DataFrame, year: int = FEATURE_YEAR) -> DataFrame:
    """payments per host (PrimaryConstituentID) inside the window."""
    return (window_payments(pe, year, key="PrimaryConstituentID")
            .groupBy(F.col("PrimaryConstituentID").alias(DONOR))
            .agg(F.count(F.lit(1)).alias("hosted_events")))


def feat_pay_type(pe: DataFrame, year: int = FEATURE_YEAR) -> DataFrame:
    """most frequent payment method per donor.

    Ties go to the method that sorts first, NA last (dplyr keeps the group
    order). Two algebraic aggregates: count per (donor, method), then the
    minimum of (-count, method is null, method) per donor -- no window sort of
    a whole donor partition.
    """
    m = F.col("PaymentMethodType")
    per_type = (window_payments(pe, year)
                .groupBy(F.col("DonorConstituentID").alias(DONOR), m.alias("_m"))
                .agg(F.count(F.lit(1)).alias("_n")))
    best = F.min(F.struct((-F.col("_n")).alias("k1"), F.col("_m").isNull().alias("k2"),
                          F.col("_m").alias("k3")))
    return per_type.groupBy(DONOR).agg(best["k3"].alias("pay_type"))


def feat_instance_count(spark: SparkSession, sf_dir: str, **ids) -> DataFrame:
    """distinct commitments per individual constituent (all years, no filter)."""
    inst = tables.instance(spark, sf_dir, **ids)
    return (inst.groupBy(F.col("IndConstituentID").alias(DONOR))
            .agg(n_distinct("InstanceDetailSKey").alias("instance_count")))


def feat_dist_events(pe, year=FEATURE_YEAR):
    """distinct programs donated to (a missing program counts as one)."""
    return (window_payments(pe, year).groupBy(F.col("DonorConstituentID").alias(DONOR))
            .agg(n_distinct("ProgramName").alias("dist_events")))


def feat_tenure(pe, year=FEATURE_YEAR):
    """days between first and last donation (placeholder date excluded)."""
    d = F.col("DonationDateSKey")
    return (window_payments(pe, year).filter(d != F.lit(SENTINEL_DATE).cast("date"))
            .groupBy(F.col("DonorConstituentID").alias(DONOR))
            .agg(F.datediff(F.max(d), F.min(d)).alias("tenure")))


def feat_yrs_donated(pe, year=FEATURE_YEAR):
    """distinct calendar years with a donation."""
    return (window_payments(pe, year).groupBy(F.col("DonorConstituentID").alias(DONOR))
            .agg(n_distinct(F.year("DonationDateSKey")).alias("yrs_donated")))


def feat_dist_cards(pe, year=FEATURE_YEAR):
    """distinct card expiries ``month-year`` (NA month is the text NA)."""
    card = paste("CreditCardExpirationMonth", F.lit("-"), "CreditCardExpirationYear")
    return (window_payments(pe, year).groupBy(F.col("DonorConstituentID").alias(DONOR))
            .agg(n_distinct(card).alias("dist_cards")))


def feat_paid_instances(pe, year=FEATURE_YEAR):
    """F8: distinct paid commitments."""
    return (window_payments(pe, year).groupBy(F.col("DonorConstituentID").alias(DONOR))
            .agg(n_distinct("InstanceDetailSKey").alias("paid_instances")))


def feat_participated_events(pe, year=FEATURE_YEAR):
    """number of payments of any status."""
    return (window_payments(pe, year).groupBy(F.col("DonorConstituentID").alias(DONOR))
            .agg(F.count(F.lit(1)).alias("participated_events")))


def feat_fail_ratio(pe, year=FEATURE_YEAR):
    """failed / successful payments for donors with a success; else 0.

    Only donors with at least one payment in the window appear (the row set of
    the base table); the ratio is filled with 0 where it is undefined.
    """
    fails, succ = (F.count_if(F.col("PaymentStatus") == s) for s in ("Error", "Processed"))
    return (window_payments(pe, year).groupBy(F.col("DonorConstituentID").alias(DONOR))
            .agg(F.coalesce(F.try_divide(fails, succ), F.lit(0.0)).cast("double").alias("fail_ratio")))


def feat_last_3(pe, year=FEATURE_YEAR, variant: str = "literal"):
    """recent-donor flag.

    ``literal`` keeps the reference's comparison of a date with the number
    2015 (days since 1970, so any gift after mid-1975 counts); ``recent`` is
    the intended ``year(last gift) > 2015``.
    """
    d = F.col("DonationDateSKey")
    flag = (date_as_number(F.max(d)) if variant == "literal" else F.year(F.max(d))) > RECENT_LITERAL
    return (window_payments(pe, year).groupBy(F.col("DonorConstituentID").alias(DONOR))
            .agg(F.when(flag, 1).otherwise(0).alias("last_3")))


# -- distinct counts of any window from stored sketches -----------------------------

SKETCH_LG_K = 14  # 16384 registers: standard error 0.8 %; up to some hundreds of values counts are exact
#: the columns of the distinct-count features
SKETCHED = {"dist_events": "ProgramName", "paid_instances": "InstanceDetailSKey"}


def donor_year_sketches(pe: DataFrame, columns: dict | None = None, lg_k: int = SKETCH_LG_K) -> DataFrame:
    """``(donor, year, s_<feature>, na_<feature>, ...)``: a mergeable HyperLogLog sketch of each column per donor and
    year, and whether a value is missing (a missing value counts as one). Payments without date have year null.

    Stored once, it answers distinct counts of any span of years without the
    payments; a new year only adds its own rows. Sketches merge on the map side, so
    a hot donor is one small row per task.
    """
    aggs = []
    for name, col in (columns or SKETCHED).items():
        aggs += [F.hll_sketch_agg(col, lg_k).alias(f"s_{name}"), F.max(F.col(col).isNull()).alias(f"na_{name}")]
    return (pe.filter(_not_sentinel("DonorConstituentID"))
            .groupBy(F.col("DonorConstituentID").alias(DONOR), F.year("DonationDateSKey").alias("year")).agg(*aggs))


def distinct_in_years(sketches: DataFrame, first: int | None = None, before: int | None = None) -> DataFrame:
    """Approximate distinct counts per donor over the years ``first <= year < before`` (None: no bound), by union."""
    own = sketches.filter("year is not null")
    own = own.filter(F.col("year") >= first) if first is not None else own
    own = own.filter(F.col("year") < before) if before is not None else own
    names = [c[2:] for c in sketches.columns if c.startswith("s_")]
    return own.groupBy(DONOR).agg(*[
        (F.hll_sketch_estimate(F.hll_union_agg(f"s_{n}")) + F.max(f"na_{n}").cast("long")).alias(n) for n in names])


CONST_BASE_COLUMNS = ["donor", "dist_events", "tenure", "yrs_donated", "dist_cards", "hosted_events",
                      "paid_instances", "participated_events", "pay_type", "last_3", "fail_ratio",
                      "instance_count"]


def const_base(spark: SparkSession, sf_dir: str, year: int = FEATURE_YEAR,
               last_3_variant: str = "literal", pe: DataFrame | None = None) -> DataFrame:
    """the donor base table, from the narrow payment table of :mod:`donorlens.plans.datasets`."""
    from donorlens.plans import datasets
    return datasets.const_base(spark, sf_dir, year, last_3_variant, pe)
