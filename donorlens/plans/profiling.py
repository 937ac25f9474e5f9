"""Profiling of constituents, commitments and appeal contacts (script 01).

One function per result; each takes ``(spark, sf_dir)`` and returns a
DataFrame. Sorting, where the reference sorts, is applied to the final (small)
result only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from donorlens.functions import as_numeric, n_distinct, na_max, na_min, not_in, ymd
from donorlens.operators import profile as P
from donorlens.sources import tables

KEY = "MasterConstituentId"


def _const(spark, sf):
    return tables.constituent(spark, sf)


def _inst(spark, sf):
    """Commitments with the RG amounts converted from text (``as.numeric``)."""
    i = tables.instance(spark, sf)
    return (i.withColumn("RGAmount", as_numeric("RGAmount"))
             .withColumn("RGAnnualAmount", as_numeric("RGAnnualAmount")))


def _appeals(spark, sf):
    return tables.appeal_contact(spark, sf)


# -- duplicates (E1-E4) ------------------------------------------------------

def dup_key_count(spark: SparkSession, sf: str) -> DataFrame:
    return P.duplicate_keys(_const(spark, sf), KEY).agg(F.count(F.lit(1)).alias("n_dup_keys"))


def dup_keys(spark, sf):
    return P.duplicate_keys(_const(spark, sf), KEY).orderBy(F.desc("count"), KEY)


def dup_rows(spark, sf):
    return P.duplicate_rows(_const(spark, sf), KEY)


def dup_status_freq(spark, sf):
    return P.freq(P.duplicate_rows(_const(spark, sf), KEY), "ConstituentStatusCode")


# -- geography (E5-E10) ------------------------------------------------------

def subregion_counts(spark, sf):
    return P.distinct_count_by(_const(spark, sf), "ConstituentSubRegion", KEY).orderBy(F.desc("count"), "ConstituentSubRegion")


def region_counts(spark, sf):
    return P.distinct_count_by(_const(spark, sf), "ConstituentRegion", KEY).orderBy(F.desc("count"), "ConstituentRegion")


def lga_counts(spark, sf):
    return P.distinct_count_by(_const(spark, sf), "LGA", KEY).orderBy(F.desc("count"), "LGA")


def _mapping(spark, sf, a, b):
    return (P.count_by(_const(spark, sf), a, b)
            .orderBy(F.asc_nulls_last(a), F.desc("count")))


def subregion_to_region(spark, sf):
    return _mapping(spark, sf, "ConstituentSubRegion", "ConstituentRegion")


def lga_to_region(spark, sf):
    return _mapping(spark, sf, "LGA", "ConstituentRegion")


def lga_to_subregion(spark, sf):
    return _mapping(spark, sf, "LGA", "ConstituentSubRegion")


# -- person attributes (E11-E18) ----------------------------------------------

def _counts(col):
    def q(spark, sf):
        return P.count_by(_const(spark, sf), col).orderBy(F.desc("count"), col)
    q.__name__ = f"counts_{col}"
    return q


title_counts = _counts("Title")
gender_counts = _counts("Gender")
birth_country_counts = _counts("CountryOfBirth")
state_counts = _counts("Address1State")
postcode_counts = _counts("Address1Postcode")
country_counts = _counts("Address1Country")


def unknown_gender_titles(spark, sf):
    c = _const(spark, sf).filter(not_in("Gender", ["Male", "Female"]))
    return P.count_by(c, "Title").orderBy(F.desc("count"), "Title")


def aboriginality_freq(spark, sf):
    return P.freq(_const(spark, sf), "Aboriginality")


def _freq(col, loader=_const):
    def q(spark, sf):
        return P.freq(loader(spark, sf), col)
    q.__name__ = f"freq_{col}"
    return q


under18_freq = _freq("Under18")
deceased_freq = _freq("Deceased")
age_freq = _freq("Age")
ageband_freq = _freq("AgeBand")
philanthropy_freq = _freq("PhilanthrophyStatus")


def deceased_date_check(spark, sf):
    return _const(spark, sf).filter(F.col("Deceased") == "No").select("DeceasedDate").distinct()


def address_cardinality(spark, sf):
    """Distinct suburbs, states and suburb-state pairs (NA is a value), from one pair table."""
    pairs = _const(spark, sf).select("Address1Suburb", "Address1State").distinct()
    return pairs.agg(n_distinct("Address1Suburb").alias("n_suburbs"),
                     n_distinct("Address1State").alias("n_states"),
                     F.count(F.lit(1)).alias("n_pairs"))


def suburb_state_counts(spark, sf):
    return (P.count_by(_const(spark, sf), "Address1Suburb", "Address1State")
            .orderBy(F.asc_nulls_last("Address1Suburb"), F.desc("count")))


def age_box(spark, sf):
    return P.box_stats(_const(spark, sf), "Age", method="tukey")


# -- commitments (E28-E37) ----------------------------------------------------

def rg_amount_summary(spark, sf):
    return P.summary(_inst(spark, sf), "RGAmount")


def rg_annual_summary(spark, sf):
    return P.summary(_inst(spark, sf), "RGAnnualAmount")


def rg_filter_counts(spark, sf):
    a, y = F.col("RGAmount"), F.col("RGAnnualAmount")
    return P.count_if_table(_inst(spark, sf), {
        "n_any_ge0": (y >= 0) | (a >= 0),
        "n_rg_ge0": a >= 0,
        "n_rg_eq0": a == 0,
        "n_any_gt0": (y > 0) | (a > 0),
    })


def amount_summary(spark, sf):
    return P.summary(_inst(spark, sf), "InstanceAmount")


def amount_filter_counts(spark, sf):
    x = F.col("InstanceAmount")
    return P.count_if_table(_inst(spark, sf), {"n_le0": x <= 0, "n_gt1000": x > 1000})


def amount_box(spark, sf):
    return P.box_stats(_inst(spark, sf), "InstanceAmount", method="tukey")


def amount_box_capped(spark, sf):
    i = _inst(spark, sf).filter(F.col("InstanceAmount") <= 1000)
    return P.box_stats(i, "InstanceAmount", method="type7")


def amount_summary_capped(spark, sf):
    return P.summary(_inst(spark, sf), "InstanceAmount", where=F.col("InstanceAmount") <= 1000)


instance_row_freq = _freq("InstanceRow", _inst)


def id_cardinality(spark, sf):
    return _inst(spark, sf).agg(n_distinct("PrimaryConstituentID").alias("pri"),
                                n_distinct("IndConstituentID").alias("indi"),
                                n_distinct("OrgConstituentID").alias("org"))


# -- appeal contacts (E38-E44) ------------------------------------------------

def appeal_profile(spark, sf):
    return P.table_summary(_appeals(spark, sf))


def _appeals_no_sentinel(spark, sf):
    return _appeals(spark, sf).filter(F.col("ConstituentId") != "Const-2")


def appeal_counts(spark, sf):
    return P.count_by(_appeals_no_sentinel(spark, sf), "AppealPackageSKey").orderBy(F.desc("count"), "AppealPackageSKey")


def contact_span(spark, sf):
    """Contacts, latest and earliest send date and the span in years, per constituent.

    ``max``/``min`` are NA when one of the constituent's date keys does not parse.
    """
    a = _appeals_no_sentinel(spark, sf).withColumn("ymd", ymd("SendDateSKey"))
    latest, earliest = na_max("ymd"), na_min("ymd")
    return (a.groupBy("ConstituentId")
            .agg(F.count(F.lit(1)).alias("count"), latest.alias("latest_info"),
                 earliest.alias("earliest_info"),
                 (F.datediff(latest, earliest) / 365.0).alias("diff"))
            .orderBy(F.desc("count"), "ConstituentId"))


def contact_counts(spark, sf):
    return (P.count_by(_appeals_no_sentinel(spark, sf), "AppealPackageSKey", "ConstituentId")
            .orderBy(F.desc("count"), "AppealPackageSKey", "ConstituentId"))


appeal_row_freq = _freq("AppealContactHistoryRow", _appeals)
response_freq = _freq("AppealResponse", _appeals)


def response_counts(spark, sf):
    return P.count_by(_appeals(spark, sf), "AppealResponse").orderBy(F.desc("count"), "AppealResponse")


def parse_date_key(spark, sf):
    """Int ``yyyyMMdd`` keys parsed to dates (unparsable -> NULL), per key."""
    a = _appeals(spark, sf)
    return a.groupBy("SendDateSKey").agg(F.count(F.lit(1)).alias("count")).withColumn(
        "send_date", ymd("SendDateSKey"))


def parse_amount(spark, sf):
    """Text amounts to numbers (``NULL`` text -> NULL), per text value."""
    i = tables.instance(spark, sf)
    return (i.groupBy("RGAmount").agg(F.count(F.lit(1)).alias("count"))
             .withColumn("rg_amount", as_numeric("RGAmount")))


def column_profile(spark, sf):
    """Schema and non-null counts of the appeal contact table."""
    return P.column_profile(_appeals(spark, sf))


def head(spark, sf, n: int = 6):
    """First rows (``head``) of the appeal contact table, in the order of all its columns."""
    a = _appeals(spark, sf)
    return a.orderBy(*a.columns).limit(n)


def mapping_uniqueness(spark, sf):
    """How many keys of the geography mappings have more than one value.

    One row: sub-regions with several regions, LGAs with several regions,
    LGAs with several sub-regions (NA is a key and a value, as in ``group_by``).
    Each count comes from the pair table of its mapping.
    """
    c = _const(spark, sf)

    def multi(a, b, name):
        pairs = c.select(a, b).distinct()
        per_key = pairs.groupBy(a).agg(F.count(F.lit(1)).alias("_n"))
        return per_key.agg(F.count_if(F.col("_n") > 1).alias(name))
    sr = multi("ConstituentSubRegion", "ConstituentRegion", "n_subregion_multi_region")
    lr = multi("LGA", "ConstituentRegion", "n_lga_multi_region")
    ls = multi("LGA", "ConstituentSubRegion", "n_lga_multi_subregion")
    one = F.lit(1).alias("_one")
    return (sr.select("*", one).join(lr.select("*", one), "_one")
              .join(ls.select("*", one), "_one").drop("_one"))
