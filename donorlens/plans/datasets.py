"""Donation tables and the labelled per-program datasets.

``program_dataset`` (A6-A9) is the flagship. Its plan joins the payments with
their programs once, into a narrow Parquet table of the rows and columns that
any feature needs (:func:`payment_rows`). Each consumer reads its own columns of
it: one additive aggregate per donor (counts, sums, dates, program totals,
label, and the distinct counts and method mode of columns with few values), one
narrow distinct per other distinct count, keyed by donor and value, and the host
counts. No row is expanded, and a donor who
owns a large share of all payments becomes one partial row per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from donorlens.functions import date_as_number, na_sum
from donorlens.plans import features as ft
from donorlens.plans.features import DONOR, FEATURE_YEAR, RECENT_LITERAL, SENTINEL_DATE
from donorlens.session import bucketed, staged
from donorlens.sources import tables

# --- fixed values: the four modelled programs and their column suffixes ------
PROGRAMS = {
    "Regular Giving": "rg",
    "ABMT": "abmt",
    "Beneficiary Events": "be",
    "Relay For Life": "rfl",
}
LABEL_YEAR = 2018
PROCESSED = "Processed"
# ---------------------------------------------------------------------------

# Programs of a wide table (each one is two columns); more is an error, never a cut.
MAX_PIVOT_VALUES = 2000

# Columns of at most so many values are counted by a bit, or a sum, per value; others by distinct rows.
MAX_MARKED = 256
MAX_SUMMED = 16


def _processed() -> F.Column:
    return F.col("PaymentStatus") == PROCESSED


def _before(year: int | None) -> F.Column:
    if year is None:
        return F.lit(True)
    return F.col("DonationDateSKey") < F.lit(f"{year}-01-01").cast("date")


def past_don(pe: DataFrame) -> DataFrame:
    """A1: processed payments with a known program per donor x program x year."""
    return (pe.filter(F.col("ProgramName").isNotNull() & _processed())
            .groupBy("DonorConstituentID", "ProgramName",
                     F.year("DonationDateSKey").alias("don_year"))
            .agg(F.count(F.lit(1)).alias("count"),
                 na_sum("PaymentAmount").alias("donated_amt")))


def donations_by_program(pe: DataFrame, as_of_year: int | None = None) -> DataFrame:
    """A2: processed amount and count per donor x program (a missing program is a group)."""
    return (pe.filter(_processed() & _before(as_of_year))
            .groupBy("DonorConstituentID", "ProgramName")
            .agg(na_sum("PaymentAmount").alias("total_amt"),
                 F.count(F.lit(1)).alias("count")))


def donor_total(pe: DataFrame, as_of_year: int | None = None) -> DataFrame:
    """A3: total processed amount and count per donor.

    Summing the per-program totals equals one aggregate over the rows (NA as
    soon as any amount is NA), so no second aggregation level is needed.
    """
    return (pe.filter(_processed() & _before(as_of_year))
            .groupBy("DonorConstituentID")
            .agg(na_sum("PaymentAmount").alias("total_donated"),
                 F.count(F.lit(1)).alias("total_count")))


def program_values(by_program: DataFrame, limit: int = MAX_PIVOT_VALUES) -> list:
    """Distinct programs of a donor x program table, a missing one first (at most ``limit``)."""
    rows = by_program.select("ProgramName").distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} programs: raise the limit of program_values to pivot them")
    vals = [r[0] for r in rows]
    return sorted(vals, key=lambda v: (v is not None, v or ""))


def _col_name(measure: str, program) -> str:
    return f"{measure}_{'NA' if program is None else program}".replace(" ", "_")


def donor_donations(pe: DataFrame, programs: list | None = None,
                    as_of_year: int | None = None) -> DataFrame:
    """A4: wide table, one row per donor with processed payments.

    Columns ``total_amt_<program>`` and ``count_<program>`` (spaces become
    underscores, a missing program is ``NA``), missing cells filled with 0.
    The payments are aggregated once, by donor and program; the program list and
    the pivot both come from that table.
    """
    by_program = staged(donations_by_program(pe, as_of_year), "by_program")
    programs = programs if programs is not None else program_values(by_program)
    wide = (by_program.groupBy("DonorConstituentID").pivot("ProgramName", programs)
            .agg(F.first("total_amt").alias("total_amt"), F.first("count").alias("count")))
    cols = [F.col("DonorConstituentID")]
    for measure in ("total_amt", "count"):
        for p in programs:
            src = f"{'null' if p is None else p}_{measure}"
            cols.append(F.coalesce(F.col(f"`{src}`"), F.lit(0)).alias(_col_name(measure, p)))
    return wide.select(*cols)


def program_dataset(spark: SparkSession, sf_dir: str, program: str = "Regular Giving",
                    suffix: str | None = None, label_year: int = LABEL_YEAR,
                    as_of_year: int | None = None, year: int = FEATURE_YEAR,
                    last_3_variant: str = "literal", pe: DataFrame | None = None) -> DataFrame:
    """The base table plus program totals, overall totals and the label.

    ``as_of_year=None`` keeps the reference's totals over all years (they
    include the label year: leakage); ``as_of_year=label_year`` gives the
    leak-free form.
    """
    suffix = suffix or PROGRAMS.get(program) or program.lower().replace(" ", "_")
    pe = pe if pe is not None else keyed_events(spark, sf_dir)
    base = donor_base(spark, sf_dir, {program: suffix}, year, label_year, as_of_year, last_3_variant, pe)
    return base.select(*ft.CONST_BASE_COLUMNS, f"total_amt_{suffix}", f"count_{suffix}",
                       "total_donated", "total_count",
                       F.col(f"status_{suffix}").cast("int").alias("status"))


def const_base(spark: SparkSession, sf_dir: str, year: int = FEATURE_YEAR, last_3_variant: str = "literal",
               pe: DataFrame | None = None) -> DataFrame:
    """the donor base table (row set: donors with a payment in the window)."""
    pe = pe if pe is not None else keyed_events(spark, sf_dir)
    base = donor_base(spark, sf_dir, {}, year, LABEL_YEAR, None, last_3_variant, pe)
    return base.select(*ft.CONST_BASE_COLUMNS)


# -- the base table from one narrow table of payments ----------------------------

def payment_rows(pe: DataFrame, year: int = FEATURE_YEAR) -> DataFrame:
    """The payments that any feature, total or label needs, with only the columns they use.

    Payments in the feature window or processed, of real donors or hosts; written
    once as Parquet, so every consumer reads its own columns. Donors and hosts may be
    given as text ids or as the numbers in them.
    """
    win = F.coalesce(ft.in_feature_window(year), F.lit(False))
    return staged(pe.filter(win | _processed()).select(
        F.col("DonorConstituentID").alias("donor"), F.col("PaymentMethodType").alias("type"),
        F.col("ProgramName").alias("prog"), F.col("DonationDateSKey").alias("d"),
        F.col("CreditCardExpirationMonth").alias("mo"), F.col("CreditCardExpirationYear").alias("yr"),
        F.col("InstanceDetailSKey").alias("inst"), F.col("PrimaryConstituentID").alias("host"),
        F.col("PaymentStatus").alias("status"), F.col("PaymentAmount").alias("amt"), win.alias("win")), "payments")


def keyed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payments with constituents' ids as numbers, which are grouped and joined faster than texts."""
    return ft.pay_events(spark, sf_dir, id_of=tables.const_key)


def _numbers(rows: DataFrame, col: str) -> bool:
    return rows.schema[col].dataType.typeName() == "long"


def _real(rows: DataFrame, col: str) -> F.Column:
    """True where ``col`` names a constituent, and no placeholder."""
    return ~F.col(col).isin(*(ft.SENTINEL_KEYS if _numbers(rows, col) else ft.SENTINEL_DONORS))


def donor_sums(rows: DataFrame, programs: dict, label_year: int = LABEL_YEAR,
               as_of_year: int | None = None, more: list | None = None) -> DataFrame:
    """Everything additive, one row per donor with a window payment (sentinels dropped); ``more`` aggregates beside it."""
    w, d, amt = F.col("win"), F.col("d"), F.col("amt")
    processed = F.col("status") == PROCESSED
    total = processed & (F.coalesce(d < F.lit(f"{as_of_year}-01-01").cast("date"), F.lit(False))
                         if as_of_year else F.lit(True))
    valid = F.when(w & (d != F.lit(SENTINEL_DATE).cast("date")), d)
    last = F.max(F.when(w, d))
    n_total = F.count_if(total)

    def money(cond):  # NA as soon as one amount is missing
        return F.when(F.count_if(cond & amt.isNull()) == 0, F.sum(F.when(cond, amt)))

    aggs = [
        F.count_if(w).alias("participated_events"),
        F.datediff(F.max(valid), F.min(valid)).alias("tenure"),
        F.when(date_as_number(last) > RECENT_LITERAL, 1).otherwise(0).alias("last_3"),
        F.when(F.year(last) > RECENT_LITERAL, 1).otherwise(0).alias("last_3_recent"),
        F.coalesce(F.try_divide(F.count_if(w & (F.col("status") == "Error")), F.count_if(w & processed)), F.lit(0.0))
         .cast("double").alias("fail_ratio"),
        F.when(n_total > 0, money(total)).alias("total_donated"),
        F.when(n_total > 0, n_total).alias("total_count"),
    ]
    for p, s in programs.items():
        own = total & F.coalesce(F.col("prog") == p, F.lit(False))
        labelled = processed & F.coalesce((F.col("prog") == p) & (F.year(d) == label_year), F.lit(False))
        paid = F.when(F.count_if(own & amt.isNull()) == 0, F.coalesce(F.sum(F.when(own, amt)), F.lit(0.0)))
        aggs += [F.when(n_total > 0, F.coalesce(paid, F.lit(0.0))).alias(f"total_amt_{s}"),
                 F.when(n_total > 0, F.count_if(own)).alias(f"count_{s}"),
                 F.when(F.count_if(labelled) > 0, 1).otherwise(0).alias(f"status_{s}")]
    return (rows.filter(_real(rows, "donor")).groupBy(F.col("donor").alias(DONOR)).agg(*aggs, *(more or []))
            .filter(F.col("participated_events") > 0))


def window_values(rows: DataFrame, columns: dict, limit: int) -> dict[str, list | None]:
    """The distinct values, as text and without the missing one, of each column over the donors' window payments;
    None for a column that has more than ``limit``."""
    own = rows.filter(F.col("win") & _real(rows, "donor"))
    each = [own.select(F.lit(name).alias("name"), c.cast("string").alias("v")).filter("v is not null").distinct().limit(limit + 1)
            for name, c in columns.items()]
    got: dict[str, list | None] = {name: [] for name in columns}
    for r in reduce(DataFrame.unionByName, each).collect():  # at most limit + 1 a column
        got[r["name"]].append(r["v"])
    return {name: sorted(v) if len(v) <= limit else None for name, v in got.items()}


def _marked(place: str, values: int) -> F.Column:
    """How many different places, from 0 to ``values``, a donor's window payments have: a bit for each, 64 to a number."""
    p, counts = F.col(place), []
    for word in range(values // 64 + 1):
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (p - 64 * word).cast("int"))
        counts.append(F.bit_count(F.coalesce(F.bit_or(F.when(F.col("win") & (F.shiftright(p, 6) == word), bit)),
                                             F.lit(0).cast("long"))))
    return reduce(lambda a, b: a + b, counts).cast("long")


def _most_frequent(column: str, values: list) -> F.Column:
    """The value of most window payments, ties to the first, NA last, from a sum per value."""
    c, w = F.col(column), F.col("win")
    ranked = [F.struct((-n).alias("k1"), F.lit(v is None).alias("k2"), F.lit(v).cast("string").alias("k3"))
              for v, n in [(v, F.count_if(w & (c.isNull() if v is None else c == v))) for v in [*values, None]]]
    return F.array_min(F.array(*ranked))["k3"]


def _counted(rows: DataFrame) -> tuple[DataFrame, list, list[DataFrame]]:
    """Distinct counts and the usual method: ``rows`` with the places of values beside them, the aggregates of columns
    with few values, and the parts of the others. The aggregates keep a number or a few per donor, whatever its payments."""
    columns = {"dist_events": F.col("prog"), "yrs_donated": F.year("d"), "dist_cards": _card()}
    few = window_values(rows, {**columns, "pay_type": F.col("type")}, MAX_MARKED)
    marked, aggs, parts = rows, [], []
    for name, c in columns.items():
        values = few[name]
        if values is None:
            parts.append(distinct_per_donor(rows, name, c.alias("value")))
            continue
        known = F.array(*[F.lit(v) for v in values]).cast("array<string>" if name == "dist_events" else "array<int>")
        # 0: a missing value, which counts as one
        marked = marked.withColumn(f"at_{name}", F.coalesce(F.array_position(known, c), F.lit(0).cast("long")))
        aggs.append(_marked(f"at_{name}", len(values)).alias(name))
    if few["pay_type"] is not None and len(few["pay_type"]) <= MAX_SUMMED:
        aggs.append(_most_frequent("type", few["pay_type"]).alias("pay_type"))
    else:
        parts.append(usual_method(rows))
    return marked, aggs, parts


def distinct_per_donor(rows: DataFrame, name: str, *values) -> DataFrame:
    """Distinct window values per donor (a missing value counts): distinct by donor and
    value first, so a hot donor stays spread, then a count per donor."""
    own = rows.filter(F.col("win") & _real(rows, "donor")).select("donor", *values).distinct()
    return own.groupBy(F.col("donor").alias(DONOR)).agg(F.count(F.lit(1)).alias(name))


def _card() -> F.Column:
    """Card expiry as one number (a missing part is a part of its own)."""
    return (F.coalesce("yr", F.lit(-1)) * 100 + F.coalesce("mo", F.lit(-1))).alias("card")


def usual_method(rows: DataFrame) -> DataFrame:
    """most window payments, ties to the first method, NA last."""
    per = (rows.filter(F.col("win") & _real(rows, "donor")).groupBy("donor", "type")
           .agg(F.count(F.lit(1)).alias("n")))
    best = F.min(F.struct((-F.col("n")).alias("k1"), F.col("type").isNull().alias("k2"), F.col("type").alias("k3")))
    return per.groupBy(F.col("donor").alias(DONOR)).agg(best["k3"].alias("pay_type"))


def hosted(rows: DataFrame) -> DataFrame:
    """window payments per host."""
    return (rows.filter(F.col("win") & _real(rows, "host")).groupBy(F.col("host").alias(DONOR))
            .agg(F.count(F.lit(1)).alias("hosted_events")))


def donor_base(spark: SparkSession, sf_dir: str, programs: dict | None = None, year: int = FEATURE_YEAR,
               label_year: int = LABEL_YEAR, as_of_year: int | None = None,
               last_3_variant: str = "literal", pe: DataFrame | None = None) -> DataFrame:
    """Base table + program columns from the narrow payment table (plus the commitments).

    The parts are joined on the donor: all have one row per donor and the same
    hash partitioning, so each is shuffled once, after its partial aggregation.
    """
    parts = donor_parts(spark, sf_dir, programs, year, label_year, as_of_year, last_3_variant, pe)
    return _joined(parts)


def donor_parts(spark: SparkSession, sf_dir: str, programs: dict | None = None, year: int = FEATURE_YEAR,
                label_year: int = LABEL_YEAR, as_of_year: int | None = None,
                last_3_variant: str = "literal", pe: DataFrame | None = None) -> list[DataFrame]:
    """The parts of the base table, each with one row per donor; the first has all donors.

    With payments of :func:`keyed_events` donors are numbers; :func:`_joined` turns them into ids.
    """
    rows = payment_rows(pe if pe is not None else ft.pay_events(spark, sf_dir), year)
    ids = {"id_of": tables.const_key} if _numbers(rows, "donor") else {}
    marked, aggs, others = _counted(rows)
    base = donor_sums(marked, programs if programs is not None else PROGRAMS, label_year, as_of_year, aggs)
    if last_3_variant == "recent":
        base = base.drop("last_3").withColumnRenamed("last_3_recent", "last_3")
    else:
        base = base.drop("last_3_recent")
    return [base, *others, distinct_per_donor(rows, "paid_instances", "inst"), hosted(rows),
            ft.feat_instance_count(spark, sf_dir, **ids)]


def _joined(parts: list[DataFrame]) -> DataFrame:
    base, *others = parts
    for part in others:
        base = base.join(part, DONOR, "left")
    if _numbers(base, DONOR):
        base = base.withColumn(DONOR, tables.const_id(F.col(DONOR)))
    return base


def donor_tables(spark: SparkSession, sf_dir: str, programs: dict | None = None, buckets: int | None = None,
                 **kw) -> list[DataFrame]:
    """:func:`donor_parts` for all programs, written once as tables bucketed by donor, for use by many datasets."""
    kw.setdefault("pe", keyed_events(spark, sf_dir))
    return [bucketed(p, DONOR, buckets) for p in donor_parts(spark, sf_dir, programs or PROGRAMS, **kw)]


def program_datasets(tables: list[DataFrame], programs: dict | None = None) -> DataFrame:
    """A6-A9 in one table: the dataset of every program, one after the other for each donor.

    Joins of bucketed tables: no exchange, and one pass for all programs.
    """
    per = [F.struct(F.lit(p).alias("program"), F.col(f"total_amt_{s}").alias("total_amt"), F.col(f"count_{s}").alias("count"),
                    F.col(f"status_{s}").cast("int").alias("status")) for p, s in (programs or PROGRAMS).items()]
    base = _joined(tables).withColumn("p", F.explode(F.array(*per)))
    return base.select("p.program", *ft.CONST_BASE_COLUMNS, "p.total_amt", "p.count", "total_donated", "total_count", "p.status")
