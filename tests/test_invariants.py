"""Invariants of the workflow on the real test tables."""

import pytest
from pyspark.sql import functions as F

from donorlens.plans import datasets as ds
from donorlens.plans import features as ft
from donorlens.plans import modelling as md


@pytest.fixture(scope="module")
def pe(spark, sf):
    return ft.pay_events(spark, sf)


def test_split_is_complete_and_disjoint(spark, sf):
    train, test, _ = md.prepared(spark, sf)
    mi = md.model_input(ds.program_dataset(spark, sf))
    n = mi.count()
    tr = {r[0] for r in train.select("donor").collect()}
    te = {r[0] for r in test.select("donor").collect()}
    assert len(tr) == int(0.7 * n) and len(tr) + len(te) == n and not tr & te


def test_donor_total_is_sum_of_program_totals_and_pivot(pe):
    by = ds.donations_by_program(pe)
    summed = by.groupBy("DonorConstituentID").agg(
        F.when(F.count("total_amt") == F.count(F.lit(1)), F.sum("total_amt")).alias("s"),
        F.sum("count").alias("c"))
    tot = ds.donor_total(pe)
    j = tot.join(summed, "DonorConstituentID", "full").collect()
    for r in j:
        assert r["total_count"] == r["c"]
        if r["s"] is None:
            assert r["total_donated"] is None
        else:
            assert r["total_donated"] == pytest.approx(r["s"], rel=1e-12)
    wide = ds.donor_donations(pe)
    cnt_cols = [c for c in wide.columns if c.startswith("count_")]
    rows = wide.select("DonorConstituentID", sum((F.col(f"`{c}`") for c in cnt_cols), F.lit(0)).alias("rc"))
    t = {r["DonorConstituentID"]: r["total_count"] for r in tot.collect()}
    for r in rows.collect():
        assert r["rc"] == t[r["DonorConstituentID"]]


def test_label_matches_past_donations(spark, sf, pe):
    ads = ds.program_dataset(spark, sf, "ABMT")
    pos = {r[0] for r in ds.past_don(pe).filter((F.col("ProgramName") == "ABMT") & (F.col("don_year") == 2018))
           .select("DonorConstituentID").collect()}
    for r in ads.select("donor", "status").collect():
        assert r["status"] == (1 if r["donor"] in pos else 0)


def test_base_row_set_is_the_window_donors(spark, sf, pe):
    base = ds.const_base(spark, sf)
    donors = {r[0] for r in ft.feat_dist_events(pe).select("donor").collect()}
    got = [r[0] for r in base.select("donor").collect()]
    assert len(got) == len(set(got)) and set(got) == donors


def test_leak_free_totals_exclude_label_year(spark, sf, pe):
    leak = {r["donor"]: r["total_count"] for r in ds.program_dataset(spark, sf).collect()}
    free = {r["donor"]: r["total_count"] for r in ds.program_dataset(spark, sf, as_of_year=2018).collect()}
    assert set(leak) == set(free)
    assert all((free[d] or 0) <= (leak[d] or 0) for d in leak)
    assert any((free[d] or 0) < (leak[d] or 0) for d in leak)
