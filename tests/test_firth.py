"""Firth's regression against a plain numpy fit, with and without separation."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from donorlens.operators import firth
from donorlens.plans import modelling as md


def plain(x, y, steps=500):
    """Newton steps on the modified score with all rows in memory, on the original scale."""
    z = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-z @ beta))
        w = p * (1 - p)
        inverse = np.linalg.inv((z * w[:, None]).T @ z)
        h = w * np.einsum("ij,jk,ik->i", z, inverse, z)
        move = inverse @ (z.T @ (y - p + h * (0.5 - p)))
        move *= min(1, 2 / np.abs(z @ move).max()) if np.abs(move).max() > 1e-12 else 1
        beta = beta + move
        if np.abs(move).max() < 1e-13:
            break
    return beta, np.sqrt(np.diag(inverse))


def sets():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (300, 3)) * [1, 30, 0.01] + [0, 500, 2]
    mixed = (rng.random(300) < 1 / (1 + np.exp(-x[:, 0] - (x[:, 1] - 500) / 40))).astype(float)
    apart = (x[:, 0] > 0.3).astype(float)
    quasi = np.where(np.abs(x[:, 0] - 0.3) < 0.02, rng.integers(0, 2, 300), apart).astype(float)
    return {"mixed": (x, mixed), "apart": (x, apart), "quasi": (x, quasi)}


@pytest.mark.parametrize("name", ["mixed", "apart", "quasi"])
def test_equals_a_plain_fit(spark, name):
    x, y = sets()[name]
    df = spark.createDataFrame([(r.tolist(), float(c)) for r, c in zip(x, y)], "x array<double>, y double").repartition(5)
    got = firth.fit(df, ["a", "b", "c"])
    beta, se = plain(x, y)
    assert got.converged and got.coefficients == pytest.approx(beta, rel=1e-6, abs=1e-8)
    assert np.sqrt(np.diag(got.covariance)) == pytest.approx(se, rel=1e-5)


def test_two_by_two_table_has_half_counts_added(spark):
    """With one binary column the penalty adds one half to each cell: a closed form, zero cells included."""
    for a, b, c, d in ((5, 3, 2, 7), (6, 0, 0, 4), (0, 5, 5, 0)):
        cells = [(1.0, 1.0, a), (1.0, 0.0, b), (0.0, 1.0, c), (0.0, 0.0, d)]
        df = spark.createDataFrame([([x], y) for x, y, k in cells for _ in range(k)], "x array<double>, y double")
        got = firth.fit(df, ["x"])
        a, b, c, d = (v + 0.5 for v in (a, b, c, d))
        assert got.converged and got.coefficients.tolist() == pytest.approx([math.log(c / d), math.log(a * d / (b * c))], abs=1e-7)


def test_one_class_constant_column_and_no_rows(spark):
    df = spark.createDataFrame([([float(i), 7.0], 1.0) for i in range(20)], "x array<double>, y double")
    got = firth.fit(df, ["i", "seven"])
    assert got.converged and np.isfinite(got.coefficients).all() and got.coefficients[2] == 0
    none = firth.fit(df.filter("false"), ["i", "seven"])
    assert not none.converged and none.coefficients.tolist() == [0, 0, 0]


def test_models_tell_separation_and_convergence(spark):
    rows = [(f"d{i}", float(i), "a" if i % 3 else "b", int(i > 49)) for i in range(100)]
    df = spark.createDataFrame(rows, "donor string, v double, pay_type string, status int")
    preds = ["v", "pay_type"]
    apart = md.logit_fit_stats(md.fit_logit(df, preds)).first()
    assert apart["separation"] == "complete" and not apart["converged"]
    noisy = df.withColumn("status", F.when(F.col("v") % 7 == 0, 1 - F.col("status")).otherwise(F.col("status")))
    fine = md.logit_fit_stats(md.fit_logit(noisy, preds)).first()
    assert fine["separation"] == "none" and fine["converged"]
    coef = {r["term"]: r for r in md.firth_coefficients(md.fit_firth(df, preds)).collect()}
    assert list(coef) == ["(Intercept)", "v", "pay_type_b"] and all(r["converged"] for r in coef.values())
    x = np.array([[r[1], float(r[2] == "b")] for r in rows])
    beta, se = plain(x, np.array([r[3] for r in rows], float))
    assert [r["estimate"] for r in coef.values()] == pytest.approx(beta, rel=1e-5)
    assert [r["std_error"] for r in coef.values()] == pytest.approx(se, rel=1e-4)
    assert all(0 < r["p_value"] <= 1 for r in coef.values())
    scores = md.firth_scores(md.fit_firth(df, preds), df, "train")
    assert scores.filter("(probability > 0.5) = (status = 1)").count() == 100
