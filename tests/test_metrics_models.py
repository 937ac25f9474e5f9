"""Metrics, sampling, SMOTE and model behaviour on small hand-made sets."""

import math

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from donorlens.operators import metrics as M
from donorlens.operators import smote as S
from donorlens.operators.sampling import exact_split, sample_with_replacement
from donorlens.plans import modelling as md


def test_auc_ties_count_half(spark):  # M8, tied_scores
    df = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.9, 1), (0.1, 0)], "s double, y int")
    assert M.roc_auc(df, "s", "y").collect()[0]["auc"] == pytest.approx((1 + 1 + 1 + 0.5) / 4)


def test_auc_matches_exact_evaluator_and_is_rank_invariant(spark):
    rows = [(((i * 37) % 101) / 101.0, int((i * 13) % 7 < 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "s double, y int")
    ours = M.roc_auc(df, "s", "y").collect()[0]["auc"]
    ev = BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="yd", metricName="areaUnderROC", numBins=0)
    ref = ev.evaluate(df.withColumn("yd", F.col("y").cast("double")))
    assert ours == pytest.approx(ref, abs=1e-12)
    mono = M.roc_auc(df.withColumn("s", F.col("s") * 3 + 1), "s", "y").collect()[0]["auc"]
    assert mono == pytest.approx(ours, abs=1e-12)


def test_confusion_one_class_and_stats(spark):  # M9, one_class; M10
    df = spark.createDataFrame([(0, 1), (0, 0), (0, 0)], "p int, y int")
    c = M.confusion_counts(df, "p", "y").collect()[0]
    assert (c["tp"], c["fn"], c["fp"], c["tn"]) == (0, 1, 0, 2)
    cm = spark.createDataFrame([(40, 10, 5, 45)], "tp long, fn long, fp long, tn long")
    s = M.confusion_stats(cm).collect()[0]
    assert s["accuracy"] == pytest.approx(0.85)
    assert s["sensitivity"] == pytest.approx(0.8) and s["specificity"] == pytest.approx(0.9)
    assert s["kappa"] == pytest.approx((0.85 - 0.5) / 0.5)
    assert s["mcnemar_statistic"] == pytest.approx(16 / 15)
    assert s["mcnemar_p_value"] == pytest.approx(math.erfc(math.sqrt(16 / 15 / 2)))


def test_exact_split_size_disjoint_and_partition_independent(spark):
    df = spark.range(1000).select(F.concat(F.lit("Const-"), F.col("id").cast("string")).alias("donor"))
    a, b = exact_split(df, "donor", 0.7, 1287)
    ta = sorted(r[0] for r in a.collect())
    tb = sorted(r[0] for r in b.collect())
    assert len(ta) == 700 and len(tb) == 300 and not set(ta) & set(tb)
    a2, _ = exact_split(df.repartition(7), "donor", 0.7, 1287, rows_per_boundary_bucket=10)
    assert sorted(r[0] for r in a2.collect()) == ta


def test_sample_with_replacement_size(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("k"))
    s = sample_with_replacement(df, 333, 7, "k")
    assert s.count() == 333
    assert s.select("k").distinct().count() <= 50


def _signal_set(spark, n=600):
    rows = []
    for i in range(n):
        x = (i * 7919) % 1000 / 1000.0
        noise = (i * 104729) % 997 / 997.0
        y = 1 if x + 0.1 * noise > 0.75 else 0
        rows.append((f"d{i}", x, noise, y, "a" if i % 3 else "b"))
    return spark.createDataFrame(rows, "donor string, x double, z double, status int, pay_type string")


def test_glm_matches_logistic_regression(spark):
    from pyspark.ml.classification import LogisticRegression
    df = _signal_set(spark).withColumn("x", F.col("x") + F.col("z") * 0.3)  # avoid separation
    df = df.withColumn("status", ((F.col("x") > 0.7) != (F.col("z") > 0.9)).cast("int"))
    m = md.fit_logit(df, ["x", "z"])
    glm = m.stages[-1]
    feats = m.stages[0].transform(df).withColumn("label", F.col("status").cast("double"))
    lr = LogisticRegression(regParam=0.0, featuresCol="features", labelCol="label").fit(feats)
    assert list(glm.coefficients) == pytest.approx(list(lr.coefficients), rel=1e-3, abs=1e-3)
    coef = md.logit_coefficients(m).collect()
    assert [r["term"] for r in coef] == ["(Intercept)", "x", "z"]


def test_forest_importance_and_pdp_follow_signal(spark):
    df = _signal_set(spark)
    preds = ["x", "z", "pay_type"]
    m = md.fit_forest(df, preds, n_trees=20, max_depth=6)
    gini = {r["variable"]: r["mean_decrease_gini"] for r in md.forest_gini_importance(m).collect()}
    assert max(gini, key=gini.get) == "x"
    perm = {r["variable"]: r["mean_decrease_accuracy"] for r in md.permutation_importance(m).collect()}
    assert max(perm, key=perm.get) == "x"
    pdp = sorted((r["value"], r["yhat"]) for r in md.partial_dependence(m, df, "x").collect())
    assert len(pdp) == 51 and pdp[-1][1] > pdp[0][1] + 0.5
    with pytest.raises(ValueError):
        md.partial_dependence(m, df, "not_there")


def test_smote_counts_parents_and_exact_neighbours(spark):
    rows = [(f"d{i}", float(i % 10), float((i * 3) % 7), "a" if i % 2 else "b", 1 if i < 20 else 0)
            for i in range(120)]
    df = spark.createDataFrame(rows, "donor string, u double, v double, pay_type string, status int")
    out = S.smote(df, "status", ["u", "v"], ["pay_type"], perc_over=300, perc_under=100, k=3, seed=5)
    counts = {r["origin"]: r["c"] for r in out.groupBy("origin").agg(F.count("*").alias("c")).collect()}
    assert counts == {"minority": 20, "synthetic": 60, "majority": 60}
    syn = out.filter("origin = 'synthetic'").collect()
    mino = df.filter("status = 1").collect()
    assert all(0 <= r["u"] <= 9 and 0 <= r["v"] <= 6 and r["status"] == 1 for r in syn)
    assert {r["pay_type"] for r in syn} <= {"a", "b"}
    # neighbours equal brute force (distances at ranks 1..k)
    nd = S.neighbour_distances(df, "status", ["u", "v"], ["pay_type"], k=3)
    got = {(r["donor"], r["rank"]): r["distance"] for r in nd.collect()}
    ru = max(r["u"] for r in mino) - min(r["u"] for r in mino)
    rv = max(r["v"] for r in mino) - min(r["v"] for r in mino)
    for a in mino:
        ds = sorted((a["u"] / ru - b["u"] / ru) ** 2 + (a["v"] / rv - b["v"] / rv) ** 2
                    + (0 if a["pay_type"] == b["pay_type"] else 1) for b in mino if b["donor"] != a["donor"])
        for j in range(3):
            assert got[(a["donor"], j + 1)] == pytest.approx(ds[j], abs=1e-12)


def test_knn_visits_with_tiny_cells(spark):
    """Tiny cells force visits to others; the result must still equal brute force."""
    rows = [(f"p{i}", float((i * 17) % 23), float((i * 5) % 11), "a", 1) for i in range(60)]
    df = spark.createDataFrame(rows, "donor string, u double, v double, pay_type string, status int")
    nn, _ = S.knn(df, ["u", "v"], ["pay_type"], k=4, cell_points=2)
    got = {}
    for r in nn.collect():
        got.setdefault(r["_vid"], []).extend([r["_d2"]] * int(r["_nm"]))
    for d, u, v, *_ in rows:
        others = sorted(((u - b) / 22.0) ** 2 + ((v - c) / 10.0) ** 2 for e, b, c, *_ in rows if e != d)
        if d in got:  # the case that names its vector
            assert sorted(got[d])[:4] == pytest.approx(others[:4], abs=1e-12)
    assert len(got) == len({r[1:3] for r in rows})


def test_knn_candidate_pairs_grow_well_below_quadratic(spark):
    """Points of 14 predictors that depend on three quantities, as donors' counts and sums do."""
    import numpy as np

    def pairs(n):
        rng = np.random.default_rng(0)
        base = rng.gamma(2.0, 1.0, (n, 3))
        x = np.hstack([base, base ** 2, np.sqrt(base), base[:, :1] + base[:, 1:2], base.sum(1, keepdims=True),
                       base[:, 1:2] * 2 + 1, base[:, 2:3] * 3, base[:, :1] - base[:, 2:3]])
        assert x.shape[1] == 14
        z = x / np.ptp(x, axis=0)
        pts = spark.createDataFrame([(f"k{i}", f"p{i:06d}", 1, r.tolist(), ["a"]) for i, r in enumerate(z)],
                                    "_vkey string, _vid string, _mult long, z array<double>, n array<string>")
        cells = S.cells_of(pts, 128)
        size = {r["cell"]: r["count"] for r in cells.groupBy("cell").count().collect()}
        asked = S.visits(cells, S.first_pass(cells, 5), 5).groupBy("visited").count().collect()
        return sum(c * c for c in size.values()) + sum(r["count"] * size[r["visited"]] for r in asked)

    small, large = pairs(5_000), pairs(20_000)
    assert large < 0.25 * 20_000 ** 2
    assert large / small < 9  # four times the points; all pairs would be sixteen times


def test_smote_with_fewer_cases_than_neighbours(spark):
    rows = [(f"d{i}", float(i), "a", 1 if i < 3 else 0) for i in range(40)]
    df = spark.createDataFrame(rows, "donor string, u double, pay_type string, status int")
    out = S.smote(df, "status", ["u"], ["pay_type"])
    n = {r["origin"]: r["count"] for r in out.groupBy("origin").count().collect()}
    assert n == {"minority": 3, "synthetic": 48, "majority": 48}
    few = S.smote(df, "status", ["u"], ["pay_type"], perc_over=67)
    n = {r["origin"]: r["count"] for r in few.groupBy("origin").count().collect()}
    assert n == {"minority": 3, "synthetic": 2, "majority": 2}
    with pytest.raises(ValueError):
        S.smote(df.filter("donor not in ('d1', 'd2')"), "status", ["u"], ["pay_type"])


def test_mcnemar_without_correction_where_counts_agree(spark):
    from donorlens.operators import metrics as M
    df = spark.createDataFrame([(40, 10, 10, 40), (40, 20, 10, 40), (5, 0, 0, 5)], "tp long, fn long, fp long, tn long")
    got = [(r["mcnemar_statistic"], r["mcnemar_p_value"]) for r in M.confusion_stats(df).collect()]
    assert got[0] == (0.0, 1.0)
    assert got[1] == (pytest.approx(81 / 30), pytest.approx(0.100348, abs=1e-5))
    assert got[2] == (None, None)


def test_rows_with_a_missing_or_new_factor_keep_their_place(spark):
    df = _signal_set(spark).withColumn("status", ((F.col("x") > 0.7) != (F.col("z") > 0.9)).cast("int"))
    odd = df.limit(20).withColumn("pay_type", F.when(F.col("x") > 0.5, "new").cast("string"))
    logit = md.fit_logit(df.unionByName(odd.filter("pay_type is null")), ["x", "z", "pay_type"])
    forest = md.fit_forest(df.unionByName(odd.filter("pay_type is null")), ["x", "z", "pay_type"], n_trees=5)
    for scores in (md.logit_scores(logit, odd, "test"), md.forest_scores(forest, odd, "test")):
        assert scores.count() == 20 and scores.filter("probability is not null").count() == 0
    assert md.logit_scores(logit, df, "train").filter("probability is null").count() == 0


def test_partial_dependence_grid_has_equal_steps(spark):
    df = _signal_set(spark).withColumn("k", F.floor(F.col("x") * 150).cast("int")).withColumn(
        "u", F.when(F.col("x") < 0.3, 0).when(F.col("x") < 0.6, 1).otherwise(100))
    m = md.fit_forest(df, ["k", "u"], n_trees=5, max_depth=4)
    grid = sorted(r["value"] for r in md.partial_dependence(m, df, "k").collect())
    lo, hi = df.agg(F.min("k"), F.max("k")).first()
    assert grid == pytest.approx([lo + (hi - lo) * i / 50 for i in range(51)])
    grid = sorted(r["value"] for r in md.partial_dependence(m, df, "u").collect())
    assert grid == pytest.approx([0, 50, 100])


def test_split_keeps_null_keys(spark):
    df = spark.createDataFrame([(None,), ("a",), ("b",), ("c",)], "donor string")
    a, b = exact_split(df, "donor", 0.5, 3)
    assert a.count() == 2 and b.count() == 2


def test_write_sorted_keeps_order_on_disk(spark):
    from donorlens.sources import csv_io
    df = spark.createDataFrame([(f"Const-{i}", i * 1.5) for i in (5, 3, 9, 1, 7)], "donor string, x double")
    path = csv_io.scratch_path(spark, "sorted")
    csv_io.write_sorted(df, path, "donor", fmt="rtable", partitions=2)
    files = sorted({r[0] for r in spark.read.text(path).select(F.input_file_name()).collect()})
    lines = [[r[0] for r in spark.read.text(f).collect()] for f in files]
    assert all(x[0] == '"donor" "x"' for x in lines)
    assert [v for x in lines for v in x[1:]] == [f'"Const-{i}" {i * 1.5}' for i in (1, 3, 5, 7, 9)]
    assert sorted(map(tuple, csv_io.read_table(spark, path, df.schema).collect())) == sorted(map(tuple, df.collect()))


def test_text_sink_keeps_every_value(spark):
    import datetime as dt
    from donorlens.sources import csv_io
    texts = ["Regular Giving", 'say "hi"', "two\nlines\r\n", "NA", "", " ", "back\\slash", "\\n", "\\\\n", 'q\\"', None, "#x", "é,;\t"]
    rows = [(t, i, i / 3 if i % 4 else None, dt.date(2020, 1, 1 + i) if i % 3 else None, bool(i % 2))
            for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "a string, b long, c double, d date, e boolean")
    got = csv_io.roundtrip(spark, df.repartition(3))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == rows
    assert csv_io.roundtrip(spark, df.filter("false")).count() == 0


def test_read_csv_detects_separator(spark):
    from donorlens.sources import csv_io
    df = spark.createDataFrame([("Const-1", 2.5, None), ("Const-2", None, "x y")], "a string, b double, c string")
    for sep in ("\t", ";", ","):
        path = csv_io.scratch_path(spark, "csv")
        df.write.option("header", True).option("sep", sep).option("nullValue", "NA").csv(path)
        back = csv_io.read_csv(spark, path, df.schema)
        assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
