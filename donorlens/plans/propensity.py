"""The propensity workflow for one program, as query functions ``(spark, sf_dir) -> DataFrame``.

Each function rebuilds its inputs from the raw tables. Building a frame runs
jobs where a later step reads it several times (model input, splits, balanced
sets are written once to the shared checkpoint folder); nothing is kept across
calls, so every result is a function of the whole tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorlens.operators import metrics as M
from donorlens.operators import smote as S
from donorlens.plans import modelling as md
from donorlens.session import materialize

PROGRAM = "Regular Giving"


def _prep(spark, sf, program=PROGRAM):
    train, test, s = md.prepared(spark, sf, program)
    return train, test, s


def model_input(spark, sf, program=PROGRAM):
    from donorlens.plans import datasets as ds
    return md.model_input(ds.program_dataset(spark, sf, program))


def split_train(spark, sf, program=PROGRAM):
    return md.prepared(spark, sf, program, materialize_parts=False)[0]


def split_test(spark, sf, program=PROGRAM):
    return md.prepared(spark, sf, program, materialize_parts=False)[1]


def index_pay_type(spark, sf, program=PROGRAM):
    return md.index_levels(model_input(spark, sf, program), "pay_type")


def fixed_scores(spark, sf, program=PROGRAM) -> DataFrame:
    """A deterministic score (no model) so metrics can be checked exactly: tenure / (tenure + 365)."""
    mi = model_input(spark, sf, program)
    return mi.select("donor", "status", (F.col("tenure") / (F.col("tenure") + 365.0)).alias("score"))


def threshold_scores(spark, sf):
    s = fixed_scores(spark, sf)
    return s.withColumn("predicted", M.threshold("score"))


def roc_auc(spark, sf):
    return M.roc_auc(fixed_scores(spark, sf), "score", "status")


def confusion_counts(spark, sf):
    return M.confusion_counts(threshold_scores(spark, sf), "predicted", "status")


def confusion_stats(spark, sf):
    return M.confusion_stats(confusion_counts(spark, sf))


def _union(*dfs):
    return reduce(DataFrame.unionByName, dfs)


def logit_fit(spark, sf, program=PROGRAM):
    train, test, s = _prep(spark, sf, program)
    preds = md.formula_predictors(train, s)
    return md.fit_logit(train, preds), train, test, s


def logit_scores(spark, sf):
    m, train, test, _ = logit_fit(spark, sf)
    return _union(md.logit_scores(m, train, "train"), md.logit_scores(m, test, "test"))


def logit_calibration(spark, sf):
    """Positives and summed probabilities of the training rows, per payment method."""
    m, train, _, _ = logit_fit(spark, sf)
    scores = md.logit_scores(m, train, "train").join(train.select("donor", "pay_type"), "donor")
    return (scores.filter("probability is not null").groupBy("pay_type")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("status").alias("positives"),
                 F.round(F.sum("probability"), 3).alias("sum_probability")))


def logit_coefficients(spark, sf):
    m, *_ = logit_fit(spark, sf)
    return md.logit_coefficients(m)


def logit_fit_stats(spark, sf):
    m, *_ = logit_fit(spark, sf)
    return md.logit_fit_stats(m)


def logit_firth_coefficients(spark, sf):
    """The regression by penalised likelihood, which is finite whatever the data."""
    train, _, s = _prep(spark, sf)
    return md.firth_coefficients(md.fit_firth(train, md.formula_predictors(train, s)))


def logit_metrics(spark, sf):
    m, train, test, _ = logit_fit(spark, sf)
    tr = md.scored_metrics(materialize(md.logit_scores(m, train, "train"))).withColumn("split", F.lit("train"))
    te = md.scored_metrics(materialize(md.logit_scores(m, test, "test"))).withColumn("split", F.lit("test"))
    return _union(tr, te)


def forest_fit(spark, sf, program=PROGRAM, n_trees=md.N_TREES):
    """The first forest: the predictors named in the workflow that exist."""
    train, test, s = _prep(spark, sf, program)
    preds = [v.format(s=s) for v in md.RAW_FOREST_VARS]
    return md.fit_forest(train, preds, n_trees), train, test, preds


def rf_scores(spark, sf):
    m, train, test, _ = forest_fit(spark, sf)
    return _union(md.forest_scores(m, train, "train"), md.forest_scores(m, test, "test"))


def rf_class_totals(spark, sf):
    """Rows of the scored splits, per class: every row of both splits is scored once."""
    return rf_scores(spark, sf).groupBy("split", "status").agg(F.count(F.lit(1)).alias("n_rows"))


def rf_metrics(spark, sf):
    m, train, test, _ = forest_fit(spark, sf)
    tr = md.scored_metrics(materialize(md.forest_scores(m, train, "train"))).withColumn("split", F.lit("train"))
    te = md.scored_metrics(materialize(md.forest_scores(m, test, "test"))).withColumn("split", F.lit("test"))
    return _union(tr, te)


def rf_gini_importance(spark, sf):
    m, *_ = forest_fit(spark, sf)
    return md.forest_gini_importance(m)


def rf_permutation_importance(spark, sf):
    m, *_ = forest_fit(spark, sf)
    return md.permutation_importance(m)


def rf_bags(spark, sf):
    """Draws and rows of each tree's bag."""
    train, _, s = _prep(spark, sf)
    return md.bags(train, [v.format(s=s) for v in md.RAW_FOREST_VARS])


def rf_oob_votes(spark, sf):
    m, *_ = forest_fit(spark, sf)
    return md.out_of_bag_votes(m)


def rf_oob_error(spark, sf):
    return md.error_rates(rf_oob_votes(spark, sf), "oob")


def rf_oob_confusion(spark, sf):
    """Confusion table and statistics of the out-of-bag classes of the training rows."""
    return _confusion(materialize(rf_oob_votes(spark, sf)))


def rf_oof_error(spark, sf):
    """Errors of 5-fold predictions by forests that did not see the fold."""
    train, test, s = _prep(spark, sf)
    preds = [v.format(s=s) for v in md.RAW_FOREST_VARS]
    return md.error_rates(md.out_of_fold_predictions(train, preds), "oof")


def _confusion(predictions):
    """2x2 counts and statistics of ``(label, predicted)`` rows, in one row."""
    return M.confusion_stats(M.confusion_counts(predictions, "predicted", "label"))


def rf_oof_confusion(spark, sf):
    """Confusion table and statistics of the held-out predictions of the training rows."""
    train, test, s = _prep(spark, sf)
    return _confusion(md.out_of_fold_predictions(train, [v.format(s=s) for v in md.RAW_FOREST_VARS]))


def _smote_cols(train, s):
    """``SMOTE(status ~ ., ...)``: every column but the label (donor id and pred never enter)."""
    nominal = ["pay_type"]
    numeric = [c for c in train.columns if c not in md.NOT_PREDICTORS and c not in nominal]
    return numeric, nominal


def smote_train(spark, sf, program=PROGRAM):
    train, test, s = _prep(spark, sf, program)
    numeric, nominal = _smote_cols(train, s)
    # every fit, score and profile reads the balanced set: written once
    return materialize(S.smote(train, "status", numeric, nominal)), test, s


def smote_counts(spark, sf):
    bal, _, _ = smote_train(spark, sf)
    return bal.agg(F.count(F.lit(1)).alias("n_rows"),
                   F.count_if(F.col("status") == 1).alias("n_minority"),
                   F.count_if(F.col("status") == 0).alias("n_majority"),
                   F.count_if(F.col("origin") == "synthetic").alias("n_synthetic"))


def smote_neighbours(spark, sf):
    train, test, s = _prep(spark, sf)
    numeric, nominal = _smote_cols(train, s)
    return S.neighbour_distances(train, "status", numeric, nominal)


def smote_rows(spark, sf):
    """The synthetic cases, with all their values."""
    bal, _, _ = smote_train(spark, sf)
    return bal.filter(F.col("origin") == "synthetic").drop("origin")


def _smote_logit(spark, sf):
    bal, test, s = smote_train(spark, sf)
    bal = bal.drop("origin")
    return md.fit_logit(bal, md.formula_predictors(bal, s)), bal, test


def _two(metrics, train, test):
    return _union(metrics(train).withColumn("split", F.lit("smote_train")),
                  metrics(test).withColumn("split", F.lit("test")))


def logit_smote_scores(spark, sf):
    m, bal, test = _smote_logit(spark, sf)
    return _union(md.logit_scores(m, bal, "smote_train"), md.logit_scores(m, test, "test"))


def logit_smote_coefficients(spark, sf):
    m, *_ = _smote_logit(spark, sf)
    return md.logit_coefficients(m)


def logit_smote_fit_stats(spark, sf):
    m, *_ = _smote_logit(spark, sf)
    return md.logit_fit_stats(m)


def _smote_firth(spark, sf):
    bal, test, s = smote_train(spark, sf)
    bal = bal.drop("origin")
    return md.fit_firth(bal, md.formula_predictors(bal, s)), bal, test


def logit_smote_firth_coefficients(spark, sf):
    m, *_ = _smote_firth(spark, sf)
    return md.firth_coefficients(m)


def logit_smote_firth_scores(spark, sf):
    """Penalised regression on the balanced set, the set that can be separated: scores on train and test."""
    m, bal, test = _smote_firth(spark, sf)
    return _union(md.firth_scores(m, bal, "smote_train"), md.firth_scores(m, test, "test"))


def logit_smote_metrics(spark, sf):
    """AUC, confusion table and statistics of the regression on the balanced set, on train and test."""
    m, bal, test = _smote_logit(spark, sf)
    return _two(md.scored_metrics, materialize(md.logit_scores(m, bal, "smote_train")),
                materialize(md.logit_scores(m, test, "test")))


def rf_smote_metrics(spark, sf):
    m, bal, test, _, _ = _smote_forest(spark, sf)
    return _two(md.scored_metrics, materialize(md.forest_scores(m, bal, "smote_train")),
                materialize(md.forest_scores(m, test, "test")))


def rf_smote_gini_importance(spark, sf):
    m, *_ = _smote_forest(spark, sf)
    return md.forest_gini_importance(m)


def rf_smote_permutation_importance(spark, sf):
    m, *_ = _smote_forest(spark, sf)
    return md.permutation_importance(m)


def rf_smote_oob_error(spark, sf):
    m, *_ = _smote_forest(spark, sf)
    return md.error_rates(md.out_of_bag_votes(m), "oob")


def rf_smote_oob_confusion(spark, sf):
    m, *_ = _smote_forest(spark, sf)
    return _confusion(materialize(md.out_of_bag_votes(m)))


def _smote_out_of_fold(spark, sf):
    bal, test, s = smote_train(spark, sf)
    bal = bal.drop("origin")
    return md.out_of_fold_predictions(bal, md.formula_predictors(bal, s))


def rf_smote_oof_error(spark, sf):
    return md.error_rates(_smote_out_of_fold(spark, sf), "oof")


def rf_smote_oof_confusion(spark, sf):
    return _confusion(_smote_out_of_fold(spark, sf))


def _smote_forest(spark, sf):
    bal, test, s = smote_train(spark, sf)
    bal = bal.drop("origin")
    preds = md.formula_predictors(bal, s)
    return md.fit_forest(bal, preds), bal, test, preds, s


def rf_smote_scores(spark, sf):
    m, bal, test, _, _ = _smote_forest(spark, sf)
    return _union(md.forest_scores(m, bal, "smote_train"), md.forest_scores(m, test, "test"))


def pdp_count(spark, sf):
    """Partial dependence on count_<program>: run on the first forest, which has it."""
    m, train, test, preds = forest_fit(spark, sf)
    s = [p for p in preds if p.startswith("count_")][0]
    return md.partial_dependence(m, train, s)


def pdp_grid(spark, sf):
    """The grid of :func:`pdp_count`: equal steps over the values of the training rows."""
    return pdp_count(spark, sf).select(F.round("value", 6).alias("value"))


def pdp_dist_cards(spark, sf):
    m, bal, test, preds, _ = _smote_forest(spark, sf)
    return md.partial_dependence(m, bal, "dist_cards")


def pdp_yrs_donated(spark, sf):
    m, bal, test, preds, _ = _smote_forest(spark, sf)
    return md.partial_dependence(m, bal, "yrs_donated")
