"""Propensity models for one program (script 04), on ``pyspark.ml``.

Pipeline: program dataset -> missing numerics to 0 -> exact-size seeded
70/30 split -> logistic regression (binomial GLM) and random forest -> scores,
exact AUC, confusion statistics -> importances and partial dependence.
SMOTE lives in :mod:`donorlens.operators.smote`.

Deliberate differences from the R workflow (see README):
* ``pred`` (a forest's own predictions) is never a predictor (leakage);
* a forest's bags are Poisson draws by hash instead of draws with replacement
  (:mod:`donorlens.operators.forest`).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from py4j.protocol import Py4JJavaError
from pyspark.errors import UnsupportedOperationException
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from donorlens.functions.special import erfc
from donorlens.operators import firth
from donorlens.operators import forest as RF
from donorlens.operators import metrics as M
from donorlens.operators.quantiles import ordered_prefix_sums
from donorlens.operators.sampling import exact_split, hash52
from donorlens.plans import datasets as ds
from donorlens.session import materialize, staged

# --- fixed values of the workflow ---------------------------------------------
SEED = 1287
TRAIN_FRACTION = 0.7
N_TREES = 100
# predictors removed from the "status ~ . - ..." formulas (suffix: program)
FORMULA_DROPS = ("last_3", "dist_events", "total_donated", "total_count", "total_amt_{s}", "count_{s}")
# predictors named in the first forest (two further names are produced nowhere)
RAW_FOREST_VARS = ("pay_type", "fail_ratio", "dist_events", "count_{s}", "dist_cards",
                   "participated_events", "tenure", "total_amt_{s}")
# variables of the three partial dependence plots
PDP_VARS = ("count_{s}", "dist_cards", "yrs_donated")
PDP_GRID = 51
# ------------------------------------------------------------------------------

NOT_PREDICTORS = ("donor", "status", "pred")
FACTORS = ("pay_type",)
LABEL = "status"


def model_input(ads: DataFrame) -> DataFrame:
    """M3: every missing numeric value set to 0 (a missing factor level stays NULL)."""
    num = [f.name for f in ads.schema.fields
           if isinstance(f.dataType, T.NumericType) and f.name not in ("status",)]
    return ads.na.fill(0, subset=num)


def split(df: DataFrame, seed: int = SEED, fraction: float = TRAIN_FRACTION):
    """M1 + J7: exact-size train (floor(0.7 n)) and its complement."""
    return exact_split(df, "donor", fraction, seed)


def formula_predictors(df: DataFrame, suffix: str) -> list[str]:
    """``status ~ . - <drops>`` over the columns of ``df`` (donor and pred never enter)."""
    drops = {d.format(s=suffix) for d in FORMULA_DROPS}
    return [c for c in df.columns if c not in NOT_PREDICTORS and c not in drops]


def _stages(train: DataFrame, predictors: list[str]) -> tuple[list, list[str]]:
    """Feature stages and the names of the feature vector's entries, in formula order.

    Factor levels are indexed from the training rows; a factor becomes dummies
    without its alphabetically first level (the baseline).
    """
    stages, inputs, names = [], [], []
    for p in predictors:
        if p not in FACTORS:
            inputs.append(p)
            names.append(p)
            continue
        indexer = StringIndexer(inputCol=p, outputCol=f"{p}__i", handleInvalid="error",
                                stringOrderType="alphabetDesc").fit(train)
        # the encoder drops the last index: the alphabetically first level
        stages += [indexer, OneHotEncoder(inputCol=f"{p}__i", outputCol=f"{p}__v", dropLast=True)]
        inputs.append(f"{p}__v")
        names += [f"{p}_{level}" for level in indexer.labels[:-1]]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="error"))
    return stages, names


def _complete(df: DataFrame, predictors: list[str]) -> F.Column:
    return reduce(lambda a, b: a & b, [F.col(p).isNotNull() for p in predictors if p in FACTORS], F.lit(True))


def _fit(train: DataFrame, predictors: list[str], estimator):
    """Pipeline model fitted on the rows without a missing factor; it carries the
    feature names and the factor levels it knows."""
    rows = train.filter(_complete(train, predictors)).withColumn("label", F.col(LABEL).cast("double"))
    stages, names = _stages(rows, predictors)
    model = Pipeline(stages=[*stages, estimator]).fit(rows)
    model._feature_names = names
    model._levels = {p: s.labels for p, s in zip([p for p in predictors if p in FACTORS],
                                                 [s for s in stages if hasattr(s, "labels")])}
    return model


def _scored(model, df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``df`` split into the scored rows and those with a factor level that the model cannot score."""
    known = reduce(lambda a, b: a & b, [F.coalesce(F.col(p).isin(v), F.lit(False))
                                        for p, v in model._levels.items()], F.lit(True))
    df = df.withColumn("label", F.col(LABEL).cast("double"))
    return model.transform(df.filter(known)), df.filter(~known)


def fit_logit(train: DataFrame, predictors: list[str], max_iter: int = 25):
    """M4: binomial GLM with logit link (IRLS), like ``glm(..., family = binomial())``.

    Rows with a missing factor level are left out of the fit (R's ``na.omit``);
    the training set is written once, since every iteration reads it.
    """
    glr = GeneralizedLinearRegression(family="binomial", link="logit", maxIter=max_iter, regParam=0.0,
                                      featuresCol="features", labelCol="label", predictionCol="probability_1")
    train = materialize(train)
    model = _fit(train, predictors, glr)
    model._train, model._max_iter = train, max_iter
    return model


def separation(model) -> str:
    """``complete`` if the fitted predictor of every positive training row is above that of every
    negative one (no finite estimate exists), ``quasi`` if some probabilities are numerically 0 or 1, else ``none``."""
    rows, _ = _scored(model, model._train)
    p, y = F.col("probability_1"), F.col("label")
    low, high, least, most = rows.agg(F.min(F.when(y == 1, p)), F.max(F.when(y == 0, p)), F.min(p), F.max(p)).first()
    if low is not None and high is not None and low > high:
        return "complete"
    return "quasi" if least is not None and (least < 1e-12 or most > 1 - 1e-12) else "none"


def logit_coefficients(model) -> DataFrame:
    """M5: coefficient table (estimate, standard error, z value, p value) of a fitted GLM."""
    spark = SparkSession.getActiveSession()
    glm = model.stages[-1]
    names = ["(Intercept)"] + _feature_names(model)
    est = [glm.intercept] + list(glm.coefficients)
    try:
        s = glm.summary
        se, z, p = list(s.coefficientStandardErrors), list(s.tValues), list(s.pValues)
        # Spark lists the intercept last
        se, z, p = [se[-1]] + se[:-1], [z[-1]] + z[:-1], [p[-1]] + p[:-1]
    except (Py4JJavaError, UnsupportedOperationException):  # singular fit: Spark has no standard errors
        se = z = p = [None] * len(est)
    rows = [(n, float(e), _f(a), _f(b), _f(c)) for n, e, a, b, c in zip(names, est, se, z, p)]
    return spark.createDataFrame(rows, "term string, estimate double, std_error double, "
                                       "z_value double, p_value double")


def logit_fit_stats(model) -> DataFrame:
    """M5 (rest of ``summary(glm)``): deviances, degrees of freedom, AIC, iterations; and whether the fit
    converged to a finite estimate, with the kind of separation that it found."""
    spark = SparkSession.getActiveSession()
    s = model.stages[-1].summary
    kind = separation(model)
    row = (float(s.nullDeviance), int(s.residualDegreeOfFreedomNull), float(s.deviance),
           int(s.residualDegreeOfFreedom), float(s.aic), int(s.numIterations),
           bool(s.numIterations < model._max_iter and kind != "complete"), kind)
    return spark.createDataFrame([row], "null_deviance double, null_df long, residual_deviance double, "
                                        "residual_df long, aic double, iterations int, converged boolean, separation string")


@dataclass
class FirthModel:
    """A penalised regression: the feature stages and the fit."""

    stages: list
    levels: dict[str, list]
    fit: firth.FirthFit


def fit_firth(train: DataFrame, predictors: list[str]) -> FirthModel:
    """M4 under separation: the same formula by Firth's penalised likelihood; rows with a missing factor level are left out."""
    rows = train.filter(_complete(train, predictors)).withColumn("label", F.col(LABEL).cast("double"))
    stages, names = _stages(rows, predictors)
    pipeline = Pipeline(stages=stages).fit(rows)
    encoded = staged(pipeline.transform(rows).select(vector_to_array("features").alias("x"), F.col("label").alias("y")), "design")
    levels = {p: s.labels for p, s in zip([p for p in predictors if p in FACTORS], [s for s in stages if hasattr(s, "labels")])}
    return FirthModel(pipeline.stages, levels, firth.fit(encoded, names))


def firth_coefficients(model: FirthModel) -> DataFrame:
    """Coefficient table of a penalised regression, with Wald tests, iterations and convergence."""
    f = model.fit
    rows = [(n, float(b), float(math.sqrt(max(v, 0.0))), int(f.iterations), bool(f.converged))
            for n, b, v in zip(f.names, f.coefficients, f.covariance.diagonal())]
    table = SparkSession.getActiveSession().createDataFrame(
        rows, "term string, estimate double, std_error double, iterations int, converged boolean")
    z = F.try_divide(F.col("estimate"), F.col("std_error"))
    return table.select("term", "estimate", "std_error", z.alias("z_value"),
                        erfc(F.abs(z) / math.sqrt(2)).alias("p_value"), "iterations", "converged")


def firth_scores(model: FirthModel, df: DataFrame, split_name: str) -> DataFrame:
    """P(status = 1) per donor by a penalised regression; NULL where a factor level is missing or unknown to it."""
    known = reduce(lambda a, b: a & b, [F.coalesce(F.col(p).isin(v), F.lit(False)) for p, v in model.levels.items()], F.lit(True))
    good = df.filter(known)
    for stage in model.stages:
        good = stage.transform(good)
    beta = [float(b) for b in model.fit.coefficients]
    products = F.zip_with(vector_to_array("features"), F.array(*[F.lit(b) for b in beta[1:]]), lambda x, b: x * b)
    eta = F.aggregate(products, F.lit(beta[0]), lambda a, v: a + v)
    columns = ["donor", F.lit(split_name).alias("split"), F.col(LABEL).cast("int").alias(LABEL)]
    return good.select(*columns, (1 / (1 + F.exp(-eta))).alias("probability")).unionByName(
        df.filter(~known).select(*columns, F.lit(None).cast("double").alias("probability")))


def _f(x):
    return None if x is None else float(x)


def _feature_names(model) -> list[str]:
    return list(getattr(model, "_feature_names", []))


def logit_scores(model, df: DataFrame, split_name: str) -> DataFrame:
    """M6: P(status = 1) per donor; NULL where a factor level is missing or unknown to the model."""
    good, rest = _scored(model, df)
    columns = ["donor", F.lit(split_name).alias("split"), F.col(LABEL).cast("int").alias(LABEL)]
    return good.select(*columns, F.col("probability_1").alias("probability")).unionByName(
        rest.select(*columns, F.lit(None).cast("double").alias("probability")))


@dataclass
class ForestModel:
    """A forest, the levels of its factors, and its training rows as it sees them."""

    forest: RF.Forest
    predictors: list[str]
    levels: dict[str, DataFrame]
    train: DataFrame


def _encoded(df: DataFrame, predictors: list[str], levels: dict[str, DataFrame]) -> DataFrame:
    """``(donor, status, rid, y, x, known)``, written once: the predictors as numbers, a factor as the number
    of its level; ``known`` is false where a level is missing or not among ``levels``."""
    d, known = df, F.lit(True)
    for p in predictors:
        if p in levels:
            d = d.join(levels[p].select(p, F.col("level").alias(f"_l_{p}")), p, "left")
            known = known & F.col(f"_l_{p}").isNotNull()
    x = F.array(*[F.coalesce(F.col(f"_l_{p}" if p in levels else p).cast("double"), F.lit(float("nan"))) for p in predictors])
    return staged(d.select("donor", F.col(LABEL).cast("int").alias(LABEL), F.monotonically_increasing_id().alias("rid"),
                           F.col(LABEL).cast("int").alias("y"), x.alias("x"), known.alias("known")), "encoded")


def fit_forest(train: DataFrame, predictors: list[str], n_trees: int = N_TREES, seed: int = SEED,
               max_depth: int | None = None, task_rows: int | None = None) -> ForestModel:
    """Random forest of trees grown until their leaves are pure, the best split of sqrt(p) predictors at each node.

    Rows with a missing factor level are left out. A missing number counts as
    larger than any. ``max_depth`` limits the levels of splits.
    """
    levels = {p: staged(factor_levels(train, p), "levels") for p in predictors if p in FACTORS}
    rows = _encoded(train, predictors, levels)
    forest = RF.fit(rows.filter("known"), "donor", list(predictors), [p in levels for p in predictors], n_trees, seed,
                    max_depth=max_depth, task_rows=task_rows)
    return ForestModel(forest, list(predictors), levels, rows)


def _class(votes: str, trees: str) -> F.Column:
    return F.when(2 * F.col(votes) > F.col(trees), 1).when(F.col(trees) > 0, 0)


def forest_scores(model: ForestModel, df: DataFrame, split_name: str) -> DataFrame:
    """M15 + M16: the share of trees that vote for class 1 and the predicted class, for every row."""
    rows = _encoded(df, model.predictors, model.levels)
    got = RF.scores(model.forest, rows.filter("known"))
    return rows.join(got, "rid", "left").select(
        "donor", F.lit(split_name).alias("split"), LABEL, (F.col("votes") / F.col("trees")).alias("probability"),
        _class("votes", "trees").alias("predicted"))


def out_of_bag_votes(model: ForestModel) -> DataFrame:
    """``(donor, label, oob_trees, oob_votes, predicted)`` for each training row that the forest knows:
    how many trees did not see it, how many of these vote for class 1, and their majority (null without any)."""
    rows = model.train.filter("known")
    got = RF.out_of_bag(model.forest)
    return rows.select("rid", "donor", F.col("y").alias("label")).join(got, "rid").select(
        "donor", "label", F.col("trees").alias("oob_trees"), F.col("votes").alias("oob_votes"),
        _class("votes", "trees").alias("predicted"))


def bags(train: DataFrame, predictors: list[str], n_trees: int = N_TREES, seed: int = SEED) -> DataFrame:
    """``(tree, bag_size, bag_rows, oob_rows)``: how many draws and rows each tree's bag holds."""
    rows = RF.with_trees(train.filter(_complete(train, predictors)).select("donor"), "donor", n_trees, seed)
    return rows.groupBy("tree").agg(F.sum("w").alias("bag_size"), F.count_if(F.col("w") > 0).alias("bag_rows"),
                                    F.count_if(F.col("w") == 0).alias("oob_rows"))


def scored_metrics(scores: DataFrame, prob: str = "probability", label: str = LABEL) -> DataFrame:
    """M7-M10 on a score table: AUC, threshold 0.5, 2x2 counts and confusion statistics (one row)."""
    pred = scores.withColumn("_pred", M.threshold(prob))
    auc = M.roc_auc(scores, prob, label).select("auc")
    stats = M.confusion_stats(M.confusion_counts(pred, "_pred", label))
    one = F.lit(1).alias("_one")
    return auc.select("*", one).join(stats.select("*", one), "_one").drop("_one")


def forest_gini_importance(model: ForestModel) -> DataFrame:
    """Mean decrease of Gini impurity per predictor, over the trees."""
    return RF.gini_importance(model.forest)


def permutation_importance(model: ForestModel) -> DataFrame:
    """Mean drop in accuracy on the trees' out-of-bag rows when a predictor's values are permuted
    among them, overall and per class, with its standard deviation over the trees."""
    return RF.permutation_importance(model.forest)


def out_of_fold_predictions(train: DataFrame, predictors: list[str], folds: int = 5, n_trees: int = N_TREES,
                            seed: int = SEED) -> DataFrame:
    """``(donor, label, predicted)``: each training row, predicted by a forest that did not see it."""
    d = train.filter(_complete(train, predictors)).withColumn(
        "_fold", F.pmod(hash52(F.col("donor"), f"{seed}:fold"), F.lit(folds)))
    parts = []
    for k in range(folds):
        m = fit_forest(d.filter(F.col("_fold") != k), predictors, n_trees, seed + k)
        parts.append(forest_scores(m, d.filter(F.col("_fold") == k), "fold").select(
            "donor", F.col(LABEL).alias("label"), "predicted"))
    return materialize(reduce(DataFrame.unionByName, parts))


def error_rates(predictions: DataFrame, prefix: str) -> DataFrame:
    """``(<prefix>_error, class0_error, class1_error, n)`` of ``(label, predicted)`` rows; rows without prediction count in ``n`` only."""
    wrong = (F.col("label") != F.col("predicted")).cast("double")
    return predictions.agg(F.avg(wrong).alias(f"{prefix}_error"),
                           F.avg(F.when(F.col("label") == 0, wrong)).alias("class0_error"),
                           F.avg(F.when(F.col("label") == 1, wrong)).alias("class1_error"),
                           F.count(F.lit(1)).alias("n"))


def partial_dependence(model: ForestModel, df: DataFrame, var: str, grid_size: int = PDP_GRID) -> DataFrame:
    """``(value, yhat)``, the average P(status = 1) with ``var`` set to each grid value, for all rows.

    Grid: ``min(grid_size, distinct values)`` equal steps from min to max, as
    doubles. A column without values has no grid: no row.
    """
    if var not in model.predictors or var in model.levels:
        raise ValueError(f"{var} is not a numeric predictor of this model")
    x = F.col(var).cast("double")
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "value double, yhat double")
    n = df.select(x.alias("v")).filter("v is not null").distinct().limit(grid_size).count()  # at most grid_size rows
    grid = [lo + (hi - lo) * i / (n - 1) for i in range(n)] if n > 1 else [lo]
    rows = _encoded(df, model.predictors, model.levels).filter("known")
    return RF.partial_dependence(model.forest, rows, var, grid)


# -- workflow glue -------------------------------------------------------------

def prepared(spark: SparkSession, sf_dir: str, program: str = "Regular Giving", seed: int = SEED,
             materialize_parts: bool = True):
    """Model input for a program, split into (train, test), with the suffix.

    The parts are checkpointed for the model fits, which read them many
    times; a caller that only writes one part passes ``materialize_parts=False``.
    """
    suffix = ds.PROGRAMS.get(program) or program.lower().replace(" ", "_")
    mi = materialize(model_input(ds.program_dataset(spark, sf_dir, program)))
    train, test = split(mi, seed)
    if materialize_parts:
        train, test = materialize(train), materialize(test)
    return train, test, suffix


def factor_levels(df: DataFrame, col: str) -> DataFrame:
    """``(col, level)``: the distinct values of a column, numbered from 1 in order of their UTF-8 bytes."""
    values = df.select(col).filter(F.col(col).isNotNull()).distinct().withColumn("one", F.lit(1))
    return ordered_prefix_sums(values, col, ["one"]).select(col, (F.col("one_before") + 1).cast("int").alias("level"))


def index_levels(df: DataFrame, col: str = "pay_type") -> DataFrame:
    """M2: factor levels of a column (alphabetical, 1-based; level 1 is the baseline)."""
    return factor_levels(df, col).withColumn("is_baseline", F.col("level") == 1)
