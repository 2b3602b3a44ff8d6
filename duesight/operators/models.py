"""Trained models with pyspark.ml: boosted trees, stack, isotonic calibration.

The trained models of record are not public. These are fitted on the data at
hand, with the label "any of the three bad-debt events happened by the snapshot".
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duesight.operators.history import event_columns
from duesight.session import scratch_path
from duesight.settings import FEATURES

#: Rows that a task of a fit holds at most, about 350 bytes each.
PART_ROWS = 250_000


def bad_debt_label(snapshot) -> Column:
    """1 when an event date exists; needs the payment facts."""
    return F.coalesce(*event_columns(snapshot).values()).isNotNull().cast("int")


def feature_matrix(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("CUSTOMER_TRX_ID", *more, *[F.col(c).cast("double").alias(c) for c in FEATURES])


def _prepared() -> list:
    filled = [f"{c}_filled" for c in FEATURES]
    return [
        Imputer(inputCols=FEATURES, outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="features"),
    ]


def positive(vector: str) -> Column:
    return vector_to_array(F.col(vector))[1]


def in_parts(rows: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Rows dealt to parts of about `part_rows`: a fit caches each part whole, and a table is read in few parts."""
    parts = -(-rows.count() // part_rows)
    return rows if parts <= rows.sparkSession.sparkContext.defaultParallelism else rows.repartition(parts)


def fit_features(train: DataFrame, steps: list) -> PipelineModel:
    """The preparation fitted on all rows, then each step on the label and the features, in parts of bounded size.

    The steps go through their rows about six times, so these are made once and held, on disk where memory is short.
    """
    made = Pipeline(stages=_prepared()).fit(train)
    points = in_parts(made.transform(train).select("label", "features")).persist()
    try:
        return PipelineModel(stages=[*made.stages, *Pipeline(stages=steps).fit(points).stages])
    finally:
        points.unpersist()


def fit_boosted(train: DataFrame, trees: int = 10, depth: int = 4) -> PipelineModel:
    tree = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, seed=7)
    return fit_features(train, [tree])


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    out = model.transform(rows)
    return out.select("CUSTOMER_TRX_ID", positive("probability").alias("prob_bad_debt"))


def without_summaries(model: PipelineModel) -> PipelineModel:
    """The model with its logistic steps written out and read back.

    A fitted one carries its training summary to the tasks, which refers to the session, and a session in which rows
    were observed can't be serialised.
    """

    def read_back(step):
        if not isinstance(step, LogisticRegressionModel):
            return step
        path = scratch_path(SparkSession.active(), "logit")
        step.save(path)
        return LogisticRegressionModel.load(path)

    return PipelineModel(stages=[read_back(step) for step in model.stages])


def fit_bases(train: DataFrame, trees: int, depth: int) -> PipelineModel:
    tree = GBTClassifier(
        featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, seed=7
    ).setPredictionCol("tree_class").setRawPredictionCol("tree_raw").setProbabilityCol("tree_p")
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
    logit = LogisticRegression(
        featuresCol="scaled", labelCol="label", predictionCol="logit_class",
        rawPredictionCol="logit_raw", probabilityCol="logit_p",
    )
    return without_summaries(fit_features(train, [tree, scaler, logit]))


def fold_of(by: str, row_id: str = "CUSTOMER_TRX_ID", folds: int = 3) -> Column:
    """Rows of one key share a fold; rows without a key are dealt by their id."""
    return F.pmod(F.when(F.col(by).isNull(), F.xxhash64(row_id)).otherwise(F.xxhash64(by)), F.lit(folds))


def fit_stack(train: DataFrame, trees: int = 10, depth: int = 4, by: str = "CUSTOMER_TRX_ID", folds: int = 3) -> PipelineModel:
    """Boosted trees on the features and a logistic on their scaled form, then a logistic on both.

    Cross-fitted: the last step learns from probabilities that base models gave to folds they were not fitted on, so it
    trusts them for what they know about other rows. Folds go by the hash of a key, as the rows of one party tell about
    each other. The base models that stay are fitted on all rows.
    """
    dealt = train.withColumn("_fold", fold_of(by, folds=folds))
    unseen = [
        base_probabilities(fit_bases(dealt.where(F.col("_fold") != k), trees, depth), dealt.where(F.col("_fold") == k), "label")
        for k in range(folds)
    ]
    pair = VectorAssembler(inputCols=["p_tree", "p_logit"], outputCol="pair")
    pairs = reduce(DataFrame.unionByName, unseen).persist()
    try:
        meta = Pipeline(stages=[pair, LogisticRegression(featuresCol="pair", labelCol="label")]).fit(pairs)
    finally:
        pairs.unpersist()
    return PipelineModel(stages=[fit_bases(train, trees, depth), without_summaries(meta)])


def base_probabilities(base, rows: DataFrame, *more: str) -> DataFrame:
    out = base.transform(rows)
    return out.select("CUSTOMER_TRX_ID", *more, positive("tree_p").alias("p_tree"), positive("logit_p").alias("p_logit"))


def predict_stack(model: PipelineModel, rows: DataFrame) -> DataFrame:
    base, meta = model.stages
    return predict(meta, base_probabilities(base, rows))


def fit_isotonic(scored: DataFrame) -> IsotonicRegressionModel:
    """Monotone calibration of prob_bad_debt against label; equal probabilities are one weighted point."""
    points = scored.groupBy(F.col("prob_bad_debt").alias("p")).agg(
        F.avg(F.col("label").cast("double")).alias("label"), F.count("*").cast("double").alias("weight")
    )
    return IsotonicRegression(featuresCol="p", labelCol="label", weightCol="weight").fit(points)


def apply_isotonic(model: IsotonicRegressionModel, scored: DataFrame) -> DataFrame:
    """Add `calibrated`, interpolated between the fitted breakpoints."""
    aimed = model.copy().setFeaturesCol("prob_bad_debt").setPredictionCol("calibrated")
    return aimed.transform(scored)
