"""Probability of bad debt and the score table."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duesight.functions.risk import action, expected_loss, risk_level
from duesight.settings import DEFAULT_MODEL_KEY, FEATURES, MODEL_KEYS, SCORECARD, THRESHOLD_HIGH, THRESHOLD_LOW

Weights = Mapping[str, tuple[float, float, float]]

# Columns of a scored table, in order.
SCORE_COLUMNS = [
    "ACCOUNT_NUMBER",
    "CUSTOMER_NAME",
    "SBU",
    "CUSTOMER_TRX_ID",
    "TRX_DATE",
    "DUE_DATE",
    "days_to_due",
    "TRX_AMOUNT_GROSS",
    "credit_memo_reduction",
    "TRX_AMOUNT",
    "expected_financial_loss",
    "prob_bad_debt",
    "risk_level",
    "recommended_action",
]

# Illustrative second scorecard and combination weights, our own as well.
PAYMENT_SCORECARD = (
    -0.2,
    {
        "historical_late_payment_ratio": (60.0, 40.0, 0.60),
        "hist_avg_payment_completion_ratio": (0.6, 0.35, -0.60),
        "hazard_approx": (0.4, 0.35, 0.70),
        "prob_paid_within_60d": (0.5, 0.35, -0.40),
    },
)
STACK = (-2.2, 2.4, 1.8)
PLATT = (-1.1, 2.6)


def resolve_model_key(key: str | None) -> str:
    return key if key in MODEL_KEYS else DEFAULT_MODEL_KEY


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def linear(intercept: float, weights: Weights) -> Column:
    """Scorecard value; a missing feature counts as its centre."""
    terms = [
        f"(coalesce(cast({name} AS double), {centre}D) - {centre}D) / {scale}D * {weight}D"
        for name, (centre, scale, weight) in weights.items()
    ]
    return F.expr(" + ".join([f"{float(intercept)}D", *terms]))


def scorecard_probability(card=SCORECARD) -> Column:
    return sigmoid(linear(*card))


def stacked_probability(first=SCORECARD, second=PAYMENT_SCORECARD, stack=STACK) -> Column:
    """Two base models, combined by a logistic on their probabilities."""
    bias, a, b = stack
    return sigmoid(bias + a * scorecard_probability(first) + b * scorecard_probability(second))


def calibrate_platt(p: Column, platt=PLATT) -> Column:
    bias, slope = platt
    return sigmoid(bias + slope * p)


def with_features(rows: DataFrame) -> DataFrame:
    """A feature the table lacks is a missing value."""
    lacking = [c for c in FEATURES if c not in rows.columns]
    return rows.select("*", *[F.lit(None).cast("double").alias(c) for c in lacking])


#: What a model key stands for: a probability as a column, or a function that adds `prob_bad_debt` to the features,
#: such as a fitted pipeline with its calibration. Both entries are illustrative; pass your own.
Model = Column | Callable[[DataFrame], DataFrame]


def default_models() -> dict[str, Model]:
    return {"stacked": scorecard_probability(), "lgbm_hyper_smote": scorecard_probability(PAYMENT_SCORECARD)}


def score(
    features: DataFrame, model: Model | None = None, low: float = THRESHOLD_LOW, high: float = THRESHOLD_HIGH
) -> DataFrame:
    """Feature table plus prob_bad_debt, loss, level and action."""
    model = scorecard_probability() if model is None else model
    rows = with_features(features)
    rows = rows.withColumn("prob_bad_debt", model) if isinstance(model, Column) else model(rows)
    rows = rows.withColumn("risk_level", risk_level(F.col("prob_bad_debt"), low, high))
    return rows.select(
        "*",
        expected_loss(F.col("TRX_AMOUNT"), F.col("prob_bad_debt")).alias("expected_financial_loss"),
        action(F.col("risk_level")).alias("recommended_action"),
    )


def score_table(scored: DataFrame) -> DataFrame:
    """The published columns, in order, dates as dates."""
    dates = ("TRX_DATE", "DUE_DATE")
    return scored.select(*[F.to_date(c).alias(c) if c in dates else F.col(c) for c in SCORE_COLUMNS])


def score_with(features: DataFrame, predict: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """Score with a user's own model, batch by batch over Arrow.

    `predict` gets the feature columns in model order and returns probabilities.
    """

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            p = predict(frame[FEATURES].astype("float64"))
            yield pd.DataFrame({"CUSTOMER_TRX_ID": frame["CUSTOMER_TRX_ID"], "prob_bad_debt": p.astype("float64")})

    narrow = with_features(features).select("CUSTOMER_TRX_ID", *FEATURES)
    return narrow.mapInPandas(batches, "CUSTOMER_TRX_ID bigint, prob_bad_debt double")
