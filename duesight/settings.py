"""Fixed values of the data model: thresholds, ranges, feature list, defaults."""

from __future__ import annotations

# Lookback presets in days, and the day count of the open range.
RANGE_DAYS = {"1w": 7, "2w": 14, "1m": 30, "3m": 90, "6m": 180, "1y": 365}
ALL_DAYS = 99999
COVER_DAYS = {**RANGE_DAYS, "all": ALL_DAYS}

# Risk thresholds on the bad-debt probability.
THRESHOLD_LOW = 0.3
THRESHOLD_HIGH = 0.6

# Action text per risk level.
ACTIONS = {
    "HIGH": "ESKALASI - Follow-up tim collection segera",
    "MEDIUM": "WATCHLIST - Monitor & kirim reminder pembayaran",
    "LOW": "OK - Monitoring rutin",
}
UNKNOWN_ACTION = "Unknown"
RISK_LEVELS = ("HIGH", "MEDIUM", "LOW")

# Model keys, and the one used for an unknown key.
MODEL_KEYS = ("stacked", "lgbm_hyper_smote")
DEFAULT_MODEL_KEY = "stacked"

# Paging bounds and report sizes.
PAGE_SIZE = 50
MAX_PAGE_SIZE = 200
TOP_LOSS_ROWS = 50
PREVIEW_ROWS = 20

# How long runs and published rows are kept, in days.
KEEP_RUN_DAYS = 30
KEEP_PUBLISHED_DAYS = 1

# Tolerance for an unpaid rest, and the minimum age to observe.
UNPAID_EPS = 0.01
OBSERVE_MIN_DAYS = 180

# The model features, in model order.
FEATURES = [
    "TRX_AMOUNT_log1p",
    "days_to_due",
    "party_prior_invoice_cnt",
    "customer_maturity_days",
    "business_scale_proxy",
    "historical_avg_dpd",
    "historical_late_payment_ratio",
    "unpaid_exposure_ratio",
    "payment_consistency_variance",
    "historical_partial_payment_freq",
    "hist_avg_payment_completion_ratio",
    "total_outstanding_at_trx",
    "prob_paid_within_30d",
    "prob_paid_within_60d",
    "median_payment_delay",
    "hazard_approx",
]

# What a party without history gets.
COLD_START = {
    "customer_maturity_days": 0,
    "business_scale_proxy": 0.0,
    "historical_avg_dpd": 0.0,
    "historical_late_payment_ratio": 0.0,
    "unpaid_exposure_ratio": 0.0,
    "payment_consistency_variance": 0.0,
    "historical_partial_payment_freq": 0.0,
    "hist_avg_payment_completion_ratio": 0.0,
    "total_outstanding_at_trx": 0.0,
    "prob_paid_within_30d": 0.5,
    "prob_paid_within_60d": 0.5,
    "median_payment_delay": 0.0,
    "hazard_approx": 0.0,
}

# Illustrative scorecard: the trained models are not public, so these weights
# are our own. intercept, {feature: (centre, scale, weight)}
SCORECARD = (
    -0.4,
    {
        "TRX_AMOUNT_log1p": (12.0, 2.0, 0.15),
        "days_to_due": (45.0, 30.0, 0.10),
        "party_prior_invoice_cnt": (5.0, 5.0, -0.10),
        "customer_maturity_days": (900.0, 700.0, -0.05),
        "business_scale_proxy": (12.0, 5.0, -0.05),
        "historical_avg_dpd": (60.0, 80.0, 0.35),
        "historical_late_payment_ratio": (60.0, 40.0, 0.40),
        "unpaid_exposure_ratio": (0.3, 0.3, 0.30),
        "payment_consistency_variance": (2000.0, 3000.0, 0.05),
        "historical_partial_payment_freq": (60.0, 40.0, -0.10),
        "hist_avg_payment_completion_ratio": (0.6, 0.35, -0.45),
        "total_outstanding_at_trx": (400000.0, 500000.0, 0.15),
        "prob_paid_within_30d": (0.4, 0.35, -0.25),
        "prob_paid_within_60d": (0.5, 0.35, -0.15),
        "median_payment_delay": (60.0, 80.0, 0.20),
        "hazard_approx": (0.4, 0.35, 0.50),
    },
)
