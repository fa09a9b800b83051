"""Thresholds and fixed values.

FIXED VALUES: the numbers, names and labels below must equal the reference's
for results to match; they are listed plainly, in natural order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---- FIXED VALUES: time -------------------------------------------------
SECOND_US = 1_000_000
MINUTE_US = 60 * SECOND_US
HOUR_US = 3600 * SECOND_US
DAY_US = 86400 * SECOND_US
WEEK_US = 7 * DAY_US

# ---- FIXED VALUES: physics ----------------------------------------------
EARTH_RADIUS_KM = 6371.0
MAX_HUMAN_TRAVEL_SPEED_KMH = 1200.0

# ---- FIXED VALUES: risk levels ------------------------------------------
RISK_LEVELS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
ALERT_LEVELS = ["HIGH", "CRITICAL"]

# ---- FIXED VALUES: feature vector order (20 model inputs) ---------------
FEATURE_ORDER = [
    "amount", "amount_log", "amount_zscore",
    "hour_of_day", "day_of_week", "is_weekend",
    "time_since_last_txn_seconds",
    "txn_count_1h", "txn_count_24h", "txn_count_7d",
    "total_amount_24h",
    "distance_from_last_txn_km", "travel_speed_kmh",
    "is_impossible_travel",
    "user_avg_amount", "user_std_amount",
    "user_txn_count_total", "user_fraud_history_count",
    "velocity_score", "merchant_risk_score",
]

# ---- FIXED VALUES: training-style feature lists -------------------------
TRAIN_NUMERIC_FEATURES = [
    "amount", "amount_log", "amount_zscore", "hour_of_day", "day_of_week",
    "is_weekend", "time_since_last_txn", "txn_count_1h", "txn_count_24h",
    "txn_count_7d", "total_amount_24h", "distance_from_last", "travel_speed",
    "is_impossible_travel", "user_avg_amount", "user_std_amount",
    "user_txn_count", "user_fraud_history", "merchant_risk_score",
    "velocity_score",
]
TRAIN_CATEGORICAL_FEATURES = ["currency", "merchant_category", "channel", "country"]

# ---- FIXED VALUES: histogram bucket bounds ------------------------------
# request duration (seconds), score duration (seconds), model latency
# (seconds), feature-store latency (seconds); +Inf is implicit.
REQUEST_BUCKETS_S = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 1.0]
SCORE_BUCKETS_S = [0.005, 0.01, 0.02, 0.03, 0.04, 0.05, 0.075, 0.1, 0.25]
MODEL_BUCKETS_S = [0.001, 0.005, 0.01, 0.02, 0.03, 0.05, 0.1]
STORE_BUCKETS_S = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1]

# ---- FIXED VALUES: channels ---------------------------------------------
CHANNELS = ["online", "offline", "mobile", "api"]


@dataclass(frozen=True)
class Thresholds:
    """Tunable thresholds; defaults are the reference's values."""
    critical: float = 0.85
    high: float = 0.70
    medium: float = 0.50
    max_speed_kmh: float = MAX_HUMAN_TRAVEL_SPEED_KMH
    suspicious_speed_kmh: float = 800.0
    profile_ttl_us: int | None = DAY_US      # None = lifetime profile
    history_ttl_us: int | None = None        # None = real windows (F5 off)
    high_value_amount: float = 10000.0


@dataclass(frozen=True)
class GBTParams:
    """Boosted-tree settings.

    FIXED VALUES: rounds, depth, step, sampling and rows per leaf. The minimum
    gain is not one of them: a summed loss reduction elsewhere, it is an
    impurity per node in Spark, where rare positives never reach 0.1.
    """
    max_iter: int = 200
    max_depth: int = 6
    step_size: float = 0.1
    subsampling_rate: float = 0.8
    feature_subset: str = "0.8"
    min_instances_per_node: int = 3
    min_info_gain: float = 0.0
    seed: int = 42


@dataclass(frozen=True)
class TrainConfig:
    test_size: float = 0.2
    validation_size: float = 0.1
    seed: int = 42
    n_folds: int = 5
    use_smote: bool = True
    smote_k: int = 5
    tune: bool = False
    gbt: GBTParams = field(default_factory=GBTParams)
    # reference grid: 3 x 3 x 3 x 3
    grid: dict = field(default_factory=lambda: {
        "maxIter": [100, 200, 300],
        "maxDepth": [4, 6, 8],
        "stepSize": [0.05, 0.1, 0.2],
        "subsamplingRate": [0.7, 0.8, 0.9],
    })


DEFAULT = Thresholds()
