"""Fixed values that results depend on: names, lists, lookup tables and limits."""

from __future__ import annotations

# --- fixed values: country -> IANA zone used for local time -------------------
COUNTRY_ZONES = {
    "US": "America/New_York",
    "GB": "Europe/London",
    "FR": "Europe/Paris",
    "DE": "Europe/Berlin",
    "IT": "Europe/Rome",
    "ES": "Europe/Madrid",
    "CA": "America/Toronto",
    "AU": "Australia/Sydney",
    "JP": "Asia/Tokyo",
    "BR": "America/Sao_Paulo",
}

# --- fixed values: zone map of the exploratory feature variant ----------------
EXPLORATORY_ZONES = {
    "US": "America/New_York",
    "GB": "Europe/London",
    "FR": "Europe/Paris",
    "DE": "Europe/Berlin",
    "IT": "Europe/Rome",
    "ES": "Europe/Madrid",
    "NL": "Europe/Amsterdam",
    "PL": "Europe/Warsaw",
    "RO": "Europe/Bucharest",
    "TR": "Europe/Istanbul",
}

# --- fixed values: the model's feature columns, by role -----------------------
CATEGORICAL_FEATURES = ["channel"]
CONTINUOUS_FEATURES = [
    "account_age_days",
    "total_transactions_user",
    "avg_amount_user",
    "amount",
    "shipping_distance_km",
    "hour_local",
    "day_of_week_local",
    "month_local",
    "amount_deviation",
    "amount_vs_avg_ratio",
    "transaction_velocity",
    "security_score",
]
BINARY_FEATURES = [
    "promo_used",
    "avs_match",
    "cvv_result",
    "three_ds_flag",
    "is_weekend_local",
    "is_late_night_local",
    "is_business_hours_local",
    "is_micro_transaction",
    "is_large_transaction",
    "is_new_account",
    "is_high_frequency_user",
    "country_mismatch",
    "high_risk_distance",
    "zero_distance",
    "new_account_with_promo",
    "late_night_micro_transaction",
    "high_value_long_distance",
]
MODEL_COLUMNS = CATEGORICAL_FEATURES + CONTINUOUS_FEATURES + BINARY_FEATURES

# --- fixed values: output order of the feature transformer --------------------
FINAL_FEATURES = [
    "account_age_days",
    "total_transactions_user",
    "avg_amount_user",
    "amount",
    "shipping_distance_km",
    "channel",
    "promo_used",
    "avs_match",
    "cvv_result",
    "three_ds_flag",
    "hour_local",
    "day_of_week_local",
    "month_local",
    "is_weekend_local",
    "is_late_night_local",
    "is_business_hours_local",
    "amount_deviation",
    "amount_vs_avg_ratio",
    "is_micro_transaction",
    "is_large_transaction",
    "transaction_velocity",
    "is_new_account",
    "is_high_frequency_user",
    "country_mismatch",
    "high_risk_distance",
    "zero_distance",
    "security_score",
    "new_account_with_promo",
    "late_night_micro_transaction",
    "high_value_long_distance",
]

# --- fixed values: display names of the features ------------------------------
FEATURE_LABELS = {
    "account_age_days": "Account Age (days)",
    "total_transactions_user": "Total User Transactions",
    "avg_amount_user": "User Average Transaction Amount",
    "amount": "Transaction Amount",
    "shipping_distance_km": "Shipping Distance (km)",
    "channel": "Transaction Channel",
    "promo_used": "Promo Code Used",
    "avs_match": "Address Verification Match",
    "cvv_result": "CVV Verification Result",
    "three_ds_flag": "3D Secure Enabled",
    "hour_local": "Hour of Day (local)",
    "day_of_week_local": "Day of Week (local)",
    "month_local": "Month",
    "is_weekend_local": "Weekend Transaction",
    "is_late_night_local": "Late Night Transaction (11PM-4AM)",
    "is_business_hours_local": "Business Hours Transaction (9AM-5PM)",
    "amount_deviation": "Amount Deviation from User Average",
    "amount_vs_avg_ratio": "Amount vs User Average Ratio",
    "is_micro_transaction": "Micro Transaction (under $5)",
    "is_large_transaction": "Large Transaction (top 5%)",
    "transaction_velocity": "Transaction Velocity (per day)",
    "is_new_account": "New Account (30 days or less)",
    "is_high_frequency_user": "High Frequency User",
    "country_mismatch": "Country Mismatch (card vs transaction)",
    "high_risk_distance": "High Risk Shipping Distance",
    "zero_distance": "Same Billing/Shipping Address",
    "security_score": "Security Score (0-3)",
    "new_account_with_promo": "New Account Using Promo",
    "late_night_micro_transaction": "Late Night Micro Transaction",
    "high_value_long_distance": "High Value + Long Distance",
}

# --- fixed values: raw columns ------------------------------------------------
RAW_NUMERIC = [
    "account_age_days",
    "total_transactions_user",
    "avg_amount_user",
    "amount",
    "shipping_distance_km",
]
RAW_CATEGORICAL = [
    "country",
    "bin_country",
    "channel",
    "merchant_category",
    "promo_used",
    "avs_match",
    "cvv_result",
    "three_ds_flag",
]
RAW_FLAGS = ["promo_used", "avs_match", "cvv_result", "three_ds_flag"]
REQUEST_COLUMNS = [
    "user_id",
    "account_age_days",
    "total_transactions_user",
    "avg_amount_user",
    "amount",
    "country",
    "bin_country",
    "channel",
    "merchant_category",
    "promo_used",
    "avs_match",
    "cvv_result",
    "three_ds_flag",
    "shipping_distance_km",
    "transaction_time",
]

# --- fixed values: split, decision and risk-band defaults ---------------------
DEFAULT_SEED = 1
TEST_SHARE = 0.2
VALIDATION_SHARE_OF_REST = 0.25
CV_FOLDS = 4
DEFAULT_THRESHOLD = 0.5
MIN_PRECISION = 0.70
RISK_BANDS = {"low": 0.3, "medium": 0.7, "high": 1.0}
RECALL_TARGETS = {
    "conservative_90pct_recall": 0.90,
    "balanced_85pct_recall": 0.85,
    "aggressive_80pct_recall": 0.80,
}
STRATEGY_TITLES = {
    "optimal_f1": "Optimal F1 (Best Balance)",
    "target_performance": "Target Performance (>=70% Prec)",
    "conservative_90pct_recall": "Conservative (90% Recall)",
    "balanced_85pct_recall": "Balanced (85% Recall)",
    "aggressive_80pct_recall": "Aggressive (80% Recall)",
}
STRATEGY_NOTES = {
    "optimal_f1": "Optimal F1 score - best precision-recall balance",
    "target_performance": "Max recall while maintaining >=70% precision (recommended)",
    "conservative_90pct_recall": "Catch most fraud (90% recall), accept more false positives",
    "balanced_85pct_recall": "Balanced precision-recall trade-off (85% recall target)",
    "aggressive_80pct_recall": "Prioritize precision (80% recall), reduce false positives",
}

# --- fixed values: evaluation metrics, in reporting order ---------------------
METRICS = ["pr_auc", "roc_auc", "f1", "precision", "recall", "accuracy"]

# --- fixed values: tuned parameters of the boosted-tree model -----------------
TUNED_BOOSTED = {
    "n_estimators": 100,
    "max_depth": 4,
    "learning_rate": 0.1,
    "subsample": 0.9,
    "colsample_bytree": 0.9,
    "min_child_weight": 7,
    "gamma": 0.7,
    "reg_alpha": 0.1,
    "reg_lambda": 1.0,
    "scale_pos_weight": 8,
}

# --- fixed values: search grids -----------------------------------------------
FOREST_GRID = {
    "n_estimators": [150, 200, 250, 300],
    "max_depth": [6, 8, 10],
    "min_samples_split": [20],
    "min_samples_leaf": [10],
    "max_features": ["sqrt"],
    "class_weight": ["balanced_subsample"],
}
BOOSTED_GRID = {
    "n_estimators": [90, 100, 110],
    "max_depth": [4, 5],
    "learning_rate": [0.1],
    "subsample": [0.9],
    "colsample_bytree": [0.9],
    "min_child_weight": [7],
    "gamma": [0.6, 0.7],
    "reg_alpha": [0.0, 0.1],
    "reg_lambda": [0, 1.0],
    "scale_pos_weight": [8],
}
FOREST_TREE_COUNTS = [10, 25, 50, 75, 100, 150, 200, 250, 300, 350, 400]
BOOSTED_TREE_COUNTS = [10, 20, 30, 40, 50, 60, 70, 80, 90, 100, 110, 125, 140, 160, 180, 200]
