"""Run parameters (defaults of the reference's segmentation run)."""
from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SegmentConfig:
    lookback_days: int = 90
    dormant_days: int = 90
    priority_balance_percentile: float = 0.80
    priority_frequency_percentile: float = 0.70
    random_state: int = 42
    validation_fraction: float = 0.15
    test_fraction: float = 0.20
    cv_folds: int = 5
    max_evaluation_customers: int | None = None  # size of an evaluation sample; None: all customers
    cluster_candidates: tuple[int, ...] = (2, 3, 4, 5)
    overfit_gap_threshold: float = 0.15
    low_silhouette_threshold: float = 0.10
    # Seeds tried per K-Means / GMM configuration (the reference's n_init grid is 10 and 20).
    kmeans_n_init: tuple[int, ...] = (10, 20)
    gmm_n_init: int = 10


FEATURE_COLUMNS = [
    "avg_balance_90d", "min_balance_90d", "balance_stability_90d",
    "transaction_count_90d", "transaction_frequency_monthly",
    "avg_transaction_amount", "median_transaction_amount", "recency_days",
    "active_product_count",
]
