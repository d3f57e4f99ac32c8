"""cohortlens: customer behaviour segmentation as Spark DataFrame operators.

Every public operator takes DataFrames (plus plain parameters) and returns a lazy
DataFrame, so the same code runs on ``local[*]`` and on a cluster.
"""
from .config import FEATURE_COLUMNS, SegmentConfig

__all__ = ["FEATURE_COLUMNS", "SegmentConfig"]
