"""The segmentation run as one lazy plan graph.

``SegmentationRun`` wires the operators together once; each attribute is a lazy
DataFrame, so a caller materialises only the outputs it asks for and Catalyst shares
the common sub-plans (exchange reuse) inside each job. The features table (one row
per customer, read by every later step) is checkpointed into the shared checkpoint
folder once, which also keeps the later plans short.
"""
from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SegmentConfig
from ..operators import candidates, features, quality, rules, splits
from ..session import cut_lineage


@dataclass
class SegmentationRun:
    frames: Mapping[str, DataFrame]
    config: SegmentConfig = field(default_factory=SegmentConfig)

    @cached_property
    def cleaned(self) -> dict[str, DataFrame]:
        return quality.clean_frames(self.frames)

    @cached_property
    def features(self) -> DataFrame:
        # one row per customer, read by every later step: checkpointed once
        return cut_lineage(features.build_customer_features(self.frames, self.config))

    @cached_property
    def labelled(self) -> DataFrame:
        return splits.hash_split(self.features, self.config)

    def part(self, name: str) -> DataFrame:
        return self.labelled.where(F.col("split") == name)

    @cached_property
    def thresholds(self) -> DataFrame:
        # one row, read by segmentation, candidates and the audit: materialised once
        return cut_lineage(rules.derive_rule_thresholds(self.part("train"), self.config))

    @cached_property
    def segmented(self) -> DataFrame:
        return rules.assign_rule_segments(self.labelled, self.thresholds, self.config)

    # the four intents of the reference's run
    def segment_customers(self) -> DataFrame:
        return self.segmented

    def explain_segment(self) -> DataFrame:
        return rules.explain_segments(self.segmented)

    def compare_segments(self) -> DataFrame:
        return rules.segment_profiles(self.segmented)

    def recommend_conversion(self, limit: int = 25) -> DataFrame:
        return candidates.priority_candidates(self.segmented, self.thresholds, limit)

    def segment_counts(self) -> DataFrame:
        return rules.segment_counts(self.segmented)

    def final_test_report(self) -> DataFrame:
        return rules.final_test_report(self.part("test"), self.thresholds, self.config)


INTENT_OUTPUTS = {
    "segment_customers": SegmentationRun.segment_customers,
    "explain_segment": SegmentationRun.explain_segment,
    "compare_segments": SegmentationRun.compare_segments,
    "recommend_conversion": SegmentationRun.recommend_conversion,
}
