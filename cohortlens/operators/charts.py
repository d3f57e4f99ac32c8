"""Chart data as tables (the reference renders these as PNG figures).

* segment distribution: customers per segment (see ``rules.segment_counts``);
* box-plot statistics per (segment, feature): quartiles with linear interpolation,
  whiskers at the most extreme values inside ``[q1 - 1.5·IQR, q3 + 1.5·IQR]``,
  outliers not drawn;
* PCA points joined to their segment.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_quantiles

BOX_FEATURES = ("avg_balance_90d", "transaction_frequency_monthly", "recency_days")
WHISKER = 1.5


def boxplot_stats(segmented: DataFrame, features: Sequence[str] = BOX_FEATURES) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features])
    long = segmented.select("segment", F.explode(pairs).alias("_p")).select("segment", "_p.feature", "_p.value").where(
        F.col("value").isNotNull()
    )
    q = exact_quantiles(long, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["segment", "feature"])
    iqr = F.col("q3") - F.col("q1")
    fenced = long.join(q, ["segment", "feature"]).where(
        (F.col("value") >= F.col("q1") - F.lit(WHISKER) * iqr) & (F.col("value") <= F.col("q3") + F.lit(WHISKER) * iqr)
    )
    whiskers = fenced.groupBy("segment", "feature").agg(
        F.min("value").alias("whisker_low"), F.max("value").alias("whisker_high"), F.count(F.lit(1)).alias("inside")
    )
    counts = long.groupBy("segment", "feature").agg(F.count(F.lit(1)).alias("n"))
    return q.join(whiskers, ["segment", "feature"], "left").join(counts, ["segment", "feature"]).select(
        "segment", "feature", "n", "q1", "median", "q3", "whisker_low", "whisker_high",
        (F.col("n") - F.coalesce("inside", F.lit(0))).alias("outliers"),
    )


def pca_points_by_segment(coordinates: DataFrame, segmented: DataFrame) -> DataFrame:
    return coordinates.join(segmented.select("customer_id", "segment"), "customer_id", "left")
