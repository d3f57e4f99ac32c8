"""Streaming variants.

The reference is batch only; these are the operators whose semantics carry over to
an unbounded input unchanged or with a stated difference:

* event cleaning: coercion and drops are row-local; keep-first per (customer, time)
  becomes ``dropDuplicatesWithinWatermark`` — first by *arrival*, not by ``seq``;
* intent routing of request texts: row-local;
* the consent-gated memory append: ``foreachBatch`` runs the batch ``save`` on each
  micro-batch and writes its stored rows and audit rows under ``batch_id=<id>``; a
  retried batch replaces its own folders, so nothing is stored twice.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.parsing import nan_to_null
from ..functions.text import route_query
from ..operators import memory as mem
from ..operators.quality import typed_events


def clean_event_stream(stream: DataFrame, value_col: str, watermark: str = "1 day") -> DataFrame:
    typed = typed_events(stream, value_col).na.drop(subset=["customer_id", "timestamp"])
    deduped = typed.withWatermark("timestamp", watermark).dropDuplicatesWithinWatermark(["customer_id", "timestamp"])
    return deduped.where(nan_to_null(F.col(value_col)).isNotNull()).select("customer_id", "timestamp", value_col)


def route_stream(texts: DataFrame, text_col: str = "text") -> DataFrame:
    return texts.select("*", route_query(F.col(text_col)).alias("route")).select("*", "route.*").drop("route")


def memory_sink(entries: DataFrame, memories_path: str, audit_path: str, checkpoint: str, as_of=None, trigger_once: bool = True) -> StreamingQuery:
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        saved = mem.save(batch, as_of=as_of)
        saved["stored"].write.mode("overwrite").parquet(f"{memories_path.rstrip('/')}/batch_id={batch_id}")
        saved["audit"].write.mode("overwrite").parquet(f"{audit_path.rstrip('/')}/batch_id={batch_id}")

    w = entries.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()
