"""Findings of a stream of changes: batches of head findings against a fixed base."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veinwork.operators import change


def new_findings(stream: DataFrame, base: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch of findings (rule_id, file, line) is compared with ``base``; the grown identities go to ``sink``."""

    def batch(head: DataFrame, number: int) -> None:
        sink(change.grown(base, head).filter("head_n > base_n"), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def windowed_findings(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """rule_id, window, n of findings (rule_id, ts): event-time counts with a watermark."""
    counted = stream.withWatermark("ts", late).groupBy("rule_id", F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("rule_id", F.col("w.start").alias("window_start"), "n")
