"""Drift monitoring over a stream of scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import drift


def watch(stream: DataFrame, reference: DataFrame, base: DataFrame, history: str, checkpoint: str, params: drift.DriftParams = drift.DriftParams()) -> StreamingQuery:
    """Append a drift report for each micro-batch to a Parquet history.

    A batch that is run again after a failure writes its report under the same
    number; readers keep one report per ``batch``.
    """

    def report(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            found = drift.recommendation(drift.detect(drift.summary(reference, base, batch), params))
            found.withColumn("batch", F.lit(number)).withColumn("at", F.current_timestamp()).write.mode("overwrite").parquet(f"{history}/number={number}")

    return stream.writeStream.foreachBatch(report).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
