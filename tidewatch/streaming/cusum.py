"""CUSUM over an unbounded stream of scores, one state per indicator."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidewatch.operators.detectors import K_REF, stateful_cusum

OUT = "indicator string, t long, s double, alarm boolean"


def streaming_cusum(z: DataFrame, h: float, k_ref: float = K_REF) -> DataFrame:
    """z is a streaming DataFrame of indicator, t, z; rows of one micro-batch are taken in order of t."""
    return z.groupBy("indicator").applyInPandasWithState(stateful_cusum(h, k_ref), OUT, "s double", "append", "NoTimeout")


def windowed_counts(events: DataFrame, time: str, width: str, late: str, by: list[str]) -> DataFrame:
    """Tumbling counts with a watermark, for streams of raw cases."""
    from pyspark.sql import functions as F

    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))
