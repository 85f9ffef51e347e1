"""Windowed maps from a stream of samples: sums and counts by window and cell, which later batches transform."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_sky(samples: DataFrame, *, time: str = "ts", cell: str = "cell_id", value: str = "value", window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Rows (start, cell_id, n, value) of samples, streamed or not: the mean by window and cell. Samples later than late are left out, so state is bounded; a null value is no sample."""
    timed = samples.where(F.col(value).isNotNull()).withWatermark(time, late)
    grouped = timed.groupBy(F.window(time, window).alias("w"), F.col(cell).alias("cell_id")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("value"))
    return grouped.select(F.col("w.start").alias("start"), "cell_id", "n", "value")
