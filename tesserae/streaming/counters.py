"""Streaming forms of the matrix counters: running totals of an event stream, per window, with late data bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_totals(events: DataFrame, time: str = "ts", cell: str = "user_id", gene: str = "event_type", value: str = "value", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, cell, gene, value, n): sums of each cell and gene in tumbling windows; rows later than `late` are left out
    and finished windows leave the state. Works on a stream and on a table."""
    w = F.window(time, width)
    out = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(w.alias("w"), F.col(cell).alias("cell"), F.col(gene).alias("gene"))
    return out.agg(F.sum(value).alias("value"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), "cell", "gene", "value", "n")


def running_qc(totals: DataFrame) -> DataFrame:
    """(start, cell, n_features, total) from windowed totals of a table."""
    return totals.groupBy("start", "cell").agg(F.count_if(F.col("value") > 0).alias("n_features"), F.sum("value").alias("total"))
