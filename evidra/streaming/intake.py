"""Annotation intake as a stream: rows are checked against known units, the first of each unit and rater is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def intake(stream: DataFrame, units: DataFrame, unit: str, rater: str, label: str, time: str, allowed: list[str], delay: str) -> DataFrame:
    """Accepted rows of a stream: a known unit, an allowed label, and no second row of a unit and rater within the watermark."""
    valid = stream.withColumn(time, F.col(time).cast("timestamp")).where(F.col(label).isin(allowed)).join(units.select(unit).distinct(), unit, "left_semi")
    return valid.withWatermark(time, delay).dropDuplicatesWithinWatermark([unit, rater])


def run_intake(accepted: DataFrame, path: str, checkpoint: str) -> None:
    """Appends what is available to a table of files and stops; the checkpoint makes a rerun go on where it ended."""
    accepted.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
