"""The sequences' table: one row per sequence with its frame rate, analysis size and radius."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 270.0


def analysis_scale(width: Column) -> Column:
    """Distances in pixels are meant for an analysis width of 270."""
    return F.greatest(F.lit(1.0), width.cast("double")) / WIDTH


def with_scalars(frames: DataFrame, sequences: DataFrame) -> DataFrame:
    """Every frame with its sequence's fps, width, height, radius and scale; frames of unlisted sequences go."""
    s = sequences.select("seq_id", F.col("fps").cast("double").alias("fps"), F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"), F.col("radius").cast("double").alias("radius"))
    return frames.join(s.withColumn("scale", analysis_scale(F.col("width"))), "seq_id")
