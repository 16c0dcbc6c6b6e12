"""Frame tables: one row per (seq_id, frame_idx)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def events_as_frames(events: DataFrame) -> DataFrame:
    """One sequence per user: frames in time order, with measurements derived from value and props."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.get_json_object("props", "$.k").cast("bigint")
    base = events.select(F.col("user_id").alias("seq_id"), (F.row_number().over(order).cast("bigint") - 1).alias("frame_idx"), k.alias("k"), "event_type", "value")
    i, kk, seen, jump = F.col("frame_idx"), F.col("k"), F.col("event_type") != "error", F.col("value") > 200
    step = F.when(i > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return base.select(
        "seq_id",
        "frame_idx",
        "k",
        seen.alias("evaluable"),
        (F.lit(0.9) + F.lit(0.0001) * kk - F.when(jump, F.lit(0.3)).otherwise(F.lit(0.0))).alias("exposed"),
        F.when(seen, F.lit(120.0) + F.lit(0.2) * i + F.lit(0.01) * (kk - 50) + F.when(jump, F.lit(12.0)).otherwise(F.lit(0.0))).alias("raw_x"),
        F.when(seen, F.lit(180.0) + F.lit(0.1) * i - F.lit(0.01) * (kk - 50)).alias("raw_y"),
        (step * F.lit(0.2)).alias("rel_x"),
        (step * F.lit(0.1)).alias("rel_y"),
        (F.lit(0.3) + F.lit(0.005) * kk).alias("response"),
        (F.lit(0.05) + F.lit(0.009) * kk).alias("quality"),
        F.when(~seen & (kk < 10), 4).otherwise(200).alias("maximum"),
        ((F.col("event_type") == "view") & (kk < 20)).alias("anchor"),
    )


def load_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_frames(spark.read.parquet(f"{sf_dir}/events.parquet"))


def sparse(frames: DataFrame, wanted: list[int]) -> DataFrame:
    """The listed frames of every sequence; the list reaches the scan as a filter where it can."""
    return frames.filter(F.col("frame_idx").isin(wanted))


def systematic(frames: DataFrame, count: int = 16) -> DataFrame:
    """``count`` evenly spaced frames of every sequence, first and last included, each once."""
    last = Window.partitionBy("seq_id")
    n = F.count(F.lit(1)).over(last)
    steps = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.floor(i * (n - 1) / F.lit(max(1, count - 1))))
    return frames.withColumn("_at", steps).filter(F.array_contains("_at", F.col("frame_idx"))).drop("_at")


def incomplete(frames: DataFrame, totals: DataFrame) -> DataFrame:
    """Sequences whose number of frames is not the declared one (seq_id, declared), with both numbers."""
    found = frames.groupBy("seq_id").agg(F.count(F.lit(1)).alias("found"))
    both = totals.select("seq_id", F.col("declared").cast("bigint").alias("declared")).join(found, "seq_id", "full")
    return both.withColumn("found", F.coalesce("found", F.lit(0))).filter(~F.col("found").eqNullSafe(F.col("declared")))
