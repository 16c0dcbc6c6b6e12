"""Ordered operators on frames; all windows are by seq_id and frame_idx, so one exchange serves all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..params import CENTERING_REASONS as R


def by_frame() -> WindowSpec:
    return Window.partitionBy("seq_id").orderBy("frame_idx")


def rows(low: int, high: int) -> WindowSpec:
    return by_frame().rowsBetween(low, high)


def true(cond: Column) -> Column:
    """Missing comparisons are false, also below a negation."""
    return F.coalesce(cond, F.lit(False))


def difference(x: Column) -> Column:
    return x - F.lag(x).over(by_frame())


def previous(x: Column, reach: int | None = None) -> Column:
    """The last known value at or before the row, within ``reach`` rows before it."""
    return F.last(x, ignorenulls=True).over(rows(Window.unboundedPreceding if reach is None else -reach, 0))


def following(x: Column, reach: int | None = None) -> Column:
    return F.first(x, ignorenulls=True).over(rows(0, Window.unboundedFollowing if reach is None else reach))


def innovation(x: str, y: str, rx: str, ry: str) -> Column:
    """How far a step of (x, y) is from the measured motion; 0 where either is missing."""
    return F.coalesce(F.hypot(difference(F.col(x)) - F.col(rx), difference(F.col(y)) - F.col(ry)), F.lit(0.0))


def transient_outlier(trusted: Column, gate: float) -> Column:
    """Both single steps around the row are off by more than ``gate`` and the double step is not."""

    def off(dx, dy):
        return F.hypot(dx, dy)

    w = by_frame()
    x, y, rx, ry = (F.col(c) for c in ("raw_x", "raw_y", "rel_x", "rel_y"))
    into = off(x - F.lag(x).over(w) - rx, y - F.lag(y).over(w) - ry)
    out = off(F.lead(x).over(w) - x - F.lead(rx).over(w), F.lead(y).over(w) - y - F.lead(ry).over(w))
    over = off(F.lead(x).over(w) - F.lag(x).over(w) - rx - F.lead(rx).over(w), F.lead(y).over(w) - F.lag(y).over(w) - ry - F.lead(ry).over(w))
    three = true(trusted) & true(F.lag(trusted).over(w)) & true(F.lead(trusted).over(w))
    return three & true((into > gate) & (out > gate) & (over < gate))


def cumulative(x: Column) -> Column:
    return F.sum(F.coalesce(x, F.lit(0.0))).over(rows(Window.unboundedPreceding, 0))


def frame_median(x: Column, low: int, high: int, least: int = 1) -> Column:
    """The median of the known values in a frame; null below ``least`` of them."""
    w = rows(low, high)
    return F.when(F.count(x).over(w) >= least, F.percentile(x, F.lit(0.5)).over(w))


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), then)[0]


def array_median(values: Column) -> Column:
    """The median of an array without nulls; null if it is empty."""
    n = F.size(values)
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return F.when(n > 0, let(F.sort_array(values), lambda s: (F.get(s, low) + F.get(s, high)) / 2))


def frame_mad(x: Column, low: int, high: int) -> Column:
    """The median absolute deviation of the known values in a frame."""
    values = F.collect_list(x).over(rows(low, high))
    return array_mad(values)


def array_mad(values: Column) -> Column:
    return let(array_median(values), lambda middle: array_median(F.transform(values, lambda v: F.abs(v - middle))))


def adaptive_gate(x: Column, scale: float, span: int = 60) -> Column:
    """2 scales, up to 3 as the positive values of the ``span`` rows before have it."""
    known = F.when(x > 0, x)
    mid = frame_median(known, -span, -1, 5)
    wide = mid + F.lit(3 * 1.4826) * frame_mad(known, -span, -1)
    return F.coalesce(F.least(F.lit(3 * scale), F.greatest(F.lit(2 * scale), wide)), F.lit(2 * scale))


def with_islands(df: DataFrame, flag: str) -> DataFrame:
    """``run`` (number of the maximal run of equal ``flag``) and its ``run_start``, ``run_length``."""
    changed = F.coalesce((F.col(flag) != F.lag(flag).over(by_frame())).cast("int"), F.lit(1))
    out = df.withColumn("run", F.sum(changed).over(rows(Window.unboundedPreceding, 0)))
    each = Window.partitionBy("seq_id", "run")
    return out.withColumns({"run_start": F.min("frame_idx").over(each), "run_length": F.count(F.lit(1)).over(each)})


def runs(df: DataFrame, flag: str) -> DataFrame:
    """One row per maximal run of a true ``flag``: start, stop (past the end) and length."""
    found = with_islands(df, flag).filter(flag)
    return found.groupBy("seq_id", "run").agg(F.min("frame_idx").alias("start"), (F.max("frame_idx") + 1).alias("stop"), F.count(F.lit(1)).alias("length")).drop("run")


def hysteresis(df: DataFrame, evidence: str, recover: int) -> DataFrame:
    """``limbo``: in a run of evidence that starts the sequence or has ``recover`` rows."""
    out = with_islands(df, evidence)
    first = F.min("frame_idx").over(Window.partitionBy("seq_id"))
    return out.withColumn("limbo", F.col(evidence) & ((F.col("run_start") == first) | (F.col("run_length") >= recover))).drop("run", "run_start", "run_length")


def latch(event: Column) -> Column:
    """True from the first row on for which ``event`` holds."""
    return true(F.max(event.cast("int")).over(rows(Window.unboundedPreceding, 0)) == 1)


def repair(x: str, bad: Column, reach: int) -> Column:
    """Bad rows by linear interpolation between their nearest good neighbours within ``reach``."""
    good = F.when(~true(bad), F.col(x))
    at = F.when(good.isNotNull(), F.col("frame_idx"))
    x0, x1, i0, i1 = previous(good, reach), following(good, reach), previous(at, reach), following(at, reach)
    between = x0 + (x1 - x0) * (F.col("frame_idx") - i0) / (i1 - i0)
    return F.when(true(bad) & x0.isNotNull() & x1.isNotNull(), between).otherwise(F.col(x))


def exposure_drops(df: DataFrame, fps: float, least_drop: float = 0.08, noise_factor: float = 6.0) -> DataFrame:
    """``baseline``, ``drop`` and ``candidate``: short dips of ``exposed`` against both sides."""
    n = max(5, round(0.5 * fps))
    x = F.when(F.col("evaluable"), F.col("exposed"))
    past, future = F.collect_list(x).over(rows(-n, -1)), F.collect_list(x).over(rows(1, n))
    out = df.withColumns({"_past": past, "_future": future})
    base = F.least(array_median(F.col("_past")), array_median(F.col("_future")))
    sides = (F.size("_past") >= 3) & (F.size("_future") >= 3) & F.col("evaluable")
    out = out.withColumns({"baseline": F.when(sides, base), "noise": F.lit(1.4826) * array_mad(F.concat("_past", "_future"))})
    out = out.withColumn("drop", F.col("baseline") - F.col("exposed"))
    gate = F.greatest(F.lit(least_drop), F.lit(noise_factor) * F.col("noise"))
    return out.withColumn("candidate", true(F.col("drop") >= gate)).drop("_past", "_future")


def isolated_tears(df: DataFrame, fps: float, longest: float = 0.067) -> DataFrame:
    """``tear``: candidates in runs (of eligible candidates) no longer than ``longest`` seconds, and
    ``run_length`` of such runs (0 elsewhere)."""
    if not fps > 0:
        raise ValueError("fps must be positive")
    out = with_islands(df.withColumn("_hit", F.col("candidate") & F.col("evaluable")), "_hit")
    length = F.when(F.col("_hit"), F.col("run_length")).otherwise(F.lit(0).cast("bigint"))
    return out.withColumns({"run_length": length, "tear": F.col("_hit") & (F.col("run_length") / F.lit(fps) <= longest + 1e-9)}).drop("_hit", "run", "run_start")


def centering(df: DataFrame, fps: float, anchor: str = "anchor", support: Column | None = None, conflict: Column | None = None) -> DataFrame:
    """``centering``: 0 at anchors, 1 where support, a bridge or a short reach from one helps, else 2;
    and ``centering_reason``."""
    extend, bridge = max(10, round(fps)), max(max(10, round(fps)), round(5 * fps))
    at = F.when(F.col(anchor), F.col("frame_idx"))
    before, after = previous(at), following(at)
    i = F.col("frame_idx")
    near = true(after - before <= bridge) | true(i - before <= extend) | true(after - i <= extend)
    supported = true(support) if support is not None else F.lit(False)
    against = true(conflict) if conflict is not None else F.lit(False)
    state = F.when(F.col(anchor), 0).when(against, 2).when(supported | near, 1).otherwise(2)
    n = F.count(F.lit(1)).over(Window.partitionBy("seq_id"))
    between = F.format_string(R["neighbours"], F.coalesce(before, F.lit(-1)).cast("long"), F.coalesce(after, n).cast("long"))
    why = F.when(F.col(anchor), R["anchor"]).when(against, R["conflict"]).when(supported, R["support"]).when(near, between).otherwise(R["none"])
    return df.withColumns({"prev_anchor": before, "next_anchor": after, "centering": state, "centering_reason": why})


def trend_fraction(values: Column, rising: bool, slack: float) -> Column:
    """The share of steps of an array that don't go against a trend by more than ``slack``."""
    known = F.filter(values, lambda v: v.isNotNull())
    steps = F.zip_with(F.slice(known, F.lit(2), F.greatest(F.size(known) - 1, F.lit(0))), F.slice(known, F.lit(1), F.greatest(F.size(known) - 1, F.lit(0))), lambda b, a: b - a)
    fits = F.filter(steps, (lambda d: d >= -slack) if rising else (lambda d: d <= slack))
    return F.when(F.size(known) >= 3, F.size(fits) / F.size(steps)).otherwise(F.lit(0.0))


def tumbling(df: DataFrame, value: str, width: int, least: int) -> DataFrame:
    """The median of every ``width`` frames that have at least ``least`` known values."""
    return df.groupBy("seq_id", F.floor(F.col("frame_idx") / width).alias("window")).agg(F.count(value).alias("known"), F.percentile(F.col(value), F.lit(0.5)).alias("middle")).filter(F.col("known") >= least)


def scale_drift(df: DataFrame, fps: float, radius: float, tolerance: float = 0.08, least: int = 5, least_all: int = 20, points: int = 35) -> DataFrame:
    """Half-second windows whose median radius is off by more than ``tolerance``: first and last
    frame, median and deviation.  Sequences with few measured radii have none."""
    width = max(1, round(0.5 * fps))
    known = F.when(F.col("radius_meas").isNotNull() & (F.col("points") >= points), F.col("radius_meas"))
    every = Window.partitionBy("seq_id")
    base = df.select("seq_id", "frame_idx", known.alias("r")).withColumn("all", F.count("r").over(every)).withColumn("last", F.max("frame_idx").over(every))
    each = base.groupBy("seq_id", F.floor(F.col("frame_idx") / width).alias("w")).agg(F.count("r").alias("n"), F.first("all").alias("all"), F.first("last").alias("end"), F.percentile("r", F.lit(0.5)).alias("middle"))
    off = F.col("middle") / F.lit(radius) - 1
    first = (F.col("w") * width).cast("bigint")
    return each.filter((F.col("n") >= least) & (F.col("all") >= least_all) & (F.abs(off) > tolerance)).select("seq_id", first.alias("first_frame"), F.least(first + width - 1, F.col("end")).alias("last_frame"), "middle", off.alias("deviation"))
