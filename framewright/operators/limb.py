"""Choices among measured candidates: thresholds, components, points, edges, radii.

Candidates are rows, many per frame; every choice is one aggregate by frame or sequence, so a frame's
candidates are never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Radii by image width, the least number of radii and of contour points.
RADIUS_SHARE, LEAST_RADII, LEAST_POINTS = (0.20, 0.48), 4, 30
RADIUS_NEAR, RADIUS_NEAR_SHARE = 2.0, 0.04
MOST_POINTS, AGREEMENT = 800, 2


def best_by(rows: DataFrame, by: list[str], score: Column, tie: Column) -> DataFrame:
    """The row of each group with the highest score; among equals the one of lowest ``tie``."""
    names = [c for c in rows.columns if c not in by]
    top = F.max_by(F.struct(*names), F.struct(score.alias("s"), (-tie).alias("t")))
    return rows.groupBy(*by).agg(top.alias("_best")).select(*by, "_best.*")


def best_candidate(candidates: DataFrame) -> DataFrame:
    """The candidate of highest quality of every frame; equal ones by the lower threshold."""
    return best_by(candidates, ["seq_id", "frame_idx"], F.col("quality"), F.col("threshold"))


def largest_component(components: DataFrame, least: float, most: float) -> DataFrame:
    """The component of largest area within bounds of every frame; equal ones by the lower label."""
    return best_by(components.filter((F.col("area") >= least) & (F.col("area") <= most)), ["seq_id", "frame_idx"], F.col("area"), F.col("label"))


def nearest_component(components: DataFrame, least: float, most: float) -> DataFrame:
    """The component within bounds whose centroid (cx, cy) is nearest to the foretold place (x, y)."""
    near = components.filter((F.col("area") >= least) & (F.col("area") <= most)).withColumn("distance", F.hypot(F.col("cx") - F.col("x"), F.col("cy") - F.col("y")))
    return best_by(near, ["seq_id", "frame_idx"], -F.col("distance"), F.col("label"))


def decimate(points: DataFrame, by: list[str], order: str, most: int = MOST_POINTS) -> DataFrame:
    """Every k-th point of each group, with the least k that leaves ``most`` at most."""
    each = Window.partitionBy(*by)
    out = points.withColumn("_n", F.count(F.lit(1)).over(each)).withColumn("_at", F.row_number().over(each.orderBy(order)) - 1)
    return out.filter(F.col("_at") % F.greatest(F.lit(1), F.ceil(F.col("_n") / most)) == 0).drop("_n", "_at")


def edge_votes(contacts: DataFrame, least_support: int) -> DataFrame:
    """edges and score of every frame from rows (threshold, edge, count, core): thresholds with enough
    pixels near an edge and at it vote for it, two votes agree."""
    core = max(2, least_support // 4)
    vote = ((F.col("count") >= least_support) & (F.col("core") >= core)).cast("int")
    by_edge = contacts.groupBy("seq_id", "frame_idx", "edge").agg(F.sum(vote).alias("votes"), F.count_distinct("threshold").alias("thresholds"))
    edges = F.array_sort(F.collect_list(F.when(F.col("votes") >= AGREEMENT, F.col("edge"))))
    return by_edge.groupBy("seq_id", "frame_idx").agg(edges.alias("edges"), (F.max("votes") / F.max("thresholds")).alias("score")).withColumn("clipped", F.size("edges") > 0)


def calibrate_radius(candidates: DataFrame) -> DataFrame:
    """radius, used and found of every sequence from the circles (radius, touch, points, width) of sampled frames.

    Circles that touch the border, have few points or an unlikely size don't count; the radius is the
    median of those near the median.  Sequences with fewer than four circles have no row.
    """
    r = F.col("radius")
    sound = candidates.filter(~F.col("touch") & (F.col("points") >= LEAST_POINTS) & (r > RADIUS_SHARE[0] * F.col("width")) & (r < RADIUS_SHARE[1] * F.col("width")))
    middle = sound.groupBy("seq_id").agg(F.percentile(r, F.lit(0.5)).alias("_middle"), F.count(F.lit(1)).alias("found")).filter(F.col("found") >= LEAST_RADII)
    near = F.when(F.abs(r - F.col("_middle")) <= F.greatest(F.lit(RADIUS_NEAR), RADIUS_NEAR_SHARE * F.col("_middle")), r)
    out = sound.join(middle, "seq_id").groupBy("seq_id", "_middle", "found").agg(F.percentile(near, F.lit(0.5)).alias("_near"), F.count(near).alias("used"))
    return out.select("seq_id", F.coalesce("_near", "_middle").alias("radius"), "used", "found")


def resolve_radius(sequences: DataFrame, candidates: DataFrame) -> DataFrame:
    """``sequences`` (seq_id, radius or null) with every radius: the given one, else the calibrated one.

    A sequence that has neither is an error.
    """
    found = calibrate_radius(candidates).select("seq_id", F.col("radius").alias("_found"))
    radius = F.coalesce("radius", "_found")
    checked = F.when(radius.isNull(), F.raise_error(F.concat(F.lit("no radius for sequence "), F.col("seq_id").cast("string"))).cast("double")).otherwise(radius)
    return sequences.join(found, "seq_id", "left").withColumn("radius", checked).drop("_found")


def algebraic_circles(points: DataFrame, by: list[str]) -> DataFrame:
    """cx, cy and radius of the least-squares circle through each group's points (x, y).

    From sums of powers about the group's mean, so a group is one row of partial sums before the
    shuffle; groups of fewer than six points, or of points on a line, have none.
    """
    each = Window.partitionBy(*by)
    u, v = F.col("x") - F.avg("x").over(each), F.col("y") - F.avg("y").over(each)
    p = points.withColumn("_u", u).withColumn("_v", v).withColumn("_mx", F.avg("x").over(each)).withColumn("_my", F.avg("y").over(each))
    u, v = F.col("_u"), F.col("_v")
    sums = {"n": F.count(F.lit(1)), "uu": F.sum(u * u), "vv": F.sum(v * v), "uv": F.sum(u * v), "uz": F.sum(u * (u * u + v * v)), "vz": F.sum(v * (u * u + v * v)), "mx": F.first("_mx"), "my": F.first("_my")}
    s = p.groupBy(*by).agg(*[x.alias(f"_{k}") for k, x in sums.items()])
    c = {k: F.col(f"_{k}") for k in sums}
    det = c["uu"] * c["vv"] - c["uv"] * c["uv"]
    a, b = (c["uz"] * c["vv"] - c["vz"] * c["uv"]) / (2 * det), (c["vz"] * c["uu"] - c["uz"] * c["uv"]) / (2 * det)
    fine = (c["n"] >= 6) & (det > 1e-9 * (c["uu"] + c["vv"]) * (c["uu"] + c["vv"]))
    return s.filter(fine).select(*by, (a + c["mx"]).alias("cx"), (b + c["my"]).alias("cy"), F.sqrt(a * a + b * b + (c["uu"] + c["vv"]) / c["n"]).alias("radius"))


def angular_gap(samples: DataFrame, by: list[str], n: int = 360) -> DataFrame:
    """gap and gap_angle (degrees) of each group's measured steps (``step`` of ``n`` around the circle).

    The gap is what lies between two neighbouring steps; none (0, null) if all are there.
    """
    steps = samples.select(*by, "step").distinct()
    order = Window.partitionBy(*by).orderBy("step")
    after = F.coalesce(F.lead("step").over(order), F.min("step").over(Window.partitionBy(*by)) + n)
    widest = best_by(steps.withColumn("_wide", after - F.col("step")), by, F.col("_wide"), F.col("step"))
    middle = F.floor((2 * F.col("step") + F.col("_wide")) / 2) % n
    free = F.col("_wide") - 1
    return widest.select(*by, (free * 360.0 / n).alias("gap"), F.when(free > 0, middle * 360.0 / n).alias("gap_angle"))


def condition(samples: DataFrame, by: list[str], n: int = 360) -> DataFrame:
    """The ratio of the eigenvalues of the scatter of each group's directions (``step`` of ``n``); infinite below 3."""
    t = F.radians(F.col("step") * 360.0 / n)
    s = samples.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.cos(t) * F.cos(t)).alias("_a"), F.sum(F.cos(t) * F.sin(t)).alias("_b"), F.sum(F.sin(t) * F.sin(t)).alias("_c"))
    mid, apart = (F.col("_a") + F.col("_c")) / 2, F.hypot((F.col("_a") - F.col("_c")) / 2, F.col("_b"))
    ratio = F.greatest(mid + apart, F.lit(1e-9)) / F.greatest(mid - apart, F.lit(1e-9))
    return s.select(*by, F.when(F.col("_n") >= 3, ratio).otherwise(F.lit(float("inf"))).alias("condition"))


def steepest_drop(profile: DataFrame, by: list[str], reach: int = 4) -> DataFrame:
    """at and drop: where each group's profile (``at``, ``value``) falls most over ``reach`` samples; the first such place."""
    after = F.lead("value", reach).over(Window.partitionBy(*by).orderBy("at"))
    falls = profile.withColumn("drop", F.col("value") - after).filter("drop is not null").select(*by, "at", "drop")
    return best_by(falls, by, F.col("drop"), F.col("at"))


def rescaled(frames: DataFrame, columns: list[tuple[str, str]], sx: Column, sy: Column) -> DataFrame:
    """Places (pairs of columns) at another resolution."""
    return frames.withColumns({name: F.col(name) * s for pair in columns for name, s in zip(pair, (sx, sy), strict=True)})
