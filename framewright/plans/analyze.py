"""The analysis of whole image sequences, its cache, and the commands that use it.

``scan`` folds over a sequence's images in order, an image and a few numbers of state in memory at a
time: motion from the image before, the limb around the foretold place, and what is measured around
the accepted one.  The contrast track is a second such pass, as its anchors are known only when all
regimes are.  Everything after that is narrow rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType

from ..functions import kernels, parse
from ..operators import limb, policy, regime, summary, track
from ..params import EDGE_BITS, Params
from ..sources import images as im
from ..sources import sinks
from ..sources.frames import systematic
from . import decide

_DOUBLES = "told_x told_y raw_x raw_y innovation rel_x rel_y response quality coverage residual strength threshold radius_meas visible_x visible_y clip_score exposed bright visible arc_gap arc_coverage".split()
_INTS, _BOOLS = "source points maximum clip_edges arc_points".split(), "touch evaluable arc_measured".split()


def radial_quality(coverage: float, residual: float | None, points: int, radius: float) -> float:
    if residual is None:
        return 0.0
    return max(0.0, min(1.0, coverage / 150)) * math.exp(-residual / max(0.8, 0.012 * radius)) * (0.7 + 0.3 * min(1.0, points / 100))


@dataclass
class Scan:
    """The measurements of a sequence's images, one after the other."""

    p: Params
    size: tuple
    before: np.ndarray | None = None
    last: tuple | None = None

    ADDED = (*((n, DoubleType()) for n in _DOUBLES), *((n, IntegerType()) for n in _INTS), *((n, BooleanType()) for n in _BOOLS))
    USED = ("gray", "h", "w")

    def step(self, row: dict) -> tuple:
        gray, radius, scale = im.decode(row), self.p.radius, self.p.scale
        phase = kernels.phase_image(gray)
        dx, dy, response = kernels.phase_shift(self.before, phase) if self.before is not None else (0.0, 0.0, 0.0)
        self.before = phase
        moved = {"rel_x": 2 * dx, "rel_y": 2 * dy, "response": response}
        told = track.moved(self.last, moved, scale) if self.last else None
        seen, arcs = kernels.detect_limb(gray, radius, told, scale), []

        def measure(_, at):
            found = kernels.radial_limb(gray, at, radius, scale)
            arcs.append(found)
            return track.Arc((found["x"], found["y"]) if found["measured"] else None, found["points"], found["coverage"], found["residual"])

        tracker = track.Geometry(self.p, (float(row["w"]), float(row["h"])), measure, self.last)
        told_x, told_y, x, y, source, innovation = tracker.step({**moved, "contour_x": seen["x"], "contour_y": seen["y"], "touch": seen["touch"]})
        self.last = tracker.last
        arc = arcs[-1] if source == 3 else arcs[0]
        out = dict.fromkeys(_DOUBLES) | {"points": 0, "quality": 0.0, "coverage": 0.0, "strength": 0.0}
        if source == 3:
            out |= {k: seen[k] for k in ("quality", "coverage", "residual", "points", "strength")}
        elif source:
            out |= {k: arc[k] for k in ("coverage", "residual", "points", "strength")} | {"quality": radial_quality(arc["coverage"], arc["residual"], arc["points"], radius)}
        centre = kernels.visible_centroid(gray)
        at = (x, y) if source else centre or (told_x, told_y)
        clip, light = kernels.clipping(gray, at, radius, scale), kernels.exposed_fraction(gray, at, radius)
        out |= moved | {
            "told_x": told_x, "told_y": told_y, "raw_x": x, "raw_y": y, "innovation": innovation, "source": source, "threshold": seen["threshold"], "touch": bool(seen["touch"]) if source == 3 else False, "radius_meas": seen["radius"],
            "visible_x": centre and centre[0], "visible_y": centre and centre[1], "maximum": int(gray.max()), "clip_edges": sum(EDGE_BITS[e] for e in clip["edges"]), "clip_score": clip["score"], "evaluable": light["evaluable"], "exposed": light["exposed"],
            "bright": light["bright"], "visible": light["visible"], "arc_gap": arc["gap"], "arc_measured": arc["measured"], "arc_points": arc["points"], "arc_coverage": arc["coverage"],
        }
        return tuple(out[n] for n, _ in self.ADDED)


class Spots(track.Contrast):
    """The contrast track with its spots found on the images."""

    USED = (*(c for c in track.Contrast.USED if not c.startswith("spot")), "gray", "h", "w")

    def __post_init__(self):
        super().__post_init__()
        self.detect = lambda row, at: kernels.contrast_center(im.decode(row), at, self.p.radius, self.p.scale)


def scan(images: DataFrame, sequences: DataFrame) -> DataFrame:
    """seq_id, frame_idx, the sequence's scalars and what ``Scan`` measures; images of (seq_id, frame_idx, h, w, gray)."""
    frames = decide.with_scalars(images.select("seq_id", "frame_idx", "h", "w", "gray"), sequences)
    return track.fold(frames, lambda: Scan(Params(), (0.0, 0.0))).drop("gray", "h", "w")


def contrast(frames: DataFrame, images: DataFrame) -> DataFrame:
    """``frames`` (with ``trusted``) with the anchored contrast track, over all images of their sequences.

    A frame without an image is an error, as is an image without a frame.
    """
    old = [n for n, _ in track.Contrast.ADDED if n in frames.columns]
    both = frames.drop(*old).withColumns({"place_x": F.when(F.col("source") != 0, F.col("raw_x")), "place_y": F.when(F.col("source") != 0, F.col("raw_y"))}).join(images.select("seq_id", "frame_idx", "h", "w", "gray"), ["seq_id", "frame_idx"], "full")
    whole = F.when(F.col("gray").isNull() | F.col("scale").isNull(), F.raise_error(F.concat(F.lit("images and frames differ at "), F.col("frame_idx").cast("string"))).cast("binary")).otherwise(F.col("gray"))
    return track.fold(both.withColumn("gray", whole), lambda: Spots(Params(), (0.0, 0.0))).drop("gray", "h", "w", "place_x", "place_y")


def refresh(frames: DataFrame, images: DataFrame, params: Params) -> DataFrame:
    """Stored frames with the contrast track made anew: regimes and trusted geometry, then the track."""
    marked = regime.classify(frames, params)
    return contrast(decide.trusted_geometry(marked, params.scale), images)


def solve(frames: DataFrame, images: DataFrame | None, sequences: DataFrame, ranges: DataFrame | list = (), auto_repair: bool = True) -> DataFrame:
    """All decisions about scanned frames; without images the contrast track that they carry is used."""
    own = ("fps", "width", "height", "radius", "scale")
    marked = policy.discard_ranges(frames.drop(*own), list(ranges) if not isinstance(ranges, DataFrame) else ranges)

    def each(f, p, size):
        f = refresh(f, images, p) if images is not None else decide.trusted_geometry(regime.classify(f, p), p.scale)
        return decide.decide(f, p, size, auto_repair=auto_repair)

    return decide.by_sequence(marked, sequences, lambda f, p, size: each(f, p, size) if images is None else each(f.join(images.select("seq_id").distinct(), "seq_id", "left_semi"), p, size))


def with_radius(images: DataFrame, sequences: DataFrame) -> DataFrame:
    """``sequences`` with the radius calibrated on 16 images where none is given."""
    sample = systematic(images, 16)
    found = im.per_image(sample, lambda gray, row: kernels.radius_candidates(gray), "threshold double, touch boolean, points int, radius double, width int")
    return limb.resolve_radius(sequences, found.filter("radius is not null"))


def cold(images: DataFrame, sequences: DataFrame, folder: str, ranges: DataFrame | list = (), auto_repair: bool = True) -> DataFrame:
    """Scan, contrast track and decisions of all sequences; what is expensive is published in ``folder`` first."""
    spark = images.sparkSession
    known = with_radius(images, sequences)
    sinks.publish(scan(images, known), f"{folder}/scan")
    scanned = sinks.current(spark, f"{folder}/scan")[0]
    sinks.publish(solve(scanned, images, known, ranges, auto_repair), f"{folder}/analysis", {"auto_repair": auto_repair})
    return sinks.current(spark, f"{folder}/analysis")[0]


def analyze(images: DataFrame, sequences: DataFrame, folder: str, state: str = "missing", ranges: DataFrame | list = (), auto_repair: bool = True) -> DataFrame:
    """The decided frames: from the stored scan if ``state`` (see ``identity.cache_status``) says that it holds, else anew.

    A refreshable one keeps its scan and has its contrast track made again; a valid one is only solved
    again, which is cheap.
    """
    spark = images.sparkSession
    stored = sinks.current(spark, f"{folder}/scan")
    if state not in ("valid", "refreshable") or stored is None:
        return cold(images, sequences, folder, ranges, auto_repair)
    own = stored[0].select("seq_id", "radius").distinct()
    known = sequences.drop("radius").join(own, "seq_id")
    before = sinks.current(spark, f"{folder}/analysis")
    if state == "valid" and before is not None:
        tracked = [n for n, _ in track.Contrast.ADDED]
        frames = stored[0].join(before[0].select("seq_id", "frame_idx", *tracked), ["seq_id", "frame_idx"])
        solved = solve(frames, None, known, ranges, auto_repair)
    else:
        solved = solve(stored[0], images, known, ranges, auto_repair)
    sinks.publish(solved, f"{folder}/analysis", {"auto_repair": auto_repair})
    return sinks.current(spark, f"{folder}/analysis")[0]


def inspect(images: DataFrame, sequences: DataFrame, samples: int = 24) -> DataFrame:
    """The limb on evenly spaced images of every sequence, with the lines of text about it."""
    frames = decide.with_scalars(systematic(images, samples), with_radius(images, sequences))

    def one(gray, row):
        found = kernels.detect_limb(gray, row["radius"], None, row["scale"])
        return {**found, "raw_x": found["x"], "raw_y": found["y"], "points": found["points"]}

    made = im.per_image(frames, one, "raw_x double, raw_y double, quality double, coverage double, residual double, threshold double, touch boolean, points int")
    return summary.detection_lines(made)


def shifted(images: DataFrame, selected: DataFrame, width: int | None = None) -> DataFrame:
    """The kept images, moved so that the centre is in the middle, in order of ``output_frame``.

    ``width``: of the output; the height follows.
    """
    kept = summary.output_positions(selected.withColumn("keep", F.col("mask"))).withColumnRenamed("position", "output_frame")
    at = selected.select("seq_id", "frame_idx", F.col("center_x").alias("_cx"), F.col("center_y").alias("_cy"), F.col("width").alias("_aw"), F.col("height").alias("_ah"))
    both = images.select("seq_id", "frame_idx", "h", "w", "gray").join(kept, ["seq_id", "frame_idx"]).join(at, ["seq_id", "frame_idx"])

    def move(gray, row):
        h, w = gray.shape
        if width is not None and width != w:
            tall = round(h * width / w)
            h, w = tall + tall % 2, width
            gray = kernels.area_resized(gray, h, w)
        sx, sy = w / row["_aw"], h / row["_ah"]
        return {"h": h, "w": w, "gray": kernels.shift(gray, w / 2 - row["_cx"] * sx, h / 2 - row["_cy"] * sy).tobytes()}

    return im.per_image(both, move, "h int, w int, gray binary", ["seq_id", "frame_idx", "output_frame"])


def validate(outputs: DataFrame, selected: DataFrame) -> DataFrame:
    """The report of every sequence: how far the limb of output images before the horizon is from the middle."""
    facts = selected.select("seq_id", "frame_idx", "radius", "width", F.coalesce("horizon_start", F.lit(1 << 62)).alias("_horizon"))
    judged = outputs.join(facts, ["seq_id", "frame_idx"]).filter(F.col("frame_idx") < F.col("_horizon"))

    def off(gray, row):
        h, w = gray.shape
        found = kernels.radial_limb(gray, (w / 2, h / 2), row["radius"] * w / row["width"], max(1.0, w) / 270)
        return {"dx": found["x"] - w / 2, "dy": found["y"] - h / 2} if found["points"] >= kernels.LEAST_RAYS else []

    made = im.per_image(judged, off, "dx double, dy double", ["seq_id", "frame_idx", "output_frame"]).withColumnRenamed("frame_idx", "source_frame").withColumn("residual", F.hypot("dx", "dy"))
    return sinks.validation(summary.jitter(made), summary.worst_residuals(made))


@dataclass(frozen=True)
class Session:
    """Where the commands find images (seq_id, frame_idx, h, w, gray) and sequences, and write to."""

    images: DataFrame
    sequences: DataFrame
    folder: str
    ranges: DataFrame | list = ()
    manual: DataFrame | None = None
    auto_repair: bool = True

    @property
    def spark(self) -> SparkSession:
        return self.images.sparkSession

    def selected(self, decided: DataFrame) -> DataFrame:
        none = self.spark.createDataFrame([], "seq_id long, frame_idx long, action string")
        return policy.selection(decided, self.manual if self.manual is not None else none)


def command_inspect(s: Session, samples: int = 24) -> DataFrame:
    """detections.csv of sampled images; returns it with the lines of text."""
    found = inspect(s.images, s.sequences, samples)
    sinks.write_csv(sinks.detection_table(found), f"{s.folder}/inspect/detections.csv")
    return found


def command_analyze(s: Session, state: str = "missing", debug: bool = False, debug_width: int = 320, max_images: int = 10000) -> DataFrame:
    """tracking.csv, with ``debug`` also frames.csv and the images that a review shows; returns the report."""
    parse.check_options(debug_width=debug_width, max_images=max_images)
    decided = analyze(s.images, s.sequences, s.folder, state, s.ranges, s.auto_repair)
    sinks.write_csv(sinks.tracking_table(decided), f"{s.folder}/tracking.csv")
    chosen = s.selected(decided)
    if debug:
        sinks.write_csv(sinks.debug_table(chosen), f"{s.folder}/debug/frames.csv")
        sample = summary.priority_sample(chosen.withColumn("problem", F.col("jitter_candidate") | F.col("excursion_candidate") | F.col("corrupt") | F.col("repaired")), max_images)
        state_name = policy.names(F.col("content"), sinks.CONTENT_STATES).alias("content_state")
        review = summary.overlay(chosen, 30.0).select("seq_id", "frame_idx", state_name, *[f"line_{i}" for i in (1, 2, 3, 4, 5, 7, 8)])
        s.images.join(sample, ["seq_id", "frame_idx"]).join(review, ["seq_id", "frame_idx"]).write.partitionBy("content_state").mode("overwrite").parquet(f"{s.folder}/debug/frames")
    return summary.analysis_report(chosen.withColumn("keep", F.col("mask")))


def command_preview(s: Session, state: str = "valid", width: int = 270) -> DataFrame:
    """Small stabilized images, and how well they are: validation.json's text of every sequence."""
    chosen = s.selected(analyze(s.images, s.sequences, s.folder, state, s.ranges, s.auto_repair))
    sinks.publish(shifted(s.images, chosen, width), f"{s.folder}/preview")
    report = validate(sinks.current(s.spark, f"{s.folder}/preview")[0], chosen)
    report.write.mode("overwrite").json(f"{s.folder}/validation.json")
    return report


def command_export(s: Session, state: str = "valid") -> DataFrame:
    """The stabilized images at full size, published whole; returns them."""
    chosen = s.selected(analyze(s.images, s.sequences, s.folder, state, s.ranges, s.auto_repair))
    sinks.publish(shifted(s.images, chosen), f"{s.folder}/export")
    return sinks.current(s.spark, f"{s.folder}/export")[0]
