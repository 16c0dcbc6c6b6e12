"""Row rules: evidence, content, quality, edges, and which frames are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from .seqops import let, true


def names(code: Column, table: dict[int, str]) -> Column:
    """A state code's name; ``unknown`` for any other code."""
    known = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(known, code.cast("int")), F.lit("unknown"))


def edges_to_bits(edges: Column) -> Column:
    out = F.lit(0)
    for name, bit in P.EDGE_BITS.items():
        out = out + F.when(F.array_contains(edges, name), bit).otherwise(0)
    return out


def bits_to_edges(bits: Column) -> Column:
    return F.array_compact(F.array(*[F.when(bits.bitwiseAND(F.lit(b)) != 0, F.lit(name)) for name, b in P.EDGE_BITS.items()]))


def radial_quality(coverage: Column, residual: Column, points: Column, radius: Column) -> Column:
    """0 to 1 from coverage, fit and number of points; 0 without a residual."""
    part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), coverage / F.lit(150.0)))
    fit = F.exp(-residual / F.greatest(F.lit(0.8), F.lit(0.012) * radius))
    return F.coalesce(part * fit * (F.lit(0.7) + F.lit(0.3) * F.least(F.lit(1.0), points / F.lit(100.0))), F.lit(0.0))


def gated_step(x: Column, y: Column, response: Column, scale: float) -> Column:
    """The motion (x, y), or (0, 0) if it is missing, weak or too far."""
    ok = true((response >= 0.12) & (F.hypot(x, y) <= 35 * scale))
    return F.struct(F.when(ok, x).otherwise(F.lit(0.0)).alias("x"), F.when(ok, y).otherwise(F.lit(0.0)).alias("y"))


def evidence(p: P.Params) -> Column:
    """Sound geometry: found, inside, covered, well fitted, enough points and quality."""
    c = F.col
    return true(c("raw_x").isNotNull() & (c("source") != 0) & ~c("touch") & (c("clip_edges") == 0) & (c("coverage") >= p.min_coverage) & (c("residual") <= 4.5 * p.scale) & (c("points") >= p.min_points) & (c("quality") >= p.min_quality))


def occluded(p: P.Params) -> Column:
    """At the border, or dark."""
    c = F.col
    return true(c("touch")) | true(c("clip_edges") != 0) | true(c("maximum") < p.dark_level)


def loss_signals(p: P.Params, columns: list[str] = ()) -> Column:
    """How many signs of loss a frame has; radius and arc count where ``columns`` has them."""
    c = F.col
    signs = [true(c("quality") < max(p.min_quality, 0.12)), ~true(c("residual") <= 4.5 * p.scale), ~true(c("coverage") >= p.min_coverage), ~true(c("points") >= p.min_points), occluded(p)]
    if "radius_meas" in columns:
        signs.append(~true(F.abs(c("radius_meas") / F.lit(p.radius) - 1) <= P.RADIUS_TOLERANCE))
    if "arc_gap" in columns and "arc_measured" in columns:
        signs.append(~(true(c("arc_measured")) & true(c("arc_gap") <= 360 - p.min_coverage)))
    out = F.lit(0)
    for s in signs:
        out = out + s.cast("int")
    return out


def content(clipped: Column, bright: Column, sound: Column) -> Column:
    return F.when(clipped, 1).when(bright & sound, 0).otherwise(2)


def rounded(x: Column, digits: int) -> Column:
    """Digits after the point as the SQL rounds them: the value times a power of ten (a product of doubles), halves away from zero."""
    power = 10.0**digits

    def whole(y):
        low = F.floor(F.abs(y)).cast("double")
        return F.signum(y) * (low + F.when(F.abs(y) - low >= 0.5, 1.0).otherwise(0.0)) / power

    return let(x.cast("double") * power, whole)


def tenths(x: Column) -> Column:
    return rounded(x, 1)


def content_reason(state: Column, bright: Column, sound: Column, tear: Column, drop: Column, edges: Column, score: Column, maximum: Column, points: Column) -> Column:
    """Why a frame's content is what ``state`` says, with the figures that it rests on."""
    t = P.CONTENT_REASONS
    names = F.concat_ws(", ", bits_to_edges(F.coalesce(edges, F.lit(0)).cast("int")))
    border = F.format_string(t["border"], F.when(names == "", t["edge"]).otherwise(names), F.rint(F.coalesce(score, F.lit(0.0)) * 100).cast("int"))
    weak = F.concat_ws("; ", F.when(~bright, F.format_string(t["dark"], maximum.cast("int"))), F.when(~sound, F.format_string(t["weak"], points.cast("int"))))
    text = F.when(state == 1, F.when(tear, F.format_string(t["tear"], tenths(drop.cast("double") * 100))).otherwise(border)).when(state == 0, t["usable"]).otherwise(F.when(weak == "", t["unclear"]).otherwise(weak))
    return F.substring(text, 1, P.REASON_CHARS)


def kept(content_state: Column, centering_state: Column) -> Column:
    return (content_state != 1) & (centering_state != 2)


def discard_ranges(frames: DataFrame, ranges: DataFrame | list[tuple[int, int]]) -> DataFrame:
    """``discarded``: in one of the inclusive ranges (start, end) of the frame's sequence.

    A table (seq_id, start, end) holds for the sequences that it names, a list for all of them.  A
    sequence's ranges meet its frames as one array, so a range costs nothing by its length.
    """
    i = F.col("frame_idx")

    def inside(spans):
        return true(F.exists(spans, lambda r: (i >= r["start"]) & (i <= r["end"])))

    if isinstance(ranges, list):
        spans = [F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ranges]
        return frames.withColumn("discarded", inside(F.array(*spans)) if spans else F.lit(False))
    each = ranges.groupBy("seq_id").agg(F.collect_list(F.struct("start", "end")).alias("_spans"))
    return frames.join(each, "seq_id", "left").withColumn("discarded", inside(F.col("_spans"))).drop("_spans")


def discard_messages(ranges: DataFrame, lengths: DataFrame) -> DataFrame:
    """seq_id, start and message of every range that begins within its sequence (``seq_id``, ``frames``)."""
    cut = ranges.join(lengths, "seq_id").filter(F.col("start") < F.col("frames")).withColumn("end", F.least("end", F.col("frames") - 1))
    one, many = (F.format_string(x, *[F.col(c).cast("long") for c in cs]) for x, cs in (("frame descartado por perfil: src %d", ("start",)), ("rango descartado por perfil: src %d-%d", ("start", "end"))))
    return cut.select("seq_id", "start", F.when(F.col("start") == F.col("end"), one).otherwise(many).alias("message"))


def selection(frames: DataFrame, manual: DataFrame) -> DataFrame:
    """``mask``, ``origin`` and ``selection_reason`` by the manual actions (seq_id, frame_idx, action).

    Drops always win over the automatic decision; keeps only bring back clipped frames that are centred
    and not discarded by a profile.  Any other keep, and a frame that is both, is an error.
    """
    t = P.SELECTION_REASONS
    acts = manual.groupBy("seq_id", "frame_idx").agg(F.bool_or(F.col("action") == "drop").alias("_drop"), F.bool_or(F.col("action") == "keep").alias("_keep"))
    f = frames.join(acts, ["seq_id", "frame_idx"], "left")
    drop, keep, gone = true(F.col("_drop")), true(F.col("_keep")), F.col("discarded")
    wrong = F.when(drop & keep, "both dropped and kept").when(keep & (F.col("centering") == 2), "kept without a centre").when(keep & (F.col("content") != 1), "kept but not clipped").when(keep & gone, "kept but discarded by the profile")
    at = F.concat(F.lit("frame "), F.col("frame_idx").cast("string"), F.lit(" is "), wrong)
    mask = F.when(wrong.isNotNull(), F.raise_error(at).cast("boolean")).when(drop, False).when(keep, True).otherwise(F.col("auto_keep") & ~gone)
    origin = F.when(drop | keep, "manual").when(gone, "profile").otherwise("auto")
    why = F.when(drop, t["drop"]).when(keep, t["keep"]).when(gone, t["profile"]).otherwise("")
    return f.withColumn("mask", mask).withColumn("origin", origin).withColumn("selection_reason", why).drop("_drop", "_keep")


def manual_counts(selected: DataFrame) -> DataFrame:
    """How many frames of each sequence were dropped and kept by hand."""
    by_hand = F.col("origin") == "manual"
    return selected.groupBy("seq_id").agg(F.count_if(by_hand & ~F.col("mask")).alias("dropped"), F.count_if(by_hand & F.col("mask")).alias("recovered"))
