"""Tolerant parsers: stream metadata, frame lists, discard profiles, frame-rate logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STREAM = "struct<streams:array<struct<width:string,height:string,avg_frame_rate:string,r_frame_rate:string,nb_frames:string,duration:string>>,format:struct<duration:string>>"


def positive_number(text: Column) -> Column:
    """A positive finite number, or null."""
    x = F.trim(text).try_cast("double")
    return F.when((x > 0) & (x < float("inf")), x)


def absent(text: Column) -> Column:
    """Nothing, blank or N/A."""
    return F.coalesce(F.trim(text).isin("", "N/A"), F.lit(True))


def positive_count(text: Column) -> Column:
    """A positive whole number; null for anything else (``bad_count`` tells absent from wrong)."""
    x = F.when(F.trim(text).rlike(r"^[+-]?[0-9]+$"), F.trim(text).try_cast("bigint"))
    return F.when(x > 0, x)


def bad_count(text: Column) -> Column:
    """Whether a count is there but is no positive whole number, which is an error."""
    return ~absent(text) & positive_count(text).isNull()


def positive_ratio(text: Column) -> Column:
    """``a/b``, if it is positive and finite; a number without a slash is none."""
    cut = F.instr(F.trim(text), "/")
    a, b = (F.trim(x).try_cast("double") for x in (F.substring(F.trim(text), F.lit(1), cut - 1), F.substring(F.trim(text), cut + 1, F.length(text))))
    x = F.try_divide(a, b)
    return F.when((cut > 0) & (x > 0) & (x < float("inf")), x)


def probe(raw: Column) -> Column:
    """Width, height, fps, duration, frames and whether frames are estimated, from probe JSON; or ``error``.

    Duration comes from the container, else the stream, else frames over rate; the rate from the
    average, else the base rate, else frames over duration; frames else from duration times rate.
    ``error`` names the first thing that is missing or wrong: json, stream, width, height, frames, fps
    or duration; the other fields are null then.
    """
    made = F.from_json(raw, STREAM)

    def read(m):
        s = F.get(m["streams"], F.lit(0))
        listed = F.coalesce(positive_ratio(s["avg_frame_rate"]), positive_ratio(s["r_frame_rate"]))
        timed = F.coalesce(positive_number(m["format"]["duration"]), positive_number(s["duration"]))
        fields = {"stream": s.isNotNull(), "w": positive_count(s["width"]), "h": positive_count(s["height"]), "counted": positive_count(s["nb_frames"]), "bad": bad_count(s["nb_frames"]), "listed": listed, "timed": timed}
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    def derive(x):
        return F.struct(*[x[k].alias(k) for k in ("stream", "w", "h", "counted", "bad")], F.coalesce(x["listed"], x["counted"] / x["timed"]).alias("fps"), F.coalesce(x["timed"], x["counted"] / x["listed"]).alias("duration"))

    good = F.try_parse_json(raw).isNotNull()

    def judge(x):
        tests = ((~good, "json"), (~x["stream"], "stream"), (x["w"].isNull(), "width"), (x["h"].isNull(), "height"), (x["bad"], "frames"), (x["fps"].isNull(), "fps"), (x["duration"].isNull(), "duration"))
        return F.struct(x.alias("x"), F.coalesce(*[F.when(F.coalesce(t, F.lit(True)), name) for t, name in tests]).alias("error"))

    def fields_of(j):
        x = j["x"]
        frames = F.coalesce(x["counted"], F.rint(x["duration"] * x["fps"]).cast("bigint"))
        values = {"width": x["w"], "height": x["h"], "fps": x["fps"], "duration": x["duration"], "frames": frames, "estimated": x["counted"].isNull()}
        return F.struct(*[F.when(j["error"].isNull(), v).alias(n) for n, v in values.items()], j["error"].alias("error"))

    return _let(_let(_let(_let(made, read), derive), judge), fields_of)


def _let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), then)[0]


#: A measurement of a rate log: a number, then irregular and regular transitions.
RATE = r"VFR:([0-9.eE+NnIi-]+) \(([0-9]+)/([0-9]+)\)"


def rate_log(raw: Column) -> Column:
    """The last usable ``VFR:x (v/c)`` of a log: irregular transitions, transitions and frames."""
    x, v, c = (F.regexp_extract_all(raw, F.lit(RATE), F.lit(i)) for i in (1, 2, 3))
    each = F.transform(F.arrays_zip(x.alias("x"), v.alias("v"), c.alias("c")), lambda m: F.struct(m["x"].try_cast("double").alias("x"), m["v"].cast("bigint").alias("v"), m["c"].cast("bigint").alias("c")))
    finite = F.filter(each, lambda m: F.coalesce(m["x"].isNotNull() & ~F.isnan(m["x"]) & (F.abs(m["x"]) < float("inf")), F.lit(False)) & (m["v"] + m["c"] > 0))
    last = F.get(finite, F.size(finite) - 1)
    return F.when(F.size(finite) > 0, F.struct(last["v"].alias("irregular"), (last["v"] + last["c"]).alias("transitions"), (last["v"] + last["c"] + 1).alias("frames")))


def exact_counts(info: DataFrame, logs: DataFrame) -> DataFrame:
    """``info`` (seq_id, fps, duration, frames, exact) with the counts of the rate logs (seq_id, log) in
    place of estimated ones; a log without a measurement where one is needed is an error."""
    both = info.join(logs.select("seq_id", rate_log(F.col("log")).alias("_found")), "seq_id", "left")
    need = ~F.col("exact")
    found = F.when(need & F.col("_found").isNull(), F.raise_error(F.concat(F.lit("no count for sequence "), F.col("seq_id").cast("string"))).cast("bigint")).otherwise(F.col("_found.frames"))
    return both.withColumns({"frames": F.when(need, found).otherwise(F.col("frames")), "duration": F.when(need, found / F.col("fps")).otherwise(F.col("duration")), "exact": F.lit(True)}).drop("_found")


def frame_list(specs: DataFrame, spec: str, total: int) -> DataFrame:
    """spec and frame_idx for lists such as ``20-24,700``; bad items raise, null and blank give none."""
    blank = F.coalesce(F.trim(F.col(spec)) == "", F.lit(True))
    item = specs.filter(~blank).select(spec, F.explode(F.split(F.col(spec), ",")).alias("_item")).withColumn("_item", F.trim("_item"))
    a = F.regexp_extract("_item", r"^(\d+)(?:\s*-\s*(\d+))?$", 1)
    b = F.regexp_extract("_item", r"^(\d+)(?:\s*-\s*(\d+))?$", 2)
    low, high = a.try_cast("bigint"), F.when(b == "", a).otherwise(b).try_cast("bigint")
    bad = low.isNull() | high.isNull() | (low > high) | (high >= total)
    checked = F.when(bad, F.raise_error(F.concat(F.lit("bad frame list item: "), F.col("_item"))).cast("bigint")).otherwise(low)
    return item.select(spec, F.explode(F.sequence(checked, high)).alias("frame_idx")).distinct()


PROFILE = "struct<version:bigint,name:string,description:string,discards:array<struct<frame:bigint,start:bigint,end:bigint,reason:string>>>"


def discards(profiles: DataFrame, raw: str) -> DataFrame:
    """start and end of every discard of a version 1 profile; anything else in it raises."""
    made = F.from_json(F.col(raw), PROFILE)
    unknown = F.size(F.array_except(F.json_object_keys(raw), F.array(*map(F.lit, ("version", "name", "description", "discards"))))) > 0
    each = profiles.select(F.when(unknown | ~F.coalesce(made["version"] == 1, F.lit(False)), F.raise_error(F.lit("bad profile")).cast("array<struct<frame:bigint,start:bigint,end:bigint,reason:string>>")).otherwise(made["discards"]).alias("d"))
    rows = each.select(F.inline("d")).select(F.coalesce("frame", "start").alias("start"), F.coalesce("frame", "end").alias("end"))
    fine = (F.col("start") >= 0) & (F.col("start") <= F.col("end"))
    return rows.select(F.when(F.coalesce(fine, F.lit(False)), F.col("start")).otherwise(F.raise_error(F.lit("bad discard")).cast("bigint")).alias("start"), "end")


def scaled_height(width: Column, height: Column, to: int) -> Column:
    """The height at another width, half to even, made even."""
    h = F.rint(height * F.lit(float(to)) / width).cast("bigint")
    return h + h % 2


def output_name(path: Column) -> Column:
    """A folder name: the file's stem in plain characters and eight digits of the path's hash."""
    stem = F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"(.)\.[^.]+$", "$1")
    plain = F.regexp_replace(F.regexp_replace(stem, r"[^A-Za-z0-9._-]+", "_"), r"^[._-]+|[._-]+$", "")
    return F.concat(F.when(plain == "", "video").otherwise(plain), F.lit("_"), F.substring(F.sha2(path, 256), 1, 8), F.lit("_output"))


def fixed(x: Column, digits: int) -> Column:
    """A number with ``digits`` after the point, as ``printf`` has it: by its exact value, halves to even.

    ``format_string`` rounds halves up, and by the shortest text of the number.
    """
    return F.call_function("format_number", x.cast("double"), F.lit("0." + "0" * digits))


def sequence_text(frames: Column, fps: Column, duration: Column, exact: Column) -> Column:
    """A sequence's figures as one line."""
    line = F.format_string("%d frames, %s fps, %s s", frames.cast("long"), fixed(fps, 3), fixed(duration, 2))
    return F.concat(line, F.when(exact, "").otherwise(" (metadatos provisionales; cadencia/conteo sin verificar)"))


def check_options(analysis_width: int = 270, radius: float | None = None, debug_width: int = 320, max_images: int = 10000) -> None:
    """Raise ValueError for options that no analysis can be made with."""
    if analysis_width < 160:
        raise ValueError("analysis_width is at least 160")
    if radius is not None and not radius > 0:
        raise ValueError("radius is positive")
    if debug_width < 64:
        raise ValueError("debug_width is at least 64")
    if max_images < 0:
        raise ValueError("max_images is not negative")


def inspect_frames(start: int, end: int, samples: int, frames: int) -> list[int]:
    """Evenly spaced frames of a part of a sequence; a negative ``end`` is its last frame."""
    first, last = max(0, start), frames - 1 if end < 0 else min(frames - 1, end)
    if last < first:
        raise ValueError("end is before start")
    return sorted({first + i * (last - first) // (samples - 1) for i in range(samples)}) if samples > 1 else [first][:samples]
