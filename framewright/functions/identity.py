"""Cache identity: what an analysis depends on, as (name, value) rows, and how a stored one compares.

Values are texts as they are shown in messages: texts in quotes, numbers and booleans plain.  A
sequence's identity is a few rows; many sequences compare in one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import VERSIONS

#: The fields, in order (fixed values).
FIELDS = (
    "version source_path source_size source_mtime_ns width height fps frames frame_count_exact analysis_width analysis_height radius_requested profile_path profile_hash min_quality "
    "visible_version contrast_version clip_version tear_version"
).split()
#: The per-frame and per-sequence arrays that a stored analysis has to have (fixed values).
REQUIRED = (
    "raw_center quality coverage median_residual threshold touch radial_points radial_strength visible_center relative response maximum radius radius_meas clip_edges clip_score tear_evaluable "
    "tear_bright_level tear_visible_threshold tear_exposed_fraction tear_reason analysis_width analysis_height source_frames source_fps contrast_center contrast_score arc_center arc_measured "
    "arc_valid_points arc_coverage arc_median_residual arc_strength arc_gap_deg arc_gap_angle geometry_source geometry_prediction geometry_innovation contrast_dynamic_offset contrast_offset_sample "
    "fallback_reanchored fallback_supported fallback_innovation fallback_mode"
).split()
REFRESHABLE, PREFIX, SHOWN = "contrast_version", "id_", 6
LEGACY = "caché legacy sin metadatos de identidad (campos id_*)"


def profile_hash(discards: Column) -> Column:
    """SHA-256 of a profile's canonical JSON; empty without one.  ``discards``: array<struct<start, end>>, or null."""
    spans = F.transform(discards, lambda d: F.concat(F.lit("["), d["start"].cast("string"), F.lit(","), d["end"].cast("string"), F.lit("]")))
    return F.when(discards.isNull(), "").otherwise(F.sha2(F.concat(F.lit('{"discards":['), F.array_join(spans, ","), F.lit('],"version":1}')), 256))


def shown(value: Column, kind: str) -> Column:
    """A value as messages show it."""
    if kind == "string":
        return F.concat(F.lit("'"), value, F.lit("'"))
    if kind == "boolean":
        return F.when(value, "True").otherwise("False")
    if kind in ("double", "float"):
        return F.when(value == F.rint(value), F.concat(value.cast("bigint").cast("string"), F.lit(".0"))).otherwise(value.cast("string"))
    return value.cast("string")


def build(info: DataFrame) -> DataFrame:
    """``info`` (seq_id and the fields but the versions) as (seq_id, name, value) rows, versions added."""
    kinds = {f.name: f.dataType.typeName() for f in info.schema}
    pairs = [F.struct(F.lit(n).alias("name"), (F.lit(str(VERSIONS[n])) if n in VERSIONS else shown(F.col(n), kinds[n])).alias("value")) for n in FIELDS]
    return info.select("seq_id", F.inline(F.array(*pairs)))


def digest(identity: DataFrame) -> DataFrame:
    """seq_id and the SHA-256 of the fields, in order of their names."""
    listed = F.array_sort(F.collect_list(F.struct("name", "value")))
    return identity.groupBy("seq_id").agg(F.sha2(F.array_join(F.transform(listed, lambda x: F.concat(x["name"], F.lit("="), x["value"])), "\n"), 256).alias("digest"))


def pack(identity: DataFrame) -> DataFrame:
    """One row per sequence with the fields as columns under the prefix ``id_``."""
    wide = identity.groupBy("seq_id").pivot("name", sorted(FIELDS)).agg(F.first("value"))
    return wide.select("seq_id", *[F.col(n).alias(PREFIX + n) for n in FIELDS])


def unpack(stored: DataFrame) -> DataFrame:
    """The (seq_id, name, value) rows of the columns under the prefix; fields that are null are absent."""
    names = [c for c in stored.columns if c.startswith(PREFIX)]
    return stored.select("seq_id", F.inline(F.array(*[F.struct(F.lit(n[len(PREFIX) :]).alias("name"), F.col(n).cast("string").alias("value")) for n in names]))).filter("value is not null")


def mismatches(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """seq_id, name and reason of every expected field that is stored otherwise, or not at all.  Other
    stored fields don't matter; a sequence without any stored field has one reason."""
    s = stored.select("seq_id", "name", F.col("value").alias("_stored"))
    both = expected.join(s, ["seq_id", "name"], "left").withColumn("_any", F.count("_stored").over(Window.partitionBy("seq_id")))
    differ = F.concat(F.lit("'"), F.col("name"), F.lit("' difiere: caché="), F.col("_stored"), F.lit(", esperado="), F.col("value"))
    reason = F.when(F.col("_stored").isNull(), F.concat(F.lit("falta el campo de identidad '"), F.col("name"), F.lit("'"))).when(F.col("_stored") != F.col("value"), differ)
    found = both.withColumn("reason", reason).filter("reason is not null and _any > 0").select("seq_id", "name", "reason")
    legacy = both.filter("_any = 0").select("seq_id").distinct().select("seq_id", F.lit(None).cast("string").alias("name"), F.lit(LEGACY).alias("reason"))
    return found.unionByName(legacy)


def structure(keys: DataFrame) -> DataFrame:
    """seq_id and reason of the stored analyses (seq_id, ``keys``: array of names) that lack arrays."""
    lacking = F.array_sort(F.array_except(F.array(*map(F.lit, REQUIRED)), F.col("keys")))
    text = F.concat(F.lit("caché incompleta; faltan arrays: "), F.array_join(F.slice(lacking, 1, SHOWN), ", "), F.when(F.size(lacking) > SHOWN, "...").otherwise(""))
    return keys.select("seq_id", lacking.alias("_lacking"), text.alias("reason")).filter(F.size("_lacking") > 0).drop("_lacking")


def cache_status(expected: DataFrame, stored: DataFrame, keys: DataFrame) -> DataFrame:
    """seq_id, state and reasons of every expected sequence.

    missing (no ``keys`` row), valid, refreshable (whole, and only the contrast version differs) or
    incompatible.
    """
    wrong = mismatches(expected, stored).groupBy("seq_id").agg(F.array_sort(F.collect_list("reason")).alias("_wrong"), F.bool_and(F.coalesce(F.col("name") == REFRESHABLE, F.lit(False))).alias("_soft"))
    s = structure(keys).withColumnRenamed("reason", "_broken")
    out = expected.select("seq_id").distinct().join(keys.select("seq_id", F.lit(True).alias("_there")), "seq_id", "left").join(wrong, "seq_id", "left").join(s, "seq_id", "left")
    there = F.coalesce("_there", F.lit(False))
    reasons = F.concat(F.coalesce("_wrong", F.array().cast("array<string>")), F.array_compact(F.array("_broken")))
    state = F.when(~there, "missing").when(F.size(reasons) == 0, "valid").when(F.col("_broken").isNull() & F.col("_soft"), "refreshable").otherwise("incompatible")
    return out.select("seq_id", state.alias("state"), F.when(there, F.array_join(reasons, "; ")).otherwise("").alias("reasons"))


def overwrite(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the columns of ``new``: those of the same name are replaced, others added, by ``keys``."""
    kept = [c for c in old.columns if c in keys or c not in new.columns]
    return old.select(*kept).join(new, keys)
