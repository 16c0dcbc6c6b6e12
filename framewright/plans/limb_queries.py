"""Queries of images, candidates, identities and reports, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import identity, kernels, parse
from ..operators import limb, policy, seqops, summary
from ..params import VERSIONS
from ..sources import images
from ..sources.frames import load_frames
from ..sources.sequences import with_scalars
from . import decide
from . import decision_sql as D
from .queries import FRAMES, _selected, contrasted, decisions_of, measured, query, r6, ranges_of

#: The images of ``images.disks`` as pixels.
PIXELS = """pm AS (SELECT s_suppkey AS id, s_suppkey // 25 AS seq_id, s_suppkey % 25 AS frame_idx, 36 + s_suppkey % 5 - 2 AS cx, 48 + s_suppkey % 7 - 3 AS cy,
 CASE s_suppkey % 4 WHEN 0 THEN 17 WHEN 2 THEN -17 ELSE 0 END AS mx, CASE s_suppkey % 4 WHEN 1 THEN 17 WHEN 3 THEN -17 ELSE 0 END AS my FROM supplier WHERE s_suppkey <= 50),
pq AS MATERIALIZED (SELECT id, seq_id, frame_idx, cx, cy, x, y, CASE WHEN id % 3 = 0 AND y > cy + 8 THEN 0 WHEN (x - cx) * (x - cx) + (y - cy) * (y - cy) <= 576 AND (x - cx - mx) * (x - cx - mx) + (y - cy - my) * (y - cy - my) > 576
 THEN 70 + 7 * (id % 25) + (3 * x + 5 * y) % 7 WHEN (x + 2 * y + id) % 11 = 0 THEN 6 ELSE 2 END AS v FROM pm, range(96) AS ty(y), range(72) AS tx(x))"""


def pictures(spark, sf_dir) -> DataFrame:
    """The first fifty suppliers' test images: the images are what the query is about, not the suppliers."""
    return images.disks(spark.read.parquet(f"{sf_dir}/supplier.parquet").filter("s_suppkey <= 50"), "s_suppkey")


@query(
    f""", {PIXELS}, dd AS (SELECT *, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS d FROM pq),
lv AS (SELECT seq_id, frame_idx, count(*) FILTER (WHERE d <= 21.6) AS n, quantile_cont(CAST(v AS DOUBLE), 0.9) FILTER (WHERE d <= 21.6) AS bright, quantile_cont(CAST(v AS DOUBLE), 0.1) FILTER (WHERE d <= 21.6) AS low,
 quantile_cont(CAST(v AS DOUBLE), 0.2) FILTER (WHERE d >= 24.72 AND d <= 28.32) AS ring FROM dd GROUP BY ALL),
lw AS (SELECT *, least(low, coalesce(ring, low)) AS dark FROM lv), lx AS (SELECT *, n >= 452 AND bright >= 32 AND bright - dark >= 0.2::double * bright AS evaluable, dark + 0.2::double * (bright - dark) AS visible FROM lw)
SELECT seq_id, frame_idx, any_value(evaluable) AS evaluable, round(any_value(bright), 6) AS bright, round(any_value(dark), 6) AS dark, CASE WHEN any_value(evaluable) THEN round(any_value(visible), 6) END AS visible,
 CASE WHEN any_value(evaluable) THEN round(avg(CAST(v >= visible AS INT)) FILTER (WHERE d <= 20.16), 6) END AS exposed FROM dd JOIN lx USING (seq_id, frame_idx) GROUP BY seq_id, frame_idx"""
)
def exposure_levels(spark, sf_dir):
    found = images.per_image(pictures(spark, sf_dir), lambda gray, row: kernels.exposed_fraction(gray, (row["cx"], row["cy"]), 24.0), "evaluable boolean, exposed double, bright double, dark double, visible double")
    return found.select("seq_id", "frame_idx", "evaluable", *r6("bright", "dark", "visible", "exposed"))


def _list_sql(fixed: tuple, shares: tuple) -> str:
    values = ", ".join([*(f"{v}::double" for v in fixed), *(f"{v}::double * top" for v in shares), "CAST(otsu AS DOUBLE)"])
    return f"list_transform(list_sort(list_distinct(list_transform(list_filter([{values}], lambda v: v >= 5 AND v <= 0.9::double * top), lambda v: round_even(v, 1)))), lambda v: CAST(round(v * 10) AS INTEGER))"


@query(
    f""", {PIXELS}, hi AS (SELECT seq_id, frame_idx, v, count(*) AS n FROM pq GROUP BY ALL),
cu AS (SELECT *, sum(n) OVER w AS below, sum(n * v) OVER w AS mass, sum(n) OVER (PARTITION BY seq_id, frame_idx) AS total, sum(n * v) OVER (PARTITION BY seq_id, frame_idx) AS all_ FROM hi WINDOW w AS (PARTITION BY seq_id, frame_idx ORDER BY v ROWS UNBOUNDED PRECEDING)),
bt AS (SELECT *, CASE WHEN below < total THEN power(all_ * below / CAST(total AS DOUBLE) - mass, 2) / (CAST(below AS DOUBLE) * (total - below)) ELSE -1 END AS between_ FROM cu),
ot AS (SELECT seq_id, frame_idx, arg_max(v, struct_pack(b := between_, t := -v)) AS otsu, CAST(max(v) AS DOUBLE) AS top FROM bt GROUP BY ALL)
SELECT seq_id, frame_idx, otsu, array_to_string({_list_sql((8, 12, 18, 25), (0.12, 0.22))}, ',') AS limb, array_to_string({_list_sql((10, 15, 20), (0.20, 0.30))}, ',') AS clip FROM ot"""
)
def threshold_lists(spark, sf_dir):
    """Thresholds in tenths."""

    def lists(gray, row):
        tenths = lambda values: ",".join(str(round(10 * v)) for v in values)
        return {"otsu": kernels.otsu(gray), "limb": tenths(kernels.limb_thresholds(gray)), "clip": tenths(kernels.clipping_thresholds(gray))}

    return images.per_image(pictures(spark, sf_dir), lists, "otsu int, limb string, clip string")


@query(f", {PIXELS} SELECT seq_id, frame_idx, round(sum(x * v) / CAST(sum(v) AS DOUBLE), 6) AS x, round(sum(y * v) / CAST(sum(v) AS DOUBLE), 6) AS y FROM pq WHERE v > 40 GROUP BY seq_id, frame_idx")
def bright_centroids(spark, sf_dir):
    def at(gray, row):
        found = kernels.centroid(gray, 40)
        return {"x": found[0], "y": found[1]} if found else []

    return images.per_image(pictures(spark, sf_dir), at, "x double, y double").select("seq_id", "frame_idx", *r6("x", "y"))


@query(
    f""", {PIXELS}, sm AS (SELECT seq_id, frame_idx, y // 2 AS y, x // 2 AS x, avg(v) AS v FROM pq GROUP BY ALL),
sh AS (SELECT seq_id, frame_idx + 1 AS frame_idx, x, y, v FROM sm)
SELECT sm.seq_id, sm.frame_idx, round(avg(abs(sm.v - sh.v)), 6) AS change FROM sm JOIN sh USING (seq_id, frame_idx, x, y) GROUP BY sm.seq_id, sm.frame_idx"""
)
def half_size_change(spark, sf_dir):
    """How much the images at half size differ from the ones before."""

    def change(gray, row):
        if row["before"] is None:
            return []
        return {"change": float(abs(kernels.half_size(gray) - kernels.half_size(images.decode(row, "before"))).mean())}

    return images.per_image(images.with_previous(pictures(spark, sf_dir)), change, "change double").select("seq_id", "frame_idx", *r6("change"))


LIMB = "x double, y double, quality double, threshold double, touch boolean, coverage double, residual double, points int, strength double, radius double"


@query()
def limb_detections(spark, sf_dir):
    """The limb of every test image; contours and rays have no SQL, the tests hold it against the drawn disks."""
    return images.per_image(pictures(spark, sf_dir), lambda gray, row: kernels.detect_limb(gray, 24.0, None, 72 / 270), LIMB)


@query()
def clipped_edges(spark, sf_dir):
    """Which borders cut the bright part, of test images whose left half is cut off where the id is even."""

    def edges(gray, row):
        cut = gray[:, int(row["cx"]) - 6 :] if row["id"] % 2 == 0 else gray
        found = kernels.clipping(cut, (6.0 if row["id"] % 2 == 0 else row["cx"], row["cy"]), 24.0, 72 / 270)
        return {"edges": ",".join(found["edges"]), "score": found["score"]}

    return images.per_image(pictures(spark, sf_dir), edges, "edges string, score double")


#: Three candidates of every frame.
CANDIDATES = """ca AS (SELECT seq_id, frame_idx, k, 12 + 6 * j AS threshold, ((k * 7 + j * 13) % 20) / 20.0::double AS quality, j + 1 AS label, 40 + (k * 31 + j * 57) % 400 AS area, CAST(100 + (k * 17 + j * 29) % 60 AS DOUBLE) AS cx,
 CAST(160 + (k * 11 + j * 37) % 50 AS DOUBLE) AS cy, 120 + 0.2::double * frame_idx AS x, 180 + 0.1::double * frame_idx AS y, (k + j) % 9 = 0 AS touch, 20 + (k + j * 10) % 60 AS points, 80 + ((k * 13 + j * 7) % 41 - 20) * 0.9::double AS radius, 270 AS width
 FROM f, range(3) AS t(j))"""


def candidates(spark, sf_dir) -> DataFrame:
    k, j, i = F.col("k"), F.col("j"), F.col("frame_idx")
    f = load_frames(spark, sf_dir).select("seq_id", "frame_idx", "k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))).alias("j"))
    return f.select(
        "seq_id", "frame_idx", "k", (12 + 6 * j).alias("threshold"), ((k * 7 + j * 13) % 20 / F.lit(20.0)).alias("quality"), (j + 1).alias("label"), (40 + (k * 31 + j * 57) % 400).alias("area"), (100 + (k * 17 + j * 29) % 60).cast("double").alias("cx"),
        (160 + (k * 11 + j * 37) % 50).cast("double").alias("cy"), (120 + F.lit(0.2) * i).alias("x"), (180 + F.lit(0.1) * i).alias("y"), ((k + j) % 9 == 0).alias("touch"), (20 + (k + j * 10) % 60).alias("points"),
        (80 + ((k * 13 + j * 7) % 41 - 20) * F.lit(0.9)).alias("radius"), F.lit(270).alias("width"),
    )


@query(f", {CANDIDATES} SELECT seq_id, frame_idx, threshold, quality FROM ca QUALIFY row_number() OVER (PARTITION BY seq_id, frame_idx ORDER BY quality DESC, threshold) = 1")
def best_thresholds(spark, sf_dir):
    return limb.best_candidate(candidates(spark, sf_dir)).select("seq_id", "frame_idx", "threshold", "quality")


@query(f", {CANDIDATES} SELECT seq_id, frame_idx, label, area FROM ca WHERE area BETWEEN 80 AND 400 QUALIFY row_number() OVER (PARTITION BY seq_id, frame_idx ORDER BY area DESC, label) = 1")
def largest_components(spark, sf_dir):
    return limb.largest_component(candidates(spark, sf_dir), 80, 400).select("seq_id", "frame_idx", "label", "area")


@query(f", {CANDIDATES} SELECT seq_id, frame_idx, label, round({D.hyp('cx - x', 'cy - y')}, 6) AS distance FROM ca WHERE area BETWEEN 80 AND 400 QUALIFY row_number() OVER (PARTITION BY seq_id, frame_idx ORDER BY {D.hyp('cx - x', 'cy - y')}, label) = 1")
def nearest_components(spark, sf_dir):
    return limb.nearest_component(candidates(spark, sf_dir), 80, 400).select("seq_id", "frame_idx", "label", *r6("distance"))


_CALIBRATED = f"""{CANDIDATES}, so AS (SELECT * FROM ca WHERE NOT touch AND points >= 30 AND radius > 54 AND radius < 129.6),
mi AS (SELECT seq_id, median(radius) AS middle, count(*) AS found FROM so GROUP BY seq_id HAVING count(*) >= 4),
cr AS (SELECT so.seq_id, median(radius) FILTER (WHERE abs(radius - middle) <= greatest(2, 0.04::double * middle)) AS radius, count(*) FILTER (WHERE abs(radius - middle) <= greatest(2, 0.04::double * middle)) AS used, any_value(found) AS found FROM so JOIN mi USING (seq_id) GROUP BY so.seq_id)"""


@query(f", {_CALIBRATED} SELECT seq_id, round(radius, 6) AS radius, used, found FROM cr")
def calibrated_radius(spark, sf_dir):
    return limb.calibrate_radius(candidates(spark, sf_dir)).select("seq_id", *r6("radius"), "used", "found")


@query(f", {_CALIBRATED} SELECT seq_id, CASE WHEN seq_id % 3 = 0 THEN 77.5 ELSE round(radius, 6) END AS radius FROM cr")
def resolved_radius(spark, sf_dir):
    seqs = load_frames(spark, sf_dir).select("seq_id").distinct().withColumn("radius", F.when(F.col("seq_id") % 3 == 0, F.lit(77.5)))
    return limb.resolve_radius(seqs, candidates(spark, sf_dir)).select("seq_id", *r6("radius"))


@query("SELECT seq_id, frame_idx, k FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY frame_idx) - 1 AS nth, count(*) OVER (PARTITION BY seq_id) AS n FROM f) WHERE nth % greatest(1, CAST(ceil(n / 20.0) AS BIGINT)) = 0")
def decimated_points(spark, sf_dir):
    return limb.decimate(load_frames(spark, sf_dir), ["seq_id"], "frame_idx", 20).select("seq_id", "frame_idx", "k")


_CONTACTS = """cn AS (SELECT seq_id, frame_idx, threshold, e.edge AS edge, (k * e.m + threshold) % 12 AS count, (k + e.m) % 4 AS core FROM ca, (VALUES ('left', 3), ('right', 5), ('top', 7), ('bottom', 11)) AS e(edge, m))"""


@query(
    f""", {CANDIDATES}, {_CONTACTS}, vo AS (SELECT seq_id, frame_idx, edge, count(*) FILTER (WHERE count >= 5 AND core >= 2) AS votes, count(DISTINCT threshold) AS n FROM cn GROUP BY ALL)
SELECT seq_id, frame_idx, coalesce(string_agg(CASE WHEN votes >= 2 THEN edge END, ',' ORDER BY edge), '') AS edges, round(max(votes) / CAST(max(n) AS DOUBLE), 6) AS score, coalesce(max(votes) >= 2, false) AS clipped FROM vo GROUP BY seq_id, frame_idx"""
)
def edge_votes(spark, sf_dir):
    edges = F.array(*[F.struct(F.lit(e).alias("edge"), F.lit(m).alias("m")) for e, m in (("left", 3), ("right", 5), ("top", 7), ("bottom", 11))])
    c = candidates(spark, sf_dir).withColumn("e", F.explode(edges)).select("seq_id", "frame_idx", "threshold", "e.edge", ((F.col("k") * F.col("e.m") + F.col("threshold")) % 12).alias("count"), ((F.col("k") + F.col("e.m")) % 4).alias("core"))
    return limb.edge_votes(c, 5).select("seq_id", "frame_idx", F.concat_ws(",", "edges").alias("edges"), *r6("score"), "clipped")


#: Points of a circle of radius 30 with whole-number noise, and steps around a circle.
_POINTS = "po AS (SELECT seq_id, 100 + seq_id % 7 + (30 + 0.01::double * (k % 9)) * cos(0.05::double * frame_idx) AS x, 50 + (30 + 0.01::double * (k % 9)) * sin(0.05::double * frame_idx) AS y, (frame_idx * 7 + k) % 360 AS step FROM f)"


def points(spark, sf_dir) -> DataFrame:
    i, k = F.col("frame_idx"), F.col("k")
    r = 30 + F.lit(0.01) * (k % 9)
    return load_frames(spark, sf_dir).select("seq_id", (100 + F.col("seq_id") % 7 + r * F.cos(F.lit(0.05) * i)).alias("x"), (50 + r * F.sin(F.lit(0.05) * i)).alias("y"), ((i * 7 + k) % 360).alias("step"))


@query(
    f""", {_POINTS}, mn AS (SELECT *, x - avg(x) OVER (PARTITION BY seq_id) AS u, y - avg(y) OVER (PARTITION BY seq_id) AS v FROM po),
su AS (SELECT seq_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, sum(u * u) AS uu, sum(v * v) AS vv, sum(u * v) AS uv, sum(u * (u * u + v * v)) AS uz, sum(v * (u * u + v * v)) AS vz FROM mn GROUP BY seq_id),
ab AS (SELECT *, (uz * vv - vz * uv) / (2 * (uu * vv - uv * uv)) AS a, (vz * uu - uz * uv) / (2 * (uu * vv - uv * uv)) AS b FROM su WHERE n >= 6)
SELECT seq_id, round(a + mx, 6) AS cx, round(b + my, 6) AS cy, round(sqrt(a * a + b * b + (uu + vv) / n), 6) AS radius FROM ab"""
)
def algebraic_circles(spark, sf_dir):
    return limb.algebraic_circles(points(spark, sf_dir), ["seq_id"]).select("seq_id", *r6("cx", "cy", "radius"))


@query(
    f""", {_POINTS}, st AS (SELECT DISTINCT seq_id, step FROM po), af AS (SELECT *, coalesce(lead(step) OVER (PARTITION BY seq_id ORDER BY step), min(step) OVER (PARTITION BY seq_id) + 360) - step AS wide FROM st)
SELECT seq_id, CAST(wide - 1 AS DOUBLE) AS gap, CAST((2 * step + wide) // 2 % 360 AS DOUBLE) AS gap_angle FROM af QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY wide DESC, step) = 1"""
)
def angular_gaps(spark, sf_dir):
    return limb.angular_gap(points(spark, sf_dir), ["seq_id"])


@query(
    f""", {_POINTS}, sc AS (SELECT seq_id, sum(cos(radians(step)) * cos(radians(step))) AS a, sum(cos(radians(step)) * sin(radians(step))) AS b, sum(sin(radians(step)) * sin(radians(step))) AS c FROM po GROUP BY seq_id)
SELECT seq_id, round(((a + c) / 2 + {D.hyp('(a - c) / 2', 'b')}) / ((a + c) / 2 - {D.hyp('(a - c) / 2', 'b')}), 5) AS condition FROM sc"""
)
def direction_scatter(spark, sf_dir):
    return limb.condition(points(spark, sf_dir), ["seq_id"]).select("seq_id", F.round("condition", 5).alias("condition"))


@query(f", s AS (SELECT seq_id, frame_idx AS place, k - lead(k, 4) OVER {D.W} AS fall FROM f) SELECT seq_id, place, fall FROM s WHERE fall IS NOT NULL QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY fall DESC, place) = 1")
def steepest_drops(spark, sf_dir):
    return limb.steepest_drop(load_frames(spark, sf_dir).select("seq_id", F.col("frame_idx").alias("at"), F.col("k").alias("value")), ["seq_id"]).withColumnsRenamed({"at": "place", "drop": "fall"})


@query("SELECT seq_id, frame_idx, round(raw_x * (720 + seq_id % 50) / 270.0::double, 6) AS raw_x, round(raw_y * 1280 / 480.0::double, 6) AS raw_y FROM f")
def rescaled_places(spark, sf_dir):
    f = limb.rescaled(load_frames(spark, sf_dir), [("raw_x", "raw_y")], (720 + F.col("seq_id") % 50) / F.lit(270.0), F.lit(1280 / 480))
    return f.select("seq_id", "frame_idx", *r6("raw_x", "raw_y"))


@query(
    f""", q AS (SELECT *, CASE WHEN evaluable AND points >= 35 THEN 80 + 0.01::double * k + CASE WHEN frame_idx // 15 % 3 = seq_id % 3 THEN 9 ELSE 0 END END AS r FROM (SELECT *, k AS points FROM f)),
n AS (SELECT *, count(r) OVER (PARTITION BY seq_id) AS every_, max(frame_idx) OVER (PARTITION BY seq_id) AS end_ FROM q),
g AS (SELECT seq_id, frame_idx // 15 AS w, count(r) AS n, median(r) AS middle, any_value(every_) AS every_, any_value(end_) AS end_ FROM n GROUP BY ALL)
SELECT seq_id, w * 15 AS first_frame, least(w * 15 + 14, end_) AS last_frame, round(middle, 6) AS middle, round(middle / 80 - 1, 6) AS deviation FROM g WHERE n >= 5 AND every_ >= 20 AND abs(middle / 80 - 1) > 0.08"""
)
def scale_drift(spark, sf_dir):
    i, k = F.col("frame_idx"), F.col("k")
    r = 80 + F.lit(0.01) * k + F.when(F.floor(i / 15) % 3 == F.col("seq_id") % 3, 9).otherwise(0)
    f = load_frames(spark, sf_dir).withColumn("points", k).withColumn("radius_meas", F.when(F.col("evaluable"), r))
    return seqops.scale_drift(f, 30.0, 80.0).select("seq_id", "first_frame", "last_frame", *r6("middle", "deviation"))


@query(
    """, s AS (SELECT seq_id, count(*) AS n FROM f GROUP BY seq_id)
SELECT seq_id, 'frames ' || n AS a, printf('%d frames, %.3f fps, %.2f s', n, 24 + seq_id % 3 * 0.5::double, n / (24 + seq_id % 3 * 0.5::double)) || CASE WHEN seq_id % 2 = 0 THEN '' ELSE ' (metadatos provisionales; cadencia/conteo sin verificar)' END AS line FROM s"""
)
def sequence_lines(spark, sf_dir):
    s = load_frames(spark, sf_dir).groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"))
    fps = 24 + F.col("seq_id") % 3 * F.lit(0.5)
    return s.select("seq_id", F.concat(F.lit("frames "), F.col("n").cast("string")).alias("a"), parse.sequence_text(F.col("n"), fps, F.col("n") / fps, F.col("seq_id") % 2 == 0).alias("line"))


@query(
    """, s AS (SELECT seq_id, count(*) AS n FROM f GROUP BY seq_id)
SELECT seq_id, CASE WHEN seq_id % 2 = 0 THEN n ELSE 2 * seq_id + 11 END AS frames, round(CASE WHEN seq_id % 2 = 0 THEN n / 25.0::double ELSE (2 * seq_id + 11) / 25.0::double END, 6) AS duration, true AS exact FROM s"""
)
def exact_counts(spark, sf_dir):
    s = load_frames(spark, sf_dir).groupBy("seq_id").agg(F.count(F.lit(1)).alias("frames"))
    info = s.select("seq_id", "frames", F.lit(25.0).alias("fps"), (F.col("frames") / 25).alias("duration"), (F.col("seq_id") % 2 == 0).alias("exact"))
    i = F.col("seq_id").cast("string")
    logs = s.filter("seq_id % 2 = 1").select("seq_id", F.concat(F.lit("x VFR:0.5 (1/9)\nVFR:1e-05 ("), i, F.lit("/"), (F.col("seq_id") + 10).cast("string"), F.lit(") min: 1\nVFR:nan (4/4)\nVFR:0.0 (0/0)")).alias("log"))
    return parse.exact_counts(info, logs).select("seq_id", "frames", *r6("duration"), "exact")


#: Identities: some stored ones differ in a field, lack one, lack arrays, or aren't there.
def _info(spark, sf_dir) -> DataFrame:
    n = load_frames(spark, sf_dir).groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"))
    i = F.col("seq_id")
    spans = F.array(F.struct((i % 20).alias("start"), (i % 20 + i % 5).alias("end")))
    return n.select(
        "seq_id", F.concat(F.lit("/in/"), i.cast("string"), F.lit(".mp4")).alias("source_path"), (i * 1000).alias("source_size"), (i * 7).alias("source_mtime_ns"), F.lit(720).alias("width"), F.lit(1280).alias("height"),
        (24 + i % 3 * F.lit(0.5)).alias("fps"), F.col("n").alias("frames"), (i % 2 == 0).alias("frame_count_exact"), F.lit(270).alias("analysis_width"), F.lit(480).alias("analysis_height"), F.lit("auto").alias("radius_requested"),
        F.lit("").alias("profile_path"), identity.profile_hash(F.when(i % 3 == 0, spans)).alias("profile_hash"), F.lit(0.18).alias("min_quality"),
    )


_HASH = """CASE WHEN seq_id % 3 = 0 THEN sha256('{"discards":[[' || (seq_id % 20) || ',' || (seq_id % 20 + seq_id % 5) || ']],"version":1}') ELSE '' END"""
_IDENTITY = f"""sq AS (SELECT seq_id, count(*) AS n FROM f GROUP BY seq_id),
idn AS (SELECT seq_id, unnest([{", ".join(f"{{'name': '{n}', 'value': '{VERSIONS[n]}'}}" for n in VERSIONS)},
 {{'name': 'source_path', 'value': '''/in/' || seq_id || '.mp4'''}}, {{'name': 'source_size', 'value': CAST(seq_id * 1000 AS VARCHAR)}}, {{'name': 'source_mtime_ns', 'value': CAST(seq_id * 7 AS VARCHAR)}}, {{'name': 'width', 'value': '720'}}, {{'name': 'height', 'value': '1280'}},
 {{'name': 'fps', 'value': CASE seq_id % 3 WHEN 0 THEN '24.0' WHEN 1 THEN '24.5' ELSE '25.0' END}}, {{'name': 'frames', 'value': CAST(n AS VARCHAR)}}, {{'name': 'frame_count_exact', 'value': CASE WHEN seq_id % 2 = 0 THEN 'True' ELSE 'False' END}},
 {{'name': 'analysis_width', 'value': '270'}}, {{'name': 'analysis_height', 'value': '480'}}, {{'name': 'radius_requested', 'value': '''auto'''}}, {{'name': 'profile_path', 'value': ''''''}}, {{'name': 'profile_hash', 'value': '''' || {_HASH} || ''''}}, {{'name': 'min_quality', 'value': '0.18'}}]) AS u FROM sq),
idt AS MATERIALIZED (SELECT seq_id, u.name AS name, u.value AS value FROM idn)"""


@query(f", {_IDENTITY} SELECT seq_id, name, value FROM idt")
def cache_identity(spark, sf_dir):
    return identity.build(_info(spark, sf_dir))


@query(f", {_IDENTITY} SELECT seq_id, sha256(string_agg(name || '=' || value, chr(10) ORDER BY name)) AS digest FROM idt GROUP BY seq_id")
def identity_digest(spark, sf_dir):
    return identity.digest(identity.build(_info(spark, sf_dir)))


@query(f", {_IDENTITY} SELECT seq_id, name, value FROM idt WHERE NOT (name = 'clip_version' AND seq_id % 4 = 1)")
def identity_round_trip(spark, sf_dir):
    packed = identity.pack(identity.build(_info(spark, sf_dir)))
    return identity.unpack(packed.withColumn("id_clip_version", F.when(F.col("seq_id") % 4 != 1, F.col("id_clip_version"))))


_LACKING = sorted(identity.REQUIRED)


@query(
    f""", {_IDENTITY}, sto AS (SELECT seq_id, name, CASE WHEN name = 'contrast_version' AND seq_id % 4 = 1 THEN '4' WHEN name = 'width' AND seq_id % 4 = 2 THEN '640' ELSE value END AS value FROM idt WHERE NOT (name = 'min_quality' AND seq_id % 8 = 3) AND seq_id % 11 <> 5
 UNION ALL SELECT seq_id, 'more', '1' FROM sq WHERE seq_id % 11 <> 5),
cmp AS (SELECT idt.seq_id, idt.name, CASE WHEN sto.value IS NULL THEN 'falta el campo de identidad ''' || idt.name || '''' WHEN sto.value <> idt.value THEN '''' || idt.name || ''' difiere: caché=' || sto.value || ', esperado=' || idt.value END AS reason
 FROM idt LEFT JOIN sto USING (seq_id, name) WHERE idt.seq_id % 11 <> 5),
wr AS (SELECT seq_id, list(reason ORDER BY reason) FILTER (WHERE reason IS NOT NULL) AS wrong, coalesce(bool_and(name = 'contrast_version') FILTER (WHERE reason IS NOT NULL), false) AS soft FROM cmp GROUP BY seq_id
 UNION ALL SELECT seq_id, ['{identity.LEGACY}'], false FROM sq WHERE seq_id % 11 = 5),
br AS (SELECT seq_id, CASE WHEN seq_id % 5 = 0 THEN 'caché incompleta; faltan arrays: ' || CASE WHEN seq_id % 2 = 0 THEN '{_LACKING[0]}' ELSE '{", ".join(_LACKING[:6])}...' END END AS broken, seq_id % 7 <> 3 AS there FROM sq),
al AS (SELECT seq_id, there, coalesce(wrong, []) AS wrong, soft, broken FROM br JOIN wr USING (seq_id))
SELECT seq_id, CASE WHEN NOT there THEN 'missing' WHEN len(wrong) = 0 AND broken IS NULL THEN 'valid' WHEN broken IS NULL AND soft THEN 'refreshable' ELSE 'incompatible' END AS state,
 CASE WHEN there THEN array_to_string(list_filter(list_append(wrong, broken), lambda r: r IS NOT NULL), '; ') ELSE '' END AS reasons FROM al"""
)
def cache_check(spark, sf_dir):
    expected = identity.build(_info(spark, sf_dir))
    i, name = F.col("seq_id"), F.col("name")
    value = F.when((name == "contrast_version") & (i % 4 == 1), "4").when((name == "width") & (i % 4 == 2), "640").otherwise(F.col("value"))
    stored = expected.filter(~((name == "min_quality") & (i % 8 == 3)) & (i % 11 != 5)).select("seq_id", "name", value.alias("value"))
    seqs = expected.select("seq_id").distinct()
    stored = stored.unionByName(seqs.filter("seq_id % 11 <> 5").select("seq_id", F.lit("more").alias("name"), F.lit("1").alias("value")))
    every = F.array(*map(F.lit, identity.REQUIRED))
    few = F.when(i % 2 == 0, F.array(F.lit(_LACKING[0]))).otherwise(F.array(*map(F.lit, _LACKING[:7])))
    keys = seqs.filter("seq_id % 7 <> 3").select("seq_id", F.when(i % 5 == 0, F.array_except(every, few)).otherwise(every).alias("keys"))
    return identity.cache_status(expected, stored, keys)


@query("SELECT seq_id, frame_idx, round(exposed, 6) AS exposed, k + 1 AS k, evaluable AS seen FROM f")
def overwritten_columns(spark, sf_dir):
    f = load_frames(spark, sf_dir)
    old, new = f.select("seq_id", "frame_idx", F.round("exposed", 6).alias("exposed"), "k"), f.select("seq_id", "frame_idx", (F.col("k") + 1).alias("k"), F.col("evaluable").alias("seen"))
    return identity.overwrite(old, new, ["seq_id", "frame_idx"])


@query(
    f""", {D.DECIDED}, st1 AS (SELECT *, x - center_x AS sx, y - center_y AS sy FROM de),
tr2 AS (SELECT *, CASE WHEN anchor_used AND lag(anchor_used) OVER {D.W} THEN {D.hyp(f'sx - lag(sx) OVER {D.W}', f'sy - lag(sy) OVER {D.W}')} END AS step, CASE WHEN anchor_used THEN {D.hyp('sx', 'sy')} END AS away,
 frame_idx - row_number() OVER (PARTITION BY seq_id, keep ORDER BY frame_idx) AS g FROM st1),
ra AS (SELECT seq_id, min(frame_idx) AS a, max(frame_idx) AS b, row_number() OVER (PARTITION BY seq_id ORDER BY min(frame_idx)) AS rn FROM tr2 WHERE NOT keep GROUP BY seq_id, g),
rt AS (SELECT seq_id, count(*) AS n_ranges, string_agg(CASE WHEN rn <= 12 THEN CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END END, ', ' ORDER BY a) || CASE WHEN count(*) > 12 THEN ' ...' ELSE '' END AS ranges FROM ra GROUP BY seq_id)
SELECT seq_id, count(*) AS frames, count(*) FILTER (WHERE anchor_used) AS trusted, count(*) FILTER (WHERE rejected) AS rejected, count(*) FILTER (WHERE jitter_candidate) AS jitter, count(*) FILTER (WHERE excursion_candidate) AS excursion,
 count(*) FILTER (WHERE corrupt) AS corruption, count(*) FILTER (WHERE repaired) AS adjusted, max(frame_idx) AS last_frame, coalesce(any_value(horizon_start), count(*)) AS horizon_start, count(*) FILTER (WHERE regime = 0) AS limbo,
 count(*) FILTER (WHERE regime = 1) AS transient, count(*) FILTER (WHERE regime = 2) AS horizon, count(*) FILTER (WHERE false_circle) AS false_circles, count(*) FILTER (WHERE content = 0) AS usable, count(*) FILTER (WHERE clipped) AS clipped,
 count(*) FILTER (WHERE content = 2) AS uncertain, count(*) FILTER (WHERE centering = 0) AS reliable, count(*) FILTER (WHERE centering = 1) AS reconstructed, count(*) FILTER (WHERE centering = 2) AS unresolved, count(*) FILTER (WHERE keep) AS written,
 count(*) FILTER (WHERE NOT keep) AS discarded, count(*) FILTER (WHERE margin < -0.75) AS cut, count(*) FILTER (WHERE discarded) AS by_profile, coalesce(any_value(n_ranges), 0) AS n_ranges, coalesce(any_value(ranges), '') AS ranges,
 round(quantile_cont(away, 0.5), 5) AS residual_median, round(quantile_cont(away, 0.95), 5) AS residual_p95, round(max(away), 5) AS residual_maximum, round(quantile_cont(step, 0.95), 5) AS step_p95, round(max(step), 5) AS step_maximum
FROM tr2 LEFT JOIN rt USING (seq_id) GROUP BY seq_id"""
)
def analysis_report(spark, sf_dir):
    d = summary.analysis_report(decisions_of(spark, sf_dir))
    return d.withColumns({c: policy.rounded(F.col(c), 5) for c in ("residual_median", "residual_p95", "residual_maximum", "step_p95", "step_maximum")})


@query(
    f""", {D.SELECTED} SELECT seq_id, frame_idx, printf('src %d  t=%.2fs', frame_idx, frame_idx / 30.0::double) AS line_1,
 'content=' || CASE content WHEN 0 THEN 'usable' WHEN 1 THEN 'clipped' ELSE 'uncertain' END || '  ' || substr(content_reason, 1, 60) AS line_2,
 'centering=' || CASE centering WHEN 0 THEN 'reliable' WHEN 1 THEN 'reconstructed' ELSE 'unresolved' END || ' ' || substr(centering_reason, 1, 32) || '  regime=' || CASE regime WHEN 0 THEN 'limbo' WHEN 1 THEN 'respaldo_transitorio' ELSE 'horizonte_confirmado' END
  || CASE WHEN false_circle THEN '  FALSO-CIRCULO' ELSE '' END AS line_3,
 'avisos=' || CASE WHEN NOT (jitter_candidate OR excursion_candidate OR corrupt OR tear OR repaired) THEN 'sin avisos' ELSE concat_ws(',', CASE WHEN jitter_candidate THEN 'jitter' END, CASE WHEN excursion_candidate THEN 'excursion' END, CASE WHEN corrupt THEN 'corrupcion' END,
  CASE WHEN tear THEN 'tear-sensor' END, CASE WHEN repaired THEN 'auto-reparado' END) END AS line_7,
 'decision=' || CASE origin WHEN 'profile' THEN 'perfil' WHEN 'auto' THEN 'automatico' ELSE origin END || ' ' || substr(selection_reason, 1, 55) AS line_8 FROM se"""
)
def overlay_lines(spark, sf_dir):
    return summary.overlay(_selected(decisions_of(spark, sf_dir)), 30.0).select("seq_id", "frame_idx", "line_1", "line_2", "line_3", "line_7", "line_8")


@query("SELECT seq_id, frame_idx, printf('frame %d', frame_idx) AS line_1, printf('q=%.3f arc=%.0f deg', quality, k * 4.0::double) AS line_2, CASE WHEN k / 20.0::double <= 4.2 AND k >= 35 THEN 'modelo=limbo circular' ELSE 'modelo=no circular/insuficiente' END AS line_4 FROM f")
def detection_lines(spark, sf_dir):
    k = F.col("k")
    f = load_frames(spark, sf_dir).withColumn("coverage", k * 4.0).withColumn("residual", k / 20.0).withColumn("points", k).withColumn("threshold", k * 0.5).withColumn("touch", k > 97)
    return summary.detection_lines(f).select("seq_id", "frame_idx", "line_1", "line_2", "line_4")


#: Every second sequence has twice the frame rate and the analysis width, and a smaller radius.
_RATES = ((30.0, 270, 80.0), (60.0, 540, 70.0))


def _by_rate_sql() -> str:
    parts = []
    for i, (fps, width, radius) in enumerate(_RATES):
        made = D.chain(fps, width / 270, radius, width, 360)
        base = FRAMES.replace("FROM base)", f"FROM base WHERE seq_id % 2 = {i})")
        parts.append(f"SELECT * FROM (WITH RECURSIVE {base}, {made.DECIDED} SELECT seq_id, frame_idx, regime, trusted, backup, content, centering, round(center_x, 6) AS center_x, round(margin, 6) AS margin, margin < {-0.75 * width / 270} AS cut, tear, run_length2 AS run_length, corrupt, keep FROM de)")
    return "FROM (" + " UNION ALL ".join(parts) + ")"


def two_rates(spark, sf_dir) -> DataFrame:
    odd = F.col("seq_id") % 2 == 1
    seqs = load_frames(spark, sf_dir).select("seq_id").distinct()
    return seqs.select("seq_id", *[F.when(odd, b).otherwise(a).alias(n) for n, a, b in zip(("fps", "width", "radius"), *_RATES, strict=True)], F.lit(360).alias("height"))


@query(_by_rate_sql())
def decisions_by_sequence(spark, sf_dir):
    """The decisions with two frame rates, scales and radii in one table."""

    def each(frames, p, size):
        return decide.decide(contrasted(spark, sf_dir, frames, p, size), p, size)

    marked = policy.discard_ranges(measured(spark, sf_dir), ranges_of(spark, sf_dir))
    out = decide.by_sequence(marked, two_rates(spark, sf_dir), each)
    return out.select("seq_id", "frame_idx", "regime", "trusted", "backup", "content", "centering", *r6("center_x", "margin"), "cut", "tear", "run_length", "corrupt", "keep")


@query("SELECT seq_id, frame_idx, CASE WHEN seq_id % 2 = 1 THEN 2 ELSE 1 END * 4.5::double AS most_residual, CASE WHEN seq_id % 2 = 1 THEN 70 ELSE 80 END * 0.6::double AS gate, CASE WHEN seq_id % 2 = 1 THEN frame_idx / 60.0::double ELSE frame_idx / 30.0::double END AS seconds FROM f")
def sequence_scalars(spark, sf_dir):
    f = with_scalars(load_frames(spark, sf_dir), two_rates(spark, sf_dir))
    return f.select("seq_id", "frame_idx", (F.col("scale") * 4.5).alias("most_residual"), (F.col("radius") * 0.6).alias("gate"), (F.col("frame_idx") / F.col("fps")).alias("seconds"))
