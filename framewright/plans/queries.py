"""Queries of the frame operators on the driver's events, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import parse
from ..operators import path as robust
from ..operators import policy, regime, seqops, summary, track
from ..params import CENTERING_REASONS, CENTERING_STATES, CONTENT_REASONS, CONTENT_STATES, SELECTION_REASONS, Params
from ..sources import sinks
from ..sources.frames import incomplete, load_frames, sparse, systematic
from . import decide, solve
from . import decision_sql as D

P = Params()
QUERIES: dict = {}
SQL: dict[str, str] = {}

#: The frame view that the SQL starts from.
FRAMES = """base AS (SELECT user_id AS seq_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx,
 CAST(props->>'$.k' AS BIGINT) AS k, event_type, value FROM events),
f AS (SELECT seq_id, frame_idx, k, event_type <> 'error' AS evaluable,
 0.9::double + 0.0001::double * k - CASE WHEN value > 200 THEN 0.3::double ELSE 0 END AS exposed,
 CASE WHEN event_type <> 'error' THEN 120::double + 0.2::double * frame_idx + 0.01::double * (k - 50) + CASE WHEN value > 200 THEN 12::double ELSE 0 END END AS raw_x,
 CASE WHEN event_type <> 'error' THEN 180::double + 0.1::double * frame_idx - 0.01::double * (k - 50) END AS raw_y,
 CASE WHEN frame_idx > 0 THEN 0.2::double ELSE 0 END AS rel_x, CASE WHEN frame_idx > 0 THEN 0.1::double ELSE 0 END AS rel_y,
 0.3::double + 0.005::double * k AS response, 0.05::double + 0.009::double * k AS quality,
 CASE WHEN event_type = 'error' AND k < 10 THEN 4 ELSE 200 END AS maximum, event_type = 'view' AND k < 20 AS anchor FROM base)"""
W = "(PARTITION BY seq_id ORDER BY frame_idx)"


def rows(low: str, high: str) -> str:
    return f"(PARTITION BY seq_id ORDER BY frame_idx ROWS BETWEEN {low} AND {high})"


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) as a query, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH RECURSIVE {FRAMES} {sql}" if sql.lstrip().startswith((",", "SELECT")) else sql
        return f

    return add


def r6(*columns: str) -> list:
    return [F.round(c, 6).alias(c) for c in columns]


def off_tie(*columns: str) -> list:
    """Six digits of values that may end in a five: both sides add the same, so that neither is a tie."""
    return [policy.rounded(F.col(c) + F.lit(1e-9), 6).alias(c) for c in columns]


@query("SELECT seq_id, frame_idx, k, evaluable, round(exposed, 6) AS exposed, round(raw_x, 6) AS raw_x, round(raw_y, 6) AS raw_y, round(response, 6) AS response, anchor FROM f")
def frame_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_frames(spark, sf_dir).select("seq_id", "frame_idx", "k", "evaluable", *r6("exposed", "raw_x", "raw_y", "response"), "anchor")


@query("SELECT seq_id, frame_idx, k FROM f WHERE frame_idx IN (0, 7, 20)")
def sparse_frames(spark, sf_dir):
    return sparse(load_frames(spark, sf_dir), [0, 7, 20]).select("seq_id", "frame_idx", "k")


@query(f", n AS (SELECT seq_id, count(*) AS n FROM f GROUP BY seq_id) SELECT DISTINCT n.seq_id, CAST(floor(i * (n - 1) / 15) AS BIGINT) AS frame_idx FROM n, range(16) AS t(i)")
def systematic_sample(spark, sf_dir):
    return systematic(load_frames(spark, sf_dir), 16).select("seq_id", "frame_idx")


@query(f"SELECT seq_id, frame_idx, round(raw_x - lag(raw_x) OVER {W}, 6) AS dx, round(coalesce(sqrt(power(raw_x - lag(raw_x) OVER {W} - rel_x, 2) + power(raw_y - lag(raw_y) OVER {W} - rel_y, 2)), 0), 6) AS innovation FROM f")
def step_innovation(spark, sf_dir):
    f = load_frames(spark, sf_dir).withColumn("dx", seqops.difference(F.col("raw_x"))).withColumn("innovation", seqops.innovation("raw_x", "raw_y", "rel_x", "rel_y"))
    return f.select("seq_id", "frame_idx", *r6("dx", "innovation"))


def _hyp(a: str, b: str) -> str:
    return f"sqrt(power({a}, 2) + power({b}, 2))"


@query(
    f""", s AS (SELECT *, lag(raw_x) OVER {W} AS px, lag(raw_y) OVER {W} AS py, lead(raw_x) OVER {W} AS nx, lead(raw_y) OVER {W} AS ny,
 lead(rel_x) OVER {W} AS nrx, lead(rel_y) OVER {W} AS nry, lag(evaluable) OVER {W} AS pe, lead(evaluable) OVER {W} AS ne FROM f)
SELECT seq_id, frame_idx FROM s WHERE evaluable AND pe AND ne AND {_hyp("raw_x - px - rel_x", "raw_y - py - rel_y")} > 4
 AND {_hyp("nx - raw_x - nrx", "ny - raw_y - nry")} > 4 AND {_hyp("nx - px - rel_x - nrx", "ny - py - rel_y - nry")} < 4"""
)
def transient_outliers(spark, sf_dir):
    return load_frames(spark, sf_dir).withColumn("odd", seqops.transient_outlier(F.col("evaluable"), 4 * P.scale)).filter("odd").select("seq_id", "frame_idx")


@query(f"""SELECT seq_id, frame_idx, round(sum(rel_x) OVER {rows("UNBOUNDED PRECEDING", "CURRENT ROW")}, 6) AS motion_x FROM f""")
def cumulative_motion(spark, sf_dir):
    return load_frames(spark, sf_dir).select("seq_id", "frame_idx", F.round(seqops.cumulative(F.col("rel_x")), 6).alias("motion_x"))


_CLOSE = rows("60 PRECEDING", "60 FOLLOWING")


@query(
    f""", o AS (SELECT seq_id, frame_idx, raw_x - sum(rel_x) OVER {rows("UNBOUNDED PRECEDING", "CURRENT ROW")} AS off FROM f)
SELECT seq_id, frame_idx, CASE WHEN count(off) OVER {_CLOSE} >= 5 THEN round(quantile_cont(off, 0.5) OVER {_CLOSE}, 6) END AS baseline FROM o"""
)
def closure_baseline(spark, sf_dir):
    f = load_frames(spark, sf_dir).withColumn("off", F.col("raw_x") - seqops.cumulative(F.col("rel_x")))
    return f.select("seq_id", "frame_idx", F.round(seqops.frame_median(F.col("off"), -60, 60, 5), 6).alias("baseline"))


@query(
    f""", d AS (SELECT seq_id, frame_idx, coalesce(abs(raw_x - lag(raw_x) OVER {W} - rel_x), 0) AS c FROM f),
l AS (SELECT seq_id, frame_idx, list_filter(coalesce(list(CASE WHEN c > 0 THEN c END) OVER {rows("60 PRECEDING", "1 PRECEDING")}, []), lambda x: x IS NOT NULL) AS l FROM d),
m AS (SELECT *, list_aggregate(l, 'median') AS m FROM l),
s AS (SELECT *, list_aggregate(list_transform(l, lambda x: abs(x - m)), 'median') AS s FROM m)
SELECT seq_id, frame_idx, round(CASE WHEN len(l) < 5 THEN 2.0::double ELSE least(3.0::double, greatest(2.0::double, m + 3 * 1.4826::double * s)) END, 6) AS gate FROM s"""
)
def adaptive_gate(spark, sf_dir):
    f = load_frames(spark, sf_dir).withColumn("c", F.coalesce(F.abs(seqops.difference(F.col("raw_x")) - F.col("rel_x")), F.lit(0.0)))
    return f.select("seq_id", "frame_idx", F.round(seqops.adaptive_gate(F.col("c"), P.scale), 6).alias("gate"))


@query(
    f""", g AS (SELECT *, value_bad AS bad, CASE WHEN NOT value_bad THEN raw_x END AS good FROM (SELECT *, evaluable AND exposed < 0.7 AS value_bad FROM f)),
n AS (SELECT *, last_value(good IGNORE NULLS) OVER {rows("5 PRECEDING", "CURRENT ROW")} AS x0, first_value(good IGNORE NULLS) OVER {rows("CURRENT ROW", "5 FOLLOWING")} AS x1,
 last_value(CASE WHEN good IS NOT NULL THEN frame_idx END IGNORE NULLS) OVER {rows("5 PRECEDING", "CURRENT ROW")} AS i0, first_value(CASE WHEN good IS NOT NULL THEN frame_idx END IGNORE NULLS) OVER {rows("CURRENT ROW", "5 FOLLOWING")} AS i1 FROM g)
SELECT seq_id, frame_idx, round(CASE WHEN bad AND x0 IS NOT NULL AND x1 IS NOT NULL THEN x0 + (x1 - x0) * (frame_idx - i0) / (i1 - i0) ELSE raw_x END, 6) AS x FROM n"""
)
def spike_repair(spark, sf_dir):
    bad = F.col("evaluable") & (F.col("exposed") < 0.7)
    return load_frames(spark, sf_dir).select("seq_id", "frame_idx", F.round(seqops.repair("raw_x", bad, P.spike_reach), 6).alias("x"))


@query(
    f"""SELECT seq_id, frame_idx, max(CASE WHEN anchor THEN frame_idx END) OVER {rows("UNBOUNDED PRECEDING", "CURRENT ROW")} AS prev_anchor,
 min(CASE WHEN anchor THEN frame_idx END) OVER {rows("CURRENT ROW", "UNBOUNDED FOLLOWING")} AS next_anchor FROM f"""
)
def anchor_neighbours(spark, sf_dir):
    at = F.when(F.col("anchor"), F.col("frame_idx"))
    return load_frames(spark, sf_dir).select("seq_id", "frame_idx", seqops.previous(at).alias("prev_anchor"), seqops.following(at).alias("next_anchor"))


@query(
    f""", i AS (SELECT seq_id, frame_idx, frame_idx - row_number() OVER (PARTITION BY seq_id ORDER BY frame_idx) AS g FROM f WHERE evaluable)
SELECT seq_id, min(frame_idx) AS start, max(frame_idx) + 1 AS stop, count(*) AS length FROM i GROUP BY seq_id, g"""
)
def visible_runs(spark, sf_dir):
    return seqops.runs(load_frames(spark, sf_dir), "evaluable")


_DROPS = f""", l AS (SELECT *, list_filter(coalesce(list(CASE WHEN evaluable THEN exposed END) OVER {rows("15 PRECEDING", "1 PRECEDING")}, []), lambda x: x IS NOT NULL) AS past,
 list_filter(coalesce(list(CASE WHEN evaluable THEN exposed END) OVER {rows("1 FOLLOWING", "15 FOLLOWING")}, []), lambda x: x IS NOT NULL) AS future FROM f),
m AS (SELECT *, list_concat(past, future) AS both_, list_aggregate(list_concat(past, future), 'median') AS mid, CASE WHEN evaluable AND len(past) >= 3 AND len(future) >= 3 THEN least(list_aggregate(past, 'median'), list_aggregate(future, 'median')) END AS baseline FROM l),
c AS (SELECT *, coalesce(baseline - exposed >= greatest(0.08::double, 6 * 1.4826::double * list_aggregate(list_transform(both_, lambda x: abs(x - mid)), 'median')), false) AS candidate FROM m)"""
_TEARS = f"""{_DROPS}, r AS (SELECT *, candidate AND evaluable AS hit, frame_idx - row_number() OVER (PARTITION BY seq_id, candidate AND evaluable ORDER BY frame_idx) AS g FROM c),
t AS (SELECT *, CASE WHEN hit THEN count(*) OVER (PARTITION BY seq_id, hit, g) ELSE 0 END AS run_length, hit AND count(*) OVER (PARTITION BY seq_id, hit, g) / 30.0 <= 0.067 + 1e-9 AS tear FROM r)"""


def tears(spark, sf_dir) -> DataFrame:
    return seqops.isolated_tears(seqops.exposure_drops(load_frames(spark, sf_dir), P.fps, P.tear_drop, P.tear_noise), P.fps, P.tear_seconds)


@query(f"{_DROPS} SELECT seq_id, frame_idx, round(baseline, 6) AS baseline, candidate FROM c WHERE evaluable")
def exposure_drops(spark, sf_dir):
    f = seqops.exposure_drops(load_frames(spark, sf_dir), P.fps, P.tear_drop, P.tear_noise).filter("evaluable")
    return f.select("seq_id", "frame_idx", *r6("baseline"), "candidate")


@query(f"{_TEARS} SELECT seq_id, frame_idx, tear, run_length FROM t")
def isolated_tears(spark, sf_dir):
    return tears(spark, sf_dir).select("seq_id", "frame_idx", "tear", "run_length")


_NEAR = """((next_anchor - prev_anchor <= 150) OR (prev_anchor IS NOT NULL AND frame_idx - prev_anchor <= 30) OR (next_anchor IS NOT NULL AND next_anchor - frame_idx <= 30))"""
_CENTER = f""", a AS (SELECT *, max(CASE WHEN anchor THEN frame_idx END) OVER {rows("UNBOUNDED PRECEDING", "CURRENT ROW")} AS prev_anchor,
 min(CASE WHEN anchor THEN frame_idx END) OVER {rows("CURRENT ROW", "UNBOUNDED FOLLOWING")} AS next_anchor FROM SOURCE),
ce AS (SELECT *, CASE WHEN anchor THEN 0 WHEN coalesce({_NEAR}, false) THEN 1 ELSE 2 END AS centering, CASE WHEN anchor THEN '{CENTERING_REASONS["anchor"]}'
 WHEN coalesce({_NEAR}, false) THEN printf('{CENTERING_REASONS["neighbours"]}', coalesce(prev_anchor, -1), coalesce(next_anchor, count(*) OVER (PARTITION BY seq_id))) ELSE '{CENTERING_REASONS["none"]}' END AS centering_reason FROM a)"""


@query(_CENTER.replace("SOURCE", "f").replace("150", "50").replace("<= 30", "<= 10") + " SELECT seq_id, frame_idx, centering, centering_reason FROM ce")
def centering_states(spark, sf_dir):
    return seqops.centering(load_frames(spark, sf_dir), 10.0).select("seq_id", "frame_idx", "centering", "centering_reason")


_DECIDED = _TEARS + _CENTER.replace("SOURCE", "t") + ", d AS (SELECT *, CASE WHEN tear THEN 1 WHEN maximum >= 8 AND quality >= 0.1 THEN 0 ELSE 2 END AS content, NOT tear AND centering <> 2 AS keep FROM ce)"


def decided(spark, sf_dir) -> DataFrame:
    """Frames with tear, content, centering and keep."""
    f = seqops.centering(tears(spark, sf_dir), P.fps)
    f = f.withColumn("content", policy.content(F.col("tear"), F.col("maximum") >= P.dark_level, F.col("quality") >= 0.1))
    return f.withColumn("keep", policy.kept(F.col("content"), F.col("centering")))


_COUNTS = """SELECT seq_id, count(*) AS frames, count(*) FILTER (WHERE content = 0) AS usable, count(*) FILTER (WHERE content = 1) AS clipped, count(*) FILTER (WHERE content = 2) AS uncertain,
 count(*) FILTER (WHERE centering = 0) AS reliable, count(*) FILTER (WHERE centering = 1) AS reconstructed, count(*) FILTER (WHERE centering = 2) AS unresolved,
 count(*) FILTER (WHERE keep) AS written, count(*) FILTER (WHERE NOT keep) AS discarded FROM d GROUP BY seq_id"""


@query(f"{_DECIDED} {_COUNTS}")
def state_summary(spark, sf_dir):
    return summary.state_counts(decided(spark, sf_dir))


_NAMES = "CASE content WHEN 0 THEN 'usable' WHEN 1 THEN 'clipped' ELSE 'uncertain' END AS content_name, CASE centering WHEN 0 THEN 'reliable' WHEN 1 THEN 'reconstructed' ELSE 'unresolved' END AS centering_name"


@query(
    f"""{_DECIDED} SELECT seq_id, frame_idx, {_NAMES}, CASE content WHEN 1 THEN CASE WHEN k % 2 = 0 THEN printf('{CONTENT_REASONS["tear"]}', round((baseline - exposed) * 100, 1))
 ELSE printf('{CONTENT_REASONS["border"]}', CASE k % 16 WHEN 0 THEN 'borde' ELSE concat_ws(', ', CASE WHEN k % 2 >= 1 THEN 'left' END, CASE WHEN k % 4 >= 2 THEN 'right' END, CASE WHEN k % 8 >= 4 THEN 'top' END, CASE WHEN k % 16 >= 8 THEN 'bottom' END) END, CAST(round_even(k / 100.0::double * 100, 0) AS INT)) END
 WHEN 0 THEN '{CONTENT_REASONS["usable"]}' ELSE CASE WHEN maximum >= 8 AND quality >= 0.1 THEN '{CONTENT_REASONS["unclear"]}' ELSE concat_ws('; ', CASE WHEN maximum < 8 THEN printf('{CONTENT_REASONS["dark"]}', maximum) END, CASE WHEN quality < 0.1 THEN printf('{CONTENT_REASONS["weak"]}', k) END) END END AS reason, centering_reason, keep FROM d"""
)
def decision_table(spark, sf_dir):
    d = decided(spark, sf_dir)
    k, tear = F.col("k"), F.col("k") % 2 == 0
    reason = policy.content_reason(F.col("content"), F.col("maximum") >= P.dark_level, F.col("quality") >= 0.1, tear, F.col("drop"), k % 16, k / 100.0, F.col("maximum"), k)
    return d.select("seq_id", "frame_idx", policy.names(F.col("content"), CONTENT_STATES).alias("content_name"), policy.names(F.col("centering"), CENTERING_STATES).alias("centering_name"), reason.alias("reason"), "centering_reason", "keep")


@query(
    f""", e AS (SELECT *, evaluable AND k >= 30 AS ev FROM f), i AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY seq_id, ev ORDER BY frame_idx) AS g FROM e),
n AS (SELECT *, count(*) OVER (PARTITION BY seq_id, ev, g) AS len_, min(frame_idx) OVER (PARTITION BY seq_id, ev, g) AS first_ FROM i)
SELECT seq_id, frame_idx, ev AND (first_ = 0 OR len_ >= 5) AS limbo FROM n"""
)
def limbo_hysteresis(spark, sf_dir):
    f = load_frames(spark, sf_dir).withColumn("ev", F.col("evaluable") & (F.col("k") >= 30))
    return seqops.hysteresis(f, "ev", P.recover_run).select("seq_id", "frame_idx", "limbo")


@query(""", h AS (SELECT seq_id, min(frame_idx) AS h FROM f WHERE k >= 95 GROUP BY seq_id) SELECT f.seq_id, frame_idx, coalesce(frame_idx >= h, false) AS horizon FROM f LEFT JOIN h USING (seq_id)""")
def horizon_latch(spark, sf_dir):
    return load_frames(spark, sf_dir).select("seq_id", "frame_idx", seqops.latch(F.col("k") >= 95).alias("horizon"))


_TREND = ", q AS (SELECT seq_id, frame_idx, quality, quality - lag(quality) OVER (PARTITION BY seq_id ORDER BY frame_idx) AS d FROM f WHERE evaluable) SELECT seq_id, CASE WHEN count(*) >= 3 THEN round(count(*) FILTER (WHERE d <= 0.05) * 1.0 / count(d), 6) ELSE 0 END AS falling FROM q GROUP BY seq_id"


@query(_TREND)
def quality_trend(spark, sf_dir):
    f = load_frames(spark, sf_dir).filter("evaluable").groupBy("seq_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "quality"))), lambda s: s["quality"]).alias("q"))
    return f.select("seq_id", F.round(seqops.trend_fraction(F.col("q"), False, 0.05), 6).alias("falling"))


@query("SELECT seq_id, CAST(floor(frame_idx / 15) AS BIGINT) AS window, count(raw_x) AS known, round(quantile_cont(raw_x, 0.5), 6) AS middle FROM f GROUP BY 1, 2 HAVING count(raw_x) >= 5")
def tumbling_medians(spark, sf_dir):
    return seqops.tumbling(load_frames(spark, sf_dir), "raw_x", 15, 5).withColumn("middle", F.round("middle", 6))


@query(
    """, m AS (SELECT seq_id, quantile_cont(exposed, 0.5) AS median, quantile_cont(exposed, 0.95) AS p95, max(exposed) AS top FROM f GROUP BY seq_id),
s AS (SELECT f.seq_id, 1.4826::double * quantile_cont(abs(exposed - median), 0.5) AS mad FROM f JOIN m USING (seq_id) GROUP BY f.seq_id)
SELECT seq_id, round(median, 6) AS median, round(p95, 6) AS p95, round(top, 6) AS top, round(mad, 6) AS mad FROM m JOIN s USING (seq_id)"""
)
def exposure_spread(spark, sf_dir):
    return summary.spread(load_frames(spark, sf_dir), "exposed").select("seq_id", *r6("median", "p95", "top", "mad"))


@query("SELECT seq_id, round(quantile_cont(raw_x, 0.5), 6) AS x, round(quantile_cont(raw_y, 0.5), 6) AS y FROM f GROUP BY seq_id")
def robust_center(spark, sf_dir):
    return summary.robust_center(load_frames(spark, sf_dir)).select("seq_id", *r6("x", "y"))


_JITTER = f"""{_DECIDED}, o AS (SELECT *, row_number() OVER {W} - 1 AS output_frame FROM d WHERE keep),
v AS (SELECT seq_id, output_frame, frame_idx AS source_frame, raw_x - (120 + 0.2::double * frame_idx) AS dx, raw_y - (180 + 0.1::double * frame_idx) AS dy FROM o WHERE raw_x IS NOT NULL),
rs AS (SELECT *, {_hyp("dx", "dy")} AS residual, CASE WHEN output_frame - lag(output_frame) OVER (PARTITION BY seq_id ORDER BY output_frame) = 1
 THEN {_hyp("dx - lag(dx) OVER (PARTITION BY seq_id ORDER BY output_frame)", "dy - lag(dy) OVER (PARTITION BY seq_id ORDER BY output_frame)")} END AS step FROM v),
j AS (SELECT seq_id, count(*) AS validated, round(quantile_cont(residual, 0.5), 6) AS median, round(quantile_cont(residual, 0.95), 6) AS p95, round(max(residual), 6) AS maximum,
 round(quantile_cont(step, 0.95), 6) AS jitter_p95, round(max(step), 6) AS jitter_maximum, count(*) FILTER (WHERE step > 1) AS jitter_over_1px FROM rs GROUP BY seq_id)"""


def _residuals(spark, sf_dir) -> DataFrame:
    i = F.col("frame_idx")
    return summary.residuals(decided(spark, sf_dir), ("raw_x", "raw_y"), (F.lit(120.0) + F.lit(0.2) * i, F.lit(180.0) + F.lit(0.1) * i))


def _metrics(spark, sf_dir) -> DataFrame:
    return summary.jitter(_residuals(spark, sf_dir)).select("seq_id", "validated", *r6("median", "p95", "maximum", "jitter_p95", "jitter_maximum"), "jitter_over_1px")


@query(f"{_JITTER} SELECT * FROM j")
def residual_jitter(spark, sf_dir):
    return _metrics(spark, sf_dir)


@query("SELECT seq_id, frame_idx, k FROM f WHERE k IS NOT NULL ORDER BY k DESC, seq_id, frame_idx LIMIT 10")
def worst_frames(spark, sf_dir):
    return summary.worst(load_frames(spark, sf_dir), "k")


@query(
    f""", s AS (SELECT seq_id, abs(CAST(k AS DOUBLE) - lag(k) OVER {W}) AS d FROM f), p AS (SELECT seq_id, CASE WHEN d > 0 THEN d END AS d FROM s),
m AS (SELECT seq_id, quantile_cont(d, 0.5) AS m FROM p GROUP BY seq_id), t AS (SELECT p.seq_id, m, quantile_cont(abs(d - m), 0.5) AS s FROM p JOIN m USING (seq_id) GROUP BY p.seq_id, m)
SELECT seq_id, round(coalesce(greatest(20, m + 6 * s), 20), 6) AS gate FROM t"""
)
def intensity_gate(spark, sf_dir):
    f = load_frames(spark, sf_dir).withColumn("k", F.col("k").cast("double"))
    return summary.intensity_gate(f, "k").select("seq_id", *r6("gate"))


@query(", o AS (SELECT seq_id, frame_idx + unnest([-2, -1, 1, 2]) AS frame_idx FROM f WHERE anchor) SELECT DISTINCT o.seq_id, o.frame_idx FROM o JOIN f USING (seq_id, frame_idx)")
def anchor_neighbourhood(spark, sf_dir):
    return summary.neighbourhood(load_frames(spark, sf_dir), "anchor")


@query(f"{_DECIDED} SELECT seq_id, frame_idx, row_number() OVER {W} - 1 AS position FROM d WHERE keep")
def output_positions(spark, sf_dir):
    return summary.output_positions(decided(spark, sf_dir))


@query(f"SELECT seq_id, frame_idx, CAST(frame_idx // 4 AS BIGINT) AS sheet_row, CAST(frame_idx % 4 AS BIGINT) AS sheet_column FROM f")
def contact_sheet(spark, sf_dir):
    return summary.grid(load_frames(spark, sf_dir)).select("seq_id", "frame_idx", F.col("sheet_row").cast("bigint").alias("sheet_row"), F.col("sheet_column").cast("bigint").alias("sheet_column"))


_PRIORITY = f"""{_DECIDED}, x AS (SELECT *, CASE WHEN tear THEN 0 WHEN content = 2 THEN 1 WHEN k % 10 = 3 THEN 2 END AS p, count(*) OVER (PARTITION BY seq_id) AS n FROM d),
nb AS (SELECT seq_id, frame_idx + unnest([-2, -1, 1, 2]) AS frame_idx FROM x WHERE p IS NOT NULL),
pr AS (SELECT x.seq_id, x.frame_idx, content, n, coalesce(p, CASE WHEN nb.seq_id IS NOT NULL THEN 3 END) AS priority FROM x LEFT JOIN (SELECT DISTINCT * FROM nb) AS nb USING (seq_id, frame_idx)),
rk AS (SELECT *, priority IS NOT NULL AND row_number() OVER (PARTITION BY seq_id ORDER BY priority NULLS LAST, frame_idx) <= 58 AS taken FROM pr),
rm AS (SELECT *, 58 - count(*) FILTER (WHERE taken) OVER (PARTITION BY seq_id) AS room FROM rk),
po AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY frame_idx) - 1 AS nth, count(*) OVER (PARTITION BY seq_id) AS m FROM rm WHERE n > 58 AND content = 0 AND NOT taken),
pk AS (SELECT DISTINCT seq_id, CAST(CASE WHEN least(room, m) = 1 THEN 0 ELSE floor(i * (m - 1) / (least(room, m) - 1)) END AS BIGINT) AS nth FROM (SELECT DISTINCT seq_id, room, m FROM po), range(58) AS t(i) WHERE i < least(room, m))
SELECT seq_id, frame_idx, coalesce(priority, 4) AS priority FROM rm WHERE n <= 58 UNION ALL SELECT seq_id, frame_idx, priority FROM rm WHERE n > 58 AND taken
UNION ALL SELECT seq_id, frame_idx, 4 FROM po JOIN pk USING (seq_id, nth)"""


@query(_PRIORITY)
def priority_sample(spark, sf_dir):
    d = decided(spark, sf_dir).withColumn("clipped", F.col("tear")).withColumn("problem", F.col("k") % 10 == 3)
    return summary.priority_sample(d, 58)


def ranges_of(spark, sf_dir) -> DataFrame:
    """Discard ranges: one of every sequence, frame 30 of every second one, and one past the end."""
    seqs = load_frames(spark, sf_dir).select("seq_id").distinct()
    i = F.col("seq_id")
    spans = F.array(F.struct((i % 20).alias("start"), (i % 20 + i % 5).alias("end")), F.when(i % 2 == 0, F.struct(F.lit(30).cast("bigint").alias("start"), F.lit(30).cast("bigint").alias("end"))), F.struct(F.lit(5000).cast("bigint").alias("start"), F.lit(6000).cast("bigint").alias("end")))
    return seqs.select("seq_id", F.inline(F.array_compact(spans)))


@query(f"SELECT seq_id, frame_idx, {D.RANGES} AS discarded FROM f")
def discarded_ranges(spark, sf_dir):
    return policy.discard_ranges(load_frames(spark, sf_dir), ranges_of(spark, sf_dir)).select("seq_id", "frame_idx", "discarded")


@query(
    f""", r AS (SELECT seq_id, seq_id % 20 AS start, seq_id % 20 + seq_id % 5 AS stop, count(*) AS n FROM f GROUP BY seq_id UNION ALL SELECT seq_id, 30, 30, count(*) FROM f WHERE seq_id % 2 = 0 GROUP BY seq_id)
SELECT seq_id, start, CASE WHEN start = least(stop, n - 1) THEN printf('frame descartado por perfil: src %d', start) ELSE printf('rango descartado por perfil: src %d-%d', start, least(stop, n - 1)) END AS message FROM r WHERE start < n"""
)
def discard_messages(spark, sf_dir):
    lengths = load_frames(spark, sf_dir).groupBy("seq_id").agg(F.count(F.lit(1)).alias("frames"))
    return policy.discard_messages(ranges_of(spark, sf_dir), lengths)


def manual_of(d: DataFrame) -> DataFrame:
    """Manual actions: some clipped and centred frames are kept, every eleventh other frame is dropped."""
    keep = (F.col("content") == 1) & (F.col("centering") != 2) & ~F.col("discarded") & (F.col("frame_idx") % 2 == 0)
    drop = ~keep & ((F.col("seq_id") + F.col("frame_idx")) % 11 == 0)
    return d.select("seq_id", "frame_idx", F.when(keep, "keep").when(drop, "drop").alias("action")).filter("action is not null")


def _selected(d: DataFrame) -> DataFrame:
    return policy.selection(d, manual_of(d))


_SELECT = f"""{_DECIDED}, g AS (SELECT *, keep AS auto_keep, {D.RANGES} AS discarded FROM d),
b AS (SELECT *, content = 1 AND centering <> 2 AND NOT discarded AND frame_idx % 2 = 0 AS back, (seq_id + frame_idx) % 11 = 0 AS out_ FROM g),
s AS (SELECT seq_id, frame_idx, CASE WHEN back THEN true WHEN out_ THEN false ELSE auto_keep AND NOT discarded END AS mask,
 CASE WHEN out_ OR back THEN 'manual' WHEN discarded THEN 'profile' ELSE 'auto' END AS origin,
 CASE WHEN back THEN '{SELECTION_REASONS["keep"]}' WHEN out_ THEN '{SELECTION_REASONS["drop"]}' WHEN discarded THEN '{SELECTION_REASONS["profile"]}' ELSE '' END AS selection_reason FROM b)"""


def _selection(spark, sf_dir) -> DataFrame:
    return _selected(policy.discard_ranges(decided(spark, sf_dir).withColumnRenamed("keep", "auto_keep"), ranges_of(spark, sf_dir)))


@query(f"{_SELECT} SELECT * FROM s")
def effective_selection(spark, sf_dir):
    return _selection(spark, sf_dir).select("seq_id", "frame_idx", "mask", "origin", "selection_reason")


@query(f"{_SELECT} SELECT seq_id, count(*) FILTER (WHERE origin = 'manual' AND NOT mask) AS dropped, count(*) FILTER (WHERE origin = 'manual' AND mask) AS recovered FROM s GROUP BY seq_id")
def manual_selection(spark, sf_dir):
    return policy.manual_counts(_selection(spark, sf_dir))


@query("SELECT seq_id, frame_idx, round(CASE WHEN response >= 0.55 THEN rel_x ELSE 0 END, 6) AS x, round(least(1, greatest(0, k * 4 / 150.0::double)) * exp(-(k / 40.0::double) / 0.96::double) * (0.7::double + 0.3::double * least(1, k / 100.0::double)), 6) AS q FROM f")
def quality_and_gate(spark, sf_dir):
    f = load_frames(spark, sf_dir)
    step = policy.gated_step(F.col("rel_x"), F.col("rel_y"), F.col("response") - F.lit(0.43), P.scale)
    k = F.col("k").cast("double")
    return f.select("seq_id", "frame_idx", F.round(step["x"], 6).alias("x"), F.round(policy.radial_quality(k * 4, k / 40, k, F.lit(80.0)), 6).alias("q"))


@query("SELECT seq_id, frame_idx, CAST(k % 16 AS INTEGER) AS bits, concat_ws(',', CASE WHEN k % 2 >= 1 THEN 'left' END, CASE WHEN k % 4 >= 2 THEN 'right' END, CASE WHEN k % 8 >= 4 THEN 'top' END, CASE WHEN k % 16 >= 8 THEN 'bottom' END) AS edges FROM f")
def edge_bits(spark, sf_dir):
    bits = (F.col("k") % 16).cast("int")
    f = load_frames(spark, sf_dir).withColumn("edges", policy.bits_to_edges(bits))
    return f.select("seq_id", "frame_idx", policy.edges_to_bits(F.col("edges")).cast("int").alias("bits"), F.concat_ws(",", "edges").alias("edges"))


@query(
    """, e AS (SELECT *, evaluable AND k * 4 >= 150 AND k / 20.0 <= 4.5 AND k >= 35 AND quality >= 0.01 AS evidence,
 CAST(quality < 0.12 AS INT) + CAST(NOT (k / 20.0 <= 4.5) AS INT) + CAST(NOT (k * 4 >= 150) AS INT) + CAST(NOT (k >= 35) AS INT) + CAST(k > 97 OR maximum < 8 AS INT) AS signals FROM f)
SELECT seq_id, frame_idx, evidence AND NOT k > 97 AS evidence, signals FROM e"""
)
def loss_signals(spark, sf_dir):
    k = F.col("k")
    f = load_frames(spark, sf_dir).withColumn("source", F.lit(1)).withColumn("touch", k > 97).withColumn("clip_edges", F.lit(0)).withColumn("coverage", k * 4.0).withColumn("residual", k / 20.0).withColumn("points", k)
    return f.select("seq_id", "frame_idx", policy.evidence(P).alias("evidence"), policy.loss_signals(P).alias("signals"))


def weighted(spark, sf_dir) -> DataFrame:
    return load_frames(spark, sf_dir).withColumn("weight", F.lit(6.0)).withColumn("stiffness", F.lit(0.03) + F.lit(0.5) * F.col("response"))


@query(
    f"""RECURSIVE_{FRAMES},
n AS (SELECT seq_id, frame_idx, CASE WHEN raw_x IS NULL THEN 0 ELSE 6::double END AS a, coalesce(raw_x, 0) AS m, rel_x AS r,
 CASE WHEN frame_idx = 0 THEN 0 ELSE 0.03::double + 0.5::double * response END AS w FROM f),
b AS (SELECT seq_id, frame_idx, -w AS lo, a + w + coalesce(lead(w) OVER {W}, 0) + 1e-9::double AS di, -coalesce(lead(w) OVER {W}, 0) AS up,
 a * m + w * r - coalesce(lead(w) OVER {W} * lead(r) OVER {W}, 0) AS rhs FROM n),
fw(seq_id, frame_idx, c, d) AS (SELECT seq_id, frame_idx, up / di, rhs / di FROM b WHERE frame_idx = 0 UNION ALL
 SELECT b.seq_id, b.frame_idx, b.up / (b.di - b.lo * fw.c), (b.rhs - b.lo * fw.d) / (b.di - b.lo * fw.c) FROM fw JOIN b ON b.seq_id = fw.seq_id AND b.frame_idx = fw.frame_idx + 1),
t AS (SELECT seq_id, max(frame_idx) AS last FROM b GROUP BY seq_id),
bw(seq_id, frame_idx, x) AS (SELECT fw.seq_id, fw.frame_idx, fw.d FROM fw JOIN t ON fw.seq_id = t.seq_id AND fw.frame_idx = t.last UNION ALL
 SELECT fw.seq_id, fw.frame_idx, fw.d - fw.c * bw.x FROM bw JOIN fw ON fw.seq_id = bw.seq_id AND fw.frame_idx = bw.frame_idx - 1)
SELECT seq_id, frame_idx, round(x, 6) AS path_x FROM bw""".replace("RECURSIVE_", "WITH RECURSIVE ")
)
def weighted_path(spark, sf_dir):
    return solve.weighted_path(weighted(spark, sf_dir)).select("seq_id", "frame_idx", F.round("path_x", 6).alias("path_x"))


#: Fields of probe documents by the sequence's number: as text, and what the text is worth.
_PROBED = {
    "width": (8, ["720", "1280", '"640"', "270", "0", '"N/A"', '"x1"', "null"], ["720", "1280", "640", "270", "NULL", "NULL", "NULL", "NULL"]),
    "nb_frames": (7, ['"N/A"', '"300"', '"0"', '"abc"', "null", '"-5"', "2400"], ["NULL", "300", "-1", "-1", "NULL", "-1", "2400"]),
    "avg_frame_rate": (5, ['"30/1"', '"0/0"', '"30"', '"24000/1001"', '"N/A"'], ["30", "NULL", "NULL", "24000 / 1001.0::double", "NULL"]),
    "r_frame_rate": (4, ['"25/1"', '"0/0"', "null", '"50/2"'], ["25", "NULL", "NULL", "25"]),
    "duration": (3, ['"8.0"', "null", '"x"'], ["8", "NULL", "NULL"]),
    "whole": (11, ['"10.0"', '"N/A"', "null", '"-1"', '"12.5"', '"nan"', '"inf"', '"1e1"', '""', '"10.0"', "7.25"], ["10", "NULL", "NULL", "NULL", "12.5", "NULL", "NULL", "10", "NULL", "10", "7.25"]),
}


def _worth(name: str) -> str:
    n, _, values = _PROBED[name]
    return f"CASE seq_id % {n} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + f" END AS {name}"


@query(
    f""", pr AS (SELECT DISTINCT seq_id, {", ".join(map(_worth, _PROBED))}, seq_id % 13 AS odd FROM f),
pe AS (SELECT seq_id, odd, width, CASE WHEN nb_frames > 0 THEN nb_frames END AS counted, coalesce(nb_frames = -1, false) AS bad, CAST(coalesce(avg_frame_rate, r_frame_rate) AS DOUBLE) AS listed, CAST(coalesce(whole, duration) AS DOUBLE) AS timed FROM pr),
pf AS (SELECT *, coalesce(listed, counted / timed) AS fps, coalesce(timed, counted / listed) AS duration FROM pe),
pg AS (SELECT *, CASE WHEN odd = 0 THEN 'json' WHEN odd = 1 THEN 'stream' WHEN width IS NULL THEN 'width' WHEN bad THEN 'frames' WHEN fps IS NULL THEN 'fps' WHEN duration IS NULL THEN 'duration' END AS error FROM pf)
SELECT seq_id, CASE WHEN error IS NULL THEN CAST(width AS BIGINT) END AS width, CASE WHEN error IS NULL THEN round(fps, 6) END AS fps, CASE WHEN error IS NULL THEN round(duration, 6) END AS duration,
 CASE WHEN error IS NULL THEN coalesce(counted, CAST(round_even(duration * fps, 0) AS BIGINT)) END AS frames, CASE WHEN error IS NULL THEN counted IS NULL END AS estimated, error FROM pg"""
)
def probe_metadata(spark, sf_dir):
    i = F.col("seq_id")

    def text(name):
        n, texts, _ = _PROBED[name]
        return F.element_at(F.array(*map(F.lit, texts)), (i % n + 1).cast("int"))

    fields = [F.concat(F.lit(f'"{name}":'), text(name)) for name in _PROBED if name != "whole"]
    stream = F.concat(F.lit('{"height":1280,'), F.concat_ws(",", *fields), F.lit("}"))
    raw = F.concat(F.lit('{"streams":['), F.when(i % 13 == 1, "").otherwise(stream), F.lit('],"format":{"duration":'), text("whole"), F.lit("}"), F.when(i % 13 == 0, "").otherwise("}"))
    p = load_frames(spark, sf_dir).select("seq_id").distinct().select("seq_id", parse.probe(raw).alias("p"))
    return p.select("seq_id", "p.width", F.round("p.fps", 6).alias("fps"), F.round("p.duration", 6).alias("duration"), "p.frames", "p.estimated", "p.error")


@query(
    """, s AS (SELECT DISTINCT seq_id, seq_id % 4 AS v FROM f) SELECT seq_id, CASE WHEN v = 2 OR seq_id = 0 THEN 3 WHEN v = 0 THEN 0 WHEN v = 1 THEN seq_id END AS irregular, CASE WHEN v = 2 OR seq_id = 0 THEN 10 WHEN v = 0 THEN seq_id WHEN v = 1 THEN 2 * seq_id + 9 END AS transitions,
 CASE WHEN v = 2 OR seq_id = 0 THEN 11 ELSE CASE v WHEN 0 THEN seq_id + 1 WHEN 1 THEN 2 * seq_id + 10 END END AS frames FROM s"""
)
def rate_log(spark, sf_dir):
    """Numbers with exponents, infinite and missing ones, no transitions, no measurement at all."""
    i = F.col("seq_id").cast("string")
    texts = [
        F.concat(F.lit("VFR:0.3 (3/7)\nVFR:0.000000 (0/"), i, F.lit(")")),
        F.concat(F.lit("x VFR:0.1 (1/9) y\nVFR:1e-05 ("), i, F.lit("/"), (F.col("seq_id") + 9).cast("string"), F.lit(") min: 1 max: 2\nVFR:0.0 (0/0)")),
        F.lit("VFR:0.3 (3/7)\nVFR:inf (9/9)\nVFR:nan (8/8)\nVFR:--1 (7/7)"),
        F.lit("no measurement VFR: 0.1 (1/2)"),
    ]
    raw = load_frames(spark, sf_dir).select("seq_id").distinct().withColumn("raw", F.element_at(F.array(*texts), (F.col("seq_id") % 4 + 1).cast("int")))
    return raw.select("seq_id", parse.rate_log(F.col("raw")).alias("p")).select("seq_id", "p.irregular", "p.transitions", "p.frames")


@query("SELECT unnest([20, 21, 22, 23, 24, 700, 900]) AS frame_idx")
def frame_list(spark, sf_dir):
    return parse.frame_list(spark.createDataFrame([("20-24,700, 900,20",), ("",), (None,)], "s string"), "s", 2400).select("frame_idx")


@query("SELECT * FROM (VALUES (120, 124), (900, 900)) t(start, \"end\")")
def profile_discards(spark, sf_dir):
    raw = '{"version": 1, "name": "x", "discards": [{"start": 120, "end": 124, "reason": "bump"}, {"frame": 900}]}'
    return parse.discards(spark.createDataFrame([(raw,)], "raw string"), "raw")


@query("SELECT seq_id, CAST(round_even(1280 * 270.0::double / (700 + seq_id % 50), 0) AS BIGINT) + CAST(round_even(1280 * 270.0::double / (700 + seq_id % 50), 0) AS BIGINT) % 2 AS height FROM f GROUP BY seq_id")
def scaled_height(spark, sf_dir):
    return load_frames(spark, sf_dir).select("seq_id").distinct().select("seq_id", parse.scaled_height(F.lit(700) + F.col("seq_id") % 50, F.lit(1280), 270).alias("height"))


@query(
    """, s AS (SELECT DISTINCT seq_id, CASE seq_id % 4 WHEN 0 THEN '/in/My.Clip ' || seq_id || '.mp4' WHEN 1 THEN '/a b/ñandú__x' || seq_id || '.tar.gz' WHEN 2 THEN '/' || seq_id || '/-.mov' ELSE '/v/Raw_' || seq_id END AS path FROM f)
SELECT seq_id, CASE seq_id % 4 WHEN 0 THEN 'My.Clip_' || seq_id WHEN 1 THEN 'and___x' || seq_id || '.tar' WHEN 2 THEN 'video' ELSE 'Raw_' || seq_id END || '_' || substr(sha256(path), 1, 8) || '_output' AS name FROM s"""
)
def output_names(spark, sf_dir):
    i, t = F.col("seq_id"), F.col("seq_id").cast("string")
    paths = [F.concat(F.lit("/in/My.Clip "), t, F.lit(".mp4")), F.concat(F.lit("/a b/ñandú__x"), t, F.lit(".tar.gz")), F.concat(F.lit("/"), t, F.lit("/-.mov")), F.concat(F.lit("/v/Raw_"), t)]
    path = F.element_at(F.array(*paths), (i % 4 + 1).cast("int"))
    return load_frames(spark, sf_dir).select("seq_id").distinct().select("seq_id", parse.output_name(path).alias("name"))


#: Anchors with a limb, their offsets from summed motion, and a narrow gate that the view's jitter passes.
_ANCHORS = f""", o AS (SELECT *, evaluable AS known, evaluable AND k >= 50 AS limb, 0.1::double AS gate,
 raw_x - sum(rel_x) OVER {rows("UNBOUNDED PRECEDING", "CURRENT ROW")} AS off_x, raw_y - sum(rel_y) OVER {rows("UNBOUNDED PRECEDING", "CURRENT ROW")} AS off_y,
 coalesce(CASE WHEN evaluable AND lag(evaluable) OVER {W} THEN {_hyp(f"raw_x - lag(raw_x) OVER {W} - rel_x", f"raw_y - lag(raw_y) OVER {W} - rel_y")} END, 0) AS local FROM f),
l AS (SELECT *, CASE WHEN limb AND known THEN frame_idx END AS ai, CASE WHEN limb AND known THEN off_x END AS ax, CASE WHEN limb AND known THEN off_y END AS ay FROM o),
n AS (SELECT *, last_value(ai IGNORE NULLS) OVER {rows("UNBOUNDED PRECEDING", "CURRENT ROW")} AS i0, first_value(ai IGNORE NULLS) OVER {rows("CURRENT ROW", "UNBOUNDED FOLLOWING")} AS i1,
 last_value(ax IGNORE NULLS) OVER {rows("UNBOUNDED PRECEDING", "CURRENT ROW")} AS x0, first_value(ax IGNORE NULLS) OVER {rows("CURRENT ROW", "UNBOUNDED FOLLOWING")} AS x1,
 last_value(ay IGNORE NULLS) OVER {rows("UNBOUNDED PRECEDING", "CURRENT ROW")} AS y0, first_value(ay IGNORE NULLS) OVER {rows("CURRENT ROW", "UNBOUNDED FOLLOWING")} AS y1 FROM l),
c AS (SELECT *, coalesce(CASE WHEN known AND i1 - i0 > 1 AND i1 - i0 <= 150 THEN {_hyp("off_x - (x0 + (x1 - x0) * (frame_idx - i0) / (i1 - i0))", "off_y - (y0 + (y1 - y0) * (frame_idx - i0) / (i1 - i0))")} END, 0) AS closure FROM n)"""


def anchors(spark, sf_dir) -> DataFrame:
    x, y = (F.col(c) for c in ("raw_x", "raw_y"))
    f = load_frames(spark, sf_dir).withColumn("known", F.col("evaluable")).withColumn("limb", F.col("evaluable") & (F.col("k") >= 50)).withColumn("gate", F.lit(0.1))
    f = f.withColumn("off_x", x - seqops.cumulative(F.col("rel_x"))).withColumn("off_y", y - seqops.cumulative(F.col("rel_y")))
    return f.withColumn("local", seqops.innovation("raw_x", "raw_y", "rel_x", "rel_y")).withColumn("closure", robust.gap_closure())


@query(f"{_ANCHORS} SELECT seq_id, frame_idx, round(closure, 6) AS closure FROM c")
def gap_closure(spark, sf_dir):
    return anchors(spark, sf_dir).select("seq_id", "frame_idx", *r6("closure"))


@query(
    f"""{_ANCHORS}, s AS (SELECT *, lag(known) OVER {W} AND known AND lead(known) OVER {W} AND (NOT limb OR (lag(limb) OVER {W} AND lead(limb) OVER {W})) AS fit, lead(local) OVER {W} AS after,
 {_hyp(f"lead(raw_x) OVER {W} - lag(raw_x) OVER {W} - rel_x - lead(rel_x) OVER {W}", f"lead(raw_y) OVER {W} - lag(raw_y) OVER {W} - rel_y - lead(rel_y) OVER {W}")} AS apart FROM c)
SELECT seq_id, frame_idx FROM s WHERE fit AND local > gate AND after > gate AND apart <= 2 * gate"""
)
def transient_spikes(spark, sf_dir):
    return anchors(spark, sf_dir).withColumn("spike", robust.transient_spike()).filter("spike").select("seq_id", "frame_idx")


@query(
    f"""{_ANCHORS}, s AS (SELECT *, known AND closure > 0.2::double AS seed FROM c), g AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY seq_id, seed ORDER BY frame_idx) AS g FROM s),
r AS (SELECT seq_id, min(frame_idx) AS start, max(frame_idx) AS last FROM g WHERE seed GROUP BY seq_id, g HAVING count(*) >= 3),
b AS (SELECT r.seq_id, start, last, max(f1.frame_idx) AS b FROM r JOIN o f1 ON f1.seq_id = r.seq_id AND f1.known AND f1.frame_idx BETWEEN start - 4 AND start - 1 GROUP BY ALL),
a AS (SELECT r.seq_id, start, min(f2.frame_idx) AS a FROM r JOIN o f2 ON f2.seq_id = r.seq_id AND f2.known AND f2.frame_idx BETWEEN last + 1 AND last + 4 GROUP BY ALL),
k AS (SELECT b.seq_id, start, last FROM b JOIN a USING (seq_id, start) JOIN o p ON p.seq_id = b.seq_id AND p.frame_idx = b JOIN o q ON q.seq_id = b.seq_id AND q.frame_idx = a WHERE {_hyp("p.off_x - q.off_x", "p.off_y - q.off_y")} <= 0.2::double),
e AS (SELECT seq_id, min(frame_idx) AS lo, max(frame_idx) AS hi FROM o WHERE limb GROUP BY seq_id)
SELECT DISTINCT o.seq_id, o.frame_idx FROM o JOIN k ON k.seq_id = o.seq_id AND o.frame_idx BETWEEN start - 4 AND last + 4 LEFT JOIN e ON e.seq_id = o.seq_id
 WHERE known AND (NOT limb OR quality < 0.15) AND coalesce(o.frame_idx NOT IN (lo, hi), true)"""
)
def accumulated_excursions(spark, sf_dir):
    return robust.excursions(anchors(spark, sf_dir), 4).filter("excursion").select("seq_id", "frame_idx")


def measured(spark, sf_dir) -> DataFrame:
    """Frames with the columns that evidence and signs of loss are read from."""
    k = F.col("k")
    return load_frames(spark, sf_dir).withColumn("source", F.lit(1)).withColumn("touch", k > 97).withColumn("clip_edges", F.lit(0)).withColumn("coverage", k * 4.0).withColumn("residual", k / 20.0).withColumn("points", k)


_TRACK = """, v AS (SELECT *, coalesce(raw_x IS NOT NULL AND k <= 97 AND k * 4 >= 150 AND k / 20.0 <= 4.5 AND k >= 35 AND quality >= 0.01, false) AS ev FROM f),
t(seq_id, frame_idx, tx, ty, lx, ly, near) AS (SELECT seq_id, frame_idx, CASE WHEN ev THEN raw_x END, CASE WHEN ev THEN raw_y END, CASE WHEN ev THEN raw_x END, CASE WHEN ev THEN raw_y END, ev FROM v WHERE frame_idx = 0
 UNION ALL SELECT seq_id, frame_idx, CASE WHEN near THEN raw_x ELSE px END, CASE WHEN near THEN raw_y ELSE py END, CASE WHEN ev THEN raw_x ELSE lx END, CASE WHEN ev THEN raw_y ELSE ly END, near
 FROM (SELECT *, ev AND (lx IS NULL OR coalesce(sqrt(power(raw_x - px, 2) + power(raw_y - py, 2)) <= 1.5, false) OR coalesce(sqrt(power(raw_x - lx, 2) + power(raw_y - ly, 2)) <= 1.5, false)) AS near
 FROM (SELECT v.*, t.lx, t.ly, t.tx + v.rel_x AS px, t.ty + v.rel_y AS py FROM t JOIN v ON v.seq_id = t.seq_id AND v.frame_idx = t.frame_idx + 1)))"""


@query(f"RECURSIVE_{FRAMES}{_TRACK} SELECT seq_id, frame_idx, near AS coherent FROM t".replace("RECURSIVE_", "WITH RECURSIVE "))
def coherent_evidence(spark, sf_dir):
    return regime.coherent(regime.loss(measured(spark, sf_dir), P), "evidence", 1.5, P.scale).select("seq_id", "frame_idx", "coherent")


@query(f", {D.REGIMES} SELECT seq_id, frame_idx, regime, horizon_start, contrast_start, false_circle, led_by, core, signs, regime_reason FROM re")
def regimes(spark, sf_dir):
    """Short spans, as the sequences of the events are short."""
    return regime.classify(measured(spark, sf_dir), P, regime.Horizon(2, 2, 9), 1.5).select("seq_id", "frame_idx", "regime", "horizon_start", "contrast_start", "false_circle", "led_by", "core", "signs", "regime_reason")


_R6 = ", ".join(f"round({c}, 6) AS {c}" for c in ("path_x", "path_y", "center_x", "center_y", "correction"))


@query(f""", an AS (SELECT *, raw_x AS x, raw_y AS y, evaluable AND k >= 50 AS limb, evaluable AS contrast, quality AS score FROM f), {D.path("an")}
SELECT seq_id, frame_idx, {_R6}, spike, excursion, jump, jitter_candidate, excursion_candidate, repaired, reason FROM rp""")
def robust_path(spark, sf_dir):
    f = load_frames(spark, sf_dir).withColumn("limb", F.col("evaluable") & (F.col("k") >= 50)).withColumn("contrast", F.col("evaluable")).withColumn("score", F.col("quality"))
    return robust.robust_path(f, P.scale).select("seq_id", "frame_idx", *r6("path_x", "path_y", "center_x", "center_y", "correction"), "spike", "excursion", "jump", "jitter_candidate", "excursion_candidate", "repaired", "reason")


SIZE = (270.0, 360.0)


def detected(spark, sf_dir) -> DataFrame:
    """Frames with an edge measurement and a contour: jumps move the edge by more than the contour."""
    k, jump = F.col("k"), F.col("exposed") < 0.7
    f = load_frames(spark, sf_dir).withColumn("radial_x", F.col("raw_x")).withColumn("radial_y", F.col("raw_y")).withColumn("points", k)
    f = f.withColumn("coverage", k * 4.0).withColumn("residual", k / 20.0).withColumn("touch", k > 85)
    return f.withColumn("contour_x", F.col("raw_x") - F.when(jump, 12.0).otherwise(0.0)).withColumn("contour_y", F.col("raw_y"))


_DETECTED = """, v AS (SELECT *, raw_x IS NOT NULL AND k >= 35 AND k * 4 >= 120 AND k / 20.0 <= 4.5 AS sound, k > 85 AS touch, raw_x - CASE WHEN exposed < 0.7 THEN 12::double ELSE 0 END AS contour_x FROM f),
t AS (SELECT seq_id, CAST(-1 AS BIGINT) AS frame_idx, NULL::double AS tx, NULL::double AS ty, NULL::double AS lx, NULL::double AS ly, 0 AS src FROM f GROUP BY seq_id
 UNION ALL SELECT seq_id, frame_idx, tx, ty, CASE src WHEN 0 THEN lx WHEN 3 THEN contour_x ELSE raw_x END, CASE src WHEN 0 THEN ly ELSE raw_y END, src
 FROM (SELECT *, CASE WHEN sound AND sqrt(power(raw_x - tx, 2) + power(raw_y - ty, 2)) <= 10 THEN CASE WHEN abs(contour_x - raw_x) > 4 THEN 2 ELSE 1 END
   WHEN sound AND NOT touch AND CASE WHEN lx IS NULL THEN sqrt(power(contour_x - tx, 2) + power(raw_y - ty, 2)) <= 6 ELSE sqrt(power(contour_x - lx - rel_x, 2) + power(raw_y - ly - rel_y, 2)) <= 10 END THEN 3 ELSE 0 END AS src
  FROM (SELECT v.*, t.lx, t.ly, CASE WHEN t.lx IS NULL THEN coalesce(v.contour_x, 135) ELSE t.lx + v.rel_x END AS tx, CASE WHEN t.lx IS NULL THEN coalesce(v.raw_y, 180) ELSE t.ly + v.rel_y END AS ty
   FROM t JOIN v ON v.seq_id = t.seq_id AND v.frame_idx = t.frame_idx + 1)))"""


@query(
    f"RECURSIVE_{FRAMES}{_DETECTED} SELECT seq_id, frame_idx, round(tx, 6) AS told_x, round(ty, 6) AS told_y, round(CASE WHEN src > 0 THEN lx END, 6) AS place_x, round(CASE WHEN src > 0 THEN ly END, 6) AS place_y, CAST(src AS INTEGER) AS place_source FROM t WHERE frame_idx >= 0".replace("RECURSIVE_", "WITH RECURSIVE ")
)
def geometry_track(spark, sf_dir):
    return track.geometry_track(detected(spark, sf_dir), P, SIZE).select("seq_id", "frame_idx", *r6("told_x", "told_y", "place_x", "place_y"), "place_source")


def contrasted(spark, sf_dir, marked: DataFrame | None = None, p: Params = P, size: tuple = SIZE) -> DataFrame:
    """Frames with their regime, trusted geometry and the contrast track anchored to it."""
    f = (measured(spark, sf_dir) if marked is None else marked).withColumn("spot_x", 100 + F.col("frame_idx") * 0.2).withColumn("spot_y", 170 + F.col("frame_idx") * 0.1).withColumn("spot_score", F.col("quality") / 2)
    f = decide.trusted_geometry(regime.classify(f, p, regime.Horizon(2, 2, 9), 1.5), p.scale).withColumn("place_x", F.col("raw_x")).withColumn("place_y", F.col("raw_y"))
    return track.contrast_track(f, p, size)


@query(f", {D.TRUSTED} SELECT seq_id, frame_idx, trusted, rejected FROM tg")
def trusted_geometry(spark, sf_dir):
    f = decide.trusted_geometry(regime.classify(measured(spark, sf_dir), P, regime.Horizon(2, 2, 9), 1.5), P.scale)
    return f.select("seq_id", "frame_idx", "trusted", "rejected")


_TRACKED = ("contrast_x", "contrast_y", "contrast_score", "offset_x", "offset_y", "sample_x", "sample_y", "fallback_innovation")


@query(f", {D.CONTRAST} SELECT seq_id, frame_idx, {', '.join(f'round({c} + 1e-9::double, 6) AS {c}' for c in _TRACKED)}, reanchored, supported, fallback_mode FROM co")
def contrast_track(spark, sf_dir):
    return contrasted(spark, sf_dir).select("seq_id", "frame_idx", *off_tie(*_TRACKED), "reanchored", "supported", "fallback_mode")


def decisions_of(spark, sf_dir) -> DataFrame:
    marked = policy.discard_ranges(measured(spark, sf_dir), ranges_of(spark, sf_dir))
    return decide.decide(contrasted(spark, sf_dir, marked), P, SIZE)


_DECISIONS = (
    "regime", "trusted", "backup", "anchor_used", "horizon_visible", "horizon_present", "tear_verdict", "content", "content_reason", "centering", "centering_reason", "corrupt", "corruption_signals",
    "cut", "contradicted", "discarded", "keep",
)


@query(f", {D.DECIDED} SELECT seq_id, frame_idx, {', '.join(c for c in _DECISIONS if c != 'cut')}, margin < -0.75 AS cut, round(center_x + 1e-9::double, 6) AS center_x, round(center_y + 1e-9::double, 6) AS center_y, round(margin + 1e-9::double, 6) AS margin FROM de")
def decisions(spark, sf_dir):
    return decisions_of(spark, sf_dir).select("seq_id", "frame_idx", *_DECISIONS, *off_tie("center_x", "center_y", "margin"))


#: The files' columns in the SQL of the decisions; columns that the frames lack have the files' defaults.
_FILE_SQL = {
    "frame": "frame_idx", "raw_cx": "raw_x", "raw_cy": "raw_y", "solved_cx": "center_x", "solved_cy": "center_y", "final_cx": "center_x", "final_cy": "center_y", "pre_repair_cx": "path_x", "pre_repair_cy": "path_y",
    "raw_solved_cx": "path_x", "raw_solved_cy": "path_y", "repaired_cx": "center_x", "repaired_cy": "center_y", "correction_magnitude": "correction", "absolute_innovation": "off_path", "local_innovation": "local_",
    "cumulative_innovation": "closure", "jitter_candidate": "jitter_candidate", "excursion_candidate": "excursion_candidate", "jump_confirmed": "jump", "corruption_candidate": "corrupt", "corruption_signal_count": "corruption_signals",
    "auto_repaired": "repaired", "repair_reason": "reason", "quality": "quality", "coverage_deg": "coverage", "median_residual": "residual", "touch": "touch", "trusted": "anchor_used", "rejected": "rejected", "phase_dx": "rel_x",
    "phase_dy": "rel_y", "phase_response": "response", "radial_points": "points", "strong_loss": "strong", "signal_count": "signals", "margin": "margin", "cut_geometry": "margin < -0.75", "keep": "keep", "horizon_tracked": "backup",
    "regime": "CASE regime WHEN 0 THEN 'limbo' WHEN 1 THEN 'respaldo_transitorio' ELSE 'horizonte_confirmado' END", "regime_reason": "regime_reason", "false_circle_after_horizon": "false_circle", "contrast_cx": "contrast_x",
    "contrast_cy": "contrast_y", "contrast_score": "contrast_score", "timed_discarded": "discarded", "clipped": "clipped", "border_clipped": "clip_edges <> 0", "tear_candidate": "candidate", "tear_evaluable": "evaluable",
    "tear_detected": "tear", "tear_run_length": "run_length2", "tear_veto_reason": "tear_verdict", "tear_exposed_fraction": "exposed", "tear_baseline_fraction": "baseline", "tear_drop_fraction": "drop_", "tear_temporal_noise": "noise",
    "content_state": "CASE content WHEN 0 THEN 'usable' WHEN 1 THEN 'clipped' ELSE 'uncertain' END", "content_reason": "content_reason", "centering_state": "CASE centering WHEN 0 THEN 'reliable' WHEN 1 THEN 'reconstructed' ELSE 'unresolved' END",
    "centering_reason": "centering_reason", "contradicted_reconstruction": "contradicted", "geometry_source": "'radial'", "contrast_dyn_offset_cx": "offset_x", "contrast_dyn_offset_cy": "offset_y", "contrast_offset_sample_cx": "sample_x",
    "contrast_offset_sample_cy": "sample_y", "fallback_reanchored": "reanchored", "fallback_supported": "supported", "fallback_innovation": "fallback_innovation", "fallback_mode": "fallback_mode", "anchor_weight": "weight",
    "robust_anchor_weight": "mended_weight", "rel_weight": "stiffness", "robust_rel_weight": "mended_stiffness", "keep_auto": "keep", "keep_effective": "mask", "decision": "origin", "decision_reason": "selection_reason",
}


def _file_sql(names: list[str]) -> str:
    out = []
    for n in names:
        text = n in sinks.NAMED or n.endswith("reason") or n == "decision"
        made = _FILE_SQL.get(n)
        if made is None:
            made = "''" if text else "0" if n in sinks.FLAGS else "0.0::double" if n in sinks.ZERO else "NULL::double"
        elif n in sinks.FLAGS:
            made = f"CAST({made} AS INTEGER)"
        elif not text and n != "frame":
            made = f"round(CAST({f'coalesce({made}, 0)' if n in sinks.ZERO else made} AS DOUBLE) + 1e-9::double, 6)"
        out.append(f"{made} AS {n}")
    return "SELECT seq_id, " + ", ".join(out)


def _rounded(table: DataFrame) -> DataFrame:
    return table.select(*[off_tie(f.name)[0] if f.dataType.typeName() == "double" else F.col(f.name) for f in table.schema])


@query(f", {D.SELECTED} {_file_sql(sinks.DEBUG)} FROM se")
def debug_csv(spark, sf_dir):
    return _rounded(sinks.debug_table(_selected(decisions_of(spark, sf_dir))))


@query(f", {D.DECIDED} {_file_sql(sinks.TRACKING)} FROM de")
def tracking_csv(spark, sf_dir):
    return _rounded(sinks.tracking_table(decisions_of(spark, sf_dir)))


@query(
    """, n AS (SELECT seq_id, count(*) AS n FROM f GROUP BY seq_id), i AS (SELECT DISTINCT n.seq_id, CAST(floor(i * (n - 1) / 15) AS BIGINT) AS i FROM n, range(16) AS t(i))
SELECT i.seq_id, f.frame_idx AS frame, round(raw_x, 6) AS cx, round(raw_y, 6) AS cy, round(quality, 6) AS quality, k * 4.0::double AS coverage_deg, k / 20.0::double AS median_residual, 0.5::double * k AS threshold, CAST(k > 97 AS INTEGER) AS touch
FROM i JOIN f ON f.seq_id = i.seq_id AND f.frame_idx = i.i"""
)
def detections_csv(spark, sf_dir):
    f = systematic(measured(spark, sf_dir), 16).withColumn("threshold", F.lit(0.5) * F.col("k"))
    return sinks.detection_table(f.withColumns({c: F.round(c, 6) for c in ("raw_x", "raw_y", "quality")}))


@query(
    f"""{_JITTER}, w AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY residual DESC, output_frame) AS rank FROM rs),
wl AS (SELECT seq_id, string_agg(printf('{{"output_frame":%d,"source_frame":%d,"residual_px":%.4f}}', output_frame, source_frame, residual), ',' ORDER BY rank) AS worst FROM w WHERE rank <= 10 GROUP BY seq_id)
SELECT seq_id, validated, median, p95, maximum, jitter_p95, jitter_maximum, jitter_over_1px, worst FROM j JOIN wl USING (seq_id)"""
)
def validation_report(spark, sf_dir):
    """The report's JSON, read again; worst rows as text with four digits, as JSON has no fixed form of numbers."""
    found = sinks.validation(_metrics(spark, sf_dir), summary.worst_residuals(_residuals(spark, sf_dir)))
    made = F.from_json("report", "struct<validated:bigint,median:double,p95:double,maximum:double,jitter_p95:double,jitter_maximum:double,jitter_over_1px:bigint,worst:array<struct<output_frame:bigint,source_frame:bigint,residual_px:double>>>")
    line = F.transform("r.worst", lambda x: F.format_string('{"output_frame":%d,"source_frame":%d,"residual_px":%.4f}', x["output_frame"], x["source_frame"], x["residual_px"]))
    return found.select("seq_id", made.alias("r")).select("seq_id", *[f"r.{c}" for c in ("validated", "median", "p95", "maximum", "jitter_p95", "jitter_maximum", "jitter_over_1px")], F.array_join(line, ",").alias("worst"))


@query(""", n AS (SELECT seq_id, count(*) AS found FROM f GROUP BY seq_id) SELECT seq_id, found + 1 AS declared, found FROM n WHERE seq_id % 3 = 0""")
def incomplete_sequences(spark, sf_dir):
    f = load_frames(spark, sf_dir)
    return incomplete(f, f.groupBy("seq_id").agg((F.count(F.lit(1)) + F.when(F.col("seq_id") % 3 == 0, 1).otherwise(0)).alias("declared"))).select("seq_id", "declared", "found")
