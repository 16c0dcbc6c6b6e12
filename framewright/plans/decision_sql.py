"""The decision about a frame in SQL: regimes, trusted geometry, contrast track, robust path, content, keep.

Common table expressions that follow each other; every one keeps a row per frame.  Ordered folds are
recursive expressions over the frame number.
"""

from __future__ import annotations

from types import SimpleNamespace

from ..params import CENTERING_REASONS, CONTENT_REASONS, REGIME_REASONS, REPAIR_REASONS, SELECTION_REASONS, TEAR_REASONS

W = "(PARTITION BY seq_id ORDER BY frame_idx)"


def rows(low: str, high: str) -> str:
    return f"(PARTITION BY seq_id ORDER BY frame_idx ROWS BETWEEN {low} AND {high})"


def hyp(a: str, b: str) -> str:
    return f"sqrt(power({a}, 2) + power({b}, 2))"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


PAST, NEXT = rows("UNBOUNDED PRECEDING", "CURRENT ROW"), rows("CURRENT ROW", "UNBOUNDED FOLLOWING")

#: Discarded: a range of every sequence, frame 30 of every second one, and a range past the end.
RANGES = "frame_idx BETWEEN seq_id % 20 AND seq_id % 20 + seq_id % 5 OR (seq_id % 2 = 0 AND frame_idx = 30) OR frame_idx BETWEEN 5000 AND 6000"

#: Manual actions: some clipped and centred frames are kept, every eleventh frame that is neither is dropped.
MANUAL_KEEP = "content = 1 AND centering <> 2 AND NOT discarded AND frame_idx % 2 = 0"


def chain(fps: float = 30.0, s: float = 1.0, r: float = 80.0, w: float = 270.0, h: float = 360.0) -> SimpleNamespace:
    """The expressions for sequences of a frame rate, scale, radius and size."""
    near, most, reach = max(5, round(0.5 * fps)), max(6, round(2 * fps)), max(10, round(fps))
    bridge = max(reach, round(5 * fps))
    #: Evidence, signs of loss, and which evidence lies near the track (within 1.5 pixels).
    EVIDENCE = f"""me AS MATERIALIZED (SELECT *, k > 97 AS touch, 0 AS clip_edges, k * 4.0::double AS coverage, k / 20.0::double AS residual, k AS points, k > 97 OR maximum < 8 AS occluded FROM f),
ls AS MATERIALIZED (SELECT *, coalesce(raw_x IS NOT NULL AND NOT touch AND coverage >= 150 AND residual <= {4.5 * s} AND points >= 35 AND quality >= 0.01, false) AS ev,
 CAST(quality < 0.12 AS INT) + CAST(residual > {4.5 * s} AS INT) + CAST(coverage < 150 AS INT) + CAST(points < 35 AS INT) + CAST(occluded AS INT) AS signals FROM me),
tr(seq_id, frame_idx, tx, ty, lx, ly, near) AS (SELECT seq_id, frame_idx, CASE WHEN ev THEN raw_x END, CASE WHEN ev THEN raw_y END, CASE WHEN ev THEN raw_x END, CASE WHEN ev THEN raw_y END, ev FROM ls WHERE frame_idx = 0
 UNION ALL SELECT seq_id, frame_idx, CASE WHEN near THEN raw_x ELSE px END, CASE WHEN near THEN raw_y ELSE py END, CASE WHEN ev THEN raw_x ELSE lx END, CASE WHEN ev THEN raw_y ELSE ly END, near
 FROM (SELECT *, ev AND (lx IS NULL OR coalesce({hyp("raw_x - px", "raw_y - py")} <= 1.5, false) OR coalesce({hyp("raw_x - lx", "raw_y - ly")} <= 1.5, false)) AS near
 FROM (SELECT ls.*, tr.lx, tr.ly, tr.tx + CASE WHEN response >= 0.12 THEN ls.rel_x ELSE 0 END AS px, tr.ty + CASE WHEN response >= 0.12 THEN ls.rel_y ELSE 0 END AS py FROM tr JOIN ls ON ls.seq_id = tr.seq_id AND ls.frame_idx = tr.frame_idx + 1)))"""


    def _trend(name: str, value: str, least: float, slack: float) -> str:
        """Falls from the head of a run to its tail by ``least`` and rarely rises by more than ``slack``."""
        return f"""coalesce(median({value}) FILTER (WHERE place < third) - median({value}) FILTER (WHERE place < span AND place >= span - third) >= {least}::double
  AND avg(CASE WHEN place < span AND place > 0 THEN CAST({name} <= {slack}::double AS INT) END) >= 0.6, false)"""


    #: Regimes with 2 frames of recovery, 2 of strong loss and 9 to judge trends by.
    REGIMES = f"""{EVIDENCE},
bk AS (SELECT ls.*, near AS coherent, ls.ev AND near AS back, NOT ls.ev AND signals >= 2 AS strong FROM ls JOIN tr USING (seq_id, frame_idx)),
i1 AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY seq_id, back ORDER BY frame_idx) AS g FROM bk),
lb AS MATERIALIZED (SELECT * EXCLUDE (g), back AND (min(frame_idx) OVER (PARTITION BY seq_id, back, g) = 0 OR count(*) OVER (PARTITION BY seq_id, back, g) >= 2) AS limbo FROM i1),
i2 AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY seq_id, limbo ORDER BY frame_idx) AS g, frame_idx - row_number() OVER (PARTITION BY seq_id, strong AND NOT limbo ORDER BY frame_idx) AS g2 FROM lb),
i3 AS (SELECT *, min(frame_idx) OVER (PARTITION BY seq_id, limbo, g) AS run_start, count(*) OVER (PARTITION BY seq_id, limbo, g) AS run_length,
 CASE WHEN strong AND NOT limbo THEN count(*) OVER (PARTITION BY seq_id, strong AND NOT limbo, g2) ELSE 0 END AS core_length FROM i2),
i4 AS (SELECT *, frame_idx - run_start AS place, least(run_length, 9) AS span, greatest(2, least(run_length, 9) // 3) AS third,
 points - lag(points) OVER {W} AS d_points, coverage - lag(coverage) OVER {W} AS d_coverage, quality - lag(quality) OVER {W} AS d_quality, lag(residual) OVER {W} - residual AS d_residual FROM i3),
ru AS MATERIALIZED (SELECT seq_id, run_start, bool_and(limbo) AS limbo, max(run_length) AS run_length, max(core_length) AS core, CASE WHEN max(span) < 3 THEN 0 ELSE
 CAST({_trend("d_points", "points", 8, 2)} AS INT) + CAST({_trend("d_coverage", "coverage", 25, 5)} AS INT) + CAST({_trend("d_quality", "quality", 0.03, 0.01)} AS INT) + CAST({_trend("d_residual", "-residual", s, 0.25 * s)} AS INT)
 + CAST(coalesce(avg(CAST(occluded AS INT)) FILTER (WHERE place < span AND place >= span - third) - avg(CAST(occluded AS INT)) FILTER (WHERE place < third) >= 0.25, false) AS INT) END AS signs FROM i4 GROUP BY seq_id, run_start),
r2 AS (SELECT *, coalesce(lag(run_length) OVER (PARTITION BY seq_id ORDER BY run_start), 0) AS led_by FROM ru),
hs AS (SELECT seq_id, min(run_start) FILTER (WHERE NOT limbo AND led_by >= 2 AND core >= 2 AND signs >= 2) AS horizon_start FROM r2 GROUP BY seq_id),
rg AS (SELECT i3.* EXCLUDE (g, g2, core_length), led_by, core, signs, horizon_start, coalesce(frame_idx >= horizon_start, false) AS past FROM i3 JOIN r2 USING (seq_id, run_start) JOIN hs ON hs.seq_id = i3.seq_id),
re AS MATERIALIZED (SELECT *, CASE WHEN past THEN 2 WHEN limbo THEN 0 ELSE 1 END AS regime, ev AND past AS false_circle, min(CASE WHEN past OR NOT limbo THEN frame_idx END) OVER (PARTITION BY seq_id) AS contrast_start,
 CASE WHEN ev AND past THEN {quoted(REGIME_REASONS["false_circle"])} WHEN past THEN {quoted(REGIME_REASONS["horizon"])} WHEN limbo THEN {quoted(REGIME_REASONS["limbo"])} ELSE {quoted(REGIME_REASONS["transient"])} END AS regime_reason FROM rg)"""

    #: Evidence before the horizon without single frames that leave the motion and come back.
    TRUSTED = f"""{REGIMES},
us AS (SELECT *, ev AND NOT past AS usable FROM re),
od AS (SELECT *, usable AND lag(usable) OVER {W} AND lead(usable) OVER {W} AND {hyp(f"raw_x - lag(raw_x) OVER {W} - rel_x", f"raw_y - lag(raw_y) OVER {W} - rel_y")} > {4 * s}
 AND {hyp(f"lead(raw_x) OVER {W} - raw_x - lead(rel_x) OVER {W}", f"lead(raw_y) OVER {W} - raw_y - lead(rel_y) OVER {W}")} > {4 * s}
 AND {hyp(f"lead(raw_x) OVER {W} - lag(raw_x) OVER {W} - rel_x - lead(rel_x) OVER {W}", f"lead(raw_y) OVER {W} - lag(raw_y) OVER {W} - rel_y - lead(rel_y) OVER {W}")} < {4 * s} AS odd FROM us),
tg AS MATERIALIZED (SELECT * EXCLUDE (odd, usable), usable AND NOT coalesce(odd, false) AS trusted, usable AND coalesce(odd, false) AS rejected FROM od)"""

    _MEDIAN = "list_aggregate({0}, 'median')"


    def _spread(axis: str) -> str:
        return f"list_aggregate(list_transform(o{axis}, lambda v: abs(v - list_aggregate(o{axis}, 'median'))), 'median')"


    #: The contrast track: trusted frames teach offsets (60 at most) and the limit of a correction.
    CONTRAST = f"""{TRUSTED},
sp AS MATERIALIZED (SELECT *, 100 + 0.2::double * frame_idx AS spot_x, 170 + 0.1::double * frame_idx AS spot_y, quality / 2 AS spot_score, raw_x IS NOT NULL AND trusted AS fixed,
 CASE WHEN response >= 0.12 AND {hyp("rel_x", "rel_y")} <= {35 * s} THEN rel_x ELSE 0 END AS mx, CASE WHEN response >= 0.12 AND {hyp("rel_x", "rel_y")} <= {35 * s} THEN rel_y ELSE 0 END AS my FROM tg),
ct(seq_id, frame_idx, px, py, ox, oy, lim, contrast_x, contrast_y, contrast_score, sample_x, sample_y, reanchored, supported, fallback_innovation, fallback_mode) AS (
 SELECT DISTINCT seq_id, CAST(-1 AS BIGINT), NULL::double, NULL::double, CAST([] AS DOUBLE[]), CAST([] AS DOUBLE[]), {4.0 * s}::double, NULL::double, NULL::double, 0::double, NULL::double, NULL::double, false, false, 0::double, 0 FROM sp
 UNION ALL SELECT seq_id, frame_idx, npx, npy, ox, oy, CASE WHEN fixed AND taught AND len(ox) >= 6 THEN greatest({2.5 * s}::double, least({20 * s}::double, 4 * 1.4826::double * ({_spread("x")} + {_spread("y")}) / 2)) ELSE lim END,
  npx, npy, CASE WHEN npx IS NULL THEN 0 ELSE spot_score END, CASE WHEN fixed AND taught THEN sx END, CASE WHEN fixed AND taught THEN sy END, fixed, npx IS NOT NULL, CASE WHEN fixed THEN 0 ELSE len_ END, CASE WHEN fixed THEN 0 ELSE 1 END
 FROM (SELECT *, CASE WHEN fixed THEN raw_x WHEN px IS NULL THEN NULL ELSE least({w + r / 4}::double, greatest({-r / 4}::double, tx + share * dx)) END AS npx, CASE WHEN fixed THEN raw_y WHEN py IS NULL THEN NULL ELSE least({h + r / 4}::double, greatest({-r / 4}::double, ty + share * dy)) END AS npy
 FROM (SELECT *, CASE WHEN taught THEN least(far, lim) ELSE 0 END AS len_, CASE WHEN taught AND far > 0 THEN (0.55::double + 0.35::double * spot_score) * least(far, lim) / far ELSE 0 END AS share
 FROM (SELECT *, {hyp("dx", "dy")} AS far FROM (SELECT *, spot_x + coalesce({_MEDIAN.format("ox")}, 0) - tx AS dx, spot_y + coalesce({_MEDIAN.format("oy")}, 0) - ty AS dy
 FROM (SELECT sp.*, ct.px, ct.py, ct.lim, spot_score > 0.02 AS taught, sp.raw_x - spot_x AS sx, sp.raw_y - spot_y AS sy, coalesce(ct.px + mx, {w / 2}) AS tx, coalesce(ct.py + my, {h / 2}) AS ty,
   CASE WHEN fixed AND spot_score > 0.02 THEN list_slice(list_append(ct.ox, sp.raw_x - spot_x), -{most}, -1) ELSE ct.ox END AS ox, CASE WHEN fixed AND spot_score > 0.02 THEN list_slice(list_append(ct.oy, sp.raw_y - spot_y), -{most}, -1) ELSE ct.oy END AS oy
   FROM ct JOIN sp ON sp.seq_id = ct.seq_id AND sp.frame_idx = ct.frame_idx + 1)))))),
co AS MATERIALIZED (SELECT tg.*, contrast_x, contrast_y, contrast_score, {_MEDIAN.format("ox")} AS offset_x, {_MEDIAN.format("oy")} AS offset_y, sample_x, sample_y, reanchored, supported, fallback_innovation, fallback_mode
 FROM tg JOIN ct USING (seq_id, frame_idx))"""


    def solved(source: str, name: str, x: str, y: str, weight: str, stiffness: str) -> str:
        """``name``: seq_id, frame_idx, x and y of the weighted path through a table's anchors."""
        return f"""{name}_n AS (SELECT seq_id, frame_idx, CASE WHEN {x} IS NULL THEN 0 ELSE {weight} END AS a, coalesce({x}, 0) AS ax, coalesce({y}, 0) AS ay, rel_x, rel_y, CASE WHEN frame_idx = 0 THEN 0 ELSE {stiffness} END AS w FROM {source}),
{name}_b AS MATERIALIZED (SELECT seq_id, frame_idx, -w AS lo, a + w + coalesce(lead(w) OVER {W}, 0) + 1e-9::double AS di, -coalesce(lead(w) OVER {W}, 0) AS up, bool_or(a > 0) OVER (PARTITION BY seq_id) AS any_,
 a * ax + w * rel_x - coalesce(lead(w) OVER {W} * lead(rel_x) OVER {W}, 0) AS bx, a * ay + w * rel_y - coalesce(lead(w) OVER {W} * lead(rel_y) OVER {W}, 0) AS by_ FROM {name}_n),
{name}_f(seq_id, frame_idx, c, dx, dy, any_) AS (SELECT seq_id, frame_idx, up / di, bx / di, by_ / di, any_ FROM {name}_b WHERE frame_idx = 0 UNION ALL
 SELECT b.seq_id, b.frame_idx, b.up / (b.di - b.lo * f.c), (b.bx - b.lo * f.dx) / (b.di - b.lo * f.c), (b.by_ - b.lo * f.dy) / (b.di - b.lo * f.c), b.any_ FROM {name}_f f JOIN {name}_b b ON b.seq_id = f.seq_id AND b.frame_idx = f.frame_idx + 1),
{name}_t AS (SELECT seq_id, max(frame_idx) AS last FROM {name}_b GROUP BY seq_id),
{name}_s(seq_id, frame_idx, x, y, any_) AS (SELECT f.seq_id, f.frame_idx, f.dx, f.dy, f.any_ FROM {name}_f f JOIN {name}_t t ON f.seq_id = t.seq_id AND f.frame_idx = t.last UNION ALL
 SELECT f.seq_id, f.frame_idx, f.dx - f.c * s.x, f.dy - f.c * s.y, f.any_ FROM {name}_s s JOIN {name}_f f ON f.seq_id = s.seq_id AND f.frame_idx = s.frame_idx - 1),
{name} AS MATERIALIZED (SELECT seq_id, frame_idx, CASE WHEN any_ THEN x END AS x, CASE WHEN any_ THEN y END AS y FROM {name}_s)"""


    _R = REPAIR_REASONS


    def path(source: str) -> str:
        """The robust path of a table with x, y (anchors), limb, contrast, quality and score: ``rp``."""
        span, gate_rows = rows("60 PRECEDING", "60 FOLLOWING"), rows("60 PRECEDING", "1 PRECEDING")
        return f"""p0 AS (SELECT *, (limb OR contrast) AND x IS NOT NULL AS known, coalesce(median(CASE WHEN response > 0 THEN response END) OVER (PARTITION BY seq_id), 1) AS normal FROM {source}),
p1 AS MATERIALIZED (SELECT *, CASE WHEN NOT known THEN 0 WHEN limb THEN 6 + 18 * least(1::double, greatest(0::double, quality)) ELSE 0.02::double + 0.18::double * least(1::double, greatest(0::double, score)) END AS weight,
 0.03::double + 0.5::double * least(1::double, greatest(0::double, response / greatest(normal, 1e-6::double))) AS stiffness FROM p0),
{solved("p1", "pa", "x", "y", "weight", "stiffness")},
p2 AS (SELECT p1.*, pa.x AS path_x, pa.y AS path_y FROM p1 JOIN pa USING (seq_id, frame_idx)),
p3 AS (SELECT *, x - sum(rel_x) OVER {PAST} AS off_x, y - sum(rel_y) OVER {PAST} AS off_y,
 coalesce(CASE WHEN known AND lag(known) OVER {W} THEN {hyp(f"x - lag(x) OVER {W} - rel_x", f"y - lag(y) OVER {W} - rel_y")} END, 0) AS local_ FROM p2),
p4 AS (SELECT *, CASE WHEN known THEN off_x END AS kx, CASE WHEN known THEN off_y END AS ky, CASE WHEN limb AND known THEN frame_idx END AS li, CASE WHEN limb AND known THEN off_x END AS lx, CASE WHEN limb AND known THEN off_y END AS ly FROM p3),
p5 AS (SELECT *, CASE WHEN known AND count(kx) OVER {span} >= 5 THEN {hyp(f"off_x - quantile_cont(kx, 0.5) OVER {span}", f"off_y - quantile_cont(ky, 0.5) OVER {span}")} END AS base,
 last_value(li IGNORE NULLS) OVER {PAST} AS i0, first_value(li IGNORE NULLS) OVER {NEXT} AS i1, last_value(lx IGNORE NULLS) OVER {PAST} AS x0, first_value(lx IGNORE NULLS) OVER {NEXT} AS x1,
 last_value(ly IGNORE NULLS) OVER {PAST} AS y0, first_value(ly IGNORE NULLS) OVER {NEXT} AS y1 FROM p4),
p6 AS (SELECT *, greatest(coalesce(base, 0), coalesce(CASE WHEN known AND i1 - i0 > 1 AND i1 - i0 <= 150 THEN {hyp("off_x - (x0 + (x1 - x0) * (frame_idx - i0) / (i1 - i0))", "off_y - (y0 + (y1 - y0) * (frame_idx - i0) / (i1 - i0))")} END, 0)) AS closure FROM p5),
p7 AS (SELECT *, CASE WHEN known THEN {hyp("x - path_x", "y - path_y")} ELSE 0 END AS off_path FROM p6),
p8 AS MATERIALIZED (SELECT *, greatest(off_path, closure) AS combined FROM p7),
p9 AS (SELECT *, list_filter(coalesce(list(CASE WHEN combined > 0 THEN combined END) OVER {gate_rows}, []), lambda v: v IS NOT NULL) AS past_ FROM p8),
p10 AS (SELECT *, list_aggregate(past_, 'median') AS mid FROM p9),
p11 AS MATERIALIZED (SELECT * EXCLUDE (past_, mid), CASE WHEN len(past_) < 5 THEN {2.0 * s}::double ELSE least({3.0 * s}::double, greatest({2.0 * s}::double, mid + 3 * 1.4826::double * list_aggregate(list_transform(past_, lambda v: abs(v - mid)), 'median'))) END AS gate FROM p10),
p12 AS (SELECT *, coalesce(known AND lag(known) OVER {W} AND lead(known) OVER {W} AND (NOT limb OR (lag(limb) OVER {W} AND lead(limb) OVER {W})) AND local_ > gate AND lead(local_) OVER {W} > gate
 AND {hyp(f"lead(x) OVER {W} - lag(x) OVER {W} - rel_x - lead(rel_x) OVER {W}", f"lead(y) OVER {W} - lag(y) OVER {W} - rel_y - lead(rel_y) OVER {W}")} <= 2 * gate, false) AS spike, known AND closure > 2 * gate AS seed FROM p11),
g0 AS MATERIALIZED (SELECT *, frame_idx - row_number() OVER (PARTITION BY seq_id, seed ORDER BY frame_idx) AS g FROM p12),
g1 AS (SELECT seq_id, min(frame_idx) AS start, max(frame_idx) AS stop FROM g0 WHERE seed GROUP BY seq_id, g HAVING count(*) >= 3),
g2 AS (SELECT g1.seq_id, start, stop, max(a.frame_idx) AS b FROM g1 JOIN g0 a ON a.seq_id = g1.seq_id AND a.known AND a.frame_idx BETWEEN start - 30 AND start - 1 GROUP BY ALL),
g3 AS (SELECT g1.seq_id, start, min(a.frame_idx) AS a FROM g1 JOIN g0 a ON a.seq_id = g1.seq_id AND a.known AND a.frame_idx BETWEEN stop + 1 AND stop + 30 GROUP BY ALL),
g4 AS (SELECT g2.seq_id, g2.start, g2.stop FROM g2 JOIN g3 USING (seq_id, start) JOIN g0 p ON p.seq_id = g2.seq_id AND p.frame_idx = b JOIN g0 q ON q.seq_id = g2.seq_id AND q.frame_idx = a
 WHERE {hyp("p.off_x - q.off_x", "p.off_y - q.off_y")} <= 2 * greatest(p.gate, q.gate)),
g5 AS (SELECT seq_id, min(frame_idx) AS lo, max(frame_idx) AS hi FROM g0 WHERE limb AND known GROUP BY seq_id),
g6 AS (SELECT DISTINCT g0.seq_id, g0.frame_idx FROM g0 JOIN g4 ON g4.seq_id = g0.seq_id AND g0.frame_idx BETWEEN g4.start - 30 AND g4.stop + 30 LEFT JOIN g5 ON g5.seq_id = g0.seq_id
 WHERE known AND (NOT limb OR quality < 0.15) AND coalesce(g0.frame_idx NOT IN (lo, hi), true)),
q1 AS (SELECT g0.* EXCLUDE (g), g6.seq_id IS NOT NULL AS excursion, gate / greatest(combined, 1e-9::double) AS ratio FROM g0 LEFT JOIN g6 USING (seq_id, frame_idx)),
q2 AS (SELECT *, CASE WHEN known AND NOT spike THEN frame_idx END AS gi, CASE WHEN known AND NOT spike THEN x END AS gx, CASE WHEN known AND NOT spike THEN y END AS gy FROM q1),
q3 AS (SELECT *, last_value(gi IGNORE NULLS) OVER {rows("5 PRECEDING", "CURRENT ROW")} AS bi, last_value(gx IGNORE NULLS) OVER {rows("5 PRECEDING", "CURRENT ROW")} AS bx, last_value(gy IGNORE NULLS) OVER {rows("5 PRECEDING", "CURRENT ROW")} AS by_,
 first_value(gi IGNORE NULLS) OVER {rows("CURRENT ROW", "5 FOLLOWING")} AS ni, first_value(gx IGNORE NULLS) OVER {rows("CURRENT ROW", "5 FOLLOWING")} AS nx, first_value(gy IGNORE NULLS) OVER {rows("CURRENT ROW", "5 FOLLOWING")} AS ny,
 coalesce({hyp(f"path_x - lag(path_x) OVER {W} - rel_x", f"path_y - lag(path_y) OVER {W} - rel_y")}, 0) AS strain, spike OR coalesce(lag(spike) OVER {W}, false) AS edge FROM q2),
q4 AS (SELECT *, spike AND bi IS NOT NULL AND ni IS NOT NULL AS mended, CASE WHEN strain > {4 * s} AND response < normal THEN {4 * s} / strain ELSE 1 END AS loose FROM q3),
q5 AS MATERIALIZED (SELECT *, CASE WHEN mended THEN bx + (nx - bx) * (frame_idx - bi) / (ni - bi) ELSE x END AS ux, CASE WHEN mended THEN by_ + (ny - by_) * (frame_idx - bi) / (ni - bi) ELSE y END AS uy,
 weight * CASE WHEN mended THEN 1 ELSE least(CASE WHEN spike THEN power(least(0.05::double, ratio), 2) ELSE 1 END, CASE WHEN NOT limb AND known AND combined > gate THEN 0.5::double * ratio * ratio ELSE 1 END, CASE WHEN excursion THEN 1e-6::double ELSE 1 END) END AS mended_weight,
 stiffness * CASE WHEN edge THEN least(loose, 0.01::double) ELSE loose END AS mended_stiffness FROM q4),
{solved("q5", "pb", "ux", "uy", "mended_weight", "mended_stiffness")},
q6 AS (SELECT q5.*, pb.x AS center_x, pb.y AS center_y, {hyp("pb.x - path_x", "pb.y - path_y")} AS correction, response >= 0.12 AND {hyp("rel_x", "rel_y")} > {4 * s} AND local_ <= {2 * s} AS jump FROM q5 JOIN pb USING (seq_id, frame_idx)),
q7 AS (SELECT *, coalesce((excursion OR spike) AND correction > {0.05 * s}, false) AS repaired, spike AND NOT jump AS jitter_candidate, seed AND NOT jump AS excursion_candidate FROM q6),
rp AS MATERIALIZED (SELECT *, CASE WHEN repaired AND NOT (jitter_candidate OR excursion_candidate) THEN {quoted(_R["weights"])} WHEN jump THEN {quoted(_R["jump"])} WHEN excursion_candidate THEN {quoted(_R["excursion"])}
 WHEN jitter_candidate THEN {quoted(_R["jitter"])} ELSE {quoted(_R["none"])} END AS reason FROM q7)"""


    _T, _C, _E = TEAR_REASONS, CONTENT_REASONS, CENTERING_REASONS
    _AT = "(PARTITION BY seq_id ORDER BY frame_idx ROWS BETWEEN {0})"

    DECIDED = f"""{CONTRAST},
ba AS (SELECT *, coalesce(regime <> 0 AND contrast_x IS NOT NULL AND supported AND NOT trusted, false) AS backup, regime = 2 AND contrast_x IS NOT NULL AS horizon_visible, regime = 2 AND maximum >= 8 AS horizon_present FROM co),
an AS MATERIALIZED (SELECT *, CASE WHEN backup THEN contrast_x ELSE raw_x END AS x, CASE WHEN backup THEN contrast_y ELSE raw_y END AS y, trusted AS limb, backup AS contrast, contrast_score AS score, trusted OR backup AS anchor_used FROM ba),
{path("an")},
mg AS (SELECT *, least(center_x - {r}, center_y - {r}, {w - 1} - center_x - {r}, {h - 1} - center_y - {r}) AS margin, evaluable AND NOT past AS able FROM rp),
d1 AS (SELECT *, list_filter(coalesce(list(CASE WHEN able THEN exposed END) OVER {_AT.format(f"{near} PRECEDING AND 1 PRECEDING")}, []), lambda v: v IS NOT NULL) AS before_,
 list_filter(coalesce(list(CASE WHEN able THEN exposed END) OVER {_AT.format(f"1 FOLLOWING AND {near} FOLLOWING")}, []), lambda v: v IS NOT NULL) AS after_ FROM mg),
d2 AS (SELECT *, list_aggregate(list_concat(before_, after_), 'median') AS mid, CASE WHEN able AND len(before_) >= 3 AND len(after_) >= 3 THEN least(list_aggregate(before_, 'median'), list_aggregate(after_, 'median')) END AS baseline FROM d1),
d3 AS (SELECT *, 1.4826::double * list_aggregate(list_transform(list_concat(before_, after_), lambda v: abs(v - mid)), 'median') AS noise, baseline - exposed AS drop_ FROM d2),
d4 AS (SELECT * EXCLUDE (before_, after_, mid), coalesce(drop_ >= greatest(0.08::double, 6 * noise), false) AS candidate FROM d3),
d5 AS (SELECT *, candidate AND able AS hit, frame_idx - row_number() OVER (PARTITION BY seq_id, candidate AND able ORDER BY frame_idx) AS g FROM d4),
d6 AS (SELECT * EXCLUDE (g), CASE WHEN hit THEN count(*) OVER (PARTITION BY seq_id, hit, g) ELSE 0 END AS run_length2 FROM d5),
d7 AS (SELECT *, hit AND run_length2 / {fps}::double <= 0.067::double + 1e-9::double AS tear FROM d6),
d8 AS (SELECT *, tear AS clipped, maximum >= 8 AS bright, past OR points >= 35 AS sound, coalesce(abs(CAST(maximum AS DOUBLE) - lag(maximum) OVER {W}), 0) AS leap,
 CASE WHEN past THEN {quoted(_T["horizon"])} WHEN NOT evaluable THEN {quoted(_T["not_evaluable"])} WHEN tear THEN {quoted(_T["confirmed"])} WHEN candidate THEN printf({quoted(_T["sustained"])}, run_length2) ELSE {quoted(_T["none"])} END AS tear_verdict FROM d7),
lm AS (SELECT seq_id, median(leap) FILTER (WHERE leap > 0) AS m FROM d8 GROUP BY seq_id),
lg AS (SELECT seq_id, m, median(abs(leap - m)) FILTER (WHERE leap > 0) AS s FROM d8 JOIN lm USING (seq_id) GROUP BY seq_id, m),
d9 AS (SELECT d8.*, coalesce(greatest(20, m + 6 * s), 20) AS leap_gate FROM d8 JOIN lg USING (seq_id)),
d10 AS (SELECT *, CAST(maximum < 8 AS INT) + CAST(response < 0.05 AS INT) + CAST(leap > leap_gate AS INT) + CAST(off_path > {4 * s} AS INT) AS corruption_signals FROM d9),
d11 AS MATERIALIZED (SELECT *, corruption_signals >= 2 AS corrupt, CASE WHEN clipped THEN 1 WHEN corruption_signals >= 2 THEN 2 WHEN bright AND sound THEN 0 ELSE 2 END AS content,
 CASE WHEN tear THEN printf({quoted(_C["tear"])}, round(drop_ * 100, 1)) WHEN corruption_signals >= 2 THEN {quoted(_C["corrupt"])} WHEN bright AND sound THEN {quoted(_C["usable"])}
  ELSE concat_ws('; ', CASE WHEN NOT bright THEN printf({quoted(_C["dark"])}, maximum) END, CASE WHEN NOT sound THEN printf({quoted(_C["weak"])}, points) END) END AS content_reason,
 trusted AND regime = 0 AS direct, backup AND off_path > {max(4 * s, r / 2)} AND response < 0.05 AS against, backup OR (trusted AND regime <> 0) AS support FROM d10),
e1 AS (SELECT *, max(CASE WHEN direct THEN frame_idx END) OVER {PAST} AS prev_anchor, min(CASE WHEN direct THEN frame_idx END) OVER {NEXT} AS next_anchor, count(*) OVER (PARTITION BY seq_id) AS n FROM d11),
e2 AS (SELECT *, coalesce(next_anchor - prev_anchor <= {bridge}, false) OR coalesce(frame_idx - prev_anchor <= {reach}, false) OR coalesce(next_anchor - frame_idx <= {reach}, false) AS near FROM e1),
e3 AS (SELECT *, CASE WHEN direct THEN 0 WHEN against THEN 2 WHEN support OR near THEN 1 ELSE 2 END AS center0,
 CASE WHEN direct THEN {quoted(_E["anchor"])} WHEN against THEN {quoted(_E["conflict"])} WHEN support THEN {quoted(_E["support"])} WHEN near THEN printf({quoted(_E["neighbours"])}, coalesce(prev_anchor, -1), coalesce(next_anchor, n)) ELSE {quoted(_E["none"])} END AS why FROM e2),
e4 AS (SELECT *, content = 2 AND center0 = 1 AND NOT trusted AND (jitter_candidate OR excursion_candidate) AND NOT jump AS contradicted FROM e3),
e5 AS (SELECT *, CASE WHEN contradicted THEN 2 ELSE center0 END AS centering, substr(CASE WHEN contradicted THEN {quoted(_E["contradicted"])} ELSE why END, 1, 90) AS centering_reason, {RANGES} AS discarded FROM e4),
de AS MATERIALIZED (SELECT *, NOT clipped AND centering <> 2 AS auto_keep, NOT clipped AND centering <> 2 AND NOT discarded AS keep FROM e5)"""

    SELECTED = f"""{DECIDED},
ma AS (SELECT *, {MANUAL_KEEP} AS kept_, NOT ({MANUAL_KEEP}) AND (seq_id + frame_idx) % 11 = 0 AS dropped_ FROM de),
se AS (SELECT *, CASE WHEN dropped_ THEN false WHEN kept_ THEN true ELSE keep END AS mask, CASE WHEN dropped_ OR kept_ THEN 'manual' WHEN discarded THEN 'profile' ELSE 'auto' END AS origin,
 CASE WHEN dropped_ THEN {quoted(SELECTION_REASONS["drop"])} WHEN kept_ THEN {quoted(SELECTION_REASONS["keep"])} WHEN discarded THEN {quoted(SELECTION_REASONS["profile"])} ELSE '' END AS selection_reason FROM ma)"""

    return SimpleNamespace(EVIDENCE=EVIDENCE, REGIMES=REGIMES, TRUSTED=TRUSTED, CONTRAST=CONTRAST, DECIDED=DECIDED, SELECTED=SELECTED, path=path)


_USUAL = chain()
EVIDENCE, REGIMES, TRUSTED, CONTRAST, DECIDED, SELECTED, path = _USUAL.EVIDENCE, _USUAL.REGIMES, _USUAL.TRUSTED, _USUAL.CONTRAST, _USUAL.DECIDED, _USUAL.SELECTED, _USUAL.path
