"""Frame queries against SQL, and scenarios of the operators on small sequences."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.functions import parse
from framewright.operators import limb, policy, seqops, summary
from framewright.plans import limb_queries, queries, solve


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{float(v):.5f}".replace("-0.00000", "0.00000") if isinstance(v, float) or hasattr(v, "as_tuple") else str(v)


@pytest.fixture(scope="module")
def decided_once(spark, sf_dir):
    """The decisions of the events, which many queries show, are made once."""
    made = queries.decisions_of(spark, sf_dir).cache()
    with pytest.MonkeyPatch.context() as patch:
        for module in (queries, limb_queries):
            patch.setattr(module, "decisions_of", lambda *_: made)
        yield made


@pytest.mark.parametrize("name", sorted(queries.SQL))
@pytest.mark.usefixtures("decided_once")
def test_same_as_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for name_ in ("events", "supplier"):
        con.sql(f"CREATE VIEW {name_} AS SELECT * FROM '{sf_dir}/{name_}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    rows = sorted(tuple(map(norm, r)) for r in got.collect())
    want = con.sql(queries.SQL[name])
    place = [want.columns.index(c) for c in got.columns]
    assert rows == sorted(tuple(norm(r[i]) for i in place) for r in want.fetchall())


@pytest.fixture(scope="module")
def tie_dir(tmp_path_factory):
    """Events whose tears' drops (29.85 and 30.05 percent) lie just beside a half of a tenth."""
    import duckdb

    folder = tmp_path_factory.mktemp("ties")
    ks = {20: 66, 60: 42, 100: 46}
    rows = ", ".join(f"({i}, TIMESTAMP '2024-01-01' + INTERVAL {i} SECOND, 7, 'view', {300.0 if i in ks else 20.0}::double, '{{\"k\": {ks.get(i, 51 if i < 40 else 27 if i < 80 else 51)}}}')" for i in range(120))
    duckdb.sql(f"COPY (SELECT * FROM (VALUES {rows}) t(event_id, ts, user_id, event_type, value, props)) TO '{folder}/events.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize(("name", "column"), [("debug_csv", "content_reason"), ("decision_table", "reason"), ("decisions", "content_reason"), ("tracking_csv", "content_reason"), ("overlay_lines", "line_2")])
def test_figures_beside_a_half_read_as_in_sql(spark, tie_dir, name, column):
    import duckdb

    duckdb.sql(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{tie_dir}/events.parquet'")
    want = sorted(r for (r,) in duckdb.sql(f"SELECT {column} FROM ({queries.SQL[name]})").fetchall())
    assert sum("%" in r for r in want) == 3
    assert sorted(r[column] for r in queries.QUERIES[name](spark, tie_dir).select(column).collect()) == want


@pytest.mark.parametrize(("n", "fps", "want"), [(3, 24.0, "3 frames, 24.000 fps, 0.12 s"), (87, 24.0, "87 frames, 24.000 fps, 3.62 s"), (9, 24.0, "9 frames, 24.000 fps, 0.38 s"), (4000, 1.0, "4000 frames, 1.000 fps, 4000.00 s"), (5, 24.0625, "5 frames, 24.062 fps, 0.21 s")])
def test_halves_in_a_sequence_s_line_go_to_even(spark, n, fps, want):
    line = parse.sequence_text(F.lit(n), F.lit(fps), F.lit(n) / F.lit(fps), F.lit(True))
    assert spark.range(1).select(line.alias("line")).first().line == want


def test_values_off_a_tie_are_rounded_as_in_sql(spark):
    import duckdb

    values = [131.783708499, -131.783708501, 0.0, -0.0000005, 1.25, 100.0000005, None]
    want = [r for (r,) in duckdb.sql(f"SELECT round(v + 1e-9::double, 6) FROM (VALUES {', '.join(f'({i}, CAST({'NULL' if v is None else repr(v)} AS DOUBLE))' for i, v in enumerate(values))}) t(i, v) ORDER BY i").fetchall()]
    assert want[0] == 131.783708
    assert [r.v for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(*queries.off_tie("v")).collect()] == want


@pytest.fixture(scope="module")
def repeated_dir(tmp_path_factory):
    """Users whose events come twenty times over, each twenty in a row or all again 400 days later; closures of theirs stand at the gate."""
    import duckdb

    folder = tmp_path_factory.mktemp("repeated")
    source = "'/root/testdata/sf0.001/events.parquet'"
    duckdb.sql(f"""COPY (SELECT event_id + i * 1000000 AS event_id, ts, user_id, event_type, value, props FROM {source}, range(20) t(i) WHERE user_id IN (8, 12)
 UNION ALL SELECT event_id + i * 1000000, ts + INTERVAL (i * 400) DAY, user_id + 100, event_type, value, props FROM {source}, range(20) t(i) WHERE user_id IN (3, 9)) TO '{folder}/events.parquet' (FORMAT parquet)""")
    return str(folder)


def test_report_at_the_gate_is_that_of_exact_sums(spark, repeated_dir):
    """The SQL's own sums of doubles depend on where rows stand, so they are made exact here."""
    import duckdb

    sql = queries.SQL["analysis_report"]
    for c in ("rel_x", "rel_y"):
        summed = f"sum({c}) OVER {queries.D.PAST}"
        assert summed in sql
        sql = sql.replace(summed, f"CAST(sum(CAST({c} AS DECIMAL(38, 18))) OVER {queries.D.PAST} AS DOUBLE)")
    duckdb.sql(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{repeated_dir}/events.parquet'")
    want = duckdb.sql(sql)
    got = queries.QUERIES["analysis_report"](spark, repeated_dir)
    place = [want.columns.index(c) for c in got.columns]
    assert sorted(tuple(map(norm, r)) for r in got.collect()) == sorted(tuple(norm(r[i]) for i in place) for r in want.fetchall())


def test_report_s_figures_are_rounded_as_in_sql(spark, monkeypatch):
    import duckdb

    values = [1.278895, 0.567815, 0.076135, 1.116985, 0.25, 0.0, 131.783708]
    flags = ("anchor_used", "rejected", "jitter_candidate", "excursion_candidate", "corrupt", "repaired", "false_circle", "clipped", "cut", "discarded")
    made = spark.createDataFrame(list(enumerate(values)), "seq_id long, anchor_x double").withColumns({c: F.lit(0.0) for c in ("anchor_y", "center_x", "center_y")} | {c: F.lit(0) for c in ("regime", "content", "centering")} | {c: F.lit(c == "anchor_used") for c in flags})
    made = made.withColumns({"frame_idx": F.lit(0).cast("bigint"), "horizon_start": F.lit(None).cast("bigint"), "keep": F.lit(True)})
    monkeypatch.setattr(limb_queries, "decisions_of", lambda spark, sf_dir: made)
    want = dict(duckdb.sql(f"SELECT i, round(v, 5) FROM (VALUES {', '.join(f'({i}, {v!r}::double)' for i, v in enumerate(values))}) t(i, v)").fetchall())
    for r in queries.QUERIES["analysis_report"](spark, "").collect():
        assert (r.residual_median, r.residual_p95, r.residual_maximum) == (want[r.seq_id],) * 3
        assert r.step_p95 is None and r.step_maximum is None


def seq(spark, **columns):
    n = len(next(iter(columns.values())))
    rows = [(1, i, *[c[i] for c in columns.values()]) for i in range(n)]
    kinds = {bool: "boolean", float: "double", int: "long", type(None): "double"}
    return spark.createDataFrame(rows, ", ".join(["seq_id long", "frame_idx long", *[f"{k} {kinds[type(next((x for x in v if x is not None), 0.0))]}" for k, v in columns.items()]]))


def frames(df, flag):
    return sorted(r.frame_idx for r in df.filter(flag).collect())


def test_a_short_dip_is_a_tear_and_a_slope_is_none(spark):
    dip = seq(spark, exposed=[0.75 if i == 30 else 1.0 for i in range(61)], evaluable=[True] * 61)
    assert frames(seqops.isolated_tears(seqops.exposure_drops(dip, 30.0), 30.0), "tear") == [30]
    slope = seq(spark, exposed=[float(x) for x in np.linspace(1, 0.4, 61)], evaluable=[True] * 61)
    assert frames(seqops.exposure_drops(slope, 30.0), "candidate") == []


@pytest.mark.parametrize(("fps", "longest"), [(24.0, 1), (25.0, 1), (30.0, 2), (60.0, 4), (120.0, 8)])
def test_tears_last_67_milliseconds_at_most(spark, fps, longest):
    for n, some in ((longest, True), (longest + 1, False)):
        df = seq(spark, candidate=[False, *[True] * n, False], evaluable=[True] * (n + 2))
        assert bool(frames(seqops.isolated_tears(df, fps), "tear")) is some
    with pytest.raises(ValueError, match="fps"):
        seqops.isolated_tears(df, 0.0)


def test_rows_that_cannot_be_judged_split_runs(spark):
    df = seq(spark, candidate=[True] * 5, evaluable=[True, True, False, True, True])
    assert frames(seqops.isolated_tears(df, 30.0), "tear") == [0, 1, 3, 4]


def test_hysteresis_needs_a_long_run_after_the_first(spark):
    df = seq(spark, ev=[True, True, False, True, True, False, *[True] * 5])
    assert frames(seqops.hysteresis(df, "ev", 5), "limbo") == [0, 1, 6, 7, 8, 9, 10]


def test_path_follows_steps_through_a_gap_and_solves_the_system():
    rng = np.random.default_rng(1)
    n = 40
    m, a, r, w = rng.normal(size=n), rng.uniform(1, 2, n), rng.normal(size=n), rng.uniform(0.1, 1, n)
    m[10:20] = np.nan
    full = np.zeros((n, n))
    rhs = np.zeros(n)
    for i in range(n):
        full[i, i] += solve.RIDGE
        if not np.isnan(m[i]):
            full[i, i] += a[i]
            rhs[i] += a[i] * m[i]
        if i:
            full[i, i] += w[i]
            full[i - 1, i - 1] += w[i]
            full[i, i - 1] -= w[i]
            full[i - 1, i] -= w[i]
            rhs[i] += w[i] * r[i]
            rhs[i - 1] -= w[i] * r[i]
    assert np.allclose(solve.path(m, a, r, w), np.linalg.solve(full, rhs), atol=1e-6)


def test_one_sequence_does_not_depend_on_the_others(spark, sf_dir):
    whole = queries.tears(spark, sf_dir)
    one = whole.select("seq_id").first()[0]
    alone = seqops.isolated_tears(seqops.exposure_drops(queries.load_frames(spark, sf_dir).filter(F.col("seq_id") == one), 30.0), 30.0)
    assert sorted(map(tuple, alone.select("frame_idx", "tear").collect())) == sorted(map(tuple, whole.filter(F.col("seq_id") == one).select("frame_idx", "tear").collect()))


def test_frames_are_written_or_discarded(spark, sf_dir):
    rows = queries.state_summary(spark, sf_dir).collect()
    assert rows and all(r.frames == r.written + r.discarded == r.usable + r.clipped + r.uncertain for r in rows)


def test_priority_sample_is_bounded_and_takes_clipped_first(spark, sf_dir):
    d = queries.decided(spark, sf_dir).withColumn("clipped", F.col("tear")).withColumn("problem", F.col("k") % 10 == 3)
    rows = summary.priority_sample(d, 6).collect()
    by_seq = {s: [r for r in rows if r.seq_id == s] for s in {r.seq_id for r in rows}}
    assert by_seq and all(len(x) == len({r.frame_idx for r in x}) <= 6 for x in by_seq.values())
    tears = {s: {r.frame_idx for r in d.filter("tear").collect() if r.seq_id == s} for s in by_seq}
    assert all(len(tears[s] & {r.frame_idx for r in x}) == min(6, len(tears[s])) for s, x in by_seq.items())


@pytest.mark.parametrize(("n", "most"), [(30, 7), (30, 1), (30, 29), (5, 5), (9, 2)])
def test_a_sample_of_usable_frames_is_evenly_spaced(spark, n, most):
    df = seq(spark, content=[0] * n, clipped=[False] * n, problem=[False] * n)
    got = sorted(r.frame_idx for r in summary.priority_sample(df, most).collect())
    assert got == sorted({int(x) for x in np.linspace(0, n - 1, min(most, n), dtype=int)})


@pytest.mark.parametrize("bad", ["abc", "1-", "-3", "3-2", "1-5-9", "6000", "1,,2"])
def test_bad_frame_lists_raise(spark, bad):
    with pytest.raises(Exception, match="bad frame list"):
        parse.frame_list(spark.createDataFrame([(bad,)], "s string"), "s", 2400).collect()


def selected(spark, acts, **columns):
    n = 5
    base = {"content": [1, 0, 1, 2, 1], "centering": [0, 0, 2, 1, 0], "auto_keep": [False, True, False, True, False], "discarded": [False, False, False, False, True]} | columns
    manual = spark.createDataFrame([(1, *a) for a in acts], "seq_id long, frame_idx long, action string")
    return {r.frame_idx: (r.mask, r.origin) for r in policy.selection(seq(spark, **{k: v[:n] for k, v in base.items()}), manual).collect()}


def test_manual_selection(spark):
    assert selected(spark, [(0, "keep"), (1, "drop"), (2, "drop")]) == {0: (True, "manual"), 1: (False, "manual"), 2: (False, "manual"), 3: (True, "auto"), 4: (False, "profile")}
    for frame, action, why in ((1, "keep", "not clipped"), (2, "keep", "without a centre"), (4, "keep", "discarded")):
        with pytest.raises(Exception, match=why):
            selected(spark, [(frame, action)])
    with pytest.raises(Exception, match="both"):
        selected(spark, [(0, "keep"), (0, "drop")])


def test_ranges_hold_for_their_sequences(spark):
    df = seq(spark, x=[0] * 6).unionByName(seq(spark, x=[0] * 6).withColumn("seq_id", F.lit(2).cast("long")))
    ranges = spark.createDataFrame([(1, 2, 3), (1, 3, 9), (3, 0, 9)], "seq_id long, start long, end long")
    assert [(r.seq_id, r.frame_idx) for r in policy.discard_ranges(df, ranges).filter("discarded").orderBy("seq_id", "frame_idx").collect()] == [(1, 2), (1, 3), (1, 4), (1, 5)]
    assert policy.discard_ranges(df, [(4, 4)]).filter("discarded").count() == 2


@pytest.mark.parametrize(("raw", "error"), [
    ("nonsense", "json"), ("[1]", "stream"), ('{"streams":[]}', "stream"), ('{"streams":[{"width":0,"height":2}]}', "width"), ('{"streams":[{"width":"720.5","height":2}]}', "width"), ('{"streams":[{"width":2}]}', "height"),
    ('{"streams":[{"width":2,"height":2,"nb_frames":"0","avg_frame_rate":"30/1","duration":"1"}]}', "frames"), ('{"streams":[{"width":2,"height":2,"nb_frames":"9","avg_frame_rate":"30"}]}', "fps"),
    ('{"streams":[{"width":2,"height":2,"avg_frame_rate":"30/1"}],"format":{"duration":"N/A"}}', "duration"),
])
def test_bad_probes_say_what_is_wrong(spark, raw, error):
    found = spark.createDataFrame([(raw,)], "raw string").select(parse.probe(F.col("raw")).alias("p")).first().p
    assert found.error == error and found.width is None and found.frames is None


def test_options():
    parse.check_options()
    for bad in ({"analysis_width": 159}, {"radius": 0.0}, {"debug_width": 63}, {"max_images": -1}):
        with pytest.raises(ValueError, match="at least|positive|negative"):
            parse.check_options(**bad)
    assert parse.inspect_frames(0, -1, 4, 10) == [0, 3, 6, 9] and parse.inspect_frames(-3, 99, 1, 10) == [0] and parse.inspect_frames(2, 3, 9, 10) == [2, 3]
    with pytest.raises(ValueError, match="before"):
        parse.inspect_frames(5, 3, 4, 10)


def test_counts_that_cannot_be_verified_raise(spark):
    info = spark.createDataFrame([(1, 25.0, 1.0, 25, False)], "seq_id long, fps double, duration double, frames long, exact boolean")
    with pytest.raises(Exception, match="no count"):
        parse.exact_counts(info, spark.createDataFrame([(1, "VFR:x")], "seq_id long, log string")).collect()


def test_radius_needs_circles(spark):
    few = spark.createDataFrame([(1, 80.0, False, 40, 270)] * 3, "seq_id long, radius double, touch boolean, points int, width int")
    assert limb.calibrate_radius(few).count() == 0
    with pytest.raises(Exception, match="no radius"):
        limb.resolve_radius(spark.createDataFrame([(1, None)], "seq_id long, radius double"), few).collect()


def test_limbs_of_the_test_images(spark, sf_dir):
    rows = limb_queries.limb_detections(spark, sf_dir).collect()
    at = {(r.seq_id, r.frame_idx): (r.cx, r.cy, r.id) for r in limb_queries.pictures(spark, sf_dir).collect()}
    assert len(rows) == len(at)
    for r in rows:
        cx, cy, i = at[r.seq_id, r.frame_idx]
        if i % 3:
            assert math.hypot(r.x - cx, r.y - cy) < 1.5


def test_empty_frames(spark, sf_dir):
    none = queries.load_frames(spark, sf_dir).limit(0)
    assert seqops.isolated_tears(seqops.exposure_drops(none, 30.0), 30.0).count() == 0
    assert policy.discard_ranges(none, [(0, 3)]).count() == 0
