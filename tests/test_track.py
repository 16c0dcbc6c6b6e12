"""Trackers on scenarios and against a plain loop, their stream, the whole decision, sinks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from framewright.operators import policy, track
from framewright.params import TEAR_REASONS, Params
from framewright.plans import decide, queries
from framewright.sources import sinks
from framewright.streaming import track as stream

P, SIZE = Params(), (270.0, 360.0)
GOOD = {"rel_x": 0.0, "rel_y": 0.0, "response": 0.5, "points": 100, "coverage": 200.0, "residual": 0.5, "touch": False}


def seen(x, y, **more):
    return GOOD | {"radial_x": x, "radial_y": y} | more


def test_geometry_prefers_the_edge_and_keeps_state_without_one():
    g = track.Geometry(P, SIZE)
    assert g.step(GOOD | {"radial_x": None, "radial_y": None}) == (135.0, 180.0, None, None, 0, None)
    assert g.last is None  # the middle of the image is no anchor
    assert g.step(seen(136.0, 180.0))[2:] == (136.0, 180.0, 1, 1.0)
    assert g.step(seen(139.0, 180.0, contour_x=145.0, contour_y=180.0))[4] == 2
    assert g.step(seen(180.0, 180.0))[4] == 0  # too far from where it was foretold
    assert g.last == (139.0, 180.0)
    assert g.step(seen(139.0, 180.0, points=34))[4] == g.step(seen(139.0, 180.0, coverage=119.0))[4] == g.step(seen(139.0, 180.0, residual=4.6))[4] == 0


def test_geometry_takes_a_contour_that_moves_with_the_frame():
    jump = {"rel_x": 50.0, "rel_y": 0.0, "contour_x": 186.0, "contour_y": 180.0}
    g = track.Geometry(P, SIZE)
    g.step(seen(136.0, 180.0))
    # so wide a motion isn't added to the foretold place, but bears the contour out
    assert g.step(seen(186.0, 180.0, **jump)) == (136.0, 180.0, 186.0, 180.0, 3, 50.0)
    for more in ({"touch": True}, {"response": 0.05}, {"points": 10}):
        g.load({"last": [136.0, 180.0]})
        assert g.step(seen(186.0, 180.0, **(jump | more)))[4] == 0


def anchored(n=8, fps=30.0):
    c = track.Contrast(Params(fps=fps), SIZE)
    assert c.step(GOOD | {"spot_x": 50.0, "spot_y": 60.0, "spot_score": 0.5})[:2] == (None, None)  # nothing to start from
    for i in range(n):
        c.step(GOOD | {"place_x": 100.0 + i, "place_y": 100.0, "trusted": True, "spot_x": 90.0 + i, "spot_y": 100.0, "spot_score": 0.5})
    return c


def test_contrast_learns_the_offset_and_caps_corrections():
    c = anchored()
    assert c.offset() == (10.0, 0.0) and c.limit == 2.5
    x, y, score, *rest = c.step(GOOD | {"rel_x": 1.0, "spot_x": 98.0, "spot_y": 100.0, "spot_score": 0.5})
    assert (x, y, score) == (108.0, 100.0, 0.5) and rest[-4:] == [False, True, 0.0, 1]
    far = c.step(GOOD | {"spot_x": 200.0, "spot_y": 100.0, "spot_score": 1.0})
    assert far[0] == pytest.approx(108.0 + 0.9 * 2.5) and far[-2] == 2.5
    veto = c.step(GOOD | {"place_x": 10.0, "place_y": 10.0, "trusted": False, "spot_x": None, "spot_y": None})
    assert veto[0] == far[0] and veto[2] == 0.0
    again = anchored(100)
    assert len(again.offsets) == 60
    assert len(anchored(100, 1.0).offsets) == 6


def test_contrast_stays_near_the_image():
    c = anchored()
    for _ in range(40):
        x = c.step(GOOD | {"rel_x": 30.0})[0]
    assert x == 270.0 + 0.25 * 80


def moving(seed=3, seqs=5, n=40):
    rng = random.Random(seed)
    out = []
    for s in [*range(seqs), None]:
        for i in range(n):
            hit = rng.random() < 0.7
            base, y = 100 + 0.5 * i, 180 + rng.random()
            x = base + rng.choice([0, 0, 0, 14])
            near = rng.random() < 0.6
            out.append((s, i, 0.5, 0.0, rng.choice([0.05, 0.5, None]), x if hit else None, y if hit else None, rng.randint(20, 90), 200.0, rng.choice([0.5, 9.0]), base + rng.choice([1, 6]) if near else None, y if near else None, rng.random() < 0.1))
    return out


COLUMNS = "rel_x double, rel_y double, response double, radial_x double, radial_y double, points long, coverage double, residual double, contour_x double, contour_y double, touch boolean"


@pytest.fixture(scope="module")
def frames(spark):
    rows = moving()
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, f"seq_id long, frame_idx long, {COLUMNS}").repartition(3).cache()


def by_loop(rows):
    want = {}
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    for s in {r[0] for r in rows}:
        g = track.Geometry(P, SIZE)
        for r in sorted((r for r in rows if r[0] == s), key=lambda r: r[1]):
            want[s, r[1]] = g.step(dict(zip(names, r[2:], strict=True)))
    return want


def test_fold_is_the_loop_over_each_sequence(frames):
    want = by_loop(moving())
    added = [n for n, _ in track.Geometry.ADDED]
    got = {(r.seq_id, r.frame_idx): tuple(r[c] for c in added) for r in track.geometry_track(frames, P, SIZE).collect()}
    assert got == want and {v[4] for v in got.values()} >= {0, 1, 2, 3}
    assert track.geometry_track(frames.limit(0), P, SIZE).count() == 0


def test_stream_gives_the_same_whatever_the_order(spark, frames, tmp_path):
    rows = [r for r in moving() if r[0] is not None]
    want = {k: v for k, v in by_loop(rows).items()}
    random.Random(4).shuffle(rows)
    for i in range(4):  # a frame of the first file comes again in the last
        part = rows[i::4] + (rows[:1] if i == 3 else [])
        spark.createDataFrame(part, frames.schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    source = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
    made = stream.geometry_stream(source, P, SIZE, 256).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    assert made.awaitTermination(180)
    added = [n for n, _ in track.Geometry.ADDED]
    got = [((r.seq_id, r.frame_idx), tuple(r[c] for c in added)) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert len(got) == len(want) and dict(got) == want
    assert spark.read.parquet(f"{tmp_path}/out").filter("late").count() == 0


def test_late_frames_are_rows_of_their_own(spark, frames, tmp_path):
    rows = sorted((r for r in moving() if r[0] == moving()[0][0]), key=lambda r: r[1])[:8]
    order = [rows[0], rows[3], rows[4], rows[5], rows[1], rows[4], rows[6], rows[1]]  # 1 and 2 are lost, 1 comes late and then again
    for i, row in enumerate(order):
        spark.createDataFrame([row], frames.schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    source = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
    made = stream.geometry_stream(source, P, SIZE, 2).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    assert made.awaitTermination(180)
    out = sorted((r.frame_idx, r.late) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert out == [(0, False), (1, True), (3, False), (4, False), (5, False), (6, False)]
    gaps = [[2, 5], [7, 8]]
    assert [stream.taken_out(gaps, i) for i in (3, 3, 7, 9)] == [True, False, True, False] and gaps == [[2, 3], [4, 5]]


def test_lost_frames_don_t_block_a_stream():
    held = {i: [i] for i in (1, 2, 4)}
    assert [i for i, _ in stream.in_order(dict(held), 1, 3)] == [1, 2]
    assert [i for i, _ in stream.in_order(dict(held), 0, 2)] == [1, 2]
    assert [i for i, _ in stream.in_order(dict(held), 0, 3)] == []


def decided(spark, n=120, tear=(), border=(), lost=()):
    rows = []
    for i in range(n):
        gone = i in lost
        rows.append((1, i, None if gone else 100 + 0.1 * i, None if gone else 180.0, 0.1 if i else 0.0, 0.0, 0.5, 0 if gone else 1, False, 1 if i in border else 0, 5.0 if gone else 300.0, None if gone else 0.5, 5 if gone else 200, 0.0 if gone else 0.9, 200, None, None, 0.0, False, not gone, 0.6 if i in tear else 0.95))
    f = spark.createDataFrame(rows, "seq_id long, frame_idx long, raw_x double, raw_y double, rel_x double, rel_y double, response double, source int, touch boolean, clip_edges int, coverage double, residual double, points long, quality double, maximum int, contrast_x double, contrast_y double, contrast_score double, supported boolean, evaluable boolean, exposed double")
    out = decide.decide(policy.discard_ranges(f, [(100, 101)]), P, SIZE)
    return {r.frame_idx: r for r in out.collect()}


def test_decision(spark):
    got = decided(spark, tear=(30,), border=(50, 51), lost=(70, 71, 72))
    assert len(got) == 120
    assert got[30].tear_verdict == TEAR_REASONS["confirmed"] and got[30].content_reason == "pérdida temporal de fotosfera confirmada (36.8%)" and got[30].content == 1 and not got[30].keep
    assert got[50].content_reason == "recorte real en left (acuerdo 0%)" and got[50].tear_verdict == TEAR_REASONS["border"] and not got[50].trusted and not got[50].auto_keep
    assert got[71].content == 2 and got[71].centering == 1 and got[71].keep  # bridged between anchors
    assert got[71].center_x == pytest.approx(107.1, abs=0.05) and got[71].regime == 1
    assert sorted(i for i, r in got.items() if not r.keep) == [30, 50, 51, 100, 101]
    assert got[100].auto_keep and got[100].discarded
    assert got[10].margin == pytest.approx(101 - 80, abs=0.05) and not got[10].cut
    assert all(r.trusted and r.content == 0 and r.centering == 0 for i, r in got.items() if i not in (30, 50, 51, 70, 71, 72))


def test_nothing_seen_is_not_kept(spark):
    got = decided(spark, 40, lost=range(40))
    assert not any(r.keep for r in got.values()) and all(r.centering == 2 and r.center_x is None for r in got.values())


def test_trusted_geometry_leaves_out_single_outliers(spark):
    rows = [(1, i, 100.0 + (9.0 if i == 5 else 0.0), 180.0, 0.0, 0.0, i != 8, 12) for i in range(16)]
    f = spark.createDataFrame(rows, "seq_id long, frame_idx long, raw_x double, raw_y double, rel_x double, rel_y double, evidence boolean, horizon_start long")
    got = {r.frame_idx: (r.trusted, r.rejected) for r in decide.trusted_geometry(f).collect()}
    assert [i for i in got if got[i][1]] == [5]
    assert sorted(i for i in got if got[i][0]) == [0, 1, 2, 3, 4, 6, 7, 9, 10, 11]


@pytest.mark.parametrize("name", ["trusted_geometry", "contrast_track"])
def test_queries_keep_every_frame(spark, sf_dir, name):
    rows = queries.QUERIES[name](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert len({(r.seq_id, r.frame_idx) for r in rows}) == len(rows)


def test_csv_has_the_columns_in_order(spark, sf_dir, tmp_path):
    manual = spark.createDataFrame([(1, 3, "drop")], "seq_id long, frame_idx long, action string")
    table = sinks.debug_table(policy.selection(queries.decisions_of(spark, sf_dir), manual))
    assert table.columns == ["seq_id", *sinks.DEBUG] and len(sinks.TRACKING) == 81 and len(sinks.DEBUG) == 56
    sinks.write_csv(table, f"{tmp_path}/debug")
    back = spark.read.option("header", True).csv(f"{tmp_path}/debug")
    assert back.count() == table.count() and set(back.columns) == set(table.columns)


def test_versions_are_published_whole(spark, tmp_path):
    folder = f"file://{tmp_path}/cache"
    assert sinks.current(spark, folder) is None
    sinks.publish(spark.range(3), folder, {"fps": 30})
    sinks.publish(spark.range(5), folder, {"fps": 25})
    table, facts = sinks.current(spark, folder)
    assert table.count() == 5 and facts == {"fps": 25}
    with pytest.raises(Exception):
        sinks.publish(spark.range(2).select(F.raise_error(F.lit("no")).alias("x")), folder)
    assert sinks.current(spark, folder)[0].count() == 5
    left = [p.name for p in (tmp_path / "cache").iterdir() if not p.name.startswith(".")]
    assert sorted(n.split("-")[0] for n in left) == ["current", "v", "v"]
