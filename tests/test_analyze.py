"""A small sequence of images through the whole analysis and the commands."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest

from framewright.functions import kernels as k
from framewright.plans import analyze

N, R = 14, 30.0


def place(i):
    return 60 + 0.8 * i, 70 - 0.5 * i


def picture(i):
    y, x = np.mgrid[:144, :128]
    cx, cy = place(i)
    sun, moon = (np.clip(R + 0.5 - np.hypot(x - a, y - cy), 0, 1) for a in (cx, cx + 0.8 * R))
    gray = 190 * sun * (1 - moon) + 3 * ((x + 2 * y) % 5)
    if i == 6:
        gray[int(cy) :] = 0  # torn
    return np.rint(k.blurred(gray, 0.6)).astype(np.uint8)


@pytest.fixture(scope="module")
def session(spark, tmp_path_factory):
    rows = [(1, i, 144, 128, bytearray(picture(i).tobytes())) for i in range(N)]
    images = spark.createDataFrame(rows, "seq_id long, frame_idx long, h int, w int, gray binary").repartition(3).cache()
    sequences = spark.createDataFrame([(1, 30.0, 128, 144, None)], "seq_id long, fps double, width int, height int, radius double")
    return analyze.Session(images, sequences, f"file://{tmp_path_factory.mktemp('session')}", [(12, 12)])


def test_the_radius_is_calibrated(session):
    assert abs(analyze.with_radius(session.images, session.sequences).first().radius - R) < 1


def test_analysis_follows_the_disk(session):
    report = analyze.command_analyze(session, debug=True, max_images=5).first()
    assert report.frames == N and report.by_profile == 1 and report.written >= N - 3
    decided = analyze.sinks.current(session.spark, f"{session.folder}/analysis")[0]
    got = {r.frame_idx: r for r in decided.collect()}
    for i, r in got.items():
        if i != 6:
            assert math.dist((r.center_x, r.center_y), place(i)) < 1.5
            assert r.source in (1, 2, 3) and r.content == 0
    assert got[6].tear and not got[6].keep and got[6].exposed < got[5].exposed - 0.08
    assert session.spark.read.parquet(f"{session.folder}/debug/frames").count() <= 5
    files = session.spark.read.option("header", True).csv(f"{session.folder}/tracking.csv")
    assert files.count() == N


def test_cached_scans_give_the_same(session):
    stored = analyze.sinks.current(session.spark, f"{session.folder}/analysis")[0]
    first = {r.frame_idx: (r.content, r.centering, round(r.center_x, 6), r.keep) for r in stored.collect()}
    for state in ("valid", "refreshable"):
        again = {r.frame_idx: (r.content, r.centering, round(r.center_x, 6), r.keep) for r in analyze.analyze(session.images, session.sequences, session.folder, state, session.ranges).collect()}
        assert again == first


def test_preview_and_export_are_centred(session):
    out = analyze.command_export(session).collect()
    assert sorted(r.output_frame for r in out) == list(range(len(out))) and 12 not in {r.frame_idx for r in out}
    for r in out:
        if r.frame_idx != 6:
            found = k.radial_limb(np.frombuffer(r.gray, np.uint8).reshape(r.h, r.w), (r.w / 2, r.h / 2), R, 128 / 270)
            assert math.dist((found["x"], found["y"]), (64, 72)) < 1.5
    report = json.loads(analyze.command_preview(session, width=96).first().report)
    assert report["validated"] >= 8 and report["median"] < 1.5 and len(report["worst"]) <= 10
    assert analyze.command_inspect(session, 4).count() == 4


def test_lost_images_are_an_error(session):
    scanned = analyze.sinks.current(session.spark, f"{session.folder}/scan")[0]
    with pytest.raises(Exception, match="differ at 3"):
        analyze.contrast(scanned.selectExpr("*", "true AS trusted"), session.images.filter("frame_idx <> 3")).collect()
