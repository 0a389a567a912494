import math
import random

import pytest
from pyspark.sql import functions as F

from paceline.operators import pose as P
from paceline.operators import trajectory as T

FRAME = ("attempt_id long, raw_time double, decoded_time double, frame_duration_s double, valid boolean, pose_selected boolean, pose_detected boolean, candidate_count int, "
         "mass_coverage double, wall_x double, wall_y double")


def frame(t, y, x=1.5, decoded=None, valid=True, a=1):
    return (a, t, decoded, None, valid, True, True, 1, 0.95, x, y)


def kin_rows(ts, ys):
    """Fitted rows as ``route_progress`` expects them."""
    return [(1, t, t, True, y, False, False, False, False, False) for t, y in zip(ts, ys)]


KIN = "attempt_id long, raw_time double, sample_time double, valid boolean, fit_y double, extrapolated boolean, raw_jump boolean, fit_jump boolean, repeated boolean, late boolean"


def test_constant_pace_crossings(spark):
    ts = [10 + i / 10 for i in range(101)]
    df = spark.createDataFrame(kin_rows(ts, [1.5 * (t - 10) for t in ts]), KIN)
    c = {r.boundary: r for r in T.crossings(T.progress_pairs(T.route_progress(df))).collect()}
    assert c["third"].crossing_s == pytest.approx(13.3333, abs=1e-3)
    assert c["half"].crossing_s == pytest.approx(15.0, abs=1e-6)
    assert c["two_thirds"].crossing_s == pytest.approx(16.6667, abs=1e-3)


def test_source_time_wins(spark):
    rows = [(1, 0.04, 0.0, True, 4.0, False, False, False, False, False), (1, 0.24, 0.2, True, 6.0, False, False, False, False, False)]
    c = {r.boundary: r for r in T.crossings(T.progress_pairs(T.route_progress(spark.createDataFrame(rows, KIN)))).collect()}
    assert c["third"].crossing_s == pytest.approx(0.1)


def test_rejected_jump_blocks_interpolation(spark):
    rows = [(1, 0.0, 0.0, True, 4.0, False, False, False, False, False), (1, 0.1, 0.1, True, 12.0, False, True, False, False, False), (1, 0.2, 0.2, True, 6.0, False, False, False, False, False)]
    c = {r.boundary: r.state for r in T.crossings(T.progress_pairs(T.route_progress(spark.createDataFrame(rows, KIN)))).collect()}
    assert c["third"] == "inside-gap"


def sequential_chunks(rows):
    """The rule as a loop: a rejected jump empties the chunk."""
    chunk, k, out = None, 0, {}
    for t, x, y, valid in rows:
        if not valid:
            continue
        if not (0 <= x <= 3 and 0 <= y <= 15):
            chunk = None
            continue
        if chunk is not None:
            dt = t - chunk[0]
            if dt > 0.25:
                chunk = None
            elif math.hypot(x - chunk[1], y - chunk[2]) / dt > 5.5:
                out[t] = (True, None)
                chunk = None
                continue
        if chunk is None:
            k += 1
        chunk = (t, x, y)
        out[t] = (False, k)
    return out


def test_chunks_match_the_sequential_rule(spark):
    r = random.Random(5)
    rows, t = [], 0.0
    for _ in range(600):
        t = round(t + r.choice([0.05, 0.1, 0.1, 0.2, 0.3]), 3)
        rows.append((t, r.choice([1.5, 1.5, 1.6, 1.4, -0.5]), r.choice([5.0, 5.1, 5.2, 5.2, 9.0, 9.1]), r.random() > 0.05))
    df = spark.createDataFrame([frame(t, y, x, valid=v) for t, x, y, v in rows], FRAME)
    got = {q.raw_time: (q.raw_jump, q.chunk_id) for q in T.chunk_frames(T.flag_frames(T.merge_cursor_times(df))).collect() if q.raw_jump or q.chunk_id}
    assert got == sequential_chunks(rows)
    assert any(j for j, _ in got.values())


def test_time_shift_changes_nothing_but_time(spark):
    r = random.Random(9)
    rows = [(round(i * 0.11, 3), 0.4 * i * 0.11 + r.random() * 0.05) for i in range(80)]
    base = T.metrics(T.kinematics(spark.createDataFrame([frame(t, y) for t, y in rows], FRAME))).first()
    moved = T.metrics(T.kinematics(spark.createDataFrame([frame(t + 7, y) for t, y in reversed(rows)], FRAME))).first()
    for c in ("path_length", "average_speed", "valid_coverage", "quality"):
        assert getattr(base, c) == getattr(moved, c) or abs(getattr(base, c) - getattr(moved, c)) < 2e-5


def test_symmetric_pose(spark):
    names = P.JOINTS
    pts = []
    for n, i in names.items():
        x = 0.5 if n == "head" else (0.4 if n.startswith("left") else 0.6)
        pts.append((i, x, 0.1 + i / 50, 0.0, 0.9))
    df = spark.createDataFrame([(1, 1, pts, [3.0, 0.0, 0.0, 0.0, -15.0, 15.0, 0.0, 0.0, 1.0])], "attempt_id long, frame_id long, landmarks array<struct<idx:int,x:double,y:double,z:double,visibility:double>>, h array<double>")
    img, wall = P.centre_of_mass(df).first(), P.centre_of_mass(df, h="h").first()
    assert img.com_x == pytest.approx(0.5) and wall.com_x == pytest.approx(1.5) and img.mass_coverage == pytest.approx(1.0)


def test_smoothing_is_bounded(spark):
    with pytest.raises(ValueError):
        T.fit_chunks(spark.range(1), 0.5)
