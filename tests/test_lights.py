"""Light rules against plain loops on fixtures and on noise."""

import math
import random

from paceline.operators import lights as L

BEFORE, AFTER = (70.0, 190.0, 80.0), (70.0, 90.0, 200.0)
SCHEMA = "attempt_id long, raw_time double, rgb struct<r:double,g:double,b:double>, before struct<r:double,g:double,b:double>, after struct<r:double,g:double,b:double>, colour_delta double"


def series(spark, runs):
    rows = [(a, t, rgb, BEFORE, AFTER, 156.205) for a, pts in runs.items() for t, rgb in pts]
    return spark.createDataFrame(rows, SCHEMA)


def mix(f, r):
    return tuple(b + (a - b) * f + r.uniform(-2, 2) for b, a in zip(BEFORE, AFTER))


def change(seed, at, step=0.033, seconds=6.0, fade=0.1, back=False):
    r = random.Random(seed)
    out = []
    for i in range(int(seconds / step)):
        t = round(i * step, 3)
        f = min(max((t - at) / fade, 0.0), 1.0)
        out.append((t, mix(1 - f if back else f, r)))
    return out


def test_finish_returns_to_the_other_state(spark):
    runs = {s: change(s, 3.0 + s / 10, back=True) for s in range(8)}
    got = {r.attempt_id: r for r in L.first_return(L.return_state(series(spark, runs))).collect()}
    assert len(got) == 8
    for s, r in got.items():
        assert abs(r.finish_s - (3.0 + s / 10)) <= 0.1 and r.confidence == "High"


def test_noise_never_finishes(spark):
    runs = {s: change(s, 99.0, back=True) for s in range(40)}
    assert L.first_return(L.return_state(series(spark, runs))).count() == 0


def test_a_flash_is_no_finish(spark):
    r = random.Random(1)
    pts = [(round(i * 0.033, 3), mix(0.0 if 90 <= i < 93 else 1.0, r)) for i in range(180)]
    assert L.first_return(L.return_state(series(spark, {1: pts}))).count() == 0


def dist(a, b):
    return math.floor(math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b))) * 1000 + 0.5) / 1000


def median(xs):
    xs = sorted(xs)
    n = len(xs)
    return xs[n // 2] if n % 2 else (xs[n // 2 - 1] + xs[n // 2]) / 2


def departure(pts, need, delta=156.205):
    """The departure rule as loops."""
    db, da = [dist(c, BEFORE) for _, c in pts], [dist(c, AFTER) for _, c in pts]
    blue = [x - y >= max(0.35, delta * 0.06) and y <= delta * 0.72 for x, y in zip(db, da)]
    i = 0
    while i < len(pts):
        if not blue[i]:
            i += 1
            continue
        n = 0
        while i + n < len(pts) and blue[i + n]:
            n += 1
        like = [x for x, y in zip(db[:i], da[:i]) if x <= y]
        if n >= need and len(like) >= 2:
            pool = sorted(like)[:max(2, math.ceil(len(like) * 0.3))]
            base = median(pool)
            thr = max(0.65, delta * 0.035, base + max(0.45, median([abs(v - base) for v in pool]) * 4))
            gone = [x >= thr for x in db]
            for k in range(2, i + 1):
                calm = all(not gone[j] and db[j] <= da[j] for j in (k - 2, k - 1))
                ahead = gone[k:min(i + 1, k + 3)]
                if not calm or not gone[k] or sum(ahead) < min(2, len(ahead)):
                    continue
                miss = worst = 0
                for j in range(k, i + 1):
                    miss = 0 if gone[j] else miss + 1
                    worst = max(worst, miss)
                if worst <= 1:
                    return pts[k][0], pts[i][0], n
        i += n
    return None


def test_departure_matches_the_loop(spark):
    runs = {}
    for s in range(30):
        pts = change(s, 2.0 + s / 20, fade=0.3 + (s % 3) * 0.2)
        if s % 4 == 0:  # an early glitch and a gap inside the fade
            pts[20] = (pts[20][0], AFTER)
        runs[s] = pts
    got = {r.attempt_id: (r.onset_s, r.confirmed_s, r.confirmation_frames) for r in L.verified_departure(series(spark, runs), 3).collect()}
    want = {s: departure(p, 3) for s, p in runs.items() if departure(p, 3)}
    assert got == want and len(want) > 20


PATCH = "recording_id long, x int, y int, radius int, t double, rgb struct<r:double,g:double,b:double>, frame_rgb struct<r:double,g:double,b:double>"


BLUE = (70.0, 120.0, 200.0)  # bright enough to be the same lamp


def lamp(f, r):
    return tuple(b + (a - b) * f + r.uniform(-2, 2) for b, a in zip(BEFORE, BLUE))


def scan(rec, seed, at, x=10, y=20, drift=False, flash=False, flip=False):
    """A patch at 5 fps; with drift the whole frame turns with it."""
    r = random.Random(seed)
    rows = []
    for i in range(50):
        t = i * 0.2
        f = 1.0 if t >= at else 0.0
        if flash:
            f = 1.0 if at <= t < at + 0.3 else 0.0
        c = lamp(1 - f if flip else f, r)
        rows.append((rec, x, y, 1, t, c, c if drift else (110.0, 110.0, 110.0)))
    return rows


def test_patch_discovery(spark):
    rows = []
    for s in range(6):
        rows += scan(s, s, 4.0 + s * 0.2)
    rows += scan(10, 1, 4.0, drift=True) + scan(11, 2, 99.0) + scan(12, 3, 4.0, flash=True) + scan(13, 4, 4.0, flip=True)
    rows += scan(14, 5, 4.0) + scan(14, 6, 4.0, x=12) + scan(14, 7, 6.0, x=30)
    found = L.patch_transitions(spark.createDataFrame(rows, PATCH), 40, 24)
    got = {}
    for q in L.separate_patches(found, 40, 24).collect():
        got.setdefault(q.recording_id, []).append(q)
    assert set(got) == {0, 1, 2, 3, 4, 5, 14}
    for s in range(6):
        assert abs(got[s][0].onset_s - (4.0 + s * 0.2)) < 1e-6 and got[s][0].confidence == "High"
    assert sorted(q.x > 20 for q in got[14]) == [False, True]
