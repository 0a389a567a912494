"""Tracking and return-state detection against plain loops."""

import math
import random

from paceline.operators import lights as L
from paceline.operators import pose as P
from tests.test_lights import AFTER, BEFORE, change, median, series


def follow(frames, zone):
    c = t = high = None
    out = []
    for time, people in frames:
        pick, why = None, None
        d = lambda p, q: math.hypot(p[0] - q[0], p[1] - q[1])
        if not people:
            why = "nobody"
        elif c is not None:
            lim = min(max(0.12 + (time - t) * 0.45, 0.12), 0.4)
            ok = sorted((d(p, c), p) for p in people if d(p, c) <= lim and p[1] <= high + 0.085)
            if not ok:
                why = "not-plausible"
            elif len(ok) > 1 and ok[1][0] - ok[0][0] < max(0.025, ok[0][0] * 0.35) and ok[0][0] > min(0.06, lim * 0.5):
                why = "two-equally-plausible"
            else:
                pick = ok[0][1]
        else:
            x1, y1, x2, y2 = zone
            inside = [p for p in people if x1 <= p[0] <= x2 and y1 <= p[1] <= y2]
            near = [p for p in people if d(p, ((x1 + x2) / 2, (y1 + y2) / 2)) <= max(0.1, math.hypot(x2 - x1, y2 - y1) * 0.75)]
            if len(inside) == 1:
                pick = inside[0]
            elif len(inside) > 1:
                why = "several-in-zone"
            elif len(near) == 1:
                pick, why = near[0], "near-zone"
            else:
                why = "several-near-zone" if near else "none-in-zone"
        if pick:
            c, t, high = pick, time, pick[1] if high is None else min(high, pick[1])
        out.append((time, pick, why))
    return out


def test_track_athlete(spark):
    r = random.Random(2)
    zone = (0.3, 0.6, 0.7, 0.95)
    runs = {}
    for a in range(6):
        fs, x, y = [], 0.5, 0.9
        for i in range(120):
            x, y = min(max(x + r.uniform(-0.05, 0.05), 0.0), 1.0), max(y - r.uniform(-0.03, 0.04), 0.0)
            people = [(x, y)] if r.random() > 0.1 else []
            if r.random() < 0.4:
                people.append((min(max(x + r.uniform(-0.2, 0.2), 0.0), 1.0), min(max(y + r.uniform(-0.1, 0.3), 0.0), 1.0)))
            if r.random() < 0.1:  # two people about equally far from where the athlete was
                people = [(max(x - 0.09, 0.0), y), (min(x + 0.09, 1.0), y)]
            fs.append((round(i * 0.1, 3), people))
        runs[a] = fs
    df = spark.createDataFrame([(a, t, p, zone) for a, fs in runs.items() for t, p in fs], "attempt_id long, raw_time double, people array<struct<x:double,y:double>>, zone struct<x1:double,y1:double,x2:double,y2:double>")
    got = {(q.attempt_id, q.raw_time): ((q.x, q.y) if q.x is not None else None, q.reason) for q in P.track_athlete(df).collect()}
    reasons = set()
    for a, fs in runs.items():
        for t, pick, why in follow(fs, zone):
            assert got[(a, t)] == (pick, why)
            reasons.add(why)
    assert {"nobody", "not-plausible", "two-equally-plausible"} <= reasons


def opp(c):
    return (c[1] - c[2]) / max(1.0, sum(c)) * 180


def returns(pts):
    """All candidates (onset, strict) of one scan, as loops."""
    ts, cs = [t for t, _ in pts], [c for _, c in pts]
    n = len(pts)
    lum = lambda c: c[0] * 0.2126 + c[1] * 0.7152 + c[2] * 0.0722
    chroma, red = (lambda c: max(c) - min(c)), (lambda c: c[0] / max(1.0, sum(c)))
    k = min(12, max(3, int(n * 0.2)))
    ob, oa = opp(BEFORE), opp(AFTER)
    span = abs(ob - oa)
    base = median([opp(c) for c in cs[:k]])
    mad = median([abs(opp(c) - base) for c in cs[:k]])
    after = abs(base - oa) <= abs(base - ob)
    target, source = (ob, oa) if after else (oa, ob)
    learned = max(span, abs(target - base))
    thr = max(1.2, learned * 0.12, mad * 4 + 0.8)
    conf, ons = max(thr * 1.35, learned * 0.22), max(0.55, learned * 0.035, mad * 3 + 0.3)
    proj = [(1 if target >= source else -1) * (opp(c) - base) for c in cs]
    step = median([max(1 / 120, b - a) for a, b in zip(ts, ts[1:])])
    bl, mc = median([lum(c) for c in cs[:k]]), max(2.5, min(median([chroma(c) for c in cs[:k]]), chroma(BEFORE), chroma(AFTER)) * 0.15)
    mr = max(red(BEFORE), red(AFTER), median([red(c) for c in cs[:k]])) + 0.12
    ok = [0.55 <= lum(c) / max(1, bl) <= 2.4 and chroma(c) >= mc and red(c) <= mr for c in cs]
    toward = [abs(opp(c) - source) - abs(opp(c) - target) >= max(0.5, span * 0.03) and o for c, o in zip(cs, ok)]
    calm = max(ons, thr * 0.75)
    reach = step * 2.25 if step >= 0.075 else max(0.1, step * 3.25)
    out = []
    for i in range(2, n - 1):
        run, quiet, j = 0, False, i - 1
        while j >= 0 and ts[j] >= ts[i] - 0.5:
            run = run + 1 if proj[j] < calm else 0
            if run >= 2:
                quiet = True
                break
            j -= 1
        if not quiet or proj[i] < thr or not ok[i] or not (toward[i] or (proj[i + 1] >= ons and ok[i + 1])):
            continue
        end = None
        for e in range(i + 1, n):
            if ts[e] > ts[i] + 1.15:
                break
            s = e
            while s > i and ts[s - 1] >= ts[e] - 0.48:
                s -= 1
            if ts[e] - ts[s] + step < 0.32:
                continue
            good = sum(1 for q in range(s, e + 1) if proj[q] >= thr and toward[q] and ok[q])
            if good >= max(2, math.ceil((e - s + 1) * (0.6 if step >= 0.15 else 0.62))) and max(proj[s:e + 1]) >= conf:
                end = e
                break
        if end is None or sum(1 for q in range(i, end + 1) if proj[q] >= thr and toward[q] and ok[q]) < 2:
            continue
        last, joined = ts[i], True
        for q in range(i + 1, end + 1):
            if proj[q] >= ons and ok[q]:
                joined = joined and ts[q] - last <= reach + 1e-9
                last = ts[q]
        if not joined or ts[end] - last > reach + 1e-9:
            continue
        o = i
        if step <= 0.075:
            cnt, miss, q = 1, 0, i - 1
            while q >= 0 and ts[q] >= ts[i] - 0.42:
                if proj[q] >= ons and ok[q]:
                    o, cnt, miss = q, cnt + 1, 0
                else:
                    miss += 1
                    if miss > 1:
                        break
                q -= 1
            if o == i or o < 2 or cnt < 3 or not all(v < ons for v in proj[o - 2:o]):
                o = i
        out.append((ts[o], ts[i]))
    return sorted(out)


def test_return_state_matches_the_loop(spark):
    r = random.Random(6)
    runs = {}
    for s in range(24):
        pts = change(s, 2.5 + s / 15, step=[0.033, 0.06, 0.2][s % 3], fade=[0.1, 0.4, 0.7][s % 3], back=s % 2 == 0)
        for _ in range(4):
            k = r.randrange(len(pts))
            pts[k] = (pts[k][0], r.choice([BEFORE, AFTER, (120.0, 118.0, 119.0), (220.0, 90.0, 60.0)]))
        runs[s] = pts
    got = {}
    for q in L.return_state(series(spark, runs)).collect():
        got.setdefault(q.attempt_id, []).append((q.onset_s, q.strict_s))
    want = {s: returns(p) for s, p in runs.items() if returns(p)}
    assert {k: sorted(v) for k, v in got.items()} == want
    assert any(a < b for v in want.values() for a, b in v) and len(want) > 15
