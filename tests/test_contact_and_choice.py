"""Hand approach, hand points and the choice of a movement, against plain loops."""

import math
import random

from pyspark.sql import functions as F

from paceline.operators import contact as C
from paceline.operators import series as S

LM = "array<struct<idx:int,x:double,y:double,z:double,visibility:double>>"
PAD = (0.48, 0.18, 0.52, 0.22)


def med(xs):
    xs = sorted(xs)
    n = len(xs)
    return xs[n // 2] if n % 2 else (xs[n // 2 - 1] + xs[n // 2]) / 2


def approach(frames):
    cx, cy, rx, ry = 0.5, 0.2, 0.028, 0.028
    for hand, idx in (("left", [15, 17, 19, 21]), ("right", [16, 18, 20, 22])):
        pts = []
        for t, lm in frames:
            at = {p[0]: p for p in lm if p[4] >= 0.35 and 0 <= p[1] <= 1 and 0 <= p[2] <= 1}
            torso = [at[i] for i in (11, 12, 23, 24) if i in at]
            fingers = [at[i] for i in idx[1:] if i in at]
            hs = fingers if len(fingers) >= 2 else [at[idx[0]]] if idx[0] in at else []
            if len(torso) < 3 or not hs:
                pts.append(None)
                continue
            tx, ty = med([p[1] for p in torso]), med([p[2] for p in torso])
            span = max(p[2] for p in torso) - min(p[2] for p in torso)
            if abs(tx - cx) > 0.1 or not cy - 0.01 <= ty <= cy + 0.2 or not 0.008 <= span <= 0.16:
                pts.append(None)
                continue
            x, y = med([p[1] for p in hs]), med([p[2] for p in hs])
            pts.append((t, x, y, tx, ty, math.hypot((x - cx) / rx, (y - cy) / ry)))
        for i in range(1, len(pts) - 1):
            p, q = pts[i], pts[i + 1]
            if not p or not q or p[5] > 1.15 or q[5] > 1.4 or q[0] - p[0] > 0.15:
                continue
            before = [b for b in pts[:i] if b and p[0] - b[0] <= 0.8]
            if len(before) < 3 or p[0] - before[0][0] < 0.18 or not any(b[5] >= 2 and b[2] > p[2] + 0.018 for b in before):
                continue
            seq = [*before, p, q]
            if any(b[0] - a[0] > 0.2 or math.hypot(b[3] - a[3], b[4] - a[4]) > 0.055 or math.hypot(b[1] - a[1], b[2] - a[2]) > 0.08 for a, b in zip(seq, seq[1:])):
                continue
            return p[0], hand, len(seq)
    return None


def test_pad_approach(spark):
    runs = {}
    for a in range(40):
        r = random.Random(a)
        frames, t = [], 0.0
        for i in range(40):
            t = round(t + r.choice([0.071, 0.083, 0.097, 0.113, 0.113 if r.random() < 0.9 else 0.241]), 3)
            k = max(0.0, min(1.0, (i - 15) / r.choice([6, 8, 9])))
            hy = 0.30 - 0.1 * k + r.uniform(-0.004, 0.004)
            side = [17, 19, 21] if a % 3 else [18, 20, 22]
            lm = [(11, 0.48, 0.26, 0.0, 0.9), (12, 0.52, 0.26, 0.0, 0.9 if r.random() > 0.1 else 0.1), (23, 0.48, 0.32, 0.0, 0.9), (24, 0.52, 0.32, 0.0, 0.9)] + [(j, 0.5 + r.uniform(-0.01, 0.01), hy, 0.0, 0.9 if r.random() > 0.15 else 0.2) for j in side]
            frames.append((t, lm))
        runs[a] = frames
    df = spark.createDataFrame([(a, t, lm) for a, fs in runs.items() for t, lm in fs], f"attempt_id long, raw_time double, landmarks {LM}")
    got = {q.attempt_id: (q.raw_time, q.hand, q.support_frames) for q in C.pad_approach(df, PAD).collect()}
    want = {a: approach(fs) for a, fs in runs.items() if approach(fs)}
    assert got == want and {h for _, h, _ in want.values()} == {"left", "right"}


def hand_point(lm, idx, low):
    at = {p[0]: p for p in lm if p[4] >= low}
    wrist = at.get(idx[0])
    f = [at[i] for i in idx[1:] if i in at]
    d = lambda p, x, y: math.hypot(p[1] - x, p[2] - y)
    if len(f) >= 2:
        x, y = med([p[1] for p in f]), med([p[2] for p in f])
        inn = [p for p in f if d(p, x, y) <= 0.42]
        if len(inn) >= 2:
            x, y = med([p[1] for p in inn]), med([p[2] for p in inn])
            if not wrist or d(wrist, x, y) <= 0.75:
                return x, y, "fingers"
    if len(f) == 1 and f[0][4] >= max(0.5, low) and ((wrist and d(wrist, f[0][1], f[0][2]) <= 0.72) or (not wrist and f[0][4] >= 0.7)):
        return f[0][1], f[0][2], "fingers"
    return (wrist[1], wrist[2], "wrist") if wrist else None


def test_hand_points(spark):
    r = random.Random(12)
    rows = [(1, k, [(i, r.uniform(0, 1.5), r.uniform(0, 1.5), 0.0, r.random()) for i in range(15, 23)], [1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0]) for k in range(300)]
    rows = [(a, k, lm, [float(v) for v in h]) for a, k, lm, h in rows]
    df = spark.createDataFrame(rows, f"attempt_id long, frame_id long, landmarks {LM}, h array<double>")
    got = {(q.frame_id, q.hand): (q.x, q.y, q.point_source) for q in C.hand_points(df, 0.25).collect()}
    for _, k, lm, _ in rows:
        for hand, idx in (("left", [15, 17, 19, 21]), ("right", [16, 18, 20, 22])):
            w = hand_point(lm, idx, 0.25)
            g = got.get((k, hand))
            assert (g is None) == (w is None)
            assert w is None or (abs(g[0] - w[0]) < 1e-12 and abs(g[1] - w[1]) < 1e-12 and g[2] == w[2])


def choice(cands, need=2):
    score = lambda c: (100000 if c["edge"] else 0) + c["climb"] * 100 - min(c["p"], need) * 18 - min(c["score"] / c["thr"], 2) * 8
    ranked = sorted(cands, key=lambda c: (score(c), c["ins"]))
    for c in ranked:
        if c["kind"] in ("Earliest Visible Motion", "Possible preload / weight shift") and c["climb"] >= 0 and c["conf"] != "Low" and not c["sus"]:
            return ranked, c
    for c in ranked:
        if "Committed Launch" in c["kind"] and c["score"] >= c["thr2"]:
            return ranked, c
    ok = [c for c in ranked if not c["edge"] and c["climb"] >= 0 and (not c["sus"] or c["score"] >= c["thr"] * 2.5) and c["score"] >= c["thr"] and c["p"] >= need]
    return ranked, (ok[0] if ok else None)


def test_movement_choice_and_presentation(spark):
    rows, want = [], {}
    kinds = ["Earliest Visible Motion", "Possible preload / weight shift", "Committed Launch", "First threshold crossing", "First threshold crossing + Committed Launch", "Largest Early Motion Spike"]
    for a in range(60):
        r = random.Random(a)
        cs = [{"ins": i, "kind": r.choice(kinds[a % 3:]), "climb": round(r.uniform(-0.2, 2), 3), "score": round(r.uniform(0.5, 4), 3), "thr": 1.5, "thr2": 2.7, "conf": r.choice(["Low", "Medium", "High"]) if a % 2 else "Low", "edge": r.random() < 0.2, "sus": r.random() < 0.4, "p": r.randrange(5)} for i in range(r.choice([3, 9, 14]))]
        ranked, sel = choice(cs)
        shown = ranked[:6]
        if sel and sel not in shown:
            shown[-1] = sel
        want[a] = (sel and sel["ins"], sorted(c["ins"] for c in shown))
        rows += [(a, c["climb"] + 1, c["climb"], c["score"], c["thr"], c["thr2"], c["ins"], c["kind"], c["conf"], c["edge"], c["sus"], c["p"]) for c in cs]
    df = spark.createDataFrame(rows, "attempt_id long, raw_time double, climb_time double, score double, thr double, committed_thr double, ins long, kind string, confidence string, boundary_risk boolean, suspicious boolean, persistence long")
    ranked = S.choose_movement(df.withColumn("preload", F.lit(False)))
    sel = {q.attempt_id: q.ins for q in ranked.where("selected").collect()}
    shown = {}
    for q in S.present_candidates(ranked).collect():
        shown.setdefault(q.attempt_id, []).append(q.ins)
    for a, (s, ins) in want.items():
        assert sel.get(a) == s and sorted(shown[a]) == ins
