"""Landmarks, calibration and projection: one row per frame or per calibration, no shuffle needed.

A frame carries its landmarks as array<struct<idx,x,y,z,visibility>> (33 at most), so joints,
segments and the centre of mass are column expressions over that array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.dims import HOLD_PIXELS, JOINTS, ROUTE_IMAGE_H, ROUTE_IMAGE_W, SEGMENTS, WALL_H, WALL_W

HAND_POINTS = range(15, 23)
CORNERS = [("bottomLeft", 0.0, 0.0), ("bottomRight", WALL_W, 0.0), ("topRight", WALL_W, WALL_H), ("topLeft", 0.0, WALL_H)]


def repair_landmarks(landmarks) -> Column:
    """PRJ15: the first 33 entries, those with a valid index, position and visibility."""
    return F.filter(F.slice(X.c(landmarks), 1, 33), lambda p: p["idx"].between(0, 32) & X.finite(p["x"]).between(-0.25, 1.25) & X.finite(p["y"]).between(-0.25, 1.25)
                    & X.finite(p["z"]).isNotNull() & X.finite(p["visibility"]).between(0, 1))


def hand_landmarks(landmarks) -> Column:
    """PRJ16: wrists and fingers only, what contact timing needs."""
    return F.filter(X.c(landmarks), lambda p: p["idx"].between(15, 22))


def repair_pose_frames(frames: DataFrame, min_mass: float = 0.75) -> DataFrame:
    """PRJ15: bounds of a stored frame; a valid frame has both centres and enough mass."""
    mass = F.when(X.finite("mass_coverage").between(0, 1), F.col("mass_coverage")).otherwise(0.0)
    vis = F.when(X.finite("mean_visibility").between(0, 1), F.col("mean_visibility")).otherwise(0.0)
    image = X.truthy(X.finite("com_x").between(-0.25, 1.25) & X.finite("com_y").between(-0.25, 1.25))
    wall = X.truthy(X.finite("wall_x").between(-10, 10) & X.finite("wall_y").between(-10, 30))
    df = frames.where(X.finite("raw_time") >= 0).withColumns({"landmarks": repair_landmarks("landmarks"), "mass_coverage": mass, "mean_visibility": vis, "_i": image, "_w": wall})
    valid = X.truthy(F.col("valid") & F.col("_i") & F.col("_w") & (F.col("mass_coverage") >= min_mass))
    df = df.withColumn("valid", valid)
    sel = F.coalesce("pose_selected", (F.size("landmarks") > 0) | F.col("valid"))
    det = F.coalesce("pose_detected", sel)
    count = F.when(F.col("candidate_count").isNotNull(), F.least(F.greatest("candidate_count", F.lit(0)), F.lit(2))).otherwise(det.cast("int"))
    cut = {c: F.when(F.col("_i"), F.col(c)) for c in ("com_x", "com_y")} | {c: F.when(F.col("_w"), F.col(c)) for c in ("wall_x", "wall_y")}
    return df.withColumns({"candidate_count": count, "pose_detected": det, "pose_selected": sel, **cut}).drop("_i", "_w")


def first_frames(frames: DataFrame, limit: int | None = None) -> DataFrame:
    """PRJ15: the frames of the accepted range; a stored result keeps the first `limit` of them (450) where one is given."""
    from pyspark.sql import Window
    w = Window.partitionBy("attempt_id").orderBy("raw_time")
    inside = (F.col("raw_time") >= F.col("start_s") - 0.001) & (F.col("raw_time") <= F.col("end_s") + 0.001)
    return (frames.where(inside).withColumn("_n", F.row_number().over(w)).where(F.lit(True) if limit is None else F.col("_n") <= limit).drop("_n")
            .withColumn("climb_time", X.round_ms(F.col("raw_time") - F.col("start_s"))))


def project(x, y, h: str = "h") -> tuple[Column, Column]:
    """PRJ32: image point to wall metres through a 3x3 matrix column; NULL where the projection is unstable."""
    m = lambda i: F.col(h)[i]
    den = m(6) * x + m(7) * y + m(8)
    ok = F.abs(den) >= 1e-10
    px, py = (m(0) * x + m(1) * y + m(2)) / den, (m(3) * x + m(4) * y + m(5)) / den
    return F.when(ok, X.finite(px)), F.when(ok, X.finite(py))


def invert(h: str = "h") -> Column:
    """PRJ35: closed-form inverse of the matrix, NULL when it has none."""
    a, b, c, d, e, f, g, k, i = [F.col(h)[n] for n in range(9)]
    c00, c01, c02 = e * i - f * k, f * g - d * i, d * k - e * g
    det = a * c00 + b * c01 + c * c02
    s = F.lit(1.0) / det
    rows = [c00, c * k - b * i, b * f - c * e, c01, a * i - c * g, c * d - a * f, c02, b * g - a * k, a * e - b * d]
    return F.when(F.abs(det) >= 1e-12, F.array(*[r * s for r in rows]))


def hold_structs() -> Column:
    return F.array(*[F.struct(F.lit(i).alias("id"), F.lit(x / ROUTE_IMAGE_W * WALL_W).alias("x"), F.lit((1 - y / ROUTE_IMAGE_H) * WALL_H).alias("y")) for i, x, y in HOLD_PIXELS])


def project_route(calibrations: DataFrame) -> DataFrame:
    """PRJ35: all 20 holds of every calibration in image coordinates."""
    df = calibrations.withColumn("inv", invert()).where("inv is not null").withColumn("hold", F.explode(hold_structs()))
    x, y = project(F.col("hold.x"), F.col("hold.y"), "inv")
    return df.withColumns({"image_x": x, "image_y": y, "hold_id": F.col("hold.id")}).drop("hold", "inv")


def nearest_hold(x, y, dx=0.0, dy=0.0) -> Column:
    """JN13/JN30: struct(d, id) of the closest hold, ties to the smaller number."""
    dx, dy = (v if isinstance(v, Column) else F.lit(v) for v in (dx, dy))
    return F.array_min(F.transform(hold_structs(), lambda h: F.struct(F.hypot(X.c(x) - h["x"] - dx, X.c(y) - h["y"] - dy).alias("d"), h["id"].alias("id"))))


def nearest_other_hold(x, y, target: int, dx=0.0, dy=0.0) -> Column:
    dx, dy = (v if isinstance(v, Column) else F.lit(v) for v in (dx, dy))
    others = F.filter(hold_structs(), lambda h: h["id"] != target)
    return F.array_min(F.transform(others, lambda h: F.struct(F.hypot(X.c(x) - h["x"] - dx, X.c(y) - h["y"] - dy).alias("d"), h["id"].alias("id"))))


# --- body -------------------------------------------------------------------------------------

JOINT_POS = {n: i for i, n in enumerate([*JOINTS, "neck", "midHip"])}


def with_joints(frames: DataFrame, h: str | None = None) -> DataFrame:
    """The 17 named joints and the two midpoints as one array; wall space when ``h`` is given (JN15).

    Higher-order functions keep the expression small: it is written once, not once per joint.
    """
    def joint(i):
        p = F.get(F.filter("landmarks", lambda q: q["idx"] == i), F.lit(0))
        ok = X.truthy(X.finite(p["x"]).between(-0.25, 1.25) & X.finite(p["y"]).between(-0.25, 1.25) & X.finite(p["visibility"]).isNotNull())
        x, y = (p["x"], p["y"]) if h is None else project(p["x"], p["y"], h)
        return F.when(ok & x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y"), p["visibility"].alias("v")))

    def mid(pair):
        a, b = F.get("joints", pair["a"]), F.get("joints", pair["b"])
        return F.when(a.isNotNull() & b.isNotNull(), F.struct(((a["x"] + b["x"]) / 2).alias("x"), ((a["y"] + b["y"]) / 2).alias("y"), F.least(a["v"], b["v"]).alias("v")))
    pairs = F.array(*[F.struct(F.lit(JOINT_POS[a]).alias("a"), F.lit(JOINT_POS[b]).alias("b")) for a, b in (("leftShoulder", "rightShoulder"), ("leftHip", "rightHip"))])
    df = frames.withColumn("joints", F.transform(F.array(*[F.lit(i) for i in JOINTS.values()]), joint))
    return df.withColumn("joints", F.concat("joints", F.transform(pairs, mid)))


def _segments(min_visibility: float) -> Column:
    """Twelve segment structs of a frame, computed from the joints array."""
    spec = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(JOINT_POS[a]).alias("a"), F.lit(JOINT_POS[b]).alias("b"), F.lit(m).alias("m"), F.lit(r).alias("r"), F.lit(q).alias("q")) for n, a, b, m, r, q in SEGMENTS])

    def one(s):
        p, q = F.get("joints", s["a"]), F.get("joints", s["b"])
        v = F.least(p["v"], q["v"])
        used = X.truthy(p.isNotNull() & q.isNotNull() & (v >= min_visibility))
        return F.struct(s["n"].alias("segment"), s["m"].alias("mass"), s["q"].alias("required"), used.alias("used"), F.when(used, v).alias("visibility"),
                        F.when(used, p["x"] + (q["x"] - p["x"]) * s["r"]).alias("seg_x"), F.when(used, p["y"] + (q["y"] - p["y"]) * s["r"]).alias("seg_y"))
    return F.transform(spec, one)


def segment_rows(frames: DataFrame, min_visibility: float = 0.25, h: str | None = None, keys=("attempt_id", "frame_id")) -> DataFrame:
    """JN14: twelve rows per frame: centre, mass and whether the segment is usable."""
    return with_joints(frames, h).select(*keys, F.explode(_segments(min_visibility)).alias("s")).select(*keys, "s.*")


def centre_of_mass(frames: DataFrame, min_visibility: float = 0.25, min_mass: float = 0.75, h: str | None = None, keys=("attempt_id", "frame_id")) -> DataFrame:
    """AG9: mass-weighted centre of the usable segments; needs the trunk and enough mass."""
    zero = F.struct(*[F.lit(0.0).alias(k) for k in "mxyv"], F.lit(True).alias("ok"))

    def add(a, s):
        u, m = s["used"], s["mass"]
        plus = lambda k, val: (a[k] + F.when(u, val).otherwise(0.0)).alias(k)
        return F.struct(plus("m", m), plus("x", s["seg_x"] * m), plus("y", s["seg_y"] * m), plus("v", s["visibility"] * m), (a["ok"] & (u | ~s["required"])).alias("ok"))
    df = with_joints(frames, h).select(*keys, F.aggregate(_segments(min_visibility), zero, add).alias("t"))
    df = df.withColumn("com_valid", F.col("t.ok") & (F.col("t.m") >= min_mass))
    return df.select(*keys, "com_valid", F.when(F.col("com_valid"), F.col("t.x") / F.col("t.m")).alias("com_x"), F.when(F.col("com_valid"), F.col("t.y") / F.col("t.m")).alias("com_y"),
                     F.col("t.m").alias("mass_coverage"), F.when(F.col("t.m") > 0, F.col("t.v") / F.col("t.m")).otherwise(0.0).alias("mean_visibility"))


def body_anchor(landmarks: Column) -> Column:
    """AG42: hip midpoint, else shoulder midpoint, else the mean of a partial torso."""
    def pt(i):
        p = F.get(F.filter(landmarks, lambda q: (q["idx"] == i) & (q["visibility"] >= 0.2) & X.finite(q["x"]).isNotNull() & X.finite(q["y"]).isNotNull()), F.lit(0))
        return F.when(p.isNotNull(), F.struct(p["x"].alias("x"), p["y"].alias("y")))
    ls, rs, lh, rh = pt(11), pt(12), pt(23), pt(24)
    mid = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.struct(((a["x"] + b["x"]) / 2).alias("x"), ((a["y"] + b["y"]) / 2).alias("y")))
    part = F.array_compact(F.array(ls, rs, lh, rh))
    mean = lambda k: F.aggregate(part, F.lit(0.0), lambda s, p: s + p[k]) / F.size(part)
    both = (ls.isNotNull() | rs.isNotNull()) & (lh.isNotNull() | rh.isNotNull())
    return F.coalesce(mid(lh, rh), mid(ls, rs), F.when(both, F.struct(mean("x").alias("x"), mean("y").alias("y"))))


def valid_seed(seed_time, x, y, start) -> Column:
    """PRJ43: a tracking seed at most 0.3 s before the start and inside the frame."""
    t, s = X.finite(seed_time), X.finite(start)
    return X.truthy((t <= s + 0.001) & (s - t <= 0.3) & X.finite(x).between(0, 1) & X.finite(y).between(0, 1))


# --- calibration ------------------------------------------------------------------------------

def quad_area(p: list[Column]) -> Column:
    """FN27: shoelace area of four points."""
    return F.abs(sum(p[i]["x"] * p[(i + 1) % 4]["y"] - p[(i + 1) % 4]["x"] * p[i]["y"] for i in range(4))) / 2


def quad_convex(p: list[Column]) -> Column:
    """FN27: every turn clockwise in image coordinates."""
    def turn(o, a, b):
        return (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])
    return X.all_of(*[turn(p[i], p[(i + 1) % 4], p[(i + 2) % 4]) < -1e-7 for i in range(4)])


def corner(corners: str, name: str) -> Column:
    return F.get(F.filter(corners, lambda c: c["id"] == name), F.lit(0))


def calibration_error(corners: str = "corners", points: list[Column] | None = None) -> Column:
    """PRJ33: first rule a stored calibration breaks before it is solved, NULL when it may be solved.  ``points``: the four corners, where they are columns."""
    p = points or [corner(corners, n) for n, _, _ in CORNERS]
    bl, br, tr, tl = p
    dist = lambda a, b: F.hypot(a["x"] - b["x"], a["y"] - b["y"])
    ids = F.size(F.array_distinct(F.transform(corners, lambda c: c["id"]))) == 4
    wall = X.all_of(*[(F.abs(c["wall_x"] - x) < 1e-9) & (F.abs(c["wall_y"] - y) < 1e-9) for c, (_, x, y) in zip(p, CORNERS)])
    inside = X.all_of(*[X.finite(c["x"]).between(0, 1) & X.finite(c["y"]).between(0, 1) for c in p])
    close = X.any_of(*[dist(p[i], p[j]) < 0.025 for i in range(4) for j in range(i + 1, 4)])
    return X.when_chain([
        (~F.col("static_camera"), "moving-camera"), (X.finite("frame_raw_time").isNull() | (F.col("frame_raw_time") < 0), "frame-time"),
        ((F.col("width_m") != WALL_W) | (F.col("height_m") != WALL_H), "wall-size"), (~X.truthy((F.size(corners) == 4) & ids & X.all_of(*[c.isNotNull() for c in p])), "corner-ids"),
        (~X.truthy(wall), "wall-targets"), (~X.truthy(inside), "outside-frame"), (close, "corners-close"), ((bl["y"] + br["y"]) / 2 <= (tr["y"] + tl["y"]) / 2 + 0.04, "upside-down"),
        ((bl["x"] >= br["x"] - 0.02) | (tl["x"] >= tr["x"] - 0.02), "left-right"), ((dist(bl, br) < 0.05) | (dist(tl, tr) < 0.05) | (dist(bl, tl) < 0.12) | (dist(br, tr) < 0.12), "too-small"),
        (~quad_convex(p) | (quad_area(p) < 0.025), "not-convex")])


def _solve(batch: pd.DataFrame, pts: np.ndarray) -> np.ndarray:
    """Stacked 8x8 systems of a whole batch at once."""
    n = len(batch)
    a, b = np.zeros((n, 8, 8)), np.zeros((n, 8))
    for i, (_, wx, wy) in enumerate(CORNERS):
        x, y = pts[:, i, 0], pts[:, i, 1]
        one, zero = np.ones(n), np.zeros(n)
        a[:, 2 * i] = np.stack([x, y, one, zero, zero, zero, -wx * x, -wx * y], 1)
        a[:, 2 * i + 1] = np.stack([zero, zero, zero, x, y, one, -wy * x, -wy * y], 1)
        b[:, 2 * i], b[:, 2 * i + 1] = wx, wy
    return np.concatenate([np.linalg.solve(a, b[:, :, None])[:, :, 0], np.ones((n, 1))], 1)


def solve_calibrations(calibrations: DataFrame, key: str = "calibration_id") -> DataFrame:
    """PRJ34: the image-to-wall matrix of every valid calibration, solved batch-wise in NumPy."""
    points = [F.col(f"_p{i}") for i in range(len(CORNERS))]
    # the rules name a corner a hundred times: generated columns are looked up once, whereas a filter takes plain ones apart again
    found = F.inline(F.array(F.struct(*[corner("corners", n).alias(f"_p{i}") for i, (n, _, _) in enumerate(CORNERS)])))
    good = calibrations.select("*", found).where(calibration_error(points=points).isNull()).select(key, *[p[k].alias(f"c{i}{k}") for i, p in enumerate(points) for k in "xy"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                pts = np.stack([np.stack([b[f"c{i}x"], b[f"c{i}y"]], 1) for i in range(4)], 1).astype(float)
                yield pd.DataFrame({key: b[key], "h": list(_solve(b, pts))})
    return good.mapInPandas(run, f"{key} bigint, h array<double>")


def track_athlete(frames: DataFrame, backtrack: float = 0.085) -> DataFrame:
    """JN28: which detected person is the tracked athlete, frame by frame.

    ``frames``: attempt_id, raw_time, people array<struct<x,y>> (anchors inside the image), zone struct.
    The accepted position, its time and the highest point reached are state; an attempt holds at most a few
    hundred frames, so they are folded in time order.
    """
    rows = frames.groupBy("attempt_id").agg(F.sort_array(F.collect_list(F.struct("raw_time", "people"))).alias("fs"), F.max("zone").alias("zone"))
    dist = lambda p, q: F.hypot(p["x"] - q["x"], p["y"] - q["y"])
    null_d = F.lit(None).cast("double")
    no_point = F.lit(None).cast("struct<x:double,y:double>")
    out = F.array().cast("array<struct<raw_time:double,x:double,y:double,reason:string>>")
    zero = F.struct(no_point.alias("c"), null_d.alias("t"), null_d.alias("high"), out.alias("out"))

    def scored(people, to):
        return F.array_sort(F.transform(people, lambda p: F.struct(dist(p, to).alias("s"), p["x"].alias("x"), p["y"].alias("y"))))

    def verdict(p, reason):
        return F.struct(p.alias("p"), F.lit(reason).cast("string").alias("reason") if not isinstance(reason, Column) else reason.alias("reason"))

    def point(s):
        return F.struct(s["x"].alias("x"), s["y"].alias("y"))

    def follow(st, f):
        limit = X.clamp(0.12 + (f["raw_time"] - st["t"]) * 0.45, 0.12, 0.4)
        ok = F.filter(scored(f["people"], st["c"]), lambda q: (q["s"] <= limit) & (q["y"] <= st["high"] + backtrack))
        a, b = F.get(ok, F.lit(0)), F.get(ok, F.lit(1))
        tie = X.truthy(b["s"] - a["s"] < F.greatest(F.lit(0.025), a["s"] * 0.35)) & (a["s"] > F.least(F.lit(0.06), limit * 0.5))
        return F.when(F.size(ok) == 0, verdict(no_point, "not-plausible")).when(tie, verdict(no_point, "two-equally-plausible")).otherwise(verdict(point(a), F.lit(None).cast("string")))

    def acquire(f):
        z = F.col("zone")
        mid = F.struct(((z["x1"] + z["x2"]) / 2).alias("x"), ((z["y1"] + z["y2"]) / 2).alias("y"))
        inside = F.filter(f["people"], lambda p: p["x"].between(z["x1"], z["x2"]) & p["y"].between(z["y1"], z["y2"]))
        near = F.filter(f["people"], lambda p: dist(p, mid) <= F.greatest(F.lit(0.1), F.hypot(z["x2"] - z["x1"], z["y2"] - z["y1"]) * 0.75))
        one = lambda a: point(F.get(a, F.lit(0)))
        return X.when_chain([(F.size(inside) == 1, verdict(one(inside), F.lit(None).cast("string"))), (F.size(inside) > 1, verdict(no_point, "several-in-zone")), (F.size(near) == 1, verdict(one(near), "near-zone")),
                             (F.size(near) > 1, verdict(no_point, "several-near-zone"))], verdict(no_point, "none-in-zone"))

    def step(st, f):
        v = F.when(F.size(f["people"]) == 0, verdict(no_point, "nobody")).when(st["c"].isNotNull(), follow(st, f)).otherwise(acquire(f))
        p = v["p"]
        row = F.struct(f["raw_time"].alias("raw_time"), p["x"].alias("x"), p["y"].alias("y"), v["reason"].alias("reason"))
        return F.struct(F.coalesce(p, st["c"]).alias("c"), F.when(p.isNotNull(), f["raw_time"]).otherwise(st["t"]).alias("t"), F.least(st["high"], p["y"]).alias("high"), F.concat(st["out"], F.array(row)).alias("out"))
    return rows.select("attempt_id", F.explode(F.aggregate("fs", zero, step)["out"]).alias("o")).select("attempt_id", "o.*")
