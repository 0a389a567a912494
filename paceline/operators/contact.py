"""Hand contact with a hold: projected hand points, proximity episodes, their evaluation and choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.dims import HOLD_PIXELS, ROUTE_IMAGE_H, ROUTE_IMAGE_W, WALL_H, WALL_W
from .pose import nearest_hold, nearest_other_hold, project

HAND = {"left": (15, (17, 19, 21), (15, 17, 19, 21)), "right": (16, (18, 20, 22), (16, 18, 20, 22))}


def hold_xy(hold_id: int) -> tuple[float, float]:
    _, px, py = HOLD_PIXELS[hold_id - 1]
    return px / ROUTE_IMAGE_W * WALL_W, (1 - py / ROUTE_IMAGE_H) * WALL_H


def contact_options(fps: float, approximate: bool, min_visibility: float = 0.25) -> dict:
    """PRJ40: defaults of the contact test, by calibration quality and sample rate."""
    fps = max(1.0, fps)
    return {"proximity": 0.62 if approximate else 0.55, "confirmation": 0.44 if approximate else 0.38, "dwell": 0.14, "gap": min(0.46, max(0.15, 2.25 / fps)),
            "visibility": min(max(max(0.2, min_visibility * 0.75), 0.0), 1.0), "median_speed": 1.65 if approximate else 1.35, "net_speed": 1.05 if approximate else 0.9,
            "padding": 0.4, "ambiguity": 0.12 if approximate else 0.08, "fps": fps}


def option_columns(fps, approximate, min_visibility) -> dict[str, Column]:
    """PRJ40 per row, for tables of analyses with different settings."""
    f = F.greatest(F.lit(1.0), X.c(fps))
    a = X.c(approximate)
    pick = lambda yes, no: F.when(a, yes).otherwise(no)
    return {"proximity_m": pick(0.62, 0.55), "confirmation_m": pick(0.44, 0.38), "dwell_s": F.lit(0.14), "gap_s": F.least(F.lit(0.46), F.greatest(F.lit(0.15), 2.25 / f)),
            "min_visibility": X.clamp(F.greatest(F.lit(0.2), X.c(min_visibility) * 0.75), 0.0, 1.0), "median_speed": pick(1.65, 1.35), "net_speed": pick(1.05, 0.9), "ambiguity_m": pick(0.12, 0.08)}


def _median(xs: Column) -> Column:
    s = F.array_sort(xs)
    n = F.size(s)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def hand_points(frames: DataFrame, min_visibility: float, h: str = "h", keys=("attempt_id", "frame_id")) -> DataFrame:
    """WN17: one point per frame and hand: the finger cluster when it is robust, else the wrist."""
    def pt(q):
        x, y = project(q["x"], q["y"], h)
        return F.struct(x.alias("x"), y.alias("y"), q["visibility"].alias("v"))
    rows = []
    for hand, (wrist_i, fingers_i, _) in HAND.items():
        seen = F.filter("landmarks", lambda q: (q["visibility"] >= min_visibility) & X.finite(q["x"]).isNotNull() & X.finite(q["y"]).isNotNull())
        have = lambda p: p["x"].isNotNull() & p["y"].isNotNull()
        fingers = F.filter(F.transform(F.filter(seen, lambda q: q["idx"].isin(*fingers_i)), pt), have)
        wrist = F.get(F.filter(F.transform(F.filter(seen, lambda q: q["idx"] == wrist_i), pt), have), F.lit(0))
        rows.append(F.struct(F.lit(hand).alias("hand"), fingers.alias("f"), wrist.alias("w")))
    df = frames.select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.*")
    near = lambda p, x, y, r: F.hypot(p["x"] - x, p["y"] - y) <= r
    axis = lambda xs, k: _median(F.transform(xs, lambda p: p[k]))
    df = df.withColumns({"_cx": axis(F.col("f"), "x"), "_cy": axis(F.col("f"), "y")})
    df = df.withColumn("_in", F.filter("f", lambda p: near(p, F.col("_cx"), F.col("_cy"), 0.42)))
    df = df.withColumns({"_ix": axis(F.col("_in"), "x"), "_iy": axis(F.col("_in"), "y"), "_iv": axis(F.col("_in"), "v"), "_one": F.get("f", F.lit(0))})
    nowrist = F.col("w").isNull()
    cluster = (F.size("f") >= 2) & (F.size("_in") >= 2) & (nowrist | near(F.col("w"), F.col("_ix"), F.col("_iy"), 0.75))
    single = (F.size("f") == 1) & (F.col("_one.v") >= max(0.5, min_visibility)) & (near(F.col("_one"), F.col("w.x"), F.col("w.y"), 0.72) | (nowrist & (F.col("_one.v") >= 0.7)))
    out = lambda x, y, v, s, n: F.struct(x.alias("x"), y.alias("y"), v.alias("visibility"), F.lit(s).alias("point_source"), n.alias("points"))
    pick = X.when_chain([(X.truthy(cluster), out(F.col("_ix"), F.col("_iy"), F.col("_iv"), "fingers", F.size("_in"))), (X.truthy(single), out(F.col("_one.x"), F.col("_one.y"), F.col("_one.v"), "fingers", F.lit(1))),
                         (~nowrist, out(F.col("w.x"), F.col("w.y"), F.col("w.v"), "wrist", F.lit(1)))])
    return df.withColumn("_p", pick).where("_p is not null").select(*keys, "hand", "_p.*")


def _hw() -> Window:
    return Window.partitionBy("attempt_id", "hand").orderBy("raw_time")


def proximity_episodes(obs: DataFrame, hold: tuple[float, float], opt: dict) -> DataFrame:
    """WN18: runs of hand samples within the radius; a longer gap or a sample outside ends a run.

    ``obs``: attempt_id, hand, raw_time, x, y, visibility, point_source, points.
    """
    d = F.hypot(F.col("x") - hold[0], F.col("y") - hold[1])
    df = obs.withColumn("distance_m", d).withColumns({"_pt": F.lag("raw_time").over(_hw()), "_pd": F.lag("distance_m").over(_hw())})
    near, joined = F.col("distance_m") <= opt["proximity"], F.col("raw_time") - F.col("_pt") <= opt["gap"] + 1e-9
    start = near & ~X.truthy((F.col("_pd") <= opt["proximity"]) & joined)
    df = df.withColumn("_start", start).withColumn("episode", F.sum(F.col("_start").cast("int")).over(_hw()))
    entry = F.when(F.col("_start") & X.truthy(joined), F.struct(F.col("_pt").alias("t"), F.col("_pd").alias("d")))
    df = df.withColumn("_entry", entry).where(near)
    e = Window.partitionBy("attempt_id", "hand", "episode")
    return df.withColumn("entry", F.max("_entry").over(e)).drop("_pt", "_pd", "_start", "_entry")


def median_filter(ep: DataFrame, hold: tuple[float, float], target: int) -> DataFrame:
    """WN19 (and JN31): median of three positions inside an episode, nearest numbered holds attached.

    The route around the target is the standard one moved so that the target hold sits on ``hold``.
    """
    w = Window.partitionBy("attempt_id", "hand", "episode").orderBy("raw_time")
    n = F.count("*").over(Window.partitionBy("attempt_id", "hand", "episode"))
    df = ep.withColumns({"idx": F.row_number().over(w) - 1, "n": n})
    mid = (F.col("n") >= 3) & (F.col("idx") > 0) & (F.col("idx") < F.col("n") - 1)
    med = lambda c: F.when(mid, F.get(F.array_sort(F.array(F.lag(c).over(w), F.col(c), F.lead(c).over(w))), F.lit(1))).otherwise(F.col(c))
    df = df.withColumns({"fx": med("x"), "fy": med("y")}).withColumn("fd", F.hypot(F.col("fx") - hold[0], F.col("fy") - hold[1]))
    tx, ty = hold_xy(target)
    near, other = nearest_hold("fx", "fy", hold[0] - tx, hold[1] - ty), nearest_other_hold("fx", "fy", target, hold[0] - tx, hold[1] - ty)
    return df.withColumns({"nearest_id": near["id"], "nearest_m": near["d"], "other_id": other["id"], "other_m": other["d"]})


def evaluate_episodes(filtered: DataFrame, opt: dict, target: int) -> DataFrame:
    """WN20 and WN21: dwell, coverage, stillness, nearest-hold share, onset, score and reject reason."""
    keys = ["attempt_id", "hand", "episode"]
    w = Window.partitionBy(*keys).orderBy("raw_time")
    dt = F.col("raw_time") - F.lag("raw_time").over(w)
    df = filtered.withColumn("_v", F.when(dt > 1e-9, F.hypot(F.col("fx") - F.lag("fx").over(w), F.col("fy") - F.lag("fy").over(w)) / dt))
    e = Window.partitionBy(*keys)
    df = df.withColumns({"_closest": F.min("distance_m").over(e), "_med": F.percentile("fd", F.lit(0.5)).over(e)})
    df = df.withColumn("_radius", F.least(F.lit(opt["confirmation"]), F.greatest(F.col("_closest") + 0.08, F.col("_med") + 0.08)))
    inr = F.col("fd") <= F.col("_radius") + 1e-9
    df = df.withColumns({"_in": inr, "_pt": F.coalesce(F.lag("raw_time").over(w), F.col("entry.t")), "_pd": F.coalesce(F.lag("fd").over(w), F.col("entry.d"))})
    stable = F.col("_in") & (X.truthy(F.lead("_in").over(w)) | X.truthy(F.lag("_in").over(w)))
    df = df.withColumn("_stable", stable)
    gap_ok = (F.col("raw_time") - F.col("_pt") <= opt["gap"] + 1e-9) & (F.col("_pd") > F.col("_radius")) & (F.col("fd") < F.col("_pd"))
    share = X.clamp((F.col("_pd") - F.col("_radius")) / (F.col("_pd") - F.col("fd")), 0.0, 1.0)
    onset = F.when(X.truthy(gap_ok), X.round_ms(F.col("_pt") + (F.col("raw_time") - F.col("_pt")) * share)).otherwise(X.round_ms("raw_time"))
    df = df.withColumn("_onset", F.when(F.col("_stable"), onset))
    conf = F.col("fd") <= opt["confirmation"] + 1e-9
    is_near, plausible = F.col("nearest_id") == target, F.col("fd") <= F.col("other_m") + opt["ambiguity"]
    g = df.groupBy(*keys).agg(
        F.count("*").alias("samples"), F.min("raw_time").alias("first_s"), (F.max("raw_time") - F.min("raw_time")).alias("duration_s"), F.min("distance_m").alias("closest_m"), F.max("_med").alias("median_m"),
        F.avg("visibility").alias("mean_visibility"), F.percentile("_v", F.lit(0.5)).alias("_ms"), F.min(F.struct("raw_time", "fx", "fy")).alias("_a"), F.max(F.struct("raw_time", "fx", "fy")).alias("_z"), F.count_if(conf).alias("confirmations"),
        F.count_if(conf & is_near).alias("_nc"), F.count_if(is_near).alias("_na"), F.count_if(conf & plausible).alias("_pc"), F.count_if(plausible).alias("_pa"), F.min_by("_onset", F.when(F.col("_stable"), F.col("raw_time"))).alias("onset_s"))
    fps = opt["fps"]
    required = max(2, -int(-(opt["dwell"] * fps) // 1) + 1)
    base = F.when(F.col("confirmations") > 0, F.col("confirmations")).otherwise(F.col("samples"))
    g = g.withColumns({
        "coverage": F.least(F.lit(1.0), F.col("samples") / F.greatest(F.lit(1.0), F.floor(F.col("duration_s") * fps + 0.5) + 1)), "nearest_share": F.when(F.col("confirmations") > 0, F.col("_nc")).otherwise(F.col("_na")) / base,
        "plausible_share": F.when(F.col("confirmations") > 0, F.col("_pc")).otherwise(F.col("_pa")) / base, "median_speed": F.coalesce("_ms", F.lit(float("inf"))),
        "net_speed": F.when(F.col("duration_s") > 1e-9, F.hypot(F.col("_z.fx") - F.col("_a.fx"), F.col("_z.fy") - F.col("_a.fy")) / F.col("duration_s")).otherwise(float("inf"))})
    unit = lambda c: X.clamp(c, 0.0, 1.0)
    score = (25 * (1 - unit(F.col("median_m") / opt["confirmation"])) + 15 * unit(F.col("duration_s") / (opt["dwell"] * 2)) + 12 * F.col("coverage") + 10 * F.col("mean_visibility")
             + 16 * (1 - unit(F.col("median_speed") / opt["median_speed"])) + 12 * unit(F.col("confirmations") / max(2, required)) + 10 * (F.col("nearest_share") + F.col("plausible_share")) / 2)
    reason = X.when_chain([
        ((F.col("samples") < required) | (F.col("duration_s") + 1e-9 < opt["dwell"]), "too-short"), (F.col("coverage") < 0.55, "missing-frames"),
        ((F.col("confirmations") < max(2, required - 1)) | (F.col("median_m") > opt["confirmation"]) | F.col("onset_s").isNull(), "not-confirmed"), ((F.col("nearest_share") < 0.5) | (F.col("plausible_share") < 0.7), "other-hold"),
        ((F.col("median_speed") > opt["median_speed"]) | (F.col("net_speed") > opt["net_speed"]), "fly-by")])
    return g.withColumns({"score": X.round_to(X.clamp(score, 0.0, 100.0), 1), "reject_reason": reason}).drop("_ms", "_a", "_z", "_nc", "_na", "_pc", "_pa")


def choose_contact(evaluated: DataFrame, opt: dict, approximate: bool, facts: DataFrame) -> DataFrame:
    """WN22: the earliest accepted episode; nearly simultaneous ones are decided by score.

    ``facts``: attempt_id, quality, calibration_confidence.
    """
    ok = evaluated.where("reject_reason is null and onset_s is not null")
    w = Window.partitionBy("attempt_id")
    near = F.col("onset_s") <= F.min("onset_s").over(w) + max(0.025, 0.45 / opt["fps"]) + 1e-9
    ok = ok.withColumn("_near", near).where("_near")
    best = ok.withColumn("_r", F.row_number().over(w.orderBy(F.col("score").desc(), "onset_s", "closest_m", "hand", "episode"))).where("_r = 1").join(facts, "attempt_id", "left")
    low = (F.col("calibration_confidence") == "Low") | (F.col("quality") == "Needs review") | (F.col("mean_visibility") < 0.4) | (F.col("score") < 62)
    strong = (F.lit(not approximate) & (F.col("quality") == "High") & (F.col("coverage") >= 0.8) & (F.col("duration_s") >= 0.2) & (F.col("closest_m") <= 0.28) & (F.col("median_speed") <= 0.8)
              & (F.col("mean_visibility") >= 0.6) & ((F.col("nearest_share") >= 0.75)) & (F.col("score") >= 75))
    return best.select("attempt_id", "hand", "onset_s", "closest_m", "score", F.when(X.truthy(low), "Low").when(X.truthy(strong), "High").otherwise("Medium").alias("confidence"))


def contact_markers(chosen: DataFrame, starts: DataFrame) -> DataFrame:
    """PRJ39: the chosen contact as a middle marker row."""
    return chosen.join(starts, "attempt_id").select("attempt_id", F.lit("hold10").alias("marker_id"), F.col("onset_s").alias("raw_time"), F.greatest(F.lit(0.0), F.col("onset_s") - F.col("start_s")).alias("climb_time"),
                                                   F.col("onset_s").alias("detected_raw_time"), F.lit(0.0).alias("offset_applied"), F.lit("Hold contact detection").alias("source"), "confidence")


def review_window(time, start, end, padding=0.4) -> tuple[Column, Column]:
    """PRJ31."""
    return F.greatest(X.c(start), X.c(time) - padding), F.least(X.c(end), X.c(time) + max(0.6, padding))


def hand_height(landmarks: Column, indices, h: str = "h") -> Column:
    """WN23: upper-median height of the visible points of one hand; two points at least."""
    seen = F.filter(landmarks, lambda q: q["idx"].isin(*indices) & (q["visibility"] >= 0.35) & X.finite(q["x"]).isNotNull() & X.finite(q["y"]).isNotNull())
    ys = F.array_sort(F.filter(F.transform(seen, lambda q: project(q["x"], q["y"], h)[1]), lambda v: v.between(-0.5, WALL_H + 0.5)))
    return F.when(F.size(ys) >= 2, F.get(ys, F.floor(F.size(ys) * 0.65).cast("int")))


def height_passage(heights: DataFrame, target: float, start: str = "start_s") -> DataFrame:
    """WN23: first continuous rise of the higher hand through a height, with an observed approach and
    at least one confirming sample.  ``heights``: attempt_id, raw_time, left_y, right_y, start_s.

    Looking back 0.6 s and ahead 0.3 s uses range frames, which stop at a gap through a gap counter.
    """
    w = Window.partitionBy("attempt_id").orderBy("raw_time")
    left = F.col("right_y").isNull() | X.truthy(F.col("left_y") >= F.col("right_y"))
    df = heights.where("left_y is not null or right_y is not null").withColumns({"hand": F.when(left & F.col("left_y").isNotNull(), "left").otherwise("right")})
    df = df.withColumn("y", F.when(F.col("hand") == "left", F.col("left_y")).otherwise(F.col("right_y")))
    gap = F.col("raw_time") - F.lag("raw_time").over(w)
    df = df.withColumns({"_gap": gap, "_py": F.lag("y").over(w), "_pt": F.lag("raw_time").over(w)}).withColumn("_run", F.sum(F.when(F.col("_gap") > 0.25, 1).otherwise(0)).over(w))
    df = df.withColumn("_ms", F.floor(F.col("raw_time") * 1000 + 0.5).cast("bigint"))
    r = Window.partitionBy("attempt_id", "_run").orderBy("_ms")
    low = F.col("y") <= target - 0.18
    df = df.withColumn("_approach", F.max(F.when(low, 1)).over(r.rangeBetween(-600, -1)))
    drop = F.min(F.when(F.col("y") < target - 0.12, F.col("_ms"))).over(r.rangeBetween(1, 300))
    df = df.withColumn("_drop", drop).withColumn("_next", F.lead("_ms").over(r))
    confirmed = (F.col("_next") - F.col("_ms") <= 300) & (F.col("_drop").isNull() | (F.col("_next") < F.col("_drop")))
    hit = (F.col("_gap") > 0) & (F.col("_gap") <= 0.25) & (F.col("_py") < target) & (F.col("y") >= target) & F.col("_approach").isNotNull() & confirmed
    rise = F.col("y") - F.col("_py")
    at = X.round_ms(F.col("_pt") + F.col("_gap") * F.when(rise > 1e-6, X.clamp((F.lit(target) - F.col("_py")) / rise, 0.0, 1.0)).otherwise(1.0))
    g = df.withColumn("_hit", X.truthy(hit)).where("_hit").groupBy("attempt_id").agg(F.min_by(F.struct(at.alias("passage_s"), "hand", start), "raw_time").alias("p"))
    return g.select("attempt_id", "p.passage_s", "p.hand", X.round_ms(F.col("p.passage_s") - F.col(f"p.{start}")).alias("climb_s"))


def frames_around(frames: DataFrame, targets: DataFrame) -> DataFrame:
    """JN20: nearest tracked frame before and after a time, when they bracket it within 0.15 s."""
    j = targets.join(frames.select("attempt_id", "raw_time"), "attempt_id", "left")
    g = j.groupBy("attempt_id", "target_s").agg(F.max(F.when(F.col("raw_time") <= F.col("target_s"), F.col("raw_time"))).alias("before_s"), F.min(F.when(F.col("raw_time") >= F.col("target_s"), F.col("raw_time"))).alias("after_s"))
    ok = X.truthy(F.col("after_s") - F.col("before_s") <= 0.15)
    return g.select("attempt_id", "target_s", F.when(ok, F.col("before_s")).alias("bracket_start_s"), F.when(ok, F.col("after_s")).alias("bracket_end_s"))


def refinement_plan(coarse: DataFrame, seeds: DataFrame) -> DataFrame:
    """JN21: the short window of a denser second look, seeded by a tracked frame.

    ``coarse``: attempt_id, coarse_s, start_s, end_s, duration_s; ``seeds``: attempt_id, raw_time.
    """
    want = F.greatest("start_s", F.col("coarse_s") - 0.7)
    ok = (F.col("coarse_s") > F.col("start_s")) & (F.col("coarse_s") < F.least("duration_s", "end_s"))
    j = coarse.where(ok).withColumn("_want", want).join(seeds.select("attempt_id", F.col("raw_time").alias("_t")), "attempt_id")
    j = j.where((F.col("_t") >= F.col("start_s")) & (F.col("_t") <= F.col("_want")) & (F.col("_want") - F.col("_t") <= 0.3))
    g = j.groupBy("attempt_id", "coarse_s", "start_s", "end_s", "duration_s").agg(F.max("_t").alias("seed_s"))
    end = F.least(F.col("duration_s") - 0.001, F.col("end_s"), F.col("coarse_s") + 0.9)
    g = g.withColumn("window_end_s", end)
    return g.where((F.col("window_end_s") - F.col("seed_s")).between(0.4, 2.2)).select("attempt_id", "coarse_s", "seed_s", "window_end_s", F.greatest("start_s", F.col("seed_s") - 0.6).alias("preview_start_s"))


def second_pass(plans: DataFrame, dense: DataFrame) -> DataFrame:
    """JN22: does the denser look confirm the coarse time?  ``dense``: attempt_id, fine_s, is_contact, selected_frames."""
    df = plans.join(dense, "attempt_id", "left")
    few = F.coalesce("selected_frames", F.lit(0)) < 4
    ok = X.truthy(F.col("fine_s").between(F.col("seed_s"), F.col("window_end_s")) & (F.abs(F.col("fine_s") - F.col("coarse_s")) <= 0.45) & ~few)
    why = X.when_chain([(ok, F.lit(None).cast("string")), (few, "few-frames"), (F.col("fine_s").isNull(), "no-candidate"), (~F.col("fine_s").between(F.col("seed_s"), F.col("window_end_s")), "outside-window")], F.lit("disagrees"))
    return df.select("attempt_id", ok.alias("refined"), F.when(ok, F.when(F.col("is_contact"), "contact-candidate").otherwise("height-passage")).otherwise("inconclusive").alias("kind"),
                     F.when(ok, F.col("fine_s")).otherwise(F.col("coarse_s")).alias("candidate_s"), F.when(ok, X.round_ms(F.col("fine_s") - F.col("coarse_s"))).alias("shift_s"), why.alias("reason"))


def evidence_frames(plans: DataFrame) -> DataFrame:
    """TOP8: review frames: candidate, coarse cursor and seven evenly spaced ones, 1 ms apart at least.

    ``plans``: attempt_id, preview_start_s, window_end_s, coarse_s, fine_s.  Earlier entries win, so each
    entry is checked against the kept ones with a fold over nine items.
    """
    a, z = F.col("preview_start_s"), F.col("window_end_s")
    pts = [F.struct(F.col("fine_s").alias("t"), F.lit("Closer estimate").alias("label")), F.struct(F.col("coarse_s").alias("t"), F.lit("Broad cursor").alias("label"))]
    pts += [F.struct((a + (z - a) * i / 6).alias("t"), F.lit({0: "Approach", 6: "Follow-through"}.get(i, "Context")).alias("label")) for i in range(7)]
    items = F.filter(F.array(*pts), lambda p: p["t"].between(a, z))
    kept = F.aggregate(items, F.slice(F.array(*pts), 1, 0), lambda k, p: F.when(F.exists(k, lambda q: F.abs(q["t"] - p["t"]) < 0.001), k).otherwise(F.concat(k, F.array(p))))
    return plans.where((a >= 0) & (z > a)).select("attempt_id", F.explode(kept).alias("k")).select("attempt_id", X.round_us("k.t").alias("raw_time"), "k.label")


def within_contact_bounds(x, y, edge=False) -> Column:
    m = WALL_W * 0.05
    e = edge if isinstance(edge, Column) else F.lit(edge)
    margin = F.when(e, m).otherwise(0.0)
    return X.truthy((X.c(x) >= -margin) & (X.c(x) <= margin + WALL_W) & (X.c(y) >= 0) & (X.c(y) <= WALL_H))


def resolve_target(df: DataFrame) -> DataFrame:
    """PRJ24 and PRJ42: manual zone centre when it projects onto the wall, else the registered hold, else the template.

    Needs zone (struct or NULL), h (matrix or NULL), aligned, align_x, align_y (image), align_wx, align_wy (wall).
    """
    z = lambda k: F.col(f"zone.{k}")
    inside = X.truthy(X.all_of(*[X.finite(f"zone.{k}").between(0, 1) for k in ("x1", "y1", "x2", "y2")]))
    cx, cy = (z("x1") + z("x2")) / 2, (z("y1") + z("y2")) / 2
    wx, wy = project(cx, cy)
    df = df.withColumns({"_wx": wx, "_wy": wy})
    on_wall = X.truthy(F.col("_wx").between(0, WALL_W) & F.col("_wy").between(0, WALL_H))
    why = X.when_chain([(F.col("zone").isNull(), "not-provided"), (~inside, "invalid-zone"), (F.col("h").isNull(), "invalid-calibration"), (F.col("_wx").isNull() | F.col("_wy").isNull(), "projection-failed"), (~on_wall, "outside-wall")])
    df = df.withColumn("fallback_reason", why)
    aligned = X.truthy(F.col("aligned") & F.col("align_x").between(0, 1) & F.col("align_y").between(0, 1) & F.col("h").isNotNull() & within_contact_bounds("align_wx", "align_wy"))
    src = F.when(F.col("fallback_reason").isNull(), "manual-zone").when(aligned, "visual-alignment").otherwise("standard-template")
    tx, ty = hold_xy(10)
    df = df.withColumn("target_source", src)
    pick = lambda m, a, t: F.when(F.col("target_source") == "manual-zone", m).when(F.col("target_source") == "visual-alignment", a).otherwise(t)
    return df.withColumns({"target_x": pick(F.col("_wx"), F.col("align_wx"), F.lit(tx)), "target_y": pick(F.col("_wy"), F.col("align_wy"), F.lit(ty)),
                           "fallback_reason": F.when(F.col("target_source") == "standard-template", F.col("fallback_reason"))}).drop("_wx", "_wy")


def observed_route(holds: DataFrame, target: int, edge: bool = False) -> DataFrame:
    """JN31: is a registered set of holds usable around the target?  ``holds``: attempt_id, hold_id, x, y, target_x, target_y."""
    ok = F.col("hold_id").between(1, 20) & within_contact_bounds("x", "y", edge)
    at = F.when(F.col("hold_id") == target, F.hypot(F.col("x") - F.col("target_x"), F.col("y") - F.col("target_y")))
    g = holds.groupBy("attempt_id").agg(F.count("*").alias("holds"), F.count_distinct("hold_id").alias("_ids"), F.bool_and(ok).alias("_ok"), F.min(at).alias("_at"))
    return g.select("attempt_id", "holds", X.truthy((F.col("holds") >= 3) & (F.col("_ids") == F.col("holds")) & F.col("_ok") & (F.col("_at") <= 0.02)).alias("usable"))


def pad_approach(frames: DataFrame, pad: tuple[float, float, float, float]) -> DataFrame:
    """WN51: first hand that approaches a target from below and stays for two frames.

    ``frames``: attempt_id, raw_time, landmarks.  What came before is a 0.8 s range frame per hand.
    """
    cx, cy = (pad[0] + pad[2]) / 2, (pad[1] + pad[3]) / 2
    rx, ry = max(0.014, (pad[2] - pad[0]) / 2 + 0.008), max(0.012, (pad[3] - pad[1]) / 2 + 0.008)
    good = lambda q: (q["visibility"] >= 0.35) & q["x"].between(0, 1) & q["y"].between(0, 1)
    pick = lambda idx: F.filter("landmarks", lambda q: q["idx"].isin(*idx) & good(q))
    axis = lambda xs, k: _median(F.transform(xs, lambda q: q[k]))
    one = frames.groupBy("attempt_id", "raw_time").agg(F.first("landmarks").alias("landmarks"))
    hands = [F.struct(F.lit(o).alias("ord"), F.lit(h).alias("hand"), F.when(F.size(pick(f)) >= 2, pick(f)).otherwise(pick((w,))).alias("hs")) for o, (h, (w, f, _)) in enumerate(HAND.items())]
    df = one.select("attempt_id", "raw_time", pick((11, 12, 23, 24)).alias("torso"), F.explode(F.array(*hands)).alias("h"))
    df = df.withColumns({"tx": axis(F.col("torso"), "x"), "ty": axis(F.col("torso"), "y"), "x": axis(F.col("h.hs"), "x"), "y": axis(F.col("h.hs"), "y"),
                         "span": F.array_max(F.transform("torso", lambda q: q["y"])) - F.array_min(F.transform("torso", lambda q: q["y"]))})
    ok = (F.size("torso") >= 3) & (F.size("h.hs") > 0) & (F.abs(F.col("tx") - cx) <= 0.1) & F.col("ty").between(cy - 0.01, cy + 0.2) & F.col("span").between(0.008, 0.16)
    df = df.withColumns({"ok": X.truthy(ok), "d": F.hypot((F.col("x") - cx) / rx, (F.col("y") - cy) / ry), "ms": F.floor(F.col("raw_time") * 1000 + 0.5).cast("bigint"), "ord": F.col("h.ord"), "hand": F.col("h.hand")})
    item = F.struct(F.col("raw_time").alias("t"), "x", "y", "tx", "ty", "d")
    w = Window.partitionBy("attempt_id", "ord").orderBy("ms")
    df = df.withColumn("p", F.when(F.col("ok"), item))
    df = df.withColumns({"before": F.array_compact(F.collect_list("p").over(w.rangeBetween(-800, -1))), "next": F.lead("p").over(w)})
    seq = F.concat("before", F.array("p", "next"))
    df = df.where("p is not null and next is not null").withColumn("seq", seq)
    pairs = F.transform(F.slice("seq", 2, F.greatest(F.size("seq") - 1, F.lit(1))), lambda q, i: F.struct(q.alias("b"), F.get("seq", i).alias("a")))
    smooth = F.forall(pairs, lambda k: (k["b"]["t"] - k["a"]["t"] <= 0.2) & (F.hypot(k["b"]["tx"] - k["a"]["tx"], k["b"]["ty"] - k["a"]["ty"]) <= 0.055) & (F.hypot(k["b"]["x"] - k["a"]["x"], k["b"]["y"] - k["a"]["y"]) <= 0.08))
    hit = ((F.col("d") <= 1.15) & (F.col("next.d") <= 1.4) & (F.col("next.t") - F.col("raw_time") <= 0.15) & (F.size("before") >= 3) & (F.col("raw_time") - F.get("before", F.lit(0))["t"] >= 0.18)
           & F.exists("before", lambda q: (q["d"] >= 2) & (q["y"] > F.col("y") + 0.018)) & smooth)
    step = F.array_max(F.transform(pairs, lambda k: k["b"]["t"] - k["a"]["t"]))
    g = df.where(X.truthy(hit)).groupBy("attempt_id").agg(F.min_by(F.struct("raw_time", "hand", step.alias("observation_interval_s"), F.size("seq").alias("support_frames")), F.struct("ord", "raw_time")).alias("r"))
    return g.select("attempt_id", "r.*")
