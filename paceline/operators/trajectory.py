"""Body trajectory of an attempt: chunks, local fits, speed, progress, crossings, sections, finish.

Every window below is partitioned by attempt and ordered by time, so the whole chain from raw
frames to metrics needs one exchange (the millisecond merge that opens it also bounds a group).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.dims import WALL_H, WALL_W
from .series import source_timing

GAP_S, MAX_SPEED, FIT_REACH_US = 0.25, 5.5, 360_000
SLACK = 1e-9
KEY = "attempt_id"


def _w() -> Window:
    return Window.partitionBy(KEY).orderBy("raw_time")


def _before() -> Window:
    return _w().rowsBetween(Window.unboundedPreceding, -1)


def merge_cursor_times(frames: DataFrame) -> DataFrame:
    """WN1: one frame per millisecond, the one with more body mass (the first on a tie)."""
    f = frames.where(X.finite("raw_time").isNotNull()).withColumn("_ms", X.round_ms("raw_time"))
    rest = [c for c in frames.columns if c not in (KEY, "raw_time")]
    g = f.groupBy(KEY, "_ms").agg(F.max_by(F.struct(*rest), F.struct(F.col("mass_coverage"), (-F.col("raw_time")))).alias("r"))
    return g.select(KEY, F.col("_ms").alias("raw_time"), "r.*")


def _inside(width: float, height: float, slack: float = 0.0) -> Column:
    x, y = F.col("wall_x"), F.col("wall_y")
    return (x >= -slack) & (x <= width + slack) & (y >= -slack) & (y <= height + slack)


def flag_frames(frames: DataFrame, width: float = WALL_W, height: float = WALL_H) -> DataFrame:
    """WN2 and WN4: repeated decoded frames, late times, points outside the wall."""
    t, d = source_timing()
    df = frames.withColumns({"source_time": t, "source_duration_s": d}).withColumn("sample_time", F.coalesce("source_time", "raw_time"))
    usable = X.truthy(F.col("valid") & _inside(width, height))
    rep = Window.partitionBy(KEY, "source_time").orderBy(usable.desc(), F.col("mass_coverage").desc(), "raw_time")
    df = df.withColumn("repeated", F.col("source_time").isNotNull() & (F.row_number().over(rep) > 1))
    seen = F.max(F.when(~F.col("repeated"), F.col("sample_time"))).over(_before())
    df = df.withColumn("late", ~F.col("repeated") & X.truthy(F.col("sample_time") <= seen))
    return df.withColumn("extrapolated", X.truthy(F.col("wall_x").isNotNull() & F.col("wall_y").isNotNull() & ~_inside(width, height, 1e-6)))


def chunk_frames(df: DataFrame) -> DataFrame:
    """WN5: continuous chunks and rejected jumps.

    A rejected jump empties the chunk, so the row after it is compared with nothing.  In a run of
    consecutive jumps the first, third, fifth ... are therefore the rejected ones, which is a position
    within an island and needs no state carried from row to row.
    """
    wall = F.col("wall_x").isNotNull() & F.col("wall_y").isNotNull()
    cand = ~F.col("repeated") & ~F.col("late") & F.col("valid") & wall & ~F.col("extrapolated")
    hard = ~F.col("repeated") & (F.col("late") | (F.col("valid") & wall & F.col("extrapolated")))
    df = df.withColumn("_cand", X.truthy(cand)).withColumn("_breaks", F.sum(F.when(X.truthy(hard), 1).otherwise(0)).over(_w()))
    prev = F.last(F.when(F.col("_cand"), F.struct("sample_time", "wall_x", "wall_y", "_breaks")), ignorenulls=True).over(_before())
    df = df.withColumn("_p", prev)
    dt = F.col("sample_time") - F.col("_p.sample_time")
    cut = F.col("_p").isNull() | (F.col("_breaks") != F.col("_p._breaks")) | (dt > GAP_S)
    jump = F.col("_cand") & ~cut & (dt > 1e-9) & (F.hypot(F.col("wall_x") - F.col("_p.wall_x"), F.col("wall_y") - F.col("_p.wall_y")) / dt > MAX_SPEED)
    df = df.withColumn("_cut", F.col("_cand") & cut).withColumn("_jump", X.truthy(jump))
    order = F.sum(F.col("_cand").cast("int")).over(_w())
    df = df.withColumn("_o", order).withColumn("_calm", F.max(F.when(F.col("_cand") & ~F.col("_jump"), F.col("_o"))).over(_w()))
    df = df.withColumn("raw_jump", F.col("_jump") & ((F.col("_o") - F.col("_calm")) % 2 == 1))
    was_rejected = F.last(F.when(F.col("_cand"), F.col("raw_jump")), ignorenulls=True).over(_before())
    start = F.col("_cand") & ~F.col("raw_jump") & (F.col("_cut") | X.truthy(was_rejected))
    chunk = F.sum(F.when(start, 1).otherwise(0)).over(_w())
    return (df.withColumn("chunk_id", F.when(F.col("_cand") & ~F.col("raw_jump"), chunk))
            .drop("_cand", "_breaks", "_p", "_cut", "_jump", "_o", "_calm"))


def fit_chunks(df: DataFrame, smoothing: float = 0.2) -> DataFrame:
    """WN7: Gaussian-weighted linear fit around every sample of a chunk.

    Neighbours come from a bounded range frame (the fit never reaches further than FIT_REACH_US), so no
    self join is needed; seven sums are folded over that short array.
    """
    if not 0 < smoothing <= 0.35:
        raise ValueError("smoothing must lie in (0, 0.35] seconds")
    inc = Window.partitionBy(KEY, "chunk_id").orderBy("raw_time")
    step = F.when(F.col("chunk_id").isNotNull(), F.col("sample_time") - F.lag("sample_time").over(inc))
    df = df.withColumn("_step", step)
    df = df.withColumn("_win", F.greatest(F.lit(smoothing), F.lit(0.05), F.coalesce(F.max("_step").over(Window.partitionBy(KEY, "chunk_id")), F.lit(0.0))))
    df = df.withColumn("_us", F.floor(F.col("sample_time") * 1000000 + 0.5).cast("bigint"))
    near = Window.partitionBy(KEY, "chunk_id").orderBy("_us").rangeBetween(-FIT_REACH_US, FIT_REACH_US)
    df = df.withColumn("_near", F.collect_list(F.struct("sample_time", "wall_x", "wall_y")).over(near))
    sigma = F.greatest(F.col("_win") / 2, F.lit(0.025))
    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("s0", "s1", "s2", "x0", "x1", "y0", "y1")])

    def add(a, p):
        tau = p["sample_time"] - F.col("sample_time")
        w = F.when(F.abs(tau) <= F.col("_win") + 1e-9, F.exp(-0.5 * (tau / sigma) * (tau / sigma))).otherwise(0.0)
        return F.struct((a["s0"] + w).alias("s0"), (a["s1"] + w * tau).alias("s1"), (a["s2"] + w * tau * tau).alias("s2"), (a["x0"] + w * p["wall_x"]).alias("x0"),
                        (a["x1"] + w * tau * p["wall_x"]).alias("x1"), (a["y0"] + w * p["wall_y"]).alias("y0"), (a["y1"] + w * tau * p["wall_y"]).alias("y1"))
    df = df.withColumn("_f", F.when(F.col("chunk_id").isNotNull(), F.aggregate("_near", zero, add)))
    f = lambda n: F.col(f"_f.{n}")
    den = f("s0") * f("s2") - f("s1") * f("s1")
    flat = F.abs(den) < 1e-12
    pos = lambda a: F.when(flat, f(f"{a}0") / f("s0")).otherwise((f("s2") * f(f"{a}0") - f("s1") * f(f"{a}1")) / den)
    vel = lambda a: F.when(~flat, (f("s0") * f(f"{a}1") - f("s1") * f(f"{a}0")) / den)
    df = df.withColumns({"fit_x": pos("x"), "fit_y": pos("y"), "_vx": vel("x"), "_vy": vel("y")})
    speed = F.hypot("_vx", "_vy")
    ok = speed <= MAX_SPEED
    return df.withColumns({"fit_jump": X.truthy(speed > MAX_SPEED), "speed_x": F.when(ok, F.col("_vx")), "speed_y": F.when(ok, F.col("_vy")), "speed": F.when(ok, speed)}).drop("_step", "_win", "_us", "_near", "_f", "_vx", "_vy")


def excluded() -> Column:
    """PRJ37: a frame that must not contribute to a path or a chart."""
    return F.col("extrapolated") | F.col("raw_jump") | F.col("fit_jump") | F.col("repeated") | F.col("late")


def metric_chunks(df: DataFrame, need_speed: bool = False, chart: bool = False) -> DataFrame:
    """WN6: chunks of the fitted path; an excluded row is a hard boundary, never bridged.

    ``chart`` also breaks at unusable poses (the presentation rule).
    """
    stop = excluded()
    if need_speed:
        stop = stop | F.col("speed").isNull()
    if chart:
        stop = stop | ~X.truthy(F.col("valid")) | ~F.coalesce("pose_selected", F.lit(True)) | F.col("fit_y").isNull()
    df = df.withColumn("_b", F.sum(F.when(~F.col("repeated") & stop, 1).otherwise(0)).over(_w()))
    member = ~F.col("repeated") & ~stop & F.col("fit_y").isNotNull()
    df = df.withColumn("_m", member)
    p = F.last(F.when(F.col("_m"), F.struct("sample_time", "_b")), ignorenulls=True).over(_before())
    df = df.withColumn("_p", p)
    new = F.col("_m") & (F.col("_p").isNull() | (F.col("_p._b") != F.col("_b")) | (F.col("sample_time") - F.col("_p.sample_time") > GAP_S))
    return df.withColumn("metric_chunk", F.when(F.col("_m"), F.sum(F.when(new, 1).otherwise(0)).over(_w()))).drop("_b", "_m", "_p")


def kinematics(frames: DataFrame, smoothing: float = 0.2) -> DataFrame:
    """The chain WN1, WN2, WN4, WN5, WN7, WN6."""
    return metric_chunks(fit_chunks(chunk_frames(flag_frames(merge_cursor_times(frames))), smoothing))


def with_peak_candidates(kin: DataFrame, fps: float) -> DataFrame:
    """WN8: ``peak_candidate`` is the speed inside runs of at least three samples no further than 0.125 s apart."""
    w = Window.partitionBy(KEY, "metric_chunk").orderBy("raw_time")
    apart = F.col("sample_time") - F.lag("sample_time").over(w) > 0.125 + 1e-6
    m = kin.withColumn("_run", F.sum(F.when(X.truthy(apart) | F.col("speed").isNull(), 1).otherwise(0)).over(w))
    inside = F.col("metric_chunk").isNotNull() & (F.count("speed").over(Window.partitionBy(KEY, "metric_chunk", "_run")) >= 3) & F.lit(fps >= 8)
    return m.withColumn("peak_candidate", F.when(inside, F.col("speed"))).drop("_run")


def peak_speeds(kin: DataFrame, fps: float) -> DataFrame:
    return with_peak_candidates(kin, fps).groupBy(KEY).agg(F.max("peak_candidate").alias("peak_speed")).where("peak_speed is not null")


def metrics(kin: DataFrame, fps: float = 10.0, min_mass: float = 0.75, automatic: bool = False, calibration_confidence: str = "High") -> DataFrame:
    """AG10 and AG11: coverage, path, speeds, quality grade and warning codes of each attempt."""
    w = Window.partitionBy(KEY, "metric_chunk").orderBy("raw_time")
    inside = F.col("metric_chunk").isNotNull()
    step = F.when(inside, F.hypot(F.col("fit_x") - F.lag("fit_x").over(w), F.col("fit_y") - F.lag("fit_y").over(w)))
    df = with_peak_candidates(kin.withColumn("_step", step), fps)
    ok = F.col("valid") & F.col("wall_x").isNotNull() & ~excluded()
    count = F.count_if
    ends = lambda agg: agg(F.when(inside, F.struct("raw_time", "sample_time", "fit_x", "fit_y")))
    detected = F.when(F.col("candidate_count").isNotNull(), F.col("candidate_count") > 0).otherwise(F.col("pose_detected"))
    per = df.groupBy(KEY, "metric_chunk").agg(
        F.count("*").alias("n"), count(X.truthy(detected)).alias("det"), count(X.truthy(F.coalesce("pose_selected", "pose_detected"))).alias("sel"), count(X.truthy(ok)).alias("val"),
        F.sum(F.when(X.truthy(ok), F.col("mass_coverage"))).alias("mass"), F.sum("_step").alias("path"), F.max("peak_candidate").alias("peak"), ends(F.min).alias("a"), ends(F.max).alias("z"),
        F.bool_or("extrapolated").alias("ext"), F.bool_or("raw_jump").alias("rj"), F.bool_or("fit_jump").alias("fj"), F.bool_or("repeated").alias("rep"), F.bool_or("late").alias("late"))
    long = F.col("metric_chunk").isNotNull() & (F.col("z.raw_time") > F.col("a.raw_time"))
    g = per.groupBy(KEY).agg(
        F.sum("n").alias("requested"), F.sum("det").alias("detected"), F.sum("sel").alias("selected"), F.sum("val").alias("valid_frames"), F.sum("mass").alias("_mass"), F.sum("path").alias("_path"),
        F.sum(F.when(long, F.col("z.sample_time") - F.col("a.sample_time"))).alias("_active"), F.sum(F.when(long, F.hypot(F.col("z.fit_x") - F.col("a.fit_x"), F.col("z.fit_y") - F.col("a.fit_y")))).alias("_chord"),
        F.sum(F.when(long, F.col("z.fit_y") - F.col("a.fit_y"))).alias("_gain"), F.count("metric_chunk").alias("chunks"), F.max("peak").alias("peak_speed"),
        *[F.bool_or(c).alias(c) for c in ("ext", "rj", "fj", "rep", "late")])
    r = F.col("requested").cast("double")
    g = g.withColumns({"detection_coverage": F.col("detected") / r, "tracking_coverage": F.col("selected") / r, "valid_coverage": F.col("valid_frames") / r,
                       "mean_mass": F.coalesce(F.col("_mass") / F.nullif("valid_frames", F.lit(0)), F.lit(0.0)), "_p": F.coalesce("_path", F.lit(0.0)), "_t": F.coalesce("_active", F.lit(0.0))})
    moved = F.col("_p") > 1e-9
    quality = X.when_chain([
        ((F.col("tracking_coverage") >= 0.9) & (F.col("valid_coverage") >= 0.85) & (F.col("mean_mass") >= 0.92) & ~F.col("ext") & ~F.col("fj"), "High"),
        ((F.col("tracking_coverage") >= 0.7) & (F.col("valid_coverage") >= 0.6) & (F.col("mean_mass") >= min_mass), "Medium")], F.lit("Needs review"))
    if automatic:
        quality = F.when(F.lit(calibration_confidence == "Low") | (quality == "Needs review"), "Needs review").otherwise("Medium")
    flag = lambda cond, code: F.when(cond, F.lit(code))
    warnings = F.array_compact(F.array(
        flag(F.lit(automatic), "automatic-scale"), flag(F.col("detection_coverage") < 0.8, "detection-low"), flag(F.col("tracking_coverage") < F.col("detection_coverage") - 0.05, "association-low"),
        flag(F.col("valid_coverage") < 0.7, "valid-low"), flag(F.col("ext"), "outside-wall"), flag(F.col("rj"), "raw-jump"), flag(F.col("fj"), "speed-spike"), flag(F.col("chunks") > 1, "tracking-gaps"),
        flag(F.col("peak_speed").isNull(), "peak-hidden"), flag(F.col("rep"), "repeated-frames"), flag(F.col("late"), "late-times")))
    r6 = lambda c: X.round_us(c)
    return g.select(
        KEY, "requested", "detected", "selected", "valid_frames", r6("detection_coverage").alias("detection_coverage"), r6("tracking_coverage").alias("tracking_coverage"), r6("valid_coverage").alias("valid_coverage"),
        r6("mean_mass").alias("mean_mass"), r6(F.when((F.col("_t") > 0) & moved, F.col("_p") / F.col("_t"))).alias("average_speed"), r6("peak_speed").alias("peak_speed"),
        r6(F.when(F.col("_t") > 0, F.col("_gain"))).alias("vertical_gain"), r6(F.when(moved, F.col("_p"))).alias("path_length"), r6(F.when(moved, F.least(F.lit(1.0), F.coalesce("_chord", F.lit(0.0)) / F.col("_p")))).alias("path_efficiency"),
        quality.alias("quality"), warnings.alias("warnings"))


# --- progress, crossings, sections ------------------------------------------------------------

def route_progress(kin: DataFrame, height: float = WALL_H) -> DataFrame:
    """WN9: upward-only progress of trusted samples, with a chunk id that breaks at gaps and barriers."""
    t = Window.partitionBy(KEY).orderBy("sample_time").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    stop = excluded()
    df = kin.withColumn("_bar", F.max(F.when(stop & ~F.col("repeated"), F.col("sample_time"))).over(t))
    s = df.where(~stop & F.col("valid") & F.col("fit_y").isNotNull())
    s = s.groupBy(KEY, F.col("sample_time").alias("t")).agg(F.max(X.clamp("fit_y", 0.0, height)).alias("h"), F.max("_bar").alias("_bar"))
    w = Window.partitionBy(KEY).orderBy("t")
    p = F.lag("t").over(w)
    cut = X.truthy((F.col("t") - p > GAP_S + 1e-9) | (F.col("_bar") >= p))
    return (s.withColumn("chunk", F.sum(cut.cast("int")).over(w)).withColumn("progress", F.max("h").over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .select(KEY, "t", "progress", "chunk"))


def progress_pairs(progress: DataFrame) -> DataFrame:
    w = Window.partitionBy(KEY).orderBy("t")
    return progress.withColumns({"t0": F.lag("t").over(w), "p0": F.lag("progress").over(w), "c0": F.lag("chunk").over(w), "first": F.row_number().over(w) == 1})


def crossings(pairs: DataFrame, height: float = WALL_H) -> DataFrame:
    """WN10: time at which progress crosses a third, half and two thirds; never guessed inside a gap."""
    fr = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(v).alias("v")) for n, v in (("third", 1 / 3), ("half", 1 / 2), ("two_thirds", 2 / 3))])
    df = pairs.withColumn("f", F.explode(fr)).withColumn("h", F.lit(height) * F.col("f.v"))
    up = (F.col("p0") < F.col("h")) & (F.col("progress") >= F.col("h"))
    gap = (F.col("c0") != F.col("chunk")) | (F.col("t") - F.col("t0") > GAP_S + 1e-9)
    rise = F.col("progress") - F.col("p0")
    at = F.col("t0") + (F.col("t") - F.col("t0")) * F.when(rise > 1e-9, X.clamp((F.col("h") - F.col("p0")) / rise, 0.0, 1.0)).otherwise(1.0)
    row = X.when_chain([
        (F.col("first") & (F.abs(F.col("progress") - F.col("h")) <= 1e-6), F.struct(F.col("t").alias("at"), F.lit("crossed").alias("state"))),
        (F.col("first") & (F.col("progress") > F.col("h")), F.struct(F.lit(None).cast("double").alias("at"), F.lit("started-above").alias("state"))),
        (up & gap, F.struct(F.lit(None).cast("double").alias("at"), F.lit("inside-gap").alias("state"))), (up, F.struct(at.alias("at"), F.lit("crossed").alias("state")))])
    g = df.withColumn("_r", row).groupBy(KEY, F.col("f.n").alias("boundary")).agg(F.min_by("_r", F.when(F.col("_r").isNotNull(), F.col("t"))).alias("r"))
    return g.select(KEY, "boundary", F.col("r.at").alias("crossing_s"), F.coalesce("r.state", F.lit("not-reached")).alias("state"))


def interval_evidence(pairs: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """WN11: observed share, duration and gain of each [range_start, range_end]."""
    return range_evidence(ranges.join(pairs.where("c0 = chunk and t > t0").select(KEY, "t0", "t", "p0", "progress", "c0", "chunk"), KEY, "left"), keys)


def range_evidence(j: DataFrame, keys: list[str]) -> DataFrame:
    """WN11 for pairs that carry their range_start and range_end as columns: no join."""
    a, b = F.greatest("range_start", "t0"), F.least("range_end", "t")
    on = (F.col("c0") == F.col("chunk")) & (F.col("t") > F.col("t0")) & (b > a)
    share = (b - a) / (F.col("t") - F.col("t0"))
    g = j.groupBy(*keys, "range_start", "range_end").agg(F.sum(F.when(on, b - a)).alias("_d"), F.sum(F.when(on, F.greatest(F.lit(0.0), (F.col("progress") - F.col("p0")) * share))).alias("_g"))
    span = F.col("range_end") - F.col("range_start")
    d = F.coalesce("_d", F.lit(0.0))
    return g.select(*keys, "range_start", "range_end", F.when(span > 0, d).otherwise(0.0).alias("observed_s"), F.when(span > 0, F.coalesce("_g", F.lit(0.0))).otherwise(0.0).alias("observed_gain"),
                    F.when(span > 0, d / span).otherwise(0.0).alias("coverage"))


def sections(pairs: DataFrame, results: DataFrame, height: float = WALL_H) -> DataFrame:
    """AG18: lower, middle and top third of each attempt with duration, pace and confidence.

    ``results``: attempt_id, start_s, end_s, valid_coverage, calibration_confidence.
    """
    c = crossings(pairs, height).groupBy(KEY).agg(*[F.max(F.when(F.col("boundary") == b, F.col("crossing_s"))).alias(b) for b in ("third", "two_thirds")])
    r = results.join(c, KEY, "left")
    rng = F.array(*[F.struct(F.lit(n).alias("section"), a.alias("range_start"), z.alias("range_end")) for n, a, z in (
        ("lower", F.col("start_s"), F.col("third")), ("middle", F.col("third"), F.col("two_thirds")), ("top", F.col("two_thirds"), F.col("end_s")),
        ("whole", F.col("start_s"), F.col("end_s")), ("to_third", F.col("start_s"), F.col("third")), ("to_two_thirds", F.col("start_s"), F.col("two_thirds")))])
    ranges = r.select(KEY, F.explode(rng).alias("s")).select(KEY, "s.*").where("range_end > range_start")
    ev = interval_evidence(pairs, ranges, [KEY, "section"])
    conf = lambda cov: X.conf_rank(X.coverage_confidence(F.least(cov, F.col("valid_coverage"))))
    e = ev.join(results.select(KEY, "valid_coverage", "calibration_confidence"), KEY).withColumn("_r", conf(F.least(F.col("coverage"), F.lit(1.0)))).withColumn("_cal", X.conf_rank("calibration_confidence"))
    n = Window.partitionBy(KEY)
    cross_rank = lambda s: F.max(F.when(F.col("section") == s, F.least("_r", "_cal"))).over(n)
    e = e.withColumns({"_c1": cross_rank("to_third"), "_c2": cross_rank("to_two_thirds"), "_whole": F.max(F.when(F.col("section") == "whole", F.col("_r"))).over(n)})
    rank = F.when(F.col("section") == "lower", F.least("_r", "_c1")).when(F.col("section") == "middle", F.least("_r", "_c1", "_c2")).otherwise(F.least("_r", "_c2"))
    cov = F.least(F.col("coverage"), F.lit(1.0))
    pace = F.when((cov >= 0.6) & (F.col("observed_s") >= 0.5) & (F.col("observed_gain") >= 0.25), F.col("observed_gain") / F.col("observed_s"))
    return e.where("section in ('lower','middle','top')").select(
        KEY, F.col("section").alias("section_id"), "range_start", "range_end", (F.col("range_end") - F.col("range_start")).alias("section_time_s"), X.round_us(cov).alias("tracking_coverage"),
        X.round_us(pace).alias("vertical_pace"), X.conf_name(rank).alias("confidence"), X.conf_name(F.least("_whole", "_cal")).alias("route_confidence"))


def pacing(section_rows: DataFrame) -> DataFrame:
    """AG18: the slowest third, or even pacing, when all three are known and trusted."""
    t = lambda s: F.max(F.when(F.col("section_id") == s, F.col("section_time_s")))
    g = section_rows.groupBy(KEY).agg(F.count("*").alias("known"), t("lower").alias("lower_s"), t("middle").alias("middle_s"), t("top").alias("top_s"), F.max(F.col("route_confidence")).alias("route_confidence"))
    slow, fast = F.greatest("lower_s", "middle_s", "top_s"), F.least("lower_s", "middle_s", "top_s")
    ready = (F.col("known") == 3) & F.col("route_confidence").isin("Medium", "High")
    apart = slow - fast > F.greatest(F.lit(0.15), fast * 0.08)
    name = F.when(F.col("lower_s") == slow, "lower").when(F.col("middle_s") == slow, "middle").otherwise("top")
    return g.select(KEY, "known", F.when(ready & apart, name).alias("slowest_section"), (ready & ~apart).alias("even_pacing"))


def speed_trace(kin: DataFrame, results: DataFrame) -> DataFrame:
    """WN12: share of [start, end] covered by the speed trace, and the number of gaps."""
    c = metric_chunks(kin, need_speed=True, chart=True).where("metric_chunk is not null")
    iv = c.groupBy(KEY, "metric_chunk").agg(F.count("*").alias("n"), F.min("sample_time").alias("a"), F.max("sample_time").alias("z")).where("n >= 2")
    j = results.join(iv, KEY, "left").withColumns({"a": F.greatest("a", "start_s"), "z": F.least("z", "end_s")})
    j = j.withColumn("_on", F.coalesce(F.col("z") > F.col("a"), F.lit(False)))
    w = Window.partitionBy(KEY).orderBy(F.when(F.col("_on"), F.col("a")).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    cursor = F.greatest(F.col("start_s"), F.coalesce(F.max(F.when(F.col("_on"), F.col("z"))).over(w), F.col("start_s")))
    j = j.withColumn("_gap", F.when(F.col("_on"), F.greatest(F.col("a") - cursor, F.lit(0.0))))
    g = j.groupBy(KEY, "start_s", "end_s").agg(F.sum("_gap").alias("_in"), F.count_if(F.col("_gap") > 0).alias("_k"), F.greatest(F.max(F.when(F.col("_on"), F.col("z"))), F.first("start_s")).alias("_last"))
    tail = F.col("end_s") - F.coalesce("_last", F.col("start_s"))
    missing = F.coalesce("_in", F.lit(0.0)) + F.greatest(tail, F.lit(0.0))
    return g.select(KEY, (F.col("_k") + (tail > 0).cast("int")).alias("gaps"), X.round_us(X.clamp(1 - missing / (F.col("end_s") - F.col("start_s")), 0.0, 1.0)).alias("coverage"))


# --- finish -----------------------------------------------------------------------------------

def progress_samples(kin: DataFrame, limits: DataFrame) -> DataFrame:
    """Frames usable for the finish test: selected poses with a position, up to the hard limit.

    Of heights that only the noise of a fit tells apart, the first is the peak.
    """
    x, y = F.coalesce("fit_x", "wall_x"), F.coalesce("fit_y", "wall_y")
    s = flag_samples(kin.join(limits.select(KEY, "hard_limit_s"), KEY)).where("usable")
    return s.select(KEY, "raw_time", "x", "y", "idx", "n", "peak_y", "peak_idx")


def flag_samples(kin: DataFrame) -> DataFrame:
    """The samples of ``progress_samples`` among all frames, for ``kin`` with hard_limit_s: ``usable``, numbered, with their peak."""
    x, y = F.coalesce("fit_x", "wall_x"), F.coalesce("fit_y", "wall_y")
    usable = X.truthy((F.col("raw_time") <= F.col("hard_limit_s") + 1e-9) & F.coalesce("pose_selected", F.lit(True)) & y.isNotNull() & x.isNotNull())
    s = kin.withColumn("usable", usable).withColumns({"x": F.when(F.col("usable"), x), "y": F.when(F.col("usable"), y)})
    w, one = Window.partitionBy(KEY), F.col("usable").cast("int")
    s = s.withColumns({"idx": F.when(F.col("usable"), F.sum(one).over(_w()) - 1), "n": F.sum(one).over(w), "peak_y": F.max("y").over(w)})
    return s.withColumn("peak_idx", F.min(F.when(F.col("y") >= F.col("peak_y") - SLACK, F.col("idx"))).over(w))


def terminal_descent(samples: DataFrame, fps: float = 10.0, height: float = WALL_H) -> DataFrame:
    """WN13 and WN14: the peak, its plateau start, and whether a sustained descent follows."""
    s = samples.withColumns({"_py": F.lag("y").over(_w()), "_pt": F.lag("raw_time").over(_w())})
    return _descent(s, [KEY], fps, height)


def _descent(s: DataFrame, keys: list[str], fps: float, height: float, *more: Column) -> DataFrame:
    """``terminal_descent`` of numbered samples with the sample before each (_py, _pt); rows without idx count for nothing."""
    min_drop, min_time, max_gap = max(0.8, height * 0.06), max(0.45, 3 / max(1.0, fps)), max(0.34, 2.25 / max(1.0, fps))
    tol = max(0.14, height * 0.012)
    # last step before the peak that leaves the plateau (a gap, or a sample below it)
    leaves = (F.col("raw_time") - F.col("_pt") > max_gap + 1e-9) | (F.col("_py") < F.col("peak_y") - tol - SLACK) | (F.col("idx") == 0)
    s = s.withColumn("_plateau", F.max(F.when((F.col("idx") <= F.col("peak_idx")) & leaves, F.col("idx"))).over(Window.partitionBy(KEY)))
    post = F.col("idx") >= F.col("peak_idx")
    step = post & (F.col("idx") > F.col("peak_idx"))
    k = F.col("n") - F.col("peak_idx")
    late = post & (F.col("idx") - F.col("peak_idx") >= F.greatest(F.lit(1), F.floor(k * 0.6)))
    tail = F.when(post & (F.col("idx") >= F.col("n") - 3), F.col("y"))
    ch = F.col("y") - F.col("_py")
    g = s.groupBy(*keys).agg(
        *more, F.max("n").alias("n"), F.max("peak_y").alias("peak_y"), F.max(F.when(F.col("idx") == F.col("peak_idx"), F.col("raw_time"))).alias("peak_s"), F.max(F.when(F.col("idx") == F.col("_plateau"), F.col("raw_time"))).alias("plateau_s"),
        F.min(F.when(F.col("idx") <= F.col("peak_idx"), F.col("y"))).alias("_low"), F.max(k).alias("descent_samples"), F.percentile(tail, F.lit(0.5)).alias("_tail"), F.max(F.when(F.col("idx").isNotNull(), F.col("raw_time"))).alias("_end"),
        F.sum(F.when(step & (ch < 0), -ch)).alias("_down"), F.sum(F.when(step & (ch > 0), ch)).alias("_up"), F.max(F.when(step, F.col("raw_time") - F.col("_pt"))).alias("_gap"), F.max(F.when(late, F.col("y"))).alias("_late"))
    drop = F.greatest(F.lit(0.0), F.col("peak_y") - F.col("_tail"))
    dur = F.col("_end") - F.col("peak_s")
    total = F.coalesce("_down", F.lit(0.0)) + F.coalesce("_up", F.lit(0.0))
    ratio = F.when(total > 1e-9, F.coalesce("_down", F.lit(0.0)) / total).otherwise(0.0)
    gap = F.coalesce("_gap", F.lit(0.0))
    ok = (F.col("descent_samples") >= 4) & (drop >= min_drop) & (dur >= min_time) & (ratio >= 0.65) & (gap <= max_gap + 1e-9) & (F.coalesce("_late", F.col("peak_y")) <= F.col("peak_y") - min_drop * 0.35)
    return g.select(*keys, *[c for c in ("hand_distance_m", "hand_s") if c in g.columns], "n", "peak_s", "peak_y", "plateau_s", (F.col("peak_y") - F.col("_low")).alias("upward_gain"), "descent_samples", drop.alias("drop_m"), dur.alias("descent_s"), ratio.alias("downward_ratio"),
                    gap.alias("max_gap_s"), ok.alias("descent_accepted"))


def closest_hand(hands: DataFrame, descent: DataFrame, limits: DataFrame) -> DataFrame:
    """WN15: the hand sample closest to the last hold from 1.2 s before to 0.6 s after the peak.

    ``hands``: attempt_id, raw_time, distance_m of visible projected hand landmarks.
    """
    j = hands.join(descent.select(KEY, "peak_s"), KEY).join(limits.select(KEY, "hard_limit_s"), KEY)
    j = j.where((F.col("raw_time") <= F.col("hard_limit_s") + 1e-9) & (F.col("raw_time") >= F.col("peak_s") - 1.2) & (F.col("raw_time") <= F.col("peak_s") + 0.6))
    return j.groupBy(KEY).agg(F.min(F.struct("distance_m", F.col("raw_time").alias("hand_s"))).alias("h")).select(KEY, F.col("h.distance_m").alias("hand_distance_m"), "h.hand_s")


def finish_cutoff(descent: DataFrame, hands: DataFrame, limits: DataFrame, height: float = WALL_H) -> DataFrame:
    """WN16: where the climb ends.  ``limits``: hard_limit_s, accepted_finish_s, quality, calibration_confidence."""
    return _cutoff(limits.join(descent, KEY, "left").join(hands, KEY, "left"), height)


def _cutoff(d: DataFrame, height: float) -> DataFrame:
    top = F.col("peak_y") >= height * 0.82
    hand = X.truthy((F.col("hand_distance_m") <= 0.65) & (F.col("peak_y") >= height * 0.68))
    done = X.truthy((F.col("n") >= 5) & (top | hand) & (F.col("upward_gain") >= max(3.0, height * 0.25)) & F.col("descent_accepted"))
    by_hand = done & hand & X.truthy((F.col("hand_s") >= F.col("plateau_s") - 0.8) & (F.col("hand_s") <= F.col("peak_s") + 0.4))
    cut = F.when(done, F.least("hard_limit_s", F.when(by_hand, F.col("hand_s")).otherwise(F.col("plateau_s")))).otherwise(F.col("hard_limit_s"))
    base = F.when(F.col("accepted_finish_s").isNotNull() & (F.col("accepted_finish_s") <= F.col("hard_limit_s")), "accepted-finish").otherwise("analysis-end")
    conf = X.when_chain([(~done, F.when(base == "accepted-finish", "High").otherwise("Low")), ((F.col("quality") == "Needs review") | (F.col("calibration_confidence") == "Low"), "Low"),
                         (by_hand & (F.col("quality") == "High"), "High")], F.lit("Medium"))
    return d.select(KEY, cut.alias("cutoff_s"), F.when(done, "top-completion").otherwise(base).alias("source"), conf.alias("confidence"), by_hand.alias("hand_defined"))


LIMITS = ["hard_limit_s", "accepted_finish_s", "quality", "calibration_confidence"]


def finish_cutoffs(kin: DataFrame, fps: float = 10.0, height: float = WALL_H) -> DataFrame:
    """WN13 to WN16 in one pass: ``kin`` also carries distance_m (see ``closest_hand``; NULL where no hand is seen) and the limits of its attempt."""
    w = Window.partitionBy(KEY)
    s = flag_samples(kin.select(KEY, "raw_time", "fit_x", "wall_x", "fit_y", "wall_y", "pose_selected", "distance_m", *LIMITS))
    last = F.last(F.when(F.col("usable"), F.struct("y", "raw_time")), ignorenulls=True).over(_before())
    s = s.withColumns({"_last": last, "_peak_s": F.max(F.when(F.col("idx") == F.col("peak_idx"), F.col("raw_time"))).over(w)})
    s = s.withColumns({"_py": F.col("_last.y"), "_pt": F.col("_last.raw_time")})
    t = F.col("raw_time")
    near = F.col("distance_m").isNotNull() & (t <= F.col("hard_limit_s") + 1e-9) & (t >= F.col("_peak_s") - 1.2) & (t <= F.col("_peak_s") + 0.6)
    s = s.withColumn("_hand", F.when(near, F.struct("distance_m", F.col("raw_time").alias("hand_s"))))
    first = F.min("_hand")
    return _cutoff(_descent(s, [KEY, *LIMITS], fps, height, first["distance_m"].alias("hand_distance_m"), first["hand_s"].alias("hand_s")), height)


def trim_at(frames: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """WN16: raw frames up to the cutoff; run ``kinematics`` and ``metrics`` on the result again."""
    return frames.join(cutoffs.select(KEY, "cutoff_s"), KEY).where(F.col("raw_time") <= F.col("cutoff_s") + 1e-9).drop("cutoff_s")


def pose_finish_boundary(start, duration, light, light_accepted, official) -> tuple[Column, Column]:
    """PRJ19: (boundary, source): the accepted light, else the official finish, else nothing."""
    from .library import official_finish
    s, d, l = X.finite(start), X.finite(duration), X.finite(light)
    ready = X.truthy(d > s)
    lit_ok = X.truthy(X.c(light_accepted) & (l > s + 0.2) & (l <= d + 0.001))
    off = official_finish(start, duration, official)
    off_ok = X.truthy(off > s + 0.2)
    return (F.when(ready & lit_ok, F.least(d, l)).when(ready & off_ok, off), F.when(ready & lit_ok, "accepted-light").when(ready & off_ok, "official-time"))


def plot_x(m) -> Column:
    """FN23: plot coordinate of wall metres across."""
    return X.clamp(m, -0.36, 3.36) * 40.0 + 40.0


def plot_y(m) -> Column:
    return F.lit(620.0) - X.clamp(m, -0.75, 15.75) * 40.0
