"""Sampled series: grids, source-frame timing, smoothing, thresholds, segments, motion events.

A series is partitioned by its attempt and ordered by time.  Sample times are whole
milliseconds and repeated ones are merged by a partial aggregation first, so an attempt holds at
most 1000 rows per second of recording whatever the size of the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X

GRID_SLICE = 10_000


def sample_grid(df: DataFrame, start: str, end: str, fps: str, inside_only: bool = False) -> DataFrame:
    """GEN1: regular sample times from start to end, in whole milliseconds.

    A quarter step of overshoot is allowed unless ``inside_only``.  A range of any length is given in
    full, in slices of GRID_SLICE steps, so that no array grows with it.
    """
    steps = (F.col(end) - F.col(start)) * F.col(fps)
    n = F.floor(steps + 0.25).cast("bigint")
    ok = (F.col(end) >= F.col(start)) & (F.col(fps) > 0)
    first = F.explode(F.sequence(F.lit(0).cast("bigint"), n, F.lit(GRID_SLICE).cast("bigint")))
    out = (df.where(ok).withColumn("_first", first).withColumn("sample", F.explode(F.sequence(F.col("_first"), F.least(n, F.col("_first") + GRID_SLICE - 1)))).drop("_first")
           .withColumn("raw_time", X.round_ms(F.col(start) + F.col("sample") / F.col(fps))))
    return out.where(F.col("raw_time") <= F.col(end) + 1e-7) if inside_only else out


# --- source-frame timing ----------------------------------------------------------------------

def source_timing(raw="raw_time", decoded="decoded_time", duration="frame_duration_s") -> tuple[Column, Column]:
    """PRJ14: decoded-frame time and duration, kept only if the frame can contain the cursor."""
    r, t, d = X.finite(raw), X.finite(decoded), X.finite(duration)
    good = F.when(d.between(0.0001, 1.0), d)
    ok = X.truthy((t >= 0) & (t <= r + 0.005) & (r - t <= 0.5) & (good.isNull() | (r - t <= good + 0.005)))
    return F.when(ok, t), F.when(ok, good)


def with_sample_time(df: DataFrame) -> DataFrame:
    t, d = source_timing()
    return df.withColumns({"source_time": t, "source_duration_s": d}).withColumn("sample_time", F.coalesce("source_time", "raw_time"))


def first_per_source_frame(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """WN3: repeated seeks into one decoded frame count once (the first seen stays)."""
    key = F.when(F.col("source_time").isNotNull(), F.struct(F.lit("source").alias("k"), F.col("source_time").alias("t"))).otherwise(F.struct(F.lit("cursor").alias("k"), F.col("raw_time").alias("t")))
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys, key.alias("_frame")).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*"))


def source_timing_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """AG12: how many samples carry native timing, and how far cursors sat from their frames."""
    native = F.col("source_time").isNotNull()
    return df.groupBy(*keys).agg(
        F.count("*").alias("sampled_frames"), F.count("source_time").alias("native_frames"), F.count_distinct("source_time").alias("unique_native_frames"),
        X.round_us(F.max(F.when(native, F.col("raw_time") - F.col("source_time")))).alias("max_cursor_offset_s"),
        F.min("source_duration_s").alias("min_frame_duration_s"), F.max("source_duration_s").alias("max_frame_duration_s"))


def interval_at(samples: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """WN53: observation interval of the first sample within 1 ms of a target time."""
    w = Window.partitionBy(*keys).orderBy("raw_time")
    native = F.col("timestamp_method") == "video-frame"
    spacing = F.when(F.lag(native).over(w), X.observation_interval(F.col("raw_time") - F.lag("raw_time").over(w)))
    s = samples.withColumn("_iv", F.when(native, F.greatest(F.coalesce(X.observation_interval("frame_duration_s"), F.lit(0.0)), F.coalesce(spacing, F.lit(0.0)))))
    hit = F.abs(F.col("raw_time") - F.col("target_s")) <= 0.001
    j = targets.join(s.select(*keys, "raw_time", "_iv"), keys, "left").groupBy(*keys, "target_s").agg(F.min_by("_iv", F.when(hit, F.col("raw_time"))).alias("_iv"))
    return j.select(*keys, "target_s", F.when(F.col("_iv") > 0, F.col("_iv")).alias("observation_interval_s"))


# --- motion -----------------------------------------------------------------------------------

# Fixed values per sensitivity: least threshold, margin over the baseline, frames that must persist.
SENSITIVITY = {"low": (4.0, 3.0, 3), "medium": (1.0, 1.0, 2), "high": (0.5, 0.5, 1)}


def _seq(key: str = "attempt_id") -> Window:
    return Window.partitionBy(key).orderBy("raw_time")


def _whole(key: str = "attempt_id") -> Window:
    return Window.partitionBy(key)


def smooth(df: DataFrame, value: str, out: str) -> DataFrame:
    """WN24: (previous + 2 x current) / 3 in ms precision; looks back only."""
    v = F.col(value)
    return df.withColumn(out, X.round_ms((F.coalesce(F.lag(value).over(_seq()), v) + v * 2) / 3))


def numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("idx", F.row_number().over(_seq()) - 1).withColumn("n", F.count("*").over(_whole()))


def baseline_flag(df: DataFrame, start: str = "start_s", fallback: int = 5) -> DataFrame:
    """WN25: every sample before the start, or the first five when there is none."""
    pre = F.coalesce(F.col("raw_time") < F.col(start), F.lit(False))
    any_pre = F.max(pre).over(_whole())
    return df.withColumn("in_baseline", F.when(any_pre, pre).otherwise(F.col("idx") < fallback))


def robust_stats(df: DataFrame, value: str) -> DataFrame:
    """Median and median absolute deviation of the flagged samples, on every row of the attempt."""
    b = F.when(F.col("in_baseline"), F.col(value))
    df = df.withColumn("baseline", F.percentile(b, F.lit(0.5)).over(_whole()))
    return df.withColumn("mad", F.percentile(F.when(F.col("in_baseline"), F.abs(F.col(value) - F.col("baseline"))), F.lit(0.5)).over(_whole()))


def adaptive_threshold(fixed: float, add: float) -> Column:
    """AG28: max(fixed, median + add + 3 x MAD)."""
    return F.greatest(F.lit(fixed), F.col("baseline") + add + F.col("mad") * 3)


def motion_series(samples: DataFrame, sensitivity: str = "medium", pre_start: bool = True) -> DataFrame:
    """Smoothed samples with index, thresholds and the strongest sample of each attempt.

    All windows share one partitioning by attempt: a single exchange.
    """
    fixed, add, _ = SENSITIVITY[sensitivity]
    df = numbered(smooth(samples, "motion_score", "smoothed"))
    df = baseline_flag(df) if pre_start else df.withColumn("in_baseline", F.col("idx") < 5)
    df = robust_stats(df, "smoothed")
    df = df.withColumn("thr", X.round_ms(adaptive_threshold(fixed, add)))
    df = df.withColumn("committed_thr", X.round_ms(F.greatest(F.col("thr") * 1.8, F.col("baseline") * 2, F.col("thr") + 0.25)))
    return df.withColumn("spike_idx", F.min_by("idx", F.struct(-F.col("smoothed"), F.col("idx"))).over(_whole())).withColumn("max_motion", F.max("smoothed").over(_whole()))


def run_length(value: str, level: Column) -> Column:
    """Samples from here on that stay at or above a level, up to the first one below it."""
    ahead = _seq().rowsBetween(0, Window.unboundedFollowing)
    stop = F.min(F.when(F.col(value) < level, F.col("idx"))).over(ahead)
    return F.coalesce(stop, F.col("n")) - F.col("idx")


def motion_segments(series: DataFrame, level: float = 0.6) -> DataFrame:
    """WN26: maximal runs above 0.6 x threshold."""
    on = F.col("smoothed") >= F.col("thr") * level
    df = series.withColumn("_on", on).withColumn("_isl", F.sum(F.when(~on, 1).otherwise(0)).over(_seq()))
    return df.where("_on").groupBy("attempt_id", "_isl").agg(
        F.min("raw_time").alias("seg_start"), F.max("raw_time").alias("seg_end"), X.round_ms(F.max("raw_time") - F.min("raw_time")).alias("seg_duration"), F.max("smoothed").alias("max_motion"),
        X.round_ms(F.avg("smoothed")).alias("average_motion"), X.round_ms(F.sum("smoothed")).alias("total_motion"), F.count("*").alias("samples"),
        F.min(F.when(F.col("smoothed") >= F.col("committed_thr"), F.col("idx"))).alias("committed_idx"), F.first("start_s").alias("start_s")).drop("_isl")


def onset_index(return_level: Column) -> Column:
    """WN27: first sample of the climb to the spike: just after the last one at or below the level."""
    low = F.max(F.when((F.col("idx") < F.col("spike_idx")) & (F.col("smoothed") <= return_level), F.col("idx"))).over(_whole())
    return F.coalesce(low + 1, F.lit(0))


def motion_onset(series: DataFrame) -> DataFrame:
    level = F.col("baseline") + F.greatest(F.lit(0.08), (F.col("thr") - F.col("baseline")) * 0.25)
    return series.withColumn("onset_idx", onset_index(level))


def motion_confidence(motion, threshold, persistence, required: int, boundary, suspicious, area, fallback) -> Column:
    ratio = F.when(X.c(threshold) > 0, X.c(motion) / X.c(threshold)).otherwise(0.0)
    p = X.c(persistence)
    return X.when_chain([(X.c(boundary) | fallback | (area > 30), "Low"), (X.c(suspicious) & (ratio < 2.5), "Low"), ((ratio >= 1.55) & (p >= required), "High"),
                         ((ratio >= 1) & (p >= min(required, 2)), "Medium")], F.lit("Low"))


def movement_candidates(series: DataFrame, sensitivity: str = "medium", min_delay: float = 0.1, frame_interval: float = 1 / 15,
                        area_percent: float = 10.0, fallback_zone: bool = False) -> DataFrame:
    """WN28, first half: every proposal before near-duplicates are merged; ``ins`` is its order.

    Needs start_s and search_end per row.
    """
    required = SENSITIVITY[sensitivity][2]
    soft = min(2, required)
    fb, area = F.lit(fallback_zone), F.lit(area_percent)
    s = motion_onset(series)
    base_level = F.greatest(F.col("baseline") + 0.05, F.col("thr") * 0.35)
    s = s.withColumns({"p_base": run_length("smoothed", base_level), "p_low": run_length("smoothed", F.col("thr") * 0.6), "p_thr": run_length("smoothed", F.col("thr"))})
    climb = F.col("raw_time") - F.col("start_s")
    near = (climb >= 0) & (climb <= min(0.005, frame_interval * 0.1))
    edge = F.col("raw_time") >= F.col("search_end") - 0.1
    s = s.withColumns({"near": near, "edge": edge, "climb": X.round_ms(climb)})
    strong = F.col("max_motion") >= F.col("thr") * 0.6
    committed = (motion_segments(s).where(F.col("seg_start") - F.col("start_s") >= min_delay)
                 .groupBy("attempt_id").agg(F.max_by(F.struct("committed_idx"), F.struct((F.col("total_motion") * 1.2 + F.col("max_motion") * 2 + F.col("seg_duration")).alias("q"), (-F.col("seg_start")).alias("t"))).alias("c"))
                 .select("attempt_id", F.col("c.committed_idx").alias("committed_idx")))
    s = s.join(committed, "attempt_id", "left")
    preload = (F.col("max_motion") >= F.col("committed_thr")) & (F.col("smoothed") < F.col("committed_thr") * 0.6)
    late = F.col("near") | (climb < min_delay)

    def item(cond, ins, kind, conf, boundary, suspicious, persistence, pre=None):
        return F.when(cond, F.struct(ins.alias("ins"), kind.alias("kind"), conf.alias("confidence"), boundary.alias("boundary_risk"), suspicious.alias("suspicious"),
                                     persistence.cast("bigint").alias("persistence"), (pre if pre is not None else F.lit(False)).alias("preload")))
    conf = motion_confidence
    crosses = F.col("smoothed") >= F.col("thr")
    items = F.array_compact(F.array(
        item(strong & (F.col("idx") == F.col("onset_idx")), F.lit(0).cast("bigint"), F.when(preload, "Possible preload / weight shift").otherwise("Earliest Visible Motion"),
             conf("max_motion", "thr", "p_base", soft, F.lit(False), "near", area, fb), F.col("edge"), F.col("near"), F.col("p_base"), preload),
        item(F.col("idx") == F.col("committed_idx"), F.lit(1).cast("bigint"), F.lit("Committed Launch"), conf("smoothed", "committed_thr", "p_thr", soft, "edge", late, area, fb), F.col("edge"), late, F.col("p_thr")),
        item(F.col("smoothed") >= F.col("thr") * 0.6, F.col("idx") + 2, F.when(crosses, "First threshold crossing").otherwise("Earliest low-threshold motion"),
             conf("smoothed", "thr", "p_low", required, "edge", "near", area, fb), F.col("edge"), F.col("near"), F.col("p_low")),
        item(strong & (F.col("idx") == F.col("spike_idx")), F.col("n") + 2, F.lit("Largest Early Motion Spike"), conf("smoothed", "committed_thr", "p_thr", soft, "edge", "near", area, fb), F.col("edge"), F.col("near"), F.col("p_low"))))
    return (s.select("attempt_id", "raw_time", F.col("climb").alias("climb_time"), F.col("smoothed").alias("score"), "thr", "committed_thr", "max_motion", F.explode(items).alias("i"))
            .select("attempt_id", "raw_time", "climb_time", "score", "thr", "committed_thr", "max_motion", "i.*"))


def merge_candidates(cands: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """TOP5 for movement candidates: in insertion order each joins the first kept one within tolerance.

    The kept ones are state, so clusters are folded with ``aggregate``.  A gap wider than the tolerance
    separates candidates for good; the fold therefore runs per cluster, not per attempt.
    """
    w = Window.partitionBy("attempt_id").orderBy("raw_time", "ins")
    gap = F.coalesce(F.col("raw_time") - F.lag("raw_time").over(w) > tolerance + 1e-9, F.lit(True))
    same = ["thr", "committed_thr", "max_motion"]
    item = F.struct("ins", "raw_time", "climb_time", "score", F.array("kind").alias("kinds"), X.conf_rank("confidence").alias("conf"), "boundary_risk", "suspicious", "persistence", "preload")
    rows = (cands.withColumn("_c", F.sum(gap.cast("int")).over(w)).groupBy("attempt_id", "_c")
            .agg(F.sort_array(F.collect_list(item)).alias("items"), *[F.max(c).alias(c) for c in same]))

    def merged(k, r):
        return F.struct(k["ins"].alias("ins"), k["raw_time"].alias("raw_time"), k["climb_time"].alias("climb_time"), F.greatest(k["score"], r["score"]).alias("score"),
                        F.array_distinct(F.concat(k["kinds"], r["kinds"])).alias("kinds"), F.greatest(k["conf"], r["conf"]).alias("conf"), k["boundary_risk"].alias("boundary_risk"),
                        (k["suspicious"] | r["suspicious"]).alias("suspicious"), F.greatest(k["persistence"], r["persistence"]).alias("persistence"), (k["preload"] | r["preload"]).alias("preload"))

    def fold(kept, r):
        hit = F.array_position(F.transform(kept, lambda k: F.abs(k["raw_time"] - r["raw_time"]) <= tolerance), F.lit(True))
        return F.when(hit == 0, F.concat(kept, F.array(r))).otherwise(F.transform(kept, lambda k, i: F.when(i == hit - 1, merged(k, r)).otherwise(k)))
    kept = F.aggregate("items", F.slice("items", 1, 0), fold)
    return (rows.select("attempt_id", *same, F.explode(kept).alias("k")).select("attempt_id", *same, "k.*")
            .withColumn("kind", F.array_join("kinds", " + ")).withColumn("confidence", X.conf_name("conf")).drop("kinds", "conf"))


def movement_rank(required: int) -> Column:
    return (F.when(F.col("boundary_risk"), 100000.0).otherwise(0.0) + F.col("climb_time") * 100 - F.least(F.col("persistence"), F.lit(required)) * 18.0
            - F.least(F.col("score") / F.col("thr"), F.lit(2.0)) * 8.0)


def choose_movement(cands: DataFrame, sensitivity: str = "medium", definition: str = "earliest", min_delay: float = 0.1) -> DataFrame:
    """WN28, second half: ranked candidates with the selected one flagged."""
    required = SENSITIVITY[sensitivity][2]
    w = Window.partitionBy("attempt_id")
    df = cands.withColumn("rank_score", movement_rank(required)).withColumn("rank", F.row_number().over(w.orderBy("rank_score", "ins")))
    launch = F.col("kind").contains("Committed Launch")
    if definition == "committed":
        tier = F.when(launch & ~F.col("boundary_risk") & ~F.col("suspicious") & (F.col("climb_time") >= min_delay), 1)
    else:
        early = F.col("kind").isin("Earliest Visible Motion", "Possible preload / weight shift")
        reliable = (~F.col("boundary_risk") & (F.col("climb_time") >= 0) & (~F.col("suspicious") | (F.col("score") >= F.col("thr") * 2.5)) & (F.col("score") >= F.col("thr")) & (F.col("persistence") >= required))
        tier = X.when_chain([(early & (F.col("climb_time") >= 0) & (F.col("confidence") != "Low") & ~F.col("suspicious"), 1), (launch & (F.col("score") >= F.col("committed_thr")), 2), (reliable, 3)])
    df = df.withColumn("_tier", tier).withColumn("_best", F.min(F.when(F.col("_tier").isNotNull(), F.struct("_tier", "rank"))).over(w))
    return df.withColumn("selected", X.truthy(F.col("rank") == F.col("_best.rank"))).drop("_tier", "_best", "rank_score")


def present_candidates(ranked: DataFrame, limit: int = 6) -> DataFrame:
    """TOP3: the first six; a selected one outside them takes the sixth place."""
    w = Window.partitionBy("attempt_id")
    outside = F.max(F.when(F.col("selected"), F.col("rank"))).over(w) > limit
    return ranked.withColumn("_out", F.coalesce(outside, F.lit(False))).where((F.col("rank") < limit) | ((F.col("rank") == limit) & ~F.col("_out")) | F.col("selected")).drop("_out")


def movement_verdict(series: DataFrame, ranked: DataFrame) -> DataFrame:
    """WN29: one verdict per attempt."""
    first = F.min_by("smoothed", F.when(F.col("raw_time") >= F.col("start_s"), F.col("idx")))
    facts = series.groupBy("attempt_id").agg(F.max("smoothed").alias("max_motion"), first.alias("first_motion"), F.max("thr").alias("thr"), F.max("committed_thr").alias("committed_thr"),
                                             F.bool_or((F.col("raw_time") < F.col("start_s")) & (F.col("smoothed") >= F.col("thr"))).alias("pre_start_motion"))
    chosen = ranked.groupBy("attempt_id").agg(F.max(F.when(F.col("selected"), F.struct("raw_time", "climb_time", "confidence", "kind", "suspicious"))).alias("s"),
                                              F.min_by(F.struct("raw_time", "climb_time", F.lit("Low").alias("confidence"), "kind", "suspicious"), "rank").alias("top"))
    df = facts.join(chosen, "attempt_id", "left")
    pick = F.coalesce("s", F.when(F.col("max_motion") >= F.col("thr") * 0.6, F.col("top")))
    ratio = X.round_ms(F.col("first_motion") / F.nullif("max_motion", F.lit(0.0)))
    return df.withColumn("_p", pick).select("attempt_id", F.col("_p").isNotNull().alias("detected"), F.col("_p.raw_time").alias("raw_time"), F.col("_p.climb_time").alias("climb_time"),
                                            F.coalesce("_p.confidence", F.lit("None")).alias("confidence"), F.col("_p.kind").alias("kind"), X.truthy(ratio > 0.8).alias("already_underway"),
                                            F.coalesce("_p.suspicious", F.lit(False)).alias("first_frame"), F.coalesce("pre_start_motion", F.lit(False)).alias("pre_start_motion"))


def can_accept_movement(detected, confidence, first_frame, underway, raw, start, duration, finish) -> Column:
    """PRJ20."""
    f = X.finite(finish)
    return X.truthy(X.c(detected) & X.c(raw).isNotNull() & X.c(confidence).isin("Medium", "High") & ~X.c(first_frame) & ~X.c(underway) & (X.c(raw) >= X.c(start) + 0.1 - 1e-6)
                    & (X.c(raw) <= X.c(duration) + 0.001) & (f.isNull() | (X.c(raw) < f - 0.001)))


def top_peaks(series: DataFrame, k: int = 5) -> DataFrame:
    """TOP4."""
    w = Window.partitionBy("attempt_id").orderBy(F.col("smoothed").desc(), "idx")
    return series.withColumn("peak", F.row_number().over(w)).where(F.col("peak") <= k).select("attempt_id", "peak", "raw_time", F.col("smoothed").alias("motion"))


def motion_start_candidates(series: DataFrame, sensitivity: str, search_start: float, search_end: float, offset: float) -> DataFrame:
    """WN30: start = motion onset minus the reaction offset; three ways to find the onset.

    ``series`` comes from ``motion_series(..., pre_start=False)``: the baseline is the first five samples.
    """
    required = SENSITIVITY[sensitivity][2]
    s = series.withColumn("onset_idx", onset_index(F.col("thr") * 0.35)).withColumn("p_low", run_length("smoothed", F.col("thr") * 0.6))
    first = F.min(F.when((F.col("smoothed") >= F.col("thr")) & (F.col("p_low") >= min(2, required)), F.col("idx"))).over(_whole())
    s = s.withColumn("cross_idx", first)
    kinds = F.array_compact(F.array(*[F.when(F.col("idx") == F.col(c), F.struct(F.lit(o).alias("ins"), F.lit(k).alias("kind"))) for o, (c, k) in enumerate(
        (("onset_idx", "Earliest motion onset"), ("spike_idx", "Largest motion spike"), ("cross_idx", "First threshold crossing")))]))
    est = F.greatest(F.lit(0.0), X.round_ms(F.col("raw_time") - offset))
    df = s.select("attempt_id", est.alias("raw_time"), F.col("raw_time").alias("movement_time"), F.col("smoothed").alias("score"), "thr", "max_motion", F.greatest("p_low", F.lit(1)).cast("bigint").alias("persistence"), F.explode(kinds).alias("k"))
    edge = (F.col("raw_time") <= search_start + 0.1) | (F.col("raw_time") >= search_end - 0.25)
    df = df.withColumn("boundary_risk", edge).withColumn("confidence", F.when(~edge & (F.col("score") >= F.col("thr") * 1.4), "Medium").otherwise("Low"))
    w = Window.partitionBy("attempt_id")
    # pairwise order "time x 100 minus persistence x 12", earliest first
    df = df.withColumn("rank", F.row_number().over(w.orderBy(F.col("raw_time") * 100 - F.col("persistence") * 12, "k.ins")))
    good = ~F.col("boundary_risk") & (F.col("persistence") >= required)
    best = F.coalesce(F.min(F.when(good, F.col("rank"))).over(w), F.lit(1))
    detected = F.col("max_motion") >= F.col("thr") * 0.5
    return df.select("attempt_id", "rank", F.col("k.kind").alias("kind"), "raw_time", "movement_time", "score", "persistence", "boundary_risk", "confidence", ((F.col("rank") == best) & detected).alias("selected"))


# --- colour -----------------------------------------------------------------------------------

def colour_start_candidates(samples: DataFrame, threshold: float, required: int, sharp: float, search_start: float, search_end: float, k: int = 3, blocked: bool = False) -> DataFrame:
    """WN31 and TOP2: colour-shift candidates of one zone, ranked, best k kept.

    Needs colour_distance, green, blue, green_base, blue_base per sample.
    """
    s = numbered(smooth(samples, "colour_distance", "smoothed"))
    s = s.withColumn("delta", X.round_ms(F.coalesce(F.col("smoothed") - F.lag("smoothed").over(_seq()), F.lit(0.0)))).withColumn("p", run_length("smoothed", F.lit(threshold * 0.75)))
    crosses = F.col("smoothed") >= threshold
    shift = (F.col("green_base") - F.col("green") > 6) & (F.col("blue") - F.col("blue_base") > 6) & (F.col("smoothed") >= threshold * 0.5)
    jump = (F.col("delta") >= sharp) & (F.col("smoothed") >= threshold * 0.55)
    weak = F.lit(blocked) & (F.col("delta") >= sharp * 0.45) & (F.col("smoothed") >= threshold * 0.3)
    kind = X.when_chain([(crosses, "First visible color shift"), (shift, "Green-to-blue shift"), (weak, "Earliest weak color shift"), (jump, "First visible color shift")])
    edge = (F.col("raw_time") >= search_end - 0.25) | (F.col("raw_time") <= search_start + 0.1)
    ratio = F.col("smoothed") / threshold
    conf = X.when_chain([(edge, "Low"), ((ratio >= 1.5) & (F.col("p") >= required), "High"), ((ratio >= 1) & (F.col("p") >= min(2, required)), "Medium")], F.lit("Low"))
    spike = F.min_by("idx", F.struct(-F.col("smoothed"), F.col("idx"))).over(_whole())
    s = s.withColumn("spike_idx", spike)
    top = (F.col("idx") == F.col("spike_idx")) & (F.col("smoothed") >= threshold * 0.6)
    items = F.array_compact(F.array(F.when(kind.isNotNull(), F.struct(F.lit(0).alias("o"), kind.alias("kind"), conf.alias("confidence"))),
                                    F.when(top, F.struct(F.lit(1).alias("o"), F.lit("Strongest color change").alias("kind"), F.when(edge | ~crosses, "Low").otherwise("Medium").alias("confidence")))))
    df = s.select("attempt_id", "raw_time", F.col("smoothed").alias("score"), F.col("p").cast("bigint").alias("persistence"), edge.alias("boundary_risk"), F.explode(items).alias("i")).select("*", "i.*").drop("i")
    weight = 135.0 if blocked else 100.0
    score = (F.when(F.col("boundary_risk"), 100000.0).otherwise(0.0) + F.col("raw_time") * weight - F.least("persistence", F.lit(required)) * 20.0 - F.least(F.col("score") / threshold, F.lit(2.0)) * 10.0
             - F.when(F.lit(blocked) & (F.col("kind") == "Earliest weak color shift"), 35.0).otherwise(0.0))
    w = Window.partitionBy("attempt_id").orderBy(score, "o", "raw_time")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("o")


def loudness_thresholds(features: DataFrame, keys: list[str]) -> DataFrame:
    """AG29: activity threshold and onset floor from background loudness (median and MAD)."""
    w = Window.partitionBy(*keys)
    df = features.withColumn("_b", F.percentile("rms", F.lit(0.5)).over(w))
    df = df.withColumn("_d", F.percentile(F.abs(F.col("rms") - F.col("_b")), F.lit(0.5)).over(w))
    thr = F.greatest(F.col("_b") * 1.8, F.col("_b") + F.col("_d") * 4, F.lit(0.004))
    return df.withColumn("threshold", thr).withColumn("onset_floor", F.greatest(F.col("_b") + F.col("_d") * 1.5, thr * 0.2, F.lit(0.002))).drop("_b", "_d")


def adapted_calibration(samples: DataFrame, calibration: DataFrame) -> DataFrame:
    """WN34: colours re-learned from the six nearest samples before and after; refused when they collapse.

    ``calibration``: attempt_id, before_time, after_time, before_rgb, after_rgb, colour_delta.
    """
    j = samples.join(calibration, "attempt_id")
    out = calibration
    for side, lo, hi in (("before", 0.3, 0.06), ("after", 0.06, 0.35)):
        t = F.col(f"{side}_time")
        near = j.where((F.col("raw_time") >= t - lo) & (F.col("raw_time") <= t + hi))
        w = Window.partitionBy("attempt_id").orderBy(F.abs(F.col("raw_time") - t), "raw_time")
        g = near.withColumn("_r", F.row_number().over(w)).where("_r <= 6").groupBy("attempt_id").agg(
            F.count("*").alias(f"_n_{side}"), F.struct(*[F.floor(F.avg(k) + 0.5).cast("double").alias(k) for k in "rgb"]).alias(f"_{side}"))
        out = out.join(g, "attempt_id", "left")
    opp = lambda v: X.green_blue_opponent(f"{v}.r", f"{v}.g", f"{v}.b")
    delta = X.rgb_distance("_before", "_after")
    was, now = opp("after_rgb") - opp("before_rgb"), opp("_after") - opp("_before")
    ok = X.truthy((F.col("_n_before") >= 2) & (F.col("_n_after") >= 2) & (delta >= 0.75) & (F.abs(now) >= F.greatest(F.lit(3.0), F.abs(was) * 0.35)) & (F.signum(now) == F.signum(was)))
    out = out.withColumn("adapted", ok)
    return out.select("attempt_id", "adapted", *[F.when(F.col("adapted"), F.col(f"_{s}")).otherwise(F.col(f"{s}_rgb")).alias(f"{s}_rgb") for s in ("before", "after")],
                      F.when(F.col("adapted"), X.round_ms(delta)).otherwise(F.col("colour_delta")).alias("colour_delta"))
