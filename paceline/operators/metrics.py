"""Metrics of one attempt, computed from its repaired markers in wide form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X

METRIC_IDS = ["total", "reaction", "bottom-phase", "top-phase", "lower-third", "middle-third", "top-third"]

# The eleven named splits as (name, from marker, to marker).
SPLITS = [
    ("reaction_time", "startSignal", "firstMovement"), ("launch_delay", "startSignal", "committedLaunch"),
    ("preload_gap", "firstMovement", "committedLaunch"), ("start_to_first_hold", "startSignal", "firstHold"),
    ("movement_to_first_hold", "firstMovement", "firstHold"), ("start_to_hold10", "startSignal", "hold10"),
    ("first_hold_to_hold10", "firstHold", "hold10"), ("hold10_to_finish", "hold10", "finishPad"),
    ("movement_time", "firstMovement", "finishPad"), ("launch_to_finish", "committedLaunch", "finishPad"),
    ("calculated_total", "startSignal", "finishPad"),
]


def _t(m: str) -> Column:
    """Usable time of a marker: set, non-negative, with a source."""
    return F.when((F.col(f"{m}.source") != "Not set") & (F.col(f"{m}.raw_time") >= 0), F.col(f"{m}.raw_time"))


def splits(wide: DataFrame) -> DataFrame:
    """AG1: one column per named split."""
    return wide.select("attempt_id", *[X.round_ms(F.col(f"{b}.raw_time") - F.col(f"{a}.raw_time")).alias(n) for n, a, b in SPLITS])


def split_map(wide: DataFrame) -> DataFrame:
    """AG1 as one map column, the shape of the dataset export."""
    s = splits(wide)
    pairs = [x for n, _, _ in SPLITS for x in (F.lit(n), F.col(n))]
    return s.select("attempt_id", F.create_map(*pairs).alias("split_calculations"))


def phase_splits(wide: DataFrame) -> DataFrame:
    """AG2: the two phases around the middle marker."""
    s, h, f = (F.col(f"{m}.raw_time") for m in ("startSignal", "hold10", "finishPad"))
    ok = X.truthy((f > s) & (h > s) & (h < f))
    a, b = X.round_ms(h - s), X.round_ms(f - h)
    gap = X.round_ms(F.abs(a - b))
    total = X.round_ms(f - s)
    return wide.select(
        "attempt_id", ok.alias("available"),
        F.when(ok, a).alias("start_to_hold10_s"), F.when(ok, b).alias("hold10_to_finish_s"), F.when(ok, total).alias("total_s"),
        F.when(ok, X.round_ms(a / total)).alias("hold10_share"), F.when(ok, gap).alias("phase_difference_s"),
        F.when(ok, F.when(gap <= 0.05, "balanced").when(a > b, "start-to-hold10").otherwise("hold10-to-finish")).alias("slower_phase"),
        F.when(ok, F.col("hold10.confidence")).otherwise("None").alias("confidence"))


def comparison_floor(*markers: str) -> Column:
    """AG6: the smallest difference between two attempts that may be called a change."""
    motion = X.any_of(*[F.col(f"{m}.source").isin(X.MOTION_SOURCES) for m in markers])
    spread = sum(F.coalesce(X.observation_interval(f"{m}.observation_interval_s"), F.lit(0.0)) for m in markers)
    return F.greatest(F.when(motion, 0.2).otherwise(0.1), spread * 2.0)


def timing_structs() -> list[Column]:
    """AG3: total, reaction and the two reviewed phases; value_s is NULL where a metric does not apply."""
    s, m, h, f = (_t(x) for x in ("startSignal", "firstMovement", "hold10", "finishPad"))
    conf = lambda *ms: X.min_confidence(*[F.col(f"{x}.confidence") for x in ms])
    phases = (F.col("hold10.acceptance_mode") == "frame-review") & (h > s) & (h < f)
    phase_conf = conf("startSignal", "hold10", "finishPad")
    rows = [
        ("total", f > s, f - s, conf("startSignal", "finishPad"), "Accepted timing", ("startSignal", "finishPad")),
        ("reaction", (m >= s) & (f.isNull() | (m <= f)), m - s, conf("startSignal", "firstMovement"), "Accepted timing", ("startSignal", "firstMovement")),
        ("bottom-phase", phases, h - s, phase_conf, "Reviewed Hold 10", ("startSignal", "hold10")),
        ("top-phase", phases, f - h, phase_conf, "Reviewed Hold 10", ("hold10", "finishPad")),
    ]
    return [F.struct(F.lit(i).alias("metric_id"), F.when(ok, X.round_ms(v)).alias("value_s"), cf.alias("confidence"),
                        F.lit(ev).alias("evidence"), comparison_floor(*fl).alias("floor_s")) for i, ok, v, cf, ev, fl in rows]


def timing_metrics(wide: DataFrame) -> DataFrame:
    """AG3 as rows."""
    return wide.select("attempt_id", F.explode(F.array(*timing_structs())).alias("r")).select("attempt_id", "r.*").where("value_s is not null")


def section_struct(section_id, time_s, confidence, route_confidence, sample_fps) -> Column:
    """AG4: the metric of a wall third, as one of ``timing_structs``; value_s is NULL without start or finish."""
    floor = F.greatest(F.lit(0.1), F.when(X.c(sample_fps) > 0, 2.0 / X.c(sample_fps)).otherwise(0.4), comparison_floor("startSignal", "finishPad"))
    ready = _t("startSignal").isNotNull() & _t("finishPad").isNotNull()
    return F.struct(F.concat(X.c(section_id), F.lit("-third")).alias("metric_id"), F.when(ready, X.round_ms(time_s)).alias("value_s"),
                    X.min_confidence(route_confidence, confidence, "startSignal.confidence", "finishPad.confidence").alias("confidence"), F.lit("COM wall estimate").alias("evidence"), floor.alias("floor_s"))


def with_section_metrics(timing: DataFrame, wide: DataFrame, sections: DataFrame) -> DataFrame:
    """AG4: add wall-third metrics from tracking that is fresh and valid.

    ``sections``: attempt_id, section_id, section_time_s, confidence, route_confidence, sample_fps,
    available.  Only fresh tracking results may be passed in (see ``freshness``).
    """
    found = sections.where("available and section_time_s is not null").join(wide, "attempt_id")
    thirds = found.select("attempt_id", section_struct("section_id", "section_time_s", "confidence", "route_confidence", "sample_fps").alias("r"))
    return timing.unionByName(thirds.select("attempt_id", "r.*").where("value_s is not null"))


def has_comparable_timing(wide: DataFrame) -> DataFrame:
    """AG8: may this attempt appear in a comparison selector at all?"""
    s, m, f = (_t(x) for x in ("startSignal", "firstMovement", "finishPad"))
    ok = (f > s) | ((m >= s) & (f.isNull() | (m <= f)))
    return wide.select("attempt_id", X.truthy(ok).alias("comparable"))


def timing_facts(wide: DataFrame) -> DataFrame:
    """AG39: numeric facts of an attempt with the state of its timing."""
    s, m, h, f = (_t(x) for x in ("startSignal", "firstMovement", "hold10", "finishPad"))
    conf = lambda *ms: X.conf_rank(X.min_confidence(*[F.col(f"{x}.confidence") for x in ms]))
    total = X.round_ms(f - s)
    ok = X.truthy((f > s) & (conf("startSignal", "finishPad") >= 2) & (total > 0) & (total <= 600))
    phase_ok = ok & X.truthy((F.col("hold10.acceptance_mode") == "frame-review") & (h > s) & (h < f) & (conf("startSignal", "hold10", "finishPad") >= 2))
    reaction = X.round_ms(m - s)
    move_ok = ok & X.truthy((m >= s) & (m <= f) & (conf("startSignal", "firstMovement") >= 2) & (reaction >= 0) & (reaction <= F.least(F.lit(30.0), total)))
    bound = lambda *ms: F.least(F.lit(600.0), F.greatest(F.lit(0.1), comparison_floor(*ms)))
    return wide.select(
        "attempt_id",
        F.when(ok, "accepted").when(s.isNull(), "missing-start").when(f.isNull(), "missing-finish").otherwise("review").alias("timing_state"),
        F.when(ok, total).alias("total_s"), F.when(move_ok, reaction).alias("movement_s"), phase_ok.alias("reviewed_hold10"),
        F.when(phase_ok, X.round_ms(h - s)).alias("bottom_s"), F.when(phase_ok, X.round_ms(f - h)).alias("top_s"),
        F.when(ok, bound("startSignal", "finishPad")).otherwise(0.1).alias("floor_total_s"),
        F.when(phase_ok, bound("startSignal", "hold10")).alias("floor_bottom_s"),
        F.when(phase_ok, bound("hold10", "finishPad")).alias("floor_top_s"))
