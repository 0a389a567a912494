"""Event markers of an attempt: repair, validation of proposals, audit.

Long form is one row per (attempt_id, marker_id).  Wide form is one row per attempt with one
struct column per marker; rules that look at several markers work on the wide form, so they
need a single aggregation by attempt (at most six rows each) and no self join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X

FIELDS = ["raw_time", "climb_time", "detected_raw_time", "offset_applied", "source", "confidence", "acceptance_mode",
          "observation_interval_s", "note"]
TYPES = dict(raw_time="double", climb_time="double", detected_raw_time="double", offset_applied="double", source="string",
             confidence="string", acceptance_mode="string", observation_interval_s="double", note="string")
EMPTY = {"source": "Not set", "confidence": "None"}


def _marker(values: dict[str, Column]) -> Column:
    return F.struct(*[values[f].cast(TYPES[f]).alias(f) for f in FIELDS])


def cleared() -> Column:
    return F.expr("named_struct(" + ", ".join(f"'{f}', " + (f"'{EMPTY[f]}'" if f in EMPTY else f"cast(null as {TYPES[f]})") for f in FIELDS) + ")")


def to_wide(markers: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Pivot to one struct per marker id; absent markers become cleared ones."""
    have = set(markers.columns)
    packed = "named_struct(" + ", ".join(f"'{f}', " + (f if f in have else f"cast(null as {TYPES[f]})") for f in FIELDS) + ")"
    aggs = [F.expr(f"max({packed}) filter (where marker_id = '{m}')").alias(m) for m in X.MARKER_IDS]
    wide = markers.groupBy("attempt_id", *keep).agg(*aggs)
    empty = cleared()
    return wide.select("attempt_id", *keep, *[F.coalesce(F.col(m), empty).alias(m) for m in X.MARKER_IDS])


def to_long(wide: DataFrame, keep: list[str] = ()) -> DataFrame:
    rows = F.expr("array(" + ", ".join(f"named_struct('marker_id', '{m}', 'marker_ord', {i + 1}, 'm', {m})" for i, m in enumerate(X.MARKER_IDS)) + ")")
    return (wide.select("attempt_id", *keep, F.explode(rows).alias("r"))
            .select("attempt_id", *keep, "r.marker_id", "r.marker_ord", "r.m.*"))


def repair_metadata(markers: DataFrame, duration: str | None = None) -> DataFrame:
    """PRJ3: unknown source, confidence and mode fall back; notes are at most 4000 characters."""
    unset = F.col("raw_time").isNull()
    inside = F.col("detected_raw_time") >= 0
    if duration:
        inside = inside & (F.col(duration).isNull() | (F.col(duration) <= 0) | (F.col("detected_raw_time") <= F.col(duration) + 0.001))
    return markers.withColumns({
        "source": F.when(F.col("source").isin(X.MARKER_SOURCES), F.col("source")).when(unset, "Not set").otherwise("Manual"),
        "confidence": F.when(F.col("confidence").isin(X.CONFIDENCES), F.col("confidence")).when(unset, "None").otherwise("Low"),
        "detected_raw_time": F.when(inside, X.finite("detected_raw_time")),
        "offset_applied": X.finite("offset_applied"),
        "note": F.substring("note", 1, 4000),
        "acceptance_mode": F.when(F.col("acceptance_mode").isin(X.ACCEPTANCE_MODES), F.col("acceptance_mode")),
        "observation_interval_s": F.when(~unset, X.observation_interval("observation_interval_s")),
    })


def is_legacy_hold10(marker_id="marker_id", source="source") -> Column:
    """PRJ4: detector-written middle markers that nobody reviewed."""
    return (X.c(marker_id) == "hold10") & X.c(source).isin(X.LEGACY_HOLD10_SOURCES)


def drop_legacy_hold10(markers: DataFrame) -> DataFrame:
    return markers.where(~is_legacy_hold10())


def _clear_long(markers: DataFrame, cond: Column) -> DataFrame:
    cond = X.truthy(cond)
    return markers.withColumns({f: F.when(cond, F.lit(EMPTY.get(f)).cast(TYPES[f])).otherwise(F.col(f))
                                for f in FIELDS if f in markers.columns})


def repair_wide(markers: DataFrame, durations: DataFrame | None = None) -> DataFrame:
    """PRJ1 on the wide form.  ``durations`` holds (attempt_id, duration_s)."""
    keep = []
    if durations is not None:
        markers = markers.join(durations.select("attempt_id", "duration_s"), "attempt_id", "left")
        keep = ["duration_s"]
    else:
        markers = markers.withColumn("duration_s", F.lit(None).cast("double"))
        keep = ["duration_s"]
    raw, dur = F.col("raw_time"), F.col("duration_s")
    good = raw.isNull() | (X.finite("raw_time").isNotNull() & (raw >= 0) & (dur.isNull() | (dur <= 0) | (raw <= dur + 0.001)))
    checked = _clear_long(repair_metadata(markers, "duration_s"), ~good)
    checked = _clear_long(checked, is_legacy_hold10())
    wide = to_wide(checked, keep)
    # each kept value is the lower bound of the next, so the bounds are chained columns
    s, f = F.col("startSignal.raw_time"), F.col("finishPad.raw_time")
    wide = wide.withColumns({"_s": s, "_f": F.when(f > s + 0.001, f)})
    kept: list[str] = []
    for m in X.MIDDLE_MARKERS:
        bound = ", ".join([*[f"_t_{k}" for k in reversed(kept)], "_s"])
        ok = f"{m}.raw_time >= coalesce({bound}) and _s is not null and (_f is null or {m}.raw_time < _f - 0.001D)"
        wide = wide.withColumn(f"_t_{m}", F.expr(f"case when {ok} then {m}.raw_time end"))
        kept.append(m)
    times = {"startSignal": "_s", "finishPad": "_f", **{m: f"_t_{m}" for m in X.MIDDLE_MARKERS}}
    empty = cleared()
    out = []
    for m in X.MARKER_IDS:
        climb = "0.0D" if m == "startSignal" else f"cast(floor(({times[m]} - _s) * 1000.0D + 0.5D) as double) / 1000.0D"
        full = F.expr("named_struct(" + ", ".join(f"'{x}', {climb if x == 'climb_time' else f'{m}.{x}'}" for x in FIELDS) + ")")
        out.append(F.when(F.col(times[m]).isNotNull(), full).otherwise(empty).alias(m))
    return wide.select("attempt_id", *out)


def repair(markers: DataFrame, durations: DataFrame | None = None) -> DataFrame:
    """PRJ1: the six markers of every attempt with impossible values cleared."""
    return to_long(repair_wide(markers, durations))


def climb_times(markers: DataFrame) -> DataFrame:
    """PRJ2: raw time minus start, in whole milliseconds."""
    starts = markers.where("marker_id = 'startSignal'").groupBy("attempt_id").agg(F.max("raw_time").alias("_s"))
    t = F.when(F.col("raw_time").isNull(), None).when(F.col("marker_id") == "startSignal", 0.0).otherwise(X.round_ms(F.col("raw_time") - F.col("_s")))
    return markers.join(starts, "attempt_id", "left").withColumn("climb_time", t).drop("_s")


def audit(markers: DataFrame) -> DataFrame:
    """PRJ7: how each marker came to be accepted.  Never an accuracy label."""
    mode = F.when(F.col("raw_time").isNull(), "unset").when(F.col("acceptance_mode").isin(X.ACCEPTANCE_MODES), F.col("acceptance_mode")).otherwise("legacy-unknown")
    return (markers.withColumn("accepted", F.col("raw_time").isNotNull()).withColumn("acceptance_audit", mode)
            .withColumn("user_accepted", F.col("acceptance_audit").isin("manual-entry", "frame-review"))
            .withColumn("is_ground_truth", F.lit(False)))


def clear_one(wide: DataFrame, marker_id: Column) -> DataFrame:
    """PRJ6: clear a marker; clearing the start clears everything."""
    s = F.col("startSignal.raw_time")
    out = []
    for m in X.MARKER_IDS:
        hit = (marker_id == "startSignal") | (marker_id == m)
        t = F.col(f"{m}.raw_time")
        climb = F.when(t.isNull(), None).when(F.lit(m == "startSignal"), 0.0).otherwise(X.round_ms(t - s))
        out.append(F.when(hit, cleared()).otherwise(F.col(m).withField("climb_time", climb)).alias(m))
    return wide.select("attempt_id", *out)


def proposal_reason(p: str = "p") -> Column:
    """PRJ5: why a proposed marker is refused, NULL when it is accepted.

    Expects the wide markers and a struct ``p`` (marker_id, raw_time, duration_s) in one row.
    """
    raw, dur, mid = F.col(f"{p}.raw_time"), F.col(f"{p}.duration_s"), F.col(f"{p}.marker_id")
    t = X.round_ms(raw)
    s, f = F.col("startSignal.raw_time"), F.col("finishPad.raw_time")
    middle = mid.isin(X.MIDDLE_MARKERS)
    before, after = F.lit(None).cast("double"), F.lit(None).cast("double")
    for i, m in enumerate(X.MIDDLE_MARKERS):
        lower = F.coalesce(*[F.col(f"{x}.raw_time") for x in reversed(X.MIDDLE_MARKERS[:i])], F.lit(None).cast("double"))
        upper = F.coalesce(*[F.col(f"{x}.raw_time") for x in X.MIDDLE_MARKERS[i + 1:]], F.lit(None).cast("double"))
        before = F.when(mid == m, lower).otherwise(before)
        after = F.when(mid == m, upper).otherwise(after)
    later = mid != "startSignal"
    return X.when_chain([
        (X.finite(raw).isNull() | (raw < 0), "not-a-time"),
        (X.finite(dur).isNotNull() & (raw > dur + 0.001), "after-recording"),
        (~mid.isin(X.MARKER_IDS), "unknown-marker"),
        (later & s.isNull(), "start-not-set"),
        (later & (t < s), "before-start"),
        ((mid == "finishPad") & (t <= s + 0.001), "finish-not-after-start"),
        (middle & f.isNotNull() & (t >= f - 0.001), "not-before-finish"),
        (middle & (t < before), "before-previous-marker"),
        (middle & (t > after), "after-next-marker"),
    ])


def accept_proposal(wide_with_p: DataFrame) -> DataFrame:
    """PRJ5: apply one proposal per attempt: reason, accepted flag, and the six markers afterwards."""
    df = wide_with_p.withColumn("reason", proposal_reason()).withColumn("accepted", F.col("reason").isNull())
    mid, t = F.col("p.marker_id"), X.round_ms(F.col("p.raw_time"))
    new_start = F.when(F.col("accepted") & (mid == "startSignal"), t).otherwise(F.col("startSignal.raw_time"))
    df = df.withColumn("_s", new_start)
    out = []
    for m in X.MARKER_IDS:
        old = F.col(m)
        old_t = F.col(f"{m}.raw_time")
        fresh = _marker({
            "raw_time": t, "climb_time": F.lit(0.0) if m == "startSignal" else X.round_ms(t - F.col("_s")),
            "detected_raw_time": F.coalesce(F.col("p.detected_raw_time"), F.col("p.raw_time")),
            "offset_applied": F.coalesce(F.col("p.offset_applied"), F.lit(0.0)), "source": F.col("p.source"),
            "confidence": F.col("p.confidence"), "acceptance_mode": F.col("p.acceptance_mode"),
            "observation_interval_s": X.observation_interval("p.observation_interval_s"), "note": F.col("p.note")})
        lost = mid == "startSignal"
        if m not in ("startSignal", "finishPad"):
            lost = lost | ((mid == "finishPad") & X.truthy(old_t >= t - 0.001))
        climb = F.when(old_t.isNull(), None).when(F.lit(m == "startSignal"), 0.0).otherwise(X.round_ms(old_t - F.col("_s")))
        after = F.when(mid == m, fresh).when(lost, cleared()).otherwise(old.withField("climb_time", climb))
        out.append(F.when(F.col("accepted"), after).otherwise(old).alias(m))
    return df.select("attempt_id", "accepted", "reason", *out)


def clear_after_athlete_change(markers: DataFrame, automatic_only: bool = False) -> DataFrame:
    """PRJ22: markers after the start depend on the chosen athlete; reviewed or typed ones may stay."""
    drop = F.col("marker_id") != "startSignal"
    if automatic_only:
        mode = F.coalesce(F.col("acceptance_mode"), F.lit(""))
        chosen = ((F.col("source") == "Manual") & (mode != "automatic")) | (mode == "frame-review")
        drop = drop & ~(chosen & ~is_legacy_hold10())
    return climb_times(_clear_long(markers, drop))
