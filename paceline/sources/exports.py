"""Per-attempt dataset records and text reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators.metrics import SPLITS, phase_splits, splits


def candidate_export(candidates: DataFrame, markers: DataFrame) -> DataFrame:
    """SNK3: each candidate with accepted or rejected (within 20 ms of its marker)."""
    m = markers.select("attempt_id", "marker_id", F.col("raw_time").alias("marker_time"))
    near = X.truthy(F.abs(F.col("marker_time") - F.col("raw_time")) <= 0.02)
    return candidates.join(m, ["attempt_id", "marker_id"], "left").withColumn("accepted", near).withColumn("rejected", ~near)


def detection_warnings(failures, underway, first_frame, scene_reason, light_area, body_area) -> Column:
    """SNK4: codes of the quality warnings of an attempt."""
    return F.array_compact(F.array(
        *[X.c(f) for f in failures], F.when(X.c(underway), F.lit("movement-underway")), F.when(X.c(first_frame), F.lit("first-sampled-frame")),
        X.c(scene_reason), F.when(X.c(light_area) > 0.05, F.lit("light-zone-large")), F.when(X.c(body_area) > 0.3, F.lit("body-zone-large"))))


def yaml_string(x) -> Column:
    """SNK6: JSON string syntax, valid in YAML."""
    return F.regexp_extract(F.to_json(F.struct(X.c(x).alias("v"))), r"^\{\"v\":([\s\S]*)\}$", 1)


def plain_number(x) -> Column:
    """Shortest text of a number; whole numbers carry no decimals; NULL is empty."""
    x = X.finite(x)
    return F.coalesce(F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string")), F.lit(""))


def seconds_text(x) -> Column:
    """Three decimals and an s, the report's time format."""
    ms = F.floor(F.abs(X.c(x)) * 1000 + 0.5)
    whole, rest = F.floor(ms / 1000).cast("string"), F.lpad((ms % 1000).cast("string"), 3, "0")
    return F.when(X.c(x).isNull(), "Not set").otherwise(F.concat(F.when(X.c(x) < 0, "-").otherwise(""), whole, F.lit("."), rest, F.lit("s")))


def dataset_records(attempts: DataFrame, wide: DataFrame, long_markers: DataFrame) -> DataFrame:
    """SNK2: the nested record of an attempt: session, video, markers, splits and phases."""
    rows = long_markers.groupBy("attempt_id").agg(F.sort_array(F.collect_list(F.struct(
        "marker_ord", "marker_id", F.col("raw_time").alias("accepted_raw_time"), "climb_time", "source", "confidence",
        X.truthy(F.abs(F.col("raw_time") - F.col("detected_raw_time")) > 0.001).alias("user_adjusted")))).alias("accepted_timestamps"))
    sp = splits(wide)
    sp = sp.select("attempt_id", F.struct(*[n for n, _, _ in SPLITS]).alias("splits"))
    ph = phase_splits(wide)
    ph = ph.select("attempt_id", F.struct(*[c for c in ph.columns if c != "attempt_id"]).alias("phases"))
    a = attempts.select("attempt_id", F.struct("name", "athlete", "date", "location", "attempt_type", "notes", "lineage_id").alias("session"),
                        F.struct("file_name", "duration_s", "width", "height").alias("video"))
    return a.join(rows, "attempt_id", "left").join(sp, "attempt_id", "left").join(ph, "attempt_id", "left")


def reports(records: DataFrame) -> DataFrame:
    """SNK5: one Markdown text per attempt, front matter first."""
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v)
    table = F.transform("accepted_timestamps", lambda m: F.concat_ws(" | ", m["marker_id"], seconds_text(m["accepted_raw_time"]), seconds_text(m["climb_time"]), m["source"], m["confidence"]))
    parts = [
        F.lit("---"), line("athlete", yaml_string(F.col("session.athlete").cast("string"))), line("date", yaml_string("session.date")),
        line("session_name", yaml_string("session.name")), line("video_file", yaml_string("video.file_name")),
        line("reaction_time", plain_number("splits.reaction_time")), line("calculated_total_time", plain_number("splits.calculated_total")),
        line("bottom_phase_share", plain_number("phases.hold10_share")), line("slower_phase", yaml_string(F.coalesce("phases.slower_phase", F.lit("Not set")))),
        F.lit("---"), F.lit("## Accepted timestamps"), F.array_join(F.coalesce(table, F.array().cast("array<string>")), "\n"), F.lit("## Splits"),
        *[line(n, seconds_text(f"splits.{n}")) for n, _, _ in SPLITS]]
    return records.select("attempt_id", F.concat_ws("\n", *parts).alias("report"))


def write_reports(report_rows: DataFrame, path: str) -> None:
    report_rows.select("report").write.mode("errorifexists").option("lineSep", "\n\n").text(path)
