"""The attempt library: merge, search, stored-record repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.scans import preceding_max
from ..functions.text import contains_all, folded
from .compare import lineage_text

IMPORT_SLICE = 1_000_000

# Zone ids and the labels their stored records may keep.
ZONE_LABELS = {"startLight": "Start Light Zone", "startBody": "Start Body Zone", "hold10": "Hold 10 Zone",
               "finishLight": "Finish Light Zone", "finishPad": "Finish Pad Review Area"}


def stamp(x) -> Column:
    """Seconds of a date text; text that is no date counts as 0."""
    return F.coalesce(X.c(x).try_cast("timestamp").cast("double"), F.lit(0.0))


def classify_imports(current: DataFrame, imported: DataFrame) -> DataFrame:
    """SET1, first half: what each imported row does (added, updated, unchanged).

    ``imported`` carries ``import_ord``; a row is judged against the stored row and against every
    earlier row of the same id.
    """
    base = current.select("attempt_id", stamp("updated_at").alias("_base"))
    rows = (imported.withColumn("_ts", stamp("updated_at")).withColumn("_slice", F.floor(F.col("import_ord") / IMPORT_SLICE)))
    rows = preceding_max(rows, ["attempt_id"], "_slice", [F.col("import_ord")], "_ts", "_seen")
    rows = rows.join(base, "attempt_id", "left")
    bar = F.greatest("_base", "_seen")
    return rows.withColumn("effect", F.when(bar.isNull(), "added").when(F.col("_ts") > bar, "updated").otherwise("unchanged"))


def merge_libraries(current: DataFrame, imported: DataFrame, payload: list[str]) -> DataFrame:
    """SET1: one row per id, the newest wins, a known lineage survives (SET2)."""
    judged = classify_imports(current, imported).where("effect <> 'unchanged'")
    cols = ["attempt_id", "import_ord", "updated_at", "lineage_id", *payload]
    both = current.withColumn("import_ord", F.lit(-1).cast("bigint")).select(*cols).unionByName(judged.select(*cols))
    lin = lineage_text()
    # every row left is strictly newer than the ones before it, so the last one wins
    return both.groupBy("attempt_id").agg(
        F.max_by(F.struct("updated_at", *payload), "import_ord").alias("w"),
        F.min_by(lin, F.when(lin.isNotNull(), F.col("import_ord"))).alias("_known"), F.max_by("lineage_id", "import_ord").alias("_raw"),
        (F.max("import_ord") >= 0).alias("from_import")).select(
        "attempt_id", F.when(F.col("from_import"), F.col("_known")).otherwise(F.col("_raw")).alias("lineage_id"), "from_import", "w.*")


def merge_counts(judged: DataFrame) -> DataFrame:
    return judged.groupBy("effect").agg(F.count("*").alias("n"), F.count_distinct("attempt_id").alias("ids"))


def newest_first(library: DataFrame) -> DataFrame:
    """TOP7: updated time, then its text, then name."""
    return library.orderBy(stamp("updated_at").desc(), F.col("updated_at").desc(), F.col("name"))


def saved_rows(attempts: DataFrame, wide: DataFrame, text_cols: list[str]) -> DataFrame:
    """Library rows with total, review flag and folded search text."""
    s, f = F.col("startSignal.raw_time"), F.col("finishPad.raw_time")
    total = F.when(f > s, f - s)
    rank = F.least(X.conf_rank("startSignal.confidence"), X.conf_rank("finishPad.confidence"))
    t = wide.select("attempt_id", total.alias("total_s"), (total.isNull() | (rank < 2)).alias("needs_review"))
    text = F.concat_ws(" ", *[F.when(F.length(c) > 0, F.col(c)) for c in text_cols])
    return (attempts.join(t, "attempt_id", "left").withColumn("needs_review", F.coalesce("needs_review", F.lit(True)))
            .withColumn("search_text", folded(text)))


def search(rows: DataFrame, text: str, keep: str = "all", sort: str = "updated") -> DataFrame:
    """TOP1: every term must occur; ``keep`` is all, timed or review; ``sort`` is updated or recorded."""
    hit = contains_all(F.col("search_text"), text)
    if keep != "all":
        hit = hit & (F.col("needs_review") if keep == "review" else ~F.col("needs_review"))
    first = stamp("date") if sort == "recorded" else stamp("updated_at")
    return rows.where(hit).orderBy(first.desc(), stamp("updated_at").desc(), "name", "attempt_id")


def repair_zone(z: str) -> Column:
    """PRJ11: corners ordered and clamped to the frame, NULL when thinner than 0.005."""
    n = {k: X.finite(f"{z}.{k}") for k in ("x1", "y1", "x2", "y2")}
    x1, x2 = X.clamp(F.least(n["x1"], n["x2"]), 0.0, 1.0), X.clamp(F.greatest(n["x1"], n["x2"]), 0.0, 1.0)
    y1, y2 = X.clamp(F.least(n["y1"], n["y2"]), 0.0, 1.0), X.clamp(F.greatest(n["y1"], n["y2"]), 0.0, 1.0)
    whole = X.all_of(*[v.isNotNull() for v in n.values()])
    return F.when(whole & (x2 - x1 > 0.005) & (y2 - y1 > 0.005),
                  F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")))


def repair_rgb(v: str) -> Column:
    ok = X.all_of(*[F.col(f"{v}.{k}").between(0, 255) for k in "rgb"])
    return F.when(ok, F.col(v))


def repair_light_calibration(df: DataFrame, duration: str) -> DataFrame:
    """PRJ12: colours 0..255, frame times inside the recording, colour distance recomputed."""
    def inside(t):
        return F.when((X.finite(t) >= 0) & (F.col(duration).isNull() | (F.col(duration) <= 0) | (F.col(t) <= F.col(duration) + 0.001)), F.col(t))
    df = df.withColumns({"before_rgb": repair_rgb("before_rgb"), "after_rgb": repair_rgb("after_rgb"),
                         "before_time": inside("before_time"), "after_time": inside("after_time")})
    return df.withColumn("colour_delta", X.round_ms(X.rgb_distance("before_rgb", "after_rgb")))


def repair_recording(df: DataFrame) -> DataFrame:
    """PRJ13: usable recording metadata only; sizes in whole pixels."""
    ok = X.truthy((F.length(F.trim("file_name")) > 0) & (X.finite("duration_s") > 0) & (X.finite("width") >= 0) & (X.finite("height") >= 0))
    return df.where(ok).withColumns({"file_name": F.trim("file_name"), "width": F.floor(F.col("width") + 0.5), "height": F.floor(F.col("height") + 0.5)})


def bounded(x, low, high, fallback) -> Column:
    n = X.finite(x)
    return F.when(n.between(low, high), n).otherwise(F.lit(fallback))


def one_of(x, values, fallback) -> Column:
    return F.when(X.c(x).isin(values), X.c(x)).otherwise(fallback)


MAX_RECORDING_S = 6 * 60 * 60.0


def repair_settings(df: DataFrame) -> DataFrame:
    """PRJ8: numbers within bounds, known choices, a positive official total as text."""
    start = bounded("start_search_start", 0.0, MAX_RECORDING_S - 0.5, 0.0)
    end = bounded("start_search_end", 0.0, MAX_RECORDING_S, 12.0)
    total = F.trim("official_total")
    level = ["low", "medium", "high"]
    return df.withColumns({
        "start_search_start": start,
        "start_search_end": F.when(end > start, end).otherwise(F.least(F.lit(MAX_RECORDING_S), start + 12.0)),
        "start_sensitivity": one_of("start_sensitivity", level, "medium"),
        "movement_sensitivity": one_of("movement_sensitivity", level, "medium"),
        "light_visibility": one_of("light_visibility", ["clear", "blocked"], "clear"),
        "start_profile": one_of("start_profile", ["auto", "calibrated", "generic", "blocked", "motion", "manual"], "auto"),
        "movement_definition": one_of("movement_definition", ["earliest", "committed"], "earliest"),
        "reaction_offset": bounded("reaction_offset", 0.0, 2.0, 0.2),
        "start_offset": bounded("start_offset", -2.0, 2.0, 0.0),
        "launch_min_delay": bounded("launch_min_delay", 0.0, 2.0, 0.1),
        "movement_offset": bounded("movement_offset", -2.0, 2.0, 0.0),
        "official_total": F.when(X.finite(total.try_cast("double")) > 0, total).otherwise(""),
    })


def start_search_window(start, end, duration) -> tuple[Column, Column]:
    """PRJ9: the start search window inside the recording, at least half a second long."""
    d = F.when(X.finite(duration) > 0, X.c(duration)).otherwise(0.0)
    s = F.least(X.c(start), F.greatest(F.lit(0.0), d - 0.5))
    return s, F.least(d, F.greatest(F.least(d, s + 0.5), X.c(end)))


def finish_search_window(start, duration, minimum=3.0, maximum=30.0) -> tuple[Column, Column]:
    """PRJ10: where a finish may be looked for."""
    s = F.greatest(F.coalesce(X.finite(start), F.lit(0.0)), F.lit(0.0))
    d = F.greatest(F.coalesce(X.finite(duration), F.lit(0.0)), F.lit(0.0))
    low = s + minimum
    return low, F.greatest(low, F.least(F.greatest(d - 0.04, F.lit(0.0)), s + maximum))


def official_finish(start, duration, total) -> Column:
    """PRJ18: start plus official total, only when it lies inside the recording."""
    s, d, t = X.finite(start), X.finite(duration), X.finite(total)
    p = s + t
    return F.when((s >= 0) & (d > s) & (t > 0) & (p > s + 0.001) & (p <= d + 0.001), F.least(d, p))


def recording_matches(a: str, b: str) -> Column:
    """FN15: does recording ``a`` match the expected recording ``b``?"""
    g = lambda s, k: F.col(f"{s}.{k}")
    size = (F.coalesce(g(b, "width"), F.lit(0)) == 0) | (F.coalesce(g(b, "height"), F.lit(0)) == 0) | ((g(a, "width") == g(b, "width")) & (g(a, "height") == g(b, "height")))
    near = F.abs(g(a, "duration_s") - g(b, "duration_s")) <= F.greatest(F.lit(0.1), F.abs(g(b, "duration_s")) * 0.005)
    return X.truthy((g(a, "file_name") == g(b, "file_name")) & size & ((g(b, "duration_s") == 0) | near))


def markers_fit(markers: DataFrame, durations: DataFrame) -> DataFrame:
    """FN16: every set marker lies inside a recording of known length."""
    d = F.col("duration_s")
    ok = F.col("raw_time").isNull() | ((F.col("raw_time") >= 0) & (F.col("raw_time") <= d))
    return (markers.join(durations.select("attempt_id", "duration_s"), "attempt_id", "left").groupBy("attempt_id")
            .agg(X.truthy(F.bool_and(ok & (d > 0))).alias("fits")))


def playback_ranges(wide: DataFrame) -> DataFrame:
    """PRJ30: the part of the recording each phase covers, all phases of an attempt in one pass."""
    s, h, f = (F.when(F.col(f"{m}.source") != "Not set", F.col(f"{m}.raw_time")) for m in ("startSignal", "hold10", "finishPad"))
    h = F.when(F.col("hold10.acceptance_mode") == "frame-review", h)
    split = (f > s) & (h > s) & (h < f)
    phases = F.array(*[F.struct(F.lit(phase).alias("phase"), F.when(ok, a).alias("range_start"), F.when(ok, b).alias("range_end"))
                       for phase, ok, a, b in (("total", f > s, s, f), ("bottom", split, s, h), ("top", split, h, f))])
    return wide.select("attempt_id", F.explode(phases).alias("p")).select("attempt_id", "p.*")


def playback_time(start, end, elapsed) -> Column:
    return X.c(start) + F.greatest(F.lit(0.0), F.least(F.coalesce(X.finite(elapsed), F.lit(0.0)), X.c(end) - X.c(start)))


def finite_splits(m) -> Column:
    """PRJ36: keep NULL and finite entries of a split map."""
    return F.map_filter(X.c(m), lambda k, v: v.isNull() | X.finite(v).isNotNull())


def content_key(*cols) -> Column:
    """FN25: digest of the editable content; save clocks and derived columns are left out by the caller."""
    return F.sha2(F.to_json(F.struct(*sorted(cols))), 256)


def body_region(z: str) -> Column:
    """PRJ21: body region of a lane, from the position of its start light."""
    cx, cy = (F.col(f"{z}.x1") + F.col(f"{z}.x2")) / 2, (F.col(f"{z}.y1") + F.col(f"{z}.y2")) / 2
    right = cx >= 0.5
    return F.struct(
        F.when(right, F.greatest(F.lit(0.5), cx - 0.2)).otherwise(F.greatest(F.lit(0.0), cx - 0.23)).alias("x1"),
        F.greatest(F.lit(0.42), cy - 0.34).alias("y1"),
        F.when(right, F.least(F.lit(1.0), cx + 0.23)).otherwise(F.least(F.lit(0.5), cx + 0.2)).alias("x2"),
        F.least(F.lit(0.9), F.greatest(F.lit(0.74), cy - 0.025)).alias("y2"))


def zones_equal(a: str, b: str) -> Column:
    """FN11: same region to 1e-6; two missing regions are equal."""
    near = X.all_of(*[F.abs(F.col(f"{a}.{k}") - F.col(f"{b}.{k}")) < 1e-6 for k in ("x1", "y1", "x2", "y2")])
    none_a, none_b = F.col(a).isNull(), F.col(b).isNull()
    return F.when(none_a | none_b, none_a & none_b).otherwise(X.truthy(near))


def result_freshness(df: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """JN16: does stored tracking still belong to the accepted range and athlete region?

    Needs result_start, result_end, start_s, end_s, result_zone, zone.
    """
    same_start = F.abs(F.col("result_start") - F.col("start_s")) <= tolerance
    zone = zones_equal("result_zone", "zone")
    return (df.withColumn("fresh", X.truthy(same_start & (F.abs(F.col("result_end") - F.col("end_s")) <= tolerance) & zone))
            .withColumn("covers", X.truthy(same_start & (F.col("result_end") + tolerance >= F.col("end_s")) & zone)))


def drop_automatic_geometry(df: DataFrame) -> DataFrame:
    """PRJ41: another athlete: results go, and calibration that nobody drew goes too."""
    return df.withColumn("result_id", F.lit(None).cast("bigint")).withColumn(
        "calibration_id", F.when(F.coalesce("calibration_source", F.lit("")) != "automatic-approximate", F.col("calibration_id")))
