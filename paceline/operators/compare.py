"""Comparing attempts: identity, pairwise outcomes, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.scans import previous_row
from .metrics import METRIC_IDS, _t, timing_structs


def lineage_text(x="lineage_id") -> Column:
    """PRJ17: a usable lineage id, or NULL."""
    x = X.c(x)
    return F.when((F.length(x) <= 256) & (F.length(F.trim(x)) > 0) & ~x.rlike("[\\x00-\\x1f\\x7f]"), x)


def resolved_lineage(attempt_id="attempt_id", lineage="lineage_id") -> Column:
    return F.coalesce(lineage_text(lineage), X.c(attempt_id).cast("string"))


def practice_id(lineage: Column, prefix: str) -> Column:
    """FN29: which bundled practice recording a lineage id names."""
    return F.when(lineage == prefix + "a", "a").when(lineage == prefix + "b", "b")


def mixed_practice(left: Column, right: Column, prefix: str) -> Column:
    """JN4: exactly one side is a bundled practice recording."""
    return practice_id(left, prefix).isNotNull() != practice_id(right, prefix).isNotNull()


def accepted_ranges(attempts: DataFrame, wide: DataFrame) -> DataFrame:
    """Attempts with the accepted [start, finish] range as columns (NULL when there is none)."""
    s, f = _t("startSignal"), _t("finishPad")
    r = wide.select("attempt_id", F.when(f > s, s).alias("range_start"), F.when(f > s, f).alias("range_end"))
    return attempts.join(r, "attempt_id", "left")


def identity(a: str = "b", b: str = "c") -> Column:
    """JN2 for two attempt structs (attempt_id, lineage_id, file details, accepted range)."""
    g = lambda side, x: F.col(f"{side}.{x}")
    same = (g(a, "attempt_id") == g(b, "attempt_id")) | (
        resolved_lineage(g(a, "attempt_id"), g(a, "lineage_id")) == resolved_lineage(g(b, "attempt_id"), g(b, "lineage_id")))
    details = X.all_of(F.length(g(a, "file_name")) > 0, *[g(a, x) == g(b, x) for x in ("file_name", "duration_s", "width", "height")],
                       *[g(a, x) > 0 for x in ("duration_s", "width", "height")])
    overlap = F.greatest(g(a, "range_start"), g(b, "range_start")) < F.least(g(a, "range_end"), g(b, "range_end"))
    both = g(a, "range_start").isNotNull() & g(b, "range_start").isNotNull()
    return F.when(same, "same-attempt").when(X.truthy(details & both & overlap), "possible-overlap").otherwise("distinct-or-unknown")


def pack_metrics(metrics: DataFrame) -> DataFrame:
    """Metric rows as one map per attempt (seven entries at most)."""
    return metrics.groupBy("attempt_id").agg(F.map_from_entries(F.collect_list(
        F.struct("metric_id", F.struct("value_s", "confidence", "floor_s")))).alias("metrics"))


def timed_attempts(attempts: DataFrame, wide: DataFrame, more: list[Column] = ()) -> DataFrame:
    """Attempts with accepted range and timing metrics, straight from the wide markers: one join.

    ``more``: further metrics of a row of ``wide``, as ``section_struct`` gives them.
    """
    s, f = _t("startSignal"), _t("finishPad")
    rows = F.filter(F.array(*timing_structs(), *more), lambda r: r["value_s"].isNotNull())
    m = F.map_from_entries(F.transform(rows, lambda r: F.struct(r["metric_id"], F.struct(r["value_s"].alias("value_s"), r["confidence"].alias("confidence"), r["floor_s"].alias("floor_s")))))
    facts = wide.select("attempt_id", F.when(f > s, s).alias("range_start"), F.when(f > s, f).alias("range_end"), m.alias("metrics"))
    return attempts.join(facts, "attempt_id", "left")


def consecutive_pairs(ranges: DataFrame) -> DataFrame:
    """Each attempt of an athlete with the athlete's previous one, in date order.

    Metrics and facts travel with the attempt when ``ranges`` carries them, so a pair needs no later join.
    """
    cols = ["attempt_id", "lineage_id", "name", "file_name", "duration_s", "width", "height", "range_start", "range_end"]
    cols += [c for c in ("metrics", "facts") if c in ranges.columns]
    p = previous_row(ranges.select("athlete", "date", *cols), ["athlete"], "date", [F.col("date"), F.col("attempt_id")], cols)
    return p.where(F.col("prev_attempt_id").isNotNull()).select(
        "athlete", "date", F.struct(*[F.col("prev_" + x).alias(x) for x in cols]).alias("b"), F.struct(*cols).alias("c"))


def compare_pairs(pairs: DataFrame, practice_prefix: str, distinct_confirmed: bool = False, context_confirmed: bool = True) -> DataFrame:
    """JN1: seven rows per (baseline, candidate) pair with the outcome of each metric.

    ``pairs`` holds structs ``b`` and ``c`` with the metrics map of each attempt.
    """
    df = pairs.withColumns({"mb": F.col("b.metrics"), "mc": F.col("c.metrics")})
    df = df.withColumn("identity", identity())
    allowed = (F.col("identity") == "distinct-or-unknown") | ((F.col("identity") == "possible-overlap") & F.lit(distinct_confirmed))
    context = F.lit(context_confirmed) & ~mixed_practice(F.col("b.lineage_id"), F.col("c.lineage_id"), practice_prefix)
    df = df.withColumn("_allowed", allowed).withColumn("_context", X.truthy(context))
    ids = F.array(*[F.struct(F.lit(i).alias("metric_ord"), F.lit(x).alias("metric_id")) for i, x in enumerate(METRIC_IDS, 1)])
    df = df.withColumn("_m", F.explode(ids)).withColumn("metric_id", F.col("_m.metric_id")).withColumn("metric_ord", F.col("_m.metric_ord"))
    df = df.withColumn("_x", F.try_element_at("mb", F.col("metric_id"))).withColumn("_y", F.try_element_at("mc", F.col("metric_id")))
    both = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    sure = both & (X.conf_rank("_x.confidence") >= 2) & (X.conf_rank("_y.confidence") >= 2)
    delta = F.when(sure, X.round_ms(F.col("_y.value_s") - F.col("_x.value_s")))
    floor = F.when(sure, F.greatest("_x.floor_s", "_y.floor_s"))
    df = df.withColumn("delta_s", delta).withColumn("floor_s", floor)
    outcome = X.when_chain([
        (~both, "unavailable"), (~sure, "review"), (~F.col("_allowed"), "identity-review"), (~F.col("_context"), "context-review"),
        (F.abs("delta_s") <= F.col("floor_s") + 1e-9, "similar"), (F.col("delta_s") < 0, "gained")], F.lit("lost"))
    return df.select("athlete", F.col("b.attempt_id").alias("baseline_id"), F.col("c.attempt_id").alias("candidate_id"), "identity",
                     (F.col("_allowed") & F.col("_context")).alias("comparison_allowed"), "metric_ord", "metric_id",
                     F.col("_x.value_s").alias("baseline_s"), F.col("_y.value_s").alias("candidate_s"), "delta_s", "floor_s", outcome.alias("outcome"))


def pair_summary(rows: DataFrame) -> DataFrame:
    """AG7: comparable metrics, overall result and the strongest detailed change of each pair."""
    has = F.col("delta_s").isNotNull()
    phase = F.col("metric_id").isin("bottom-phase", "top-phase")
    changed = F.col("outcome").isin("gained", "lost")
    rank = F.struct(F.abs("delta_s").alias("a"), (-F.col("metric_ord")).alias("o"))
    item = F.struct("metric_id", "delta_s", "outcome")
    g = rows.groupBy("athlete", "baseline_id", "candidate_id", "identity", "comparison_allowed").agg(
        F.count_if(has).alias("_n"), F.bool_or(has & phase).alias("_phases"),
        F.max(F.when(F.col("metric_id") == "total", F.struct("delta_s", "floor_s", "outcome"))).alias("_total"),
        F.max_by(F.when(has & phase & changed, item), F.when(has & phase & changed, rank)).alias("_p"),
        F.max_by(F.when(has & (F.col("metric_id") != "total") & changed, item), F.when(has & (F.col("metric_id") != "total") & changed, rank)).alias("_d"))
    best = F.when(F.col("_phases"), F.col("_p")).otherwise(F.col("_d"))
    headline = X.when_chain([
        (F.col("identity") == "same-attempt", "same-attempt"), (~F.col("comparison_allowed") & (F.col("identity") == "possible-overlap"), "confirm-identity"),
        (~F.col("comparison_allowed"), "review-context"), (F.col("_n") == 0, "nothing-comparable"),
        (F.col("_total.delta_s").isNotNull(), F.concat(F.lit("total-"), F.col("_total.outcome"))), (best.isNotNull(), "detail-only")], F.lit("below-floor"))
    return g.select("athlete", "baseline_id", "candidate_id", F.when(F.col("comparison_allowed"), F.col("_n")).otherwise(F.lit(0)).cast("bigint").alias("comparable_metrics"),
                    F.col("_total.delta_s").alias("total_delta_s"), best.getField("metric_id").alias("strongest_metric"),
                    best.getField("delta_s").alias("strongest_delta_s"), headline.alias("headline"))


def context_key(*cols) -> Column:
    """FN18: one digest for the exact versions and ranges a reviewer confirmed."""
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


#: Attempts of one athlete that meet a chosen attempt in one task.
LIBRARY_PART = 4096


def library_attempts(attempts: DataFrame, wide: DataFrame, facts: DataFrame) -> DataFrame:
    """Attempts with the accepted range, the state of their timing and their total; what a choice of baselines needs."""
    return accepted_ranges(attempts, wide).join(facts.select("attempt_id", "timing_state", "total_s"), "attempt_id", "left")


def baseline_choices(library: DataFrame, chosen: Column, practice_prefix: str, part_rows: int = LIBRARY_PART) -> DataFrame:
    """JN3: for each chosen attempt every attempt of the same athlete's library, the attempt itself too, and whether it
    may serve as baseline; if not, the first reason why.

    ``library`` comes from ``library_attempts``; ``chosen`` is a condition on its rows.  Attempts without an athlete form a
    library of their own.  Athletes with more than ``part_rows`` attempts are dealt out in parts, and their chosen attempts
    are repeated once for each part, so the work of an athlete spreads over tasks with the number of attempts; the others
    are joined as they are.  Nothing is collected, and only (athlete, parts) of such athletes is joined beside the pairs.
    """
    cols = ["attempt_id", "lineage_id", "name", "date", "file_name", "duration_s", "width", "height", "range_start", "range_end", "timing_state", "total_s"]
    rows = library.select("athlete", F.struct(*cols).alias("b"), X.truthy(chosen).alias("_chosen"))
    large = rows.groupBy("athlete").agg(F.count("*").alias("_n")).where(F.col("_n") > part_rows).select(F.col("athlete").alias("_a"), F.ceil(F.col("_n") / part_rows).cast("int").alias("_parts"))
    rows = rows.join(large, F.col("athlete").eqNullSafe(F.col("_a")), "left").withColumn("_parts", F.coalesce("_parts", F.lit(1))).drop("_a")
    offered = rows.select("athlete", "b", F.pmod(F.xxhash64("b.attempt_id"), "_parts").cast("int").alias("_part"))
    asked = rows.where("_chosen").select(F.col("athlete").alias("_a"), F.col("b").alias("c"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_p"))
    df = offered.join(asked, F.col("athlete").eqNullSafe(F.col("_a")) & (F.col("_part") == F.col("_p"))).withColumn("_id", identity())
    reason = X.when_chain([
        (F.col("b.attempt_id") == F.col("c.attempt_id"), "current-attempt"), (F.col("_id") == "same-attempt", "same-attempt"),
        (mixed_practice(F.col("b.lineage_id"), F.col("c.lineage_id"), practice_prefix), "practice-baseline"),
        (F.coalesce(F.col("b.timing_state"), F.lit("missing-start")) != "accepted", "timing-needs-review")])
    return df.withColumn("reason", reason).select(
        F.col("c.attempt_id").alias("candidate_id"), F.col("b.attempt_id").alias("baseline_id"), F.col("b.name").alias("baseline_name"), F.col("b.date").alias("baseline_date"),
        F.col("b.total_s").alias("baseline_total_s"), F.col("reason").isNull().alias("eligible"), "reason", (F.col("reason").isNull() & (F.col("_id") == "possible-overlap")).alias("needs_confirmation"))


def first_of_lineage(attempts: DataFrame) -> DataFrame:
    """SET4: one attempt per lineage, the earliest; a copy is not another attempt."""
    row = F.struct("date", "attempt_id")
    return (attempts.withColumn("lineage", resolved_lineage()).groupBy("lineage").agg(F.min(row).alias("r"), F.count("*").alias("copies"))
            .select("lineage", "r.date", "r.attempt_id", "copies"))
