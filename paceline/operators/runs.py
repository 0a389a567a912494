"""Run regression: before/after pairing, media variations, known failures, user references, trials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from .study import is_date, wilson

SLACK = 1e-9


def duplicate_run_keys(runs: DataFrame) -> DataFrame:
    """SET5: (source, variation) keys that cannot be paired because they repeat."""
    return runs.groupBy("source_name", "variation_id").agg(F.count("*").alias("runs")).where("runs > 1")


def boundary_status(old: Column, new: Column, tolerance: float) -> Column:
    d = F.abs(X.round_us(new - old))
    return X.when_chain([
        (old.isNull() & new.isNull(), "remains-unaccepted"), (old.isNull(), "new-unverified-acceptance"), (new.isNull(), "availability-loss"),
        (d > tolerance + SLACK, "output-timing-drift"), (d > SLACK, "changed-within-policy")], F.lit("unchanged"))


def coverage(valid: Column, requested: Column) -> Column:
    ok = (requested > 0) & (valid >= 0) & (valid <= requested)
    return F.when(ok, X.round_us(valid / requested))


def pair_runs(before: DataFrame, after: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """JN8 (and SET3): full outer pairing of two reports on (source, variation)."""
    keys = ["source_name", "variation_id"]
    b = before.select(*keys, F.struct(*[c for c in before.columns if c not in keys]).alias("b"))
    a = after.select(*keys, F.struct(*[c for c in after.columns if c not in keys]).alias("a"))
    df = b.join(a, keys, "full_outer")
    hashes = X.all_of(*[X.valid_hash(f"{s}.{h}") for s in "ba" for h in ("media_sha256", "source_sha256")])
    same = X.truthy((F.col("b.media_sha256") == F.col("a.media_sha256")) & (F.col("b.source_sha256") == F.col("a.source_sha256")))
    failed = F.col("b.error").isNotNull() | F.col("a.error").isNotNull() | ~F.col("b.has_outcome") | ~F.col("a.has_outcome")
    status = X.when_chain([(F.col("a").isNull(), "missing-after"), (F.col("b").isNull(), "added-after"), (~hashes, "unverified-media-identity"),
                           (~same, "different-media"), (failed, "workflow-error")], F.lit("paired"))
    df = df.withColumn("status", status)
    paired = F.col("status") == "paired"
    out = {}
    for e in ("start", "finish"):
        old, new = X.marker_seconds(f"b.{e}_text"), X.marker_seconds(f"a.{e}_text")
        out[f"{e}_before"], out[f"{e}_after"] = F.when(paired, old), F.when(paired, new)
        out[f"{e}_delta"] = F.when(paired, X.round_us(new - old))
        out[f"{e}_status"] = F.when(paired, boundary_status(old, new, tolerance))
    comparable = paired & F.col("b.full_workflow") & F.col("a.full_workflow") & (F.col("b.sample_fps") == F.col("a.sample_fps"))
    cb, ca = coverage(F.col("b.valid_frames"), F.col("b.requested_frames")), coverage(F.col("a.valid_frames"), F.col("a.requested_frames"))
    out["coverage_delta"] = F.when(comparable, X.round_us(ca - cb))
    return df.withColumns(out).select(*keys, "status", *out)


def regression_summary(cases: DataFrame) -> DataFrame:
    """AG24: counts only; agreement without labels is never turned into accuracy."""
    n = lambda s: sum(F.count_if(F.col(f"{e}_status") == s) for e in ("start", "finish"))
    return cases.agg(F.count_if(F.col("status") == "paired").alias("paired"), F.count_if(F.col("status") != "paired").alias("unpaired"),
                     n("availability-loss").alias("availability_losses"), n("new-unverified-acceptance").alias("new_unverified"), n("output-timing-drift").alias("timing_drifts"),
                     n("changed-within-policy").alias("changed_within_policy")).withColumn("accuracy", F.lit(None).cast("double"))


def independent_label_time(label: str = "label") -> Column:
    """Time of an auditable label: confirmed, independent, with reviewer, method and date."""
    g = lambda k: F.col(f"{label}.{k}")
    ok = (g("status") == "confirmed") & g("independent") & X.nonempty(g("reviewer_id")) & X.nonempty(g("method")) & is_date(g("reviewed_at")) & (X.finite(g("raw_time")) >= 0)
    return F.when(X.truthy(ok), g("raw_time"))


def label_outcome(raw_time, label_time, tolerance: float = 0.1) -> Column:
    """AG26."""
    t, l = X.finite(raw_time), X.c(label_time)
    return F.when(t.isNull() | l.isNull(), "unverified").when(F.abs(t - l) <= tolerance + SLACK, "within-tolerance").otherwise("outside-tolerance")


def assess_variations(rows: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """JN9: one row per (trial, variation, boundary), already joined with trim and outcome.

    Needs ref_status, ref_time, label_time (independent or NULL), trim_s, observed_text.
    """
    obs = X.marker_seconds("observed_text")
    ref, lab = X.finite("ref_time") - F.col("trim_s"), F.col("label_time") - F.col("trim_s")
    accepted = F.coalesce(F.col("ref_status") == "accepted", F.lit(False))
    sdelta, delta = obs - ref, obs - lab
    source = X.when_chain([(~accepted | ref.isNull(), "unbaselined"), (obs.isNull(), "availability-loss"), (F.abs(sdelta) <= tolerance + SLACK, "consistent")], F.lit("source-timing-regression"))
    status = X.when_chain([
        (obs.isNull() & accepted, "availability-loss"), (obs.isNull(), "remains-unaccepted"), (lab.isNull() | (lab < 0), "unverified-acceptance"),
        (F.abs(delta) > tolerance + SLACK, "timing-regression"), (accepted, "consistent")], F.lit("new-labeled-acceptance"))
    return rows.withColumns({"observed_s": obs, "source_delta_s": X.round_us(sdelta), "label_delta_s": X.round_us(delta), "source_consistency": source, "boundary_status": status})


def variation_verdict(boundaries: DataFrame, keys: list[str]) -> DataFrame:
    """JN9: does a variation need investigation?"""
    bad = F.col("boundary_status").isin("timing-regression", "unverified-acceptance", "availability-loss") | (F.col("source_consistency") == "source-timing-regression")
    t = lambda b: F.max(F.when(F.col("boundary") == b, F.col("observed_s")))
    return boundaries.groupBy(*keys).agg(F.bool_or(bad).alias("needs_investigation"), F.bool_or(F.col("boundary_status") == "timing-regression").alias("safety_regression"),
                                         F.bool_or(F.col("source_consistency") == "source-timing-regression").alias("source_timing_regression"), X.round_us(t("finish") - t("start")).alias("observed_duration_s"))


def tracking_status(ref_usable, ref_requested, valid, requested) -> Column:
    rc = F.when((X.c(ref_requested) > 0) & (X.c(ref_usable) >= 3), X.c(ref_usable) / X.c(ref_requested))
    oc = F.when(X.c(requested) > 0, X.c(valid) / X.c(requested)).otherwise(0.0)
    return F.when(rc.isNull(), "unbaselined").when(X.c(valid) < 3, "availability-loss").when(oc < rc - 0.2, "coverage-loss").otherwise("retained")


# Fixed value: how the status text of a stopped analysis begins.
STOPPED = r"(?i)^(?:Quick Analyze|Reviewed-start analysis) stopped(?:[.:]|$)"


def analysis_failed(status) -> Column:
    """FN22."""
    return F.coalesce(F.trim(X.c(status)).rlike(STOPPED), F.lit(False))


def known_failure_status(cases: DataFrame, outcomes: DataFrame) -> DataFrame:
    """JN10: does a recorded failure recur?  Joined on the case's own recording."""
    df = cases.join(outcomes, "case_id", "left")
    text = F.col("boundary_text")
    t = X.marker_seconds(text)
    repeated = F.abs(t - F.col("rejected_raw_time")) <= F.col("tolerance_s") + SLACK
    status = X.when_chain([
        (~X.truthy(F.lower("media_sha256") == F.lower("sha256")), "media-mismatch"), (F.col("error").isNotNull() | analysis_failed("analysis_status"), "workflow-error"),
        (~X.nonempty("analysis_status"), "unreadable-status"), (t.isNull() & ~X.truthy(text == "Not set"), "unreadable-boundary"),
        (repeated, "known-failure-recurred"), (t.isNull(), "guard-held")], F.lit("different-output-needs-review"))
    df = df.withColumn("status", status)
    return df.select("case_id", "status", (~F.col("status").isin("guard-held", "different-output-needs-review")).alias("failed"), t.alias("accepted_raw_time"))


def user_reference(refs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """JN11: reported totals matched by exact file hash, never by name."""
    o = outcomes.select(F.col("sha256").alias("source_sha256"), "start_s", "finish_s", "hold_x", "hold_y")
    df = refs.join(o, "source_sha256", "left")
    total = F.col("finish_s") - F.col("start_s")
    far = F.hypot(F.col("hold_x") - F.col("expected_x"), F.col("hold_y") - F.col("expected_y")) > F.col("radius")
    return df.select("reference_id", X.round_ms(total).alias("measured_total_s"), X.round_ms(total - F.col("expected_total_s")).alias("signed_error_s"),
                     F.coalesce(far, F.lit(True)).alias("hold_missing_or_outside"))


def snapshot_violations(declared: DataFrame, snapshot: DataFrame) -> DataFrame:
    """JN12: declared predictions against the preserved automatic snapshot."""
    s = snapshot.groupBy("run_id", "event").agg(F.count("*").alias("n"), F.max("accepted_raw_time").alias("t"), F.max(F.when(F.col("accepted_raw_time").isNotNull(), F.col("acceptance_mode"))).alias("mode"))
    df = declared.join(s, ["run_id", "event"], "left")
    rule = X.when_chain([
        (F.coalesce("n", F.lit(0)) != 1, "marker-count"), (F.col("t").isNotNull() & ~X.truthy(F.col("mode") == "automatic"), "not-automatic"),
        (F.col("t").isNotNull() & ~X.truthy(F.col("status") == "automatic"), "acceptance-removed"), (F.col("t").isNotNull() & ~X.truthy(F.col("raw_time") == F.col("t")), "time-differs"),
        (F.col("t").isNull() & X.truthy(F.col("status") == "automatic"), "promoted")])
    return df.withColumn("rule", rule).where("rule is not null").select("run_id", "event", "rule")


def failure_messages(parts: DataFrame, runs: DataFrame) -> DataFrame:
    """AG27: reasons of a failed benchmark joined in their order; at most one message per reason row."""
    g = (parts.where(X.nonempty("reason")).groupBy("run_id")
         .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "reason"))), lambda r: r["reason"]), "; ").alias("reasons")))
    df = runs.join(g, "run_id", "left")
    fallback = F.format_string("Workflow runner failed (exit %d, passed=%s).", F.col("exit_code"), F.coalesce(F.col("passed").cast("string"), F.lit("unavailable")))
    good = (F.col("exit_code") == 0) & F.coalesce(F.col("passed"), F.lit(True))
    return df.select("run_id", F.when(~good, F.coalesce("reasons", fallback)).alias("message"))


def trial_summary(trials: DataFrame, keys: list[str]) -> DataFrame:
    """AG25: acceptance, labelled outcomes and frame rates of benchmark trials."""
    cnt = lambda cond: F.count_if(X.truthy(cond))
    acc = lambda b: F.col(f"{b}_status") == "accepted"
    rev = lambda b: F.col(f"{b}_status") == "review"
    com = F.col("usable_frames").isNotNull() & F.col("requested_frames").isNotNull()
    aggs = [F.count("*").alias("videos")]
    for b in ("start", "finish"):
        out = F.col(f"{b}_outcome")
        aggs += [cnt(acc(b)).alias(f"{b}_accepted"), cnt(rev(b)).alias(f"{b}_review"), cnt(acc(b) & (out == "within-tolerance")).alias(f"{b}_correct"),
                 cnt(acc(b) & (out == "outside-tolerance")).alias(f"{b}_false"), cnt(acc(b) & (out == "unverified")).alias(f"{b}_unverified")]
    aggs += [cnt(com).alias("com_videos"), F.sum(F.when(com, F.col("usable_frames"))).alias("usable"), F.sum(F.when(com, F.col("requested_frames"))).alias("requested"),
             F.count("reaction_error").alias("reaction_checks"), F.max("reaction_error").alias("worst_reaction_error")]
    g = trials.withColumn("reaction_error", X.round_us(F.abs(F.col("measured_reaction") - F.col("official_reaction")))).groupBy(*keys).agg(*aggs)
    _, lo, hi = wilson(F.col("start_correct"), F.col("start_correct") + F.col("start_false"), 1.96)
    return g.withColumns({"start_rate": X.round_us(F.col("start_accepted") / F.col("videos")), "usable_rate": X.round_us(F.col("usable") / F.nullif("requested", F.lit(0))),
                          "precision_low": X.round_ms(lo), "precision_high": X.round_ms(hi)})
