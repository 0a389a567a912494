"""Scoring a study: integrity violations, adjudicated references, errors, intervals, counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.quantiles import group_quantiles

EVENTS = ["start", "hold10", "finish"]
Z95 = 1.959963984540054
ERROR_SLICE_S = 0.25


def is_date(x) -> Column:
    return X.nonempty(x) & X.c(x).try_cast("timestamp").isNotNull()


def wilson(successes: Column, total: Column, z: float = Z95) -> tuple[Column, Column, Column]:
    """AG14: share and its Wilson interval; all NULL when the total is zero."""
    n = F.nullif(total, F.lit(0)).cast("double")
    p, z2 = successes / n, z * z
    scale = 1 + z2 / n
    centre = (p + z2 / (n * 2)) / scale
    half = F.sqrt((p * (1 - p) + z2 / (n * 4)) / n) * z / scale
    low, high = centre - half, centre + half
    return p, F.when(n.isNotNull(), F.greatest(F.lit(0.0), low)), F.when(n.isNotNull(), F.least(F.lit(1.0), high))


def valid_review() -> Column:
    """PRJ38."""
    return X.truthy(F.col("status").isin("confirmed", "disputed") & F.col("independent") & X.nonempty("reviewer_id") & X.nonempty("method")
                    & is_date("reviewed_at") & (X.finite("raw_time") >= 0) & X.nonempty("evidence_source"))


def references(labels: DataFrame) -> DataFrame:
    """JN6: one adjudicated reference per (clip, event), with agreement (AG16) and rule violations.

    The two originals an adjudication cites are found by joining its exploded citations with the
    label rows, so no group of labels is ever collected.
    """
    keys = ["clip_id", "event"]
    rows = labels.withColumn("_valid", valid_review())
    rev, adj = F.col("review_role") == "reviewer", (F.col("review_role") == "adjudicator") & F.col("_valid") & (F.col("status") == "confirmed")
    vrev = rev & F.col("_valid")
    groups = rows.groupBy(*keys).agg(
        F.count_if(rev).alias("n_originals"), F.count_if(vrev).alias("n_reviewers"), F.count_if(adj).alias("n_adjudications"),
        F.max(F.when(vrev, F.col("raw_time"))).alias("_hi"), F.min(F.when(vrev, F.col("raw_time"))).alias("_lo"),
        F.max(F.when(vrev, F.col("evidence_source"))).alias("_ehi"), F.min(F.when(vrev, F.col("evidence_source"))).alias("_elo"),
        F.max(F.when(adj, F.struct("label_id", "raw_time", "evidence_source", "reviewed_at", "notes"))).alias("adj"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("confirmed", "disputed", "unobservable", "pending")])
    cited = (rows.where(adj).select(*keys, F.col("evidence_source").alias("_ae"), F.col("reviewed_at").try_cast("timestamp").alias("_at"),
                                    F.explode(F.split("adjudication_reference", "[;|]")).alias("_c")).withColumn("_c", F.trim("_c")))
    # a citation may repeat: count tokens and distinct tokens, then match each distinct token once
    tokens = cited.groupBy(*keys, "_c").agg(F.count("*").alias("_n"), F.first("_ae").alias("_ae"), F.first("_at").alias("_at"))
    originals = rows.where(rev).select(*keys, F.col("label_id").alias("_c"), F.col("_valid").alias("_ok"), "reviewer_id", "evidence_source", "last_before", "first_after",
                                       F.col("reviewed_at").try_cast("timestamp").alias("_when"))
    good = F.coalesce(F.col("_ok"), F.lit(False))
    cit = tokens.join(originals, [*keys, "_c"], "left").groupBy(*keys).agg(
        F.sum("_n").alias("n_tokens"), F.count("*").alias("n_cited"), F.count("_ok").alias("n_matched"), F.count_if(good).alias("n_valid_cited"),
        F.min(F.when(good, F.col("reviewer_id"))).alias("_r1"), F.max(F.when(good, F.col("reviewer_id"))).alias("_r2"),
        F.bool_and(F.when(good, F.col("_when") <= F.col("_at"))).alias("_dated"), F.bool_and(F.when(good, F.col("evidence_source") == F.col("_ae"))).alias("_same_def"),
        F.count_if(good & (X.finite("last_before") >= 0) & (X.finite("first_after") >= 0)).alias("_brackets"),
        F.max(F.when(good, F.col("last_before"))).alias("_lb"), F.min(F.when(good, F.col("first_after"))).alias("_fa"))
    df = groups.join(cit, keys, "left")
    two = F.coalesce(F.col("n_valid_cited") == 2, F.lit(False))
    disjoint = two & (F.col("_brackets") == 2) & (F.col("_fa") < F.col("_lb"))
    noted = X.nonempty("adj.notes")
    one = F.col("n_adjudications") == 1
    violation = X.when_chain([
        (F.col("n_originals") > 2, "too-many-originals"), (F.col("n_adjudications") > 1, "several-adjudications"),
        (one & ~X.truthy((F.col("n_tokens") == 2) & (F.col("n_cited") == 2) & (F.col("n_matched") == 2)), "bad-citation"),
        (one & two & ~F.col("_dated"), "adjudication-too-early"), (one & X.truthy(disjoint) & ~noted, "unresolved-brackets")])
    comparable = (F.col("n_reviewers") == 2) & (F.col("_ehi") == F.col("_elo"))
    resolved = F.coalesce(F.col("_same_def"), F.lit(True)) | noted
    ready = one & two & (F.col("_r1") != F.col("_r2")) & resolved & F.col("violation").isNull()
    return (df.withColumn("violation", violation).select(
        *keys, "violation", F.when(X.truthy(ready), F.col("adj.raw_time")).alias("reference_time"), F.when(one, F.col("adj.evidence_source")).alias("reference_source"),
        F.when(X.truthy(comparable), F.col("_hi") - F.col("_lo")).alias("agreement"),
        X.truthy((F.col("n_reviewers") == 2) & ~X.truthy(comparable)).alias("definition_disagreement"),
        "n_confirmed", "n_disputed", "n_unobservable", "n_pending"))


def scored(clips: DataFrame, predictions: DataFrame, refs: DataFrame, tolerance: float) -> DataFrame:
    """JN5: held-out fixed-phone originals x events, primary run and reference side by side."""
    held = clips.where("parent_clip_id is null and split = 'held-out' and cohort = 'fixed-phone'").select(
        "clip_id", "primary_run_id", F.explode(F.array(*[F.lit(e) for e in EVENTS])).alias("event"))
    p = predictions.select(F.col("run_id").alias("primary_run_id"), F.col("clip_id").alias("_pc"), "event", F.col("status").alias("prediction"), F.col("raw_time").alias("predicted_s"), F.col("evidence_source").alias("_ps"))
    df = held.join(p, ["primary_run_id", "event"], "left").join(refs, ["clip_id", "event"], "left")
    acc = F.col("prediction") == "accepted"
    matched = acc & F.col("reference_time").isNotNull() & X.nonempty("_ps") & (F.col("_ps") == F.col("reference_source"))
    err = F.when(X.truthy(matched), F.col("predicted_s") - F.col("reference_time"))
    return df.withColumn("error_s", err).select(
        "clip_id", "event", F.coalesce("prediction", F.lit("not-run")).alias("prediction"), "predicted_s", "reference_time", "error_s",
        X.truthy(F.abs("error_s") > tolerance + 1e-9).alias("false_acceptance"),
        X.truthy(acc & F.col("reference_time").isNotNull() & F.col("error_s").isNull()).alias("mismatched_definition"),
        "agreement", F.coalesce("definition_disagreement", F.lit(False)).alias("definition_disagreement"))


def error_summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """AG13: count, signed median, absolute median and absolute 95th percentile."""
    signed = group_quantiles(rows, keys, value, {"signed_median_s": 0.5}, ERROR_SLICE_S)
    absolute = group_quantiles(rows.withColumn("_abs", F.abs(value)), keys, "_abs", {"absolute_median_s": 0.5, "absolute_p95_s": 0.95}, ERROR_SLICE_S).drop("n")
    return signed.join(absolute, keys)


def endpoint_rollup(rows: DataFrame) -> DataFrame:
    """AG15: coverage, false acceptances and the other outcomes, per event."""
    n = lambda s: F.count_if(F.col("prediction") == s)
    g = rows.groupBy("event").agg(
        F.count("*").alias("eligible"), n("accepted").alias("accepted"), F.count("error_s").alias("verified"), F.count_if("false_acceptance").alias("false_acceptances"),
        F.count("reference_time").alias("confirmed_references"), n("review").alias("needs_review"), n("missing").alias("missing"), n("failed").alias("failed"), n("not-run").alias("not_run"),
        F.count_if("mismatched_definition").alias("mismatched_definitions"), F.count("agreement").alias("comparable_pairs"), F.count_if("definition_disagreement").alias("definition_disagreements"))
    cov, lo, hi = wilson(F.col("accepted"), F.col("eligible"))
    fa, flo, fhi = wilson(F.col("false_acceptances"), F.col("verified"))
    return g.withColumn("accepted_without_reference", F.col("accepted") - F.col("verified")).withColumns(
        {"coverage": X.round_us(cov), "coverage_low": X.round_us(lo), "coverage_high": X.round_us(hi),
         "false_share": X.round_us(fa), "false_low": X.round_us(flo), "false_high": X.round_us(fhi)})


def split_leakage(clips: DataFrame, fields: list[str]) -> DataFrame:
    """JN23: groups whose clips sit in both splits."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    return (clips.select("split", F.explode(pairs).alias("g")).groupBy("g.field", "g.value").agg(F.min("split").alias("_a"), F.max("split").alias("_b"), F.count("*").alias("clips"))
            .where("_a <> _b").select("field", "value", "clips"))


def repeated_originals(clips: DataFrame) -> DataFrame:
    """JN24: attempts and files that occur more than once among originals."""
    o = clips.where("parent_clip_id is null")
    pairs = F.array(F.struct(F.lit("attempt").alias("kind"), F.col("attempt_id").cast("string").alias("value")), F.struct(F.lit("file").alias("kind"), F.lower("source_sha256").alias("value")))
    return o.select("clip_id", F.explode(pairs).alias("g")).groupBy("g.kind", "g.value").agg(F.count("*").alias("clips"), F.min("clip_id").alias("first_clip")).where("clips > 1")


def invalid_derivatives(clips: DataFrame) -> DataFrame:
    """JN25: derivatives without an original parent of the same attempt and split (an anti join)."""
    d = clips.where("parent_clip_id is not null").select("clip_id", "parent_clip_id", "attempt_id", "split")
    p = clips.where("parent_clip_id is null").select(F.col("clip_id").alias("parent_clip_id"), "attempt_id", "split")
    return d.join(p, ["parent_clip_id", "attempt_id", "split"], "left_anti").select("clip_id", "parent_clip_id")


def violations(clips: DataFrame, predictions: DataFrame, labels: DataFrame, study_id: str, app_commit: str, frozen_at: str) -> DataFrame:
    """JN26: every broken reference or hash between runs, labels and clips (all of them, not only the first)."""
    c = clips.select(F.col("clip_id").alias("_c"), F.lower("source_sha256").alias("_h"), F.col("duration_s").alias("_d"))
    p = predictions.join(c, F.col("clip_id") == F.col("_c"), "left").withColumn("rule", X.when_chain([
        (F.col("_c").isNull(), "unknown-clip"), (~X.truthy((F.lower("source_sha256") == F.col("_h")) & (F.col("app_commit") == app_commit)), "run-identity"),
        (~X.truthy(F.col("started_at").try_cast("timestamp") >= F.lit(frozen_at).cast("timestamp")), "before-freeze"),
        (~F.col("status").isin("accepted", "review", "missing", "failed"), "status"),
        (~X.truthy((F.col("status") != "accepted") | ((X.finite("raw_time") >= 0) & (F.col("raw_time") <= F.col("_d")))), "accepted-time")]))
    time, lo, hi = X.finite("raw_time"), X.finite("last_before"), X.finite("first_after")
    bracket_ok = (lo <= hi) & (hi <= F.col("_d")) & (time.isNull() | ((time >= lo) & (time <= hi)))
    lab = labels.join(c, F.col("clip_id") == F.col("_c"), "left").withColumn("rule", X.when_chain([
        (~X.truthy(F.col("_c").isNotNull() & (F.col("study_id") == study_id) & (F.lower("source_sha256") == F.col("_h"))), "label-identity"),
        (~F.col("event").isin(*EVENTS, "firstMovement", "padRelease", "officialTotal"), "label-event"),
        (~(F.col("review_role").isin("reviewer", "adjudicator") & F.col("status").isin("pending", "confirmed", "disputed", "unobservable")), "label-role"),
        (X.truthy(time > F.col("_d")), "outside-recording"), (lo.isNotNull() & hi.isNotNull() & ~X.truthy(bracket_ok), "bad-bracket")]))
    return (p.where("rule is not null").select(F.lit("run").alias("entity"), F.col("run_id").alias("entity_id"), F.col("event"), "rule")
            .unionByName(lab.where("rule is not null").select(F.lit("label").alias("entity"), F.col("label_id").alias("entity_id"), "event", "rule")))


def study_counts(clips: DataFrame) -> DataFrame:
    """AG17: originals, and distinct climbers, sessions, phones and gyms, with readiness flags."""
    o = F.col("parent_clip_id").isNull()
    d = lambda x: F.count_distinct(F.when(o, F.col(x)))
    return clips.agg(F.count_if(o).alias("originals"), F.count_if(o & (F.col("split") == "held-out") & (F.col("cohort") == "fixed-phone")).alias("held_out_supported"),
                     F.count_if(o & (F.col("split") == "development")).alias("development"), F.count_if(~o).alias("derivatives"), d("climber_alias").alias("climbers"),
                     d("session_id").alias("sessions"), d("phone_model").alias("phones"), d("gym_alias").alias("gyms")).withColumns({
                         "attempt_target_met": F.col("originals") >= 30, "three_phones": F.col("phones") >= 3, "two_gyms": F.col("gyms") >= 2})


def condition_counts(clips: DataFrame) -> DataFrame:
    """AG17 by condition: split x cohort x phone x gym with subtotals."""
    o = clips.where("parent_clip_id is null")
    return o.groupingSets([["split", "cohort", "phone_model", "gym_alias"], ["split", "cohort"], []], "split", "cohort", "phone_model", "gym_alias").agg(F.count("*").alias("originals"))


def rejection_cohort(clips: DataFrame, predictions: DataFrame) -> DataFrame:
    """AG20: accepted endpoints in the held-out rejection cohort."""
    r = clips.where("parent_clip_id is null and split = 'held-out' and cohort = 'rejection'").select("clip_id", "primary_run_id")
    p = predictions.where("status = 'accepted'").groupBy(F.col("run_id").alias("primary_run_id")).agg(F.count("*").alias("n"))
    return r.join(p, "primary_run_id", "left").agg(F.count("*").alias("attempts"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("accepted_endpoints"))


def workflow_summary(obs: DataFrame) -> DataFrame:
    """AG19: completion, return and correction figures over participants."""
    per = obs.groupBy("participant").agg(
        F.bool_or(X.truthy(F.col("returned"))).alias("returned"), F.bool_or(F.col("returned").isNotNull()).alias("return_seen"),
        F.max(F.when(F.col("task_role") == "first-use", F.struct(F.lit(1), "completed", "assisted"))).alias("first"),
        F.count("*").alias("n"), F.count("correction_s").alias("measured"), F.count_if(X.nonempty("decision")).alias("decisions"))
    seen = F.col("first.completed").isNotNull() & F.col("first.assisted").isNotNull()
    alone = seen & F.col("first.completed") & ~F.col("first.assisted")
    g = per.agg(F.count("*").alias("participants"), F.sum("n").alias("observations"), F.sum("measured").alias("measured"), F.count_if(X.truthy(seen)).alias("completion_observed"),
                F.count_if(X.truthy(alone)).alias("unassisted"), F.count_if("returned").alias("returned"), F.count_if("return_seen").alias("return_observed"), F.sum("decisions").alias("decisions"))
    p, lo, hi = wilson(F.col("unassisted"), F.col("completion_observed"))
    q, qlo, qhi = wilson(F.col("returned"), F.col("return_observed"))
    return g.withColumns({"unassisted_share": X.round_us(p), "unassisted_low": X.round_us(lo), "unassisted_high": X.round_us(hi),
                          "return_share": X.round_us(q), "return_low": X.round_us(qlo), "return_high": X.round_us(qhi)})


def workflow_violations(obs: DataFrame) -> DataFrame:
    """AG19: first use must be unique, a follow-up needs a later session of the same participant."""
    first = obs.where("task_role = 'first-use'")
    dup = first.groupBy("participant").agg(F.count("*").alias("n")).where("n > 1").select("participant", F.lit("several-first-uses").alias("rule"), F.lit(None).cast("string").alias("observation_id"))
    early = first.where("returned is not null").select("participant", F.lit("return-on-first-use").alias("rule"), "observation_id")
    base = first.groupBy("participant").agg(F.min(F.struct("observed_at", "session_id")).alias("b"))
    follow = obs.where("task_role = 'follow-up'").join(base, "participant", "left")
    ok = F.col("b").isNotNull() & (F.col("b.session_id") != F.col("session_id")) & (F.col("observed_at") > F.col("b.observed_at"))
    late = follow.where(~X.truthy(ok)).select("participant", F.lit("follow-up-without-first-use").alias("rule"), "observation_id")
    return reduce(DataFrame.unionByName, [dup, early, late])
