"""Queries that score a study."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.quantiles import group_quantiles
from ..operators import study as S
from ..sources import study_files as Q
from . import roles as R
from . import study_roles as V
from .registry import query

TOL = 0.1
VALID = "status IN ('confirmed','disputed') AND independent AND length(trim(reviewer_id))>0 AND length(trim(method))>0 AND try_cast(reviewed_at AS TIMESTAMP) IS NOT NULL AND raw_time >= 0 AND length(trim(evidence_source))>0"
ISADJ = "review_role='adjudicator' AND valid AND status='confirmed'"
REFS = f"""lv AS (SELECT *, {VALID} AS valid FROM lab),
gr AS (SELECT clip_id, event, count(*) FILTER (review_role='reviewer') AS n_orig, count(*) FILTER (review_role='reviewer' AND valid) AS n_rev, count(*) FILTER ({ISADJ}) AS n_adj,
 max(raw_time) FILTER (review_role='reviewer' AND valid) - min(raw_time) FILTER (review_role='reviewer' AND valid) AS spread, count(DISTINCT evidence_source) FILTER (review_role='reviewer' AND valid) AS n_ev,
 max(raw_time) FILTER ({ISADJ}) AS a_time, max(evidence_source) FILTER ({ISADJ}) AS a_ev, max(notes) FILTER ({ISADJ}) AS a_notes,
 count(*) FILTER (status='confirmed') AS n_confirmed, count(*) FILTER (status='disputed') AS n_disputed, count(*) FILTER (status='unobservable') AS n_unobservable, count(*) FILTER (status='pending') AS n_pending FROM lv GROUP BY 1,2),
ct AS (SELECT a.clip_id, a.event, a.evidence_source AS ae, CAST(a.reviewed_at AS TIMESTAMP) AS aat, unnest(a.cites) AS c FROM lv a WHERE {ISADJ}),
cm AS (SELECT t.clip_id, t.event, count(*) AS n_tok, count(DISTINCT c) AS n_cited, count(o.label_id) AS n_match, count(*) FILTER (o.valid) AS n_val, count(DISTINCT o.reviewer_id) FILTER (o.valid) AS n_people,
  bool_and(CAST(o.reviewed_at AS TIMESTAMP) <= aat) FILTER (o.valid) AS dated, bool_and(o.evidence_source = ae) FILTER (o.valid) AS same_def, count(*) FILTER (o.valid AND o.last_before >= 0 AND o.first_after >= 0) AS n_br,
  max(o.last_before) FILTER (o.valid) AS lb, min(o.first_after) FILTER (o.valid) AS fa
  FROM ct t LEFT JOIN lv o ON o.clip_id=t.clip_id AND o.event=t.event AND o.label_id=t.c AND o.review_role='reviewer' GROUP BY 1,2),
rv AS (SELECT g.*, m.n_val, m.n_people, m.same_def, CASE WHEN n_orig > 2 THEN 'too-many-originals' WHEN n_adj > 1 THEN 'several-adjudications'
  WHEN n_adj=1 AND NOT coalesce(n_tok=2 AND n_cited=2 AND n_match=2, false) THEN 'bad-citation' WHEN n_adj=1 AND n_val=2 AND NOT dated THEN 'adjudication-too-early'
  WHEN n_adj=1 AND n_val=2 AND n_br=2 AND fa < lb AND a_notes IS NULL THEN 'unresolved-brackets' END AS violation FROM gr g LEFT JOIN cm m ON g.clip_id=m.clip_id AND g.event=m.event),
refs AS (SELECT clip_id, event, violation, CASE WHEN n_adj=1 AND n_val=2 AND n_people=2 AND (coalesce(same_def,true) OR a_notes IS NOT NULL) AND violation IS NULL THEN a_time END AS reference_time,
 CASE WHEN n_adj=1 THEN a_ev END AS reference_source, CASE WHEN n_rev=2 AND n_ev=1 THEN spread END AS agreement, n_rev=2 AND n_ev<>1 AS definition_disagreement, n_confirmed, n_disputed, n_unobservable, n_pending FROM rv)"""
SCORED = f"""held AS (SELECT clip_id, primary_run_id, unnest(['start','hold10','finish']) AS event FROM clips WHERE parent_clip_id IS NULL AND split='held-out' AND cohort='fixed-phone'),
sc0 AS (SELECT h.clip_id, h.event, coalesce(p.status,'not-run') AS prediction, p.raw_time AS predicted_s, r.reference_time, CASE WHEN p.status='accepted' AND p.evidence_source = r.reference_source THEN p.raw_time - r.reference_time END AS error_s,
 r.agreement, coalesce(r.definition_disagreement, false) AS definition_disagreement FROM held h LEFT JOIN preds p ON p.run_id=h.primary_run_id AND p.event=h.event LEFT JOIN refs r ON r.clip_id=h.clip_id AND r.event=h.event),
scored AS (SELECT clip_id, event, prediction, predicted_s, reference_time, error_s, coalesce(abs(error_s) > 0.1 + 1e-9, false) AS false_acceptance, prediction='accepted' AND reference_time IS NOT NULL AND error_s IS NULL AS mismatched_definition, agreement, definition_disagreement FROM sc0)"""
ALL = f"WITH {V.CLIPS}, {V.PREDICTIONS}, {V.LABELS}, {REFS}, {SCORED}"


def r6(x):
    return f"(floor(({x})*1000000+0.5)/1000000)"


def wil(k, n, z="1.959963984540054"):
    p, z2 = f"(CAST({k} AS DOUBLE)/nullif({n},0))", f"CAST({z} AS DOUBLE)*CAST({z} AS DOUBLE)"
    c = f"(({p}+{z2}/(2.0*{n}))/(1+{z2}/{n}))"
    h = f"(sqrt(({p}*(1-{p})+{z2}/(4.0*{n}))/{n})*{z}/(1+{z2}/{n}))"
    return p, f"(CASE WHEN {n}>0 THEN greatest(0.0,{c}-{h}) END)", f"(CASE WHEN {n}>0 THEN least(1.0,{c}+{h}) END)"


def scored(spark, sf):
    return S.scored(V.clips(spark, sf), V.predictions(spark, sf), S.references(V.labels(spark, sf)), TOL)


@query("prj38", f"WITH {V.LABELS} SELECT label_id, {VALID} AS valid FROM lab")
def prj38(spark, sf):
    return V.labels(spark, sf).select("label_id", S.valid_review().alias("valid"))


@query("jn6", f"WITH {V.LABELS}, {REFS} SELECT * FROM refs")
def jn6(spark, sf):
    return S.references(V.labels(spark, sf))


@query("jn5", f"{ALL} SELECT * FROM scored")
def jn5(spark, sf):
    return scored(spark, sf)


@query("ag13", f"{ALL} SELECT event, count(error_s) AS n, {r6('quantile_cont(error_s,0.5)')} AS signed_median_s, {r6('quantile_cont(abs(error_s),0.5)')} AS absolute_median_s, {r6('quantile_cont(abs(error_s),0.95)')} AS absolute_p95_s FROM scored WHERE error_s IS NOT NULL GROUP BY 1")
def ag13(spark, sf):
    q = S.error_summary(scored(spark, sf), ["event"], "error_s")
    return q.select("event", "n", *[X.round_us(c).alias(c) for c in ("signed_median_s", "absolute_median_s", "absolute_p95_s")])


@query("ag14", f"SELECT quality, count(*) AS total, sum(toxic) AS successes, {r6(wil('sum(toxic)', 'count(*)')[0])} AS share, {r6(wil('sum(toxic)', 'count(*)')[1])} AS low, {r6(wil('sum(toxic)', 'count(*)')[2])} AS high FROM labels GROUP BY 1")
def ag14(spark, sf):
    g = R.table(spark, sf, "labels").groupBy("quality").agg(F.count("*").alias("total"), F.sum("toxic").alias("successes"))
    p, lo, hi = S.wilson(F.col("successes"), F.col("total"))
    return g.select("quality", "total", "successes", X.round_us(p).alias("share"), X.round_us(lo).alias("low"), X.round_us(hi).alias("high"))


COV, FA = wil("accepted", "eligible"), wil("false_acceptances", "verified")


@query("ag15", f"""{ALL}, g AS (SELECT event, count(*) AS eligible, count(*) FILTER (prediction='accepted') AS accepted, count(error_s) AS verified, count(*) FILTER (false_acceptance) AS false_acceptances, count(reference_time) AS confirmed_references,
 count(*) FILTER (prediction='review') AS needs_review, count(*) FILTER (prediction='missing') AS missing, count(*) FILTER (prediction='failed') AS failed, count(*) FILTER (prediction='not-run') AS not_run,
 count(*) FILTER (mismatched_definition) AS mismatched_definitions, count(agreement) AS comparable_pairs, count(*) FILTER (definition_disagreement) AS definition_disagreements FROM scored GROUP BY 1)
 SELECT *, accepted-verified AS accepted_without_reference, {r6(COV[0])} AS coverage, {r6(COV[1])} AS coverage_low, {r6(COV[2])} AS coverage_high, {r6(FA[0])} AS false_share, {r6(FA[1])} AS false_low, {r6(FA[2])} AS false_high FROM g""")
def ag15(spark, sf):
    return S.endpoint_rollup(scored(spark, sf))


@query("ag16", f"{ALL} SELECT event, count(agreement) AS n, {r6('quantile_cont(agreement,0.5)')} AS median_s, {r6('quantile_cont(agreement,0.95)')} AS p95_s FROM scored WHERE agreement IS NOT NULL GROUP BY 1")
def ag16(spark, sf):
    q = group_quantiles(scored(spark, sf), ["event"], "agreement", {"median_s": 0.5, "p95_s": 0.95}, S.ERROR_SLICE_S)
    return q.select("event", "n", X.round_us("median_s").alias("median_s"), X.round_us("p95_s").alias("p95_s"))


@query("ag17", f"""WITH {V.CLIPS}, o AS (SELECT * FROM clips WHERE parent_clip_id IS NULL) SELECT count(*) AS originals, count(*) FILTER (split='held-out' AND cohort='fixed-phone') AS held_out_supported, count(*) FILTER (split='development') AS development,
 (SELECT count(*) FROM clips WHERE parent_clip_id IS NOT NULL) AS derivatives, count(DISTINCT climber_alias) AS climbers, count(DISTINCT session_id) AS sessions, count(DISTINCT phone_model) AS phones, count(DISTINCT gym_alias) AS gyms,
 count(*)>=30 AS attempt_target_met, count(DISTINCT phone_model)>=3 AS three_phones, count(DISTINCT gym_alias)>=2 AS two_gyms FROM o""")
def ag17(spark, sf):
    return S.study_counts(V.clips(spark, sf))


@query("ag17_conditions", f"WITH {V.CLIPS} SELECT split, cohort, phone_model, gym_alias, count(*) AS originals FROM clips WHERE parent_clip_id IS NULL GROUP BY GROUPING SETS ((split,cohort,phone_model,gym_alias),(split,cohort),())")
def ag17_conditions(spark, sf):
    return S.condition_counts(V.clips(spark, sf))


@query("ag20", f"WITH {V.CLIPS}, {V.PREDICTIONS}, r AS (SELECT * FROM clips WHERE parent_clip_id IS NULL AND split='held-out' AND cohort='rejection') SELECT (SELECT count(*) FROM r) AS attempts, (SELECT count(*) FROM r JOIN preds p ON p.run_id=r.primary_run_id WHERE p.status='accepted') AS accepted_endpoints")
def ag20(spark, sf):
    return S.rejection_cohort(V.clips(spark, sf), V.predictions(spark, sf))


U, RT = wil("unassisted", "completion_observed"), wil("returned", "return_observed")


@query("ag19", f"""WITH {V.OBS}, p AS (SELECT participant, coalesce(bool_or(returned),false) AS ret, bool_or(returned IS NOT NULL) AS seen, count(*) AS n, count(correction_s) AS measured, count(*) FILTER (length(trim(decision))>0) AS dec FROM obs GROUP BY 1),
 f0 AS (SELECT participant, completed, assisted, row_number() OVER (PARTITION BY participant ORDER BY completed DESC NULLS LAST, assisted DESC NULLS LAST) AS rn FROM obs WHERE task_role='first-use'), f AS (SELECT * FROM f0 WHERE rn=1),
 g AS (SELECT count(*) AS participants, sum(n) AS observations, sum(measured) AS measured, count(*) FILTER (f.completed IS NOT NULL AND f.assisted IS NOT NULL) AS completion_observed, count(*) FILTER (f.completed AND NOT f.assisted) AS unassisted,
  count(*) FILTER (ret) AS returned, count(*) FILTER (seen) AS return_observed, sum(dec) AS decisions FROM p LEFT JOIN f USING (participant))
 SELECT *, {r6(U[0])} AS unassisted_share, {r6(U[1])} AS unassisted_low, {r6(U[2])} AS unassisted_high, {r6(RT[0])} AS return_share, {r6(RT[1])} AS return_low, {r6(RT[2])} AS return_high FROM g""")
def ag19(spark, sf):
    return S.workflow_summary(V.observations(spark, sf))


@query("ag19_violations", f"""WITH {V.OBS}, f AS (SELECT * FROM obs WHERE task_role='first-use'), b AS (SELECT participant, observed_at, session_id, row_number() OVER (PARTITION BY participant ORDER BY observed_at, session_id) AS rn FROM f)
 SELECT participant, 'several-first-uses' AS rule, NULL AS observation_id FROM f GROUP BY 1 HAVING count(*)>1 UNION ALL SELECT participant, 'return-on-first-use', observation_id FROM f WHERE returned IS NOT NULL
 UNION ALL SELECT o.participant, 'follow-up-without-first-use', o.observation_id FROM obs o LEFT JOIN b ON b.participant=o.participant AND b.rn=1 WHERE o.task_role='follow-up' AND NOT coalesce(b.session_id <> o.session_id AND o.observed_at > b.observed_at, false)""")
def ag19_violations(spark, sf):
    return S.workflow_violations(V.observations(spark, sf))


@query("ag19_corrections", f"WITH {V.OBS} SELECT task_role, count(correction_s) AS n, quantile_cont(correction_s,0.5) AS median_s, {r6('quantile_cont(correction_s,0.95)')} AS p95_s FROM obs WHERE correction_s IS NOT NULL GROUP BY 1")
def ag19_corrections(spark, sf):
    q = group_quantiles(V.observations(spark, sf), ["task_role"], "correction_s", {"median_s": 0.5, "p95_s": 0.95}, 5.0)
    return q.select("task_role", "n", "median_s", X.round_us("p95_s").alias("p95_s"))


@query("jn23", f"WITH {V.CLIPS}, g AS (SELECT 'session_id' AS field, session_id AS value, split FROM clips UNION ALL SELECT 'climber_alias', climber_alias, split FROM clips) SELECT field, value, count(*) AS clips FROM g GROUP BY 1,2 HAVING count(DISTINCT split) > 1")
def jn23(spark, sf):
    return S.split_leakage(V.clips(spark, sf), ["session_id", "climber_alias"])


@query("jn24", f"WITH {V.CLIPS}, g AS (SELECT clip_id, 'attempt' AS kind, CAST(attempt_id AS VARCHAR) AS value FROM clips WHERE parent_clip_id IS NULL UNION ALL SELECT clip_id, 'file', lower(source_sha256) FROM clips WHERE parent_clip_id IS NULL) SELECT kind, value, count(*) AS clips, min(clip_id) AS first_clip FROM g GROUP BY 1,2 HAVING count(*)>1")
def jn24(spark, sf):
    return S.repeated_originals(V.clips(spark, sf))


@query("jn25", f"WITH {V.CLIPS} SELECT d.clip_id, d.parent_clip_id FROM clips d WHERE d.parent_clip_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM clips p WHERE p.clip_id=d.parent_clip_id AND p.parent_clip_id IS NULL AND p.attempt_id=d.attempt_id AND p.split=d.split)")
def jn25(spark, sf):
    return S.invalid_derivatives(V.clips(spark, sf))


@query("jn26", f"""WITH {V.CLIPS}, {V.PREDICTIONS}, {V.LABELS}, p AS (SELECT 'run' AS entity, run_id AS entity_id, event, CASE WHEN c.clip_id IS NULL THEN 'unknown-clip' WHEN NOT (p.source_sha256=c.source_sha256 AND app_commit='abcdef1') THEN 'run-identity'
  WHEN CAST(started_at AS TIMESTAMP) < TIMESTAMP '2024-01-05' THEN 'before-freeze' WHEN status='accepted' AND NOT (raw_time>=0 AND raw_time<=c.duration_s) THEN 'accepted-time' END AS rule FROM preds p LEFT JOIN clips c ON p.clip_id=c.clip_id),
 l AS (SELECT 'label' AS entity, label_id AS entity_id, event, CASE WHEN l.source_sha256<>c.source_sha256 OR c.clip_id IS NULL THEN 'label-identity' WHEN event NOT IN ('start','hold10','finish','firstMovement','padRelease','officialTotal') THEN 'label-event'
  WHEN raw_time > c.duration_s THEN 'outside-recording' WHEN NOT (last_before<=first_after AND first_after<=c.duration_s AND raw_time>=last_before AND raw_time<=first_after) THEN 'bad-bracket' END AS rule FROM lab l LEFT JOIN clips c ON l.clip_id=c.clip_id)
 SELECT * FROM p WHERE rule IS NOT NULL UNION ALL SELECT * FROM l WHERE rule IS NOT NULL""")
def jn26(spark, sf):
    return S.violations(V.clips(spark, sf), V.predictions(spark, sf), V.labels(spark, sf), V.STUDY, V.COMMIT, V.FROZEN)


@query("set7", f"WITH {V.CLIPS} SELECT clip_id, split FROM clips WHERE parent_clip_id IS NULL")
def set7(spark, sf):
    return V.clips(spark, sf).where("parent_clip_id is null").select("clip_id", "split")


@query("src5", """SELECT doc_id AS "labelId", CASE WHEN quality=1 THEN doc_id/7.0 END AS "labelReview.rawTime", toxic=1 AS "labelReview.independentOfDetector" FROM labels""")
def src5(spark, sf):
    raw = R.table(spark, sf, "labels").select(F.col("doc_id").alias("labelId"), F.when(F.col("quality") == 1, F.concat(F.lit(" "), (F.col("doc_id") / 7.0).cast("string"))).otherwise("").alias("labelReview.rawTime"),
                                              (F.col("toxic") == 1).cast("string").alias("labelReview.independentOfDetector"))
    t = Q.typed_worksheet(raw.withColumn("labelId", F.col("labelId").cast("string")))
    return t.withColumn("labelId", F.col("labelId").cast("bigint"))


@query("src6", f"WITH {V.PREDICTIONS} SELECT run_id, clip_id, event, status, raw_time FROM preds")
def src6(spark, sf):
    """Predictions nested into manifest documents, then exploded again by the reader's own shape."""
    p = V.predictions(spark, sf)
    runs = p.groupBy("run_id", "clip_id").agg(F.map_from_entries(F.collect_list(F.struct("event", F.struct("status", F.col("raw_time").alias("rawTime"), F.col("evidence_source").alias("evidenceSource"))))).alias("events"))
    doc = runs.select(F.to_json(F.struct(F.lit(1).alias("version"), F.lit("s").alias("studyId"), F.array(F.struct(F.col("run_id").alias("runId"), F.col("clip_id").cast("string").alias("clipId"), "events")).alias("predictions"))).alias("j"))
    study = doc.select(F.from_json("j", Q.STUDY_SCHEMA).alias("s")).select("s.*")
    return Q.study_predictions(study).select("run_id", F.col("clip_id").cast("bigint").alias("clip_id"), "event", "status", "raw_time")
