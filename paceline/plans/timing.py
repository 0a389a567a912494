"""Queries over markers, metrics and comparisons (registered with their SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import compare as C
from ..operators import markers as M
from ..operators import metrics as K
from . import roles as R
from .registry import query

PRACTICE = "practice-v1-"
LEGACY = "('COM halfway estimate','Hold contact detection','Future / experimental')"
SOURCES = "(" + ",".join(f"'{x}'" for x in X.MARKER_SOURCES) + ")"
BASE = f"{R.ATTEMPTS}, {R.RAW_MARKERS}"

META = f"""meta AS (SELECT m.attempt_id, marker_id, marker_ord, raw_time, duration_s,
 CASE WHEN source IN {SOURCES} THEN source WHEN raw_time IS NULL THEN 'Not set' ELSE 'Manual' END AS source,
 CASE WHEN confidence IN ('None','Low','Medium','High') THEN confidence WHEN raw_time IS NULL THEN 'None' ELSE 'Low' END AS confidence,
 CASE WHEN detected_raw_time >= 0 AND (duration_s IS NULL OR detected_raw_time <= duration_s + 0.001) THEN detected_raw_time END AS detected_raw_time,
 offset_applied, left(note, 4000) AS note,
 CASE WHEN acceptance_mode IN ('automatic','manual-entry','frame-review') THEN acceptance_mode END AS acceptance_mode,
 CASE WHEN observation_interval_s BETWEEN 0.001 AND 2 THEN observation_interval_s END AS observation_interval_s
 FROM raw_markers m LEFT JOIN attempts a ON m.attempt_id = a.attempt_id)"""

IDS = """ids AS (SELECT unnest(['startSignal','firstMovement','committedLaunch','firstHold','hold10','finishPad']) AS marker_id,
 unnest([1,2,3,4,5,6]) AS marker_ord)"""

REPAIRED = f"""{META}, {IDS}, usable AS (SELECT *, CASE WHEN raw_time >= 0 AND (duration_s IS NULL OR raw_time <= duration_s + 0.001)
  AND NOT (marker_id = 'hold10' AND source IN {LEGACY}) THEN raw_time END AS t FROM meta),
w0 AS (SELECT attempt_id, max(t) FILTER (marker_ord=1) AS s, max(t) FILTER (marker_ord=2) AS m2, max(t) FILTER (marker_ord=3) AS m3,
  max(t) FILTER (marker_ord=4) AS m4, max(t) FILTER (marker_ord=5) AS m5, max(t) FILTER (marker_ord=6) AS f0 FROM usable GROUP BY 1),
w1 AS (SELECT *, CASE WHEN f0 > s + 0.001 THEN f0 END AS f FROM w0),
w2 AS (SELECT *, CASE WHEN m2 >= s AND (f IS NULL OR m2 < f - 0.001) THEN m2 END AS k2 FROM w1),
w3 AS (SELECT *, CASE WHEN m3 >= coalesce(k2, s) AND (f IS NULL OR m3 < f - 0.001) THEN m3 END AS k3 FROM w2),
w4 AS (SELECT *, CASE WHEN m4 >= coalesce(k3, k2, s) AND (f IS NULL OR m4 < f - 0.001) THEN m4 END AS k4 FROM w3),
w5 AS (SELECT *, CASE WHEN m5 >= coalesce(k4, k3, k2, s) AND (f IS NULL OR m5 < f - 0.001) THEN m5 END AS k5 FROM w4),
repaired AS (SELECT w.attempt_id, i.marker_id, CAST(i.marker_ord AS INTEGER) AS marker_ord,
  CASE i.marker_ord WHEN 1 THEN s WHEN 2 THEN k2 WHEN 3 THEN k3 WHEN 4 THEN k4 WHEN 5 THEN k5 ELSE f END AS raw_time,
  CASE WHEN i.marker_ord = 1 THEN CASE WHEN s IS NOT NULL THEN 0.0 END
    ELSE floor((CASE i.marker_ord WHEN 2 THEN k2 WHEN 3 THEN k3 WHEN 4 THEN k4 WHEN 5 THEN k5 ELSE f END - s)*1000+0.5)/1000 END AS climb_time,
  u.detected_raw_time, u.offset_applied, coalesce(u.source, 'Not set') AS source, coalesce(u.confidence, 'None') AS confidence,
  u.acceptance_mode, u.observation_interval_s, u.note
 FROM w5 w CROSS JOIN ids i LEFT JOIN usable u ON u.attempt_id = w.attempt_id AND u.marker_id = i.marker_id
  AND CASE i.marker_ord WHEN 1 THEN s WHEN 2 THEN k2 WHEN 3 THEN k3 WHEN 4 THEN k4 WHEN 5 THEN k5 ELSE f END IS NOT NULL)"""

WIDE_COLS = ",\n ".join(f"max({c}) FILTER (marker_ord={i}) AS {n}_{p}" for i, p in enumerate("smlhxf", 1)
                        for c, n in (("raw_time", "t"), ("source", "src"), ("confidence", "cf"), ("acceptance_mode", "mode"), ("observation_interval_s", "iv")))
WIDE = f"{BASE}, {REPAIRED}, wide AS (SELECT attempt_id, {WIDE_COLS} FROM repaired GROUP BY 1)"


def rank(x):
    return f"(CASE {x} WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END)"


def conf(*xs):
    inner = ", ".join(rank(x) for x in xs)
    return f"(CASE least({inner}) WHEN 3 THEN 'High' WHEN 2 THEN 'Medium' WHEN 1 THEN 'Low' ELSE 'None' END)"


def floor_sql(*ps):
    motion = " OR ".join(f"src_{p} IN ('Body motion detection','Motion-based estimate')" for p in ps)
    spread = "+".join(f"coalesce(iv_{p}, 0)" for p in ps)
    return f"greatest(CASE WHEN {motion} THEN 0.2 ELSE 0.1 END, 2*({spread}))"


def r3(x):
    return f"(floor(({x})*1000+0.5)/1000)"


METRICS = f"""metrics AS (
 SELECT attempt_id, 'total' AS metric_id, {r3('t_f-t_s')} AS value_s, {conf('cf_s','cf_f')} AS confidence, 'Accepted timing' AS evidence, {floor_sql('s','f')} AS floor_s FROM wide WHERE t_f > t_s
 UNION ALL SELECT attempt_id, 'reaction', {r3('t_m-t_s')}, {conf('cf_s','cf_m')}, 'Accepted timing', {floor_sql('s','m')} FROM wide WHERE t_m >= t_s AND (t_f IS NULL OR t_m <= t_f)
 UNION ALL SELECT attempt_id, 'bottom-phase', {r3('t_x-t_s')}, {conf('cf_s','cf_x','cf_f')}, 'Reviewed Hold 10', {floor_sql('s','x')} FROM wide WHERE mode_x='frame-review' AND t_x > t_s AND t_x < t_f
 UNION ALL SELECT attempt_id, 'top-phase', {r3('t_f-t_x')}, {conf('cf_s','cf_x','cf_f')}, 'Reviewed Hold 10', {floor_sql('x','f')} FROM wide WHERE mode_x='frame-review' AND t_x > t_s AND t_x < t_f)"""

LIN = "(CASE WHEN length({0}.lineage_id) <= 256 AND length(trim({0}.lineage_id)) > 0 THEN {0}.lineage_id END)"
RANGED = """ranged AS (SELECT a.*, CASE WHEN t_f > t_s THEN t_s END AS range_start, CASE WHEN t_f > t_s THEN t_f END AS range_end
  FROM attempts a LEFT JOIN wide w ON a.attempt_id = w.attempt_id)"""
IDENTITY = f"""CASE WHEN coalesce({LIN.format('b')}, CAST(b.attempt_id AS VARCHAR)) = coalesce({LIN.format('c')}, CAST(c.attempt_id AS VARCHAR)) THEN 'same-attempt'
       WHEN b.file_name = c.file_name AND b.duration_s = c.duration_s AND b.width = c.width AND b.height = c.height
        AND greatest(b.range_start, c.range_start) < least(b.range_end, c.range_end) AND b.range_start IS NOT NULL AND c.range_start IS NOT NULL THEN 'possible-overlap'
       ELSE 'distinct-or-unknown' END"""
MIXED = "(coalesce(b.lineage_id,'') IN ('practice-v1-a','practice-v1-b')) <> (coalesce(c.lineage_id,'') IN ('practice-v1-a','practice-v1-b'))"
PAIRS = f"""{RANGED},
ord AS (SELECT *, lag(attempt_id) OVER (PARTITION BY athlete ORDER BY date, attempt_id) AS prev_id FROM ranged),
pairs AS (SELECT c.athlete, c.date, b.attempt_id AS baseline_id, c.attempt_id AS candidate_id, b.lineage_id AS bl, c.lineage_id AS cl, b.name AS b_name, c.name AS c_name,
  {IDENTITY} AS identity, {MIXED} AS mixed
  FROM ord c JOIN ranged b ON c.prev_id = b.attempt_id)"""
MIDS = """mids AS (SELECT unnest([1,2,3,4,5,6,7]) AS metric_ord, unnest(['total','reaction','bottom-phase','top-phase','lower-third','middle-third','top-third']) AS metric_id)"""
COMPARE = f"""{MIDS}, joined AS (SELECT p.*, m.metric_ord, m.metric_id, x.value_s AS baseline_s, y.value_s AS candidate_s,
  x.value_s IS NOT NULL AND y.value_s IS NOT NULL AS both_, {rank('x.confidence')} >= 2 AND {rank('y.confidence')} >= 2 AS sure_,
  CASE WHEN {rank('x.confidence')} >= 2 AND {rank('y.confidence')} >= 2 THEN {r3('y.value_s-x.value_s')} END AS delta_s,
  CASE WHEN {rank('x.confidence')} >= 2 AND {rank('y.confidence')} >= 2 THEN greatest(x.floor_s, y.floor_s) END AS floor_s
  FROM pairs p CROSS JOIN mids m LEFT JOIN metrics x ON x.attempt_id = p.baseline_id AND x.metric_id = m.metric_id
  LEFT JOIN metrics y ON y.attempt_id = p.candidate_id AND y.metric_id = m.metric_id),
compared AS (SELECT athlete, baseline_id, candidate_id, identity, identity = 'distinct-or-unknown' AND NOT mixed AS comparison_allowed,
  CAST(metric_ord AS INTEGER) AS metric_ord, metric_id, baseline_s, candidate_s, delta_s, floor_s,
  CASE WHEN NOT both_ THEN 'unavailable' WHEN NOT sure_ THEN 'review' WHEN identity <> 'distinct-or-unknown' THEN 'identity-review'
   WHEN mixed THEN 'context-review' WHEN abs(delta_s) <= floor_s + 1e-9 THEN 'similar' WHEN delta_s < 0 THEN 'gained' ELSE 'lost' END AS outcome FROM joined)"""


def wide(spark, sf):
    return M.repair_wide(R.raw_markers(spark, sf), R.attempts(spark, sf))


def ranged(spark, sf):
    return C.accepted_ranges(R.attempts(spark, sf), wide(spark, sf))


def pairs(spark, sf):
    return C.consecutive_pairs(ranged(spark, sf))


def compared(spark, sf):
    return C.compare_pairs(C.consecutive_pairs(C.timed_attempts(R.attempts(spark, sf), wide(spark, sf))), PRACTICE)


@query("prj1", f"WITH {BASE}, {REPAIRED} SELECT * FROM repaired")
def prj1(spark, sf):
    return M.repair(R.raw_markers(spark, sf), R.attempts(spark, sf))


@query("prj2", f"""WITH {R.RAW_MARKERS} SELECT attempt_id, marker_id, raw_time, CASE WHEN marker_id='startSignal' THEN 0.0
  ELSE floor((raw_time - max(CASE WHEN marker_id='startSignal' THEN raw_time END) OVER (PARTITION BY attempt_id))*1000+0.5)/1000 END AS climb_time FROM raw_markers""")
def prj2(spark, sf):
    return M.climb_times(R.raw_markers(spark, sf)).select("attempt_id", "marker_id", "raw_time", "climb_time")


@query("prj3", f"WITH {BASE}, {META} SELECT attempt_id, marker_id, source, confidence, detected_raw_time, acceptance_mode, observation_interval_s, note FROM meta")
def prj3(spark, sf):
    m = R.raw_markers(spark, sf).join(R.attempts(spark, sf).select("attempt_id", "duration_s"), "attempt_id", "left")
    return M.repair_metadata(m, "duration_s").select("attempt_id", "marker_id", "source", "confidence", "detected_raw_time", "acceptance_mode", "observation_interval_s", "note")


@query("prj4", f"WITH {R.RAW_MARKERS} SELECT attempt_id, marker_id, source FROM raw_markers WHERE NOT (marker_id='hold10' AND source IN {LEGACY})")
def prj4(spark, sf):
    return M.drop_legacy_hold10(R.raw_markers(spark, sf)).select("attempt_id", "marker_id", "source")


def proposals(spark, sf):
    """One proposed marker per attempt: the line of the part with the highest key."""
    li = R.table(spark, sf, "lineitem")
    p = li.groupBy("l_orderkey").agg(F.max(F.struct("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")).alias("x"))
    ids = F.array(*[F.lit(x) for x in [*X.MARKER_IDS, "elbow"]])
    return p.select(F.col("l_orderkey").alias("attempt_id"), F.struct(
        F.element_at(ids, F.col("x.l_linenumber").cast("int")).alias("marker_id"),
        (F.col("x.l_quantity") / 3.0 + F.col("x.l_suppkey") % 7 - 1.0).alias("raw_time"), F.lit(18.0).alias("duration_s"),
        F.lit(None).cast("double").alias("detected_raw_time"), F.lit(None).cast("double").alias("offset_applied"),
        F.lit("Manual").alias("source"), F.lit("High").alias("confidence"), F.lit("manual-entry").alias("acceptance_mode"),
        (F.col("x.l_quantity") / 20.0).alias("observation_interval_s"), F.lit("typed").alias("note")).alias("p"))


PROPOSALS = """props AS (SELECT l_orderkey AS attempt_id,
 ['startSignal','firstMovement','committedLaunch','firstHold','hold10','finishPad','elbow'][l_linenumber] AS mid,
 l_quantity/3.0 + l_suppkey % 7 - 1.0 AS p_raw, floor((l_quantity/3.0 + l_suppkey % 7 - 1.0)*1000+0.5)/1000 AS p_t, l_quantity/20.0 AS p_iv
 FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey DESC, l_suppkey DESC, l_linenumber DESC, l_quantity DESC, l_extendedprice DESC) AS rn FROM lineitem) WHERE rn=1),
verdict AS (SELECT w.*, p.mid, p.p_raw, p.p_t, p.p_iv, CASE WHEN p_raw < 0 THEN 'not-a-time' WHEN p_raw > 18.001 THEN 'after-recording' WHEN mid='elbow' THEN 'unknown-marker'
 WHEN mid<>'startSignal' AND t_s IS NULL THEN 'start-not-set' WHEN mid<>'startSignal' AND p_t < t_s THEN 'before-start'
 WHEN mid='finishPad' AND p_t <= t_s+0.001 THEN 'finish-not-after-start'
 WHEN mid NOT IN ('startSignal','finishPad') AND p_t >= t_f-0.001 THEN 'not-before-finish'
 WHEN (mid='committedLaunch' AND p_t < t_m) OR (mid='firstHold' AND p_t < coalesce(t_l,t_m)) OR (mid='hold10' AND p_t < coalesce(t_h,t_l,t_m)) THEN 'before-previous-marker'
 WHEN (mid='firstMovement' AND p_t > coalesce(t_l,t_h,t_x)) OR (mid='committedLaunch' AND p_t > coalesce(t_h,t_x)) OR (mid='firstHold' AND p_t > t_x) THEN 'after-next-marker' END AS reason
 FROM wide w JOIN props p ON w.attempt_id = p.attempt_id)"""


@query("prj5", f"""WITH {WIDE}, {PROPOSALS}, aft AS (SELECT v.*, i.marker_id, i.marker_ord,
  CASE i.marker_ord WHEN 1 THEN t_s WHEN 2 THEN t_m WHEN 3 THEN t_l WHEN 4 THEN t_h WHEN 5 THEN t_x ELSE t_f END AS old_t,
  CASE i.marker_ord WHEN 1 THEN src_s WHEN 2 THEN src_m WHEN 3 THEN src_l WHEN 4 THEN src_h WHEN 5 THEN src_x ELSE src_f END AS old_src FROM verdict v CROSS JOIN ids i),
 res AS (SELECT attempt_id, reason IS NULL AS accepted, reason, marker_id, CAST(marker_ord AS INTEGER) AS marker_ord,
  CASE WHEN reason IS NOT NULL THEN old_t WHEN marker_id = mid THEN p_t WHEN mid='startSignal' THEN NULL
       WHEN mid='finishPad' AND marker_ord BETWEEN 2 AND 5 AND old_t >= p_t-0.001 THEN NULL ELSE old_t END AS raw_time,
  CASE WHEN reason IS NOT NULL THEN old_src WHEN marker_id = mid THEN 'Manual' WHEN mid='startSignal' THEN 'Not set'
       WHEN mid='finishPad' AND marker_ord BETWEEN 2 AND 5 AND old_t >= p_t-0.001 THEN 'Not set' ELSE old_src END AS source FROM aft)
 SELECT *, CASE WHEN raw_time IS NULL THEN NULL WHEN marker_ord = 1 THEN 0.0 ELSE floor((raw_time - max(CASE WHEN marker_ord=1 THEN raw_time END) OVER (PARTITION BY attempt_id))*1000+0.5)/1000 END AS climb_time FROM res""")
def prj5(spark, sf):
    df = M.accept_proposal(wide(spark, sf).join(proposals(spark, sf), "attempt_id"))
    return M.to_long(df, ["accepted", "reason"]).select("attempt_id", "accepted", "reason", "marker_id", "marker_ord", "raw_time", "source", "climb_time")


@query("prj6", f"""WITH {BASE}, {REPAIRED}, pick AS (SELECT r.*, ['startSignal','firstMovement','committedLaunch','firstHold','hold10','finishPad'][1 + CAST(attempt_id % 6 AS INTEGER)] AS victim FROM repaired r)
 SELECT attempt_id, marker_id, marker_ord, CASE WHEN victim NOT IN ('startSignal', marker_id) THEN raw_time END AS raw_time,
 CASE WHEN victim NOT IN ('startSignal', marker_id) THEN source ELSE 'Not set' END AS source FROM pick""")
def prj6(spark, sf):
    victim = F.element_at(F.array(*[F.lit(x) for x in X.MARKER_IDS]), (1 + F.col("attempt_id") % 6).cast("int"))
    return M.to_long(M.clear_one(wide(spark, sf), victim)).select("attempt_id", "marker_id", "marker_ord", "raw_time", "source")


@query("prj7", f"""WITH {BASE}, {REPAIRED} SELECT attempt_id, marker_id, raw_time IS NOT NULL AS accepted,
 CASE WHEN raw_time IS NULL THEN 'unset' ELSE coalesce(acceptance_mode, 'legacy-unknown') END AS acceptance_audit,
 raw_time IS NOT NULL AND coalesce(acceptance_mode IN ('manual-entry','frame-review'), false) AS user_accepted, false AS is_ground_truth FROM repaired""")
def prj7(spark, sf):
    m = M.repair(R.raw_markers(spark, sf), R.attempts(spark, sf))
    return M.audit(m).select("attempt_id", "marker_id", "accepted", "acceptance_audit", "user_accepted", "is_ground_truth")


@query("prj17", f"WITH {R.ATTEMPTS} SELECT attempt_id, {LIN.format('attempts')} AS lineage, coalesce({LIN.format('attempts')}, CAST(attempt_id AS VARCHAR)) AS resolved FROM attempts")
def prj17(spark, sf):
    return R.attempts(spark, sf).select("attempt_id", C.lineage_text().alias("lineage"), C.resolved_lineage().alias("resolved"))


@query("prj22", f"""WITH {BASE}, {REPAIRED}, k AS (SELECT *, marker_id='startSignal' OR (((source='Manual' AND coalesce(acceptance_mode,'')<>'automatic') OR coalesce(acceptance_mode,'')='frame-review')
   AND NOT (marker_id='hold10' AND source IN {LEGACY})) AS stays FROM repaired)
 SELECT attempt_id, marker_id, CASE WHEN stays THEN raw_time END AS raw_time, CASE WHEN stays THEN source ELSE 'Not set' END AS source,
  CASE WHEN stays THEN climb_time END AS climb_time FROM k""")
def prj22(spark, sf):
    m = M.repair(R.raw_markers(spark, sf), R.attempts(spark, sf))
    return M.clear_after_athlete_change(m, automatic_only=True).select("attempt_id", "marker_id", "raw_time", "source", "climb_time")


@query("prj23", f"WITH {R.RAW_MARKERS} SELECT attempt_id, marker_id, CASE WHEN observation_interval_s BETWEEN 0.001 AND 2 THEN observation_interval_s END AS interval_s FROM raw_markers")
def prj23(spark, sf):
    return R.raw_markers(spark, sf).select("attempt_id", "marker_id", X.observation_interval("observation_interval_s").alias("interval_s"))


P = dict(startSignal="s", firstMovement="m", committedLaunch="l", firstHold="h", hold10="x", finishPad="f")


@query("ag1", f"WITH {WIDE} SELECT attempt_id, " + ", ".join(f"{r3(f't_{P[b]}-t_{P[a]}')} AS {n}" for n, a, b in K.SPLITS) + " FROM wide")
def ag1(spark, sf):
    return K.splits(wide(spark, sf))


@query("ag2", f"""WITH {WIDE}, g AS (SELECT *, coalesce(t_f > t_s AND t_x > t_s AND t_x < t_f, false) AS available FROM wide),
 v AS (SELECT attempt_id, available, cf_x, CASE WHEN available THEN {r3('t_x-t_s')} END AS a, CASE WHEN available THEN {r3('t_f-t_x')} END AS b, CASE WHEN available THEN {r3('t_f-t_s')} END AS tot FROM g)
 SELECT attempt_id, available, a AS start_to_hold10_s, b AS hold10_to_finish_s, tot AS total_s, {r3('a/tot')} AS hold10_share, {r3('abs(a-b)')} AS phase_difference_s,
  CASE WHEN available THEN CASE WHEN {r3('abs(a-b)')} <= 0.05 THEN 'balanced' WHEN a > b THEN 'start-to-hold10' ELSE 'hold10-to-finish' END END AS slower_phase,
  CASE WHEN available THEN cf_x ELSE 'None' END AS confidence FROM v""")
def ag2(spark, sf):
    return K.phase_splits(wide(spark, sf))


@query("ag3", f"WITH {WIDE}, {METRICS} SELECT * FROM metrics")
def ag3(spark, sf):
    return K.timing_metrics(wide(spark, sf))


@query("ag5", f"WITH {WIDE} SELECT attempt_id, CASE WHEN t_s IS NULL OR t_f IS NULL THEN 'None' ELSE {conf('cf_s','cf_f')} END AS timing_confidence FROM wide")
def ag5(spark, sf):
    unset = F.col("startSignal.raw_time").isNull() | F.col("finishPad.raw_time").isNull()
    return wide(spark, sf).select("attempt_id", F.when(unset, "None").otherwise(X.min_confidence("startSignal.confidence", "finishPad.confidence")).alias("timing_confidence"))


@query("ag6", f"WITH {WIDE} SELECT attempt_id, {floor_sql('s','f')} AS floor_total, {floor_sql('s','x')} AS floor_bottom, {floor_sql('x','f')} AS floor_top FROM wide")
def ag6(spark, sf):
    return wide(spark, sf).select("attempt_id", K.comparison_floor("startSignal", "finishPad").alias("floor_total"),
                                  K.comparison_floor("startSignal", "hold10").alias("floor_bottom"), K.comparison_floor("hold10", "finishPad").alias("floor_top"))


@query("ag8", f"WITH {WIDE} SELECT attempt_id, coalesce(t_f > t_s OR (t_m >= t_s AND (t_f IS NULL OR t_m <= t_f)), false) AS comparable FROM wide")
def ag8(spark, sf):
    return K.has_comparable_timing(wide(spark, sf))


FACTS = f"""fq AS (SELECT *, {rank(conf('cf_s','cf_f'))} AS c_t, {rank(conf('cf_s','cf_x','cf_f'))} AS c_p, {rank(conf('cf_s','cf_m'))} AS c_m, {r3('t_f-t_s')} AS tot, {r3('t_m-t_s')} AS mv FROM wide),
 fr AS (SELECT *, coalesce(t_f > t_s AND c_t >= 2 AND tot > 0 AND tot <= 600, false) AS ok FROM fq),
 fs AS (SELECT *, ok AND coalesce(mode_x='frame-review' AND t_x > t_s AND t_x < t_f AND c_p >= 2, false) AS pok, ok AND coalesce(t_m >= t_s AND t_m <= t_f AND c_m >= 2 AND mv >= 0 AND mv <= least(30, tot), false) AS mok FROM fr),
 facts AS (SELECT attempt_id, CASE WHEN ok THEN 'accepted' WHEN t_s IS NULL THEN 'missing-start' WHEN t_f IS NULL THEN 'missing-finish' ELSE 'review' END AS timing_state,
 CASE WHEN ok THEN tot END AS total_s, CASE WHEN mok THEN mv END AS movement_s, pok AS reviewed_hold10, CASE WHEN pok THEN {r3('t_x-t_s')} END AS bottom_s, CASE WHEN pok THEN {r3('t_f-t_x')} END AS top_s,
 CASE WHEN ok THEN least(600, greatest(0.1, {floor_sql('s','f')})) ELSE 0.1 END AS floor_total_s, CASE WHEN pok THEN least(600, greatest(0.1, {floor_sql('s','x')})) END AS floor_bottom_s,
 CASE WHEN pok THEN least(600, greatest(0.1, {floor_sql('x','f')})) END AS floor_top_s FROM fs)"""


@query("ag39", f"WITH {WIDE}, {FACTS} SELECT * FROM facts")
def ag39(spark, sf):
    return K.timing_facts(wide(spark, sf))


@query("jn1", f"WITH {WIDE}, {METRICS}, {PAIRS}, {COMPARE} SELECT * FROM compared")
def jn1(spark, sf):
    return compared(spark, sf)


@query("jn2", f"WITH {WIDE}, {PAIRS} SELECT baseline_id, candidate_id, identity, identity='possible-overlap' AS needs_confirmation FROM pairs")
def jn2(spark, sf):
    return pairs(spark, sf).select(F.col("b.attempt_id").alias("baseline_id"), F.col("c.attempt_id").alias("candidate_id"), C.identity().alias("identity"),
                                   (C.identity() == "possible-overlap").alias("needs_confirmation"))


@query("ag7", f"""WITH {WIDE}, {METRICS}, {PAIRS}, {COMPARE}, agg AS (SELECT athlete, baseline_id, candidate_id, identity, comparison_allowed, count(delta_s) AS n,
  coalesce(bool_or(delta_s IS NOT NULL AND metric_id IN ('bottom-phase','top-phase')), false) AS phases, max(delta_s) FILTER (metric_id='total') AS td, max(outcome) FILTER (metric_id='total' AND delta_s IS NOT NULL) AS tout
  FROM compared GROUP BY ALL),
 det AS (SELECT c.*, row_number() OVER (PARTITION BY c.candidate_id ORDER BY abs(c.delta_s) DESC, c.metric_ord) AS rn FROM compared c JOIN agg a ON c.candidate_id = a.candidate_id
   WHERE c.delta_s IS NOT NULL AND c.outcome IN ('gained','lost') AND CASE WHEN a.phases THEN c.metric_id IN ('bottom-phase','top-phase') ELSE c.metric_id <> 'total' END)
 SELECT a.athlete, a.baseline_id, a.candidate_id, CASE WHEN a.comparison_allowed THEN n ELSE 0 END AS comparable_metrics, td AS total_delta_s, d.metric_id AS strongest_metric, d.delta_s AS strongest_delta_s,
  CASE WHEN a.identity='same-attempt' THEN 'same-attempt' WHEN NOT a.comparison_allowed AND a.identity='possible-overlap' THEN 'confirm-identity' WHEN NOT a.comparison_allowed THEN 'review-context'
   WHEN n = 0 THEN 'nothing-comparable' WHEN td IS NOT NULL THEN 'total-' || tout WHEN d.metric_id IS NOT NULL THEN 'detail-only' ELSE 'below-floor' END AS headline
 FROM agg a LEFT JOIN (SELECT * FROM det WHERE rn=1) d ON a.candidate_id = d.candidate_id""")
def ag7(spark, sf):
    return C.pair_summary(compared(spark, sf))


@query("jn3", f"""WITH {WIDE}, {FACTS}, {RANGED}, q AS (SELECT c.attempt_id AS candidate_id, b.attempt_id AS baseline_id, b.name AS baseline_name, b.date AS baseline_date, f.total_s AS baseline_total_s, f.timing_state, {IDENTITY} AS identity, {MIXED} AS mixed
  FROM ranged c JOIN ranged b ON c.athlete IS NOT DISTINCT FROM b.athlete LEFT JOIN facts f ON b.attempt_id = f.attempt_id WHERE c.attempt_id % 20 = 0),
 r AS (SELECT *, CASE WHEN candidate_id = baseline_id THEN 'current-attempt' WHEN identity='same-attempt' THEN 'same-attempt' WHEN mixed THEN 'practice-baseline' WHEN coalesce(timing_state,'missing-start') <> 'accepted' THEN 'timing-needs-review' END AS reason FROM q)
 SELECT candidate_id, baseline_id, baseline_name, baseline_date, baseline_total_s, reason IS NULL AS eligible, reason, reason IS NULL AND identity='possible-overlap' AS needs_confirmation FROM r""")
def jn3(spark, sf):
    """Baselines for every attempt whose id is divisible by 20, out of the whole library of its athlete."""
    w = wide(spark, sf)
    return C.baseline_choices(C.library_attempts(R.attempts(spark, sf), w, K.timing_facts(w)), F.col("attempt_id") % 20 == 0, PRACTICE)


@query("jn4", f"WITH {WIDE}, {PAIRS} SELECT baseline_id, candidate_id, mixed FROM pairs")
def jn4(spark, sf):
    return pairs(spark, sf).select(F.col("b.attempt_id").alias("baseline_id"), F.col("c.attempt_id").alias("candidate_id"),
                                   C.mixed_practice(F.col("b.lineage_id"), F.col("c.lineage_id"), PRACTICE).alias("mixed"))


@query("set4", f"""WITH {R.ATTEMPTS}, l AS (SELECT *, coalesce({LIN.format('attempts')}, CAST(attempt_id AS VARCHAR)) AS lineage FROM attempts),
 r AS (SELECT *, row_number() OVER (PARTITION BY lineage ORDER BY date, attempt_id) AS rn, count(*) OVER (PARTITION BY lineage) AS copies FROM l) SELECT lineage, date, attempt_id, copies FROM r WHERE rn=1""")
def set4(spark, sf):
    return C.first_of_lineage(R.attempts(spark, sf))


@query("fn29", f"WITH {R.ATTEMPTS} SELECT attempt_id, CASE lineage_id WHEN 'practice-v1-a' THEN 'a' WHEN 'practice-v1-b' THEN 'b' END AS practice FROM attempts")
def fn29(spark, sf):
    return R.attempts(spark, sf).select("attempt_id", C.practice_id(F.col("lineage_id"), PRACTICE).alias("practice"))


@query("fn19", f"""WITH {WIDE} SELECT attempt_id, CASE WHEN t_f IS NULL THEN '' WHEN iv_f IS NULL THEN 'precision-unverified' ELSE 'observation-interval-' || CAST(CAST(floor(iv_f*1000+0.5) AS BIGINT) AS VARCHAR) || '-ms' END AS note FROM wide""")
def fn19(spark, sf):
    iv = X.observation_interval("finishPad.observation_interval_s")
    return wide(spark, sf).select("attempt_id", F.when(F.col("finishPad.raw_time").isNull(), "").when(iv.isNull(), "precision-unverified")
                                  .otherwise(F.concat(F.lit("observation-interval-"), F.floor(iv * 1000 + 0.5).cast("string"), F.lit("-ms"))).alias("note"))


@query("fn18", f"""WITH {WIDE}, {PAIRS} SELECT baseline_id, candidate_id, sha256('{{"b":' || baseline_id || ',"c":' || candidate_id || ',"bl":' || CASE WHEN bl IS NULL THEN 'null' ELSE '"' || bl || '"' END || '}}') AS context_key FROM pairs""")
def fn18(spark, sf):
    return pairs(spark, sf).select(F.col("b.attempt_id").alias("baseline_id"), F.col("c.attempt_id").alias("candidate_id"),
                                   C.context_key(F.col("b.attempt_id").alias("b"), F.col("c.attempt_id").alias("c"), F.col("b.lineage_id").alias("bl")).alias("context_key"))
