"""Queries over run reports, trials and public evidence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dims as D
from ..functions import exprs as X
from ..operators import evidence as E
from ..operators import runs as N
from . import roles as R
from . import study_roles as V
from .registry import query
from .study import r6, wil
from ..sources import study_files as Q


def ms_text(ms):
    ms = ms.cast("bigint")
    return F.concat(F.floor(ms / 1000).cast("string"), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"), F.lit("s"))


def ms_sql(m):
    return f"(CAST(({m})//1000 AS VARCHAR) || '.' || lpad(CAST(({m})%1000 AS VARCHAR),3,'0') || 's')"


def runs(spark, sf, parity):
    """One report per parity of the order key; a run per order, numbered within its customer and month."""
    o = R.table(spark, sf, "orders").where(F.col("o_orderkey") % 2 == parity)
    n = F.row_number().over(Window.partitionBy("o_custkey", F.month("o_orderdate")).orderBy("o_orderkey"))
    g = o.select("o_custkey", F.month("o_orderdate").cast("string").alias("m"), F.col("o_orderkey").alias("k"), n.alias("n")).withColumn("mon", F.when(F.col("n") > 1, F.concat_ws("-", "m", F.col("n").cast("string"))).otherwise(F.col("m")))
    k, c = F.col("k"), F.col("o_custkey")
    base = F.concat(c.cast("string"), F.lit("/"), "mon")
    start = (c % 50) * 100 + F.when(k % 3 == 0, 50).when(k % 13 == 0, 400).otherwise(0)
    return g.select(F.concat(F.lit("c"), c.cast("string")).alias("source_name"), F.concat(F.lit("m"), "mon").alias("variation_id"),
                    F.when(k % 19 == 0, "nohash").when(k % 17 == 0, F.sha2(k.cast("string"), 256)).otherwise(F.sha2(base, 256)).alias("media_sha256"), F.sha2(c.cast("string"), 256).alias("source_sha256"),
                    F.when(k % 23 == 0, "stopped").alias("error"), (k % 29 != 0).alias("has_outcome"), F.when(k % 7 == 0, "Not set").otherwise(ms_text(start)).alias("start_text"),
                    F.when(k % 5 == 0, "Not set").otherwise(ms_text(start + 6000 + (k % 4) * 40)).alias("finish_text"), (F.lit(50) + k % 10).alias("requested_frames"), (F.lit(30) + k % 30).alias("valid_frames"),
                    (k % 11 != 0).alias("full_workflow"), F.lit(5).alias("sample_fps"))


def runs_cte(name, parity):
    st = "(o_custkey%50)*100 + CASE WHEN k%3=0 THEN 50 WHEN k%13=0 THEN 400 ELSE 0 END"
    return f"""{name} AS (SELECT 'c'||o_custkey AS source_name, 'm'||mon AS variation_id, CASE WHEN k%19=0 THEN 'nohash' WHEN k%17=0 THEN sha256(CAST(k AS VARCHAR)) ELSE sha256(o_custkey||'/'||mon) END AS media_sha256, sha256(CAST(o_custkey AS VARCHAR)) AS source_sha256,
 CASE WHEN k%23=0 THEN 'stopped' END AS error, k%29<>0 AS has_outcome, CASE WHEN k%7<>0 THEN CAST({st} AS DOUBLE)/1000 END AS start_t, CASE WHEN k%5<>0 THEN CAST({st} + 6000 + (k%4)*40 AS DOUBLE)/1000 END AS finish_t, 50+k%10 AS req, 30+k%30 AS val, k%11<>0 AS fullw
 FROM (SELECT o_custkey, month(o_orderdate) || CASE WHEN n>1 THEN '-' || n ELSE '' END AS mon, o_orderkey AS k FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, month(o_orderdate) ORDER BY o_orderkey) AS n FROM orders WHERE o_orderkey%2={parity})))"""


def bstat(e):
    d = f"abs({r6(f'a.{e}_t-b.{e}_t')})"
    return f"""CASE WHEN b.{e}_t IS NULL AND a.{e}_t IS NULL THEN 'remains-unaccepted' WHEN b.{e}_t IS NULL THEN 'new-unverified-acceptance' WHEN a.{e}_t IS NULL THEN 'availability-loss' WHEN {d} > 0.1+1e-9 THEN 'output-timing-drift' WHEN {d} > 1e-9 THEN 'changed-within-policy' ELSE 'unchanged' END"""


PAIRED = f"""{runs_cte('b', 0)}, {runs_cte('a', 1)}, j AS (SELECT coalesce(b.source_name,a.source_name) AS source_name, coalesce(b.variation_id,a.variation_id) AS variation_id,
 CASE WHEN a.source_name IS NULL THEN 'missing-after' WHEN b.source_name IS NULL THEN 'added-after' WHEN length(a.media_sha256)<>64 OR length(b.media_sha256)<>64 THEN 'unverified-media-identity' WHEN a.media_sha256<>b.media_sha256 THEN 'different-media'
  WHEN a.error IS NOT NULL OR b.error IS NOT NULL OR NOT a.has_outcome OR NOT b.has_outcome THEN 'workflow-error' ELSE 'paired' END AS status,
 b.start_t AS sb, a.start_t AS sa, b.finish_t AS fb, a.finish_t AS fa, {bstat('start')} AS ss, {bstat('finish')} AS fs, a.fullw AND b.fullw AS cmp,
 CASE WHEN b.val<=b.req THEN {r6('CAST(b.val AS DOUBLE)/b.req')} END AS cb, CASE WHEN a.val<=a.req THEN {r6('CAST(a.val AS DOUBLE)/a.req')} END AS ca
 FROM b FULL OUTER JOIN a ON a.source_name=b.source_name AND a.variation_id=b.variation_id),
cases AS (SELECT source_name, variation_id, status, CASE WHEN status='paired' THEN sb END AS start_before, CASE WHEN status='paired' THEN sa END AS start_after, CASE WHEN status='paired' THEN {r6('sa-sb')} END AS start_delta, CASE WHEN status='paired' THEN ss END AS start_status,
 CASE WHEN status='paired' THEN fb END AS finish_before, CASE WHEN status='paired' THEN fa END AS finish_after, CASE WHEN status='paired' THEN {r6('fa-fb')} END AS finish_delta, CASE WHEN status='paired' THEN fs END AS finish_status,
 CASE WHEN status='paired' AND cmp THEN {r6('ca-cb')} END AS coverage_delta FROM j)"""


@query("jn8", f"WITH {PAIRED} SELECT * FROM cases")
def jn8(spark, sf):
    return N.pair_runs(runs(spark, sf, 0), runs(spark, sf, 1))


@query("ag24", f"""WITH {PAIRED} SELECT count(*) FILTER (status='paired') AS paired, count(*) FILTER (status<>'paired') AS unpaired, {', '.join(f"count(*) FILTER (start_status='{s}')+count(*) FILTER (finish_status='{s}') AS {n}" for s, n in (('availability-loss', 'availability_losses'), ('new-unverified-acceptance', 'new_unverified'), ('output-timing-drift', 'timing_drifts'), ('changed-within-policy', 'changed_within_policy')))}, CAST(NULL AS DOUBLE) AS accuracy FROM cases""")
def ag24(spark, sf):
    return N.regression_summary(jn8(spark, sf))


@query("set3", f"WITH {runs_cte('b', 0)}, {runs_cte('a', 1)} SELECT coalesce(b.source_name,a.source_name) AS source_name, coalesce(b.variation_id,a.variation_id) AS variation_id, CASE WHEN a.source_name IS NULL THEN 'missing-after' ELSE 'added-after' END AS status FROM b FULL OUTER JOIN a ON a.source_name=b.source_name AND a.variation_id=b.variation_id WHERE a.source_name IS NULL OR b.source_name IS NULL")
def set3(spark, sf):
    return jn8(spark, sf).where("status in ('missing-after','added-after')").select("source_name", "variation_id", "status")


@query("set5", "SELECT 'c'||o_custkey AS source_name, 'm'||month(o_orderdate) AS variation_id, count(*) AS runs FROM orders GROUP BY 1,2 HAVING count(*)>1")
def set5(spark, sf):
    o = R.table(spark, sf, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source_name"), F.concat(F.lit("m"), F.month("o_orderdate").cast("string")).alias("variation_id"))
    return N.duplicate_run_keys(o)


@query("src7", f"WITH {runs_cte('b', 0)} SELECT source_name, variation_id, media_sha256, error, has_outcome, start_t, finish_t FROM b WHERE NOT source_name LIKE '%3'")
def src7(spark, sf):
    """Reports nested as documents (one per run), unfinished ones rejected, then flattened."""
    r = runs(spark, sf, 0)
    outcome = F.when(F.col("has_outcome"), F.struct(F.struct(F.col("start_text").alias("rawTime")).alias("start"), F.struct(F.col("finish_text").alias("rawTime")).alias("finish"),
                                                    F.struct(F.col("requested_frames").alias("requestedFrames"), F.col("valid_frames").alias("validFrames")).alias("workflow")))
    run = F.struct(F.col("source_name").alias("sourceName"), F.col("variation_id").alias("variationId"), F.col("error").alias("error"), F.struct(F.col("media_sha256").alias("sha256"), F.col("source_sha256").alias("sourceSha256")).alias("media"), outcome.alias("outcome"))
    docs = r.select(F.to_json(F.struct(F.when(~F.col("source_name").endswith("3"), "2024-01-01").alias("finishedAt"), F.lit(True).alias("fullWorkflow"), F.array(run).alias("runs"))).alias("j"), "start_text", "finish_text")
    flat = Q.report_runs(docs.select(F.from_json("j", Q.REPORT_SCHEMA).alias("d")).select("d.*"))
    return flat.join(r.select("source_name", "variation_id", F.col("start_text").alias("_s"), F.col("finish_text").alias("_f")), ["source_name", "variation_id"]).select(
        "source_name", "variation_id", "media_sha256", "error", "has_outcome", X.marker_seconds(F.coalesce("start_text", "_s")).alias("start_t"), X.marker_seconds(F.coalesce("finish_text", "_f")).alias("finish_t"))


@query("src9", """WITH t AS (SELECT event_id, CASE event_id%6 WHEN 0 THEN value||'s' WHEN 1 THEN ' '||value||' ' WHEN 2 THEN 'Not set' WHEN 3 THEN '-'||value||'s' WHEN 4 THEN value||'sec' ELSE CAST(user_id AS VARCHAR) END AS txt FROM events)
 SELECT event_id, CASE WHEN regexp_matches(trim(txt), '^\\d+(\\.\\d+)?s?$') THEN CAST(replace(trim(txt),'s','') AS DOUBLE) END AS seconds FROM t""")
def src9(spark, sf):
    e, v, m = R.table(spark, sf, "events"), F.col("value").cast("string"), F.col("event_id") % 6
    txt = F.when(m == 0, F.concat(v, F.lit("s"))).when(m == 1, F.concat(F.lit(" "), v, F.lit(" "))).when(m == 2, "Not set").when(m == 3, F.concat(F.lit("-"), v, F.lit("s"))).when(m == 4, F.concat(v, F.lit("sec"))).otherwise(F.col("user_id").cast("string"))
    return e.select("event_id", X.marker_seconds(txt).alias("seconds"))


# --- trials and variations --------------------------------------------------------------------

def trial_boundaries(spark, sf):
    """Orders as trials; a start and a finish row per order, tried under one variation each."""
    o = R.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    names = F.array(*[F.lit(v[0]) for v in D.VARIATIONS])
    rows = o.select(k, F.element_at(names, (k % 6 + 1).cast("int")).alias("variation_id"), F.explode(F.array(F.struct(F.lit("start").alias("boundary"), F.lit(0).alias("i")), F.struct(F.lit("finish").alias("boundary"), F.lit(1).alias("i")))).alias("b"))
    i = F.col("b.i")
    ref = (k % 40) * 100 + i * 6000 + 1500
    obs = ref + F.when(k % 6 == 5, -2000).otherwise(0) + F.when(k % 8 == 0, 250).when(k % 3 == 0, 80).otherwise(0)
    label = F.struct(F.when(k % 4 == 0, "disputed").otherwise("confirmed").alias("status"), (k % 5 != 0).alias("independent"), F.lit("r").alias("reviewer_id"), F.lit("m").alias("method"),
                     F.when(k % 9 == 0, "soon").otherwise("2024-01-01").alias("reviewed_at"), (ref / 1000.0 + F.when(k % 7 == 0, 0.3).otherwise(0.02)).alias("raw_time"))
    df = rows.select(k.alias("trial_id"), "variation_id", F.col("b.boundary").alias("boundary"), F.when(k % 10 < 7, "accepted").otherwise("review").alias("ref_status"), F.when(k % 11 != 0, ref / 1000.0).alias("ref_time"),
                     label.alias("label"), F.when(k % 12 == i, "Not set").when(obs >= 0, ms_text(obs)).otherwise("Not set").alias("observed_text"))
    return df.withColumn("label_time", N.independent_label_time()).join(F.broadcast(D.variations(spark)), "variation_id")


TRIALS = f"""t0 AS (SELECT o_orderkey AS k, i, bnd, CASE WHEN o_orderkey%6=5 THEN 2.0 ELSE 0.0 END AS trim_s, (o_orderkey%40)*100 + i*6000 + 1500 AS ref FROM orders, (SELECT unnest([0,1]) AS i, unnest(['start','finish']) AS bnd)),
t1 AS (SELECT *, ref + CASE WHEN k%6=5 THEN -2000 ELSE 0 END + CASE WHEN k%8=0 THEN 250 WHEN k%3=0 THEN 80 ELSE 0 END AS obs_ms FROM t0),
t2 AS (SELECT *, CASE WHEN k%12=i OR obs_ms<0 THEN NULL ELSE CAST(obs_ms AS DOUBLE)/1000 END AS obs, CASE WHEN k%11<>0 THEN CAST(ref AS DOUBLE)/1000 END AS ref_time,
 CASE WHEN k%4<>0 AND k%5<>0 AND k%9<>0 THEN CAST(ref AS DOUBLE)/1000 + CASE WHEN k%7=0 THEN CAST(0.3 AS DOUBLE) ELSE CAST(0.02 AS DOUBLE) END END AS label_time, k%10<7 AS acc FROM t1),
bd AS (SELECT k AS trial_id, bnd AS boundary, obs AS observed_s, {r6('obs-(ref_time-trim_s)')} AS source_delta_s, {r6('obs-(label_time-trim_s)')} AS label_delta_s,
 CASE WHEN NOT acc OR ref_time IS NULL THEN 'unbaselined' WHEN obs IS NULL THEN 'availability-loss' WHEN abs(obs-(ref_time-trim_s)) <= 0.1+1e-9 THEN 'consistent' ELSE 'source-timing-regression' END AS source_consistency,
 CASE WHEN obs IS NULL AND acc THEN 'availability-loss' WHEN obs IS NULL THEN 'remains-unaccepted' WHEN label_time IS NULL OR label_time-trim_s<0 THEN 'unverified-acceptance' WHEN abs(obs-(label_time-trim_s)) > 0.1+1e-9 THEN 'timing-regression' WHEN acc THEN 'consistent' ELSE 'new-labeled-acceptance' END AS boundary_status, ref_time, label_time, acc FROM t2)"""


@query("jn9", f"WITH {TRIALS} SELECT trial_id, boundary, observed_s, source_delta_s, label_delta_s, source_consistency, boundary_status FROM bd")
def jn9(spark, sf):
    return N.assess_variations(trial_boundaries(spark, sf)).select("trial_id", "boundary", "observed_s", "source_delta_s", "label_delta_s", "source_consistency", "boundary_status")


@query("jn9_verdict", f"""WITH {TRIALS} SELECT trial_id, bool_or(boundary_status IN ('timing-regression','unverified-acceptance','availability-loss') OR source_consistency='source-timing-regression') AS needs_investigation, bool_or(boundary_status='timing-regression') AS safety_regression,
 bool_or(source_consistency='source-timing-regression') AS source_timing_regression, {r6("max(observed_s) FILTER (boundary='finish') - max(observed_s) FILTER (boundary='start')")} AS observed_duration_s FROM bd GROUP BY 1""")
def jn9_verdict(spark, sf):
    return N.variation_verdict(N.assess_variations(trial_boundaries(spark, sf)), ["trial_id"])


@query("jn9_tracking", """SELECT o_orderkey, CASE WHEN ru<3 OR rr=0 THEN 'unbaselined' WHEN v<3 THEN 'availability-loss' WHEN CASE WHEN q>0 THEN CAST(v AS DOUBLE)/q ELSE 0 END < CAST(ru AS DOUBLE)/rr - 0.2 THEN 'coverage-loss' ELSE 'retained' END AS tracking_status
 FROM (SELECT o_orderkey, o_orderkey%60 AS ru, 60 AS rr, o_custkey%60 AS v, 50 AS q FROM orders)""")
def jn9_tracking(spark, sf):
    o = R.table(spark, sf, "orders")
    return o.select("o_orderkey", N.tracking_status(F.col("o_orderkey") % 60, F.lit(60), F.col("o_custkey") % 60, F.lit(50)).alias("tracking_status"))


@query("ag26", f"WITH {TRIALS} SELECT trial_id, boundary, CASE WHEN ref_time IS NULL OR label_time IS NULL THEN 'unverified' WHEN abs(ref_time-label_time) <= 0.1+1e-9 THEN 'within-tolerance' ELSE 'outside-tolerance' END AS outcome FROM bd")
def ag26(spark, sf):
    return trial_boundaries(spark, sf).select("trial_id", "boundary", N.label_outcome("ref_time", "label_time").alias("outcome"))


W25 = wil("start_correct", "(start_correct+start_false)", "1.96")


def r3x(x):
    return f"(floor(({x})*1000+0.5)/1000)"


@query("ag25", f"""WITH {TRIALS}, x AS (SELECT *, CASE WHEN ref_time IS NULL OR label_time IS NULL THEN 'unverified' WHEN abs(ref_time-label_time) <= 0.1+1e-9 THEN 'within-tolerance' ELSE 'outside-tolerance' END AS oc FROM bd),
 w AS (SELECT trial_id, bool_or(acc) AS acc, max(oc) FILTER (boundary='start') AS so, max(oc) FILTER (boundary='finish') AS fo, max(observed_s) FILTER (boundary='start') AS ms, max(ref_time) FILTER (boundary='start') AS os FROM x GROUP BY 1),
 g AS (SELECT trial_id%3 AS division, count(*) AS videos, count(*) FILTER (acc) AS start_accepted, count(*) FILTER (NOT acc) AS start_review, count(*) FILTER (acc AND so='within-tolerance') AS start_correct, count(*) FILTER (acc AND so='outside-tolerance') AS start_false, count(*) FILTER (acc AND so='unverified') AS start_unverified,
 count(*) FILTER (acc) AS finish_accepted, count(*) FILTER (NOT acc) AS finish_review, count(*) FILTER (acc AND fo='within-tolerance') AS finish_correct, count(*) FILTER (acc AND fo='outside-tolerance') AS finish_false, count(*) FILTER (acc AND fo='unverified') AS finish_unverified,
 count(*) FILTER (trial_id%5<>0) AS com_videos, sum(trial_id%60) FILTER (trial_id%5<>0) AS usable, sum(60) FILTER (trial_id%5<>0) AS requested, count(ms-os) AS reaction_checks, max({r6('abs(ms-os)')}) AS worst_reaction_error FROM w GROUP BY 1)
 SELECT *, {r6('CAST(start_accepted AS DOUBLE)/videos')} AS start_rate, {r6('CAST(usable AS DOUBLE)/requested')} AS usable_rate, {r3x(W25[1])} AS precision_low, {r3x(W25[2])} AS precision_high FROM g""")
def ag25(spark, sf):
    b = trial_boundaries(spark, sf).withColumn("oc", N.label_outcome("ref_time", "label_time")).withColumn("obs", X.marker_seconds("observed_text"))
    at = lambda c, e: F.max(F.when(F.col("boundary") == e, F.col(c)))
    t = b.groupBy("trial_id").agg(F.max("ref_status").alias("start_status"), F.max("ref_status").alias("finish_status"), at("oc", "start").alias("start_outcome"), at("oc", "finish").alias("finish_outcome"),
                                  at("obs", "start").alias("measured_reaction"), at("ref_time", "start").alias("official_reaction"))
    t = t.withColumns({"division": F.col("trial_id") % 3, "usable_frames": F.when(F.col("trial_id") % 5 != 0, F.col("trial_id") % 60), "requested_frames": F.lit(60)})
    return N.trial_summary(t, ["division"])


# --- known failures, user references, snapshots -----------------------------------------------

@query("jn10", """WITH c AS (SELECT p_partkey, p_size, sha256(CAST(p_partkey AS VARCHAR)) AS h FROM part), x AS (SELECT *, CASE WHEN p_size%5=0 THEN 'Not set' WHEN p_size%5=1 THEN '?' ELSE 'time' END AS kind, CAST(p_size*100 AS DOUBLE)/1000 AS t FROM c)
 SELECT p_partkey AS case_id, CASE WHEN p_size%7=0 THEN 'media-mismatch' WHEN p_size%11=0 OR p_size%13=0 THEN 'workflow-error' WHEN p_size%17=0 THEN 'unreadable-status' WHEN kind='?' THEN 'unreadable-boundary' WHEN kind='time' AND abs(t-2.5)<=0.5+1e-9 THEN 'known-failure-recurred' WHEN kind='Not set' THEN 'guard-held' ELSE 'different-output-needs-review' END AS status,
 NOT (p_size%7<>0 AND p_size%11<>0 AND p_size%13<>0 AND p_size%17<>0 AND (kind='Not set' OR (kind='time' AND abs(t-2.5)>0.5+1e-9))) AS failed, CASE WHEN kind='time' THEN t END AS accepted_raw_time FROM x""")
def jn10(spark, sf):
    p, s = R.table(spark, sf, "part"), F.col("p_size")
    h = F.sha2(F.col("p_partkey").cast("string"), 256)
    cases = p.select(F.col("p_partkey").alias("case_id"), F.upper(h).alias("sha256"), F.lit(2.5).alias("rejected_raw_time"), F.lit(0.5).alias("tolerance_s"))
    outcomes = p.select(F.col("p_partkey").alias("case_id"), F.when(s % 7 == 0, "other").otherwise(h).alias("media_sha256"), F.when(s % 11 == 0, "boom").alias("error"),
                        F.when(s % 13 == 0, " quick analyze stopped: no start").when(s % 17 == 0, "").otherwise("Quick Analyze finished").alias("analysis_status"),
                        F.when(s % 5 == 0, "Not set").when(s % 5 == 1, "?").otherwise(ms_text(s * 100)).alias("boundary_text"))
    return N.known_failure_status(cases, outcomes)


@query("jn11", f"""SELECT c_custkey AS reference_id, {r3x('f-s')} AS measured_total_s, {r3x('f-s-expected')} AS signed_error_s, coalesce(sqrt((hx-0.5)*(hx-0.5)+(hy-0.5)*(hy-0.5)) > 0.3, true) AS hold_missing_or_outside FROM (SELECT c_custkey, c_acctbal/1000.0 AS expected, CASE WHEN c_custkey%4<>0 THEN c_nationkey/10.0 END AS s, CASE WHEN c_custkey%4<>0 THEN c_nationkey/10.0 + 6.25 END AS f,
 CASE WHEN c_custkey%4<>0 THEN c_nationkey/25.0 END AS hx, CASE WHEN c_custkey%4<>0 THEN (c_custkey%10)/10.0 END AS hy FROM customer)""")
def jn11(spark, sf):
    c = R.table(spark, sf, "customer")
    h = F.sha2(F.col("c_custkey").cast("string"), 256)
    refs = c.select(F.col("c_custkey").alias("reference_id"), h.alias("source_sha256"), (F.col("c_acctbal") / 1000.0).alias("expected_total_s"), F.lit(0.5).alias("expected_x"), F.lit(0.5).alias("expected_y"), F.lit(0.3).alias("radius"))
    n = F.col("c_nationkey")
    outs = c.select(F.when(F.col("c_custkey") % 4 != 0, h).otherwise(F.sha2(F.concat(F.lit("other "), F.col("c_custkey").cast("string")), 256)).alias("sha256"), (n / 10.0).alias("start_s"), (n / 10.0 + 6.25).alias("finish_s"), (n / 25.0).alias("hold_x"), ((F.col("c_custkey") % 10) / 10.0).alias("hold_y"))
    return N.user_reference(refs, outs)


@query("jn12", """WITH d AS (SELECT o_orderkey AS run_id, e AS event, CASE (o_orderkey+i)%3 WHEN 0 THEN 'automatic' WHEN 1 THEN 'review' ELSE 'missing' END AS status, CASE WHEN (o_orderkey+i)%3=0 THEN CAST(o_custkey%50 AS DOUBLE) END AS raw_time FROM orders, (SELECT unnest([0,1]) AS i, unnest(['start','finish']) AS e)),
 s AS (SELECT l_orderkey AS run_id, CASE l_linenumber WHEN 1 THEN 'start' WHEN 6 THEN 'finish' ELSE 'marker-' || l_linenumber END AS event, count(*) AS n, max(CASE WHEN l_quantity>25 THEN l_quantity END) AS t, max(CASE WHEN l_quantity>25 THEN CASE WHEN l_linestatus='F' THEN 'automatic' ELSE 'frame-review' END END) AS mode FROM lineitem GROUP BY 1,2),
 v AS (SELECT d.run_id, d.event, CASE WHEN coalesce(n,0)<>1 THEN 'marker-count' WHEN t IS NOT NULL AND mode<>'automatic' THEN 'not-automatic' WHEN t IS NOT NULL AND status<>'automatic' THEN 'acceptance-removed' WHEN t IS NOT NULL AND raw_time<>t THEN 'time-differs' WHEN t IS NULL AND status='automatic' THEN 'promoted' END AS rule FROM d LEFT JOIN s ON d.run_id=s.run_id AND d.event=s.event)
 SELECT * FROM v WHERE rule IS NOT NULL""")
def jn12(spark, sf):
    o, li = R.table(spark, sf, "orders"), R.table(spark, sf, "lineitem")
    d = o.select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey"), F.explode(F.array(F.struct(F.lit("start").alias("event"), F.lit(0).alias("i")), F.struct(F.lit("finish").alias("event"), F.lit(1).alias("i")))).alias("e"))
    st = F.element_at(F.array(F.lit("automatic"), F.lit("review"), F.lit("missing")), ((F.col("run_id") + F.col("e.i")) % 3 + 1).cast("int"))
    declared = d.select("run_id", "e.event", st.alias("status"), F.when(st == "automatic", (F.col("o_custkey") % 50).cast("double")).alias("raw_time"))
    snap = li.select(F.col("l_orderkey").alias("run_id"), F.when(F.col("l_linenumber") == 1, "start").when(F.col("l_linenumber") == 6, "finish").otherwise(F.concat(F.lit("marker-"), F.col("l_linenumber").cast("string"))).alias("event"), F.when(F.col("l_quantity") > 25, F.col("l_quantity")).alias("accepted_raw_time"),
                     F.when(F.col("l_linestatus") == "F", "automatic").otherwise("frame-review").alias("acceptance_mode"))
    return N.snapshot_violations(declared, snap)


@query("ag27", """WITH p AS (SELECT l_orderkey AS run_id, l_linenumber AS ord, CASE WHEN l_quantity>40 THEN 'line '||l_linenumber||' qty '||CAST(l_quantity AS INT)||' part '||l_partkey WHEN l_quantity>30 THEN ' ' END AS reason FROM lineitem),
 g AS (SELECT run_id, string_agg(reason, '; ' ORDER BY ord, reason) AS reasons FROM p WHERE length(trim(reason))>0 GROUP BY 1)
 SELECT o_orderkey AS run_id, CASE WHEN NOT (o_orderkey%3=0 AND o_orderkey%4<>0) THEN coalesce(reasons, 'Workflow runner failed (exit '||(o_orderkey%3)||', passed='||CASE WHEN o_orderkey%4=0 THEN 'false' ELSE 'unavailable' END||').') END AS message FROM orders LEFT JOIN g ON run_id=o_orderkey""")
def ag27(spark, sf):
    q = F.col("l_quantity")
    parts = R.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("ord"), F.when(q > 40, F.concat(
        F.lit("line "), F.col("l_linenumber").cast("string"), F.lit(" qty "), q.cast("int").cast("string"), F.lit(" part "), F.col("l_partkey").cast("string"))).when(q > 30, " ").alias("reason"))
    k = F.col("o_orderkey")
    rr = R.table(spark, sf, "orders").select(k.alias("run_id"), (k % 3).alias("exit_code"), F.when(k % 4 == 0, False).alias("passed"))
    return N.failure_messages(parts, rr)


# --- public evidence --------------------------------------------------------------------------

def reviews(spark, sf):
    d = R.table(spark, sf, "documents")
    k = F.col("doc_id")
    v = F.array(*[F.struct(F.lit(e).alias("event"), F.lit(i).alias("i"), F.lit(r).alias("r")) for i, e in enumerate(("start", "finish")) for r in (0, 1)])
    df = d.select("*", F.explode(v).alias("v"))
    i, r = F.col("v.i"), F.col("v.r")
    lo = (F.col("n_chars") % 400) / 100.0 + i * 6.0 + r * F.when(k % 15 == 0, 0.5).otherwise(0.05)
    return df.select(k.alias("clip_id"), F.col("v.event").alias("event"), F.when(k % 14 == 0, "disputed").when(k % 22 == 0, "unobservable").otherwise("observable").alias("reference_status"),
                     F.when((k % 33 == 0), "agent-0").otherwise(F.concat(F.lit("agent-"), r.cast("string"))).alias("reviewer_id"), F.when((k % 26 == 0) & (r == 1), "disputed").otherwise("observable").alias("status"),
                     lo.alias("bracket_lo"), (lo + 0.2).alias("bracket_hi"), F.when((k % 21 == 0) & (r == 1), "pad").otherwise("light").alias("event_definition"), F.when((k % 25 == 0) & (r == 1), "R").otherwise("L").alias("lane_id"))


REV = """rev AS (SELECT doc_id AS clip_id, e AS event, i, CASE WHEN doc_id%14=0 THEN 'disputed' WHEN doc_id%22=0 THEN 'unobservable' ELSE 'observable' END AS reference_status, CASE WHEN doc_id%33=0 THEN 'agent-0' ELSE 'agent-'||r END AS reviewer_id,
 CASE WHEN doc_id%26=0 AND r=1 THEN 'disputed' ELSE 'observable' END AS status, CAST(n_chars%400 AS DOUBLE)/100.0 + i*6.0 + r*CAST(CASE WHEN doc_id%15=0 THEN 0.5 ELSE 0.05 END AS DOUBLE) AS bracket_lo,
 CASE WHEN doc_id%21=0 AND r=1 THEN 'pad' ELSE 'light' END AS event_definition, CASE WHEN doc_id%25=0 AND r=1 THEN 'R' ELSE 'L' END AS lane_id FROM documents, (SELECT unnest([0,1]) AS i, unnest(['start','finish']) AS e), (SELECT unnest([0,1]) AS r)),
pr0 AS (SELECT clip_id, event, count(*) AS n, count(DISTINCT reviewer_id) AS np, count(*) FILTER (status='observable') AS seen, count(DISTINCT event_definition) AS nd, count(DISTINCT lane_id) AS nl, min(event_definition) AS ed, min(lane_id) AS ln, min(bracket_lo) AS lo, max(bracket_lo) AS lo2,
 max(bracket_lo+CAST(0.2 AS DOUBLE)) AS hi, min(bracket_lo+CAST(0.2 AS DOUBLE)) AS hi1, max(reference_status) AS rs FROM rev GROUP BY 1,2),
pr1 AS (SELECT *, CASE WHEN n<>2 OR np<>2 THEN 'observers' WHEN rs<>'observable' THEN NULL WHEN seen<2 THEN 'unqualified-original' WHEN nd>1 OR nl>1 THEN 'event-or-lane' WHEN lo2>hi1 THEN 'disjoint' END AS violation FROM pr0),
pref AS (SELECT clip_id, event, CASE WHEN violation IS NULL THEN rs END AS reference_status, violation, CASE WHEN violation IS NULL AND rs='observable' THEN ed END AS event_definition, CASE WHEN violation IS NULL AND rs='observable' THEN ln END AS lane_id,
 CASE WHEN violation IS NULL AND rs='observable' THEN lo END AS bracket_lo, CASE WHEN violation IS NULL AND rs='observable' THEN hi END AS bracket_hi FROM pr1)"""


@query("jn7", f"WITH {REV} SELECT * FROM pref")
def jn7(spark, sf):
    return E.bracket_references(reviews(spark, sf))


def public_predictions(spark, sf):
    p = V.predictions(spark, sf).where("event <> 'hold10'")
    return p.select("run_id", "event", F.when(F.col("status") == "accepted", "automatic").otherwise(F.col("status")).alias("status"), (F.col("raw_time") - F.when(F.col("event") == "finish", 6.0).otherwise(0.0)).alias("raw_time"),
                    F.when(F.col("clip_id") % 9 == 0, "pad").otherwise("light").alias("event_definition"), F.lit("L").alias("lane_id"))


EV = f"""{V.CLIPS}, {V.PREDICTIONS}, {REV}, org AS (SELECT clip_id, split, cohort, primary_run_id, unnest(['start','finish']) AS event FROM clips WHERE parent_clip_id IS NULL),
pp AS (SELECT run_id, clip_id AS pc, event, CASE WHEN status='accepted' THEN 'automatic' ELSE status END AS status, raw_time - CASE WHEN event='finish' THEN 6.0 ELSE 0.0 END AS p FROM preds WHERE event<>'hold10'),
er AS (SELECT o.clip_id, o.split, o.cohort, o.event, coalesce(p.status,'missing') AS prediction, p.p, r.bracket_lo AS lo, r.bracket_hi AS hi, p.status='automatic' AND r.reference_status='observable' AND r.event_definition=CASE WHEN p.pc%9=0 THEN 'pad' ELSE 'light' END AND r.lane_id='L' AS m FROM org o LEFT JOIN pp p ON p.run_id=o.primary_run_id AND p.event=o.event LEFT JOIN pref r ON r.clip_id=o.clip_id AND r.event=o.event),
erow AS (SELECT clip_id, split, cohort, event, prediction, CASE WHEN m THEN {r6('greatest(lo-p,p-hi,0)')} END AS min_distance_s, CASE WHEN m THEN {r6('greatest(abs(p-lo),abs(p-hi))')} END AS max_distance_s,
 CASE WHEN m THEN CASE WHEN greatest(lo-p,p-hi,0) > 0.1+1e-9 THEN 'certainly-outside' WHEN greatest(abs(p-lo),abs(p-hi)) <= 0.1+1e-9 THEN 'wholly-within' ELSE 'indeterminate' END END AS tolerance_class FROM er)"""


def endpoint_rows(spark, sf):
    return E.endpoint_rows(V.clips(spark, sf), public_predictions(spark, sf), E.bracket_references(reviews(spark, sf)), 0.1)


@query("ag22", f"WITH {EV} SELECT * FROM erow")
def ag22(spark, sf):
    return endpoint_rows(spark, sf)


@query("ag21", f"""WITH {EV} SELECT split, cohort, event, count(*) AS originals, count(*) FILTER (prediction='automatic') AS automatic, count(*) FILTER (prediction='review') AS review, count(*) FILTER (prediction='missing') AS missing, count(*) FILTER (prediction='failed') AS failed,
 count(tolerance_class) AS comparable, count(*) FILTER (prediction='automatic' AND tolerance_class IS NULL) AS unverified_automatic, count(*) FILTER (tolerance_class='certainly-outside') AS certainly_outside, count(*) FILTER (tolerance_class='wholly-within') AS wholly_within, count(*) FILTER (tolerance_class='indeterminate') AS indeterminate
 FROM erow GROUP BY GROUPING SETS ((split,cohort,event),(event))""")
def ag21(spark, sf):
    return E.cohort_rollup(endpoint_rows(spark, sf))


@query("src8", f"WITH {REV} SELECT clip_id, event, reference_status, reviewer_id, bracket_lo, bracket_lo + CAST(0.2 AS DOUBLE) AS bracket_hi FROM rev")
def src8(spark, sf):
    """Reviews nested into evidence documents, two per reference, then flattened by the reader."""
    r = reviews(spark, sf)
    review = F.struct(F.col("reviewer_id").alias("reviewerId"), "status", F.array("bracket_lo", "bracket_hi").alias("bracket"), F.col("event_definition").alias("eventDefinition"), F.col("lane_id").alias("laneId"))
    refs = r.groupBy("clip_id", "event").agg(F.max("reference_status").alias("rs"), F.collect_list(review).alias("reviews"))
    doc = refs.select(F.to_json(F.struct(F.lit(1).alias("schemaVersion"), F.lit("a").alias("auditId"), F.lit(0.1).alias("toleranceSeconds"), F.array(F.struct(F.col("clip_id").cast("string").alias("id"), F.create_map(
        F.col("event"), F.struct(F.col("rs").alias("status"), "reviews")).alias("references"))).alias("clips"))).alias("j"))
    flat = Q.evidence_reviews(doc.select(F.from_json("j", Q.EVIDENCE_SCHEMA).alias("d")).select("d.*"))
    return flat.select(F.col("clip_id").cast("bigint").alias("clip_id"), "event", "reference_status", "reviewer_id", "bracket_lo", "bracket_hi")


def memberships(spark, sf):
    d = R.table(spark, sf, "documents")
    k = F.col("doc_id")
    groups = F.array_compact(F.array(F.concat(F.lit("source:"), "source", F.lit("/"), F.floor((k % 100) / 10).cast("string")), F.when(k % 50 == 0, F.concat(F.lit("athlete:"), F.floor(k / 200).cast("string")))))
    return d.select(k.alias("clip_id"), F.explode(groups).alias("group_id"))


LINKS = """mem AS (SELECT doc_id AS clip_id, 'source:'||source||'/'||CAST(floor((doc_id%100)/10) AS BIGINT) AS g FROM documents UNION ALL SELECT doc_id, 'athlete:'||CAST(floor(doc_id/200) AS BIGINT) FROM documents WHERE doc_id%50=0),
gmin AS (SELECT g, min(clip_id) AS m FROM mem GROUP BY 1), ge AS (SELECT DISTINCT a.g AS g1, b.g AS g2 FROM mem a JOIN mem b ON a.clip_id=b.clip_id), reach(g1, g2) AS (SELECT g, g FROM gmin UNION SELECT r.g1, e.g2 FROM reach r JOIN ge e ON r.g2=e.g1),
comp AS (SELECT r.g1 AS g, min(m) AS component FROM reach r JOIN gmin ON gmin.g=r.g2 GROUP BY 1), cc AS (SELECT DISTINCT mem.clip_id, comp.component FROM mem JOIN comp ON mem.g=comp.g)"""


@query("ag23", f"WITH RECURSIVE {LINKS} SELECT * FROM cc")
def ag23(spark, sf):
    return E.linked_groups(memberships(spark, sf))


@query("ag23_runs", f"WITH RECURSIVE {LINKS}, {V.PREDICTIONS} SELECT component, min(started_at) AS earliest_run, count(*) AS runs FROM cc JOIN (SELECT DISTINCT clip_id, started_at FROM preds) p ON p.clip_id=cc.clip_id GROUP BY 1")
def ag23_runs(spark, sf):
    starts = V.predictions(spark, sf).select("clip_id", "started_at").distinct()
    return E.earliest_runs(E.linked_groups(memberships(spark, sf)), starts)
