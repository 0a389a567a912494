"""Queries over sampled series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import series as S
from . import series_roles as V
from .registry import query
from .timing import r3

PW = "PARTITION BY attempt_id"
OW = "PARTITION BY attempt_id ORDER BY raw_time"


def series_sql(fixed, add, base):
    return f"""{V.SAMPLES}, s1 AS (SELECT *, {r3('(coalesce(lag(motion_score) OVER (' + OW + '), motion_score) + motion_score*2)/3')} AS smoothed, row_number() OVER ({OW}) - 1 AS idx, count(*) OVER ({PW}) AS n FROM smp),
s2 AS (SELECT *, {base} AS inb FROM s1), s3 AS (SELECT *, quantile_cont(CASE WHEN inb THEN smoothed END, 0.5) OVER ({PW}) AS baseline FROM s2),
s4 AS (SELECT *, quantile_cont(CASE WHEN inb THEN abs(smoothed-baseline) END, 0.5) OVER ({PW}) AS mad FROM s3),
s5 AS (SELECT *, {r3(f'greatest({fixed}::DOUBLE, baseline+{add}+mad*3)')} AS thr FROM s4),
ser AS (SELECT *, {r3('greatest(thr*1.8, baseline*2, thr+0.25)')} AS committed_thr, first_value(idx) OVER ({PW} ORDER BY smoothed DESC, idx) AS spike_idx, max(smoothed) OVER ({PW}) AS max_motion FROM s5)"""


PRE = f"CASE WHEN bool_or(raw_time < start_s) OVER ({PW}) THEN raw_time < start_s ELSE idx < 5 END"
SER = series_sql(1, 1, PRE)
SEGS = f"""sg0 AS (SELECT *, smoothed >= thr*0.6 AS o, sum(CASE WHEN smoothed >= thr*0.6 THEN 0 ELSE 1 END) OVER ({OW}) AS isl FROM ser),
segs AS (SELECT attempt_id, min(raw_time) AS seg_start, max(raw_time) AS seg_end, {r3('max(raw_time)-min(raw_time)')} AS seg_duration, max(smoothed) AS max_motion, {r3('avg(smoothed)')} AS average_motion, {r3('sum(smoothed)')} AS total_motion, count(*) AS samples, min(CASE WHEN smoothed>=committed_thr THEN idx END) AS committed_idx, min(start_s) AS start_s
 FROM sg0 WHERE o GROUP BY attempt_id, isl)"""


def rl(level):
    return f"(coalesce(min(CASE WHEN smoothed < {level} THEN idx END) OVER ({OW} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), n) - idx)"


def series(spark, sf, pre=True):
    return S.motion_series(V.samples(spark, sf), "medium", pre)


@query("prj14", f"WITH {V.SAMPLES}, {V.FRAMED} SELECT attempt_id, raw_time, source_time, source_duration_s, coalesce(source_time, raw_time) AS sample_time FROM fr")
def prj14(spark, sf):
    return S.with_sample_time(V.framed(spark, sf)).select("attempt_id", "raw_time", "source_time", "source_duration_s", "sample_time")


@query("wn3", f"WITH {V.SAMPLES}, {V.FRAMED}, k AS (SELECT *, row_number() OVER (PARTITION BY attempt_id, CASE WHEN source_time IS NULL THEN 'c' ELSE 's' END, coalesce(source_time, raw_time) ORDER BY raw_time) AS rn FROM fr) SELECT attempt_id, raw_time, source_time FROM k WHERE rn=1")
def wn3(spark, sf):
    return S.first_per_source_frame(S.with_sample_time(V.framed(spark, sf)), ["attempt_id"], "raw_time").select("attempt_id", "raw_time", "source_time")


@query("ag12", f"WITH {V.SAMPLES}, {V.FRAMED} SELECT attempt_id, count(*) AS sampled_frames, count(source_time) AS native_frames, count(DISTINCT source_time) AS unique_native_frames, floor(max(raw_time-source_time)*1000000+0.5)/1000000 AS max_cursor_offset_s, min(source_duration_s) AS min_frame_duration_s, max(source_duration_s) AS max_frame_duration_s FROM fr GROUP BY 1")
def ag12(spark, sf):
    return S.source_timing_summary(S.with_sample_time(V.framed(spark, sf)), ["attempt_id"])


@query("wn53", f"""WITH {V.SAMPLES}, {V.FRAMED}, w AS (SELECT *, lag(timestamp_method) OVER ({OW})='video-frame' AS pn, raw_time - lag(raw_time) OVER ({OW}) AS sp FROM fr), v AS (SELECT *, CASE WHEN timestamp_method='video-frame' THEN greatest(coalesce(CASE WHEN frame_duration_s BETWEEN 0.001 AND 2 THEN frame_duration_s END,0), coalesce(CASE WHEN pn AND sp BETWEEN 0.001 AND 2 THEN sp END,0)) END AS iv FROM w),
 t AS (SELECT attempt_id, max(raw_time) AS target_s FROM smp WHERE ms % 3 = 0 GROUP BY 1), h AS (SELECT t.attempt_id, t.target_s, v.iv, row_number() OVER (PARTITION BY t.attempt_id ORDER BY v.raw_time) AS rn FROM t JOIN v ON v.attempt_id=t.attempt_id AND abs(v.raw_time-t.target_s) <= 0.001)
 SELECT attempt_id, target_s, CASE WHEN iv>0 THEN iv END AS observation_interval_s FROM h WHERE rn=1""")
def wn53(spark, sf):
    targets = V.samples(spark, sf).where("ms % 3 = 0").groupBy("attempt_id").agg(F.max("raw_time").alias("target_s"))
    return S.interval_at(V.framed(spark, sf), targets, ["attempt_id"])


@query("wn24", f"WITH {SER} SELECT attempt_id, raw_time, smoothed FROM ser")
def wn24(spark, sf):
    return S.smooth(V.samples(spark, sf), "motion_score", "smoothed").select("attempt_id", "raw_time", "smoothed")


@query("wn25", f"WITH {SER} SELECT attempt_id, raw_time, smoothed FROM ser WHERE inb")
def wn25(spark, sf):
    return S.baseline_flag(S.numbered(S.smooth(V.samples(spark, sf), "motion_score", "smoothed"))).where("in_baseline").select("attempt_id", "raw_time", "smoothed")


@query("ag28", f"WITH {SER} SELECT DISTINCT attempt_id, {r3('baseline')} AS baseline, {r3('mad')} AS mad, thr, committed_thr FROM ser")
def ag28(spark, sf):
    return series(spark, sf).groupBy("attempt_id").agg(X.round_ms(F.max("baseline")).alias("baseline"), X.round_ms(F.max("mad")).alias("mad"), F.max("thr").alias("thr"), F.max("committed_thr").alias("committed_thr"))


@query("wn26", f"WITH {SER}, {SEGS} SELECT attempt_id, seg_start, seg_end, seg_duration, max_motion, average_motion, total_motion, samples FROM segs")
def wn26(spark, sf):
    return S.motion_segments(series(spark, sf)).drop("committed_idx", "start_s")


RET = "baseline + greatest(0.08, (thr-baseline)*0.25)"
ONS = f"ons AS (SELECT *, coalesce(max(CASE WHEN idx < spike_idx AND smoothed <= {RET} THEN idx END) OVER ({PW}) + 1, 0) AS onset_idx FROM ser)"


@query("wn27", f"WITH {SER}, {ONS} SELECT attempt_id, CAST(spike_idx AS BIGINT) AS spike_idx, CAST(onset_idx AS BIGINT) AS onset_idx, raw_time AS onset_s, CAST(p AS BIGINT) AS persistence FROM (SELECT *, {rl('thr*0.6')} AS p FROM ons) WHERE idx = onset_idx")
def wn27(spark, sf):
    s = S.motion_onset(series(spark, sf)).withColumn("persistence", S.run_length("smoothed", F.col("thr") * 0.6).cast("bigint"))
    return s.where("idx = onset_idx").select("attempt_id", F.col("spike_idx").cast("bigint").alias("spike_idx"), F.col("onset_idx").cast("bigint").alias("onset_idx"), F.col("raw_time").alias("onset_s"), "persistence")


def mconf(m, t, p, req, b, s):
    return f"CASE WHEN {b} THEN 'Low' WHEN {s} AND {m}/{t} < 2.5 THEN 'Low' WHEN {m}/{t} >= 1.55 AND {p} >= {req} THEN 'High' WHEN {m}/{t} >= 1 AND {p} >= {min(req, 2)} THEN 'Medium' ELSE 'Low' END"


CANDS = f"""{SER}, {SEGS}, {ONS}, cs AS (SELECT attempt_id, committed_idx FROM (SELECT *, row_number() OVER ({PW} ORDER BY total_motion*1.2+max_motion*2+seg_duration DESC, seg_start) AS rn FROM segs WHERE seg_start-start_s >= 0.1) WHERE rn=1),
cx AS (SELECT o.*, (SELECT committed_idx FROM cs WHERE cs.attempt_id=o.attempt_id) AS committed_idx, {rl('greatest(baseline+0.05, thr*0.35)')} AS p_base, {rl('thr*0.6')} AS p_low, {rl('thr')} AS p_thr, raw_time-start_s >= 0 AND raw_time-start_s <= 0.005 AS near, raw_time >= search_end-0.1 AS edge, {r3('raw_time-start_s')} AS climb,
  max_motion >= committed_thr AND smoothed < committed_thr*0.6 AS pre FROM ons o),
cand AS (SELECT attempt_id, raw_time, climb AS climb_time, smoothed AS score, 0 AS ins, CASE WHEN pre THEN 'Possible preload / weight shift' ELSE 'Earliest Visible Motion' END AS kind, {mconf('max_motion', 'thr', 'p_base', 2, 'false', 'near')} AS confidence, edge AS boundary_risk, near AS suspicious, p_base AS persistence FROM cx WHERE max_motion >= thr*0.6 AND idx = onset_idx
 UNION ALL SELECT attempt_id, raw_time, climb, smoothed, 1, 'Committed Launch', {mconf('smoothed', 'committed_thr', 'p_thr', 2, 'edge', '(near OR raw_time-start_s < 0.1)')}, edge, near OR raw_time-start_s < 0.1, p_thr FROM cx WHERE idx = committed_idx
 UNION ALL SELECT attempt_id, raw_time, climb, smoothed, idx+2, CASE WHEN smoothed >= thr THEN 'First threshold crossing' ELSE 'Earliest low-threshold motion' END, {mconf('smoothed', 'thr', 'p_low', 2, 'edge', 'near')}, edge, near, p_low FROM cx WHERE smoothed >= thr*0.6
 UNION ALL SELECT attempt_id, raw_time, climb, smoothed, n+2, 'Largest Early Motion Spike', {mconf('smoothed', 'committed_thr', 'p_thr', 2, 'edge', 'near')}, edge, near, p_low FROM cx WHERE max_motion >= thr*0.6 AND idx = spike_idx)"""


@query("wn28", f"WITH {CANDS} SELECT attempt_id, raw_time, climb_time, score, CAST(ins AS BIGINT) AS ins, kind, confidence, boundary_risk, suspicious, CAST(persistence AS BIGINT) AS persistence FROM cand")
def wn28(spark, sf):
    return S.movement_candidates(series(spark, sf)).select("attempt_id", "raw_time", "climb_time", "score", "ins", "kind", "confidence", "boundary_risk", "suspicious", "persistence")


def ranked(spark, sf):
    return S.choose_movement(S.merge_candidates(S.movement_candidates(series(spark, sf))))


@query("top5")
def top5(spark, sf):
    return S.merge_candidates(S.movement_candidates(series(spark, sf))).select("attempt_id", "raw_time", "kind", "score", "confidence", "persistence")


@query("top3")
def top3(spark, sf):
    return S.present_candidates(ranked(spark, sf)).select("attempt_id", "rank", "raw_time", "kind", "confidence", "selected")


@query("wn29")
def wn29(spark, sf):
    return S.movement_verdict(series(spark, sf), ranked(spark, sf))


@query("top4", f"WITH {SER}, p AS (SELECT *, row_number() OVER ({PW} ORDER BY smoothed DESC, idx) AS peak FROM ser) SELECT attempt_id, CAST(peak AS INTEGER) AS peak, raw_time, smoothed AS motion FROM p WHERE peak <= 5")
def top4(spark, sf):
    return S.top_peaks(series(spark, sf))


@query("prj20", f"""WITH {SER} SELECT attempt_id, raw_time, smoothed >= thr AND smoothed/thr >= 1.2 AND NOT (idx=0) AND NOT (idx%7=0) AND raw_time >= start_s+0.1-1e-6 AND raw_time <= 9.001 AND (attempt_id%2=0 OR raw_time < 8-0.001) AS can_accept FROM ser""")
def prj20(spark, sf):
    s = series(spark, sf)
    conf = F.when(F.col("smoothed") / F.col("thr") >= 1.2, "Medium").otherwise("Low")
    ok = S.can_accept_movement(F.col("smoothed") >= F.col("thr"), conf, F.col("idx") == 0, F.col("idx") % 7 == 0, F.col("raw_time"), F.col("start_s"), F.lit(9.0), F.when(F.col("attempt_id") % 2 != 0, 8.0))
    return s.select("attempt_id", "raw_time", ok.alias("can_accept"))


SER5 = series_sql(1, 1, "idx < 5")


@query("wn30", f"""WITH {SER5}, o AS (SELECT *, coalesce(max(CASE WHEN idx < spike_idx AND smoothed <= thr*0.35 THEN idx END) OVER ({PW}) + 1, 0) AS onset_idx, {rl('thr*0.6')} AS p_low FROM ser), o2 AS (SELECT *, min(CASE WHEN smoothed >= thr AND p_low >= 2 THEN idx END) OVER ({PW}) AS cross_idx FROM o),
 k AS (SELECT *, 0 AS ins, 'Earliest motion onset' AS kind FROM o2 WHERE idx=onset_idx UNION ALL SELECT *, 1, 'Largest motion spike' FROM o2 WHERE idx=spike_idx UNION ALL SELECT *, 2, 'First threshold crossing' FROM o2 WHERE idx=cross_idx),
 e AS (SELECT attempt_id, ins, kind, raw_time AS movement_time, greatest(0, {r3('raw_time-0.2')}) AS raw_time, smoothed AS score, thr, max_motion, greatest(p_low,1) AS persistence FROM k), f AS (SELECT *, raw_time <= 0.1 OR raw_time >= 10.4-0.25 AS boundary_risk FROM e),
 g AS (SELECT *, row_number() OVER (PARTITION BY attempt_id ORDER BY raw_time*100-persistence*12, ins) AS rank FROM f), h AS (SELECT *, coalesce(min(CASE WHEN NOT boundary_risk AND persistence >= 2 THEN rank END) OVER ({PW}), 1) AS best FROM g)
 SELECT attempt_id, CAST(rank AS INTEGER) AS rank, kind, raw_time, movement_time, score, CAST(persistence AS BIGINT) AS persistence, boundary_risk, CASE WHEN NOT boundary_risk AND score >= thr*1.4 THEN 'Medium' ELSE 'Low' END AS confidence, rank=best AND max_motion >= thr*0.5 AS selected FROM h""")
def wn30(spark, sf):
    return S.motion_start_candidates(series(spark, sf, False), "medium", 0.0, 10.4, 0.2)


def colour_series(spark, sf):
    return V.colours(spark, sf).select("attempt_id", "raw_time", X.round_ms(F.abs(F.col("g") - 190.0) + F.abs(F.col("b") - 80.0)).alias("colour_distance"), F.col("g").alias("green"), F.col("b").alias("blue"), F.lit(190.0).alias("green_base"), F.lit(80.0).alias("blue_base"))


@query("wn31", f"""WITH {V.SAMPLES}, {V.COLOURS}, c0 AS (SELECT attempt_id, raw_time, g, b, {r3('abs(g-190.0)+abs(b-80.0)')} AS cd FROM col), c1 AS (SELECT *, {r3('(coalesce(lag(cd) OVER (' + OW + '), cd)+cd*2)/3')} AS smoothed, row_number() OVER ({OW})-1 AS idx, count(*) OVER ({PW}) AS n FROM c0),
 c2 AS (SELECT *, {r3('coalesce(smoothed - lag(smoothed) OVER (' + OW + '), 0)')} AS delta, {rl('40.0*0.75')} AS p, first_value(idx) OVER ({PW} ORDER BY smoothed DESC, idx) AS spike_idx, raw_time >= 10.4-0.25 OR raw_time <= 0.1 AS edge FROM c1),
 c3 AS (SELECT *, CASE WHEN smoothed>=40 THEN 'First visible color shift' WHEN 190-g>6 AND b-80>6 AND smoothed>=20 THEN 'Green-to-blue shift' WHEN delta>=15 AND smoothed>=40*0.55 THEN 'First visible color shift' END AS kind FROM c2),
 c4 AS (SELECT attempt_id, raw_time, smoothed AS score, CAST(p AS BIGINT) AS persistence, edge AS boundary_risk, 0 AS o, kind, CASE WHEN edge THEN 'Low' WHEN smoothed/40>=1.5 AND p>=2 THEN 'High' WHEN smoothed/40>=1 AND p>=2 THEN 'Medium' ELSE 'Low' END AS confidence FROM c3 WHERE kind IS NOT NULL
  UNION ALL SELECT attempt_id, raw_time, smoothed, CAST(p AS BIGINT), edge, 1, 'Strongest color change', CASE WHEN edge OR smoothed<40 THEN 'Low' ELSE 'Medium' END FROM c3 WHERE idx=spike_idx AND smoothed>=40*0.6),
 c5 AS (SELECT *, row_number() OVER (PARTITION BY attempt_id ORDER BY CASE WHEN boundary_risk THEN 100000.0 ELSE 0 END + raw_time*100 - least(persistence,2)*20.0 - least(score/40,2)*10.0, o, raw_time) AS rank FROM c4)
 SELECT attempt_id, raw_time, score, persistence, boundary_risk, kind, confidence, CAST(rank AS INTEGER) AS rank FROM c5 WHERE rank <= 3""")
def wn31(spark, sf):
    return S.colour_start_candidates(colour_series(spark, sf), 40.0, 2, 15.0, 0.0, 10.4)


@query("top2", f"""WITH {SER}, p AS (SELECT *, row_number() OVER ({PW} ORDER BY CASE WHEN raw_time >= 10.15 OR raw_time <= 0.1 THEN 100000.0 ELSE 0 END + raw_time*100 - least(smoothed/thr,2)*10.0, idx) AS rank FROM ser WHERE smoothed >= thr) SELECT attempt_id, CAST(rank AS INTEGER) AS rank, raw_time FROM p WHERE rank <= 3""")
def top2(spark, sf):
    from pyspark.sql import Window
    s = series(spark, sf).where("smoothed >= thr")
    edge = F.when((F.col("raw_time") >= 10.15) | (F.col("raw_time") <= 0.1), 100000.0).otherwise(0.0)
    w = Window.partitionBy("attempt_id").orderBy(edge + F.col("raw_time") * 100 - F.least(F.col("smoothed") / F.col("thr"), F.lit(2.0)) * 10.0, "idx")
    return s.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("attempt_id", "rank", "raw_time")


@query("ag29", f"""WITH {V.SAMPLES}, f0 AS (SELECT attempt_id, raw_time, motion_score/100 AS rms FROM smp), f1 AS (SELECT *, quantile_cont(rms,0.5) OVER ({PW}) AS b FROM f0), f2 AS (SELECT *, quantile_cont(abs(rms-b),0.5) OVER ({PW}) AS d FROM f1), f3 AS (SELECT *, greatest(b*1.8, b+d*4, 0.004) AS t FROM f2)
 SELECT DISTINCT attempt_id, floor(t*1000000+0.5)/1000000 AS threshold, floor(greatest(b+d*1.5, t*0.2, 0.002)*1000000+0.5)/1000000 AS onset_floor FROM f3""")
def ag29(spark, sf):
    f = V.samples(spark, sf).select("attempt_id", "raw_time", (F.col("motion_score") / 100).alias("rms"))
    return S.loudness_thresholds(f, ["attempt_id"]).groupBy("attempt_id").agg(X.round_us(F.max("threshold")).alias("threshold"), X.round_us(F.max("onset_floor")).alias("onset_floor"))


CAL = "cal AS (SELECT DISTINCT user_id AS attempt_id, CAST((user_id%5)*1000+2300 AS DOUBLE)/1000 AS bt, CAST((user_id%5)*1000+3000 AS DOUBLE)/1000 AS att FROM events)"


def side_sql(name, t, lo, hi):
    return f"{name} AS (SELECT attempt_id, count(*) AS n, floor(avg(r)+0.5) AS r, floor(avg(g)+0.5) AS g, floor(avg(b)+0.5) AS b FROM (SELECT c.*, row_number() OVER (PARTITION BY c.attempt_id ORDER BY abs(raw_time-{t}), raw_time) AS rn FROM col c JOIN cal ON c.attempt_id=cal.attempt_id WHERE raw_time>={t}-{lo} AND raw_time<={t}+{hi}) WHERE rn<=6 GROUP BY 1)"


@query("wn34", f"""WITH {V.SAMPLES}, {V.COLOURS}, {CAL}, {side_sql('bf', 'bt', 0.3, 0.06)}, {side_sql('af', 'att', 0.06, 0.35)}, z AS (SELECT cal.attempt_id, bf.n>=2 AND af.n>=2 AS enough, bf.g AS bg, af.b AS ab, sqrt((bf.r-af.r)*(bf.r-af.r)+(bf.g-af.g)*(bf.g-af.g)+(bf.b-af.b)*(bf.b-af.b)) AS d,
  (af.g-af.b)/greatest(1,af.r+af.g+af.b)*180 - (bf.g-bf.b)/greatest(1,bf.r+bf.g+bf.b)*180 AS nw, (90.0-200)/greatest(1,360.0)*180 - (190.0-80)/greatest(1,340.0)*180 AS ws FROM cal LEFT JOIN bf ON bf.attempt_id=cal.attempt_id LEFT JOIN af ON af.attempt_id=cal.attempt_id),
 y AS (SELECT *, coalesce(enough AND d>=0.75 AND abs(nw)>=greatest(3,abs(ws)*0.35) AND sign(nw)=sign(ws), false) AS adapted FROM z)
 SELECT attempt_id, adapted, CASE WHEN adapted THEN bg ELSE 190.0 END AS before_g, CASE WHEN adapted THEN ab ELSE 200.0 END AS after_b, CASE WHEN adapted THEN {r3('d')} ELSE 150.0 END AS colour_delta FROM y""")
def wn34(spark, sf):
    c = V.colours(spark, sf)
    rgb = lambda r, g, b: F.struct(F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b"))
    a = F.col("attempt_id")
    cal = c.select("attempt_id").distinct().select("attempt_id", (((a % 5) * 1000 + 2300) / 1000.0).alias("before_time"), (((a % 5) * 1000 + 3000) / 1000.0).alias("after_time"),
                                                   rgb(70.0, 190.0, 80.0).alias("before_rgb"), rgb(70.0, 90.0, 200.0).alias("after_rgb"), F.lit(150.0).alias("colour_delta"))
    return S.adapted_calibration(c, cal).select("attempt_id", "adapted", F.col("before_rgb.g").alias("before_g"), F.col("after_rgb.b").alias("after_b"), "colour_delta")
