"""Queries over athlete tracking, pad approach and tone details."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audio as A
from ..operators import contact as C
from ..operators import pose as P
from . import fusion as U
from . import series_roles as V
from .registry import query
from .roles import table
from .study import r6


@query("jn28")
def jn28(spark, sf):
    """Each vector is a frame with one or two people; 400 consecutive vectors of a label form an attempt."""
    e = table(spark, sf, "embeddings")
    k, t = F.col("vec_id"), (F.col("vec_id") % 400) * 0.025
    at = lambda i: F.element_at("embedding", i).cast("double")
    a = F.struct((0.5 + at(1) * 0.2).alias("x"), (0.8 - t * 0.05 + at(2) * 0.1).alias("y"))
    b = F.struct((0.55 + at(3) * 0.3).alias("x"), (0.78 - t * 0.05 + at(4) * 0.3).alias("y"))
    zone = F.struct(F.lit(0.3).alias("x1"), F.lit(0.6).alias("y1"), F.lit(0.7).alias("x2"), F.lit(0.95).alias("y2"))
    f = e.select((F.col("label") * 100000 + F.floor(k / 400)).alias("attempt_id"), t.alias("raw_time"), F.when(k % 11 == 0, F.array().cast("array<struct<x:double,y:double>>")).when(k % 3 == 0, F.array(a, b)).otherwise(F.array(a)).alias("people"), zone.alias("zone"))
    return P.track_athlete(f)


PAD = (0.48, 0.18, 0.52, 0.22)


@query("wn51")
def wn51(spark, sf):
    """Samples as frames of an athlete below a pad who reaches up once a second."""
    s, v = V.samples(spark, sf), F.col("v")
    up = F.least(F.lit(1.0), (F.col("raw_time") - F.floor(F.col("raw_time"))) * 1.6)
    pt = lambda i, x, y: F.struct(F.lit(i).alias("idx"), (F.lit(x) + (v % 5 - 2) / 1000.0).alias("x"), y.alias("y"), F.lit(0.0).alias("z"), F.lit(0.9).alias("visibility"))
    hy = F.lit(0.29) - up * 0.09 + (v % 7 - 3) / 2000.0
    lm = F.array(pt(11, 0.48, F.lit(0.26)), pt(12, 0.52, F.lit(0.26)), pt(23, 0.48, F.lit(0.32)), pt(24, 0.52, F.lit(0.32)), pt(17, 0.5, hy), pt(19, 0.5, hy), pt(21, 0.5, hy), pt(16, 0.6, F.lit(0.3)))
    return C.pad_approach(s.select("attempt_id", "raw_time", lm.alias("landmarks")), PAD)


@query("wn41")
def wn41(spark, sf):
    f = U.features(spark, sf)
    return A.stable_pitch_tones(f, A.usable_tones(A.merge_tones(A.tone_segments(f))))


SEC = """st AS (SELECT attempt_id, start_s, duration_s, CASE WHEN frequency>1000 THEN 1760.0::DOUBLE ELSE 880.0::DOUBLE END + frequency%20 AS f, st, tonality, prom+10 AS prom, q FROM tn), pa AS (SELECT * FROM st WHERE abs(f-880)/greatest(f,880)<=0.08 AND q>=6 AND duration_s>=0.08 AND prom>=18 AND st<=80), pc AS (SELECT * FROM st WHERE abs(f-1760)/greatest(f,1760)<=0.08 AND q>=4 AND prom>=14 AND st<=140),
x AS (SELECT a.attempt_id, a.start_s AS a_s, b.start_s AS b_s, c.start_s AS c_s, b.start_s-a.start_s AS g1, c.start_s-b.start_s AS g2, abs(a.f-b.f)/greatest(a.f,b.f) AS se, (a.f+b.f)/2 AS p, c.f AS fc, abs(a.duration_s-b.duration_s)/2/((a.duration_s+b.duration_s)/2) AS ds, (a.tonality+b.tonality+c.tonality)/3 AS ton, (a.prom+b.prom+c.prom)/3 AS pr
 FROM pa a JOIN pa b ON b.attempt_id=a.attempt_id AND b.start_s-a.start_s BETWEEN 0.7 AND 1.3 JOIN pc c ON c.attempt_id=b.attempt_id AND c.start_s-b.start_s BETWEEN 0.7 AND 1.3),
y AS (SELECT *, ton*30+least(pr,40)*1.5+abs(fc-p)/greatest(fc,p)*80-se*100-abs(g1-g2)/(g1+g2)*45-ds*15 AS score FROM x WHERE se<=0.08 AND fc/p BETWEEN 1.8 AND 2.2 AND abs(g1-g2)<=greatest(0.12,(g1+g2)/2*0.2) AND abs(g1-g2)/(g1+g2)<=0.2 AND ds<=0.65 AND ton>=0.38 AND pr>=12)"""


@query("wn47", f"WITH {V.SAMPLES}, {U.TONES}, {SEC}, z AS (SELECT *, row_number() OVER (PARTITION BY attempt_id ORDER BY c_s, score DESC, a_s) AS rn FROM y) SELECT attempt_id, c_s AS raw_time, a_s AS a_start_s, b_s AS b_start_s, {r6('score')} AS score, 'Medium' AS confidence, false AS vote_allowed FROM z WHERE rn=1")
def wn47(spark, sf):
    t = U.tones(spark, sf)
    f = F.col("frequency")
    t = t.withColumns({"frequency": F.when(f > 1000, 1760.0).otherwise(880.0) + f % 20, "prominence_db": F.col("prominence_db") + 10})
    return A.secondary_review(t)
