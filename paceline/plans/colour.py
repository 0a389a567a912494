"""Queries over frame cells, light samples and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import colour as C
from ..operators import runs as N
from . import series_roles as V
from .library import ZONE, zone_rows
from .registry import query
from .roles import dealt, table
from .study import r6

W, H = 40, 24


def cells(spark, sf):
    """Order lines as light on the pixels of small frames, whose lines come together; lines of one pixel are averaged."""
    li = dealt(table(spark, sf, "lineitem").withColumn("frame", F.col("l_linenumber").cast("int")).withColumnRenamed("l_suppkey", "recording_id"), "recording_id", "frame")
    pos = ["recording_id", "frame"]
    pos += [(F.col("l_partkey") % W).cast("int").alias("x"), (F.col("l_orderkey") % H).cast("int").alias("y")]
    light = {"r": (F.col("l_quantity") * 5).cast("int"), "g": F.floor(F.col("l_tax") * 3000 + 0.5), "b": F.floor(F.col("l_discount") * 2500 + 0.5)}
    return li.groupBy(*pos).agg(*[F.floor(F.avg(v) + 0.5).cast("int").alias(k) for k, v in light.items()])


CELLS = f"""cells AS (SELECT l_suppkey AS recording_id, CAST(l_linenumber AS INTEGER) AS frame, CAST(l_partkey%{W} AS INTEGER) AS x, CAST(l_orderkey%{H} AS INTEGER) AS y,
 CAST(floor(avg(CAST(l_quantity*5 AS INTEGER))+0.5) AS INTEGER) AS r, CAST(floor(avg(floor(l_tax*3000+0.5))+0.5) AS INTEGER) AS g, CAST(floor(avg(floor(l_discount*2500+0.5))+0.5) AS INTEGER) AS b FROM lineitem GROUP BY 1,2,3,4)"""
PAIRS = f"{CELLS}, pr AS (SELECT c.*, p.r AS pr, p.g AS pg, p.b AS pb FROM cells c JOIN cells p ON p.recording_id=c.recording_id AND p.frame=c.frame-1 AND p.x=c.x AND p.y=c.y)"


def pairs(spark, sf):
    return C.with_previous(cells(spark, sf))




@query("ag30", f"""WITH {CELLS}, lg AS (SELECT recording_id, frame, unnest(['r','g','b']) AS ch, unnest([r,g,b]) AS v FROM cells), h AS (SELECT recording_id, frame, ch, v, count(*) AS n FROM lg GROUP BY ALL), k AS (SELECT *, sum(n) OVER (PARTITION BY recording_id, frame, ch ORDER BY v) AS hi, sum(n) OVER (PARTITION BY recording_id, frame, ch) AS t FROM h),
 m AS (SELECT recording_id, frame, ch, sum(v*kp)/nullif(sum(kp),0) AS m FROM (SELECT *, greatest(0, least(hi, t-floor(t*0.1)) - greatest(hi-n, floor(t*0.1))) AS kp FROM k) GROUP BY ALL) SELECT recording_id, frame, {r6("coalesce(max(m) FILTER (ch='r'),0)")} AS r, {r6("coalesce(max(m) FILTER (ch='g'),0)")} AS g, {r6("coalesce(max(m) FILTER (ch='b'),0)")} AS b FROM m GROUP BY 1,2""")
def ag30(spark, sf):
    return C.frame_colour(cells(spark, sf)).withColumns({c: X.round_us(c) for c in "rgb"})


@query("ag31", f"WITH {CELLS}, s AS (SELECT recording_id, frame, x+dx AS cx, y+dy AS cy, r, g, b FROM cells, (SELECT unnest([-1,0,1]) AS dx), (SELECT unnest([-1,0,1]) AS dy)) SELECT recording_id, frame, cx, cy, CAST(floor(avg(r)+0.5) AS BIGINT) AS r, CAST(floor(avg(g)+0.5) AS BIGINT) AS g, CAST(floor(avg(b)+0.5) AS BIGINT) AS b, count(*) AS cells FROM s WHERE cx BETWEEN 0 AND {W-1} AND cy BETWEEN 0 AND {H-1} GROUP BY 1,2,3,4")
def ag31(spark, sf):
    return C.patch_colour(cells(spark, sf), 1, W, H)


def owq(expr):
    return f"WITH {CELLS}, s AS (SELECT *, {expr}*(0.35+0.65*sqrt(greatest(1,r+g+b)/765.0::DOUBLE)) AS sc FROM cells), k AS (SELECT *, row_number() OVER (PARTITION BY recording_id, frame ORDER BY sc DESC, y, x) AS rn, count(*) OVER (PARTITION BY recording_id, frame) AS n FROM s) SELECT recording_id, frame, CAST(floor(avg(r)+0.5) AS BIGINT) AS r, CAST(floor(avg(g)+0.5) AS BIGINT) AS g, CAST(floor(avg(b)+0.5) AS BIGINT) AS b, count(*) AS selected FROM k WHERE rn <= least(64, greatest(2, ceil(n*0.12))) GROUP BY 1,2"


@query("ag32", owq("abs(g-b)/greatest(1,r+g+b)"))
def ag32(spark, sf):
    return C.opponent_weighted(cells(spark, sf))


@query("ag32_directional", owq("(g-b)*-1/greatest(1,r+g+b)"))
def ag32_directional(spark, sf):
    return C.opponent_weighted(cells(spark, sf), -1)


@query("ag33", f"WITH {PAIRS} SELECT recording_id, frame, CAST(floor(avg(r)+0.5) AS BIGINT) AS r, CAST(floor(avg(g)+0.5) AS BIGINT) AS g, CAST(floor(avg(b)+0.5) AS BIGINT) AS b, {r6('avg((abs(r-pr)+abs(g-pg)+abs(b-pb))/3)')} AS motion FROM pr GROUP BY 1,2")
def ag33(spark, sf):
    return C.frame_motion(pairs(spark, sf)).withColumn("motion", X.round_us("motion"))


@query("ag34", f"WITH {PAIRS}, d AS (SELECT *, abs(299*(r-pr)+587*(g-pg)+114*(b-pb)) AS d FROM pr) SELECT recording_id, frame, floor((coalesce(sum(d-500) FILTER (d>500),0)/1000/count(*)*1.15::DOUBLE+count(*) FILTER (d>500)/count(*)*3)*1000+0.5)/1000 AS motion_score FROM d GROUP BY 1,2")
def ag34(spark, sf):
    return C.sensitive_motion(pairs(spark, sf))


SCENE = "sh AS (SELECT *, avg(r-pr) OVER q AS mr, avg(g-pg) OVER q AS mg, avg(b-pb) OVER q AS mb FROM pr WINDOW q AS (PARTITION BY recording_id, frame)), scn AS (SELECT recording_id, frame, count(*) FILTER ((abs(r-pr-mr)+abs(g-pg-mg)+abs(b-pb-mb))/3 >= 60)/count(*) AS c FROM sh GROUP BY 1,2)"


@query("ag35", f"WITH {PAIRS}, {SCENE} SELECT recording_id, frame, floor(c*1000+0.5)/1000 AS change_ratio, c <= 0.5 AS continuous FROM scn")
def ag35(spark, sf):
    return C.scene_change(pairs(spark, sf), 60.0, 0.5)


@query("ag36", f"WITH {PAIRS}, d AS (SELECT recording_id, frame, ((r-pr)+(g-pg)+(b-pb))/3 AS d FROM pr), k AS (SELECT *, row_number() OVER (PARTITION BY recording_id, frame ORDER BY d)-1 AS rn, count(*) OVER (PARTITION BY recording_id, frame) AS n FROM d), m AS (SELECT recording_id, frame, max(d) FILTER (rn = n//2) AS med FROM k GROUP BY 1,2) SELECT recording_id, frame, {r6('avg(abs(d-med))')} AS local_change FROM d JOIN m USING (recording_id, frame) GROUP BY 1,2")
def ag36(spark, sf):
    return C.centred_change(pairs(spark, sf)).withColumn("local_change", X.round_us("local_change"))


@query("ag37", f"""WITH {PAIRS}, {SCENE}, pt AS (SELECT recording_id, frame, CASE WHEN recording_id%2=0 THEN 0.96::DOUBLE ELSE 0.5::DOUBLE END AS cy, recording_id%3<>0 AS ls FROM cells GROUP BY 1,2), g AS (SELECT p.recording_id, p.frame, cy, ls, count(*) FILTER (abs(c.y-floor(cy*23+0.5))<=2 AND c.r*0.2126+c.g*0.7152+c.b*0.0722 < 80)/nullif(count(*) FILTER (abs(c.y-floor(cy*23+0.5))<=2),0) AS dk FROM pt p JOIN cells c USING (recording_id, frame) GROUP BY 1,2,3,4)
 SELECT g.recording_id, g.frame, {r6('dk')} AS dark_share, coalesce(c<=0.5,false) AND NOT (ls AND cy>=0.94) AS may_vote, CASE WHEN NOT coalesce(c<=0.5,false) THEN 'scene-cut' WHEN ls AND cy>=0.94 AND coalesce(dk,0)>=0.55 THEN 'dark-band' WHEN ls AND cy>=0.94 THEN 'lower-edge' END AS reason FROM g LEFT JOIN scn ON scn.recording_id=g.recording_id AND scn.frame=g.frame""")
def ag37(spark, sf):
    c, rec = cells(spark, sf), F.col("recording_id")
    p = c.select("recording_id", "frame").distinct().select("recording_id", "frame", F.when(rec % 2 == 0, 0.96).otherwise(0.5).alias("centre_y"), (rec % 3 != 0).alias("landscape"), F.lit(True).alias("automatic"))
    return C.light_artifacts(c, p, C.scene_change(pairs(spark, sf), 60.0, 0.5), H)


# --- finish rules -----------------------------------------------------------------------------

@query("prj26", """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey%5<>0 AS det, l_quantity/5 AS t, CASE WHEN l_suppkey%3=0 THEN l_quantity/5+l_discount*8 END AS ex, CASE WHEN l_suppkey%4=0 THEN l_quantity/5+l_tax*30 END AS ct FROM lineitem), y AS (SELECT *, NOT det OR coalesce(abs(ex-t)<=0.45,false) AS keep, coalesce(abs(ct-t)<=1.2,false) AS ph FROM x)
 SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN keep THEN det ELSE ph END AS detected_out, CASE WHEN keep OR ph THEN t END AS raw_time_out, CASE WHEN keep THEN 'High' WHEN ph THEN 'Medium' ELSE 'Low' END AS confidence_out, CASE WHEN keep THEN 'kept' WHEN ph THEN 'review' ELSE 'withheld' END AS policy FROM y""")
def prj26(spark, sf):
    s, t = F.col("l_suppkey"), F.col("l_quantity") / 5
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (s % 5 != 0).alias("detected"), t.alias("raw_time"), F.lit("High").alias("confidence"),
                                             F.when(s % 3 == 0, t + F.col("l_discount") * 8).alias("expected_s"), F.when(s % 4 == 0, t + F.col("l_tax") * 30).alias("contact_s"))
    return C.upper_corroboration(df).select("l_orderkey", "l_linenumber", "l_partkey", "detected_out", "raw_time_out", "confidence_out", "policy")


@query("prj27", """SELECT p_partkey, CASE WHEN p_size%2=0 OR p_size%3<>0 THEN p_size%2=0 ELSE true END AS detected, CASE WHEN p_size%2=0 OR p_size%3<>0 THEN p_size*1.0::DOUBLE ELSE p_size*2.0::DOUBLE END AS raw_time, CASE WHEN p_size%2=0 OR p_size%3<>0 THEN 'High' WHEN p_size%5=0 THEN 'Low' ELSE 'Medium' END AS confidence FROM part""")
def prj27(spark, sf):
    s = F.col("p_size")
    st = lambda d, t, c: F.struct(d.alias("detected"), t.cast("double").alias("raw_time"), c.alias("confidence"))
    df = table(spark, sf, "part").withColumns({"coarse": st(s % 3 == 0, s * 2, F.when(s % 5 == 0, "Low").otherwise("High")), "fine": st(s % 2 == 0, s, F.lit("High"))})
    return df.select("p_partkey", C.refine_finish().alias("o")).select("p_partkey", "o.*")


@query("prj28", "SELECT p_partkey, p_size%2=0 AND p_size%3<>0 AS detected, CASE WHEN p_size%3<>0 THEN p_retailprice END AS raw_time, CASE WHEN p_size%3=0 AND p_size%5<>0 THEN 'Low' WHEN p_size%5=0 THEN 'None' ELSE 'High' END AS confidence FROM part")
def prj28(spark, sf):
    s = F.col("p_size")
    df = table(spark, sf, "part").select("p_partkey", (s % 2 == 0).alias("detected"), F.col("p_retailprice").alias("raw_time"), F.when(s % 5 == 0, "None").otherwise("High").alias("confidence"), (s % 3 == 0).alias("partial"))
    return C.partial_finish(df).drop("partial")


def indicator(spark, sf):
    rgb = lambda r, g, b: F.struct(F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b"))
    return V.colours(spark, sf).withColumns({"before": rgb(70.0, 190.0, 80.0), "after": rgb(70.0, 90.0, 200.0)})


@query("wn38", f"""WITH RECURSIVE {V.SAMPLES}, {V.COLOURS}, u0 AS (SELECT *, ((g-190)*-100+(b-80)*120)/24400.0::DOUBLE AS p, row_number() OVER (PARTITION BY attempt_id ORDER BY raw_time)-1 AS idx, count(*) OVER (PARTITION BY attempt_id) AS n FROM col), u1 AS (SELECT *, least(12,greatest(4,floor(n*0.22))) AS base FROM u0 WHERE n>=8),
 u2 AS (SELECT *, p - quantile_cont(CASE WHEN idx<base THEN p END,0.5) OVER (PARTITION BY attempt_id) AS v FROM u1), u3 AS (SELECT *, count(*) OVER a AS k, count(*) FILTER (v>=0.42) OVER a AS t, max(v) OVER a AS pk, lag(v) OVER q AS v1, lag(v,2) OVER q AS v2 FROM u2 WINDOW a AS (PARTITION BY attempt_id ORDER BY ms RANGE BETWEEN CURRENT ROW AND 950 FOLLOWING), q AS (PARTITION BY attempt_id ORDER BY raw_time)),
 hit AS (SELECT * FROM u3 WHERE idx>=base AND idx<n-2 AND v>=0.16 AND v1<0.12 AND v2<0.12 AND t>=greatest(3,ceil(k*0.55)) AND pk>=0.7),
 wk AS (SELECT attempt_id, idx AS h, idx AS cur, raw_time AS o, 0 AS miss, ms, base FROM hit UNION ALL SELECT w.attempt_id, w.h, u.idx, CASE WHEN u.v>=0.08 THEN u.raw_time ELSE w.o END, CASE WHEN u.v>=0.08 THEN 0 ELSE w.miss+1 END, w.ms, w.base FROM wk w JOIN u2 u ON u.attempt_id=w.attempt_id AND u.idx=w.cur-1 AND u.idx>=w.base AND u.ms>=w.ms-340 WHERE w.miss<=1),
 os AS (SELECT attempt_id, h, min(o) AS onset_s FROM wk WHERE miss<=1 OR true GROUP BY 1,2), c AS (SELECT hit.attempt_id, onset_s, hit.raw_time, CASE WHEN pk>=0.9 AND t>=ceil(k*0.62) THEN 'High' ELSE 'Medium' END AS confidence, t AS target_frames, row_number() OVER (PARTITION BY hit.attempt_id ORDER BY onset_s, hit.raw_time) AS rn, count(*) OVER (PARTITION BY hit.attempt_id) AS candidates FROM hit JOIN os ON os.attempt_id=hit.attempt_id AND os.h=hit.idx)
 SELECT attempt_id, floor(onset_s*1000+0.5)/1000 AS onset_s, confidence, target_frames, candidates FROM c WHERE rn=1""")
def wn38(spark, sf):
    return C.upper_indicator(indicator(spark, sf))


@query("wn52", f"""WITH {V.SAMPLES}, s AS (SELECT attempt_id, raw_time, motion_score AS score, row_number() OVER (PARTITION BY attempt_id ORDER BY raw_time)-1 AS idx, count(*) OVER (PARTITION BY attempt_id) AS n FROM smp), p AS (SELECT attempt_id, max(score) AS ms, arg_min(idx, struct_pack(a:=-score,b:=idx)) AS pi, arg_min(raw_time, struct_pack(a:=-score,b:=idx)) AS pt, max(n) AS n FROM s WHERE n>=3 GROUP BY 1),
 f AS (SELECT *, greatest(0, least(n-5, CASE WHEN ms>=4 THEN pi ELSE n//2 END - 2)) AS fi FROM p) SELECT s.attempt_id, s.raw_time, CASE WHEN ms>=4 THEN pt END AS suggested_s FROM s JOIN f USING (attempt_id) WHERE s.idx>=fi AND s.idx<fi+5""")
def wn52(spark, sf):
    return C.largest_change(V.samples(spark, sf).select("attempt_id", "raw_time", F.col("motion_score").alias("score")))


@query("prj31_finish", f"""WITH {V.SAMPLES}, x AS (SELECT attempt_id, raw_time AS c, 9.0::DOUBLE AS d, CASE WHEN attempt_id%3<>0 THEN start_s END AS s FROM smp), y AS (SELECT *, c<d AND (s IS NULL OR s<d) AS ok, greatest(coalesce(s,0), c-1.25, 0) AS a, least(d-0.001::DOUBLE, c+1.25) AS z FROM x) SELECT attempt_id, c AS raw_time, CASE WHEN ok AND z-a>=0.2 THEN a END AS window_start_s, CASE WHEN ok AND z-a>=0.2 THEN z END AS window_end_s FROM y""")
def prj31_finish(spark, sf):
    s = V.samples(spark, sf)
    a, z = C.finish_review_window("raw_time", F.lit(9.0), F.when(F.col("attempt_id") % 3 != 0, F.col("start_s")))
    return s.select("attempt_id", "raw_time", a.alias("window_start_s"), z.alias("window_end_s"))


# --- scalars ----------------------------------------------------------------------------------

RGB = "px AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity*5 AS r, l_tax*3000 AS g, l_discount*2500 AS b FROM lineitem)"
KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]


def pixels(spark, sf):
    return table(spark, sf, "lineitem").select(*KEYS, (F.col("l_quantity") * 5).alias("r"), (F.col("l_tax") * 3000).alias("g"), (F.col("l_discount") * 2500).alias("b"))


@query("fn1", f"WITH {RGB} SELECT l_orderkey, l_linenumber, l_partkey, {r6('sqrt((r-100)*(r-100)+(g-50)*(g-50)+(b-20)*(b-20))')} AS distance FROM px")
def fn1(spark, sf):
    st = lambda *v: F.struct(*[x.alias(k) for k, x in zip("rgb", v)])
    p = pixels(spark, sf).withColumns({"a": st(F.col("r"), F.col("g"), F.col("b")), "z": st(F.lit(100.0), F.lit(50.0), F.lit(20.0))})
    return p.select(*KEYS, X.round_us(X.rgb_distance("a", "z")).alias("distance"))


def share(p, q, s):
    return f"CASE WHEN r+g+b>0 THEN ({p}-greatest({q},{s}))/(r+g+b) ELSE 0 END"


@query("fn2", f"WITH {RGB} SELECT l_orderkey, l_linenumber, l_partkey, {r6('g-greatest(r,b)')} AS green_dominance, {r6('b-greatest(r,g)')} AS blue_dominance, {r6('greatest(g-greatest(r,b), ' + share('g', 'r', 'b') + '*180)')} AS green_signal, {r6('greatest(b-greatest(r,g), ' + share('b', 'r', 'g') + '*180)')} AS blue_signal, {r6('CASE WHEN r+g+b>0 THEN (g-b)/(r+g+b)*180 ELSE 0 END')} AS opponent FROM px")
def fn2(spark, sf):
    s = C.light_signals("r", "g", "b")
    return pixels(spark, sf).select(*KEYS, *[X.round_us(s[k]).alias(k) for k in ("green_dominance", "blue_dominance", "green_signal", "blue_signal", "opponent")])


@query("fn3", f"WITH {RGB} SELECT l_orderkey, l_linenumber, l_partkey, {r6('(g-b)/greatest(1,r+g+b)*180')} AS finish_opponent, {r6('r/greatest(1,r+g+b)')} AS red_share, {r6('greatest(r,g,b)-least(r,g,b)')} AS chroma FROM px")
def fn3(spark, sf):
    s = C.light_signals("r", "g", "b")
    return pixels(spark, sf).select(*KEYS, *[X.round_us(s[k]).alias(k) for k in ("finish_opponent", "red_share", "chroma")])


@query("fn4", f"WITH {RGB} SELECT l_orderkey, l_linenumber, l_partkey, {r6('r*0.2126::DOUBLE+g*0.7152::DOUBLE+b*0.0722::DOUBLE')} AS luminance, {r6('r*0.299::DOUBLE+g*0.587::DOUBLE+b*0.114::DOUBLE')} AS grey FROM px")
def fn4(spark, sf):
    return pixels(spark, sf).select(*KEYS, X.round_us(X.luminance("r", "g", "b")).alias("luminance"), X.round_us(X.grey("r", "g", "b")).alias("grey"))


@query("fn5", f"WITH {V.SAMPLES} SELECT attempt_id, ms, {r6('abs(1200*log2((500+v%700)/554.0::DOUBLE))')} AS cents, {r6('abs((500+v%700)-554.0::DOUBLE)/greatest(500+v%700,554.0::DOUBLE)')} AS relative_difference FROM smp")
def fn5(spark, sf):
    f = 500.0 + F.col("v") % 700
    return V.samples(spark, sf).select("attempt_id", "ms", X.round_us(X.cents(f, F.lit(554.0))).alias("cents"), X.round_us(X.relative_difference(f, F.lit(554.0))).alias("relative_difference"))


@query("fn6", f"WITH {V.SAMPLES} SELECT attempt_id, {r6('sqrt(avg(v*v))/1000')} AS rms, {r6('avg(v)/1000')} AS mean, {r6('stddev_pop(motion_score)')} AS deviation FROM smp GROUP BY 1")
def fn6(spark, sf):
    m, v = F.col("motion_score"), F.col("v")  # whole thousandths, so that sums don't depend on their order
    return V.samples(spark, sf).groupBy("attempt_id").agg(X.round_us(F.sqrt(F.avg(v * v)) / 1000).alias("rms"), X.round_us(F.avg(v) / 1000).alias("mean"), X.round_us(F.stddev_pop(m)).alias("deviation"))


@query("fn7", f"SELECT p_partkey, {r6('CASE WHEN p_size%3=0 AND p_size%5=0 THEN NULL WHEN p_size%3=0 THEN p_size*2.0::DOUBLE WHEN p_size%5=0 THEN p_retailprice ELSE (p_retailprice*p_size+p_size*2.0::DOUBLE*3)/greatest(p_size+3,1e-6) END')} AS mean FROM part")
def fn7(spark, sf):
    s = F.col("p_size")
    a, b = F.when(s % 3 != 0, F.col("p_retailprice")), F.when(s % 5 != 0, s * 2.0)
    mean = F.when(a.isNull(), b).when(b.isNull(), a).otherwise((a * s + b * 3) / F.greatest(s + 3.0, F.lit(1e-6)))
    return table(spark, sf, "part").select("p_partkey", X.round_us(mean).alias("mean"))


@query("fn8", "SELECT o_orderkey, least(greatest(o_totalprice, 50000), 300000) AS clamped FROM orders")
def fn8(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", X.clamp("o_totalprice", 50000.0, 300000.0).alias("clamped"))


@query("fn9", "SELECT l_orderkey, l_linenumber, l_partkey, floor((l_extendedprice/-7777)*1000+0.5)/1000 AS ms_rounded, floor((l_extendedprice/-7777)*1000000+0.5)/1000000 AS us_rounded FROM lineitem")
def fn9(spark, sf):
    v = F.col("l_extendedprice") / -7777
    return table(spark, sf, "lineitem").select(*KEYS, X.round_ms(v).alias("ms_rounded"), X.round_us(v).alias("us_rounded"))


@query("fn10", f"SELECT l_orderkey, l_linenumber, l_partkey, {r6('sqrt(power(l_quantity/20-1.5,2)+power(l_discount*100-7,2))')} AS wall_distance FROM lineitem")
def fn10(spark, sf):
    return table(spark, sf, "lineitem").select(*KEYS, X.round_us(F.hypot(F.col("l_quantity") / 20 - 1.5, F.col("l_discount") * 100 - 7)).alias("wall_distance"))


@query("fn11", f"WITH {ZONE} SELECT l_orderkey, l_linenumber, l_partkey, {r6('abs((x2-x1)*(y2-y1))')} AS area, {r6('(x1+x2)/2')} AS centre_x, {r6('(y1+y2)/2')} AS centre_y, l_suppkey%2=0 AS same_zone FROM zr")
def fn11(spark, sf):
    from ..operators.library import zones_equal
    d = F.when(F.col("l_suppkey") % 2 == 0, 1e-8).otherwise(1e-4)
    z = zone_rows(spark, sf).withColumn("o", F.struct(*[(F.col(f"z.{k}") + d).alias(k) for k in ("x1", "y1", "x2", "y2")]))
    return z.select(*KEYS, X.round_us(X.zone_area("z")).alias("area"), X.round_us((F.col("z.x1") + F.col("z.x2")) / 2).alias("centre_x"), X.round_us((F.col("z.y1") + F.col("z.y2")) / 2).alias("centre_y"), zones_equal("z", "o").alias("same_zone"))


@query("fn12", "SELECT p_partkey, CASE WHEN p_size/50.0>=0.85 THEN 'High' WHEN p_size/50.0>=0.65 THEN 'Medium' WHEN p_size>0 THEN 'Low' ELSE 'None' END AS confidence FROM part")
def fn12(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.coverage_confidence(F.col("p_size") / 50.0).alias("confidence"))


@query("fn20", "SELECT o_orderkey, o_orderkey%5<>0 AND o_orderkey%7<>0 AS matches, o_orderkey%7<>0 AS valid FROM orders")
def fn20(spark, sf):
    k = F.col("o_orderkey")
    h = F.sha2(k.cast("string"), 256)
    other = F.when(k % 7 == 0, "zz").when(k % 5 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.upper(h))
    return table(spark, sf, "orders").select("o_orderkey", (X.valid_hash(h) & X.valid_hash(other) & (F.lower(h) == F.lower(other))).alias("matches"), X.valid_hash(other).alias("valid"))


@query("fn21", "SELECT o_orderkey, o_orderkey%3=0 OR (o_custkey%4=0 AND o_orderkey%3<>1) AS unverified FROM orders")
def fn21(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    reviewed = F.when(k % 3 == 0, False).when(k % 3 == 1, True)
    status = F.when(c % 4 == 0, "research-compared").otherwise("baseline")
    flag = X.truthy(~reviewed) | ((status == "research-compared") & ~X.truthy(reviewed))
    return table(spark, sf, "orders").select("o_orderkey", flag.alias("unverified"))


@query("fn22", "SELECT o_orderkey, o_orderkey%4=0 OR o_orderkey%4=1 AS failed FROM orders")
def fn22(spark, sf):
    k = F.col("o_orderkey") % 4
    t = F.when(k == 0, " QUICK analyze stopped: no start ").when(k == 1, "Reviewed-start analysis stopped").when(k == 2, "Quick Analyze stoppedish").otherwise("done")
    return table(spark, sf, "orders").select("o_orderkey", N.analysis_failed(t).alias("failed"))


@query("fn28", f"""WITH {ZONE}, c AS (SELECT *, least(1,greatest(0,least(x1,x2))) AS l, least(1,greatest(0,greatest(x1,x2))) AS r, least(1,greatest(0,least(y1,y2))) AS t, least(1,greatest(0,greatest(y1,y2))) AS b FROM zr)
 SELECT l_orderkey, l_linenumber, l_partkey, CAST(least(floor(l*1080),1079) AS BIGINT) AS x, CAST(least(floor(t*1920),1919) AS BIGINT) AS y, CAST(least(greatest(1,ceil((r-l)*1080)),1080-floor(l*1080)) AS BIGINT) AS width, CAST(least(greatest(1,ceil((b-t)*1920)),1920-floor(t*1920)) AS BIGINT) AS height FROM c""")
def fn28(spark, sf):
    return zone_rows(spark, sf).select(*KEYS, C.pixel_rect("z", F.lit(1080), F.lit(1920)).alias("p")).select(*KEYS, "p.*")
