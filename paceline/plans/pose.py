"""Queries over landmarks, calibrations and hand contact."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dims as D
from ..functions import exprs as X
from ..operators import contact as C
from ..operators import pose as P
from . import series_roles as V
from .library import HOLDS
from .registry import query
from .roles import table
from .study import r6

MATRIX = "[3.0, 0.0, 0.0, 0.0, -15.0, 15.0, 0.1*(attempt_id%3), 0.05, 1.0]"


def frames(spark, sf):
    """One pose frame per vector: 32 landmarks; 400 consecutive vectors of a label form an attempt."""
    e = table(spark, sf, "embeddings")
    k = F.col("vec_id")
    pts = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(
        i.alias("idx"), (F.element_at("embedding", i * 2 + 1).cast("double") + 0.5).alias("x"), (F.element_at("embedding", i * 2 + 2).cast("double") + 0.5).alias("y"), F.lit(0.0).alias("z"),
        ((k * 7 + i * 13) % 100 / 100.0).alias("visibility")))
    df = e.select((F.col("label") * 100000 + F.floor(k / 400)).alias("attempt_id"), k.alias("frame_id"), ((k % 400) * 0.025).alias("raw_time"), pts.alias("landmarks"))
    h = F.array(*[F.lit(v) for v in (3.0, 0.0, 0.0, 0.0, -15.0, 15.0)], F.lit(0.1) * (F.col("attempt_id") % 3), F.lit(0.05), F.lit(1.0))
    return df.withColumn("h", h)


LM = """lm AS (SELECT label*100000 + vec_id//400 AS attempt_id, vec_id AS frame_id, (vec_id%400)*0.025::DOUBLE AS raw_time, i AS idx, 0.5::DOUBLE+CAST(embedding[2*i+1] AS DOUBLE) AS x, 0.5::DOUBLE+CAST(embedding[2*i+2] AS DOUBLE) AS y, ((vec_id*7+i*13)%100)/100.0::DOUBLE AS visibility,
 0.1::DOUBLE*((label*100000 + vec_id//400)%3)*(0.5::DOUBLE+CAST(embedding[2*i+1] AS DOUBLE)) + 0.05::DOUBLE*(0.5::DOUBLE+CAST(embedding[2*i+2] AS DOUBLE)) + 1.0 AS den FROM embeddings, (SELECT unnest(range(0,32)) AS i)),
wl AS (SELECT attempt_id, frame_id, raw_time, idx, visibility, 3.0*x/den AS x, (15.0-15.0*y)/den AS y FROM lm)"""
JOINTS = "jt AS (SELECT * FROM (VALUES " + ",".join(f"('{n}',{i})" for n, i in D.JOINTS.items()) + ") AS t(joint, idx))"
SEGS = "sgm AS (SELECT * FROM (VALUES " + ",".join(f"('{n}','{a}','{b}',{m}::DOUBLE,{r}::DOUBLE,{str(q).lower()})" for n, a, b, m, r, q in D.SEGMENTS) + ") AS t(segment, a, b, mass, ratio, required))"


def body_sql(src):
    return f"""{LM}, {JOINTS}, {SEGS}, j0 AS (SELECT attempt_id, frame_id, joint, x, y, visibility AS v FROM {src} JOIN jt USING (idx)),
j1 AS (SELECT * FROM j0 UNION ALL SELECT l.attempt_id, l.frame_id, 'neck', (l.x+r.x)/2, (l.y+r.y)/2, least(l.v,r.v) FROM j0 l JOIN j0 r USING (attempt_id, frame_id) WHERE l.joint='leftShoulder' AND r.joint='rightShoulder'
 UNION ALL SELECT l.attempt_id, l.frame_id, 'midHip', (l.x+r.x)/2, (l.y+r.y)/2, least(l.v,r.v) FROM j0 l JOIN j0 r USING (attempt_id, frame_id) WHERE l.joint='leftHip' AND r.joint='rightHip'),
fr AS (SELECT DISTINCT attempt_id, frame_id FROM lm), sg AS (SELECT f.attempt_id, f.frame_id, s.segment, s.mass, s.required, p.v IS NOT NULL AND q.v IS NOT NULL AND coalesce(least(p.v,q.v) >= 0.25, false) AS used, least(p.v,q.v) AS vis, p.x+(q.x-p.x)*ratio AS sx, p.y+(q.y-p.y)*ratio AS sy
 FROM fr f CROSS JOIN sgm s LEFT JOIN j1 p ON p.attempt_id=f.attempt_id AND p.frame_id=f.frame_id AND p.joint=s.a LEFT JOIN j1 q ON q.attempt_id=f.attempt_id AND q.frame_id=f.frame_id AND q.joint=s.b),
cm0 AS (SELECT attempt_id, frame_id, coalesce(sum(mass) FILTER (used),0) AS m, sum(mass*sx) FILTER (used) AS mx, sum(mass*sy) FILTER (used) AS my, sum(mass*vis) FILTER (used) AS mv, bool_and(used OR NOT required) AS trunk FROM sg GROUP BY 1,2),
com AS (SELECT attempt_id, frame_id, trunk AND m >= 0.4 AS com_valid, CASE WHEN trunk AND m >= 0.4 THEN {r6('mx/m')} END AS com_x, CASE WHEN trunk AND m >= 0.4 THEN {r6('my/m')} END AS com_y, {r6('m')} AS mass_coverage, CASE WHEN m>0 THEN {r6('mv/m')} ELSE 0 END AS mean_visibility FROM cm0)"""


def _r(df, *cols):
    return df.withColumns({c: X.round_us(c) for c in cols})


@query("ag9", f"WITH {body_sql('lm')} SELECT * FROM com")
def ag9(spark, sf):
    return _r(P.centre_of_mass(frames(spark, sf), min_mass=0.4), "com_x", "com_y", "mass_coverage", "mean_visibility")


@query("jn15", f"WITH {body_sql('wl')} SELECT * FROM com")
def jn15(spark, sf):
    return _r(P.centre_of_mass(frames(spark, sf), min_mass=0.4, h="h"), "com_x", "com_y", "mass_coverage", "mean_visibility")


@query("jn14", f"WITH {body_sql('lm')} SELECT attempt_id, frame_id, segment, used, CASE WHEN used THEN {r6('sx')} END AS seg_x, CASE WHEN used THEN {r6('sy')} END AS seg_y FROM sg")
def jn14(spark, sf):
    return _r(P.segment_rows(frames(spark, sf)).select("attempt_id", "frame_id", "segment", "used", "seg_x", "seg_y"), "seg_x", "seg_y")


@query("dim3", f"WITH {SEGS}, {JOINTS} SELECT vec_id, segment, mass, ratio, required, ja.idx AS proximal_idx, jb.idx AS distal_idx FROM embeddings JOIN sgm ON mass > 0 LEFT JOIN jt ja ON ja.joint=a LEFT JOIN jt jb ON jb.joint=b")
def dim3(spark, sf):
    j = D.joints(spark)
    s = (D.segments(spark).join(F.broadcast(j.select(F.col("joint").alias("proximal"), F.col("landmark_idx").alias("proximal_idx"))), "proximal", "left")
         .join(F.broadcast(j.select(F.col("joint").alias("distal"), F.col("landmark_idx").alias("distal_idx"))), "distal", "left"))
    names = F.array(*[F.lit(r["segment"]) for r in D.segments(spark).where("mass > 0").select("segment").collect()])  # the fixed segments of the body
    return table(spark, sf, "embeddings").withColumn("segment", F.explode(names)).join(F.broadcast(s), "segment").select("vec_id", "segment", "mass", "ratio", "required", "proximal_idx", "distal_idx")


@query("ag42", f"""WITH {LM}, p AS (SELECT attempt_id, frame_id, max(x) FILTER (idx=11) AS lsx, max(y) FILTER (idx=11) AS lsy, max(x) FILTER (idx=12) AS rsx, max(y) FILTER (idx=12) AS rsy, max(x) FILTER (idx=23) AS lhx, max(y) FILTER (idx=23) AS lhy, max(x) FILTER (idx=24) AS rhx, max(y) FILTER (idx=24) AS rhy,
  avg(x) FILTER (idx IN (11,12,23,24)) AS mx, avg(y) FILTER (idx IN (11,12,23,24)) AS my FROM lm WHERE visibility >= 0.2 GROUP BY 1,2)
 SELECT attempt_id, frame_id, {r6('coalesce((lhx+rhx)/2,(lsx+rsx)/2, CASE WHEN coalesce(lsx,rsx) IS NOT NULL AND coalesce(lhx,rhx) IS NOT NULL THEN mx END)')} AS anchor_x, {r6('coalesce((lhy+rhy)/2,(lsy+rsy)/2, CASE WHEN coalesce(lsx,rsx) IS NOT NULL AND coalesce(lhx,rhx) IS NOT NULL THEN my END)')} AS anchor_y FROM p""")
def ag42(spark, sf):
    return frames(spark, sf).withColumn("a", P.body_anchor(F.col("landmarks"))).select("attempt_id", "frame_id", X.round_us("a.x").alias("anchor_x"), X.round_us("a.y").alias("anchor_y"))


@query("prj15", """WITH n AS (SELECT vec_id AS frame_id, label*100000 + vec_id//400 AS attempt_id, (vec_id%400)*0.025::DOUBLE AS raw_time, len(list_filter(range(0,32), lambda i: ((vec_id*7+i*13)%100)/100.0*1.2 <= 1 AND (0.5+CAST(embedding[2*i+1] AS DOUBLE))*1.3 <= 1.25)) AS kept FROM embeddings)
 SELECT attempt_id, frame_id, kept, vec%5<>0 AND vec%7<>0 AND vec%3<>0 AS valid, CASE WHEN vec%7<>0 THEN 0.5::DOUBLE END AS com_x, CASE WHEN vec%3=0 THEN 0.0 ELSE 0.9::DOUBLE END AS mass_coverage, CAST(CASE WHEN vec%11=0 THEN 2 WHEN vec%13=0 THEN 0 ELSE 1 END AS INTEGER) AS candidate_count FROM (SELECT *, frame_id AS vec FROM n)""")
def prj15(spark, sf):
    k = F.col("frame_id")
    wide = F.transform("landmarks", lambda p: F.struct(p["idx"].alias("idx"), (p["x"] * 1.3).alias("x"), p["y"].alias("y"), p["z"].alias("z"), (p["visibility"] * 1.2).alias("visibility")))
    f = frames(spark, sf).withColumns({"landmarks": wide, "valid": k % 5 != 0, "com_x": F.when(k % 7 == 0, 3.0).otherwise(0.5), "com_y": F.lit(0.5), "wall_x": F.lit(1.5), "wall_y": F.lit(7.0),
                                       "mass_coverage": F.when(k % 3 == 0, float("nan")).otherwise(0.9), "mean_visibility": F.lit(0.5), "pose_selected": F.lit(None).cast("boolean"), "pose_detected": F.lit(None).cast("boolean"),
                                       "candidate_count": F.when(k % 11 == 0, 7).when(k % 13 == 0, -3)})
    return P.repair_pose_frames(f).select("attempt_id", "frame_id", F.size("landmarks").cast("bigint").alias("kept"), "valid", "com_x", "mass_coverage", "candidate_count")


@query("prj15_range", f"WITH {LM}, f AS (SELECT DISTINCT attempt_id, frame_id, raw_time FROM lm WHERE raw_time BETWEEN 1-0.001 AND 8+0.001), n AS (SELECT *, row_number() OVER (PARTITION BY attempt_id ORDER BY raw_time) AS rn FROM f) SELECT attempt_id, frame_id, floor((raw_time-1)*1000+0.5)/1000 AS climb_time FROM n WHERE rn <= 450")
def prj15_range(spark, sf):
    f = frames(spark, sf).withColumns({"start_s": F.lit(1.0), "end_s": F.lit(8.0)})
    return P.first_frames(f, limit=450).select("attempt_id", "frame_id", "climb_time")


@query("prj16", f"WITH {LM} SELECT attempt_id, frame_id, CAST(idx AS INTEGER) AS idx, x, y FROM lm WHERE idx BETWEEN 15 AND 22")
def prj16(spark, sf):
    return frames(spark, sf).select("attempt_id", "frame_id", F.explode(P.hand_landmarks("landmarks")).alias("p")).select("attempt_id", "frame_id", "p.idx", "p.x", "p.y")


@query("prj32", f"WITH {LM} SELECT attempt_id, frame_id, CAST(idx AS INTEGER) AS idx, {r6('x')} AS wall_x, {r6('y')} AS wall_y FROM wl")
def prj32(spark, sf):
    f = frames(spark, sf).select("attempt_id", "frame_id", "h", F.explode("landmarks").alias("p"))
    x, y = P.project(F.col("p.x"), F.col("p.y"))
    return f.select("attempt_id", "frame_id", "p.idx", X.round_us(x).alias("wall_x"), X.round_us(y).alias("wall_y"))


@query("prj43", """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity/20 <= 1.501 AND 1.5-l_quantity/20 <= 0.3 AND l_discount*11 BETWEEN 0 AND 1 AND l_tax*15 BETWEEN 0 AND 1 AS valid FROM lineitem""")
def prj43(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", P.valid_seed(F.col("l_quantity") / 20, F.col("l_discount") * 11, F.col("l_tax") * 15, F.lit(1.5)).alias("valid"))


# --- calibration ------------------------------------------------------------------------------

def calibrations(spark, sf):
    # a part is a short row of one file, but a calibration is work: dealt out, not left to the file's few splits
    p, s = table(spark, sf, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey"), F.col("p_size")
    pt = lambda i, x, y, wx, wy: F.struct(F.lit(i).alias("id"), x.alias("x"), y.alias("y"), F.lit(wx).alias("wall_x"), F.lit(wy).alias("wall_y"))
    bl = F.when(s % 13 == 0, 0.85).otherwise(0.2 + (s % 5) * 0.01)
    corners = F.array(pt("bottomLeft", bl, F.lit(0.9), 0.0, 0.0), pt("bottomRight", F.lit(0.8), 0.9 - (s % 3) * 0.01, 3.0, 0.0),
                      F.when(s % 23 == 0, pt("bottomRight", F.lit(0.7), F.lit(0.1), 3.0, 15.0)).otherwise(pt("topRight", F.lit(0.7), 0.1 + (s % 4) * 0.01, 3.0, 15.0)), pt("topLeft", F.lit(0.3), F.lit(0.1), 0.0, 15.0))
    return p.select(F.col("p_partkey").alias("calibration_id"), s.alias("s"), corners.alias("corners"), (s % 17 != 0).alias("static_camera"), F.when(s % 19 == 0, -1.0).otherwise(2.0).alias("frame_raw_time"),
                    F.when(s % 11 == 0, 4.0).otherwise(3.0).alias("width_m"), F.lit(15.0).alias("height_m"))


ERR = "CASE WHEN p_size%17=0 THEN 'moving-camera' WHEN p_size%19=0 THEN 'frame-time' WHEN p_size%11=0 THEN 'wall-size' WHEN p_size%23=0 THEN 'corner-ids' WHEN p_size%13=0 THEN 'left-right' END"


@query("prj33", f"SELECT p_partkey AS calibration_id, {ERR} AS error FROM part")
def prj33(spark, sf):
    return calibrations(spark, sf).select("calibration_id", P.calibration_error().alias("error"))


@query("prj34", f"SELECT p_partkey AS calibration_id, id, x AS wall_x, y AS wall_y FROM part CROSS JOIN (SELECT unnest(['bottomLeft','bottomRight','topRight','topLeft']) AS id, unnest([0.0,3.0,3.0,0.0]::DOUBLE[]) AS x, unnest([0.0,0.0,15.0,15.0]::DOUBLE[]) AS y) WHERE {ERR} IS NULL")
def prj34(spark, sf):
    """Each solved matrix must send its own corners to the wall corners."""
    c = calibrations(spark, sf)
    j = P.solve_calibrations(c).join(c.select("calibration_id", F.explode("corners").alias("p")), "calibration_id")
    x, y = P.project(F.col("p.x"), F.col("p.y"))
    return j.select("calibration_id", "p.id", X.round_us(x).alias("wall_x"), X.round_us(y).alias("wall_y"))


@query("prj35", f"WITH {HOLDS} SELECT p_partkey AS calibration_id, hold_id, {r6('hold_x')} AS wall_x, {r6('hold_y')} AS wall_y FROM part JOIN holds ON hold_id > 0 WHERE {ERR} IS NULL")
def prj35(spark, sf):
    """Holds projected into the image and back must return to their wall position."""
    r = P.project_route(P.solve_calibrations(calibrations(spark, sf)))
    x, y = P.project(F.col("image_x"), F.col("image_y"))
    return r.select("calibration_id", "hold_id", X.round_us(x).alias("wall_x"), X.round_us(y).alias("wall_y"))


@query("fn27", f"""WITH q AS (SELECT p_partkey, CASE WHEN p_size%13=0 THEN 0.85::DOUBLE ELSE 0.2::DOUBLE+(p_size%5)*0.01::DOUBLE END AS x1, 0.9::DOUBLE AS y1, 0.8::DOUBLE AS x2, 0.9::DOUBLE-(p_size%3)*0.01::DOUBLE AS y2, 0.7::DOUBLE AS x3, 0.1::DOUBLE+(p_size%4)*0.01::DOUBLE AS y3, 0.3::DOUBLE AS x4, 0.1::DOUBLE AS y4 FROM part WHERE p_size%23<>0)
 SELECT p_partkey AS calibration_id, {r6('abs(x1*y2-x2*y1+x2*y3-x3*y2+x3*y4-x4*y3+x4*y1-x1*y4)/2')} AS area, (x2-x1)*(y3-y1)-(y2-y1)*(x3-x1) < -1e-7 AND (x3-x2)*(y4-y2)-(y3-y2)*(x4-x2) < -1e-7 AND (x4-x3)*(y1-y3)-(y4-y3)*(x1-x3) < -1e-7 AND (x1-x4)*(y2-y4)-(y1-y4)*(x2-x4) < -1e-7 AS convex FROM q""")
def fn27(spark, sf):
    c = calibrations(spark, sf).where("s % 23 <> 0")
    p = [P.corner("corners", n) for n, _, _ in P.CORNERS]
    return c.select("calibration_id", X.round_us(P.quad_area(p)).alias("area"), P.quad_convex(p).alias("convex"))


# --- nearest hold -----------------------------------------------------------------------------

PTS = "pts AS (SELECT attempt_id, raw_time, 1.2::DOUBLE + (v%60)/100.0::DOUBLE AS x, raw_time*1.4::DOUBLE AS y FROM smp)"


def points(spark, sf):
    return V.samples(spark, sf).select("attempt_id", "raw_time", (1.2 + (F.col("v") % 60) / 100.0).alias("x"), (F.col("raw_time") * 1.4).alias("y"))


@query("jn13", f"WITH {V.SAMPLES}, {PTS}, {HOLDS}, d AS (SELECT p.*, hold_id, sqrt((x-hold_x)*(x-hold_x)+(y-hold_y)*(y-hold_y)) AS dist FROM pts p CROSS JOIN holds), r AS (SELECT *, row_number() OVER (PARTITION BY attempt_id, raw_time ORDER BY dist, hold_id) AS rn, min(CASE WHEN hold_id<>10 THEN dist END) OVER (PARTITION BY attempt_id, raw_time) AS alt FROM d) SELECT attempt_id, raw_time, CAST(hold_id AS INTEGER) AS hold_id, {r6('dist')} AS distance_m, {r6('alt')} AS other_m FROM r WHERE rn=1")
def jn13(spark, sf):
    n, o = P.nearest_hold("x", "y"), P.nearest_other_hold("x", "y", 10)
    return points(spark, sf).withColumns({"n": n, "o": o}).select("attempt_id", "raw_time", F.col("n.id").alias("hold_id"), X.round_us("n.d").alias("distance_m"), X.round_us("o.d").alias("other_m"))


@query("jn30", f"WITH {V.SAMPLES}, {PTS}, {HOLDS}, d AS (SELECT p.*, hold_id, sqrt((x-hold_x)*(x-hold_x)+(y-hold_y)*(y-hold_y)) AS dist FROM pts p CROSS JOIN holds), r AS (SELECT *, row_number() OVER (PARTITION BY attempt_id, raw_time ORDER BY dist, hold_id) AS rn FROM d) SELECT attempt_id, raw_time, CAST(CASE WHEN dist<=0.5 THEN hold_id END AS INTEGER) AS hold_id FROM r WHERE rn=1")
def jn30(spark, sf):
    return points(spark, sf).withColumn("n", P.nearest_hold("x", "y")).select("attempt_id", "raw_time", F.when(F.col("n.d") <= 0.5, F.col("n.id")).alias("hold_id"))


# --- contact ----------------------------------------------------------------------------------

OPT = C.contact_options(6.0, False)
HOLD = (1.5, 7.25)


def hand_obs(spark, sf):
    """Two hands that step up once a second and rest two thirds of it."""
    s = V.samples(spark, sf).withColumn("hand", F.explode(F.array(F.lit("left"), F.lit("right"))))
    t, v = F.col("raw_time"), F.col("v")
    y = (F.floor(t) + F.least(F.lit(1.0), (t - F.floor(t)) * 3.0)) * 1.45 + ((v * 7) % 9 - 4) / 50.0
    x = F.lit(1.5) + ((v * 13) % 9 - 4) / 40.0 + F.when(F.col("hand") == "right", (F.col("attempt_id") % 4) * 0.12).otherwise(0.0)
    return s.select("attempt_id", "hand", "raw_time", x.alias("x"), y.alias("y"), (0.4 + (v % 50) / 100.0).alias("visibility"), F.lit("wrist").alias("point_source"), F.lit(1).alias("points"))


EPIS = f"""hob AS (SELECT attempt_id, hand, raw_time, 1.5::DOUBLE + ((v*13)%9-4)/40.0::DOUBLE + CASE WHEN hand='right' THEN (attempt_id%4)*0.12::DOUBLE ELSE 0 END AS x, (floor(raw_time)+least(1.0,(raw_time-floor(raw_time))*3.0))*1.45::DOUBLE + ((v*7)%9-4)/50.0::DOUBLE AS y, 0.4::DOUBLE+(v%50)/100.0::DOUBLE AS vis FROM smp, (SELECT unnest(['left','right']) AS hand)),
e0 AS (SELECT *, sqrt((x-1.5)*(x-1.5)+(y-7.25)*(y-7.25)) AS dist FROM hob), e1 AS (SELECT *, lag(raw_time) OVER q AS pt, lag(dist) OVER q AS pd FROM e0 WINDOW q AS (PARTITION BY attempt_id, hand ORDER BY raw_time)),
e2 AS (SELECT *, dist<=0.55 AND NOT coalesce(pd<=0.55 AND raw_time-pt<=0.375+1e-9, false) AS st FROM e1), e3 AS (SELECT *, sum(CASE WHEN st THEN 1 ELSE 0 END) OVER (PARTITION BY attempt_id, hand ORDER BY raw_time) AS episode FROM e2),
ep AS (SELECT *, max(CASE WHEN st AND raw_time-pt<=0.375+1e-9 THEN pt END) OVER z AS et, max(CASE WHEN st AND raw_time-pt<=0.375+1e-9 THEN pd END) OVER z AS ed FROM e3 WHERE dist<=0.55 WINDOW z AS (PARTITION BY attempt_id, hand, episode))"""
TX, TY = C.hold_xy(10)
FILT = f"""{EPIS}, {HOLDS}, m0 AS (SELECT *, row_number() OVER z - 1 AS idx, count(*) OVER (PARTITION BY attempt_id, hand, episode) AS n, lag(x) OVER z AS xa, lead(x) OVER z AS xb, lag(y) OVER z AS ya, lead(y) OVER z AS yb FROM ep WINDOW z AS (PARTITION BY attempt_id, hand, episode ORDER BY raw_time)),
m1 AS (SELECT *, CASE WHEN n>=3 AND idx>0 AND idx<n-1 THEN list_sort([xa,x,xb])[2] ELSE x END AS fx, CASE WHEN n>=3 AND idx>0 AND idx<n-1 THEN list_sort([ya,y,yb])[2] ELSE y END AS fy FROM m0), m2 AS (SELECT *, sqrt((fx-1.5)*(fx-1.5)+(fy-7.25)*(fy-7.25)) AS fd FROM m1),
nh AS (SELECT attempt_id, hand, raw_time, arg_min(hold_id, struct_pack(d:=d, i:=hold_id)) AS nearest_id, min(d) FILTER (hold_id<>10) AS other_m FROM (SELECT m.attempt_id, m.hand, m.raw_time, hold_id, sqrt(power(fx-hold_x-(1.5-{TX!r}::DOUBLE),2)+power(fy-hold_y-(7.25-{TY!r}::DOUBLE),2)) AS d FROM m2 m CROSS JOIN holds) GROUP BY 1,2,3),
flt AS (SELECT m2.*, nearest_id, other_m FROM m2 JOIN nh USING (attempt_id, hand, raw_time))"""
EVAL = f"""{FILT}, v0 AS (SELECT *, CASE WHEN raw_time-lag(raw_time) OVER z > 1e-9 THEN sqrt(power(fx-lag(fx) OVER z,2)+power(fy-lag(fy) OVER z,2))/(raw_time-lag(raw_time) OVER z) END AS sp, min(dist) OVER y AS closest, quantile_cont(fd,0.5) OVER y AS med, coalesce(lag(raw_time) OVER z, et) AS qt, coalesce(lag(fd) OVER z, ed) AS qd FROM flt WINDOW z AS (PARTITION BY attempt_id, hand, episode ORDER BY raw_time), y AS (PARTITION BY attempt_id, hand, episode)),
v1 AS (SELECT *, least(0.38::DOUBLE, greatest(closest+0.08::DOUBLE, med+0.08::DOUBLE)) AS rad FROM v0), v2 AS (SELECT *, fd<=rad+1e-9 AS inn FROM v1), v3 AS (SELECT *, inn AND (coalesce(lead(inn) OVER z,false) OR coalesce(lag(inn) OVER z,false)) AS stable FROM v2 WINDOW z AS (PARTITION BY attempt_id, hand, episode ORDER BY raw_time)),
v4 AS (SELECT *, CASE WHEN stable THEN CASE WHEN raw_time-qt<=0.375+1e-9 AND qd>rad AND fd<qd THEN floor((qt+(raw_time-qt)*least(1,greatest(0,(qd-rad)/(qd-fd))))*1000+0.5)/1000 ELSE floor(raw_time*1000+0.5)/1000 END END AS ons FROM v3),
v5 AS (SELECT attempt_id, hand, episode, count(*) AS samples, min(raw_time) AS first_s, max(raw_time)-min(raw_time) AS duration_s, min(dist) AS closest_m, max(med) AS median_m, avg(vis) AS mean_visibility, quantile_cont(sp,0.5) AS ms, sqrt(power(arg_max(fx,raw_time)-arg_min(fx,raw_time),2)+power(arg_max(fy,raw_time)-arg_min(fy,raw_time),2)) AS net,
 count(*) FILTER (fd<=0.38+1e-9) AS confirmations, count(*) FILTER (fd<=0.38+1e-9 AND nearest_id=10) AS nc, count(*) FILTER (nearest_id=10) AS na, count(*) FILTER (fd<=0.38+1e-9 AND fd<=other_m+0.08) AS pc, count(*) FILTER (fd<=other_m+0.08) AS pa, arg_min(ons,raw_time) FILTER (stable) AS onset_s FROM v4 GROUP BY 1,2,3),
v6 AS (SELECT *, least(1.0, samples/greatest(1, floor(duration_s*6+0.5)+1)) AS coverage, CASE WHEN confirmations>0 THEN nc/confirmations ELSE na/samples END AS nearest_share, CASE WHEN confirmations>0 THEN pc/confirmations ELSE pa/samples END AS plausible_share, CASE WHEN duration_s>1e-9 THEN net/duration_s END AS net_speed FROM v5),
evl AS (SELECT *, floor(least(100,greatest(0, 25*(1-least(1,median_m/0.38))+15*least(1,duration_s/0.28)+12*coverage+10*mean_visibility+16*(1-least(1,coalesce(ms,1e9)/1.35))+12*least(1,confirmations/2)+5*(nearest_share+plausible_share)))*10+0.5)/10 AS score,
 CASE WHEN samples<2 OR duration_s+1e-9<0.14 THEN 'too-short' WHEN coverage<0.55 THEN 'missing-frames' WHEN confirmations<2 OR median_m>0.38 OR onset_s IS NULL THEN 'not-confirmed' WHEN nearest_share<0.5 OR plausible_share<0.7 THEN 'other-hold' WHEN ms>1.35 OR net_speed>0.9 THEN 'fly-by' END AS reject_reason FROM v6)"""


def episodes(spark, sf):
    return C.proximity_episodes(hand_obs(spark, sf), HOLD, OPT)


def evaluated(spark, sf):
    return C.evaluate_episodes(C.median_filter(episodes(spark, sf), HOLD, 10), OPT, 10)


@query("wn18", f"WITH {V.SAMPLES}, {EPIS} SELECT attempt_id, hand, raw_time, CAST(episode AS BIGINT) AS episode, et AS entry_s FROM ep")
def wn18(spark, sf):
    return episodes(spark, sf).select("attempt_id", "hand", "raw_time", "episode", F.col("entry.t").alias("entry_s"))


@query("wn19", f"WITH {V.SAMPLES}, {FILT} SELECT attempt_id, hand, raw_time, {r6('fx')} AS fx, {r6('fy')} AS fy, {r6('fd')} AS fd, CAST(nearest_id AS INTEGER) AS nearest_id FROM flt")
def wn19(spark, sf):
    return _r(C.median_filter(episodes(spark, sf), HOLD, 10).select("attempt_id", "hand", "raw_time", "fx", "fy", "fd", "nearest_id"), "fx", "fy", "fd")


@query("wn20", f"WITH {V.SAMPLES}, {EVAL} SELECT attempt_id, hand, CAST(episode AS BIGINT) AS episode, onset_s FROM evl")
def wn20(spark, sf):
    return evaluated(spark, sf).select("attempt_id", "hand", "episode", "onset_s")


@query("wn21", f"WITH {V.SAMPLES}, {EVAL} SELECT attempt_id, hand, CAST(episode AS BIGINT) AS episode, samples, {r6('duration_s')} AS duration_s, {r6('closest_m')} AS closest_m, {r6('median_m')} AS median_m, {r6('coverage')} AS coverage, confirmations, {r6('nearest_share')} AS nearest_share, {r6('plausible_share')} AS plausible_share, score, reject_reason FROM evl")
def wn21(spark, sf):
    e = evaluated(spark, sf).select("attempt_id", "hand", "episode", "samples", "duration_s", "closest_m", "median_m", "coverage", "confirmations", "nearest_share", "plausible_share", "score", "reject_reason")
    return _r(e, "duration_s", "closest_m", "median_m", "coverage", "nearest_share", "plausible_share")


CHO = f"""{EVAL}, ch0 AS (SELECT *, min(onset_s) OVER (PARTITION BY attempt_id) AS first_on FROM evl WHERE reject_reason IS NULL), ch1 AS (SELECT *, row_number() OVER (PARTITION BY attempt_id ORDER BY score DESC, onset_s, closest_m, hand, episode) AS rn FROM ch0 WHERE onset_s <= first_on + 0.45::DOUBLE/6 + 1e-9),
cho AS (SELECT attempt_id, hand, onset_s, {r6('closest_m')} AS closest_m, score, CASE WHEN attempt_id%7=0 OR attempt_id%5=1 OR mean_visibility<0.4 OR score<62 THEN 'Low' WHEN attempt_id%5=0 AND coverage>=0.8 AND duration_s>=0.2 AND closest_m<=0.28 AND ms<=0.8 AND mean_visibility>=0.6 AND nearest_share>=0.75 AND score>=75 THEN 'High' ELSE 'Medium' END AS confidence FROM ch1 WHERE rn=1)"""


def chosen(spark, sf):
    a = F.col("attempt_id")
    facts = V.samples(spark, sf).select("attempt_id").distinct().select("attempt_id", F.when(a % 5 == 0, "High").when(a % 5 == 1, "Needs review").otherwise("Medium").alias("quality"), F.when(a % 7 == 0, "Low").otherwise("High").alias("calibration_confidence"))
    return C.choose_contact(evaluated(spark, sf), OPT, False, facts)


@query("wn22", f"WITH {V.SAMPLES}, {CHO} SELECT * FROM cho")
def wn22(spark, sf):
    return _r(chosen(spark, sf), "closest_m")


@query("prj39", f"WITH {V.SAMPLES}, {CHO} SELECT c.attempt_id, 'hold10' AS marker_id, onset_s AS raw_time, greatest(0.0, {r6('onset_s - s')}) AS climb_time, 'Hold contact detection' AS source, confidence FROM cho c JOIN (SELECT attempt_id, max(start_s) AS s FROM smp GROUP BY 1) USING (attempt_id)")
def prj39(spark, sf):
    starts = V.samples(spark, sf).groupBy("attempt_id").agg(F.max("start_s").alias("start_s"))
    return _r(C.contact_markers(chosen(spark, sf), starts).select("attempt_id", "marker_id", "raw_time", "climb_time", "source", "confidence"), "climb_time")


@query("prj40", """SELECT p_partkey, CASE WHEN p_size%2=0 THEN 0.62::DOUBLE ELSE 0.55::DOUBLE END AS proximity_m, CASE WHEN p_size%2=0 THEN 0.44::DOUBLE ELSE 0.38::DOUBLE END AS confirmation_m, least(0.46::DOUBLE, greatest(0.15::DOUBLE, 2.25::DOUBLE/greatest(1,p_size))) AS gap_s, least(1.0, greatest(0.2::DOUBLE, p_size/40.0*0.75)) AS min_visibility FROM part""")
def prj40(spark, sf):
    o = C.option_columns(F.col("p_size").cast("double"), F.col("p_size") % 2 == 0, F.col("p_size") / 40.0)
    return table(spark, sf, "part").select("p_partkey", *[o[c].alias(c) for c in ("proximity_m", "confirmation_m", "gap_s", "min_visibility")])


@query("prj31", f"WITH {V.SAMPLES} SELECT attempt_id, raw_time, greatest(0.5::DOUBLE, raw_time-0.4::DOUBLE) AS window_start_s, least(9.0::DOUBLE, raw_time+0.6::DOUBLE) AS window_end_s FROM smp")
def prj31(spark, sf):
    a, b = C.review_window("raw_time", F.lit(0.5), F.lit(9.0))
    return V.samples(spark, sf).select("attempt_id", "raw_time", a.alias("window_start_s"), b.alias("window_end_s"))


@query("wn17", None)
def wn17(spark, sf):
    return C.hand_points(frames(spark, sf), 0.25)


def heights(spark, sf):
    h = hand_obs(spark, sf).where("hand = 'left'")
    s = V.samples(spark, sf).select("attempt_id", "raw_time", "v", "start_s")
    return h.select("attempt_id", "raw_time", "y").join(s, ["attempt_id", "raw_time"]).select("attempt_id", "raw_time", "start_s", F.when(F.col("v") % 4 != 0, F.col("y")).alias("left_y"), F.when(F.col("v") % 3 == 0, F.col("y") - 0.1).alias("right_y"))


@query("wn23", f"""WITH {V.SAMPLES}, h0 AS (SELECT attempt_id, raw_time, start_s, CASE WHEN v%4<>0 THEN y END AS ly, CASE WHEN v%3=0 THEN y-0.1::DOUBLE END AS ry FROM (SELECT *, (floor(raw_time)+least(1.0,(raw_time-floor(raw_time))*3.0))*1.45::DOUBLE + ((v*7)%9-4)/50.0::DOUBLE AS y FROM smp)),
 h1 AS (SELECT *, CASE WHEN ly IS NOT NULL AND (ry IS NULL OR ly>=ry) THEN 'left' ELSE 'right' END AS hand, CASE WHEN ly IS NOT NULL AND (ry IS NULL OR ly>=ry) THEN ly ELSE ry END AS y, row_number() OVER (PARTITION BY attempt_id ORDER BY raw_time) AS i FROM h0 WHERE ly IS NOT NULL OR ry IS NOT NULL),
 h2 AS (SELECT *, lag(y) OVER q AS py, lag(raw_time) OVER q AS pt, sum(CASE WHEN g>0.25 THEN 1 ELSE 0 END) OVER q AS run FROM (SELECT *, raw_time-lag(raw_time) OVER (PARTITION BY attempt_id ORDER BY raw_time) AS g FROM h1) WINDOW q AS (PARTITION BY attempt_id ORDER BY raw_time)),
 hit AS (SELECT c.* FROM h2 c WHERE g>0 AND g<=0.25 AND py<8.0 AND y>=8.0 AND EXISTS (SELECT 1 FROM h2 b WHERE b.attempt_id=c.attempt_id AND b.run=c.run AND b.i<c.i AND c.raw_time-b.raw_time<=0.6+1e-7 AND b.y<=8.0-0.18)
   AND EXISTS (SELECT 1 FROM h2 n WHERE n.attempt_id=c.attempt_id AND n.run=c.run AND n.i=c.i+1 AND n.raw_time-c.raw_time<=0.3+1e-7 AND n.y>=8.0-0.12)),
 f AS (SELECT *, row_number() OVER (PARTITION BY attempt_id ORDER BY raw_time) AS rn FROM hit)
 SELECT attempt_id, p AS passage_s, hand, floor((p-start_s)*1000+0.5)/1000 AS climb_s FROM (SELECT *, floor((pt+g*CASE WHEN y-py>1e-6 THEN least(1,greatest(0,(8.0-py)/(y-py))) ELSE 1 END)*1000+0.5)/1000 AS p FROM f WHERE rn=1)""")
def wn23(spark, sf):
    return C.height_passage(heights(spark, sf), 8.0)


@query("jn20", f"WITH {V.SAMPLES}, t AS (SELECT attempt_id, avg(ms)/1000 AS target_s FROM smp GROUP BY 1), g AS (SELECT t.attempt_id, {r6('target_s')} AS target_s, max(raw_time) FILTER (raw_time<={r6('target_s')}) AS b, min(raw_time) FILTER (raw_time>={r6('target_s')}) AS a FROM t JOIN smp USING (attempt_id) GROUP BY 1,2) SELECT attempt_id, target_s, CASE WHEN a-b<=0.15 THEN b END AS bracket_start_s, CASE WHEN a-b<=0.15 THEN a END AS bracket_end_s FROM g")
def jn20(spark, sf):
    s = V.samples(spark, sf)
    return C.frames_around(s, s.groupBy("attempt_id").agg(X.round_us(F.avg("ms") / 1000).alias("target_s")))


PLAN = f"""co AS (SELECT attempt_id, 3.0::DOUBLE+(attempt_id%70)/10.0::DOUBLE AS coarse_s FROM smp GROUP BY 1), pl0 AS (SELECT c.attempt_id, coarse_s, max(raw_time) AS seed_s FROM co c JOIN smp s ON s.attempt_id=c.attempt_id WHERE coarse_s>0.5 AND coarse_s<9.6 AND raw_time>=0.5 AND raw_time<=greatest(0.5::DOUBLE,coarse_s-0.7::DOUBLE) AND greatest(0.5::DOUBLE,coarse_s-0.7::DOUBLE)-raw_time<=0.3 GROUP BY 1,2),
pl AS (SELECT *, least(10.0::DOUBLE-0.001::DOUBLE, 9.6::DOUBLE, coarse_s+0.9::DOUBLE) AS window_end_s, greatest(0.5::DOUBLE, seed_s-0.6::DOUBLE) AS preview_start_s FROM pl0 WHERE least(10.0::DOUBLE-0.001::DOUBLE, 9.6::DOUBLE, coarse_s+0.9::DOUBLE)-seed_s BETWEEN 0.4 AND 2.2)"""


def plans(spark, sf):
    s = V.samples(spark, sf)
    coarse = s.select("attempt_id").distinct().select("attempt_id", (3.0 + (F.col("attempt_id") % 70) / 10.0).alias("coarse_s"), F.lit(0.5).alias("start_s"), F.lit(9.6).alias("end_s"), F.lit(10.0).alias("duration_s"))
    return C.refinement_plan(coarse, s)


@query("jn21", f"WITH {V.SAMPLES}, {PLAN} SELECT attempt_id, coarse_s, seed_s, window_end_s, preview_start_s FROM pl")
def jn21(spark, sf):
    return plans(spark, sf)


@query("jn22", f"""WITH {V.SAMPLES}, {PLAN}, d AS (SELECT attempt_id, CASE WHEN attempt_id%6<>0 THEN coarse_s + (attempt_id%9-4)/8.0::DOUBLE END AS fine_s, attempt_id%2=0 AS ic, attempt_id%11 AS sel FROM pl), j AS (SELECT pl.*, fine_s, ic, sel, coalesce(fine_s>=seed_s AND fine_s<=window_end_s AND abs(fine_s-coarse_s)<=0.45, false) AND sel>=4 AS ok FROM pl JOIN d USING (attempt_id))
 SELECT attempt_id, ok AS refined, CASE WHEN ok THEN CASE WHEN ic THEN 'contact-candidate' ELSE 'height-passage' END ELSE 'inconclusive' END AS kind, CASE WHEN ok THEN fine_s ELSE coarse_s END AS candidate_s, CASE WHEN ok THEN floor((fine_s-coarse_s)*1000+0.5)/1000 END AS shift_s,
 CASE WHEN ok THEN NULL WHEN sel<4 THEN 'few-frames' WHEN fine_s IS NULL THEN 'no-candidate' WHEN fine_s<seed_s OR fine_s>window_end_s THEN 'outside-window' ELSE 'disagrees' END AS reason FROM j""")
def jn22(spark, sf):
    p, a = plans(spark, sf), F.col("attempt_id")
    dense = p.select("attempt_id", F.when(a % 6 != 0, F.col("coarse_s") + (a % 9 - 4) / 8.0).alias("fine_s"), (a % 2 == 0).alias("is_contact"), (a % 11).alias("selected_frames"))
    return C.second_pass(p, dense)


@query("top8", f"""WITH {V.SAMPLES}, {PLAN}, it AS (SELECT attempt_id, 0 AS o, coarse_s + (attempt_id%9-4)/8.0::DOUBLE AS t, 'Closer estimate' AS label, preview_start_s AS a, window_end_s AS z FROM pl UNION ALL SELECT attempt_id, 1, coarse_s, 'Broad cursor', preview_start_s, window_end_s FROM pl
  UNION ALL SELECT attempt_id, 2+i, preview_start_s+(window_end_s-preview_start_s)*i/6, CASE i WHEN 0 THEN 'Approach' WHEN 6 THEN 'Follow-through' ELSE 'Context' END, preview_start_s, window_end_s FROM pl, (SELECT unnest(range(0,7)) AS i)), f AS (SELECT * FROM it WHERE t BETWEEN a AND z)
 SELECT attempt_id, {r6('t')} AS raw_time, label FROM f x WHERE NOT EXISTS (SELECT 1 FROM f y WHERE y.attempt_id=x.attempt_id AND y.o<x.o AND abs(y.t-x.t)<0.001)""")
def top8(spark, sf):
    return C.evidence_frames(plans(spark, sf).withColumn("fine_s", F.col("coarse_s") + (F.col("attempt_id") % 9 - 4) / 8.0))


def targets(spark, sf):
    s = F.col("s")
    c = P.solve_calibrations(calibrations(spark, sf)).join(calibrations(spark, sf).select("calibration_id", "s"), "calibration_id", "right")
    zone = F.struct(*[v.alias(n) for n, v in (("x1", s / 60.0), ("y1", s / 50.0), ("x2", s / 60.0 + 0.1), ("y2", F.when(s % 9 == 0, 1.4).otherwise(s / 50.0)))])
    return c.select("calibration_id", "h", F.when(s % 7 != 0, zone).alias("zone"), (s % 2 == 0).alias("aligned"), F.lit(0.5).alias("align_x"), F.lit(0.5).alias("align_y"), (s / 12.0).alias("align_wx"), F.lit(8.0).alias("align_wy"))


@query("prj24")
def prj24(spark, sf):
    return C.resolve_target(targets(spark, sf)).select("calibration_id", "target_source", "fallback_reason", X.round_us("target_x").alias("target_x"), X.round_us("target_y").alias("target_y"))


@query("prj42", f"""SELECT p_partkey AS calibration_id, CASE WHEN p_size%2=0 AND p_size/12.0 BETWEEN 0 AND 3 AND {ERR} IS NULL THEN 'visual-alignment' ELSE 'standard-template' END AS target_source, CASE WHEN p_size%2=0 AND p_size/12.0 BETWEEN 0 AND 3 AND {ERR} IS NULL THEN {r6('p_size/12.0::DOUBLE')} ELSE {r6(repr(TX)+'::DOUBLE')} END AS target_x FROM part WHERE p_size%7=0""")
def prj42(spark, sf):
    t = targets(spark, sf).where("zone is null")
    return C.resolve_target(t).select("calibration_id", "target_source", X.round_us("target_x").alias("target_x"))


@query("jn31", f"""WITH {HOLDS}, oh AS (SELECT l_orderkey AS attempt_id, CASE WHEN l_partkey%40=0 THEN 21 ELSE l_suppkey%20+1 END AS hold_id FROM lineitem), p AS (SELECT oh.attempt_id, oh.hold_id, h.hold_x + CASE WHEN oh.attempt_id%5=0 THEN 0.5 ELSE 0 END AS x FROM oh LEFT JOIN holds h ON h.hold_id=oh.hold_id),
 g AS (SELECT attempt_id, count(*) AS holds, count(DISTINCT hold_id) AS ids, bool_and(hold_id<=20 AND x BETWEEN 0 AND 3) AS ok, min(CASE WHEN hold_id=10 THEN abs(x-{TX!r}::DOUBLE) END) AS d FROM p GROUP BY 1) SELECT attempt_id, holds, coalesce(holds>=3 AND ids=holds AND ok AND d<=0.02, false) AS usable FROM g""")
def jn31(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("attempt_id"), F.when(F.col("l_partkey") % 40 == 0, 21).otherwise(F.col("l_suppkey") % 20 + 1).cast("int").alias("hold_id"))
    h = li.join(F.broadcast(D.holds(spark)), "hold_id", "left")
    return C.observed_route(h.select("attempt_id", "hold_id", (F.col("hold_x") + F.when(F.col("attempt_id") % 5 == 0, 0.5).otherwise(0.0)).alias("x"), F.col("hold_y").alias("y"), F.lit(TX).alias("target_x"), F.lit(TY).alias("target_y")), 10)
