"""Queries over small areas of frames: upper patch discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import patches as P
from .registry import query
from .roles import table
from .series_roles import event_ms

W, H = 10, 24
#: Cells of a task, about; a task sorts them by recording.
CELLS_AT_ONCE = 1_000_000


def grid_frames(spark, sf):
    """Each event is a frame of its user's recording, 10 x 24 cells of wall whose light depends on its value; events of one
    millisecond light the same frame. Most walls hold an indicator that turns from green to red for good, some only
    for a moment, some brighten as a whole, and on some a spectator covers the wall for two seconds."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("recording_id"), event_ms().alias("ms"), "value")
    f = e.groupBy("recording_id", "ms").agg(F.sum(F.floor(F.col("value") * 100 + 0.5)).alias("v"))
    # few small rows become many cells: tasks of about a million, in which whole recordings lie together
    tasks = 1 + e.count() * W * H // CELLS_AT_ONCE
    f = f.repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), "recording_id")
    c = f.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(W - 1)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(H - 1))))
    k, ms, x, y, v = (F.col(n) for n in ("recording_id", "ms", "x", "y", "v"))
    t0 = (k % 5) * 1000 + 4000
    lamp = (F.abs(x - (2 + k % 6)) <= 1) & (F.abs(y - (2 + k % 4)) <= 1)
    lit = (k % 6 != 0) & (ms >= t0) & ((k % 7 != 0) | (ms < t0 + 500))
    covered = (k % 5 == 1) & ms.between(5000, 6999) & (x < 8)
    more = F.when((k % 4 == 0) & (ms > 3000), 30).otherwise(0)
    tone = lambda wall, off, on, cover: (F.when(covered, cover).when(lamp & lit, on + v % 4).when(lamp, off + v % 3).otherwise(wall) + more).cast("int")
    return c.select("recording_id", "ms", "x", "y", tone((x * 7 + y * 13) % 9 + v % 5 + 100, 60, 175, 190).alias("r"), tone((x * 5 + y * 11) % 7 + v % 3 + 110, 150, 60, 130).alias("g"), tone((x * 3 + y * 17) % 8 + v % 4 + 95, 62, 70, 110).alias("b"))


def centres() -> str:
    x1, x2, y1, y2 = P.search_area(W, H, 0.45)
    places = [(r, x, y) for r in P.RADII for y in range(y1 + r, y2 - r + 1, max(2, r + 1)) for x in range(x1 + r, x2 - r + 1, max(2, r + 1))]
    return ", ".join(map(str, places))


def dist(a: str, b: str) -> str:
    return "sqrt(" + "+".join(f"({a}.{k}-{b}.{k})*({a}.{k}-{b}.{k})" for k in "rgb") + ")"


def colour(expr: str) -> str:
    return "{" + ", ".join(f"'{k}': CAST({expr.replace('@', k)} AS DOUBLE)" for k in "rgb") + "}"


def chroma(v: str) -> str:
    return f"(greatest({v}.r,{v}.g,{v}.b)-least({v}.r,{v}.g,{v}.b))"


def grey(v: str, k: str) -> str:
    return f"({v}.{k}-({v}.r+{v}.g+{v}.b)/3)"


HUE = f"({chroma('bef')}>=8 AND {chroma('aft')}>=8 AND ({'+'.join(grey('bef', k) + '*' + grey('aft', k) for k in 'rgb')})/(sqrt({'+'.join(grey('bef', k) + '*' + grey('bef', k) for k in 'rgb')})*sqrt({'+'.join(grey('aft', k) + '*' + grey('aft', k) for k in 'rgb')}))<=0.75)"
LUM = lambda v: f"({v}.r*0.2126::DOUBLE+{v}.g*0.7152::DOUBLE+{v}.b*0.0722::DOUBLE)"

PATCH_SQL = f"""WITH frm AS (SELECT user_id AS rec, ms, sum(CAST(floor(value*100+0.5) AS BIGINT))::BIGINT AS v FROM (SELECT *, CAST(floor((epoch_us(ts)-epoch_us(TIMESTAMP '2024-01-01'))/250000000.0) AS BIGINT) AS ms FROM events) GROUP BY 1,2),
c0 AS (SELECT rec, ms, v, x, y, abs(x-(2+rec%6))<=1 AND abs(y-(2+rec%4))<=1 AS lamp, rec%6<>0 AND ms>=(rec%5)*1000+4000 AND (rec%7<>0 OR ms<(rec%5)*1000+4500) AS lit, rec%5=1 AND ms BETWEEN 5000 AND 6999 AND x<8 AS cov, CASE WHEN rec%4=0 AND ms>3000 THEN 30 ELSE 0 END AS more FROM frm, range({W}) a(x), range({H}) b(y)),
cells AS MATERIALIZED (SELECT rec, ms, x, y, CASE WHEN cov THEN 190 WHEN lamp AND lit THEN 175+v%4 WHEN lamp THEN 60+v%3 ELSE (x*7+y*13)%9+v%5+100 END+more AS r, CASE WHEN cov THEN 130 WHEN lamp AND lit THEN 60+v%4 WHEN lamp THEN 150+v%3 ELSE (x*5+y*11)%7+v%3+110 END+more AS g, CASE WHEN cov THEN 110 WHEN lamp AND lit THEN 70+v%4 WHEN lamp THEN 62+v%3 ELSE (x*3+y*17)%8+v%4+95 END+more AS b FROM c0),
f0 AS (SELECT rec, ms, {colour('floor(avg(@)+0.5)')} AS av FROM cells GROUP BY 1,2), f1 AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY ms)-1 AS idx, count(*) OVER (PARTITION BY rec) AS n FROM f0),
f2 AS (SELECT *, least(8, greatest(4, floor(n*0.14))) AS bn FROM f1 WHERE n>=8), f3 AS (SELECT *, {colour('floor(avg(CASE WHEN idx<bn THEN av.@ END) OVER (PARTITION BY rec)+0.5)')} AS ab, first_value(av) OVER (PARTITION BY rec ORDER BY ms) AS a0 FROM f2),
k0 AS (SELECT *, {', '.join(f'{k}-first_value({k}) OVER q AS d{k}' for k in 'rgb')} FROM cells WINDOW q AS (PARTITION BY rec, x, y ORDER BY ms)),
ch AS (SELECT k0.rec, k0.ms, count(*) FILTER ({'+'.join(f'abs(d{k}-(av.{k}-a0.{k}))' for k in 'rgb')}>=84)/count(*) AS changed FROM k0 JOIN f3 ON f3.rec=k0.rec AND f3.ms=k0.ms GROUP BY 1,2),
ff AS MATERIALIZED (SELECT f3.rec, f3.ms, idx, n, bn, {dist('av', 'ab')}*0.95::DOUBLE AS ex, changed FROM f3 JOIN ch ON ch.rec=f3.rec AND ch.ms=f3.ms),
ctr(radius, cx, cy) AS (VALUES {centres()}),
pm AS (SELECT rec, ms, radius, cx, cy, {colour('floor(avg(@) FILTER (inn)+0.5)')} AS rgb, CASE WHEN count(*) FILTER (NOT inn) >= greatest(8, ((2*radius+7)*(2*radius+7)-(2*radius+1)*(2*radius+1))*0.5) THEN {colour('floor(avg(@) FILTER (NOT inn)+0.5)')} END AS around
 FROM (SELECT *, abs(x-cx)<=radius AND abs(y-cy)<=radius AS inn FROM cells, ctr WHERE abs(x-cx)<=radius+3 AND abs(y-cy)<=radius+3) GROUP BY rec, ms, radius, cx, cy),
p0 AS (SELECT pm.*, idx, n, bn, ex, changed FROM pm JOIN ff ON ff.rec=pm.rec AND ff.ms=pm.ms),
p1 AS (SELECT *, {colour('floor(avg(CASE WHEN idx<bn THEN rgb.@ END) OVER (PARTITION BY rec, radius, cx, cy)+0.5)')} AS bef FROM p0), p2 AS (SELECT *, {dist('rgb', 'bef')} AS d FROM p1),
p3 AS (SELECT *, quantile_cont(CASE WHEN idx<bn THEN d END, 0.5) OVER (PARTITION BY rec, radius, cx, cy) AS m FROM p2), p4 AS (SELECT *, quantile_cont(CASE WHEN idx<bn THEN abs(d-m) END, 0.5) OVER (PARTITION BY rec, radius, cx, cy) AS mad FROM p3),
p5 AS (SELECT *, greatest(8.0::DOUBLE, m+mad*4+4) AS thr, d-ex AS corr, changed<=0.26 AS still FROM p4), p6 AS (SELECT *, corr>=thr AND still AS lit, corr<thr*0.72::DOUBLE AS calm FROM p5),
p7 AS (SELECT *, coalesce(lag(calm) OVER o AND lag(calm,2) OVER o, false) AS quiet, count(*) OVER a AS k, count(*) FILTER (lit) OVER a AS c, count(*) FILTER (still) OVER a AS s, list({{'ms': ms, 'lit': lit, 'rgb': rgb, 'around': around}}) OVER a AS f FROM p6 WINDOW o AS (PARTITION BY rec, radius, cx, cy ORDER BY ms), a AS (PARTITION BY rec, radius, cx, cy ORDER BY ms RANGE BETWEEN CURRENT ROW AND 1600 FOLLOWING)),
p8 AS (SELECT *, list_filter(f, lambda q: q.ms >= f[-1].ms-620) AS e FROM p7 WHERE idx>=bn AND idx<n-3 AND lit AND quiet AND k>=4 AND c>=greatest(3, ceil(k*0.55)) AND s>=ceil(k*0.72)), p9 AS (SELECT *, list_filter(e, lambda q: q.lit) AS tl FROM p8),
pa AS (SELECT *, {colour('floor(list_sum(list_transform(tl, lambda q: q.rgb.@))/len(tl)+0.5)')} AS aft FROM p9 WHERE len(tl)>=2), pb AS (SELECT *, {dist('bef', 'aft')} AS delta FROM pa),
pc AS (SELECT *, list_filter(tl, lambda q: {dist('q.rgb', 'aft')} <= greatest(10.0, delta*0.42::DOUBLE)) AS sm, greatest(2, ceil(len(e)*0.55)) AS need FROM pb),
pd AS (SELECT *, len(list_filter(sm, lambda q: coalesce({dist('q.rgb', 'q.around')} >= greatest(4.0, least(10.0, delta*0.05::DOUBLE)), false))) >= need AS localized FROM pc WHERE delta>=thr*1.1::DOUBLE AND len(sm)>=need AND {LUM('aft')}/greatest(1.0, {LUM('bef')}) BETWEEN 0.55 AND 3.2 AND greatest(aft.r,aft.g,aft.b)>=45 AND {HUE}),
pe AS (SELECT *, delta+len(sm)*5+greatest(0.0, 18-abs(cx/{W}-0.45::DOUBLE)/0.45::DOUBLE*18)+greatest(0.0, {chroma('aft')}-{chroma('bef')})*0.3::DOUBLE-least(24.0, abs(ms/1000-7.0::DOUBLE)*4) AS score, row_number() OVER (PARTITION BY rec, radius, cx, cy ORDER BY idx) AS rn FROM pd),
pf AS (SELECT *, CASE WHEN NOT localized THEN 'Low' WHEN delta>=greatest(18.0, thr*1.65::DOUBLE) AND len(sm)>=3 THEN 'High' ELSE 'Medium' END AS confidence FROM pe WHERE rn=1)"""

FOUND_SQL = f"""{PATCH_SQL}, li AS (SELECT rec, list({{'o': -score, 'radius': radius, 'cy': cy, 'cx': cx, 'ms': ms, 'confidence': confidence, 'localized': localized, 'bef': bef, 'aft': aft, 'delta': delta}} ORDER BY -score, radius, cy, cx) AS items FROM pf GROUP BY rec),
kp AS (SELECT rec, list_reduce(list_transform(items, lambda q: [q]), lambda a, q: CASE WHEN len(a)>=8 OR len(list_filter(a, lambda e: sqrt(((e.cx-q[1].cx)/{W})*((e.cx-q[1].cx)/{W})+((e.cy-q[1].cy)/{H})*((e.cy-q[1].cy)/{H})) < 0.035))>0 THEN a ELSE list_concat(a, q) END) AS kept FROM li),
un AS (SELECT rec, len(kept) AS candidates, kept[1].o AS best, unnest(kept) AS q FROM kp), sel AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY q.ms, q.o, q.radius, q.cy, q.cx) AS rn FROM un WHERE -q.o >= -best*0.78::DOUBLE)
SELECT r.rec AS recording_id, q IS NOT NULL AS found, q.ms/1000 AS raw_time, coalesce(q.confidence, 'None') AS confidence, q.localized AS localized, floor(coalesce(-q.o, 0.0::DOUBLE)*1000+0.5)/1000 AS score, coalesce(candidates, 0)::INT AS candidates,
 least(greatest((q.cx-q.radius)/{W}, 0), 1) AS x1, least(greatest((q.cy-q.radius)/{H}, 0), 1) AS y1, least(greatest((q.cx+q.radius+1)/{W}, 0), 1) AS x2, least(greatest((q.cy+q.radius+1)/{H}, 0), 1) AS y2,
 {', '.join(f'q.bef.{k}::INT AS before_{k}' for k in 'rgb')}, {', '.join(f'q.aft.{k}::INT AS after_{k}' for k in 'rgb')}, floor(q.delta*1000+0.5)/1000 AS colour_delta
FROM (SELECT DISTINCT rec FROM frm) r LEFT JOIN (SELECT * FROM sel WHERE rn=1) s ON s.rec=r.rec"""


@query("wn39", FOUND_SQL)
def wn39(spark, sf):
    return P.discover_upper_light(grid_frames(spark, sf), W, H, 0.45, 7.0)


@query("wn39_patches", f"{PATCH_SQL} SELECT rec AS recording_id, radius, cx, cy, ms, floor(score*1000+0.5)/1000 AS score, confidence, localized, len(sm)::INT AS persistence FROM pf")
def wn39_patches(spark, sf):
    """Every patch that changed, before they are told apart."""
    return P.patch_changes(grid_frames(spark, sf), W, H, 0.45, 7.0).select("recording_id", "radius", "cx", "cy", "ms", (F.floor(F.col("score") * 1000 + 0.5) / 1000).alias("score"), "confidence", "localized", "persistence")
