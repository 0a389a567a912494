"""Queries over start evidence, lanes and start tones."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import audio as A
from ..operators import fusion as U
from ..operators import series as S
from . import series_roles as V
from .registry import query
from .roles import table
from .study import r6
from .series import SER


def evidence(spark, sf):
    """Every sample is one cue: kind, confidence and vote follow from its value."""
    s, v = V.samples(spark, sf), F.col("v")
    c = F.floor(v / 5) % 11
    kind = F.when(v % 5 <= 1, "color").when(v % 5 <= 3, "audio").otherwise("motion")
    return s.select("attempt_id", F.col("event_id").alias("ord"), kind.alias("kind"), "raw_time", F.when(c == 0, "High").when(c < 5, "Medium").when(c == 10, "None").otherwise("Low").alias("confidence"),
                    F.concat(kind, F.lit("-"), (v % 7).cast("string")).alias("label"), (v % 13 != 0).alias("vote_allowed"), (0.02 + (v % 3) * 0.02).alias("observation_interval_s"),
                    F.when(kind == "color", F.col("raw_time") + (v % 40) / 100.0).alias("blue_s"))


EVID = """evi AS (SELECT *, CASE confidence WHEN 'High' THEN 3.0::DOUBLE WHEN 'Medium' THEN 2.0 ELSE 0.75 END * CASE kind WHEN 'color' THEN 1.15::DOUBLE WHEN 'audio' THEN 1.0 ELSE 0.35 END AS w FROM (SELECT attempt_id, event_id AS ord, CASE WHEN v%5<=1 THEN 'color' WHEN v%5<=3 THEN 'audio' ELSE 'motion' END AS kind, raw_time, CASE WHEN (v//5)%11=0 THEN 'High' WHEN (v//5)%11<5 THEN 'Medium' WHEN (v//5)%11=10 THEN 'None' ELSE 'Low' END AS confidence,
 v%13<>0 AS ok, 0.02::DOUBLE+(v%3)*0.02::DOUBLE AS iv, CASE WHEN v%5<=1 THEN raw_time+(v%40)/100.0::DOUBLE END AS blue, CAST(floor(raw_time/0.6) AS BIGINT) AS cid FROM smp) WHERE confidence<>'None')"""


def binned(spark, sf):
    """Evidence with given clusters: bins of 0.6 s."""
    return U.usable_evidence(evidence(spark, sf)).withColumn("cluster_id", F.floor(F.col("raw_time") / 0.6))


TIER = {"a": "kind='audio' AND confidence='High'", "b": "kind='color' AND confidence IN ('High','Medium')", "c": "kind='audio' AND confidence IN ('High','Medium')", "d": "kind='color'", "e": "kind<>'motion'", "f": "true"}


def wtime(flag):
    return "coalesce(" + ", ".join(f"sum(w*raw_time) FILTER ({flag} AND {t})/sum(w) FILTER ({flag} AND {t})" for t in TIER.values()) + ")"


def winterval(flag):
    cases = []
    for t in TIER.values():
        f = f"{flag} AND {t}"
        cases.append(f"WHEN count(*) FILTER ({f})>0 THEN CASE WHEN bool_and(kind='color') FILTER ({f}) AND max(iv) FILTER ({f})+max(raw_time) FILTER ({f})-min(raw_time) FILTER ({f}) <= 2 THEN max(iv) FILTER ({f})+max(raw_time) FILTER ({f})-min(raw_time) FILTER ({f}) END")
    return "CASE " + " ".join(cases) + " END"


def sc(flag):
    return f"(coalesce(sum(w) FILTER ({flag}),0) + count(DISTINCT kind) FILTER ({flag} AND confidence<>'Low')*1.8 + greatest(0, count(*) FILTER ({flag} AND confidence<>'Low' AND kind='color')-1)*1.5)"


CONS = """nat AS (SELECT attempt_id, cid, ord, raw_time, blue, iv, row_number() OVER (PARTITION BY attempt_id, cid ORDER BY blue, raw_time, ord) AS i FROM evi WHERE kind='color' AND confidence IN ('High','Medium') AND ok AND blue>=raw_time),
nw AS (SELECT attempt_id, cid, count(*) AS n, least(0.2, greatest(0.1, max(iv*2))) AS win, max(raw_time)-min(raw_time) AS spread FROM nat GROUP BY 1,2 HAVING count(*)>=3), nv AS (SELECT * FROM nw WHERE spread > win+1e-9),
ng AS (SELECT a.attempt_id, a.cid, a.i, a.blue, v.win, v.n, count(b.ord) AS k FROM nat a JOIN nv v USING (attempt_id, cid) JOIN nat b ON b.attempt_id=a.attempt_id AND b.cid=a.cid AND b.i>=a.i AND b.blue-a.blue<=v.win+1e-9 GROUP BY ALL),
nt AS (SELECT attempt_id, cid, max(k) AS top, max(n) AS n FROM ng GROUP BY 1,2), na AS (SELECT t.attempt_id, t.cid, NOT (top > t.n/2 AND count(*)=1) AS ambiguous, min(g.i) AS li, min(g.blue) AS lb, min(win) AS win FROM nt t JOIN ng g ON g.attempt_id=t.attempt_id AND g.cid=t.cid AND g.k=t.top GROUP BY t.attempt_id, t.cid, top, t.n),
won AS (SELECT n.* FROM nat n JOIN na USING (attempt_id, cid) WHERE NOT ambiguous AND n.i>=li AND n.blue-lb<=win+1e-9), outl AS (SELECT n.attempt_id, n.cid, n.ord FROM nat n JOIN na USING (attempt_id, cid) WHERE NOT ambiguous AND NOT EXISTS (SELECT 1 FROM won w WHERE w.attempt_id=n.attempt_id AND w.cid=n.cid AND (w.ord=n.ord OR abs(w.raw_time-n.raw_time) <= win+1e-9)))"""
FUSE = f"""{V.SAMPLES}, {EVID}, {CONS}, cl AS (SELECT attempt_id, cid, {sc('true')} AS score, {sc('ok')} AS es, bool_or(kind='audio' AND confidence='High') AS ha, bool_or(kind='audio' AND confidence='High' AND ok) AS oha, bool_or(confidence='High') AS hh, bool_or(ok AND kind<>'motion') AS okc, bool_or(NOT ok) AS bl, min(raw_time) AS born, {wtime('true')} AS centre FROM evi GROUP BY 1,2),
c1 AS (SELECT *, row_number() OVER (PARTITION BY attempt_id ORDER BY score DESC, born) AS rk, first_value(CASE WHEN ha THEN cid END) OVER (PARTITION BY attempt_id ORDER BY CASE WHEN ha THEN 0 ELSE 1 END, born) AS af FROM cl),
c2 AS (SELECT *, coalesce(af, max(CASE WHEN rk=1 THEN cid END) OVER (PARTITION BY attempt_id)) AS orig FROM c1), c3 AS (SELECT *, bool_or(cid=orig AND NOT oha AND bl) OVER (PARTITION BY attempt_id) AS rethink, first_value(CASE WHEN okc THEN cid END) OVER (PARTITION BY attempt_id ORDER BY CASE WHEN okc THEN 0 ELSE 1 END, CASE WHEN oha THEN 0 ELSE 1 END, es DESC, rk) AS alt FROM c2),
c4 AS (SELECT *, CASE WHEN rethink THEN coalesce(alt,orig) ELSE orig END AS best FROM c3), c5 AS (SELECT *, max(CASE WHEN cid=best THEN score END) OVER (PARTITION BY attempt_id) AS bs, max(CASE WHEN cid=best THEN centre END) OVER (PARTITION BY attempt_id) AS bc FROM c4),
bst AS (SELECT attempt_id, max(best) AS cid, max(orig) AS orig, bool_or(cid<>best AND hh AND score>=bs*0.78 AND abs(centre-bc)>0.38) AS rival, count(*) AS clusters FROM c5 GROUP BY 1),
i1 AS (SELECT e.*, b.orig, b.rival, b.clusters, bool_or(kind='audio' AND confidence='High' AND ok) OVER (PARTITION BY e.attempt_id) AS ac, o.ord IS NOT NULL AS isout, coalesce(na.ambiguous,false) AS amb FROM evi e JOIN bst b ON b.attempt_id=e.attempt_id AND b.cid=e.cid LEFT JOIN outl o ON o.attempt_id=e.attempt_id AND o.ord=e.ord LEFT JOIN na ON na.attempt_id=e.attempt_id AND na.cid=e.cid),
i2 AS (SELECT *, NOT (isout AND NOT ac) AS vis, NOT (isout AND NOT ac) AND ok AS el FROM i1), i3 AS (SELECT *, CASE WHEN bool_or(el AND kind<>'motion') OVER (PARTITION BY attempt_id) THEN el ELSE vis END AS sup FROM i2),
fq AS (SELECT attempt_id, max(cid)<>max(orig) AS changed, bool_or(rival) AS rival, max(clusters) AS clusters, count(*) FILTER (el AND kind='color' AND confidence<>'Low') AS cc, bool_or(el AND kind='audio' AND confidence<>'Low') AS sa, bool_or(el AND kind='motion' AND confidence<>'Low') AS sm, bool_or(el AND kind='motion') AS m,
  arg_min(confidence, raw_time) FILTER (el AND kind='color') AS c1, arg_min(confidence, raw_time) FILTER (el AND kind='audio') AS a1, bool_or(el AND kind='audio' AND confidence='High') AS eha, bool_or(ac) AS ac, bool_or(amb) AS amb FROM i3 GROUP BY 1),
fr AS (SELECT *, rival OR (amb AND NOT ac AND NOT eha) AS conflict, CASE WHEN cc>=1 AND sa THEN 'High' WHEN cc>=2 THEN 'High' WHEN cc>=1 AND m THEN 'Medium' WHEN cc>=1 THEN c1 WHEN sa AND a1='High' THEN 'High' WHEN sa AND sm THEN 'Medium' WHEN sa THEN a1 ELSE 'Low' END AS cf FROM fq),
fs AS (SELECT *, (CASE WHEN (cc>=1 AND sa) OR cc>=2 THEN true WHEN cc>=1 THEN cf='High' WHEN sa THEN a1='High' ELSE false END) AND NOT conflict AND NOT changed AS auto_accept, CASE WHEN changed AND cf='High' THEN 'Medium' ELSE cf END AS confidence FROM fr),
i4 AS (SELECT i3.*, CASE WHEN fs.auto_accept THEN el ELSE sup END AS us FROM i3 JOIN fs USING (attempt_id)), tm AS (SELECT attempt_id, count(*) FILTER (sup) AS supporting, {wtime('us')} AS t, {winterval('us')} AS iv FROM i4 GROUP BY 1),
fused AS (SELECT fs.attempt_id, floor(t*1000+0.5)/1000 AS raw_time, confidence, auto_accept, conflict, supporting, clusters, {r6('iv')} AS observation_interval_s FROM fs JOIN tm USING (attempt_id))"""


@query("wn48")
def wn48(spark, sf):
    return U.cluster_evidence(evidence(spark, sf)).select("attempt_id", "ord", "raw_time", "cluster_id")


@query("wn49", f"WITH {FUSE} SELECT * FROM fused")
def wn49(spark, sf):
    return U.fuse(binned(spark, sf))


@query("wn49_live")
def wn49_live(spark, sf):
    """Clustering and decision together."""
    return U.fuse(U.cluster_evidence(evidence(spark, sf)))


@query("wn50", f"WITH {V.SAMPLES}, {EVID}, {CONS}, oc AS (SELECT attempt_id, cid, count(*) AS k FROM outl GROUP BY 1,2) SELECT na.attempt_id, na.cid AS cluster_id, ambiguous, coalesce(k,0) AS n_outliers FROM na LEFT JOIN oc ON oc.attempt_id=na.attempt_id AND oc.cid=na.cid")
def wn50(spark, sf):
    c = U.visual_consensus(binned(spark, sf))
    return c.select("attempt_id", "cluster_id", "ambiguous", F.size("outliers").cast("bigint").alias("n_outliers"))


@query("fn24", f"WITH {V.SAMPLES}, {EVID} SELECT attempt_id, ord, {r6('w')} AS weight FROM evi")
def fn24(spark, sf):
    return U.usable_evidence(evidence(spark, sf)).select("attempt_id", "ord", X.round_us(U.evidence_weight()).alias("weight"))


def decisions(spark, sf):
    v = F.col("v")
    d = V.samples(spark, sf).where("ms >= 3000").groupBy("attempt_id").agg(F.min(F.struct("raw_time", "v")).alias("x"))
    return d.select("attempt_id", F.col("x.raw_time").alias("raw_time"), F.when(F.col("x.v") % 3 == 0, "High").when(F.col("x.v") % 3 == 1, "Medium").otherwise("Low").alias("confidence"), (F.col("x.v") % 2 == 0).alias("auto_accept"))


@query("prj29", f"""WITH {V.SAMPLES}, d AS (SELECT attempt_id, min(raw_time) AS raw_time, arg_min(v, raw_time) AS v FROM smp WHERE ms>=3000 GROUP BY 1), n AS (SELECT d.attempt_id, coalesce(bool_or(s.raw_time>=0 AND abs(s.raw_time-d.raw_time)<=0.38+1e-9),false) AS near_cut FROM d LEFT JOIN smp s ON s.attempt_id=d.attempt_id AND s.motion_score>12 GROUP BY 1)
 SELECT d.attempt_id, d.raw_time, CASE WHEN near_cut AND v%3=0 THEN 'Medium' WHEN v%3=0 THEN 'High' WHEN v%3=1 THEN 'Medium' ELSE 'Low' END AS confidence, v%2=0 AND NOT near_cut AS auto_accept, near_cut FROM d JOIN n USING (attempt_id)""")
def prj29(spark, sf):
    cuts = V.samples(spark, sf).where("motion_score > 12").select("attempt_id", F.col("raw_time").alias("cut_s"))
    return U.require_continuous_scene(decisions(spark, sf), cuts)


@query("prj25", f"""WITH {SER}, p AS (SELECT attempt_id, max(raw_time) AS proposed_s, arg_max(idx, raw_time) AS k, arg_max(smoothed, raw_time) AS q FROM ser WHERE raw_time <= 5 GROUP BY 1), pm AS (SELECT p.attempt_id, coalesce(bool_or(s.raw_time<proposed_s AND s.raw_time>=proposed_s-0.15 AND s.smoothed>=s.thr),false) AS pre FROM p LEFT JOIN ser s ON s.attempt_id=p.attempt_id GROUP BY 1),
 x AS (SELECT p.attempt_id, proposed_s, pre, k%7=0 AS uw, k%5<>0 AS det, proposed_s + (k%12-2)/10.0::DOUBLE AS mv, CASE WHEN k%4=0 THEN 'Low' ELSE 'High' END AS cf, k%9=0 AS ff, (proposed_s + (k%12-2)/10.0::DOUBLE)-proposed_s AS d FROM p JOIN pm USING (attempt_id)),
 r AS (SELECT *, CASE WHEN pre THEN 'motion-just-before' WHEN uw THEN 'already-underway' WHEN NOT det OR cf='Low' THEN 'no-reliable-launch' WHEN d>=-0.02 AND d<0.1-1e-6 THEN 'delay-too-short' WHEN d<0 THEN 'moved-before' WHEN d>0.75 THEN 'moved-too-late' WHEN ff THEN 'first-sample-strong' END AS reason FROM x) SELECT attempt_id, proposed_s, reason, reason IS NULL AS safe FROM r""")
def prj25(spark, sf):
    s = S.motion_series(V.samples(spark, sf), "medium")
    p = s.where("raw_time <= 5").groupBy("attempt_id").agg(F.max(F.struct("raw_time", "idx")).alias("x")).select("attempt_id", F.col("x.raw_time").alias("proposed_s"), F.col("x.idx").alias("k"))
    m = U.pre_motion(s, p.select("attempt_id", "proposed_s")).join(p, ["attempt_id", "proposed_s"])
    k = F.col("k")
    m = m.withColumns({"underway": k % 7 == 0, "detected": k % 5 != 0, "movement_s": F.col("proposed_s") + (k % 12 - 2) / 10.0, "confidence": F.when(k % 4 == 0, "Low").otherwise("High"), "first_frame": k % 9 == 0})
    return U.body_audit(m).select("attempt_id", "proposed_s", "reason", "safe")


# --- lanes ------------------------------------------------------------------------------------

def lanes(spark, sf):
    """Every order line is a candidate patch; patches of an order are numbered by line, part and the rest."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
    li = table(spark, sf, "lineitem").select("l_orderkey", F.row_number().over(w).alias("ord"), F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag").alias("m"))
    x, y = (F.col("m.l_partkey") % 80) / 100.0, (F.col("m.l_suppkey") % 90) / 100.0
    zone = F.struct(x.alias("x1"), y.alias("y1"), (x + 0.05).alias("x2"), (y + 0.05).alias("y2"))
    k = F.col("l_orderkey")
    return li.select(k.alias("attempt_id"), F.col("ord").cast("int").alias("ord"), zone.alias("zone"), F.col("m.l_extendedprice").alias("score"), (F.col("m.l_quantity") / 10).alias("start_s"),
                     F.when(k % 3 == 0, F.struct(F.lit(0.1).alias("x1"), F.lit(0.6).alias("x2"))).alias("body"), F.concat(F.lit("lane-"), (F.col("m.l_partkey") % 5).cast("string")).alias("label"),
                     F.when(F.col("m.l_returnflag") == "A", "High").when(F.col("m.l_returnflag") == "N", "Medium").otherwise("Low").alias("confidence"), (F.col("m.l_suppkey") % 9 != 0).alias("vote_allowed"))


LANES = """ln AS (SELECT l_orderkey AS attempt_id, rn AS ord, (l_partkey%80)/100.0::DOUBLE AS x1, (l_suppkey%90)/100.0::DOUBLE AS y1, (l_partkey%80)/100.0::DOUBLE+0.05::DOUBLE AS x2, (l_suppkey%90)/100.0::DOUBLE+0.05::DOUBLE AS y2, l_extendedprice AS score, l_quantity/10 AS start_s, 'lane-'||(l_partkey%5) AS label,
 CASE l_returnflag WHEN 'A' THEN 'High' WHEN 'N' THEN 'Medium' ELSE 'Low' END AS confidence, l_suppkey%9<>0 AS vote FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag) AS rn FROM lineitem))"""


@query("fn14", f"WITH {LANES} SELECT attempt_id, CAST(ord AS INTEGER) AS ord, printf('light:%.6f:%.6f:%.6f:%.6f', x1, y1, x2, y2) AS lane_id FROM ln")
def fn14(spark, sf):
    return lanes(spark, sf).select("attempt_id", "ord", U.patch_id().alias("lane_id"))


# the merge keeps state from lane to lane; with at most seven lanes it unrolls into a recursion over their order
POOL = f"""WITH RECURSIVE {LANES}, okl AS (SELECT *, row_number() OVER (PARTITION BY attempt_id ORDER BY ord) AS i FROM ln WHERE attempt_id%3<>0 OR (x1+x2)/2 BETWEEN 0.1-0.035 AND 0.6+0.035),
fold AS (SELECT attempt_id, i, [struct_pack(o:=ord, x:=(x1+x2)/2, y:=(y1+y2)/2)] AS kept FROM okl WHERE i=1 UNION ALL SELECT f.attempt_id, o.i, CASE WHEN len(list_filter(f.kept, lambda k: sqrt(power((o.x1+o.x2)/2-k.x,2)+power((o.y1+o.y2)/2-k.y,2)) < 0.035))>0 THEN f.kept ELSE list_append(f.kept, struct_pack(o:=o.ord, x:=(o.x1+o.x2)/2, y:=(o.y1+o.y2)/2)) END FROM fold f JOIN okl o ON o.attempt_id=f.attempt_id AND o.i=f.i+1),
pool AS (SELECT attempt_id, arg_max(kept, i) AS kept FROM fold GROUP BY 1)"""


@query("jn19", POOL + ", u AS (SELECT attempt_id, unnest(kept) AS k FROM pool) SELECT attempt_id, CAST(k.o AS INTEGER) AS ord FROM u")
def jn19(spark, sf):
    return U.lane_pool(lanes(spark, sf)).select("attempt_id", F.explode("pool").alias("p")).select("attempt_id", "p.ord")


@query("top6", POOL + ", u AS (SELECT attempt_id, len(kept) AS pool_size, unnest(kept[1:3]) AS k, generate_subscripts(kept[1:3], 1) AS place FROM pool) SELECT attempt_id, CAST(pool_size AS INTEGER) AS pool_size, CAST(place-1 AS INTEGER) AS place, CAST(k.o AS INTEGER) AS ord FROM u")
def top6(spark, sf):
    return U.scan_budget(U.lane_pool(lanes(spark, sf))).select("attempt_id", "pool_size", "place", "ord")


@query("top10", POOL + ", u AS (SELECT attempt_id, unnest(kept) AS k, generate_subscripts(kept, 1)-1 AS place FROM pool) SELECT attempt_id, CAST(k.o AS INTEGER) AS ord, CAST(row_number() OVER (PARTITION BY attempt_id ORDER BY CASE WHEN k.o=4 THEN 0 ELSE 1 END, place)-1 AS INTEGER) AS new_place FROM u")
def top10(spark, sf):
    p = U.lane_pool(lanes(spark, sf)).select("attempt_id", F.posexplode("pool").alias("place", "c")).select("attempt_id", "place", "c.ord", (F.col("c.ord") == 4).alias("selected"))
    return U.reorder_lanes(p).select("attempt_id", "ord", "new_place")


@query("jn17", POOL + """, u AS (SELECT attempt_id, k.o AS o, k.x AS x FROM (SELECT attempt_id, unnest(kept) AS k FROM pool)), b AS (SELECT *, CASE WHEN x>=0.5 THEN greatest(0.5,x-0.2) ELSE greatest(0,x-0.23) END - 0.035 AS lo, CASE WHEN x>=0.5 THEN least(1,x+0.23) ELSE least(0.5,x+0.2) END + 0.035 AS hi FROM u)
 SELECT a.attempt_id, CAST((SELECT count(*) FROM b c WHERE c.attempt_id=a.attempt_id) AS INTEGER) AS lanes, CAST(count(*) FILTER (b2.o IS NOT NULL AND NOT (b2.x BETWEEN a.lo AND a.hi AND a.x BETWEEN b2.lo AND b2.hi)) AS INTEGER) AS conflicts, count(*) FILTER (b2.o IS NOT NULL AND NOT (b2.x BETWEEN a.lo AND a.hi AND a.x BETWEEN b2.lo AND b2.hi))>0 AS needs_selection
 FROM b a LEFT JOIN b b2 ON b2.attempt_id=a.attempt_id AND b2.o>a.o GROUP BY a.attempt_id""")
def jn17(spark, sf):
    return U.lane_conflicts(U.lane_pool(lanes(spark, sf)))


@query("jn18", f"""WITH {LANES}, d AS (SELECT o_orderkey AS attempt_id, (o_custkey%50)/10.0::DOUBLE AS t, o_custkey%3=0 AS ac, CASE WHEN o_custkey%4=0 THEN (o_custkey%50)/10.0::DOUBLE+0.2::DOUBLE END AS hint, 'lane-'||(o_custkey%5) AS l1 FROM orders),
 j AS (SELECT ln.*, d.t, ac, hint, label=l1 AS seed, confidence<>'Low' AS rel, printf('light:%.6f:%.6f:%.6f:%.6f', x1, y1, x2, y2) AS lane_id FROM ln JOIN d ON d.attempt_id=ln.attempt_id WHERE vote), k AS (SELECT *, bool_or(seed AND rel) OVER (PARTITION BY attempt_id) AS have, CASE confidence WHEN 'High' THEN 3.0::DOUBLE WHEN 'Medium' THEN 2.0 ELSE 0.75 END AS w FROM j),
 m AS (SELECT *, CASE WHEN abs(hint-t)<=0.38 THEN hint ELSE coalesce(sum(CASE WHEN seed AND (rel OR NOT have) THEN start_s*w END) OVER (PARTITION BY attempt_id)/sum(CASE WHEN seed AND (rel OR NOT have) THEN w END) OVER (PARTITION BY attempt_id), t) END AS a FROM k),
 f AS (SELECT *, row_number() OVER (PARTITION BY attempt_id ORDER BY abs(start_s-a), score DESC, lane_id) AS place FROM m WHERE (seed OR (confidence<>'Low' AND abs(start_s-a)<=0.35)) AND (NOT ac OR confidence<>'Low')) SELECT attempt_id, lane_id, CAST(place AS INTEGER) AS place, {r6('a')} AS association_s, place=1 AS selected FROM f""")
def jn18(spark, sf):
    c = F.col("o_custkey")
    d = table(spark, sf, "orders").select(F.col("o_orderkey").alias("attempt_id"), ((c % 50) / 10.0).alias("raw_time"), (c % 3 == 0).alias("audio_clock"), F.when(c % 4 == 0, (c % 50) / 10.0 + 0.2).alias("hint_s"), F.array(F.concat(F.lit("lane-"), (c % 5).cast("string"))).alias("labels"))
    return U.associate_lanes(lanes(spark, sf).withColumn("lane_id", U.patch_id()), d)


@query("fn26", """SELECT o_orderkey, CASE WHEN o_orderkey%7<>0 AND o_custkey%11<>0 THEN sha256('{"source":"s'||o_custkey||'","start":'||(o_custkey%11)||',"zone":'||CASE WHEN o_orderkey%2=0 THEN '{"x1":1}' ELSE 'null' END||'}') END AS context_key FROM orders""")
def fn26(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = table(spark, sf, "orders").select(k, F.when(k % 7 != 0, F.concat(F.lit("s"), c.cast("string"))).alias("src"), F.when(c % 11 != 0, c % 11).alias("st"), F.when(k % 2 == 0, F.struct(F.lit(1).alias("x1"))).alias("z"))
    ok = X.nonempty("src") & (F.col("st") >= 0)
    return o.select("o_orderkey", F.when(X.truthy(ok), U.run_context("src", "st", "z")).alias("context_key"))


# --- audio ------------------------------------------------------------------------------------

def features(spark, sf):
    """Samples as audio frames: loudness from the value, pitch by the second."""
    s, v = V.samples(spark, sf), F.col("v")
    sec = F.floor(F.col("raw_time"))
    f = s.select("attempt_id", F.col("raw_time").alias("t"), (v / 40000.0).alias("rms"), ((v % 100) / 100.0).alias("tonality"), F.when(v % 9 != 0, F.when(sec % 4 == 3, 1108.0).otherwise(554.0) + v % 7).alias("frequency"),
                 ((v % 40) * 1.0).alias("prominence_db"), ((v % 30) / 100.0).alias("concentration"), F.lit(0.1).alias("amplitude"))
    return S.loudness_thresholds(f, ["attempt_id"])


@query("wn40")
def wn40(spark, sf):
    return A.usable_tones(A.merge_tones(A.tone_segments(features(spark, sf))))


def tones(spark, sf):
    """Samples as tones with pitches that form the start pattern now and then."""
    s, v = V.samples(spark, sf), F.col("v")
    return s.select("attempt_id", F.col("raw_time").alias("start_s"), (0.05 + (v % 10) / 50.0).alias("duration_s"), (F.when(v % 4 == 0, 1108.0).otherwise(554.0) + v % 20).alias("frequency"), (v % 150).cast("double").alias("stability_cents"),
                    (0.3 + (v % 60) / 100.0).alias("tonality"), (8.0 + v % 40).alias("prominence_db"), (v % 12).alias("qualified"), (v / 10000.0).alias("peak_rms"))


TONES = """tn AS (SELECT attempt_id, raw_time AS start_s, 0.05::DOUBLE+(v%10)/50.0::DOUBLE AS duration_s, CASE WHEN v%4=0 THEN 1108.0::DOUBLE ELSE 554.0::DOUBLE END + v%20 AS frequency, v%150 AS st, 0.3::DOUBLE+(v%60)/100.0::DOUBLE AS tonality, 8.0::DOUBLE+v%40 AS prom, v%12 AS q, v/10000.0::DOUBLE AS peak_rms FROM smp)"""
PAT = f"""{V.SAMPLES}, {TONES}, tq AS (SELECT * FROM tn WHERE st<=140 AND q>=4), t3 AS (SELECT a.attempt_id, a.start_s AS a_s, b.start_s AS b_s, c.start_s AS c_s, a.frequency AS fa, b.frequency AS fb, c.frequency AS fc, a.duration_s AS da, b.duration_s AS db, a.q AS qa, b.q AS qb, (a.tonality+b.tonality+c.tonality)/3 AS ton, (a.prom+b.prom+c.prom)/3 AS pr, b.start_s-a.start_s AS g1, c.start_s-b.start_s AS g2
 FROM tq a JOIN tq b ON b.attempt_id=a.attempt_id AND b.start_s-a.start_s BETWEEN 0.25 AND 1.5 JOIN tq c ON c.attempt_id=b.attempt_id AND c.start_s-b.start_s BETWEEN 0.25 AND 1.5),
t4 AS (SELECT *, abs(fa-fb)/greatest(fa,fb) AS se, abs(fc-(fa+fb)/2)/greatest(fc,(fa+fb)/2) AS fd, fc/((fa+fb)/2) AS fr, abs(g1-g2)/2/((g1+g2)/2) AS sp, abs(da-db)/2/((da+db)/2) AS ds FROM t3 WHERE abs(g1-g2)<=greatest(0.12,(g1+g2)/2*0.2)),
t5 AS (SELECT *, ton*30+least(pr,40)*1.5+fd*80-se*100-sp*45-ds*15 AS score, fr BETWEEN 1.8 AND 2.2 AND se<=0.08 AND (fa+fb)/2 BETWEEN 480 AND 650 AND g1 BETWEEN 0.7 AND 1.3 AND g2 BETWEEN 0.7 AND 1.3 AS official FROM t4 WHERE se<=0.12 AND fd>=0.13 AND sp<=0.2 AND ds<=0.65 AND ton>=0.38 AND pr>=12),
t6 AS (SELECT *, se<=0.04 AND least(qa,qb)>=6 AND least(da,db)>=0.08 AND fd>=0.18 AND official AND 1-sp>=0.72 AS strong, row_number() OVER (PARTITION BY attempt_id ORDER BY CASE WHEN official THEN 0 ELSE 1 END, CASE WHEN official THEN c_s ELSE 0 END, score DESC, a_s, b_s, c_s) AS rn FROM t5), pat AS (SELECT * FROM t6 WHERE rn=1)"""


@query("wn43", f"WITH {PAT} SELECT attempt_id, a_s AS a_start_s, b_s AS b_start_s, c_s AS c_start_s, {r6('score')} AS score, official, strong FROM pat")
def wn43(spark, sf):
    return A.tone_patterns(tones(spark, sf)).select("attempt_id", "a_start_s", "b_start_s", "c_start_s", X.round_us("score").alias("score"), "official", "strong")


CD = f"""cd0 AS (SELECT attempt_id, start_s, duration_s, tonality, peak_rms, row_number() OVER (PARTITION BY attempt_id ORDER BY start_s) AS i FROM tn), cd1 AS (SELECT a.attempt_id, n, a.i, a.start_s AS final_s, a.peak_rms AS frms, b.i AS bi, b.start_s AS bs, b.duration_s AS bd, b.tonality AS bt, b.peak_rms AS br, lag(b.start_s) OVER (PARTITION BY a.attempt_id, n, a.i ORDER BY b.i) AS ps
 FROM cd0 a CROSS JOIN (SELECT unnest([3,4,5]) AS n) JOIN cd0 b ON b.attempt_id=a.attempt_id AND b.i>a.i-n AND b.i<=a.i WHERE a.i>=n),
cd2 AS (SELECT attempt_id, n, i, max(final_s) AS final_s, max(frms) AS frms, avg(bs-ps) AS m, stddev_pop(bs-ps) AS sdv, avg(bd) FILTER (bi<i) AS dm, stddev_pop(bd) FILTER (bi<i) AS dsd, avg(bt) AS ton, avg(br) AS rms, avg(br) FILTER (bi<i) AS er FROM cd1 GROUP BY 1,2,3),
cd3 AS (SELECT *, n*30+ton*35-sdv/m*45-dsd/dm*15+least(20,rms*120)+least(12,frms/greatest(er,1e-6)*4) AS score FROM cd2 WHERE m BETWEEN 0.14 AND 1.6 AND sdv/m<=0.34 AND dsd/dm<=0.65 AND ton>=0.34), cdn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY attempt_id ORDER BY score DESC, n DESC, final_s) AS rn FROM cd3) WHERE rn=1)"""


@query("wn44", f"WITH {V.SAMPLES}, {TONES}, {CD} SELECT attempt_id, final_s, CAST(n AS INTEGER) AS n, {r6('score')} AS score FROM cdn")
def wn44(spark, sf):
    return A.countdowns(tones(spark, sf)).withColumn("score", X.round_us("score"))


LONE = """lt AS (SELECT *, row_number() OVER (PARTITION BY attempt_id ORDER BY CASE WHEN duration_s BETWEEN 0.05 AND 1.4 AND tonality>=0.42 AND peak_rms>=0.05*1.3 THEN 0 ELSE 1 END, peak_rms DESC, start_s) AS rn FROM tn), lone AS (SELECT a.attempt_id, a.start_s FROM lt a WHERE rn=1 AND duration_s BETWEEN 0.05 AND 1.4 AND tonality>=0.42 AND peak_rms>=0.05*1.3 AND coalesce((SELECT max(peak_rms) FROM tn b WHERE b.attempt_id=a.attempt_id AND b.start_s<>a.start_s),0)*1.8 <= peak_rms)"""


@query("wn44_lone", f"WITH {V.SAMPLES}, {TONES}, {LONE} SELECT * FROM lone")
def wn44_lone(spark, sf):
    t = tones(spark, sf)
    return A.lone_tone(t, t.select("attempt_id").distinct().withColumn("threshold", F.lit(0.05)))


VERD = f"{PAT}, {CD}, {LONE}"


@query("wn45", f"""WITH {VERD}, al AS (SELECT DISTINCT attempt_id FROM smp) SELECT al.attempt_id, coalesce(p.c_s, c.final_s, l.start_s) IS NOT NULL AS found, coalesce(p.c_s, c.final_s, l.start_s) AS raw_time, CASE WHEN p.c_s IS NOT NULL THEN CASE WHEN strong THEN 'High' ELSE 'Medium' END WHEN coalesce(c.final_s,l.start_s) IS NOT NULL THEN 'Low' ELSE 'None' END AS confidence,
 CASE WHEN p.c_s IS NOT NULL THEN 'two-same-then-different' WHEN c.final_s IS NOT NULL THEN 'regular-countdown' WHEN l.start_s IS NOT NULL THEN 'single-prominent-beep' END AS pattern, CASE WHEN official THEN p.c_s END AS search_hint_s FROM al LEFT JOIN pat p ON p.attempt_id=al.attempt_id LEFT JOIN cdn c ON c.attempt_id=al.attempt_id LEFT JOIN lone l ON l.attempt_id=al.attempt_id""")
def wn45(spark, sf):
    t = tones(spark, sf)
    al = t.select("attempt_id").distinct()
    return A.verdict(al, A.tone_patterns(t), A.countdowns(t), A.lone_tone(t, al.withColumn("threshold", F.lit(0.05))))


@query("wn46", f"""WITH {PAT}, m AS (SELECT DISTINCT attempt_id, 1.5::DOUBLE AS raw_time, CASE WHEN attempt_id%4=0 THEN 'High' ELSE 'Medium' END AS confidence FROM smp), r AS (SELECT attempt_id, c_s + (attempt_id%5)*0.012::DOUBLE AS r1, c_s AS r0 FROM pat WHERE strong AND attempt_id%7<>0 AND (attempt_id%5)*0.012::DOUBLE <= 0.04+1e-9 AND (attempt_id%5)*0.012::DOUBLE < 0.05)
 SELECT m.attempt_id, CASE WHEN r0 IS NOT NULL AND confidence<>'High' THEN least(r0,r1) ELSE raw_time END AS raw_time, CASE WHEN r0 IS NOT NULL THEN 'High' ELSE confidence END AS confidence, CAST(CASE WHEN r0 IS NOT NULL AND confidence<>'High' THEN 0 END AS INTEGER) AS recovered_channel FROM m LEFT JOIN r USING (attempt_id)""")
def wn46(spark, sf):
    t = tones(spark, sf)
    p = A.tone_patterns(t)
    a = F.col("attempt_id")
    shift = (a % 5) * 0.012

    def channel(c, d):
        tone = lambda k: F.struct((F.col(f"{k}_start_s") + d).alias("start_s"), (F.col(f"{k}_start_s") + d + 0.05).alias("end_s"), (F.col(f"{k}_frequency") * F.when((a % 7 == 0) & F.lit(c == 1), 1.2).otherwise(1.0)).alias("frequency"))
        return p.select("attempt_id", F.lit(c).alias("channel"), "strong", F.array(tone("a"), tone("b"), tone("c")).alias("tones"), (F.col("c_start_s") + d).alias("raw_time"))
    mixed = t.select("attempt_id").distinct().select("attempt_id", F.lit(1.5).alias("raw_time"), F.when(a % 4 == 0, "High").otherwise("Medium").alias("confidence"))
    return A.reconcile_channels(mixed, channel(0, F.lit(0.0)).unionByName(channel(1, shift)))


@query("wn54")
def wn54(spark, sf):
    """Documents as recordings: the code of each character is one sample; chunks overlap by one frame less a hop."""
    d = table(spark, sf, "documents").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")  # a few splits of a file hold hours of sound
    step, size = 8000, 8000 + 80
    n = F.floor((F.length("text") - 1) / step)
    c = d.select(F.col("doc_id").alias("recording_id"), F.lit(0).alias("channel"), "text", F.explode(F.sequence(F.lit(0).cast("bigint"), n)).alias("k"))
    part = F.substring(F.col("text"), F.col("k") * step + 1, F.lit(size))
    codes = F.transform(F.split(part, ""), lambda ch: (F.ascii(ch) - 100) / 128.0)
    return A.frame_features(c.select("recording_id", "channel", (F.col("k") * (step / A.RATE)).alias("chunk_start_s"), codes.alias("samples")))
