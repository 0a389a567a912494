"""Start evidence: clustering, fusion decision, lane association, safety gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X

AGREE_S = 0.38
LANE_MARGIN, LANE_MERGE = 0.035, 0.035


def evidence_weight(kind="kind", confidence="confidence") -> Column:
    """FN24."""
    c = F.when(X.c(confidence) == "High", 3.0).when(X.c(confidence) == "Medium", 2.0).otherwise(0.75)
    return c * F.when(X.c(kind) == "color", 1.15).when(X.c(kind) == "audio", 1.0).otherwise(0.35)


#: Parts of a weight: scores are added up as whole numbers, which have one sum in whatever order they come.
WEIGHT_PARTS = 10_000


def whole_weight() -> Column:
    return F.floor(F.col("_w") * WEIGHT_PARTS + 0.5).cast("bigint")


def _tiers(kind: Column, conf: Column) -> list[Column]:
    """Which items may set a cluster's clock, best tier first; the first tier that is present decides."""
    return [(kind == "audio") & (conf == "High"), (kind == "color") & conf.isin("High", "Medium"), (kind == "audio") & conf.isin("High", "Medium"), kind == "color", kind != "motion", F.lit(True)]


N_TIERS = 6


def usable_evidence(ev: DataFrame) -> DataFrame:
    return ev.where((X.finite("raw_time") >= 0) & (F.col("confidence") != "None"))


def cluster_evidence(ev: DataFrame) -> DataFrame:
    """WN48: in time order an item joins the first cluster whose weighted time is within 0.38 s.

    The weighted time moves with every member, so items are folded.  A cluster's time never exceeds its
    latest member, hence a step of more than 0.38 s starts afresh and the fold runs per such stretch.
    """
    w = Window.partitionBy("attempt_id").orderBy("raw_time", "ord")
    u = usable_evidence(ev).withColumn("_w", evidence_weight())
    u = u.withColumn("_new", F.coalesce(F.col("raw_time") - F.lag("raw_time").over(w) > AGREE_S, F.lit(True))).withColumn("_part", F.sum(F.col("_new").cast("int")).over(w))
    tiers = F.array(*[F.when(t, F.col("_w")).otherwise(0.0) for t in _tiers(F.col("kind"), F.col("confidence"))])
    item = F.struct("raw_time", "ord", tiers.alias("tw"))
    parts = u.groupBy("attempt_id", "_part").agg(F.sort_array(F.collect_list(item)).alias("items"))
    add = lambda a, b: F.zip_with(a, b, lambda p, q: p + q)
    sums = lambda it: F.struct(it["tw"].alias("w"), F.transform(it["tw"], lambda v: v * it["raw_time"]).alias("wt"))

    def centre(c):
        pos = F.array_position(F.transform(c["w"], lambda v: v > 0), F.lit(True)).cast("int") - 1
        return F.get(c["wt"], pos) / F.get(c["w"], pos)

    def fold(s, it):
        hit = F.array_position(F.transform(s["c"], lambda c: F.abs(centre(c) - it["raw_time"]) <= AGREE_S), F.lit(True)).cast("int")
        at = F.when(hit > 0, hit).otherwise(F.size(s["c"]) + 1)
        grown = F.when(hit > 0, F.transform(s["c"], lambda c, i: F.when(i == hit - 1, F.struct(add(c["w"], it["tw"]).alias("w"), add(c["wt"], sums(it)["wt"]).alias("wt"))).otherwise(c))).otherwise(F.concat(s["c"], F.array(sums(it))))
        return F.struct(grown.alias("c"), F.concat(s["a"], F.array(F.struct(it["ord"].alias("ord"), at.alias("cl")))).alias("a"))
    first = F.col("items")[0]
    zero = F.struct(F.slice(F.array(sums(first)), 1, 0).alias("c"), F.slice(F.array(F.struct(first["ord"].alias("ord"), F.lit(0).alias("cl"))), 1, 0).alias("a"))
    done = parts.select("attempt_id", "_part", F.explode(F.aggregate("items", zero, fold)["a"]).alias("a"))
    ids = done.select("attempt_id", F.col("a.ord").alias("ord"), (F.col("_part") * 1000000 + F.col("a.cl")).alias("cluster_id"))
    return u.drop("_new", "_part", "_w").join(ids, ["attempt_id", "ord"])


def weighted_time(flag: Column) -> list[Column]:
    """The flagged items in order of time and the bounds of each tier; combine with ``pick_time``."""
    tiers = _tiers(F.col("kind"), F.col("confidence"))
    out = [F.sort_array(F.collect_list(F.when(flag, F.struct("raw_time", "ord", "_w", F.array(*tiers).alias("tiers"))))).alias("_items")]
    for i, t in enumerate(tiers):
        on = flag & t
        out += [F.max(F.when(on, F.col("raw_time"))).alias(f"_hi{i}"), F.min(F.when(on, F.col("raw_time"))).alias(f"_lo{i}"),
                F.max(F.when(on, X.observation_interval("observation_interval_s"))).alias(f"_iv{i}"), F.bool_and(F.when(on, (F.col("kind") == "color") & X.observation_interval("observation_interval_s").isNotNull())).alias(f"_pure{i}")]
    return out


def pick_time() -> Column:
    """Weighted time of the best tier, added up in order of time: equal evidence has one time, to the last bit."""
    best = F.array_position(F.array(*[F.col(f"_hi{i}").isNotNull() for i in range(N_TIERS)]), F.lit(True)).cast("int") - 1
    mine = F.filter("_items", lambda x: F.get(x["tiers"], best))
    zero = F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("w"))
    s = F.aggregate(mine, zero, lambda a, x: F.struct((a["t"] + x["_w"] * x["raw_time"]).alias("t"), (a["w"] + x["_w"]).alias("w")))
    return s["t"] / F.nullif(s["w"], F.lit(0.0))


def pick_interval() -> Column:
    """Interval of an all-light clock: coarsest member plus their spread; NULL for any other clock."""
    return X.when_chain([(F.col(f"_hi{i}").isNotNull(), F.when(F.col(f"_pure{i}"), X.observation_interval(F.col(f"_iv{i}") + F.col(f"_hi{i}") - F.col(f"_lo{i}")))) for i in range(N_TIERS)])


def visual_consensus(items: DataFrame) -> DataFrame:
    """WN50: per (attempt_id, cluster_id) the light cues outside a unique majority of blue confirmations."""
    native = items.where((F.col("kind") == "color") & F.col("confidence").isin("High", "Medium") & F.col("vote_allowed") & (X.finite("blue_s") >= F.col("raw_time")) & X.observation_interval("observation_interval_s").isNotNull())
    g = native.groupBy("attempt_id", "cluster_id").agg(F.sort_array(F.collect_list(F.struct("blue_s", "raw_time", "ord"))).alias("a"), (F.max("raw_time") - F.min("raw_time")).alias("spread"),
                                                       F.least(F.lit(0.2), F.greatest(F.lit(0.1), F.max("observation_interval_s") * 2)).alias("win")).where("size(a) >= 3 and spread > win + 1e-9")
    inside = lambda f: F.filter("a", lambda x, j: (x["blue_s"] - f["blue_s"] <= F.col("win") + 1e-9))
    g = g.withColumn("n", F.transform("a", lambda f, i: F.size(F.filter("a", lambda x, j: (j >= i) & (x["blue_s"] - f["blue_s"] <= F.col("win") + 1e-9)))))
    g = g.withColumn("top", F.array_max("n"))
    unique = (F.col("top") > F.size("a") / 2) & (F.size(F.filter("n", lambda v: v == F.col("top"))) == 1)
    g = g.withColumn("ambiguous", ~unique).withColumn("lead", F.array_position("n", F.col("top")).cast("int") - 1)
    g = g.withColumn("won", F.filter("a", lambda x, j: (j >= F.col("lead")) & (x["blue_s"] - F.col("a")[F.col("lead")]["blue_s"] <= F.col("win") + 1e-9)))
    out = F.filter("a", lambda x: ~F.exists("won", lambda y: y["ord"] == x["ord"]) & F.forall("won", lambda y: F.abs(y["raw_time"] - x["raw_time"]) > F.col("win") + 1e-9))
    return g.select("attempt_id", "cluster_id", "ambiguous", F.when(~F.col("ambiguous"), F.transform(out, lambda x: x["ord"])).otherwise(F.array().cast("array<bigint>")).alias("outliers"))


def fuse(items: DataFrame) -> DataFrame:
    """WN49: one start decision per attempt from clustered evidence."""
    e = items.withColumns({"_w": evidence_weight(), "_ok": F.coalesce("vote_allowed", F.lit(True))})
    hi, low = F.col("confidence") == "High", F.col("confidence") == "Low"
    aud, col, mot = F.col("kind") == "audio", F.col("kind") == "color", F.col("kind") == "motion"

    def score(flag):
        rel = flag & ~low
        return (F.coalesce(F.sum(F.when(flag, whole_weight())), F.lit(0)) / WEIGHT_PARTS + F.size(F.collect_set(F.when(rel, F.col("kind")))) * 1.8 + F.greatest(F.lit(0), F.count_if(rel & col) - 1) * 1.5)
    cl = e.groupBy("attempt_id", "cluster_id").agg(
        score(F.lit(True)).alias("score"), score(F.col("_ok")).alias("eligible_score"), F.bool_or(aud & hi).alias("high_audio"), F.bool_or(aud & hi & F.col("_ok")).alias("ok_high_audio"), F.bool_or(hi).alias("has_high"),
        F.bool_or(F.col("_ok") & ~mot).alias("ok_clock"), F.bool_or(~F.col("_ok")).alias("blocked"), F.min(F.struct("raw_time", "ord")).alias("born"), *weighted_time(F.lit(True))).withColumn("centre", pick_time())
    keep = ["attempt_id", "cluster_id", "score", "eligible_score", "high_audio", "ok_high_audio", "has_high", "ok_clock", "blocked", "born", "centre"]
    w = Window.partitionBy("attempt_id")
    cl = cl.select(*keep)
    # creation order of a cluster is the order of its first item
    cl = cl.withColumn("_rank", F.row_number().over(w.orderBy(F.col("score").desc(), "born")))
    audio_first = F.min(F.when(F.col("high_audio"), F.struct("born", "cluster_id"))).over(w)["cluster_id"]
    cl = cl.withColumn("_orig", F.coalesce(audio_first, F.max(F.when(F.col("_rank") == 1, F.col("cluster_id"))).over(w)))
    mine = F.col("cluster_id") == F.col("_orig")
    cl = cl.withColumn("_rethink", F.bool_or(mine & ~F.col("ok_high_audio") & F.col("blocked")).over(w))
    alt = F.min(F.when(F.col("ok_clock"), F.struct((~F.col("ok_high_audio")).alias("a"), (-F.col("eligible_score")).alias("s"), F.col("_rank").alias("r"), "cluster_id"))).over(w)["cluster_id"]
    cl = cl.withColumn("_best", F.when(F.col("_rethink"), F.coalesce(alt, F.col("_orig"))).otherwise(F.col("_orig")))
    chosen = F.col("cluster_id") == F.col("_best")
    bs, bc = F.max(F.when(chosen, F.col("score"))).over(w), F.max(F.when(chosen, F.col("centre"))).over(w)
    rival = ~chosen & F.col("has_high") & (F.col("score") >= bs * 0.78) & (F.abs(F.col("centre") - bc) > AGREE_S)
    cl = cl.withColumn("_rival", rival)
    best = cl.groupBy("attempt_id").agg(F.max("_best").alias("cluster_id"), F.max("_orig").alias("_orig"), F.bool_or("_rival").alias("rival"), F.count("*").alias("clusters"))
    it = e.join(best, ["attempt_id", "cluster_id"]).join(visual_consensus(items), ["attempt_id", "cluster_id"], "left")
    clock = F.bool_or(aud & hi & F.col("_ok")).over(w)
    it = it.withColumn("_audio_clock", clock)
    outlier = ~F.col("_audio_clock") & F.coalesce(F.array_contains("outliers", F.col("ord")), F.lit(False))
    it = it.withColumn("_vis", ~outlier).withColumn("_el", F.col("_vis") & F.col("_ok")).withColumn("_any", F.bool_or(F.col("_el") & ~mot).over(w))
    it = it.withColumn("_sup", F.when(F.col("_any"), F.col("_el")).otherwise(F.col("_vis")))
    el = F.col("_el")
    first = lambda k: F.min_by("confidence", F.when(el & k, F.struct("raw_time", "ord")))
    facts = it.groupBy("attempt_id").agg(
        F.max("rival").alias("rival"), F.max("clusters").alias("clusters"), F.max(F.col("cluster_id") != F.col("_orig")).alias("changed"), F.count_if(el & col & ~low).alias("_cc"), F.bool_or(el & aud & ~low).alias("_sa"), F.bool_or(el & mot & ~low).alias("_sm"),
        F.bool_or(el & mot).alias("_m"), first(col).alias("_c1"), first(aud).alias("_a1"), F.bool_or(el & aud & hi).alias("_eha"), F.max("_audio_clock").alias("_ac"), F.max(F.coalesce("ambiguous", F.lit(False))).alias("_amb"))
    conflict = F.col("rival") | (F.col("_amb") & ~F.col("_ac") & ~F.col("_eha"))
    sc = F.col("_cc") >= 1
    conf = X.when_chain([(sc & F.col("_sa"), "High"), (F.col("_cc") >= 2, "High"), (sc & F.col("_m"), "Medium"), (sc, F.col("_c1")), (F.col("_sa") & (F.col("_a1") == "High"), "High"), (F.col("_sa") & F.col("_sm"), "Medium"), (F.col("_sa"), F.col("_a1"))], F.lit("Low"))
    facts = facts.withColumns({"conflict": conflict, "_conf": conf})
    auto = X.when_chain([((sc & F.col("_sa")) | (F.col("_cc") >= 2), F.lit(True)), (sc, F.col("_conf") == "High"), (F.col("_sa"), F.col("_a1") == "High")], F.lit(False)) & ~F.col("conflict") & ~F.col("changed")
    facts = facts.withColumn("auto_accept", auto).withColumn("confidence", F.when(F.col("changed") & (F.col("_conf") == "High"), "Medium").otherwise(F.col("_conf")))
    use = F.when(F.col("auto_accept"), F.col("_el")).otherwise(F.col("_sup"))
    t = it.join(facts.select("attempt_id", "auto_accept"), "attempt_id").withColumn("_use", use).groupBy("attempt_id").agg(F.count_if("_sup").alias("supporting"), *weighted_time(F.col("_use")))
    t = t.select("attempt_id", "supporting", X.round_ms(pick_time()).alias("raw_time"), X.round_us(pick_interval()).alias("observation_interval_s"))
    return facts.join(t, "attempt_id").select("attempt_id", "raw_time", "confidence", "auto_accept", "conflict", "supporting", "clusters", "observation_interval_s")


def require_continuous_scene(decisions: DataFrame, cuts: DataFrame) -> DataFrame:
    """PRJ29: a camera cut within 0.38 s makes a start reviewable only."""
    j = decisions.join(cuts.select("attempt_id", F.col("cut_s")), "attempt_id", "left")
    near = F.bool_or(X.truthy((F.col("cut_s") >= 0) & (F.abs(F.col("cut_s") - F.col("raw_time")) <= AGREE_S + 1e-9)))
    g = j.groupBy(*decisions.columns).agg(near.alias("near_cut"))
    return g.withColumns({"auto_accept": F.col("auto_accept") & ~F.col("near_cut"), "confidence": F.when(F.col("near_cut") & (F.col("confidence") == "High"), "Medium").otherwise(F.col("confidence"))})


def body_audit(movement: DataFrame) -> DataFrame:
    """PRJ25: six ordered reasons why a proposed start is not safe to accept.

    Needs proposed_s, pre_motion (any sample at or above threshold in the last 0.15 s), underway, detected,
    movement_s, confidence, first_frame.
    """
    d = F.col("movement_s") - F.col("proposed_s")
    reason = X.when_chain([
        (F.col("pre_motion"), "motion-just-before"), (F.col("underway"), "already-underway"), (~F.col("detected") | F.col("movement_s").isNull() | ~F.col("confidence").isin("Medium", "High"), "no-reliable-launch"),
        ((d >= -0.02) & (d < 0.1 - 1e-6), "delay-too-short"), (d < 0, "moved-before"), (d > 0.75, "moved-too-late"), (F.col("first_frame"), "first-sample-strong")])
    return movement.withColumn("reason", reason).withColumn("safe", F.col("reason").isNull())


def pre_motion(series: DataFrame, proposals: DataFrame) -> DataFrame:
    """Was there motion at threshold in the 0.15 s before a proposed start?"""
    j = proposals.join(series.select("attempt_id", "raw_time", "smoothed", "thr"), "attempt_id", "left")
    on = (F.col("raw_time") < F.col("proposed_s")) & (F.col("raw_time") >= F.col("proposed_s") - 0.15) & (F.col("smoothed") >= F.col("thr"))
    return j.groupBy("attempt_id", "proposed_s").agg(F.bool_or(X.truthy(on)).alias("pre_motion"))


# --- lanes ------------------------------------------------------------------------------------

def patch_id(z: str = "zone") -> Column:
    """FN14: identity of a patch from its coordinates."""
    return F.format_string("light:%.6f:%.6f:%.6f:%.6f", *[F.col(f"{z}.{k}") for k in ("x1", "y1", "x2", "y2")])


def _cx(z) -> Column:
    return (z["x1"] + z["x2"]) / 2


def _cy(z) -> Column:
    return (z["y1"] + z["y2"]) / 2


def merge_patches(items: Column) -> Column:
    """TOP5 for lanes: keep an item unless a kept one lies within 0.035 of it; order is priority."""
    near = lambda a, b: F.hypot(_cx(a["zone"]) - _cx(b["zone"]), _cy(a["zone"]) - _cy(b["zone"])) < LANE_MERGE
    return F.aggregate(items, F.slice(items, 1, 0), lambda k, x: F.when(F.exists(k, lambda y: near(x, y)), k).otherwise(F.concat(k, F.array(x))))


def lane_pool(lanes: DataFrame) -> DataFrame:
    """JN19: the lanes of an attempt inside the athlete's horizontal band, primary first, near-duplicates merged.

    ``lanes``: attempt_id, ord (primary 0), zone, score, start_s, body (struct or NULL).  The merged pool
    holds at most one lane per 0.035 of the frame, whatever the number of rows.
    """
    c = (F.col("zone.x1") + F.col("zone.x2")) / 2
    ok = F.col("body").isNull() | c.between(F.col("body.x1") - LANE_MARGIN, F.col("body.x2") + LANE_MARGIN)
    g = lanes.where(X.truthy(ok)).groupBy("attempt_id").agg(F.sort_array(F.collect_list(F.struct("ord", "zone", "score", "start_s"))).alias("items"))
    return g.select("attempt_id", merge_patches(F.col("items")).alias("pool"))


def scan_budget(pool: DataFrame, k: int = 3) -> DataFrame:
    """TOP6: the whole pool is assessed before the first three are kept."""
    return pool.select("attempt_id", F.size("pool").alias("pool_size"), F.posexplode(F.slice("pool", 1, k)).alias("place", "c")).select("attempt_id", "pool_size", "place", "c.ord", "c.score")


def body_of(z: Column) -> Column:
    cx, cy = _cx(z), _cy(z)
    right = cx >= 0.5
    return F.struct(F.when(right, F.greatest(F.lit(0.5), cx - 0.2)).otherwise(F.greatest(F.lit(0.0), cx - 0.23)).alias("x1"), F.when(right, F.least(F.lit(1.0), cx + 0.23)).otherwise(F.least(F.lit(0.5), cx + 0.2)).alias("x2"))


def lane_conflicts(pool: DataFrame) -> DataFrame:
    """JN17: lanes of one pool that do not contain each other; symmetric, never bridged by a third."""
    inside = lambda a, b: _cx(b["zone"]).between(body_of(a["zone"])["x1"] - LANE_MARGIN, body_of(a["zone"])["x2"] + LANE_MARGIN)
    per = F.transform("pool", lambda a, i: F.size(F.filter("pool", lambda b, j: (j > i) & ~(inside(a, b) & inside(b, a)))))
    n = F.aggregate(per, F.lit(0), lambda s, v: s + v)
    return pool.select("attempt_id", F.size("pool").alias("lanes"), n.alias("conflicts")).withColumn("needs_selection", F.col("conflicts") > 0)


def reorder_lanes(scanned: DataFrame) -> DataFrame:
    """TOP10: the selected lane first, the pool's own order behind it."""
    w = Window.partitionBy("attempt_id").orderBy(F.col("selected").desc(), "place")
    return scanned.withColumn("new_place", F.row_number().over(w) - 1)


def associate_lanes(lanes: DataFrame, decisions: DataFrame) -> DataFrame:
    """JN18: lanes that support a fused start, by label or within 0.35 s of the association time.

    ``lanes``: attempt_id, lane_id, label, start_s, score, confidence, vote_allowed.
    ``decisions``: attempt_id, raw_time, labels (array), audio_clock, hint_s.
    """
    j = lanes.join(decisions, "attempt_id").where("vote_allowed")
    w = Window.partitionBy("attempt_id")
    seed = F.array_contains("labels", F.col("label"))
    j = j.withColumn("_seed", seed).withColumn("_rel", F.col("confidence").isin("High", "Medium")).withColumn("_have", F.bool_or(F.col("_seed") & F.col("_rel")).over(w))
    wt = F.when(F.col("confidence") == "High", 3.0).when(F.col("confidence") == "Medium", 2.0).otherwise(0.75)
    anchor = F.col("_seed") & (F.col("_rel") | ~F.col("_have"))
    at = F.sum(F.when(anchor, F.col("start_s") * wt)).over(w) / F.sum(F.when(anchor, wt)).over(w)
    hint = X.truthy(F.abs(F.col("hint_s") - F.col("raw_time")) <= AGREE_S)
    j = j.withColumn("association_s", F.when(hint, F.col("hint_s")).otherwise(F.coalesce(at, F.col("raw_time"))))
    dist = F.abs(F.col("start_s") - F.col("association_s"))
    j = j.where(F.col("_seed") | ((F.col("confidence") != "Low") & (dist <= 0.35))).where(~F.col("audio_clock") | (F.col("confidence") != "Low"))
    order = w.orderBy(dist, F.col("score").desc(), "lane_id")
    return j.withColumn("place", F.row_number().over(order)).select("attempt_id", "lane_id", "place", X.round_us("association_s").alias("association_s"), (F.col("place") == 1).alias("selected"))


def run_context(source, start, zone) -> Column:
    """FN26: key of an analysis context; NULL when it has no source or no accepted start."""
    ok = X.nonempty(source) & (X.finite(start) >= 0)
    return F.when(X.truthy(ok), F.sha2(F.to_json(F.struct(X.c(source).alias("source"), X.c(start).alias("start"), X.c(zone).alias("zone")), {"ignoreNullFields": "false"}), 256))
