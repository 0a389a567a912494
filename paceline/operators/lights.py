"""Calibrated start and finish lights: verified departure, return-state detection.

Work is per attempt and ordered by time.  Look-ahead and look-back use range frames of at most
1.15 s, and the rules that compare a row with several later rows are folds over those short arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from .series import numbered

AHEAD_MS, WINDOW_S, BACK_MS = 1150, 0.48, 420


def _opp(v: str) -> Column:
    return X.green_blue_opponent(f"{v}.r", f"{v}.g", f"{v}.b")


def _red(v: str) -> Column:
    g = lambda k: F.col(f"{v}.{k}")
    return g("r") / F.greatest(F.lit(1.0), g("r") + g("g") + g("b"))


def _chroma(v: str) -> Column:
    g = lambda k: F.col(f"{v}.{k}")
    return F.greatest(g("r"), g("g"), g("b")) - F.least(g("r"), g("g"), g("b"))


def _med(x: Column, w: Window) -> Column:
    return F.percentile(x, F.lit(0.5)).over(w)


def return_state(samples: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """WN36: candidates of the light's return to its other state, each verified by a settled stretch.

    ``samples``: attempt_id, raw_time, rgb, and before/after colour structs.  The state the light is in is
    learned from the first fifth of the scan, or from ``history`` (attempt_id, opponent_median,
    opponent_mad) when it is given.
    """
    s = _learned(samples)
    if history is not None:
        s = s.join(history.select("attempt_id", F.col("opponent_median").alias("_hm"), F.col("opponent_mad").alias("_hd")), "attempt_id").withColumns({"sig": F.col("_hm"), "mad": F.col("_hd")})
    return _returns(s, ["attempt_id"])


def both_readings(samples: DataFrame, states: DataFrame) -> DataFrame:
    """WN37: the candidates of ``return_state`` by the scan and, where ``states`` has a conflict, by the history too (``by_history``).

    ``states``: attempt_id, conflict, opponent_median, opponent_mad.  The scan is learned from once for both readings.
    """
    s = _learned(samples).join(states.select("attempt_id", "conflict", "opponent_median", "opponent_mad"), "attempt_id")
    scan = F.struct(F.lit(False).alias("by_history"), F.col("sig").cast("double").alias("sig"), F.col("mad").cast("double").alias("mad"))
    told = F.struct(F.lit(True).alias("by_history"), F.col("opponent_median").cast("double").alias("sig"), F.col("opponent_mad").cast("double").alias("mad"))
    s = s.withColumn("_r", F.explode(F.when(F.col("conflict"), F.array(scan, told)).otherwise(F.array(scan))))
    s = s.withColumns({c: F.col(f"_r.{c}") for c in ("by_history", "sig", "mad")}).drop("_r", "conflict", "opponent_median", "opponent_mad")
    return _returns(s, ["attempt_id", "by_history"])


def _learned(samples: DataFrame) -> DataFrame:
    """Samples with the median colour of the first fifth of their scan and its spread."""
    a = Window.partitionBy("attempt_id")
    s = numbered(samples).where("n >= 6").withColumns({"opp": _opp("rgb"), "before_o": _opp("before"), "after_o": _opp("after"), "lum": X.luminance("rgb.r", "rgb.g", "rgb.b"), "red": _red("rgb"), "chr": _chroma("rgb")})
    s = s.withColumn("span", F.abs(F.col("before_o") - F.col("after_o"))).where("span >= 1")
    s = s.withColumn("_b", F.col("idx") < F.least(F.lit(12), F.greatest(F.lit(3), F.floor(F.col("n") * 0.2))))
    base = lambda c: F.when(F.col("_b"), F.col(c))
    s = s.withColumns({"sig": _med(base("opp"), a), "base_lum": _med(base("lum"), a), "base_chr": _med(base("chr"), a), "base_red": _med(base("red"), a)})
    return s.withColumn("mad", _med(F.when(F.col("_b"), F.abs(F.col("opp") - F.col("sig"))), a))


def _returns(s: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates of each scan (``keys``) whose state ``sig`` and spread ``mad`` are known."""
    a = Window.partitionBy(*keys)
    o = a.orderBy("raw_time")
    after = F.abs(F.col("sig") - F.col("after_o")) <= F.abs(F.col("sig") - F.col("before_o"))
    s = s.withColumns({"in_after": after, "target": F.when(after, F.col("before_o")).otherwise(F.col("after_o")), "source": F.when(after, F.col("after_o")).otherwise(F.col("before_o"))})
    s = s.withColumn("learned", F.greatest("span", F.abs(F.col("target") - F.col("sig"))))
    s = s.withColumn("thr", F.greatest(F.lit(1.2), F.col("learned") * 0.12, F.col("mad") * 4 + 0.8))
    gap = F.greatest(F.lit(1 / 120), F.col("raw_time") - F.lag("raw_time").over(o))
    s = s.withColumns({"confirm": F.greatest(F.col("thr") * 1.35, F.col("learned") * 0.22), "onset_thr": F.greatest(F.lit(0.55), F.col("learned") * 0.035, F.col("mad") * 3 + 0.3), "_gap": gap,
                       "proj": F.when(F.col("target") >= F.col("source"), 1.0).otherwise(-1.0) * (F.col("opp") - F.col("sig"))})
    s = s.withColumn("step", _med(F.col("_gap"), a))
    min_chr = F.greatest(F.lit(2.5), F.least(F.col("base_chr"), _chroma("before"), _chroma("after")) * 0.15)
    plausible = (F.col("lum") / F.greatest(F.lit(1.0), F.col("base_lum"))).between(0.55, 2.4) & (F.col("chr") >= min_chr) & (F.col("red") <= F.greatest(_red("before"), _red("after"), F.col("base_red")) + 0.12)
    s = s.withColumn("ok", plausible)
    directed = F.abs(F.col("opp") - F.col("source")) - F.abs(F.col("opp") - F.col("target")) >= F.greatest(F.lit(0.5), F.col("span") * 0.03)
    s = s.withColumns({"dir": directed & F.col("ok"), "ms": F.floor(F.col("raw_time") * 1000 + 0.5).cast("bigint"), "calm": F.col("proj") < F.greatest(F.col("onset_thr"), F.col("thr") * 0.75)})
    # two calm samples in a row within the last half second
    pair = F.when(F.col("calm") & X.truthy(F.lag("calm").over(o)), F.lag("raw_time").over(o))
    s = s.withColumn("_pair", pair).withColumn("_quiet", X.truthy(F.max("_pair").over(o.rowsBetween(Window.unboundedPreceding, -1)) >= F.col("raw_time") - 0.5))
    cont = X.truthy((F.lead("proj").over(o) >= F.col("onset_thr")) & F.lead("ok").over(o))
    s = s.withColumn("anchor", (F.col("idx") >= 2) & (F.col("idx") < F.col("n") - 1) & F.col("_quiet") & (F.col("proj") >= F.col("thr")) & F.col("ok") & (F.col("dir") | cont))
    s = s.withColumn("_q", X.truthy((F.lag("proj", 1).over(o) < F.col("onset_thr")) & (F.lag("proj", 2).over(o) < F.col("onset_thr"))))
    item = F.struct(F.col("raw_time").alias("t"), F.col("proj").alias("p"), "ok", (F.col("dir") & F.col("ok")).alias("d"), "idx", F.col("_q").alias("q"))
    r = a.orderBy("ms")
    s = s.withColumns({"_f": F.collect_list(item).over(r.rangeBetween(0, AHEAD_MS)), "_back": F.collect_list(item).over(r.rangeBetween(-BACK_MS, -1))}).where("anchor")
    # the frames are whole milliseconds; the bounds themselves are seconds
    s = s.withColumns({"_f": F.filter("_f", lambda q: q["t"] <= F.col("raw_time") + AHEAD_MS / 1000), "_back": F.filter("_back", lambda q: q["t"] >= F.col("raw_time") - BACK_MS / 1000)})
    ratio = F.when(F.col("step") >= 0.15, 0.6).otherwise(0.62)

    def verified(end, k):
        win = F.filter("_f", lambda q, j: (j <= k) & (q["t"] >= end["t"] - WINDOW_S))
        good = F.size(F.filter(win, lambda q: (q["p"] >= F.col("thr")) & q["d"]))
        long = end["t"] - F.get(win, F.lit(0))["t"] + F.col("step") >= 0.32
        return (k >= 1) & long & (good >= F.greatest(F.lit(2), F.ceil(F.size(win) * ratio))) & (F.array_max(F.transform(win, lambda q: q["p"])) >= F.col("confirm"))
    s = s.withColumn("_end", F.array_position(F.transform("_f", verified), F.lit(True)).cast("int") - 1).where("_end >= 1")
    s = s.withColumn("_v", F.slice("_f", 1, F.col("_end") + 1))
    reach = F.when(F.col("step") >= 0.075, F.col("step") * 2.25).otherwise(F.greatest(F.lit(0.1), F.col("step") * 3.25))
    seen = F.filter("_v", lambda q, j: (j == 0) | ((q["p"] >= F.col("onset_thr")) & q["ok"]))
    walked = F.aggregate(seen, F.struct(F.col("raw_time").alias("t"), F.lit(True).alias("ok")), lambda c, q: F.struct(q["t"].alias("t"), (c["ok"] & (q["t"] - c["t"] <= reach + 1e-9)).alias("ok")))
    s = s.withColumn("_w", walked)
    support = F.size(F.filter("_v", lambda q: (q["p"] >= F.col("thr")) & q["d"]))
    s = s.where(F.col("_w.ok") & (F.element_at("_v", -1)["t"] - F.col("_w.t") <= reach + 1e-9) & (support >= 2))
    # faint precursor: walk back at most 0.42 s, one miss in a row allowed, with two quiet samples before it
    zero = F.struct(F.col("raw_time").alias("t"), F.col("idx").alias("i"), F.lit(1).alias("k"), F.lit(0).alias("miss"), F.lit(False).alias("stop"), F.lit(False).alias("q"))

    def back(c, q):
        on = ~c["stop"] & (q["p"] >= F.col("onset_thr")) & q["ok"]
        miss = F.when(on, 0).otherwise(c["miss"] + 1)
        return F.struct(F.when(on, q["t"]).otherwise(c["t"]).alias("t"), F.when(on, q["idx"]).otherwise(c["i"]).alias("i"), (c["k"] + on.cast("int")).alias("k"), miss.cast("int").alias("miss"), (c["stop"] | (miss > 1)).alias("stop"), F.when(on, q["q"]).otherwise(c["q"]).alias("q"))
    s = s.withColumn("_o", F.aggregate(F.reverse("_back"), zero, back))
    s = s.withColumn("_pre", (F.col("step") <= 0.075) & (F.col("_o.i") < F.col("idx")) & (F.col("_o.i") >= 2) & (F.col("_o.k") >= 3))
    n = F.size("_v")
    strong = F.size(F.filter("_v", lambda q: q["p"] >= F.col("thr")))
    peak = F.array_max(F.transform("_v", lambda q: q["p"]))
    conf = F.when((peak >= F.greatest(F.col("confirm") * 1.2, F.col("learned") * 0.34)) & (strong >= F.ceil(n * 0.42)) & (support >= F.ceil(n * 0.2)), "High").otherwise("Medium")
    return s.select(*keys, X.round_ms(F.when(F.col("_pre") & F.col("_o.q"), F.col("_o.t")).otherwise(F.col("raw_time"))).alias("onset_s"), F.col("raw_time").alias("strict_s"), conf.alias("confidence"),
                    X.round_ms(peak + strong).alias("score"), strong.alias("persistence"), "in_after")


def first_return(candidates: DataFrame) -> DataFrame:
    """The earliest candidate of an attempt is its finish."""
    return candidates.groupBy("attempt_id").agg(F.min(F.struct("onset_s", "strict_s", "confidence", "score")).alias("c"), F.count("*").alias("candidates")).select("attempt_id", F.col("c.onset_s").alias("finish_s"), "c.confidence", "candidates")


def resolve_polarity(samples: DataFrame, states: DataFrame) -> DataFrame:
    """WN37: when earlier observations and the scan disagree about the lamp's state, nothing is automatic:
    the earliest finish of either reading is a Medium suggestion and both stay as review rows.

    ``states``: attempt_id, scan_after, history_after, opponent_median, opponent_mad.
    """
    st = states.withColumn("conflict", X.truthy(F.col("history_after") != F.col("scan_after")))
    earliest = lambda on: F.min(F.when(on, F.struct("onset_s", "strict_s", "confidence", "score")))
    found = both_readings(samples, st).groupBy("attempt_id").agg(earliest(~F.col("by_history")).alias("_s"), earliest(F.col("by_history")).alias("_h"))
    found = found.select("attempt_id", F.col("_s.onset_s").alias("_a"), F.col("_s.confidence").alias("_ac"), F.col("_h.onset_s").alias("_b"))
    j = st.join(found, "attempt_id", "left")
    both = F.array_sort(F.array_distinct(F.array_compact(F.array("_a", "_b"))))
    return j.select("attempt_id", "conflict", F.when(F.col("conflict"), F.least("_a", "_b")).otherwise(F.col("_a")).alias("finish_s"),
                    F.when(F.col("conflict") & F.least("_a", "_b").isNotNull(), "Medium").otherwise(F.coalesce("_ac", F.lit("None"))).alias("confidence"), F.when(F.col("conflict"), both).otherwise(F.array_compact(F.array("_a"))).alias("review_times"))


def verified_departure(samples: DataFrame, required: int, chromatic: bool = False, min_seconds: float = 0.0) -> DataFrame:
    """WN32: the first durable departure from the "before" colour that a later run of "after" frames proves.

    ``samples``: attempt_id, raw_time, rgb, before, after, colour_delta.  Every qualifying run is joined with
    the samples before it (runs are few); the earliest run with a connected departure decides.
    """
    a = Window.partitionBy("attempt_id")
    o = a.orderBy("raw_time")
    s = numbered(samples).withColumns({"db": X.round_ms(X.rgb_distance("rgb", "before")), "da": X.round_ms(X.rgb_distance("rgb", "after"))})
    opp = lambda v: (F.col(f"{v}.b") - F.col(f"{v}.g")) / F.greatest(F.lit(1.0), F.col(f"{v}.r") + F.col(f"{v}.g") + F.col(f"{v}.b"))
    raw = lambda v: F.col(f"{v}.b") - F.col(f"{v}.g")
    span = opp("after") - opp("before")
    hue = (span > 0) & (opp("rgb") - opp("before") >= F.greatest(F.lit(0.006), span * 0.035)) & (raw("rgb") - raw("before") >= F.greatest(F.lit(0.75), (raw("after") - raw("before")) * 0.035))
    s = s.withColumn("hue", hue if chromatic else F.lit(True))
    d = F.col("colour_delta")
    s = s.withColumn("blue", (F.col("db") - F.col("da") >= F.greatest(F.lit(0.35), d * 0.06)) & (F.col("da") <= d * 0.72) & F.col("hue"))
    s = s.withColumn("_isl", F.sum(F.when(~F.col("blue"), 1).otherwise(0)).over(o))
    runs = s.where("blue").groupBy("attempt_id", "_isl").agg(F.min("idx").alias("run_idx"), F.count("*").alias("run_n"), (F.max("raw_time") - F.min("raw_time")).alias("_cov"), F.min_by(F.struct("raw_time", "db", "da"), "idx").alias("first"))
    runs = runs.where((F.col("run_n") >= required) & ((F.lit(min_seconds) <= 0) | (F.col("_cov") + 1e-6 >= min_seconds))).drop("_isl", "_cov")
    pre = s.join(runs, "attempt_id").where(F.col("idx") <= F.col("run_idx"))
    like = F.when((F.col("idx") < F.col("run_idx")) & (F.col("db") <= F.col("da")), F.col("db"))
    k = Window.partitionBy("attempt_id", "run_idx")
    q = pre.withColumns({"_like": like}).withColumns({"_r": F.row_number().over(k.orderBy(F.col("_like").asc_nulls_last(), "idx")), "_nl": F.count("_like").over(k)}).where("_nl >= 2")
    stable = F.when((F.col("_r") <= F.greatest(F.lit(2), F.ceil(F.col("_nl") * 0.3))) & F.col("_like").isNotNull(), F.col("_like"))
    q = q.withColumn("_s", stable).withColumn("base", F.percentile("_s", F.lit(0.5)).over(k))
    q = q.withColumn("_m", F.percentile(F.abs(F.col("_s") - F.col("base")), F.lit(0.5)).over(k))
    q = q.withColumn("threshold", F.greatest(F.lit(0.65), d * 0.035, F.col("base") + F.greatest(F.lit(0.45), F.col("_m") * 4)))
    ko = k.orderBy("idx")
    q = q.withColumn("gone", (F.col("db") >= F.col("threshold")) & F.col("hue")).withColumn("_calm", ~F.col("gone") & (F.col("db") <= F.col("da")))
    # last place at or after which two misses in a row still occur: a departure must start behind it
    miss2 = ~F.col("gone") & ~F.coalesce(F.lag("gone").over(ko), F.lit(True))
    q = q.withColumn("_broken", F.max(F.when(miss2, F.col("idx"))).over(k))
    near = F.count_if("gone").over(ko.rowsBetween(0, 2))
    width = F.count("*").over(ko.rowsBetween(0, 2))
    q = q.withColumn("_start", (F.col("idx") >= 2) & F.lag("_calm", 1).over(ko) & F.lag("_calm", 2).over(ko) & F.col("gone") & (near >= F.least(F.lit(2), width)) & (F.coalesce(F.col("_broken"), F.lit(-1)) <= F.col("idx")))
    hits = q.where(X.truthy(F.col("_start"))).groupBy("attempt_id", "run_idx").agg(F.min(F.struct("idx", F.col("raw_time").alias("onset_s"), X.round_ms("threshold").alias("threshold"), X.round_ms("base").alias("baseline"))).alias("h"),
                                                                                 F.first("run_n").alias("run_n"), F.first("first").alias("first"), F.first("colour_delta").alias("colour_delta"))
    g = hits.groupBy("attempt_id").agg(F.min(F.struct("run_idx", "h", "run_n", "first", "colour_delta")).alias("b"))
    return g.select("attempt_id", "b.h.onset_s", F.col("b.first.raw_time").alias("confirmed_s"), F.col("b.run_n").alias("confirmation_frames"), "b.h.threshold", "b.h.baseline",
                    X.round_ms(F.col("b.first.db") - F.col("b.first.da")).alias("advantage"), "b.colour_delta")


def calibrated_verdict(departures: DataFrame, required: int, search_start: float, search_end: float) -> DataFrame:
    """WN33: confidence of a verified start; a departure at the edge of the search stays unselected."""
    edge = (F.col("onset_s") >= search_end - 0.25) | (F.col("onset_s") <= search_start + 0.1)
    d, n = F.col("colour_delta"), F.col("confirmation_frames")
    conf = X.when_chain([(edge | (d < 12), "Low"), ((d >= 35) & (F.col("advantage") >= d * 0.2) & (n >= required), "High"), ((d >= 18) & (n >= min(2, required)), "Medium")], F.lit("Low"))
    return departures.select("attempt_id", "onset_s", "confirmed_s", conf.alias("confidence"), edge.alias("boundary_risk"), (~edge & (n >= required)).alias("selected"))


LOOK_BACK, LOOK_AHEAD, VERIFY_S = 10, 12, 0.5


def _signal(main: Column, a: Column, b: Column) -> Column:
    total = main + a + b
    return F.greatest(main - F.greatest(a, b), F.when(total > 0, (main - F.greatest(a, b)) / total).otherwise(0.0) * 180)


def _opponent(c: Column) -> Column:
    total = c["r"] + c["g"] + c["b"]
    return F.when(total > 0, (c["g"] - c["b"]) / total * 180).otherwise(0.0)


def _mean_colour(items: Column, field: str) -> Column:
    zero = F.struct(*[F.lit(0.0).alias(k) for k in "rgb"])
    mean = lambda s, k: F.floor(s[k] / F.greatest(F.size(items), F.lit(1)) + 0.5).cast("double").alias(k)
    return F.aggregate(items, zero, lambda s, q: F.struct(*[(s[k] + q[field][k]).alias(k) for k in "rgb"]), lambda s: F.struct(*[mean(s, k) for k in "rgb"]))


def _median_of(xs: Column) -> Column:
    s = F.array_sort(xs)
    return (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2


def patch_transitions(patches: DataFrame, width: int, height: int) -> DataFrame:
    """WN35: patches that leave a stable green for a durable blue, with the colour of the whole frame removed.

    ``patches``: recording_id, x, y, radius, t, rgb (patch mean), frame_rgb (frame mean).  Look-back is ten
    and look-ahead twelve frames, both row frames inside a patch.  The earliest proven change of a patch
    counts.  This is the unguided scan: it knows neither an expected time nor a body region.
    """
    key = ["recording_id", "x", "y", "radius"]
    p = Window.partitionBy(*key)
    o = p.orderBy("t")
    c, g = F.col("rgb"), F.col("frame_rgb")
    s = patches.withColumns({"idx": F.row_number().over(o) - 1, "n": F.count("*").over(p), "gs": _signal(c["g"], c["r"], c["b"]), "bs": _signal(c["b"], c["r"], c["g"]), "corr": _opponent(c) - _opponent(g)}).where("n >= 6")
    s = s.withColumns({"blue": (F.col("bs") >= 0.5) & (F.col("rgb.b") >= 8), "green": (F.col("gs") >= 0.5) & (F.col("rgb.g") >= 8)})
    rest = o.rowsBetween(0, Window.unboundedFollowing)
    stop = F.min(F.when(~F.col("blue"), F.col("idx"))).over(rest)
    item = F.struct("idx", "t", "rgb", "frame_rgb", "green", "gs", "corr")
    s = s.withColumns({"run": F.coalesce(stop, F.col("n")) - F.col("idx"), "tail": F.count_if(F.col("blue") & (F.col("idx") >= F.col("n") - 4)).over(rest), "near": F.count("*").over(o.rowsBetween(0, LOOK_AHEAD - 1)),
                       "lit": F.collect_list(F.when(F.col("blue"), item)).over(o.rowsBetween(0, LOOK_AHEAD - 1)), "past": F.collect_list(item).over(o.rowsBetween(-LOOK_BACK, -1))})
    ratio = F.size("lit") / F.col("near")
    ends = F.col("n") - F.greatest(F.col("idx"), F.col("n") - 4)
    s = s.withColumn("ratio", ratio).where((F.col("idx") >= 2) & (F.col("bs") >= 0.65) & (F.col("rgb.b") >= 8) & (F.col("run") >= F.least(F.lit(2), F.col("n") - F.col("idx")))
                                           & (F.col("ratio") >= 0.55) & ((F.col("tail") >= F.greatest(F.lit(1), F.ceil(ends * 0.5))) | (F.col("run") >= 10)))
    greens = F.slice(F.array_sort(F.transform(F.filter("past", lambda q: q["green"]), lambda q: F.struct((-q["gs"]).alias("o"), q["idx"].alias("i"), q["rgb"].alias("rgb"), q["frame_rgb"].alias("frame_rgb"), q["corr"].alias("corr")))), 1, 5)
    s = s.withColumn("base", greens).withColumn("after", F.slice("lit", 1, 6))
    s = s.withColumns({"base_rgb": _mean_colour(F.col("base"), "rgb"), "after_rgb": _mean_colour(F.col("after"), "rgb"), "base_all": _mean_colour(F.col("base"), "frame_rgb"), "after_all": _mean_colour(F.col("after"), "frame_rgb")})
    local = _opponent(F.col("base_rgb")) - _opponent(F.col("after_rgb"))
    b = F.col("base_rgb")
    s = s.withColumns({"local": local, "shift": local - (_opponent(F.col("base_all")) - _opponent(F.col("after_all"))), "base_green": _signal(b["g"], b["r"], b["b"]), "delta": X.rgb_distance("base_rgb", "after_rgb"),
                       "centre": _opponent(b) - _opponent(F.col("base_all"))})
    lum = lambda v: X.luminance(f"{v}.r", f"{v}.g", f"{v}.b")
    s = s.withColumn("_ok", (F.size("base") >= 2) & (F.col("base_green") >= 0.65) & (b["g"] >= 8) & (F.col("delta") >= 3) & (F.col("local") >= 0.9) & (F.col("shift") >= F.greatest(F.lit(0.6), F.col("local") * 0.18))
                & (F.col("after_rgb.b") >= b["b"] - 2) & (lum("after_rgb") >= lum("base_rgb") * 0.65))
    s = s.withColumn("_d", F.transform("base", lambda q: F.abs(q["corr"] - F.col("centre"))))
    s = s.withColumn("_m", _median_of(F.col("_d")))
    s = s.withColumn("_mad", _median_of(F.transform("_d", lambda v: F.abs(v - F.col("_m")))))
    s = s.withColumns({"leave": F.greatest(F.lit(0.45), F.col("shift") * 0.04, F.col("_m") + F.greatest(F.lit(0.3), F.col("_mad") * 4)), "calm": F.greatest(F.lit(0.6), F.col("shift") * 0.035, F.col("_m") + F.col("_mad") * 3),
                       "view": F.concat("past", F.array(item))})
    gone = lambda q: F.col("centre") - q["corr"] >= F.col("leave")
    still = lambda q: q["green"] & (F.abs(q["corr"] - F.col("centre")) <= F.col("calm"))

    def starts(q, j):
        ahead = F.slice("view", j + 1, 3)
        quiet = F.when(j >= 2, still(F.get("view", j - 2)) & still(F.get("view", j - 1))).otherwise(F.lit(False))
        return quiet & (q["t"] >= F.col("t") - VERIFY_S) & gone(q) & (F.size(F.filter(ahead, gone)) >= F.least(F.lit(2), F.size(ahead)))
    s = s.withColumn("_at", F.array_position(F.transform("view", starts), F.lit(True)).cast("int")).withColumn("on", F.get("view", F.col("_at") - 1)).withColumn("_hit", X.truthy(F.col("_ok") & (F.col("_at") > 0)))
    y = F.col("y") / height
    score = (F.least("base_green", F.lit(30.0)) * 0.7 + F.least("bs", F.lit(30.0)) * 0.9 + F.least("delta", F.lit(50.0)) * 0.25 + F.least("shift", F.lit(30.0)) * 4 + F.col("ratio") * 30 - F.col("radius") * 1.5
             - (F.col("t") - F.col("on.t")) * 20 + y * 26 - F.when(y < 0.12, 28.0).otherwise(0.0))
    conf = X.when_chain([((y >= 0.2) & (F.col("base_green") >= 18) & (F.col("bs") >= 14) & (F.col("delta") >= 35) & (F.col("ratio") >= 0.75) & (F.col("shift") >= 12), "High"),
                         ((y >= 0.2) & (F.col("base_green") >= 3) & (F.col("bs") >= 2.5) & (F.col("delta") >= 8) & (F.col("shift") >= 3), "Medium")], F.lit("Low"))
    first = F.min_by(F.struct(score.alias("score"), F.col("on.t").alias("onset_s"), F.col("on.idx").alias("frame"), F.col("t").alias("verified_s"), conf.alias("confidence"), "base_rgb", "after_rgb"), F.when(F.col("_hit"), F.col("idx")))
    return s.groupBy(*key).agg(first.alias("c")).where("c is not null").select(*key, "c.*")


def separate_patches(found: DataFrame, width: int, height: int, keep: int = 4) -> DataFrame:
    """TOP5 for patches: best first, near ones at about the same frame are the same light.

    A frame has a fixed number of patch positions, so the folded list is bounded by the grid.
    """
    item = F.struct((-F.col("score")).alias("o"), "x", "y", "radius", "frame", "onset_s", "verified_s", "confidence", "base_rgb", "after_rgb")
    g = found.groupBy("recording_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    same = lambda a, b: (F.hypot((a["x"] - b["x"]) / width, (a["y"] - b["y"]) / height) < 0.1) & (F.abs(a["frame"] - b["frame"]) <= 2)
    kept = F.aggregate("items", F.slice("items", 1, 0), lambda k, q: F.when((F.size(k) >= 6) | F.exists(k, lambda e: same(e, q)), k).otherwise(F.concat(k, F.array(q))))
    return g.select("recording_id", F.posexplode(F.slice(kept, 1, keep)).alias("place", "c")).select("recording_id", "place", "c.x", "c.y", "c.radius", "c.onset_s", "c.verified_s", "c.confidence", X.round_ms(-F.col("c.o")).alias("score"))
