"""Start tones: frame features, tone segments, the three-tone pattern, the verdict."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X

FRAME_S, HOP_S, RATE = 0.02, 0.01, 8000
FEATURES = "recording_id bigint, channel int, t double, rms double, tonality double, frequency double, prominence_db double, concentration double, amplitude double"


def _frame_features(f: np.ndarray, rate: int) -> dict[str, np.ndarray]:
    """Features of many frames at once (rows are frames)."""
    n, size = f.shape
    rms = np.sqrt((f * f).mean(1))
    best = np.zeros(n)
    for lag in range(max(2, rate // 2500), min(size - 2, -(-rate // 90)) + 1):
        a, b = f[:, :-lag], f[:, lag:]
        best = np.maximum(best, (a * b).sum(1) / np.sqrt(np.maximum(1e-12, (a * a).sum(1) * (b * b).sum(1))))
    lo, hi = max(1, -(-120 * size // rate)), min(size // 2 - 1, 2500 * size // rate)
    win = np.hanning(size)
    power = np.abs(np.fft.rfft(f * win, axis=1)[:, lo:hi + 1]) ** 2
    k = power.argmax(1)
    rows = np.arange(n)
    peak = power[rows, k]
    side = lambda d: np.where((k + d >= 0) & (k + d < power.shape[1]), power[rows, np.clip(k + d, 0, power.shape[1] - 1)], 0)
    left, right = (np.where(s > 0, s, peak) for s in (side(-1), side(1)))
    den = left - 2 * peak + right
    off = np.where(np.abs(den) > 1e-12, np.clip(0.5 * (left - right) / np.where(np.abs(den) > 1e-12, den, 1), -0.5, 0.5), 0)
    silent, dull = (f * f).sum(1) < 1e-10, peak <= 1e-10
    flat = silent | dull
    db = np.minimum(80, 10 * np.log10(np.maximum(peak, 1e-300) / np.maximum(1e-12, np.median(power, axis=1))))
    return {"rms": rms, "tonality": np.where(silent, 0, np.clip(best, 0, 1)), "frequency": np.where(flat, np.nan, (k + lo + off) * rate / size), "prominence_db": np.where(flat, 0, db),
            "concentration": np.where(flat, 0, peak / np.maximum(1e-12, power.sum(1))), "amplitude": np.where(flat, 0, 2 * np.sqrt(peak) / max(1e-6, win.sum()))}


def frame_features(chunks: DataFrame, rate: int = RATE) -> DataFrame:
    """WN54: 20 ms frames every 10 ms.  ``chunks``: recording_id, channel, chunk_start_s, samples.

    Consecutive chunks must overlap by one frame minus one hop, so every frame lies inside one chunk
    and no two chunks need to meet in a task.
    """
    size, hop = round(FRAME_S * rate), round(HOP_S * rate)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for rec, ch, start, samples in zip(b.recording_id, b.channel, b.chunk_start_s, b.samples):
                x = np.asarray(samples, dtype=float)
                if len(x) < size:
                    continue
                f = np.lib.stride_tricks.sliding_window_view(x, size)[::hop]
                d = pd.DataFrame(_frame_features(f, rate))
                d.insert(0, "t", start + np.arange(len(f)) * hop / rate)
                d.insert(0, "channel", ch)
                d.insert(0, "recording_id", rec)
                out.append(d)
            if out:
                r = pd.concat(out)
                r["frequency"] = r["frequency"].astype(object).where(r["frequency"].notna(), None)
                yield r
    return chunks.select("recording_id", "channel", "chunk_start_s", "samples").mapInPandas(run, FEATURES)


def protocol_frame() -> Column:
    return X.truthy(F.col("frequency").between(300, 2200) & (F.col("prominence_db") >= 14) & (F.col("concentration") >= 0.14) & (F.col("tonality") >= 0.4))


def tone_segments(features: DataFrame, key: str = "attempt_id") -> DataFrame:
    """WN40 before merging: activity runs with at most two missing frames, onset walked back by at most 80 ms.

    Needs threshold and onset_floor per row (``series.loudness_thresholds``).
    """
    w = Window.partitionBy(key).orderBy("t")
    f = features.withColumn("idx", F.row_number().over(w) - 1)
    active = protocol_frame() | X.truthy((F.col("rms") >= F.col("threshold")) & (F.col("tonality") >= 0.28) & (F.col("prominence_db") >= 6))
    f = f.withColumn("_on", active)
    last = F.max(F.when(F.col("_on"), F.col("idx"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    f = f.withColumn("_start", F.col("_on") & (last.isNull() | (F.col("idx") - last > 3))).withColumn("_seg", F.sum(F.col("_start").cast("int")).over(w))
    s = Window.partitionBy(key, "_seg")
    f = f.withColumn("_end", F.max(F.when(F.col("_on"), F.col("idx"))).over(s))
    f = f.withColumn("_lead", F.collect_list(F.struct("idx", "t", "rms", "frequency", "prominence_db")).over(w.rowsBetween(-8, -1)))
    core = f.where((F.col("_seg") > 0) & (F.col("idx") <= F.col("_end")))
    core = core.withColumn("_f0", F.percentile("frequency", F.lit(0.5)).over(s))
    g = core.groupBy(key, "_seg").agg(
        F.min("t").alias("_t0"), F.max("t").alias("_t1"), F.max("rms").alias("_peak"), F.avg("tonality").alias("tonality"), F.max("_f0").alias("frequency"),
        F.percentile(X.cents("frequency", "_f0"), F.lit(0.5)).alias("stability_cents"), F.avg("prominence_db").alias("prominence_db"), F.avg("concentration").alias("concentration"),
        F.count_if(protocol_frame()).alias("qualified"), F.min_by("_lead", "idx").alias("_lead"), F.min_by("onset_floor", "idx").alias("_floor"))
    holds = lambda p: (p["rms"] >= F.col("_floor")) | X.truthy((X.cents(p["frequency"], F.col("frequency")) <= 180) & (p["prominence_db"] >= 6))
    broken = F.array_max(F.transform(F.filter("_lead", lambda p: ~holds(p)), lambda p: p["idx"]))
    back = F.filter("_lead", lambda p: p["idx"] > F.coalesce(F.col("_b"), F.lit(-1)))
    g = g.withColumn("_b", broken).withColumn("_back", back)
    start = F.coalesce(F.array_min(F.transform("_back", lambda p: p["t"])), F.col("_t0"))
    g = g.withColumn("_s", start)
    return g.select(key, X.round_ms("_s").alias("start_s"), X.round_ms(F.col("_t1") + FRAME_S).alias("end_s"), X.round_ms(F.col("_t1") + FRAME_S - F.col("_s")).alias("duration_s"),
                    F.greatest("_peak", F.array_max(F.transform("_back", lambda p: p["rms"]))).alias("peak_rms"), "tonality", "frequency", "stability_cents", "prominence_db", "concentration", "qualified")


def merge_tones(segments: DataFrame, key: str = "attempt_id", max_gap: float = HOP_S * 8) -> DataFrame:
    """WN40, second half: adjacent segments of one pitch join; the pitch of the joined one is averaged on.

    Only neighbours within the gap can join, so the fold runs per stretch without a longer gap.
    """
    w = Window.partitionBy(key).orderBy("start_s")
    apart = F.coalesce(F.col("start_s") - F.lag("end_s").over(w) > max_gap, F.lit(True))
    d = segments.withColumn("_p", F.sum(apart.cast("int")).over(w))
    cols = ["start_s", "end_s", "duration_s", "peak_rms", "tonality", "frequency", "stability_cents", "prominence_db", "concentration", "qualified"]
    g = d.groupBy(key, "_p").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("items"))

    def joined(a, b):
        t = F.greatest(a["duration_s"] + b["duration_s"], F.lit(1e-6))
        avg = lambda c: ((a[c] * a["duration_s"] + b[c] * b["duration_s"]) / t).alias(c)
        return F.struct(a["start_s"].alias("start_s"), b["end_s"].alias("end_s"), X.round_ms(b["end_s"] - a["start_s"]).alias("duration_s"), F.greatest(a["peak_rms"], b["peak_rms"]).alias("peak_rms"), avg("tonality"),
                        ((a["frequency"] + b["frequency"]) / 2).alias("frequency"), F.greatest(F.coalesce(a["stability_cents"], F.lit(0.0)), F.coalesce(b["stability_cents"], F.lit(0.0))).alias("stability_cents"),
                        avg("prominence_db"), avg("concentration"), (a["qualified"] + b["qualified"]).alias("qualified"))

    def fold(k, x):
        last = F.element_at(k, -1)
        same = (F.size(k) > 0) & X.truthy((X.cents(F.get(k, F.size(k) - 1)["frequency"], x["frequency"]) <= 180) & (x["start_s"] - F.get(k, F.size(k) - 1)["end_s"] <= max_gap))
        tail = F.get(k, F.size(k) - 1)
        return F.when(same, F.concat(F.slice(k, 1, F.greatest(F.size(k) - 1, F.lit(0))), F.array(joined(tail, x)))).otherwise(F.concat(k, F.array(x)))
    return g.select(key, F.explode(F.aggregate("items", F.slice("items", 1, 0), fold)).alias("s")).select(key, "s.*")


def usable_tones(merged: DataFrame) -> DataFrame:
    return merged.where(F.col("duration_s").between(0.04, 1.4) & ((F.col("tonality") >= 0.28) | (F.coalesce("prominence_db", F.lit(0.0)) >= 14)))


REACH_S = 1.5


def tone_patterns(segments: DataFrame, key: str = "attempt_id", base=(480, 650), ratio=(1.8, 2.2)) -> DataFrame:
    """WN43: the best same-same-different triple of each recording; the earliest official one wins.

    Triples are range joins on time buckets of the longest gap, so a tone meets only its neighbours.
    """
    cols = ["start_s", "duration_s", "frequency", "tonality", "prominence_db", "qualified"]
    ok = segments.where((F.col("frequency") > 0) & (F.coalesce("stability_cents", F.lit(1e9)) <= 140) & (F.col("qualified") >= 4))
    s = ok.select(key, F.floor(F.col("start_s") / REACH_S).alias("_k"), *cols)
    nxt = lambda p: s.select(key, F.explode(F.array(F.col("_k"), F.col("_k") - 1)).alias("_k"), *[F.col(c).alias(p + c) for c in cols])
    gap = lambda a, b: F.col(b) - F.col(a)
    two = s.select(key, "_k", *[F.col(c).alias("a_" + c) for c in cols]).join(nxt("b_"), [key, "_k"]).where(gap("a_start_s", "b_start_s").between(0.25, 1.5)).withColumn("_k", F.floor(F.col("b_start_s") / REACH_S))
    df = two.join(nxt("c_"), [key, "_k"]).where(gap("b_start_s", "c_start_s").between(0.25, 1.5))
    g1, g2 = gap("a_start_s", "b_start_s"), gap("b_start_s", "c_start_s")
    mean = (g1 + g2) / 2
    pitch = (F.col("a_frequency") + F.col("b_frequency")) / 2
    avg3 = lambda c: (F.col("a_" + c) + F.col("b_" + c) + F.col("c_" + c)) / 3
    d1, d2 = F.col("a_duration_s"), F.col("b_duration_s")
    df = df.withColumns({"same_error": X.relative_difference("a_frequency", "b_frequency"), "final_difference": X.relative_difference("c_frequency", pitch), "final_ratio": F.col("c_frequency") / pitch, "_g1": g1, "_g2": g2,
                         "spread": F.abs(g1 - g2) / 2 / mean, "duration_spread": F.abs(d1 - d2) / 2 / F.greatest((d1 + d2) / 2, F.lit(1e-6)), "_ton": avg3("tonality"), "_prom": avg3("prominence_db"), "_pitch": pitch})
    df = df.where((F.abs(g1 - g2) <= F.greatest(F.lit(0.12), mean * 0.2)) & (F.col("same_error") <= 0.12) & (F.col("final_difference") >= 0.13) & (F.col("spread") <= 0.2) & (F.col("duration_spread") <= 0.65) & (F.col("_ton") >= 0.38) & (F.col("_prom") >= 12))
    score = F.col("_ton") * 30 + F.least(F.col("_prom"), F.lit(40.0)) * 1.5 + F.col("final_difference") * 80 - F.col("same_error") * 100 - F.col("spread") * 45 - F.col("duration_spread") * 15
    official = F.col("final_ratio").between(*ratio) & (F.col("same_error") <= 0.08) & F.col("_pitch").between(*base) & F.col("_g1").between(0.7, 1.3) & F.col("_g2").between(0.7, 1.3)
    df = df.withColumns({"score": score, "official": official})
    strong = (F.col("same_error") <= 0.04) & (F.least("a_qualified", "b_qualified") >= 6) & (F.least(d1, d2) >= 0.08) & (F.col("final_difference") >= 0.18) & F.col("official") & (1 - F.col("spread") >= 0.72)
    rank = F.struct((~F.col("official")).alias("o"), F.when(F.col("official"), F.col("c_start_s")).otherwise(0.0).alias("t"), (-F.col("score")).alias("s"), F.col("a_start_s").alias("x"), F.col("b_start_s").alias("y"), F.col("c_start_s").alias("z"))
    pick = F.struct("a_start_s", "b_start_s", "c_start_s", "a_frequency", "b_frequency", "c_frequency", F.col("c_duration_s").alias("c_d"), F.col("a_duration_s").alias("a_d"), F.col("b_duration_s").alias("b_d"), "score", "official", strong.alias("strong"))
    return df.groupBy(key).agg(F.min_by(pick, rank).alias("p")).select(key, "p.*")


def countdowns(segments: DataFrame, key: str = "attempt_id") -> DataFrame:
    """WN44: regular runs of three to five consecutive tones, best score first."""
    w = Window.partitionBy(key).orderBy("start_s")
    item = F.struct("start_s", "duration_s", "tonality", "peak_rms")
    s = segments.withColumn("_last", F.collect_list(item).over(w.rowsBetween(-4, 0)))
    seqs = F.transform(F.sequence(F.lit(3), F.lit(5)), lambda n: F.when(F.size("_last") >= n, F.slice("_last", -n, n)))
    s = s.select(key, F.explode(F.filter(seqs, lambda q: q.isNotNull())).alias("q")).withColumn("n", F.size("q"))
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda a, v: a + v)
    s = s.withColumn("_iv", F.transform(F.slice(F.col("q"), 2, 5), lambda x, i: x["start_s"] - F.get("q", i)["start_s"]))
    s = s.withColumn("_core", F.slice("q", 1, F.col("n") - 1))
    mean = lambda a: total(a) / F.size(a)
    s = s.withColumns({"_m": mean(F.col("_iv")), "_dm": mean(F.transform("_core", lambda x: x["duration_s"])), "_ton": mean(F.transform("q", lambda x: x["tonality"])), "_rms": mean(F.transform("q", lambda x: x["peak_rms"])),
                       "_er": mean(F.transform("_core", lambda x: x["peak_rms"]))})
    sd = lambda a, m: F.sqrt(mean(F.transform(a, lambda v: (v - m) * (v - m))))
    s = s.withColumns({"spread": sd(F.col("_iv"), F.col("_m")) / F.greatest("_m", F.lit(1e-6)), "dspread": sd(F.transform("_core", lambda x: x["duration_s"]), F.col("_dm")) / F.greatest("_dm", F.lit(1e-6))})
    s = s.where(F.col("_m").between(0.14, 1.6) & (F.col("spread") <= 0.34) & (F.col("dspread") <= 0.65) & (F.col("_ton") >= 0.34))
    fin = F.element_at("q", -1)
    score = F.col("n") * 30 + F.col("_ton") * 35 - F.col("spread") * 45 - F.col("dspread") * 15 + F.least(F.lit(20.0), F.col("_rms") * 120) + F.least(F.lit(12.0), fin["peak_rms"] / F.greatest("_er", F.lit(1e-6)) * 4)
    s = s.withColumns({"score": score, "final_s": fin["start_s"]})
    return s.groupBy(key).agg(F.min_by(F.struct("final_s", "n", "score"), F.struct((-F.col("score")).alias("s"), (-F.col("n")).alias("n"), F.col("final_s").alias("t"))).alias("b")).select(key, "b.*")


def lone_tone(segments: DataFrame, thresholds: DataFrame, key: str = "attempt_id") -> DataFrame:
    """WN44: one tone that stands out by 1.8 in loudness."""
    j = segments.join(thresholds, key)
    ok = F.col("duration_s").between(0.05, 1.4) & (F.col("tonality") >= 0.42) & (F.col("peak_rms") >= F.col("threshold") * 1.3)
    w = Window.partitionBy(key)
    j = j.withColumn("_ok", ok).withColumn("_best", F.min(F.when(F.col("_ok"), F.struct((-F.col("peak_rms")).alias("p"), F.col("start_s").alias("t")))).over(w))
    j = j.withColumn("_next", F.max(F.when(F.col("start_s") != F.col("_best.t"), F.col("peak_rms"))).over(w))
    return j.where((F.col("start_s") == F.col("_best.t")) & (F.coalesce("_next", F.lit(0.0)) * 1.8 <= F.col("peak_rms"))).select(key, "start_s")


def verdict(recordings: DataFrame, patterns: DataFrame, counts: DataFrame, lone: DataFrame, key: str = "attempt_id") -> DataFrame:
    """WN45: pattern, else regular countdown, else a lone tone, else nothing."""
    p = patterns.select(key, F.struct(F.col("c_start_s").alias("t"), F.when(F.col("strong"), "High").otherwise("Medium").alias("c"), F.lit("two-same-then-different").alias("k"), "official").alias("p"))
    c = counts.select(key, F.struct(F.col("final_s").alias("t"), F.lit("Low").alias("c"), F.lit("regular-countdown").alias("k"), F.lit(False).alias("official")).alias("q"))
    l = lone.select(key, F.struct(F.col("start_s").alias("t"), F.lit("Low").alias("c"), F.lit("single-prominent-beep").alias("k"), F.lit(False).alias("official")).alias("r"))
    df = recordings.join(p, key, "left").join(c, key, "left").join(l, key, "left").withColumn("v", F.coalesce("p", "q", "r"))
    return df.select(key, F.col("v").isNotNull().alias("found"), X.round_ms("v.t").alias("raw_time"), F.coalesce("v.c", F.lit("None")).alias("confidence"), F.col("v.k").alias("pattern"), F.when(F.col("v.official"), X.round_ms("v.t")).alias("search_hint_s"))


def reconcile_channels(mixed: DataFrame, channels: DataFrame, key: str = "attempt_id") -> DataFrame:
    """WN46: two complete channel patterns that agree tone by tone may replace an inconclusive mix.

    ``channels``: key, channel (0/1), strong, tones array<struct<start_s,end_s,frequency>> (three), raw_time.
    """
    ok = channels.where(F.col("strong") & (F.size("tones") == 3))
    l, r = (ok.where(F.col("channel") == c).select(key, F.col("tones").alias(f"t{c}"), F.col("raw_time").alias(f"r{c}")) for c in (0, 1))
    both = l.join(r, key)

    def gap(i):
        a, b = F.col("t0")[i], F.col("t1")[i]
        return F.greatest(a["start_s"], b["start_s"]) - F.least(a["end_s"], b["end_s"])
    pitch = X.all_of(*[X.relative_difference(F.col("t0")[i]["frequency"], F.col("t1")[i]["frequency"]) <= 0.04 for i in range(3)])
    agree = pitch & (gap(0) <= FRAME_S + 1e-9) & (gap(1) <= FRAME_S + 1e-9) & (gap(2) < 0) & (F.abs(F.col("r0") - F.col("r1")) <= FRAME_S + 2 * HOP_S + 1e-9)
    rec = both.where(X.truthy(agree)).select(key, F.least("r0", "r1").alias("_t"), F.when(F.col("r0") <= F.col("r1"), 0).otherwise(1).alias("_ch"))
    df = mixed.join(rec, key, "left")
    use = F.col("_t").isNotNull() & (F.col("confidence") != "High")
    return df.select(key, F.when(use, F.col("_t")).otherwise(F.col("raw_time")).alias("raw_time"), F.when(use, "High").otherwise(F.col("confidence")).alias("confidence"), F.when(use, F.col("_ch")).alias("recovered_channel"))


def stable_pitch_tones(features: DataFrame, parents: DataFrame, key: str = "attempt_id", tolerance: float = 120.0) -> DataFrame:
    """WN41: pitch-stable stretches inside a tone segment, one view per qualified frame, duplicates removed.

    Parents last at most 1.4 s (140 frames), so seeds meet only the frames of their own segment.
    """
    p = parents.where(F.col("duration_s") <= 1.4).select(key, F.col("start_s").alias("ps"), F.col("end_s").alias("pe"))
    f = features.join(p, key).where((F.col("t") >= F.col("ps") - HOP_S) & (F.col("t") <= F.col("pe"))).withColumn("q", protocol_frame())
    seg = Window.partitionBy(key, "ps").orderBy("t")
    f = f.withColumn("i", F.row_number().over(seg))
    seeds = f.where("q").select(key, "ps", F.col("frequency").alias("seed")).distinct()
    m = f.join(seeds, [key, "ps"]).where(F.col("q") & (X.cents("frequency", "seed") <= tolerance))
    run = Window.partitionBy(key, "ps", "seed").orderBy("i")
    m = m.withColumn("_r", F.sum(F.coalesce((F.col("i") - F.lag("i").over(run) > 3).cast("int"), F.lit(0))).over(run))
    keys = [key, "ps", "seed", "_r"]
    m = m.withColumn("_f0", F.percentile("frequency", F.lit(0.5)).over(Window.partitionBy(*keys)))
    g = m.groupBy(*keys).agg(F.min("t").alias("a"), F.max("t").alias("z"), F.min("i").alias("ia"), F.max("i").alias("iz"), F.avg("tonality").alias("tonality"), F.max("_f0").alias("frequency"),
                             F.percentile(X.cents("frequency", "_f0"), F.lit(0.5)).alias("stability_cents"), F.avg("prominence_db").alias("prominence_db"), F.avg("concentration").alias("concentration"), F.count("*").alias("qualified")).where("qualified >= 4")
    # many seeds describe the same stretch: keep one row per stretch before the loudness lookup
    g = g.withColumn("s", F.greatest(F.col("ps"), F.col("a") - HOP_S)).dropDuplicates([key, "ps", "ia", "iz", "qualified", "frequency"])
    loud = f.select(key, "ps", F.col("i").alias("_i"), "rms")
    g = g.join(loud, [key, "ps"]).where(F.col("_i").between(F.col("ia"), F.col("iz"))).groupBy(*[c for c in g.columns]).agg(F.max("rms").alias("peak_rms"))
    g = g.withColumns({"start_s": X.round_ms("s"), "end_s": X.round_ms(F.col("z") + FRAME_S), "duration_s": X.round_ms(F.col("z") + FRAME_S - F.col("s"))}).where(F.col("duration_s").between(0.04, 1.4))
    quality = F.col("qualified") * 2 + F.col("tonality") * 10 + F.col("prominence_db") * 0.2 - F.col("stability_cents") * 0.02
    cols = ["start_s", "end_s", "duration_s", "peak_rms", "tonality", "frequency", "stability_cents", "prominence_db", "concentration", "qualified"]
    g = g.select(key, quality.alias("quality"), *cols)
    # only overlapping stretches can be duplicates: fold per cluster of overlapping ones, best first
    w = Window.partitionBy(key).orderBy("start_s", "end_s")
    apart = F.coalesce(F.col("start_s") > F.max("end_s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    g = g.withColumn("_c", F.sum(apart.cast("int")).over(w))
    items = g.groupBy(key, "_c").agg(F.sort_array(F.collect_list(F.struct((-F.col("quality")).alias("o"), *cols))).alias("items"))
    same = lambda k, x: (X.cents(k["frequency"], x["frequency"]) <= tolerance) & (F.greatest(F.lit(0.0), F.least(k["end_s"], x["end_s"]) - F.greatest(k["start_s"], x["start_s"])) / F.greatest(F.lit(0.001), F.least(k["duration_s"], x["duration_s"])) >= 0.6)
    kept = F.aggregate("items", F.slice("items", 1, 0), lambda k, x: F.when(F.exists(k, lambda y: same(y, x)), k).otherwise(F.concat(k, F.array(x))))
    return items.select(key, F.explode(kept).alias("s")).select(key, *[f"s.{c}" for c in cols])


# The secondary profile for review (preparation and final pitch in Hz, tolerance).
SECONDARY = (880.0, 1760.0, 0.08)


def secondary_review(tones: DataFrame, key: str = "attempt_id") -> DataFrame:
    """WN47: a bounded 880/1760 Hz pattern as a place to look; it never votes."""
    prep, final, err = SECONDARY
    strong = (X.relative_difference("frequency", F.lit(prep)) <= err) & (F.col("qualified") >= 6) & (F.col("duration_s") >= 0.08) & (F.col("prominence_db") >= 18) & (F.col("stability_cents") <= 80)
    last = (X.relative_difference("frequency", F.lit(final)) <= err) & (F.col("qualified") >= 4) & (F.col("prominence_db") >= 14) & (F.col("stability_cents") <= 140)
    cols = ["start_s", "duration_s", "frequency", "tonality", "prominence_db"]
    named = lambda d, p: d.select(key, F.explode(F.array(F.floor(F.col("start_s") / REACH_S), F.floor(F.col("start_s") / REACH_S) - 1)).alias("_k"), *[F.col(c).alias(p + c) for c in cols])
    a = tones.where(strong).select(key, F.floor(F.col("start_s") / REACH_S).alias("_k"), *[F.col(c).alias("a_" + c) for c in cols])
    df = a.join(named(tones.where(strong), "b_"), [key, "_k"]).withColumn("_k", F.floor(F.col("b_start_s") / REACH_S)).join(named(tones.where(last), "c_"), [key, "_k"])
    g1, g2 = F.col("b_start_s") - F.col("a_start_s"), F.col("c_start_s") - F.col("b_start_s")
    mean, pitch = (g1 + g2) / 2, (F.col("a_frequency") + F.col("b_frequency")) / 2
    d1, d2 = F.col("a_duration_s"), F.col("b_duration_s")
    same, spread, dspread = X.relative_difference("a_frequency", "b_frequency"), F.abs(g1 - g2) / 2 / mean, F.abs(d1 - d2) / 2 / F.greatest((d1 + d2) / 2, F.lit(1e-6))
    avg3 = lambda c: (F.col("a_" + c) + F.col("b_" + c) + F.col("c_" + c)) / 3
    ok = (g1.between(0.7, 1.3) & g2.between(0.7, 1.3) & (same <= err) & (F.col("c_frequency") / pitch).between(1.8, 2.2) & (F.abs(g1 - g2) <= F.greatest(F.lit(0.12), mean * 0.2)) & (spread <= 0.2) & (dspread <= 0.65)
          & (avg3("tonality") >= 0.38) & (avg3("prominence_db") >= 12))
    score = avg3("tonality") * 30 + F.least(avg3("prominence_db"), F.lit(40.0)) * 1.5 + X.relative_difference("c_frequency", pitch) * 80 - same * 100 - spread * 45 - dspread * 15
    df = df.where(ok).withColumn("score", score)
    g = df.groupBy(key).agg(F.min_by(F.struct("a_start_s", "b_start_s", "c_start_s", "score"), F.struct("c_start_s", (-F.col("score")).alias("s"), "a_start_s", "b_start_s")).alias("p"))
    return g.select(key, F.col("p.c_start_s").alias("raw_time"), "p.a_start_s", "p.b_start_s", X.round_us("p.score").alias("score"), F.lit("Medium").alias("confidence"), F.lit(False).alias("vote_allowed"))
