"""Usable notes by importance resampling: n-gram models of target and raw notes, sampled by Gumbel top-k.

Method. Both models say how likely a note holds an n-gram: words, pairs of words, five letters of a word and four or eight
equal words in a row. N-grams are counted by hashes of 44 bits, without buckets, so that none inherits what another one
means however many there are. The target model counts notes labelled usable, the raw model all notes. First the n-grams of
the labelled notes are counted; of those in two notes or more, the ones that tell usable notes from others by more than
chance (and the commonest, which set the scale) are then counted over all notes. A note's log weight is the sum over its
n-grams of the log ratio of the two models. Gumbel noise is added and the notes with the largest sums are the sample.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import WordHashes, cut, hash_words, mixed, row_key, small_batches, text_batches

#: Bits of an n-gram's hash; the others of a 63-bit key number the rows of a batch.
HASH_BITS = 44
#: Words whose n-grams a task takes at once, n-grams that it gathers before it hands their counts on, and the commonest n-grams, which set the scale of the models.
WORDS, GATHERED, COMMON = 25_000, 500_000, 5_000
#: Words whose hash a task remembers.
REMEMBERED = 100_000
#: Of cuts whose kept shares differ by no more than this from the best, the one that keeps most is taken.
NEARLY_BEST = 0.005
#: Values of a step of the search for the k-th largest key, and keys that are sorted at its end.
STEPS, SORTED_AT_ONCE = 1024, 5_000


def features(rows: list[list[bytes]], known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct n-grams of each row, in the order of rows."""
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    ids = hash_words([w for row in rows for w in row], known)
    row = np.repeat(np.arange(len(rows)), lengths)
    same_row = row[1:] == row[:-1]
    pairs = mixed((ids[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (ids[1:] * np.uint64(0xC2B2AE3D27D4EB4F)))[same_row]
    # Five letters of a word, its bounds (spaces) included, packed into one number.
    texts = [b" " + b" ".join(own) + b" " if own else b"" for own in rows]
    letters = np.frombuffer(b"".join(texts), np.uint8)
    letter_row = np.repeat(np.arange(len(rows)), np.fromiter(map(len, texts), np.int64, len(texts)))
    n = max(0, len(letters) - 4)
    inner = letters != 32
    inside = inner[1 : n + 1] & inner[2 : n + 2] & inner[3 : n + 3]
    packed = np.zeros(n, np.uint64)
    for j in range(5):
        packed |= letters[j : n + j].astype(np.uint64) << np.uint64(8 * j)
    fives = mixed(packed[inside] + np.uint64(0x9E3779B97F4A7C15))
    equal = same_row & (ids[1:] == ids[:-1])
    four = equal[:-2] & equal[1:-1] & equal[2:] if len(equal) > 2 else np.zeros(0, bool)
    eight = four[:-4] & equal[3 : len(four) - 1] & four[4:] if len(four) > 4 else np.zeros(0, bool)
    repeats = [(np.flatnonzero(x), np.uint64(v)) for x, v in ((four, 0x4444), (eight, 0x8888))]
    rows_of = np.concatenate([row, row[1:][same_row], letter_row[:n][inside], *[row[at] for at, _ in repeats]])
    hashes = np.concatenate([mixed(ids), pairs, fives, *[np.full(len(at), mixed(np.array([v]))[0]) for at, v in repeats]])
    keys = np.sort((rows_of << HASH_BITS) | (hashes >> np.uint64(64 - HASH_BITS)).astype(np.int64))
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    return keys >> HASH_BITS, keys & ((1 << HASH_BITS) - 1)


def counted(keys: list[np.ndarray], flags: list[np.ndarray]) -> pd.DataFrame:
    """How often each n-gram stands in labelled notes, and in usable ones."""
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    target = np.bincount(where, weights=np.concatenate(flags), minlength=len(key)).astype(np.int64)
    return pd.DataFrame({"key": key, "labelled": np.bincount(where, minlength=len(key)), "target": target})


def log_ratios(target: np.ndarray, raw: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each n-gram the log ratio of the models, relative to the ratio that most of the common n-grams have.

    It is 0 where the two differ by less than a factor of two: many small differences would only add up with a note's
    length.
    """
    ratio = np.log((target + 0.5) / (raw * usual_share(target[common], raw[common]) + 0.5))
    ratio[np.abs(ratio) < math.log(2)] = 0
    return ratio.astype(np.float32)


def usual_share(part: np.ndarray, whole: np.ndarray) -> float:
    """The share that frequent n-grams have in the median."""
    order = np.argsort(part / whole, kind="stable")
    middle = np.searchsorted(np.cumsum(whole[order]), whole.sum() / 2)
    return max(part[order[middle]] / whole[order[middle]], 1e-9)


def best_cut(weights: np.ndarray, usable: np.ndarray) -> float:
    """The log weight that best parts labelled usable notes from the others (largest difference of the kept shares)."""
    if usable.all() or not usable.any():
        return -math.inf
    order = np.argsort(weights, kind="stable")
    w, u = weights[order], usable[order]
    lost_good = np.concatenate([[0], np.cumsum(u)]) / u.sum()
    lost_bad = np.concatenate([[0], np.cumsum(~u)]) / (~u).sum()
    edges = np.concatenate([[True], w[1:] > w[:-1], [True]])
    gain = np.where(edges, lost_bad - lost_good, -1)
    best = int(np.flatnonzero(gain >= gain.max() - NEARLY_BEST)[0])
    if best == 0:
        return -math.inf
    return float((w[best - 1] + w[best]) / 2) if best < len(w) else float(w[-1]) + 1


def sample_usable_notes(
    attempts: DataFrame, labels: DataFrame, attempt_id: str = "attempt_id", notes: str = "notes", usable: str = "usable", keep: int | None = None, labelled_rows: int = 100_000, seed: int = 1, carry: tuple[str, ...] = ()
) -> DataFrame:
    """A sample of notes that reads like the notes labelled usable: (attempt_id, log_weight, sample_key, kept).

    labels holds attempt_id and usable (boolean or 0/1; null or unknown ids count for nothing; of repeated ids all labels
    must agree, else the id counts as not usable). The target model is fitted on at most labelled_rows labels, those of
    the smallest hash; the raw model counts all notes. keep is the size of the sample; by default it is the number of
    notes whose log weight lies above the cut that best parts the labelled notes, so that a corpus in good order is kept
    nearly whole. The sample is drawn without replacement in proportion to the weights (Gumbel top-k); the noise of a
    note depends on its id, its text and seed only, so that repeated rows share their fate and a lost task repeats it.
    Notes that tie with the last of the sample are kept. Null or blank notes have weight 1 (log weight 0). Without
    usable labels all weights are 1. Every row is returned; of further columns only those of carry are kept.
    """
    spark = attempts.sparkSession
    kind = attempts.schema[attempt_id].dataType.simpleString()
    rows = attempts.select(F.col(attempt_id).cast("string").alias("id"), F.col(notes).cast("string").alias("text"), *[F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)])
    carried = [f"carried_{i}" for i in range(len(carry))]
    types = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in carried)
    label = labels.where(F.col(attempt_id).isNotNull() & F.col(usable).isNotNull()).groupBy(F.col(attempt_id).cast("string").alias("id")).agg(F.min(F.col(usable).cast("int")).alias("usable"))
    # At most labelled_rows rows of an id and a flag: small enough to be sent to every executor.
    fitted = label.orderBy(F.xxhash64("id"), "id").limit(labelled_rows)
    marked = rows.join(F.broadcast(fitted), "id", "left")

    def count_labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes(REMEMBERED)
        keys, flags, size = [], [], 0
        for frame, words in text_batches(batches, "text", False, WORDS):
            row, key = features(words, known)
            keys.append(key)
            flags.append((frame["usable"] == 1).to_numpy()[row])
            size += len(key)
            if size >= GATHERED:
                out = counted(keys, flags)
                keys, flags, size = [], [], 0
                yield out
        if size:
            yield counted(keys, flags)

    labelled = marked.where("usable is not null").select("text", "usable").mapInPandas(count_labelled, "key long, labelled long, target long")
    with small_batches(spark):
        grams = cut(labelled.groupBy("key").agg(F.sum("labelled").alias("labelled"), F.sum("target").alias("target")).where("labelled > 1"))
    common = grams.orderBy(F.desc("labelled"), "key").limit(COMMON).toPandas()
    keys, ratios = np.empty(0, np.int64), np.empty(0, np.float32)
    if common["target"].any():
        # N-grams whose Poisson deviance among labelled notes is more than chance exceeds in few of them.
        expected = F.col("labelled") * F.lit(float(usual_share(common["target"].to_numpy(), common["labelled"].to_numpy())))
        deviance = 2 * (F.when(F.col("target") > 0, F.col("target") * F.log(F.col("target") / expected)).otherwise(0.0) - (F.col("target") - expected))
        telling = grams.where(deviance >= F.lit(1.5 * math.log(max(2, grams.count())))).select("key", "labelled", "target").toPandas()
        held = pd.concat([telling, common]).drop_duplicates("key").sort_values("key", ignore_index=True)
        wanted = spark.sparkContext.broadcast(held["key"].to_numpy())

        def count_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known, keys = WordHashes(REMEMBERED), wanted.value
            raw = np.zeros(len(keys), np.int64)
            for _, words in text_batches(batches, "text", False, WORDS):
                at, found = places(keys, features(words, known)[1])
                raw += np.bincount(at[found], minlength=len(keys))
            yield pd.DataFrame({"key": keys, "raw": raw})[raw > 0]

        with small_batches(spark):
            raw = rows.select("text").mapInPandas(count_all, "key long, raw long").groupBy("key").agg(F.sum("raw").alias("raw")).toPandas()
        held = held.merge(raw, on="key").sort_values("key", ignore_index=True)
        ratios = log_ratios(held["target"].to_numpy(), held["raw"].to_numpy(), held["key"].isin(common["key"]).to_numpy())
        says = (ratios != 0) & held["key"].isin(telling["key"]).to_numpy()
        keys, ratios = held["key"].to_numpy()[says], ratios[says]
    model = spark.sparkContext.broadcast((keys, ratios))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, (keys, ratios) = WordHashes(REMEMBERED), model.value
        for frame, words in text_batches(batches, "text", False, WORDS):
            row, key = features(words, known)
            at, found = places(keys, key)
            weight = np.bincount(row[found], weights=ratios[at[found]], minlength=len(words))
            noise = frame["noise"].to_numpy()
            uniform = ((noise.view(np.uint64) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
            yield pd.DataFrame({"id": frame["id"], "usable": frame["usable"], "log_weight": weight, "sample_key": weight - np.log(-np.log(uniform))} | {c: frame[c].to_numpy() for c in carried})

    with small_batches(spark):
        scored = cut(marked.withColumn("noise", F.xxhash64(row_key("id", "text"), F.lit(seed))).mapInPandas(score, "id string, usable int, log_weight double, sample_key double" + types))
    if keep is None:
        seen = scored.where("usable is not null").orderBy(F.xxhash64("id"), "id").limit(labelled_rows).select("log_weight", "usable").toPandas()
        least = best_cut(seen["log_weight"].to_numpy(), seen["usable"].to_numpy() == 1)
        keep = scored.where(F.col("log_weight") > F.lit(least)).count()
    threshold = kth_largest(scored, "sample_key", keep)
    return scored.select(F.col("id").cast(kind).alias(attempt_id), "log_weight", "sample_key", (F.col("sample_key") >= F.lit(threshold)).alias("kept"), *[F.col(f"carried_{i}").alias(c) for i, c in enumerate(carry)])


def places(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of wanted stands in sorted keys, and whether it does."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    near = np.zeros(1 << 20, bool)
    near[keys & ((1 << 20) - 1)] = True
    maybe = np.flatnonzero(near[wanted & ((1 << 20) - 1)])
    at, found = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at[maybe] = np.minimum(np.searchsorted(keys, wanted[maybe]), len(keys) - 1)
    found[maybe] = keys[at[maybe]] == wanted[maybe]
    return at, found


def kth_largest(rows: DataFrame, column: str, k: int) -> float:
    """The k-th largest value, exactly: counts of STEPS ranges, then of the range that holds it, until few are left to sort."""
    if k <= 0:
        return math.inf
    low, high, total = rows.agg(F.min(column), F.max(column), F.count(column)).first()
    if not total or k >= total:
        return -math.inf
    above = 0
    while True:
        inside = rows.where((F.col(column) >= F.lit(low)) & (F.col(column) <= F.lit(high)))
        width = (high - low) / STEPS
        if width <= 0 or low + width == low:
            return low
        place = F.least(F.lit(STEPS - 1), F.floor((F.col(column) - F.lit(low)) / F.lit(width)))
        counts = inside.groupBy(place.alias("place")).agg(F.count("*").alias("c"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for r in sorted(counts, key=lambda r: -r["place"]):
            if above + r["c"] >= k:
                break
            above += r["c"]
        low, high = r["lo"], r["hi"]
        if low == high:
            return low
        if r["c"] <= SORTED_AT_ONCE:
            some = rows.where((F.col(column) >= F.lit(low)) & (F.col(column) <= F.lit(high))).select(column).toPandas()[column].sort_values(ascending=False)
            return float(some.iloc[k - above - 1])
