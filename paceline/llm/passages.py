"""Repeated passages in notes, found exactly by super-k-mer partitioning over words.

Method. A window is window_words consecutive words. Its minimiser is the smallest hash among its runs of GRAM words, the
leftmost of equal ones. Consecutive windows whose minimiser lies at the same place form a super-k-mer; equal windows have
equal minimisers. A minimiser that stands at one place only can't repeat a window, so only super-k-mers of the others
travel, each as one packed string, to the bucket of their minimiser, where sorting counts the windows exactly.
Minimisers met more often than HOT times are dealt by window instead, so that no bucket grows with one passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import WordHashes, expand, grams, hash_words, mixed, row_key, sliding_min, text_batches, whole_groups

#: Words of a minimiser.
GRAM = 10
#: Super-k-mers of one minimiser that may meet in one bucket; beyond, its windows are counted by their 128-bit digests.
HOT = 32_768
#: Super-k-mers sorted together.
ROWS_AT_ONCE = 8_000
#: Positions handled together; the low 24 bits of a sort key hold a position.
SLICE = 1 << 23


def minimiser_places(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of width hashes, the place of its smallest (by the upper 40 bits, then the leftmost)."""
    out = []
    for at in range(0, max(0, len(hashes) - width + 1), SLICE):
        part = hashes[at : at + SLICE + width - 1]
        keys = (part & ~np.uint64(0xFFFFFF)) | np.arange(len(part), dtype=np.uint64)
        out.append((sliding_min(keys, width) & np.uint64(0xFFFFFF)).astype(np.int64) + at)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def super_kmers(ids: np.ndarray, lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, row, first window (from the row's start) and number of windows of each super-k-mer."""
    gram = min(GRAM, window)
    hashes = grams(ids, gram)
    places = minimiser_places(hashes, window - gram + 1)
    row = np.repeat(np.arange(len(lengths)), lengths)
    first = np.cumsum(lengths) - lengths
    count = len(places)
    whole = row[:count] == row[window - 1 : window - 1 + count] if count else np.empty(0, bool)
    starts_here = np.ones(count, bool)
    starts_here[1:] = (places[1:] != places[:-1]) | ~whole[:-1]
    starts = np.flatnonzero(starts_here & whole)
    ends = np.flatnonzero(np.append(starts_here[1:] | ~whole[1:], True) & whole) if count else starts
    own = row[starts]
    return hashes[places[starts]].view(np.int64), own, starts - first[own], ends - starts + 1


def window_ranks(codes: np.ndarray, window: int) -> np.ndarray:
    """Equal numbers for equal windows of codes, by prefix doubling; a place too near the end has no window."""
    ranks, length = codes, 1
    while length * 2 <= window:
        ranks, length = paired(ranks[:-length], ranks[length:]), length * 2
    return paired(ranks[: len(ranks) - (window - length)], ranks[window - length :]) if length < window else ranks


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1].astype(np.int64)


def remove_repeated_passages(attempts: DataFrame, attempt_id: str = "attempt_id", notes: str = "notes", window_words: int = 35, carry: tuple[str, ...] = (), keep_untouched: bool = False) -> DataFrame:
    """Notes without passages that stand elsewhere too: (attempt_id, n_words, n_removed, notes, spans).

    Words lie between ASCII white space and are compared unchanged. Each word covered by a window of window_words words
    whose sequence also starts at another place, in the same notes or in any others, is removed; windows are judged on
    the input. notes holds the kept words joined by one space
    (with keep_untouched, notes that lose nothing are returned as they are); spans the removed stretches as (first, last) word numbers.
    Null notes have no words and give an empty text. Every row counts and is returned: a repeated row makes all its
    windows repeat. Notes shorter than a window lose nothing. Columns named in carry are returned as they are, behind the
    others; further columns are ignored.
    """
    docs = attempts.select(F.col(attempt_id).cast("string").alias("id"), F.col(notes).cast("string").alias("text"), *[F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)]).withColumn("rk", row_key("id", "text"))
    carried = [f"carried_{i}" for i in range(len(carry))]
    places = "mini long, rk long, start int"

    def narrow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for frame, words in text_batches(batches, "text", False):
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            mini, own, start, _ = super_kmers(hash_words([w for row in words for w in row], known), lengths, window_words)
            yield pd.DataFrame({"mini": mini, "rk": frame["rk"].to_numpy()[own], "start": start.astype(np.int32)})

    found = docs.select("rk", "text").mapInPandas(narrow, places)
    again = found.groupBy("mini").agg(F.count("*").alias("c")).where("c > 1")
    suspects = (
        found.join(again, "mini")
        .groupBy("rk")
        .agg(F.collect_list(F.when(F.col("c") <= HOT, F.col("start"))).alias("cold"), F.collect_list(F.when(F.col("c") > HOT, F.col("start"))).alias("hot"))
    )
    texts = docs.select("rk", "id", "text", *carried).repartition("rk")
    marked = texts.join(suspects, "rk")  # all columns, so that the texts are shuffled once for all their uses

    def chosen(frame: pd.DataFrame, words: list[list[bytes]], column: str, known: WordHashes) -> tuple[np.ndarray, ...]:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ids = hash_words([w for row in words for w in row], known)
        mini, own, start, count = super_kmers(ids, lengths, window_words)
        wanted = [np.asarray(x, np.int64) for x in frame[column]]
        marks = np.repeat(np.arange(len(wanted)), [len(x) for x in wanted]) * (1 << 40) + (np.concatenate(wanted) if wanted else 0)
        keep = np.isin(own * (1 << 40) + start, marks)
        return ids, lengths, mini[keep], own[keep], start[keep], count[keep]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for frame, words in text_batches(batches, "text", False):
            _, _, mini, own, start, count = chosen(frame, words, "cold", known)
            rk = frame["rk"].to_numpy()
            for at in range(0, len(mini), 20_000):
                part = slice(at, at + 20_000)
                packed = [b" ".join(words[r][s : s + n + window_words - 1]).decode("utf-8", "surrogatepass") for r, s, n in zip(own[part].tolist(), start[part].tolist(), count[part].tolist(), strict=True)]
                yield pd.DataFrame({"mini": mini[part], "packed": packed, "rk": rk[own[part]], "start": start[part].astype(np.int32)})

    def sort_and_count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, "mini", ROWS_AT_ONCE):
            rows = [ascii_split(x) for x in frame["packed"]]
            codes: dict[bytes, int] = {}
            flat = np.fromiter((codes.setdefault(w, len(codes)) for row in rows for w in row), np.int64)
            lengths = np.fromiter(map(len, rows), np.int64, len(rows))
            windows = lengths - window_words + 1
            at = expand(np.cumsum(lengths) - lengths, windows)
            rank = window_ranks(flat, window_words)[at]
            twice = np.bincount(rank)[rank] > 1
            own = np.repeat(np.arange(len(rows)), windows)
            offset = np.arange(len(own)) - (np.cumsum(windows) - windows)[own]
            yield runs(twice, own, offset, frame["rk"].to_numpy(), frame["start"].to_numpy())

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for frame, words in text_batches(batches, "text", False):
            ids, lengths, _, own, start, count = chosen(frame, words, "hot", known)
            first = np.cumsum(lengths) - lengths
            at = expand(first[own] + start, count)
            rk = np.repeat(frame["rk"].to_numpy()[own], count)
            place = expand(start, count).astype(np.int32)
            one, two = grams(ids, window_words), grams(mixed(ids ^ np.uint64(0x9E3779B97F4A7C15)), window_words)
            for i in range(0, len(at), 200_000):
                j = slice(i, i + 200_000)
                yield pd.DataFrame({"d1": one[at[j]].view(np.int64), "d2": two[at[j]].view(np.int64), "rk": rk[j], "start": place[j]})

    strings = marked.where("size(cold) > 0").drop("hot").mapInPandas(pack, "mini long, packed string, rk long, start int")
    cold = strings.repartition("mini").sortWithinPartitions("mini").mapInPandas(sort_and_count, "rk long, start int, n int")
    windows = marked.where("size(hot) > 0").drop("cold").mapInPandas(digest, "d1 long, d2 long, rk long, start int")
    repeated = windows.groupBy("d1", "d2").agg(F.count("*").alias("c")).where("c > 1").select("d1", "d2")
    hot = windows.join(repeated, ["d1", "d2"], "left_semi").select("rk", "start", F.lit(1).alias("n"))
    spans = cold.union(hot).groupBy("rk").agg(F.collect_list(F.struct("start", "n")).alias("runs"))

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, words in text_batches(batches, "text", False):
            lost, kept, spans = [], [], []
            for row, found, text in zip(words, frame["runs"], frame["text"], strict=True):
                if found is None or not len(found):
                    kept.append(text or "" if keep_untouched else b" ".join(row).decode("utf-8", "surrogatepass"))
                    lost.append(0)
                    spans.append([])
                    continue
                step = np.zeros(len(row) + 1, np.int64)
                starts = np.array([x["start"] for x in found])
                np.add.at(step, starts, 1)
                np.add.at(step, starts + np.array([x["n"] for x in found]) + window_words - 1, -1)
                gone = np.cumsum(step)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                spans.append([{"first": int(a), "last": int(b) - 1} for a, b in zip(edge[::2], edge[1::2], strict=True)])
                kept.append(b" ".join([row[i] for i in np.flatnonzero(~gone).tolist()]).decode("utf-8", "surrogatepass"))
                lost.append(int(gone.sum()))
            yield pd.DataFrame({"id": frame["id"], "n_words": list(map(len, words)), "n_removed": lost, "kept": kept, "spans": spans} | {c: frame[c].to_numpy() for c in carried})

    kind = attempts.schema[attempt_id].dataType.simpleString()
    types = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carried)
    out = texts.join(spans, "rk", "left").mapInPandas(remove, "id string, n_words long, n_removed long, kept string, spans array<struct<first:int,last:int>>" + types)
    return out.select(F.col("id").cast(kind).alias(attempt_id), "n_words", "n_removed", F.col("kept").alias(notes), "spans", *[F.col(f"carried_{i}").alias(c) for i, c in enumerate(carry)])


def ascii_split(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def runs(twice: np.ndarray, own: np.ndarray, offset: np.ndarray, rk: np.ndarray, start: np.ndarray) -> pd.DataFrame:
    """Stretches of windows that repeat, inside each packed string."""
    begins = twice & ~np.concatenate([[False], twice[:-1] & (own[1:] == own[:-1])]) if len(twice) else twice
    stops = twice & ~np.concatenate([twice[1:] & (own[1:] == own[:-1]), [False]]) if len(twice) else twice
    a, b = np.flatnonzero(begins), np.flatnonzero(stops)
    return pd.DataFrame({"rk": rk[own[a]], "start": (start[own[a]] + offset[a]).astype(np.int32), "n": (b - a + 1).astype(np.int32)})
