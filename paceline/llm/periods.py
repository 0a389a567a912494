"""Periodic runs of words in notes, by a dictionary of basic factors.

Method. The factors of length 1, 2, 4, ... of a text are named by pairing the names of their halves, equal names for equal
factors. Where a factor of length L stands again within 2 L words, the distance to its successor proposes a period; places
in a row with the same distance are one arithmetic progression of occurrences and give one stretch. Factors of at least
the period extend it as far as words that distance apart agree: inside a run of period q and at least 3 q words the
successor of each factor of the smallest L >= q stands exactly q words further, and no stretch of them has a smaller period.
Stretches found at several lengths are kept once. Factors that stand once only are left out of the longer ones, which
can't repeat either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import text_batches


def named(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of equal values, which of them stand twice or more, and the places sorted by value, then place."""
    order = np.argsort(values, kind="stable")
    new = np.ones(len(values), bool)
    new[1:] = values[order[1:]] != values[order[:-1]]
    names = np.empty(len(values), np.int64)
    names[order] = np.cumsum(new) - 1
    return names, (np.bincount(names, minlength=1) > 1)[names], order


def periodic_runs(codes: np.ndarray, least_length: int, least_repeats: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of each run, sorted by start, then period; equal codes are equal words."""
    found = [np.empty((0, 3), np.int64)]
    length = 1
    names, twice, order = named(codes)
    places = np.arange(len(codes))  # of names, ascending
    while len(places) and twice.any():
        at, same = places[order], names[order]
        gap = at[1:] - at[:-1]
        near = (same[1:] == same[:-1]) & (gap <= 2 * length)
        start, period = at[:-1][near], gap[near]
        by_place = np.argsort(start, kind="stable")
        start, period = start[by_place], period[by_place]
        # Places in a row with one distance are a progression; it reaches over the last factor and one distance more. With a
        # distance up to the factor's length this is the whole stretch: a word more on either side would be a further place.
        # A longer distance is only a proposal, which the doubled factor extends.
        head = np.ones(len(start), bool)
        head[1:] = (start[1:] != start[:-1] + 1) | (period[1:] != period[:-1])
        heads = np.flatnonzero(head)
        tails = np.append(heads[1:], len(start))[: len(heads)] - 1
        first, period = start[heads], period[heads]
        size = start[tails] + length + period - first
        whole = (period <= length) & (size >= np.maximum(least_length, least_repeats * period))
        found.append(np.stack([first[whole], size[whole], period[whole]], 1))
        # Names of the doubled factors: both halves must stand twice or more.
        kept, kept_names = places[twice], names[twice]
        right = np.searchsorted(kept, kept + length)
        paired = (right < len(kept)) & (kept[np.minimum(right, len(kept) - 1)] == kept + length)
        places = kept[paired]
        names, twice, order = named(kept_names[paired] * (int(kept_names.max(initial=0)) + 1) + kept_names[right[paired]])
        length *= 2
    runs = np.unique(np.concatenate(found), axis=0)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    return runs[:, 0], runs[:, 1], runs[:, 2]


def find_periodic_runs(attempts: DataFrame, attempt_id: str = "attempt_id", notes: str = "notes", least_length: int = 24, least_repeats: int = 3) -> DataFrame:
    """Runs of words in the notes of each attempt: (attempt_id, n_words, runs, notes).

    Words lie between ASCII white space and are compared unchanged, numbered from 0. A run is a stretch of words with the
    smallest period p (words p apart are the same) of at least least_length words and least_repeats periods (3 or more),
    that no neighbouring word continues. runs holds (start, length, period) by start, then period; runs may overlap. notes
    are the words left, joined by one space: a word goes when any run contains it behind the run's first period words.
    Null notes have no words and give an empty text, short ones no runs; every row is returned, repeated ones and null
    ids too. Further columns are ignored. Rows don't meet each other: there is no shuffle, a text is handled in one task.
    """
    if least_repeats < 3:
        raise ValueError("a run needs at least three periods")
    rows = attempts.select(F.col(attempt_id).cast("string").alias("id"), F.col(notes).cast("string").alias("text"))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, words in text_batches(batches, "text", False):
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            codes, flat, base = [], {}, 0
            for row in words:  # each text has numbers of its own, so that no factor repeats across texts
                flat = {}
                codes.append(np.fromiter((flat.setdefault(w, len(flat)) for w in row), np.int64, len(row)) + base)
                base += len(flat)
            # Texts are told apart by a word of its own between them.
            ends = np.cumsum(lengths + 1)
            joined = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
            joined[ends - 1] = base + np.arange(len(ends))
            for code, end, n in zip(codes, ends.tolist(), lengths.tolist(), strict=True):
                joined[end - 1 - n : end - 1] = code
            start, length, period = periodic_runs(joined, least_length, least_repeats)
            own = np.searchsorted(ends, start, side="right")
            step = np.zeros(len(joined) + 1, np.int64)
            np.add.at(step, start + period, 1)
            np.add.at(step, start + length, -1)
            gone = np.cumsum(step)[:-1] > 0
            local = start - (ends - lengths - 1)[own] if len(own) else start
            listed: list[list[dict]] = [[] for _ in words]
            for i, s, n, p in zip(own.tolist(), local.tolist(), length.tolist(), period.tolist(), strict=True):
                listed[i].append({"start": s, "length": n, "period": p})
            left = []
            for i, row in enumerate(words):
                lost = gone[ends[i] - 1 - lengths[i] : ends[i] - 1] if listed[i] else None
                left.append(b" ".join(row if lost is None else [row[j] for j in np.flatnonzero(~lost).tolist()]).decode("utf-8", "surrogatepass"))
            yield pd.DataFrame({"id": frame["id"].to_numpy(), "n_words": lengths, "runs": listed, "left": left})

    kind = attempts.schema[attempt_id].dataType.simpleString()
    found = rows.mapInPandas(find, "id string, n_words long, runs array<struct<start:long,length:long,period:long>>, left string")
    return found.select(F.col("id").cast(kind).alias(attempt_id), "n_words", "runs", F.col("left").alias(notes))
