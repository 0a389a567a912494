"""Helpers of the text and archive operators: word hashes, streamed groups, reliable cuts and connected components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Distinct words whose hash a Python worker remembers; it then starts afresh, which changes no result.
REMEMBERED_WORDS = 400_000
#: Words handled at once inside a task.
WORDS_AT_ONCE = 400_000
#: Edges for each task of a component search.
EDGES_AT_ONCE = 200_000
#: Texts that go to a Python worker in one piece: Spark holds a piece twice outside the heap, the worker once more.
TEXTS_AT_ONCE = 1_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where none is set (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = getattr(shared_folder, "own", None) or "file://" + tempfile.mkdtemp(prefix="paceline-")
        shared_folder.own = folder
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


@contextmanager
def setting(spark: SparkSession, name: str, value: object) -> Iterator[None]:
    """A setting of the session for the actions inside; afterwards it is as before."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(value))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def small_batches(spark: SparkSession):
    """Actions inside hand texts to Python TEXTS_AT_ONCE at a time, or fewer where the session says so."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = int(spark.conf.get(name))
    return setting(spark, name, min(held, TEXTS_AT_ONCE) if held > 0 else TEXTS_AT_ONCE)


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, kept in the shared folder: later steps read them again instead of running df again.

    What was shuffled for them is deleted at once, not when the driver happens to collect its garbage.
    """
    shared_folder(df.sparkSession)
    with setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        return df.select("*").checkpoint()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.copy()
    for _ in range(2):
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class WordHashes(dict):
    """The 64-bit hash of a word in UTF-8, remembered for up to `most` words."""

    def __init__(self, most: int = REMEMBERED_WORDS) -> None:
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


def ascii_words(text: str | None, fold: bool) -> list[bytes]:
    """Words between ASCII white space; fold lower-cases A-Z only."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if fold else raw).split()


def hash_words(words: list[bytes], known: WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def grams(ids: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of size words."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, np.uint64(size))
    for j in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[j : n + j]
        h ^= h >> np.uint64(29)
    return mixed(h)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of width values, by doubling."""
    n, reach, low = len(values) - width + 1, 1, values
    if n <= 0:
        return values[:0]
    while reach * 2 <= width:
        low, reach = np.minimum(low[:-reach], low[reach:]), reach * 2
    return np.minimum(low[:n], low[width - reach : width - reach + n])


def text_batches(batches: Iterable[pd.DataFrame], text: str, fold: bool, words_at_once: int = WORDS_AT_ONCE) -> Iterator[tuple[pd.DataFrame, list[list[bytes]]]]:
    """Rows with their words, a bounded number of words at a time (one very long text may exceed it)."""
    for frame in batches:
        start, size, words = 0, 0, []
        for i, value in enumerate(frame[text].tolist()):
            own = ascii_words(value, fold)
            words.append(own)
            size += len(own)
            if size >= words_at_once:
                yield frame.iloc[start : i + 1], words
                start, size, words = i + 1, 0, []
        if words:
            yield frame.iloc[start:], words


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for lengths[0] places, then the same for the next."""
    total = int(lengths.sum())
    before = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(lengths) else np.empty(0, np.int64)
    return np.repeat(starts - before, lengths) + np.arange(total)


def whole_groups(batches: Iterable[pd.DataFrame], key: str, rows: int) -> Iterator[pd.DataFrame]:
    """From a partition sorted by key: frames of about that many rows that never split a key."""
    held: list[pd.DataFrame] = []
    size, limit = 0, rows
    for frame in batches:
        if not len(frame):
            continue
        held.append(frame)
        size += len(frame)
        if size < limit:
            continue
        whole = pd.concat(held, ignore_index=True)
        last = whole[key].iloc[-1]
        cut_at = int((whole[key] != last).sum())
        if cut_at:
            yield whole.iloc[:cut_at]
        held = [whole.iloc[cut_at:]]
        size = len(held[0])
        limit = max(rows, 2 * size)
    if size:
        yield pd.concat(held, ignore_index=True)


def row_key(*columns: str | Column) -> Column:
    """A 64-bit key of a row's identity; nulls count as values of their own."""
    parts = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.xxhash64(*[x for c in parts for x in (c.isNull(), c)])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b) of longs, by alternating large and small stars (Kiveris et al. 2014).

    Returns (node, component): the component is its smallest node. Nodes without an edge to another are left out. Every
    round is cut in the shared folder. It ends when the edges are stars to a smaller centre: each node has one parent
    and no parent has one itself, which is counted, not sampled. The rounds take tasks in proportion to the edges, as
    every task of an exchange leaves files on the disk, empty ones too.
    """
    parents = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("parent")).distinct())
    tasks = 1 + parents.count() // EDGES_AT_ONCE
    fit = (lambda df: df.coalesce(tasks)) if tasks < partitions(edges.sparkSession) else (lambda df: df)
    while True:
        parents = fit(parents)
        roots = parents.groupBy("node").agg(F.count("*").alias("n"))
        several = roots.where("n > 1").limit(1).count()
        above = 0 if several else parents.join(parents.select(F.col("node").alias("parent")), "parent", "left_semi").limit(1).count()
        if not several and not above:
            return parents.select("node", F.col("parent").alias("component")).union(parents.select("parent", "parent").distinct())
        both = fit(parents.union(parents.select("parent", "node")))
        low = both.groupBy("node").agg(F.min("parent").alias("low")).select("node", F.least("low", "node").alias("low"))
        large = both.where("parent > node").join(low, "node").where("parent <> low").select(F.col("parent").alias("node"), F.col("low").alias("parent")).distinct()
        low = large.groupBy("node").agg(F.min("parent").alias("low"))
        small = large.join(low, "node")
        parents = cut(fit(small.where("parent <> low").select(F.col("parent").alias("node"), F.col("low").alias("parent")).union(small.select("node", F.col("low").alias("parent")))).distinct())
