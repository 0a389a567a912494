"""Known items inside long notes: containment search by size-partitioned MinHash, verified exactly.

Method. Items are partitioned by their number of shingles, each partition spanning a factor of two. For a partition of
items of up to u shingles the notes are read as blocks of u consecutive shingles, so that item and block are of like
size however long the notes are. Both are sketched by one permutation in 2u bins (the smallest hash of each bin); notes
that share the value of a bin with an item are candidates, and their containment is then counted on whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import WordHashes, ascii_words, grams, hash_words, mixed, text_batches

#: Words of the items that are sent to the executors at once; more items make more blocks, each a pass over the notes.
ITEM_WORDS_AT_ONCE = 1_000_000


def bins_of(hashes: np.ndarray, bins: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) * np.uint64(bins) >> np.uint64(24)).astype(np.int64)


class ItemIndex:
    """Items of one block of the query set: their shingle sets, and bin values to items for each size partition."""

    def __init__(self, items: list[tuple[int, np.ndarray]]) -> None:
        self.sets = dict(items)
        self.partitions: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        by_size: dict[int, list[int]] = {}
        for key, values in items:
            if len(values):
                by_size.setdefault(1 << max(2, int(len(values) - 1).bit_length()), []).append(key)
        for upper, keys in sorted(by_size.items()):
            found, owners = [], []
            for key in keys:
                values = mixed(self.sets[key] ^ np.uint64(0xA0761D6478BD642F))
                low = least_in_bins(values, bins_of(values, 2 * upper), 2 * upper)
                found.append(low)
                owners.append(np.full(len(low), key))
            value, owner = np.concatenate(found), np.concatenate(owners)
            order = np.argsort(value, kind="stable")
            value = value[order]
            near = np.zeros(1 << 20, bool)
            near[(value & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.partitions.append((upper, value, owner[order], near))

    def candidates(self, hashes: np.ndarray, row: np.ndarray, first: np.ndarray) -> set[tuple[int, int]]:
        """(row, item) pairs that share the value of a bin; hashes: the shingles of all rows, first: where each row begins."""
        out: set[tuple[int, int]] = set()
        if not len(hashes):
            return out
        values = mixed(hashes ^ np.uint64(0xA0761D6478BD642F))
        place = np.arange(len(values)) - first[row]
        for upper, known, owner, near in self.partitions:
            # A block never spans two rows.
            block = np.cumsum(np.concatenate([[0], ((place[1:] // upper) != (place[:-1] // upper)) | (row[1:] != row[:-1])]))
            width = 2 * upper
            low = np.full((int(block[-1]) + 1) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
            cell = block * width + bins_of(values, width)
            np.minimum.at(low, cell, values)
            hit = np.flatnonzero(near[(low & np.uint64((1 << 20) - 1)).astype(np.int64)])
            at = np.searchsorted(known, low[hit])
            real = known[np.minimum(at, len(known) - 1)] == low[hit]
            begin = np.searchsorted(block, np.arange(int(block[-1]) + 1))
            for h, a in zip(hit[real].tolist(), at[real].tolist(), strict=True):
                r = int(row[begin[h // width]])
                while a < len(known) and known[a] == low[h]:
                    out.add((r, int(owner[a])))
                    a += 1
        return out


def least_in_bins(values: np.ndarray, bins: np.ndarray, count: int) -> np.ndarray:
    low = np.full(count, np.uint64(0xFFFFFFFFFFFFFFFF))
    np.minimum.at(low, bins, values)
    return low[np.unique(bins)]


def find_leaked_items(
    attempts: DataFrame, items: DataFrame, attempt_id: str = "attempt_id", notes: str = "notes", item_id: str = "case_id", item_text: str = "evidence", shingle_words: int = 5, percent: int = 80
) -> DataFrame:
    """Items (known cases, by the text of their evidence) that stand inside notes.

    Words are lower-cased (A-Z) and cut at ASCII white space. An item is found in notes that hold at least percent per
    cent of its distinct shingles of shingle_words words. Returns (attempt_id, item_id, n_shingles, n_found): the size of
    the item's set and how much of it the notes hold. Items of fewer words, or null ones, have no shingles and are never
    found; null notes hold none. Repeated rows of notes are each returned; repeated items once. Null ids stay null.
    Every item is searched in all notes: items are sent to the executors in blocks of ITEM_WORDS_AT_ONCE words at most
    (a longer item alone), one pass over the notes for each block.
    """
    spark = attempts.sparkSession
    id_type = attempts.schema[attempt_id].dataType.simpleString()
    item_type = items.schema[item_id].dataType.simpleString()
    wanted = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")).where("text is not null").distinct().withColumn("words", F.length("text") - F.length(F.translate("text", " \t\n\r\f\u000b", "")) + 1)
    parts = 1
    while True:
        block = F.pmod(F.xxhash64("item", "text"), F.lit(parts))
        sizes = wanted.groupBy(block.alias("block")).agg(F.sum("words").alias("words"), F.count("*").alias("c")).collect()
        if all(r["words"] <= ITEM_WORDS_AT_ONCE or r["c"] == 1 for r in sizes):
            break
        parts *= 2
    out = spark.createDataFrame([], "id string, item string, n_shingles long, n_found long")
    texts = attempts.select(F.col(attempt_id).cast("string").alias("id"), F.col(notes).cast("string").alias("text"))
    for r in sizes:
        rows = wanted.where(block == r["block"]).select("item", "text").collect()
        sent = spark.sparkContext.broadcast([(x["item"], x["text"]) for x in rows])

        def search(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            known = WordHashes()
            names = [item for item, _ in sent.value]
            sets = [np.unique(grams(hash_words(ascii_words(text, True), known), shingle_words)) for _, text in sent.value]
            index = ItemIndex(list(enumerate(sets)))
            for frame, words in text_batches(batches, "text", True):
                lengths = np.fromiter(map(len, words), np.int64, len(words))
                hashes = grams(hash_words([w for row in words for w in row], known), shingle_words)
                row = np.repeat(np.arange(len(words)), lengths)
                n = len(hashes)
                whole = row[:n] == row[shingle_words - 1 : shingle_words - 1 + n]
                hashes, row = hashes[whole], row[:n][whole]
                own = np.bincount(row, minlength=len(words))
                first = np.cumsum(own) - own
                found = []
                for i, k in sorted(index.candidates(hashes, row, first)):
                    held = int(np.isin(sets[k], hashes[first[i] : first[i] + own[i]]).sum())
                    if 100 * held >= percent * len(sets[k]):
                        found.append((frame["id"].iloc[i], names[k], len(sets[k]), held))
                if found:
                    yield pd.DataFrame(found, columns=["id", "item", "n_shingles", "n_found"])

        out = out.union(texts.mapInPandas(search, out.schema))
    return out.select(F.col("id").cast(id_type).alias(attempt_id), F.col("item").cast(item_type).alias(item_id), "n_shingles", "n_found")
