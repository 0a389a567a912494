"""Quality rules of notes: simple measures of each text, and lines that a site repeats in too many of its texts.

Method. Lines are normalised and hashed together with their site. For each (site, line) the distinct texts that hold it
are counted; a line over both limits is boilerplate of its site and is removed, and notes that lose more of their words
than allowed are rejected. Counting is two partial aggregations, so neither a site with most of the texts nor a line that
most texts hold meets in one task; the lines found are dealt over SALTS before they meet the notes again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import cut, text_batches

#: Signs counted as symbols (fixed value).
SYMBOLS = "#*$%&|<>"
#: White space between words (fixed value).
SPACES = " \t\n\x0b\x0c\r"
#: Parts over which the notes that hold one removed line are dealt.
SALTS = 16
DIGITS = re.compile(rb"[0-9]+")
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def digest(value: bytes) -> tuple[int, int]:
    """The two signed halves of a 128-bit hash."""
    h = xxhash.xxh3_128_digest(value)
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def repeated_words(rows: list[list[bytes]], width: int = 3) -> np.ndarray:
    """Of each row, the words in windows of width words that the row holds twice or more; compared exactly."""
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    codes: dict[bytes, int] = {}
    flat = np.fromiter((codes.setdefault(w, len(codes)) for row in rows for w in row), np.int64, int(lengths.sum()))
    row = np.repeat(np.arange(len(rows)), lengths)
    names = np.unique(row * max(1, len(codes)) + flat, return_inverse=True)[1]  # words of different rows differ
    count = max(0, len(flat) - width + 1)
    for j in range(1, width):
        names = np.unique(names[: len(flat) - j] * max(1, len(codes)) + flat[j:], return_inverse=True)[1] if len(flat) > j else names[:0]
    inside = np.flatnonzero(row[:count] == row[len(row) - count :])  # windows within one row
    at = inside[np.bincount(names[inside], minlength=1)[names[inside]] > 1]
    step = np.zeros(len(flat) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + width, -1)
    return np.bincount(row, np.cumsum(step)[:-1] > 0, len(rows)).astype(np.int64)


def judge_notes(
    attempts: DataFrame, attempt_id: str = "attempt_id", notes: str = "notes", location: str = "location",
    least_words: int = 50, most_repeated_percent: int = 50, most_attempts: int = 10, most_percent: int = 5, least_left_percent: int = 50, clean: bool = False,
) -> DataFrame:
    """Measures and verdict of the notes of each attempt: (attempt_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, n_lines, removed_lines, n_removed_words, kept), and with clean notes last.

    Words lie between ASCII white space. word_chars are the code points in words, n_symbols the signs of SYMBOLS,
    n_dup_lines lines with a word that equal an earlier line, n_repeat_words words in 3-word windows found twice or more
    in the notes. base_failed: fewer than least_words words, or more than most_repeated_percent of the words repeated.
    Lines (cut at LF, with a word) are compared with A-Z lower-cased, words joined by one space and digits as one 0. A line
    is removed at a location when more than most_attempts different notes and more than most_percent of the different
    notes of that location hold it; removed_lines are its numbers, from 0. kept: not base_failed, and at least
    least_left_percent of the words are left. Limits are shares of a location, so they mean the same at every size.

    Copies of the same notes at one location count as one text, so a text isn't boilerplate for being copied. Null notes
    count as empty and fail; a null location is a location of its own; null ids and repeated rows are kept and judged like
    others. clean returns the notes without the removed lines (null stays null). Further columns are ignored.
    """
    rows = attempts.select(F.col(attempt_id).cast("string").alias("id"), F.col(notes).cast("string").alias("text"), F.col(location).cast("string").alias("site"))
    types = "id string, site string, t1 long, t2 long, " + ", ".join(f"{m} long" for m in MEASURES) + ", d1 array<long>, d2 array<long>, at array<int>, words array<int>" + (", text string" if clean else "")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, words in text_batches(batches, "text", False):
            out: dict[str, list] = {k: [] for k in ("t1", "t2", "word_chars", "n_symbols", "n_dup_lines", "d1", "d2", "at", "words")}
            for text, site in zip(frame["text"].tolist(), frame["site"].tolist(), strict=True):
                text = text or ""
                raw = text.encode("utf-8", "surrogatepass")
                mark = b"\x00" if site is None else b"\x01" + site.encode("utf-8", "surrogatepass") + b"\x00"
                one, two = digest(raw)
                lines = raw.split(b"\n")
                seen: set[bytes] = set()
                hashes, places, sizes, doubles = [], [], [], 0
                for i, line in enumerate(lines):
                    own = line.split()
                    if own:
                        doubles += line in seen
                        seen.add(line)
                        hashes.append(digest(mark + DIGITS.sub(b"0", b" ".join(own).lower())))
                        places.append(i)
                        sizes.append(len(own))
                both = np.array(hashes, np.int64).reshape(-1, 2)
                for k, v in (("t1", one), ("t2", two), ("word_chars", len(text) - sum(map(text.count, SPACES))), ("n_symbols", sum(map(text.count, SYMBOLS))), ("n_dup_lines", doubles), ("d1", both[:, 0]), ("d2", both[:, 1]), ("at", np.array(places, np.int32)), ("words", np.array(sizes, np.int32))):
                    out[k].append(v)
            own = {"id": frame["id"].to_numpy(), "site": frame["site"].to_numpy(), "n_words": list(map(len, words)), "n_repeat_words": repeated_words(words)}
            yield pd.DataFrame(own | out | ({"text": frame["text"].to_numpy()} if clean else {}))[[c.split()[0] for c in types.split(", ")]]

    measured = cut(rows.mapInPandas(measure, types).withColumn("row", F.monotonically_increasing_id()))
    lines = measured.select("row", "site", "t1", "t2", F.inline(F.arrays_zip("d1", "d2", "at", "words")))
    sites = measured.select("site", "t1", "t2").distinct().groupBy("site").agg(F.count("*").alias("texts"))
    counts = lines.select("d1", "d2", "site", "t1", "t2").distinct().groupBy("d1", "d2", "site").agg(F.count("*").alias("held_by")).where(F.col("held_by") > most_attempts)
    common = counts.join(sites.withColumnRenamed("site", "of"), F.col("site").eqNullSafe(F.col("of"))).where(F.col("held_by") * 100 > F.col("texts") * most_percent)
    dealt = common.select("d1", "d2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    removed = lines.select("row", "d1", "d2", "at", "words", (F.col("row") % SALTS).cast("int").alias("salt")).join(dealt, ["d1", "d2", "salt"])
    lost = removed.groupBy("row").agg(F.sum("words").alias("gone"), F.sort_array(F.collect_list("at")).alias("removed_lines"))

    judged = measured.join(lost, "row", "left").withColumns({"n_lines": F.size("at").cast("long"), "removed_lines": F.coalesce("removed_lines", F.array().cast("array<int>")), "n_removed_words": F.coalesce("gone", F.lit(0)).cast("long"), "base_failed": (F.col("n_words") < least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * most_repeated_percent)})
    kept = ~F.col("base_failed") & ((F.col("n_words") - F.col("n_removed_words")) * 100 >= F.col("n_words") * least_left_percent)
    kind = attempts.schema[attempt_id].dataType.simpleString()
    out = [F.col("id").cast(kind).alias(attempt_id), *MEASURES, "base_failed", "n_lines", "removed_lines", "n_removed_words", kept.alias("kept")]
    if clean:
        out.append(F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("removed_lines", i)), "\n").alias(notes))
    return judged.select(*out)
