"""Byte-pair encoding of notes by dynamic programming over prefixes, and decoding.

Method. For every prefix of a pre-token the encoding ends in one token only. The automaton of the vocabulary gives the
tokens that end at a place; the one that may follow the last token of the prefix before it, by a test of the pair, is
stored. Following these back from the end gives the ids that merging by rank gives.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens and pairs of tokens that a Python worker remembers; of pre-tokens twice as many, the older half goes first.
REMEMBERED, REMEMBERED_PAIRS = 200_000, 400_000
#: Characters handled at once.
CHARACTERS_AT_ONCE = 2_000_000
END = "</w>"
#: The last byte of a pre-token is a symbol of its own, at this distance.
LAST = 0xE000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is visible in Latin-1, else the next free one from 256."""
    visible = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class Remembered(dict):
    """A dict that computes what it misses and keeps the entries used last: up to limit, and as many before those."""

    def __init__(self, compute: Callable[[str], tuple[int, ...]], limit: int) -> None:
        self.compute, self.limit, self.older = compute, limit, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        out = self.older.get(word)
        if out is None:
            out = self.compute(word)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[word] = out
        return out


class WordBpe:
    """The encoder of a tokenizer file of lower-cased words with word ends."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.cut_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pre_token = regex.compile(file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"], flags=regex.V0)
        self.symbols = byte_symbols()
        self.automaton = ahocorasick.Automaton()
        for token, i in model["vocab"].items():
            own = self.packed(token)
            if own:
                self.automaton.add_word(own, (len(own), i))
        self.automaton.make_automaton()
        # What two tokens merge into, when (the rank), and what a token was merged from.
        self.rank_of: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        vocab = model["vocab"]
        for rank, (a, b) in enumerate(model["merges"]):
            x, y = vocab[a], vocab[b]
            made = vocab[a + b]
            self.merge[x, y] = rank
            self.rank_of.setdefault(made, rank)
            self.halves.setdefault(made, (x, y))
        self.of_token = Remembered(self.tokens_of, REMEMBERED)
        self.pairs: dict[int, bool] = {}  # by left << 20 | right

    @staticmethod
    def packed(token: str) -> str:
        return token[: -len(END) - 1] + chr(LAST + ord(token[-len(END) - 1])) if token.endswith(END) and len(token) > len(END) else token

    def compatible(self, left: int, right: int) -> bool:
        """Whether the text of left and right is encoded as just these two; the answer is kept in pairs.

        Undo merges beside the boundary, the latest first. A merge over the boundary would have come before one of
        them if its rank is lower than that of the merge that used up its left part, or not higher than that of the one
        that used up its right part (of equal merges the leftmost is first).
        """
        x, y, until_x, until_y, good = left, right, 1 << 60, 1 << 60, True
        while True:
            over = self.merge.get((x, y))
            if over is not None and over < until_x and over <= until_y:
                good = False
                break
            rx, ry = self.rank_of.get(x, -1), self.rank_of.get(y, -1)
            if rx < 0 and ry < 0:
                break
            if rx > ry:
                x, until_x = self.halves[x][1], rx
            else:
                y, until_y = self.halves[y][0], ry
        if len(self.pairs) >= REMEMBERED_PAIRS:
            self.pairs.clear()
        self.pairs[left << 20 | right] = good
        return good

    def tokens_of(self, word: str) -> tuple[int, ...]:
        """Ids of a pre-token."""
        if word.isascii() and word.isprintable() and " " not in word:  # each byte is its own symbol
            text = word[:-1] + chr(LAST + ord(word[-1]))
        else:
            raw = word.encode("utf-8", "surrogatepass")
            symbols = self.symbols
            text = "".join([symbols[b] for b in raw[:-1]]) + chr(LAST + ord(symbols[raw[-1]]))
        last: list[tuple[int, int] | None] = [None] * (len(text) + 1)
        pairs = self.pairs
        for end, (size, token) in self.automaton.iter(text):
            end += 1
            if last[end] is None:
                start = end - size
                if start:
                    before = last[start]
                    if before is None:
                        continue
                    good = pairs.get(before[1] << 20 | token)
                    if good is None:
                        good = self.compatible(before[1], token)
                    if not good:
                        continue
                last[end] = (start, token)
        ids, at = [], len(text)
        while at:
            at, token = last[at]
            ids.append(token)
        return tuple(reversed(ids))

    def forget(self) -> None:
        """Give up what was remembered of the texts so far."""
        self.of_token = Remembered(self.tokens_of, REMEMBERED)
        self.pairs = {}

    def encode(self, text: str) -> np.ndarray:
        if self.cut_special is None or not any(s in text for s in self.special):
            return self.encode_plain(text)
        parts, at = [], 0
        for m in self.cut_special.finditer(text):
            parts += [self.encode_plain(text[at : m.start()]), np.array([self.special[m[0]]], np.int32)]
            at = m.end()
        return np.concatenate([*parts, self.encode_plain(text[at:])])

    def encode_plain(self, text: str) -> np.ndarray:
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return np.fromiter(chain.from_iterable(map(self.of_token.__getitem__, self.pre_token.findall(text))), np.int32)


@lru_cache(maxsize=1)
def encoder(path: str) -> WordBpe:
    """Read once in a Python worker, whatever the number of tasks."""
    return WordBpe(path)


@lru_cache(maxsize=1)
def token_texts(path: str) -> dict[int, str]:
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    return {i: t for t, i in (file["model"]["vocab"] | {x["content"]: x["id"] for x in file["added_tokens"]}).items()}


def some_at_once(frame: pd.DataFrame, sizes: list[int], limit: int) -> Iterator[pd.DataFrame]:
    start = size = 0
    for i, n in enumerate(sizes):
        size += n
        if size >= limit:
            yield frame.iloc[start : i + 1]
            start, size = i + 1, 0
    if start < len(frame):
        yield frame.iloc[start:]


def spelled(ids: np.ndarray, text_of: Callable[[int], str]) -> str:
    return " ".join(map(text_of, ids.tolist()))


def encode_notes(attempts: DataFrame, vocabulary: str, attempt_id: str = "attempt_id", notes: str = "notes", decoded: bool = False) -> DataFrame:
    """Token ids of whole notes: (attempt_id, token_ids, n_tokens), with decoded also notes, the text that the ids stand for.

    vocabulary is the path of a tokenizer file that every executor can open. Ids are those of that file's tokenizer
    without tokens added around the text; its special tokens are recognised inside it. Null or blank notes have no
    tokens. Every row is returned, repeated rows and null ids too; further columns are ignored. decoded gives what
    decode_notes gives, by the Python worker that encodes: each operator on the way would have workers of its own, which
    live on with what they hold.
    """
    kind = attempts.schema[attempt_id].dataType.simpleString()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = encoder(vocabulary)
        text_of = token_texts(vocabulary).__getitem__ if decoded else None
        try:
            for frame in batches:
                texts = frame["text"].tolist()
                for part in some_at_once(frame, [len(t or "") for t in texts], CHARACTERS_AT_ONCE):
                    ids = [bpe.encode(t) if t else np.empty(0, np.int32) for t in part["text"]]
                    own = {"text": [spelled(x, text_of) for x in ids]} if decoded else {}
                    yield pd.DataFrame({"id": part["id"].tolist(), "token_ids": ids, "n_tokens": list(map(len, ids))} | own)
        finally:
            bpe.forget()

    rows = attempts.select(F.col(attempt_id).cast("string").alias("id"), F.col(notes).cast("string").alias("text"))
    out = rows.mapInPandas(encode, "id string, token_ids array<int>, n_tokens long" + (", text string" if decoded else ""))
    return out.select(F.col("id").cast(kind).alias(attempt_id), "token_ids", "n_tokens", *([F.col("text").alias(notes)] if decoded else []))


def decode_notes(encoded: DataFrame, vocabulary: str, attempt_id: str = "attempt_id", notes: str = "notes") -> DataFrame:
    """Texts of token ids: (attempt_id, token_ids, n_tokens, notes); the tokens' own texts are joined by one space, as a tokenizer file without a decoder does."""
    kind = encoded.schema[attempt_id].dataType.simpleString()

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        text_of = token_texts(vocabulary).__getitem__
        for frame in batches:
            for part in some_at_once(frame, list(map(len, frame["token_ids"])), CHARACTERS_AT_ONCE // 4):
                yield part.assign(text=[spelled(np.asarray(x), text_of) for x in part["token_ids"]])

    rows = encoded.select(F.col(attempt_id).cast("string").alias("id"), F.coalesce("token_ids", F.array().cast("array<int>")).alias("token_ids"), "n_tokens")
    out = rows.mapInPandas(decode, "id string, token_ids array<int>, n_tokens long, text string")
    return out.select(F.col("id").cast(kind).alias(attempt_id), "token_ids", "n_tokens", F.col("text").alias(notes))
