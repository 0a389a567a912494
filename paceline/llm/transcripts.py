"""Canonical turns of review transcripts: a hidden Markov model over speaker markers and line features.

Method. Every line of a transcript is in one of six states: it begins or continues a turn of the system, the user or the
assistant. Lines show a speaker marker and features (place in the message, length, ending); transitions and features
are counted on labelled messages, markers follow a fixed table. Viterbi finds the likeliest states. A long transcript is
worked in blocks of messages: each block gives its best score from every state before it to every state at its end, these
are chained, and each block is then traced back between the states that the chain chose.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import cut, whole_groups

ROLES = ("system", "user", "assistant")
#: Names by which transcripts mark their speakers.
NAMES = {"system": "system|sys|instructions?|context", "user": "user|human|question|q|customer|prompter|athlete|me", "assistant": "assistant|ai|bot|model|answer|a|agent|coach|response"}
#: Turns of a block, about.
BLOCK_TURNS = 64
#: Chance of a marker in a line that begins a turn: its own role's, another role's, another name's; and of any in a later line.
OWN_MARKER, WRONG_MARKER, OTHER_MARKER, LATE_MARKER = 0.45, 0.01, 0.03, 0.002
MARKS = ("none", *ROLES, "other")
#: Number of values of the trained features: place (first of the message, after a blank line, else), length, ending, opening.
FEATURES = {"place": 3, "length": 6, "ending": 3, "opening": 4}
BEGIN = len(ROLES)


def marked_span(names: str) -> str:
    """What marks a speaker at the start of a line: a name closed by a bracket, stars or a colon, or after a chat token.

    Colons, stars and brackets further on are text. Read alike by Java and by Python (ASCII).
    """
    closed = r"(?:(?:[\]>|]+(?:\*+(?![^\s:]))?|\*+)(?::|\s+:(?!\S))?|\s*:(?:\*+(?!\S))?)"
    return rf"^[\s#*\[<|>]*(?:(?:im_start\|>)?(?:{names}){closed}|im_start\|>(?:{names})(?!\S))"


def marker(line: Column) -> Column:
    """Number in MARKS of the speaker marker at the start of a line."""
    own = [F.when(line.rlike("(?i)" + marked_span(names)), F.lit(1 + i)) for i, names in enumerate(NAMES.values())]
    return F.coalesce(*own, F.when(line.rlike(r"^\s*\p{Lu}[\p{L}.]{0,19}(?: \p{Lu}[\p{L}.]{0,19})?:(?:\s|$)"), F.lit(4)), F.lit(0))


def described(messages: DataFrame) -> DataFrame:
    """Messages (request_id, turn, text) with the marker and features of each of their lines."""
    lines = F.split(F.coalesce("text", F.lit("")), r"\r?\n")
    size = lambda x: F.length(F.trim(x))

    def one(x: Column, i: Column) -> Column:
        before = F.get(lines, i - 1)
        return F.struct(
            marker(x).cast("int").alias("marker"),
            F.when(i == 0, 0).when(F.trim(before) == "", 1).otherwise(2).alias("place"),
            F.least(F.lit(5), F.when(size(x) == 0, 0).otherwise(F.floor(F.log2(F.greatest(size(x), F.lit(1)) / 20 + 1)) + 1)).cast("int").alias("length"),
            F.when(F.rtrim(x).endswith("?"), 0).when(F.rtrim(x).rlike(r"[.!]$"), 1).otherwise(2).alias("ending"),
            F.when(x.rlike(r"^\s*\p{Lu}"), 0).when(x.rlike(r"^\s*(?:[-*•]|\d+[.)])"), 1).when(x.rlike(r"^\s*\p{Ll}"), 2).otherwise(3).alias("opening"),
        )

    return messages.withColumn("lines", F.transform(lines, one))


class RoleModel:
    """Log chances of the states' starts, moves and lines."""

    def __init__(self, starts: np.ndarray, moves: np.ndarray, features: dict[str, np.ndarray]) -> None:
        self.start = np.log((starts + 1) / (starts + 1).sum())
        self.start[BEGIN:] = -30.0  # a transcript begins with a turn
        self.move = np.log((moves + 0.5) / (moves + 0.5).sum(1, keepdims=True))
        for r in range(len(ROLES)):  # a turn is only continued by its own speaker
            self.move[:, BEGIN + r] = np.where(np.isin(np.arange(6), (r, BEGIN + r)), self.move[:, BEGIN + r], -30.0)
        # Labelled messages begin a turn each, in a transcript a turn may begin at any line; and its turns may be shorter.
        features = {k: v + (0.1 if k == "place" else 0.03) * v.sum(1, keepdims=True) for k, v in features.items()}
        self.feature = {k: np.log((v + 1) / (v + 1).sum(1, keepdims=True)) for k, v in features.items()}
        mark = np.full((6, len(MARKS)), LATE_MARKER)
        mark[BEGIN:, 0] = 1 - 4 * LATE_MARKER
        for r in range(len(ROLES)):
            mark[r, 1:4], mark[r, 4], mark[r, 1 + r] = WRONG_MARKER, OTHER_MARKER, OWN_MARKER
            mark[r, 0] = 1 - mark[r, 1:].sum()
        self.mark = np.log(mark)

    def emission(self, lines: list[dict]) -> np.ndarray:
        out = self.mark[:, [x["marker"] for x in lines]].T.copy()
        for k, table in self.feature.items():
            out += table[:, [x[k] for x in lines]].T
        return out

    def across(self, lines: list[dict], opening: bool) -> np.ndarray:
        """Best score from each state before the lines to each state of the last; opening: nothing was before."""
        emitted = self.emission(lines)
        score = np.tile(self.start, (6, 1)) + emitted[0] if opening else self.move + emitted[0]
        for e in emitted[1:]:
            score = (score[:, :, None] + self.move[None]).max(1) + e
        return score

    def trace(self, lines: list[dict], before: int | None, last: int) -> list[int]:
        """The best states that end in last."""
        emitted = self.emission(lines)
        score = (self.start if before is None else self.move[before]) + emitted[0]
        back = []
        for e in emitted[1:]:
            options = score[:, None] + self.move
            back.append(options.argmax(0))
            score = options.max(0) + e
        states = [last]
        for b in reversed(back):
            states.append(int(b[states[-1]]))
        return states[::-1]


def fit_roles(labelled: DataFrame, request_id: str = "request_id", turn: str = "turn", role: str = "role", text: str = "text") -> RoleModel:
    """The model of labelled messages (request_id, turn, role, text); messages of unknown or null roles count for nothing.

    All messages are counted by Spark; what comes to the driver are the counts of states and feature values.
    """
    known = labelled.select(F.col(request_id).alias("request_id"), F.col(turn).alias("turn"), F.lower(F.trim(F.col(role))).alias("role"), F.col(text).cast("string").alias("text")).where(F.col("role").isin(*ROLES))
    number = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")).cast("int") - 1
    rows = described(known).select("request_id", "turn", number.alias("r"), F.size("lines").alias("n"), "lines")
    lines = rows.select("r", F.posexplode("lines").alias("at", "line")).withColumn("state", F.col("r") + F.when(F.col("at") > 0, BEGIN).otherwise(0))
    values = lines.select("state", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"line.{k}").cast("int").alias("v")) for k in FEATURES])).alias("f"))
    features = {k: np.zeros((6, n)) for k, n in FEATURES.items()}
    for x in values.groupBy("state", "f.k", "f.v").agg(F.count("*").alias("c")).collect():
        features[x["k"]][x["state"], x["v"]] = x["c"]
    moves, starts = np.zeros((6, 6)), np.zeros(6)
    # A message follows the one of the turn before it; joined by request and turn, so that no request is gathered.
    after = rows.select("request_id", (F.col("turn") - 1).alias("turn"), F.col("r").alias("next"))
    follows = rows.join(after, ["request_id", "turn"]).groupBy("r", (F.col("n") > 1).alias("long"), "next").agg(F.count("*").alias("c"))
    for x in follows.collect():
        moves[x["r"] + (BEGIN if x["long"] else 0), x["next"]] += x["c"]
    for x in rows.where("n > 1").groupBy("r").agg(F.count("*").alias("c"), F.sum(F.col("n") - 2).alias("more")).collect():
        moves[x["r"], BEGIN + x["r"]] += x["c"]
        moves[BEGIN + x["r"], BEGIN + x["r"]] += x["more"]
    heads = rows.join(rows.select("request_id", (F.col("turn") + 1).alias("turn")).distinct(), ["request_id", "turn"], "left_anti")
    for x in heads.groupBy("r").agg(F.count("*").alias("c")).collect():
        starts[x["r"]] = x["c"]
    return RoleModel(starts, moves, features)


def format_transcripts(messages: DataFrame, model: RoleModel, request_id: str = "request_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """Messages of review transcripts with their speakers recovered: (request_id, turn, roles, n_lines, formatted).

    A message is a piece of a request's transcript and may hold one turn, a part of one or many. roles lists the speakers
    of its turns in order; formatted is its text as canonical turns, <|role|> before each and <|end|> after each, without
    the markers of the source; a piece that continues a turn begins without a header. Messages are ordered by turn, equal
    turns by text. Null or empty text is one empty line. Rows with a null request_id are one transcript, and a null turn
    comes first; repeated rows are repeated messages. Every row is returned; further columns are ignored.
    """
    kind, turn_kind = messages.schema[request_id].dataType.simpleString(), messages.schema[turn].dataType.simpleString()
    rows = messages.select(F.col(request_id).cast("string").alias("request_id"), F.col(turn).cast("string").alias("turn_text"), F.col(turn).cast("double").alias("order"), F.col(text).cast("string").alias("text"))
    rows = described(rows.withColumn("block", F.coalesce(F.floor(F.col("order") / BLOCK_TURNS), F.lit(-1)).cast("long"))).withColumn("task", F.xxhash64(F.col("request_id").isNull(), "request_id", "block"))
    first = rows.groupBy("request_id").agg(F.min("block").alias("first"))
    rows = rows.join(first.select(F.col("request_id").alias("rid"), "first"), F.col("request_id").eqNullSafe(F.col("rid"))).drop("rid").withColumn("opening", F.col("block") == F.col("first"))
    dealt = rows.repartition("task").sortWithinPartitions("task", "order", "text")

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, "task", 2000):
            for _, own in frame.groupby("task", sort=False):
                yield own

    def lines_of(own: pd.DataFrame) -> list[dict]:
        return [x for row in own["lines"] for x in row]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in groups(batches):
            yield pd.DataFrame({"request_id": [own["request_id"].iloc[0]], "block": [int(own["block"].iloc[0])], "opening": [bool(own["opening"].iloc[0])], "best": [model.across(lines_of(own), bool(own["opening"].iloc[0])).ravel()]})

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks of a request in order; kept for each: its number and six back-pointers."""
        held: list[tuple] = []
        total = np.zeros(6)

        def trace() -> pd.DataFrame:
            state, out = int(total.argmax()), []
            for name, block, back in reversed(held):
                out.append((name, block, None if back is None else int(back[state]), state))
                state = state if back is None else int(back[state])
            return pd.DataFrame(out, columns=["request_id", "block", "before", "last"]).astype({"before": "Int32"})

        for frame in batches:
            for name, block, opening, best in zip(frame["request_id"], frame["block"], frame["opening"], frame["best"], strict=True):
                best = np.asarray(best).reshape(6, 6)
                if opening:
                    if held:
                        yield trace()
                    held, total = [(name, block, None)], best[0]
                else:
                    options = total[:, None] + best
                    held.append((name, block, options.argmax(0).astype(np.int8)))
                    total = options.max(0)
        if held:
            yield trace()

    scored = dealt.mapInPandas(score, "request_id string, block long, opening boolean, best array<double>")
    chosen = cut(scored.repartition("request_id").sortWithinPartitions("request_id", "block").mapInPandas(chain, "request_id string, block long, before int, last int"))
    ends = chosen.select(F.xxhash64(F.col("request_id").isNull(), "request_id", "block").alias("task"), "before", "last")

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in groups(batches):
            before = own["before"].iloc[0]
            states = model.trace(lines_of(own), None if pd.isna(before) else int(before), int(own["last"].iloc[0]))
            at, out = 0, []
            for value, features in zip(own["text"], own["lines"], strict=True):
                texts = (value or "").replace("\r\n", "\n").split("\n")
                roles, parts = [], []
                for line, state, mark in zip(texts, states[at : at + len(texts)], (x["marker"] for x in features), strict=True):
                    if state < BEGIN:
                        roles.append(ROLES[state])
                        parts.append(f"{'<|end|>' + chr(10) if parts else ''}<|{ROLES[state]}|>\n")
                        line = unmarked(line, mark) if 1 <= mark <= 3 else line
                    parts.append(line + "\n")
                at += len(texts)
                out.append((roles, len(texts), "".join(parts) + "<|end|>"))
            yield pd.DataFrame({"request_id": own["request_id"].tolist(), "turn_text": own["turn_text"].tolist(), "roles": [x[0] for x in out], "n_lines": [x[1] for x in out], "formatted": [x[2] for x in out]})

    done = rows.join(ends, "task").repartition("task").sortWithinPartitions("task", "order", "text").mapInPandas(render, "request_id string, turn_text string, roles array<string>, n_lines long, formatted string")
    return done.select(F.col("request_id").cast(kind).alias(request_id), F.col("turn_text").cast(turn_kind).alias(turn), "roles", "n_lines", "formatted")


def unmarked(line: str, mark: int) -> str:
    """A line without the speaker marker at its start, of the role of that number in MARKS."""
    return re.sub(marked_span(NAMES[MARKS[mark]]), "", line, count=1, flags=re.IGNORECASE | re.ASCII).strip()
