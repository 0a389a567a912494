"""Near-duplicate pose vectors by lattice hashing.

Method. In each of several tables a vector of unit length is projected at random into blocks of eight dimensions, and
each block is decoded to the nearest point of the E8 lattice; the points together are its cell. A vector also probes the
neighbouring cells that it lies nearest to (one block's point replaced by the second nearest). Vectors that meet in a
cell, at least one of them at home there, are compared by exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import components, cut, mixed, whole_groups

#: Lattice spacing for projections of unit variance, tables, and cells of distinct vectors that one block of eight tells apart.
SPACING, TABLES, CELLS_OF_BLOCK = 1.9, 16, 300
#: Members of a cell that are compared in one task; a larger cell is dealt out as pairs of its parts.
PART = 1024
#: Comparisons (rows times rows) at once inside a task.
AT_ONCE = 1 << 21


def nearest_d8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest point of D8 (integers with an even sum) and its squared distance."""
    f = np.rint(x)
    rest = x - f
    odd = (f.sum(-1).astype(np.int64) & 1).astype(bool)
    worst = np.abs(rest).argmax(-1)[..., None]
    step = np.where(np.take_along_axis(rest, worst, -1) >= 0, 1.0, -1.0) * odd[..., None]
    np.put_along_axis(f, worst, np.take_along_axis(f, worst, -1) + step, -1)
    return f, ((x - f) ** 2).sum(-1)


def decode_e8(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8, doubled to be whole numbers: the better of D8 and D8 moved by one half."""
    a, da = nearest_d8(x)
    b, db = nearest_d8(x - 0.5)
    return np.where((da <= db)[..., None], 2 * a, 2 * b + 1).astype(np.int64)


def neighbour(x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The point of E8 next to home that x lies nearest to, and how much farther than home it is (squared).

    Of the lattice's 240 shortest vectors the best for a rest r is, for those with two entries, the two largest entries of
    |r| with their signs; for those of halves, the signs of r with an even number of minuses.
    """
    rest = x - home / 2
    big = np.argsort(-np.abs(rest), -1)[..., :2]
    two = np.zeros_like(rest)
    np.put_along_axis(two, big, np.where(np.take_along_axis(rest, big, -1) >= 0, 1.0, -1.0), -1)
    half = np.where(rest >= 0, 0.5, -0.5)
    odd = ((half < 0).sum(-1) & 1).astype(bool)
    least = np.abs(rest).argmin(-1)[..., None]
    np.put_along_axis(half, least, np.take_along_axis(half, least, -1) * np.where(odd, -1.0, 1.0)[..., None], -1)
    gain_two, gain_half = (rest * two).sum(-1), (rest * half).sum(-1)
    step = np.where((gain_two >= gain_half)[..., None], two, half)
    return home + np.rint(2 * step).astype(np.int64), 2 - 2 * np.maximum(gain_two, gain_half)


def cell_keys(points: np.ndarray, table: int) -> np.ndarray:
    """One 64-bit number of the points of all blocks."""
    h = np.full(points.shape[0], np.uint64(table + 1))
    for j in range(points.shape[1]):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + points[:, j].view(np.uint64))
    return h.view(np.int64)


def cells(vectors: np.ndarray, blocks: int, tables: int, probes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each vector in each table, and its neighbouring cells (rows, tables, probes)."""
    n, d = vectors.shape
    homes, near = np.empty((n, tables), np.int64), np.empty((n, tables, probes), np.int64)
    for t in range(tables):
        plane = np.random.default_rng([seed, t, d]).standard_normal((d, 8 * blocks))
        x = (vectors @ plane / SPACING).reshape(n, blocks, 8)
        home = decode_e8(x)
        homes[:, t] = cell_keys(home.reshape(n, -1), t)
        other, cost = neighbour(x, home)
        order = np.argsort(cost, 1)
        for p in range(probes):
            moved = home.copy()
            at = order[:, p]
            moved[np.arange(n), at] = other[np.arange(n), at]
            near[:, t, p] = cell_keys(moved.reshape(n, -1), t)
    return homes, near


def near_duplicate_frames(frames: DataFrame, frame_id: str = "frame_id", vector: str = "landmarks", least_cosine: float = 0.95, tables: int = TABLES, probes: int = 2, seed: int = 7) -> DataFrame:
    """Groups of pose frames with nearly the same direction: (frame_id, n_links, component_id, kept).

    vector holds an array of numbers, compared in double precision whatever frames they come from; arrays of different
    lengths never link. Two frames link when their cosine is least_cosine or more and they meet in a cell of any table;
    no pair below links, and few above are missed (recall is measured in the tests). Null, empty or zero vectors and
    those with null or non-finite entries link with nothing. n_links counts the other rows linked directly, component_id
    is the smallest frame_id reachable by links, kept is frame_id = component_id. Repeated vectors are compared once
    and counted as often as they stand; every row is returned. A null frame_id stays null and is kept if its component
    has no other. Further columns are ignored. Cells grow finer with the number of vectors, and a cell of more than PART
    vectors is compared in parts.
    """
    rows = frames.select(F.col(frame_id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    sound = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    # Adding zero makes -0.0 and 0.0 the same bits.
    rows = rows.withColumn("node", F.when(sound, F.xxhash64(F.transform("v", lambda x: x + F.lit(0.0)))))
    held = cut(rows.select("id", "node"))
    classes = rows.where("node is not null").groupBy("node").agg(F.any_value("v").alias("v"))
    count = held.where("node is not null").select("node").distinct().count()
    blocks = max(1, int(np.ceil(np.log(max(2, count) / 4) / np.log(CELLS_OF_BLOCK))))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            lengths = frame["v"].map(len)
            for _, own in frame.groupby(lengths):
                for at in range(0, len(own), 2000):
                    part = own.iloc[at : at + 2000]
                    x = np.stack(part["v"].to_numpy())
                    x = x / np.abs(x).max(1)[:, None]
                    x /= np.sqrt((x * x).sum(1))[:, None]
                    home, near = cells(x, blocks, tables, min(probes, blocks), seed)
                    keys = np.concatenate([home[:, :, None], near], 2)
                    yield pd.DataFrame({"node": part["node"].to_numpy(), "v": [v.tobytes() for v in x], "homes": [h.tobytes() for h in home], "keys": list(keys.reshape(len(part), -1))})

    vectors = cut(classes.mapInPandas(deal, "node long, v binary, homes binary, keys array<long>"))
    each = 1 + min(probes, blocks)
    dealt = vectors.select("node", F.posexplode("keys").alias("pos", "cell")).select("node", "cell", F.floor(F.col("pos") / each).cast("int").alias("turn"), (F.col("pos") % each == 0).alias("home"))
    # Only cells in which a vector at home meets another are worth a comparison.
    met = dealt.groupBy("cell").agg(F.count("*").alias("c"), F.max("home").alias("any_home")).where("c > 1 and any_home").select("cell", F.ceil(F.col("c") / PART).cast("int").alias("parts"))
    parted = dealt.join(met, "cell").join(vectors.select("node", "v", "homes"), "node").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    sides = parted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"lo": F.least("part", "other"), "hi": F.greatest("part", "other")})
    work = sides.withColumn("task", F.xxhash64("cell", "lo", "hi")).select("task", "lo", "hi", "part", "node", "turn", "home", "v", "homes")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, "task", 4096):
            task = frame["task"].to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1], [True]]))
            found = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if b - a > 1:
                    found += links_of(frame.iloc[a:b], least_cosine)
            if found:
                yield pd.DataFrame({"a": np.concatenate([x for x, _ in found]), "b": np.concatenate([y for _, y in found])})

    links = cut(work.repartition("task").sortWithinPartitions("task").mapInPandas(compare, "a long, b long").distinct())
    weight = held.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"))
    both = links.union(links.select("b", "a"))
    degree = both.join(weight.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("others"))
    groups = components(links)
    least = held.join(groups, "node", "left").withColumn("group", F.coalesce("component", "node"))
    least = least.join(weight, "node", "left").join(degree, "node", "left")
    first = least.where("group is not null").groupBy("group").agg(F.min("id").alias("first"))
    out = least.join(first, "group", "left").select(F.col("id").alias(frame_id), (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_links"), F.coalesce("first", "id").alias("component_id"))
    return out.withColumn("kept", F.col(frame_id).eqNullSafe(F.col("component_id")))


def links_of(group: pd.DataFrame, least_cosine: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs (smaller node first) of one cell, or of two of its parts, that don't share an earlier home cell."""
    width = {len(v) for v in group["v"]}
    if len(width) > 1:
        return [pair for w in width for pair in links_of(group[group["v"].map(len) == w], least_cosine)]
    x = np.frombuffer(b"".join(group["v"]), np.float64).reshape(len(group), -1)
    homes = np.frombuffer(b"".join(group["homes"]), np.int64).reshape(len(group), -1)
    node, home, part, turn = group["node"].to_numpy(), group["home"].to_numpy(), group["part"].to_numpy(), int(group["turn"].iloc[0])
    lo, hi = int(group["lo"].iloc[0]), int(group["hi"].iloc[0])
    left, right = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
    out = []
    step = max(1, AT_ONCE // max(1, len(right)))
    for at in range(0, len(left), step):
        some = left[at : at + step]
        near = (x[some] @ x[right].T >= least_cosine) & (home[some][:, None] | home[right][None, :])
        near &= (node[some][:, None] < node[right][None, :]) if lo == hi else (node[some][:, None] != node[right][None, :])
        i, j = np.nonzero(near)
        p, q = some[i], right[j]
        fresh = ~(homes[p, :turn] == homes[q, :turn]).any(1)
        p, q = node[p[fresh]], node[q[fresh]]
        if len(p):
            out.append((np.minimum(p, q), np.maximum(p, q)))
    return out
