"""Clusters of pose frames: Lloyd rounds over blocks of frames along a space-filling curve.

Method. Vectors are ordered along a Hilbert curve through all components and cut into blocks of BLOCK rows, each with the
smallest and largest value of every component (its zone map) and the sum of its rows. In a round a block's box bounds the
distance to each centroid from below and above, and the bisecting plane of two centroids tells whether the whole box lies
on one side; centroids that can't be nearest to any of its rows are passed over. A block with one candidate adds its
sum as it stands, the others are compared exactly, in whole numbers. Blocks are written once and read in every round;
only the centroids and their sums meet at the driver, a number of values that doesn't depend on the frames.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import cut, partitions

#: Rows of a block.
BLOCK = 256
#: Bits of each component in the place on the curve.
BITS = 3
#: Values beyond saturate, so that a squared distance fits 64 bits.
REACH = 1 << 27
#: Up to this size of values products of doubles are exact.
EXACT = 1 << 53


def curve_places(cells: np.ndarray, bits: int) -> list[bytes]:
    """Sortable places on the Hilbert curve of rows of cells (0 to 2**bits - 1 in each dimension), after Skilling (2004)."""
    axes = [c.copy() for c in cells.T.astype(np.uint32)]
    top = 1 << (bits - 1)
    level = top
    while level > 1:
        low = np.uint32(level - 1)
        for i, own in enumerate(axes):
            inverted = (own & np.uint32(level)) != 0
            swapped = np.where(inverted, np.uint32(0), (axes[0] ^ own) & low)
            axes[0] = axes[0] ^ np.where(inverted, low, swapped)
            axes[i] = axes[i] ^ swapped
        level >>= 1
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    flip = np.zeros(len(cells), np.uint32)
    level = top
    while level > 1:
        flip ^= np.where(axes[-1] & np.uint32(level), np.uint32(level - 1), np.uint32(0))
        level >>= 1
    planes = [((axis ^ flip) >> np.uint32(b)) & np.uint32(1) for b in range(bits - 1, -1, -1) for axis in axes]
    return [row.tobytes() for row in np.packbits(np.stack(planes, 1).astype(np.uint8), axis=1)]


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to a vector of the box; equal distances stay."""
    nearest = np.maximum(np.maximum(low - centroids, centroids - high), 0)
    furthest = np.maximum(np.abs(low - centroids), np.abs(high - centroids))
    least, most = (nearest * nearest).sum(1), (furthest * furthest).sum(1)
    near = np.flatnonzero(least <= most.min())
    if len(near) == 1:
        return near
    # Against the centroid of the smallest upper bound: its distance less another's is linear, so its greatest value in the
    # box is at a corner. Below zero at that corner, the other is further away everywhere.
    best = int(most.argmin())
    slope = 2 * (centroids[near] - centroids[best])
    corner = np.where(slope > 0, high, low)
    offset = (centroids[best] ** 2).sum() - (centroids[near] ** 2).sum(1)
    return near[(slope * corner).sum(1) + offset >= 0]


def nearest_of(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smaller of equal ones) and the squared distance, exact."""
    size = max(int(np.abs(vectors).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if vectors.shape[1] * (2 * size) ** 2 < EXACT:
        x, c = vectors.astype(np.float64), centroids.astype(np.float64)
        far = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
    else:
        far = np.stack([((vectors - c) ** 2).sum(1) for c in centroids], 1)
    at = far.argmin(1)
    return at, far[np.arange(len(at)), at].astype(np.int64)


def cluster_frames(
    frames: DataFrame, frame_id: str = "frame_id", landmarks: str = "landmarks", components: int = 64, clusters: int = 8, rounds: int = 10, scale: int = 1024, seed: int = 3
) -> DataFrame:
    """Clusters of pose frames by their landmarks: (frame_id, cluster, distance, cluster_inertia, inertia, centroid_sha256).

    landmarks is an array of numbers (33 landmarks of x and y give 66 components). Frames with exactly that many
    components, none null or non-finite, are clustered, whatever attempt they come from; others are left out. A component x
    becomes floor(scale * x); values beyond +-2**27 saturate. The first centroids are the frames with the smallest SHA-256
    of "seed:frame_id" (a null id as empty; of repeated ids the smaller vector first), fewer if there are fewer frames.
    Each round gives every frame to its nearest centroid by squared distance (of equal ones the smaller number) and replaces
    it by the componentwise floor of the mean of its frames; a centroid without frames stays. Rounds that would change
    nothing are passed over. Then frames are given once more: distance is squared, cluster_inertia its sum over the
    cluster, inertia over all frames, centroid_sha256 of the centroid's numbers joined by commas. All sums are exact.
    Repeated rows and null ids are clustered and returned like others. Further columns are ignored.
    """
    spark, kind = frames.sparkSession, frames.schema[frame_id].dataType.simpleString()
    rows = frames.select(F.col(frame_id).cast("string").alias("id"), F.col(landmarks).cast("array<double>").alias("v"))
    rows = rows.where((F.size("v") == components) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))))

    def whole(frame: pd.DataFrame) -> np.ndarray:
        stacked = np.stack(frame["v"].to_numpy()) if len(frame) else np.empty((0, components))
        return np.clip(np.floor(stacked * float(scale)), -REACH, REACH).astype(np.int32)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, total, squares = 0, np.zeros(components), np.zeros(components)
        for frame in batches:
            x = whole(frame).astype(np.float64)
            count, total, squares = count + len(x), total + x.sum(0), squares + (x * x).sum(0)
        if count:
            yield pd.DataFrame({"at": np.arange(components), "n": float(count), "total": total, "squares": squares})

    # Two numbers of each component, for the cells of the curve only.
    moments = rows.select("v").mapInPandas(spread, "at int, n double, total double, squares double").groupBy("at").agg(F.sum("n"), F.sum("total"), F.sum("squares")).orderBy("at").collect()
    schema = f"{frame_id} {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not moments:
        return spark.createDataFrame([], schema)
    count, total, squares = (np.array(x, float) for x in list(zip(*moments, strict=True))[1:])
    centre = total / count
    width = np.sqrt(np.maximum(squares / count - centre**2, 0)) + 1

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for at in range(0, len(frame), 2000):
                part = frame.iloc[at : at + 2000]
                x = whole(part)
                cells = np.clip(((x - centre) / width + 2) * (1 << (BITS - 2)), 0, (1 << BITS) - 1)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "place": curve_places(cells, BITS), "packed": [r.tobytes() for r in x]})

    placed = rows.mapInPandas(place, "id string, place binary, packed binary")
    # The row number parts frames at one place, so that many equal ones don't meet in one task.
    ordered = placed.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(partitions(spark), "place", "row").sortWithinPartitions("place", "row")

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            made: dict[str, list] = {k: [] for k in ("ids", "vectors", "low", "high", "total")}
            for at in range(0, len(frame), BLOCK):
                part = frame.iloc[at : at + BLOCK]
                raw = b"".join(part["packed"])
                x = np.frombuffer(raw, np.int32).reshape(-1, components)
                for k, v in (("ids", part["id"].tolist()), ("vectors", raw), ("low", x.min(0).tobytes()), ("high", x.max(0).tobytes()), ("total", x.sum(0, dtype=np.int64).tobytes())):
                    made[k].append(v)
            yield pd.DataFrame(made)

    blocks = cut(ordered.select("id", "packed").mapInPandas(block, "ids array<string>, vectors binary, low binary, high binary, total binary"))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("id", F.lit(""))).cast("binary"), 256)
    first = placed.select(drawn.alias("drawn"), "packed").orderBy("drawn", "packed").limit(clusters).collect()
    centroids = np.stack([np.frombuffer(bytes(r["packed"]), np.int32) for r in first]).astype(np.int64)

    def unpack(row: object, name: str, kind_of: type = np.int32) -> np.ndarray:
        return np.frombuffer(getattr(row, name), kind_of).astype(np.int64)

    def means(now: np.ndarray) -> list[tuple[int, int, int]]:
        """Of each cluster with frames and each component: the floor of the mean of its frames."""

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n, sum_of = np.zeros(len(now), np.int64), np.zeros((len(now), components), np.int64)
            for frame in batches:
                for row in frame.itertuples():
                    near = candidates(unpack(row, "low"), unpack(row, "high"), now)
                    if len(near) == 1:
                        n[near[0]] += len(row.ids)
                        sum_of[near[0]] += unpack(row, "total", np.int64)
                        continue
                    x = unpack(row, "vectors").reshape(-1, components)
                    at, _ = nearest_of(x, now[near])
                    n += np.bincount(near[at], minlength=len(now))
                    for i, k in enumerate(near):
                        sum_of[k] += x[at == i].sum(0)
            some = np.flatnonzero(n)
            yield pd.DataFrame({"cluster": np.repeat(some, components), "at": np.tile(np.arange(components), len(some)), "n": np.repeat(n[some], components), "total": sum_of[some].reshape(-1)})

        wide = F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
        found = blocks.select("ids", "vectors", "low", "high", "total").mapInPandas(add, "cluster int, at int, n long, total long").groupBy("cluster", "at").agg(*wide)
        return [(r["cluster"], r["at"], int(r["total"]) // int(r["n"])) for r in found.collect()]

    for _ in range(rounds):
        moved = centroids.copy()
        for k, at, mean in means(centroids):
            moved[k, at] = mean
        if (moved == centroids).all():
            break
        centroids = moved

    def given(row: object) -> tuple[np.ndarray, np.ndarray]:
        near = candidates(unpack(row, "low"), unpack(row, "high"), centroids)
        at, far = nearest_of(unpack(row, "vectors").reshape(-1, components), centroids[near])
        return near[at], far

    def spent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            own = [given(row) for row in frame.itertuples()]
            at, far = (np.concatenate(x) for x in zip(*own, strict=True)) if own else (np.empty(0, int), np.empty(0, np.int64))
            some = np.unique(at)
            yield pd.DataFrame({"cluster": some, "far": [str(sum(far[at == k].tolist())) for k in some]})

    costs = blocks.mapInPandas(spent, "cluster int, far string").groupBy("cluster").agg(F.sum(F.col("far").cast("decimal(38,0)")).alias("far")).collect()
    inertia = np.zeros(len(centroids), np.int64)
    for r in costs:
        inertia[r["cluster"]] = int(r["far"])
    names = np.array([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()], object)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for start in range(0, len(frame), 32):
                part = list(frame.iloc[start : start + 32].itertuples())
                at, far = (np.concatenate(x) for x in zip(*map(given, part), strict=True))
                yield pd.DataFrame({"id": np.concatenate([row.ids for row in part]), "cluster": at, "distance": far, "cluster_inertia": inertia[at], "inertia": inertia.sum(), "centroid_sha256": names[at]})

    out = blocks.mapInPandas(assign, "id string, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.select(F.col("id").cast(kind).alias(frame_id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
