"""Upper patches: small areas near the top of a frame that turn to a new lasting colour.

Frames come as cells (recording_id, ms, x, y, r, g, b), one row per position and whole millisecond.  The cells of a
recording come together in one task, which adds them up on the grids of its frames, GRID_FRAMES at a time, and judges all
patches there; only changes leave it.  Cells that already lie by recording are neither shuffled nor written; a task holds
one recording, which its length bounds, and looking ahead is bounded by HORIZON_MS.  Tables of frames grow with the input
but look small to the planner, which doesn't know how many cells a row becomes: they are merged, never broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from .colour import CHANNELS, GRID_FRAMES

RADII = (0, 1, 2)
RING = 3  # cells around a patch that count as its surroundings
BAND = (0.015, 0.22)
HORIZON_MS, TAIL_MS = 1600, 620
MOST_CHANGED = 0.26  # share of a frame that may differ from the first frame
LEAST_FRAMES = 8
LOOKED_AHEAD = 200_000  # patch colours behind the candidates that are judged in one piece
FRAME = ["recording_id", "ms"]
PATCH = ["recording_id", "radius", "cx", "cy"]
NO_PLACE = -(1 << 31)  # x or y of a cell that has none


def _half(v: np.ndarray) -> np.ndarray:
    return np.floor(v + 0.5)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of colours along the last axis; NaN where one isn't known."""
    d = a - b
    return np.sqrt(d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2])


def _chroma(v: np.ndarray) -> np.ndarray:
    return v.max(-1) - v.min(-1)


def _luminance(v: np.ndarray) -> np.ndarray:
    return v[..., 0] * 0.2126 + v[..., 1] * 0.7152 + v[..., 2] * 0.0722


def _distinct_hue(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """``colour.distinct_hue`` of arrays."""
    a, b = (v - (v[..., 0] + v[..., 1] + v[..., 2])[..., None] / 3 for v in (before, after))
    dot = lambda u, v: u[..., 0] * v[..., 0] + u[..., 1] * v[..., 1] + u[..., 2] * v[..., 2]
    norms = np.sqrt(dot(a, a)) * np.sqrt(dot(b, b))
    return (_chroma(before) >= 8) & (_chroma(after) >= 8) & (norms != 0) & (dot(a, b) / np.where(norms == 0, 1, norms) <= 0.75)


def search_area(width: int, height: int, lane_x: float | None = None) -> tuple[int, int, int, int]:
    """First and last x and y of the band; a lane low on the wall is mapped toward the middle of the top."""
    low, high = 0.04, 0.96
    if lane_x is not None:
        centre = 0.5 + (lane_x - 0.5) * 0.42
        low, high = (min(max(centre + d, 0.02), 0.98) for d in (-0.21, 0.21))
    return max(1, math.floor(width * low)), min(width - 2, math.ceil(width * high)), max(1, math.floor(height * BAND[0])), min(height - 2, math.ceil(height * BAND[1]))


def patches_of(width: int, height: int, lane_x: float | None = None) -> np.ndarray:
    """(radius, x, y) of every patch of the band."""
    x1, x2, y1, y2 = search_area(width, height, lane_x)
    along = lambda first, last, r: range(max(first + r, 0), max(last - r, first + r - 1) + 1, max(2, r + 1))
    return np.array([(r, x, y) for r in RADII for y in along(y1, y2, r) for x in along(x1, x2, r)], np.int64).reshape(-1, 3)


class Cells:
    """The cells of one recording: frame (by time, one without a time first), x, y and colour of each, NaN where not known.

    They come a frame a row (ms, cells): a row for each cell costs far more on its way to Python.
    """

    def __init__(self, frames: list[pa.RecordBatch]) -> None:
        held = pa.Table.from_batches(frames).combine_chunks()
        lists = pa.concat_arrays(held["cells"].chunks)
        ms = held["ms"].combine_chunks().take(pa.array(np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))))
        timeless = np.asarray(ms.is_null())
        of_cell = dict(zip(("x", "y", *CHANNELS), lists.flatten().flatten(), strict=True))
        ms = ms.fill_null(0).to_numpy(zero_copy_only=False)
        x, y = (of_cell[c].fill_null(NO_PLACE).to_numpy(zero_copy_only=False) for c in "xy")
        colour = np.stack([of_cell[c].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in CHANNELS], 1)
        times, frame = np.unique(ms[~timeless], return_inverse=True)
        #: Frames without a time: they count in means over frames, but are no evidence.
        self.timeless = int(timeless.any())
        self.ms = np.concatenate([np.zeros(self.timeless, times.dtype), times])
        of = np.zeros(len(ms), np.int64)
        of[~timeless] = frame + self.timeless
        order = np.argsort(of, kind="stable")
        self.frame, self.x, self.y, self.colour = of[order], x[order].astype(np.int64), y[order].astype(np.int64), colour[order]


def whole_recordings(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The frames of one recording after another; they lie together, and idx counts them from 0."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        at = 0
        for first in np.flatnonzero(batch.column("idx").to_numpy() == 0).tolist():
            held += [batch.slice(at, first - at)] if first > at else []
            if held:
                yield held
            held, at = [], first
        if at < batch.num_rows:
            held.append(batch.slice(at))
    if held:
        yield held


def patch_means(cells: Cells, patches: np.ndarray, width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean colour of every patch in every frame (NaN where the frame has no cell of it) and of its surroundings (NaN where
    too little of them is in the frame)."""
    r, cx, cy = (patches[:, i, None] for i in range(3))
    place = np.arange(width * height)
    away = np.maximum(np.abs(place % width - cx), np.abs(place // width - cy))
    used = (away <= r + RING).any(0)
    inside, near = ((away <= r + more).T[used].astype(np.float64) for more in (0, RING))
    column = np.where(used, np.cumsum(used) - 1, -1)
    frames, places = len(cells.ms), int(used.sum())
    own, around = (np.full((frames, len(patches), len(CHANNELS)), np.nan) for _ in range(2))
    full = (2 * (patches[:, 0] + RING) + 1) ** 2 - (2 * patches[:, 0] + 1) ** 2
    ends = np.searchsorted(cells.frame, np.arange(0, frames + GRID_FRAMES, GRID_FRAMES))
    for low, (a, b) in zip(range(0, frames, GRID_FRAMES), zip(ends, ends[1:], strict=False), strict=False):
        x, y, n = cells.x[a:b], cells.y[a:b], min(GRID_FRAMES, frames - low)
        # cells outside the grid belong to no patch
        at = np.where((x >= 0) & (x < width) & (y >= 0) & (y < height), column[np.clip(y, 0, height - 1) * width + np.clip(x, 0, width - 1)], -1)
        kept = at >= 0
        flat, colour = ((cells.frame[a:b] - low) * places + at)[kept], cells.colour[a:b][kept]
        grid = lambda w: np.bincount(flat, w, n * places).reshape(n, places)
        held = grid(np.ones(len(flat)))
        n_inside, n_near = held @ inside, held @ near
        ring = n_near - n_inside
        known = ~np.isnan(colour)
        with np.errstate(invalid="ignore", divide="ignore"):
            for k in range(len(CHANNELS)):
                sums = grid(np.where(known[:, k], colour[:, k], 0))
                in_sum, near_sum = sums @ inside, sums @ near
                own[low : low + n, :, k] = np.where(n_inside > 0, _half(in_sum / n_inside), np.nan)
                some = True if known[:, k].all() else grid(known[:, k].astype(np.float64)) @ near > 0
                around[low : low + n, :, k] = np.where((ring >= np.maximum(8.0, full * 0.5)) & some, _half((near_sum - in_sum) / ring), np.nan)
    return own, around


def frame_facts(cells: Cells) -> tuple[int, np.ndarray, np.ndarray]:
    """How many frames are early ones, and per frame: the change of exposure against those, and the share of cells whose
    structure changed against the first frame once the exposure of the whole frame is taken off."""
    n = len(cells.ms)
    base_n = min(8, max(4, math.floor(n * 0.14)))
    known = ~np.isnan(cells.colour)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.stack([_half(np.bincount(cells.frame[own], c[own], n) / np.bincount(cells.frame[own], minlength=n)) for c, own in zip(cells.colour.T, known.T, strict=True)], 1)
        early = mean[:base_n]
        base = _half(np.nansum(early, 0) / (~np.isnan(early)).sum(0))
        exposure = _distance(mean, base) * 0.95
        timed = cells.frame >= cells.timeless
        frame, colour = cells.frame[timed], cells.colour[timed]
        _, first, place = np.unique((cells.x[timed] << 32) + cells.y[timed], return_index=True, return_inverse=True)
        shift = np.abs(colour - colour[first][place] - (mean - mean[0])[frame])
        moved = shift[:, 0] + shift[:, 1] + shift[:, 2] >= 28 * 3
        changed = np.bincount(frame, moved, n) / np.bincount(frame, minlength=n)
    return base_n, exposure, changed


def _looked_ahead(starts: np.ndarray, ends: np.ndarray) -> Iterator[slice]:
    """Candidates a bounded number of rows at a time."""
    total, at = np.cumsum(ends - starts), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + LOOKED_AHEAD)))
        yield slice(at, to)
        at = to


def _first_changes(ms: np.ndarray, idx: np.ndarray, n: int, base_n: int, exposure: np.ndarray, changed: np.ndarray, own: np.ndarray, around: np.ndarray) -> dict[int, dict]:
    """The first lasting change of each patch that has one, for patches that stand in the same frames, by their number."""
    rows = len(ms)
    early = idx < base_n
    if not early.any():
        return {}
    before = _half(own[early].mean(0))
    d = _distance(own, before)
    middle = np.median(d[early], 0)
    thr = np.maximum(8.0, middle + np.median(np.abs(d[early] - middle), 0) * 4 + 4)
    corr, still = d - exposure[:, None], changed <= MOST_CHANGED
    on, calm = (corr >= thr) & still[:, None], corr < thr * 0.72
    quiet = np.zeros_like(calm)
    quiet[2:] = calm[1:-1] & calm[:-2]
    end = np.searchsorted(ms, ms + HORIZON_MS, "right")
    seen = end - np.arange(rows)
    count = lambda v: (lambda total: total[end] - total[:-1])(np.concatenate([np.zeros((1, *v.shape[1:]), np.int64), np.cumsum(v, 0)]))
    enough = (idx >= base_n) & (idx < n - 3) & (seen >= 4) & (count(still) >= np.ceil(seen * 0.72))
    patch, row = np.nonzero((on & quiet & enough[:, None] & (count(on) >= np.maximum(3, np.ceil(seen * 0.55))[:, None])).T)
    tail_from = np.maximum(np.searchsorted(ms, ms[end - 1] - TAIL_MS), np.arange(rows))
    found: dict[int, dict] = {}
    for part in _looked_ahead(tail_from[row], end[row]):
        p, i = patch[part], row[part]
        length = end[i] - tail_from[i]
        of = np.repeat(np.arange(len(i)), length)
        at = np.arange(len(of)) - np.repeat(np.cumsum(length) - length - tail_from[i], length)
        lit = on[at, p[of]]
        of, at = of[lit], at[lit]
        colour = own[at, p[of]]
        lights = np.bincount(of, minlength=len(i))
        with np.errstate(invalid="ignore", divide="ignore"):
            after = _half(np.stack([np.bincount(of, c, len(i)) for c in colour.T], 1) / lights[:, None])
            delta = _distance(before[p], after)
            same = _distance(colour, after[of]) <= np.maximum(10.0, delta * 0.42)[of]
            apart = same & (_distance(colour, around[at, p[of]]) >= np.maximum(4.0, np.minimum(10.0, delta * 0.05))[of])
            persistence, need = np.bincount(of[same], minlength=len(i)), np.maximum(2, np.ceil(length * 0.55))
            ratio = _luminance(after) / np.maximum(1.0, _luminance(before[p]))
            good = (lights >= 2) & (delta >= thr[p] * 1.1) & (persistence >= need) & (ratio >= 0.55) & (ratio <= 3.2) & (after.max(1) >= 45) & _distinct_hue(before[p], after)
        local = np.bincount(of[apart], minlength=len(i)) >= need
        for c in np.flatnonzero(good).tolist():
            # candidates stand by patch, then by time
            found.setdefault(int(p[c]), {"ms": ms[i[c]].item(), "localized": bool(local[c]), "persistence": int(persistence[c]), "before": before[p[c]], "after": after[c], "delta": float(delta[c]), "thr": float(thr[p[c]])})
    return found


def patch_changes(cells: DataFrame, width: int, height: int, lane_x: float | None = None, expected_s: float | None = None) -> DataFrame:
    """WN39: the first lasting change of each upper patch.

    The colour is compared with the patch's own early frames, less the change of exposure of the whole frame.  Frames in
    which more than a quarter of the cells changed structure are not evidence.  The new colour must hold to the end of the
    look-ahead, be light-like and of another hue; where it doesn't stand out from its surroundings, confidence is Low.
    Recordings of fewer than eight frames, or grids below 8 x 8, have no changes.  Every position of a frame is expected
    once; repeated cells count with their weight in the means.
    """
    if width < 8 or height < 8:
        cells = cells.where(F.lit(False))
    patches = patches_of(width, height, lane_x)
    rgb = pa.struct([(k, pa.float64()) for k in CHANNELS])
    names = [*PATCH, "ms", "score", "confidence", "localized", "persistence", "before", "after", "delta"]

    def changes_of(frames: list[pa.RecordBatch]) -> list[tuple]:
        held, recording = Cells(frames), frames[0].column("recording_id")[0].as_py()
        base_n, exposure, changed = frame_facts(held)
        own, around = patch_means(held, patches, width, height)
        timed, n = np.arange(len(held.ms)) >= held.timeless, len(held.ms)
        rows = []
        # a patch has a row in the frames that have a cell of it; patches of the same frames are judged at once
        present = ~np.isnan(own[..., 0]) & timed[:, None]
        masks, group = np.unique(present, axis=1, return_inverse=True)
        for g in range(masks.shape[1]):
            idx, some = np.flatnonzero(masks[:, g]), np.flatnonzero(group.ravel() == g)
            for at, c in _first_changes(held.ms[idx], idx, n, base_n, exposure[idx], changed[idx], own[np.ix_(idx, some)], around[np.ix_(idx, some)]).items():
                radius, cx, cy = patches[some[at]].tolist()
                lane = 0.0 if lane_x is None else max(0.0, 18 - abs(cx / width - lane_x) / 0.45 * 18)
                late = 0.0 if expected_s is None else min(24.0, abs(c["ms"] / 1000 - expected_s) * 4)
                score = c["delta"] + c["persistence"] * 5 + lane + max(0.0, float(_chroma(c["after"]) - _chroma(c["before"]))) * 0.3 - late
                confidence = "Low" if not c["localized"] else "High" if c["delta"] >= max(18.0, c["thr"] * 1.65) and c["persistence"] >= 3 else "Medium"
                rows.append((recording, radius, cx, cy, c["ms"], score, confidence, c["localized"], c["persistence"], *(dict(zip(CHANNELS, c[s].tolist(), strict=True)) for s in ("before", "after")), c["delta"]))
        return rows

    def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frames in whole_recordings(batches):
            if rows := changes_of(frames):
                types = [frames[0].schema.field("recording_id").type, pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.string(), pa.bool_(), pa.int32(), rgb, rgb, pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    colour = f"struct<{', '.join(f'{k}:double' for k in CHANNELS)}>"
    kind = cells.schema["recording_id"].dataType.simpleString()
    schema = f"recording_id {kind}, radius int, cx int, cy int, ms long, score double, confidence string, localized boolean, persistence int, before {colour}, after {colour}, delta double"
    # A recording without enough frames or without an id has no changes and doesn't go to Python.
    frames = cells.groupBy(*FRAME).agg(F.count("*").alias("cells")).groupBy("recording_id").agg(F.count("*").alias("frames"))
    enough = frames.where(F.col("frames") >= LEAST_FRAMES).select("recording_id")
    packed = cells.groupBy(*FRAME).agg(F.collect_list(F.struct("x", "y", *CHANNELS)).alias("cells"))
    # numbering them brings the frames of a recording together, in order of time
    number = F.row_number().over(Window.partitionBy("recording_id").orderBy("ms")) - 1
    whole = packed.join(enough.hint("merge"), "recording_id", "left_semi").withColumn("idx", number)
    return whole.mapInArrow(changes, schema)


def discover_upper_light(cells: DataFrame, width: int, height: int, lane_x: float | None = None, expected_s: float | None = None, keep: int = 8) -> DataFrame:
    """WN39: one row per recording: the earliest of the credible patch changes, with its zone and calibration.

    Changes are taken best first; one near a better one is the same light.  Credible are those with at least 0.78 of the
    best score.  The folded list is bounded by the patches of a frame.
    """
    found = patch_changes(cells, width, height, lane_x, expected_s)
    item = F.struct((-F.col("score")).alias("o"), "radius", "cy", "cx", "ms", "confidence", "localized", "before", "after", "delta")
    g = found.groupBy("recording_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    same = lambda a, b: F.hypot((a["cx"] - b["cx"]) / width, (a["cy"] - b["cy"]) / height) < 0.035
    kept = F.aggregate("items", F.slice("items", 1, 0), lambda k, q: F.when((F.size(k) >= keep) | F.exists(k, lambda e: same(e, q)), k).otherwise(F.concat(k, F.array(q))))
    g = g.withColumn("kept", kept).withColumn("best", F.get("kept", F.lit(0))["o"])
    # scores are negated here: at least 0.78 of the best
    g = g.withColumn("c", F.array_min(F.transform(F.filter("kept", lambda q: -q["o"] >= -F.col("best") * 0.78), lambda q: F.struct(q["ms"].alias("ms"), q["o"].alias("o"), q.alias("q")))))
    q = F.col("c.q")
    half = lambda v, d: X.clamp(v / d, 0.0, 1.0)
    out = cells.select("recording_id").distinct().join(g.hint("merge"), "recording_id", "left")
    return out.select(
        "recording_id", F.col("c").isNotNull().alias("found"), (q["ms"] / 1000).alias("raw_time"), F.coalesce(q["confidence"], F.lit("None")).alias("confidence"), q["localized"].alias("localized"),
        X.round_ms(F.coalesce(-q["o"], F.lit(0.0))).alias("score"), F.coalesce(F.size("kept"), F.lit(0)).alias("candidates"),
        half(q["cx"] - q["radius"], width).alias("x1"), half(q["cy"] - q["radius"], height).alias("y1"), half(q["cx"] + q["radius"] + 1, width).alias("x2"), half(q["cy"] + q["radius"] + 1, height).alias("y2"),
        *[q["before"][k].cast("int").alias(f"before_{k}") for k in CHANNELS], *[q["after"][k].cast("int").alias(f"after_{k}") for k in CHANNELS], X.round_ms(q["delta"]).alias("colour_delta"))
