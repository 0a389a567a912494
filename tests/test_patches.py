"""Upper patch discovery against a plain loop over frames."""

import math
import random
from statistics import median

from paceline.operators import patches as P

W, H = 14, 30
CELLS = "recording_id long, ms long, x int, y int, r int, g int, b int, around int, idx int"


def wall(seed, lamp=None, at=None, until=math.inf, cover=None, shift=None, frames=40, step=200):
    """Frames of a wall; lamp (x, y) turns at a time, cover is a range of times with a spectator, shift one of more light."""
    rnd = random.Random(seed)
    out = []
    for i in range(frames):
        ms = i * step + rnd.randrange(20)
        more = 40 if shift and shift[0] <= ms < shift[1] else 0
        cells = {}
        for x in range(W):
            for y in range(H):
                c = [90 + (x * 7 + y * 3) % 11 + rnd.randrange(4), 100 + (x + y * 5) % 9 + rnd.randrange(4), 95 + rnd.randrange(4)]
                if lamp and abs(x - lamp[0]) <= 1 and abs(y - lamp[1]) <= 1:
                    c = [180, 60, 60] if at <= ms < until else [60, 140, 60]
                if cover and cover[0] <= ms < cover[1] and x < 7:
                    c = [250, 20, 200]
                cells[x, y] = tuple(min(255, v + more) for v in c)
        out.append((ms, cells))
    return out


def half(v):
    return math.floor(v + 0.5)


def mean(colours):
    return tuple(half(sum(c[k] for c in colours) / len(colours)) for k in range(3))


def dist(a, b):
    return math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b, strict=True)))


def chroma(c):
    return max(c) - min(c)


def hue_differs(a, b):
    if chroma(a) < 8 or chroma(b) < 8:
        return False
    u, v = ([x - sum(c) / 3 for x in c] for c in (a, b))
    return sum(x * y for x, y in zip(u, v, strict=True)) / (math.hypot(*u) * math.hypot(*v)) <= 0.75


def lum(c):
    return c[0] * 0.2126 + c[1] * 0.7152 + c[2] * 0.0722


def plain_changes(frames):
    """{(radius, x, y): (ms, score, confidence, localized)} by loops over patches and frames."""
    n = len(frames)
    if n < 8:
        return {}
    times = [ms for ms, _ in frames]
    base_n = min(8, max(4, math.floor(n * 0.14)))
    means = [mean(list(c.values())) for _, c in frames]
    base = mean(means[:base_n])
    exposure = [dist(m, base) * 0.95 for m in means]
    first = frames[0][1]
    changed = [sum(sum(abs(c[p][k] - first[p][k] - (m[k] - means[0][k])) for k in range(3)) >= 84 for p in first) / len(first) for (_, c), m in zip(frames, means, strict=True)]
    x1, x2, y1, y2 = max(1, math.floor(W * 0.04)), min(W - 2, math.ceil(W * 0.96)), max(1, math.floor(H * 0.015)), min(H - 2, math.ceil(H * 0.22))
    found = {}
    for r in (0, 1, 2):
        for cy in range(y1 + r, y2 - r + 1, max(2, r + 1)):
            for cx in range(x1 + r, x2 - r + 1, max(2, r + 1)):
                own, around = [], []
                for _, c in frames:
                    own.append(mean([c[p] for p in c if abs(p[0] - cx) <= r and abs(p[1] - cy) <= r]))
                    ring = [c[p] for p in c if abs(p[0] - cx) <= r + 3 and abs(p[1] - cy) <= r + 3 and not (abs(p[0] - cx) <= r and abs(p[1] - cy) <= r)]
                    around.append(mean(ring) if len(ring) >= max(8, ((2 * r + 7) ** 2 - (2 * r + 1) ** 2) * 0.5) else None)
                before = mean(own[:base_n])
                d = [dist(c, before) for c in own]
                m = median(d[:base_n])
                thr = max(8, m + median(abs(v - m) for v in d[:base_n]) * 4 + 4)
                corr = [a - b for a, b in zip(d, exposure, strict=True)]
                on = [v >= thr and s <= 0.26 for v, s in zip(corr, changed, strict=True)]
                for i in range(base_n, n - 3):
                    if not on[i] or corr[i - 1] >= thr * 0.72 or corr[i - 2] >= thr * 0.72:
                        continue
                    end = max(j for j in range(n) if times[j] <= times[i] + 1600)
                    seen = range(i, end + 1)
                    if end - i < 3 or sum(on[j] for j in seen) < max(3, math.ceil(len(seen) * 0.55)) or sum(changed[j] <= 0.26 for j in seen) < math.ceil(len(seen) * 0.72):
                        continue
                    last = [j for j in seen if times[j] >= times[end] - 620]
                    tail = [j for j in last if on[j]]
                    if len(tail) < 2:
                        continue
                    after = mean([own[j] for j in tail])
                    delta = dist(before, after)
                    same = [j for j in tail if dist(own[j], after) <= max(10, delta * 0.42)]
                    need = max(2, math.ceil(len(last) * 0.55))
                    if delta < thr * 1.1 or len(same) < need or not 0.55 <= lum(after) / max(1, lum(before)) <= 3.2 or max(after) < 45 or not hue_differs(before, after):
                        continue
                    local = sum(around[j] is not None and dist(own[j], around[j]) >= max(4, min(10, delta * 0.05)) for j in same) >= need
                    score = delta + len(same) * 5 + max(0, chroma(after) - chroma(before)) * 0.3
                    confidence = "Low" if not local else "High" if delta >= max(18, thr * 1.65) and len(same) >= 3 else "Medium"
                    found[r, cx, cy] = (times[i], round(score, 6), confidence, local)
                    break
    return found


RECORDINGS = {
    1: wall(1, (5, 3), 4000), 2: wall(2, (7, 5), 5000, shift=(2500, 9000)), 3: wall(3, (5, 3), 4000, until=4500), 4: wall(4), 5: wall(5, (8, 4), 4200, cover=(6200, 7000)),
    6: wall(6, (3, 4), 3000, frames=7), 7: wall(7, cover=(4000, 9999)), 8: wall(8, (11, 2), 6900),
}


def cells_of(spark, recordings, more=()):
    rows = [(k, ms, x, y, *c, 1, 2) for k, frames in recordings.items() for ms, cells in frames for (x, y), c in cells.items()]
    return spark.createDataFrame(rows + list(more), CELLS).repartition(6)


def test_patch_changes_equal_a_plain_loop(spark):
    found = {}
    for r in P.patch_changes(cells_of(spark, RECORDINGS), W, H).collect():
        found.setdefault(r["recording_id"], {})[r["radius"], r["cx"], r["cy"]] = (r["ms"], round(r["score"], 6), r["confidence"], r["localized"])
    expected = {k: v for k, v in ((k, plain_changes(f)) for k, f in RECORDINGS.items()) if v}
    assert found == expected
    assert {1, 2, 5} <= set(found) and not {3, 4, 6, 7} & set(found)


def test_one_light_is_found_where_and_when_it_turns(spark):
    got = {r["recording_id"]: r for r in P.discover_upper_light(cells_of(spark, RECORDINGS), W, H).collect()}
    assert set(got) == set(RECORDINGS)
    for k, at, x, y in ((1, 4000, 5, 3), (2, 5000, 7, 5), (5, 4200, 8, 4)):
        r = got[k]
        assert r["found"] and r["confidence"] == "High" and 0 <= r["raw_time"] * 1000 - at <= 220
        assert r["x1"] <= (x + 1) / W and r["x2"] >= x / W and r["y1"] <= (y + 1) / H and r["y2"] >= y / H
        assert r["before_g"] > r["before_r"] and r["after_r"] > r["after_g"]
    assert [got[k]["found"] for k in (3, 4, 6, 7)] == [False] * 4 and got[3]["confidence"] == "None"


def test_lane_and_expected_time_weigh_scores(spark):
    cells = cells_of(spark, {1: RECORDINGS[1]})
    plain, guided = (P.discover_upper_light(cells, W, H, *a).collect()[0] for a in ((), (0.4, 4.0)))
    assert guided["found"] and guided["raw_time"] == plain["raw_time"] and guided["score"] > plain["score"]


def test_small_grids_and_empty_tables(spark):
    assert P.discover_upper_light(cells_of(spark, {}), W, H).collect() == []
    assert P.discover_upper_light(cells_of(spark, {1: RECORDINGS[1]}), 7, 30).collect()[0]["found"] is False


def test_frames_are_merged_never_broadcast(spark):
    """The planner takes frames for small, as it can't see how many cells a row becomes."""
    from paceline.plans import patches as Q
    for df in (Q.wn39(spark, "/root/testdata/sf0.001"), Q.wn39_patches(spark, "/root/testdata/sf0.001")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [recording_id" in plan
        assert "BroadcastHashJoin [recording_id" not in plan


def test_cells_are_not_shuffled(spark):
    """Events are dealt by recording while they are few; the cells made of them stay where they are."""
    from paceline.plans import patches as Q
    lines = Q.wn39_patches(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    below = lambda i: lines[i + 1 : next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))]
    exchanges = [i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
    assert exchanges and any("Generate explode" in line for line in lines)
    assert not any("Generate explode" in line for i in exchanges for line in below(i))


def test_cells_without_colour_place_or_time(spark):
    found = lambda df: {(r["radius"], r["cx"], r["cy"], r["ms"], r["score"]) for r in P.patch_changes(df, W, H).collect()}
    plain = cells_of(spark, {1: RECORDINGS[1]})
    # rows that no patch can use: a recording without an id, places outside the grid, none at all
    other = [(None, *r[1:]) for r in map(tuple, plain.collect())] + [(1, RECORDINGS[1][0][0], x, y, 95, 105, 95, 1, 2) for x, y in ((-1, 3), (4, H), (None, 2), (3, None))]
    assert found(plain.union(spark.createDataFrame(other, CELLS))) == found(plain) != set()
    dark = plain.selectExpr("recording_id", "ms", "x", "y", *[f"if(y < 15, null, {k}) as {k}" for k in "rgb"], "around", "idx")
    assert found(dark) == set()
