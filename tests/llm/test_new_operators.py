"""Frame clusters, quality rules and periodic runs against brute force on small records of attempts and frames."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("xxhash")

from paceline.llm.clusters import BLOCK, candidates, cluster_frames, curve_places, nearest_of
from paceline.llm.periods import find_periodic_runs, periodic_runs
from paceline.llm.rules import judge_notes, repeated_words

NOTES = "attempt_id string, notes string, location string, id long, text string, site string, row int, d1 long, w int"


def attempts(spark, rows):
    """Attempts with further columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, 1, "x", "s", 2, 3, 4) for r in rows], NOTES).repartition(3)


# --- clusters ---


def brute_clusters(frames, components, clusters, rounds, scale, seed):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in frames if v is not None and len(v) == components and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], np.int32).tobytes()))[:clusters]
    centroids = [v for _, v in start]

    def give():
        out = []
        for _, v in kept:
            far = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids]
            out.append((far.index(min(far)), min(far)))
        return out

    for _ in range(rounds):
        own = give()
        for k in range(len(centroids)):
            mine = [v for (_, v), (c, _) in zip(kept, own, strict=True) if c == k]
            if mine:
                centroids[k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    own = give()
    cost = Counter()
    for k, d in own:
        cost[k] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, k, d, cost[k], sum(cost.values()), names[k]) for (i, _), (k, d) in zip(kept, own, strict=True)), key=str)


def poses(seed, count, components):
    rnd = random.Random(seed)
    centres = [[rnd.uniform(-1, 1) for _ in range(components)] for _ in range(5)]
    rows = [(f"f{i}", [x + rnd.gauss(0, 0.2) for x in centres[i % 5]]) for i in range(count)]
    rows += [("f1", rows[1][1])] * 3 + [(None, rows[2][1]), (None, rows[3][1])] + [(f"same{i}", rows[0][1]) for i in range(700)]
    rows += [("no", None), ("short", [1.0] * (components - 1)), ("gap", [None] + [1.0] * (components - 1)), ("nan", [float("nan")] * components), ("inf", [float("inf")] + [0.0] * (components - 1)), ("empty", [])]
    return rows


@pytest.mark.parametrize(("components", "clusters", "rounds"), [(6, 8, 10), (66, 5, 3), (2, 8, 10), (1, 3, 0)])
def test_clusters_equal_plain_rounds(spark, components, clusters, rounds):
    rows = poses(components, 400, components)
    frames = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "frame_id string, landmarks array<double>, id string, place int").repartition(5)
    found = cluster_frames(frames, components=components, clusters=clusters, rounds=rounds)
    assert sorted(map(tuple, found.collect()), key=str) == brute_clusters(rows, components, clusters, rounds, 1024, 3)


def test_clusters_of_few_or_no_frames(spark):
    schema = "frame_id long, landmarks array<double>"
    assert cluster_frames(spark.createDataFrame([], schema), components=2).collect() == []
    assert cluster_frames(spark.createDataFrame([(1, None)], schema), components=2).collect() == []
    few = [(9007199254740993, [0.5, 0.25]), (None, [-0.5, 1e30])]
    found = {r["frame_id"]: r for r in cluster_frames(spark.createDataFrame(few, schema), components=2).collect()}
    assert set(found) == {9007199254740993, None} and all(r["distance"] == 0 for r in found.values())


def test_boxes_never_pass_over_the_nearest_centroid():
    rnd = np.random.default_rng(1)
    alone = 0
    for _ in range(300):
        x = rnd.integers(-40, 40, 3) + rnd.integers(-9, 9, (20, 3))
        centroids = rnd.integers(-60, 60, (6, 3))
        near = candidates(x.min(0), x.max(0), centroids)
        at, far = nearest_of(x, centroids)
        own, same = nearest_of(x, centroids[near])
        assert (near[own] == at).all() and (same == far).all()
        alone += len(near) == 1
    assert alone > 30
    big = rnd.integers(-(1 << 27), 1 << 27, (5, 64))
    assert (nearest_of(big, big[:2])[1] == [min(sum((int(a) - int(b)) ** 2 for a, b in zip(v, c, strict=True)) for c in big[:2]) for v in big]).all()


def test_places_follow_the_curve():
    cells = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    order = sorted(range(len(cells)), key=curve_places(cells, 3).__getitem__)
    steps = np.abs(np.diff(cells[order], axis=0)).sum(1)
    assert len(set(curve_places(cells, 3))) == 512 and (steps == 1).all()
    assert BLOCK > 1


# --- quality rules ---


def brute_measures(text):
    text = text or ""
    words = text.encode().split()
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    doubles = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), doubles, len(covered)


def normal(line):
    import re

    return re.sub(rb"[0-9]+", b"0", b" ".join(line.encode().split()).lower())


def brute_rules(rows, most_attempts, most_percent):
    sites, held = {}, {}
    for _, t, s in rows:
        t = t or ""
        sites.setdefault(s, set()).add(t)
        for x in t.split("\n"):
            if x.encode().split():
                held.setdefault((s, normal(x)), set()).add(t)
    out = []
    for i, t, s in rows:
        m = brute_measures(t)
        lines = [(k, x) for k, x in enumerate((t or "").split("\n")) if x.encode().split()]
        gone = [(k, x) for k, x in lines if len(held[s, normal(x)]) > most_attempts and 100 * len(held[s, normal(x)]) > most_percent * len(sites[s])]
        lost = sum(len(x.encode().split()) for _, x in gone)
        failed = m[0] < 50 or 100 * m[4] > 50 * m[0]
        left = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in {k for k, _ in gone})
        out.append((i, *m, failed, len(lines), [k for k, _ in gone], lost, not failed and 100 * (m[0] - lost) >= 50 * m[0], left))
    return sorted(out, key=str)


def notes_of_sites():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(300)] + ["é#", "|x|", "ünï"]
    rows = [("a", None, "hall"), (None, "", "hall"), ("b", " \n\t\n", None), ("c", "x\r\nx\r\nX", "gym")]
    for i in range(120):
        site = rnd.choice(["hall", "hall", "gym", None])
        lines = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 30))) for _ in range(rnd.randint(1, 6))]
        if i % 2:
            lines.insert(rnd.randint(0, len(lines)), f"Visited  {i} times, All rights reserved " + " ".join(f"w{k}" for k in range(60)))
        if i % 5 == 0:
            lines = lines * 3
        rows.append((f"n{i}", "\n".join(lines), site))
    rows += [rows[-1]] * 4 + [(f"copy{i}", "one text that many copy\n" + "z " * 30 + " ".join(f"q{k}" for k in range(60)), "hall") for i in range(60)]
    return rows


def test_rules_equal_plain_counts(spark):
    rows = notes_of_sites()
    found = sorted((tuple(r) for r in judge_notes(attempts(spark, rows), clean=True).collect()), key=str)
    expected = brute_rules(rows, 10, 5)
    assert found == expected
    assert any(r[8] for r in expected) and {r[10] for r in expected} == {True, False}
    assert all(r[10] for r in found if (r[0] or "").startswith("copy"))  # a copied text is not boilerplate


def test_rules_on_nothing_and_on_a_long_text(spark):
    assert judge_notes(attempts(spark, [])).collect() == []
    rnd = random.Random(4)
    long = "\n".join(" ".join(f"v{rnd.randrange(50_000)}" for _ in range(40)) for _ in range(20_000))
    row = judge_notes(attempts(spark, [("long", long, "hall")])).collect()[0]
    assert row["n_words"] == 800_000 and row["kept"] and row["removed_lines"] == []


def test_repeated_words_stay_inside_their_text():
    rows = [b"a b c".split(), b"a b c d a b c".split(), [], b"x x x x".split(), b"c a b c".split()]
    assert repeated_words(rows).tolist() == [0, 6, 0, 4, 0]


# --- periodic runs ---


def brute_runs(words, least_length=24, least_repeats=3):
    found = {}
    for q in range(1, len(words) // least_repeats + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least_length, least_repeats * q):
                covered = any(s <= i and s + n >= j + q for s, n, _ in found.values())
                if not covered:
                    found[(i, q)] = (i, j - i + q, q)
            i = max(j, i + 1)
    return sorted(found.values(), key=lambda r: (r[0], r[2]))


def periodic_texts():
    rnd = random.Random(9)
    rows = [("a", None), ("b", ""), (None, " \n "), ("c", "x " * 23), ("d", "x " * 24), ("e", "x y " * 12), ("e", "x y " * 12), ("f", "a b " * 12 + "a b c " * 12)]
    for i in range(150):
        alphabet = [f"w{k}" for k in range(rnd.choice((1, 2, 3, 5, 40)))]
        words = []
        for _ in range(rnd.randint(1, 5)):
            words += [rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))]
            block = [rnd.choice(alphabet) for _ in range(rnd.randint(1, 40))]
            words += (block * 9)[: rnd.randint(0, 5 * len(block))]
        rows.append((f"t{i}", "\n".join(words)))
    return rows


def test_runs_equal_plain_search(spark):
    rows = periodic_texts()
    expected = []
    for i, t in rows:
        words = (t or "").split()
        runs = brute_runs(words)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        expected.append((i, len(words), runs, " ".join(w for k, w in enumerate(words) if k not in gone)))
    found = find_periodic_runs(attempts(spark, [(i, t, "hall") for i, t in rows])).collect()
    assert sorted(((r[0], r[1], [tuple(x) for x in r[2]], r[3]) for r in found), key=str) == sorted(expected, key=str)
    assert sum(len(r[2]) > 1 for r in expected) > 20
    assert find_periodic_runs(attempts(spark, [])).collect() == []


@pytest.mark.parametrize("least", [3, 6, 24])
def test_runs_of_few_words(least):
    rnd = random.Random(least)
    for _ in range(400):
        codes = np.array([rnd.randrange(rnd.choice((1, 2, 3))) for _ in range(rnd.randint(0, 60))], np.int64)
        assert list(zip(*(x.tolist() for x in periodic_runs(codes, least, 3)), strict=True)) == brute_runs(codes.tolist(), least)


def test_runs_of_a_very_long_text():
    codes = np.concatenate([np.arange(10, 100_010), np.tile(np.arange(1000) % 997, 300), [5], np.zeros(400_000, np.int64)])
    start, length, period = periodic_runs(codes, 24, 3)
    assert (100_000, 300_000, 1000) in set(zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
    assert (400_001, 400_000, 1) in set(zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
