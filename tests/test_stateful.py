"""Order-dependent rules against plain loops."""

import random

from pyspark.sql import functions as F

from paceline.operators import fusion as U
from paceline.operators import library as L
from paceline.operators import review as W
from paceline.operators import series as S


def weight(kind, conf):
    return {"High": 3.0, "Medium": 2.0}.get(conf, 0.75) * {"color": 1.15, "audio": 1.0}.get(kind, 0.35)


def centre(cluster):
    tests = [lambda k, c: k == "audio" and c == "High", lambda k, c: k == "color" and c in ("High", "Medium"), lambda k, c: k == "audio" and c in ("High", "Medium"), lambda k, c: k == "color", lambda k, c: k != "motion", lambda k, c: True]
    for t in tests:
        items = [(weight(k, c), x) for x, k, c in cluster if t(k, c)]
        if items:
            return sum(w * x for w, x in items) / sum(w for w, _ in items)


def test_evidence_clusters(spark):
    r = random.Random(3)
    rows = sorted((round(r.random() * 12, 3), i, r.choice(["color", "audio", "motion"]), r.choice(["High", "Medium", "Low"])) for i in range(60))
    clusters, want = [], {}
    for t, i, k, c in rows:
        hit = next((n for n, cl in enumerate(clusters) if abs(centre(cl) - t) <= 0.38), None)
        if hit is None:
            clusters.append([])
            hit = len(clusters) - 1
        clusters[hit].append((t, k, c))
        want[i] = hit
    ev = spark.createDataFrame([(1, i, k, t, c) for t, i, k, c in rows], "attempt_id long, ord long, kind string, raw_time double, confidence string")
    got = {q.ord: q.cluster_id for q in U.cluster_evidence(ev).collect()}
    pairs = {(want[i], got[i]) for i in want}
    assert len(pairs) == len(clusters) == len({g for _, g in pairs})


def test_candidate_merge(spark):
    r = random.Random(4)
    rows = [(1, round(r.randrange(200) / 100, 3), float(i), r.choice(["A", "B", "C"]), r.choice(["Low", "Medium", "High"])) for i in range(70)]
    kept = []
    for _, t, ins, kind, conf in rows:
        old = next((k for k in kept if abs(k["t"] - t) <= 0.02), None)
        if old is None:
            kept.append({"t": t, "kinds": [kind], "conf": conf})
            continue
        if kind not in old["kinds"]:
            old["kinds"].append(kind)
        order = ["Low", "Medium", "High"]
        old["conf"] = max(old["conf"], conf, key=order.index)
    df = spark.createDataFrame(rows, "attempt_id long, raw_time double, ins double, kind string, confidence string").withColumn("ins", F.col("ins").cast("bigint")).withColumns(
        {"climb_time": F.lit(0.0), "score": F.lit(1.0), "thr": F.lit(1.0), "committed_thr": F.lit(1.0), "max_motion": F.lit(1.0), "boundary_risk": F.lit(False), "suspicious": F.lit(False), "persistence": F.lit(1).cast("bigint"), "preload": F.lit(False)})
    got = sorted((q.raw_time, q.kind, q.confidence) for q in S.merge_candidates(df).collect())
    assert got == sorted((k["t"], " + ".join(k["kinds"]), k["conf"]) for k in kept)


def test_library_merge_counts_intermediate_winners(spark):
    cur = spark.createDataFrame([("a", "2024-01-05", None, "old"), ("b", "2024-01-05", "lin", "b")], "attempt_id string, updated_at string, lineage_id string, name string")
    imp = spark.createDataFrame([(0, "a", "2024-01-06", "x", "n1"), (1, "a", "2024-01-05", "y", "n2"), (2, "a", "2024-01-09", "z", "n3"), (3, "b", "2024-01-05", None, "tie"), (4, "c", "bad date", None, "new"), (5, "c", "2024-01-01", "late", "newer"),
                                 (6, "b", "2024-02-01", "other", "b2")], "import_ord long, attempt_id string, updated_at string, lineage_id string, name string")
    effects = {r.import_ord: r.effect for r in L.classify_imports(cur, imp).collect()}
    assert effects == {0: "updated", 1: "unchanged", 2: "updated", 3: "unchanged", 4: "added", 5: "updated", 6: "updated"}
    out = {r.attempt_id: (r.name, r.lineage_id) for r in L.merge_libraries(cur, imp, ["name"]).collect()}
    assert out == {"a": ("n3", "x"), "b": ("b2", "lin"), "c": ("newer", "late")}


def test_request_ledger(spark):
    r = random.Random(8)
    rows = [(f"o{r.randrange(3)}", f"2024-01-0{1 + i // 40}", f"r{r.randrange(25)}", f"f{r.randrange(20)}", i) for i in range(200)]
    asked, spent, want = set(), {}, {}
    for o, d, q, f, i in rows:
        if (o, "r", q) in asked or (o, "f", f) in asked:
            want[i] = "existing"
        elif spent.get((o, d), 0) >= 2:
            want[i] = "limited"
        else:
            asked |= {(o, "r", q), (o, "f", f)}
            spent[(o, d)] = spent.get((o, d), 0) + 1
            want[i] = "created"
    df = spark.createDataFrame(rows, "owner string, day string, request_id string, fingerprint string, ord long")
    assert {x.ord: x.state for x in W.reserve_requests(df, 2).collect()} == want
    assert set(want.values()) == {"created", "existing", "limited"}


def test_lane_merge_keeps_priority(spark):
    z = lambda x: (x, 0.5, x + 0.05, 0.55)
    rows = [(1, i, z(x), 1.0, 1.0, None) for i, x in enumerate([0.1, 0.12, 0.14, 0.3, 0.31])]
    df = spark.createDataFrame(rows, "attempt_id long, ord int, zone struct<x1:double,y1:double,x2:double,y2:double>, score double, start_s double, body struct<x1:double,x2:double>")
    assert [p.ord for p in U.lane_pool(df).first().pool] == [0, 2, 3]
