"""Baselines out of a whole library against a double loop, with a hot athlete and athletes without a name."""

import random

from pyspark.sql import functions as F

from paceline.operators import compare as C

SCHEMA = "attempt_id long, athlete string, lineage_id string, name string, date string, file_name string, duration_s double, width int, height int, range_start double, range_end double, timing_state string, total_s double, b string, c int"
KEYS = [x.split()[0] for x in SCHEMA.split(", ")]


def library(seed, count):
    rnd = random.Random(seed)
    rows = []
    for i in range(count):
        athlete = rnd.choice(["hot"] * 6 + ["a", "b", None])
        start = rnd.choice([None, float(rnd.randint(0, 3))])
        rows.append((i, athlete, rnd.choice([None, "l1", "l2", " ", "practice-v1-a", f"own{i}"]), f"n{i}", rnd.choice(["2024-01-01", None]), rnd.choice(["v.mov", "w.mov", ""]), rnd.choice([10.0, 12.0]), 1080, 1920,
                     start, None if start is None else start + 5.0, rnd.choice(["accepted", "accepted", "review", None]), rnd.choice([None, 6.5]), "x", 1))
    return rows


def lineage(r):
    t = r["lineage_id"]
    return t if t and t.strip() else str(r["attempt_id"])


def plain(rows):
    rows = [dict(zip(KEYS, r, strict=True)) for r in rows]
    out = []
    for c in rows:
        if c["attempt_id"] % 20:
            continue
        for b in rows:
            if b["athlete"] != c["athlete"]:
                continue
            same = lineage(b) == lineage(c)
            details = b["file_name"] and all(b[k] == c[k] for k in ("file_name", "duration_s", "width", "height"))
            overlap = details and b["range_start"] is not None and c["range_start"] is not None and max(b["range_start"], c["range_start"]) < min(b["range_end"], c["range_end"])
            practice = lambda r: r["lineage_id"] in ("practice-v1-a", "practice-v1-b")
            reason = "current-attempt" if b["attempt_id"] == c["attempt_id"] else "same-attempt" if same else "practice-baseline" if practice(b) != practice(c) else "timing-needs-review" if b["timing_state"] != "accepted" else None
            out.append((c["attempt_id"], b["attempt_id"], b["name"], b["date"], b["total_s"], reason is None, reason, bool(reason is None and overlap)))
    return sorted(out, key=str)


def test_every_attempt_of_the_library_is_offered(spark):
    rows = library(2, 400)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for part_rows in (4096, 40, 1):
        found = C.baseline_choices(df, F.col("attempt_id") % 20 == 0, "practice-v1-", part_rows).collect()
        assert sorted(map(tuple, found), key=str) == plain(rows)
    reasons = {r["reason"] for r in found}
    assert reasons == {None, "current-attempt", "same-attempt", "practice-baseline", "timing-needs-review"}
    assert any(r["needs_confirmation"] for r in found)


def test_a_hot_athlete_spreads_over_tasks(spark):
    df = spark.createDataFrame([(i, "hot", None, "n", None, "v", 1.0, 1, 1, None, None, "accepted", 1.0, "x", 1) for i in range(4000)], SCHEMA)
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for k, v in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.shuffle.partitions", "8")):
            spark.conf.set(k, v)
        tasks = C.baseline_choices(df, F.col("attempt_id") % 400 == 0, "practice-v1-", 100).withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert sum(r["count"] for r in tasks) == 4000 * 10
    assert len(tasks) == 8 and max(r["count"] for r in tasks) < 12_000


def test_nothing_chosen_and_empty_libraries(spark):
    df = spark.createDataFrame(library(3, 50), SCHEMA)
    assert C.baseline_choices(df, F.lit(False), "p").collect() == [] and C.baseline_choices(df, F.lit(None).cast("boolean"), "p").collect() == []
    assert C.baseline_choices(spark.createDataFrame([], SCHEMA), F.lit(True), "p").collect() == []
