"""Steps that used to run once for each of their readers, held whole batches of texts, or grew with the input."""

import random

from pyspark.sql import functions as F

from paceline.functions import text
from paceline.operators import fusion as U
from paceline.operators import trajectory as T
from paceline.plans import colour, library, lights, live, roles, trajectory

SF = "/root/testdata/sf0.001"


def reads(df, column):
    return df._jdf.queryExecution().optimizedPlan().toString().count(f"Relation [{column}")


def test_equal_evidence_has_one_time_in_any_order(spark):
    rng = random.Random(3)
    cues = [(round(rng.uniform(0, 0.59), 3), i, rng.choice(["color", "audio"]), rng.choice(["Medium", "Low"])) for i in range(40)]
    flag = F.lit(True)
    seen = set()
    for _ in range(12):
        rng.shuffle(cues)
        items = spark.createDataFrame(cues, "raw_time double, ord long, kind string, confidence string").coalesce(1)
        items = items.withColumns({"_w": U.evidence_weight(), "observation_interval_s": F.lit(0.02)})
        seen.add(items.groupBy().agg(*U.weighted_time(flag)).select(U.pick_time().alias("t")).first().t)
    assert len(seen) == 1


def test_texts_are_folded_without_arrow_batches(spark):
    texts = [None, "", " Plain ASCII\x1f", "\x0bTAB\t", "Été  ", "　Ｗide ﬁ ", "ÅNGSTRÖM İ", "a\x00B"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.folded("t").alias("f"))
    assert [r.f for r in df.orderBy("i").collect()] == [text.fold(t) for t in texts]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" in plan


def test_finish_cutoffs_read_the_frames_once(spark):
    assert reads(trajectory.wn16(spark, SF), "event_id") == 1
    got = sorted(map(tuple, trajectory.wn16(spark, SF).collect()))
    d, limits = trajectory.descent(spark, SF), trajectory.limits(spark, SF)
    assert got == sorted(map(tuple, T.finish_cutoff(d, T.closest_hand(trajectory.hands(spark, SF), d, limits), limits).collect()))


def test_attempts_without_a_usable_sample_end_at_their_limit(spark):
    kin = spark.createDataFrame([(1, 1.0, None, False, None), (2, 11.0, 3.0, True, 0.1)], "attempt_id int, raw_time double, wall_x double, pose_selected boolean, distance_m double")
    kin = kin.selectExpr("*", "wall_x AS wall_y", "wall_x AS fit_x", "wall_x AS fit_y", "10.1D AS hard_limit_s", "10.1D AS accepted_finish_s", "'High' AS quality", "'High' AS calibration_confidence")
    assert {(r.attempt_id, r.cutoff_s, r.source, r.hand_defined) for r in T.finish_cutoffs(kin).collect()} == {(1, 10.1, "accepted-finish", False), (2, 10.1, "accepted-finish", False)}


def test_interval_evidence_reads_the_frames_once(spark):
    assert reads(trajectory.wn11(spark, SF), "event_id") == 1
    assert reads(trajectory.ag43(spark, SF), "event_id") == 1


def test_thirds_are_compared_without_a_join_of_markers(spark):
    # once for the attempts and once for the tails of their slices
    assert reads(live.jn27(spark, SF), "l_orderkey") == 2


def test_both_readings_of_a_light_learn_from_one_scan(spark):
    df = lights.wn37(spark, SF)
    # the scan, and its first state for the history and for the result
    assert reads(df, "event_id") == 3
    assert df.count() == df.select("attempt_id").distinct().count() > 0


def test_written_libraries_are_parsed_once(spark, monkeypatch):
    from paceline.sources import nested_library as N
    path = library.workdir(spark) + "/lib"
    s = '{"version":1,"id":"%s","name":"n","createdAt":"c","updatedAt":"%s","settings":%s,"timestamps":%s}'
    kept = [s % ("1", "a", "{}", "[]"), s % ("1", "b", "{}", "[]"), s % ("2", "a", "null", "[]"), s % ("3", "a", "{}", "{}"), s % ("4", "a", "{}", "null")]
    records = spark.createDataFrame([(i, t) for i, t in enumerate(kept)], "attempt_id long, session string")
    monkeypatch.setattr(type(records), "count", None)
    N.write_libraries(records, path, "m", "now", sessions=5)
    monkeypatch.undo()
    back = N.library_tables(N.read_written(spark, path, "m"))
    assert [tuple(r) for r in back.attempts.select("attempt_id", "updated_at").collect()] == [("1", "b")]
    assert sorted(r.reason for r in back.rejected.collect()) == ["malformed-session"] * 3 + ["older-copy"]
    both = back.attempts.join(back.markers, "attempt_id", "left")
    assert "LeftSemi" not in both._jdf.queryExecution().optimizedPlan().toString() and reads(both, "value") == 2


def test_tasks_of_frames_grow_with_their_lines(spark, monkeypatch):
    monkeypatch.setattr(roles, "LINES_AT_ONCE", 500)
    assert colour.ag30(spark, SF).rdd.getNumPartitions() >= 12
