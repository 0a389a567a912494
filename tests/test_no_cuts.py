"""Rules that used to drop rows silently: long ranges, long recordings and long chains are kept whole."""

from paceline.operators.evidence import linked_groups
from paceline.operators.pose import first_frames
from paceline.operators.series import sample_grid


def test_a_long_grid_is_given_in_full(spark):
    df = spark.createDataFrame([("long", 0.0, 20000.0, 10.0), ("short", 1.0, 1.5, 4.0)], "id string, s double, e double, fps double")
    got = sample_grid(df, "s", "e", "fps").groupBy("id").agg({"sample": "max", "*": "count"}).collect()
    assert {r["id"]: (r["max(sample)"], r["count(1)"]) for r in got} == {"long": (200000, 200001), "short": (2, 3)}


def test_frames_are_cut_only_where_asked(spark):
    df = spark.range(900).selectExpr("'a' as attempt_id", "id as frame_id", "id / 100.0D as raw_time", "0.0D as start_s", "99.0D as end_s")
    assert first_frames(df).count() == 900
    assert first_frames(df, limit=450).count() == 450


def test_a_long_chain_is_one_group(spark):
    links = [(f"g{i}", i + d) for i in range(300) for d in (0, 1)]
    got = linked_groups(spark.createDataFrame(links, "group_id string, clip_id long"))
    assert {r["component"] for r in got.collect()} == {0} and got.count() == 301
