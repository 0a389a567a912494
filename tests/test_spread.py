"""Short rows of one file that stand for much work are dealt over tasks."""

from paceline.plans import fusion, library, pose, roles, timing

SF = "/root/testdata/sf0.001"


def test_calibrations_are_dealt_out(spark):
    assert pose.calibrations(spark, SF).rdd.getNumPartitions() == 4
    assert "REPARTITION_BY_NUM" in pose.prj24(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_recordings_are_dealt_out(spark):
    assert "REPARTITION_BY_NUM" in fusion.wn54(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_tasks_of_order_lines_grow_with_them(spark, monkeypatch):
    monkeypatch.setattr(roles, "LINES_AT_ONCE", 500)
    wide = timing.wide(spark, SF)
    assert wide.rdd.getNumPartitions() >= 12
    assert len({r.attempt_id for r in wide.collect()}) == wide.count()


def test_all_phases_are_read_in_one_pass(spark):
    plan = library.prj30(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_linenumber#") and plan.count("Relation [l_orderkey") == 1
