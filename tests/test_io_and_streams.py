import datetime
import json
import os
import random
import tempfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from paceline.functions.exprs import MARKER_IDS
from paceline.operators import evidence as E
from paceline.operators import markers as M
from paceline.plans import load_all
from paceline.plans.registry import ORACLE, QUERIES
from paceline.sources import library_json as J
from paceline.sources import study_files as Q
from paceline.streaming import feeds as L


def test_worksheet_quotes_and_newlines(spark, tmp_path):
    p = tmp_path / "labels.csv"
    p.write_text('labelId,notes,labelReview.rawTime,labelReview.independentOfDetector\na,"two\nlines, ""quoted""",1.5,true\nb,,,false\n')
    rows = {r.labelId: r for r in Q.read_worksheet(spark, str(p)).collect()}
    assert rows["a"]["notes"] == 'two\nlines, "quoted"' and rows["a"]["labelReview.rawTime"] == 1.5
    assert rows["b"]["labelReview.rawTime"] is None and rows["b"]["labelReview.independentOfDetector"] is False


def test_worksheet_refuses_duplicate_headers(spark, tmp_path):
    p = tmp_path / "bad.csv"
    p.write_text("a,a\n1,2\n")
    with pytest.raises(ValueError):
        Q.read_worksheet(spark, str(p))


def test_library_round_trip(spark, tmp_path):
    good = {"version": 1, "id": "x", "name": "n", "createdAt": "c", "updatedAt": "u", "settings": {"a": 1}, "timestamps": []}
    bad = [{**good, "name": 5}, {**good, "id": ""}, {**good, "location": 3}, {k: v for k, v in good.items() if k != "timestamps"}]
    (tmp_path / "lib.json").write_text(json.dumps({"format": "attempt-library", "version": 1, "exportedAt": "t", "sessions": [good, *bad]}))
    (tmp_path / "other.json").write_text(json.dumps({"format": "else", "version": 1, "exportedAt": "t", "sessions": [good]}))
    rows = J.read_library(spark, str(tmp_path), "attempt-library").collect()
    assert [r.session_id for r in rows] == ["x"]
    out = str(tmp_path / "out")
    J.write_library(spark.createDataFrame([(1, "2024-01-01")], "attempt_id long, date string"), out, "attempt-library", "now")
    assert spark.read.json(out).count() == 1


def test_study_manifest(spark, tmp_path):
    (tmp_path / "study.json").write_text(json.dumps({"version": 1, "studyId": "s", "clips": [{"clipId": "c", "attemptId": "a"}], "predictions": [{"runId": "r", "clipId": "c", "events": {"start": {"status": "accepted", "rawTime": 1.5}}}], "observations": []}))
    s = Q.read_study(spark, str(tmp_path))
    assert Q.study_clips(s).count() == 1 and Q.study_predictions(s).first().raw_time == 1.5 and Q.study_observations(s).count() == 0


def test_library_upsert_newest_wins(spark, tmp_path):
    path = str(tmp_path / "lib")
    a = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y")], "id string, version long, v string")
    b = spark.createDataFrame([("a", 2, "x2"), ("b", 5, "tie"), ("c", 1, "z")], "id string, version long, v string")
    held = lambda: {r.id: r.v for r in L.read_library(spark, path).collect()}
    for i, batch in enumerate((a, b)):
        L.upsert_library(batch, path, "id", "version", 4, i)
    assert held() == {"a": "x2", "b": "y", "c": "z"}
    L.upsert_library(a.withColumn("version", F.lit(99).cast("long")), path, "id", "version", 4, 1)  # replayed: was published
    assert held() == {"a": "x2", "b": "y", "c": "z"}


def test_half_written_batch_is_not_read_and_old_snapshots_expire(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "lib")
    rows = lambda i: spark.createDataFrame([(k, i, f"{k}{i}") for k in "abcdef"[: 6 - i]], "id string, version long, v string")
    held = lambda: {r.id: r.v for r in L.read_library(spark, path).collect()}
    L.upsert_library(rows(0), path, "id", "version", 3, 0)
    before = held()
    with monkeypatch.context() as m:
        m.setattr(L, "_publish", lambda *_: (_ for _ in ()).throw(OSError("driver lost")))
        with pytest.raises(OSError):
            L.upsert_library(rows(1), path, "id", "version", 3, 1)
    assert held() == before
    for i in (1, 2, 3):
        L.upsert_library(rows(i), path, "id", "version", 7, i)  # the stored number of buckets stays 3
    want = {"a": "a3", "b": "b3", "c": "c3", "d": "d2", "e": "e1", "f": "f0"}
    assert held() == want and L.current_snapshot(spark, path)["buckets"] == 3
    L.expire_snapshots(spark, path, keep=1)
    assert held() == want and len([p for p in os.listdir(f"{path}/pointers") if p.isdigit()]) == 1


def feed(spark, folder, rows, schema, parts):
    """rows as that many files, in this order."""
    os.makedirs(folder)
    size = -(-len(rows) // parts)
    for i in range(parts):
        part = pa.Table.from_pylist(rows[i * size : (i + 1) * size], schema=schema)
        pq.write_table(part, f"{folder}/feed{i}.parquet")
        os.utime(f"{folder}/feed{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return folder


def forget_last_commit(work):
    """As after a driver lost between writing a batch and saying so."""
    ids = [int(n) for n in os.listdir(f"{work}/state/commits") if n.isdigit()]
    for name in (f"{max(ids)}", f".{max(ids)}.crc"):
        if os.path.exists(f"{work}/state/commits/{name}"):
            os.remove(f"{work}/state/commits/{name}")


def test_sessions_over_several_triggers_equal_the_batch(spark, tmp_path):
    r = random.Random(3)
    schema = pa.schema([("user_id", pa.int64()), ("ts", pa.timestamp("us", "UTC")), ("value", pa.float64())])
    at = [datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(minutes=m) for m in sorted(r.randrange(40_000) for _ in range(300))]
    folder = feed(spark, str(tmp_path / "in"), [{"user_id": r.randrange(4), "ts": t, "value": r.random()} for t in at], schema, 5)
    table = spark.read.parquet(folder)
    for build, want in ((lambda s: L.tracking_sessions(s, "user_id", "ts", "6 hours", "1 hour"), table.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).count().select("user_id", "w.start", "w.end", "count")),
                        (lambda s: L.sliding_energy(s, "user_id", "ts", "value", "2 hours", "1 hour", "1 hour").select("user_id", "window_start", F.lit(0), "samples"), table.groupBy("user_id", F.window("ts", "2 hours", "1 hour").alias("w")).count().select("user_id", "w.start", F.lit(0), "count"))):
        work = tempfile.mkdtemp(dir=tmp_path)
        got = L.run_to_end(L.file_stream(spark, folder, "feed", 1), build, work, "ts")
        assert len(os.listdir(f"{work}/state/commits")) > 10  # five files, each with its .crc
        expected = sorted(tuple(x) for x in want.collect())
        assert sorted(tuple(x) for x in got.collect()) == expected
        forget_last_commit(work)
        q = L.write_batches(build(L.with_end(L.file_stream(spark, folder, "feed", 1), work)), work)
        assert sorted(tuple(x) for x in spark.read.schema(got.schema).parquet(f"{work}/out").drop("batch").collect()) == expected
        assert q.lastProgress is None or q.lastProgress.stateOperators[0].numRowsTotal <= 2  # only the feed's end is open


def test_marker_verdicts_do_not_depend_on_triggers(spark, tmp_path):
    r = random.Random(5)
    schema = pa.schema([("attempt_id", pa.int64()), ("ord", pa.int64()), ("marker_id", pa.string()), ("raw_time", pa.float64()), ("duration_s", pa.float64()), ("ts", pa.timestamp("us", "UTC"))])
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    rows = [{"attempt_id": r.randrange(3), "ord": i, "marker_id": r.choice([*MARKER_IDS, "elbow", None]), "raw_time": r.choice([None, round(r.random() * 22, 2)]) if i % 9 == 0 else round(r.random() * 22, 2),
             "duration_s": None if i % 5 == 0 else 20.0, "ts": start + datetime.timedelta(seconds=i)} for i in range(120)]
    want, held = {}, {}
    for p in rows:
        own = held.setdefault(p["attempt_id"], dict.fromkeys(MARKER_IDS))
        want[p["ord"]] = L.judge(own, p["marker_id"], float("nan") if p["raw_time"] is None else p["raw_time"], p["duration_s"])
    mixed = [p for i in range(0, 120, 20) for p in r.sample(rows[i : i + 20], 20)]  # out of order within 20 s, over trigger bounds too
    folder = feed(spark, str(tmp_path / "in"), mixed, schema, 7)
    for once in (1, None):
        work = tempfile.mkdtemp(dir=tmp_path)
        got = L.run_to_end(L.file_stream(spark, folder, "feed", once), lambda s: L.validate_markers(s, "ts", "1 minute", 3_600_000).where("attempt_id is not null"), work, "ts")
        assert {x.ord: x.reason for x in got.collect()} == want and got.count() == 120
    assert {"unknown-marker", "not-a-time", None, "start-not-set", "after-recording"} <= set(want.values())


def test_neighbouring_attempts_share_a_state(spark, tmp_path):
    schema = pa.schema([("attempt_id", pa.int64()), ("ord", pa.int64()), ("marker_id", pa.string()), ("raw_time", pa.float64()), ("duration_s", pa.float64()), ("ts", pa.timestamp("us", "UTC"))])
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    rows = [{"attempt_id": i % 200, "ord": i, "marker_id": MARKER_IDS[i // 200], "raw_time": i // 200 + (i % 200) / 100, "duration_s": 5.0, "ts": start + datetime.timedelta(seconds=i)} for i in range(1200)]
    want, held = {}, {}
    for p in rows:
        want[p["ord"]] = L.judge(held.setdefault(p["attempt_id"], dict.fromkeys(MARKER_IDS)), p["marker_id"], p["raw_time"], p["duration_s"])
    s = L.validate_markers(L.file_stream(spark, feed(spark, str(tmp_path / "in"), rows, schema, 7), "feed", 1), "ts", "1 minute", 3_600_000)
    q = L.write_batches(s, str(tmp_path / "work"))
    assert max(p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators) <= 4  # one for each attempt before
    L.run_available(s, str(tmp_path / "work"))
    got = {x.ord: x.reason for x in spark.read.parquet(str(tmp_path / "work" / "out")).collect()}
    assert got == {o: want[o] for o in got} and len(got) > 1000


def test_late_rows_go_to_a_side_table(spark, tmp_path):
    schema = pa.schema([("attempt_id", pa.int64()), ("sample_time", pa.float64()), ("value", pa.float64()), ("ord", pa.int64())])
    rows = [{"attempt_id": i % 2, "sample_time": float(t), "value": float(i), "ord": i} for i, t in enumerate([1, 1, 2, 3, 2, 3, 5, 2, 4, 9])]
    folder = feed(spark, str(tmp_path / "in"), rows, schema, 5)
    work = str(tmp_path / "work")
    L.run_available(L.flag_late(L.file_stream(spark, folder, "feed", 1), 60_000), work, ["late"])
    side = sorted(x.value for x in spark.read.parquet(f"{work}/out").where("late = 'true'").collect())
    seen, want = {}, []
    for p in rows:
        last = seen.get(p["attempt_id"])
        if last is not None and p["sample_time"] <= last:
            want.append(p["value"])
        seen[p["attempt_id"]] = p["sample_time"] if last is None else max(last, p["sample_time"])
    assert side == want and spark.read.parquet(f"{work}/out").count() == 10


def test_live_marker_rule_agrees_with_the_batch_rule(spark):
    held = {"startSignal": 1.0, "firstMovement": 2.0, "committedLaunch": None, "firstHold": 4.0, "hold10": None, "finishPad": 8.0}
    cases = [(m, t) for m in [*MARKER_IDS, "knee"] for t in (-1.0, 0.5, 1.0, 1.0005, 1.5, 3.0, 4.5, 7.9995, 9.0, 30.0)]
    rows = [(i, m, t) for i, (m, t) in enumerate(cases)]
    long = [(i, k, v) for i, _, _ in rows for k, v in held.items()]
    wide = M.to_wide(spark.createDataFrame(long, "attempt_id long, marker_id string, raw_time double").withColumns({"source": F.lit("Manual"), "confidence": F.lit("High")}))
    p = spark.createDataFrame(rows, "attempt_id long, marker_id string, raw_time double").select("attempt_id", F.struct(
        "marker_id", "raw_time", F.lit(20.0).alias("duration_s"), F.lit(None).cast("double").alias("detected_raw_time"), F.lit(None).cast("double").alias("offset_applied"), F.lit("Manual").alias("source"), F.lit("High").alias("confidence"),
        F.lit("manual-entry").alias("acceptance_mode"), F.lit(None).cast("double").alias("observation_interval_s"), F.lit(None).cast("string").alias("note")).alias("p"))
    got = {r.attempt_id: r for r in M.accept_proposal(wide.join(p, "attempt_id")).collect()}
    for i, m, t in rows:
        state = dict(held)
        why = L.judge(state, m, t, 20.0)
        assert got[i].reason == why
        assert {k: getattr(got[i], k).raw_time for k in MARKER_IDS} == state


def test_linked_groups(spark):
    edges = [(i, f"g{i // 5}") for i in range(40)] + [(0, "x"), (39, "x"), (12, "y"), (17, "y")] + [(i, "hot") for i in range(100, 160)]
    got = {r.clip_id: r.component for r in E.linked_groups(spark.createDataFrame(edges, "clip_id long, group_id string")).collect()}
    assert got[39] == 0 and got[17] == got[12] == 10 and got[159] == 100 and got[24] == 20


ROWS_ONLY = {"snk5", "top5", "top3", "wn29", "wn17", "prj24", "wn48", "wn49_live", "wn40", "wn54", "ag41", "st6", "wn32", "wn33", "wn36", "wn37", "jn28", "wn51", "wn41", "wn35"}


def test_every_query_is_compared_or_listed():
    load_all()
    assert {q for q in QUERIES if q not in ORACLE} <= ROWS_ONLY
    assert set(ORACLE) <= set(QUERIES)
