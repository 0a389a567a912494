"""Structured Streaming operators over samples, detections, markers and library snapshots."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.exprs import MARKER_IDS, MIDDLE_MARKERS


def unique_frames(stream: DataFrame, keys: list[str], ts: str, lateness: str) -> DataFrame:
    """ST1: repeats of one decoded frame are dropped while they are within the lateness bound."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)


def tracking_sessions(stream: DataFrame, key: str, ts: str, gap: str, lateness: str) -> DataFrame:
    """ST2: spans of continuous tracking, closed by a gap."""
    g = stream.withWatermark(ts, lateness).groupBy(key, F.session_window(ts, gap)).agg(F.count("*").alias("samples"))
    return g.select(key, F.col("session_window.start").alias("span_start"), F.col("session_window.end").alias("span_end"), "samples")


def sliding_energy(stream: DataFrame, key: str, ts: str, value: str, size: str, hop: str, lateness: str) -> DataFrame:
    """ST3: energy of overlapping windows."""
    g = stream.withWatermark(ts, lateness).groupBy(key, F.window(ts, size, hop)).agg(F.sum(F.col(value) * F.col(value)).alias("energy"), F.count("*").alias("samples"))
    return g.select(key, F.col("window.start").alias("window_start"), "energy", "samples")


def outcome_counts(stream: DataFrame, key: str, ts: str, status: str, size: str, lateness: str) -> DataFrame:
    """ST4: accepted, review and missing per detector and period."""
    n = lambda s: F.count_if(F.col(status) == s).alias(s)
    g = stream.withWatermark(ts, lateness).groupBy(key, F.window(ts, size)).agg(n("accepted"), n("review"), n("missing"))
    return g.select(key, F.col("window.start").alias("window_start"), "accepted", "review", "missing")


def _hadoop(spark: SparkSession, path: str) -> tuple:
    """File system and path of a folder that driver and executors share."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def current_snapshot(spark: SparkSession, path: str) -> dict | None:
    """What the newest pointer says: its batch, the number of buckets and the version folder of each bucket."""
    fs, pointers = _hadoop(spark, f"{path}/pointers")
    if not fs.exists(pointers):
        return None
    found = [int(f.getPath().getName()) for f in fs.listStatus(pointers) if f.getPath().getName().isdigit()]
    return json.loads("".join(r.value for r in spark.read.text(f"{path}/pointers/{max(found)}", wholetext=True).collect())) if found else None


def _publish(spark: SparkSession, path: str, snapshot: dict) -> None:
    """The pointer is written aside and renamed, so readers see either the old snapshot or the whole new one."""
    fs, ready = _hadoop(spark, f"{path}/pointers/{snapshot['batch']}")
    _, aside = _hadoop(spark, f"{path}/pointers/.{snapshot['batch']}.tmp")
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps(snapshot).encode()))
    out.close()
    if not fs.rename(aside, ready):
        raise OSError(f"snapshot {snapshot['batch']} of {path} could not be published")


def read_library(spark: SparkSession, path: str) -> DataFrame:
    """The library as the newest pointer names it; folders of batches that were never published are not read."""
    snapshot = current_snapshot(spark, path)
    if snapshot is None:
        raise FileNotFoundError(f"no snapshot in {path}")
    return spark.read.parquet(*[f"{path}/{folder}/bucket={b}" for b, folder in sorted(snapshot["folders"].items())])


def upsert_library(batch: DataFrame, path: str, key: str, version: str, buckets: int, batch_id: int) -> None:
    """ST5: one micro-batch into the stored library; the newest version of an id wins, on a tie the stored row stays.

    Rows live in hash buckets of the id. A batch writes new files for the buckets that it touches into a folder of its own
    and then publishes a pointer to them and to the untouched ones, so readers never see half a batch and a lost driver
    leaves the last snapshot in place. A batch that was published before is left out. ``buckets`` holds for a new
    library; a stored one keeps its own number.
    """
    spark = batch.sparkSession
    old = current_snapshot(spark, path)
    if old is not None and batch_id <= old["batch"]:
        return
    n = old["buckets"] if old else buckets
    new = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumn("_new", F.lit(1))
    hit = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most n values
    if not hit:
        return
    folders = dict(old["folders"]) if old else {}
    stored = [f"{path}/{folders[str(b)]}/bucket={b}" for b in hit if str(b) in folders]
    rows = new
    if stored:
        kept = spark.read.schema(batch.schema).parquet(*stored).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))
        rows = kept.withColumn("_new", F.lit(0)).unionByName(new)
    order = F.struct(F.col(version), (-F.col("_new")).alias("o"))
    cols = [c for c in batch.columns if c != key]
    merged = rows.groupBy("bucket", key).agg(F.max_by(F.struct(*cols), order).alias("r")).select(key, "r.*", "bucket")
    # one task may write several buckets, but a bucket is written by one task only
    merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch-{batch_id}")
    _publish(spark, path, {"batch": batch_id, "buckets": n, "folders": folders | {str(b): f"batch-{batch_id}" for b in hit}})


def expire_snapshots(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Takes away pointers older than the newest ``keep`` and batch folders that no kept pointer names; the number of folders."""
    fs, pointers = _hadoop(spark, f"{path}/pointers")
    ids = sorted((int(f.getPath().getName()) for f in fs.listStatus(pointers) if f.getPath().getName().isdigit()), reverse=True)
    named = set()
    for i in ids[:keep]:
        text = "".join(r.value for r in spark.read.text(f"{path}/pointers/{i}", wholetext=True).collect())
        named |= set(json.loads(text)["folders"].values())
    for i in ids[keep:]:
        fs.delete(_hadoop(spark, f"{path}/pointers/{i}")[1], False)
    gone = 0
    for f in fs.listStatus(_hadoop(spark, path)[1]):
        name = f.getPath().getName()
        # a folder beyond the newest pointer may be a batch that is being written
        if name.startswith("batch-") and name not in named and int(name[6:]) <= ids[0]:
            gone += bool(fs.delete(f.getPath(), True))
    return gone


VERDICTS = "attempt_id bigint, ord bigint, marker_id string, raw_time double, accepted boolean, reason string"
MARKER_STATE = ", ".join(f"{m} double" for m in MARKER_IDS)


def judge(markers: dict[str, float | None], marker: str, raw: float, duration: float | None) -> str | None:
    """Reason to refuse a proposed marker, and the effect of an accepted one on ``markers``."""
    if not raw == raw or raw in (float("inf"), float("-inf")) or raw < 0:
        return "not-a-time"
    if duration is not None and raw > duration + 0.001:
        return "after-recording"
    if marker not in markers:
        return "unknown-marker"
    t = int(raw * 1000 + 0.5) / 1000
    start, finish = markers["startSignal"], markers["finishPad"]
    if marker != "startSignal":
        if start is None:
            return "start-not-set"
        if t < start:
            return "before-start"
        if marker == "finishPad" and t <= start + 0.001:
            return "finish-not-after-start"
        if marker != "finishPad" and finish is not None and t >= finish - 0.001:
            return "not-before-finish"
    if marker in MIDDLE_MARKERS:
        i = MIDDLE_MARKERS.index(marker)
        before = next((markers[m] for m in reversed(MIDDLE_MARKERS[:i]) if markers[m] is not None), None)
        after = next((markers[m] for m in MIDDLE_MARKERS[i + 1:] if markers[m] is not None), None)
        if before is not None and t < before:
            return "before-previous-marker"
        if after is not None and t > after:
            return "after-next-marker"
    for m in MARKER_IDS:
        lost = marker == "startSignal" or (marker == "finishPad" and m in MIDDLE_MARKERS and markers[m] is not None and markers[m] >= t - 0.001)
        if m != marker and lost:
            markers[m] = None
    markers[marker] = t
    return None


PENDING = ["ord", "marker_id", "raw_time", "duration_s"]
#: Attempts whose numbers agree but for this many bits share a state, so that a call of Python judges many of them.
SHARED_BITS = 6


def validate_markers(stream: DataFrame, ts: str, lateness: str, idle_ms: int) -> DataFrame:
    """ST6: proposals (attempt_id, ord, marker_id, raw_time, duration_s) judged against the attempt's six accepted markers.

    Proposals wait in the state until the watermark has passed their time ``ts`` and are then judged by time and ord, so
    the triggers that they arrive in change no verdict. Proposals later than the lateness bound are left out, as
    everywhere in Spark. An attempt without proposals for ``idle_ms`` of feed time gives up its state; what comes after
    that starts a new take. The state holds, for a few neighbouring attempts, the six markers and the proposals inside the
    lateness bound; rows without an attempt only move the watermark.
    """
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {a: h for a, h in json.loads(state.get[0])} if state.exists else {}
        if not state.hasTimedOut:
            for b in batches:
                ids, at = b["attempt_id"].tolist(), b["_at"].tolist()
                values = [[None if x is None or x != x else x for x in b[c].tolist()] for c in PENDING]
                for a, *row in zip(ids, at, *values, strict=True):
                    if a is not None and a == a:
                        held.setdefault(int(a), {"markers": [None] * len(MARKER_IDS), "pending": [], "last": 0})["pending"].append(row)
        now = state.getCurrentWatermarkMs()
        out, kept, wakes = [], [], []
        for a, h in held.items():
            markers, pending, last = dict(zip(MARKER_IDS, h["markers"], strict=True)), h["pending"], h["last"]
            pending.sort(key=lambda r: (r[0], r[1] is not None, r[1]))
            due = 0
            while due < len(pending) and pending[due][0] <= now:
                at, ord_, marker, raw, duration = pending[due]
                last, due = max(last, at), due + 1
                why = judge(markers, marker, float("nan") if raw is None else raw, duration)
                out.append((a, ord_, marker, raw, why is None, why))
            pending = pending[due:]
            wake = pending[0][0] if pending else last + idle_ms
            if pending or wake > now:
                kept.append((a, {"markers": [markers[m] for m in MARKER_IDS], "pending": pending, "last": last}))
                wakes.append(wake)
        if kept:
            state.update((json.dumps(kept),))
            state.setTimeoutTimestamp(max(min(wakes), now + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["attempt_id", "ord", "marker_id", "raw_time", "accepted", "reason"])
    rows = stream.withWatermark(ts, lateness).withColumn("_at", F.unix_millis(ts)).withColumn("_few", F.shiftright("attempt_id", SHARED_BITS))
    return rows.groupBy("_few").applyInPandasWithState(run, VERDICTS, "held string", "append", GroupStateTimeout.EventTimeTimeout)


LATE = "attempt_id bigint, sample_time double, value double, late boolean"


def flag_late(stream: DataFrame, idle_ms: int) -> DataFrame:
    """ST7: samples (attempt_id, sample_time, value, ord) whose time does not increase are flagged and kept,
    so a sink can put them into a side table.

    The watermark is on the time of arrival, so no sample is too late for it; an attempt of which nothing arrived for
    ``idle_ms`` gives up its state.
    """
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        b = pd.concat(list(batches)).sort_values("ord", kind="stable")
        seen = b["sample_time"].cummax().shift(1)
        if last is not None:
            seen = seen.fillna(last).clip(lower=last)
        late = (b["sample_time"] <= seen).fillna(False)
        top = b["sample_time"].max()
        state.update((float(top if last is None else max(top, last)),))
        state.setTimeoutTimestamp(max(int(b["_at"].max()), state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame({"attempt_id": key[0], "sample_time": b["sample_time"], "value": b["value"], "late": late.astype(bool)})
    rows = stream.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", "1 hour").withColumn("_at", F.unix_millis("_arrived"))
    return rows.groupBy("attempt_id").applyInPandasWithState(run, LATE, "last double", "append", GroupStateTimeout.EventTimeTimeout)


def file_stream(spark: SparkSession, folder: str, name: str, files_at_once: int | None = None) -> DataFrame:
    """A table of the folder as a stream; new files with the same name pattern are picked up."""
    schema = spark.read.parquet(f"{folder}/{name}*.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet")
    return (reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).parquet(folder)


def with_end(stream: DataFrame, work: str) -> DataFrame:
    """The stream and, in a folder of its own, the feed's end: rows that only move the watermark (see end_feed)."""
    spark = stream.sparkSession
    fs, end = _hadoop(spark, f"{work}/end")
    fs.mkdirs(end)
    return stream.union(spark.readStream.schema(stream.schema).parquet(f"{work}/end"))


def end_feed(spark: SparkSession, stream: DataFrame, work: str, ts: str, at: str) -> None:
    """Says that a feed is over: a row of nulls at a time beyond all others closes what is open, and stays open itself."""
    row = spark.range(1).select(*[(F.to_timestamp(F.lit(at)) if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in stream.schema])
    row.write.mode("overwrite").parquet(f"{work}/end")


def write_batches(stream: DataFrame, work: str, by: list[str] | None = None) -> StreamingQuery:
    """Appends what is there now; each batch has a folder of its own that a replay of it overwrites."""
    def write(batch: DataFrame, batch_id: int) -> None:
        w = batch.write.mode("overwrite")
        (w.partitionBy(*by) if by else w).parquet(f"{work}/out/batch={batch_id}")
    q = stream.writeStream.outputMode("append").option("checkpointLocation", f"{work}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return q


def run_available(stream: DataFrame, work: str, by: list[str] | None = None) -> DataFrame:
    """Process everything that is there now and return the written result; ``by`` puts rows into side tables."""
    spark = stream.sparkSession
    write_batches(stream, work, by)
    fs, out = _hadoop(spark, f"{work}/out")
    if not fs.exists(out):  # an empty table starts no batch
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{work}/out").drop("batch")


def run_to_end(source: DataFrame, build: Callable[[DataFrame], DataFrame], work: str, ts: str, at: str = "2200-01-01") -> DataFrame:
    """Append mode over everything that is there, then the end of the feed, which closes the windows still open."""
    result = build(with_end(source, work))
    write_batches(result, work)
    end_feed(source.sparkSession, source, work, ts, at)
    return run_available(result, work)
