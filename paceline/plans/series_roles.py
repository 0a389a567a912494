"""Events seen as sampled series: thirty days of a user's events become a ten-second recording.

Sample times are whole milliseconds; the events of one millisecond are averaged by a partial aggregation, so
every event counts and a series is bounded by the length of its recording, not by the input.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .roles import table

T0 = "2024-01-01"


def event_ms():
    """Milliseconds on the compressed clock."""
    us = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(T0).cast("timestamp"))
    return F.floor(us / 250000000)


def samples(spark, sf):
    e = table(spark, sf, "events")
    g = e.groupBy(F.col("user_id").alias("attempt_id"), event_ms().alias("ms")).agg(F.floor(F.avg(F.floor(F.col("value") * 100 + 0.5)) + 0.5).cast("bigint").alias("v"), F.max("event_id").alias("event_id"))
    v = F.col("v")
    return g.select("attempt_id", "ms", (F.col("ms") / 1000.0).alias("raw_time"), "event_id", "v", v.cast("double").alias("vd"),
                    (v / 1000.0).alias("motion_score"), ((F.col("attempt_id") % 30) / 10.0 + 0.5).alias("start_s"), F.lit(10.4).alias("search_end"))


SAMPLES = """smp AS (SELECT user_id AS attempt_id, ms, CAST(ms AS DOUBLE)/1000 AS raw_time, max(event_id) AS event_id, CAST(floor(avg(floor(value*100+0.5))+0.5) AS BIGINT) AS v, CAST(floor(avg(floor(value*100+0.5))+0.5) AS DOUBLE)/1000 AS motion_score,
 CAST(user_id%30 AS DOUBLE)/10 + 0.5 AS start_s, 10.4 AS search_end FROM (SELECT *, CAST(floor((epoch_us(ts)-epoch_us(TIMESTAMP '2024-01-01'))/250000000.0) AS BIGINT) AS ms FROM events) GROUP BY user_id, ms)"""


def colours(spark, sf):
    """A start light that turns from green to blue (for most attempts) with some noise."""
    s = samples(spark, sf)
    a, v = F.col("attempt_id"), F.col("v")
    n1, n2 = (v * 7) % 9 - 4, (v * 13) % 9 - 4
    t = (a % 5) * 1000 + 2500
    f = F.when(a % 6 == 0, 0.0).otherwise(F.least(F.greatest((F.col("ms") - t) / 400.0, F.lit(0.0)), F.lit(1.0)))
    g = F.lit(190.0) + n1 - f * 100.0
    b = F.lit(80.0) + n2 + f * 120.0
    return s.select("attempt_id", "ms", "raw_time", "event_id", F.lit(70.0).alias("r"), g.alias("g"), b.alias("b"))


COLOURS = """col AS (SELECT attempt_id, ms, raw_time, event_id, CAST(70 AS DOUBLE) AS r, 190.0 + (v*7)%9-4 - f*100.0 AS g, 80.0 + (v*13)%9-4 + f*120.0 AS b
 FROM (SELECT *, CASE WHEN attempt_id%6=0 THEN 0.0::DOUBLE ELSE least(greatest(CAST(ms - ((attempt_id%5)*1000+2500) AS DOUBLE)/400.0, 0.0), 1.0) END AS f FROM smp))"""


def framed(spark, sf):
    """Samples with decoded-frame times: a 20 fps grid behind the cursor, broken in known ways."""
    s = samples(spark, sf)
    k, ms = F.col("event_id"), F.col("ms")
    dec = F.floor(ms / 50) * 50
    return s.select("attempt_id", "ms", "raw_time", F.when(k % 9 == 0, None).when(k % 11 == 0, (ms + 40) / 1000.0).when(k % 13 == 0, (ms - 700) / 1000.0).otherwise(dec / 1000.0).alias("decoded_time"),
                    F.when(k % 7 == 0, 0.004).when(k % 17 == 0, 2.5).otherwise(0.05).alias("frame_duration_s"), F.when(k % 5 == 0, "seek-cursor").otherwise("video-frame").alias("timestamp_method"))


FRAMED = """frm AS (SELECT attempt_id, ms, raw_time, CASE WHEN event_id%9=0 THEN NULL WHEN event_id%11=0 THEN CAST(ms+40 AS DOUBLE)/1000 WHEN event_id%13=0 THEN CAST(ms-700 AS DOUBLE)/1000 ELSE CAST((ms//50)*50 AS DOUBLE)/1000 END AS decoded_time,
 CAST(CASE WHEN event_id%7=0 THEN 0.004 WHEN event_id%17=0 THEN 2.5 ELSE 0.05 END AS DOUBLE) AS frame_duration_s, CASE WHEN event_id%5=0 THEN 'seek-cursor' ELSE 'video-frame' END AS timestamp_method FROM smp),
fr1 AS (SELECT *, CASE WHEN frame_duration_s BETWEEN 0.0001 AND 1 THEN frame_duration_s END AS gd FROM frm),
fr AS (SELECT *, CASE WHEN decoded_time>=0 AND decoded_time<=raw_time+0.005 AND raw_time-decoded_time<=0.5 AND (gd IS NULL OR raw_time-decoded_time<=gd+0.005) THEN decoded_time END AS source_time,
 CASE WHEN decoded_time>=0 AND decoded_time<=raw_time+0.005 AND raw_time-decoded_time<=0.5 AND (gd IS NULL OR raw_time-decoded_time<=gd+0.005) THEN gd END AS source_duration_s FROM fr1)"""
