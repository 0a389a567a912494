"""The driver's tables seen as the engine's role tables, in Spark and in SQL.

Each function returns the role as a DataFrame; the upper-case text of the same name is the
same mapping as a SQL common table expression, used by the comparison queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import MARKER_IDS


#: Lines that a task sorts, repairs or groups, whatever the size of the input.
LINES_AT_ONCE = 500_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def by_order(lines: DataFrame) -> DataFrame:
    """Lines dealt by their order, as numbering and repair need them."""
    return dealt(lines, "l_orderkey")


def dealt(lines: DataFrame, *keys: str) -> DataFrame:
    """Lines dealt by keys to tasks of about LINES_AT_ONCE lines at most."""
    tasks = 1 + lines.count() // LINES_AT_ONCE
    enough = tasks <= int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lines.repartition(*keys) if enough else lines.repartition(tasks, *keys)


def attempts(spark, sf) -> DataFrame:
    """One attempt per order; the customer is the athlete."""
    o = table(spark, sf, "orders")
    k, cu = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        k.alias("attempt_id"), cu.alias("athlete"),
        F.when(k % 11 == 0, F.concat(F.lit("lin-"), cu.cast("string")))
        .when(k % 13 == 0, F.lit("  "))
        .when((cu % 17 == 0) & (k % 4 == 0), F.lit("practice-v1-a")).alias("lineage_id"),
        F.concat(F.lit("Attempt "), k.cast("string")).alias("name"),
        F.to_date("o_orderdate").cast("string").alias("date"),
        F.concat(F.lit("gym-"), (cu % 25).cast("string")).alias("location"),
        F.col("o_orderpriority").alias("attempt_type"), F.col("o_orderstatus").alias("notes"),
        F.to_date(F.date_add(F.to_date("o_orderdate"), (k % 9).cast("int"))).cast("string").alias("updated_at"),
        F.concat(F.lit("rec"), (k % 4).cast("string"), F.lit(".mov")).alias("file_name"),
        (F.lit(12.0) + (cu % 3) * 6.0).alias("duration_s"),
        F.lit(1080).alias("width"), F.lit(1920).alias("height"),
    )


ATTEMPTS = """attempts AS (SELECT o_orderkey AS attempt_id, o_custkey AS athlete,
 CASE WHEN o_orderkey % 11 = 0 THEN 'lin-' || o_custkey WHEN o_orderkey % 13 = 0 THEN '  '
      WHEN o_custkey % 17 = 0 AND o_orderkey % 4 = 0 THEN 'practice-v1-a' END AS lineage_id,
 'Attempt ' || o_orderkey AS name, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date,
 'gym-' || (o_custkey % 25) AS location, o_orderpriority AS attempt_type, o_orderstatus AS notes,
 CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 AS INTEGER) AS VARCHAR) AS updated_at,
 'rec' || (o_orderkey % 4) || '.mov' AS file_name,
 CAST(12 + (o_custkey % 3) * 6 AS DOUBLE) AS duration_s, 1080 AS width, 1920 AS height FROM orders)"""


def raw_markers(spark, sf) -> DataFrame:
    """Markers as read, one per order line: nothing is repaired yet.

    Lines 1 to 6 are the six markers. Repeats of a line and line 7 are further takes, ids that no attempt knows, which
    repair leaves out; they have no place in the order of markers.
    """
    li = by_order(table(spark, sf, "lineitem"))
    first = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    one = li.withColumn("rn", F.row_number().over(first)).withColumn("known", (F.col("rn") == 1) & (F.col("l_linenumber") <= 6)).select("l_orderkey", "l_linenumber", "rn", "known", F.struct(
        "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus").alias("m"))
    ids = F.array(*[F.lit(x) for x in MARKER_IDS])
    ln, q, s = F.col("l_linenumber"), F.col("m.l_quantity"), F.col("m.l_suppkey")
    return one.select(
        F.col("l_orderkey").alias("attempt_id"), F.when(F.col("known"), F.get(ids, ln.cast("int") - 1)).otherwise(F.concat(F.lit("take-"), ln.cast("string"), F.lit("-"), F.col("rn").cast("string"))).alias("marker_id"),
        F.when(F.col("known"), ln.cast("int")).alias("marker_ord"), (2.0 * (ln - 1) + q / 4.0).alias("raw_time"),
        F.when(s % 3 == 0, 2.0 * (ln - 1) + q / 4.0 + F.col("m.l_tax")).alias("detected_raw_time"),
        F.col("m.l_tax").alias("offset_applied"),
        F.when(s % 10 == 0, "Body motion detection").when(s % 10 == 1, "Hold contact detection")
        .when(s % 10 == 2, "Somewhere").otherwise("Manual").alias("source"),
        F.when(F.col("m.l_tax") >= 0.08, "Certain").when(F.col("m.l_returnflag") == "A", "High")
        .when(F.col("m.l_returnflag") == "N", "Medium").otherwise("Low").alias("confidence"),
        F.when(F.col("m.l_tax") == 0, F.lit("guess")).when(F.col("m.l_linestatus") == "F", "frame-review")
        .otherwise("automatic").alias("acceptance_mode"),
        F.col("m.l_discount").alias("observation_interval_s"),
        F.concat(F.lit("part "), F.col("m.l_partkey").cast("string")).alias("note"),
    )


RAW_MARKERS = """raw_markers AS (SELECT l_orderkey AS attempt_id,
 CASE WHEN rn = 1 AND l_linenumber <= 6 THEN ['startSignal','firstMovement','committedLaunch','firstHold','hold10','finishPad'][l_linenumber] ELSE 'take-' || l_linenumber || '-' || rn END AS marker_id,
 CASE WHEN rn = 1 AND l_linenumber <= 6 THEN CAST(l_linenumber AS INTEGER) END AS marker_ord, 2.0*(l_linenumber-1)+l_quantity/4.0 AS raw_time,
 CASE WHEN l_suppkey % 3 = 0 THEN 2.0*(l_linenumber-1)+l_quantity/4.0+l_tax END AS detected_raw_time, l_tax AS offset_applied,
 CASE l_suppkey % 10 WHEN 0 THEN 'Body motion detection' WHEN 1 THEN 'Hold contact detection' WHEN 2 THEN 'Somewhere' ELSE 'Manual' END AS source,
 CASE WHEN l_tax >= 0.08 THEN 'Certain' WHEN l_returnflag='A' THEN 'High' WHEN l_returnflag='N' THEN 'Medium' ELSE 'Low' END AS confidence,
 CASE WHEN l_tax = 0 THEN 'guess' WHEN l_linestatus='F' THEN 'frame-review' ELSE 'automatic' END AS acceptance_mode,
 l_discount AS observation_interval_s, 'part ' || l_partkey AS note
 FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity,
   l_discount, l_tax, l_returnflag, l_linestatus) AS rn FROM lineitem))"""
