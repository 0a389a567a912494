"""Public evidence: observer brackets, tolerance classes, cohort roll-up, linked groups."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X

SLACK = 1e-9


def bracket_references(reviews: DataFrame) -> DataFrame:
    """JN7: two observers of one event and lane; the union of their overlapping brackets."""
    seen = F.col("status") == "observable"
    g = reviews.groupBy("clip_id", "event").agg(
        F.count("*").alias("_n"), F.min("reviewer_id").alias("_r1"), F.max("reviewer_id").alias("_r2"), F.count_if(seen).alias("_seen"), F.min("event_definition").alias("event_definition"),
        F.max("event_definition").alias("_d2"), F.min("lane_id").alias("lane_id"), F.max("lane_id").alias("_l2"), F.min("bracket_lo").alias("bracket_lo"), F.max("bracket_lo").alias("_lo2"),
        F.max("bracket_hi").alias("bracket_hi"), F.min("bracket_hi").alias("_hi1"), F.max("reference_status").alias("reference_status"))
    rule = X.when_chain([
        ((F.col("_n") != 2) | (F.col("_r1") == F.col("_r2")), "observers"), (F.col("reference_status") != "observable", F.lit(None).cast("string")), (F.col("_seen") < 2, "unqualified-original"),
        ((F.col("event_definition") != F.col("_d2")) | (F.col("lane_id") != F.col("_l2")), "event-or-lane"), (F.col("_lo2") > F.col("_hi1"), "disjoint")])
    ok = F.col("violation").isNull() & (F.col("reference_status") == "observable")
    g = g.withColumn("violation", rule)
    return g.select("clip_id", "event", F.when(F.col("violation").isNull(), F.col("reference_status")).alias("reference_status"), "violation",
                    *[F.when(ok, F.col(c)).alias(c) for c in ("event_definition", "lane_id", "bracket_lo", "bracket_hi")])


def endpoint_rows(clips: DataFrame, predictions: DataFrame, refs: DataFrame, tolerance: float) -> DataFrame:
    """AG22: distance of a prediction to its bracket and the tolerance class."""
    o = clips.where("parent_clip_id is null").select("clip_id", "split", "cohort", "primary_run_id", F.explode(F.array(F.lit("start"), F.lit("finish"))).alias("event"))
    p = predictions.select(F.col("run_id").alias("primary_run_id"), "event", F.col("status").alias("prediction"), F.col("raw_time").alias("p"), F.col("event_definition").alias("_pd"), F.col("lane_id").alias("_pl"))
    df = o.join(p, ["primary_run_id", "event"], "left").join(refs, ["clip_id", "event"], "left")
    match = X.truthy((F.coalesce("prediction", F.lit("missing")) == "automatic") & (F.col("reference_status") == "observable") & (F.col("_pd") == F.col("event_definition")) & (F.col("_pl") == F.col("lane_id")))
    lo, hi, t = F.col("bracket_lo"), F.col("bracket_hi"), F.col("p")
    dmin, dmax = F.greatest(lo - t, t - hi, F.lit(0.0)), F.greatest(F.abs(t - lo), F.abs(t - hi))
    cls = F.when(dmin > tolerance + SLACK, "certainly-outside").when(dmax <= tolerance + SLACK, "wholly-within").otherwise("indeterminate")
    return df.select("clip_id", "split", "cohort", "event", F.coalesce("prediction", F.lit("missing")).alias("prediction"), F.when(match, X.round_us(dmin)).alias("min_distance_s"),
                     F.when(match, X.round_us(dmax)).alias("max_distance_s"), F.when(match, cls).alias("tolerance_class"))


def cohort_rollup(rows: DataFrame) -> DataFrame:
    """AG21: ten counters by split x cohort x event, and by event over everything."""
    n = lambda s: F.count_if(F.col("prediction") == s)
    k = lambda s: F.count_if(F.col("tolerance_class") == s)
    return rows.groupingSets([["split", "cohort", "event"], ["event"]], "split", "cohort", "event").agg(
        F.count("*").alias("originals"), n("automatic").alias("automatic"), n("review").alias("review"), n("missing").alias("missing"), n("failed").alias("failed"),
        F.count("tolerance_class").alias("comparable"), F.count_if((F.col("prediction") == "automatic") & F.col("tolerance_class").isNull()).alias("unverified_automatic"),
        k("certainly-outside").alias("certainly_outside"), k("wholly-within").alias("wholly_within"), k("indeterminate").alias("indeterminate"))


def _checkpointed(df: DataFrame) -> DataFrame:
    spark: SparkSession = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            folder = tempfile.mkdtemp(prefix="run-")  # only where no shared folder is named, as in tests
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def _settled(edges: DataFrame) -> bool:
    """Whether every clip points at one other and that one at none: stars, which another round would leave alone."""
    several = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    return not several and not edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()


def linked_groups(memberships: DataFrame) -> DataFrame:
    """AG23: clips linked through shared groups; one row per clip with its component's smallest clip.

    Alternating large-star and small-star rounds on a star graph (every clip of a group points at the
    group's smallest clip), so edges stay linear in the input and no pairs of a group are listed.  A
    round is two aggregations and two joins; edges are checkpointed between rounds.
    """
    heads = memberships.groupBy("group_id").agg(F.min("clip_id").alias("v"))
    edges = memberships.join(heads, "group_id").select(F.col("clip_id").alias("u"), "v").where("u <> v").distinct()
    edges = _checkpointed(edges)
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        edges = _checkpointed(small.where("u <> v").distinct())
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    return memberships.select("clip_id").distinct().join(roots, F.col("clip_id") == F.col("u"), "left").select("clip_id", F.coalesce("root", "clip_id").alias("component"))


def earliest_runs(components: DataFrame, runs: DataFrame) -> DataFrame:
    """AG23: first run start of every linked group."""
    return components.join(runs, "clip_id").groupBy("component").agg(F.min("started_at").alias("earliest_run"), F.count("*").alias("runs"))
