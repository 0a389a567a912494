"""Study inputs: the label worksheet, the study manifest, run reports, public-evidence documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X

# Worksheet columns that are numbers, and the independence declaration.
NUMERIC = ["labelReview.rawTime", "lastBeforeRawTime", "firstAfterRawTime", "officialTotalSeconds"]
INDEPENDENT = "labelReview.independentOfDetector"


def worksheet_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a worksheet; empty or repeated names are refused (Spark would rename them)."""
    row = spark.read.option("header", False).option("multiLine", True).option("escape", '"').csv(path).limit(1).collect()
    names = [(v or "").lstrip("﻿") for v in row[0]] if row else []
    if any(not n.strip() for n in names) or len(set(names)) != len(names):
        raise ValueError("the label worksheet has empty or duplicate headers")
    return names


def read_worksheet(spark: SparkSession, path: str) -> DataFrame:
    """SRC5: quoted CSV with embedded newlines; wrong column counts and bad numbers fail the read."""
    names = worksheet_header(spark, path)
    schema = ", ".join(f"`{n}` string" for n in names)
    df = (spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
          .option("mode", "FAILFAST").option("enforceSchema", True).option("ignoreLeadingWhiteSpace", False).option("nullValue", "\u0000").csv(path))
    return typed_worksheet(df)


def typed_worksheet(df: DataFrame) -> DataFrame:
    def number(n):
        t = F.trim(F.col(f"`{n}`"))
        v = X.finite(t.try_cast("double"))
        return F.when(F.length(t) > 0, F.when(v >= 0, v).otherwise(F.raise_error(F.lit(f"invalid {n} in a label row"))))
    cols = {n: number(n) for n in NUMERIC if n in df.columns}
    if INDEPENDENT in df.columns:
        t = F.col(f"`{INDEPENDENT}`")
        cols[INDEPENDENT] = F.when(t == "true", True).when(t == "false", False).otherwise(F.raise_error(F.lit("missing independence declaration")))
    blank = X.all_of(*[~X.nonempty(F.col(f"`{n}`")) for n in df.columns])
    return df.where(~blank).withColumns(cols)


STUDY_SCHEMA = """version int, studyId string, protocol struct<splitUnit string, appCommit string, frozenAt string, endpointToleranceSeconds double>,
clips array<struct<clipId string, parentClipId string, attemptId string, sourceSha256 string, durationSeconds double, datasetSplit string, cohort string,
 captureSessionId string, climberAlias string, gymAlias string, capturePhoneModel string, lane string, consentConfirmed boolean, primaryRunId string>>,
predictions array<struct<runId string, clipId string, sourceSha256 string, appCommit string, startedAt string,
 events map<string, struct<status string, rawTime double, evidenceSource string>>>>,
observations array<struct<participantAlias string, captureSessionId string, taskRole string, observedAt string, correctionSeconds double,
 completedImportReviewSave boolean, assistanceRequired boolean, voluntaryReturn boolean, trainingDecision string>>"""


def read_study(spark: SparkSession, path: str) -> DataFrame:
    """SRC6: study manifests, one JSON document per file."""
    return spark.read.schema(STUDY_SCHEMA).option("multiLine", True).json(path).where("version = 1 and length(trim(studyId)) > 0")


def study_clips(study: DataFrame) -> DataFrame:
    return study.select("studyId", F.explode("clips").alias("c")).select(
        F.col("studyId").alias("study_id"), F.col("c.clipId").alias("clip_id"), F.col("c.parentClipId").alias("parent_clip_id"), F.col("c.attemptId").alias("attempt_id"),
        F.col("c.sourceSha256").alias("source_sha256"), F.col("c.durationSeconds").alias("duration_s"), F.col("c.datasetSplit").alias("split"), F.col("c.cohort").alias("cohort"),
        F.col("c.captureSessionId").alias("session_id"), F.col("c.climberAlias").alias("climber_alias"), F.col("c.gymAlias").alias("gym_alias"),
        F.col("c.capturePhoneModel").alias("phone_model"), F.col("c.lane").alias("lane"), F.col("c.consentConfirmed").alias("consent"), F.col("c.primaryRunId").alias("primary_run_id"))


def study_predictions(study: DataFrame) -> DataFrame:
    return study.select(F.explode("predictions").alias("p")).select("p", F.explode("p.events").alias("event", "e")).select(
        F.col("p.runId").alias("run_id"), F.col("p.clipId").alias("clip_id"), F.col("p.sourceSha256").alias("source_sha256"), F.col("p.appCommit").alias("app_commit"),
        F.col("p.startedAt").alias("started_at"), "event", F.col("e.status").alias("status"), F.col("e.rawTime").alias("raw_time"), F.col("e.evidenceSource").alias("evidence_source"))


def study_observations(study: DataFrame) -> DataFrame:
    return study.select(F.explode("observations").alias("o")).select(
        F.col("o.participantAlias").alias("participant"), F.col("o.captureSessionId").alias("session_id"), F.col("o.taskRole").alias("task_role"), F.col("o.observedAt").alias("observed_at"),
        F.col("o.correctionSeconds").alias("correction_s"), F.col("o.completedImportReviewSave").alias("completed"), F.col("o.assistanceRequired").alias("assisted"),
        F.col("o.voluntaryReturn").alias("returned"), F.col("o.trainingDecision").alias("decision"))


REPORT_SCHEMA = """finishedAt string, fullWorkflow boolean, sampleFps int, runs array<struct<sourceName string, variationId string, error string, app struct<version string>,
 media struct<sha256 string, sourceSha256 string>, outcome struct<start struct<rawTime string>, finish struct<rawTime string>,
 workflow struct<error string, requestedFrames bigint, validFrames bigint>>>>"""


def report_runs(reports: DataFrame) -> DataFrame:
    """SRC7: run rows of finished reports."""
    o = F.col("r.outcome")
    return reports.where("length(finishedAt) > 0 and runs is not null").select("finishedAt", "fullWorkflow", F.coalesce("sampleFps", F.lit(5)).alias("sample_fps"), F.explode("runs").alias("r")).select(
        F.col("r.sourceName").alias("source_name"), F.col("r.variationId").alias("variation_id"), F.col("r.media.sha256").alias("media_sha256"), F.col("r.media.sourceSha256").alias("source_sha256"),
        F.coalesce("r.error", "r.outcome.workflow.error").alias("error"), o.isNotNull().alias("has_outcome"), F.col("r.outcome.start.rawTime").alias("start_text"), F.col("r.outcome.finish.rawTime").alias("finish_text"),
        F.col("r.outcome.workflow.requestedFrames").alias("requested_frames"), F.col("r.outcome.workflow.validFrames").alias("valid_frames"), "fullWorkflow", "sample_fps")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT_SCHEMA).option("multiLine", True).json(path)


EVIDENCE_SCHEMA = """schemaVersion int, observerType string, auditId string, frozenAt string, toleranceSeconds double,
clips array<struct<id string, parentClipId string, attemptId string, sourceGroupId string, sourceSha256 string, durationSeconds double, cohort string, split string,
 athleteGroupIds array<string>, primaryRunId string, references map<string, struct<status string, reason string, frozenAt string,
 reviews array<struct<reviewerId string, method string, independentOfPredictions boolean, sourceSha256 string, reviewedAt string, status string, bracket array<double>, eventDefinition string, laneId string>>>>>>,
runs array<struct<id string, clipId string, sourceSha256 string, startedAt string, events map<string, struct<status string, rawTime double, eventDefinition string, laneId string>>>>"""


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """SRC8: public-evidence documents."""
    return spark.read.schema(EVIDENCE_SCHEMA).option("multiLine", True).json(path).where("schemaVersion = 1 and length(trim(auditId)) > 0 and toleranceSeconds > 0")


def evidence_reviews(docs: DataFrame) -> DataFrame:
    clips = docs.select(F.explode("clips").alias("c")).select(F.col("c.id").alias("clip_id"), F.explode("c.references").alias("event", "ref"))
    return clips.select("clip_id", "event", F.col("ref.status").alias("reference_status"), F.col("ref.frozenAt").alias("frozen_at"), F.explode("ref.reviews").alias("r")).select(
        "clip_id", "event", "reference_status", "frozen_at", F.col("r.reviewerId").alias("reviewer_id"), F.col("r.status").alias("status"), F.col("r.bracket")[0].alias("bracket_lo"),
        F.col("r.bracket")[1].alias("bracket_hi"), F.col("r.eventDefinition").alias("event_definition"), F.col("r.laneId").alias("lane_id"))
