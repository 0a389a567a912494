"""Documents, labels and conversations seen as study clips, predictions, labels and observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from .roles import table

COMMIT, STUDY, FROZEN = "abcdef1", "study-1", "2024-01-05"


def clips(spark, sf):
    d = table(spark, sf, "documents")
    k = F.col("doc_id")
    s = k.cast("string")
    parent = F.when(k % 10 == 9, F.when(k % 20 == 9, k - 3).otherwise(k - 10))
    return d.select(
        k.alias("clip_id"), parent.alias("parent_clip_id"), F.when((k % 20 == 9) & (k % 3 != 0), k - 3).otherwise(k).alias("attempt_id"), F.sha2("text", 256).alias("source_sha256"),
        (F.lit(20.0) + F.col("n_chars") % 10).alias("duration_s"), F.when(F.when(k % 20 == 9, k - 3).otherwise(k) % 3 == 0, "development").otherwise("held-out").alias("split"),
        F.when(F.col("lang") == "de", "rejection").otherwise("fixed-phone").alias("cohort"), F.concat("source", F.lit("-"), (k % 50).cast("string")).alias("session_id"),
        F.concat("source", F.lit("/"), (k % 90).cast("string")).alias("climber_alias"), F.col("lang").alias("gym_alias"), F.concat(F.lit("phone"), (k % 5).cast("string")).alias("phone_model"),
        F.concat(F.lit("run-"), s).alias("primary_run_id"), "source")


CLIPS = """clips AS (SELECT doc_id AS clip_id, CASE WHEN doc_id % 10 = 9 THEN CASE WHEN doc_id % 20 = 9 THEN doc_id - 3 ELSE doc_id - 10 END END AS parent_clip_id,
 CASE WHEN doc_id % 20 = 9 AND doc_id % 3 <> 0 THEN doc_id - 3 ELSE doc_id END AS attempt_id, sha256(text) AS source_sha256, 20.0 + n_chars % 10 AS duration_s,
 CASE WHEN (CASE WHEN doc_id % 20 = 9 THEN doc_id - 3 ELSE doc_id END) % 3 = 0 THEN 'development' ELSE 'held-out' END AS split, CASE WHEN lang='de' THEN 'rejection' ELSE 'fixed-phone' END AS cohort,
 source || '-' || (doc_id % 50) AS session_id, source || '/' || (doc_id % 90) AS climber_alias, lang AS gym_alias, 'phone' || (doc_id % 5) AS phone_model, 'run-' || doc_id AS primary_run_id, source FROM documents)"""


def predictions(spark, sf):
    d = table(spark, sf, "documents")
    k = F.col("doc_id")
    ev = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(e).alias("event")) for i, e in enumerate(("start", "hold10", "finish"))])
    df = d.select("*", F.explode(ev).alias("v"))
    i = F.col("v.i")
    st = F.element_at(F.array(*[F.lit(x) for x in ("accepted", "accepted", "review", "accepted", "missing", "failed")]), ((k + i) % 6 + 1).cast("int"))
    return df.select(F.concat(F.when(k % 7 == 0, "earlier-").otherwise("run-"), k.cast("string")).alias("run_id"), k.alias("clip_id"), F.when(k % 41 == 0, F.lit("bad")).otherwise(F.sha2("text", 256)).alias("source_sha256"),
                     F.when(k % 43 == 0, "0000000").otherwise(COMMIT).alias("app_commit"), F.when(k % 47 == 0, "2024-01-01").otherwise("2024-02-01").alias("started_at"), F.col("v.event").alias("event"),
                     st.alias("status"), F.when(st == "accepted", (F.col("n_chars") % 400) / 100.0 + i * 6.0 + (k % 13) / 100.0).alias("raw_time"), F.when(k % 4 == 0, "audio").otherwise("light").alias("evidence_source"))


PREDICTIONS = """preds AS (SELECT CASE WHEN doc_id % 7 = 0 THEN 'earlier-' ELSE 'run-' END || doc_id AS run_id, doc_id AS clip_id, CASE WHEN doc_id % 41 = 0 THEN 'bad' ELSE sha256(text) END AS source_sha256, CASE WHEN doc_id % 43 = 0 THEN '0000000' ELSE 'abcdef1' END AS app_commit,
 CASE WHEN doc_id % 47 = 0 THEN '2024-01-01' ELSE '2024-02-01' END AS started_at, event, ['accepted','accepted','review','accepted','missing','failed'][1 + CAST((doc_id + i) % 6 AS INT)] AS status,
 CASE WHEN ['accepted','accepted','review','accepted','missing','failed'][1 + CAST((doc_id + i) % 6 AS INT)] = 'accepted' THEN CAST(n_chars % 400 AS DOUBLE) / 100.0 + i * 6.0 + CAST(doc_id % 13 AS DOUBLE) / 100.0 END AS raw_time,
 CASE WHEN doc_id % 4 = 0 THEN 'audio' ELSE 'light' END AS evidence_source FROM documents, (SELECT unnest([0,1,2]) AS i, unnest(['start','hold10','finish']) AS event))"""


def labels(spark, sf):
    """Two reviewers and one adjudicator per labelled document and event."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    k = F.col("doc_id")
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(e).alias("event"), F.lit(r).alias("r")) for i, e in enumerate(("start", "hold10", "finish")) for r in ("r1", "r2", "adj")])
    df = d.select("*", F.explode(rows).alias("v"))
    i, r = F.col("v.i"), F.col("v.r")
    base = (F.col("n_chars") % 400) / 100.0 + i * 6.0
    time = base + F.when(r == "r1", F.col("quality") * 0.03).when(r == "r2", F.col("toxic") * 0.25 - 0.02).otherwise(0.0)
    time = F.greatest(time, F.lit(0.0))
    lid = lambda x: F.concat(k.cast("string"), F.lit("-"), i.cast("string"), F.lit("-"), F.lit(x))
    return df.select(
        F.concat(k.cast("string"), F.lit("-"), i.cast("string"), F.lit("-"), r).alias("label_id"), F.lit(STUDY).alias("study_id"), k.alias("clip_id"), F.when(k % 53 == 0, "x").otherwise(F.sha2("text", 256)).alias("source_sha256"),
        F.when((k % 59 == 0) & (i == 1), "elbow").otherwise(F.col("v.event")).alias("event"), F.when(r == "adj", "adjudicator").otherwise("reviewer").alias("review_role"),
        F.when((r == "r2") & (k % 9 == 0), "disputed").when((r == "adj") & (k % 8 == 0), "pending").when((r == "r1") & (k % 17 == 0), "unobservable").otherwise("confirmed").alias("status"),
        (k % 23 != 0).alias("independent"), F.when((k % 19 == 0) & (r == "r2"), "ann-r1").otherwise(F.concat(F.lit("ann-"), r)).alias("reviewer_id"), F.lit("frame step").alias("method"),
        F.when((r == "adj") & (k % 31 == 0), "2024-01-01").when(r == "adj", "2024-03-01").otherwise("2024-02-01").alias("reviewed_at"), time.alias("raw_time"),
        F.when((k % 6 == 0) & (r == "r2"), "audio").when(k % 4 == 0, "audio").otherwise("light").alias("evidence_source"), (time - 0.05).alias("last_before"), (time + F.when(k % 61 == 0, -0.02).otherwise(0.1)).alias("first_after"),
        F.when(r == "adj", F.when(k % 13 == 0, lid("r1")).when(k % 29 == 0, F.concat(lid("r1"), F.lit(";"), lid("zz"))).otherwise(F.concat(lid("r1"), F.lit(" | "), lid("r2")))).alias("adjudication_reference"),
        F.when(k % 5 == 0, "resolved").alias("notes"))


LABELS = """lab AS (SELECT doc_id || '-' || i || '-' || r AS label_id, 'study-1' AS study_id, doc_id AS clip_id, CASE WHEN doc_id % 53 = 0 THEN 'x' ELSE sha256(text) END AS source_sha256,
 CASE WHEN doc_id % 59 = 0 AND i = 1 THEN 'elbow' ELSE ev END AS event, CASE WHEN r='adj' THEN 'adjudicator' ELSE 'reviewer' END AS review_role,
 CASE WHEN r='r2' AND doc_id % 9 = 0 THEN 'disputed' WHEN r='adj' AND doc_id % 8 = 0 THEN 'pending' WHEN r='r1' AND doc_id % 17 = 0 THEN 'unobservable' ELSE 'confirmed' END AS status, doc_id % 23 <> 0 AS independent,
 CASE WHEN doc_id % 19 = 0 AND r='r2' THEN 'ann-r1' ELSE 'ann-' || r END AS reviewer_id, 'frame step' AS method, CASE WHEN r='adj' AND doc_id % 31 = 0 THEN '2024-01-01' WHEN r='adj' THEN '2024-03-01' ELSE '2024-02-01' END AS reviewed_at,
 raw_time, CASE WHEN doc_id % 6 = 0 AND r='r2' THEN 'audio' WHEN doc_id % 4 = 0 THEN 'audio' ELSE 'light' END AS evidence_source, raw_time - CAST(0.05 AS DOUBLE) AS last_before, raw_time + CASE WHEN doc_id % 61 = 0 THEN CAST(-0.02 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END AS first_after,
 CASE WHEN r='adj' THEN CASE WHEN doc_id % 13 = 0 THEN [doc_id || '-' || i || '-r1'] WHEN doc_id % 29 = 0 THEN [doc_id || '-' || i || '-r1', doc_id || '-' || i || '-zz'] ELSE [doc_id || '-' || i || '-r1', doc_id || '-' || i || '-r2'] END END AS cites, CASE WHEN doc_id % 5 = 0 THEN 'resolved' END AS notes
 FROM (SELECT *, greatest(CAST(n_chars % 400 AS DOUBLE)/100.0 + i*6.0 + CASE r WHEN 'r1' THEN quality*CAST(0.03 AS DOUBLE) WHEN 'r2' THEN toxic*CAST(0.25 AS DOUBLE) - CAST(0.02 AS DOUBLE) ELSE 0 END, 0) AS raw_time
  FROM documents JOIN labels USING (doc_id), (SELECT unnest([0,1,2]) AS i, unnest(['start','hold10','finish']) AS ev), (SELECT unnest(['r1','r2','adj']) AS r)))"""


def observations(spark, sf):
    o = table(spark, sf, "conversations")
    t, n = F.col("turn"), F.length("text")
    return o.select(F.concat(F.col("conv_id").cast("string"), F.lit("/"), t.cast("string")).alias("observation_id"), F.col("conv_id").alias("participant"),
                    F.concat(F.lit("s"), F.floor(t / 2).cast("string")).alias("session_id"), F.when((t == 0) | ((t == 1) & (n % 11 == 0)), "first-use").otherwise("follow-up").alias("task_role"),
                    (t * 10 + F.col("conv_id") % 3).alias("observed_at"), F.when(n % 3 != 0, (n % 100).cast("double")).alias("correction_s"), F.when(n % 5 != 0, F.col("role") == "user").alias("completed"),
                    F.when(n % 7 != 0, n % 4 == 0).alias("assisted"), F.when((t > 0) | (n % 13 == 0), n % 2 == 0).alias("returned"), F.when(n % 6 == 0, "rest").when(n % 6 == 1, " ").alias("decision"))


OBS = """obs AS (SELECT conv_id || '/' || turn AS observation_id, conv_id AS participant, 's' || CAST(floor(turn/2) AS BIGINT) AS session_id, CASE WHEN turn=0 OR (turn=1 AND length(text)%11=0) THEN 'first-use' ELSE 'follow-up' END AS task_role,
 turn*10 + conv_id%3 AS observed_at, CASE WHEN length(text)%3<>0 THEN CAST(length(text)%100 AS DOUBLE) END AS correction_s, CASE WHEN length(text)%5<>0 THEN role='user' END AS completed, CASE WHEN length(text)%7<>0 THEN length(text)%4=0 END AS assisted,
 CASE WHEN turn>0 OR length(text)%13=0 THEN length(text)%2=0 END AS returned, CASE WHEN length(text)%6=0 THEN 'rest' WHEN length(text)%6=1 THEN ' ' END AS decision FROM conversations)"""
