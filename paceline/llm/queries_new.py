"""Queries of frame clusters, quality rules and periodic runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.clusters import cluster_frames
from paceline.llm.periods import find_periodic_runs
from paceline.llm.queries_text import attempts
from paceline.llm.registry import query
from paceline.llm.rules import judge_notes


def rounds_sql(rounds: int) -> str:
    """One pair of tables for each round: vectors given to centroids, then centroids moved."""
    steps = []
    for i in range(rounds + 1):
        steps.append(
            f"near{i} AS MATERIALIZED (SELECT vec_id, e, k, d FROM (SELECT vec_id, e, k, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, k) AS r FROM "
            f"(SELECT vec_id, e, k, list_sum(list_transform(list_zip(e, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{i})) WHERE r = 1)"
        )
        if i < rounds:
            steps.append(
                f"mean{i} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM (SELECT k, j, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM "
                f"(SELECT k, unnest(e) AS x, unnest(range(1, len(e) + 1)) AS j FROM near{i}) GROUP BY k, j) GROUP BY k), "
                f"c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m.c, p.c)::BIGINT[] AS c FROM c{i} p LEFT JOIN mean{i} m USING (k))"
            )
    return ",\n".join(steps)


CLUSTER_SQL = f"""
WITH sound AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE len(embedding) = 64),
v AS MATERIALIZED (
  SELECT vec_id, list_transform(e, lambda x: floor(1024 * x)::BIGINT) AS e FROM sound WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS k, e AS c FROM (SELECT e, sha256('3:' || vec_id) AS h FROM v) ORDER BY h LIMIT 8),
{rounds_sql(10)}
SELECT vec_id, k::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM near10 JOIN c10 USING (k)
"""


@query("op11_centroid_clustering", CLUSTER_SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("frame_id"), F.col("embedding").alias("landmarks"))
    return cluster_frames(vectors, components=64, clusters=8, rounds=10, scale=1024, seed=3).withColumnRenamed("frame_id", "vec_id")


RULES_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
words AS (SELECT r, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM docs),
windows AS (SELECT r, i, w[i:i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM windows) WHERE c > 1),
repeated AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, range(3) s(j) GROUP BY r),
split AS (SELECT r, source, t, unnest(string_split(t, chr(10))) AS raw FROM docs),
lines AS (
  SELECT r, source, t, raw, len(l) AS n,
    regexp_replace(translate(array_to_string(l, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g') AS line
  FROM (SELECT *, list_filter(string_split_regex(raw, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l FROM split) WHERE len(l) > 0),
doubled AS (SELECT r, sum(c - 1) AS n FROM (SELECT r, count(*) AS c FROM lines GROUP BY r, raw) GROUP BY r),
sites AS (SELECT source, count(DISTINCT t) AS texts FROM docs GROUP BY source),
held AS (SELECT source, line, count(DISTINCT t) AS c FROM lines GROUP BY source, line),
common AS (SELECT h.source, line FROM held h JOIN sites s ON h.source IS NOT DISTINCT FROM s.source WHERE c > 10 AND 100 * c > 5 * texts),
gone AS (SELECT r, sum(n) AS n FROM lines l JOIN common c ON l.source IS NOT DISTINCT FROM c.source AND l.line = c.line GROUP BY r),
measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(doubled.n, 0)::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_removed_words
  FROM docs JOIN words USING (r) LEFT JOIN repeated USING (r) LEFT JOIN doubled USING (r) LEFT JOIN gone USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - n_removed_words) >= 50 * n_words AS kept
FROM measured
"""


@query("op12_quality_rules", RULES_SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    """A document's source is the host that its text comes from."""
    notes = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("attempt_id"), F.col("text").alias("notes"), F.col("source").alias("location"))
    found = judge_notes(notes).withColumnRenamed("attempt_id", "doc_id")
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed", "kept")


PERIODS_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda acc, x: xor(xor(acc, x) >> 1, 3988292384 * (xor(acc, x) & 1)))) AS h FROM documents),
sizes AS (SELECT *, len(w)::BIGINT AS n, h // 10 AS g FROM docs),
starts AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM sizes),
steps AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM starts),
texts AS MATERIALIZED (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) END AS w FROM steps),
tokens AS MATERIALIZED (SELECT r, n, unnest(range(0, n)) AS i, unnest(w) AS word FROM texts),
pairs AS (SELECT x.r, x.i, y.i - x.i AS q FROM tokens x JOIN tokens y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs),
stretches AS MATERIALIZED (SELECT r, q, min(i) AS s, count(*) + q AS l FROM islands GROUP BY r, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
runs AS MATERIALIZED (SELECT * FROM stretches x WHERE NOT EXISTS (SELECT 1 FROM stretches y WHERE y.r = x.r AND y.q < x.q AND y.s <= x.s AND y.s + y.l >= x.s + x.l)),
listed AS (
  SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS text, first({'s': s, 'l': l, 'q': q} ORDER BY l::DOUBLE / q DESC, s, q) AS best FROM runs GROUP BY r),
dropped AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM runs),
left_over AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM tokens t WHERE NOT EXISTS (SELECT 1 FROM dropped d WHERE d.r = t.r AND d.i = t.i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length, best.q::BIGINT AS period, (1000 * best.l // best.q)::BIGINT AS exponent_milli,
  sha256(coalesce(listed.text, '')) AS runs_sha256, sha256(coalesce(left_over.text, '')) AS collapsed_sha256
FROM texts LEFT JOIN listed USING (r) LEFT JOIN left_over USING (r)
"""


def planted(rows: DataFrame) -> DataFrame:
    """Documents with the repeats that the query asks for: every tenth text, by the CRC of its doc_id, goes on periodically."""
    h = F.crc32(F.col("attempt_id").cast("string").cast("binary"))
    chosen = rows.withColumn("h", h).withColumn("w", F.when(F.col("h") % 10 == 0, F.filter(F.split(F.coalesce("notes", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda x: x != "")))
    n, g = F.size("w"), F.floor(F.col("h") / 10)
    first = chosen.withColumns({"n": n, "a": F.when(n > 0, g % n).cast("int")}).withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int"))
    again = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    words = F.concat(F.slice("w", 1, F.col("a")), F.slice(again, 1, F.col("n") - F.col("a")))
    return first.withColumn("notes", F.when(F.col("n") > 0, F.array_join(words, " ")).otherwise(F.col("notes"))).select("attempt_id", "notes")


def most_repeated(runs: str) -> Column:
    """The run of the greatest length / period, compared exactly; of equal ones that of the smallest start, then period."""
    return F.aggregate(F.slice(F.col(runs), 2, F.greatest(F.size(runs), F.lit(1))), F.get(runs, F.lit(0)), lambda a, x: F.when(x["length"] * a["period"] > a["length"] * x["period"], x).otherwise(a))


@query("op13_periodic_run_detection", PERIODS_SQL)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    found = find_periodic_runs(planted(attempts(spark, sf)), least_length=24, least_repeats=3).withColumn("best", most_repeated("runs"))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    return found.select(
        F.col("attempt_id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("notes", 256).alias("collapsed_sha256"),
    )
