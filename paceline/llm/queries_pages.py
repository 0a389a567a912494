"""Queries over pages, embeddings and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.archives import new_archive_folder, read_archives, write_archives
from paceline.llm.content import extract_content, fit_content, labelled_pages
from paceline.llm.lattice import near_duplicate_frames
from paceline.llm.registry import query
from paceline.llm.reputation import judge_pages
from paceline.llm.transcripts import fit_roles, format_transcripts

#: The rules of the filter.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]

URL_SQL = r"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
raw AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*', 0) AS h FROM cut),
parts AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*', 0) AS path FROM raw),
rules(rule, verdict) AS (VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')),
fits AS (
  SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM parts
  JOIN rules ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, strpos(rule, '/')))
  GROUP BY 1, 2, 3),
named AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':\d*$', '') AS name FROM parts),
suffixed AS (
  SELECT *, CASE WHEN s = '' THEN name ELSE substr(s, 2) END AS suffix
  FROM (SELECT *, regexp_extract(name, '((?:\.(?:co|com|org|net|ac|gov|edu)\.[a-z]{2})|(?:\.[^.]*))$', 1) AS s FROM named)),
split AS (
  SELECT page_id, host, path, suffix, CASE WHEN l = '' THEN suffix ELSE l || '.' || suffix END AS domain
  FROM (SELECT *, regexp_extract(substr(name, 1, greatest(length(name) - length(suffix) - 1, 0)), '[^.]*$', 0) AS l FROM suffixed)),
linked AS (SELECT p.page_id, (CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS good FROM pages p JOIN labels l ON l.doc_id = try_cast(regexp_extract(p.url, '^[^:]*://[^/?#]*/[a-z]+/(\d+)', 1) AS BIGINT)),
hosts AS (SELECT host, domain, suffix, count(*) AS n, sum(good) AS k FROM linked JOIN split USING (page_id) GROUP BY 1, 2, 3),
world AS (SELECT (coalesce(sum(k), 0) + 1.0) / (coalesce(sum(n), 0) + 2.0) AS m FROM hosts),
s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, any_value(m) AS m FROM hosts, world GROUP BY 1),
ss AS (SELECT 1 / greatest(0.001, least(0.95, coalesce(sum((k - n * m) * (k - n * m) - n * m * (1 - m)) / nullif(sum(n * m * (1 - m) * (n - 1)), 0), 0.001))) - 1 AS s FROM s0),
s1 AS (SELECT suffix, (k + s * m) / (n + s) AS sm FROM s0, ss),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k, any_value(sm) AS m FROM hosts JOIN s1 USING (suffix) GROUP BY 1, 2),
ds AS (SELECT 1 / greatest(0.001, least(0.95, coalesce(sum((k - n * m) * (k - n * m) - n * m * (1 - m)) / nullif(sum(n * m * (1 - m) * (n - 1)), 0), 0.001))) - 1 AS s FROM d0),
d1 AS (SELECT domain, suffix, (k + s * m) / (n + s) AS dm FROM d0, ds),
h0 AS (SELECT host, n, k, dm AS m FROM hosts JOIN d1 USING (domain, suffix)),
hs AS (SELECT 1 / greatest(0.001, least(0.95, coalesce(sum((k - n * m) * (k - n * m) - n * m * (1 - m)) / nullif(sum(n * m * (1 - m) * (n - 1)), 0), 0.001))) - 1 AS s FROM h0),
judged AS (
  SELECT page_id, s * coalesce(dm, sm, m) + coalesce(k, 0) AS a, s * (1 - coalesce(dm, sm, m)) + coalesce(n, 0) - coalesce(k, 0) AS b
  FROM split LEFT JOIN (SELECT host, n, k FROM hosts) h USING (host) LEFT JOIN d1 USING (domain, suffix) LEFT JOIN s1 USING (suffix), hs, world)
SELECT p.page_id, p.host, p.path, f.rule,
  coalesce(f.verdict, CASE WHEN a / (a + b) - sqrt((a / (a + b)) * (1 - a / (a + b)) / (a + b + 1)) >= 0.5 THEN 'allow' ELSE 'block' END) AS verdict
FROM parts p JOIN judged USING (page_id) LEFT JOIN fits f USING (page_id)
"""


@query("op4_url_filters", URL_SQL)
def op4(spark: SparkSession, sf: str) -> DataFrame:
    """A page's url names the document whose label is its outcome."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    document = F.regexp_extract("url", r"^[^:]*://[^/?#]*/[a-z]+/(\d+)", 1)
    good = ((F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")
    outcomes = pages.withColumn("doc_id", F.try_to_number(document, F.lit("999999999999999999")).cast("long")).join(labels.select("doc_id", good.alias("good")), "doc_id")
    return judge_pages(pages, outcomes, RULES).select("page_id", "host", "path", "rule", "verdict")


ARCHIVE_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
first AS (SELECT x, min(page_id) AS f FROM p GROUP BY x),
digits AS (
  SELECT page_id, h, x, f, list_transform(range(0, 8), lambda i: ('0x' || substr(x, (5 * i + 1)::INT, 5))::BIGINT) AS v FROM p JOIN first USING (x))
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  array_to_string(list_transform(v, lambda n: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> 15) & 31)::INT + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> 10) & 31)::INT + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> 5) & 31)::INT + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (n & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = f THEN NULL ELSE f END AS refers_to
FROM digits
"""


@query("op9_warc", ARCHIVE_SQL)
def op9(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_archive_folder(spark)
    manifest = write_archives(spark.read.parquet(f"{sf}/pages.parquet"), folder, least_bytes=0)
    return read_archives(manifest, folder).select(F.col("page_id").cast("long"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long"))


VECTOR_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
sound AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
roots AS (SELECT vec_id, least(vec_id, coalesce((SELECT min(y) FROM reach WHERE x = vec_id), vec_id)) AS component_id FROM v)
SELECT vec_id, (SELECT count(*) FROM links WHERE x = vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM roots
"""


@query("op7_embedding_near_dedup", VECTOR_SQL)
def op7(spark: SparkSession, sf: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("frame_id"), F.col("embedding").alias("landmarks"))
    return near_duplicate_frames(vectors, least_cosine=0.95).withColumnRenamed("frame_id", "vec_id")


@query("op1_chat_formatting")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    """Roles are recovered from the texts alone; the given ones only train the model."""
    talks = spark.read.parquet(f"{sf}/conversations.parquet").withColumnRenamed("conv_id", "request_id")
    model = fit_roles(talks)
    return format_transcripts(talks.select("request_id", "turn", "text"), model).withColumnRenamed("request_id", "conv_id")


@query("op6_html_extraction")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return extract_content(spark.read.parquet(f"{sf}/pages.parquet"), fit_content(labelled_pages(spark)))
