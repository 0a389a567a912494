"""Queries over the attempt library: repair, merge, search, read and write shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dims as D
from ..functions import exprs as X
from ..functions.text import folded
from ..operators import compare as C
from ..operators import library as L
from ..operators import markers as M
from ..sources import exports as E
from ..sources import library_json as J
from ..sources import nested_library as N
from . import roles as R
from . import timing as T
from .live import workdir
from .registry import query

CUR = f"""cur AS (SELECT *, CASE WHEN attempt_id % 31 = 0 THEN 'unknown' ELSE updated_at END AS upd FROM attempts WHERE attempt_id % 3 <> 0),
imp AS (SELECT attempt_id AS import_ord, attempt_id - attempt_id % 2 AS id, CASE WHEN attempt_id % 29 = 0 THEN 'unknown' ELSE updated_at END AS upd, lineage_id, name FROM attempts),
judged0 AS (SELECT i.*, coalesce(epoch(try_cast(i.upd AS TIMESTAMP)), 0) AS ts, (SELECT coalesce(epoch(try_cast(c.upd AS TIMESTAMP)), 0) FROM cur c WHERE c.attempt_id = i.id) AS base FROM imp i),
judged1 AS (SELECT *, max(ts) OVER (PARTITION BY id ORDER BY import_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM judged0),
judged AS (SELECT *, CASE WHEN base IS NULL AND seen IS NULL THEN 'added' WHEN ts > greatest(coalesce(base,-1e300), coalesce(seen,-1e300)) THEN 'updated' ELSE 'unchanged' END AS effect FROM judged1)"""


def library_sides(spark, sf):
    a = R.attempts(spark, sf)
    k = F.col("attempt_id")
    cur = a.where(k % 3 != 0).withColumn("updated_at", F.when(k % 31 == 0, "unknown").otherwise(F.col("updated_at")))
    imp = a.select(k.alias("import_ord"), (k - k % 2).alias("attempt_id"), F.when(k % 29 == 0, "unknown").otherwise(F.col("updated_at")).alias("updated_at"), "lineage_id", "name")
    return cur, imp


VALID_LIN = "CASE WHEN length(lineage_id) <= 256 AND length(trim(lineage_id)) > 0 THEN lineage_id END"


@query("set1", f"""WITH {R.ATTEMPTS}, {CUR}, chain AS (SELECT attempt_id AS id, CAST(-1 AS BIGINT) AS o, upd, lineage_id, name FROM cur UNION ALL SELECT id, import_ord, upd, lineage_id, name FROM judged WHERE effect <> 'unchanged'),
 win AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o DESC) AS rn, max(o) OVER (PARTITION BY id) AS top FROM chain),
 lin AS (SELECT id, {VALID_LIN} AS l, row_number() OVER (PARTITION BY id ORDER BY o) AS rn FROM chain WHERE {VALID_LIN} IS NOT NULL)
 SELECT w.id AS attempt_id, CASE WHEN top >= 0 THEN l.l ELSE w.lineage_id END AS lineage_id, top >= 0 AS from_import, w.upd AS updated_at, w.name FROM win w LEFT JOIN lin l ON w.id = l.id AND l.rn = 1 WHERE w.rn = 1""")
def set1(spark, sf):
    cur, imp = library_sides(spark, sf)
    return L.merge_libraries(cur, imp, ["name"])


@query("set1_counts", f"WITH {R.ATTEMPTS}, {CUR} SELECT effect, count(*) AS n, count(DISTINCT id) AS ids FROM judged GROUP BY 1")
def set1_counts(spark, sf):
    cur, imp = library_sides(spark, sf)
    return L.merge_counts(L.classify_imports(cur, imp))


@query("set2", f"""WITH {R.ATTEMPTS}, {CUR} SELECT i.import_ord, coalesce((SELECT {VALID_LIN} FROM cur c WHERE c.attempt_id = i.id), {VALID_LIN.replace('lineage_id', 'i.lineage_id')}) AS lineage_id FROM imp i""")
def set2(spark, sf):
    cur, imp = library_sides(spark, sf)
    known = cur.select("attempt_id", C.lineage_text().alias("_known"))
    return imp.join(known, "attempt_id", "left").select("import_ord", F.coalesce("_known", C.lineage_text()).alias("lineage_id"))


def fleet(spark, sf):
    """Saved rows whose notes are whole documents, so search has real text to look through."""
    a = R.attempts(spark, sf).withColumn("day", F.col("date"))
    d = R.table(spark, sf, "documents").select(F.col("doc_id").alias("attempt_id"), "text")
    return a.join(d, "attempt_id", "left").select(*a.columns, F.col("text").alias("long_notes"))


SEARCH = f"""WITH {T.WIDE}, r AS (SELECT a.*, d.text, CASE WHEN w.t_f > w.t_s THEN w.t_f - w.t_s END AS total_s, least({T.rank('w.cf_s')}, {T.rank('w.cf_f')}) AS rk
 FROM attempts a LEFT JOIN documents d ON a.attempt_id = d.doc_id LEFT JOIN wide w ON a.attempt_id = w.attempt_id),
 rows_ AS (SELECT *, total_s IS NULL OR rk < 2 AS needs_review, trim(lower(strip_accents(name || ' ' || location || ' ' || coalesce(text, '')))) AS search_text FROM r)"""


@query("top1", SEARCH + " SELECT attempt_id, name, total_s, needs_review, updated_at FROM rows_ WHERE contains(search_text, 'attempt') AND contains(search_text, 'elle') AND contains(search_text, 'ete')")
def top1(spark, sf):
    rows = L.saved_rows(fleet(spark, sf), T.wide(spark, sf), ["name", "location", "long_notes"])
    return L.search(rows, "Attempt ELLE été", "all", "updated").select("attempt_id", "name", "total_s", "needs_review", "updated_at")


@query("top1_timed", SEARCH + " SELECT attempt_id, date, total_s FROM rows_ WHERE contains(search_text, 'gym-2') AND NOT needs_review")
def top1_timed(spark, sf):
    rows = L.saved_rows(fleet(spark, sf), T.wide(spark, sf), ["name", "location", "long_notes"])
    return L.search(rows, "gym-2", "timed", "recorded").select("attempt_id", "date", "total_s")


@query("fn13", "SELECT doc_id, md5(trim(lower(strip_accents(text)))) AS folded_md5 FROM documents")
def fn13(spark, sf):
    return R.table(spark, sf, "documents").select("doc_id", F.md5(folded("text").cast("binary")).alias("folded_md5"))


@query("top7", f"WITH {R.ATTEMPTS} SELECT attempt_id, updated_at, name FROM attempts")
def top7(spark, sf):
    return L.newest_first(R.attempts(spark, sf)).select("attempt_id", "updated_at", "name")


# --- stored records as text -------------------------------------------------------------------

def session_text(spark, sf):
    """One JSON session per order, some of them malformed in known ways."""
    o = R.table(spark, sf, "orders")
    k, s = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    j = F.concat(
        F.lit('{"version":'), F.when(k % 19 == 0, "2").otherwise("1"), F.lit(',"id":"'), F.when(k % 23 == 0, "").otherwise(s),
        F.lit('","name":'), F.when(k % 7 == 0, s).otherwise(F.concat(F.lit('"Attempt '), s, F.lit('"'))), F.lit(',"createdAt":"c","updatedAt":"u'), s,
        F.lit('","location":'), F.when(k % 5 == 0, "17").when(k % 5 == 1, "null").otherwise(F.concat(F.lit('"gym '), F.col("o_custkey").cast("string"), F.lit('"'))),
        F.when(k % 3 == 0, F.lit("")).otherwise(F.lit(',"settings":{"a":1}')), F.when(k % 29 == 0, F.lit(',"timestamps":{}')).otherwise(F.lit(',"timestamps":[]')), F.lit("}"))
    return o.select(k.alias("k"), j.alias("j"))


SESSION_TEXT = """session_text AS (SELECT o_orderkey AS k, '{"version":' || CASE WHEN o_orderkey % 19 = 0 THEN '2' ELSE '1' END || ',"id":"' || CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END
 || '","name":' || CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE '"Attempt ' || o_orderkey || '"' END || ',"createdAt":"c","updatedAt":"u' || o_orderkey || '","location":'
 || CASE WHEN o_orderkey % 5 = 0 THEN '17' WHEN o_orderkey % 5 = 1 THEN 'null' ELSE '"gym ' || o_custkey || '"' END || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ',"settings":{"a":1}' END
 || CASE WHEN o_orderkey % 29 = 0 THEN ',"timestamps":{}' ELSE ',"timestamps":[]' END || '}' AS j FROM orders),
good AS (SELECT * FROM session_text WHERE json_extract_string(j,'$.version')='1' AND json_type(j,'$.id')='VARCHAR' AND length(json_extract_string(j,'$.id'))>0 AND json_type(j,'$.name')='VARCHAR'
 AND coalesce(json_type(j,'$.location'),'NULL') IN ('VARCHAR','NULL') AND json_type(j,'$.settings') IS NOT NULL AND json_type(j,'$.timestamps')='ARRAY')"""


@query("src1", f"""WITH {SESSION_TEXT} SELECT json_extract_string(j,'$.id') AS session_id, json_extract_string(j,'$.name') AS name, json_extract_string(j,'$.updatedAt') AS updated_at, '' AS climber,
 coalesce(json_extract_string(j,'$.location'),'') AS location, 'Training' AS attempt_type, '' AS notes, CAST(NULL AS VARCHAR) AS lineage_id FROM good WHERE k % 2 = 0""")
def src1(spark, sf):
    marker = F.when(F.col("k") % 2 == 0, "attempt-library").otherwise("something-else")
    doc = F.concat(F.lit('{"format":"'), marker, F.lit('","version":1,"exportedAt":"x","sessions":['), F.col("j"), F.lit("]}"))
    docs = session_text(spark, sf).select(F.try_parse_json(doc).alias("doc"))
    return J.session_columns(J.library_sessions(docs, "attempt-library"))


@query("src2", f"WITH {SESSION_TEXT} SELECT k AS attempt_id FROM good")
def src2(spark, sf):
    s = session_text(spark, sf).select(F.col("k").alias("attempt_id"), F.try_parse_json("j").alias("session"))
    return s.where(J.well_formed(F.col("session"))).select("attempt_id")


def dataset_text(spark, sf):
    o = R.table(spark, sf, "orders")
    k, s = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    j = F.concat(
        F.when(k % 6 == 0, F.lit("{")).otherwise(F.lit('{"appVersion":"1",')), F.lit('"session":{"sessionId":'), q(s), F.lit(',"sessionName":"'), F.when(k % 4 == 0, "").otherwise(F.col("o_orderstatus")),
        F.lit('","date":"'), F.to_date("o_orderdate").cast("string"), F.lit('","location":"'), F.when(k % 3 == 0, "").otherwise(F.lit("hall")), F.lit('","gym":"gym '), (k % 9).cast("string"),
        F.lit('"},"video":{"fileName":"'), F.when(k % 5 == 0, "").otherwise(F.lit("a.mov")), F.lit('","duration":'), (12 + k % 7).cast("string"),
        F.lit('},"athleteNotes":'), q(F.col("o_orderpriority")), F.lit(',"acceptedTimestamps":[{"markerId":"startSignal","acceptedRawTime":'), (k % 4).cast("string"), F.lit('.5,"source":"Manual","confidence":"High"},{"markerId":"knee","acceptedRawTime":1},{"markerId":"finishPad","acceptedRawTime":'),
        F.when(k % 11 == 0, F.lit('"6"')).otherwise((k % 13).cast("string")), F.lit(',"source":"Manual","confidence":"Medium"}]}'))
    return o.select(F.try_parse_json(j).alias("doc"))


@query("src3", """SELECT CAST(o_orderkey AS VARCHAR) AS session_id, CASE WHEN o_orderkey % 4 = 0 THEN 'Imported session' ELSE o_orderstatus END AS name, '' AS climber, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date,
 CASE WHEN o_orderkey % 3 = 0 THEN 'gym ' || (o_orderkey % 9) ELSE 'hall' END AS location, 'Training' AS attempt_type, o_orderpriority AS notes, CASE WHEN o_orderkey % 5 <> 0 THEN 'a.mov' END AS file_name,
 CASE WHEN o_orderkey % 5 <> 0 THEN CAST(12 + o_orderkey % 7 AS DOUBLE) END AS duration_s FROM orders WHERE o_orderkey % 6 <> 0""")
def src3(spark, sf):
    return J.dataset_sessions(dataset_text(spark, sf))


@query("src4", """WITH t AS (SELECT CAST(o_orderkey AS VARCHAR) AS attempt_id, o_orderkey % 4 + 0.5 AS s, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 13 END AS f FROM orders),
 ids AS (SELECT unnest(['startSignal','firstMovement','committedLaunch','firstHold','hold10','finishPad']) AS marker_id, unnest([1,2,3,4,5,6]) AS marker_ord)
 SELECT attempt_id, marker_id, CAST(marker_ord AS INTEGER) AS marker_ord, CAST(CASE marker_ord WHEN 1 THEN s WHEN 6 THEN CASE WHEN f > s + 0.001 THEN f END END AS DOUBLE) AS raw_time,
 CASE WHEN marker_ord = 1 OR (marker_ord = 6 AND f > s + 0.001) THEN 'Manual' ELSE 'Not set' END AS source FROM t CROSS JOIN ids""")
def src4(spark, sf):
    return M.repair(J.dataset_markers(dataset_text(spark, sf))).select("attempt_id", "marker_id", "marker_ord", "raw_time", "source")


@query("snk1", f"WITH {T.BASE}, {T.REPAIRED}, n AS (SELECT attempt_id, count(*) AS n_markers, count(raw_time) AS n_set, sum(climb_time) AS climb FROM repaired GROUP BY 1) SELECT a.attempt_id, a.date, n_markers, n_set, round(climb, 6) AS climb FROM attempts a LEFT JOIN n ON a.attempt_id = n.attempt_id")
def snk1(spark, sf):
    rec = J.library_records(R.attempts(spark, sf), M.repair(R.raw_markers(spark, sf), R.attempts(spark, sf)))
    t = F.col("timestamps")
    n_set = F.size(F.filter(t, lambda m: m["raw_time"].isNotNull()))
    climb = F.aggregate(F.filter(t, lambda m: m["climb_time"].isNotNull()), F.lit(0.0), lambda a, m: a + m["climb_time"])
    return rec.select("attempt_id", "date", F.when(t.isNotNull(), F.size(t)).cast("bigint").alias("n_markers"), F.when(t.isNotNull(), n_set).cast("bigint").alias("n_set"),
                      F.when(n_set > 0, F.round(climb, 6)).alias("climb"))


@query("src1_rejects", f"""WITH {SESSION_TEXT} SELECT s.k AS attempt_id, CASE WHEN s.k % 2 = 1 THEN 'not-a-library' WHEN g.k IS NULL THEN 'malformed-session' END AS reason FROM session_text s LEFT JOIN good g ON g.k = s.k""")
def src1_rejects(spark, sf):
    """Every stored session, and why it can't be used."""
    marker = F.when(F.col("k") % 2 == 0, "attempt-library").otherwise("something-else")
    doc = F.concat(F.lit('{"format":"'), marker, F.lit('","version":1,"exportedAt":"x","sessions":['), F.col("j"), F.lit("]}"))
    docs = session_text(spark, sf).select(F.col("k").alias("file"), F.try_parse_json(doc).alias("doc"))
    return N.document_sessions(docs, "attempt-library").select(F.col("file").alias("attempt_id"), "reason")


@query("snk1_readback", f"WITH {T.WIDE}, {T.METRICS}, {T.PAIRS}, {T.COMPARE} SELECT * FROM compared")
def snk1_readback(spark, sf):
    """Attempts and markers written as library documents, read back, and compared like those of the tables."""
    attempts = R.attempts(spark, sf)
    none = lambda columns: spark.createDataFrame([], columns)
    rgb = "struct<r:double,g:double,b:double>"
    settings = "attempt_id long, " + ", ".join(f"{c} {'string' if c in N.CHOICES else 'double'}" for c in N.SETTINGS.values())
    held = N.Library(attempts, M.repair(R.raw_markers(spark, sf), attempts), none("attempt_id long, zone_id string, label string, x1 double, y1 double, x2 double, y2 double"), none(settings),
                     none(f"attempt_id long, before_rgb {rgb}, after_rgb {rgb}, before_time double, after_time double, colour_delta double"), none("file string, position long, reason string"))
    path = f"{workdir(spark)}/library"
    N.write_libraries(N.session_records(held), path, "attempt-library", "now", sessions=attempts.count(), compression="gzip")
    back = N.library_tables(N.read_written(spark, path, "attempt-library"))
    a = back.attempts.withColumns({"attempt_id": F.col("attempt_id").cast("long"), "athlete": F.col("athlete").cast("long")})
    return T.C.compare_pairs(T.C.consecutive_pairs(T.C.timed_attempts(a, M.repair_wide(back.markers.withColumn("attempt_id", F.col("attempt_id").cast("long")), a))), T.PRACTICE)


@query("snk2", f"""WITH {T.BASE}, {T.REPAIRED}, n AS (SELECT attempt_id, count(raw_time) AS n_set, count(*) FILTER (abs(raw_time-detected_raw_time) > 0.001) AS adjusted, max(climb_time) FILTER (marker_id='finishPad') AS total FROM repaired GROUP BY 1)
 SELECT a.attempt_id, a.name, a.file_name, n_set, adjusted, total FROM attempts a LEFT JOIN n ON a.attempt_id = n.attempt_id""")
def snk2(spark, sf):
    w = T.wide(spark, sf)
    r = E.dataset_records(R.attempts(spark, sf), w, M.to_long(w))
    t = F.col("accepted_timestamps")
    some = lambda cond: F.when(t.isNotNull(), F.size(F.filter(t, cond))).cast("bigint")
    return r.select("attempt_id", "session.name", "video.file_name", some(lambda m: m["accepted_raw_time"].isNotNull()).alias("n_set"),
                    some(lambda m: m["user_adjusted"]).alias("adjusted"), F.col("splits.calculated_total").alias("total"))


@query("snk3", f"""WITH {T.BASE}, {T.REPAIRED}, cand AS (SELECT attempt_id, marker_id, raw_time + coalesce(offset_applied, 0) / 2 AS raw_time FROM raw_markers)
 SELECT c.attempt_id, c.marker_id, c.raw_time, coalesce(abs(r.raw_time - c.raw_time) <= 0.02, false) AS accepted, NOT coalesce(abs(r.raw_time - c.raw_time) <= 0.02, false) AS rejected
 FROM cand c LEFT JOIN repaired r ON c.attempt_id = r.attempt_id AND c.marker_id = r.marker_id""")
def snk3(spark, sf):
    raw = R.raw_markers(spark, sf)
    cand = raw.select("attempt_id", "marker_id", (F.col("raw_time") + F.coalesce("offset_applied", F.lit(0.0)) / 2).alias("raw_time"))
    return E.candidate_export(cand, M.repair(raw, R.attempts(spark, sf))).select("attempt_id", "marker_id", "raw_time", "accepted", "rejected")


@query("snk4", """SELECT p_partkey, list_filter([CASE WHEN p_size < 5 THEN 'start failed' END, CASE WHEN p_size % 7 = 0 THEN 'movement-underway' END, CASE WHEN p_size % 11 = 0 THEN 'first-sampled-frame' END, CASE WHEN p_size % 13 = 0 THEN 'scene cut' END,
  CASE WHEN p_size / 800.0 > 0.05 THEN 'light-zone-large' END, CASE WHEN p_size / 100.0 > 0.3 THEN 'body-zone-large' END], lambda x: x IS NOT NULL) AS warnings FROM part""")
def snk4(spark, sf):
    s = F.col("p_size")
    w = E.detection_warnings([F.when(s < 5, "start failed")], s % 7 == 0, s % 11 == 0, F.when(s % 13 == 0, "scene cut"), s / 800.0, s / 100.0)
    return R.table(spark, sf, "part").select("p_partkey", w.alias("warnings"))


@query("snk5", None)
def snk5(spark, sf):
    w = T.wide(spark, sf)
    return E.reports(E.dataset_records(R.attempts(spark, sf), w, M.to_long(w)))


@query("snk6", """SELECT doc_id, md5(CAST(to_json(source || chr(10) || '"' || lang || '"') AS VARCHAR)) AS yaml_md5, CASE WHEN n_chars % 5 = 0 THEN '' ELSE CAST(n_chars AS VARCHAR) END AS yaml_number FROM documents""")
def snk6(spark, sf):
    d = R.table(spark, sf, "documents")
    text = F.concat("source", F.lit('\n"'), "lang", F.lit('"'))
    return d.select("doc_id", F.md5(E.yaml_string(text).cast("binary")).alias("yaml_md5"),
                    E.plain_number(F.when(F.col("n_chars") % 5 != 0, F.col("n_chars").cast("double"))).alias("yaml_number"))


# --- dimensions joined with the data ----------------------------------------------------------

HOLDS = "holds AS (SELECT * FROM (VALUES " + ",".join(f"({i},{x}/376.0*3.0,(1-{y}/531.0)*15.0)" for i, x, y in D.HOLD_PIXELS) + ") AS t(hold_id, hold_x, hold_y))"
HOLDS = HOLDS.replace("/376.0", "::DOUBLE/376.0").replace("/531.0", "::DOUBLE/531.0")


@query("dim1", f"WITH {HOLDS} SELECT p_partkey, hold_id, round(hold_x, 9) AS hold_x, round(hold_y, 9) AS hold_y FROM part JOIN holds ON hold_id = p_size % 20 + 1")
def dim1(spark, sf):
    h = F.broadcast(D.holds(spark))
    return R.table(spark, sf, "part").join(h, F.col("hold_id") == F.col("p_size") % 20 + 1).select("p_partkey", "hold_id", F.round("hold_x", 9).alias("hold_x"), F.round("hold_y", 9).alias("hold_y"))


BOLTS = "bolts AS (SELECT * FROM (VALUES " + ",".join(f"({h},'{s}{p}','{c}{r}',{(1.5 if s == 'DX' else 0) + 0.125 + D.BOLT_COLUMNS.index(c) * 0.125},{(p - 1) * 1.5 + 0.1875 + (r - 1) * 0.125})" for h, s, p, c, r in D.BOLTS) + ") AS t(hold_id, panel, grid, bolt_x, bolt_y))"


@query("dim2", f"WITH {BOLTS} SELECT p_partkey, hold_id, panel, grid, CAST(bolt_x AS DOUBLE) AS bolt_x, CAST(bolt_y AS DOUBLE) AS bolt_y FROM part JOIN bolts ON hold_id = p_size % 20 + 1")
def dim2(spark, sf):
    b = F.broadcast(D.bolts(spark))
    return R.table(spark, sf, "part").join(b, F.col("hold_id") == F.col("p_size") % 20 + 1).select("p_partkey", "hold_id", "panel", "grid", "bolt_x", "bolt_y")


@query("dim4", """WITH v AS (SELECT * FROM (VALUES (0,'control-720',0.0,false),(1,'compact-360',0.0,false),(2,'dark-720',0.0,false),(3,'low-fps-720',0.0,false),(4,'silent-720',0.0,true),(5,'trim-2s-720',2.0,false)) AS t(i, variation_id, trim_s, silent))
 SELECT o_orderkey, variation_id, CAST(trim_s AS DOUBLE) AS trim_s, silent FROM orders JOIN v ON i = o_orderkey % 6""")
def dim4(spark, sf):
    names = F.array(*[F.lit(v[0]) for v in D.VARIATIONS])
    o = R.table(spark, sf, "orders").select("o_orderkey", F.element_at(names, (F.col("o_orderkey") % 6 + 1).cast("int")).alias("variation_id"))
    return o.join(F.broadcast(D.variations(spark)), "variation_id").select("o_orderkey", "variation_id", "trim_s", "silent")


@query("gen1", """WITH w AS (SELECT p_partkey, CAST(p_size AS DOUBLE)/10 AS s, CAST(p_size AS DOUBLE)/10 + p_partkey % 5 AS e, CAST(5 + p_partkey % 3 * 5 AS DOUBLE) AS fps FROM part), g AS (SELECT *, CAST(floor((e-s)*fps + 0.25) AS BIGINT) AS n FROM w)
 SELECT p_partkey, i AS sample, floor((s + i/fps)*1000+0.5)/1000 AS raw_time FROM g, unnest(range(0, n+1)) AS u(i) WHERE e >= s""")
def gen1(spark, sf):
    from ..operators import series as S
    p = R.table(spark, sf, "part").select("p_partkey", (F.col("p_size").cast("double") / 10).alias("start_s"), (F.col("p_size").cast("double") / 10 + F.col("p_partkey") % 5).alias("end_s"),
                                          (5.0 + F.col("p_partkey") % 3 * 5).alias("fps"))
    return S.sample_grid(p, "start_s", "end_s", "fps").select("p_partkey", "sample", "raw_time")


# --- stored-record repair ----------------------------------------------------------------------

def zone_rows(spark, sf):
    p = R.table(spark, sf, "lineitem")
    return p.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.struct(
        (F.col("l_discount") * 12 - 0.1).alias("x1"), (F.col("l_tax") * 10).alias("y1"), (F.col("l_quantity") / 45.0).alias("x2"), (F.col("l_quantity") / 50.0 - 0.05).alias("y2")).alias("z"))


ZONE = "zr AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount*12-0.1 AS x1, l_tax*10 AS y1, l_quantity/45.0 AS x2, l_quantity/50.0-0.05 AS y2 FROM lineitem)"


@query("prj11", f"""WITH {ZONE}, c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, least(1,greatest(0,least(x1,x2))) AS x1, least(1,greatest(0,greatest(x1,x2))) AS x2, least(1,greatest(0,least(y1,y2))) AS y1, least(1,greatest(0,greatest(y1,y2))) AS y2 FROM zr)
 SELECT l_orderkey, l_linenumber, l_partkey, x1, y1, x2, y2 FROM c WHERE x2-x1 > 0.005 AND y2-y1 > 0.005""")
def prj11(spark, sf):
    return zone_rows(spark, sf).withColumn("z", L.repair_zone("z")).where("z is not null").select("l_orderkey", "l_linenumber", "l_partkey", "z.*")


@query("prj12", """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity*6 AS r, l_tax*3000 AS g, l_discount*2500 AS b, l_discount*2500 AS r2, l_quantity*5 AS g2, l_tax*3000 AS b2, l_quantity-3 AS t FROM lineitem),
 v AS (SELECT *, r BETWEEN 0 AND 255 AND g BETWEEN 0 AND 255 AND b BETWEEN 0 AND 255 AS ok1, r2 BETWEEN 0 AND 255 AND g2 BETWEEN 0 AND 255 AND b2 BETWEEN 0 AND 255 AS ok2 FROM c)
 SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN ok1 THEN r END AS before_r, CASE WHEN ok2 THEN g2 END AS after_g, CASE WHEN ok1 AND ok2 THEN floor(sqrt((r-r2)*(r-r2)+(g-g2)*(g-g2)+(b-b2)*(b-b2))*1000+0.5)/1000 END AS colour_delta,
 CASE WHEN t >= 0 AND t <= 40.001 THEN t END AS before_time FROM v""")
def prj12(spark, sf):
    q, t, d = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    df = R.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.struct((q * 6).alias("r"), (t * 3000).alias("g"), (d * 2500).alias("b")).alias("before_rgb"),
                                               F.struct((d * 2500).alias("r"), (q * 5).alias("g"), (t * 3000).alias("b")).alias("after_rgb"), (q - 3).alias("before_time"), q.alias("after_time"), F.lit(40.0).alias("dur"))
    return L.repair_light_calibration(df, "dur").select("l_orderkey", "l_linenumber", "l_partkey", F.col("before_rgb.r").alias("before_r"), F.col("after_rgb.g").alias("after_g"), "colour_delta", "before_time")


@query("prj13", """SELECT p_partkey, trim(CASE WHEN p_size % 4 = 0 THEN '  ' ELSE ' ' || p_name || ' ' END) AS file_name, CAST(p_size - 3 AS DOUBLE) AS duration_s, CAST(floor(p_retailprice/3+0.5) AS BIGINT) AS width, CAST(floor(p_size*1.5+0.5) AS BIGINT) AS height
 FROM part WHERE p_size % 4 <> 0 AND p_size > 3""")
def prj13(spark, sf):
    s = F.col("p_size")
    df = R.table(spark, sf, "part").select("p_partkey", F.when(s % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_name", F.lit(" "))).alias("file_name"), (s - 3).cast("double").alias("duration_s"),
                                           (F.col("p_retailprice") / 3).alias("width"), (s * 1.5).alias("height"))
    return L.repair_recording(df)


def settings_rows(spark, sf):
    o = R.table(spark, sf, "orders")
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (k % len(v) + 1).cast("int"))
    return o.select(k.alias("attempt_id"), (p / 10 - 5000).alias("start_search_start"), (p / 9 - 5000).alias("start_search_end"), pick("low", "extreme", "high").alias("start_sensitivity"),
                    pick("medium", "low", "x").alias("movement_sensitivity"), pick("blocked", "foggy").alias("light_visibility"), pick("auto", "motion", "psychic", "manual").alias("start_profile"),
                    pick("committed", "latest").alias("movement_definition"), (p / 100000 - 1).alias("reaction_offset"), (p / 50000 - 4).alias("start_offset"), (p / 100000 - 1).alias("launch_min_delay"),
                    (p / 50000 - 4).alias("movement_offset"), pick(" 12.3 ", "-4", "abc", "").alias("official_total"))


@query("prj8", """WITH s AS (SELECT o_orderkey AS attempt_id, o_totalprice/10-5000 AS a, o_totalprice/9-5000 AS b, o_totalprice/100000-1 AS r, o_totalprice/50000-4 AS f FROM orders), t AS (SELECT *, CASE WHEN a BETWEEN 0 AND 21599.5 THEN a ELSE 0.0 END AS sa, CASE WHEN b BETWEEN 0 AND 21600 THEN b ELSE 12.0 END AS sb FROM s)
 SELECT attempt_id, sa AS start_search_start, CASE WHEN sb > sa THEN sb ELSE least(21600.0, sa + 12) END AS start_search_end, ['low','medium','high'][1+CAST(attempt_id%3 AS INT)] AS start_sensitivity, ['medium','low','medium'][1+CAST(attempt_id%3 AS INT)] AS movement_sensitivity,
 ['blocked','clear'][1+CAST(attempt_id%2 AS INT)] AS light_visibility, ['auto','motion','auto','manual'][1+CAST(attempt_id%4 AS INT)] AS start_profile, ['committed','earliest'][1+CAST(attempt_id%2 AS INT)] AS movement_definition,
 CASE WHEN r BETWEEN 0 AND 2 THEN r ELSE 0.2 END AS reaction_offset, CASE WHEN f BETWEEN -2 AND 2 THEN f ELSE 0.0 END AS start_offset, CASE WHEN r BETWEEN 0 AND 2 THEN r ELSE 0.1 END AS launch_min_delay,
 CASE WHEN f BETWEEN -2 AND 2 THEN f ELSE 0.0 END AS movement_offset, CASE WHEN attempt_id % 4 = 0 THEN '12.3' ELSE '' END AS official_total FROM t""")
def prj8(spark, sf):
    return L.repair_settings(settings_rows(spark, sf))


@query("prj9", """WITH s AS (SELECT o_orderkey AS attempt_id, CASE WHEN o_totalprice/10-5000 BETWEEN 0 AND 21599.5 THEN o_totalprice/10-5000 ELSE 0.0 END AS a, CASE WHEN o_totalprice/9-5000 BETWEEN 0 AND 21600 THEN o_totalprice/9-5000 ELSE 12.0 END AS b, CAST(o_orderkey % 4000 - 10 AS DOUBLE) AS d0 FROM orders),
 t AS (SELECT attempt_id, a, CASE WHEN b > a THEN b ELSE least(21600.0, a+12) END AS b, CASE WHEN d0 > 0 THEN d0 ELSE 0 END AS d FROM s), u AS (SELECT *, least(a, greatest(0, d-0.5)) AS w FROM t)
 SELECT attempt_id, w AS window_start, least(d, greatest(least(d, w+0.5), b)) AS window_end FROM u""")
def prj9(spark, sf):
    df = L.repair_settings(settings_rows(spark, sf)).withColumn("d", (F.col("attempt_id") % 4000 - 10).cast("double"))
    a, b = L.start_search_window("start_search_start", "start_search_end", "d")
    return df.select("attempt_id", a.alias("window_start"), b.alias("window_end"))


@query("prj10", f"WITH {T.WIDE}, x AS (SELECT w.attempt_id, greatest(coalesce(t_s,0),0) AS s, duration_s AS d FROM wide w JOIN attempts a ON a.attempt_id = w.attempt_id) SELECT attempt_id, s+3.0 AS window_start, greatest(s+3.0, least(greatest(0, d-0.04), s+30.0)) AS window_end FROM x")
def prj10(spark, sf):
    df = T.wide(spark, sf).join(R.attempts(spark, sf).select("attempt_id", "duration_s"), "attempt_id")
    a, b = L.finish_search_window("startSignal.raw_time", "duration_s")
    return df.select("attempt_id", a.alias("window_start"), b.alias("window_end"))


@query("prj18", f"""WITH {T.WIDE}, x AS (SELECT w.attempt_id, t_s AS s, duration_s AS d, (w.attempt_id % 30) * CAST(0.7 AS DOUBLE) - 2 AS t FROM wide w JOIN attempts a ON a.attempt_id = w.attempt_id)
 SELECT attempt_id, CASE WHEN s >= 0 AND d > s AND t > 0 AND s+t > s+0.001 AND s+t <= d+0.001 THEN least(d, s+t) END AS finish_s FROM x""")
def prj18(spark, sf):
    df = T.wide(spark, sf).join(R.attempts(spark, sf).select("attempt_id", "duration_s"), "attempt_id").withColumn("total", (F.col("attempt_id") % 30) * 0.7 - 2)
    return df.select("attempt_id", L.official_finish("startSignal.raw_time", "duration_s", "total").alias("finish_s"))


BODY = """CASE WHEN (x1+x2)/2 >= 0.5 THEN greatest(0.5,(x1+x2)/2-0.2) ELSE greatest(0,(x1+x2)/2-0.23) END AS x1, greatest(0.42,(y1+y2)/2-0.34) AS y1,
 CASE WHEN (x1+x2)/2 >= 0.5 THEN least(1,(x1+x2)/2+0.23) ELSE least(0.5,(x1+x2)/2+0.2) END AS x2, least(0.9,greatest(0.74,(y1+y2)/2-0.025)) AS y2"""


@query("prj21", f"WITH {ZONE} SELECT l_orderkey, l_linenumber, l_partkey, {BODY} FROM zr")
def prj21(spark, sf):
    return zone_rows(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", L.body_region("z").alias("b")).select("l_orderkey", "l_linenumber", "l_partkey", "b.*")


@query("prj30", f"""WITH {T.WIDE}, p AS (SELECT attempt_id, 'total' AS phase, t_f > t_s AS ok, t_s AS a, t_f AS b FROM wide UNION ALL SELECT attempt_id, 'bottom', t_f > t_s AND mode_x='frame-review' AND t_x > t_s AND t_x < t_f, t_s, t_x FROM wide
 UNION ALL SELECT attempt_id, 'top', t_f > t_s AND mode_x='frame-review' AND t_x > t_s AND t_x < t_f, t_x, t_f FROM wide), r AS (SELECT attempt_id, phase, CASE WHEN ok THEN a END AS range_start, CASE WHEN ok THEN b END AS range_end FROM p)
 SELECT *, CASE WHEN range_start IS NOT NULL THEN range_start + greatest(0, least(2.5, range_end-range_start)) END AS at_s FROM r""")
def prj30(spark, sf):
    out = L.playback_ranges(T.wide(spark, sf))
    return out.withColumn("at_s", F.when(F.col("range_start").isNotNull(), L.playback_time("range_start", "range_end", F.lit(2.5))))


@query("prj36", f"WITH {T.WIDE} SELECT attempt_id, 11 - (CASE WHEN attempt_id % 2 = 0 THEN 1 ELSE 0 END) AS kept FROM wide")
def prj36(spark, sf):
    from ..operators.metrics import split_map
    m = split_map(T.wide(spark, sf))
    broken = F.transform_values("split_calculations", lambda k, v: F.when((k == "reaction_time") & (F.col("attempt_id") % 2 == 0), float("nan")).otherwise(v))
    return m.select("attempt_id", F.size(L.finite_splits(broken)).alias("kept"))


@query("prj41", "SELECT p_partkey, CAST(NULL AS BIGINT) AS result_id, CASE WHEN p_size % 3 <> 0 THEN p_partkey END AS calibration_id FROM part")
def prj41(spark, sf):
    p = R.table(spark, sf, "part").select("p_partkey", F.col("p_partkey").alias("result_id"), F.col("p_partkey").alias("calibration_id"),
                                          F.when(F.col("p_size") % 3 == 0, "automatic-approximate").when(F.col("p_size") % 3 == 1, "manual").alias("calibration_source"))
    return L.drop_automatic_geometry(p).select("p_partkey", "result_id", "calibration_id")


@query("jn16", f"""WITH {T.WIDE}, x AS (SELECT attempt_id, t_s AS s, t_f AS f, t_s + (attempt_id % 3)*0.0006 AS rs, t_f + (attempt_id % 5 - 2)*0.0007 AS re, attempt_id % 7 = 0 AS shifted, attempt_id % 11 = 0 AS nozone, attempt_id % 22 = 0 AS none_both FROM wide),
 z AS (SELECT *, CASE WHEN nozone THEN none_both ELSE NOT shifted END AS zone_ok FROM x)
 SELECT attempt_id, coalesce(abs(rs-s) <= 0.001 AND abs(re-f) <= 0.001, false) AND zone_ok AS fresh, coalesce(abs(rs-s) <= 0.001 AND re+0.001 >= f, false) AND zone_ok AS covers FROM z""")
def jn16(spark, sf):
    k = F.col("attempt_id")
    zone = lambda d: F.struct(*[(F.lit(v) + d).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), (0.1, 0.2, 0.3, 0.4))])
    df = T.wide(spark, sf).select("attempt_id", F.col("startSignal.raw_time").alias("start_s"), F.col("finishPad.raw_time").alias("end_s"))
    df = df.withColumns({"result_start": F.col("start_s") + (k % 3) * 0.0006, "result_end": F.col("end_s") + (k % 5 - 2) * 0.0007,
                         "result_zone": F.when(k % 11 != 0, zone(F.when(k % 7 == 0, 0.01).otherwise(0.0))), "zone": F.when(k % 22 != 0, zone(F.lit(0.0)))})
    return L.result_freshness(df).select("attempt_id", "fresh", "covers")


@query("fn15", f"""WITH {R.ATTEMPTS} SELECT a.attempt_id, a.file_name = b.file_name AND a.width = b.width AND abs(a.duration_s - b.duration_s) <= greatest(0.1, abs(b.duration_s)*0.005) AS matches
 FROM (SELECT *, duration_s + (attempt_id % 5)*0.04 AS d2 FROM attempts) b JOIN (SELECT attempt_id, athlete, file_name, width, duration_s + (attempt_id % 5)*0.04 AS duration_s FROM attempts) a ON a.attempt_id = b.attempt_id""")
def fn15(spark, sf):
    cols = ["file_name", "duration_s", "width", "height"]
    a = R.attempts(spark, sf).withColumn("b", F.struct(*cols)).withColumn("duration_s", F.col("duration_s") + (F.col("attempt_id") % 5) * 0.04).withColumn("a", F.struct(*cols))
    return a.select("attempt_id", L.recording_matches("a", "b").alias("matches"))


@query("fn16", f"WITH {T.BASE} SELECT m.attempt_id, bool_and(raw_time >= 0 AND raw_time <= duration_s) AS fits FROM raw_markers m JOIN attempts a ON m.attempt_id = a.attempt_id GROUP BY 1")
def fn16(spark, sf):
    return L.markers_fit(R.raw_markers(spark, sf), R.attempts(spark, sf))


@query("fn17", f"""WITH {T.WIDE} SELECT attempt_id, sha256('{{"attempt_id":' || attempt_id || ',"s":' || CASE WHEN t_s IS NULL THEN 'null' ELSE CAST(CAST(floor(t_s*1000+0.5) AS BIGINT) AS VARCHAR) END || '}}') AS fingerprint FROM wide""")
def fn17(spark, sf):
    return T.wide(spark, sf).select("attempt_id", C.context_key("attempt_id", F.floor(F.col("startSignal.raw_time") * 1000 + 0.5).alias("s")).alias("fingerprint"))


@query("fn25", """SELECT o_orderkey, sha256('{"name":"' || o_orderstatus || '","notes":"' || o_orderpriority || '"}') AS content_key, true AS unchanged_since_save FROM orders""")
def fn25(spark, sf):
    o = R.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("name"), F.col("o_orderpriority").alias("notes"), F.col("o_orderdate").alias("updated_at"))
    saved = o.withColumn("updated_at", F.date_add("updated_at", 3))
    k = L.content_key("name", "notes")
    return o.select("o_orderkey", k.alias("content_key")).join(saved.select("o_orderkey", k.alias("_saved")), "o_orderkey").select("o_orderkey", "content_key", (F.col("content_key") == F.col("_saved")).alias("unchanged_since_save"))
