"""Queries of the file, manifest, sidecar and cohort operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tractloom.functions.numeric import lit, rnd
from tractloom.functions.stage import materialize
from tractloom.operators import acquisition as aq, cohort as co, metrics as me
from tractloom.plans import fixtures as fx
from tractloom.plans.fixtures import GRID, SQL_GRADIENTS, r6
from tractloom.plans.q_acquisition import DIRS
from tractloom.plans.q_metrics import ALL_METRICS, bundles, subjects
from tractloom.plans.registry import query
from tractloom.sources import files as fl, tables as tb


def _str(c):
    return F.col(c).cast("string")


# ---------------------------------------------------------------------------------- S1-S3

@query("S1_cohort_discovery", """WITH p AS (SELECT 'sub-' || o_custkey AS subject, CASE WHEN o_custkey % 4 > 0 AND (o_custkey % 4 <> 2 OR o_orderkey % 2 = 0) THEN 'ses-' || year(o_orderdate) END AS session FROM orders),
q AS (SELECT DISTINCT * FROM p WHERE (starts_with(subject, 'sub-1') OR subject LIKE 'sub-_7%') AND NOT starts_with(subject, 'sub-13')),
h AS (SELECT subject FROM q WHERE session IS NOT NULL)
SELECT subject, session, subject || coalesce('/' || session, '') AS dir FROM q WHERE session IS NOT NULL OR subject NOT IN (SELECT subject FROM h)""")
def s1(spark, sf):
    o = fx.table(spark, sf, "orders")
    k = F.col("o_custkey")
    ses = F.when((k % 4 > 0) & ((k % 4 != 2) | (F.col("o_orderkey") % 2 == 0)), F.concat(F.lit("/ses-"), F.year("o_orderdate").cast("string"))).otherwise("")
    p = o.select(F.concat(F.lit("sub-"), k.cast("string"), ses, F.lit("/dwi/f"), _str("o_orderkey"), F.lit(".nii.gz")).alias("path"))
    return fl.discover_subjects(p, include=["sub-1", "sub-.7"], exclude=["sub-13"])


# kind of file by order: see the CASE of the SQL twin
_UNIT_FILES = ("dwi/run%_dwi.nii.gz", "dwi/x%.nii.gz", "dwi/i%.dcm", "dwi/IM%", "a%_dwi.nii.gz", "b%.nii.gz", "c%.DCM", ".h%", "anat/d%.nii.gz")


@query("S2_input_type", """WITH f AS (SELECT 'sub-' || o_custkey AS unit, o_orderkey % 9 AS m, o_orderkey % 2 = 0 AS magic,
  replace(['dwi/run%_dwi.nii.gz', 'dwi/x%.nii.gz', 'dwi/i%.dcm', 'dwi/IM%', 'a%_dwi.nii.gz', 'b%.nii.gz', 'c%.DCM', '.h%', 'anat/d%.nii.gz'][o_orderkey % 9 + 1], '%', o_orderkey::VARCHAR) AS rel
  FROM orders),
c AS (SELECT unit, rel, magic, CASE WHEN m < 4 THEN 0 ELSE 1 END AS dr, CASE m WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 4 THEN 1 WHEN 5 THEN 2 WHEN 6 THEN 3 END AS kind,
   unit || CASE WHEN m < 4 THEN '/dwi' ELSE '' END AS dir, m FROM f WHERE m < 8),
k AS (SELECT unit, dr, kind, CASE WHEN kind < 3 THEN unit || '/' || rel ELSE dir END AS path FROM c WHERE kind IS NOT NULL
  UNION ALL SELECT unit, dr, 4, dir FROM c WHERE magic AND m <> 7),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY unit ORDER BY dr, kind, path) = 1)
SELECT u.unit, CASE WHEN kind <= 2 THEN 'nifti' WHEN kind >= 3 THEN 'dicom' ELSE 'none' END AS input_type, path AS input_path
FROM (SELECT DISTINCT unit FROM c) u LEFT JOIN b ON u.unit = b.unit""")
def s2(spark, sf):
    o = fx.table(spark, sf, "orders")
    unit = F.concat(F.lit("sub-"), _str("o_custkey"))
    rel = F.replace(F.array(*map(F.lit, _UNIT_FILES))[(F.col("o_orderkey") % 9).cast("int")], F.lit("%"), _str("o_orderkey"))
    return fl.detect_input(o.select(unit.alias("unit"), F.concat_ws("/", unit, rel).alias("path"), (F.col("o_orderkey") % 2 == 0).alias("magic")))


@query("S3_sidecar_pairing", """WITH b AS (SELECT o_orderkey AS k, 'sub-' || o_custkey || '/dwi/r' || o_orderkey AS s FROM orders),
i AS (SELECT k, s, s || CASE k % 3 WHEN 0 THEN '_dwi_preproc' WHEN 1 THEN '_preproc' ELSE '' END AS stem FROM b),
one AS (SELECT *, k % 2 = 0 AND k % 5 <> 1 AS sing, k % 7 = 0 OR k % 7 = 3 AS plu FROM i)
SELECT stem || CASE WHEN k % 2 = 0 THEN '.nii.gz' ELSE '.nii' END AS nifti,
  CASE WHEN sing THEN s || '.bval' WHEN plu THEN s || '.bvals' END AS bval, CASE WHEN sing THEN s || '.bvec' WHEN plu THEN s || '.bvecs' END AS bvec,
  CASE WHEN k % 4 = 0 THEN stem || '.json' END AS json FROM one""")
def s3(spark, sf):
    k = F.col("o_orderkey")
    base = F.concat(F.lit("sub-"), _str("o_custkey"), F.lit("/dwi/r"), k.cast("string"))
    stem = F.concat(base, F.when(k % 3 == 0, "_dwi_preproc").when(k % 3 == 1, "_preproc").otherwise(""))
    plural = (k % 7).isin(0, 3)
    paths = F.array_compact(F.array(
        F.concat(stem, F.when(k % 2 == 0, ".nii.gz").otherwise(".nii")), F.when(k % 4 == 0, F.concat(stem, F.lit(".json"))),
        F.when(k % 2 == 0, F.concat(base, F.lit(".bval"))), F.when((k % 2 == 0) & (k % 5 != 1), F.concat(base, F.lit(".bvec"))),
        F.when(plural, F.concat(base, F.lit(".bvals"))), F.when(plural, F.concat(base, F.lit(".bvecs")))))
    return fl.pair_sidecars(fx.table(spark, sf, "orders").select(F.explode(paths).alias("path")))


# ---------------------------------------------------------------------------------- S4-S6

@query("S4_study_manifest", """WITH c AS (SELECT c_custkey AS k, c_mktsegment AS g FROM customer),
s AS (SELECT g AS study, k, 0 AS position, CASE WHEN k % 9 = 1 THEN NULL ELSE 'sub-' || k END AS id, 'ses-1' AS session, CASE WHEN k % 3 <> 2 THEN '/d/' || k || '.nii.gz' END AS nifti, CASE WHEN k % 3 > 0 AND k % 2 = 0 THEN '/d/' || k END AS dicom, NULL AS series_uid FROM c
  UNION ALL SELECT g, k, 1, k::VARCHAR, NULL, NULL, '/x', '1.2.' || k FROM c)
SELECT study, CAST(position AS INT) AS position, id, session, nifti, dicom, series_uid, CASE WHEN id IS NULL THEN 'missing id' WHEN nifti IS NULL AND dicom IS NULL THEN 'neither nifti nor dicom'
  WHEN nifti IS NOT NULL AND dicom IS NOT NULL THEN 'both nifti and dicom' END AS error, 'mppca' AS denoise FROM s""")
def s4(spark, sf):
    k = F.col("c_custkey")
    q = lambda name, v: F.concat(F.lit(f'"{name}": "'), v, F.lit('"'))
    first = F.concat_ws(", ", F.when(k % 9 != 1, q("id", F.concat(F.lit("sub-"), k.cast("string")))), F.lit('"session": "ses-1"'),
                        F.when(k % 3 != 2, q("nifti", F.concat(F.lit("/d/"), k.cast("string"), F.lit(".nii.gz")))),
                        F.when((k % 3 > 0) & (k % 2 == 0), q("dicom", F.concat(F.lit("/d/"), k.cast("string")))))
    text = F.concat(F.lit('{"name": "'), F.col("c_mktsegment"), F.lit('", "options": {"denoise_method": "mppca"}, "subjects": [{'), first,
                    F.lit('}, {"id": '), k.cast("string"), F.lit(', "dicom": "/x", "series_uid": "1.2.'), k.cast("string"), F.lit('"}]}'))
    m = fx.table(spark, sf, "customer").select(F.from_json(text, tb.MANIFEST).alias("m")).select("m.*")
    return tb.manifest_subjects(m).select("study", "position", "id", "session", "nifti", "dicom", "series_uid", "error",
                                          F.col("study_options")["denoise_method"].alias("denoise"))


def _gradient_texts(spark, sf):
    k = F.col("o_orderkey")
    n = (F.lit(5) + k % 3).cast("int")
    idx = F.sequence(F.lit(0), n - 1)
    m = n - F.when(k % 5 == 0, 1).otherwise(0)
    axis = [lambda i: i + k % 4, lambda i: i - 1, lambda i: k % 3]
    vi = F.sequence(F.lit(0), m - 1)

    def line(a):
        return F.array_join(F.transform(vi, lambda i: a(i).cast("string")), " ")

    rows = F.array_join(F.array(*map(line, axis)), "\n")
    cols = F.array_join(F.transform(vi, lambda i: F.concat_ws("  ", *[a(i).cast("string") for a in axis])), "\n")
    return fx.table(spark, sf, "orders").select(
        k.alias("key"), F.concat(F.array_join(F.transform(idx, lambda i: (i * 500).cast("string")), " "), F.lit("\n")).alias("bval_text"),
        F.when(k % 2 == 0, rows).otherwise(cols).alias("bvec_text"), (n + F.when(k % 7 == 0, 1).otherwise(0)).alias("n_volumes"))


GTEXT = """WITH b AS (SELECT o_orderkey AS k, CAST(5 + o_orderkey % 3 AS INT) AS n, CAST(5 + o_orderkey % 3 - CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS INT) AS m FROM orders)"""


@query("S5_gradient_text", GTEXT + """, v AS (SELECT *, CAST(unnest(range(n)) AS INT) AS i FROM b)
SELECT k AS key, i AS vol_idx, i * 5e2 AS bval, CAST(CASE WHEN i < m THEN i + k % 4 END AS DOUBLE) AS bx, CAST(CASE WHEN i < m THEN i - 1 END AS DOUBLE) AS by,
  CAST(CASE WHEN i < m THEN k % 3 END AS DOUBLE) AS bz FROM v""")
def s5(spark, sf):
    return tb.parse_gradients(_gradient_texts(spark, sf))


@query("S5_gradient_check", GTEXT + """, c AS (SELECT k, n, m, n + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS v FROM b)
SELECT k AS key, CAST(v AS INT) AS n_volumes, n::BIGINT AS n_bvals, m::BIGINT AS n_bvecs, CASE WHEN n <> v THEN 'volume/gradient mismatch' WHEN m <> n THEN 'bval/bvec mismatch' END AS issue,
  n = v AND m = n AS valid FROM c""")
def s5b(spark, sf):
    t = _gradient_texts(spark, sf)
    return tb.check_gradients(tb.parse_gradients(t), t.select("key", "n_volumes"))


def _sidecars(spark, sf):
    e = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    strength = F.when(e % 3 == 0, '"MagneticFieldStrength": 3, ').when(e % 3 == 1, '"MagneticFieldStrength": "strong", ').otherwise("")
    return fx.table(spark, sf, "events").select("event_id", "user_id", F.concat(
        F.lit("{"), strength, F.lit('"Manufacturer": "V'), (e % 4).cast("string"), F.lit('", "EchoTime": 0.'), F.lpad((k * 2).cast("string"), 3, "0"), F.lit("}")).alias("json"))


@query("S6_sidecar_fields", f"""WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 3e0 END AS field_strength, {r6("CAST('0.' || lpad((k * 2)::VARCHAR, 3, '0') AS DOUBLE) * 1000")} AS echo_time_ms, 'V' || event_id % 4 AS manufacturer FROM e""")
def s6(spark, sf):
    return tb.parse_sidecars(_sidecars(spark, sf)).select("event_id", "field_strength", rnd(F.col("echo_time_ms")).alias("echo_time_ms"), "manufacturer")


@query("S6_acquisition_metadata", DIRS + f""",
side AS (SELECT user_id AS subject_id, min(event_id) AS e FROM events GROUP BY 1),
s AS (SELECT subject_id, e, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM side JOIN events ON event_id = e)
SELECT d.subject_id, CASE WHEN d.subject_id % 5 = 0 THEN 15e-1 WHEN e % 3 = 0 THEN 3e0 END AS "field_strength_T", {r6("CAST('0.' || lpad((k * 2)::VARCHAR, 3, '0') AS DOUBLE) * 1000")} AS echo_time_ms,
  string_agg(DISTINCT CAST(CAST(bval AS INT) AS VARCHAR), ',' ORDER BY CAST(CAST(bval AS INT) AS VARCHAR)) AS b_values, count(DISTINCT (ux, uy, uz)) FILTER (bval > 50) AS n_directions, count(*) AS n_volumes
FROM dir d JOIN s USING (subject_id) GROUP BY d.subject_id, e, k""")
def s6b(spark, sf):
    t = tb.parse_sidecars(_sidecars(spark, sf))
    first = t.groupBy(F.col("user_id").alias("subject_id")).agg(F.min_by(F.struct("field_strength", "echo_time_ms"), "event_id").alias("s")).select("subject_id", "s.*")
    first = first.withColumns({"override_field_strength": F.when(F.col("subject_id") % 5 == 0, lit(1.5)), "override_echo_time_ms": F.lit(None).cast("double")})
    m = aq.acquisition_metadata(fx.gradients(spark, sf), first)
    return m.withColumns({"b_values": F.array_join(F.array_sort(F.col("b_values").cast("array<string>")), ","), "echo_time_ms": rnd(F.col("echo_time_ms"))})


# ---------------------------------------------------------------------------------- S7-S9

@query("S7_study_scan", """WITH r AS (SELECT l_suppkey AS study, l_partkey % 6 AS d, l_orderkey AS o, l_linenumber AS n FROM lineitem),
f AS (SELECT study, ['', 'a', 'a/b', 'c/d/e/f/g', 'c/d/e', '.hid/x'][d + 1] AS dir, CASE WHEN (study + d) % 5 = 4 AND o % 3 = 0 THEN '.' ELSE '' END || 'IM' || o || '_' || n || ['.dcm', '.DCM', '', '.txt', '.dicom'][(study + d) % 5 + 1] AS fn,
   (study + d) % 5 AS e, o % 3 = 0 AND (study + d) % 5 = 2 AS magic FROM r WHERE d < 5),
k AS (SELECT *, e < 2 AS dcm, (e < 2 OR e = 4 OR magic) AND NOT starts_with(fn, '.') AS okf FROM f),
g AS (SELECT study, dir, count(*) FILTER (dcm) AS nd, count(*) FILTER (okf) AS nm, bool_or(okf) AS hit FROM k GROUP BY 1, 2),
s AS (SELECT study, dir, CASE WHEN nd > 0 THEN nd ELSE nm END AS n_files, CAST(CASE WHEN dir = '' THEN 0 ELSE len(string_split(dir, '/')) END AS INT) AS depth FROM g WHERE nd > 0 OR hit)
SELECT study, dir, n_files, depth, regexp_extract(dir, '[^/]*$') AS name FROM s
  WHERE NOT (dir = 'a/b' AND EXISTS (SELECT 1 FROM s t WHERE t.study = s.study AND t.dir = 'a'))
  AND NOT (dir = 'c/d/e/f/g' AND EXISTS (SELECT 1 FROM s t WHERE t.study = s.study AND t.dir = 'c/d/e'))""")
def s7(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    d = (F.col("l_partkey") % 6).cast("int")
    e = ((F.col("l_suppkey") + d) % 5).cast("int")
    folder = F.array(*map(F.lit, ("", "a/", "a/b/", "c/d/e/f/g/", "c/d/e/", ".hid/x/")))[d]
    dot = F.when((e == 4) & (F.col("l_orderkey") % 3 == 0), ".").otherwise("")
    p = F.concat(folder, dot, F.lit("IM"), _str("l_orderkey"), F.lit("_"), _str("l_linenumber"), F.array(*map(F.lit, (".dcm", ".DCM", "", ".txt", ".dicom")))[e])
    return fl.scan_study(li.select(F.col("l_suppkey").alias("study"), p.alias("path"), ((F.col("l_orderkey") % 3 == 0) & (e == 2)).alias("magic")))


SER = """ser AS (SELECT l_suppkey AS dir, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE 'u' || (l_partkey % (1 + l_suppkey % 3)) END AS uid, printf('%012d', l_orderkey) || '/' || l_linenumber || '/' || l_partkey || '/' || l_extendedprice AS path,
   l_returnflag AS description, l_linenumber AS number FROM lineitem),
gs AS (SELECT dir, uid, arg_min(description, path) AS description, arg_min(number, path) AS number, count(*) AS file_count FROM ser WHERE uid IS NOT NULL GROUP BY 1, 2)"""


def _series_headers(spark, sf):
    k = F.col("l_partkey")
    return fx.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("dir"), F.when(k % 7 != 0, F.concat(F.lit("u"), (k % (1 + F.col("l_suppkey") % 3)).cast("string"))).alias("uid"),
        F.concat_ws("/", F.format_string("%012d", "l_orderkey"), _str("l_linenumber"), k.cast("string"), _str("l_extendedprice")).alias("path"),
        F.col("l_returnflag").alias("description"), F.col("l_linenumber").alias("number"))


@query("S8_series_grouping", f"WITH {SER} SELECT * FROM gs")
def s8(spark, sf):
    return fl.group_series(_series_headers(spark, sf))


@query("S8_single_series", f"""WITH {SER}, r AS (SELECT s_suppkey AS dir, CASE s_suppkey % 4 WHEN 1 THEN 'u0' WHEN 2 THEN 'u9' END AS w FROM supplier),
j AS (SELECT r.dir, w, count(uid) AS n_series, min(uid) AS one, coalesce(bool_or(uid = w), false) AS has FROM r LEFT JOIN gs ON gs.dir = r.dir GROUP BY 1, 2),
k AS (SELECT *, CASE WHEN n_series = 0 THEN 'none' WHEN w IS NOT NULL AND has THEN 'ok' WHEN w IS NOT NULL THEN 'uid not found' WHEN n_series > 1 THEN 'ambiguous' ELSE 'ok' END AS status FROM j)
SELECT dir, n_series, status, CASE WHEN status = 'ok' THEN coalesce(w, one) END AS uid FROM k""")
def s8b(spark, sf):
    s = F.col("s_suppkey")
    req = fx.table(spark, sf, "supplier").select(s.alias("dir"), F.when(s % 4 == 1, "u0").when(s % 4 == 2, "u9").alias("series_uid"))
    return fl.choose_single_series(fl.group_series(_series_headers(spark, sf)), req)


@query("S9_file_integrity", """WITH m AS (SELECT 'doc/' || doc_id AS key, CASE WHEN doc_id % 7 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS sha256, doc_id FROM documents
  UNION ALL SELECT 'gone/' || doc_id, sha256(text), doc_id FROM documents WHERE doc_id % 11 = 0)
SELECT key, sha256, starts_with(key, 'doc/') AS present, starts_with(key, 'doc/') AND doc_id % 7 <> 0 AS valid, doc_id % 3 = 0 AS tier2 FROM m""")
def s9(spark, sf):
    d, i = fx.table(spark, sf, "documents"), F.col("doc_id")
    key = F.concat(F.lit("doc/"), i.cast("string"))
    tag = F.when(i % 3 == 0, "atlas").alias("tag")
    m = d.select(key.alias("key"), F.upper(F.sha2(F.when(i % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256)).alias("sha256"), tag).unionByName(
        d.where(i % 11 == 0).select(F.concat(F.lit("gone/"), i.cast("string")).alias("key"), F.sha2("text", 256).alias("sha256"), tag))
    v = fl.verify_files(d.select(key.alias("key"), F.col("text").cast("binary").alias("content")), m)
    return v.select("key", F.lower("sha256").alias("sha256"), "present", "valid", "tier2")


# ----------------------------------------------------------------------- reports S10-S12

def _metric_columns(spark, sf):
    m = materialize(me.metrics_long(bundles(spark, sf), GRID, fx.voxels(spark), subjects=subjects(spark, sf)))
    return co.side_columns(m, me.compare_sides(m))


def _flat_sql() -> str:
    names = {"streamline_count": "n_streamlines", "volume": "tract_volume_mm3", "mean_length": "mean_length_mm"}
    parts = []
    for col in co.report_columns():
        if col.endswith("_laterality_index"):
            q = col[: -len("_laterality_index")]
            e = f"max(CASE WHEN l + r = 0 THEN 0 ELSE (l - r) / (l + r) END) FILTER (quantity = '{q}')"
        else:
            side, rest = col.split("_", 1)
            q = next((k for k, v in names.items() if v == rest), None)
            if rest.endswith("_mean_point_weighted"):
                e = f"max(pm) FILTER (quantity = '{rest[:2]}' AND sd = '{side}')"
            elif rest.endswith("_std"):
                e = f"max(ps) FILTER (quantity = '{rest[:2]}' AND sd = '{side}')"
            else:
                q = q or (rest[:2] if rest.endswith("_mean") else rest)
                e = f"max({side[0]}) FILTER (quantity = '{q}')"
        parts.append(f"{r6(e, 9)} AS {col}")
    return ", ".join(parts)


@query("S10_flat_report", ALL_METRICS + f""", w AS (SELECT subject_id, quantity, l, r, NULL::DOUBLE AS pm, NULL::DOUBLE AS ps, NULL AS sd FROM lr
  UNION ALL SELECT subject_id, scalar, NULL, NULL, pool_mean, std, side FROM smy)
SELECT subject_id, {_flat_sql()} FROM w GROUP BY 1""")
def s10(spark, sf):
    f = co.flat_report(_metric_columns(spark, sf))
    return f.select("subject_id", *[rnd(F.col(c), 9).alias(c) for c in f.columns if c != "subject_id"])


@query("S10_nested_report", """SELECT c_custkey AS subject_id, '{"left":{"fa_mean":' || (c_custkey % 50) || '.5,"n_streamlines":' || c_custkey || '.0},"right":{"fa_mean":' || (c_custkey % 40) || '.25},"asymmetry":{"fa_laterality_index":0.5}}' AS metrics FROM customer""")
def s10b(spark, sf):
    k = F.col("c_custkey")
    rows = F.array(*[F.struct(F.lit(n).alias("column"), v.alias("value")) for n, v in (
        ("left_n_streamlines", k.cast("double")), ("left_fa_mean", k % 50 + lit(0.5)), ("right_fa_mean", k % 40 + lit(0.25)), ("fa_laterality_index", lit(0.5)))])
    c = fx.table(spark, sf, "customer").select(k.alias("subject_id"), F.inline(rows))
    return co.nested_report(c).select("subject_id", F.to_json("metrics").alias("metrics"))


RESULTS = """res AS (SELECT o_custkey AS subject_id, CAST(year(o_orderdate) AS VARCHAR) AS session_id, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failed' ELSE 'skipped' END AS status,
   CASE o_orderstatus WHEN 'O' THEN 'PIPELINE_FAILED' END AS error_category, o_totalprice / 1e3 AS duration_seconds, CASE o_orderstatus WHEN 'O' THEN 'step failed' END AS error, o_totalprice FROM orders),
lst AS (SELECT * FROM res QUALIFY row_number() OVER (PARTITION BY subject_id, session_id ORDER BY o_orderkey DESC) = 1)"""


def _results(spark, sf):
    st = F.col("o_orderstatus")
    r = fx.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("subject_id"), F.year("o_orderdate").cast("string").alias("session_id"), "o_orderkey",
        F.when(st == "F", "success").when(st == "O", "failed").otherwise("skipped").alias("status"),
        F.when(st == "O", "PIPELINE_FAILED").alias("error_category"), (F.col("o_totalprice") / lit(1000)).alias("duration_seconds"),
        F.when(st == "O", "step failed").alias("error"), "o_totalprice")
    return co.latest(r, "o_orderkey")


@query("S11_cohort_table", f"""WITH {RESULTS} SELECT subject_id, session_id, status, error_category, {r6('duration_seconds', 1)} AS duration_seconds, error,
  {", ".join(f"CASE WHEN status = 'success' AND (subject_id + {n}) % 5 > 0 THEN {r6(f'o_totalprice / {n + 1}e0', 3)} END AS {c}" for n, c in enumerate(co.report_columns()))} FROM lst""")
def s11(spark, sf):
    r = materialize(_results(spark, sf))
    cols = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(c).alias("column")) for n, c in enumerate(co.report_columns())])
    m = r.select("subject_id", "session_id", "o_totalprice", F.inline(cols)).where((F.col("subject_id") + F.col("n")) % 5 > 0)
    m = m.withColumn("value", rnd(F.col("o_totalprice") / (F.col("n") + 1).cast("double"), 3))
    return co.cohort_table(r, m)


@query("S12_batch_summary", f"""WITH {RESULTS} SELECT count(*) AS total, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed,
  count(*) FILTER (status = 'skipped') AS skipped, {r6(f"sum({r6('duration_seconds', 1)})", 4)} AS seconds FROM lst""")
def s12(spark, sf):
    return co.batch_summary(_results(spark, sf)).withColumn("seconds", rnd(F.col("seconds"), 4))


@query("S12_step_report", f"""WITH s AS (SELECT l_orderkey AS run, 'step' || l_linenumber AS step, sum(l_quantity) AS seconds, bool_and(l_returnflag <> 'R') AS ok FROM lineitem GROUP BY 1, 2)
SELECT run, {r6('sum(seconds)')} AS total_seconds, count(*) AS n_steps, coalesce(string_agg(step, ',' ORDER BY step) FILTER (NOT ok), '') AS failed_steps, bool_and(ok) AS success FROM s GROUP BY 1""")
def s12b(spark, sf):
    s = fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run"), F.concat(F.lit("step"), _str("l_linenumber")).alias("step"),
                                               F.col("l_quantity").alias("seconds"), (F.col("l_returnflag") != "R").alias("success"))
    return co.step_report(s).withColumn("total_seconds", rnd(F.col("total_seconds")))


# --------------------------------------------------------- participants, provenance, batch

@query("S13_participants_upsert", f"""WITH e AS (SELECT 'sub-' || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'x' END || c_custkey AS participant_id, 'n/a' AS age, 'F' AS sex FROM customer),
f AS (SELECT 'sub-' || o_custkey AS participant_id, arg_min(o_orderkey, o_orderkey) AS o FROM orders GROUP BY 1)
SELECT * FROM e UNION ALL SELECT participant_id, CASE WHEN o % 4 = 0 THEN 'n/a' ELSE printf('%.1f', {r6('o / 7e0', 1)}) END AS age, CASE o % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'O' ELSE 'n/a' END AS sex
FROM f WHERE participant_id NOT IN (SELECT participant_id FROM e)""")
def s13(spark, sf):
    site = F.when(F.col("c_custkey") % 2 == 0, "").otherwise("x")  # the other half is of another site
    e = fx.table(spark, sf, "customer").select(
        F.concat(F.lit("sub-"), site, _str("c_custkey")).alias("participant_id"), F.lit("n/a").alias("age"), F.lit("F").alias("sex"))
    o = F.col("o_orderkey")
    n = fx.table(spark, sf, "orders").select(F.concat(F.lit("sub-"), _str("o_custkey")).alias("participant_id"), F.when(o % 4 != 0, o / lit(7)).alias("age"),
                                             F.when(o % 3 == 0, "male").when(o % 3 == 1, "Other").otherwise("?").alias("sex"), o.alias("seq"))
    return co.upsert_participants(e, n)


@query("S14_sidecar_records", """SELECT 'sub-' || o_custkey || '/dwi/r' || o_orderkey || '.json' AS sidecar,
  '{"Sources":["bids::sub-' || o_custkey || '/raw' || o_orderkey || '"],"SpatialReference":"native","Description":"FA map"' || CASE WHEN o_orderkey % 3 = 0 THEN ',"CommandLine":"run ' || o_orderkey || '"' ELSE '' END
  || CASE WHEN o_orderkey % 2 = 0 THEN ',"ProcessingSteps":[{"Name":"fit","Software":"fit","Version":"1.' || o_orderkey % 9 || '"}]' ELSE '' END || '}' AS record FROM orders""")
def s14(spark, sf):
    k = F.col("o_orderkey")
    sub = F.concat(F.lit("sub-"), _str("o_custkey"))
    f = fx.table(spark, sf, "orders").select(
        F.concat(sub, F.lit("/dwi/r"), k.cast("string"), F.when(k % 5 == 0, ".nii").otherwise(".nii.gz")).alias("path"),
        F.array(F.concat(F.lit("bids::"), sub, F.lit("/raw"), k.cast("string"))).alias("sources"), F.lit("FA map").alias("description"),
        F.when(k % 3 == 0, F.concat(F.lit("run "), k.cast("string"))).otherwise("").alias("command_line"),
        F.when(k % 2 == 0, F.create_map(F.lit("fit"), F.concat(F.lit("1."), (k % 9).cast("string")))).alias("software"))
    return co.sidecar_records(f)


@query("F14_preflight", """WITH s AS (SELECT o_orderkey AS seq, CASE WHEN o_custkey % 37 = 0 THEN 'sub ' || o_custkey ELSE 'sub-' || o_custkey END AS subject_id, CAST(year(o_orderdate) AS VARCHAR) AS session_id,
   CASE WHEN o_orderkey % 4 = 0 THEN 'dicom' ELSE 'nifti' END AS t, 'd/' || o_orderkey AS p FROM orders),
d AS (SELECT *, min(seq) OVER (PARTITION BY subject_id, session_id) AS f FROM s)
SELECT 'INPUT' AS category, 'invalid subject id: ' || subject_id AS message, subject_id, seq FROM s WHERE contains(subject_id, ' ')
UNION ALL SELECT 'CONFIG', 'duplicate subject/session: ' || subject_id || '/' || session_id, subject_id, seq FROM d WHERE seq > f
UNION ALL SELECT 'INPUT', CASE t WHEN 'dicom' THEN 'DICOM directory' ELSE 'NIfTI file' END || ' not found: ' || p, subject_id, seq FROM s WHERE seq % 9 = 0 OR (t = 'dicom' AND seq % 5 = 0)
UNION ALL SELECT 'INPUT', 'bval file not found: ' || p || '.bval', subject_id, seq FROM s WHERE t = 'nifti' AND seq % 3 = 0 AND seq % 7 = 0
UNION ALL SELECT 'INPUT', 'bvec file not found: ' || p || '.bvec', subject_id, seq FROM s WHERE t = 'nifti' AND seq % 3 = 0 AND seq % 11 = 0""")
def f14(spark, sf):
    k = F.col("o_orderkey")
    o = fx.table(spark, sf, "orders")
    p = F.concat(F.lit("d/"), k.cast("string"))
    s = o.select(k.alias("seq"), F.concat(F.when(F.col("o_custkey") % 37 == 0, "sub ").otherwise("sub-"), _str("o_custkey")).alias("subject_id"),
                 F.year("o_orderdate").cast("string").alias("session_id"), F.when(k % 4 == 0, "dicom").otherwise("nifti").alias("input_type"), p.alias("input_path"),
                 F.when(k % 3 == 0, F.concat(p, F.lit(".bval"))).alias("bval_path"), F.when(k % 3 == 0, F.concat(p, F.lit(".bvec"))).alias("bvec_path"))
    there = F.array_compact(F.array(
        F.when(k % 9 != 0, F.struct(p.alias("path"), ((k % 4 == 0) & (k % 5 != 0)).alias("is_dir"))),
        F.when(k % 7 != 0, F.struct(F.concat(p, F.lit(".bval")).alias("path"), F.lit(False).alias("is_dir"))),
        F.when(k % 11 != 0, F.struct(F.concat(p, F.lit(".bvec")).alias("path"), F.lit(False).alias("is_dir")))))
    return co.preflight(s, o.select(F.inline(there)))


@query("J14_resume", f"""WITH {RESULTS}, h AS (SELECT *, sha256('{{"denoise_method": "' || CASE WHEN subject_id % 3 = 0 THEN 'mppca' ELSE 'nl"m' END || '", "out": "/o/' || session_id || '"}}') AS hash FROM lst),
q AS (SELECT *, replace(hash, 'x', 'x') AS want, sha256('{{"denoise_method": "' || CASE WHEN subject_id % 3 = 0 THEN 'mppca' ELSE 'nl\\"m' END || '", "out": "/o/' || session_id || '"}}') AS h2 FROM h)
SELECT subject_id, session_id, h2 AS config_hash, CASE WHEN status = 'success' AND subject_id % 5 > 0 AND subject_id % 7 > 0 THEN 'skipped' ELSE 'run' END AS action FROM q""")
def j14(spark, sf):
    r = _results(spark, sf)
    s = F.col("subject_id")
    cfg = F.create_map(F.lit("out"), F.concat(F.lit("/o/"), "session_id"), F.lit("force"), F.lit("False"), F.lit("denoise_method"),
                       F.when(s % 3 == 0, "mppca").otherwise('nl"m'), F.lit("timeout_minutes"), F.lit("120"))
    want = r.withColumn("config_hash", co.config_hash(cfg))
    done = want.where("status = 'success'").withColumn("config_hash", F.when(s % 5 == 0, "old").otherwise(F.col("config_hash")))
    return co.resume(want, done, force=s % 7 == 0)


@query("J18_extraction_attach", f"""SELECT c_custkey AS subject_id, {r6('c_acctbal')} AS value,
  CASE WHEN c_custkey % 3 = 0 THEN 'bidirectional' WHEN c_custkey % 4 = 0 THEN 'passthrough' END AS method, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 10 / 1e1 END AS artifact_index,
  CASE WHEN c_custkey % 3 = 0 THEN true WHEN c_custkey % 4 = 0 THEN false END AS artifact_index_available,
  CASE WHEN c_custkey % 3 > 0 AND c_custkey % 4 = 0 THEN 'defined only for bidirectional extraction' END AS artifact_index_reason FROM customer""")
def j18(spark, sf):
    c, k = fx.table(spark, sf, "customer"), F.col("c_custkey")
    m = c.select(k.alias("subject_id"), rnd(F.col("c_acctbal")).alias("value"))
    near = c.where(k % 3 == 0).select(k.alias("subject_id"), F.lit("bidirectional").alias("method"), (k % 10 / lit(10)).alias("artifact_index"))
    beside = c.where(k % 4 == 0).select(k.alias("subject_id"), F.lit("passthrough").alias("method"), F.lit(None).cast("double").alias("artifact_index"))
    return co.attach_extraction(m, near, beside)
