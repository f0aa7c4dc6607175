"""Queries whose rows go through files: folders checked and scanned, reports written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tractloom.functions.numeric import lit, rnd
from tractloom.functions.stage import materialize, stage_dir
from tractloom.operators import cohort as co, compare as cp, extract as ex, metrics as me, reports as rp, series as se
from tractloom.operators.geometry import voxelise
from tractloom.plans import fixtures as fx
from tractloom.plans.fixtures import GRID, r6
from tractloom.plans.q_compare import CAND, CAND_SQL, REF, REF_SQL, SETS
from tractloom.plans.q_metrics import ALL_METRICS, bundles, subjects
from tractloom.plans.q_extract import ENDS, SQL_LENS, SQL_VOX
from tractloom.plans.q_series import PART, _series
from tractloom.plans.registry import query
from tractloom.sources import files as fl
from tractloom.sources.stores import write_records

#: Time that the reports of the queries carry.
AT = "2024-05-06 07:08:09"


def _written(records, spark) -> str:
    """Folder into which the records were written."""
    path = f"{stage_dir(spark)}/files-{uuid.uuid4().hex}"
    write_records(records, path)
    return path


# ----------------------------------------------------------------------------- S9, S7

@query("S9_folder_integrity", """WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT doc_id, 'g' || doc_id % 7 || '/d ' || doc_id || '.txt' AS key, CASE WHEN doc_id % 5 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS sha256, text FROM d
  UNION ALL SELECT doc_id, 'gone/' || doc_id, sha256(text), NULL FROM d WHERE doc_id % 11 = 0)
SELECT key, sha256, text IS NOT NULL AS present, text IS NOT NULL AND doc_id % 5 <> 0 AS valid, doc_id % 3 = 0 AS tier2, CAST(strlen(text) AS BIGINT) AS size FROM m""")
def s9_folder(spark, sf):
    i = F.col("doc_id")
    d = fx.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    key = F.concat(F.lit("g"), (i % 7).cast("string"), F.lit("/d "), i.cast("string"), F.lit(".txt"))
    root = _written(d.select(key.alias("name"), F.col("text").alias("content")), spark)
    tag = F.when(i % 3 == 0, "atlas").alias("tag")
    m = d.select(key.alias("key"), F.sha2(F.when(i % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("sha256"), tag).unionByName(
        d.where(i % 11 == 0).select(F.concat(F.lit("gone/"), i.cast("string")).alias("key"), F.sha2("text", 256).alias("sha256"), tag))
    return fl.verify_folder(spark, root, m).select("key", "sha256", "present", "valid", "tier2", "size")


_FOLDERS, _ENDS = ("", "a/", "a/b/", "c/d/", ".hid/"), (".dcm", "", ".ima", ".txt", ".nii")


@query("S7_folder_scan", """WITH f AS (SELECT doc_id, 's' || doc_id % 23 AS study, ['', 'a', 'a/b', 'c/d', '.hid'][doc_id % 5 + 1] AS dir, (doc_id // 5) % 5 AS e, (doc_id // 25) % 3 > 0 AS magic FROM documents),
g AS (SELECT study, dir, count(*) FILTER (e = 0) AS nd, count(*) FILTER (e = 0 OR (magic AND e < 4)) AS nm FROM f WHERE dir <> '.hid' GROUP BY 1, 2),
s AS (SELECT study, dir, CASE WHEN nd > 0 THEN nd ELSE nm END AS n_files, CAST(CASE WHEN dir = '' THEN 0 ELSE len(string_split(dir, '/')) END AS INT) AS depth FROM g WHERE nm > 0)
SELECT study, dir, n_files, depth, regexp_extract(dir, '[^/]*$') AS name FROM s WHERE NOT (dir = 'a/b' AND EXISTS (SELECT 1 FROM s t WHERE t.study = s.study AND t.dir = 'a'))""")
def s7_folder(spark, sf):
    i = F.col("doc_id")
    pick = lambda names, at: F.array(*map(F.lit, names))[at.cast("int")]
    study = F.concat(F.lit("s"), (i % 23).cast("string"))
    name = F.concat(study, F.lit("/"), pick(_FOLDERS, i % 5), F.lit("IM"), i.cast("string"), pick(_ENDS, F.expr("(doc_id div 5) % 5")))
    head = F.when(F.expr("(doc_id div 25) % 3 > 0"), F.lit("\0" * 128 + "DICM")).otherwise(F.lit(""))
    root = _written(fx.table(spark, sf, "documents").select(name.alias("name"), F.concat(head, F.lit("x"), F.coalesce("text", F.lit(""))).alias("content")), spark)
    files = fl.list_files(spark, root, magic=True)
    inside = F.regexp_replace("path", "^[^/]*/", "")
    return fl.scan_study(files.select(F.substring_index("path", "/", 1).alias("study"), inside.alias("path"), "magic"))


# -------------------------------------------------------------------------- S10, S14

@query("S10_validation_report", SETS + f""",
g AS (SELECT subject_id, count(*) FILTER (c AND r) AS intersection_volume, count(*) FILTER (c) AS cv, count(*) FILTER (r) AS rv FROM v GROUP BY 1),
b AS (SELECT DISTINCT subject_id, (streamline_id // 8) % 6 AS n, {CAND_SQL} AS c, {REF_SQL} AS r FROM pts),
p AS (SELECT subject_id, 'sub-' || subject_id || '/bundle-' || n || '.trk' AS path, c, r FROM b WHERE c OR r)
SELECT subject_id, '{AT}' AS timestamp, string_agg(path, ' ' ORDER BY path) FILTER (c) AS candidates, string_agg(path, ' ' ORDER BY path) FILTER (r) AS refs,
  CASE WHEN subject_id % 2 = 0 THEN 'sub-' || subject_id || '/t1.nii.gz' END AS anatomy, any_value(intersection_volume) AS intersection_volume,
  {r6('2e0 * any_value(intersection_volume) / (any_value(cv) + any_value(rv))')} AS dice, {r6('any_value(intersection_volume) / any_value(rv)::DOUBLE')} AS coverage
FROM g JOIN p USING (subject_id) GROUP BY 1""")
def s10_validation(spark, sf):
    p = materialize(fx.points(spark, sf))
    v = voxelise(p, GRID)
    overlap = cp.bundle_overlap(v.where(CAND), v.where(REF), p.select("subject_id").distinct())
    sub = F.concat(F.lit("sub-"), F.col("subject_id").cast("string"))
    files = p.select("subject_id", F.expr("(streamline_id div 8) % 6").alias("n"), F.expr(CAND).alias("c"), F.expr(REF).alias("r")).distinct()
    roles = F.array_compact(F.array(F.when(F.col("c"), "candidate"), F.when(F.col("r"), "reference")))
    files = files.select("subject_id", F.explode(roles).alias("role"), F.concat(sub, F.lit("/bundle-"), F.col("n").cast("string"), F.lit(".trk")).alias("path"))
    anatomy = overlap.where("subject_id % 2 = 0").select("subject_id", F.concat(sub, F.lit("/t1.nii.gz")).alias("path"))
    root = _written(rp.validation_records(overlap.withColumn("subject", F.col("subject_id")), files, anatomy, AT), spark)
    got = rp.read_records(spark, root, """timestamp string, candidate_tractograms array<string>, reference_tractograms array<string>, reference_anatomy string,
        metrics struct<subject: long, intersection_volume: long, dice: double, coverage: double>""").select("record.*").select("*", "metrics.*")
    return got.select(F.col("subject").alias("subject_id"), "timestamp", F.array_join("candidate_tractograms", " ").alias("candidates"),
                      F.array_join("reference_tractograms", " ").alias("refs"), F.col("reference_anatomy").alias("anatomy"), "intersection_volume",
                      rnd(F.col("dice")).alias("dice"), rnd(F.col("coverage")).alias("coverage"))


@query("S10_extraction_report", f"""WITH {SQL_VOX}{SQL_LENS}{ENDS},
f AS (SELECT subject_id, length BETWEEN 6e1 AND 2e2 AS ok, s || e IN ('bl', 'lb') AS l, s || e IN ('br', 'rb') AS r FROM ends JOIN lens USING (subject_id, streamline_id)),
g AS (SELECT subject_id, count(*) AS total_input, count(*) FILTER (ok AND l) AS lc, count(*) FILTER (ok AND r) AS rc FROM f GROUP BY 1)
SELECT subject_id, '{AT}' AS processing_date, total_input, lc + rc AS total_count, {r6('(lc + rc) * 100 / total_input::DOUBLE')} AS extraction_rate,
  CASE WHEN rc = 0 THEN 'inf'::DOUBLE ELSE {r6('lc / rc::DOUBLE')} END AS left_right_ratio, CASE WHEN lc > 0 THEN 'sub-' || subject_id || '/cst_left.trk' END AS cst_left,
  CASE WHEN rc > 0 THEN 'sub-' || subject_id || '/cst_right.trk' END AS cst_right, CASE WHEN lc + rc > 0 THEN 'sub-' || subject_id || '/cst_combined.trk' END AS cst_combined FROM g""")
def s10_extraction(spark, sf):
    flags = materialize(ex.extract_endpoints(fx.points(spark, sf), GRID, fx.roi_voxels(spark), fx.BAND))
    stats = ex.endpoint_stats(flags)
    side = ex.endpoint_bundles(flags).select("subject_id", F.explode(F.array(F.concat(F.lit("cst_"), "side"), F.lit("cst_combined"))).alias("kind")).distinct()
    outputs = side.withColumn("path", F.concat(F.lit("sub-"), F.col("subject_id").cast("string"), F.lit("/"), "kind", F.lit(".trk")))
    root = _written(rp.extraction_records(stats, outputs, {"tractloom": "1"}, AT), spark)
    got = rp.read_records(spark, root, """processing_date string, subject_id long, statistics struct<total_input: long, total_count: long, extraction_rate: double,
        left_right_ratio: double>, output_files struct<cst_left: string, cst_right: string, cst_combined: string>""").select("record.*")
    d = got.select("subject_id", "processing_date", "statistics.*", "output_files.*")
    return d.withColumns({c: rnd(F.col(c)) for c in ("extraction_rate", "left_right_ratio")})


@query("S10_bilateral_record", ALL_METRICS + f""",
q AS (SELECT subject_id, max(l) FILTER (quantity = 'streamline_count') AS ln, max(r) FILTER (quantity = 'streamline_count') AS rn,
  max(l) FILTER (quantity = 'fa') AS lf, max(r) FILTER (quantity = 'fa') AS rf FROM lr GROUP BY 1)
SELECT subject_id, side, {r6("CASE side WHEN 'left' THEN ln ELSE rn END")} AS n_streamlines, {r6("CASE side WHEN 'left' THEN lf ELSE rf END", 9)} AS fa_mean,
  {r6('CASE WHEN lf + rf = 0 THEN 0 ELSE (lf - rf) / (lf + rf) END', 9)} AS fa_laterality_index, CAST(place AS INT) AS place, {r6('value', 9)} AS fa, 6e1 AS min_length
FROM prf JOIN q USING (subject_id) WHERE scalar = 'fa'""")
def s10_bilateral(spark, sf):
    b, people, maps = bundles(spark, sf), subjects(spark, sf), fx.voxels(spark)
    profile = materialize(me.tract_profile(b, GRID, maps, subjects=people))
    m = materialize(me.metrics_long(b, GRID, maps, subjects=people, profile=profile))
    columns = co.side_columns(m, me.compare_sides(m))
    limits = F.struct(lit(fx.BAND[0]).alias("min_length"), lit(fx.BAND[1]).alias("max_length")).alias("qc_thresholds")
    meta = people.select("subject_id", F.create_map(F.lit("grid"), F.lit("x".join(map(str, GRID.shape)))).alias("acquisition"),
                         F.create_map(F.lit("extraction"), F.lit("passthrough")).alias("processing"), limits)
    root = _written(rp.metrics_records(columns, profile, meta, "1", AT), spark)
    side = "map<string, double>"
    got = rp.read_records(spark, root, f"""subject_id long, qc_thresholds struct<min_length: double>, metrics struct<left: {side}, right: {side}, asymmetry: {side},
        profiles: struct<left: map<string, array<double>>, right: map<string, array<double>>>>""").select("record.*")
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"metrics.{s}").alias("m"), F.col(f"metrics.profiles.{s}")["fa"].alias("fa")) for s in ("left", "right")])
    d = got.select("subject_id", "qc_thresholds.min_length", F.col("metrics.asymmetry")["fa_laterality_index"].alias("li"), F.inline(sides))
    return d.select("subject_id", "side", rnd(F.col("m")["n_streamlines"]).alias("n_streamlines"), rnd(F.col("m")["fa_mean"], 9).alias("fa_mean"),
                    rnd(F.col("li"), 9).alias("fa_laterality_index"), F.posexplode("fa").alias("place", "fa"), "min_length").withColumn("fa", rnd(F.col("fa"), 9))


@query("S14_import_reports", f"""WITH {PART} SELECT series AS subject_id, name AS series_name, CAST(n_files AS BIGINT) AS n_dicom_files, series % 6 > 0 AS success, CASE WHEN series % 6 > 0 THEN 'native' END AS converter,
  CAST(nb AS INT) AS n_b_values, pe AS phase_encoding, series_type, score > 0 AS suitable, score FROM sco""")
def s14_import(spark, sf):
    ok = F.col("series") % 6 > 0
    s = materialize(se.assess(_series(spark, sf))).withColumns({"subject_id": F.col("series"), "success": ok, "converter": F.when(ok, "native")})
    root = _written(rp.import_report_records(s), spark)
    got = rp.read_records(spark, root, """processing_info struct<subject_id: long>, input struct<series_name: string, n_dicom_files: long>, conversion struct<success: boolean, converter: string>,
        data_properties struct<b_values: array<double>, phase_encoding: string>, quality_assessment struct<series_type: string, suitable_for_tractography: boolean, suitability_score: double>""")
    d = got.select("record.*").select("processing_info.*", "input.*", "conversion.*", "data_properties.*", "quality_assessment.*")
    return d.withColumn("n_b_values", F.size("b_values")).withColumnsRenamed({"suitable_for_tractography": "suitable", "suitability_score": "score"}).drop("b_values")
