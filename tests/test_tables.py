import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tractloom import constants as C
from tractloom.functions import naming as nm
from tractloom.functions.ranking import exact_percentiles, two_stage_rank, with_buckets
from tractloom.operators import acquisition as aq, cohort as co, qc, rois, tensor as tn
from tractloom.functions.geometry import Grid
from tractloom.functions.numeric import lit
from tractloom.sources import files as fl, tables as tb
from tests.conftest import IDENTITY


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def test_rank_and_percentiles_with_hot_key(spark):
    rng = np.random.default_rng(1)
    vals = {0: np.round(rng.normal(0, 3, 900), 1), 1: rng.normal(5, 1, 7), 2: np.array([4.0])}
    d = spark.createDataFrame([(k, n, float(v)) for k, vs in vals.items() for n, v in enumerate(vs)], "k int, n int, v double")
    r = two_stage_rank(d, ["k"], F.floor("v"), [F.col("v"), F.col("n")], total="t")
    for k, vs in vals.items():
        got = [(x.rank, x.v) for x in r.where(F.col("k") == k).orderBy("rank").collect()]
        assert got == list(enumerate(sorted(vs.tolist())))
    p = {x.k: x for x in exact_percentiles(d, ["k"], F.col("v"), {"a": 0.0, "b": 0.37, "c": 0.99, "d": 1.0}).collect()}
    for k, vs in vals.items():
        assert [p[k].a, p[k].b, p[k].c, p[k].d] == pytest.approx(np.percentile(vs, [0, 37, 99, 100]).tolist())


def test_buckets_of_a_hot_key_are_even(spark):
    """One key holds 90 % of the rows, with values of a tiny scale."""
    d = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(0).alias("k"), (lit(4e-4) + F.rand(3) * lit(1.2e-3)).alias("v"))
    b = with_buckets(d, ["k"], F.col("v")).where("k = 0").groupBy("_bucket").count().toPandas()["count"]
    assert len(b) == 64 and b.max() <= 2 * b.sum() / 64


def test_cohort_headers():
    assert len(C.cohort_headers()) == 78 and len(set(C.cohort_headers())) == 78


def test_listing_discovery_and_dicom_magic(spark, tmp_path):
    for p in ("sub-01/ses-01/dwi/sub-01_dwi.nii.gz", "sub-01/ses-02/dwi/a.dcm", "sub-02/dwi/IM1", "other/x.nii.gz"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"\0" * 128 + b"DICM" if p.endswith("IM1") else b"x")
    files = fl.list_files(spark, str(tmp_path), magic=True)
    assert {r.path for r in files.where("magic").collect()} == {"sub-02/dwi/IM1"}
    d = {(r.subject, r.session) for r in fl.discover_subjects(files).collect()}
    assert d == {("sub-01", "ses-01"), ("sub-01", "ses-02"), ("sub-02", None)}
    assert fl.discover_subjects(files, exclude=["sub-01"]).count() == 1
    units = fl.discover_subjects(files).select(F.col("dir").alias("unit"))
    t = {r.unit: (r.input_type, r.input_path) for r in fl.detect_input(
        files.join(units, F.col("path").startswith(F.concat("unit", F.lit("/"))))).collect()}
    assert t == {"sub-01/ses-01": ("nifti", "sub-01/ses-01/dwi/sub-01_dwi.nii.gz"), "sub-01/ses-02": ("dicom", "sub-01/ses-02/dwi"), "sub-02": ("dicom", "sub-02/dwi")}


def test_manifest_file(spark, tmp_path):
    f = tmp_path / "m.json"
    f.write_text(json.dumps({"name": "S", "options": {"a": "1"}, "subjects": [
        {"id": "sub-1", "nifti": "/x"}, {"nifti": "/x"}, {"id": "2"}, {"id": 3, "nifti": "/x", "dicom": "/y"}]}, indent=1))
    got = [(r.position, r.id, r.error) for r in tb.manifest_subjects(tb.read_manifest(spark, str(f))).orderBy("position").collect()]
    assert got == [(0, "sub-1", None), (1, None, "missing id"), (2, "2", "neither nifti nor dicom"), (3, "3", "both nifti and dicom")]


def test_gradient_text_both_layouts(spark):
    t = spark.createDataFrame([("r", "0 1000 1000 \n", "0 1 0.5 0\n0 0 1 0 \n0 0 0 1\n"), ("c", "0\n1000\n", "1 2 3\n4 5 6\n")], "key string, bval_text string, bvec_text string")
    g = tb.parse_gradients(t)
    c = [(r.bval, r.bx, r.by, r.bz) for r in g.where("key = 'c'").orderBy("vol_idx").collect()]
    assert c == [(0, 1, 2, 3), (1000, 4, 5, 6)]
    v = spark.createDataFrame([("r", 3), ("c", 5), ("none", 1)], "key string, n_volumes int")
    assert {r.key: r.issue for r in tb.check_gradients(g, v).collect()} == {"r": "bval/bvec mismatch", "c": "volume/gradient mismatch", "none": None}


def issues(spark, bvals, vecs=None, voxel=(2.0, 2.0, 2.0), meta=None, n_bvecs=None):
    rng = np.random.default_rng(42)
    vecs = vecs if vecs is not None else [v / np.linalg.norm(v) for v in rng.normal(size=(len(bvals), 3))]
    g = spark.createDataFrame([(0, n, float(b), *map(float, v)) for n, (b, v) in enumerate(zip(bvals, vecs))], "subject_id long, vol_idx int, bval double, bx double, by double, bz double")
    f = aq.features(g).withColumns({"n_bvals": F.lit(len(bvals)), "n_bvecs": F.lit(n_bvecs or len(bvals)), **{c: lit(s) for c, s in zip(("vx", "vy", "vz"), voxel)},
                                    "meta": F.create_map(*[F.lit(x) for kv in (meta or {}).items() for x in kv]) if meta else F.lit(None).cast("map<string,string>")})
    return [(r.severity, r.message) for r in aq.quality_issues(f).orderBy("position").collect()]


def test_quality_rules(spark):
    good = [0] * 3 + [1000] * 30
    assert issues(spark, good) == []
    assert issues(spark, good, n_bvecs=5) == [("CRITICAL", "bval and bvec files disagree (33 and 5 entries)")]
    assert issues(spark, [0, 10, 50])[-1] == ("CRITICAL", "The series has no diffusion weighting")
    shells = issues(spark, [0] * 3 + [1000] * 5 + [2000] * 30)
    assert ("INFO", "Shells found: 2 at b = [1000, 2000]") in shells
    assert any(m.startswith("Shell at b=1000 has 5") for _, m in shells)
    gap = issues(spark, [0] + [1000] * 40 + [0, 0])
    assert gap == [("INFO", "Up to 41 volumes lie between two unweighted ones; an even spread helps motion correction")]
    vox = issues(spark, good, voxel=(1.0, 1.0, 2.6))
    assert [s for s, _ in vox] == ["WARNING", "CRITICAL"]
    te = issues(spark, good, meta={"EchoTime": "0.12", "PhaseEncodingDirection": "j", "TotalReadoutTime": "0.1"})
    assert te == [("WARNING", "Echo time (120 ms) is long, so signal decays")]


def test_shells_anchor_rule(spark):
    g = spark.createDataFrame([(0, n, float(b), 1.0, 0.0, 0.0) for n, b in enumerate([1000, 1040, 1050, 1060, 1110, 2000])] +
                              [(1, n, float(b), 1.0, 0.0, 0.0) for n, b in enumerate([0, 30, 1000])], "subject_id long, vol_idx int, bval double, bx double, by double, bz double")
    got = {(r.subject_id, r.bval): r.shell for r in aq.shells(g).collect()}
    assert [got[(0, b)] for b in (1000, 1040, 1050, 1060, 1110, 2000)] == [1000, 1000, 1000, 1060, 1060, 2000]
    assert all(got[(1, b)] == 0 for b in (0, 30, 1000))


def test_names(spark):
    assert one(spark, nm.sanitize_label(F.lit("--12 a//b"))) == "x12-a-b" and one(spark, nm.sanitize_label(F.lit("///"))) == "x"
    assert [one(spark, nm.age_years(F.lit(a))) for a in ("034Y", "018M", "002W", "005d", "7X", "")] == [34.0, 1.5, 0.038, 0.014, None, None]
    assert one(spark, nm.patient_hash(F.lit("P1"))) == hashlib.sha256(b"P1").hexdigest()[:8]
    assert one(spark, nm.subject_from_series(F.lit("proj7_mbep2d_diff_AP_TDI_Series0004"))) == "proj7_diff_AP_4"
    assert one(spark, nm.clean_stem(F.lit("/d/sub-1_dwi_preproc_nomc.nii.gz"))) == "sub-1"
    e = F.create_map(*[F.lit(x) for x in ("desc", "preproc", "zz", "1", "space", "orig", "sub", "001")])
    assert one(spark, nm.bids_filename(e, F.lit("dwi"), F.lit(".nii.gz"))) == "sub-001_space-orig_desc-preproc_zz-1_dwi.nii.gz"
    assert one(spark, nm.fixed(lit(0.125), 2)) == "0.12"


def test_config_hash_is_sorted_json(spark):
    cfg = {"out": "/o", "denoise_method": "mppca", "force": "True", "timeout_minutes": "9"}
    want = hashlib.sha256(json.dumps({k: v for k, v in cfg.items() if k not in ("force", "timeout_minutes")}, sort_keys=True).encode()).hexdigest()
    assert one(spark, co.config_hash(F.create_map(*[F.lit(x) for kv in cfg.items() for x in kv]))) == want


def test_participants_first_write_wins(spark):
    old = spark.createDataFrame([("sub-1", "30.0", "M")], "participant_id string, age string, sex string")
    new = spark.createDataFrame([("sub-1", 40.0, "F", 0), ("sub-2", None, "female", 2), ("sub-2", 5.0, "M", 3)], "participant_id string, age double, sex string, seq int")
    got = sorted(tuple(r) for r in co.upsert_participants(old, new).collect())
    assert got == [("sub-1", "30.0", "M"), ("sub-2", "n/a", "F")]


def test_cohort_row_without_session(spark, tmp_path):
    r = spark.createDataFrame([("a", None, "success", None, 1.25, None), ("b", None, "failed", "X", 2.0, "e")],
                              "subject_id string, session_id string, status string, error_category string, duration_seconds double, error string")
    m = spark.createDataFrame([(s, None, "left_fa_mean", 0.5) for s in "ab"], "subject_id string, session_id string, column string, value double")
    t = co.cohort_table(r, m)
    assert t.columns == C.cohort_headers()
    assert {x.subject_id: x.left_fa_mean for x in t.collect()} == {"a": 0.5, "b": None}
    co.write_cohort(t, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2


def test_dilation_is_clipped_and_zero_is_identity(spark, grid):
    m = spark.createDataFrame([(0, 0, 5, 9)], "subject_id long, i int, j int, k int")
    assert rois.dilate(m, 0, grid) is m
    assert rois.dilate(m, 1, grid).count() == 5
    assert rois.dilate(m, 2, Grid(IDENTITY, (20, 20, 20))).count() == 19  # 25 minus the x < 0 part


def test_subsample_is_stable_and_capped(spark):
    d = spark.range(100).selectExpr("0L subject_id", "id streamline_id")
    a = {r.streamline_id for r in qc.subsample(d, 10).collect()}
    b = {r.streamline_id for r in qc.subsample(d.repartition(5), 10).collect()}
    assert a == b and len(a) == 10 and qc.subsample(d, 500).count() == 100


def test_isotropic_tensor_has_no_anisotropy(spark):
    d = spark.createDataFrame([(0, 0, 0, 0, 1e-3, 1e-3, 1e-3, 0.0, 0.0, 0.0), (0, 1, 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (0, 2, 0, 0, 1e-3, 0.0, 0.0, 0.0, 0.0, 0.0)],
                              "subject_id long, i int, j int, k int, dxx double, dyy double, dzz double, dxy double, dxz double, dyz double")
    got = {r.i: (r.fa, r.md, r.ad) for r in tn.tensor_scalars(d).collect()}
    assert got[0] == pytest.approx((0.0, 1e-3, 1e-3), abs=1e-9) and got[1] == (0.0, 0.0, 0.0) and got[2][0] == pytest.approx(1.0)


def test_deep_and_late_dicom_series_are_found(spark):
    files = [("s", f"a/b/c/d/e/IM{n}.dcm", False) for n in range(2)] + [("s", f"late/a{n:02}.txt", False) for n in range(30)] + [("s", "late/z1", True), ("s", "late/.hidden", True)]
    d = spark.createDataFrame(files, "study string, path string, magic boolean")
    got = {(r.dir, r.n_files, r.depth) for r in fl.scan_study(d).collect()}
    assert got == {("a/b/c/d/e", 2, 5), ("late", 1, 1)}
    assert fl.large_series(fl.scan_study(d)).count() == 0 and {r.dir for r in fl.shallow_series(fl.scan_study(d)).collect()} == {"late"}


def test_two_inputs_under_one_label_are_an_error(spark):
    d = spark.createDataFrame([("a-very-long-series-name-1",), ("a-very-long-series-name-2",), ("short",), ("short",)], "raw string")
    got = nm.label_collisions(d.withColumn("label", nm.sanitize_label(F.col("raw"))), "label", "raw").collect()
    assert [(r.label, r.first_key, r.last_key) for r in got] == [("a-very-long-series-n", "a-very-long-series-name-1", "a-very-long-series-name-2")]


def test_description_and_import_records(spark):
    d = spark.range(1).select(co.dataset_description("1.0", nested_in_raw=True).alias("d"), co.participants_description().alias("p")).first()
    assert (d.d.DatasetType, d.d.GeneratedBy[0].Version, d.d.SourceDatasets[0].URL) == ("derivative", "1.0", "bids::") and d.p.age.Units == "years"
    row = spark.range(1).selectExpr("'sub-1' subject_id", "'n' name", "'d' description", "3L n_files", "true success", "'x' converter", "array(0.0D) b_values", "'AP' phase_encoding", "'diffusion_raw' series_type", "true suitable", "75.0D score")
    got = json.loads(co.import_records(row).first().record)
    assert got["input"]["n_dicom_files"] == 3 and got["quality_assessment"]["suitability_score"] == 75
