import json
import os

from tractloom.operators import reports as rp
from tractloom.plans import q_reports
from tractloom.sources import stores as st

AT = "2024-01-02 03:04:05"


def _content(df):
    return {r.subject_id: (r["name"], json.loads(r.content)) for r in df.collect()}


def test_validation_records(spark):
    metrics = spark.createDataFrame([("a", 0.5, 3), ("b", float("nan"), None)], "subject_id string, dice double, n int")
    files = spark.createDataFrame([("a", "candidate", "2.trk"), ("a", "candidate", "1.trk"), ("a", "candidate", "1.trk"), ("a", "reference", "r.trk"), ("zz", "candidate", "x.trk")],
                                  "subject_id string, role string, path string")
    image = spark.createDataFrame([("a", "t1b.nii"), ("a", "t1a.nii")], "subject_id string, path string")
    got = _content(rp.validation_records(metrics, files, image, AT))
    assert got["a"] == ("validation/a_validation.json", {
        "timestamp": AT, "candidate_tractograms": ["1.trk", "2.trk"], "reference_tractograms": ["r.trk"], "reference_anatomy": "t1a.nii", "metrics": {"dice": 0.5, "n": 3}})
    assert got["b"][1] == {"timestamp": AT, "candidate_tractograms": [], "reference_tractograms": [], "reference_anatomy": None, "metrics": {"dice": "NaN", "n": None}}
    assert set(got) == {"a", "b"}
    assert _content(rp.validation_records(metrics, files))["a"][1]["reference_anatomy"] is None


def test_extraction_records(spark):
    stats = spark.createDataFrame([(1, 10, 4), (2, 7, 0)], "subject_id long, total_input long, total_count long")
    out = spark.createDataFrame([(1, "cst_left", "l.trk"), (1, "cst_combined", "c.trk"), (1, "other", "o")], "subject_id long, kind string, path string")
    got = _content(rp.extraction_records(stats, out, {"tool": "2"}, AT))
    assert got[1] == ("logs/1_cst_extraction_report.json", {
        "processing_date": AT, "subject_id": 1, "provenance": {"tool": "2"}, "statistics": {"total_input": 10, "total_count": 4},
        "output_files": {"cst_left": "l.trk", "cst_right": None, "cst_combined": "c.trk"}})
    assert got[2][1]["output_files"] == {"cst_left": None, "cst_right": None, "cst_combined": None}


def test_metrics_records_written_and_read_back(spark, tmp_path):
    columns = spark.createDataFrame([(1, "left_fa_mean", 0.5), (1, "right_fa_mean", 0.25), (1, "fa_laterality_index", 1 / 3), (2, "left_fa_mean", 0.75)],
                                    "subject_id long, column string, value double")
    profile = spark.createDataFrame([(1, s, p, "fa", p / 4) for s in ("left", "right") for p in (2, 0, 1)], "subject_id long, side string, place int, scalar string, value double")
    meta = spark.sql("select 1L subject_id, map('protocol', 'x') acquisition, map('tracking', 'y') processing, named_struct('min_length', 60.0D) qc_thresholds")
    records = rp.metrics_records(columns, profile, meta, "1", AT)
    one = _content(records)[1][1]
    assert one["metrics"] == {"left": {"fa_mean": 0.5}, "right": {"fa_mean": 0.25}, "asymmetry": {"fa_laterality_index": 1 / 3},
                              "profiles": {"left": {"fa": [0.0, 0.25, 0.5]}, "right": {"fa": [0.0, 0.25, 0.5]}}}
    assert (one["acquisition"], one["qc_thresholds"], one["version"]) == ({"protocol": "x"}, {"min_length": 60.0}, "1")
    st.write_records(records, f"{tmp_path}/r")
    assert sorted(os.listdir(tmp_path / "r" / "metrics")) == ["1_bilateral_metrics.json", "2_bilateral_metrics.json"]
    (tmp_path / "r" / "broken.json").write_text("{")
    got = [r.record for r in rp.read_records(spark, f"{tmp_path}/r", "subject_id long, metrics struct<left: map<string, double>>").collect()]
    assert {r.subject_id: r.metrics.left["fa_mean"] for r in got if r and r.subject_id} == {1: 0.5, 2: 0.75} and len(got) == 3


def test_bilateral_record_makes_the_profile_once(spark, monkeypatch):
    calls, plain = [], q_reports.me.tract_profile
    monkeypatch.setattr(q_reports.me, "tract_profile", lambda *a, **k: calls.append(1) or plain(*a, **k))
    assert q_reports.s10_bilateral(spark, "/root/testdata/sf0.001").count() == 9 * 2 * 20
    assert len(calls) == 1
