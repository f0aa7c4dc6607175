from pyspark.sql import functions as F

from tractloom.sources import files as fl


def test_series_named_by_uid_or_other_suffixes(spark, tmp_path):
    uid = "1.2.840.113619.2.5"
    names = [f"sub-01/dwi/{uid}.{n}" for n in range(12)] + [f"sub-02/dwi/a b {n}.ima" for n in range(3)] + ["sub-03/dwi/x.001", "sub-03/dwi/notes.txt", "sub-03/dwi/short.9", "sub-04/dwi/IM1"]
    for p in [*names, "sub-05/dwi/raw.nii", "sub-05/dwi/e.dcm"]:
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x" * 200 if p.endswith((".txt", ".nii")) else b"DICM" if p.endswith("short.9") else b"\0" * 128 + b"DICM" + b"x" * 5000)
    files = fl.list_files(spark, str(tmp_path), magic=True)
    assert files.count() == len(names) + 2
    assert {r.path for r in files.where("magic").collect()} == set(names) - {"sub-03/dwi/notes.txt", "sub-03/dwi/short.9"}
    series = fl.scan_study(files.withColumn("study", F.lit("s")))
    assert {(r.dir, r.n_files) for r in series.collect()} == {("sub-01/dwi", 12), ("sub-02/dwi", 3), ("sub-03/dwi", 1), ("sub-04/dwi", 1), ("sub-05/dwi", 1)}
    units = fl.detect_input(files.withColumn("unit", F.substring_index("path", "/", 1)))
    assert {r.unit: r.input_type for r in units.collect()} == {"sub-01": "dicom", "sub-02": "dicom", "sub-03": "dicom", "sub-04": "dicom", "sub-05": "dicom"}
