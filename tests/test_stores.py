import hashlib
import os

import pytest
from pyspark.sql import functions as F

from tractloom.sources import files as fl, stores as st


def _left(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, fs in os.walk(folder) for f in fs)


def test_records_are_written_whole_and_read_back(spark, tmp_path):
    rows = [("sub-01/a b.json", '{"x": "é"}'), ("sub-02/c%20d.json", None), ("e+f (1).json", "")]
    df = spark.createDataFrame(rows, "name string, content string").withColumn("other", F.lit(1)).repartition(3)
    st.write_records(df, f"{tmp_path}/out")
    assert _left(tmp_path) == sorted(f"out/{n}" for n, _ in rows)
    want = spark.createDataFrame([(n, hashlib.sha256((c or "").encode()).hexdigest()) for n, c in [*rows, ("gone", "")]], "key string, sha256 string").withColumn("tag", F.lit(None))
    d = {r.key: (r.valid, r.size) for r in fl.verify_folder(spark, f"{tmp_path}/out", want).collect()}
    assert d == {"gone": (False, None), **{n: (True, len((c or "").encode())) for n, c in rows}}
    assert {r.key for r in st.file_digests(spark, f"{tmp_path}/out", "*.json").collect()} == {rows[0][0]}
    with pytest.raises(Exception, match="FileExistsError"):
        st.write_records(df, f"{tmp_path}/out")
    assert len(_left(tmp_path)) == 3
    st.write_records(df.limit(0), f"{tmp_path}/out", overwrite=True)
    assert _left(tmp_path) == [] and os.path.isdir(tmp_path / "out")


def test_failing_task_leaves_no_file(spark, tmp_path):
    good = spark.range(20).selectExpr("concat('r', id) name", "'x' content")
    bad = good.withColumn("content", F.when(F.col("name") == "r17", F.raise_error(F.lit("lost"))).otherwise(F.col("content")))
    for df in (bad.repartition(4), good.withColumn("name", F.lit("twice")), *(good.limit(1).withColumn("name", F.lit(n)) for n in ("../up", "/abs", "a//b", ""))):
        with pytest.raises(Exception):
            st.write_records(df, f"{tmp_path}/out")
    with pytest.raises(Exception):
        st.write_records(good.limit(1).withColumn("name", F.lit(None).cast("string")), f"{tmp_path}/out")
    assert _left(tmp_path) == [] and not os.path.exists(tmp_path / "out")


def test_large_file_in_chunks(spark, tmp_path):
    """A sparse file above 2 GB, which one row can't hold."""
    size = (2 << 30) + 77
    (tmp_path / "d").mkdir()
    with open(tmp_path / "d" / "large.bin", "wb") as f:
        f.seek(size - 1)
        f.write(b"z")
    h = hashlib.sha256()
    for n in [1 << 24] * ((size - 1) >> 24) + [(size - 1) & ((1 << 24) - 1)]:
        h.update(bytes(n))
    h.update(b"z")
    want = spark.createDataFrame([("large.bin", h.hexdigest().upper(), "t"), ("none.bin", "00", None)], "key string, sha256 string, tag string")
    got = {r.key: r for r in fl.verify_folder(spark, f"{tmp_path}/d", want).collect()}
    assert got["large.bin"].valid and got["large.bin"].size == size and got["large.bin"].tier2
    assert not got["none.bin"].present and not got["none.bin"].valid and got["none.bin"].size is None
    assert st.Stores().head(f"file:{tmp_path}/d/large.bin", 132) == bytes(132)


def test_paths_of_stores():
    s = st.Stores()
    assert s.at("/a b/c")[1] == s.at("file:/a b/c")[1] == s.at("file:///a b/c")[1] == "/a b/c" and len(s.opened) == 1
    s.opened["s3", "bucket"] = (s.at("/x")[0], "bucket")
    assert s.at("s3a://bucket/k/v%20.dcm")[1] == "bucket/k/v%20.dcm" == s.at("s3://bucket/k/v%20.dcm")[1]


def test_folders_are_listed_by_tasks(spark, tmp_path):
    """Many small files: read by a bounded number of tasks, at any depth; hidden names and empty files are left out."""
    for d in ("a", "a/b/c", "d", ".hid", "_x"):
        (tmp_path / "r" / d).mkdir(parents=True)
        for n in range(40):
            (tmp_path / "r" / d / f"f{n}.json").write_text(f'{{"n": {n}}}')
    (tmp_path / "r" / "a" / "empty.json").write_text("")
    (tmp_path / "r" / "a" / "other.txt").write_text("x")
    root = f"{tmp_path}/r"
    got = {r.path: r.length for r in st.found_files(spark, root, "*.json").select(st.relative(root).alias("path"), "length").collect()}
    assert got == {f"{d}/f{n}.json": len(f'{{"n": {n}}}') for d in ("a", "a/b/c", "d") for n in range(40)}
    texts = st.file_texts(spark, root, "*.json")
    assert "FileScan binaryFile" not in texts._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.value for r in texts.collect()) == sorted([f'{{"n": {n}}}' for n in range(40)] * 3)
