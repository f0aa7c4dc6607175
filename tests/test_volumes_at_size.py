"""Voxel tables made from few rows: dealt over tasks, never sent whole through the driver; cuts and means that do not depend on the order of rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tractloom.functions import geometry as G
from tractloom.functions.naming import patient_hash, subject_session_labels
from tractloom.functions.ranking import with_buckets
from tractloom.operators import extract as ex, rois
from tractloom.plans import catalog, fixtures as fx

SF = "/root/testdata/sf0.001"
#: Queries whose voxel side was broadcast, as an explode of a small file was taken for small.
WHOLE = ("F2_voxel_to_world", "F11_ras_orientation", "J16_label_resample", "F7_hemisphere_clamp", "F8_tissue_masks", "A9_roi_hemisphere_split", "W4_jacobian")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", WHOLE)
def test_no_voxel_table_is_broadcast(spark, name):
    plan = _plan(catalog.QUERIES[name](spark, SF))
    assert "BroadcastHashJoin" not in plan, plan


def test_volumes_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(fx, "TASK_VOLUMES", 2)
    v = fx.volumes(spark, SF)
    n = fx.table(spark, SF, "supplier").count()
    assert v.groupBy(F.spark_partition_id()).count().count() > 1 and v.count() == n * fx.BOX ** 3
    assert v.rdd.getNumPartitions() >= n / 2


def test_densest_slices_read_the_masks_once(spark):
    rows = [(1, "a", 2, 0, 5), (1, "a", 1, 0, 5), (1, "b", 1, 0, 5), (1, "a", 1, 3, 4), (2, "a", 0, 0, 0)]
    masks = spark.createDataFrame(rows, "subject_id long, roi string, i int, j int, k int")
    got = rois.densest_slices(masks, spark.range(1, 4).withColumnRenamed("id", "subject_id"), (9, 7, 5))
    assert _plan(got).count("Scan ExistingRDD") == 1
    assert sorted(map(tuple, got.collect())) == [(1, 1, 2, 0, 2, 5, 2), (2, 0, 1, 0, 1, 0, 1), (3, 4, 0, 3, 0, 2, 0)]


def test_plane_clamps_before_duplicates_meet(spark):
    rows = [(1, i, j, 5, lab) for i in range(8) for j in range(8) for lab in (7, 107) if (i + j) % 3 == 0]
    lab = spark.createDataFrame(rows, "subject_id long, i int, j int, k int, label int")
    grid = G.Grid(((1.0, 0.0, 0.0, -4.0), (0.0, 1.0, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0), (0.0, 0.0, 0.0, 1.0)), (8, 8, 8))
    got = rois.create_roi_masks(lab, grid, F.lit(0.0))
    late = rois.clamp_to_hemisphere(rois.create_roi_masks(lab, grid), grid, F.lit(0.0))
    assert sorted(got.collect()) == sorted(late.select(*got.columns).collect()) != []


def test_cuts_are_taken_once(spark):
    d = with_buckets(spark.range(1000).selectExpr("id % 3 as s", "id as v"), ["s"], F.col("v"))
    assert "percentile_approx" not in _plan(d)


def test_mean_on_a_midline_keeps_its_side(spark, make_points, grid):
    """0.1 ten times is 0.1 on average, in any order; the sum of doubles is a little less."""
    points = make_points({1: [(0.1, 0, n) for n in range(10)], 2: [(0.3, 0, 0), (0.1, 0, 1), (0.2, 0, 2)]})
    none = spark.createDataFrame([], "subject_id long, i int, j int, k int, roi string")
    means = {r.streamline_id: r.x_mean for r in ex.streamline_table(points, grid, none).collect()}
    assert means == {1: 0.1, 2: 0.2}


def test_hash_collisions_are_errors_in_both(spark):
    """Two patients whose short hashes are equal (found by search) are told in the query and in its SQL."""
    seen, pair = {}, None
    con = duckdb.connect()
    for k, h in con.execute("SELECT r, substr(sha256('pat ' || r), 1, 8) FROM range(1, 400000) t(r) WHERE r % 4 > 0").fetchall():
        if h in seen:
            pair = (seen[h], k)
            break
        seen[h] = k
    assert pair
    con.execute("CREATE TABLE orders AS SELECT unnest(?) AS o_custkey, 1 AS o_orderkey, DATE '2020-01-01' AS o_orderdate", [list(pair)])
    want = con.execute("SELECT study_id, error FROM (" + catalog.ORACLE["H12_tag_labels"] + ") ORDER BY 1").fetchall()
    rows = [(k, "f", f"pat {k}", "030Y", "F", "20200101", None, None) for k in pair]
    h = spark.createDataFrame(rows, "study_id long, path string, patient_id string, age string, sex string, study_date string, given_subject string, given_session string")
    got = sorted((r.study_id, r.error) for r in subject_session_labels(h).collect())
    assert got == sorted(want) == [(k, "label collision") for k in sorted(pair)]
    assert spark.createDataFrame([(f"pat {k}",) for k in pair], "p string").select(patient_hash(F.col("p"))).distinct().count() == 1
