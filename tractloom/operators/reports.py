"""Reports as one JSON record per subject (S10, S14): rows (name, content) for ``sources.stores.write_records``.

A record holds a fixed set of metrics, a profile of fixed length and the few files of one subject, so
its size does not grow with the cohort. A subject without files has empty lists, one without metrics
a null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tractloom import constants as C
from tractloom.operators.cohort import import_records, nested_report
from tractloom.sources.stores import file_texts

#: JSON keeps fields that are null.
_JSON = {"ignoreNullFields": "false"}


def _named(records: DataFrame, prefix: str, suffix: str, record: Column) -> DataFrame:
    name = F.concat(F.lit(prefix), F.col("subject_id").cast("string"), F.lit(suffix))
    return records.select("subject_id", name.alias("name"), F.to_json(record, _JSON).alias("content"))


def _written(at: str | None) -> Column:
    return F.date_format(F.current_timestamp() if at is None else F.lit(at).cast("timestamp"), "yyyy-MM-dd HH:mm:ss")


def _metrics(metrics: DataFrame) -> DataFrame:
    return metrics.select("subject_id", F.struct(*[c for c in metrics.columns if c != "subject_id"]).alias("metrics"))


def validation_records(metrics: DataFrame, tractograms: DataFrame, anatomy: DataFrame | None = None, at: str | None = None) -> DataFrame:
    """Validation report of each row of ``metrics`` (subject_id and any metric columns).

    ``tractograms``: subject_id, role (``candidate`` or ``reference``), path; ``anatomy``: subject_id,
    path of the reference image, the least one if there are several. ``at`` is the time that the
    reports carry, now if none.
    """
    def paths(role: str) -> Column:
        return F.array_sort(F.collect_set(F.when(F.col("role") == role, F.col("path"))))

    files = tractograms.groupBy("subject_id").agg(paths("candidate").alias("candidate"), paths("reference").alias("reference"))
    d = _metrics(metrics).join(files, "subject_id", "left")
    image = F.lit(None).cast("string")
    if anatomy is not None:
        d = d.join(anatomy.groupBy("subject_id").agg(F.min("path").alias("anatomy")), "subject_id", "left")
        image = F.col("anatomy")
    none = F.array().cast("array<string>")
    return _named(d, "validation/", "_validation.json", F.struct(
        _written(at).alias("timestamp"), F.coalesce("candidate", none).alias("candidate_tractograms"),
        F.coalesce("reference", none).alias("reference_tractograms"), image.alias("reference_anatomy"), "metrics"))


def extraction_records(stats: DataFrame, outputs: DataFrame, versions: dict[str, str], at: str | None = None) -> DataFrame:
    """Extraction report of each row of ``stats`` (subject_id and any statistics).

    ``outputs``: subject_id, kind (one of ``constants.EXTRACTION_OUTPUTS``), path; a kind without a
    file is null, of several files of a kind the least is named.
    """
    files = outputs.groupBy("subject_id").agg(F.struct(*[
        F.min(F.when(F.col("kind") == k, F.col("path"))).alias(k) for k in C.EXTRACTION_OUTPUTS]).alias("files"))
    d = _metrics(stats).join(files, "subject_id", "left")
    none = F.struct(*[F.lit(None).cast("string").alias(k) for k in C.EXTRACTION_OUTPUTS])
    provenance = F.struct(*[F.lit(v).alias(k) for k, v in versions.items()]) if versions else F.lit(None).cast("string")
    return _named(d, "logs/", "_cst_extraction_report.json", F.struct(
        _written(at).alias("processing_date"), "subject_id", provenance.alias("provenance"), F.col("metrics").alias("statistics"),
        F.coalesce("files", none).alias("output_files")))


def metrics_records(columns: DataFrame, profile: DataFrame, metadata: DataFrame, version: str, at: str | None = None) -> DataFrame:
    """Nested bilateral report of each subject of ``columns`` (as ``cohort.side_columns`` gives them).

    ``profile``: subject_id, side, place, scalar, value, the values along the tract; ``metadata``:
    subject_id, acquisition, processing, qc_thresholds (structs or maps, one row per subject).
    """
    points = profile.groupBy("subject_id", "side", "scalar").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("_p"))
    lines = points.withColumn("_p", F.transform("_p", lambda p: p["value"])).groupBy("subject_id").agg(*[
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("scalar", "_p"))))).alias(f"_{s}") for s in ("left", "right")])
    profiles = F.struct(F.col("_left").alias("left"), F.col("_right").alias("right")).alias("profiles")
    d = nested_report(columns).join(lines, "subject_id", "left").join(metadata, "subject_id", "left")
    return _named(d, "metrics/", "_bilateral_metrics.json", F.struct(
        "subject_id", _written(at).alias("processing_date"), F.lit(version).alias("version"), "acquisition", "processing", "qc_thresholds",
        F.struct("metrics.left", "metrics.right", "metrics.asymmetry", profiles).alias("metrics")))


def import_report_records(series: DataFrame) -> DataFrame:
    """Import report of each subject's series (columns of ``cohort.import_records``) as a file."""
    name = F.concat(F.lit("import/"), F.col("subject_id").cast("string"), F.lit("_import_report.json"))
    return import_records(series).select("subject_id", name.alias("name"), F.col("record").alias("content"))


def read_records(spark: SparkSession, path: str, schema: StructType | str, glob: str = "*.json") -> DataFrame:
    """(record) of every JSON file with that ending below a folder, one row per file; null where a file does not parse."""
    return file_texts(spark, path, glob).select(F.from_json("value", schema).alias("record"))
