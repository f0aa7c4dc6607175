"""Manifests, gradient text and sidecar JSON as typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

_MAP = T.MapType(T.StringType(), T.StringType())
SUBJECT = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "session", "nifti", "dicom", "series_uid")]
                       + [T.StructField("options", _MAP)])
MANIFEST = T.StructType([T.StructField("name", T.StringType()), T.StructField("description", T.StringType()),
                         T.StructField("options", _MAP), T.StructField("subjects", T.ArrayType(SUBJECT))])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest file(s) as rows."""
    return spark.read.schema(MANIFEST).json(path, multiLine=True)


def manifest_subjects(manifest: DataFrame) -> DataFrame:
    """One row per listed subject with an error code (NULL when valid)."""
    s = manifest.select(F.coalesce("name", F.lit("Unnamed Study")).alias("study"), F.col("options").alias("study_options"),
                        F.posexplode("subjects").alias("position", "s"))
    nii, dcm = F.col("s.nifti").isNotNull(), F.col("s.dicom").isNotNull()
    error = (F.when(F.col("s").isNull(), "not an object").when(F.col("s.id").isNull(), "missing id")
             .when(~nii & ~dcm, "neither nifti nor dicom").when(nii & dcm, "both nifti and dicom"))
    return s.select("study", "study_options", "position", "s.*", error.alias("error"))


# --------------------------------------------------------------------------- gradient text

def _numbers(line: Column) -> Column:
    return F.transform(F.filter(F.split(F.trim(line), r"\s+"), lambda t: t != ""), lambda t: t.try_cast("double"))


def parse_gradients(texts: DataFrame) -> DataFrame:
    """Gradient volumes from whole texts (``key``, ``bval_text``, ``bvec_text``).

    b-values may span lines; vectors are 3 lines of N or N lines of 3 (3 lines win). Output:
    key, vol_idx, bval, bx, by, bz; entries beyond the shorter file are NULL.
    """
    lines = F.filter(F.split("bvec_text", r"\r?\n"), lambda s: F.trim(s) != "")
    d = texts.withColumns({"_b": _numbers(F.regexp_replace("bval_text", r"\s+", " ")), "_r": F.transform(lines, _numbers)})
    by_row = F.size("_r") == 3

    def axis(a: int) -> Column:
        return F.when(by_row, F.get("_r", F.lit(a))).otherwise(F.transform("_r", lambda r: F.get(r, F.lit(a))))

    d = d.withColumns({n: axis(a) for a, n in enumerate(("_x", "_y", "_z"))})
    z = d.select("key", F.posexplode(F.arrays_zip("_b", "_x", "_y", "_z")).alias("vol_idx", "v"))
    return z.select("key", "vol_idx", F.col("v._b").alias("bval"), F.col("v._x").alias("bx"), F.col("v._y").alias("by"), F.col("v._z").alias("bz"))


def check_gradients(gradients: DataFrame, volumes: DataFrame) -> DataFrame:
    """Counts of b-values and vectors against the image's volumes (key, n_volumes)."""
    g = gradients.groupBy("key").agg(F.count("bval").alias("n_bvals"), F.count("bx").alias("n_bvecs"))
    d = volumes.join(g, "key", "left").na.fill(0, ["n_bvals", "n_bvecs"])
    issue = (F.when(F.col("n_volumes") <= 1, None)
             .when(F.col("n_bvals") != F.col("n_volumes"), "volume/gradient mismatch")
             .when(F.col("n_bvecs") != F.col("n_bvals"), "bval/bvec mismatch"))
    return d.withColumns({"issue": issue, "valid": issue.isNull()})


# ------------------------------------------------------------------------------- sidecars

SIDECAR_FIELDS = ("MagneticFieldStrength", "EchoTime", "RepetitionTime", "Manufacturer", "DeviceSerialNumber",
                  "SoftwareVersions", "ConversionSoftwareVersion")


def parse_sidecars(texts: DataFrame, json: str = "json") -> DataFrame:
    """Sidecar text to typed columns; values that are not numbers become NULL; echo time in ms."""
    def get(name: str) -> Column:
        return F.get_json_object(json, f"$.{name}")

    return texts.withColumns({
        "field_strength": get("MagneticFieldStrength").try_cast("double"),
        "echo_time_ms": get("EchoTime").try_cast("double") * 1000,
        "repetition_time": get("RepetitionTime").try_cast("double"),
        "manufacturer": get("Manufacturer"), "device_serial": get("DeviceSerialNumber"),
        "software": get("SoftwareVersions"), "converter": get("ConversionSoftwareVersion")}).drop(json)
