"""File listings as tables, and what is found in them.

A listing has one row per file with ``path`` relative to the study root; ``magic`` tells whether
bytes 128-131 are ``DICM``. ``list_files`` makes one from a folder without reading contents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tractloom import constants as C
from tractloom.functions.stage import materialize
from tractloom.sources.stores import empty_files, file_digests, found_files, relative, with_magic


def list_files(spark: SparkSession, root: str, magic: bool = False) -> DataFrame:
    """Listing of a folder in any store; with ``magic`` all files but those named as DICOM or NIfTI are looked into for theirs, 132 bytes each."""
    found, rel = found_files(spark, root), relative(root)
    files = found.select(rel.alias("path"), F.col("length").alias("size"))
    if not magic:
        return files.withColumn("magic", F.lit(False))
    unnamed = found.where(~F.lower("path").rlike(r"\.(dcm|dicom|nii|nii\.gz)$"))
    heads = with_magic(unnamed).select(rel.alias("path"), "magic")
    return files.join(heads, "path", "left").withColumn("magic", F.coalesce("magic", F.lit(False)))


def _name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, r"^(?:(.*)/)?[^/]*$", 1)


def any_match(c: Column, patterns: list[str] | None) -> Column:
    """Any of the regular expressions matches from the start."""
    return reduce(lambda a, p: a | c.rlike(f"^(?:{p})"), patterns or [], F.lit(False))


def valid_subject_id(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[a-zA-Z0-9\-_]+$"), F.lit(False))


def discover_subjects(files: DataFrame, include: list[str] | None = None,
                      exclude: list[str] | None = None) -> DataFrame:
    """One row per session, or one without session for subjects that have none."""
    part = F.split("path", "/")
    sub, ses = F.get(part, F.lit(0)), F.get(part, F.lit(1))
    d = files.select(F.when(F.size(part) > 1, sub).alias("subject"),
                     F.when((F.size(part) > 2) & ses.startswith("ses-"), ses).alias("session"))
    d = d.where(F.col("subject").startswith("sub-"))
    if include:
        d = d.where(any_match(F.col("subject"), include))
    if exclude:
        d = d.where(~any_match(F.col("subject"), exclude))
    d = d.distinct()
    with_ses = d.where(F.col("session").isNotNull())
    plain = d.where(F.col("session").isNull()).join(with_ses.select("subject").distinct(), "subject", "left_anti")
    out = with_ses.unionByName(plain)
    return out.select("subject", "session", F.concat_ws("/", "subject", "session").alias("dir"))


def detect_input(files: DataFrame) -> DataFrame:
    """NIfTI or DICOM input of each unit (``unit`` column = subject or session folder).

    Looks in ``dwi/`` first, then the unit itself: *_dwi.nii.gz, any .nii.gz, .dcm, then any visible
    file with the magic. The least (folder, kind, path) wins, so it is one aggregate.
    """
    rel = F.expr("substring(path, length(unit) + 2)")
    d = files.withColumn("_rel", rel)
    rank = F.when(F.col("_rel").rlike(r"^dwi/[^/]+$"), 0).when(F.col("_rel").rlike(r"^[^/]+$"), 1)
    d = d.withColumns({"_rank": rank, "_n": _name(F.col("path"))}).where(F.col("_rank").isNotNull())
    n = F.col("_n")
    kind = F.when(n.endswith("_dwi.nii.gz"), 1).when(n.endswith(".nii.gz"), 2).when(n.endswith(".dcm") | n.endswith(".DCM"), 3)
    folder = parent_dir(F.col("path"))
    magic = ~n.startswith(".") & F.col("magic")
    g = d.groupBy("unit", "_rank").agg(
        F.min(F.when(kind.isNotNull(), F.struct(kind.alias("kind"), F.when(kind < 3, F.col("path")).otherwise(folder).alias("path")))).alias("_k"),
        F.min(F.when(magic, folder)).alias("_dir"))
    hit = F.coalesce(F.col("_k"), F.when(F.col("_dir").isNotNull(), F.struct(F.lit(4).alias("kind"), F.col("_dir").alias("path"))))
    best = g.groupBy("unit").agg(F.min(F.when(hit.isNotNull(), F.struct("_rank", hit.alias("hit")))).alias("_b"))
    k = F.col("_b.hit.kind")
    return best.select("unit", F.when(k <= 2, "nifti").when(k >= 3, "dicom").otherwise("none").alias("input_type"),
                       F.col("_b.hit.path").alias("input_path"))


def pair_sidecars(files: DataFrame) -> DataFrame:
    """S3: gradient and JSON companions of each NIfTI image in the same folder.

    A gradient pair must be complete; .bval/.bvec come before .bvals/.bvecs, and an image without
    a pair of its own retries with processing suffixes removed in the listed order. Companions are
    collected per (folder, stem) in one grouped pass.
    """
    p = F.col("path")
    comp = files.select(F.regexp_extract(p, r"^(.*)\.(bvals?|bvecs?|json)$", 1).alias("base"),
                        F.regexp_extract(p, r"\.(bvals?|bvecs?|json)$", 1).alias("ext"), p).where(F.col("ext") != "")
    c = comp.groupBy("base").agg(*[F.max(F.when(F.col("ext") == e, F.col("path"))).alias(e)
                                   for e in ("bval", "bvec", "bvals", "bvecs", "json")])
    one, many = F.col("bval").isNotNull() & F.col("bvec").isNotNull(), F.col("bvals").isNotNull() & F.col("bvecs").isNotNull()
    c = c.select("base", F.when(one, F.struct("bval", "bvec")).when(many, F.struct(F.col("bvals").alias("bval"), F.col("bvecs").alias("bvec"))).alias("pair"), "json")
    img = files.where(p.rlike(r"\.nii(\.gz)?$")).select(p.alias("nifti"), F.regexp_replace(p, r"\.nii(\.gz)?$", "").alias("stem"))
    tries = F.array_compact(F.array(
        F.struct(F.lit(0).alias("rank"), F.col("stem").alias("base")),
        *[F.when(F.col("stem").endswith(s), F.struct(F.lit(n + 1).alias("rank"), F.regexp_replace("stem", s + "$", "").alias("base")))
          for n, s in enumerate(C.GRADIENT_STEM_SUFFIXES)]))
    t = img.select("nifti", F.inline(tries)).join(c, "base", "left")
    return t.groupBy("nifti").agg(
        F.min_by("pair", F.when(F.col("pair").isNotNull(), F.col("rank"))).alias("_p"),
        F.max(F.when(F.col("rank") == 0, F.col("json"))).alias("json")).select(
            "nifti", F.col("_p.bval").alias("bval"), F.col("_p.bvec").alias("bvec"), "json")


# ---------------------------------------------------------------------------------- DICOM

def is_dicom_name(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(dcm|dicom)$")


def scan_study(files: DataFrame) -> DataFrame:
    """Folders that are a DICOM series, with file count and depth.

    A folder counts if any of its files is DICOM by name or, unless hidden, by content. The search
    goes to any depth, not into hidden folders and not below a series; the root is looked at by
    itself. ``large_series`` and ``shallow_series`` narrow the result.
    """
    n = _name(F.col("path"))
    d = files.select("study", "path", "magic", parent_dir(F.col("path")).alias("dir"), n.alias("_n"))
    d = d.where(~F.col("dir").rlike(r"(^|/)\."))
    dcm = F.col("_n").endswith(".dcm") | F.col("_n").endswith(".DCM")
    ok = (is_dicom_name(F.col("_n")) | F.col("magic")) & ~F.col("_n").startswith(".")
    g = d.groupBy("study", "dir").agg(F.count(F.when(dcm, 1)).alias("n_dcm"), F.count(F.when(ok, 1)).alias("n_magic"))
    g = g.where((F.col("n_dcm") > 0) | (F.col("n_magic") > 0))
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    s = g.select("study", "dir", F.when(F.col("n_dcm") > 0, F.col("n_dcm")).otherwise(F.col("n_magic")).alias("n_files"),
                 depth.alias("depth"))
    s = materialize(s)
    part = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.col("depth") - 1), lambda k: F.array_join(F.slice(part, 1, k), "/"))
    anc = s.where("depth > 1").select("study", "dir", F.explode(above).alias("up"))
    below = anc.join(s.where("depth > 0").select("study", F.col("dir").alias("up")), ["study", "up"], "left_semi")
    s = s.join(below.select("study", "dir").distinct(), ["study", "dir"], "left_anti")
    return s.withColumn("name", _name(F.col("dir")))


def large_series(series: DataFrame, min_files: int = C.DICOM_MIN_FILES) -> DataFrame:
    """Series of a scan with at least ``min_files`` files."""
    return series.where(F.col("n_files") >= min_files)


def shallow_series(series: DataFrame, max_depth: int = C.DICOM_MAX_DEPTH) -> DataFrame:
    """Series of a scan at most ``max_depth`` folders below the root."""
    return series.where(F.col("depth") <= max_depth)


def group_series(headers: DataFrame) -> DataFrame:
    """Series of each folder from header rows (dir, path, uid, description, number)."""
    h = headers.where(F.coalesce(F.col("uid"), F.lit("")) != "")
    return h.groupBy("dir", "uid").agg(
        F.min_by(F.struct("description", "number"), "path").alias("_f"), F.count(F.lit(1)).alias("file_count")).select(
            "dir", "uid", F.coalesce("_f.description", F.lit("Unknown")).alias("description"),
            F.coalesce("_f.number", F.lit(0)).alias("number"), "file_count")


def choose_single_series(series: DataFrame, requests: DataFrame) -> DataFrame:
    """The one series of a folder, or the requested UID; otherwise why not."""
    g = requests.join(series, "dir", "left").groupBy("dir", "series_uid").agg(
        F.count("uid").alias("n_series"), F.min("uid").alias("_only"),
        F.max(F.coalesce((F.col("uid") == F.col("series_uid")).cast("int"), F.lit(0))).alias("_has"))
    named, n = F.col("series_uid").isNotNull(), F.col("n_series")
    status = (F.when(n == 0, "none").when(named & (F.col("_has") == 1), "ok").when(named, "uid not found")
              .when(n > 1, "ambiguous").otherwise("ok"))
    uid = F.when(status == "ok", F.coalesce("series_uid", "_only"))
    return g.select("dir", "n_series", status.alias("status"), uid.alias("uid"))


# ------------------------------------------------------------------------------- integrity

def _checked(manifest: DataFrame, digests: DataFrame) -> DataFrame:
    d = manifest.join(digests, "key", "left")
    return d.withColumns({"present": F.col("actual").isNotNull(),
                          "valid": F.coalesce(F.col("actual") == F.lower("sha256"), F.lit(False)),
                          "tier2": F.col("tag").isNotNull()}).drop("actual")


def verify_files(contents: DataFrame, manifest: DataFrame) -> DataFrame:
    """SHA-256 of each content against the manifest; a missing one does not verify.

    ``contents``: key, content; ``manifest``: key, sha256, tag, ….
    """
    return _checked(manifest, contents.select("key", F.sha2("content", 256).alias("actual")))


def verify_folder(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """SHA-256 of each file below ``root``, read in chunks, against the manifest; ``size`` is null for a missing file.

    ``manifest``: key (path below ``root``), sha256, tag, …, but no size of its own.
    """
    full = materialize(file_digests(spark, root))
    empty = empty_files(spark, root, manifest.select("key").distinct().join(full, "key", "left_anti"))
    nothing = empty.select("key", F.sha2(F.lit(b""), 256).alias("actual"), F.lit(0).cast("long").alias("size"))
    return _checked(manifest, full.unionByName(nothing))
