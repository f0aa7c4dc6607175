"""Cohort tables: preflight, resume, report rows, participants and provenance records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tractloom import constants as C
from tractloom.functions.naming import nifti_stem, sex_code
from tractloom.functions.numeric import count_if, rnd
from tractloom.sources.files import valid_subject_id

UNIT = ["subject_id", "session_id"]


def _unit(df: DataFrame) -> DataFrame:
    """Session '' where there is none, so that units join."""
    return df.withColumn("session_id", F.coalesce(F.col("session_id").cast("string"), F.lit("")))


def preflight(subjects: DataFrame, paths: DataFrame) -> DataFrame:
    """error rows for bad ids, repeated (subject, session) and missing inputs.

    ``subjects``: subject_id, session_id, seq (order listed), input_type, input_path, bval_path,
    bvec_path; ``paths``: path, is_dir. The first listing of a pair is not an error. Duplicates are
    found by counting pairs, not by ordering them.
    """
    s = _unit(subjects)
    bad = s.where(~valid_subject_id(F.col("subject_id"))).select(
        F.lit("INPUT").alias("category"), F.concat(F.lit("invalid subject id: "), F.coalesce("subject_id", F.lit(""))).alias("message"), "subject_id", "seq")
    pairs = s.groupBy(*UNIT).agg(F.min("seq").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    dup = s.join(pairs, UNIT).where(F.col("seq") > F.col("_first")).select(
        F.lit("CONFIG").alias("category"), F.concat(F.lit("duplicate subject/session: "), "subject_id", F.lit("/"), "session_id").alias("message"), "subject_id", "seq")
    need = F.array_compact(F.array(
        F.struct(F.when(F.col("input_type") == "dicom", "DICOM directory").otherwise("NIfTI file").alias("what"), F.col("input_path").alias("path"),
                 (F.col("input_type") == "dicom").alias("dir")),
        *[F.when((F.col("input_type") == "nifti") & F.col(f"{k}_path").isNotNull(), F.struct(F.lit(f"{k} file").alias("what"), F.col(f"{k}_path").alias("path"), F.lit(False).alias("dir")))
          for k in ("bval", "bvec")]))
    wanted = s.select("subject_id", "seq", F.inline(need))
    known = paths.select("path", "is_dir").distinct()
    miss = wanted.join(known, ["path"], "left").where(F.col("is_dir").isNull() | (F.col("dir") & ~F.col("is_dir"))).select(
        F.lit("INPUT").alias("category"), F.concat("what", F.lit(" not found: "), "path").alias("message"), "subject_id", "seq")
    return bad.unionByName(dup).unionByName(miss)


def config_hash(config: Column) -> Column:
    """SHA-256 of the run settings (MAP) as key-sorted JSON, without those that do not change output."""
    def quoted(c: Column) -> Column:
        return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))

    kept = F.array_sort(F.filter(F.map_entries(config), lambda e: ~e["key"].isin("force", "keep_work", "timeout_minutes")))
    return F.sha2(F.concat(F.lit("{"), F.array_join(F.transform(kept, lambda e: F.concat(quoted(e["key"]), F.lit(": "), quoted(e["value"]))), ", "), F.lit("}")), 256)


def resume(subjects: DataFrame, done: DataFrame, force: Column | bool = False) -> DataFrame:
    """Which subjects still have to run: no done marker with the same settings, or forced."""
    force = F.lit(force) if isinstance(force, bool) else force
    m = _unit(done).select(*UNIT, "config_hash", F.lit(True).alias("_done")).distinct()
    d = _unit(subjects).join(m, [*UNIT, "config_hash"], "left")
    return d.select(*UNIT, "config_hash", F.when(F.coalesce("_done", F.lit(False)) & ~force, "skipped").otherwise("run").alias("action"))


def attach_extraction(metrics: DataFrame, near: DataFrame, beside: DataFrame) -> DataFrame:
    """Extraction method and artifact index of a subject, from the first report found.

    ``near`` and ``beside`` are reports at the two candidate places (subject_id, method,
    artifact_index).
    """
    a = near.select("subject_id", F.struct("method", "artifact_index").alias("_a"))
    b = beside.select("subject_id", F.struct("method", "artifact_index").alias("_b"))
    d = metrics.join(a, "subject_id", "left").join(b, "subject_id", "left").withColumn("_x", F.coalesce("_a", "_b"))
    has, ai = F.coalesce(F.col("_x.method"), F.lit("")) != "", F.col("_x.artifact_index")
    return d.withColumns({
        "method": F.when(has, F.col("_x.method")), "artifact_index": F.when(has, ai),
        "artifact_index_available": F.when(has, ai.isNotNull()),
        "artifact_index_reason": F.when(has & ai.isNull(), "defined only for bidirectional extraction")}).drop("_a", "_b", "_x")


# ------------------------------------------------------------------------------ report rows

def latest(results: DataFrame, order: str) -> DataFrame:
    """The last result of each (subject, session)."""
    cols = [c for c in results.columns if c not in UNIT]
    return results.groupBy(*UNIT).agg(F.max_by(F.struct(*cols), order).alias("_r")).select(*UNIT, "_r.*")


def report_columns() -> list[str]:
    """The metric columns of a cohort row (all but the six status columns)."""
    return C.cohort_headers()[6:]


def _wide(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key with a column per report column, in one aggregation; names are turned to numbers first."""
    names = report_columns()
    place = F.create_map(*[x for n, c in enumerate(names) for x in (F.lit(c), F.lit(n))])[F.col("column")]
    d = metrics.select(*keys, place.alias("_n"), "value")
    return d.groupBy(*keys).agg(*[F.max(F.when(F.col("_n") == n, F.col("value"))).alias(c) for n, c in enumerate(names)])


def cohort_table(results: DataFrame, metrics: DataFrame) -> DataFrame:
    """Fixed columns, one row per result; metrics only for successes; missing stay NULL.

    ``metrics``: subject_id, session_id, column, value. The columns are a fixed list, so a task first
    makes one row of a unit's values and only such rows are exchanged.
    """
    wide = _wide(_unit(metrics), UNIT)
    ok = F.col("status") == "success"
    d = _unit(results).join(wide, UNIT, "left")
    status = {"duration_seconds": rnd(F.col("duration_seconds"), 1)}
    return d.select(*[F.when(ok, F.col(c)).alias(c) if c in set(report_columns()) else status.get(c, F.col(c)).alias(c)
                      for c in C.cohort_headers()])


def side_columns(metrics_long: DataFrame, comparison: DataFrame) -> DataFrame:
    """Report columns (column, value) of ``metrics.metrics_long`` and ``compare_sides`` output."""
    names = {"n_streamlines": "n_streamlines", "mean_length": "mean_length_mm", "tract_volume": "tract_volume_mm3"}
    for s in C.SCALARS:
        names |= {f"{s}_mean": f"{s}_mean", f"{s}_std": f"{s}_std", f"{s}_pool_mean": f"{s}_mean_point_weighted"}
        names |= {f"{s}_{r}": f"{s}_{r}" for r, _, _ in C.TRACT_REGIONS}
    label = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    left_right = metrics_long.where(F.col("metric").isin(*names)).select(
        "subject_id", F.concat_ws("_", "side", label[F.col("metric")]).alias("column"), "value")
    li = comparison.where(F.col("quantity") != "mean_length").select(
        "subject_id", F.concat(F.col("quantity"), F.lit("_laterality_index")).alias("column"), F.col("laterality_index").alias("value"))
    return left_right.unionByName(li)


def nested_report(columns: DataFrame) -> DataFrame:
    """One nested record per subject: left, right and asymmetry maps of the report columns."""
    part = (F.when(F.col("column").endswith("laterality_index"), "asymmetry")
            .when(F.col("column").startswith("left_"), "left").otherwise("right"))
    key = F.regexp_replace("column", "^(left|right)_", "")
    d = columns.select("subject_id", part.alias("part"), key.alias("key"), "value")
    # a subject has at most the fixed number of report columns, so these maps stay small
    def entries(p: str) -> Column:
        return F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("part") == p, F.struct("key", "value")))))
    return d.groupBy("subject_id").agg(F.struct(*[entries(p).alias(p) for p in ("left", "right", "asymmetry")]).alias("metrics"))


def flat_report(columns: DataFrame) -> DataFrame:
    """One flat row per subject."""
    return _wide(columns, ["subject_id"])


def write_cohort(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def batch_summary(results: DataFrame) -> DataFrame:
    """Total and per-status counts."""
    s = F.col("status")
    return results.agg(F.count(F.lit(1)).alias("total"), *[count_if(s == v).alias(v) for v in ("success", "failed", "skipped")],
                       F.sum(rnd(F.col("duration_seconds"), 1)).alias("seconds"))


def step_report(steps: DataFrame) -> DataFrame:
    """Total time, failed step names and success of each run (run, step, seconds, success).

    Step names come from a fixed short list, so the collected set is bounded.
    """
    per_step = steps.groupBy("run", "step").agg(F.sum("seconds").alias("seconds"), F.bool_and("success").alias("ok"))
    g = per_step.groupBy("run").agg(
        F.sum("seconds").alias("total_seconds"), F.count(F.lit(1)).alias("n_steps"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("step")))), ",").alias("failed_steps"),
        F.bool_and("ok").alias("success"))
    return g


# ---------------------------------------------------------------------------- participants

def upsert_participants(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Add participants not listed yet; the first row of a new id wins; nothing is updated.

    ``new``: participant_id, age (years or NULL), sex (raw), seq.
    """
    age = F.when(F.col("age").isNull(), "n/a").otherwise(F.format_string("%.1f", rnd(F.col("age"), 1)))
    row = F.struct(age.alias("age"), sex_code(F.col("sex")).alias("sex"))
    first = new.groupBy("participant_id").agg(F.min_by(row, "seq").alias("_r")).select("participant_id", "_r.*")
    return existing.select("participant_id", "age", "sex").unionByName(first.join(existing, "participant_id", "left_anti"))


def dataset_description(version: str, derivative: bool = True, nested_in_raw: bool = False) -> Column:
    """dataset_description record."""
    name = "tract analytics derivatives" if derivative else "tract analytics raw BIDS"
    fields = [F.lit(name).alias("Name"), F.lit("1.9.0").alias("BIDSVersion"),
              F.lit("derivative" if derivative else "raw").alias("DatasetType"),
              F.array(F.struct(F.lit("tractloom").alias("Name"), F.lit(version).alias("Version"))).alias("GeneratedBy")]
    if derivative and nested_in_raw:
        fields.append(F.array(F.struct(F.lit("bids::").alias("URL"))).alias("SourceDatasets"))
    return F.struct(*fields)


def participants_description() -> Column:
    """Participants.json column definitions."""
    return F.struct(
        F.struct(F.lit("Label of the participant, unique in the dataset").alias("Description")).alias("participant_id"),
        F.struct(F.lit("Age when scanned").alias("Description"), F.lit("years").alias("Units")).alias("age"),
        F.struct(F.lit("Sex as recorded by the scanner").alias("Description"), F.struct(
            F.lit("Male").alias("M"), F.lit("Female").alias("F"), F.lit("Other").alias("O")).alias("Levels")).alias("sex"))


def sidecar_records(files: DataFrame) -> DataFrame:
    """Provenance record of each derived image as JSON next to it.

    ``files``: path, sources (ARRAY), description, command_line, software (MAP or NULL).
    """
    steps = F.transform(F.map_entries("software"), lambda e: F.struct(
        e["key"].alias("Name"), e["key"].alias("Software"), e["value"].alias("Version")))
    record = F.struct(F.col("sources").alias("Sources"), F.lit("native").alias("SpatialReference"), F.col("description").alias("Description"),
                      F.nullif("command_line", F.lit("")).alias("CommandLine"), F.when(F.size("software") > 0, steps).alias("ProcessingSteps"))
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    return files.select(F.concat(folder, nifti_stem(F.col("path")), F.lit(".json")).alias("sidecar"), F.to_json(record).alias("record"))


def import_records(series: DataFrame) -> DataFrame:
    """Import report per subject from an assessed series and its conversion outcome."""
    c = F.col
    record = F.struct(
        F.struct("subject_id").alias("processing_info"),
        F.struct(c("name").alias("series_name"), c("description").alias("series_description"), c("n_files").alias("n_dicom_files")).alias("input"),
        F.struct("success", "converter").alias("conversion"),
        F.struct("b_values", c("phase_encoding")).alias("data_properties"),
        F.struct("series_type", c("suitable").alias("suitable_for_tractography"), c("score").alias("suitability_score")).alias("quality_assessment"))
    return series.select("subject_id", F.to_json(record).alias("record"))
