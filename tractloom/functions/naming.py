"""Names, labels, ages and report cells as string expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tractloom import constants as C
from tractloom.functions.numeric import lit, rnd


def bids_filename(entities: Column, suffix: Column, extension: Column) -> Column:
    """H2: ``entities`` (MAP) in BIDS order, unknown ones after, then ``_suffix`` and extension."""
    order = F.array(*map(F.lit, C.BIDS_ENTITY_ORDER))
    pair = lambda k: F.concat(k, F.lit("-"), F.try_element_at(entities, k))
    known = F.transform(F.filter(order, lambda k: F.map_contains_key(entities, k)), pair)
    other = F.transform(F.filter(F.map_keys(entities), lambda k: ~F.array_contains(order, k)), pair)
    return F.concat(F.array_join(F.concat(known, other), "_"), F.lit("_"), suffix, extension)


def sanitize_label(raw: Column, max_len: int = 20) -> Column:
    """H3: letters and digits with single hyphens, starting with a letter, never empty.

    Each letter or digit gives at least one character of the label, so it depends on no more than the
    text up to the ``max_len`` + 1st of them, however far that is; a match up to there is rewritten and
    not a long text three times over.
    """
    s = F.regexp_extract(raw, rf"^(?:[^A-Za-z0-9]*+[A-Za-z0-9]){{0,{max_len + 1}}}+", 0)
    s = F.ltrim(F.regexp_replace(s, "[^A-Za-z0-9]+", "-"), F.lit("-"))
    s = F.when(s == "", "x").when(~s.rlike("^[A-Za-z]"), F.concat(F.lit("x"), s)).otherwise(s)
    return F.substring(s, 1, max_len)


def age_years(tag: Column) -> Column:
    """H4: '034Y', '018M', '002W', '005D' to years; NULL for anything else."""
    s = F.upper(F.trim(tag))
    n = F.regexp_extract(s, r"^(\d+)[YMWD]$", 1).try_cast("double")
    unit = F.substring(s, -1, 1)
    return (F.when(unit == "Y", n).when(unit == "M", rnd(n / lit(12.0), 3))
            .when(unit == "W", rnd(n / lit(52.18), 3)).when(unit == "D", rnd(n / lit(365.25), 3)))


def sex_code(raw: Column) -> Column:
    """H5."""
    s = F.upper(F.trim(raw))
    return (F.when(s.isin("M", "MALE"), "M").when(s.isin("F", "FEMALE"), "F")
            .when(s.isin("O", "OTHER"), "O").otherwise("n/a"))


def patient_key(patient_id: Column) -> Column:
    """H6: SHA-256 of the patient id; the key by which patients are told apart."""
    return F.sha2(patient_id, 256)


def patient_hash(patient_id: Column) -> Column:
    """H6: first 8 hex digits of the key, to be shown only; see ``label_collisions``."""
    return F.substring(patient_key(patient_id), 1, 8)


def label_collisions(rows: DataFrame, label: str, key: str) -> DataFrame:
    """Labels (shortened, hashed or cleaned names) that more than one different key got, one error row each."""
    g = rows.groupBy(label).agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"))
    return g.where(F.col("first_key") != F.col("last_key")).select(label, "first_key", "last_key", F.lit("label collision").alias("error"))


def _file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def nifti_stem(path: Column) -> Column:
    """H7: file name without .nii.gz or .nii."""
    return F.regexp_replace(_file_name(path), r"\.nii(\.gz)?$", "")


def clean_stem(path: Column) -> Column:
    """H7: stem without the first matching processing suffix; short results keep the plain stem."""
    last_dropped = F.regexp_replace(_file_name(path), r"(?<=.)\.[^.]+$", "")
    stem = F.regexp_replace(last_dropped, r"\.nii$", "")
    cut = reduce(lambda e, s: e.when(stem.endswith(s), F.regexp_replace(stem, s + "$", "")), C.STEM_SUFFIXES, F).otherwise(stem)
    return F.when(F.length(cut) < 3, F.replace(last_dropped, F.lit(".nii"), F.lit(""))).otherwise(cut)


def safe_filename(name: Column) -> Column:
    """H7: characters illegal in file names become underscores; outer _ and . are stripped."""
    s = F.regexp_replace(name, r'[ /\\:*?"<>|]', "_")
    s = F.regexp_replace(s, r"^[_.]+|[_.]+$", "")
    return F.when(s == "", "converted").otherwise(s)


def subject_from_series(name: Column) -> Column:
    """H7: series name without protocol tokens, at most 50 characters."""
    s = F.regexp_replace(name, r"_?Series0*(\d+)", "_$1")
    s = F.regexp_replace(F.regexp_replace(s, r"(?i)mbep2d_?", ""), r"(?i)TDI_?", "")
    s = F.regexp_replace(F.regexp_replace(s, "__+", "_"), "^_+|_+$", "")
    s = F.regexp_replace(F.substring(s, 1, 50), r"(?U)[^\w\-]", "_")
    return F.when(s == "", "subject").otherwise(s)


# ------------------------------------------------------------------------- report cells

def fixed(c: Column, places: int) -> Column:
    """Fixed-point text of a number, ties to even."""
    return F.format_string(f"%.{places}f", rnd(c, places))


def _scaled(c: Column, diffusivity: bool) -> tuple[Column, int]:
    return (c * lit(1000.0), 2) if diffusivity else (c, 3)


def mean_sd(mean: Column, std: Column, diffusivity: bool = False) -> Column:
    (m, p), (s, _) = _scaled(mean, diffusivity), _scaled(std, diffusivity)
    return F.concat(fixed(m, p), F.lit(" ± "), fixed(s, p))


def median_range(median: Column, low: Column, high: Column, diffusivity: bool = False) -> Column:
    m, lo, hi = (_scaled(c, diffusivity) for c in (median, low, high))
    return F.concat(fixed(*m), F.lit(" ("), fixed(*lo), F.lit("-"), fixed(*hi), F.lit(")"))


def side_cell(left: Column, right: Column, li: Column, diffusivity: bool = False) -> Column:
    """Left / right / signed laterality; '-' where a side is missing."""
    lo, ro = _scaled(left, diffusivity), _scaled(right, diffusivity)
    v = rnd(F.coalesce(li, lit(0.0)), 3)
    signed = F.concat(F.when(v < 0, F.lit("")).otherwise("+"), F.format_string("%.3f", v))
    return F.coalesce(F.concat(fixed(*lo), F.lit(" / "), fixed(*ro), F.lit(" / "), signed), F.lit("-"))


def length_cell(c: Column) -> Column:
    return fixed(c, 1)


def volume_cell(mm3: Column) -> Column:
    """mm^3 as cm^3."""
    return fixed(mm3 / lit(1000.0), 2)


def unreliable_vendor(vendor: Column) -> Column:
    """Vendors whose fallback conversion is known to be unreliable."""
    return F.coalesce(F.lower(vendor).isin(*C.UNRELIABLE_VENDORS), F.lit(False))


def gradients_missing(n_dims: Column, n_volumes: Column, bval: Column, bvec: Column) -> Column:
    """A 4-D image of several volumes without both gradient files."""
    return (n_dims == 4) & (n_volumes > 1) & (bval.isNull() | bvec.isNull())


def subject_session_labels(headers: DataFrame, keep_phi: bool = False) -> DataFrame:
    """Subject and session label of each study from its first header.

    ``headers``: study_id, path, patient_id, age, sex, study_date, given_subject, given_session.
    Different patients under one subject label would be merged by what follows, so their studies
    carry an ``error``.
    """
    def clean(c: str) -> Column:
        return F.nullif(F.trim(F.col(c)), F.lit(""))

    first = headers.groupBy("study_id").agg(F.min_by(F.struct(
        "patient_id", "age", "sex", "study_date", "given_subject", "given_session"), "path").alias("h")).select("study_id", "h.*")
    d = first.select("study_id", "given_subject", "given_session", *[clean(c).alias(c) for c in ("patient_id", "age", "sex")],
                     F.when(F.length(F.trim("study_date")) == 8, F.trim("study_date")).alias("study_date"))
    own = sanitize_label(F.col("patient_id")) if keep_phi else patient_hash(F.col("patient_id"))
    subject = F.regexp_replace(F.coalesce("given_subject", own), "^sub-", "")
    session = F.regexp_replace(F.coalesce("given_session", F.replace("study_date", F.lit("-"), F.lit("")), F.lit("01")), "^ses-", "")
    d = d.select("study_id", F.concat(F.lit("sub-"), subject).alias("subject_id"), F.concat(F.lit("ses-"), session).alias("session_id"),
                 age_years(F.col("age")).alias("age"), sex_code(F.col("sex")).alias("sex"), patient_key(F.col("patient_id")).alias("_key"))
    clash = label_collisions(d, "subject_id", "_key").select("subject_id", "error")
    return d.drop("_key").join(clash, "subject_id", "left")
