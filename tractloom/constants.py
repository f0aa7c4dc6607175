"""Fixed values the results depend on (thresholds, label codes, word lists, column orders)."""

# b-value at or below which a volume counts as b0 (s/mm^2)
B0_THRESHOLD = 50.0
SHELL_TOLERANCE = 0.05

# fractional-anisotropy thresholds: whole-brain and seeded
FA_THRESHOLD = 0.2
SEED_FA_THRESHOLD = 0.15

# seeds per voxel edge: whole-brain and extraction
SEED_DENSITY = 1
SEED_DENSITY_EXTRACT = 2

# length bands in mm (both ends inclusive)
LENGTH_BAND_PASSTHROUGH = (20.0, 200.0)
LENGTH_BAND_SEEDED = (30.0, 200.0)

# dilation steps of the regions
DILATE_BRAINSTEM = 2
DILATE_MOTOR = 1

# millimetres a streamline may stray over the midline
MIDLINE_TOLERANCE_MM = 8.0

# laterality bands
LI_SYMMETRIC = 0.05
LI_MILD = 0.10
LI_MODERATE = 0.20

ARTIFACT_INDEX_THRESHOLD = 0.20
RANDOM_SEED = 42

# atlas labels of the regions and the code each takes in the combined label volume
ROI_LABELS = {"brainstem": 8, "motor_left": 7, "motor_right": 107}
ROI_CODES = {"brainstem": 1, "motor_left": 2, "motor_right": 3}
RIGHT_LABEL_OFFSET = 100

SCALARS = ("fa", "md", "rd", "ad")
PROFILE_POINTS = 20
PROFILE_MIN_SAMPLES = 5
# region, first and last fraction of the tract counted from its lower end
TRACT_REGIONS = (("pontine", 0.0, 0.35), ("plic", 0.35, 0.70), ("precentral", 0.70, 1.0))

# BIDS entity order of a file name
BIDS_ENTITY_ORDER = (
    "sub", "ses", "task", "acq", "ce", "rec", "dir", "run", "mod", "echo",
    "flip", "inv", "mt", "space", "res", "den", "label", "desc", "model", "param",
)

# suffixes taken off a stem, first match wins
STEM_SUFFIXES = (
    "_dwi_preproc_nomc", "_dwi_preproc_mc", "_preproc_nomc", "_preproc_mc", "_preproc", "_dwi",
)
# suffixes tried, in turn, when a preprocessed image has no gradient files under its own stem
GRADIENT_STEM_SUFFIXES = ("_preproc", "_dwi_preproc_nomc", "_dwi_preproc_mc", "_dwi_preproc")

# vendors whose conversion is known to lose gradients
UNRELIABLE_VENDORS = ("philips", "ge", "ge medical systems", "hitachi")

# tolerance per metric family, tried in this order on the lower-cased key
METRIC_TOLERANCES = (
    ("fa", 1e-8, 1e-9),
    ("md", 1e-8, 1e-12),
    ("rd", 1e-8, 1e-12),
    ("ad", 1e-8, 1e-12),
    ("li", 1e-8, 1e-9),
    ("lateral", 1e-8, 1e-9),
)
DEFAULT_TOLERANCE = (1e-8, 1e-9)

# series scan limits
DICOM_MAX_DEPTH = 3
DICOM_MIN_FILES = 10


def cohort_headers() -> list[str]:
    """The 78 columns of the cohort table, in order."""
    cols = [
        "subject_id", "session_id", "status", "error_category", "duration_seconds", "error",
        "left_n_streamlines", "right_n_streamlines",
        "left_mean_length_mm", "right_mean_length_mm",
        "left_tract_volume_mm3", "right_tract_volume_mm3",
        "volume_laterality_index", "streamline_count_laterality_index",
    ]
    for s in SCALARS:
        cols += [f"left_{s}_mean", f"left_{s}_std", f"right_{s}_mean", f"right_{s}_std",
                 f"{s}_laterality_index",
                 f"left_{s}_mean_point_weighted", f"right_{s}_mean_point_weighted"]
        for region, _, _ in TRACT_REGIONS:
            cols += [f"left_{s}_{region}", f"right_{s}_{region}", f"{s}_{region}_laterality_index"]
    return cols

#: Files that an extraction writes, by their names in its report.
EXTRACTION_OUTPUTS = ("cst_left", "cst_right", "cst_combined")

#: Places to which a mean coordinate (mm) is rounded before it is compared with a plane; sums in another order differ by less.
MEAN_PLACES = 9
