"""All registered queries; importing this module loads them."""

from tractloom.plans import (q_acquisition, q_cohort, q_compare, q_extract, q_fields, q_geometry,  # noqa: F401
                             q_metrics, q_reports, q_rois, q_series)
from tractloom.plans.registry import ORACLE, QUERIES  # noqa: F401
