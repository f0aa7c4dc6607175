"""Laterality index of a left and a right value (H1)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tractloom import constants as C
from tractloom.functions.numeric import lit


def li_columns(left: Column, right: Column) -> dict[str, Column]:
    """laterality_index, absolute_difference, percent_difference and interpretation.

    A side without data is 0, so one side alone has index 1 or -1 and none at all gives "no data".
    """
    left, right = F.coalesce(left, lit(0.0)), F.coalesce(right, lit(0.0))
    total = left + right
    none = total == 0
    li = F.try_divide(left - right, total)
    diff = F.abs(left - right)
    mean = total / 2
    band = (F.when(F.abs(li) < C.LI_SYMMETRIC, "symmetric").when(F.abs(li) < C.LI_MILD, "mild asymmetry")
            .when(F.abs(li) < C.LI_MODERATE, "moderate asymmetry").otherwise("strong asymmetry"))
    side = F.when(li > 0, " (left > right)").when(li < 0, " (right > left)").otherwise("")
    return {
        "laterality_index": F.when(none, lit(0.0)).otherwise(li),
        "absolute_difference": F.when(none, lit(0.0)).otherwise(diff),
        "percent_difference": F.when(none | (mean <= 0), lit(0.0)).otherwise(F.try_divide(diff, mean) * 100),
        "interpretation": F.when(none, "no data").otherwise(F.concat(band, side)),
    }
