"""Voxel-wise diffusion tensor fit and its scalar maps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tractloom.functions.numeric import finite_or_zero, lit
from tractloom.functions.stage import materialize

VOX = ["subject_id", "i", "j", "k"]
COEF = ("dxx", "dyy", "dzz", "dxy", "dxz", "dyz", "ln_s0")
MIN_SIGNAL = 1e-4


def _design(b: Column, x: Column, y: Column, z: Column) -> list[Column]:
    """Row of the log-linear model ln S = -b g'Dg + ln S0."""
    return [-b * x * x, -b * y * y, -b * z * z, lit(-2.0) * b * x * y, lit(-2.0) * b * x * z, lit(-2.0) * b * y * z, lit(1.0)]


def tensor_scalars(d: DataFrame) -> DataFrame:
    """FA, MD, RD, AD from tensor elements: closed-form eigenvalues of a symmetric 3x3 matrix.

    Eigenvalues below 0 become 0; NaN and infinities become 0.
    """
    c = F.col
    q = (c("dxx") + c("dyy") + c("dzz")) / lit(3.0)
    off = c("dxy") * c("dxy") + c("dxz") * c("dxz") + c("dyz") * c("dyz")
    d = d.withColumn("_q", q)
    a, b, e = c("dxx") - c("_q"), c("dyy") - c("_q"), c("dzz") - c("_q")
    d = d.withColumn("_p", F.sqrt((a * a + b * b + e * e + lit(2.0) * off) / lit(6.0)))
    det = (a * (b * e - c("dyz") * c("dyz")) - c("dxy") * (c("dxy") * e - c("dyz") * c("dxz"))
           + c("dxz") * (c("dxy") * c("dyz") - b * c("dxz")))
    r = F.coalesce(F.try_divide(det, lit(2.0) * c("_p") * c("_p") * c("_p")), lit(0.0))
    phi = F.acos(F.greatest(lit(-1.0), F.least(lit(1.0), r))) / lit(3.0)
    d = d.withColumn("_phi", phi)
    l1 = c("_q") + lit(2.0) * c("_p") * F.cos("_phi")
    l3 = c("_q") + lit(2.0) * c("_p") * F.cos(c("_phi") + lit(2.0 * np.pi / 3.0))
    d = d.withColumns({"_l1": l1, "_l3": l3}).withColumn("_l2", lit(3.0) * c("_q") - c("_l1") - c("_l3"))
    d = d.withColumns({n: F.greatest(c(n), lit(0.0)) for n in ("_l1", "_l2", "_l3")})
    x, y, z = c("_l1"), c("_l2"), c("_l3")
    norm = x * x + y * y + z * z
    fa = F.sqrt(lit(0.5) * ((x - y) * (x - y) + (y - z) * (y - z) + (z - x) * (z - x))) / F.sqrt(norm)
    maps = {"fa": F.when(norm == 0, lit(0.0)).otherwise(fa), "md": (x + y + z) / lit(3.0), "rd": (y + z) / lit(2.0), "ad": x}
    return d.withColumns({n: finite_or_zero(m) for n, m in maps.items()}).drop("_q", "_p", "_phi", "_l1", "_l2", "_l3")


def solver_rows(gradients: DataFrame) -> DataFrame:
    """Pseudo-inverse of each subject's design matrix, one array of 7 weights per volume.

    ``gradients`` (subject_id, vol_idx, bval, bx, by, bz). The normal matrix is a sum of 28
    products per subject, so it is aggregated map-side; only that 7x7 matrix per subject is
    inverted, and the weights of a volume follow row by row.
    """
    g = gradients.select("subject_id", "vol_idx", F.array(*_design(F.col("bval"), F.col("bx"), F.col("by"), F.col("bz"))).alias("row"))
    pairs = [(r, c) for r in range(7) for c in range(r, 7)]
    normal = g.groupBy("subject_id").agg(*[F.sum(F.col("row")[r] * F.col("row")[c]).alias(f"n{r}{c}") for r, c in pairs])
    normal = normal.select("subject_id", F.array(*[F.col(f"n{min(r, c)}{max(r, c)}") for r in range(7) for c in range(7)]).alias("m"))
    inv = normal.withColumn("inv", _invert7(F.col("m"))).drop("m")
    d = g.join(inv, ["subject_id"])
    w = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda r: F.aggregate(
        F.sequence(F.lit(0), F.lit(6)), lit(0.0), lambda acc, c: acc + F.get("inv", r * 7 + c) * F.get("row", c)))
    return d.select("subject_id", "vol_idx", w.alias("weights"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _invert7(m: pd.Series) -> pd.Series:
    """Pseudo-inverse of 7x7 normal matrices."""
    return pd.Series(list(_scaled_pinv(m).reshape(-1, 49)))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _solve7(m: pd.Series, t: pd.Series) -> pd.Series:
    """Least-squares solutions of 7x7 normal equations."""
    return pd.Series(list(np.einsum("nij,nj->ni", _scaled_pinv(m), np.stack(t.map(np.asarray).to_list()))))


def _scaled_pinv(m: pd.Series) -> np.ndarray:
    """Pseudo-inverses with the unknowns scaled to unit diagonal first."""
    a = np.stack(m.map(np.asarray).to_list()).reshape(-1, 7, 7)
    s = np.sqrt(np.einsum("nii->ni", a))
    s[s == 0] = 1.0
    return np.linalg.pinv(a / s[:, :, None] / s[:, None, :], rcond=1e-13) / s[:, :, None] / s[:, None, :]


def fit_ols(signals: DataFrame, gradients: DataFrame) -> DataFrame:
    """A28, ordinary least squares on ln(signal).

    ``signals``: subject_id, i, j, k, vol_idx, signal (brain voxels, long). Each volume's 7 weights
    meet the signals on (subject, volume); a voxel's coefficients are then 7 sums, combined before
    the shuffle on the voxel.
    """
    w = solver_rows(gradients)
    s = signals.withColumn("ln", F.log(F.greatest(F.col("signal"), lit(MIN_SIGNAL))))
    s = s.join(w, ["subject_id", "vol_idx"])
    g = s.groupBy(*VOX).agg(*[F.sum(F.col("weights")[n] * F.col("ln")).alias(c) for n, c in enumerate(COEF)])
    return tensor_scalars(g).select(*VOX, *COEF, "fa", "md", "rd", "ad")


def fit_wls(signals: DataFrame, gradients: DataFrame) -> DataFrame:
    """A28, weighted least squares (the default): weights are the squared signals of the OLS fit.

    Same long input as ``fit_ols``. The OLS coefficients go back to each signal, the weighted normal
    equations of a voxel are 35 sums combined before the shuffle, and only those compact rows are
    solved, in Arrow batches. No voxel's volumes are gathered.
    """
    coef = materialize(fit_ols(signals, gradients).select(*VOX, F.array(*COEF).alias("coef")))
    rows = gradients.select("subject_id", "vol_idx", F.array(*_design(
        F.col("bval"), F.col("bx"), F.col("by"), F.col("bz"))).alias("row"))
    d = signals.join(rows, ["subject_id", "vol_idx"])
    d = d.join(coef, VOX)
    r = [F.col("row")[n] for n in range(7)]
    fitted = sum((r[n] * F.col("coef")[n] for n in range(1, 7)), r[0] * F.col("coef")[0])
    d = d.select(*VOX, "row", F.exp(lit(2.0) * fitted).alias("w"), F.log(F.greatest(F.col("signal"), lit(MIN_SIGNAL))).alias("ln"))
    pairs = [(a, b) for a in range(7) for b in range(a, 7)]
    g = d.groupBy(*VOX).agg(*[F.sum(r[a] * r[b] * F.col("w")).alias(f"n{a}{b}") for a, b in pairs],
                            *[F.sum(r[a] * F.col("ln") * F.col("w")).alias(f"t{a}") for a in range(7)])
    normal = F.array(*[F.col(f"n{min(a, b)}{max(a, b)}") for a in range(7) for b in range(7)])
    g = g.select(*VOX, _solve7(normal, F.array(*[F.col(f"t{a}") for a in range(7)])).alias("c"))
    g = g.select(*VOX, *[F.col("c")[n].alias(c) for n, c in enumerate(COEF)])
    return tensor_scalars(g).select(*VOX, *COEF, "fa", "md", "rd", "ad")
