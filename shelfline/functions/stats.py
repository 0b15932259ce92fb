"""Normal and gamma probability functions as plain column arithmetic, so they
stay inside whole-stage codegen."""
import math

import numpy as np
from pyspark.sql import Column, functions as F

# fixed values: Abramowitz & Stegun 26.2.17
_AS_P = 0.2316419
_AS_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
_SQRT_2PI = 2.5066282746310002

# fixed values: Acklam's rational approximation of the normal quantile
ACKLAM_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
            1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
ACKLAM_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
            6.680131188771972e+01, -1.328068155288572e+01)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
            -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
            3.754408661907416e+00)
ACKLAM_LOW = 0.02425


def _horner(coefs, x):
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def norm_cdf(x: Column) -> Column:
    ax = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(_AS_P) * ax)
    tail = F.exp(-(ax * ax) / 2.0) / F.lit(_SQRT_2PI) * t * _horner(tuple(reversed(_AS_B)), t)
    return F.when(x >= 0, F.lit(1.0) - tail).otherwise(tail)


def norm_ppf(p: Column) -> Column:
    q = p - 0.5
    r = q * q
    centre = _horner(ACKLAM_A, r) * q / (_horner(ACKLAM_B, r) * r + 1.0)
    lo = F.sqrt(F.lit(-2.0) * F.ln(p))
    hi = F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - p))
    tail = lambda s: _horner(ACKLAM_C, s) / (_horner(ACKLAM_D, s) * s + 1.0)
    return (F.when(p < ACKLAM_LOW, tail(lo))
            .when(p > 1.0 - ACKLAM_LOW, -tail(hi))
            .otherwise(centre))


def gamma_ppf(p: Column, shape: Column, scale: Column) -> Column:
    """Wilson-Hilferty cube approximation of the gamma quantile."""
    c = F.lit(1.0) / (F.lit(9.0) * shape)
    root = F.lit(1.0) - c + norm_ppf(p) * F.sqrt(c)
    return F.greatest(F.lit(0.0), shape * scale * root * root * root)


def normal_point(p: float) -> float:
    """norm_ppf of a constant."""
    def horner(coefs, x):
        acc = coefs[0]
        for c in coefs[1:]:
            acc = acc * x + c
        return acc

    if ACKLAM_LOW <= p <= 1.0 - ACKLAM_LOW:
        q = p - 0.5
        return horner(ACKLAM_A, q * q) * q / (horner(ACKLAM_B, q * q) * (q * q) + 1.0)
    s = math.sqrt(-2.0 * math.log(min(p, 1.0 - p)))
    tail = horner(ACKLAM_C, s) / (horner(ACKLAM_D, s) * s + 1.0)
    return tail if p < 0.5 else -tail


def gamma_points(points, shape: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """gamma_ppf at constant points: rows x points."""
    z, c = np.array([normal_point(p) for p in points]), (1.0 / (9.0 * shape))[:, None]
    root = 1.0 - c + z * np.sqrt(c)
    return np.maximum(0.0, (shape * scale)[:, None] * root * root * root)


def r(col, digits: int = 6) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col.cast("double"), digits)
