"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def r6(c: Column | str) -> Column:
    """Six decimals, without negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def to_u8(c: Column) -> Column:
    """Scaled by 255, clipped and cut to whole numbers."""
    return F.floor(clip(c * 255.0, 0.0, 255.0)).cast("double")


def singular_values(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column]:
    """Of the matrix [[a, b], [c, d]], the larger first."""
    q = F.hypot((a + d) / 2, (c - b) / 2)
    r = F.hypot((a - d) / 2, (c + b) / 2)
    return q + r, F.abs(q - r)


def condition_number(a: Column, b: Column, c: Column, d: Column) -> Column:
    high, low = singular_values(a, b, c, d)
    return high / (low + 1e-8)


def plausible(a: Column, b: Column, c: Column, d: Column, most_scale: float = 20.0, least_scale: float = 0.05, most_condition: float = 50.0) -> Column:
    """Whether the linear part keeps orientation and neither blows up, collapses nor shears too far."""
    high, low = singular_values(a, b, c, d)
    return (a * d - b * c > 0) & (high <= most_scale) & (low >= least_scale) & (condition_number(a, b, c, d) <= most_condition)


def matmul3(a: str, b: str) -> Column:
    """The product of two 3x3 matrices, arrays of 9 in row order."""
    at = lambda m, i, j: F.get(m, F.lit(3 * i + j))
    return F.array(*[sum((at(a, i, k) * at(b, k, j) for k in range(1, 3)), at(a, i, 0) * at(b, 0, j)) for i in range(3) for j in range(3)])


def invert3(m: str) -> Column:
    """The inverse by cofactors; null where the determinant is zero."""
    at = lambda i, j: F.get(m, F.lit(3 * (i % 3) + j % 3))
    cof = lambda i, j: at(i + 1, j + 1) * at(i + 2, j + 2) - at(i + 1, j + 2) * at(i + 2, j + 1)
    det = at(0, 0) * cof(0, 0) + at(0, 1) * cof(0, 1) + at(0, 2) * cof(0, 2)
    return F.when(det != 0, F.array(*[cof(j, i) / det for i in range(3) for j in range(3)]))


def apply_homography(m: Sequence[Column], x: Column, y: Column, eps: float = 1e-8) -> tuple[Column, Column]:
    w = m[6] * x + m[7] * y + m[8] + eps
    return (m[0] * x + m[1] * y + m[2]) / w, (m[3] * x + m[4] * y + m[5]) / w


def fixed(c: Column, digits: int) -> Column:
    """Fixed-point text with ``digits`` decimals; ties go away from zero."""
    return F.format_string(f"%.{digits}f", c)


def metric_text(c: Column, digits: int = 3) -> Column:
    """Report text: null is a dash, NaN and infinities are named."""
    return F.when(c.isNull(), "-").when(F.isnan(c), "nan").when(c == float("inf"), "∞").otherwise(fixed(c, digits))
