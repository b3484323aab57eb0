"""Column expressions shared by the operators; all of them run inside the JVM."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from sievelark.functions.fixed import COVALENT_RADII, SYMBOLS


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def all_of(*conds: Column) -> Column:
    return reduce(lambda a, b: a & b, conds)


def as_double(arr: Column | str) -> Column:
    return col(arr).cast("array<double>")


# --- vectors ---------------------------------------------------------------

def sq_l2(a: Column | str, b: Column | str) -> Column:
    d = F.zip_with(col(a), col(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(d, F.lit(0.0), lambda s, v: s + v)


def l2(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(sq_l2(a, b))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def distance3(ax, ay, az, bx, by, bz) -> Column:
    dx, dy, dz = col(ax) - col(bx), col(ay) - col(by), col(az) - col(bz)
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def wrap_delta(delta: Column, length: Column | float) -> Column:
    """Minimum-image difference along one orthogonal periodic axis (half-to-even rounding)."""
    length = length if isinstance(length, Column) else F.lit(float(length))
    return delta - F.rint(delta / length) * length


def wrapped_distance3(dx: Column, dy: Column, dz: Column, cell: tuple[float, float, float] | None,
                      pbc: tuple[bool, bool, bool] = (True, True, False)) -> Column:
    if cell is not None:
        dx = wrap_delta(dx, cell[0]) if pbc[0] else dx
        dy = wrap_delta(dy, cell[1]) if pbc[1] else dy
        dz = wrap_delta(dz, cell[2]) if pbc[2] else dz
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def mic_image_distance(dx: Column, dy: Column, dz: Column, cell) -> Column:
    """Shortest distance over the 27 neighbouring images of a reduced 3x3 cell."""
    cell = np.asarray(cell, dtype=float)
    best = None
    for i in (-1, 0, 1):
        for j in (-1, 0, 1):
            for k in (-1, 0, 1):
                sx, sy, sz = (float(v) for v in i * cell[0] + j * cell[1] + k * cell[2])
                d2 = (dx + sx) * (dx + sx) + (dy + sy) * (dy + sy) + (dz + sz) * (dz + sz)
                best = d2 if best is None else F.least(best, d2)
    return F.sqrt(best)


def is_orthogonal(a, b, c, tol: float = 1e-8) -> Column:
    return (F.abs(dot(a, b)) <= tol) & (F.abs(dot(a, c)) <= tol) & (F.abs(dot(b, c)) <= tol)


# --- NaN-aware predicates --------------------------------------------------

def within(d: Column, t: Column | float) -> Column:
    """``d <= t`` that is false for NaN and NULL."""
    return F.coalesce(~F.isnan(d) & (d <= t), F.lit(False))


def at_least(d: Column, t: Column | float) -> Column:
    return F.coalesce(~F.isnan(d) & (d >= t), F.lit(False))


def finite(c: Column | str) -> Column:
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def nan_last(c: Column | str) -> Column:
    """Sort value where NaN and NULL become +inf."""
    c = col(c).cast("double")
    return F.when(c.isNull() | F.isnan(c), F.lit(float("inf"))).otherwise(c)


def safe_ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den)


# --- classification --------------------------------------------------------

def tilt_bin(deg: Column | str) -> Column:
    deg = col(deg)
    return (F.when(~finite(deg), "unknown").when(deg < 10.0, "upright")
            .when(deg < 60.0, "tilted").otherwise("flat"))


def planar_bin(deg: Column | str) -> Column:
    """Family of a flat molecule from the angle between its plane normal and the surface normal."""
    deg = col(deg)
    return F.when(~finite(deg), "unknown").when(deg < 20.0, "flat").when(deg < 70.0, "tilted").otherwise("upright")


def tilt_deg(vx: Column, vy: Column, vz: Column, nx=0.0, ny=0.0, nz=1.0) -> Column:
    """Unsigned angle between a direction and a unit normal, in degrees."""
    norm = F.sqrt(vx * vx + vy * vy + vz * vz)
    cosine = F.abs(vx * nx + vy * ny + vz * nz) / norm
    return F.degrees(F.acos(F.least(F.lit(1.0), cosine)))


def quaternion_angle(a: Column | str, b: Column | str) -> Column:
    return 2.0 * F.acos(F.least(F.lit(1.0), F.abs(dot(a, b))))


def quaternion_product(a: Column | str, b: Column | str) -> Column:
    """Hamilton product of two ``[w, x, y, z]`` arrays."""
    p, q = [col(a)[i] for i in range(4)], [col(b)[i] for i in range(4)]
    return F.array(
        p[0] * q[0] - p[1] * q[1] - p[2] * q[2] - p[3] * q[3],
        p[0] * q[1] + p[1] * q[0] + p[2] * q[3] - p[3] * q[2],
        p[0] * q[2] - p[1] * q[3] + p[2] * q[0] + p[3] * q[1],
        p[0] * q[3] + p[1] * q[2] - p[2] * q[1] + p[3] * q[0],
    )


def axis_quaternion(axis: tuple[float, float, float], angle: Column) -> Column:
    n = float(np.linalg.norm(axis)) or 1.0
    s = F.sin(angle / 2.0)
    return F.array(F.cos(angle / 2.0), s * (axis[0] / n), s * (axis[1] / n), s * (axis[2] / n))


def rotate(q: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Rotate a point by a unit quaternion."""
    w, a, b, c = (q[i] for i in range(4))
    return (
        (1 - 2 * (b * b + c * c)) * x + 2 * (a * b - w * c) * y + 2 * (a * c + w * b) * z,
        2 * (a * b + w * c) * x + (1 - 2 * (a * a + c * c)) * y + 2 * (b * c - w * a) * z,
        2 * (a * c - w * b) * x + 2 * (b * c + w * a) * y + (1 - 2 * (a * a + b * b)) * z,
    )


# --- symmetric 3x3 eigenvalues (trigonometric form) ------------------------

def sym3_eigenvalues(a, b, c, d, e, f) -> tuple[Column, Column, Column]:
    """Descending eigenvalues of ``[[a,d,e],[d,b,f],[e,f,c]]``."""
    a, b, c, d, e, f = (col(v) for v in (a, b, c, d, e, f))
    q = (a + b + c) / 3.0
    p2 = ((a - q) * (a - q) + (b - q) * (b - q) + (c - q) * (c - q) + 2.0 * (d * d + e * e + f * f)) / 6.0
    p = F.sqrt(p2)
    det = ((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e))
    r = F.when(p2 > 0, det / (2.0 * p2 * p)).otherwise(F.lit(1.0))
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))) / 3.0
    hi = q + 2.0 * p * F.cos(phi)
    lo = q + 2.0 * p * F.cos(phi + 2.0 * np.pi / 3.0)
    return hi, 3.0 * q - hi - lo, lo


# --- text and hashes -------------------------------------------------------

def short_sha1(text: Column, n: int = 16) -> Column:
    return F.substring(F.sha1(text.cast("binary")), 1, n)


def safe_name(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"[^A-Za-z0-9_.\-]+", "_")


def fixed_decimals(c: Column | str, digits: int = 3) -> Column:
    """``%.{digits}f`` rounded half-to-even on the exact binary value, as C and Python print it."""
    @F.pandas_udf("string")
    def fmt(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else f"{v:.{digits}f}")

    return fmt(col(c).cast("double"))


def format_float(c: Column | str, digits: int = 8) -> Column:
    c = col(c)
    return F.when(c.isNull() | F.isnan(c), F.lit("nan")).otherwise(fixed_decimals(c, digits))


def ratio_text(num: Column, den: Column) -> Column:
    """``a/b (p%)`` with one decimal."""
    pct = F.when(den > 0, F.round(100.0 * num / den, 1)).otherwise(F.lit(0.0))
    return F.concat(num.cast("string"), F.lit("/"), den.cast("string"), F.lit(" ("), F.format_string("%.1f", pct), F.lit("%)"))


def norm_token(c: Column | str) -> Column:
    return F.lower(F.trim(col(c)))


# --- element tables --------------------------------------------------------

def covalent_radius(z: Column | str) -> Column:
    """Radius by atomic number from a literal array: no join needed."""
    table = F.array(*[F.lit(v) for v in COVALENT_RADII])
    return F.try_element_at(table, col(z).cast("int"))


def symbol_of(z: Column | str) -> Column:
    return F.try_element_at(F.array(*[F.lit(s) for s in SYMBOLS]), col(z).cast("int"))
