"""Reduced lattices: the exact nearest image in any cell, skewed or not, without a search radius.

A frame's periodic vectors are reduced (Gauss for two, Minkowski for three). In a reduced
cell the nearest image of a difference is among the 27 around its rounded coordinates, so a
frame carries 27 shifts at most, whatever the shape of its cell.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

PACKED = "_images"
_KIND = T.StructType([T.StructField(n, T.ArrayType(T.ArrayType(T.DoubleType()))) for n in ("dual", "cell", "shifts")])


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(-1)


def _gauss(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shortest basis of the planes spanned by ``u, v`` (one pair per row), the shorter vector first."""
    u, v = u.copy(), v.copy()
    todo = np.arange(len(u))
    while len(todo):
        a, b = u[todo], v[todo]
        swap = _dot(a, a) > _dot(b, b)
        a[swap], b[swap] = b[swap], a[swap].copy()
        n = np.rint(_dot(a, b) / _dot(a, a))
        b -= n[:, None] * a
        u[todo], v[todo] = a, b
        # a step that no longer shortens is rounding noise
        todo = todo[(n != 0) & (_dot(b, b) < _dot(a, a))]
    return u, v


def _minkowski(cells: np.ndarray) -> np.ndarray:
    """Minkowski-reduced bases of three-dimensional lattices (one per row)."""
    out = cells.copy()
    todo = np.arange(len(out))
    around = list(itertools.product((-1, 0, 1), repeat=2))
    while len(todo):
        c = out[todo]
        c = np.take_along_axis(c, np.argsort(_dot(c, c), axis=1, kind="stable")[:, :, None], 1)
        u, v = _gauss(c[:, 0], c[:, 1])
        w, old = c[:, 2], _dot(c[:, 2], c[:, 2])
        uu, vv, uv, wu, wv = _dot(u, u), _dot(v, v), _dot(u, v), _dot(w, u), _dot(w, v)
        det = uu * vv - uv * uv
        x, y = np.rint((wu * vv - wv * uv) / det), np.rint((wv * uu - wu * uv) / det)
        near = np.stack([w - (x + i)[:, None] * u - (y + j)[:, None] * v for i, j in around], 1)
        w = near[np.arange(len(near)), _dot(near, near).argmin(1)]
        out[todo] = np.stack([u, v, w], 1)
        size = _dot(w, w)
        todo = todo[(size < old * (1 - 1e-12)) & (size < _dot(v, v))]
    return out


def reduced_vectors(cell: np.ndarray, pbc: np.ndarray) -> np.ndarray:
    """Reduced periodic vectors of many cells (``n x 3 x 3``), zero rows for the open axes."""
    out = np.where(pbc[:, :, None], cell, 0.0)
    count = pbc.sum(1)
    for k in (2, 3):
        rows = np.flatnonzero(count == k)
        if len(rows):
            order = np.argsort(~pbc[rows], axis=1, kind="stable")
            v = np.take_along_axis(out[rows], order[:, :, None], 1)
            v[:, :k] = np.stack(_gauss(v[:, 0], v[:, 1]), 1) if k == 2 else _minkowski(v)
            # back to the places of the periodic axes
            back = np.zeros_like(v)
            np.put_along_axis(back, order[:, :, None], v, 1)
            out[rows] = back
    return out


def _packed(cell: np.ndarray, pbc: np.ndarray) -> pd.DataFrame:
    v = reduced_vectors(cell, pbc)
    # coordinates within the span of the periodic vectors, so an open axis need not be at right angles to them
    dual = np.swapaxes(np.linalg.pinv(v), 1, 2)
    steps = np.array(list(itertools.product((-1, 0, 1), repeat=3)), float)
    used = _dot(v, v) > 0
    shifts = [(steps[(steps[:, ~u] == 0).all(1)] @ c).tolist() for u, c in zip(used, v)]
    return pd.DataFrame({"dual": dual.tolist(), "cell": v.tolist(), "shifts": shifts})


def _numbers(col: pa.Array, size: int, rows: np.ndarray) -> np.ndarray:
    """``size`` numbers per row of a nested list column, zeros but in the given ``rows``."""
    flat = col.filter(pa.array(rows))
    while pa.types.is_list(flat.type) or pa.types.is_large_list(flat.type):
        flat = flat.flatten()
    out = np.zeros((len(col), size))
    out[rows] = flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
    return out


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists of lists, so many to an entry."""
    inner = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel()))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), inner)


def _cells(cell: pa.Array, pbc: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different cells of a batch, their periodic axes and the place of each row among them."""
    ok = ~(cell.is_null().to_numpy(zero_copy_only=False) | pbc.is_null().to_numpy(zero_copy_only=False))
    both, place = np.unique(np.hstack([_numbers(cell, 9, ok), _numbers(pbc, 3, ok)]), axis=0, return_inverse=True)
    c = both[:, :9].reshape(-1, 3, 3)
    return c, (both[:, 9:] != 0) & (_dot(c, c) > 0), place.ravel()


def _three(values: np.ndarray, place: np.ndarray) -> pa.Array:
    return _lists(values[place].reshape(-1, 3), np.full(len(place), 3))


@F.arrow_udf(_KIND)
def _images(cell: pa.Array, pbc: pa.Array) -> pa.Array:
    c, p, place = _cells(cell, pbc)
    found = _packed(c, p)
    shifts = [np.array(v) for v in found["shifts"]]
    size = np.array([len(v) for v in shifts], dtype=int)
    many = np.concatenate([shifts[i] for i in place]) if len(place) else np.zeros((0, 3))
    dual, reduced = (np.array(found[n].tolist()).reshape(-1, 3, 3) for n in ("dual", "cell"))
    return pa.StructArray.from_arrays([_three(dual, place), _three(reduced, place), _lists(many, size[place])], ["dual", "cell", "shifts"])


@F.arrow_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def _reduced(cell: pa.Array, pbc: pa.Array) -> pa.Array:
    c, p, place = _cells(cell, pbc)
    return _three(np.where(p[:, :, None], reduced_vectors(c, p), c), place)


_STEPS = np.array(list(itertools.product((-1, 0, 1), repeat=3)), float)
#: Pairs compared with their 27 images in one step.
_PAIRS = 4_096


@F.arrow_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in "dxyz"]))
def _shortest(dx: pa.Array, dy: pa.Array, dz: pa.Array, dual: pa.Array, cell: pa.Array) -> pa.Array:
    """:func:`nearest_image` of many differences at once; null cells are open, null differences stay null."""
    here = [~c.is_null().to_numpy(zero_copy_only=False) for c in (dual, cell, dx, dy, dz)]
    u, v = (_numbers(c, 9, here[0] & here[1]).reshape(-1, 3, 3) for c in (dual, cell))
    start = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in (dx, dy, dz)], 1)
    out = np.empty((len(start), 4))
    for a in range(0, len(start), _PAIRS):
        s, c = slice(a, a + _PAIRS), v[a:a + _PAIRS]
        turn = np.rint((u[s] * start[s, None]).sum(2))
        d = start[s] - turn[:, :1] * c[:, 0] - turn[:, 1:2] * c[:, 1] - turn[:, 2:] * c[:, 2]
        # zero rows of open axes repeat images, which changes no minimum
        at = d[:, None] + _STEPS @ c
        far = np.sqrt(at[..., 0] * at[..., 0] + at[..., 1] * at[..., 1] + at[..., 2] * at[..., 2])
        best, row = far.argmin(1), np.arange(len(d))
        out[s, 0], out[s, 1:] = far[row, best], at[row, best]
    gone = ~(here[2] & here[3] & here[4])
    return pa.StructArray.from_arrays([pa.array(out[:, i], mask=gone) for i in range(4)], list("dxyz"))


def reduced_lattice(lattice: DataFrame) -> DataFrame:
    """The same lattices with the shortest periodic vectors; vectors of open axes stay. Rows without cell or flags go."""
    return lattice.where("cell is not null and pbc is not null").select("frame", _reduced("cell", "pbc").alias("cell"), "pbc")


def packed_lattice(lattice: DataFrame) -> DataFrame:
    """``frame, _images`` of a lattice table ``frame, cell, pbc`` (one cell per frame): reduced vectors, their duals and the shifts to try.

    Vectors of periodic axes must be independent; a null cell or null flags, and vectors of length 0, count as open.
    """
    return lattice.select("frame", _images("cell", "pbc").alias(PACKED))


def nearest_image(dx: Column, dy: Column, dz: Column) -> Column:
    """The shortest image of a difference as ``struct<d, x, y, z>``; the row needs :func:`packed_lattice`'s column, null means open."""
    p = F.col(PACKED)
    start = F.struct(dx.alias("x"), dy.alias("y"), dz.alias("z"))

    def back(d: Column, j: int) -> Column:
        turn = lambda i: F.rint(p["dual"][i][0] * d["x"] + p["dual"][i][1] * d["y"] + p["dual"][i][2] * d["z"])
        return d["xyz"[j]] - turn(0) * p["cell"][0][j] - turn(1) * p["cell"][1][j] - turn(2) * p["cell"][2][j]

    def at(d: Column, s: Column | None) -> Column:
        x, y, z = (d[c] if s is None else d[c] + s[i] for i, c in enumerate("xyz"))
        return F.struct(F.sqrt(x * x + y * y + z * z).alias("d"), x.alias("x"), y.alias("y"), z.alias("z"))

    # one-element arrays name intermediate results inside the expression
    wrapped = F.transform(F.array(start), lambda d: F.struct(*[back(d, j).alias("xyz"[j]) for j in range(3)]))
    closest = F.transform(wrapped, lambda d: F.array_min(F.transform(p["shifts"], lambda s: at(d, s))))
    return F.when(p.isNull(), F.transform(F.array(start), lambda d: at(d, None))[0]).otherwise(closest[0])


def with_images_of(df: DataFrame, lattice: DataFrame | None) -> DataFrame:
    """Add the packed lattice of each row's frame; null where the frame has none."""
    if lattice is None:
        return df.withColumn(PACKED, F.lit(None).cast(_KIND))
    return df.join(packed_lattice(lattice), "frame", "left")


def with_shortest(df: DataFrame, lattice: DataFrame, name: str, a: str = "a_", b: str = "b_") -> DataFrame:
    """Add the nearest image of the difference of ``a`` and ``b`` coordinates of each row as ``struct<d, x, y, z>``."""
    d = [(F.col(f"{a}{c}") - F.col(f"{b}{c}")).cast("double") for c in ("px", "py", "pz")]
    packed = packed_lattice(lattice).select("frame", F.col(PACKED)["dual"].alias("_dual"), F.col(PACKED)["cell"].alias("_span"))
    return df.join(packed, "frame", "left").withColumn(name, _shortest(*d, "_dual", "_span")).drop("_dual", "_span")


def lattice_distance(df: DataFrame, lattice: DataFrame | None, name: str = "d", a: str = "a_", b: str = "b_") -> DataFrame:
    """Add the distance of ``a`` and ``b`` coordinates of each row, to the nearest image where the frame has a cell."""
    if lattice is None:
        d = [F.col(f"{a}{c}") - F.col(f"{b}{c}") for c in ("px", "py", "pz")]
        return df.withColumn(name, F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]))
    return with_shortest(df, lattice, "_near", a, b).withColumn(name, F.col("_near.d")).drop("_near")
