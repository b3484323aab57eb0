"""Operators over atom tables.

An atom table has one row per atom: ``frame, atom, is_ads, z, px, py, pz`` (frame id, atom
id, adsorbate flag, atomic number, coordinates). Everything is a join or an aggregate over
that table, so a frame of any size spreads over the cluster.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from sievelark.functions.exprs import (col, covalent_radius, distance3, safe_ratio, short_sha1, sym3_eigenvalues, symbol_of, wrap_delta,
                                       wrapped_distance3)
from sievelark.functions.fixed import COVALENT_RADII
from sievelark.operators.lattice import lattice_distance, reduced_lattice, with_shortest
from sievelark.session import settle

FEW = 512  # frames up to this size are joined without a grid
ATOM = ["frame", "atom", "is_ads", "z", "px", "py", "pz"]
WIDEST = 2.0 * max(COVALENT_RADII)


def explode_frames(frames: DataFrame) -> DataFrame:
    """Frame rows (``frame_id, numbers, positions, slab_n``) to an atom table."""
    return frames.select(F.col("frame_id").alias("frame"), "slab_n",
                         F.posexplode(F.arrays_zip("numbers", "positions")).alias("atom", "a")).select(
        "frame", F.col("atom").cast("long").alias("atom"), (F.col("atom") >= F.col("slab_n")).alias("is_ads"),
        F.col("a.numbers").alias("z"), F.col("a.positions")[0].alias("px"), F.col("a.positions")[1].alias("py"),
        F.col("a.positions")[2].alias("pz"))


def _cells(df: DataFrame, width: float, spread: bool, cell, pbc) -> DataFrame:
    """Grid cell of each atom; with ``spread`` one row per neighbouring cell.

    Along a periodic axis the cells tile the period exactly and neighbours wrap around.
    """
    wrap = [max(1, int(cell[i] // width)) if cell is not None and pbc[i] else None for i in range(3)]
    size = [cell[i] / n if n else width for i, n in enumerate(wrap)]

    def index(v: Column, n: int | None) -> Column:
        return v if n is None else F.pmod(v, F.lit(n).cast("long"))

    at = [index(F.floor(F.col(p) / w).cast("long"), n) for p, w, n in zip(("px", "py", "pz"), size, wrap)]
    j = df.withColumn("_c", F.array(*at))
    if not spread:
        return j
    around = [F.array(*[index(F.col("_c")[i] + F.lit(o[i]), wrap[i]) for i in range(3)]) for o in itertools.product((-1, 0, 1), repeat=3)]
    return j.withColumn("_c", F.explode(F.array_distinct(F.array(*around))))


def atoms_within(a: DataFrame, b: DataFrame, cutoff: Column | float, *, max_cutoff: float, cell=None,
                 pbc=(True, True, False), extra: Column | None = None) -> DataFrame:
    """Pairs (``a_*``, ``b_*``, ``d``) of the same frame with ``d <= cutoff``.

    Frames of up to ``FEW`` rows meet by their frame alone, so each table is shuffled once. Large frames
    are blocked by a grid at least as wide as the largest cutoff; a periodic ``cell`` (orthogonal
    lengths) wraps both the distances and the grid.
    """
    big = large_frames(a, b)
    few = lambda df: df if big is None else df.join(big, "frame", "left_anti")
    j = _paired(few(a), few(b))
    if big is not None:
        many = lambda df: df.join(big, "frame", "left_semi")
        side = lambda df, name, spread: _cells(many(df), max_cutoff, spread, cell, pbc).select(
            "frame", "_c", *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != "frame"])
        j = j.unionByName(side(a, "a", False).join(side(b, "b", True), ["frame", "_c"]).drop("_c"))
    d = wrapped_distance3(F.col("a_px") - F.col("b_px"), F.col("a_py") - F.col("b_py"), F.col("a_pz") - F.col("b_pz"), cell, pbc)
    if extra is not None:
        j = j.where(extra)
    cutoff = cutoff if isinstance(cutoff, Column) else F.lit(float(cutoff))
    return j.withColumn("d", d).where(F.col("d") <= cutoff)


# --- periodic frames ---------------------------------------------------------

def _cross(a: Column, b: Column) -> Column:
    return F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def _dot(a: Column, b: Column) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def wrap_atoms(atoms: DataFrame, lattice: DataFrame) -> DataFrame:
    """Atoms moved into their frame's cell along its periodic axes; frames without a lattice stay.

    ``lattice``: ``frame, cell`` (three vectors) ``, pbc`` (three booleans); any cell of non-zero
    volume, skewed or not, one per frame; it is reduced first, so few images suffice. Adds ``_cell, _pbc, _high`` (distance between opposite
    faces), which :func:`with_images` uses.
    """
    l = reduced_lattice(lattice).select("frame", F.col("cell").alias("_cell"), F.col("pbc").alias("_pbc"))
    c = [F.col("_cell")[i] for i in range(3)]
    faces = [_cross(c[1], c[2]), _cross(c[2], c[0]), _cross(c[0], c[1])]
    volume = _dot(c[0], faces[0])
    j = atoms.join(l, "frame", "left")
    at = F.array("px", "py", "pz")
    turns = [F.when(F.col("_pbc")[i], F.floor(_dot(at, faces[i]) / volume).cast("double")).otherwise(0.0) for i in range(3)]
    moved = [F.col(p) - F.coalesce(turns[0] * c[0][k] + turns[1] * c[1][k] + turns[2] * c[2][k], F.lit(0.0)) for k, p in enumerate(("px", "py", "pz"))]
    high = F.when(F.col("_cell").isNotNull(), F.array(*[F.abs(volume) / F.sqrt(_dot(f, f)) for f in faces]))
    return j.withColumns(dict(zip(("px", "py", "pz"), moved)) | {"_high": high})


def with_images(wrapped: DataFrame, reach: float) -> DataFrame:
    """Wrapped atoms and all their images that may lie within ``reach`` of a wrapped atom."""
    def steps(i: int) -> Column:
        n = F.floor(F.lit(float(reach)) / F.col("_high")[i] + 1.0).cast("int")
        return F.when(F.coalesce(F.col("_pbc")[i], F.lit(False)), F.sequence(-n, n)).otherwise(F.array(F.lit(0)))

    j = wrapped
    for i in range(3):
        j = j.withColumn(f"_s{i}", F.explode(steps(i)))
    shift = lambda k: F.coalesce(sum((F.col(f"_s{i}") * F.col("_cell")[i][k] for i in (1, 2)), F.col("_s0") * F.col("_cell")[0][k]), F.lit(0.0))
    j = j.withColumns({p: F.col(p) + shift(k) for k, p in enumerate(("px", "py", "pz"))})
    return j.drop("_s0", "_s1", "_s2", "_cell", "_pbc", "_high")


def large_frames(a: DataFrame, b: DataFrame) -> DataFrame | None:
    """Frames of more than ``FEW`` rows in both tables together; None if there are none."""
    n = a.select("frame").unionByName(b.select("frame")).groupBy("frame").agg(F.count(F.lit(1)).alias("_n"))
    big = settle(n.where(F.col("_n") > FEW).select("frame"))
    return None if big.isEmpty() else big


def _paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of the same frame side by side as ``a_*, b_*``."""
    side = lambda df, name: df.select("frame", *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != "frame"])
    return side(a, "a").join(side(b, "b"), "frame")


def atoms_within_images(a: DataFrame, b: DataFrame, cutoff: Column | float, *, max_cutoff: float, lattice: DataFrame, extra: Column | None = None) -> DataFrame:
    """Like :func:`atoms_within` with one periodic cell per frame: ``d`` is the distance to the nearest image, ``b_p*`` its place.

    Frames of up to ``FEW`` rows compare all pairs at their nearest images; larger ones lay out the
    images within ``max_cutoff`` and search them by a grid.
    """
    at = ("px", "py", "pz")
    big = large_frames(a, b)
    few = lambda df: df if big is None else df.join(big, "frame", "left_anti")
    p = _paired(few(a), few(b))
    p = with_shortest(p if extra is None else p.where(extra), lattice, "_near").withColumn("d", F.col("_near.d"))
    p = p.where(F.col("d") <= (cutoff if isinstance(cutoff, Column) else F.lit(float(cutoff))))
    p = p.withColumns({f"b_{c}": F.col(f"a_{c}") - F.col(f"_near.{x}") for c, x in zip(at, "xyz")}).drop("_near")
    if big is not None:
        many = lambda df: wrap_atoms(df.join(big, "frame", "left_semi"), lattice)
        moved = many(a.withColumns({f"_o{c}": F.col(c) for c in at})).drop("_cell", "_pbc", "_high")
        q = atoms_within(moved, with_images(many(b), max_cutoff), cutoff, max_cutoff=max_cutoff, extra=extra)
        back = {f"b_{c}": F.col(f"b_{c}") + F.col(f"a__o{c}") - F.col(f"a_{c}") for c in at}
        q = q.withColumns(back).withColumns({f"a_{c}": F.col(f"a__o{c}") for c in at})
        p = p.unionByName(q.drop(*[f"a__o{c}" for c in at]))
    keys = ["frame", *[c for c in p.columns if c not in ("frame", "d", "b_px", "b_py", "b_pz")]]
    return p.groupBy(*keys).agg(*[F.min_by(f"b_{c}", "d").alias(f"b_{c}") for c in at], F.min("d").alias("d"))


def _contacts(a: DataFrame, b: DataFrame, cutoff, *, max_cutoff: float, lattice: DataFrame | None = None, extra: Column | None = None, **cell) -> DataFrame:
    if lattice is None:
        return atoms_within(a, b, cutoff, max_cutoff=max_cutoff, extra=extra, **cell)
    return atoms_within_images(a, b, cutoff, max_cutoff=max_cutoff, lattice=lattice, extra=extra)


def _radii_sum() -> Column:
    return covalent_radius("a_z") + covalent_radius("b_z")


def bonds(atoms: DataFrame, tau: float = 1.20, lattice: DataFrame | None = None) -> DataFrame:
    """Adsorbate bonds ``frame, i, j`` with ``d <= tau (ri + rj)``, ``i < j``."""
    ads = atoms.where("is_ads").select("frame", "atom", "z", "px", "py", "pz")
    p = _contacts(ads, ads, tau * _radii_sum(), max_cutoff=tau * WIDEST, extra=F.col("a_atom") < F.col("b_atom"), lattice=lattice)
    return p.select("frame", F.col("a_atom").alias("i"), F.col("b_atom").alias("j"), F.col("a_z").alias("zi"), F.col("b_z").alias("zj"), "d")


def binding_pairs(atoms: DataFrame, tau: float = 1.15, *, ignore_h: bool = True, cell=None, pbc=(True, True, False), lattice: DataFrame | None = None) -> DataFrame:
    """Contacts ``frame, ads, surf`` between adsorbate and slab atoms; hydrogens count only in
    adsorbates without a heavier atom."""
    cols = ["frame", "atom", "z", "px", "py", "pz"]
    ads, slab = atoms.where("is_ads").select(*cols), atoms.where("not is_ads").select(*cols)
    if ignore_h:
        heavy = ads.where("z <> 1").select("frame").distinct().withColumn("_heavy", F.lit(True))
        ads = ads.join(heavy, "frame", "left").where((F.col("z") != 1) | F.col("_heavy").isNull()).drop("_heavy")
    p = _contacts(ads, slab, tau * _radii_sum(), max_cutoff=tau * WIDEST, cell=cell, pbc=pbc, lattice=lattice)
    return p.select("frame", F.col("a_atom").alias("ads"), F.col("b_atom").alias("surf"), F.col("a_z").alias("z_ads"),
                    F.col("b_z").alias("z_surf"), "d")


def surface_graph(atoms: DataFrame, surface: DataFrame, *, scale: float = 1.2, cell=None, lattice: DataFrame | None = None) -> DataFrame:
    """Edges between surface atoms closer than ``scale`` times the sum of their radii; ``lattice`` gives every frame its own cell."""
    s = atoms.join(surface.select("frame", "atom"), ["frame", "atom"], "left_semi").select("frame", "atom", "z", "px", "py", "pz")
    p = _contacts(s, s, scale * _radii_sum(), max_cutoff=scale * WIDEST, cell=cell, extra=F.col("a_atom") < F.col("b_atom"), lattice=lattice)
    return p.select("frame", F.col("a_atom").alias("src"), F.col("b_atom").alias("dst"), "d")


def min_contact_ratio(atoms: DataFrame, tau: float = 1.5, lattice: DataFrame | None = None) -> DataFrame:
    """Per frame the smallest ``d / (ra + rs)`` over all adsorbate-slab pairs.

    A near pass settles every frame whose best ratio cannot be beaten from outside its
    search radius; only the rest compare all pairs (nearest images in a ``lattice``), as a streaming minimum.
    In a ``lattice`` frames of up to ``FEW`` rows compare all pairs at once.
    """
    cols = ["frame", "atom", "z", "px", "py", "pz"]
    ads, slab = atoms.where("is_ads").select(*cols), atoms.where("not is_ads").select(*cols)
    reach = tau * WIDEST
    ratio = (F.col("d") / F.greatest(F.lit(1e-12), _radii_sum())).alias("r")
    small = None
    if lattice is not None:
        big = large_frames(ads, slab)
        few = lambda df: df if big is None else df.join(big, "frame", "left_anti")
        small = lattice_distance(_paired(few(ads), few(slab)), lattice).select("frame", ratio).groupBy("frame").agg(F.min("r").alias("min_ratio"))
        if big is None:
            return small
        atoms, ads, slab = (df.join(big, "frame", "left_semi") for df in (atoms, ads, slab))
    near = (_contacts(ads, slab, reach, max_cutoff=reach, lattice=lattice).select("frame", ratio)
            .groupBy("frame").agg(F.min("r").alias("min_ratio")).where(F.col("min_ratio") <= tau))
    rest = atoms.select("frame").distinct().join(near, "frame", "left_anti")
    la = ads.join(rest, "frame", "left_semi").select("frame", *[F.col(c).alias(f"a_{c}") for c in cols[1:]])
    rb = slab.join(rest, "frame", "left_semi").select("frame", *[F.col(c).alias(f"b_{c}") for c in cols[1:]])
    far = lattice_distance(la.join(rb, "frame"), lattice).select("frame", ratio).groupBy("frame").agg(F.min("r").alias("min_ratio"))
    return near.unionByName(far) if small is None else small.unionByName(near).unionByName(far)


def nearest_atoms(a: DataFrame, b: DataFrame, k: int, *, skip_self: bool = False, start: float = 4.0, lattice: DataFrame | None = None) -> DataFrame:
    """The ``k`` nearest ``b`` atoms of every ``a`` atom in its frame: ``frame, atom, other, d, rank``.

    With a ``lattice`` an atom stands at its nearest image and is counted once. The search radius doubles for atoms that have not found ``k`` neighbours yet; the last
    round joins what is left without a radius.
    """
    cols = ["frame", "atom", "z", "px", "py", "pz"]
    a, b = a.select(*cols), b.select(*cols)
    w = Window.partitionBy("frame", "atom").orderBy("d", "other")
    extra = (F.col("a_atom") != F.col("b_atom")) if skip_self else None

    def ranked(pairs):
        p = pairs.select("frame", F.col("a_atom").alias("atom"), F.col("b_atom").alias("other"), F.col("b_z").alias("z_other"), "d")
        return p.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    big = b.groupBy("frame").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > FEW).select("frame")
    big = settle(big)
    todo = a
    out, radius = None, start
    if not big.isEmpty():
        todo, rest = a.join(big, "frame", "left_anti"), a.join(big, "frame", "left_semi")
        span = b.join(big, "frame", "left_semi").agg(*[(F.max(c) - F.min(c)) for c in ("px", "py", "pz")]).first()
        limit = math.sqrt(sum(float(v) ** 2 for v in span))
        while radius < limit:
            hit = settle(ranked(_contacts(rest, b, radius, max_cutoff=radius, extra=extra, lattice=lattice)))
            full = hit.groupBy("frame", "atom").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") >= k).select("frame", "atom")
            part = hit.join(full, ["frame", "atom"], "left_semi")
            out = part if out is None else out.unionByName(part)
            rest = settle(rest.join(full, ["frame", "atom"], "left_anti"))
            radius *= 2.0
        todo = todo.unionByName(rest)
    la = todo.select("frame", *[F.col(c).alias(f"a_{c}") for c in cols[1:]])
    rb = b.select("frame", *[F.col(c).alias(f"b_{c}") for c in cols[1:]])
    j = la.join(rb, "frame")
    j = j.where(extra) if extra is not None else j
    small = ranked(lattice_distance(j, lattice))
    return small if out is None else out.unionByName(small)


def descriptor_atoms(atoms: DataFrame, pairs: DataFrame, mode: str = "binding_only") -> DataFrame:
    """Adsorbate atoms that enter the surface descriptor; heavy modes fall back when empty."""
    ads = atoms.where("is_ads")
    bound = ads.join(pairs.select("frame", F.col("ads").alias("atom")).distinct(), ["frame", "atom"], "left_semi")
    mode = mode.strip().lower()
    if mode in {"binding_only", "binding_atoms", "bound"}:
        return bound
    if mode in {"all", "all_atoms", "adsorbate"}:
        return ads
    if mode in {"binding_heavy", "binding_non_h", "bound_heavy"}:
        base = bound
    elif mode in {"all_heavy", "heavy", "non_h"}:
        base = ads
    else:
        raise ValueError(f"unsupported atom mode: {mode}")
    heavy = base.where("z <> 1")
    return heavy.unionByName(base.join(heavy.select("frame").distinct(), "frame", "left_anti"))


def surface_descriptor(atoms: DataFrame, pairs: DataFrame, *, k: int = 8, mode: str = "binding_only",
                       relative: bool = False, lattice: DataFrame | None = None) -> DataFrame:
    """Sorted distances to the ``k`` nearest slab atoms: one row ``frame, atom, rank, d``."""
    n = nearest_atoms(descriptor_atoms(atoms, pairs, mode), atoms.where("not is_ads"), k, lattice=lattice)
    if relative:
        w = Window.partitionBy("frame", "atom")
        n = n.withColumn("d", F.col("d") - F.min("d").over(w))
    return n.select("frame", "atom", "rank", "d")


def packed_descriptor(long: DataFrame) -> DataFrame:
    """Long descriptor rows to one array per frame, ordered by atom and rank."""
    s = F.sort_array(F.collect_list(F.struct("atom", "rank", "d")))
    return long.groupBy("frame").agg(F.transform(s, lambda v: v["d"]).alias("descriptor"))


# --- frame summaries -------------------------------------------------------

def centred(atoms: DataFrame, weight: Column | float = 1.0) -> DataFrame:
    """Coordinates relative to the (weighted) centre of each frame."""
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    c = atoms.groupBy("frame").agg(*[(F.sum(w * F.col(p)) / F.sum(w)).alias(f"_c{p}") for p in ("px", "py", "pz")])
    j = atoms.join(c, "frame")
    for p in ("px", "py", "pz"):
        j = j.withColumn(p, F.col(p) - F.col(f"_c{p}"))
    return j.select(*atoms.columns)


def second_moments(atoms: DataFrame) -> DataFrame:
    """Per frame: atom count, extents and the centred scatter matrix (six sums)."""
    p = {"x": "px", "y": "py", "z": "pz"}
    n = F.count(F.lit(1))
    aggs = [n.alias("n_atoms")]
    aggs += [(F.max(v) - F.min(v)).alias(f"span_{k}") for k, v in p.items()]
    for a, b in (("x", "x"), ("y", "y"), ("z", "z"), ("x", "y"), ("x", "z"), ("y", "z")):
        aggs.append((F.covar_pop(p[a], p[b]) * n).alias(f"s{a}{b}"))
    return atoms.groupBy("frame").agg(*aggs)


def shape_class(moments: DataFrame) -> DataFrame:
    """Molecule shape from the eigenvalues of the scatter matrix."""
    hi, mid, lo = sym3_eigenvalues("sxx", "syy", "szz", "sxy", "sxz", "syz")
    d = moments.withColumn("_hi", hi).withColumn("_mid", mid).withColumn("_lo", lo)
    shape = (F.when(F.col("n_atoms") <= 1, "monatomic").when(F.col("n_atoms") == 2, "diatomic")
             .when(F.col("_hi") <= 1e-12, "monatomic").when(F.col("_mid") / F.col("_hi") < 1e-3, "linear").otherwise("nonlinear"))
    planar = (F.col("shape") == "nonlinear") & (F.col("n_atoms") >= 4) & (F.col("_mid") > 1e-12) & (F.col("_lo") / F.col("_mid") < 0.08)
    return d.withColumn("shape", shape).withColumn("planar_like", planar).drop("_hi", "_mid", "_lo")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def principal_frame(sxx: pd.Series, syy: pd.Series, szz: pd.Series, sxy: pd.Series, sxz: pd.Series, syz: pd.Series) -> pd.Series:
    """Axes of 3x3 scatter matrices as nine numbers, longest extent first, first large component positive."""
    m = np.stack([np.stack([sxx, sxy, sxz], 1), np.stack([sxy, syy, syz], 1), np.stack([sxz, syz, szz], 1)], 1)
    _, vec = np.linalg.eigh(m)
    vec = np.swapaxes(vec, 1, 2)[:, ::-1]
    lead = np.take_along_axis(vec, np.abs(vec).argmax(2)[..., None], 2)
    return pd.Series(list((vec * np.where(lead < 0, -1.0, 1.0)).reshape(len(m), 9)), index=sxx.index)


def principal_axes(atoms: DataFrame, weight: Column | None = None) -> DataFrame:
    """``frame, axis_*`` (long axis) and ``normal_*`` (plane normal) of each frame."""
    w = F.lit(1.0) if weight is None else weight
    m = second_moments(centred(atoms, w)) if weight is None else _weighted_moments(atoms, w)
    p = m.withColumn("_a", principal_frame("sxx", "syy", "szz", "sxy", "sxz", "syz"))
    return p.select("frame", "n_atoms", *[F.col("_a")[i].alias(n) for i, n in (
        (0, "axis_x"), (1, "axis_y"), (2, "axis_z"), (6, "normal_x"), (7, "normal_y"), (8, "normal_z"))])


def _weighted_moments(atoms: DataFrame, w: Column) -> DataFrame:
    c = centred(atoms.withColumn("_w", w), F.col("_w"))
    p = {"x": "px", "y": "py", "z": "pz"}
    return c.groupBy("frame").agg(F.count(F.lit(1)).alias("n_atoms"), *[
        F.sum(F.col("_w") * F.col(p[a]) * F.col(p[b])).alias(f"s{a}{b}")
        for a, b in (("x", "x"), ("y", "y"), ("z", "z"), ("x", "y"), ("x", "z"), ("y", "z"))])


# --- aligned RMSD ----------------------------------------------------------

def aligned_rmsd(pairs: DataFrame, key: list[str]) -> DataFrame:
    """Kabsch RMSD per ``key`` over matched atoms (``ax ay az bx by bz``).

    Centring, covariance and norms are mergeable sums; the optimal rotation enters only
    through the singular values of a 3x3 matrix, taken in closed form.
    """
    A, B = ("ax", "ay", "az"), ("bx", "by", "bz")
    n = F.count(F.lit(1))
    aggs = [n.alias("n")]
    aggs += [(F.covar_pop(A[i], B[j]) * n).alias(f"h{i}{j}") for i in range(3) for j in range(3)]
    aggs += [(sum((F.var_pop(c) for c in (*A, *B)), F.lit(0.0)) * n).alias("e")]
    g = pairs.groupBy(*key).agg(*aggs)
    h = [[F.col(f"h{i}{j}") for j in range(3)] for i in range(3)]
    gram = lambda i, j: h[0][i] * h[0][j] + h[1][i] * h[1][j] + h[2][i] * h[2][j]
    l1, l2, l3 = sym3_eigenvalues(gram(0, 0), gram(1, 1), gram(2, 2), gram(0, 1), gram(0, 2), gram(1, 2))
    det = (h[0][0] * (h[1][1] * h[2][2] - h[1][2] * h[2][1]) - h[0][1] * (h[1][0] * h[2][2] - h[1][2] * h[2][0])
           + h[0][2] * (h[1][0] * h[2][1] - h[1][1] * h[2][0]))
    pos = lambda c: F.sqrt(F.greatest(F.lit(0.0), c))
    g = g.select(*key, "n", "e", l1.alias("_l1"), l2.alias("_l2"), l3.alias("_l3"), det.alias("_det"))
    s = pos(F.col("_l1")) + pos(F.col("_l2")) + F.signum("_det") * pos(F.col("_l3"))
    return g.select(*key, "n", pos((F.col("e") - 2.0 * s) / F.col("n")).alias("rmsd"))


def plain_rmsd(a: np.ndarray, b: np.ndarray) -> float:
    """Kabsch RMSD of two small coordinate arrays."""
    a, b = a - a.mean(0), b - b.mean(0)
    u, s, vt = np.linalg.svd(a.T @ b)
    s[-1] *= np.sign(np.linalg.det(u @ vt))
    return float(np.sqrt(max(0.0, (a * a).sum() + (b * b).sum() - 2.0 * s.sum()) / len(a)))


def assignment(cost: np.ndarray) -> np.ndarray:
    """Row-to-column assignment of least total cost (shortest augmenting paths)."""
    n = len(cost)
    u, v, owner = np.zeros(n + 1), np.zeros(n + 1), np.full(n + 1, -1)
    for row in range(n):
        owner[n], at = row, n
        dist, back, used = np.full(n, np.inf), np.full(n, n), np.zeros(n + 1, dtype=bool)
        while owner[at] >= 0:
            used[at] = True
            free = ~used[:n]
            step = cost[owner[at]] - u[owner[at]] - v[:n]
            better = free & (step < dist)
            dist[better], back[better] = step[better], at
            nxt = int(np.where(free, dist, np.inf).argmin())
            delta = dist[nxt]
            u[owner[used]] += delta
            v[used] -= delta
            dist[free] -= delta
            at = nxt
        while at != n:
            owner[at] = owner[back[at]]
            at = back[at]
    out = np.empty(n, dtype=int)
    out[owner[:n]] = np.arange(n)
    return out


def class_rmsd(a: np.ndarray, b: np.ndarray, classes: list[int], exact: int = 256) -> float:
    """RMSD minimised over permutations inside atom classes: all of them up to ``exact`` permutations,
    beyond that the best of three rounds of alignment and assignment, which may miss the minimum."""
    groups = [[i for i, c in enumerate(classes) if c == k] for k in sorted(set(classes))]
    if math.prod(math.factorial(len(g)) for g in groups) <= exact:
        best = math.inf
        for parts in itertools.product(*[itertools.permutations(g) for g in groups]):
            order = np.empty(len(a), dtype=int)
            for g, p in zip(groups, parts):
                order[g] = p
            best = min(best, plain_rmsd(a, b[order]))
        return best
    order = np.arange(len(a))
    best = plain_rmsd(a, b)
    for _ in range(3):
        p, q = a - a.mean(0), b - b.mean(0)
        u, _, vt = np.linalg.svd(q[order].T @ p)
        fix = np.diag([1.0, 1.0, np.sign(np.linalg.det(u @ vt))])
        moved = q @ (u @ fix @ vt)
        for g in groups:
            order[g] = np.array(g)[assignment(np.sqrt(((p[g][:, None] - moved[g][None]) ** 2).sum(2)))]
        best = min(best, plain_rmsd(a, b[order]))
    return best


@F.pandas_udf(T.DoubleType())
def symmetric_rmsd(a: pd.Series, b: pd.Series, classes: pd.Series) -> pd.Series:
    """Symmetry-aware RMSD of molecule rows (``array<array<double>>`` twice, class per atom)."""
    out = []
    for p, q, c in zip(a, b, classes):
        p, q = np.array([list(v) for v in p]), np.array([list(v) for v in q])
        out.append(class_rmsd(p, q, list(c)) if p.shape == q.shape and len(p) else float("nan"))
    return pd.Series(out)


@F.pandas_udf(T.DoubleType())
def assigned_node_l2(a: pd.Series, b: pd.Series, classes: pd.Series, mean: pd.Series) -> pd.Series:
    """Sum or mean over atoms of descriptor distances after the best match inside atom classes."""
    out = []
    for p, q, c, m in zip(a, b, classes, mean):
        p, q, c = np.array([list(v) for v in p]), np.array([list(v) for v in q]), np.array(c)
        if p.shape != q.shape or not len(p):
            out.append(float("nan"))
            continue
        total = 0.0
        for k in np.unique(c):
            d = np.sqrt(((p[c == k][:, None] - q[c == k][None]) ** 2).sum(2))
            total += float(d[np.arange(len(d)), assignment(d)].sum())
        out.append(total / len(p) if m else total)
    return pd.Series(out)


# --- anomaly rules ---------------------------------------------------------

def bond_changes(now: DataFrame, ref: DataFrame) -> DataFrame:
    """Per frame counts of bonds in both tables, removed and added (``frame, i, j`` inputs)."""
    n = now.select("frame", "i", "j").withColumn("_now", F.lit(1))
    r = ref.select("frame", "i", "j").withColumn("_ref", F.lit(1))
    j = n.join(r, ["frame", "i", "j"], "full_outer")
    return j.groupBy("frame").agg(F.count("_ref").alias("ads_bond_n0"), F.count("_now").alias("ads_bond_n1"),
                                  F.count_if(F.col("_now").isNull()).alias("bond_removed_n"),
                                  F.count_if(F.col("_ref").isNull()).alias("bond_added_n"))


def classify_frames(relaxed: DataFrame, reference: DataFrame, *, tau: float = 1.15, min_bonds: int = 1, slack: float = 0.25,
                    max_disp: float = 1.0, check_reconstruction: bool = True, allow_bond_change: bool = False,
                    burial_margin: float = 0.5, bond_tau: float = 1.20, axis: str = "pz", lattice: DataFrame | None = None) -> DataFrame:
    """First matching rule per frame: invalid_split, desorption, surface_reconstruction,
    dissociation, burial, or NULL; with the measured values as columns. ``lattice`` gives every
    frame its own periodic cell (see :func:`wrap_atoms`)."""
    counts = relaxed.groupBy("frame").agg(
        F.count_if(~F.col("is_ads")).alias("slab_n"), F.count(F.lit(1)).alias("n_atoms"),
        F.min(F.when(~F.col("is_ads"), F.col(axis))).alias("slab_min_axis"), F.max(F.when(~F.col("is_ads"), F.col(axis))).alias("slab_max_axis"),
        F.min(F.when(F.col("is_ads"), F.col(axis))).alias("ads_min_axis"), F.max(F.when(F.col("is_ads"), F.col(axis))).alias("ads_max_axis"))
    pairs = binding_pairs(relaxed, tau, lattice=lattice).groupBy("frame").agg(F.count(F.lit(1)).alias("binding_pair_n"))
    ratio = min_contact_ratio(relaxed, lattice=lattice).withColumnRenamed("min_ratio", "min_surface_contact_ratio")
    ref = reference.where("not is_ads").select("frame", "atom", *[F.col(p).alias(f"r{p}") for p in ("px", "py", "pz")])
    disp = (relaxed.where("not is_ads").join(ref, ["frame", "atom"])
            .groupBy("frame").agg(F.max(distance3("px", "py", "pz", "rpx", "rpy", "rpz")).alias("surface_max_disp")))
    change = bond_changes(bonds(relaxed, bond_tau, lattice), bonds(reference, bond_tau, lattice))
    d = counts
    for other in (pairs, ratio, disp, change):
        d = d.join(other, "frame", "left")
    zero = ["binding_pair_n", "ads_bond_n0", "ads_bond_n1", "bond_removed_n", "bond_added_n"]
    d = d.fillna(0, zero)
    few = F.col("binding_pair_n") < min_bonds
    lost = F.col("min_surface_contact_ratio").isNull() | (F.col("min_surface_contact_ratio") > tau + slack)
    rebuilt = F.lit(check_reconstruction) & (F.col("surface_max_disp") > max_disp)
    broken = F.lit(not allow_bond_change) & ((F.col("bond_removed_n") + F.col("bond_added_n")) > 0)
    reason = (F.when((F.col("slab_n") <= 0) | (F.col("slab_n") >= F.col("n_atoms")), "invalid_split")
              .when(few & lost, "desorption").when(rebuilt, "surface_reconstruction").when(broken, "dissociation")
              .when(F.col("ads_min_axis") < F.col("slab_min_axis") - burial_margin, "burial"))
    return d.withColumn("reason", reason)


# --- signatures ------------------------------------------------------------

def denticity(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("frame").agg(F.countDistinct("ads").alias("denticity"), F.count(F.lit(1)).alias("n_pairs"))


def joined_text(df: DataFrame, key: list[str], order: list[str], text: Column, sep: str, name: str) -> DataFrame:
    """Concatenate the texts of each key in order."""
    s = F.sort_array(F.collect_list(F.struct(*order, text.alias("_t"))))
    return df.groupBy(*key).agg(F.array_join(F.transform(s, lambda v: v["_t"]), sep).alias(name))


def absolute_signature(pairs: DataFrame) -> DataFrame:
    """Hash of the sorted ``ads:surf`` contacts of each frame."""
    t = joined_text(pairs, ["frame"], ["ads", "surf"], F.concat_ws(":", F.col("ads").cast("string"), F.col("surf").cast("string")), ",", "_t")
    return t.select("frame", short_sha1(F.col("_t")).alias("signature"))


def provenance_signature(frames: DataFrame, pairs: DataFrame) -> DataFrame:
    """Hash of ``ads:label`` tokens; label is the frame's site label or its basis id."""
    label = F.when(F.trim(F.coalesce("site_label", F.lit(""))) != "", F.trim("site_label")).otherwise(
        F.concat(F.lit("basis="), F.coalesce(F.col("basis_id").cast("string"), F.lit("None"))))
    f = frames.select("frame", label.alias("_l"))
    p = pairs.join(f, "frame")
    t = joined_text(p, ["frame"], ["ads", "surf"], F.concat_ws(":", F.col("ads").cast("string"), "_l"), ",", "_t")
    return f.join(t, "frame", "left").select(
        "frame", short_sha1(F.coalesce("_t", F.concat(F.lit("free:"), "_l"))).alias("signature"))


def pattern_signature(pairs: DataFrame) -> DataFrame:
    """Hash of ``ads:symbol:coordination`` tokens."""
    c = pairs.groupBy("frame", "ads", "z_ads").agg(F.count(F.lit(1)).alias("_n"))
    t = joined_text(c, ["frame"], ["ads"], F.concat_ws(":", F.col("ads").cast("string"), symbol_of("z_ads"), F.col("_n").cast("string")), ",", "_t")
    return t.select("frame", short_sha1(F.col("_t")).alias("signature"))


def environment_text(slab: DataFrame, *, k: int = 6, lattice: DataFrame | None = None) -> DataFrame:
    """``Z|d1,..,dk`` per slab atom: element and distances to its nearest slab atoms (3 decimals)."""
    from sievelark.functions.exprs import fixed_decimals

    n = nearest_atoms(slab, slab, k, skip_self=True, lattice=lattice).where("d > 1e-8").withColumn("_d", fixed_decimals("d", 3))
    t = joined_text(n, ["frame", "atom"], ["rank"], F.col("_d"), ",", "_t")
    alone = slab.groupBy("frame").agg((F.count(F.lit(1)) <= 1).alias("_one"))
    env = F.when(F.col("_one"), F.concat(F.lit("s"), F.col("atom").cast("string"))).otherwise(
        F.concat(F.lit("Z"), F.col("z").cast("string"), F.lit("|"), F.coalesce("_t", F.lit(""))))
    return slab.join(t, ["frame", "atom"], "left").join(alone, "frame").select("frame", "atom", env.alias("env"))


def canonical_signature(pairs: DataFrame, env: DataFrame) -> DataFrame:
    """Hash of ``ads:environment`` tokens: equal for symmetry-equivalent slab atoms."""
    p = pairs.join(env.withColumnRenamed("atom", "surf"), ["frame", "surf"])
    t = joined_text(p, ["frame"], ["ads", "surf"], F.concat_ws(":", F.col("ads").cast("string"), "env"), ",", "_t")
    return t.select("frame", short_sha1(F.col("_t")).alias("signature"))


def surface_keys(pairs: DataFrame, env: DataFrame, slab: DataFrame, lattice: DataFrame | None = None) -> DataFrame:
    """``surface_env_key`` (16 characters) and ``surface_geometry_key`` (20) of each frame with contacts."""
    from sievelark.functions.exprs import fixed_decimals

    p = pairs.select("frame", "ads", "surf").join(env.withColumnRenamed("atom", "surf"), ["frame", "surf"])
    token = F.concat_ws(":", F.col("ads").cast("string"), "env")
    e = joined_text(p, ["frame"], ["ads", "surf"], token, "|", "_t").select("frame", short_sha1(F.col("_t")).alias("surface_env_key"))
    site = pairs.select("frame", F.col("surf").alias("atom")).distinct().join(slab.select("frame", "atom", "px", "py", "pz"), ["frame", "atom"])
    a = site.select("frame", *[F.col(c).alias(f"a_{c}") for c in ("atom", "px", "py", "pz")])
    b = site.select("frame", *[F.col(c).alias(f"b_{c}") for c in ("atom", "px", "py", "pz")])
    peer = lattice_distance(a.join(b, "frame").where("a_atom <> b_atom"), lattice)
    peer = peer.withColumn("_s", fixed_decimals("d", 3))
    per = joined_text(peer, ["frame", "a_atom"], ["d"], F.col("_s"), ",", "_peer").withColumnRenamed("a_atom", "surf")
    both = joined_text(peer.where("a_atom < b_atom"), ["frame"], ["d"], F.col("_s"), ",", "_g")
    q = p.join(per, ["frame", "surf"], "left").withColumn("_u", F.concat(token, F.lit("|peer:"), F.coalesce("_peer", F.lit(""))))
    s = joined_text(q, ["frame"], ["ads", "surf"], F.col("_u"), "|", "_t").join(both, "frame", "left")
    g = s.select("frame", short_sha1(F.concat(F.lit("S:"), "_t", F.lit("|G:"), F.coalesce("_g", F.lit(""))), 20).alias("surface_geometry_key"))
    return e.join(g, "frame")
