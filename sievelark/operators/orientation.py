"""Orientation of adsorbates: which atom binds, which way it points, and sets of rotations that cover both.

Atoms are table rows with local rules as keys, so no molecule is collected to choose its binding
atom. Directions and rotation sets are column arithmetic over short arrays.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from sievelark.functions.exprs import covalent_radius, quaternion_angle
from sievelark.functions.fixed import ELECTRONEGATIVITY

#: Elements that bind through a lone pair, and what counts as carbon for them.
HETERO, CARBON_LIKE = (7, 8, 15, 16), (6, 14)
#: Rotations closer than this are the same.
SAME = 1e-6


def _electronegativity(z: Column, unknown: float) -> Column:
    return F.coalesce(*[F.when(z == k, F.lit(v)) for k, v in ELECTRONEGATIVITY.items()], F.lit(unknown))


def binding_atoms(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """``frame, atom, rule``: the atom through which each molecule binds.

    ``atoms``: ``frame, atom, z, px, py, pz``; ``bonds``: ``frame, i, j``. The only heavy atom; else a
    hetero atom with hydrogen (``protic``); else, among three heavy atoms or more, a hetero atom on
    carbon with at most two bonds (``hetero``); else the least electronegative heavy atom with at
    most one bond (``terminal``), or of all heavy atoms (``heavy``). Hydrogens count as heavy where
    there is nothing else. Ties: few bonds, then far from the centre for hetero atoms; far from the
    centre, then small radius for the others; then the lowest atom.
    """
    both = bonds.select("frame", F.col("i").alias("atom"), F.col("j").alias("_to")).unionByName(bonds.select("frame", F.col("j").alias("atom"), F.col("i").alias("_to")))
    ends = both.join(atoms.select("frame", F.col("atom").alias("_to"), F.col("z").alias("_z")), ["frame", "_to"])
    near = ends.groupBy("frame", "atom").agg(F.count(F.lit(1)).alias("_deg"), F.count_if(F.col("_z") == 1).alias("_h"), F.count_if(F.col("_z").isin(*CARBON_LIKE)).alias("_c"))
    size = atoms.groupBy("frame").agg(F.count_if(F.col("z") != 1).alias("_heavy"), F.count(F.lit(1)).alias("_n"), *[F.avg(p).alias(f"_{p}") for p in ("px", "py", "pz")])
    j = atoms.join(size, "frame").join(near, ["frame", "atom"], "left").fillna(0, ["_deg", "_h", "_c"])
    away = F.sqrt(sum(((F.col(p) - F.col(f"_{p}")) * (F.col(p) - F.col(f"_{p}")) for p in ("px", "py", "pz")), F.lit(0.0)))
    heavies = F.when(F.col("_heavy") > 0, F.col("_heavy")).otherwise(F.col("_n"))
    hetero = F.col("z").isin(*HETERO)
    rule = (F.when((F.col("_heavy") == 1) | (F.col("_n") == 1), 0).when(hetero & (F.col("_h") > 0), 1).when(hetero & (F.col("_c") > 0) & (F.col("_deg") <= 2) & (heavies > 2), 2)
            .when(F.col("_deg") <= 1, 3).otherwise(4))
    by_hetero = rule.isin(1, 2)
    key = F.struct(rule.alias("rule"), F.when(by_hetero, -_electronegativity(F.col("z"), 0.0)).otherwise(_electronegativity(F.col("z"), 10.0)).alias("e"),
                   F.when(by_hetero, F.col("_deg").cast("double")).otherwise(-away).alias("k"), F.when(by_hetero, -away).otherwise(covalent_radius("z")).alias("m"), F.col("atom").alias("atom"))
    best = j.where((F.col("_heavy") == 0) | (F.col("z") != 1)).groupBy("frame").agg(F.min(key).alias("b"))
    names = F.array(*map(F.lit, ("only", "protic", "hetero", "terminal", "heavy")))
    return best.select("frame", "b.atom", names[F.col("b.rule")].alias("rule"))


def _vec(x: Column, y: Column, z: Column) -> Column:
    return F.array(x, y, z)


def _dot(a: Column, b: Column) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _norm(a: Column) -> Column:
    return F.sqrt(_dot(a, a))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row: expressions inside lambdas run again for every element."""
    return F.transform(F.array(value), use)[0]


def unit(a: Column) -> Column:
    """A vector scaled to length 1; null below 1e-12."""
    return _once(a, lambda b: F.when(_norm(b) > 1e-12, _once(_norm(b), lambda n: F.transform(b, lambda v: v / n))))


def cone_direction(vectors: Column) -> Column:
    """The direction whose smallest cosine to all ``vectors`` is largest, among the vectors, their pair sums and their mean.

    Ties go to the larger mean cosine, then to vectors in order, pair sums in order, the mean.
    Zero vectors are left out; without any vector the direction is the z axis.
    """
    def best(rel: Column) -> Column:
        n = F.size(rel)
        pairs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.when(i < n, F.transform(F.sequence(i + 1, n), lambda j: unit(F.zip_with(
            F.element_at(rel, i), F.element_at(rel, j), lambda a, b: a + b)))).otherwise(F.array().cast("array<array<double>>"))))
        mean = unit(F.aggregate(rel, _vec(*[F.lit(0.0)] * 3), lambda s, v: F.zip_with(s, v, lambda a, b: a + b)))
        cands = F.filter(F.concat(rel, pairs, F.array(mean)), lambda c: c.isNotNull())

        def scored(c: Column, i: Column) -> Column:
            cos = F.transform(rel, lambda v: _dot(v, c))
            return F.struct(F.array_min(cos).alias("low"), (F.aggregate(cos, F.lit(0.0), lambda s, v: s + v) / n).alias("mean"), (-i).alias("i"), c.alias("c"))

        return F.array_max(F.transform(cands, scored))["c"]

    rel = F.filter(F.transform(vectors, unit), lambda v: v.isNotNull())
    # a one-element array names the unit vectors inside the expression
    return F.when(F.size(rel) > 0, F.transform(F.array(rel), best)[0]).otherwise(_vec(F.lit(0.0), F.lit(0.0), F.lit(1.0)))


def quaternion_between(a: Column, b: Column) -> Column:
    """The shortest rotation (scalar part first) from one unit vector to another; half a turn about a normal axis where they are opposite."""
    return _once(F.struct(a.alias("a"), b.alias("b")), lambda p: _shortest(p["a"], p["b"]))


def _shortest(a: Column, b: Column) -> Column:
    d = _dot(a, b)
    cross = _vec(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
    helper = F.when(F.abs(a[0]) < 0.9, _vec(F.lit(1.0), F.lit(0.0), F.lit(0.0))).otherwise(_vec(F.lit(0.0), F.lit(1.0), F.lit(0.0)))
    side = unit(_vec(a[1] * helper[2] - a[2] * helper[1], a[2] * helper[0] - a[0] * helper[2], a[0] * helper[1] - a[1] * helper[0]))
    turn = F.array(1.0 + d, cross[0], cross[1], cross[2])
    scaled = _once(turn, lambda t: _once(F.sqrt(F.aggregate(t, F.lit(0.0), lambda s, v: s + v * v)), lambda n: F.transform(t, lambda v: v / n)))
    return F.when(d > -1.0 + 1e-12, scaled).otherwise(_once(side, lambda s: F.array(F.lit(0.0), s[0], s[1], s[2])))


def matrix_quaternion(m: Column) -> Column:
    """Quaternion (scalar part first, not negative) of a rotation matrix given as three rows."""
    c = [[m[i][j] for j in range(3)] for i in range(3)]
    size = [1 + c[0][0] + c[1][1] + c[2][2], 1 + c[0][0] - c[1][1] - c[2][2], 1 - c[0][0] + c[1][1] - c[2][2], 1 - c[0][0] - c[1][1] + c[2][2]]
    a, b, d = c[2][1] - c[1][2], c[0][2] - c[2][0], c[1][0] - c[0][1]
    x, y, z = c[1][0] + c[0][1], c[0][2] + c[2][0], c[2][1] + c[1][2]
    rows = [(size[0], a, b, d), (a, size[1], x, y), (b, x, size[2], z), (d, y, z, size[3])]
    # the largest component is divided by, so nothing is lost to rounding
    best = F.greatest(*size)
    q = F.coalesce(*[F.when(size[i] >= best, F.transform(F.array(*rows[i]), lambda v: v / (2.0 * F.sqrt(best)))) for i in range(4)])
    return F.when(q[0] < 0, F.transform(q, lambda v: -v)).otherwise(q)


def tilt_targets(normal: Column, tangent: Column, tilts: list[float]) -> Column:
    """Directions tilted off the normal towards the tangent, each followed by its opposite: ``array<struct<tilt, direction>>``."""
    out = []
    for t in tilts:
        c, s = math.cos(math.radians(t)), math.sin(math.radians(t))
        d = F.zip_with(normal, tangent, lambda n, u: c * n + s * u)
        out.append(_once(unit(d), lambda d: F.array(*[F.struct(F.lit(float(t)).alias("tilt"), v.alias("direction")) for v in (d, F.transform(d, lambda x: -x))])))
    return F.flatten(F.array(*out))


def distinct_rotations(quaternions: Column, tolerance: float = SAME) -> Column:
    """Rotations in order without the ones that an earlier one equals; a quaternion and its negative are one rotation."""
    return F.aggregate(quaternions, F.array().cast("array<array<double>>"), lambda seen, q: F.when(
        F.exists(seen, lambda r: quaternion_angle(r, q) <= tolerance), seen).otherwise(F.concat(seen, F.array(q))))


def spread_rotations(quaternions: Column, k: int, seeds: Column | None = None) -> Column:
    """``k`` rotations by farthest-point choice under the rotation angle, which does not tell a quaternion from its negative.

    Starts from ``seeds`` (the first rotation by default); ties go to the earlier candidate.
    """
    def spread(all_: Column) -> Column:
        def add(chosen: Column, _: Column) -> Column:
            def scored(q: Column, i: Column) -> Column:
                return F.struct(F.array_min(F.transform(chosen, lambda r: quaternion_angle(r, q))).alias("d"), (-i).alias("i"), q.alias("q"))

            far = F.array_max(F.filter(F.transform(all_, scored), lambda c: c["d"] > SAME))
            return _once(far, lambda f: F.when((F.size(chosen) < k) & f.isNotNull(), F.concat(chosen, F.array(f["q"]))).otherwise(chosen))

        return F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.slice(all_, 1, 1) if seeds is None else F.slice(seeds, 1, k), add)

    return _once(quaternions, spread)


def linear_rotations(axis: Column, normal: Column, tangent: Column, tilts: list[float], k: int) -> Column:
    """At most ``k`` rotations of a linear molecule: both ends at every tilt, doubles dropped, spread over the angle."""
    targets = F.transform(tilt_targets(normal, tangent, tilts), lambda t: quaternion_between(axis, t["direction"]))
    return spread_rotations(distinct_rotations(targets), k)
