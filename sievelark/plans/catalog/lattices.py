"""Structure queries in periodic cells of many shapes; their SQL lists images instead of reducing the cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sievelark.operators import structure as S
from sievelark.plans.catalog.registry import query
from sievelark.plans.catalog.structures import ATOM_SQL, order_atoms
from sievelark.session import settle
from sievelark.sources.tables import table

#: Cells by order number: a flat and a full one whose second vector is ten times the first, a right-angled one; every fourth order is open.
CELLS = {0: ([[4.0, 0.0, 0.0], [39.0, 4.0, 0.0], [0.5, -0.9, 9.0]], [True, True, False]), 1: ([[4.0, 0.0, 0.0], [39.0, 4.0, 0.0], [7.0, 5.0, 9.0]], [True, True, True]),
         2: ([[5.0, 0.0, 0.0], [0.0, 5.0, 0.0], [0.0, 0.0, 12.0]], [True, True, True])}
IMAGES_SQL = """img AS MATERIALIZED (
 SELECT 0 AS shape, i * 4.0::DOUBLE + j * 39.0::DOUBLE AS ox, j * 4.0::DOUBLE AS oy, 0.0::DOUBLE AS oz FROM range(-24, 25) t(i), range(-2, 3) u(j) UNION ALL
 SELECT 1, i * 4.0::DOUBLE + j * 39.0::DOUBLE + k * 7.0::DOUBLE, j * 4.0::DOUBLE + k * 5.0::DOUBLE, k * 9.0::DOUBLE FROM range(-35, 36) t(i), range(-4, 5) u(j), range(-1, 2) v(k) UNION ALL
 SELECT 2, i * 5.0::DOUBLE, j * 5.0::DOUBLE, k * 12.0::DOUBLE FROM range(-2, 3) t(i), range(-2, 3) u(j), range(-1, 2) v(k) UNION ALL SELECT 3, 0.0, 0.0, 0.0)"""
IMAGE_DIST = "sqrt((a.px - b.px + ox) * (a.px - b.px + ox) + (a.py - b.py + oy) * (a.py - b.py + oy) + (a.pz - b.pz + oz) * (a.pz - b.pz + oz))"
# nearest images of all pairs of an adsorbate and a slab atom
NEAREST_SQL = f"""md AS MATERIALIZED (SELECT a.frame, a.atom, b.atom AS other, any_value(a.z) AS z, any_value(a.r + b.r) AS rs, min({IMAGE_DIST}) AS d
 FROM atm a JOIN atm b ON a.frame = b.frame AND a.is_ads AND NOT b.is_ads JOIN img ON img.shape = a.frame % 4 GROUP BY 1, 2, 3)"""
BASE = f"WITH {ATOM_SQL}, {IMAGES_SQL}, {NEAREST_SQL}"
BOUND = """heavy AS (SELECT DISTINCT frame FROM atm WHERE is_ads AND z <> 1), pr AS MATERIALIZED (SELECT * FROM md WHERE d <= 1.15::DOUBLE * rs AND (z <> 1 OR frame NOT IN (SELECT frame FROM heavy)))"""


def order_lattice(spark, base) -> DataFrame:
    """``frame, cell, pbc`` of every order that has a cell."""
    shape = F.col("l_orderkey") % 4
    vectors = lambda c: F.array(*[F.array(*map(F.lit, v)) for v in c])
    cell = F.coalesce(*[F.when(shape == k, vectors(c)) for k, (c, _) in CELLS.items()])
    pbc = F.coalesce(*[F.when(shape == k, F.array(*map(F.lit, p))) for k, (_, p) in CELLS.items()])
    return table(spark, base, "lineitem").where(shape < 3).select("l_orderkey").distinct().select(F.col("l_orderkey").alias("frame"), cell.alias("cell"), pbc.alias("pbc"))


@query("lattice_nearest_atoms", f"{BASE} SELECT frame, atom, other, round(d, 6) AS d, row_number() OVER (PARTITION BY frame, atom ORDER BY d, other)::INTEGER AS rank FROM md QUALIFY rank <= 2")
def _(spark, base):
    """Two nearest slab atoms of every adsorbate atom, at their nearest images."""
    a = settle(order_atoms(spark, base))
    return S.nearest_atoms(a.where("is_ads"), a.where("not is_ads"), 2, lattice=order_lattice(spark, base)).select("frame", "atom", "other", F.round("d", 6).alias("d"), "rank")


@query("lattice_contact_ratio", f"{BASE} SELECT frame, round(min(d / rs), 6) AS min_ratio FROM md GROUP BY 1")
def _(spark, base):
    """Smallest contact ratio of every order; orders without a near contact compare nearest images of all pairs."""
    return S.min_contact_ratio(settle(order_atoms(spark, base)), 0.9, lattice=order_lattice(spark, base)).withColumn("min_ratio", F.round("min_ratio", 6))


@query("lattice_descriptor", f"""{BASE}, {BOUND} SELECT frame, atom, round(d, 6) AS d, row_number() OVER (PARTITION BY frame, atom ORDER BY d, other)::INTEGER AS rank
FROM md SEMI JOIN pr ON pr.frame = md.frame AND pr.atom = md.atom QUALIFY rank <= 8""")
def _(spark, base):
    """Distances of bound atoms to their slab atoms."""
    a, lattice = settle(order_atoms(spark, base)), order_lattice(spark, base)
    return S.surface_descriptor(a, S.binding_pairs(a, lattice=lattice), lattice=lattice).select("frame", "atom", "rank", F.round("d", 6).alias("d"))


@query("lattice_surface_graph", f"""WITH {ATOM_SQL}, {IMAGES_SQL} SELECT a.frame, a.atom AS src, b.atom AS dst, round(min({IMAGE_DIST}), 6) AS d
FROM atm a JOIN atm b ON a.frame = b.frame AND a.atom < b.atom AND NOT a.is_ads AND NOT b.is_ads JOIN img ON img.shape = a.frame % 4 GROUP BY 1, 2, 3, a.r, b.r HAVING min({IMAGE_DIST}) <= a.r + b.r""")
def _(spark, base):
    """Surface neighbours across the borders of every order's own cell."""
    a = settle(order_atoms(spark, base))
    return S.surface_graph(a, a.where("not is_ads"), scale=1.0, lattice=order_lattice(spark, base)).select("frame", "src", "dst", F.round("d", 6).alias("d"))


@query("lattice_anomalies", f"""{BASE}, {BOUND}, ra AS (SELECT frame, min(d / rs) AS ratio FROM md GROUP BY 1), np AS (SELECT frame, count(*) AS n FROM pr GROUP BY 1),
f AS (SELECT frame, count(*) FILTER (WHERE NOT is_ads) AS slab_n, count(*) AS n_atoms, min(pz) FILTER (NOT is_ads) AS smin, min(pz) FILTER (is_ads) AS amin FROM atm GROUP BY 1)
SELECT f.frame, coalesce(n, 0) AS binding_pair_n, round(ratio, 6) AS min_surface_contact_ratio,
 CASE WHEN slab_n <= 0 OR slab_n >= n_atoms THEN 'invalid_split' WHEN coalesce(n, 0) < 1 AND (ratio IS NULL OR ratio > 1.15::DOUBLE + 0.25::DOUBLE) THEN 'desorption' WHEN amin < smin - 0.5::DOUBLE THEN 'burial' END AS reason
FROM f LEFT JOIN ra USING (frame) LEFT JOIN np USING (frame)""")
def _(spark, base):
    """Anomaly rules with contacts and ratios in every order's own cell."""
    a = settle(order_atoms(spark, base).drop("s"))
    d = S.classify_frames(a, a, lattice=order_lattice(spark, base))
    return d.select("frame", "binding_pair_n", F.round("min_surface_contact_ratio", 6).alias("min_surface_contact_ratio"), "reason")
