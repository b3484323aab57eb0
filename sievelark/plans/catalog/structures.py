"""Structure queries: every order is a frame, its lines are the atoms."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelark.functions.exprs import covalent_radius, quaternion_angle, quaternion_product, tilt_deg
from sievelark.functions.options import is_flexible, reference_height, sampling_budget, site_coordination
from sievelark.operators import graph as G
from sievelark.operators import structure as S
from sievelark.plans.catalog.registry import query
from sievelark.session import settle
from sievelark.sources.tables import table

# one atom per (order, part, line number); lines 1-3 form the adsorbate
ATOM_SQL = """atoms AS MATERIALIZED (SELECT l_orderkey AS frame, l_partkey * 10 + l_linenumber AS atom, l_linenumber <= 3 AS is_ads,
  CASE WHEN l_linenumber <= 3 THEN [1, 6, 7, 8][(l_partkey % 4)::INT + 1] ELSE [29, 78][(l_partkey % 2)::INT + 1] END AS z,
  min(l_quantity) / 12.0::DOUBLE AS px, min(l_extendedprice) / 25000.0::DOUBLE AS py,
  CASE WHEN l_linenumber <= 3 THEN 1.0::DOUBLE + min(l_tax) * 25.0::DOUBLE ELSE min(l_discount) * 10.0::DOUBLE END AS pz, min(l_suppkey) AS s
  FROM lineitem GROUP BY l_orderkey, l_partkey, l_linenumber),
atm AS MATERIALIZED (SELECT *, (CASE z WHEN 1 THEN 0.31 WHEN 6 THEN 0.76 WHEN 7 THEN 0.71 WHEN 8 THEN 0.66 WHEN 29 THEN 1.32 ELSE 1.36 END)::DOUBLE AS r FROM atoms)"""
DIST = "sqrt((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py) + (a.pz - b.pz) * (a.pz - b.pz))"
BOND_SQL = f"bond AS MATERIALIZED (SELECT a.frame, a.atom AS i, b.atom AS j, {DIST} AS d FROM atm a JOIN atm b ON a.frame = b.frame AND a.atom < b.atom AND a.is_ads AND b.is_ads WHERE {DIST} <= 1.2::DOUBLE * (a.r + b.r))"
PAIR_SQL = f"""heavy AS (SELECT DISTINCT frame FROM atm WHERE is_ads AND z <> 1),
pr AS MATERIALIZED (SELECT a.frame, a.atom AS ads, b.atom AS surf, a.z AS z_ads, {DIST} AS d FROM atm a JOIN atm b ON a.frame = b.frame AND a.is_ads AND NOT b.is_ads
  WHERE {DIST} <= 1.15::DOUBLE * (a.r + b.r) AND (a.z <> 1 OR a.frame NOT IN (SELECT frame FROM heavy)))"""


def order_atoms(spark, base):
    pick = lambda vals, n: F.get(F.array(*[F.lit(v) for v in vals]), (F.col("l_partkey") % n).cast("int"))
    ads = F.col("l_linenumber") <= 3
    g = table(spark, base, "lineitem").groupBy("l_orderkey", "l_partkey", "l_linenumber").agg(
        F.min("l_quantity").alias("q"), F.min("l_extendedprice").alias("p"), F.min("l_discount").alias("d"), F.min("l_tax").alias("t"), F.min("l_suppkey").alias("s"))
    return g.select(F.col("l_orderkey").alias("frame"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("atom"), ads.alias("is_ads"),
                    F.when(ads, pick((1, 6, 7, 8), 4)).otherwise(pick((29, 78), 2)).alias("z"), (F.col("q") / 12.0).alias("px"), (F.col("p") / 25000.0).alias("py"),
                    F.when(ads, 1.0 + F.col("t") * 25.0).otherwise(F.col("d") * 10.0).alias("pz"), "s")


def moved_atoms(spark, base):
    """Reference positions: each atom shifted by an amount that depends on its supplier."""
    a = order_atoms(spark, base)
    shift = F.when(F.col("is_ads"), (F.col("s") % 3) * 0.1).otherwise((F.col("s") % 4) * 0.4)
    return a.withColumn("px", F.col("px") + shift)


MOVED_SQL = """rf AS MATERIALIZED (SELECT frame, atom, is_ads, z, px + CASE WHEN is_ads THEN (s % 3) * 0.1::DOUBLE ELSE (s % 4) * 0.4::DOUBLE END AS px, py, pz, r FROM atm)"""


@query("adsorbate_bonds", f"WITH {ATOM_SQL}, {BOND_SQL} SELECT frame, i, j, round(d, 6) AS d FROM bond")
def _(spark, base):
    return S.bonds(order_atoms(spark, base)).select("frame", "i", "j", F.round("d", 6).alias("d"))


@query("binding_pairs", f"WITH {ATOM_SQL}, {PAIR_SQL} SELECT frame, ads, surf, round(d, 6) AS d FROM pr")
def _(spark, base):
    return S.binding_pairs(order_atoms(spark, base)).select("frame", "ads", "surf", F.round("d", 6).alias("d"))


WRAP = "sqrt(({x}) * ({x}) + ({y}) * ({y}) + (a.pz - b.pz) * (a.pz - b.pz))".format(
    x="(a.px - b.px) - round_even((a.px - b.px) / 4.0::DOUBLE, 0) * 4.0::DOUBLE", y="(a.py - b.py) - round_even((a.py - b.py) / 4.0::DOUBLE, 0) * 4.0::DOUBLE")


@query("periodic_surface_graph", f"WITH {ATOM_SQL} SELECT a.frame, a.atom AS src, b.atom AS dst, round({WRAP}, 6) AS d FROM atm a JOIN atm b ON a.frame = b.frame AND a.atom < b.atom AND NOT a.is_ads AND NOT b.is_ads WHERE {WRAP} <= 1.0::DOUBLE * (a.r + b.r)")
def _(spark, base):
    """Surface neighbours with minimum-image wrapping in x and y."""
    a = order_atoms(spark, base)
    return S.surface_graph(a, a.where("not is_ads"), scale=1.0, cell=(4.0, 4.0, 20.0)).select("frame", "src", "dst", F.round("d", 6).alias("d"))


@query("image_distances", f"""WITH {ATOM_SQL}, o AS (SELECT i * 4.0::DOUBLE + j * 1.0::DOUBLE AS ox, j * 4.0::DOUBLE AS oy, k * 9.0::DOUBLE AS oz FROM (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j), (SELECT unnest([-1, 0, 1]) AS k)),
c AS (SELECT frame, avg(px) AS px, avg(py) AS py, avg(pz) AS pz FROM atm GROUP BY 1)
SELECT a.frame, a.atom, round(min(sqrt(pow(a.px - c.px + ox, 2) + pow(a.py - c.py + oy, 2) + pow(a.pz - c.pz + oz, 2))), 6) AS d FROM atm a JOIN c USING (frame), o GROUP BY 1, 2""")
def _(spark, base):
    """Distance to the frame centre over the 27 images of a skewed cell."""
    from sievelark.functions.exprs import mic_image_distance

    c = S.centred(order_atoms(spark, base))
    return c.select("frame", "atom", F.round(mic_image_distance(F.col("px"), F.col("py"), F.col("pz"), [[4, 0, 0], [1, 4, 0], [0, 0, 9]]), 6).alias("d"))


@query("min_contact_ratio", f"WITH {ATOM_SQL} SELECT a.frame, round(min({DIST} / (a.r + b.r)), 6) AS min_ratio FROM atm a JOIN atm b ON a.frame = b.frame AND a.is_ads AND NOT b.is_ads GROUP BY 1")
def _(spark, base):
    return S.min_contact_ratio(settle(order_atoms(spark, base))).withColumn("min_ratio", F.round("min_ratio", 6))


@query("nearest_slab_atoms", f"""WITH {ATOM_SQL} SELECT a.frame, a.atom, b.atom AS other, round({DIST}, 6) AS d, row_number() OVER (PARTITION BY a.frame, a.atom ORDER BY {DIST}, b.atom)::INTEGER AS rank
FROM atm a JOIN atm b ON a.frame = b.frame AND a.is_ads AND NOT b.is_ads QUALIFY rank <= 2""")
def _(spark, base):
    a = settle(order_atoms(spark, base))
    return S.nearest_atoms(a.where("is_ads"), a.where("not is_ads"), 2).select("frame", "atom", "other", F.round("d", 6).alias("d"), "rank")


@query("surface_descriptor", f"""WITH {ATOM_SQL}, {PAIR_SQL}, bd AS (SELECT DISTINCT frame, ads AS atom FROM pr)
SELECT a.frame, a.atom, round({DIST}, 6) AS d, row_number() OVER (PARTITION BY a.frame, a.atom ORDER BY {DIST}, b.atom)::INTEGER AS rank
FROM atm a SEMI JOIN bd ON bd.frame = a.frame AND bd.atom = a.atom JOIN atm b ON a.frame = b.frame AND NOT b.is_ads QUALIFY rank <= 8""")
def _(spark, base):
    a = settle(order_atoms(spark, base))
    return S.surface_descriptor(a, S.binding_pairs(a)).select("frame", "atom", "rank", F.round("d", 6).alias("d"))


@query("binding_environment", f"""WITH {ATOM_SQL}, {PAIR_SQL}, f AS (SELECT frame, min(atom) AS atom FROM atm WHERE is_ads GROUP BY 1),
n AS (SELECT f.frame, count(pr.surf) AS coordination FROM f LEFT JOIN pr ON pr.frame = f.frame AND pr.ads = f.atom GROUP BY 1)
SELECT frame, coordination, coordination >= 3 AS collapsed FROM n""")
def _(spark, base):
    """Coordination of the first adsorbate atom and the flag for three or more contacts."""
    a = settle(order_atoms(spark, base))
    f = a.where("is_ads").groupBy("frame").agg(F.min("atom").alias("ads"))
    n = f.join(S.binding_pairs(a).select("frame", "ads", "surf"), ["frame", "ads"], "left").groupBy("frame").agg(F.count("surf").alias("coordination"))
    return n.withColumn("collapsed", F.col("coordination") >= 3)


ANOMALY_SQL = f"""{ATOM_SQL}, {PAIR_SQL}, {BOND_SQL}, {MOVED_SQL},
b0 AS (SELECT a.frame, a.atom AS i, b.atom AS j FROM rf a JOIN rf b ON a.frame = b.frame AND a.atom < b.atom AND a.is_ads AND b.is_ads WHERE {DIST} <= 1.2::DOUBLE * (a.r + b.r)),
bc AS (SELECT coalesce(bond.frame, b0.frame) AS frame, count(*) FILTER (WHERE bond.i IS NULL) AS removed, count(*) FILTER (WHERE b0.i IS NULL) AS added FROM bond FULL JOIN b0 ON bond.frame = b0.frame AND bond.i = b0.i AND bond.j = b0.j GROUP BY 1),
ds AS (SELECT a.frame, max({DIST}) AS disp FROM atm a JOIN rf b ON a.frame = b.frame AND a.atom = b.atom AND NOT a.is_ads GROUP BY 1),
ra AS (SELECT a.frame, min({DIST} / (a.r + b.r)) AS ratio FROM atm a JOIN atm b ON a.frame = b.frame AND a.is_ads AND NOT b.is_ads GROUP BY 1),
np AS (SELECT frame, count(*) AS n FROM pr GROUP BY 1),
f AS (SELECT frame, count(*) FILTER (WHERE NOT is_ads) AS slab_n, count(*) AS n_atoms, min(pz) FILTER (NOT is_ads) AS smin, min(pz) FILTER (is_ads) AS amin FROM atm GROUP BY 1),
k AS (SELECT f.frame, coalesce(n, 0) AS binding_pair_n, coalesce(removed, 0) AS bond_removed_n, coalesce(added, 0) AS bond_added_n, round(disp, 6) AS surface_max_disp,
 CASE WHEN slab_n <= 0 OR slab_n >= n_atoms THEN 'invalid_split' WHEN coalesce(n, 0) < 1 AND (ratio IS NULL OR ratio > 1.15::DOUBLE + 0.25::DOUBLE) THEN 'desorption' WHEN disp > 0.9 THEN 'surface_reconstruction'
  WHEN coalesce(removed, 0) + coalesce(added, 0) > 0 THEN 'dissociation' WHEN amin < smin - 0.5::DOUBLE THEN 'burial' END AS reason
 FROM f LEFT JOIN bc USING (frame) LEFT JOIN ds USING (frame) LEFT JOIN ra USING (frame) LEFT JOIN np USING (frame))"""


def _classified(spark, base):
    now, ref = settle(order_atoms(spark, base)), settle(moved_atoms(spark, base))
    return S.classify_frames(now.drop("s"), ref.drop("s"), max_disp=0.9)


@query("frame_anomalies", f"WITH {ANOMALY_SQL} SELECT frame, binding_pair_n, bond_removed_n, bond_added_n, surface_max_disp, reason FROM k")
def _(spark, base):
    return _classified(spark, base).select("frame", "binding_pair_n", "bond_removed_n", "bond_added_n", F.round("surface_max_disp", 6).alias("surface_max_disp"), "reason")


@query("rejection_counts", f"WITH {ANOMALY_SQL} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM k GROUP BY 1")
def _(spark, base):
    return _classified(spark, base).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("denticity", f"WITH {ATOM_SQL}, {PAIR_SQL} SELECT frame, count(DISTINCT ads) AS denticity, count(*) AS n_pairs FROM pr GROUP BY 1")
def _(spark, base):
    return S.denticity(S.binding_pairs(order_atoms(spark, base)))


EIG = """eig AS (SELECT *, (sxx + syy + szz) / 3.0 AS q,
  ((sxx - (sxx + syy + szz) / 3.0) ** 2 + (syy - (sxx + syy + szz) / 3.0) ** 2 + (szz - (sxx + syy + szz) / 3.0) ** 2 + 2 * (sxy * sxy + sxz * sxz + syz * syz)) / 6.0 AS p2 FROM mo),
ei2 AS (SELECT *, sqrt(p2) AS p, acos(greatest(-1, least(1, CASE WHEN p2 > 0 THEN ((sxx - q) * ((syy - q) * (szz - q) - syz * syz) - sxy * (sxy * (szz - q) - syz * sxz) + sxz * (sxy * syz - (syy - q) * sxz)) / (2 * p2 * sqrt(p2)) ELSE 1 END))) / 3.0 AS phi FROM eig),
ev AS (SELECT *, q + 2 * p * cos(phi) AS hi, q + 2 * p * cos(phi + 2 * pi() / 3.0) AS lo, 3 * q - (q + 2 * p * cos(phi)) - (q + 2 * p * cos(phi + 2 * pi() / 3.0)) AS mid FROM ei2)"""


@query("molecule_shapes", f"""WITH {ATOM_SQL}, mo AS (SELECT frame, count(*) AS n_atoms, max(px) - min(px) AS span_x, max(py) - min(py) AS span_y, max(pz) - min(pz) AS span_z,
  covar_pop(px, px) * count(*) AS sxx, covar_pop(py, py) * count(*) AS syy, covar_pop(pz, pz) * count(*) AS szz, covar_pop(px, py) * count(*) AS sxy, covar_pop(px, pz) * count(*) AS sxz, covar_pop(py, pz) * count(*) AS syz
  FROM atm WHERE is_ads GROUP BY 1), {EIG},
sh AS (SELECT *, CASE WHEN n_atoms <= 1 THEN 'monatomic' WHEN n_atoms = 2 THEN 'diatomic' WHEN hi <= 1e-12 THEN 'monatomic' WHEN mid / hi < 1e-3 THEN 'linear' ELSE 'nonlinear' END AS shape FROM ev)
SELECT frame, n_atoms, round(greatest(span_x, span_y, span_z), 6) AS span, shape, shape = 'nonlinear' AND n_atoms >= 4 AND mid > 1e-12 AND lo / mid < 0.08 AS planar_like,
  CASE shape WHEN 'monatomic' THEN 1 WHEN 'nonlinear' THEN 4 ELSE 4 END AS n_rot, n_atoms >= 10 AS flexible FROM sh""")
def _(spark, base):
    m = S.shape_class(S.second_moments(order_atoms(spark, base).where("is_ads")))
    b = sampling_budget(F.col("shape"), 4, 6, 3)
    return m.select("frame", "n_atoms", F.round(F.greatest("span_x", "span_y", "span_z"), 6).alias("span"), "shape", "planar_like",
                    b["n_rot"].alias("n_rot"), is_flexible(F.col("n_atoms"), F.lit(False)).alias("flexible"))


@query("aligned_rmsd", f"""WITH {ATOM_SQL}, {MOVED_SQL},
h AS (SELECT a.frame, count(*) AS n, covar_pop(a.px, b.px) * count(*) AS xx, covar_pop(a.px, b.py) * count(*) AS xy, covar_pop(a.px, b.pz) * count(*) AS xz,
  covar_pop(a.py, b.px) * count(*) AS yx, covar_pop(a.py, b.py) * count(*) AS yy, covar_pop(a.py, b.pz) * count(*) AS yz, covar_pop(a.pz, b.px) * count(*) AS zx, covar_pop(a.pz, b.py) * count(*) AS zy, covar_pop(a.pz, b.pz) * count(*) AS zz,
  (var_pop(a.px) + var_pop(a.py) + var_pop(a.pz) + var_pop(b.px) + var_pop(b.py) + var_pop(b.pz)) * count(*) AS e FROM atm a JOIN rf b ON a.frame = b.frame AND a.atom = b.atom GROUP BY 1),
mo AS (SELECT *, xx * xx + yx * yx + zx * zx AS sxx, xy * xy + yy * yy + zy * zy AS syy, xz * xz + yz * yz + zz * zz AS szz, xx * xy + yx * yy + zx * zy AS sxy, xx * xz + yx * yz + zx * zz AS sxz, xy * xz + yy * yz + zy * zz AS syz,
  xx * (yy * zz - yz * zy) - xy * (yx * zz - yz * zx) + xz * (yx * zy - yy * zx) AS det FROM h), {EIG}
SELECT frame, n, round(sqrt(greatest(0, (e - 2 * (sqrt(greatest(0, hi)) + sqrt(greatest(0, mid)) + sign(det) * sqrt(greatest(0, lo)))) / n)), 3) AS rmsd FROM ev WHERE n >= 4""")
def _(spark, base):
    """Best-fit RMSD between each order's atoms and their moved copies (four atoms or more)."""
    a = order_atoms(spark, base).select("frame", "atom", F.col("px").alias("ax"), F.col("py").alias("ay"), F.col("pz").alias("az"))
    b = moved_atoms(spark, base).select("frame", "atom", F.col("px").alias("bx"), F.col("py").alias("by"), F.col("pz").alias("bz"))
    return S.aligned_rmsd(a.join(b, ["frame", "atom"]), ["frame"]).where("n >= 4").withColumn("rmsd", F.round("rmsd", 3))


@query("centred_coordinates", f"""WITH {ATOM_SQL}, c AS (SELECT frame, sum((z + 0.37::DOUBLE) * px) / sum(z + 0.37::DOUBLE) AS cx, sum((z + 0.37::DOUBLE) * py) / sum(z + 0.37::DOUBLE) AS cy, sum((z + 0.37::DOUBLE) * pz) / sum(z + 0.37::DOUBLE) AS cz FROM atm GROUP BY 1)
SELECT frame, atom, round(px - cx + 1.37e-7, 5) AS px, round(py - cy + 1.37e-7, 5) AS py, round(pz - cz + 1.37e-7, 5) AS pz FROM atm JOIN c USING (frame)""")
def _(spark, base):
    c = S.centred(order_atoms(spark, base), F.col("z") + 0.37)
    return c.select("frame", "atom", *[F.round(F.col(p) + 1.37e-7, 5).alias(p) for p in ("px", "py", "pz")])


@query("tilt_angles", f"""WITH {ATOM_SQL}, p AS (SELECT frame, count(*) AS n, arg_min(px, atom) AS x0, arg_max(px, atom) AS x1, arg_min(py, atom) AS y0, arg_max(py, atom) AS y1, arg_min(pz, atom) AS z0, arg_max(pz, atom) AS z1 FROM atm WHERE is_ads GROUP BY 1 HAVING count(*) = 2),
t AS (SELECT frame, degrees(acos(least(1.0::DOUBLE, abs(z1 - z0) / sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2) + pow(z1 - z0, 2))))) AS tilt FROM p)
SELECT frame, round(tilt, 3) AS tilt FROM t""")
def _(spark, base):
    """Tilt of two-atom adsorbates from their principal axis."""
    ax = S.principal_axes(order_atoms(spark, base).where("is_ads")).where("n_atoms = 2")
    return ax.select("frame", F.round(tilt_deg(F.col("axis_x"), F.col("axis_y"), F.col("axis_z")), 3).alias("tilt"))


@query("principal_axes")
def _(spark, base):
    ax = S.principal_axes(order_atoms(spark, base).where("is_ads")).where("n_atoms >= 3")
    return ax.select("frame", *[F.round(c, 6).alias(c) for c in ax.columns if c[:4] in ("axis", "norm")])


@query("covalent_radius_sums", f"WITH {ATOM_SQL} SELECT frame, round(sum(r), 6) AS radii, count(*) AS n FROM atm GROUP BY 1")
def _(spark, base):
    return order_atoms(spark, base).groupBy("frame").agg(F.round(F.sum(covalent_radius("z")), 6).alias("radii"), F.count(F.lit(1)).alias("n"))


@query("quaternion_chain", """
WITH q AS (SELECT event_id, value / 100.0 AS a, (event_id % 360) / 57.0 AS b FROM events)
SELECT event_id, round(2 * acos(least(1.0::DOUBLE, abs(cos(a / 2) * cos(b / 2)))), 6) AS angle FROM q""")
def _(spark, base):
    """Angle of a rotation about z followed by one about x."""
    from sievelark.functions.exprs import axis_quaternion

    qa, qb = axis_quaternion((0, 0, 1), F.col("value") / 100.0), axis_quaternion((1, 0, 0), (F.col("event_id") % 360) / 57.0)
    one = F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))
    return table(spark, base, "events").select("event_id", F.round(quaternion_angle(quaternion_product(qa, qb), one), 6).alias("angle"))


@query("reference_heights", """
WITH p AS (SELECT p_partkey, p_size % 3 + 1 AS n, CASE p_size % 3 WHEN 0 THEN 'monatomic' WHEN 1 THEN 'diatomic' ELSE 'nonlinear' END AS shape, CASE p_size % 4 WHEN 0 THEN 'ontop' WHEN 1 THEN 'short-bridge' WHEN 2 THEN 'fcc' ELSE '4c' END AS site FROM part),
c AS (SELECT *, CASE site WHEN 'ontop' THEN 1 WHEN 'short-bridge' THEN 2 WHEN 'fcc' THEN 3 ELSE 4 END AS co FROM p)
SELECT p_partkey, co AS coordination, (CASE WHEN n = 1 THEN CASE WHEN co >= 3 THEN 0.9 WHEN co = 2 THEN 1.0 ELSE 1.1 END
 ELSE greatest(CASE WHEN shape = 'diatomic' THEN CASE WHEN co <= 1 THEN 1.75 WHEN co = 2 THEN 1.55 ELSE 1.45 END ELSE 0 END, CASE co WHEN 1 THEN 1.85 WHEN 2 THEN 1.70 WHEN 3 THEN 1.55 ELSE 1.45 END) END)::DOUBLE AS height FROM c""")
def _(spark, base):
    k, m = F.col("p_size") % 3, F.col("p_size") % 4
    shape = F.when(k == 0, "monatomic").when(k == 1, "diatomic").otherwise("nonlinear")
    site = F.when(m == 0, "ontop").when(m == 1, "short-bridge").when(m == 2, "fcc").otherwise("4c")
    p = table(spark, base, "part").select("p_partkey", (k + 1).alias("n"), shape.alias("shape"), site_coordination(site).alias("coordination"))
    return p.select("p_partkey", "coordination", reference_height(F.col("n"), F.col("shape"), F.col("coordination")).alias("height"))


# --- signatures and node ids -------------------------------------------------

@query("binding_signatures", f"WITH {ATOM_SQL}, {PAIR_SQL} SELECT frame, substr(sha1(string_agg(ads || ':' || surf, ',' ORDER BY ads, surf)), 1, 16) AS signature FROM pr GROUP BY 1")
def _(spark, base):
    return S.absolute_signature(S.binding_pairs(order_atoms(spark, base)))


@query("pattern_signatures", f"""WITH {ATOM_SQL}, {PAIR_SQL}, c AS (SELECT frame, ads, any_value(CASE z_ads WHEN 1 THEN 'H' WHEN 6 THEN 'C' WHEN 7 THEN 'N' ELSE 'O' END) AS s, count(*) AS n FROM pr GROUP BY 1, 2)
SELECT frame, substr(sha1(string_agg(ads || ':' || s || ':' || n, ',' ORDER BY ads)), 1, 16) AS signature FROM c GROUP BY 1""")
def _(spark, base):
    return S.pattern_signature(S.binding_pairs(order_atoms(spark, base)))


@query("provenance_signatures", f"""WITH {ATOM_SQL}, {PAIR_SQL}, f AS (SELECT o_orderkey AS frame, CASE WHEN o_orderstatus = 'P' THEN 'basis=' || o_custkey ELSE o_orderpriority END AS l FROM orders)
SELECT f.frame, substr(sha1(coalesce(string_agg(ads || ':' || l, ',' ORDER BY ads, surf), 'free:' || any_value(l))), 1, 16) AS signature FROM f LEFT JOIN pr USING (frame) GROUP BY 1""")
def _(spark, base):
    f = table(spark, base, "orders").select(F.col("o_orderkey").alias("frame"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("site_label"), F.col("o_custkey").alias("basis_id"))
    return S.provenance_signature(f, S.binding_pairs(order_atoms(spark, base)))


ENV_SQL = f"""nn AS (SELECT a.frame, a.atom, {DIST} AS d, row_number() OVER (PARTITION BY a.frame, a.atom ORDER BY {DIST}, b.atom) AS rk FROM atm a JOIN atm b ON a.frame = b.frame AND a.atom <> b.atom AND NOT a.is_ads AND NOT b.is_ads),
nt AS (SELECT frame, atom, string_agg(printf('%.3f', d), ',' ORDER BY rk) AS t FROM nn WHERE rk <= 6 AND d > 1e-8 GROUP BY 1, 2),
env AS MATERIALIZED (SELECT a.frame, a.atom, CASE WHEN count(*) OVER (PARTITION BY a.frame) <= 1 THEN 's' || a.atom ELSE 'Z' || a.z || '|' || coalesce(t, '') END AS env FROM atm a LEFT JOIN nt USING (frame, atom) WHERE NOT a.is_ads)"""


@query("canonical_signatures", f"WITH {ATOM_SQL}, {PAIR_SQL}, {ENV_SQL} SELECT pr.frame, substr(sha1(string_agg(ads || ':' || env, ',' ORDER BY ads, surf)), 1, 16) AS signature FROM pr JOIN env ON env.frame = pr.frame AND env.atom = pr.surf GROUP BY 1")
def _(spark, base):
    a = settle(order_atoms(spark, base))
    return S.canonical_signature(S.binding_pairs(a), S.environment_text(a.where("not is_ads")))


@query("surface_keys", f"""WITH {ATOM_SQL}, {PAIR_SQL}, {ENV_SQL}, site AS (SELECT DISTINCT frame, surf AS atom FROM pr),
sx AS (SELECT atm.* FROM atm SEMI JOIN site ON site.frame = atm.frame AND site.atom = atm.atom), pe AS (SELECT a.frame, a.atom AS i, b.atom AS j, {DIST} AS d FROM sx a JOIN sx b ON a.frame = b.frame AND a.atom <> b.atom),
pp AS (SELECT frame, i AS surf, string_agg(printf('%.3f', d), ',' ORDER BY d) AS t FROM pe GROUP BY 1, 2), gg AS (SELECT frame, string_agg(printf('%.3f', d), ',' ORDER BY d) AS t FROM pe WHERE i < j GROUP BY 1),
u AS (SELECT pr.frame, pr.ads, pr.surf, pr.ads || ':' || env AS k, pr.ads || ':' || env || '|peer:' || coalesce(pp.t, '') AS g FROM pr JOIN env ON env.frame = pr.frame AND env.atom = pr.surf LEFT JOIN pp ON pp.frame = pr.frame AND pp.surf = pr.surf)
SELECT u.frame, substr(sha1(string_agg(k, '|' ORDER BY ads, u.surf)), 1, 16) AS surface_env_key, substr(sha1('S:' || string_agg(g, '|' ORDER BY ads, u.surf) || '|G:' || coalesce(any_value(gg.t), '')), 1, 20) AS surface_geometry_key FROM u LEFT JOIN gg USING (frame) GROUP BY 1""")
def _(spark, base):
    a = settle(order_atoms(spark, base))
    slab = a.where("not is_ads")
    return S.surface_keys(settle(S.binding_pairs(a)), S.environment_text(slab), slab)


def _molecules(spark, base):
    """Adsorbate atoms and bonds with table-wide vertex numbers."""
    a = settle(order_atoms(spark, base))
    v = lambda c: (F.col("frame") * 1_000_000_000 + F.col(c))
    ads = a.where("is_ads").select("frame", v("atom").alias("v"), "z", "atom")
    b = S.bonds(a).select(v("i").alias("src"), v("j").alias("dst"))
    return a, settle(ads), settle(b)


def _labels(k):
    prev = f"l{k}"
    return f"""l{k + 1} AS MATERIALIZED (SELECT o.frame, o.atom, o.z, o.deg, o.rounds, CASE WHEN o.rounds > {k} THEN sha1(o.label || '|' || coalesce(n.t, '')) ELSE o.label END AS label FROM {prev} o
 LEFT JOIN (SELECT bb.frame, bb.i, string_agg(p.label, '|' ORDER BY p.label) AS t FROM bb JOIN {prev} p ON p.frame = bb.frame AND p.atom = bb.j GROUP BY 1, 2) n ON n.frame = o.frame AND n.i = o.atom)"""


CANON_SQL = f"""{ATOM_SQL}, {BOND_SQL}, bb AS (SELECT frame, i, j FROM bond UNION ALL SELECT frame, j, i FROM bond), dd AS (SELECT frame, i AS atom, count(*) AS deg FROM bb GROUP BY 1, 2),
l0 AS MATERIALIZED (SELECT a.frame, a.atom, a.z, coalesce(deg, 0) AS deg, 'Z' || a.z || '|D' || coalesce(deg, 0) AS label, CASE WHEN count(*) OVER (PARTITION BY a.frame) <= 1 THEN 0 ELSE least(6, greatest(2, count(*) OVER (PARTITION BY a.frame))) END AS rounds FROM atm a LEFT JOIN dd USING (frame, atom) WHERE is_ads),
{", ".join(_labels(k) for k in range(6))},
co AS MATERIALIZED (SELECT frame, atom, z, row_number() OVER (PARTITION BY frame ORDER BY label, z, deg, atom) - 1 AS pos FROM l6)"""


@query("canonical_order", f"WITH {CANON_SQL} SELECT frame, atom, pos AS position FROM co")
def _(spark, base):
    _, ads, b = _molecules(spark, base)
    o = G.canonical_order(ads.drop("atom"), b)
    return o.select("frame", (F.col("v") - F.col("frame") * 1_000_000_000).alias("atom"), "position")


@query("node_ids", f"""WITH {CANON_SQL}, {PAIR_SQL}, zz AS (SELECT frame, string_agg(z::VARCHAR, ',' ORDER BY pos) AS t FROM co GROUP BY 1),
bp AS (SELECT bond.frame, least(p.pos, q.pos) AS i, greatest(p.pos, q.pos) AS j FROM bond JOIN co p ON p.frame = bond.frame AND p.atom = bond.i JOIN co q ON q.frame = bond.frame AND q.atom = bond.j),
bt AS (SELECT frame, string_agg(i || '-' || j, ',' ORDER BY i, j) AS t FROM bp GROUP BY 1),
st AS (SELECT pr.frame, string_agg(pos || ':' || surf, ',' ORDER BY pos, surf) AS t FROM pr JOIN co ON co.frame = pr.frame AND co.atom = pr.ads GROUP BY 1)
SELECT zz.frame, substr(sha1('Z:' || zz.t || '|B:' || coalesce(bt.t, '') || '|S:' || coalesce(st.t, '')), 1, 20) AS node_id FROM zz LEFT JOIN bt USING (frame) LEFT JOIN st USING (frame)""")
def _(spark, base):
    a, ads, b = _molecules(spark, base)
    o = settle(G.canonical_order(ads.drop("atom"), b))
    p = S.binding_pairs(a).select((F.col("frame") * 1_000_000_000 + F.col("ads")).alias("v"), "surf")
    return G.node_ids(o, b, p)
