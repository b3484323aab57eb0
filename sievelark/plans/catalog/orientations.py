"""Binding atoms, directions and rotation sets of adsorbates, and second-shell edges of surfaces."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from sievelark.operators import orientation as O
from sievelark.operators import structure as S
from sievelark.operators.poses import tilt_schedule
from sievelark.operators.rows import row_like_edges
from sievelark.plans.catalog.registry import query
from sievelark.plans.catalog.structures import ATOM_SQL, BOND_SQL, DIST, order_atoms
from sievelark.session import settle

BINDING_SQL = f"""{ATOM_SQL}, {BOND_SQL}, ad AS (SELECT * FROM atm WHERE is_ads), bb AS (SELECT frame, i AS atom, j AS o FROM bond UNION ALL SELECT frame, j, i FROM bond),
nb AS (SELECT bb.frame, bb.atom, count(*) AS deg, count(*) FILTER (ad.z = 1) AS h, count(*) FILTER (ad.z = 6) AS c FROM bb JOIN ad ON ad.frame = bb.frame AND ad.atom = bb.o GROUP BY 1, 2),
fa AS (SELECT ad.*, coalesce(deg, 0) AS deg, coalesce(h, 0) AS h, coalesce(c, 0) AS c, count(*) FILTER (ad.z <> 1) OVER w AS heavy, count(*) OVER w AS n, sqrt(pow(px - avg(px) OVER w, 2) + pow(py - avg(py) OVER w, 2) + pow(pz - avg(pz) OVER w, 2)) AS away
 FROM ad LEFT JOIN nb ON nb.frame = ad.frame AND nb.atom = ad.atom WINDOW w AS (PARTITION BY ad.frame)),
ru AS (SELECT *, CASE z WHEN 1 THEN 2.2 WHEN 6 THEN 2.55 WHEN 7 THEN 3.04 ELSE 3.44 END AS en,
 CASE WHEN heavy = 1 OR n = 1 THEN 0 WHEN z IN (7, 8) AND h > 0 THEN 1 WHEN z IN (7, 8) AND c > 0 AND deg <= 2 AND (CASE WHEN heavy > 0 THEN heavy ELSE n END) > 2 THEN 2 WHEN deg <= 1 THEN 3 ELSE 4 END AS rule FROM fa WHERE heavy = 0 OR z <> 1),
ba AS MATERIALIZED (SELECT frame, atom, ['only', 'protic', 'hetero', 'terminal', 'heavy'][rule + 1] AS rule FROM ru
 QUALIFY row_number() OVER (PARTITION BY frame ORDER BY ru.rule, CASE WHEN ru.rule IN (1, 2) THEN -en ELSE en END, CASE WHEN ru.rule IN (1, 2) THEN deg ELSE -away END, CASE WHEN ru.rule IN (1, 2) THEN -away ELSE r END, atom) = 1)"""


def _binding(spark, base):
    a = settle(order_atoms(spark, base))
    return a.where("is_ads"), settle(O.binding_atoms(a.where("is_ads"), S.bonds(a)))


@query("binding_atoms", f"WITH {BINDING_SQL} SELECT frame, atom, rule FROM ba")
def _(spark, base):
    """The atom through which every order's adsorbate binds, and the rule that chose it."""
    return _binding(spark, base)[1]


@query("donor_direction", f"""WITH {BINDING_SQL},
vv AS (SELECT a.frame, b.atom, b.px - a.px AS x, b.py - a.py AS y, b.pz - a.pz AS z FROM ba JOIN ad a USING (frame, atom) JOIN ad b ON b.frame = a.frame AND b.atom <> a.atom),
uv AS MATERIALIZED (SELECT frame, atom, x / l AS x, y / l AS y, z / l AS z FROM (SELECT *, sqrt(x * x + y * y + z * z) AS l FROM vv) WHERE l > 1e-12),
ca AS (SELECT frame, 0 AS kind, atom AS i, 0::BIGINT AS j, x, y, z FROM uv UNION ALL SELECT a.frame, 1, a.atom, b.atom, a.x + b.x, a.y + b.y, a.z + b.z FROM uv a JOIN uv b ON a.frame = b.frame AND a.atom < b.atom
 UNION ALL SELECT frame, 2, 0, 0, sum(x), sum(y), sum(z) FROM uv GROUP BY frame),
cu AS (SELECT frame, kind, i, j, x / l AS x, y / l AS y, z / l AS z FROM (SELECT *, sqrt(x * x + y * y + z * z) AS l FROM ca) WHERE l > 1e-12),
sc AS (SELECT c.frame, c.kind, c.i, c.j, c.x, c.y, c.z, min(c.x * u.x + c.y * u.y + c.z * u.z) AS low, avg(c.x * u.x + c.y * u.y + c.z * u.z) AS mean FROM cu c JOIN uv u ON u.frame = c.frame GROUP BY ALL)
SELECT frame, round(x, 5) AS x, round(y, 5) AS y, round(z, 5) AS z, round(low, 5) AS low FROM sc QUALIFY row_number() OVER (PARTITION BY frame ORDER BY round(low, 12) DESC, round(mean, 12) DESC, kind, i, j) = 1""")
def _(spark, base):
    """Direction from the binding atom that keeps the other atoms of its molecule within the narrowest cone."""
    ads, b = _binding(spark, base)
    at = b.select("frame", F.col("atom").alias("_b")).join(ads.select("frame", F.col("atom").alias("_b"), *[F.col(p).alias(f"_{p}") for p in ("px", "py", "pz")]), ["frame", "_b"])
    rel = ads.join(at, "frame").where("atom <> _b").select("frame", F.struct("atom", F.array(*[F.col(p) - F.col(f"_{p}") for p in ("px", "py", "pz")]).alias("v")).alias("s"))
    d = rel.groupBy("frame").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["v"]).alias("v")).withColumn("c", O.cone_direction(F.col("v")))
    unit = F.filter(F.transform("v", O.unit), lambda v: v.isNotNull())
    low = F.array_min(F.transform(unit, lambda v: v[0] * F.col("c")[0] + v[1] * F.col("c")[1] + v[2] * F.col("c")[2]))
    return d.where(F.size(unit) > 0).select("frame", *[F.round(F.col("c")[i], 5).alias(n) for i, n in enumerate("xyz")], F.round(low, 5).alias("low"))


_TARGETS = ", ".join(f"[{s * math.sin(math.radians(t))!r}::DOUBLE, 0.0::DOUBLE, {s * math.cos(math.radians(t))!r}::DOUBLE]" for t in tilt_schedule(4) for s in (1.0, -1.0))
_ANGLE = "2 * acos(least(1, abs(list_dot_product({a}, {b}))))"


@query("rotation_budget", f"""WITH RECURSIVE {ATOM_SQL}, en AS (SELECT frame, first(px ORDER BY atom DESC) - first(px ORDER BY atom) AS x, first(py ORDER BY atom DESC) - first(py ORDER BY atom) AS y, first(pz ORDER BY atom DESC) - first(pz ORDER BY atom) AS z FROM atm WHERE is_ads GROUP BY 1 HAVING count(*) > 1),
ax AS (SELECT frame, [x / sqrt(x * x + y * y + z * z), y / sqrt(x * x + y * y + z * z), z / sqrt(x * x + y * y + z * z)] AS a FROM en),
qs AS (SELECT frame, list_transform([{_TARGETS}], lambda t: [1 + list_dot_product(a, t), a[2] * t[3] - a[3] * t[2], a[3] * t[1] - a[1] * t[3], a[1] * t[2] - a[2] * t[1]]) AS q FROM ax),
cq AS MATERIALIZED (SELECT frame, list_transform(q, lambda v: list_transform(v, lambda w: w / sqrt(list_dot_product(v, v)))) AS q FROM qs),
ch AS (SELECT frame, q, [q[1]] AS c FROM cq UNION ALL SELECT frame, q, list_append(c, q[-list_max(list_transform(range(1, 9), lambda i: {{'d': list_min(list_transform(c, lambda o: {_ANGLE.format(a="o", b="q[i]")})), 'i': -i}})).i]) FROM ch WHERE len(c) < 5),
pk AS (SELECT frame, c, unnest(range(1, 6)) AS i FROM ch WHERE len(c) = 5)
SELECT frame, (i - 1)::INTEGER AS place, round(c[i][1], 5) AS w, round(c[i][2], 5) AS x, round(c[i][3], 5) AS y, round(c[i][4], 5) AS z FROM pk""")
def _(spark, base):
    """Five of the eight tilts of both ends of every adsorbate's long direction, spread by farthest-point choice."""
    ends = order_atoms(spark, base).where("is_ads").groupBy("frame").agg(
        F.min_by(F.array("px", "py", "pz"), "atom").alias("a"), F.max_by(F.array("px", "py", "pz"), "atom").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    vec = lambda *v: F.array(*map(F.lit, v))
    axis = settle(ends.select("frame", O.unit(F.zip_with("b", "a", lambda x, y: x - y)).alias("axis")))
    q = axis.withColumn("q", O.linear_rotations(F.col("axis"), vec(0.0, 0.0, 1.0), vec(1.0, 0.0, 0.0), tilt_schedule(4), 5))
    return q.select("frame", F.posexplode("q").alias("place", "q")).select("frame", "place", *[F.round(F.col("q")[i], 5).alias(n) for i, n in enumerate("wxyz")])


@query("row_like_edges", f"""WITH RECURSIVE {ATOM_SQL}, s AS (SELECT * FROM atm WHERE NOT is_ads),
ed AS MATERIALIZED (SELECT a.frame, a.atom AS src, b.atom AS dst, {DIST} AS d FROM s a JOIN s b ON a.frame = b.frame AND a.atom < b.atom WHERE {DIST} <= 0.8::DOUBLE * (a.r + b.r)),
n AS (SELECT frame, count(*) AS n FROM s GROUP BY 1), e AS (SELECT frame, count(*) AS m, quantile_cont(d, 0.5) AS f FROM ed GROUP BY 1),
inf AS (SELECT * FROM n JOIN e USING (frame) WHERE n >= 4 AND 2 * m / n <= 2.5),
ca AS (SELECT a.frame, a.atom AS src, b.atom AS dst, {DIST} AS d, f, n FROM s a JOIN s b ON a.frame = b.frame AND a.atom < b.atom JOIN inf ON inf.frame = a.frame),
cb AS MATERIALIZED (SELECT ca.*, row_number() OVER (PARTITION BY ca.frame ORDER BY ca.d, ca.src, ca.dst) AS k FROM ca ANTI JOIN ed ON ed.frame = ca.frame AND ed.src = ca.src AND ed.dst = ca.dst WHERE ca.d > f * 1.001::DOUBLE AND ca.d <= f * 1.5::DOUBLE),
wk AS (SELECT frame, n, k, [d] AS ds FROM cb WHERE k = 1 UNION ALL SELECT cb.frame, cb.n, cb.k, list_append(ds, cb.d) FROM wk JOIN cb ON cb.frame = wk.frame AND cb.k = wk.k + 1 WHERE abs(cb.d - list_median(ds)) <= greatest(1e-3, 0.08::DOUBLE * list_median(ds))),
sh AS (SELECT frame, n, max(k) AS m FROM wk GROUP BY 1, 2)
SELECT frame, src, dst, round(d, 6) AS d, 1 AS shell FROM ed UNION ALL SELECT cb.frame, src, dst, round(d, 6), 2 FROM cb JOIN sh USING (frame) WHERE k <= m AND m >= greatest(2, sh.n // 4)""")
def _(spark, base):
    """Surface neighbours and, on row-like surfaces, the next shell."""
    a = settle(order_atoms(spark, base).where("not is_ads"))
    e = S.surface_graph(a, a, scale=0.8)
    return row_like_edges(a, a, e, scale=0.8).select("frame", "src", "dst", F.round("d", 6).alias("d"), "shell")
