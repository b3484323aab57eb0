"""Windows, diversity filters and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelark.operators.convergence import cut_picks, site_occupancy
from sievelark.operators.fps import farthest_points, in_rounds
from sievelark.operators.greedy import diversity_filter
from sievelark.operators.select import (Farthest, GridStop, Rounds, basin_window, dual_diagnostics, dual_flags, dual_threshold, energy_window,
                                        relative_energy, rule, stage_select, target_k)
from sievelark.operators.stats import kmeans_pick_lowest, pca_fit, pooled_kmeans_pick, project
from sievelark.plans.catalog.registry import query
from sievelark.sources.tables import table, vectors

# embeddings with an order value taken from the first component
VEC_SQL = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x,
  round(embedding[1]::DOUBLE, 3) AS e FROM embeddings)"""


def scored_vectors(spark, base):
    return vectors(spark, base).withColumn("e", F.round(F.col("embedding")[0], 3))


# walk the rows of a label in order, carrying the kept rows; {ord} orders, {ok} accepts
WALK_SQL = """WITH RECURSIVE {head},
r AS (SELECT {src}.*, row_number() OVER (PARTITION BY label ORDER BY {ord}) AS k FROM {src}),
w AS (
  SELECT label, k, [vec_id] AS ids, [x] AS xs, [e] AS es FROM r WHERE k = 1
  UNION ALL
  SELECT w.label, r.k,
    CASE WHEN {ok} THEN list_append(w.ids, r.vec_id) ELSE w.ids END,
    CASE WHEN {ok} THEN list_append(w.xs, r.x) ELSE w.xs END,
    CASE WHEN {ok} THEN list_append(w.es, r.e) ELSE w.es END
  FROM w JOIN r ON r.label = w.label AND r.k = w.k + 1),
kept AS (SELECT label, unnest(ids) AS vec_id FROM w
  WHERE k = (SELECT max(k) FROM r WHERE r.label = w.label))
"""
FAR = "list_min(list_transform(w.xs, lambda y: list_distance(y, r.x))) >= {t}"
WINDOWED = "c AS (SELECT v.* FROM v JOIN (SELECT label, min(e) AS m FROM v GROUP BY label) g USING (label) WHERE e <= m + {d})"


@query("energy_window", """
WITH w AS (SELECT p_partkey, p_brand, p_retailprice, min(p_retailprice) OVER (PARTITION BY p_brand) AS lo FROM part),
k AS (SELECT *, p_retailprice - lo AS rel FROM w WHERE p_retailprice <= lo + 20.0)
SELECT p_partkey, p_brand, round(p_retailprice - lo, 4) AS relative_price, arg_min(p_partkey, (p_retailprice, p_partkey)) OVER (PARTITION BY p_brand) AS rep_partkey
FROM k""".replace("arg_min(p_partkey, (p_retailprice, p_partkey)) OVER (PARTITION BY p_brand)",
                  "first_value(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey)"))
def _(spark, base):
    p = table(spark, base, "part").select("p_partkey", "p_brand", "p_retailprice")
    kept = relative_energy(energy_window(p, "p_retailprice", 20.0, group=["p_brand"]), "p_retailprice", group=["p_brand"], name="relative_price")
    rep = kept.groupBy("p_brand").agg(F.min_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("rep_partkey"))
    return kept.join(rep, "p_brand").select("p_partkey", "p_brand", F.round("relative_price", 4).alias("relative_price"), "rep_partkey")


@query("energy_window_global", "SELECT event_id, value FROM events WHERE value <= (SELECT min(value) FROM events) + 5.0")
def _(spark, base):
    return energy_window(table(spark, base, "events").select("event_id", "value"), "value", 5.0)


@query("basin_energy_window", """
WITH w AS (SELECT event_type, value, min(value) OVER (PARTITION BY event_type) AS lo FROM events)
SELECT event_type, CASE WHEN value > lo + 60.0 THEN 'energy_window' END AS reason, count(*) AS n,
  round(max(value - lo), 6) AS max_delta FROM w GROUP BY 1, 2""")
def _(spark, base):
    f = basin_window(table(spark, base, "events").select("event_type", "value"), "value", 60.0, group=["event_type"])
    return f.groupBy("event_type", "reason").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("delta_e"), 6).alias("max_delta"))


@query("relative_energy", """
SELECT o_orderkey, round(o_totalprice - min(o_totalprice) OVER (PARTITION BY o_orderpriority), 4) AS relative_price FROM orders""")
def _(spark, base):
    o = table(spark, base, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return relative_energy(o, "o_totalprice", group=["o_orderpriority"], name="rel").select(
        "o_orderkey", F.round("rel", 4).alias("relative_price"))


@query("diversity_filter", WALK_SQL.format(head=VEC_SQL, src="v", ord="vec_id", ok=FAR.format(t="1.3")) + "SELECT vec_id, label FROM kept")
def _(spark, base):
    v = scored_vectors(spark, base)
    return diversity_filter(v, id="vec_id", feat="embedding", threshold=1.3, order="vec_id", group=["label"]).select("vec_id", "label")


@query("dual_threshold", WALK_SQL.format(head=VEC_SQL + ",\n" + WINDOWED.format(d="0.2"), src="c", ord="e, vec_id", ok=FAR.format(t="1.3"))
       + "SELECT vec_id, label FROM kept")
def _(spark, base):
    v = scored_vectors(spark, base)
    return dual_threshold(v, id="vec_id", energy="e", feat="embedding", delta=0.2, threshold=1.3, group=["label"]).select("vec_id", "label")


@query("pair_gap_filter", WALK_SQL.format(
    head=VEC_SQL, src="v", ord="e, vec_id",
    ok="len(list_filter(list_zip(w.xs, w.es), lambda y: list_distance(y[1], r.x) < 1.35 AND NOT (abs(r.e - y[2]) >= 0.1))) = 0")
    + "SELECT vec_id, label FROM kept")
def _(spark, base):
    v = scored_vectors(spark, base)
    return diversity_filter(v, id="vec_id", feat="embedding", threshold=1.35, order="e", group=["label"], min_gap=0.1).select("vec_id", "label")


@query("dual_filter_diagnostics", WALK_SQL.format(head=VEC_SQL + ",\n" + WINDOWED.format(d="0.2"), src="c", ord="e, vec_id", ok=FAR.format(t="1.3")) + """
SELECT v.label, count(*) AS n_total, round(min(v.e), 6) AS e_min, count(c.vec_id) AS n_energy_keep, count(*) - count(c.vec_id) AS n_energy_drop,
  count(k.vec_id) AS n_rmsd_keep, count(c.vec_id) - count(k.vec_id) AS n_rmsd_drop,
  round(count(c.vec_id)::DOUBLE / count(*), 6) AS frac_energy_keep,
  round(count(k.vec_id)::DOUBLE / count(c.vec_id), 6) AS frac_rmsd_keep_of_energy_keep
FROM v LEFT JOIN c USING (vec_id) LEFT JOIN kept k USING (vec_id) GROUP BY v.label""")
def _(spark, base):
    f = dual_flags(scored_vectors(spark, base), id="vec_id", energy="e", feat="embedding", delta=0.2, threshold=1.3, group=["label"])
    d = dual_diagnostics(f, "e", group=["label"])
    return d.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in d.dtypes])


@query("dual_filter_flags", WALK_SQL.format(head=VEC_SQL + ",\n" + WINDOWED.format(d="0.2"), src="c", ord="e, vec_id", ok=FAR.format(t="1.3")) + """,
kx AS (SELECT k.label, k.vec_id, c.x, c.e FROM kept k JOIN c USING (vec_id)),
m AS (SELECT c.vec_id, min(list_distance(c.x, kx.x)) AS d FROM c LEFT JOIN kx ON kx.label = c.label AND (kx.e, kx.vec_id) < (c.e, c.vec_id) GROUP BY 1)
SELECT v.vec_id, round(v.e - min(v.e) OVER (PARTITION BY v.label), 6) AS delta_e, c.vec_id IS NOT NULL AS energy_keep,
  CASE WHEN c.vec_id IS NULL THEN NULL ELSE round(coalesce(m.d, 'infinity'::DOUBLE), 6) END AS min_dist,
  k.vec_id IS NOT NULL AS rmsd_keep
FROM v LEFT JOIN c USING (vec_id) LEFT JOIN m USING (vec_id) LEFT JOIN kept k USING (vec_id)""")
def _(spark, base):
    f = dual_flags(scored_vectors(spark, base), id="vec_id", energy="e", feat="embedding", delta=0.2, threshold=1.3, group=["label"])
    inf = F.lit(float("inf"))
    d = F.when(F.col("min_dist") == inf, inf).otherwise(F.round("min_dist", 6))
    return f.select("vec_id", F.round("delta_e", 6).alias("delta_e"), "energy_keep", d.alias("min_dist"), "rmsd_keep")


FPS_SQL = """WITH RECURSIVE {head},
f AS (
  SELECT s.g, 0 AS pick, [s.vec_id] AS ids, [s.x] AS xs FROM ({start}) s
  UNION ALL
  SELECT n.g, n.pick, n.ids, n.xs FROM (
    SELECT f.g, f.pick + 1 AS pick, list_append(f.ids, v.vec_id) AS ids, list_append(f.xs, v.x) AS xs,
      row_number() OVER (PARTITION BY f.g ORDER BY {rank}) AS rn
    FROM f JOIN ({pool}) v ON v.g = f.g AND NOT list_contains(f.ids, v.vec_id) WHERE f.pick < {k} - 1) n WHERE n.rn = 1)
SELECT {out} ids[pick + 1] AS vec_id, pick FROM f"""
NEAREST = "round(list_min(list_transform(f.xs, lambda y: list_distance(y, v.x))), 9)"


@query("farthest_points", FPS_SQL.format(
    head=VEC_SQL, start="SELECT label AS g, min(vec_id) AS vec_id, arg_min(x, vec_id) AS x FROM v GROUP BY label",
    pool="SELECT *, label AS g FROM v", rank=NEAREST + " DESC, v.vec_id", k=8, out="g AS label,"))
def _(spark, base):
    v = vectors(spark, base)
    p = farthest_points(v, 8, id="vec_id", feat="embedding", group=["label"], start="first", iterative=True)
    return v.join(p, "vec_id").select("label", "vec_id", F.col("pick").cast("int").alias("pick"))


@query("farthest_points_global", FPS_SQL.format(
    head=VEC_SQL, start="SELECT 0 AS g, min(vec_id) AS vec_id, arg_min(x, vec_id) AS x FROM v",
    pool="SELECT *, 0 AS g FROM v", rank=NEAREST + " DESC, v.vec_id", k=16, out=""))
def _(spark, base):
    p = farthest_points(vectors(spark, base), 16, id="vec_id", feat="embedding", start="first")
    return p.select("vec_id", F.col("pick").cast("int").alias("pick"))


@query("target_k", FPS_SQL.format(
    head=VEC_SQL, start="SELECT label AS g, arg_min(vec_id, e * 1000000 + vec_id) AS vec_id, arg_min(x, e * 1000000 + vec_id) AS x FROM v GROUP BY label",
    pool="SELECT *, label AS g FROM v", rank=NEAREST + " DESC, v.e, v.vec_id", k=6, out="g AS label,"))
def _(spark, base):
    return target_k(scored_vectors(spark, base), 6, id="vec_id", energy="e", feat="embedding", group=["label"]).select(
        "label", "vec_id", F.col("pick").cast("int").alias("pick"))


@query("iterative_sampling_site_convergence")
def _(spark, base):
    """Rounds of four picks until no new label appears; the seeded start is drawn by NumPy."""
    v = vectors(spark, base)
    p = in_rounds(farthest_points(v, 60, id="vec_id", feat="embedding", iterative=True), 4)
    p = p.join(v.select("vec_id", "label"), "vec_id")
    r = site_occupancy(p, F.struct("label"), group=["_g"], patience=2)
    return cut_picks(p, r, ["_g"]).join(r.drop("_g"), "round").select(
        "vec_id", "pick", "round", "n_new_bins", "n_occupied_bins", "stable_rounds", "stop")


@query("stage_selection_grid_convergence")
def _(spark, base):
    cfg = Farthest(48, rounds=Rounds(4, stop=GridStop(variance=0.05, bins=4, min_rounds=2, patience=1, min_gain=0.2, min_novelty=0.6)))
    return stage_select(vectors(spark, base), cfg, id="vec_id", feat="embedding").select("vec_id", "label")


@query("stage_selection_window", WALK_SQL.format(head=VEC_SQL + ",\n" + WINDOWED.format(d="0.25"), src="c", ord="e, vec_id", ok=FAR.format(t="1.3")) + """,
s AS (SELECT k.vec_id, k.label, row_number() OVER (PARTITION BY k.label ORDER BY c.e, k.vec_id) AS rn FROM kept k JOIN c USING (vec_id))
SELECT vec_id, label FROM s WHERE rn <= 5""")
def _(spark, base):
    cfg = rule("molclus", keep=5, window=0.25, distance=1.3)
    return stage_select(scored_vectors(spark, base), cfg, id="vec_id", feat="embedding", energy="e", group=["label"]).select("vec_id", "label")


@query("pca_variance", """
WITH p AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS i FROM embeddings)
SELECT round(sum(s), 4) AS total_scatter, count(*) AS n_axes FROM (SELECT i, var_pop(x) * count(*) AS s FROM p GROUP BY i)""")
def _(spark, base):
    """The eigenvalues of the scatter matrix add up to the summed variances."""
    m = pca_fit(vectors(spark, base), "embedding")
    return spark.range(1).select(F.round(F.lit(float(m.variance.sum())), 4).alias("total_scatter"), F.lit(len(m.variance)).cast("long").alias("n_axes"))


@query("pca_projection")
def _(spark, base):
    v = vectors(spark, base)
    return project(v, "embedding", pca_fit(v, "embedding", n_components=2), "xy").select("vec_id", "label", F.transform("xy", lambda c: F.round(c, 6)).alias("xy"))


@query("kmeans_lowest")
def _(spark, base):
    return kmeans_pick_lowest(scored_vectors(spark, base), id="vec_id", feat="embedding", energy="e", k=8)


@query("pooled_kmeans_lowest")
def _(spark, base):
    return pooled_kmeans_pick(scored_vectors(spark, base), id="vec_id", feat="embedding", energy="e", k=8)
