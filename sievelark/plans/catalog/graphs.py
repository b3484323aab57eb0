"""Graph queries over an order graph derived from lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelark.operators.components import components
from sievelark.operators.graph import both_ways, chordless_squares, degrees, refined_classes, ring_count, triangles
from sievelark.plans.catalog.registry import query
from sievelark.sources.tables import table

# an order is linked to an order of its block of 50, picked by the part of each line
EDGE_SQL = """e AS (SELECT DISTINCT least(s, t) AS src, greatest(s, t) AS dst FROM (
  SELECT l_orderkey AS s, l_orderkey - l_orderkey % 50 + l_partkey % 50 AS t FROM lineitem) WHERE s <> t),
b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e),
dg AS (SELECT src AS v, count(*) AS degree FROM b GROUP BY 1)"""


def order_graph(spark, base):
    l = table(spark, base, "lineitem")
    t = F.col("l_orderkey") - F.col("l_orderkey") % 50 + F.col("l_partkey") % 50
    e = l.select(F.least("l_orderkey", t).alias("src"), F.greatest("l_orderkey", t).alias("dst"))
    return e.where("src <> dst").distinct()


@query("vertex_degrees", "WITH " + EDGE_SQL + " SELECT v, degree FROM dg")
def _(spark, base):
    return degrees(order_graph(spark, base))


@query("triangles", "WITH " + EDGE_SQL + """
SELECT x.src AS a, x.dst AS b, y.dst AS c FROM e x JOIN e y ON x.dst = y.src JOIN e z ON z.src = x.src AND z.dst = y.dst""")
def _(spark, base):
    return triangles(order_graph(spark, base))


@query("chordless_squares", "WITH " + EDGE_SQL + """,
w AS (SELECT x.src AS p, y.dst AS q, x.dst AS m FROM b x JOIN b y ON x.dst = y.src WHERE x.src < y.dst),
c AS (SELECT w1.p AS a, w1.m AS b, w1.q AS c, w2.m AS d FROM w w1 JOIN w w2 ON w1.p = w2.p AND w1.q = w2.q AND w1.m < w2.m WHERE w1.p < w1.m)
SELECT a, b, c, d FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.src = c.a AND e.dst = c.c) AND NOT EXISTS (SELECT 1 FROM e WHERE e.src = c.b AND e.dst = c.d)""")
def _(spark, base):
    return chordless_squares(order_graph(spark, base))


REFINE = "SELECT o.v, md5(o.label || '|' || coalesce(n.t, '')) AS label FROM {prev} o LEFT JOIN (SELECT b.src, string_agg(p.label, '/' ORDER BY p.label) AS t FROM b JOIN {prev} p ON p.v = b.dst GROUP BY 1) n ON n.src = o.v"


@query("refined_classes", "WITH " + EDGE_SQL + ", l0 AS (SELECT o_orderkey AS v, o_orderstatus || coalesce(degree, 0) AS label FROM orders LEFT JOIN dg ON v = o_orderkey), "
       + ", ".join(f"l{i + 1} AS MATERIALIZED ({REFINE.format(prev=f'l{i}')})" for i in range(2)) + """
SELECT v, min(v) OVER (PARTITION BY label) AS class, count(*) OVER (PARTITION BY label) AS class_size FROM l2""")
def _(spark, base):
    """Two rounds of refinement from order status and degree."""
    e = order_graph(spark, base)
    d = degrees(e)
    v = table(spark, base, "orders").select(F.col("o_orderkey").alias("v"), "o_orderstatus").join(d, "v", "left").fillna(0, ["degree"])
    v = v.select("v", F.concat("o_orderstatus", F.col("degree").cast("string")).alias("label"))
    return refined_classes(v, e, 2)


REACH = """c AS (SELECT v AS s, v AS t FROM (SELECT src AS v FROM e UNION SELECT dst FROM e) UNION SELECT c.s, b.dst FROM c JOIN b ON b.src = c.t)"""


@query("graph_components", "WITH RECURSIVE " + EDGE_SQL + ", " + REACH + " SELECT s AS id, min(t) AS component FROM c GROUP BY 1")
def _(spark, base):
    return components(order_graph(spark, base))


@query("ring_counts", "WITH RECURSIVE " + EDGE_SQL + ", " + REACH + """,
k AS (SELECT s AS v, min(t) AS component FROM c GROUP BY 1), nv AS (SELECT v // 50 AS block, count(*) AS n_v, count(DISTINCT component) AS n_c FROM k GROUP BY 1),
ne AS (SELECT src // 50 AS block, count(*) AS n_e FROM e GROUP BY 1)
SELECT block, n_v, n_e, n_c, greatest(0, n_e - n_v + n_c) AS rings FROM nv JOIN ne USING (block)""")
def _(spark, base):
    e = order_graph(spark, base)
    block = lambda c: F.floor(F.col(c) / 50).alias("block")
    c = components(e.withColumn("block", block("src")), "block").withColumnRenamed("id", "v").withColumn("block", block("v"))
    return ring_count(c, e.withColumn("block", block("src")), c, ["block"]).select("block", "n_v", "n_e", "n_c", "rings")


@query("topology_hash", "WITH " + EDGE_SQL + """
SELECT v // 50 AS block, string_agg(k || 'x' || n, ',' ORDER BY k) AS topo FROM (SELECT v // 50 * 50 AS v, degree AS k, count(*) AS n FROM dg GROUP BY 1, 2) GROUP BY 1""")
def _(spark, base):
    """Sorted degree list per block, run-length written."""
    d = degrees(order_graph(spark, base)).groupBy(F.floor(F.col("v") / 50).alias("block"), F.col("degree").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    s = F.sort_array(F.collect_list(F.struct("k", F.concat_ws("x", F.col("k").cast("string"), F.col("n").cast("string")).alias("t"))))
    return d.groupBy("block").agg(F.array_join(F.transform(s, lambda v: v["t"]), ",").alias("topo"))
