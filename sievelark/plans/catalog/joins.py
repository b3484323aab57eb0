"""Joins, matchings and set comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelark.operators.match import best_matches, first_match
from sievelark.operators.reports import extra_reason, multiset_equal, set_compare, upgraded_status
from sievelark.operators.tiles import cross_pairs, first_partner, k_nearest, near_pairs, prepared
from sievelark.plans.catalog.registry import query
from sievelark.plans.catalog.selection import VEC_SQL, scored_vectors
from sievelark.sources.tables import table, vectors


@query("near_pairs", "WITH " + VEC_SQL + """
SELECT a.vec_id AS first_id, b.vec_id AS second_id, round(list_distance(a.x, b.x), 6) AS d
FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id AND list_distance(a.x, b.x) <= 1.25""")
def _(spark, base):
    p = near_pairs(prepared(vectors(spark, base), "vec_id", "embedding", None, "label"), 1.25)
    return p.select(F.col("_a").alias("first_id"), F.col("_b").alias("second_id"), F.round("_d", 6).alias("d"))


@query("nearest_rows", "WITH " + VEC_SQL + """
SELECT vec_id, other, rank, round(d, 6) AS d FROM (
  SELECT a.vec_id, b.vec_id AS other, list_distance(a.x, b.x) AS d,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.x, b.x), b.vec_id) AS rank
  FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id) WHERE rank <= 6""")
def _(spark, base):
    rows = prepared(vectors(spark, base), "vec_id", "embedding", None, "label")
    n = k_nearest(rows, rows, 6)
    return n.select(F.col("_a").alias("vec_id"), F.col("_b").alias("other"), F.col("_rank").cast("long").alias("rank"), F.round("_d", 6).alias("d"))


@query("cross_set_pairs", "WITH " + VEC_SQL + """
SELECT a.vec_id AS left_id, b.vec_id AS right_id, a.label % 5 = b.label % 5 AS signature_match, round(list_distance(a.x, b.x), 6) AS rmsd
FROM v a JOIN v b ON a.label < 5 AND b.label >= 5 AND list_distance(a.x, b.x) <= 1.2""")
def _(spark, base):
    v = vectors(spark, base)
    return _cross(v).select("left_id", "right_id", "signature_match", F.round("rmsd", 6).alias("rmsd"))


def _cross(v):
    a, b = prepared(v.where("label < 5"), "vec_id", "embedding"), prepared(v.where("label >= 5"), "vec_id", "embedding")
    p = cross_pairs(a, b, 1.2).select(F.col("_a").alias("left_id"), F.col("_b").alias("right_id"), F.col("_d").alias("rmsd"))
    la = v.select(F.col("vec_id").alias("left_id"), F.col("label").alias("_la"))
    lb = v.select(F.col("vec_id").alias("right_id"), F.col("label").alias("_lb"))
    return p.join(la, "left_id").join(lb, "right_id").withColumn("signature_match", F.col("_la") % 5 == F.col("_lb") % 5).drop("_la", "_lb")


@query("maximum_matching")
def _(spark, base):
    """One-to-one matching of two result sets; unique maximum size, partners by rank."""
    return best_matches(_cross(vectors(spark, base))).select("left_id", "right_id", "signature_match", F.round("rmsd", 6).alias("rmsd"))


@query("first_match_overlap", """
WITH a AS (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT'), b AS (SELECT * FROM orders WHERE o_orderpriority = '2-HIGH')
SELECT a.o_orderkey AS left_key, min(b.o_orderkey) AS right_key FROM a JOIN b
ON a.o_custkey = b.o_custkey AND abs(a.o_totalprice - b.o_totalprice) <= 40000 GROUP BY 1""")
def _(spark, base):
    """Equal signature and close value: the first partner wins and may serve several rows."""
    o = table(spark, base, "orders").withColumn("x", F.array("o_totalprice"))
    side = lambda p: prepared(o.where(F.col("o_orderpriority") == p), "o_orderkey", "x", "o_orderkey", "o_custkey")
    return first_partner(side("1-URGENT"), side("2-HIGH"), 40000.0).select(F.col("_id").alias("left_key"), F.col("_rep").alias("right_key"))


@query("best_partner_per_row", "WITH " + VEC_SQL + """,
p AS (SELECT a.vec_id AS left_id, b.vec_id AS right_id, a.label % 5 = b.label % 5 AS m, list_distance(a.x, b.x) AS d
  FROM v a JOIN v b ON a.label < 5 AND b.label >= 5 AND list_distance(a.x, b.x) <= 1.2)
SELECT left_id, right_id, m AS signature_match, round(d, 6) AS rmsd FROM p QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY NOT m, d, right_id) = 1""")
def _(spark, base):
    p = first_match(_cross(vectors(spark, base)), ["left_id"], [~F.col("signature_match"), F.col("rmsd"), F.col("right_id")])
    return p.select("left_id", "right_id", "signature_match", F.round("rmsd", 6).alias("rmsd"))


@query("lookup_join", """
SELECT c.c_custkey, n.n_name AS nation, r.r_name AS region, count(o.o_orderkey) AS n_orders
FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY ALL""")
def _(spark, base):
    c, n, r = (table(spark, base, t) for t in ("customer", "nation", "region"))
    o = table(spark, base, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    j = c.join(n, c["c_nationkey"] == n["n_nationkey"], "left").join(r, n["n_regionkey"] == r["r_regionkey"], "left").join(o, "c_custkey", "left")
    return j.select("c_custkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.coalesce("n_orders", F.lit(0)).alias("n_orders"))


@query("diagnosis_upgrade", """
WITH s AS (SELECT d.doc_id, CASE WHEN n_chars > 2000 THEN 'full_recall' ELSE 'both_zero' END AS status, l.quality = 1 AS diag
  FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT CASE WHEN status = 'both_zero' AND coalesce(diag, false) THEN 'robust_null_zone' ELSE status END AS status, count(*) AS n FROM s GROUP BY 1""")
def _(spark, base):
    d, l = table(spark, base, "documents").select("doc_id", "n_chars"), table(spark, base, "labels")
    s = F.when(F.col("n_chars") > 2000, "full_recall").otherwise("both_zero")
    j = d.join(l.select("doc_id", (F.col("quality") == 1).alias("diag")), "doc_id", "left")
    return j.select(upgraded_status(s, F.col("diag")).alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("side_by_side", """
WITH g AS (SELECT l_suppkey, l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY 1, 2)
SELECT a.l_suppkey AS suppkey, a.n AS base_n, b.n AS other_n, a.qty AS base_qty, b.qty AS other_qty, a.n = b.n AS same_n
FROM g a JOIN g b ON a.l_suppkey = b.l_suppkey AND a.l_returnflag = 'A' AND b.l_returnflag = 'R'""")
def _(spark, base):
    l = table(spark, base, "lineitem").where("l_returnflag in ('A', 'R')")
    g = l.groupBy(F.col("l_suppkey").alias("suppkey"), "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))
    a = g.where("l_returnflag = 'A'").select("suppkey", F.col("n").alias("base_n"), F.col("qty").alias("base_qty"))
    b = g.where("l_returnflag = 'R'").select("suppkey", F.col("n").alias("other_n"), F.col("qty").alias("other_qty"))
    return a.join(b, "suppkey").withColumn("same_n", F.col("base_n") == F.col("other_n"))


@query("schedule_comparison", """
WITH g AS (SELECT o_custkey, o_orderstatus, count(*) AS n, avg(o_totalprice) AS p FROM orders GROUP BY 1, 2),
j AS (SELECT a.n AS n1, b.n AS n2, a.p AS p1, b.p AS p2 FROM g a JOIN g b USING (o_custkey) WHERE a.o_orderstatus = 'F' AND b.o_orderstatus = 'O')
SELECT count(*) AS n_cases, count(*) FILTER (WHERE n1 = n2) AS n_equal, round(avg(n1), 6) AS mean_base, round(avg(n2), 6) AS mean_other, round(avg(p2 - p1), 2) AS mean_delta FROM j""")
def _(spark, base):
    g = table(spark, base, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("p"))
    a = g.where("o_orderstatus = 'F'").select("o_custkey", F.col("n").alias("n1"), F.col("p").alias("p1"))
    b = g.where("o_orderstatus = 'O'").select("o_custkey", F.col("n").alias("n2"), F.col("p").alias("p2"))
    return a.join(b, "o_custkey").agg(F.count(F.lit(1)).alias("n_cases"), F.count_if(F.col("n1") == F.col("n2")).alias("n_equal"),
                                      F.round(F.avg("n1"), 6).alias("mean_base"), F.round(F.avg("n2"), 6).alias("mean_other"),
                                      F.round(F.avg(F.col("p2") - F.col("p1")), 2).alias("mean_delta"))


@query("unmatched_with_reason", """
WITH m AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 40),
anchor AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_discount = 0.0), site AS (SELECT DISTINCT p_brand FROM part JOIN m ON p_partkey = l_partkey)
SELECT p_partkey, CASE WHEN p_partkey NOT IN (SELECT l_partkey FROM anchor) THEN 'binding_atom_outside_manual_anchor_set'
  WHEN p_brand NOT IN (SELECT p_brand FROM site) THEN 'site_label_outside_manual_reference' ELSE 'same_anchor_same_site_unmatched' END AS reason
FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM m)""")
def _(spark, base):
    l, p = table(spark, base, "lineitem"), table(spark, base, "part").select("p_partkey", "p_brand")
    key = F.col("l_partkey").alias("p_partkey")
    m = l.where("l_returnflag = 'R' and l_quantity >= 40").select(key).distinct()
    anchor = l.where("l_discount = 0.0").select(key).distinct().withColumn("_in", F.lit(True))
    site = p.join(m, "p_partkey", "left_semi").select("p_brand").distinct().withColumn("_site", F.lit(True))
    x = p.join(m, "p_partkey", "left_anti").join(anchor, "p_partkey", "left").join(site, "p_brand", "left")
    return x.select("p_partkey", extra_reason(F.col("_in").isNull(), F.col("_site").isNull()).alias("reason"))


@query("fully_mapped_groups", """
SELECT l_orderkey, count(*) AS n_lines FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size <= 40
GROUP BY l_orderkey HAVING count(p_partkey) = count(*)""")
def _(spark, base):
    """Orders whose every part maps into the allowed set; one missing part drops the order."""
    p = table(spark, base, "part").where("p_size <= 40").select(F.col("p_partkey").alias("l_partkey")).withColumn("_in", F.lit(1))
    j = table(spark, base, "lineitem").select("l_orderkey", "l_partkey").join(p, "l_partkey", "left")
    return j.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"), F.count("_in").alias("_m")).where("n_lines = _m").drop("_m")


@query("member_gather", """
WITH m AS (SELECT user_id AS basin, event_id + (event_id % 3) * 100000000 AS member FROM events)
SELECT basin, count(e.event_id) AS n_found, count(*) - count(e.event_id) AS n_missing, round(min(e.value), 4) AS value_min
FROM m LEFT JOIN events e ON e.event_id = m.member GROUP BY basin""")
def _(spark, base):
    """Look members up by id; ids without a row are counted, not kept."""
    e = table(spark, base, "events").select("event_id", "user_id", "value")
    m = e.select(F.col("user_id").alias("basin"), (F.col("event_id") + (F.col("event_id") % 3) * 100000000).alias("event_id"))
    j = m.join(e.select("event_id", "value"), "event_id", "left")
    return j.groupBy("basin").agg(F.count("value").alias("n_found"), F.count_if(F.col("value").isNull()).alias("n_missing"), F.round(F.min("value"), 4).alias("value_min"))


@query("positional_join", """
WITH a AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS i FROM orders WHERE o_orderpriority = '1-URGENT'),
b AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS i FROM orders WHERE o_orderpriority = '5-LOW')
SELECT a.o_orderstatus, a.i - 1 AS position, a.o_orderkey AS left_key, b.o_orderkey AS right_key FROM a JOIN b ON a.o_orderstatus = b.o_orderstatus AND a.i = b.i""")
def _(spark, base):
    from sievelark.operators.scan import ordered_scan

    o = table(spark, base, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    rank = lambda p: ordered_scan(o.where(F.col("o_orderpriority") == p), ["o_totalprice", "o_orderkey"], group=["o_orderstatus"], position="position")
    a = rank("1-URGENT").select("o_orderstatus", "position", F.col("o_orderkey").alias("left_key"))
    return a.join(rank("5-LOW").select("o_orderstatus", "position", F.col("o_orderkey").alias("right_key")), ["o_orderstatus", "position"])


@query("sorted_list_equality", """
WITH a AS (SELECT o_custkey, list_sort(list(o_orderpriority)) AS l FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
b AS (SELECT o_custkey, list_sort(list(o_orderpriority)) AS l FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT o_custkey, a.l = b.l AS equal FROM a JOIN b USING (o_custkey)""")
def _(spark, base):
    o = table(spark, base, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority")
    return multiset_equal(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), ["o_custkey"], "o_orderpriority")


@query("set_compare", """
WITH a AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'N'),
j AS (SELECT coalesce(a.l_suppkey, b.l_suppkey) AS l_suppkey, a.l_partkey AS pa, b.l_partkey AS pb FROM a FULL JOIN b ON a.l_suppkey = b.l_suppkey AND a.l_partkey = b.l_partkey)
SELECT l_suppkey, count(pa) AS n_a, count(pb) AS n_b, count(*) FILTER (WHERE pa IS NOT NULL AND pb IS NOT NULL) AS n_both, count(*) FILTER (WHERE pb IS NULL) AS only_a, count(*) FILTER (WHERE pa IS NULL) AS only_b FROM j GROUP BY 1""")
def _(spark, base):
    l = table(spark, base, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag")
    return set_compare(l.where("l_returnflag = 'A'"), l.where("l_returnflag = 'N'"), ["l_suppkey"], "l_partkey")


@query("union_of_runs", """
SELECT source, count(*) AS n, round(min(value), 4) AS lo, round(max(value), 4) AS hi FROM (
  SELECT 'orders' AS source, o_totalprice AS value FROM orders UNION ALL SELECT 'events', value FROM events UNION ALL SELECT 'parts', p_retailprice FROM part) GROUP BY 1""")
def _(spark, base):
    v = lambda t, c, n: table(spark, base, t).select(F.lit(n).alias("source"), F.col(c).alias("value"))
    u = v("orders", "o_totalprice", "orders").unionByName(v("events", "value", "events")).unionByName(v("part", "p_retailprice", "parts"))
    return u.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("value"), 4).alias("lo"), F.round(F.max("value"), 4).alias("hi"))
