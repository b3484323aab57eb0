"""Grouped statistics, audits, scores and model-evaluation aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelark.functions.exprs import safe_ratio, tilt_bin
from sievelark.operators import reports as R
from sievelark.operators.stats import (fence_limits, histogram, kernel_density, normal_equations, pair_distance_sums, parity_metrics,
                                       quantiles)
from sievelark.operators.tiles import prepared
from sievelark.plans.catalog.registry import query
from sievelark.plans.catalog.selection import VEC_SQL, scored_vectors
from sievelark.sources.tables import table, vectors


def rounded(df, n=4):
    return df.select(*[F.round(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("count_by_key", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1")
def _(spark, base):
    return table(spark, base, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("n_users"))


@query("count_map", """
SELECT o_custkey, string_agg(o_orderpriority || ':' || n, ',' ORDER BY o_orderpriority || ':' || n) AS counts
FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1""")
def _(spark, base):
    return R.count_map(table(spark, base, "orders"), ["o_custkey"], "o_orderpriority")


@query("group_stats", """
SELECT o_custkey, count(*) AS n, round(min(o_totalprice), 4) AS value_min, round(max(o_totalprice), 4) AS value_max,
  round(max(o_totalprice) - min(o_totalprice), 4) AS value_span, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS o_orderstatus_set FROM orders GROUP BY 1""")
def _(spark, base):
    g = R.group_stats(table(spark, base, "orders"), ["o_custkey"], "o_totalprice", distinct=["o_orderstatus"])
    return rounded(g.withColumn("o_orderstatus_set", F.array_join("o_orderstatus_set", ",")))


@query("argmin_representative", "SELECT p_type, first(p_partkey ORDER BY p_retailprice, p_partkey) AS rep, min(p_retailprice) AS price, count(*) AS n FROM part GROUP BY 1")
def _(spark, base):
    return table(spark, base, "part").groupBy("p_type").agg(F.min_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("rep"),
                                                            F.min("p_retailprice").alias("price"), F.count(F.lit(1)).alias("n"))


@query("signature_dedup", """
SELECT sig AS signature, min(p_partkey) AS first_seen, first(p_partkey ORDER BY p_retailprice, p_partkey) AS rep, count(*) AS n_members
FROM (SELECT *, substr(sha1(p_brand || '|' || p_type), 1, 16) AS sig FROM part) GROUP BY 1""")
def _(spark, base):
    from sievelark.functions.exprs import short_sha1

    p = table(spark, base, "part").withColumn("signature", short_sha1(F.concat_ws("|", "p_brand", "p_type")))
    return p.groupBy("signature").agg(F.min("p_partkey").alias("first_seen"), F.min_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("rep"),
                                      F.count(F.lit(1)).alias("n_members"))


@query("basin_dictionary", """
WITH b AS (SELECT l_suppkey AS basin, count(*) AS n_members, count(DISTINCT l_partkey) AS n_parts, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1),
s AS (SELECT s_suppkey AS basin, n_name AS node FROM supplier JOIN nation ON n_nationkey = s_nationkey),
j AS (SELECT b.*, s.node, count(*) OVER (PARTITION BY s.node) AS shared FROM b LEFT JOIN s USING (basin))
SELECT basin, n_members, n_parts, round(lo, 4) AS energy_min, round(hi - lo, 4) AS energy_span, node, shared > 1 AS suspect FROM j""")
def _(spark, base):
    """Member statistics per basin, its node, and whether the node is shared by several basins."""
    b = table(spark, base, "lineitem").groupBy(F.col("l_suppkey").alias("basin")).agg(
        F.count(F.lit(1)).alias("n_members"), F.countDistinct("l_partkey").alias("n_parts"), F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))
    n = table(spark, base, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("node"))
    s = table(spark, base, "supplier").select(F.col("s_suppkey").alias("basin"), "s_nationkey").join(n, "s_nationkey").select("basin", "node")
    shared = b.select("basin").join(s, "basin").groupBy("node").agg((F.count(F.lit(1)) > 1).alias("suspect"))
    return b.join(s, "basin", "left").join(shared, "node", "left").select(
        "basin", "n_members", "n_parts", F.round("lo", 4).alias("energy_min"), F.round(F.col("hi") - F.col("lo"), 4).alias("energy_span"), "node",
        F.coalesce("suspect", F.lit(False)).alias("suspect"))


@query("member_spread", "WITH " + VEC_SQL + """,
f AS (SELECT label, min(vec_id) AS fid, arg_min(x, vec_id) AS fx FROM v GROUP BY 1)
SELECT label, count(*) AS n_members, round(min(d), 4) AS rmsd_min, round(max(d), 4) AS rmsd_max, round(avg(d), 4) AS rmsd_mean
FROM (SELECT v.label, CASE WHEN v.vec_id <> fid THEN list_distance(v.x, fx) END AS d FROM v JOIN f USING (label)) GROUP BY label""")
def _(spark, base):
    from sievelark.functions.exprs import l2

    v = vectors(spark, base).select("label", "vec_id", "embedding")
    return rounded(R.member_spread(v, ["label"], ["vec_id"], lambda a, b: l2(a["embedding"], b["embedding"])))


ID_SQL = """r AS (SELECT l_suppkey AS c, l_returnflag || l_linestatus || (l_partkey % 7) AS obs, (l_partkey % 7) || ':' || (l_linenumber % 3) AS leg, l_partkey % 7 AS geo, l_quantity % 5 AS mrg FROM lineitem)"""


def _identities(spark, base):
    k = F.col("l_partkey") % 7
    return table(spark, base, "lineitem").select(
        F.col("l_suppkey").alias("c"), F.concat("l_returnflag", "l_linestatus", k.cast("string")).alias("obs"),
        F.concat_ws(":", k.cast("string"), (F.col("l_linenumber") % 3).cast("string")).alias("leg"), k.alias("geo"), (F.col("l_quantity") % 5).alias("mrg"))


@query("inflation_audit", "WITH " + ID_SQL + """,
p AS (SELECT c, geo, count(DISTINCT obs) AS o, count(*) AS n FROM r GROUP BY 1, 2), s AS (SELECT c, count(*) FILTER (WHERE o > 1) AS sg, coalesce(sum(n) FILTER (o > 1), 0) AS sr FROM p GROUP BY 1)
SELECT c, count(*) AS n_rows, count(DISTINCT obs) AS n_observed, count(DISTINCT leg) AS n_legacy, count(DISTINCT geo) AS n_geometry, any_value(sg) AS split_groups, any_value(sr)::BIGINT AS split_rows,
 count(DISTINCT obs) - count(DISTINCT geo) AS inflation_observed, count(DISTINCT leg) - count(DISTINCT geo) AS inflation_legacy FROM r JOIN s USING (c) GROUP BY c""")
def _(spark, base):
    return R.inflation_audit(_identities(spark, base), ["c"], "obs", "leg", "geo")


@query("merge_audit", "WITH " + ID_SQL + """,
p AS (SELECT c, mrg, count(DISTINCT obs) AS o, count(DISTINCT geo) AS g FROM r GROUP BY 1, 2), n AS (SELECT c, count(DISTINCT geo) AS n_geometry FROM r GROUP BY 1)
SELECT c, count(*) AS n_merged, count(*) FILTER (WHERE g = 1 AND o > 1) AS redundant_resolved, count(*) FILTER (WHERE g > 1) AS cross_merges, any_value(n_geometry) AS n_geometry, count(*) - any_value(n_geometry) AS delta FROM p JOIN n USING (c) GROUP BY c""")
def _(spark, base):
    return R.merge_audit(_identities(spark, base), ["c"], "mrg", "obs", "geo")


@query("pose_summary_grouping_sets", """
WITH t AS (SELECT event_type AS site, CASE WHEN value < 10 THEN 'upright' WHEN value < 60 THEN 'tilted' ELSE 'flat' END AS bin, value, user_id FROM events)
SELECT coalesce(site, 'all') AS site, count(*) AS n, count(DISTINCT user_id) AS n_primitives, count(*) FILTER (WHERE bin = 'upright') AS upright, count(*) FILTER (WHERE bin = 'tilted') AS tilted, count(*) FILTER (WHERE bin = 'flat') AS flat,
  round(min(value), 4) AS tilt_min, round(max(value), 4) AS tilt_max, round(avg(value), 4) AS tilt_mean FROM t GROUP BY GROUPING SETS ((site), ())""")
def _(spark, base):
    t = table(spark, base, "events").select(F.col("event_type").alias("site"), tilt_bin("value").alias("bin"), "value", "user_id")
    n = lambda b: F.count_if(F.col("bin") == b).alias(b)
    g = t.rollup("site").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("n_primitives"), n("upright"), n("tilted"), n("flat"),
                             F.min("value").alias("tilt_min"), F.max("value").alias("tilt_max"), F.avg("value").alias("tilt_mean"))
    return rounded(g.withColumn("site", F.coalesce("site", F.lit("all"))))


@query("result_summary", """
SELECT p_brand, count(*) AS n, min(p_retailprice) AS lo, max(p_retailprice) AS hi, round(avg(p_retailprice), 4) AS mean, round(stddev_pop(p_retailprice), 4) AS std,
  array_to_string(list_transform(list(p_retailprice ORDER BY p_retailprice)[1:5], lambda v: v::VARCHAR), ',') AS top5 FROM part GROUP BY 1""")
def _(spark, base):
    from sievelark.operators.select import head

    p = table(spark, base, "part").select("p_brand", "p_partkey", "p_retailprice")
    top = head(p, 5, [F.col("p_retailprice"), F.col("p_partkey")], ["p_brand"]).groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_list("p_retailprice")).cast("array<string>"), ",").alias("top5"))
    s = p.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"),
                                 F.round(F.avg("p_retailprice"), 4).alias("mean"), F.round(F.stddev_pop("p_retailprice"), 4).alias("std"))
    return s.join(top, "p_brand")


@query("energy_stats", """
SELECT l_suppkey, count(*) AS n, round(min(l_quantity), 4) AS lo, round(avg(l_quantity), 4) AS mean, round(median(l_quantity), 4) AS median, round(stddev_pop(l_quantity), 4) AS std,
  round(sum(l_discount) / nullif(sum(l_tax), 0), 4) AS ratio FROM lineitem GROUP BY 1""")
def _(spark, base):
    l = table(spark, base, "lineitem")
    s = l.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.min("l_quantity").alias("lo"), F.avg("l_quantity").alias("mean"),
        F.stddev_pop("l_quantity").alias("std"), safe_ratio(F.sum("l_discount"), F.sum("l_tax")).alias("ratio"))
    return rounded(s.join(quantiles(l, "l_quantity", {"median": 0.5}, ["l_suppkey"]), "l_suppkey"))


@query("pair_distance_stats", "WITH " + VEC_SQL + """
SELECT a.label, count(*) AS n_pairs, round(min(list_distance(a.x, b.x)), 4) AS min_dist, round(max(list_distance(a.x, b.x)), 4) AS max_dist, round(avg(list_distance(a.x, b.x)), 4) AS mean_dist
FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1""")
def _(spark, base):
    s = pair_distance_sums(prepared(vectors(spark, base), "vec_id", "embedding", None, "label"))
    return rounded(s.select(F.split("_g", "\u0001")[0].cast("int").alias("label"), "n_pairs", "min_dist", "max_dist", (F.col("sum_dist") / F.col("n_pairs")).alias("mean_dist")))


@query("pair_distance_histogram", "WITH " + VEC_SQL + """
SELECT a.label, floor(list_distance(a.x, b.x) / 0.1)::INTEGER AS bin, count(*) AS n
FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1, 2""")
def _(spark, base):
    edges = [i * 0.1 for i in range(31)]
    s = pair_distance_sums(prepared(vectors(spark, base), "vec_id", "embedding", None, "label"), edges=edges)
    return s.select(F.split("_g", "\u0001")[0].cast("int").alias("label"), "bin", "n")


@query("stage_funnel", """
WITH s AS (SELECT l_returnflag AS g, l_extendedprice AS v, unnest([0, 1, 2, 3]) AS no, l_quantity AS q, l_discount AS d, l_tax AS t FROM lineitem),
k AS (SELECT g, no, v FROM s WHERE no = 0 OR (no = 1 AND q <= 40) OR (no = 2 AND q <= 40 AND d <= 0.05) OR (no = 3 AND q <= 40 AND d <= 0.05 AND t <= 0.02)),
a AS (SELECT g, no, count(*) AS n, avg(v) AS m, stddev_pop(v) AS sd FROM k GROUP BY 1, 2)
SELECT g AS l_returnflag, no AS stage_no, ['raw', 'preselect', 'loose', 'final'][no + 1] AS stage, n, round(m, 2) AS value_mean, round(sd, 2) AS value_std,
  coalesce(lag(n) OVER w, n) - n AS removed, round(n / coalesce(lag(n) OVER w, n), 6) AS retention FROM a WINDOW w AS (PARTITION BY g ORDER BY no)""")
def _(spark, base):
    st = {"raw": F.lit(True), "preselect": F.col("l_quantity") <= 40, "loose": F.col("l_discount") <= 0.05, "final": F.col("l_tax") <= 0.02}
    l = table(spark, base, "lineitem")
    e = l.withColumn("k0", F.lit(True)).withColumn("k1", st["preselect"]).withColumn("k2", st["loose"]).withColumn("k3", st["final"])
    f = R.stage_funnel(e.select("l_returnflag", "l_extendedprice", "l_quantity", "l_discount", "l_tax"), st, ["l_returnflag"], "l_extendedprice")
    return f.select("l_returnflag", "stage_no", "stage", "n", F.round("value_mean", 2).alias("value_mean"), F.round("value_std", 2).alias("value_std"), "removed",
                    F.round("retention", 6).alias("retention"))


@query("sweep_summary", """
SELECT CASE WHEN p_name LIKE 'small%' THEN 'small' WHEN p_name LIKE 'red%' THEN 'red' WHEN p_name LIKE 'blue%' THEN 'blue' ELSE 'other' END AS family, count(*) AS total,
  count(*) FILTER (WHERE p_size > 5) AS ok, count(*) FILTER (WHERE p_size <= 5) AS failed, min(p_size) AS lo, round(median(p_size), 4) AS mid, max(p_size) AS hi FROM part GROUP BY 1""")
def _(spark, base):
    fam = F.coalesce(*[F.when(F.col("p_name").startswith(f), F.lit(f)) for f in ("small", "red", "blue")], F.lit("other"))
    return table(spark, base, "part").groupBy(fam.alias("family")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("p_size") > 5).alias("ok"), F.count_if(F.col("p_size") <= 5).alias("failed"),
        F.min("p_size").alias("lo"), F.round(F.median("p_size"), 4).alias("mid"), F.max("p_size").alias("hi"))


RUN_SQL = """r AS (SELECT l_shipdate, l_returnflag AS strategy, l_linenumber AS win, l_suppkey % 4 AS thr, l_orderkey, l_quantity AS n_in, floor(l_quantity * l_discount * 10) AS n_out, l_tax * 1000 AS sec FROM lineitem),
s AS (SELECT *, CASE WHEN n_in <= 0 THEN 0.0 ELSE 100.0 * (0.60 * (CASE WHEN n_out > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE + 0.30 * greatest(0.0, 1.0 - abs(n_out / greatest(1, n_in) - 0.65) / 0.65)::DOUBLE + 0.10 * greatest(0.0, 1.0 - sec / 180.0)::DOUBLE) END AS score FROM r)"""


def _runs(spark, base):
    r = table(spark, base, "lineitem").select(
        F.col("l_returnflag").alias("strategy"), F.col("l_linenumber").alias("win"), (F.col("l_suppkey") % 4).alias("thr"), F.col("l_quantity").alias("n_in"),
        F.floor(F.col("l_quantity") * F.col("l_discount") * 10).alias("n_out"), (F.col("l_tax") * 1000).alias("sec"))
    return r.withColumn("score", R.strategy_score(F.col("n_in"), F.col("n_out"), F.col("sec")))


@query("strategy_ranking", "WITH " + RUN_SQL + """
SELECT strategy, win, thr, count(*) AS n, round(avg(score), 4) AS score, round(avg((n_out > 0)::INT), 6) AS rate, round(avg(sec), 4) AS sec FROM s GROUP BY 1, 2, 3""")
def _(spark, base):
    g = _runs(spark, base).groupBy("strategy", "win", "thr").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 4).alias("score"), F.round(F.avg((F.col("n_out") > 0).cast("int")), 6).alias("rate"), F.round(F.avg("sec"), 4).alias("sec"))
    return g.orderBy(F.desc("score"), F.desc("rate"), "sec")


@query("strategy_rollup", "WITH " + RUN_SQL + """,
g AS (SELECT strategy, win, thr, round(avg(score), 6) AS score FROM s GROUP BY 1, 2, 3)
SELECT strategy, first(win ORDER BY score DESC, win, thr) AS best_win, first(thr ORDER BY score DESC, win, thr) AS best_thr, round(max(score), 4) AS best_score, round(avg(score), 4) AS mean_score FROM g GROUP BY 1""")
def _(spark, base):
    g = _runs(spark, base).groupBy("strategy", "win", "thr").agg(F.round(F.avg("score"), 6).alias("score"))
    best = F.min_by(F.struct("win", "thr"), F.struct(-F.col("score"), F.col("win"), F.col("thr")))
    return g.groupBy("strategy").agg(best.alias("b"), F.round(F.max("score"), 4).alias("best_score"), F.round(F.avg("score"), 4).alias("mean_score")).select(
        "strategy", F.col("b.win").alias("best_win"), F.col("b.thr").alias("best_thr"), "best_score", "mean_score")


CASE_SQL = """c AS (SELECT c_custkey, count(o_orderkey) AS n_sites, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_ref, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_ours,
  CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'F') > 0 THEN least(count(*) FILTER (WHERE o_orderstatus = 'O'), count(*) FILTER (WHERE o_orderstatus = 'F')) / count(*) FILTER (WHERE o_orderstatus = 'F') END AS recall
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1),
k AS (SELECT *, CASE WHEN n_sites <= 0 THEN 'manual_reference_missing' WHEN n_ref = 0 AND n_ours = 0 THEN 'both_zero' WHEN n_ref = 0 THEN 'manual_zero_ours_positive'
  WHEN n_ours = 0 THEN 'manual_positive_ours_zero' WHEN abs(recall - 1.0) <= 1e-12 THEN 'full_recall' ELSE 'partial_recall' END AS status FROM c)"""


def _cases(spark, base):
    o = table(spark, base, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n_sites"), F.count_if(F.col("o_orderstatus") == "F").alias("n_ref"), F.count_if(F.col("o_orderstatus") == "O").alias("n_ours"))
    c = table(spark, base, "customer").select("c_custkey").join(o, "c_custkey", "left").fillna(0)
    c = c.withColumn("recall", F.when(F.col("n_ref") > 0, F.least("n_ours", "n_ref") / F.col("n_ref")))
    return c.withColumn("status", R.case_status(F.col("n_sites"), F.lit(""), F.col("n_ref"), F.col("n_ours"), F.col("recall")))


@query("case_status", "WITH " + CASE_SQL + " SELECT c_custkey, n_ref, n_ours, round(recall, 6) AS recall, status FROM k")
def _(spark, base):
    return _cases(spark, base).select("c_custkey", "n_ref", "n_ours", F.round("recall", 6).alias("recall"), "status")


@query("recall_audit", "WITH " + CASE_SQL + """
SELECT count(*) AS n_cases, count(recall) AS n_defined, round(avg(recall), 6) AS mean_recall, count(*) FILTER (WHERE status = 'full_recall') AS n_full, count(*) FILTER (WHERE n_ref = 0) AS n_empty_reference,
  count(*) FILTER (WHERE n_ref = n_ours) AS n_agree, count(*) FILTER (WHERE n_ours > 0) AS n_ours_positive, sum(n_ref)::BIGINT AS total_ref, sum(n_ours)::BIGINT AS total_ours, count(*) FILTER (WHERE n_ours > 2 * n_ref) AS n_suspicious FROM k""")
def _(spark, base):
    return _cases(spark, base).agg(
        F.count(F.lit(1)).alias("n_cases"), F.count("recall").alias("n_defined"), F.round(F.avg("recall"), 6).alias("mean_recall"),
        F.count_if(F.col("status") == "full_recall").alias("n_full"), F.count_if(F.col("n_ref") == 0).alias("n_empty_reference"),
        F.count_if(F.col("n_ref") == F.col("n_ours")).alias("n_agree"), F.count_if(F.col("n_ours") > 0).alias("n_ours_positive"),
        F.sum("n_ref").alias("total_ref"), F.sum("n_ours").alias("total_ours"), F.count_if(F.col("n_ours") > 2 * F.col("n_ref")).alias("n_suspicious"))


@query("match_ratio_by_budget", """
WITH b AS (SELECT d.doc_id % 8 AS k, CASE WHEN l.doc_id IS NULL THEN NULL ELSE l.quality = 1 END AS m FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT k, count(*) FILTER (WHERE m) || '/' || count(m) AS matches, round(count(*) FILTER (WHERE m) / count(m), 6) AS rate FROM b GROUP BY 1""")
def _(spark, base):
    l = table(spark, base, "labels").select("doc_id", (F.col("quality") == 1).alias("m"))
    b = table(spark, base, "documents").select("doc_id", (F.col("doc_id") % 8).alias("k")).join(l, "doc_id", "left")
    n, t = F.count_if("m"), F.count("m")
    return b.groupBy("k").agg(F.concat_ws("/", n.cast("string"), t.cast("string")).alias("matches"), F.round(n / t, 6).alias("rate"))


@query("placement_status", """
WITH a AS (SELECT c_custkey, c_mktsegment, count(o_orderkey) AS n_p, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_q, min(o_totalprice) AS d FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN n_p <= 0 THEN 'zero_primitive' WHEN n_q <= 0 THEN 'zero_pose' WHEN d < 20000 THEN 'soft_clash' ELSE 'ok' END AS status FROM a)
SELECT c_mktsegment, status, count(*) AS n, round(min(d), 2) AS min_value, round(count(*) / sum(count(*)) OVER (PARTITION BY c_mktsegment), 6) AS share FROM s GROUP BY 1, 2""")
def _(spark, base):
    o = table(spark, base, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_p"), F.count_if(F.col("o_orderstatus") == "O").alias("n_q"), F.min("o_totalprice").alias("d"))
    a = table(spark, base, "customer").select("c_custkey", "c_mktsegment").join(o, "c_custkey", "left").fillna(0, ["n_p", "n_q"])
    s = a.withColumn("status", R.placement_status(F.col("n_p"), F.col("n_q"), F.col("d"), 20000.0))
    g = s.groupBy("c_mktsegment", "status").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("d"), 2).alias("min_value"))
    t = g.groupBy("c_mktsegment").agg(F.sum("n").alias("_t"))
    return g.join(t, "c_mktsegment").withColumn("share", F.round(F.col("n") / F.col("_t"), 6)).drop("_t")


@query("library_comparison", """
WITH a AS (SELECT l_partkey, count(*) FILTER (WHERE l_returnflag = 'A') AS ours, count(*) FILTER (WHERE l_returnflag = 'R') AS other FROM lineitem GROUP BY 1)
SELECT sum(ours)::BIGINT AS total_ours, sum(other)::BIGINT AS total_other, count(*) FILTER (WHERE ours < other) AS fewer, count(*) FILTER (WHERE ours = other) AS same, count(*) FILTER (WHERE ours > other) AS more FROM a""")
def _(spark, base):
    n = lambda f: F.count_if(F.col("l_returnflag") == f)
    a = table(spark, base, "lineitem").groupBy("l_partkey").agg(n("A").alias("ours"), n("R").alias("other"))
    o, t = F.col("ours"), F.col("other")
    return a.agg(F.sum(o).alias("total_ours"), F.sum(t).alias("total_other"), F.count_if(o < t).alias("fewer"), F.count_if(o == t).alias("same"), F.count_if(o > t).alias("more"))


@query("null_zone", "SELECT l_orderkey, bool_and(l_returnflag = 'N') AS all_none, bool_or(l_returnflag = 'R') AS any_rejected, count(DISTINCT l_linestatus) AS n_modes FROM lineitem GROUP BY 1")
def _(spark, base):
    return table(spark, base, "lineitem").groupBy("l_orderkey").agg(
        F.bool_and(F.col("l_returnflag") == "N").alias("all_none"), F.bool_or(F.col("l_returnflag") == "R").alias("any_rejected"), F.countDistinct("l_linestatus").alias("n_modes"))


@query("parity_metrics", """
WITH p AS (SELECT l_returnflag AS g, l_extendedprice AS t, l_quantity * 1500.0 AS p FROM lineitem)
SELECT g AS l_returnflag, count(*) AS n, round(avg(abs(p - t)), 2) AS mae, round(sqrt(avg((p - t) * (p - t))), 2) AS rmse, round(1.0 - sum((p - t) * (p - t)) / (var_pop(t) * count(*)), 6) AS r2 FROM p GROUP BY 1""")
def _(spark, base):
    p = table(spark, base, "lineitem").withColumn("p", F.col("l_quantity") * 1500.0)
    m = parity_metrics(p, "l_extendedprice", "p", ["l_returnflag"])
    return m.select("l_returnflag", "n", F.round("mae", 2).alias("mae"), F.round("rmse", 2).alias("rmse"), F.round("r2", 6).alias("r2"))


@query("segment_aggregate", "SELECT l_orderkey, count(*) AS n_atoms, round(sum(l_quantity), 4) AS charge, round(avg(abs(l_discount - l_tax)), 6) AS mean_error, round(max(abs(l_discount - l_tax)), 6) AS max_error FROM lineitem GROUP BY 1")
def _(spark, base):
    e = F.abs(F.col("l_discount") - F.col("l_tax"))
    return table(spark, base, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_atoms"), F.round(F.sum("l_quantity"), 4).alias("charge"),
                                                                    F.round(F.avg(e), 6).alias("mean_error"), F.round(F.max(e), 6).alias("max_error"))


@query("element_means", "SELECT l_partkey % 12 AS z, count(*) AS n, round(avg(l_extendedprice), 2) AS mean FROM lineitem GROUP BY 1")
def _(spark, base):
    return table(spark, base, "lineitem").groupBy((F.col("l_partkey") % 12).alias("z")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_extendedprice"), 2).alias("mean"))


@query("mean_pool", "SELECT label, i AS position, round(avg(x), 6) AS value FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding)))::INTEGER AS i FROM embeddings) GROUP BY 1, 2")
def _(spark, base):
    return R.mean_pool(vectors(spark, base), ["label"], "embedding").withColumn("value", F.round("value", 6))


@query("value_histogram", """
WITH l AS (SELECT event_type, min(value) AS lo, max(value) AS hi, least(80, greatest(10, floor(5.0 * sqrt(count(*)))))::INTEGER AS b FROM events GROUP BY 1)
SELECT event_type, least(floor((value - lo) / ((hi - lo) / b)), b - 1)::INTEGER AS bin, count(*) AS n FROM events JOIN l USING (event_type) GROUP BY 1, 2""")
def _(spark, base):
    return histogram(table(spark, base, "events"), "value", group=["event_type"])


@query("kernel_density", """
WITH s AS (SELECT event_type, count(*) AS n, stddev_samp(value) AS sd FROM events GROUP BY 1), g AS (SELECT unnest([0, 25, 50, 100, 200])::DOUBLE AS at)
SELECT event_type, g.at AS at, round(sum(exp(-0.5 * pow((g.at - value) / (sd * pow(n, -0.2)), 2))) / (any_value(n) * any_value(sd * pow(n, -0.2)) * sqrt(2 * pi())), 8) AS density FROM events JOIN s USING (event_type), g GROUP BY 1, 2""")
def _(spark, base):
    k = kernel_density(table(spark, base, "events"), "value", [0, 25, 50, 100, 200], ["event_type"])
    return k.withColumn("density", F.round("density", 8))


@query("fence_limits", """
SELECT event_type, round(quantile_cont(value, 0.25), 4) AS q1, round(quantile_cont(value, 0.75), 4) AS q3, round(quantile_cont(value, 0.05), 4) AS p05, round(quantile_cont(value, 0.95), 4) AS p95,
  round(quantile_cont(value, 0.25) - 2.0 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)), 4) AS low_fence,
  round(quantile_cont(value, 0.75) + 2.0 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)), 4) AS high_fence FROM events GROUP BY 1""")
def _(spark, base):
    return rounded(fence_limits(table(spark, base, "events"), "value", 2.0, ["event_type"]))


@query("reference_regression", "SELECT round(sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity), 6) AS coef, round(avg(l_extendedprice - l_quantity * (SELECT sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity) FROM lineitem)), 4) AS mean_residual FROM lineitem")
def _(spark, base):
    l = table(spark, base, "lineitem")
    c = float(normal_equations(l, [F.col("l_quantity")], F.col("l_extendedprice"))[0])
    return l.agg(F.round(F.lit(c), 6).alias("coef"), F.round(F.avg(F.col("l_extendedprice") - F.col("l_quantity") * c), 4).alias("mean_residual"))


@query("readiness_score", """
SELECT s_suppkey, (s_acctbal > 0)::INT + (s_nationkey < 20)::INT + (n_lines > 500)::INT + (n_parts > 400)::INT + (lo < 1000)::INT AS score FROM supplier
JOIN (SELECT l_suppkey, count(*) AS n_lines, count(DISTINCT l_partkey) AS n_parts, min(l_extendedprice) AS lo FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey""")
def _(spark, base):
    g = table(spark, base, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n_lines"), F.countDistinct("l_partkey").alias("n_parts"), F.min("l_extendedprice").alias("lo"))
    c = [F.col("s_acctbal") > 0, F.col("s_nationkey") < 20, F.col("n_lines") > 500, F.col("n_parts") > 400, F.col("lo") < 1000]
    return table(spark, base, "supplier").join(g, "s_suppkey").select("s_suppkey", R.checks_passed(c).alias("score"))


@query("ablation_extremes", """
WITH g AS (SELECT l_suppkey, l_linenumber AS cfg, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, first(cfg ORDER BY n, cfg) AS lowest, min(n) AS lowest_value, first(cfg ORDER BY n DESC, cfg) AS highest, max(n) AS highest_value, max(n) - min(n) AS delta FROM g GROUP BY 1""")
def _(spark, base):
    g = table(spark, base, "lineitem").groupBy("l_suppkey", F.col("l_linenumber").alias("cfg")).agg(F.countDistinct("l_partkey").alias("n"))
    return R.best_and_worst(g, ["l_suppkey"], "cfg", "n", "cfg")


@query("composite_score", """
WITH c AS (SELECT l_suppkey, count(*) AS n_in, count(DISTINCT l_partkey) AS n_a, count(DISTINCT l_orderkey) AS n_b, avg(l_tax) * 2000 AS sec, count(DISTINCT l_linenumber) / 7.0 AS ready FROM lineitem GROUP BY 1)
SELECT round(100.0 * avg(0.30 * (n_a > 0)::INT + 0.35 * greatest(0.0, 1.0 - abs(n_a / greatest(1, n_in) - 0.65) / 0.65)::DOUBLE + 0.25 * greatest(0.0, 1.0 - 5.0 * abs(n_a - n_b) / greatest(1, n_in))::DOUBLE
 + 0.05 * ready + 0.05 * greatest(0.0, 1.0 - sec / 180.0)::DOUBLE), 4) AS final_score, count(*) AS n_cases FROM c""")
def _(spark, base):
    c = table(spark, base, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n_in"), F.countDistinct("l_partkey").alias("n_a"), F.countDistinct("l_orderkey").alias("n_b"), (F.avg("l_tax") * 2000).alias("sec"),
        (F.countDistinct("l_linenumber") / 7.0).alias("ready"))
    s = R.case_score(F.col("n_a"), F.col("n_b"), F.col("n_in"), F.col("ready"), F.col("sec"))
    return c.agg(F.round(100.0 * F.avg(s), 4).alias("final_score"), F.count(F.lit(1)).alias("n_cases"))


@query("formula", """
WITH c AS (SELECT l_orderkey, ['Al','C','Cu','H','N','O','Pt'][(l_partkey % 7)::INT + 1] AS s, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, string_agg(s || CASE WHEN n > 1 THEN n::VARCHAR ELSE '' END, '' ORDER BY s) AS formula FROM c GROUP BY 1""")
def _(spark, base):
    sym = F.array(*[F.lit(s) for s in ("Al", "C", "Cu", "H", "N", "O", "Pt")])
    c = table(spark, base, "lineitem").groupBy("l_orderkey", F.get(sym, (F.col("l_partkey") % 7).cast("int")).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return R.formula(c, ["l_orderkey"], "s", "n")


@query("compression_ratio", "SELECT p_brand, count(*) AS n_raw, count(DISTINCT p_type || p_size) AS n_basis, round(count(DISTINCT p_type || p_size) / count(*), 6) AS ratio FROM part GROUP BY 1")
def _(spark, base):
    b = F.countDistinct(F.concat("p_type", F.col("p_size").cast("string")))
    n = F.count(F.lit(1))
    return table(spark, base, "part").groupBy("p_brand").agg(n.alias("n_raw"), b.alias("n_basis"), F.round(b / n, 6).alias("ratio"))


@query("reaudit_levels", """
SELECT l_suppkey, count(DISTINCT round(l_tax, 6)) AS n_levels, array_to_string(list_transform(list_sort(list(DISTINCT round(l_tax, 6)), 'DESC'), lambda v: v::VARCHAR), ',') AS levels, count(*) FILTER (WHERE l_returnflag = 'A') AS n_a, count(*) FILTER (WHERE l_returnflag = 'N') AS n_n FROM lineitem GROUP BY 1""")
def _(spark, base):
    z = F.round("l_tax", 6)
    return table(spark, base, "lineitem").groupBy("l_suppkey").agg(
        F.countDistinct(z).alias("n_levels"), F.array_join(F.sort_array(F.collect_set(z), False).cast("array<string>"), ",").alias("levels"), F.count_if(F.col("l_returnflag") == "A").alias("n_a"), F.count_if(F.col("l_returnflag") == "N").alias("n_n"))


@query("adsorption_energy", """
SELECT o_orderpriority, count(*) AS n, round(min(e), 4) AS e_min, round(avg(e), 4) AS e_mean, round(median(e), 4) AS e_median
FROM (SELECT o_orderpriority, o_totalprice - 10.0 * c_acctbal - 50000.0 AS e FROM orders JOIN customer ON c_custkey = o_custkey) GROUP BY 1""")
def _(spark, base):
    c = table(spark, base, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    e = table(spark, base, "orders").join(c, "o_custkey").withColumn("e", F.col("o_totalprice") - 10.0 * F.col("c_acctbal") - 50000.0)
    s = e.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("e"), 4).alias("e_min"), F.round(F.avg("e"), 4).alias("e_mean"))
    return s.join(quantiles(e, "e", {"e_median": 0.5}, ["o_orderpriority"]).withColumn("e_median", F.round("e_median", 4)), "o_orderpriority")
