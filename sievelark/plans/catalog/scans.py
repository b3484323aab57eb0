"""Order-dependent queries: levels, packing, rounds and top lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelark.operators.convergence import stable_counter
from sievelark.operators.scan import anchor_levels, first_shell, gap_levels, next_fit_batches, ordered_scan
from sievelark.operators.select import head
from sievelark.plans.catalog.registry import query
from sievelark.sources.tables import table

GAP_SQL = """d AS (SELECT DISTINCT event_type, value FROM events),
p AS (SELECT *, lag(value) OVER (PARTITION BY event_type ORDER BY value) AS pv FROM d),
l AS (SELECT event_type, value, sum(CASE WHEN pv IS NULL OR abs(value - pv) > 2.0 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY value) - 1 AS level FROM p),
e AS (SELECT events.event_type, events.value, l.level FROM events JOIN l USING (event_type, value))"""


@query("gap_levels", "WITH " + GAP_SQL + " SELECT event_type, level::BIGINT AS level, count(*) AS n, min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS mean FROM e GROUP BY 1, 2")
def _(spark, base):
    g = gap_levels(table(spark, base, "events").select("event_type", "value"), "value", 2.0, group=["event_type"])
    return g.groupBy("event_type", "level").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.round(F.avg("value"), 6).alias("mean"))


@query("effective_layers", "WITH " + GAP_SQL + """,
c AS (SELECT event_type, level, count(*) AS n FROM e GROUP BY 1, 2), m AS (SELECT event_type, greatest(2.0, 0.3 * median(n)) AS cut, count(*) AS total FROM c GROUP BY 1)
SELECT event_type, CASE WHEN any_value(total) < 2 THEN NULL WHEN count(*) FILTER (WHERE n >= cut) >= 2 THEN count(*) FILTER (WHERE n >= cut) ELSE any_value(total) END AS layers FROM c JOIN m USING (event_type) GROUP BY 1""")
def _(spark, base):
    g = gap_levels(table(spark, base, "events").select("event_type", "value"), "value", 2.0, group=["event_type"])
    c = g.groupBy("event_type", "level").agg(F.count(F.lit(1)).alias("n"))
    m = c.groupBy("event_type").agg(F.greatest(F.lit(2.0), 0.3 * F.median("n")).alias("cut"), F.count(F.lit(1)).alias("total"))
    k = F.count_if(F.col("n") >= F.col("cut"))
    t = F.max("total")
    return c.join(m, "event_type").groupBy("event_type").agg(F.when(t < 2, F.lit(None)).when(k >= 2, k).otherwise(t).alias("layers"))


@query("anchor_levels", """
WITH RECURSIVE a AS (SELECT user_id, max(value) AS v FROM events GROUP BY 1
  UNION ALL SELECT a.user_id, (SELECT max(value) FROM events e WHERE e.user_id = a.user_id AND -e.value > -a.v + (5.0 + 1e-9)) FROM a
  WHERE EXISTS (SELECT 1 FROM events e WHERE e.user_id = a.user_id AND -e.value > -a.v + (5.0 + 1e-9)))
SELECT user_id, level, count(*) AS n, max(value) AS top FROM (
  SELECT e.user_id, e.value, (SELECT count(*) FROM a WHERE a.user_id = e.user_id AND a.v >= e.value) - 1 AS level FROM events e) GROUP BY 1, 2""")
def _(spark, base):
    g = anchor_levels(table(spark, base, "events").select("user_id", "value"), "value", 5.0, group=["user_id"])
    return g.groupBy("user_id", "level").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))


@query("next_fit_packing", """
WITH RECURSIVE r AS (SELECT user_id, event_id, value::DECIMAL(28, 6) AS w, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
b AS (SELECT user_id, event_id, k, w AS acc, 0::BIGINT AS batch FROM r WHERE k = 1
  UNION ALL SELECT r.user_id, r.event_id, r.k, CASE WHEN b.acc + r.w > 200 THEN r.w ELSE b.acc + r.w END, b.batch + (b.acc + r.w > 200)::BIGINT
  FROM b JOIN r ON r.user_id = b.user_id AND r.k = b.k + 1)
SELECT event_id, user_id, batch FROM b""")
def _(spark, base):
    e = table(spark, base, "events").select("event_id", "user_id", "value")
    return next_fit_batches(e, "event_id", "value", 200.0, order=["event_id"], group=["user_id"]).select("event_id", "user_id", "batch")


@query("running_positions", """
SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) - 1 AS position,
  round(sum(o_totalprice::DECIMAL(18, 2)) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey)::DOUBLE, 2) AS running,
  lag(o_orderkey) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS previous FROM orders""")
def _(spark, base):
    """Position, running sum and previous row inside three large groups."""
    o = table(spark, base, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    s = ordered_scan(o, ["o_totalprice", "o_orderkey"], group=["o_orderstatus"], position="position",
                     sums={"running": F.col("o_totalprice").cast("decimal(18,2)")}, previous={"previous": "o_orderkey"})
    return s.select("o_orderkey", "position", F.round(F.col("running").cast("double"), 2).alias("running"), "previous")


@query("first_shell", """
WITH RECURSIVE d AS (SELECT l_suppkey AS g, l_extendedprice AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS k FROM lineitem),
s AS (SELECT g, k, [v] AS vs FROM d WHERE k = 1
  UNION ALL SELECT s.g, d.k, list_append(s.vs, d.v) FROM s JOIN d ON d.g = s.g AND d.k = s.k + 1 AND abs(d.v - list_aggregate(s.vs, 'median')) <= greatest(1e-3, 0.15 * list_aggregate(s.vs, 'median')))
SELECT g AS l_suppkey, max(k) AS n, round(max(list_max(vs)), 2) AS hi FROM s GROUP BY 1""")
def _(spark, base):
    s = first_shell(table(spark, base, "lineitem").select("l_suppkey", "l_extendedprice"), "l_extendedprice", 0.15, group=["l_suppkey"])
    return s.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("l_extendedprice"), 2).alias("hi"))


@query("cumulative_rounds", """
WITH r AS (SELECT user_id, event_id // 1000 AS round, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1, 2)
SELECT user_id, round, n, (sum(n) OVER w)::BIGINT AS n_total, min(first_id) OVER w AS lowest_id FROM r WINDOW w AS (PARTITION BY user_id ORDER BY round)""")
def _(spark, base):
    r = table(spark, base, "events").groupBy("user_id", F.floor(F.col("event_id") / 1000).alias("round")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    return r.select("user_id", "round", "n", F.sum("n").over(w).alias("n_total"), F.min("first_id").over(w).alias("lowest_id"))


@query("stable_rounds", """
WITH r AS (SELECT user_id, event_id // 1000 AS round, count(*) FILTER (event_type = 'error') <= 1 AS stable FROM events GROUP BY 1, 2),
i AS (SELECT *, sum((NOT stable)::INT) OVER (PARTITION BY user_id ORDER BY round) AS isl FROM r)
SELECT user_id, round, (sum(stable::INT) OVER (PARTITION BY user_id, isl ORDER BY round))::BIGINT AS stable_rounds FROM i""")
def _(spark, base):
    e = table(spark, base, "events")
    r = e.groupBy("user_id", F.floor(F.col("event_id") / 1000).alias("round")).agg(F.count_if(F.col("event_type") == "error").alias("k"))
    return stable_counter(r, F.col("k") <= 1, group=["user_id"]).select("user_id", "round", "stable_rounds")


@query("top_per_group", """
SELECT l_suppkey, l_orderkey, l_partkey, l_linenumber, l_extendedprice FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_linenumber) <= 20""")
def _(spark, base):
    l = table(spark, base, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")
    return head(l, 20, [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")], ["l_suppkey"])


@query("scored_catalogue_top", """
SELECT p_partkey, p_name, p_size + 2 * (p_type IN ('ECONOMY', 'PROMO'))::INT AS score FROM part
WHERE p_size BETWEEN 6 AND 28 ORDER BY score DESC, p_name, p_partkey LIMIT 30""")
def _(spark, base):
    """A catalogue's best 30 entries by score, then name."""
    s = F.col("p_size") + 2 * F.col("p_type").isin("ECONOMY", "PROMO").cast("int")
    p = table(spark, base, "part").where("p_size between 6 and 28").select("p_partkey", "p_name", s.alias("score"))
    return head(p, 30, [F.desc("score"), F.col("p_name"), F.col("p_partkey")])


@query("requested_names", """
WITH want AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS w FROM part WHERE p_size = 10)
SELECT count(*) FILTER (WHERE ok) AS n_known, count(*) FILTER (WHERE NOT ok) AS n_unknown FROM (SELECT w, w IN (SELECT DISTINCT split_part(p_name, ' ', 1) FROM part WHERE p_size > 25) AS ok FROM want)""")
def _(spark, base):
    p = table(spark, base, "part").select(F.split("p_name", " ")[0].alias("w"), "p_size")
    want, known = p.where("p_size = 10").select("w").distinct(), p.where("p_size > 25").select("w").distinct().withColumn("_k", F.lit(1))
    j = want.join(known, "w", "left")
    return j.agg(F.count("_k").alias("n_known"), F.count_if(F.col("_k").isNull()).alias("n_unknown"))


@query("plot_sample", "SELECT count(*) AS n FROM (SELECT event_id FROM events LIMIT 2000)")
def _(spark, base):
    """Seeded sample without replacement of the size a scatter plot shows."""
    s = table(spark, base, "events").select("event_id").orderBy(F.rand(7)).limit(2000)
    return s.agg(F.countDistinct("event_id").alias("n"))
