"""Text, hash, JSON and option helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelark.functions.exprs import fixed_decimals, format_float, norm_token, planar_bin, ratio_text, safe_name, short_sha1, tilt_bin
from sievelark.functions.options import flexible_budget, head_name, runtime_cap
from sievelark.plans.catalog.registry import query
from sievelark.sources.tables import table


@query("safe_names", r"SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_.\-]+', '_', 'g') AS name FROM pages")
def _(spark, base):
    return table(spark, base, "pages").select("page_id", safe_name("url").alias("name"))


@query("case_tokens", """
SELECT p_partkey, trim(split_part(t, '__', 1)) AS slab, trim(split_part(t, '__', 2)) AS ads, try_cast(split_part(p_brand, '#', 2) AS INTEGER) AS budget
FROM (SELECT p_partkey, p_brand, replace(p_name, ' ', '__') AS t FROM part)""")
def _(spark, base):
    t = F.split(F.regexp_replace("p_name", " ", "__"), "__", 2)
    return table(spark, base, "part").select("p_partkey", F.trim(t[0]).alias("slab"), F.trim(t[1]).alias("ads"),
                                             F.split("p_brand", "#")[1].try_cast("int").alias("budget"))


@query("float_text", "SELECT event_id, printf('%.8f', value) AS text8, printf('%.3f', value / 7.0) AS text3 FROM events")
def _(spark, base):
    return table(spark, base, "events").select("event_id", format_float("value").alias("text8"), fixed_decimals(F.col("value") / 7.0, 3).alias("text3"))


@query("ratio_text", """
SELECT c_mktsegment, count(*) FILTER (WHERE c_acctbal > 0) || '/' || count(*) || ' (' || printf('%.1f', round(100.0 * count(*) FILTER (WHERE c_acctbal > 0) / count(*), 1)) || '%)' AS share FROM customer GROUP BY 1""")
def _(spark, base):
    return table(spark, base, "customer").groupBy("c_mktsegment").agg(ratio_text(F.count_if(F.col("c_acctbal") > 0), F.count(F.lit(1))).alias("share"))


@query("alias_tokens", "SELECT lower(trim(p_type)) AS token, CASE WHEN lower(trim(p_type)) IN ('economy', 'small') THEN 'basic' ELSE lower(trim(p_type)) END AS canonical, count(*) AS n FROM part GROUP BY 1, 2")
def _(spark, base):
    t = norm_token("p_type")
    return table(spark, base, "part").groupBy(t.alias("token"), F.when(t.isin("economy", "small"), "basic").otherwise(t).alias("canonical")).agg(F.count(F.lit(1)).alias("n"))


@query("head_names", "SELECT doc_id, CASE WHEN contains(lower(text), 'omat') THEN 'omat_pbe' WHEN contains(lower(text), 'omol') THEN 'omol' END AS head FROM documents")
def _(spark, base):
    """Model head by substring, read from whole texts."""
    return table(spark, base, "documents").select("doc_id", head_name("text").alias("head"))


@query("source_resolution", """
SELECT conv_id, CASE WHEN count(DISTINCT role) = 0 THEN '' WHEN count(DISTINCT role) = 1 THEN min(role) ELSE 'mixed' END AS source FROM conversations GROUP BY 1""")
def _(spark, base):
    n = F.countDistinct("role")
    return table(spark, base, "conversations").groupBy("conv_id").agg(F.when(n == 0, "").when(n == 1, F.min("role")).otherwise("mixed").alias("source"))


@query("json_metadata", """
SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS INTEGER), -1) AS k, coalesce(CAST(json_extract(props, '$.missing') AS INTEGER), 0) AS missing,
  coalesce(json_extract_string(props, '$.label'), event_type) AS label FROM events""")
def _(spark, base):
    v = F.parse_json("props")
    return table(spark, base, "events").select(
        "event_id", F.coalesce(F.variant_get(v, "$.k", "int"), F.lit(-1)).alias("k"), F.coalesce(F.variant_get(v, "$.missing", "int"), F.lit(0)).alias("missing"),
        F.coalesce(F.variant_get(v, "$.label", "string"), F.col("event_type")).alias("label"))


@query("nested_update", "SELECT event_id, value * 2 AS threshold, user_id AS seed FROM events")
def _(spark, base):
    """Replace one field of a nested option record by its dotted path."""
    s = F.struct(F.struct(F.col("value").alias("threshold"), F.col("user_id").alias("seed")).alias("selection"))
    d = table(spark, base, "events").select("event_id", s.alias("cfg"))
    d = d.withColumn("cfg", F.col("cfg").withField("selection.threshold", F.col("cfg.selection.threshold") * 2))
    return d.select("event_id", F.col("cfg.selection.threshold").alias("threshold"), F.col("cfg.selection.seed").alias("seed"))


@query("record_json", """
SELECT p_partkey, '{"site_id":"site_' || lpad(p_partkey::VARCHAR, 9, '0') || '","kind":"' || p_type || '","connectivity":' || (p_size % 4 + 1) || ',"topology":"' || coalesce(nullif(p_name, ''), p_type) || '"}' AS record FROM part""")
def _(spark, base):
    r = F.struct(F.concat(F.lit("site_"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("site_id"), F.col("p_type").alias("kind"),
                 (F.col("p_size") % 4 + 1).alias("connectivity"), F.coalesce(F.nullif("p_name", F.lit("")), F.col("p_type")).alias("topology"))
    return table(spark, base, "part").select("p_partkey", F.to_json(r).alias("record"))


@query("text_hashes", "SELECT doc_id, substr(sha1(text), 1, 16) AS h16, substr(sha1(text || '|' || lang), 1, 20) AS h20 FROM documents")
def _(spark, base):
    return table(spark, base, "documents").select("doc_id", short_sha1(F.col("text")).alias("h16"), short_sha1(F.concat_ws("|", "text", "lang"), 20).alias("h20"))


@query("orientation_bins", """
SELECT CASE WHEN value < 10 THEN 'upright' WHEN value < 60 THEN 'tilted' ELSE 'flat' END AS tilt, CASE WHEN value < 20 THEN 'flat' WHEN value < 70 THEN 'tilted' ELSE 'upright' END AS planar, count(*) AS n FROM events GROUP BY 1, 2""")
def _(spark, base):
    return table(spark, base, "events").groupBy(tilt_bin("value").alias("tilt"), planar_bin("value").alias("planar")).agg(F.count(F.lit(1)).alias("n"))


@query("flexible_budget", """
WITH a AS (SELECT l_orderkey, count(*) AS n_heavy, count(*) FILTER (WHERE l_discount >= 0.06) AS rot, count(*) FILTER (WHERE l_tax >= 0.07) AS ring, count(*) FILTER (WHERE l_returnflag = 'A') AS het, (max(l_quantity) - min(l_quantity)) / 5.0 AS span FROM lineitem GROUP BY 1),
s AS (SELECT *, (0.35 * rot::DOUBLE + 0.80 * ring::DOUBLE + 0.18 * greatest(0, n_heavy - 4)::DOUBLE + 0.22 * het::DOUBLE + 0.25 * greatest(0.0, span - 3.0)::DOUBLE)::DOUBLE AS score FROM a),
r AS (SELECT *, (n_heavy >= 7 AND score >= 2.0) OR score >= 3.2 OR rot >= 2 AS run FROM s)
SELECT l_orderkey, round(score, 6) AS score, run, CASE WHEN run THEN round(least(40.0, greatest(8.0, 8.0 + 2.2 * score)), 6) ELSE 0.0 END AS time_ps,
 CASE WHEN run THEN least(6, greatest(2, round_even(2 + score / 2.2, 0)))::INTEGER ELSE 0 END AS runs, CASE WHEN run THEN least(256, greatest(64, round_even(64 + 18 * score, 0)))::INTEGER ELSE 0 END AS preselect_k,
 CASE WHEN NOT run THEN 0 WHEN score >= 5.0 THEN 12 ELSE 8 END AS target_final_k, CASE WHEN run THEN least(16, greatest(4, round_even(4 + score / 1.4, 0)))::INTEGER ELSE 0 END AS fps_rounds,
 CASE WHEN run THEN least(48, greatest(12, round_even(12 + 4 * score, 0)))::INTEGER ELSE 0 END AS fps_round_size FROM r""")
def _(spark, base):
    a = table(spark, base, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_heavy"), F.count_if(F.col("l_discount") >= 0.06).alias("rotatable"), F.count_if(F.col("l_tax") >= 0.07).alias("rings"),
        F.count_if(F.col("l_returnflag") == "A").alias("hetero"), ((F.max("l_quantity") - F.min("l_quantity")) / 5.0).alias("span"))
    b = flexible_budget(a)
    return b.select("l_orderkey", F.round("score", 6).alias("score"), "run", F.round("time_ps", 6).alias("time_ps"), "runs", "preselect_k", "target_final_k", "fps_rounds", "fps_round_size")


@query("capped_budget", """
SELECT p_partkey, least(p_size / 2.0, 8.0)::DOUBLE AS time_ps, least(p_size % 7, 2) AS runs, least(p_size * 4, 48) AS preselect_k, least(p_size, 4) AS target_final_k,
  least(p_size % 16, 4) AS fps_rounds, least(p_size, 16) AS fps_round_size FROM part""")
def _(spark, base):
    p = table(spark, base, "part").select("p_partkey", (F.col("p_size") / 2.0).alias("time_ps"), (F.col("p_size") % 7).alias("runs"), (F.col("p_size") * 4).alias("preselect_k"),
                                          F.col("p_size").alias("target_final_k"), (F.col("p_size") % 16).alias("fps_rounds"), F.col("p_size").alias("fps_round_size"))
    return runtime_cap(p)


@query("explicit_or_derived_set", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN (o_custkey % 5) || ',' || (o_custkey % 7) ELSE NULL END AS given, array_to_string(list_sort(list_distinct(CASE WHEN o_orderstatus = 'F' THEN [o_custkey % 5, o_custkey % 7] ELSE [o_orderkey % 3, o_orderkey % 4, o_orderkey % 3] END)), ',') AS indices FROM orders""")
def _(spark, base):
    e = F.when(F.col("o_orderstatus") == "F", F.array(F.col("o_custkey") % 5, F.col("o_custkey") % 7))
    d = F.array(F.col("o_orderkey") % 3, F.col("o_orderkey") % 4, F.col("o_orderkey") % 3)
    pick = F.when(F.size(F.coalesce(e, F.array().cast("array<bigint>"))) > 0, e).otherwise(d)
    return table(spark, base, "orders").select(
        "o_orderkey", F.array_join(e.cast("array<string>"), ",").alias("given"), F.array_join(F.array_sort(F.array_distinct(pick)).cast("array<string>"), ",").alias("indices"))
