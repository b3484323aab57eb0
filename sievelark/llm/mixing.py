"""Mixing sources to target weights by capped water-filling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sievelark.llm.common import WORD, documents, store
from sievelark.llm.registry import query
from sievelark.operators.scan import ordered_scan

SEED = "mix-1"
#: Fractions are cut by LEVELS rounds of 256 hash buckets each.
LEVELS = 3
#: Up to so many sources, their targets are broadcast.
FEW_SOURCES = 50_000


def targets(sizes: DataFrame, max_epochs: int = 3) -> DataFrame:
    """Add ``target`` to rows ``source, source_size, weight``: shares of all sizes by weight, clamped at the cap.

    A source above ``max_epochs`` times its size is clamped there and its excess goes to the
    others by weight, until no source is above. Every round is one aggregation over the
    sources. A source of size 0 gets 0; an empty table gives an empty table.
    """
    d = sizes.withColumn("_cap", F.col("source_size") * F.lit(max_epochs))
    total = d.agg(F.sum("source_size")).first()[0] or 0
    level, seen = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("_cap") < F.col("weight") * F.lit(level)
        clamped, at_cap, weight = d.agg(F.sum(F.when(full, 1).otherwise(0)), F.sum(F.when(full, F.col("_cap")).otherwise(0)),
                                        F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        if clamped is None or clamped == seen or not weight:
            break
        level, seen = (total - at_cap) / weight, clamped
    level = 0.0 if level is None else level
    return d.withColumn("target", F.least(F.col("_cap").cast("double"), F.col("weight") * F.lit(float(level)))).drop("_cap")


def bucket(key: Column, level: int, seed: str = SEED) -> Column:
    """Byte ``level`` of the seeded hash of a key; a null key counts as the empty text."""
    h = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(h, 2 * level + 1, 2), 16, 10).cast("int")


def mix(docs: DataFrame, *, id: str, size: str, source: str, weights: DataFrame, max_epochs: int = 3, seed: str = SEED) -> DataFrame:
    """Rows ``id, size, source, source_size, target, taken``: how many units of each row the mix takes.

    ``weights`` has ``source, weight`` for every source (null is a source of its own). A
    source with target t and size s takes every row floor(t / s) times, and once more the
    rows with the smallest seeded hashes until t is reached as nearly as whole rows allow.
    The cut is found by ``LEVELS`` rounds of 256 buckets per source, so no task ever sorts a
    source. Rows with equal ids share their hash and are taken together. Null sizes count 0.
    """
    d = docs.select(F.col(id).alias("_id"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_size"), F.col(source).alias("_src"),
                    *[bucket(F.col(id), k, seed).alias(f"_b{k}") for k in range(LEVELS)])
    d = store(d, "mix")
    sums = d.groupBy(F.col("_src").alias("source")).agg(F.sum("_size").alias("source_size"))
    w = weights.select(F.col("source").alias("_ws"), F.col("weight"))
    sums = store(sums.join(w, F.col("source").eqNullSafe(F.col("_ws")), "left").select("source", "source_size", F.coalesce("weight", F.lit(0)).alias("weight")), "mix-sources")
    goal = targets(sums, max_epochs)
    reps = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = goal.withColumn("_whole", F.floor(reps).cast("long")).withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    cut = goal.select(F.col("source").alias("_cs"), F.col("_rest"))
    edge = cut
    for k in range(LEVELS):
        held = [f"_b{j}" for j in range(k)]
        at = edge.select(F.col("_cs"), F.col("_rest"), *[F.col(f"_c{j}") for j in range(k)])
        on = F.col("_src").eqNullSafe(F.col("_cs"))
        for j in range(k):
            on = on & (F.col(f"_b{j}") == F.col(f"_c{j}"))
        per = d.groupBy("_src", *held, f"_b{k}").agg(F.sum("_size").alias("_n"))
        per = per.join(at, on).select("_cs", "_rest", *[f"_c{j}" for j in range(k)], F.col(f"_b{k}").alias(f"_c{k}"), "_n")
        run = Window.partitionBy("_cs").orderBy(f"_c{k}").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        per = per.withColumn("_to", F.sum("_n").over(run))
        # the bucket in which the wanted size is reached; without one, all rows are taken
        edge = (per.where(F.col("_to") > F.col("_rest")).groupBy("_cs", *[f"_c{j}" for j in range(k)])
                .agg(F.min_by(F.struct(f"_c{k}", F.col("_rest") - (F.col("_to") - F.col("_n")), F.col("_n")), f"_c{k}").alias("_e"))
                .select("_cs", *[f"_c{j}" for j in range(k)], F.col(f"_e._c{k}").alias(f"_c{k}"), F.col("_e.col2").alias("_rest"), F.col("_e._n").alias("_n")))
    last = F.when(F.col("_rest") * 2 >= F.col("_n"), 1).otherwise(0)
    code = lambda p: sum((F.col(f"{p}{k}") * F.lit(256 ** (LEVELS - 1 - k)) for k in range(1, LEVELS)), F.col(f"{p}0") * F.lit(256 ** (LEVELS - 1)))
    edge = edge.select(F.col("_cs").alias("_es"), (code("_c") + last).alias("_below"))
    goal = goal.join(edge, F.col("source").eqNullSafe(F.col("_es")), "left").drop("_es")
    if sums.count() <= FEW_SOURCES:  # else the join shuffles, and Spark splits a hot source
        goal = F.broadcast(goal)
    out = d.join(goal, F.col("_src").eqNullSafe(F.col("source")), "left")
    extra = F.when(F.col("_rest") <= 0, 0).when(F.col("_below").isNull() | (code("_b") < F.col("_below")), 1).otherwise(0)
    return out.select(F.col("_id").alias(id), F.col("_size").alias("size"), F.col("_src").alias("source"), F.col("source_size"), F.col("target"),
                      (F.col("_size") * F.least(F.col("_whole") + extra, F.lit(max_epochs))).cast("long").alias("taken"))


def ranked_weights(docs: DataFrame, source: str, cycle: int = 3) -> DataFrame:
    """Weights 1 .. ``cycle``, repeating, over the distinct sources by code point with null last."""
    names = docs.select(F.col(source).alias("source")).distinct()
    ranked = ordered_scan(names, [F.col("source").isNull(), F.col("source")], position="_at")
    return ranked.select("source", (F.col("_at") % cycle + 1).cast("long").alias("weight"))


SQL_MIX = f"""
WITH d AS (
  SELECT doc_id, source, text, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END AS BIGINT) AS size,
         CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, {2 * LEVELS}) AS BIGINT) AS h
  FROM {{docs}}),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM d GROUP BY source),
r AS (SELECT *, 3 * source_size AS cap, sum(source_size) OVER ()::BIGINT AS total,
        coalesce(sum(3 * source_size) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cap_before,
        sum(weight) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS weight_left FROM s),
l AS (SELECT min_by((total - cap_before)::DOUBLE / weight_left, cap::DOUBLE / weight) FILTER (WHERE (total - cap_before)::DOUBLE / weight_left * weight <= cap) AS level FROM r),
g AS (SELECT source, source_size, least(cap::DOUBLE, weight * level) AS target FROM r, l),
t AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM g),
b AS (SELECT source, h, sum(size)::BIGINT AS n FROM d GROUP BY source, h),
c AS (SELECT b.source, b.h, b.n, t.target - t.whole * t.source_size AS rest,
        (sum(b.n) OVER (PARTITION BY b.source ORDER BY b.h) - b.n)::BIGINT AS before FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source),
e AS (SELECT source, h, CASE WHEN rest <= 0 THEN 0 WHEN before + n <= rest THEN 1 WHEN before <= rest AND (rest - before) * 2 >= n THEN 1 ELSE 0 END AS extra FROM c)
"""


@query("op8_mix_sources", SQL_MIX.format(docs="documents") + """
SELECT d.doc_id, d.size, t.source_size, t.target, (d.size * least(t.whole + e.extra, 3))::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN e ON d.source IS NOT DISTINCT FROM e.source AND d.h = e.h""")
def _(spark, base):
    return mixed_documents(documents(spark, base)).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, max_epochs: int = 3, seed: str = SEED) -> DataFrame:
    """All documents mixed by words, weights 1, 2, 3 over the sources by code point; columns of :func:`mix`."""
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    return mix(sized, id="doc_id", size="size", source="source", weights=ranked_weights(docs, "source"), max_epochs=max_epochs, seed=seed)
