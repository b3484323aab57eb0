"""Connected components of an edge table."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sievelark.session import settle

EDGES_PER_GROUP = 200_000


def _union(pdf: pd.DataFrame) -> pd.DataFrame:
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for u, v in zip(pdf["src"].tolist(), pdf["dst"].tolist()):
        a, b = root(u), root(v)
        if a != b:
            parent[max(a, b)] = min(a, b)
    ids = list(parent)
    return pd.DataFrame({"id": ids, "component": [root(v) for v in ids]}, dtype="int64")


def _stars(edges: DataFrame) -> DataFrame:
    """Alternate large-star and small-star steps until every edge points at its root."""
    def fingerprint(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())

    edges = settle(edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
                   .where("src <> dst").distinct())
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        large = both.join(low, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        large = large.where("src <> dst").distinct()
        down = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = (large.join(down, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
                 .unionByName(down.select("src", F.col("m").alias("dst")))
                 .where("src <> dst")
                 .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
        edges = settle(small)
        now = fingerprint(edges)
        if now == last:
            break
        last = now
    roots = edges.select(F.col("src").alias("id"), F.col("dst").alias("component"))
    return roots.unionByName(edges.select(F.col("dst").alias("id"), F.col("dst").alias("component")).distinct())


def components(edges: DataFrame, group: str | None = None, bound: int = EDGES_PER_GROUP) -> DataFrame:
    """``id, component`` (lowest id of the component) for every vertex on an edge ``src, dst``.

    Edges of one group never touch another group. Groups with few edges are solved many to
    a task; larger ones by star contraction over the whole cluster.
    """
    if group is None:
        return _stars(edges.select("src", "dst"))
    edges = settle(edges.select(F.col(group).alias("_g"), "src", "dst"))
    sizes = settle(edges.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")))
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    big = settle(sizes.where(F.col("_n") > bound).select("_g"))
    tasks = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * -(-total // EDGES_PER_GROUP))
    solve = lambda e: e.groupBy(F.pmod(F.xxhash64("_g"), F.lit(tasks)).alias("_k")).applyInPandas(_union, "id long, component long")
    if big.isEmpty():
        return solve(edges)
    return solve(edges.join(big, "_g", "left_anti")).unionByName(_stars(edges.join(big, "_g", "left_semi").select("src", "dst")))


def with_components(vertices: DataFrame, id: str, edges: DataFrame, group: str | None = None, **kw) -> DataFrame:
    """Vertices with their component; isolated ones are their own component."""
    comp = components(edges, group, **kw).withColumnRenamed("id", id)
    return vertices.join(comp, id, "left").withColumn("component", F.coalesce("component", F.col(id)))
