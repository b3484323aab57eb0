"""Second-shell edges of row-like surfaces, whose nearest neighbours only form rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sievelark.operators.scan import ordered_scan
from sievelark.operators.structure import WIDEST, _contacts
from sievelark.session import settle


def row_like_edges(atoms: DataFrame, surface: DataFrame, edges: DataFrame, *, degree: float = 2.5, ratio: float = 1.5, tolerance: float = 0.08,
                   scale: float = 1.2, lattice: DataFrame | None = None) -> DataFrame:
    """``edges`` (``frame, src, dst, d``) with ``shell`` 1, and the second shell (``shell`` 2) of row-like frames.

    A frame is row-like when it has four surface atoms or more and at most ``degree`` edge ends per
    atom. Other pairs up to ``ratio`` times the median edge are walked by distance: the shell goes on
    while the next distance is within ``tolerance`` of the median of the shell so far, and is added
    when it has at least two pairs and a quarter as many as there are atoms. The median of a sorted
    run is the mean of its middle members, so every step is judged by position, in parallel.
    ``scale`` is the one the edges were found with.
    """
    n = surface.select("frame", "atom").distinct().groupBy("frame").agg(F.count(F.lit(1)).alias("_size"))
    e = settle(edges.select("frame", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "d"))
    per = e.where("d > 1e-8").groupBy("frame").agg(F.percentile("d", 0.5).alias("_first"))
    many = e.groupBy("frame").agg((2.0 * F.count(F.lit(1))).alias("_ends"))
    info = n.join(per, "frame").join(many, "frame").where((F.col("_size") >= 4) & (F.col("_ends") / F.col("_size") <= degree)).select("frame", "_size", "_first")
    s = atoms.join(surface.select("frame", "atom"), ["frame", "atom"], "left_semi").select("frame", "atom", "px", "py", "pz").join(info, "frame")
    far = F.col("a__first") * ratio
    p = _contacts(s, s.drop("_size", "_first"), far, max_cutoff=ratio * scale * WIDEST, extra=F.col("a_atom") < F.col("b_atom"), lattice=lattice)
    p = p.where(F.col("d") > F.col("a__first") * (1.0 + 1e-3)).select("frame", F.col("a_atom").alias("src"), F.col("b_atom").alias("dst"), "d", F.col("a__size").alias("_size"))
    p = p.join(e.select("frame", "src", "dst"), ["frame", "src", "dst"], "left_anti")
    walk = settle(ordered_scan(p, ["d", "src", "dst"], group=["frame"], position="_k"))
    # row k continues the shell of the k rows before it; their median lies at these two places
    low, high = F.floor((F.col("_k") - 1) / 2).cast("long"), F.floor(F.col("_k") / 2).cast("long")
    at = lambda name: walk.select("frame", F.col("_k").alias(f"_{name}"), F.col("d").alias(f"_d{name}"))
    judged = walk.where("_k > 0").withColumn("_a", low).withColumn("_b", high).join(at("a"), ["frame", "_a"]).join(at("b"), ["frame", "_b"])
    median = (F.col("_da") + F.col("_db")) / 2.0
    breaks = judged.where(F.abs(F.col("d") - median) > F.greatest(F.lit(1e-3), tolerance * median)).groupBy("frame").agg(F.min("_k").alias("_end"))
    shell = walk.join(breaks, "frame", "left").where(F.col("_end").isNull() | (F.col("_k") < F.col("_end")))
    enough = shell.groupBy("frame", "_size").agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") >= F.greatest(F.lit(2), F.floor(F.col("_size") / 4))).select("frame")
    second = shell.join(enough, "frame", "left_semi").select("frame", "src", "dst", "d", F.lit(2).alias("shell"))
    return e.withColumn("shell", F.lit(1)).unionByName(second)
