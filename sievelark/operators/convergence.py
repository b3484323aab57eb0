"""Stopping rules over selection rounds, as windows over the list of picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def occupancy_rounds(picks: DataFrame, bucket: Column, *, group: list[str]) -> DataFrame:
    """Per round: picks, running total, occupied bins and bins seen for the first time."""
    w = Window.partitionBy(*group, "_b").orderBy("pick")
    first = picks.where("round > 0").withColumn("_b", bucket).withColumn("_new", (F.row_number().over(w) == 1).cast("int"))
    per = first.groupBy(*group, "round").agg(F.count(F.lit(1)).alias("n_new_selected"), F.sum("_new").alias("n_new_bins"),
                                             F.countDistinct("_b").alias("n_round_bins"))
    run = Window.partitionBy(*group).orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumn("n_occupied_bins", F.sum("n_new_bins").over(run))


def stable_counter(rounds: DataFrame, stable: Column, *, group: list[str]) -> DataFrame:
    """Length of the current run of stable rounds (an unstable round resets it to zero)."""
    run = Window.partitionBy(*group).orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    isl = rounds.withColumn("_stable", stable.cast("int")).withColumn("_island", F.sum(1 - F.col("_stable")).over(run))
    w = Window.partitionBy(*group, "_island").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    return isl.withColumn("stable_rounds", F.sum("_stable").over(w)).drop("_stable", "_island")


def with_stop(rounds: DataFrame, *, min_rounds: int, patience: int, group: list[str]) -> DataFrame:
    """Mark the first round that meets the rule and drop the rounds after it."""
    hit = (F.col("round") >= min_rounds) & (F.col("stable_rounds") >= patience)
    w = Window.partitionBy(*group).orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max(hit.cast("int")).over(w), F.lit(0))
    return rounds.withColumn("stop", hit).withColumn("_past", before).where("_past = 0").drop("_past")


def site_occupancy(picks: DataFrame, bucket: Column, *, group: list[str], min_new_bins: int = 0, patience: int = 2,
                   min_rounds: int = 1) -> DataFrame:
    """Stop when at most ``min_new_bins`` new bins appear in ``patience`` consecutive rounds."""
    r = occupancy_rounds(picks, bucket, group=group)
    r = stable_counter(r, F.col("n_new_bins") <= min_new_bins, group=group)
    return with_stop(r, min_rounds=min_rounds, patience=patience, group=group)


def grid_occupancy(picks: DataFrame, pool: DataFrame, bins: Column, *, group: list[str], min_rounds: int = 5, patience: int = 3,
                   min_coverage_gain: float = 1e-3, min_novelty: float = 5e-2) -> DataFrame:
    """Stop when rounds stop covering new cells of a projected grid.

    ``pool`` holds every candidate with the same projection columns as ``picks``.
    """
    total = pool.withColumn("_b", bins).groupBy(*group).agg(F.countDistinct("_b").alias("n_pool_bins"))
    r = occupancy_rounds(picks, bins, group=group).join(total, group)
    w = Window.partitionBy(*group).orderBy("round")
    r = r.withColumn("coverage", F.col("n_occupied_bins") / F.greatest(F.lit(1), F.col("n_pool_bins")))
    r = r.withColumn("coverage_gain", F.col("coverage") - F.coalesce(F.lag("coverage").over(w), F.lit(0.0)))
    r = r.withColumn("novelty", F.col("n_new_bins") / F.greatest(F.lit(1), F.col("n_round_bins")))
    r = stable_counter(r, (F.col("coverage_gain") < min_coverage_gain) & (F.col("novelty") < min_novelty), group=group)
    return with_stop(r, min_rounds=min_rounds, patience=patience, group=group)


def cut_picks(picks: DataFrame, rounds: DataFrame, group: list[str]) -> DataFrame:
    """Keep the picks up to the round that stopped."""
    last = rounds.groupBy(*group).agg(F.max("round").alias("_last"))
    return picks.join(last, group).where(F.col("round") <= F.col("_last")).drop("_last")
