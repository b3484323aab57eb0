"""Grouped statistics, audits and scores over case and candidate tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from sievelark.functions.exprs import col


def group_stats(df: DataFrame, group: list[str], value: str, *, distinct: list[str] | None = None) -> DataFrame:
    """Count, value range and sorted distinct labels per group.

    Meant for label columns with few values; member ids stay in their own rows.
    """
    aggs = [F.count(F.lit(1)).alias("n"), F.min(value).alias("value_min"), F.max(value).alias("value_max"),
            (F.max(value) - F.min(value)).alias("value_span")]
    aggs += [F.array_sort(F.collect_set(c)).alias(f"{c}_set") for c in distinct or []]
    return df.groupBy(*group).agg(*aggs)


def count_map(df: DataFrame, group: list[str], key: str, name: str = "counts") -> DataFrame:
    """Counts by key as one sorted text per group: counting first keeps the lists short."""
    c = df.groupBy(*group, key).agg(F.count(F.lit(1)).alias("_n"))
    e = F.array_sort(F.collect_list(F.concat_ws(":", F.col(key).cast("string"), F.col("_n").cast("string"))))
    return c.groupBy(*group).agg(F.array_join(e, ",").alias(name))


def member_spread(members: DataFrame, group: list[str], order: list[str], distance) -> DataFrame:
    """Min, max and mean distance of members to the first member of their group.

    ``distance(first, own)`` builds the expression from two structs of the row's columns;
    a single member gives NULLs, no comparable member gives zeros.
    """
    cols = members.columns
    first = members.groupBy(*group).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_first"), F.count(F.lit(1)).alias("n_members"))
    j = members.withColumn("_own", F.struct(*cols)).join(first, group)
    other = reduce(lambda a, b: a | b, [F.col(f"_own.{o}") != F.col(f"_first.{o}") for o in order])
    j = j.withColumn("_d", F.when(other, distance(F.col("_first"), F.col("_own"))))
    stat = lambda f: F.when(F.max("n_members") > 1, F.coalesce(f("_d"), F.lit(0.0)))
    return j.groupBy(*group).agg(F.max("n_members").alias("n_members"), stat(F.min).alias("rmsd_min"), stat(F.max).alias("rmsd_max"),
                                 stat(F.avg).alias("rmsd_mean"))


def inflation_audit(rows: DataFrame, case: list[str], observed: str, legacy: str, geometry: str) -> DataFrame:
    """Distinct identities under three modes and geometry groups that split into several observed ids."""
    per = rows.groupBy(*case, geometry).agg(F.countDistinct(observed).alias("_o"), F.count(F.lit(1)).alias("_n"))
    split = per.groupBy(*case).agg(F.count_if(F.col("_o") > 1).alias("split_groups"),
                                   F.coalesce(F.sum(F.when(F.col("_o") > 1, F.col("_n"))), F.lit(0)).alias("split_rows"))
    n = rows.groupBy(*case).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(observed).alias("n_observed"),
                                F.countDistinct(legacy).alias("n_legacy"), F.countDistinct(geometry).alias("n_geometry"))
    j = n.join(split, case)
    return j.withColumn("inflation_observed", F.col("n_observed") - F.col("n_geometry")).withColumn(
        "inflation_legacy", F.col("n_legacy") - F.col("n_geometry"))


def merge_audit(rows: DataFrame, case: list[str], merged: str, observed: str, geometry: str) -> DataFrame:
    """Per case: how merged groups relate to observed and geometry identities."""
    per = rows.groupBy(*case, merged).agg(F.countDistinct(observed).alias("_o"), F.countDistinct(geometry).alias("_g"))
    a = per.groupBy(*case).agg(F.count(F.lit(1)).alias("n_merged"),
                               F.count_if((F.col("_g") == 1) & (F.col("_o") > 1)).alias("redundant_resolved"),
                               F.count_if(F.col("_g") > 1).alias("cross_merges"))
    g = rows.groupBy(*case).agg(F.countDistinct(geometry).alias("n_geometry"))
    return a.join(g, case).withColumn("delta", F.col("n_merged") - F.col("n_geometry"))


def best_and_worst(df: DataFrame, group: list[str], name: str, value: str, order: str) -> DataFrame:
    """Names with the lowest and highest value per group; ties go to the lowest order."""
    v = col(value)
    return df.groupBy(*group).agg(
        F.min_by(name, F.struct(v, F.col(order))).alias("lowest"), F.min(value).alias("lowest_value"),
        F.min_by(name, F.struct(-v, F.col(order))).alias("highest"), F.max(value).alias("highest_value"),
        (F.max(value) - F.min(value)).alias("delta"))


def stage_funnel(df: DataFrame, stages: dict[str, Column], group: list[str], value: str) -> DataFrame:
    """Long table ``stage, n, retention, removed`` and value statistics over successive filters."""
    keep = F.lit(True)
    rows = []
    for i, (name, cond) in enumerate(stages.items()):
        keep = keep & cond
        rows.append(F.struct(F.lit(i).alias("stage_no"), F.lit(name).alias("stage"), F.coalesce(keep, F.lit(False)).alias("_k")))
    e = df.select(*group, value, F.explode(F.array(*rows)).alias("s")).where("s._k")
    a = e.groupBy(*group, F.col("s.stage_no").alias("stage_no"), F.col("s.stage").alias("stage")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("value_mean"), F.stddev_pop(value).alias("value_std"))
    w = Window.partitionBy(*group).orderBy("stage_no")
    prev = F.coalesce(F.lag("n").over(w), F.col("n"))
    return a.withColumn("removed", prev - F.col("n")).withColumn("retention", F.col("n") / prev)


def yield_ratio(n_out: Column, n_in: Column) -> Column:
    """1 at a yield of 0.65, falling linearly to 0 at 0 and 1.3."""
    return F.greatest(F.lit(0.0), 1.0 - F.abs(n_out / F.greatest(F.lit(1), n_in) - 0.65) / 0.65)


def time_score(sec: Column, target: float = 180.0) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - sec / target)


def agreement_score(a: Column, b: Column, n: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - 5.0 * F.abs(a - b) / F.greatest(F.lit(1), n))


def strategy_score(n_in: Column, n_out: Column, sec: Column) -> Column:
    some = F.when(n_out > 0, 1.0).otherwise(0.0)
    return F.when(n_in <= 0, F.lit(0.0)).otherwise(100.0 * (0.60 * some + 0.30 * yield_ratio(n_out, n_in) + 0.10 * time_score(sec)))


def case_score(n_a: Column, n_b: Column, n_in: Column, ready: Column, sec: Column) -> Column:
    some = F.when(n_a > 0, 1.0).otherwise(0.0)
    return (0.30 * some + 0.35 * yield_ratio(n_a, n_in) + 0.25 * agreement_score(n_a, n_b, n_in) + 0.05 * ready + 0.05 * time_score(sec))


def checks_passed(checks: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(False)).cast("int") for c in checks])


def case_status(n_sites: Column, source: Column, n_ref: Column, n_ours: Column, recall: Column) -> Column:
    """Status of a validation case from reference and own counts."""
    return (F.when((n_sites <= 0) & (F.coalesce(source, F.lit("")) == ""), "manual_reference_missing")
            .when((n_ref == 0) & (n_ours == 0), "both_zero").when((n_ref == 0) & (n_ours > 0), "manual_zero_ours_positive")
            .when((n_ref > 0) & (n_ours == 0), "manual_positive_ours_zero")
            .when(F.abs(recall - 1.0) <= 1e-12, "full_recall").otherwise("partial_recall"))


def upgraded_status(status: Column, diagnosis: Column) -> Column:
    """``both_zero`` becomes ``robust_null_zone`` where the diagnosis confirms it."""
    return F.when((status == "both_zero") & F.coalesce(diagnosis, F.lit(False)), F.lit("robust_null_zone")).otherwise(status)


def extra_reason(outside_anchor: Column, unseen_site: Column) -> Column:
    return (F.when(outside_anchor, "binding_atom_outside_manual_anchor_set")
            .when(unseen_site, "site_label_outside_manual_reference").otherwise("same_anchor_same_site_unmatched"))


def placement_status(n_primitives: Column, n_poses: Column, min_dist: Column, limit: float) -> Column:
    return (F.when(n_primitives <= 0, "zero_primitive").when(n_poses <= 0, "zero_pose")
            .when(min_dist < limit, "soft_clash").otherwise("ok"))


def set_compare(a: DataFrame, b: DataFrame, kind: list[str], item: str) -> DataFrame:
    """Per kind: sizes of both sets, of their intersection and of both differences."""
    x = a.select(*kind, item).distinct().withColumn("_a", F.lit(1))
    y = b.select(*kind, item).distinct().withColumn("_b", F.lit(1))
    j = x.join(y, [*kind, item], "full_outer")
    return j.groupBy(*kind).agg(F.count("_a").alias("n_a"), F.count("_b").alias("n_b"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_both"),
                                F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"))


def multiset_equal(a: DataFrame, b: DataFrame, key: list[str], item: str) -> DataFrame:
    """Per key of both tables: whether the multisets of items agree. Counts are compared, no list is built."""
    x = a.groupBy(*key, item).agg(F.count(F.lit(1)).alias("_na"))
    y = b.groupBy(*key, item).agg(F.count(F.lit(1)).alias("_nb"))
    j = x.join(y, [*key, item], "full_outer").fillna(0, ["_na", "_nb"])
    return j.groupBy(*key).agg((F.sum("_na") > 0).alias("in_a"), (F.sum("_nb") > 0).alias("in_b"),
                               F.bool_and(F.col("_na") == F.col("_nb")).alias("equal")).where("in_a and in_b").select(*key, "equal")


def formula(counts: DataFrame, group: list[str], symbol: str, n: str, name: str = "formula") -> DataFrame:
    """Sorted element symbols with their counts (1 is left out)."""
    t = F.concat(F.col(symbol), F.when(F.col(n) > 1, F.col(n).cast("string")).otherwise(F.lit("")))
    return counts.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(symbol).alias("s"), t.alias("t")))), lambda v: v["t"]), "").alias(name))


def mean_pool(df: DataFrame, group: list[str], feat: str) -> DataFrame:
    """Element-wise mean of feature arrays per group: ``group, position, value``."""
    e = df.select(*group, F.posexplode(feat).alias("position", "_v"))
    return e.groupBy(*group, "position").agg(F.avg("_v").alias("value"))
