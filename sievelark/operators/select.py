"""Windows, diversity filters and stage selection over candidate rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from sievelark.functions.exprs import col, nan_last, within
from sievelark.operators import cluster as C
from sievelark.operators.convergence import cut_picks, grid_occupancy, site_occupancy
from sievelark.operators.fps import farthest_points, in_rounds
from sievelark.operators.greedy import diversity_ids
from sievelark.operators.scan import ordered_scan
from sievelark.operators.stats import grid_bins, pca_fit, project
from sievelark.operators.tiles import k_nearest, prepared


def attach(df: DataFrame, summary: DataFrame, group: list[str]) -> DataFrame:
    """Add per-group values to rows; without a group the single summary row becomes literals
    through a scalar subquery."""
    if group:
        return df.join(summary, group, "left")
    one = summary.select(F.struct(*summary.columns).alias("s")).scalar()
    return df.select("*", *[one[c].alias(c) for c in summary.columns])


def group_min(df: DataFrame, value: str | Column, group: list[str], name: str, *, nan_poisons: bool) -> DataFrame:
    v = col(value).cast("double")
    low = F.min(F.when(~F.isnan(v), v))
    if nan_poisons:
        low = F.when(F.coalesce(F.bool_or(F.isnan(v)), F.lit(False)), F.lit(None)).otherwise(low)
    return df.groupBy(*group).agg(low.alias(name))


def energy_window(df: DataFrame, energy: str, delta: float | None, *, group: list[str] | None = None) -> DataFrame:
    """Rows with ``energy <= min + delta``; one undefined energy empties its group.

    ``delta`` None or infinite passes everything through.
    """
    if delta is None or delta == float("inf"):
        return df
    low = group_min(df, energy, group or [], "_lo", nan_poisons=True)
    return attach(df, low, group or []).where(within(F.col(energy).cast("double"), F.col("_lo") + delta)).drop("_lo")


def basin_window(df: DataFrame, energy: str, delta: float, *, group: list[str] | None = None) -> DataFrame:
    """Flag instead of filter: ``reason`` is ``energy_window`` beyond the window, NULL otherwise.

    Undefined energies are kept and do not disturb the minimum.
    """
    low = group_min(df, energy, group or [], "energy_min", nan_poisons=False)
    e = F.col(energy).cast("double")
    d = attach(df, low, group or []).withColumn("delta_e", e - F.col("energy_min"))
    return d.withColumn("reason", F.when(~F.isnan(e) & (e > F.col("energy_min") + delta), F.lit("energy_window")))


def relative_energy(df: DataFrame, energy: str, *, group: list[str] | None = None, name: str = "relative_energy") -> DataFrame:
    low = group_min(df, energy, group or [], "_lo", nan_poisons=False)
    return attach(df, low, group or []).withColumn(name, F.col(energy) - F.col("_lo")).drop("_lo")


def dual_threshold(df: DataFrame, *, id: str, energy: str, feat, delta: float | None, threshold: float,
                   group: list[str] | None = None, min_gap: float | None = None, **kw) -> DataFrame:
    """Energy window, then the diversity filter in energy order."""
    cand = energy_window(df, energy, delta, group=group)
    ids = diversity_ids(cand, id=id, feat=feat, threshold=threshold, order=energy, group=group, min_gap=min_gap, **kw)
    return cand.join(ids, id, "left_semi")


def candidate_filter(df: DataFrame, mode: str, *, id: str, energy: str, feat, delta: float | None, threshold: float,
                     group: list[str] | None = None, min_gap: float | None = None) -> DataFrame:
    """``none | energy | rmsd | dual``; anything else means dual."""
    mode = mode.strip().lower()
    if mode == "none":
        return df
    if mode == "energy":
        return energy_window(df, energy, delta, group=group)
    if mode == "rmsd":
        return df.join(diversity_ids(df, id=id, feat=feat, threshold=threshold, group=group, min_gap=min_gap), id, "left_semi")
    return dual_threshold(df, id=id, energy=energy, feat=feat, delta=delta, threshold=threshold, group=group, min_gap=min_gap)


def dual_flags(df: DataFrame, *, id: str, energy: str, feat, delta: float, threshold: float,
               group: list[str] | None = None) -> DataFrame:
    """Every row with ``delta_e, energy_keep, min_dist, rmsd_keep``.

    ``min_dist`` is the distance to the nearest row kept before this one (infinite for the
    first kept row, NULL outside the window).
    """
    group = group or []
    low = group_min(df, energy, group, "_lo", nan_poisons=True)
    d = attach(df, low, group).withColumn("delta_e", F.col(energy) - F.col("_lo"))
    d = d.withColumn("energy_keep", within(F.col(energy).cast("double"), F.col("_lo") + delta)).drop("_lo")
    cand = d.where("energy_keep")
    kept = diversity_ids(cand, id=id, feat=feat, threshold=threshold, order=energy, group=group)
    rows = prepared(cand, id, feat, energy, group)
    reps = rows.join(kept.select(F.col(id).alias("_id")), "_id", "left_semi").select("_g", "_id", "_e", "_x")
    near = k_nearest(rows, reps, 1, earlier_only=True).select(F.col("_a").alias(id), F.col("_d").alias("min_dist"))
    d = d.join(kept.withColumn("rmsd_keep", F.lit(True)), id, "left").join(near, id, "left")
    d = d.withColumn("rmsd_keep", F.coalesce("rmsd_keep", F.lit(False)))
    inf = F.lit(float("inf"))
    return d.withColumn("min_dist", F.when(F.col("energy_keep"), F.coalesce("min_dist", inf)))


def dual_diagnostics(flags: DataFrame, energy: str, *, group: list[str] | None = None) -> DataFrame:
    n, ke, kr = F.count(F.lit(1)), F.count_if("energy_keep"), F.count_if("rmsd_keep")
    return flags.groupBy(*(group or [])).agg(
        n.alias("n_total"), F.min(energy).alias("e_min"), ke.alias("n_energy_keep"), (n - ke).alias("n_energy_drop"),
        kr.alias("n_rmsd_keep"), (ke - kr).alias("n_rmsd_drop"), (ke / n).alias("frac_energy_keep"),
        F.when(ke > 0, kr / ke).otherwise(0.0).alias("frac_rmsd_keep_of_energy_keep"))


def target_k(df: DataFrame, k: int | None, *, id: str, energy: str, feat, group: list[str] | None = None) -> DataFrame:
    """Keep ``k`` rows per group: the lowest energy first, then the row with the largest
    (distance to chosen rows, smallest energy gap to them, -energy). Adds ``pick``."""
    order = [F.col(energy), F.col(id)]
    ranked = None
    if not k or k <= 0:
        return ordered_scan(df, order, group=group, position="pick")
    n = df.groupBy(*(group or [])).agg(F.count(F.lit(1)).alias("_n"))
    sized = attach(df, n, group or [])
    small = sized.where(F.col("_n") <= k).drop("_n")
    ranked = ordered_scan(small, order, group=group, position="pick")
    large = sized.where(F.col("_n") > k).drop("_n")
    picks = farthest_points(large, k, id=id, feat=feat, energy=energy, group=group, start="lowest", use_gap=True)
    return ranked.unionByName(large.join(picks.select(id, "pick"), id))


@dataclass(frozen=True)
class GridStop:
    """Stop adding rounds when the picks fill a grid over the leading components."""

    variance: float = 0.95
    bins: int = 12
    min_rounds: int = 5
    patience: int = 3
    min_gain: float = 1e-3
    min_novelty: float = 5e-2

    def decide(self, picks: DataFrame, rows: DataFrame, at: Keys) -> DataFrame:
        axes = pca_fit(rows, at.feat, variance=self.variance)
        cells = project(rows, at.feat, axes, "_p").select(*at.by, at.id, "_p")
        cells = grid_bins(cells, "_p", self.bins, name="_bin", group=at.group)
        cells = cells.join(prepared(rows, at.id, at.feat, None, at.group).select(F.col("_id").alias(at.id), "_g"), at.id)
        return grid_occupancy(picks.join(cells.select(at.id, "_bin"), at.id), cells, F.col("_bin"), group=["_g"], min_rounds=self.min_rounds,
                              patience=self.patience, min_coverage_gain=self.min_gain, min_novelty=self.min_novelty)


@dataclass(frozen=True)
class BinStop:
    """Stop adding rounds when they stop meeting new combinations of ``columns`` (those that exist; else ids)."""

    # fixed values: the provenance columns of poses
    columns: tuple[str, ...] = ("basis_id", "primitive_index", "conformer_id", "azimuth_index", "height_shift_index")
    min_new: int = 0
    patience: int = 2
    min_rounds: int = 1

    def decide(self, picks: DataFrame, rows: DataFrame, at: Keys) -> DataFrame:
        names = [c for c in self.columns if c in rows.columns] or [at.id]
        met = picks.join(rows.select(at.id, *[c for c in names if c != at.id]), at.id)
        return site_occupancy(met, F.struct(*names), group=["_g"], min_new_bins=self.min_new, patience=self.patience, min_rounds=self.min_rounds)


@dataclass(frozen=True)
class Rounds:
    """Picks come in rounds of ``size``, at most ``count`` of them, until ``stop`` ends them."""

    size: int | None = None
    count: int | None = None
    stop: GridStop | BinStop | None = None


@dataclass(frozen=True)
class Keys:
    """Columns a rule works on."""

    id: str
    feat: str
    energy: str | None = None
    group: list[str] | None = None

    @property
    def by(self) -> list[str]:
        return self.group or []

    @property
    def order(self) -> list[Column]:
        return [nan_last(self.energy), F.col(self.id)] if self.energy else [F.col(self.id)]

    def windowed(self, rows: DataFrame, delta: float | None) -> DataFrame:
        return rows if self.energy is None else energy_window(rows, self.energy, delta, group=self.group)


@dataclass(frozen=True)
class Farthest:
    """Farthest-point picks, ``keep`` per group (0: as many as rows), from ``starts`` or a seeded row."""

    keep: int = 0
    window: float | None = None
    seed: int = 0
    starts: tuple[int, ...] = ()
    rounds: Rounds | None = None

    def apply(self, rows: DataFrame, at: Keys) -> DataFrame:
        rows = at.windowed(rows, self.window)
        first = tuple(dict.fromkeys(int(v) for v in self.starts))
        given = rows.sparkSession.createDataFrame([(v, n) for n, v in enumerate(first)], f"{at.id} long, seed_order int") if first else None
        in_turns = bool(first) or self.rounds is not None
        picks = farthest_points(rows, self.keep or rows.count(), id=at.id, feat=at.feat, group=at.group, seed=self.seed, seeds=given, iterative=in_turns)
        if in_turns:
            turns = self.rounds or Rounds()
            picks = in_rounds(picks, turns.size, max(1, len(first)), turns.count)
            if turns.stop is not None:
                picks = cut_picks(picks, turns.stop.decide(picks, rows, at), ["_g"])
        return rows.join(picks.select(at.id), at.id, "left_semi")


@dataclass(frozen=True)
class Spread:
    """An energy window, then rows farther than ``distance`` from every kept one; the best ``keep`` of them."""

    keep: int = 0
    window: float | None = None
    distance: float = 0.10

    def apply(self, rows: DataFrame, at: Keys) -> DataFrame:
        if at.energy is None:
            out = rows.join(diversity_ids(rows, id=at.id, feat=at.feat, threshold=self.distance, group=at.group), at.id, "left_semi")
        else:
            out = dual_threshold(rows, id=at.id, energy=at.energy, feat=at.feat, delta=self.window, threshold=self.distance, group=at.group)
        return head(out, self.keep, at.order, at.group)


@dataclass(frozen=True)
class Clusters:
    """An energy window, then the best member of every cluster; the best ``keep`` of them."""

    keep: int = 0
    window: float | None = None
    distance: float = 0.10
    method: str = "hierarchical"

    def apply(self, rows: DataFrame, at: Keys) -> DataFrame:
        rows = at.windowed(rows, self.window)
        best = C.representatives(rows, id=at.id, feat=at.feat, threshold=self.distance, energy=at.energy, group=at.group, method=self.method)
        return head(rows.join(best.select(at.id), at.id, "left_semi"), self.keep, at.order, at.group)


Rule = Farthest | Spread | Clusters | None

# fixed values: public names of the strategies
STRATEGIES: dict[str, Callable[..., Rule]] = {
    "none": lambda **o: None, "off": lambda **o: None, "disabled": lambda **o: None,
    "fps": Farthest, "iterative_fps": lambda rounds=Rounds(), **o: Farthest(rounds=rounds, **o),
    "energy_rmsd_window": Spread, "molclus": Spread, "molclus_like": Spread,
    "cluster": Clusters, "hierarchical": Clusters, "fuzzy": lambda **o: Clusters(method="fuzzy", **o),
}


def rule(name: str, **options) -> Rule:
    """The rule of a named strategy; None passes every row."""
    make = STRATEGIES.get(name.strip().lower())
    if make is None:
        raise ValueError(f"unsupported selection strategy: {name}")
    return make(**options)


def stage_select(df: DataFrame, chosen: Rule, *, id: str, feat, energy: str | None = None, group: list[str] | None = None) -> DataFrame:
    """Rows that a selection rule keeps, with the input's columns."""
    return df if chosen is None else chosen.apply(df, Keys(id, feat, energy, group)).select(*df.columns)


def head(df: DataFrame, n: int, order: list[Column], group: list[str] | None = None) -> DataFrame:
    """First ``n`` rows per group; 0 keeps all. Rank filters are limited per task before the shuffle."""
    if n <= 0:
        return df
    if not group:
        return df.orderBy(*order).limit(n)
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
