"""The full pipeline over pose rows: select, relax, classify, deduplicate, identify, audit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from sievelark.functions.exprs import as_double
from sievelark.functions.plugins import pair_distances, relax
from sievelark.operators import graph as G
from sievelark.operators import structure as S
from sievelark.operators.cluster import cluster_basins, merge_representatives, merged_basins, numbered_basins, with_clusters
from sievelark.operators.lattice import PACKED, nearest_image, packed_lattice
from sievelark.operators.select import Farthest, basin_window, candidate_filter, stage_select, target_k
from sievelark.plans.presets import Schedule, make_schedule
from sievelark.session import settle


@dataclass
class Result:
    basins: DataFrame
    members: DataFrame
    rejected: DataFrame
    nodes: DataFrame
    stages: DataFrame


def surface_distances(frames: DataFrame, name: str = "features", lattice: DataFrame | None = None) -> DataFrame:
    """Selection features of a frame row: per adsorbate atom its sorted distances to the slab atoms, nearest images in a ``lattice``."""
    p, n = F.col("positions"), F.col("slab_n")
    slab, ads = F.slice(p, 1, n), F.slice(p, n + 1, F.size(p) - n)
    if lattice is None:
        dist = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
    else:
        dist = lambda a, b: nearest_image(*(a[i] - b[i] for i in range(3)))["d"]
        frames = frames.join(packed_lattice(lattice).withColumnRenamed("frame", "frame_id"), "frame_id", "left")
    return frames.withColumn(name, F.flatten(F.transform(ads, lambda a: F.array_sort(F.transform(slab, lambda b: dist(a, b)))))).drop(PACKED)


def run_workflow(frames: DataFrame, *, schedule: str | Schedule = "multistage_default", relax_backend="identity", tau: float = 1.15, delta: float = 1.0,
                 basin_threshold: float = 0.10, method: str = "greedy", merge_threshold: float | None = None, reference: DataFrame | None = None, lattice: DataFrame | None = None) -> Result:
    """From pose frames to basins and nodes.

    ``lattice`` (``frame, cell, pbc``) gives frames periodic cells, for every distance of every stage.

    ``frames``: ``frame_id, numbers, positions, slab_n, energy``. Every row keeps its
    ``frame_id`` through all stages, so members always point at the right input.
    """
    sch = make_schedule(schedule) if isinstance(schedule, str) else schedule
    pool = settle(surface_distances(frames, lattice=lattice))
    picked = pool if sch.exhaustive else stage_select(pool, sch.before, id="frame_id", feat="features")
    relaxed = settle(surface_distances(relax(picked.drop("features"), relax_backend), lattice=lattice))
    atoms = settle(S.explode_frames(relaxed))
    ref = settle(S.explode_frames((reference if reference is not None else frames).join(relaxed.select("frame_id"), "frame_id", "left_semi")))
    marked = S.classify_frames(atoms, ref, tau=tau, lattice=lattice).select(F.col("frame").alias("frame_id"), F.col("reason").alias("anomaly"))
    j = settle(relaxed.join(marked, "frame_id", "left"))
    ok = settle(basin_window(j.where("anomaly is null"), "energy", delta))
    rejected = j.where("anomaly is not null").select("frame_id", F.col("anomaly").alias("reason")).unionByName(
        ok.where("reason is not null").select("frame_id", "reason"))
    kept = stage_select(ok.where("reason is null").drop("reason", "energy_min", "delta_e", "anomaly"), sch.after, id="frame_id", feat="features", energy="energy")
    pairs = settle(S.binding_pairs(atoms, lattice=lattice))
    sig = S.absolute_signature(pairs).withColumnRenamed("frame", "frame_id")
    kept = settle(kept.join(sig, "frame_id", "left").withColumn("signature", F.coalesce("signature", F.lit("free"))))
    clustered = settle(with_clusters(kept, id="frame_id", feat="features", threshold=basin_threshold, method=method, energy="energy", group=["signature"]))
    b = settle(numbered_basins(cluster_basins(clustered, id="frame_id", signature="signature", energy="energy")))
    members = settle(clustered.select("cluster", "frame_id").join(b.select("cluster", "basin_id"), "cluster").select("basin_id", "frame_id"))
    if merge_threshold is not None:
        reps = b.join(kept.select(F.col("frame_id").alias("rep_id"), "features"), "rep_id")
        merged = settle(merge_representatives(reps, members, id="basin_id", energy="energy", feat="features", threshold=merge_threshold, member_key="frame_id"))
        b, members = merged_basins(b, merged)
        b, members = settle(b), settle(members)
    nodes = node_table(atoms.join(b.select(F.col("rep_id").alias("frame")), "frame", "left_semi"), pairs, lattice)
    low = b.groupBy().agg(F.min("energy").alias("m")).select("m").scalar()
    nodes = b.join(nodes, b["rep_id"] == nodes["frame"], "left").withColumn("relative_energy", F.col("energy") - low).drop("frame")
    stage = lambda df, n, name: df.select(F.lit(n).alias("stage_no"), F.lit(name).alias("stage")).groupBy("stage_no", "stage").agg(F.count(F.lit(1)).alias("n"))
    stages = stage(pool, 0, "poses").unionByName(stage(relaxed, 1, "selected")).unionByName(stage(ok.where("reason is null"), 2, "window")).unionByName(
        stage(kept, 3, "post_selected")).unionByName(stage(b, 4, "basins"))
    return Result(b, members, rejected, nodes, stages)


def node_table(atoms: DataFrame, pairs: DataFrame, lattice: DataFrame | None = None) -> DataFrame:
    """``frame, node_id, denticity`` of the given frames; bonds cross the borders of a ``lattice``."""
    v = lambda c: F.xxhash64("frame", c)
    ads = settle(atoms.where("is_ads").select("frame", v("atom").alias("v"), "z", "atom"))
    bonds = S.bonds(atoms, lattice=lattice).select(v("i").alias("src"), v("j").alias("dst"))
    order = settle(G.canonical_order(ads.drop("atom"), settle(bonds)))
    p = pairs.join(atoms.select("frame").distinct(), "frame", "left_semi")
    ids = G.node_ids(order, bonds, p.select(v("ads").alias("v"), "surf"))
    return ids.join(S.denticity(p).select("frame", "denticity"), "frame", "left").fillna(0, ["denticity"])


@dataclass
class Profile:
    """Selection options of the conformer pipeline."""

    preselect_k: int = 128
    target: int | None = None
    energy_window: float = 0.25
    threshold: float = 0.05
    min_gap: float | None = None
    mode: str = "dual"


def conformer_profile(name: str = "manual", target: int | None = None) -> Profile:
    # fixed values: windows, gaps and sizes of the named profiles
    key = name.strip().lower()
    if key in {"manual", ""}:
        return Profile(target=target)
    if key == "isolated_strict":
        k = target or 12
        return Profile(max(64, 4 * k), k, 0.20, min_gap=0.02)
    if key == "adsorption_seed_broad":
        k = target or 8
        return Profile(max(96, 6 * k), k, 0.60, min_gap=0.01)
    raise ValueError(f"unsupported selection profile: {name}")


def run_conformers(frames: DataFrame, *, profile: str | Profile = "manual", loose="identity", refine="identity",
                   target: int | None = None) -> DataFrame:
    """Raw frames to a final ensemble: preselect, loose relax, filter, refine, filter, target size.

    ``frames``: ``frame_id, molecule, numbers, positions, energy``.
    """
    p = conformer_profile(profile, target) if isinstance(profile, str) else profile
    key = ["molecule"]
    f = settle(pair_distances(frames))
    f = stage_select(f, Farthest(p.preselect_k), id="frame_id", feat="features", group=key)
    for backend in (loose, refine):
        bare = f.drop(*[c for c in ("features", "relax_error") if c in f.columns])
        f = settle(pair_distances(relax(bare, backend)))
        f = settle(candidate_filter(f, p.mode, id="frame_id", energy="energy", feat="features", delta=p.energy_window, threshold=p.threshold,
                                    group=key, min_gap=p.min_gap))
    return target_k(f, p.target, id="frame_id", energy="energy", feat="features", group=key)
