import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelark.operators import cluster as C
from sievelark.operators import greedy
from sievelark.operators.components import _stars, components
from sievelark.operators.fps import farthest_points
from sievelark.operators.greedy import diversity_ids, first_fit
from sievelark.operators.select import (Clusters, Farthest, GridStop, Rounds, Spread, basin_window, candidate_filter, dual_threshold, energy_window, rule, stage_select, target_k)
from sievelark.operators.stats import kmeans_pick_lowest, parity_metrics
from sievelark.operators.tiles import Grid, Tiles, near_pairs, plan_grid, prepared

SCHEMA = "id long, g string, x array<double>, e double"


def frame(spark, X, E=None, g=None):
    X = np.asarray(X, dtype=float)
    E = np.zeros(len(X)) if E is None else E
    g = ["a"] * len(X) if g is None else g
    return spark.createDataFrame([(i, g[i], [float(v) for v in X[i]], float(E[i])) for i in range(len(X))], SCHEMA)


def ids(df, c="id"):
    return sorted(r[c] for r in df.select(c).collect())


def greedy_oracle(X, E, t, strict=True, gap=None):
    order = sorted(range(len(X)), key=lambda i: (E[i], i))
    kept = []
    for i in order:
        close = [j for j in kept if (np.linalg.norm(X[i] - X[j]) < t if strict else np.linalg.norm(X[i] - X[j]) <= t)]
        if not close or (gap and all(abs(E[i] - E[j]) >= gap for j in close)):
            kept.append(i)
    return sorted(kept)


@pytest.mark.parametrize("block", [4096, 16])
def test_diversity_matches_sequential_rule_on_a_grid(spark, block):
    rng = np.random.default_rng(1)
    X = np.concatenate([rng.normal(size=(150, 3)) * 4, rng.normal(size=(80, 3)) * 0.05])
    X = np.concatenate([X, X[:20]])
    E = np.round(rng.random(len(X)), 2)
    df = frame(spark, X, E)
    assert ids(diversity_ids(df, id="id", feat="x", threshold=0.8, order="e", group="g", block=block)) == greedy_oracle(X, E, 0.8)


def test_diversity_with_gap(spark):
    rng = np.random.default_rng(2)
    X, E = rng.normal(size=(120, 2)), np.round(rng.random(120), 2)
    got = ids(diversity_ids(frame(spark, X, E), id="id", feat="x", threshold=0.6, order="e", min_gap=0.2))
    assert got == greedy_oracle(X, E, 0.6, gap=0.2)


def test_large_conflict_groups_use_rounds(spark, monkeypatch):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(150, 2))
    E = np.arange(150.0)
    monkeypatch.setattr(greedy.dropped_by_edges, "__defaults__", (3,))
    assert ids(diversity_ids(frame(spark, X, E), id="id", feat="x", threshold=0.5, order="e")) == greedy_oracle(X, E, 0.5)


def test_undefined_features(spark):
    nan = float("nan")
    later = frame(spark, [[0.0, 0.0], [nan, 0.0], [3.0, 0.0]], [0, 1, 2])
    first = frame(spark, [[nan, 0.0], [0.0, 0.0], [3.0, 0.0]], [0, 1, 2])
    assert ids(diversity_ids(later, id="id", feat="x", threshold=1.0, order="e")) == [0, 2]
    assert ids(diversity_ids(first, id="id", feat="x", threshold=1.0, order="e")) == [0]


def test_first_fit(spark):
    rng = np.random.default_rng(4)
    X, E = rng.normal(size=(100, 2)), rng.permutation(100).astype(float)
    reps = greedy_oracle(X, E, 0.7, strict=False)
    want = {}
    for i in range(100):
        near = [r for r in reps if np.linalg.norm(X[i] - X[r]) <= 0.7]
        want[i] = min(near, key=lambda r: (E[r], r))
    got = {r["id"]: r["rep_id"] for r in first_fit(frame(spark, X, E), id="id", feat="x", threshold=0.7, order="e").collect()}
    assert got == want


@pytest.mark.parametrize("block", [4096, 8])
def test_near_pairs_complete_in_hot_cells(spark, block):
    rng = np.random.default_rng(5)
    X = np.concatenate([rng.normal(size=(60, 3)) * 5, rng.normal(size=(60, 3)) * 0.2])
    got = {(r["_a"], r["_b"]) for r in near_pairs(prepared(frame(spark, X), "id", "x", None, "g"), 0.4, block=block).collect()}
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if np.linalg.norm(X[i] - X[j]) <= 0.4}
    assert got == want


def test_energy_windows(spark):
    nan = float("nan")
    df = frame(spark, [[0.0]] * 4, [0.0, 0.05, 0.3, 0.32])
    assert ids(energy_window(df, "e", 0.05)) == [0, 1]
    assert ids(energy_window(df, "e", None)) == [0, 1, 2, 3]
    bad = frame(spark, [[0.0]] * 3, [0.0, nan, 9.0])
    assert ids(energy_window(bad, "e", 1.0)) == []
    kept = basin_window(bad, "e", 1.0).where("reason is null")
    assert ids(kept) == [0, 1]


def test_dual_threshold_fixture(spark):
    X = [[0, 0], [0.02, 0], [0.3, 0], [0.6, 0], [0.61, 0]]
    got = ids(dual_threshold(frame(spark, X, [0, 0.03, 0.10, 0.35, 0.36]), id="id", energy="e", feat="x", delta=0.2, threshold=0.05))
    assert 0 in got and 2 in got and 3 not in got


def test_pair_gap_fixture(spark):
    df = frame(spark, [[0, 0], [0, 0.01], [1, 0], [1, 0.01]], [0, 0.30, 0.02, 0.40])
    run = lambda gap: ids(candidate_filter(df, "rmsd", id="id", energy="e", feat="x", delta=None, threshold=0.05, min_gap=gap))
    assert len(dual_threshold(df, id="id", energy="e", feat="x", delta=9.0, threshold=0.05, min_gap=0.20).collect()) == 4
    assert len(run(0)) == 2


def fps_oracle(X, k, start, E=None):
    pick, n = [start], len(X)
    d = ((X - X[start]) ** 2).sum(1)
    gap = np.abs(E - E[start]) if E is not None else np.zeros(n)
    while len(pick) < min(k, n):
        rest = [i for i in range(n) if i not in pick]
        best = max(rest, key=lambda i: (d[i], gap[i], -(E[i] if E is not None else 0), -i))
        pick.append(best)
        d = np.minimum(d, ((X - X[best]) ** 2).sum(1))
        if E is not None:
            gap = np.minimum(gap, np.abs(E - E[best]))
    return pick


@pytest.mark.parametrize("pool", [1024, 4])
def test_farthest_points(spark, pool):
    X = np.random.default_rng(0).normal(size=(200, 8))
    got = [r["id"] for r in farthest_points(frame(spark, X), 32, id="id", feat="x", pool=pool).orderBy("pick").collect()]
    assert got == fps_oracle(X, 32, int(np.random.default_rng(0).integers(0, 200)))


def test_farthest_points_of_equal_rows(spark):
    got = [r["id"] for r in farthest_points(frame(spark, np.zeros((50, 3))), 30, id="id", feat="x").collect()]
    assert len(got) == 30 == len(set(got))


def test_target_k(spark):
    rng = np.random.default_rng(6)
    X, E = np.round(rng.normal(size=(40, 2)), 1), np.round(rng.random(40), 2)
    start = min(range(40), key=lambda i: (E[i], i))
    got = [r["id"] for r in target_k(frame(spark, X, E), 7, id="id", energy="e", feat="x").orderBy("pick").collect()]
    assert got == fps_oracle(X, 7, start, E)


def test_chain_merges_in_linkage_modes(spark):
    df = frame(spark, [[0.0], [0.19], [0.38]])
    n = lambda m: C.cluster_ids(df, id="id", feat="x", threshold=0.2, method=m).select("cluster").distinct().count()
    assert (n("hierarchical"), n("fuzzy"), n("greedy")) == (1, 1, 2)
    with pytest.raises(ValueError):
        C.cluster_ids(df, id="id", feat="x", threshold=0.2, method="other")


def test_copies_do_not_need_pairs(spark):
    X = np.zeros((300, 2))
    X[250:] = 5.0
    got = C.cluster_ids(frame(spark, X), id="id", feat="x", threshold=0.1)
    assert got.groupBy("cluster").count().count() == 2


def test_energy_gate_splits(spark):
    df = frame(spark, [[0.0], [0.0]], [0.0, 0.3])
    n = lambda g: C.cluster_ids(df, id="id", feat="x", threshold=0.1, energy="e", gate=g).select("cluster").distinct().count()
    assert (n(None), n(0.05)) == (1, 2)


def test_stage_fixtures(spark):
    def pair(stretch):
        P = np.array([[0, 0, 1.5], [0.95 + stretch, 0, 1.5], [0.3, 0.8 + stretch, 1.5]])
        return [np.linalg.norm(P[i] - P[j]) for i in range(3) for j in range(i + 1, 3)]

    df = frame(spark, [pair(s) for s in (0, 0.02, 0.30, 0.32)], [0.0, 0.02, 0.30, 0.32])
    win = Spread(window=0.05, distance=0.05)
    assert ids(stage_select(df, win, id="id", feat="x", energy="e")) == [0]
    assert stage_select(df, Farthest(2), id="id", feat="x").count() == 2
    odd = df.withColumn("e", F.element_at(F.array(*[F.lit(v) for v in (0.1, 0.0, 0.4, 0.3)]), (F.col("id") + 1).cast("int")))
    reps = stage_select(odd, Clusters(distance=0.05), id="id", feat="x", energy="e")
    assert ids(reps) == [1, 3]
    with pytest.raises(ValueError):
        rule("other")
    assert rule("disabled") is None and stage_select(df, rule("off"), id="id", feat="x").count() == 4


def test_grid_convergence_stops_early(spark):
    corners = [[0, 0], [0, 1], [1, 0], [1, 1]] * 8
    cfg = Farthest(16, rounds=Rounds(4, stop=GridStop(bins=2, min_rounds=2, patience=1, min_novelty=0.25)))
    n = stage_select(frame(spark, corners), cfg, id="id", feat="x").count()
    assert 4 <= n < 16


def test_kmeans_fixture(spark):
    X = [[0.0]] * 6 + [[10.0]] * 6
    E = np.linspace(0.5, 0.0, 12)
    assert ids(kmeans_pick_lowest(frame(spark, X, E), id="id", feat="x", energy="e", k=2)) == [5, 11]


def test_components_paths_agree(spark):
    rng = np.random.default_rng(7)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2)) if a != b] + [(i, i + 1) for i in range(300, 360)]
    df = spark.createDataFrame(e, "src long, dst long")
    small = sorted(map(tuple, components(df.withColumn("g", F.lit(1)), "g").collect()))
    assert small == sorted(map(tuple, _stars(df).collect()))


def test_parity_without_spread(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0)], "t double, p double")
    assert math.isnan(parity_metrics(df, "t", "p").first()["r2"])


def test_small_groups_beside_a_large_one(spark):
    """Groups of a few rows are joined whole, a large one by its grid; pairs are those of brute force."""
    rng = np.random.default_rng(12)
    rows = [(i, 0 if i < 700 else i % 40, rng.random(2).round(2).tolist()) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, g long, x array<double>")
    got = sorted((r["_a"], r["_b"]) for r in near_pairs(prepared(df, "id", "x", "id", "g"), 0.05).collect())
    want = sorted((a, b) for a, g, x in rows for b, h, y in rows if a < b and g == h and np.sqrt(((np.array(x) - y) ** 2).sum()) <= 0.05)
    assert got == want


@pytest.mark.parametrize("gated", [False, True])
def test_first_fit_of_small_groups_in_one_pass(spark, monkeypatch, gated):
    """Groups of few rows are solved whole, without a tile join: copies, repeated ids, undefined features, ties."""
    from sievelark.operators import greedy as G

    rng = random.Random(5)
    rows = [(n, f"g{n % 7}", float(rng.randrange(4)), [rng.randrange(12) / 4, rng.randrange(12) / 4]) for n in range(200)]
    rows += [rows[3], (200, "g1", 0.0, [float("nan"), 1.0]), (201, "g1", 0.0, None)]
    df = spark.createDataFrame(rows, "id long, g string, e double, x array<double>")
    gate = (lambda a, b: abs(a - b) <= 1.0) if gated else None
    want = {200: 200, 201: 201}
    for g in {r[1] for r in rows}:
        reps = []
        for n, _, e, x in sorted((r for r in rows if r[1] == g and r[0] < 200), key=lambda r: (r[2], r[0])):
            near = [m for m, e2, y in reps if math.dist(x, y) <= 0.6 and (not gated or abs(e - e2) <= 1.0)]
            want[n] = min(near, key=lambda m: (dict((k, v) for k, v, _ in reps)[m], m)) if near else n
            if not near:
                reps.append((n, e, x))
    monkeypatch.setattr(G, "keep_first", None)
    got = [tuple(r) for r in G.first_fit(df, id="id", feat="x", threshold=0.6, order="e", group="g", gate=gate).collect()]
    assert len(got) == len(rows) and dict(got) == want
