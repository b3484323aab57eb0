"""Voxel floods over blocks, height ladders, orientations and second shells, against plain loops."""

import itertools
import math
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelark.functions.fixed import COVALENT_RADII
from sievelark.operators import orientation as O
from sievelark.operators import poses as P
from sievelark.operators import voxels as V
from sievelark.operators.rows import row_like_edges

SLAB = "frame long, atom long, z int, px double, py double, pz double"
LATTICE = "frame long, cell array<array<double>>, pbc array<boolean>"


def flood_by_hand(atoms, cell, pbc, spacing, scale, axis=2):
    """Contacts of every atom by a breadth-first flood of one dense grid."""
    cell = np.array(cell)
    lengths = np.linalg.norm(cell, axis=1)
    dims = [max(4, math.ceil(v / spacing) + 1) for v in lengths]
    full = np.zeros(dims, bool)
    frac = [np.array(p) @ np.linalg.inv(cell) for _, p in atoms]
    frac = [f - np.where(pbc, np.floor(f), 0) for f in frac]
    n = np.array(dims) - 1
    centre = [np.clip(np.rint(f * n).astype(int), 0, n) for f in frac]
    for (z, _), f, c in zip(atoms, frac, centre):
        r = max(spacing, scale * COVALENT_RADII[z - 1])
        half = np.ceil(r / lengths * n).astype(int)
        for v in itertools.product(*[range(max(0, c[i] - half[i]), min(n[i], c[i] + half[i]) + 1) for i in range(3)]):
            d = np.array(v) / n - f
            d = np.array([x if i == axis else x - np.rint(x) for i, x in enumerate(d)])
            full[v] |= np.linalg.norm(d @ cell) <= r
    steps = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    seen = {v for v in itertools.product(*map(range, dims)) if not full[v] and v[axis] in (0, n[axis])}
    todo = deque(seen)
    while todo:
        v = todo.popleft()
        for s in steps:
            w = tuple(a + b for a, b in zip(v, s))
            if all(0 <= w[i] < dims[i] for i in range(3)) and not full[w] and w not in seen:
                seen.add(w)
                todo.append(w)
    return [sum(tuple(c + np.array(s)) in seen for s in steps) for c in centre]


@pytest.mark.parametrize("block,axis", [(3, 2), (5, 0), (16, 2)])
def test_voxel_surface(spark, block, axis):
    """Blocks of any size give the flood of the whole grid: closed cavities, skewed cells, open axes, frames without a cell."""
    rng = np.random.default_rng(block)
    shell = [(1, (4 + 2.2 * x, 4 + 2.2 * y, 4 + 2.2 * z)) for x, y, z in itertools.product((-1, 0, 1), repeat=3) if (x, y, z) != (0, 0, 0)] + [(1, (4.0, 4.0, 4.0))]
    frames = {0: (shell, [[8.0, 0.0, 0.0], [0.0, 8.0, 0.0], [0.0, 0.0, 8.0]], [True, True, False]),
              1: ([(int(rng.choice([1, 6, 29])), tuple(rng.uniform(-2, 9, 3))) for _ in range(14)], [[6.0, 0.0, 0.0], [2.0, 7.0, 0.0], [0.5, -1.0, 9.0]], [True, True, False]),
              2: ([(29, (1.0, 1.0, 1.0))], [[3.0, 0.0, 0.0], [0.0, 3.0, 0.0], [0.0, 0.0, 3.0]], [False, False, False])}
    rows = [(f, i, z, *map(float, p)) for f, (atoms, _, _) in frames.items() for i, (z, p) in enumerate(atoms)] + [(3, 0, 6, 0.0, 0.0, 0.0)]
    lattice = spark.createDataFrame([(f, c, p) for f, (_, c, p) in frames.items()], LATTICE)
    got = {(r["frame"], r["atom"]): r for r in V.voxel_surface(spark.createDataFrame(rows, SLAB), lattice, spacing=0.9, scale=0.8, axis=axis, block=block).collect()}
    assert {k[0] for k in got} == {0, 1, 2}
    for f, (atoms, cell, pbc) in frames.items():
        want = flood_by_hand(atoms, cell, pbc, 0.9, 0.8, axis)
        assert [got[f, i]["contact"] for i in range(len(atoms))] == want
        assert all(got[f, i]["found"] == (w > 0) and got[f, i]["score"] == pytest.approx(w / max(want) if max(want) else 0.0) for i, w in enumerate(want))


@pytest.mark.parametrize("whole", [0, 1_000, 32_768])
def test_voxel_surface_of_small_frames(spark, monkeypatch, whole):
    """Small frames are flooded whole, many to a task, without blocks; both ways agree, for atoms without a number too."""
    rng = np.random.default_rng(11)
    cells = [[[6.0, 0.0, 0.0], [2.0, 7.0, 0.0], [0.5, -1.0, 9.0]], [[9.0, 0.0, 0.0], [0.0, 9.0, 0.0], [0.0, 0.0, 9.0]]]
    frames = {f: ([(int(rng.choice([1, 6, 29])), tuple(rng.uniform(-2, 9, 3))) for _ in range(3 + f)], cells[f % 2]) for f in range(4)}
    rows = [(f, i or None, z, *map(float, p)) for f, (atoms, _) in frames.items() for i, (z, p) in enumerate(atoms)]
    lattice = spark.createDataFrame([(f, c, [True, True, False]) for f, (_, c) in frames.items()], LATTICE)
    used, by_blocks = [], V._by_blocks
    monkeypatch.setattr(V, "_by_blocks", lambda p, *a: used.append(p.select("frame").distinct().count()) or by_blocks(p, *a))
    got = {(r["frame"], r["atom"]): r for r in V.voxel_surface(spark.createDataFrame(rows, SLAB), lattice, spacing=0.9, scale=0.8, block=4, whole=whole).collect()}
    assert len(got) == len(rows) and used == {0: [4], 1_000: [2], 32_768: []}[whole]
    for f, (atoms, cell) in frames.items():
        want = flood_by_hand(atoms, cell, [True, True, False], 0.9, 0.8)
        want[0] = 0  # an atom without a number has no contacts
        assert [got[f, i or None]["contact"] for i in range(len(atoms))] == want
        assert all(got[f, i or None]["score"] == pytest.approx(w / max(max(want), 1)) for i, w in enumerate(want))


def test_height_ladder_and_rescue(spark):
    """Ladder, contact rule before and after halving, and rescue, in a skewed cell, against a scan with listed images."""
    cell, pbc = np.array([[5.0, 0.0, 0.0], [2.0, 5.5, 0.0], [0.0, 0.0, 30.0]]), [True, True, False]
    rng = np.random.default_rng(6)
    slab = [(29, np.array([x, y, 0.0]) + rng.normal(size=3) * 0.2) for x, y in ((0, 0), (2.5, 0), (1.0, 2.7), (3.5, 2.7))] + [(29, np.array([1.8, 1.3, 1.9]))]
    rows = [(0, i, z, *map(float, p)) for i, (z, p) in enumerate(slab)]
    sites, members = [], []
    for i in range(12):
        ids = sorted(rng.choice(5, 1 + i % 3, replace=False).tolist())
        c = np.mean([slab[k][1] for k in ids], axis=0) + [5.0 * (i % 2), 0.0, 0.0]
        n = np.array([0.1 * (i % 4), -0.05, 1.0])
        n /= np.linalg.norm(n)
        t = np.cross(n, [0.0, 1.0, 0.0])
        t /= np.linalg.norm(t)
        sites.append((0, i, len(ids), *map(float, [*c, *n, *t, *np.cross(n, t)])))
        members += [(i, int(k)) for k in ids]
    names = "frame long, site_id long, coordination int, cx double, cy double, cz double, nx double, ny double, nz double, t1x double, t1y double, t1z double, t2x double, t2y double, t2z double"
    mol = [(6, 0.0, 0.0, 0.0), (8, 0.3, 0.0, 1.1)]
    p = P.enumerate_poses(spark.createDataFrame(sites, names), shifts=[(0.0, 0.0), (0.7, 0.4)], quaternions=P.tilt_quaternions(3), azimuths=P.azimuth_angles(3))
    rules = P.Heights(taus=(0.8, 1.0, 1.3), clash=0.75, low=0.6, high=2.2, window=0.02, extra=0.01, rescue=0.15, rescue_extra=1.5, rescue_slack=0.5)
    lattice = spark.createDataFrame([(0, cell.tolist(), pbc)], LATTICE)
    got = {(r["site_id"], r["shift_index"], r["rotation_index"], r["azimuth_index"]): r for r in P.solve_heights(p, spark.createDataFrame(rows, SLAB), spark.createDataFrame(members, "site_id long, atom long"), mol, rules=rules, lattice=lattice).collect()}
    own = {s: {k for i, k in members if i == s} for s in range(12)}
    around = [(k, COVALENT_RADII[z - 1], q + np.array([a, b, 0]) @ cell) for k, (z, q) in enumerate(slab) for a in range(-3, 4) for b in range(-3, 4)]
    poses = {}
    for r in P.pose_atoms(p, mol).collect():
        poses.setdefault((r["site_id"], r["shift_index"], r["rotation_index"], r["azimuth_index"]), []).append((COVALENT_RADII[r["z"] - 1], np.array([r["px"], r["py"], r["pz"]]), np.array([r["nx"], r["ny"], r["nz"]]), r["coordination"]))
    how = set()
    for key, atoms in poses.items():
        def ratios(h):
            site = all_ = np.inf
            for r, q, n, _ in atoms:
                for k, s, x in around:
                    v = np.linalg.norm(q + h * n - x) / (r + s)
                    all_ = min(all_, v)
                    site = min(site, v) if k in own[key[0]] else site
            return site, all_

        def ok(h, target):
            site, all_ = ratios(h)
            return site >= target and all_ >= rules.clash

        want = tau = None
        loose = atoms[0][3] >= 3
        for t in rules.taus:
            target = max(t, rules.clash)
            h = next((0.6 + 0.1 * k for k in range(17) if 0.6 + 0.1 * k <= 2.2 + 1e-12 and ok(0.6 + 0.1 * k, target)), None)
            if h is None:
                continue
            if h <= 0.6 + 1e-12:
                want, tau = h, t
                break
            if not loose and ratios(h)[0] > target + 0.03:
                continue
            a, b = h - 0.1, h
            for _ in range(8):
                a, b = (a, (a + b) / 2) if ok((a + b) / 2, target) else ((a + b) / 2, b)
            if loose or ratios(b)[0] <= target + 0.03:
                want, tau = b, t
                break
        if want is None:
            want = next((0.6 + 0.15 * k for k in range(30) if 0.6 + 0.15 * k <= 3.7 + 1e-12 and ratios(0.6 + 0.15 * k)[1] >= 0.75 and (loose or ratios(0.6 + 0.15 * k)[0] <= 1.3 + 0.03 + 0.5)), None)
        how.add(tau if tau else "rescued" if want is not None else "none")
        assert (key in got) == (want is not None)
        if want is not None:
            assert got[key]["height"] == pytest.approx(want, abs=1e-9) and got[key]["tau"] == tau and got[key]["rescued"] == (tau is None)
    assert {0.8, "rescued"} <= how and len(how) >= 3


def quat_matrix(q):
    w, x, y, z = q
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])


def test_rotations(spark):
    """From two vectors, from matrices, without doubles, and spread with antipodes identified."""
    rng = np.random.default_rng(9)
    vec = [v / np.linalg.norm(v) for v in rng.normal(size=(20, 3))]
    pairs = [(a.tolist(), b.tolist()) for a, b in zip(vec[:10], vec[10:])] + [(vec[0].tolist(), (-vec[0]).tolist()), ([1.0, 0.0, 0.0], [-1.0, 0.0, 0.0]), (vec[1].tolist(), vec[1].tolist())]
    for r in spark.createDataFrame(pairs, "a array<double>, b array<double>").withColumn("q", O.quaternion_between(F.col("a"), F.col("b"))).collect():
        assert np.allclose(quat_matrix(r["q"]) @ r["a"], r["b"], atol=1e-6)
    quats = [q / np.linalg.norm(q) for q in rng.normal(size=(12, 4))] + [np.array([1.0, 0, 0, 0]), np.array([0, 1.0, 0, 0]), np.array([0, 0, 1.0, 0]), np.array([0, 0, 0, 1.0])]
    for q, r in zip(quats, spark.createDataFrame([(i, quat_matrix(q).tolist()) for i, q in enumerate(quats)], "i int, m array<array<double>>").orderBy("i").withColumn("q", O.matrix_quaternion(F.col("m"))).collect()):
        assert np.allclose(np.abs(np.dot(r["q"], q)), 1.0) and r["q"][0] >= 0
    many = quats[:8] + [-quats[2], quats[0]]
    df = spark.createDataFrame([([list(map(float, q)) for q in many],)], "q array<array<double>>")
    assert df.select(F.size(O.distinct_rotations(F.col("q")))).first()[0] == 8
    got = df.select(O.spread_rotations(F.col("q"), 5)).first()[0]
    angle = lambda a, b: 2 * math.acos(min(1.0, abs(float(np.dot(a, b)))))
    want = [many[0]]
    while len(want) < 5:
        want.append(max(many[1:], key=lambda q: min(angle(q, w) for w in want)))
    assert np.allclose(np.abs([np.dot(a, b) for a, b in zip(got, want)]), 1.0)
    # no more than there are different ones
    assert df.select(F.size(O.spread_rotations(F.col("q"), 20))).first()[0] == 8


def test_cone_direction(spark):
    rng = np.random.default_rng(2)
    cases = [[], [[0.0, 0.0, 0.0]], [[0.0, 2.0, 0.0]], [[1.0, 0.0, 0.0], [-1.0, 0.0, 0.0]], *[rng.normal(size=(k, 3)).tolist() for k in (2, 3, 4, 6)]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, v array<array<double>>").orderBy("i")
    for c, r in zip(cases, df.withColumn("c", O.cone_direction(F.col("v"))).collect()):
        rel = [np.array(v) / np.linalg.norm(v) for v in c if np.linalg.norm(v) > 1e-12]
        if not rel:
            assert r["c"] == [0.0, 0.0, 1.0]
            continue
        cands = rel + [a + b for a, b in itertools.combinations(rel, 2)] + [np.mean(rel, axis=0)]
        best = max(min(float(np.dot(v, x)) for v in rel) for x in (y / np.linalg.norm(y) for y in cands if np.linalg.norm(y) > 1e-12))
        assert np.linalg.norm(r["c"]) == pytest.approx(1.0) and min(float(np.dot(v, r["c"])) for v in rel) == pytest.approx(best, abs=1e-12)


def test_binding_atoms(spark):
    """One molecule per rule, and ties that go to the lowest atom."""
    mols = {0: ([6], []), 1: ([6, 1, 1], [(0, 1), (0, 2)]), 2: ([6, 8, 1, 7], [(0, 1), (1, 2), (0, 3)]), 3: ([6, 8, 6], [(0, 1), (1, 2)]), 4: ([6, 6], [(0, 1)]), 5: ([6, 8], [(0, 1)]), 6: ([1, 1], [(0, 1)]), 7: ([6, 6, 6], [(0, 1), (1, 2), (0, 2)])}
    rows = [(f, i, z, float(i), 0.3 * (i == 1), 0.0) for f, (zs, _) in mols.items() for i, z in enumerate(zs)]
    bonds = spark.createDataFrame([(f, i, j) for f, (_, bs) in mols.items() for i, j in bs], "frame long, i long, j long")
    got = {r["frame"]: (r["atom"], r["rule"]) for r in O.binding_atoms(spark.createDataFrame(rows, SLAB), bonds).collect()}
    assert got == {0: (0, "only"), 1: (0, "only"), 2: (1, "protic"), 3: (1, "hetero"), 4: (0, "terminal"), 5: (0, "terminal"), 6: (0, "terminal"), 7: (0, "heavy")}


def test_row_like_edges(spark):
    """A surface of rows gets its second shell; dense, small and ragged surfaces keep their edges."""
    rows = [(0, 10 * x + y, 29, 2.5 * x, 3.4 * y + 0.01 * x * y, 0.0) for x in range(4) for y in range(3)]
    rows += [(1, 10 * x + y, 29, 2.5 * x, 2.5 * y, 0.0) for x in range(3) for y in range(3)] + [(2, i, 29, 2.5 * i, 0.0, 0.0) for i in range(3)]
    atoms = spark.createDataFrame(rows, SLAB)
    e = [(f, a, b, math.dist(p, q)) for (f, a, _, *p), (g, b, _, *q) in itertools.combinations(rows, 2) if f == g and math.dist(p, q) <= 2.6]
    got = row_like_edges(atoms, atoms, spark.createDataFrame(e, "frame long, src long, dst long, d double")).collect()
    assert sorted((r["frame"], r["src"], r["dst"]) for r in got if r["shell"] == 1) == sorted(x[:3] for x in e)
    second = {(r["src"], r["dst"]) for r in got if r["shell"] == 2}
    assert second == {(10 * x + y, 10 * x + y + 1) for x in range(4) for y in range(2)} and all(r["frame"] == 0 for r in got if r["shell"] == 2)
    none = row_like_edges(atoms.limit(0), atoms.limit(0), spark.createDataFrame([], "frame long, src long, dst long, d double"))
    assert none.count() == 0


def test_pruning_across_borders(spark):
    """Greedy pruning by nearest images equals the sequential rule; frames without a cell stay open."""
    rng = np.random.default_rng(12)
    cells = {0: (np.array([[4.0, 0.0, 0.0], [15.0, 4.0, 0.0], [0.0, 0.0, 9.0]]), [True, True, False]), 1: (np.array([[3.0, 0.0, 0.0], [1.0, 3.5, 0.0], [0.7, -0.4, 4.0]]), [True, True, True])}
    rows = []
    for i in range(150):
        q = rng.normal(size=4)
        q = [1.0, 0.0, 0.0, 0.0] if i % 2 else (q / np.linalg.norm(q)).tolist()
        rows.append((i % 3, i, *map(float, rng.uniform(-6, 6, 2)), float(rng.uniform(0, 1)), 0.0, 0.0, 1.0, float(rng.integers(0, 4)) / 4, q))
    df = spark.createDataFrame(rows, "frame long, pose_id long, cx double, cy double, cz double, nx double, ny double, nz double, height double, quaternion array<double>")
    lattice = spark.createDataFrame([(f, c.tolist(), p) for f, (c, p) in cells.items()], LATTICE)
    got = {r["pose_id"] for r in P.prune_duplicates(df, com=0.9, rotation=1.2, lattice=lattice).collect()}
    kept = []
    for r in sorted(rows, key=lambda r: (r[8], r[1])):
        def close(o):
            d = np.array(r[2:5]) - o[2:5] + [0, 0, r[8] - o[8]]
            if r[0] in cells:
                cell, pbc = cells[r[0]]
                d = min((d + np.array(n) @ cell for n in itertools.product(*[range(-12, 13) if pbc[0] else (0,), range(-4, 5) if pbc[1] else (0,), range(-4, 5) if pbc[2] else (0,)])), key=np.linalg.norm)
            return np.linalg.norm(d) < 0.9 and 2 * math.acos(min(1.0, abs(float(np.dot(r[9], o[9]))))) < 1.2

        if not any(o[0] == r[0] and close(o) for o in kept):
            kept.append(r)
    assert got == {r[1] for r in kept} and 30 < len(kept) < 150


def test_rotations_are_computed_once(spark):
    """The candidates of a choice, and a vector to be scaled, stand in the plan once; inside lambdas they ran for every element."""
    df = spark.createDataFrame([([[1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.6, 0.8, 0.0, 0.0]],)], "q array<array<double>>")
    of = lambda c: df.select(c.alias("out"))
    spread = of(O.spread_rotations(F.reverse("q"), 2))
    unit = of(O.unit(F.reverse(F.slice(F.get("q", F.lit(2)), 1, 3))))
    for d in (spread, unit):
        assert d._jdf.queryExecution().analyzed().toString().count("reverse(") == 1
    assert spread.first()["out"] == [[0.6, 0.8, 0.0, 0.0], [1.0, 0.0, 0.0, 0.0]]
    assert unit.first()["out"] == pytest.approx([0.0, 0.8, 0.6])
