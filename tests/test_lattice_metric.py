"""Reduced lattices and clustering under other metrics, against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelark.operators import lattice as L
from sievelark.operators import metric as M
from sievelark.operators import structure as S
from sievelark.operators.cluster import cluster_ids
from sievelark.plans.workflow import node_table, surface_distances

ATOMS = "frame long, atom long, is_ads boolean, z int, px double, py double, pz double"
LATTICE = "frame long, cell array<array<double>>, pbc array<boolean>"
SKEWED = [[4.0, 0.0, 0.0], [39.0, 4.0, 0.0], [0.0, 0.0, 40.0]]


def images(d, cell, pbc, reach=60):
    """Length of the shortest image, by listing images wide enough for the cells of these tests."""
    span = [range(-reach, reach + 1) if pbc[0] else (0,), range(-5, 6) if pbc[1] else (0,), range(-2, 3) if pbc[2] else (0,)]
    n = np.array(list(itertools.product(*span)), float)
    return np.sqrt(((d + n @ np.array(cell)) ** 2).sum(1)).min()


def test_reduction_keeps_the_lattice_and_finds_the_nearest_image():
    rng = np.random.default_rng(3)
    for _ in range(60):
        cell = rng.normal(size=(3, 3)) * 3
        cell[1] += rng.integers(-12, 13) * cell[0]
        cell[2] += rng.integers(-5, 6) * cell[0] + rng.integers(-5, 6) * cell[1]
        pbc = rng.random(3) < 0.8
        p = L._packed(cell[None], pbc[None]).iloc[0]
        red = np.array(p["cell"])[pbc]
        assert np.isclose(np.linalg.det(red @ red.T), np.linalg.det(cell[pbc] @ cell[pbc].T), rtol=1e-6)
        d = rng.normal(size=3) * 8
        turned = d - np.rint(np.array(p["dual"]) @ d) @ np.array(p["cell"])
        got = min(np.linalg.norm(turned + s) for s in np.array(p["shifts"]))
        q = np.rint(np.linalg.lstsq(red.T, d, rcond=None)[0]) if pbc.any() else np.zeros(0)
        want = min(np.linalg.norm(d - (q + o) @ red) for o in itertools.product(range(-3, 4), repeat=int(pbc.sum())))
        assert abs(got - want) < 1e-9


def test_far_contacts_in_a_skewed_cell(spark):
    """A pair that is close only through an image many short vectors away; no near pass finds it at a small radius."""
    rows = [(0, 0, False, 78, 0.0, 0.0, 0.0), (0, 1, True, 6, 20.5, 0.9, 7.0), (1, 0, False, 78, 0.0, 0.0, 0.0), (1, 1, True, 6, 20.5, 0.9, 7.0)]
    atoms = spark.createDataFrame(rows, ATOMS)
    lattice = spark.createDataFrame([(0, SKEWED, [True, True, False])], LATTICE)
    got = {r["frame"]: r["min_ratio"] for r in S.min_contact_ratio(atoms, lattice=lattice).collect()}
    d = np.array([20.5, 0.9, 7.0])
    assert got[0] == pytest.approx(images(d, SKEWED, [1, 1, 0]) / (1.36 + 0.76)) and got[1] == pytest.approx(np.linalg.norm(d) / (1.36 + 0.76))


@pytest.mark.parametrize("few", [S.FEW, 3])
def test_nearest_atoms_in_cells(spark, monkeypatch, few):
    """Same neighbours for frames joined whole and for frames searched by radius; rows without cell, flags or lattice are open."""
    monkeypatch.setattr(S, "FEW", few)
    rng = np.random.default_rng(5)
    cells = {0: (SKEWED, [True, True, False]), 1: ([[5.0, 0.0, 0.0], [2.0, 6.0, 0.0], [-1.0, 2.0, 7.0]], [True, True, True]), 2: (None, None)}
    rows = [(f, i, i >= 9, 6, *map(float, rng.uniform(-9, 9, 3))) for f in range(4) for i in range(12)]
    atoms = spark.createDataFrame(rows, ATOMS)
    lattice = spark.createDataFrame([(f, *c) for f, c in cells.items()], LATTICE)
    got = {(r["frame"], r["atom"], r["rank"]): (r["other"], r["d"]) for r in S.nearest_atoms(atoms.where("is_ads"), atoms.where("not is_ads"), 3, lattice=lattice).collect()}
    for f in range(4):
        cell, pbc = cells.get(f, (None, None))
        for r in rows[12 * f + 9:12 * f + 12]:
            near = []
            for q in rows[12 * f:12 * f + 9]:
                d = np.array(r[4:]) - q[4:]
                near.append((images(d, cell, pbc) if cell else np.linalg.norm(d), q[1]))
            for k, (d, other) in enumerate(sorted(near)[:3], 1):
                assert got[f, r[1], k] == (other, pytest.approx(d, abs=1e-9))


def test_workflow_parts_see_the_border(spark):
    """A molecule across the border has the same features and node id as one inside."""
    cell, pbc = [[10.0, 0.0, 0.0], [3.0, 10.0, 0.0], [0.0, 0.0, 20.0]], [True, True, False]
    slab = [[5.0, 5.0, 0.0], [2.0, 2.0, 0.0]]
    inside = [[5.0, 5.0, 1.8], [5.6, 5.0, 2.7]]
    across = [[p[0] + dx, p[1], p[2]] for p, dx in zip(inside, (0.0, 10.0))]
    frames = spark.createDataFrame([(0, [78, 78, 6, 8], slab + inside, 2), (1, [78, 78, 6, 8], slab + across, 2)], "frame_id long, numbers array<int>, positions array<array<double>>, slab_n int")
    lattice = spark.createDataFrame([(0, cell, pbc), (1, cell, pbc)], LATTICE)
    f = {r["frame_id"]: r["features"] for r in surface_distances(frames, lattice=lattice).collect()}
    assert f[0] == pytest.approx(f[1])
    atoms = S.explode_frames(frames)
    ids = lambda lat: {r["frame"]: r["node_id"] for r in node_table(atoms, S.binding_pairs(atoms, lattice=lat), lat).collect()}
    assert ids(lattice)[0] == ids(lattice)[1] and ids(None)[0] != ids(None)[1]


def turned(rng, x):
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    return x @ (q * np.sign(np.linalg.det(q))) + rng.normal(size=3)


def test_rmsd_bound_and_symmetry():
    """Leading numbers never exceed the distance; rotated and permuted copies are at 0; few and many permutations agree."""
    rng = np.random.default_rng(8)
    classes = np.array([1, 1, 1, 6, 6, 8])
    rows, xs = [], []
    for _ in range(12):
        x = rng.normal(size=(6, 3))
        order = np.concatenate([rng.permutation(3), 3 + rng.permutation(2), [5]])
        for y in (x, turned(rng, x[order])):
            xs.append(y)
            rows.append(np.concatenate(M._molecule(y, classes)))
    rows = np.array(rows)
    i, j = map(np.array, zip(*itertools.combinations(range(len(rows)), 2)))
    d = M.rmsd_distance(rows[i, M.LEAD:], rows[j, M.LEAD:])
    assert (np.linalg.norm(rows[i, :M.LEAD] - rows[j, :M.LEAD], axis=1) <= d + 1e-7).all()
    want = [min(S.plain_rmsd(xs[a], xs[b][list(p) + [3 + q for q in r] + [5]]) for p in itertools.permutations(range(3)) for r in itertools.permutations(range(2))) for a, b in zip(i, j)]
    assert np.allclose(d, want, atol=1e-6) and (d[(i % 2 == 0) & (j == i + 1)] < 1e-6).all()
    few = M.rmsd_distance(rows[i, M.LEAD:], rows[j, M.LEAD:], exact=1)
    assert (few >= d - 1e-6).all()


@pytest.mark.parametrize("method", ["greedy", "hierarchical"])
def test_clusters_under_metrics(spark, method):
    """First fit and connected parts under RMSD and node distance equal the sequential rules; odd rows stand alone."""
    rng = np.random.default_rng(11)
    base = [rng.normal(size=(4, 3)) for _ in range(4)]
    classes = [1, 1, 6, 8]
    rows = []
    for i in range(40):
        x = base[i % 4] + rng.normal(size=(4, 3)) * 0.12
        rows.append((i, turned(rng, x[[1, 0, 2, 3]] if i % 3 else x).tolist(), classes, float(rng.integers(0, 9)), rng.normal(size=(4, 2)).round(1).tolist()))
    rows += [(40, None, classes, 0.0, None), (41, [[0.0, 0.0, 0.0]], classes, 0.0, [[1.0, 2.0]]), (42, [], [], 1.0, [])]
    df = spark.createDataFrame(rows, "id long, xyz array<array<double>>, classes array<int>, e double, desc array<array<double>>").withColumn("kind", M.class_key(F.col("classes")))
    for row, metric, limit, at in ((M.rmsd_row("xyz", "classes"), M.RMSD, 0.25, 1), (M.node_mean_row("desc", "classes"), M.NODE_L2, 0.9, 4)):
        got = {r["id"]: r["cluster"] for r in cluster_ids(df.withColumn("row", row), id="id", feat="row", threshold=limit, method=method, energy="e", group=["kind"], metric=metric).collect()}

        def dist(a, b):
            x, y = np.array(a[at]), np.array(b[at])
            if at == 1:
                return min(S.plain_rmsd(x, y[list(p) + [2, 3]]) for p in itertools.permutations((0, 1)))
            return min(np.linalg.norm(x - y[list(p) + [2, 3]], axis=1).mean() for p in itertools.permutations((0, 1)))

        good = sorted(rows[:40], key=lambda r: (r[3], r[0]))
        want = {i: i for i in (40, 41, 42)}
        if method == "greedy":
            reps = []
            for r in good:
                hit = next((q for q in reps if dist(r, q) <= limit), None)
                if hit is None:
                    reps.append(r)
                want[r[0]] = (hit or r)[0]
            assert got == want and len(reps) < 40
        else:
            part = {r[0]: r[0] for r in good}
            for a, b in itertools.combinations(good, 2):
                if dist(a, b) <= limit and part[a[0]] != part[b[0]]:
                    old, new = part[b[0]], part[a[0]]
                    part = {k: new if v == old else v for k, v in part.items()}
            same = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
            assert same(got) == same(part | want)
    none = cluster_ids(df.limit(0).withColumn("row", M.rmsd_row("xyz", "classes")), id="id", feat="row", threshold=0.3, method=method, energy="e", group=["kind"], metric=M.RMSD)
    assert none.count() == 0


def test_node_distances_are_matched_in_batches(monkeypatch):
    """Small classes never solve an assignment pair by pair; the distances are those of the assignment."""
    import pandas as pd

    rng = np.random.default_rng(11)
    classes = [[6], [6, 6], [8, 6], [6, 1, 6, 1], [1, 1, 1], [8] * 5, [6, 6, 6, 6, 1], [6]]
    which = rng.integers(0, len(classes), 400)
    desc = [rng.random((len(classes[i]), 3 if i != 7 else 2)).tolist() for i in which]
    rows = M._node_rows(pd.Series(desc + [None, [[1.0], []]]), pd.Series([classes[i] for i in which] + [None, [1, 2]]), True)
    assert rows[400] is None and rows[401] is None
    wide = np.zeros((400, max(len(r) for r in rows[:400])))
    for i, r in enumerate(rows[:400]):
        wide[i, :len(r)] = r
    a, b = wide[:200], wide[200:]
    solved = []
    monkeypatch.setattr(M, "assignment", lambda cost: solved.append(len(cost)) or S.assignment(cost))
    got = M.node_distance(a[:, M.LEAD:], b[:, M.LEAD:])
    for g, i, j, x, y in zip(got, which[:200], which[200:], a, b):
        if sorted(classes[i]) != sorted(classes[j]) or (i == 7) != (j == 7):
            assert np.isnan(g)
            continue
        n, m = int(x[M.LEAD]), int(x[M.LEAD + 1])
        c, (p, q) = x[M.LEAD + 2:M.LEAD + 2 + n], (v[M.LEAD + 2 + n:M.LEAD + 2 + n + n * m].reshape(n, m) for v in (x, y))
        want = min(sum(np.linalg.norm(p[r] - q[s]) for r, s in enumerate(o)) for o in itertools.permutations(range(n)) if all(c[r] == c[s] for r, s in enumerate(o)))
        assert g == pytest.approx(want) and np.linalg.norm(x[:M.LEAD] - y[:M.LEAD]) <= g + 1e-9
    assert (~np.isnan(got)).sum() > 20 and set(solved) == {5}


def test_molecule_rows_are_made_in_batches(monkeypatch):
    """Molecules of one size share a step; each row is that of the molecule by itself."""
    import pandas as pd

    rng = np.random.default_rng(12)
    kinds = [[6], [8, 6], [6, 1, 6], [1, 1, 6, 1, 8, 6, 6, 1, 1, 8]]
    classes = [kinds[i] for i in rng.integers(0, 4, 60)] + [None, [6], []]
    xyz = [rng.normal(size=(len(c or []), 3)).tolist() for c in classes[:60]] + [[[0.0, 0.0, 0.0]], None, []]
    steps, one = [], M._molecules
    monkeypatch.setattr(M, "_molecules", lambda x, c: steps.append(len(x)) or one(x, c))
    rows = M._molecule_rows(pd.Series(xyz), pd.Series(classes))
    assert len(steps) == 4 and rows[60:] == [None, None, None]
    for (lead, payload), p, c in zip(rows[:60], xyz, classes):
        order = np.argsort(c, kind="stable")
        x, k = (np.array(p) - np.mean(p, 0))[order], np.array(c, float)[order]
        r = np.concatenate([np.sort(np.linalg.norm(x[k == v], axis=1)) for v in np.unique(k)]) / np.sqrt(len(k))
        assert payload.tolist() == pytest.approx([len(k), *k, *x.ravel()]) and lead.tolist() == pytest.approx([np.linalg.norm(v) for v in np.array_split(r, M.LEAD)])
