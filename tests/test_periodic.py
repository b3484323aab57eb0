import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelark.operators import structure as S
from sievelark.operators.cluster import merged_basins

ATOMS = "frame long, atom long, is_ads boolean, z int, px double, py double, pz double"
LATTICE = "frame long, cell array<array<double>>, pbc array<boolean>"


def test_contacts_across_skewed_borders(spark):
    """Every frame has its own cell; distances equal the nearest image by brute force."""
    rng = np.random.default_rng(4)
    cells = {f: np.array([[4.0 + f, 0, 0], [1.7 * (f % 3), 4.5, 0], [0.6 * f, -0.9, 7.0]]) for f in range(5)}
    pbc = {f: [True, f != 2, f % 2 == 0] for f in range(5)}
    rows = [(f, i, i >= 6, int(rng.choice([6, 8, 78])), *map(float, rng.uniform(-6, 12, 3))) for f in range(5) for i in range(10)]
    atoms = spark.createDataFrame(rows, ATOMS)
    lattice = spark.createDataFrame([(f, cells[f].tolist(), pbc[f]) for f in range(4)], LATTICE)  # frame 4 has none
    cols = ["frame", "atom", "z", "px", "py", "pz"]
    ads, slab = atoms.where("is_ads").select(*cols), atoms.where("not is_ads").select(*cols)
    got = {(r["frame"], r["a_atom"], r["b_atom"]): r["d"] for r in S.atoms_within_images(ads, slab, 3.0, max_cutoff=3.0, lattice=lattice).collect()}
    want = {}
    for f, i, ad, _, *p in rows:
        for g, j, bd, _, *q in rows:
            if f == g and ad and not bd:
                span = [range(-9, 10) if f < 4 and pbc[f][k] else (0,) for k in range(3)]
                d = min(np.linalg.norm(np.array(p) - q + np.array(n) @ cells[f]) for n in itertools.product(*span))
                if d <= 3.0:
                    want[f, i, j] = d
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_classifier_sees_contacts_across_the_border(spark):
    rows = [(0, 0, False, 78, 0.1, 1.0, 1.0), (0, 1, False, 78, 2.8, 1.0, 1.0), (0, 2, True, 6, 9.2, 1.0, 2.0)]
    atoms = spark.createDataFrame(rows, ATOMS)
    lattice = spark.createDataFrame([(0, [[10.0, 0.0, 0.0], [0.0, 10.0, 0.0], [0.0, 0.0, 20.0]], [True, True, False])], LATTICE)
    assert S.classify_frames(atoms, atoms).first()["reason"] == "desorption"
    r = S.classify_frames(atoms, atoms, lattice=lattice).first()
    assert r["reason"] is None and r["binding_pair_n"] == 1


def test_merged_basin_takes_the_lowest_energy(spark):
    b = spark.createDataFrame([(0, 10, 5.0, "s", 1, 7), (1, 11, 4.5, "t", 2, 8), (2, 12, float("nan"), "u", 1, 9)], "basin_id long, rep_id long, energy double, signature string, n_members long, cluster long")
    merged = spark.createDataFrame([(0, 0, 10), (0, 1, 11), (0, 1, 13), (2, 2, 12)], "cluster long, basin_id long, frame_id long")
    out, members = merged_basins(b, merged)
    got = {r["basin_id"]: (r["rep_id"], r["energy"], r["n_members"], r["source_basin_ids"]) for r in out.where(~F.isnan("energy")).collect()}
    assert got == {1: (11, 4.5, 3, "0,1")}
    assert sorted(map(tuple, members.collect())) == [(1, 10), (1, 11), (1, 13), (2, 12)]


def test_small_frames_lay_out_no_images(spark, monkeypatch):
    """Frames joined whole compare nearest images pair by pair: no copy of an atom is made, nulls and frames without a cell stay open."""
    monkeypatch.setattr(S, "with_images", None)
    rows = [(f, i, i < 3, 78, x, 0.7 * i, 0.3 * i * i) for f in range(3) for i, x in enumerate((0.2, 9.1, 17.3, 3.9, 12.4))]
    rows += [(0, 1, True, 78, 9.1, 0.7, 0.3), (0, 9, True, 78, None, 0.0, 0.0), (None, 3, False, 78, 0.0, 0.0, 0.0)]
    cells = {0: ([[4.0, 0.0, 0.0], [39.0, 4.0, 0.0], [0.0, 0.0, 30.0]], [True, True, False]), 1: ([[5.0, 0.0, 0.0], [2.0, 6.0, 0.0], [-1.0, 2.0, 7.0]], [True, True, True])}
    lattice = spark.createDataFrame([(f, *c) for f, c in cells.items()] + [(2, None, None)], LATTICE)
    a = spark.createDataFrame(rows, ATOMS)
    got = S.atoms_within_images(a.where("is_ads"), a.where("not is_ads"), 3.0, max_cutoff=3.0, lattice=lattice).collect()
    assert len(got) == len({(r["frame"], r["a_atom"], r["b_atom"]) for r in got})
    want = {}
    for f, i, p in [(r[0], r[1], np.array(r[4:])) for r in rows if r[2] and r[4] is not None]:
        for g, j, q in [(r[0], r[1], np.array(r[4:])) for r in rows if not r[2]]:
            if f == g:
                cell, pbc = cells.get(f, (np.eye(3), [False] * 3))
                n = np.array(list(itertools.product(*[range(-40, 41) if k < 2 and pbc[k] else range(-3, 4) if pbc[k] else (0,) for k in range(3)])), float)
                d = np.sqrt(((p - q + n @ np.array(cell)) ** 2).sum(1)).min()
                if d <= 3.0:
                    want[f, i, j] = d
    assert {(r["frame"], r["a_atom"], r["b_atom"]): r["d"] for r in got} == pytest.approx(want) and {f for f, _, _ in want} >= {0, 1}
    assert all(np.linalg.norm([r[f"a_{c}"] - r[f"b_{c}"] for c in ("px", "py", "pz")]) == pytest.approx(r["d"]) for r in got)
    ratios = {r["frame"]: r["min_ratio"] for r in S.min_contact_ratio(a.where("px is not null"), lattice=lattice).collect()}
    assert ratios[0] == pytest.approx(min(d for (f, _, _), d in want.items() if f == 0) / 2.72)
