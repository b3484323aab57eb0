"""Poses are solved and capped without shuffling them again and again."""

import math
import random

import pytest

from sievelark.operators import poses as P
from sievelark.operators import structure as S

SITE = "frame long, site_id long, coordination int, cx double, cy double, cz double, nx double, ny double, nz double, t1x double, t1y double, t1z double, t2x double, t2y double, t2z double"
CO = [(6, 0.0, 0.0, 0.0), (8, 0.0, 0.0, 1.15)]


def test_near_atoms_go_along_with_the_poses(spark):
    """Atoms joined to sites give the heights of the join by poses, and no pose passes an exchange."""
    rng = random.Random(3)
    atoms = [(f, 10 * f + n, 29, rng.uniform(0, 4), rng.uniform(0, 4), rng.uniform(0, 1)) for f in range(4) for n in range(5)]
    rows = [(f, 100 * f + n, 1 + n % 3, *[rng.uniform(0, 4) for _ in "xy"], 0.5, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0) for f in range(5) for n in range(4)]
    slab = spark.createDataFrame(atoms, "frame long, atom long, z int, px double, py double, pz double")
    s = spark.createDataFrame(rows, SITE)
    members = spark.createDataFrame([(r[1], 10 * r[0] + m) for r in rows for m in (0, 1, 1)] + [(rows[0][1], None)], "site_id long, atom long")
    shifts, quats, turns = [(0.0, 0.0), (0.4, 0.2)], P.tilt_quaternions(2), P.azimuth_angles(2)
    rules = P.Heights(taus=(0.9, 1.0), rescue=0.2)
    by_pose = P.solve_heights(P.enumerate_poses(s, shifts=shifts, quaternions=quats, azimuths=turns), slab, members, CO, rules=rules)
    near = P.with_near_atoms(s, slab, members, CO, shifts=shifts, rules=rules)
    by_site = P.solve_heights(P.enumerate_poses(near, shifts=shifts, quaternions=quats, azimuths=turns, keep=("_near",)), slab, members, CO, rules=rules)
    assert by_site.columns == by_pose.columns
    rows_of = lambda d: sorted(map(str, d.collect()))
    assert rows_of(by_site) == rows_of(by_pose) and by_site.count() > 50
    above = by_site._jdf.queryExecution().sparkPlan().toString().split("Generate")[0]
    assert "MapInArrow" in above and "Join" not in above


@pytest.mark.parametrize("k", [1, 3])
def test_sites_are_capped_whole(spark, monkeypatch, k):
    """One pass gives what the rounds give: ties, repeated ids, several and missing families, undefined rotations."""
    rng = random.Random(8)
    rows = []
    for n in range(160):
        site = n % 13 if n < 150 else None
        q = [rng.gauss(0, 1) for _ in range(4)]
        q = [v / math.hypot(*q) for v in q] if n % 17 else None
        rows.append((n, site, rng.choice(["flat", "tilted", "upright", None]) if site and site % 2 else None, rng.randrange(5) / 4, q, rng.randrange(3) / 3, rng.randrange(3) / 3, n % 5))
    rows += [rows[20], (20, *rows[20][1:3], 0.9, *rows[20][4:]), (500, 77, "flat", 1.0, rows[1][4], 0.0, 0.0, 0)]
    df = spark.createDataFrame(rows, "pose_id long, site_id long, orientation_family string, height double, quaternion array<double>, shift_u double, shift_v double, frame long")
    got = sorted(map(str, P.cap_per_site(df, k).collect()))
    rounds = sorted(map(str, df.join(P._cap_by_rounds(df, k, "pose_id"), "pose_id", "left_semi").select(*df.columns).collect()))
    mixed_block = 12
    monkeypatch.setattr(P, "CAP_BLOCK", mixed_block)
    mixed = sorted(map(str, P.cap_per_site(df, k).select(*df.columns).collect()))
    assert got == rounds == mixed
    monkeypatch.setattr(P, "CAP_BLOCK", 65_536)
    monkeypatch.setattr(P, "_cap_by_rounds", None)
    assert P.cap_per_site(df, k).count() == len(got)


def test_small_frames_meet_by_their_frame_alone(spark, monkeypatch):
    """Pairs of small frames need one exchange of each table; large frames give the same pairs by a grid."""
    rng = random.Random(2)
    rows = [(f if f else None, n, 29, *[rng.uniform(0, 9) for _ in "xyz"]) for f, many in ((0, 4), (1, 6), (2, 40), (3, 9)) for n in range(many)]
    a = spark.createDataFrame(rows, "frame long, atom long, z int, px double, py double, pz double")
    key = lambda d: sorted(map(str, d.select("frame", "a_atom", "b_atom", "d").collect()))
    whole = S.atoms_within(a, a, 3.0, max_cutoff=3.0)
    assert "_c#" not in whole._jdf.queryExecution().optimizedPlan().toString()
    want = sorted(str((r[0], r[1], s[1])) for r in rows for s in rows if r[0] and r[0] == s[0] and math.dist(r[3:], s[3:]) <= 3.0)
    assert sorted(str((r["frame"], r["a_atom"], r["b_atom"])) for r in whole.collect()) == want
    monkeypatch.setattr(S, "FEW", 20)
    assert key(S.atoms_within(a, a, 3.0, max_cutoff=3.0)) == key(whole)
    cell = (9.0, 9.0, 9.0)
    some = key(S.atoms_within(a, a, 3.0, max_cutoff=3.0, cell=cell))
    monkeypatch.setattr(S, "FEW", 512)
    assert key(S.atoms_within(a, a, 3.0, max_cutoff=3.0, cell=cell)) == some


@pytest.mark.parametrize("case", ["plain", "gated", "turned", "repeated", "doubled"])
def test_small_groups_are_thinned_whole(spark, monkeypatch, case):
    """Kept rows are those of the sequential rule, without batches of a tile join; large groups still take those."""
    from sievelark.operators import greedy as G
    from sievelark.operators.tiles import prepared

    rng = random.Random(4)
    rows = [(n, f"g{n % 6}", rng.randrange(5) / 2, [rng.randrange(9) / 4, rng.randrange(9) / 4, rng.choice([0.0, -0.0, 1.0])]) for n in range(240)]
    rows += [(240, "g1", 0.0, [float("nan"), 0.0, 0.0]), (241, "g2", 0.5, rows[2][3]), (242, "g3", None, [9.0, 9.0, 0.0])]
    if case == "repeated":
        rows += [rows[7], (8, "g2", 9.0, [5.0, 5.0, 0.0])]
    if case == "doubled":
        rows += rows
    gate = (lambda a, b: abs(a - b) <= 1.0) if case == "gated" else None
    by = {"dims": 2, "extra": lambda p, q: p[:, 0] == q[:, 0]} if case == "turned" else {}
    df = prepared(spark.createDataFrame(rows, "id long, g string, e double, x array<double>"), "id", "x", "e", "g")
    want = set()
    for g in {r[1] for r in rows}:
        reps = []
        for n, _, e, x in sorted({(*r[:3], tuple(r[3])) for r in rows if r[1] == g and r[0] != 240}, key=lambda r: (math.inf if r[2] is None else r[2], r[0])):
            d = lambda y: math.dist(x[:by.get("dims")], y[:by.get("dims")])
            if not any(d(y) < 0.6 and (gate is None or abs(e - f) <= 1.0) and (not by or x[2] == y[2]) for f, y in reps):
                reps.append((e if e is not None else math.inf, x))
                want.add(n)
    by_batches = sorted(r["_id"] for r in G._keep_in_batches(df.where("_id <> 240"), 0.6, True, gate, 4096, by.get("dims"), by.get("extra")).collect())
    monkeypatch.setattr(G, "_keep_in_batches", None)
    got = [r["_id"] for r in G.keep_first(df, 0.6, gate=gate, **by).collect()]
    # the rows of id 8 stand or fall together
    assert len(got) == len(by_batches) and sorted(got) == by_batches and set(got) - {8} == want - {8}
