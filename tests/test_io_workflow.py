import os
from dataclasses import FrozenInstanceError

import pytest
from pyspark.sql import functions as F

from sievelark.functions.plugins import RELAXERS, generate, relax
from sievelark.operators.select import GridStop
from sievelark.plans.presets import make_schedule, preset_names, strategy_matrix
from sievelark.plans.workflow import conformer_profile, run_conformers, run_workflow
from sievelark.sources import molecules as M
from sievelark.sources import sinks as K
from sievelark.streaming.batching import append_stream, budgeted, relax_continuously, remaining, rerun_actions


def test_molecule_files(spark, tmp_path):
    (tmp_path / "h2.gjf").write_text("%chk=a.chk\n# hf\n\ntitle\n\n0 1\nH 0 0 0\nH 0 0 0.74\n")
    (tmp_path / "ch.gjf").write_text("# hf geom=connectivity\n\ntitle\n\n0 1\nC 0 0 0\nH 0 0 1.0\n\n1 2 1.0\n2\n")
    (tmp_path / "bad.foo").write_text("nothing")
    rows = {os.path.basename(r["path"]): r for r in M.read_molecules(spark, str(tmp_path)).collect()}
    assert rows["h2.gjf"]["numbers"] == [1, 1]
    ch = rows["ch.gjf"]
    assert (ch["charge"], ch["multiplicity"], [tuple(b) for b in ch["bonds"]]) == (0, 1, [(0, 1, 1.0)])
    assert "unsupported" in rows["bad.foo"]["error"]


def test_connectivity_rules():
    assert M.connectivity(["1 2 1.5 3", "1 2 1.5 x 1.0", "1 2 1.5 3 y", "7 1 1.0", "x 1 1.0", "", "2"], 3) == []
    b = M.connectivity(["1 2 1.5 3 1.0", "2 1 2.0", "3 3 1.0 9 1.0"], 3)
    assert [(x["i"], x["j"], x["order"]) for x in b] == [(0, 1, 1.5), (0, 2, 1.0)]


@pytest.mark.parametrize("size", [64 << 20, 40])
def test_trajectory_ranges(spark, tmp_path, size):
    text = "".join(f"2\nframe {i}\nH 0.0 0.0 {i}.0\nO 0.0 0.0 {i}.7\n" for i in range(25))
    (tmp_path / "t.xyz").write_text(text)
    rows = M.read_frames(spark, str(tmp_path / "t.xyz"), size).orderBy("frame_no").collect()
    assert [r["positions"][0][2] for r in rows] == [float(i) for i in range(25)] and rows[0]["numbers"] == [1, 8]


def test_extxyz_round_trip(spark, tmp_path):
    df = spark.createDataFrame([([29, 8], [[0.0, 0.0, 0.0], [0.0, 0.0, 1.9]], [[5.0, 0.0, 0.0], [0.0, 5.0, 0.0], [0.0, 0.0, 20.0]], [True, True, False], -1.25, {"site_label": "top a"})],
                               "numbers array<int>, positions array<array<double>>, cell array<array<double>>, pbc array<boolean>, energy double, info map<string,string>")
    M.write_frames(df, str(tmp_path / "out"))
    r = M.read_frames(spark, str(tmp_path / "out")).first()
    assert r["numbers"] == [29, 8] and r["cell"][2][2] == 20.0 and r["pbc"] == [True, True, False] and r["energy"] == -1.25 and r["info"]["site_label"] == "top a"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 1.0, "x"), ("c", None, "y")], "name string, v double, reason string")
    K.write_rows(df, str(tmp_path), "rows", "Rows")
    assert os.path.exists(tmp_path / "rows.md") and "a;b" in (tmp_path / "rows.md").read_text()
    K.write_by_category(df, str(tmp_path / "cat"), "reason")
    assert os.path.isdir(tmp_path / "cat" / "reason=x")
    m = K.metric_rows(spark.createDataFrame([("s", 1, 2.0)], "stage string, a int, b double"), ["stage"])
    assert {(r["metric"], r["value"]) for r in m.collect()} == {("a", 1.0), ("b", 2.0)}


def test_completeness_and_rerun(spark):
    files = spark.createDataFrame([("a", "s.json"), ("a", "b.json"), ("b", "s.json")], "case string, file string")
    met = spark.createDataFrame([("a", "ok"), ("b", "ok"), ("c", "bad")], "case string, m string")
    got = {r["case"]: (r["complete"], r["reason"]) for r in M.complete_cases(files, met, ["s.json", "b.json"], ["m"]).collect()}
    assert got == {"a": (True, None), "b": (False, "missing:b.json"), "c": (False, "missing:s.json")}
    act = rerun_actions(spark.createDataFrame([("a",), ("b",)], "case string"), spark.createDataFrame([("a", True), ("b", False), ("z", True)], "case string, complete boolean"))
    assert {r["case"]: r["action"] for r in act.collect()} == {"a": "copy_complete", "b": "rerun", "z": "skip_unknown_case"}


def test_continuous_batching():
    seen = []

    def step(active):
        seen.append(sum(r["w"] for r in active))
        for r in active:
            r["left"] -= 1
        return [r["left"] <= 0 for r in active]

    rows = [{"i": i, "w": w, "left": n} for i, (w, n) in enumerate([(3, 1), (3, 4), (3, 2), (20, 1), (1, 1)])]
    out = list(budgeted(iter(rows), step, lambda r: r["w"], 7))
    assert {r["i"] for r in out} == set(range(5)) and all(s <= 7 or s == 20 for s in seen)


def test_relax_stream_in_partitions(spark):
    df = spark.range(40).select("id", (F.col("id") % 5 + 1).cast("double").alias("left"))

    def step(active):
        for r in active:
            r["left"] -= 1.0
        return [r["left"] <= 0 for r in active]

    got = relax_continuously(df, step, lambda r: 1.0, 4.0)
    assert {r["id"]: r["n_steps"] for r in got.collect()} == {i: i % 5 + 1 for i in range(40)}


def test_append_stream_and_resume(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.range(10).select("id", (F.col("id") % 2 == 0).alias("converged")).write.parquet(src)
    cases = spark.range(10).select("id")
    assert remaining(cases, out, ["id"]).count() == 10
    q = append_stream(spark.readStream.schema("id long, converged boolean").parquet(src), out, str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert sorted(r["id"] for r in remaining(cases, out, ["id"]).collect()) == [1, 3, 5, 7, 9]


def test_failed_relaxation_keeps_the_input(spark):
    df = spark.createDataFrame([(0, [[0.0, 0.0, 0.0]], 1.0), (1, [[1.0, 0.0, 0.0]], 2.0)], "frame_id long, positions array<array<double>>, energy double")

    def fail_second(f):
        if f["frame_id"] == 1:
            raise RuntimeError("diverged")
        return f["positions"], -1.0

    got = {r["frame_id"]: r for r in relax(df, fail_second).collect()}
    assert got[0]["energy"] == -1.0 and got[1]["energy"] != got[1]["energy"] and got[1]["positions"] == [[1.0, 0.0, 0.0]] and "diverged" in got[1]["relax_error"]
    with pytest.raises(ValueError):
        relax(df, "unknown")


def test_generator_seeds(spark):
    seeds = spark.createDataFrame([("m", [1], [[0.0, 0.0, 0.0]])], "molecule string, numbers array<int>, positions array<array<double>>")
    gen = lambda row, seed: [{"positions": [[float(seed), 0.0, 0.0]], "energy": 0.0}]
    got = generate(seeds, gen, 3, seed=5)
    assert sorted(r["positions"][0][0] for r in got.collect()) == [5.0, 6.0, 7.0]
    assert {r["seed"] for r in generate(seeds, gen, 3, seed=5, mode="fixed").collect()} == {5}


def test_presets():
    assert len(preset_names()) == 7 and make_schedule(" Default ").name == "multistage_default"
    s = make_schedule("adaptive_default")
    assert s.before.rounds.size == 4 and isinstance(s.before.rounds.stop, GridStop) and s.after.distance == 0.05
    with pytest.raises(FrozenInstanceError):
        s.before.keep = 1
    assert make_schedule("adaptive_default").before.keep == 24
    assert len(strategy_matrix()) == 20
    with pytest.raises(ValueError):
        make_schedule("other")
    assert conformer_profile("isolated_strict").preselect_k == 64 and conformer_profile("adsorption_seed_broad", 20).preselect_k == 120


def test_workflow_end_to_end(spark):
    slab = [[x * 2.8, y * 2.8, 0.0] for x in range(3) for y in range(3)]
    rows = []
    for i in range(12):
        x, y = (i % 3) * 2.8, ((i // 3) % 2) * 2.8
        rows.append((i, [78] * 9 + [6, 8], slab + [[x, y, 1.9 + 0.01 * (i // 6)], [x, y, 3.05 + 0.01 * (i // 6)]], 9, 0.1 * (i % 6) + 0.001 * i))
    rows.append((12, [78] * 9 + [6, 8], slab + [[0.0, 0.0, 8.0], [0.0, 0.0, 9.15]], 9, 5.0))
    f = spark.createDataFrame(rows, "frame_id long, numbers array<int>, positions array<array<double>>, slab_n int, energy double")
    r = run_workflow(f, schedule="no_selection", delta=2.0)
    assert {x["frame_id"]: x["reason"] for x in r.rejected.collect()} == {12: "desorption"}
    b = r.basins.orderBy("basin_id").collect()
    assert len(b) == 6 and sum(x["n_members"] for x in b) == 12
    n = r.nodes.collect()
    assert len(n) == 6 and min(x["relative_energy"] for x in n) == 0.0 and all(x["node_id"] for x in n)
    assert r.stages.where("stage = 'basins'").first()["n"] == 6


def test_conformers(spark):
    rows = [(i, "m", [1, 1, 8], [[0.0, 0.0, 0.0], [1.0 + 0.2 * i, 0.0, 0.0], [0.0, 1.0, 0.0]], 0.02 * i) for i in range(10)]
    f = spark.createDataFrame(rows, "frame_id long, molecule string, numbers array<int>, positions array<array<double>>, energy double")
    got = run_conformers(f, target=3).orderBy("pick").collect()
    assert len(got) == 3 and got[0]["frame_id"] == 0
