"""Extension points: relaxation, descriptors and conformer generation.

A plug-in is a function from a list of frames to a result per frame. It runs inside
``mapInPandas`` on the executors; a failed frame keeps its input with an undefined energy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

_CACHE: dict = {}


def cached(key, build: Callable):
    """One object per executor process and key, for models and calculators."""
    if key not in _CACHE:
        _CACHE[key] = build()
    return _CACHE[key]


def identity_relax(frame: dict) -> tuple[list, float]:
    """Positions unchanged; the energy is the frame's own."""
    e = frame.get("energy")
    return frame["positions"], float("nan") if e is None else float(e)


RELAXERS: dict[str, Callable[[dict], tuple[list, float]]] = {"identity": identity_relax}
DESCRIPTORS: dict[str, Callable[[dict], list[float]]] = {}
GENERATORS: dict[str, Callable[[dict, int], list[dict]]] = {}


def lookup(registry: dict, name: str, what: str):
    key = name.strip().lower()
    if key not in registry:
        raise ValueError(f"unsupported {what}: {name}")
    return registry[key]


def relax(frames: DataFrame, backend: str | Callable = "identity") -> DataFrame:
    """Frames with updated ``positions`` and ``energy`` and a ``relax_error`` column."""
    fn = lookup(RELAXERS, backend, "relax backend") if isinstance(backend, str) else backend
    schema = ", ".join(f"{c} {t}" for c, t in frames.dtypes) + ", relax_error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pos, en, err = [], [], []
            for row in b.to_dict("records"):
                try:
                    p, e = fn(row)
                    pos.append([list(map(float, v)) for v in p])
                    en.append(float(e))
                    err.append(None)
                except Exception as x:  # noqa: BLE001 - a failed frame must not stop the others
                    pos.append(row["positions"])
                    en.append(float("nan"))
                    err.append(f"{type(x).__name__}: {x}")
            yield b.assign(positions=pos, energy=en, relax_error=err)

    # pandas hands undefined numbers over as NULL; an unknown energy is NaN here
    return frames.mapInPandas(run, schema).withColumn("energy", F.coalesce("energy", F.lit(float("nan"))))


def generate(seeds: DataFrame, generator: str | Callable, n_runs: int, *, seed: int = 0, mode: str = "increment") -> DataFrame:
    """Frames of several seeded runs per molecule: ``run, seed`` plus the generator's rows.

    ``mode``: ``fixed`` repeats the seed, ``increment`` adds the run number, ``hashed`` mixes
    both with a stable hash.
    """
    fn = lookup(GENERATORS, generator, "conformer generator") if isinstance(generator, str) else generator
    run = F.explode(F.sequence(F.lit(0), F.lit(n_runs - 1))).alias("run")
    d = seeds.select("*", run)
    s = {"fixed": F.lit(seed), "increment": F.col("run") + seed, "hashed": F.pmod(F.xxhash64(F.lit(seed), "run"), F.lit(2**31 - 1))}[mode]
    d = d.withColumn("seed", s.cast("long")).repartition(F.col("molecule"), F.col("run"))

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                for n, f in enumerate(fn(r, int(r["seed"]))):
                    rows.append({"molecule": r["molecule"], "run": r["run"], "seed": r["seed"], "frame_no": n, "numbers": list(f.get("numbers", r["numbers"])),
                                 "positions": [list(map(float, v)) for v in f["positions"]], "energy": f.get("energy", float("nan"))})
            yield pd.DataFrame(rows, columns=["molecule", "run", "seed", "frame_no", "numbers", "positions", "energy"])

    return d.mapInPandas(make, "molecule string, run int, seed long, frame_no int, numbers array<int>, positions array<array<double>>, energy double")


def pair_distances(frames: DataFrame, name: str = "features") -> DataFrame:
    """Distances of all atom pairs of a frame row, in index order."""
    p = F.col("positions")
    n = F.size(p)
    d = F.flatten(F.transform(p, lambda a, i: F.transform(F.slice(p, i + 2, F.greatest(F.lit(0), n - i - 1)), lambda b: F.sqrt(
        F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)))))
    return frames.withColumn(name, d)
