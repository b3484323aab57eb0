"""Farthest-point sampling in few passes.

A plain implementation reads the table once per chosen row. Here each pass takes the
``pool`` best rows of every group (farthest from everything chosen so far) and continues
the greedy choice inside that pool. A choice made there is also the table-wide choice as
long as it does not rank behind the last pool row, because distances only shrink.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from sievelark.operators.scan import ordered_scan
from sievelark.operators.tiles import has_nan, prepared
from sievelark.session import settle

POOL = 1024
CHUNK = 20_000
STATE = "_g string, _id long, _e double, _x array<double>, _chunk long, _d double, _gap double"


def _shrink(rows: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
    """Update the distance and order gap of a chunk against newly chosen rows."""
    rows = rows.copy()
    if len(centres) and len(rows):
        X = np.array(rows["_x"].tolist(), dtype=float)
        d, gap, e = rows["_d"].to_numpy(copy=True), rows["_gap"].to_numpy(copy=True), rows["_e"].to_numpy()
        for c, ce in zip(centres["_x"], centres["_e"]):
            d = np.minimum(d, ((X - np.asarray(c, dtype=float)) ** 2).sum(1))
            gap = np.minimum(gap, np.abs(e - ce))
        rows["_d"], rows["_gap"] = d, gap
        rows = rows[~rows["_id"].isin(set(centres["_id"]))]
    return rows


def _choose(pool: pd.DataFrame, k: int, size: int, use_gap: bool) -> pd.DataFrame:
    """Greedy choices inside one group's pool, while they are certain to hold table-wide."""
    pool = pool.reset_index(drop=True)
    X = np.array(pool["_x"].tolist(), dtype=float)
    d, e, ids = pool["_d"].to_numpy(copy=True), pool["_e"].to_numpy(), pool["_id"].to_numpy()
    gap = pool["_gap"].to_numpy(copy=True)
    want = k - int(pool["_done"].iloc[0])
    key = lambda n: (-d[n], -gap[n], e[n], ids[n]) if use_gap else (-d[n], ids[n])
    bound = max((key(n) for n in range(len(pool))), default=None) if len(pool) >= size else None
    live = np.ones(len(pool), dtype=bool)
    out = []
    while want > 0 and live.any():
        top = d[live].max()
        ties = np.nonzero(live & (d == top))[0]
        n = min(ties.tolist(), key=key)
        if bound is not None and key(n) > bound:
            break
        out.append(n)
        live[n] = False
        want -= 1
        d = np.minimum(d, ((X - X[n]) ** 2).sum(1))
        gap = np.minimum(gap, np.abs(e - e[n]))
    got = pool.iloc[out]
    first = int(pool["_done"].iloc[0])
    return pd.DataFrame({"_g": got["_g"], "_id": got["_id"], "_e": got["_e"], "_x": got["_x"],
                         "_n": np.arange(first, first + len(out), dtype="int64")})


def farthest_points(df: DataFrame, k: int, *, id: str, feat, group=None, energy=None, start: str = "random", seed: int = 0,
                    seeds: DataFrame | None = None, use_gap: bool = False, iterative: bool = False,
                    pool: int = POOL) -> DataFrame:
    """Choose ``k`` rows per group; returns ``_g, <id>, pick`` with picks numbered from 0.

    ``start``: ``random`` draws the first row's position (in id order) with NumPy's default
    generator, ``first`` takes the lowest id, ``lowest`` the lowest energy. ``seeds`` (id,
    seed_order) are chosen beforehand instead. ``use_gap`` breaks distance ties by the
    largest order gap, then the lowest order value.
    """
    rows = prepared(df, id, feat, energy, group).where(~has_nan("_x"))
    count = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    whole = None
    if seeds is None and not iterative and not use_gap:
        few = count.where(F.col("_n") <= k)
        pos = ordered_scan(rows.join(few, "_g", "left_semi").select("_g", "_id"), ["_id"], group=["_g"], position="_n")
        whole = pos.select("_g", F.col("_id"), "_n")
        rows = rows.join(few, "_g", "left_anti")
    rows = settle(rows.withColumn("_chunk", F.pmod(F.xxhash64("_id"), F.lit(1 << 20))))
    count = settle(rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")))
    chunk = F.pmod(F.col("_chunk"), F.ceil(F.col("_n") / CHUNK).cast("long"))
    state = (rows.join(count, "_g").withColumn("_chunk", chunk)
             .select("_g", "_id", "_e", "_x", "_chunk", F.lit(float("inf")).alias("_d"), F.lit(float("inf")).alias("_gap")))
    if seeds is not None:
        s = seeds.select(F.col(id).cast("long").alias("_id"), F.col("seed_order").alias("_so"))
        w = Window.partitionBy("_g").orderBy("_so")
        picks = (rows.join(s, "_id").withColumn("_n", (F.row_number().over(w) - 1).cast("long"))
                 .where(F.col("_n") < k).select("_g", "_id", "_e", "_x", "_n"))
    elif start == "random":
        @F.pandas_udf("long")
        def draw(n: pd.Series) -> pd.Series:
            return n.map(lambda v: int(np.random.default_rng(seed).integers(0, int(v))))

        at = count.select("_g", draw("_n").alias("_p"))
        pos = ordered_scan(rows.select("_g", "_id"), ["_id"], group=["_g"], position="_p")
        chosen = pos.join(at, ["_g", "_p"]).select("_id")
        picks = rows.join(chosen, "_id").select("_g", "_id", "_e", "_x", F.lit(0).cast("long").alias("_n"))
    else:
        rank = F.struct("_e", "_id") if start == "lowest" else F.struct("_id")
        picks = rows.groupBy("_g").agg(F.min_by(F.struct("_id", "_e", "_x"), rank).alias("m")).select(
            "_g", "m._id", "m._e", "m._x", F.lit(0).cast("long").alias("_n"))
    picks = settle(picks)
    chosen = picks.select("_g", "_id", "_n")
    order = [F.col("_d").desc()] + ([F.col("_gap").desc(), F.col("_e")] if use_gap else []) + [F.col("_id")]
    top = Window.partitionBy("_g").orderBy(*order)
    fresh = picks
    while True:
        spread = state.select("_g", "_chunk").distinct().join(fresh, "_g").select(
            *[F.col(c).alias(c) for c in ("_g", "_chunk", "_id", "_e", "_x", "_n")])
        state = settle(state.groupBy("_g", "_chunk").cogroup(spread.groupBy("_g", "_chunk")).applyInPandas(_shrink, STATE))
        done = chosen.groupBy("_g").agg(F.count(F.lit(1)).alias("_done"))
        best = (state.join(done.where(F.col("_done") < k), "_g")
                .withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= pool))
        fresh = settle(best.groupBy("_g").applyInPandas(
            lambda p: _choose(p, k, pool, use_gap), "_g string, _id long, _e double, _x array<double>, _n long"))
        if fresh.isEmpty():
            break
        chosen = settle(chosen.unionByName(fresh.select("_g", "_id", "_n")))
    if whole is not None:
        chosen = chosen.unionByName(whole)
    return chosen.select("_g", F.col("_id").alias(id), F.col("_n").alias("pick"))


def in_rounds(picks: DataFrame, round_size: int | None, n_seed: int = 1, rounds: int | None = None) -> DataFrame:
    """Number the rounds: the start (or seed) picks belong to round 0, the others fill rounds in order."""
    rel = F.col("pick") - F.lit(n_seed)
    no = F.lit(1) if round_size is None else F.floor(rel / F.lit(max(1, round_size))) + 1
    out = picks.withColumn("round", F.when(rel < 0, F.lit(0)).otherwise(no).cast("int"))
    return out if rounds is None else out.where(F.col("round") <= max(1, rounds))
