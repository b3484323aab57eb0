"""Linear algebra and statistics built from mergeable sums."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from sievelark.functions.exprs import as_double, col, finite
from sievelark.operators.tiles import has_nan


# --- covariance and PCA ----------------------------------------------------

def _width(df: DataFrame, feat) -> int:
    return int(df.select(F.max(F.size(as_double(feat)))).first()[0] or 0)


def covariance(df: DataFrame, feat) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, mean vector and scatter matrix of a feature column (d x d, whatever the row count)."""
    x = df.select(as_double(feat).alias("x")).where(~has_nan("x"))
    d = _width(df, feat)
    row = x.agg(F.count(F.lit(1)), *[F.avg(F.get(F.col("x"), F.lit(i))) for i in range(d)]).first()
    mean = np.array([v or 0.0 for v in row[1:]], dtype=float)
    upper = np.triu_indices(d)

    def partial(batches):
        total = np.zeros((d, d))
        for b in batches:
            if len(b):
                m = np.array(b["x"].tolist(), dtype=float) - mean
                total += m.T @ m
        yield pd.DataFrame({"s": [total[upper].tolist()]})

    sums = (x.mapInPandas(partial, "s array<double>").select(F.posexplode("s").alias("p", "v"))
            .groupBy("p").agg(F.sum("v").alias("v")))
    scatter = np.zeros((d, d))
    flat = np.zeros(len(upper[0]))
    for r in sums.collect():
        flat[r["p"]] = r["v"]
    scatter[upper] = flat
    return int(row[0]), mean, scatter + np.triu(scatter, 1).T


@dataclass
class PcaModel:
    mean: np.ndarray
    components: np.ndarray
    variance: np.ndarray

    @property
    def ratio(self) -> np.ndarray:
        total = self.variance.sum()
        return self.variance / total if total > 0 else np.zeros_like(self.variance)


def pca_fit(df: DataFrame, feat, *, n_components: int | None = None, variance: float | None = None) -> PcaModel:
    """Principal axes, either a fixed number or as many as reach the variance share."""
    _, mean, scatter = covariance(df, feat)
    val, vec = np.linalg.eigh(scatter)
    val, vec = np.clip(val[::-1], 0.0, None), vec[:, ::-1].T
    sign = np.sign(vec[np.arange(len(vec)), np.abs(vec).argmax(1)])
    vec = vec * np.where(sign == 0, 1.0, sign)[:, None]
    n = len(val) if n_components is None else min(n_components, len(val))
    if variance is not None and val.sum() > 0:
        n = int(np.searchsorted(np.cumsum(val) / val.sum(), variance, side="left") + 1)
    n = max(1, min(n, len(val)))
    return PcaModel(mean, vec[:n], val)


def project(df: DataFrame, feat, model: PcaModel, name: str) -> DataFrame:
    mean, comp = model.mean, model.components

    @F.pandas_udf("array<double>")
    def apply(x: pd.Series) -> pd.Series:
        m = np.array(x.tolist(), dtype=float)
        return pd.Series(list((m - mean) @ comp.T), index=x.index)

    return df.withColumn(name, apply(as_double(feat)))


def grid_bins(df: DataFrame, proj: str, bins: int, *, name: str = "bin", group: list[str] | None = None) -> DataFrame:
    """Cell of each projected row on a per-axis grid between the observed limits."""
    from sievelark.operators.select import attach

    d = _width(df, proj)
    p = [F.get(F.col(proj), F.lit(i)) for i in range(d)]
    lim = df.groupBy(*(group or [])).agg(*[F.min(v).alias(f"_lo{i}") for i, v in enumerate(p)],
                                         *[F.max(v).alias(f"_hi{i}") for i, v in enumerate(p)])
    j = attach(df, lim, group or [])
    cell = []
    for i, v in enumerate(p):
        span = F.greatest(F.col(f"_hi{i}") - F.col(f"_lo{i}"), F.lit(1e-12))
        s = F.greatest(F.lit(0.0), F.least(F.lit(0.999999), (v - F.col(f"_lo{i}")) / span))
        cell.append(F.floor(s * max(1, bins)).cast("int"))
    return j.withColumn(name, F.array(*cell)).drop(*[f"_{e}{i}" for e in ("lo", "hi") for i in range(d)])


# --- k-means ---------------------------------------------------------------

def kmeans_labels(df: DataFrame, *, id: str, feat, k: int, seed: int = 0, n_iter: int = 30) -> DataFrame:
    """Lloyd iterations from rows drawn by position with NumPy's generator; adds ``km_label``.

    Centres (k x d) travel with the tasks; sums per label are ordinary aggregates.
    """
    from sievelark.operators.scan import ordered_scan
    from sievelark.session import settle

    x = settle(ordered_scan(df.select(id, as_double(feat).alias("_x")), [id], position="_pos"))
    n, d = x.count(), _width(x, "_x")
    if k >= n:
        return x.select(id, F.col("_pos").cast("int").alias("km_label"))
    rng = np.random.default_rng(seed)
    init = [int(v) for v in rng.choice(n, size=k, replace=False)]
    rows = {r["_pos"]: r["_x"] for r in x.where(F.col("_pos").isin(init)).collect()}
    centres = np.array([rows[i] for i in init], dtype=float)

    def labelled(c):
        @F.pandas_udf("int")
        def nearest(v: pd.Series) -> pd.Series:
            m = np.array(v.tolist(), dtype=float)
            return pd.Series(((m[:, None, :] - c[None, :, :]) ** 2).sum(2).argmin(1), index=v.index, dtype="int32")

        return x.withColumn("km_label", nearest("_x"))

    last = None
    for _ in range(n_iter):
        lab = labelled(centres.copy())
        s = lab.groupBy("km_label").agg(*[F.avg(F.get(F.col("_x"), F.lit(i))).alias(f"m{i}") for i in range(d)])
        got = {r["km_label"]: np.array(r[1:], dtype=float) for r in s.collect()}
        new = centres.copy()
        for i in range(k):
            if i in got:
                new[i] = got[i]
            else:
                pos = int(rng.integers(0, n))
                new[i] = np.array(x.where(F.col("_pos") == pos).first()["_x"], dtype=float)
        last = lab
        if np.array_equal(new, centres):
            break
        centres = new
    return last.select(id, "km_label")


def kmeans_pick_lowest(df: DataFrame, *, id: str, feat, energy: str, k: int, seed: int = 0) -> DataFrame:
    """The lowest-energy row of each k-means cluster on at most 8 principal components."""
    n_feat = _width(df, feat)
    reduced = project(df, feat, pca_fit(df, feat, n_components=min(8, max(1, n_feat))), "_r")
    lab = kmeans_labels(reduced, id=id, feat="_r", k=k, seed=seed)
    best = df.join(lab, id).groupBy("km_label").agg(F.min_by(id, F.struct(energy, id)).alias(id), F.count(F.lit(1)).alias("n"))
    return best.select(id, "km_label", "n")


def pooled_kmeans_pick(df: DataFrame, *, id: str, feat, energy: str, k: int, seed: int = 0, factor: int = 3,
                       variance: float = 0.95) -> DataFrame:
    """Farthest-point pool of ``factor * k`` rows, reduced by PCA, then one pick per k-means cluster."""
    from sievelark.operators.fps import farthest_points

    if df.count() <= k:
        return df.select(id)
    pool = df.join(farthest_points(df, k * max(1, factor), id=id, feat=feat, seed=seed).select(id), id, "left_semi")
    reduced = project(pool, feat, pca_fit(pool, feat, variance=variance), "_pool")
    return kmeans_pick_lowest(reduced, id=id, feat="_pool", energy=energy, k=k, seed=seed).select(id)


# --- regression, parity, densities ----------------------------------------

def normal_equations(df: DataFrame, xs: list[Column], y: Column) -> np.ndarray:
    """Least-squares coefficients without intercept from one aggregate row."""
    n = len(xs)
    aggs = [F.sum(xs[i] * xs[j]).alias(f"a{i}_{j}") for i in range(n) for j in range(i, n)]
    aggs += [F.sum(xs[i] * y).alias(f"b{i}") for i in range(n)]
    r = df.agg(*aggs).first()
    a = np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)], dtype=float)
    return np.linalg.lstsq(a, np.array([r[f"b{i}"] for i in range(n)], dtype=float), rcond=None)[0]


def parity_metrics(df: DataFrame, truth: str, pred: str, group: list[str] | None = None) -> DataFrame:
    """MAE, RMSE and R2 over rows where both values are finite; R2 is NaN without spread."""
    d = df.where(finite(truth) & finite(pred))
    t, e = F.col(truth), F.col(pred) - F.col(truth)
    # the spread comes from the variance, which merges partial means instead of raw squares
    spread = F.var_pop(t) * F.count(F.lit(1))
    return d.groupBy(*(group or [])).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.when(spread > 1e-10, 1.0 - F.sum(e * e) / spread).otherwise(F.lit(float("nan"))).alias("r2"))


def histogram(df: DataFrame, value: str, bins: int | None = None, group: list[str] | None = None) -> DataFrame:
    """Equal-width counts; the default bin number is ``min(80, max(10, 5 sqrt n))``."""
    from sievelark.operators.select import attach

    d = df.where(finite(value))
    lim = d.groupBy(*(group or [])).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(F.lit(1)).alias("_n"))
    nb = F.lit(bins) if bins else F.least(F.lit(80), F.greatest(F.lit(10), F.floor(5.0 * F.sqrt(F.col("_n"))).cast("int")))
    j = attach(d, lim, group or []).withColumn("_b", nb)
    w = (F.col("_hi") - F.col("_lo")) / F.col("_b")
    idx = F.when(w > 0, F.least(F.floor((F.col(value) - F.col("_lo")) / w), F.col("_b") - 1)).otherwise(0)
    return j.withColumn("bin", idx.cast("int")).groupBy(*(group or []), "bin").agg(F.count(F.lit(1)).alias("n"))


def kernel_density(df: DataFrame, value: str, grid: list[float], group: list[str] | None = None,
                   decimals: int = 6) -> DataFrame:
    """Gaussian density with Scott's bandwidth at the grid points.

    Equal values are counted first, then every (value, grid point) term is one narrow row.
    """
    from sievelark.operators.select import attach

    d = df.where(finite(value))
    s = d.groupBy(*(group or [])).agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp(value).alias("_sd"))
    v = d.groupBy(*(group or []), F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    j = attach(v, s, group or []).withColumn("_h", F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2)))
    j = j.withColumn("at", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    u = (F.col("at") - F.col("_v")) / F.col("_h")
    term = F.col("_c") * F.exp(-0.5 * u * u) / (F.col("_n") * F.col("_h") * float(np.sqrt(2 * np.pi)))
    return j.groupBy(*(group or []), "at").agg(F.sum(term).alias("density"))


def quantiles(df: DataFrame, value: str, at: dict[str, float], group: list[str] | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, read off by position in a distributed sort.

    No group's values are gathered, so one hot group costs no more memory than others.
    """
    from sievelark.operators.scan import ordered_scan
    from sievelark.operators.select import attach

    group = group or []
    d = df.where(finite(value)).select(*group, F.col(value).cast("double").alias("_v"))
    pos = ordered_scan(d, ["_v"], group=group, position="_p")
    n = d.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    j = attach(pos, n, group)
    aggs = []
    for name, q in at.items():
        h = (F.col("_n") - 1) * F.lit(q)
        lo = F.max(F.when(F.col("_p") == F.floor(h), F.col("_v")))
        hi = F.max(F.when(F.col("_p") == F.ceil(h), F.col("_v")))
        aggs.append((lo + (hi - lo) * F.max(h - F.floor(h))).alias(name))
    return j.groupBy(*group).agg(*aggs)


def fence_limits(df: DataFrame, value: str, factor: float = 2.0, group: list[str] | None = None) -> DataFrame:
    """Interquartile fence and the 5-95 % clipping limits (exact, linear interpolation)."""
    a = quantiles(df, value, {"q1": 0.25, "q3": 0.75, "p05": 0.05, "p95": 0.95}, group)
    iqr = F.col("q3") - F.col("q1")
    return a.withColumn("low_fence", F.col("q1") - factor * iqr).withColumn("high_fence", F.col("q3") + factor * iqr)


# --- pair distances --------------------------------------------------------

def pair_distance_sums(rows: DataFrame, *, block: int | None = None, edges: list[float] | None = None) -> DataFrame:
    """Over all pairs of a prepared table: count, sum, min and max per group, or counts per interval.

    Pairs live only inside a tile task; each tile returns one summary row.
    """
    from sievelark.operators.tiles import BLOCK, Tiles, tile_join

    def distances(t: Tiles):
        for i, j in t.steps():
            later = t.rid[j] > t.lid[i]
            i, j = i[later], j[later]
            yield pd.DataFrame({"_g": t.l["_g"].to_numpy()[i], "d": t.distance(i, j)})

    def summary(t: Tiles):
        parts = [p.groupby("_g")["d"].agg(n="count", s="sum", lo="min", hi="max").reset_index() for p in distances(t)]
        return pd.concat(parts) if parts else pd.DataFrame({"_g": [], "n": [], "s": [], "lo": [], "hi": []})

    def counts(t: Tiles):
        parts = []
        for p in distances(t):
            p["bin"] = np.searchsorted(np.array(edges), p["d"].to_numpy(), side="right") - 1
            p = p[(p["bin"] >= 0) & (p["bin"] < len(edges) - 1)]
            parts.append(p.groupby(["_g", "bin"]).size().rename("n").reset_index())
        return pd.concat(parts) if parts else pd.DataFrame({"_g": [], "bin": [], "n": []})

    if edges is None:
        t = tile_join(rows, rows, None, summary, "_g string, n long, s double, lo double, hi double", block or BLOCK)
        return t.groupBy("_g").agg(F.sum("n").alias("n_pairs"), F.sum("s").alias("sum_dist"), F.min("lo").alias("min_dist"),
                                   F.max("hi").alias("max_dist")).where("n_pairs > 0")
    t = tile_join(rows, rows, None, counts, "_g string, bin int, n long", block or BLOCK)
    return t.groupBy("_g", "bin").agg(F.sum("n").alias("n"))
