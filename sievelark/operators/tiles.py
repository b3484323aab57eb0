"""Exact distance joins over feature arrays, cut into bounded tiles.

Rows are blocked by group and by a grid on a few feature axes (dropping axes never
lengthens a distance, so rows within the threshold always meet in neighbouring cells).
Every cell is further split into chunks of at most about ``block`` rows on either side;
a task sees one chunk pair, whatever share of the table a group or a cell holds.
Kernels emit only what the caller needs: matching pairs, a spanning forest of the
threshold graph, the first matching partner, or the k nearest rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sievelark.functions.exprs import as_double, col, nan_last
from sievelark.session import settle

BLOCK = 4096
#: Groups of up to so many rows on both sides together meet as one tile, without a grid.
FEW = 512


def prepared(df: DataFrame, id: str, feat: str | Column, order: str | Column | None = None,
             group: list[str] | str | None = None) -> DataFrame:
    """Project to the columns the tile join works on: ``_g, _id, _e, _x``.

    Rows of unequal feature length never match, so the length is part of the group.
    """
    group = [group] if isinstance(group, str) else (group or [])
    x = as_double(feat)
    key = F.concat_ws("\u0001", *[F.coalesce(col(g).cast("string"), F.lit("\u0000")) for g in group],
                      F.size(x).cast("string"))
    e = F.lit(0.0) if order is None else nan_last(order)
    return df.select(key.alias("_g"), col(id).cast("long").alias("_id"), e.alias("_e"), x.alias("_x"))


def has_nan(x: Column | str) -> Column:
    return F.exists(col(x), lambda v: v.isNull() | F.isnan(v))


@dataclass
class Grid:
    axes: list[int]
    width: float
    rows: int = 0

    def cell(self, x: Column) -> Column:
        return F.array(*[F.coalesce(F.floor(F.get(x, F.lit(a)) / self.width).cast("long"), F.lit(0)) for a in self.axes])

    def neighbours(self, cell: Column) -> Column:
        def grow(out: Column, at: Column) -> Column:
            around = F.array(*[at + F.lit(o) for o in (-1, 0, 1)])
            return F.flatten(F.transform(out, lambda p: F.transform(around, lambda v: F.concat(p, F.array(v)))))

        out = F.array(F.array().cast("array<bigint>"))
        for k in range(len(self.axes)):
            out = grow(out, cell[k])
        return out


def plan_grid(df: DataFrame, threshold: float, block: int = BLOCK, n_axes: int = 2, dims: int | None = None) -> Grid:
    """Pick the widest feature axes (among the first ``dims``) and a cell width of at least the threshold."""
    head, rows = df.select(F.max(F.size("_x")), F.count(F.lit(1))).first()
    head = min(head or 0, dims) if dims else head
    if not head or head <= 0:
        return Grid([], 1.0, rows)
    aggs = []
    for i in range(head):
        v = F.get(F.col("_x"), F.lit(i))
        aggs += [F.max(v).alias(f"hi{i}"), F.min(v).alias(f"lo{i}")]
    row = df.where(~has_nan("_x")).agg(*aggs).first()
    spans = sorted(((float((row[f"hi{i}"] or 0.0) - (row[f"lo{i}"] or 0.0)), -i) for i in range(head)), reverse=True)
    width = max(float(threshold) * (1.0 + 1e-9), 1e-12)
    axes = [-i for span, i in spans[:n_axes] if span > width]
    if not axes:
        return Grid([], 1.0, rows)
    per_axis = max(1.0, (rows / max(1.0, block / 4.0)) ** (1.0 / len(axes)))
    return Grid(axes, max(width, spans[0][0] / per_axis), rows)


def _padded(x: pd.Series, dim: int) -> np.ndarray:
    """Feature rows as one matrix, shorter ones filled with zeros."""
    out = np.zeros((len(x), dim))
    if len(x) and dim:
        n = np.fromiter(map(len, x), np.int64, len(x))
        out[np.arange(dim) < n[:, None]] = np.concatenate(x.to_numpy())
    return out


def _matrix(col_: pd.Series) -> np.ndarray:
    return np.array(col_.tolist(), dtype=float) if len(col_) else np.empty((0, 0))


class Tiles:
    """The rows of one task: several small tiles, or one chunk pair of a large cell."""

    WORK = 4_000_000  # numbers per vectorised step
    LARGE = 20_000  # pairs from which a tile is first screened by a matrix product

    def __init__(self, l: pd.DataFrame, r: pd.DataFrame):
        # a tile is named by its group and its cell; group codes keep different groups apart
        both = pd.concat([l[["_g", "_h"]], r[["_g", "_h"]]])
        code = pd.MultiIndex.from_frame(both).factorize()[0]
        cl, cr = code[:len(l)], code[len(l):]
        ol, orr = np.argsort(cl, kind="stable"), np.argsort(cr, kind="stable")
        self.l, self.r = l.iloc[ol].reset_index(drop=True), r.iloc[orr].reset_index(drop=True)
        self.cl, cr = cl[ol], cr[orr]
        n = int(code.max()) + 1 if len(code) else 0
        self.nr = np.bincount(cr, minlength=n)
        self.r0 = np.concatenate([[0], np.cumsum(self.nr)])[:-1] if n else np.empty(0, dtype=int)
        self.dim = max((max(map(len, x), default=0) for x in (self.l["_x"], self.r["_x"])), default=0)
        self.X, self.Y = _padded(self.l.pop("_x"), self.dim), _padded(self.r.pop("_x"), self.dim)
        self.lid, self.rid = self.l["_id"].to_numpy(), self.r["_id"].to_numpy()
        self.le, self.re = self.l["_e"].to_numpy(), self.r["_e"].to_numpy()

    def steps(self):
        """Index arrays (i, j) over all pairs of equal tiles; a step holds whole left rows."""
        width = self.nr[self.cl] if len(self.cl) else np.empty(0, dtype=int)
        limit = max(1, self.WORK // max(1, self.dim))
        s = 0
        ends = np.cumsum(width)
        while s < len(width):
            base = ends[s - 1] if s else 0
            e = max(s + 1, int(np.searchsorted(ends, base + limit, side="right")))
            w = width[s:e]
            i = np.repeat(np.arange(s, e), w)
            j = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w) + np.repeat(self.r0[self.cl[s:e]], w)
            if len(i):
                yield i, j
            s = e

    def distance(self, i, j, dims: int | None = None) -> np.ndarray:
        return np.sqrt(((self.X[i, :dims] - self.Y[j, :dims]) ** 2).sum(1))

    def earlier(self, i, j) -> np.ndarray:
        """Left row before right row in (order, id)."""
        return (self.le[i] < self.re[j]) | ((self.le[i] == self.re[j]) & (self.lid[i] < self.rid[j]))

    def close(self, threshold: float, strict: bool, gate, dims: int | None = None, extra=None):
        """Pairs within the threshold as (i, j, d).

        With ``dims`` the distance covers the leading numbers only and ``extra`` judges the
        pairs by the others.
        """
        A, B = self.X[:, :dims], self.Y[:, :dims]
        xx, yy = (A * A).sum(1), (B * B).sum(1)
        out = []
        for i, j in self.steps():
            # small tiles are judged at once, a product for each of them would cost more
            if len(i) > self.LARGE and len(i) > FEW * len(np.unique(self.cl[i])):
                approx = xx[i] + yy[j]
                rows = np.unique(i)
                at = 0
                for c in np.unique(self.cl[rows]):
                    a = rows[np.searchsorted(self.cl[rows], c):np.searchsorted(self.cl[rows], c, side="right")]
                    b = slice(self.r0[c], self.r0[c] + self.nr[c])
                    prod = (A[a] @ B[b].T).ravel()
                    approx[at:at + len(prod)] -= 2.0 * prod
                    at += len(prod)
                m = approx <= threshold * threshold + 1e-9 * (xx[i] + yy[j]) + 1e-12
                i, j = i[m], j[m]
            d = self.distance(i, j, dims)
            ok = (d < threshold) if strict else (d <= threshold)
            if gate is not None:
                ok &= gate(self.le[i], self.re[j])
            if extra is not None:
                ok[ok] = extra(self.X[i[ok], dims:], self.Y[j[ok], dims:])
            out.append((i[ok], j[ok], d[ok]))
        if not out:
            z = np.empty(0, dtype=int)
            return z, z, np.empty(0)
        return tuple(np.concatenate(v) for v in zip(*out))

    def frame(self, i, j, d) -> pd.DataFrame:
        return pd.DataFrame({"_g": self.l["_g"].to_numpy()[i], "_ea": self.le[i], "_a": self.lid[i],
                             "_eb": self.re[j], "_b": self.rid[j], "_d": d})


PAIR_SCHEMA = "_g string, _ea double, _a long, _eb double, _b long, _d double"


def spanning_edges(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mask of the edges that join two parts not yet connected."""
    parent: dict = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    keep = np.zeros(len(a), dtype=bool)
    for n, (u, v) in enumerate(zip(a.tolist(), b.tolist())):
        ru, rv = root(u), root(v)
        if ru != rv:
            parent[rv] = ru
            keep[n] = True
    return keep


def tile_join(left: DataFrame, right: DataFrame, grid: Grid | None, kernel: Callable, schema: str,
              block: int = BLOCK) -> DataFrame:
    """Bring every left chunk together with every right chunk of its neighbourhood.

    Groups of up to ``FEW`` rows (and ``block``) are one tile each, many to a task: their rows are
    shuffled once and not copied to neighbouring cells.
    """
    fresh = lambda df: df.where(~has_nan("_x")).select(*[F.col(c).alias(c) for c in ("_g", "_id", "_e", "_x")])
    left, right = fresh(left), fresh(right)
    few = min(FEW, block)
    sizes = left.select("_g").unionByName(right.select("_g")).groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    total, large = sizes.agg(F.sum("_n"), F.sum(F.when(F.col("_n") > few, F.col("_n")))).first()
    if not large:
        return _whole_groups(left, right, kernel, schema, block, total or 0)
    if large == total:
        return _tiled(left, right, grid, kernel, schema, block)
    big = settle(sizes.where(F.col("_n") > few).select("_g"))
    of = lambda df, how: df.join(big, "_g", how).select("_g", "_id", "_e", "_x")
    small = _whole_groups(of(left, "left_anti"), of(right, "left_anti"), kernel, schema, block, total - large)
    return small.unionByName(_tiled(of(left, "left_semi"), of(right, "left_semi"), grid, kernel, schema, block))


def _whole_groups(left: DataFrame, right: DataFrame, kernel: Callable, schema: str, block: int, rows: int) -> DataFrame:
    """Every left row of a small group with every right row of it, many groups to a task."""
    buckets = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // block))
    key = F.pmod(F.xxhash64("_g"), F.lit(buckets)).alias("_k")
    cols = [key, "_g", F.lit(0).cast("long").alias("_h"), "_id", "_e", "_x"]

    def run(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        return kernel(Tiles(l, r))

    return left.select(*cols).groupBy("_k").cogroup(right.select(*cols).groupBy("_k")).applyInPandas(run, schema)


def _tiled(left: DataFrame, right: DataFrame, grid: Grid | None, kernel: Callable, schema: str, block: int) -> DataFrame:
    empty = F.array().cast("array<bigint>")
    rows = grid.rows if grid is not None else left.count()
    if grid is None or not grid.axes:
        L, R = left.withColumn("_c", empty), right.withColumn("_c", empty)
    else:
        L = left.withColumn("_c", grid.cell(F.col("_x")))
        R = right.withColumn("_c", F.explode(grid.neighbours(grid.cell(F.col("_x")))))
    chunks = lambda n: F.ceil(F.col(n) / F.lit(float(block))).cast("int")
    nl = L.groupBy("_g", "_c").agg(F.count(F.lit(1)).alias("_nl"))
    nr = R.groupBy("_g", "_c").agg(F.count(F.lit(1)).alias("_nr"))
    size = nl.join(nr, ["_g", "_c"]).select("_g", "_c", chunks("_nl").alias("_nl"), chunks("_nr").alias("_nr"))
    buckets = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // block))
    mine = lambda n: F.pmod(F.xxhash64("_id"), F.col(n).cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # cells of one chunk share a task by bucket; further chunks of a large cell get their own
    cols = [F.pmod(F.xxhash64("_g", "_c"), F.lit(buckets)).alias("_k"), "_g", F.xxhash64("_c").alias("_h"), "_id", "_e", "_x"]
    Lt = L.join(size, ["_g", "_c"]).select(*cols, mine("_nl").alias("_i"), every("_nr").alias("_j"))
    Rt = R.join(size, ["_g", "_c"]).select(*cols, every("_nl").alias("_i"), mine("_nr").alias("_j"))
    key = ["_k", "_i", "_j"]

    def run(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        return kernel(Tiles(l, r))

    return Lt.groupBy(*key).cogroup(Rt.groupBy(*key)).applyInPandas(run, schema)


def near_pairs(df: DataFrame, threshold: float, *, strict=False, gate=None, grid: Grid | None = None,
               block: int = BLOCK, forest: bool = False, dims: int | None = None, extra=None) -> DataFrame:
    """Pairs of one table within the threshold, the earlier row (order, id) first.

    With ``forest=True`` each tile returns a spanning forest of its pairs: enough for
    connectivity, linear in the rows of the tile.
    """
    grid = grid or plan_grid(df, threshold, block, dims=dims)

    def kernel(t: Tiles):
        i, j, d = t.close(threshold, strict, gate, dims, extra)
        m = t.earlier(i, j)
        i, j, d = i[m], j[m], d[m]
        if forest:
            k = spanning_edges(t.lid[i], t.rid[j])
            i, j, d = i[k], j[k], d[k]
        return t.frame(i, j, d)

    return tile_join(df, df, grid, kernel, PAIR_SCHEMA, block)


def cross_pairs(left: DataFrame, right: DataFrame, threshold: float, *, strict=False, gate=None,
                block: int = BLOCK) -> DataFrame:
    """Pairs between two tables within the threshold."""
    grid = plan_grid(right, threshold, block)

    def kernel(t: Tiles):
        return t.frame(*t.close(threshold, strict, gate))

    return tile_join(left, right, grid, kernel, PAIR_SCHEMA, block)


def first_partner(left: DataFrame, right: DataFrame, threshold: float, *, strict=False, gate=None,
                  block: int = BLOCK, dims: int | None = None, extra=None) -> DataFrame:
    """For each left row its earliest right row within the threshold: ``_id, _rep, _d``."""
    grid = plan_grid(right, threshold, block, dims=dims)

    def kernel(t: Tiles):
        i, j, d = t.close(threshold, strict, gate, dims, extra)
        order = np.lexsort((t.rid[j], t.re[j], i))
        i, j, d = i[order], j[order], d[order]
        head = np.r_[True, i[1:] != i[:-1]] if len(i) else np.empty(0, dtype=bool)
        return t.frame(i[head], j[head], d[head])

    hits = tile_join(left, right, grid, kernel, PAIR_SCHEMA, block)
    best = hits.groupBy("_a").agg(F.min(F.struct("_eb", "_b", "_d")).alias("m"))
    return best.select(F.col("_a").alias("_id"), F.col("m._b").alias("_rep"), F.col("m._d").alias("_d"))


def k_nearest(left: DataFrame, right: DataFrame, k: int, *, skip_self: bool = True, earlier_only: bool = False,
              block: int = BLOCK) -> DataFrame:
    """The k nearest right rows of every left row, ranked by (distance, id)."""
    from pyspark.sql import Window

    def kernel(t: Tiles):
        out = []
        for i, j in t.steps():
            m = np.ones(len(i), dtype=bool)
            if skip_self:
                m &= t.lid[i] != t.rid[j]
            if earlier_only:
                m &= (t.re[j] < t.le[i]) | ((t.re[j] == t.le[i]) & (t.rid[j] < t.lid[i]))
            i, j = i[m], j[m]
            d = t.distance(i, j)
            order = np.lexsort((t.rid[j], d, i))
            i, j, d = i[order], j[order], d[order]
            start = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.empty(0, dtype=int)
            rank = np.arange(len(i)) - np.repeat(start, np.diff(np.r_[start, len(i)]))
            top = rank < k
            out.append(pd.DataFrame({"_a": t.lid[i[top]], "_b": t.rid[j[top]], "_d": d[top]}))
        return pd.concat(out) if out else pd.DataFrame({"_a": [], "_b": [], "_d": []})

    hits = tile_join(left, right, None, kernel, "_a long, _b long, _d double", block)
    w = Window.partitionBy("_a").orderBy("_d", "_b")
    return hits.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k)
