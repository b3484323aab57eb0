"""First-come diversity filters as a parallel greedy independent set.

The sequential rule "walk the rows in order, keep a row unless a kept row is too close"
has one answer: a row is kept exactly when no earlier kept row conflicts with it. It is
computed here in order-prefix batches. A batch is decided from its own conflict edges,
then every later row that conflicts with a newly kept row is removed before the next
batch is cut. Batches are cut so that no grid cell contributes more than ``block`` rows,
hence a dense cluster loses all but its kept rows early and its pairs are never listed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from sievelark.operators.tiles import BLOCK, FEW, Tiles, first_partner, has_nan, near_pairs, plan_grid, prepared
from sievelark.session import settle

EDGES_PER_GROUP = 200_000


def _later_dropped(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sequential rule on the conflict edges of some whole groups (a bounded number of edges)."""
    dropped: set[int] = set()
    pdf = pdf.sort_values(["_ea", "_a"], kind="stable")
    for a, b in zip(pdf["_a"].tolist(), pdf["_b"].tolist()):
        if a not in dropped:
            dropped.add(b)
    return pd.DataFrame({"_id": list(dropped)}, dtype="int64")


def dropped_by_edges(edges: DataFrame, bound: int = EDGES_PER_GROUP) -> DataFrame:
    """Ids dropped by the greedy rule, given conflict edges ``_a`` (earlier) to ``_b``.

    Groups of few edges are solved many to a task; larger groups in rounds over the cluster.
    """
    edges = settle(edges)
    sizes = settle(edges.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")))
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    big = settle(sizes.where(F.col("_n") > bound).select("_g"))
    tasks = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * -(-total // EDGES_PER_GROUP))
    solve = lambda e: e.groupBy(F.pmod(F.xxhash64("_g"), F.lit(tasks)).alias("_k")).applyInPandas(_later_dropped, "_id long")
    if big.isEmpty():
        return solve(edges)
    out = solve(edges.join(big, "_g", "left_anti"))
    live = settle(edges.join(big, "_g", "left_semi").select("_a", "_b"))
    while not live.isEmpty():
        ends = live.select(F.col("_a").alias("_id"), F.lit(0).alias("in_")).unionByName(
            live.select(F.col("_b").alias("_id"), F.lit(1).alias("in_")))
        heads = ends.groupBy("_id").agg(F.max("in_").alias("in_")).where("in_ = 0").select("_id")
        gone = settle(live.join(heads.select(F.col("_id").alias("_a")), "_a", "left_semi")
                      .select(F.col("_b").alias("_id")).distinct())
        out = out.unionByName(gone)
        live = settle(live.join(gone.select(F.col("_id").alias("_b")), "_b", "left_anti")
                      .join(gone.select(F.col("_id").alias("_a")), "_a", "left_anti").select("_a", "_b"))
    return out


def _prefix_cut(rows: DataFrame, grid, block: int) -> DataFrame | None:
    """Per group the order position up to which no cell holds more than ``block`` rows."""
    cell = grid.cell(F.col("_x")) if grid.axes else F.array().cast("array<bigint>")
    full = rows.select("_g", cell.alias("_c"), F.struct("_e", "_id").alias("_o"))
    crowded = settle(full.groupBy("_g", "_c").count().where(F.col("count") > block).select("_g", "_c"))
    if crowded.isEmpty():
        return None
    w = Window.partitionBy("_g", "_c").orderBy("_o")
    nth = (full.join(crowded, ["_g", "_c"], "left_semi")
           .withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= block)
           .groupBy("_g", "_c").agg(F.max("_o").alias("_o")))
    return nth.groupBy("_g").agg(F.min("_o").alias("_cut"))


def _kept_in_groups(pdf: pd.DataFrame, threshold: float, strict: bool, gate, dims: int | None, extra) -> pd.DataFrame:
    """Rows that the greedy rule keeps, of all rows of some whole groups.

    A round takes the first undecided row of every group and drops the rows too close to it, so a row
    is compared with kept rows only.
    """
    pdf = pdf.sort_values("_g", kind="stable").reset_index(drop=True)
    again = pdf.duplicated(["_g", "_id"], keep=False)
    if again.any():
        # rows of one id stand or fall together: such groups are decided from all their pairs
        odd = pdf["_g"].isin(set(pdf["_g"][again]))
        by_pairs = _kept_by_pairs(pdf[odd], threshold, strict, gate, dims, extra)
        return by_pairs if odd.all() else pd.concat([by_pairs, _kept_in_groups(pdf[~odd], threshold, strict, gate, dims, extra)])
    t = Tiles(pdf, pdf)
    fold = gate is None and (threshold > 0 or not strict)
    kept = np.zeros(len(pdf), bool)
    left = np.lexsort((t.lid, t.le, t.cl))
    step = max(1, t.WORK // max(1, t.dim))

    def close(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        d = t.distance(i, j, dims)
        ok = (d < threshold) if strict else (d <= threshold)
        if gate is not None:
            ok &= gate(t.le[i], t.re[j])
        if extra is not None:
            ok[ok] = extra(t.X[i[ok], dims:], t.Y[j[ok], dims:])
        return ok | (t.X[i] == t.Y[j]).all(1) if fold else ok

    while len(left):
        head = np.r_[True, t.cl[left][1:] != t.cl[left][:-1]]
        kept[left[head]] = True
        first, left = left[head][np.cumsum(head) - 1][~head], left[~head]
        parts = [close(first[k:k + step], left[k:k + step]) for k in range(0, len(left), step)]
        left = left[~np.concatenate(parts)] if parts else left
    return pdf.loc[kept, ["_g", "_id", "_e", "_x"]]


def _kept_by_pairs(pdf: pd.DataFrame, threshold: float, strict: bool, gate, dims: int | None, extra) -> pd.DataFrame:
    """Like :func:`_kept_in_groups`, for groups in which ids repeat."""
    pdf = pdf.sort_values(["_g", "_e", "_id"], kind="stable").reset_index(drop=True)
    if gate is None and (threshold > 0 or not strict):
        # -0.0 equals 0.0
        pdf = pdf[~pd.DataFrame({"g": pdf["_g"], "x": [tuple(v) for v in pdf["_x"]]}).duplicated().to_numpy()].reset_index(drop=True)
    t = Tiles(pdf, pdf)
    i, j, _ = t.close(threshold, strict, gate, dims, extra)
    m = t.earlier(i, j)
    a, b = i[m], j[m]
    by = np.lexsort((t.lid[a], t.le[a]))
    unit = pd.MultiIndex.from_arrays([t.cl, t.lid]).factorize()[0]
    dropped = np.zeros(len(unit), bool)
    for u, v in zip(unit[a[by]].tolist(), unit[b[by]].tolist()):
        if not dropped[u]:
            dropped[v] = True
    return pdf.loc[~dropped[unit], ["_g", "_id", "_e", "_x"]]


def _keep_groups(rows: DataFrame, total: int, threshold: float, strict: bool, gate, dims: int | None, extra, block: int) -> DataFrame:
    """The greedy rule over small groups, many to a task; their rows are shuffled once."""
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // (8 * block)))
    keyed = rows.select(F.pmod(F.xxhash64("_g"), F.lit(tasks)).alias("_k"), "_g", F.lit(0).cast("long").alias("_h"), "_id", "_e", "_x")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _kept_in_groups(pdf, threshold, strict, gate, dims, extra)

    return keyed.groupBy("_k").applyInPandas(run, "_g string, _id long, _e double, _x array<double>")


def keep_first(rows: DataFrame, threshold: float, *, strict: bool = True, gate=None, block: int = BLOCK,
               dims: int | None = None, extra=None) -> DataFrame:
    """Kept rows (``_g, _id, _e, _x``) of the greedy rule over prepared rows.

    ``dims`` and ``extra`` add a second condition on the trailing features of a pair. Groups of up
    to ``FEW`` rows are decided whole in one pass, larger ones batch by batch.
    """
    rows = rows.where(~has_nan("_x"))
    sizes = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), F.count("_id").alias("_m"))
    whole = (F.col("_n") <= min(FEW, block)) & (F.col("_n") == F.col("_m"))
    total, large = sizes.agg(F.sum("_n"), F.sum(F.when(~whole, F.col("_n")))).first()
    if not large:
        return _keep_groups(rows, total or 0, threshold, strict, gate, dims, extra, block)
    small = None
    if large < total:
        rows, big = settle(rows), settle(sizes.where(~whole).select("_g"))
        small = _keep_groups(rows.join(big, "_g", "left_anti"), total - large, threshold, strict, gate, dims, extra, block)
        rows = rows.join(big, "_g", "left_semi")
    kept = _keep_in_batches(rows.select("_g", "_id", "_e", "_x"), threshold, strict, gate, block, dims, extra)
    return kept if small is None else kept.unionByName(small)


def _keep_in_batches(rows: DataFrame, threshold: float, strict: bool, gate, block: int, dims: int | None, extra) -> DataFrame:
    """The greedy rule over groups of any size."""
    copies = ["_g", "_x"] if gate is None else ["_g", "_x", "_e"]
    if threshold > 0 or not strict:
        first = rows.groupBy(*copies).agg(F.min(F.struct("_e", "_id")).alias("_m"))
        if gate is None:
            rows = first.select("_g", F.col("_m._id").alias("_id"), F.col("_m._e").alias("_e"), "_x")
    rows = settle(rows)
    grid = plan_grid(rows, threshold, block, dims=dims)
    kept = None
    while True:
        cut = _prefix_cut(rows, grid, block)
        if cut is None:
            batch, rest = rows, None
        else:
            marked = settle(rows.join(cut, "_g", "left").withColumn(
                "_now", F.col("_cut").isNull() | (F.struct("_e", "_id") <= F.col("_cut"))))
            batch = marked.where("_now").select("_g", "_id", "_e", "_x")
            rest = marked.where("not _now").select("_g", "_id", "_e", "_x")
        edges = near_pairs(batch, threshold, strict=strict, gate=gate, grid=grid, block=block, dims=dims, extra=extra)
        new = settle(batch.join(dropped_by_edges(edges), "_id", "left_anti").select("_g", "_id", "_e", "_x"))
        kept = new if kept is None else kept.unionByName(new)
        if rest is None:
            return kept
        hit = first_partner(rest, new, threshold, strict=strict, gate=gate, block=block, dims=dims, extra=extra).select("_id")
        rows = settle(rest.join(hit, "_id", "left_anti"))
        if rows.isEmpty():
            return kept


def _nan_rule(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A row with an undefined feature never passes the distance test, unless it comes first;
    then nothing after it can pass. Returns (ids kept alone, rows still to decide)."""
    head = rows.groupBy("_g").agg(F.min_by(F.struct("_id", has_nan("_x").alias("bad")), F.struct("_e", "_id")).alias("_h"))
    alone = head.where("_h.bad").select("_g", F.col("_h._id").alias("_id"))
    rest = rows.where(~has_nan("_x")).join(alone, "_g", "left_anti")
    return alone.select("_id"), rest


def diversity_ids(df: DataFrame, *, id: str, feat, threshold: float, order: str | Column | None = None, group=None,
                  min_gap: float | None = None, block: int = BLOCK) -> DataFrame:
    """Ids kept when a row must be at least ``threshold`` away from every kept row.

    ``min_gap`` also keeps a close row whose order value differs by at least the gap from
    every kept row it is close to.
    """
    rows = prepared(df, id, feat, order, group)
    gate = None if not min_gap or min_gap <= 0 else (lambda a, b: ~(abs(a - b) >= min_gap))
    alone, rest = _nan_rule(rows)
    kept = keep_first(rest, threshold, strict=True, gate=gate, block=block)
    return kept.select("_id").unionByName(alone).withColumnRenamed("_id", id)


def diversity_filter(df: DataFrame, *, id: str, **kw) -> DataFrame:
    return df.join(diversity_ids(df, id=id, **kw), id, "left_semi")


def _first_fit_tile(t: Tiles, threshold: float, gate) -> pd.DataFrame:
    """``_id, _eb, _rep`` of all rows of some whole groups: the sequential rule, then the earliest kept row in reach."""
    i, j, _ = t.close(threshold, False, gate)
    # rows of one id in a group stand or fall together
    unit = pd.MultiIndex.from_arrays([t.cl, t.lid]).factorize()[0]
    before = t.earlier(i, j)
    a, b = i[before], j[before]
    by = np.lexsort((t.lid[a], t.le[a]))
    dropped = np.zeros(len(unit), bool)
    for u, v in zip(unit[a[by]].tolist(), unit[b[by]].tolist()):
        if not dropped[u]:
            dropped[v] = True
    near = ~dropped[unit[j]]
    i, j = i[near], j[near]
    by = np.lexsort((t.rid[j], t.re[j], i))
    i, j = i[by], j[by]
    head = np.r_[True, i[1:] != i[:-1]] if len(i) else np.empty(0, dtype=bool)
    hit = pd.DataFrame({"_eb": t.re[j[head]], "_rep": pd.array(t.rid[j[head]], "Int64")}, index=i[head]).reindex(np.arange(len(unit)))
    return pd.DataFrame({"_id": t.lid, "_eb": hit["_eb"], "_rep": hit["_rep"]})


def _first_fit_groups(rows: DataFrame, total: int, threshold: float, gate, block: int) -> DataFrame:
    """First fit of small groups, many to a task; their rows are shuffled once."""
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // block))
    key = F.pmod(F.xxhash64("_g"), F.lit(tasks)).alias("_k")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _first_fit_tile(Tiles(pdf, pdf), threshold, gate)

    known = rows.where(~has_nan("_x")).select(key, "_g", F.lit(0).cast("long").alias("_h"), "_id", "_e", "_x")
    hits = known.groupBy("_k").applyInPandas(run, "_id long, _eb double, _rep long")
    others = rows.where(F.coalesce(has_nan("_x"), F.lit(True))).select("_id", F.lit(None).cast("double").alias("_eb"), F.lit(None).cast("long").alias("_rep"))
    hit = F.when(F.col("_rep").isNotNull(), F.struct("_eb", "_rep"))
    best = hits.unionByName(others).select("_id", F.min(hit).over(Window.partitionBy("_id")).alias("_m"))
    return best.select("_id", F.coalesce("_m._rep", "_id").alias("_rep"))


def first_fit(df: DataFrame, *, id: str, feat, threshold: float, order=None, group=None, gate=None,
              block: int = BLOCK, metric=None) -> DataFrame:
    """First-fit clustering: every row joins the earliest representative within the threshold.

    Returns ``id, rep_id``; rows with undefined features represent themselves. ``metric`` (a
    :class:`~sievelark.operators.metric.Metric`) replaces feature L2. Where all groups have up to
    ``FEW`` rows, a group is solved whole in one pass, with the same result.
    """
    rows = settle(prepared(df, id, feat, order, group))
    if metric is None and threshold >= 0:
        sizes = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), F.count("_id").alias("_m"))
        total, most, named = sizes.agg(F.sum("_n"), F.max("_n"), F.sum("_m")).first()
        if total and most <= min(FEW, block) and named == total:
            return _first_fit_groups(rows, total, threshold, gate, block).select(F.col("_id").alias(id), F.col("_rep").alias("rep_id"))
    by = {} if metric is None else {"dims": metric.lead, "extra": metric.within(threshold)}
    reps = settle(keep_first(rows, threshold, strict=False, gate=gate, block=block, **by))
    hit = first_partner(rows, reps, threshold, strict=False, gate=gate, block=block, **by)
    return (rows.select("_id").join(hit, "_id", "left")
            .select(F.col("_id").alias(id), F.coalesce("_rep", "_id").alias("rep_id")))
