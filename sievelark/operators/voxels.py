"""Voxel surface detection: occupancy, a flood from the open faces, contacts of atoms with the outside.

Frames of few voxels and atoms are flooded whole, many at once as one array. The grid of a
larger frame is cut into blocks. A task labels the connected empty voxels of one block at a
time; only labels that meet across block borders go on to the component search, so the graph to
solve has a few nodes per block instead of one per voxel, and one large frame uses many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sievelark.functions.exprs import covalent_radius
from sievelark.operators.components import components
from sievelark.session import settle

BLOCK = 16
#: Blocks that one task labels, one after the other.
BLOCKS_PER_TASK = 2_000
AXES = ("x", "y", "z")
#: A frame of up to so many voxels and atoms is flooded whole.
WHOLE_VOXELS, WHOLE_ATOMS = 32_768, 4_096
#: Atoms of whole frames in one task, and voxels in one vectorised step.
ATOMS_PER_TASK, STEP = 40_000, 1_000_000


def _cross(a: Column, b: Column) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _placed(atoms: DataFrame, lattice: DataFrame, spacing: float, axis: int) -> DataFrame:
    """Atoms with cell, grid size ``d*``, fractional coordinates ``f*`` (periodic axes wrapped) and nearest voxel ``c*``."""
    cell = [F.col("_cell")[i] for i in range(3)]
    faces = [_cross(cell[1], cell[2]), _cross(cell[2], cell[0]), _cross(cell[0], cell[1])]
    volume = sum((cell[0][k] * faces[0][k] for k in range(3)), F.lit(0.0))
    j = atoms.join(lattice.select("frame", F.col("cell").cast("array<array<double>>").alias("_cell"), F.col("pbc").alias("_pbc")), "frame")
    at = [F.col(p) for p in ("px", "py", "pz")]
    for i, c in enumerate(AXES):
        length = F.sqrt(cell[i][0] * cell[i][0] + cell[i][1] * cell[i][1] + cell[i][2] * cell[i][2])
        f = sum((at[k] * faces[i][k] for k in range(3)), F.lit(0.0)) / volume
        j = j.withColumn(f"l{c}", length).withColumn(f"d{c}", F.greatest(F.lit(4), F.ceil(length / spacing) + 1).cast("int"))
        j = j.withColumn(f"f{c}", F.when(F.col("_pbc")[i], f - F.floor(f)).otherwise(f))
        j = j.withColumn(f"c{c}", F.least(F.col(f"d{c}") - 1, F.greatest(F.lit(0), F.rint(F.col(f"f{c}") * (F.col(f"d{c}") - 1)).cast("int"))))
    return j.drop("_pbc")


def _reach(placed: DataFrame, spacing: float, scale: float) -> DataFrame:
    """Atoms with radius ``_r`` and the voxels ``lo*`` to ``hi*`` that it may reach along each axis."""
    j = placed.withColumn("_r", F.greatest(F.lit(float(spacing)), scale * covalent_radius("z")))
    for c in AXES:
        n = F.col(f"d{c}") - 1
        half = F.ceil(F.col("_r") / F.col(f"l{c}") * n).cast("int")
        j = j.withColumn(f"lo{c}", F.greatest(F.lit(0), F.col(f"c{c}") - half)).withColumn(f"hi{c}", F.least(n, F.col(f"c{c}") + half))
    return j


def _occupied(placed: DataFrame, spacing: float, scale: float, axis: int) -> DataFrame:
    """``frame, x, y, z`` of the voxels within an atom's radius; differences along the surface wrap."""
    j = _reach(placed, spacing, scale)
    for c in AXES:
        n = F.col(f"d{c}") - 1
        j = j.withColumn(f"v{c}", F.explode(F.sequence(f"lo{c}", f"hi{c}")))
        d = F.col(f"v{c}") / n - F.col(f"f{c}")
        j = j.withColumn(f"_g{c}", d if c == AXES[axis] else d - F.rint(d))
    away = [sum((F.col(f"_g{c}") * F.col("_cell")[i][k] for i, c in enumerate(AXES)), F.lit(0.0)) for k in range(3)]
    near = away[0] * away[0] + away[1] * away[1] + away[2] * away[2] <= F.col("_r") * F.col("_r")
    return j.where(near).select("frame", *[F.col(f"v{c}").alias(c) for c in AXES]).distinct()


def _labels(empty: np.ndarray) -> np.ndarray:
    """Lowest voxel number of every connected empty part (face neighbours), -1 at full voxels."""
    big = empty.size
    lab = np.where(empty, np.arange(big).reshape(empty.shape), big)
    while True:
        new = lab.copy()
        for ax in range(3):
            a, b = (np.take(new, range(s, empty.shape[ax] - 1 + s), ax) for s in (0, 1))
            both = np.where((a < big) & (b < big), np.minimum(a, b), big)
            for s in (0, 1):
                part = [slice(None)] * 3
                part[ax] = slice(s, empty.shape[ax] - 1 + s)
                new[tuple(part)] = np.minimum(new[tuple(part)], both)
        # follow labels to their own labels, so a part is named in few rounds
        flat = new.ravel()
        while True:
            nxt = np.where(flat < big, flat[np.minimum(flat, big - 1)], big)
            if (nxt == flat).all():
                break
            flat = nxt
        new = flat.reshape(empty.shape)
        if (new == lab).all():
            return np.where(new < big, new, -1)
        lab = new


class _Rows:
    """Result rows of many blocks as lists of arrays."""

    def __init__(self) -> None:
        self.parts: list[tuple] = []

    def add(self, frame, kind: int, side: int, at: np.ndarray, part: np.ndarray, atom: np.ndarray | None = None) -> None:
        n = len(part)
        if n:
            self.parts.append((np.full(n, frame), np.full(n, kind), np.full(n, side), at[:, 0], at[:, 1], at[:, 2], part, np.full(n, -1) if atom is None else atom))

    def frame(self) -> pd.DataFrame:
        names = ("frame", "kind", "side", "x", "y", "z", "part", "atom")
        if not self.parts:
            return pd.DataFrame({n: np.zeros(0, np.int64) for n in names})
        return pd.DataFrame({n: np.concatenate(c) for n, c in zip(names, zip(*self.parts))})


def _solve_block(rows: _Rows, frame, block: np.ndarray, dims: np.ndarray, xyz: np.ndarray, kind: np.ndarray, atom: np.ndarray, size: int, axis: int) -> None:
    """Label one block (kind 1: full voxels, 2: voxels asked for by atoms) and add its parts, borders, open faces and answers."""
    low = block * size
    shape = np.minimum(size, dims - low)
    empty = np.ones(shape, bool)
    xyz = xyz - low
    empty[tuple(xyz[kind == 1].T)] = False
    lab = _labels(empty)
    # part numbers are unique in a frame: block number, then voxel number
    blocks = -(-dims // size)
    base = int((block[0] * blocks[1] + block[1]) * blocks[2] + block[2]) * size ** 3
    parts = np.unique(lab[lab >= 0])
    rows.add(frame, 0, 0, np.zeros((len(parts), 3), int), base + parts)
    grid = np.argwhere(empty)
    label = lab[tuple(grid.T)]
    for ax in range(3):
        for side, edge, last in ((0, 0, 0), (1, shape[ax] - 1, dims[ax] - 1)):
            on = grid[:, ax] == edge
            if low[ax] + edge != last:
                # a high border names the voxel beyond it, where the neighbour's low border meets it
                beyond = np.zeros(3, int)
                beyond[ax] = side
                rows.add(frame, 1, 2 * ax + side, grid[on] + low + beyond, base + label[on])
            elif ax == axis:
                open_ = np.unique(label[on])
                rows.add(frame, 2, 0, np.zeros((len(open_), 3), int), base + open_)
    asked = xyz[kind == 2]
    part = lab[tuple(asked.T)]
    rows.add(frame, 3, 0, asked[part >= 0] + low, base + part[part >= 0], atom[kind == 2][part >= 0])


def _solve_blocks(size: int, axis: int):
    """Function over the rows of many whole blocks."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["frame", "bx", "by", "bz", "kind"], kind="stable")
        block, frame = pdf[["bx", "by", "bz"]].to_numpy(), pdf["frame"].to_numpy()
        xyz, kind, dims, atom = pdf[["x", "y", "z"]].to_numpy(), pdf["kind"].to_numpy(), pdf[["dx", "dy", "dz"]].to_numpy(), pdf["atom"].to_numpy()
        # every block starts with its own row of kind 0
        start = np.flatnonzero(kind == 0)
        rows = _Rows()
        for a, b in zip(start, np.append(start[1:], len(pdf))):
            _solve_block(rows, frame[a], block[a], dims[a], xyz[a + 1:b], kind[a + 1:b], atom[a + 1:b], size, axis)
        return rows.frame()

    return run


def _fill(empty: np.ndarray, frame: np.ndarray, rows: dict[str, np.ndarray], axis: int) -> None:
    """Clear the voxels within the atoms' radii; the same sums in the same order as in :func:`_occupied`."""
    lo, width = rows["lo"], rows["hi"] - rows["lo"] + 1
    ends = np.cumsum(width.prod(1))
    n = np.array(empty.shape[1:]) - 1
    a = 0
    while a < len(frame):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + STEP, side="right")))
        count = width[a:b].prod(1)
        i = np.repeat(np.arange(a, b), count)
        k = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        w = width[i]
        at = lo[i] + np.stack([k // (w[:, 1] * w[:, 2]), k // w[:, 2] % w[:, 1], k % w[:, 2]], axis=1)
        g = at / n - rows["f"][i]
        for ax in range(3):
            if ax != axis:
                g[:, ax] -= np.rint(g[:, ax])
        cell = rows["cell"][i]
        away = [0.0 + g[:, 0] * cell[:, m] + g[:, 1] * cell[:, 3 + m] + g[:, 2] * cell[:, 6 + m] for m in range(3)]
        near = away[0] * away[0] + away[1] * away[1] + away[2] * away[2] <= rows["r"][i] * rows["r"][i]
        empty[(frame[i[near]], *at[near].T)] = False
        a = b


def _outside(empty: np.ndarray, axis: int) -> np.ndarray:
    """Empty voxels connected by faces to the lowest or highest layer along ``axis``, in every grid of the array."""
    out = np.zeros_like(empty)
    side = np.moveaxis(empty, axis + 1, 0)
    for end in (0, -1):
        np.moveaxis(out, axis + 1, 0)[end] = side[end]
    live = np.arange(len(empty))
    while len(live):
        e, o = empty[live], out[live]
        before = o.sum(axis=(1, 2, 3))
        for ax in range(1, 4):
            ee, oo = np.moveaxis(e, ax, 0), np.moveaxis(o, ax, 0)
            for i in range(1, len(oo)):
                oo[i] |= oo[i - 1] & ee[i]
            for i in range(len(oo) - 2, -1, -1):
                oo[i] |= oo[i + 1] & ee[i]
        out[live] = o
        live = live[o.sum(axis=(1, 2, 3)) > before]
    return out


def _solve_frames(axis: int):
    """Function over the atoms of many whole frames."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_f=pd.factorize(pdf["frame"])[0]).sort_values(["dx", "dy", "dz", "_f"], kind="stable", ignore_index=True)
        of = lambda kind: pdf[[f"{kind}{c}" for c in AXES]].to_numpy()
        dims, frame, at = of("d"), pdf["_f"].to_numpy(), of("c")
        rows = {"f": of("f"), "lo": of("lo"), "hi": of("hi"), "r": pdf["_r"].to_numpy(), "cell": pdf[[f"m{k}" for k in range(9)]].to_numpy()}
        first = np.flatnonzero(np.r_[True, frame[1:] != frame[:-1]])
        contact, most = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        named = pdf["named"].to_numpy()
        a = 0
        while a < len(first):
            shape = dims[first[a]]
            # frames of one shape, as many as fit a step
            b = min(len(first), a + max(1, STEP // int(shape.prod())))
            b = a + int((dims[first[a:b]] == shape).all(1).cumprod().sum())
            s = slice(first[a], first[b] if b < len(first) else len(pdf))
            number = np.cumsum(np.r_[0, frame[s][1:] != frame[s][:-1]])
            empty = np.ones((b - a, *shape), bool)
            _fill(empty, number, {k: v[s] for k, v in rows.items()}, axis)
            out = _outside(empty, axis)
            for ax in range(3):
                for step in (1, -1):
                    to = at[s].copy()
                    to[:, ax] += step
                    ok = (to[:, ax] >= 0) & (to[:, ax] < shape[ax])
                    contact[s][ok] += out[(number[ok], *to[ok].T)]
            a = b
        # rows of one atom count together, atoms without a number do not count
        contact[~named] = 0
        twice = pd.DataFrame({"f": frame, "a": pdf["atom"], "n": named})
        if twice.duplicated().any():
            contact = twice.assign(c=contact).groupby(["f", "a", "n"])["c"].transform("sum").to_numpy()
        np.maximum.at(most, frame, contact)
        most = most[frame]
        score = np.where(most > 0, contact / np.maximum(most, 1), 0.0)
        return pd.DataFrame({"frame": pdf["frame"], "atom": pdf["atom"], "named": named, "contact": contact, "score": score, "found": contact > 0})

    return run


def _whole_frames(placed: DataFrame, spacing: float, scale: float, axis: int, atoms: int) -> DataFrame:
    """Result rows of frames that one task floods whole, many frames to a task."""
    kinds = dict(placed.dtypes)
    tasks = max(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-atoms // ATOMS_PER_TASK))
    cell = [F.col("_cell")[i][k].alias(f"m{3 * i + k}") for i in range(3) for k in range(3)]
    # no nulls, so that pandas keeps whole numbers
    rows = _reach(placed, spacing, scale).select("frame", F.coalesce(F.col("atom").cast("long"), F.lit(-1)).alias("atom"), F.col("atom").isNotNull().alias("named"), "_r", *cell,
                                                 *[f"{kind}{c}" for kind in ("d", "f", "c", "lo", "hi") for c in AXES])
    solve = _solve_frames(axis)
    done = rows.groupBy(F.pmod(F.xxhash64("frame"), F.lit(tasks)).alias("_k")).applyInPandas(
        lambda pdf: solve(pdf), f"frame {kinds['frame']}, atom long, named boolean, contact long, score double, found boolean")
    return done.select("frame", F.when(F.col("named"), F.col("atom")).cast(kinds["atom"]).alias("atom"), "contact", "score", "found")


def voxel_surface(atoms: DataFrame, lattice: DataFrame, *, spacing: float = 0.8, scale: float = 1.15, axis: int = 2, block: int = BLOCK, whole: int = WHOLE_VOXELS) -> DataFrame:
    """``frame, atom, contact, score, found``: how many of the six neighbours of an atom's voxel lie outside.

    ``atoms``: ``frame, atom, z, px, py, pz``; ``lattice``: ``frame, cell, pbc`` with a cell of
    non-zero volume. A voxel is full within ``scale`` times an atom's radius, at least
    ``spacing``, of an atom. Empty voxels connected by faces to the lowest or highest layer along
    ``axis`` are outside; the flood itself does not wrap. ``score`` is the contact over the
    frame's largest one. Frames without a cell give no rows. Frames of up to ``whole`` voxels
    and ``WHOLE_ATOMS`` atoms go whole to a task, larger ones block by block: the result is the same.
    """
    p = settle(_placed(atoms.select("frame", "atom", "z", "px", "py", "pz"), lattice, spacing, axis))
    voxels = F.col("dx").cast("long") * F.col("dy") * F.col("dz")
    sizes = p.groupBy("frame").agg(F.count(F.lit(1)).alias("_n"), F.max(voxels).alias("_v"))
    large = (F.col("_v") > whole) | (F.col("_n") > WHOLE_ATOMS)
    total, many = sizes.agg(F.sum("_n"), F.sum(F.when(large, F.col("_n")))).first()
    if not many:
        return _whole_frames(p, spacing, scale, axis, total or 0)
    if many == total:
        return _by_blocks(p, spacing, scale, axis, block)
    big = settle(sizes.where(large).select("frame"))
    small = _whole_frames(p.join(big, "frame", "left_anti"), spacing, scale, axis, total - many)
    return small.unionByName(_by_blocks(settle(p.join(big, "frame", "left_semi")), spacing, scale, axis, block))


def _by_blocks(p: DataFrame, spacing: float, scale: float, axis: int, block: int) -> DataFrame:
    """Result rows of large frames: a task labels blocks, the parts that meet at borders are joined."""
    dims = p.select("frame", "dx", "dy", "dz").distinct()
    # no nulls, so that pandas keeps whole numbers
    none = lambda name, kind="int": F.lit(-1).cast(kind).alias(name)
    all_blocks = dims
    for c in AXES:
        all_blocks = all_blocks.withColumn(f"b{c}", F.explode(F.sequence(F.lit(0), ((F.col(f"d{c}") - 1) / block).cast("int"))))
    blocks = ["bx", "by", "bz"]
    head = all_blocks.select("frame", *blocks, F.lit(0).alias("kind"), *[F.lit(0).alias(c) for c in AXES], "dx", "dy", "dz", none("atom", "long"))
    of = [(F.col(c) / block).cast("int").alias(f"b{c}") for c in AXES]
    full = _occupied(p, spacing, scale, axis).select("frame", *of, F.lit(1).alias("kind"), *AXES, none("dx"), none("dy"), none("dz"), none("atom", "long"))
    steps = F.array(*[F.array(*[F.lit(s if i == j else 0) for j in range(3)]) for i in range(3) for s in (1, -1)])
    asked = p.withColumn("_s", F.explode(steps)).select("frame", F.col("atom").cast("long").alias("atom"), *[(F.col(f"c{c}") + F.col("_s")[i]).alias(c) for i, c in enumerate(AXES)], "dx", "dy", "dz")
    inside = [(F.col(c) >= 0) & (F.col(c) < F.col(f"d{c}")) for c in AXES]
    asked = asked.where(inside[0] & inside[1] & inside[2]).select("frame", *of, F.lit(2).alias("kind"), *AXES, none("dx"), none("dy"), none("dz"), "atom")
    kind = dict(p.dtypes)["frame"]
    solve = _solve_blocks(block, axis)
    rows = head.unionByName(full).unionByName(asked)
    tasks = max(int(p.sparkSession.conf.get("spark.sql.shuffle.partitions")), head.count() // BLOCKS_PER_TASK)
    solved = settle(rows.groupBy(F.pmod(F.xxhash64("frame", *blocks), F.lit(tasks)).alias("_k")).applyInPandas(
        lambda pdf: solve(pdf), f"frame {kind}, kind int, side int, x int, y int, z int, part long, atom long"))
    parts = settle(solved.where("kind = 0").select("frame", "part").withColumn("id", F.monotonically_increasing_id()))
    border = solved.where("kind = 1")
    high = border.where("side % 2 = 1").select("frame", (F.col("side") - 1).alias("side"), *AXES, F.col("part").alias("a"))
    meets = high.distinct().join(border.where("side % 2 = 0").select("frame", "side", *AXES, F.col("part").alias("b")), ["frame", "side", *AXES]).select("frame", "a", "b").distinct()
    named = lambda side, to: parts.select("frame", F.col("part").alias(side), F.col("id").alias(to))
    links = meets.join(named("a", "src"), ["frame", "a"]).join(named("b", "dst"), ["frame", "b"]).select("frame", "src", "dst")
    joined = components(links, "frame")
    whole = settle(parts.join(joined, "id", "left").select("frame", "part", F.coalesce("component", "id").alias("component")))
    outside = solved.where("kind = 2").select("frame", "part").distinct().join(whole, ["frame", "part"]).select("frame", "component").distinct()
    open_ = whole.join(outside, ["frame", "component"], "left_semi").select("frame", "part")
    touch = solved.where("kind = 3").join(open_, ["frame", "part"], "left_semi").groupBy("frame", "atom").agg(F.count(F.lit(1)).alias("contact"))
    d = p.select("frame", "atom").join(touch, ["frame", "atom"], "left").withColumn("contact", F.coalesce("contact", F.lit(0)))
    most = d.groupBy("frame").agg(F.max("contact").alias("_m"))
    return d.join(most, "frame").select("frame", "atom", "contact", F.when(F.col("_m") > 0, F.col("contact") / F.col("_m")).otherwise(0.0).alias("score"), (F.col("contact") > 0).alias("found"))
