"""Molecule and trajectory files as DataFrames.

``read_molecules`` takes folders of single-molecule files (Gaussian inputs, xyz). Long
trajectories go through the ``frames_extxyz`` data source, which cuts a file into byte
ranges and lets every task find the frames that start in its range.
"""

from __future__ import annotations

import glob
import os
import re
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from sievelark.functions.fixed import ATOMIC_NUMBER, SYMBOLS

FRAME_SCHEMA = ("path string, frame_no long, numbers array<int>, positions array<array<double>>, cell array<array<double>>, "
                "pbc array<boolean>, energy double, info map<string,string>")
MOLECULE_SCHEMA = ("path string, kind string, charge int, multiplicity int, numbers array<int>, positions array<array<double>>, "
                   "bonds array<struct<i:int,j:int,order:double>>, error string")


def element(token: str) -> int:
    """Atomic number from a symbol, a symbol with a suffix, or a number."""
    t = token.split("(")[0].split("-")[0]
    return int(t) if t.isdigit() else ATOMIC_NUMBER[t[:1].upper() + re.sub(r"[^a-z]", "", t[1:].lower())]


def _ints(tokens: list[str]) -> list[int] | None:
    try:
        return [int(t) for t in tokens]
    except ValueError:
        return None


def gaussian_molecule(text: str) -> dict:
    """Charge line, atom lines and the connectivity block of a Gaussian input."""
    lines = [l.strip() for l in text.splitlines()]
    head = next((n for n, l in enumerate(lines) if len(l.split()) >= 2 and _ints(l.split()[:2]) is not None), None)
    if head is None:
        raise ValueError("no charge and multiplicity line")
    charge, mult = _ints(lines[head].split()[:2])
    numbers, xyz, n = [], [], head + 1
    while n < len(lines):
        t = lines[n].split()
        try:
            z, p = element(t[0]), [float(v) for v in t[1:4]]
        except (IndexError, ValueError, KeyError):
            break
        if len(p) < 3:
            break
        numbers.append(z)
        xyz.append(p)
        n += 1
    if not numbers:
        raise ValueError("no atoms")
    return {"charge": charge, "multiplicity": mult, "numbers": numbers, "positions": xyz, "bonds": connectivity(lines[n:], len(numbers))}


def connectivity(lines: list[str], n_atoms: int) -> list[dict]:
    """Bonds from ``source (target order)*`` lines: 1-based input, first mention of a pair wins.

    A line with a source outside the molecule, a tail of odd length or a token that is no
    number is left out whole; single targets outside the molecule are left out alone.
    """
    seen: dict[tuple[int, int], float] = {}
    for line in lines:
        head, *tail = line.split() or [""]
        if not tail or len(tail) % 2:
            continue
        try:
            i, ends = int(head) - 1, [(int(a) - 1, float(o)) for a, o in zip(tail[::2], tail[1::2])]
        except ValueError:
            continue
        for j, order in ends if 0 <= i < n_atoms else ():
            if i != j and 0 <= j < n_atoms:
                seen.setdefault((min(i, j), max(i, j)), order)
    return [{"i": i, "j": j, "order": o} for (i, j), o in sorted(seen.items())]


def xyz_molecule(text: str) -> dict:
    lines = text.splitlines()
    n = int(lines[0])
    rows = [l.split() for l in lines[2:2 + n]]
    return {"charge": None, "multiplicity": None, "numbers": [element(r[0]) for r in rows], "positions": [[float(v) for v in r[1:4]] for r in rows], "bonds": []}


READERS = {".gjf": ("gaussian", gaussian_molecule), ".com": ("gaussian", gaussian_molecule), ".xyz": ("xyz", xyz_molecule), ".extxyz": ("xyz", xyz_molecule)}


def read_molecules(spark: SparkSession, path: str) -> DataFrame:
    """One row per file; an unreadable or unknown file keeps its row with ``error`` set."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))

    def parse(batches):
        for b in batches:
            out = []
            for text, p in zip(b["value"], b["path"]):
                row = {"path": p, "kind": None, "charge": None, "multiplicity": None, "numbers": None, "positions": None, "bonds": None, "error": None}
                ext = os.path.splitext(p)[1].lower()
                try:
                    if ext not in READERS:
                        raise ValueError(f"unsupported molecule file: {ext}")
                    row["kind"], reader = READERS[ext]
                    row.update(reader(text))
                except (ValueError, IndexError, KeyError) as e:
                    row["error"] = f"{type(e).__name__}: {e}"
                out.append(row)
            yield pd.DataFrame(out)

    return files.mapInPandas(parse, MOLECULE_SCHEMA)


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def _comment(text: str) -> tuple[dict, list | None, list | None]:
    """Key-value pairs of an extended-xyz comment line, with its lattice and periodicity."""
    info = {k: (q if q or not v else v) for k, q, v in re.findall(r'([A-Za-z_][\w-]*)=(?:"([^"]*)"|(\S+))', text)}
    cell = pbc = None
    if "Lattice" in info:
        v = [float(x) for x in info.pop("Lattice").split()]
        cell = [v[0:3], v[3:6], v[6:9]]
    if "pbc" in info:
        pbc = [t.upper().startswith("T") for t in info.pop("pbc").split()]
    return info, cell, pbc


def _columns(info: dict) -> tuple[int, int]:
    """Positions of the species and coordinate columns from the Properties entry."""
    at, species, pos = 0, 0, 1
    parts = info.pop("Properties", "species:S:1:pos:R:3").split(":")
    for name, _, width in zip(parts[0::3], parts[1::3], parts[2::3]):
        species, pos = (at if name == "species" else species), (at if name == "pos" else pos)
        at += int(width)
    return species, pos


class _FrameReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.size = int(options.get("rangebytes", 64 << 20))

    def partitions(self):
        names = sorted(glob.glob(os.path.join(self.path, "*xyz")) if os.path.isdir(self.path) else glob.glob(self.path))
        out = []
        for n in names:
            total = os.path.getsize(n)
            out += [_Range(n, s, min(total, s + self.size)) for s in range(0, max(total, 1), self.size)]
        return out

    @staticmethod
    def _is_head(lines: list[bytes]) -> bool:
        """A frame starts where a count is followed, after a comment, by that many atom lines."""
        if not lines[0].strip().isdigit():
            return False
        n = int(lines[0])
        atoms = lines[2:2 + n]
        if any(len(l.split()) < 4 for l in atoms):
            return False
        after = lines[2 + n] if len(lines) > 2 + n else b""
        return len(atoms) == n and (not after.strip() or after.strip().isdigit())

    def _align(self, f, start: int) -> None:
        f.seek(start)
        if start:
            f.seek(start - 1)
            f.readline()
        while True:
            here = f.tell()
            line = f.readline()
            if not line:
                return
            if line.strip().isdigit():
                block = [line] + [f.readline() for _ in range(int(line) + 2)]
                if self._is_head([b for b in block if b] if not block[-1] else block):
                    f.seek(here)
                    return
                f.seek(here)
                f.readline()

    def read(self, part: _Range):
        with open(part.path, "rb") as f:
            self._align(f, part.start)
            while True:
                here = f.tell()
                line = f.readline()
                if not line or here >= part.end:
                    return
                if not line.strip():
                    continue
                n = int(line)
                info, cell, pbc = _comment(f.readline().decode("utf-8"))
                s, p = _columns(info)
                rows = [f.readline().decode("utf-8").split() for _ in range(n)]
                energy = next((float(info[k]) for k in ("energy", "energy_ev", "free_energy", "E") if k in info), 0.0)
                yield (part.path, here, [element(r[s]) for r in rows], [[float(v) for v in r[p:p + 3]] for r in rows], cell, pbc, energy, info)


class _FrameWriter(DataSourceWriter):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.columns = options["path"], columns

    def write(self, rows):
        os.makedirs(self.path, exist_ok=True)
        name = os.path.join(self.path, f"part-{uuid.uuid4().hex}.extxyz")
        with open(name + ".tmp", "w", encoding="utf-8") as f:
            for r in rows:
                get = lambda c: r[self.columns.index(c)] if c in self.columns else None
                head = []
                if get("cell"):
                    head.append('Lattice="' + " ".join(repr(float(v)) for a in get("cell") for v in a) + '"')
                head.append("Properties=species:S:1:pos:R:3")
                if get("energy") is not None:
                    head.append(f"energy={float(get('energy'))!r}")
                head += [f'{k}="{v}"' for k, v in sorted((get("info") or {}).items()) if k not in ("energy",)]
                if get("pbc"):
                    head.append('pbc="' + " ".join("T" if v else "F" for v in get("pbc")) + '"')
                f.write(f"{len(get('numbers'))}\n{' '.join(head)}\n")
                for z, p in zip(get("numbers"), get("positions")):
                    f.write(f"{SYMBOLS[z - 1]} " + " ".join(repr(float(v)) for v in p) + "\n")
        os.rename(name + ".tmp", name)
        return WriterCommitMessage()


class ExtxyzFrames(DataSource):
    """``spark.read/write.format("frames_extxyz")``; paths must be visible to every executor."""

    @classmethod
    def name(cls):
        return "frames_extxyz"

    def schema(self):
        return FRAME_SCHEMA

    def reader(self, schema):
        return _FrameReader(self.options)

    def writer(self, schema, overwrite):
        return _FrameWriter(self.options, schema.fieldNames())


def read_frames(spark: SparkSession, path: str, range_bytes: int = 64 << 20) -> DataFrame:
    """Frames of extended-xyz files; ``frame_no`` is the byte offset, which orders them within a file."""
    spark.dataSource.register(ExtxyzFrames)
    return spark.read.format("frames_extxyz").option("rangebytes", range_bytes).load(path)


def write_frames(df: DataFrame, path: str) -> None:
    df.sparkSession.dataSource.register(ExtxyzFrames)
    df.write.format("frames_extxyz").mode("append").save(path)


def first_existing(spark: SparkSession, folder: str, names: tuple[str, ...] = ("post_relax_selected.extxyz", "relaxed_stream.extxyz")) -> DataFrame:
    """Frames of the first file that exists in the folder."""
    for n in names:
        if os.path.exists(os.path.join(folder, n)):
            return read_frames(spark, os.path.join(folder, n))
    raise FileNotFoundError(f"none of {', '.join(names)} in {folder}")


def read_case_json(spark: SparkSession, pattern: str, parts: list[str], schema: str) -> DataFrame:
    """JSON documents under ``.../group/slab/ads/file.json`` with the folder names as columns; broken files are skipped."""
    d = spark.read.schema(schema).option("multiLine", True).option("ignoreCorruptFiles", True).option("mode", "DROPMALFORMED").json(pattern)
    names = F.split(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", ""), "/")
    return d.select("*", *[F.element_at(names, i - len(parts)).alias(p) for i, p in enumerate(parts)])


def positional_zip(rows: DataFrame, frames: DataFrame, key: list[str], at: str) -> DataFrame:
    """Join rows and frames on position; a case with different counts raises when evaluated."""
    n = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_a")).join(frames.groupBy(*key).agg(F.count(F.lit(1)).alias("_b")), key, "full_outer")
    same = F.coalesce(F.col("_a"), F.lit(0)) == F.coalesce(F.col("_b"), F.lit(0))
    ok = n.select(*key, F.when(same, True).otherwise(F.raise_error(F.lit("row and frame counts differ"))).alias("_ok"))
    return rows.join(ok, key).where("_ok").drop("_ok").join(frames, [*key, at])


def complete_cases(files: DataFrame, metrics: DataFrame, required: list[str], checks: list[str]) -> DataFrame:
    """``case, complete, reason``: required files present and every listed metric ``ok``.

    ``files``: ``case, file``; ``metrics``: ``case`` plus one status column per check.
    """
    have = files.where(F.col("file").isin(required)).groupBy("case").agg(F.collect_set("file").alias("_f"))
    cases = files.select("case").union(metrics.select("case")).distinct()
    j = cases.join(have, "case", "left").join(metrics, "case", "left")
    missing = [F.when(~F.array_contains(F.coalesce("_f", F.array().cast("array<string>")), f), F.lit(f"missing:{f}")) for f in required]
    bad = [F.when(F.coalesce(F.col(c), F.lit("")) != "ok", F.lit(f"metric:{c}")) for c in checks]
    reason = F.coalesce(*missing, *bad)
    return j.select("case", reason.isNull().alias("complete"), reason.alias("reason"))
