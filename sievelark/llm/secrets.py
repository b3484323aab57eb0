"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sievelark.llm.common import documents, raw_texts, store
from sievelark.llm.registry import query

# The patterns every scan reports.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]{12,}")
HEX = re.compile(rb"[0-9a-f]{32,}")
KEYWORDS = (b"passw", b"secret", b"token", b"api")
KINDS = ("assign", "access", "hex", "random")

#: Runs that are tested, and the alphabets that may encode them (narrowest that fits wins).
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_-]{16,}")
LOWER, UPPER, DIGITS = b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
ALPHABETS = [DIGITS + LOWER[:6], DIGITS + UPPER[:6], UPPER + b"234567", DIGITS + LOWER, DIGITS + UPPER, DIGITS + UPPER + LOWER, UPPER + LOWER + DIGITS + b"+/", UPPER + LOWER + DIGITS + b"-_"]
#: Chance of a false discovery, and the battery's level at which a run counts as not random.
FDR, NOT_RANDOM = 0.001, 0.0005
#: Lengths from which a stratum starts; false discoveries are controlled in each.
STRATA = (16, 24, 32, 48, 64, 128)

_SIZE = np.array([len(a) for a in ALPHABETS])
_SYMBOL = np.full((len(ALPHABETS), 256), -1, np.int16)
for _k, _a in enumerate(ALPHABETS):
    _SYMBOL[_k, np.frombuffer(_a, np.uint8)] = np.arange(len(_a))
_FITS = _SYMBOL >= 0


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind) in bytes of the fixed patterns, by start and kind."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if b"AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], x[2]))


def _normal_tail(z: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(x / math.sqrt(2)) for x in z])


def background(docs: DataFrame) -> np.ndarray:
    """Shares of the 256 byte values in all texts, with one added to each count."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            for t in raw_texts(batch):
                if t:
                    total += np.bincount(np.frombuffer(t, np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256, dtype=np.int32)), pa.array(total)], names=["b", "n"])

    got = docs.select("text").mapInArrow(count, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).collect()
    x = np.ones(256)
    for r in got:
        x[r["b"]] += r["n"]
    return x / x.sum()


def battery(runs: list[bytes], share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per run: the chance that ordinary text of its length looks as random, and that random symbols look as uneven.

    The encoding is the narrowest alphabet that holds the run (runs of digits only are never
    random here). Against ordinary text: the log likelihood ratio of uniform symbols to the
    corpus' own shares of those symbols, which for text of n symbols is close to normal with
    mean and spread that follow from the shares, so short runs need stronger evidence. For
    randomness: chi-squared of the symbol counts, runs above and below the alphabet's middle,
    and the correlation of neighbours; the smallest of the three chances times three.
    """
    if not runs:
        return np.zeros(0), np.zeros(0)
    n = np.array([len(r) for r in runs])
    flat = np.frombuffer(b"".join(runs), np.uint8)
    start = np.concatenate([[0], np.cumsum(n)[:-1]])
    own = np.repeat(np.arange(len(runs)), n)
    fits = np.stack([np.logical_and.reduceat(_FITS[k][flat], start) for k in range(len(ALPHABETS))])
    enc = np.argmax(fits, axis=0)
    digits = np.logical_and.reduceat((flat >= 48) & (flat <= 57), start)
    none = ~fits.any(axis=0) | digits
    size = _SIZE[enc]
    sym = np.maximum(_SYMBOL[enc[own], flat], 0).astype(np.int64)
    ratio, mean, sd = np.zeros((len(ALPHABETS), 256)), np.zeros(len(ALPHABETS)), np.zeros(len(ALPHABETS))
    for k, a in enumerate(ALPHABETS):
        at = np.frombuffer(a, np.uint8)
        q = share[at] / share[at].sum()
        ratio[k, at] = -np.log(len(a) * q)
        mean[k] = (q * ratio[k, at]).sum()
        sd[k] = math.sqrt(max((q * ratio[k, at] ** 2).sum() - mean[k] ** 2, 1e-12))
    llr = np.add.reduceat(ratio[enc[own], flat], start)
    ordinary = _normal_tail((llr - n * mean[enc]) / (sd[enc] * np.sqrt(n)))
    counts = np.bincount(own * 64 + sym, minlength=64 * len(runs)).reshape(-1, 64)
    chi = (counts ** 2).sum(axis=1) * size / n - n
    z1 = (chi - (size - 1)) / np.sqrt(2 * (size - 1) * (n - 1) / n)
    high = sym >= (size // 2)[own]
    change = np.zeros(len(flat), np.int64)
    change[1:] = (high[1:] != high[:-1]) & (own[1:] == own[:-1])
    p = (size // 2) / size
    p = 1 - p
    flips = np.add.reduceat(change, start)
    expect = (n - 1) * 2 * p * (1 - p)
    z2 = (flips - expect) / np.sqrt(np.maximum((n - 1) * 2 * p * (1 - p) * (1 - 2 * p * (1 - p)), 1e-9))
    dev = sym - np.repeat(np.add.reduceat(sym, start) / n, n)
    prod = np.zeros(len(flat))
    prod[1:] = np.where(own[1:] == own[:-1], dev[1:] * dev[:-1], 0)
    var = np.add.reduceat(dev ** 2, start)
    z3 = np.where(var > 0, np.add.reduceat(prod, start) / np.maximum(var, 1e-9) * np.sqrt(n), 99.0)
    uneven = np.minimum(1, 3 * np.minimum(_normal_tail(z1), 2 * np.minimum(_normal_tail(np.abs(z2)), _normal_tail(np.abs(z3)))))
    return np.where(none, 1.0, ordinary), np.where(none, 0.0, uneven)


def _candidates(texts: list[bytes | None]) -> tuple[list[int], list[int], list[bytes]]:
    rows, starts, runs = [], [], []
    for r, t in enumerate(texts):
        if t:
            for m in CANDIDATE.finditer(t):
                rows.append(r), starts.append(m.start()), runs.append(m.group())
    return rows, starts, runs


def thresholds(docs: DataFrame, share: np.ndarray, fdr: float = FDR) -> np.ndarray:
    """Per stratum of length, the Benjamini-Hochberg bound on the chance of being ordinary text, over all runs of all documents."""
    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tested = np.zeros(len(STRATA), np.int64)
        for batch in batches:
            _, _, runs = _candidates(raw_texts(batch))
            p, _ = battery(runs, share)
            s = np.searchsorted(STRATA, [len(r) for r in runs], side="right") - 1 if runs else np.zeros(0, np.int64)
            tested += np.bincount(s, minlength=len(STRATA))
            low = p <= fdr
            if low.any():
                yield pa.RecordBatch.from_arrays([pa.array(s[low].astype(np.int32)), pa.array(p[low]), pa.array(np.zeros(int(low.sum()), np.int64))], names=["s", "p", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(STRATA), dtype=np.int32)), pa.nulls(len(STRATA), pa.float64()), pa.array(tested)], names=["s", "p", "n"])

    rows = store(docs.select("text").mapInArrow(test, "s int, p double, n long"), "secret-tests")
    m = np.zeros(len(STRATA))
    for r in rows.groupBy("s").agg(F.sum("n").alias("n")).collect():
        m[r["s"]] = r["n"]
    cut = np.full(len(STRATA), fdr)
    while True:  # falls to the largest p with p <= fdr * rank / tested, step by step of 1 / tested; mostly few rounds, each one aggregation
        bound = F.element_at(F.array(*[F.lit(float(c)) for c in cut]), F.col("s") + 1)
        ranks = {r["s"]: r["k"] for r in rows.where(F.col("p") <= bound).groupBy("s").agg(F.count(F.lit(1)).alias("k")).collect()}
        new = np.array([min(cut[s], fdr * ranks.get(s, 0) / m[s]) if m[s] else 0.0 for s in range(len(STRATA))])
        if np.array_equal(new, cut):
            break
        cut = new
    return cut


def scan(docs: DataFrame) -> DataFrame:
    """Rows ``doc_id, spans`` with spans (start, end, kind) in code points, by start and kind.

    ``kind`` indexes KINDS. Random runs are those that pass the battery, stand out from
    ordinary text under the false-discovery bound of their length, and overlap no other span.
    Null and empty texts have no spans; repeated rows each get theirs.
    """
    share = background(docs)
    cut = thresholds(docs, share)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = raw_texts(batch)
            spans = [base_spans(t) if t else [] for t in texts]
            rows, starts, runs = _candidates(texts)
            ordinary, uneven = battery(runs, share)
            s = np.searchsorted(STRATA, [len(r) for r in runs], side="right") - 1 if runs else np.zeros(0, np.int64)
            for i in np.nonzero((ordinary <= cut[s]) & (uneven > NOT_RANDOM))[0]:
                r, a = rows[i], starts[i]
                b = a + len(runs[i])
                if all(b <= x[0] or x[1] <= a for x in spans[r] if x[2] < 3):
                    spans[r].append((a, b, 3))
            out = []
            for t, sp in zip(texts, spans):
                sp.sort(key=lambda x: (x[0], x[2]))
                if sp and not t.isascii():
                    at = np.concatenate([[0], np.cumsum((np.frombuffer(t, np.uint8) & 0xC0) != 0x80)])
                    sp = [(int(at[a]), int(at[b]), k) for a, b, k in sp]
                out.append([[a, b, k] for a, b, k in sp])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.list_(pa.int32())))], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<array<int>>")


@query("op4_secret_randomness")
def _(spark, base):
    s = scan(documents(spark, base))
    of = lambda k: F.size(F.filter("spans", lambda x: x[2] == k)).cast("long")
    names = F.array(*[F.lit(k) for k in KINDS])
    text = lambda c: F.concat_ws(",", F.transform(c, lambda x: F.concat_ws(":", F.get(names, x[2]), x[0], x[1])))
    return s.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
                    F.sha2(text(F.filter("spans", lambda x: x[2] < 3)).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), of(3).alias("n_random"))
