"""Quality rules: statistics of whole texts, and an isolation forest that finds the texts that stand out in them."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sievelark.llm.common import documents, fresh, raw_texts, store
from sievelark.llm.registry import query
from sievelark.sources.tables import table

#: Words of a window, the fewest words of a document, and the share (of 100) of its words that may lie in repeated windows.
WINDOW, MIN_WORDS, MAX_REPEATED = 8, 20, 30
#: Trees of the forest, rows that a tree is grown from, and labelled rows (by the smallest hashes of their ids) that trees draw from.
TREES, ROWS_PER_TREE, SAMPLE = 128, 256, 8_192
#: Share of the good labelled rows that the threshold may reject.
LOSS = 0.01
#: Scores are read to so many decimals when the threshold is calibrated.
DIGITS = 4
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Names of the statistics that the forest splits, in order.
STATISTICS = [
    "log_words", "word_length", "symbols", "dup_lines", "repeated_words", "distinct_words", "top_word", "capitals", "digits", "other_signs", "wide_chars",
    "marks", "wordless", "log_line_words", "short_words", "long_words",
]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside runs of ``window`` words (a power of two) that occur at two places or more.

    Classes of equal runs double in length; only starts whose halves both recur go on.
    """
    n = len(words)
    if n <= window:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(number) == n:
        return 0
    cls = np.fromiter(map(number.__getitem__, words), np.int64, n)
    cls[np.bincount(cls)[cls] == 1] = -1
    step = 1
    while step < window:
        first, second = cls[:-step], cls[step:]
        at = np.flatnonzero((first >= 0) & (second >= 0))
        if not len(at):
            return 0
        _, inv, count = np.unique(first[at] * (cls.max() + 1) + second[at], return_inverse=True, return_counts=True)
        cls = np.full(n - 2 * step + 1, -1, np.int64)
        cls[at] = np.where(count[inv] > 1, inv, -1)
        step *= 2
    at = np.flatnonzero(cls >= 0)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def statistics(text: bytes | None) -> tuple[list[int], list[float]]:
    """The counts ``COUNTS`` and the ``STATISTICS`` of a whole text; null and the empty text have zeros."""
    t = text or b""
    words = t.split()
    n = len(words)
    hist = np.bincount(np.frombuffer(t, np.uint8), minlength=256)
    blanks = hist[32] + hist[9:14].sum()
    points = int(len(t) - hist[0x80:0xC0].sum())
    lines = t.split(b"\n")
    filled = [x for x in lines if x.strip()]
    counts = [n, points - int(blanks), int(hist[list(SYMBOLS)].sum()), len(filled) - len(set(filled)), repeated_words(words)]
    if not n:
        return counts, [0.0] * len(STATISTICS)
    size = Counter(words)
    lengths = Counter(map(len, words))
    chars = counts[1]
    capitals, small, digits = hist[65:91].sum(), hist[97:123].sum(), hist[48:58].sum()
    wide = hist[0xC0:].sum()
    marks = hist[list(b".,;:!?")].sum()
    return counts, [
        math.log1p(n), min(chars / n, 40.0), counts[2] / n, counts[3] / len(filled), counts[4] / n, len(size) / n, max(size.values()) / n, capitals / max(capitals + small, 1), digits / chars,
        (chars - capitals - small - digits - wide - marks) / chars, wide / chars, marks / n, sum(c for w, c in size.items() if not w.isalpha()) / n, math.log1p(n / len(filled)),
        sum(c for k, c in lengths.items() if k <= 2) / n, sum(c for k, c in lengths.items() if k >= 15) / n,
    ]


def base_failed(counts: DataFrame) -> DataFrame:
    """Add ``base_failed``: too few words, or too many of them in repeated windows."""
    return counts.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED))


def rule_statistics(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, the counts, ``base_failed`` and the statistics ``x`` of every row; one pass over whole texts."""
    kind = dict(docs.dtypes)[id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t) for t in raw_texts(batch)]
            counts = np.array([c for c, _ in found], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[:, i]) for i in range(len(COUNTS))), pa.array([x for _, x in found], pa.list_(pa.float64()))], names=["doc_id", *COUNTS, "x"])

    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    return base_failed(rows.mapInArrow(run, f"doc_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, x array<double>"))


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean length of an unsuccessful search in a binary search tree of ``n`` rows; 0 below two rows."""
    n = np.asarray(n, float)
    m = np.maximum(n, 2.0)
    h = np.where(m == 2.0, 1.0, np.log(m - 1) + np.euler_gamma + 1 / (2 * (m - 1)))
    return np.where(n < 2, 0.0, 2 * h - 2 * (m - 1) / m)


def grow_tree(x: np.ndarray, tree: int) -> dict[str, list]:
    """One isolation tree on rows drawn from ``x``: ``feature`` (-1 at a leaf), ``cut``, ``left`` (right is the next node) and ``path`` (of a leaf)."""
    rng = np.random.default_rng([20_231, tree])
    rows = x[rng.permutation(len(x))[:ROWS_PER_TREE]]
    deepest = max(1, math.ceil(math.log2(max(len(rows), 2))))
    out = {"feature": [-1], "cut": [0.0], "left": [0], "path": [0.0]}
    todo = [(0, rows, 0)]
    while todo:
        node, part, depth = todo.pop()
        low, high = part.min(axis=0), part.max(axis=0)
        open_ = np.flatnonzero(high > low)
        if depth == deepest or len(part) < 2 or not len(open_):
            out["path"][node] = depth + float(average_path(len(part)))
            continue
        f = int(rng.choice(open_))
        cut = float(rng.uniform(low[f], high[f]))
        left = len(out["feature"])
        for k, v in (("feature", -1), ("cut", 0.0), ("left", 0), ("path", 0.0)):
            out[k] += [v, v]
        out["feature"][node], out["cut"][node], out["left"][node] = f, cut, left
        todo += [(left, part[part[:, f] <= cut], depth + 1), (left + 1, part[part[:, f] > cut], depth + 1)]
    return out


class Forest:
    """Isolation trees as flat arrays; ``score`` is near 1 for rows that few random splits set apart."""

    def __init__(self, trees: list[dict[str, list]], rows: int) -> None:
        at = np.cumsum([0, *(len(t["feature"]) for t in trees)])
        self.root = at[:-1]
        self.feature = np.concatenate([np.array(t["feature"]) for t in trees])
        self.cut = np.concatenate([np.array(t["cut"]) for t in trees])
        self.left = np.concatenate([np.array(t["left"]) + a for t, a in zip(trees, at)])
        self.path = np.concatenate([np.array(t["path"]) for t in trees])
        self.norm = max(float(average_path(min(rows, ROWS_PER_TREE))), 1e-9)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        row = np.arange(len(x))
        for root in self.root:
            node = np.full(len(x), root)
            while True:
                f = self.feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[row, np.maximum(f, 0)] > self.cut[node]
                node = np.where(inner, self.left[node] + right, node)
            total += self.path[node]
        return np.round(2.0 ** (-total / len(self.root) / self.norm), DIGITS)


def fit_forest(rows: DataFrame) -> Forest | None:
    """A forest on at most ``SAMPLE`` of ``rows`` (``doc_id, x``), the ones with the smallest hashes of their ids; None without rows.

    Every tree is grown in a task of its own from the sample, with a seed of its own.
    """
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(SAMPLE).select("x").toArrow()  # bounded by ``SAMPLE``
    if not sample.num_rows:
        return None
    x = np.array(sample["x"].to_pylist())

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [(t, grow_tree(x, t)) for t in batch.column(0).to_pylist()]
            if trees:
                yield pa.RecordBatch.from_pylist([{"tree": t, **v} for t, v in trees], schema=pa.schema([
                    ("tree", pa.int64()), ("feature", pa.list_(pa.int64())), ("cut", pa.list_(pa.float64())), ("left", pa.list_(pa.int64())), ("path", pa.list_(pa.float64()))]))

    grown = rows.sparkSession.range(TREES).mapInArrow(grow, "tree long, feature array<bigint>, cut array<double>, left array<bigint>, path array<double>")
    return Forest([r.asDict() for r in sorted(grown.collect(), key=lambda r: r["tree"])], len(x))


def scored(rows: DataFrame, forest: Forest | None) -> DataFrame:
    """``rows`` with ``x`` replaced by ``anomaly`` (0 to 1, 0 without a forest)."""
    keep = [c for c in rows.columns if c != "x"]
    if forest is None:
        return rows.select(*keep, F.lit(0.0).alias("anomaly"))
    model = rows.sparkSession.sparkContext.broadcast(forest)  # bounded by TREES and ROWS_PER_TREE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(len(keep)).flatten().to_numpy().reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(model.value.score(x))], names=[*keep, "anomaly"])

    kinds = dict(rows.dtypes)
    return rows.select(*keep, "x").mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", anomaly double")


def threshold(rows: DataFrame, loss: float = LOSS) -> float:
    """Anomaly above which a document goes, from the labelled ``rows`` (``y, anomaly``).

    Of the cuts that reject at most ``loss`` of the good rows, the one that tells both classes
    apart best (balanced accuracy), the lowest of equals. Without both classes nothing goes.
    """
    # scores have DIGITS decimals: a bounded histogram over all labelled rows
    bins = rows.groupBy("anomaly").agg(F.sum("y").alias("good"), F.count(F.lit(1)).alias("n")).toPandas().sort_values("anomaly")
    good, bad = bins["good"].to_numpy(float), (bins["n"] - bins["good"]).to_numpy(float)
    if not good.sum() or not bad.sum():
        return 1.0
    lost, caught = 1 - np.cumsum(good) / good.sum(), 1 - np.cumsum(bad) / bad.sum()
    worth = np.where(lost <= loss + 1e-12, caught - lost, -np.inf)
    return float(bins["anomaly"].to_numpy()[int(np.argmax(worth))])


def judge(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", loss: float = LOSS) -> DataFrame:
    """Counts, ``base_failed``, ``anomaly`` and ``kept`` of every row of ``docs``.

    ``labels`` has ``doc_id`` and ``quality`` (1 good, 0 bad); rows with a null in either are left
    out, of several labels of an id the lowest counts. Labelled documents that pass the base rules
    feed the forest (a bounded sample) and the threshold (all of them). ``kept`` is false where the
    base rules fail or the anomaly is above the threshold. Null and empty texts fail the base rules;
    repeated rows and null ids each get their own row; an empty table gives no rows; other columns
    of ``docs`` are not read. Without labels of both classes nothing goes but by the base rules.
    """
    stats = store(rule_statistics(docs, id=id, text=text), "rules")
    y = fresh("y", ["doc_id"])
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias(y))
    labelled = store(stats.where("NOT base_failed").join(marks, "doc_id").select("doc_id", "x", y), "rules-labelled")
    forest = fit_forest(labelled)
    cut = threshold(scored(labelled.select(y, "x"), forest), loss)
    return scored(stats, forest).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= cut))


@query("op12_rule_forest")
def op12_rule_forest(spark: SparkSession, base: str) -> DataFrame:
    """Base counts and verdict of every document."""
    return judge(documents(spark, base), table(spark, base, "labels"))
