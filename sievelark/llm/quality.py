"""Document quality by Bradley-Terry ranking of preference pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from sievelark.llm.common import documents, each_text, give_back, held_out, store
from sievelark.llm.registry import query
from sievelark.sources.tables import table

#: Labelled rows that take part in the fit, by the smallest hashes of their ids; pairs per row.
SAMPLE, PAIRS_PER_ROW = 12_000, 6
#: Tasks of one pass over the pairs, whose number is bounded.
FIT_TASKS = 4
#: A document is kept at this score and above.
KEEP = 0.3
WIDTH = 256 + 14


def features(text: bytes | None) -> np.ndarray:
    """Shares of byte values (square roots) and shape statistics of a whole text, all bounded for any length."""
    t = text or b""
    x = np.zeros(WIDTH)
    if not t:
        return x
    hist = np.bincount(np.frombuffer(t, np.uint8), minlength=256) / len(t)
    x[:256] = np.sqrt(hist)
    w = t.split()
    n = len(w)
    lines = t.split(b"\n")
    if n:
        pairs = set(zip(w, w[1:]))
        distinct = set(w)
        letters = hist[65:91].sum() + hist[97:123].sum() + hist[128:].sum()
        x[256:] = (hist[65:91].sum() / max(letters, 1e-9), letters, hist[48:58].sum(), len(distinct) / n, math.sqrt(len(distinct) / n), len(pairs) / max(n - 1, 1),
                   sum(a == b for a, b in zip(w, w[1:])) / n, min(len(t) / n, 50) / 10, math.log1p(n) / 10, math.log1p(len(lines)) / 10, len(set(lines)) / len(lines),
                   sum(hist[c] for c in b"%#$&*@~^<>{}[]|\\_=+"), hist[33], sum(hist[c] for c in b".,;:"))
    return x


def raw_scores(batch: pa.RecordBatch, w: np.ndarray) -> np.ndarray:
    """Weighted features of every text, of which a few are held at a time."""
    return np.array([features(t) @ w for t in each_text(batch)], float)


def _featured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and ``x`` for rows with ``text`` last."""
    kind = ", ".join(f"{c} {dict(docs.dtypes)[c]}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([features(t) for t in each_text(batch)]) if batch.num_rows else np.zeros((0, WIDTH))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), WIDTH).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], flat], names=[*keep, "x"])
            give_back()

    return docs.select(*keep, "text").mapInArrow(run, f"{kind}, x array<double>")


def preference_pairs(rows: DataFrame, per_row: int = PAIRS_PER_ROW) -> DataFrame:
    """Feature differences ``d`` with ``won`` 1 or 0: every row of either class meets rows of the other class.

    ``rows`` has ``y`` (1 preferred over 0), ``x`` and ``rank`` (0, 1, ... within its class).
    """
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return rows.sparkSession.createDataFrame([], "won double, d array<double>")
    m = per_row * max(n.values())
    p = rows.sparkSession.range(m)
    p = p.select((F.col("id") % n[1]).alias("i"), ((F.col("id") * 7919 + F.floor(F.col("id") / n[1])) % n[0]).alias("j"), (F.col("id") % 2).cast("double").alias("won"))
    good = rows.where("y = 1").select(F.col("rank").alias("i"), F.col("x").alias("a"))
    bad = rows.where("y = 0").select(F.col("rank").alias("j"), F.col("x").alias("b"))
    sign = F.when(F.col("won") > 0, 1.0).otherwise(-1.0)
    return p.join(good, "i").join(bad, "j").select("won", F.zip_with("a", "b", lambda u, v: (u - v) * sign).alias("d"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Weights of the Bradley-Terry model and the raw score that is the cut.

    ``labels`` has ``doc_id, y``. At most ``sample`` labelled rows take part. The chance that
    one document is preferred to another is the logistic function of the difference of their
    scores, which are linear in :func:`features`; the fit minimises the logistic loss of the
    pairs' feature differences. The cut is the quantile of the rows' scores (of 199 evenly
    spaced ones) with the best balanced accuracy. Without both classes all weights are 0 and
    every document scores 1/2.
    """
    chosen = labels.where("y is not null and doc_id is not null").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "y")), "doc_id")  # bounded by ``sample``
    rows = store(_featured(picked, ["doc_id", "y"]), "quality-rows")
    order = rows.select("doc_id", "y").dropDuplicates(["doc_id"]).toPandas().sort_values(["y", "doc_id"])  # bounded by ``sample``
    order["rank"] = order.groupby("y").cumcount()
    if order["y"].nunique() < 2:
        return np.zeros(WIDTH), -10.0
    spark = docs.sparkSession
    ranks = spark.createDataFrame(order[["doc_id", "rank"]].astype("int64"))
    ranked = rows.dropDuplicates(["doc_id"]).join(F.broadcast(ranks), "doc_id")
    pairs = store(preference_pairs(ranked).select("won", array_to_vector("d").alias("d")), "quality-pairs")
    model = LogisticRegression(featuresCol="d", labelCol="won", fitIntercept=False, regParam=1e-4, maxIter=60).fit(pairs.coalesce(FIT_TASKS))
    w = model.coefficients.toArray()
    scored = rows.select("y", F.aggregate(F.zip_with("x", F.lit(list(map(float, w))), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v).alias("s")).toPandas()
    s, y = scored["s"].to_numpy(), scored["y"].to_numpy()
    cuts = np.quantile(s, np.arange(1, 200) / 200)
    best = [((s[y == 1] >= c).mean() + (s[y == 0] < c).mean(), -abs(i - 100)) for i, c in enumerate(cuts)]
    return w, float(cuts[max(range(len(cuts)), key=best.__getitem__)])


def score(docs: DataFrame, keep: list[str], w: np.ndarray, cut: float) -> DataFrame:
    """Columns ``keep``, ``score`` (0 to 1; KEEP at the cut) and ``predicted``; rows need ``text``."""
    shift = math.log(KEEP / (1 - KEEP)) - cut if w.any() else 0.0
    names = {c: f for c, f in docs.dtypes}
    kind = ", ".join(f"`{c}` {names[c]}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = raw_scores(batch, w) + shift
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(p), pa.array((p >= KEEP).astype(np.int32))], names=[*keep, "score", "predicted"])
            give_back()

    return docs.select(*keep, F.col("text")).mapInArrow(run, f"{kind}, score double, predicted int")


def train_labels(labels: DataFrame, parts: int = 5) -> DataFrame:
    """Labels of the rows that may be learned from."""
    return labels.select("doc_id", F.col("quality").cast("int").alias("y")).where(~held_out(F.col("doc_id"), parts))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that the classifier does not reject, with their columns."""
    w, cut = fit(docs, train_labels(labels))
    schema = docs.schema
    shift = math.log(KEEP / (1 - KEEP)) - cut if w.any() else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = raw_scores(batch, w) + shift
            yield batch.filter(pa.array(z >= math.log(KEEP / (1 - KEEP))))
            give_back()

    return docs.mapInArrow(run, schema)


@query("op1_quality_bradley_terry")
def _(spark, base):
    docs = documents(spark, base)
    w, cut = fit(docs, train_labels(table(spark, base, "labels")))
    s = score(docs.select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "text"), ["doc_id", "held_out"], w, cut)
    return s.select("doc_id", "held_out", "score", "predicted")
