"""Toxicity by classifier chains of linear models."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, functions as F

from sievelark.llm.common import documents, held_out, raw_texts, store
from sievelark.llm.quality import WIDTH, features
from sievelark.llm.registry import query
from sievelark.sources.tables import table

#: Labelled rows that take part in the fit, by the smallest hashes of their ids; folds; texts that must share a feature.
SAMPLE, FOLDS, MIN_TEXTS = 12_000, 3, 8
#: Word features of the model, the most telling ones: weights and gradients stay small whatever the vocabulary.
WIDEST = 20_000
#: Tasks of one pass over the sample; the sample is bounded, so a fixed number will do.
FIT_TASKS = 4
PREFIXES = (4, 5, 6, 7)
SPACE = 1 << 22
_WORD = re.compile(r"[^\W\d_]+")


def distinct_words(text: bytes | None) -> set[str]:
    return set(_WORD.findall(text.decode("utf-8", "replace").lower())) if text else set()


class _Features(dict):
    """Word -> hashed numbers of the word and its prefixes, kept up to a bound."""

    def __init__(self, known: np.ndarray | None = None) -> None:
        super().__init__()
        self.at = None if known is None else {int(k): i for i, k in enumerate(known)}

    def __missing__(self, w: str) -> tuple[int, ...]:
        if len(self) >= 200_000:
            self.clear()
        made = {xxhash.xxh3_64_intdigest("w" + w) % SPACE} | {xxhash.xxh3_64_intdigest("p" + w[:k]) % SPACE for k in PREFIXES if len(w) >= k}
        self[w] = got = tuple(made) if self.at is None else tuple(self.at[m] for m in made if m in self.at)
        return got

    def of(self, text: bytes | None) -> set[int]:
        out: set[int] = set()
        for w in distinct_words(text):
            out.update(self[w])
        return out


class Chain:
    """Per category, in order, linear weights over word features, shape features, and the earlier categories' chances."""

    def __init__(self, names: list[str], known: np.ndarray) -> None:
        self.names, self.known, self.links, self.cuts = names, known, [], []

    def chances(self, texts: list[bytes | None]) -> np.ndarray:
        words, n = _Features(self.known), len(self.known)
        out = np.zeros((len(texts), len(self.links)))
        for r, t in enumerate(texts):
            ids = np.fromiter(words.of(t), np.int64)
            x = features(t)
            for k, (w, b) in enumerate(self.links):
                z = b + w[ids].sum() + w[n:n + WIDTH] @ x + w[n + WIDTH:] @ out[r, :k]
                out[r, k] = 1 / (1 + math.exp(-min(40, max(-40, z))))
        return out


def fit_chain(docs: DataFrame, labels: DataFrame, names: list[str], sample: int = SAMPLE) -> Chain:
    """Fit one logistic regression per category of ``labels`` (``doc_id`` and the 0/1 columns ``names``).

    At most ``sample`` labelled rows take part. A later model sees the earlier categories'
    chances as features; in training those are out-of-fold predictions of models that have not
    seen the row, else later links would trust them too much. Word features that fewer than
    MIN_TEXTS texts share are left out; of the rest the WIDEST most telling ones take part. ``cuts`` has, per category, the chance with the best F1
    over out-of-fold predictions. A category with one class only gets chance 0 or 1.
    """
    spark = docs.sparkSession
    ok = F.lit(True)
    for c in names:
        ok = ok & F.col(c).isNotNull()
    chosen = labels.where(ok & F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", *names)), "doc_id")  # bounded by ``sample``

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Features()
        for batch in batches:
            texts = raw_texts(batch)
            ids = [sorted(words.of(t)) for t in texts]
            x = [features(t).tolist() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(ids, pa.list_(pa.int32())), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", *names, "ids", "x"])

    kind = dict(docs.dtypes)["doc_id"]
    flags = ", ".join(f"{c} int" for c in names)
    made = picked.select("doc_id", "text", *[F.col(c).cast("int").alias(c) for c in names]).mapInArrow(run, f"doc_id {kind}, {flags}, ids array<int>, x array<double>")
    rows = store(made.dropDuplicates(["doc_id"]), "toxic-rows")
    known = _telling(rows, names)
    chain = Chain(names, known)
    n = len(known)

    def vector(ids, x, earlier):
        at = np.searchsorted(known, ids) if len(known) else np.zeros(0, int)
        at = [int(a) for a, i in zip(at, ids) if a < n and known[a] == i]
        values = [1.0] * len(at) + list(x) + list(earlier)
        return Vectors.sparse(n + WIDTH + len(earlier), at + list(range(n, n + WIDTH + len(earlier))), values)

    to_vector = F.udf(vector, VectorUDT())
    held = rows.withColumn("earlier", F.array().cast("array<double>")).withColumn("fold", F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(1009)) % FOLDS)
    for k, c in enumerate(names):
        train = store(held.select("doc_id", "fold", F.col(c).cast("double").alias("label"), to_vector("ids", "x", "earlier").alias("v")), f"toxic-link{k}")
        chain.links.append(_logistic(train, n + WIDTH + k))
        unseen = None
        for f in range(FOLDS):
            w, b = _logistic(train.where(F.col("fold") != f), n + WIDTH + k)
            part = train.where(F.col("fold") == f).select("doc_id", _chance(w, b)("v").alias("p"))
            unseen = part if unseen is None else unseen.unionByName(part)
        unseen = store(unseen, f"toxic-unseen{k}")
        chain.cuts.append(_cut(unseen.join(train.select("doc_id", "label"), "doc_id").select("p", "label").toPandas()))  # bounded by ``sample``
        held = held.join(unseen, "doc_id").withColumn("earlier", F.concat("earlier", F.array("p"))).drop("p")
    return chain


def _telling(rows: DataFrame, names: list[str]) -> np.ndarray:
    """Word features of MIN_TEXTS texts and more, the WIDEST most telling ones by chi-squared with any category, sorted."""
    total = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in names]).first()
    seen = rows.select(F.explode("ids").alias("i"), *names).groupBy("i").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in names]).where(F.col("n") >= MIN_TEXTS)
    worth = F.lit(0.0)
    for c in names:
        n, y = float(total["n"] or 0), float(total[c] or 0)
        if 0 < y < n:
            # (observed - expected)^2 over its variance; the same factor of n for all features
            worth = F.greatest(worth, F.pow(F.col(c) * n - F.col("n") * y, 2) / (F.col("n") * (n + 1 - F.col("n")) * y * (n - y)))
    best = seen.select("i", worth.alias("worth")).orderBy(F.desc("worth"), "i").limit(WIDEST)
    return np.sort(best.select("i").toPandas()["i"].to_numpy(np.int64))


def _cut(rows) -> float:
    """The chance from which a category is predicted: the best F1 over out-of-fold chances, 1/2 without both classes."""
    by = rows.sort_values("p", ascending=False)
    y, p = by["label"].to_numpy(), by["p"].to_numpy()
    if len(set(y)) < 2:
        return 0.5
    hit = np.cumsum(y)
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    best = int(np.argmax(f1))
    return float((p[best] + p[min(best + 1, len(p) - 1)]) / 2)


def _logistic(train: DataFrame, width: int) -> tuple[np.ndarray, float]:
    seen = [r["label"] for r in train.select("label").distinct().collect()]
    if len(seen) < 2:
        return np.zeros(width), (30.0 if seen == [1.0] else -30.0)
    model = LogisticRegression(featuresCol="v", labelCol="label", regParam=0.003, standardization=False, maxIter=60).fit(train.coalesce(FIT_TASKS))
    return model.coefficients.toArray(), float(model.intercept)


def _chance(w: np.ndarray, b: float):
    return F.udf(lambda v: float(1 / (1 + math.exp(-min(40, max(-40, v.dot(w) + b))))), "double")


def chances(docs: DataFrame, keep: list[str], chain: Chain) -> DataFrame:
    """Columns ``keep`` and one chance per category, named after it, from every whole text (null counts as empty)."""
    names = dict(docs.dtypes)
    kind = ", ".join([f"`{c}` {names[c]}" for c in keep] + [f"`{c}` double" for c in chain.names])
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.chances(raw_texts(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], *[pa.array(p[:, k]) for k in range(p.shape[1])]], names=[*keep, *chain.names])

    return docs.select(*keep, "text").mapInArrow(run, kind)


#: Categories in the chain's order: what is unusable in any case comes first.
CATEGORIES = ["junk", "toxic"]


@query("op9_toxicity_chain")
def _(spark, base):
    docs = documents(spark, base).select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "text")
    labels = table(spark, base, "labels").where(~held_out(F.col("doc_id"), 5)).select("doc_id", (1 - F.col("quality")).alias("junk"), "toxic")
    chain = fit_chain(docs, labels, CATEGORIES)
    p = chances(docs, ["doc_id", "held_out"], chain)
    return p.select("doc_id", "held_out", F.col("junk").alias("p_junk"), F.col("toxic").alias("score"), (F.col("toxic") >= chain.cuts[-1]).cast("int").alias("predicted"))
