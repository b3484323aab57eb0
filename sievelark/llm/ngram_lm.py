"""A trigram language model in Elias-Fano tries: counted, built and queried by Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from sievelark.llm.common import documents, hash_words, held_out, mix64, raw_texts, shared_folder, words
from sievelark.llm.elias_fano import EliasFano, load, save
from sievelark.llm.registry import query

#: Absolute discount, and the additive constant of the base model.
DISCOUNT, ADD = 0.75, 0.1
#: Tokens a task holds at a time, and tokens per shard of the vocabulary and of the trie.
FLUSH, VOCAB_SHARD, TRIE_SHARD = 1_000_000, 6_000_000, 1_500_000
#: The end of a text is a token; no word contains a blank. Number 0 stands before a text, words count from 1.
END = b" "
NONE = np.uint32(0xFFFFFFFF)


def local_path(uri: str) -> str:
    """Path of a shared folder that is mounted on every machine; levels are memory-mapped from there."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"the trie is memory-mapped: spark.checkpoint.dir must be a mounted folder, not {uri}")
    return uri


def token_hashes(text: bytes | None) -> np.ndarray:
    return hash_words(words(text) + [END])


def _squeeze(*columns: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(c.tobytes() for c in columns))


def _rows(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "data"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Token hashes of texts, up to about FLUSH tokens at a time; the text column is the last."""
    part, held = [], 0
    for batch in batches:
        for t in raw_texts(batch):
            h = token_hashes(t)
            part.append(h)
            held += len(h)
            if held >= FLUSH:
                yield part
                part, held = [], 0
    if part:
        yield part


# ---------------------------------------------------------------- vocabulary

def _count_words(docs: DataFrame, shards: int) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks(batches):
            h, c = np.unique(np.concatenate(part), return_counts=True)
            at = _vocab_shard(h, shards)  # rising with h
            edge = np.searchsorted(at, np.arange(shards + 1))
            yield _rows([(s, _squeeze(h[edge[s]:edge[s + 1]], c[edge[s]:edge[s + 1]].astype(np.int64))) for s in range(shards) if edge[s] < edge[s + 1]])

    return docs.select("text").mapInArrow(emit, "shard int, data binary")


def _vocab_shard(h: np.ndarray, shards: int) -> np.ndarray:
    """Shard by range of the hash, so that shards in order make one sorted vocabulary."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(keys, kind="stable")
    keys, counts = keys[by], counts[by]
    first = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0]
    return keys[first], np.add.reduceat(counts, first)


def _build_vocab(folder: str):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame({"shard": [], "n": [], "total": []}, dtype="int64")
        keys, counts = [], []
        for blob in pdf["data"]:
            x = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint64)
            keys.append(x[:len(x) // 2]), counts.append(x[len(x) // 2:].view(np.int64))
        k, c = _merge(np.concatenate(keys), np.concatenate(counts))
        s = int(pdf["shard"].iat[0])
        save(f"{folder}/vocab/{s}", EliasFano.build(k, 1 << 64).arrays("words") | {"count": c})
        return pd.DataFrame({"shard": [s], "n": [len(k)], "total": [int(c.sum())]})

    return build


# ---------------------------------------------------------------- trie

def _shard_of(u: np.ndarray, v: np.ndarray, shards: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix64(u.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + v.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)


def _triples(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, w) of texts given as word numbers: the begin mark leads, NONE follows the end."""
    u, v, w = [], [], []
    for x in ids:
        y = np.concatenate([[0], x, [NONE]]).astype(np.uint32)
        u.append(y[:-2]), v.append(y[1:-1]), w.append(y[2:])
    return np.concatenate(u), np.concatenate(v), np.concatenate(w)


def _count_ngrams(docs: DataFrame, model: "Model") -> DataFrame:
    """Distinct (u, v, w) with counts per task, packed by trie shard."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks(batches):
            flat = np.concatenate(part)
            known, at = np.unique(flat, return_inverse=True)
            number = (model.lookup(known)[0] + 1).astype(np.uint32)[at]
            cut = np.cumsum([len(p) for p in part])[:-1]
            u, v, w = _triples(np.split(number, cut))
            pair = (u.astype(np.uint64) << np.uint64(32)) | v
            by = np.lexsort((w, pair))
            pair, w = pair[by], w[by]
            first = np.nonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (w[1:] != w[:-1])]))[0]
            c = np.diff(np.concatenate([first, [len(pair)]])).astype(np.uint32)
            pair, w = pair[first], w[first]
            u, v = (pair >> np.uint64(32)).astype(np.uint32), pair.astype(np.uint32)
            s = _shard_of(u, v, model.shards)
            by = np.argsort(s.astype(np.uint16 if model.shards < 1 << 16 else np.int64), kind="stable")
            s, u, v, w, c = s[by], u[by], v[by], w[by], c[by]
            edge = np.searchsorted(s, np.arange(model.shards + 1))
            yield _rows([(k, _squeeze(np.diff(u[a:b], prepend=u.dtype.type(0)), v[a:b], w[a:b], c[a:b])) for k in range(model.shards) for a, b in [(edge[k], edge[k + 1])] if a < b])

    return docs.select("text").mapInArrow(emit, "shard int, data binary")


def _quantise(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """8-bit codes and a codebook of log10 values: exact up to 256 distinct values, else means of 256 equal steps."""
    values, at = np.unique(p, return_inverse=True)
    if len(values) <= 256:
        return at.astype(np.uint8), np.log10(np.maximum(values, 1e-30)) if len(values) else np.zeros(1)
    logs = np.log10(np.maximum(p, 1e-30))
    low = logs.min()
    step = (logs.max() - low) / 256
    code = np.minimum((logs - low) / step, 255).astype(np.int64)
    n = np.bincount(code, minlength=256)
    return code.astype(np.uint8), np.where(n > 0, np.bincount(code, logs, minlength=256) / np.maximum(n, 1), 0.0)


def _build_trie(model: "Model"):
    """One shard's levels; returns how many distinct words follow each word there, packed by vocabulary shard."""
    folder = model.folder

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame({"shard": pd.Series(dtype="int32"), "data": pd.Series(dtype=object)})
        cols = [[], [], [], []]
        for blob in pdf["data"]:
            x = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint32).reshape(4, -1)
            cols[0].append(np.cumsum(x[0], dtype=np.uint32))
            for k in (1, 2, 3):
                cols[k].append(x[k])
        u, v, w, c = (np.concatenate(x) for x in cols)
        by = np.lexsort((w, (u.astype(np.uint64) << np.uint64(32)) | v))
        u, v, w, c = u[by].astype(np.int64), v[by].astype(np.int64), w[by], c[by].astype(np.int64)
        first = np.nonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1]) | (w[1:] != w[:-1])]))[0]
        u, v, w, c = u[first], v[first], w[first], np.add.reduceat(c, first)
        pair = np.nonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])]))[0]
        pu, pv, pc = u[pair], v[pair], np.add.reduceat(c, pair)
        real = w != NONE
        kids = np.add.reduceat(real.astype(np.int64), pair)
        node = np.repeat(np.arange(len(pair)), np.diff(np.concatenate([pair, [len(u)]])))
        head = np.nonzero(np.concatenate([[True], pu[1:] != pu[:-1]]))[0]
        roots, fan = pu[head], np.diff(np.concatenate([head, [len(pu)]]))
        # what stands before: texts for the begin mark, else the word's count
        seen = np.where(roots == 0, model.texts, model.counts(np.maximum(roots - 1, 0)))
        p2, book2 = _quantise((pc - DISCOUNT) / np.repeat(seen, fan))
        back, book_back = _quantise(DISCOUNT * kids / pc)
        p3, book3 = _quantise((c[real] - DISCOUNT) / pc[node[real]])
        size = model.words + 2
        s = int(pdf["shard"].iat[0])
        rank = np.repeat(np.arange(len(roots)), fan)
        save(f"{folder}/trie/{s}", EliasFano.build(roots, size).arrays("l1") | EliasFano.build(np.concatenate([[0], np.cumsum(fan)]), len(pu) + 1).arrays("to2")
             | EliasFano.build(rank * size + pv, len(roots) * size).arrays("l2") | EliasFano.build(np.concatenate([[0], np.cumsum(kids)]), int(real.sum()) + 1).arrays("to3")
             | EliasFano.build(node[real] * size + w[real].astype(np.int64), len(pair) * size).arrays("l3")
             | {"p2": p2, "back": back, "p3": p3, "width": np.array([size]), "book2": book2, "book_back": book_back, "book3": book3})
        at = np.searchsorted(model.base, np.maximum(roots - 1, 0), side="right") - 1
        at = np.where(roots == 0, -1, at)
        return pd.DataFrame([(int(k), _squeeze(roots[at == k], fan[at == k])) for k in np.unique(at)], columns=["shard", "data"]).astype({"shard": "int32"})

    return build


def _build_followers(folder: str, base: np.ndarray):
    """Per vocabulary shard the number of distinct followers of its words."""
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame({"shard": [], "n": []}, dtype="int64")
        s = int(pdf["shard"].iat[0])
        total = np.zeros(1 if s < 0 else int(base[s + 1] - base[s]), np.int64)
        for blob in pdf["data"]:
            x = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.int64).reshape(2, -1)
            np.add.at(total, x[0] if s < 0 else x[0] - 1 - base[s], x[1])
        if s >= 0:
            save(f"{folder}/followers/{s}", {"n": total.astype(np.uint32)})
        return pd.DataFrame({"shard": [s], "n": [int(total.sum())]})

    return build


def followers(path: str, word: int) -> list[int]:
    """Numbers of the words that follow ``word`` in one shard: the entries between its two pointers, less its offset."""
    parts = load(path)
    l1, l2, to2 = (EliasFano.load(parts, x) for x in ("l1", "l2", "to2"))
    r = l1.find(np.array([word]))
    if r[0] < 0:
        return []
    a, b = (int(to2.get(r + k)[0]) for k in (0, 1))
    return [int(x) for x in l2.get(np.arange(a, b)) - np.uint64(int(r[0]) * int(parts["width"][0]))]


class Model:
    """Where the levels lie and the few totals a task needs; the levels themselves are memory-mapped by tasks."""

    def __init__(self, folder: str, base: np.ndarray, tokens: int, texts: int, shards: int) -> None:
        self.folder, self.base, self.tokens, self.texts, self.shards = folder, base, tokens, texts, shards
        self.words, self.first_fan = int(base[-1]), 0

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (-1: unknown) and count of sorted word hashes."""
        n = len(self.base) - 1
        rank, count = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        edge = np.searchsorted(_vocab_shard(h, n), np.arange(n + 1))
        for s in range(n):
            a, b = edge[s], edge[s + 1]
            if a < b and self.base[s] < self.base[s + 1]:
                parts = _mapped(f"{self.folder}/vocab/{s}")
                i = EliasFano.load(parts, "words").find(h[a:b])
                ok = i >= 0
                rank[a:b][ok] = i[ok] + self.base[s]
                count[a:b][ok] = parts["count"][i[ok]]
        return rank, count

    def _of(self, kind: str, field: str, rank: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rank), np.int64)
        s = np.searchsorted(self.base, rank, side="right") - 1
        for k in np.unique(s):
            if 0 <= k < len(self.base) - 1:
                at = s == k
                out[at] = _mapped(f"{self.folder}/{kind}/{k}")[field][rank[at] - self.base[k]]
        return out

    def counts(self, rank: np.ndarray) -> np.ndarray:
        return self._of("vocab", "count", rank)

    def followers(self, rank: np.ndarray) -> np.ndarray:
        return self._of("followers", "n", rank)

    def score(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, known tokens, base log10 and model log10 per text of token hashes."""
        flat = np.concatenate(texts)
        size = np.array([len(t) for t in texts])
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        known, at = np.unique(flat, return_inverse=True)
        rank, count = self.lookup(known)
        one = (count + ADD) / (self.tokens + ADD * (self.words + 1))
        fan = np.where(rank >= 0, self.followers(np.maximum(rank, 0)) if self.words else 0, 0)
        back1 = np.where(count > 0, DISCOUNT * fan / np.maximum(count, 1), 1.0)
        w = (rank + 1)[at]
        before = np.empty(len(flat), np.int64)
        before[1:], before[start] = w[:-1], 0
        back = np.empty(len(flat))
        back[1:], back[start] = back1[at][:-1], (DISCOUNT * self.first_fan / self.texts if self.texts else 1.0)
        p1 = one[at]
        # unknown words are 0 too, but only as a text's begin may 0 be a context
        context = (before > 0) | np.isin(np.arange(len(flat)), start)
        p2, p3, back2, node = np.zeros(len(flat)), np.zeros(len(flat)), np.zeros(len(flat)), np.zeros(len(flat), bool)
        ask = np.nonzero(context & (w > 0))[0]
        last = np.zeros(len(flat), bool)
        last[start + size - 1] = True
        if len(ask):
            s = _shard_of(before[ask], w[ask], self.shards)
            by = np.argsort(s, kind="stable")
            ask, s = ask[by], s[by]
            edge = np.searchsorted(s, np.arange(self.shards + 1))
            for k in range(self.shards):
                q = ask[edge[k]:edge[k + 1]]
                if not len(q):
                    continue
                parts = _mapped(f"{self.folder}/trie/{k}", missing=True)
                if parts is None:
                    continue
                l1, l2, l3 = (EliasFano.load(parts, x) for x in ("l1", "l2", "l3"))
                width = self.words + 2
                r = l1.find(before[q])
                q, r = q[r >= 0], r[r >= 0]
                if not len(q):
                    continue
                # entries are numbered from their context's offset on, so the search starts and ends among its children
                n = l2.find(r * width + w[q])
                q, n = q[n >= 0], n[n >= 0]
                if not len(q):
                    continue
                p2[q] = (10 ** parts["book2"])[parts["p2"][n]]
                back2[q] = (10 ** parts["book_back"])[parts["back"][n]]
                node[q] = True
                more = ~last[q]
                q, n = q[more] + 1, n[more]
                more = w[q] > 0
                q, n = q[more], n[more]
                if len(q):
                    c = l3.find(n * width + w[q])
                    p3[q[c >= 0]] = (10 ** parts["book3"])[parts["p3"][c[c >= 0]]]
        p2 = np.where(context, p2 + back * p1, p1)
        seen = np.zeros(len(flat), bool)
        seen[1:] = node[:-1] & ~last[:-1]
        prior = np.ones(len(flat))
        prior[1:] = back2[:-1]
        p = np.where(seen, p3 + prior * p2, p2)
        total = lambda x: np.add.reduceat(x, start)
        return size, total((count[at] > 0).astype(np.int64)), total(np.log10(p1)), total(np.log10(np.maximum(p, 1e-300)))


@lru_cache(maxsize=256)
def _cached(path: str) -> dict[str, np.ndarray]:
    return load(path)


def _mapped(path: str, missing: bool = False) -> dict[str, np.ndarray] | None:
    try:
        return _cached(path)
    except FileNotFoundError:
        if missing:
            return None
        raise


def train(docs: DataFrame) -> Model:
    """Train on the ``text`` of all rows; null counts as the empty text.

    Tasks count words, then trigrams, in packed columns of distinct entries, and exchange them
    by shard: the vocabulary by range of the word's hash, trigrams by a hash of the first two
    words, so even a very frequent word spreads. Each shard is built in one task of bounded
    size into a file of the shared folder: words, bigrams and trigrams as Elias-Fano sequences
    whose entries are numbered relative to their context, monotone pointers, and 8-bit codes
    of discounted probabilities and back-off weights (interpolated absolute discounting).
    Shards grow in number, not in size, with the corpus. Empty tables give an empty model.
    """
    spark = docs.sparkSession
    folder = local_path(shared_folder(spark, "lm"))
    volume, texts = docs.agg(F.sum(F.length("text")), F.count(F.lit(1))).first()
    tokens = int((volume or 0) / 6) + texts
    pieces = max(1, -(-tokens // VOCAB_SHARD))
    shards = max(1, -(-tokens // TRIE_SHARD))
    got = _count_words(docs, pieces).groupBy("shard").applyInPandas(_build_vocab(folder), "shard int, n long, total long").toPandas()
    sizes = np.zeros(pieces, np.int64)
    sizes[got["shard"].to_numpy(int)] = got["n"].to_numpy()
    base = np.concatenate([[0], np.cumsum(sizes)])
    if base[-1] >= int(NONE) - 1:
        raise ValueError("the vocabulary exceeds 32 bits")
    model = Model(folder, base, int(got["total"].sum()), texts, shards)
    parts = _count_ngrams(docs, model).groupBy("shard").applyInPandas(_build_trie(model), "shard int, data binary")
    fans = parts.groupBy("shard").applyInPandas(_build_followers(folder, base), "shard int, n long").toPandas()
    model.first_fan = int(fans.loc[fans["shard"] < 0, "n"].sum())
    return model


def score(docs: DataFrame, keep: list[str], model: Model) -> DataFrame:
    """Columns ``keep`` with ``n_tokens, n_known, train_tokens, base_score, score`` of every whole text."""
    names = dict(docs.dtypes)
    kind = ", ".join(f"`{c}` {names[c]}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, a, held = [], 0, 0
            texts = raw_texts(batch)
            for r, t in enumerate(texts):
                part.append(token_hashes(t))
                held += len(part[-1])
                if held >= FLUSH or r + 1 == len(texts):
                    n, known, base, own = model.score(part)
                    made = [pa.array(x) for x in (n.astype(np.int64), known, np.full(len(part), model.tokens, np.int64), base, own)]
                    yield pa.RecordBatch.from_arrays([*[c.slice(a, len(part)) for c in batch.columns[:len(keep)]], *made], names=[*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score"])
                    a, part, held = r + 1, [], 0

    return docs.select(*keep, "text").mapInArrow(run, f"{kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


@query("op2_ngram_trie_lm")
def _(spark, base):
    docs = documents(spark, base).select("doc_id", held_out(F.col("doc_id"), 10).alias("held_out"), "text")
    return score(docs, ["doc_id", "held_out"], train(docs.where(~F.col("held_out"))))
