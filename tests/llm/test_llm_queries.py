"""Registered queries against their SQL, and the contracts of those without SQL."""

import collections
import hashlib
import math
import re
import zlib

import pytest

from sievelark.llm import queries
from tests.llm.conftest import BASE
from tools.check_queries import close, plain

SQL_NAMES = sorted(queries.SQL)


@pytest.mark.parametrize("name", SQL_NAMES)
def test_query_matches_its_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, BASE)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = duck.execute(queries.SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert len(got) == len(want) and all(close(a, b) for a, b in zip(got, want))


def _docs(spark, base=BASE):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "text").collect()}


def _auc(pairs):
    rank = {v: i for i, v in enumerate(sorted({p for p, _ in pairs}))}
    good, bad = [rank[p] for p, y in pairs if y], [rank[p] for p, y in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))


def test_quality_orders_held_out_documents(spark):
    base = BASE.replace("0.001", "0.01")
    got = {r["doc_id"]: r for r in queries.QUERIES["op1_quality_bradley_terry"](spark, base).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{base}/labels.parquet").collect()}
    assert len(got) == 1000 and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in got.items())
    held = [(got[i]["score"], y) for i, y in labels.items() if got[i]["held_out"]]
    assert _auc(held) > 0.98
    assert sum(got[i]["predicted"] == y for i, y in labels.items() if got[i]["held_out"]) > 0.95 * len(held)


def test_toxicity_orders_held_out_documents(spark):
    base = BASE.replace("0.001", "0.01")
    got = {r["doc_id"]: r for r in queries.QUERIES["op9_toxicity_chain"](spark, base).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{base}/labels.parquet").collect()}
    held = [(got[i]["score"], y) for i, y in labels.items() if got[i]["held_out"]]
    assert len(got) == 1000 and _auc(held) > 0.85
    seen = [i for i in labels if not got[i]["held_out"]]
    assert sum(got[i]["predicted"] == labels[i] for i in seen) > 0.97 * len(seen)


def test_language_model_matches_plain_counts(spark):
    docs = _docs(spark)
    got = {r["doc_id"]: r for r in queries.QUERIES["op2_ngram_trie_lm"](spark, BASE).collect()}
    cut = lambda x: (x or "").encode().lower().split() + [b" "]
    train = [cut(t) for i, t in docs.items() if zlib.crc32(str(i).encode()) % 10]
    one = collections.Counter(w for x in train for w in x)
    two, three = collections.Counter(), collections.Counter()
    for x in train:
        y = [b"<"] + x
        two.update(zip(y, y[1:]))
        three.update(zip(y, y[1:], y[2:]))
    fan1, fan2 = collections.Counter(a for a, _ in two), collections.Counter((a, b) for a, b, _ in three)
    total, kinds = sum(one.values()), len(one)
    context = dict(one) | {b"<": len(train)}
    for i, t in docs.items():
        y = [b"<"] + cut(t)
        base = own = 0.0
        for k in range(1, len(y)):
            p1 = p = (one[y[k]] + 0.1) / (total + 0.1 * (kinds + 1))
            base += math.log10(p1)
            c = context.get(y[k - 1], 0)
            if c:
                p = max(two[y[k - 1], y[k]] - 0.75, 0) / c + 0.75 * fan1[y[k - 1]] / c * p1
            c = two[y[k - 2], y[k - 1]] if k > 1 else 0
            if c:
                p = max(three[tuple(y[k - 2:k + 1])] - 0.75, 0) / c + 0.75 * fan2[y[k - 2], y[k - 1]] / c * p
            own += math.log10(p)
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(y) - 1, sum(one[w] > 0 for w in y[1:]), total)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base))
        assert abs(r["score"] - own) < 0.012 * len(y)  # 8-bit codes


def test_fingerprints(spark):
    docs = _docs(spark)
    got = {r["doc_id"]: r for r in queries.QUERIES["op3_order_minhash"](spark, BASE).collect()}
    ids = sorted(docs, reverse=True)
    by_text = collections.defaultdict(set)
    for i, j in zip(ids, ids[1:] + ids[:1]):
        t, m = docs[i], len(docs[i]) // 3
        edited = t[:len(t) - m] + docs[j][:m]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        by_text[t].add(r["fingerprint"])
        by_text[edited].add(r["edited_fingerprint"])
        assert 0 <= r["near_next"] <= 1
        if len(t) > 400 and docs[j] != t:
            assert r["near_edited"] > 0
    assert all(len(x) == 1 for x in by_text.values())
    long = [r for r in got.values() if r["n_chars"] > 400]
    assert sum(r["near_edited"] for r in long) / len(long) > 0.15 > 0.05 > sum(r["near_next"] for r in long) / len(long)


def test_secrets_keep_the_fixed_patterns(spark):
    docs = _docs(spark)
    got = {r["doc_id"]: r for r in queries.QUERIES["op4_secret_randomness"](spark, BASE).collect()}
    kinds = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8),
             ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32)]
    for i, t in docs.items():
        spans = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(kinds) for m in p.finditer(t) if ok(m))
        text = ",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in spans)
        assert got[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) - {""} <= set(got[i]["spans"].split(","))
