"""Token alignment, rule forest and collocations against brute force, with odd rows and empty tables."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sievelark.llm import collocations as C
from sievelark.llm import rule_forest as R
from sievelark.llm import token_align as T

from tests.llm.conftest import BASE


# --- op11 --------------------------------------------------------------------

def aligned_by_hand(docs):
    """Whole texts through both libraries, aligned token by token."""
    a = Tokenizer.from_file(f"{T.TOKENIZERS}/{T.A_FILE}")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{T.TOKENIZERS}/{T.B_FILE}")
    alphabet, counts, done = T._byte_alphabet(), Counter(), []
    for key, text in docs:
        if not text:
            done.append((key, None))
            continue
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bx = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in x]
        by = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if not b"".join(bx) == b"".join(by) == (" " + text).encode():
            done.append((key, None))
            continue
        ends = lambda parts: np.cumsum(list(map(len, parts)))
        ex, ey = ends(bx), ends(by)
        links = [(x[np.searchsorted(ex, e)], y[np.searchsorted(ey, e)]) for e in sorted({*ex.tolist(), *ey.tolist()})]
        cut = sorted({*ex.tolist()} & {*ey.tolist()})
        groups, low = [], 0
        for e in cut:
            groups.append(([i for i, z in zip(x, ex) if low < z <= e], [i for i, z in zip(y, ey) if low < z <= e]))
            low = e
        counts.update(links)
        done.append((key, (x, y, groups, links)))
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    out = []
    for key, r in done:
        if r is None:
            out.append((key, 0, 0, 0, 0, 0, 0, ""))
            continue
        x, y, groups, links = r
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((key, len(x), len(y), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest()))
    return out, counts


ODD_TEXTS = [None, "", " ", "a", "a ", "a  ", " a", "a  b\n c  d é é  x　 y", "▁x", "<s> <|endoftext|> <unk> <0x41>", "x" * 3000, "日本 語 テ́ x\x00 y", "it's 'll  \t z", "\n", "a b", "a b", "ﬁ ½ Å", "  \n  b c", "x  y  z"]


@pytest.mark.parametrize("small", [False, True])
def test_alignment_equals_whole_texts(spark, monkeypatch, small):
    """Every odd text and the documents of the smallest table, in one chunk and in many with few pieces at a time."""
    if small:
        monkeypatch.setattr(T, "CHUNK_BYTES", 20_000)
        monkeypatch.setattr(T, "SLICE", 64)
        monkeypatch.setattr(T, "AT_ONCE", 7)
    docs = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(3, "repeated id"), (None, "no id")]
    docs += [(r["doc_id"] + 1000, r["text"]) for r in spark.read.parquet(f"{BASE}/documents.parquet").orderBy("doc_id").limit(40 if small else 200).collect()]
    # names of the operator's own columns clash
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"chunk": F.lit(1), "links": F.lit("x"), "ids": F.lit(2), "n_a": F.lit(None).cast("string")}).repartition(3)
    want, counts = aligned_by_hand(docs)
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    assert order(T.align(df).collect()) == order(want)
    if not small:
        assert {(r["a_id"], r["b_id"]): r["links"] for r in T.pair_counts(df).collect()} == counts


def test_alignment_of_nothing(spark, nothing):
    assert T.align(nothing).count() == 0 and T.pair_counts(nothing).count() == 0


def test_pieces_are_cut_alike():
    """Both ways of cutting give the same pieces, and pieces joined by blanks are the text."""
    for t in map(str.encode, filter(None, ODD_TEXTS)):
        parts = [p for part in T.pieces_of(t) for p in part]
        assert b" ".join(parts) == t and parts == T._CUT.split(t)


# --- op12 --------------------------------------------------------------------

def counts_by_hand(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    runs = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    hit = {i + k for i in range(len(words) - 7) if runs[tuple(words[i:i + 8])] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)]


def test_rule_counts(spark, odd):
    rows = [r["text"] for r in spark.read.parquet(f"{BASE}/documents.parquet").collect()] + [r["text"] for r in odd.collect()]
    rows += ["a b c d e f g h a b c d e f g h", "x " * 30, "a b c d e f g h i a b c d e f g h", "l\nl\n \n \nl", "1 2 3 4 5 6 7 8 9 2 3 4 5 6 7 8 9 2 3 4 5 6 7 8"]
    for t in rows:
        assert R.statistics(None if t is None else t.encode())[0] == counts_by_hand(t)


def path_by_hand(tree, x):
    node = 0
    while tree["feature"][node] >= 0:
        node = tree["left"][node] + (x[tree["feature"][node]] > tree["cut"][node])
    return tree["path"][node]


def test_forest_verdicts(spark):
    """The whole verdict from lists: sample by hash order, trees, mean paths, threshold."""
    docs, labels = (spark.read.parquet(f"{BASE}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in R.judge(docs, labels).collect()}
    rows = [(r["doc_id"], *R.statistics(None if r["text"] is None else r["text"].encode()), r["h"]) for r in docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h")).collect()]
    failed = {k: c[0] < 20 or 100 * c[4] > 30 * c[0] for k, c, _, _ in rows}
    y = {r["doc_id"]: r["quality"] for r in labels.collect()}
    sample = sorted((h, k, x) for k, _, x, h in rows if k in y and not failed[k])
    x = np.array([s for *_, s in sample])
    trees = [R.grow_tree(x, t) for t in range(R.TREES)]
    norm = float(R.average_path(min(len(x), R.ROWS_PER_TREE)))
    score = {k: round(2 ** (-np.mean([path_by_hand(t, s) for t in trees]) / norm), 4) for k, _, s, _ in rows}
    good, bad = ([score[k] for k in y if k in score and not failed[k] and y[k] == v] for v in (1, 0))
    cuts = sorted({*good, *bad})
    share = lambda part, c: sum(s > c for s in part) / len(part)
    cut = max((c for c in cuts if share(good, c) <= R.LOSS + 1e-12), key=lambda c: (share(bad, c) - share(good, c), -c))
    assert all(abs(got[k]["anomaly"] - score[k]) < 2e-4 for k in score)
    assert {k: r["kept"] for k, r in got.items()} == {k: not failed[k] and got[k]["anomaly"] <= cut for k in score}
    assert all(r["base_failed"] == failed[k] for k, r in got.items())
    # it tells labelled rows apart
    assert share(bad, cut) > 0.8 and share(good, cut) <= R.LOSS


def test_forest_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(5, 1), (6, 0), (6, 1), (8, 1), (None, 1), (9, None), (77, 0)], "doc_id long, quality int")
    got = R.judge(odd, labels).collect()
    assert len(got) == odd.count() and all(not r["kept"] for r in got if r["n_words"] < 20)
    # no labels: only the base rules speak
    plain = R.judge(odd, labels.limit(0)).collect()
    assert all(r["kept"] == (not r["base_failed"]) and r["anomaly"] == 0.0 for r in plain)
    assert R.judge(nothing, labels).count() == 0 and R.judge(nothing, labels.limit(0)).count() == 0
    other = R.judge(odd.withColumnsRenamed({"doc_id": "x", "text": "y"}).withColumn("doc_id", F.lit("clash")), labels, id="x", text="y")
    assert sorted(map(repr, (tuple(r) for r in other.collect()))) == sorted(map(repr, (tuple(r) for r in got)))


# --- op13 --------------------------------------------------------------------

def phrases_by_hand(docs, least, limit):
    """The contract's rules over plain dictionaries."""
    f = {}
    for lang, text in docs:
        c = f.setdefault("und" if lang is None else lang, Counter())
        low = (text or "").translate({i: i + 32 for i in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            for k in range(1, 5):
                c.update(w[i:i + k] for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        n = sum(v for g, v in c.items() if len(g) == 1)
        cand = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        over = Counter()
        for g, a in cand.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    over[g[i:i + k]] = max(over[g[i:i + k]], a)
        rows = []
        for g, a in cand.items():
            if 100 * over[g] >= 80 * a:
                continue
            score, _, left, right = min((2_000_000 * a // (c[g[:k]] + c[g[k:]]), k, c[g[:k]], c[g[k:]]) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:limit], 1)]
    return sorted(out)


@pytest.mark.parametrize("limit,first,chunk", [(2000, 2, 12 << 20), (7, 1, 3_000)])
def test_collocations(spark, monkeypatch, limit, first, chunk):
    """One round or many, one chunk or many: the same phrases as by hand."""
    monkeypatch.setattr(C, "FIRST", first)
    monkeypatch.setattr(C, "FURTHER", 2)
    monkeypatch.setattr(C, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(C, "ROW", 50)
    monkeypatch.setattr(C, "DIRECT", 2_000_000 if first == 2 else 3)
    monkeypatch.setattr(C, "CHUNKS_PER_SALT", 64 if first == 2 else 1)
    rng = np.random.default_rng(limit)
    words = [f"w{i}" for i in range(12)] + ["É", "New", "york", "x.y"]
    fixed = ["New york city hall", "w1 w2 w3", "w4 w5", "a b a b a"]
    docs = []
    for i in range(100):
        parts = [fixed[rng.integers(len(fixed))] if rng.random() < 0.4 else " ".join(rng.choice(words, rng.integers(1, 6))) for _ in range(10)]
        docs.append((["en", "fr", None, "und"][rng.integers(4)], "".join(p + str(rng.choice([" ", ", ", "\n", "\t", ". "])) for p in parts)))
    docs += [("en", None), ("de", ""), (None, "  \t"), ("en", docs[0][1]), ("en", docs[0][1])]
    df = spark.createDataFrame(docs, "lang string, text string").withColumns({"gid": F.lit(1), "a": F.lit("x"), "chunk": F.lit(2), "score": F.lit(0), "phrase": F.lit("p")}).repartition(3)
    got = sorted(map(tuple, C.collocations(df, least=6, limit=limit).collect()))
    want = phrases_by_hand(docs, 6, limit)
    assert got == want and any(len(r[2].split()) > 2 for r in want) == any(len(r[2].split()) > 2 for r in got)


def test_collocations_match_sql(spark, duck):
    got = sorted(map(tuple, C.op13_collocations(spark, BASE).collect()))
    assert got == sorted(duck.execute(C.SQL).fetchall())


def test_collocations_of_nothing(spark, nothing, odd):
    assert C.collocations(nothing).count() == 0
    assert C.collocations(odd.where("text IS NULL OR text = ''")).count() == 0
    assert {r["lang"] for r in C.collocations(odd, least=2).collect()} <= {"en", "und"}


def test_scores_beyond_64_bits(spark):
    """2,000,000 times a count of 10^13 passes 64 bits."""
    a = 10 ** 13 + 7
    df = spark.createDataFrame([(a, a, a + 5)], "a long, l long, r long")
    assert df.select(C._div(F.col("a"), F.col("l") + F.col("r"))).first()[0] == 2_000_000 * a // (2 * a + 5)
