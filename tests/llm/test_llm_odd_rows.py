"""Nulls, empty and long texts, ties, repeats, empty tables and clashing column names: every operator has a defined result."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelark.llm import decontaminate, jaccard, licenses, line_dedup, mixing, ngram_lm, order_minhash, quality, queries, secrets, toxicity
from tests.llm.conftest import LONG, PASSAGE

N = 13


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality(spark, odd, nothing):
    labels = _labels(spark, [(1, 1, 0), (1, 1, 0), (5, 0, 1), (7, None, 0), (None, 1, 1), (8, 1, 0), (9, 0, 0)])
    w, cut = quality.fit(odd, labels.select("doc_id", F.col("quality").alias("y")))
    assert quality.score(odd, ["doc_id"], w, cut).count() == N
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns and kept.count() <= N
    w, cut = quality.fit(nothing, labels.select("doc_id", F.col("quality").alias("y")))
    assert not w.any() and quality.score(nothing, ["doc_id"], w, cut).count() == 0
    assert {r["score"] for r in quality.score(odd, ["doc_id"], w, cut).collect()} == {0.5}


def test_pairs_span_both_classes(spark):
    rows = spark.createDataFrame([(i % 2, i // 2, [float(i)]) for i in range(9)], "y int, rank int, x array<double>")
    p = quality.preference_pairs(rows, 4).collect()
    assert len(p) == 20 and {r["won"] for r in p} == {0.0, 1.0}


def test_language_model(spark, odd, nothing):
    got = ngram_lm.score(odd, ["doc_id"], ngram_lm.train(odd)).collect()
    assert len(got) == N and all(r["n_tokens"] == r["n_known"] >= 1 and r["score"] <= 0 for r in got)
    empty = ngram_lm.train(nothing)
    got = ngram_lm.score(odd, ["doc_id"], empty).collect()
    assert len(got) == N and all(r["n_known"] == 0 and r["base_score"] == r["score"] == 0 for r in got)
    assert ngram_lm.score(nothing, ["doc_id"], empty).count() == 0


def test_fingerprints(spark, odd, nothing):
    got = order_minhash.edited_pairs(odd).collect()
    assert len(got) == N
    by = {r["doc_id"]: r for r in got}
    assert by[5]["fingerprint"] == by[6]["fingerprint"] and by[2]["fingerprint"] == by[3]["fingerprint"] and by[2]["n_chars"] == 0
    assert by[6]["near_next"] == 1.0
    assert order_minhash.edited_pairs(nothing).count() == 0


def test_fingerprint_numbers_repeats(spark):
    df = spark.createDataFrame([(0, "a b c"), (1, "a b c a b c a b c a b c"), (2, "c b a"), (3, "a b c")], "i int, t string")
    s = {r["i"]: r["s"] for r in order_minhash.with_signature(df, "t", "s").collect()}
    assert s[0] == s[3] != s[2] and len(s[1]) > len(s[0])


def test_secrets(spark, odd, nothing):
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(odd).collect()}
    assert got[2] == got[3] == got[4] == [] and got[7] == [[8, 29, 0]]
    assert secrets.scan(nothing).count() == 0


def test_secrets_find_random_runs_and_leave_words(spark):
    rng = np.random.default_rng(5)
    alphabet = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    runs = ["".join(rng.choice(alphabet, 32)) for _ in range(30)]
    prose = "the quick brown fox jumps over the lazy dog and sees incomprehensibilities in uncharacteristically long words " * 5
    df = spark.createDataFrame([(i, f"{prose}{r} {prose}") for i, r in enumerate(runs)] + [(100, prose), (101, prose + "z" * 40)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(df).collect()}
    assert sum(got[i] == [[len(prose), len(prose) + 32, 3]] for i in range(30)) >= 29 and got[100] == [] and not got[101]


def test_secret_bound_settles_however_many_rounds_it_takes(spark, monkeypatch):
    k = 215
    # run i has the chance 0.001 * (i + 1.5) / k, so each round takes one run out, and none is left
    monkeypatch.setattr(secrets, "battery", lambda runs, share: (np.array([0.001 * (int(r[-4:]) + 1.5) / k for r in runs]), np.ones(len(runs))))
    df = spark.createDataFrame([(1, " ".join("a" * 16 + f"{i:04d}" for i in range(k)))], "doc_id long, text string").coalesce(1)
    assert not secrets.thresholds(df, np.ones(256) / 256).any()


def test_licenses(spark, odd, nothing):
    assert licenses.scan(odd.select(F.col("source").alias("path"), "text")).count() == 2
    assert licenses.scan(nothing.select(F.col("source").alias("path"), "text")).count() == 0
    rows = [("a/LICENSE", "Released under the MIT License."), ("a/b/x.txt", "words"), ("a/b/c/y.txt", "words\nLicensed under CC BY-NC 4.0.\nmore words of the file follow here and go on"), ("z/w.txt", "words"), ("top", None)]
    got = {r["path"]: (r["license"], r["evidence"], r["origin"]) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got["a/b/x.txt"] == ("MIT", "inherited", "a") and got["a/b/c/y.txt"][:2] == ("CC-BY-NC-4.0", "header") and got["z/w.txt"] == got["top"] == (None, None, None)


def test_decontamination(spark, odd, nothing):
    items = spark.createDataFrame([("i1", PASSAGE), ("i2", "epsilon zeta"), ("i3", None), (None, "one"), ("i4", "")], "item string, text string")
    got = {r["doc_id"]: r for r in decontaminate.digest(decontaminate.contamination(odd.select("doc_id", "text"), items)).collect()}
    assert got[8]["n_hit"] == got[9]["n_hit"] == 60 and got[1]["n_hit"] == 2 and got[10]["n_hit"] == 0 and got[2]["n_words"] == 0
    cut = decontaminate.remove_spans(odd, items)
    assert cut.columns == odd.columns
    left = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert left[1] == "alpha beta gamma delta " and left[5] == LONG and 8 not in left and 9 not in left and left[2] is None
    assert decontaminate.contamination(nothing.select("doc_id", "text"), items).count() == 0
    assert decontaminate.remove_spans(odd, items.limit(0)).count() == N


def test_decontamination_by_items_without_id(spark, odd, tmp_path):
    items = [(None, "beta gamma delta"), (None, "epsilon zeta"), (5, "gamma delta epsilon"), (6, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = odd.where("doc_id in (1, 4, 10)").distinct()
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.QUERIES["op6_decontaminate"](spark, str(tmp_path)).collect()}
    with duckdb.connect() as c:
        for t in ("documents", "benchmark"):
            c.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
        want = {r[0]: r for r in c.execute(queries.SQL["op6_decontaminate"]).fetchall()}
    assert {k: tuple(r) for k, r in got.items()} == want and got[1]["n_hit"] == 5 and got[1]["n_items"] == 2
    left = decontaminate.remove_spans(docs, spark.createDataFrame(items[:1], "item string, text string"), max_coverage=0.6)
    assert {r["doc_id"]: r["text"] for r in left.collect()}[1] == "alpha  epsilon zeta"


def test_decontamination_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 30, n)]
    items = [(f"i{k}", " ".join(word(int(rng.integers(1, 25))))) for k in range(40)]
    docs = [(k, " ".join(word(60) + items[k % 40][1].split() + word(5))) for k in range(60)]
    d, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item string, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 40)
    got = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in decontaminate.digest(decontaminate.contamination(d, it, 4)).collect()}
    for k, t in docs:
        ws, hit, found = t.split(), set(), set()
        for name, x in items:
            x = x.split()
            w = min(4, len(x))
            for a in range(len(x) - w + 1):
                for b in range(len(ws) - w + 1):
                    if ws[b:b + w] == x[a:a + w]:
                        hit.update(range(b, b + w))
                        found.add(name)
        assert got[k] == (len(hit), len(found))


def test_jaccard(spark, odd, nothing):
    got = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["n_links"]) for r in jaccard.near_duplicates(odd).collect()}
    assert got[(1, 2)] == (1, 1) and got[(6, 997)] == (5, 1) and got[(2, 0)] == (2, 0) and got[(3, 0)] == (3, 0) and got[(10, 1)] == (10, 0)
    assert jaccard.near_duplicates(nothing).count() == 0


def test_prefix_tree_against_all_pairs(monkeypatch):
    rng = np.random.default_rng(1)
    for _ in range(60):
        base = [np.unique(rng.integers(0, 400, rng.integers(1, 120)).astype(np.uint64)) for _ in range(5)]
        sets = []
        for _ in range(int(rng.integers(2, 40))):
            b = base[rng.integers(5)]
            s = np.unique(np.concatenate([b[rng.random(len(b)) > rng.choice([0, 0.05, 0.1, 0.2])], rng.integers(0, 400, rng.integers(0, 8)).astype(np.uint64)]))
            if len(s):
                sets.append(s)
        linked = lambda a, b: 7 * len(np.intersect1d(a, b)) >= 3 * (len(a) + len(b))
        got = jaccard.join_sets(sets)
        assert len(got) == len(set(got)) and set(got) == {(i, j) for j in range(len(sets)) for i in range(j) if linked(sets[i], sets[j])}
        h = len(sets) // 2
        if h:
            assert set(jaccard.join_sets(sets[:h], sets[h:])) == {(i, j) for i in range(h) for j in range(len(sets) - h) if linked(sets[i], sets[h + j])}


@pytest.mark.parametrize("bound", [("BLOCK", 7), ("BLOCK_SHINGLES", 500)])
def test_jaccard_blocks_do_not_change_results(spark, monkeypatch, bound):
    rng = np.random.default_rng(7)
    base = [f"w{x}" for x in rng.integers(0, 10_000, 120)]
    rows = []
    for i in range(60):
        w = list(base) if i % 3 else [f"v{x}" for x in rng.integers(0, 10_000, 120)]
        for _ in range(int(rng.integers(0, 5))):
            w[int(rng.integers(0, 120))] = "edit" + str(i)
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, jaccard.near_duplicates(d).collect()))
    monkeypatch.setattr(jaccard, *bound)
    monkeypatch.setattr(jaccard, "FEW", 4)
    assert sorted(map(tuple, jaccard.near_duplicates(d).collect())) == want
    sets = {i: set(zip(*[t.split()[k:] for k in range(5)])) for i, t in rows}
    links = {i: sum(100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) for j in sets if j != i) for i in sets}
    assert {r[0]: r[3] for r in want} == links


def test_jaccard_null_ids_hold_their_neighbours_together(spark):
    w = [f"w{i}" for i in range(104)]
    # 4 - null - 3 is a chain whose ends do not link
    rows = [(4, " ".join(w[:94])), (None, " ".join(w[5:99])), (3, " ".join(w[17:])), (None, "alone " + " ".join(w[::-1])), (9, "an other text of its own")]
    sets = [set(zip(*[t.split()[k:] for k in range(5)])) for _, t in rows]
    links = [sum(7 * len(a & b) >= 3 * (len(a) + len(b)) for b in sets) - 1 for a in sets]
    assert links == [1, 2, 1, 0, 0]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, ((r["doc_id"], r["component_id"], r["n_links"]) for r in got))) == sorted(map(str, [(4, 3, 1), (None, 3, 2), (3, 3, 1), (None, None, 0), (9, 9, 0)]))


def test_jaccard_leads_stand_for_all_sets_of_their_size(spark, monkeypatch):
    rng = np.random.default_rng(0)
    passages = [[f"p{k}w{i}" for i in range(30)] for k in range(10)]
    rows = []
    for g in range(40):
        w = sum((passages[k] for k in sorted(rng.choice(10, 5, replace=False))), [])
        c = int(rng.integers(1, 40))
        at = int(rng.integers(0, len(w) - c))
        rows += [(2 * g, " ".join(w)), (2 * g + 1, " ".join(w[:at] + w[at + c:]))]
    sets = {i: set(zip(*[t.split()[k:] for k in range(5)])) for i, t in rows}
    near = {i: [j for j in sets if j != i and 7 * len(sets[i] & sets[j]) >= 3 * (len(sets[i]) + len(sets[j]))] for i in sets}
    want = {}
    for i in sorted(sets):
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in want:
                want[j] = i
                todo += near[j]
    monkeypatch.setattr(jaccard, "EQUAL", 1)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 2, 5):
        got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in jaccard.near_duplicates(d.repartition(parts, "doc_id")).collect()}
        assert got == {i: (want[i], len(near[i])) for i in sets}


def test_mix(spark, odd, nothing):
    got = mixing.mixed_documents(odd).collect()
    assert len(got) == N and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed_documents(odd).collect()))
    assert mixing.mixed_documents(nothing).count() == 0


def test_mix_targets_are_capped_and_feasible(spark):
    rows = [("a", 10, 3), ("b", 1000, 1), ("c", 50, 2), ("d", 0, 1), (None, 400, 2)]
    t = {r["source"]: r for r in mixing.targets(spark.createDataFrame(rows, "source string, source_size long, weight long")).collect()}
    assert abs(sum(r["target"] for r in t.values()) - 1460) < 1e-6 and all(r["target"] <= 3 * r["source_size"] for r in t.values())
    level = t["b"]["target"]
    assert t["a"]["target"] == 30 and t["c"]["target"] == 150 and abs(t[None]["target"] - min(1200, 2 * level)) < 1e-6


def test_toxicity(spark, odd, nothing):
    labels = _labels(spark, [(1, 1, 0), (1, 1, 0), (5, 0, 1), (7, None, 0), (8, 1, 0), (9, 0, 1), (10, 1, 0)])
    chain = toxicity.fit_chain(odd, labels, ["quality", "toxic"])
    assert toxicity.chances(odd, ["doc_id"], chain).count() == N
    assert toxicity.chances(nothing, ["doc_id"], toxicity.fit_chain(nothing, labels, ["quality", "toxic"])).count() == 0


def test_line_dedup(spark, odd, nothing):
    got = {(r["doc_id"], r["text"]): r for r in line_dedup.without_repeats(odd, stats=True).collect()}
    assert (8, PASSAGE + "\nown line eight") in got and (9, "line nine") in got and (5, LONG) in got and (6, "") in got and (2, None) in got
    assert line_dedup.without_repeats(odd).columns == odd.columns and line_dedup.without_repeats(odd).count() == N
    assert line_dedup.without_repeats(nothing).count() == 0


def test_line_dedup_removes_maximal_runs(spark):
    big, small = " ".join(f"b{i}" for i in range(60)), "a short tail"
    rows = [(1, f"{big}\n{small}\nfirst"), (2, f"x\n{small}\ny"), (3, f"intro\n{big}\n{small}\nother"), (4, "\n".join(f"l{i}" for i in range(55)) + "\nfour"), (5, "five\n" + "\n\n".join(f"l{i}" for i in range(55)))]
    got = {r["doc_id"]: r["text"] for r in line_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1] and got[2] == rows[1][1] and got[3] == "intro\nother" and got[4] == rows[3][1] and got[5].strip() == "five"
