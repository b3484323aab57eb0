"""Line deduplication: repeated runs of lines found by distributed prefix doubling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sievelark.llm.common import WORD, documents, fresh, give_back, raw_texts, store
from sievelark.llm.registry import query

MIN_WORDS = 50


def _lines(docs: DataFrame) -> DataFrame:
    """``d, t, j, w, h1, h2``: document, text hash, number among its non-blank lines, words, 128 bits of the line."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select(F.col("doc_id").alias("d"), F.xxhash64(text).alias("t"), F.posexplode(kept).alias("j", "_line"))
    rows = rows.select("d", "t", F.col("j").cast("long").alias("j"), F.regexp_count("_line", F.lit(WORD)).alias("w"),
                       F.xxhash64("_line").alias("h1"), F.xxhash64(F.lit(1), F.col("_line")).alias("h2"))
    return rows


def _named(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Rows whose ``by`` occurs again, with the class name: the first position (document, line) of the class."""
    classes = rows.groupBy(*by).agg(F.min(F.struct("d", "t", "j")).alias(name), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return rows.join(classes.drop("_n"), by)


def repeated_windows(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``d, t, j, n``: runs of ``n`` lines from line ``j`` that have at least ``min_words`` words and an earlier copy.

    The lines of all documents, in order of id, form one sequence of line classes; no run
    crosses a document. Prefix doubling names the classes of equal 1, 2, 4, ... line runs, as
    in the construction of a suffix array: round k joins the names of two neighbouring halves.
    A class is an interval of the suffix array whose longest common prefix is at least that
    length, and is named by its earliest suffix; suffixes alone in their interval leave, so
    the rounds shrink. A line belongs to a later copy of a maximal repeated run of enough
    words exactly if it lies in the shortest long enough run that starts, or ends, at some
    line of that copy; such shortest runs have at most ``min_words`` lines, and two
    overlapping power-of-two classes identify them. Hence log2(min_words) rounds suffice.
    """
    rows = store(_named(_lines(docs).dropDuplicates(["d", "t", "j"]), ["h1", "h2"], "c0").select("d", "t", "j", "w", "c0"), "lines")
    seq = Window.partitionBy("d", "t").orderBy("j")
    ahead = F.collect_list(F.struct("j", "w")).over(seq.rangeBetween(0, min_words - 1))
    behind = F.reverse(F.collect_list(F.struct("j", "w")).over(seq.rangeBetween(-(min_words - 1), 0)))

    def reach(near, step: int):
        # lines needed, walking over neighbouring repeated lines only; 0 if they don't suffice
        walk = F.aggregate(near, F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("w"), F.lit(True).alias("ok")), lambda a, x: F.when(
            (a["w"] >= min_words) | ~a["ok"] | (x["j"] != F.col("j") + a["n"] * step), F.struct(a["n"].alias("n"), a["w"].alias("w"), (a["w"] >= min_words).alias("ok"))).otherwise(
            F.struct((a["n"] + 1).alias("n"), (a["w"] + x["w"]).alias("w"), a["ok"].alias("ok"))))
        return F.when(walk["w"] >= min_words, walk["n"]).otherwise(0)

    runs = rows.select("d", "t", "j", ahead.alias("_a"), behind.alias("_b")).select("d", "t", "j", reach(F.col("_a"), 1).alias("_f"), reach(F.col("_b"), -1).alias("_r"))
    runs = runs.select("d", "t", F.explode(F.array(F.struct(F.col("j").alias("j"), F.col("_f").alias("n")), F.struct((F.col("j") - F.col("_r") + 1).alias("j"), F.col("_r").alias("n")))).alias("_x"))
    runs = store(runs.select("d", "t", "_x.j", "_x.n").where("n > 0").distinct(), "runs")
    longest = runs.agg(F.max("n")).first()[0] or 0
    level = rows.select("d", "t", "j", F.col("c0").alias("c"))
    found = None
    k = 0
    while True:
        size = 1 << k
        if longest >= size:
            here = runs.where((F.col("n") >= size) & (F.col("n") < 2 * size))
            tail = (F.col("l.d").eqNullSafe(F.col("r.d"))) & (F.col("l.t") == F.col("r.t"))
            a = here.alias("r").join(level.alias("l"), tail & (F.col("l.j") == F.col("r.j"))).select("r.*", F.col("l.c").alias("_x"))
            b = a.alias("r").join(level.alias("l"), tail & (F.col("l.j") == F.col("r.j") + F.col("r.n") - size)).select("r.*", F.col("l.c").alias("_y"))
            same = _named(b, ["_x", "_y", "n"], "_first").where((F.col("_first") != F.struct("d", "t", "j")))
            same = same.select("d", "t", "j", "n")
            found = same if found is None else found.unionByName(same)
        k += 1
        if longest < 2 * size:
            break
        pair = level.withColumn("_c2", F.first("c").over(seq.rangeBetween(size, size))).where("_c2 is not null")
        level = store(_named(pair, ["c", "_c2"], "_c").select("d", "t", "j", F.col("_c").alias("c")), f"level{k}")
    return found if found is not None else runs


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, stats: bool = False) -> DataFrame:
    """Documents without later copies of repeated line runs of at least ``min_words`` words.

    The first copy in order of ``doc_id`` (null first, then the text's hash, then the line)
    stays. Lines are cut at newlines and compared byte for byte; blank lines are ignored in
    comparisons and stay where the text stays. A text whose every non-blank line goes becomes
    empty. Rows that repeat id and text are one document and get the same result; null and
    empty texts stay as they are. With ``stats`` the columns ``_lines, _removed, _words``
    (non-blank lines, removed lines, removed words) are added.
    """
    cuts = repeated_windows(docs, min_words).groupBy("d", "t").agg(F.collect_list(F.struct("j", "n")).alias("_cuts"))
    key = docs["doc_id"].eqNullSafe(cuts["d"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == cuts["t"])
    last = fresh("_cuts", docs.columns)
    joined = docs.join(cuts, key, "left").select(*[docs[c] for c in docs.columns], cuts["_cuts"].alias(last))
    at = docs.columns.index("text")
    made = ["_lines", "_removed", "_words"] if stats else []
    names = docs.columns + made
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [f"{m} long" for m in made])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, cuts = raw_texts(batch), batch.column(batch.num_columns - 1).to_pylist()
            n, gone, words = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for r, (t, c) in enumerate(zip(texts, cuts)):
                lines = t.split(b"\n") if t else []
                real = [i for i, x in enumerate(lines) if x.split()]
                n[r] = len(real)
                if not c:
                    continue
                drop = {real[j] for x in c for j in range(x["j"], x["j"] + x["n"])}
                gone[r] = len(drop)
                words[r] = sum(len(lines[i].split()) for i in drop)
                texts[r] = b"" if len(drop) == len(real) else b"\n".join(x for i, x in enumerate(lines) if i not in drop)
            cols = list(batch.columns)[:-1]
            cols[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(n), pa.array(gone), pa.array(words)] if made else []), names=names)
            del texts, cuts
            give_back()

    return joined.mapInArrow(cut, out)


@query("op10_line_dedup", r"""
WITH l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w
           FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)
           WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY j) AS upto FROM l),
f AS (SELECT a.doc_id, a.j, min(b.j) AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.j >= a.j AND b.j < a.j + 50 AND b.upto - a.upto + a.w >= 50 GROUP BY ALL),
r AS (SELECT a.doc_id, max(b.j) AS j, a.j AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.j <= a.j AND b.j > a.j - 50 AND a.upto - b.upto + b.w >= 50 GROUP BY ALL),
win AS (SELECT DISTINCT doc_id, j, e FROM (SELECT doc_id, j, e FROM f UNION ALL SELECT doc_id, j, e FROM r)),
g AS (SELECT win.doc_id, win.j, win.e, string_agg(c.line, chr(10) ORDER BY c.j) AS body FROM win JOIN c ON c.doc_id = win.doc_id AND c.j BETWEEN win.j AND win.e GROUP BY ALL),
m AS (SELECT *, min((doc_id, j)) OVER (PARTITION BY body) AS first FROM g),
del AS (SELECT DISTINCT doc_id, unnest(range(j, e + 1)) AS j FROM m WHERE first <> (doc_id, j)),
n AS (SELECT c.doc_id, count(*) AS n_lines, count(del.j) AS n_removed, coalesce(sum(c.w) FILTER (WHERE del.j IS NOT NULL), 0) AS removed_words
      FROM c LEFT JOIN del ON c.doc_id = del.doc_id AND c.j = del.j GROUP BY c.doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(removed_words, 0) AS BIGINT) AS removed_words
FROM documents d LEFT JOIN n USING (doc_id)""")
def _(spark, base):
    return without_repeats(documents(spark, base).select("doc_id", "text"), stats=True).select(
        "doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), F.col("_words").alias("removed_words"))
