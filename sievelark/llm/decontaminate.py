"""Benchmark decontamination with generalised suffix automata of test items."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from sievelark.llm.common import documents, each_text, fresh, give_back, raw_texts, store
from sievelark.llm.registry import query
from sievelark.sources.tables import table

#: Words of test items held by one automaton; more items make more automata.
BLOCK_WORDS = 400_000
#: What a word is: runs of ASCII letters, digits and any non-ASCII character; A-Z are lower-cased.
_MAP = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def item_words(text: bytes | None) -> list[bytes]:
    return text.translate(_MAP).split() if text else []


class SuffixAutomaton:
    """Generalised suffix automaton over word ids; one state per class of equal end positions.

    ``items[state]`` lists the items whose windows end there: windows of ``window`` words, or
    the whole item when it is shorter.
    """

    def __init__(self, window: int) -> None:
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.ids: dict[bytes, int] = {}
        self.items: dict[int, list[int]] = {}
        self.short: dict[int, list[int]] = {}

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        q = nxt[last].get(c)
        if q is not None and length[q] == length[last] + 1:
            return q
        if q is not None:
            return self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def build(self, items: list[list[bytes]]) -> "SuffixAutomaton":
        coded = [[self.ids.setdefault(w, len(self.ids)) for w in item] for item in items]
        for item in coded:
            last = 0
            for c in item:
                last = self._extend(last, c)
        # windows are attached once all states are final
        for k, item in enumerate(coded):
            n, w, state = len(item), self.window, 0
            for i, c in enumerate(item):
                state = self.next[state][c]
                if n >= w and i + 1 >= w:
                    while self.len[self.link[state]] >= w:
                        state = self.link[state]
                    self._add(self.items, state, k)
            if 0 < n < w:
                while self.len[self.link[state]] >= n:
                    state = self.link[state]
                self._add(self.short, state, (n, k))
        return self

    @staticmethod
    def _add(where: dict[int, list], state: int, x) -> None:
        got = where.setdefault(state, [])
        if not got or got[-1] != x:
            got.append(x)

    def match(self, tokens: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged hit spans (start, end) in words and the items with occurring windows."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        nxt, link, length, ids, w = self.next, self.link, self.len, self.ids, self.window
        state = matched = 0
        for i, t in enumerate(tokens):
            c = ids.get(t)
            if c is None:
                state = matched = 0
                continue
            while state and c not in nxt[state]:
                state = link[state]
                matched = length[state]
            to = nxt[state].get(c)
            if to is None:
                continue
            state, matched = to, matched + 1
            longest = 0
            if matched >= w:
                s = state
                while length[link[s]] >= w:
                    s = link[s]
                if s in self.items:
                    found.update(self.items[s])
                    longest = w
            if self.short:
                s = state
                while s:
                    for n, k in self.short.get(s, ()):
                        if n <= matched:
                            found.add(k)
                            longest = max(longest, n)
                    s = link[s]
            if longest:
                a = i + 1 - longest
                while spans and spans[-1][1] >= a:
                    a = min(a, spans.pop()[0])
                spans.append((a, i + 1))
        return spans, found


def _blocks(items: DataFrame) -> tuple[DataFrame, int]:
    """Items dealt by hash to blocks of about BLOCK_WORDS words (four bytes and more each), and how many blocks."""
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // (4 * BLOCK_WORDS)))
    return items.withColumn("_block", F.pmod(F.xxhash64("item", "text"), F.lit(n))), n


#: Kinds of the columns added to documents: words, hit word spans (start, end), items found.
MADE = [("_n", T.LongType()), ("_spans", T.ArrayType(T.ArrayType(T.IntegerType()))), ("_items", T.ArrayType(T.StringType()))]


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, unnamed: bool = False) -> DataFrame:
    """Append three columns (see ``MADE``) to ``docs``: words, hit word spans (start, end), items found.

    Their names get underscores in front where ``docs`` has them already.

    ``items`` has ``item`` (text id) and ``text``. Training words stream through a suffix
    automaton of the items, which tracks the longest match ending at every word; a match of
    ``window`` words, or of a whole shorter item, is a hit. The items' automaton is broadcast
    in blocks of about BLOCK_WORDS words: the size of a broadcast has that bound, and more
    items mean more passes over the documents. Null texts have no words. Items without an id are left out,
    or with ``unnamed`` hit like any other and are listed as null.
    """
    it = items.select(F.col("item").cast("string").alias("item"), "text").where("text is not null" if unnamed else "text is not null and item is not null").distinct()
    it, n = _blocks(store(it, "items"))
    spark = docs.sparkSession
    fields = docs.schema
    out = docs
    for b in range(n):
        rows = it.where(F.col("_block") == b).select("item", "text").collect()  # one block, bounded by BLOCK_WORDS
        names = [r["item"] for r in rows]
        sam = SuffixAutomaton(window).build([item_words(r["text"].encode()) for r in rows])
        shared = spark.sparkContext.broadcast(pickle.dumps((sam, names), protocol=pickle.HIGHEST_PROTOCOL))
        kind = T.StructType(fields.fields + [T.StructField(fresh(n, docs.columns), t) for n, t in MADE]) if b == 0 else out.schema

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, first=b == 0, columns=[f.name for f in kind.fields]) -> Iterator[pa.RecordBatch]:
            sam, names = pickle.loads(shared.value)
            for batch in batches:
                ns, spans, found = [], [], []
                for t in each_text(batch):
                    tokens = item_words(t)
                    s, f = sam.match(tokens)
                    ns.append(len(tokens))
                    spans.append([list(x) for x in s])
                    found.append([names[k] for k in f])
                cols = list(batch.columns)
                if not first:
                    spans = [a + b for a, b in zip(cols[-2].to_pylist(), spans)]
                    found = [a + b for a, b in zip(cols[-1].to_pylist(), found)]
                    cols = cols[:-3]
                made = [pa.array(ns, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(found, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols + made, names=columns)
                give_back()

        out = out.mapInArrow(scan, kind)
        if b + 1 < n:  # one automaton in memory at a time
            out = store(out, "decontaminate")
    return out


def merged(spans: list[list[int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(map(tuple, spans)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_spans(docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """Documents with hit spans cut out of their texts; those covered beyond ``max_coverage`` are dropped.

    A cut goes from the first to the last word of a span, with what stands between them.
    Texts without a hit stay byte for byte. Columns are those of ``docs``. Items without an id
    are cut like any other.
    """
    hit = contamination(docs, items, window, unnamed=True)
    at = docs.columns.index("text")
    schema = docs.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, spans = batch.column(batch.num_columns - 3).to_pylist(), batch.column(batch.num_columns - 2).to_pylist()
            keep = np.ones(batch.num_rows, bool)
            texts = raw_texts(batch)
            for r, sp in enumerate(spans):
                if not sp:
                    continue
                sp = merged(sp)
                if sum(b - a for a, b in sp) > max_coverage * n[r]:
                    keep[r] = False
                else:
                    texts[r] = _without(texts[r], sp)
            cols = list(batch.columns)[:-3]
            cols[at] = pa.array([None if t is None else t.decode("utf-8", "replace") for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema.fields]).filter(pa.array(keep))
            del texts
            give_back()

    return hit.mapInArrow(cut, schema)


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    plain = text.translate(_MAP)
    starts, ends, pos = [], [], 0
    for w in plain.split():
        pos = plain.index(w, pos)
        starts.append(pos)
        pos += len(w)
        ends.append(pos)
    out, last = [], 0
    for a, b in spans:
        out.append(text[last:starts[a]])
        last = ends[b - 1]
    out.append(text[last:])
    return b"".join(out)


@query("op6_decontaminate", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS ws FROM documents),
bw AS (SELECT item_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(ws), 10) AS k, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS g
        FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS i FROM bw WHERE len(ws) > 0)),
ks AS (SELECT DISTINCT k FROM win),
g AS (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, ks WHERE len(ws) >= k)),
m AS (SELECT DISTINCT g.doc_id, g.i, g.k FROM g SEMI JOIN win ON g.g = win.g AND g.k = win.k),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT g.doc_id, CAST(win.item_id AS VARCHAR) AS item_id FROM g JOIN win ON g.g = win.g AND g.k = win.k) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN its USING (doc_id)""")
def _(spark, base):
    b = table(spark, base, "benchmark").select(F.col("item_id").alias("item"), "text")
    c = contamination(documents(spark, base).select("doc_id", "text"), b, unnamed=True)
    return digest(c)


def digest(c: DataFrame) -> DataFrame:
    """Counts per document from spans; spans of several automata may overlap, so they are merged first."""
    n, spans, items = c.columns[-3:]
    sorted_ = F.array_sort(spans)
    hit = F.aggregate(sorted_, F.struct(F.lit(0).alias("n"), F.lit(-1).alias("e")), lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0), s[1] - F.greatest(a["e"], s[0]))).alias("n"), F.greatest(a["e"], s[1]).alias("e")), lambda a: a["n"])
    ids = F.array_sort(F.array_distinct(items))
    return c.select("doc_id", F.col(n).alias("n_words"), hit.cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
                    F.sha2(F.concat_ws(",", ids).cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))
