"""Phrase collocations of every language by best-first growth with admissible bounds.

Texts are kept as chunks of numbered frequent words. Pairs of frequent words are counted
outright: a single word bounds nothing. Longer phrases grow best first. A prefix ``p`` with count ``a`` bounds every phrase that it starts: none scores above
``2000000 a / (l + a)`` for the count ``l`` of any part that starts ``p``, since a phrase's count
and that of its rest are linked that way. In a round, a language has a cut: prefixes bounded
below it stay shut, the others are grown, and phrases that score at the cut or above are probed
for longer phrases that absorb them. All survivors at the cut are then known. Rounds lower the
cut until the language has ``limit`` of them (ties at the last place are among them) or is used up.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, reduce
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sievelark.llm.common import documents, raw_texts, store
from sievelark.llm.registry import query

#: Fewest occurrences of a phrase, and phrases reported per language.
LEAST, LIMIT = 30, 2_000
#: Points of a phrase that always occurs whole.
POINTS = 1_000_000
#: A longer phrase with at least so many of 5 occurrences absorbs a shorter one.
ABSORB = 4
#: Pairs above the first cut, as a multiple of the limit, and by how much a round multiplies them; this changes costs only.
FIRST, FURTHER = 2, 4
#: Chunks of text that a task hands on together, and words or pairs in one row of numbers.
CHUNK_BYTES, CHUNK_WORDS, ROW = 12 << 20, 200_000, 100_000
SLICE = 4 << 20
#: Pieces that are added to a chunk at a time, and words of a chunk up to which three numbers fit into one.
PIECES, DIRECT = 20_000, 2_000_000
#: Chunks that one task joins with a common word's pairs.
CHUNKS_PER_SALT = 64
#: A-Z become small letters, signs between pieces become line ends.
_MAP = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))


def pieces(text: bytes | None) -> Iterator[list[bytes]]:
    """Words of every piece that has some, a bounded part of the text at a time."""
    t, at = (text or b"").translate(_MAP), 0
    while at < len(t):
        end = t.find(b"\n", at + SLICE) if len(t) - at > SLICE else -1
        end = len(t) if end < 0 else end
        yield from filter(None, map(bytes.split, t[at:end].split(b"\n")))
        at = end + 1


def _packed(x: np.ndarray) -> bytes:
    return pa.compress(x.astype(np.int32).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, size * 4, codec="zstd", asbytes=True), np.int32)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Chunk:
    """Texts as word numbers of their language, with -1 between pieces."""

    def __init__(self) -> None:
        self.numbers: dict[str, _Numbers] = {}
        self.parts: dict[str, list[np.ndarray]] = {}
        self.size = 0

    def add(self, lang: str, found: tuple[list[bytes], ...]) -> None:
        number = self.numbers.setdefault(lang, _Numbers())
        out, get = [], number.__getitem__
        for words in found:
            out += map(get, words)
            out.append(-1)
        self.parts.setdefault(lang, []).append(np.array(out, np.int32))
        self.size += 6 * len(out)

    def full(self) -> bool:
        return self.size >= CHUNK_BYTES or sum(map(len, self.numbers.values())) >= CHUNK_WORDS

    def rows(self, name: int) -> Iterator[dict]:
        """First a row with the numbers of all languages, then rows of bounded length with their words and counts."""
        start, seqs, spelled = 0, [], []
        for lang, number in self.numbers.items():
            seq = np.concatenate(self.parts[lang])
            count = np.bincount(seq[seq >= 0], minlength=len(number))
            words = list(number)
            for at in range(0, len(words), ROW):
                spelled.append({"chunk": name, "lang": lang, "first": start + at, "words": [w.decode() for w in words[at:at + ROW]], "counts": count[at:at + ROW].tolist()})
            seqs.append(np.where(seq >= 0, seq + start, -1))
            start += len(number)
        seq = np.concatenate(seqs)
        yield {"chunk": name, "size": len(seq), "n_words": start, "seq": _packed(seq)}
        yield from spelled


_CHUNK = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("first", pa.int64()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("size", pa.int64()), ("n_words", pa.int64()), ("seq", pa.binary())])
_CODED = pa.schema([("chunk", pa.int64()), ("size", pa.int64()), ("seq", pa.binary()), ("ids", pa.list_(pa.int64()))])
_RUNS = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("z", pa.int64()), ("w", pa.int64()), ("n", pa.int64())])


def _chunks(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, chunk = TaskContext.get().partitionId(), 0, _Chunk()

        def handed() -> Iterator[pa.RecordBatch]:
            for row in chunk.rows((part << 32) + made):
                yield pa.RecordBatch.from_pylist([row], schema=_CHUNK)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                for lang, text in zip(piece.column(0).to_pylist(), raw_texts(piece)):
                    for found in batched(pieces(text), PIECES):
                        chunk.add(lang, found)
                        if chunk.full():
                            yield from handed()
                            made, chunk = made + 1, _Chunk()
        if chunk.parts:
            yield from handed()

    return docs.mapInArrow(run, "chunk long, lang string, first long, words array<string>, counts array<bigint>, size long, n_words long, seq binary")


def _only_frequent(chunk: pa.Table, known: pa.Table) -> pa.Table:
    """The chunk in numbers of frequent words only; ``known`` has ``ord, gid``."""
    out = []
    for c in chunk.to_pylist():
        to = np.full(c["n_words"] + 1, -1, np.int64)
        to[known["ord"].to_numpy()] = np.arange(known.num_rows)
        out.append({"chunk": c["chunk"], "size": c["size"], "seq": _packed(to[_unpacked(c["seq"], c["size"])]), "ids": known["gid"].to_numpy()})
    return pa.Table.from_pylist(out, schema=_CODED)


def _find(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of ``x`` in the sorted ``keys``, -1 where there is none."""
    if not len(keys):
        return np.full(len(x), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, at, -1)


class _Words:
    """A chunk in numbers of frequent words."""

    def __init__(self, c: dict) -> None:
        self.ids = np.array(c["ids"], np.int64)
        self.seq = _unpacked(c["seq"], c["size"]).astype(np.int64)
        self.m = max(len(self.ids), 1)
        self.order = np.argsort(self.ids)

    def runs(self, k: int) -> np.ndarray:
        """One number for the ``k`` <= 3 words that start at every place, -1 where a piece ends before or a word is rare."""
        if k == 3 and self.m > DIRECT:
            pair = self.runs(2)
            at = _find(self.pairs, pair[:-1])
            return np.where((at >= 0) & (pair[1:] >= 0), at * self.m + self.seq[2:], -1)
        n = max(len(self.seq) - k + 1, 0)
        code, ok = np.zeros(n, np.int64), np.ones(n, bool)
        for j in range(k):
            word = self.seq[j:j + n]
            ok &= word >= 0
            code = code * self.m + word
        return np.where(ok, code, -1)

    @cached_property
    def pairs(self) -> np.ndarray:
        """The chunk's pairs in order; their places stand for them in triples of a chunk with very many words."""
        return np.unique(self.runs(2)[self.runs(2) >= 0])

    def places(self, asked: pa.Table, names: str) -> np.ndarray:
        """The row of ``asked`` whose words start at every place, -1 where none does."""
        code, here = np.zeros(asked.num_rows, np.int64), np.ones(asked.num_rows, bool)
        for j, c in enumerate(names):
            at = _find(self.ids[self.order], asked[c].to_numpy())
            here &= at >= 0
            if j == 2 and self.m > DIRECT:
                code = _find(self.pairs, code)
                here &= code >= 0
            code = code * self.m + (self.order[np.maximum(at, 0)] if len(self.order) else 0)
        rows = np.flatnonzero(here)
        rows = rows[np.argsort(code[rows])]
        at = _find(code[rows], self.runs(len(names)))
        return np.where(at >= 0, rows[np.maximum(at, 0)] if len(rows) else -1, -1)

    def counted(self, at: np.ndarray, k: int) -> pa.RecordBatch:
        """Distinct runs of ``k`` words at the places ``at``, with their counts; words that a run has not are -1."""
        head, inv = np.unique(self.runs(min(k, 3))[at], return_inverse=True)
        tail = np.full(len(head), -1, np.int64)
        if k == 4:
            both, n = np.unique(inv * self.m + self.seq[at + 3], return_counts=True)
            head, tail = head[both // self.m], self.ids[both % self.m]
        else:
            n = np.bincount(inv, minlength=len(head))
        last = [head % self.m]
        pair = head // self.m if k > 2 else head
        if k > 2 and self.m > DIRECT:
            pair = self.pairs[pair]
        words = [self.ids[x] for x in (pair // self.m, pair % self.m, *(last if k > 2 else ()))]
        words += [np.full(len(head), -1, np.int64)] * (3 - len(words)) + [tail]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (*words, n)], schema=_RUNS)


def _flag(asked: pa.Table, name: str, places: np.ndarray) -> np.ndarray:
    """The flag of the asked row at every place, False at -1."""
    return np.append(asked[name].to_numpy(zero_copy_only=False).astype(bool), False)[places]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of frequent neighbours of every chunk."""
    for batch in batches:
        for c in batch.to_pylist():
            words = _Words(c)
            found = words.counted(np.flatnonzero(words.runs(2) >= 0), 2)
            yield from (found.slice(at, ROW) for at in range(0, found.num_rows, ROW))


def _body(work):
    """Cogroup function over a chunk and what is asked of it."""
    def run(chunk: pa.Table, asked: pa.Table) -> pa.Table:
        return pa.Table.from_batches([work(_Words(c), asked) for c in chunk.to_pylist()], schema=_RUNS)

    return run


def _grow(names: str):
    """Runs one word longer whose first part is open or probed, or whose last part is probed."""
    def work(words: _Words, asked: pa.Table) -> pa.RecordBatch:
        k = len(names)
        at = words.places(asked, names)
        first, last = _flag(asked, "open", at) | _flag(asked, "probe", at), _flag(asked, "probe", at)
        whole = words.runs(k)
        fits = (whole[:-1] >= 0) & (whole[1:] >= 0)
        return words.counted(np.flatnonzero(fits & (first[:-1] | last[1:])), k + 1)

    return _body(work)


def _named(words: _Words, asked: pa.Table) -> pa.RecordBatch:
    """The triples that are asked for by name."""
    return words.counted(np.flatnonzero(words.places(asked, "xyz") >= 0), 3)


def _div(a: Column, b: Column) -> Column:
    """``floor(2 POINTS a / b)``, exact beyond 64 bits."""
    return F.call_function("div", F.lit(2 * POINTS).cast("decimal(10,0)") * a.cast("decimal(19,0)"), b.cast("decimal(20,0)")).cast("long")


def _lowest(cuts: list[tuple[Column, Column]], a: Column) -> Column:
    """``score, l, r`` of the lowest-scoring cut, the first of equals."""
    each = [F.struct(_div(a, left + right).alias("score"), F.lit(i).alias("k"), left.alias("l"), right.alias("r")) for i, (left, right) in enumerate(cuts)]
    return F.least(*each) if len(each) > 1 else each[0]


def _phrase(*words: str) -> Column:
    return F.concat_ws(" ", *words)


class Miner:
    """Frequent words and pairs of a corpus, and growth of longer phrases from them.

    Words go by number: ``x, y, z, w`` are those of a phrase, ``tx`` to ``tw`` its spelling and ``fx``,
    ``fxy`` and so on the counts of its parts.
    """

    def __init__(self, docs: DataFrame, least: int = LEAST) -> None:
        """``docs`` has ``lang`` and ``text``."""
        self.least = least
        chunks = store(_chunks(docs), "phrases")
        word = F.posexplode(F.arrays_zip("words", "counts")).alias("i", "s")
        seen = chunks.where("words IS NOT NULL").select("chunk", "lang", "first", word).select("chunk", "lang", (F.col("first") + F.col("i")).alias("ord"), F.col("s.words").alias("word"), F.col("s.counts").alias("n"))
        self.size = store(seen.groupBy("lang").agg(F.sum("n").alias("n")), "phrases-size")
        # one shuffle brings the chunks' counts of a word together: its total goes on with every chunk that holds it
        met = seen.withColumn("f", F.sum("n").over(Window.partitionBy("lang", "word"))).where(F.col("f") >= least)
        met = store(met.select("chunk", "ord", "lang", "word", "f"), "phrases-met")
        # numbers are fixed once the table is written
        self.words = store(met.select("lang", "word", "f").distinct().withColumn("gid", F.monotonically_increasing_id()), "phrases-words")
        known = met.join(self.words.select("lang", "word", "gid"), ["lang", "word"]).select(F.col("chunk").alias("of_chunk"), "ord", "gid")
        seqs = chunks.where("words IS NULL").select("chunk", "size", "n_words", "seq")
        self.state = store(seqs.groupBy("chunk").cogroup(known.groupBy("of_chunk")).applyInArrow(_only_frequent, "chunk long, size long, seq binary, ids array<bigint>"), "phrases-state")
        self.salts = max(1, self.state.count() // CHUNKS_PER_SALT)
        pairs = self.state.mapInArrow(_pairs, "x long, y long, z long, w long, n long").groupBy("x", "y").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
        left = self.words.select(F.col("gid").alias("x"), "lang", F.col("f").alias("fx"), F.col("word").alias("tx"))
        right = self.words.select(F.col("gid").alias("y"), F.col("f").alias("fy"), F.col("word").alias("ty"))
        pairs = store(pairs, "phrases-pair-counts").join(left, "x").join(right, "y")
        best = _lowest([(F.col("fx"), F.col("fy"))], F.col("a"))
        self.pairs = store(pairs.withColumn("best", best).select("*", "best.score", F.col("best.l").alias("l"), F.col("best.r").alias("r")).drop("best"), "phrases-pairs")

    def ask(self, work, asked: DataFrame) -> DataFrame:
        """Sums over all chunks of what ``work`` counts; a chunk gets the ``asked`` rows whose first word it has.

        The rows of a common word are dealt to several tasks by chunk.
        """
        held = self.state.select(F.col("chunk").alias("of_chunk"), F.explode("ids").alias("x"), F.pmod(F.xxhash64("chunk"), F.lit(self.salts)).alias("salt"))
        dealt = asked.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.salts - 1).cast("long"))))
        known = held.join(dealt, ["x", "salt"]).drop("salt")
        rows = self.state.groupBy("chunk").cogroup(known.groupBy("of_chunk")).applyInArrow(work, "x long, y long, z long, w long, n long")
        return rows.groupBy("x", "y", "z", "w").agg(F.sum("n").alias("a"))

    def cuts(self, langs: DataFrame, rank: int) -> DataFrame:
        """``lang, cut``: the score of the pair at ``rank``, 0 where there are fewer."""
        at = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score")))
        found = self.pairs.select("lang", "score", at.alias("at")).where(F.col("at") <= rank).where(F.col("at") == rank)
        return langs.join(found, "lang", "left").select("lang", F.coalesce("score", F.lit(0)).alias("cut"))

    def survivors(self, cuts: DataFrame) -> DataFrame:
        """All phrases of the languages in ``cuts`` that score at the cut or above and that no longer phrase absorbs."""
        a, enough = F.col("a"), F.col("a") >= self.least
        pairs = self.pairs.join(cuts, "lang")
        asked = pairs.select("x", "y", (_div(a, F.col("fx") + a) >= F.col("cut")).alias("open"), (F.col("score") >= F.col("cut")).alias("probe")).where("open OR probe")
        grown = store(self.ask(_grow("xy"), asked).where(enough).select("x", "y", "z", "a"), "phrases-grown")
        head = pairs.select("x", "y", "lang", "cut", "tx", "ty", "fx", F.col("a").alias("fxy"))
        tail = self.pairs.select(F.col("x").alias("y"), F.col("y").alias("z"), F.col("ty").alias("tz"), F.col("fy").alias("fz"), F.col("a").alias("fyz"))
        triples = grown.join(head, ["x", "y"]).join(tail, ["y", "z"]).withColumn("best", _lowest([(F.col("fx"), F.col("fyz")), (F.col("fxy"), F.col("fz"))], a))
        bound = F.least(_div(a, F.col("fx") + a), _div(a, F.col("fxy") + a))
        triples = store(triples.select("*", "best.score", F.col("best.l").alias("l"), F.col("best.r").alias("r"), (bound >= F.col("cut")).alias("open"), (F.col("best.score") >= F.col("cut")).alias("probe")).drop("best"), "phrases-triples")
        fours = self.ask(_grow("xyz"), triples.where("open OR probe").select("x", "y", "z", "open", "probe")).where(enough)
        head = triples.select("x", "y", "z", "lang", "cut", "tx", "ty", "tz", "fx", "fxy", F.col("a").alias("fxyz"), F.col("open").alias("grown"))
        tail = self.pairs.select(F.col("x").alias("z"), F.col("y").alias("w"), F.col("ty").alias("tw"), F.col("fy").alias("fw"), F.col("a").alias("fzw"))
        rest = triples.select(F.col("x").alias("y"), F.col("y").alias("z"), F.col("z").alias("w"), F.col("a").alias("fyzw"))
        # a phrase whose first triple was never grown is bounded below the cut: only its count matters
        fours = store(fours.join(head, ["x", "y", "z"], "left").join(tail, ["z", "w"]).join(rest, ["y", "z", "w"], "left"), "phrases-fours")
        two, three = (F.col("fxy"), F.col("fzw")), (F.col("fxyz"), F.col("fw"))
        wanted = fours.where("grown AND fyzw IS NULL").where(F.least(*(_div(a, x + y) for x, y in (two, three))) >= F.col("cut"))
        # rests that no growth has met are counted by name
        named = store(wanted.select(F.col("y").alias("x"), F.col("z").alias("y"), F.col("w").alias("z")).distinct(), "phrases-named")
        late = self.ask(_body(_named), named).select(F.col("x").alias("y"), F.col("y").alias("z"), F.col("z").alias("w"), F.col("a").alias("late"))
        scored = fours.where("grown")
        scored = (scored.withColumn("late", F.lit(None).cast("long")) if named.isEmpty() else scored.join(late, ["y", "z", "w"], "left")).withColumn("fyzw", F.coalesce("fyzw", "late")).where("fyzw IS NOT NULL")
        best = _lowest([(F.col("fx"), F.col("fyzw")), two, three], a)
        scored = scored.withColumn("best", best).where(F.col("best.score") >= F.col("cut"))

        def absorbed(longer: DataFrame, to: str, *parts: str) -> DataFrame:
            each = [longer.select(*(F.col(c).alias(n) for c, n in zip(p, to)), F.col("a").alias("longer")) for p in parts]
            return reduce(DataFrame.union, each).groupBy(*to).agg(F.max("longer").alias("longer"))

        stays = F.col("longer").isNull() | (F.col("longer") * 5 < a * ABSORB)
        two_words = pairs.where(F.col("score") >= F.col("cut")).join(absorbed(grown, "xy", "xy", "yz"), ["x", "y"], "left").where(stays)
        three_words = triples.where("probe").join(absorbed(fours, "xyz", "xyz", "yzw"), ["x", "y", "z"], "left").where(stays)
        out = [two_words.select("lang", _phrase("tx", "ty").alias("phrase"), "a", "l", "r", "score"), three_words.select("lang", _phrase("tx", "ty", "tz").alias("phrase"), "a", "l", "r", "score"),
               scored.select("lang", _phrase("tx", "ty", "tz", "tw").alias("phrase"), "a", "best.l", "best.r", "best.score")]
        return store(reduce(DataFrame.union, out), "phrases-left")


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = LEAST, limit: int = LIMIT) -> DataFrame:
    """The ``limit`` best phrases of every language: ``lang, rank, phrase, a, l, r, n, score``.

    ``a, l, r`` are counts of the phrase and of both parts of its lowest-scoring cut, ``n`` the words
    of the language. A null language is ``und``, null and empty texts have no words; repeated rows
    count each; languages without a phrase of ``least`` occurrences give no rows, an empty table
    gives none; other columns are not read. Ties go by count, then by the bytes of the phrase.
    """
    spark = docs.sparkSession
    miner = Miner(docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text")), least)
    open_, done, rank = miner.pairs.select("lang").distinct(), [], FIRST * limit
    while True:
        cuts = store(miner.cuts(open_, rank), "phrases-cuts")
        left = miner.survivors(cuts)
        held = left.groupBy("lang").agg(F.count(F.lit(1)).alias("held"))
        settled = store(cuts.join(held, "lang", "left").withColumn("settled", (F.col("cut") == 0) | (F.coalesce("held", F.lit(0)) >= limit)), "phrases-settled")
        done.append(left.join(settled.where("settled").select("lang"), "lang", "left_semi"))
        open_ = settled.where("NOT settled").select("lang")
        if open_.isEmpty():
            break
        rank *= FURTHER
    at = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))
    best = reduce(DataFrame.union, done).withColumn("rank", at).where(F.col("rank") <= limit).withColumn("rank", F.col("rank").cast("long"))
    return best.join(miner.size, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = f"""
WITH words AS (
    SELECT lang, list_filter(regexp_extract_all(piece, '[^\\x20\\x09]+'), lambda x: len(x) > 0) AS w
    FROM (SELECT coalesce(lang, 'und') AS lang,
                 unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)
), grams AS (
    SELECT lang, k, unnest(list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: w[i:i + k - 1])) AS g FROM words, (SELECT unnest([1, 2, 3, 4]) AS k)
), f AS MATERIALIZED (SELECT lang, k, g, count(*) AS a FROM grams GROUP BY ALL),
sizes AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS MATERIALIZED (SELECT * FROM f WHERE k > 1 AND a >= {LEAST}),
cut AS (SELECT *, unnest(range(1, k)) AS c FROM cand),
scored AS (
    SELECT cut.lang, cut.k, cut.g, cut.a, l.a AS l, r.a AS r, ({2 * POINTS}::HUGEINT * cut.a // (l.a + r.a))::BIGINT AS score,
           row_number() OVER (PARTITION BY cut.lang, cut.g ORDER BY {2 * POINTS}::HUGEINT * cut.a // (l.a + r.a), c) AS pick
    FROM cut JOIN f l ON l.lang = cut.lang AND l.g = cut.g[1:c] JOIN f r ON r.lang = cut.lang AND r.g = cut.g[c + 1:]
), inner_ AS (
    SELECT lang, g[i:i + m - 1] AS part, max(a) AS longer
    FROM (SELECT lang, k, g, a, m, unnest(range(1, k - m + 2)) AS i FROM cand, (SELECT unnest([2, 3]) AS m) WHERE m < k) GROUP BY ALL
), kept AS (
    SELECT s.* FROM scored s LEFT JOIN inner_ x ON x.lang = s.lang AND x.part = s.g WHERE pick = 1 AND (x.longer IS NULL OR 100 * x.longer < 80 * s.a)
), ranked AS (
    SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= {LIMIT}
"""


@query("op13_collocations", SQL)
def op13_collocations(spark: SparkSession, base: str) -> DataFrame:
    """The 2,000 best phrases of every language of the documents."""
    return collocations(documents(spark, base))
