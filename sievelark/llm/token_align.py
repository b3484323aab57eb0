"""Alignment of two tokenizers over a corpus: groups with common ends, links of overlapping tokens, counts of linked ids.

Texts are cut into pieces at blanks where both tokenizers provably start a new token, so one
alignment serves every occurrence of a piece. Inside a task the work is Arrow kernels over the
distinct pieces: token lists are flattened with their parent indices, segmented cumulative sums
give the ends of tokens, an Acero join on (piece, end) finds the common ends, and
``Table.group_by`` counts links, which Spark sums over all tasks.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from sievelark.llm.common import documents, raw_texts, store
from sievelark.llm.registry import query

TOKENIZERS = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A task hands on its documents in chunks of so many bytes of text or so many distinct pieces; this changes costs only.
CHUNK_BYTES, CHUNK_PIECES = 32 << 20, 300_000
#: Bytes of one text that are cut at a time, and pieces that are aligned at a time.
SLICE, AT_ONCE = 4 << 20, 20_000
#: Pair key: id of A times this plus id of B.
_SHIFT = 1 << 31
#: The pattern of byte-level pre-tokenisation (fixed value of the public vocabulary).
_PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A blank after an ASCII sign or a two-byte letter starts a new token in both tokenizers, unless only blanks follow.
_CUT = re.compile(rb"(?:(?<=[\x21-\x7E])|(?<=[\xC3-\xDF][\x80-\xBF]))\x20(?=\x20*[^\x20])")
#: Blanks that are no such cut; a text without them is cut at every blank.
_UNCUT = re.compile(rb"\x20(?:\x20|$)|(?:[\x00-\x1F\x7F]|\xC2[\x80-\xBF]|[\xE0-\xFF][\x80-\xBF]+)\x20")

Encoder = tuple[Callable[[list[str]], list[list[int]]], list[bytes]]


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies: itself where printable in Latin-1, else U+0100 onwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_level(spec: bytes) -> Encoder:
    """Encoder of a byte-level BPE file for texts with a blank set before them, and the bytes of every id.

    Where the merges stand in the order of their ids, ranks are enough and the quicker rank encoder
    gives the same tokens; any other file is encoded by its own library.
    """
    model = json.loads(spec)
    alphabet, vocab = _byte_alphabet(), model["model"]["vocab"]
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    token = [b""] * (max([*vocab.values(), *special.values()]) + 1)
    for text, i in vocab.items():
        token[i] = text.encode() if text in special else bytes(alphabet[c] for c in text)
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["model"]["merges"]]
    pre = model["pre_tokenizer"]
    by_rank = merged == sorted(merged) and pre["type"] == "ByteLevel" and not pre["add_prefix_space"] and pre.get("use_regex", True) and model["normalizer"] is None
    if by_rank:
        import tiktoken

        ranks = {b: i for i, b in enumerate(token) if b and i not in special.values()}
        encode = tiktoken.Encoding("byte_level", pat_str=_PRETOKENS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda texts: [encode(" " + t) for t in texts], token
    from tokenizers import Tokenizer

    full = Tokenizer.from_str(spec.decode())
    full.encode_special_tokens = True
    return lambda texts: [e.ids for e in full.encode_batch([" " + t for t in texts], add_special_tokens=False)], token


def piece_level(spec: bytes) -> Encoder:
    """Encoder of a sentence-piece model, which sets a blank before every text, and the bytes of every id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=spec)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    token = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
    return lambda texts: model.encode(texts, num_threads=1), token


@lru_cache(2)
def _encoders(a: bytes, b: bytes) -> tuple[Encoder, Encoder, bool]:
    left, right = byte_level(a), piece_level(b)
    # a token of B with a blank after another sign could span a cut
    return left, right, not any(re.search(rb"[^\x20]\x20", t) for t in right[1])


def pieces_of(text: bytes, cut: bool = True) -> Iterator[list[bytes]]:
    """Lists of the pieces of blank + text, each without the blank that it starts with, a bounded part of the text at a time."""
    at = 0
    while cut and len(text) - at > SLICE and (m := _CUT.search(text, at + SLICE)):
        yield _cut(text[at:m.start()])
        at = m.end()
    rest = text[at:] if at else text
    yield _cut(rest) if cut else [rest]


def _cut(text: bytes) -> list[bytes]:
    return _CUT.split(text) if text.startswith(b" ") or _UNCUT.search(text) else text.split(b" ")


def _lists(rows: list[list[int]]) -> pa.ListArray:
    return pa.array(rows, pa.list_(pa.int32()))


def _ends(tokens: pa.ListArray, lengths: pa.Array, side: str) -> pa.Table:
    """One row per token: its piece (parent index), its end in bytes (cumulative sum within the piece) and its position in the flat list."""
    flat, parent = pc.list_flatten(tokens), pc.list_parent_indices(tokens)
    run = pc.cumulative_sum(pc.take(lengths, flat))
    before = pa.concat_arrays([pa.array([0], pa.int64()), run.combine_chunks() if isinstance(run, pa.ChunkedArray) else run])
    start = pc.take(before, pc.take(tokens.offsets, parent))
    return pa.table({"piece": parent.cast(pa.int64()), "end": pc.subtract(run, start), side: pa.array(np.arange(len(flat), dtype=np.int64))})


class Aligned:
    """Alignment of distinct pieces (blanks set before them): per piece its token, group and link numbers, its groups as text, and its links as pair keys."""

    def __init__(self, pieces: list[bytes], left: Encoder, right: Encoder) -> None:
        texts = [p.decode() for p in pieces]
        a, b = left[0](texts), right[0](texts)
        at, bt = left[1], right[1]
        self.valid = np.fromiter((b"".join(map(at.__getitem__, x)) == b" " + p == b"".join(map(bt.__getitem__, y)) for p, x, y in zip(pieces, a, b)), bool, len(pieces))
        la = _lists([x if v else [] for x, v in zip(a, self.valid)])
        lb = _lists([y if v else [] for y, v in zip(b, self.valid)])
        n = len(pieces)
        ends_a = _ends(la, pa.array(list(map(len, at)), pa.int64()), "ia")
        ends_b = _ends(lb, pa.array(list(map(len, bt)), pa.int64()), "ib")
        both = ends_a.join(ends_b, ["piece", "end"], join_type="full outer", use_threads=False).sort_by([("piece", "ascending"), ("end", "ascending")])
        piece = both["piece"].to_numpy()
        in_a, in_b = pc.is_valid(both["ia"]).to_numpy(), pc.is_valid(both["ib"]).to_numpy()
        # up to its end a stretch lies in the token that ends next, on either side
        flat_a, flat_b = pc.list_flatten(la).to_numpy(), pc.list_flatten(lb).to_numpy()
        ia, ib, group = (np.cumsum(x) - x for x in (in_a, in_b, in_a & in_b))
        self.links = flat_a[ia].astype(np.int64) * _SHIFT + flat_b[ib]
        self.n_links = np.bincount(piece, minlength=n).astype(np.int64)
        self.n_a, self.n_b = np.diff(la.offsets.to_numpy()).astype(np.int64), np.diff(lb.offsets.to_numpy()).astype(np.int64)
        self.n_groups = np.bincount(piece[in_a & in_b], minlength=n).astype(np.int64)
        self.text = self._texts(n, piece, group, in_a, in_b, flat_a, flat_b)

    @classmethod
    def of(cls, pieces: list[bytes], left: Encoder, right: Encoder) -> Aligned:
        """The same, a bounded number of pieces at a time."""
        parts = [cls(pieces[i:i + AT_ONCE], left, right) for i in range(0, max(len(pieces), 1), AT_ONCE)]
        out = parts[0]
        for name in ("valid", "links", "n_links", "n_a", "n_b", "n_groups"):
            setattr(out, name, np.concatenate([getattr(x, name) for x in parts]))
        out.text = [t for x in parts for t in x.text]
        return out

    @staticmethod
    def _texts(n, piece, group, in_a, in_b, flat_a, flat_b) -> list[bytes]:
        """``a1,a2|b1;a3|b2`` of every piece."""
        both = in_a & in_b
        parts = pa.table({
            "piece": np.concatenate([piece[in_a], piece[in_b]]), "group": np.concatenate([group[in_a], group[in_b]]),
            "side": np.repeat(np.array([0, 1], np.int8), [in_a.sum(), in_b.sum()]), "at": np.arange(len(flat_a) + len(flat_b)),
            "id": np.concatenate([flat_a, flat_b]), "last": np.concatenate([both[in_a], both[in_b]]),
        }).sort_by([("group", "ascending"), ("side", "ascending"), ("at", "ascending")])
        sign = pc.if_else(parts["last"], pc.if_else(pc.equal(parts["side"], 0), "|", ";"), ",")
        signed = pc.binary_join_element_wise(parts["id"].cast(pa.string()), sign, "").combine_chunks()
        bounds = np.searchsorted(parts["piece"].to_numpy(), np.arange(n + 1)).astype(np.int32)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), signed), "")
        return [t[:-1] for t in joined.cast(pa.binary()).to_pylist()]


class _Ordinals(dict):
    """Piece -> number in the order of first sight."""

    def __missing__(self, piece: bytes) -> int:
        self[piece] = n = len(self)
        return n


def _packed(x: np.ndarray, dtype=np.int32) -> bytes:
    return pa.compress(x.astype(dtype).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, size: int, dtype=np.int32) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, size * np.dtype(dtype).itemsize, codec="zstd", asbytes=True), dtype)


_CHUNK = pa.schema([
    ("chunk", pa.string()), ("ids", pa.list_(pa.int64())), ("n_a", pa.list_(pa.int64())), ("n_b", pa.list_(pa.int64())), ("n_groups", pa.list_(pa.int64())), ("n_links", pa.list_(pa.int64())),
    ("groups_sha256", pa.list_(pa.string())), ("doc_at", pa.list_(pa.int64())), ("pieces", pa.binary()), ("link_at", pa.list_(pa.int64())), ("links", pa.binary()), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
])
_CHUNK_DDL = (
    "chunk string, ids array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, groups_sha256 array<string>, "
    "doc_at array<bigint>, pieces binary, link_at array<bigint>, links binary, pairs array<bigint>, counts array<bigint>"
)
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class _Chunk:
    def __init__(self) -> None:
        self.ids, self.docs, self.size, self.ordinal = [], [], 0, _Ordinals()

    def add(self, key, text: bytes | None, cut: bool) -> None:
        self.ids.append(key)
        parts = [np.fromiter(map(self.ordinal.__getitem__, p), np.int32) for p in pieces_of(text, cut)] if text else []
        self.docs.append(np.concatenate(parts) if parts else np.empty(0, np.int32))
        self.size += len(text) if text else 0

    def full(self) -> bool:
        return self.size >= CHUNK_BYTES or len(self.ordinal) >= CHUNK_PIECES

    def row(self, name: str, left: Encoder, right: Encoder) -> pa.RecordBatch:
        al = Aligned.of(list(self.ordinal), left, right)
        link_at = np.cumsum([0, *al.n_links])
        # a document with one piece that does not come back has no tokens at all
        docs = [d if al.valid[d].all() else d[:0] for d in self.docs]
        at = np.cumsum([0, *map(len, docs)])
        flat = np.concatenate([*docs, np.empty(0, np.int32)]).astype(np.int32)

        def summed(x: np.ndarray) -> np.ndarray:
            run = np.concatenate([[0], np.cumsum(x[flat])])
            return run[at[1:]] - run[at[:-1]]

        sha = [hashlib.sha256(b";".join(map(al.text.__getitem__, d.tolist()))).hexdigest() if len(d) else "" for d in docs]
        seen = np.bincount(flat, minlength=len(self.ordinal)).astype(np.int64)
        pairs = pa.table({"pair": al.links, "n": np.repeat(seen, al.n_links)}).group_by("pair", use_threads=False).aggregate([("n", "sum")]).sort_by("pair")
        keys, counts = pairs["pair"].to_numpy(), pairs["n_sum"].to_numpy()
        return pa.RecordBatch.from_arrays([
            pa.array([name]), pa.array([self.ids], pa.list_(pa.int64())), *(pa.array([summed(x)], pa.list_(pa.int64())) for x in (al.n_a, al.n_b, al.n_groups, al.n_links)),
            pa.array([sha], pa.list_(pa.string())), pa.array([at], pa.list_(pa.int64())), pa.array([_packed(flat)], pa.binary()), pa.array([link_at], pa.list_(pa.int64())),
            pa.array([_packed(np.searchsorted(keys, al.links))], pa.binary()), pa.array([keys], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())),
        ], schema=_CHUNK)


def _chunks(docs: DataFrame, a: bytes, b: bytes) -> DataFrame:
    spec = docs.sparkSession.sparkContext.broadcast((a, b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, cut = _encoders(*spec.value)
        part, made, chunk = TaskContext.get().partitionId(), 0, _Chunk()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                for key, text in zip(piece.column(0).to_pylist(), raw_texts(piece)):
                    chunk.add(key, text, cut)
                    if chunk.full():
                        yield chunk.row(f"{part}-{made}", left, right)
                        made, chunk = made + 1, _Chunk()
        if chunk.ids:
            yield chunk.row(f"{part}-{made}", left, right)

    return docs.mapInArrow(run, _CHUNK_DDL)


def _spread(chunks: DataFrame) -> DataFrame:
    pair = F.explode(F.arrays_zip("pairs", "counts")).alias("x")
    return chunks.select("chunk", pair).select("chunk", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))


def _totals(chunks: DataFrame) -> DataFrame:
    return _spread(chunks).groupBy("pair").agg(F.sum("n").alias("links")).withColumn("b_id", F.col("pair") % _SHIFT)


@cache
def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _specs(a: str | None, b: str | None) -> tuple[bytes, bytes]:
    # vocabulary files of a few MB; tasks get their bytes by broadcast
    return _read(a or os.path.join(TOKENIZERS, A_FILE)), _read(b or os.path.join(TOKENIZERS, B_FILE))


def pair_counts(docs: DataFrame, *, text: str = "text", a: str | None = None, b: str | None = None) -> DataFrame:
    """``a_id, b_id, links``: how many links of the corpus hold the two ids linked. Null and empty texts have none."""
    rows = docs.select(F.lit(None).cast("long").alias("id"), F.col(text).alias("text"))
    return _totals(store(_chunks(rows, *_specs(a, b)), "align")).select(F.expr(f"pair div {_SHIFT}").cast("int").alias("a_id"), F.col("b_id").cast("int"), "links")


def align(docs: DataFrame, *, id: str = "doc_id", text: str = "text", a: str | None = None, b: str | None = None) -> DataFrame:
    """Alignment figures of every text under tokenizers ``a`` (byte-level BPE) and ``b`` (sentence pieces).

    ``docs`` needs an integer ``id`` and ``text``; other columns, whatever their names, are not read.
    One row per input row: repeated rows and equal or null ids stay apart and each counts in the corpus.
    Null and empty texts, and texts that either tokenizer does not give back byte by byte, have zeros
    and the empty ``groups_sha256``. An empty table gives no rows.
    """
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    chunks = store(_chunks(rows, *_specs(a, b)), "align")
    totals = _totals(chunks)
    totals = store(totals, "align-pairs")
    top = totals.groupBy("b_id").agg(F.max("links").alias("top"))
    known = totals.join(top, "b_id").select("pair", "links", (F.col("links") == F.col("top")).alias("best"))
    answer = _spread(chunks).select(F.col("chunk").alias("of_chunk"), "pair").join(known, "pair")

    def weigh(chunk: pa.Table, pairs: pa.Table) -> pa.Table:
        out = []
        order = np.argsort(pairs["pair"].to_numpy())
        links, best = pairs["links"].to_numpy()[order], pairs["best"].to_numpy()[order].astype(np.int64)
        for c in chunk.to_pylist():
            at, link_at = np.array(c["doc_at"]), np.array(c["link_at"])
            flat, held = _unpacked(c["pieces"], int(at[-1])), _unpacked(c["links"], int(link_at[-1]))

            def per_doc(w: np.ndarray) -> np.ndarray:
                run = np.concatenate([[0], np.cumsum(w[held])])
                run = np.concatenate([[0], np.cumsum((run[link_at[1:]] - run[link_at[:-1]])[flat])])
                return run[at[1:]] - run[at[:-1]]

            out.append(pa.table([
                pa.array(c["ids"], pa.int64()), *(pa.array(c[k], pa.int64()) for k in ("n_a", "n_b", "n_groups", "n_links")), pa.array(per_doc(best), pa.int64()), pa.array(per_doc(links), pa.int64()), pa.array(c["groups_sha256"], pa.string()),
            ], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]))
        return pa.concat_tables(out)

    blobs = chunks.select("chunk", "ids", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "doc_at", "pieces", "link_at", "links")
    return blobs.groupBy("chunk").cogroup(answer.groupBy("of_chunk")).applyInArrow(weigh, RESULT)


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, base: str) -> DataFrame:
    """Groups, links and corpus-wide link counts of every document under the two default vocabularies."""
    return align(documents(spark, base))
