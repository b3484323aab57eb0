"""Shared helpers: words, stable word hashes, deterministic splits, the shared folder."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sievelark.session import ensure_checkpoint_dir
from sievelark.sources.tables import table

#: Java pattern of one word: anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents")


def words(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text with A-Z lower-cased; ``bytes.split`` cuts at exactly the six ASCII blanks."""
    return text.lower().split() if text else []


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """UTF-8 bytes of a text column, without decoding."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def each_text(batch: pa.RecordBatch, name: str = "text", rows: int = 256) -> Iterator[bytes | None]:
    """UTF-8 bytes of a text column, a few rows at a time, so that a batch is never held twice."""
    column = batch.column(batch.schema.get_field_index(name))
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).cast(pa.binary()).to_pylist()


def give_back() -> None:
    """Return freed memory of this task's Python process to the machine; a reused worker keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass


class _Hashes(dict):
    """Word -> 64-bit hash, kept for repeated words up to a bound."""

    def __missing__(self, w: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[w] = h = xxhash.xxh3_64_intdigest(w)
        return h


_HASHES = _Hashes()


def hash_words(tokens: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter(map(_HASHES.__getitem__, tokens), np.uint64, len(tokens))


_BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
#: The low bytes of a 64-bit number, by how many of them belong to a word.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def text_hashes(text: bytes | None) -> np.ndarray:
    """64-bit hashes of a text's :func:`words`, without an object per word: up to 24 bytes enter as numbers, eight at a time."""
    if not text:
        return np.zeros(0, np.uint64)
    t = b" " + text.lower() + b" " * 25
    blank = _BLANK[np.frombuffer(t, np.uint8)]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    start, size = edge[::2], edge[1::2] - edge[::2]
    eight = np.ndarray(len(t) - 7, "<u8", t, strides=(1,))
    with np.errstate(over="ignore"):
        h = mix64((eight[start] & _LOW[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        for at in (8, 16):
            more = np.flatnonzero(size > at)
            if not len(more):
                return h
            h[more] = mix64(h[more] ^ ((eight[start[more] + at] & _LOW[np.minimum(size[more] - at, 8)]) * np.uint64(0xD6E8FEB86659FD93)))
    for i in np.flatnonzero(size > 24):
        h[i] = xxhash.xxh3_64_intdigest(t[start[i]:start[i] + size[i]])
    return h


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit number over all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` word hashes; a shorter sequence counts as one run, an empty one has none."""
    n = len(h)
    if n == 0:
        return h
    k = min(k, n)
    with np.errstate(over="ignore"):
        out = h[:n - k + 1] + np.uint64(k)
        for j in range(1, k):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[j:n - k + 1 + j]
    return mix64(out)


def held_out(key: Column, parts: int) -> Column:
    """Rows whose key's CRC-32 (as text) is divisible by ``parts``; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == 0


def text_key(text: Column) -> Column:
    """128 bits that stand for a text, as text; null and the empty text agree."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI below the checkpoint folder that driver and executors share."""
    ensure_checkpoint_dir(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: survives lost executors and cuts lineage."""
    out = shared_folder(df.sparkSession, name)
    df.write.parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores before it until no column is called so."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def batched(items: Iterator, size: int) -> Iterator[list]:
    part = []
    for x in items:
        part.append(x)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part
