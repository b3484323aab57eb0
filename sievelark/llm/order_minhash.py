"""Order MinHash fingerprints, sensitive to edits and to order, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sievelark.llm.common import documents, store, text_key
from sievelark.llm.registry import query
from sievelark.operators.scan import ordered_scan

K = 3
BINS_LOG2 = 5
#: A text position takes 28 bits of a packed number, a hash the other 36.
POS_BITS = 28
LOW = (1 << POS_BITS) - 1


def with_signature(df: DataFrame, text: str, out: str, k: int = K, bins_log2: int = BINS_LOG2) -> DataFrame:
    """Add ``out``: an array of 64-bit numbers, one per non-empty bin, that fingerprints ``text``.

    The k-mers are runs of ``k`` blank-separated tokens (a text with fewer tokens is one
    k-mer; null and empty texts are the empty token). Every k-mer is numbered by its
    occurrence, so repeats count. The numbered k-mers are hashed into ``2 ** bins_log2``
    bins by one permutation; a bin keeps its two minimal ones, puts them in text order and
    hashes that tuple. Equal texts have equal signatures; moving blocks changes tuples.
    All work stays inside a row, so nothing is shuffled, and is linear in the text but for
    two sorts of numbers.
    """
    a, b, c, d, e, f, g = (f"_{out}_{x}" for x in "abcdefg")
    top = 64 - bins_log2
    df = df.withColumn(a, F.split(F.translate(F.coalesce(F.col(text), F.lit("")), "\t\n\x0b\f\r", "     "), " "))
    parts = ", ".join(f"get({a}, i + {j})" for j in range(k))
    # hash and position packed: sorting brings equal k-mers together, in text order
    df = df.withColumn(b, F.expr(f"sort_array(transform(sequence(0, greatest(size({a}) - {k}, 0)), i -> (shiftleft(xxhash64({parts}), {POS_BITS}) | cast(i as bigint))))"))
    same = lambda arr: f"coalesce(shiftright(get({arr}, i - 1), {POS_BITS}) = shiftright(x, {POS_BITS}), false)"
    df = df.withColumn(c, F.expr(f"filter({b}, (x, i) -> not {same(b)})"))
    # later occurrences only: the start of every run of equal k-mers numbers its members
    df = df.withColumn(d, F.expr(f"if(size({c}) = size({b}), cast(array() as array<bigint>), filter({b}, (x, i) -> {same(b)}))"))
    df = df.withColumn(e, F.expr(f"filter(transform({d}, (x, i) -> if({same(d)}, null, i)), i -> i is not null)"))
    again = (f"flatten(transform({e}, (s, j) -> transform(slice({d}, s + 1, coalesce(get({e}, j + 1), size({d})) - s), "
             f"(x, n) -> ((xxhash64(shiftright(x, {POS_BITS}), n + 1) & {~LOW}L) | (x & {LOW}L)))))")
    df = df.withColumn(f, F.expr(f"if(size({d}) = 0, {c}, sort_array(concat({c}, sort_array({again}))))"))
    df = df.withColumn(g, F.expr(f"filter({f}, (x, i) -> coalesce(shiftright(get({f}, i - 2), {top}) <> shiftright(x, {top}), true))"))
    first = f"coalesce(shiftright(get({g}, i - 1), {top}) <> shiftright(x, {top}), true)"
    hx, hy = f"shiftright(x, {POS_BITS})", f"shiftright(get({g}, i + 1), {POS_BITS})"
    pair = (f"case when coalesce(shiftright(get({g}, i + 1), {top}) <> shiftright(x, {top}), true) then xxhash64({hx}) "
            f"when (x & {LOW}L) <= (get({g}, i + 1) & {LOW}L) then xxhash64({hx}, {hy}) else xxhash64({hy}, {hx}) end")
    bin_ = f"(shiftright(x, {top}) + {1 << (bins_log2 - 1)})"
    df = df.withColumn(out, F.expr(f"filter(transform({g}, (x, i) -> if({first}, ({pair} & {-(1 << bins_log2)}L) | {bin_}, null)), x -> x is not null)"))
    return df.drop(a, b, c, d, e, f, g)


def signature_text(sig: Column) -> Column:
    return F.concat_ws("", F.transform(sig, lambda x: F.lpad(F.hex(x), 16, "0")))


def likeness(x: Column, y: Column, bins_log2: int = BINS_LOG2) -> Column:
    """Share of the bins filled on either side whose tuples agree, 0 to 1."""
    at = lambda s: F.transform(s, lambda v: v.bitwiseAND(F.lit((1 << bins_log2) - 1)))
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(at(x), at(y)))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likenesses.

    The edited text has its last third replaced by the head of the next document in
    descending id (ties by the text's MD5; null ids last; after the last comes the first).
    Rows that repeat id and text are one document and share their result. Texts move once to
    where the previous document's request is and heads move back; both joins use one shuffle.
    """
    text = F.coalesce("text", F.lit(""))
    key = F.concat_ws(":", F.col("doc_id").cast("string"), text_key(text)).alias("k")
    keys = docs.select(key, "doc_id", F.length(text).cast("long").alias("n_chars")).distinct()
    d = docs.select(key, text.alias("text"))
    order = [F.col("doc_id").isNotNull(), F.col("doc_id"), F.col("k")]
    # ascending order: the next document in descending order is the previous row
    ring = store(ordered_scan(keys, order, position="_at", previous={"_next": "k"}), "ring")
    last = ring.agg(F.max_by("k", "_at")).first()[0]
    ring = ring.select("k", "doc_id", "n_chars", F.coalesce("_next", F.lit(last)).alias("next_k"))
    asked = ring.select(F.col("k").alias("_for"), "doc_id", F.col("next_k").alias("_at"), F.floor(F.col("n_chars") / 3).cast("int").alias("_m"))
    heads = d.join(asked, F.col("k") == F.col("_at")).select("_for", "doc_id", F.expr("left(text, _m)").alias("_head")).dropDuplicates(["_for"])
    e = d.join(heads, F.col("k") == F.col("_for"))
    n = F.length("text")
    e = e.select("k", "doc_id", n.cast("long").alias("n_chars"), "text", F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 3) as int))"), F.col("_head")).alias("_edited"))
    e = with_signature(with_signature(e, "text", "_fp"), "_edited", "_efp")
    e = store(e.select("k", "doc_id", "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"), "_fp", "_efp"), "omh")
    nxt = e.select(F.col("k").alias("_nk"), F.col("_fp").alias("_nfp")).dropDuplicates(["_nk"])
    out = e.join(ring.select("k", "next_k"), "k").join(nxt, F.col("next_k") == F.col("_nk"))
    return out.select("doc_id", "n_chars", "edited_sha256", signature_text(F.col("_fp")).alias("fingerprint"), signature_text(F.col("_efp")).alias("edited_fingerprint"),
                      likeness(F.col("_fp"), F.col("_efp")).alias("near_edited"), likeness(F.col("_fp"), F.col("_nfp")).alias("near_next"))


@query("op3_order_minhash")
def _(spark, base):
    return edited_pairs(documents(spark, base))
