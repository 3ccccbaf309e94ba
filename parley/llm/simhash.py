"""SimHash near-duplicates by Golay-code fuzzy hashing (operator 8).

Fingerprint: 64 bits, each the majority over XXH64 (seed 42) of a text's 3-word shingles. The
fingerprint is cut into segments of 23, 23 and 18 bits. With at most two errors in all, one
segment has none (pigeonhole) and the next has two at most. The perfect binary Golay code
(23 bits, 12 of data) covers the second: words at distance two have a common neighbour, so
the codewords to which a word and its 23 neighbours decode (one or six of them) include a
common one. Each fingerprint gets a key for every segment taken as exact and every codeword
of the next segment; fingerprints that share a key are joined and verified.

Copies are no matter: keys and links are of distinct fingerprints. A key with more than
`PAIRED` fingerprints isn't paired: words link within two bits exactly if some word is within
one bit of both, so its members meet at these midpoints, in linear number, and each
midpoint's members link to its smallest. Both ways find every link.

Cases: null or empty text and text of white space have fingerprint zero, linked like any
other; fewer than three words are one shingle; repeated shingles count as often as they
stand; equal texts and repeated rows have equal fingerprints; rows with a null id get the
component of their fingerprint and count for its smallest id only if no id is there (null
then); an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, cut_lineage, map_arrow, without
from .components import components

SHINGLE = 3
DISTANCE = 2
#: Segments of the fingerprint: (shift, bits). The last is shortened: its missing bits are zero.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1. Fixed value.
GENERATOR = 0xAE3
PAIRED = 24
_BLOCK = 1 << 15


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of one text."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(size, len(words))
    count = np.zeros(64, np.int64)
    total = len(words) - size + 1
    digest = xxhash.xxh64_digest
    for at in range(0, total, _BLOCK):
        upto = min(at + _BLOCK, total)
        spans = zip(starts[at:upto].tolist(), ends[at + size - 1 : upto + size - 1].tolist())
        made = b"".join([digest(line[s:e], 42) for s, e in spans])
        bits = np.unpackbits(np.frombuffer(made, np.uint8).reshape(-1, 8), axis=1)
        count += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(count * 2 > total).tobytes(), "big")


def add_fingerprint(df: DataFrame, text_col: str = "text", out_col: str = "fp", size: int = SHINGLE) -> DataFrame:
    """df with the fingerprint as a signed 64-bit integer."""

    def make():
        return lambda texts: (np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64),)

    return add_columns(df, text_col, {out_col: "bigint"}, make)


def syndromes() -> np.ndarray:
    """Error pattern (of three bits at most) for each of the 2^11 syndromes of the Golay code."""
    one = np.array([1 << i for i in range(23)], np.int64)
    words = [np.zeros(1, np.int64), one]
    words.append(np.array([a | b for i, a in enumerate(one) for b in one[:i]], np.int64))
    words.append(np.array([a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j]], np.int64))
    errors = np.concatenate(words)
    table = np.zeros(1 << 11, np.int64)
    table[remainder(errors)] = errors
    return table


def remainder(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words modulo the generator polynomial."""
    rest = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - 11), 0)
    return rest


def decoded(words: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Twelve-bit index of the codeword nearest to each 23-bit word."""
    return (words ^ table[remainder(words)]) >> 11


def keys(fingerprints: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in the input, key) of all keys of unsigned 64-bit fingerprints."""
    at, made = [], []
    flips = np.array([0] + [1 << i for i in range(23)], np.int64)
    parts = [(fingerprints >> np.uint64(s) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in SEGMENTS]
    for k, exact in enumerate(parts):
        near = np.sort(decoded(parts[(k + 1) % len(parts)][:, None] ^ flips[None, :], table), axis=1)
        new = np.concatenate([np.ones((len(near), 1), bool), near[:, 1:] != near[:, :-1]], axis=1)
        row, _ = np.nonzero(new)
        at.append(row)
        made.append(np.int64(k) << 35 | exact[row] << 12 | near[new])
    return np.concatenate(at), np.concatenate(made)


def _keyed(distinct: DataFrame) -> DataFrame:
    def run(batches):
        table = syndromes()
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False)
            at, made = keys(fps.view(np.uint64), table)
            yield pa.RecordBatch.from_arrays([pa.array(fps[at]), pa.array(made)], names=["fp", "key"])

    return map_arrow(distinct, run, "fp bigint, key bigint")


def _midpoints(members: DataFrame) -> DataFrame:
    """(word, fp): each fingerprint at itself and at its 64 neighbours."""

    def run(batches):
        flips = np.concatenate([[0], 1 << np.arange(64, dtype=np.uint64)]).astype(np.uint64).view(np.int64)
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False)
            word = (fps[:, None] ^ flips[None, :]).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(np.repeat(fps, 65))], names=["word", "fp"])

    return map_arrow(members, run, "word bigint, fp bigint")


def links(distinct: DataFrame) -> DataFrame:
    """(u, v) pairs of distinct fingerprints within two bits that connect all that are linked."""
    keyed = cut_lineage(_keyed(distinct))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = keyed.join(sizes, "key")
    few = shared.where(F.col("n") <= PAIRED).select("key", "fp")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= DISTANCE
    pairs = few.withColumnRenamed("fp", "u").join(few.withColumnRenamed("fp", "v"), "key").where((F.col("u") < F.col("v")) & near)
    many = _midpoints(shared.where(F.col("n") > PAIRED).select("fp").distinct())
    low = many.groupBy("word").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1")
    stars = many.join(low, "word").where("fp != v").select(F.col("fp").alias("u"), "v")
    return pairs.select("u", "v").union(stars).distinct()


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", size: int = SHINGLE) -> DataFrame:
    """docs without their text, with `fp` (signed 64 bits), `component_id` (smallest id linked directly or through others)
    and `component_fp` (a fingerprint that stands for the component)."""
    marked = without(add_fingerprint(docs, text_col, "fp", size), [text_col, "component_id", "component_fp"])
    marked = cut_lineage(marked)
    distinct = cut_lineage(marked.groupBy("fp").agg(F.min(id_col).alias("low")))
    roots = components(links(distinct.select("fp")))
    placed = distinct.join(roots.withColumnRenamed("vertex", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    found = placed.join(lowest, "root").select("fp", "component_id", F.col("root").alias("component_fp"))
    return marked.join(found, "fp").select(*marked.columns, "component_id", "component_fp")


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
