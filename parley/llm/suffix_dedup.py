"""Removal of repeated substrings by difference covers (operator 4).

A byte goes if a string of `LENGTH` bytes that covers it also starts at another place. As in
difference-cover suffix sorting, only sampled positions are named and compared first; a
difference cover D modulo v guarantees that for any two places some offset under v takes both
to sampled positions. Triples (v = 3) would name two thirds of all positions, several times
over; here the covers are Singer sets with v = 307 and v = 57, and what is named is the string
of `LENGTH` - v + 1 bytes from a sampled position, which any repeated string must contain.

1. Sample with v = 307, name 94 bytes, sort by name. Positions whose name occurs at another
   place are kept; only the strings that can contain one of them are looked at further.
2. Recurse on these with v = 57: the narrow name (344 bytes) and the wide name (56 bytes more on
   either side, less at a text's ends). Places that share both repeat all strings between.
3. Where a narrow name has several wide names, the remaining positions are merged: one place
   of each wide name gives the name of each whole string around it, and equal ones are
   neighbours when sorted.

Names are polynomial hashes (two of 64 bits where they decide, one where they filter). A text
is identified by a 64-bit hash. Copies of whole texts are handled once; all they hold goes.

From the second step on, a text goes by a number of its own, and what a step has written for
the next is removed once it has been read, so that the largest step sets the disk needed.

A name is counted within a slice of a partition first: of equal names one row goes on under
the name, the others are known to be repeated and go under names of their own. So a string that
a third of all documents share meets itself once for each slice, in no group of that size.

Cases: null text is empty: nothing in, nothing removed, the digest of no bytes. Texts shorter
than `LENGTH` lose nothing. Repeated rows are other places: all but short texts go. Ids may be
null, equal or clash; they only choose which copy of a text is read. An empty table gives an
empty table. Long texts are hashed in segments of bounded size.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import add_columns, aside, discard, map_arrow, release, stored

LENGTH = 400
COARSE, FINE = 17, 7  # orders of the two Singer sets: moduli 307 and 57
SEGMENT = 1 << 20
SLICE_BYTES = 4 << 20


def singer(q: int) -> tuple[int, list[int]]:
    """(v, D) for a prime q: a set of q + 1 residues modulo v = q * q + q + 1 whose differences are all residues.

    D are the exponents i for which x^i has no square term, x a generator of the field of q^3 elements.
    """
    for a, b, c in itertools.product(range(q), range(q), range(1, q)):
        power, seen = (0, 0, 1), []  # coefficients of x^2, x, 1; x^3 = a x^2 + b x + c
        for i in range(q**3 - 1):
            if i and power == (0, 0, 1):
                break
            seen.append(power)
            s, t, u = power
            power = ((t + a * s) % q, (u + b * s) % q, c * s % q)
        v = q * q + q + 1
        if len(seen) == q**3 - 1:
            return v, [i for i in range(v) if seen[i][0] == 0]
    raise ValueError(f"{q} is no prime")


class Hasher:
    """Normalised polynomial hashes modulo 2^64 of substrings of one segment."""

    BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

    def __init__(self, size: int = SEGMENT + 2 * LENGTH):
        one = np.ones(1, np.uint64)
        self.up = [np.cumprod(np.concatenate([one, np.full(size, b, np.uint64)])) for b in self.BASES]
        self.down = [np.cumprod(np.concatenate([one, np.full(size, pow(b, -1, 1 << 64), np.uint64)])) for b in self.BASES]
        self.value = [np.array([int.from_bytes(hashlib.sha256(bytes([k, b])).digest()[:8], "big") | 1 for b in range(256)], np.uint64) for k in range(2)]

    def sums(self, segment: np.ndarray, k: int) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.value[k][segment] * self.up[k][: len(segment)])])

    def names(self, sums: np.ndarray, k: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (sums[end] - sums[start]) * self.down[k][start]
        h ^= h >> np.uint64(31)
        return h * np.uint64(0xD6E8FEB86659FD93)

    def windows(self, raw: np.ndarray, at: np.ndarray, before: int, after: int, k: int) -> np.ndarray:
        """Names of raw[at - before : at + after], cut to the text, for sorted positions."""
        out, n = np.empty(len(at), np.uint64), len(raw)
        for s in range(0, n, SEGMENT):
            lo, hi = np.searchsorted(at, (s, s + SEGMENT))
            if lo == hi:
                continue
            left, right = max(0, s - before), min(n, s + SEGMENT + after)
            sums, p = self.sums(raw[left:right], k), at[lo:hi]
            out[lo:hi] = self.names(sums, k, np.maximum(p - before, 0) - left, np.minimum(p + after, n) - left)
        return out


def sampled(v: int, cover: np.ndarray, upto: int) -> np.ndarray:
    """Sorted positions below `upto` whose residue modulo v is in the cover."""
    at = (np.arange(0, max(0, upto), v)[:, None] + cover[None, :]).ravel()
    return at[at < upto]


def united(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of the ranges [lo, hi), lo sorted, as disjoint sorted ranges; empty ones go."""
    keep = lo < hi
    lo, hi = lo[keep], np.maximum.accumulate(hi[keep]) if keep.any() else hi[keep]
    new = np.concatenate([[True], lo[1:] > hi[:-1]]) if len(lo) else np.zeros(0, bool)
    return lo[new], np.concatenate([hi[:-1][new[1:]], hi[-1:]]) if len(lo) else hi


def inside(at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which sorted positions lie in disjoint sorted ranges."""
    k = np.searchsorted(lo, at, "right") - 1
    return (k >= 0) & (at < hi[np.maximum(k, 0)]) if len(lo) else np.zeros(len(at), bool)


def listed(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All positions of disjoint sorted ranges."""
    n = hi - lo
    return np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(lo) else np.zeros(0, np.int64)


def candidates(spots: np.ndarray, v: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of the starts of strings that contain the name of one of the sorted sampled positions."""
    return united(np.maximum(spots - v + 1, 0), np.minimum(spots, n - LENGTH) + 1)


def _emit(rows: list, names: tuple[str, ...]):
    """One batch of (name, ..., mark, at, many): names that repeat in the slice keep one row under the name."""
    columns = [np.concatenate([r[i] for r in rows]) for i in range(len(rows[0]))] if rows else [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)] * len(names)
    hashes, mark, at = [c.copy() for c in columns[:-2]], columns[-2], columns[-1]
    order = np.lexsort(hashes)
    same = np.ones(max(0, len(order) - 1), bool)
    for h in hashes:
        same &= h[order[1:]] == h[order[:-1]]
    many = np.zeros(len(order), bool)
    many[order[1:]] |= same
    many[order[:-1]] |= same
    later = order[1:][same]
    own = (mark[later].view(np.uint64) ^ (at[later].astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))) * np.uint64(0x94D049BB133111EB)
    for k, h in enumerate(hashes):
        h[later] = own + np.uint64(k)
    arrays = [pa.array(h.view(np.int64)) for h in hashes] + [pa.array(mark), pa.array(at.astype(np.int32)), pa.array(many)]
    return pa.RecordBatch.from_arrays(arrays, names=[*names, "mark", "at", "many"])


def _named(texts: DataFrame, names: tuple[str, ...], make) -> DataFrame:
    """Rows of names; make() gives a function of (raw text, further columns) that returns hashes and positions.

    Equal texts of a task are named once: they are one text.
    """

    def run(batches):
        fn, done = make(), set()
        rows, size = [], 0
        for b in batches:
            for i, mark in enumerate(b.column(0).to_pylist()):
                raw = b.column(1)[i].as_buffer() if b.column(1)[i].is_valid else None
                if raw is None or mark in done or len(raw) < LENGTH:
                    continue
                done.add(mark)
                *hashes, at = fn(np.frombuffer(raw, np.uint8), *[c[i].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns[2:]])
                rows.append((*hashes, np.full(len(at), mark, np.int64), at))
                size += len(raw)
                if size >= SLICE_BYTES:
                    yield _emit(rows, names)
                    rows, size = [], 0
        if rows:
            yield _emit(rows, names)

    return map_arrow(texts, run, ", ".join(f"{n} bigint" for n in names) + ", mark bigint, at int, many boolean")


def _repeated(rows: DataFrame, names: tuple[str, ...]):
    """Whether a row's names stand at more than one place."""
    w = Window.partitionBy(*names)
    places = (F.min("mark").over(w) < F.max("mark").over(w)) | (F.min("at").over(w) < F.max("at").over(w))
    return F.max("many").over(w) | places


def _gathered(rows: DataFrame, name: str) -> DataFrame:
    """(mark, sorted positions): bounded by the text's length."""
    return rows.groupBy("mark").agg(F.sort_array(F.collect_set("at")).alias(name))


def repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(texts, found): mark, id and copies of each text of LENGTH bytes or more; mark, bytes and repeated positions of those with any."""
    spark = docs.sparkSession
    (v1, cover1), (v2, cover2) = singer(COARSE), singer(FINE)
    cover1, cover2 = np.array(cover1), np.array(cover2)
    side = v2 - 1
    base = docs.select(F.xxhash64(text_col).alias("mark"), F.col(text_col).cast("binary").alias("raw"), F.col(id_col).alias("id"))
    texts = stored(base.where(F.octet_length("raw") >= LENGTH).groupBy("mark").agg(F.min("id").alias("id"), F.count("*").alias("copies")))

    def coarse():
        h = Hasher()

        def name(raw):
            at = sampled(v1, cover1, len(raw) - (LENGTH - v1 + 1) + 1)
            return h.windows(raw, at, 0, LENGTH - v1 + 1, 0), at

        return name

    first = _named(base.select("mark", "raw"), ("h",), coarse)
    spots = stored(_gathered(first.withColumn("again", _repeated(first, ("h",))).where("again"), "spots"))
    release(spark)
    one = spots.join(texts, "mark").select("mark", "id", "spots")
    same = (base["mark"] == one["mark"]) & base["id"].eqNullSafe(one["id"])
    pool = stored(base.join(one, same).select(base["mark"].alias("text"), "raw", "spots", F.monotonically_increasing_id().alias("mark")))
    del first, one, same
    release(spark)

    def fine():
        h = Hasher()

        def name(raw, spots):
            n = len(raw)
            lo, hi = candidates(spots, v1, n)
            lo, hi = united(lo, hi + side)
            at = sampled(v2, cover2, n - (LENGTH - side) + 1)
            at = at[inside(at, lo, hi)]
            room = np.minimum(at, side) * v2 + np.minimum(n - at - (LENGTH - side), side)  # equal strings that are cut differently differ
            wide = h.windows(raw, at, side, LENGTH, 1) ^ (room.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
            return h.windows(raw, at, 0, LENGTH - side, 0), wide, at

        return name

    second = _named(pool.select("mark", "raw", "spots"), ("narrow", "wide"), fine)
    w = Window.partitionBy("narrow", "wide").orderBy("mark", "at")
    one_each = F.when(F.row_number().over(w) == 1, F.col("narrow")).alias("narrow")  # once for each wide name
    again = _repeated(second, ("narrow", "wide")).alias("again")
    second = stored(second.select(one_each, "mark", "at", again))
    release(spark)
    sure = stored(_gathered(second.where("again"), "sure"))
    several = second.where("narrow is not null").groupBy("narrow").agg(F.count("*").alias("n")).where("n > 1")
    ends = stored(_gathered(second.join(several, "narrow", "left_semi"), "ends"))
    discard(second)
    release(spark)

    def whole():
        h = Hasher()

        def name(raw, spots, ends):
            n = len(raw)
            lo, hi = candidates(ends, v2, n)
            at = listed(lo, hi)
            at = at[inside(at, *candidates(spots, v1, n))]
            return h.windows(raw, at, 0, LENGTH, 0), h.windows(raw, at, 0, LENGTH, 1), at

        return name

    third = _named(pool.join(ends, "mark").select("mark", "raw", "spots", "ends"), ("h1", "h2"), whole)
    rest = stored(_gathered(third.withColumn("again", _repeated(third, ("h1", "h2"))).where("again"), "rest"))
    del third
    release(spark)
    found = pool.join(sure, "mark", "left").join(rest, "mark", "left").where("sure is not null or rest is not null")
    return texts, found.select(F.col("text").alias("mark"), "raw", "sure", "rest")


def removed(n: int, sure, rest) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of the bytes to remove."""
    side = FINE * FINE + FINE
    q, i = np.array(sure or (), np.int64), np.array(rest or (), np.int64)
    lo = np.concatenate([np.maximum(q - side, 0), i])
    last = np.concatenate([np.minimum(q, n - LENGTH), i])
    good = lo <= last
    lo, hi = lo[good], last[good] + LENGTH
    order = np.argsort(lo, kind="stable")
    return united(lo[order], hi[order])


def dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs without their text, with `n_bytes`, `n_removed`, `n_spans` and `kept_sha256` (of the bytes that stay)."""
    return aside(docs, [id_col, text_col], ("n_bytes", "n_removed", "n_spans", "kept_sha256"), lambda df: _dedup(df, text_col, id_col))


def _dedup(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    texts, found = repeats(docs, text_col, id_col)

    def make():
        def batch(raws, sure, rest):
            out = []
            for raw, q, i in zip(raws, sure, rest):
                lo, hi = removed(len(raw), q, i)
                cuts = zip([0, *hi.tolist()], [*lo.tolist(), len(raw)])
                out.append((int((hi - lo).sum()), len(lo), hashlib.sha256(b"".join([raw[a:b] for a, b in cuts])).hexdigest()))
            return tuple(zip(*out, strict=True)) or ((), (), ())

        return batch

    outputs = {"part_removed": "bigint", "part_spans": "bigint", "part_sha256": "string"}
    parts = add_columns(found, "raw", outputs, make, also=("sure", "rest"), kind="binary").drop("raw").dropDuplicates(["mark"])
    facts = texts.select("mark", "copies").join(parts, "mark", "left").withColumnRenamed("mark", "mark__")
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.withColumn("n_bytes", F.octet_length(text).cast("bigint")).withColumn("whole__", F.sha2(text, 256)).withColumn("mark", F.xxhash64(text_col)).drop(text_col)
    joined = rows.join(facts, rows["mark"] == facts["mark__"], "left")
    copied = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    return (
        joined.withColumn("n_removed", F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("part_removed", F.lit(0).cast("bigint"))))
        .withColumn("n_spans", F.when(copied, F.lit(1).cast("bigint")).otherwise(F.coalesce("part_spans", F.lit(0).cast("bigint"))))
        .withColumn("kept_sha256", F.when(copied, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("part_sha256", "whole__")))
        .drop("mark", "mark__", "copies", "whole__", *outputs)
    )
