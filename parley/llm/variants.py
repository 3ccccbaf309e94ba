"""Operator 13: spelling variants by PartEnum signatures of letter multisets.

A word's letters with their occurrences (the second `e` is an element of its own) are a binary
vector. One inserted, deleted or replaced code point changes one or two of its elements. The
elements are partitioned into PARTS parts, and what differs lies in one part or in two:

* in one part: the other parts are equal. One signature for each part, of all others.
* in two parts, by a replacement: both words are equally long, and the part that loses a letter
  has one more in one word. One signature for each pair of parts, of all others, the length and
  the number of letters in the first of the two; that number is one more on the other side.

So every pair of near words meets at exactly one signature. Signatures are enumerated for each
word, joined on equality, and the pairs verified with the edit distance.

Scale: occurrences are counted in each task before they are shuffled by word; all that follows
works on distinct words. A signature is a 64-bit hash, as equal hashes are verified anyway.
Joins are shuffled, by a hint: Spark would take signatures for little more than the vocabulary's
file, though each word has PARTS^2 of them, and broadcast them through the driver. Adaptive
execution splits a signature that many words share. Forms are followed to the last by doubling, in as many rounds as the logarithm of the longest chain, and
a chain is no longer than the logarithm to base RATIO of the largest count.

Rows: a null text has no words; a null id counts as empty text before the colon. Repeated rows
count each time. A table without rows, or without words that stand often enough, gives none.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, map_arrow, stored

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Parts of the elements.
PARTS = 6
#: One run in so many loses a code point.
DAMAGE = 199
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form stands so many times as often as the word.
RATIO = 5
#: Distinct words in a task's memory before their counts are handed on.
FLUSH = 400_000


def runs(doc_id, text: str | None) -> Counter:
    """Words of a text, after the damage, with their numbers."""
    out = Counter()
    start = zlib.crc32(b":" if doc_id is None else f"{doc_id}:".encode())
    for run, n in Counter(RUN.findall((text or "").translate(LOWER))).items():
        h = zlib.crc32(run.encode(), start)
        if h % DAMAGE == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= LEAST_LENGTH:
            out[run] += n
    return out


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""

    def run(batches):
        counts = Counter()

        def out():
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()

        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    counts.update(runs(doc_id, text))
                if len(counts) > FLUSH:
                    yield from out()
        yield from out()

    rows = docs.select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").cast("string"))
    counts = map_arrow(rows, run, "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def signatures(word: str) -> list[tuple[int, int]]:
    """(signature, side): words are near only if they meet at a signature on the sides 0 and 1, or both on side 2."""
    parts: list[list[str]] = [[] for _ in range(PARTS)]
    seen = Counter()
    for c in word:
        seen[c] += 1
        parts[(ord(c) + 2 * seen[c]) % PARTS].append(c)
    texts = ["".join(sorted(p)) for p in parts]
    out = []

    def key(kind, left_out, *more):
        rest = "\0".join(t for i, t in enumerate(texts) if i not in left_out)
        h = xxhash.xxh64_intdigest(f"{kind}|{left_out}|{more}|{rest}")
        return h - (1 << 64) if h >> 63 else h

    for p in range(PARTS):
        out.append((key("one", (p,)), 2))
        for q in range(p + 1, PARTS):
            out.append((key("two", (p, q), len(word), len(parts[p])), 0))
            out.append((key("two", (p, q), len(word), len(parts[p]) + 1), 1))
    return out


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(a, an, b, bn): pairs of words that differ by one code point, each once, with their numbers."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 8 * SLICE):
                batch = whole.slice(at, 8 * SLICE)
                made = [signatures(w) for w in batch.column(0).to_pylist()]
                index = pa.array([i for i, s in enumerate(made) for _ in s], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for s in made for k, _ in s], pa.int64()), pa.array([x for s in made for _, x in s], pa.int32()), batch.column(0).take(index), batch.column(1).take(index)],
                    names=["key", "side", "word", "n"],
                )

    signed = map_arrow(vocabulary.select("word", "n"), run, "key bigint, side int, word string, n bigint")
    left = signed.where("side != 1").select("key", F.col("side").alias("s"), F.col("word").alias("a"), F.col("n").alias("an"))
    right = signed.where("side != 0").select("key", F.col("side").alias("t"), F.col("word").alias("b"), F.col("n").alias("bn"))
    meet = ((F.col("s") == 0) & (F.col("t") == 1)) | ((F.col("s") == 2) & (F.col("t") == 2) & (F.col("a") < F.col("b")))
    shape = F.abs(F.length("a") - F.length("b")) <= 1
    pairs = left.join(right.hint("merge"), "key").where(meet & shape & (F.levenshtein("a", "b", 1) == 1))
    return pairs.select("a", "an", "b", "bn").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the rows (word, form): the last of the forms that follow each other."""
    now = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        step = now.select(F.col("word").alias("w"), F.col("root").alias("further"))
        joined = now.join(step.hint("merge"), F.col("root") == F.col("w"), "left")
        moved = stored(joined.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        now = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each word: word, form, root, n, n_near, form_n."""
    vocabulary = stored(words(docs, id_col, text_col))
    pairs = stored(near_pairs(vocabulary))
    both = pairs.union(pairs.select("b", "bn", "a", "an"))
    best = F.min(F.struct((-F.col("bn")).alias("m"), F.col("b").alias("w"))).alias("best")
    near = both.groupBy("a").agg(F.count("*").alias("count"), best)
    made = vocabulary.join(near.hint("merge"), F.col("word") == F.col("a"), "left")
    taken = -F.col("best.m") >= RATIO * F.col("n")
    made = stored(made.select(
        "word", F.when(taken, F.col("best.w")).alias("form"), "n", F.coalesce("count", F.lit(0)).cast("bigint").alias("n_near"), F.when(taken, -F.col("best.m")).alias("form_n")
    ))
    last = roots(made.where("form is not null")).select(F.col("word").alias("w"), "root")
    out = made.join(last.hint("merge"), F.col("word") == F.col("w"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
