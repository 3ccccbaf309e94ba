"""Substring dedup by sliding sentence spans (operator 1).

A text is cut into sentences: after a full stop, exclamation or question mark with white space
behind it, and at line ends. Runs of consecutive sentences are hashed (128 bits over their
words, A-Z lower-cased): every run of three, every run of two with `PAIR_WORDS` words, and every
sentence of `LONE_WORDS` words. Passages that begin or end inside a sentence are found by
strings of `PASSAGE` words, whatever the sentences: of each `SPREAD` neighbouring ones that with
the least hash is taken (winnowing), so any text of PASSAGE + SPREAD - 1 words has the same in
all its copies, and those taken in a longer one overlap. Sentences are cut where such a string
begins or ends; the pieces are what is counted and removed. Up to SPREAD - 1 words at either
edge of a copied passage, where its sentence goes on differently, may stay.

Of the places where a run or string stands, the first by doc_id (null last), text hash and
position is kept; each piece inside any other is removed.

Within a slice of a partition only the first place of a run is shuffled by its hash. The others
are known not to be the first and go with a hash of their own, so a run that a third of all
documents share sends one row for each slice, not for each document.

Texts are cut once: with the places goes one row for each text that has the sizes of its pieces,
a byte each in most cases, so that removal only adds them up.

Cases: null and empty texts have no sentence and stay as they are; texts of under
PASSAGE + SPREAD - 1 words have no strings of their own and their sentences stay whole; rows with equal id and equal
text are one document, in whose rows the same sentences go; a run that overlaps itself in one
text counts as repeated; an empty table gives an empty table.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import add_columns, aside, map_arrow

RUN = 3
PAIR_WORDS = 30
LONE_WORDS = 50
PASSAGE = 24
SPREAD = 20
SLICE = 2048
_END = re.compile(r"(?<=[.!?])[\x20\x09-\x0d]+|\n+")
_WORD = re.compile(r"[^\x20\x09-\x0d]+")


def _sentences(text: str) -> list[int]:
    """Ends (exclusive, with the white space behind) of the sentences, in code points."""
    ends = [m.end() for m in _END.finditer(text)]
    return ends if not text or ends and ends[-1] == len(text) else [*ends, len(text)]


def _sliding(values: np.ndarray, size: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each `size` neighbouring values."""
    step = 1
    while 2 * step <= size:
        values, step = pick(values[:-step], values[step:]), 2 * step
    return pick(values[: len(values) - size + step], values[size - step :])


def chosen(words: list[bytes]) -> list[int]:
    """First words of the strings of PASSAGE words with the least hash of any SPREAD neighbouring ones."""
    if len(words) < PASSAGE + SPREAD - 1:
        return []
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    made, size, long = None, 0, one  # hashes of strings of `size` words, and of `step` words
    step = 1
    while step <= PASSAGE:
        if PASSAGE & step:
            n = len(words) - size - step + 1
            made = long if made is None else made[:n] * _factor(step) + long[size : size + n]
            size += step
        long, step = long[:-step] * _factor(step) + long[step:], 2 * step
    made = (made ^ (made >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    made ^= made >> np.uint64(29)
    least = np.pad(_sliding(made, SPREAD, np.minimum), SPREAD - 1)
    return np.flatnonzero(_sliding(least, SPREAD, np.maximum) == made).tolist()


def _factor(size: int) -> np.uint64:
    return np.uint64(pow(0xC2B2AE3D27D4EB4F, size, 1 << 64))


def _cut(text: str) -> tuple[list[int], list[int], list[tuple[int, int, bytes]]]:
    """(ends of the sentences, ends of the pieces, strings as start, end and digest)."""
    ends, words = _sentences(text), text.encode().lower().split()
    first = chosen(words)
    if not first:
        return ends, ends, []
    at = [m.start() for m in _WORD.finditer(text)]
    at[0] = 0  # no piece of white space alone at a text's ends
    at.append(len(text))
    strings = [(at[i], at[i + PASSAGE], xxhash.xxh3_128_digest(b" ".join(words[i : i + PASSAGE]))) for i in first]
    return ends, sorted({*ends, *[x for s in strings for x in s[:2]]} - {0}), strings


def sentences(text: str) -> list[int]:
    """Ends (exclusive, with the white space behind) of the pieces into which sentences are cut, in code points."""
    return _cut(text)[1]


def runs(text: str) -> list[tuple[int, int, bytes]]:
    """(first piece, pieces, digest) of all runs and strings that are hashed."""
    return _pieces_and_runs(text)[1]


def _pieces_and_runs(text: str) -> tuple[list[int], list[tuple[int, int, bytes]]]:
    """(ends of the pieces, runs)."""
    ends, pieces, strings = _cut(text)
    index = dict(zip([0, *pieces], range(len(pieces) + 1)))
    made, at, words, starts = [(index[a], index[b] - index[a], d) for a, b, d in strings], 0, [], []
    for end in ends:
        words.append(text[at:end].encode().lower().split())
        starts.append(index[at])
        at = end
    starts.append(len(pieces))
    full = [i for i, w in enumerate(words) if w]  # sentences without a word belong to no run of their own
    joined = {i: b" ".join(words[i]) for i in full}
    digest = xxhash.xxh3_128_digest
    for k, i in enumerate(full):
        if len(words[i]) >= LONE_WORDS:
            made.append((starts[i], starts[i + 1] - starts[i], digest(joined[i])))
        pair = full[k : k + 2]
        if len(pair) == 2 and len(words[i]) + len(words[pair[1]]) >= PAIR_WORDS:
            made.append((starts[i], starts[pair[1] + 1] - starts[i], digest(joined[i] + b"\n" + joined[pair[1]])))
        three = full[k : k + RUN]
        if len(three) == RUN:
            made.append((starts[i], starts[three[-1] + 1] - starts[i], digest(b"\n".join([joined[j] for j in three]))))
    return pieces, made


def _sizes(ends: list[int]) -> bytes:
    """The sizes of the pieces, each as a byte below 255 behind as many of 255 as it needs."""
    sizes = np.diff(ends, prepend=0)
    more = sizes // 255
    out = np.full(len(sizes) + more.sum(), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = sizes % 255
    return out.tobytes()


def _ends(sizes: bytes | None) -> list[int]:
    made = np.frombuffer(sizes or b"", np.uint8)
    return np.cumsum(made, dtype=np.int64)[made < 255].tolist()


def _places(docs: DataFrame) -> DataFrame:
    """(h1, h2, doc_id, mark, at, n, known, sizes): the places of all runs; known: certainly not the first.

    One more row of each text has the `_sizes` of its pieces (else null), a hash of its own, and is known.
    """

    def run(batches):
        for b in batches:
            for start in range(0, b.num_rows, SLICE):
                part = b.slice(start, SLICE)
                ids, marks, texts = (part.column(i).to_pylist() for i in range(3))
                order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, marks[i]))
                first: dict[bytes, tuple] = {}
                rows, digests, known, sizes = [], [], [], {}
                for i in order:
                    if not texts[i]:
                        continue
                    ends, found = _pieces_and_runs(texts[i])
                    sizes[ids[i], marks[i]] = _sizes(ends)
                    for at, n, d in found:
                        place = (marks[i], ids[i], at)
                        later = first.setdefault(d, place) != place
                        rows.append((ids[i], marks[i], at, n))
                        digests.append(xxhash.xxh3_128_digest(d + repr(place).encode()) if later else d)
                        known.append(later)
                none = [None] * len(rows)
                for doc in sizes:
                    rows.append((*doc, 0, 0))
                    digests.append(xxhash.xxh3_128_digest(repr(doc).encode()))
                    known.append(True)
                h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                cols = list(zip(*rows)) or [(), (), (), ()]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[:, 0]), pa.array(h[:, 1]), *[pa.array(c, k) for c, k in zip(cols, kinds)], pa.array(known, pa.bool_()), pa.array([*none, *sizes.values()], pa.binary())],
                    names=["h1", "h2", "doc_id", "mark", "at", "n", "known", "sizes"],
                )

    return map_arrow(docs.select(F.col("doc_id").cast("bigint"), "mark", "text"), run, "h1 bigint, h2 bigint, doc_id bigint, mark bigint, at int, n int, known boolean, sizes binary")


OUTPUTS = {"kept_text": "string", "n_sentences": "bigint", "n_removed": "bigint", "removed": "array<int>"}


def dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with `kept_text`, `n_sentences`, `n_removed` and `removed` (indices of the removed pieces, all counted in pieces of sentences)."""
    return aside(docs, [id_col, text_col], OUTPUTS, lambda df: _dedup(df, text_col, id_col))


def _without(text: str | None, spans, sizes) -> tuple:
    """The outputs of a text: `spans` (first piece << 32 | pieces) go; `sizes` are the `_sizes` of its pieces."""
    if not text:
        return text, 0, 0, []
    ends, gone = _ends(sizes), set()
    if ends[-1:] != [len(text)]:  # another text of the same id and mark
        ends = sentences(text)
    for s in spans or ():
        gone.update(range(s >> 32, (s >> 32) + (s & 0xFFFFFFFF)))
    if not gone:
        return text, len(ends), 0, []
    kept = "".join([text[a:b] for i, (a, b) in enumerate(zip([0, *ends], ends)) if i not in gone])
    return kept, len(ends), len(gone), sorted(gone)


def _dedup(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    base = docs.withColumn("mark", F.xxhash64(F.col(text_col)))
    places = _places(base.select(F.col(id_col).alias("doc_id"), "mark", F.col(text_col).alias("text")))
    order = Window.partitionBy("h1", "h2").orderBy(F.col("doc_id").asc_nulls_last(), "mark", "at")
    later = places.withColumn("k", F.dense_rank().over(order)).where(F.col("known") | (F.col("k") > 1))
    span = F.when(F.col("sizes").isNull(), F.struct("at", "n"))
    covered = later.groupBy("doc_id", "mark").agg(F.collect_set(span).alias("spans"), F.first("sizes", ignorenulls=True).alias("sizes__"))
    packed = covered.select(F.col("doc_id").alias("id__"), F.col("mark").alias("mark__"), F.transform("spans", lambda s: F.shiftleft(s["at"].cast("bigint"), 32) + s["n"]).alias("spans__"), "sizes__")
    joined = base.join(packed, base[id_col].cast("bigint").eqNullSafe(F.col("id__")) & (base["mark"] == F.col("mark__")), "left")

    def make():
        return lambda texts, spans, sizes: tuple(zip(*map(_without, texts, spans, sizes), strict=True)) or ((), (), (), ())

    return add_columns(joined.drop("id__", "mark__", "mark"), text_col, OUTPUTS, make, also=("spans__", "sizes__"))


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_sentences", "n_removed", "removed", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
