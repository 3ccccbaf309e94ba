"""Benchmark decontamination by a prefix-filtered set join (operator 5).

A window is ten consecutive words of a benchmark item (all its words if it has fewer). To
contain a window a text must contain all its words, so one word of it suffices as the prefix
to join on: the rarest, by its count over all documents (ties by the word). Where a text has
such a word, the position of the word in the window gives the only place where the window can
start (positional bound), the window must end inside the text (length bound), and the words
there are compared with the window's.

Benchmark items are the stated query set. Equal rows are taken once. The items go in blocks by a
hash of the item; the bytes of every block are counted before any is collected, and a block
that is too large is dealt again, so that none but a single item holds more than stated. Each
block runs against all documents; one block is usually all. Documents are never shuffled.

Cases: null texts and texts without words have no window and no hit; items with equal id
count once; a null item id counts as an empty string; repeated rows each get their own
result; an empty benchmark or an empty table gives no hit or no row.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, cut_lineage, map_arrow

WINDOW = 10
#: Bytes of benchmark text that are broadcast at once.
BLOCK_BYTES = 8 << 20
_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    """Words of a text, with A-Z lower-cased: runs of digits, ASCII letters and other than ASCII characters."""
    return (text or "").encode().translate(_WORDS).split()


def windows(item: list[bytes], size: int = WINDOW) -> set[tuple]:
    return {tuple(item[i : i + size]) for i in range(max(1, len(item) - size + 1))} if item else set()


def rarity(docs: DataFrame, vocabulary: set[bytes], text_col: str) -> dict[bytes, int]:
    """Count over all documents of each word of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known, count = shared.value, Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                count.update([w for w in words(text) if w in known])
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])

    found = map_arrow(docs.select(F.col(text_col).cast("string")), run, "word binary, n bigint")
    return {bytes(r["word"]): r["n"] for r in found.groupBy("word").agg(F.sum("n").alias("n")).collect()}


class Index:
    """Windows of a block of items by their rarest word."""

    def __init__(self, items: list[tuple[str, str | None]], count: dict[bytes, int], size: int):
        self.ids: dict[tuple, set] = {}
        for name, text in items:
            for w in windows(words(text), size):
                self.ids.setdefault(w, set()).add(name)
        self.prefix: dict[bytes, set] = {}
        for w in self.ids:
            at = min(range(len(w)), key=lambda i: (count.get(w[i], 0), w[i]))
            self.prefix.setdefault(w[at], set()).add((at, len(w)))

    def match(self, text: list[bytes], hit: bytearray) -> set:
        """Marks the words of a text in windows; the ids of the items they come from."""
        found, n = set(), len(text)
        for i, word in enumerate(text):
            if word in self.prefix:
                for at, size in self.prefix[word]:
                    start = i - at
                    if start >= 0 and start + size <= n:
                        ids = self.ids.get(tuple(text[start : start + size]))
                        if ids:
                            found |= ids
                            hit[start : start + size] = b"\1" * size
        return found


def _spans(hit: bytearray) -> list[int]:
    """Start and end (exclusive) of each run of marked words, packed as start * 2^32 + end."""
    out, at = [], hit.find(1)
    while at >= 0:
        end = hit.find(0, at)
        end = len(hit) if end < 0 else end
        out.append(at << 32 | end)
        at = hit.find(1, end)
    return out


def _mark(docs: DataFrame, items: list, text_col: str, size: int, first: bool) -> DataFrame:
    """docs with the hits of one block of items added to those of the blocks before."""
    vocabulary = {w for _, text in items for w in words(text)}
    index = docs.sparkSession.sparkContext.broadcast(Index(items, rarity(docs, vocabulary, text_col), size))

    def make():
        def batch(texts):
            rows = []
            for text in texts:
                tokens = words(text)
                hit = bytearray(len(tokens))
                found = index.value.match(tokens, hit)
                rows.append((len(tokens), _spans(hit), sorted(found)))
            return [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]

        return batch

    names = ("n_words", "hit_spans", "items") if first else ("n_words", "more_spans", "more_items")
    return add_columns(docs, text_col, dict(zip(names, ("bigint", "array<bigint>", "array<string>"))), make)


def _blocks(items: DataFrame, block_bytes: int, where=None, depth: int = 0) -> list:
    """Conditions that deal distinct items into blocks of at most block_bytes, by hashes of their own for each depth."""
    where = F.lit(True) if where is None else where
    size = F.sum(F.coalesce(F.octet_length("id") + F.octet_length("text"), F.lit(0)))
    n, total = items.where(where).agg(F.count("*"), size).first()
    total = total or 0
    if total <= block_bytes or n <= 1:
        return [where]
    blocks = -(-total * 5 // (block_bytes * 4))  # room for blocks of unequal size
    at = F.pmod(F.xxhash64("id", "text", F.lit(depth)), F.lit(blocks))
    out = []
    for r in items.where(where).groupBy(at.alias("k")).agg(F.count("*").alias("n"), size.alias("size")).orderBy("k").collect():
        part = where & (at == r["k"])
        out += [part] if r["size"] <= block_bytes or r["n"] <= 1 else _blocks(items, block_bytes, part, depth + 1)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with `n_words`, `n_hit` (words in any window), `items` (sorted ids of the items found), `hit_spans`, `contaminated`.

    hit_spans: structs of start and end (exclusive) of the runs of words hit, by start; runs from different blocks may overlap.
    """
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.col(item_text).cast("string").alias("text")).distinct()
    parts = _blocks(items, block_bytes)
    blocks = len(parts)
    if blocks > 1:
        items = cut_lineage(items)
    out = docs
    for k, where in enumerate(parts):
        part = items.where(where).collect()
        out = _mark(out, [(r["id"], r["text"]) for r in part], text_col, size, k == 0)
        if k:
            out = out.withColumn("hit_spans", F.concat("hit_spans", "more_spans")).withColumn("items", F.array_union("items", "more_items")).drop("more_spans", "more_items")
        if blocks > 1:
            out = cut_lineage(out)
    spans = F.transform(F.sort_array("hit_spans"), lambda x: F.struct(F.shiftright(x, 32).alias("start"), x.bitwiseAND(F.lit(0xFFFFFFFF)).alias("end")))
    out = out.withColumn("hit_spans", spans)
    zero = F.lit(0).cast("bigint")
    counted = F.aggregate(
        "hit_spans", F.struct(zero.alias("n"), zero.alias("to")),
        lambda s, x: F.struct((s["n"] + F.greatest(zero, x["end"] - F.greatest(s["to"], x["start"]))).alias("n"), F.greatest(s["to"], x["end"]).alias("to")),
        lambda s: s["n"],
    )
    return out.withColumn("n_hit", counted).withColumn("items", F.sort_array("items")).withColumn("contaminated", F.col("n_hit") > 0)


def digests(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )
