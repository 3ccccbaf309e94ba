"""Language identification by compression (operator 3).

For each language, a raw-content zstandard dictionary is filled with labelled text. A text,
lower-cased and with runs of other ASCII characters than letters as one space, is cut into
chunks, and each chunk is compressed with each dictionary: the language with the smallest sum
wins, ties by name. Chunks keep a long text from being its own dictionary. If the margin over
the second language, as a share of its size, is under `NARROW`, the prediction is rejected.

Training sees the text and language of rows outside the held-out fold only, a documented
bounded sample: `ROWS` pieces of at most `PIECE` characters, in order of a hash, up to
`DICTIONARY` bytes for each language. Rows are thinned by a threshold on their hash before
they are ranked, so that what is ranked doesn't grow with the table.

Cases: null text or text without a letter is `und`, score 0, rejected; so is all text if
nothing was learned; with a single language learned, its score is 1. Null languages and null
ids are never learned from; a null id isn't held out. Equal pieces are learned once.
"""

from __future__ import annotations

import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import add_columns, without

LEVEL = 5
DICTIONARY = 1 << 17
CHUNK = 4096
ROWS = 256
PIECE = 2048
NARROW = 0.01
FOLDS = 5
UNKNOWN = "und"
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def normal(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(_LETTERS).split())


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Language -> dictionary content, from the rows that aren't held out."""
    rows = docs.select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"), held_out(id_col).alias("out")
    ).where("not out and id is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    part = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 4 * ROWS / n))])
    chance = (F.xxhash64("id", "text") / F.lit(2.0**64)) + 0.5
    at = F.pmod(F.xxhash64("text"), F.greatest(F.lit(1), F.length("text") - PIECE + 1)).cast("int") + 1
    pieces = rows.where(F.col("text").isNotNull() & (chance < part[F.col("lang")])).select("lang", F.expr("text").substr(at, F.lit(PIECE)).alias("piece"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("piece"), "piece")
    ranked = pieces.distinct().withColumn("k", F.row_number().over(order)).where(F.col("k") <= ROWS)
    taken: dict[str, list[bytes]] = {}
    for r in sorted(ranked.collect(), key=lambda r: (r["lang"], r["k"])):
        taken.setdefault(r["lang"], []).append(normal(r["piece"]))
    made = {lang: b" ".join(filter(None, x))[:DICTIONARY] for lang, x in sorted(taken.items())}
    return {lang: content for lang, content in made.items() if len(content) >= 8}


class Sizer:
    """Compressed size of a text with each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.by = {}
        for lang, content in sorted(dictionaries.items()):
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            self.by[lang] = zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, whether it is rejected)."""
        if not text or not self.by or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        raw = normal(text)
        chunks = [raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK)]
        sizes = sorted((sum([len(c.compress(x)) for x in chunks]), lang) for lang, c in self.by.items())
        if len(sizes) == 1:
            return sizes[0][1], 1.0, False
        margin = 1 - sizes[0][0] / sizes[1][0]
        return sizes[0][1], margin, margin < NARROW


def predict(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """docs with `lang_pred`, `score` (margin between the two smallest sizes) and `rejected`."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # DICTIONARY bytes a language at most

    def make():
        sizer = Sizer(shared.value)
        return lambda texts: tuple(zip(*map(sizer.predict, texts), strict=True)) or ((), (), ())

    return add_columns(docs, text_col, {"lang_pred": "string", "score": "double", "rejected": "boolean"}, make)


def identify(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with their predicted language, learned from `labelled` (docs itself if none is given)."""
    return predict(without(docs, ["held_out"]).withColumn("held_out", held_out(id_col)), learn(docs if labelled is None else labelled, id_col, text_col, lang_col), text_col)
