"""Quality by tokeniser fertility (operator 6).

Two public vocabularies tokenise every word. A text's measures are: characters per token in
either vocabulary, the share of byte-fallback tokens (characters that the piece vocabulary
doesn't hold), and the Shannon entropy of its piece tokens, also as a share of the highest
that a text of as many tokens could have. A text outside a band of any of them is rejected.
Beside these stand the base measures: words, characters in words, symbols, duplicate lines and
words in repeated three-word windows.

The bands come from the corpus: of the texts of one script and language that pass the base
rule, `FENCE` times the distance of the quartiles beyond either quartile, and no nearer to
them than `LEAST_MARGIN`. A script and language of fewer than `LEAST_TEXTS` such texts (and
texts without a language) take the bands of all texts of the script. Within these hold fixed
outer bands, which are all that a script of fewer texts has.

Words are tokenised by themselves, as after a space, so a worker can remember the words it has
seen (two generations of bounded size; results don't depend on it).

Cases: null and empty texts have no word; they, and texts of under `LEAST_WORDS` words or
mostly repeated windows, fail the base rule and aren't kept; an empty table gives an empty
table; repeated rows each count for the bands and are judged alike; null ids need no rule.
"""

from __future__ import annotations

import base64
import math
import re
from array import array
from collections import Counter

import numpy as np
import regex
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, aside, stored

LEAST_WORDS = 50
REPEATED_PERCENT = 50
SYMBOLS = "#*$%&|<>"
MEMO = 250_000
MEMO_CHARS = 64
#: Scripts that have bands of their own; all else is "other". A text's script is that of most of its letters.
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Han", "Hangul", "Hiragana", "Katakana", "Thai")
#: Texts from which bands are taken, and their distance from the quartiles (in distances of the quartiles: Tukey's outer fences).
LEAST_TEXTS = 100
FENCE = 3.0
LEAST_MARGIN = {"chars_per_piece": 0.1, "chars_per_token": 0.1, "byte_share": 0.05, "entropy": 0.2, "entropy_share": 0.05}
#: measure -> (least, most) accepted in any corpus.
DEFAULT = {"chars_per_piece": (0.2, 12.0), "chars_per_token": (0.2, 12.0), "byte_share": (0.0, 0.9), "entropy": (2.0, 16.0), "entropy_share": (0.3, 1.0)}
BANDS = {
    "Latin": {"chars_per_piece": (1.3, 8.0), "chars_per_token": (1.2, 8.0), "byte_share": (0.0, 0.15), "entropy": (3.0, 16.0), "entropy_share": (0.5, 1.0)},
    "Cyrillic": DEFAULT | {"chars_per_piece": (0.8, 8.0), "byte_share": (0.0, 0.3)},
    "Greek": DEFAULT | {"byte_share": (0.0, 0.5)},
}
MEASURES = tuple(DEFAULT)
_LETTER = regex.compile(r"\p{L}+")
_SCRIPT = [(s, regex.compile(rf"\p{{Script={s}}}")) for s in SCRIPTS]
_LINE = re.compile("[^\x20\x09-\x0d]")


class Tokenisers:
    """The piece vocabulary (with byte fallback) and the byte-level one, word by word."""

    def __init__(self, pieces: bytes, ranks: bytes, pattern: str):
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        self.bytes = {i for i in range(self.pieces.get_piece_size()) if self.pieces.is_byte(i)}
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.level = tiktoken.Encoding("byte level", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.size = self.pieces.get_piece_size()
        self.memo, self.older = {}, {}

    def word(self, raw: bytes) -> tuple[int, int, bytes]:
        """(byte-fallback tokens, tokens of the byte-level vocabulary, piece ids) of a word."""
        made = self.memo.get(raw)
        if made is None:
            made = self.older.get(raw)
            if made is None:
                word = raw.decode()
                ids = self.pieces.encode(word, num_threads=1)
                made = (sum([i in self.bytes for i in ids]), len(self.level.encode_ordinary(" " + word)), array("i", ids).tobytes())
            if len(raw) <= MEMO_CHARS:
                if len(self.memo) >= MEMO:
                    self.older, self.memo = self.memo, {}
                self.memo[raw] = made
        return made


def script(text: str) -> str:
    """Script of more than half of the letters."""
    if text.isascii() or max(text) < "\u0250":  # up to there, nearly all letters are Latin
        return "Latin" if any(map(str.isalpha, text)) else "other"
    letters = "".join(_LETTER.findall(text))
    for name, one in _SCRIPT:
        if 2 * len(one.findall(letters)) > len(letters):
            return name
    return "other"


def base(text: str, words: list[bytes]) -> tuple[int, int, int, int]:
    """(characters in words, symbols, duplicate lines, words in repeated three-word windows)."""
    chars = len(b"".join(words).decode())
    lines = [x for x in text.split("\n") if _LINE.search(x)]
    triples = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(triples)) < len(triples):
        count, upto = Counter(triples), 0
        for i, t in enumerate(triples):
            if count[t] > 1:
                repeated += i + 3 - max(i, upto)
                upto = i + 3
    return chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


def measures(words: list[bytes], chars: int, tokens: Tokenisers) -> tuple[float, ...]:
    """Values of MEASURES for a text of at least one word."""
    made = [tokens.word(w) for w in words]
    ids = np.frombuffer(b"".join([m[2] for m in made]), np.int32)
    n, level = max(1, len(ids)), max(1, sum([m[1] for m in made]))
    count = np.bincount(ids, minlength=1)
    share = count[count > 0] / n
    entropy = max(0.0, float(-(share * np.log2(share)).sum()))
    most = math.log2(min(n, tokens.size))
    return chars / n, chars / level, sum([m[0] for m in made]) / n, entropy, entropy / most if most > 0 else 0.0


COLUMNS = {
    "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint",
    "base_failed": "boolean", "kept": "boolean", "script": "string", **dict.fromkeys(MEASURES, "double"),
}


def measured(docs: DataFrame, pieces_path: str, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """docs with COLUMNS, `kept` by the outer bands. The driver reads the two vocabulary files and broadcasts them (about a megabyte each)."""
    files = []
    for path in (pieces_path, ranks_path):
        with open(path, "rb") as f:
            files.append(f.read())
    sent = docs.sparkSession.sparkContext.broadcast(tuple(files))

    def make():
        tokens = shared_tokenisers(sent.value, pattern)

        def one(text):
            text = text or ""
            words = text.encode().split()
            chars, symbols, lines, repeated = base(text, words)
            n = len(words)
            failed = n < LEAST_WORDS or 100 * repeated > REPEATED_PERCENT * n
            kind = script(text)
            values = measures(words, chars, tokens) if words else (0.0,) * len(MEASURES)
            bands = BANDS.get(kind, DEFAULT)
            good = all(bands[m][0] <= v <= bands[m][1] for m, v in zip(MEASURES, values))
            return n, chars, symbols, lines, repeated, failed, good and not failed, kind, *values

        return lambda texts: tuple(zip(*map(one, texts), strict=True)) or ((),) * len(COLUMNS)

    return add_columns(docs, text_col, COLUMNS, make)


def corpus_bands(found: DataFrame, by: list) -> DataFrame:
    """(key0, .., bands) of each group of at least LEAST_TEXTS measured texts: a (least, most) for each of MEASURES."""

    def band(m):
        low, high = (F.percentile_approx(m, q, 100_000) for q in (0.25, 0.75))
        margin = F.greatest(FENCE * (high - low), F.lit(LEAST_MARGIN[m]))
        return F.struct((low - margin).alias("least"), (high + margin).alias("most")).alias(m)

    groups = found.where(~F.col("base_failed")).groupBy(*[c.alias(f"key{i}") for i, c in enumerate(by)])
    return groups.agg(F.count("*").alias("n"), *map(band, MEASURES)).where(F.col("n") >= LEAST_TEXTS).select(*[f"key{i}" for i in range(len(by))], F.struct(*MEASURES).alias("bands"))


def quality(docs: DataFrame, pieces_path: str, ranks_path: str, pattern: str, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without their text, with COLUMNS; without a column `lang_col` the bands are by script alone."""
    used = [text_col, lang_col] if lang_col in docs.columns else [text_col]
    return aside(docs, used, COLUMNS, lambda df: _quality(df, pieces_path, ranks_path, pattern, text_col, lang_col))


def _quality(docs: DataFrame, pieces_path: str, ranks_path: str, pattern: str, text_col: str, lang_col: str) -> DataFrame:
    found = stored(measured(docs, pieces_path, ranks_path, pattern, text_col).drop(text_col))
    lang = F.col(f"`{lang_col}`") if lang_col in found.columns else F.lit(None).cast("string")
    # a row for each script, and for each pair of script and language of at least LEAST_TEXTS texts
    own = corpus_bands(found.where(lang.isNotNull()), [F.col("script"), lang]).withColumnsRenamed({"key0": "script__", "key1": "lang__", "bands": "own__"})
    whole = corpus_bands(found, [F.col("script")]).withColumnsRenamed({"key0": "of__", "bands": "whole__"})
    # few keys hold most rows, so no shuffle by them
    placed = found.join(F.broadcast(own), (F.col("script") == F.col("script__")) & (lang == F.col("lang__")), "left")
    placed = placed.join(F.broadcast(whole), F.col("script") == F.col("of__"), "left")
    bands = F.coalesce("own__", "whole__")
    good = F.lit(True)
    for m in MEASURES:
        good = good & F.col(m).between(bands[m]["least"], bands[m]["most"])
    return placed.withColumn("kept", F.col("kept") & (bands.isNull() | good)).drop("script__", "lang__", "own__", "of__", "whole__")


_shared: dict = {}


def shared_tokenisers(files: tuple, pattern: str) -> Tokenisers:
    """One for each worker process and pair of vocabularies."""
    key = hash((files, pattern))
    if key not in _shared:
        _shared[key] = Tokenisers(*files, pattern)
    return _shared[key]
