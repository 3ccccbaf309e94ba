"""Byte-pair encoding and decoding by dynamic programming over prefixes (operator 9).

The last token of the encoding of a prefix is unique. For every prefix of a pre-token the
tokens that end there come from an Aho-Corasick automaton over the vocabulary; the one that
is kept must itself be what its own bytes encode to, and must be compatible with the last
token of the prefix before it: undoing the merges of both, latest first, no merge across the
border may come earlier than the merge just undone. Back-pointers from the end give the ids.
Long pre-tokens cost time and memory in proportion to their length.

Cases: null text counts as empty (no ids, empty text); the strings of added tokens in a text
become their ids, as in the tokenizers library; an empty table gives an empty table; every
row is encoded by itself, so repeated rows and ties need no rule.
"""

from __future__ import annotations

import hashlib
import json
from array import array

import ahocorasick
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns

#: Pre-tokenizer pattern of byte-level BPE vocabularies. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens in each of a worker's two generations of remembered results (a bound on memory only, results are the same).
MEMO = 400_000
MEMO_CHARS = 64


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for the 256 bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one byte-level BPE vocabulary file."""

    def __init__(self, content: str):
        spec = json.loads(content)
        back = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.bytes = {i: bytes(back[c] for c in s) for s, i in vocab.items()}
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.bytes |= {i: s.encode() for s, i in self.added.items()}
        self.rank, self.left, self.right, self.pair = {}, {}, {}, {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            self.pair.setdefault((i, j), (r, k))
            if k not in self.rank:
                self.rank[k], self.left[k], self.right[k] = r, i, j
        self.single = {b[0]: i for i, b in self.bytes.items() if len(b) == 1 and i not in self.rank}
        self.fits: dict[int, bool] = {}
        self.auto = ahocorasick.Automaton()
        for i in vocab.values():
            if self.merged(i):
                text = self.bytes[i].decode("latin-1")
                self.auto.add_word(text, (i, len(text)))
        self.auto.make_automaton()
        self.find = regex.compile(PATTERN).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.at = [self.bytes.get(i, b"") for i in range(max(self.bytes) + 1)]

    def merged(self, token: int) -> bool:
        """Whether the token's own bytes encode to just this token; no encoding holds any other."""
        parts = [self.single[b] for b in self.bytes[token]]
        while len(parts) > 1:
            options = [(self.pair[p][0], i) for i, p in enumerate(zip(parts, parts[1:])) if p in self.pair]
            if not options:
                return False
            _, i = min(options)
            parts[i : i + 2] = [self.pair[parts[i], parts[i + 1]][1]]
        return parts == [token]

    def compatible(self, a: int, b: int) -> bool:
        """Whether tokens a, b next to each other stay apart."""
        key, limit, rank = a << 24 | b, 1 << 32, self.rank
        while True:
            across = self.pair.get((a, b))
            if across is not None and across[0] < limit:
                ok = False
                break
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                ok = True
                break
            if ra > rb:
                limit, a = ra, self.right[a]
            else:  # of two equal merges the left one comes first, so the border goes before b's own
                limit, b = rb + 1, self.left[b]
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        self.fits[key] = ok
        return ok

    def word(self, text: str) -> bytes:
        """Ids of one pre-token as little-endian unsigned 32-bit integers."""
        raw = text.encode()
        n = len(raw)
        last, size, fits = [-1] * (n + 1), [0] * (n + 1), self.fits.get
        for end, (token, length) in self.auto.iter(raw.decode("latin-1")):
            end += 1
            if last[end] < 0:
                if end > length:
                    before = last[end - length]
                    ok = fits(before << 24 | token)
                    if not (self.compatible(before, token) if ok is None else ok):
                        continue
                last[end], size[end] = token, length
        out = []
        while n:
            out.append(last[n])
            n -= size[n]
        out.reverse()
        return array("I", out).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        memo, made = self.memo, []
        for piece in self.split(text) if self.split else [text]:
            if piece in self.added:
                made.append(array("I", [self.added[piece]]).tobytes())
                continue
            for w in self.find(piece):
                ids = memo.get(w)
                if ids is None:
                    ids = self.older.get(w) or self.word(w)
                    if len(w) <= MEMO_CHARS:
                        if len(memo) >= MEMO:
                            self.older, self.memo = memo, {}
                            memo = self.memo
                        memo[w] = ids
                made.append(ids)
        return b"".join(made)

    def decode(self, ids: bytes) -> str:
        """Text of little-endian ids; bytes that are no UTF-8 become U+FFFD."""
        at = self.at
        return b"".join([at[i] for i in array("I", ids)]).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def shared_codec(df: DataFrame, path: str):
    """A function that gives the codec inside a task. The driver reads the vocabulary file and broadcasts it (a file of
    one or two MB); a worker process keeps its codec from task to task."""
    with open(path, encoding="utf-8") as f:
        content = f.read()
    name, sent = hashlib.sha256(content.encode()).hexdigest(), df.sparkSession.sparkContext.broadcast(content)

    def codec() -> Codec:
        if name not in _codecs:
            _codecs[name] = Codec(sent.value)
        return _codecs[name]

    return codec


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "token_ids", decoded_col: str | None = None) -> DataFrame:
    """df with `ids_col` (binary: the ids as little-endian unsigned 32-bit integers) and, if named, the text decoded from them."""
    codec = shared_codec(df, path)
    outputs = {ids_col: "binary"} | ({decoded_col: "string"} if decoded_col else {})

    def make():
        c = codec()

        def batch(texts):
            ids = [c.encode(t) for t in texts]
            return (ids, [c.decode(i) for i in ids]) if decoded_col else (ids,)

        return batch

    return add_columns(df, text_col, outputs, make)


def decode(df: DataFrame, path: str, ids_col: str = "token_ids", decoded_col: str = "decoded") -> DataFrame:
    """df with the text of its token ids; null ids give an empty text."""
    codec = shared_codec(df, path)
    hexed = df.withColumn("ids__hex", F.hex(F.col(f"`{ids_col}`")))

    def make():
        c = codec()
        return lambda ids: ([c.decode(bytes.fromhex(i or "")) for i in ids],)

    return add_columns(hexed, "ids__hex", {decoded_col: "string"}, make).drop("ids__hex")


def digests(df: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoded and decoded documents."""
    return df.select(
        "doc_id", (F.octet_length("token_ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
