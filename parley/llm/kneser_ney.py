"""Quality classifier: interpolated modified Kneser-Ney character n-grams (operator 10).

The model is trained on the words of trusted text. Words are counted, then the n-grams in
them (a word between a start and an end mark, `ORDER` characters at most); the highest order
and n-grams from a word's start take raw counts, all others the number of different
characters before them. Each order has three discounts from its counts of counts. Counts join
the totals of their contexts, which gives for each n-gram its discounted probability and for
each context the weight of the order below.

A document's perplexity is that of its words' characters. The model is cut into shards by
the last two characters of the context, of `SHARD_ROWS` rows on average (a hash of frequent
contexts may put more into one); orders without two characters of context are in all. The
driver reads one shard after the other and broadcasts it. A document's log probability is the
sum over shards; the sums so far are stored after each shard, so each pass over the documents
holds one shard; a small model has one.

A language's threshold is the `QUANTILE` of its trusted documents' perplexities, times
`SLACK`; languages without trusted documents (and null) take that of all trusted documents.

Cases: texts without words (null, empty) have no perplexity and aren't kept; without trusted
text nothing is scored and every text with words is kept; ids that are labelled twice are
trusted if one label says so; repeated rows are scored alike; null ids are never trusted;
characters that the model hasn't seen share the probability left for one more character.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, aside, discard, map_arrow, release, stored, without

ORDER = 5
START, END = "\x02", "\x03"
SHARD_ROWS = 500_000
#: Languages whose thresholds are broadcast at most.
LANGUAGES = 10_000
QUANTILE = 0.995
SLACK = 1.1
MEMO = 400_000
MEMO_CHARS = 64
#: n-grams whose log probability a task remembers.
GRAMS = 1_000_000


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): counted in each task before the shuffle."""

    def run(batches):
        for b in batches:
            count = Counter()
            for t in b.column(0).to_pylist():
                if t:
                    count.update(t.split())
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])

    found = map_arrow(docs.select(F.col(text_col).cast("string")), run, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def raw_grams(words: DataFrame) -> DataFrame:
    """(gram, n): n-grams of the highest order, and all from a word's start."""

    def run(batches):
        for b in batches:
            count = Counter()
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = START + w + END
                for k in range(2, min(ORDER, len(s) + 1)):
                    count[s[:k]] += n
                for i in range(len(s) - ORDER + 1):
                    count[s[i : i + ORDER]] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["gram", "n"])

    return map_arrow(words, run, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def _level(level: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(gram, weight) and (context, weight) of one order, from its counts (gram, n)."""
    of = level.agg(*[F.count(F.when(F.col("n") == i, 1)).alias(f"n{i}") for i in range(1, 5)]).first()
    n1, n2, n3, n4 = (of[f"n{i}"] for i in range(1, 5))
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    cut = [min(i - 1e-6, max(0.05, i - (i + 1) * y * b / a)) if a and b else 0.5 * i for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    discount = F.when(F.col("n") == 1, cut[0]).when(F.col("n") == 2, cut[1]).otherwise(cut[2])
    grams = level.select("gram", F.expr(f"left(gram, {k - 1})").alias("h"), "n", discount.alias("d"))
    contexts = grams.groupBy("h").agg(F.sum("n").alias("total"), F.sum("d").alias("left"))
    weights = grams.join(contexts, "h").select(F.col("gram").alias("key"), ((F.col("n") - F.col("d")) / F.col("total")).alias("w"))
    return weights, contexts.select(F.col("h").alias("key"), (F.col("left") / F.col("total")).alias("w"))


def train(trusted: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, key, w): discounted probabilities of n-grams (kind p) and backing-off weights of contexts (kind b)."""
    raw = stored(raw_grams(word_counts(trusted, text_col)))
    release(trusted.sparkSession)
    size = F.length("gram")
    level, parts = raw.where(size == ORDER), []
    for k in range(ORDER, 0, -1):
        grams, contexts = _level(level, k)
        parts += [grams.select(F.lit("p").alias("kind"), "key", "w"), contexts.select(F.lit("b").alias("kind"), "key", "w")]
        if k > 1:
            lower = level.select(F.expr(f"right(gram, {k - 1})").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
            level = stored(lower.union(raw.where(size == k - 1)))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return stored(out)


class Scorer:
    """Log probabilities of words, for the positions that belong to one shard of the model."""

    def __init__(self, p: dict, b: dict, shard: int, shards: int, other: float):
        self.p, self.b, self.shard, self.shards, self.other = p, b, shard, shards, other
        self.memo, self.older, self.grams = {}, {}, {}

    def place(self, gram: str) -> float:
        """Log probability of a gram's last character after the others; 0 where another shard has it."""
        i, p, b = len(gram) - 1, self.p, self.b
        if self.shards > 1 and shard_of(gram[max(0, i - 2) : i], self.shards) != self.shard:
            return 0.0
        prob = p.get(gram[i], 0.0) + b[""] * self.other
        for k in range(1, i + 1):
            weight = b.get(gram[i - k : i])
            if weight is None:
                break
            prob = p.get(gram[i - k :], 0.0) + weight * prob
        return math.log(prob)

    def word(self, w: str) -> float:
        s, grams, total = START + w + END, self.grams, 0.0
        for i in range(1, len(s)):
            gram = s[i - ORDER + 1 : i + 1] if i >= ORDER else s[: i + 1]
            value = grams.get(gram)
            if value is None:
                if len(grams) >= GRAMS:
                    grams.clear()
                value = grams[gram] = self.place(gram)
            total += value
        return total

    def text(self, words: list[str]) -> float:
        memo, total = self.memo, 0.0
        for w in words:
            value = memo.get(w)
            if value is None:
                value = self.older.get(w)
                if value is None:
                    value = self.word(w)
                if len(w) <= MEMO_CHARS:
                    if len(memo) >= MEMO:
                        self.older, self.memo = memo, {}
                        memo = self.memo
                    memo[w] = value
            total += value
        return total


def shard_of(context: str, shards: int) -> int:
    """Shard of the last two characters of a context; shorter contexts are in shard 0."""
    return (ord(context[-2]) * 1_000_003 + ord(context[-1])) % shards if len(context) >= 2 else 0


def log_probability(docs: DataFrame, model: DataFrame, text_col: str = "text", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """docs with `log_p` and `n_scored` (characters of words and their ends), null without a model or words."""
    rows, vocabulary = model.agg(F.count("*"), F.count(F.when((F.col("kind") == "p") & (F.length("key") == 1), 1))).first()
    out = without(docs, ["log_p", "n_scored"])
    if not rows:
        scored = F.length(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"\s+", ""))
        return out.withColumn("log_p", F.lit(None).cast("double")).withColumn("n_scored", F.when(scored > 0, scored.cast("bigint")))
    shards = -(-rows // shard_rows)
    context = F.when(F.col("kind") == "p", F.expr("left(key, length(key) - 1)")).otherwise(F.col("key"))
    last = F.right(context, F.lit(2))
    at = (F.ascii(last) * F.lit(1_000_003).cast("bigint") + F.ascii(F.right(context, F.lit(1)))) % shards
    keyed = model.withColumn("shard", F.when(F.length(context) >= 2, at))
    for shard in range(shards):
        part = keyed.where(F.col("shard").isNull() | (F.col("shard") == shard))
        tables = {"p": {}, "b": {}}
        for kind, key, w in zip(*[c.to_pylist() for c in part.select("kind", "key", "w").toArrow().columns]):
            tables[kind][key] = w
        sent = docs.sparkSession.sparkContext.broadcast(tables)
        added, before = _add_shard(out, sent, text_col, shard, shards, 1 / (vocabulary + 1)), out
        if shard + 1 < shards:  # chained steps of one stage would hold all shards at once
            added = stored(added)
            sent.unpersist()
            if shard:
                discard(before)
        out = added
    total = F.lit(0.0)
    for shard in range(shards):
        total = total + F.col(f"log_p__{shard}")
    found = out.withColumn("log_p", F.when(F.col("n_scored") > 0, total)).withColumn("n_scored", F.when(F.col("n_scored") > 0, F.col("n_scored")))
    return found.drop(*[f"log_p__{i}" for i in range(shards)])


def _add_shard(docs, sent, text_col, shard, shards, other):
    def make():
        scorer = Scorer(sent.value["p"], sent.value["b"], shard, shards, other)

        def batch(texts):
            words = [(t or "").split() for t in texts]
            return [scorer.text(w) for w in words], [sum(map(len, w)) + len(w) for w in words]

        return batch

    return add_columns(docs, text_col, {f"log_p__{shard}": "double", "n_scored": "bigint"}, make)


def classify(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """docs without their text, with `perplexity`, `threshold`, `kept`, `log_p` and `n_scored`."""
    outputs = ("perplexity", "threshold", "kept", "log_p", "n_scored")
    return aside(docs, [id_col, text_col, lang_col], outputs, lambda df: _classify(df, labels, text_col, id_col, lang_col, shard_rows))


def _classify(docs: DataFrame, labels: DataFrame, text_col: str, id_col: str, lang_col: str, shard_rows: int) -> DataFrame:
    trusted = labels.where("quality = 1").select(F.col("doc_id").alias(id_col)).distinct()
    # always by a shuffle of the text: ids of trusted documents have no bound that would allow a broadcast
    model = train(docs.select(id_col, text_col).join(trusted.hint("merge"), id_col, "left_semi"), text_col)
    scored = log_probability(docs, model, text_col, shard_rows).drop(text_col)
    scored = stored(scored.withColumn("perplexity", F.exp(-F.col("log_p") / F.col("n_scored"))))
    known = scored.where("perplexity is not null").join(trusted, id_col, "left_semi")
    at = F.percentile_approx("perplexity", QUANTILE, 100_000) * SLACK
    by = known.where(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("lang__")).agg(at.alias("own__"))
    overall = known.agg(at.alias("all")).first()["all"]
    # one row for each language: at most as many as there are language names
    placed = scored.join(F.broadcast(by) if by.count() <= LANGUAGES else by, F.col(lang_col) == F.col("lang__"), "left").withColumn("threshold", F.coalesce("own__", F.lit(overall).cast("double")))
    kept = F.when(F.col("threshold").isNull(), F.col("n_scored").isNotNull()).otherwise(F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)))
    return placed.withColumn("kept", kept).drop("lang__", "own__")
