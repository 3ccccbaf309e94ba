"""Operator 12: toxicity by weak supervision.

1. Voters. Lexicons of common insults by kind and language, lexicons learned from labelled
   texts (words, and beginnings of words, that toxic texts hold far more often), and patterns
   (several hits, dense hits, insults that address someone, spellings with digits or stars,
   stretched letters, shouting) each vote or abstain on each whole text.
2. Generative label model. A row's true label makes its votes. Voters depend on each other: the
   model is a tree in which each voter depends on the label and on one other voter. Expectation-
   maximisation estimates how often each voter fires under either label given its neighbour,
   and finds the tree as the spanning tree of the largest conditional mutual information. A
   known label is one more voter, whose accuracy is estimated too and isn't taken for certain.
3. Linear classifier. Logistic regression on counts and rates of hits, trained on the posterior
   labels; its probability is the score.

Scale: learning counts are partially aggregated over all labelled texts. The label model sees
one row for each pattern of votes, at most 2^voters of them whatever the number of rows. The
classifier is fitted on about SAMPLE rows, chosen by a hash of id and features. Lexicons hold
at most LEARNED units each, so what the tasks get has a fixed bound; the texts are
read for the lexicons and once more for the features, which are stored.

Rows: only rows with `held_out` false and a label are learned from (held out: the id's crc32
modulo 3 is 1; a null id isn't held out and has no label). Equal texts of different ids
teach once. Null, empty and letterless texts are scored like texts without a hit. Without labels
of both kinds no lexicon is learned, and the label model rests on the other voters. Repeated
rows get equal scores; of several labels of one id the largest counts. A table without rows
gives none; one without rows to learn from scores 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE, add_columns, aside, map_arrow, stored

# Common insults and threats, by kind and language.
LEXICONS = {
    "person": "idiot idiots moron morons loser losers clown clowns fool fools imbecile imbeciles jerk jerks dimwit halfwit blockhead dunce coward cowards liar creep creeps",
    "worth": "worthless trash scum garbage filth filthy vermin scumbag scumbags lowlife lowlifes subhuman parasite parasites degenerate degenerates",
    "manner": "stupid pathetic disgusting dumb ridiculous repulsive vile hideous retarded braindead revolting despicable contemptible loathsome",
    "harm": "kill murder strangle despise loathe exterminate lynch slaughter hate hated bastard bastards bitch bitches damn shit crap fuck fucking asshole",
    "foreign": (
        "dummkopf trottel vollidiot arschloch mistkerl schwachkopf abschaum dreckig ekelhaft widerlich scheiße verdammt wertlos "
        "connard connards salaud crétin abruti imbécile ordure dégoûtant minable merde débile raclure "
        "estúpido estúpida imbécil pendejo cabrón basura asqueroso inútil patético mierda idiota escoria"
    ),
}
#: Units a learned lexicon holds at most (those of the largest likelihood ratio); the bound of what tasks get.
LEARNED = 20_000
#: A unit is learned from this many toxic texts on, with at least this log ratio of rates (and a likelihood ratio beyond chance).
LEAST, RATIO = 3, 1.6
#: Code points of the beginnings of words that are units too.
BEGINNINGS = (4, 5, 6)
#: Rows that the classifier is fitted on at most.
SAMPLE = 60_000
#: Pairs in a task's memory before learning counts are handed on.
FLUSH = 400_000
EM_STEPS, EM_CLOSE = 200, 1e-6
#: The accuracy that a given label has at least.
TRUSTED = 0.98

WORD = re.compile(r"[^\W\d_]+")
UPPER = re.compile("[A-ZÀ-ÖØ-ÞΑ-ΩА-Я]")
MARKS = re.compile(r"[0134578@$!*]+(?=[^\W\d_])")
TOKEN = re.compile(r"(?:[^\W_]|[@$!*])+")
SWAPPED = str.maketrans("0134578@$!", "oieastbasi")
#: Code points on either side of a mark that a spelling with marks can have.
AROUND = 20
#: Words a task remembers as of no interest, or with their units, before it forgets them all.
REMEMBERED = 300_000
STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
ADDRESS = {"you", "your", "youre", "u", "du", "dich", "ihr", "tu", "te", "toi", "vous", "usted", "eres", "he", "she", "they", "this", "that", "the", "these", "such"}

VOTERS = (
    *[f"lexicon_{k}" for k in LEXICONS], "learned_word", "learned_words", "learned_start", "learned_starts",
    "two_hits", "dense", "addressed", "spelled", "stretched", "shouting",
)
FEATURES = (*VOTERS, "log_kinds", "log_hits", "rate", "log_words", "log_starts", "weight")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 3 == 1, F.lit(False))


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def units(word: str) -> list[str]:
    """A word, and its beginnings, which end in a star."""
    return [word, *[f"{word[:n]}*" for n in BEGINNINGS if len(word) > n]]


def learn(taught: DataFrame) -> dict[str, float]:
    """Weights of units, learned from rows (text, toxic): the log ratio of their rates in toxic and other texts."""

    def run(batches):
        seen, known = {0: Counter(), 1: Counter()}, {}

        def all_units(words):
            if len(known) > REMEMBERED:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = units(w)
            return {""}.union(*map(known.__getitem__, words))

        def out():
            for label, counts in seen.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(counts), pa.string()), pa.array([label] * len(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())],
                    names=["unit", "toxic", "n"],
                )
                counts.clear()

        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    seen[toxic].update(all_units(set(words_of(text))))
                if sum(map(len, seen.values())) > FLUSH:
                    yield from out()
        yield from out()

    counts = map_arrow(taught.select(F.col("text").cast("string"), F.col("toxic").cast("int")), run, "unit string, toxic int, n bigint")
    yes, no = (F.sum(F.when(F.col("toxic") == t, F.col("n")).otherwise(0)) for t in (1, 0))
    counts = stored(counts.groupBy("unit").agg(yes.alias("yes"), no.alias("no")).where(F.col("yes") >= LEAST))
    all_texts = counts.where("unit = ''").first()
    if all_texts is None or not all_texts["no"]:
        return {}
    n1, n0 = all_texts["yes"], all_texts["no"]
    a, b, share = F.col("yes").cast("double"), F.col("no").cast("double"), n1 / (n1 + n0)
    ratio = F.log((a + 0.5) / (n1 + 1)) - F.log((b + 0.5) / (n0 + 1))
    surprise = 2 * (a * F.log(a / ((a + b) * share)) + F.when(b > 0, b * F.log(b / ((a + b) * (1 - share)))).otherwise(0.0))
    least = 2 * math.log(counts.count())  # what chance reaches among so many units
    good = counts.where("unit != ''").select("unit", ratio.alias("weight"), surprise.alias("surprise"), F.col("unit").endswith("*").alias("start"))
    good = good.where((F.col("weight") >= RATIO) & (F.col("surprise") >= least))
    out = {}
    for start in (True, False):
        out |= {r["unit"]: r["weight"] for r in good.where(F.col("start") == start).orderBy(F.desc("surprise"), "unit").limit(LEARNED).collect()}
    return out


class Voters:
    """Votes and features of single texts."""

    def __init__(self, learned: dict[str, float]):
        self.kinds = {w: i for i, k in enumerate(LEXICONS.values()) for w in k.split()}
        self.words = {u: w for u, w in learned.items() if not u.endswith("*")}
        self.starts = {u[:-1]: w for u, w in learned.items() if u.endswith("*")}
        self.dull: set[str] = set()

    def start(self, word: str) -> float:
        return max((self.starts.get(word[:n], 0.0) for n in BEGINNINGS if len(word) > n), default=0.0)

    def stretched(self, word: str) -> bool:
        return STRETCHED.search(word) is not None and any(STRETCHED.sub(r"\1" * n, word) in self.kinds for n in (1, 2))

    def spelled(self, text: str) -> bool:
        """Whether a word of the lexicons stands in the text with marks in place of some letters, or between them."""
        for m in MARKS.finditer(text):
            at = m.start()
            if at and text[at - 1].isalpha():
                from_ = max(0, at - AROUND)
                for t in TOKEN.finditer(text[from_ : m.end() + AROUND].lower()):
                    token = t.group()
                    if t.start() <= at - from_ < t.end() and (token.translate(SWAPPED) in self.kinds or token.replace("*", "") in self.kinds or self.starred(token)):
                        return True
        return False

    def starred(self, token: str) -> bool:
        return "*" in token and any(len(w) == len(token) and all(a in (b, "*") for a, b in zip(token, w)) for w in self.kinds)

    def features(self, text: str | None) -> list[float]:
        """One number for each of FEATURES; the first are the votes, 1 or 0."""
        words = words_of(text)
        counts = Counter(words)
        by_kind, learned, starts, found, hits, stretched = [0] * len(LEXICONS), {}, {}, set(), 0, False
        if len(self.dull) > REMEMBERED:
            self.dull.clear()
        for w in counts.keys() - self.dull:
            kind, start, long = self.kinds.get(w), self.start(w), self.stretched(w)
            if kind is None and not start and not long and w not in self.words:
                self.dull.add(w)
                continue
            stretched |= long
            if kind is not None:
                by_kind[kind] += counts[w]
            if w in self.words:
                learned[w] = self.words[w]
            if start:
                starts[w] = start
            if kind is not None or w in learned or start:
                found.add(w)
                hits += counts[w]
        rate = hits / len(words) if words else 0.0
        letters = sum(map(len, words))
        addressed = bool(found) and any(w in found and not ADDRESS.isdisjoint(words[max(0, i - 3) : i]) for i, w in enumerate(words))
        shouting = letters > 0 and len(text) >= 40 and len(UPPER.findall(text)) > 0.5 * letters
        weight = sum(sorted({**starts, **learned}.values(), reverse=True)[:8])
        votes = [
            *[n > 0 for n in by_kind], len(learned) > 0, len(learned) > 1, len(starts) > 0, len(starts) > 1,
            len(found) > 1, rate >= 0.01, addressed, bool(text) and self.spelled(text), stretched, shouting,
        ]
        log = math.log1p
        return [float(v) for v in votes] + [log(len(found)), log(hits), min(1.0, 20 * rate), log(len(learned)), log(len(starts)), weight / 8]


class LabelModel:
    """Votes given a hidden label, each voter depending on the label and on one other voter (its parent in a tree)."""

    def __init__(self, patterns: np.ndarray, labels: np.ndarray, n: np.ndarray):
        """Distinct rows of votes (0 or 1), labels (1, 0, -1 for none) and how often each stands."""
        self.parents = [-1] * patterns.shape[1]
        self.accuracy = [0.97, 0.97]
        x, n = patterns.astype(np.int64), n.astype(float)
        says = x[:, : len(LEXICONS) + 4].sum(axis=1)
        post = np.where(labels == 1, 0.97, np.where(labels == 0, 0.03, np.where(says >= 2, 0.8, np.where(says == 1, 0.4, 0.02))))
        self.steps, last = 0, -math.inf
        for self.steps in range(1, EM_STEPS + 1):
            self._fit(x, labels, n * post, n * (1 - post))
            both = self._both(x, labels)
            top = np.logaddexp(both[1], both[0])
            post, now = np.exp(both[1] - top), float((n * top).sum() / n.sum())
            if abs(now - last) < EM_CLOSE:
                break
            last = now

    def _fit(self, x, labels, yes, no):
        v = x.shape[1]
        weight = (no, yes)
        self.prior = [(w.sum() + 1) / (yes.sum() + no.sum() + 2) for w in weight]
        for y, own in enumerate((0, 1)):
            right, wrong = weight[y][labels == own].sum(), weight[y][labels == 1 - own].sum()
            self.accuracy[y] = max(TRUSTED, (right + 49) / (right + wrong + 50))
        # joint[y][i, a, j, b]: how often voters i and j say a and b under label y
        hot = np.stack([1 - x, x], axis=2).reshape(len(x), 2 * v).astype(float)
        joint = [(hot.T @ (hot * w[:, None])).reshape(v, 2, v, 2) for w in weight]
        self.information = np.zeros((v, v))
        for y in (0, 1):
            total = joint[y][0, :, 0, :].sum() + 1
            for i, j in combinations(range(v), 2):
                p = (joint[y][i, :, j, :] + 0.25) / total
                p = p / p.sum()
                gain = (p * (np.log(p) - np.log(p.sum(1, keepdims=True)) - np.log(p.sum(0, keepdims=True)))).sum()
                self.information[i, j] += self.prior[y] * gain
                self.information[j, i] = self.information[i, j]
        self.parents = self._tree()
        self.table = np.zeros((v, 2, 2, 2))  # voter, label, parent's vote, own vote
        for y in (0, 1):
            for i, up in enumerate(self.parents):
                c = joint[y][up, :, i, :] if up >= 0 else np.tile(np.diag(joint[y][i, :, i, :]), (2, 1))
                each = np.diag(joint[y][i, :, i, :]) + 0.5
                c = c + 2 * each / each.sum()  # towards the voter's own rate where its parent's vote is rare
                self.table[i, y] = c / c.sum(axis=1, keepdims=True)

    def _tree(self) -> list[int]:
        """Parents in the spanning tree of the largest information, from voter 0."""
        parents, reached, best = [-1] * len(self.information), {0}, self.information[0].copy()
        link = [0] * len(self.information)
        while len(reached) < len(self.information):
            i = max((k for k in range(len(best)) if k not in reached), key=lambda k: best[k])
            parents[i] = link[i]
            reached.add(i)
            for j in range(len(best)):
                if j not in reached and self.information[i, j] > best[j]:
                    best[j], link[j] = self.information[i, j], i
        return parents

    def _both(self, x, labels) -> np.ndarray:
        """Log probability of each row with label 0 and 1."""
        out = np.zeros((2, len(x)))
        for y in (0, 1):
            out[y] = math.log(self.prior[y])
            for i, up in enumerate(self.parents):
                out[y] += np.log(self.table[i, y, x[:, up] if up >= 0 else 0, x[:, i]])
            out[y] += np.where(labels < 0, 0.0, np.log(np.where(labels == y, self.accuracy[y], 1 - self.accuracy[y])))
        return out

    def posterior(self, x: np.ndarray, labels: np.ndarray) -> np.ndarray:
        both = self._both(x.astype(np.int64), labels)
        return 1 / (1 + np.exp(np.clip(both[0] - both[1], -50, 50)))


class Classifier:
    """Logistic regression on features with soft labels."""

    def __init__(self, x: np.ndarray, target: np.ndarray, ridge: float = 1.0):
        self.mean = x.mean(axis=0)
        self.scale = np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1.0)
        z = np.hstack([np.ones((len(x), 1)), (x - self.mean) / self.scale])
        w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
        penalty[0] = 1e-6
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
            step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (p - target) + penalty * w)
            w = w - step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-9:
                break
        self.weights = w

    def column(self, x: str) -> Column:
        """The probability of label 1, from a column of features."""
        slope = self.weights[1:] / self.scale
        z = F.lit(float(self.weights[0] - slope @ self.mean))
        for i, w in enumerate(slope.tolist()):
            z = z + F.get(x, F.lit(i)) * F.lit(w)
        return 1 / (1 + F.exp(-z))


def taught_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(id, text, toxic) of the labelled rows to learn from, each text once."""
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("key")).agg(F.max(label_col).cast("int").alias("toxic"))
    known = known.where(~held_out("key"))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    marks = rows.select("id", F.xxhash64("text").alias("mark")).join(known, F.col("id") == F.col("key")).groupBy("mark").agg(F.min(F.struct("id", "toxic")).alias("s"))
    marks = marks.select(F.col("s.id").alias("key"), F.col("s.toxic").alias("toxic")).hint("merge")  # the same plan at every size
    return rows.where(~held_out("id")).join(marks, F.col("id") == F.col("key")).select("id", "text", "toxic")


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """docs without their text, with `held_out`, `votes` (names of the voters that fire) and `score`."""
    return aside(docs, [id_col, text_col], ("held_out", "votes", "score"), lambda df: _score(df, labels, id_col, text_col, label_col))


def _score(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    learned = learn(taught_rows(docs, labels, id_col, text_col, label_col))
    def make():
        voters = Voters(learned)
        return lambda texts: ([voters.features(t) for t in texts],)

    found = stored(add_columns(docs, text_col, {"x__": "array<double>"}, make).drop(text_col).withColumn("held_out", held_out(id_col)))
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("key__")).agg(F.max(label_col).cast("int").alias("toxic__"))
    open_rows = found.where(~F.col("held_out")).select(F.col(f"`{id_col}`").alias("id"), "x__")
    seen = open_rows.join(known, F.col("id") == F.col("key__"), "left").select("id", "x__", F.coalesce("toxic__", F.lit(-1)).alias("label"))
    votes = F.slice("x__", 1, len(VOTERS)).cast("array<int>")
    patterns = seen.groupBy(votes.alias("votes"), "label").agg(F.count("*").alias("n")).toPandas()
    fired = F.filter(F.array(*[F.when(F.get("x__", F.lit(i)) > 0, F.lit(v)) for i, v in enumerate(VOTERS)]), lambda v: v.isNotNull())
    found = found.withColumn("votes", fired)
    if patterns.empty:
        return found.withColumn("score", F.lit(0.0)).drop("x__")
    model = LabelModel(np.stack(patterns["votes"].to_numpy()), patterns["label"].to_numpy(), patterns["n"].to_numpy())
    share = min(1.0, SAMPLE / float(patterns["n"].sum()))
    drawn = F.pmod(F.xxhash64("id", "x__"), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = (seen.where(drawn) if share < 1 else seen).select("x__", "label").toPandas()
    x = np.stack(sample["x__"].to_numpy())
    classifier = Classifier(x, model.posterior(x[:, : len(VOTERS)], sample["label"].to_numpy()))
    return found.withColumn("score", classifier.column("x__")).drop("x__")


def digests(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.concat_ws(",", "votes").alias("votes"))
