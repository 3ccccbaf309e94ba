"""Personal data by weak supervision (operator 2), in DataFrame functions alone.

Four base kinds (email, ip, card, phone) follow fixed patterns and always stay. Candidates of
more kinds (tel: local telephone numbers, ssn, iban, name) come from looser patterns where
they overlap no base span. On every span three labelers vote for (1), against (-1) or not at
all (0): a regex labeler on its format, a gazetteer labeler on lists of endings, prefixes
and given names, and a context labeler on cue words before it. Counts of vote patterns over
the whole corpus go to expectation-maximisation with two classes, which estimates how often
each labeler says what of either class. The posteriors are soft labels for the final span
classifier, naive Bayes over kind, length, share of digits, neighbouring character and votes.
A candidate stays if its log odds are above zero.

Patterns that are tried at each character of a long run are written so that they start at
the beginning of the run only, and possessively, which finds the same matches in linear time.

Cases: null text has no span and stays null; empty text has none; an empty table, or one
without candidates, leaves the classifier at its prior; equal texts get equal spans; each row
is its own, so repeated rows and null ids need no rule.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .common import aside, cut_lineage, without

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: kind -> (pattern, condition on the match). Same matches as the stated base patterns.
BASE = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda v: F.lit(True)),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", lambda v: v.rlike(rf"\A{_OCTET}(?:\.{_OCTET}){{3}}\z")),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", lambda v: _digits(v, 12, 19) & F.call_function("luhn_check", F.regexp_replace(v, "[^0-9]", ""))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: _digits(v, 9, 15)),
}
MORE = {
    "tel": r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Z0-9])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?\x20[A-Z][a-z]+(?:\x20[A-Z][a-z]+)?",
}
RANK = {k: i for i, k in enumerate([*BASE, *MORE])}
#: Formats that the regex labeler takes as right.
STRICT = {
    "email": r"\A[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9][A-Za-z0-9-]*\.)+[A-Za-z]{2,}\z",
    "ip": r"\A(?!0|127\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}\z",
    "card": r"\A[3-6][0-9]{3}(?:[\x20-]?[0-9]{2,6})+\z",
    "phone": r"\A\+[1-9][0-9]{0,2}[\x20.-]?\(?[0-9]",
    "tel": r"\A\(?[2-9][0-9]{2}",
    "ssn": r"\A(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
    "iban": r"\A(?:[A-Z]{2}[0-9]{2}(?:\x20[A-Z0-9]{4})+|[A-Z]{2}[0-9]{2}[A-Z0-9]+)",
    "name": r"\x20[A-Z][a-z]+\x20[A-Z][a-z]+\z",
}
#: What the gazetteer labeler knows: endings, prefixes, words.
GAZETTEER = {
    "email": r"\.(?:com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu|us|ca|ch|at|mx)\z",
    "ip": r"\A(?!10\.|192\.168\.|169\.254\.|255\.)",
    "card": r"\A(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"\A\+(?:1|33|34|44|49|39|41|43|52|54|61|81|86|91)",
    "tel": r"\A\(?(?:2[0-9]{2}|3[0-9]{2}|4[0-9]{2}|5[0-9]{2}|6[0-9]{2}|7[0-9]{2}|8(?!00|88|77|66)[0-9]{2}|9(?!00)[0-9]{2})",
    "iban": r"\A(?:DE|FR|ES|IT|GB|CH|AT|NL|BE|PT|IE|LU)",
    "name": r"\b(?:James|John|Robert|Michael|Mary|Anna|Maria|Peter|Paul|Jean|Pierre|Marie|Hans|Karl|Juan|Carlos|Ana|Luis|David|Sarah|Laura|Thomas)\b",
}
FOR = r"(?i)mail|contact|reach|call|phone|tel|mobil|fax|card|visa|account|konto|compte|cuenta|ssn|social|iban|address|name|write|host|server"
AGAINST = r"(?i)version|licen|isbn|order|section|chapter|v\.?\x20*\z|part\x20no|figure|page"
STEPS = 12
VOTES = ("by_regex", "by_gazetteer", "by_context")


def _digits(v: Column, least: int, most: int) -> Column:
    return F.length(F.regexp_replace(v, "[^0-9]", "")).between(least, most)


def _matches(df: DataFrame, text: str, kinds: dict, prefix: str) -> DataFrame:
    for kind, (pattern, _) in kinds.items():
        df = df.withColumn(f"{prefix}{kind}", F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
    for kind, (pattern, ok) in kinds.items():
        df = df.withColumn(f"{prefix}{kind}", S.located(F.col(text), pattern, F.col(f"{prefix}{kind}"), kind, RANK[kind], ok))
    return df


def _vote(kind: Column, value: Column, patterns: dict[str, str], no: int) -> Column:
    out = F.lit(0)
    for k, p in patterns.items():
        out = F.when(kind == k, F.when(value.rlike(p), 1).otherwise(no)).otherwise(out)
    return out


def _labelled(span: Column) -> Column:
    """A span with its labelers' votes and the features of the classifier."""
    kind, value, before = span["kind"], span["value"], span["before"]
    side = F.right(before, F.lit(1))
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    return F.struct(
        span["start"].alias("start"), span["rank"].alias("rank"), span["end"].alias("end"), kind.alias("kind"), value.alias("value"), before.alias("before"),
        _vote(kind, value, STRICT, -1).alias(VOTES[0]),
        _vote(kind, value, GAZETTEER, 0).alias(VOTES[1]),
        F.when(before.rlike(AGAINST), -1).when(before.rlike(FOR), 1).otherwise(0).alias(VOTES[2]),
        F.least(F.floor(F.length(value) / 4), F.lit(12)).cast("int").alias("long"),
        F.floor(4 * digits / F.length(value)).cast("int").alias("digits"),
        F.when(side == "", "start").when(side.rlike(r"\s"), "space").when(side.rlike(r"[\p{L}\p{N}]"), "word").otherwise("mark").alias("side"),
    )


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with `pii_base` (base spans) and `pii_all` (these and the further candidates, with votes and features)."""
    df = without(docs, ["pii_base", "pii_all"]).withColumn("t__", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    df = _matches(df, "t__", BASE, "b__")
    df = _matches(df, "t__", {k: (p, None) for k, p in MORE.items()}, "m__")
    df = df.withColumn("pii_base", F.sort_array(F.concat(*[F.col(f"b__{k}") for k in BASE])))
    more = S.apart(F.concat(*[F.col(f"m__{k}") for k in MORE]), F.col("pii_base"))
    df = df.withColumn("pii_all", F.transform(F.concat("pii_base", more), _labelled))
    return df.drop("t__", *[f"b__{k}" for k in BASE], *[f"m__{k}" for k in MORE])


FEATURES = ("kind", "long", "digits", "side", *VOTES)


def fit(found: DataFrame) -> dict[tuple[str, str], float]:
    """Log odds by (feature, value), and of the prior under ("", "").

    Counts of equal candidates are taken once, over the whole corpus: at most a few thousand
    rows, as every feature has few values. Expectation-maximisation runs over these.
    """
    # outer: else the optimizer asks for rows with candidates first, which finds all candidates twice
    seen = found.select(F.explode_outer("pii_all").alias("s")).where("s is not null").select(*[F.col(f"s.{f}").alias(f) for f in FEATURES])
    seen = cut_lineage(seen.groupBy(*FEATURES).agg(F.count("*").alias("n")))
    votes = seen.groupBy(*VOTES).agg(F.sum("n").alias("n"))
    if votes.isEmpty():
        return {("", ""): 0.0}
    prior, says = 0.5, {(v, x, y): 0.6 if x == y else 0.2 for v in VOTES for x in (-1, 0, 1) for y in (-1, 1)}

    def posterior() -> Column:
        odds = F.lit(math.log(prior) - math.log(1 - prior))
        for v in VOTES:
            for x in (-1, 0, 1):
                odds = odds + F.when(F.col(v) == x, math.log(says[v, x, 1]) - math.log(says[v, x, -1])).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))

    for _ in range(STEPS):
        marked = votes.withColumn("yes", F.col("n") * posterior()).withColumn("no", F.col("n") - F.col("yes"))
        sums = marked.agg(
            F.sum("yes").alias("yes"), F.sum("no").alias("no"),
            *[F.sum(F.when(F.col(v) == x, F.col(c)).otherwise(0.0)).alias(f"{c}{i}_{x + 1}") for i, v in enumerate(VOTES) for x in (-1, 0, 1) for c in ("yes", "no")],
        ).first()
        prior = (sums["yes"] + 1) / (sums["yes"] + sums["no"] + 2)
        says = {(v, x, y): (sums[f"{c}{i}_{x + 1}"] + 1) / (sums[c] + 3) for i, v in enumerate(VOTES) for x in (-1, 0, 1) for y, c in ((1, "yes"), (-1, "no"))}
    soft = seen.withColumn("yes", F.col("n") * posterior()).withColumn("no", F.col("n") - F.col("yes"))
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("string").alias("v")) for f in FEATURES])).alias("p")
    table = soft.select(pairs, "yes", "no").groupBy("p.f", "p.v").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).collect()
    yes, no = (sum(r[c] for r in table if r["f"] == "kind") for c in ("yes", "no"))
    return {("", ""): math.log((yes + 1) / (no + 1))} | {
        (r["f"], r["v"]): math.log((r["yes"] + 1) / (yes + 2)) - math.log((r["no"] + 1) / (no + 2)) for r in table
    }


def _odds(span: Column, weights: dict[tuple[str, str], float]) -> Column:
    known = F.create_map(*[F.lit(x) for (f, v), w in weights.items() for x in (f"{f}={v}", w)])
    out = F.lit(weights["", ""])
    for f in FEATURES:
        out = out + F.coalesce(F.element_at(known, F.concat(F.lit(f"{f}="), span[f].cast("string"))), F.lit(0.0))
    return out


def detect(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with `pii_base` and `pii_spans` (base spans and the candidates that the classifier keeps), sorted."""
    return aside(docs, [text_col], ("pii_base", "pii_spans", "pii_all"), lambda df: _detect(df, text_col))


def _detect(docs: DataFrame, text_col: str) -> DataFrame:
    found = candidates(docs, text_col)
    weights = fit(found.select("pii_all"))
    kept = F.filter("pii_all", lambda s: (s["rank"] < len(BASE)) | (_odds(s, weights) > 0))
    plain = F.transform(kept, lambda s: F.struct(*[s[f] for f in ("start", "rank", "end", "kind", "value", "before")]).cast(S.SPAN))
    return without(found, ["pii_spans"]).withColumn("pii_spans", F.sort_array(plain)).drop("pii_all")


def redact(found: DataFrame, text_col: str = "text") -> DataFrame:
    """Detected documents with each span of their text replaced by its kind in brackets."""
    return found.withColumn(text_col, S.replaced(F.col(text_col), F.col("pii_spans"), lambda k: F.concat(F.lit("["), F.upper(k), F.lit("]"))))


def digests(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", *[S.count(F.col("pii_base"), k).alias(f"n_{k}") for k in BASE],
        F.sha2(S.listed(F.col("pii_base")).cast("binary"), 256).alias("base_sha256"), S.listed(F.col("pii_spans")).alias("spans"),
    )
