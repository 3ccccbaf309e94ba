"""Columns of the input that have the names of operators' own columns come back with their values."""

import pytest

from parley.llm import bpe, decontaminate, fertility, kneser_ney, langid, merkle, pii, secrets, sentence_dedup, simhash, suffix_dedup, toxicity

NAMES = (
    "mark mark__ id__ own__ lang__ copies part_removed part_spans part_sha256 whole__ raw spots sure rest h h1 h2 at n k known spans spans__ "
    "text__in t__ p__ b__email m__tel s__key u v root fp key side word unit x__ toxic__ key__ place group__ node__ size__ block__ top__ c0__ own0__ aside0__ passed__"
).split()


@pytest.fixture(scope="module")
def docs(spark):
    text = "one two three four five six seven eight nine ten eleven twelve. " * 12
    rows = [(i, f"{text} {i % 3}" if i % 4 else None, "en", "s", 1, *[f"{n}={i}" for n in NAMES]) for i in range(24)]
    return spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *NAMES]).cache()


def operators(spark):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(24)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    import public_tokenizers as P

    return {
        "sentence_dedup": sentence_dedup.dedup, "suffix_dedup": suffix_dedup.dedup, "simhash": simhash.near_duplicates, "langid": langid.identify,
        "kneser_ney": lambda d: kneser_ney.classify(d, labels), "toxicity": lambda d: toxicity.score(d, labels), "merkle": merkle.manifest,
        "pii": pii.detect, "secrets": secrets.detect, "decontaminate": lambda d: decontaminate.contamination(d, bench),
        "bpe": lambda d: bpe.encode(d, P.path("byte_bpe_50k.json")),
        "fertility": lambda d: fertility.quality(d, P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN),
    }


@pytest.mark.parametrize("name", ["sentence_dedup", "suffix_dedup", "simhash", "langid", "kneser_ney", "toxicity", "merkle", "pii", "secrets", "decontaminate", "bpe", "fertility"])
def test_foreign_columns_come_back(spark, docs, name):
    made = operators(spark)[name](docs)
    own = {"merkle": {"root", "place"}, "simhash": {"fp"}}.get(name, set())  # outputs of theirs
    kept = [n for n in NAMES if n not in own]
    rows = made.select("doc_id", *kept).collect()
    assert len(rows) == 24 and all(r[n] == f"{n}={r['doc_id']}" for r in rows for n in kept)
