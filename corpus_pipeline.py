"""From raw documents to token ids: five stages, each one of the operators in parley.llm.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All
but the last return the columns of documents; further columns, whatever their names, pass
through. The rows of a stage's result:

* language_id: documents whose language is clear; those without text or letters, or with a
  narrow margin, go.
* simhash_near_dedup: of each group of near-duplicates the row with the smallest doc_id (rows
  without an id come last; of repeated rows one stays).
* benchmark_decontamination: documents without any benchmark window.
* pii: all, with personal data in their text replaced by its kind; n_chars follows the text.
* bpe: all, as token ids with digests of the ids and of the text decoded from them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import bpe, decontaminate, langid, pii, simhash
from parley.llm.common import cut_lineage, read_table

VOCABULARY = "byte_bpe_50k.json"
_PASSED = "passed__"


def _packed(docs: DataFrame, used: list[str]) -> DataFrame:
    """The used columns, and all others in one struct, so that an operator's outputs meet no column of the same name."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in used]
    return docs.select(*[F.col(f"`{c}`") for c in used], F.struct(F.lit(0).alias("none__"), *rest).alias(_PASSED))


def _unpacked(df: DataFrame, like: DataFrame) -> DataFrame:
    own = set(df.columns)
    return df.select(*[F.col(f"`{c}`") if c in own and c in ("doc_id", "text", "lang", "n_chars") else F.col(f"{_PASSED}.`{c}`").alias(c) for c in like.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = langid.identify(_packed(docs, ["doc_id", "text", "lang"]))
    return _unpacked(found.where(~F.col("rejected")), docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mark = F.xxhash64("text").alias("mark__")
    found = simhash.near_duplicates(docs.select("doc_id", "text", mark))
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id__"), F.col("mark__"))).alias("first")
    kept = found.groupBy("component_fp").agg(first).select("first.id__", F.col("first.mark__").alias("kept__")).distinct()
    rows = docs.select("*", mark)
    same = rows["doc_id"].eqNullSafe(kept["id__"]) & (rows["mark__"] == kept["kept__"])
    return rows.join(kept, same, "left_semi").dropDuplicates(["doc_id", "mark__"]).drop("mark__")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_packed(docs, ["doc_id", "text"]), read_table(spark, sf_dir, "benchmark"))
    return _unpacked(found.where(~F.col("contaminated")), docs)


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = pii.redact(pii.detect(_packed(docs, ["doc_id", "text"])))
    if "n_chars" in docs.columns:
        chars = F.when(F.size("pii_spans") > 0, F.length("text")).otherwise(F.col(f"{_PASSED}.n_chars"))
        found = found.withColumn("n_chars", chars.cast(docs.schema["n_chars"].dataType))
    return _unpacked(found, docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path(VOCABULARY), decoded_col="decoded")
    return found.select(
        "doc_id", "token_ids", (F.octet_length("token_ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii", pii_redaction),
    ("bpe", bpe_encoding),
]

#: SQL can express neither the compression nor the byte-pair encoding; tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
