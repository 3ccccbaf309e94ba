"""Registered queries of the operators, one for each, over whole tables."""

from __future__ import annotations

import public_tokenizers

from . import bpe, decontaminate, fertility, kneser_ney, langid, merkle, pii, secrets, sentence_dedup, simhash, suffix_dedup, toxicity, variants
from .common import documents, read_table
from .oracle import ORACLE  # noqa: F401  (name -> DuckDB SQL)

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op9_bpe_codec(spark, sf_dir):
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.digests(bpe.encode(documents(spark, sf_dir), vocabulary, decoded_col="decoded"))


@query
def op8_simhash_golay(spark, sf_dir):
    return simhash.digests(simhash.near_duplicates(documents(spark, sf_dir)))


@query
def op3_language_zstd(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs).select("doc_id", "held_out", "lang_pred", "score", "rejected")


@query
def op5_prefix_decontamination(spark, sf_dir):
    return decontaminate.digests(decontaminate.contamination(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark")))


@query
def op2_pii_weak_supervision(spark, sf_dir):
    return pii.digests(pii.detect(documents(spark, sf_dir)))


@query
def op7_secret_entropy(spark, sf_dir):
    return secrets.digests(secrets.detect(documents(spark, sf_dir)))


@query
def op6_tokenizer_fertility(spark, sf_dir):
    path = public_tokenizers.path
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return fertility.quality(docs, path("piece_bpe_32k.model"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("lang")


@query
def op1_sentence_spans(spark, sf_dir):
    return sentence_dedup.digests(sentence_dedup.dedup(documents(spark, sf_dir)))


@query
def op10_kneser_ney(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    return kneser_ney.classify(docs, labels).select("doc_id", "lang", "perplexity", "threshold", "kept")


@query
def op4_difference_cover(spark, sf_dir):
    return suffix_dedup.dedup(documents(spark, sf_dir))


@query
def op11_merkle_manifest(spark, sf_dir):
    return merkle.audit(read_table(spark, sf_dir, "documents").select(*merkle.FIELDS))


@query
def op12_label_model(spark, sf_dir):
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.digests(toxicity.score(documents(spark, sf_dir), labels))


@query
def op13_partenum_variants(spark, sf_dir):
    return variants.variants(documents(spark, sf_dir))
