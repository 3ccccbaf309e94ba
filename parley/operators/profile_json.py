"""Dataset profile (M1) as one nested row plus its JSON text; every part is a small aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import SEED, STRUCTURAL_FEATURES
from . import profile as prof

# ---- fixed values (profile texts) ----
FEATURE_DEFINITIONS = {
    "turn_count": "Number of parsed dialogue turns in a conversation thread.",
    "aggregate_num_urls": "Total number of URL patterns detected across all turns in a thread.",
    "aggregate_money_terms": "Total count of money-related keywords and amount patterns across a thread.",
    "ratio_request_messages": "Proportion of messages in a thread that appear to contain a request.",
}
REDACTION_RULES = {
    "email": "Email-like patterns are replaced with [REDACTED_EMAIL].",
    "phone": "Phone-like number patterns are replaced with [REDACTED_PHONE].",
    "ssn": "SSN-like patterns are replaced with [REDACTED_SSN].",
    "amount": "Money amount patterns are replaced with [REDACTED_AMOUNT].",
}
EXCLUDED_FEATURES = {
    "tf_idf": "Excluded to preserve interpretability and reduce computational complexity.",
    "deep_learning_embeddings": "Excluded because the project focuses on lightweight explainable structural features.",
    "llm_features": "Excluded because the project does not include LLM fine-tuning or deployment.",
}


def _map(d: dict):
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def _files(spark, files: dict[str, str]):
    """Struct of (path, exists, size_bytes) by name: a short list, looked up on the driver."""
    from ..sources.tables import input_presence

    found = {r["path"]: r for r in input_presence(spark, list(files.values())).collect()} if files else {}
    kind = "struct<path:string,exists:boolean,size_bytes:bigint>"
    entries = [
        F.struct(F.lit(p).alias("path"), F.lit(found[p]["exists"]).alias("exists"), F.lit(found[p]["size_bytes"]).cast("bigint").alias("size_bytes")).cast(kind)
        for p in files.values()
    ]
    return F.create_map(*[x for n, e in zip(files, entries) for x in (F.lit(n), e)]) if files else F.create_map().cast(f"map<string,{kind}>")


def dataset_profile(raw: DataFrame, turns: DataFrame, feats: DataFrame, input_files: dict | None = None, output_files: dict | None = None) -> DataFrame:
    """``input_files`` and ``output_files`` (name -> path) are listed with existence and size. Each input is aggregated once: its label distribution (checkpointed, a few rows) also
    gives its row count; the small per-thread feature table is checkpointed before describe."""
    from ..session import cut_lineage

    feats = cut_lineage(feats)
    labels, totals = [], []
    for name, df, col in [("raw_data", raw, "label"), ("parsed_data", turns, "thread_label"), ("feature_data", feats, "thread_label")]:
        dist = cut_lineage(prof.label_distribution(df, col, name))
        labels.append(prof.as_count_map(dist).withColumnRenamed("counts", name).withColumn("k", F.lit(1)))
        totals.append(dist.agg(F.sum("n").alias(name)).withColumn("k", F.lit(1)))
    counts = totals[0].join(totals[1], "k").join(totals[2], "k").select(
        "k", F.col("raw_data").alias("raw_rows"), F.col("parsed_data").alias("parsed_turn_rows"),
        F.col("feature_data").alias("thread_feature_rows"),
    )
    desc = prof.describe(feats, STRUCTURAL_FEATURES)
    stats = desc.agg(
        F.map_from_entries(
            F.collect_list(
                F.struct(
                    "feature",
                    F.struct(
                        "count",
                        "mean",
                        "std",
                        "min",
                        F.col("p25").alias("25%"),
                        F.col("p50").alias("50%"),
                        F.col("p75").alias("75%"),
                        "max",
                    ),
                )
            )
        ).alias("feature_summary_statistics")
    ).withColumn("k", F.lit(1))
    row = counts
    for m in labels:
        row = row.join(m, "k")
    row = row.join(stats, "k")
    profile = F.struct(
        F.lit(SEED).alias("random_seed"),
        _files(raw.sparkSession, input_files or {}).alias("input_files"),
        _files(raw.sparkSession, output_files or {}).alias("output_files"),
        F.struct("raw_rows", "parsed_turn_rows", "thread_feature_rows").alias("row_counts"),
        F.struct(
            F.array(*[F.lit(c) for c in raw.columns]).alias("raw_columns"),
            F.array(*[F.lit(c) for c in turns.columns]).alias("parsed_columns"),
            F.array(*[F.lit(c) for c in feats.columns]).alias("feature_columns"),
        ).alias("columns"),
        F.array(*[F.lit(c) for c in STRUCTURAL_FEATURES]).alias("structural_features"),
        _map(FEATURE_DEFINITIONS).alias("feature_definitions"),
        _map(REDACTION_RULES).alias("redaction_rules"),
        F.struct("raw_data", "parsed_data", "feature_data").alias("label_distribution"),
        F.col("feature_summary_statistics"),
        _map(EXCLUDED_FEATURES).alias("excluded_features"),
    )
    return row.select(profile.alias("profile")).select("profile", F.to_json("profile").alias("profile_json"))
