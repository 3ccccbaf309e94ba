"""Threshold grid, one-pass sweep, target-precision/recall/F1 selection, risk bands, band lookup.

The sweep never pairs rows with thresholds: each distinct score is mapped to the
highest grid threshold it reaches (exact comparisons against k/100), counts are
aggregated per grid index, and suffix sums over the 91 grid rows give the
confusion matrix at every threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .metrics import zdiv

GRID_LO, GRID_HI = 5, 95  # thresholds 0.05 .. 0.95 step 0.01 (k / 100)

# ---- fixed values (risk-band texts) ----
BAND_ACTIONS = {
    "Low": "Low scam-risk score; no immediate alert, but still keep record for analysis.",
    "Medium": "Medium scam-risk score; conversation should be reviewed or monitored.",
    "High": "High scam-risk score; prioritize this conversation for warning or further review.",
}
FALLBACK_MEDIUM, FALLBACK_HIGH, TOP_EDGE = 0.33, 0.66, 1.01
FALLBACK_BASIS = "fallback fixed bands because validation-derived thresholds overlapped"


def grid_value(k) -> Column:
    kc = F.col(k) if isinstance(k, str) else (k if isinstance(k, Column) else F.lit(k))
    return kc.cast("double") / F.lit(100.0)


def grid_index(p) -> Column:
    """Largest k in [GRID_LO, GRID_HI] with k/100 <= p; GRID_LO - 1 when p is below the grid."""
    pc = F.col(p) if isinstance(p, str) else p
    c = F.floor(pc * 100).cast("int")
    c = F.when(grid_value(c + 1) <= pc, c + 1).when(grid_value(c) > pc, c - 1).otherwise(c)
    return F.greatest(F.lit(GRID_LO - 1), F.least(F.lit(GRID_HI), c))


def sweep(df: DataFrame, y: str, p: str, keys=()) -> DataFrame:
    """Confusion counts and precision/recall/F1 at every grid threshold, per group (rule ``p >= t``)."""
    keys = list(keys)
    per = df.groupBy(*keys, grid_index(p).alias("g")).agg(
        F.count_if(F.col(y) == 1).alias("n_pos"), F.count_if(F.col(y) == 0).alias("n_neg")
    )
    per = cut_lineage(per)  # at most 92 rows per group; the source is scanned once
    tot = per.groupBy(*keys).agg(F.sum("n_pos").alias("P"), F.sum("n_neg").alias("N"))
    grid = tot.select(*keys, "P", "N", F.explode(F.sequence(F.lit(GRID_LO), F.lit(GRID_HI))).alias("g"))
    full = grid.join(per.where(F.col("g") >= GRID_LO), [*keys, "g"], "left").fillna(0, ["n_pos", "n_neg"])
    w = Window.partitionBy(*keys).orderBy(F.col("g").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = full.select(*keys, "g", "P", "N", F.sum("n_pos").over(w).alias("tp"), F.sum("n_neg").over(w).alias("fp"))
    tp, fp = F.col("tp"), F.col("fp")
    fn, tn = F.col("P") - tp, F.col("N") - fp
    return s.select(
        *keys,
        grid_value("g").alias("threshold"),
        tp.alias("true_positive"),
        fp.alias("false_positive"),
        fn.alias("false_negative"),
        tn.alias("true_negative"),
        (tp + fp).alias("n_predicted_positive"),
        zdiv(tp, tp + fp).alias("precision"),
        zdiv(tp, tp + fn).alias("recall"),
        zdiv(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def _first(df: DataFrame, keys, order) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


SELECTED = ["threshold", "precision", "recall", "f1", "basis"]


def best_f1(sw: DataFrame, keys=()) -> DataFrame:
    b = _first(sw, keys, [F.col("f1").desc(), F.col("threshold")])
    return b.select(*keys, *SELECTED[:-1], F.lit("best F1 fallback").alias("basis"))


def _union_fallback(chosen: DataFrame, fallback: DataFrame, keys) -> DataFrame:
    """Chosen rows, plus the fallback row for every group that has no chosen row."""
    k = list(keys)
    if k:
        return chosen.unionByName(fallback.join(chosen.select(*k), k, "left_anti"))
    tag = F.lit(1).alias("_k")
    missing = fallback.select("*", tag).join(chosen.select(tag), "_k", "left_anti").drop("_k")
    return chosen.unionByName(missing)


def for_precision(sw: DataFrame, target: float = 0.90, keys=()) -> DataFrame:
    """Highest F1 (then recall) among thresholds with predictions and precision >= target."""
    cand = sw.where((F.col("n_predicted_positive") > 0) & (F.col("precision") >= F.lit(target)))
    return _union_fallback(
        _first(cand, keys, [F.col("f1").desc(), F.col("recall").desc(), F.col("threshold")]).select(
            *keys, *SELECTED[:-1], F.lit(f"precision >= {target}").alias("basis")
        ),
        best_f1(sw, keys),
        keys,
    )


def for_recall(sw: DataFrame, target: float = 0.90, keys=()) -> DataFrame:
    """Highest F1 (then precision) among thresholds with recall >= target."""
    cand = sw.where(F.col("recall") >= F.lit(target))
    return _union_fallback(
        _first(cand, keys, [F.col("f1").desc(), F.col("precision").desc(), F.col("threshold")]).select(
            *keys, *SELECTED[:-1], F.lit(f"recall >= {target}").alias("basis")
        ),
        best_f1(sw, keys),
        keys,
    )


def risk_bands(sw: DataFrame, keys=(), model: Column | None = None, method: Column | None = None,
               recall_target: float = 0.90, precision_target: float = 0.90) -> DataFrame:
    """Low / Medium / High bands [min, max) from the recall- and precision-based thresholds."""
    keys = list(keys)
    m = for_recall(sw, recall_target, keys).select(*keys, F.col("threshold").alias("m"), F.col("basis").alias("mb"))
    h = for_precision(sw, precision_target, keys).select(*keys, F.col("threshold").alias("h"), F.col("basis").alias("hb"))
    if keys:
        j = m.join(h, keys)
    else:
        j = m.withColumn("_k", F.lit(1)).join(h.withColumn("_k", F.lit(1)), "_k").drop("_k")
    overlap = F.col("m") >= F.col("h")
    j = j.select(
        *keys,
        F.when(overlap, F.lit(FALLBACK_MEDIUM)).otherwise(F.col("m")).alias("m"),
        F.when(overlap, F.lit(FALLBACK_HIGH)).otherwise(F.col("h")).alias("h"),
        F.when(overlap, F.lit(FALLBACK_BASIS))
        .otherwise(F.concat(F.lit("medium threshold based on "), F.col("mb"), F.lit("; high threshold based on "), F.col("hb")))
        .alias("threshold_basis"),
    )
    bands = F.array(
        F.struct(F.lit("Low").alias("risk_band"), F.lit(0.0).alias("probability_min"), F.col("m").alias("probability_max_exclusive"),
                 F.lit(BAND_ACTIONS["Low"]).alias("recommended_action")),
        F.struct(F.lit("Medium").alias("risk_band"), F.col("m").alias("probability_min"), F.col("h").alias("probability_max_exclusive"),
                 F.lit(BAND_ACTIONS["Medium"]).alias("recommended_action")),
        F.struct(F.lit("High").alias("risk_band"), F.col("h").alias("probability_min"), F.lit(TOP_EDGE).alias("probability_max_exclusive"),
                 F.lit(BAND_ACTIONS["High"]).alias("recommended_action")),
    )
    out = j.select(*keys, "threshold_basis", F.explode(bands).alias("b")).select(*keys, "b.*", "threshold_basis")
    extra = []
    if model is not None:
        extra.append(model.alias("selected_model"))
    if method is not None:
        extra.append(method.alias("calibration_method"))
    return out.select("*", *extra)


def assign_band(scores: DataFrame, bands: DataFrame, p: str, keys=()) -> DataFrame:
    """Range lookup ``min <= p < max`` against the band table: a group's few bands in one row, broadcast:
    a score meets one row where it stands, and groups (models) may be few and large; without groups, they become one CASE expression (no join, also on a stream)."""
    if not keys:
        out = F.lit(None).cast("string")
        for r in bands.select("risk_band", "probability_min", "probability_max_exclusive").collect():
            out = F.when((F.col(p) >= r["probability_min"]) & (F.col(p) < r["probability_max_exclusive"]), r["risk_band"]).otherwise(out)
        return scores.select("*", out.alias("risk_band"))
    row = F.collect_list(F.struct("probability_min", "probability_max_exclusive", "risk_band")).alias("_bands")
    of = bands.groupBy(*[F.col(k).alias(f"_b_{k}") for k in keys]).agg(row)
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"_b_{k}"))
    inside = F.filter("_bands", lambda b: (F.col(p) >= b["probability_min"]) & (F.col(p) < b["probability_max_exclusive"]))
    return scores.join(F.broadcast(of), same, "left").select(*scores.columns, F.get(inside, F.lit(0))["risk_band"].alias("risk_band"))
