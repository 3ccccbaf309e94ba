"""Logistic regression for many runs at once: Newton (L2) / proximal Newton (L1) on
grouped aggregates.

Objective per run (the liblinear form, intercept penalised as a bias feature of value 1 unless
the run's ``penalise_intercept`` is false, which leaves it free):
    L2:  1/2 ||b||^2 + C * sum_i w_i * logloss_i
    L1:  ||b||_1     + C * sum_i w_i * logloss_i
on features standardised with the run's training mean and population std (a zero std
scales by 1). Runs that share their training rows share a ``part``: a row stands once for
each part, not for each run. An iteration is one pass over the compacted rows with all live
runs' coefficients: a batch of a part's rows meets the matrix of its runs' coefficients, which
gives all their losses, gradients (d+1) and Hessians (upper triangle) at once; each task hands
on one row of sums for each run. The driver solves the (d+1)x(d+1) step per run. Driver data:
run parameters only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

MAX_ITER = 1000
TOL = 1e-9


def part_stats(train: DataFrame, feats) -> DataFrame:
    """Mean and population std per part (row counts in ``cnt`` when rows are pre-compacted)."""
    if "cnt" not in train.columns:
        aggs = []
        for c in feats:
            aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std")]
        return train.groupBy("part").agg(*aggs)
    n = F.sum("cnt")
    aggs = [n.alias("_n")]
    for c in feats:
        aggs += [F.sum(F.col("cnt") * F.col(c)).alias(f"_s_{c}")]
    m = train.groupBy("part").agg(*aggs)
    means = m.select("part", "_n", *[(F.col(f"_s_{c}") / F.col("_n")).alias(f"{c}__mean") for c in feats])
    dev = train.join(means, "part").groupBy("part").agg(
        *[F.sum(F.col("cnt") * (F.col(c) - F.col(f"{c}__mean")) * (F.col(c) - F.col(f"{c}__mean"))).alias(f"_v_{c}") for c in feats],
        F.first("_n").alias("_n"),
    )
    out = means.drop("_n").join(dev, "part")
    return out.select("part", *[x for c in feats for x in (F.col(f"{c}__mean"), F.sqrt(F.col(f"_v_{c}") / F.col("_n")).alias(f"{c}__std"))])


def _z(feats):
    return [
        ((F.col(c) - F.col(f"{c}__mean")) / F.when(F.col(f"{c}__std") == 0, F.lit(1.0)).otherwise(F.col(f"{c}__std"))).alias(f"z{i}")
        for i, c in enumerate(feats)
    ]


def compact_standardized(train: DataFrame, feats, y: str = "y") -> tuple[DataFrame, DataFrame]:
    """(part, z0..z{d-1}, y, w) with w the row count, plus the per-part stats table."""
    stats = part_stats(train, feats)
    n = F.sum("cnt") if "cnt" in train.columns else F.count(F.lit(1))
    compact = train.groupBy("part", *feats, F.col(y).alias("y")).agg(n.alias("cnt"))
    rows = compact.join(stats, "part").select("part", *_z(feats), "y", F.col("cnt").cast("double").alias("w"))
    return rows, stats


def _aggregate(rows: DataFrame, live: dict, d: int, target: str = "y") -> dict:
    """One pass: each live run's loss, gradient and Hessian. live: run -> (part, coefficients, weights of the labels 0 and 1)."""
    by_part: dict = {}
    for run, (part, b, cw) in sorted(live.items()):
        by_part.setdefault(part, []).append((run, b, cw))
    packed = {p: ([r for r, _, _ in of], np.array([b for _, b, _ in of]).T, np.array([cw for _, _, cw in of]).T) for p, of in by_part.items()}
    upper = np.triu_indices(d + 1)
    width = 1 + (d + 1) + len(upper[0])

    def sums(batches):
        total: dict = {}
        for batch in batches:
            parts = batch.column(0).dictionary_encode()
            index, names = np.asarray(parts.indices), parts.dictionary.to_pylist()
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, d + 1)] + [np.ones(batch.num_rows)])
            t, w = (batch.column(i).to_numpy(zero_copy_only=False)[:, None] for i in (d + 1, d + 2))
            for i, part in enumerate(names):
                if part not in packed:
                    continue
                own = index == i
                _, b, cw = packed[part]
                z, y, weight = x[own], t[own], w[own] * np.where(t[own] == 1, cw[1], cw[0])
                m = z @ b
                s = 1 / (1 + np.exp(-np.clip(m, -700, 700)))
                loss = np.maximum(m, 0) + np.log1p(np.exp(-np.abs(m))) - y * m
                pairs = z[:, upper[0]] * z[:, upper[1]]
                made = np.vstack([(weight * loss).sum(axis=0), z.T @ (weight * (s - y)), pairs.T @ (weight * s * (1 - s))])
                total[part] = total[part] + made if part in total else made
        for part, made in total.items():
            runs = packed[part][0]
            yield pa.RecordBatch.from_arrays([pa.array(runs), *[pa.array(made[i]) for i in range(width)]], names=["run", *[f"v{i}" for i in range(width)]])

    columns = rows.select("part", *[F.col(f"z{i}").cast("double") for i in range(d)], F.col(target).cast("double"), F.col("w").cast("double"))
    made = columns.mapInArrow(sums, "run string, " + ", ".join(f"v{i} double" for i in range(width)))
    out = {}
    for r in made.groupBy("run").agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(width)]).collect():
        v = np.array([r[f"v{i}"] for i in range(width)])
        h = np.zeros((d + 1, d + 1))
        h[upper] = v[d + 2 :]
        out[r["run"]] = (v[0], v[1 : d + 2], h + np.triu(h, 1).T)
    return out


def _penalty(b, l1, weights):
    return float(weights @ np.abs(b)) if l1 else 0.5 * float(weights @ (b * b))


def _prox_newton_step(b, g, h, C, weights, iters=10_000):
    """argmin_d  C g.d + 1/2 C d.H.d + sum_j weights_j |b_j + d_j| by cyclic coordinate descent."""
    d = np.zeros_like(b)
    A = C * h
    for _ in range(iters):
        delta = 0.0
        for j in range(len(b)):
            a = A[j, j]
            if a <= 0:
                continue
            grad_j = C * g[j] + A[j] @ d - a * d[j]
            z = b[j] - grad_j / a  # unpenalised minimiser of the 1-d quadratic for (b_j + d_j)
            nb = np.sign(z) * max(abs(z) - weights[j] / a, 0.0)
            nd = nb - b[j]
            delta = max(delta, abs(nd - d[j]))
            d[j] = nd
        if delta < 1e-12:
            break
    return d


def fit_logistic(rows: DataFrame, params: DataFrame, d: int, target: str = "y", max_iter: int = MAX_ITER) -> DataFrame:
    """rows: (part, z0.., y|target, w); params: (run, C, l1[, part, balanced, penalise_intercept]).

    Without a part, a run is its own. Balanced runs weigh label c by n / (labels * n_c) of their
    part. Returns (run, b0..b{d}, iterations, converged) with b{d} the intercept; a run that reaches
    ``max_iter`` steps says so in ``converged``."""
    spark = rows.sparkSession
    for name, default in (("penalise_intercept", F.lit(True)), ("balanced", F.lit(False)), ("part", F.col("run"))):
        params = params if name in params.columns else params.withColumn(name, default)
    rows = rows if "part" in rows.columns else rows.withColumnRenamed("run", "part")
    prm, part, classes = {}, {}, {}
    given = params.select("run", "C", "l1", "penalise_intercept", "balanced", "part").collect()
    if any(r["balanced"] for r in given):
        for r in rows.groupBy("part", target).agg(F.sum("w").alias("n")).collect():
            classes.setdefault(r["part"], {})[r[target]] = r["n"]
    for r in given:
        weights = np.ones(d + 1)
        weights[d] = float(r["penalise_intercept"])
        prm[r["run"]] = (float(r["C"]), bool(r["l1"]), weights)
        n = classes.get(r["part"], {}) if r["balanced"] else {}
        part[r["run"]] = (r["part"], [sum(n.values()) / (len(n) * n[c]) if c in n else 1.0 for c in (0, 1)])
    runs = sorted(prm)
    beta = {r: np.zeros(d + 1) for r in runs}
    step = {r: np.zeros(d + 1) for r in runs}
    prev_obj = {r: np.inf for r in runs}
    done: dict = {}  # run -> (iterations, converged)
    schema = "run string, " + ", ".join(f"b{i} double" for i in range(d + 1)) + ", iterations int, converged boolean"
    for it in range(max_iter):
        live = [r for r in runs if r not in done]
        if not live:
            break
        stats = _aggregate(rows, {r: (part[r][0], beta[r], part[r][1]) for r in live}, d, target)
        for r in live:
            if r not in stats:
                done[r] = (it, False)
                continue
            C, l1, weights = prm[r]
            L, g, h = stats[r]
            obj = C * L + _penalty(beta[r], l1, weights)
            if obj > prev_obj[r] + 1e-12 * max(1.0, abs(prev_obj[r])) and np.abs(step[r]).max() > 1e-12:
                step[r] = step[r] / 2.0  # backtrack: halve the last step
                beta[r] = beta[r] - step[r]
                continue
            prev_obj[r] = obj
            if l1:
                s = _prox_newton_step(beta[r], g, h, C, weights)
            else:
                s = -np.linalg.lstsq(C * h + np.diag(weights), C * g + weights * beta[r], rcond=None)[0]
            if np.abs(s).max() < TOL:
                done[r] = (it, True)
                continue
            step[r] = s
            beta[r] = beta[r] + s
    return spark.createDataFrame([(r, *map(float, beta[r]), *done.get(r, (max_iter, False))) for r in runs], schema)


def fit_runs(train: DataFrame, runs: DataFrame, feats, y: str = "y") -> DataFrame:
    """train: (part, feats..., y[, cnt]); runs: (run, part, C, l1 [0/1 or bool], balanced). Model table:
    (run, coefficients ARRAY<DOUBLE> on standardised features, intercept, means, stds, iterations, converged).
    Without a part, train has the run."""
    if "part" not in train.columns:
        train, runs = train.withColumnRenamed("run", "part"), runs.withColumn("part", F.col("run"))
    params = runs.select(
        "run",
        "part",
        F.col("C").cast("double").alias("C"),
        (F.coalesce(F.col("l1").cast("double"), F.lit(0.0)) >= 1.0).alias("l1"),
        F.coalesce(F.col("balanced").cast("boolean"), F.lit(False)).alias("balanced"),
        (F.coalesce(F.col("penalise_intercept"), F.lit(True)) if "penalise_intercept" in runs.columns else F.lit(True)).alias("penalise_intercept"),
    )
    rows, stats = compact_standardized(train, feats, y)
    rows, stats = cut_lineage(rows), cut_lineage(stats)
    d = len(feats)
    beta = fit_logistic(rows, params, d)
    model = beta.join(params.select("run", "part"), "run").join(stats, "part")
    return model.select(
        "run",
        F.array(*[F.col(f"b{i}") for i in range(d)]).alias("coefficients"),
        F.col(f"b{d}").alias("intercept"),
        F.array(*[F.col(f"{c}__mean") for c in feats]).alias("means"),
        F.array(*[F.col(f"{c}__std") for c in feats]).alias("stds"),
        "iterations",
        "converged",
    )


def decision(feats, model_prefix: str = "") -> F.Column:
    """Linear score on standardised features from model columns (coefficients, intercept, means, stds)."""
    m = F.col(f"{model_prefix}intercept")
    for i, c in enumerate(feats):
        sd = F.element_at(F.col(f"{model_prefix}stds"), i + 1)
        z = (F.col(c) - F.element_at(F.col(f"{model_prefix}means"), i + 1)) / F.when(sd == 0, F.lit(1.0)).otherwise(sd)
        m = m + F.element_at(F.col(f"{model_prefix}coefficients"), i + 1) * z
    return m


def sigmoid(c: F.Column) -> F.Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def score(rows: DataFrame, models: DataFrame, feats) -> DataFrame:
    """Adds ``decision`` and ``p1`` for each row's run (one row per run in the model table)."""
    j = rows.join(models, "run")
    dec = decision(feats)
    return j.select(*rows.columns, dec.alias("decision"), sigmoid(dec).alias("p1"))
