"""Ridge regression on repeated random halves, from sums that Spark adds up; only the small systems of equations are solved in Python."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import rng


def is_train(key: Column, repeat: Column, seed: int) -> Column:
    """Whether a key falls into the training half of a repeat: the same on any partition."""
    return rng.uniform(seed, F.xxhash64(key, repeat).bitwiseAND(F.lit(0x7FFFFFFF))) < 0.5


def _solver(features: Sequence[str], targets: Sequence[str], ridge: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                n = row["n"]
                mean = np.array([row[f"s_{f}"] for f in features]) / n
                cross = np.array([[row[f"c_{min(i, j)}_{max(i, j)}"] for j in range(len(features))] for i in range(len(features))]) - n * np.outer(mean, mean)
                scale = np.sqrt(np.maximum(np.diag(cross), 0) / (n - 1))
                scale[scale < 1e-12] = 1.0  # a constant feature explains nothing
                for t in targets:
                    level = row[f"s_{t}"] / n
                    xy = np.array([row[f"x_{i}_{t}"] for i in range(len(features))]) - n * mean * level
                    slope = np.linalg.solve(cross / np.outer(scale, scale) + ridge * np.eye(len(features)), xy / scale) / scale
                    out.append((row["repeat"], t, level, level - float(slope @ mean), slope.tolist()))
            yield pd.DataFrame(out, columns=["repeat", "target", "level", "intercept", "slope"])

    return run


def half_models(rows: DataFrame, key: str, features: Sequence[str], targets: Sequence[str], repeats: int, ridge: float, seed: int = 1) -> DataFrame:
    """Ridge coefficients per repeat and target: (repeat, target, level, intercept, slope), level being the training mean.

    Features are standardised within the training half. Rows with a null key, feature or target are left out; a repeat
    whose half has fewer than 3 rows has no model.
    """
    train = _repeated(rows, key, features, targets, repeats, seed).where("train")
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s_{c}") for c in (*features, *targets)]]
    sums += [F.sum(F.col(a) * F.col(b)).alias(f"c_{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(features) if i <= j]
    sums += [F.sum(F.col(f) * F.col(t)).alias(f"x_{i}_{t}") for i, f in enumerate(features) for t in targets]
    grams = train.groupBy("repeat").agg(*sums).where("n >= 3")
    return grams.mapInPandas(_solver(features, targets, ridge), "repeat int, target string, level double, intercept double, slope array<double>")


def _repeated(rows: DataFrame, key: str, features: Sequence[str], targets: Sequence[str], repeats: int, seed: int) -> DataFrame:
    clean = rows.select(F.col(key).cast("string").alias("_key"), *[F.col(c).cast("double").alias(c) for c in (*features, *targets)]).na.drop()
    each = clean.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    return each.withColumn("train", is_train(F.col("_key"), F.col("repeat"), seed))


def holdout_r2(rows: DataFrame, key: str, features: Sequence[str], targets: Sequence[str], repeats: int = 15, ridge: float = 1.0, seed: int = 1) -> DataFrame:
    """Fit on the other half against its training mean: (target, repeats, n, r2, r2_sd), averaged over the repeats.

    Rows of one key always fall into the same half. No rows give no result. The models that go to the rows are `repeats`
    times `targets` in number, however many rows there are.
    """
    models = half_models(rows, key, features, targets, repeats, ridge, seed)
    held = _repeated(rows, key, features, targets, repeats, seed).where("NOT train")
    values = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("y")) for t in targets])).alias("_t")
    long = held.select("repeat", F.array(*features).alias("_x"), values).select("repeat", "_x", "_t.*")
    guess = F.col("intercept") + F.aggregate(F.zip_with("slope", "_x", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    both = long.join(F.broadcast(models), ["repeat", "target"]).withColumn("_guess", guess)
    fits = both.groupBy("target", "repeat").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.pow(F.col("y") - F.col("_guess"), F.lit(2.0))).alias("sse"), F.sum(F.pow(F.col("y") - F.col("level"), F.lit(2.0))).alias("sst")
    )
    r2 = 1 - F.col("sse") / F.nullif(F.col("sst"), F.lit(0.0))
    return fits.groupBy("target").agg(F.count(F.lit(1)).alias("repeats"), F.sum("n").alias("n"), F.avg(r2).alias("r2"), F.stddev_pop(r2).alias("r2_sd"))
